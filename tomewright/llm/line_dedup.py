"""Line deduplication over a corpus: repeated and nearly repeated lines keep their earliest place.

A line is its sequence of lower-cased words; two lines are near if one word is replaced, inserted or deleted, or, from 30
words on, one word in each full 15 of the longer line. All steps are DataFrame operations:

1. Equal lines are one (by 128-bit hashes); its earliest place is the least (key, line number).
2. A line that may have a near line shares its first or its last half of words with another one, whatever the edit
   is: only such lines go on, which spares all others the larger step.
3. Deletion neighbourhood: a line emits a hashed key for itself and for itself less each word (outside the half it shares). Equal keys join. Lines
   less the same place are one substitution apart, so a group needs only its earliest line as partner; a
   line equal to a longer one less a word pairs with the earliest of the other side. Pairs grow with the
   keys, not with their square.
4. The edit distance of each pair is verified on the words. Lines with an earlier near line go, wherever they stand.
5. Lines that more edits may join share a run of 10 words, as k edits cut N words into k + 1 runs. Of each 3 neighbouring
   eight-word runs the least hash is a key, so two lines with such a run share a key, wherever it stands; only lines that
   share one go on. An edit changes four of the four-word pieces at most, so of a line's distinct pieces, put in any order that all lines
   have in common, a near line shares one of the first 4k + 1, and that one is among its own first ones too. The order
   is by the number of lines with the piece, rarest first. A line whose first pieces are its own has no partner, and a passage that
   very many lines have is no key of lines with text of their own. A line meets the earliest line of its key and length
   class first; only lines not near to that one meet all earlier ones of their keys. Pairs whose words,
   counted in a few classes, differ by more than the edits allow are dropped before any text is joined.
   Word edit distances are verified by characters that stand for words. A key of the rarest pieces that many lines share, none near
   to the earliest, still costs up to the square of these lines: variants of one text, more edits from each other than from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, other_columns, stash, text_or_empty

#: Shorter lines are never duplicates; lines shorter than the second have no near lines.
MIN_WORDS, NEAR_WORDS = 5, 10
#: Lines of twice as many words or more may differ by one word in each full so many.
WORDS_PER_EDIT = 15
#: Words of a run that is hashed into a key of step 5, and of the pieces that are counted.
KEY_WORDS, GRAM_WORDS = 8, 4
#: Lines of more words aren't sketched: a count would not fit its byte. Seeds of the sketches.
SKETCHED_WORDS, SKETCHES = 255, (3, 4)
#: Characters that stand for words by hash; the 112,000 others are for words whose hashes clash within a pair of lines.
NUMBERS = 1_000_000


#: White space inside a line that isn't a single space.
ODD_SPACE = r"[ \t\x0B\x0C\r]{2,}|[\t\x0B\x0C\r]"


def _plain(text: Column) -> Column:
    """Lower case, one space for each run of white space inside a line: words are what stands between single spaces."""
    return F.lower(F.regexp_replace(text, ODD_SPACE, " "))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _t, _row (hash of the text, which tells rows of equal keys apart)."""
    return df.select(F.col(key).alias("_key"), text_or_empty(text).alias("_t")).withColumn("_row", F.xxhash64("_t"))


def _lines(texts: DataFrame, min_words: int) -> DataFrame:
    """_key, _row, _no, _line (words and single spaces), _n (number of words) of the lines of min_words or more."""
    lines = texts.select("_key", "_row", F.posexplode(F.split(_plain(F.col("_t")), "\n", -1)).alias("_no", "_line")).withColumn("_line", F.trim("_line"))
    spaces = F.octet_length("_line") - F.octet_length(F.replace(F.col("_line"), F.lit(" "), F.lit("")))
    return lines.withColumn("_n", F.when(F.col("_line") == "", 0).otherwise(spaces + 1)).where(F.col("_n") >= min_words)


def _halves(near_words: int, most: int | None) -> Column:
    """Hashes of the first and the last n/2 words, and for even n also of (n - 1)/2; none for lines without near lines or of more
    than most words. The line stays a string: its halves are cut at spaces, and no array of words is made."""
    n = F.col("_n")
    cut = lambda count: F.call_function("substring_index", F.col("_line"), F.lit(" "), count.cast("int"))
    pair = lambda size: [F.xxhash64(cut(size)), F.xxhash64(F.lit(2), cut(-size))]
    large, small = F.floor(n / 2), F.floor((n - 1) / 2)
    wanted = n >= near_words if most is None else (n >= near_words) & (n <= most)
    none = F.array().cast("array<bigint>")
    return F.when(wanted & (n % 2 == 0), F.array(*pair(large), *pair(small))).when(wanted, F.array(*pair(small))).otherwise(none)


def _edit_distance_at_most_one(a: str, b: str) -> Column:
    """Shared words from the front and from the back cover all but one of the longer line."""
    same_from = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
    size_a, size_b = F.size(a), F.size(b)
    front = same_from(a, b)
    back = same_from(F.reverse(a), F.reverse(b))
    return (F.abs(size_a - size_b) <= 1) & ((front == 0) | (front - 1 + back - 1 >= F.greatest(size_a, size_b) - 1))


def _first_lines(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The lines in places (_h, _g, at and others), each once, with _line and r, a number that grows with at."""
    # The earliest places of these lines, gathered by text, say which lines to take from which texts.
    rest = [c for c in places.columns if c != "at"]
    by_text = stash(places.groupBy("at._key", "at._row").agg(F.collect_list(F.struct(*places.columns)).alias("wanted")), "by_text")
    rows = texts.join(by_text, texts["_key"].eqNullSafe(by_text["_key"]) & (texts["_row"] == by_text["_row"])).select(F.split(_plain(F.col("_t")), "\n", -1).alias("_split"), "wanted")
    first = rows.select("_split", F.explode("wanted").alias("x")).select("x.at", *[f"x.{c}" for c in rest], F.trim(F.get("_split", F.col("x.at._no"))).alias("_line"))
    # Repeated rows bring a place several times. Numbers instead of places: they are compared and gathered as longs.
    once = first.groupBy("at").agg(*[F.first(c).alias(c) for c in (*rest, "_line")])
    return stash(once.orderBy("at").drop("at").withColumn("r", F.monotonically_increasing_id()), "first")


def _words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.split("_line", " ", -1)).drop("_line")


def _near_lines(texts: DataFrame, hashed: DataFrame) -> DataFrame:
    """_h, _g of the lines that have an earlier line one edit away."""
    long = hashed.where(F.size("_halves") > 0)
    halves = long.select("_h", F.posexplode("_halves").alias("side", "half")).withColumn("side", F.col("side") % 2)
    shared = stash(halves.groupBy("half").agg(F.min("_h").alias("low"), F.max("_h").alias("high")).where("low <> high").select("half"), "halves")
    sides = [F.max(F.col("side") == s).alias(f"side{s}") for s in (0, 1)]
    chosen = stash(halves.join(shared, "half", "left_semi").groupBy("_h").agg(*sides), "chosen")
    if chosen.isEmpty():
        return hashed.select("_h", "_g").limit(0)
    # Stored, so that a line with very many copies is split in the join and combined before the next shuffle.
    copies = stash(long.select("_h", "_g", "_key", "_row", "_no").join(chosen, "_h"), "copies")
    places = copies.groupBy("_h", "_g", "side0", "side1").agg(F.min(F.struct("_key", "_row", "_no")).alias("at"))
    first = _first_lines(texts, stash(places, "places"))

    # Keys of all lines less a word in one pass over their words: xor of hashed (word, place), with places after the gap moved.
    words = _words(first.repartition("r")).select("r", F.size("w").alias("n"), "side0", "side1", F.posexplode("w").alias("i", "word"))
    seeds = (0, 1)
    words = words.withColumns({f"a{s}": F.xxhash64(F.lit(s), "word", "i") for s in seeds} | {f"b{s}": F.xxhash64(F.lit(s), "word", F.col("i") - 1) for s in seeds})
    line = Window.partitionBy("r").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumns({f"{c}{s}_to": F.bit_xor(f"{c}{s}").over(line) for c in "ab" for s in seeds})
    whole = Window.partitionBy("r")
    words = words.withColumns({f"{c}{s}_all": F.bit_xor(f"{c}{s}").over(whole) for c in "ab" for s in seeds})
    gap = [F.col(f"a{s}_to").bitwiseXOR(F.col(f"a{s}")).bitwiseXOR(F.col(f"b{s}_all")).bitwiseXOR(F.col(f"b{s}_to")) for s in seeds]
    own = [F.col(f"a{s}_all") for s in seeds]
    keyed = lambda role, n, values, *more: F.struct(F.lit(role).cast("byte").alias("role"), *[F.xxhash64(n, v, *more).alias(f"k{s}") for s, v in zip(seeds, values, strict=True)])
    # Where only one half is like another line's, the edit lies outside that half.
    half = F.floor((F.col("n") - 1) / 2)
    open_place = (F.col("side0") & F.col("side1")) | (F.col("side0") & (F.col("i") >= half)) | (F.col("side1") & (F.col("i") < F.col("n") - half))
    replaced = F.when(open_place, keyed(0, F.col("n"), gap, F.col("i")))
    shorter = F.when(open_place, keyed(2, F.col("n") - 1, gap))
    itself = F.when(F.col("i") == 0, keyed(1, F.col("n"), own))
    keys = words.select("r", F.explode(F.array_compact(F.array(replaced, shorter, itself))).alias("k")).select("r", "k.role", "k.k0", "k.k1")
    keys = stash(keys, "variants")
    # A replaced word and a shorter line hash different inputs, so their keys don't meet.
    is_shorter = F.col("role") == 2
    least = [F.min(F.when(~is_shorter, F.col("r"))).alias("whole"), F.min(F.when(is_shorter, F.col("r"))).alias("shorter"), F.max("r").alias("high")]
    groups = stash(keys.groupBy("k0", "k1").agg(*least).where(F.least("whole", "shorter") < F.col("high")).drop("high"), "groups")
    partner = F.when(F.col("role") == 1, F.col("shorter")).otherwise(F.col("whole"))
    pairs = keys.join(groups, ["k0", "k1"]).select("r", partner.alias("partner")).where("partner < r").distinct()
    left = first.select("r", "_h", "_g", F.col("_line").alias("line_a"))
    right = first.select(F.col("r").alias("partner"), F.col("_line").alias("line_b"))
    both = pairs.join(right, "partner").join(left, "r")
    return both.withColumns({"w_a": F.split("line_a", " ", -1), "w_b": F.split("line_b", " ", -1)}).where(_edit_distance_at_most_one("w_a", "w_b")).select("_h", "_g").distinct()


def _run_words(per: int) -> int:
    """Words of the run that lines in reach of more than one edit share."""
    return -(-2 * (per - 1) // 3)


def _hashed_runs(w: Column, words: int) -> Column:
    """Hashes of all runs of so many words."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(F.slice(w, i + 1, words)))


def _run_keys(per: int) -> Column:
    """Least hashes of neighbouring runs, such that lines in reach of more than one edit share one."""
    run = _run_words(per)
    gram = min(KEY_WORDS, run)
    near = run - gram + 1
    hashes = lambda w: _hashed_runs(w, gram)
    least = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - near), lambda i: F.array_min(F.slice(h, i + 1, near)))
    # Arrays of one element bind what is used for each place, so that it is computed once.
    return F.array_distinct(F.transform(F.transform(F.array(F.split("_line", " ", -1)), hashes), least)[0])


def _pieces(line: str, gram: int) -> Column:
    """Hashes of the distinct runs of gram words of a line."""
    return F.array_distinct(F.transform(F.array(F.split(line, " ", -1)), lambda w: _hashed_runs(w, gram))[0])


def _rarest_pieces(lines: DataFrame, per: int) -> DataFrame:
    """r, keys: the pieces of a line, rarest first, that any line in reach shares one of. Lines whose such pieces are all their own aren't there."""
    gram = min(GRAM_WORDS, _run_words(per))
    n = F.octet_length("_line") - F.octet_length(F.replace(F.col("_line"), F.lit(" "), F.lit(""))) + 1
    # The longer line of a pair has k * per words or more, this one k fewer at most.
    first = (gram * F.floor(n / (per - 1)) + 1).cast("int")
    pieces = lines.select("r", first.alias("first"), _pieces("_line", gram).alias("p"))
    each = stash(pieces.select("r", "first", F.size("p").alias("m"), F.explode("p").alias("k")), "pieces")
    counted = stash(each.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "counted")
    common = stash(each.select("r", "k").join(counted, "k"), "common").groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "k"))).alias("found"))
    sizes = each.groupBy("r").agg(F.first("first").alias("first"), F.first("m").alias("m"))
    # The pieces that no other line has come first.
    left = F.col("first") - (F.col("m") - F.size("found"))
    return common.join(sizes, "r").where(left > 0).select("r", F.slice("found", 1, left).k.alias("keys"))


def _as_characters(numbers: Column) -> Column:
    """One character for each number from 0 on, without the surrogates (numbers repeat beyond all 1,112,000)."""
    point = lambda x: x + F.when(x >= 0xD7FF, 0x801).otherwise(1)
    return F.decode(F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(point(F.pmod(x, F.lit(1_112_000)))), 8, "0")), "")), "UTF-32")


def _within(pairs: DataFrame, lines: DataFrame, per: int) -> DataFrame:
    """r of the pairs (r, p_r) whose word edit distance is in the bound."""
    code = lambda w: _as_characters(F.transform(w, _number))
    bound = f"greatest(size(w_a), size(w_b)) div {per}"
    # Characters shared by different words make distances less, never more: a pair that passes is checked again with own characters for these.
    right = lines.select(F.col("r").alias("p_r"), F.col("_line").alias("line_b"))
    both = pairs.join(right, "p_r").join(lines.select("r", F.col("_line").alias("line_a")), "r")
    split = both.select("r", F.split("line_a", " ", -1).alias("w_a"), F.split("line_b", " ", -1).alias("w_b"))
    passed = split.withColumns({"code_a": code("w_a"), "code_b": code("w_b")}).where(F.expr(f"levenshtein(code_a, code_b, cast({bound} as int)) >= 0"))
    bind = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (computed once, not for each element)

    def distance(known: Column, clashing: Column) -> Column:
        words = F.filter(known, lambda x: F.array_contains(clashing, _number(x)))
        own = lambda w, c: _as_characters(F.transform(w, lambda x: F.when(F.array_contains(clashing, _number(x)), NUMBERS + F.array_position(c, x)).otherwise(_number(x))))
        return F.when(F.size(clashing) == 0, 0).otherwise(bind(words, lambda c: F.call_function("levenshtein", own(F.col("w_a"), c), own(F.col("w_b"), c), F.expr(f"cast({bound} as int)"))))

    repeated = lambda numbers: F.array_distinct(F.filter(numbers, lambda x, i: x == F.get(numbers, i - 1)))
    clashing = lambda known: bind(F.array_sort(F.transform(known, _number)), repeated)
    exact = bind(F.array_distinct(F.concat("w_a", "w_b")), lambda known: bind(clashing(known), lambda c: distance(known, c)))
    # Beyond the bound the distance is -1.
    return passed.where(exact >= 0).select("r").distinct()


def _number(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(NUMBERS))


def _counts(words: str, seed: int) -> Column:
    """Words by hash in seven classes, counted in a byte each of one number."""
    one = lambda w: F.element_at(F.array(*[F.lit(1 << 8 * i).cast("long") for i in range(7)]), (F.pmod(F.xxhash64(F.lit(seed), w), F.lit(7)) + 1).cast("int"))
    counted = F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + one(w))
    return F.when(F.size(words) <= SKETCHED_WORDS, counted).otherwise(F.lit(0).cast("long"))


def _apart(a: Column, b: Column) -> Column:
    """Sum of the differences of the counts: two at most for each word edit."""
    count = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))
    parts = [F.abs(count(a, i) - count(b, i)) for i in range(7)]
    return sum(parts[1:], parts[0])


def _near_by_more_edits(texts: DataFrame, hashed: DataFrame, near: DataFrame, per: int) -> DataFrame:
    """near, and _h, _g of the lines that have an earlier line in reach of more than one edit."""
    long = hashed.where(F.size("_keys") > 0)
    keys = long.select("_h", F.explode("_keys").alias("k"))
    shared = stash(keys.groupBy("k").agg(F.min("_h").alias("low"), F.max("_h").alias("high")).where("low <> high").select("k"), "shared")
    found = stash(keys.join(shared, "k", "left_semi").select("_h").distinct(), "members")
    if found.isEmpty():
        return near
    places = long.select("_h", "_g", F.struct("_key", "_row", "_no").alias("at")).groupBy("_h", "_g").agg(F.min("at").alias("at"))
    lines = _first_lines(texts, stash(places.join(found, "_h"), "places"))
    n = F.size("w")
    keyed = lines.join(stash(_rarest_pieces(lines, per), "rarest"), "r")
    sketched = stash(keyed.select("r", "keys", F.split("_line", " ", -1).alias("w")).select("r", "keys", n.alias("n"), *[_counts("w", seed).alias(f"s{seed}") for seed in SKETCHES]), "sketched")
    n, sketches = F.col("n"), [f"s{seed}" for seed in SKETCHES]
    members = stash(sketched.select("r", n, *sketches, F.floor(F.log(n) * 8).alias("class"), F.explode("keys").alias("k")), "keyed")
    longer = F.greatest("n", "p_n")
    bound = F.floor(longer / per)
    reach = (F.col("p_r") < F.col("r")) & (longer >= 2 * per) & (F.abs(F.col("n") - F.col("p_n")) <= bound)
    for c in sketches:
        reach = reach & ((longer > SKETCHED_WORDS) | (_apart(F.col(c), F.col(f"p_{c}")) <= 2 * bound))
    named = [F.col(c).alias(f"p_{c}") for c in ("r", "n", *sketches)]

    known = lines.join(near, ["_h", "_g"], "left_semi").select("r")
    earliest = members.groupBy("k", "class").agg(F.min("r").alias("r"), *[F.min_by(c, "r").alias(c) for c in ("n", *sketches)]).select("k", "class", *named)
    pairs = members.join(known, "r", "left_anti").join(earliest, ["k", "class"]).where(reach).select("r", "p_r").distinct()
    met = stash(known.unionByName(_within(pairs, lines, per)), "near_first")
    pairs = members.join(met, "r", "left_anti").join(members.select("k", *named), "k").where(reach).select("r", "p_r").distinct()
    met = met.unionByName(_within(stash(pairs, "open_pairs"), lines, per))
    return stash(near.unionByName(lines.join(met, "r", "left_semi").select("_h", "_g")).distinct(), "near_more")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, words_per_edit: int | None = WORDS_PER_EDIT) -> DataFrame:
    """df with duplicate lines taken out of its texts, and n_lines, n_exact, n_near (lines there were, taken as equal, taken
    as near). A line is taken if it has min_words words and an equal line stands earlier, or near_words words and an
    earlier line is one word edit away, or as many as the longer line has full words_per_edit words (None: one edit whatever
    the length); earlier is by key (null first), then line number.

    A null text stays null, an empty one empty; a text may lose all its lines. Repeated rows (equal key and text) count
    as one document and come out alike. Columns named like a made one are replaced, all others pass through."""
    keep = other_columns(df, "n_lines", "n_exact", "n_near")
    texts = _texts(df, key, text)
    none = F.array().cast("array<bigint>")
    # Lines of 2 * words_per_edit words have more edits; their pairs, those of one edit too, share runs.
    made = [_halves(near_words, 2 * words_per_edit - 1 if words_per_edit else None).alias("_halves")]
    if words_per_edit:
        made.append(F.when(F.col("_n") >= max(near_words, 2 * words_per_edit - 2), _run_keys(words_per_edit)).otherwise(none).alias("_keys"))
    place = F.struct("_key", "_row", "_no")
    hashed = stash(_lines(texts, min_words).select("_key", "_row", "_no", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), "_line").alias("_g"), *made), "lines")
    near = stash(_near_lines(texts, hashed), "near")
    near = _near_by_more_edits(texts, hashed, near, words_per_edit) if words_per_edit else near
    firsts = hashed.groupBy("_h", "_g").agg(F.min(place).alias("at"), F.count("*").alias("n")).join(near.withColumn("near", F.lit(True)), ["_h", "_g"], "left").where("n > 1 or near").select("_h", "_g", "at", F.coalesce("near", F.lit(False)).alias("near"))
    taken = hashed.select("_key", "_row", "_no", "_h", "_g").join(stash(firsts, "firsts"), ["_h", "_g"]).where(F.col("near") | (place != F.col("at")))
    by_text = taken.groupBy("_key", "_row").agg(F.collect_set("_no").alias("_gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("_no")))).alias("n_near"))
    rows = df.select(*keep, F.xxhash64(text_or_empty(text)).alias("_row"))
    joined = rows.alias("r").join(by_text.alias("g"), F.col(f"r.{key}").eqNullSafe(F.col("g._key")) & (F.col("r._row") == F.col("g._row")), "left")
    split = F.split(F.col(f"r.{text}"), "\n", -1)
    # The places that stay, in order; array_except and a lookup keep it linear.
    kept_places = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone")))
    cleaned = F.when(F.col("_gone").isNull(), F.col(f"r.{text}")).otherwise(F.transform(F.array(split), lambda s: F.array_join(F.transform(kept_places, lambda i: F.get(s, i)), "\n"))[0])
    # A line with a word, from its first other character on, is one match.
    n_lines = F.coalesce(F.regexp_count(F.col(f"r.{text}"), F.lit(f"[^{ASCII_SPACE}][^\n]*")), F.lit(0)).cast("long")
    n_near = F.coalesce("n_near", F.lit(0)).cast("long")
    return joined.select(*[(cleaned.alias(text) if c == text else F.col(f"r.{c}")) for c in keep], n_lines.alias("n_lines"), (F.coalesce(F.size("_gone"), F.lit(0)).cast("long") - n_near).alias("n_exact"), n_near.alias("n_near"))


def oracle(min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> str:
    """The counts and digests of op8 in DuckDB's SQL over the table documents: variants are compared as they are, not as hashes."""
    return rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
    w AS (SELECT *, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM l),
    d AS (SELECT ws, len(ws) AS n, min((doc_id, no)) AS place FROM w WHERE len(ws) >= {min_words} GROUP BY ws),
    v AS (SELECT ws, n, place, i, list_concat(ws[1:i - 1], ws[i + 1:n]) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= {near_words})),
    s AS (SELECT ws FROM (SELECT ws, place, min(place) OVER (PARTITION BY n, i, rest) AS low FROM v) WHERE low < place),
    p AS (SELECT CASE WHEN a.place < b.place THEN b.ws ELSE a.ws END AS ws FROM d AS a JOIN v AS b ON a.ws = b.rest WHERE a.n >= {near_words}),
    near AS (SELECT ws FROM s UNION SELECT ws FROM p),
    f AS (SELECT w.doc_id, w.no, line, d.ws IS NOT NULL AND near.ws IS NOT NULL AS is_near, d.ws IS NOT NULL AND d.place <> (w.doc_id, w.no) AS is_repeat,
        regexp_matches(line, '[^\x20\x09-\x0D]') AS worded
        FROM w LEFT JOIN d ON w.ws = d.ws LEFT JOIN near ON w.ws = near.ws)
    SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (is_repeat AND NOT is_near) AS n_exact, count(*) FILTER (is_near) AS n_near,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT is_near AND NOT is_repeat), '')) AS text_sha256
    FROM f GROUP BY doc_id"""
