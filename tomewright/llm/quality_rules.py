"""Quality rules: a table of thresholds compiled into column expressions, without user functions.

Everything is a function of one row, so the plan is a scan and projections: no exchange, and a
hot source or a group of copies costs what its rows cost. Arrays used more than once are columns of
their own, which keeps Catalyst from evaluating them again for each use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, other_columns, text_or_empty

#: Code points of white space between words, and symbols that are counted.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOL_CHARS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are by this from at be have or an not "
    "der die das und ist nicht von mit den ein eine zu auf für im dem sich des "
    "le la les et est une pour que dans qui sur pas du au de un en "
    "el los las y es por con para del su lo se al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if numerator / denominator lies outside [least, most], among documents of at
    least min_words words. Whole-number bounds over a divisor keep the test exact: v * per < least * d."""

    name: str
    numerator: str
    denominator: str | None = None
    least: int | None = None
    most: int | None = None
    per: int = 1
    min_words: int = 0

    def fails(self) -> Column:
        value = F.col(self.numerator) * F.lit(self.per)
        unit = F.col(self.denominator) if self.denominator else F.lit(1)
        low = value < unit * F.lit(self.least) if self.least is not None else F.lit(False)
        high = value > unit * F.lit(self.most) if self.most is not None else F.lit(False)
        return (F.col("n_words") >= F.lit(self.min_words)) & (low | high)

    def sql(self) -> str:
        unit = self.denominator or "1"
        sides = [f"{self.numerator} * {self.per} {sign} {bound} * {unit}" for sign, bound in (("<", self.least), (">", self.most)) if bound is not None]
        return f"(n_words >= {self.min_words} AND ({' OR '.join(sides)}))"


#: Rules that hold for every table of thresholds.
BASE = (
    Rule("few_words", "n_words", least=10),
    Rule("repeated_words", "n_repeat_words", "n_words", most=20, per=100),
)
#: The default table. Ratios are in hundredths of the denominator.
THRESHOLDS = (
    Rule("word_length", "word_chars", "n_words", least=2, most=15),
    Rule("symbols", "n_symbols", "n_words", most=30, per=100),
    Rule("stop_words", "n_stop_words", "n_words", least=2, per=100, min_words=40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50, per=100),
)


def _repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from window hashes in text order. Sorting brings equal
    windows together; each covers WINDOW words from its place, less what the next one covers."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def neighbours(items: Column, join) -> Column:
        return F.transform(F.array(items), lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), join))[0]

    empty = F.array().cast("array<int>")
    places = F.array_sort(F.array_distinct(F.flatten(neighbours(placed, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(empty)))))
    covered = F.aggregate(neighbours(places, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda total, x: total + x)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (long).

    A null or empty text has no words and zero measures. Windows are compared by 64-bit hashes of their
    words within one text. Input columns named like a measure are replaced."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]
    keep = other_columns(df, *made, "_t", "_words", "_lines", "_windows")
    size = lambda c: F.length(c).cast("long")
    count = lambda c: F.size(c).cast("long")
    split = df.select(*keep, text_or_empty(text).alias("_t")).select(
        *keep,
        F.array_remove(F.split("_t", f"[{ASCII_SPACE}]+", -1), "").alias("_words"),
        F.filter(F.split("_t", "\n", -1), lambda line: F.trim(line, F.lit(SPACE_CHARS)) != "").alias("_lines"),
        size(F.translate("_t", SPACE_CHARS, "")).alias("word_chars"),
        (size("_t") - size(F.translate("_t", SYMBOL_CHARS, ""))).alias("n_symbols"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(WINDOW)]))
    counted = split.select(
        *keep,
        "word_chars",
        "n_symbols",
        count("_words").alias("n_words"),
        count("_lines").alias("n_lines"),
        (count("_lines") - count(F.array_distinct("_lines"))).alias("n_dup_lines"),
        count(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        F.when(F.size("_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    return counted.select(*keep, *made[:-1], _repeated_words(F.col("_windows")).cast("long").alias("n_repeat_words"))


def judge(df: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """measures(df) with base_failed, kept (boolean) and failed_rules (names, in table order)."""
    any_of = lambda table: reduce(lambda a, b: a | b, [r.fails() for r in table], F.lit(False))
    out = measures(df, text)
    out = out.select(*other_columns(out, "base_failed", "kept", "failed_rules"), any_of(BASE).alias("base_failed"), (~any_of(BASE + rules)).alias("kept"), F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in BASE + rules])).alias("failed_rules"))
    return out


def oracle(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    """The same in DuckDB's SQL over the table documents."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM t),
    g AS (SELECT r, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
    h AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM g),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM h),
    p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, range(0, {WINDOW}) AS s(k) WHERE n > 1 GROUP BY r),
    m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
        n_repeat_words::BIGINT AS n_repeat_words, ({' OR '.join(r.sql() for r in BASE)}) AS base_failed, NOT ({' OR '.join(r.sql() for r in BASE + rules)}) AS kept FROM m"""
