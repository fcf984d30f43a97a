"""Knowledge-base engine on Spark: segmentation, entity linking, recall and vector search as DataFrame plans."""

__version__ = "0.1.0"
