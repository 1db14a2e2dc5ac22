"""Review-sentiment analytics on PySpark: text, lexicon, feature and evaluation operators."""

__version__ = "0.1.0"
