"""plumbline: Spark-native analytics for the evaluation of language-model systems."""

__version__ = "0.1.0"
