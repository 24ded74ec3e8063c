"""quern: a DataFrame-native engine for document retrieval and corpus work on Spark."""

__version__ = "0.1.0"
