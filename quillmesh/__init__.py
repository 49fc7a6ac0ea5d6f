"""Text analytics over DataFrames: normalisation, similarity, retrieval and evaluation on Spark."""

__version__ = "0.1.0"
