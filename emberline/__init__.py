"""emberline: batch scoring, embedding and training jobs on Spark DataFrames."""

__version__ = "0.1.0"
