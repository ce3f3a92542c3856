"""codeloom: code-graph analytics and data preparation as plain Spark DataFrames."""

__version__ = "0.1.0"
