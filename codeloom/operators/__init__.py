"""Relational, graph and search operators: DataFrame in, DataFrame out."""
