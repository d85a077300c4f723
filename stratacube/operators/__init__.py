"""Cube operators: DataFrame in, DataFrame out."""
