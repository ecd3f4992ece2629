"""Relational, psychometric, graph and content operators: DataFrame in, DataFrame out."""
