"""Operators: DataFrame in, DataFrame out; plans are left to Catalyst."""
