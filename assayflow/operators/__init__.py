"""Operators: DataFrame -> DataFrame functions over the long model."""
