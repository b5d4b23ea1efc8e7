"""Operators: DataFrame -> DataFrame functions grouped by SURVEY section."""
