"""A PySpark engine for retrieving, maintaining and analysing stores of short text memories."""
