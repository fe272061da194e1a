"""ixpanel: a Spark-native engine for economic index panels.

Turns spreadsheet-style cell grids into a long panel of category, month,
value and adjustment, and answers queries on it with DataFrames and
Structured Streaming.
"""

__version__ = "0.1.0"
