"""DataFrame operators. Every function takes and returns DataFrames or
Columns and triggers no Spark action."""
