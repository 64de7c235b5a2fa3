"""quarry: file-corpus analytics on Spark.

Tables in, tables out: a workspace inventory is listed, filtered by
modification time, classified, profiled, tagged, embedded into a vector
table and summarised into one report row per request ticket, for many
tickets in one job. Every step is a DataFrame transformation; Python runs
inside tasks only where a per-file parser (Python grammar, CSV sniffing)
has no built-in Spark equivalent.
"""

__version__ = "0.1.0"
