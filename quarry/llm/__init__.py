"""Training-data operators (one module per operator) and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
