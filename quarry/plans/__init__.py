"""Query plans: compositions of operators, the query registry and the
DuckDB oracle texts used to check them."""
