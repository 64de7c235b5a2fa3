"""DuckDB building blocks for the oracle queries.

The oracles are written independently of the Spark code, in plain SQL over
the driver's views; they share only the fixed values (patterns, type map).
"""

from __future__ import annotations

from quarry.functions.text import WS_CLASS, WS_NO_LF_CLASS
from quarry.operators.scan import FILE_TYPES, IGNORE_PATTERNS
from quarry.sources.tables import FILES_SQL

ROOT_LEN = len("/ws")


def _any_contains(col: str) -> str:
    return " OR ".join(f"contains({col}, '{p}')" for p in IGNORE_PATTERNS)


def _type_case(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FILE_TYPES.items())
    return f"CASE lower({expr}) {whens} ELSE 'other' END"


FLAGGED_SQL = f"""
named AS (
  SELECT *, split_part(path, '/', -1) AS name,
         regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS parent
  FROM files),
flagged AS (
  SELECT *,
    (length(parent) > {ROOT_LEN} AND (({_any_contains('parent')})
       OR regexp_matches(substr(parent, {ROOT_LEN + 2}) || '/', '(^|/)[^/]*[.]pyc/'))) AS pruned,
    (({_any_contains('path')}) OR ends_with(name, '.pyc')) AS ignored
  FROM named)"""

INVENTORY_SQL = f"""
inventory AS (
  SELECT doc_id, path, content, size, modified, name,
    regexp_extract(name, '(?s)^.+([.][^.]+)$', 1) AS suffix,
    {_type_case("regexp_extract(name, '(?s)^.+([.][^.]+)$', 1)")} AS file_type
  FROM flagged WHERE NOT pruned AND NOT ignored)"""

# Python str.split() / str.strip() whitespace, as RE2 classes.
WORD_RE = f"[^{WS_CLASS}]+"
HEADER_RE = f"(?m)^[{WS_NO_LF_CLASS}]*#"


def with_inventory(*extra_ctes: str) -> str:
    ctes = [FILES_SQL.strip(), FLAGGED_SQL.strip(), INVENTORY_SQL.strip()]
    ctes += [c.strip() for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n"


def words(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{WORD_RE}')) AS BIGINT)"


def lines(expr: str) -> str:
    return f"CAST(length({expr}) - length(replace({expr}, chr(10), '')) + 1 AS BIGINT)"


def headers(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{HEADER_RE}')) AS BIGINT)"


def preview(expr: str, n: int = 500) -> str:
    return (f"(CASE WHEN length({expr}) > {n} THEN substring({expr}, 1, {n}) || '...' "
            f"ELSE {expr} END)")


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


def iso(expr: str) -> str:
    """DuckDB twin of ``iso_timestamp``."""
    return (f"(CASE WHEN {expr} IS NULL THEN NULL WHEN epoch_us({expr}) % 1000000 = 0 "
            f"THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') END)")


# Validated tickets; needs ``tickets``.
VALIDATED_SQL = """
vt AS (
  SELECT *, CASE WHEN task_id IS NULL THEN 'task_id: Field required'
      WHEN workspace_path IS NULL THEN 'workspace_path: Field required'
      WHEN NOT coalesce(scan_all, FALSE) AND (start_date IS NULL OR end_date IS NULL)
        THEN 'start_date and end_date required when scan_all=False' END AS error
  FROM tickets),
vtk AS (SELECT *, error IS NULL AS valid FROM vt)"""

# Validated tickets and (ticket, file) pairs; needs ``tickets`` and ``inventory``.
TICKET_FILES_SQL = VALIDATED_SQL + """,
tf AS (
  SELECT t.task_id, t.reindex, i.*
  FROM vtk t JOIN inventory i
    ON t.valid AND (coalesce(t.scan_all, FALSE) OR i.modified BETWEEN t.start_date AND t.end_date))"""
