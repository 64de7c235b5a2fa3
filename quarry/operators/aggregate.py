"""Per-scope aggregates of parsed files.

Input is the parsed files and the scopes as nodes of the time tree
(``dyadic``): a file is never paired with the windows around it. All counters,
sums and flags are values of a file that merge, from files to units of time,
nodes and scopes, with partial aggregation before each shuffle. The "first N
in path order" lists merge the same way: units and nodes hold at most N rows
of each list (WindowGroupLimit before and after each shuffle), and no list is
ever collected beyond its N rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed as X
from quarry.functions.text import format_2f, format_fixed, template
from quarry.operators import dyadic
from quarry.operators.enrich import LARGE_FILE_BYTES, file_format

TYPES = ("code", "data", "note", "notebook", "other")  # sorted: summary order
MB = 1024 * 1024


def file_values() -> dict[str, tuple[Column, str]]:
    """What one file adds to its scopes' statistics, and how it merges."""
    t = F.col("file_type")
    d = lambda f: F.coalesce(F.col(f"details.{f}"), F.lit(0)).cast("bigint")
    n = lambda f: F.size(F.coalesce(F.col(f"details.{f}"), F.array())).cast("bigint")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    only = lambda c, value: F.when(c, value).otherwise(F.lit(0).cast("bigint"))
    code, data, nb, note = t == "code", t == "data", t == "notebook", t == "note"
    values = {
        "files_processed": (F.lit(1).cast("bigint"), "sum"),
        "total_size_bytes": (F.coalesce(F.col("size"), F.lit(0)).cast("bigint"), "sum"),
        "files_succeeded": (flag(F.col("success")), "sum"),
        "parse_failed": (flag(~F.col("success")), "sum"),
        "large_files": (flag(F.col("size") > LARGE_FILE_BYTES), "sum"),
    }
    values |= {f"n_{k}": (flag(t == k), "sum") for k in TYPES}
    return values | {
        "code_python": (F.coalesce(code & (F.col("suffix") == ".py"), F.lit(False)), "any"),
        "code_total_lines": (only(code, d("lines_of_code")), "sum"),
        "code_functions": (only(code, n("functions")), "sum"),
        "code_classes": (only(code, n("classes")), "sum"),
        # distinct formats: data/note types admit only case variants of
        # four / two suffixes, so these sets are small by construction
        "data_formats": (F.when(data, file_format()), "set"),
        "data_total_rows": (only(data, d("rows")), "sum"),
        "data_total_columns": (only(data, d("columns")), "max"),
        "notebook_total_cells": (only(nb, d("total_cells")), "sum"),
        "notebook_code_cells": (only(nb, d("code_cells")), "sum"),
        "notebook_markdown_cells": (only(nb, d("markdown_cells")), "sum"),
        "note_formats": (F.when(note, file_format()), "set"),
        "note_total_words": (only(note, d("words")), "sum"),
    }


def scope_stats(files: DataFrame, selection: dyadic.Selection) -> DataFrame:
    """One row per scope with files: counters, per-type breakdown, flags."""
    return dyadic.aggregate(files, selection, file_values())


def scope_firsts(files: DataFrame, selection: dyadic.Selection) -> DataFrame:
    """Per scope the first file, failed file and large file, by path."""
    place = F.struct("path", "file_no")
    return dyadic.aggregate(files, selection, {
        "first_file": (place, "min"), "first_error": (F.when(~F.col("success"), place), "min"),
        "first_large": (F.when(F.col("size") > LARGE_FILE_BYTES, place), "min")})


# List kinds: (name, member types, limit).
LISTS = [
    ("highlights", tuple(X.HIGHLIGHT), X.LIST_LIMITS["highlights"]),
    ("notable_changes", tuple(X.IMPACT), X.LIST_LIMITS["notable_changes"]),
    ("recommendations", tuple(X.RECOMMENDATION), X.LIST_LIMITS["recommendations"]),
    ("notable_code", ("code",), X.LIST_LIMITS["notable_code"]),
    ("file_listing", TYPES, X.LIST_LIMITS["file_listing"]),
]
MAX_LIST = max(k for _, _, k in LISTS)


def first_n_rows(files: DataFrame, selection: dyadic.Selection) -> DataFrame:
    """Rows of every first-N list: (scope_id, kind, rank, file columns). One
    explode tags each file with the lists it belongs to."""
    t = F.col("file_type")
    kinds = F.array_compact(F.array(*[
        F.when(t.isin(*types), F.lit(kind)) for kind, types, _ in LISTS]))
    limits = F.create_map(*[F.lit(x) for kind, _, k in LISTS for x in (kind, k)])
    rows = files.select("path", "name", "file_type", "size", "summary", "modified",
                        F.explode(kinds).alias("kind"))
    ranked = dyadic.first_n(rows, selection, MAX_LIST).drop("modified")
    return ranked.filter(F.col("rank") <= F.element_at(limits, F.col("kind")))


def _by_type(texts: dict) -> Column:
    """A per-type template chosen by ``file_type`` (first entry is the default)."""
    t, name = F.col("file_type"), F.col("name")
    items = list(texts.items())
    col = F.when(t == items[0][0], template(items[0][1], name=name))
    for kind, tpl in items[1:]:
        col = col.when(t == kind, template(tpl, name=name))
    return col


def _item(kind: str) -> Column:
    if kind == "highlights":
        return _by_type(X.HIGHLIGHT)
    if kind == "recommendations":
        return _by_type(X.RECOMMENDATION)
    if kind == "notable_code":
        return template(X.NOTABLE_CODE_LINE, name=F.col("name"), summary=F.col("summary"))
    if kind == "file_listing":
        return template(X.LISTING_LINE, name=F.col("name"), kind=F.col("file_type"),
                        kb=format_fixed(F.col("size") / F.lit(1024.0), 1))
    raise KeyError(kind)


def scope_lists(files: DataFrame, selection: dyadic.Selection) -> DataFrame:
    """One row per scope with the bounded lists, in path order."""
    rows = first_n_rows(files, selection)
    item = F.when(F.col("kind") == "notable_changes", F.lit(None))
    for kind, _, _ in LISTS:
        if kind != "notable_changes":
            item = item.when(F.col("kind") == kind, _item(kind))
    change = F.when(F.col("kind") == "notable_changes", F.struct(
        F.col("file_type").alias("type"), F.col("name").alias("file"),
        F.col("summary").alias("description"),
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in X.IMPACT.items() for x in kv]),
                                F.col("file_type")), F.lit("medium")).alias("impact")))
    per_kind = (rows.groupBy("scope_id", "kind")
                .agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("text"),
                                                          change.alias("change"))))
                     .alias("items")))
    texts = lambda k: F.max(F.when(F.col("kind") == k, F.transform("items", lambda x: x["text"])))
    return per_kind.groupBy("scope_id").agg(
        texts("highlights").alias("highlights"),
        F.max(F.when(F.col("kind") == "notable_changes",
                     F.transform("items", lambda x: x["change"]))).alias("notable_changes"),
        texts("recommendations").alias("recommendations"),
        texts("notable_code").alias("notable_code"),
        texts("file_listing").alias("file_listing"),
    )


def empty_list(type_ddl: str = "array<string>") -> Column:
    return F.array().cast(type_ddl)


def activity_summary(stats_prefix: str = "") -> Column:
    """A7, from the per-type counts (NULL counts mean no files)."""
    c = lambda k: F.coalesce(F.col(f"{stats_prefix}n_{k}"), F.lit(0))
    total = F.coalesce(F.col(f"{stats_prefix}files_processed"), F.lit(0))
    label = F.when(total == 0, F.lit(X.ACTIVITY_NONE))
    for kind, text in X.ACTIVITY:
        label = label.when(c(kind) > 0, F.lit(text))
    return label.otherwise(F.lit(X.ACTIVITY_OTHER))


def summary_text() -> Column:
    """A8 text from scope stats + the notable code list."""
    total = F.coalesce(F.col("files_processed"), F.lit(0))
    breakdown = F.array_compact(F.array(*[
        F.when(F.col(f"n_{k}") > 0, template(X.SUMMARY_TYPE_LINE, kind=k, n=F.col(f"n_{k}")))
        for k in TYPES]))
    size = template(X.SUMMARY_SIZE, mb=format_2f(F.col("total_size_bytes") / F.lit(float(MB))))
    code = F.coalesce(F.col("notable_code"), empty_list())
    code_part = F.when(F.size(code) > 0, F.concat(
        F.lit(X.SUMMARY_CODE_HEAD), F.array_join(code, "\n"))).otherwise(F.lit(""))
    text = F.concat(template(X.SUMMARY_HEAD, n=total),
                    F.array_join(breakdown, "\n"), F.lit("\n\n"), size, code_part)
    return F.when(total == 0, F.lit(X.SUMMARY_EMPTY)).otherwise(text)


def suggested_actions() -> Column:
    """Fixed actions, two of them conditional on the file mix."""
    def action(a):
        return F.struct(F.lit(a[0]).alias("action"), F.lit(a[1]).alias("description"),
                        F.lit(a[2]).alias("example"))
    has = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) > 0
    return F.array_compact(F.array(
        action(X.ACTION_SEARCH),
        F.when(has("code"), action(X.ACTION_DEEP_DIVE)),
        F.when(has("notebook"), action(X.ACTION_NOTEBOOK)),
        action(X.ACTION_COMPARE),
    ))


def large_file_names(pairs: DataFrame) -> DataFrame:
    """A11 affected files: (scope_id, name, path) of every file over 10 MB."""
    return pairs.filter(F.col("size") > LARGE_FILE_BYTES).select("scope_id", "name", "path")
