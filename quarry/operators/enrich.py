"""Per-file enrichment over parsed rows: tags (P4), complexity (P5), the
enhanced file record (P6) and the display projection (P8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed as X
from quarry.functions.text import iso_timestamp

LARGE_FILE_BYTES = X.LARGE_FILE_BYTES


def _has(name: Column, *words: str) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(name, F.lit(w))
    return cond


def _rule(rule) -> Column | None:
    if rule is None:
        return None
    kind, *args = rule
    if kind == "name":
        return _has(F.lower(F.col("name")), *args)
    if kind == "import":
        imports = F.coalesce(F.col("details.imports"), F.array().cast("array<string>"))
        return F.array_contains(imports, args[0])
    if kind == "column":
        columns = F.coalesce(F.col("details.column_names"), F.array().cast("array<string>"))
        has_columns = F.coalesce(F.col("details.columns"), F.lit(0)) != 0
        return has_columns & F.exists(columns, lambda c: F.contains(F.lower(c), F.lit(args[0])))
    raise ValueError(rule)


def tags() -> Column:
    """Ordered tag list from type, lower-cased name and parsed details."""
    ftype = F.col("file_type")
    out = None
    for kind, rules in X.TAGS.items():
        arr = F.array_compact(F.array(*[
            F.lit(tag) if _rule(rule) is None else F.when(_rule(rule), F.lit(tag))
            for tag, rule in rules]))
        out = F.when(ftype == kind, arr) if out is None else out.when(ftype == kind, arr)
    return out.otherwise(F.array().cast("array<string>"))


def complexity() -> Column:
    """P5: low / medium / high from definitions and line count."""
    items = (F.size(F.coalesce(F.col("details.functions"), F.array()))
             + F.size(F.coalesce(F.col("details.classes"), F.array())))
    lines = F.coalesce(F.col("details.lines_of_code"), F.lit(0))
    return (F.when((items == 0) | (lines < X.COMPLEXITY_LOW_LINES), "low")
            .when((items < X.COMPLEXITY_MEDIUM_ITEMS) & (lines < X.COMPLEXITY_MEDIUM_LINES),
                  "medium")
            .otherwise("high"))


def file_format() -> Column:
    """Suffix without the dot, as written (``.CSV`` stays ``CSV``)."""
    return F.ltrim(F.col("suffix"), F.lit("."))


def enhanced_files(parsed: DataFrame, keys=()) -> DataFrame:
    """One enhanced record per parsed file (report ``results.files``)."""
    ftype = F.col("file_type")
    analysis = F.struct(
        F.col("summary").alias("summary"),
        F.col("details").alias("details"),
        F.substring("content_preview", 1, X.RECORD_PREVIEW_CHARS).alias("content_preview"),
        tags().alias("tags"),
        F.col("success").alias("rag_indexed"),
        F.lit(None).cast("string").alias("rag_id"),
        F.when(ftype == "code", F.lit("python")).alias("language"),
        F.when(ftype == "code", complexity()).alias("complexity"),
        F.when(ftype.isin("data", "note"), file_format())
         .when(ftype == "notebook", F.lit("jupyter")).alias("format"),
        F.when(ftype == "notebook", F.lit("python3")).alias("kernel"),
        F.when(ftype == "notebook", F.lit(False)).alias("executed"),
        F.when(ftype == "notebook", F.lit(False)).alias("has_outputs"),
    )
    return parsed.select(
        *keys, "path", "name", ftype.alias("type"), F.col("size").alias("size_bytes"),
        iso_timestamp("modified").alias("modified"),
        F.lit(None).cast("string").alias("created"), F.lit("unknown").alias("author"),
        analysis.alias("analysis"),
    )


def display(files: DataFrame, keys=()) -> DataFrame:
    """Name, type, minute-precision time, size in KB (2 decimals)."""
    return files.select(
        *keys, "name", "file_type",
        F.date_format("modified", "yyyy-MM-dd HH:mm").alias("modified"),
        F.bround(F.col("size") / F.lit(1024.0), 2).alias("size_kb"),
    )
