"""Per-file profiling (parse) as one distributed job.

Files are routed by (type, suffix). Markdown, plain text and binary files are
profiled with native column expressions inside whole-stage codegen, notebooks
of format 4 as VARIANT values. Python sources, CSV files and the other
notebooks need a real parser; only those rows (plus Markdown that is not valid
UTF-8, for the exact decoder message) go through one ``mapInArrow`` job that runs the per-file helpers of
``quarry.functions.profilers`` on Arrow batches. Both branches produce the same
columns and are glued with ``unionByName``.

Files of a real folder carry no ``content``: each is opened once, in the task
of its branch, at any size. Text is measured in pieces of constant memory and
goes through the same column expressions as table content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import fixed as X
from quarry.functions.text import (header_count, line_count, normalize_newlines, preview, template,
                                   word_count)

DTYPE = T.StructType([T.StructField("name", T.StringType()),
                      T.StructField("dtype", T.StringType())])

# One typed field per key a profiler can emit; NULL means "key absent".
DETAILS = T.StructType([
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("functions", T.ArrayType(T.StringType())),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("lines_of_code", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("columns", T.LongType()),
    T.StructField("column_names", T.ArrayType(T.StringType())),
    T.StructField("dtypes", T.ArrayType(DTYPE)),
    T.StructField("total_cells", T.LongType()),
    T.StructField("code_cells", T.LongType()),
    T.StructField("markdown_cells", T.LongType()),
    T.StructField("words", T.LongType()),
    T.StructField("lines", T.LongType()),
    T.StructField("headers", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
])

PROFILE_FIELDS = [
    T.StructField("summary", T.StringType()),
    T.StructField("content_preview", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("details", DETAILS),
    T.StructField("detail_lines", T.ArrayType(T.StringType())),
]

FILE_COLUMNS = ["path", "name", "file_type", "suffix", "size", "modified"]

PYTHON_SIDE = ("python", "csv", "notebook")


PARSERS = X.PARSERS


def parser_for(file_type: Column, suffix: Column) -> Column:
    """C0 dispatch; the suffix test is case-sensitive (``A.CSV`` is generic)."""
    pairs = [F.lit(x) for kv in PARSERS.items() for x in kv]
    key = F.concat(file_type, F.lit("|"), suffix)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit("generic"))


def _text(content: Column) -> Column:
    return content.cast("string")


def notebook_cells(text: Column) -> Column:
    """The cells (kind, source) of a notebook of format 4, null for any
    other text: text that is no JSON, older formats (their cells need an
    upgrade) and cells without kind or source (their message names the key)."""
    notebook = F.try_parse_json(text)
    found = F.try_variant_get(notebook, "$.cells", "array<variant>")

    def cell(c: Column) -> Column:
        # a source is a string or a list of strings to join
        parts = F.try_variant_get(c, "$.source", "array<string>")
        return F.struct(
            F.try_variant_get(c, "$.cell_type", "string").alias("kind"),
            F.coalesce(F.array_join(parts, ""),
                       F.try_variant_get(c, "$.source", "string")).alias("source"))

    cells = F.transform(found, cell)
    whole = F.forall(cells, lambda c: c["kind"].isNotNull() & c["source"].isNotNull())
    return F.when((F.try_variant_get(notebook, "$.nbformat", "bigint") == 4) & whole, cells)


def _notebooks(files: DataFrame) -> DataFrame:
    """Profiles of the notebooks whose ``_cells`` are known."""
    cells = F.col("_cells")
    count = lambda kind: F.size(F.filter(cells, lambda c: c["kind"] == kind)).cast("bigint")
    counts = {"total": F.size(cells).cast("bigint"), "code": count("code"), "markdown": count("markdown")}
    shown = F.array_join(F.transform(
        F.slice(cells, 1, X.NB_PREVIEW_CELLS),
        lambda c, i: template(X.NB_CELL, index=i + 1, kind=c["kind"],
                              source=F.substring(c["source"], 1, X.NB_CELL_PREVIEW_CHARS))), "\n\n")
    details = {f"{k}_cells": n for k, n in counts.items()}
    return files.select(
        *FILE_COLUMNS, "parser", template(X.NB_SUMMARY, **counts).alias("summary"),
        preview(shown, X.PREVIEW_CHARS).alias("content_preview"), F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"), _details(**details).alias("details"),
        _detail_lines(**details).alias("detail_lines"))


def route(files: DataFrame) -> DataFrame:
    """Adds ``parser``, ``_cells`` (notebooks of format 4) and ``python_side``
    (rows that need the Arrow job)."""
    parser = parser_for(F.col("file_type"), F.col("suffix"))
    valid = F.is_valid_utf8(_text(F.col("content")))
    p = F.col("parser")
    routed = files.withColumn("parser", parser).withColumn(
        "_cells", F.when(p == "notebook", notebook_cells(_text(F.col("content")))))
    python_side = (p.isin("python", "csv") | ((p == "notebook") & F.col("_cells").isNull())
                   | ((p == "markdown") & F.col("content").isNotNull() & ~valid))
    return routed.withColumn("python_side", python_side)


def _md_summary(words, lines, headers) -> Column:
    return template(X.MD_SUMMARY, words=words, lines=lines, headers=headers)


def _text_summary(lines) -> Column:
    return template(X.TEXT_SUMMARY, kind=F.initcap("file_type"), lines=lines)


def _binary_summary(size) -> Column:
    return template(X.BINARY_SUMMARY, kind=F.col("file_type"), size=size)


def _detail_lines(**values) -> Column:
    """``key: value`` lines in the order given."""
    return F.array(*[template(X.DETAIL_LINE, key=k, value=v) for k, v in values.items()])


def _details(**fields) -> Column:
    cols = []
    for f in DETAILS.fields:
        value = fields.get(f.name)
        cols.append((value if value is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*cols)


def _native(files: DataFrame) -> DataFrame:
    """Markdown (valid UTF-8), generic text and binary profiles, JVM-side.

    The text is normalised and measured once in a first projection; the
    output columns only combine those values.
    """
    raw = _text(F.col("content"))
    text = normalize_newlines(raw)
    return _text_profile(files.select(
        *FILE_COLUMNS, "parser",
        F.col("content").isNull().alias("_missing"),
        (~F.is_valid_utf8(raw)).alias("_binary"),
        text.alias("_text"),
    ).select(
        *FILE_COLUMNS, "parser", "_missing", "_binary",
        word_count("_text").alias("_words"), line_count("_text").alias("_lines"),
        header_count("_text").alias("_headers"),
        preview("_text", X.PREVIEW_CHARS).alias("_preview"),
        F.lit(None).cast("string").alias("_undecodable"),
    ))


def _text_profile(measured: DataFrame) -> DataFrame:
    """Profile columns from the measures of a text."""
    missing, binary = F.col("_missing"), F.col("_binary")
    words, lines, headers = F.col("_words"), F.col("_lines"), F.col("_headers")
    md = F.col("parser") == "markdown"
    size = F.col("size")
    undecodable = F.col("_undecodable")
    failed = md & undecodable.isNotNull()

    summary = (F.when(missing, F.lit(X.FILE_NOT_FOUND))
               .when(failed, F.lit(X.MD_PARSE_ERROR))
               .when(md, _md_summary(words, lines, headers))
               .when(binary, _binary_summary(size))
               .otherwise(_text_summary(lines)))
    content_preview = (F.when(missing | failed, F.lit(""))
                       .when(~md & binary, F.lit(X.BINARY_PREVIEW))
                       .otherwise(F.col("_preview")))
    details = (F.when(missing | failed, _details())
               .when(md, _details(words=words, lines=lines, headers=headers))
               .when(binary, _details(size_bytes=size))
               .otherwise(_details(lines=lines, words=words, size_bytes=size)))
    detail_lines = (F.when(missing | failed, F.array().cast("array<string>"))
                    .when(md, _detail_lines(words=words, lines=lines, headers=headers))
                    .when(binary, _detail_lines(size_bytes=size))
                    .otherwise(_detail_lines(lines=lines, words=words, size_bytes=size)))
    return measured.select(
        *FILE_COLUMNS, "parser",
        summary.alias("summary"),
        content_preview.alias("content_preview"),
        (~(missing | failed)).alias("success"),
        F.when(missing, F.lit(X.FILE_DOES_NOT_EXIST)).when(failed, undecodable).alias("error"),
        details.alias("details"),
        detail_lines.alias("detail_lines"),
    )


_ARROW_OUT = T.StructType(
    [T.StructField(c, t) for c, t in [
        ("path", T.StringType()), ("name", T.StringType()), ("file_type", T.StringType()),
        ("suffix", T.StringType()), ("size", T.LongType()),
        ("modified", T.TimestampNTZType()), ("parser", T.StringType())]]
    + PROFILE_FIELDS)


def _read_file(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _profile_batches(batches):
    """mapInArrow body: one output batch per input batch, row order kept. A
    batch without ``content`` names files to open, one at a time."""
    import pyarrow as pa

    from quarry.functions.profilers import profile
    from quarry.operators.parse import DETAILS, FILE_COLUMNS
    detail_names = [f.name for f in DETAILS.fields]
    for batch in batches:
        cols = batch.select(FILE_COLUMNS + ["parser"]).to_pydict()
        contents = batch.column("content") if "content" in batch.schema.names else None
        summaries, previews, oks, errors, details, lines = [], [], [], [], [], []
        for i, parser in enumerate(cols["parser"]):
            # one file's bytes at a time
            raw = contents[i].as_py() if contents is not None else _read_file(cols["path"][i])
            if isinstance(raw, str):
                raw = raw.encode("utf-8")
            out = profile(parser, raw)
            summaries.append(out["summary"])
            previews.append(out["content_preview"])
            oks.append(out["success"])
            errors.append(out["error"])
            d = out["details"]
            if "dtypes" in d:
                d = dict(d, dtypes=[{"name": str(k), "dtype": v} for k, v in d["dtypes"].items()])
            details.append({k: d.get(k) for k in detail_names})
            lines.append(out["detail_lines"])
        yield pa.RecordBatch.from_pydict({
            "path": cols["path"], "name": cols["name"], "file_type": cols["file_type"],
            "suffix": cols["suffix"], "size": cols["size"], "modified": cols["modified"],
            "parser": cols["parser"], "summary": summaries, "content_preview": previews,
            "success": oks, "error": errors, "details": details, "detail_lines": lines,
        }, schema=_arrow_schema())


def _arrow_schema():
    import pyarrow as pa
    s = pa.string()
    ls = pa.list_(s)
    i = pa.int64()
    details = pa.struct([
        ("classes", ls), ("functions", ls), ("imports", ls), ("lines_of_code", i),
        ("error", s), ("rows", i), ("columns", i), ("column_names", ls),
        ("dtypes", pa.list_(pa.struct([("name", s), ("dtype", s)]))),
        ("total_cells", i), ("code_cells", i), ("markdown_cells", i),
        ("words", i), ("lines", i), ("headers", i), ("size_bytes", i)])
    return pa.schema([
        ("path", s), ("name", s), ("file_type", s), ("suffix", s), ("size", i),
        ("modified", pa.timestamp("us")), ("parser", s), ("summary", s),
        ("content_preview", s), ("success", pa.bool_()), ("error", s),
        ("details", details), ("detail_lines", ls)])


def _python_side(files: DataFrame) -> DataFrame:
    cols = FILE_COLUMNS + ["parser"]
    if "content" in files.columns:
        cols.append(F.col("content").cast("binary").alias("content"))
    return files.select(*cols).mapInArrow(_profile_batches, _ARROW_OUT)


def parse_files(files: DataFrame, native_only: bool = False) -> DataFrame:
    """One profile row per inventoried file.

    Input columns: the inventory (path, name, file_type, suffix, size,
    modified) and, for files held in a table, ``content`` (STRING or BINARY,
    NULL for a vanished file); without it the files are opened by path.
    ``native_only`` skips the Arrow job (callers that keep only files with
    a native profile: Markdown, plain text, binary, notebooks of format 4).
    """
    if "content" not in files.columns:
        return _parse_by_path(files)
    routed = route(files)
    jvm, notebook = ~F.col("python_side"), F.col("parser") == "notebook"
    native = _native(routed.filter(jvm & ~notebook)).unionByName(
        _notebooks(routed.filter(jvm & notebook)))
    if native_only:
        return native
    return native.unionByName(_python_side(routed.filter(F.col("python_side"))))


# measures of one range of a file (functions.streams), by its number
_MEASURES = ("n int, missing boolean, error_at bigint, error string, words bigint, lines bigint, "
             "headers bigint, first_space boolean, lead string, in_word boolean, blank boolean, "
             "starts_lf boolean, ends_cr boolean, head string")
RANGE_BYTES = 64 << 20


def _measure_ranges(range_bytes: int):
    """mapInPandas body: measures of each range of a text file, read in pieces."""
    names = [part.split()[0] for part in _MEASURES.split(", ")]

    def run(frames):
        import pandas as pd

        from quarry.functions.streams import measure_text
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                n, last = row["n"], row.pop("last")
                m = measure_text(row["path"], X.PREVIEW_CHARS, lo=n * range_bytes,
                                 hi=None if last else (n + 1) * range_bytes)
                found = (m is None, *((None,) * (len(names) - 2) if m is None else (
                    m.error_at, m.error, m.words, m.lines, m.headers, m.first_space, m.lead, m.in_word,
                    m.blank, m.starts_lf, m.ends_cr, m.head)))
                rows.append((*row.values(), *found))
            columns = [c for c in frame.columns if c != "last"]
            yield pd.DataFrame(rows, columns=[*columns, *names[1:]]).astype({"error_at": "Int64"})
    return run


def _merged_ranges(measured: DataFrame) -> DataFrame:
    """One row per file from its ranges, merged in order: a word, a line or a
    line end that a cut went through counts once."""
    names = [part.split()[0] for part in _MEASURES.split(", ")]
    keys = [c for c in measured.columns if c not in names]
    # the all-null state of a missing file changes nothing: it has no first character
    step = """if(s.first_space IS NULL, a, named_struct(
        'words', a.words + s.words - int(a.in_word AND NOT s.first_space),
        'lines', a.lines + s.lines - 1 - int(a.cr AND s.starts_lf),
        'headers', a.headers + s.headers - int(NOT a.blank AND s.lead = '#'),
        'head', if(length(a.head) > {keep}, a.head,
                   concat(a.head, if(a.cr AND s.starts_lf, substring(s.head, 2), s.head))),
        'in_word', s.in_word, 'blank', if(s.lines > 1, s.blank, a.blank AND s.blank), 'cr', s.ends_cr))"""
    start = ("named_struct('words', 0L, 'lines', 1L, 'headers', 0L, 'head', '', 'in_word', false, "
             "'blank', true, 'cr', false)")
    fold = F.expr(f"aggregate(array_sort(ranges), {start}, (a, s) -> {step.format(keep=X.PREVIEW_CHARS)})")
    files = measured.groupBy(*keys).agg(
        F.collect_list(F.struct(*names)).alias("ranges"), F.bool_or("missing").alias("_missing"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("error_at", "error")))["error"].alias("_undecodable"))
    head = F.col("m.head")
    return files.withColumn("m", fold).select(
        *keys, "_missing", F.col("_undecodable").isNotNull().alias("_binary"),
        F.col("m.words").alias("_words"), F.col("m.lines").alias("_lines"), F.col("m.headers").alias("_headers"),
        F.concat(F.substring(head, 1, X.PREVIEW_CHARS),
                 F.when(F.length(head) > X.PREVIEW_CHARS, X.ELLIPSIS).otherwise("")).alias("_preview"),
        "_undecodable")


FILES_PER_TASK_BYTES = 128 << 20


def _parse_by_path(files: DataFrame) -> DataFrame:
    """Profiles of files of a mounted tree. Each branch deals its files over
    tasks by their number and bytes; a text file is opened once per range."""
    from pyspark.sql.types import _parse_datatype_string

    routed = files.select(*FILE_COLUMNS).withColumn(
        "parser", parser_for(F.col("file_type"), F.col("suffix")))
    size = routed.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, size["n"] // 2000,
                (size["bytes"] or 0) // FILES_PER_TASK_BYTES)
    dealt = F.col("parser").isin(*PYTHON_SIDE)
    # text is dealt by byte ranges: a large file is many tasks' work
    count = F.greatest(F.ceil(F.col("size") / RANGE_BYTES).cast("int"), F.lit(1))
    text = (routed.filter(~dealt).withColumn("_of", count)
            .withColumn("n", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
            .withColumn("last", F.col("n") == F.col("_of") - 1).drop("_of").repartition(tasks, "path", "n"))
    schema = T.StructType([f for f in text.schema if f.name not in ("n", "last")]
                          + _parse_datatype_string(_MEASURES).fields)
    return (_text_profile(_merged_ranges(text.mapInPandas(_measure_ranges(RANGE_BYTES), schema)))
            .unionByName(_python_side(routed.filter(dealt).repartition(tasks, "path"))))


def without_profile(files: DataFrame) -> DataFrame:
    """The parse columns as NULLs, for aggregates that need names and types only."""
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in PROFILE_FIELDS}
    routed = files.withColumn("parser", parser_for(F.col("file_type"), F.col("suffix")))
    return routed.select(*FILE_COLUMNS, "parser", *[v.alias(k) for k, v in nulls.items()])


def error_message() -> Column:
    return F.concat_ws(": ", F.col("name"), F.coalesce(F.col("error"), F.lit("Unknown error")))


def parse_errors(parsed: DataFrame, keys=()) -> DataFrame:
    """``"{name}: {error}"`` for every failed parse."""
    return parsed.filter(~F.col("success")).select(*keys, "path", error_message().alias("message"))
