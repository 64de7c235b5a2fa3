"""Per-file profile queries (C0-C7, P4-P6, V1) over the workspace view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import WORD_RE
from quarry.operators import enrich, parse, scan
from quarry.operators import vectors as V
from quarry.plans import oracle_sql as O
from quarry.plans.registry import register
from quarry.sources.tables import FIXTURE_ROOT, fixture_files

GENERIC = ("NOT ((file_type = 'code' AND suffix = '.py') OR (file_type = 'data' AND suffix = '.csv')"
           " OR (file_type = 'notebook' AND suffix = '.ipynb') OR (file_type = 'note' AND suffix = '.md'))")


def _inventory(spark, sf_dir):
    return scan.inventory(fixture_files(spark, sf_dir), FIXTURE_ROOT)


def _parsed(spark, sf_dir):
    return parse.parse_files(_inventory(spark, sf_dir))


_NORM = "regexp_replace(content, '\\r\\n?', chr(10), 'g')"


@register("parse_dispatch", O.with_inventory() + f"""
SELECT CASE WHEN file_type = 'code' AND suffix = '.py' THEN 'python'
  WHEN file_type = 'data' AND suffix = '.csv' THEN 'csv'
  WHEN file_type = 'notebook' AND suffix = '.ipynb' THEN 'notebook'
  WHEN file_type = 'note' AND suffix = '.md' THEN 'markdown' ELSE 'generic' END AS parser,
  count(*) AS files
FROM inventory GROUP BY 1""")
def parse_dispatch(spark, sf_dir):
    """Files per profiler branch."""
    return _parsed(spark, sf_dir).groupBy("parser").agg(F.count(F.lit(1)).alias("files"))


# Markdown: the documents carry no '#' lines, so each line starting with 'T'
# becomes a header line before profiling (FIXTURES.md section 9).
@register("markdown_profile", O.with_inventory() + f"""
, md AS (SELECT path, {_NORM.replace('content', "regexp_replace(content, '(^|\\n)T', '\\1# T', 'g')")} AS t
         FROM inventory WHERE file_type = 'note' AND suffix = '.md')
SELECT path, {O.words('t')} AS words, {O.lines('t')} AS lines, {O.headers('t')} AS headers,
  'Markdown file with ' || {O.words('t')} || ' words, ' || {O.lines('t')} || ' lines, '
    || {O.headers('t')} || ' headers' AS summary,
  {O.preview('t')} AS content_preview
FROM md""".replace("\n, md AS", ",\nmd AS"))
def markdown_profile(spark, sf_dir):
    """C4: words, lines, headers, summary and preview of Markdown files."""
    inv = _inventory(spark, sf_dir).filter((F.col("file_type") == "note") & (F.col("suffix") == ".md"))
    inv = inv.withColumn("content", F.regexp_replace("content", r"(^|\n)T", "$1# T"))
    p = parse.parse_files(inv, native_only=True)
    return p.select("path", "details.words", "details.lines", "details.headers", "summary",
                    "content_preview")


@register("generic_profile", O.with_inventory() + f"""
, g AS (SELECT path, file_type, size, {_NORM} AS t FROM inventory WHERE {GENERIC})
SELECT path, upper(file_type[1]) || file_type[2:] || ' file with ' || {O.lines('t')} || ' lines'
    AS summary,
  {O.lines('t')} AS lines, {O.words('t')} AS words, size AS size_bytes,
  {O.preview('t')} AS content_preview
FROM g""".replace("\n, g AS", ",\ng AS"))
def generic_profile(spark, sf_dir):
    """Plain-text profile of every file without a dedicated parser."""
    p = parse.parse_files(_inventory(spark, sf_dir), native_only=True)
    p = p.filter(F.col("parser") == "generic")
    return p.select("path", "summary", "details.lines", "details.words", "details.size_bytes",
                    "content_preview")


def _with_binary(files):
    """.bin files get a trailing 0xFF byte: invalid UTF-8, so binary."""
    is_bin = F.col("suffix") == ".bin"
    raw = F.col("content").cast("binary")
    content = F.when(is_bin, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return files.withColumns({"content": content, "size": F.octet_length(content).cast("bigint")})


@register("binary_profile", O.with_inventory() + f"""
, g AS (SELECT path, file_type, suffix, size, {_NORM} AS t FROM inventory WHERE {GENERIC})
SELECT path,
  CASE WHEN suffix = '.bin' THEN 'Binary ' || file_type || ' file (' || (size + 1) || ' bytes)'
       ELSE upper(file_type[1]) || file_type[2:] || ' file with ' || {O.lines('t')} || ' lines' END
    AS summary,
  CASE WHEN suffix = '.bin' THEN '[Binary content]' ELSE {O.preview('t')} END AS content_preview,
  CASE WHEN suffix = '.bin' THEN size + 1 ELSE size END AS size_bytes
FROM g""".replace("\n, g AS", ",\ng AS"))
def binary_profile(spark, sf_dir):
    """Files that are not valid UTF-8 get the binary profile."""
    p = parse.parse_files(_with_binary(_inventory(spark, sf_dir)), native_only=True)
    return p.filter(F.col("parser") == "generic").select(
        "path", "summary", "content_preview", "details.size_bytes")


@register("parse_totals", O.with_inventory() + f"""
, g AS (SELECT *, {_NORM} AS t, {GENERIC} AS generic, file_type = 'note' AND suffix = '.md' AS md
        FROM inventory)
SELECT parser, count(*) AS files, CAST(coalesce(sum(words), 0) AS BIGINT) AS words,
  CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS size_bytes
FROM (SELECT CASE WHEN md THEN 'markdown' WHEN generic THEN 'generic' ELSE 'code, data or notebook' END
        AS parser, size, CASE WHEN md OR generic THEN {O.words('t')} END AS words,
        CASE WHEN md OR generic THEN {O.lines('t')} END AS lines FROM g)
GROUP BY parser""".replace("\n, g AS", ",\ng AS"))
def parse_totals(spark, sf_dir):
    """Every file profiled; words, lines and bytes per kind of profile
    (the lengths of all summaries and previews are read, so nothing is pruned)."""
    p = _parsed(spark, sf_dir)
    kind = F.when(F.col("parser").isin("markdown", "generic"), F.col("parser")).otherwise(
        "code, data or notebook")
    seen = F.length(F.concat_ws("", "summary", "content_preview", "error", F.to_json("details")))
    return (p.groupBy(kind.alias("parser")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("details.words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(F.col("parser").isin("markdown", "generic"), F.col("details.lines"))),
                   F.lit(0)).alias("lines"),
        F.sum("size").cast("bigint").alias("size_bytes"), F.sum(seen).alias("seen"))
        .where("seen >= 0").drop("seen"))


@register("python_profile", None)
def python_profile(spark, sf_dir):
    """Python grammar profile (stdlib ast in the Arrow job): rows-only."""
    p = _parsed(spark, sf_dir).filter(F.col("parser") == "python")
    return p.select("path", "summary", "success", "error", "details.lines_of_code",
                    F.array_join("details.functions", ",").alias("functions"),
                    F.array_join("details.classes", ",").alias("classes"),
                    F.array_join("details.imports", ",").alias("imports"))


@register("csv_profile", None)
def csv_profile(spark, sf_dir):
    """Pandas CSV profile in the Arrow job: rows-only."""
    p = _parsed(spark, sf_dir).filter(F.col("parser") == "csv")
    return p.select("path", "summary", "success", "error", "details.rows", "details.columns",
                    F.array_join("details.column_names", "|").alias("column_names"),
                    F.array_join(F.transform("details.dtypes", lambda d: d["dtype"]), ",")
                    .alias("dtypes"))


def _as_notebook(files):
    """.ipynb documents become nbformat-4 notebooks: one cell per line,
    code and markdown cells alternating."""
    lines = F.split(F.col("content"), "\n", -1)
    cells = F.transform(lines, lambda l, i: F.struct(
        F.when(i % 2 == 0, "code").otherwise("markdown").alias("cell_type"),
        F.struct().alias("metadata"), l.alias("source")))
    nb = F.to_json(F.struct(cells.alias("cells"), F.struct().alias("metadata"),
                            F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor")))
    return files.withColumn("content", F.when(F.col("suffix") == ".ipynb", nb)
                            .otherwise(F.col("content")))


def _nb_preview_sql() -> str:
    cell = lambda i, kind: (f"'[Cell {i} - {kind}]' || chr(10) || "  # noqa: E731
                            f"coalesce(substring(ls[{i}], 1, 200), '')")
    body = (f"CASE WHEN n = 1 THEN {cell(1, 'code')} "
            f"WHEN n = 2 THEN {cell(1, 'code')} || chr(10) || chr(10) || {cell(2, 'markdown')} "
            f"ELSE {cell(1, 'code')} || chr(10) || chr(10) || {cell(2, 'markdown')} || chr(10) "
            f"|| chr(10) || {cell(3, 'code')} END")
    return body


@register("notebook_profile", O.with_inventory() + f"""
, nb AS (SELECT path, string_split(content, chr(10)) AS ls FROM inventory
         WHERE file_type = 'notebook' AND suffix = '.ipynb'),
nb2 AS (SELECT path, ls, len(ls) AS n FROM nb),
nb3 AS (SELECT path, n, {_nb_preview_sql()} AS pv FROM nb2)
SELECT path, 'Jupyter notebook with ' || n || ' cells (' || (n + 1) // 2 || ' code, '
    || n // 2 || ' markdown)' AS summary,
  CAST(n AS BIGINT) AS total_cells, CAST((n + 1) // 2 AS BIGINT) AS code_cells,
  CAST(n // 2 AS BIGINT) AS markdown_cells, {O.preview('pv')} AS content_preview
FROM nb3""".replace("\n, nb AS", ",\nnb AS"))
def notebook_profile(spark, sf_dir):
    """Notebook cells and preview (JSON read as VARIANT, no Python)."""
    p = parse.parse_files(_as_notebook(_inventory(spark, sf_dir))
                          .filter((F.col("file_type") == "notebook") & (F.col("suffix") == ".ipynb")),
                          native_only=True)
    return p.select("path", "summary", "details.total_cells", "details.code_cells",
                    "details.markdown_cells", "content_preview")


@register("parse_errors", None)
def parse_errors(spark, sf_dir):
    """C7: "{name}: {error}" for each failed parse (messages from the parsers)."""
    return parse.parse_errors(_parsed(spark, sf_dir))


@register("enhanced_files", O.with_inventory() + f"""
SELECT path, name, file_type AS type, size AS size_bytes, {O.iso('modified')} AS modified,
  'unknown' AS author, CASE WHEN file_type = 'code' THEN 'python' END AS language,
  CASE WHEN file_type IN ('data', 'note') THEN ltrim(suffix, '.')
       WHEN file_type = 'notebook' THEN 'jupyter' END AS format,
  CASE WHEN file_type = 'notebook' THEN 'python3' END AS kernel
FROM inventory""")
def enhanced_files(spark, sf_dir):
    """The enhanced file record (parse-independent fields compared)."""
    e = enrich.enhanced_files(_parsed(spark, sf_dir))
    return e.select("path", "name", "type", "size_bytes", "modified", "author",
                    "analysis.language", "analysis.format", "analysis.kernel")


@register("file_tags", None)
def file_tags(spark, sf_dir):
    """Ordered tags (import/column rules use the parse): rows-only."""
    p = _parsed(spark, sf_dir)
    return p.select("path", F.array_join(enrich.tags(), ",").alias("tags"),
                    F.when(F.col("file_type") == "code", enrich.complexity()).alias("complexity"))


# ------------------------------------------------------- generated sources
# Python and CSV files generated from each document, so that the Arrow-side
# parsers (stdlib ast, pandas) are checked value by value: the structure of
# the generated file is known, its content comes from the document.

_PY_FILES = "(file_type = 'code' AND suffix = '.py')"
_CSV_FILES = "(file_type = 'data' AND suffix = '.csv')"


def _as_python(files):
    """One module per .py document: pandas (even ids) or numpy (odd ids)
    and a module of its own imported, a class with a method, and one
    function per document line carrying the line as a comment."""
    lines = F.split(F.col("content"), "\n", -1)
    defs = F.transform(lines, lambda l, i: F.concat(
        F.lit("def f_"), i.cast("string"), F.lit("():\n    # "),
        F.regexp_replace(l, "[\\r\\x00]", " "), F.lit("\n    return "),
        F.length(l).cast("string")))
    lib = F.when(F.col("name_id").cast("bigint") % 2 == 0, F.lit("import pandas as pd\n")) \
        .otherwise(F.lit("import numpy as np\n"))
    code = F.concat(lib, F.lit("import mod_"), F.col("name_id"), F.lit("\nclass C"), F.col("name_id"),
                    F.lit(":\n    def method(self):\n        return 0\n"), F.array_join(defs, "\n"))
    return (files.withColumn("name_id", F.regexp_extract("name", "([0-9]+)", 1))
            .withColumn("content", F.when((F.col("file_type") == "code") & (F.col("suffix") == ".py"),
                                          code).otherwise(F.col("content")))
            .drop("name_id"))


def _py_code_sql() -> str:
    return ("CASE WHEN CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) % 2 = 0 "
            "THEN 'import pandas as pd' ELSE 'import numpy as np' END || chr(10) || "
            "'import mod_' || regexp_extract(name, '([0-9]+)', 1) || chr(10) || 'class C' || "
            "regexp_extract(name, '([0-9]+)', 1) || ':' || chr(10) || '    def method(self):' || "
            "chr(10) || '        return 0' || chr(10) || array_to_string(list_transform("
            "string_split(content, chr(10)), lambda l, i: 'def f_' || (i - 1) || '():' || chr(10) "
            "|| '    # ' || regexp_replace(l, '[\\r\\x00]', ' ', 'g') || chr(10) || "
            "'    return ' || length(l)), chr(10))")


@register("python_profile_generated", O.with_inventory() + f"""
, g AS (SELECT path, name, content, len(string_split(content, chr(10))) AS n,
          {_py_code_sql()} AS code FROM inventory WHERE {_PY_FILES}),
h AS (SELECT *, array_to_string(list_slice(string_split(code, chr(10)), 1, 20), chr(10)) AS head
      FROM g)
SELECT path, 'Python file with 1 class(es), ' || (n + 1) || ' function(s)' AS summary,
  TRUE AS success, CAST(5 + 3 * n AS BIGINT) AS lines_of_code,
  array_to_string(list_transform(range(n), lambda i: 'f_' || i), ',') || ',method' AS functions,
  'C' || regexp_extract(name, '([0-9]+)', 1) AS classes,
  CASE WHEN CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) % 2 = 0 THEN 'pandas'
       ELSE 'numpy' END || ',mod_' || regexp_extract(name, '([0-9]+)', 1) AS imports,
  {O.preview('head')} AS content_preview
FROM h""".replace("\n, g AS", ",\ng AS"))
def python_profile_generated(spark, sf_dir):
    """C1 checked exactly: generated modules parsed by ast in the Arrow job."""
    inv = _as_python(_inventory(spark, sf_dir)).filter(
        (F.col("file_type") == "code") & (F.col("suffix") == ".py"))
    p = parse.parse_files(inv)
    return p.select("path", "summary", "success", "details.lines_of_code",
                    F.array_join("details.functions", ",").alias("functions"),
                    F.array_join("details.classes", ",").alias("classes"),
                    F.array_join("details.imports", ",").alias("imports"),
                    "content_preview")


def _as_csv(files):
    """One CSV per .csv document: a row per word (quoted, prefixed so that
    pandas keeps it text), its length, and whether the length is even (the
    column is named "timestamp" for even ids, "even" otherwise)."""
    words = F.regexp_extract_all(F.col("content"), F.lit(WORD_RE), 0)
    rows = F.transform(words, lambda w: F.concat(
        F.lit('"w:'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('",'),
        F.length(w).cast("string"), F.lit(","),
        F.when(F.length(w) % 2 == 0, F.lit("True")).otherwise(F.lit("False"))))
    third = F.when(F.regexp_extract("name", "([0-9]+)", 1).cast("bigint") % 2 == 0,
                   F.lit("timestamp")).otherwise(F.lit("even"))
    body = F.concat(F.lit("word,chars,"), third, F.lit("\n"), F.array_join(rows, "\n"))
    return files.withColumn("content", F.when(
        (F.col("file_type") == "data") & (F.col("suffix") == ".csv"), body).otherwise(F.col("content")))


@register("csv_profile_generated", O.with_inventory() + f"""
, g AS (SELECT path, name, len(regexp_extract_all(content, '{O.WORD_RE}')) AS n
        FROM inventory WHERE {_CSV_FILES})
SELECT path, 'CSV file with ' || n || ' rows and 3 columns' AS summary, TRUE AS success,
  CAST(n AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns,
  'word|chars|' || CASE WHEN CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) % 2 = 0
                        THEN 'timestamp' ELSE 'even' END AS column_names,
  CASE WHEN n > 0 THEN 'object,int64,bool' ELSE 'object,object,object' END AS dtypes
FROM g""".replace("\n, g AS", ",\ng AS"))
def csv_profile_generated(spark, sf_dir):
    """C2 checked exactly: generated CSV files read by pandas in the Arrow job."""
    inv = _as_csv(_inventory(spark, sf_dir)).filter(
        (F.col("file_type") == "data") & (F.col("suffix") == ".csv"))
    p = parse.parse_files(inv)
    return p.select("path", "summary", "success", "details.rows", "details.columns",
                    F.array_join("details.column_names", "|").alias("column_names"),
                    F.array_join(F.transform("details.dtypes", lambda d: d["dtype"]), ",")
                    .alias("dtypes"))


def _has(col: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


@register("file_tags_generated", O.with_inventory() + f"""
, g AS (SELECT *, CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) % 2 = 0 AS even,
          len(string_split(content, chr(10))) AS n FROM inventory)
SELECT path,
  CASE file_type
    WHEN 'code' THEN concat_ws(',', 'code', CASE WHEN {_has('name', 'test')} THEN 'test' END,
      CASE WHEN {_has('name', 'analysis', 'analyze')} THEN 'analysis' END,
      CASE WHEN suffix = '.py' AND even THEN 'pandas' END,
      CASE WHEN suffix = '.py' AND NOT even THEN 'numpy' END)
    WHEN 'data' THEN concat_ws(',', 'data',
      CASE WHEN {_has('name', 'sensor', 'temperature')} THEN 'sensor-data' END,
      CASE WHEN suffix = '.csv' AND even THEN 'timeseries' END)
    WHEN 'notebook' THEN concat_ws(',', 'notebook', 'jupyter',
      CASE WHEN {_has('name', 'analysis')} THEN 'analysis' END,
      CASE WHEN {_has('name', 'visualization', 'viz')} THEN 'visualization' END)
    WHEN 'note' THEN concat_ws(',', 'documentation',
      CASE WHEN {_has('name', 'research')} THEN 'research' END,
      CASE WHEN {_has('name', 'readme')} THEN 'readme' END)
    ELSE '' END AS tags,
  CASE WHEN file_type <> 'code' THEN NULL
       WHEN suffix <> '.py' OR 5 + 3 * n < 50 THEN 'low'
       WHEN n + 2 < 5 AND 5 + 3 * n < 200 THEN 'medium' ELSE 'high' END AS complexity
FROM g""".replace("\n, g AS", ",\ng AS"))
def file_tags_generated(spark, sf_dir):
    """P4/P5 checked exactly: tags from names, imports and CSV columns, and
    code complexity, over the generated sources."""
    inv = _as_notebook(_as_csv(_as_python(_inventory(spark, sf_dir))))
    p = parse.parse_files(inv)
    return p.select("path", F.array_join(enrich.tags(), ",").alias("tags"),
                    F.when(F.col("file_type") == "code", enrich.complexity()).alias("complexity"))


def generated_files(spark, sf_dir):
    """The inventory with generated code, CSV and notebook files."""
    return _as_notebook(_as_csv(_as_python(_inventory(spark, sf_dir))))


def _repr_sql(items: str) -> str:
    """A list of plain strings as Python prints it, cut to 200 characters."""
    sep = "chr(39) || ', ' || chr(39)"
    return (f"substring('[' || chr(39) || array_to_string({items}, {sep}) || chr(39) || ']', 1, 200)")


def _csv_index_sql() -> str:
    """Index text of the generated CSV files. The preview is pandas' table of
    the first five rows: an index column, then right-aligned columns two
    spaces apart."""
    words = f"regexp_extract_all(content, '{O.WORD_RE}')"
    third = "CASE WHEN num % 2 = 0 THEN 'timestamp' ELSE 'even' END"
    flag = "(CASE WHEN length(x) % 2 = 0 THEN 'True' ELSE 'False' END)"
    widths = {
        "w1": "greatest(4, list_max(list_transform(five, lambda x: length(x) + 2)))",
        "w2": "greatest(5, list_max(list_transform(five, lambda x: length(length(x)::VARCHAR))))",
        "w3": f"greatest(length({third}), list_max(list_transform(five, lambda x: length({flag}))))",
    }
    pad = lambda text, width: f"repeat(' ', ({width} - length({text}))::BIGINT) || {text}"
    row = (f"(i - 1) || '  ' || {pad("('w:' || x)", 'w1')} || '  ' || "
           f"{pad('length(x)::VARCHAR', 'w2')} || '  ' || {pad(flag, 'w3')}")
    head = (f"'   ' || {pad("'word'", 'w1')} || '  ' || {pad("'chars'", 'w2')} || '  ' || "
            f"{pad(f'({third})', 'w3')}")
    quoted = lambda *names: " || ', ' || ".join(f"chr(39) || {n} || chr(39)" for n in names)
    types = lambda *t: " || ', ' || ".join(
        f"chr(39) || {n} || chr(39) || ': ' || chr(39) || '{x}' || chr(39)"
        for n, x in zip(("'word'", "'chars'", f"({third})"), t))
    return f"""SELECT path, file_type, concat_ws(chr(10),
      'CSV file with ' || n_words || ' rows and 3 columns', {O.preview('pv')},
      'rows: ' || n_words, 'columns: 3',
      'column_names: [' || {quoted("'word'", "'chars'", f"({third})")} || ']',
      'dtypes: {{' || CASE WHEN n_words > 0 THEN {types('object', 'int64', 'bool')}
        ELSE {types('object', 'object', 'object')} END || '}}') AS index_text
  FROM (SELECT *, CASE WHEN n_words = 0
          THEN 'Empty DataFrame' || chr(10) || 'Columns: [word, chars, ' || ({third}) || ']' || chr(10)
            || 'Index: []'
          ELSE {head} || chr(10) || array_to_string(list_transform(five, lambda x, i: {row}), chr(10))
          END AS pv
        FROM (SELECT *, {", ".join(f"{w} AS {k}" for k, w in widths.items())}
              FROM (SELECT *, list_slice({words}, 1, 5) AS five, len({words}) AS n_words
                    FROM gi WHERE is_csv)))"""


def index_text_sql() -> str:
    """CTE ``indexed`` (path, file_type, index_text): every file of the
    generated workspace."""
    detail = lambda **kv: ", ".join(f"'{k}: ' || {v}" for k, v in kv.items())
    return O.with_inventory() + f""",
gi AS (
  SELECT *, {_NORM} AS t, CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) AS num,
    string_split(content, chr(10)) AS ls, len(string_split(content, chr(10))) AS n,
    {_PY_FILES} AS is_py, {_CSV_FILES} AS is_csv,
    (file_type = 'notebook' AND suffix = '.ipynb') AS is_nb,
    (file_type = 'note' AND suffix = '.md') AS is_md
  FROM inventory),
py AS (
  SELECT path, file_type, n, num, {_py_code_sql()} AS code,
    list_transform(range(n), lambda i: 'f_' || i) || ['method'] AS fns,
    ['C' || num] AS cls, [CASE WHEN num % 2 = 0 THEN 'pandas' ELSE 'numpy' END, 'mod_' || num] AS imps
  FROM gi WHERE is_py),
py2 AS (
  SELECT *, array_to_string(list_slice(string_split(code, chr(10)), 1, 20), chr(10)) AS head FROM py),
nb AS (SELECT path, file_type, ls, n, {_nb_preview_sql()} AS pv FROM gi WHERE is_nb),
indexed AS (
  SELECT path, file_type, concat_ws(chr(10),
      'Python file with 1 class(es), ' || (n + 1) || ' function(s)', nullif({O.preview('head')}, ''),
      'classes: ' || {_repr_sql('cls')}, 'functions: ' || {_repr_sql('fns')},
      'imports: ' || {_repr_sql('imps')}, 'lines_of_code: ' || (5 + 3 * n)) AS index_text
  FROM py2
  UNION ALL
  SELECT path, file_type, concat_ws(chr(10),
      'Jupyter notebook with ' || n || ' cells (' || (n + 1) // 2 || ' code, ' || n // 2 || ' markdown)',
      nullif({O.preview('pv')}, ''),
      {detail(total_cells='n', code_cells='((n + 1) // 2)', markdown_cells='(n // 2)')})
  FROM nb
  UNION ALL
  SELECT path, file_type, concat_ws(chr(10), 'Markdown file with ' || {O.words('t')} || ' words, '
      || {O.lines('t')} || ' lines, ' || {O.headers('t')} || ' headers', nullif({O.preview('t')}, ''),
      {detail(words=O.words('t'), lines=O.lines('t'), headers=O.headers('t'))})
  FROM gi WHERE is_md
  UNION ALL
  SELECT path, file_type, concat_ws(chr(10), upper(file_type[1]) || file_type[2:] || ' file with '
      || {O.lines('t')} || ' lines', nullif({O.preview('t')}, ''),
      {detail(lines=O.lines('t'), words=O.words('t'), size_bytes='size')})
  FROM gi WHERE NOT (is_py OR is_csv OR is_nb OR is_md)
  UNION ALL
  {_csv_index_sql()})"""


@register("index_text", index_text_sql() + """
SELECT path, index_text FROM indexed""")
def index_text(spark, sf_dir):
    """V1: the text that is embedded for each successfully parsed file, the
    generated code, CSV and notebook files included."""
    p = parse.parse_files(generated_files(spark, sf_dir))
    return p.filter("success").select("path", V.index_text().alias("index_text"))


@register("parse_errors_generated", O.with_inventory() + f"""
SELECT path, name || ': ' || CASE
    WHEN {_PY_FILES} THEN 'Syntax error: expected ' || chr(39) || ':' || chr(39)
      || ' (<unknown>, line ' || (len(string_split(content, chr(10))) + 1) || ')'
    ELSE 'Notebook does not appear to be JSON: ' || chr(39) || 'doc '
      || regexp_extract(name, '([0-9]+)', 1) || chr(39) END AS message
FROM inventory WHERE {_PY_FILES} OR (file_type = 'notebook' AND suffix = '.ipynb')""")
def parse_errors_generated(spark, sf_dir):
    """C7 checked exactly: modules whose last line is a function without a
    colon, and notebooks that are not JSON."""
    inv = _inventory(spark, sf_dir)
    is_py = (F.col("file_type") == "code") & (F.col("suffix") == ".py")
    is_nb = (F.col("file_type") == "notebook") & (F.col("suffix") == ".ipynb")
    comments = F.array_join(F.transform(F.split("content", "\n", -1), lambda l: F.concat(
        F.lit("# "), F.regexp_replace(l, "[\\r\\x00\\x0c]", " "))), "\n")
    broken = (F.when(is_py, F.concat(comments, F.lit("\ndef incomplete()\n")))
              .when(is_nb, F.concat(F.lit("doc "), F.regexp_extract("name", "([0-9]+)", 1)))
              .otherwise(F.col("content")))
    parsed = parse.parse_files(inv.withColumn("content", broken))
    return parse.parse_errors(parsed.filter(F.col("parser").isin("python", "notebook")))
