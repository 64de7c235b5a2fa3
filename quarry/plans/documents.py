"""Report documents (S9, T5): one JSON document per ticket, of any size.

A document holds lists that grow with the workspace (``results.files``,
``errors``, ``warnings[].affected_files``). They are never gathered: every
list element is a line of its own, and the lines of all documents are range
partitioned and sorted by (document, list, path) and written as they come. A
document is the folder of its ticket; its part files in the order of their
names are its text, so a large document is written by many tasks, and each
task keeps one line at a time.

The lines are ordinary JSON. Elements are indented, one space for files, two
for errors, three for affected files, and each but a list's first starts with a
comma; what stands around the lists starts at the margin, on at most four
lines. ``read_documents`` reads them back in parallel by that: the small
document around the lists and each element of each list.

Defined cases: tickets without a task id share the name ``unknown`` and are
told apart by the number of their report; tickets with equal reports have one
document; rows that repeat a path are kept, in the order of ``file_no``; a
ticket that is not valid has a document without results, on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators import enrich
from quarry.operators.parse import error_message
from quarry.plans import conformance
from quarry.plans.report import TicketRun

DOCUMENT = ("task_id", "ticket")
ORDER = (*DOCUMENT, "section", "path", "file_no")
FILES, ERRORS, AFFECTED = 1, 3, 5
# where the elements of each list stand in the schema, by their section
PARTS = {FILES: "results.files[]", ERRORS: "errors[]", AFFECTED: "warnings[].affected_files[]"}
# what stands around the lists, by how its lines start
_AROUND = ("{", "]},\"errors\"", "],\"warnings\"", "]")


def _open(value: Column) -> Column:
    """JSON of a struct without its closing brace."""
    text = F.to_json(value)
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _string(value: Column) -> Column:
    """JSON of a string."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _around(reports: DataFrame) -> DataFrame:
    """The lines around the lists of every document."""
    grown = ("results", "errors", "warnings")
    outer = F.struct(*[c for c in reports.columns
                       if c not in (*grown, "ticket", "scope_id") and not c.startswith("first_")])
    valid = F.col("status") == "success"
    warning = F.get("warnings", F.lit(0))
    warned = warning.isNotNull()
    line = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("line"))
    whole = F.array(
        line(0, F.concat(_open(outer), F.lit(',"results":'), _open(F.col("results")), F.lit(',"files":['))),
        line(ERRORS - 1, F.lit(']},"errors":[')),
        line(AFFECTED - 1, F.concat(F.lit('],"warnings":['), F.when(warned, F.concat(
            _open(F.struct(warning["level"].alias("level"), warning["message"].alias("message"))),
            F.lit(',"affected_files":['))).otherwise(""))),
        line(AFFECTED + 1, F.concat(F.when(warned, "]}").otherwise(""), F.lit("]}"))))
    failed = F.array(line(0, F.concat(_open(outer), F.lit(',"errors":['),
                                      _string(F.get("errors", F.lit(0))), F.lit("]}"))))
    return (reports.select(*DOCUMENT, F.explode(F.when(valid, whole).otherwise(failed)).alias("x"))
            .select(*DOCUMENT, "x.section", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("file_no"),
                    "x.line"))


def _elements(run: TicketRun, reports: DataFrame) -> DataFrame:
    """The lines of the lists: each element is made once per scope and copied
    to the scope's documents."""
    record = F.struct(*enrich.enhanced_files(run.parsed).columns)
    made = (enrich.enhanced_files(run.pairs, keys=("scope_id", "file_no", "success", "error", "size"))
            .select("scope_id", "path", "file_no", F.to_json(record).alias("file"),
                    F.when(~F.col("success"), _string(error_message())).alias("failed"),
                    F.when(F.col("size") > A.LARGE_FILE_BYTES, _string(F.col("name"))).alias("large")))
    papers = reports.where("scope_id IS NOT NULL").select(
        "scope_id", *DOCUMENT, "first_file", "first_error", "first_large")
    here = F.struct("path", "file_no")

    def line(section: int, text: Column, first: str, indent: str) -> Column:
        comma = F.when(here == F.col(first), indent).otherwise(indent + ",")
        return F.when(text.isNotNull(), F.struct(F.lit(section).alias("section"), F.concat(comma, text).alias("line")))

    lines = F.array_compact(F.array(line(FILES, F.col("file"), "first_file", " "),
                                    line(ERRORS, F.col("failed"), "first_error", "  "),
                                    line(AFFECTED, F.col("large"), "first_large", "   ")))
    return (made.join(papers, "scope_id")
            .select(*DOCUMENT, "path", "file_no", F.explode(lines).alias("x"))
            .select(*DOCUMENT, "x.section", "path", "file_no", "x.line"))


def document_lines(run: TicketRun, reports: DataFrame) -> DataFrame:
    """Every line of every document, with its place (``ORDER``). ``reports``
    are ``build_reports(run, ..., lists=False)``."""
    shown = F.struct(*[c for c in reports.columns if c != "scope_id"])
    papers = (reports.join(A.scope_firsts(run.parsed, run.selection), "scope_id", "left")
              .withColumn("task_id", F.coalesce("task_id", F.lit("unknown")))
              .withColumn("ticket", F.coalesce(F.lower(F.hex(F.xxhash64(F.to_json(shown)))), F.lit("")))
              .dropDuplicates(list(DOCUMENT)))
    return _around(papers).unionByName(_elements(run, papers))


def write_documents(lines: DataFrame, path: str) -> None:
    """Streams sorted lines into the documents' folders under ``path``."""
    (lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
     .select(F.col("line").alias("value"), *DOCUMENT)
     .write.mode("overwrite").partitionBy(*DOCUMENT).text(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """task_id, ticket, part and document: the JSON around the lists (part
    ``''``) and each element of each list (part as in ``PARTS``)."""
    lines = spark.read.schema(f"value string, {', '.join(f'{c} string' for c in DOCUMENT)}").text(path)
    indent = F.length("value") - F.length(F.ltrim("value"))
    part = F.when(indent == 0, "")
    for n, at in enumerate(PARTS.values(), 1):
        part = part.when(indent == n, at)
    lines = lines.withColumn("part", part)
    place = F.lit(len(_AROUND))
    for n, start in reversed(list(enumerate(_AROUND))):
        place = F.when(F.col("value").startswith(start), n).otherwise(place)
    around = (lines.where("part = ''").groupBy(*DOCUMENT)
              .agg(F.array_sort(F.collect_list(F.struct(place.alias("n"), "value"))).alias("x"))
              .select(*DOCUMENT, F.lit("").alias("part"), F.array_join("x.value", "").alias("document")))
    elements = lines.where("part != ''").select(
        *DOCUMENT, "part", F.regexp_replace("value", "^ +,?", "").alias("document"))
    return around.unionByName(elements)


def stored_violations(documents: DataFrame, schema: dict) -> DataFrame:
    """T8 over documents read back: task_id, ticket, path, rule, value."""
    found = None
    for part in ("", *PARTS.values()):
        some = conformance.violations(documents.where(F.col("part") == part).drop("part"), schema, at=part)
        found = some if found is None else found.unionByName(some)
    return found
