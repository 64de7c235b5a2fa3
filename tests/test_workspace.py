"""The workspace data source, the parsers and a full report on a real folder.

Expected values are written by hand for the files created here.
"""

import datetime as dt
import json
import os

import pytest

from quarry.operators import parse
from quarry.plans import report as R
from quarry.sources.workspace import read_workspace

SAMPLE_PY = '''import os
from collections import OrderedDict
import numpy as np


def hello_world():
    return "hi"


class SampleClass:
    def __init__(self):
        self.x = 1

    def method(self):
        def inner():
            return 2
        return inner()


async def not_counted():
    pass
'''

DATA_CSV = "name,age,city\nAnn,31,Oslo\nBo,42,Rome\nCy,27,Lima\n"
SENSOR_CSV = "timestamp,temperature\n2024-01-01T00:00,20.5\n2024-01-01T01:00,21.0\n"
NOTES_MD = "# Title\n\nSome words here.\n\n## Section\n  # indented header\n- item one\n- item two\n"
NOTEBOOK = {
    "nbformat": 4, "nbformat_minor": 5, "metadata": {},
    "cells": [
        {"cell_type": "markdown", "metadata": {}, "source": ["# Analysis\n", "text"]},
        {"cell_type": "code", "metadata": {}, "source": "print(1)", "outputs": [],
         "execution_count": None},
        {"cell_type": "raw", "metadata": {}, "source": "raw"},
        {"cell_type": "code", "metadata": {}, "source": "x = 2", "outputs": [],
         "execution_count": None},
    ],
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    files = {
        "sample.py": SAMPLE_PY,
        "data.csv": DATA_CSV,
        "sensor_log.csv": SENSOR_CSV,
        "notes.md": NOTES_MD,
        "analysis_viz.ipynb": json.dumps(NOTEBOOK),
        "broken.ipynb": "not json at all",
        "bad.py": "def incomplete_function(\n",
        "empty.csv": "",
        "readme.txt": "line one\r\nline two\rline three",
        "blob.bin": b"\xff\xfe\x00binary",
        "__init__.py": "",
        ".env": "KEY=1\n",
        "_private.yml": "a: 1\n",
        "subdir/nested.py": "import numpy as np\n\ndef calculate(x):\n    return np.sqrt(x)\n",
        "subdir/deeper/more/leaf.md": "leaf\n",
        "__pycache__/sample.pyc": "compiled",
        ".git/config": "[core]",
        "myvenv2/lib.py": "x = 1",
        "x.pyc/inside.txt": "hidden by the .pyc directory",
        "keep/.gitignore": "*.log",
        "keep/module.pyc": "ignored by suffix",
    }
    for rel, body in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        if isinstance(body, bytes):
            p.write_bytes(body)
        else:
            p.write_bytes(body.encode("utf-8"))
    stamp = dt.datetime(2024, 1, 10, 12, 0, 0).timestamp()
    for rel in files:
        os.utime(root / rel, (stamp, stamp))
    late = dt.datetime(2024, 3, 1, 8, 30, 0, 123456).timestamp()
    os.utime(root / "notes.md", (late, late))
    return str(root)


EXPECTED = {
    "sample.py", "data.csv", "sensor_log.csv", "notes.md", "analysis_viz.ipynb", "broken.ipynb",
    "bad.py", "empty.csv", "readme.txt", "blob.bin", "__init__.py", ".env", "_private.yml",
    "subdir/nested.py", "subdir/deeper/more/leaf.md",
}


def _rel(root, paths):
    return {os.path.relpath(p, root) for p in paths}


def test_listing_keeps_hidden_and_prunes_ignored(spark, workspace):
    files = read_workspace(spark, workspace, filesPerPartition=3)
    assert _rel(workspace, [r.path for r in files.select("path").collect()]) == EXPECTED


def test_links_to_directories_are_no_files_and_not_entered(spark, tmp_path):
    root = tmp_path / "links"
    (root / "a" / "b" / "c").mkdir(parents=True)
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "hidden.md").write_text("x")
    for where in (root, root / "a", root / "a" / "b" / "c"):
        (where / "file.md").write_text("# x")
        (where / "dirlink").symlink_to(outside, target_is_directory=True)
        (where / "filelink.md").symlink_to(outside / "hidden.md")
    (root / "gone.md").symlink_to(tmp_path / "nothing")
    files = read_workspace(spark, str(root))
    found = _rel(str(root), [r.path for r in files.collect()])
    assert found == {os.path.join(d, n) for d in ("", "a", "a/b/c") for n in ("file.md", "filelink.md")}


def test_include_ignored_counts_only_reached_files(spark, workspace):
    files = read_workspace(spark, workspace, includeIgnored=True)
    ignored = _rel(workspace, [r.path for r in files.filter("ignored").collect()])
    # .gitignore matches ".git" as a substring; module.pyc by suffix;
    # files under pruned directories are never reached
    assert ignored == {"keep/.gitignore", "keep/module.pyc"}


def test_types_sizes_and_inclusive_window(spark, workspace):
    files = read_workspace(spark, workspace, start="2024-01-10 12:00:00",
                           end="2024-01-10 12:00:00")
    rows = {os.path.relpath(r.path, workspace): r for r in files.collect()}
    assert "notes.md" not in rows  # modified later
    assert rows["sample.py"].file_type == "code"
    assert rows["data.csv"].file_type == "data"
    assert rows["analysis_viz.ipynb"].file_type == "notebook"
    assert rows["readme.txt"].file_type == "note"
    assert rows["blob.bin"].file_type == "other"
    assert rows["_private.yml"].file_type == "data"
    assert rows[".env"].file_type == "other"
    assert rows["empty.csv"].size == 0
    late = read_workspace(spark, workspace, start="2024-03-01 08:30:00.123456").collect()
    assert [os.path.relpath(r.path, workspace) for r in late] == ["notes.md"]
    assert late[0].modified == dt.datetime(2024, 3, 1, 8, 30, 0, 123456)


@pytest.fixture(scope="module")
def parsed(spark, workspace):
    files = read_workspace(spark, workspace)
    rows = parse.parse_files(files).collect()
    return {os.path.relpath(r.path, workspace): r for r in rows}


def test_python_profile(parsed):
    r = parsed["sample.py"]
    assert r.success and r.parser == "python"
    d = r.details
    assert d.classes == ["SampleClass"]
    # breadth-first: module level first, then methods, then nested
    assert d.functions == ["hello_world", "__init__", "method", "inner"]
    assert d.imports == ["os", "collections", "numpy"]
    assert d.lines_of_code == len(SAMPLE_PY.split("\n"))
    assert r.summary == "Python file with 1 class(es), 4 function(s)"
    bad = parsed["bad.py"]
    assert not bad.success
    assert bad.summary == "Python file with syntax errors"
    assert bad.error.startswith("Syntax error: ")
    empty = parsed["__init__.py"]
    assert empty.success and empty.summary == "Python file with no classes or functions"


def test_csv_profile(parsed):
    r = parsed["data.csv"]
    assert r.summary == "CSV file with 3 rows and 3 columns"
    assert r.details.column_names == ["name", "age", "city"]
    assert [(x.name, x.dtype) for x in r.details.dtypes] == [
        ("name", "object"), ("age", "int64"), ("city", "object")]
    e = parsed["empty.csv"]
    assert e.success and e.summary == "Empty CSV file"
    assert e.details.rows == 0 and e.details.columns == 0


def test_notebook_profile(parsed):
    r = parsed["analysis_viz.ipynb"]
    assert r.summary == "Jupyter notebook with 4 cells (2 code, 1 markdown)"
    assert r.content_preview.startswith("[Cell 1 - markdown]\n# Analysis\ntext\n\n[Cell 2 - code]")
    b = parsed["broken.ipynb"]
    assert not b.success and b.summary == "Jupyter notebook (parse error)"
    assert b.error.startswith("Notebook does not appear to be JSON: 'not json at all'")


def test_markdown_generic_binary(parsed):
    md = parsed["notes.md"]
    assert md.details.headers == 3
    assert md.details.lines == len(NOTES_MD.split("\n"))
    assert md.details.words == len(NOTES_MD.split())
    txt = parsed["readme.txt"]
    assert txt.summary == "Note file with 3 lines"
    assert txt.content_preview == "line one\nline two\nline three"
    b = parsed["blob.bin"]
    assert b.summary == "Binary other file (9 bytes)"
    assert b.content_preview == "[Binary content]" and b.success


def test_parse_errors_list(spark, workspace):
    files = read_workspace(spark, workspace)
    msgs = {r.message for r in parse.parse_errors(parse.parse_files(files)).collect()}
    assert any(m.startswith("bad.py: Syntax error") for m in msgs)
    assert any(m.startswith("broken.ipynb: Notebook does not appear") for m in msgs)


def test_report_end_to_end(spark, workspace):
    from quarry.operators.tickets import TICKET_SCHEMA
    tickets = spark.createDataFrame([
        ("T-ALL", workspace, None, None, True, True, None),
        ("T-JAN", workspace, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), False, True,
         ("Ann", None, None, None, "What changed?", "Slack", None, "High", None, None)),
        ("T-BAD", workspace, None, None, False, True, None),
        ("T-NONE", workspace, dt.datetime(2031, 1, 1), dt.datetime(2031, 2, 1), False, True, None),
    ], TICKET_SCHEMA)
    files = read_workspace(spark, workspace)
    run = R.prepare(files, tickets)
    reports = {r.task_id: r for r in R.build_reports(run, "2024-03-02T00:00:00").collect()}
    all_ = reports["T-ALL"]
    assert all_.status == "success"
    assert all_.message == f"Successfully processed {len(EXPECTED)} files"
    by_type = all_.results.breakdown_by_type
    assert by_type.code["count"] == 4 and by_type.code.languages == ["python"]
    assert by_type.data["count"] == 4 and by_type.data.formats == ["csv", "yml"]
    assert by_type.data.total_rows == 5 and by_type.data.total_columns == 3
    assert by_type.notebook["count"] == 2 and by_type.notebook.total_cells == 4
    assert by_type.note.formats == ["md", "txt"]
    assert all_.insights.activity_summary == "Active development with code changes"
    assert [a.action for a in all_.suggested_actions] == [
        "semantic_search", "deep_dive", "execute_notebook", "compare"]
    assert all_.results.statistics.parse_failed == 2
    assert all_.results.statistics.files_indexed == len(EXPECTED) - 2
    jan = reports["T-JAN"]
    assert jan.results.statistics.files_processed == len(EXPECTED) - 1  # notes.md is March
    assert jan.context.requester.name == "Ann" and jan.context.request.urgency == "High"
    assert reports["T-BAD"].status == "error"
    assert reports["T-BAD"].message == ("Task failed: start_date and end_date required "
                                        "when scan_all=False")
    none = reports["T-NONE"]
    assert none.message == "No files found matching criteria"
    assert none.insights.activity_summary == "No activity found"
    assert none.results.summary == "No files were processed."
    # the nested report serialises to JSON
    json.loads(R.build_reports(run, "x").toJSON().first())


def whole_documents(folder):
    """(task id, ticket) -> document: its part files, one behind the other, as JSON."""
    import pathlib
    from urllib.parse import unquote
    return {(unquote(d.parent.name.split("=", 1)[1]), d.name.split("=", 1)[1]):
            json.loads("".join(p.read_text() for p in sorted(d.glob("part-*"))))
            for d in pathlib.Path(folder).glob("task_id=*/ticket=*")}


def test_run_tickets_writes_outputs_and_index(spark, workspace, tmp_path):
    from quarry.operators.tickets import TICKET_SCHEMA
    from quarry.plans import runner as P
    tickets = spark.createDataFrame(
        [("T-ALL", workspace, None, None, True, True, None)], TICKET_SCHEMA)
    files = read_workspace(spark, workspace)
    out = P.run_tickets(spark, files, tickets, str(tmp_path / "out"),
                        collection=str(tmp_path / "coll"))
    rep = spark.read.json(str(tmp_path / "out" / "reports")).first()
    assert rep.status == "success"
    assert rep.performance.processing_time_seconds >= 0
    assert rep.rag_status.total_documents == len(EXPECTED) - 2
    assert spark.read.parquet(str(tmp_path / "out" / "report_files")).count() == len(EXPECTED)
    assert spark.read.parquet(str(tmp_path / "out" / "report_errors")).count() == 2
    hits = P.search_workspace(spark, out["collection"], "calculate numpy", limit=3).collect()
    assert hits and hits[0].file_path.endswith("nested.py")
    # the report names the table of its files and the true embedder; its document lists its errors
    assert rep.results.files_location == str(tmp_path / "out" / "report_files")
    (doc,) = whole_documents(tmp_path / "out" / "documents").values()
    assert len(doc["errors"]) == 2 and any(e.startswith("bad.py: Syntax error") for e in doc["errors"])
    assert [f["path"].removeprefix(workspace + "/") for f in doc["results"]["files"]] == sorted(EXPECTED)
    assert doc["performance"]["processing_time_seconds"] == rep.performance.processing_time_seconds
    assert rep.rag_status.embedding_model == "hashed-words-md5"
    p = rep.performance
    assert p.processing_time_seconds >= p.scan_time_seconds + p.parse_time_seconds


def test_run_tickets_leaves_no_stage_tables(spark, workspace, tmp_path):
    from quarry.operators.tickets import TICKET_SCHEMA
    from quarry.plans import runner as P
    from quarry.session import ensure_checkpoint_dir
    files = read_workspace(spark, workspace)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    tickets = spark.createDataFrame(
        [("T-ALL", workspace, None, None, True, True, None)], TICKET_SCHEMA)
    P.run_tickets(spark, files, tickets, str(tmp_path / "o"), collection=str(tmp_path / "c"))
    assert set(os.listdir(folder)) == before


def test_large_files_are_named_in_the_warning(spark, tmp_path, monkeypatch):
    from quarry.operators import aggregate
    from quarry.operators.tickets import TICKET_SCHEMA
    root = tmp_path / "large"
    root.mkdir()
    for name, size in (("b.txt", 50), ("a.txt", 60), ("small.txt", 5)):
        (root / name).write_text("x" * size)
    monkeypatch.setattr(aggregate, "LARGE_FILE_BYTES", 20)
    tickets = spark.createDataFrame([("T", str(root), None, None, True, True, None)], TICKET_SCHEMA)
    run = R.prepare(read_workspace(spark, str(root)), tickets)
    (warning,) = R.build_reports(run, "x").first().warnings
    assert warning.affected_files == ["a.txt", "b.txt"] and "2 large files" in warning.message


ODD_NAMES = ["two words.txt", "br[a]ck{e}t.md", "per%20cent.txt", "_under.md", ".dot.txt",
             "plus+hash#q?.md", "ünï.txt"]


def test_text_files_of_any_name_and_encoding(spark, tmp_path):
    root = tmp_path / "odd"
    root.mkdir()
    bodies = {
        "bom.md": b"\xef\xbb\xbf# not a header\n# header\n",
        "cr.txt": b"a b\rc\rd", "crlf.md": b"# a b\r\nc\r\n\r\n  # d\r\n", "empty.txt": b"",
        "bad.txt": b"ok\n\xff\xfe\n", "bad.md": b"# ok \xc3\x28\n", "cut.md": b"# ok \xe2\x82",
        "noeol.txt": "x\u00a0y z\u2028w".encode(),
        **{n: f"# {n}\nsome words here".encode() for n in ODD_NAMES},
    }
    for name, body in bodies.items():
        (root / name).write_bytes(body)
    got = {r.name: r for r in parse.parse_files(read_workspace(spark, str(root))).collect()}
    assert set(got) == set(bodies)
    for name, body in bodies.items():
        r = got[name]
        try:
            text = body.decode().replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError as e:
            assert (r.error, r.success) == ((str(e), False) if name.endswith(".md") else (None, True))
            continue
        lines = text.split("\n")
        assert r.success and r.content_preview == text
        assert (r.details.words, r.details.lines) == (len(text.split()), len(lines)), name
        if name.endswith(".md"):
            assert r.details.headers == sum(x.strip().startswith("#") for x in lines), name


def test_measures_do_not_depend_on_the_piece_size(tmp_path):
    from quarry.functions.streams import measure_text
    text = "# A é\r\nword " * 40 + "\n\n  \t# B 日本\rtail\r" + "#" + "x" * 50 + " 😀"
    path = tmp_path / "f.md"
    path.write_bytes(text.encode())
    norm = text.replace("\r\n", "\n").replace("\r", "\n")
    want = (len(norm.split()), len(norm.split("\n")),
            sum(x.strip().startswith("#") for x in norm.split("\n")), norm[:31])
    for piece in (1, 2, 3, 7, 64, 1 << 20):
        m = measure_text(str(path), 30, piece)
        assert (m.words, m.lines, m.headers, m.head) == want, piece
    path.write_bytes(b"abc\n" * 5 + b"\xe2\x82\x28 tail")
    message = None
    try:
        path.read_bytes().decode()
    except UnicodeDecodeError as e:
        message = str(e)
    for piece in (1, 3, 4, 100):
        assert measure_text(str(path), 30, piece).error == message, piece


def test_flat_directory_is_read_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    flat = tmp_path / "flat"
    (flat / "big").mkdir(parents=True)
    for i in range(60):
        (flat / "big" / f"f{i:03d}.txt").write_text(f"file {i}\n")
    (flat / "small.md").write_text("# x\n")
    rows = read_workspace(spark, str(flat), filesPerPartition=10)
    assert rows.count() == 61
    tasks = rows.filter(F.col("path").contains("/big/")).select(
        F.input_file_name().alias("part")).distinct().count()
    assert tasks >= 2


def test_each_file_is_opened_by_one_branch(spark, workspace):
    plan = parse.parse_files(read_workspace(spark, workspace))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("MapInPandas") + physical.count("MapInArrow") == 2
    assert "content" not in physical.split("Scan parquet")[1].split("\n")[0].split("ReadSchema")[-1] \
        .replace("content_preview", "")


NOTEBOOKS = {
    "four.ipynb": NOTEBOOK,
    "lists.ipynb": {"nbformat": 4, "cells": [{"cell_type": "code", "source": ["a\n", "b"]},
                                             {"cell_type": "markdown", "source": []}]},
    "none.ipynb": {"nbformat": 4, "cells": []},
    "three.ipynb": {"nbformat": 3, "worksheets": [{"cells": [
        {"cell_type": "heading", "level": 2, "source": ["Big\n", "title"]},
        {"cell_type": "code", "input": ["x = 1"]}, {"cell_type": "html", "source": "<b>"}]}]},
    "two.ipynb": {"nbformat": 2, "worksheets": [{"cells": [{"cell_type": "code", "input": "y"}]}]},
    "one.ipynb": {"cells": [{"cell_type": "code", "code": "z"}, {"cell_type": "text", "text": "t"}]},
    "keyless.ipynb": {"nbformat": 4, "cells": [{"cell_type": "code"}]},
    "nine.ipynb": {"nbformat": 9},
}


def test_notebooks_of_all_formats_by_path_and_in_tables(spark, tmp_path):
    """Folder files take the Arrow job, table content the VARIANT path where
    it can: both give the same profiles."""
    from pyspark.sql import functions as F
    root = tmp_path / "nb"
    root.mkdir()
    for name, body in NOTEBOOKS.items():
        (root / name).write_text(json.dumps(body))
    (root / "text.ipynb").write_text("{not json")
    files = read_workspace(spark, str(root))
    bodies = spark.createDataFrame(
        [(n, (root / n).read_text()) for n in os.listdir(root)], "name string, content string")
    table = files.join(bodies, "name").select(*files.columns, "content")
    key = lambda r: r.name
    by_path = sorted(parse.parse_files(files).drop("modified").collect(), key=key)
    in_table = sorted(parse.parse_files(table).drop("modified").collect(), key=key)
    assert [r.asDict() for r in by_path] == [r.asDict() for r in in_table]
    got = {r.name: r for r in in_table}
    cells = {n: (r.details.total_cells, r.details.code_cells, r.details.markdown_cells)
             for n, r in got.items() if r.success}
    assert cells == {"four.ipynb": (4, 2, 1), "lists.ipynb": (2, 1, 1), "none.ipynb": (0, 0, 0),
                     "three.ipynb": (3, 1, 2), "two.ipynb": (1, 1, 0), "one.ipynb": (2, 1, 1)}
    assert got["three.ipynb"].content_preview.startswith("[Cell 1 - markdown]\n## Big title\n\n[Cell 2 - code]")
    assert got["lists.ipynb"].content_preview == "[Cell 1 - code]\na\nb\n\n[Cell 2 - markdown]\n"
    native = table.filter(F.col("name").isin("four.ipynb", "lists.ipynb", "none.ipynb"))
    assert parse.route(native).filter("python_side").count() == 0
