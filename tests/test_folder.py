"""Folder files by byte ranges, the data source, and observed counters."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import parse, scan
from quarry.session import materialize_observed
from quarry.sources import datasource
from quarry.sources.tables import write_tree
from quarry.sources.workspace import read_workspace

PARTS = ["a", "b c", " ", "\n", "\r\n", "\r", "#", "# x\n", "é", "漢字", "😀", "\t", "\x1c", "　", "  # h\n", "word" * 30]
BROKEN = [b"\xff", b"\xe6\xbc", b"\x80", b"\xf0\x9f\x98", b"\xc3", b"\xf0\x9f\x98\x80\x80\x80\x80", b"\xed\xa0\x80",
          b"\x80" * 5, b"\xe6A"]


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    for i in range(n):
        raw = "".join(rng.choices(PARTS, k=rng.randint(0, 30))).encode()
        if i % 4 == 3:
            k = rng.randint(0, len(raw))
            raw = raw[:k] + rng.choice(BROKEN) + raw[k:]
        yield raw


def plain(raw, md):
    """(words, lines, headers, preview) of a text, or the error of its bytes."""
    try:
        text = raw.decode().replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as e:
        return str(e) if md else "[Binary content]"
    headers = sum(line.strip().startswith("#") for line in text.split("\n")) if md else None
    return len(text.split()), text.count("\n") + 1, headers, text[:500] + "..." * (len(text) > 500)


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 7, 50, 1 << 20])
def test_profiles_are_the_same_at_every_range_size(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(parse, "RANGE_BYTES", range_bytes)
    root = tmp_path / "tree"
    root.mkdir()
    texts = list(odd_texts(24)) + [b"", b"\r" * 9 + b"\n", b"x" * 1200, "é".encode() * 700]
    want = {}
    for i, raw in enumerate(texts):
        for suffix in ("md", "txt"):
            (root / f"f{i}.{suffix}").write_bytes(raw)
            want[f"f{i}.{suffix}"] = plain(raw, suffix == "md")
    got = {}
    for r in parse.parse_files(read_workspace(spark, str(root))).collect():
        if r["error"]:
            got[r["name"]] = r["error"].removeprefix("Failed to parse file: ")
        elif r["content_preview"] == "[Binary content]":
            got[r["name"]] = r["content_preview"]
        else:
            d = r["details"]
            got[r["name"]] = (d["words"], d["lines"], d["headers"], r["content_preview"])
    assert got == want


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parse, "RANGE_BYTES", 1000)
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "large.txt").write_bytes(b"one two\n" * 4000)
    (row,) = parse.parse_files(read_workspace(spark, str(tmp_path / "tree"))).collect()
    assert (row["details"]["words"], row["details"]["lines"]) == (8000, 4001)
    files = read_workspace(spark, str(tmp_path / "tree"))
    ranged = parse.parse_files(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in ranged.lower() and "path" in ranged


# ------------------------------------------------------------ data source

@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree") / "ws")
    start = dt.datetime(2024, 1, 1)
    rows = [(f"{root}/d{i % 5}/e{i % 3}/f{i}.{['py', 'CSV', 'txt'][i % 3]}", "x" * i, start + dt.timedelta(hours=i))
            for i in range(200)]
    rows += [(f"{root}/{name}", "", start) for name in (".gitignore", "node_modules/a.py", "x.pyc", "_under.md", "flat")]
    rows += [(f"{root}/flat_dir/n{i:03d}.md", "# h\n", start) for i in range(150)]
    frame = spark.createDataFrame(rows, "path string, content string, modified timestamp_ntz")
    assert write_tree(frame) == len(rows)
    os.symlink(f"{root}/d0", f"{root}/link")
    datasource.register(spark)
    return root


COLUMNS = ["path", "name", "file_type", "modified", "size", "ignored", "suffix"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("options", [{}, {"minPartitions": 1}, {"minPartitions": 1000, "filesPerPartition": 10},
                                     {"includeIgnored": "true"}])
def test_data_source_lists_what_the_listing_lists(spark, tree, options):
    got = spark.read.format("workspace").options(**options).load(tree)
    want = read_workspace(spark, tree, includeIgnored="includeIgnored" in options)
    assert rows_of(got) == rows_of(want) and got.count() > 300


def test_filters_reach_the_reader(spark, tree):
    at = lambda h: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)).cast("timestamp_ntz")
    files = spark.read.format("workspace").load(tree)
    some = files.where((F.col("modified") >= at(24)) & (F.col("modified") <= at(60))
                       & F.col("path").startswith(f"{tree}/d1/") & (F.col("size") > 30))
    plan = some._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    (pushed,) = [line for line in plan.split("\n") if "PushedFilters" in line]
    assert "GreaterThanOrEqual(modified" in pushed and "LessThanOrEqual(modified" in pushed
    assert "StringStartsWith(path" in pushed and "size" not in pushed
    want = [r for r in rows_of(read_workspace(spark, tree)) if r[0].startswith(f"{tree}/d1/") and r[4] > 30
            and dt.timedelta(hours=24) <= r[3] - dt.datetime(2024, 1, 1) <= dt.timedelta(hours=60)]
    assert rows_of(some) == want and want


def test_reader_opens_no_directory_outside_the_prefix(tree, monkeypatch):
    from pyspark.sql.datasource import StringStartsWith
    reader = datasource.WorkspaceReader({"path": tree, "minPartitions": "3"})
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{tree}/d1/e")])) == []
    opened = []
    entries = datasource._entries
    monkeypatch.setattr(datasource, "_entries", lambda d: opened.append(d) or entries(d))
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert len(rows) == 40 and all(r[0].startswith(f"{tree}/d1/e") for r in rows)
    assert set(opened) <= {tree, f"{tree}/d1", *(f"{tree}/d1/e{k}" for k in range(3))}


def test_missing_root_is_an_error(spark, tree):
    with pytest.raises(Exception, match="does not exist"):
        spark.read.format("workspace").load(tree + "/none").count()


# ------------------------------------------------------------ observed counters

def test_counters_are_seen_as_the_inventory_is_written(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"/ws/{'__pycache__/' if i % 7 == 0 else ''}f{i}{'.pyc' if i % 5 == 0 else '.py'}", i,
             start + dt.timedelta(hours=i)) for i in range(100)]
    files = spark.createDataFrame(rows, "path string, size bigint, modified timestamp_ntz")
    lo, hi = start + dt.timedelta(hours=10), start + dt.timedelta(hours=60)
    stage, seen = scan.observed_inventory(files, lo, hi, "/ws")
    plain_counters = scan.scan_counters(files, lo, hi, "/ws").first()
    assert (seen["scanned"], seen["ignored"], seen["changed"]) == tuple(plain_counters)
    assert stage.count() == seen["changed"] and stage.agg(F.sum("size")).first()[0] == seen["bytes"]
    assert stage.columns == scan.inventory(files, "/ws").columns
    empty, none = scan.observed_inventory(files.limit(0), lo, hi, "/ws")
    assert empty.count() == 0 and set(none.values()) == {0}


def test_observed_stages_count_what_they_write(spark):
    stage, seen = materialize_observed(spark.range(1000), "n", rows=F.count("*"), total=F.sum("id"))
    assert stage.count() == 1000 and seen == {"rows": 1000, "total": 499500}
