"""Report documents and their conformance to the schema."""

import datetime as dt
import json
import random

from quarry.fixed import REPORT_SCHEMA
from quarry.operators.tickets import TICKET_SCHEMA
from quarry.plans import conformance as C
from quarry.plans import documents as D
from quarry.plans import report as R
from test_workspace import whole_documents

DAY = dt.datetime(2024, 1, 1)


def files(spark, n=300):
    """Code that parses and code that does not, notes, data, and some large files."""
    rows = []
    for i in range(n):
        kind = i % 5
        name = [f"m{i}.py", f"bad{i}.py", f"n \"{i}\".md", f"d{i}.bin", f"ü{i}.txt"][kind]
        text = ["x = 1\n", "def (:\n", "# head\n\ttab \\ back", "raw", "line\r\nnext \x01"][kind]
        rows.append((f"/ws/{i % 7}/{name}", text, 20 * (i % 50), DAY + dt.timedelta(hours=i)))
    rows.append(rows[3])  # a path that repeats
    return spark.createDataFrame(rows, "path string, content string, size bigint, modified timestamp_ntz")


def tickets(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    ctx = ("Ann", None, None, None, "q \"x\"", "Pager", None, None, None, None)
    rows = [("all", "/ws", None, None, True, True, ctx), ("again", "/ws", None, None, True, True, None),
            ("week/1", "/ws", day(0), day(3), False, True, None), ("none", "/ws", day(90), day(91), False, True, None),
            ("undated", "/ws", None, day(1), False, True, None), (None, "/ws", day(0), day(1), False, True, None),
            (None, None, day(0), day(1), False, True, None), ("007", "/ws", day(0), day(0), False, False, None)]
    return spark.createDataFrame(rows, TICKET_SCHEMA)


def written(spark, folder, monkeypatch, tasks=None):
    from quarry.operators import aggregate, scan
    monkeypatch.setattr(aggregate, "LARGE_FILE_BYTES", 700)
    run = R.prepare(scan.inventory(files(spark), "/ws"), tickets(spark))
    lines = D.document_lines(run, R.build_reports(run, "2024-03-01T09:00:00", lists=False))
    D.write_documents(lines, folder)
    return run, lines


def test_documents_have_every_record(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "documents")
    run, _ = written(spark, folder, monkeypatch)
    docs = whole_documents(folder)
    assert sorted(k[0] for k in docs) == ["007", "again", "all", "none", "undated", "unknown", "unknown", "week/1"]
    want = sorted((r["path"], r["name"], r["size"], r["success"]) for r in run.parsed.collect())
    for (task, _), doc in docs.items():
        assert doc["task_id"] == task
        if doc["status"] == "error":
            assert "results" not in doc and doc["errors"] == [doc["message"].removeprefix("Task failed: ")]
            continue
        end = {"all": 10 ** 9, "again": 10 ** 9, "week/1": 72, "none": -1, "007": 0}[task]
        place = lambda p: int("".join(c for c in p.rsplit("/", 1)[1] if c.isdigit()))
        some = [w for w in want if place(w[0]) <= end]
        assert [(f["path"], f["name"], f["size_bytes"]) for f in doc["results"]["files"]] == [w[:3] for w in some]
        assert [e.split(":")[0] for e in doc["errors"]] == [w[1] for w in some if not w[3]]
        large = [w[1] for w in some if w[2] > 700]
        assert [x for warning in doc["warnings"] for x in warning["affected_files"]] == large
        assert bool(large) == bool(doc["warnings"])
        assert doc["results"]["statistics"]["files_processed"] == len(some)


def test_read_back_documents_are_the_written_ones(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "documents")
    written(spark, folder, monkeypatch)
    want = whole_documents(folder)
    found = {}
    for r in D.read_documents(spark, folder).collect():
        found.setdefault((r["task_id"], r["ticket"]), {}).setdefault(r["part"], []).append(json.loads(r["document"]))
    assert set(found) == set(want)
    for key, parts in found.items():
        doc = want[key]
        assert len(parts[""]) == 1
        if doc["status"] == "success":
            assert sorted(f["path"] for f in parts.get("results.files[]", [])) == \
                [f["path"] for f in doc["results"]["files"]]
            assert sorted(parts.get("errors[]", [])) == sorted(doc["errors"])
            doc["results"]["files"], doc["errors"] = [], []
            for warning in doc["warnings"]:
                assert sorted(parts["warnings[].affected_files[]"]) == sorted(warning["affected_files"])
                warning["affected_files"] = []
        assert parts[""] == [doc]


def test_a_document_of_many_tasks_is_one_text(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "documents")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",
                                           "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        run, lines = written(spark, folder, monkeypatch)
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    (large,) = (tmp_path / "documents").glob("task_id=all/ticket=*")
    assert len(list(large.glob("part-*"))) > 3
    doc = next(d for (task, _), d in whole_documents(folder).items() if task == "all")
    assert [f["path"] for f in doc["results"]["files"]] == sorted(r["path"] for r in run.parsed.collect())
    # lists are streamed: what is collected per scope are the bounded first-N lists only
    assert "error_messages" not in plan and "collect_list(struct(path" not in plan.replace(" ", "")


def test_written_documents_conform(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "documents")
    written(spark, folder, monkeypatch)
    got = {(r["task_id"], r["path"], r["rule"], r["value"])
           for r in D.stored_violations(D.read_documents(spark, folder), REPORT_SCHEMA).collect()}
    assert got == {("all", "context.request.channel", "enum", "Pager")} | {
        (task, path, "required", None) for task in ("undated", "unknown")
        for path in ("results", "metadata.reply_agent_compatible")}


# ------------------------------------------------------------ any schema, any document

def kind(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "integer" if x == int(x) else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def brute(schema, x, path=""):
    below = lambda n: f"{path}.{n}".lstrip(".")
    types = schema.get("type", kind(x))
    types = [types] if isinstance(types, str) else types
    k = kind(x)
    if k not in types and not (k == "integer" and "number" in types):
        return [(path, "type", k)]
    out = [(path, "enum", str(x))] if "enum" in schema and x not in schema["enum"] else []
    if k == "object":
        out += [(below(n), "required", None) for n in schema.get("required", ()) if n not in x]
        for n, v in x.items():
            if n in schema.get("properties", {}):
                out += brute(schema["properties"][n], v, below(n))
            elif isinstance(schema.get("additionalProperties"), dict):
                out += brute(schema["additionalProperties"], v, below("*"))
    if k == "array" and "items" in schema:
        for v in x:
            out += brute(schema["items"], v, path + "[]")
    return out


def sample(schema, rng):
    if rng.random() < 0.05:
        return rng.choice([None, 1, 1.5, 2.0, 1e300, 10 ** 30, "x", "", True, [], {}, [1, "a", [None]], {"q": 1}])
    t = schema.get("type")
    t = rng.choice(t) if isinstance(t, (list, tuple)) else t
    if "enum" in schema:
        return rng.choice([*schema["enum"], "it's"])
    if t == "object":
        doc = {n: sample(s, rng) for n, s in schema.get("properties", {}).items() if rng.random() < 0.93}
        if isinstance(schema.get("additionalProperties"), dict):
            doc |= {n: sample(schema["additionalProperties"], rng) for n in ("code", "no's", "ü \"") if rng.random() < 0.5}
        return doc | ({"extra": 1} if rng.random() < 0.1 else {})
    if t == "array":
        return [sample(schema.get("items", {}), rng) for _ in range(rng.randint(0, 3))]
    return {"string": "s", "integer": 3, "number": 2.5, "boolean": False, "null": None, None: 1}[t]


OTHER = {"type": "object", "required": ["a"], "properties": {
    "a": {"type": "array", "items": {"type": "array", "items": {"type": ["integer", "null"]}}},
    "no's": {"enum": [1, "1", None, True, "it's"]}, "c.d": {"type": "object", "required": ["x y"]}},
    "additionalProperties": {"type": "object", "properties": {"n": {"type": "number"}}}}


def test_violations_are_those_of_a_plain_walk(spark):
    for schema, seed in ((REPORT_SCHEMA, 1), (OTHER, 2)):
        rng = random.Random(seed)
        texts = [json.dumps(sample(schema, rng)) for _ in range(200)]
        texts += ["{bad", None, "null", "[]", '"x"', "3", "", " "]
        got = sorted((r["i"], r["path"], r["rule"], str(r["value"])) for r in C.violations(
            spark.createDataFrame(list(enumerate(texts)), "i int, document string"), schema).collect())
        want = []
        for i, text in enumerate(texts):
            try:
                doc = json.loads(text)
            except (TypeError, ValueError):
                want.append((i, "", "json", "None"))
                continue
            want += [(i, p, r, str(v)) for p, r, v in brute(schema, doc)]
        plain = lambda rows: sorted(r if r[2] != "enum" else (*r[:3], "") for r in rows)
        assert plain(got) == plain(want)


def test_rules_name_all_required_fields():
    required = [p for p, rule, _ in C.rules(REPORT_SCHEMA) if rule == "required"]
    assert len(required) == 28 and "results.files" in required and "suggested_actions[].example" in required
    assert C.subschema(REPORT_SCHEMA, "results.files[]")["required"] == ["path", "name", "type", "analysis"]
    assert C.subschema(REPORT_SCHEMA, "results.breakdown_by_type.code.count") == {"type": "integer"}
