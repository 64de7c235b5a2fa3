"""Column functions agree with Python's string semantics (property tests:
many generated strings are checked in one Spark job)."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as TX

ALPHABET = (string.ascii_letters + " \t\n\r\x0b\x0c\x1c\x1d\x85\xa0#é  　 "
            "._-ü")
texts = st.lists(st.text(alphabet=ALPHABET, max_size=80), min_size=1, max_size=60)


def _py_header_count(s):
    return sum(1 for line in s.split("\n") if line.strip().startswith("#"))


def _py_suffix(name):
    i = name.rfind(".")
    return name[i:] if 0 < i < len(name) - 1 else ""


@settings(max_examples=15, deadline=None)
@given(texts)
def test_text_functions_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    norm = TX.normalize_newlines("t")
    rows = df.select("i", "t", norm.alias("n")).select(
        "i", "t", TX.word_count("n").alias("w"), TX.line_count("n").alias("l"),
        TX.header_count("n").alias("h"), TX.preview("n", 7).alias("p"),
        TX.file_suffix("t").alias("s")).collect()
    for r in rows:
        n = r.t.replace("\r\n", "\n").replace("\r", "\n")
        assert r.w == len(n.split()), (r.t,)
        assert r.l == len(n.split("\n"))
        assert r.h == _py_header_count(n), (r.t,)
        assert r.p == (n[:7] + "..." if len(n) > 7 else n)
        assert r.s == _py_suffix(r.t)


def test_rounding_and_iso(spark):
    df = spark.createDataFrame([(65536, 0.125, 0.25)], "b long, x double, k double")
    r = df.select(TX.round_half_even(F.col("b") / 1048576.0, 3).alias("mb"),
                  TX.format_2f("x").alias("f2"), TX.format_fixed("k", 1).alias("f1")).first()
    assert r.mb == round(65536 / 1048576, 3)
    assert r.f2 == f"{0.125:.2f}" and r.f1 == f"{0.25:.1f}"
    iso = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' a, "
                    "timestamp_ntz'2024-01-02 03:04:05.000120' b").select(
        TX.iso_timestamp("a").alias("a"), TX.iso_timestamp("b").alias("b")).first()
    assert iso.a == "2024-01-02T03:04:05" and iso.b == "2024-01-02T03:04:05.000120"


def test_session_settings_of_the_user_are_kept(spark):
    from quarry.session import DEFAULT_CONF, apply_conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "77")
    try:
        apply_conf(spark)
        assert spark.conf.get(name) == "77"
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set(name, DEFAULT_CONF[name])
