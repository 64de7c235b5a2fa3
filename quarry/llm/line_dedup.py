"""Line deduplication by winnowing over line hashes, DataFrame functions only.

The lines of a document that are not blank (trimmed) form a sequence. Its
windows are its pieces of ``MIN_LINES`` lines, and the shorter ones of at
least ``MIN_WORDS`` words. Steps:

1. Winnowing: each window selects its least line hash (the leftmost). Only the
   selected lines are written, one row each, with the windows that selected
   it (as 128 bits of content) and the hashes of the lines around it. Equal
   windows select the same line, so a run that repeats and fills a window is
   guaranteed a common fingerprint.
2. Fingerprints are counted over the corpus with map-side partial sums; only
   selected lines whose hash is selected at more than one place go on. Text
   that stands nowhere else ends here.
3. Positions are joined: each window of a selected line meets the first
   position (by id, null last, then by place) of the same window.
4. Matches are extended both ways, line by line, from the selected line, as
   far as the lines around both positions agree. Selected lines of a run are
   at most ``MIN_LINES`` apart and see ``MIN_LINES - 1`` lines to either side,
   so the extended matches of a run touch and merge into the whole run.
5. The merged runs of the later positions are deleted.

Every line of a run of ``MIN_LINES`` lines or ``MIN_WORDS`` words that has
stood earlier is deleted, and no other line, whichever partners a run has
(the first position of a window decides, not that of a line); no pair of later
positions is ever formed. A window that overlaps the first position in the
same document is no copy. Texts of documents that lose lines move once,
when the deletions join them (a bitmap finds them); all others pass without a
shuffle. Hot fingerprints and windows meet pre-aggregated tables, and adaptive
execution can split their rows. None of these tables has a bound, so none is
broadcast, at any size (merge hints). The work on a document is linear in its
lines.

Defined cases: a null text counts as empty; blank lines are no part of a run
and stay; rows that repeat id and text are one document and get the same
result; an empty table gives an empty result; other columns are ignored or
(``drop_repeated_lines``) passed through unread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import (WHITESPACE, WORD, key, key_filter, materialize, text_or_empty,
                               with_filter)

MIN_LINES = 3
MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(WHITESPACE))


def selected_lines(docs: DataFrame, id_col: str, text_col: str, min_lines: int,
                   min_words: int) -> DataFrame:
    """k, at (number among the lines that are not blank), mark (its hash),
    around (hashes of the lines from ``at - min_lines + 1`` on, null outside)
    and windows (lines before and behind ``at``, content) of every line that
    some window selects."""
    kept = F.filter(F.transform(_lines(text_or_empty(text_col)), _trim), lambda x: x != "")
    words = lambda x: F.regexp_count(x, F.lit(WORD))
    arrays = docs.select(key(id_col, text_col).alias("k"), kept.alias("lines")).select(
        "k", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(x, F.lit(1))).alias("b"),
        F.transform("lines", words).alias("n"))
    span = min_lines - 1

    def window(at: Column, before: int, behind: int) -> Column:
        """The window, null if it is none or selects another line."""
        here = lambda name, j: F.get(name, at + j)
        ends = [here("a", j) for j in range(-before, behind + 1)]
        full = reduce(lambda s, x: s & x.isNotNull(), ends, F.lit(True))
        if before + behind < span:
            full &= reduce(lambda s, j: s + here("n", j), range(1 - before, behind + 1),
                           here("n", -before)) >= min_words
        least = reduce(lambda s, j: s & ((here("a", j) > here("a", 0)) if j < 0 else (here("a", j) >= here("a", 0))),
                       [j for j in range(-before, behind + 1) if j], F.lit(True))
        return F.when(full & least, F.struct(
            F.lit(before).alias("before"), F.lit(behind).alias("behind"),
            F.xxhash64(*ends).alias("w1"),
            F.xxhash64(*[here("b", j) for j in range(-before, behind + 1)]).alias("w2")))

    def line(at: Column) -> Column:
        return F.struct(
            at.alias("at"), F.get("a", at).alias("mark"),
            F.array(*(F.get("a", at + j) for j in range(-span, span + 1))).alias("around"),
            F.array_compact(F.array(*(window(at, i, j) for i in range(min_lines)
                                      for j in range(min_lines - i)))).alias("windows"))

    every = F.when(F.size("a") > 0, F.sequence(F.lit(0), F.size("a") - 1))
    return (arrays.select("k", F.explode(F.filter(F.transform(every, line), lambda x: F.size(x["windows"]) > 0))
                          .alias("x")).select("k", "x.*"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """k, spans: per document with deletions the (start, end) ranges of lines
    that go, in order and apart."""
    found = materialize(selected_lines(docs, id_col, text_col, min_lines, min_words), "line-minima")
    # equal places are told apart from others by least and greatest
    place = F.struct(F.col("k.id").isNull(), "k", "at")
    marks = materialize(
        found.groupBy("mark").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
        .where("lo != hi").select("mark"), "line-marks")
    # a bitmap leaves out most of the others before anything moves
    some = with_filter(found, key_filter(marks, "mark"), "mark").where("hit").drop("hit")
    met = materialize(
        some.join(marks.hint("merge"), "mark")
        .select("k", "at", "around", F.explode("windows").alias("w")).select("k", "at", "around", "w.*"),
        "line-matches")
    start, end = F.col("at") - F.col("before"), F.col("at") + F.col("behind")
    position = F.struct(F.col("k.id").isNull().alias("no_id"), "k", start.alias("start"), end.alias("end"), "around")
    firsts = materialize(
        met.groupBy("w1", "w2").agg(F.min(position).alias("first"), F.max(position).alias("last"))
        .where("first != last").select("w1", "w2", "first"), "line-firsts")
    later = (F.col("k") != F.col("first.k")) | (start > F.col("first.end"))
    return merged(met.join(firsts.hint("merge"), ["w1", "w2"]).where(later)
                  .select("k", *extended(min_lines - 1)))


def extended(span: int) -> tuple[Column, Column]:
    """First and last line of a match, from its selected line outwards as far
    as the lines around it are those around the first position."""
    def agreeing(step: int) -> Column:
        reach, run = F.lit(0), F.lit(True)
        for j in range(1, span + 1):
            at = F.lit(span + step * j)
            run = run & F.coalesce(F.get("around", at) == F.get("first.around", at), F.lit(False))
            reach = reach + run.cast("int")
        return reach
    return ((F.col("at") - agreeing(-1)).alias("start"), (F.col("at") + agreeing(1)).alias("end"))


def merged(matches: DataFrame) -> DataFrame:
    """k and its runs: matches that overlap or touch, as one."""
    # equal matches first: a hot document brings each of its lines once
    matches = matches.groupBy("k", "start").agg(F.max("end").alias("end"))
    by_start = Window.partitionBy("k").orderBy("start")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    return (matches.withColumn("opens", F.coalesce(F.col("start") > before + 1, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("opens").over(by_start))
            .groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its columns, ``text_col`` without the deleted lines, and
    the columns lines, lines_deleted (lines that are not blank)."""
    spans = materialize(repeated_lines(docs, id_col, text_col, min_lines, min_words), "line-spans")
    text = text_or_empty(f"d.{text_col}")
    blank = lambda x: _trim(x) == ""
    whole = F.size(F.filter(_lines(text), lambda x: ~blank(x)))
    some = F.col("spans").isNotNull()
    counts = lambda n, gone: (n.cast("bigint").alias("lines"), gone.cast("bigint").alias("lines_deleted"))
    cols = lambda kept: [kept.alias(c) if c == text_col else F.col(f"d.`{c}`")
                         for c in docs.columns]
    # the lines up to each run (behind the one before it), then the blank lines inside it
    full = F.filter(F.transform("parts", lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())

    def piece(j: Column) -> Column:
        here, past = F.get("spans", j), F.get("spans", j - 1)
        start = F.coalesce(F.get("full", past["end"]) + 1, F.lit(0))
        stop = F.coalesce(F.get("full", here["start"]), F.size("parts"))
        last = F.coalesce(F.get("full", here["end"]) + 1, F.size("parts"))
        return F.concat(F.slice("parts", start + 1, stop - start),
                        F.filter(F.slice("parts", stop + 1, last - stop), blank))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), piece))
    gone = F.aggregate("spans", F.lit(0), lambda s, r: s + r["end"] - r["start"] + 1)
    marked = with_filter(docs.select(F.struct("*").alias("d"), key(id_col, text_col).alias("k")),
                         key_filter(spans, "k"), "k")
    # only documents that lose lines move to meet their spans
    same = marked.where("NOT hit").select(*cols(text), *counts(whole, F.lit(0)))
    met = (marked.where("hit").join(spans.hint("merge"), "k", "left")
           .withColumn("parts", _lines(text)).withColumn("full", full)
           .select(*cols(F.when(some, F.array_join(kept, "\n")).otherwise(text)),
                   *counts(F.size("full"), F.when(some, gone).otherwise(0))))
    return same.unionByName(met)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id_col, lines, lines_deleted, n_chars, text_sha256
    of the text that stays."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (drop_repeated_lines(plain, "id", "text", min_lines, min_words)
            .select(F.col("id").alias(id_col), "lines", "lines_deleted",
                    F.length("text").cast("bigint").alias("n_chars"),
                    F.sha2("text", 256).alias("text_sha256")))


ORACLE = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents),
raw AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM cut),
lines AS (
  SELECT doc_id, line, n, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM raw),
seq AS (
  SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM lines WHERE t <> ''),
next AS (
  SELECT doc_id, i, t, w, lead(t) OVER d AS t1, lead(w) OVER d AS w1, lead(t, 2) OVER d AS t2
  FROM seq WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
win AS (
  SELECT doc_id, i, i AS e, t AS content FROM next WHERE w >= {MIN_WORDS}
  UNION ALL SELECT doc_id, i, i + 1, t || chr(10) || t1 FROM next WHERE w + w1 >= {MIN_WORDS}
  UNION ALL SELECT doc_id, i, i + 2, t || chr(10) || t1 || chr(10) || t2 FROM next WHERE t2 IS NOT NULL),
first AS (
  SELECT *, first_value(doc_id) OVER c AS fd, first_value(e) OVER c AS fe FROM win
  WINDOW c AS (PARTITION BY content ORDER BY doc_id, i)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i
  FROM first WHERE doc_id <> fd OR i > fe),
marked AS (
  SELECT l.doc_id, l.n, l.line, s.i IS NOT NULL AS counted, g.i IS NOT NULL AS gone
  FROM lines l LEFT JOIN seq s ON l.doc_id = s.doc_id AND l.n = s.n
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i),
kept AS (
  SELECT doc_id, sum(counted::INT) AS lines, sum(gone::INT) AS lines_deleted,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, lines::BIGINT AS lines, lines_deleted::BIGINT AS lines_deleted,
  length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256
FROM kept"""
