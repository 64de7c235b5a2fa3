"""Registered queries of the training-data operators: name -> (builder,
DuckDB text or None). Each applies its operator with production parameters to
its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (ann_forest, exact_dedup, html_extraction, line_dedup, mixing,
                        periodic_runs, quality, sentencepiece_codec, simhash_dedup,
                        token_alignment, token_counts, toxicity, url_filter)
from quarry.llm.common import WORD, table, text_or_empty
from quarry.plans.registry import Builder

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block",
             "org/fr/": "allow"}
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = PIECE_MODEL) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.sentencepiece_encode(
        table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.ann_search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where by h = crc32(doc_id) every tenth text repeats
    the p words from its word a on up to its end. A null id plants nothing."""
    h, n = F.col("h"), F.size("words")
    a = F.floor(h / 10) % n
    p = 1 + F.floor((n - a) / (3 + F.floor(h / 10) % 8))
    planted = F.expr("array_join(transform(sequence(0, size(words) - 1), "
                     "i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return (docs.select("doc_id", text_or_empty("text").alias("text"),
                        F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
            .withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
            .withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
            .select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = "concat(r.start, ',', r.length, ',', r.period, '\n')"
    return (found.withColumn("r", F.expr(
        "element_at(array_sort(runs, (x, y) -> CASE WHEN x.length != y.length THEN int(sign(y.length - x.length)) "
        "WHEN x.start != y.start THEN int(sign(x.start - y.start)) "
        "ELSE int(sign(x.period - y.period)) END), 1)"))
        .withColumn("r", F.when(F.size("runs") > 0, F.col("r")))
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period",
                F.expr("1000 * r.length div r.period").alias("exponent_milli"),
                F.sha2(F.array_join(F.expr(f"transform(runs, r -> {line})"), ""), 256).alias("runs_sha256"),
                F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fit_chars``: characters of the longest prefix within the limit."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(),
                                       budgets=[TOKEN_LIMIT])
    return counts.select("doc_id", "n_bytes", "n_tokens",
                         (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                         F.col("fit")[0].alias("fit_chars"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"),
                                           tokenizer_path(BYTE_MODEL), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity, exact dedup, near dedup, mixing and encoding in a row."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


OP9_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)"""

_RULE_SQL = """CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END"""


def _strength_sql(level: str) -> str:
    """Method-of-moments strength of a level that has n, bad and parent."""
    return f"""(SELECT CASE WHEN scale > 0 THEN greatest({url_filter.LEAST_STRENGTH},
        least({url_filter.MOST_STRENGTH}, CASE WHEN (ss - noise) / scale > 0
          THEN 1 / ((ss - noise) / scale) - 1 ELSE {url_filter.MOST_STRENGTH} END))
      ELSE {url_filter.LEAST_STRENGTH} END
    FROM (SELECT sum(n * (bad / n - parent) ** 2) AS ss, sum(parent * (1 - parent)) AS noise,
            sum((n - 1) * parent * (1 - parent)) AS scale FROM {level} WHERE n > 1))"""


OP1_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT *, {_RULE_SQL} AS rule FROM p),
h AS (
  SELECT host, CASE WHEN array_length(string_split(host, '.')) > 1
      THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain,
    string_split(host, '.')[-1] AS suffix, sum((rule IS NOT NULL)::INT)::DOUBLE AS n,
    sum((rule IN ('net/', 'example.com/de/') AND rule IS NOT NULL)::INT)::DOUBLE AS bad
  FROM j GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
s AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM s0) AS parent FROM s0),
sk AS (SELECT {_strength_sql('s')} AS k),
sm AS (SELECT suffix, (k * parent + bad) / (k + n) AS parent FROM s, sk),
dl AS (SELECT d.*, sm.parent FROM d JOIN sm USING (suffix)),
dk AS (SELECT {_strength_sql('dl')} AS k),
dm AS (SELECT domain, (k * parent + bad) / (k + n) AS parent FROM dl, dk),
hl AS (SELECT h.*, dm.parent FROM h JOIN dm USING (domain)),
hk AS (SELECT {_strength_sql('hl')} AS k),
ab AS (SELECT host, k * parent + bad AS a, k * (1 - parent) + n - bad AS b FROM hl, hk),
r AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {url_filter.Z}
    * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {url_filter.BAD_RATE} AS blocked FROM ab)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate
FROM j JOIN r USING (host)"""


def _sainte_lague_sql(parties: str, group: str, votes: str, seats: str, order: str) -> str:
    """(group, order, quota) by ranking every quotient up to a safe seat."""
    by = f"PARTITION BY {group}" if group else ""
    cols = f"{group}, {order}" if group else order
    return f"""SELECT {cols}, count(*) FILTER (WHERE rank <= seats) AS quota FROM (
      SELECT {cols}, {seats} AS seats,
        row_number() OVER ({by} ORDER BY {votes} / (2 * seat + 1) DESC, {order}, seat) AS rank
      FROM (SELECT *, unnest(range(0, least({seats},
          ceil({seats} * {votes} / (sum({votes}) OVER ({by}))) + count(*) OVER ({by}) + 1)::BIGINT)) AS seat
        FROM {parties} WHERE {votes} > 0)) GROUP BY ALL"""


OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '?')) AS digest FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
s1 AS (
  SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][((place - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE
    AS weight, ({mixing.MOST} * source_size)::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s1 WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (
  SELECT source, source_size, place, coalesce(least(cap, weight * (
    SELECT level FROM s2 WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1)), cap) AS target
  FROM s2),
s4 AS (SELECT *, round(sum(target) OVER () / {mixing.BLOCK})::BIGINT AS blocks FROM s3),
sq AS ({_sainte_lague_sql('s4', '', 'target', 'blocks', 'place')}),
s AS (
  SELECT s4.*, coalesce(quota, 0) AS source_quota, greatest(
      least({mixing.SHARDS}, ceil(source_size / {64 * mixing.BLOCK})),
      ceil(source_size / {mixing.SHARD_WORDS}), 1)::BIGINT AS n_shards
  FROM s4 LEFT JOIN sq USING (place)),
placed AS (
  SELECT doc_id, size, digest, s.*, ('0x' || substr(digest, 1, 7))::BIGINT % n_shards AS shard
  FROM sized JOIN s ON sized.source IS NOT DISTINCT FROM s.source),
h0 AS (
  SELECT place, shard, sum(size)::BIGINT AS words, any_value(source_quota)::BIGINT AS seats
  FROM placed GROUP BY ALL),
hq AS ({_sainte_lague_sql('h0', 'place', 'words', 'seats', 'shard')}),
h1 AS (SELECT *, greatest(1, round(words / {mixing.BLOCK}))::BIGINT AS n_blocks FROM h0),
h AS (
  SELECT h1.*, least(coalesce(quota, 0), {mixing.MOST} * n_blocks) AS quota,
    ('0x' || substr(md5('{mixing.SEED}:' || place || ':' || shard), 1, 7))::BIGINT % n_blocks AS first
  FROM h1 LEFT JOIN hq USING (place, shard)),
x AS (
  SELECT doc_id, size, source_size, target, quota, n_blocks,
    sum(size) OVER (PARTITION BY place, shard ORDER BY substr(digest, 8, 25), doc_id
      ROWS UNBOUNDED PRECEDING) AS ends,
    floor(first * words / n_blocks) AS lo,
    floor(least(first + quota % n_blocks, n_blocks) * words / n_blocks) AS hi,
    floor(greatest(first + quota % n_blocks - n_blocks, 0) * words / n_blocks) AS hi2
  FROM placed JOIN h USING (place, shard))
SELECT doc_id, size::BIGINT AS size, source_size, target, (quota // n_blocks * size
    + greatest(0, least(ends, hi) - greatest(ends - size, lo))
    + greatest(0, least(ends, hi2) - (ends - size)))::BIGINT AS taken
FROM x"""

OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
        string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, c:
      list_reduce(list_concat([xor(crc, c)], range(8)), lambda v, k:
        CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) AS h
  FROM documents),
e AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % len(w) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
g AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
      w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f),
t AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM g),
m AS (
  SELECT x.doc_id, y.i - x.i AS q, y.i FROM t x JOIN t y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {periodic_runs.REPEATS} * (y.i - x.i) <= x.n),
s AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
  GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest({periodic_runs.LEAST_WORDS}, {periodic_runs.REPEATS} * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
runs AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS longest
  FROM r GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM t
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period
      AND t.i < r.start + r.length) GROUP BY t.doc_id)
SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, longest.l AS length,
  longest.p AS period, 1000 * longest.l // longest.p AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUERIES: dict[str, tuple[Builder, str | None]] = {
    "op1_url_filters": (op1_url_filters, OP1_SQL),
    "op2_sentencepiece": (op2_sentencepiece, None),
    "op3_line_dedup": (op3_line_dedup, line_dedup.ORACLE),
    "op4_mix_sources": (op4_mix_sources, OP4_SQL),
    "op5_quality": (op5_quality, None),
    "op6_nearest_neighbours": (op6_nearest_neighbours, None),
    "op7_simhash_dedup": (op7_simhash_dedup, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_html_extraction": (op10_html_extraction, None),
    "op11_periodic_runs": (op11_periodic_runs, OP11_SQL),
    "op12_token_counts": (op12_token_counts, None),
    "op13_token_alignment": (op13_token_alignment, None),
    "pipeline": (pipeline, None),
}
