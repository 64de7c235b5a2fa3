"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Sizes: words of each document, summed per source.
2. Targets: sources by code point (null last) get the weights of
   ``WEIGHTS`` in turn as shares of all words; a target stops at ``MOST``
   times its source's size and the excess is shared again by weight until no
   target is above. In closed form: with the sources ordered by cap per unit
   of weight, the first m are capped for the smallest m whose remaining budget
   per unit of weight no longer exceeds the next cap.
3. Blocks: the budget is cut into blocks of ``BLOCK`` words. Sainte-Lague
   gives every source an integer number of blocks by the highest quotients
   target / (2 s + 1), and every source's blocks to its shards by
   shard words / (2 s + 1).
4. Selection: a shard's documents stand in seeded order and their words are
   cut into equal blocks. A quota of q of n blocks takes every block q div n
   times and q mod n more blocks, consecutive (cyclically) from a seeded one,
   so that nearly all documents are taken whole.

Apportionment ranks only the last seats: the divisor of a final allocation
lies within half a seat per party of the plain quota, so each party's seats
below that range are certain and at most two or three per party compete.

Shards: a source has between 1 and ``SHARDS`` shards of some 64 blocks each,
and more when a shard would hold more than ``SHARD_WORDS`` words, so no task
holds a source. Only (key, size, order) rows are shuffled, never texts.

Defined cases: a null or blank text has size 0 and is never taken; a null
source is a source of its own, the last; a source without words has target 0;
rows that repeat id and text are documents of their own (equal rows may swap
their taken words); an empty table gives an empty result; other columns are
ignored. Quotient ties go to the source or shard that comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, key, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARDS = 64
SHARD_WORDS = 1 << 26
SEED = "mix-1"


def n_words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` to the same with place, target. One row per
    source stands in one window."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every)
    # what a unit of weight gets when exactly the sources before are capped
    level = ((F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    uncapped = F.col("level") * F.col("weight") <= F.col("cap")
    return (sources.withColumn("place", place).withColumn("weight", turn)
            .withColumn("cap", (F.col("source_size") * most).cast("double"))
            .withColumn("budget", budget).withColumn("level", level)
            # level only falls to the first source that stays below its cap
            .withColumn("final", F.min(F.when(uncapped, F.struct(
                F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"])
            .withColumn("target", F.coalesce(F.least("cap", F.col("final") * F.col("weight")),
                                             F.col("cap")))
            .select("source", "source_size", "place", "target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str,
                 order: str) -> DataFrame:
    """``parties`` with ``quota``: the group's ``seats`` (equal in the rows of
    a group) apportioned by highest quotients votes / (2 s + 1)."""
    whole = Window.partitionBy(*group)
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    spread = (F.col("_parties") / 2 + 1) / F.greatest(n, F.lit(1.0))
    share = F.when(F.col("_votes") > 0, v / F.col("_votes") * n).otherwise(F.lit(0.0))
    ranged = (parties
              .withColumn("_votes", F.sum(v).over(whole))
              .withColumn("_parties", F.sum(F.when(v > 0, 1).otherwise(0)).over(whole))
              .withColumn("_sure", F.greatest(F.lit(0), F.floor(share * (1 - spread) - 1))
                          .cast("bigint"))
              .withColumn("_most", F.when(v > 0, F.ceil(share * (1 + spread) + 1))
                          .otherwise(0).cast("bigint"))
              .withColumn("_open", n - F.sum("_sure").over(whole)))
    contest = (ranged.where("_most > _sure")
               .withColumn("_seat", F.explode(F.sequence("_sure", F.col("_most") - 1)))
               .withColumn("_rank", F.row_number().over(whole.orderBy(
                   (v / (2 * F.col("_seat") + 1)).desc(), order, "_seat")))
               .where("_rank <= _open").groupBy(*group, order).agg(F.count("*").alias("_won")))
    return (ranged.join(contest, [*group, order], "left")
            .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
            .drop("_votes", "_parties", "_sure", "_most", "_open", "_won"))


def _number(text: Column, at: int) -> Column:
    """28 bits of a hex digest."""
    return F.conv(F.substring(text, at, 7), 16, 10).cast("bigint")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", block: int = BLOCK, shards: int = SHARDS,
             shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: k, source, size, source_size, target, whole
    (times all words are taken), from_word, n_more, from_word_2, n_more_2 (up
    to two runs of words that are taken once more)."""
    sized = materialize(docs.select(
        key(id_col, text_col).alias("k"), docs[source_col].alias("source"),
        n_words(text_col).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("?"))))
        .alias("digest")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = materialize(
        sainte_lague(sources.withColumn("all_blocks", F.round(F.sum("target").over(every) / block)),
                     [], "target", "all_blocks", "place")
        .withColumn("n_shards", F.greatest(
            F.least(F.lit(shards), F.ceil(F.col("source_size") / (64 * block))),
            F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("bigint"))
        .select("place", "source", "source_size", "target", "quota", "n_shards"), "mix-sources")
    # one row per source, at most 8 bytes of counts and a name each: Spark's
    # own size estimate decides whether it is broadcast
    placed = (sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
              .select("k", sized["source"], "size", "digest", "place", "source_size", "target",
                      F.pmod(_number(F.col("digest"), 1), "n_shards").alias("shard"),
                      F.col("quota").alias("source_quota")))
    shard_rows = (placed.groupBy("place", "shard")
                  .agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota")))
    start = _number(F.md5(F.concat_ws(":", F.lit(seed), "place", "shard")), 1)
    shard_rows = materialize(
        sainte_lague(shard_rows, ["place"], "words", "source_quota", "shard")
        .withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("bigint"))
        .withColumn("quota", F.least("quota", MOST * F.col("n_blocks")))
        .withColumn("first", F.pmod(start, "n_blocks"))
        .select("place", "shard", "words", "quota", "n_blocks", "first"), "mix-shards")
    stream = Window.partitionBy("place", "shard").orderBy(
        F.substring("digest", 8, 25), "k")
    ends = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = lambda b: F.floor(b * F.col("words") / F.col("n_blocks"))
    last = F.col("first") + F.col("quota") % F.col("n_blocks")
    # the run [first, last) of blocks, split in two where it passes the end
    lo, hi = cut(F.col("first")), cut(F.least(last, F.col("n_blocks")))
    hi_2 = cut(F.greatest(last - F.col("n_blocks"), F.lit(0)))
    begin, end = F.col("ends") - F.col("size"), F.col("ends")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(begin, a))
    return (placed.withColumn("ends", ends).join(shard_rows, ["place", "shard"])
            .select("k", "source", "size", "source_size", "target",
                    F.floor(F.col("quota") / F.col("n_blocks")).alias("whole"),
                    F.greatest(F.lit(0), lo - begin).alias("from_word"),
                    overlap(lo, hi).alias("n_more"),
                    F.lit(0).cast("bigint").alias("from_word_2"),
                    overlap(F.lit(0), hi_2).alias("n_more_2")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", **params) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken."""
    plan = mix_plan(docs, id_col, text_col, source_col, **params)
    return plan.select(F.col("k.id").alias(id_col), "size", "source_size", "target",
                       (F.col("whole") * F.col("size") + F.col("n_more") + F.col("n_more_2"))
                       .cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **params) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every time a
    document is taken whole, and one for a run of its words where the
    selection ends inside it (white space between its words as it is)."""
    plan = mix_plan(docs, id_col, text_col, source_col, **params)
    copy = F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))
    plan = (plan.withColumn("copy", copy).where("whole > 0 OR n_more > 0 OR n_more_2 > 0")
            .select("k", "copy", "size", "whole", "from_word", "n_more", "from_word_2", "n_more_2"))
    held = (docs.select(F.struct("*").alias("d"), key(id_col, text_col).alias("k"))
            .select("d", "k", copy.alias("d_copy")))
    runs = F.filter(F.array_append(
        F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").alias("n")),
                       F.col("whole").cast("int")),
        F.struct(F.col("from_word").alias("a"), F.col("n_more").alias("n"))),
        lambda r: r["n"] > 0)
    second = F.filter(F.array(F.struct(F.col("from_word_2").alias("a"), F.col("n_more_2").alias("n"))),
                      lambda r: r["n"] > 0)
    text = F.col(f"d.`{text_col}`")
    # words with the white space behind them; the text's own when all are taken
    part = F.concat_ws("", F.slice(F.regexp_extract_all(text, F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), 0),
                                   (F.col("run.a") + 1).cast("int"), F.col("run.n").cast("int")))
    words = F.when(F.col("run.n") == F.col("size"), text).otherwise(part)
    cols = [words.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    # joined on the key alone, so that the texts move once; the copy number of
    # repeated rows is a condition on top
    return (held.join(plan, (held["k"] == plan["k"]) & (held["d_copy"] - plan["copy"] == 0))
            .withColumn("run", F.explode(F.concat(runs, second))).select(*cols))
