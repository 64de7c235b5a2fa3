"""Trained operators: held-out accuracy, exact neighbours, defined cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from helpers import ROWS, awkward, empty, rows_of
from quarry.llm import ann_forest, quality, toxicity


def tables(spark):
    return (spark.read.parquet(f"{SF_CHECK}/documents.parquet"),
            spark.read.parquet(f"{SF_CHECK}/labels.parquet"))


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.train(*tables(spark))


@pytest.fixture(scope="module")
def quality_model(spark):
    return quality.train(*tables(spark))


def test_toxicity_on_held_out_documents(spark, toxic_model):
    docs, labels = tables(spark)
    got = toxicity.toxicity_scores(docs, toxic_model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) >= 0.95
    clean = [r for r in got if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in clean]) <= 0.02
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_column_agrees_with_scores(spark, toxic_model):
    docs, _ = tables(spark)
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, toxic_model).collect()}
    low = docs.where(toxicity.toxicity_score(toxic_model, F.col("text")) < 0.5)
    assert {r["doc_id"] for r in low.select("doc_id").collect()} == {d for d, p in scores.items() if not p}


def test_toxicity_awkward_rows(spark, toxic_model):
    got = rows_of(toxicity.toxicity_scores(awkward(spark), toxic_model))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    blank = {r["score"] for r in got if r["doc_id"] in (4, 5, 6)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert toxicity.toxicity_scores(empty(spark), toxic_model).count() == 0


def test_without_labels_every_score_is_defined(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = awkward(spark)
    assert {r["score"] for r in toxicity.toxicity_scores(
        docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in quality.quality_scores(
        docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (7, None, None)], none.schema)
    assert toxicity.train(docs, one) is None and quality.train(docs, one) is None


def test_every_term_that_separates_the_classes_is_indexed(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("bdfgklmnprstvz"), n))
    insults, plain = [word(8) for _ in range(120)], [word(7) for _ in range(2000)]
    dealt = np.concatenate([rng.permutation(insults) for _ in range(24)]).reshape(720, 4)  # each in 24 texts
    rows = [(i, " ".join([*rng.choice(plain, 12), *(dealt[i] if i < 720 else [])])) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id < 720) AS toxic"))
    assert len(model.vocabulary) > 256
    assert set(insults) <= set(model.vocabulary.at)
    found = toxicity._scores(model, [f"{plain[i]} {w} {plain[i + 1]}" for i, w in enumerate(insults)], {})
    assert all(score >= 0.5 for score, _ in found)
    assert all(score < 0.5 for score, _ in toxicity._scores(model, [" ".join(plain[i:i + 9]) for i in range(50)], {}))


def test_only_the_same_words_are_copies_of_a_short_text(spark):
    rows = [(1, 1, "foo"), (2, 1, "bar"), (3, 1, "foo bar"), (4, 1, "Foo!"), (5, 0, "foo"), (6, 0, ""), (7, 0, " ")]
    assert toxicity._unlike(spark.createDataFrame(rows, "id bigint, y int, text string")) == {1, 2, 3, 5, 6}


def test_insults_of_short_texts_are_terms(spark):
    rows = [(i, f"plain words number {i} here" if i % 4 else f"zorg v{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 4 = 0) AS toxic"))
    assert "zorg" in model.vocabulary.at


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(400):
        terms = rng.choice(30, rng.integers(1, 6), replace=False)
        v = {int(t): float(w) for t, w in zip(terms, rng.random(len(terms)) + 0.1)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / norm for t, w in v.items()})
    vectors += vectors[:20]  # ties
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for q in vectors[::37]:
        near, sims = index.search(q, np.ones(len(vectors)), 7)
        all_ = sorted(((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), -i)
                       for i, v in enumerate(vectors)), reverse=True)
        floor = all_[6][0]
        assert near.tolist() == [-i for s, i in all_ if s >= floor]
        assert sims.tolist() == [s for s, _ in all_ if s >= floor]


def test_quality_on_held_out_documents(spark, quality_model):
    docs, labels = tables(spark)
    got = quality.quality_scores(docs, quality_model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95


def test_quality_awkward_rows(spark, quality_model):
    got = rows_of(quality.quality_scores(awkward(spark), quality_model))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert quality.quality_scores(empty(spark), quality_model).count() == 0


def test_pair_loss_orders_separable_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0.8).astype(int)
    model = quality.fit(x, y, {0: int((y == 0).sum()), 1: int(y.sum())})
    assert np.mean((model.score(x) >= quality.THRESHOLD) == y) > 0.97


def labelled_rows(docs, labels):
    """Features and labels of all training rows, by brute force."""
    rows = (docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
            .select("text", "quality").collect())
    return np.array([quality.features(r["text"]) for r in rows]), np.array([r["quality"] for r in rows])


def pair_gradient(model, x, y):
    """Gradient of the loss over every pair of a good and a bad row."""
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    miss = 1 / (1 + np.exp((good @ model.weight)[:, None] - (bad @ model.weight)[None, :]))
    return (miss.sum(axis=0) @ bad - miss.sum(axis=1) @ good) / miss.size + quality.RIDGE * model.weight


def test_quality_is_learnt_from_all_pairs(spark, quality_model):
    x, y = labelled_rows(*tables(spark))
    assert np.abs(pair_gradient(quality_model, x, y)).max() < 1e-6


def test_quality_is_learnt_from_every_labelled_document(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(16_000):  # some 10,800 good training rows, and a bad one in ten
        good = bool(rng.random() < 0.9)
        words = rng.choice(["Alpha", "beta,", "gamma", "delta.", "EPSILON", "zeta!!", "<eta>", "42"],
                           rng.integers(4, 40), p=np.array([2, 2, 4, 2, 1, 1, 1, 1] if good else
                                                           [2, 1, 3, 1, 2, 2, 2, 1]) / 14)
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
        if i % 500 == 0:
            rows.append((i, " ".join(words[::-1]) + " more"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    x, y = labelled_rows(docs, labels)
    assert (y == 1).sum() > 10_000
    model = quality.train(docs, labels)
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-6, atol=1e-9)
    assert np.abs(pair_gradient(model, x, y)).max() < 1e-6
    u, bad = np.sort(model.utility(x)), int((y == 0).sum())
    assert model.threshold == (u[bad - 1] + u[bad]) / 2
    here = quality.fit(x, y, {0: bad, 1: len(y) - bad})
    assert np.allclose(here.weight, model.weight, atol=1e-5) and here.slope == pytest.approx(model.slope, rel=1e-4)


def test_ranks_are_those_of_the_sorted_utilities():
    rng = np.random.default_rng(3)
    u = np.concatenate([rng.normal(size=300), np.zeros(40), -np.zeros(40), rng.normal(size=50) * 1e-12, [2.5] * 30])
    whole = lambda kernel, width: quality._add({}, *kernel(u, np.zeros(len(u))))
    order = np.sort(u)
    for rank in (1, 2, 150, 171, 200, 230, 300, 430, 431, 460):
        assert quality._ranked(whole, lambda x: x, (rank, min(rank + 1, len(u)))) == [
            order[rank - 1], order[min(rank, len(u) - 1)]]


def test_text_of_control_characters_has_a_score(spark, quality_model):
    docs = spark.createDataFrame([(1, "\x01"), (2, "\x02 \x03")], "doc_id bigint, text string")
    got = rows_of(quality.quality_scores(docs, quality_model))
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_query_takes_features_once_and_agrees(spark, quality_model):
    docs, labels = tables(spark)
    want = {r["doc_id"]: r for r in rows_of(quality.quality_scores(docs, quality_model))}
    got = rows_of(quality.quality(docs, labels))
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert r["held_out"] == w["held_out"] and r["score"] == pytest.approx(w["score"], abs=1e-6)
    got = rows_of(quality.quality(awkward(spark), labels))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert quality.quality(empty(spark), labels).count() == 0


# ------------------------------------------------------------- nearest neighbours

def brute_neighbours(ids, x, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        order = [(-round(float(score[j]), 12), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i]]
        out[int(ids[i])] = sorted(order)[:k]
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = vectors.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], np.float64)
    want = brute_neighbours(ids, x)
    got = rows_of(ann_forest.ann_search(vectors, F.col("id") % 50 == 0))
    assert Counter(r["query_id"] for r in got) == {q: 5 for q in want}
    hits = sum((-round(r["score"], 12), r["vec_id"]) in want[r["query_id"]] for r in got)
    assert hits / len(got) >= 0.9
    place = {int(i): n for n, i in enumerate(ids)}
    for r in got:
        a, b = x[place[r["query_id"]]], x[place[r["vec_id"]]]
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_vector_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [None, 1.0]),
            (250, [1.0]), (300, []), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]),
            (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]),
            (350, [float("inf"), 0.0]), (400, [-1.0, 0.0])]
    rows += [(1000 + i, [2.0, 0.0]) for i in range(1, 40)]
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows],
                               "vec_id bigint, embedding array<float>, label int, point int")
    got = rows_of(ann_forest.ann_search(df, F.col("id") % 50 == 0))
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert set(by) == {0, 400}
    assert by[0] == [(1, 1.0), (2, 1.0), (3, 1.0), (1001, 1.0), (1002, 1.0)]
    none = spark.createDataFrame([], df.schema)
    assert ann_forest.ann_search(none, F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in rows_of(
        ann_forest.ann_search(few, F.col("id") % 50 == 0))] == [(1, 1)]
