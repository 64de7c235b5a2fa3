"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a
block-max inverted index, distance-weighted votes, calibrated scores.

Terms are lower-cased words and word beginnings of 4 to 6 characters (so that
inflected forms meet). From a bounded sample of labelled documents (``SAMPLE``
per class, chosen by a hash of the id) every term that surely separates the
classes enters the space, however many there are (copies of a text counted
once; cut-offs ``SUPPORT``, ``EFFECT`` and ``SURE``; terms below them are noise
and lead to worse neighbours); their document frequencies are counted over all
documents. A constant term of weight ``BIAS`` lets a text without any term find
the examples without any.

The index holds the distinct example vectors in blocks of ``BLOCK``, with the
largest weight of each term in each block. A query adds these maxima to an
upper bound per block, visits blocks from the highest bound on, and stops when
the bound falls below the k-th similarity found: the neighbours are exact.
Neighbours vote with 1 / (distance + ``SOFT``) for the labels of all examples
behind their vector, until ``NEIGHBOURS`` examples have voted (examples at the
same similarity as the last one all vote). Votes are calibrated by a logistic
fit on leave-one-out votes; each document carries the ids of its nearest
examples as evidence.

Both passes over the documents are maps: nothing but one count per term and
task is shuffled. The model has a bound (the sample and its terms) and travels
with the tasks.

Defined cases: a null or blank text has no term and is scored like the
examples without terms; ids may be null or repeat; without labelled examples
of both classes every score is 0; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, materialize, python_ready, text_or_empty
from quarry.llm.labelled import held_out, labelled_sample

SAMPLE = 10_000
SUPPORT = 5
EFFECT = 2.0           # least log ratio of the document shares of a term
SURE = 4               # least z of their difference
PREFIXES = (4, 5, 6)
BIAS = 2.0
BLOCK = 32
GROUP = 8              # blocks scored at once
NEIGHBOURS = 15
SOFT = 0.05
EVIDENCE = 3
FOLDS, FOLD = 5, 0
_WORD = re.compile(r"\w+")


def terms(text: str) -> Counter:
    """All terms of a text: words and marked word beginnings."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        out[word] += n
        for size in PREFIXES:
            if len(word) >= size:
                out[word[:size] + "*"] += n
    return out


class Vocabulary:
    """The selected terms; counts them in a text without building the others."""

    def __init__(self, selected: list[str]):
        self.at = {t: i for i, t in enumerate(selected)}
        self.heads = {t.rstrip("*")[:PREFIXES[0]] for t in selected}

    def __len__(self) -> int:
        return len(self.at)

    def counts(self, text: str) -> tuple[tuple[int, int], ...]:
        """(term, count) pairs by term."""
        size, heads = PREFIXES[0], self.heads
        near = [w for w in _WORD.findall(text.lower()) if w[:size] in heads]
        if not near:
            return ()
        out: Counter = Counter()
        for word, n in Counter(near).items():
            forms = [word] + [word[:s] + "*" for s in PREFIXES if len(word) >= s]
            for form in forms:
                if form in self.at:
                    out[self.at[form]] += n
        return tuple(sorted(out.items()))


class BlockMaxIndex:
    """Exact top similarities over sparse unit vectors."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        lists: dict[int, dict[int, np.ndarray]] = {}
        for i, vector in enumerate(vectors):
            for term, weight in vector.items():
                postings = lists.setdefault(term, {})
                if i // block not in postings:
                    postings[i // block] = np.zeros(block)
                postings[i // block][i % block] = weight
        # term -> the blocks that hold it, its weights in each, the largest of each
        self.terms = {}
        for term, postings in lists.items():
            weights = np.stack(list(postings.values()))
            self.terms[term] = (np.array(list(postings)), weights, weights.max(axis=1))

    def search(self, query: dict[int, float], rows: np.ndarray,
               need: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities), nearest first and ties to the smaller
        example: the shortest list that ends at a similarity and on which
        ``rows`` sum up to ``need`` (all examples if they never do)."""
        known = [(self.terms[t], q) for t, q in query.items() if t in self.terms]
        bound = np.zeros(self.blocks)
        for (blocks, _, top), q in known:
            bound[blocks] += q * top
        order = np.argsort(-bound, kind="stable")
        at, sim, least = np.zeros(0, np.int64), np.zeros(0), -1.0
        for start in range(0, len(order), GROUP):
            group = order[start:start + GROUP]
            group = group[bound[group] >= least - 1e-9]
            if not len(group):
                break
            score = np.zeros((len(group), self.block))
            for (blocks, weights, _), q in known:
                j = np.minimum(np.searchsorted(blocks, group), len(blocks) - 1)
                hit = blocks[j] == group
                score[hit] += q * weights[j[hit]]
            i = (group[:, None] * self.block + np.arange(self.block)).ravel()
            s = np.round(score.ravel(), 12)
            near = (i < self.n) & (s >= least)
            at, sim = np.concatenate([at, i[near]]), np.concatenate([sim, s[near]])
            best = np.lexsort((at, -sim))
            at, sim = at[best], sim[best]
            k = int(np.searchsorted(np.cumsum(rows[at]), need))
            if k < len(at):
                least = sim[k]
                at, sim = at[sim >= least], sim[sim >= least]
        return at, sim


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    positive: np.ndarray      # weight of the positive examples behind a vector
    total: np.ndarray
    rows: np.ndarray          # examples behind a vector
    example: list             # least id of them
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: tuple) -> dict[int, float]:
        out = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts}
        out[-1] = BIAS
        norm = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / norm for t, w in out.items()}

    def vote(self, counts: tuple, without: tuple[int, int] | None = None) -> tuple[float, list]:
        """(share of the votes that are positive, neighbours); ``without``:
        a vector and label one example of which has no vote."""
        rows = self.rows
        if without:
            rows = rows.copy()
            rows[without[0]] -= 1
        near, sims = self.index.search(self.vector(counts), rows, NEIGHBOURS)
        weight = 1 / (np.maximum(0.0, 1 - sims) + SOFT)
        positive, total = self.positive[near], self.total[near]
        if without:
            own, one = near == without[0], self.weights[without[1]]
            positive, total = positive - one * without[1] * own, total - one * own
        every = float(weight @ total)
        return (float(weight @ positive) / every if every > 0 else 0.0), near.tolist()

    def raw(self, share: float) -> float:
        p = min(max(share, 0.005), 0.995)
        return math.log(p / (1 - p))

    def score(self, counts: tuple) -> tuple[float, list]:
        share, near = self.vote(counts)
        z = self.slope * self.raw(share) + self.shift
        return 1 / (1 + math.exp(-z)), [self.example[i] for i in near[:EVIDENCE]]

    weights: tuple = (1.0, 1.0)


def _signature(text: str) -> int:
    """Least hash of the three-word shingles: copies of a text mostly agree.
    Of a shorter text the hash of its words, so only the same words agree."""
    words = _WORD.findall(text.lower())
    if len(words) < 3:
        return zlib.crc32(" ".join(words).encode())
    return min(zlib.crc32(" ".join(w).encode()) for w in zip(words, words[1:], words[2:]))


def _unlike(sample: DataFrame) -> set:
    """Ids of the sample without the copies of a text within a class, so that
    the words of a much copied text do not pass for words of its class."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"],
                                "sig": [_signature(t) for t in batch["text"]]})

    id_type = sample.schema["id"].dataType.simpleString()
    rows = (sample.mapInPandas(sign, f"id {id_type}, y int, sig bigint")
            .groupBy("y", "sig").agg(F.min("id").alias("id")).collect())
    return {r["id"] for r in rows}


def _select(sample: DataFrame) -> list[str]:
    """The terms whose document shares differ surely between the classes
    (two-proportion z above ``SURE``), among those that ``SUPPORT`` documents
    hold and whose shares differ by ``EFFECT``; the surest first."""
    unlike = _unlike(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            docs = Counter()
            for key, y, text in zip(batch["id"], batch["y"], batch["text"]):
                if key in unlike:
                    seen[y].update(terms(text).keys())
                    docs[y] += 1
            rows = [(t, seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys()]
            # the empty term counts the documents themselves
            yield pd.DataFrame(rows + [("", docs[1], docs[0])], columns=["term", "n1", "n0"])

    counted = materialize(
        sample.select("id", "y", "text").mapInPandas(count, "term string, n1 bigint, n0 bigint")
        .groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where(F.col("n1") + F.col("n0") >= SUPPORT), "term-counts")
    whole = counted.where("term = ''").first()
    if not whole or not whole["n1"] or not whole["n0"]:
        return []
    n1, n0 = whole["n1"], whole["n0"]
    shared = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = ((F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(shared * (1 - shared) * (1 / n1 + 1 / n0)))
    ratio = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    found = (counted.where((F.col("term") != "") & (shared < 1) & (F.abs(ratio) >= EFFECT))
             .select("term", F.abs(z).alias("z")).where(F.col("z") > SURE)
             .orderBy(F.desc("z"), "term"))
    return [r["term"] for r in found.collect()]


def _document_counts(docs: DataFrame, text_col: str, vocabulary: Vocabulary) -> np.ndarray:
    """Documents that hold each term, and all documents at the end."""
    size = len(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for term, _ in vocabulary.counts(text):
                    df[term] += 1
            df[size] += len(batch)
        yield pd.DataFrame({"term": np.arange(size + 1), "n": df})

    rows = (docs.select(text_or_empty(text_col).alias("text"))
            .mapInPandas(count, "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(size + 1)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", sample_size: int = SAMPLE) -> ToxicityModel | None:
    """None without examples of both classes."""
    python_ready(docs)
    sample, totals = labelled_sample(docs, labels, label, ~held_out(id_col, FOLDS, FOLD),
                                     sample_size, id_col, text_col)
    vocabulary = Vocabulary(_select(sample))
    if not totals.get(0) or not totals.get(1):
        return None

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [vocabulary.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"],
                                "terms": [[t for t, _ in f] for f in found],
                                "counts": [[n for _, n in f] for f in found]})

    id_type = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInPandas(
        vectors, f"id {id_type}, y int, terms array<int>, counts array<int>").collect()
    taken = Counter(r["y"] for r in rows)
    if not taken[0] or not taken[1]:
        return None
    df = _document_counts(docs, text_col, vocabulary)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    # a class that is sampled more thinly weighs more for each example
    weights = (totals[0] / taken[0], totals[1] / taken[1])
    behind: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        counts = tuple(zip(r["terms"], r["counts"]))
        entry = behind.setdefault(counts, [r["id"], 0, 0])
        entry[1 + r["y"]] += 1
    # similar vectors share blocks: sorted by their terms
    distinct = sorted(behind)
    model = ToxicityModel(
        vocabulary, idf, BlockMaxIndex([]),
        np.array([behind[c][2] * weights[1] for c in distinct]),
        np.array([behind[c][1] * weights[0] + behind[c][2] * weights[1] for c in distinct]),
        np.array([behind[c][1] + behind[c][2] for c in distinct]),
        [behind[c][0] for c in distinct], weights=weights)
    model.index = BlockMaxIndex([model.vector(c) for c in distinct])
    _calibrate(model, distinct, [behind[c][1:] for c in distinct])
    return model


def _calibrate(model: ToxicityModel, distinct: list[tuple], classes: list) -> None:
    """Logistic fit of the labels on the logit of leave-one-out votes."""
    x, y, w = [], [], []
    for i, (counts, n) in enumerate(zip(distinct, classes)):
        for label in (0, 1):
            if n[label]:
                x.append(model.raw(model.vote(counts, (i, label))[0]))
                y.append(label)
                w.append(n[label] * model.weights[label])
    x, y, w = np.array(x), np.array(y), np.array(w)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + 0.1 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    # votes decide the order of scores; the fit only maps them
    model.slope, model.shift = (a, b) if a > 0 else (1.0, 0.0)


def _scores(model: ToxicityModel | None, texts: pd.Series, known: dict) -> list[tuple]:
    if model is None:
        return [(0.0, [])] * len(texts)
    out = []
    for text in texts:
        counts = model.vocabulary.counts(text)
        if counts not in known:
            if len(known) > 50_000:
                known.clear()
            known[counts] = model.score(counts)
        out.append(known[counts])
    return out


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id",
                    text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted, evidence_ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    python_ready(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            found = _scores(model, batch["text"], known)
            yield pd.DataFrame({"id": batch["id"], "score": [s for s, _ in found],
                                "evidence_ids": [e for _, e in found]})

    return (docs.select(id_as_text(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .mapInPandas(run, f"id string, score double, evidence_ids array<{id_type}>")
            .select(F.col("id").cast(id_type).alias(id_col), held_out("id", FOLDS, FOLD).alias("held_out"),
                    "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                    "evidence_ids"))


def toxicity_score(model: ToxicityModel | None, text: Column) -> Column:
    """The score as a column, to filter documents in place without a join."""
    known: dict = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([s for s, _ in _scores(model, texts, known)], dtype="float64")

    return score(F.coalesce(text, F.lit("")))
