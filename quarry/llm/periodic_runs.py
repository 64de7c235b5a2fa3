"""Periodic runs of words, found online by a sparse diagonal table.

For every lag d the words i with ``word[i] == word[i - d]`` form diagonals; a
stretch of words has period d exactly where a diagonal of that lag covers it.
The words of a text are met in order. Each earlier occurrence of a word, at
lag d, adds to the match length of the active diagonal of that lag, and a
diagonal that has become long enough is measured and emitted at once.

A run repeats its period ``REPEATS`` times, so its diagonal holds at least
(REPEATS - 1) * d words. Lags are therefore kept by octaves: for lags in
[s, 2s), s a power of two, only every s-th word of the text updates the
diagonals, and a run's diagonal can not miss REPEATS - 1 updates in a row. A
word at place i so walks back through its earlier occurrences over fewer than
2 * (largest power of two in i) places: at most n updates per octave, n log n
in all, for any text (also for one word repeated n times). Only words whose
previous occurrence lies that near are looked at in Python.

A stretch of period d that is long enough and has a smaller period has its
smallest one, q, among the divisors of d and is the same stretch for both
lags: of equal stretches the smallest lag stays. As lag q meets its updates
earlier, the stretch has mostly been emitted with q by then, and updates of
multiples of q inside it are passed over without a measurement.

The work is a map over the rows without a shuffle; a text's words are kept as
numbers, its distinct words once, and it is split in pieces, so memory is a
small multiple of the longest text.

Defined cases: a null or blank text has no words, no runs and the empty text;
repeated rows and null ids each give their row; a text of any length is
treated whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, python_ready, text_or_empty

LEAST_WORDS = 6
REPEATS = 4
PIECE_BYTES = 4_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NEVER = -(1 << 60)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """Parts of a text, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def word_numbers(text: bytes, size: int = PIECE_BYTES) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word of a UTF-8 text, equal for equal words, and the
    distinct words by number."""
    numbers = defaultdict(count().__next__)
    parts = []
    for piece in _pieces(text, size):
        words = piece.split()  # of bytes: exactly the white space of the contracts
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)), list(numbers)


def _previous(ids: np.ndarray) -> np.ndarray:
    """Place of the previous occurrence of each word."""
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    prev = np.full(len(ids), _NEVER, np.int64)
    prev[order[1:][again]] = order[:-1][again]
    return prev


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at += step
        step *= 2
    return n


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS,
              repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period: maximal
    stretches with smallest period q of at least max(least, repeats * q) words."""
    if repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    n = len(ids)
    if n < max(least, repeats):
        return []
    prev = _previous(ids)
    places = np.arange(n)
    # lags that a word updates: octaves whose grid holds its place, and which fit into the text
    reach = np.minimum(2 * (places & -places), n // repeats + 1)
    met = np.flatnonzero(places - prev < reach)
    if not len(met):
        return []
    back, reach = prev.tolist(), reach[met].tolist()
    period: dict[tuple[int, int], int] = {}     # (start, length) of a run -> smallest lag
    open_runs: list[tuple[int, int, int]] = []  # (start, end, period), end ahead
    active: dict[int, tuple[int, int]] = {}     # lag -> last update, updates in a row
    measured: dict[int, int] = {}               # lag -> end of its last measured diagonal
    for i, top in zip(met.tolist(), reach, strict=True):
        j = back[i]
        while (d := i - j) < top:
            j = back[j]
            last, hits = active.get(d, (_NEVER, 0))
            hits = hits + 1 if last == i - (1 << (d.bit_length() - 1)) else 1
            active[d] = (i, hits)
            if hits < repeats - 1 or i < measured.get(d, 0):
                continue
            if any(s <= i - d and i < e and d % q == 0 for s, e, q in open_runs):
                continue
            first = i - _agree(ids[:i][::-1], ids[:i - d][::-1])
            end = i + _agree(ids[i:], ids[i - d:n - d])
            measured[d] = end
            if end - first + d >= max(least, repeats * d):
                stretch = (first - d, end - first + d)
                period[stretch] = min(d, period.get(stretch, d))
                open_runs = [r for r in open_runs if r[1] > i] + [(first - d, end, d)]
    return sorted(((s, m, q) for (s, m), q in period.items()), key=lambda r: (r[0], r[2]))


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def collapse(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text with one period of each run, its words joined by one space."""
    kept = ids[~repeated_words(len(ids), runs)] if runs else ids
    step = 1 << 20
    return b" ".join(b" ".join(map(words.__getitem__, kept[at:at + step].tolist()))
                     for at in range(0, len(kept), step))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """One row per document: id_col, n_words, ``runs`` (start, length and
    period of each, in words, by start and period) and ``collapsed``, the
    words without those that only repeat a run's first period."""
    python_ready(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ("id string, n_words bigint, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, texts = [], [], []
            for text in batch.column("text"):
                ids, words = word_numbers(text.as_py())
                runs = find_runs(ids, least, repeats)
                n_words.append(len(ids))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                texts.append(collapse(ids, words, runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(found, _RUNS),
                 pa.array(texts, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    return (docs.select(id_as_text(id_col).alias("id"),
                        text_or_empty(text_col).cast("binary").alias("text"))
            .mapInArrow(run, schema)
            .select(F.col("id").cast(id_type).alias(id_col), "n_words", "runs",
                    F.col("collapsed").cast("string").alias("collapsed")))
