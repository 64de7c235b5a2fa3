"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import LONG, ROWS, WORD, awkward, empty, rows_of
from quarry.llm import periodic_runs, queries


def brute_runs(words, least=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = q
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(least, repeats * q) and i > first:
                found.setdefault((first - q, i - first + q), q)
            i += i == first
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 1), (3, 9), (5, 6)])
def test_runs_are_those_of_every_lag(repeats, least):
    rng = random.Random(repeats)
    for _ in range(1500):
        n, kinds = rng.randint(0, 80), rng.choice([1, 2, 3, 6])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n + 1), rng.randint(1, n // 3 + 1)
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        got = periodic_runs.find_runs(np.array(words, np.int32), least, repeats)
        assert got == brute_runs(words, least, repeats), words


def test_long_texts_stay_near_linear(monkeypatch):
    measured = []
    agree = periodic_runs._agree
    monkeypatch.setattr(periodic_runs, "_agree", lambda a, b: measured.append(1) or agree(a, b))
    n = 60_000
    assert periodic_runs.find_runs(np.zeros(n, np.int32)) == [(0, n, 1)]
    assert len(measured) == 2  # one diagonal, both ways: multiples of its lag are passed over
    assert len(periodic_runs.find_runs(np.arange(n, dtype=np.int32) // 6)) == n // 6


def test_pieces_of_a_text_have_its_words():
    for text in (LONG, " a b\tc \n d", "", " ", "one", "é  ü\x0b\x0cñ a b c"):
        want = [w.encode() for w in WORD.findall(text)]
        for size in (1, 3, 7, 1000, 1 << 20):
            ids, words = periodic_runs.word_numbers(text.encode(), size)
            assert [words[i] for i in ids] == want


def test_rows_with_awkward_texts(spark):
    extra = [(100, "a b " * 50, "en", "a", 1), (101, "x y z " * 3 + "x y", "en", "a", 1),
             (102, "go go go go go", "en", "a", 1), (103, "go go go go go go stop", "en", "a", 1),
             (104, "a b a b a b a b c a b c a b c a b c", "en", "a", 1)]
    rows = ROWS + extra
    got = rows_of(periodic_runs.periodic_runs(awkward(spark, rows)))
    want = Counter()
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words) if len(words) < 1000 else []
        want[(doc, len(words), tuple(runs), brute_collapse(words, runs))] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]),
                    r["collapsed"]) for r in got) == want
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_query_of_planted_runs(spark, tmp_path):
    rows = ROWS + [(200 + i, " ".join(f"w{j % (i + 3)}v{j}" for j in range(5 * i)), "en", "a", 1)
                   for i in range(60)]
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.op11_periodic_runs(spark, str(tmp_path)))
    want = Counter()
    for doc, text, *_ in rows:
        words = planted(doc, text)
        runs = brute_runs(words) if len(words) < 1000 else []
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[(doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
              hashlib.sha256(listed.encode()).hexdigest(),
              hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest())] += 1
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert sum(r["n_runs"] for r in got) > 3
