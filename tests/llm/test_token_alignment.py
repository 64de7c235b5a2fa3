"""Alignment of two tokenizers against byte ranges of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from helpers import ROWS, awkward, empty, rows_of
from quarry.llm import queries, token_alignment
from quarry.llm.queries import BYTE_MODEL, tokenizer_path

PARTS = ["a", "b", "th", "e ", "the", " ", "  ", "   ", " " * 7, " " * 15, "é", "漢", "😀", "\n", "\t", "s", "ing",
         "er", "1", "23", "<s>", "aaaa", "un", "\x00", "日本", "<|endoftext|>", "'s", " ", " ", "　",
         "\x85", "\x1c", "\r\n", "\n ", "!?", "ñ", "́", "<0x41>", "don't", "İ"]


@pytest.fixture(scope="module")
def sides():
    return token_alignment.ByteSide(tokenizer_path(BYTE_MODEL)), token_alignment.PieceSide(tokenizer_path())


def brute(sides, text):
    """ids, byte ends, links and groups of a whole text, or None."""
    a, b = sides
    if not text:
        return None
    ids = (a.model.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text))
    parts = [[side.bytes[i] for i in some] for side, some in zip(sides, ids)]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    starts = [[0, *e[:-1]] for e in ends]
    links = [(ids[0][i], ids[1][j]) for i in range(len(ids[0])) for j in range(len(ids[1]))
             if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
    groups, lo = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([x for x, e in zip(some, end) if lo < e <= cut] for some, end in zip(ids, ends)))
        lo = cut
    return ids, ends, links, groups


def digest(groups):
    listed = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return hashlib.sha256(listed.encode()).hexdigest()


def expected(sides, rows):
    """The contract's row of every document."""
    found = [brute(sides, text) for _, text in rows]
    total = Counter()
    for f in found:
        total.update(f[2] if f else [])
    top = defaultdict(int)
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    out = Counter()
    for (doc, _), f in zip(rows, found):
        if f is None:
            out[(doc, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        ids, _, links, groups = f
        out[(doc, len(ids[0]), len(ids[1]), len(groups), len(links),
             sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), digest(groups))] += 1
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


def test_spans_are_exact_byte_ranges(sides):
    for text in random_texts(400, 1):
        found = brute(sides, text)
        if found is None:
            continue
        full = " " + text
        raw = full.encode()
        byte_at = None if raw.isascii() else np.append(
            np.cumsum([0] + [len(c.encode()) for c in full])[:-1], len(raw))
        for side, ids, ends in zip(sides, found[0], found[1]):
            got_ids, got_ends = side.spans(full, byte_at)
            assert got_ids.tolist() == ids and got_ends.tolist() == ends, (text, side)


def test_chunks_are_encoded_like_the_whole_text(sides):
    for text in random_texts(400, 2) + ["▁", "a ▁b", " ", "a ", " a", "x\n", "x \n y"]:
        found = brute(sides, text)
        block = token_alignment.Block(*sides, "x")
        block.add(1, text)
        row = block.part()
        assert row["digests"] == [digest(found[3]) if found else ""], text
        assert row["n_links"].tolist() == [len(found[2]) if found else 0]


def test_a_byte_level_letter_for_each_byte():
    letters = token_alignment.byte_letters()
    assert sorted(letters.values()) == list(range(256)) and letters["Ġ"] == 32 and letters["Ċ"] == 10


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_alignment.check_bytes(tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("part_chars, block_chars, table_chars", [
    (1, 1, 1), (200, 10 ** 9, 10 ** 9), (1, 500, 10 ** 9), (60, 10 ** 9, 300), (10 ** 9, 10 ** 9, 10 ** 9)])
def test_blocks_of_any_size_give_the_same_rows(sides, part_chars, block_chars, table_chars, monkeypatch):
    """Parts and tables of any sizes, as a task makes them, against whole texts."""
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", block_chars)
    monkeypatch.setattr(token_alignment, "TABLE_CHARS", table_chars)
    texts = random_texts(120, 3) + ["the same text"] * 20
    blocks, block = [], None
    for i, text in enumerate(texts):
        block = block or token_alignment.Block(*sides, "x")
        block.add(i, text)
        if block.part_chars >= part_chars or i == len(texts) - 1:
            blocks.append(block.part())
            if block.full() or i == len(texts) - 1:
                blocks.append(block.table())
                block = None
    total, got = Counter(), {}
    for row in blocks:
        if "pairs" in row:
            total.update({(int(p) >> 20, int(p) & (1 << 20) - 1): int(n)
                          for p, n in zip(row["pairs"], row["links"]) if n})
        else:
            got |= {i: (a, d) for i, a, d in zip(row["ids"], row["n_links"].tolist(), row["digests"])}
    want = Counter()
    for i, text in enumerate(texts):
        found = brute(sides, text)
        want.update(found[2] if found else [])
        assert got[i] == ((len(found[2]), digest(found[3])) if found else (0, ""))
    assert total == want


@pytest.mark.parametrize("part_chars", [1, 200, 1 << 30])
def test_parts_of_any_size_give_the_same_rows(spark, sides, part_chars):
    rows = [(i, t) for i, t in enumerate(random_texts(150, 3) + ["the same text"] * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = rows_of(token_alignment.token_alignment(docs, tokenizer_path(BYTE_MODEL), tokenizer_path(),
                                                  part_chars=part_chars))
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == expected(sides, rows)


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_any_size_give_the_same_rows(spark, sides, piece):
    rows = [(i, t) for i, t in enumerate(random_texts(60, 4) + ["", "one two " * 40])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = rows_of(token_alignment.token_alignment(docs, tokenizer_path(BYTE_MODEL), tokenizer_path(),
                                                  part_chars=1000, piece=piece))
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == expected(sides, rows)


def test_rows_of_a_block_do_not_grow_with_it(spark):
    """Neither by long texts and large tables, nor by many empty texts."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long)], "doc_id bigint, text string").coalesce(1)
    paths = tokenizer_path(BYTE_MODEL), tokenizer_path()
    blocks = token_alignment.aligned_blocks(docs, *paths).toArrow()
    lists = [f.name for f in blocks.schema if f.name not in ("block", "part", "piece")]

    def longest(blocks):
        return max(len(v) for name in lists for v in blocks[name].to_pylist() if v is not None)

    assert longest(blocks) <= 1 << 15
    assert sum(len(v) for v in blocks["words"].to_pylist() if v) == 120_000
    none = spark.range(40_000).selectExpr("id AS doc_id", "'' AS text").coalesce(1)
    blocks = token_alignment.aligned_blocks(none, *paths, part_chars=100_000).toArrow()
    assert longest(blocks) <= 2_000 and sum(len(v) for v in blocks["ids"].to_pylist() if v) == 40_000


def test_row_groups_of_the_stage_are_small(spark, monkeypatch):
    """A scan holds a row group at once."""
    import pyarrow.dataset as ds
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(150_000)) for _ in range(6)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id bigint, text string").coalesce(1)
    kept = []
    real = token_alignment.materialize
    monkeypatch.setattr(token_alignment, "materialize", lambda *a: kept.append(real(*a)) or kept[-1])
    token_alignment.token_alignment(docs, tokenizer_path(BYTE_MODEL), tokenizer_path())
    files = [f.removeprefix("file://") for f in kept[0].inputFiles()]
    sizes = [g.total_byte_size for f in ds.dataset(files).get_fragments() for g in f.row_groups]
    assert max(sizes) <= 5 << 20 < sum(sizes), sizes


def test_rows_with_awkward_texts(spark, sides):
    rows = [r if len(r[1] or "") < 5000 else (r[0], r[1][:3000], *r[2:]) for r in ROWS]
    docs = awkward(spark, rows)
    paths = tokenizer_path(BYTE_MODEL), tokenizer_path()
    got = rows_of(token_alignment.token_alignment(docs, *paths))
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == expected(sides, [r[:2] for r in rows])
    groups = rows_of(token_alignment.aligned_groups(docs, *paths))
    want = Counter()
    for doc, text, *_ in rows:
        found = brute(sides, text)
        want[(doc, str([tuple(g) for g in found[3]]) if found else "[]")] += 1
    assert Counter((r["doc_id"], str([(g["a"], g["b"]) for g in r["groups"]])) for r in groups) == want
    assert token_alignment.token_alignment(empty(spark), *paths).count() == 0
    assert token_alignment.aligned_groups(empty(spark), *paths).count() == 0


def test_query_on_documents(spark, sides):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in rows_of(queries.op13_token_alignment(spark, SF_SMALL))}
    assert len(got) == len(docs)
    a, b = sides
    total, per_doc = Counter(), {}
    for doc, text in docs:
        ids = (np.array(a.model.encode(" " + text, add_special_tokens=False).ids), np.array(b.model.encode(text)))
        ends = [np.cumsum(side.lengths[i]) for side, i in zip(sides, ids)]
        if not text or any(b"".join(side.bytes[i] for i in some) != (" " + text).encode()
                           for side, some in zip(sides, ids)):
            per_doc[doc] = []
            continue
        cuts = np.union1d(*ends)
        per_doc[doc] = list(zip(*(i[np.searchsorted(e, cuts)].tolist() for i, e in zip(ids, ends))))
        total.update(per_doc[doc])
        r = got[doc]
        assert (r["n_a"], r["n_b"], r["n_groups"]) == (*map(len, ids), len(np.intersect1d(*ends)))
    top = defaultdict(int)
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    for doc, links in per_doc.items():
        r = got[doc]
        assert r["n_links"] == len(links) and r["count_sum"] == sum(total[x] for x in links)
        assert r["n_best"] == sum(total[x] == top[x[1]] for x in links)
