"""Token counts at every prefix against the tokenizer itself."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from helpers import LONG, ROWS, awkward, empty, rows_of
from quarry.llm import queries, sentencepiece_codec, token_counts
from quarry.llm.queries import tokenizer_path

PARTS = ["a", "b", "th", "e ", "the", " ", "  ", "   ", " " * 7, " " * 15, " " * 16, "é", "漢", "😀", "\n", "\t",
         "▁", "s", "ing", "er", "1", "23", "<s>", "</s>", "<0x41>", "aaaa", "un", "\x00", "日本", " "]


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.load_model(tokenizer_path())


@pytest.fixture(scope="module")
def counts():
    return token_counts.PrefixCounts(token_counts.Merges(tokenizer_path()))


def brute(model, text):
    return [len(model.encode(text[:i])) for i in range(len(text) + 1)]


def check(model, counts, text, budgets):
    want = brute(model, text)
    assert counts.prefixes(text).tolist() == want
    n, fit, at = counts.cut(text, budgets, budgets)
    assert n == want[-1] == counts.total(text)
    assert fit == [max(i for i, c in enumerate(want) if c <= b) for b in budgets]
    assert at == [want[min(b, len(text))] for b in budgets]


def test_every_prefix_has_the_tokenizer_s_count(model, counts):
    rng = random.Random(4)
    for k in range(400):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 25)))
        if k % 20 == 0:
            text = text.replace(" ", "") * 4  # longer than LONG_WORD
        check(model, counts, text, [rng.randint(0, len(text) + 2) for _ in range(4)])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40), st.lists(st.integers(0, 60), max_size=3))
def test_any_text(text, budgets):
    model = sentencepiece_codec.load_model(tokenizer_path())
    check(model, token_counts.worker_table(tokenizer_path()), text, budgets)


def test_counts_fall_from_a_prefix_to_the_next(counts):
    found = counts.prefixes("unbelievably international representations")
    assert (found[1:] < found[:-1]).any()


def test_full_tables_change_nothing(model):
    small = token_counts.PrefixCounts(token_counts.Merges(tokenizer_path()), max_prefixes=60, max_pairs=20)
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(rng.choices(PARTS, k=3)) for _ in range(6))
        check(model, small, text, [3, 9])
    assert len(small.states) <= 60 + token_counts.LONG_WORD and len(small.apart) <= 21


def test_long_texts_in_pieces_and_without_spaces(model, counts, monkeypatch):
    text = "".join(random.Random(6).choices("abcdefgh", k=60_000))
    assert counts.total(text) == len(model.encode(text))
    monkeypatch.setattr(sentencepiece_codec.pieces, "__defaults__", (50,))
    for text in (LONG[:700], "a  b " * 40, " " * 120, "z" * 130 + " tail "):
        check(model, counts, text, [0, 1, 20, 10 ** 6])


def test_rows_with_awkward_texts(spark, model):
    rows = ROWS + [(100 + i, p * 3, "en", "a", 1) for i, p in enumerate(PARTS)]
    got = rows_of(token_counts.token_counts(awkward(spark, rows), tokenizer_path(), budgets=[0, 5],
                                            places=[0, 4, 10 ** 9], with_prefixes=True))
    want = Counter()
    for doc, text, *_ in rows:
        text = text or ""
        tokens = brute(model, text) if len(text) < 5000 else None
        n = len(model.encode(text))
        want[(doc, len(text.encode()), n)] += 1
        if tokens:
            row = next(r for r in got if r["doc_id"] == doc and r["n_bytes"] == len(text.encode()))
            assert row["prefixes"] == tokens
            assert row["fit"] == [max(i for i, c in enumerate(tokens) if c <= b) for b in (0, 5)]
            assert row["at"] == [0, tokens[min(4, len(text))], n]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(empty(spark), tokenizer_path()).count() == 0


def test_query_on_documents(spark, model):
    got = {r["doc_id"]: r for r in rows_of(queries.op12_token_counts(spark, SF_SMALL))}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        n = len(model.encode(text or ""))
        r = got[doc]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 4096)
        if n > 4096:
            assert len(model.encode(text[:r["fit_chars"]])) <= 4096
            assert all(len(model.encode(text[:i])) > 4096
                       for i in range(r["fit_chars"] + 1, min(len(text), r["fit_chars"] + 20)))
        else:
            assert r["fit_chars"] == len(text or "")
