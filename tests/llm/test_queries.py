"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from oracle_harness import compare, duck
from quarry.llm import sentencepiece_codec, toxicity
from quarry.llm.queries import QUERIES, tokenizer_path
from test_documents import SPACE, WORD, brute_components, brute_exact, brute_fingerprint, brute_targets


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_its_sql(spark, name):
    build, sql = QUERIES[name]
    problems, n = compare(build(spark, SF_SMALL), duck(SF_SMALL), sql)
    assert not problems and n > 0, problems


def test_all_queries_are_registered():
    import __spark_entry__ as E
    assert set(QUERIES) <= set(E.queries())
    assert {n for n, (_, sql) in QUERIES.items() if sql} <= set(E.oracle_sql())
    assert len([n for n in QUERIES if n.startswith("op")]) == 13


def test_run_returns_the_last_stage_and_keeps_only_its_table(spark):
    import os

    from quarry.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(out.columns)
    assert out.count() > 0
    (left,) = set(os.listdir(folder)) - before
    assert left.startswith("quarry-pipeline-sentencepiece")


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = docs.collect()
    out = {}
    df = docs
    from quarry.session import materialize
    for name, stage in corpus_pipeline.STAGES:
        df = materialize(stage(spark, df, SF_SMALL), name)
        out[name] = df
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
    # toxicity: exactly the documents that the operator scores low
    model = toxicity.train(docs, labels)
    low = {r["doc_id"] for r in toxicity.toxicity_scores(docs, model).where("predicted = 0").collect()}
    stage = out["toxicity"].collect()
    assert {r["doc_id"] for r in stage} == low and len(stage) == len([r for r in rows if r["doc_id"] in low])
    # exact copies
    got = out["exact_dedup"].collect()
    keep = {v[0] for v in brute_exact([(r["doc_id"], r["text"]) for r in stage]).values()}
    assert {r["doc_id"] for r in got} == keep and len(got) == len(keep)
    # near copies
    stage, got = got, out["simhash_dedup"].collect()
    roots = brute_components([brute_fingerprint(r["text"]) for r in stage])
    least = defaultdict(lambda: 1 << 60)
    for r, root in zip(stage, roots):
        least[root] = min(least[root], r["doc_id"])
    assert Counter(r["doc_id"] for r in got) == Counter(least.values())
    # the mix comes near its targets and cuts no word
    stage, got = got, out["mix_sources"].collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    texts = {r["doc_id"]: r["text"] for r in stage}
    for r in stage:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in got:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["text"].strip(SPACE) in texts[r["doc_id"]]
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= max(0.02 * t, 128)
    # ids of every text
    model = sentencepiece_codec.load_model(tokenizer_path())
    want = Counter((r["doc_id"], hashlib.sha256(",".join(map(str, model.encode(r["text"]))).encode())
                    .hexdigest()) for r in got)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in out["sentencepiece"].collect()) == want
