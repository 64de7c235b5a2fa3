"""Document operators against brute force, with nulls, repeats and empty tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from conftest import SF_SMALL
from helpers import LONG, PARA, ROWS, WORD, awkward, empty, rows_of
from quarry.llm import exact_dedup, line_dedup, mixing, sentencepiece_codec, simhash_dedup
from quarry.llm.queries import tokenizer_path

SPACE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------- exact dedup

def brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text, *_) in enumerate(rows):
        norm = (text or "").translate({ord(c): None for c in SPACE})
        groups[norm].append((-len(text or ""), doc is None, doc or 0, i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out[m[3]] = (rows[keep[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_dedup_matches_brute_force(spark):
    want = brute_exact(ROWS)
    got = rows_of(exact_dedup.exact_dedup(awkward(spark)))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == \
        Counter((ROWS[i][0], *v) for i, v in want.items())
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({v[2] for v in want.values()})


def test_exact_dedup_stage_keeps_one_row_of_each_text(spark):
    docs = awkward(spark)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    norms = [(r["text"] or "").translate({ord(c): None for c in SPACE}) for r in rows_of(out)]
    assert len(norms) == len(set(norms)) == len({v[2] for v in brute_exact(ROWS).values()})
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = [(i, "copy of one text" if i % 3 else f"text {i}", "en", "a", 1) for i in range(600)]
    got = rows_of(exact_dedup.exact_dedup(awkward(spark, rows)))
    assert sum(r["kept"] for r in got) == 201
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] % 3} == {(1, 400)}


# ------------------------------------------------------------- simhash

def brute_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    roots = brute_components(fps)
    least = {}
    for r, root in zip(ROWS, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = Counter((r[0], f"{fp:016x}", least.get(root)) for r, fp, root in zip(ROWS, fps, roots))
    got = rows_of(simhash_dedup.simhash_dedup(awkward(spark)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash_dedup.simhash_dedup(empty(spark)).count() == 0


def test_simhash_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    # variants of one text with a word changed at its end make chains of near copies
    base = next(t for _, t in rows if t and 400 < len(t.split()) < 700)
    rows += [(10_000 + i, base + f" extra{i}") for i in range(40)]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = defaultdict(lambda: 1 << 60)
    for (doc, _), root in zip(rows, roots):
        least[root] = min(least[root], doc)
    got = simhash_dedup.simhash_dedup(
        spark.createDataFrame(rows, "doc_id bigint, text string"), radius=3)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(got)} == \
        {(doc, f"{fp:016x}", least[root]) for (doc, _), fp, root in zip(rows, fps, roots)}


def test_tiles_of_any_size_find_the_same_components(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(s) for s in seeds}
    for s in seeds[:15]:  # chains: each step flips two bits of the one before
        x = int(s)
        for _ in range(12):
            for b in rng.choice(63, 2, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for tile in (4, 64, 4096):
        from quarry.llm.components import components
        roots = {r["node"]: r["root"] for r in components(simhash_dedup.links(df, 3, tile)).collect()}
        got = [roots.get(f, f) for f in fps]
        assert [fps[w] for w in want] == got


def test_forest_of_a_dense_group_is_small():
    base = np.uint64(0x0123456789ABCDEF)
    group = np.array(sorted({base ^ np.uint64(1 << i) for i in range(64)} | {base}), np.uint64)
    found = simhash_dedup.forest(group, group, 3)
    assert len(found) == len(group) - 1


def test_near_copy_stage_keeps_one_row_of_each_component(spark):
    docs = awkward(spark)
    out = simhash_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    roots = brute_components([brute_fingerprint(r[1]) for r in ROWS])
    assert out.count() == len(set(roots))


# ------------------------------------------------------------- sentencepiece

@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.load_model(tokenizer_path())


def test_encoding_is_the_library_s(spark, model):
    odd = ["  two  spaces ", "▁ mark ▁▁x▁", "tab\tnew\nline", "日本語 テスト 😀", "\x00 zero", "<s> </s> <unk>",
           " ", "   ", "\u00a0\u3000 wide", "é e\u0301", "a" * 5000]
    rows = ROWS + [(100 + i, t, "en", "a", 1) for i, t in enumerate(odd)]
    got = rows_of(sentencepiece_codec.sentencepiece_encode(awkward(spark, rows), tokenizer_path()))
    assert len(got) == len(rows)

    def digest(doc, text):
        ids = model.encode(text or "")
        return (doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(model.decode(ids).encode()).hexdigest(), tuple(ids))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]))
                   for r in got) == Counter(digest(r[0], r[1]) for r in rows)
    assert sentencepiece_codec.sentencepiece_encode(empty(spark), tokenizer_path()).count() == 0


def test_full_table_changes_nothing(model):
    texts = [f"word{i} same other{i % 7}  gap {LONG[:200]}" for i in range(300)]
    small = sentencepiece_codec.ChunkTable(model, max_chars=500)
    got = [x for i in range(0, 300, 10) for x in small.encode(texts[i:i + 10])]
    assert [g[0] for g in got] == [",".join(map(str, i)) for i in model.encode(texts)]


def test_pieces_of_a_long_text_have_its_chunks(model):
    rng = np.random.default_rng(2)
    parts = [" ", "  ", "   ", "a", "the", "▁", "long" * 9, "é", "\n", " x", "y "]
    table = sentencepiece_codec.ChunkTable(model)
    for _ in range(300):
        text = "".join(rng.choice(parts, rng.integers(1, 60)))
        whole = table.chunks(text)
        for size in (1, 2, 5, 17, 40):
            cut = [c for p in sentencepiece_codec.pieces(text, size) for c in table.chunks(p)]
            assert cut == whole, (text, size)


def test_long_text_in_pieces_encodes_like_the_whole(model, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "GROUP_CHARS", 50)
    monkeypatch.setattr(sentencepiece_codec.pieces, "__defaults__", (50,))
    texts = ["", "short", LONG[:3000], " " * 120, "z" * 130 + " tail ", "a  b " * 40, ""]
    table = sentencepiece_codec.ChunkTable(model)
    rows = [r for group in sentencepiece_codec.encode_rows(table, list(range(7)), texts, True)
            for r in group]
    for (_, n, ids_sha, text_sha, got), text in zip(rows, texts):
        ids = model.encode(text)
        assert got.tolist() == ids and n == len(ids)
        assert ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert text_sha == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_models_whose_pieces_cross_markers_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(tokenizer_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[500].piece = "of▁the"
    path = tmp_path / "crossing.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        sentencepiece_codec.check_model(str(path))


# ------------------------------------------------------------- mixing

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: float(most * sizes[s]) for s in over})
        open_ -= over
    return target


def test_mix_targets_and_takes(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 400)), "en", s, 1) for i, s in
            enumerate(["tiny"] * 2 + ["mid"] * 60 + ["big"] * 300 + [None] * 20 + ["É"] * 40)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    want = brute_targets(sizes)
    docs = awkward(spark, rows)
    got = rows_of(mixing.mix_sources(docs))
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    taken = defaultdict(int)
    for r in rows:
        g = by_id[r[0]]
        assert g["size"] == len(WORD.findall(r[1])) and g["source_size"] == sizes[r[3]]
        assert g["target"] == pytest.approx(want[r[3]], rel=1e-9)
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[r[3]] += g["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 2 * mixing.BLOCK)
    assert Counter((r["doc_id"], r["taken"]) for r in rows_of(mixing.mix_sources(docs.repartition(5)))) \
        == Counter((r["doc_id"], r["taken"]) for r in got)
    # the mix itself holds exactly the words taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in rows_of(mixed):
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert dict(words) == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def brute_sainte_lague(votes, seats):
    won = Counter()
    for _ in range(seats):
        won[max(sorted(votes), key=lambda p: votes[p] / (2 * won[p] + 1))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_matches_seat_by_seat(spark, seed):
    rng = np.random.default_rng(seed)
    votes = {p: float(v) for p, v in enumerate(rng.pareto(0.7, 23) * 100)}
    votes[3] = votes[7] = 50.0
    votes[5] = 0.0
    seats = int(rng.integers(1, 400))
    df = spark.createDataFrame([("g", p, v, seats) for p, v in votes.items()],
                               "g string, p int, v double, n int")
    got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "v", "n", "p").collect()}
    want = brute_sainte_lague(votes, seats)
    assert got == {p: want[p] for p in votes}


def test_mix_awkward_rows(spark):
    got = rows_of(mixing.mix_sources(awkward(spark)))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


# ------------------------------------------------------------- line dedup

def brute_lines(rows, min_lines=3, min_words=50):
    """Per row: (lines, deleted, text that stays)."""
    seqs = {}
    for r in rows:
        parts = (r[1] or "").split("\n")
        seqs[(r[0] is None, r[0] or 0, r[1] or "")] = [
            (n, p.strip(SPACE)) for n, p in enumerate(parts) if p.strip(SPACE)]
    first, gone = {}, defaultdict(set)
    for key in sorted(seqs, key=lambda k: (k[0], k[1], xxhash.xxh64_intdigest(k[2].encode(), 42))):
        seq = [t for _, t in seqs[key]]
        for i in range(len(seq)):
            for end in range(i, min(i + min_lines, len(seq))):
                words = sum(len(WORD.findall(t)) for t in seq[i:end + 1])
                if words >= min_words or end - i + 1 == min_lines:
                    at = first.setdefault(tuple(seq[i:end + 1]), (key, i, end))
                    if at[0] != key or i > at[2]:
                        gone[key].update(range(i, end + 1))
    out = []
    for r in rows:
        key = (r[0] is None, r[0] or 0, r[1] or "")
        drop = {seqs[key][i][0] for i in gone[key]}
        kept = "\n".join(p for n, p in enumerate((r[1] or "").split("\n")) if n not in drop)
        out.append((r[0], len(seqs[key]), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_line_dedup_matches_brute_force(spark):
    rows = ROWS + [(50 + i, f"own {i}\n" + PARA, "en", "a", 1) for i in range(30)]
    got = rows_of(line_dedup.line_dedup(awkward(spark, rows)))
    assert Counter((r["doc_id"], r["lines"], r["lines_deleted"], r["text_sha256"]) for r in got) == \
        Counter(brute_lines(rows))
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_finds_whole_runs_with_any_partner(spark):
    rng = np.random.default_rng(5)
    lines = [f"line {i} of the pool" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 12))), "en", "a", 1) for i in range(150)]
    got = rows_of(line_dedup.line_dedup(awkward(spark, rows)))
    assert Counter((r["doc_id"], r["lines"], r["lines_deleted"], r["text_sha256"]) for r in got) == \
        Counter(brute_lines(rows))


def repeated_runs(rows, min_lines=3, min_words=50):
    """id -> the lines of all runs, of any length, that have stood earlier."""
    first, gone = {}, defaultdict(set)
    for doc_id, text in rows:
        seq = text.split("\n")
        for i in range(len(seq)):
            for end in range(i, len(seq)):
                part = tuple(seq[i:end + 1])
                if len(part) >= min_lines or sum(len(WORD.findall(t)) for t in part) >= min_words:
                    at = first.setdefault(part, (doc_id, i, end))
                    if at[0] != doc_id or i > at[2]:
                        gone[doc_id].update(range(i, end + 1))
    return gone


def test_line_dedup_deletes_lines_behind_a_full_window(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rng = np.random.default_rng(6)
    long, half, short = line("l", 60), line("h", 30), line("s", 10)
    texts = [[long, short, short + " b"], ["own", long, short, short + " b", "end"],  # [60, 10, 10]
             [half, half + " b", short + " c"], [half, half + " b", short + " c", "last"],
             [short + " d", long + " e", short + " f"], [long + " e", short + " f"],  # at the text's end
             [short + " d", long + " e", "apart"],
             *([f"{line(p, n)}" for p, n in zip(rng.choice(list("xyz"), 6), rng.choice([4, 10, 30, 60], 6))]
               for _ in range(60))]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = {r["k"]["id"]: {i for s in r["spans"] for i in range(s["start"], s["end"] + 1)}
           for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == repeated_runs(rows)
    assert got[1] == {1, 2, 3} and got[3] == {0, 1, 2} and got[5] == {0, 1} and got[6] == {0, 1}


def test_deletion_keeps_blank_lines_in_place(spark):
    part = ["r1 of the run", "r2 of the run", "r3 of the run"]
    rows = [(1, "\n".join(part)), (2, "a\n\n" + "\n \n".join(part) + "\n\nb\n" + "\n".join(part) + "\n"),
            (3, "\n".join(part)), (4, "\n\n" + "\n".join(part) + "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in rows_of(line_dedup.drop_repeated_lines(docs))}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "a\n\n \n \n\nb\n"
    assert got[3]["text"] == "" and got[4]["text"] == "\n\n\n"
    assert [(got[i]["lines"], got[i]["lines_deleted"]) for i in (1, 2, 3, 4)] == [(3, 0), (8, 6), (3, 3), (3, 3)]


def test_line_dedup_is_linear_in_a_text_s_lines(spark):
    import time
    took = {}
    for n in (1_000, 16_000, 32_000):
        text = "\n".join(f"line {i} of a long text" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id bigint, text string")
        t = time.perf_counter()
        got = {r["doc_id"]: r for r in rows_of(line_dedup.line_dedup(docs))}
        took[n] = time.perf_counter() - t
        assert (got[1]["lines_deleted"], got[2]["lines_deleted"], got[2]["lines"]) == (0, n, n + 1)
    assert took[32_000] < 3 * took[16_000]


def test_dropped_lines_pass_other_columns_through(spark):
    docs = awkward(spark)
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns + ["lines", "lines_deleted"]


def test_native_operators_have_no_python_node(spark):
    for df in (line_dedup.line_dedup(awkward(spark)), exact_dedup.exact_dedup(awkward(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
