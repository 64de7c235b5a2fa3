"""Alignment of two tokenizers' tokens, by their spans.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and reads a
space and the text; B is a SentencePiece model, which adds that space itself.
Both give spans: A's are character offsets, B's stand in its result message.
Spans are coarse cuts: where one token ends and the next begins at the same
character, that place is a token boundary. Between such cuts, tokens that
share a character (parts of a multibyte character, byte-fallback pieces) lie
one after the other by the lengths of their decoded bytes. So every token gets
its exact byte range. Bytes where tokens of both sides end cut them into
groups; every stretch between neighbouring ends of either side lies in exactly
one A and one B token, which is one link.

Neither tokenizer has a token across the start of a space that stands behind a
character that is no white space (``check_model`` proves it for B; A's
pre-tokenizer cuts there, ``check_bytes`` looks at its settings). Texts fall
into such chunks, and a block of texts encodes and aligns each distinct chunk
once. It gives parts (documents with their chunks as numbers) and one table
(the links of each chunk, and of the block's distinct (A id, B id) pairs). Both
are cut into rows of at most ``PIECE`` items a list, written in small row
groups: the rows that the JVM copies and the row group that it reads at once do
not grow with a block. Pair
counts over the corpus are a sum of the tables; each block then receives the
counts of its own pairs, joined by pair and grouped by block, and sums them up
over its documents' chunks. Nothing is broadcast but B's vocabulary (one number
per id).

The rows shuffled are one per block and distinct pair: a pair has at most one
row per block and a block's rows are bounded by its text, so no key holds a
large share. A block ends when its texts or its distinct chunks have the size
above; only a single longer text exceeds it. A document counts as ``DOC_CHARS``
characters besides its text, so many empty ones fill a part as well.

Defined cases: null and empty texts, and texts whose tokens do not decode to
the space and the text (a literal U+2581), have no tokens: zeros and ''; ids
may be null or repeat (documents are never joined by id); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, materialize, python_ready, text_or_empty
from quarry.llm.sentencepiece_codec import MARK, check_model, load_model

PART_CHARS = 3_000_000    # of the texts that are worked on at once
BLOCK_CHARS = 20_000_000  # of a block's texts
TABLE_CHARS = 2_500_000   # of a block's distinct chunks
DOC_CHARS = 100           # that a document's id, digest and counts weigh
PIECE = 1 << 15           # items of a list in a row
CALL_WORDS = 1_000
_B_BITS = 20  # of B's id in a pair
_CUT = re.compile(r"(?<=\S)(?= )")
_RARE_CUT = re.compile(r"\s ")
#: Of the stage's files. Rows are large: without the last, sizes are looked at every 100 rows.
_ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1}
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def check_bytes(path: str) -> None:
    """Raises unless A is a byte-level BPE that splits at spaces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if (spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True)
            or split.get("add_prefix_space")):
        raise ValueError("the tokenizer is not a plain byte-level BPE")


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand
    for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Side:
    """What both tokenizers have: token bytes by id, and ids as text."""

    def __init__(self, token_bytes: list[bytes], mark: str):
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes])
        # ids behind a comma, then behind the side's mark, where a group's side begins
        self.names = np.array([m + str(i) for m in ("," + mark) for i in range(len(token_bytes))], dtype=object)

    def named(self, ids: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Tokens as text: the first of each group behind the side's mark."""
        first = np.append(True, groups[1:] != groups[:-1])
        return self.names[ids + len(self.bytes) * first]

    def ends(self, ids: np.ndarray, span_ends: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """End byte of every token: that of its span at coarse cuts, and behind
        the last one by the tokens' own bytes between them."""
        own = np.cumsum(self.lengths[ids])
        last = np.maximum.accumulate(np.where(coarse, np.arange(len(ids)), -1))
        from_cut = np.where(last >= 0, span_ends[last] - own[last], 0)
        return np.where(coarse, span_ends, own + from_cut)


class ByteSide(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_letters()
        vocabulary = self.model.get_vocab()
        found = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            found[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(found, ";")

    def spans(self, text: str, byte_at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and end bytes of the tokens of a text that starts with the space."""
        encoded = self.model.encode(text, add_special_tokens=False)
        offsets = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(encoded))
        ids, starts, ends = np.array(encoded.ids), offsets[::2], offsets[1::2]
        coarse = np.append(ends[:-1] == starts[1:], True)
        return ids, self.ends(ids, ends if byte_at is None else byte_at[ends], coarse)


class PieceSide(Side):
    def __init__(self, path: str):
        self.model = load_model(path)
        found = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            found.append(bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode())
        super().__init__(found, "|")

    def spans(self, text: str, byte_at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if text == " ":  # a lone marker, which the model adds to no empty text
            return np.array([self.model.piece_to_id(MARK)]), np.ones(1, int)
        found = self.model.encode(text[1:], return_type="proto", num_threads=1).pieces
        spans = np.fromiter(chain.from_iterable([(p.id, p.end) for p in found]), np.int64, 2 * len(found))
        ids, ends = spans[::2], spans[1::2]
        # the first bytes of a fallen-back character have empty spans, the last one has the character
        coarse = np.diff(ends, prepend=-1 if ends[0] == 0 and self.lengths[ids[0]] == 1 else 0) > 0
        if byte_at is not None and len(ends) and ends[-1] == len(text) - 1:
            ends = byte_at[ends + 1] - 1  # spans in characters
        return ids, self.ends(ids, ends + 1, coarse)


class Chunks:
    """Aligned chunks, by number: sizes, group texts and links."""

    def __init__(self):
        self.n_a, self.n_b, self.n_groups, self.n_links = [], [], [], []
        self.texts: list[str] = []    # ";group;group..."
        self.pairs: list[np.ndarray] = []
        self.good: list[np.ndarray] = []

    def add(self, a: ByteSide, b: PieceSide, chunks: list[str]) -> None:
        text = "".join(chunks)
        raw = text.encode()
        byte_at = None
        if len(raw) > len(text):  # places of the characters' first bytes
            leads = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
            byte_at = np.append(np.flatnonzero(leads), len(raw))
        ids_a, ends_a = a.spans(text, byte_at)
        ids_b, ends_b = b.spans(text, byte_at)
        whole = (b"".join(map(a.bytes.__getitem__, ids_a.tolist())) == raw
                 and b"".join(map(b.bytes.__getitem__, ids_b.tolist())) == raw)
        if not whole:
            if len(chunks) > 1:
                for chunk in chunks:
                    self.add(a, b, [chunk])
                return
            for column in (self.n_a, self.n_b, self.n_groups, self.n_links):
                column.append(np.zeros(1, int))
            self.texts.append("")
            self.pairs.append(np.zeros(0, np.int64))
            self.good.append(np.zeros(1, bool))
            return
        n = len(chunks)
        chunk_ends = np.cumsum([len(c) for c in chunks])
        if byte_at is not None:
            chunk_ends = byte_at[chunk_ends]
        groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = np.union1d(ends_a, ends_b)
        self.pairs.append(ids_a[np.searchsorted(ends_a, links)].astype(np.int64) << _B_BITS
                          | ids_b[np.searchsorted(ends_b, links)])
        for column, ends in ((self.n_a, ends_a), (self.n_b, ends_b), (self.n_groups, groups),
                             (self.n_links, links)):
            column.append(np.diff(np.searchsorted(ends, chunk_ends, "right"), prepend=0))
        self.good.append(np.ones(n, bool))
        # tokens as text in the order of groups, A before B
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        listed = np.concatenate([a.named(ids_a, group_a), b.named(ids_b, group_b)])[order].tolist()
        at = 0
        for size in (self.n_a[-1] + self.n_b[-1]).tolist():
            self.texts.append("".join(listed[at:at + size]))
            at += size

    def columns(self) -> dict[str, np.ndarray]:
        for name in ("n_a", "n_b", "n_groups", "n_links", "pairs", "good"):
            setattr(self, name, [np.concatenate(getattr(self, name) or [np.zeros(0, int)])])
        return {name: getattr(self, name)[0] for name in ("n_a", "n_b", "n_groups", "n_links", "pairs")} | {
            "good": self.good[0].astype(bool)}


@lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


def chunk_keys(text: str) -> list[str]:
    """Chunks of the space and the text, without the space that each starts with."""
    if _RARE_CUT.search(" " + text) is None:
        return text.split(" ")
    return [c[1:] for c in _CUT.split(" " + text)]


def align(a: ByteSide, b: PieceSide, keys: list[str], chunks: Chunks) -> Chunks:
    """Adds the distinct chunks ``keys``, many to a call where no white space at
    a chunk's end could meet the next chunk."""
    call: list[str] = []
    for key in keys:
        closed = key != "" and not key[-1].isspace()
        if call and (not closed or len(call) == CALL_WORDS):
            chunks.add(a, b, call)
            call = []
        if closed:
            call.append(" " + key)
        else:
            chunks.add(a, b, [" " + key])
    if call:
        chunks.add(a, b, call)
    return chunks


class Block:
    """Documents whose chunks are aligned through one table; texts are not kept."""

    def __init__(self, a: ByteSide, b: PieceSide, name: str):
        self.a, self.b, self.name = a, b, name
        self.numbers = defaultdict(count().__next__)
        self.chunks, self.times = Chunks(), np.zeros(0, np.int64)
        self.chars = self.table_chars = 0
        self._start_part()

    def _start_part(self) -> None:
        self.ids, self.words, self.part_chars = [], [], 0

    def add(self, doc, text: str) -> None:
        keys = chunk_keys(text) if text and MARK not in text else []
        self.ids.append(doc)
        self.words.append(np.fromiter(map(self.numbers.__getitem__, keys), np.int32, len(keys)))
        self.part_chars += len(text) + DOC_CHARS

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or self.table_chars >= TABLE_CHARS

    def part(self) -> dict:
        """The documents since the last part, their new chunks aligned."""
        new = list(islice(self.numbers, len(self.times), None))
        align(self.a, self.b, new, self.chunks)
        self.chars += self.part_chars
        self.table_chars += sum(map(len, new)) + len(new)
        table = self.chunks.columns()
        words = [w if table["good"][w].all() else w[:0] for w in self.words]
        ids = self.ids
        self._start_part()
        sizes = np.array([len(w) for w in words], int)
        every = np.concatenate(words) if words else np.zeros(0, np.int32)
        edges = np.append(0, np.cumsum(sizes))
        times = np.bincount(every, minlength=len(table["good"]))
        times[:len(self.times)] += self.times
        self.times = times

        def per_document(column: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(column[every]))
            return sums[edges[1:]] - sums[edges[:-1]]

        digests = []
        for w in words:
            digest, step = hashlib.sha256(), 1 << 18
            for at in range(0, len(w), step):
                text = "".join(map(self.chunks.texts.__getitem__, w[at:at + step].tolist()))
                digest.update((text[1:] if at == 0 else text).encode())
            digests.append(digest.hexdigest() if len(w) else "")
        return {"block": self.name, "ids": ids, "words": every, "sizes": sizes, "digests": digests,
                **{c: per_document(table[c]) for c in ("n_a", "n_b", "n_groups", "n_links")}}

    def table(self) -> dict:
        """The block's chunks and pairs, its last record."""
        columns = self.chunks.columns()
        self.chunks = self.numbers = None
        pairs, place = np.unique(columns["pairs"], return_inverse=True)
        links = np.bincount(place, weights=np.repeat(self.times, columns["n_links"]), minlength=len(pairs))
        return {"block": self.name, "chunk_links": columns["n_links"].astype(np.int32),
                "place": place.astype(np.int32), "pairs": pairs, "links": links.astype(np.int64)}


_BLOCKS = pa.schema([
    ("block", pa.string()), ("part", pa.int32()), ("piece", pa.int32()),
    ("ids", pa.list_(pa.string())), ("words", pa.list_(pa.int32())),
    ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("n_a", pa.list_(pa.int64())),
    ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("chunk_links", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())),
    ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])
_DDL = ", ".join(f"{f.name} " + {"string": "string", "int32": "int", "list<item: string>": "array<string>",
                                 "list<item: int32>": "array<int>", "list<item: int64>": "array<bigint>"}
                 .get(str(f.type), "array<bigint>") for f in _BLOCKS)
_PART = ["ids", "words", "sizes", "digests", "n_a", "n_b", "n_groups", "n_links"]


def pieces(row: dict, part: int | None, size: int) -> Iterator[pa.RecordBatch]:
    """A block's part, or its table if ``part`` is None, as rows: the k-th has
    the items k * size up to (k + 1) * size of each list."""
    lists = {name: v for name, v in row.items() if name != "block"}
    for k in range(max(1, -(-max(map(len, lists.values())) // size))):
        cut = {name: v[k * size:(k + 1) * size] for name, v in lists.items()}
        cut |= {"block": row["block"], "part": part, "piece": k}
        yield pa.RecordBatch.from_arrays([pa.array([cut.get(f.name)], f.type) for f in _BLOCKS], schema=_BLOCKS)


def joined(rows: pd.DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """The whole lists of one record's pieces."""
    rows = rows.sort_values("piece")
    return {name: np.concatenate(rows[name].tolist()) for name in names}


def _give_back_memory() -> None:
    """Returns what a task has freed to the machine: the worker stays, and the
    next stage's memory is another's."""
    import ctypes
    import ctypes.util
    gc.collect()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                   text_col: str = "text", part_chars: int = PART_CHARS, piece: int = PIECE) -> DataFrame:
    """The rows of all blocks: pieces of parts, and of tables (``part`` is null)."""
    check_model(b_path)
    check_bytes(a_path)
    python_ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(a_path, b_path)
        task = TaskContext.get()
        prefix = f"{task.stageId()}-{task.partitionId()}" if task else "0"
        number, parts = count(), count()
        block = None
        gc.disable()  # many small strings and tuples, no cycles
        try:
            for batch in batches:
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    block = block or Block(a, b, f"{prefix}-{next(number)}")
                    block.add(doc, text.as_py())
                    if block.part_chars >= part_chars:
                        yield from pieces(block.part(), next(parts), piece)
                        if block.full():
                            yield from pieces(block.table(), None, piece)
                            block = None
            if block:
                if block.ids:
                    yield from pieces(block.part(), next(parts), piece)
                yield from pieces(block.table(), None, piece)
        finally:
            gc.enable()  # the worker goes on with other tasks
            block = None
            _give_back_memory()

    return docs.select(id_as_text(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, _DDL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, the links that hold it, and whether no other A token holds
    more with its B token."""
    counts = (blocks.select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n"))
              .where("n > 0")  # pairs only of texts without tokens
              .withColumn("a", F.shiftright("pair", _B_BITS))
              .withColumn("b", F.col("pair").bitwiseAND((1 << _B_BITS) - 1)))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most B's vocabulary
    return (counts.join(F.broadcast(top), "b")
            .select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best")))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                    text_col: str = "text", part_chars: int = PART_CHARS, piece: int = PIECE) -> DataFrame:
    """One row per document: id_col, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256 (see ``pair_counts`` and ``aligned_groups`` for
    the pairs and the groups themselves)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = materialize(aligned_blocks(docs, a_path, b_path, id_col, text_col, part_chars, piece), "aligned",
                         _ROW_GROUPS)
    counts = materialize(pair_counts(blocks), "pairs")
    asked = (blocks.select(F.col("block").alias("for"), "piece", F.posexplode("pairs").alias("pos", "pair"))
             .withColumn("pos", F.col("piece") * piece + F.col("pos")))
    answers = asked.join(counts.select("pair", "n", "best"), "pair").select("for", "pos", "n", "best")
    out = ("id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
           "count_sum bigint, groups_sha256 string")

    def run(some: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        # the rows of one block: its table, and its parts
        table = joined(some[some["part"].isna()], ["chunk_links", "place", "pairs"])
        n, best = np.zeros(len(table["pairs"]), np.int64), np.zeros(len(table["pairs"]), np.int64)
        n[counted["pos"]], best[counted["pos"]] = counted["n"], counted["best"]
        links = np.append(0, np.cumsum(table["chunk_links"]))

        def of_chunks(values: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(values[table["place"]]))
            return sums[links[1:]] - sums[links[:-1]]

        chunk_n, chunk_best = of_chunks(n), of_chunks(best)
        frames = []
        for _, rows in some[some["part"].notna()].groupby("part"):
            r = joined(rows, _PART)
            edges = np.append(0, np.cumsum(r["sizes"]))

            def per_document(values, r=r, edges=edges):
                sums = np.append(0, np.cumsum(values[r["words"]]))
                return sums[edges[1:]] - sums[edges[:-1]]

            frames.append(pd.DataFrame({
                "id": r["ids"], "n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"],
                "n_links": r["n_links"], "n_best": per_document(chunk_best),
                "count_sum": per_document(chunk_n), "groups_sha256": r["digests"]}))
        return pd.concat(frames)

    left = blocks.drop("links").groupBy("block")
    found = left.cogroup(answers.groupBy("for")).applyInPandas(run, out)
    return found.select(F.col("id").cast(id_type).alias(id_col), *found.columns[1:])


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: id_col and its groups, each with A's and B's ids."""
    check_model(b_path)
    check_bytes(a_path)
    python_ready(docs)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(a_path, b_path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                keys = chunk_keys(text) if text and MARK not in text else []
                chunks = align(a, b, keys, Chunks())
                whole = all(good.all() for good in chunks.good)
                listed = "".join(chunks.texts)[1:].split(";") if keys and whole else []
                rows.append([{"a": [int(x) for x in g.split("|")[0].split(",")],
                              "b": [int(x) for x in g.split("|")[1].split(",")]} for g in listed])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)],
                                             names=["id", "groups"])

    return (docs.select(id_as_text(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .mapInArrow(run, "id string, groups array<struct<a:array<int>,b:array<int>>>")
            .select(F.col("id").cast(id_type).alias(id_col), "groups"))
