"""Exact token counts at every prefix, by dynamic programming.

The ids of a text are found by merges, so the tokens of its prefix are not a
prefix of its tokens. Still a prefix's tokens follow from shorter prefixes:
the last of them, t, stands behind the tokens of the prefix without t, and
among all pieces that end there exactly one t does not merge with the token
before it. So one pass keeps for every prefix its count and its last token,
``count[i] = count[i - len(t)] + 1``, trying at most as many pieces per
character as the longest piece is long. Whether two neighbouring tokens stay
apart is asked of the tokenizer once per pair and remembered.

No piece crosses the start of a marked word (``check_model`` proves it for the
model), so the table is kept by the prefixes of marked words, shared by all
words that begin alike, and a text's counts are the sums over its words. The
counts then answer without another encoding: how many tokens a text or any of
its prefixes has, and which is its longest prefix within a budget (counts can
fall from a prefix to the next, so this is not a cut of the whole text's
tokens).

The table is bounded by ``TABLE_PREFIXES`` and the pairs by ``TABLE_PAIRS``;
a full one starts anew, which costs time and never changes a result. A worker
keeps it for its next tasks, which get the same counts from an empty one. Words of
more than ``LONG_WORD`` characters go through the same recurrence on their
own; texts are worked on in bounded pieces. The work is a map without a
shuffle.

Defined cases: null and empty texts have no bytes and no tokens (a budget
keeps their 0 characters); ids may be null or repeat; texts of any length are
treated whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, python_ready, text_or_empty
from quarry.llm.sentencepiece_codec import MARK, ChunkTable, check_model, pieces

TABLE_PREFIXES = 1_200_000
TABLE_PAIRS = 1_000_000
LONG_WORD = 48  # counts of these fit into bytes


class Merges:
    """The merging part of a model: ids of a string without an added marker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False
        model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        plain = (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED)
        self.pieces = {p.piece.replace(MARK, " ") for p in proto.pieces if p.type in plain}
        # lengths of the pieces that end like the last three (or fewer) characters of a
        # string, longest first; endings without pieces of three characters: by the last two
        lengths: dict[str, set[int]] = {}
        for piece in self.pieces:
            for n in range(1, min(len(piece), 3) + 1):
                lengths.setdefault(piece[-n:], {1})
        for end, found in lengths.items():
            found.update(n for n in range(1, len(end) + 1) if end[-n:] in self.pieces)
        for piece in self.pieces:
            if len(piece) >= 3:
                lengths[piece[-3:]].add(len(piece))
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self.encode = lambda s: model.encode(s, num_threads=1)


class PrefixCounts(dict):
    """Token counts of the marked words met so far; the keys leave out the
    word's marker (the empty key is the lone marker).

    ``states`` holds every prefix of those words: the counts behind each of
    its characters and the lengths of the last tokens there, as bytes, shared
    by the prefixes of one word.
    """

    def __init__(self, merges: Merges, max_prefixes: int = TABLE_PREFIXES,
                 max_pairs: int = TABLE_PAIRS):
        super().__init__()
        self.merges, self.max_prefixes, self.max_pairs = merges, max_prefixes, max_pairs
        self.states: dict[str, tuple[bytes, bytes]] = {}
        self.apart: dict[tuple[str, str], bool] = {}  # two tokens that stay apart
        self.ids: dict[str, list[int]] = {}          # of a token: several for an unknown character

    def _ids(self, token: str) -> list[int]:
        found = self.ids.get(token)
        if found is None:
            found = self.ids[token] = self.merges.encode(token)
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        if len(self.apart) >= self.max_pairs:
            self.apart.clear()
            self.ids.clear()
        found = self.merges.encode(left + right) == self._ids(left) + self._ids(right)
        self.apart[left, right] = found
        return found

    def _extend(self, word: str, at: int, counts, lasts) -> None:
        """Appends count and last token's length of ``word[:end]`` for every
        end > at; ``counts[end]`` and ``lasts[end]`` are known up to ``at``."""
        known, lengths, apart = self.merges.pieces, self.merges.lengths, self.apart
        for end in range(at + 1, len(word) + 1):
            sizes = (lengths.get(word[end - 3:end] if end > 2 else word[:end])
                     or lengths.get(word[end - 2:end], (1,)))
            for size in sizes:
                start = end - size
                if start < 0:
                    continue
                token = word[start:end]
                if size > 3 and token not in known:
                    continue
                if start:
                    left = word[start - lasts[start]:start]
                    fits = apart.get((left, token))
                    if fits is None:
                        fits = self._stay_apart(left, token)
                else:  # alone: a character, or a piece that the merges do build
                    fits = size == 1 or len(self._ids(token)) == 1
                if fits:
                    counts.append(counts[start] + (len(self._ids(token)) if size == 1 else 1))
                    lasts.append(size)
                    break
            else:
                raise ValueError(f"no token ends {word[:end]!r}: the model's ids are not built by merges")

    def __missing__(self, key: str) -> int:
        if len(key) > LONG_WORD:
            return int(self.word(key)[-1])
        states = self.states
        if len(states) + len(key) >= self.max_prefixes:
            self.clear()
            states.clear()
        at = len(key)
        new = []
        while at >= 0 and (state := states.get(prefix := key[:at])) is None:
            new.append(prefix)
            at -= 1
        # behind nothing, the marker and the ``at`` characters of the known prefix
        counts = bytearray(state[0][:at + 2]) if at >= 0 else bytearray(1)
        lasts = bytearray(state[1][:at + 2]) if at >= 0 else bytearray(1)
        if new:
            self._extend(" " + key, at + 1, counts, lasts)
            states.update(dict.fromkeys(new, (bytes(counts), bytes(lasts))))
        self[key] = counts[-1]
        return counts[-1]

    def word(self, key: str) -> np.ndarray:
        """Counts at the word's prefixes: behind the marker, then behind each
        character of the key."""
        if len(key) <= LONG_WORD:
            if key not in self.states:
                self[key]
            return np.frombuffer(self.states[key][0], np.uint8)[1:len(key) + 2].astype(int)
        counts, lasts = [0], [0]
        self._extend(" " + key, 0, counts, lasts)
        return np.array(counts[1:])

    def total(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, ChunkTable.chunks(part)))
                   for part in pieces(text)) if text else 0

    def prefixes(self, text: str) -> np.ndarray:
        """The exact number of tokens of ``text[:i]`` for every i."""
        if not text:
            return np.zeros(1, int)
        out, before = [], 0
        for part in pieces(text):
            for key in ChunkTable.chunks(part):
                out.append(before + self.word(key))
                before = int(out[-1][-1])
        found = np.concatenate(out)
        found[0] = 0  # the text's own marker is added with its first character
        return found

    def cut(self, text: str, budgets: Sequence[int], places: Sequence[int]) -> tuple[int, list, list]:
        """Tokens of the text, characters of its longest prefix within each
        budget, and tokens of its prefix of each given length."""
        if not text:
            return 0, [0 for _ in budgets], [0 for _ in places]
        keys = [k for part in pieces(text) for k in ChunkTable.chunks(part)]
        ends = np.cumsum([self[k] for k in keys])
        starts = np.cumsum([0] + [len(k) + 1 for k in keys])  # of the words, in characters of the text
        fit = []
        for budget in budgets:
            at = bisect_right(ends, budget)  # the first word that does not fit whole
            if at == len(keys):
                fit.append(len(text))
                continue
            before = int(ends[at - 1]) if at else 0
            inside = np.flatnonzero(self.word(keys[at]) + before <= budget)
            # nothing of the word, not its marker either: the prefix ends before it
            fit.append(max(0, int(starts[at]) + (int(inside[-1]) if len(inside) else -1)))
        counts = []
        for n in places:
            n = min(max(n, 0), len(text))
            at = bisect_right(starts, n) - 1
            at = min(at, len(keys) - 1)
            before = int(ends[at - 1]) if at else 0
            counts.append(before + int(self.word(keys[at])[n - int(starts[at])]) if n else 0)
        return int(ends[-1]), fit, counts


@lru_cache(maxsize=1)
def worker_table(path: str) -> PrefixCounts:
    """The table of a Python worker, kept from task to task."""
    return PrefixCounts(Merges(path))


def token_counts(docs: DataFrame, model_path: str, budgets: Sequence[int] = (),
                 places: Sequence[int] = (), with_prefixes: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes (UTF-8) and n_tokens; ``fit``, the
    characters of the longest prefix within each budget; ``at``, the tokens of
    the prefix of each length in ``places`` (a longer one is the whole text);
    with ``with_prefixes`` also ``prefixes``, the tokens of every prefix."""
    check_model(model_path)
    python_ready(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "fit", "at"] + ["prefixes"] * with_prefixes
    schema = ("id string, n_bytes bigint, n_tokens bigint, fit array<bigint>, at array<bigint>"
              + (", prefixes array<int>" if with_prefixes else ""))
    budgets, places = list(budgets), list(places)

    def answer(table: PrefixCounts, text: str) -> tuple:
        n = table.total(text)
        if not places and all(n <= b for b in budgets):
            out = (n, [len(text)] * len(budgets), [])
        else:
            out = table.cut(text, budgets, places)
        return (*out, table.prefixes(text).astype(np.int32)) if with_prefixes else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(model_path)
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        gc.disable()  # the table holds many strings and no cycles
        try:
            for batch in batches:
                rows = [answer(table, t.as_py()) for t in batch.column("text")]
                columns = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("n_bytes"), *columns],
                    names=["id", "n_bytes", *names])
        finally:
            gc.enable()  # the worker goes on with other tasks

    text = text_or_empty(text_col)
    return (docs.select(id_as_text(id_col).alias("id"),
                        F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
            .mapInArrow(run, schema)
            .select(F.col("id").cast(id_type).alias(id_col), "n_bytes", *names))
