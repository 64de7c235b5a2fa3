"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model whose pieces never hold a white-space marker after another
character, no merge can cross the start of a marked word. A text therefore
falls into chunks (a run of markers and the word behind it) whose
segmentations are independent. Each task keeps a table of the distinct chunks
it has met: a chunk is segmented and decoded once, and the texts' ids are
joined back by position. ``check_model`` proves the condition on the model's
pieces and normaliser before any task runs.

The table is bounded by ``TABLE_CHARS`` characters of chunks; when it is full
it starts anew, which costs time and never changes a result. Texts are worked
on in groups of ``GROUP_CHARS`` characters and longer ones in pieces of that
size, cut at a chunk's start, so memory does not grow with a text or a batch.
The work is a map over the rows: no shuffle, nothing but the model path leaves
the driver, and a lost task is recomputed from its input split.

Defined cases: a null text counts as empty and has no ids; ids may be null or
repeat (rows are never joined); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, python_ready, text_or_empty

MARK = "▁"
TABLE_CHARS = 3_000_000
GROUP_CHARS = 500_000
CALL_WORDS = 500
# behind the first marker of a text: runs of markers and words
_CHUNK = re.compile("(?: *[^ ]+| +$)")


def load_model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raises unless chunks can be segmented apart with this model."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("the model's normaliser changes text beyond marking white space")
    if proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model marks the ends of words")
    crossing = [p.piece for p in proto.pieces if re.search(f"[^{MARK}]{MARK}", p.piece)]
    if crossing:
        raise ValueError(f"pieces cross a white-space marker: {crossing[:5]}")


class ChunkTable:
    """Ids (as text) and decoded text of distinct chunks.

    The key of a chunk is the chunk without its first marker, with spaces for
    the others: ``word`` stands for the marked word, the empty key for a lone
    marker.
    """

    def __init__(self, model, max_chars: int = TABLE_CHARS):
        self.model, self.max_chars = model, max_chars
        self.rows: dict[str, tuple[str, str]] = {}
        self.chars = 0
        # an id as text, behind a space where its piece opens a marked word
        self.names = np.array([(" " if model.id_to_piece(i).startswith(MARK) else ",") + str(i)
                               for i in range(model.get_piece_size())], dtype=object)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Keys of the chunks of a text that is not empty."""
        if MARK in text:
            text = text.replace(MARK, " ")
        keys = text.split(" ")
        if "" not in keys:
            return keys
        # " " + text cut before each run of markers; the first marker goes
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def learn(self, keys: set[str]) -> None:
        """Segments and decodes the chunks that the table does not hold yet."""
        new = [k for k in keys if k not in self.rows]
        size = sum(map(len, new))
        if self.chars + size > self.max_chars:
            self.rows, self.chars = {}, 0
            new = list(keys)
            size = sum(map(len, new))
        self.chars += size
        words = [k for k in new if k and " " not in k]
        for i in range(0, len(words), CALL_WORDS):
            # one call for many marked words: each holds one marker, at its start
            some = words[i:i + CALL_WORDS]
            ids = self.model.encode(" ".join(some), num_threads=1)
            as_text = "".join(self.names[ids].tolist())[1:].split(" ")
            decoded = self.model.decode(ids).split(" ")
            # a text that decodes to itself is held once
            self.rows.update((k, (i, k if k == t else t))
                             for k, i, t in zip(some, as_text, decoded, strict=True))
        for k in new:
            if not k:
                ids = [self.model.piece_to_id(MARK)]
            elif " " in k:
                ids = self.model.encode(k, num_threads=1)
            else:
                continue
            self.rows[k] = (",".join(map(str, ids)), self.model.decode(ids))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids as text, decoded text) of each text that is not empty."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        out = []
        for keys in cut:
            found = [self.rows[k] for k in keys]
            # decode() drops the first marker of a chunk; inside a text it is a space
            out.append((",".join([r[0] for r in found]), " ".join([r[1] for r in found])))
        return out


def pieces(text: str, size: int = GROUP_CHARS) -> Iterator[str]:
    """Parts of a long text whose chunks, one part after the other, are the
    chunks of the text: cut at the first marker of a run, which goes."""
    if MARK in text:
        text = text.replace(MARK, " ")
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        while cut > at and text[cut - 1] == " ":
            cut -= 1
        if cut <= at:  # one chunk fills the piece: its end is the next start
            word = re.compile("[^ ]").search(text, at)
            cut = text.find(" ", word.start()) if word else -1
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class _Digest:
    """What a text's pieces add up to."""

    def __init__(self, with_ids: bool):
        self.n, self.ids_hash, self.text_hash = 0, hashlib.sha256(), hashlib.sha256()
        self.ids = [] if with_ids else None

    def add(self, ids: str, decoded: str) -> None:
        if self.n:
            self.ids_hash.update(b",")
            self.text_hash.update(b" ")
        self.ids_hash.update(ids.encode())
        self.text_hash.update(decoded.encode())
        self.n += ids.count(",") + 1
        if self.ids is not None:
            self.ids.append(np.array(ids.split(","), dtype=np.int32))

    def row(self) -> tuple:
        out = (self.n, self.ids_hash.hexdigest(), self.text_hash.hexdigest())
        if self.ids is None:
            return out
        return (*out, np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32))


def encode_rows(table: ChunkTable, ids: list, texts: list[str],
                with_ids: bool) -> Iterator[list[tuple]]:
    """Result rows, in lists of one group each."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= GROUP_CHARS):
            chars += len(texts[end])
            end += 1
        digests = [_Digest(with_ids) for _ in range(start, end)]
        if chars > GROUP_CHARS:  # a long text, alone in its group
            for piece in pieces(texts[start]):
                digests[0].add(*table.encode([piece])[0])
        else:
            some = [i for i in range(start, end) if texts[i]]
            for i, found in zip(some, table.encode([texts[i] for i in some])):
                digests[i - start].add(*found)
        yield [(ids[i], *digests[i - start].row()) for i in range(start, end)]
        start = end


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256 and,
    with ``with_ids``, the ids themselves."""
    check_model(model_path)
    python_ready(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = ("id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
              + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk_table = ChunkTable(load_model(model_path))
        gc.disable()  # the table holds many small tuples and no cycles
        try:
            for batch in batches:
                for rows in encode_rows(chunk_table, batch["id"].tolist(), batch["text"].tolist(),
                                        with_ids):
                    yield pd.DataFrame(rows, columns=names)
        finally:
            gc.enable()  # the worker goes on with other tasks

    return (docs.select(id_as_text(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .mapInPandas(run, schema)
            .select(F.col("id").cast(id_type).alias(id_col), *names[1:]))
