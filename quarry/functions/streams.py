"""Measures of a byte range of a file's text, read in pieces so that memory
stays bounded at any file size. Nothing here touches Spark.

The measures of a file's ranges, in order, merge into those of the file: a
range knows what it cut (a word, a line, a carriage return from its line feed)
by its first and last characters. Ranges end at the starts of characters, so
every byte is decoded by one range.
"""

from __future__ import annotations

import codecs
import io
from dataclasses import dataclass, field

PIECE = 1 << 20


@dataclass
class TextMeasures:
    """Running measures over decoded pieces with universal newlines."""
    keep: int                       # characters to keep for a preview, and one more
    words: int = 0
    lines: int = 1
    headers: int = 0
    head: str = ""
    in_word: bool = False           # the last character belongs to a word
    blank: bool = True              # the current line has only white space so far
    first_space: bool | None = None  # the first character is white space; None without one
    lead: str = ""                  # first character that is no white space on the first line
    starts_lf: bool = False         # the first character is a line feed
    ends_cr: bool = False           # the last character is a carriage return
    error: str | None = field(default=None)
    error_at: int | None = field(default=None)

    def add(self, piece: str) -> None:
        if not piece:
            return
        if self.first_space is None:
            self.first_space = piece[0].isspace()
        if len(self.head) <= self.keep:
            self.head += piece[:self.keep + 1 - len(self.head)]
        found = len(piece.split())
        # a word that goes on across the edge has been counted already
        self.words += found - (self.in_word and not piece[0].isspace())
        self.in_word = not piece[-1].isspace()
        self.lines += piece.count("\n")
        for i, part in enumerate(piece.split("\n")):
            if i:
                self.blank = True
            if self.blank:
                rest = part.lstrip()
                if rest:
                    self.blank = False
                    self.headers += rest[0] == "#"
                    if self.lines - piece.count("\n") + i == 1:
                        self.lead = rest[0]


def _decode_message(e: UnicodeDecodeError, before: int) -> str:
    """The message of decoding the whole file at once: ``before`` bytes were
    decoded earlier."""
    start, end = e.start + before, e.end + before
    if e.end - e.start == 1:
        return (f"'utf-8' codec can't decode byte 0x{e.object[e.start]:02x} in position {start}: "
                f"{e.reason}")
    return f"'utf-8' codec can't decode bytes in position {start}-{end - 1}: {e.reason}"


def _next_start(f, at: int) -> int:
    """First place from ``at`` on where a character can start (at most three
    bytes on: those that continue a character)."""
    if at == 0:
        return 0
    f.seek(at)
    for byte in f.read(3):
        if byte & 0xC0 != 0x80:
            break
        at += 1
    return at


def measure_text(path: str, keep: int, piece: int = PIECE, lo: int = 0,
                 hi: int | None = None) -> TextMeasures | None:
    """Measures of a file's bytes from ``lo`` to ``hi`` (its end if None), with
    ``error`` set where they are not UTF-8; None where the file cannot be read."""
    out = TextMeasures(keep)
    utf8 = codecs.getincrementaldecoder("utf-8")()
    newlines = io.IncrementalNewlineDecoder(None, translate=True)
    try:
        with open(path, "rb") as f:
            end = None if hi is None else _next_start(f, hi)
            read = _next_start(f, lo)
            f.seek(read)
            first = True
            while True:
                raw = f.read(piece if end is None else min(piece, max(end - read, 0)))
                held = len(utf8.getstate()[0])  # bytes of a character cut by the last piece
                # what follows the range decides how a broken last character reads
                more = b"" if raw or end is None else f.read(4)
                try:
                    if more and held:
                        utf8.decode(more)
                    text = utf8.decode(raw, final=not raw and not more)
                except UnicodeDecodeError as e:
                    out.error, out.error_at = _decode_message(e, read - held), e.start + read - held
                    return out
                if text:
                    out.starts_lf = text[0] == "\n" if first else out.starts_lf
                    out.ends_cr, first = text[-1] == "\r", False
                out.add(newlines.decode(text, final=not raw))
                read += len(raw)
                if not raw:
                    return out
    except OSError:
        return None
