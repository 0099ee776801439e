"""Tokens of whole columns of texts at once: the full-text tokenizer as array operations.

The same tokens as ``functions.text.fts_tokens``, from a table that is made of
that function itself, one character at a time; what isn't a matter of single
characters (combining marks, the capital sigma, bytes that aren't UTF-8) is
done here as there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T

CHARACTERS = 0x110000
#: Bytes of texts that are taken at once; a longer text is taken alone.
BLOCK = 8_000_000
_SIGMA = 0x3A3
_made: list[bytes] = []
_open: dict[bytes, np.ndarray] = {}


def table(spark: SparkSession) -> bytes:
    """Of every character what it is in a token, or that it's in none: packed, made once in a process."""
    if not _made:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        every = spark.range(0, CHARACTERS, 1, 16).where("id not between 55296 and 57343")  # no surrogates
        found = every.select("id", F.get(T.fts_tokens(char), F.lit(0)).alias("t")).where("t is not null").toArrow()  # the letters and digits that there are
        steps = np.full(CHARACTERS, -CHARACTERS, np.int32)
        at = found.column("id").to_numpy()
        steps[at] = np.array([ord(t) for t in found.column("t").to_pylist()]) - at
        _made.append(zlib.compress(steps.tobytes()))
    return _made[0]


def _unpacked(packed: bytes) -> np.ndarray:
    """By character: the one in a token, 0 for none."""
    if packed not in _open:
        steps = np.frombuffer(zlib.decompress(packed), np.int32)
        _open.clear()
        _open[packed] = np.where(steps == -CHARACTERS, 0, np.arange(CHARACTERS) + steps).astype(np.uint32)
    return _open[packed]


def _lowered_sigmas(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Capital sigmas in lower case, which depends on the letters around them."""
    codes = codes.copy()
    for i in np.unique(np.searchsorted(starts, np.flatnonzero(codes == _SIGMA), side="right") - 1):
        row = codes[starts[i] : starts[i + 1]]
        low = np.frombuffer(row.tobytes().decode("utf-32-le").replace("İ", "i").lower().encode("utf-32-le"), "<u4")
        row[row == _SIGMA] = low[row == _SIGMA]
    return codes


def _without_marks(codes: np.ndarray, folded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of combining marks go where they stand behind a token's character in the same text."""
    mark = (codes >= ord(min(T.MARKS))) & (codes <= ord(max(T.MARKS)))
    if not mark.any():
        return folded, starts
    mark[mark] = np.isin(codes[mark], [ord(c) for c in T.MARKS])
    head = np.zeros(len(codes), bool)
    head[starts[:-1][starts[:-1] < len(codes)]] = True  # a text's first character
    begins = mark & (head | ~np.r_[False, mark[:-1]])
    behind = begins & ~head & np.r_[False, folded[:-1] > 0]
    run = np.cumsum(begins)
    gone = mark & np.r_[False, behind[begins]][run]
    return folded[~gone], starts - np.r_[0, np.cumsum(gone)][starts]


def _folded(texts: pa.Array, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of tokens, 0 for others, and where each text starts among them; a null has none."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = data[int(ends[0]) : int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""
    if data.isascii():
        return fold[:128].astype(np.uint8)[np.frombuffer(data, np.uint8)], ends - ends[0]
    try:
        text, sizes = data.decode(), pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    except UnicodeDecodeError:
        each = [data[a:b].decode(errors="replace") for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
        text, sizes = "".join(each), [*map(len, each)]
    starts = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    try:
        return fold[:256].astype(np.uint16)[np.frombuffer(text.encode("latin-1"), np.uint8)], starts
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if "Σ" in text:
        codes = _lowered_sigmas(codes, starts)
    return _without_marks(codes, fold[codes], starts)


class Tokens:
    """The tokens of some texts in one row: where they start, how long they are, and the first of each text."""

    def __init__(self, texts: pa.Array, fold: np.ndarray) -> None:
        self.codes, starts = _folded(texts, fold)
        inside = self.codes != 0
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        some = starts[:-1] < starts[1:]
        heads, tails = starts[:-1][some], starts[1:][some] - 1
        begin[heads], end[tails] = inside[heads], inside[tails]
        self.at = np.flatnonzero(begin)
        self.size = np.flatnonzero(end) + 1 - self.at
        self.first = np.searchsorted(self.at, starts)
        self.head = self.codes[self.at]

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Places by text."""
        return np.diff(np.searchsorted(places, self.first))

    def find(self, term: str, prefix: bool = False) -> np.ndarray:
        """Places of a term, or of all that start with it, in order."""
        spelled = [ord(c) for c in term]
        found = np.flatnonzero((self.head == spelled[0]) & (self.size >= len(spelled) if prefix else self.size == len(spelled)))
        for j, c in enumerate(spelled[1:], 1):
            found = found[self.codes[self.at[found] + j] == c]
        return found


def blocks(texts: pa.Array, packed: bytes) -> Iterator[tuple[int, int, Tokens]]:
    """Texts from one row to before another, and their tokens."""
    texts, fold, lo = texts.cast(pa.large_string()), _unpacked(packed), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield lo, hi, Tokens(texts[lo:hi], fold)
        lo = hi
