"""Terms of texts, a batch of texts at once.

Tokens are found by comparing the bytes of many texts with their neighbours. What is said of a token is
worked out once for every different token of a piece; places and texts are handled as numbers only.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 18  # text handled together, more only where one text is longer
PIECE_ROWS = 1 << 16
_FACTOR = 0x2545F491  # odd and below 2^30, so that a hash fits in a long
_SIGN, _DIGIT, _LETTER, _HYPHEN = 1, 2, 3, 4
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(b"+#.")], _KIND[ord("-")], _KIND[48:58] = _SIGN, _HYPHEN, _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOWER[65:91] += 32
# the only letters beyond ASCII whose lower case has an ASCII letter
_FOREIGN = ("\u212a", "\u0130")


def term_hash(term: Column) -> Column:
    """A number for a term of one or two tokens; different terms may share it."""
    parts = F.split(term, " ", 2)
    return (F.crc32(F.get(parts, 0).cast("binary")) * F.lit(_FACTOR)
            + F.coalesce(F.crc32(F.get(parts, 1).cast("binary")), F.lit(0)))


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text has, and all tokens in order, in lower case."""
    # one line feed after each text keeps tokens apart
    ended = pc.binary_join_element_wise(texts, _text(""), _text("\n"))
    _, places, content = ended.buffers()
    bounds = np.frombuffer(places, np.int64)[ended.offset:ended.offset + len(ended) + 1]
    data = np.frombuffer(content, np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    kind = _KIND[data]
    solid = (kind > 0) & (kind < _HYPHEN)
    inside = solid.copy()
    inside[1:-1] |= (kind[1:-1] == _HYPHEN) & solid[:-2] & solid[2:]
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = change[::2], change[1::2]
    # a token begins with the first letter or digit of its run
    late = np.flatnonzero(kind[start] == _SIGN)
    if late.size:
        first = np.append(np.flatnonzero((kind == _DIGIT) | (kind == _LETTER)), len(data))
        start = start.copy()
        start[late] = first[np.searchsorted(first, start[late])]
        start, end = start[start < end], end[start < end]
    # and ends before the dots at its end
    end = end - (data[end - 1] == ord("."))
    dotted = np.flatnonzero(data[end - 1] == ord("."))
    if dotted.size:
        other = np.flatnonzero(data != ord("."))
        end[dotted] = other[np.searchsorted(other, end[dotted]) - 1] + 1
    step = np.zeros(len(data) + 1, np.int8)
    step[start], step[end] = 1, -1
    kept = _LOWER[data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]]
    ends = np.concatenate([[0], np.cumsum(end - start)])
    tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept))
    return np.diff(np.searchsorted(start, bounds)), tokens


class _Piece:
    """Terms of a few texts: ``row`` has ``known[first]``, with ``known[second - 1]`` after it unless that is 0."""

    def __init__(self, texts: pa.Array, words: pa.Array) -> None:
        counts, tokens = _tokens(texts)
        encoded = tokens.dictionary_encode()
        self.rows, self.known = len(texts), encoded.dictionary
        unfit = pc.or_(
            pc.or_(pc.less(pc.binary_length(self.known), 2), pc.ascii_is_decimal(self.known)),
            pc.is_in(self.known, value_set=words)).to_numpy(zero_copy_only=False)
        code = encoded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(self.rows), counts)
        fit = ~unfit[code]
        pair = np.flatnonzero(fit[:-1] & fit[1:] & (row[:-1] == row[1:]))
        self.row = np.concatenate([row[fit], row[pair]])
        self.first = np.concatenate([code[fit], code[pair]])
        self.second = np.concatenate([np.zeros(np.count_nonzero(fit), np.int64), code[pair + 1] + 1])

    def hashes(self) -> np.ndarray:
        """:func:`term_hash` of every term."""
        each = self.known.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        own = np.fromiter(map(crc32, each), np.int64, len(each))
        return (own * _FACTOR)[self.first] + np.concatenate([[0], own])[self.second]

    def select(self, kept: np.ndarray) -> None:
        self.row, self.first, self.second = self.row[kept], self.first[kept], self.second[kept]

    def settle(self) -> np.ndarray:
        """Keep one of each term of a row; how many every row has."""
        # within 63 bits: either few rows and bytes, or one row
        width = len(self.known) + 1
        key = np.sort((self.row * width + self.first) * width + self.second)
        key = key[np.diff(key, prepend=-1) != 0]
        rest = key // width
        self.row = rest // width
        self.first, self.second = rest - self.row * width, key - rest * width
        return np.bincount(self.row, minlength=self.rows)

    def names(self) -> pa.Array:
        after = pa.array(self.second - 1, mask=self.second == 0)
        return pc.binary_join_element_wise(
            self.known.take(pa.array(self.first)), self.known.take(after), _text(" "), null_handling="skip")


def _pieces(texts: pa.Array, stopwords):
    words = pa.array(list(stopwords), pa.large_string())
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    for letter in _FOREIGN:
        if pc.any(pc.match_substring(plain, letter)).as_py():
            plain = pc.replace_substring(plain, letter, letter.lower())
    size = np.cumsum(pc.binary_length(plain).to_numpy())
    begin = 0
    while begin < len(plain):
        before = size[begin - 1] if begin else 0
        end = int(np.searchsorted(size, before + PIECE_BYTES, "right"))
        end = max(begin + 1, min(end, begin + PIECE_ROWS))
        yield _Piece(plain.slice(begin, end - begin), words)
        begin = end


def _lists(texts: pa.Array, counts: list, values: list, kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.concat_arrays([pa.array([], kind), *values]),
        mask=texts.is_null() if texts.null_count else None)


def terms_of(texts: pa.Array, stopwords, keep=None) -> pa.Array:
    """Distinct unigrams and adjacent bigrams of each text, without stopwords and bare numbers.

    ``keep`` tells from an array of :func:`term_hash` which terms are wanted.
    """
    counts, values = [], []
    for piece in _pieces(texts, stopwords):
        if keep is not None:
            piece.select(keep(piece.hashes()))
        counts.append(piece.settle())
        values.append(piece.names())
    return _lists(texts, counts, values, pa.large_string())


def hashes_of(texts: pa.Array, stopwords) -> pa.Array:
    """:func:`term_hash` of each term of :func:`terms_of`."""
    counts, values = [], []
    for piece in _pieces(texts, stopwords):
        counts.append(piece.settle())
        values.append(pa.array(piece.hashes()))
    return _lists(texts, counts, values, pa.int64())
