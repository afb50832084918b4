"""The tokens of ``code_terms`` and ``plain_tokens`` for whole Arrow columns, by tables over bytes.

Both kinds of tokens are made of ASCII letters, digits and underscores, and where one begins is settled by the classes of a
byte and its neighbours, so a worker looks at all bytes of a slice of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text as T

#: Bytes of the texts that are looked at at a time; a longer text stands alone.
SLICE = 1 << 21
NONE, SMALL, LARGE, DIGIT, LINE = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    for first, last, k in (("a", "z", SMALL), ("A", "Z", LARGE), ("0", "9", DIGIT), ("_", "_", LINE)):
        kind[ord(first) : ord(last) + 1] = k
    low[ord("A") : ord("Z") + 1] += 32
    return kind, low


def _table(begins) -> np.ndarray:
    """Whether a token begins at a byte, by the classes of the byte before, its own and that of the next."""
    return np.array([begins(p, c, n) for p in range(5) for c in range(5) for n in range(5)])


KIND, LOW = _classes()
#: A piece of a name: digits, small letters with a capital before them, or capitals up to the last one before a small letter.
PIECE = _table(lambda p, c, n: (c == DIGIT and p != DIGIT) or (c == SMALL and p not in (SMALL, LARGE)) or (c == LARGE and (p != LARGE or n == SMALL)))
#: A plain token, but for letters after digits that begin one.
PLAIN = _table(lambda p, c, n: c in (SMALL, LARGE, DIGIT) and (p in (NONE, LINE) or (c == LARGE and p in (SMALL, DIGIT))))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with about ``most`` bytes of text."""
    if len(column) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    yield start, len(sizes) - start


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of each row): the texts, nulls as empty ones, with a byte of no token after each."""
    ended = pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    at = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(ended.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _marked(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether a token begins there)."""
    kind = KIND[data]
    code = kind * np.uint8(5)
    code[1:] += kind[:-1] * np.uint8(25)
    code[:-1] += kind[1:]
    return kind, table[code]


def _strings(data: np.ndarray, kept: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The tokens in lower case: of the bytes ``kept``, from each byte where one ``begins`` to the next."""
    held = LOW[data[kept]]
    cuts = np.append(np.flatnonzero(begins[kept]), len(held)).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(held))


def plain(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all rows, each one's row) by ``plain_tokens``."""
    data, rows = _bytes(column)
    kind, begins = _marked(data, PLAIN)
    after = np.flatnonzero((kind[1:] == SMALL) & (kind[:-1] == DIGIT)) + 1
    if len(after):  # letters after digits begin a token if nothing but the digits is before them
        other = np.flatnonzero(kind != DIGIT)
        place = np.searchsorted(other, after) - 1
        before = np.where(place >= 0, kind[other[place]], NONE)
        begins[after[(before == NONE) | (before == LINE)]] = True
    kept = (kind != NONE) & (kind != LINE)
    return _strings(data, kept, begins), np.searchsorted(rows, np.flatnonzero(begins), "right") - 1


def code(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all rows, each one's row) by ``code_terms``: pieces of names without stop words, and names of several pieces."""
    data, rows = _bytes(column)
    kind, begins = _marked(data, PIECE)
    starts = np.flatnonzero(begins)
    pieces = _strings(data, (kind != NONE) & (kind != LINE), begins).dictionary_encode()
    stop = pc.is_in(pieces.dictionary, value_set=pa.array(T.STOPWORDS)).to_numpy(zero_copy_only=False)
    good = ~stop[pieces.indices.to_numpy()] if len(stop) else np.zeros(0, bool)
    tokens, row = pieces.filter(pa.array(good)), np.searchsorted(rows, starts[good], "right") - 1
    inner = starts[kind[starts - 1] != NONE] if len(starts) and starts[0] else starts[1:][kind[starts[1:] - 1] != NONE]
    if len(inner):  # only runs of letters, digits and underscores with such a place can be names of several pieces
        gaps = np.flatnonzero(kind == NONE)
        end = np.unique(np.searchsorted(gaps, inner))
        first, last = np.where(end > 0, gaps[end - 1] + 1, 0), gaps[end]
        digits = np.flatnonzero(kind[first] == DIGIT)
        if len(digits):  # digits before a name are a name of their own
            other = np.flatnonzero(kind != DIGIT)
            first[digits] = other[np.searchsorted(other, first[digits])]
        several = np.searchsorted(starts, last) - np.searchsorted(starts, first) > 1
        first, last = first[several], last[several]
        low = LOW[data].tobytes() if len(first) > 64 else None
        names = pa.array([(low[a:b] if low is not None else LOW[data[a:b]].tobytes()).decode("ascii") for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.string())
        tokens, row = pa.concat_arrays([tokens.cast(pa.string()), names]), np.concatenate((row, np.searchsorted(rows, first, "right") - 1))
    return tokens, row


#: By the expressions that give the same tokens.
BY = {T.code_terms: code, T.code_tokens: code, T.plain_tokens: plain}


def encoded(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct tokens, place of each token among them)."""
    held = tokens if pa.types.is_dictionary(tokens.type) else tokens.dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
