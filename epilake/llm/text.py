"""Vectorised word hashing over Arrow batches, for operators that run as `mapInArrow`.

Texts are handled whole. Temporaries per byte exist only for blocks of BLOCK
bytes (or one longer word), so memory follows the longest text by its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
#: Bytes of text that are handled at once; a longer text is a group of its own.
GROUP = 1 << 21
_U = np.uint64

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLD = _TABLE.copy()
_FOLD[65:91] = _FOLD[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and digits and bytes of longer characters.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = PUNCT[128:] = False
#: Classes of bytes: runs of letters and digits, and runs of punctuation, are tokens of their own.
TOKENS = np.where(SPACE, 0, np.where(PUNCT, 2, 1)).astype(np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        n = max(n, BLOCK + 4096)
        got = np.empty(n, np.uint64)
        got[0] = 1
        have = 1
        with np.errstate(over="ignore"):
            while have < n:
                more = min(have, n - have)
                got[have:have + more] = got[:more] * _U(pow(base, have, 1 << 64))
                have += more
        _POWERS[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `limit` bytes, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _pieces(text: bytes, sep: np.ndarray) -> Iterator[bytes]:
    """A long text cut before separators into pieces of about BLOCK bytes."""
    a = np.frombuffer(text, np.uint8)
    at = 0
    while len(a) - at > BLOCK:
        end = at + BLOCK
        cut = np.flatnonzero(sep[a[at:end]])
        while not len(cut) and end < len(a):  # one word longer than a block
            end = min(len(a), end + BLOCK)
            cut = np.flatnonzero(sep[a[at:end]])
        if not len(cut):
            break
        to = at + int(cut[-1])
        if to == at:
            nxt = np.flatnonzero(sep[a[at + 1:]])
            to = at + 1 + int(nxt[0]) if len(nxt) else len(a)
        yield text[at:to]
        at = to
    yield text[at:]


def _blocks(texts: list[bytes], sep: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, list[int]]]:
    """Joined blocks with the start of each part and the text that it belongs to."""
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush():
        lens = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        return b" ".join(parts) + b" ", np.cumsum(lens) - lens, list(owner)

    for i, t in enumerate(texts):
        for p in [t] if len(t) <= BLOCK else _pieces(t, sep):
            if parts and size + len(p) > BLOCK:
                yield flush()
                parts, owner, size = [], [], 0
            parts.append(p)
            owner.append(i)
            size += len(p) + 1
    if parts:
        yield flush()


def _fold_latin(b: np.ndarray) -> np.ndarray:
    """Capital letters of Latin-1 (bytes C3 80 to C3 9E, but for the multiplication sign) in lower case."""
    capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    out = b.copy()
    out[1:][capital] += 0x20
    return out


def words(texts: list[bytes], sep: np.ndarray = SPACE, fold: bool = True, latin: bool = False,
          also: Callable | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the words of all texts in order, the number of words of each text, and
    what `also(bytes as uint8, starts, ends, hash)` gives for the words of each block.

    sep: separators, or classes of bytes of which 0 separates and a change of class ends a word.
    fold: A-Z as a-z; latin: the same for the other letters of Latin-1.
    """
    table = _FOLD if fold else _TABLE
    classes = np.where(sep, 0, 1).astype(np.uint8) if sep.dtype == bool else sep
    sep = classes == 0
    counts = np.zeros(len(texts), np.int64)
    hashes, more = [], []
    for block, at, owner in _blocks(texts, sep):
        b = np.frombuffer(block, np.uint8)
        kind = classes[b]
        edge = np.flatnonzero(np.append(kind[:1] != 0, kind[1:] != kind[:-1]))
        starts = edge[kind[edge] != 0]
        ends = edge[edge > 0]
        ends = ends[kind[ends - 1] != 0]  # a block ends with a separator
        with np.errstate(over="ignore"):
            sums = np.empty(len(b) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[_fold_latin(b) if latin else b] * _powers(_BASE, len(b))[:len(b)], out=sums[1:])

            def span(s, e, sums=sums):
                return mix((sums[e] - sums[s]) * _powers(_INVERSE, len(sums))[s] + (e - s).astype(np.uint64))

            h = span(starts, ends)
        hashes.append(h)
        np.add.at(counts, np.asarray(owner), np.diff(np.searchsorted(starts, at), append=len(starts)))
        if also:
            more.append(also(b, starts, ends, span))
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    extra = [np.concatenate(x) for x in zip(*more)] if more else []
    return h, counts, extra


def grams(h: np.ndarray, counts: np.ndarray, n: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each text, and their number for each text.

    whole: a text of 1 to n-1 words gives one window of all its words; else none.
    """
    total = len(h)
    many = np.maximum(counts - n + 1, 0)
    starts = np.cumsum(counts) - counts
    q = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    with np.errstate(over="ignore"):
        if total >= n:
            roll = h[:total - n + 1] * q[0]
            for k in range(1, n):
                roll = roll + h[k:total - n + 1 + k] * q[k]
            roll = mix(roll + _U(n))
        else:
            roll = np.empty(0, np.uint64)
        keep = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out = roll[keep]
        if whole:
            short = np.flatnonzero((counts > 0) & (counts < n))
            if len(short):
                one = np.empty(len(short), np.uint64)
                for i, s in enumerate(short):
                    v = h[starts[s]:starts[s] + counts[s]]
                    one[i] = (v * np.array(q[:len(v)], np.uint64)).sum(dtype=np.uint64) + _U(len(v))
                many = many.copy()
                many[short] = 1
                at = (np.cumsum(many) - many)[short] - np.arange(len(short))
                out = np.insert(out, at, mix(one))
    return out, many
