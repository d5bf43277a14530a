"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text becomes an array of code-point classes. Each class is a transition function over
the few states of the pre-tokeniser; the functions form a small finite monoid, so they are
numbered, composed by table look-up, and an associative prefix scan gives the state before
every character at once. A token boundary depends on that state and the character. The
slices between boundaries are encoded by pair merging behind a cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Slices that a worker's cache holds before it starts afresh.
CACHE = 1 << 18
#: Slices longer than this are merged with a heap and not cached.
LONG = 128

# The characters with the Unicode property White_Space.
_SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# The suffixes that an apostrophe splits off, in order of preference.
_SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]

# Character classes. An apostrophe that would start a suffix has a class by the suffix's length;
# white space has a class by what follows it, as only the last of a run can go with the next token.
LETTER, NUMBER, OTHER, TICK1, TICK2, SPACE_LAST, WHITE_LAST, WHITE_MORE, RESET = range(9)
# States: what the token that is open after a character can still take.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, SUFFIX2, SUFFIX1 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at the character."""
    if kind == RESET:
        return START, True
    if state == SUFFIX2:
        return SUFFIX1, False
    if state == SUFFIX1:
        return START, False
    if kind in (LETTER, NUMBER, OTHER):
        own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[kind]
        return own, state not in (own, AFTER_SPACE)
    if kind in (TICK1, TICK2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (SUFFIX1 if kind == TICK1 else SUFFIX2), True
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == WHITE_LAST:
        return START, True
    return IN_WHITE, state != IN_WHITE


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, product table, whether an element is constant, its image of START, boundaries."""
    gens = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    elements = {g: i for i, g in enumerate(dict.fromkeys(gens))}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[f[s]] for s in range(8))
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    each = list(elements)
    product = np.array([[elements[tuple(b[a[s]] for s in range(8))] for b in each] for a in each], np.uint16)
    return (
        np.array([elements[g] for g in gens], np.uint16),
        product.ravel(),
        np.array([len(set(e)) == 1 for e in each]),
        np.array([e[START] for e in each], np.uint8),
        np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)]).ravel(),
    )


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point, before looking at its neighbours."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[_SPACES] = WHITE_MORE
    return table


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets at which pre-tokens start, and the length of the text at the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kinds = _classes()[points]
    white = kinds == WHITE_MORE
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[-1] = False  # at the end of the text a run is one token
    kinds[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
    for i in np.flatnonzero(points == 39):
        after = text[i + 1 : i + 3]
        match = next((s for s in _SUFFIXES if after.startswith(s)), None)
        if match:
            kinds[i] = TICK1 if len(match) == 1 else TICK2
    gens, product, constant, image, starts = _monoid()
    size = len(constant)
    scan, d = gens[kinds], 1
    while d < n:
        # Once the function before a character is constant, composing it with earlier ones changes nothing.
        open_ = np.flatnonzero(~constant[scan[d:]]) + d
        if not len(open_):
            break
        if 4 * len(open_) > n:
            scan[d:] = product[scan[:-d].astype(np.int32) * size + scan[d:]]
        else:
            scan[open_] = product[scan[open_ - d].astype(np.int32) * size + scan[open_]]
        d *= 2
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = image[scan[:-1]]
    return np.append(np.flatnonzero(starts[before.astype(np.int32) * 9 + kinds]), n)


class Encoder:
    """Encodes and decodes by a file of ranks; ``path`` is any tiktoken rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.lengths = np.array([len(x) for x in self.vocabulary], np.int64)
        self.cache = _Slices(self)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.vocabulary)
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            if i >= 0 and right[i] < n and (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or right[i] >= n or end[right[i]] != stop:
                continue
            j = right[i]
            alive[j], end[i], right[i] = False, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            push(left[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def ids(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        at = boundaries(text).tolist()
        return b"".join(map(self.cache.__getitem__, map(text.__getitem__, map(slice, at[:-1], at[1:]))))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and the byte offset of each token in the UTF-8 text."""
        ids = np.frombuffer(self.ids(text), "<u4")
        return ids, np.cumsum(self.lengths[ids]) - self.lengths[ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.asarray(ids).tolist()))


class _Slices(dict):
    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.merge(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and rank file."""
    return Encoder(path)


def tokenize(df: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``ids`` and ``offsets``.

    ``ranks`` is a rank file's name among the public tokenizers or a path that every
    worker can open. ``offsets`` are byte offsets of the tokens, enough to decode any
    range; the decoded digest is of the bytes that the ids stand for. Null and empty texts have no tokens; repeated rows give repeated results;
    an empty table gives no rows; a text is encoded as a whole, however long; only the two named
    columns are read, whatever others are called; special tokens are ordinary text.
    """
    wanted = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, offsets array<int>"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks if "/" in ranks else public_tokenizers.path(ranks))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(code.ids(text or ""), "<u4")
                offsets = (np.cumsum(code.lengths[ids]) - code.lengths[ids]).astype(np.int32)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest(), ids.view(np.int32), offsets))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) as `{id_col}`", f"cast(`{text_col}` as string) as `{text_col}`"), run, wanted)


def op8(docs: DataFrame) -> DataFrame:
    """Per document: number of tokens, digests of the ids and of the bytes decoded from them; see ``tokenize`` for awkward rows."""
    return tokenize(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
