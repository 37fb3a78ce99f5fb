"""Byte-level BPE encoding of a column of texts.

Pre-tokenisation works on a whole batch at once: the texts become one array of code points, each code point
becomes a symbol (its class, and what the next one or two decide), and a finite automaton over those symbols
says before which code points a piece begins. The automaton is run as a scan of transition functions: the
symbols are laid out as blocks side by side, every block composes the functions of its symbols for all states
at once, the blocks' functions are chained, and then every block is run again from its true first state.
Composition is associative, so blocks can be of any size. No regular expression is involved.

Each distinct piece is merged once per worker; the pieces' ids are kept. Offsets are code point offsets of
each token's piece start plus its byte length, so ids can be traced and decoded.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Symbols. The last four are white space: a space or another blank, followed by more of it (or the end) or not.
L, N, O, A2, A3, SPM, SPL, WSM, WSL = range(9)
_FIRST = 9  # added to the symbol of a text's first code point
#: States: nothing open, in letters, in numbers, in others, in blanks, a lone space that the next piece takes, a contraction of which 1 or 2 are left.
S_START, S_L, S_N, S_O, S_W, S_P, S_C1, S_C2 = range(8)

#: Code points that count as white space (fixed values of the Unicode property White_Space).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points taken together in one scan; a longer text is a scan of its own.
CHUNK = 1_000_000
#: Distinct pieces whose ids a worker keeps before it starts anew.
CACHE_PIECES = 500_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; next state and "a piece begins here" of each symbol and state."""
    kind = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = L
        elif k == "N":
            kind[c] = N
    kind[WHITE] = WSM
    kind[32] = SPM
    start = {L: S_L, N: S_N, O: S_O, A2: S_C1, A3: S_C2, SPM: S_W, SPL: S_P, WSM: S_W, WSL: S_START}
    nxt = np.zeros((18, 8), np.uint8)
    new = np.ones((18, 8), bool)
    for sym in range(9):
        nxt[sym] = nxt[sym + _FIRST] = start[sym]
    for state, sym, to in [
        (S_L, L, S_L), (S_N, N, S_N), (S_O, O, S_O), (S_O, A2, S_O), (S_O, A3, S_O), (S_W, SPM, S_W), (S_W, WSM, S_W),
        (S_P, L, S_L), (S_P, N, S_N), (S_P, O, S_O), (S_P, A2, S_O), (S_P, A3, S_O),
    ]:
        nxt[sym, state], new[sym, state] = to, False
    for sym in range(9):
        nxt[sym, S_C1], new[sym, S_C1] = S_START, False
        nxt[sym, S_C2], new[sym, S_C2] = S_C1, False
    return kind, nxt, new


_KIND: list[tuple] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _KIND:
        _KIND.append(_tables())
    return _KIND[0]


def _symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; first: positions at which texts begin (texts are not empty)."""
    kind = tables()[0]
    sym = kind[np.minimum(cp, 0x10FFFF)]
    n = len(cp)
    begins = np.zeros(n + 3, bool)
    begins[first] = True
    begins[n:] = True
    after = np.zeros(n + 2, cp.dtype)
    after[:n] = cp
    one, two = after[1 : n + 1], after[2 : n + 2]
    inside1, inside2 = ~begins[1 : n + 1], ~begins[1 : n + 1] & ~begins[2 : n + 2]
    blank = sym >= SPM
    more = np.zeros(n, bool)
    more[:-1] = blank[1:]
    last = blank & inside1 & ~more
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        a, b = one[quote], two[quote]
        short = inside1[quote] & np.isin(a, [ord(c) for c in "stmd"])
        long = inside2[quote] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        sym[quote[long]] = A3
        sym[quote[short]] = A2
    sym[last] += 1
    sym[first] += _FIRST
    return sym


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, by a blocked scan of transition functions."""
    _, nxt, new = tables()
    sym = _symbols(cp, first)
    n = len(sym)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.intp)
    padded[:n] = sym
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T) * 8
    flat = nxt.ravel().astype(np.intp)
    fun = np.broadcast_to(np.arange(8), (blocks, 8))
    for row in grid:
        fun = flat[row[:, None] + fun]
    state = np.zeros(blocks, np.intp)
    at = S_START
    for k in range(blocks):
        state[k] = at
        at = fun[k, at]
    begin = np.empty((width, blocks), bool)
    newly = new.ravel()
    for j, row in enumerate(grid):
        here = row + state
        begin[j] = newly[here]
        state = flat[here]
    return np.flatnonzero(begin.T.ravel()[:n])


class Encoder:
    """Ids of pieces, from a file of ranks (a base64 token and its id in each line)."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.token = {v: k for k, v in self.ranks.items()}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of lowest rank is merged first, of equals the leftmost."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        n = len(piece)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] == n or end[end[i]] != to:
                continue
            alive[end[i]] = False
            end[i] = to
            if to < n:
                left[to] = i
                if (r := rank(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (j := left[i]) >= 0 and (r := rank(piece[j:to])) is not None:
                heapq.heappush(heap, (r, j, to))
        return tuple(self.ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            got = self.merge(text.encode("utf-8", "replace"))
            if len(text) <= 64:
                self.cache[text] = got
        return got

    def chunk(self, texts: list[str], counts: bool) -> tuple[list, list]:
        """Ids (or their number) and piece offsets of texts, none of them empty."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.cumsum([0, *map(len, texts)])
        starts = piece_starts(cp, edge[:-1])
        cut = starts.tolist() + [len(joined)]
        upto = np.searchsorted(starts, edge).tolist()
        ids, offsets, know, learn = [], [], self.cache.get, self.piece
        for k, base in enumerate(edge[:-1].tolist()):
            a, b = upto[k], upto[k + 1]
            pieces = [joined[i:j] for i, j in zip(cut[a:b], cut[a + 1 : b + 1])]
            got = [know(p) or learn(p) for p in pieces]
            if counts:
                ids.append(sum(map(len, got)))
            else:
                ids.append([t for g in got for t in g])
                offsets.append([i - base for g, i in zip(got, cut[a:b]) for _ in g])
        return ids, offsets

    def encode(self, texts: list[str | None], counts: bool = False) -> tuple[list, list]:
        """For each text its ids (counts: their number) and, for each id, the code point offset of its piece."""
        ids: list = [0 if counts else []] * len(texts)
        offsets: list = [[]] * len(texts)
        at, size = [], 0

        def flush() -> None:
            nonlocal at, size
            if at:
                got, off = self.chunk([texts[i] for i in at], counts)
                for k, i in enumerate(at):
                    ids[i] = got[k]
                    if not counts:
                        offsets[i] = off[k]
            at, size = [], 0

        for i, x in enumerate(texts):
            if x:
                if size and size + len(x) > CHUNK:
                    flush()
                at.append(i)
                size += len(x)
        flush()
        return ids, offsets

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    key = hash(ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _run(df: DataFrame, text: str, keep: dict[str, str], ranks_path: str, made: list[T.StructField], work) -> DataFrame:
    """Projects df to text and the kept columns, and adds what `work` makes of each batch's texts."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(_ranks(ranks_path))  # one vocabulary file, below 1 MB
    slim = df.select(*[F.col(f"`{c}`").alias(name) for c, name in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], *made])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                cols = work(enc, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=schema.names)

    return slim.mapInArrow(batches, schema)


def encode(df: DataFrame, text: str, keep: list[str], ranks_path: str = DEFAULT_RANKS, offsets: bool = False) -> DataFrame:
    """keep columns, ids ARRAY<INT>, and with offsets=True piece_offsets ARRAY<INT> (code points into the text).

    An empty or null text has an empty list. Special tokens are neither added nor recognised: their strings are
    ordinary text. Repeated rows are encoded each; an empty table gives no rows. A kept column that would clash
    with a made one isn't allowed to be called ids or piece_offsets; other columns of df don't matter.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        made.append(T.StructField("piece_offsets", T.ArrayType(T.IntegerType(), False), False))

    def work(enc: Encoder, texts: list) -> list:
        ids, off = enc.encode(texts)
        return [pa.array(ids, pa.list_(pa.int32()))] + ([pa.array(off, pa.list_(pa.int32()))] if offsets else [])

    return _run(df, text, {c: c for c in keep}, ranks_path, made, work)


def count_tokens(df: DataFrame, text: str, keep: list[str], ranks_path: str = DEFAULT_RANKS, name: str = "n_tokens") -> DataFrame:
    """keep columns and the number of tokens of each text, 0 for an empty or null one."""
    made = [T.StructField(name, T.LongType(), False)]
    return _run(df, text, {c: c for c in keep}, ranks_path, made, lambda enc, texts: [pa.array(enc.encode(texts, counts=True)[0], pa.int64())])


def decode(df: DataFrame, ids: str, keep: list[str], ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """keep columns and text STRING, the text of a list of ids; null for null."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(_ranks(ranks_path))
    slim = df.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in it:
            texts = [None if x is None else enc.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return slim.mapInArrow(batches, schema)


assert sys.byteorder == "little", "code points are read as little-endian"
