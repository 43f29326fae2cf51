"""Encoding with a public byte-level BPE vocabulary, vectorised over whole Arrow batches.

1. All texts of a batch become one array of code points; a lookup table gives each its class.
2. Where tokens begin is the output of a finite automaton with eight states. Its run over the array isn't a loop over
   characters: each character is a *function* from state to state, composition of functions is associative, so the state
   before every character is a prefix scan, done with numpy over blocks and then over the blocks' composites.
3. The slices between beginnings are merged by rank; each distinct slice is merged once and cached.

The byte offset of every token is kept, so a span of ids leads back to its span of the text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyline.plans.lineage import spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices kept in the cache of merges before it is emptied.
CACHE_SLICES = 400_000
#: Code points handled at once; longer texts form a chunk of their own.
CHUNK = 1 << 20
BLOCK = 128

# Symbols of the automaton. A blank or other white space is *last* if a character that is none follows.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, BLANK_LAST, BLANK, SPACE_LAST, SPACE, END = range(10)
# States: which token is open. CLOSED: none; JOINED: a blank that the next token takes in; ONE, TWO: letters to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACE, ONE, TWO = range(8)
N_STATES = 8

#: Code points with the property White_Space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
END_POINT = 0x110000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol and state."""
    go = np.zeros((10, N_STATES), np.uint8)
    begins = np.ones((10, N_STATES), bool)

    def runs(symbol: int, state: int, otherwise: int) -> None:
        go[symbol] = otherwise
        for held in (state, JOINED):
            go[symbol, held], begins[symbol, held] = state, False

    runs(LETTER, IN_LETTERS, IN_LETTERS)
    go[LETTER, TWO], go[LETTER, ONE] = ONE, CLOSED
    begins[LETTER, [TWO, ONE]] = False
    runs(NUMBER, IN_NUMBERS, IN_NUMBERS)
    runs(OTHER, IN_OTHERS, IN_OTHERS)
    runs(QUOTE1, IN_OTHERS, ONE)
    runs(QUOTE2, IN_OTHERS, TWO)
    go[BLANK_LAST] = JOINED
    go[SPACE_LAST] = CLOSED
    for symbol in (BLANK, SPACE):
        go[symbol] = IN_SPACE
        begins[symbol, IN_SPACE] = False
    go[END] = CLOSED
    return go, begins


GO, BEGINS = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER, BLANK, SPACE or END."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(END_POINT)), np.uint8, END_POINT)
    table = np.append(table, np.uint8(END))
    table[list(WHITE_SPACE)] = SPACE
    table[32] = BLANK
    return table


def states_before(symbols: np.ndarray, go: np.ndarray = GO, first: int = CLOSED) -> np.ndarray:
    """State before each symbol, by an associative scan of the symbols' transition functions.

    Blocks are rows; step j composes the j-th function of all blocks at once. The composites of whole blocks are scanned
    the same way, and every block's entry state then selects among the composed functions.
    """
    n, k = len(symbols), go.shape[1]
    if n <= BLOCK:
        out, state = np.empty(n, np.uint8), first
        for i, s in enumerate(symbols.tolist()):
            out[i] = state
            state = go[s, state]
        return out
    n_blocks = -(-n // BLOCK)
    padded = np.full(n_blocks * BLOCK, END, np.uint8)
    padded[:n] = symbols
    padded = padded.reshape(n_blocks, BLOCK)
    prefix = np.empty((BLOCK, n_blocks, k), np.uint8)  # prefix[j]: the functions before symbol j, composed
    now = np.broadcast_to(np.arange(k, dtype=np.uint8), (n_blocks, k))
    for j in range(BLOCK):
        prefix[j] = now
        now = go[padded[:, j, None], now]
    entry = _entries(now, first)
    return prefix[:, np.arange(n_blocks), entry].T.reshape(-1)[:n]


def _entries(blocks: np.ndarray, first: int) -> np.ndarray:
    """State before each block, given the blocks' composed functions: a scan by doubling."""
    total, step = blocks.copy(), 1
    while step < len(total):
        later = np.take_along_axis(total[step:], total[:-step].astype(np.intp), 1)
        total = np.concatenate([total[:step], later])
        step *= 2
    return np.concatenate([[first], total[:-1, first]]).astype(np.intp)


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Symbols of code points, in which every text is followed by END_POINT."""
    kinds = _classes()[points]
    ahead = np.append(kinds[1:], np.uint8(END))
    white = (kinds == BLANK) | (kinds == SPACE)
    last = white & ((ahead == LETTER) | (ahead == NUMBER) | (ahead == OTHER))
    out = np.where(last, kinds - 1, kinds)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        one = points[np.minimum(quotes + 1, len(points) - 1)]
        two = points[np.minimum(quotes + 2, len(points) - 1)]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[pairs]] = QUOTE2
    return out


class Encoder:
    """Ids of texts by a rank file (one base64 token and its rank a line)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}

    @classmethod
    def load(cls, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Encoder:
        lines = Path(folder, name).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})

    def _merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges in order of (rank, place) with a heap: a slice of any length in n log n."""
        import heapq

        ranks, n = self.ranks, len(piece)
        size, after, before = [1] * n, [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(piece[i : j + size[j]])) is not None:
                heapq.heappush(heap, (r, i, size[i] + size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, length = heapq.heappop(heap)
            if not size[i] or (j := after[i]) >= n or size[i] + size[j] != length:
                continue
            size[i], size[j], after[i] = length, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[piece[i : i + size[i]]] for i in range(n) if size[i]]

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(all bytes, where each slice begins and ends, how many slices each text has)."""
        chunks: list[np.ndarray] = []
        for t in texts:
            chunks += [np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([END_POINT], np.uint32)]
        points = np.concatenate(chunks)
        symbols = symbols_of(points)
        begins = BEGINS[symbols, states_before(symbols)]
        ends = points == END_POINT
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width[ends] = 0
        at = np.concatenate([[0], np.cumsum(width)])
        first = np.flatnonzero(begins & ~ends)
        edges = np.append(at[first], at[-1])
        per_text = np.diff(np.searchsorted(first, np.flatnonzero(ends)), prepend=0)
        return "".join(texts).encode(), edges, per_text

    def encode_batch(self, texts: list[str | None], offsets: bool = False) -> list[list[int]] | list[tuple[list[int], list[int]]]:
        """Ids of each text, none for an empty or null one; with ``offsets`` also the byte where each token begins."""
        full = [t or "" for t in texts]
        out: list = []
        at = 0
        while at < len(full):
            size, stop = 0, at
            while stop < len(full) and (stop == at or size + len(full[stop]) <= CHUNK):
                size += len(full[stop])
                stop += 1
            data, edges, per_text = self.slices(full[at:stop])
            bounds, k, cache, merge = edges.tolist(), 0, self.cache, self._merge
            for n in per_text.tolist():
                ids: list[int] = []
                for j in range(k, k + n):
                    piece = data[bounds[j] : bounds[j + 1]]
                    found = cache.get(piece)
                    if found is None:
                        if len(cache) >= CACHE_SLICES:
                            cache.clear()
                        found = cache[piece] = merge(piece)
                    ids += found
                out.append((ids, self._offsets(ids)) if offsets else ids)
                k += n
            at = stop
        return out

    @property
    def tokens(self) -> list[bytes]:
        return [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]

    def _offsets(self, ids: list[int]) -> list[int]:
        tokens = self.__dict__.setdefault("_tokens", self.tokens)
        return np.cumsum([0, *(len(tokens[i]) for i in ids)])[:-1].tolist()

    def decode(self, ids: list[int]) -> str:
        tokens = self.__dict__.setdefault("_tokens", self.tokens)
        return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def _encoder(folder: str, name: str) -> Encoder:
    return Encoder.load(folder, name)


def _mapped(df: DataFrame, keys: list[str], text: str, schema: str, last, folder: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, name)
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keys))]
            texts = batch.column(len(keys)).to_pylist()
            yield pa.RecordBatch.from_arrays([*columns, *last(encoder, texts)], names=[*keys, *names])

    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(df.select(*keys, text)).mapInArrow(run, f"{kinds}, {schema}")


def encode(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of every row; an empty or null text has an empty list.

    No special tokens: their spellings in a text are ordinary characters. Whole texts of any length, one narrow pass
    without a shuffle; repeated rows are encoded each. Other columns don't reach the scan.
    """

    def ids(encoder: Encoder, texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(encoder.encode_batch(texts), pa.list_(pa.int32()))]

    return _mapped(df, keys, text, "ids array<int>", ids, folder, name)


def encode_with_offsets(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Like ``encode``, with ``offsets``: the byte of the UTF-8 text at which each token begins."""

    def both(encoder: Encoder, texts: list[str | None]) -> list[pa.Array]:
        pairs = encoder.encode_batch(texts, offsets=True)
        return [pa.array([a for a, _ in pairs], pa.list_(pa.int32())), pa.array([b for _, b in pairs], pa.list_(pa.int64()))]

    return _mapped(df, keys, text, "ids array<int>, offsets array<bigint>", both, folder, name)


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row, 0 for an empty or null text."""

    def sizes(encoder: Encoder, texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([len(x) for x in encoder.encode_batch(texts)], pa.int64())]

    return _mapped(df, keys, text, "n_tokens bigint", sizes, folder, name)
