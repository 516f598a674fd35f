"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokenisation uses no regular expression.  Each code point gets a class; the
classes (with one or two code points of look-ahead) drive a small automaton.
Its transition functions form a finite monoid, so a whole batch of texts is
scanned at once: the composition of transition functions is associative and is
looked up in a table, block by block.  A boundary stands where the automaton
begins a piece.  Pieces are merged by rank behind a cache.

Encodings keep byte offsets: token i of a text covers bytes offsets[i] up to
offsets[i + 1].  Decoding gathers token bytes by ids.

Nulls are empty texts; an empty text has no ids.  Texts of any length are
scanned in blocks, cut only before white space that follows other text, where
a piece always begins; so a text without white space is one block, for which a
task needs some tens of times its size.  Every row has a result, also repeated
ones; an empty table gives an empty one.  Only the id and text columns are read,
so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import lean

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
#: White space of the pre-tokenisation pattern (fixed values: Unicode White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 1 << 20
CACHED_PIECES = 600_000
#: Pieces of more bytes are merged one by one.
WIDE = 48

# Symbols: what the automaton reads at a code point.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_LAST_BLANK, S_LAST_WHITE, S_WHITE, S_BREAK = range(9)
# States: what the piece so far is.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, BLANK, IN_WHITE, SUFFIX_1, SUFFIX_2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]."""
    step = np.zeros((8, 9), np.uint8)
    begins = np.ones((8, 9), bool)
    for state in range(8):
        for symbol, run in ((S_LETTER, IN_LETTER), (S_NUMBER, IN_NUMBER), (S_OTHER, IN_OTHER)):
            step[state, symbol] = run
            begins[state, symbol] = state not in (run, BLANK)
        for symbol, left in ((S_SHORT, SUFFIX_1), (S_LONG, SUFFIX_2)):
            joins = state in (IN_OTHER, BLANK)
            step[state, symbol] = IN_OTHER if joins else left
            begins[state, symbol] = not joins
        step[state, S_LAST_BLANK] = BLANK
        step[state, S_LAST_WHITE] = FRESH
        step[state, S_WHITE] = IN_WHITE
        begins[state, S_WHITE] = state != IN_WHITE
        step[state, S_BREAK] = FRESH
    step[SUFFIX_2, S_LETTER], begins[SUFFIX_2, S_LETTER] = SUFFIX_1, False
    step[SUFFIX_1, S_LETTER], begins[SUFFIX_1, S_LETTER] = FRESH, False
    return step, begins


class Scanner:
    """Boundaries of pieces, by a scan over transition functions."""

    def __init__(self) -> None:
        kinds = np.zeros(0x110001, np.uint8)
        for point in range(0x110000):
            first = unicodedata.category(chr(point))[0]
            if first in "LN":
                kinds[point] = LETTER if first == "L" else NUMBER
        kinds[WHITE] = SPACE
        kinds[0x110000] = BREAK
        self.kinds = kinds
        self.step, self.begins = _automaton()
        functions = {tuple(range(8)): 0}
        letters = [functions.setdefault(tuple(map(int, self.step[:, s])), len(functions)) for s in range(9)]
        found = list(functions)
        while found:  # the closure under composition
            more = []
            for f in found:
                for s in range(9):
                    g = tuple(int(self.step[x, s]) for x in f)
                    if g not in functions:
                        functions[g] = len(functions)
                        more.append(g)
            found = more
        table = np.array(list(functions), np.uint8)
        self.size, self.apply = len(table), table
        self.letter = np.array(letters, np.uint16)
        compose = np.zeros((self.size, self.size), np.uint16)
        for a, f in enumerate(functions):
            for b, g in enumerate(functions):
                compose[a, b] = functions[tuple(g[x] for x in f)]
        self.compose = compose.ravel()

    def _after(self, f: np.ndarray) -> np.ndarray:
        """The composition of f[0..i] for every i."""
        n = len(f)
        if n <= 32:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.compose[int(out[i - 1]) * self.size + int(f[i])]
            return out
        width = 64 if n > 4096 else 16
        rows = -(-n // width)
        x = np.zeros(rows * width, np.uint16)
        x[:n] = f
        x = np.ascontiguousarray(x.reshape(rows, width).T)
        for j in range(1, width):
            x[j] = self.compose.take(x[j - 1].astype(np.int32) * self.size + x[j])
        if rows > 1:
            before = self._after(x[-1])[:-1].astype(np.int32) * self.size
            x[:, 1:] = self.compose.take(before[None, :] + x[:, 1:])
        return np.ascontiguousarray(x.T).ravel()[:n]

    def boundaries(self, points: np.ndarray) -> np.ndarray:
        """Where pieces begin in code points, texts of which end in a break (0x110000)."""
        kind = self.kinds[points]
        symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_BREAK], np.uint8)[kind]
        following = np.append(kind[1:], np.uint8(BREAK))
        last = (kind == SPACE) & (following != SPACE) & (following != BREAK)
        symbol[last] = S_LAST_WHITE
        symbol[last & (points == 0x20)] = S_LAST_BLANK
        quote = np.flatnonzero(points == 0x27)
        if len(quote):
            one, two = (points.take(quote + k, mode="clip") for k in (1, 2))
            symbol[quote[np.isin(one, [0x73, 0x74, 0x6D, 0x64])]] = S_SHORT
            pair = one.astype(np.uint64) << np.uint64(32) | two
            symbol[quote[np.isin(pair, [a << 32 | b for a, b in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C))])]] = S_LONG
        done = self._after(self.letter[symbol])
        state = np.empty(len(points), np.uint8)
        state[:1] = FRESH
        state[1:] = self.apply[done[:-1], FRESH]
        return np.flatnonzero(self.begins[state, symbol] & (kind != BREAK))


class Tokenizer:
    def __init__(self, ranks: bytes) -> None:
        """ranks: the lines of a vocabulary file, base64 of a token's bytes and its rank."""
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.scanner = Scanner()
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.packed = np.arange(size, dtype="<u4").tobytes()
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        self.none = np.int64(size + 1)
        joins = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    joins[a << 32 | b] = rank
        self.keys = np.array(sorted(joins), np.int64)
        self.ranked = np.array([joins[x] for x in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of 2 to WIDE bytes: each round merges the pair of lowest rank in every piece that has one."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        for low in range(0, len(order), 8192):
            own = order[low : low + 8192]
            lengths = np.array([len(pieces[k]) for k in own])
            width = int(lengths[-1])
            flat = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8)
            token = np.full((len(own), width), -1, np.int64)
            token[np.arange(width) < lengths[:, None]] = self.single[flat]
            pair = self._pair(token[:, :-1], token[:, 1:])
            rows, held = np.arange(len(own)), lengths.copy()
            done = token.copy()
            while len(rows):
                at = pair.argmin(1)
                best = pair[np.arange(len(rows)), at]
                live = best < self.none
                if not live.all():
                    done[rows[~live], : token.shape[1]] = token[~live]
                    rows, token, pair, at, best = rows[live], token[live], pair[live], at[live], best[live]
                    if not len(rows):
                        break
                held[rows] -= 1
                k = np.arange(len(rows))
                token[k, at] = best
                span = np.arange(token.shape[1] - 1)
                token = np.take_along_axis(token, span + (span > at[:, None]), 1)
                if token.shape[1] == 1:
                    done[rows, :1] = token
                    break
                pair = np.take_along_axis(pair, span[:-1] + (span[:-1] >= at[:, None]), 1)
                right, left = at < token.shape[1] - 1, at > 0
                pair[k[right], at[right]] = self._pair(best[right], token[k[right], at[right] + 1])
                pair[k[left], at[left] - 1] = self._pair(token[k[left], at[left] - 1], best[left])
            done = done.astype("<u4")
            for i, k in enumerate(own):
                out[k] = done[i, : held[i]].tobytes()
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's join; none where there is none (-1: past the end)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranked[at], self.none)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            if (j := after[i]) < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        gone = bytearray(n)
        while heap:
            _, i, to = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or end[j] != to:
                continue
            gone[j], end[i], after[i] = 1, to, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache."""
        short: list[tuple[str, bytes]] = []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:
                self.cache[piece] = self.packed[rank * 4 : rank * 4 + 4]
            elif len(data) > WIDE:
                self.cache[piece] = np.array(self._merge_long(data), "<u4").tobytes()
            else:
                short.append((piece, data))
        for (piece, _), ids in zip(short, self._merge_all([x for _, x in short]), strict=True):
            self.cache[piece] = ids

    def _parts(self, text: str) -> Iterator[str]:
        """text in blocks; a block ends where white space follows something else."""
        at, n = 0, len(text)
        white = self.scanner.kinds
        while n - at > BLOCK:
            to = at + BLOCK
            while to < n and not (white[ord(text[to])] == SPACE and white[ord(text[to - 1])] != SPACE):
                to += 1
            yield text[at:to]
            at = to
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        work: list[tuple[int, str]] = []
        held = 0
        for k, text in enumerate(texts):
            for part in self._parts(text):
                work.append((k, part))
                held += len(part)
                if held >= BLOCK:
                    self._encode(work, out)
                    work, held = [], 0
        self._encode(work, out)
        return [np.frombuffer(b"".join(x), "<u4") for x in out]

    def _encode(self, work: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        if not work:
            return
        stop = np.array([0x110000], "<u4")
        points = np.concatenate([x for _, t in work for x in (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), stop)])
        begin = self.scanner.boundaries(points)
        ends = np.cumsum([len(t) + 1 for _, t in work])
        upto = np.searchsorted(begin, ends)
        pieces: list[str] = []
        low, base = 0, 0
        for (_, text), high, end in zip(work, upto.tolist(), ends.tolist(), strict=True):
            at = (begin[low:high] - base).tolist()
            at.append(len(text))
            pieces.extend([text[i:j] for i, j in zip(at, at[1:])])
            low, base = high, end
        ids = list(map(self.cache.get, pieces))
        if None in ids:
            missing = {p for p, x in zip(pieces, ids, strict=True) if x is None}
            if len(self.cache) + len(missing) > CACHED_PIECES:
                self.cache.clear()
            self._learn(missing)
            ids = [self.cache[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
        low = 0
        for (k, _), high in zip(work, upto.tolist(), strict=True):
            out[k].append(b"".join(ids[low:high]))
            low = high

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens, and the length of all at the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        at = self.offsets(ids)
        out = bytearray()
        for i in range(0, len(ids), BLOCK):
            own, lengths = ids[i : i + BLOCK], self.lengths[ids[i : i + BLOCK]]
            first = at[i : i + len(own)] - at[i]
            out += self.blob[np.repeat(self.starts[own] - first, lengths) + np.arange(int(lengths.sum()))].tobytes()
        return bytes(out)




class _Ranks:
    """A broadcast vocabulary, alike for the cache if its digest is."""

    def __init__(self, broadcast, digest: str) -> None:
        self.broadcast, self.digest = broadcast, digest

    def tokenizer(self) -> Tokenizer:
        found = _held.get(self.digest)
        if found is None:
            found = _held[self.digest] = Tokenizer(self.broadcast.value)
        return found


_held: dict[str, Tokenizer] = {}


def ranks_of(spark, path: str) -> _Ranks:
    """The vocabulary file at path, sent to the executors once (a file has one size, about 1 MB, whatever the corpus)."""
    with open(path, "rb") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} has {len(data)} bytes; a vocabulary may have 64 MB")
    return _Ranks(spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest())


def _chunks(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(lengths):
        held += n
        if held >= most:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(lengths):
        yield low, len(lengths)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, ids (binary, little-endian unsigned 32 bit).

    offsets: also offsets (binary, the same coding, one more than ids).
    decoded: also decoded (binary), what decoding the ids gives.
    Null texts are empty.  Only id_col and text_col are read.
    """
    spark = docs.sparkSession
    ranks = ranks_of(spark, path)
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, ids binary" + ", offsets binary" * offsets + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ranks.tokenizer()
        try:
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                for low, high in _chunks(texts):
                    ids = tokenizer.encode([x or "" for x in texts.slice(low, high - low).to_pylist()])
                    columns = [keys.slice(low, high - low), pa.array([x.tobytes() for x in ids], pa.binary())]
                    if offsets:
                        columns.append(pa.array([tokenizer.offsets(x).astype("<u4").tobytes() for x in ids], pa.binary()))
                    if decoded:
                        columns.append(pa.array([tokenizer.decode(x) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", *["offsets"] * offsets, *["decoded"] * decoded])
        finally:
            tokenizer.cache.clear()  # the worker stays, and other stages need the room

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of encoded (id_col, ids): id_col, decoded (binary).  Null ids decode to nothing."""
    ranks = ranks_of(encoded.sparkSession, path)
    kind = encoded.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ranks.tokenizer()
        for batch in batches:
            texts = [tokenizer.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(lean(run), f"{id_col} {kind.simpleString()}, decoded binary")
