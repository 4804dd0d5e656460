"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers give the count. The first cuts a text into words: eight states over character classes, with a
word emitted on some transitions. It runs over chunks of all texts at once: every chunk's state map (exit state for
each entry state) is composed with those before it by a parallel prefix scan, so that a second pass knows where each
chunk begins. The second reads a word byte by byte; each transition is annotated with the tokens it adds, and the sum along a
word's path is its token count. It is compiled as words need it, all new transitions of a step together, and holds a
bounded number of states.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .textcode import code_points, slices

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
CHUNK = 256
#: Longer words (bytes) are merged one by one, without states.
LONG = 64
#: Slots of the transition table, half of which are used before the machine starts anew.
SLOTS = 1 << 22

# States of the word transducer: what the word that is open consists of.
FRESH, LETTERS, NUMBERS, OTHERS, SPACED, BLANKS, LAST1, LAST2 = range(8)
# Character classes. A blank before a non-blank is PREFIX (the space itself) or LONE; other blanks are BLANK. SHORT2 and
# SHORT3 are apostrophes that begin 's 't 'm 'd and 're 've 'll. FIRST is added at the start of a text.
LETTER, NUMBER, OTHER, SHORT2, SHORT3, PREFIX, LONE, BLANK = range(8)
FIRST = 8
EMIT = 8


def word_transducer() -> np.ndarray:
    """[class, state] to the next state, with EMIT added where a new word begins."""
    table = np.zeros((16, 8), np.uint8)
    runs = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT2: OTHERS, SHORT3: OTHERS}
    begins = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT2: LAST1, SHORT3: LAST2, PREFIX: SPACED, LONE: FRESH, BLANK: BLANKS}
    for c, to in begins.items():
        table[c, :] = to + EMIT
        if c in runs:  # goes on with a run of its kind, or joins the space before
            table[c, [runs[c], SPACED]] = runs[c]
        table[c + FIRST, :] = to + EMIT
    table[BLANK, BLANKS] = BLANKS
    table[LETTER, LAST1], table[LETTER, LAST2] = FRESH, LAST1
    return table


def compose(maps: np.ndarray) -> np.ndarray:
    """maps[i, s]: where chunk i leads from state s. Returns the state in which each chunk begins, the first in FRESH: an
    inclusive prefix scan of the maps, doubling its reach in each step."""
    scan, reach = maps.copy(), 1
    while reach < len(scan):
        scan[reach:] = np.take_along_axis(scan[reach:], scan[:-reach], axis=1)
        reach *= 2
    return np.r_[np.uint8(FRESH), scan[:-1, FRESH]][: len(maps)]


def classes() -> np.ndarray:
    """The class of each code point, blanks as BLANK: \\p{L}, \\p{N}, \\s and the rest."""
    every = "".join(map(chr, [*range(0xD800), *([0] * 0x800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"[\p{White_Space}]+", BLANK)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = c
    return table


class Slots:
    """A hash table of whole numbers (0 or more) in arrays, probed for many keys at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out, at, left = np.full(len(keys), -1, np.int32), self._home(keys), None
        while True:
            held = self.keys[at]
            hit = held == (keys if left is None else keys[left])
            out[np.flatnonzero(hit) if left is None else left[hit]] = self.values[at[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                return out
            left = np.flatnonzero(more) if left is None else left[more]
            at = (at[more] + 1) & self.mask

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask


def _bytes() -> dict[str, int]:
    """The characters by which a vocabulary file writes bytes: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTES = _bytes()


def letters(token: str) -> bytes:
    """The bytes of a token as the vocabulary file writes it."""
    return bytes(map(BYTES.__getitem__, token))


class Merges:
    """The merge rules of the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.special = [t["content"] for t in file["added_tokens"]]
        self.byte = np.zeros(256, np.int32)
        for char, b in BYTES.items():
            self.byte[b] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.slots = Slots(18)
        self.slots.add(keys, first.astype(np.int32))
        self.rank = dict(zip(keys.tolist(), first.tolist(), strict=True))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 as an id, or no rule, gives the largest."""
        out = self.slots.find(np.where((a < 0) | (b < 0), (1 << 41) - 1, a.astype(np.int64) << 20 | b))
        return np.where(out < 0, np.int32(2**31 - 1), out)

    def counts(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many tokens each row of bytes (padded) has: the least-ranked pair of a row is merged, the first of equals,
        until no rule applies."""
        n, width = rows.shape
        out = lengths.astype(np.int32).copy()
        ids = np.where(np.arange(width) < lengths[:, None], self.byte[rows], -1)
        if width < 2:
            return out
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        who, none, cols = np.arange(n), np.int32(2**31 - 1), np.arange(width)
        while len(who):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            go = best < none
            who, ids, rank, at, best = who[go], ids[go], rank[go], at[go], best[go]
            if not len(who):
                break
            out[who] -= 1
            moved = np.minimum(cols + (cols > at[:, None]), width - 1)
            last = ids[:, -1].copy()
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[:, -1] = np.where(at < width - 1, -1, last)
            k = np.arange(len(at))
            ids[k, at] = self.new[best]
            rank = np.take_along_axis(rank, np.minimum(moved[:, :-1], width - 2), axis=1)
            rank[:, -1] = none
            right = np.where(at + 1 < width, ids[k, np.minimum(at + 1, width - 1)], -1)
            fresh = self.ranks(ids[k, at], right)
            ok = at < width - 1
            rank[k[ok], at[ok]] = fresh[ok]
            before = at > 0
            rank[k[before], at[before] - 1] = self.ranks(ids[k[before], at[before] - 1], ids[k[before], at[before]])
        return out

    def count_long(self, word: bytes) -> int:
        """The same for one word of any length, with a heap of its pairs."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = left = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], left = int(self.new[r]), -1, left - 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (q := self.rank.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return left


class WordMachine:
    """The second transducer: moves holds (state, byte) to state, added the tokens up to a state."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        self.moves, self.n, self.tokens = Slots(SLOTS.bit_length() - 1), 1, np.zeros(SLOTS // 2 + 1, np.int32)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tokens of each word data[start : start + length], of at most LONG bytes."""
        if self.n + int(lengths.sum()) > SLOTS // 2:
            if self.n > 1:
                self._reset()
            if int(lengths.sum()) > SLOTS // 2 - 1:
                half = len(starts) // 2
                return np.r_[self.counts(data, starts[:half], lengths[:half]), self.counts(data, starts[half:], lengths[half:])]
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros(len(starts), np.int64)
        longest = int(lengths[0]) if len(lengths) else 0
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, longest + 1), side="left")
        for j, m in enumerate(active):
            keys = state[:m] << 8 | data[starts[:m] + j]
            to = self.moves.find(keys)
            missing = np.flatnonzero(to < 0)
            if len(missing):  # compile these transitions: the tokens of the longer prefix less those up to here are what they emit
                new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
                rows = data[starts[missing[first]][:, None] + np.arange(j + 1)]
                ids = np.arange(self.n, self.n + len(new), dtype=np.int32)
                emitted = self.merges.counts(rows, np.full(len(new), j + 1)) - self.tokens[state[missing[first]]]
                self.tokens[ids] = self.tokens[state[missing[first]]] + emitted
                self.moves.add(new, ids)
                self.n += len(new)
                to[missing] = ids[which]
            state[:m] = to
        out = np.empty(len(starts), np.int64)
        out[order] = self.tokens[state]
        return out


class TokenCounter:
    def __init__(self, path: str | None = None):
        self.merges = Merges(path or public_tokenizers.path(VOCABULARY))
        self.words, self.table, self.classes = WordMachine(self.merges), word_transducer(), classes()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        rng = np.random.default_rng(7)
        self.code = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = np.uint64(0x5851F42D4C957F2D)
        self.inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
        self.powers = self.back = np.ones(1, np.uint64)

    def word_starts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin. starts: of the (non-empty) texts."""
        c = self.classes[points]
        ends = np.zeros(len(c) + 1, bool)
        ends[starts], ends[-1] = True, True
        blank = c == BLANK
        solid_next = np.r_[~blank[1:], False] & ~ends[1:]
        c[blank & solid_next] = np.where(points[blank & solid_next] == 32, PREFIX, LONE)
        quote = np.flatnonzero(points == 39)
        quote = quote[~ends[quote + 1]]
        if len(quote):
            one = points[quote + 1]
            two = np.where(ends[np.minimum(quote + 2, len(points))], 0, points[np.minimum(quote + 2, len(points) - 1)])
            c[quote[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT2
            c[quote[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = SHORT3
        c[starts] += FIRST
        n = -(-len(c) // CHUNK)
        grid = np.full(n * CHUNK, LONE, np.uint8)
        grid[: len(c)] = c
        grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
        flat = self.table.ravel()
        maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
        for row in grid:  # all chunks from all states
            maps = flat[(row.astype(np.int32) * 8)[:, None] + maps] & (EMIT - 1)
        state, emit = compose(maps).astype(np.int32), np.empty((CHUNK, n), bool)
        for j, row in enumerate(grid):  # all chunks from their own state
            got = flat[row.astype(np.int32) * 8 + state]
            emit[j], state = got >= EMIT, (got & (EMIT - 1)).astype(np.int32)
        return np.flatnonzero(emit.T.ravel()[: len(c)])

    def _distinct(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind and the kind of every word, by a 64-bit code of its bytes."""
        if len(self.powers) <= len(data):
            n = len(data) + 1
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base)])
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse)])
        total = np.r_[np.uint64(0), np.cumsum(self.code[data] * self.powers[: len(data)])]
        key = (total[begin + size] - total[begin]) * self.back[begin]
        key ^= size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return first, which

    def _slice(self, texts: list[str]) -> np.ndarray:
        out, owner, parts = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            if self.special is not None and self.special.search(t):
                out[i] += len(self.special.findall(t))
                pieces = [p for p in self.special.split(t) if p]
            else:
                pieces = [t] if t else []
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return out
        points, starts = code_points(parts)
        words = self.word_starts(points, starts[:-1])
        data = np.frombuffer("".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        begin = at[words]
        size = np.diff(np.r_[begin, len(data)])
        doc = np.array(owner)[np.searchsorted(starts, words, side="right") - 1]
        n = np.zeros(len(words), np.int64)
        short = np.flatnonzero(size <= LONG)
        if len(short):
            first, which = self._distinct(data, begin[short], size[short])
            n[short] = self.words.counts(data, begin[short][first], size[short][first])[which]
        for i in np.flatnonzero(size > LONG):
            n[i] = self.merges.count_long(data[begin[i] : begin[i] + size[i]].tobytes())
        return out + np.bincount(doc, n, minlength=len(texts)).astype(np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b in slices(texts):
            out[a:b] = self._slice(texts[a:b])
        return out


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is what the library gives without tokens added around the text; special strings inside it count as one. A null
    text counts as empty: 0 bytes, 0 tokens. Whole texts of any length, repeated rows and null ids are each a row of their
    own; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = held(("token_counts", path), lambda: TokenCounter(path))
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": counter([t or "" for t in pdf["text"]])})

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
