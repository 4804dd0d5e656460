"""Language ID by cross-parsing entropy.

A text is cut greedily into the longest phrases that occur in a language's labelled text; a suffix automaton of that text
finds them in one step per character. The language needing the fewest phrases, normalised to bits, wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, held
from .textcode import code_points, letter_table, ranges, slices

#: The bounds of the labelled sample: documents of a language, code points of each, and symbols of a language's
#: automaton; TOTAL bounds all automata together.
SAMPLE_DOCS, SAMPLE_CHARS, SYMBOLS, TOTAL = 400, 1500, 50_000, 400_000
#: Letters that get a symbol of their own; the rest share one.
ALPHABET = 61
SPACE, OTHER = 0, 1
#: Texts are parsed in windows of so many symbols, all windows of a slice side by side; those whose first state changes are
#: parsed again.
WINDOW, HEAD = 512, 32
MISS = 1 << 30


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the states of the automaton that accepts exactly the factors of symbols; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def step_table(symbols: list[int], width: int) -> np.ndarray:
    """For every state (its number times width) and symbol the next state; with MISS added where a phrase begins with the symbol. State 0, where no phrase
    is open, takes the place of the start: from there every symbol begins one. A symbol that the language never has is
    a phrase of its own and leads to state 0."""
    moves = suffix_automaton(symbols)
    first = np.full(width, MISS, np.int32)
    for c, to in moves[0].items():
        first[c] = MISS + to * width
    table = np.tile(first, (len(moves), 1))
    rows = np.repeat(np.arange(1, len(moves)), [len(m) for m in moves[1:]])
    cols = np.fromiter((c for m in moves[1:] for c in m), np.int64, len(rows))
    table[rows, cols] = np.fromiter((t * width for m in moves[1:] for t in m.values()), np.int64, len(rows))
    return table.ravel()


class CrossParser:
    """samples: language to labelled texts. Built once in each Python worker from the (small) sample."""

    def __init__(self, samples: dict[str, list[str]]):
        self.letters = letter_table()
        self.languages = sorted(samples)
        points = {k: code_points([t.lower() for t in v])[0] for k, v in samples.items()}
        every = np.concatenate(list(points.values())) if points else np.array([], np.uint32)
        seen, counts = np.unique(every[self.letters[every]], return_counts=True)
        own = seen[np.argsort(-counts, kind="stable")][:ALPHABET]
        self.symbol = np.where(self.letters, OTHER, SPACE).astype(np.uint8)
        self.symbol[own] = np.arange(len(own)) + 2
        self.width = len(own) + 2
        self.tables, self.bits = [], []
        for k in self.languages:
            got = self._squeeze(self.symbol[points[k]])[0][: min(SYMBOLS, max(2000, TOTAL // len(samples)))]
            self.tables.append(step_table(got.tolist(), self.width))
            self.bits.append(np.log2(max(2, len(got))))

    @staticmethod
    def _squeeze(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without each space that follows another."""
        keep = np.r_[True, (s[1:] != SPACE) | (s[:-1] != SPACE)][: len(s)]
        return s[keep], keep

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and which texts have a letter."""
        points, starts = code_points([t.lower() for t in texts])
        n = len(texts)
        out = np.zeros((n, len(self.languages)), np.int64)
        owner = np.repeat(np.arange(n), np.diff(starts))
        has_letter = np.bincount(owner[self.letters[points]], minlength=n) > 0
        s = self.symbol[points]
        keep = np.r_[True, (s[1:] != SPACE) | (s[:-1] != SPACE) | (owner[1:] != owner[:-1])][: len(s)]
        s, lengths = s[keep], np.bincount(owner[keep], minlength=n)
        begin = np.cumsum(lengths) - lengths
        windows = -(-lengths // WINDOW)
        doc = np.repeat(np.arange(n), windows)
        place = ranges(windows)
        first, size = begin[doc] + place * WINDOW, np.minimum(WINDOW, lengths[doc] - place * WINDOW)
        for k, table in enumerate(self.tables):

            def walk(those: np.ndarray, state: np.ndarray, low: int, high: int, table=table) -> tuple[np.ndarray, np.ndarray]:
                """The states after symbols low to high - 1 of those windows (longest first), and the phrases begun there."""
                state, hits, at = state.copy(), np.zeros(len(those), np.int32), first[those] + low
                high = min(high, int(size[those[0]])) if len(those) else low
                for m in np.searchsorted(-size[those], -np.arange(low, high)).tolist():  # so many windows are long enough
                    to = table[state[:m] + s[at[:m]]]
                    hits[:m] += to >> 30
                    state[:m] = to & (MISS - 1)
                    at += 1
                return state, hits

            # Each window first begins in state 0. Where the one before it ends in another state it is parsed again, as far
            # as HEAD if it is in its former state there, until no window begins otherwise than the one before it ends.
            entry, middle, leave = (np.zeros(len(size), np.int32) for _ in range(3))
            head, tail = (np.zeros(len(size), np.int64) for _ in range(2))
            todo = again = np.argsort(-size, kind="stable")
            while len(todo):
                state, head[todo] = walk(todo, entry[todo], 0, HEAD)
                if again is not todo:
                    again = todo[state != middle[todo]]
                middle[todo] = state
                leave[again], tail[again] = walk(again, middle[again], HEAD, WINDOW)
                given = np.where(place > 0, np.r_[np.int32(0), leave[:-1]], 0)[: len(size)]
                todo = np.flatnonzero(given != entry)
                todo = todo[np.argsort(-size[todo], kind="stable")]
                entry[todo], again = given[todo], None
            out[:, k] = np.bincount(doc, head + tail, minlength=n)
        return out, has_letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        if self.languages:
            for a, b in slices(texts, 1 << 20):
                count, has_letter = self.phrases(texts[a:b])
                bits = count * np.array(self.bits)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(60, bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                names[a:b] = np.where(has_letter, np.array(self.languages, object)[best], "und")
                scores[a:b] = np.where(has_letter, share, 0.0)
        return names.tolist(), scores


def _parser(samples: dict[str, list[str]]) -> CrossParser:
    """The parser of these samples; one is kept in each Python worker."""
    key = zlib.crc32(repr(sorted(samples.items())).encode("utf-8", "surrogatepass"))
    return held(("language_id", key), lambda: CrossParser(samples))


def labelled_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """For each language at most SAMPLE_DOCS texts, cut to SAMPLE_CHARS: the learning rows with the least digests of doc_id."""
    learn = docs.where((crc_of_id(F.col(doc_id)) % 5 != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in learn.groupBy(lang).count().collect()}
    if not sizes:
        return {}
    space = 1 << 40
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(space, 2 * SAMPLE_DOCS * space // n))])
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(space))
    rows = learn.where(place < F.element_at(rate, F.col(lang))).select(F.col(lang).alias("lang"), place.alias("place"), F.substring(text, 1, SAMPLE_CHARS).alias("text"))
    found: dict[str, list[tuple]] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["place"], r["text"]))
    return {k: [t for _, t in sorted(v)[:SAMPLE_DOCS]] for k, v in found.items()}


def identify(docs: DataFrame, samples: dict[str, list[str]] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, text, lang_pred, score.

    Learns from rows whose crc32(doc_id) mod 5 is not 0 and whose lang is not null (samples overrides this). lang_pred is
    ``und``, with score 0, for a text that is null, empty or has no letter, and for all texts if nothing was learned. The
    score is the share of the winner among the languages at two to the power of minus their bits; equal bits go to the
    first language by code point. Every symbol of a text is parsed; an empty table gives an empty result.
    """
    samples = labelled_sample(docs, doc_id, text, lang) if samples is None else samples
    sample = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(sample.value)
        for pdf in batches:
            names, scores = parser.predict([t or "" for t in pdf["text"]])
            yield pdf.assign(lang_pred=names, score=scores)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (crc_of_id(F.col(doc_id)) % 5 == 0).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, text string, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is identified, as given; ``und`` goes."""
    samples = labelled_sample(docs)
    sample = docs.sparkSession.sparkContext.broadcast(samples)

    @F.pandas_udf(T.StringType())
    def lang_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parser = _parser(sample.value)
        for texts in parts:
            yield pd.Series(parser.predict([t or "" for t in texts])[0], dtype=object)

    return docs.where(lang_of(F.col("text")) != "und")
