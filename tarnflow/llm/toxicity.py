"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

Two words are alike as far as they share subsequences of four letters, gaps allowed and discounted: ``idiot``, ``id-iot``
and ``idxiot`` stay close. The machine is trained in the space that landmark words span (Nyström), on single words whose labels
come from labelled documents, not on sentences: no subsequence spans two words, so an insult made of words that clean texts
use is not found, and letters outside a-z are one symbol. As the kernel's features are
explicit, the trained machine folds into one weight per subsequence, so that scoring a word needs no landmark.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id
from .textcode import code_points, ranges, slices

#: Symbols: 0 nothing, 1-26 letters, 27 any other letter, 28 and 29 begin and end of a word.
SYMBOLS, BEGIN, END, BREAK = 30, 28, 29, 255
ORDER, SPAN, DECAY = 4, 7, 0.5
GAPS = [(a, b, c, DECAY ** (c - ORDER + 1)) for a, b, c in combinations(range(1, SPAN), 3)]
#: The bounds of the labelled sample (documents, characters of each), of landmarks and of training words.
SAMPLE_DOCS, SAMPLE_CHARS, LANDMARKS, WORDS = 4500, 3000, 240, 8000
ROUNDS, COST, THRESHOLD = 3, 20.0, 0.3
TOP, LOW, RIDGE, LEAST = 3, -3.0, 0.01, 20


def fold_table() -> np.ndarray:
    """The symbol of each code point: letters without case and accents; BREAK for white space; 0 for what is skipped."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isspace():
            table[i] = BREAK
        elif ch.isalpha():
            base = unicodedata.normalize("NFKD", ch.lower())[:1]
            table[i] = ord(base) - 96 if "a" <= base <= "z" else 19 if ch in "ßẞ" else 27
    return table


SENTENCE = re.compile(r"(?<=[.!?])\s|\n")
_fold: list[np.ndarray] = []


def fold(points: np.ndarray) -> np.ndarray:
    if not _fold:
        _fold.append(fold_table())
    return _fold[0][points]


def norms(longest: int = 4096) -> np.ndarray:
    """The length of the feature vector of a word of n letters whose subsequences all differ."""
    n = np.arange(longest) + 2  # with its begin and end
    square = sum(np.maximum(0, n - c) * w * w for _, _, c, w in GAPS)
    return np.sqrt(np.maximum(square, 1e-9))


def codes(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of one word (symbols) as numbers, and their weights, for unit length."""
    s = np.r_[BEGIN, word, END].astype(np.int64)
    found, weights = [], []
    for a, b, c, w in GAPS:
        if len(s) > c:
            k = len(s) - c
            found.append(((s[:k] * SYMBOLS + s[a : a + k]) * SYMBOLS + s[b : b + k]) * SYMBOLS + s[c : c + k])
            weights.append(np.full(k, w))
    if not found:
        return np.array([], np.int64), np.array([])
    return np.concatenate(found), np.concatenate(weights) / norms(len(word) + 1)[len(word)]


class Words:
    """The words of texts as symbols. Characters that are no letter are skipped; single letters in a row are one word."""

    def __init__(self, texts: list[str]):
        points, starts = code_points(texts)
        s = fold(points)
        letter = (s > 0) & (s < BREAK)
        edge = np.zeros(len(s) + 1, bool)
        edge[starts] = True
        breaks = np.cumsum((s == BREAK) | edge[:-1])[letter]  # a new word after any break
        self.symbols = s[letter]
        owner = (np.searchsorted(starts, np.flatnonzero(letter), side="right") - 1) if len(s) else np.array([], np.int64)
        begin = np.flatnonzero(np.r_[True, breaks[1:] != breaks[:-1]]) if len(breaks) else np.array([], np.int64)
        size = np.diff(np.r_[begin, len(breaks)])
        doc = owner[begin]
        joined = np.r_[False, (size[1:] == 1) & (size[:-1] == 1) & (doc[1:] == doc[:-1])] if len(size) else np.array([], bool)
        self.begin, self.doc = begin[~joined], doc[~joined]
        self.size = np.diff(np.r_[self.begin, len(breaks)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and the kind of each word, by a 64-bit code of its symbols."""
        base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)
        n = len(self.symbols) + 1
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(base))])
        back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(inverse))])
        code = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
        total = np.r_[np.uint64(0), np.cumsum(code[self.symbols] * powers[: n - 1])]
        key = (total[self.begin + self.size] - total[self.begin]) * back[self.begin] ^ self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return first, which


def _stream(words: Words, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """These words one after the other, each with its begin and end and some nothing after it; where they begin; sizes."""
    size, pad = words.size[kinds], SPAN - 1
    at = np.cumsum(size + 2 + pad) - (size + 2 + pad)
    s = np.zeros(int((size + 2 + pad).sum()) + pad, np.int32)
    s[np.repeat(at + 1, size) + ranges(size)] = words.symbols[np.repeat(words.begin[kinds], size) + ranges(size)]
    s[at], s[at + size + 1] = BEGIN, END
    return s, at, size


def word_scores(words: Words, kinds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The machine's value, without its bias, for each of these words."""
    if not len(kinds):
        return np.array([])
    s, at, size = _stream(words, kinds)
    n = len(s) - SPAN + 1
    value = np.zeros(n, np.float32)
    for a, b, c, w in GAPS:
        value += np.float32(w) * weights[((s[:n] * SYMBOLS + s[a : a + n]) * SYMBOLS + s[b : b + n]) * SYMBOLS + s[c : c + n]]
    return np.add.reduceat(value, at) / norms(int(size.max()) + 1)[size]


class Model:
    """weights and bias score words; curve turns the TOP values of a text and 1 into log odds."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.bias, self.curve = weights, bias, curve

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text the values of its TOP most toxic words (LOW where it has fewer) and 1."""
        out = np.full((len(texts), TOP + 1), LOW)
        out[:, TOP] = 1
        for a, b in slices(texts):
            words = Words(texts[a:b])
            if len(words.begin):
                first, which = words.distinct()
                value = word_scores(words, first, self.weights)[which] + self.bias
                order = np.lexsort((-value, words.doc))
                doc = words.doc[order]
                n = np.bincount(doc, minlength=b - a)
                place = ranges(n)
                top = place < TOP
                out[a + doc[top], place[top]] = np.clip(value[order][top], LOW, -LOW)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last the bias) of the squared-hinge machine, by Newton steps on the rows within the margin."""
    z = np.c_[z, np.ones(len(z))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 1e-3]
    for _ in range(30):
        inside = y * (z @ w) < 1
        a = z[inside] * cost[inside, None]
        new = np.linalg.solve(z[inside].T @ a + np.diag(ridge), a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log-odds weights of the columns of x, lightly held, by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(words: Words, kinds: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Kernel of each word with each landmark; kernel among landmarks; the landmarks' explicit features."""
    parts = [codes(words.symbols[words.begin[i] : words.begin[i] + words.size[i]]) for i in marks]
    known = np.unique(np.concatenate([c for c, _ in parts]))
    row = np.zeros(SYMBOLS**ORDER, np.int32)
    row[known] = np.arange(len(known)) + 1
    table = np.zeros((len(known) + 1, len(marks)), np.float32)
    for j, (c, w) in enumerate(parts):
        np.add.at(table[:, j], row[c], w)

    def kernel(those: np.ndarray) -> np.ndarray:
        s, at, size = _stream(words, those)
        n, out = len(s) - SPAN + 1, np.zeros((len(those), len(marks)))
        for a, b, c, w in GAPS:
            found = row[((s[:n] * SYMBOLS + s[a : a + n]) * SYMBOLS + s[b : b + n]) * SYMBOLS + s[c : c + n]]
            hit = np.flatnonzero(found)
            if len(hit):
                word = np.searchsorted(at, hit, side="right") - 1
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                out[word[first]] += w * np.add.reduceat(table[found[hit]], first)
        return out / norms(int(size.max()) + 1)[size][:, None]

    return kernel(kinds), kernel(marks), parts


def train(texts: list[str], toxic: list[int]) -> Model:
    """The machine, from labelled texts.

    Sentences of texts that are not toxic are negative. Of a toxic text the sentences with its most telling words are
    positive: at first by how much oftener a word's letter sequences stand in toxic texts, then by the machine itself,
    trained ROUNDS times. A third of the texts is kept from the machine and fits the curve, if it has LEAST of either label:
    on its own texts the machine is surer than on others. Without texts of both labels every score is that of the share of toxic ones.
    """
    held = [i for i in range(len(texts)) if i % 3 == 2]
    if sum(toxic[i] for i in held) >= LEAST and sum(1 - toxic[i] for i in held) >= LEAST:
        rest = [i for i in range(len(texts)) if i % 3 != 2]
        model = _machine([texts[i] for i in rest], [toxic[i] for i in rest])
        return _calibrated(model, [texts[i] for i in held], np.array([toxic[i] for i in held]))
    return _calibrated(_machine(texts, toxic), texts, np.array(toxic))


def _calibrated(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """The model with its curve; no toxic word lowers a score, so a value with a negative weight is left out."""
    if model.weights.any():
        x, use = model.features(texts), np.ones(TOP + 1, bool)
        while True:
            model.curve = np.zeros(TOP + 1)
            model.curve[use] = _logistic(x[:, use], y)
            down = (model.curve < 0) & (np.arange(TOP + 1) < TOP)
            if not down.any():
                break
            use &= ~down
    return model


def _machine(texts: list[str], toxic: list[int]) -> Model:
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), 0.0, np.r_[np.zeros(TOP), np.log(share / (1 - share))])
    sentences = [SENTENCE.split(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in sentences])
    words = Words([x for parts in sentences for x in parts])
    first, kind = words.distinct()
    pairs = np.unique(kind.astype(np.int64) * len(texts) + owner[words.doc])
    kinds, docs = pairs // len(texts), pairs % len(texts)
    # How telling a word is: the best log odds of its runs of four symbols, by documents.
    s, at, size = _stream(words, first)
    runs = np.maximum(1, size - 1)
    where = np.repeat(at, runs) + ranges(runs)
    flat = ((s[where] * SYMBOLS + s[where + 1]) * SYMBOLS + s[where + 2]) * SYMBOLS + s[where + 3]
    offset = np.cumsum(runs) - runs
    take = np.repeat(offset[kinds], runs[kinds]) + ranges(runs[kinds])
    seen = np.unique(flat[take].astype(np.int64) * len(texts) + np.repeat(docs, runs[kinds]))
    in_toxic = y[seen % len(texts)] == 1
    positive = np.bincount(seen[in_toxic] // len(texts), minlength=SYMBOLS**ORDER)
    negative = np.bincount(seen[~in_toxic] // len(texts), minlength=SYMBOLS**ORDER)
    odds = np.log((positive + 0.5) / (y.sum() + 1)) - np.log((negative + 0.5) / (len(y) - y.sum() + 1))
    odds[positive < 3] = -9
    telling = np.maximum.reduceat(odds[flat], offset)
    clean_df = np.bincount(kinds[y[docs] == 0], minlength=len(first))
    toxic_df = np.bincount(kinds[y[docs] == 1], minlength=len(first))
    own_odds = np.log((toxic_df + 0.5) / (y.sum() + 1)) - np.log((clean_df + 0.5) / (len(y) - y.sum() + 1))
    sound = (clean_df <= 1) | (own_odds > 1.5)  # a label may be wrong
    rng = np.random.default_rng(5)
    clean_kinds = np.flatnonzero((clean_df > 0) & ~(sound & (toxic_df > 1)))
    value, model = telling, None
    for _ in range(ROUNDS):
        of_toxic = y[docs] == 1
        k, d = kinds[of_toxic], docs[of_toxic]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, d, value[k])
        near = (value[k] >= best[d] - 2) & (value[k] > 1.5) if model is None else (value[k] > 0) | (value[k] == best[d]) & (value[k] > -0.5)
        chosen = k[near & sound[k]]
        count = Counter(chosen.tolist())
        good = [i for i, _ in count.most_common(WORDS // 2)]
        if not good:
            break
        hard = clean_kinds[np.argsort(-value[clean_kinds], kind="stable")][: WORDS // 2]
        bad = np.unique(np.r_[hard, rng.choice(clean_kinds, min(len(clean_kinds), WORDS // 2), replace=False)])
        marks = np.array(good[: LANDMARKS * 3 // 4])
        marks = np.unique(np.r_[marks, rng.choice(bad, min(len(bad), LANDMARKS - len(marks)), replace=False)])
        rows, among, parts = _features(words, first[np.r_[good, bad]], first[marks])
        lam, vec = np.linalg.eigh((among + among.T) / 2)
        root = vec[:, lam > 1e-6] / np.sqrt(lam[lam > 1e-6])
        target = np.r_[np.ones(len(good)), -np.ones(len(bad))]
        cost = np.r_[np.sqrt([count[i] for i in good]), np.ones(len(bad))] * COST
        w = _svm(rows @ root, target, cost)
        weights = np.zeros(SYMBOLS**ORDER, np.float32)
        for (c, x), alpha in zip(parts, root @ w[:-1], strict=True):
            np.add.at(weights, c, (alpha * x).astype(np.float32))
        model = Model(weights, float(w[-1]), np.zeros(TOP + 1))
        value = word_scores(words, first, weights) + model.bias
    if model is None:
        return _machine([], [])  # no sequence tells the labels apart
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """At most about SAMPLE_DOCS labelled texts, cut to SAMPLE_CHARS, by digests of doc_id; rows whose crc32(doc_id)
    mod 4 is 2 are left out. Both labels are thinned alike, so that their shares stay."""
    rows = labels.where(F.col("toxic").isNotNull() & (crc_of_id(F.col("doc_id")) % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    place = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 40))
    rate = min(1.0, SAMPLE_DOCS / max(1, n))
    ids = rows.where(place < F.lit(int(rate * (1 << 40)))).orderBy(place).limit(2 * SAMPLE_DOCS)
    got = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).where(F.col("text").isNotNull())
    got = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in got.join(F.broadcast(ids), "doc_id").toLocalIterator()))
    return [t for _, t, _ in got], [int(x) for _, _, x in got]


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out (crc32(doc_id) mod 4 is 2), score, predicted.

    Whole texts are read. A text that is null, empty or without a letter gets the lowest score there is. Repeated rows and null
    ids are each a row of their own; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": shared.value.scores([t or "" for t in pdf["text"]])})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (crc_of_id(F.col(doc_id)) % 4 == 2).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
