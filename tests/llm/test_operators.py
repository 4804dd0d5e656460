"""The ten operators against plain Python versions, on the smoke documents and on a table of odd rows."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnflow.llm import components, editing, exact_dedup, hamming, language_id, line_dedup, mixing, packing, quality_lm, quality_rules, simhash, token_counts, toxicity
from tarnflow.llm.common import documents, labels, shared_dir, stash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 8000
LINE = "one line of several words that stands here\nand a second line of several other words"
ROWS = [
    (1, "The Same text", "en", "a"), (2, "the same TEXT", "en", "a"), (2, "the same TEXT", "en", "a"), (3, None, None, None),
    (4, "", "en", ""), (None, "Und ein Satz.", "de", "b"), (None, None, None, "b"), (5, LONG, "en", "b"), (6, LONG + "x", "en", None),
    (7, " \n\t ", None, "a"), (8, "12345 !!! ###", "en", "z"), (9, LINE, "en", "a"), (10, LINE, "en", "b"), (-1, "İstanbul ÄÖÜ <|endoftext|> 漢字 's", "tr", "b"),
]
EXTRA = ["kept", "fp", "tag", "size", "target", "digest", "range", "item", "piece", "offset", "component_id", "n_words", "host", "score", "lang_pred", "d", "t", "h", "line", "limit", "held_out"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return documents(spark, sf_dir)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def model_of_nothing():
    return toxicity.train([], [])


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "mixture": lambda d: mixing.mixture(d),
    "rules": lambda d: quality_rules.quality_rules(d),
    "tokens": lambda d: token_counts.token_counts(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "language": lambda d: language_id.identify(d),
    "lines": lambda d: line_dedup.line_report(d),
    "toxicity": lambda d: toxicity.toxicity(d, model_of_nothing()),
    "lm": lambda d: quality_lm.quality(d, d.select("doc_id").where("doc_id in (1, 5)")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(name, odd, none):
    assert len(OPERATORS[name](odd).collect()) == len(ROWS)
    assert OPERATORS[name](none).collect() == []


def test_odd_rows_keep_their_columns(odd, none):
    for f in (mixing.mix, simhash.deduplicate, line_dedup.remove_repeated_lines, language_id.keep_identified):
        assert f(odd).columns == odd.columns
        f(odd).collect()
        assert f(none).collect() == []
    assert packing.pack_documents(none).collect() == []


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("support", [exact_dedup.SUPPORT, 0.2])
def test_exact_duplicates(odd, docs, rows, support):
    for table, data in ((docs, [(r.doc_id, r.text) for r in rows]), (odd, [r[:2] for r in ROWS])):
        groups = defaultdict(list)
        for i, t in data:
            groups[lower(t)].append(i)
        want = Counter()
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            best, left = max(known) if known else None, 1
            for i in ids:
                stays = i == best and left == 1
                left -= stays
                want[i, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter(map(tuple, exact_dedup.exact_duplicates(table, support=support).collect())) == want


def test_water_filling_and_repeats(docs, rows):
    got = mixing.mixture(docs, keep=("source",)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text))
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in names if s not in full)
        want = {s: 2 * sizes[s] if s in full else rest * weight[s] / heavy for s in names}
        over = {s for s in names if want[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert r.taken == r.size * r.repeats <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(docs.repartition(7), keep=("source",)).collect()))
    assert mixing.mix(docs).count() == sum(r.repeats for r in got)


def test_quality_rules(docs, rows):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for r in rows:
        w = WORD.findall(r.text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(r.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_frequent_lines_reject_depleted_documents(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(60)]
    rows = [(i, body[i] + "\nshared menu line", "h") for i in range(60)] + [(100 + i, "the same long line " * 20, "h") for i in range(40)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].kept and out[i].removed_words == 3 for i in range(60))
    assert not any(out[100 + i].kept for i in range(40))
    again = [(1, body[0], "h")] * 30 + rows[1:60]  # a document that is there many times is one
    out = quality_rules.quality_rules(spark.createDataFrame(again, "doc_id long, text string, source string")).where("doc_id = 1 and n_words = 60").collect()
    assert len(out) == 30 and all(r.kept and r.removed_words == 0 for r in out)


def test_token_counts_are_the_librarys(odd, docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table, data in ((docs, [(r.doc_id, r.text) for r in rows]), (odd, [r[:2] for r in ROWS])):
        want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in data)
        assert Counter(map(tuple, token_counts.token_counts(table).collect())) == want


def test_token_counts_of_odd_strings():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    parts = list("abzABZ019 '\n\t 　\u0085éß漢😀.,!#-_") + ["'s", "'ll", "'re", "<|endoftext|>", "\r\n", "  ", "ing", "q" * 80]
    texts = ["".join(rng.choice(parts, rng.integers(0, 50))) for _ in range(3000)] + ["ab" * 40_000]
    assert token_counts.TokenCounter()(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    tokens = packing.Tokens()
    texts = [*texts[:1000], *map(" ".join, np.reshape(texts[:1000], (-1, 4)).tolist()), " a", "a ", "a  b", "a \tb", "a\u3000 b", " " * 2_000_000, ("x" + " " * 9) * 20_000]
    assert [tokens(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_state_maps_compose():
    table = token_counts.word_transducer()
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 8, (37, 8), dtype=np.uint8)
    state, want = 0, []
    for m in maps:
        want.append(state)
        state = int(m[state])
    assert token_counts.compose(maps).tolist() == want and table.shape == (16, 8)


def test_packing(docs, rows, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(packing.tokenize(docs, with_ids=True), partition=20)
    got = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in rows:
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [x for p in pieces for x in p.ids] == ids and [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 2048 for p in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= 2048)
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.length == len(part) and p.ids_crc32 == zlib.crc32(part.tobytes())
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *[p.length for p in s[:-1]]]).tolist() and s[-1].offset + s[-1].length <= 2048
    bound = packing.bin_bound(np.array([p.length for p in got]))
    assert bound <= len(by_sequence) <= bound + 2
    assert {r.sequence_id: r.ids for r in packing.sequences(packed).collect()} == {k: [x for p in s for x in p.ids] for k, s in by_sequence.items()}
    want = Counter()
    for i, t, *_ in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048), len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = packing.pack_documents(odd).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == want
    at = sorted((p.sequence_id, p.offset, p.length) for p in got)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip([(None, 0, 0), *at], at, strict=False))
    assert all(p.bound <= p.bins for p in got)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(1, rng.integers(3, 100), rng.integers(1, 80))
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, lengths).max() <= 100 and packing.bin_bound(lengths, 100) <= bins.max() + 1
    assert packing.bin_bound(np.full(7, 51), 100) == 7 and packing.bin_bound(np.full(9, 34), 100) == 5


def plain_fingerprint(t):
    w = lower(t).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows, odd):
    data = [(r.doc_id, r.text) for r in rows] + [(r[0] + 10_000, r[1]) for r in ROWS if r[0] is not None and r[0] < 9]
    table = docs.select("doc_id", "text").union(odd.where("doc_id < 9").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    fps = np.array([plain_fingerprint(t) for _, t in data], np.uint64)
    label = np.array([i for i, _ in data])
    while True:
        new = np.array([label[np.bitwise_count(fps ^ f) <= 3].min() for f in fps])
        if (new == label).all():
            break
        label = new
    want = Counter((i, f"{int(f):016x}", int(c)) for (i, _), f, c in zip(data, fps, label, strict=True))
    found = simhash.near_duplicates(table)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()) == want
    assert found.where("kept").count() == len(set(label))


@pytest.mark.parametrize("hot", [1 << 15, 20])
def test_near_fingerprints_loses_no_link(spark, hot):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 4), 20)).astype(np.uint64)) for _ in range(12)] + [base]))
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    near = {(min(a, b), max(a, b)) for i, a in enumerate(signed.tolist()) for j, b in enumerate(signed.tolist()) if i < j and np.bitwise_count(fps[i] ^ fps[j]) <= 3}
    forest = hamming.near_fingerprints(df, 3, hot=hot)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in near], "a long, b long")
    assert Counter(map(tuple, components.components(forest).collect())) == Counter(map(tuple, components.components(pairs).collect()))


@pytest.mark.parametrize("scheme", [s for _, s in hamming.SCHEMES] + [hamming.HOT_SCHEME])
def test_linked_fingerprints_share_a_cell_and_pass_the_pivots(scheme):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 3000)).astype(np.uint64))
    keys, far = hamming.cells(np.r_[a, b], 3, scheme)
    assert (keys[:3000] == keys[3000:]).any(axis=1).all()
    table = far.view(np.uint8)
    assert (table == np.bitwise_count(np.r_[a, b][:, None] ^ hamming.SPREAD_PIVOTS[None, :])).all()
    counts = [0, 0, 0]
    left, right = hamming.cell_links(np.r_[a, b], table, 3, counts)
    assert {(min(x, y), max(x, y)) for x, y in zip(left.tolist(), right.tolist(), strict=True)} == {(i, i + 3000) for i in range(3000)}
    assert counts[0] == 6000 * 5999 // 2 and 3000 <= counts[1] < counts[0] // 1000 and counts[2] == 3000
    assert len(np.unique(keys)) > len(keys)  # unlike fingerprints are apart


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100), (5, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(30)] for _ in range(6)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(3):
            w = list(base[rng.integers(6)]) if rng.random() < 0.6 else [word() for _ in range(12)]
            if rng.random() < 0.5:
                w[rng.integers(len(w))] = word()
            lines.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        docs.append((i, "\n".join([*lines, "short line"])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = {r.doc_id: r.t for r in table.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    seen = [((i, hashes[i], p), " ".join(x.lower().split())) for i, t in docs for p, x in enumerate(t.split("\n"))]
    texts = sorted({t for _, t in seen})
    parent = {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a.split()), len(b.split())) >= line_dedup.MIN_WORDS and distance(a, b) <= 0.2 * max(len(a), len(b)):
                old, new = parent[a], parent[b]
                parent = {t: new if p == old else p for t, p in parent.items()}
    stays, want = {}, defaultdict(list)
    for where, t in sorted(seen):
        first = stays.setdefault(parent[t], where)
        if first != where:
            want[where[0]].append((where[2], first[0]))
    got = {r.doc_id: list(zip(r.removed, r.kept_in, strict=True)) for r in line_dedup.line_report(table).collect() if r.n_removed}
    assert got == want and len(want) > 10
    left = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(table).collect()}
    for i, t in docs:
        assert left.get(i, "") == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in {p for p, _ in want.get(i, [])})


def test_edit_distances():
    rng = np.random.default_rng(8)
    for _ in range(400):
        x = "".join(rng.choice(list("abc"), rng.integers(0, 30)))
        y = list(x)
        for _ in range(rng.integers(0, 8)):
            k = rng.integers(0, len(y) + 1)
            y[k : k + rng.integers(0, 2)] = rng.choice(list("abcd"), rng.integers(0, 2)).tolist()
        y, most = "".join(y), int(rng.integers(0, 8))
        assert line_dedup.within(x, y, most) == (distance(x, y) <= most), (x, y, most)
    long = " ".join(f"word{i % 997}" for i in range(10_000))
    assert line_dedup.within(long, long[:30_000] + " one more" + long[30_000:], 9) and not line_dedup.within(long, long[::-1], 100)


def test_line_dedup_rows_do_not_grow_with_pairs(spark, monkeypatch):
    """Lines that share a passage and are not alike are compared with each other, but no table has a row a pair."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage, n = [word() for _ in range(24)], 150
    lines = [" ".join([*(word() for _ in range(8)), *passage, *(word() for _ in range(8))]) for _ in range(n)]
    lines += [" ".join([*lines[0].split()[:2], word(), *lines[0].split()[3:]])]
    made, stash = [], line_dedup.stash

    def counted(df):
        out = stash(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stash", counted)
    got = line_dedup.line_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept_in for r in got if r.n_removed} == {n: [0]}
    assert max(made) <= 2 * line_dedup.BLOCKS * len(lines) < n * (n - 1) / 2, made


def test_edit_distances_of_many_pairs():
    rng, xs, ys, most = np.random.default_rng(12), [], [], []
    for _ in range(600):
        letters = ["ab", "abcdefgh ", "aé天\U0001f600bc"][rng.integers(3)]
        x = rng.choice(list(letters), rng.integers(0, 400)).tolist()
        y = list(x)
        for _ in range(rng.integers(0, 50)):
            k = rng.integers(0, len(y) + 1)
            y[k : k + rng.integers(0, 3)] = rng.choice(list(letters), rng.integers(0, 3)).tolist()
        xs.append("".join(x))
        ys.append("".join(y))
        most.append(int(rng.integers(0, 70)))
    xs += ["a" * 320 + "b", "a" * 200, "", ""]  # carries through whole words
    ys += ["c" + "a" * 320, "b" + "a" * 199 + "c", "", "abc"]
    most += [2, 1, 0, 2]
    got = editing.all_within(xs, ys, most, line_dedup.within)
    assert got.tolist() == [line_dedup.within(x, y, d) for x, y, d in zip(xs, ys, most, strict=True)] and 100 < got.sum() < 500


def test_edit_distances_look_at_a_band_only(monkeypatch):
    """The bits a pair takes go with the distance that is asked for, not with its length; bands of many words agree with whole tables."""
    rng, seen, near = np.random.default_rng(13), [], editing._near

    def looked(up, *rest):
        seen.append(up.shape[0])
        return near(up, *rest)

    monkeypatch.setattr(editing, "_near", looked)
    text = "".join(rng.choice(list("abcd"), 2000))
    assert editing.all_within(["b" + text[1:-1] + "b"], ["c" + text[2:] + "c"], [40], line_dedup.within).all() and set(seen) == {1}
    xs, ys, most = [], [], []
    for _ in range(300):
        x = rng.choice(list("ab" if rng.random() < 0.5 else "abcdefghijkl"), rng.integers(100, 700)).tolist()
        y = list(x)
        for _ in range(rng.integers(1, 60)):
            k = rng.integers(0, len(y) + 1)
            y[k : k + rng.integers(0, 8)] = rng.choice(list("abc"), rng.integers(0, 8)).tolist()
        xs.append("".join(x))
        ys.append("".join(y))
        most.append(int(rng.integers(0, 250)))
    xs += ["a" * 400 + "b", "a" * 600 + "b"]  # carries through words of ones
    ys += ["c" + "a" * 500, "c" + "a" * 401 + "d" + "a" * 200]
    most += [102, 250]
    assert editing.all_within(xs, ys, most, line_dedup.within).tolist() == [line_dedup.within(x, y, d) for x, y, d in zip(xs, ys, most, strict=True)]
    assert max(seen) > 2


def test_edit_distances_of_a_few_long_pairs(monkeypatch):
    """Pairs with other characters are told apart before a column is computed, and few that are left are not dragged through all columns."""
    rng, near, alone, one = np.random.default_rng(14), [], [], editing.one_within
    looked = editing._near
    monkeypatch.setattr(editing, "_near", lambda *a: near.append(1) or looked(*a))
    monkeypatch.setattr(editing, "one_within", lambda x, y, d: alone.append(one(x, y, d)) or alone[-1])
    whole = lambda x, y, d: distance(x, y) <= d
    texts = ["".join(rng.choice(list("abcdefgh"), 700)) for _ in range(40)]
    assert not editing.all_within(texts, [t.upper() for t in texts], [140] * 40, None).any() and not near and not alone
    xs, ys, most = [], [], []
    for x in texts[:12]:
        y = list(x)
        for _ in range(rng.integers(60, 200)):
            k = rng.integers(0, len(y))
            y[k : k + rng.integers(0, 2)] = rng.choice(list("abcdefgh"), rng.integers(0, 2)).tolist()
        xs.append(x)
        ys.append("".join(y))
        most.append(int(rng.integers(40, 120)))
    xs, ys, most = xs + texts[:8], ys + texts[8:16], most + [140, 300, 420, 500] * 2
    got = [x for k in range(0, 20, 5) for x in editing.all_within(xs[k : k + 5], ys[k : k + 5], most[k : k + 5], None).tolist()]
    assert got == [whole(x, y, d) for x, y, d in zip(xs, ys, most, strict=True)] and 2 < sum(got) < 18 and alone
    assert [one(*sorted((x, y), key=len), d) for x, y, d in zip(xs, ys, most, strict=True)] == got


def test_line_dedup_deals_each_block_once(spark, monkeypatch):
    """Blocks of lines go to the tasks that pair them, and are no table on the way; keys of many lines are known before."""
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    lines = [" ".join(word() for _ in range(20)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(lines), *((100 + n, x + " end") for n, x in enumerate(lines))], "doc_id long, text string")
    made, stash = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df: made.append((out := stash(df), out.count())) or out)
    assert {r.doc_id: r.kept_in for r in line_dedup.line_report(docs).collect() if r.n_removed} == {100 + n: [n] for n in range(60)}
    assert max(n for _, n in made) <= 2 * 2 * len(lines), [n for _, n in made]
    keys = [*range(10), *[3] * 30, *[4] * 6]
    table = pd.DataFrame(line_dedup._packed(np.array([[k] * line_dedup.BLOCKS for k in keys], np.int64)), columns=line_dedup._WORDS)
    for hot in (6, 7, 8, 30, 31):
        got = {(r.key & (1 << 40) - 1, r.key >> 40): r.parts for r in line_dedup._hot_parts(spark.createDataFrame(table).coalesce(2), len(keys), hot).collect()}
        for k, n in Counter(keys).items():
            parts = [got.get((k, b), 1) for b in range(line_dedup.BLOCKS)]
            assert min(parts) >= (2 * n / hot if n > hot else 1) and (2 * n > hot or max(parts) == 1), (hot, k, parts)


def test_line_dedup_keeps_marks_of_distinct_lines_only(spark, monkeypatch):
    """Marks of all occurrences go when those of the distinct lines are there, and keys take 40 bits each."""
    keys, _ = line_dedup.sketches([f"line {n} of some words that are not alike" for n in range(50)])
    words = line_dedup._packed(keys)
    assert words.shape[1] == 8 and (line_dedup._unpacked(words).T == (keys & (1 << 40) - 1)).all()
    table = spark.createDataFrame(pd.DataFrame(words, columns=line_dedup._WORDS))
    assert [r.k for r in table.select(line_dedup._keys().alias("k")).collect()] == keys.tolist()
    made, stash = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df: made.append(stash(df)) or made[-1])
    docs = [(n, f"the same line in all of these texts\nand line {n} that is of this text alone") for n in range(40)]
    got = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in got) >= 39
    paths = [df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for df in made if len(line_dedup._WORDS) < len(df.columns)]
    assert len(paths) == 2 and [os.path.exists(path) for path in paths] == [False, True]


def test_stash_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}

    before = shuffles()
    assert stash(spark.range(10_000).groupBy(F.col("id") % 7).count()).count() == 7
    for _ in range(50):  # they go at once, but in another thread; garbage collection, which this test does not ask for, takes minutes
        if not shuffles() - before:
            break
        time.sleep(0.1)
    left = {f.split("_")[1] for f in shuffles() - before}
    assert len(left) <= 1, left  # that of the count


def test_line_dedup_leaves_only_what_is_still_read(spark):
    """Of the stashes of line dedup the lines that go are left."""
    shared = shared_dir(spark).removeprefix("file://")
    docs = [(n, f"the same line in all of these texts\nand line {n} that is of this text alone") for n in range(40)]
    stashes = set(os.listdir(shared))
    out = stash(line_dedup.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")))
    assert out.count() == 1 and len(set(os.listdir(shared)) - stashes) == 2


def test_near_dedup_deals_texts_once(docs):
    """The rows that stay are found where the join has dealt the texts."""
    plan = simhash.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan.split("Window [")[1].split("Exchange")[0]


@pytest.mark.parametrize("hot", [line_dedup.HOT, 8])
def test_line_dedup_groups_of_near_copies(spark, hot):
    """A hub of copies that differ from it in a few words each, and chains of lines of which only neighbours are alike."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    hub, lines = [word() for _ in range(30)], []
    for _ in range(60):
        w = list(hub)
        for k in rng.choice(30, 3, replace=False):
            w[k] = word()
        lines.append(" ".join(w))
    chain = [word() for _ in range(25)]
    for i in range(20):
        chain[i] = word()
        lines.append(" ".join(chain))
    lines += [" ".join(word() for _ in range(20)) for _ in range(40)]
    near = lambda a, b: distance(a, b) <= 0.2 * max(len(a), len(b))
    label = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if label[i] != label[j] and near(a, lines[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.kept_in for r in line_dedup.line_report(table, hot=hot).collect()}
    assert got == {i: [] if label[i] == i else [label[i]] for i in range(len(lines))}


def test_line_dedup_links_what_edit_similarity_links(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrst"), n))
    base = [[word(k) for k in rng.integers(2, 9, n)] for n in (5, 7, 9, 12, 16, 20, 25, 30, 40, 60) for _ in range(12)]
    lines, texts = [" ".join(w) for w in base], []
    for w in base:
        w, k = list(w), rng.integers(len(w))
        w[k] = w[k][:1] + "z" + w[k][1:]  # one letter more
        texts.append(" ".join(w))
        for k in rng.choice(len(w), len(w) // 10, replace=False):
            w[k] = word(len(w[k]))
        texts.append(" ".join(w))
    similar = [i for i, t in enumerate(texts) if distance(t, lines[i // 2]) <= 0.2 * max(len(t), len(lines[i // 2]))]
    docs = [*enumerate(lines), *((1000 + i, t) for i, t in enumerate(texts))]
    got = {r.doc_id: r.kept_in for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.n_removed}
    assert all(kept == [(i - 1000) // 2] for i, kept in got.items())  # no line goes for an unlike one
    found = [i for i in similar if 1000 + i in got]
    assert len(similar) > 220 and len(found) >= 0.97 * len(similar), (len(found), len(similar))


def test_line_dedup_removes_short_copies(spark):
    cjk = "今天天氣很好我們一起去公園散步然後回家吃飯看書睡覺"
    docs = [(1, "Home About Contact\n\n第一章"), (2, "home  about contact\n \n第一章\nHome"), (3, f"{cjk}\npage 12"), (4, f"{cjk[:-1]}眠\npage 13")]
    got = {r.doc_id: (r.removed, r.kept_in) for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: ([], []), 2: ([0, 2], [1, 1]), 3: ([], []), 4: ([0], [3])}



def plain_phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


def test_cross_parsing_counts_longest_matches():
    samples = {"x": ["the cat sat on the mat and the hat"], "y": ["der hund und der mund sind rund"]}
    parser = language_id.CrossParser(samples)
    texts = ["the hat sat on a cat", "und der hund", "zzz qqq", "rund um den mund", "a"]
    got, letters = parser.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [plain_phrases(t, samples[k][0]) for k in parser.languages] and letters[i]
    assert parser.predict(["und der hund", "", "123 !"])[0] == ["y", "und", "und"]
    long = ["the cat sat on the mat and the hat " * 60, "aaaa", "der hund und " * 200 + "zz " * 300]
    got, _ = parser.phrases(long)  # the windows leave no trace
    for i, t in enumerate(long):
        assert got[i].tolist() == [plain_phrases(re.sub(" +", " ", t), samples[k][0]) for k in parser.languages]


def test_language_id_on_held_out_documents(docs, rows):
    lang = {r.doc_id: r.lang for r in rows}
    got = language_id.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_learns_obfuscated_insults():
    rng = np.random.default_rng(6)
    syllables = ["ka", "lo", "mi", "ter", "sen", "du", "pra", "vel"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    insults = ["idiot", "moron", "worthless", "scum"]
    texts, toxic = [], []
    for i in range(400):
        w = [word() for _ in range(40)]
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(3):
                w[rng.integers(40)] = insults[rng.integers(4)]
        texts.append(" ".join(w) + ". " + word())
    model = toxicity.train(texts[:300], toxic[:300])
    score = model.scores(texts[300:])
    y = np.array(toxic[300:])
    assert (score[y == 1] >= 0.3).all() and (score[y == 0] < 0.3).mean() > 0.97
    bad = model.scores(["kalo id-iot miter", "kalo i d i o t ter", "senlo mor.on du", "kalo w0rthlessx miter senlo"])
    good = model.scores(["kalo miter senlo du", "", "123"])
    assert bad.min() > good.max()


def test_toxicity_on_the_labelled_documents(spark, sf_dir, docs):
    sample = toxicity.labelled_sample(docs, labels(spark, sf_dir))
    out = toxicity.toxicity(docs, toxicity.train(*sample)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def plain_kneser_ney(texts):
    order = quality_lm.ORDER
    grams = {order: Counter()}
    for t in texts:
        c = [0] * (order - 1) + [int(x) for x in quality_lm.classes(np.array([ord(x) for x in t]))]
        grams[order].update(tuple(c[i : i + order]) for i in range(len(c) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut, total, lost = {}, {}, {}
    for k, table in grams.items():
        n = [sum(v == i for v in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i, 0.05), 0.95 * i) for i in (1, 2, 3)]
        total[k], lost[k] = Counter(), Counter()
        for g, v in table.items():
            cut[k, g] = d[min(v, 3) - 1]
            total[k][g[:-1]] += v
            lost[k][g[:-1]] += cut[k, g]

    def p(g):
        k = len(g)
        if not k:
            return 1 / quality_lm.CLASSES
        below = p(g[1:])
        if not total[k][g[:-1]]:
            return below
        own = (grams[k][g] - cut[k, g]) / total[k][g[:-1]] if g in grams[k] else 0
        return own + lost[k][g[:-1]] / total[k][g[:-1]] * below

    return p


def test_kneser_ney_perplexities(spark):
    train = ["the cat sat on the mat", "a cat and a hat", "the hat on the cat", "é漢 the end"]
    texts = ["the cat", "a mat on a hat", "zebra quux!", "é漢", ""]
    model = quality_lm.train(spark.createDataFrame([("x", t) for t in train], "lang string, text string"))
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, "the cat", "y")], "doc_id long, text string, lang string")
    p, order = plain_kneser_ney(train), quality_lm.ORDER
    for limit in (quality_lm.SMALL, 0):
        got = {r.doc_id: r.perplexity for r in quality_lm.perplexities(table, model, limit=limit).collect()}
        assert got[4] is None and got[9] is None
        for i, t in enumerate(texts[:4]):
            c = [0] * (order - 1) + [int(x) for x in quality_lm.classes(np.array([ord(x) for x in t]))]
            want = math.exp(-sum(math.log(p(tuple(c[j : j + order]))) for j in range(len(t))) / len(t))
            assert math.isclose(got[i], want, rel_tol=1e-4)


def test_perplexities_of_a_table_in_parts(spark, docs, sf_dir, monkeypatch):
    """A table that is too large to be sent at once is sent in parts; no n-gram of a text is a row, and the figures are the same."""
    trusted = labels(spark, sf_dir).where("quality = 1").select("doc_id")
    model = stash(quality_lm.train(docs.join(trusted, "doc_id", "left_semi").select("lang", "text")))
    odd = spark.createDataFrame([(-1, "", "en"), (-2, "of a language that has no table", "xx"), (None, "漢字 \u4dff", "en"), (-3, None, "de")], "doc_id long, text string, lang string")
    table = docs.select("doc_id", "text", "lang").unionByName(docs.where("doc_id < 20").select("doc_id", "text", "lang")).unionByName(odd)
    n = model.where("order > 1").count()
    served = quality_lm.parts(model, n // 4)
    assert 4 <= len(served) < 8 and all(sum(p[x] for p in served).tolist() == [1] * quality_lm.CLASSES for x in served[0])
    sizes = [quality_lm._part(model, p).where("order > 1").count() for p in served]
    assert sum(sizes) == n and max(sizes) <= n // 4
    monkeypatch.setattr(quality_lm, "sharded_totals", None)
    key = lambda r: (r.doc_id is None, r.doc_id, r.lang, r.n_chars)
    want, got = (sorted(quality_lm.perplexities(table, model, limit=limit).collect(), key=key) for limit in (quality_lm.SMALL, n // 4))
    assert [key(r) for r in got] == [key(r) for r in want] and len(got) == table.count()
    assert all((a.perplexity is None) == (b.perplexity is None) and math.isclose(a.perplexity or 1, b.perplexity or 1, rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_quality_keeps_clean_text(spark, sf_dir, docs, rows):
    trusted = labels(spark, sf_dir).where("quality = 1")
    out = {r.doc_id: r for r in quality_lm.quality(docs, trusted).collect()}
    marked = {r.doc_id: bool(re.search(r"\*\*\*|!! ", r.text)) for r in rows}
    kept = [out[r.doc_id].kept for r in trusted.collect() if not marked[r.doc_id]]
    assert sum(kept) >= 0.97 * len(kept)
    assert not any(out[i].kept for i, m in marked.items() if m and out[i].n_chars > 200)
