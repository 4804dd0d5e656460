"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Every table is sharded by (language, n-gram) and every step is a join or an aggregation on that key: counts of the highest
order, continuation counts of the lower ones, context sums, discounts, and the probabilities from the lowest order up. Texts
are scored against the finished table, which is sent to the executors: where a count shows that it is small at once, else in
parts with a pass over the texts each, so that no n-gram of a text is shuffled. A text is kept if its perplexity is at most the language's limit, a
multiple of a quantile over the trusted texts of that language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, small, stash
from .textcode import code_points, slices
from .token_counts import Slots

#: Order of the model; bits of a character's class in an n-gram's number, the newest character lowest. Class 0 stands
#: before a text; characters from 4000 on share 95 classes.
ORDER, BITS, WIDE, SHARED = 5, 12, 4000, 95
#: Kept up to SLACK times this quantile of the trusted texts' perplexities; times e to SHORT / sqrt(characters), as the
#: perplexity of a short text scatters.
QUANTILE, SLACK, SHORT, ACCURACY = 0.9, 1.2, 1.5, 10_000
#: A table of more rows is not sent to the executors at once (16 bytes each).
SMALL = 3_000_000
CLASSES = WIDE + SHARED + 1


def classes(points: np.ndarray) -> np.ndarray:
    return np.where(points < WIDE, points + 1, WIDE + 1 + points % SHARED).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The highest-order n-gram that ends at each character, and the number of its text."""
    points, starts = code_points(texts)
    c, n = classes(points), np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(points)) - starts[owner]
    key = c.copy()
    for j in range(1, ORDER):
        key[j:] |= np.where(place[j:] >= j, c[:-j], 0) << (BITS * j)
    return key, owner


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=False):
            texts = part["text"].tolist()
            for a, b in slices(texts):
                key, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "key": key, "n": n})


def _low(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the discounts of counts 1, 2 and 3 or more, from how many n-grams were counted once to four times."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
    d = [i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)) for i in (1, 2, 3)]
    return n.select("lang", *[F.least(F.greatest(F.coalesce(x, F.lit(0.5 * i)), F.lit(0.05)), F.lit(0.95 * i)).alias(f"d{i}") for i, x in enumerate(d, 1)])


def train(texts: DataFrame) -> DataFrame:
    """texts (lang, text) to the table lang, order, kind, key, value: kind p holds log probabilities of n-grams, kind b the
    logs of the weights with which a context (key) hands over to the order below."""
    rows = texts.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    counts = stash(rows.mapInPandas(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stash(levels[k + 1].groupBy("lang", _low(k).alias("key")).agg(F.count("*").alias("n")))
    below, out = None, None
    for k in range(1, ORDER + 1):
        c = levels[k].join(F.broadcast(_discounts(levels[k])), "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.select("lang", "key", F.shiftright("key", BITS).alias("context"), F.col("n").cast("double").alias("n"), cut.alias("cut"))
        context = stash(c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("lost")))
        c = c.join(context, ["lang", "context"]).select("lang", "key", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), (F.col("lost") / F.col("total")).alias("weight"))
        if below is None:
            c = c.withColumn("p", F.col("own") + F.col("weight") / CLASSES)
        else:
            c = c.withColumn("low", _low(k - 1)).join(below.select("lang", F.col("key").alias("low"), F.col("p").alias("q")), ["lang", "low"])
            c = c.withColumn("p", F.col("own") + F.col("weight") * F.col("q"))
        below = stash(c.select("lang", "key", "p"))
        parts = below.select("lang", F.lit(k).alias("order"), F.lit("p").alias("kind"), "key", F.log("p").cast("float").alias("value")).unionByName(
            context.select("lang", F.lit(k).alias("order"), F.lit("b").alias("kind"), F.col("context").alias("key"), F.log(F.col("lost") / F.col("total")).cast("float").alias("value"))
        )
        out = parts if out is None else out.unionByName(parts)
    return out


def gathered(model: DataFrame) -> dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]]:
    """The keys and values of the table by language, order and kind, as arrays: 12 bytes a row."""
    langs = sorted(r[0] for r in model.select("lang").distinct().collect())
    kinds = [(x, k, kind) for x in langs for k in range(1, ORDER + 1) for kind in "pb"]
    out = {}
    for x in langs:
        number = ((F.col("order") - 1) * 2 + F.when(F.col("kind") == "b", 1).otherwise(0)).alias("number")
        got = model.where(F.col("lang") == x).select(number, "key", "value").toArrow()
        number, key, value = (got.column(c).to_numpy() for c in ("number", "key", "value"))
        for i, kind in enumerate(k for k in kinds if k[0] == x):
            out[kind] = key[number == i], value[number == i].astype(np.float32)
    return out


class Scorer:
    """The table in memory, as hash tables by language."""

    def __init__(self, arrays: dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]]):
        self.tables: dict[str, dict] = {}
        for (lang, order, kind), (key, value) in arrays.items():
            slots = Slots(max(4, int(np.ceil(np.log2(2 * len(key) + 1)))))
            slots.add(key, np.arange(len(key), dtype=np.int32))
            self.tables.setdefault(lang, {})[order, kind] = slots, value.astype(np.float64)

    def log_likelihoods(self, lang: str, texts: list[str], mine: np.ndarray | None = None) -> np.ndarray | None:
        """The log probability of each text's characters together, or of those after a character whose class is marked in mine; None
        if the language has no model."""
        tables = self.tables.get(lang)
        if tables is None:
            return None
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            key, owner = grams(texts[a:b])
            if mine is not None:
                here = mine[key >> BITS & CLASSES - 1]
                key, owner = key[here], owner[here]
            value, left = np.zeros(len(key)), np.arange(len(key))
            for k in range(ORDER, 0, -1):
                low = key[left] & ((1 << BITS * k) - 1)
                slots, p = tables[k, "p"]
                at = slots.find(low)
                value[left] += np.where(at >= 0, p[at], 0.0)
                left, low = left[at < 0], low[at < 0]
                if not len(left):
                    break
                slots, p = tables[k, "b"]
                at = slots.find(low >> BITS)
                value[left] += np.where(at >= 0, p[at], 0.0)
            else:
                value[left] -= np.log(CLASSES)
            out[a:b] = np.bincount(owner, value, minlength=b - a)
        return out


def _score(shared: Broadcast, name: str, columns: list[str]):
    """Rows with their total; shared holds the arrays of a table, or of a part, and then which characters it serves by language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, mine = held(("quality_lm", name), lambda: (Scorer(shared.value[0]), shared.value[1]))
        for pdf in batches:
            total = np.full(len(pdf), np.nan)
            lang = pdf["lang"].to_numpy()
            for x in pd.unique(lang):
                of = np.flatnonzero(lang == x)
                if (got := scorer.log_likelihoods(x, pdf["text"].iloc[of].tolist(), mine.get(x))) is not None:
                    total[of] = got
            yield pdf[columns].assign(total=total)

    return run


def _scored(rows: DataFrame, arrays: dict, mine: dict[str, np.ndarray]) -> DataFrame:
    """rows (lang, text and others) with total in place of text."""
    shared = rows.sparkSession.sparkContext.broadcast((arrays, mine))
    rest = rows.drop("text")
    schema = ", ".join(f"{c} {kind}" for c, kind in rest.dtypes) + ", total double"
    return rows.mapInPandas(_score(shared, f"{id(shared)}-{np.random.default_rng().integers(1 << 60)}", rest.columns), schema)


def _before() -> Column:
    """The class of the character before the last of a row's n-gram: that of an n-gram's probabilities and back-off weights in all orders
    but the first."""
    return F.when(F.col("kind") == "p", F.shiftright("key", BITS)).otherwise(F.col("key")).bitwiseAND(F.lit(CLASSES - 1)).alias("before")


def parts(model: DataFrame, limit: int) -> list[dict[str, np.ndarray]] | None:
    """Parts of the table of at most limit rows, besides those of order 1, which all parts have: by language the characters (marked by
    class) whose n-grams a part serves. None if one character of a language has more rows."""
    counts = model.where("order > 1").groupBy("lang", _before()).count().collect()
    langs = sorted(r[0] for r in model.select("lang").distinct().collect())
    rows, out = [], []
    for r in sorted(counts, key=lambda r: (-r["count"], r["lang"], r["before"])):
        if r["count"] > limit:
            return None
        k = next((k for k, n in enumerate(rows) if n + r["count"] <= limit), len(rows))
        if k == len(rows):
            rows.append(0)
            out.append({x: np.zeros(CLASSES, bool) for x in langs})
        rows[k] += r["count"]
        out[k][r["lang"]][r["before"]] = True
    for x in langs if out else []:  # characters that the table does not know need order 1 only
        out[0][x] |= ~np.any([part[x] for part in out], axis=0)
    return out or None


def _part(model: DataFrame, part: dict[str, np.ndarray]) -> DataFrame:
    place = [(x, int(c)) for x, mine in part.items() for c in np.flatnonzero(mine)]
    place = F.broadcast(model.sparkSession.createDataFrame(place, "lang string, before long"))
    return model.where("order = 1").unionByName(model.where("order > 1").withColumn("before", _before()).join(place, ["lang", "before"], "left_semi").drop("before"))


def totals_by_parts(rows: DataFrame, model: DataFrame, served: list[dict[str, np.ndarray]]) -> DataFrame:
    """rows (doc_id, lang, n_chars, text) with total in place of text: a pass over the texts for each part of the table. What passes
    give is joined by the text's hash; rows that repeat a doc_id and text have the same total."""
    keys = ["doc_id", "lang", "n_chars", "t"]
    rows, passes = rows.withColumn("t", F.xxhash64("text")), []
    for part in served:
        scored = stash(_scored(rows, gathered(_part(model, part)), part))
        passes.append(scored.groupBy(*keys).agg(F.count("*").alias("n"), F.first("total").alias("total")))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    every = every.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("total").alias("total"))
    return every.select("doc_id", "lang", "n_chars", "total", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, tags, langs = pdf["text"].tolist(), pdf["tag"].to_numpy(), pdf["lang"].to_numpy()
        for a, b in slices(texts):
            key, owner = grams(texts[a:b])
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)])
            n = np.diff(np.r_[first, len(key)])
            yield pd.DataFrame({"tag": tags[a + owner[first]], "lang": langs[a + owner[first]], "key": key[first], "n": n})


def sharded_totals(rows: DataFrame, model: DataFrame) -> DataFrame:
    """tag and total of the rows (tag, lang, text): the distinct n-grams of each are joined to the shards of the model, and
    their log probabilities, handed down where a shard has none, are summed by row."""
    scored = rows.mapInPandas(_emit, "tag long, lang string, key long, n long")
    p = b = None
    for k in range(ORDER, 0, -1):
        at = {kind: model.where((F.col("order") == k) & (F.col("kind") == kind)).select("lang", F.col("key").alias(f"{kind}_key{k}"), F.col("value").alias(f"{kind}{k}")) for kind in "pb"}
        scored = scored.withColumn(f"p_key{k}", _low(k)).withColumn(f"b_key{k}", F.shiftright(_low(k), BITS))
        scored = scored.join(at["p"], ["lang", f"p_key{k}"], "left").join(at["b"], ["lang", f"b_key{k}"], "left")
    value = F.lit(-float(np.log(CLASSES)))
    for k in range(1, ORDER + 1):
        p, b = F.col(f"p{k}").cast("double"), F.col(f"b{k}").cast("double")
        value = F.coalesce(p, F.coalesce(b, F.lit(0.0)) + value)
    known = model.select("lang").distinct()
    return scored.join(F.broadcast(known), "lang", "left_semi").groupBy("tag").agg(F.sum(F.col("n") * value).alias("total"))


def perplexities(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = SMALL) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_chars, perplexity (null for a text that is null or empty, and for a language
    without trusted text; null languages are one language)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.char_length(t).cast("long").alias("n_chars"), t.alias("text"))
    if model.count() <= limit:
        scored = _scored(rows, gathered(model), {})
    elif served := parts(model, limit):
        scored = totals_by_parts(rows, model, served)
    else:
        rows = rows.withColumn("tag", F.monotonically_increasing_id())
        scored = rows.drop("text").join(sharded_totals(rows.select("tag", "lang", "text"), model), "tag", "left")
    total = F.nanvl(F.col("total"), F.lit(None).cast("double"))
    return scored.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-total / F.col("n_chars"))).alias("perplexity"))


def quality(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """perplexities() with the language's limit and kept.

    trusted holds the doc_ids whose texts train the model and set the limits. A text with no character is not kept; one
    without a perplexity for lack of trusted text in its language is. Repeated rows are each a row of their own. Other
    columns are not read; an empty table gives an empty result.
    """
    ids = small(trusted.select(F.col("doc_id").alias("_trusted")).distinct())
    texts = docs.join(ids, F.col(doc_id) == F.col("_trusted"), "left_semi").select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    scored = stash(perplexities(docs, stash(train(texts)), doc_id, text, lang))
    limits = scored.join(ids, F.col("doc_id") == F.col("_trusted"), "left_semi").groupBy("lang").agg((F.percentile_approx("perplexity", quantile, ACCURACY) * slack).alias("limit"))
    out = scored.join(F.broadcast(limits), "lang", "left")
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("limit") * F.exp(SHORT / F.sqrt("n_chars")), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "limit", kept.alias("kept"))
