"""Mixing sources to target weights [native]: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stash

#: Weights of the sources in code-point order, repeating; the share of all words to take; the most epochs of a source.
WEIGHTS, SHARE, MAX_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = "mix-1"


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with their target: weight times one water level, or max_epochs times the size where
    that is less. The level is the one at which the targets sum to share of all sizes.

    Sources fill up in order of cap / weight. If those before a source are full, the others share the rest by weight. That
    share rises while it fills a further source and falls after; the level is the highest. One row per source: the
    table is tiny.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(max_epochs)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    level = (F.sum("source_size").over(every) * F.lit(share) - F.col("full")) / F.col("open")
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), **fill) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, repeats, taken, and the columns named in keep.

    Every document is taken whole ``floor(target / source_size)`` times. The fraction that is left takes documents once
    more, in the order of a seeded digest of doc_id, until their words come nearest to it: a sample without
    replacement that a rerun repeats. The order is cut into 4096 ranges by the digest, whose sums (one row per source
    and range) say in which range the fraction ends; only that range is sorted.

    A null or blank text has size 0 and is taken 0 words (its whole repetitions remain); null sources are one source,
    last in order; null ids share one place in the order, repeated rows are ordered by size. If all sizes are 0, every
    target is 0. An empty table gives an empty result.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), digest.alias("digest"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("range", F.substring("digest", 1, 3))
    sums = stash(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **fill)
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select("source", "range", "words", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", _epochs().alias("whole")).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("source_size")
    )
    ranges = ranges.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("range").alias("r"), "source_size", "target", "whole", "extra", "before",
        ((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra"))).alias("split"),
    )
    joined = rows.join(ranges, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("source", "range").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.where("split").withColumn("upto", F.col("before") + F.sum("size").over(order))
    cut = cut.withColumn("more", F.col("upto") - F.col("size") / 2 <= F.col("extra")).drop("upto")
    rest = joined.where(~F.col("split")).withColumn("more", F.col("before") < F.col("extra"))
    repeats = (F.col("whole") + F.col("more").cast("long")).alias("repeats")
    out = rest.unionByName(cut).select("doc_id", "size", "source_size", "target", repeats, *[F.col(f"_keep_{c}") for c in keep])
    return out.select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) if c not in ("doc_id", "size", "source_size", "target", "repeats", "taken") else F.col(f"_keep_{c}") for c in keep])


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of docs, each row as often as the mix takes it."""
    names = docs.columns
    packed = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    taken = mixture(packed, keep=("_row",), **options)
    rows = taken.where("repeats > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("_copy"))
    return rows.select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM d GROUP BY source),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
        coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
        sum(source_size) OVER () * 1.5::DOUBLE AS want FROM s),
l AS (SELECT max((want - filled) / room) AS level FROM f),
t AS (SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN CAST(floor(least(cap, level * weight) / source_size) AS BIGINT) ELSE 0 END AS whole FROM f, l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS extra,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, d.size ROWS UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(digest, 1, 3) RANGE UNBOUNDED PRECEDING) AS range_end,
             sum(d.size) OVER (PARTITION BY d.source, substr(digest, 1, 3)) AS range_words
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, whole + CASE WHEN range_end - range_words > extra OR (range_end - range_words <= extra AND range_end > extra AND NOT upto - size / 2.0::DOUBLE <= extra) OR (range_end <= extra AND NOT range_end - range_words < extra) THEN 0 ELSE 1 END AS repeats FROM o)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken FROM r
"""
