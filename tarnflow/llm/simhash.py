"""SimHash near-dedup: fingerprints of word shingles, linked within three bits through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash
from .components import components
from .hamming import near_fingerprints

SHINGLE, SEED, RADIUS = 3, 42, 3


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if set in over half the XXH64 values of the word shingles, repeats included."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(w) - shingle + 1)
    stops = ends[min(shingle, len(w)) - 1 :].tolist()
    h, digest = np.empty(n, np.uint64), xxhash.xxh64_intdigest
    h[:] = [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops, strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fps = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "t": pdf["t"], "tag": pdf["tag"], "fp": fps})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, t (a hash of the text), tag, fp (long), fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest doc_id that is reached over links, the row's own included; null ids are ignored there
    unless a component has no other. Texts that are null or have no word have fingerprint zero and are linked like any
    other. Exactly one row of each component is kept: the first of its smallest doc_id. Other columns are not read. An
    empty table gives an empty result. tag numbers the rows of the written fingerprints.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.monotonically_increasing_id().alias("tag"))
    rows = stash(rows.mapInPandas(_fingerprints, "doc_id long, t long, tag long, fp long"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    distinct = stash(rows.groupBy("fp").agg(F.min(rank).alias("first")))
    linked = components(near_fingerprints(distinct, radius))
    member = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    heads = member.groupBy("c").agg(F.min("first").alias("head"))
    heads = member.join(heads, "c").select(F.col("fp").alias("f"), "head")
    return rows.join(heads, F.col("fp") == F.col("f")).select(
        "doc_id", "t", "tag", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"), (F.col("tag") == F.col("head.tag")).alias("kept"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component; columns as given. Of rows that repeat a doc_id and text one
    stays."""
    names, keys = docs.columns, ["_near_id", "_near_none", "_near_text"]
    key = lambda text: (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]), text.alias(keys[2]))
    found = near_duplicates(docs).where("kept").select(*key(F.col("t")))
    rows = docs.select("*", *key(F.xxhash64(F.coalesce("text", F.lit(""))))).join(found, keys, "left_semi")
    one = Window.partitionBy(*keys).orderBy(F.lit(0))  # by the keys of the join, so that texts are dealt once
    return rows.withColumn("_near_n", F.row_number().over(one)).where("_near_n = 1").select(*[F.col(f"`{c}`") for c in names])
