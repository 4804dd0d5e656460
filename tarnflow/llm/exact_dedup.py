"""Exact dedup with a heavy-hitter split [native].

Misra-Gries counters (``DataFrame.freqItems``) name the few digests that may be frequent. An exact count verifies them;
the verified winners, at most ``1 / support`` rows, are broadcast and settle their rows map-side, without a shuffle. No
digest that is left has more than ``support`` of the rows, so the ordinary shuffle has no hot partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stash

#: Digests with more than this share of the rows are always found; at most 1 / SUPPORT winners are broadcast (each
#: about 60 bytes: 120 KB in all).
SUPPORT = 1 / 2048


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest doc_id stays (a null id is the smallest); among repeated rows with that id exactly one does. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))
    rows = stash(docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("tag"), digest.alias("digest")))
    rank = F.struct("id", (-F.col("tag")).alias("tag"))

    candidates = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(rank).alias("best"), F.count("*").alias("size"))
        .where("size > 1")
    )
    winners = stash(winners)
    hot = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest", "id", "tag", F.max(rank).over(same).alias("best"), F.count("*").over(same).alias("size")
    )
    return hot.select(rest.columns).unionByName(rest).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("tag") == -F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)
"""
