"""Quality rules with cross-document line frequency [native].

Base rules look at one document. The method's own verdict looks across documents: lines are normalised and hashed, the
distinct documents of each (host, line) are counted, lines above the host's limit are removed, and a document of which too
little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate of a host if it stands in more documents than MIN_DOCS and than SHARE of the host's documents.
MIN_DOCS, SHARE = 20, 0.02
#: A document is kept if at least this part of its words is left.
LEAST_LEFT = 0.5
SYMBOLS = r"[^#*$%&|<>]+"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(w: Column) -> Column:
    """How many words of the array w stand in a 3-word window that occurs twice or more. Windows are sorted by their
    64-bit hash with their places; equal neighbours are repeats: n log n for any text."""
    after = lambda k: F.slice(w, k, F.greatest(F.size(w), F.lit(1)))
    pairs = F.zip_with(w, after(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.zip_with(pairs, after(3), lambda x, c: F.when(c.isNotNull(), F.xxhash64(x["a"], x["b"], c)))
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    placed = F.filter(placed, lambda x: x["h"].isNotNull())
    return F.sort_array(placed)


def _covered(placed: Column) -> Column:
    twins = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.flatten(F.filter(twins, lambda x: x.isNotNull()))
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def base_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), t.alias("t"))
    rows = rows.select("doc_id", "host", "t", words(F.col("t")).alias("w"), _lines(F.col("t")).alias("lines"))
    rows = rows.select(
        "doc_id", "host", F.xxhash64("t").alias("text_hash"), F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("placed"),
    )
    rows = rows.withColumn("n_repeat_words", _covered(F.col("placed"))).drop("placed")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _line_rows(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host, text_hash, line hash and its words: one row for each distinct normalised line of a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    normal = F.lower(F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " "))
    line = F.explode(F.array_distinct(F.transform(F.split(normal, "\n"), lambda x: F.trim(x)))).alias("line")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(t).alias("text_hash"), line).where("line <> ''")
    n = F.size(F.split("line", " "))
    return rows.select("doc_id", "host", "text_hash", F.xxhash64("line").alias("line"), n.cast("long").alias("line_words"))


def frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """host, line (hash), n_docs of the lines above the limit of their host. Rows that repeat a doc_id and text are one document."""
    lines = _line_rows(docs, doc_id, text, host)
    counts = lines.groupBy("host", "line").agg(F.count_distinct(F.struct("doc_id", "text_hash")).alias("n_docs")).where(F.col("n_docs") > min_docs)
    each = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    hosts = docs.groupBy(F.col(host).alias("host_")).agg(F.count_distinct(each).alias("host_docs"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n_docs") > F.lit(share) * F.col("host_docs")).select("host", "line", "n_docs")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """base_rules() with removed_words and kept.

    The document's distinct words in removed lines are counted once per line. A null text has no words and fails the base
    rules; null hosts are one host; rows that repeat a doc_id and text get the same verdict; an empty table gives none.
    Columns of other names are not read.
    """
    base = base_rules(docs, doc_id, text, host)
    often = small(frequent_lines(docs, doc_id, text, host).select(F.col("host").alias("h"), F.col("line").alias("l")))
    lines = _line_rows(docs, doc_id, text, host)
    hits = lines.join(often, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    lost = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line", "line_words")).alias("gone"))
    lost = lost.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("x"), F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["line_words"]).alias("removed_words"))
    out = base.join(lost, (F.col("text_hash") == F.col("x")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d", "x")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.lit(LEAST_LEFT) * F.col("n_words")))


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, source, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY rid),
ln AS (SELECT DISTINCT rid, source, d, trim(lower(l), ' ') AS line FROM (SELECT rid, source, (doc_id, hash(x)) AS d, unnest(string_split(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS l FROM t) WHERE trim(l, ' ') <> ''),
hosts AS (SELECT source, count(DISTINCT (doc_id, hash(x))) AS n FROM t GROUP BY source),
often AS (SELECT ln.source, line FROM ln JOIN hosts ON ln.source IS NOT DISTINCT FROM hosts.source GROUP BY ln.source, line, hosts.n HAVING count(DISTINCT d) > 20 AND count(DISTINCT d) > 0.02 * hosts.n),
gone AS (SELECT rid, sum(len(string_split(ln.line, ' '))) AS n FROM ln JOIN often ON ln.line = often.line AND ln.source IS NOT DISTINCT FROM often.source GROUP BY rid),
b AS (SELECT w.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON w.rid = c.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - coalesce(gone.n, 0) >= 0.5 * n_words AS kept
FROM f LEFT JOIN gone ON f.rid = gone.rid
"""
