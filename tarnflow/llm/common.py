"""Helpers that the document operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a new one serves a master of one
    machine (as in tests); on others it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: With it, Spark deletes the shuffle files of a query when the query has run, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of each open passing() the folders of the stashes made inside.
_passing: list[dict[str, DataFrame]] = []


def stash(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it again: lineage ends there, and losing an executor
    costs no recomputation. Shuffle files go at once, the stash when the application ends or passing() does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    if _passing:
        _passing[-1][path] = out
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def freed(*stashed: DataFrame) -> None:
    """Deletes the files of stashes that nothing reads any more: what was made of them has to be stashed, too."""
    for df in stashed:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            _deleted(df.sparkSession, path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stashes made inside are deleted at its end, but for those given to what it yields; an enclosing one has those."""
    kept: list[DataFrame] = []
    _passing.append({})
    try:
        yield lambda df: kept.append(df) or df
    finally:
        made = _passing.pop()
        for path, df in made.items():
            if any(df is x for x in kept):
                if _passing:
                    _passing[-1][path] = df
            else:
                _deleted(df.sparkSession, path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most so many (narrow) rows; else as it is, so that the
    join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_held: dict = {}


def held(key, build):
    """What build() gives, kept in this Python worker until something else is asked for: workers outlive a stage, so that one
    table at a time stays in memory."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; of a null text none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without building them one by one: white space before a word ends a split part."""
    return (F.size(F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), SPACE + r"(?=[^\x20\x09-\x0D])")) - 1).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; of a null id that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
