"""Best-fit packing of tokenised documents, with bounds that certify the number of sequences.

Pieces are dealt into small partitions, each packed by best-fit decreasing. Dual-feasible functions bound from below the
sequences that a partition needs. One that meets its bound is certified and releases only its sequences that are far from
full; the others release all with room. These are dealt anew, so that partitions exchange documents, and packed again.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import held, stash
from .textcode import slices
from .token_counts import letters

CAPACITY, SEPARATOR = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces in a partition, on average, at first and at most.
PARTITION, LARGEST = 4096, 1 << 17
#: A certified partition settles sequences that are at least so full.
FILLED = 0.95
#: Two blanks in a row; a run of them that is left to the library.
_RUN, _LONG_RUN = re.compile(r"\s\s"), re.compile(r"\s{1000}")


class Tokens:
    """Token ids of the file that the library ``tokenizers`` reads. Its merges are applied by tiktoken, which is five times as
    fast: its ranks are the file's ids, which number the merges in their order. A text without two blanks in a row is split
    by the pattern without its look-ahead, which finds the same words there. Texts with a run of a thousand blanks go through
    the library, as the look-ahead would need a stack as deep as the run."""

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {letters(k): v for k, v in file["model"]["vocab"].items() if k not in special}
        pattern = public_tokenizers.PATTERN
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens=special)
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.library = path, None

    def __call__(self, text: str) -> list[int]:
        if not _RUN.search(text):
            return self.plain.encode(text, allowed_special="all")
        if not _LONG_RUN.search(text):
            return self.full.encode(text, allowed_special="all")
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every row of docs: its token ids and the separator, cut from
    the end into pieces of capacity tokens, so that the first may be shorter. A null text counts as empty: one piece of
    one token; an empty table gives none. Rows that repeat a doc_id give pieces of their own; other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = held(("packing", path), lambda: Tokens(path))
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in slices(texts):
                rows = []
                for d, t in zip(pdf["doc_id"].iloc[a:b], texts[a:b], strict=True):
                    ids = np.array([*encode(t), SEPARATOR], "<u4")
                    n = len(ids)
                    cuts = [0, *range((n - 1) % capacity + 1, n, capacity), n]
                    for i in range(len(cuts) - 1):
                        part = ids[cuts[i] : cuts[i + 1]]
                        rows.append((d, i, cuts[i], len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)


def bin_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of these lengths has fewer bins: the largest bound by dual-feasible functions.

    One family rounds lengths above capacity - k up to capacity and those below k down to 0; the other, with k >= 1, keeps
    x if (k + 1) x is a multiple of capacity and else takes floor((k + 1) x / capacity) / k. All in whole numbers.
    """
    x, c = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    if not len(x):
        return 0
    best = -(-int((x * c).sum()) // capacity)
    total, count = np.r_[0, np.cumsum(x * c)], np.r_[0, np.cumsum(c)]
    for k in np.unique(np.minimum(np.r_[x, capacity - x + 1], capacity // 2)):
        if k < 1:
            continue
        low, high = np.searchsorted(x, k), np.searchsorted(x, capacity - k, side="right")
        high = max(low, high)
        best = max(best, int(count[-1] - count[high]) - (-int(total[high] - total[low]) // capacity))
    for k in range(1, 33):
        whole = (k + 1) * x
        value = np.where(whole % capacity == 0, k * x, whole // capacity * capacity)
        best = max(best, -(-int((value * c).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its offset there: longest first, each into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the distinct free spaces, ascending
    having: dict[int, list[int]] = {}
    n = 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, length)
        if at == len(rooms):
            b, room = n, capacity
            n += 1
        else:
            room = rooms[at]
            b = having[room].pop()
            if not having[room]:
                del having[room], rooms[at]
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        if left:
            if left not in having:
                having[left] = []
                rooms.insert(bisect_left(rooms, left), left)
            having[left].append(b)
    return bins, offsets


def _pack_partition(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        lengths, items = pdf["length"].to_numpy(), pdf["item"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        old, new = pdf["bin"].nunique(), int(bins.max()) + 1
        if old and old <= new:
            bins, offsets, new = pd.factorize(pdf["bin"])[0], pdf["at"].to_numpy(), old
        first = np.zeros(new, np.int64)
        first[bins[offsets == 0]] = items[offsets == 0]
        fill, bound = np.bincount(bins, lengths), bin_bound(lengths, capacity)
        out = pd.DataFrame({"item": items, "length": lengths, "bin": first[bins], "at": offsets, "open": (fill < (capacity if new > bound else FILLED * capacity))[bins]})
        return out.assign(bins=new, bound=bound, gain=np.where(np.arange(len(out)) == 0, (old or new + 1) - new, 0))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION, largest: int = LARGEST) -> DataFrame:
    """pieces (any columns, with a length from 1 to capacity) with sequence_id, offset, bins and bound: gapless sequences of
    at most capacity tokens, about as few as can be. bins and bound are the sequences of the partition in which this one was
    settled and the least that its pieces need.

    Rounds go on until every sequence is full or settled by a certified partition, or until one saves no sequence. Each
    doubles the pieces of a partition, up to largest. Columns of these names, or named ``_item``, are replaced. Pieces of
    equal length are packed in the order in which they were written. An empty table gives an empty result; the same
    written pieces give the same packing.
    """
    names = ["sequence_id", "offset", "bins", "bound"]
    pieces = stash(pieces.drop(*names).withColumn("_item", F.monotonically_increasing_id()))
    schema = "item long, length long, bin long, at long, open boolean, bins long, bound long, gain long"
    one = F.lit(1).cast("long")
    settled = pieces.where(F.col("length") >= capacity).select(F.col("_item").alias("item"), F.col("_item").alias("bin"), F.lit(0).cast("long").alias("at"), one.alias("bins"), one.alias("bound"))
    todo = pieces.where(F.col("length") < capacity).select(F.col("_item").alias("item"), "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("at"), one.alias("bins"), one.alias("bound"))
    n, gain, groups, i = todo.count(), 1, 2, 0
    while n and gain and groups > 1:
        groups = -(-n // min(partition << i, largest))  # what is left meets in ever larger partitions
        key = F.pmod(F.xxhash64(F.lit(i), F.coalesce("bin", "item")), F.lit(groups))
        done = stash(todo.drop("bins", "bound").withColumn("group", key).groupBy("group").applyInPandas(_pack_partition(capacity), schema))
        settled = settled.unionByName(done.where("not open").select("item", "bin", "at", "bins", "bound"))
        todo = done.where("open").select("item", "length", "bin", "at", "bins", "bound")
        n, gain = done.agg(F.coalesce(F.sum(F.col("open").cast("long")), F.lit(0)), F.coalesce(F.sum("gain"), F.lit(0))).first()
        i += 1
    plan = settled.unionByName(todo.select(settled.columns)).select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"), "bins", "bound")
    return pieces.join(plan, pieces["_item"] == plan["item"]).drop("_item", "item")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence: the ids of its pieces in order. Needs pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Every document of docs, tokenised and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    bins, bound."""
    return pack(tokenize(docs))
