"""Best-two-fit packing of token pieces into sequences.

Packing depends on the lengths alone, of which there are at most as many as a sequence has places. So the
histogram of lengths is packed on the driver, as piece by piece (a test holds the two equal): a bin is filled greedily with the
longest piece that fits; when none does, its smallest piece is replaced by the two unpacked pieces that fit
the expanded gap most tightly, if they fill more of it. The same bin is then repeated as long as the
lengths last, which is what going piece by piece would do, so the work doesn't depend on the number of
pieces. Pieces are ranked within their length and take the slots of that rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, slices, table, trimmed, tuned
from .tokens import tokenizer


def best_two_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: times}, number of such bins), for counts[length] pieces of each length.

    The capacity is len(counts) - 1; counts[0] is ignored.
    """
    capacity, left, bins = len(counts) - 1, counts.astype(np.int64).copy(), []
    left[0] = 0
    lengths = np.flatnonzero(left)
    while len(lengths):
        gap, used = capacity, {}
        while gap:
            at = np.searchsorted(lengths, gap, side="right") - 1
            while at >= 0 and used.get(int(lengths[at]), 0) >= left[lengths[at]]:
                at -= 1
            if at < 0:
                break
            size = int(lengths[at])
            times = min(gap // size, int(left[size]) - used.get(size, 0))
            used[size] = used.get(size, 0) + times
            gap -= times * size
        if gap and len(used):
            least = min(used)
            room = left[lengths] - np.array([used.get(int(x), 0) for x in lengths])
            free, twice = lengths[room > 0], set(lengths[room > 1].tolist())
            best, pair = (least, capacity), None
            if len(free):
                partner = np.searchsorted(free, gap + least - free, side="right") - 1
                for i in np.flatnonzero((partner >= 0) & (free + free[np.maximum(partner, 0)] > least)):
                    a, j = int(free[i]), int(partner[i])
                    if a == free[j] and a not in twice:
                        j -= 1
                    b = int(free[j])
                    # of equal sums, the one with the longest piece
                    if j >= 0 and (a + b, max(a, b)) > best:
                        best, pair = (a + b, max(a, b)), (a, b)
            if pair:
                used[least] -= 1
                if not used[least]:
                    del used[least]
                for x in pair:
                    used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in used.items())
        bins.append((used, times))
        for x, k in used.items():
            left[x] -= k * times
        lengths = lengths[left[lengths] > 0]
    return bins


def slots(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, times in the bin, first sequence, offset): the r-th piece of that
    length lies in sequence  first sequence + (r - first rank) // times  at  offset + (r - first rank) % times * length.
    """
    rows, taken, sequence = [], {}, 0
    for used, times in bins:
        offset = 0
        for size, k in sorted(used.items(), reverse=True):
            a = taken.get(size, 0)
            rows.append((size, a, a + k * times, k, sequence, offset))
            taken[size] = a + k * times
            offset += k * size
        sequence += times
    return rows


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; only documents over `capacity` are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch, limit=3 << 20):
                ids, offsets = words.encode(part.column("text"), end_id)
                ids, size = ids.astype("<u4"), np.diff(offsets)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = (offsets[doc] + start).tolist()
                crc = [zlib.crc32(ids[a : a + b]) for a, b in zip(at, length.tolist())]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return docs.select("doc_id", "text").mapInArrow(trimmed(run, tokens=True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """pieces() with sequence_id and offset. Every row of docs is packed, repeated ones too; null texts are
    empty and have the end id alone; an empty table gives no rows; other columns of docs are left out.

    To the driver come at most `capacity` counts; the table of slots has at most some times as many rows.
    Ranks within a length are taken in buckets of a hash, so a length that most pieces have is no hot key.
    """
    spark = docs.sparkSession
    found = keep(pieces(docs, tokenizer_path, end_id, capacity))
    buckets = 4 * max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    tally = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    table_of_slots = spark.createDataFrame(slots(best_two_fit(counts)), "length long, first long, until long, times long, sequence long, place long")
    prior = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(prior, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    by_length = table_of_slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "until", "times", "sequence", "place"))).alias("s"))
    ranked = ranked.join(F.broadcast(by_length), "length")
    slot = F.element_at("s", F.expr("size(filter(s, x -> x.first <= r))").cast("int"))
    into = F.col("r") - F.col("slot.first")
    return ranked.withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(into / F.col("slot.times"))).cast("long").alias("sequence_id"),
        (F.col("slot.place") + F.pmod(into, F.col("slot.times")) * F.col("length")).cast("long").alias("offset"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences; copies of a document are packed as documents of their own."""
    tuned(spark)
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
