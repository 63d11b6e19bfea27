"""Token ids in word-aligned blocks (Simple-8b), written and read back as a table of binary segments.

Format of a segment, little-endian 64-bit words throughout:

    header   8 words: magic, documents, ids, ids a block, blocks, code words, escapes, 0
    doc ids  1 word a document (0 where null), then validity, 1 word a document (0: null id)
    lengths  1 word a document: its number of ids
    offsets  1 word a block: its first code word
    code     code words; blocks follow each other
    escapes  1 word each

A code word has a selector in its upper 4 bits and 60 bits of payload. Selector s > 1 packs COUNT[s] ids of
BITS[s] bits each, the first in the lowest bits; a block's last word may hold fewer, the rest zero bits.
Selector 0 is an escape: the payload is an index into the segment's escapes, for an id of over 60 bits.
Every block but a segment's last holds BLOCK ids, so any block can be decoded alone, and all at once.
Segments are rows (shard, segment, n_ids, payload) of a table that Spark's own committer writes, so a lost
executor leaves no half-written file; shards ascend with doc_id, segments within a shard too.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, table, trimmed
from .tokens import tokenizer

MAGIC = int.from_bytes(b"TSS8B\0\0\1", "little")
BLOCK = 1024
#: Bits and count of each selector from 2 on.
PACKS = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]
BITS = np.array([60, 0] + [b for b, _ in PACKS], np.uint64)
COUNT = np.array([1, 0] + [c for _, c in PACKS], np.int64)


_SHORT = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 61 stands for over 60."""
    if values.max(initial=0) < 1 << 16:
        return _SHORT[values.astype(np.int64)]
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    exact = width >= 53  # beyond what a double can tell
    if exact.any():
        width[exact] = [min(int(v).bit_length(), 61) for v in values[exact]]
    return width


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, first word of each block, and escapes of unsigned 64-bit values.

    At every place the selector that packs most of the next values is taken; all blocks advance together.
    """
    values = values.astype(np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide = BLOCK + 64  # a block's row ends in zeros, so a word never reaches into the next block
    lanes = np.zeros((blocks, wide), np.uint64)
    lanes[: n // BLOCK, :BLOCK] = values[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    lanes[-1, : n - (blocks - 1) * BLOCK] = values[(blocks - 1) * BLOCK :]
    width = _widths(lanes.ravel()).reshape(blocks, wide)
    lanes = lanes.ravel()
    top = {1: width}
    for p in (2, 4, 8, 16, 32):
        half = top[p // 2]
        top[p] = half.copy()
        np.maximum(half[:, : -p // 2], half[:, p // 2 :], out=top[p][:, : -p // 2])
    selector = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(COUNT) - 1, 1, -1):
        c = int(COUNT[s])
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(top[p][:, :BLOCK], top[p][:, c - p : c - p + BLOCK])
        np.copyto(selector, np.uint8(s), where=most <= np.uint8(BITS[s]))
    step = COUNT[selector].ravel()
    end = np.full(blocks, BLOCK)
    end[-1] = n - (blocks - 1) * BLOCK
    at, lane, places = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(lane):
        place = lane * BLOCK + at
        places.append(place)
        at = at + step[place]
        live = at < end[lane]
        if not live.all():
            lane, at = lane[live], at[live]
    place = np.sort(np.concatenate(places))
    kind = selector.ravel()[place]
    offsets = np.searchsorted(place, np.arange(blocks) * BLOCK)
    place = place // BLOCK * 64 + place
    words = np.zeros(len(place), np.uint64)
    for s in range(2, len(COUNT)):
        own = np.flatnonzero(kind == s)
        if len(own):
            from_ = place[own]
            word = lanes[from_] | (np.uint64(s) << np.uint64(60))
            for k in range(1, COUNT[s]):
                word |= lanes[from_ + k] << np.uint64(k * int(BITS[s]))
            words[own] = word
    odd = kind == 0
    words[odd] = np.arange(odd.sum(), dtype=np.uint64)
    return words, offsets, lanes[place[odd]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values that encode() was given; all words of a selector are unpacked at once."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[kind]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    place = block * BLOCK + before - before[offsets][block] if len(words) else before
    out = np.zeros(len(offsets) * BLOCK + 64, np.uint64)
    last = (block + 1) * BLOCK - place  # places left in the block
    for s in range(2, len(COUNT)):
        own = np.flatnonzero(kind == s)
        if not len(own):
            continue
        at, word = place[own], words[own]
        mask = (np.uint64(1) << BITS[s]) - np.uint64(1)
        cut = last[own] < COUNT[s]
        for k in range(COUNT[s]):
            part = (word >> np.uint64(k * int(BITS[s]))) & mask
            if cut.any():
                fine = last[own] > k
                out[at[fine] + k] = part[fine]
            else:
                out[at + k] = part
    odd = kind == 0
    out[place[odd]] = escapes[(words[odd] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def pack_segment(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = encode(ids)
    header = [MAGIC, len(doc_ids), len(ids), BLOCK, len(offsets), len(words), len(escapes), 0]
    parts = [np.array(header), doc_ids, valid, lengths, offsets]
    return b"".join([np.concatenate([np.asarray(p, "<i8") for p in parts]).tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their validity, lengths, and all ids of a segment."""
    a = np.frombuffer(payload, "<i8")
    magic, docs, n, block, blocks, words, escapes, _ = a[:8].tolist()
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    doc_ids, valid, lengths, offsets, code, rest = np.split(a[8:], np.cumsum([docs, docs, docs, blocks, words]))
    if len(rest) != escapes:
        raise ValueError("a segment is cut short")
    return doc_ids, valid.astype(bool), lengths, decode(code.view("<u8"), offsets, rest.view("<u8"), n)


SEGMENT = "shard int, segment int, n_ids long, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encodes the texts of docs (doc_id, text; null: empty) and writes segments under path.

    Rows are dealt by ranges of doc_id (nulls first; equal ids by a hash of the text) and sorted within them.
    Every row is written, repeated ones too; an empty text has the end id alone; a text stays in memory whole,
    other than that a slice of some MB at a time. An empty table gives an empty folder of segments.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ranged = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = pyspark.TaskContext.get().partitionId(), 0
        words = tokenizer(tokenizer_path, known_words=500_000)
        for batch in batches:
            for part in slices(batch, limit=3 << 20):
                ids, offsets = words.encode(part.column("text"), end_id)
                doc_id = part.column("doc_id")
                payload = pack_segment(doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), ids)
                yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
                segment += 1

    ranged.mapInArrow(trimmed(run, tokens=True), SEGMENT).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone, all ids decoded.

    start counts the ids of all documents before it: sums of shards, then of segments within a shard, are
    added to places within a segment, so no task sees more than a shard's or the shards' totals.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.select("shard", "segment", "n_ids")
    shards = totals.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard").orderBy("segment")
    bases = totals.withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids")).join(shards, "shard")
    bases = bases.select("shard", "segment", (F.col("base") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, payload in zip(batch.column("shard").to_pylist(), batch.column("segment").to_pylist(), batch.column("payload")):
                doc_ids, valid, lengths, ids = unpack_segment(payload.as_buffer())
                ids = ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                n = len(doc_ids)
                yield pa.record_batch({
                    "shard": pa.array(np.full(n, shard, np.int32)), "segment": pa.array(np.full(n, segment, np.int32)),
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=~valid), "place": pa.array(at[:-1]),
                    "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()),
                })

    decoded = segments.select("shard", "segment", "payload").mapInArrow(trimmed(run, tokens=True), "shard int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return decoded.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(spark, path)
