"""Document fingerprints: Merkle trees over sentences, paragraphs and sections.

Leaves are sentences, their parents paragraphs (lines); paragraphs are grouped into sections whose ends
depend on the paragraphs' digests, so an edit moves no section but its own; the root covers the sections.
Equal roots mean equal texts; where roots differ, only branches whose digests differ need to be followed.

A fingerprint is text:  root (32 hex digits), then for each section "/" and 16 digits, then for each of its
paragraphs ":" and 8 digits, followed by 8 digits for each sentence if the paragraph has several.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, trimmed

#: A paragraph ends its section if the first byte of its digest is below this (one in eight does).
SECTION_END = 32


def fingerprint(text: str) -> str:
    """The tree of a text. The empty text has one section of one empty paragraph."""
    sections, paragraphs, written, out = [], [], [], []

    def close() -> None:
        digest = blake2b(b"".join(paragraphs), digest_size=16).digest()
        sections.append(digest)
        out.append(f"/{digest.hex()[:16]}{''.join(written)}")
        paragraphs.clear()
        written.clear()

    for line in text.split("\n"):
        leaves = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in line.split(". ")]
        digest = blake2b(b"".join(leaves), digest_size=16).digest()
        paragraphs.append(digest)
        written.append(f":{digest.hex()[:8]}{''.join([x.hex()[:8] for x in leaves]) if len(leaves) > 1 else ''}")
        if digest[0] < SECTION_END:
            close()
    if paragraphs:
        close()
    return blake2b(b"".join(sections), digest_size=16).hexdigest() + "".join(out)


def _leaves(sections: list[str]) -> Counter:
    found: Counter = Counter()
    for s in sections:
        for p in s.split(":")[1:]:
            found.update([p] if len(p) == 8 else [p[k : k + 8] for k in range(8, len(p), 8)])
    return found


def likeness(a: str, b: str) -> float:
    """Shared leaves as a part of all leaves of both fingerprints (with repeats), 0 to 1; 1 if roots are equal.

    Sections that both have are matched whole; only the others are opened.
    """
    if a[:32] == b[:32]:
        return 1.0
    sa, sb = Counter(a.split("/")[1:]), Counter(b.split("/")[1:])
    both = sa & sb
    same = sum(_leaves([s]).total() * k for s, k in both.items())
    la, lb = _leaves(list((sa - both).elements())), _leaves(list((sb - both).elements()))
    common = same + (la & lb).total()
    return common / (2 * same + la.total() + lb.total() - common)


def differing(a: str, b: str) -> list[int]:
    """Places (from 0) of the paragraphs of a that b lacks: where a was edited. Follows differing branches alone."""
    if a[:32] == b[:32]:
        return []
    there, at, out = Counter(b.split("/")[1:]), 0, []
    rest = Counter(p for s in (Counter(b.split("/")[1:]) - Counter(a.split("/")[1:])).elements() for p in s.split(":")[1:])
    for s in a.split("/")[1:]:
        own = s.split(":")[1:]
        if there[s]:
            there[s] -= 1
        else:
            for k, p in enumerate(own):
                if rest[p]:
                    rest[p] -= 1
                else:
                    out.append(at + k)
        at += len(own)
    return out


def with_next(docs: DataFrame, ranges_a_task: int = 4) -> DataFrame:
    """(range, is_next, doc_id, text) so that each row's successor follows it. Rows are in order of doc_id, nulls
    first; null and equal ids in order of a hash of their texts, then the texts.

    Rows are cut into ranges of that order, rows of null ids into ranges of the hash; the first row of each range is
    also given, as is_next, to the end of the range before (of the first range: to the last), so one shuffle suffices
    and no task sees all rows. To the driver come the ranges' bounds, a stated number for each shuffle partition.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("key"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    n = parts * ranges_a_task
    count = docs.agg(F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("none")).first()
    keys = docs.where("key is not null").select(F.col("key").cast("double").alias("key"))
    bounds = keys.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n) if count.n > count.none else []
    splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
    if len(splits) < 3:
        splits = [-float("inf"), 0.0, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__k", outputCol="__r")
    none = max(1, -(-count.none * n // max(count.n, 1)))  # ranges of null ids, by the upper bits of the hash

    def ranged(df: DataFrame) -> DataFrame:
        of_null = F.floor((F.shiftright("tie", 32) + 2**31) * F.lit(none) / F.lit(2.0**32))
        df = cut.transform(df.withColumn("__k", F.coalesce("key", F.lit(0)).cast("double")))
        return df.withColumn("range", F.when(F.col("key").isNull(), of_null).otherwise(F.col("__r") + none).cast("int")).drop("__k", "__r")

    firsts = ranged(docs.select("key", "tie", "text")).groupBy("range").agg(F.min(F.struct(F.col("key"), "tie")).alias("first"))
    firsts = sorted((r["range"], r["first"]["key"], r["first"]["tie"]) for r in firsts.collect())
    before = [(at, firsts[i - 1][0], key, tie) for i, (at, key, tie) in enumerate(firsts)]
    before = F.broadcast(spark.createDataFrame(before, "range int, __to int, __key long, __tie long"))
    docs = ranged(docs).join(before, "range", "left")
    first = F.col("key").eqNullSafe(F.col("__key")) & (F.col("tie") == F.col("__tie"))
    own = F.struct(F.col("range"), F.lit(False).alias("is_next"))
    copies = F.when(first, F.array(own, F.struct(F.col("__to").alias("range"), F.lit(True).alias("is_next")))).otherwise(F.array(own))
    docs = docs.withColumn("__c", F.explode(copies)).select("__c.range", "__c.is_next", "key", "tie", "doc_id", "text")
    return docs.repartition(parts, "range").sortWithinPartitions("range", "is_next", "key", "tie", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and likenesses (see SCHEMA and op6).

    Null texts are empty. Rows of equal doc_id follow each other by a hash of the text; null ids come first. A table
    of one row is its own successor; an empty one gives no rows. Other columns of docs are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])))
        held = None
        for batch in batches:
            for part in slices(batch):
                rows = []
                for at, is_next, doc_id, text in zip(*[part.column(c).to_pylist() for c in ("range", "is_next", "doc_id", "text")]):
                    own = fingerprint(text)
                    if held and held[0] == at:
                        _, before, was, tree = held
                        n = len(was)
                        edited = was[: n - n // 2] + text[: n // 2]
                        changed = tree if edited == was else fingerprint(edited)
                        rows.append((before, n, sha256(edited.encode()).hexdigest(), tree, changed, likeness(tree, changed), likeness(tree, own)))
                    held = None if is_next else (at, doc_id, text, own)
                if rows:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return with_next(docs).mapInArrow(trimmed(run), SCHEMA)


def op6_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
