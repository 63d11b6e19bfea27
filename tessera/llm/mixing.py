"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Each source is cut into 2^m blocks of some thousand words, by ranges of a hash of its documents, and its blocks are
permuted by a seeded bijection. The mix takes the first blocks of that order, the last one in part, until `target` words
are reached, going through them again where the target is larger than the source: a quota of blocks. A binary tree
over the output shards splits each node's quotas, all sources at once, by a multivariate hypergeometric draw, as a
uniform shuffle of all blocks would. A shard draws its quota of each source's permuted blocks, disjoint from other
shards', and its rows are shuffled locally by a hash. What is taken of a document is what shards drew of its block.

All that a document needs to know is one row of its source: its permutation, where its quota ends and which shard
draws which blocks. So texts are moved once, to their shards.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, small, table, tuned

#: At most so many groups of sources; rounds of the bijection that permutes blocks.
GROUPS, ROUNDS = 1024, 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words of the text (null: 0)."""
    return _once(docs.drop("size"), "size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: what uses it often doesn't repeat it, as it would a projection."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def targets(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, sid, source_size, target: one row a source, in code-point order (null last).

    Water-filling in closed form: with sources by rising cap / weight, those before the first whose even
    share is no more than its cap stop at their caps, and the rest get shares by weight.
    """
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "sid")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"])
    return s.select("source", "sid", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int, room: np.ndarray | None = None) -> np.ndarray:
    """Blocks of each source in each shard, [shards, sources]; columns add up to the quotas. room: blocks that each
    shard takes; else shards have as equal totals as can be. Each node draws with a seed of its own place, so reruns
    agree."""
    out, total = np.zeros((shards, len(quotas)), np.int64), int(quotas.sum())
    if room is None:
        room = np.diff([total * k // shards for k in range(shards + 1)])

    def split(a: int, b: int, have: np.ndarray) -> None:
        if b - a == 1 or not have.any():
            out[a] = have
            return
        middle = (a + b) // 2
        key = int.from_bytes(hashlib.sha256(f"{seed}/{a}/{b}".encode()).digest()[:8], "little")
        left = np.random.default_rng(key).multivariate_hypergeometric(have, int(room[a:middle].sum()), method="marginals")
        split(a, middle, left)
        split(middle, b, have - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def _shares(goals: DataFrame, shards: int, seed: int) -> DataFrame:
    """goals (sid, quota) with upto and at: that shard at[k] draws the quota's blocks up to upto[k], from upto[k - 1].

    Sources are split in groups of some thousand, and the tree of the groups, of which there are GROUPS at most, gives
    each group's room in each shard; drawing within a group, given its totals, is the same as drawing at once.
    """
    n = goals.count()
    groups = max(1, min(GROUPS, -(-n // 1024)))
    goals = goals.withColumn("__g", F.pmod("sid", F.lit(groups)).cast("int"))
    totals = np.zeros(groups, np.int64)
    for r in goals.groupBy("__g").agg(F.sum("quota").alias("n")).collect():
        totals[r["__g"]] = r.n
    room = splitting_tree(totals, shards, seed)

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        g = int(rows["__g"].iloc[0])
        drawn = splitting_tree(rows.quota.to_numpy(), shards, seed + 1 + g, room[:, g]).T
        at = [np.flatnonzero(x) for x in drawn]
        return pd.DataFrame({"sid": rows.sid, "upto": [x[k].cumsum() for x, k in zip(drawn, at)], "at": at})

    return goals.drop("__g").join(goals.select("__g", "sid", "quota").groupBy("__g").applyInPandas(split, "sid int, upto array<long>, at array<int>"), "sid")


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")).cast("binary"))


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def _steps(seed: int) -> Column:
    """Odd factors and numbers of each round of a source's permutation."""
    out = []
    for r in range(ROUNDS):
        drawn = F.md5(F.concat_ws("|", F.lit(seed), F.col("sid"), F.lit(r)).cast("binary"))
        out += [_number(drawn, 7).bitwiseOR(F.lit(1)), _number(F.substring(drawn, 9, 7), 7)]
    return F.array(*out)


def _permuted(o: Column) -> Column:
    """The order's key of a row with bits and steps: the permuted block's place (left-aligned in 32 bits), then the hash
    o. The bijection on m bits: for each round, times an odd number, plus a number, xor its own upper half."""
    x = F.call_function("shiftright", _number(o, 8), F.lit(32) - F.col("bits"))
    held = F.struct(x.alias("x"), F.expr("shiftleft(1L, bits) - 1").alias("mask"), F.expr("greatest(1, int((bits + 1) / 2))").alias("half"))

    def round_(s: Column, r: Column) -> Column:
        moved = (s["x"] * F.get("steps", 2 * r) + F.get("steps", 2 * r + 1)).bitwiseAND(s["mask"])
        return F.transform(F.array(moved), lambda y: F.struct(y.bitwiseXOR(F.call_function("shiftright", y, s["half"])).alias("x"), s["mask"].alias("mask"), s["half"].alias("half")))[0]

    placed = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), held, round_)["x"]
    return F.concat(F.lower(F.lpad(F.hex(F.call_function("shiftleft", placed, F.lit(32) - F.col("bits"))), 8, "0")), o)


def _edges(light: DataFrame, goals: DataFrame) -> DataFrame:
    """sid, edge, edge_words: the order's key at which the rest of a source's target ends, and how many words
    of the document there it takes (rows with the same key, repeats of an id and size, take equal parts).

    Sums of 4096 ranges of the key tell the range in which the rest ends; only its documents are put in order.
    """
    goals = small(goals.select(F.col("source").alias("__s"), "sid", "bits", "steps", "rest"))
    light = light.join(goals, F.col("source").eqNullSafe(F.col("__s")))
    light = _once(light.select("sid", "size", "rest", "bits", "steps", F.col("o").alias("__o")), "o", _permuted(F.col("__o")))
    light = light.select("sid", "size", "rest", "o", F.substring("o", 1, 3).alias("b"))
    sums = light.groupBy("sid", "b").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("b")) - F.col("n"))
    rest = goals.select("sid", "rest")
    last = sums.join(rest, "sid").where("before < rest and rest <= before + n").select("sid", "b", "before")
    inside = light.join(small(last), ["sid", "b"]).groupBy("sid", "o", "rest", "before").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("sid").orderBy("o"))
    inside = inside.withColumn("end", end).where("rest > end - n and rest <= end")
    return inside.select("sid", F.col("o").alias("edge"), F.expr("(rest - (end - n)) div k").alias("edge_words"))


def mix(docs: DataFrame, shards: int | None = None, block_words: int = 4096, seed: int = 11, weights=(5, 2, 1), share: float = 1.5) -> DataFrame:
    """docs (doc_id, source, size and any other columns) with source_size, target, taken and draws.

    draws: array of (copy, words, shard, key): which copies of the document shards drew, how many of its first
    words each copy has (all but for the one document of a source where the target ends), the shard and the place
    within it by rising key. taken: the words of its draws. Each source's words add up to its target, rounded; a
    document is taken at most twice. Documents without words are taken without words, never; null sources are a
    source; repeated rows are documents of their own; an empty table gives an empty result. Columns of docs with the
    names added here are replaced.

    shards: as many as there are shuffle partitions, unless given. To the driver come totals of GROUPS groups of
    sources at most. The hypergeometric draws need under 10^9 blocks, so blocks grow with the words beyond that.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.drop("source_size", "target", "taken", "draws")
    light = keep(docs.select("source", "size", _order(seed).alias("o")))  # texts are read for their sizes once, and once more below
    goals = keep(targets(light, weights, share).withColumn("n", F.floor(F.col("target") + 0.5)))
    block = max(block_words, math.ceil((goals.agg(F.sum("source_size")).first()[0] or 0) / 1e8))
    goals = goals.withColumn("__b", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)))
    goals = goals.withColumn("bits", F.when(F.col("__b") > 1, F.length(F.bin(F.col("__b") - 1))).otherwise(0).cast("int")).drop("__b").withColumn("steps", _steps(seed))
    goals = goals.withColumn("full", F.when(F.col("source_size") > 0, F.expr("n div source_size")).otherwise(0).cast("int"))
    goals = goals.withColumn("rest", F.col("n") - F.col("full") * F.col("source_size"))
    goals = goals.join(_edges(light, goals), "sid", "left").withColumn("blocks", F.expr("shiftleft(1L, bits)"))
    into = F.when(F.col("edge").isNull(), 0).otherwise(F.expr("shiftright(conv(substring(edge, 1, 8), 16, 10) :: long, 32 - bits) + 1"))
    goals = keep(goals.withColumn("quota", F.col("full") * F.col("blocks") + into))
    plan = _shares(goals, shards, seed).select(F.col("source").alias("__s"), "sid", "source_size", "target", "bits", "steps", "full", "edge", "edge_words", "blocks", "quota", "upto", "at")
    plan = small(keep(plan), 40_000_000 // (12 * shards))
    own = ["__s", "sid", "bits", "steps", "full", "edge", "edge_words", "blocks", "quota", "upto", "at", "o", "__place"]
    held = {c: f"__own_{c}" for c in own if c in docs.columns}  # columns of docs that are called so
    docs = docs.withColumnsRenamed(held)
    docs = _once(docs.join(plan, F.col("source").eqNullSafe(F.col("__s"))), "o", _permuted(_order(seed)))
    docs = docs.withColumn("__place", F.expr("shiftright(conv(substring(o, 1, 8), 16, 10) :: long, 32 - bits)"))
    halves = F.array(*[F.lit(1 << k) for k in range(shards.bit_length() - 1, -1, -1)])
    part = F.when(F.col("o") < F.col("edge"), F.col("size")).when(F.col("o") == F.col("edge"), F.col("edge_words")).otherwise(0)

    def draw(copy: int) -> Column:
        at = F.col("__place") + copy * F.col("blocks")
        # the number of entries of upto that are <= at, by halving: the shard that draws this block, if one does
        go = lambda k, step: F.when((k + step <= F.size("upto")) & (F.get("upto", k + step - 1) <= at), k + step).otherwise(k)
        shard = F.get("at", F.aggregate(halves, F.lit(0), go))
        words = F.when(shard.isNull(), 0).when((at == F.col("quota") - 1) & F.col("edge").isNotNull(), part).otherwise(F.col("size"))
        return F.struct(F.lit(copy).alias("copy"), words.cast("long").alias("words"), shard.alias("shard"), F.xxhash64(F.lit(seed), "o", F.lit(copy)).alias("key"))

    docs = docs.withColumn("draws", F.filter(F.array(draw(0), draw(1)), lambda x: x.words > 0))
    docs = docs.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x.words))
    return docs.drop(*own).withColumnsRenamed({v: k for k, v in held.items()})


def spread(mixed: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a copy, with copy, words, shard, key; text cut to the copy's words. With shards (as given to
    mix()), partition k holds shard k in its local shuffled order."""
    out = mixed.withColumn("__d", F.explode("draws")).select(*[c for c in mixed.columns if c != "draws"], "__d.*")
    if "text" in out.columns:
        first = F.array_join(F.slice(F.split(F.ltrim("text"), r"[\x20\x09-\x0D]+"), 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), " ")
        out = out.withColumn("text", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text")))
    return out.sortWithinPartitions("shard", "key") if shards is None else out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row a copy taken, cut where a source's target ends, in shuffled shards."""
    tuned(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = spread(mix(sized(docs), shards), shards)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keep(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _permuted_sql() -> str:
    """Rounds of _permuted() over d (x, bits, sid), as common table expressions x0, x1, ..."""
    out = []
    for r in range(ROUNDS):
        h = f"md5('11|' || sid || '|{r}')"
        step = f"((x * (('0x' || substr({h}, 1, 7))::BIGINT | 1) + ('0x' || substr({h}, 9, 7))::BIGINT) & ((1::BIGINT << bits) - 1))"
        before = "b" if r == 0 else f"x{r - 1}"
        out.append(f"x{r} AS (SELECT * REPLACE (xor(x, x >> greatest(1, (bits + 1) // 2)) AS x) FROM (SELECT * REPLACE ({step} AS x) FROM {before}))")
    return ", ".join(out)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
        - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
t AS (SELECT source, sid, source_size, least(cap, (SELECT arg_min(level, (ratio, sid)) FROM l WHERE level <= ratio) * weight) AS target,
        CASE WHEN source_size <= 4096 THEN 0 ELSE length(bin((source_size + 4095) // 4096 - 1)) END::BIGINT AS bits FROM l),
h AS (SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, t.bits, floor(t.target + 0.5)::BIGINT AS n,
        md5('11|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size) AS o FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT >> (32 - bits) AS x FROM h), {_permuted_sql()},
c AS (SELECT *, (sum(size) OVER (PARTITION BY sid ORDER BY x, o, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place FROM x{ROUNDS - 1})
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, n - place)) + greatest(0, least(size, n - place - source_size)))::BIGINT AS taken FROM c"""
