"""Text defects, lengths and the tests around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, normal_sf
from .ordered import running

#: Whole answers that say nothing, in lower case, before an optional final mark (fixed values).
NON_ANSWERS = [
    "n/?a", "null", "none", "nan", "nil",
    "unsure", "not sure", "unclear", "unknown", "idk", "i don'?t know", "can'?t tell", "cannot tell",
    "no action", "not action", "no motion", "no movement", "no task", "nothing", "nothing happens",
    "no instruction", "invalid", "blank", "empty",
]


def normalise(text) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def no_terminal(text) -> Column:
    return ~F.right(text, F.lit(1)).isin(".", "!", "?")


def non_answer(text) -> Column:
    return F.lower(text).rlike("^(?:" + "|".join(NON_ANSWERS) + ")[.!?]?$")


def junk(text) -> Column:
    """Under two ASCII letters, or one character over and over."""
    return (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) < 2) | (F.replace(text, F.substring(text, 1, 1), F.lit("")) == "")


def words(text) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def flag_truncated(df: DataFrame, text: str, dictionary: DataFrame | None = None, rare: int = 2, common: int = 20) -> DataFrame:
    """df with truncated: the text doesn't end in .!? and its last word is rare, while longer words that begin
    with it are common; words of 4 letters or more of the dictionary (column word) are never cut words.

    Word counts are one aggregate. Only rare words that end a text without a mark are asked for, so each other distinct
    word is cut to the few lengths that those have, and cuts that aren't among them go before they are added up.
    """
    low = F.lower(text)
    tokens = df.select(F.explode(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))).alias("w"))
    vocabulary = tokens.groupBy("w").agg(F.count("*").alias("c"))
    # the last word is the first of the text read backwards
    last = F.reverse(F.regexp_extract(F.reverse(low), "^[^a-z]*+([a-z]++)", 1))
    tails = df.withColumn("w", F.when(no_terminal(F.col(text)), F.nullif(last, F.lit(""))))
    asked = tails.select("w").where("w is not null").distinct().join(vocabulary.where(F.col("c") <= rare), "w")
    sizes = F.broadcast(asked.agg(F.collect_set(F.length("w")).alias("sizes")))
    cuts = vocabulary.crossJoin(sizes).select("w", "c", F.explode(F.filter("sizes", lambda k: k < F.length("w"))).alias("k"))
    cuts = cuts.select(F.substr("w", F.lit(1), F.col("k")).alias("w"), F.col("c").alias("x"))
    found = cuts.join(asked.select("w"), "w", "left_semi").groupBy("w").agg(F.sum("x").alias("x")).where(F.col("x") >= common)
    out = tails.join(found, "w", "left")
    flag = F.col("x").isNotNull()
    if dictionary is not None:
        known = dictionary.select(F.col("word").alias("w"), F.lit(True).alias("known")).distinct()
        out = out.join(known, "w", "left")
        flag = flag & ~((F.length("w") >= 4) & F.coalesce("known", F.lit(False)))
    return out.withColumn("truncated", F.coalesce(flag, F.lit(False))).drop("w", "x", "known")


def length_distribution(df: DataFrame, text: str) -> DataFrame:
    """measure, least, p5, ..., most (cut to integers) and mean of characters and words."""
    both = df.select(F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.length(text).alias("v")), F.struct(F.lit("words").alias("measure"), words(F.col(text)).alias("v"))))).select("col.*")
    at = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    p = both.groupBy("measure").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p"), F.avg("v").alias("mean"))
    names = ["least", "p5", "p25", "p50", "p75", "p95", "p99", "most"]
    return p.select("measure", *[F.element_at("p", k + 1).cast("int").alias(n) for k, n in enumerate(names)], "mean")


def contingency(df: DataFrame, group: str, flag: str) -> DataFrame:
    """statistic, dof, expected_under_5, p: chi-square of flag by group; Yates' rule where dof is 1."""
    cells = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("k"))
    all_ = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("rows", F.sum("n").over(all_)).withColumn("flagged", F.sum("k").over(all_)).withColumn("groups", F.count("*").over(all_))
    yes = F.struct(F.col("k").alias("o"), (F.col("n") * F.col("flagged") / F.col("rows")).alias("e"))
    no = F.struct((F.col("n") - F.col("k")).alias("o"), (F.col("n") * (F.col("rows") - F.col("flagged")) / F.col("rows")).alias("e"))
    long = cells.select("groups", F.explode(F.array(yes, no)).alias("c")).select("groups", "c.*")
    gap = F.abs(F.col("o") - F.col("e"))
    gap = F.when(F.col("groups") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    row = long.agg(F.sum(F.try_divide(gap * gap, F.col("e"))).alias("statistic"), (F.max("groups") - 1).cast("long").alias("dof"), F.sum((F.col("e") < 5).cast("long")).alias("expected_under_5"))
    found = row.first()
    p = chi2_sf(found.statistic, found.dof) if found.dof and found.statistic is not None else None
    return row.withColumn("p", F.lit(p).cast("double"))


def sibling_mean(df: DataFrame, unit: str, value: str) -> DataFrame:
    """df with sibling_mean: the mean of value over the unit's other rows (null for single rows)."""
    w = Window.partitionBy(unit)
    return df.withColumn("sibling_mean", F.try_divide(F.sum(value).over(w) - F.col(value), F.count("*").over(w) - 1))


def midranks(df: DataFrame, value: str, name: str = "rank", descending: bool = False, by: str | None = None) -> DataFrame:
    """df with ranks from 1 of a number (in each group of by), ties sharing their mean rank. Equal values are counted first, so only
    distinct values are put in order, by ranges."""
    own = [by] if by else []
    counts = df.groupBy(*own, value).agg(F.count("*").alias("__k"))
    ranks = running(counts, [*map(F.col, own), -F.col(value) if descending else F.col(value)], "__k", name)
    ranks = ranks.withColumn(name, F.col(name) - (F.col("__k") - 1) / 2)
    if by:
        sizes = counts.groupBy(by).agg(F.sum("__k").alias("__t"))
        before = sizes.select(by, (F.sum("__t").over(Window.orderBy(by)) - F.col("__t")).alias("__b"))  # a row a group
        ranks = ranks.join(before, by).withColumn(name, F.col(name) - F.col("__b")).drop("__b")
    return df.join(ranks.drop("__k"), [*own, value])


def mann_whitney(df: DataFrame, value: str, flag: str) -> DataFrame:
    """u, n1, n2, z, p: two-sided, normal approximation with tie and continuity corrections."""
    ranked = midranks(df.select(value, flag), value)
    one = F.col(flag)
    s = ranked.agg(F.sum(F.when(one, F.col("rank"))).alias("r1"), F.sum(one.cast("long")).alias("n1"), F.sum((~one).cast("long")).alias("n2"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = s.crossJoin(ties).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    larger = F.greatest("u", F.col("n1") * F.col("n2") - F.col("u"))
    s = s.withColumn("z", (larger - F.col("n1") * F.col("n2") / 2 - 0.5) / sd).select("u", "n1", "n2", "z")
    z = s.first().z
    return s.withColumn("p", F.lit(None if z is None else min(1.0, 2 * normal_sf(z))).cast("double"))
