"""TF-IDF vectors as sparse rows: counts of words of two characters or more, smoothed idf, unit length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agreement import PAIR_ROWS, alpha

#: So many of the commonest words are broadcast where all words count.
COMMON = 5000
#: The queries' words are broadcast if there are at most so many.
ASKED = 50_000


def word_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def char_grams(text, least: int = 3, most: int = 5) -> Column:
    """Runs of least to most characters of the text in lower case, spaces made single."""
    c = F.filter(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), ""), lambda x: x != "")
    return _once(c, lambda c: F.flatten(F.array(*[_runs(c, n, "") for n in range(least, most + 1)])))


def _once(value: Column, f) -> Column:
    """f(value), with value computed once a row and not in each place where f's own functions use it."""
    return F.transform(F.array(value), f)[0]


def _runs(parts: Column, n: int, between: str) -> Column:
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))), lambda i: i <= F.size(parts) - n + 1)
    return F.transform(at, lambda i: F.array_join(F.slice(parts, i, n), between))


def word_grams(text, most: int = 2) -> Column:
    """Words of two characters or more and runs of up to `most` of them, joined by spaces."""
    return _once(word_tokens(text), lambda w: F.flatten(F.array(*[_runs(w, n, " ") for n in range(1, most + 1)])))


def tfidf(df: DataFrame, key: str, text: str, max_features: int = 5000, tokens=word_tokens) -> DataFrame:
    """key, token, w. idf = ln((1 + n) / (1 + df)) + 1; the commonest max_features tokens, if there are more
    (ties: by token); rows without tokens are left out. tokens: a function
    from a text column to its tokens (words, char_grams, word_grams)."""
    n = df.count()
    # the filter is in both branches below, so that Spark shuffles the tokens once and reuses them
    each = df.select(F.col(key).alias("k"), F.explode(tokens(F.col(text))).alias("token")).where("token is not null")
    tf = each.groupBy("k", "token").agg(F.count("*").cast("double").alias("tf"))
    kept = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "token").limit(max_features)
    w = tf.join(F.broadcast(kept), "token").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy("k")))
    return w.withColumn("norm", norm).select(F.col("k").alias(key), "token", (F.col("w") / F.col("norm")).alias("w"))


def alpha_sparse(weights: DataFrame, rows: DataFrame, key: str, unit_col: str) -> DataFrame:
    """alpha, n_units, n_pairable of semantic agreement from sparse unit vectors.

    Squared distances over all pairs are n^2 - 2 |sum x|^2 + |X'X|^2, so no pair of rows is made: a task adds the
    outer products of its rows' few tokens to one matrix of kept tokens (tfidf's max_features, 200 MB at 5000).
    Units of over PAIR_ROWS rows are summed the same way, smaller ones multiply their rows with each other.
    """
    ids = weights.select("token").distinct().withColumn("i", F.row_number().over(Window.orderBy("token")) - 1)  # max_features rows at most
    d = ids.count()
    u = rows.select(F.col(key).alias("k"), F.col(unit_col).alias("u")).join(weights.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    u = u.withColumn("m", F.count("*").over(Window.partitionBy("u"))).where("m >= 2")
    held = weights.select(F.col(key).alias("k"), "token", "w").join(F.broadcast(ids), "token").groupBy("k").agg(F.collect_list(F.struct("i", "w")).alias("s"))
    docs = held.join(u, "k").select("u", "m", F.col("s.i").alias("i"), F.col("s.w").alias("w"))
    plain = f"u {docs.schema['u'].dataType.simpleString()}"

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(g), d))
        for r, (i, w) in enumerate(zip(g.i, g.w)):
            x[r, i] = w
        return pd.DataFrame({"u": g.u[:1], "m": len(g), "total": float(((1 - x @ x.T) ** 2).sum())})

    def written(unit, gram):
        for at in range(0, d + 1, 128):
            part = [(at + i, row) for i, row in enumerate(gram[at : at + 128]) if row.any()]
            if part:
                yield pd.DataFrame({"u": [unit] * len(part), "i": [i for i, _ in part], "row": [r for _, r in part]})

    def partial(batches):
        unit = gram = None
        for b in batches:
            for v, i, w in zip(b.u, b.i, b.w):
                if gram is None or v != unit:
                    if gram is not None:
                        yield from written(unit, gram)
                    unit, gram = v, np.zeros((d + 1, d))
                gram[np.ix_(i, i)] += np.outer(w, w)
                gram[d, i] += w
        if gram is not None:
            yield from written(unit, gram)

    def add(g: pd.DataFrame) -> pd.DataFrame:
        square, own = float((g.row.sum() ** 2).sum()), g.i.iloc[0] < d
        return pd.DataFrame({"u": g.u[:1], "part": square if own else -2 * square})

    def summed(some: DataFrame, unit: str) -> DataFrame:
        grams = some.sortWithinPartitions("u").mapInPandas(partial, f"{unit}, i int, row array<double>")
        return grams.groupBy("u", "i").applyInPandas(add, f"{unit}, part double").groupBy("u").agg(F.sum("part").alias("part"))

    large = summed(docs.where(F.col("m") > PAIR_ROWS), plain).join(u.select("u", "m").distinct(), "u").select("u", "m", (F.col("m") * F.col("m") + F.col("part")).alias("total"))
    units = docs.where(F.col("m") <= PAIR_ROWS).groupBy("u").applyInPandas(pairs, f"{plain}, m long, total double").union(large)
    near = units.agg(F.sum(F.col("total") / (F.col("m") - 1)).alias("apart"), F.count("*").alias("n_units"), F.sum("m").alias("n"))
    pool = summed(docs.withColumn("u", F.lit(0)), "u int").select("part")
    n = F.col("n").cast("double")
    out = near.crossJoin(pool).select(alpha(F.col("apart") / n, (n * n + F.col("part")) / (n * (n - 1))).alias("alpha"), "n_units", F.col("n").alias("n_pairable"))
    return out


def search(df: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, rank, key, score: the k rows of largest TF-IDF cosine for each query (query, t), ties to the least key.

    Rows without a word of the query take no part. All words of the rows count.
    Inverse frequencies come from the rows alone. The join is on the word, and scores are summed before ranks are
    made; Spark splits common words as skewed partitions. For lengths, the commonest words' frequencies are
    broadcast and only the others, each of few rows, are joined by a shuffle.
    """
    n = df.count()
    # the filter is in every branch below, so that Spark shuffles the words once and reuses them
    each = df.select(F.col(key).alias("k"), F.explode(word_tokens(F.col(text))).alias("token")).where("token is not null")
    tf = each.groupBy("k", "token").agg(F.count("*").cast("double").alias("tf"))
    every = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    weight = (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")
    common = every.orderBy(F.desc("total"), "token").limit(COMMON).select("token", weight)
    idf = every.select("token", weight)
    asked = queries.select("query", F.explode(word_tokens(F.col("t"))).alias("token")).where("token is not null").groupBy("query", "token").agg(F.count("*").cast("double").alias("tf"))
    few = F.broadcast if asked.limit(ASKED + 1).count() <= ASKED else lambda x: x
    q = idf.join(few(asked), "token").select("query", "token", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = q.groupBy("query").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("long"))
    x = F.col("tf") * F.col("idf")
    w = tf.join(F.broadcast(common), "token").select("k", x.alias("x"))
    w = w.union(tf.join(F.broadcast(common.select("token")), "token", "left_anti").join(idf, "token").select("k", x.alias("x")))
    norms = w.groupBy("k").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    hits = tf.join(few(q), "token").groupBy("query", "k").agg(F.sum(x * F.col("w")).alias("s"))
    # a union and a window in place of a join on the key, which would filter one branch by it
    both = norms.select(F.lit(None).cast(q.schema["query"].dataType).alias("query"), "k", "norm", F.lit(None).cast("double").alias("s"))
    both = both.union(hits.select("query", "k", F.lit(None).cast("double"), "s")).withColumn("norm", F.max("norm").over(Window.partitionBy("k")))
    scored = both.where("s is not null").join(few(lengths), "query").select("query", F.col("k").alias(key), F.bround(F.col("s") / (F.col("norm") * F.col("long")), 12).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", key, "score")
