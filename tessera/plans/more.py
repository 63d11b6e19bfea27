"""More named queries: resampled vectors, calibration, subsets, worklists, metadata and checks of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot, snap, unit
from ..operators import agreement, index, knn, pooling, rank, resample, textq
from ..operators.ordered import ranked
from ..sources.tables import table
from .catalog import _A, _B, _DIS, _END_SQL, _NA_SQL, _TEXTS, _UNITS_SQL, _disagreement, _graph_sql, _nominal_sql, _semantic_sql, _texts, _triples, _views, query, rounded, weights_sql


@query(f"""
WITH x AS (SELECT vec_id // 3 AS u, vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT *, count(*) OVER (PARTITION BY u) AS m FROM x) WHERE m >= 2),
un AS (SELECT u, any_value(m) AS m FROM p GROUP BY u), wu AS (SELECT * FROM {weights_sql("un", 300, 0)} WHERE w > 0),
d AS (SELECT a.u AS ua, b.u AS ub, sum(power(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 2)) AS d FROM p a JOIN p b ON a.k <> b.k GROUP BY 1, 2),
o AS (SELECT b, sum(w * d / (m - 1)) AS apart, sum(w * m)::DOUBLE AS n FROM wu JOIN d ON ua = u AND ub = u GROUP BY b),
e AS (SELECT x.b, sum(x.w * y.w * d) AS total FROM wu x JOIN wu y ON x.b = y.b JOIN d ON ua = x.u AND ub = y.u GROUP BY x.b),
a AS (SELECT 1 - (apart / n) / (total / (n * (n - 1))) AS alpha FROM o JOIN e USING (b))
SELECT round(quantile_cont(alpha, 0.025), 8) AS low, round(quantile_cont(alpha, 0.975), 8) AS high, count(*) AS reps FROM a""")
def bootstrap_ci_semantic(spark, d):
    return rounded(resample.bootstrap_semantic(_triples(spark, d), "u", "embedding", 300))


@query(f"""
WITH x AS (SELECT vec_id // 3 AS u, vec_id // 3 % 4 AS g, vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT *, count(*) OVER (PARTITION BY u) AS m FROM x) WHERE m >= 2),
un AS (SELECT g, u, any_value(m) AS m FROM p GROUP BY g, u), wu AS (SELECT * FROM {weights_sql("un", 300, 0, "g || '|' || u")} WHERE w > 0),
d AS (SELECT a.g, a.u AS ua, b.u AS ub, sum(power(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 2)) AS d FROM p a JOIN p b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
o AS (SELECT wu.g, b, sum(w * d / (m - 1)) AS apart, sum(w * m)::DOUBLE AS n FROM wu JOIN d ON ua = u AND ub = u GROUP BY wu.g, b),
e AS (SELECT x.g, x.b, sum(x.w * y.w * d) AS total FROM wu x JOIN wu y ON x.g = y.g AND x.b = y.b JOIN d ON ua = x.u AND ub = y.u GROUP BY x.g, x.b),
a AS (SELECT g, 1 - (apart / n) / (total / (n * (n - 1))) AS alpha FROM o JOIN e USING (g, b)),
ci AS (SELECT g, quantile_cont(alpha, 0.025) AS low, quantile_cont(alpha, 0.975) AS high FROM a GROUP BY g),
pt AS (SELECT un.g, count(*) AS n_units, sum(m)::DOUBLE AS n, sum(d / (m - 1)) AS apart FROM un JOIN d ON ua = u AND ub = u GROUP BY un.g),
al AS (SELECT g, sum(d) AS total FROM d GROUP BY g)
SELECT g AS lab, round(1 - (apart / n) / (total / (n * (n - 1))), 8) AS alpha, n_units, round(low, 8) AS low, round(high, 8) AS high FROM pt JOIN al USING (g) JOIN ci USING (g) WHERE n_units >= 30""")
def alpha_semantic_by_lab(spark, d):
    rows = _triples(spark, d).withColumn("lab", F.col("u") % 4)
    points = agreement.alpha_semantic(rows, "u", "embedding", ["lab"]).where("n_units >= 30").select("lab", "alpha", "n_units")
    return rounded(points.join(resample.bootstrap_semantic(rows, "u", "embedding", 300, by=["lab"]).drop("reps"), "lab"))


def _excluded_sql(name: str, where: str) -> str:
    out = _semantic_sql("vec_id // 3").replace("FROM embeddings)", f"FROM embeddings WHERE {where})", 1)
    return f"SELECT '{name}' AS class, * FROM ({out.replace('round(1 - observed / expected, 8)', '1 - observed / expected')})"


@query(f"""WITH c AS ({" UNION ALL ".join(_excluded_sql(n, w) for n, w in (("all", "true"), ("seventh", "vec_id % 7 <> 0"), ("few_labels", "label > 6")))}),
a AS (SELECT alpha AS a, n_units AS n FROM c WHERE class = 'all')
SELECT class, round(alpha, 8) AS alpha, round(alpha - a, 8) + 0.0 AS delta, n_units, n - n_units AS units_lost, 2 * (n - n_units) > n AS half_lost FROM c, a""")
def alpha_semantic_excluding(spark, d):
    return rounded(agreement.alpha_excluding(_triples(spark, d), "u", "embedding", {"seventh": F.col("vec_id") % 7 == 0, "few_labels": F.col("label") <= 6}))


@query(_nominal_sql("(SELECT *, l_orderkey % 7 AS lab FROM lineitem)", "l_orderkey", "l_returnflag", "lab").replace("FROM r", "FROM r WHERE n_units >= 30 ORDER BY alpha DESC, lab LIMIT 3"))
def labs_by_alpha(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lab", F.col("l_orderkey") % 7)
    out = rounded(agreement.alpha_nominal(rows, "l_orderkey", "l_returnflag", ["lab"]))
    return out.where("n_units >= 30").orderBy(F.desc("alpha"), "lab").limit(3)


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1)
SELECT count(*) AS units, count(*) FILTER (n >= 2) AS pairable, count(*) FILTER (k = 1 AND n >= 2) AS unanimous, sum(n)::BIGINT AS rows, round(avg(k / n::DOUBLE), 8) AS distinct_share FROM t""")
def unit_coverage(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("k"))
    return rounded(t.agg(F.count("*").alias("units"), F.count_if(F.col("n") >= 2).alias("pairable"), F.count_if((F.col("k") == 1) & (F.col("n") >= 2)).alias("unanimous"), F.sum("n").alias("rows"), F.avg(F.col("k") / F.col("n")).alias("distinct_share")))


_UNTIED = "(SELECT l.* FROM lineitem l JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_quantity)) USING (l_orderkey))"


@query(_nominal_sql(_UNTIED, "l_orderkey", "l_returnflag"))
def alpha_without_tied_units(spark, d):
    rows = table(spark, d, "lineitem")
    free = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_quantity").alias("k")).where("n = k").select("l_orderkey")
    return rounded(agreement.alpha_nominal(rows.join(free, "l_orderkey", "left_semi"), "l_orderkey", "l_returnflag"))


@query(f"SELECT doc_id, t, length(t) AS chars, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words, {_END_SQL} AND NOT {_NA_SQL} AS open_end FROM {_TEXTS}")
def text_lengths(spark, d):
    t = F.col("t")
    return _texts(spark, d).select("doc_id", textq.normalise(t).alias("t"), F.length(t).cast("long").alias("chars"), textq.words(t).cast("long").alias("words"), (textq.no_terminal(t) & ~textq.non_answer(t)).alias("open_end"))


@query("""SELECT l_shipdate_month AS month, n, k FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipdate_month, count(*) AS n, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1) WHERE n >= 200""")
def months_with_rows(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("k")).where("n >= 200")


@query(_UNITS_SQL + """ SELECT e.vec_id, e.label, round(d.d, 8) AS disagreement FROM embeddings e LEFT JOIN d ON d.unit = e.vec_id // 3 AND e.vec_id % 2 = 0""")
def index_metadata(spark, d):
    rows = _triples(spark, d)
    scores = agreement.per_unit_disagreement(rows, "u", "embedding").select(F.col("unit").alias("u"), "disagreement")
    return rounded(rows.withColumn("u", F.when(F.col("vec_id") % 2 == 0, F.col("u"))).join(scores, "u", "left").select("vec_id", "label", "disagreement"))


@query(_UNITS_SQL + ", " + _graph_sql("embedding", 10, "g", "a.id % 100 = 0") + """
SELECT g.id, g.rank::INT AS rank, g.nbr, round(g.sim, 8) AS sim, g.nbr // 3 AS unit, g.nlabel AS label, round(d.d, 8) AS disagreement FROM g LEFT JOIN d ON d.unit = g.nbr // 3""")
def frame_search(spark, d):
    rows = _triples(spark, d)
    found = index.exact_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return rounded(index.described(found, rows, "vec_id", "u", "embedding", ["label"]))


@query(f"""SELECT round(min(c), 8) AS least, round(avg(c), 8) AS mean, count(*) FILTER (c < 0.9999) AS below FROM (SELECT list_dot_product({_A}::DOUBLE[], {_B}::DOUBLE[]) /
 sqrt(list_dot_product({_A}::DOUBLE[], {_A}::DOUBLE[]) * list_dot_product({_B}::DOUBLE[], {_B}::DOUBLE[])) AS c FROM embeddings)""")
def view_agreement_check(spark, d):
    c = _views(spark, d).select(dot(unit("a"), unit("b")).alias("c"))
    return rounded(c.agg(F.min("c").alias("least"), F.avg("c").alias("mean"), F.count_if(F.col("c") < 0.9999).alias("below")))


@query(f"""WITH u AS (SELECT vec_id, {_A}::DOUBLE[] AS a, {_B}::DOUBLE[] AS b, sqrt(list_dot_product({_A}::DOUBLE[], {_A}::DOUBLE[])) AS na, sqrt(list_dot_product({_B}::DOUBLE[], {_B}::DOUBLE[])) AS nb FROM embeddings)
SELECT vec_id, (i - 1)::INT AS dim, round((CASE WHEN i <= 32 THEN a[i] / na ELSE b[i - 32] / nb END) / sqrt(2), 8) + 0.0 AS value FROM u, range(1, 65) r(i)""")
def concatenated_views(spark, d):
    rows = _views(spark, d)
    return rounded(pooling.concat_views(rows, "a", "b").select("vec_id", F.posexplode("x").alias("dim", "value")))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), n AS (SELECT count(*) AS n, count(*) FILTER (id % 9 = 0) AS p FROM q),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, md5('0|' || id), id) AS r FROM q),
f AS (SELECT f, greatest(1, floor(f * n)::BIGINT) AS k, n, p FROM n, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) t(f))
SELECT f AS fraction, round(count(*) FILTER (r <= k AND id % 9 = 0) / any_value(k)::DOUBLE, 8) AS precision, round(count(*) FILTER (r <= k AND id % 9 = 0) / any_value(p)::DOUBLE, 8) AS recall,
 round(count(*) FILTER (r <= k AND id % 9 = 0) / any_value(k)::DOUBLE / (any_value(p) / any_value(n)::DOUBLE), 8) AS lift FROM r, f GROUP BY f""")
def detection_lift(spark, d):
    s = _disagreement(spark, d)
    return rounded(rank.lift(s, s.where("id % 9 = 0")))


@query("WITH " + _graph_sql("embedding", 10, "g") + """
SELECT id, (count(*) FILTER (label = nlabel))::BIGINT AS agree, bool_and(label <> nlabel) AS foreign_label FROM g GROUP BY id""")
def label_unlike_neighbours(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"))
    g = knn.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 10).join(rows, "id").join(rows.select(F.col("id").alias("nbr"), F.col("label").alias("nl")), "nbr")
    same = F.col("label") == F.col("nl")
    return g.groupBy("id").agg(F.count_if(same).alias("agree"), F.bool_and(~same).alias("foreign_label"))


_CALIBRATION = """
WITH r AS (SELECT s, seed FROM (VALUES (85), (169)) a(s), range(10) b(seed)), x AS (SELECT vec_id AS k, label AS l FROM embeddings),
c0 AS (SELECT s, seed, k, l, row_number() OVER (PARTITION BY s, seed ORDER BY md5(seed || '|' || k), k) - 1 AS h FROM r, x),
c AS (SELECT s, seed, k, l, row_number() OVER (PARTITION BY s, seed ORDER BY l, k) - 1 AS r FROM c0 WHERE h < s),
t1 AS (SELECT s, seed, max(n) AS t FROM (SELECT s, seed, l, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL),
g AS (SELECT c.s, c.seed, (r + t1.t) % c.s AS r, l AS nl FROM c JOIN t1 USING (s, seed)),
moved AS (SELECT c.s, c.seed, k, nl FROM c JOIN g USING (s, seed, r)),"""


@query(_CALIBRATION + _graph_sql(_A, 10, "ga") + ", " + _graph_sql(_B, 10, "gb") + """,
w AS (SELECT r.s, r.seed, x.k, coalesce(m.nl, x.l) AS l, m.k IS NOT NULL AS swapped FROM r CROSS JOIN x LEFT JOIN moved m ON m.s = r.s AND m.seed = r.seed AND m.k = x.k),
nn AS (SELECT 'a' AS arm, id, nbr FROM ga UNION ALL SELECT 'b', id, nbr FROM gb),
sc AS (SELECT arm, a.s, a.seed, a.k, any_value(a.swapped)::INT AS y, avg((a.l <> b.l)::INT) AS score FROM w a JOIN nn ON nn.id = a.k JOIN w b ON b.s = a.s AND b.seed = a.seed AND b.k = nn.nbr GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY arm, s, seed ORDER BY score) + (count(*) OVER (PARTITION BY arm, s, seed, score) - 1) / 2.0 AS mid FROM sc),
en AS (SELECT 'ensemble' AS arm, s, seed, k, any_value(y) AS y, avg(mid) AS score FROM rk GROUP BY s, seed, k),
al AS (SELECT * FROM rk UNION ALL SELECT *, rank() OVER (PARTITION BY s, seed ORDER BY score) + (count(*) OVER (PARTITION BY s, seed, score) - 1) / 2.0 FROM en),
auc AS (SELECT arm, s, seed, (sum(y * mid) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM al GROUP BY ALL)
SELECT arm, s::INT AS n_swap, round(avg(auc), 8) AS auc, round(stddev_samp(auc), 8) AS sd, count(*) AS seeds FROM auc GROUP BY arm, s""")
def label_swap_calibration(spark, d):
    v = _views(spark, d)
    graphs = {"a": knn.neighbours(v, "vec_id", "a", 10), "b": knn.neighbours(v, "vec_id", "b", 10)}
    return rounded(rank.swap_calibration(v, graphs, "vec_id", "label", [85, 169], 10))


@query(f"""WITH v AS (SELECT vec_id, {_A}[1]::DOUBLE AS x FROM embeddings), r AS (SELECT vec_id, rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS midrank, row_number() OVER (ORDER BY x, vec_id) AS ordinal FROM v)
SELECT vec_id, midrank::DOUBLE AS midrank, ordinal::INT AS ordinal FROM r""")
def ranks_of_scores(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    mid = textq.midranks(v, "x", "midrank", descending=True)
    return ranked(mid, [F.col("x"), F.col("vec_id")], "ordinal").select("vec_id", "midrank", F.col("ordinal").cast("int").alias("ordinal"))


@query("""WITH s AS (SELECT vec_id FROM embeddings ORDER BY md5('0|' || vec_id), vec_id LIMIT 100), t AS (SELECT vec_id FROM embeddings ORDER BY md5('1|' || vec_id), vec_id LIMIT 100)
SELECT 'both' AS part, vec_id FROM s INTERSECT SELECT 'both', vec_id FROM t UNION ALL (SELECT 'first', vec_id FROM s EXCEPT SELECT 'first', vec_id FROM t) UNION ALL (SELECT 'either', vec_id FROM s UNION SELECT 'either', vec_id FROM t)""")
def sets_of_samples(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id")
    s, t = resample.sample(rows, "vec_id", 100, 0), resample.sample(rows, "vec_id", 100, 1)
    named = lambda df, n: df.select(F.lit(n).alias("part"), "vec_id")
    return named(s.intersect(t), "both").union(named(s.exceptAll(t), "first")).union(named(s.union(t).distinct(), "either"))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), t AS (SELECT id, row_number() OVER (ORDER BY score DESC, md5('0|' || id), id) AS r FROM q)
SELECT label, count(*) AS n FROM t JOIN embeddings e ON e.vec_id = t.id WHERE r <= 50 GROUP BY label""")
def suspects_by_label(spark, d):
    first = rank.top(_disagreement(spark, d), 50)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.join(F.broadcast(first), "id").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""SELECT vec_id, round_even(list_dot_product({_A}::DOUBLE[], {_B}::DOUBLE[]), 9) + 0.0 AS snapped FROM embeddings""")
def snapped_scores(spark, d):
    return _views(spark, d).select("vec_id", (F.bround(snap(dot("a", "b")), 9) + F.lit(0.0)).alias("snapped"))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), o AS (SELECT id, round_even(score * ((id * 7) % 13), 12) AS score FROM q),
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, md5('0|' || id), id) AS r FROM q), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, md5('1|' || id), id) AS r FROM o)
SELECT count(*) FILTER (b.r <= 200) / 50.0::DOUBLE AS in_wide, quantile_cont(b.r, 0.5)::DOUBLE AS median_rank FROM a JOIN b USING (id) WHERE a.r <= 50""")
def cross_encoder_rank(spark, d):
    s = _disagreement(spark, d)
    other = s.select("id", F.bround(F.col("score") * ((F.col("id") * 7) % 13), 12).alias("score"))
    both = rank.top(s, 50, 0).select("id").join(rank.places(other, 1).select("id", "rank"), "id")
    return both.agg((F.count_if(F.col("rank") <= 200) / 50).alias("in_wide"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), o AS (SELECT id, round_even(score * ((id * 7) % 13), 12) AS score FROM q)
SELECT id, round(least(q.score, o.score), 8) AS score FROM q JOIN o USING (id) WHERE q.score > 0 AND o.score > 0""")
def consensus_suspects(spark, d):
    s = _disagreement(spark, d)
    other = s.select("id", F.bround(F.col("score") * ((F.col("id") * 7) % 13), 12).alias("other"))
    return rounded(s.join(other, "id").where("score > 0 and other > 0").select("id", F.least("score", "other").alias("score")))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), t AS (SELECT id FROM q ORDER BY score DESC, md5('0|' || id), id LIMIT 200)
SELECT id FROM q WHERE id NOT IN (SELECT id FROM t) ORDER BY md5('9|' || id), id LIMIT 10""")
def suspect_controls(spark, d):
    s = _disagreement(spark, d)
    return resample.sample(s.join(rank.top(s, 200).select("id"), "id", "left_anti").select("id"), "id", 10, 9)


_PURITY_KS = (1, 5, 10, 25)


@query("WITH " + _graph_sql("embedding", 25, "g") + f""", p AS (SELECT id, {", ".join(f"avg((label = nlabel)::INT) FILTER (rank <= {k}) AS p{k}" for k in _PURITY_KS)} FROM g GROUP BY id),
m AS (SELECT b, {", ".join(f"sum(w * p{k}) / sum(w) AS p{k}" for k in _PURITY_KS)} FROM {weights_sql("p", 1000, 3, "id")} GROUP BY b)
""" + " UNION ALL ".join(f"SELECT {k} AS k, round(quantile_cont(p{k}, 0.025), 8) AS low, round(quantile_cont(p{k}, 0.975), 8) AS high FROM m" for k in _PURITY_KS))
def purity_bootstrap(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    g = knn.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 25).join(rows, "id").join(rows.select(F.col("id").alias("nbr"), F.col("label").alias("nl")), "nbr")
    same = (F.col("label") == F.col("nl")).cast("double")
    each = g.groupBy("id").agg(*[F.avg(F.when(F.col("rank") <= k, same)).alias(str(k)) for k in _PURITY_KS])
    return rounded(resample.bootstrap_mean(each, "id", [str(k) for k in _PURITY_KS], 1000, 3).withColumn("k", F.col("value").cast("int")).drop("value"))


@query("""SELECT vec_id, split_part('lab' || (vec_id % 5) || '+' || label || '+2024-0' || (vec_id % 9 + 1) || '-11', '+', 1) AS lab, '2024-0' || (vec_id % 9 + 1) AS month, 'cam_' || label AS slug FROM embeddings""")
def id_parts(spark, d):
    name = F.concat(F.lit("lab"), F.col("vec_id") % 5, F.lit("+"), F.col("label"), F.lit("+2024-0"), F.col("vec_id") % 9 + 1, F.lit("-11"))
    rows = table(spark, d, "embeddings").withColumn("k", F.split(name, r"\+"))
    camera = F.concat(F.lit("observation.images.cam_"), F.col("label"))
    return rows.select("vec_id", F.col("k")[0].alias("lab"), F.substring(F.col("k")[2], 1, 7).alias("month"), F.substring_index(camera, ".", -1).alias("slug"))


@query(f"""WITH x AS (SELECT vec_id AS k, label AS l, CASE WHEN label IN (2, 5) THEN (label + 1) % 10 ELSE label END AS w FROM embeddings), {_graph_sql("embedding", 10, "g")},
s AS (SELECT g.id, avg((a.w <> b.w)::INT) AS score, any_value((a.w <> a.l)::INT) AS y FROM g JOIN x a ON a.k = g.id JOIN x b ON b.k = g.nbr GROUP BY g.id),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s)
SELECT round((sum(y * mid) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auc, sum(y)::BIGINT AS positives FROM r""")
def whole_task_corruption(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    now = rows.withColumn("w", F.when(F.col("label").isin(2, 5), (F.col("label") + 1) % 10).otherwise(F.col("label")))
    g = knn.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    pairs = g.join(now, "id").join(now.select(F.col("id").alias("nbr"), F.col("w").alias("wn")), "nbr")
    scores = pairs.groupBy("id").agg(F.avg((F.col("w") != F.col("wn")).cast("double")).alias("score"))
    return rounded(rank.detection(scores, now.where("w <> label"), ks=()))
