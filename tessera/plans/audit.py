"""Queries of a whole audit: intervals by lab, where faults gather, text search, planted faults, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, grams, knn, pooling, rank, resample, textq, tfidf
from ..sources import report, synthetic
from ..sources.tables import table
from .catalog import _DIS, _NEAREST_LABEL, _SUBSET, _TEXTS, _TRUNC_SQL, ORACLES, _disagreement, _graph_sql, _nominal_sql, _texts, chi2_p_sql, query, rounded, weights_sql

# --- labs under resampling -----------------------------------------------------------------------------------

_LABS = f"""
WITH c AS (SELECT l_orderkey % 7 AS g, l_orderkey AS u, l_returnflag AS l, count(*) AS c FROM lineitem GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY g, u) AS m FROM c) WHERE m >= 2),
un AS (SELECT g, u, max(m) AS m, sum(c * (c - 1)) AS same FROM p GROUP BY g, u), dr AS (SELECT * FROM {weights_sql("un", 300, 0, "g || '|' || u")} WHERE w > 0),
o AS (SELECT g, b, sum(w * m)::DOUBLE AS n, sum(w * (m * (m - 1) - same) / (m - 1)::DOUBLE) AS apart FROM dr GROUP BY g, b),
e AS (SELECT g, b, sum(t * (t - 1))::DOUBLE AS same FROM (SELECT g, b, l, sum(w * c) AS t FROM dr JOIN p USING (g, u) GROUP BY g, b, l) GROUP BY g, b),
a AS (SELECT g AS lab, b, round(1 - (apart / n) / ((n * (n - 1) - same) / (n * (n - 1))), 10) AS alpha FROM o JOIN e USING (g, b)),
ci AS (SELECT lab, quantile_cont(alpha, 0.025) AS low, quantile_cont(alpha, 0.975) AS high, count(*) AS reps FROM a GROUP BY lab)"""


def _by_lab(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lab", F.col("l_orderkey") % 7)
    each = resample.bootstrap_nominal_by(rows, "l_orderkey", "l_returnflag", "lab", 300).withColumn("alpha", F.round("alpha", 10))
    at = lambda q: F.percentile("alpha", F.lit(q))
    return rows, each, each.groupBy("lab").agg(at(0.025).alias("low"), at(0.975).alias("high"), F.count("*").alias("reps"))


@query(_LABS + " SELECT lab, round(low, 8) AS low, round(high, 8) AS high, reps FROM ci")
def alpha_by_lab_interval(spark, d):
    return rounded(_by_lab(spark, d)[2])


@query(_LABS + """, x AS (SELECT b, arg_min(lab, (alpha, lab)) AS least, arg_min(lab, (-alpha, lab)) AS most FROM a GROUP BY b)
SELECT lab, round(avg((lab = least)::INT), 8) AS p_least, round(avg((lab = most)::INT), 8) AS p_most FROM (SELECT DISTINCT lab FROM a), x GROUP BY lab""")
def lab_extremes(spark, d):
    each = _by_lab(spark, d)[1]
    ends = each.groupBy("b").agg(F.min_by("lab", F.struct("alpha", "lab")).alias("least"), F.min_by("lab", F.struct(-F.col("alpha"), "lab")).alias("most"))
    marked = each.join(ends, "b").groupBy("lab")
    return rounded(marked.agg(F.avg((F.col("lab") == F.col("least")).cast("double")).alias("p_least"), F.avg((F.col("lab") == F.col("most")).cast("double")).alias("p_most")))


_POINTS = _nominal_sql("(SELECT *, l_orderkey % 7 AS lab FROM lineitem)", "l_orderkey", "l_returnflag", "lab")


@query(_LABS + f""", pt AS (SELECT * FROM ({_POINTS}) JOIN ci USING (lab) WHERE n_units >= 30),
b AS (SELECT arg_min(lab, (alpha, lab)) AS least, max(high) FILTER (lab = (SELECT arg_min(lab, (alpha, lab)) FROM pt)) AS top, arg_min(lab, (-alpha, lab)) AS most, max(low) FILTER (lab = (SELECT arg_min(lab, (-alpha, lab)) FROM pt)) AS bottom FROM pt)
SELECT least, most, top >= bottom AS overlap FROM b""")
def extreme_labs(spark, d):
    rows, _, ci = _by_lab(spark, d)
    points = rounded(agreement.alpha_nominal(rows, "l_orderkey", "l_returnflag", ["lab"])).where("n_units >= 30").join(ci, "lab")
    held = F.struct("lab", "low", "high")
    ends = points.agg(F.min_by(held, F.struct("alpha", "lab")).alias("a"), F.min_by(held, F.struct(-F.col("alpha"), "lab")).alias("b"))
    return ends.select(F.col("a.lab").alias("least"), F.col("b.lab").alias("most"), (F.col("a.high") >= F.col("b.low")).alias("overlap"))


# --- where faults gather -------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT year(o_orderdate) AS g, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1 HAVING count(*) >= 200),
t AS (SELECT *, (sum(n) OVER ())::DOUBLE AS nn, (sum(k) OVER ())::DOUBLE AS kk FROM c), o AS (SELECT k AS o, n * kk / nn AS e FROM t UNION ALL SELECT n - k, n * (nn - kk) / nn FROM t),
r AS (SELECT sum(power(o - e, 2) / e) AS x, (count(*) // 2 - 1)::BIGINT AS k, count(*) FILTER (e < 5) AS expected_under_5 FROM o)
SELECT round(x, 8) AS statistic, k AS dof, expected_under_5, round(""" + chi2_p_sql("x", "k") + ", 8) AS p FROM r")
def chi2_period(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("period"), (F.col("o_orderstatus") == "F").alias("flag"))
    large = rows.groupBy("period").count().where("count >= 200").select("period")
    return rounded(textq.contingency(rows.join(large, "period", "left_semi"), "period", "flag"))


@query(_TRUNC_SQL + " SELECT count(*) AS n, count(DISTINCT length(t)) AS lengths, round(count(DISTINCT length(t)) / count(*), 8) AS concentration FROM f WHERE truncated")
def truncated_lengths(spark, d):
    cut = textq.flag_truncated(_texts(spark, d), "t").where("truncated")
    out = cut.agg(F.count("*").alias("n"), F.countDistinct(F.length("t")).alias("lengths"))
    return rounded(out.withColumn("concentration", F.try_divide("lengths", "n")))


@query(_TRUNC_SQL + " SELECT source, count(*) AS n, count(*) FILTER (truncated) AS cut, round(count(*) FILTER (truncated) / count(*), 8) AS rate FROM f GROUP BY source")
def truncated_by_lab(spark, d):
    flagged = textq.flag_truncated(_texts(spark, d), "t")
    return rounded(flagged.groupBy("source").agg(F.count("*").alias("n"), F.count_if("truncated").alias("cut"), (F.count_if("truncated") / F.count("*")).alias("rate")))


@query("SELECT source AS file, count(*) AS episodes, sum(length(text))::BIGINT AS rows, bool_and(doc_id % 97 <> 0) AS intact FROM documents GROUP BY source")
def layout_check(spark, d):
    """Ranges as planned, but for one row too late in some episodes, which the check must find."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.length("text").cast("long").alias("n"))
    plan = pooling.file_plan(rows, "file", "doc_id", "n").withColumn("first", F.col("first") + (F.col("doc_id") % 97 == 0).cast("int"))
    return pooling.layout_check(plan, "file", "doc_id", "first", "last", "n")


# --- noise and detection ---------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, round(avg(changed::INT), 8) AS rate FROM ({ORACLES['noise_' + m]})" for m in ("shuffle", "swap", "paraphrase")))
def noise_realised_rates(spark, d):
    rows = table(spark, d, "embeddings")
    nearest = knn.nearest_labels(rows, "label", "embedding")
    done = [resample.inject_label_noise(rows.select("vec_id", "label"), "vec_id", "label", 0.3, m, nearest=nearest).select(F.lit(m).alias("mode"), "changed") for m in ("shuffle", "swap", "paraphrase")]
    return rounded(done[0].union(done[1]).union(done[2]).groupBy("mode").agg(F.avg(F.col("changed").cast("double")).alias("rate")))


@query(_SUBSET + ", " + _NEAREST_LABEL + ", " + _graph_sql("embedding", 10, "g") + """, z AS (SELECT s.k, s.l, CASE WHEN r0 < 85 THEN other ELSE s.l END AS w FROM s JOIN nl ON nl.label = s.l),
sc AS (SELECT g.id, avg((a.w <> b.w)::INT) AS score, any_value((a.w <> a.l)::INT) AS y FROM g JOIN z a ON a.k = g.id JOIN z b ON b.k = g.nbr GROUP BY g.id),
rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM sc)
SELECT round((sum(y * mid) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auc, sum(y)::BIGINT AS positives FROM rk""")
def nearest_task_swap(spark, d):
    rows = table(spark, d, "embeddings")
    ids = rows.select(F.col("vec_id").alias("id"), "label")
    drawn = resample.sample(ids, "id", 85, 0).select("id", F.lit(True).alias("drawn"))
    now = ids.join(F.broadcast(drawn), "id", "left").join(knn.nearest_labels(rows, "label", "embedding"), "label").select("id", "label", F.when(F.col("drawn"), F.col("other")).otherwise(F.col("label")).alias("w"))
    pairs = knn.neighbours(rows, "vec_id", "embedding", 10).join(now, "id").join(now.select(F.col("id").alias("nbr"), F.col("w").alias("wn")), "nbr")
    scores = pairs.groupBy("id").agg(F.avg((F.col("w") != F.col("wn")).cast("double")).alias("score"))
    return rounded(rank.detection(scores, now.where("w <> label"), ks=()))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), o AS (SELECT id, round_even(score * ((id * 7) % 13), 12) AS score FROM q),
j AS (SELECT q.score AS a, o.score AS b FROM q JOIN o USING (id) WHERE q.score > 0 OR o.score > 0),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j)
SELECT count(*) FILTER (a > 0) AS positive_a, count(*) FILTER (b > 0) AS positive_b, round(count(*) FILTER (a > 0 AND b > 0) / count(*), 8) AS jaccard, round(corr(ra, rb), 8) AS rho FROM r""")
def tail_agreement(spark, d):
    s = _disagreement(spark, d)
    return rounded(rank.agreement_of_tails(s, s.select("id", F.bround(F.col("score") * ((F.col("id") * 7) % 13), 12).alias("score"))))


def _normal_sql(*parts: str) -> str:
    u, v = (f"((('0x' || substr(md5({' || chr(124) || '.join(parts)} || '|{x}'), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)" for x in "uv")
    return f"(sqrt(-2 * ln({u})) * cos(2 * 3.141592653589793 * {v}))"


def _view_sql(name: str, own: str) -> str:
    return f"""{name} AS (SELECT episode, list({_normal_sql("'0|task'", own, "i")} + 0.3 * {_normal_sql(f"'0|{name}'", "episode", "i")} ORDER BY i) AS x FROM t, range(48) r(i) GROUP BY episode),
{name}_n AS (SELECT episode AS id, x, sqrt(list_dot_product(x, x)) AS n FROM {name})"""


@query(f"""
WITH e AS (SELECT range AS episode, ('0x' || substr(md5('0|pick|' || range), 1, 8))::BIGINT % 12 AS task,
 ('0x' || substr(md5('0|wrong|' || range), 1, 8))::BIGINT < 0.2 * 4294967296.0 AS wrong, ('0x' || substr(md5('0|to|' || range), 1, 8))::BIGINT AS other FROM range(600)),
t AS (SELECT episode, task, CASE WHEN wrong THEN (task + 1 + other % 11) % 12 ELSE task END AS label FROM e), {_view_sql("vision", "task")}, {_view_sql("language", "label")},
g AS (SELECT * FROM (SELECT a.id, b.id AS nbr, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.x, b.x) / (a.n * b.n) DESC, b.id) AS r FROM vision_n a JOIN vision_n b ON a.id <> b.id) WHERE r <= 10),
s AS (SELECT g.id, round_even(1 - avg(list_dot_product(p.x, q.x) / (p.n * q.n)), 12) AS score FROM g JOIN language_n p ON p.id = g.id JOIN language_n q ON q.id = g.nbr GROUP BY g.id),
k AS (SELECT s.id, (task <> label)::INT AS y, row_number() OVER (ORDER BY score DESC, md5('0|' || s.id), s.id) AS r FROM s JOIN t ON t.episode = s.id),
n AS (SELECT count(*) AS n, sum(y)::BIGINT AS p FROM k), f AS (SELECT f, greatest(1, floor(f * n))::BIGINT AS m FROM (VALUES (0.1::DOUBLE), (0.2), (0.3)) v(f), n)
SELECT f AS fraction, round(sum(y) FILTER (r <= m) / any_value(m), 8) AS precision, round(sum(y) FILTER (r <= m) / any_value(p), 8) AS recall,
 round(sum(y) FILTER (r <= m) / any_value(m) / (any_value(p) / any_value(n)), 8) AS lift FROM k, n, f GROUP BY f""")
def demo_corpus_audit(spark, d):
    """Planted wrong labels of the synthetic corpus, found by disagreement of its two views."""
    rows = synthetic.corpus(spark)
    found = knn.disagreement(knn.neighbours(rows, "episode", "vision", 10), rows, "episode", "language", snapped=True)
    return rounded(rank.lift(found, rows.where("task <> label").select(F.col("episode").alias("id"))))


# --- text vectors and reports --------------------------------------------------------------------------------


def _grams_sql(tokens: str) -> str:
    return f"""
WITH x AS (SELECT doc_id AS k, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT count(*) AS n FROM x),
tk AS ({tokens}), tf AS (SELECT k, tok, count(*)::DOUBLE AS tf FROM tk GROUP BY ALL),
df AS (SELECT tok, count(*) AS df, sum(tf) AS total FROM tf GROUP BY tok ORDER BY total DESC, tok LIMIT 5000),
w AS (SELECT k, tok, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (tok), n)
SELECT k AS doc_id, tok AS token, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 8) AS w FROM w"""


@query(_grams_sql("SELECT k, substr(t, i, m) AS tok FROM (SELECT k, t, m, unnest(range(1, length(t) - m + 2)) AS i FROM x, range(3, 6) r(m))"))
def tfidf_char_grams(spark, d):
    return grams.tfidf_chars(table(spark, d, "documents"), "doc_id", "text", digits=8)


@query(_grams_sql("""SELECT k, unnest(w) AS tok FROM (SELECT k, regexp_extract_all(t, '[\\p{L}\\p{N}_]{2,}') AS w FROM x)
 UNION ALL SELECT k, w[i] || ' ' || w[i + 1] FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM (SELECT k, regexp_extract_all(t, '[\\p{L}\\p{N}_]{2,}') AS w FROM x))"""))
def tfidf_word_grams(spark, d):
    return rounded(tfidf.tfidf(table(spark, d, "documents"), "doc_id", "text", tokens=tfidf.word_grams))


@query(f"""
WITH x AS (SELECT doc_id AS k, lower(t) AS t FROM {_TEXTS}), n AS (SELECT count(*) AS n FROM x),
tf AS (SELECT k, tok, count(*)::DOUBLE AS tf FROM (SELECT k, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM x) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df, sum(tf) AS total FROM tf GROUP BY tok),
i AS (SELECT tok, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n), w AS (SELECT k, tok, tf * idf AS x FROM tf JOIN i USING (tok)),
q AS (SELECT qi, tok, tf * idf AS w FROM (SELECT item_id AS qi, tok, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL) JOIN i USING (tok)),
s AS (SELECT qi, k, sum(x * w) AS s FROM w JOIN q USING (tok) GROUP BY ALL), a AS (SELECT k, sqrt(sum(x * x)) AS a FROM w GROUP BY k), b AS (SELECT qi, sqrt(sum(w * w)) AS b FROM q GROUP BY qi),
r AS (SELECT qi, k, round_even(s / (a * b), 12) AS score FROM s JOIN a USING (k) JOIN b USING (qi))
SELECT qi AS query, (row_number() OVER (PARTITION BY qi ORDER BY score DESC, k))::INT AS rank, k AS doc_id, round(score, 8) AS score FROM r QUALIFY rank <= 10""")
def text_search(spark, d):
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), F.col("text").alias("t"))
    return rounded(tfidf.search(_texts(spark, d), "doc_id", "t", asked))


@query(f"""SELECT printf('nominal lab=%d alpha=%.4f observed=%.4f expected=%.4f n_units=%d n_pairable=%d', lab, alpha, observed, expected, n_units, n_pairable::BIGINT) AS line FROM ({_POINTS})""")
def alpha_report(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lab", F.col("l_orderkey") % 7)
    return report.lines(rounded(agreement.alpha_nominal(rows, "l_orderkey", "l_returnflag", ["lab"])), "nominal")
