"""All named queries over the reference tables, and DuckDB SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..operators import agreement, index, knn, linalg, pooling, rank, resample, textq, tfidf
from ..sources import tables
from ..sources.tables import table
from ..streaming.ingest import windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded; engines add in different orders."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _integral(f: str, upper: str) -> str:
    """Simpson's rule over [0, upper] with 4000 steps; f is of s."""
    return f"(SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f})) * max(h) / 12000 FROM (SELECT i, h, h * i / 4000 AS s FROM range(4001) r(i), (SELECT {upper} AS h)))"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a standard normal z >= 0."""
    return f"greatest(0, 1 - 2 * {_integral('exp(-s * s / 2)', z)} / sqrt(2 * pi()))"


def chi2_p_sql(x: str, k: str) -> str:
    """Upper tail of chi-square with k degrees, by x = s^2."""
    return f"greatest(0, 1 - {_integral(f'pow(s, {k} - 1) * exp(-s * s / 2)', f'sqrt({x})')} * 2 / pow(2, {k} / 2.0) / exp(lgamma({k} / 2.0)))"


def t_p_sql(t: str, k: str) -> str:
    """Two-sided p of Student's t with k degrees, by t = sqrt(k) tan s."""
    return f"greatest(0, 1 - 2 * {_integral(f'pow(cos(s), {k} - 1)', f'atan(abs({t}) / sqrt({k}))')} * exp(lgamma(({k} + 1) / 2.0) - lgamma({k} / 2.0)) / sqrt(pi()))"


def weights_sql(units: str, reps: int, seed: int, unit: str = "u") -> str:
    """Columns of `units`, b and w: resample.times() for each of its rows and replicates."""
    number = "('0x' || substr(h, 1 + 8 * (b % 8), 8))::BIGINT"
    count = " + ".join(f"(x >= {c})::INT" for c in resample.CUTS)
    hashed = f"SELECT *, sha256('{seed}|' || ({unit}) || '|' || k) AS h FROM {units}, (SELECT unnest(range({-(-reps // 8)})) AS k)"
    drawn = f"SELECT * EXCLUDE (h, k), {number} AS x FROM ({hashed}) JOIN (SELECT unnest(range({reps})) AS b) ON b // 8 = k"
    return f"(SELECT * EXCLUDE (x), {count} AS w FROM ({drawn}))"


# --- agreement ---------------------------------------------------------------------------------------------


def _nominal_sql(source: str, unit_col: str, label: str, by: str = "") -> str:
    b, j = (f"{by}, ", f"JOIN e USING ({by})") if by else ("", "CROSS JOIN e")
    g = f"GROUP BY {by}" if by else ""
    return f"""
WITH c AS (SELECT {b}{unit_col} AS u, {label} AS l, count(*) AS c FROM {source} GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY {b}u) AS m FROM c) WHERE m >= 2),
un AS (SELECT {b}u, max(m) AS m, sum(c * (c - 1)) AS same FROM p GROUP BY {b}u),
o AS (SELECT {b}sum((m * (m - 1) - same) / (m - 1)::DOUBLE) AS apart, sum(m)::DOUBLE AS n, count(*) AS n_units FROM un {g}),
e AS (SELECT {b}sum(t * (t - 1))::DOUBLE AS same FROM (SELECT {b}l, sum(c) AS t FROM p GROUP BY {b}l) {g}),
r AS (SELECT {b}apart / n AS observed, (n * (n - 1) - same) / (n * (n - 1)) AS expected, n_units, n::BIGINT AS n_pairable FROM o {j})
SELECT {b}round(CASE WHEN expected = 0 THEN 1 ELSE 1 - observed / expected END, 8) AS alpha, round(observed, 8) AS observed,
       round(expected, 8) AS expected, n_units, n_pairable FROM r"""


@query(_nominal_sql("lineitem", "l_orderkey", "l_returnflag"))
def alpha_nominal_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.alpha_nominal(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag"))


@query(_nominal_sql("documents", "source", "lang"))
def alpha_nominal_documents_lang(spark, d):
    return rounded(agreement.alpha_nominal(table(spark, d, "documents"), "source", "lang"))


@query(_nominal_sql("events", "user_id", "event_type"))
def alpha_nominal_events(spark, d):
    return rounded(agreement.alpha_nominal(table(spark, d, "events"), "user_id", "event_type"))


@query(_nominal_sql("conversations", "conv_id", "role"))
def alpha_nominal_conversations_role(spark, d):
    return rounded(agreement.alpha_nominal(table(spark, d, "conversations"), "conv_id", "role"))


@query(_nominal_sql("conversations", "conv_id", "lower(regexp_replace(text, '[^A-Za-z ]', '', 'g'))"))
def alpha_nominal_case_folded(spark, d):
    folded = F.lower(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return rounded(agreement.alpha_nominal(table(spark, d, "conversations").withColumn("l", folded), "conv_id", "l"))


@query(_nominal_sql("(SELECT *, l_orderkey % 7 AS lab FROM lineitem)", "l_orderkey", "l_returnflag", "lab"))
def alpha_by_lab(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lab", F.col("l_orderkey") % 7)
    return rounded(agreement.alpha_nominal(rows, "l_orderkey", "l_returnflag", ["lab"]))


def _semantic_sql(unit_col: str) -> str:
    return f"""
WITH x AS (SELECT {unit_col} AS u, vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY u) AS m FROM x) WHERE m >= 2),
q AS (SELECT u, k, m, v, sqrt(list_dot_product(v, v)) AS n FROM p),
d AS (SELECT a.u = b.u AS own, a.m, power(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 2) AS d FROM q a JOIN q b ON a.k <> b.k),
s AS (SELECT sum(CASE WHEN own THEN d / (m - 1) END) AS apart, sum(d) AS total FROM d),
r AS (SELECT apart / n AS observed, total / (n * (n - 1)) AS expected, n_units, n FROM s, (SELECT count(*) AS n, count(DISTINCT u) AS n_units FROM p))
SELECT round(1 - observed / expected, 8) AS alpha, round(observed, 8) AS observed, round(expected, 8) AS expected, n_units, n AS n_pairable FROM r"""


def _triples(spark, d):
    return table(spark, d, "embeddings").withColumn("u", F.expr("vec_id div 3"))


@query(_semantic_sql("vec_id // 3"))
def alpha_semantic_triples(spark, d):
    return rounded(agreement.alpha_semantic(_triples(spark, d), "u", "embedding"))


@query(_semantic_sql("label"))
def alpha_semantic_by_label(spark, d):
    return rounded(agreement.alpha_semantic(table(spark, d, "embeddings"), "label", "embedding"))


@query(_semantic_sql("vec_id // 3"))
def alpha_naive_triples(spark, d):
    return rounded(agreement.alpha_by_blocks(_triples(spark, d), "u", "embedding", "vec_id"))


_UNITS_SQL = """
WITH q AS (SELECT vec_id // 3 AS u, vec_id AS k, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
d AS (SELECT a.u AS unit, avg(power(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 2)) AS d, count(DISTINCT a.k) AS m FROM q a JOIN q b ON a.u = b.u AND a.k <> b.k GROUP BY a.u)"""


@query(_UNITS_SQL + " SELECT unit, m, round(d, 8) AS disagreement FROM d")
def per_unit_disagreement(spark, d):
    return rounded(agreement.per_unit_disagreement(_triples(spark, d), "u", "embedding"))


@query(_UNITS_SQL + """, t AS (SELECT * FROM d ORDER BY round_even(d, 12) DESC, unit LIMIT 15)
SELECT unit, m, round(d, 8) AS disagreement, string_agg(k::VARCHAR, '|' ORDER BY k::VARCHAR) AS texts FROM t JOIN q ON q.u = t.unit GROUP BY ALL""")
def worst_units_top15(spark, d):
    return rounded(agreement.worst_units(_triples(spark, d), "u", "embedding", "vec_id"))


@query("SELECT k, count(*) AS units FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey) GROUP BY k")
def unit_size_histogram(spark, d):
    return agreement.unit_sizes(table(spark, d, "lineitem"), "l_orderkey")


@query("""
WITH t AS (SELECT l_orderkey AS s, l_returnflag AS c FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 3)),
c AS (SELECT s, c, count(*)::DOUBLE AS k FROM t GROUP BY ALL),
p AS (SELECT avg((sq - 3) / 6) AS p, count(*) AS n FROM (SELECT sum(k * k) AS sq FROM c GROUP BY s)),
e AS (SELECT sum(power(k / tot, 2)) AS e FROM (SELECT sum(k) AS k, sum(sum(k)) OVER () AS tot FROM c GROUP BY c))
SELECT round((p - e) / (1 - e), 8) AS kappa, n AS n_subjects, 3::BIGINT AS n_raters FROM p, e""")
def fleiss_kappa_orders(spark, d):
    rows = table(spark, d, "lineitem")
    three = rows.groupBy("l_orderkey").count().where("count = 3").select("l_orderkey")
    return rounded(agreement.fleiss_kappa(rows.join(three, "l_orderkey", "left_semi"), "l_orderkey", "l_returnflag"))


@query(f"""
WITH c AS (SELECT l_orderkey AS u, l_returnflag AS l, count(*) AS c FROM lineitem GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY u) AS m FROM c) WHERE m >= 2),
un AS (SELECT u, max(m) AS m, sum(c * (c - 1)) AS same FROM p GROUP BY u), dr AS (SELECT * FROM {weights_sql("un", 1000, 0)} WHERE w > 0),
o AS (SELECT b, sum(w * m)::DOUBLE AS n, sum(w * (m * (m - 1) - same) / (m - 1)::DOUBLE) AS apart FROM dr GROUP BY b),
e AS (SELECT b, sum(t * (t - 1))::DOUBLE AS same FROM (SELECT b, l, sum(w * c) AS t FROM dr JOIN p USING (u) GROUP BY b, l) GROUP BY b),
a AS (SELECT 1 - (apart / n) / ((n * (n - 1) - o_same) / (n * (n - 1))) AS alpha FROM (SELECT o.*, e.same AS o_same FROM o JOIN e USING (b)))
SELECT round(quantile_cont(alpha, 0.025), 8) AS low, round(quantile_cont(alpha, 0.975), 8) AS high, count(*) AS reps FROM a""")
def bootstrap_ci_nominal(spark, d):
    return rounded(resample.bootstrap_nominal(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", 1000))


# --- text ----------------------------------------------------------------------------------------------------

# every whole document, and beside each a planted answer: junk, a non-answer or its text without the last two letters
_TEXTS = """(SELECT doc_id * 2 + j AS doc_id, source, CASE WHEN j = 0 THEN t ELSE CASE doc_id % 5 WHEN 0 THEN '+++++' WHEN 1 THEN 'N/A' WHEN 2 THEN 'no action.' WHEN 3 THEN 'zzzz'
 ELSE trim(substr(t, 1, length(t) - 2)) END END AS t FROM (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), range(2) r(j))"""


def _texts(spark, d):
    k, t = F.col("doc_id") % 5, textq.normalise("text")
    planted = F.when(k == 0, "+++++").when(k == 1, "N/A").when(k == 2, "no action.").when(k == 3, "zzzz").otherwise(F.trim(F.substr(t, F.lit(1), F.length(t) - 2)))
    both = F.posexplode(F.array(t, planted)).alias("j", "t")
    return table(spark, d, "documents").select("doc_id", "source", both).select((F.col("doc_id") * 2 + F.col("j")).alias("doc_id"), "source", "t")


_NA_SQL = "regexp_matches(lower(t), '^(?:" + "|".join(textq.NON_ANSWERS).replace("'", "''") + ")[.!?]?$')"
_JUNK_SQL = "(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) < 2 OR replace(t, substr(t, 1, 1), '') = '')"
_END_SQL = "(right(t, 1) NOT IN ('.', '!', '?'))"


@query(f"SELECT doc_id, t, {_END_SQL} AS no_terminal, {_NA_SQL} AS non_answer, {_JUNK_SQL} AS junk FROM {_TEXTS}")
def text_defects(spark, d):
    t = F.col("t")
    return _texts(spark, d).select("doc_id", "t", textq.no_terminal(t).alias("no_terminal"), textq.non_answer(t).alias("non_answer"), textq.junk(t).alias("junk"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER ({_END_SQL}) AS no_terminal, count(*) FILTER ({_NA_SQL}) AS non_answers, count(*) FILTER ({_JUNK_SQL}) AS junk, round(count(*) FILTER ({_JUNK_SQL}) / count(*), 8) AS junk_rate FROM {_TEXTS} GROUP BY source")
def defect_counts_by_lab(spark, d):
    t = F.col("t")
    return rounded(_texts(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(textq.no_terminal(t)).alias("no_terminal"), F.count_if(textq.non_answer(t)).alias("non_answers"),
        F.count_if(textq.junk(t)).alias("junk"), (F.count_if(textq.junk(t)) / F.count("*")).alias("junk_rate")))


@query(f"SELECT t, count(*) AS n FROM {_TEXTS} WHERE {_NA_SQL} OR {_JUNK_SQL} GROUP BY t ORDER BY n DESC, t LIMIT 20")
def most_common_defects(spark, d):
    t = F.col("t")
    return _texts(spark, d).where(textq.non_answer(t) | textq.junk(t)).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(20)


@query(f"SELECT source, bool_or({_NA_SQL}) AS touched, bool_and({_NA_SQL}) AS wholly FROM {_TEXTS} GROUP BY source")
def touched_units(spark, d):
    na = textq.non_answer(F.col("t"))
    return _texts(spark, d).groupBy("source").agg(F.bool_or(na).alias("touched"), F.bool_and(na).alias("wholly"))


_TRUNC_SQL = f"""
WITH x AS (SELECT * FROM {_TEXTS}),
v AS (SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM x) GROUP BY w),
e AS (SELECT substr(w, 1, k) AS w, sum(c) AS x FROM (SELECT w, c, unnest(range(1, length(w))) AS k FROM v) GROUP BY 1),
l AS (SELECT doc_id, source, t, list_extract(regexp_extract_all(lower(t), '[a-z]+'), -1) AS w FROM x),
f AS (SELECT doc_id, source, t, coalesce(right(t, 1) NOT IN ('.', '!', '?') AND w IS NOT NULL AND coalesce(c, 0) <= 2 AND coalesce(e.x, 0) >= 20, false) AS truncated
      FROM l LEFT JOIN v USING (w) LEFT JOIN e USING (w))"""


@query(_TRUNC_SQL + " SELECT doc_id, truncated FROM f")
def flag_truncated(spark, d):
    return textq.flag_truncated(_texts(spark, d), "t").select("doc_id", "truncated")


@query(_TRUNC_SQL + """, c AS (SELECT source AS g, count(*) AS n, count(*) FILTER (truncated) AS k FROM f GROUP BY 1),
t AS (SELECT *, (sum(n) OVER ())::DOUBLE AS nn, (sum(k) OVER ())::DOUBLE AS kk FROM c),
o AS (SELECT k AS o, n * kk / nn AS e FROM t UNION ALL SELECT n - k, n * (nn - kk) / nn FROM t),
r AS (SELECT sum(power(o - e, 2) / e) AS x, (count(*) // 2 - 1)::BIGINT AS k, count(*) FILTER (e < 5) AS expected_under_5 FROM o)
SELECT round(x, 8) AS statistic, k AS dof, expected_under_5, round(""" + chi2_p_sql("x", "k") + ", 8) AS p FROM r")
def chi2_lab(spark, d):
    return rounded(textq.contingency(textq.flag_truncated(_texts(spark, d), "t"), "source", "truncated"))


@query(f"""WITH b AS (SELECT 'chars' AS measure, length(t) AS v FROM {_TEXTS} UNION ALL SELECT 'words', len(list_filter(string_split(t, ' '), lambda w: w <> '')) FROM {_TEXTS})
SELECT measure, min(v)::INT AS least, trunc(quantile_cont(v, 0.05))::INT AS p5, trunc(quantile_cont(v, 0.25))::INT AS p25, trunc(quantile_cont(v, 0.5))::INT AS p50, trunc(quantile_cont(v, 0.75))::INT AS p75,
 trunc(quantile_cont(v, 0.95))::INT AS p95, trunc(quantile_cont(v, 0.99))::INT AS p99, max(v)::INT AS most, round(avg(v), 8) AS mean FROM b GROUP BY measure""")
def length_distribution(spark, d):
    return rounded(textq.length_distribution(_texts(spark, d), "t"))


@query(f"""WITH b AS (SELECT length(t) AS v FROM {_TEXTS}), p AS (SELECT quantile_cont(v, 0.9) AS q FROM b)
SELECT v AS chars, count(*) AS n FROM b, p WHERE v >= q GROUP BY v ORDER BY n DESC, v LIMIT 8""")
def densest_lengths(spark, d):
    b = _texts(spark, d).select(F.length("t").cast("long").alias("chars"))
    q = b.agg(F.percentile("chars", F.lit(0.9)).alias("q"))
    return b.crossJoin(F.broadcast(q)).where("chars >= q").groupBy("chars").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chars").limit(8)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 8) AS rate FROM orders GROUP BY 1 HAVING count(*) >= 200")
def month_table(spark, d):
    rows = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(rows.groupBy("month").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate")).where("n >= 200"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN count(*) OVER w > 1 THEN (sum(l_quantity) OVER w - l_quantity) / (count(*) OVER w - 1) END, 8) AS sibling_mean
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def sibling_mean_quantity(spark, d):
    rows = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return rounded(textq.sibling_mean(rows, "l_orderkey", "q").select("l_orderkey", "l_linenumber", "sibling_mean"))


@query("""
WITH x AS (SELECT l_quantity::DOUBLE AS v, l_returnflag = 'R' AS f FROM lineitem),
c AS (SELECT v, count(*)::DOUBLE AS t, count(*) FILTER (f) AS a FROM x GROUP BY v),
r AS (SELECT *, sum(t) OVER (ORDER BY v) - (t - 1) / 2 AS mid FROM c),
s AS (SELECT sum(a * mid) AS r1, sum(a)::BIGINT AS n1, (sum(t) - sum(a))::BIGINT AS n2, sum(t * t * t - t) AS ties, sum(t) AS n FROM r),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s),
z AS (SELECT u, n1, n2, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
SELECT round(u, 8) AS u, n1, n2, round(z, 8) AS z, round(least(1, """ + normal_p_sql("z") + "), 8) AS p FROM z")
def mann_whitney_quantity(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("v"), (F.col("l_returnflag") == "R").alias("f"))
    return rounded(textq.mann_whitney(rows, "v", "f"))


_EXCLUDED = f"""(SELECT k.name AS class, x.source, x.t FROM {_TEXTS} x, (VALUES ('all'), ('junk'), ('non_answer')) k(name)
 WHERE k.name = 'all' OR (k.name = 'junk' AND NOT {_JUNK_SQL}) OR (k.name = 'non_answer' AND NOT {_NA_SQL}))"""


@query(_nominal_sql(_EXCLUDED, "source", "t", "class"))
def alpha_excluding_class(spark, d):
    t = F.col("t")
    kept = F.filter(F.array(F.lit("all"), F.when(~textq.junk(t), "junk"), F.when(~textq.non_answer(t), "non_answer")), lambda x: x.isNotNull())
    rows = _texts(spark, d).select("source", t.alias("l"), F.explode(kept).alias("class"))
    return rounded(agreement.alpha_nominal(rows, "source", "l", ["class"]))


_TFIDF_SQL = f"""
WITH x AS (SELECT doc_id // 3 AS u, doc_id AS k, lower(t) AS t FROM {_TEXTS}),
n AS (SELECT count(*) AS n FROM x),
tf AS (SELECT k, u, tok, count(*)::DOUBLE AS tf FROM (SELECT k, u, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM x) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df, sum(tf) AS total FROM tf GROUP BY tok ORDER BY total DESC, tok LIMIT 5000),
w AS (SELECT k, u, tok, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (tok), n),
z AS (SELECT k, u, tok, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM w)"""


@query(_TFIDF_SQL + " SELECT k AS doc_id, tok AS token, round(w, 8) AS w FROM z")
def tfidf_weights(spark, d):
    return rounded(tfidf.tfidf(_texts(spark, d), "doc_id", "t"))


@query(_TFIDF_SQL + """, ks AS (SELECT DISTINCT k, u FROM z), m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY u) AS m FROM ks) WHERE m >= 2),
c AS (SELECT a.k AS ka, b.k AS kb, sum(a.w * b.w) AS c FROM z a JOIN z b ON a.tok = b.tok AND a.k <> b.k GROUP BY 1, 2),
d AS (SELECT a.u = b.u AS own, a.m, power(1 - coalesce(c.c, 0), 2) AS d FROM m a JOIN m b ON a.k <> b.k LEFT JOIN c ON c.ka = a.k AND c.kb = b.k),
r AS (SELECT sum(CASE WHEN own THEN d / (m - 1) END) AS apart, sum(d) AS total FROM d), s AS (SELECT count(*) AS n, count(DISTINCT u) AS n_units FROM m)
SELECT round(1 - (apart / n) / (total / (n * (n - 1))), 8) AS alpha, n_units, n AS n_pairable FROM r, s""")
def tfidf_alpha(spark, d):
    rows = _texts(spark, d).withColumn("u", F.expr("doc_id div 3"))
    return rounded(tfidf.alpha_sparse(tfidf.tfidf(rows, "doc_id", "t"), rows, "doc_id", "u"))


@query(f"SELECT bit_xor(('0x' || substr(md5('m|' || t), 1, 15))::BIGINT) AS tag, count(*) AS rows FROM {_TEXTS}")
def corpus_tag(spark, d):
    return tables.corpus_tag(_texts(spark, d), "t", "m")


# --- neighbours ------------------------------------------------------------------------------------------------


def _graph_sql(vec: str, k: int, name: str, where: str = "true") -> str:
    return f"""{name}v AS (SELECT vec_id AS id, label, {vec}::DOUBLE[] AS x, sqrt(list_dot_product({vec}::DOUBLE[], {vec}::DOUBLE[])) AS n FROM embeddings),
{name} AS (SELECT * FROM (SELECT a.id, b.id AS nbr, a.label, b.label AS nlabel, list_dot_product(a.x, b.x) / (a.n * b.n) AS sim,
 row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.x, b.x) / (a.n * b.n) DESC, b.id) AS rank
 FROM {name}v a JOIN {name}v b ON a.id <> b.id WHERE {where}) WHERE rank <= {k})"""


_A, _B = "embedding[1:32]", "embedding[33:64]"


def _views(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))


@query("WITH " + _graph_sql("embedding", 10, "g") + " SELECT id, rank::INT AS rank, nbr, round(sim, 8) AS sim FROM g")
def knn_exact_k10(spark, d):
    return rounded(knn.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 10))


@query("WITH " + _graph_sql("embedding", 10, "g", "a.id % 100 = 0") + " SELECT id, rank::INT AS rank, nbr, round(sim, 8) AS sim FROM g")
def search_exact(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(index.exact_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10))


_CHANCE = "(SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS chance FROM (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label))"


@query("WITH " + _graph_sql("embedding", 25, "g") + f""",
e AS (SELECT k, id, avg(CASE WHEN label = nlabel THEN 1.0 ELSE 0.0 END) AS p FROM g, (VALUES (1), (5), (10), (25)) t(k) WHERE rank <= k GROUP BY k, id)
SELECT k, round(avg(p), 8) AS purity, round(stddev_samp(p), 8) AS sd, round(avg((p = 1)::INT), 8) AS all_same, round(avg((p = 0)::INT), 8) AS none_same,
 round(any_value(chance), 8) AS chance, round(avg(p) / any_value(chance), 8) AS ratio FROM e, {_CHANCE} GROUP BY k""")
def knn_purity_curve(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(knn.purity_curve(knn.neighbours(rows, "vec_id", "embedding", 25), rows, "vec_id", "label", [1, 5, 10, 25]))


@query(f"SELECT round(chance, 8) AS chance FROM {_CHANCE}")
def chance_purity(spark, d):
    return rounded(knn.chance_purity(table(spark, d, "embeddings"), "label"))


@query("""WITH g AS (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label)
SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 8) AS mean, max(n) AS most, round(sum(n * n) / sum(n), 8) AS row_mean,
 round(sum(n * CASE WHEN n > 1 THEN least(1.0, 10.0 / (n - 1)) ELSE 1.0 END) / sum(n), 8) AS filled FROM g""")
def tie_group_sizes(spark, d):
    return rounded(knn.tie_group_sizes(table(spark, d, "embeddings"), "label"))


_DIS = "WITH " + _graph_sql(_A, 10, "g") + f""", l AS (SELECT vec_id AS id, {_B}::DOUBLE[] AS y, sqrt(list_dot_product({_B}::DOUBLE[], {_B}::DOUBLE[])) AS m FROM embeddings),
s AS (SELECT g.id, 1 - avg(list_dot_product(p.y, q.y) / (p.m * q.m)) AS score FROM g JOIN l p ON p.id = g.id JOIN l q ON q.id = g.nbr GROUP BY g.id)"""


def _disagreement(spark, d):
    v = _views(spark, d)
    return knn.disagreement(knn.neighbours(v, "vec_id", "a", 10), v, "vec_id", "b", snapped=True)


@query(_DIS + " SELECT id, round(score, 8) AS score FROM s")
def neighborhood_disagreement(spark, d):
    return rounded(_disagreement(spark, d))


@query("WITH " + _graph_sql(_A, 10, "g") + ", " + _graph_sql(_B, 10, "h") + """
SELECT a.id, round(coalesce(c / (20.0 - c), 0), 8) AS jaccard FROM (SELECT DISTINCT id FROM g) a LEFT JOIN (SELECT g.id, count(*) AS c FROM g JOIN h ON g.id = h.id AND g.nbr = h.nbr GROUP BY g.id) USING (id)""")
def neighborhood_overlap(spark, d):
    v = _views(spark, d)
    return rounded(knn.overlap(knn.neighbours(v, "vec_id", "a", 10), knn.neighbours(v, "vec_id", "b", 10)))


@query("WITH " + _graph_sql(_A, 10, "g") + ", " + _graph_sql(_B, 10, "h") + """,
o AS (SELECT coalesce(c / (20.0 - c), 0) AS j FROM (SELECT DISTINCT id FROM g) a LEFT JOIN (SELECT g.id, count(*) AS c FROM g JOIN h ON g.id = h.id AND g.nbr = h.nbr GROUP BY g.id) USING (id))
SELECT round(avg(j), 8) AS mean, round(quantile_cont(j, 0.5), 8) AS median, round(stddev_samp(j), 8) AS sd, round(max(j), 8) AS most, round(avg((j = 0)::INT), 8) AS zero FROM o""")
def overlap_summary(spark, d):
    v = _views(spark, d)
    return rounded(knn.summary(knn.overlap(knn.neighbours(v, "vec_id", "a", 10), knn.neighbours(v, "vec_id", "b", 10)), "jaccard"))


@query(f"""
WITH s AS (SELECT vec_id AS id, {_A}::DOUBLE[] AS a, {_B}::DOUBLE[] AS b FROM embeddings ORDER BY md5('0|' || vec_id), vec_id LIMIT 2000),
u AS (SELECT id, a, b, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb FROM s),
p AS (SELECT 1 - list_dot_product(x.a, y.a) / (x.na * y.na) AS da, 1 - list_dot_product(x.b, y.b) / (x.nb * y.nb) AS db FROM u x JOIN u y ON x.id < y.id),
r AS (SELECT rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2.0 AS ra, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2.0 AS rb FROM p)
SELECT round(corr(ra, rb), 8) AS rho, count(*) AS n FROM r""")
def rank_corr_views(spark, d):
    s = resample.sample(_views(spark, d), "vec_id", 2000, 0)
    return rounded(knn.spearman(knn.pairwise(s, "vec_id", "a", "b"), "da", "db"))


@query("WITH " + _graph_sql("embedding", 1, "g") + """, q AS (SELECT avg(list_dot_product(a.x, b.x) / (a.n * b.n)) AS pairwise FROM gv a JOIN gv b ON a.id <> b.id)
SELECT (SELECT count(*) FROM gv) AS n, 64 AS dim, round(avg(sim), 8) AS nearest, (SELECT round(pairwise, 8) FROM q) AS pairwise, (SELECT count(DISTINCT label) FROM gv) AS distinct_labels FROM g""")
def instruction_report(spark, d):
    rows = table(spark, d, "embeddings")
    near = knn.neighbours(rows, "vec_id", "embedding", 1).agg(F.avg("sim").alias("nearest"))
    parts = rows.select(F.posexplode(unit("embedding"))).groupBy("pos").agg(F.sum("col").alias("s")).agg(F.sum(F.col("s") ** 2).alias("sq"))
    counts = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.countDistinct("label").alias("distinct_labels"))
    out = counts.crossJoin(near).crossJoin(parts)
    return rounded(out.select("n", "dim", "nearest", ((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("pairwise"), "distinct_labels"))


@query("""
WITH p AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT a.k, greatest(abs(a.e[1] - b.e[1]), abs(a.e[2] - b.e[2])) AS dx, greatest(abs(a.e[33] - b.e[33]), abs(a.e[34] - b.e[34])) AS dy FROM p a JOIN p b ON a.k <> b.k),
e AS (SELECT k, d AS eps FROM (SELECT k, greatest(dx, dy) AS d, row_number() OVER (PARTITION BY k ORDER BY greatest(dx, dy)) AS r FROM q) WHERE r = 5),
c AS (SELECT k, count(*) FILTER (dx < eps - 1e-12) AS nx, count(*) FILTER (dy < eps - 1e-12) AS ny FROM q JOIN e USING (k) GROUP BY k),
h AS (SELECT n, sum(CASE WHEN n > 0 THEN 1.0::DOUBLE / n ELSE 0 END) OVER (ORDER BY n) AS h FROM (SELECT unnest(range(0, 3000))::BIGINT AS n))
SELECT round(greatest(0, (SELECT h FROM h WHERE n = 4) + (SELECT h FROM h WHERE n = (SELECT count(*) - 1 FROM p)) - avg(a.h + b.h)), 8) AS mi, count(*) AS n
FROM c JOIN h a ON a.n = nx JOIN h b ON b.n = ny""")
def ksg_mutual_information(spark, d):
    at = lambda *k: [F.col("embedding")[i] for i in k]
    return rounded(knn.ksg(table(spark, d, "embeddings"), at(0, 1), at(32, 33), "vec_id"))


@query()
def effective_rank(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(spark.createDataFrame([(linalg.effective_rank(rows, "embedding"),)], "effective_rank double"))


@query()
def cca_views(spark, d):
    r = linalg.cca(_views(spark, d), "a", "b")[0]
    rows = [(i, float(x), linalg.gaussian_mi([x])) for i, x in enumerate(r)]
    return rounded(spark.createDataFrame(rows, "component int, correlation double, mi double"))


@query()
def cross_validated_cca(spark, d):
    return rounded(spark.createDataFrame(linalg.cross_validated_cca(_views(spark, d), "vec_id", "a", "b")))


@query()
def search_ivf_recall(spark, d):
    rows = table(spark, d, "embeddings")
    built, centroids = index.build(rows, "vec_id", "embedding", 16)
    exact = index.exact_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    found = index.search(built, centroids, built.where("vec_id % 100 = 0"), "vec_id", 10, 8)
    return rounded(index.recall(found, exact))


@query("""
WITH v AS (SELECT vec_id, vec_id // 3 AS u, list_transform(embedding::DOUBLE[], lambda e: e / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings),
m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS a FROM v, range(1, 65) r(i) WHERE u = 5 GROUP BY i)),
s AS (SELECT u AS unit, vec_id AS nbr, list_dot_product(x, m) / sqrt(list_dot_product(m, m)) AS sim FROM v, m WHERE u <> 5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY sim DESC, nbr) AS r FROM s) WHERE r = 1)
SELECT unit, nbr, round(sim, 8) AS sim, (row_number() OVER (ORDER BY sim DESC, unit))::INT AS rank FROM b ORDER BY sim DESC, unit LIMIT 10""")
def episode_similar(spark, d):
    return rounded(index.similar_units(_triples(spark, d), "u", "vec_id", "embedding", 5, 10))


# --- noise, ranks and detection ----------------------------------------------------------------------------------

_SUBSET = """WITH x AS (SELECT vec_id AS k, label AS l FROM embeddings), n AS (SELECT round_even(0.3::DOUBLE * count(*), 0)::BIGINT AS n FROM x),
s AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || k), k) - 1 AS r0 FROM x)"""


@query(_SUBSET + """, m AS (SELECT n - n % 2 AS m FROM n), c AS (SELECT k, l, r0 AS r FROM s, m WHERE r0 < m),
g AS (SELECT (r + m // 2) % m AS r, l AS nl FROM c, m)
SELECT x.k AS vec_id, x.l AS label, coalesce(nl, x.l) AS new_label, coalesce(nl, x.l) <> x.l AS changed FROM x LEFT JOIN c USING (k) LEFT JOIN g USING (r)""")
def noise_swap(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return resample.inject_label_noise(rows, "vec_id", "label", 0.3, "swap")


@query(_SUBSET + """, c AS (SELECT k, l, r0 AS r FROM s, n WHERE r0 < n), g AS (SELECT l AS nl, row_number() OVER (ORDER BY md5('1|' || k), k) - 1 AS r FROM c)
SELECT x.k AS vec_id, x.l AS label, coalesce(nl, x.l) AS new_label, coalesce(nl, x.l) <> x.l AS changed FROM x LEFT JOIN c USING (k) LEFT JOIN g USING (r)""")
def noise_shuffle(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return resample.inject_label_noise(rows, "vec_id", "label", 0.3, "shuffle")


_NEAREST_LABEL = """u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda e: e / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings),
ml AS (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(x[i]) AS a FROM u, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
nl AS (SELECT * FROM (SELECT a.label, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m) * list_dot_product(b.m, b.m)) DESC, b.label) AS r
 FROM ml a JOIN ml b ON a.label <> b.label) WHERE r = 1)"""


@query(_SUBSET + ", " + _NEAREST_LABEL + """, c AS (SELECT k, l, r0 AS r FROM s, n WHERE r0 < n)
SELECT x.k AS vec_id, x.l AS label, CASE WHEN c.k IS NULL THEN x.l ELSE other END AS new_label, c.k IS NOT NULL AS changed FROM x LEFT JOIN c USING (k) JOIN nl ON nl.label = x.l""")
def noise_paraphrase(spark, d):
    rows = table(spark, d, "embeddings")
    nearest = knn.nearest_labels(rows, "label", "embedding")
    return resample.inject_label_noise(rows.select("vec_id", "label"), "vec_id", "label", 0.3, "paraphrase", nearest=nearest)


_DERANGED = """WITH x AS (SELECT vec_id AS k, label AS l FROM embeddings), c AS (SELECT *, row_number() OVER (ORDER BY l, k) - 1 AS r FROM (SELECT * FROM x ORDER BY md5('0|' || k), k LIMIT 85)),
t AS (SELECT max(n) AS t FROM (SELECT count(*) AS n FROM c GROUP BY l)), g AS (SELECT (r + t) % 85 AS r, l AS nl FROM c, t),
w AS (SELECT x.k AS vec_id, x.l AS label, coalesce(nl, x.l) AS new_task FROM x LEFT JOIN c USING (k) LEFT JOIN g USING (r))"""


@query(_DERANGED + " SELECT * FROM w")
def task_derangement(spark, d):
    return resample.derange_tasks(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 85)


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), t AS (SELECT id, score, (id % 9 = 0)::INT AS t FROM q),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid, row_number() OVER (ORDER BY score DESC, md5('0|' || id), id) AS top FROM t),
a AS (SELECT sum(t)::BIGINT AS p, sum(1 - t) AS n, sum(t * mid) AS r, (count(*) FILTER (t = 1 AND top <= 50))::DOUBLE AS h50, (count(*) FILTER (t = 1 AND top <= 200))::DOUBLE AS h200 FROM r)
SELECT round((r - p * (p + 1) / 2) / (p * n), 8) AS auc, p AS positives, h50 / 50 AS precision_50, round(h50 / p, 8) AS recall_50, least(1.0, round(p / 50, 8))::DOUBLE AS ceiling_50,
 h200 / 200 AS precision_200, round(h200 / p, 8) AS recall_200, least(1.0, round(p / 200, 8))::DOUBLE AS ceiling_200 FROM a""")
def detection_metrics(spark, d):
    s = _disagreement(spark, d)
    return rounded(rank.detection(s, s.where("id % 9 = 0")))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s),
e AS (SELECT 'x' AS encoder, id, score FROM q UNION ALL SELECT 'y', id, round_even(score * ((id * 7) % 13), 12) FROM q),
r AS (SELECT *, rank() OVER (PARTITION BY encoder ORDER BY score DESC) + (count(*) OVER (PARTITION BY encoder, score) - 1) / 2.0 AS mid FROM e)
SELECT id, round(-avg(mid), 8) + 0.0 AS score FROM r GROUP BY id""")
def ensemble_rank(spark, d):
    s = _disagreement(spark, d)
    other = s.select(F.lit("y").alias("encoder"), "id", F.bround(F.col("score") * ((F.col("id") * 7) % 13), 12).alias("score"))
    return rounded(rank.ensemble(s.select(F.lit("x").alias("encoder"), "id", "score").union(other)))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s)
SELECT id, round(score, 8) AS score, (row_number() OVER (ORDER BY score DESC, md5('0|' || id), id))::INT AS rank FROM q QUALIFY rank <= 200""")
def suspect_worklist(spark, d):
    return rounded(rank.top(_disagreement(spark, d), 200))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), a AS (SELECT id FROM q ORDER BY score DESC, md5('0|' || id), id LIMIT 50), wa AS (SELECT id FROM q ORDER BY score DESC, md5('0|' || id), id LIMIT 150),
o AS (SELECT id, round_even(score * ((id * 7) % 13), 12) AS score FROM q), b AS (SELECT id FROM o ORDER BY score DESC, md5('1|' || id), id LIMIT 50), wb AS (SELECT id FROM o ORDER BY score DESC, md5('1|' || id), id LIMIT 150)
SELECT (SELECT count(*) / 50.0 FROM a JOIN b USING (id))::DOUBLE AS common, (SELECT count(*) / 50.0 FROM a JOIN wb USING (id))::DOUBLE AS a_in_b, (SELECT count(*) / 50.0 FROM b JOIN wa USING (id))::DOUBLE AS b_in_a""")
def topk_overlap(spark, d):
    s = _disagreement(spark, d)
    other = s.select("id", F.bround(F.col("score") * ((F.col("id") * 7) % 13), 12).alias("score"))
    return rounded(rank.agreement_of_tops(s, other, 50, 150))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s)
SELECT round(avg(score), 8) AS mean, round(stddev_samp(score), 8) AS sd, round(min(score), 8) AS q0, round(quantile_cont(score, 0.01), 8) AS q1, round(quantile_cont(score, 0.05), 8) AS q5, round(quantile_cont(score, 0.25), 8) AS q25,
 round(quantile_cont(score, 0.5), 8) AS q50, round(quantile_cont(score, 0.75), 8) AS q75, round(quantile_cont(score, 0.95), 8) AS q95, round(quantile_cont(score, 0.99), 8) AS q99, round(max(score), 8) AS q100, count(DISTINCT score) AS distinct_scores FROM q""")
def score_distribution(spark, d):
    return rounded(rank.distribution(_disagreement(spark, d)))


@query(_DIS + """, q AS (SELECT id, round_even(score, 12) AS score FROM s), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, md5('0|' || id), id) AS r FROM q),
e AS (SELECT max(CASE WHEN r = 50 THEN score END) AS at_k, max(CASE WHEN r = 51 THEN score END) AS after_k FROM r)
SELECT round(avg(score) FILTER (r <= 50), 8) AS top_mean, round(avg(score) FILTER (r > 50), 8) AS rest_mean, round((avg(score) FILTER (r <= 50) - avg(score) FILTER (r > 50)) / stddev_samp(score), 8) AS gap_sd,
 round(any_value(at_k), 8) AS at_k, round(any_value(after_k), 8) AS after_k, round(any_value(at_k - after_k), 8) AS drop, round(quantile_cont(score, 0.5), 8) AS median, round(max(score), 8) AS most,
 count(*) FILTER (score > 0) AS positive, count(*) FILTER (score = at_k) AS ties, count(*) FILTER (score > at_k) AS above FROM r, e""")
def specificity_block(spark, d):
    return rounded(rank.specificity(_disagreement(spark, d)))


@query("""WITH p AS (SELECT (l_linenumber / 10.0)::DOUBLE AS rate, avg(l_discount::DOUBLE) AS score FROM lineitem GROUP BY 1), s AS (SELECT regr_slope(score, rate) AS slope, regr_intercept(score, rate) AS intercept, corr(score, rate) AS r,
 regr_sxx(score, rate) AS sxx, regr_syy(score, rate) AS syy, count(*) AS n FROM p),
e AS (SELECT *, sqrt(greatest(0, 1 - r * r) * syy / sxx / (n - 2)) AS se FROM s)
SELECT round(slope, 8) AS slope, round(intercept, 8) AS intercept, round(r, 8) AS r, round(se, 8) AS stderr, n, round(""" + t_p_sql("(slope / se)", "(n - 2)") + ", 8) AS p FROM e")
def degradation_curve(spark, d):
    p = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") / 10.0).alias("rate")).agg(F.avg(F.col("l_discount").cast("double")).alias("score"))
    return rounded(rank.fit_line(p))


# --- pooling, frames, ingestion ----------------------------------------------------------------------------------


@query("""WITH v AS (SELECT label, list_transform(embedding::DOUBLE[], lambda e: e / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings),
a AS (SELECT label AS unit, i, avg(x[i]) AS a FROM v, range(1, 65) r(i) GROUP BY label, i), n AS (SELECT unit, sqrt(sum(a * a)) AS n FROM a GROUP BY unit)
SELECT unit, (i - 1)::INT AS dim, round(a / n, 8) + 0.0 AS value FROM a JOIN n USING (unit)""")
def pool_unit_vector(spark, d):
    return rounded(pooling.pool(table(spark, d, "embeddings"), "label", "embedding").select("unit", F.posexplode("x").alias("dim", "value")))


_ACTION = """WITH s AS (SELECT user_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
a AS (SELECT user_id, n, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS least, max(v) AS most, max(CASE WHEN i = 0 THEN v END) AS w0, max(CASE WHEN i = round_even(0.25 * (n - 1)::DOUBLE, 0) THEN v END) AS w25,
 max(CASE WHEN i = round_even(0.5 * (n - 1)::DOUBLE, 0) THEN v END) AS w50, max(CASE WHEN i = round_even(0.75 * (n - 1)::DOUBLE, 0) THEN v END) AS w75, max(CASE WHEN i = n - 1 THEN v END) AS w100 FROM s GROUP BY user_id, n)"""
_ACTION_COLUMNS = ["mean", "sd", "least", "most", "w0", "w25", "w50", "w75", "w100"]


def _action(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.col("value").cast("double"))
    return pooling.waypoints(rows, "user_id", ["ts", "event_id"], "v")


@query(_ACTION + " SELECT user_id, n, " + ", ".join(f"round({c}, 8) AS {c}" for c in _ACTION_COLUMNS) + " FROM a")
def action_view(spark, d):
    return rounded(_action(spark, d))


@query(_ACTION + " SELECT user_id, n, " + ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END, 6) + 0.0 AS {c}" for c in _ACTION_COLUMNS) + " FROM a")
def action_view_zscore(spark, d):
    return rounded(pooling.zscore(_action(spark, d), _ACTION_COLUMNS), 6)


# fifteen channels of a frame: eight of state, seven of action
_CHANNELS = [f"c{k}" for k in range(15)]
_WIDE = [f"{c}_{x}" for c in _CHANNELS for x in pooling.STATS]


def _wide_sql() -> str:
    channels = ", ".join(f"value::DOUBLE * ((event_id * {k + 1}) % {k + 2}) AS c{k}" for k in range(15))
    point = lambda c, f: f"max(CASE WHEN i = round_even({f} * (n - 1)::DOUBLE, 0) THEN {c} END)"
    stats = ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd, min({c}) AS {c}_least, max({c}) AS {c}_most, " + ", ".join(f"{point(c, f / 100)} AS {c}_w{f}" for f in (0, 25, 50, 75, 100)) for c in _CHANNELS)
    scaled = ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END, 6) + 0.0 AS {c}" for c in _WIDE)
    return f"""WITH s AS (SELECT user_id, {channels}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
a AS (SELECT user_id, n, {stats} FROM s GROUP BY user_id, n) SELECT user_id, n, {scaled} FROM a"""


@query(_wide_sql())
def action_view_wide(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", *[(F.col("value").cast("double") * ((F.col("event_id") * (k + 1)) % (k + 2))).alias(c) for k, c in enumerate(_CHANNELS)])
    return rounded(pooling.action_view(rows, "user_id", ["ts", "event_id"], _CHANNELS), 6)


@query("SELECT user_id, min(event_type) AS least, max(event_type) AS most, min(event_type) = max(event_type) AS consistent FROM events GROUP BY user_id")
def constant_in_group(spark, d):
    return pooling.constant_in_group(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT file, doc_id, n, (sum(n) OVER w - n)::BIGINT AS "first", (sum(n) OVER w - 1)::BIGINT AS "last" FROM (SELECT doc_id, source AS file, length(text) AS n FROM documents) WINDOW w AS (PARTITION BY file ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def file_plan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.length("text").cast("long").alias("n"))
    return pooling.file_plan(rows, "file", "doc_id", "n").select("file", "doc_id", "n", "first", "last")


@query("SELECT user_id, pick::INT AS pick, round_even(pick * (n - 1) / 8.0::DOUBLE, 0)::BIGINT AS frame FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(9) r(pick)")
def frame_plan(spark, d):
    return pooling.frame_plan(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import audit, more  # noqa: E402, F401  add their queries
