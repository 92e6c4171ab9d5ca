"""Feature queries: embeddings are frames (kinematics: components 1 to 8, the
rest are features; recording: label, order: vector id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.columns import aic, aicc, bic, clip_gain, cube_root, range_normalise
from tracelake.operators import decode, metrics, select
from tracelake.plans import sqltext
from tracelake.plans.base import query, r6, signed_round, table

_LONG = "v AS (SELECT vec_id, label, unnest(generate_series(1, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_CORR = "CASE WHEN stddev_pop({0}) = 0 OR stddev_pop({1}) = 0 THEN 0 ELSE covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", "embedding", F.slice("embedding", 1, 8).alias("state"), F.slice("embedding", 9, 56).alias("features"))


_SMALL = "f AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[9]::DOUBLE AS z1, embedding[10]::DOUBLE AS z2 FROM embeddings)"


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states and two features, which SQL can invert by hand."""
    return _frames(spark, sf_dir).select("vec_id", "label", F.slice("state", 1, 2).alias("state"), F.slice("features", 1, 2).alias("features"))


def _dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).select("vec_id", "label", F.posexplode("state").alias("dof", "value"))
    return rows.select("vec_id", "label", (F.col("dof") + 1).alias("dof"), F.col("value").cast("double").alias("value"))


@query(f"""WITH {_LONG}, c AS (SELECT a.label, a.k AS i, b.k AS j, {_CORR.format('a.x', 'b.x')} AS c FROM v a JOIN v b USING (vec_id, label) WHERE a.k > 8 AND b.k > 8 GROUP BY ALL)
SELECT label, round(sum(abs(c)) / count(*), 6) AS redundancy FROM c GROUP BY label""")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.redundancy(_frames(spark, sf_dir), "features", ["label"]).select("label", *r6("redundancy"))


@query(f"""WITH {_LONG}, c AS (SELECT a.k AS i, b.k AS j, {_CORR.format('a.x', 'b.x')} AS c FROM v a JOIN v b USING (vec_id) WHERE a.k <= 8 AND b.k > 8 GROUP BY ALL)
SELECT i - 1 AS target, round(sum(abs(c)) / count(*), 6) AS relevance FROM c GROUP BY i""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relevance(_frames(spark, sf_dir), "embedding", 8).select("target", *r6("relevance"))


_EIGEN = """e AS (SELECT (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS l1, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS l2
  FROM (SELECT var_samp(z1) AS a, var_samp(z2) AS b, covar_samp(z1, z2) AS c FROM f))"""


@query(f"WITH {_SMALL}, {_EIGEN} SELECT unnest([1, 2]) AS component, round(100 * unnest([l1, l2]) / (l1 + l2), 6) AS percent FROM e")
def pca_vaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variance_explained(_small(spark, sf_dir), F.col("features"), 2).select("component", *r6("percent"))


@query(f"""WITH {_SMALL}, {_EIGEN}, l AS (SELECT vec_id, unnest([1, 2]) AS k, unnest([x1, x2]) AS x, unnest([z1, z2]) AS z FROM f),
xx AS (SELECT a.k, b.k AS j, {_CORR.format('a.z', 'b.z')} AS c FROM l a JOIN l b USING (vec_id) GROUP BY ALL), xy AS (SELECT a.k, b.k AS j, {_CORR.format('a.x', 'b.z')} AS c FROM l a JOIN l b USING (vec_id) GROUP BY ALL)
SELECT 'pca_vaf' AS measure, unnest([1, 2]) AS place, round(100 * unnest([l1, l2]) / (l1 + l2), 6) AS value FROM e
UNION ALL SELECT 'corr_xx', 1, round(sum(abs(c)) / 4, 6) FROM xx UNION ALL SELECT 'corr_xy', k, round(sum(abs(c)) / 2, 6) FROM xy GROUP BY k
UNION ALL SELECT 'mutual_info_xx', 1, 1.0 UNION ALL SELECT 'mutual_info_xy', i::INT, i FROM generate_series(1, 12) g(i)""")
def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_small(spark, sf_dir), "features", "state", 2, 2).select("measure", "place", *r6("value"))


@query(f"WITH {_LONG} SELECT a.k - 1 AS i, b.k - 1 AS j, round(sum(a.x * b.x), 6) AS sij, round(sum(a.x), 6) AS si FROM v a JOIN v b USING (vec_id) GROUP BY a.k, b.k")
def gram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.moments(_frames(spark, sf_dir), "embedding").select("i", "j", *r6("sij", "si"))


_PARTS = f"""{_LONG}, p AS (
  SELECT vec_id, k AS dof, 'pos' AS side, greatest(x, 0) AS part FROM v WHERE k <= 8 UNION ALL SELECT vec_id, k, 'neg', greatest(-x, 0) FROM v WHERE k <= 8)"""


@query(f"""WITH {_PARTS}, c AS (SELECT p.dof, p.side, v.k AS channel, {_CORR.format('p.part', 'v.x')} AS corr FROM p JOIN v USING (vec_id) WHERE v.k > 8 GROUP BY ALL),
r AS (SELECT *, abs(corr) AS size, row_number() OVER (PARTITION BY dof, side ORDER BY abs(corr) DESC, channel) AS rank FROM c WHERE abs(corr) >= 0.05),
f AS (SELECT channel, min((dof, side, rank)) AS place FROM r GROUP BY channel)
SELECT channel, place[1] AS dof, place[2] AS side, place[3]::INT AS rank FROM f ORDER BY place LIMIT 48""")
def signsplit_corr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = select.sign_split(_dofs(spark, sf_dir), ["vec_id"], "dof", "value")
    wide = _frames(spark, sf_dir).select("vec_id", F.posexplode("features").alias("c", "x")).select("vec_id", (F.col("c") + 9).alias("channel"), F.col("x").cast("double").alias("x"))
    pairs = select.channel_correlations(parts.join(wide, "vec_id"), ["dof", "side"], "channel", "part", "x")
    return select.rank_channels(pairs, ["dof", "side"], "channel", F.col("corr"), 0.05, 48)


@query(f"""WITH {_LONG}, e AS (SELECT a.label, count(*) AS n, sum(pow(a.x - b.x, 2)) AS rss FROM v a JOIN v b USING (vec_id, label) WHERE a.k = 1 AND b.k = 9 GROUP BY a.label)
SELECT label, round(6 + n * ln(rss), 6) AS aic, round(6 + n * ln(rss) + 24.0 / (n - 4), 6) AS aicc, round(3 * ln(n) + n * ln(rss), 6) AS bic FROM e""")
def info_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("embedding")[0].cast("double") - F.col("embedding")[8].cast("double")
    sums = _frames(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.pow(error, F.lit(2))).alias("rss"))
    made = sums.select("label", *(f(F.col("n"), F.col("rss"), F.lit(3)).alias(name) for name, f in (("aic", aic), ("aicc", aicc), ("bic", bic))))
    return made.select("label", *r6("aic", "aicc", "bic"))


_CENTRED = "SELECT count(*) AS n, regr_sxx(x1, x1) AS t, regr_sxx(z1, z1) AS a, regr_sxx(z2, z2) AS b, regr_sxy(z1, z2) AS c, regr_sxy(x1, z1) AS u, regr_sxy(x1, z2) AS v FROM f"


@query(f"""WITH {_SMALL}, s AS ({_CENTRED}), r AS (SELECT n, t - u * u / a AS r1, t - (u * u * b - 2 * u * v * c + v * v * a) / (a * b - c * c) AS r2 FROM s)
SELECT unnest([1, 2]) AS n_channels, unnest([8, 9]) AS channel, round(unnest([r1, r2]), 6) AS rss, round(2 * unnest([1, 2]) + n * ln(unnest([r1, r2])), 6) AS value FROM r""")
def information_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.information_scan(_frames(spark, sf_dir), "embedding", 0, [8, 9]).select("n_channels", "channel", *r6("rss", "value"))


def _gram_schmidt(steps: int) -> str:
    out = "c0 AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*) AS v FROM v a JOIN v b USING (vec_id) WHERE a.k <= 16 AND b.k <= 16 GROUP BY ALL)"
    score = lambda c, free: f"SELECT p.j, max(abs(p.v) / sqrt(t.v * d.v)) AS size FROM {c} p JOIN {c} t ON t.i = p.i AND t.j = p.i JOIN {c} d ON d.i = p.j AND d.j = p.j WHERE p.i <= 8 AND p.j > 8 {free} GROUP BY p.j"
    out += f", free AS (SELECT j FROM ({score('c0', '')}) WHERE size >= 0.05)"
    for n in range(1, steps + 1):
        taken = "".join(f" AND p.j <> (SELECT j FROM b{m})" for m in range(1, n))
        out += f", b{n} AS ({score(f'c{n - 1}', 'AND p.j IN (SELECT j FROM free)' + taken)} ORDER BY size DESC LIMIT 1)"
        out += f", c{n} AS (SELECT c.i, c.j, c.v - x.v * y.v / d.v AS v FROM c{n - 1} c CROSS JOIN b{n} b JOIN c{n - 1} x ON x.i = c.i AND x.j = b.j JOIN c{n - 1} y ON y.i = b.j AND y.j = c.j JOIN c{n - 1} d ON d.i = b.j AND d.j = b.j)"
    return out


@query(f"WITH {_LONG}, {_gram_schmidt(4)} " + " UNION ALL ".join(f"SELECT {n} AS step, (j - 9)::INT AS channel, round(size, 6) AS corr FROM b{n}" for n in range(1, 5)))
def gram_schmidt_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir).select(F.slice("embedding", 1, 16).alias("v"))
    return select.gram_schmidt(frames, "v", 8, 4, 0.05).select("step", "channel", *r6("corr"))


@query(f"WITH {_SMALL}, {sqltext.kalman_model('f', 'label', 'vec_id')} " + " UNION ALL ".join(f"SELECT '{n}' AS matrix, {i - 1} AS i, {j - 1} AS j, round({n}{i}{j}, 6) AS value FROM m" for n in "awhq" for i in (1, 2) for j in (1, 2)))
def kalman_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decode.train_decoder("standard", _small(spark, sf_dir), "label", "vec_id", "state", "features", 2)
    rows = [(name, i, j, float(v)) for name in ("a", "w", "h", "q") for i, row in enumerate(getattr(m, name)) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "matrix string, i int, j int, value double").withColumn("value", F.round("value", 6))


KALMAN_SQL = f"WITH RECURSIVE {_SMALL}, {sqltext.kalman_steps('f', 'label', 'vec_id')} SELECT label, vec_id, [round(x1, 6), round(x2, 6)] AS predicted FROM k"


@query(KALMAN_SQL)
def kalman_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _small(spark, sf_dir)
    m = decode.train(frames, "label", "vec_id", "state", "features", 2)
    rows = decode.decode(frames, "label", "vec_id", "features", m)
    return rows.select("label", "vec_id", F.transform("predicted", lambda p: signed_round(p)).alias("predicted"))


@query("""WITH v AS (SELECT label, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
SELECT label, round(list_aggregate(lows, 'sum'), 6) AS low, round(list_aggregate(highs, 'sum'), 6) AS high FROM (
  SELECT label, [a[f] * (1 - (p - f)) + a[least(f + 1, n)] * (p - f)] AS lows, [b[g] * (1 - (q - g)) + b[least(g + 1, n)] * (q - g)] AS highs FROM (
    SELECT *, floor(p)::BIGINT AS f, floor(q)::BIGINT AS g FROM (
      SELECT label, list_sort(list(lo)) AS a, list_sort(list(hi)) AS b, count(*) AS n, greatest(1, least(count(*), 0.05 * count(*) + 0.5)) AS p, greatest(1, least(count(*), 0.95 * count(*) + 0.5)) AS q FROM v GROUP BY label)))""")
def figure_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators import tidy

    return tidy.figure_limits(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", *r6("low", "high"))


@query(f"""WITH {_SMALL}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS row FROM f),
l AS (SELECT label, vec_id, row, unnest([1, 2]) AS line, unnest([x1, x2]) AS x, unnest([z1, z2]) AS z FROM n),
s AS (SELECT *, (z - min(z) OVER w) / nullif(max(z) OVER w - min(z) OVER w, 0) AS scaled FROM l WINDOW w AS (PARTITION BY label, line))
SELECT label, vec_id, 'kinematics' AS panel, line, round(x + line, 6) AS value FROM s WHERE (row - 1) % 5 = 0 UNION ALL SELECT label, vec_id, 'features', line, round(scaled, 6) FROM s WHERE (row - 1) % 5 = 0""")
def figure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators import tidy

    return tidy.figure_rows(_small(spark, sf_dir), "label", "vec_id", "state", "features").select("label", "vec_id", "panel", "line", *r6("value"))


_DOFS = "d AS (SELECT vec_id, label, k AS dof, x AS value FROM (SELECT vec_id, label, unnest(generate_series(1, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE k <= 8)"


@query(f"""WITH {_DOFS} SELECT vec_id, dof::INT AS dof, round(greatest(-1.0, least(1.0, CASE WHEN value >= 0 THEN greatest((value * 3 - 0.2) / 0.8, 0.0) ELSE least((value * 3 + 0.2) / 0.8, 0.0) END)), 6) AS value FROM d""")
def gain_threshold_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dofs(spark, sf_dir).select("vec_id", "dof", F.round(clip_gain(F.col("value"), 3.0), 6).alias("value"))


@query(f"WITH {_DOFS} SELECT vec_id, dof::INT AS dof, round(sign(value) * pow(abs(value), 1.0 / 3), 6) AS root, round((value - min(value) OVER (PARTITION BY dof)) / (max(value) OVER (PARTITION BY dof) - min(value) OVER (PARTITION BY dof)), 6) AS scaled FROM d")
def range_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w, value = Window.partitionBy("dof"), F.col("value")
    rows = _dofs(spark, sf_dir).select("vec_id", "dof", cube_root(value).alias("root"), range_normalise(value, F.min("value").over(w), F.max("value").over(w)).alias("scaled"))
    return rows.select("vec_id", "dof", *r6("root", "scaled"))


_ERRORS = f"""WITH {_LONG}, t AS (SELECT a.vec_id, a.label, a.k AS dof, CASE WHEN abs(a.x) > 0.2 THEN a.x ELSE 0 END AS truth, b.x AS predicted FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.k = a.k + 8 WHERE a.k <= 8)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).select("vec_id", "label", F.posexplode(F.arrays_zip(F.col("state").alias("t"), F.slice("features", 1, 8).alias("p"))).alias("dof", "z"))
    t = F.col("z")["t"].cast("double")
    return rows.select("vec_id", "label", (F.col("dof") + 1).alias("dof"), F.when(F.abs(t) > 0.2, t).otherwise(0.0).alias("truth"), F.col("z")["p"].cast("double").alias("predicted"))


@query(f"{_ERRORS} SELECT label, vec_id % 50 AS win, dof::INT AS dof, round(sqrt(avg(pow(truth - predicted, 2))), 6) AS rmse, sum(truth) <> 0 AS intended FROM t GROUP BY ALL")
def rmse_movement_crosstalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir).withColumn("win", F.col("vec_id") % 50)
    return metrics.movement_errors(rows, ["label", "win"], "dof", "truth", "predicted").select("label", "win", "dof", "intended", *r6("rmse"))


@query(f"{_ERRORS} SELECT dof::INT AS dof, round({_CORR.format('truth', 'predicted')}, 6) AS corr FROM t GROUP BY dof")
def corr_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.diagonal_corr(_errors(spark, sf_dir), ["dof"], "truth", "predicted").select("dof", *r6("corr"))
