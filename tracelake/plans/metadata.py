"""Metadata and chart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.columns import clean_path, swap_extension, tail
from tracelake.operators import catalog, tidy
from tracelake.plans.base import micros, query, r6, table

_HAVE = "h AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {_HAVE} SELECT l_orderkey, unnest(CASE WHEN len(c) > 0 THEN c ELSE ['OTHER'] END) AS category FROM (
  SELECT l_orderkey, list_filter([CASE WHEN list_has_all(have, [1, 2, 3, 6]) THEN 'WIDE' END, CASE WHEN list_has_any(have, [1, 2]) AND list_contains(have, 5) THEN 'WRIST' END,
    CASE WHEN list_has_any(have, [1, 2, 3]) THEN 'FINGER' END], lambda x: x IS NOT NULL) AS c FROM h)""")
def category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    rules = {
        "WIDE": catalog.needs(1, 2, 3, 6), "WRIST": catalog.any_of(1, 2) & F.array_contains("__have", 5), "FINGER": catalog.any_of(1, 2, 3),
    }
    return catalog.categories(sets, F.col("have"), rules).select("l_orderkey", "category")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN 'combined' ELSE 'independent' END AS kind, count(DISTINCT l_returnflag) AS n, min(l_quantity)::BIGINT AS trials FROM lineitem GROUP BY ALL)
SELECT kind, count(*) FILTER (WHERE n < 2) AS uni, count(*) FILTER (WHERE n >= 2) AS bi, coalesce(sum(trials) FILTER (WHERE n < 2), 0)::BIGINT AS uni_trials, coalesce(sum(trials) FILTER (WHERE n >= 2), 0)::BIGINT AS bi_trials FROM k GROUP BY kind""")
def dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") <= 4, "combined").otherwise("independent")
    entries = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", kind.alias("kind")).agg(
        F.count_distinct("l_returnflag").alias("n"), F.min("l_quantity").cast("long").alias("trials")
    )
    return catalog.direction_counts(entries, "kind", "n", "trials")


@query("""SELECT n_name, count(*) AS count, 'BUILDING' AS category FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name
UNION ALL SELECT n_name, count(*), 'MACHINERY' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' GROUP BY n_name""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [catalog.counts(people.where(F.col("c_mktsegment") == s), "n_name", s) for s in ("BUILDING", "MACHINERY")]
    return parts[0].unionByName(parts[1]).orderBy("category", "n_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job with every feature set: both are short lists by their nature."""
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(table(spark, sf_dir, "region").select("r_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(wanted, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").where("c_custkey = 7")
    return one.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", "n_name")


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 30")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "supplier").where("s_suppkey < 30").select(F.col("s_nationkey").alias("nation"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct().join(seen, "nation", "left_anti")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return nations.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query(r"""SELECT page_id, trim(replace(replace(url, '://', '\'), '\', '/'), '/') AS path, right(url, 15) AS tail, regexp_replace(url, '\.kdf$', '.kef') AS events FROM pages""")
def path_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    raw = F.replace(url, F.lit("://"), F.lit("\\"))
    return table(spark, sf_dir, "pages").select("page_id", clean_path(raw).alias("path"), tail(url).alias("tail"), swap_extension(url, "kdf", "kef").alias("events"))


@query("""SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS most FROM documents""")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.size_stats(table(spark, sf_dir, "documents"), "n_chars")
    return rows.select("n", "most", *r6("mean", "median", "p05", "p95"))


@query("""WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT least(floor((n_chars - lo) * 12.0 / (hi - lo)), 11)::BIGINT + 1 AS bin, count(*) AS count FROM documents, s GROUP BY bin""")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(table(spark, sf_dir, "documents"), "n_chars")


_WIDE = """w AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, value AS kinematics_1, value - 40 AS kinematics_2, value * 2 AS neural_1, -value AS neural_2 FROM events),
b AS (SELECT *, floor(t / greatest((max(t) OVER () - min(t) OVER ()) / 660, 1)) AS bin FROM w),
m AS (SELECT avg(t) AS t, avg(kinematics_1) AS kinematics_1, avg(kinematics_2) AS kinematics_2, avg(neural_1) AS neural_1, avg(neural_2) AS neural_2, bin FROM b GROUP BY bin),
l AS (UNPIVOT (SELECT t, kinematics_1, kinematics_2, neural_1, neural_2 FROM m) ON kinematics_1, kinematics_2, neural_1, neural_2 INTO NAME feature_id VALUE value),
n AS (SELECT t, feature_id, split_part(feature_id, '_', 1) AS feature_type, value, min(value) OVER (PARTITION BY feature_id) AS lo, max(value) OVER (PARTITION BY feature_id) AS hi FROM l),
z AS (SELECT t, feature_id, feature_type, CASE WHEN feature_type = 'kinematics' THEN value WHEN hi = lo OR hi < 0 THEN 0 ELSE (value - lo) / (hi - lo) * sqrt(hi) END AS value FROM n)"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = micros(table(spark, sf_dir, "events"))
    value = F.col("value")
    return events.select(
        "user_id", (F.col("us") / 1000000.0).cast("double").alias("t"), value.alias("kinematics_1"), (value - 40).alias("kinematics_2"), (value * 2).alias("neural_1"), (-value).alias("neural_2")
    )


def _tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.tidy(_wide(spark, sf_dir), "t", ["kinematics_1", "kinematics_2"], ["neural_1", "neural_2"])


@query(f"WITH {_WIDE} SELECT bin::BIGINT AS bin, round(t, 3) AS t, round(neural_1, 6) AS neural_1 FROM m")
def bin_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.binned(_wide(spark, sf_dir), "t", ["neural_1"]).select("bin", F.round("t", 3).alias("t"), *r6("neural_1"))


@query("""SELECT event_id, feature_id, split_part(feature_id, '_', 1) AS feature_type, value FROM (
  UNPIVOT (SELECT event_id, value AS kinematics_1, value * 2 AS neural_10 FROM events) ON kinematics_1, neural_10 INTO NAME feature_id VALUE value)""")
def unpivot_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("kinematics_1"), (F.col("value") * 2).alias("neural_10"))
    return tidy.long_form(rows, ["event_id"], ["kinematics_1", "neural_10"])


@query("""SELECT user_id, event_id, round((value - lo) / (hi - lo) * sqrt(hi), 6) AS value FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.normalised(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"]).select("user_id", "event_id", *r6("value"))


@query(f"WITH {_WIDE} SELECT round(t, 3) AS t, feature_id, feature_type, round(value, 6) AS value FROM z")
def tidy_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(spark, sf_dir).select(F.round("t", 3).alias("t"), "feature_id", "feature_type", *r6("value"))


@query(f"WITH {_WIDE} SELECT round(t, 3) AS t, feature_id, split_part(feature_id, '_', 2)::INT AS dof, round(value + split_part(feature_id, '_', 2)::INT * 1.75, 6) AS stacked FROM z WHERE feature_type = 'kinematics'")
def line_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.lines(_tidy(spark, sf_dir)).select(F.round("t", 3).alias("t"), "feature_id", "dof", *r6("stacked"))


@query(f"WITH {_WIDE} SELECT round(t, 3) AS t, feature_id, round(value, 6) AS value FROM z WHERE feature_id IN ('neural_1')")
def raster_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.raster(_tidy(spark, sf_dir), ["neural_1"]).select(F.round("t", 3).alias("t"), "feature_id", *r6("value"))


@query("SELECT DISTINCT user_id FROM events ORDER BY md5(concat_ws('|', user_id, 42)), user_id LIMIT 64")
def channel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.sampled(table(spark, sf_dir, "events"), "user_id", 64)
