"""Trial queries: orders are trials, their lines are samples (degree of freedom:
line number, signed value from the discount)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.columns import flex_extend, movement_code
from tracelake.operators import trials
from tracelake.plans.base import query, r6, table

_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "value"]
_LINES = "x AS (SELECT *, round((l_discount - 0.05) * 20, 6) AS value FROM lineitem)"
_PEAKS = f"""{_LINES},
k AS (SELECT l_orderkey, l_linenumber, first(value ORDER BY -abs(value), l_shipdate, l_partkey, l_suppkey, l_extendedprice, value) AS peak, max(abs(value)) AS size FROM x GROUP BY ALL)"""
_GESTURES = f"""{_PEAKS},
n AS (SELECT l_orderkey, count(*) AS n_active, array_to_string(list_sort(list('dof_' || l_linenumber || CASE WHEN peak > 0 THEN '_pos' ELSE '_neg' END)), '-') AS names FROM k WHERE size > 0.1 GROUP BY l_orderkey),
gestures AS (SELECT l_orderkey, n_active > 1 AS is_combined, CASE WHEN n_active > 1 THEN 'combo_' || names ELSE names END AS gesture_id FROM n)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    return rows.withColumn("value", F.round((F.col("l_discount") - 0.05) * 20, 6))


def _gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.gestures(_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", "value", _ORDER)


@query(f"WITH {_PEAKS} SELECT l_orderkey, l_linenumber, peak, size FROM k")
def signed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.peaks(_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", "value", _ORDER)


@query(f"WITH {_GESTURES} SELECT l_orderkey, is_combined, gesture_id FROM gestures")
def gesture_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gestures(spark, sf_dir)


_SPLIT = f"""WITH {_GESTURES},
p AS (SELECT l_orderkey, gesture_id, count(*) OVER (PARTITION BY gesture_id) AS n, row_number() OVER (PARTITION BY gesture_id ORDER BY l_orderkey) AS place FROM gestures WHERE NOT is_combined)
SELECT l_orderkey, gesture_id, CASE WHEN {{}} THEN 'train' ELSE 'test' END AS set FROM p WHERE n >= 2"""


def _split(spark: SparkSession, sf_dir: str, ratio: float, mode: str, half_even: bool = True) -> DataFrame:
    single = _gestures(spark, sf_dir).where("not is_combined")
    return trials.split(single, "gesture_id", ["l_orderkey"], ratio, mode, half_even=half_even).select("l_orderkey", "gesture_id", "set")


@query(_SPLIT.format("place <= round_even(n * 0.75, 0)"))
def split_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 0.75, "train_first")


@query(_SPLIT.format("place > n - round_even(n * 0.5, 0)"))
def split_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 0.5, "train_last")


@query(_SPLIT.format("place <= floor(n * 0.75)"))
def split_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 0.75, "train_first", half_even=False)


@query(f"""WITH {_GESTURES},
p AS (SELECT l_orderkey, gesture_id, count(*) OVER (PARTITION BY gesture_id) AS n, row_number() OVER (PARTITION BY gesture_id ORDER BY md5(concat_ws('|', l_orderkey, 2025)), l_orderkey) AS place FROM gestures WHERE NOT is_combined)
SELECT l_orderkey, gesture_id, CASE WHEN place <= round_even(n * 0.75, 0) THEN 'train' ELSE 'test' END AS set FROM p WHERE n >= 2""")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 0.75, "train_random")


@query("""WITH t AS (SELECT o_custkey, o_orderkey AS start, o_orderkey + o_custkey % 7 + 1 AS stop FROM orders)
SELECT o_custkey, start, stop, relative AS relative_start_idx, relative + stop - start AS relative_stop_idx FROM (
  SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS relative FROM t)""")
def trial_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 7 + 1).alias("stop"))
    return trials.trial_info(rows, ["o_custkey"], "start", "stop")


@query("SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS start FROM orders")
def trial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.windows_from_ends(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS trial FROM orders WHERE o_orderstatus <> 'P'),
e AS (SELECT o_custkey, o_orderkey AS stop, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS trial FROM orders WHERE o_orderpriority >= '3')
SELECT o_custkey, trial::INT AS trial, start, stop FROM s JOIN e USING (o_custkey, trial) WHERE start < stop AND stop < 14000""")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    starts = orders.where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").alias("start"), F.lit(14000).alias("n"))
    stops = orders.where("o_orderpriority >= '3'").select("o_custkey", F.col("o_orderkey").alias("stop"))
    return trials.valid_trials(starts, stops, "o_custkey", "start", "stop", "n").select("o_custkey", "trial", "start", "stop")


_WIDE = f"""{_LINES}, a AS (SELECT l_orderkey, {', '.join(f'coalesce(round(sum(value) FILTER (WHERE l_linenumber = {d}), 6), 0) AS a{d}' for d in range(1, 8))} FROM x GROUP BY l_orderkey)"""


def _amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = [F.coalesce(F.round(F.sum(F.when(F.col("l_linenumber") == d, F.col("value"))), 6), F.lit(0.0)) for d in range(1, 8)]
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array(*wide).alias("amps"))


@query(f"""WITH {_WIDE} SELECT l_orderkey, array_to_string(list_filter([{', '.join(f'sign(a{d})::INT * {d}' for d in range(1, 8))}], lambda c: c <> 0), ',') AS code,
  {' + '.join(f'(a{d} > 0)::INT' for d in range(1, 8))} AS n_flex FROM a""")
def movement_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _amplitudes(spark, sf_dir)
    return rows.select(
        "l_orderkey", F.array_join(movement_code(F.col("amps")).cast("array<string>"), ",").alias("code"),
        F.size(F.filter(flex_extend(F.col("amps")), lambda f: f[0])).alias("n_flex"),
    )


_MOVING = ", ".join(f"CASE WHEN a{d} <> 0 THEN {d} END" for d in range(1, 8))


@query(f"""WITH {_WIDE}, m AS (SELECT *, coalesce({_MOVING}) AS first_dof, {' + '.join(f'(a{d} <> 0)::INT' for d in range(1, 8))} AS n, {' + '.join(f'abs(a{d})' for d in range(1, 8))} AS total FROM a)
SELECT l_orderkey, round(total, 6) AS mvnt_count FROM m WHERE total <= 1 AND first_dof IN (1, 2, 4, 6) AND NOT (first_dof = 4 AND a4 < 0)""")
def downselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trials.eligible(_amplitudes(spark, sf_dir), "amps", [1, 2, 4, 6], False, [1.0] * 7, [1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0])
    return found.select("l_orderkey", *r6("mvnt_count"))


# Orders are trials of a job (customers by tens), their priority is the movement.
_JOBS = """t AS (SELECT o_custkey % 10 AS job, o_orderkey AS stop, CASE o_orderpriority[1] WHEN '1' THEN [1, -2] WHEN '2' THEN [2] WHEN '3' THEN [-2] WHEN '4' THEN [3, 4] ELSE [5] END AS code FROM orders),
n AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY job ORDER BY stop) AS start, row_number() OVER (PARTITION BY job, code ORDER BY {order} stop) AS pos, count(*) OVER (PARTITION BY job, code) AS n FROM t),
s AS (SELECT job, stop, code, start, pos, CASE WHEN {train} AND ({train_combos} OR len(code) = 1) THEN 'train' WHEN {test_combos} OR len(code) = 1 THEN 'test' END AS set FROM n),
f AS (SELECT c_custkey % 10 AS job, c_custkey * 10 + 1 AS at FROM customer)"""
_FIRST = _JOBS.format(order="", train="pos <= floor(n * 0.7)", train_combos="false", test_combos="true")
_STEP = 100.0


def _job_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    code = F.when(kind == "1", F.array(F.lit(1), F.lit(-2))).when(kind == "2", F.array(F.lit(2))).when(kind == "3", F.array(F.lit(-2))).when(kind == "4", F.array(F.lit(3), F.lit(4))).otherwise(F.array(F.lit(5)))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("job"), F.col("o_orderkey").alias("stop"), code.alias("code"))


def _job_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("job"), (F.col("c_custkey") * 10 + 1).alias("at"), "c_acctbal", "c_nationkey")


def _split_jobs(spark: SparkSession, sf_dir: str, mode: str = "first", percent: float = 0.7, train_combos: bool = False, test_combos: bool = True) -> DataFrame:
    return trials.split_movements(_job_trials(spark, sf_dir), "job", "code", "stop", percent, mode, train_combos, test_combos)


@query(f"WITH {_FIRST} SELECT job, stop, start, pos::INT AS pos, set FROM s WHERE set IS NOT NULL")
def split_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_jobs(spark, sf_dir).select("job", "stop", "start", "pos", "set")


@query(f"""WITH {_JOBS.format(order="md5(concat_ws('|', job, stop, 2025)),", train="pos <= floor(n * 0.5)", train_combos="true", test_combos="false")} SELECT job, stop, start, pos::INT AS pos, set FROM s WHERE set IS NOT NULL""")
def split_movements_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_jobs(spark, sf_dir, "shuffle", 0.5, True, False).select("job", "stop", "start", "pos", "set")


@query(f"WITH {_FIRST} SELECT f.job, f.at, bool_or(set = 'train') AS train, bool_or(set = 'test') AS test FROM f JOIN s ON s.job = f.job AND f.at BETWEEN start AND stop WHERE set IS NOT NULL GROUP BY ALL")
def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.frame_sets(_job_frames(spark, sf_dir), _split_jobs(spark, sf_dir), "job", "at", "stop", _STEP)


@query(f"""WITH {_FIRST}, z AS (SELECT s.job, s.stop, s.pos, min(s.stop) OVER (PARTITION BY s.job, s.code) AS first, s.set, (SELECT count(*) FROM f WHERE f.job = s.job AND f.at BETWEEN s.start AND s.stop) AS size FROM s WHERE set IS NOT NULL),
c AS (SELECT job, stop, size, sum(size) OVER (PARTITION BY job ORDER BY first, pos)::BIGINT AS relative_stop FROM z WHERE set = 'test')
SELECT job, stop, relative_stop - size + 1 AS relative_start, relative_stop FROM c""")
def split_test_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.test_ranges(_job_frames(spark, sf_dir), _split_jobs(spark, sf_dir), "job", "at", "code", "stop", _STEP)


@query(f"""WITH {_FIRST}, g AS (SELECT c_custkey % 10 AS job, c_custkey * 10 + 1 AS at, c_acctbal AS a, c_nationkey AS b FROM customer), e AS (SELECT job, start, stop FROM s WHERE code[1] IN (1, 2, 5) AND len(code) = 1)
SELECT g.job, row_number() OVER (PARTITION BY g.job ORDER BY e.stop, e.start, g.at)::INT AS place, e.stop, g.at, a AS dof FROM g JOIN e ON e.job = g.job AND g.at BETWEEN e.start AND e.stop""")
def down_selected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _split_jobs(spark, sf_dir).where(F.col("code")[0].isin(1, 2, 5) & (F.size("code") == 1))
    frames = _job_frames(spark, sf_dir).select("job", "at", F.array("c_acctbal", F.lit(0.0)).alias("kin"), F.array(F.col("c_nationkey").cast("double")).alias("feat"))
    rows = trials.down_select(frames, own, "job", "at", "start", "stop", [1], "kin", "feat", _STEP)
    return rows.select("job", "place", "stop", "at", F.col("kin")[0].alias("dof"))


@query(f"""WITH {_JOBS.format(order="", train="pos <= floor(n * 0.7)", train_combos="false", test_combos="true")}, g AS (SELECT c_custkey % 10 AS job, sum(c_acctbal) AS a, sum(c_nationkey) AS b FROM customer GROUP BY ALL)
SELECT job, list_filter([CASE WHEN a <> 0 THEN 1 END, CASE WHEN b <> 0 THEN 2 END], x -> x IS NOT NULL) AS active FROM g""".replace("x -> x", "lambda x: x"))
def active_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _job_frames(spark, sf_dir).select("job", F.array("c_acctbal", F.col("c_nationkey").cast("double"), F.lit(0.0)).alias("kin"))
    return trials.active_dofs(frames, "job", "kin")
