"""Decode files, event files, manifests, annotations, listings, and sinks."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("tracelake")

MANIFEST = "job_id int, participant_id string, session_dir string, training_filename string, baseline_filename string, events_filename string, full_stream_filename string"
_SECTIONS = ("features", "kinematics", "targets", "kalman")


def parse_kdf(raw: bytes) -> pd.DataFrame:
    """frame, nip_time, features, kinematics, targets, kalman: five float32 counts,
    then float32 frames; an empty section is null."""
    head = np.frombuffer(raw[:20], "<f4").astype(int)
    width = int(head.sum())
    n = (len(raw) - 20) // (4 * width) if width else 0
    rows = np.frombuffer(raw[20 : 20 + 4 * n * width], "<f4").reshape(n, max(width, 1))[:, :width]
    parts = np.split(rows, np.cumsum(head)[:-1], axis=1)
    listed = [list(p) if p.shape[1] else [None] * n for p in parts]
    time = parts[0][:, 0].astype(float) if parts[0].shape[1] else [None] * n
    return pd.DataFrame(dict(zip(("frame", "nip_time", *_SECTIONS), (np.arange(n), time, *listed[1:]))))


def read_kdf(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, nip_time, and arrays of the four sections; a file at a time in
    hand, as whole as the files are (some megabytes an hour)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                rows = parse_kdf(raw)
                rows.insert(0, "path", name)
                for lo in range(0, len(rows), 8192):
                    yield rows.iloc[lo : lo + 8192]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.kdf").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, frame long, nip_time double, " + ", ".join(f"{s} array<float>" for s in _SECTIONS))


_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def read_kef(spark: SparkSession, path: str) -> DataFrame:
    """Trials of event files: path, targ_on_ts, trial_ts, mvnt_mat.  Records are
    parsed as text and never run; those that lack a field are left out."""
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.input_file_name().alias("path"), "value")
    number = lambda field: F.nullif(F.regexp_extract("value", rf"{field}\s*=\s*\[?\s*({_NUMBER})", 1), F.lit("")).cast("double")
    body = F.nullif(F.regexp_extract("value", r"MvntMat\s*=\s*\[([^\]]*)\]", 1), F.lit(""))
    rows = F.filter(F.split(body, r"\s*;\s*"), lambda r: F.trim(r) != "")
    matrix = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), r"[\s,]+"), lambda v: v.cast("double")))
    found = lines.select("path", number("TargOnTS").alias("targ_on_ts"), number("TrialTS").alias("trial_ts"), matrix.alias("mvnt_mat"))
    return found.dropna()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=MANIFEST)


def annotations(spark: SparkSession, jobs: Mapping[Any, Mapping[str, Any]]) -> DataFrame:
    """job_id, kinematic, type, n_gestures, min_trials from nested annotations."""
    rows: list[tuple] = []
    for job, data in jobs.items():
        found = data.get("kinematics") or {}
        # A job without movements keeps its place.
        rows += [(int(job), None, None, 0, 0)] if not found else []
        for name, info in found.items():
            gestures = info.get("gestures") or {}
            rows.append((int(job), name, info.get("type"), len(gestures), min(gestures.values(), default=0)))
    return spark.createDataFrame(rows, "job_id int, kinematic string, type string, n_gestures int, min_trials int")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A YAML or JSON file, a document of bounded size, read on the driver."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        return annotations(spark, json.loads(text))
    import yaml

    return annotations(spark, yaml.safe_load(text))


def load_config(text: str) -> dict:
    """YAML, of which JSON is a part."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def to_json(config: Mapping) -> str:
    return json.dumps(config, indent=2, sort_keys=False)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, dir of files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"))


def first_per_dir(files: DataFrame) -> DataFrame:
    """The first file of each folder, with a warning flag where there are more."""
    return files.groupBy("dir").agg(F.min("path").alias("path"), (F.count(F.lit(1)) > 1).alias("several"))


def missing_keys(found: DataFrame, required: Sequence[str], file: str = "path", key: str = "key", files: DataFrame | None = None) -> DataFrame:
    """Files that lack one of the required keys, with those they lack; of ``files``,
    a listing, those without any key row too."""
    have = found.groupBy(file).agg(F.collect_set(key).alias("have"))
    if files is not None:
        have = files.select(file).distinct().join(have, file, "left").withColumn("have", F.coalesce("have", F.array().cast(have.schema["have"].dataType)))
    lack = F.array_except(F.array(*map(F.lit, required)), F.col("have"))
    return have.where(F.size(lack) > 0).select(file, lack.alias("missing"))


def missing_report(lacking: DataFrame, file: str = "path") -> DataFrame:
    """One line of text for each file that lacks keys, in order."""
    line = F.concat(F.col(file).cast("string"), F.lit(": lacks "), F.array_join(F.sort_array("missing"), ", "))
    return lacking.select(line.alias("value")).orderBy("value")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, batch: int = 10000) -> DataFrame:
    """Rows of a query of an SQLite file (a catalogue), read by one task in batches;
    the file is opened read-only."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for _ in batches:
            con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            try:
                cursor = con.execute(query)
                while rows := cursor.fetchmany(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
            finally:
                con.close()

    return spark.range(1, numPartitions=1).mapInArrow(run, schema)


def clock_starts(sidecar: DataFrame) -> DataFrame:
    """Start of recording, from the second source where the first has none; null
    (and a flag) where neither has one."""
    return sidecar.withColumn("start", F.coalesce("rec_start", "ss_rec_start")).withColumn("unknown", F.col("start").isNull())


def write_features(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("job_id", "feature_set").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def load_session(spark: SparkSession, path: str, events: bool = True, kinematics: bool = True, features: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a session that are asked for; one that is not there is
    warned of and left out."""
    wanted = {"events": events, "kinematics": kinematics} | {f"features_{f.lower()}": True for f in features}
    out = {}
    for name, use in wanted.items():
        if not use:
            continue
        try:
            out[name] = spark.read.parquet(f"{path}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("%s: %s is not there", path, name)
    return out
