"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most
``d`` of their eight bytes, so they share at least ``8 - d`` positional bytes.
For d = 2 the eight byte positions are taken as four neighbouring pairs; at
least two of the pairs agree, so the posting lists are those of the six
combinations of two pairs, that is of four positional bytes each.  Within a
posting the shared positional bytes of each pair of fingerprints are tallied,
pairs below the guaranteed minimum are dropped, and the rest are verified by
the bits that differ.  A pair is tallied in the first posting it shares only.

A posting longer than ``long_posting`` (a large group of near copies) is not
paired.  Its fingerprints go an exact way of linear size: each is listed under
itself and its 64 one-bit variants, and all that meet under one variant are
linked to the least of them.  Two fingerprints differ in at most two bits
exactly when they share such a variant, so nothing is lost and nothing wrong
is linked.

Only distinct fingerprints are indexed; copies are combined first.

Defined results: null text is an empty text; a text without words has
fingerprint zero and is linked like any other; a null ``doc_id`` keeps its row
and never is a ``component_id`` while the component has another id; repeated
rows share their component; other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import append_arrow, bounded_batches, connected_components, fresh, map_arrow, materialize

SHINGLE = 3
MAX_BITS = 2
LONG_POSTING = 64
_PAIRS = 4
_SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the hashes of the shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = [digest(b" ".join(words), _SEED)]
    else:
        line = b" ".join(words)
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        values = [digest(line[a : b - 1], _SEED) for a, b in zip(starts, starts[shingle:])]
    return _majority(np.array(values, np.uint64))


def _majority(values: np.ndarray) -> int:
    # In slices, so that a very long text needs no more memory than a short one.
    n = len(values)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        bits = np.unpackbits(values[lo : lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed bigint."""
    bounded_batches(docs.sparkSession)

    def run(doc_id: pa.Array, text: pa.Array) -> dict:
        values = np.array([fingerprint(t or "", shingle) for t in text.to_pylist()], np.uint64)
        return {"doc_id": doc_id, "fp": pa.array(values.view(np.int64))}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _byte(c: str, i: int) -> Column:
    return F.shiftrightunsigned(c, 8 * (7 - i)).bitwiseAND(F.lit(0xFF))


def _two_bytes(c: str, i: int) -> Column:
    return F.shiftrightunsigned(c, 16 * (_PAIRS - 1 - i)).bitwiseAND(F.lit(0xFFFF))


def links(prints: DataFrame, long_posting: int = LONG_POSTING) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect
    everything within ``MAX_BITS`` differing bits."""
    combos = list(combinations(range(_PAIRS), 2))
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 32)
        .bitwiseOR(F.shiftleft(_two_bytes("fp", i), 16))
        .bitwiseOR(_two_bytes("fp", j))
        for n, (i, j) in enumerate(combos)
    ]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    lengths = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = postings.join(lengths, "key")
    short = postings.where(F.col("n") <= long_posting).select("key", "fp")

    same = [_two_bytes("a", i) == _two_bytes("b", i) for i in range(_PAIRS)]
    first = F.lit(len(combos))
    for n, (i, j) in reversed(list(enumerate(combos))):
        first = F.when(same[i] & same[j], F.lit(n)).otherwise(first)
    tally = sum((_byte("a", i) == _byte("b", i)).cast("int") for i in range(8))
    pairs = (
        short.withColumnRenamed("fp", "a")
        .join(short.withColumnRenamed("fp", "b"), "key")
        .where("a < b")
        # Bytes shared, then the first posting the pair shares, then the bits.
        .where(tally >= 8 - MAX_BITS)
        .where(F.shiftrightunsigned("key", 32) == first)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )

    crowd = postings.where(F.col("n") > long_posting).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    heads = near.groupBy("variant").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(heads, "variant").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def _classes(marked: DataFrame, best: Column, long_posting: int) -> DataFrame:
    """fp, root, best: the least ``best`` of the rows of all linked fingerprints."""
    prints = marked.groupBy("fp").agg(F.min(best).alias("own"))
    found = connected_components(links(prints.select("fp"), long_posting))
    rooted = prints.join(found.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("own").alias("best"))
    return rooted.join(least, "root").select("fp", "root", "best")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, long_posting: int = LONG_POSTING) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fp bigint, fingerprint (hex),
    component_id, the least doc_id that links reach."""
    marked = materialize(fingerprints(docs, shingle))
    named = _classes(marked, F.col("doc_id"), long_posting).select("fp", F.col("best").alias("component_id"))
    return marked.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, long_posting: int = LONG_POSTING) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the
    least doc_id, then of the least text hash; null ids come last."""
    bounded_batches(docs.sparkSession)

    def run(text: pa.Array) -> dict:
        values = np.array([fingerprint(t or "", shingle) for t in text.to_pylist()], np.uint64)
        return {"fp": pa.array(values.view(np.int64))}

    doc_id = F.col("doc_id").cast("long")
    key = [doc_id.isNull().alias("k0"), F.coalesce(doc_id, F.lit(0)).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")]
    marked = materialize(append_arrow(docs.select(*key, "text"), ["text"], run, "fp long").drop("text"))
    kept = _classes(marked, F.struct("k0", "k1", "k2"), long_posting).select("best.*").distinct()
    names = fresh("key", 3, docs.columns)
    kept = kept.toDF(*names)
    return docs.withColumns(dict(zip(names, key))).join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
