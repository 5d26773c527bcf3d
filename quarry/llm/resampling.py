"""Importance resampling: a target and a raw model of hashed n-grams, and a Gumbel top-k draw.

Target: texts labelled quality 1 and not toxic, at most MAX_TARGET of them. Raw: all texts. Both are bags of hashed words and word pairs with added
counts; a text's log weight is the sum over its n-grams of log target - log raw. Each row's key is its log weight plus
Gumbel noise made from a hash of doc_id and text, and the k largest keys are a draw without replacement in proportion
to the weights. k is the share times the number of rows; by default the share is that of target rows among labelled ones.

The k-th key is found by counting keys in ever finer ranges, so no task sorts or holds all of them. Equal keys at the
boundary come in the order of (doc_id, hash of text); rows equal in both are drawn together. Null and empty texts have
log weight 0. Without labels, or without target rows, all weights are 0 and all rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.model_text import texts

BITS = 18
#: Added to each bucket's raw count, and as much in proportion to its target count.
PRIOR = 20.0
#: Labelled target rows that the target model is counted on, at most (smallest hashes of doc_id); the raw model takes all rows.
MAX_TARGET = 200_000


def ngrams(text: str) -> np.ndarray:
    """Buckets of the words (ASCII letters lower-cased) of a text and of its pairs of neighbours."""
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    b = np.where((b >= 65) & (b <= 90), b | 32, b)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(np.diff(solid) > 1) + 1
    starts = solid[np.concatenate(([0], edge))]
    ends = solid[np.concatenate((edge - 1, [len(solid) - 1]))] + 1
    size = ends - starts
    place = np.arange(len(solid), dtype=np.uint64) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size).astype(np.uint64)
    mixed = (b[solid].astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, np.uint64(len(_POWERS) - 1))]
    h = np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(size)[:-1])))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)
    return (np.concatenate((h, two)) >> np.uint64(64 - BITS)).astype(np.int64)


_POWERS = np.cumprod(np.full(512, 0x5851F42D4C957F2D, dtype=np.uint64) | np.uint64(1))


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log target - log raw by bucket, from all texts. What comes back is two numbers per bucket and partition, summed
    by Spark: at most 2 ** BITS rows reach the driver."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    good = good.where("toxic = 0 AND quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET)
    # At most MAX_TARGET ids: a proven bound for the broadcast, and no text is shuffled.
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("target", F.lit(True))), "doc_id", "left")
    marked = marked.select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch, own in texts(batches):
            for text, of_target in zip(own, batch["target"].to_pylist()):
                f = ngrams(text)
                np.add.at(raw, f, 1)
                if of_target:
                    np.add.at(target, f, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["b", "raw", "target"])

    sums = marked.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = sums.toPandas()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[got["b"].to_numpy(dtype=np.int64)], target[got["b"].to_numpy(dtype=np.int64)] = got["raw"], got["target"]
    if not target.sum():
        return np.zeros(1 << BITS, np.float32)
    overall = target.sum() / raw.sum()  # where little was seen, the two models agree
    return np.log((target + PRIOR * overall) / ((raw + PRIOR) * overall)).astype(np.float32)


def weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), log_weight and key."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch, own in texts(batches):
            w = pa.array([float(r[ngrams(t)].sum(dtype=np.float64)) for t in own], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], w], names=["doc_id", "th", "log_weight"])

    narrow = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    out = narrow.mapInArrow(run, "doc_id long, th long, log_weight double")
    u = (F.pmod(F.xxhash64("doc_id", "th", F.lit(11)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return out.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def boundary(keys: DataFrame, k: int, ranges: int = 1024) -> float:
    """The k-th largest key, by counting in ever finer ranges: each step sends `ranges` counts to the driver."""
    low, high = (float(x) for x in keys.agg(F.min("key"), F.max("key")).first())
    above = 0
    while high > low:
        width = (high - low) / ranges
        if low + width == low:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(ranges - 1))
        got = {r["r"]: (r["n"], r["lo"], r["hi"]) for r in keys.where(F.col("key").between(low, high)).groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for r in sorted(got, reverse=True):
            if above + got[r][0] >= k:
                low, high = got[r][1], got[r][2]
                break
            above += got[r][0]
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key and kept for every row of docs."""
    if share is None:
        one = labels.agg(F.count("*").alias("n"), F.count(F.when((F.col("toxic") == 0) & (F.col("quality") == 1), 1)).alias("good")).first()
        share = one["good"] / one["n"] if one["good"] else 1.0
    keys = written(weighed(docs, log_ratio(docs, labels)), "resampling")
    n = keys.count()
    k = round(n * share)
    if not n or not k:
        return keys.select("doc_id", "log_weight", "key", F.lit(False).alias("kept"))
    edge = boundary(keys, k)
    tied = keys.where(F.col("key") == edge).groupBy("doc_id", "th").count().orderBy("doc_id", "th")
    room = k - keys.where(F.col("key") > edge).count()
    # More than one row at the very same key: repeated rows, or one in 2 ** 40 by chance.
    last = tied.limit(max(1, room)).agg(F.max(F.struct("doc_id", "th")).alias("last")).first()["last"]
    kept = (F.col("key") > edge) | ((F.col("key") == edge) & (F.struct("doc_id", "th") <= F.struct(F.lit(last[0]).cast("long").alias("doc_id"), F.lit(last[1]).alias("th"))))
    return keys.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), F.coalesce(kept, F.lit(True)).alias("kept"))
