"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: the target's over a bounded
sample of documents labelled good, the raw text's over all documents. A document's
log importance weight is the sum of log(target / raw) over its n-grams, brought to
one common length, as the sums of long and short texts do not compare. Gumbel
top-k draws the share of documents that the labels call good, without replacement
and in proportion to the weights: each weight gets Gumbel noise, made from the
document's id and text, and the k largest stay.

N-grams are words, pairs of neighbours and the words' shapes (capital, small,
digit, sign). A pair of equal words is one n-gram whatever the word.

Counting and scoring each read a document once and keep BUCKETS numbers per task;
counts of tasks are added by Spark, and what reaches the driver is two numbers per
bucket. The k-th largest weight is found by histograms, without a sort.

Defined results. A null or empty text has no n-grams and weight 0. Labels without a
document, null labels and repeated labels are harmless; without any good label
every document is kept. Rows alike in id and text share their noise; rows without an
id, or that share one, are drawn by their texts. Documents that tie at the cut are all
kept. Very long texts are counted and scored whole. An empty table gives no rows.
Columns named like one of the three added ones are replaced; any other name passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tenure.llm.columns import arrow_batch, bytes_of, saved, text_key, uniform
from tenure.llm.selection import cut_points

BUCKETS = 1 << 14
#: Good documents the target model is fitted on, at most.
TARGET_SAMPLE = 20_000
SMOOTHING = 1.0
#: A text's weight is that of so many n-grams of its kind; a text counts as so many more
#: n-grams of no weight, which holds very short ones near zero.
COMMON_LENGTH, PRIOR_LENGTH = 100.0, 30.0
SEED = 11

_PAIR, _SHAPE, _REPEAT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0x2545F491)


def _shape_table() -> bytes:
    kinds = bytearray(b"a" * 256)
    for i in range(128):
        c = chr(i)
        kinds[i] = ord("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c)
    return bytes(kinds)


_SHAPES = _shape_table()


def ngram_buckets(text: bytes) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint32)
    n = len(words)
    word = np.fromiter(map(crc32, words), np.uint32, n)
    shape = np.fromiter(map(crc32, text.translate(_SHAPES).split()), np.uint32, n)
    left, right = word[:-1], word[1:]
    pair = np.where(left == right, _REPEAT, left * _PAIR + right)
    found = np.concatenate([word, pair, shape * _SHAPE])
    found ^= found >> np.uint32(15)
    found *= np.uint32(0x2C1B3C6D)
    found ^= found >> np.uint32(13)
    return found % np.uint32(BUCKETS)


_COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(bytes_of(batch, "text"), batch.column("good").to_pylist(), strict=True):
            one = np.bincount(ngram_buckets(text), minlength=BUCKETS) if text else 0
            raw += one
            if good:
                target += one
    kept = np.flatnonzero(raw)
    yield arrow_batch({"bucket": kept, "target": target[kept], "raw": raw[kept]}, _COUNTS)


def good_sample(labels: DataFrame, id_col: str, label_col: str, size: int) -> DataFrame:
    """Ids of up to ``size`` documents labelled good, chosen by a hash of the id."""
    return (
        labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_labelled"))
        .distinct()
        .orderBy(F.xxhash64("_labelled", F.lit(SEED)), "_labelled")
        .limit(size)
    )


def log_ratios(
    documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    sample: int = TARGET_SAMPLE,
) -> np.ndarray:
    """log(target / raw) per bucket, or zeros if nothing is labelled good."""
    good = F.broadcast(good_sample(labels, id_col, label_col, sample))
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    flagged = rows.join(good, F.col("_id") == F.col("_labelled"), "left").select(
        "text", F.col("_labelled").isNotNull().alias("good")
    )
    counts = (
        flagged.mapInArrow(_count, "bucket int, target long, raw long")
        .groupBy("bucket")
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, t, r in counts.collect():
        target[bucket], raw[bucket] = t, r
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def scorer(ratios: np.ndarray):
    """A column function: the log importance weight of a text."""
    sent = ratios

    def one(text: bytes | None) -> float:
        found = sent[ngram_buckets(text or b"")]
        return COMMON_LENGTH * float(found.sum()) / (len(found) + PRIOR_LENGTH)

    @F.arrow_udf(DoubleType())
    def weight(texts: pa.Array) -> pa.Array:
        plain = texts.cast(pa.large_binary()).to_pylist()
        return pa.array(map(one, plain), pa.float64())

    return weight


def gumbel(id_col: str, text_col: str):
    return -F.log(-F.log(uniform(id_col, text_key(F.col(text_col)), seed=SEED)))


def classify(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """The documents with ``log_weight``, ``gumbel_score`` and ``kept``."""
    ratios = log_ratios(documents, labels, id_col, text_col, label_col)
    weighed = documents.withColumn("log_weight", scorer(ratios)(F.col(text_col)))
    scored = weighed.withColumn("gumbel_score", F.col("log_weight") + gumbel(id_col, text_col))
    share = labels.filter(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    if not ratios.any() or share is None:
        return scored.withColumn("kept", F.lit(True))
    # Loss rank: the best score first, so that rows below the cut are the ones kept.
    ranks = saved(scored.select(F.lit(0).alias("_all"), (-F.col("gumbel_score")).alias("_rank"), F.lit(1).alias("_one")))
    keep = math.ceil(share * ranks.count())
    budget = ranks.sparkSession.createDataFrame([(0, float(keep - 1))], "_all int, budget double")
    found = cut_points(ranks, "_all", "_rank", "_one", budget).first()
    cut = found["cut"] if found else math.inf
    return scored.withColumn("kept", -F.col("gumbel_score") <= F.lit(cut))
