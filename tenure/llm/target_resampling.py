"""Importance resampling towards a target distribution, with prefix CRCs.

A text is normalised to its words with one separator between them. One scan stores
the running CRC after each word; the CRC of any run of words is then the running
CRC at its end less that at its start, shifted over the run's bytes: in GF(2)
arithmetic ``crc(run) = crc(upto end) xor shift(crc(upto start), bytes of run)``.
So all runs of up to ``max_words`` words cost one scan, whatever their length.

A run's bucket is its CRC modulo ``buckets``. Counts of the documents and of the
target per bucket, added by Spark, give each bucket a gain in thousandths of a nat;
a document's weight is the sum over its runs, and Gumbel noise from its id turns the
top scores into a draw without replacement in proportion to the weights. Ranks come
from a distributed sort: rows know their place in a sorted partition, and the only
thing that reaches the driver is one count per partition.

Defined results. A null or empty text has no words, weight 0 and a score. Very long
texts are scanned whole. Ties in score go to the smaller id, null ids last; repeated
rows share their noise and each take a rank. A null id has the noise of an empty
one. Tables without rows give no rows; an empty target gives the gains of smoothing
alone. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.columns import arrow_batch, bytes_of, saved

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of text whose words are worked on at once, or a single longer text.
SLICE_BYTES = 1 << 20

_POLYNOMIAL = 0xEDB88320
_SEPARATOR = b" "
_PIECE = re.compile(rb" ?[^ ]+")


def _letters() -> bytes:
    """Each byte's normal form: A-Z lowered, a separator for what is no letter or digit."""
    kept = (string.ascii_lowercase + string.digits).encode()
    table = bytearray(b if b >= 0x80 or b in kept else _SEPARATOR[0] for b in range(256))
    for upper, lower in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True):
        table[ord(upper)] = ord(lower)
    return bytes(table)


_NORMAL = _letters()


def _shift_tables(powers: int = 40) -> np.ndarray:
    """``[b, k, v]``: byte ``v`` at place ``k`` of a CRC, shifted over 2**b zero bytes."""
    images = []  # of each bit, under a shift over one byte
    for bit in range(32):
        value = 1 << bit
        for _ in range(8):
            value = (value >> 1) ^ (_POLYNOMIAL if value & 1 else 0)
        images.append(value)
    tables = np.zeros((powers, 4, 256), np.uint32)
    for power in range(powers):
        for place in range(4):
            for v in range(256):
                for bit in range(8):
                    if v >> bit & 1:
                        tables[power, place, v] ^= np.uint32(images[8 * place + bit])
        images = [int(x) for x in _apply(tables[power], np.array(images, np.uint32))]
    return tables


def _apply(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return (
        table[0][crcs & 255]
        ^ table[1][crcs >> 8 & 255]
        ^ table[2][crcs >> 16 & 255]
        ^ table[3][crcs >> 24]
    )


_SHIFTS = _shift_tables()


def shifted(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each CRC, shifted over so many zero bytes."""
    found = crcs.copy()
    for power in range(int(sizes.max(initial=0)).bit_length()):
        rows = np.flatnonzero(sizes >> power & 1)
        found[rows] = _apply(_SHIFTS[power], found[rows])
    return found


class Words:
    """The words of some texts: their document, size and the running CRC at their end."""

    def __init__(self, texts: list[bytes]):
        words = [t.translate(_NORMAL).split() for t in texts]
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        n = int(self.counts.sum())
        self.sizes = np.fromiter((len(w) for found in words for w in found), np.int64, n)
        self.ends = np.fromiter(
            (crc for found in words for crc in running_crcs(_SEPARATOR.join(found))), np.uint32, n
        )
        self.document = np.repeat(np.arange(len(texts)), self.counts)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The CRC of every run of so many words, and its document."""
        n = len(self.ends)
        at = np.arange(max(n - length + 1, 0))
        at = at[self.document[at] == self.document[at + length - 1]]
        after = np.r_[np.uint32(0), _apply(_SHIFTS[0], self.ends[:-1]) ^ np.uint32(crc32(_SEPARATOR))]
        first = np.r_[True, self.document[1:] != self.document[:-1]]
        starts = np.where(first, np.uint32(0), after[:n])[at] if n else self.ends[:0]
        upto = np.r_[0, np.cumsum(self.sizes + 1)]
        span = upto[at + length] - upto[at] - 1
        return self.ends[at + length - 1] ^ shifted(starts, span), self.document[at]

    def features(self, max_words: int) -> tuple[np.ndarray, np.ndarray]:
        found = [self.runs(length) for length in range(1, max_words + 1)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def running_crcs(normalised: bytes) -> Iterator[int]:
    """The CRC of the text up to the end of each word, in one scan."""
    found = accumulate(_PIECE.findall(normalised), lambda crc, piece: crc32(piece, crc), initial=0)
    next(found)
    return found


def sliced(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def bucket_counts(
    texts: DataFrame, text_col: str, max_words: int, buckets: int = BUCKETS
) -> np.ndarray:
    """How many runs of all texts fall into each bucket; one row per task and bucket is added up."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in sliced(bytes_of(batch, "text")):
                crcs, _ = Words(part).features(max_words)
                found += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(found)
        yield arrow_batch({"bucket": hit, "n": found[hit]}, schema)

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a run of each bucket adds to a weight, in whole thousandths, rounded down."""
    n = float(len(documents))
    s, t = documents.astype(float), target.astype(float)
    ratio = (t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(
    documents: DataFrame, gain: np.ndarray, id_col: str, text_col: str, max_words: int
) -> DataFrame:
    """``id, n_words, n_features, weight`` of every document."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for part in sliced(bytes_of(batch, "text")):
                words = Words(part)
                crcs, document = words.features(max_words)
                worth = gain[crcs % np.uint32(len(gain))]
                # Whole numbers below 2**53, which doubles add exactly.
                sums = np.bincount(document, weights=worth, minlength=len(part))
                n_words.append(words.counts)
                n_features.append(np.bincount(document, minlength=len(part)))
                weight.append(sums.astype(np.int64))
            found = [batch.column("id"), *map(_joined, (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(found, ["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long")


def _joined(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else [], pa.int64())


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((bits + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank`` from 1 on; only a count per partition reaches the driver.

    A row's place is its partition of the sorted table and its place therein. The
    sorted rows are saved, so that places stay what they are.
    """
    placed = saved(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("_part")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = rows.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long"
    )
    found = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.select(*rows.columns, (F.col("_before") + place + 1).alias("rank"))


def importance_resample(
    documents: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every document.

    ``percent`` of the documents with ``min_words`` words are drawn and have a rank.
    """
    gain = gains(
        bucket_counts(documents, text_col, max_words, buckets),
        bucket_counts(target, text_col, max_words, buckets),
    )
    weighed = weigh(documents, gain, id_col, text_col, max_words)
    scored = saved(weighed.withColumn("score", F.col("weight") + noise("id", seed)))
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    places = ranked(
        able, F.desc("score"), F.asc_nulls_last("id"), "n_words", "n_features", "weight"
    )
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    kept = F.when(F.col("rank") <= drawn, F.col("rank"))
    found = places.withColumn("rank", kept).unionByName(rest)
    return found.withColumnRenamed("id", id_col)
