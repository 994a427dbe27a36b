"""A log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

A token's context is the ORDER tokens before it. Their vectors, weighted per place
and summed, predict the token's vector; the product of both and a bias is its score,
and the softmax over all units, from batched matrix products, its probability. Units
are the end of a text, the most frequent words, and classes of all other words by their
last bytes. A word of a class has the class's probability times its share of the
class's training tokens, smoothed by one, with one share left for a word never seen. So
the probabilities after any context sum to one over all words.

Training tells a token from NOISE samples of the unigram distribution, which a batch
shares. A round is a Spark job over a part of the training texts: every task starts
from the same parameters, trains on the texts it reads, and Spark averages what the
tasks end with, weighted by their tokens. The rounds together read every training
text. The biases start as the unigram's logarithms.

Word counts grow with the corpus and stay in Spark. Only the most frequent words, at
most HEAD and a bounded number of bytes each, are sent to the tasks; all other
tokens meet their counts in a join, where no key is hot, as hot ones are in the head.
Words of more than LONG bytes go by a digest.

Defined results. A null or empty text is its end alone. A null id belongs to the
training texts, by the checksum of an empty id. Repeated rows count and are scored
each. Very long texts are scored whole. Ties in frequency go by the word's bytes. A
table without rows gives none; without training texts only smoothing is left. Only
id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.columns import arrow_batch, bytes_of, saved

ORDER, WIDTH = 3, 24
WORDS, CLASSES = 128, 256
#: Words sent to the tasks, at most, and the bytes of a word beyond which a digest stands for it.
HEAD, LONG = 1 << 18, 32
#: Distinct words that a counting task holds before it passes its counts on.
HELD_WORDS = 300_000
ROUNDS, BATCH, NOISE, RATE = 2, 1024, 64, 0.1
#: Beyond this bound on a score the exact maximum is taken, so that no exponential vanishes.
FAR = 40.0
SEED = 12
#: A document is held out if the checksum of its id leaves this remainder.
FOLDS, HELD_OUT = 7, 2

#: No word is empty, and none begins with a space.
END = b""


def word_key(word: bytes) -> bytes:
    """A word, or a digest of a long one."""
    return word if len(word) <= LONG else b" " + hashlib.md5(word).hexdigest()[:LONG].encode()


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def class_of(key: bytes) -> int:
    return crc32(key[-3:]) % CLASSES


def held_out(name: str) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


# Counts ----------------------------------------------------------------------

_COUNTS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("n_all", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train, held = Counter(), Counter()
    for batch in batches:
        for text, out in zip(bytes_of(batch, "text"), batch.column("held").to_pylist(), strict=True):
            (held if out else train).update(words_of(text))
            if len(train) + len(held) > HELD_WORDS:
                yield from _counted(train, held)
                train.clear()
                held.clear()
    yield from _counted(train, held)


def _counted(train: Counter, held: Counter) -> Iterator[pa.RecordBatch]:
    words = list(train.keys() | held.keys())
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        n = [train[w] for w in part]
        both = [a + held[w] for a, w in zip(n, part, strict=True)]
        yield arrow_batch({"key": map(word_key, part), "n": n, "n_all": both}, _COUNTS)


def word_counts(rows: DataFrame) -> DataFrame:
    """``key, n, n_all`` of each word of ``text, held``: in training texts, and in all."""
    found = rows.mapInArrow(_count, "key binary, n long, n_all long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def _level(n: Column) -> Column:
    return F.floor(8 * F.log2(n.cast("double"))).cast("int")


class Vocabulary(NamedTuple):
    """What the tasks know of the words: at most HEAD of them, and sums over all."""

    tokens: int
    distinct: int
    #: Head words by place: unit and training count.
    place: dict[bytes, int]
    unit: np.ndarray
    count: np.ndarray
    #: log10 of the smoothed tokens of each class, and training tokens of each unit.
    class_size: np.ndarray
    unit_count: np.ndarray
    #: Words of a lower level are not in the head.
    level: int

    @property
    def words(self) -> int:
        return len(self.unit_count) - CLASSES


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head, the model's units and the corpus' sums, from saved counts."""
    tokens, distinct = counts.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    level, room = 1 << 20, HEAD
    sizes = counts.groupBy(_level(F.col("n_all")).alias("level")).count().collect()
    for here, n in sorted(sizes, reverse=True):
        room -= n
        if room < 0:
            break
        level = here
    head = counts.filter(_level(F.col("n_all")) >= level).toArrow()
    keys, n = head.column("key").to_pylist(), head.column("n").to_numpy()
    ranked = sorted(range(len(keys)), key=lambda i: (-n[i], keys[i]))
    named = [END, *(keys[i] for i in ranked[: WORDS + 1] if keys[i] != END and n[i] > 0)][:WORDS]
    unit_of = {key: i for i, key in enumerate(named)}
    unit = np.array([unit_of.get(k, len(named) + class_of(k)) for k in keys], np.int16)
    # Sums of each class over all words that are no unit of their own.
    by_class = (F.crc32(F.substring("key", -3, 3)) % CLASSES).alias("class")
    size, smoothed = np.zeros(CLASSES, np.int64), np.ones(CLASSES)
    for c, total, different in (
        counts.filter("n > 0").groupBy(by_class).agg(F.sum("n"), F.count(F.lit(1))).collect()
    ):
        size[c], smoothed[c] = total, different + 1
    of_unit = dict(zip(keys, n.tolist(), strict=True))
    for key in named:
        if of_unit.get(key):
            size[class_of(key)] -= of_unit[key]
            smoothed[class_of(key)] -= 1
    of_units = [of_unit.get(key, 0) for key in named]
    return Vocabulary(
        int(tokens or 0), distinct, {k: i for i, k in enumerate(keys)}, unit, n,
        np.log10(size + smoothed), np.array([*of_units, *size], np.int64), level,
    )


# Texts as units --------------------------------------------------------------

_ENCODED = [
    ("n_tokens", pa.int64()),
    ("units", pa.binary()),
    ("n_known", pa.int64()),
    ("log_counts", pa.float64()),
    ("log_shares", pa.float64()),
    ("rest", pa.list_(pa.binary())),
]


def encoder(vocabulary):
    """A task that turns texts into unit numbers and looks up the head's counts.

    ``log_counts`` adds up log10(count + 1) over the tokens in the head,
    ``log_shares`` over those of them that belong to a class; ``rest`` are the others.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        logs, known, words = np.log10(v.count + 1.0), v.count > 0, v.words
        classed = np.where(v.unit >= words, logs, 0.0)
        for batch in batches:
            found = []
            for text in bytes_of(batch, "text"):
                tokens = words_of(text)
                at = np.fromiter(map(v.place.get, tokens, repeat(-1)), np.int64, len(tokens))
                rest = []
                missing = np.flatnonzero(at < 0)
                late = np.zeros(len(missing), np.int16)
                for j, i in enumerate(missing.tolist()):
                    key = word_key(tokens[i])
                    at[i] = v.place.get(key, -1)
                    if at[i] < 0:
                        rest.append(key)
                        late[j] = words + class_of(key)
                    else:
                        late[j] = v.unit[at[i]]
                units = v.unit[at] if len(v.unit) else np.zeros(len(at), np.int16)
                units[missing] = late
                head = at[at >= 0]
                found.append(
                    (len(tokens), units.tobytes(), int(known[head].sum()),
                     float(logs[head].sum()), float(classed[head].sum()), rest)
                )
            columns = zip(*found, strict=True) if found else [[]] * len(_ENCODED)
            arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, _ENCODED, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), *arrays],
                ["id", "held", *(name for name, _ in _ENCODED)],
            )

    return encode


# The model -------------------------------------------------------------------


class Model(NamedTuple):
    """Vectors of context units (the last one stands before a text) and of predicted ones."""

    context: np.ndarray
    place: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    def like(self, flat: np.ndarray) -> "Model":
        cuts = np.cumsum([x.size for x in self])[:-1]
        parts = np.split(flat.astype(np.float32), cuts)
        return Model(*(p.reshape(x.shape) for p, x in zip(parts, self, strict=True)))


class Softmax:
    """Log-probabilities of units after their contexts, a batch per matrix product."""

    def __init__(self, model: Model):
        self.tables = [model.context * weights for weights in model.place]
        n = len(model.bias)
        # A row's offset and the biases take part in the product as two more columns.
        self.output = np.concatenate([model.output, model.bias[:, None], np.ones((n, 1))], axis=1)
        self.output = np.ascontiguousarray(self.output.T.astype(np.float32))
        self.ones = np.ones(n, np.float32)
        self.longest = float(np.sqrt((model.output**2).sum(axis=1).max(initial=0)))
        self.bias = float(model.bias.max())

    def log_probabilities(self, contexts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The natural logarithm of each unit's share in the softmax after its context."""
        guess = sum(table[contexts[:, i]] for i, table in enumerate(self.tables))
        # No score is above the product of the lengths and the largest bias.
        most = np.sqrt((guess * guess).sum(axis=1)) * self.longest + self.bias
        if most.max(initial=0) - self.bias > FAR:
            most = (guess @ self.output[:-2] + self.output[-2]).max(axis=1)
        ones = np.ones(len(guess), np.float32)
        scores = np.column_stack([guess, ones, -most]).astype(np.float32) @ self.output
        own = scores[np.arange(len(units)), units].astype(np.float64)
        return own - np.log((np.exp(scores, out=scores) @ self.ones).astype(np.float64))


def unigram(counts: np.ndarray) -> np.ndarray:
    return (counts + 1.0) / (counts.sum() + len(counts))


def first_model(counts: np.ndarray) -> Model:
    """Small random vectors, and biases that alone give the unigram distribution."""
    random = np.random.default_rng(SEED)
    n = len(counts)
    draw = lambda *shape: (0.1 * random.standard_normal(shape)).astype(np.float32)
    return Model(
        draw(n + 1, WIDTH),
        np.full((ORDER, WIDTH), 1.0 / ORDER, np.float32),
        draw(n, WIDTH),
        np.log(unigram(counts)).astype(np.float32),
    )


def contexts_of(texts: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts in a row, and the ORDER units before each in its own text."""
    pad = np.full(ORDER, before, np.int16)
    padded = np.concatenate([x for text in texts for x in (pad, text)])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + ORDER * (1 + np.repeat(np.arange(len(texts)), sizes))
    del starts
    return padded[at], np.stack([padded[at - back] for back in range(1, ORDER + 1)], axis=1)


def _added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the vectors of each row number."""
    width = values.shape[1]
    at = rows.astype(np.int64)[:, None] * width + np.arange(width)
    return np.bincount(at.ravel(), values.ravel(), n * width).reshape(n, width)


class Trainer:
    """Stochastic gradient steps with step sizes by parameter."""

    def __init__(self, model: Model, counts: np.ndarray, seed: tuple[int, ...]):
        self.model = Model(*(x.copy() for x in model))
        self.seen = Model(*(np.ones_like(x) for x in model))
        share = unigram(counts)
        self.upto = np.cumsum(share)
        self.expected = np.log(NOISE * share).astype(np.float32)
        self.random = np.random.default_rng(seed)

    def step(self, contexts: np.ndarray, units: np.ndarray) -> None:
        m, n = self.model, len(self.model.bias)
        noise = np.minimum(np.searchsorted(self.upto, self.random.random(NOISE)), n - 1)
        around = m.context[contexts]
        guess = np.einsum("bod,od->bd", around, m.place)
        wanted, other = m.output[units], m.output[noise]
        true = np.einsum("bd,bd->b", guess, wanted) + m.bias[units] - self.expected[units]
        false = guess @ other.T + (m.bias[noise] - self.expected[noise])
        # What is missing to certainty that the token is one, and the noise is none.
        up, down = 1.0 / (1.0 + np.exp(np.minimum(true, 50))), -1.0 / (1.0 + np.exp(np.minimum(-false, 50)))
        slope = up[:, None] * wanted + down @ other
        output = _added(units, up[:, None] * guess, n) + _added(noise, down.T @ guess, n)
        bias = np.bincount(units, up, n) + np.bincount(noise, down.sum(axis=0), n)
        context = _added(
            contexts.ravel(), (slope[:, None] * m.place).reshape(-1, WIDTH), n + 1
        )
        place = (slope[:, None] * around).sum(axis=0)
        for value, seen, gradient in zip(m, self.seen, (context, place, output, bias), strict=True):
            seen += gradient * gradient
            value += RATE * gradient / np.sqrt(seen)


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int16) for b in batch.column("units").to_pylist()]


def trained(encoded: DataFrame, counts: np.ndarray) -> Model:
    """The model after all rounds over the training texts."""
    spark = encoded.sparkSession
    model = first_model(counts)
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64()), ("weight", pa.float64())])
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(sent.value, counts, (SEED, number, TaskContext.get().partitionId()))
            tokens = 0
            for texts in _portions(batches):
                units, contexts = contexts_of(texts, len(counts))
                for i in range(0, len(units), BATCH):
                    trainer.step(contexts[i : i + BATCH], units[i : i + BATCH])
                tokens += len(units)
            if tokens:
                flat = trainer.model.flat().astype(np.float64) * tokens
                yield arrow_batch(
                    {"at": np.arange(len(flat)), "value": flat, "weight": np.full(len(flat), float(tokens))},
                    schema,
                )

        part = F.pmod(F.xxhash64("units"), F.lit(ROUNDS)) == number
        found = (
            encoded.filter(~F.col("held") & part)
            .select("units")
            .mapInArrow(train, "at int, value double, weight double")
            .groupBy("at")
            .agg((F.sum("value") / F.sum("weight")).alias("value"))
            .toArrow()
        )
        if found.num_rows:
            flat = model.flat()
            flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
            model = model.like(flat)
        sent.unpersist()
    return model


def _portions(batches: Iterator[pa.RecordBatch], size: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Texts whose units come to a portion at a time, and longer ones alone."""
    texts, held = [], 0
    for batch in batches:
        for text in _texts(batch):
            texts.append(text)
            held += len(text)
            if held >= size:
                yield texts
                texts, held = [], 0
    if texts:
        yield texts


def scorer(model, vocabulary):
    """A task that adds each text's log10 probability, as far as the head's counts go."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        softmax = Softmax(model.value)
        shares = np.concatenate([np.zeros(vocabulary.value.words), vocabulary.value.class_size])
        for batch in batches:
            sums = [
                total
                for texts in _portions([batch], 8 * BATCH)
                for total in _scores(softmax, shares, texts)
            ]
            kept = [c for c in batch.schema.names if c != "units"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sums, pa.float64())],
                [*kept, "log_model"],
            )

    return score


def _scores(softmax: Softmax, shares: np.ndarray, texts: list[np.ndarray]) -> list[float]:
    """log10 of each text's units' probabilities over their classes' sizes."""
    units, contexts = contexts_of(texts, len(softmax.ones))
    found = np.empty(len(units))
    for i in range(0, len(units), BATCH):
        part = slice(i, i + BATCH)
        found[part] = softmax.log_probabilities(contexts[part], units[part])
    starts = np.cumsum([0, *map(len, texts[:-1])])
    return np.add.reduceat(found / np.log(10.0) - shares[units], starts).tolist()


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Trains on the documents that are not held out and scores all. ``base_score`` is
    that of a smoothed unigram model.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    counts = saved(word_counts(rows.select("text", "held")))
    v = vocabulary(counts)
    sent = spark.sparkContext.broadcast(v)
    encoded = saved(
        rows.mapInArrow(
            encoder(sent),
            f"id {kind}, held boolean, n_tokens long, units binary, n_known long, "
            "log_counts double, log_shares double, rest array<binary>",
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    model = spark.sparkContext.broadcast(trained(encoded.select("held", "units"), v.unit_count))
    logged = F.log10(F.col("n") + 1.0)
    rest = (
        encoded.select("_row", F.explode("rest").alias("key"))
        .join(counts.filter(_level(F.col("n_all")) < v.level), "key")
        .groupBy("_row")
        .agg(F.sum(logged).alias("_logs"), F.count_if(F.col("n") > 0).alias("_known"))
    )
    scored = encoded.drop("rest").mapInArrow(
        scorer(model, sent),
        f"id {kind}, held boolean, n_tokens long, n_known long, "
        "log_counts double, log_shares double, _row long, log_model double",
    )
    logs, known = F.coalesce("_logs", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    per_token = float(np.log10(v.tokens + v.distinct + 1.0))
    return scored.join(rest, "_row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("log_model") + F.col("log_shares") + logs).alias("score"),
    )
