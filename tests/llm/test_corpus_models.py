"""Target resampling, the language model and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.llm import neural_lm, prefix_trie, target_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, id string, score string, rank string, held string, _row string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, texts, ids=None):
    """Documents whose extra columns are named like inner ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, *"abcde") for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


# Target resampling -------------------------------------------------------------


def plain_features(text, most):
    words = WORD.findall(lowered(text))
    runs = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
    return words, [crc32(r.encode()) % 10_000 for r in runs]


def plain_resample(rows, target, most, min_words=20, percent=10):
    found = [(i, *plain_features(t, most)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, buckets in found:
        s.update(buckets)
    for text in target:
        t.update(plain_features(text, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for i, words, buckets in found:
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000))))
            for b in buckets
        )
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((i, len(words), len(buckets), weight, score))
    able = [r for r in scored if r[1] >= min_words]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0]))
    k = len(able) * percent // 100
    rest = [r for r in scored if r[1] < min_words]
    ranked = [(r[0], *r[2:], n if n <= k else None) for n, r in enumerate(able, 1)]
    return sorted(map(repr, ranked + [(r[0], *r[2:], None) for r in rest]))


EDGES = [
    None, "", " -- \n", "Été naïve 学校 the-end_of x1Y2", "a" * 70_000 + " b", "é" * 300 + "-B",
    " ".join(f"w{i}" for i in range(30_000)), "\x00\x1ftab\tsep\x7fend", "A B a b A B",
]


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_plain_python(spark, most):
    texts = EDGES + prose(150, ["the", "Of", "née", "x-y", "von", "der", "42"], 3) + ["same words " * 12] * 20
    ids = [*range(len(texts) - 4), None, None, 7, 7]
    target = [None, "", *prose(20, ["von", "der", "née"], 4)]
    got = target_resampling.importance_resample(
        docs(spark, texts, ids).repartition(5), docs(spark, target), max_words=most, percent=30
    )
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == plain_resample(
        list(zip(ids, texts, strict=True)), target, most, percent=30
    )


def test_crcs_of_all_runs_and_empty_tables(spark):
    words = target_resampling.Words([b"Ab  c!d", b"", b"x" * 5000 + b" y z"])
    crcs, document = words.runs(2)
    runs = [b"ab c", b"c d", b"x" * 5000 + b" y", b"y z"]
    assert crcs.tolist() == [crc32(r) for r in runs] and document.tolist() == [0, 0, 2, 2]
    none = docs(spark, [])
    assert target_resampling.importance_resample(none, docs(spark, ["a"])).count() == 0
    alone = target_resampling.importance_resample(docs(spark, ["a b"]), none).first()
    assert (alone["n_features"], alone["rank"]) == (2, None)


def test_equal_scores_rank_by_id(spark):
    rows = spark.createDataFrame([(i, 5) for i in range(100)], "id long, score long").repartition(7)
    got = target_resampling.ranked(rows, F.desc("score"), F.asc_nulls_last("id"))
    assert {r["id"]: r["rank"] for r in got.collect()} == {i: i + 1 for i in range(100)}


# Language model ----------------------------------------------------------------


def plain_words(text):
    return [*(text or "").encode().lower().split(), neural_lm.END]


def plain_base(rows):
    count = Counter(
        w for i, t in rows if crc32(str("" if i is None else i).encode()) % 7 != 2 for w in plain_words(t)
    )
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        words = plain_words(text)
        held = crc32(str("" if i is None else i).encode()) % 7 == 2
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, held, len(words), sum(count[w] > 0 for w in words), n, round(base, 6)))
    return sorted(map(repr, out))


def base_of(frame):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    return sorted(
        repr((*(r[n] for n in names), round(r["base_score"], 6)))
        for r in frame.select(*names, "base_score").collect()
    )


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_base_scores_equal_plain_python(spark, monkeypatch, head):
    """Also where hardly any word is in the head, so that the rest meet in the join."""
    monkeypatch.setattr(neural_lm, "HEAD", head)
    texts = [
        None, "", "\x0b \x1c", "Long" * 50 + " x", "long" * 50, "É é\x00z", "w " * 5000,
        *prose(40, ["the", "Of", "née", "x-y", "q" * 40], 5), *["only here"] * 3,
    ]
    ids = [*range(len(texts) - 3), None, None, 5]
    got = neural_lm.score_texts(docs(spark, texts, ids).repartition(4))
    assert base_of(got) == plain_base(list(zip(ids, texts, strict=True)))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.collect())


def test_probabilities_sum_to_one_over_all_words(spark, monkeypatch):
    """Over every known word and one never seen, after several contexts."""
    monkeypatch.setattr(neural_lm, "WORDS", 4)
    texts = prose(60, ["the", "of", "and", "mit", "von", "la", "le", "x", "y"], 6)
    rows = docs(spark, texts).select(F.col("text"), F.lit(False).alias("held"))
    from tenure.llm.columns import saved

    counts = saved(neural_lm.word_counts(rows))
    v = neural_lm.vocabulary(counts)
    model = neural_lm.first_model(v.unit_count)
    trainer = neural_lm.Trainer(model, v.unit_count, (1,))
    rng = np.random.default_rng(0)
    for _ in range(50):
        trainer.step(rng.integers(0, len(model.bias) + 1, (64, 3)), rng.integers(0, len(model.bias), 64))
    softmax = neural_lm.Softmax(trainer.model)
    words = v.words
    known = defaultdict(list)
    for key, at in v.place.items():
        if v.unit[at] >= words:
            known[v.unit[at] - words].append(v.count[at])
    shares = [sum(c + 1 for c in known[k]) + 1 for k in range(neural_lm.CLASSES)]
    assert np.allclose(np.log10(shares), v.class_size)
    for context in ([1, 2, 3], [0, 0, 5], [len(model.bias)] * 3):
        n = len(model.bias)
        logs = softmax.log_probabilities(np.tile(np.array(context, np.int16), (n, 1)), np.arange(n))
        plain = sum(trainer.model.context[c] * w for c, w in zip(context, trainer.model.place, strict=True))
        scores = (trainer.model.output @ plain + trainer.model.bias).astype(float)
        assert np.allclose(logs, scores - np.log(np.exp(scores).sum()), atol=1e-4)
        assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_far_scores_stay_finite():
    model = neural_lm.first_model(np.arange(1, 20))
    far = model._replace(context=model.context * 3000, output=model.output * 3000)
    logs = neural_lm.Softmax(far).log_probabilities(np.array([[1, 2, 3]] * 19), np.arange(19))
    assert np.isfinite(logs).all() and abs(np.exp(logs).sum() - 1) < 1e-3


def test_model_beats_the_unigram_on_held_out_texts(spark, sf_dir):
    found = neural_lm.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = found.filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.1


def test_model_of_empty_tables(spark):
    assert neural_lm.score_texts(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    alone = neural_lm.score_texts(docs(spark, ["no training text"], [held])).first()
    assert (alone["train_tokens"], alone["n_known"], alone["n_tokens"]) == (0, 0, 4)
    assert math.isfinite(alone["score"])


# Prefix trie -------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, conv string, place string, shard string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TALK)


def plain_nodes(rows):
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            named = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            original[c].append((turn is not None, turn or 0, named, (role, text)))
    original = {c: [x[-1] for x in sorted(found)] for c, found in original.items()}
    members = defaultdict(list)
    for c in sorted(original):
        h = crc32(str(c).encode()) % 6
        path = tuple(original.get(c - int(math.fmod(c, 100)), [])[:h] + original[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path)))
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, found in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(found) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        repr((
            found[0][0], len(path), members[path[:-1]][0][0] if path else None, len(found),
            children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c, n in found if n == len(path)).encode()).hexdigest(),
        ))
        for path, found in members.items()
    )


def nodes_of(turns):
    trie = prefix_trie.prefix_trie(prefix_trie.rebuilt(turns))
    found = trie.nodes.join(prefix_trie.end_digests(trie.ends), ["conv_id", "depth"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    assert trie.nodes.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"
    ]
    names = [*trie.nodes.columns, "digest"]
    return sorted(
        repr((*(r[n] for n in names[:-1]), r["digest"] or empty)) for r in found.select(*names).collect()
    )


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_trie_equals_plain_python(spark, monkeypatch, shard):
    """Whatever the shards, with copies, null and repeated turns, and a long conversation."""
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    rng = random.Random(shard)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yy", "é\n", "", None]))
            for c in rng.sample(range(700), 220) for t in range(rng.randint(1, 8))]
    rows += [(1000 + c, t, "u", f"hot {t}") for c in range(60) for t in range(4)]
    rows += [(5, None, None, None), (5, 1, "u", "x"), (5, 1, "u", "x"), (None, 0, "u", "lost")]
    rows += [(2000, t, "u", str(t % 3)) for t in range(150)] + [(2107, 0, "u", "a")]
    rng.shuffle(rows)
    turns = prefix_trie.turns_of(talks(spark, rows).repartition(6))
    assert nodes_of(turns) == plain_nodes(rows)


def test_turnless_conversations_and_empty_tables(spark):
    """A conversation whose block has no first one may lose all turns; it ends at the root."""
    short = [c for c in range(101, 160) if crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "u", "gone") for c in short]
    assert nodes_of(prefix_trie.turns_of(talks(spark, rows))) == plain_nodes(rows)
    assert nodes_of(prefix_trie.turns_of(talks(spark, []))) == []


def test_a_long_list_of_ends_passes_in_parts(spark):
    ids = [str(i) for i in range(10_000)]
    parts = [(1, 2, i, ",".join(ids[i : i + 100])) for i in range(0, 10_000, 100)]
    ends = spark.createDataFrame(parts, "conv_id long, depth long, shard long, ids string").repartition(9)
    found = prefix_trie.end_digests(ends).collect()
    assert [tuple(r) for r in found] == [(1, 2, hashlib.sha256(",".join(ids).encode()).hexdigest())]
