"""SimHash near-duplicates by anchor-point covering.

A document's 64-bit fingerprint comes from the XXH64 hashes of its word shingles;
fingerprints of up to 3 differing bits are linked. Of two such fingerprints, one
32-bit half differs in at most one bit. For each half the anchors are a covering
code: the words of the Hamming code of length 31, which covers every 31 bits within
radius 1, with the last bit free. A fingerprint is sent to every anchor within
covering radius plus threshold, 1 + 1 = 2 bits, of its half: at most 17. The nearest
one is its home, and whatever differs from it by a bit in that half also reaches
its home. So each anchor compares its home fingerprints with all that it has, in
all 64 bits.

Only distinct fingerprints take part; documents follow by a join. An anchor reports
a spanning forest of its links, never all pairs. Within an anchor's task, a large
group is compared by the bytes of the other half (two fingerprints that are linked
agree in at least one of its four), and an anchor with more than HOT fingerprints is
split by those bytes over tasks before. Components come from alternating star steps
over saved edges until nothing changes.

Defined results. A null text counts as empty: no shingles and fingerprint zero,
linked like any other. Fewer words than a shingle has make one shingle of them.
Repeated rows and ids give repeated rows; a component's id is its smallest document
id, null only if all are null. An empty table gives no rows. Only id and text are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tenure.llm.columns import arrow_batch, saved, text_key
from tenure.llm.row_filter import named_rows

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Fingerprints of an anchor that one task compares as one group, and at most.
SMALL, HOT = 512, 50_000

_LANES = np.uint64(0x0101010101010101)
_HALF = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -size].tolist()]
    digest = xxhash.xxh64_intdigest
    found = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as an unsigned number."""
    n = len(hashes)
    if not n:
        return 0
    # Eight one-byte counters share a number; each sum of 255 hashes is kept apart.
    starts = np.arange(0, n, 255)
    value = 0
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n).tolist():
            value |= 1 << (8 * lane + bit)
    return value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    plain = texts.cast(pa.large_binary()).to_pylist()
    return pa.array([_signed(fingerprint(shingle_hashes(t or b""))) for t in plain], pa.int64())


_POSITIONS = np.arange(1, 32, dtype=np.uint64)


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of the low 31 bits: the place of the bit to flip, or 0."""
    found = np.zeros(len(halves), np.int64)
    for bit in range(5):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> bit & 1))
        found |= (np.bitwise_count(halves & mask).astype(np.int64) & 1) << bit
    return found


#: By syndrome: the 15 pairs of bits whose flip gives a code word, as masks.
_PAIRS = np.zeros((32, 15), np.uint64)
for _s in range(1, 32):
    _PAIRS[_s] = [
        (1 << (a - 1)) | (1 << (b - 1)) for a, b in combinations(range(1, 32), 2) if a ^ b == _s
    ]


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, anchor, home`` for every anchor within 2 bits of each 32-bit number."""
    syndromes = _syndromes(halves)
    flips = np.where(syndromes > 0, np.uint64(1) << np.maximum(syndromes - 1, 0).astype(np.uint64), np.uint64(0))
    home = halves ^ flips
    rows = np.arange(len(halves))
    off = np.flatnonzero(syndromes > 0)
    near = (halves[off, None] ^ _PAIRS[syndromes[off]]).reshape(-1)
    row = np.concatenate([rows, rows, np.repeat(off, 15)])
    anchor = np.concatenate([home, home ^ np.uint64(1 << 31), near])
    return row, anchor, np.arange(len(row)) < len(rows)


_REPLICA = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for part in np.array_split(values, max(1, len(values) // 20_000)):
            for half in (0, 1):
                row, anchor, home = anchors((part >> np.uint64(32 * half)) & _HALF)
                key = (anchor | np.uint64(half << 32)).view(np.int64)
                yield arrow_batch({"anchor": key, "fp": part[row].view(np.int64), "home": home}, _REPLICA)


def _forest(values: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a group: each found member with the member that it was found from."""
    found, open_ = [], np.arange(len(values))
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            near = np.bitwise_count(values[open_] ^ values[at]) <= MAX_BITS
            if not home[at]:
                near &= home[open_]
            hits = open_[near]
            if len(hits):
                found.append((np.full(len(hits), values[at]), values[hits]))
                queue.extend(hits.tolist())
                open_ = open_[~near]
    return found


def _large_forest(anchor: int, values: np.ndarray, home: np.ndarray) -> list:
    """A forest of a large group, from groups that agree in a byte of the other half."""
    found = []
    other = values >> np.uint64(0 if anchor >> 32 & 1 else 32)
    for byte in range(4):
        key = (other >> np.uint64(8 * byte)) & np.uint64(0xFF)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            found += _forest(values[part], home[part])
    return found


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each anchor; rows come sorted by anchor."""
    rest: list[pa.Table] = []

    def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[starts, len(anchor)])
        found = []
        # Small groups: compare each row with the k-th after it, for all groups at once.
        size_of = np.repeat(sizes, sizes)
        place = np.arange(len(anchor)) - np.repeat(starts, sizes)
        rows = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
        step = 1
        while len(rows):
            rows = rows[place[rows] + step < size_of[rows]]
            near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= MAX_BITS
            hit = rows[near & (home[rows] | home[rows + step])]
            if len(hit):
                found.append((fp[hit], fp[hit + step]))
            step += 1
        if not found and not (sizes > SMALL).any():
            return found
        if found and max(map(len, (x for x, _ in found))) > 0:
            found = _thinned(found)
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            found += _large_forest(int(anchor[s]) & ((1 << 33) - 1), fp[s : s + n], home[s : s + n])
        return found

    def out(table: pa.Table):
        anchor = table["anchor"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        found = links(anchor, fp, table["home"].to_numpy())
        if found:
            u = np.concatenate([x for x, _ in found])
            v = np.concatenate([y for _, y in found])
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            yield arrow_batch({"u": pairs[:, 0].view(np.int64), "v": pairs[:, 1].view(np.int64)}, _EDGES)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("anchor").to_numpy(zero_copy_only=False)
        whole = int(np.searchsorted(keys, keys[-1]))
        # The last anchor of a batch may go on in the next one.
        if whole or (rest and rest[0]["anchor"][0].as_py() != keys[0]):
            yield from out(pa.concat_tables([*rest, pa.Table.from_batches([batch.slice(0, whole)])]))
            rest = []
        rest.append(pa.Table.from_batches([batch.slice(whole)]))
    if rest:
        yield from out(pa.concat_tables(rest))


def _thinned(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links: members with the smallest member of their component."""
    u, v = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(names))
    return [(names[keep], names[root[keep]])]


def linked(fingerprints: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints ``fp`` (distinct, saved) within MAX_BITS."""
    replicas = fingerprints.mapInArrow(_replicate, "anchor long, fp long, home boolean")
    hot = saved(replicas.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"))
    if not hot.isEmpty():
        marked = replicas.join(hot.withColumn("_hot", F.lit(True)), "anchor", "left")
        other = F.when(F.col("anchor").bitwiseAND(F.lit(1 << 32)) == 0, F.shiftright("fp", 32)).otherwise(F.col("fp"))
        parts = F.array(
            *(
                F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)).bitwiseOR(F.lit(i << 8)) + 1
                for i in range(4)
            )
        )
        part = F.explode(F.when(F.col("_hot"), parts).otherwise(F.array(F.lit(0).cast("long"))))
        replicas = marked.withColumn("_part", part).withColumn(
            "anchor", F.col("anchor").bitwiseOR(F.call_function("shiftleft", F.col("_part"), F.lit(33)))
        )
    grouped = replicas.select("anchor", "fp", "home").repartition("anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``: the smallest node it reaches.

    Large and small star steps in turn, each from saved edges.
    """
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = saved(large)
        lower = large.groupBy("u").agg(F.min("v").alias("_m"))
        kept = large.join(lower, "u")
        small = saved(
            kept.filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .union(lower.select("u", F.col("_m").alias("v")))
            .distinct()
        )
        changed = not small.exceptAll(edges).isEmpty() or not edges.exceptAll(small).isEmpty()
        edges = small
        if not changed:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v"), F.col("v"))).distinct()


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, component_id`` of every document; ``fp`` is the signed fingerprint."""
    prints = saved(documents.select(F.col(id_col).alias("_id"), fingerprint_of(F.col(text_col)).alias("fp")))
    distinct = saved(prints.groupBy("fp").agg(F.min("_id").alias("_first")))
    roots = saved(components(linked(distinct.select("fp"))))
    classes = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("root")
    )
    ids = classes.groupBy("root").agg(F.min("_first").alias("component_id"))
    member = saved(classes.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return prints.join(member, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document row of each group.

    It is the one with the smallest id; a null id stays only in a group without any
    other. Rows that share an id but not the text are documents of their own. Among
    those of one id in a group the text's key decides, and of equal rows one stays.
    """
    text = F.col(text_col)
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_key(text).alias("key"))
    found = saved(near_duplicates(documents.select(name.alias("_name"), text), "_name", text_col))
    first = F.col("_name") == F.col("component_id")

    def named(rows: DataFrame) -> DataFrame:
        return saved(rows.select(F.col("_name.id").alias("_named_id"), F.col("_name.key").alias("_named_key")))

    def among(rows: DataFrame, names: DataFrame, without: bool) -> DataFrame:
        return named_rows(rows, names, id_col, text_col, without)

    kept = among(documents, named(found.filter(~first).select("_name").distinct()), True)
    repeated = named(found.filter(first).groupBy("_name").count().filter("count > 1"))
    if repeated.isEmpty():
        return kept
    whole = F.struct(*(F.col(c) for c in documents.columns)).alias("_row")
    twice = among(kept, repeated, False).select(whole, F.col(id_col).alias("_id"), text_key(text).alias("_key"))
    once = twice.dropDuplicates(["_id", "_key"])
    once = once.select(*(F.col("_row").getField(c).alias(c) for c in documents.columns))
    return among(kept, repeated, True).unionByName(once)
