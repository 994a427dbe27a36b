"""A trie of conversation prefixes, from vertical bitmaps per shard.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. A shard is a range of conversation ids. In it, every (position,
turn) has a bitset of the conversations that have this turn there. Depth first, the
intersection of a node's bitset with the postings of the next position gives its
children; a bitset's lowest bit is the smallest member, its popcount the number of
members, and the bits without a next turn are the conversations that end there.

Shards are cut by id and not by content, so a first turn that a third of all
conversations share is spread like any other; a shard reports such a node once. The
nodes of all shards meet by a chained digest of their turns. Sums over subtrees need no
walk over the whole trie: each node belongs to the shard of its smallest member,
where all its ancestors are nodes too. So a shard adds up what it owns below each of
its nodes, and the sums of the shards add up to the trie's.

Defined results. Turns come in the order of ``turn``, null first, ties by role and
text. A null role or text is the empty one. Rows without a conversation id belong
to no conversation. Repeated rows are turns of their own. Very long texts count by
their digest. A table without rows has no nodes, not even a root. Other columns are
not read. Memory follows a shard's turns, or those of one conversation if it has more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.columns import arrow_batch, saved, text_or_empty

#: A shard is closed at the end of the conversation that reaches one of these.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 16
#: Conversations that take their first turns from one of their block, and how many at most.
BLOCK, MOST_BORROWED = 100, 5


class Trie(NamedTuple):
    """``nodes``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens. ``ends``: per node and shard with conversations that end there,
    conv_id, depth, ``shard`` (its smallest id) and ``ids``, their ascending ids joined by
    commas; no list is ever in one row as a whole."""

    nodes: DataFrame
    ends: DataFrame


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, place, digest, chars``: the turns in order, without their texts."""
    role, text = text_or_empty("role"), text_or_empty("text")
    named = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        named.alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return narrow.select(
        "conv", (F.row_number().over(order) - 1).cast("long").alias("place"), "digest", "chars"
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation after it took its first turns from the first of its block.

    It takes 0 to MOST_BORROWED of them, by a checksum of its id, in place of as many of
    its own. A conversation that has no turn then keeps a row without one.
    """
    base = F.col("conv") - F.col("conv") % BLOCK
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    lent = (
        turns.filter((F.col("conv") % BLOCK == 0) & (F.col("place") < MOST_BORROWED))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("lent"))
    )
    firsts = turns.filter("place = 0").select("conv", base.alias("base"), taken.alias("taken"))
    got = firsts.join(lent, "base", "left").select(
        "conv", F.explode_outer(F.slice("lent", 1, F.col("taken").cast("int"))).alias("turn")
    )
    own = turns.filter(F.col("place") >= taken).withColumn("place", F.col("place") + MOST_BORROWED)
    return got.select("conv", "turn.place", "turn.digest", "turn.chars").unionByName(own)


class Local(NamedTuple):
    """The nodes of one shard, each before those below it."""

    last: list[int]
    parent: list[int]
    depth: list[int]
    key: list[bytes]
    first: list[int]
    n: list[int]
    chars: list[int]
    ends: list[str | None]


Turn = tuple[bytes, int]


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def shard_trie(ids: list[int], turns: list[list[Turn]]) -> Local:
    """The trie of conversations with ascending ids, by intersection of bitsets."""
    postings: list[dict[Turn, int]] = [{} for _ in range(max(map(len, turns), default=0))]
    for i, own in enumerate(turns):
        for place, turn in enumerate(own):
            postings[place][turn] = postings[place].get(turn, 0) | 1 << i
    # Conversations that have a turn at each place, and at none after the last.
    going = [0] * (len(postings) + 1)
    for i, own in enumerate(turns):
        going[len(own)] |= 1 << i
    ended, left = 0, ~0
    for place, stop in enumerate(going):
        if stop:
            ended |= stop
            left = ~ended
        going[place] = left
    out = Local([], [], [], [], [], [], [], [])
    stack = [((1 << len(ids)) - 1, 0, -1, b"", 0)]
    while stack:
        members, depth, parent, key, chars = stack.pop()
        at = len(out.key)
        on = members & going[depth]
        out.parent.append(parent)
        out.depth.append(depth)
        out.key.append(key)
        out.first.append(ids[(members & -members).bit_length() - 1])
        out.n.append(members.bit_count())
        out.chars.append(chars)
        stop = members & ~on
        out.ends.append(",".join(str(ids[i]) for i in _bits(stop)) if stop else None)
        while on:
            turn = turns[(on & -on).bit_length() - 1][depth]
            child = members & postings[depth][turn]
            on &= ~child
            stack.append((child, depth + 1, at, hashlib.md5(key + turn[0]).digest(), turn[1]))
    last = list(range(len(out.key)))
    for at in range(len(last) - 1, 0, -1):
        last[out.parent[at]] = max(last[out.parent[at]], last[at])
    out.last.extend(last)
    return out


_LOCAL = pa.schema(
    [
        ("shard", pa.int64()),
        ("at", pa.int32()),
        ("last", pa.int32()),
        ("parent", pa.int32()),
        ("depth", pa.int64()),
        ("key", pa.binary()),
        ("first", pa.int64()),
        ("n", pa.int64()),
        ("chars", pa.int64()),
        ("ends", pa.string()),
    ]
)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The local nodes of each shard; rows come ordered by conversation and place."""
    ids, turns, size = [], [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv", "digest", "chars"))
        for conv, digest, chars in zip(*columns, strict=True):
            if not ids or ids[-1] != conv:
                if len(ids) >= SHARD_CONVERSATIONS or size >= SHARD_TURNS:
                    yield _told(ids, turns)
                    ids, turns, size = [], [], 0
                ids.append(conv)
                turns.append([])
            if digest is not None:
                turns[-1].append((digest, chars))
                size += 1
    if ids:
        yield _told(ids, turns)


def _told(ids: list[int], turns: list[list[Turn]]) -> pa.RecordBatch:
    found = shard_trie(ids, turns)
    count = len(found.key)
    return arrow_batch(
        {**found._asdict(), "shard": [ids[0]] * count, "at": range(count)}, _LOCAL
    )


_PARTS = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, shard long, ids string"
)


def _owned_sums(nodes: pd.DataFrame) -> pd.DataFrame:
    """What a shard owns at and below each of its nodes."""
    nodes = nodes.sort_values("at")
    own = (nodes["first"] == nodes["conv_id"]).to_numpy()
    parent = nodes["parent"].to_numpy()
    conv = nodes["conv_id"].to_numpy()
    after = nodes["last"].to_numpy() + 1

    def below(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[after] - upto[:-1]

    worth = (nodes["n_convs"].to_numpy() - 1) * nodes["chars"].to_numpy()
    return pd.DataFrame(
        {
            "conv_id": conv,
            "depth": nodes["depth"],
            "parent_conv_id": pd.array(np.where(parent < 0, 0, conv[parent]), "Int64"),
            "n_convs": nodes["n_convs"],
            "n_children": np.bincount(parent[own & (parent >= 0)], minlength=len(conv)),
            "n_leaves": below((own & nodes["leaf"].to_numpy()).astype(np.int64)),
            "saved_tokens": below(np.where(own, worth, 0)),
            "shard": nodes["shard"],
            "ids": nodes["ends"],
        }
    ).assign(parent_conv_id=lambda out: out["parent_conv_id"].mask(parent < 0))


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of ``conv, place, digest, chars`` rows, as ``turns_of`` and ``rebuilt`` give."""
    spread = turns.repartitionByRange("conv").sortWithinPartitions("conv", "place")
    kinds = (
        "shard long, at int, last int, parent int, depth long, key binary, "
        "first long, n long, chars long, ends string"
    )
    local = saved(spread.mapInArrow(_shards, kinds))
    whole = local.groupBy("key").agg(
        F.min("first").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.bool_and(F.col("at") == F.col("last")).alias("leaf"),
    )
    parts = saved(
        local.drop("n").join(whole, "key").drop("key").groupBy("shard").applyInPandas(_owned_sums, _PARTS)
    )
    nodes = parts.groupBy("conv_id", "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    return Trie(nodes, parts.filter("ids IS NOT NULL").select("conv_id", "depth", "shard", "ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per node; its lists come one after the other and are never joined in memory."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.string())])
    node, running = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            here = row["conv_id"], row["depth"]
            if here == node:
                running.update(b",")
            else:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = here, hashlib.sha256()
            running.update(row["ids"].encode())
        yield arrow_batch({f.name: [d[i] for d in done] for i, f in enumerate(schema)}, schema)
    if node is not None:
        yield arrow_batch(
            {"conv_id": [node[0]], "depth": [node[1]], "digest": [running.hexdigest()]}, schema
        )


def end_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, digest``: SHA-256 of all ids that end at a node, ascending.

    A digest reads its list from start to end, so a node's lists meet in one task, a row
    per shard, and pass through it as a stream.
    """
    together = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "shard")
    return together.mapInArrow(_digests, "conv_id long, depth long, digest string")
