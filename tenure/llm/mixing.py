"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix by weight, at most MAX_COPIES times its
size; what a source cannot take is shared by weight among the others. Within a
source, a document's expected copies are proportional to its preference (one for
all, unless a column says otherwise) and at most MAX_COPIES. The whole part of the
expected copies is certain. The rest is the document's inclusion probability p:
with a random number u, taken from id and text, documents are ranked by

    (u / (1 - u)) / (p / (1 - p))

and the smallest are taken, as many as fit into the words that the certain copies
leave. A document that would pass the target is left out and the ranking goes on among
those that still fit, until none does. One more document, the one that comes nearest to
the words still missing, then closes the gap if that brings the source nearer.

All sums are made by Spark over narrow rows; the driver sees three totals per
round of the sharing. The decision about a document depends on its own row and on
one row per source, so texts are never shuffled.

Defined results. A null text has size 0 and takes no words. A null source is a
source of its own and comes last. Rows alike in id and text have one random number
and one fate, and where they no longer fit together the ranking of their source ends; rows
without an id, or that share one, are drawn by their texts. Very long
texts count whole. Empty sources have target 0. An empty table gives no rows. Columns
of the documents that are named like one of the five added ones are replaced; any other
name passes through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.columns import attach, saved, text_key, text_or_empty, uniform, word_count
from tenure.llm.selection import cut_points


ADDED = ("size", "source_size", "target", "copies", "taken")


@dataclass(frozen=True)
class Mix:
    """Sources in code point order weigh ``weights``, repeating."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    max_copies: float = 2.0
    seed: int = 7


def _group(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def ranked(frame: DataFrame, *order: Column) -> DataFrame:
    """The frame with ``place``, 0 and up in the given order, without a single task."""
    ordered = saved(frame.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        ordered.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("place", F.col("_start") + place)
        .drop("_id", "_part", "_start")
    )


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """``_g, source_size, target`` for rows of ``_source, _g, size``, saved."""
    totals = sized.groupBy("_g").agg(
        F.first("_source").alias("_source"), F.sum("size").alias("source_size")
    )
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    weighed = saved(
        ranked(totals, F.col("_source").asc_nulls_last()).select(
            "_g",
            "source_size",
            F.get(weights, (F.col("place") % len(mix.weights)).cast("int")).alias("_weight"),
        )
    )
    most = mix.max_copies * F.col("source_size")
    total, weight = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    words = mix.share * float(total or 0)
    level = words / weight if weight else 0.0
    while True:
        full = most <= F.lit(level) * F.col("_weight")
        taken, left = weighed.agg(
            F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        higher = (words - (taken or 0.0)) / left if left else float("inf")
        if higher <= level or higher == float("inf"):
            level = max(level, higher)
            break
        level = higher
    target = F.least(most, F.lit(level) * F.col("_weight")) if level != float("inf") else most
    return saved(weighed.select("_g", "source_size", target.alias("target")))


def _expected(mix: Mix) -> Column:
    return F.least(F.lit(mix.max_copies), F.col("_scale") * F.col("_preference"))


def _scales(sized: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``_scale``, by which expected copies add up to each source's target."""
    state = saved(targets.withColumn("_scale", F.lit(0.0)))
    while True:
        rows = attach(sized, state, "_g")
        full = _expected(mix) >= mix.max_copies
        sums = rows.groupBy("_g").agg(
            F.sum(F.when(full, F.col("size") * mix.max_copies).otherwise(0.0)).alias("_taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("_preference"))).alias("_left"),
        )
        step = F.when(
            F.col("_left") > 0, (F.col("target") - F.col("_taken")) / F.col("_left")
        ).otherwise(F.col("_scale"))
        found = saved(
            state.join(sums, "_g").select(
                "_g", "source_size", "target",
                F.greatest("_scale", step).alias("_scale"),
                (step > F.col("_scale") * (1 + 1e-12)).alias("_more"),
            )
        )
        state = found.drop("_more")
        if found.filter("_more").isEmpty():
            return state


def plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: size, target, scale, the cut of the ranking, the closing place.

    ``sized`` holds ``_source, _g, size, _preference, _u`` and should be saved.
    """
    scaled = _scales(sized, source_targets(sized, mix), mix)
    rows = attach(sized, scaled, "_g").select("_g", "size", *_sampled(mix))
    certain = rows.groupBy("_g").agg(F.sum(F.col("_sure") * F.col("size")).alias("_certain"))
    state = scaled.join(certain, "_g").withColumn(
        "budget", F.greatest(F.col("target") - F.col("_certain"), F.lit(0.0))
    )
    chances = saved(rows.filter("_rank IS NOT NULL AND size > 0").select("_g", "_rank", "size"))
    gaps = _filled(chances, state.select("_g", F.col("budget").alias("_gap")))
    closing = (
        _left(chances, gaps)
        .groupBy("_g", "_rank", "_gap")
        .agg(F.sum("size").alias("_words"))
        .filter("_words < 2 * _gap")
        .groupBy("_g")
        .agg(F.min(F.struct(F.abs(F.col("_gap") - F.col("_words")), "_rank")).alias("_near"))
        .select("_g", F.col("_near._rank").alias("_closing"))
    )
    return saved(
        scaled.join(gaps.select("_g", "_steps"), "_g", "left").join(closing, "_g", "left").select(
            "_g", "source_size", "target", "_scale", "_steps",
            F.coalesce("_closing", F.lit(-1.0)).alias("_closing"),
        )
    )


def _taken(size: Column, rank: Column, steps: Column) -> Column:
    """Whether one of the steps, each with the longest size and the rank below which it takes, takes a document."""
    return F.exists(steps, lambda s: (size <= s["most"]) & (rank < s["cut"]))


def _left(chances: DataFrame, gaps: DataFrame) -> DataFrame:
    """The documents that no step has taken, with their source's gap and steps."""
    rows = attach(chances, gaps, "_g")
    return rows.filter(~_taken(F.col("size"), F.col("_rank"), F.col("_steps")))


def _filled(chances: DataFrame, gaps: DataFrame) -> DataFrame:
    """``_g, _gap, _steps``: how far down the ranking goes, and the words still missing.

    A step takes by rank, among the documents left that fit by themselves, as many as
    fit together; so each leaves a gap below the size of one of them. A source is done when
    a step takes nothing. As ranks are random, the number of steps is about the logarithm of
    the number of documents. ``gaps`` holds ``_g, _gap``.
    """
    none = F.expr("CAST(array() AS array<struct<most: double, cut: double>>)")
    gaps = saved(gaps.withColumns({"_steps": none, "_open": F.lit(True)}))
    while True:
        fitting = saved(_left(chances, gaps.filter("_open")).filter("size <= _gap").select("_g", "_rank", "size"))
        if fitting.isEmpty():
            return gaps
        cuts = saved(cut_points(fitting, "_g", "_rank", "size", gaps.select("_g", F.col("_gap").alias("budget"))))
        taken = attach(fitting, cuts, "_g").filter("_rank < cut").groupBy("_g")
        step = F.struct(F.col("_gap").alias("most"), F.col("cut"))
        gaps = saved(
            gaps.join(cuts.select("_g", "cut"), "_g", "left")
            .join(taken.agg(F.sum("size").alias("_words")), "_g", "left")
            .select(
                "_g",
                (F.col("_gap") - F.coalesce("_words", F.lit(0))).alias("_gap"),
                F.when(F.col("cut").isNull(), F.col("_steps")).otherwise(F.array_append("_steps", step)).alias("_steps"),
                F.col("_words").isNotNull().alias("_open"),
            )
        )


def _sampled(mix: Mix) -> list[Column]:
    """Certain copies, and the rank of a document's chance of one more, in (0, 1)."""
    expected = _expected(mix)
    chance = expected - F.floor(expected)
    odds = (F.col("_u") / (1 - F.col("_u"))) * ((1 - chance) / chance)
    rank = F.when(chance > 0, odds / (1 + odds))
    return [F.floor(expected).alias("_sure"), rank.alias("_rank")]


def mix_sources(
    documents: DataFrame,
    mix: Mix = Mix(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    preference_col: str | None = None,
) -> DataFrame:
    """The documents with ``size, source_size, target, copies`` and ``taken`` words.

    ``preference_col`` holds positive numbers; null counts as 1.
    """
    preference = F.coalesce(F.col(preference_col), F.lit(1.0)) if preference_col else F.lit(1.0)
    added = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("_row"),
        word_count(text_or_empty(text_col)).alias("size"),
        F.col(source_col).alias("_source"),
        _group(F.col(source_col)).alias("_g"),
        preference.cast("double").alias("_preference"),
        uniform(id_col, text_key(F.col(text_col)), seed=mix.seed).alias("_u"),
    )
    sized = saved(added.select("_source", "_g", "size", "_preference", "_u"))
    found = attach(added, plan(sized, mix), "_g").withColumns(
        {"_sure": _sampled(mix)[0], "_rank": _sampled(mix)[1]}
    )
    extra = (F.col("size") > 0) & F.col("_rank").isNotNull() & (
        F.coalesce(_taken(F.col("size"), F.col("_rank"), F.col("_steps")), F.lit(False))
        | (F.col("_rank") == F.col("_closing"))
    )
    copies = (F.col("_sure") + F.when(extra, 1).otherwise(0)).cast("long")
    # Before the row is unpacked: in a lambda, a column of the same select that is named alike would come first.
    found = found.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    given = [c for c in documents.columns if c not in ADDED]
    return found.select(*(F.col("_row").getField(c).alias(c) for c in given), *ADDED)
