"""Benchmark decontamination by q-gram counting and banded alignment.

A document is contaminated if it holds a window of WINDOW characters of a benchmark
text, or the whole of a shorter one, within an edit budget of one edit per
CHARS_PER_EDIT characters. Letter case (ASCII and Latin-1) and the amount of white
space do not count.

By the q-gram lemma, a window of w characters with at most k edits shares at least
w + 1 - q (k + 1) q-grams with its match, on at most k + 1 neighbouring diagonals.
The first pass keeps the regions of a document in which so many of its q-grams are
set in a bit map of all benchmark q-grams. The second looks the region's q-grams up
in an index, counts them per benchmark text in diagonal bands that overlap by half,
so that any k + 1 diagonals lie in one band, and aligns every window whose count
meets the bound within the band. A window that aligns covers the document from its
first shared q-gram to its last; those of one item that overlap make one span.

A bit map takes MAP_CHARS characters of benchmark text, so that it is at most about a
sixteenth full; a larger benchmark comes in groups with a map each, and the documents
are read once per group. The index comes in blocks of about BLOCK_CHARS characters;
only a group's regions, few and saved, meet its blocks. Long benchmark texts are cut
into overlapping pieces that no window can miss. No text is shuffled to find matches;
``row_filter`` says how rows are left out.

Items below SHORTEST characters are compared exactly, in one case and with single
spaces. From Q characters up they count wherever they stand as whole words (between two
letters or digits below U+2000 no word begins or ends); shorter ones, which share no
q-gram and would be found in any text, where they are the whole document. They are
looked up by rolling hashes at word starts, SHORT_BLOCK items at a time.

Defined results. A null or empty text is clean. Benchmark rows that are null or hold only
white space are no passages. Benchmark rows that share an id are one item; short items alike
go by their smallest id. A row's result depends on its own text, also where ids are null or
repeated; repeated rows stay. Very long texts are searched whole. Empty tables give clean
documents or no rows. Only id and text are read, so that other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.columns import arrow_batch, saved, text_key, texts_of
from tenure.llm.row_filter import named_rows

Q, WINDOW, CHARS_PER_EDIT, SHORTEST = 8, 96, 20, 32
BLOCK_CHARS, PIECE_CHARS = 1_000_000, 10_000
MAX_MAP_BITS, MAP_CHARS = 26, 1 << 22
#: Short items that are sent to the tasks at a time.
SHORT_BLOCK = 100_000
#: Lengths at which the thresholds of shorter benchmark texts change.
_CLASSES = ((32, 48), (48, 64), (64, 80), (80, WINDOW), (WINDOW, WINDOW + 1))

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_CHAR = np.uint32(0xFFFFFFFF)


def budget(window: int) -> int:
    return window // CHARS_PER_EDIT


def least_shared(window: int) -> int:
    """q-grams that a match of a window must share with it."""
    return window + 1 - Q * (budget(window) + 1)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in one case with single spaces, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = ((codes >= 65) & (codes <= 90)) | ((codes >= 192) & (codes <= 222) & (codes != 215))
    space = ((codes >= 9) & (codes <= 13)) | (codes == 32)
    codes = np.where(space, np.uint32(32), codes + upper * np.uint32(32))
    if len(codes):
        keep = np.flatnonzero(~(space & np.r_[True, space[:-1]]))
        return codes[keep], keep
    return codes, np.zeros(0, np.int64)


def grams(codes: np.ndarray) -> np.ndarray:
    """A number per q-gram: equal q-grams have equal numbers."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    low = ((codes ^ (codes >> np.uint32(8)) * np.uint32(167)) & np.uint32(255)).astype(np.uint64)
    two = low[:-1] << np.uint64(8) | low[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return four[:-4] << np.uint64(32) | four[4:]


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - size)


def pieces(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, offset, text``: benchmark texts, long ones cut with an overlap of two windows."""
    text = F.col(text_col)
    last = F.greatest(F.length(text) - 1, F.lit(0))
    start = F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_CHARS)))
    rows = benchmark.filter(F.length(text) >= SHORTEST)
    cut = rows.select(F.col(id_col).alias("item"), text.alias("_t"), start.alias("offset")).select(
        "item", "offset", F.substring("_t", F.col("offset") + 1, F.lit(PIECE_CHARS + 2 * WINDOW)).alias("text")
    )
    return cut.distinct()


def short_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, text`` of the items below SHORTEST characters, in one case and with single spaces, each text once."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    id_type = rows.schema["item"].dataType.simpleString()

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [normal(t)[0] for t in texts_of(batch, "text")]
            kept = [i for i, c in enumerate(codes) if 0 < len(c) < SHORTEST]
            schema = pa.schema([batch.schema.field("item"), ("text", pa.string())])
            items = batch.column("item").take(pa.array(kept, pa.int64()))
            yield arrow_batch({"item": items, "text": [_plain(codes[i]) for i in kept]}, schema)

    found = rows.mapInArrow(shorten, f"item {id_type}, text string").filter("text <> ''")
    return found.groupBy("text").agg(F.min("item").alias("item"))


def _plain(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").rstrip(" ")


class ShortItems:
    """Short items by their texts, and the hashes of each length."""

    def __init__(self, texts: list[str]):
        self.number = {t: i for i, t in enumerate(texts)}
        coded = [normal(t)[0] for t in texts if len(t) >= Q]
        hashes: dict[int, list[int]] = {}
        for codes in coded:
            hashes.setdefault(len(codes), []).append(int(_rolled(codes, np.zeros(1, np.int64), len(codes))[-1][0]))
        self.hashes = {size: np.unique(np.array(h, np.uint64)) for size, h in hashes.items()}

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``item, start, end, 0`` of every short item in a normal text."""
        plain = _plain(codes)
        if len(plain) < Q:
            return [(self.number[plain], 0, len(plain), 0)] if plain in self.number else []
        codes = codes[: len(plain)]
        letter = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | ((codes >= 192) & (codes < 0x2000))
        edge = np.r_[True, ~(letter[1:] & letter[:-1]), True]
        starts = np.flatnonzero(edge[:-1])
        found = []
        for size, rolled in enumerate(_rolled(codes, starts, max(self.hashes, default=0)), 1):
            if size not in self.hashes:
                continue
            at = starts[: len(rolled)]
            for start in at[edge[at + size] & np.isin(rolled, self.hashes[size])].tolist():
                number = self.number.get(plain[start : start + size])
                if number is not None:
                    found.append((number, start, start + size, 0))
        return found


def _rolled(codes: np.ndarray, starts: np.ndarray, longest: int) -> list[np.ndarray]:
    """A hash of the 1, 2, ... ``longest`` characters from each of the ascending places that has so many."""
    wide, value = codes.astype(np.uint64), np.zeros(len(starts), np.uint64)
    found = []
    for size in range(1, longest + 1):
        left = int(np.searchsorted(starts, len(codes) - size, "right"))
        value = value[:left] * _MIX + wide[starts[:left] + size - 1] + np.uint64(1)
        found.append(value)
    return found


def exact_matches(documents: DataFrame, items: list[str]) -> DataFrame:
    """The places of short items in ``id, key, text`` rows."""
    sent = documents.sparkSession.sparkContext.broadcast(items)
    id_type = documents.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = ShortItems(sent.value)
        for batch in batches:
            yield _found(batch, short.matches)

    return documents.mapInArrow(find, _found_type(id_type))


def gram_map(parts: DataFrame, chars: int) -> np.ndarray:
    """A bit per hashed benchmark q-gram, packed in bytes."""
    size = min(MAX_MAP_BITS, max(16, (16 * chars).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])
        for batch in batches:
            for text in texts_of(batch, "text"):
                at = np.unique(_bits(grams(normal(text)[0]), size))
                one = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield arrow_batch({"word": (at >> np.uint64(6)).astype(np.int64), "bits": one}, schema)

    found = parts.select("text").mapInArrow(words, "word long, bits long")
    table = np.zeros((1 << size) // 64, np.int64)
    for word, bits in found.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        table[word] = bits
    return table.view(np.uint8)


def suspect_regions(hits: np.ndarray) -> list[tuple[int, int]]:
    """Stretches ``start, end`` of q-gram places in which a match could lie."""
    total = np.zeros(len(hits) + 1, np.int64)
    np.cumsum(hits, out=total[1:])
    marks = np.zeros(len(hits) + 1, np.int64)
    for low, high in _CLASSES:
        need = least_shared(low)
        reach = min(len(hits), high - Q + budget(high - 1))
        if total[-1] < need or reach <= 0:
            continue
        starts = np.flatnonzero(total[reach:] - total[:-reach] >= need)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + reach, -1)
    inside = np.cumsum(marks[:-1]) > 0
    if not inside.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def regions(documents: DataFrame, table: np.ndarray) -> DataFrame:
    """``id, key, start, text``: the parts of documents that could match, in place."""
    sent = documents.sparkSession.sparkContext.broadcast(table)
    size = (len(table) * 8).bit_length() - 1
    id_type = documents.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            rows, starts, texts = [], [], []
            for row, text in enumerate(texts_of(batch, "text")):
                if len(text) < SHORTEST - budget(SHORTEST):
                    continue
                codes, origin = normal(text)
                at = _bits(grams(codes), size)
                hits = bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                for a, b in suspect_regions(hits):
                    first = int(origin[max(0, a - Q)])
                    last = int(origin[min(len(origin), b + 2 * Q) - 1]) + 1
                    rows.append(row)
                    starts.append(first)
                    texts.append(text[first:last])
            names = [batch.schema.field(n) for n in ("id", "key")]
            schema = pa.schema([*names, ("start", pa.int64()), ("text", pa.string())])
            of = {f.name: batch.column(f.name).take(pa.array(rows, pa.int64())) for f in names}
            yield arrow_batch({**of, "start": starts, "text": texts}, schema)

    return documents.mapInArrow(find, f"id {id_type}, key string, start long, text string")


class Index:
    """q-grams of some benchmark pieces, sorted."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        keys = [grams(c) for c in items]
        sizes = [len(k) for k in keys]
        every = np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)[order]
        self.place = np.concatenate([*(np.arange(n, dtype=np.int32) for n in sizes), np.zeros(0, np.int32)])[order]

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``place in the region, item, place in the item`` of every shared q-gram."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(keys)), n), self.item[at], self.place[at]


def alignments(pattern: np.ndarray, text: np.ndarray, start: int, width: int, window: int) -> np.ndarray:
    """Edits between each window of a pattern and a part of the text, in ``width`` diagonals from ``start``."""
    m, n = len(pattern), len(pattern) - window + 1
    padded = np.full(m + width - 1, _NO_CHAR)
    a, b = max(0, start), min(len(text), start + len(padded))
    if b > a:
        padded[a - start : b - start] = text[a:b]
    differs = np.lib.stride_tricks.sliding_window_view(padded, m) != pattern
    # A row per diagonal, less its number, so that an edit to the next one costs nothing more.
    steps = np.arange(width, dtype=np.int8 if window + width < 128 else np.int64)[:, None]
    row = np.repeat(-steps, n, axis=1)
    for i in range(window):
        new = row + differs[:, i : i + n]
        new[:-1] = np.minimum(new[:-1], row[1:] + 2)
        reach = 1
        while reach < width:
            new[reach:] = np.minimum(new[reach:], new[:-reach])
            reach *= 2
        row = new
    return (row + steps).min(axis=0)


def aligned(pattern: np.ndarray, text: np.ndarray, start: int, width: int) -> int:
    """Edits between a whole pattern and a part of the text."""
    return int(alignments(pattern, text, start, width, len(pattern))[0])


def merged(start: np.ndarray, end: np.ndarray, edits: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans in order, overlapping ones as one with the fewest edits of any."""
    order = np.argsort(start, kind="stable")
    start, end, edits = start[order], end[order], edits[order]
    cuts = np.flatnonzero(np.r_[True, start[1:] >= np.maximum.accumulate(end)[:-1]])
    ends, least = np.maximum.reduceat(end, cuts), np.minimum.reduceat(edits, cuts)
    return list(zip(start[cuts].tolist(), ends.tolist(), least.tolist(), strict=True))


def matches(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """``item, start, end, edits`` of every span of each benchmark piece in a region."""
    place, item, at = index.hits(grams(codes))
    found = []
    order = np.argsort(item, kind="stable")
    cuts = np.flatnonzero(np.diff(item[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        which = int(item[part[0]])
        window = min(WINDOW, len(index.items[which]))
        need, edits = least_shared(window), budget(window)
        if window < SHORTEST or len(part) < need:
            continue
        spans = list(_windows(place[part], at[part], codes, index.items[which], window, need, edits))
        if spans:
            found += [(which, *m) for m in merged(*map(np.concatenate, zip(*spans, strict=True)))]
    return found


def _windows(place, at, codes, pattern, window, need, edits):
    """``start, end, edits`` arrays of all windows that align, by band."""
    width = edits + 1
    band = (place - at) // width
    # A pair of bands whose first one is empty has no hits that the next pair lacks.
    names, sizes = np.unique(band, return_counts=True)
    after = np.append(np.where(np.diff(names) == 1, sizes[1:], 0), 0)
    for low in names[sizes + after >= need].tolist():
        inside = np.flatnonzero((band == low) | (band == low + 1))
        inside = inside[np.argsort(at[inside], kind="stable")]
        hit_at, hit_place = at[inside], place[inside]
        earliest = max(0, int(hit_at[0]) + Q - window)
        starts = np.arange(earliest, min(int(hit_at[-1]), len(pattern) - window) + 1)
        from_, to = np.searchsorted(hit_at, starts), np.searchsorted(hit_at, starts + window - Q, "right")
        tried = np.flatnonzero(to - from_ >= need)
        if not len(tried):
            continue
        for part in np.split(tried, np.flatnonzero(np.diff(tried) > window) + 1):
            first, last = int(starts[part[0]]), int(starts[part[-1]])
            at_text = first + low * width - edits
            stretch = pattern[first : last + window]
            cost = alignments(stretch, codes, at_text, 2 * width + 2 * edits, window)[part - part[0]]
            right = part[cost <= edits]
            if len(right):
                ranges = np.stack([from_[right], to[right]], axis=1).reshape(-1)
                ended = np.append(hit_place, 0)
                low_place = np.minimum.reduceat(ended, ranges)[::2]
                yield low_place, np.maximum.reduceat(ended, ranges)[::2] + Q, cost[cost <= edits]


def _found_type(id_type: str) -> str:
    return f"id {id_type}, key string, piece long, start long, end long, edits long"


def _found(batch: pa.RecordBatch, find: Callable[[np.ndarray], Iterable[tuple[int, int, int, int]]]) -> pa.RecordBatch:
    """``piece, start, end, edits`` of each row's matches, in places of the document, which ``start`` of the row opens."""
    rows, out = [], {"piece": [], "start": [], "end": [], "edits": []}
    opens = batch.column("start").to_pylist() if "start" in batch.schema.names else [0] * batch.num_rows
    for row, text in enumerate(texts_of(batch, "text")):
        codes, origin = normal(text)
        for which, start, end, edits in find(codes):
            rows.append(row)
            out["piece"].append(which)
            out["start"].append(opens[row] + int(origin[start]))
            out["end"].append(opens[row] + int(origin[end - 1]) + 1)
            out["edits"].append(edits)
    names = [batch.schema.field(n) for n in ("id", "key")]
    schema = pa.schema([*names, *((k, pa.int64()) for k in out)])
    of = {f.name: batch.column(f.name).take(pa.array(rows, pa.int64())) for f in names}
    return arrow_batch({**of, **out}, schema)


def verified(candidates: DataFrame, items: list[str]) -> DataFrame:
    """The matches of saved regions with one block of pieces."""
    sent = candidates.sparkSession.sparkContext.broadcast(items)
    id_type = candidates.schema["id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([normal(t)[0] for t in sent.value])
        for batch in batches:
            yield _found(batch, lambda codes: matches(codes, index))

    return candidates.mapInArrow(verify, _found_type(id_type))


def maximal(found: DataFrame) -> DataFrame:
    """The spans with overlapping ones of a row and item, from pieces or regions that overlap, as one."""
    row = ["id", "key", "item"]
    once = found.groupBy(*row, "start", "end").agg(F.min("edits").alias("edits"))
    order = Window.partitionBy(*row).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = once.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("long"))
    numbered = opens.withColumn("_number", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*row, "_number").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits")
    )
    return spans.drop("_number")


def _divided(rows: DataFrame, number: int, seed: int) -> Iterator[DataFrame]:
    """The rows in ``number`` parts of about equal size, by a hash of the whole row."""
    part = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(max(1, number)))
    for i in range(number):
        yield rows.filter(part == i)


def contaminated_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, key, item, start, end, edits`` of every match, saved; places in code points.

    A match is a maximal span of overlapping windows of one item; its edits are the fewest
    of any of them. ``key`` is the ``text_key`` of the document's text.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")
    )
    parts = saved(pieces(benchmark, item_col, item_text_col))
    short = saved(short_items(benchmark, item_col, item_text_col))
    id_type, item_type = (f.dataType.simpleString() for f in (rows.schema["id"], parts.schema["item"]))
    found = spark.createDataFrame([], f"id {id_type}, key string, item {item_type}, start long, end long, edits long")

    def named(hits: DataFrame, items: list) -> DataFrame:
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(items)], f"piece long, item {item_type}")
        return hits.join(F.broadcast(names), "piece").drop("piece")

    chars = int(parts.agg(F.sum(F.length("text"))).first()[0] or 0)
    for group in _divided(parts, -(-chars // MAP_CHARS), seed=1):
        candidates = saved(regions(rows, gram_map(group, min(chars, MAP_CHARS))))
        for block in _divided(group, -(-min(chars, MAP_CHARS) // BLOCK_CHARS), seed=2):
            items = block.collect()
            if items:
                found = found.unionByName(named(verified(candidates, [r["text"] for r in items]), items))
    for block in _divided(short, -(-short.count() // SHORT_BLOCK), seed=3):
        items = block.collect()
        found = found.unionByName(named(exact_matches(rows, [r["text"] for r in items]), items))
    return saved(maximal(found))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """``id, contaminated, items, spans`` of every document row."""
    spans = contaminated_spans(documents, benchmark, id_col, text_col, item_col)
    span = F.struct("start", "end", "item", "edits")
    per_document = spans.groupBy(F.col("id").alias("_hit"), F.col("key").alias("_hit_key")).agg(
        F.sort_array(F.collect_set("item")).alias("items"),
        F.sort_array(F.collect_set(span)).alias("spans"),
    )
    rows = documents.select(F.col(id_col), text_key(F.col(text_col)).alias("_key"))
    same = F.col(id_col).eqNullSafe(F.col("_hit")) & (F.col("_key") == F.col("_hit_key"))
    return rows.join(per_document, same, "left").select(
        id_col,
        F.col("spans").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array()).alias("items"),
        F.coalesce(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), F.array()).alias("spans"),
    )


def clean_documents(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without the contaminated ones."""
    spans = contaminated_spans(documents, benchmark, id_col, text_col)
    names = spans.select(F.col("id").alias("_named_id"), F.col("key").alias("_named_key"))
    return named_rows(documents, saved(names.distinct()), id_col, text_col, without=True)
