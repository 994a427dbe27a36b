"""Token counts under a unigram model, by dynamic programming over a trie.

A text is cut at white space into pre-tokens, each with a leading word mark. The
best segmentation of a pre-token has the highest sum of piece scores; of those the
fewest pieces. A character that is no piece costs one piece per UTF-8 byte, at the
lowest score of the vocabulary less a penalty.

Distinct pre-tokens are put into a trie, kept as the sorted pre-tokens and the
depth to which each shares its neighbour's prefix. A node's best score and piece
count are worked out once from the nodes above it, all nodes of a depth together,
and a pre-token's count is read off its last node. Where the trie has few branches
left, each goes on by itself, so that one very long pre-token costs its own length. Each task builds the tries of
its own pre-tokens and forgets the counts when it has MAX_WORDS of them, which
bounds memory and changes no count. Nothing is shuffled.

Scores are integers, so that ties are exact: a unigram model's log probabilities in
thousandths. A vocabulary without probabilities, whose scores are whole numbers or
alike for all pieces, has the negative of a piece's rank instead.

Defined results. A null or empty text has 0 words and tokens. Repeated rows give
repeated rows; an empty table gives none. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.columns import arrow_batch, texts_of

MARK = "▁"
BYTE_PENALTY = 10_000
#: Pre-tokens a task remembers, and those that one trie takes.
MAX_WORDS, CHUNK = 300_000, 100_000
#: Where so few words are left, or a depth is reached at which the numbers could outgrow 64
#: bits, each branch goes on by itself.
FEW, DEEP = 32, 100_000

#: The value of a segmentation is its score times _UNIT less its pieces.
_UNIT = 1 << 24
_NO_PIECE, _UNKNOWN = -(1 << 62), -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BASE64 = np.uint64(_BASE)

Scores = dict[str, int]


def read_scores(model_path: str) -> Scores:
    """Pieces and scores of a sentencepiece vocabulary, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    ]
    own = {i: model.get_score(i) for i in ids}
    if all(score == int(score) for score in own.values()) or len(set(own.values())) == 1:
        return {model.id_to_piece(i): -i for i in ids}
    return {model.id_to_piece(i): round(1000 * score) for i, score in own.items()}


def _hash(codes: np.ndarray) -> int:
    value = 0
    for code in codes.tolist():
        value = (value * _BASE + code + 1) % (1 << 64)
    return value


class Pieces:
    """Scores of pieces by hash, for all their endings.

    A longer ending of a prefix can only be a piece if this ending is known, so a
    search for the last piece goes back from the prefix's end until one is not.
    """

    def __init__(self, scores: Scores):
        endings: dict[int, int] = {}
        for piece in scores:
            codes = _codes(piece)
            for i in range(1, len(codes)):
                endings.setdefault(_hash(codes[i:]), _NO_PIECE)
        for piece, score in scores.items():
            endings[_hash(_codes(piece))] = score * _UNIT - 1
        self.endings = endings
        self.hashes = np.array(sorted(endings), np.uint64)
        self.values = np.array([endings[h] for h in sorted(endings)], np.int64)
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0) - BYTE_PENALTY

    def values_of(self, hashes: np.ndarray) -> np.ndarray:
        """A piece's worth, _NO_PIECE for a mere ending, _UNKNOWN for neither."""
        if not len(self.hashes):
            return np.full(len(hashes), _UNKNOWN)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], _UNKNOWN)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _branch_count(codes: np.ndarray, path: list[tuple[int, int]], pieces: Pieces) -> int:
    """Pieces at the end of a branch, given hash and best of the last nodes above it."""
    whole, endings = (1 << 64) - 1, pieces.endings
    powers = [pow(_BASE, back, 1 << 64) for back in range(pieces.longest + 1)]
    hashes = [h for h, _ in path]
    counts = [-best & (_UNIT - 1) for _, best in path]
    scores = [(best + n) // _UNIT for (_, best), n in zip(path, counts, strict=True)]
    for code in codes.tolist():
        hashed = (hashes[-1] * _BASE + code + 1) & whole
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        score, count = scores[-1] + pieces.floor * size, counts[-1] + size
        for back in range(1, len(hashes) + 1):
            worth = endings.get((hashed - hashes[-back] * powers[back]) & whole)
            if worth is None:
                break
            if worth != _NO_PIECE:
                way, more = scores[-back] + (worth + 1) // _UNIT, counts[-back] + 1
                if way > score or (way == score and more < count):
                    score, count = way, more
        hashes.append(hashed)
        scores.append(score)
        counts.append(count)
        if len(hashes) > pieces.longest:
            del hashes[0], scores[0], counts[0]
    return counts[-1]


def trie_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Pieces in the best segmentation of each pre-token; ``words`` are sorted and distinct.

    Sorted, the words are a trie: a node is the first word of those that share a
    prefix. Nodes are worked out depth by depth, each from nodes of its own path
    that lie less than a piece's length above it.
    """
    n = len(words)
    codes = _codes("".join([MARK + w for w in words]))
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    starts = np.cumsum(sizes) - sizes
    counts = np.zeros(n, np.int64)
    word = np.arange(n)
    shared = np.zeros(n, bool)  # with the word before, up to this depth
    shared[1:] = True
    alive = np.arange(n)
    reach = pieces.longest
    hashes, bests = [np.zeros(n, np.uint64)], [np.zeros(n, np.int64)]
    for depth in range(1, int(sizes.max(initial=0)) + 1):
        if depth > 1:
            alive = alive[sizes[alive] >= depth]
        if 2 * len(alive) < n:
            # Few words are this long: go on with them alone. One whose neighbour has
            # ended shares no further prefix with any word before it.
            shared = shared[alive] & np.r_[False, np.diff(alive) == 1]
            word, starts, sizes = word[alive], starts[alive], sizes[alive]
            hashes, bests = [h[alive] for h in hashes], [b[alive] for b in bests]
            n = len(alive)
            alive = np.arange(n)
        if n <= FEW or depth > DEEP:
            for i in alive.tolist():
                rest = codes[starts[i] + depth - 1 : starts[i] + sizes[i]]
                path = [(int(h[i]), int(b[i])) for h, b in zip(hashes, bests, strict=True)]
                counts[word[i]] = _branch_count(rest, path, pieces)
            break
        here = codes[starts[alive] + depth - 1]
        before = np.maximum(alive - 1, 0)
        longer = sizes[before] >= depth
        other = codes[np.where(longer, starts[before] + depth - 1, 0)]
        same = shared[alive] & longer & (other == here)
        shared[alive] = same
        nodes, char = alive[~same], here[~same]
        # Every node's hash, then its best last piece, going back a character at a time.
        hashed = hashes[-1][nodes] * _BASE64 + char + np.uint64(1)
        size = 1 + (char >= 0x80) + (char >= 0x800).astype(np.int64) + (char >= 0x10000)
        best = bests[-1][nodes] + (pieces.floor * _UNIT - 1) * size
        open_, power = np.arange(len(nodes)), 1
        for back in range(1, len(hashes) + 1):
            power = power * _BASE % (1 << 64)
            rows = nodes[open_]
            worth = pieces.values_of(hashed[open_] - hashes[-back][rows] * np.uint64(power))
            open_, rows, worth = (x[worth != _UNKNOWN] for x in (open_, rows, worth))
            if not len(open_):
                break
            way = np.where(worth == _NO_PIECE, _UNKNOWN, bests[-back][rows] + worth)
            best[open_] = np.maximum(best[open_], way)
        # Words that share the prefix take over what its first word has.
        owner = np.maximum.accumulate(np.where(same, 0, np.arange(len(alive))))
        full_hash, full_best = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        place = np.cumsum(~same) - 1
        full_hash[alive], full_best[alive] = hashed[place[owner]], best[place[owner]]
        hashes, bests = [*hashes, full_hash][-reach:], [*bests, full_best][-reach:]
        done = alive[sizes[alive] == depth]
        counts[word[done]] = -full_best[done] & (_UNIT - 1)
    return counts


class Counts(dict):
    """Token counts of the pre-tokens met so far, started anew at MAX_WORDS."""

    def __init__(self, scores: Scores):
        super().__init__()
        self.pieces = Pieces(scores)

    def add(self, words: set[str]) -> None:
        if len(self) > MAX_WORDS:
            self.clear()
        new = sorted(w for w in words if w not in self)
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            self.update(zip(part, trie_counts(part, self.pieces).tolist(), strict=True))


_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(
    documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_words, n_tokens`` of every document.

    The vocabulary is read on the driver and sent with the job; it has as many
    entries as the model's vocabulary size.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scores = rows.sparkSession.sparkContext.broadcast(read_scores(model_path))
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(scores.value)
        for batch in batches:
            words = [split_words(t) for t in texts_of(batch, "text")]
            known.add(set().union(*words))
            schema = pa.schema([batch.schema.field("id"), _OUT.field(1), _OUT.field(2)])
            yield arrow_batch(
                {
                    "id": batch.column("id"),
                    "n_words": [len(w) for w in words],
                    "n_tokens": [sum(map(known.__getitem__, w)) for w in words],
                },
                schema,
            )

    found = rows.mapInArrow(count, f"id {id_type}, n_words long, n_tokens long")
    return found.withColumnRenamed("id", id_col)


def split_words(text: str) -> list[str]:
    """The words between ASCII white space."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w.decode() for w in text.encode().split()]
