r"""Secret scans: fixed patterns, and character Markov models of what looks random.

The patterns find values given to a name such as ``password``, access key ids and
long hexadecimal strings. First-order Markov models of characters are trained from
labelled samples: the values that the patterns find are random strings, words of the
rest of the corpus and of the names in public Python modules are what identifiers are
made of. There is an ordinary model per naming style (small and camelCase, small with
separators, CONSTANT_CASE; as first-order counts need only a word's letter pairs, first
and last letter, a style is counted from the words' sums) and two even ones over
hexadecimal digits, for numbers, dates, UUIDs and hashes. The model of random strings is
mixed with an even one, as the labelled values use few alphabets.

Every run of identifier characters that no pattern covers is cut at separators. A part's
log-likelihood ratio is that of random to the ordinary model that explains it best, taken
over its best stretch; neighbouring parts add up. From MIN_RATIO on the parts are a
secret: the ratio alone decides, not a length. It was chosen on held-out strings: of random
letters and digits, 12 characters reach it in 92 of 100 cases and 24 in all but a few; of
the names in modules that are no sample about one in 2,000 does. Names that string together
words with digits (``Md5V2Utf8``) may. Hexadecimal strings below the pattern's 32
characters do not, as they cannot be told from hashes and ids.

Training and scanning read each text once. Tasks add up a matrix of fixed size
(PAIRS cells a class); Spark adds the tasks' cells, and the driver gets the sum.

Defined results. A null text counts as empty; texts of any length are read whole. Spans
are in code points with an exclusive end. Pattern spans of a kind do not overlap; where
spans start at one place, they are in the order of the kinds. A model span (``markov``)
never overlaps any other. Without any labelled value the random model is the even one,
without any word all letters are alike. A column ``found`` of the documents is replaced
by ``scan_secrets``; ``find_secrets`` reads no column beyond id and text. Repeated rows
give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.columns import arrow_batch, texts_of

# Fixed: names of secrets, what their values may hold, and the least lengths.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_VALUE = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_SIGN = re.compile("[:=]")
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 8

#: The log-likelihood ratio from which the best part of a run is a secret.
MIN_RATIO = 8.0

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1
PAIRS = _SIZE * _SIZE
#: Weight of the single characters' shares beside a pair's own count, and of the even model.
BACKOFF, EVEN_SHARE = 2.0, 0.95
#: Shares of separators in even random strings, of the even model in an ordinary one.
MARK_SHARE, FLOOR = 0.05, 0.01
#: The naming styles that are told apart, and how often a word holds a number or is an acronym.
STYLES = ("camel", "lower", "upper")
NUMBERED, DIGITS_GO_ON, ACRONYMS = 0.01, 0.7, 0.3
#: The least chance that a character is repeated.
REPEATED = 0.03
#: Shares of the corpus' words, of library names and of even letters in what identifiers are made of.
CORPUS_SHARE, LIBRARY_SHARE = 0.27, 0.7
#: The modules whose public names are the labelled sample of identifiers (some 5,000 names).
LIBRARY = (
    "argparse ast asyncio base64 builtins calendar codecs collections concurrent.futures configparser contextlib "
    "csv datetime decimal difflib email.message email.policy errno fractions functools glob gzip hashlib html "
    "html.entities http http.client http.cookies inspect io ipaddress itertools json keyword locale logging "
    "logging.handlers mailbox math mimetypes multiprocessing operator os pathlib pickle platform plistlib "
    "queue random re sched select selectors shutil signal smtplib socket sqlite3 ssl stat statistics string struct "
    "subprocess sysconfig tarfile tempfile textwrap threading time token tokenize trace traceback types typing "
    "unicodedata unittest unittest.mock urllib.parse urllib.request uuid weakref xml.dom xml.etree.ElementTree "
    "xml.sax zipfile zlib pyspark.sql.functions pyspark.sql.types pyspark.sql.streaming"
).split()

_CODES = np.zeros(256, np.uint16)
_CODES[list(_ALPHABET)] = np.arange(1, _SIZE)
_IS_HEX = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_SEPARATORS = b"+/_=-."
_UPPER, _LOWER = _CODES[65:91].astype(int), _CODES[97:123].astype(int)
_DIGITS = _CODES[48:58].astype(int)
_MARKS = _CODES[list(_SEPARATORS)].astype(int)

Span = tuple[int, int, int, int]


def _named(text: str, end: int) -> int | None:
    """Where the secret's name starts that ends, quote and blanks aside, at ``end``."""
    while end and text[end - 1] == " ":
        end -= 1
    for stop in (end, end - 1):
        if stop < end and (stop < 0 or text[stop] not in "\"'"):
            break
        for name in NAMES:
            start = stop - len(name)
            if start >= 0 and (found := text[start:stop]).isascii() and found.lower() == name:
                return start
    return None


def _assigned(text: str) -> list[Span]:
    """Spans ``start, kind, end, value start`` of values given to a name."""
    found, free = [], 0
    if ":" not in text and "=" not in text:
        return found
    for sign in _SIGN.finditer(text):
        start = _named(text, sign.start())
        if start is None or start < free:
            continue
        value = _VALUE.match(text, sign.end())
        if value:
            free = value.end()
            if free - value.start(1) >= MIN_VALUE:
                found.append((start, 0, free, value.start(1)))
    return found


def pattern_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, ordered by start and kind."""
    found = _assigned(text)
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    if b"h" * 32 in text.encode().translate(_IS_HEX):
        found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def transitions(text: bytes) -> np.ndarray:
    """How often each character follows each other one; 0 stands for any outside character."""
    codes = np.zeros(len(text) + 2, np.uint16)
    codes[1:-1] = _CODES[np.frombuffer(text, np.uint8)]
    return np.bincount(codes[:-1] * np.uint16(_SIZE) + codes[1:], minlength=PAIRS)


_COUNTS = pa.schema([("cell", pa.int32()), ("random", pa.int64()), ("ordinary", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random, ordinary = np.zeros(PAIRS, np.int64), np.zeros(PAIRS, np.int64)
    for batch in batches:
        for text in texts_of(batch, "text"):
            spans = pattern_spans(text)
            plain, at = [], 0
            for start, _, end, value in spans:
                random += transitions(text[value:end].encode())
                plain.append(text[at:start])
                at = max(at, end)
            plain.append(text[at:])
            ordinary += transitions(" ".join(plain).encode())
    kept = np.flatnonzero(random + ordinary)
    yield arrow_batch({"cell": kept, "random": random[kept], "ordinary": ordinary[kept]}, _COUNTS)


_WORDS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@functools.cache
def library_letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of letter pairs, first and last letters in the words of the library's names."""
    names = {n for m in LIBRARY for n in dir(importlib.import_module(m))}
    pairs, starts, ends = np.zeros((26, 26)), np.zeros(26), np.zeros(26)
    for word in sorted({w.lower() for n in names for w in _WORDS.findall(n)}):
        letters = np.frombuffer(word.encode(), np.uint8).astype(int) - ord("a")
        np.add.at(pairs, (letters[:-1], letters[1:]), 1)
        starts[letters[0]] += 1
        ends[letters[-1]] += 1
    return pairs, starts, ends


def style_counts(ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the words' characters as identifiers would have them, by naming style."""
    square = ordinary.reshape(_SIZE, _SIZE).astype(float)
    letters = np.concatenate([_UPPER, _LOWER])
    fold = np.zeros((_SIZE, 26))
    fold[_UPPER, range(26)] = fold[_LOWER, range(26)] = 1
    # Pairs within a word: a hump, small to capital, is a border between two.
    within = square.copy()
    within[np.ix_(_LOWER, _UPPER)] = 0
    pairs = fold.T @ within @ fold + 1 / 26
    others = np.setdiff1d(np.arange(_SIZE), letters)
    starts = (square[others] @ fold).sum(0) + 1 / 26
    ends = (fold.T @ square[:, others]).sum(1) + 1 / 26
    # Letters of library names beside those of the corpus, both by the corpus' number of words.
    words, inner = starts.sum(), pairs.sum()
    a_pairs, a_starts, a_ends = library_letters()
    even = 1 - CORPUS_SHARE - LIBRARY_SHARE

    def mixed(corpus: np.ndarray, library: np.ndarray, total: float) -> np.ndarray:
        shares = CORPUS_SHARE * corpus / corpus.sum() + LIBRARY_SHARE * library / library.sum()
        return total * (shares + even / corpus.size)

    pairs, starts, ends = mixed(pairs, a_pairs, inner), mixed(starts, a_starts, words), mixed(ends, a_ends, words)
    first = starts / words
    opening = pairs / pairs.sum(1, keepdims=True) * starts[:, None]

    found = {}
    for style in STYLES:
        counts = np.zeros((_SIZE, _SIZE))
        body = _UPPER if style == "upper" else _LOWER
        heads = _LOWER if style == "lower" else _UPPER
        counts[np.ix_(body, body)] += pairs
        if style == "camel":
            counts[np.ix_(_UPPER, _LOWER)] += opening
            counts[np.ix_(_LOWER, _UPPER)] += np.outer(ends, first)
            counts[np.ix_(_UPPER, _UPPER)] += ACRONYMS * opening
            counts[np.ix_(_MARKS, _LOWER)] += words * first / len(_MARKS)
        counts[np.ix_(body, _MARKS)] += ends[:, None] / len(_MARKS)
        counts[np.ix_(_MARKS, heads)] += words * first / len(_MARKS)
        counts[np.ix_(body, _DIGITS)] += NUMBERED * ends[:, None] / 10
        # Numbers go on, or a separator or a word follows.
        counts[np.ix_(_DIGITS, heads)] += NUMBERED * words * 0.25 * first / 10
        counts[np.ix_(_DIGITS, _MARKS)] += NUMBERED * words * 0.75 / 10 / len(_MARKS)
        counts[np.ix_(_DIGITS, _DIGITS)] += NUMBERED * words * DIGITS_GO_ON / (1 - DIGITS_GO_ON) / 100
        counts[np.ix_(_MARKS, _DIGITS)] += NUMBERED * words / 10 / len(_MARKS)
        counts[np.ix_(_MARKS, _MARKS)] += NUMBERED * words / len(_MARKS) ** 2
        found[style] = counts
    return found


def _chances(counts: np.ndarray) -> np.ndarray:
    square = counts.reshape(_SIZE, _SIZE)
    single = square.sum(axis=0) + 0.5
    square = square + BACKOFF * single / single.sum()
    return square / square.sum(axis=1, keepdims=True)


#: What the ratio falls by at a character that no identifier has: no part reaches across.
_CUT = -1e4


def ratio_tables(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log(random / ordinary) per pair of characters, a row for each ordinary model.

    The first is that of camelCase, which also holds small words.
    """
    even = np.full(_SIZE, (1 - MARK_SHARE) / 62)
    even[_MARKS] = MARK_SHARE / len(_MARKS)
    learned = _chances(random) if random.sum() else even
    mixed = np.log((1 - EVEN_SHARE) * learned + EVEN_SHARE * even)
    models = [_chances(c.reshape(-1)) for c in style_counts(ordinary).values()]
    for digits in (b"0123456789abcdef", b"0123456789ABCDEF"):
        hexadecimal = np.zeros((_SIZE, _SIZE))
        hexadecimal[:, _CODES[list(digits)].astype(int)] = 0.8 / len(digits)
        hexadecimal[:, _MARKS] = 0.2 / len(_MARKS)
        models.append(hexadecimal)
    tables = []
    for model in models:
        model = (1 - FLOOR) * model + FLOOR / _SIZE
        np.fill_diagonal(model, np.maximum(np.diag(model), REPEATED))
        ratio = mixed - np.log(model)
        ratio[0, :] = ratio[:, 0] = _CUT
        tables.append(ratio.reshape(-1))
    return np.array(tables)


def train(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """The ratio tables from all texts."""
    counts = (
        documents.select(F.col(text_col).alias("text"))
        .mapInArrow(_count, "cell int, random long, ordinary long")
        .groupBy("cell")
        .agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary"))
    )
    random, ordinary = np.zeros(PAIRS), np.zeros(PAIRS)
    for cell, r, o in counts.collect():
        random[cell], ordinary[cell] = r, o
    return ratio_tables(random, ordinary)


def _codes_of(text: str) -> np.ndarray:
    """A code per code point; 0 for all that identifiers do not have."""
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)].astype(np.int32)


def _peak(ratios: np.ndarray) -> np.ndarray:
    """The highest sum of neighbouring ratios, per row."""
    total = np.cumsum(ratios, axis=-1)
    before = np.concatenate([np.zeros_like(total[..., :1]), total[..., :-1]], axis=-1)
    return (total - np.minimum.accumulate(before, axis=-1)).max(axis=-1)


def best_parts(codes: np.ndarray, tables: np.ndarray) -> list[tuple[int, int, float]]:
    """The stretches of a run, from separator to separator, that reach MIN_RATIO, with their ratio.

    A part between separators is as ordinary as the best model finds it, so a run may mix
    styles. A part counts by its best stretch of characters, neighbouring ones by their sums.
    """
    if len(codes) < 2:
        return []
    ratios = tables[:, codes[:-1] * _SIZE + codes[1:]]
    marks = np.flatnonzero(np.isin(codes, _MARKS))
    edges = np.unique(np.concatenate([[0], marks, marks + 1, [len(codes)]]))
    found: list[tuple[int, int, float]] = []
    low, total, top, top_end, single = 0, 0.0, 0.0, 0, 0.0

    def close() -> None:
        if top >= MIN_RATIO:
            found.append((low, top_end, top))

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        # The step into the part belongs to it.
        own = ratios[:, max(a - 1, 0) : b - 1]
        value = float(own.sum(1).min()) if own.size else 0.0
        inner = ratios[:, a : b - 1]
        single = float(_peak(inner).min()) if inner.size else 0.0
        if single >= MIN_RATIO and total + value < single:
            close()
            low, total, top, top_end = a, single, single, b
            continue
        if total <= 0:
            close()
            low, total, top, top_end = a, 0.0, 0.0, a
        total += value
        if total > top:
            top, top_end = total, b
        elif total < top - MIN_RATIO:
            close()
            low, total, top, top_end = b, 0.0, 0.0, b
    close()
    return found


def model_spans(text: str, covered: list[Span], tables: np.ndarray) -> list[Span]:
    """The spans that the models find in what the covered spans leave free."""
    codes = _codes_of(text)
    for start, _, end, _ in covered:
        codes[start:end] = 0
    if len(codes) < 2:
        return []
    # No part is above what it is for one model; few places in prose reach the ratio for this one.
    total = np.cumsum(tables[0][codes[:-1] * _SIZE + codes[1:]])
    before = np.concatenate([[0.0], total[:-1]])
    hits = np.flatnonzero(total - np.minimum.accumulate(before) >= MIN_RATIO)
    if not len(hits):
        return []
    outside = np.concatenate([[-1], np.flatnonzero(codes == 0), [len(codes)]])
    runs = np.unique(np.searchsorted(outside, hits + 1))
    found = []
    for k in runs.tolist():
        start = int(outside[k - 1]) + 1
        for a, b, _ in best_parts(codes[start : outside[k]], tables):
            found.append((start + a, 3, start + b, start + a))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


_FOUND = pa.struct([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("n_markov", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
    ("redacted", pa.string()),
])
_FOUND_DDL = (
    "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_markov:bigint,"
    "base_sha256:string,spans:string,redacted:string>"
)
REDACTED = "[secret]"


def _redact(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for start, _, end, _ in sorted(spans):
        if start >= at:
            parts += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scanner(tables: np.ndarray, redact: bool):
    """A column function: counts and spans of a text and, if asked for, the text without them."""

    @F.arrow_udf(_FOUND_DDL)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base = pattern_spans(text or "")
            spans = sorted(base + model_spans(text or "", base, tables))
            kinds = [k for _, k, _, _ in spans]
            rows.append(
                {
                    "n_assign": kinds.count(0),
                    "n_access": kinds.count(1),
                    "n_hex": kinds.count(2),
                    "n_markov": kinds.count(3),
                    "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(),
                    "spans": written(spans),
                    "redacted": _redact(text, spans) if redact and spans else None,
                }
            )
        return pa.array(rows, _FOUND)

    return scan


def scan_secrets(
    documents: DataFrame, text_col: str = "text", tables: np.ndarray | None = None
) -> DataFrame:
    """The documents with ``found``: counts, digest and spans, and the text without secrets.

    ``found.redacted`` is null where a text has none.
    """
    tables = train(documents, text_col) if tables is None else tables
    return documents.withColumn("found", scanner(tables, True)(F.col(text_col)))


def find_secrets(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, counts, digest and spans of every document."""
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    found = rows.withColumn("found", scanner(train(rows), False)(F.col("text")))
    return found.select(F.col("_id").alias(id_col), "found.*").drop("redacted")
