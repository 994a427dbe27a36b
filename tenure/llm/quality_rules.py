r"""Quality rules, line first.

Every line is judged by itself: symbols in place of prose (symbol rule), no mark
that ends a sentence (punctuation rule), separators of menus and tables
(navigation rule), and short lines of site boilerplate (boilerplate rule). Failing
lines are taken out; a document that loses too large a share of its characters so
is rejected. Counts over the whole text reject documents that are too short or
repeat themselves. Only DataFrame functions run, all of them within a row, so no
text is shuffled.

Repeated three-word windows are found by sorting their hashes within the row. A
window's key holds 38 bits of its hash and its place in one number; where two
different windows share the 38 bits, or the text has over 2^26 words, the row
takes the slower sort of full hashes and places instead, with the same result.

Defined results. A null text counts as empty: no words, ``base_failed``, not kept,
and an empty cleaned text. Repeated rows give repeated rows; an empty table gives
none. Only id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.columns import SPACE, ascii_lower, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols a line may hold per 100 characters, and characters a text may lose.
MAX_SYMBOL_PERCENT = 8
MAX_LOST_PERCENT = 40
#: A line of more words is no boilerplate, whatever it mentions.
BOILERPLATE_WORDS = 40

# Fixed: the symbols counted, the white space between words, line rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
LINE_SYMBOLS = "#*$%&|<>!?{}[]^~=_\\"
SENTENCE_MARK = "[.!?:;…]"
NAVIGATION = "[|»›•·>][^|»›•·>]*[|»›•·>]"
BOILERPLATE = (
    "all rights reserved|cookie|javascript|terms of (use|service)|privacy policy"
    "|licensed under|general public license|creative commons|lorem ipsum"
    "|sign (in|up)|log in|click here|read more|subscribe"
)

_PLACE_BITS = 26
_PLACES = (1 << _PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def has_word(line: Column) -> Column:
    return F.length(without(line, SPACES)) > 0


def line_passes(line: Column) -> Column:
    """Whether a line stays. A line without a word does."""
    chars = F.length(without(line, SPACES))
    symbols = F.length(line) - F.length(without(line, LINE_SYMBOLS))
    plain = ascii_lower(line)
    words = F.regexp_count(line, F.lit(SPACE + "+")) + 1
    fails = (
        (symbols * 100 > chars * MAX_SYMBOL_PERCENT)
        | ~line.rlike(SENTENCE_MARK)
        | (line.rlike(NAVIGATION) & ~line.rlike("[.!?]"))
        | (plain.rlike(BOILERPLATE) & (words <= BOILERPLATE_WORDS))
    )
    return (chars == 0) | ~fails


def _windows(words: Column) -> Column:
    """A hash of each three words that follow one another."""
    last = F.greatest(F.size(words) - 2, F.lit(0))
    return F.transform(
        F.slice(words, 1, last),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def _equal_neighbours(ordered: str, key) -> Column:
    """Entries of a sorted array whose key the entry before or after also has."""
    near = lambda i: key(F.get(F.col(ordered), i))
    return F.filter(
        F.col(ordered),
        lambda x, i: F.coalesce(near(i - 1) == key(x), F.lit(False))
        | F.coalesce(near(i + 1) == key(x), F.lit(False)),
    )


def _with_repeat_words(frame: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows that have ``_words``."""
    keyed = frame.withColumn("_hashes", _windows(F.col("_words"))).withColumn(
        "_sorted",
        F.when(
            F.size("_hashes") <= _PLACES,
            F.sort_array(
                F.transform(
                    "_hashes",
                    lambda h, i: h.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(i.cast("long")),
                )
            ),
        ),
    )
    top = lambda x: F.shiftright(x, _PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_PLACES)).cast("int")
    full = lambda x: F.get(F.col("_hashes"), place(x))
    near = keyed.withColumn("_near", _equal_neighbours("_sorted", top))
    mixed = F.exists(
        F.transform(
            "_near",
            lambda x, i: F.coalesce(
                (top(F.get(F.col("_near"), i + 1)) == top(x))
                & (full(F.get(F.col("_near"), i + 1)) != full(x)),
                F.lit(False),
            ),
        ),
        lambda b: b,
    )
    clean = near.withColumn("_exact", F.coalesce(~mixed, F.lit(False)))
    slow = clean.withColumn(
        "_pairs",
        F.when(
            ~F.col("_exact"),
            F.sort_array(
                F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    )
    places = F.when(F.col("_exact"), F.transform("_near", place)).otherwise(
        F.transform(_equal_neighbours("_pairs", lambda x: x["h"]), lambda x: x["i"])
    )
    covered = F.transform(places, lambda p: F.array(p, p + 1, p + 2))
    return slow.withColumn(
        "n_repeat_words", F.size(F.array_distinct(F.flatten(covered))).cast("long")
    ).drop("_hashes", "_sorted", "_near", "_exact", "_pairs")


def clean_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, cleaned ``text``, the counts, ``lost_chars``, ``base_failed`` and ``kept``."""
    base = documents.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    split = base.select(
        "*", words_of(F.col("_text")).alias("_words"), F.split("_text", "\n", -1).alias("_lines")
    )
    counted = _with_repeat_words(split).withColumn(
        "_real", F.filter("_lines", has_word)
    ).withColumn("_passed", F.filter("_lines", line_passes))
    measured = counted.select(
        F.col("_id").alias(id_col),
        F.array_join("_passed", "\n").alias(text_col),
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS)))
        .cast("long")
        .alias("n_symbols"),
        (F.size("_real") - F.size(F.array_distinct("_real"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    lost = F.col("word_chars") - F.length(without(F.col(text_col), SPACES))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    judged = measured.select("*", lost.alias("lost_chars"), failed.alias("base_failed"))
    return judged.withColumn(
        "kept",
        ~F.col("base_failed")
        & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")),
    )
