"""URL filter: rules by host and path, and a list of blocked canonical URLs.

The list is turned into a blocked Bloom filter: each URL sets a few bits of one
64-bit word, and that word is chosen by the URL's hash. Pages look up a single
word, and only those whose bits are all set and that no rule has judged go on to an
exact join with the list, which removes the false positives; all others are done.
Everything is DataFrame functions. The filter is itself a table of (word number,
word). Up to BROADCAST_WORDS words, 16 bytes each, it is sent to every executor and no
page is shuffled for it; beyond that narrow rows meet it on the word's number.

Defined results. A URL that is null or has no ``://`` has an empty host and path,
fits no rule and is never listed: ``allow``. Null and repeated list entries count
once. An empty list blocks nothing. Repeated pages give repeated rows. Very long URLs
are judged whole. Columns of the pages beyond id and URL are not read, so their names
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.columns import ascii_lower

BITS_PER_URL = 12
HASHES = 4
#: A filter of up to so many words (16 MB) is broadcast: a list of 5.5 million URLs.
BROADCAST_WORDS = 1 << 20

#: Query parameters that only say where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "ref", "fbclid", "gclid")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without page endings, kept parameters.

    Scheme, fragment and tracking parameters are dropped; an empty string if the
    URL has no host.
    """
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(?:^|&)(?:{'|'.join(TRACKING)})=[^&]*", "")
    query = F.regexp_replace(F.coalesce(query, F.lit("")), r"^&", "")
    query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    return F.when(host == "", "").otherwise(F.concat(host, path, query))


def best_rule(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """``what`` of the longest rule that fits: its host or a subdomain, its path a prefix."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        found = F.when(fits & path.startswith(rule.path), getattr(rule, what)).otherwise(found)
    return found


def _word(hashed: Column, words: Column) -> Column:
    return F.pmod(hashed, words)


def _mask(name: str) -> Column:
    """The bits that a URL sets in its word, taken from a second hash."""
    second = F.xxhash64(F.col(name), F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(HASHES):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def word_total(count: int) -> int:
    return max(1, count * BITS_PER_URL // 64)


def bloom_words(listed: DataFrame, count: int, name: str = "canonical") -> DataFrame:
    """The filter as rows ``word`` and ``bits``, for a list of ``count`` URLs."""
    words = F.lit(word_total(count)).cast("long")
    return (
        listed.select(_word(F.xxhash64(name), words).alias("word"), _mask(name).alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("bits"))
    )


def listed_urls(blocked: DataFrame) -> DataFrame:
    """The distinct canonical URLs of the frame's first column."""
    urls = blocked.select(canonical(F.col(blocked.columns[0])).alias("canonical"))
    return urls.filter(F.col("canonical") != "").distinct()


def looked_up(judged: DataFrame, listed: DataFrame, count: int) -> DataFrame:
    """Rows with ``canonical`` and ``_verdict``, and ``_possible``: may be listed, and no rule has judged."""
    words = bloom_words(listed, count)
    if word_total(count) <= BROADCAST_WORDS:
        words = F.broadcast(words)
    total = F.lit(word_total(count)).cast("long")
    rows = judged.withColumn("word", _word(F.xxhash64("canonical"), total))
    mask = _mask("canonical")
    possible = F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))
    return rows.join(words, "word", "left").select(
        *judged.columns, (possible & F.col("_verdict").isNull()).alias("_possible")
    )


def filter_urls(
    pages: DataFrame,
    blocked: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id, host, path, canonical, rule, verdict`` of every page.

    ``blocked`` has one string column of URLs in any form. A rule's verdict stands
    before the list's.
    """
    listed = listed_urls(blocked)
    url = F.col(url_col)
    judged = pages.select(
        F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        canonical(url).alias("canonical"),
    )
    judged = judged.select(
        "*",
        *(best_rule(F.col("host"), F.col("path"), rules, x).alias(f"_{x}") for x in ("name", "verdict")),
    )
    looked = looked_up(judged, listed, listed.count())

    def result(rows: DataFrame, verdict: Column) -> DataFrame:
        return rows.select(
            F.col("_id").alias(id_col), "host", "path", "canonical",
            F.col("_name").alias("rule"), verdict.alias("verdict"),
        )

    # The URLs are read once for each side; that is less than to write or shuffle them.
    met = looked.filter("_possible").join(
        listed.select("canonical", F.lit(True).alias("_listed")), "canonical", "left"
    )
    done = result(looked.filter("not _possible"), F.coalesce(F.col("_verdict"), F.lit("allow")))
    return done.unionByName(
        result(met, F.when(F.col("_listed"), "block").otherwise("allow"))
    )
