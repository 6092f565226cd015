"""URL filter: a blocked Bloom filter of the listed keys, then an exact hash join.

Two lists decide on a url.  ``rules`` are (host, path, verdict): a rule fits its host and every
subdomain, if the url's path starts with the rule's; the longest one wins.  ``listed`` are whole
urls to block; their canonical form is host and path, without scheme, query and fragment.

Three kinds of keys are listed: canonical urls, rules (host and path) and the hosts of rules.
Their bits go into a Bloom filter of 64-bit blocks, four bits of one block for each key, so that
a probe reads one number.  A page whose canonical url and host suffixes (one for every number of
labels a rule's host has) are all rejected is on no list: it is decided in its own row and never
shuffled.  The other pages' distinct urls make one candidate key for each *shape* of rule (labels
of the host, characters of the path), whatever the number of rules, and go through the filter
again; what passes meets the lists in an exact equi-join, which removes the false positives.

The filter is one value of at most ``MAX_BLOCKS`` blocks (8 MB), computed by Spark and handed to
the tasks as a scalar subquery: its size is bounded whatever the size of the lists.  A list too
long for it only lets more candidates through to the join; the results stay the same.

All of it is DataFrame functions.  Defined results: a null url, or one without ``://``, has an empty
host and path, is on no list and fits no rule; of equally long rules the one with the longer host
wins, of equal rules ``block``; rules with a null or empty host or a null path are left out; without a
rule the verdict is ``block`` for a listed url and ``allow`` for any other; repeated pages and null
ids keep their rows; long urls are read whole; an empty table or list is an empty table or list;
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.spans import settled
from maskweave.functions.text import ascii_lower
from maskweave.session import staged

KEYS_PER_BLOCK = 5  # about one false positive in a hundred with four bits a key
MAX_BLOCKS = 1 << 20
KEY_BITS = 4

URL, RULE, HOST = "url", "rule", "host"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    host, path = host_and_path(url)
    return F.concat(host, path)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _suffix(host: Column, labels: Column) -> Column:
    """The last ``labels`` labels of a host; the whole host where it has no more."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def usable_rules(rules: DataFrame) -> DataFrame:
    good = rules.where((F.col("host") != "") & F.col("path").isNotNull())
    return good.select(ascii_lower("host").alias("host"), "path", "verdict")


def entries(rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """(kind, key, host, path_chars, verdict): one row for each distinct key of the two lists."""
    ruled = rules.select(
        F.lit(RULE).alias("kind"),
        F.concat("host", "path").alias("key"),
        "host",
        F.length("path").alias("path_chars"),
        "verdict",
    )
    whole = listed.select(
        F.lit(URL).alias("kind"),
        canonical(F.col(url)).alias("key"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("int").alias("path_chars"),
        F.lit("block").alias("verdict"),
    )
    both = ruled.unionByName(whole.where(F.col("key") != ""))
    return both.groupBy("kind", "key", "host", "path_chars").agg(F.max("verdict").alias("verdict"))


def _place(kind: str | Column, key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, _kind(kind)), F.lit(blocks)).cast("int")


def _kind(kind: str | Column) -> Column:
    return F.lit(kind) if isinstance(kind, str) else kind


def _mask(kind: str | Column, key: Column) -> Column:
    """The bits of a key in its block."""
    h = F.xxhash64(F.lit(KEY_BITS), key, _kind(kind))
    one = F.lit(1).cast("bigint")
    bits = [
        F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * n).bitwiseAND(63).cast("int"))
        for n in range(KEY_BITS)
    ]
    return reduce(Column.bitwiseOR, bits)


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row, one column: the blocks in order, as an array, of the distinct (kind, key) rows."""
    kind, key = F.col("kind"), F.col("key")
    filled = (
        keys.select(_place(kind, key, blocks).alias("block"), _mask(kind, key).alias("mask"))
        .groupBy("block")
        .agg(F.bit_or("mask").alias("bits"))
    )
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    dense = every.join(filled, "block", "left").select(
        "block", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")
    )
    # At most MAX_BLOCKS rows meet here.
    in_order = F.sort_array(F.collect_list(F.struct("block", "bits")))
    return dense.agg(F.transform(in_order, lambda b: b["bits"]).alias("filter"))


class Filter:
    """The Bloom filter of some keys, as a test on columns."""

    def __init__(self, keys: DataFrame, n_keys: int, max_blocks: int = MAX_BLOCKS):
        self.blocks = max(1, min(max_blocks, -(-n_keys // KEYS_PER_BLOCK)))
        self.bits = staged(bloom_filter(keys, self.blocks), "url-filter").scalar()

    def passes(self, kind: str | Column, key: Column) -> Column:
        """False only for keys that are not listed."""
        mask = _mask(kind, key)
        return F.get(self.bits, _place(kind, key, self.blocks)).bitwiseAND(mask) == mask


def judged(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    good = usable_rules(rules)
    known = staged(entries(good, listed, listed_url), "url-lists")
    hosts = known.where(F.col("kind") == RULE).select(F.lit(HOST).alias("kind"), F.col("host").alias("key"))
    keys = known.select("kind", "key").unionByName(hosts.distinct())
    # Numbers of labels a rule's host has: a host name has at most 127.
    counts = known.where(F.col("kind") == RULE).select(_labels(F.col("host"))).distinct().collect()
    passing = Filter(keys, keys.count(), max_blocks)

    host, path = host_and_path(F.col(url))
    rows = settled(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), {"host": host, "path": path})
    own = F.concat("host", "path")
    suffixes = [passing.passes(HOST, _suffix(F.col("host"), F.lit(n))) for (n,) in sorted(counts)]
    may_be_listed = reduce(Column.__or__, suffixes, passing.passes(URL, own)) & (F.col("host") != "")
    probed = settled(rows.drop("url"), {"loud": may_be_listed})
    quiet = probed.where(~F.col("loud")).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")
    )
    loud = probed.where("loud").drop("loud")

    # Each distinct url makes its candidates, however many pages have it.
    shapes = (
        known.where(F.col("kind") == RULE)
        .agg(F.collect_set(F.struct(_labels(F.col("host")).alias("labels"), "path_chars")).alias("shapes"))
        .scalar()
    )
    distinct = loud.select("host", "path").distinct()
    prefixed = F.concat(
        _suffix(F.col("host"), F.col("shape.labels")),
        F.call_function("substring", F.col("path"), F.lit(1), F.col("shape.path_chars")),
    )
    of_rules = distinct.select("host", "path", F.explode(shapes).alias("shape")).select(
        "host", "path", F.lit(RULE).alias("kind"), prefixed.alias("key")
    )
    of_urls = distinct.select("host", "path", F.lit(URL).alias("kind"), own.alias("key"))
    candidates = of_rules.unionByName(of_urls)
    test = passing.passes(F.col("kind"), F.col("key"))
    possible = settled(candidates, {"passes": test}).where("passes").drop("passes")
    exact = possible.join(known.withColumnRenamed("host", "rule_host"), ["kind", "key"])
    is_rule = F.col("kind") == RULE
    rank = F.struct(F.length("key").alias("chars"), F.length("rule_host").alias("host_chars"), "verdict", "key")
    found = exact.groupBy("host", "path").agg(
        F.max(F.when(is_rule, rank)).alias("best"), F.bool_or(~is_rule).alias("is_listed")
    )
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("is_listed"), F.lit("block"))
    decided = loud.join(found, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce(verdict, F.lit("allow")).alias("verdict"),
    )
    return quiet.unionByName(decided)
