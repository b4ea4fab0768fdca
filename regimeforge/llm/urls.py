"""URL filtering: rules by host and path, then a list of URLs behind a blocked Bloom filter.

Listed and seen URLs are compared in canonical form. The filter is a table of blocks, each of WORDS
longs; a URL has one bit in every word of its block, so a look-up is one hash join and a few bit
operations. URLs that pass it are possible hits and go to an exact join on the canonical URL, which
removes the false ones; all others skip that shuffle. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Longs of a block; bits for each listed URL; the most blocks the filter may have (8 MB of longs).
WORDS, BITS, MOST_BLOCKS = 8, 16, 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``action`` (block or allow) for a host with all its subdomains, below a path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, ``www.``, fragment, tracking parameters, an index page and a slash at the end go; the other
    parameters are sorted. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda q: (q != "") & ~q.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_column(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
    return name, action


def _block(canon: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon), F.lit(blocks))


def _bits(canon: Column) -> list[Column]:
    """The long of each word that has the URL's bit set: six bits of a second hash for each word."""
    h = F.xxhash64(F.lit("bits"), canon)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def blocked_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, w1, ...): at most ``blocks`` rows, by an aggregate with partial bit-ors."""
    words = [f"w{k}" for k in range(WORDS)]
    own = listed.select(_block(F.col("canon"), blocks).alias("block"), *(b.alias(w) for b, w in zip(_bits(F.col("canon")), words, strict=True)))
    return own.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed), a row for each row of ``pages``.

    ``rule`` is the longest fitting rule or null. ``verdict`` is the rule's action; without a rule it is
    ``block`` for a listed URL and ``allow`` for others. A null URL or one without ``://`` has an empty
    host and path, fits no rule and is never listed. Null ids and repeated rows are kept as rows; null
    and repeated entries of the list do no harm; an empty list blocks nothing; other columns are ignored.
    """
    entries = common.materialize(listed.select(canonical(listed[listed_url]).alias("canon")).where("canon is not null").distinct(), "listed")
    n = entries.count()
    blocks = max(1, min(-(-n * BITS // (64 * WORDS)), MOST_BLOCKS))
    held = blocked_filter(entries, blocks)

    u = pages[url]
    seen = pages.select(pages[page_id].cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canon"))
    name, action = rule_column(rules, F.col("host"), F.col("path"))
    seen = seen.select("page_id", "host", "path", "canon", name.alias("rule"), action.alias("action"), _block(F.col("canon"), blocks).alias("block"))
    # the filter has at most MOST_BLOCKS rows whatever the list's length
    probed = seen.join(F.broadcast(held), "block", "left")
    hit = F.coalesce(F.reduce(F.array(*(F.col(f"w{k}").bitwiseAND(b) == b for k, b in enumerate(_bits(F.col("canon"))))), F.lit(True), lambda a, b: a & b), F.lit(False))
    probed = probed.select("page_id", "host", "path", "canon", "rule", "action", hit.alias("possible"))
    exact = entries.select("canon", F.lit(True).alias("listed"))
    possible = probed.where("possible").join(exact, "canon", "left")
    rest = probed.where("not possible").withColumn("listed", F.lit(False))
    out = possible.unionByName(rest)
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("action", F.when(is_listed, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), is_listed.alias("listed"))
