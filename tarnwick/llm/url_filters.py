"""URL filters: rules by host and path, then a blocked Bloom filter before an exact join. DataFrame functions only.

``url_filter`` judges each row by its url. The rules come first: a rule fits its host and every subdomain when the
path starts with the rule's path, and the longest fitting rule decides. A url that no rule fits is blocked when its
canonical form is listed. The list may be larger than memory, so it isn't joined with every row: a blocked Bloom filter
of it (one row of four 64-bit lanes for each block) first lets through the urls that may be listed, and only those
are joined with the list itself, which removes the filter's false positives.

Cases: a null url, or one without ``://``, has an empty host and path, no canonical form and no rule, and is allowed. An empty
table gives an empty result. Equal rows are judged alike and all returned. Further columns pass through; columns
named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.columns import unused
from tarnwick.llm.graph import checkpoint

#: A Bloom filter of at most so many blocks (40 bytes each) is broadcast; a larger one is joined by its block.
BROADCAST_BLOCKS = 1 << 17
#: Listed urls for each block of four lanes of 64 bits: 16 bits a url.
URLS_PER_BLOCK = 16
_LANES = 4

#: Query parameters that don't change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+|sessionid)="


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def canonical_of(url: Column) -> Column:
    """Host without ``www.``, path without a final ``/`` or ``.html``, and the sorted query without tracking; null without a host."""
    host, path = F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"(\.html|/+)$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one. rules: (verdict, ``host/path``)."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each lane."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    bits = [F.shiftright(second, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(_LANES)]
    return F.pmod(first, F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, lane0 .. lane3: the filter of the non-null keys, one row for each block that has any."""
    block, lanes = _place(F.col(key), blocks)
    return (
        listed.where(F.col(key).isNotNull())
        .select(block.alias("block"), *(b.alias(f"lane{k}") for k, b in enumerate(lanes)))
        .groupBy("block")
        .agg(*(F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(_LANES)))
    )


def listed_flag(rows: DataFrame, key: str, listed: DataFrame, flag: str = "listed") -> DataFrame:
    """rows with a boolean that tells whether ``key`` is among ``listed``'s only column; null keys aren't.

    The distinct list is written once, as it is counted, made a filter of and joined. Rows that the filter rules out aren't shuffled, so the rows are read twice.
    """
    rows = rows.drop(flag)
    name, at, maybe, *held = unused([*rows.columns, flag], "name", "at", "maybe", *(f"lane{k}" for k in range(_LANES)))
    names = checkpoint(listed.select(F.col(listed.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct())
    blocks = -(-max(1, names.count()) // URLS_PER_BLOCK)
    bloom = bloom_filter(names, name, blocks).toDF(at, *held)
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    block, lanes = _place(F.col(key), blocks)
    probed = rows.withColumn(at, block).join(bloom, at, "left")
    inside = F.lit(True)
    for k, bit in zip(held, lanes, strict=True):
        inside = inside & (F.col(k).bitwiseAND(bit) != 0)
    probed = probed.withColumn(maybe, F.coalesce(inside & F.col(key).isNotNull(), F.lit(False))).drop(at, *held)
    never = probed.where(~F.col(maybe)).withColumn(flag, F.lit(False))
    hits = probed.where(F.col(maybe)).join(names, F.col(key) == F.col(name), "left").withColumn(flag, F.col(name).isNotNull()).drop(name)
    return never.unionByName(hits).drop(maybe)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, canonical, rule, listed and verdict (``allow`` or ``block``)."""
    rows = pages.drop("host", "path", "canonical", "rule", "listed", "verdict")
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "canonical": canonical_of(F.col(url))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said = unused([*rows.columns, "rule", "listed", "verdict"], "said")[0]
    rows = listed_flag(rows.withColumns({"rule": rule, said: verdict}), "canonical", listed)
    return rows.withColumn("verdict", F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow"))).drop(said)


def repeated_urls(pages: DataFrame, url: str = "url", least: int = 2) -> DataFrame:
    """canonical urls that at least so many rows share: mirrors and session copies, the list of the registered query."""
    return pages.select(canonical_of(F.col(url)).alias("canonical")).where("canonical is not null").groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("canonical")
