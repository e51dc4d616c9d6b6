"""URL filter: rules, then a blocked Bloom filter of listed canonical URLs whose possible hits an exact hash join confirms.

The filter is a table of 256-bit blocks (four longs), 16 bits a listed URL: a URL touches one block, so testing it is one equality join on the block
number and six bit tests.  Only rows that pass go to the exact join, which removes false positives.  Spark broadcasts the block table when its measured
size allows it, else it is joined by shuffle.

A url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed.  Repeated rows and listed URLs are fine; an empty list blocks
nothing; columns other than id and url are not read.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, PROBES = 4, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without closing slashes; null for a url without host.  Scheme, query and fragment do not count."""
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "/+$", "")))


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(what)).otherwise(verdict)
    return which, verdict


def masks(key: Column) -> list[Column]:
    """The bits of a URL in the words of its block."""
    h = F.xxhash64(key, F.lit(1))
    at = [F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for j in range(PROBES)]
    out = []
    for w in range(WORDS):
        m = F.lit(0).cast("long")
        for a in at:
            m = m.bitwiseOR(F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        out.append(m)
    return out


def block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def build(listed: DataFrame, n_blocks: int) -> DataFrame:
    """``_block`` and the words of the filter; ``listed`` has the column ``_key``."""
    return listed.select(block(F.col("_key"), n_blocks).alias("_block"), *[m.alias(f"_m{w}") for w, m in enumerate(masks(F.col("_key")))]).groupBy("_block").agg(*[F.bit_or(f"_m{w}").alias(f"_w{w}") for w in range(WORDS)])


def judge(pages: DataFrame, listed_urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed (whether the canonical url is on the list) for every row of ``pages``."""
    u = F.col(listed_col)
    listed = listed_urls.select(canonical(host(u), path(u)).alias("_key")).where("_key is not null").distinct()
    n_blocks = max(1, -(-listed.count() // 16))
    u = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host(u).alias("host"), path(u).alias("path")).withColumn("_key", canonical(F.col("host"), F.col("path")))
    keyed = rows.where("_key is not null").withColumn("_block", block(F.col("_key"), n_blocks)).join(build(listed, n_blocks), "_block", "left")
    may = F.lit(True)
    for w, m in enumerate(masks(F.col("_key"))):
        may = may & (F.coalesce(F.col(f"_w{w}"), F.lit(0).cast("long")).bitwiseAND(m) == m)
    tested = keyed.select("_id", "host", "path", "_key", may.alias("_may"))
    sure = tested.where("_may").join(listed.withColumn("_on", F.lit(True)), "_key", "left").select("_id", "host", "path", F.coalesce("_on", F.lit(False)).alias("listed"))
    rest = tested.where("not _may").select("_id", "host", "path", F.lit(False).alias("listed")).unionByName(rows.where("_key is null").select("_id", "host", "path", F.lit(False).alias("listed")))
    which, verdict = rule(F.col("host"), F.col("path"), rules)
    return sure.unionByName(rest).select(F.col("_id").alias(id_col), "host", "path", which.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: A page that shows runs of filler marks puts its url on the list of the registered query.
FILLER = "[%#&$*]{3}"


def spam_list(pages: DataFrame) -> DataFrame:
    return pages.where(F.regexp_replace("html", "&amp;", "&").rlike(FILLER)).select("url")


SQL = f"""
WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
     k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS key FROM p),
     s AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND regexp_matches(replace(html, '&amp;', '&'), '{FILLER}')),
     r AS (SELECT k.*, s.key IS NOT NULL AS listed, CASE
             WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM k LEFT JOIN s USING (key))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
