"""Cross-site boilerplate lines: how many distinct sites show a line.

A line (hash of its text) gets a HyperLogLog sketch of its sites; sketches merge by aggregation, so nothing is held per site.  The sketch decides lines
whose estimate is clearly under or over the threshold; lines within the margin get an exact distinct count.  Boilerplate lines leave the texts.

Lines end at a line feed.  Empty lines stay.  A null site is no site; null texts are null afterwards and have no lines; documents keep their other columns,
whatever they are called; repeated rows are treated alike; an empty table gives an empty table.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
LG_K = 10


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """``_line`` (hash) of the lines that at least ``min_sites`` sites show.

    A line seen on one site only leaves before any sketch is made (minimum and maximum site are equal, a plain aggregate).  ``margin`` is six standard
    errors of the sketch at most (1.04 / sqrt(2^LG_K) = 3.3 %), so lines outside it are decided rightly.
    """
    shown = docs.where(F.col(site_col).isNotNull()).select(F.xxhash64(F.col(site_col).cast("string")).alias("_site"), F.explode(F.array_distinct(line_hashes(F.col(text_col)))).alias("_line")).where("_line is not null")
    pairs = shown.groupBy("_line", "_site").agg(F.lit(1).alias("_one"))  # each task sends a line and site once
    wide = pairs.groupBy("_line").agg(F.min("_site").alias("_a"), F.max("_site").alias("_b")).where("_a <> _b").select("_line")
    spread = pairs.join(wide, "_line", "left_semi") if min_sites > 1 else pairs
    sketch = spread.groupBy("_line").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch")).select("_line", F.hll_sketch_estimate("_sketch").alias("_n"))
    sure = sketch.where(F.col("_n") > min_sites * (1 + margin)).select("_line")
    near = sketch.where(F.col("_n").between(min_sites * (1 - margin), min_sites * (1 + margin))).select("_line")
    exact = spread.join(near, "_line", "left_semi").groupBy("_line").agg(F.countDistinct("_site").alias("_n")).where(F.col("_n") >= min_sites).select("_line")
    return sure.unionByName(exact)


def removal(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """``docs`` with ``_bad``: the hashes of its boilerplate lines (null: none).

    The join key is the hash of the whole text: equal texts are looked up once, rows need no id.  Two texts of equal hash would share their lists, which
    removes no line that is not boilerplate.
    """
    bad = boilerplate(docs, min_sites, site_col, text_col, margin)
    lines = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("_text"), F.explode(F.array_distinct(line_hashes(F.col(text_col)))).alias("_line")).where("_line is not null")
    hits = lines.join(bad, "_line", "left_semi").groupBy("_text").agg(F.collect_set("_line").alias("_bad"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(own, F.xxhash64(text_col).alias("_text")).join(hits, "_text", "left").select("_row", "_bad")


def kept_text(text: Column, bad: Column) -> Column:
    return F.when(bad.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: (x == "") | ~F.array_contains(bad, F.xxhash64(x))), "\n"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the boilerplate lines cut from the text; a document of such lines only keeps an empty text."""
    got = removal(docs, min_sites, site_col, text_col)
    return got.select(*[(kept_text(F.col(f"_row.`{c}`"), F.col("_bad")) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; of an empty text for null)."""
    got = removal(docs.select("doc_id", "source", "text"), min_sites)
    text = F.col("_row.text")
    kept = F.coalesce(kept_text(text, F.col("_bad")), F.lit(""))
    lines = F.split(text, "\n")
    gone = F.when(F.col("_bad").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: (x != "") & F.array_contains(F.col("_bad"), F.xxhash64(x)))))
    return got.select("_row.doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"), F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT rowid_ AS r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)),
     bad AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, count(line) AS n_lines, count(line) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad USING (line)) GROUP BY r, doc_id
"""
