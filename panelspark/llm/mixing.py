"""Mixing sources to target weights with a low-discrepancy schedule.

Every source gets a target of words (its weight's share of 150 % of all words, at most twice its own words; what is over goes to the others by weight).
The points of a golden-ratio sequence are mapped through the cumulative targets to sources; a source's points, ranked, are its slots.  Its documents,
shuffled by hash and laid end to end, up to two times, give as many blocks of equal words, which are joined to the slots in a shuffled order.

Sizes count runs of non-blank characters; null and empty texts have size 0, take part and are never taken.  A null source is a source of its own, last.
Documents with equal ids are laid in order of their text; results do not depend on partitions or reruns.  An empty table gives an empty mix.
Only id, source and text are read.  DataFrame functions only; sources are not collected anywhere: a source's documents are summed in blocks of the hash order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, Kept, n_words

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 256
#: Fixed value: the golden ratio's fraction times 2^31.
STEP, RANGE = 1327217885, 1 << 31
CELLS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("_text"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target, and the running total of the targets.

    target = least(most * size, level * weight): with sources in order of size / weight, the level at which the first j are full is (all - most * their
    sizes) / (the weights of the rest); the right j is the first whose next source is not full, and its level the highest of those that fit.  The windows run over one row a source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by.withColumn("weight", w)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.sum("source_size").over(everything).alias("_all"), F.sum("weight").over(everything).alias("_w"), F.coalesce(F.sum("source_size").over(fill), F.lit(0)).alias("_full"), F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("_fw"))
    level = (F.lit(share) * F.col("_all") - F.lit(most) * F.col("_full")) / (F.col("_w") - F.col("_fw"))
    s = s.withColumn("_level", F.max(F.when(level * F.col("weight") <= F.lit(most) * F.col("source_size"), level)).over(everything))
    s = s.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("_level") * F.col("weight"), F.lit(float(most)) * F.col("source_size"))))
    return s.select("source", "source_size", "weight", "target", F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_from"), F.sum("target").over(everything).alias("_sum"))


def slots(goal: DataFrame, n: int) -> DataFrame:
    """Point number ``i`` and source of each slot, and ``_rank``, the number of the source's slots before it; every source with a target has one slot at least.

    A point finds its source by an equality join on a cell of the unit interval and a test of the limits.  Ranks are counted in two steps (runs of points,
    then inside a run), so no source's points meet in one task.
    """
    lo, hi = F.col("_from") / F.col("_sum"), (F.col("_from") + F.col("target")) / F.col("_sum")
    cells = goal.where("target >= 1").select("source", lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(F.floor(lo * CELLS), F.least(F.floor(hi * CELLS), F.lit(CELLS - 1).cast("long")))).alias("_cell"))
    spark = goal.sparkSession
    u = F.pmod(F.pmod(F.col("id"), F.lit(RANGE).cast("long")) * F.lit(STEP).cast("long"), F.lit(RANGE).cast("long")) / F.lit(float(RANGE))
    points = spark.range(n).select(F.col("id").alias("i"), u.alias("_u")).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    drawn = points.join(cells, "_cell").where("_u >= _lo and _u < _hi").select("i", "source", F.floor(F.col("i") / 4096).alias("_run"))
    runs = drawn.groupBy("source", "_run").agg(F.count("*").alias("_n"))
    before = runs.select("source", "_run", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source", "_run").orderBy("i")) - 1
    ranked = drawn.withColumn("_in", inside).withColumnRenamed("source", "_s").join(before, F.col("_s").eqNullSafe(F.col("source")) & (drawn["_run"] == before["_run"])).select("i", "source", (F.col("_in") + F.col("_before")).alias("_rank"))
    none = goal.where("target >= 1").select("source").join(runs.select(F.col("source").alias("_s")).distinct(), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    return ranked.unionByName(none.select(F.lit(n).cast("long").alias("i"), "source", F.lit(0).cast("long").alias("_rank")))


def laid_out(sized: DataFrame) -> DataFrame:
    """Adds ``_off``: the words of the source's documents before this one in hash order.  Sums run over 1/4096 of the hash range, then inside each."""
    h = sized.select("*", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h")).withColumn("_part", F.substring("_h", 1, 3))
    parts = h.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    before = parts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "_part").orderBy("_h", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return h.withColumn("_in", inside).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).withColumn("_off", F.col("_in") + F.col("_before")).drop("_h", "_part", "_in", "_s", "_p", "_before")


def schedule(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).  A piece: ``i`` (its place in the mix), source, doc_id, pass (0 or 1), ``_x`` and ``_y`` (its words in the source's laid-out stream).

    Documents: doc_id, source, size, ``_text``, ``_off``, source_size, target; (source, ``_off``) tells those with words apart.
    """
    kept = Kept(docs.sparkSession, "mix")
    sized, _ = kept.write(sizes(docs))
    # what several branches read is written once
    goal, _ = kept.write(targets(sized))
    total = sized.agg(F.sum("size")).first()[0] or 0
    slot, _ = kept.write(slots(goal, max(1, int(SHARE * total) // block_words)))
    count = slot.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_b")
    g = goal.select(F.col("source").alias("_g"), "source_size", "target", F.floor("target").alias("_take"))
    on, _ = kept.write(laid_out(sized).join(g, F.col("source").eqNullSafe(F.col("_g"))).drop("_g"))
    copy = on.where("size > 0 and _take > 0").join(count, F.col("source").eqNullSafe(F.col("_b"))).drop("_b").withColumn("_n", F.least("_n", "_take")).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    copy = copy.withColumn("_a", F.col("_off") + F.col("pass") * F.col("source_size")).withColumn("_z", F.least(F.col("_a") + F.col("size"), F.col("_take"))).where("_a < _z")
    # blocks differ by a word at most: the first _r of them have _q + 1 words, the others _q
    copy = copy.selectExpr("*", "_take div _n as _q", "_take % _n as _r")
    of = "if({0} < _r * (_q + 1), {0} div (_q + 1), _r + ({0} - _r * (_q + 1)) div _q)"
    piece = copy.withColumn("_k", F.expr(f"explode(sequence({of.format('_a')}, {of.format('(_z - 1)')}))"))
    piece = piece.selectExpr("doc_id", "source as _s", "_off", "pass", "_k", "greatest(_a, _k * _q + least(_k, _r)) as _x", "least(_z, (_k + 1) * _q + least(_k + 1, _r)) as _y")
    got = piece.join(slot, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_k") == F.col("_rank"))).drop("_s", "_rank")
    return got, on.drop("_take")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    piece, on = schedule(docs, block_words)
    taken = piece.groupBy(F.col("source").alias("_s"), F.col("_off").alias("_o")).agg(F.sum(F.col("_y") - F.col("_x")).alias("_taken"))
    some = on.where("size > 0").join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_off") == F.col("_o")), "left").drop("_s", "_o")
    both = some.unionByName(on.where("size = 0").withColumn("_taken", F.lit(0).cast("long")))
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def sample(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``docs``: a document stands in it whole, once for every pass of which the mix takes half its words at least."""
    piece, on = schedule(docs, block_words)
    taken = piece.groupBy(F.col("source").alias("_s"), F.col("_off").alias("_o"), "pass").agg(F.sum(F.col("_y") - F.col("_x")).alias("_taken"))
    times = on.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_off") == F.col("_o"))).where("size > 0 and 2 * _taken >= size").groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), "_text").agg(F.count("*").alias("_times"), F.countDistinct("_off").alias("_rows"))
    # equal rows share their passes evenly
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_c"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    joined = rows.join(times, F.col("_d").eqNullSafe(F.col("_i")) & F.col("_c").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_text")))
    return joined.select("_row", F.explode(F.expr("sequence(1L, cast(ceil(_times / _rows) as bigint))"))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
     s AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)}] AS w FROM (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source)),
     f AS (SELECT *, ({SHARE} * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev FROM s
           WINDOW o AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     g AS (SELECT source, source_size, least({MOST} * source_size, w * (SELECT max(lev) FROM f WHERE lev * w <= {MOST} * source_size)) AS target FROM f),
     p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (least(size, greatest(0, floor(target) - off)) + least(size, greatest(0, floor(target) - source_size - off)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
