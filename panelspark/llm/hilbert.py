"""Shards along a Hilbert curve, so that files can be left out by any of several metadata columns.

Language, source and size of a document are quantised to ``2 ** LEVELS`` cells each (cells of about equally many rows: a value's cell is the share of rows
with a smaller value), the three cells give an index on a Hilbert curve, rows are ordered by that index and the order is cut into runs.  A run is a
compact box or two of the three dimensions, so the least and greatest values of a file's columns say which files a filter can skip.

The order is never sorted in one piece: rows are counted by curve index and hash prefix, running totals of these counts (in three steps) give the place of
each prefix, and only a prefix is ordered inside.  Rows of one index follow each other by the hash of id and text, so an index that holds a third of all rows
is 4096 groups; rows that are equal in id, text, language and source are counted before the shuffle.

A null language or source sorts before all others, a null text has no bytes, rows without id are rows like others; equal rows get places of their own; an
empty table gives an empty result; other columns are only kept by ``rows`` and ``write``.  DataFrame functions only; the driver sees the at most 32 lower limits of a dimension's cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import CRC32_SQL, CRC32_TABLE_SQL, Kept

DIMS = ("lang", "source", "size")
LEVELS, SHARDS = 5, 24
#: Copies that one row is unfolded to at a time.
RUN = 4096


def curve_steps(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of the curve in ``n`` dimensions for ``state << n | bits``; a state is ``entry corner * n + direction``."""
    full = (1 << n) - 1
    left = lambda x, k: (x << k % n | x >> (n - k % n)) & full
    gray = lambda i: i ^ i >> 1
    back = {gray(i): i for i in range(full + 1)}
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  # trailing ones
    digit, state = [], []
    for entry in range(full + 1):
        for way in range(n):
            for bits in range(full + 1):
                w = back[left(bits ^ entry, n - (way + 1) % n)]
                corner = gray((w - 1) // 2 * 2) if w else 0
                turn = (ones(w) if w % 2 else ones(w - 1)) % n if w else 0
                digit.append(w)
                state.append((entry ^ left(corner, way + 1)) * n + (way + turn + 1) % n)
    return digit, state


def curve_index(cells: list[Column], levels: int = LEVELS) -> Column:
    """Hilbert index of the cells (``levels`` bits each)."""
    n = len(cells)
    digit, state = (F.array(*map(F.lit, x)) for x in curve_steps(n))
    at, index = F.lit(0), F.lit(0)
    for level in reversed(range(levels)):
        bits = sum((F.shiftright(c, level).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(cells)), F.lit(0))
        step = F.shiftleft(at, n) + bits
        at, index = F.get(state, step), F.shiftleft(index, n) + F.get(digit, step)
    return index


def ordered_text(name: str, c: Column) -> Column:
    """The value as a string of the same order, null first."""
    return F.lpad(c.cast("string"), 20, "0") if name == "size" else F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def digest(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32 and the three dimensions as ordered strings (``_lang``, ``_source``, ``_size``), and ``more``."""
    text = F.col("text").cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = (F.octet_length(raw) + 8).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), *[ordered_text(d, size if d == "size" else F.col(d)).alias(f"_{d}") for d in DIMS], *more)


def running(counts: DataFrame, levels: list[str], values: list[str]) -> DataFrame:
    """``counts`` (one row for each combination of ``levels``) with ``_b_<value>``: the total of all rows before, summed level by level."""
    up, last = levels[:-1], levels[-1]
    w = Window.partitionBy(*up) if up else Window.partitionBy()
    before = [F.coalesce(F.sum(v).over(w.orderBy(last).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{v}") for v in values]
    if not up:
        return counts.select("*", *before)
    above = running(counts.groupBy(*up).agg(*[F.sum(v).alias(v) for v in values]), up, values)
    above = above.select(*[F.col(c).alias(f"_u_{c}") for c in up], *[F.col(f"_b_{v}").alias(f"_a_{v}") for v in values])
    on = [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in up]
    joined = counts.select("*", *before).join(above, on)
    return joined.select(*counts.columns, *[(F.col(f"_a_{v}") + F.col(f"_b_{v}")).alias(f"_b_{v}") for v in values])


def cells(rows: DataFrame, kept: Kept, levels: int = LEVELS) -> list[Column]:
    """A column for each dimension: the cell of its value.  Distinct values are laid in ranges, whose totals are summed; at most ``2 ** levels`` lower limits a dimension come back."""
    pair = F.array(*[F.struct(F.lit(k).alias("d"), F.col(f"_{d}").alias("v")) for k, d in enumerate(DIMS)])
    each = rows.select(F.explode(pair).alias("p")).groupBy("p.d", "p.v").agg(F.count("*").alias("n"))
    # the number of the range is written, so a task that runs again cannot move it
    each, path = kept.write(each.repartitionByRange("d", "v").withColumn("r", F.spark_partition_id()))
    total = each.groupBy("d").agg(F.sum("n").alias("all"))
    part = running(each.groupBy("d", "r").agg(F.sum("n").alias("n")).join(total, "d"), ["d", "r"], ["n"])
    first = part.groupBy("d").agg(F.min("_b_n").alias("zero"))  # the totals go on from one dimension to the next
    part = part.join(first, "d").select(F.col("d").alias("_d"), F.col("r").alias("_r"), (F.col("_b_n") - F.col("zero")).alias("_before"), "all")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("d", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = each.withColumn("_in", inside).join(part, (F.col("d") == F.col("_d")) & (F.col("r") == F.col("_r")))
    limits = own.withColumn("cell", F.expr(f"((_before + _in) * {1 << levels}) div all")).groupBy("d", "cell").agg(F.min("v").alias("v")).collect()
    kept.drop(path)
    out = []
    for k, d in enumerate(DIMS):
        cell = F.lit(0)
        for r in sorted((r for r in limits if r["d"] == k), key=lambda r: r["cell"]):
            cell = F.when(F.col(f"_{d}") >= r["v"], F.lit(r["cell"])).otherwise(cell)
        out.append(cell.cast("int"))
    return out


def groups(docs: DataFrame, kept: Kept, levels: int = LEVELS) -> tuple[DataFrame, int, int]:
    """(one row for equal rows: doc_id, size, text_crc32, dimensions, curve, ``_hash``, ``_n`` copies, ``_row`` and ``_byte``: rows and bytes before), rows, bytes."""
    rows, _ = kept.write(digest(docs))
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    cut = rows.select("*", *[c.alias(f"_c{k}") for k, c in enumerate(cells(rows, kept, levels))])
    rows = cut.select(*rows.columns, curve_index([F.col(f"_c{k}") for k in range(len(DIMS))], levels).cast("long").alias("curve"), key.alias("_hash"))
    one = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).select("*", F.substring("_hash", 1, 3).alias("_part"), F.shiftright("curve", 8).alias("_top"), (F.col("_n") * F.col("size")).alias("_s"))
    one, _ = kept.write(one)
    part = running(one.groupBy("_top", "curve", "_part").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")), ["_top", "curve", "_part"], ["_n", "_s"])
    part = part.select(F.col("curve").alias("_c"), F.col("_part").alias("_p"), "_b__n", "_b__s")
    w = Window.partitionBy("curve", "_part").orderBy("_hash", *rows.columns[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = one.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_i{v}") for v in ("_n", "_s")])
    placed = inside.join(part, (F.col("curve") == F.col("_c")) & (F.col("_part") == F.col("_p")))
    return placed.select(*rows.columns, "_n", (F.col("_i_n") + F.col("_b__n")).alias("_row"), (F.col("_i_s") + F.col("_b__s")).alias("_byte")), n, size or 0


def places(docs: DataFrame, shards: int = SHARDS, law: str = "rows", levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, ``_lang``, ``_source``, ``_size``, curve, copy (number among equal rows), shard, slot.

    ``law="rows"``: the counts of the shards are one apart at most.  ``law="bytes"``: runs are cut where the middle of a row passes a multiple of the shards'
    equal share of bytes, so a shard is off by one row at most on either side.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    one, n, size = groups(docs, Kept(docs.sparkSession, "hilbert"), levels)
    # equal rows are unfolded in runs, so that no array grows with their number
    runs = one.withColumn("_k", F.explode(F.expr(f"sequence(0L, (_n - 1) div {RUN})")))
    each = runs.withColumn("copy", F.explode(F.expr(f"sequence(_k * {RUN}, least(_n, (_k + 1) * {RUN}) - 1)")))
    row = each.withColumn("_row", F.col("_row") + F.col("copy"))
    own = ["doc_id", "size", "text_crc32", *[f"_{d}" for d in DIMS], "curve", "copy"]
    if law == "rows":
        shard = F.expr(f"(_row * {shards}) div {max(n, 1)}")
        return row.withColumn("shard", shard).select(*own, F.col("shard").cast("int").alias("shard"), (F.col("_row") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).alias("slot"))
    cut = row.withColumn("shard", F.expr(f"cast(((2 * (_byte + copy * size) + size) * {shards}) div {max(2 * size, 1)} as int)"))
    first = cut.groupBy(F.col("shard").alias("_shard")).agg(F.min("_row").alias("_first"))
    return cut.join(first, F.col("shard") == F.col("_shard")).select(*own, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: runs have no growth law), curve."""
    got = places(docs.select("doc_id", "text", "lang", "source"), shards, law)
    return got.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def rows(docs: DataFrame, shards: int = SHARDS, law: str = "rows", levels: int = LEVELS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (in place of columns of these names).

    Rows that are equal in all that the order reads are numbered within 256 parts of themselves, so a row repeated very often is many groups.
    """
    kept = Kept(docs.sparkSession, "hilbert-rows")
    key = ["doc_id", "size", "text_crc32", *[f"_{d}" for d in DIMS]]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    # the salt is written, so a task that runs again cannot change it
    held, _ = kept.write(digest(docs, own, F.pmod(F.monotonically_increasing_id(), F.lit(256)).alias("__salt")))
    salts = held.groupBy(*key, "__salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salts.select(*[F.col(k).alias(f"_k{k}") for k in key], F.col("__salt").alias("_s"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = held.withColumn("_in", F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(F.lit(0))) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in key]
    numbered = inside.join(before, [*same, F.col("__salt") == F.col("_s")]).select("__row", *key, (F.col("_in") + F.col("_before")).alias("_copy"))
    place = places(docs.select("doc_id", "text", "lang", "source"), shards, law, levels).select(*[F.col(k).alias(f"_k{k}") for k in key], F.col("copy").alias("_c"), "shard", "slot")
    got = numbered.join(place, [*same, F.col("_copy") == F.col("_c")])
    return got.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "rows", levels: int = LEVELS) -> DataFrame:
    """Writes ``docs`` as one folder a shard, in order of the curve, and returns its table of limits: shard, rows, least and greatest ``lang``, ``source`` and ``size``.

    The table is written beside the shards; ``needed`` tells from it which of them a filter has to open.
    """
    placed = rows(docs, shards, law, levels)
    placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    back = docs.sparkSession.read.parquet(f"{path}/rows")
    size = (F.octet_length(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")) + 8).cast("long")
    ends = [f(c).alias(f"{n}_{d}") for d, c in (("lang", F.col("lang")), ("source", F.col("source")), ("size", size)) for n, f in (("min", F.min), ("max", F.max))]
    nulls = [F.count_if(F.col(d).isNull()).alias(f"null_{d}") for d in ("lang", "source")]
    back.groupBy("shard").agg(F.count("*").alias("rows"), *ends, *nulls).coalesce(1).write.parquet(f"{path}/limits")
    return docs.sparkSession.read.parquet(f"{path}/limits")


def needed(limits: DataFrame, lang: str | None = None, source: str | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """The shards of a table of limits that can hold rows of that language, source and range of sizes (both ends included)."""
    may = F.lit(True)
    for d, v in (("lang", lang), ("source", source)):
        if v is not None:
            may = may & (F.lit(v) >= F.col(f"min_{d}")) & (F.lit(v) <= F.col(f"max_{d}"))
    if size is not None:
        may = may & (F.col("max_size") >= size[0]) & (F.col("min_size") <= size[1])
    return limits.where(may).select("shard")


def _curve_sql() -> str:
    """The index of the cells a, b and c, level by level."""
    out, at = [], f"c{LEVELS}"
    for level in reversed(range(LEVELS)):
        bits = " + ".join(f"({c} >> {level} & 1) * {1 << k}" for k, c in enumerate("abc"))
        out.append(f"c{level} AS (SELECT {at}.* EXCLUDE (i, s), i * 8 + step_digit[s * 8 + {bits} + 1] AS i, step_state[s * 8 + {bits} + 1] AS s FROM {at}, steps)")
        at = f"c{level}"
    return ",\n     ".join(out)


def _sql() -> str:
    digit, state = curve_steps(len(DIMS))
    cell = lambda d: f"(SELECT v, ({1 << LEVELS} * coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // (sum(n) OVER ()) AS cell FROM (SELECT {d} AS v, count(*) AS n FROM d GROUP BY ALL))"
    return f"""
WITH crc AS ({CRC32_TABLE_SQL}),
     steps AS (SELECT {digit} AS step_digit, {state} AS step_state),
     d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {CRC32_SQL.format("coalesce(text, '')")} AS text_crc32, coalesce('1' || lang, '0') AS lang, coalesce('1' || source, '0') AS source FROM documents, crc),
     c5 AS (SELECT d.*, x.cell::BIGINT AS a, y.cell::BIGINT AS b, z.cell::BIGINT AS c, 0::BIGINT AS i, 0::BIGINT AS s FROM d JOIN {cell("lang")} x ON d.lang = x.v JOIN {cell("source")} y ON d.source = y.v JOIN {cell("size")} z ON d.size = z.v),
     {_curve_sql()},
     r AS (SELECT *, row_number() OVER (ORDER BY i, md5(coalesce(doc_id::VARCHAR, '') || '|' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM c0)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (r * {SHARDS} // n)::INT AS shard, (r - ((r * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, i::BIGINT AS curve FROM r
"""


SQL = _sql()
