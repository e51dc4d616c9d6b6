"""Fixtures shared by the corpus tests."""

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table that has them already must do no harm.
CLASH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("key", "fp", "size", "score", "spans", "_row", "_bad", "_line", "_text", "node", "root", "label", "pass", "ids", "count")])


def clashing(spark, rows):
    """(doc_id, text, source) with further columns."""
    return spark.createDataFrame([(*r, *["x"] * (len(CLASH) - 3)) for r in rows], CLASH)


ODD = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", "b"), (3, "word", None), (4, "Zürich straße 🙂 " * 3, "b"), (5, "x" * 70_000, "a"), (5, "x" * 70_000, "a"), (None, "no id here", "b"), (7, "one two three four five six", "c"), (8, "one two three four five six", "c")]
