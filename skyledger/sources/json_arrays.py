"""JSON array files read in byte ranges, several tasks to a file.

Files are read as text that ends at closing braces, which Spark splits at any byte. Whether a
brace counts depends on what stands before it in the file: inside a string it does not, and an
element ends only at the outermost one. What a range does to that state can be told without
knowing how it begins: it turns strings on or off, and it changes the depth by one number if it begins outside a
string and by another if it begins inside. A first pass finds these for every range; composing
them in order of the file (a row per range) gives the state each range begins in; a second pass
cuts the elements. Only elements that cross ranges are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_RANGE = ["file", "block"]
_TAIL = r"^[\s,]*(\[?\s*\])?\s*$"  # what may stand after the last element


def fragments(spark: SparkSession, path: str, pattern: str = "*.json", stream: bool = False) -> DataFrame:
    """Text up to each closing brace (without it), with its file and the start of its byte range."""
    reader = spark.readStream if stream else spark.read
    rows = reader.format("text").option("lineSep", "}").option("pathGlobFilter", pattern).load(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _outside(text: Column, inside: Column) -> Column:
    """``text`` (without escapes) without what stands in strings; ``inside``: it begins in one."""
    begun = F.when(~inside, text).when(text.contains('"'), F.regexp_replace(text, r'(?s)^[^"]*"', "")).otherwise("")
    return F.regexp_replace(F.regexp_replace(begun, r'(?s)"[^"]*"', ""), r'(?s)"[^"]*$', "")


def _read(rows: DataFrame) -> DataFrame:
    """Fragments with their place in the range, their quotes, and whether they are the end of the range."""
    placed = rows.withColumn("place", F.monotonically_increasing_id())  # rows of a range are in order within a task
    plain = placed.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    return plain.withColumn("quotes", _count(F.col("plain"), '"'))


def _steps(rows: DataFrame, begins_inside: Column, name: str) -> DataFrame:
    """Adds what each fragment does to the depth, ``name``, and whether its brace closes, if the range begins so."""
    before = F.coalesce(F.sum("quotes").over(W.partitionBy(*_RANGE).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = (before + begins_inside.cast("int")) % 2 == 1
    closes = (inside.cast("int") + F.col("quotes")) % 2 == 0
    return rows.withColumns({name: _count(_outside(F.col("plain"), inside), "{") - closes.cast("int"), f"{name}_closes": closes})


def _begins(rows: DataFrame) -> DataFrame:
    """The state each range begins in: (file, block, begins_inside, begins_depth); a row per range."""
    both = _steps(_steps(_read(rows), F.lit(False), "outside"), F.lit(True), "inside")
    ranges = both.groupBy(*_RANGE).agg(F.sum("quotes").alias("quotes"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begun = ranges.withColumn("begins_inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("outside"))
    return begun.withColumn("begins_depth", F.coalesce(F.sum(change).over(earlier), F.lit(0))).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "begins_inside", "begins_depth")


def elements(rows: DataFrame) -> DataFrame:
    """The elements of every file's array as texts; ``rows`` are ``fragments``."""
    known = _read(rows).join(_begins(rows), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    stepped = _steps(known, F.col("begins_inside"), "step")
    order = W.partitionBy(*_RANGE).orderBy("place")
    depth = F.col("begins_depth") + F.sum("step").over(order)
    ended = stepped.withColumn("ends", F.col("step_closes") & (depth <= 0))
    nth = F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = ended.withColumn("nth", nth).groupBy(*_RANGE, "nth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda f: f["value"]), "}").alias("text"),
        F.max("ends").alias("ends"))
    whole = pieces.filter((F.col("nth") > 0) & F.col("ends")).select("text")
    # pieces at the edges of ranges: two of each at most; those up to the next end belong together
    in_file = W.partitionBy("file").orderBy("block", "nth")
    edges = pieces.filter((F.col("nth") == 0) | ~F.col("ends")).withColumn(
        "element", F.coalesce(F.sum(F.col("ends").cast("int")).over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = edges.groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "text"))), lambda p: p["text"]), "}").alias("text"))
    cut = whole.unionByName(joined.select("text")).filter(~F.col("text").rlike(_TAIL))
    return cut.select(F.concat(F.regexp_replace("text", r"^[\s,\[\uFEFF]+", ""), F.lit("}")).alias("value"))
