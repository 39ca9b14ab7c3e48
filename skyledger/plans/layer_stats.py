"""Figures of the layers that are kept with every batch, so that asking for them scans no layer.

A batch adds, for each layer, day and family of flights, its rows, the extremes of its times and a
bitmap of its flights. All of them merge: sums, extremes, and bitmaps by OR, so distinct flights over any
days are exact. A flight id is a family (its text) and a number, which is a bit of the family's bitmap; ids that
end in no number, or in one of more than nine digits, are rows of their own.

RAW rows that have reached CLEAN are counted by the day of their CLEAN row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.sources.snapshots import Section, SnapshotTable, seen

LAYERS = ["RAW", "CLEAN", "FACT"]
STAMPS = {"RAW": "loaded_at", "CLEAN": "transformed_at", "FACT": "transformed_at"}
FIGURES, DONE = "figures", "done"
_FLIGHT = r"(?s)\A(.*?)(0|[1-9][0-9]{0,8})?\z"
_GROUP = ["day", "family", "numbered", "word"]

_FIGURES = T.StructType([
    T.StructField("day", T.DateType()), T.StructField("family", T.StringType()), T.StructField("numbered", T.BooleanType()),
    T.StructField("word", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("oldest", T.TimestampType()),
    T.StructField("newest", T.TimestampType()), T.StructField("stamp", T.TimestampType()), T.StructField("flights", T.BinaryType()),
    T.StructField("layer", T.StringType())])
_DONE = T.StructType([T.StructField("day", T.DateType()), T.StructField("rows", T.LongType()), T.StructField("layer", T.StringType())])


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("layer", *_GROUP).agg(
        F.sum("rows").alias("rows"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.max("stamp").alias("stamp"),
        F.when(F.col("numbered"), F.bitmap_or_agg("flights")).alias("flights"))


def _merged_done(rows: DataFrame) -> DataFrame:
    return rows.groupBy("layer", "day").agg(F.sum("rows").alias("rows"))


class LayerStatistics(SnapshotTable):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {FIGURES: Section(_FIGURES, "layer", fold=_merged), DONE: Section(_DONE, "layer", fold=_merged_done)})

    def _figures(self, layer: str, rows: DataFrame, day: str | Column) -> DataFrame:
        number = F.regexp_extract("flight_id", _FLIGHT, 2)
        numbered = number != ""
        value = number.try_cast("long")
        named = rows.select(
            (F.col(day) if isinstance(day, str) else day).alias("day"), F.regexp_extract("flight_id", _FLIGHT, 1).alias("family"), numbered.alias("numbered"),
            F.when(numbered, F.bitmap_bucket_number(value)).alias("word"), F.when(numbered, F.bitmap_bit_position(value)).alias("bit"),
            "event_timestamp", F.col(STAMPS[layer]).alias("stamp"))
        return named.groupBy(*_GROUP).agg(
            F.count("*").alias("rows"), F.min("event_timestamp").alias("oldest"), F.max("event_timestamp").alias("newest"),
            F.max("stamp").alias("stamp"), F.when(F.col("numbered"), F.bitmap_construct_agg("bit")).alias("flights")).withColumn("layer", F.lit(layer))

    def add(self, layer: str, rows: DataFrame, day: str | Column = "event_date", batch: tuple[str, int] | None = None) -> None:
        """Add the figures of rows that the layer has got; one scan of them."""
        base = self.state()
        if not seen(base, batch):
            self.commit(base, self.stage(FIGURES, self._figures(layer, rows, day)), batch=batch)
            self.upkeep()

    def add_done(self, raw: DataFrame, clean: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add the RAW rows whose events are among these CLEAN rows, by the day of the latter."""
        base = self.state()
        if not seen(base, batch):
            known = clean.select(F.col("event_id").alias("_done"), F.col("event_date").alias("day")).dropDuplicates(["_done"])
            done = raw.select("event_id").join(known, F.col("event_id") == F.col("_done")).groupBy("day").agg(F.count("*").alias("rows"))
            self.commit(base, self.stage(DONE, done.withColumn("layer", F.lit("RAW"))), batch=batch)
            self.upkeep()

    def recount(self, layer: str, rows: DataFrame, day: str | Column = "event_date") -> None:
        """The figures of a layer anew, from all its rows: after a crash between a write and its figures."""
        base = self.state()
        self.commit(base, self.stage(FIGURES, self._figures(layer, rows, day)), base.of(FIGURES, [f"layer={layer}"]))
        self.upkeep()

    def volumes(self) -> DataFrame:
        """(layer, total_rows, unique_flights, oldest, newest, stamp) of every layer, also of an empty one."""
        figures = self.read(FIGURES)
        families = figures.groupBy("layer", "family", "numbered", "word").agg(
            F.sum("rows").alias("rows"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.max("stamp").alias("stamp"),
            F.when(F.col("numbered"), F.bitmap_count(F.bitmap_or_agg("flights"))).when(F.col("family").isNotNull(), F.lit(1)).alias("flights"))
        found = families.groupBy(F.col("layer").alias("_layer")).agg(
            F.sum("rows").alias("rows"), F.sum("flights").alias("flights"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.max("stamp").alias("stamp"))
        every = self.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer"))
        return every.join(found, F.col("layer") == F.col("_layer"), "left").select(
            "layer", F.coalesce("rows", F.lit(0)).alias("total_rows"), F.coalesce("flights", F.lit(0)).alias("unique_flights"), "oldest", "newest", "stamp")

    def done_before(self, day: Column) -> Column:
        """RAW rows that have reached CLEAN rows of days before ``day``, as a scalar."""
        return F.coalesce(self.read(DONE).filter(F.col("day") < day).agg(F.sum("rows").alias("n")).scalar(), F.lit(0))
