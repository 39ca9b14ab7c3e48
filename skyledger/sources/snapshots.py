"""Tables that change: folders written once, and a small list of which of them count.

A table has sections (its rows, and where needed an index of its keys), each partitioned by
one column. A write adds a folder and never touches another; what it added and what it
supersedes becomes visible at once, when the next numbered list of pieces is put beside the
others. A reader takes the newest list and keeps one state of all sections, whatever is
written meanwhile. Two writers that start from the same list cannot both succeed.

Streams name themselves and their batch in the list, so a batch that runs again is known.

Small pieces of a part are merged when ``FAN_IN`` of the same level have gathered, into one
piece of the next level: after n batches a part has at most (FAN_IN - 1) times log n pieces, and a
row is rewritten log n times. Where a batch would hit every part with a few rows (parts by hash) it
is one piece of its own first, a run, and as many runs are dealt to the parts together. Superseded folders stay for running readers until their lists
are older than the newest ``KEPT_LISTS`` and than ``KEPT_SECONDS``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

FAN_IN = 8
KEPT_LISTS = 10
KEPT_SECONDS = 3600
ORPHAN_SECONDS = 7 * 24 * 3600
LISTS = "_lists"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of a null


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


@dataclass(frozen=True)
class Section:
    schema: T.StructType  # with the partition column
    part: str  # the partition column
    sort_by: str | None = None
    fold: Callable[[DataFrame], DataFrame] | None = None  # what merged rows become, e.g. the newest of each key

    def folder_of(self, value) -> str:
        return f"{self.part}={NULL_PART if value is None else value}"


@dataclass(frozen=True)
class Piece:
    section: str
    part: str  # name of the part's folder, column=value
    write: str  # name of the write that made it
    level: int = 0


@dataclass(frozen=True)
class State:
    """One list: the pieces that count, and the last batch of each stream."""

    number: int = 0
    pieces: frozenset[Piece] = frozenset()
    batches: dict[str, int] = field(default_factory=dict)

    def of(self, section: str, parts: Iterable[str] | None = None) -> list[Piece]:
        wanted = None if parts is None else set(parts)
        return sorted((p for p in self.pieces if p.section == section and (wanted is None or p.part in wanted)), key=lambda p: (p.part, p.write))


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, sections: dict[str, Section], runs: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None):
        """``runs``: for a section of runs, the section they go to, and what turns their rows into rows of that."""
        self.spark, self.path, self.sections, self.runs = spark, path.rstrip("/"), sections, runs or {}
        self._hadoop = spark._jvm.org.apache.hadoop
        root = self._hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- Lists ---------------------------------------------------------------------

    def _at(self, *names: str):
        return self._hadoop.fs.Path("/".join([self.path, *names]))

    def _list_numbers(self) -> list[tuple[int, float]]:
        """Numbers of the lists and their age in seconds, in order."""
        if not self._fs.exists(self._at(LISTS)):
            return []
        found, now = [], time.time()
        for status in self._fs.listStatus(self._at(LISTS)):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                found.append((int(name[:-5]), now - status.getModificationTime() / 1000))
        return sorted(found)

    def _load(self, number: int) -> State:
        stream = self._fs.open(self._at(LISTS, f"{number:09d}.json"))
        try:
            content = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(number, frozenset(Piece(*p) for p in content["pieces"]), content["batches"])

    def state(self) -> State:
        numbers = self._list_numbers()
        return self._load(numbers[-1][0]) if numbers else State()

    def exists(self) -> bool:
        return bool(self._list_numbers())

    def commit(self, base: State, add: Iterable[Piece], remove: Iterable[Piece] = (), batch: tuple[str, int] | None = None) -> State:
        """The state after ``base`` with these pieces added and removed; fails if ``base`` is no longer the newest."""
        batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        following = State(base.number + 1, (base.pieces - frozenset(remove)) | frozenset(add), batches)
        rows = [[p.section, p.part, p.write, p.level] for p in sorted(following.pieces, key=lambda p: (p.section, p.part, p.write))]
        draft = self._at(LISTS, f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"pieces": rows, "batches": batches}).encode()))
        stream.close()
        context = self._hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)
        try:  # fails where the name is taken
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(LISTS, f"{following.number:09d}.json")), plain)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error) or self._fs.exists(self._at(LISTS, f"{following.number:09d}.json")):
                raise Conflict(f"{self.path}: list {following.number} was written by another") from None
            raise
        return following

    # --- Rows ----------------------------------------------------------------------

    def folders(self, pieces: Iterable[Piece]) -> list[str]:
        return [f"{self.path}/{p.section}/write={p.write}/{p.part}" for p in pieces]

    def rows_of(self, section: str, pieces: list[Piece]) -> DataFrame:
        about = self.sections[section]
        if not pieces:
            return self.spark.createDataFrame([], about.schema)
        read = self.spark.read.schema(about.schema).option("basePath", f"{self.path}/{section}")
        return read.parquet(*self.folders(pieces)).select(*about.schema.names)

    def read(self, section: str, values: Iterable | None = None, state: State | None = None) -> DataFrame:
        """Rows of a section, of all parts or of those of these values; only their folders are listed."""
        parts = None if values is None else [self.sections[section].folder_of(v) for v in values]
        return self.rows_of(section, (state or self.state()).of(section, parts))

    def stage(self, section: str, rows: DataFrame, level: int = 0) -> list[Piece]:
        """Write ``rows`` as new pieces that nobody sees before they are committed."""
        about, write = self.sections[section], f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        even = rows.select(*about.schema.names).hint("rebalance", about.part)
        ordered = even.sortWithinPartitions(about.part, about.sort_by) if about.sort_by else even
        ordered.write.partitionBy(about.part).parquet(f"{self.path}/{section}/write={write}")
        there = self._fs.listStatus(self._at(section, f"write={write}"))
        return [Piece(section, s.getPath().getName(), write, level) for s in there if s.isDirectory()]

    # --- Upkeep --------------------------------------------------------------------

    def due(self, state: State) -> list[Piece]:
        """Pieces to merge: those of a part and level of which ``FAN_IN`` have gathered."""
        gathered: dict[tuple[str, str, int], list[Piece]] = {}
        for piece in state.pieces:
            if piece.section in self.runs:
                continue
            gathered.setdefault((piece.section, piece.part, piece.level), []).append(piece)
        return [p for found in gathered.values() if len(found) >= FAN_IN for p in found]

    def compact(self) -> State:
        """Deal runs and merge what is due until nothing is; gives way to another writer."""
        state = self.state()
        for section, (target, deal) in self.runs.items():
            runs = state.of(section)
            if len(runs) >= FAN_IN:
                try:
                    state = self.commit(state, self.stage(target, deal(self.rows_of(section, runs))), runs)
                except Conflict:
                    return self.state()
        while due := self.due(state):
            added = []
            for section, level in sorted({(p.section, p.level) for p in due}):
                merged = self.rows_of(section, sorted((p for p in due if (p.section, p.level) == (section, level)), key=lambda p: (p.part, p.write)))
                fold = self.sections[section].fold
                added += self.stage(section, fold(merged) if fold else merged, level + 1)
            try:
                state = self.commit(state, added, due)
            except Conflict:
                return self.state()
        return state

    def vacuum(self, kept_lists: int = KEPT_LISTS, kept_seconds: float = KEPT_SECONDS) -> int:
        """Delete old lists and the folders that only they name, also those of writes that never were committed; returns how many folders went."""
        numbers = self._list_numbers()
        old = [n for n, age in numbers[:-kept_lists] if age > kept_seconds] if kept_lists < len(numbers) else []
        if not old:
            return 0
        kept = frozenset().union(*(self._load(n).pieces for n, _ in numbers if n not in set(old)))
        gone = frozenset().union(*(self._load(n).pieces for n in old)) - kept
        for piece in gone:
            self._fs.delete(self._at(piece.section, f"write={piece.write}", piece.part), True)
        for number in old:
            self._fs.delete(self._at(LISTS, f"{number:09d}.json"), False)
        named, now = {(p.section, p.write) for p in kept}, time.time()
        for section in self.sections:
            folder = self._at(section)
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                write = status.getPath().getName().partition("=")[2]
                emptied = (section, write) in {(p.section, p.write) for p in gone}
                if (section, write) not in named and (emptied or now - status.getModificationTime() / 1000 > ORPHAN_SECONDS):
                    self._fs.delete(status.getPath(), True)
        return len(gone)

    def upkeep(self) -> None:
        self.compact()
        self.vacuum()


# --- Tables by day, with known keys -----------------------------------------------------

ROWS, RECENT, KEYS = "rows", "recent", "keys"
PREFIX, KEY, HELD = "key_prefix", "key", "held_day"
PREFIXES = 32
AT_ONCE = 10_000  # keys of a batch beyond this many for each prefix go to their prefixes at once
RUN, WHOLE = "run", "all"


class DayTable(SnapshotTable):
    """Rows by day. With ``key`` it also keeps where each key is: an index of (key, day), so that a batch learns which of its
    keys are there, and on which days, without reading a column of the rows.

    New entries are runs of their own, read whole; when ``FAN_IN`` have gathered they are dealt to prefixes of the
    key's hash. A batch reads the recent runs and the prefixes it hits.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None, day: str = "event_date",
                 sort_by: str | None = None, prefixes: int = PREFIXES):
        self.schema, self.keys, self.day, self.prefixes = schema, keys, day, prefixes
        sections = {ROWS: Section(schema, day, sort_by)}
        if keys:
            entry = [T.StructField(KEY, T.StringType()), T.StructField(HELD, T.DateType())]
            sections[RECENT] = Section(T.StructType([*entry, T.StructField(RUN, T.StringType())]), RUN)
            sections[KEYS] = Section(T.StructType([*entry, T.StructField(PREFIX, T.IntegerType())]), PREFIX, KEY)
        deal = lambda runs: runs.select(KEY, HELD).distinct().withColumn(PREFIX, self.prefix_of())
        super().__init__(spark, path, sections, {RECENT: (KEYS, deal)} if keys else None)

    def rows(self, days: Iterable | None = None, state: State | None = None) -> DataFrame:
        return self.read(ROWS, days, state)

    def key_of(self, alias: str = KEY) -> Column:
        """The key as one text; rows without a key share the null."""
        if len(self.keys) == 1:
            return F.col(self.keys[0]).cast("string").alias(alias)
        return F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}).alias(alias)

    def prefix_of(self, key: str = KEY) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.prefixes)).cast("int")

    def entries(self, keys: DataFrame, state: State) -> DataFrame:
        """(key, day) of the prefixes that ``keys`` (a column ``key``) hit, each as often as it was noted."""
        old = state.of(KEYS)
        if old:
            hit = [r[0] for r in keys.select(self.prefix_of()).distinct().collect()]  # at most ``prefixes`` numbers
            found = self.read(KEYS, hit, state).select(KEY, HELD)
            return found.unionByName(self.read(RECENT, None, state).select(KEY, HELD))
        return self.read(RECENT, None, state).select(KEY, HELD)

    def stage_keys(self, rows: DataFrame, count: int) -> list[Piece]:
        entries = rows.select(self.key_of(), F.col(self.day).alias(HELD))
        if count > AT_ONCE * self.prefixes:
            return self.stage(KEYS, entries.withColumn(PREFIX, self.prefix_of()))
        return self.stage(RECENT, entries.withColumn(RUN, F.lit(WHOLE)))

    def replace(self, rows: DataFrame, days: Iterable, batch: tuple[str, int] | None = None) -> None:
        """Replace exactly these days by ``rows``; a day without rows is empty afterwards. ``rows`` may read the table."""
        if self.keys:
            raise ValueError(f"{self.path}: its keys are indexed; it changes by merges")
        base = self.state()
        part = self.sections[ROWS].folder_of
        named = {part(d) for d in days}
        added = self.stage(ROWS, rows)
        if others := sorted({p.part for p in added} - named):
            raise ValueError(f"{self.path}: rows of days that are not to be replaced: {others[:5]}")
        self.commit(base, added, base.of(ROWS, named), batch)
        self.upkeep()

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add rows of whatever days; a batch that was added already is not added again."""
        if self.keys:
            raise ValueError(f"{self.path}: its keys are indexed; it changes by merges")
        base = self.state()
        if not seen(base, batch):
            self.commit(base, self.stage(ROWS, rows), batch=batch)
            self.upkeep()


def seen(state: State, batch: tuple[str, int] | None) -> bool:
    """Whether a stream's batch is in the table already."""
    return batch is not None and state.batches.get(batch[0], -1) >= batch[1]


def batch_name(rows: DataFrame, batch_id: int) -> tuple[str, int]:
    """The stream that ``rows`` come from, and the number of the batch; outside a stream the name is ``by hand``."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "by hand", batch_id


# --- Tables by key, newest row wins ---------------------------------------------------------

BUCKET, CHANGE = "bucket", "change_number"


class KeyedTable(SnapshotTable):
    """A row for each key: writes add the changed rows, reads take the newest of each key.

    ``order`` says which of a key's rows is the newest (the greatest); without it the last one written is. A write is
    a run; runs are dealt to buckets of the key's hash, whose pieces are merged in turn, and a merged piece holds one
    row of a key, so old rows go by themselves.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str] | None = None, buckets: int = PREFIXES):
        self.schema, self.key, self.order, self.buckets = schema, key, order or [CHANGE], buckets
        stored = [*schema.fields, T.StructField(CHANGE, T.LongType())]
        sections = {RECENT: Section(T.StructType([*stored, T.StructField(RUN, T.StringType())]), RUN),
                    ROWS: Section(T.StructType([*stored, T.StructField(BUCKET, T.IntegerType())]), BUCKET, key, self.newest)}
        super().__init__(spark, path, sections, {RECENT: (ROWS, lambda runs: self.newest(runs.drop(RUN)).withColumn(BUCKET, self.bucket_of()))})

    def newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        best = F.max_by(F.struct(*others), F.struct(*self.order, *[c for c in others if c not in self.order]))
        return rows.groupBy(self.key).agg(best.alias("_r")).select(self.key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def changes(self, like: DataFrame | None = None, state: State | None = None) -> DataFrame:
        """Rows as written, of all keys or of the keys in the buckets that ``like`` hits; a key may have several."""
        state = state or self.state()
        hit = None if like is None or not state.of(ROWS) else [r[0] for r in like.select(self.bucket_of()).distinct().collect()]  # at most ``buckets`` numbers
        return self.read(ROWS, hit, state).drop(BUCKET).unionByName(self.read(RECENT, None, state).drop(RUN))

    def current(self, like: DataFrame | None = None, state: State | None = None) -> DataFrame:
        """The newest row of every key, or of the keys in the buckets that ``like`` hits."""
        return self.newest(self.changes(like, state)).select(*self.schema.names)

    def unknown(self, rows: DataFrame, state: State) -> DataFrame:
        """Rows whose key the table lacks; of the table only keys are read, of the buckets that ``rows`` hit."""
        if not state.pieces:
            return rows
        known = self.changes(rows, state).select(F.col(self.key).alias("_known"))
        return rows.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti")

    def write(self, changes: DataFrame, batch: tuple[str, int] | None = None, base: State | None = None, large: bool = False) -> None:
        """Add changed rows, one for each key. With ``base`` it fails if the table has changed since; a ``large`` write goes to the buckets at once."""
        before = base or self.state()
        if not seen(before, batch):
            rows = changes.select(*self.schema.names, F.lit(before.number).cast("long").alias(CHANGE))
            added = self.stage(ROWS, rows.withColumn(BUCKET, self.bucket_of())) if large else self.stage(RECENT, rows.withColumn(RUN, F.lit(WHOLE)))
            if added or batch:
                self.commit(before, added, batch=batch)
                self.upkeep()
