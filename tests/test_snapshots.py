from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from skyledger.operators import merge
from skyledger.plans import dead_letters
from skyledger.sources import files, snapshots, tables
from skyledger.sources.snapshots import KEYS, RECENT, ROWS, Conflict, DayTable, KeyedTable, Piece, State

SCHEMA = "event_id string, event_date date, n int, note string"
D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def table_at(spark, path, keys=("event_id",), **options):
    return DayTable(spark, path, frame(spark, []).schema, list(keys) if keys else None, **options)


def content(df):
    return sorted((r.event_id or "", str(r.event_date), r.n) for r in df.collect())


def insert(spark, path, data):
    return merge.insert_only(spark, path, frame(spark, data))


# --- The index of keys ---------------------------------------------------------------------

def test_known_keys_come_from_the_index_alone(spark, scratch):
    path = scratch("keyed")
    insert(spark, path, [(f"E{i}", D1 + timedelta(days=i % 5), i, "x") for i in range(100)])
    table, batch = table_at(spark, path), frame(spark, [("E7", D3, 0, "again"), ("new", D3, 1, "y"), (None, D1, 2, "z")])
    fresh = merge.unknown_rows(table, batch, table.state())
    assert content(fresh) == [("", str(D1), 2), ("new", str(D3), 1)]
    assert all(f"/{RECENT}/" in f or f"/{KEYS}/" in f for f in fresh.inputFiles()) and fresh.inputFiles()


def test_only_hit_prefixes_are_opened(spark, scratch, monkeypatch):
    path = scratch("prefixes")
    monkeypatch.setattr(snapshots, "AT_ONCE", 0)  # every batch goes to its prefixes at once
    insert(spark, path, [(f"E{i}", D1, i, "x") for i in range(300)])
    table = table_at(spark, path)
    batch = frame(spark, [("E7", D1, 0, "x")])
    opened = [f for f in merge.unknown_rows(table, batch, table.state()).inputFiles() if f"/{KEYS}/" in f]
    assert len(opened) == 1 and len(table.read(KEYS).inputFiles()) > 20
    assert insert(spark, path, [("E7", D3, 1, "x"), ("E301", D3, 1, "x")]) == 1


def test_inserts_agree_with_a_plain_table_through_all_levels(spark, scratch, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN_IN", 3)
    path, known = scratch("levels"), {}
    for number in range(14):
        data = [(f"E{(number * 7 + i * 5) % 60}" if i % 9 else None, D1 + timedelta(days=(number + i) % 3), number, "x") for i in range(12)]
        insert(spark, path, data)
        for key, day, n, _ in sorted(data, key=lambda r: (r[1], r[2])):
            known.setdefault(key or "", (key or "", str(day), n))
    table = table_at(spark, path)
    assert content(table.rows()) == sorted(known.values())
    state = table.state()
    assert state.of(KEYS) and len(state.of(RECENT)) < 3
    entries = [(r.key, r.held_day) for r in table.entries(table.rows().select(table.key_of()), state).collect()]
    assert len(entries) == len(known) and {(k or "", str(d)) for k, d in entries} == {v[:2] for v in known.values()}


def test_upsert_reads_the_days_that_the_index_names(spark, scratch):
    path = scratch("upsert")
    merge.upsert_days(spark, path, frame(spark, [(f"E{i}", D1 + timedelta(days=i), i, "x") for i in range(6)]), ["event_id"], ["n"])
    before = {p.part: p for p in table_at(spark, path).state().of(ROWS)}
    merge.upsert_days(spark, path, frame(spark, [("E2", D1, 20, "y"), ("E9", D1, 9, "y")]), ["event_id"], ["n"])
    after = {p.part: p for p in table_at(spark, path).state().of(ROWS)}
    assert {part for part in before if before[part] != after[part]} == {f"event_date={D1}", f"event_date={D1 + timedelta(days=2)}"}
    assert content(table_at(spark, path).rows())[2] == ("E2", str(D1 + timedelta(days=2)), 20)
    merge.upsert_days(spark, path, frame(spark, [("E2", D3, 5, "z")]), ["event_id"])  # the key moves to another day
    merge.upsert_days(spark, path, frame(spark, [("E2", D1, 6, "z")]), ["event_id"], ["n"])
    assert [r for r in content(table_at(spark, path).rows()) if r[0] == "E2"] == [("E2", str(D3), 6)]


def test_several_columns_as_key(spark, scratch):
    path = scratch("two")
    rows = lambda n: frame(spark, [("a", D1, n, "x"), ("a", D1, n, "y"), (None, D2, n, None)])
    for n in (1, 2):
        merge.upsert_days(spark, path, rows(n), ["event_id", "note"], ["n"])
    assert content(table_at(spark, path, ("event_id", "note")).rows()) == [("", str(D2), 2), ("a", str(D1), 2), ("a", str(D1), 2)]


# --- Lists -------------------------------------------------------------------------------------

def test_a_reader_keeps_the_state_it_took(spark, scratch):
    table = table_at(spark, scratch("state"), keys=None)
    table.append(frame(spark, [("a", D1, 1, "x"), ("b", D2, 2, "x")]))
    old = table.rows()
    table.replace(frame(spark, [("c", D2, 3, "x")]), [D1, D2])
    assert content(old) == [("a", str(D1), 1), ("b", str(D2), 2)] and content(table.rows()) == [("c", str(D2), 3)]


def test_what_is_not_committed_is_not_there(spark, scratch):
    table = table_at(spark, scratch("staged"), keys=None)
    table.append(frame(spark, [("a", D1, 1, "x")]))
    table.stage(ROWS, frame(spark, [("b", D1, 2, "x")]))  # a writer that dies here
    assert content(table.rows()) == [("a", str(D1), 1)]


def test_one_of_two_writers_has_to_start_again(spark, scratch):
    table = table_at(spark, scratch("race"), keys=None)
    base = table.state()
    table.commit(base, table.stage(ROWS, frame(spark, [("a", D1, 1, "x")])))
    with pytest.raises(Conflict):
        table.commit(base, table.stage(ROWS, frame(spark, [("b", D1, 2, "x")])))
    assert content(table.rows()) == [("a", str(D1), 1)]


def test_inserts_that_meet_insert_once(spark, scratch, monkeypatch):
    path = scratch("meet")
    insert(spark, path, [("a", D1, 1, "x")])
    usual, met = DayTable.commit, []

    def late(self, base, add, remove=(), batch=None):
        if not met:  # another writer comes first, with the same key
            met.append(True)
            insert(spark, path, [("b", D2, 1, "first")])
        return usual(self, base, add, remove, batch)

    monkeypatch.setattr(DayTable, "commit", late)
    assert insert(spark, path, [("b", D2, 2, "second"), ("c", D2, 3, "second")]) == 1
    assert content(table_at(spark, path).rows()) == [("a", str(D1), 1), ("b", str(D2), 1), ("c", str(D2), 3)]


def test_empty_tables_and_batches(spark, scratch):
    path = scratch("empty")
    assert insert(spark, path, []) == 0 and content(table_at(spark, path).rows()) == []
    merge.upsert_days(spark, path, frame(spark, []), ["event_id"])
    assert insert(spark, path, [("a", None, 1, "x")]) == 1 and insert(spark, path, [("a", D1, 1, "x")]) == 0
    assert content(table_at(spark, path).rows([None])) == [("a", "None", 1)] and content(table_at(spark, path).rows([D1])) == []


# --- Merging of pieces -------------------------------------------------------------------------

def test_many_batches_leave_few_pieces(spark, scratch, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN_IN", 3)
    table, rows = table_at(spark, scratch("many"), keys=None), []
    held = table.rows
    for number in range(20):
        data = [(f"E{number}-{i}", D1 + timedelta(days=i), number, "x") for i in range(2)]
        rows += data
        table.append(frame(spark, data).coalesce(1))
        if number == 10:
            running = held()  # a reader that goes on while pieces are merged
    assert content(table.rows()) == sorted((k, str(d), n) for k, d, n, _ in rows)
    assert len(content(running)) == 22
    assert max(len(table.state().of(ROWS, [f"event_date={d}"])) for d in (D1, D2)) <= 2 * 4  # (FAN_IN - 1) x levels


def test_a_thousand_batches_have_a_bounded_number_of_pieces(spark, scratch, monkeypatch):
    """The bookkeeping alone: pieces by name, without files."""
    table = table_at(spark, scratch("names"), keys=None)
    state, held, most, made = State(), {}, 0, 0
    for number in range(1000):
        piece = Piece(ROWS, "event_date=2024-01-01", f"w{number}")
        held[piece] = 1
        state = State(number, state.pieces | {piece})
        while due := table.due(state):
            made += 1
            merged = Piece(ROWS, due[0].part, f"m{made}", due[0].level + 1)
            held[merged] = sum(held[p] for p in due)
            state = State(number, (state.pieces - set(due)) | {merged})
        most = max(most, len(state.pieces))
    assert most <= (snapshots.FAN_IN - 1) * 4 and sum(held[p] for p in state.pieces) == 1000


def test_old_folders_go_when_no_kept_list_names_them(spark, scratch):
    table = table_at(spark, scratch("old"), keys=None)
    for n in range(5):
        table.replace(frame(spark, [("a", D1, n, "x")]), [D1])
    assert table.vacuum() == 0  # all lists are young
    before = table.rows()
    assert table.vacuum(kept_lists=2, kept_seconds=-1) == 3
    assert content(before) == [("a", str(D1), 4)] and len(table._list_numbers()) == 2
    assert spark.read.parquet(f"{table.path}/{ROWS}").count() == 2


# --- Newest row wins -----------------------------------------------------------------------------

VALUES = T.StructType([T.StructField("id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("v", T.LongType())])
NOW = datetime(2024, 1, 30)


def test_newest_rows_through_all_levels(spark, scratch, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN_IN", 3)
    by_time = KeyedTable(spark, scratch("time"), VALUES, "id", ["at", "v"], buckets=4)
    last = KeyedTable(spark, scratch("last"), VALUES, "id", buckets=4)
    newest, written = {}, {}
    for number in range(11):
        rows = [(f"k{i % 5}", NOW + timedelta(minutes=(i * 7 + number * 11) % 60), number * 10 + i) for i in range(0, 8, 3)]
        for key, at, v in rows:
            newest[key] = max(newest.get(key, (datetime.min, 0)), (at, v))
            written[key] = max((at, v) for k, at, v in rows if k == key)
        by_time.write(by_time.newest(frame(spark, rows, VALUES)))
        last.write(by_time.newest(frame(spark, rows, VALUES)))
    assert {r.id: (r.at, r.v) for r in by_time.current().collect()} == newest
    assert {r.id: (r.at, r.v) for r in last.current().collect()} == written
    state = by_time.state()
    assert len(state.of(RECENT)) < 3 and 0 < max(len(state.of(ROWS, [p.part])) for p in state.of(ROWS)) <= 2 * 2


def stored_rows(spark, table):
    return sum(table.read(section).count() for section in (ROWS, RECENT))


def test_a_few_changes_write_a_few_rows(spark, scratch):
    table = KeyedTable(spark, scratch("few"), VALUES, "id", ["at"])
    table.write(frame(spark, [(f"k{i}", NOW, i) for i in range(200)], VALUES), ("stream", 0), large=True)
    for _ in range(2):  # a batch that runs twice
        table.write(frame(spark, [(f"k{i}", NOW + timedelta(minutes=1), -1) for i in range(10)], VALUES), ("stream", 1))
    assert stored_rows(spark, table) == 210
    assert table.current().filter("v = -1").count() == 10 and table.current().count() == 200
    hit = table.current(frame(spark, [("k3", NOW, 0)], VALUES))
    assert 0 < hit.count() < 200 and {r.v for r in hit.filter("id = 'k3'").collect()} == {-1}


# --- Replays that break off --------------------------------------------------------------------------

def published(spark, scratch):
    at = "TIMESTAMP '2024-01-01 00:00:00' AS at"
    rows = spark.sql(f"""SELECT 'E' || id AS event_id, 'F' || id AS flight_id, if(id % 4 = 3, 'not json ' || id, '{{"n": ' || id || '}}') AS value, {at} FROM range(12)""")
    letters = dead_letters.Letters(spark, scratch("letters"))
    for _ in range(2):
        letters.publish(dead_letters.dead_letters(rows, F.lit("bad"), "test", F.col("at"), payload=F.col("value")))
    return letters


def test_a_replay_that_breaks_off_sends_nothing_twice(spark, scratch):
    letters, sent = published(spark, scratch), scratch("sent")
    ids = letters.current().filter("event_id <> 'E0'").select("id")

    def breaks(messages, attempt):
        files.write_messages(messages, sent, attempt)
        raise OSError("after sending, before marking")

    with pytest.raises(OSError):
        letters.replay(ids, breaks, 1)
    assert letters.current().filter("status = 'pending'").count() == 12
    send = lambda messages, attempt: files.write_messages(messages, sent, attempt)
    assert letters.replay(letters.current().limit(1).select("id"), send, 1)  # the same attempt: its own letters, whatever is asked now
    assert not letters.replay(ids, send, 1)
    assert letters.replay(letters.current().select("id"), send, 2)
    assert sorted(r.key for r in files.read_messages(spark, sent).collect()) == sorted(f"F{i}" for i in range(12) if i % 4 != 3)
    assert {r.status: r.letters for r in dead_letters.letter_stats(letters.current()).collect()} == {"replayed": 9, "replay_failed": 3}


def test_a_status_change_writes_its_letters_only(spark, scratch):
    letters = published(spark, scratch)
    stored = lambda: stored_rows(spark, letters)
    assert stored() == 12
    letters.replay(letters.current().filter("event_id = 'E1'").select("id"), lambda messages, attempt: None, 1)
    assert stored() == 13
    letters.publish(letters.current().filter("event_id = 'E1'").withColumn("status", F.lit("pending")))  # published again: still replayed
    assert letters.current().filter("status = 'replayed'").count() == 1 and stored() == 13


def test_plain_and_changing_tables_are_read_alike(spark, scratch):
    rows, plain, changing = frame(spark, [("a", D1, 1, "x")]), scratch("plain"), scratch("changing")
    tables.write_days(rows, plain)
    table_at(spark, changing, keys=None).append(rows)
    assert content(tables.read(spark, plain, rows.schema)) == content(tables.read(spark, changing, rows.schema)) == [("a", str(D1), 1)]
