from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyledger.operators import merge
from skyledger.sources import tables

SCHEMA = "event_id string, event_date date, n int, note string"
D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(df):
    return sorted((r.event_id or "", str(r.event_date), r.n, r.note or "") for r in df.collect())


def test_upsert_updates_named_columns_and_inserts_whole_rows(spark):
    target = frame(spark, [("a", D1, 1, "old"), ("b", D1, 2, "old")])
    source = frame(spark, [("b", D2, 20, None), ("c", D3, 30, "new")])
    merged = merge.upsert_rows(target, source, ["event_id"], ["n", "note"])
    assert content(merged) == [("a", str(D1), 1, "old"), ("b", str(D1), 20, ""), ("c", str(D3), 30, "new")]


def test_upsert_can_update_only_one_column(spark):
    merged = merge.upsert_rows(frame(spark, [("a", D1, 1, "old")]), frame(spark, [("a", D1, 9, "new")]), ["event_id"], ["note"])
    assert content(merged) == [("a", str(D1), 1, "new")]


def test_upsert_of_missing_key_is_idempotent(spark):
    target, source = frame(spark, [(None, D1, 1, "x")]), frame(spark, [(None, D1, 2, "y")])
    assert content(merge.upsert_rows(target, source, ["event_id"], ["n"])) == [("", str(D1), 2, "x")]


def test_insert_only_twice_is_the_same_as_once(spark, scratch):
    path = scratch("insert")
    rows = frame(spark, [("a", D1, 1, "x"), ("a", D1, 2, "x"), ("b", D2, 3, "y")])
    for _ in range(2):
        merge.insert_only(spark, path, rows)
    assert content(tables.read(spark, path, rows.schema)) == [("a", str(D1), 1, "x"), ("b", str(D2), 3, "y")]
    merge.insert_only(spark, path, frame(spark, [("b", D2, 9, "z"), ("c", D3, 4, "z")]))
    assert content(tables.read(spark, path, rows.schema))[-1] == ("c", str(D3), 4, "z")


def test_insert_without_source_dedup_keeps_both(spark):
    source = frame(spark, [("a", D1, 1, "x"), ("a", D1, 2, "x")])
    empty = frame(spark, [])
    assert merge.rows_to_insert(source, empty, dedupe_source=False).count() == 2
    assert merge.rows_to_insert(source, empty).count() == 1


def day_table(spark, path, **options):
    return tables.DayTable(spark, path, frame(spark, []).schema, **options)


def pieces_of(table, day):
    return table.folders(table.state().of("rows", [f"event_date={day}"]))


def test_upsert_days_leaves_other_days_alone(spark, scratch):
    path = scratch("days")
    merge.upsert_days(spark, path, frame(spark, [("a", D1, 1, "x"), ("b", D2, 2, "x"), ("c", D3, 3, "x")]), ["event_id"])
    table = day_table(spark, path, keys=["event_id"])
    before = {day: pieces_of(table, day) for day in (D1, D2, D3)}
    # "a" is known under day 1 although the source dates it day 3
    merge.upsert_days(spark, path, frame(spark, [("a", D3, 10, "y"), ("d", D3, 4, "y")]), ["event_id"], ["n"])
    schema = frame(spark, []).schema
    assert content(tables.read(spark, path, schema)) == [
        ("a", str(D1), 10, "x"), ("b", str(D2), 2, "x"), ("c", str(D3), 3, "x"), ("d", str(D3), 4, "y")]
    after = {day: pieces_of(table, day) for day in (D1, D2, D3)}
    assert after[D2] == before[D2] and after[D1] != before[D1] and after[D3] != before[D3]


def test_replace_days_replaces_exactly_those_days(spark, scratch):
    table = day_table(spark, scratch("replace"))
    table.append(frame(spark, [("a", D1, 1, "x"), ("b", D2, 2, "x")]))
    for _ in range(2):  # the replacement reads the table it replaces
        table.replace(table.rows([D2]).withColumn("n", F.lit(7)), [D2])
    assert content(table.rows()) == [("a", str(D1), 1, "x"), ("b", str(D2), 7, "x")]


def test_a_day_replaced_by_nothing_is_empty(spark, scratch):
    table = day_table(spark, scratch("replace"))
    table.append(frame(spark, [("a", D1, 1, "x"), ("b", D2, 2, "x"), (None, None, 3, "x")]))
    table.replace(frame(spark, []), [D1, None])
    assert content(table.rows()) == [("b", str(D2), 2, "x")]
    with pytest.raises(ValueError, match="not to be replaced"):
        table.replace(frame(spark, [("c", D3, 1, "x")]), [D1])
    assert content(table.rows()) == [("b", str(D2), 2, "x")]


def test_versioned_table_ignores_an_unfinished_version(spark, scratch):
    rows = frame(spark, [("a", D1, 1, "x")])
    table = tables.VersionedTable(spark, scratch("versions"), rows.schema)
    assert table.read().count() == 0
    table.write(rows)
    unfinished = f"{table.path}/v000002"
    rows.withColumn("n", F.lit(99)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(unfinished)
    assert [r.n for r in table.read().collect()] == [1]
    table.write(merge.upsert_rows(table.read(), frame(spark, [("b", D1, 2, "y")]), ["event_id"]))
    assert content(table.read()) == [("a", str(D1), 1, "x"), ("b", str(D1), 2, "y")]


def test_same_key_twice_in_source_keeps_the_earliest(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 2), 2), ("a", datetime(2024, 1, 1), 1), ("a", None, 0)],
                               "event_id string, loaded_at timestamp, n int")
    assert [r.n for r in merge.one_row_per_key(df, ["event_id"]).collect()] == [1]


@pytest.mark.parametrize("hot_rows", [400])
def test_hot_day_is_split_into_files_without_loss(spark, scratch, hot_rows):
    path = scratch("hot")
    data = [(f"h{i}", D1, i, "x") for i in range(hot_rows)] + [(f"c{i}", D2, i, "x") for i in range(5)]
    tables.write_days(frame(spark, data).repartition(4), path)
    assert tables.read(spark, path, frame(spark, []).schema).count() == hot_rows + 5


def test_repeated_source_keys_never_multiply_target_rows(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    source = spark.createDataFrame([("a", 9), ("a", 7), ("c", 5), ("c", 6)], "k string, v int")
    assert sorted(tuple(r) for r in merge.upsert_rows(target, source, ["k"]).collect()) == [("a", 7), ("b", 2), ("c", 5)]
