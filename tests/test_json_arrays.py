import json
import random

import pytest

from skyledger.sources import files, json_arrays


def nasty(rng, depth=0):
    """Objects whose strings hold braces, brackets, quotes, backslashes and line breaks."""
    text = lambda: "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ",", "\n", "a", "é", "日", " "]) for _ in range(rng.randrange(12)))
    row = {"event_id": f"E{rng.randrange(10**6)}", text() or "k": text(), "altitude": rng.choice([None, 1, -2.5, "7"])}
    if depth < 2 and rng.random() < 0.5:
        row["inner"] = [nasty(rng, depth + 1) for _ in range(rng.randrange(3))] + [{}]
    return row


def written(spark, path, texts):
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, text in enumerate(texts):
        stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/f{i}.json"))
        stream.write(bytearray(text.encode()))
        stream.close()
    return path


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "700")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_equal_the_plain_parser(spark, scratch, small_ranges, indent):
    rng = random.Random(indent or 1)
    arrays = [[nasty(rng) for _ in range(n)] for n in (60, 1, 0, 25)] + [[{"event_id": "wide", "note": "}{" * 1500}, {"event_id": "next"}]]
    path = written(spark, scratch("arrays"), [json.dumps(a, indent=indent, ensure_ascii=rng.random() < 0.5) for a in arrays])
    rows = json_arrays.fragments(spark, path)
    assert rows.select("file", "block").distinct().count() > 12  # several ranges of one file
    found = [json.loads(r.value) for r in json_arrays.elements(rows).collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, found)) == sorted(key(x) for a in arrays for x in a)


def test_files_of_other_shapes(spark, scratch, small_ranges):
    path = written(spark, scratch("shapes"), ['{"event_id":"single"}', '[{"event_id":"a"},{"event_id":', "[]", "", "[\n]\n", '\ufeff[{"event_id":"marked"}]\n\n', '[{"event_id":"x"}, oops {"event_id":"y"}]'])
    rows = files.read_json_files(spark, path, outer_array=True).collect()
    assert sorted(r.event_id for r in rows if r._corrupt is None) == ["a", "marked", "single", "x"]
    assert sum(r._corrupt is not None for r in rows) == 2


def test_a_load_takes_each_file_once(spark, scratch, small_ranges):
    rng = random.Random(5)
    source, target, checkpoint = scratch("source"), scratch("target"), scratch("cp")
    sizes = (40, 30)
    for part, n in enumerate(sizes):
        written(spark, f"{source}/p{part}", [json.dumps([{"event_id": f"E{part}-{i}", "altitude": i, "status": "}]" * rng.randrange(9)} for i in range(n)])])
        for _ in range(2):
            files.load_new_files(spark, f"{source}/*", target, checkpoint, outer_array=True)
        assert files.load_counts(spark, target).first().rows_loaded == sum(sizes[:part + 1])
    assert {r.event_id for r in files.loaded_rows(spark, target).collect()} == {f"E{p}-{i}" for p, n in enumerate(sizes) for i in range(n)}
