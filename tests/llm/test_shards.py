import zlib

from skyledger.llm import balanced_shards as B


def shards_of(docs, shards):
    return B.assign(B.sized(docs), shards)


def test_contiguous_balanced_and_gapless(documents):
    rows = [(i * 7 % 501, "é" * (i % 90) + "x" * (i * i % 400)) for i in range(501)]
    found = shards_of(documents(rows), 7).collect()
    texts = dict(rows)
    by = {}
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(7)) and len(found) == 501
    order = []
    for shard in sorted(by):
        by[shard].sort(key=lambda r: r.slot)
        assert [r.slot for r in by[shard]] == list(range(len(by[shard])))
        order += [r.doc_id for r in by[shard]]
    assert order == sorted(texts)
    share, largest = sum(r.size for r in found) / 7, max(r.size for r in found)
    assert all(abs(sum(r.size for r in rows) - share) <= largest for rows in by.values())


def test_one_key_for_most_rows_nulls_and_a_long_text(documents):
    rows = [(5, "same")] * 300 + [(None, None)] * 20 + [(9, "y" * 2_000_000)]
    found = shards_of(documents(rows), 4).collect()
    assert len(found) == 321 and {r.shard for r in found} <= {0, 1, 2, 3}
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found))) for s in range(4))
    assert {(r.size, r.text_crc32) for r in found if r.doc_id is None} == {(16, 0)}


def test_empty_table_clashing_columns_and_files(llm, documents, tmp_path):
    docs = documents([(i, "t" * i) for i in range(30)])
    assert shards_of(docs.limit(0), 3).count() == 0
    from pyspark.sql import functions as F

    own = B.sized(docs).select("*", F.lit("a").alias("shard"), F.lit("b").alias("x_part"), F.lit("c").alias("x_before"))
    found = B.assign(own, 3)
    assert found.columns == ["doc_id", "size", "text_crc32", "x_part", "x_before", "shard", "slot"] and found.count() == 30
    B.write_shards(found, f"{tmp_path}/shards")
    assert llm.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().count() == 3
