import os

from medloom.llm import common


def test_scratch_deletes_its_tables(spark):
    with common.scratch(spark):
        rows = common.written(spark.range(5), "x")
        path = rows.inputFiles()[0]
        assert rows.count() == 5 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_texts_come_in_bounded_slices():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 100, "c", "", "d" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(common.texts_of(batch, "text", rows=3, size=12))
    assert [t for p in parts for t in p] == texts and max(map(len, parts)) <= 3 and ["b" * 100] in parts
    assert list(common.texts_of(batch.slice(2, 2), "text")) == [["b" * 100, "c"]]
