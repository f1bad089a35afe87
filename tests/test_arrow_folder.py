"""Arrow folders: partitions, columns, splits, both file formats, and writing."""

import json

import pyarrow as pa
import pytest

from millrace.sources import arrow_folder


@pytest.fixture(scope="module")
def session(spark):
    return arrow_folder.register(spark)


def rows(n, begin=0):
    return pa.table({"id": pa.array(range(begin, begin + n), pa.int64()), "text": [f"t{i}" for i in range(begin, begin + n)], "tags": [[str(i)] * (i % 3) for i in range(begin, begin + n)], "pos": [{"x": float(i)} for i in range(begin, begin + n)]})


def put(path, table, stream, size=10):
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, table.schema) as out:
        out.write_table(table, max_chunksize=size)


def test_streams_are_a_partition_each_and_files_are_cut_at_record_batches(session, tmp_path):
    put(tmp_path / "data-00000.arrow", rows(35), True)
    put(tmp_path / "data-00001.arrow", rows(40, 35), False)
    put(tmp_path / "other.arrow", rows(5, 500), False)
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": "data-00000.arrow"}, {"filename": "data-00001.arrow"}]}))
    read = session.read.format("arrow_folder")
    df = read.load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    got = {r["id"]: (r["text"], r["tags"], r["pos"]["x"]) for r in df.collect()}
    assert got == {i: (f"t{i}", [str(i)] * (i % 3), float(i)) for i in range(75)}
    cut = session.read.format("arrow_folder").option("partBytes", 1).load(f"file://{tmp_path}")
    assert cut.rdd.getNumPartitions() == 1 + 4
    assert cut.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() == [35, 10, 10, 10, 10]
    assert sorted(r["id"] for r in cut.select("id").collect()) == list(range(75))


def test_only_wanted_columns_are_read(session, tmp_path):
    put(tmp_path / "a.arrow", rows(5), False)
    df = session.read.format("arrow_folder").option("columns", "text, id").load(str(tmp_path))
    assert df.columns == ["text", "id"] and sorted(tuple(r) for r in df.collect()) == [(f"t{i}", i) for i in range(5)]
    taken = arrow_folder.ArrowFolderReader(df.schema, {"path": str(tmp_path)})
    assert [b.schema.names for p in taken.partitions() for b in taken.read(p)] == [["text", "id"]]
    with pytest.raises(Exception, match="no column"):
        session.read.format("arrow_folder").schema("id long, absent string").load(str(tmp_path)).collect()


def test_splits(session, tmp_path):
    (tmp_path / "dataset_dict.json").write_text(json.dumps({"splits": ["train", "test"]}))
    for k, s in enumerate(("train", "test")):
        (tmp_path / s).mkdir()
        put(tmp_path / s / "data.arrow", rows(10 + k, 100 * k), k == 0)
    count = lambda **o: session.read.format("arrow_folder").options(**o).load(str(tmp_path)).count()
    assert (count(), count(split="train"), count(split="test")) == (21, 10, 11)
    with pytest.raises(Exception, match="no split"):
        count(split="dev")


def test_written_folders_are_read_back(session, tmp_path):
    path = str(tmp_path / "new")
    df = session.range(0, 25_000, 1, 3).selectExpr("id", "IF(id % 7 = 0, NULL, concat('t', id)) AS text", "array(id, id + 1) AS pair", "CAST(id AS timestamp) AS at", "named_struct('x', id / 4) AS s")
    df.write.format("arrow_folder").mode("overwrite").save(path)
    back = session.read.format("arrow_folder").load(path)
    assert back.rdd.getNumPartitions() == 3 and back.dtypes == df.dtypes
    assert back.exceptAll(df).isEmpty() and back.count() == 25_000
    df.limit(10).write.format("arrow_folder").mode("append").save(path)
    assert session.read.format("arrow_folder").load(path).count() == 25_010
    df.limit(4).write.format("arrow_folder").mode("overwrite").save(path)
    assert session.read.format("arrow_folder").load(path).count() == 4


def test_empty_folders(session, tmp_path):
    with pytest.raises(Exception, match="no Arrow files"):
        session.read.format("arrow_folder").load(str(tmp_path)).count()
    assert session.read.format("arrow_folder").schema("id long").load(str(tmp_path)).count() == 0
    put(tmp_path / "a.arrow", rows(0), True)
    assert session.read.format("arrow_folder").load(str(tmp_path)).count() == 0
