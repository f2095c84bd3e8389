"""Published trials, ordered files and numbered lines on real files."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.plans import loglines
from traceloom.session import materialise
from traceloom.sources import published
from traceloom.sources.ordered_files import read_ordered, write_ordered


def threads(spark, n, first=0):
    return spark.createDataFrame([(first + i, 1, i, i, i) for i in range(n)], "id int, machine_id long, process_id long, pid int, tid int")


def test_a_trial_is_published_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path)
    assert published.read_published(spark, folder, "threads").collect() == []
    assert published.publish_trial({"threads": threads(spark, 3)}, folder, "a b/c") == 0
    broken = threads(spark, 3).withColumn("pid", F.when(F.col("id") > 1, F.raise_error(F.lit("lost"))).otherwise(1).cast("int"))
    comms = spark.createDataFrame([(1, "c", 1, 1, True)], "id int, comm string, c_thread_id long, c_time long, exec_flag boolean")
    with pytest.raises(Exception, match="lost"):
        published.publish_trial({"comms": comms, "threads": broken}, folder, "second")
    assert not published.is_published(spark, folder, "second")
    assert published.read_published(spark, folder, "comms").collect() == []
    published.publish_trial({"comms": comms, "threads": threads(spark, 2)}, folder, "second")
    rows = published.read_published(spark, folder, "threads").groupBy("trial").count().collect()
    assert {r.trial: r["count"] for r in rows} == {"a b/c": 3, "second": 2}


def test_replacing_and_refusing(spark, tmp_path):
    folder = str(tmp_path)
    published.publish_trial({"threads": threads(spark, 3)}, folder, "t")
    with pytest.raises(FileExistsError):
        published.publish_trial({"threads": threads(spark, 1)}, folder, "t")
    before = published.read_published(spark, folder, "threads", "t")
    assert published.publish_trial({"threads": threads(spark, 1, 50)}, folder, "t", replace=True) == 1
    assert before.count() == 3  # a reader keeps what it opened
    assert [r.id for r in published.read_published(spark, folder, "threads", "t").collect()] == [50]
    with pytest.raises(ValueError, match="no trace tables"):
        published.publish_trial({"nothing": threads(spark, 1)}, folder, "u")


def test_layouts_and_absent_tables(spark, tmp_path):
    folder = str(tmp_path)
    types = spark.createDataFrame([(1, "call")], "id int, name string")
    cbr = spark.createDataFrame([], "id long, cbr int, mhz int, percent int")
    published.publish_trial({"branch_types": types, "cbr": cbr}, folder, "x")
    assert {r.table_name for r in published.manifest(spark, folder).collect()} == {"branch_types"}
    assert published.read_published(spark, folder, "cbr").columns == ["id", "cbr", "mhz", "percent", "trial"]
    assert published.read_published(spark, folder, "branch_types", "y").collect() == []


def test_reading_ordered_files_is_reading_in_order(spark, tmp_path):
    rnd = random.Random(1)
    data = [(rnd.choice([None, *range(30)]), i) for i in range(500)]
    df = materialise(spark.createDataFrame(data, "k int, i int").repartition(5))
    write_ordered(df, f"{tmp_path}/o", ["k", "i"], rows_per_file=40)
    assert len(list((tmp_path / "o").glob("part-*.parquet"))) > 5
    got = sorted((r.place, r.k, r.i) for r in read_ordered(spark, f"{tmp_path}/o").collect())
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(k, i) for _, k, i in got] == want and [p for p, _, _ in got] == list(range(500))
    write_ordered(df.limit(0), f"{tmp_path}/e", ["k"])
    assert read_ordered(spark, f"{tmp_path}/e").collect() == []


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rnd = random.Random(2)
    texts = {
        "a.log": b"".join(b"%d %s\n" % (i, b"x" * rnd.randrange(90)) for i in range(400)),
        "b.log": b"one\r\n\n\r\nlong " + b"y" * 5000 + b"\nlast without end",
        "c.log": b"",
        "d.log": b"\n" * 900,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1000")
    try:
        got = loglines.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(setting, before)
    found = {}
    for r in sorted(got, key=lambda r: r.line_no):
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    for name, text in texts.items():
        lines = text.decode().split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want = [(i, line.removesuffix("\r")) for i, line in enumerate(lines)]
        assert found.get(name, []) == want, name
