"""Lookups by thread and time against filters, and what is skipped; streams against one read, killed and fed twice."""

import glob
import json
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadloom.sources import layout, tables
from threadloom.streaming import ingest

DAY = datetime(2025, 5, 1)


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [(f"t{r.randint(0, 400) * 2:04}" if i % 3 else "t0100", DAY + timedelta(minutes=r.randint(0, 200_000)), f"text {i}" * 20) for i in range(20_000)]
    rows += [(None, DAY, "no thread"), ("t0002", None, "no time")]
    df = spark.createDataFrame(rows, "thread string, at timestamp, text string").repartition(3)
    path = f"file://{tmp_path_factory.mktemp('layout')}/x"
    layout.write_layout(df, path, "thread", "at", file_rows=3_000, group_bytes=20_000)
    return df, path


def read_rows(df):
    """Rows that the scans of a query gave."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName().startswith("Scan parquet"):
            out.append(p.metrics().apply("numOutputRows").value())
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            walk(p.executedPlan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(out)


def plain(df):
    return sorted(map(str, df.collect()))


def groups(path, threads):
    """(row groups in all, those whose span holds a thread, rows of these) of the files as they are."""
    all_ = near = rows = 0
    for f in glob.glob(f"{path.removeprefix('file://')}/rows/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            all_ += 1
            if stats is not None and stats.has_min_max and any(stats.min <= t <= stats.max for t in threads):
                near += 1
                rows += meta.row_group(g).num_rows
    return all_, near, rows


@pytest.mark.parametrize("threads", [["t0100"], ["t0002", "t0700"], ["t0101"], ["zzz"], [], [None, "t0004"]])
def test_threads(spark, laid, threads):
    df, path = laid
    got = layout.lookup_threads(spark, path, "thread", threads)
    assert plain(got) == plain(df.where(F.col("thread").isin(*[t for t in threads if t])))


def test_row_groups_are_skipped(spark, laid):
    df, path = laid
    all_, near, rows = groups(path, ["t0702"])
    assert all_ > 10 and near <= 2
    assert df.where("thread = 't0702'").count() <= read_rows(layout.lookup_threads(spark, path, "thread", ["t0702"])) <= rows < df.count() / 5
    # A thread between two that are there: statistics let it through, the filter of its row group doesn't.
    _, near, rows = groups(path, ["t0703"])
    assert near >= 1 and rows > 0 and read_rows(layout.lookup_threads(spark, path, "thread", ["t0703"])) == 0
    assert len(layout.files_of(spark, path, ["t0702"])) < len(glob.glob(f"{path.removeprefix('file://')}/rows/*.parquet")) / 2


def test_hot_thread_is_cut_by_time(spark, laid):
    df, path = laid
    assert len(layout.files_of(spark, path, ["t0100"])) >= 2
    m = spark.read.parquet(f"{path}/manifest")
    assert m.agg(F.sum("n")).first()[0] == df.count() and m.agg(F.max("n")).first()[0] < 6_000


@pytest.mark.parametrize("most", [1_000, 2])
def test_times(spark, laid, monkeypatch, most):
    monkeypatch.setattr(layout, "LISTED_THREADS", most)
    df, path = laid
    for a, b in ((100, 160), (0, 200_001), (300_000, 400_000)):
        start, end = DAY + timedelta(minutes=a), DAY + timedelta(minutes=b)
        got = layout.lookup_times(spark, path, "thread", "at", start, end)
        assert plain(got) == plain(df.where((F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(end))))


def test_empty_layout(spark, tmp_path):
    df = spark.createDataFrame([], "thread string, at timestamp")
    layout.write_layout(df, f"file://{tmp_path}/x", "thread", "at")
    assert layout.lookup_threads(spark, f"file://{tmp_path}/x", "thread", ["a"]).collect() == []
    assert layout.lookup_times(spark, f"file://{tmp_path}/x", "thread", "at", DAY, DAY + timedelta(days=1)).collect() == []


def conversation(i, version=0):
    mapping = {f"{i}-{k}": {"parent": f"{i}-{k - 1}" if k else None, "children": [], "message": {"author": {"role": "User"}, "create_time": 10.0 * k, "content": {"parts": [f"part {k} of {i}, version {version}"]}}} for k in range(4)}
    return {"id": f"c{i}", "title": None, "create_time": 1.0, "update_time": 100.0 + version, "mapping": mapping}


def put(folder, name, conversations):
    (folder / name).write_text(json.dumps(conversations))


def test_stream_killed_and_fed_twice(spark, tmp_path, monkeypatch):
    exports, table, state = tmp_path / "exports", f"file://{tmp_path}/table", f"file://{tmp_path}/state"
    exports.mkdir()
    for i in range(6):
        put(exports, f"a{i}.json", [conversation(3 * i + k) for k in range(3)])
    put(exports, "odd.json", [{"id": "none", "mapping": None}, {"id": "list", "mapping": []}, {"mapping": conversation(99)["mapping"]}])
    real, calls = ingest.nodes, []

    def failing(batch):
        calls.append(1)
        if len(calls) == 3:
            batch.sparkSession.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{table}/batch=2")  # half of a batch's work
            raise RuntimeError("killed")
        return real(batch)

    monkeypatch.setattr(ingest, "nodes", failing)
    with pytest.raises(Exception, match="killed"):
        ingest.start(spark, f"file://{exports}", table, state, files_per_batch=2).awaitTermination()
    monkeypatch.setattr(ingest, "nodes", real)
    ingest.start(spark, f"file://{exports}", table, state, files_per_batch=2).awaitTermination()
    whole = lambda: ingest.latest(real(spark.read.schema(tables.EXPORT).json(f"file://{exports}", multiLine=True)))
    assert plain(ingest.read(spark, table)) == plain(whole()) and whole().count() == 18 * 4
    # The same file under another name, and a newer version of one conversation; an older one comes later still.
    put(exports, "again.json", [conversation(3 * 2 + k) for k in range(3)])
    put(exports, "newer.json", [conversation(4, 7)])
    ingest.start(spark, f"file://{exports}", table, state).awaitTermination()
    put(exports, "older.json", [conversation(4, 3)])
    ingest.start(spark, f"file://{exports}", table, state).awaitTermination()
    got = ingest.read(spark, table)
    assert plain(got) == plain(whole()) and got.count() == 18 * 4
    assert {r["text"] for r in got.where("thread_id = 'c4'").collect()} == {f"part {k} of 4, version 7" for k in range(4)}
    ingest.compact(spark, table, f"file://{tmp_path}/compact")
    assert plain(ingest.read(spark, f"file://{tmp_path}/compact")) == plain(got)
