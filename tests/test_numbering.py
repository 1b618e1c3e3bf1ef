"""Places in a global order and in groups, with hot times, hot groups, nulls and equal rows."""

import random

from threadloom.operators import numbering


def test_hot_time_is_cut_by_id(spark):
    r = random.Random(3)
    rows = [(7 if i % 2 else r.randint(0, 20), i) for i in range(400)] + [(None, 900)]
    df = spark.createDataFrame(rows, "at int, id int").repartition(5)
    got = numbering.numbered(df, ["at", "id"], total="n", range_rows=25).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(x["at"], x["id"]) for x in sorted(got, key=lambda x: x["pos"])] == want
    assert {x["n"] for x in got} == {401} and sorted(x["pos"] for x in got) == list(range(401))
    assert numbering.numbered(df.limit(0), ["at", "id"]).count() == 0


def test_groups_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", 3)
    rows = [("hot" if i % 3 else (None if i % 2 else "b"), i % 10) for i in range(300)]
    got = numbering.numbered(spark.createDataFrame(rows, "g string, v int"), ["v"], within=("g",), total="n", range_rows=20).collect()
    for g in ("hot", "b", None):
        own = sorted((x["pos"], x["v"], x["n"]) for x in got if x["g"] == g)
        want = sorted(v for h, v in rows if h == g)
        assert [(p, v) for p, v, _ in own] == list(enumerate(want)) and {n for *_, n in own} == {len(want)}
