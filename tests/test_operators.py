"""Resampling, reduced topics and small statistics on small rows, against plain Python and numpy."""

import decimal
import hashlib
import itertools
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import resample, runs, stats, svd, tree
from threadloom.sources import tables


def test_hash_rank_in_buckets_equals_one_sort(spark, monkeypatch):
    monkeypatch.setattr(resample, "BUCKET_ROWS", 3)
    rows = [(str(i), "a" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, g string")
    got = {(r["perm_id"], r["id"]): r["rank"] for r in resample.hash_rank(df, "id", 2, within=("g",)).collect()}
    for p in range(2):
        for g in ("a", None):
            order = sorted((i for i, x in rows if x == g), key=lambda i: (hashlib.md5(f"{p}|42|{i}".encode()).hexdigest(), i))
            assert [got[p, i] for i in order] == list(range(1, len(order) + 1))


def test_dealt_values_keep_their_counts(spark):
    df = spark.createDataFrame([(str(i), i % 2, "x" if i < 7 else None) for i in range(20)], "id string, g int, v string")
    out = resample.deal(df, "id", "v", 3, within=("g",))
    n = {(r["perm_id"], r["g"], r["v_perm"]): r["count"] for r in out.groupBy("perm_id", "g", "v_perm").count().collect()}
    want = {(r["g"], r["v"]): r["count"] for r in df.groupBy("g", "v").count().collect()}
    assert n == {(p, *k): c for p in range(3) for k, c in want.items()}
    assert resample.deal(df.limit(0), "id", "v", 3).count() == 0


def test_equal_samples_take_the_smallest_period(spark):
    df = spark.createDataFrame([(f"{p}{r}{i}", p, r) for p, n in (("a", 3), ("b", 5)) for r in ("user", "assistant") for i in range(n)] + [("z", "a", "tool")], "id string, p string, r string")
    n = resample.sample_equal(df, "id", "p", "r", 2).groupBy("perm_id", "p", "r").count().collect()
    assert len(n) == 8 and {r["count"] for r in n} == {3}


def test_rank_sum_against_enumeration(spark):
    r = random.Random(2)
    cases = [([1.0, 2.0, 5.0, 7.0], [3.0, 4.0, 2.0, 0.0]), ([1.0], [1.0, 1.0]), ([1.0, 1.0, 2.0], [1.0, 1.0, 2.0])]
    cases += [([float(r.randint(0, 9)) for _ in range(n)], [float(r.randint(0, 9)) for _ in range(12 - n)]) for n in (1, 5, 6, 11)]
    for a, b in cases:
        df = spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b] + [(True, None)], "g boolean, v double")
        got = resample.rank_sum(df, F.col("g"), "v").first()
        u, p = mann_whitney_greater(a, b)
        assert (got["n_a"], got["n_b"], got["u"]) == (len(a), len(b), u) and got["p_greater"] == pytest.approx(p, abs=1e-12)
    assert resample.rank_sum(spark.range(30), F.lit(True), "id").first()["p_greater"] is None
    assert resample.rank_sum(spark.range(0), F.lit(True), "id").collect() == []


def test_rank_sum_of_many_values(spark, monkeypatch):
    """The normal limit meets the exact count where both can be had, and ranks by ranges are those of one sort."""
    df = spark.range(180).select((F.col("id") % 3 == 0).alias("g"), ((F.col("id") * 37 % 101) + F.when(F.col("id") % 3 == 0, 7).otherwise(0)).alias("v"))
    exact, near = (resample.rank_sum(df, F.col("g"), "v", n).first() for n in (200, 10))
    assert exact["u"] == near["u"] and exact["p_greater"] == pytest.approx(near["p_greater"], abs=2e-3)
    monkeypatch.setattr(resample.running, "__defaults__", (20,))
    assert resample.rank_sum(df, F.col("g"), "v").first() == exact


def mann_whitney_greater(a, b):
    """(U of a, exact one-sided p that a is greater) by counting all assignments."""
    both = [*a, *b]
    u = lambda x, y: sum((p > q) + (p == q) / 2 for p in x for q in y)
    picks = list(itertools.combinations(range(len(both)), len(a)))
    null = [u([both[i] for i in c], [both[i] for i in range(len(both)) if i not in c]) for c in picks]
    return u(a, b), sum(x >= u(a, b) for x in null) / len(picks)


def student_two_sided(rho, n):
    """Two-sided p of a correlation of n pairs under Student's t: Simpson's rule of the tail in the angle, where the density is smooth."""
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t = abs(rho) * math.sqrt(df / (1 - rho * rho))
    steps = 20_000
    a, b = math.atan(t / math.sqrt(df)), math.pi / 2
    h = (b - a) / steps
    f = lambda u: math.cos(u) ** (df - 1)
    total = f(a) + f(b) + sum((4 if k % 2 else 2) * f(a + k * h) for k in range(1, steps))
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * norm * total * h / 3


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 30.0, 1e4, 1e9, 1e15]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(stats.log_gamma(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in got] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-13)


@pytest.mark.parametrize("p", [0.5, 0.2, 0.93])
def test_binomial_against_exact_sums(spark, p):
    r = random.Random(int(p * 100))
    cases = [(k, n) for n in (1, 2, 3, 10, 47) for k in {0, 1, n // 2, n - 1, n}] + [(r.randint(0, n), n) for n in (200, 1000) for _ in range(4)] + [(int(p * 1000), 1000), (int(p * 1000) - 30, 1000)]
    got = {(x["k"], x["n"]): x["p_value"] for x in stats.binomial_two_sided(spark.createDataFrame([*cases, (0, 0)], "k long, n long"), "k", "n", p).collect()}
    assert got[0, 0] is None
    share = Fraction(p).limit_denominator(100)
    for k, n in cases:
        pmf = [math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(n + 1)]
        want = float(sum(q for q in pmf if q <= pmf[k] * (1 + Fraction(1, 10**7))))
        assert got[k, n] == pytest.approx(want, rel=1e-9), (k, n)


def test_binomial_of_a_billion(spark):
    """A tail of a billion draws, by the ratios of its terms in sixty digits."""
    n, k = 10**9, 500_040_000
    got = stats.binomial_two_sided(spark.createDataFrame([(k, n), (n // 2, n)], "k long, n long"), "k", "n").orderBy("k").collect()
    assert got[0]["p_value"] == 1.0
    decimal.getcontext().prec = 60
    D = decimal.Decimal
    pi = D("3.14159265358979323846264338327950288419716939937510582097494")
    ln_fact = lambda m: (D(m) + D("0.5")) * D(m).ln() - D(m) + (2 * pi).ln() / 2 + 1 / (12 * D(m)) - 1 / (360 * D(m) ** 3)
    first = float((ln_fact(n) - ln_fact(k) - ln_fact(n - k) + n * D("0.5").ln()).exp())
    i = np.arange(k, k + 900_000, dtype=float)
    want = 2 * first * (1 + np.cumprod((n - i) / (i + 1)).sum())
    assert got[1]["p_value"] == pytest.approx(want, rel=1e-9)


def test_correlation_pvalue_against_the_integral(spark):
    cases = [(0.5, 8), (-0.857, 8), (0.643, 9), (0.1, 3), (0.3, 4), (0.9, 5), (1.0, 6), (0.0, 30)]
    df = spark.createDataFrame([*cases, (0.5, 2), (None, 9)], "r double, n int")
    got = [x["p"] for x in df.select(stats.correlation_pvalue(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[: len(cases)] == pytest.approx([student_two_sided(r, n) for r, n in cases], abs=1e-9)
    assert got[-2:] == [None, None]


def test_reduced_space_against_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.random((40, 3)) @ rng.random((3, 25)) + 0.01 * rng.random((40, 25))
    dense[rng.random(dense.shape) < 0.5] = 0
    long = spark.createDataFrame([(d, f"t{t:02}", float(dense[d, t])) for d in range(40) for t in range(25) if dense[d, t]], "doc_id int, term string, weight double").repartition(3)
    terms = svd.vocabulary(long)
    rows = svd.packed(long, terms, "doc_id")
    v, s = svd.decompose(rows, terms.count(), 4, more=15, passes=8)
    _, want, basis = np.linalg.svd(dense, full_matrices=False)
    assert s == pytest.approx(want[:4], rel=1e-6)
    assert np.abs(np.sum(v * basis[:4].T, axis=0)) == pytest.approx(np.ones(4), abs=1e-5)
    got = {r["doc_id"]: r["vec"] for r in svd.project(rows, "doc_id", v, unit=False).collect()}
    for d, x in got.items():
        assert x == pytest.approx(dense[d] @ v)
    assert all(math.isclose(sum(x * x for x in r["vec"]), 1.0) for r in svd.project(rows, "doc_id", v).collect())
    assert svd.decompose(rows.limit(0), 0, 4)[0].shape == (0, 0)


def test_reduced_topics_of_new_rows(spark):
    long = spark.createDataFrame([(i, t, 1.0) for i in range(20) for t in (("red", "blue") if i % 2 else ("dog", "cat"))], "id int, term string, weight double")
    model = svd.fit(long, "id", [(2, 2)])[2, 2]
    got = {r["id"]: r["cluster"] for r in model.transform(long, "id").collect()}
    assert len({(i % 2, c) for i, c in got.items()}) == 2
    new = spark.createDataFrame([(1, "blue", 1.0), (2, "dog", 1.0), (3, "unseen", 1.0)], "id int, term string, weight double")
    told = {r["id"]: r["cluster"] for r in model.transform(new, "id").collect()}
    assert told == {1: got[1], 2: got[0]}


def test_export_shapes(spark, tmp_path):
    node = lambda parent, content, at: {"parent": parent, "message": {"author": {"role": "User"}, "create_time": at, "content": content}}
    nodes = {
        "a": node(None, {"parts": ["  one", {"text": "two"}, {"k": 1}, None, 3, True, "{not json}", {"text": 5}]}, 1.0),
        "b": node("a", {"text": "plain \n"}, 2.0), "c": node("gone", {"value": "v"}, None), "d": node("a", "bare", "x"), "e": {"parent": "b", "message": None},
    }
    f = tmp_path / "e.json"
    f.write_text(json.dumps([{"id": "t", "title": None, "mapping": nodes}, {"id": "u", "mapping": {}}, {"id": "w", "mapping": []}]))
    got = {r["node_id"]: r for r in tables.export_nodes(tables.read_export(spark, str(f))).collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a": 'one\ntwo\n{"k":1}\nNone\n3\nTrue\n{not json}\n{"text":5}', "b": "plain", "c": "v", "d": "bare", "e": ""}
    assert got["a"]["role"] == "user" and got["d"]["ts"] is None and got["c"]["parent_id"] == "gone"
    counted = tables.export_counts(tables.read_export(spark, str(f), keep_empty=True)).first()
    assert tuple(counted) == (3, 2, 5)
    lines = tmp_path / "e.jsonl"
    lines.write_text("".join(json.dumps(x) + "\n" for x in json.loads(f.read_text())))
    assert sorted(map(str, tables.read_export(spark, str(lines), lines=True).collect())) == sorted(map(str, tables.read_export(spark, str(f)).collect()))
    f.write_text("\n  {}")
    with pytest.raises(ValueError):
        tables.read_export(spark, str(f))
    f.write_text("[]")
    assert tables.read_export(spark, str(f)).collect() == []


def test_join_with_a_map_checks_its_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, tables.join_unique(left, spark.createDataFrame([(1, 7), (3, None)], "k int, d int"), "k").collect())) == [(1, "a", 7), (3, "c", None)]
    with pytest.raises(Exception, match="isn't unique"):
        tables.join_unique(left, spark.createDataFrame([(1, 7), (1, 7)], "k int, d int"), "k").collect()


def test_paths_and_cluster_files(spark, tmp_path):
    for folder, name, head in (("a", "x.csv", "node_id,cluster"), ("b", "x.csv", "node_id,text"), ("b/c", "y.csv", "macro_domain,node_id,z"), ("b", "z.txt", "node_id,topic")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(head + "\n")
    assert tables.find_path(spark, "x.csv", [str(tmp_path / "none"), str(tmp_path / "b"), str(tmp_path / "a")]) == str(tmp_path / "b" / "x.csv")
    assert tables.find_path(spark, "q.csv", [str(tmp_path)]) is None
    found = [f.removeprefix("file:") for f in tables.find_cluster_files(spark, str(tmp_path))]
    assert found == [str(tmp_path / "a" / "x.csv"), str(tmp_path / "b" / "c" / "y.csv")]
    tables.write_config({"b": 1, "a": [2]}, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == {"a": [2], "b": 1}
    with pytest.raises(ValueError, match="missing columns: t"):
        tables.require(spark.range(1), ["id", "t"])


def test_report(spark):
    page = tables.report_html("A <title>", [("Head", "x & y", spark.createDataFrame([(1, "<b>"), (2, None)], "n int, t string")), ("Picture", "", b"\x89PNG"), ("Words", "only", None)])
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>")
    assert "A &lt;title&gt;" in page and "<td>&lt;b&gt;</td>" in page and "x &amp; y" in page and "src='data:image/png;base64,iVBORw=='" in page


def test_labels(spark):
    rows = [(0.0, "2025-07", 0.75), (1.5, "nothing", -0.45), (1746098096.789012, None, 0.2), (None, "2024-12", 0.05), (-1.0, "2025-05", -0.9)]
    df = spark.createDataFrame(rows, "s double, m string, r double")
    got = df.select(text.epoch_to_iso(F.col("s")), text.month_label(F.col("m")), text.month_label(F.col("m"), year=True), text.trend_word(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [
        ("1970-01-01T00:00:00+00:00", "Jul", "Jul '25", "strongly increasing"), ("1970-01-01T00:00:01.500000+00:00", "nothing", "nothing", "moderately decreasing"),
        ("2025-05-01T11:14:56.789012+00:00", None, None, "slightly increasing"), ("", "Dec", "Dec '24", "stable"), ("1969-12-31T23:59:59+00:00", "May", "May '25", "strongly decreasing"),
    ]
    weeks = spark.sql("select timestamp_ntz'2025-05-11 23:59:59' as a, timestamp_ntz'2025-05-12 00:00:00' as b, timestamp_ntz'2025-01-01 00:00:00' as c")
    assert tuple(weeks.select(*[text.week_label(F.col(c)) for c in "abc"]).first()) == ("2025-05-05/2025-05-11", "2025-05-12/2025-05-18", "2024-12-30/2025-01-05")


@pytest.mark.parametrize("bucket_rows", [1_000_000, 13])
def test_count_windows_in_ranges(spark, bucket_rows):
    """Numbered in many ranges or in one, with a time that many rows share."""
    rows = [(i, 5 if 20 <= i < 60 else i) for i in range(107)]
    df = spark.createDataFrame(rows, "id int, at int").repartition(5)
    got = {r["id"]: (r["window"], r["place"]) for r in runs.count_windows(df, ["at", "id"], 10, bucket_rows=bucket_rows).collect()}
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert got == {i: (k // 10, k % 10) for k, i in enumerate(order) if k < 100}


def test_dealt_values_of_many_stretches(spark):
    """Without groups, where some values have far more rows than others."""
    df = spark.createDataFrame([(str(i), min(i // 3, 20) if i % 7 else None) for i in range(400)], "id string, v int")
    out = resample.deal(df, "id", "v", 2).groupBy("perm_id", "v_perm").count().collect()
    want = {r["v"]: r["count"] for r in df.groupBy("v").count().collect()}
    assert {(r["perm_id"], r["v_perm"]): r["count"] for r in out} == {(p, v): n for p in range(2) for v, n in want.items()}


def test_count_draws(spark):
    """Tables drawn from counts keep both margins, and their means are those of a permutation of rows."""
    rows = [(m, r, d) for m, n in (("a", 6), ("b", 4)) for i in range(n) for r, d in ((("user", "assistant")[i % 2], i % 3), ("user", 1))]
    df = spark.createDataFrame(rows, "m string, r string, d int")
    got = resample.count_draws(df, "r", "d", 400, within=("m",)).collect()
    count = lambda key, of: {k: sum(x["n"] for x in of if key(x) == k) for k in {key(x) for x in of}}
    by = lambda *i: (lambda x: tuple(x[j] for j in i))
    real = [{"m": m, "r": r, "d": d, "n": 1} for m, r, d in rows]
    for p in (0, 7, 399):
        own = [x for x in got if x["perm_id"] == p]
        for margin in (("m", "r"), ("m", "d")):
            assert count(by(*margin), own) == count(by(*margin), real)
    left, right, all_ = count(by("m", "r"), real), count(by("m", "d"), real), count(by("m"), real)
    mean = count(by("m", "r", "d"), got)
    for (m, r, d), n in mean.items():
        assert n / 400 == pytest.approx(left[m, r] * right[m, d] / all_[(m,)], abs=0.25)
    again = resample.count_draws(df.repartition(5), "r", "d", 400, within=("m",)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_trend_shuffle(spark):
    """Against all orders of four values: shares near the exact ones."""
    import itertools

    rows = [("a", k, v) for k, v in enumerate([1.0, 2.0, 4.0, 3.0])] + [("b", k, 4.0 - k) for k in range(4)] + [("c", k, 1.0) for k in range(4)]
    got = {r["k"]: r for r in resample.trend_shuffle(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v", 3000).collect()}
    rho = lambda x: float(np.corrcoef(range(4), x)[0, 1])
    for key, ranks in (("a", [1, 2, 4, 3]), ("b", [4, 3, 2, 1])):
        real, null = rho(ranks), [rho(p) for p in itertools.permutations(ranks)]
        assert got[key]["rho"] == pytest.approx(real)
        assert got[key]["p_one_tail"] == pytest.approx(np.mean([n >= real - 1e-9 for n in null]), abs=0.03)
        assert got[key]["p_two_tail"] == pytest.approx(np.mean([abs(n) >= abs(real) - 1e-9 for n in null]), abs=0.03)
    assert got["c"]["rho"] is None


def test_main_path_cases(spark):
    # thread x: a tie of depths goes to the earlier child; y: an orphan is a root; z: a cycle alone.
    rows = [("x", "r", None, 0), ("x", "b", "r", 2), ("x", "a", "r", 1), ("x", "c", "a", 9), ("x", "d", "b", 3), ("y", "o", "gone", 0), ("y", "p", "o", 1)]
    df = spark.createDataFrame(rows, "t string, n string, p string, ts int")
    path = {}
    for r in tree.main_path(df, "t", "n", "p", "ts").orderBy("t", "pos").collect():
        path.setdefault(r["t"], []).append(r["n"])
    assert path == {"x": ["r", "a", "c"], "y": ["o", "p"]}


@pytest.mark.parametrize("seed", [1, 2])
def test_main_path_of_large_threads(spark, seed):
    """Walked by joins, odd threads give the paths of walking in one group: chains, stars, ties, orphans, cycles, repeated and null ids."""
    r = random.Random(seed)
    rows = [("chain", f"n{i}", f"n{i - 1}" if i else None, i) for i in range(70)]
    rows += [("star", f"n{i}", "n0" if i else None, 5 if i else 0) for i in range(60)] + [("self", "a", "a", 1), ("self", "b", "a", 2)]
    rows += [("ring", f"n{i}", f"n{(i + 1) % 4}", 3 - i) for i in range(4)] + [("ring", "x", "n2", 0), ("rho", "a", "z", 1), ("rho", "z", "y", 1), ("rho", "y", "z", 1), ("rho", "b", "a", 0)]
    rows += [(None, "a", None, 2), (None, "b", "a", None), (None, "c", "a", 7), (None, None, "a", 1), ("twice", "a", None, 3), ("twice", "b", "a", 4), ("twice", "a", "b", 9), ("twice", "b", "a", 4)]
    for t in range(6):
        n = r.randrange(2, 40)
        rows += [(f"r{t}", f"n{i:02}", r.choice([None, "gone", *(f"n{j:02}" for j in range(n + 1))]) if r.random() < 0.15 else f"n{r.randrange(max(i, 1)):02}", r.choice([None, 1, 2, 3])) for i in range(n)]
    df = spark.createDataFrame(rows, "t string, n string, p string, ts int").repartition(3)
    want, got, both = (sorted(map(tuple, tree.main_path(df, "t", "n", "p", "ts", most_rows=m).collect()), key=str) for m in (1_000, 0, 30))
    assert got == want == both
    paths = {t: [n for t2, _, n in sorted(want, key=lambda x: x[1]) if t2 == t] for t in {x[0] for x in want}}
    assert len(paths["chain"]) == 70 and paths["star"] == ["n0", "n1"] and paths["self"] == ["a", "b"]
    assert paths[None] == ["a", "c"] and paths["twice"] == ["a", "b"] and paths["rho"] == ["a", "b"] and paths["ring"] == ["n0", "n3", "n2", "x"]
    assert tree.main_path(df.limit(0), "t", "n", "p", "ts", most_rows=0).count() == 0


def test_coupling_reads_its_rows_once(spark, monkeypatch):
    """What weekly_coupling makes of the counts never goes back to the table."""
    from pathlib import Path

    from threadloom.plans import catalog, more

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no tables here")
    plan = more.weekly_coupling(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_partkey" not in plan
    assert "o_orderkey" not in catalog.monthly_coupling_pvalues(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
