"""Shuffles of single messages, against plain Python on messages made for it: a month of few messages and empty texts count like any other."""

import hashlib
from collections import Counter, defaultdict

import pytest
from test_nulls import contrasts

from threadloom.plans import catalog


def messages():
    """(conv_id, turn, role, text): seven months of 30 conversations, the last one of 12; some texts are empty, some roles are neither side's."""
    for i in range(240):
        if i % 8 < 7 or i < 96:
            for turn in range(3):
                role = "system" if i % 13 == 5 and turn == 0 else ("user", "assistant")[turn % 2]
                yield i, turn, role, "" if (i + turn) % 9 == 4 else "x" * (1 + (i * i + 3 * turn + i // 8) % 23)


ROWS = [(f"{i}-{turn}", f"2025-{5 + i % 8:02}", role, str((len(text) * 31 + turn) % 8)) for i, turn, role, text in messages() if role in ("user", "assistant")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("shuffles")
    spark.createDataFrame(list(messages()), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def ranked(perm, rows):
    return sorted(rows, key=lambda r: (hashlib.md5(f"{perm}|42|{r[0]}".encode()).hexdigest(), r[0]))


def months_dealt(perm):
    return [(m, r, d) for m, (_, _, r, d) in zip(sorted(x[1] for x in ROWS), ranked(perm, ROWS), strict=True)]


def test_months_are_dealt_to_all_messages(spark, folder):
    got = {r["perm_id"]: r.asDict() for r in catalog.QUERIES["perm_month_shuffle"](spark, folder).collect()}
    assert sorted(got) == list(range(catalog.DRAWS))
    for perm in (0, 1, 57, 199):
        want = contrasts(Counter(months_dealt(perm)))
        assert {c: got[perm][c] for c in want} == pytest.approx(want, abs=2e-9)


def by_month(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return out


def roles_dealt(perm):
    return [(m, r, d) for m, rows in by_month(ROWS).items() for r, (_, _, _, d) in zip(sorted(x[2] for x in rows), ranked(perm, rows), strict=True)]


def test_roles_are_dealt_to_all_messages_of_a_month(spark, folder):
    got = defaultdict(dict)
    for r in catalog.QUERIES["perm_role_shuffle"](spark, folder).collect():
        got[r["perm_id"]][r["month"], str(r["domain"])] = r["user_n"]
    assert sorted(got) == list(range(catalog.DRAWS))
    cells = {(m, d) for _, m, _, d in ROWS}
    for perm in (0, 1, 57, 199):
        want = Counter((m, d) for m, r, d in roles_dealt(perm) if r == "user")
        assert got[perm] == {c: want[c] for c in cells}


def sampled(perm):
    sides = defaultdict(list)
    for r in ROWS:
        sides[r[1], r[2]].append(r)
    floor = {side: min(len(x) for (_, r), x in sides.items() if r == side) for side in ("user", "assistant")}
    return [r[1:] for (_, side), rows in sides.items() for r in ranked(perm, rows)[: floor[side]]]


def test_pvalues_are_of_all_messages(spark, folder):
    got = {r["model"]: r.asDict() for r in catalog.QUERIES["null_model_pvalues"](spark, folder).collect()}
    real = contrasts(Counter(r[1:] for r in ROWS))
    assert set(got) == {"months", "roles", "volume"}
    for model, draw in {"months": months_dealt, "roles": roles_dealt, "volume": sampled}.items():
        drawn = [contrasts(Counter(draw(perm))) for perm in range(catalog.DRAWS)]
        for name, value in real.items():
            assert got[model][f"real_{name}"] == pytest.approx(value, abs=2e-9)
            far = [x[name] >= value - 2e-9 if value >= 0 else x[name] <= value + 2e-9 for x in drawn if x[name] is not None]
            assert got[model][f"p_{name}"] == pytest.approx(sum(far) / len(far), abs=1e-6)
