"""Queries that SQL cannot express against plain restatements over the whole smallest tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from tessera.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars", "text").collect())


def test_knapsack(spark, docs):
    got = defaultdict(dict)
    for r in QUERIES["knapsack_pack"](spark, SF).collect():
        got[r.batch_no][r.doc_id] = (r.knapsack, r.place)
    batches = defaultdict(list)
    for d in docs:
        batches[d.doc_id // 1000].append(d)
    for b, rows in batches.items():
        left, want, k = [(d.n_chars, d.doc_id) for d in rows if d.n_chars <= 4096], {}, 0
        while left:
            room, place = 4096, 0
            while fits := [x for x in left if x[0] <= room]:
                best = max(fits)  # the largest; of equal ones the last
                left.remove(best)
                want[best[1]] = (k, place)
                room, place = room - best[0], place + 1
            k += 1
        assert got[b] == want


def test_balance(spark, docs):
    """Largest differencing on explicit lists of sums and members, without a queue."""
    got = {r.doc_id: r.part for r in QUERIES["kk_balance"](spark, SF).collect()}
    batches = defaultdict(list)
    for d in docs:
        batches[d.doc_id // 64].append(d)
    fall = lambda sets: sorted(sets, key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)
    for rows in batches.values():
        states = [fall([(d.n_chars, [(i, d.n_chars)])] + [(0, [])] * 7) for i, d in sorted(enumerate(rows), key=lambda x: (x[1].n_chars, x[0]))]
        while len(states) > 1:
            states.sort(key=lambda s: (s[0][0] - s[-1][0], (s[0][0], len(s[0][1]), s[0][1])))
            a, b = states.pop(), states.pop()
            states.append(fall([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]))
        want = {rows[i].doc_id: j for j, s in enumerate(states[0]) for i, _ in s[1]}
        assert {d.doc_id: got[d.doc_id] for d in rows} == want
        loads = [s[0] for s in states[0]]
        assert max(loads) - min(loads) <= max(d.n_chars for d in rows)


def test_ocr_lines(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        y, x = int(r.l_quantity * 4), r.l_linenumber * 10
        lines[r.l_orderkey].append(((y, x, y + 8, x + 5), r.l_returnflag))
    got = {r.k: r.page for r in QUERIES["ocr_lines"](spark, SF).collect()}
    assert set(got) == set(lines)
    for k, items in lines.items():
        rows = []
        for (y1, x1, y2, x2), t in sorted(items):
            for row in rows:
                top, bottom = min(i[1] for i in row), max(i[3] for i in row)
                if abs((y1 + y2) / 2 - (top + bottom) / 2) <= max(y2 - y1, bottom - top) * 0.6:
                    row.append((x1, y1, x2, y2, t))
                    break
            else:
                rows.append([(x1, y1, x2, y2, t)])
        rows.sort(key=lambda row: min(i[1] for i in row))
        want = [Counter(i[4] for i in row) for row in rows]
        assert [Counter(line.replace(" ", "")) for line in got[k].split("\n")] == want, k


def test_bootstrap(spark):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect():
        groups[r.event_type, r.user_id].append(r.value)
    rows = QUERIES["val_bootstrap"](spark, SF).collect()
    assert {(r.source, r.uid) for r in rows} == {k for k, v in groups.items() if len(v) > 1}
    for r in rows[::7]:
        x = np.array(groups[r.source, r.uid])
        got = x[np.random.RandomState(42).choice(len(x), size=(1000, r.k), replace=True)]
        assert math.isclose(r.best_mean, got.max(axis=1).mean(), rel_tol=1e-6, abs_tol=1e-6) and math.isclose(r.worst_mean, got.min(axis=1).mean(), rel_tol=1e-6, abs_tol=1e-6)


def test_search_rounds(spark):
    rows = {r.trajectory_id: r for r in QUERIES["search_rounds"](spark, SF).collect()}
    children = defaultdict(list)
    for r in rows.values():
        if r.parent_id is not None:
            children[r.parent_id].append(r)
            assert r["round"] == rows[r.parent_id]["round"] + 1 and r.budget == max(rows[r.parent_id].budget - 1, 0) and math.isclose(r.score, rows[r.parent_id].score * 0.9)
    for r in rows.values():
        assert (r.status == "expanded") == bool(children[r.trajectory_id]) and r.status != "running"
    per = Counter(r["round"] for r in rows.values())
    assert per[0] == spark.read.parquet(f"{SF}/customer.parquet").count() and all(n <= 500 for k, n in per.items() if k)
