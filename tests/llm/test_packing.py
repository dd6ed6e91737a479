import random

import numpy as np
import pytest
from oracle import connect, same

from tessera.llm import packing as P


def check(rows, items, capacity):
    fill, tokens = {}, {}
    for r in rows:
        fill.setdefault(r["row_id"], []).append(r)
        tokens[r["doc"]] = tokens.get(r["doc"], 0) + r["tokens"]
        assert 1 <= r["tokens"] <= capacity
    for own in fill.values():
        total = sum(r["tokens"] for r in own)
        assert total <= capacity and {r["row_tokens"] for r in own} == {total}
    want = {}
    for d, n in items:
        if d is not None and n and n > 0:
            want[d] = want.get(d, 0) + n
    assert tokens == want
    pieces = {}
    for r in rows:
        pieces[r["doc"]] = pieces.get(r["doc"], 0) + 1
    return fill


@pytest.mark.parametrize("partition_items, seed", [(50_000, 1), (40, 2), (7, 3)])
def test_invariants(spark, partition_items, seed):
    rng = random.Random(seed)
    items = [(i, rng.choice([rng.randrange(1, 100), rng.randrange(1, 20), 100, 51, 250, 200])) for i in range(400)]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in items], "doc_id long, tokens int, bin string, fill int")
    plans = spark.createDataFrame([(1, 100), (2, 100), (3, 7), (None, 5), (4, None), (5, 0)], "plan_id int, capacity_tokens int")
    rows = P.pack(df, plans, "doc_id", "tokens", partition_items=partition_items).collect()
    for plan, capacity in ((1, 100), (2, 100), (3, 7)):
        own = [r for r in rows if r["plan_id"] == plan]
        fill = check(own, items, capacity)
        bound = -(-sum(n for _, n in items) // capacity)
        assert len(fill) <= bound * (1.1 if partition_items > 10 else 1.25) + 3
        if capacity >= 100:  # only what exceeds the capacity is split
            assert all(sum(r["doc"] == d for r in own) == 1 for d, n in items if n <= capacity)
    assert {r["plan_id"] for r in rows} == {1, 2, 3}


def test_edges(spark):
    plans = spark.createDataFrame([(1, 10)], "plan_id int, capacity_tokens int")
    items = [(1, None), (None, 5), (2, 0), (3, -4), (4, 10), (5, 10_000), (6, 3), (6, 3)]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    fill = check(P.pack(df, plans, "doc_id", "tokens").collect(), items, 10)
    assert len(fill) == 1002
    assert P.pack(df.limit(0), plans, "doc_id", "tokens").count() == 0
    assert P.pack(df, plans.limit(0), "doc_id", "tokens").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bound_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, 12)
    capacity = 50

    def optimum(rest, rooms):
        if not rest:
            return len(rooms)
        best, first, tried = 99, rest[0], set()
        for k, room in enumerate(rooms):
            if first <= room and room not in tried:
                tried.add(room)
                best = min(best, optimum(rest[1:], rooms[:k] + (room - first,) + rooms[k + 1 :]))
        return min(best, optimum(rest[1:], rooms + (capacity - first,))) if len(rooms) < 8 else best

    exact = optimum(tuple(sorted(sizes.tolist(), reverse=True)), ())
    bins = P.best_fit_decreasing(sizes, capacity)
    assert P.lower_bound(sizes, capacity) <= exact <= bins.max() + 1 <= exact + 1
    assert max(sizes[bins == b].sum() for b in set(bins.tolist())) <= capacity


def test_bound_sees_large_items():
    assert P.lower_bound(np.array([51, 51, 51, 51]), 100) == 4
    assert P.lower_bound(np.array([], dtype=int), 100) == 0


def test_bounds_of_plans(spark):
    df = spark.createDataFrame([(i, 51) for i in range(40)] + [(100, 250), (101, 10)], "doc_id long, tokens int")
    plans = spark.createDataFrame([(1, 100), (2, 51)], "plan_id int, capacity_tokens int")
    got = {r["plan_id"]: r["least_rows"] for r in P.bounds(df, plans, "doc_id", "tokens").collect()}
    assert got == {1: 43, 2: -(-(40 * 51 + 250 + 10) // 51)}
    assert P.bounds(df, plans.limit(0), "doc_id", "tokens").count() == 0


def test_exchange_saves_bins(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([34, 35, 52, 26, 61, 13])) for i in range(600)]
    df = spark.createDataFrame(items, "doc_id long, tokens int")
    plans = spark.createDataFrame([(1, 100)], "plan_id int, capacity_tokens int")
    used = {n: P.pack(df, plans, "doc_id", "tokens", partition_items=n).select("row_id").distinct().count() for n in (20, 1000)}
    alone = sum(int(P.best_fit_decreasing(np.array([n for i, n in items[a : a + 20]]), 100).max()) + 1 for a in range(0, 600, 20))
    assert used[1000] <= used[20] < alone


def test_too_many_plans(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_PLANS", 2)
    df = spark.createDataFrame([(1, 5)], "doc_id long, tokens int")
    with pytest.raises(ValueError, match="plans"):
        P.pack(df, spark.range(3).selectExpr("cast(id as int) as plan_id", "10 as capacity_tokens"), "doc_id", "tokens")


def test_query_equals_its_sql(spark, small):
    same(P.p6_checked(spark, small), connect(small), P.SQL["p6_checked"])


def test_sizes_of_documents(spark):
    df = spark.createDataFrame([(1, "s", "añ", None), (2, "s", None, 5), (3, "s", "  　", 5), (4, "s", "abc", 9), (5, "s", "", None)], "doc_id long, source string, text string, n_tokens int")
    assert {r["doc_id"]: r["tokens"] for r in P.sized_documents(df).collect()} == {1: 4, 4: 9}


def test_p6_on_the_tables(spark, small):
    rows = P.p6_packed(spark, small).collect()
    items = [(r["doc_id"], r["tokens"]) for r in P.sized_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()]
    for plan in {r["plan_id"] for r in rows}:
        own = [{**r.asDict(), "doc": r["doc_id"]} for r in rows if r["plan_id"] == plan]
        check(own, items, own[0]["capacity"])
