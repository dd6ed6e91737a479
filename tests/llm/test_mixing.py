import random

import numpy as np
import pytest
from oracle import connect, same

from tessera.llm import mixing as M

PLANS = "plan_id int, source string, target_weight double, max_repeats int"


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_is_exact(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(2, 60), 6)))
    counts = np.array([rng.randrange(0, 5) for _ in lengths])
    reachable = {0}
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reachable |= {x + int(n) for x in reachable}
    for budget in (0, 1, 17, 83, 200, 5000):
        take = M.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == max(x for x in reachable if x <= budget)


@pytest.mark.parametrize("budget", [0, 10, 5_000, 123_457, 700_001, 10**9])
def test_choose_meets_the_budget(budget):
    lengths, counts = np.array([3, 50, 777, 2048]), np.array([500, 900, 300, 200])
    take = M.choose(lengths, counts, budget, "s")
    assert (take <= counts).all() and (take >= 0).all()
    assert abs(int((take * lengths).sum()) - min(budget, int((lengths * counts).sum()))) <= 2


def run(spark, docs, plans):
    d = spark.createDataFrame([(i, s, n, 1, "x") for i, s, n in docs], "doc_id long, source string, tokens long, uses int, name string")
    return M.mix(d, spark.createDataFrame(plans, PLANS)).collect()


def test_shares_and_repeats(spark):
    rng = random.Random(1)
    docs = [(i, "big", rng.randrange(5, 900)) for i in range(600)] + [(1000 + i, " Small-one", rng.randrange(5, 300)) for i in range(20)] + [(2000, None, 5), (2001, "other", 5), (None, "big", 5), (2002, "big", None)]
    rows = run(spark, docs, [(1, "big", 3.0, 2), (1, "small_one", 1.0, 4), (2, "big", 1.0, 1), (2, "missing", 1.0, 3), (3, "BIG", 0.0, 1), (3, "small-one", 5.0, 1)])
    for plan in (1, 2, 3):
        own = [r for r in rows if r["plan_id"] == plan]
        total = sum(r["uses"] * (r["tokens"] or 0) for r in own)
        for name in {r["source"] for r in own}:
            mine = [r for r in own if r["source"] == name]
            assert sum(r["uses"] * (r["tokens"] or 0) for r in mine) / total == pytest.approx(mine[0]["actual_share"])
    one = {r["source"]: r for r in rows if r["plan_id"] == 1}
    assert one["big"]["actual_share"] == pytest.approx(0.75, abs=1e-3) and one["small_one"]["target_share"] == 0.25
    assert max(r["uses"] for r in rows if r["plan_id"] == 1 and r["source"] == "small_one") <= 4
    missing = [r for r in rows if r["source"] == "missing"]
    assert len(missing) == 1 and missing[0]["doc"] is None and missing[0]["actual_share"] == 0.0 and missing[0]["target_share"] == 0.5
    assert all(r["uses"] == 0 for r in rows if r["plan_id"] == 3 and r["source"] == "big")
    assert sum(r["uses"] for r in rows if r["plan_id"] == 2 and r["source"] == "big") == 600
    assert not any(r["doc"] in (2000, 2001, 2002) for r in rows)


def test_edges(spark):
    assert run(spark, [], [(1, "a", 1.0, 1)])[0]["uses"] == 0
    assert run(spark, [(1, "a", 5)], []) == []
    rows = run(spark, [(1, "a", 5), (1, "a", 5), (2, "a", 5)], [(1, "a", None, 1), (1, "b", float("nan"), None), (2, "a", -1.0, None), (3, "a", 2.0, 0), (4, "a", 1.0, 1), (4, "a", 1.0, 3)])
    assert all(r["uses"] == 0 for r in rows if r["plan_id"] in (1, 2, 3))
    assert [r["uses"] for r in rows if r["plan_id"] == 4] == [3, 3, 3]


def test_crowded_lengths_are_ranked_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    docs = [(i, "hot", 7) for i in range(900)] + [(5000 + i, "rare", 7) for i in range(30)]
    rows = run(spark, docs, [(1, "hot", 3.0, 1), (1, "rare", 1.0, 1)])
    used = [r["doc"] for r in rows if r["uses"]]
    assert len(used) == len(set(used)) == 120 and sum(d >= 5000 for d in used) == 30


def test_query_equals_its_sql(spark, small):
    same(M.p7_checked(spark, small), connect(small), M.SQL["p7_checked"])


def test_p7_on_the_tables(spark, small):
    rows = M.p7_shares(spark, small).collect()
    assert {r["plan_id"] for r in rows} == {1, 2, 3, 4}
    repeats = {(r["plan_id"], r["source"]): r["max_repeats"] for r in spark.read.parquet(f"{small}/mix_plans.parquet").collect()}
    assert all(r["most_uses"] <= repeats[r["plan_id"], r["source"]] for r in rows)
