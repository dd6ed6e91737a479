"""Operators against brute force, boundary rows, empty tables and NULLs."""

import random

import pytest
from pyspark.sql import Row, functions as F

from tessera.functions import arrays as A, parsing as X
from tessera.operators import adaptive, agents, dedup, joins, messages as M, metrics, packing, plugins, reports, rewards, sampling as S, series, tokens


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


# ---- duplicates -------------------------------------------------------------------------------------------------
def test_near_duplicates_chain_and_short_texts(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (1, base.replace("word199", "wordx")), (7, base.upper()), (9, "hello you"), (8, "hello me"), (3, "other"), (2, ""), (4, None), (6, "completely different text about nothing at all")]
    got = {r["id"]: r["cluster"] for r in dedup.near_duplicate_clusters(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()}
    assert got[5] == got[7] == 1 and got[1] == 1
    assert got[2] == got[4] == 2  # NULL counts as ''
    assert got[3] == 3 and got[6] == 6
    # shuffled input gives the same clusters
    random.Random(1).shuffle(rows)
    again = {r["id"]: r["cluster"] for r in dedup.near_duplicate_clusters(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()}
    assert again == got


def test_links_connect_what_pairs_connect(spark):
    """Texts that drift step by step: neighbours are alike, the ends are not."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        if i % 10 == 0:
            rng.shuffle(words)
        for _ in range(2):
            words[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    near = dedup.NearDuplicates(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    components = lambda d: {(r["id"], r["component"]) for r in dedup.connected_components(d, "lo", "hi").collect()}
    assert components(near.links()) == components(near.pairs()) and near.pairs().count() >= near.links().count() > 0


def test_links_are_few_in_a_large_bucket(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:199], f"n{rng.randrange(10**6)}"])) for i in range(150)]
    near = dedup.NearDuplicates(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    pairs, links = near.pairs().count(), near.links()  # between distinct signatures
    assert pairs > 2000 and links.count() < pairs / 10
    assert {r["component"] for r in dedup.connected_components(links, "lo", "hi").collect()} == {0}


def test_recall_of_bands_at_the_threshold():
    """Of pairs just at the threshold at least nine in ten share a bucket."""
    s = dedup.THRESHOLD
    assert 1 - (1 - s**dedup.ROWS) ** dedup.BANDS > 0.9 and dedup.BANDS * dedup.ROWS <= dedup.PERMUTATIONS


def test_near_duplicates_of_an_empty_table(spark):
    assert dedup.near_duplicate_clusters(spark.createDataFrame([], "id long, t string"), "id", F.col("t")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, x) for x in range(201, 230)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {v: find(v) for e in edges for v in e if e[0] != e[1]}
    got = {r["id"]: r["component"] for r in dedup.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id long, t string")
    assert sorted(r["id"] for r in dedup.keep_first(df, F.col("t"), "id").collect()) == [1, 2, 4]


# ---- messages ---------------------------------------------------------------------------------------------------
def chat(spark, *messages):
    return spark.createDataFrame([([Row(role=r, content=c) for r, c in messages],)], f"m {M.MESSAGE.replace('struct', 'array<struct', 1)}>")


def test_history_round_trip(spark):
    df = chat(spark, ("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"))
    h = df.select(M.messages_to_history(F.col("m")).alias("h")).first()["h"]
    assert (h["system"], h["history"], h["query"], h["response"]) == ("s", [["a", "b"]], "c", None)
    back = df.select(M.history_to_messages(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit(None).cast("string"))), F.lit("s")).alias("x")).first()["x"]
    assert [(m["role"], m["content"]) for m in back] == [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")]


def test_irregular_roles_give_null(spark):
    assert chat(spark, ("assistant", "a"), ("user", "b")).select(M.messages_to_history(F.col("m"))).first()[0] is None


def test_reasoning_is_stripped_from_earlier_turns_only(spark):
    df = chat(spark, ("user", "a"), ("assistant", "<think>x</think> y"), ("user", "b"), ("assistant", "<think>z</think> w"))
    got = [m["content"] for m in df.select(M.without_reasoning(F.col("m"))).first()[0]]
    assert got == ["a", "y", "b", "<think>z</think> w"]


def test_templates(spark):
    df = chat(spark, ("user", "hi"), ("assistant", "yo"))
    assert df.select(M.rendered(F.col("m"), M.get_template("chatml"))).first()[0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>"
    assert df.select(M.rendered(F.col("m"), M.get_template("ziya"), "<b>", "<e>")).first()[0] == "<b><human>:hi\n<bot>:yo<e>"
    with pytest.raises(ValueError):
        M.register_template(M.get_template("chatml"))


def test_content_parts(spark):
    df = spark.createDataFrame([([Row(type="text", text="see ", url=None), Row(type="image_url", text=None, url="u.png")],)], "p array<struct<type:string,text:string,url:string>>")
    assert df.select(M.text_of_parts(F.col("p")), M.media_of(F.col("p"), "image")).first()[:] == ("see <image>", ["u.png"])
    assert one(spark, M.as_list(F.lit("u"))) == ["u"]
    aliased = chat(spark, ("tool_response", "{}")).select(M.aliased_roles(F.col("m"))).first()[0]
    assert aliased[0]["role"] == "tool"


def test_class_prompts(spark):
    assert one(spark, M.label_text(F.lit(1), ["no", "yes"])) == "yes"
    assert one(spark, M.label_text(F.lit(5), ["no", "yes"])) is None
    assert "Sentence2: b" in one(spark, M.class_prompt(F.lit("a"), ["x"], "t", F.lit("b")))


# ---- arrays and parsing -----------------------------------------------------------------------------------------
def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (1, 1, 1, 2)])
    assert one(spark, A.positions_of(a, [1, 1])) == [0, 1]
    assert one(spark, A.positions_of(a, [9] * 9)) == []
    assert one(spark, A.rolled(a, F.lit(-100))) == [1, 1, 2, -100]
    assert one(spark, A.padded(a, 6, F.lit(0), left=True)) == [0, 0, 1, 1, 1, 2]
    assert one(spark, A.attention_mask(a, 3)) == [1, 1, 1]
    assert one(spark, A.min_max(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, A.min_max(F.array(F.lit(2.0), F.lit(2.0)))) == [1.0, 1.0]
    assert one(spark, A.min_max(F.array(F.lit(0.5), F.lit(0.5)))) == [0.5, 0.5]
    assert sum(one(spark, A.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))) == pytest.approx(1)
    assert [one(spark, A.ntile_of(F.lit(i), F.lit(7), 3)) for i in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    assert one(spark, A.linspace(F.lit(0.0), F.lit(1.0), 3)) == [0.0, 0.5, 1.0]
    # binary-search bounds
    assert (one(spark, A.lower_bound(a, F.lit(1))), one(spark, A.upper_bound(a, F.lit(1))), one(spark, A.upper_bound(a, F.lit(5)))) == (0, 3, 4)


def test_parsing(spark):
    assert one(spark, X.boxed(F.lit(r"so \boxed{3} ok"))) == "3"
    assert one(spark, X.boxed(F.lit("no box"))) == "no box"
    assert one(spark, X.boxed(F.lit(r"\boxed{\frac{1}{2}}"))) == r"\frac{1"
    assert one(spark, X.same_answer(F.lit(r"\boxed{1,000}"), F.lit("# Answer 1000.0"))) is True
    assert one(spark, X.reward_value(F.lit("blah Reward: [0.75]"))) == 0.75
    got = one(spark, X.action_of(F.lit("Thought: x\nAction: a\nAction Input: {}\nAction: b\nAction Input: {\"k\": 1}")))
    assert (got["action"], got["input"]) == ("b", '{"k": 1}')
    assert one(spark, X.action_of(F.lit("nothing")))[:] == ("none", "{}")
    assert one(spark, X.think_answer_format(F.lit("<think>a\nb</think> <answer>c</answer>"))) == 1.0
    assert one(spark, X.think_answer_format(F.lit("<think>a</think><answer>c</answer> tail"))) == 0.0
    calls = one(spark, X.parsed_tool_calls(F.lit('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>')))
    assert [(c["name"], c["arguments"]) for c in calls] == [("f", '{"x": 1}')]
    assert one(spark, X.lenient_json(F.lit("{'a': None}"))) == '{"a": null}'
    assert one(spark, X.lenient_json(F.lit("{oops"))) is None
    assert one(spark, X.sanitised_json(F.lit('{"hub_token": "s", "x": [{"a_token": 1}]}'))) == '{"hub_token": null, "x": [{"a_token": null}]}'
    text = "lead aa one bb two aa"
    parts = one(spark, X.sections(["aa", "bb"])(F.lit(text)))
    assert "".join(p["key"] + p["content"] for p in parts) == text and [p["key"] for p in parts] == ["", "aa", "bb", "aa"]


def test_rewards(spark):
    assert one(spark, rewards.repetition(F.lit("a b c a b c"))) == pytest.approx(-(1 - 3 / 4))
    assert one(spark, rewards.repetition(F.lit("a b"))) == 0.0
    assert one(spark, rewards.soft_overlong(F.lit(1500), 2048, 512)) == 0.0
    assert one(spark, rewards.soft_overlong(F.lit(2048), 2048, 512)) == -1.0
    assert one(spark, rewards.cosine(F.lit(0), F.lit(True))) == pytest.approx(1.0)
    assert one(spark, rewards.cosine(F.lit(1000), F.lit(True))) == pytest.approx(0.5)
    assert one(spark, rewards.cosine(F.lit(0), F.lit(False))) == pytest.approx(-0.5)
    good = 'Action: f\nAction Input: {"a": "1"}'
    assert one(spark, rewards.toolbench(F.lit(good), F.lit(good))) == 1.0
    assert one(spark, rewards.toolbench(F.lit(good), F.lit('Action: f\nAction Input: {"a": "2"}'))) == 0.0
    assert one(spark, rewards.mean_extracted(F.array(F.lit("Reward: 1"), F.lit("none"), F.lit("Reward: 0")))) == 0.5
    with pytest.raises(ValueError):
        rewards.register_reward("format")(None)


# ---- series, joins, reports -------------------------------------------------------------------------------------
def test_series_against_loops(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.random() * 10) for k in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    got = {(r["k"], r["i"]): r["smoothed"] for r in series.smoothed(df, "k", "i", "v").collect()}
    for key in "ab":
        x = norm = 0.0
        for k, i, v in rows:
            if k == key:
                x, norm = x * 0.9 + v, norm * 0.9 + 1
                assert got[k, i] == pytest.approx(x / norm)
    top = {(r["k"], r["i"]): r["running"] for r in series.running(df, "k", "i", "v", "max").collect()}
    for key in "ab":
        best = -1
        for k, i, v in rows:
            if k == key:
                best = max(best, v)
                assert top[k, i] == best
    total = {r["i"]: r["total"] for r in tokens.running_total(df.where("k = 'a'").select("i", "v"), "i", "v").collect()}
    assert total[499] == pytest.approx(sum(v for k, _, v in rows if k == "a"))


def test_as_of_and_intervals_against_loops(spark):
    rng = random.Random(4)
    left = [(i, rng.randrange(4), rng.random() * 100) for i in range(200)]
    right = [(rng.randrange(4), rng.random() * 100, f"v{i}") for i in range(60)]
    df = joins.as_of(spark.createDataFrame(left, "id int, k int, t double"), spark.createDataFrame(right, "k int, t double, v string"), "k", "t", ["v"], 7.0)
    got = {r["id"]: r["v"] for r in df.collect()}
    for i, k, t in left:
        before = [(x, v) for y, x, v in right if y == k and x <= t]
        assert got[i] == (max(before)[1] if before else None)
    spans = [(f"s{i}", a := rng.random() * 90, a + rng.random() * 30) for i in range(30)]
    found = {(r["id"], r["s"]) for r in joins.within(spark.createDataFrame(left, "id int, k int, t double"), spark.createDataFrame(spans, "s string, lo double, hi double"), "t", "lo", "hi", 9.0).collect()}
    assert found == {(i, s) for i, _, t in left for s, lo, hi in spans if lo <= t < hi}


def test_reports(spark):
    line = "SKIPPED [1] tests/a.py:3: because"
    assert one(spark, reports.normalised_log_line(F.lit(line))) == "SKIPPED tests/a.py:3"
    assert one(spark, reports.normalised_log_line(F.lit("FAILED x::y - boom"))) == "FAILED x::y"
    assert one(spark, reports.duration_seconds(F.lit("1:02:03"))) == 3723.0
    assert one(spark, reports.duration_text(F.lit(3723))) == "1h2m3s"
    nodes = spark.createDataFrame([(1, 0, None, 1.0, 0.5), (1, 1, 0, 0.0, 0.7), (1, 2, 0, 3.0, 0.9), (1, 3, 2, 2.0, 0.1)], "t int, n int, p int, o double, q double")
    paths = {r["node"]: (r["depth"], r["mean_outcome"], r["min_process"]) for r in reports.tree_paths(nodes, "t", "n", "p", "o", "q").collect()}
    assert paths[3] == (3, 2.0, 0.1)
    pair = reports.preference_pairs(nodes, "t", "n", "p", "o", 1.0).collect()
    assert [(r["good"], r["bad"]) for r in pair] == [(2, 1)]


def test_loops_run_to_their_end(spark):
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, 1.0, 0.5) for i in range(67)], "t int, n int, p int, o double, q double")
    paths = {r["node"]: r["depth"] for r in reports.tree_paths(deep, "t", "n", "p", "o", "q").collect()}
    assert paths == {i: i + 1 for i in range(67)}
    cycle = spark.createDataFrame([(1, 0, None, 1.0, 0.5), (1, 1, 0, 1.0, 0.5), (1, 1, 2, 1.0, 0.5), (1, 2, 1, 1.0, 0.5)], deep.schema)
    with pytest.raises(ValueError):
        reports.tree_paths(cycle, "t", "n", "p", "o", "q")
    with pytest.raises(RuntimeError):
        dedup.connected_components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"), "a", "b", max_rounds=1)


def test_metrics(spark):
    assert metrics.rouge_l("a b c d".split(), "a c d x".split()) == pytest.approx(0.75)
    assert metrics.rouge_n("a b".split(), "a b".split(), 2) == 1.0
    assert metrics.bleu_4("abcdef", "abcdef") == pytest.approx(1.0)
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (None, 1)], "p int, y int")
    assert metrics.evaluate(df, "accuracy", F.col("p"), F.col("y")).first()[0] == 0.5
    assert metrics.evaluate(spark.createDataFrame([], "p int, y int"), "mcc", F.col("p"), F.col("y")).first()[0] == 0.0


# ---- acceptance -------------------------------------------------------------------------------------------------
def test_chain_labels(spark):
    rows = [("a", s, x) for s, x in enumerate((1, 1, 1))] + [("b", s, x) for s, x in enumerate((0, 1, 1))] + [("c", s, x) for s, x in enumerate((1, 0, 1))]
    got = {(r["r"], r["step"]): r["label"] for r in adaptive.chain_labels(spark.createDataFrame(rows, "r string, step int, accept int"), "r").collect()}
    assert [got["a", s] for s in range(3)] == [1, 1, 1] and [got["b", s] for s in range(3)] == [0, -100, -100] and [got["c", s] for s in range(3)] == [1, 0, -100]


def test_accept_length_is_a_ratio_of_sums(spark):
    df = spark.createDataFrame([("x", 10, 5), ("x", 30, 5), ("y", 7, None)], "task string, completion_tokens long, spec_verify_ct long")
    got = {r["task"]: r["accept_length"] for r in adaptive.request_totals(df, "task").collect()}
    assert got == {"x": 4.0, "y": 1.0}


# ---- sampling and packing ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 3, 10, 23])
def test_sampling_sizes(spark, n):
    df = spark.range(10)
    rows = S.sample_exact(df, n, "id", seed=1).collect()
    assert len(rows) == n
    counts = [sum(r["id"] == i for r in rows) for i in range(10)]
    assert max(counts) - min(counts) <= 1


def test_sampling_an_empty_table(spark):
    assert S.sample_exact(spark.range(0), 5, "id").count() == 0


def test_stratified_quotas_with_a_hot_stratum(spark):
    df = spark.range(20_000).withColumn("s", F.when(F.col("id") < 18_000, "hot").when(F.col("id") < 19_995, "mid").otherwise("tiny"))
    got = {r["s"]: r["count"] for r in S.stratified(df, "s", {"hot": 700, "mid": 100, "tiny": 50}, "id", 2).groupBy("s").count().collect()}
    assert got == {"hot": 700, "mid": 100, "tiny": 5}
    assert S.ratio_quotas({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}


def test_best_of_n_edges(spark):
    rows = [
        ("tie", ["x", "y"], [1.0, 1.0], None),
        ("masked", ["x", "y"], [0.0, 0.0], None),
        ("none", None, None, None),
        ("holes", ["x", None, "z"], [0.2, 0.9, 0.4], [0.5, 0.5, None]),
    ]
    df = spark.createDataFrame(rows, "id string, c array<string>, o array<double>, p array<double>")
    got = {r["id"]: (r["chosen"], r["rejected"]) for r in S.best_of_n(df, "id", "c", "o", "p").collect()}
    assert got == {"tie": ("y", "x"), "holes": ("x", "x")}


def test_packing_invariants(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 1, 7, 60, 99, 100, 101])) for i in range(300)]
    packed = packing.pack_rows(spark.createDataFrame(rows, "id long, n long"), "id", "n", 100).collect()
    assert sorted(r["id"] for r in packed) == sorted(i for i, n in rows if n and n <= 100)
    fill = {}
    for r in packed:
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["length"]
    assert max(fill.values()) <= 100


def test_numbers_as_texts_round_as_python_does(spark):
    rng = random.Random(3)
    values = [k / 100 for k in range(-200, 200)] + [k / 8 for k in range(-40, 40)] + [rng.uniform(-9, 9) for _ in range(300)] + [-0.0, -0.04, 0.95, 9.95, 2.0**51 + 0.5, 1e18, 5e-324, 99.9999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 3):
        got = df.select("v", M.number_text(F.col("v"), digits).alias("t")).collect()
        assert [r["t"] for r in got] == [f"{r['v']:.{digits}f}" for r in got]
    assert one(spark, M.number_text(F.lit(None))) is None


# ---- plug-ins and agents ----------------------------------------------------------------------------------------
def test_preprocessors(spark):
    df = spark.createDataFrame([("q", "r"), ("x", None)], "query string, response string")
    assert [m["content"] for m in plugins.PREPROCESSORS["query_response"](df).first()["messages"]] == ["q", "r"]
    assert plugins.PREPROCESSORS["query_response"](df).count() == 1
    rows = plugins.by_row(lambda r: {"n": len(r["query"])} if r["response"] else None, "n long")(df).collect()
    assert [r["n"] for r in rows] == [1]
    batch = plugins.by_batch(lambda b: {"n": [len(b["query"])]}, "n long")(df.coalesce(1)).collect()
    assert sum(r["n"] for r in batch) == 2


def test_multi_turn(spark):
    df = spark.createDataFrame([(1, "wrong <answer>3", "stop", 0.0), (2, "fine", "stop", 1.0), (3, "cut", "length", 0.0)], "id int, response string, finish_reason string, accuracy double")
    out = {r["id"]: r["response"] for r in plugins.run_turns(df, "accuracy_tip", lambda d: d).collect()}
    assert out[2] == "fine" and out[3] == "cut" and out[1].startswith("wrong  But wait")


def test_agent_formats():
    tools = '[{"name": "f", "description": "does it", "parameters": {"type": "object"}}]'
    for name in agents.FORMATS:
        prompt = agents.tool_prompt(tools, name, "SYS", "USER")
        assert "f" in prompt and "does it" in prompt
    assert agents.tool_prompt("oops", "hermes") is None
    assert agents.call_text(['{"name": "f", "arguments": {"a": 1}}'], "react_en") == 'Action: f\nAction Input: {"a": 1}\nObservation:'
    assert agents.call_text(['{"name": "f", "arguments": {"a": 1}}'], "hermes") == '<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>'
    assert agents.response_text(["1", "2"], "glm4_0414") == "\n1<|observation|>\n2<|assistant|>\n"


def test_weighted_sections(spark):
    parts = one(spark, agents.weighted_sections(F.lit("pre Action: x End"), {"Action:": (2.0, 3.0)}))
    assert [(p["content"], p["weight"]) for p in parts] == [("pre ", 1.0), ("Action:", 2.0), (" x End", 3.0)]


# ---- small ones -------------------------------------------------------------------------------------------------
def test_times(spark):
    import datetime as dt

    from tessera.functions import times

    ts = F.lit(dt.datetime(2025, 1, 31, 23, 59, 58, 500_000))
    assert one(spark, times.file_stamp(ts)) == "20250131-235958" and one(spark, times.prompt_date(ts)) == "31 Jan 2025"
    assert [one(spark, times.short_duration(F.lit(s))) for s in (5, 65, 3600, 90_061)] == ["5s", "1m 5s", "1h 0m 0s", "1d 1h 1m 1s"]
    assert one(spark, times.remaining(F.lit(1), F.lit(4), F.lit(10)))[:] == ("25.0%", "10s", "30s")


def test_weighted_choice(spark):
    rows = spark.range(4000).select(S.weighted_choice([("en", 0.8), ("zh", 0.2)], "id", 3).alias("l")).groupBy("l").count().collect()
    counts = {r["l"]: r["count"] for r in rows}
    assert 3000 < counts["en"] < 3400 and counts["en"] + counts["zh"] == 4000


def test_checks(spark):
    assert one(spark, M.one_at_most(a=F.lit(1), b=F.lit(None))) is None
    with pytest.raises(Exception, match="only one of a, b"):
        one(spark, M.one_at_most(a=F.lit(1), b=F.lit(2)))
    df = spark.createDataFrame([([Row(label="x", score=0.5), Row(label="y", score=0.6)],)], "p array<struct<label:string,score:double>>")
    assert [p["label"] for p in df.select(M.confident(F.col("p"))).first()[0]] == ["y"]
    balance = metrics.evaluate(spark.createDataFrame([(True,), (False,), (False,)], "d boolean"), "preference_balance", F.col("d")).first()
    assert (balance["desirable"], balance["undesirable"], balance["low"]) == (1, 2, 2.0)
    assert plugins.by_row(lambda r: {"n": 1 // r["id"]}, "n long", strict=False)(spark.range(3)).count() == 2
