import json
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing as S
from tessera.operators import agents as G, metrics as Q, rewards as R


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<struct<role:string,content:string>>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def cut(text, weights, regex=False):
    """The same in Python, delimiter by delimiter."""
    pattern = "|".join(k if regex else re.escape(k) for k in sorted(weights, key=len, reverse=True))
    out, at, follow = [], 0, 1.0
    for m in re.finditer(pattern, text, re.S):
        out.append((text[at : m.start()], follow))
        w = next(v for k, v in weights.items() if (re.fullmatch(k, m[0], re.S) if regex else k == m[0]))
        out.append((m[0], w[0]))
        at, follow = m.end(), 1.0 if regex else w[-1]
    return [(c, w) for c, w in [*out, (text[at:], follow)] if c]


TEXTS = ["", "plain", "Action: a\nAction Input: {}\nObservation: none", "x Thought: y Final Answer: z", "Thought:", "Action:Action:Action Input:", "<tool_call>a</tool_call> and\n<tool_call>\n{}\n</tool_call>", "<think>\n\n</think>\n\nIt is so.", "中文Thought:。" * 3, "line\n" * 30_000 + "Thought: end"]


@pytest.mark.parametrize("mode", ["react", "hermes", "qwen", "agentflan", "alpha_umi", "ignore_empty_think"])
def test_weighted_sections(spark, mode):
    scale = G.LOSS_SCALES[mode]
    weights, regex = scale.delimiters or scale.patterns, scale.delimiters is None
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", G.weighted_sections(F.col("t"), weights, regex).alias("s")).collect()
    for r in rows:
        assert (None if r["s"] is None else [tuple(x) for x in r["s"]]) == (None if r["t"] is None else cut(r["t"], weights, regex))


def test_single_weights_keep_delimiter_and_content_together(spark):
    assert [tuple(x) for x in one(spark, G.weighted_sections(F.col("t"), {"A:": 2.0, "B:": (3.0, 0.5)}), t="xA:yB:z")] == [("x", 1.0), ("A:y", 2.0), ("B:", 3.0), ("z", 0.5)]


def test_sections(spark):
    assert [tuple(x) for x in one(spark, S.sections(["a+", "a"])(F.col("t")), t="xa+yaz")] == [("", "x"), ("a+", "y"), ("a", "z")]
    assert [tuple(x) for x in one(spark, S.sections([r"\d+"], regex=True)(F.col("t")), t="12a3")] == [("12", "a"), ("3", "")]
    assert one(spark, S.sections(["a"])(F.col("t")), t="") == []


def test_loss_sections(spark):
    chat = [("system", "s"), ("user", "What is the value of x?"), ("assistant", "Thought: a"), None, ("user", "u"), ("assistant", None), ("assistant", "<think> </think>b")]
    of = lambda mode: [tuple(x) for x in one(spark, G.loss_sections(F.col("m"), mode), m=chat)]
    assert of("default") == [("s", 0.0), ("What is the value of x?", 0.0), ("Thought: a", 1.0), ("u", 0.0), ("<think> </think>b", 1.0)]
    assert of("last_round")[2][1] == 0.0 and of("last_round")[-1][1] == 1.0 and {w for _, w in of("all")} == {1.0}
    assert of("agentflan")[2] == ("Thought: a", 3.0) and of("react")[2:4] == [("Thought:", 1.0), (" a", 1.0)]
    assert of("last_round_with_ignore_empty_think")[-2:] == [("<think> </think>", 0.0), ("b", 1.0)]
    assert set(G.LOSS_SCALES) == {"default", "last_round", "all", "ignore_empty_think", "last_round_with_ignore_empty_think", "react", "hermes", "qwen", "agentflan", "alpha_umi"}
    with pytest.raises(ValueError, match="registered"):
        G.register_loss_scale(G.LossScale("react"))


def test_formats_have_their_public_names():
    assert set(G.FORMATS) == {"react_en", "react_zh", "qwen_en", "qwen_zh", "qwen_en_parallel", "qwen_zh_parallel", "hermes", "toolbench", "glm4", "glm4_0414", "llama3", "llama4", "react_grpo"}
    tools = json.dumps([{"name": "look", "description": "Looks.", "parameters": {"type": "object"}}])
    old, new = G.tool_prompt(tools, "glm4"), G.tool_prompt(tools, "glm4_0414")
    assert old.startswith("你是一个名为 GLM-4 的人工智能助手") and old.endswith(new) and new.startswith("# 可用工具\n\n## look\n\n{\n    \"name\"")
    assert G.call_text(['{"name": "look", "arguments": {"a": 1}}'] * 2, "glm4") == 'look\n{"a": 1}<|assistant|>look\n{"a": 1}<|observation|>'


@pytest.mark.parametrize(
    "said, wanted, equal",
    [
        (r"\boxed{\frac{1}{2}}", "0.5", 1), (r"\boxed{\frac12}", r"\frac{2}{4}", 1), (r"2^{10}", "1024", 1), (r"\sqrt{16}", "4", 1), (r"50\%", r"\frac{1}{2}", 1), (r"\{1, 2, 3\}", r"\{3,1,2\}", 1), (r"\{1,2\}", r"\{1,3\}", 0),
        (r"[0, \frac{1}{2})", "[0,0.5)", 1), ("[0,1)", "[0,1]", 0), ("(1, 2)", "(2, 1)", 0), ("x = 3", "3", 1), ("1,234", "1234", 1), (r"\text{yes}", "yes", 0), ("Yes", "yes", 1), ("x+1", "x + 1", 1), (r"2\pi", "6.283185307179586", 1), ("3", "x", 0),
        ("# Answer 7", "7", 1), ("9**9**9**9", "1", 0), ("", "", 1), (r"\boxed{\{1,\frac{2}{2}\}}", r"\{1\}", 0),
    ],
)
def test_math_reward(spark, said, wanted, equal):
    assert one(spark, R.math_answer(F.col("a"), F.col("b")), a=said, b=wanted) == equal


def test_toolbench_reward(spark):
    act = lambda name, given: f"Thought: x\nAction: {name}\nAction Input: {given}"
    f1 = lambda a, b: one(spark, R.action_f1(F.col("a"), F.col("b")), a=a, b=b)
    whole = act("look", '{"a": 1, "b": "x"}')
    assert f1(whole, whole) == 1.0 and one(spark, R.REWARDS["toolbench"](F.col("a"), F.col("b")), a=whole, b=whole) == 1.0
    assert f1(act("look", '{"a": 2, "b": "x"}'), whole) == 0.75 and f1(act("look", '{"a": 1}'), whole) == pytest.approx(2 / 3)
    assert f1(act("go", '{"a": 1, "b": "x"}'), whole) == 0.0 and f1(act("look", "{}"), act("look", "{}")) == 1.0 and f1(act("look", "{}"), whole) == 0.0 and f1(act("look", "nothing"), whole) == 0.0


def test_registries_of_scores(spark):
    assert R.PROCESS_REWARDS.keys() == {"least", "stated"} and R.REWARD_MODELS.keys() == {"scores", "generative"}
    assert one(spark, R.PROCESS_REWARDS["stated"](F.col("t")), t="It is fine. **Reward: 0.5**") == 0.5
    asked = one(spark, R.judge_request(F.col("q"), F.col("t"), F.col("r")), q="What?", t=None, r="That.")
    assert [m["role"] for m in asked] == ["system", "user"] and "What?" in asked[1]["content"] and "#" not in asked[1]["content"]


def test_first_value(spark):
    for text, want in (('[[], {"a": ""}, {"b": ["x", "y"]}]', "x"), ("[0, false, 7]", "7"), ('{"key": "say \\"hi\\""}', 'say "hi"'), ("[]", None), (None, None), ('{"a": null, "b": true}', "true")):
        assert one(spark, S.first_value(F.col("t")), t=text) == want


def test_words_and_common_length():
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert Q.common_length(a, b) == slow(a, b)
    assert Q.words_of("the 磨坊 mill, かな") == ["the", "磨", "坊", "mill,", "か", "な"]
