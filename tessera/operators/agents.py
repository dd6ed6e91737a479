"""Tool descriptions, calls and responses of agent conversations, in several public prompt formats.

A format is data: how one tool is described, and the frame around all descriptions. One Arrow function renders any of
them over a column of JSON tool lists.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from tessera.functions.parsing import _lenient, sections
from tessera.functions.text import let


@dataclass(frozen=True)
class ToolFormat:
    """``tool`` may hold {name}, {human}, {description}, {parameters}, {json}, {wrapped}, {indented}; ``frame`` {tools}, {names}, {list}, {system}, {user}."""

    name: str
    tool: str
    frame: str
    joint: str = "\n\n"
    call: str = "Action: {name}\nAction Input: {arguments}\n"
    call_joint: str = ""
    call_end: str = "Observation:"
    response: str = "{content}"
    response_joint: str = ""
    response_frame: str = "{responses}"


FORMATS: dict[str, ToolFormat] = {}


def register_format(f: ToolFormat) -> ToolFormat:
    if f.name in FORMATS:
        raise ValueError(f"format {f.name} is registered already")
    FORMATS[f.name] = f
    return f


# ---- Fixed values: texts of the prompt formats, which models were trained on word for word ---------------------
_REACT_TOOL_EN = "{name}: Call this tool to interact with the {human} API. What is the {human} API useful for? {description} Parameters: {parameters} Format the arguments as a JSON object."
_REACT_TOOL_ZH = "{name}: 调用此工具与 {human} API 进行交互。{human} 有什么用？{description} 输入参数：{parameters} 此工具的输入应为JSON对象。"
register_format(ToolFormat("react_en", _REACT_TOOL_EN, """Answer the following questions as best you can. You have access to the following tools:

{tools}

Use the following format:

Question: the input question you must answer
Thought: you should always think about what to do
Action: the action to take, should be one of [{names}]
Action Input: the input to the action
Observation: the result of the action
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Thought: I now know the final answer
Final Answer: the final answer to the original input question

Begin!
"""))
register_format(ToolFormat("react_zh", _REACT_TOOL_ZH, """尽可能地回答以下问题。你可以使用以下工具:

{tools}

请按照以下格式进行:

Question: 需要你回答的输入问题
Thought: 你应该总是思考该做什么
Action: 需要使用的工具，应该是[{names}]中的一个
Action Input: 传入工具的内容
Observation: 行动的结果
... (这个Thought/Action/Action Input/Observation可以重复N次)
Thought: 我现在知道最后的答案
Final Answer: 对原始输入问题的最终答案

现在开始！
"""))
_QWEN_CALL = dict(call="✿FUNCTION✿: {name}\n✿ARGS✿: {arguments}\n", call_end="✿RESULT✿:")
_QWEN_TOOL_EN = "### {human}\n\n{name}: {description} Parameters: {parameters} Format the arguments as a JSON object."
_QWEN_TOOL_ZH = "### {human}\n\n{name}: {description} 输入参数：{parameters} 此工具的输入应为JSON对象。"
register_format(ToolFormat("qwen_en", _QWEN_TOOL_EN, """{system}

# Tools

## You have access to the following tools:

{tools}

## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:

✿FUNCTION✿: The tool to use, should be one of [{names}]
✿ARGS✿: The input of the tool
✿RESULT✿: Tool results
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)""", **_QWEN_CALL))
register_format(ToolFormat("qwen_zh", _QWEN_TOOL_ZH, """{system}

# 工具

## 你拥有如下工具：

{tools}

## 你可以在回复中插入零次、一次或多次以下命令以调用工具：

✿FUNCTION✿: 工具名称，必须是[{names}]之一。
✿ARGS✿: 工具输入
✿RESULT✿: 工具结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来""", **_QWEN_CALL))
register_format(ToolFormat("qwen_en_parallel", _QWEN_TOOL_EN, """{system}

# Tools

## You have access to the following tools:

{tools}

## Insert the following command in your reply when you need to call N tools in parallel:

✿FUNCTION✿: The name of tool 1, should be one of [{names}]
✿ARGS✿: The input of tool 1
✿FUNCTION✿: The name of tool 2
✿ARGS✿: The input of tool 2
...
✿FUNCTION✿: The name of tool N
✿ARGS✿: The input of tool N
✿RESULT✿: The result of tool 1
✿RESULT✿: The result of tool 2
...
✿RESULT✿: he result of tool N
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)""", **_QWEN_CALL))
register_format(ToolFormat("qwen_zh_parallel", _QWEN_TOOL_ZH, """{system}

# 工具

## 你拥有如下工具：

{tools}

## 你可以在回复中插入以下命令以并行调用N个工具：

✿FUNCTION✿: 工具1的名称，必须是[{names}]之一
✿ARGS✿: 工具1的输入
✿FUNCTION✿: 工具2的名称
✿ARGS✿: 工具2的输入
...
✿FUNCTION✿: 工具N的名称
✿ARGS✿: 工具N的输入
✿RESULT✿: 工具1的结果
✿RESULT✿: 工具2的结果
...
✿RESULT✿: 工具N的结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来""", **_QWEN_CALL))
register_format(ToolFormat("hermes", "{wrapped}", """{system}

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{tools}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{{"name": <function-name>, "arguments": <args-json-object>}}
</tool_call>""", joint="\n", call="<tool_call>\n{json}\n</tool_call>", call_joint="\n", call_end="",
    response="<tool_response>\n{content}\n</tool_response>", response_joint="\n", response_frame="<|im_end|>\n<|im_start|>user\n{responses}<|im_end|>\n<|im_start|>assistant\n"))
register_format(ToolFormat("toolbench", "", """You can use many tools(functions) to do the following task.
First I will give you the task description, and your task start.
At each step, you need to give your thought to analyze the status now and what to do next, with a function call to actually execute your step. Your output should follow this format:
Thought:
Action:
Action Input:

After the call, you will get the call result, and you are now in a new state.
Then you will analyze your status now, then decide what to do next...
After many (Thought-call) pairs, you finally perform the task, then you can give your final answer.
Remember:
1.the state change is irreversible, you can't go back to one of the former state, if you want to restart the task, say "I give up and restart".
2.All the thought is short, at most in 5 sentence.
3.You can do more then one try, so if your plan is to continuously try some conditions, you can do one of the conditions per try.
Let's Begin!
Task description: You should use functions to help handle the real time user queries. Remember:
1.ALWAYS call "Finish" function at the end of the task. And the final answer should contain enough information to show to the user,If you can't handle the task, or you find that function calls always fail(the function is not valid now), use function Finish->give_up_and_restart.
2.Do not use origin tool names, use only subfunctions' names.
Specifically, you have access to the following APIs: {list}"""))
_GLM4_SYSTEM = "你是一个名为 GLM-4 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n"
for _name, _start in (("glm4", _GLM4_SYSTEM), ("glm4_0414", "")):
    register_format(ToolFormat(_name, "## {name}\n\n{indented}\n在调用上述函数时，请使用 Json 格式表示调用的参数。", _start + "# 可用工具\n\n{tools}", joint="\n",
        call="{name}\n{arguments}", call_joint="<|assistant|>", call_end="<|observation|>", response_joint="<|observation|>\n", response_frame="\n{responses}<|assistant|>\n"))
_LLAMA_FRAME = """Given the following functions, please respond with a JSON for a function call with its proper arguments that best answers the given prompt.

Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}. Do not use variables.

{tools}

{user}"""
for _name, _start, _end, _eot in (("llama3", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"), ("llama4", "<|header_start|>", "<|header_end|>", "<|eot|>")):
    register_format(ToolFormat(_name, "{raw}", _LLAMA_FRAME, call="{parameters_json}", call_joint="\n", call_end="",
        response=f"{_start}tool{_end}\n\n{{content}}{_eot}", response_frame=f"{_eot}{{responses}}{_start}assistant{_end}\n\n"))
register_format(ToolFormat("react_grpo", _REACT_TOOL_EN, """A conversation for tool calling between User and Assistant. The user asks a question which may be solved by calling tools, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process should be enclosed within <think> </think>tags and answer should follow the ReACT format(Action:xxx
Action Input:xxx), i.e., <think> reasoning process here </think> Action: action here
Action Input: parameters here

Answer the following questions as best as you can. You have access to the following tools:

{tools}

Use the following format:

<think>you should always think about what to do</think>
Action: the action to take, should be one of [{names}]
Action Input: the input to the action
Observation: the result of the action, given by the actual calling
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Final Answer: the final answer to the original input question

Begin!
"""))
# ---- end of the fixed values ------------------------------------------------------------------------------------


def _dump(value, **options) -> str:
    return json.dumps(value, ensure_ascii=False, **options)


def tool_fields(tool: dict) -> dict[str, str]:
    """What a description of one tool may show; the tool may be bare or wrapped as a function."""
    bare = tool["function"] if {"type", "function"} <= tool.keys() else tool
    name = bare.get("name_for_model") or bare.get("name")
    about = bare.get("description", bare.get("description_for_model"))
    if name is None or about is None:
        raise ValueError("a tool needs a name and a description")
    arguments = bare.get("parameters") or {}
    wrapped = tool if tool.keys() & {"type", "function"} else {"type": "function", "function": tool}
    return {
        "name": name, "human": bare.get("name_for_human") or name, "description": about, "parameters": arguments if isinstance(arguments, str) else _dump(arguments),
        "json": _dump(bare), "indented": _dump(bare, indent=4), "wrapped": _dump(wrapped), "raw": _dump(tool, indent=4),
    }


def tool_prompt(tools: str, name: str, system: str = "", user: str = "") -> str | None:
    """The prompt of a JSON list of tools; None if it isn't one."""
    parsed = _lenient(tools) if tools else None
    if not isinstance(parsed, list) or not all(isinstance(t, dict) for t in parsed):
        return None
    style, fields = FORMATS[name], [tool_fields(t) for t in parsed]
    listed = "[" + ", ".join(f["json"] for f in fields) + "]"
    return style.frame.format(tools=style.joint.join(style.tool.format(**f) for f in fields), names=",".join(f["name"] for f in fields), list=listed, system=system or "", user=user or "")


def call_text(calls: list[str], name: str) -> str | None:
    """Tool calls (JSON texts with name and arguments) as an assistant's text."""
    style, out = FORMATS[name], []
    for text in calls:
        call = _lenient(text) if isinstance(text, str) else text
        if not isinstance(call, dict) or "name" not in call:
            return None
        given = call.get("arguments", call.get("parameters", {}))
        parsed = _lenient(given) if isinstance(given, str) else given
        out.append(style.call.format(
            name=call["name"], arguments=given if isinstance(given, str) else _dump(given),
            json=_dump({"name": call["name"], "arguments": parsed}), parameters_json=_dump({"name": call["name"], "parameters": parsed}),
        ))
    return style.call_joint.join(out) + style.call_end


def response_text(contents: list[str], name: str) -> str:
    style = FORMATS[name]
    return style.response_frame.format(responses=style.response_joint.join(style.response.format(content=c) for c in contents))


def _over(function: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values])

    return run


def tool_prompts(tools: Column, name: str) -> Column:
    """Column of prompts over a column of JSON tool lists (NULL where it is none)."""
    return _over(lambda t: tool_prompt(t, name))(tools)


def call_texts(calls: Column, name: str) -> Column:
    return _over(lambda c: call_text(list(c), name))(calls)


def response_texts(contents: Column, name: str) -> Column:
    return _over(lambda c: response_text(list(c), name))(contents)


def weighted_sections(text: Column, weights: dict[str, float | tuple[float, ...]], regex: bool = False) -> Column:
    """``array<struct<content, weight>>``: a text cut at delimiters, each part with the weight of its delimiter.

    A pair of weights gives the delimiter and what follows it a weight each, a single one both together; a regular
    expression's match takes its weight and the rest 1. What stands before the first delimiter has weight 1. The contents
    add up to the text; an empty text has no parts, NULL gives NULL. Regular expressions must have no groups of their own.
    """
    part = lambda content, weight: F.struct(content.alias("content"), weight.cast("double").alias("weight"))
    given = {k: tuple(w) if isinstance(w, (tuple, list)) else (w,) for k, w in weights.items()}
    if regex:
        pattern = F.lit("(?s)(.*?)(" + "|".join(given) + r"|\z)")
        weight_of = lambda m: F.coalesce(*[F.when(m.rlike(rf"(?s)\A(?:{k})\z"), float(w[0])) for k, w in given.items()], F.lit(1.0))
        pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("rest"), F.regexp_extract_all(text, pattern, 2).alias("match"))
        parts = F.transform(pairs, lambda p: F.array(part(p["rest"], F.lit(1.0)), part(p["match"], weight_of(p["match"]))))
    else:
        def own(s: Column) -> Column:
            first, follow = F.lit(1.0), F.lit(1.0)
            joined = F.lit(False)
            for k, w in given.items():
                first, follow = F.when(s["key"] == k, float(w[0])).otherwise(first), F.when(s["key"] == k, float(w[-1])).otherwise(follow)
                joined = joined | ((s["key"] == k) & F.lit(len(w) == 1))
            whole = F.array(part(F.concat(s["key"], s["content"]), first))
            return F.when(joined, whole).otherwise(F.array(part(s["key"], first), part(s["content"], follow)))

        parts = F.transform(sections(list(given))(text), own)
    return F.filter(F.flatten(parts), lambda x: x["content"] != "")


# ---- loss weights of conversations -----------------------------------------------------------------------------
@dataclass(frozen=True)
class LossScale:
    """How the answers of a conversation weigh: whole, cut at ``delimiters`` or at matches of ``patterns``, or by a question
    that holds one of ``queries``. ``last_round`` leaves all answers but the last at 0, ``everything`` gives all messages 1."""

    name: str
    delimiters: dict[str, tuple[float, ...]] | None = None
    patterns: dict[str, tuple[float, ...]] | None = None
    queries: dict[str, float] | None = None
    last_round: bool = False
    everything: bool = False


LOSS_SCALES: dict[str, LossScale] = {}


def register_loss_scale(scale: LossScale, replace: bool = False) -> LossScale:
    if scale.name in LOSS_SCALES and not replace:
        raise ValueError(f"loss scale {scale.name} is registered already")
    LOSS_SCALES[scale.name] = scale
    return scale


# Marks of the public agent formats; calls weigh twice, what a tool returns nothing. Register others to change them.
_REACT_WEIGHTS = {"Action:": (2.0, 2.0), "Action Input:": (2.0, 2.0), "Thought:": (1.0, 1.0), "Final Answer:": (1.0, 1.0), "Observation:": (2.0, 0.0)}
_EMPTY_THINK = {r"<think>\s*</think>\s*": (0.0,)}
for _scale in (
    LossScale("default"),
    LossScale("last_round", last_round=True),
    LossScale("all", everything=True),
    LossScale("ignore_empty_think", patterns=_EMPTY_THINK),
    LossScale("last_round_with_ignore_empty_think", patterns=_EMPTY_THINK, last_round=True),
    LossScale("react", delimiters=_REACT_WEIGHTS),
    LossScale("hermes", patterns={r"<tool_call>.+?</tool_call>": (2.0,)}),
    LossScale("qwen", delimiters={"✿FUNCTION✿:": (2.0, 2.0), "✿ARGS✿:": (2.0, 2.0), "✿RETURN✿:": (1.0, 1.0), "✿RESULT✿:": (2.0, 0.0)}),
    LossScale(
        "agentflan",
        delimiters={**{k: (1.0, 3.0) for k in ("Name:", "Action:", "ACTION:", "Tool:", "Command", "Arguments:", "action input", "ACTION_INPUT:", "Action Input:")}, "Thought:": (1.0, 1.0), "Final Answer:": (1.0, 1.0), "Observation:": (2.0, 0.0)},
        queries={k: 3.0 for k in ("What is the tool you want to use", "What are the required parameter names", "What is the value of", "What are the required parameter names for this tool")},
    ),
    LossScale("alpha_umi", delimiters=_REACT_WEIGHTS),
):
    register_loss_scale(_scale)


def loss_sections(messages: Column, mode: str = "default") -> Column:
    """``array<struct<content, weight>>`` of a conversation: its messages in order, answers cut and weighted as a mode says.

    Messages other than answers weigh 0 (1 in 'all'). An answer's question is the message before it. NULL contents give
    no part; NULL messages give NULL.
    """
    scale = LOSS_SCALES[mode]
    whole = lambda content, weight: F.array(F.struct(content.alias("content"), weight.cast("double").alias("weight")))

    def of(m: Column, i: Column, n: Column, before: Column) -> Column:
        content = m["content"]
        if scale.everything:
            return whole(content, F.lit(1.0))
        if scale.delimiters or scale.patterns:
            cut = weighted_sections(content, scale.delimiters or scale.patterns, regex=scale.delimiters is None)
        else:
            cut = whole(content, F.lit(1.0))
        for key, weight in (scale.queries or {}).items():
            cut = F.when(F.coalesce(before["content"].contains(key), F.lit(False)), whole(content, F.lit(weight))).otherwise(cut)
        if scale.last_round:
            cut = F.when(i == n - 1, cut).otherwise(whole(content, F.lit(0.0)))
        return F.when(m["role"] == "assistant", cut).otherwise(whole(content, F.lit(0.0)))

    made = let(F.struct(messages.alias("m"), F.size(messages).alias("n")), lambda s: F.transform(s["m"], lambda m, i: of(m, i, s["n"], F.get(s["m"], i - 1))))
    return F.filter(F.flatten(F.filter(made, lambda x: x.isNotNull())), lambda x: x["content"].isNotNull())
