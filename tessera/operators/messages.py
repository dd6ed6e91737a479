"""Reshaping of chat messages: Column factories over ``array<struct<role, content>>``; everything stays in the JVM.

NULL message lists give NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import let

MESSAGE = "struct<role:string,content:string>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def system_of(messages: Column) -> Column:
    """Content of a leading system message, else NULL."""
    return F.when(F.get(messages, F.lit(0))["role"] == "system", F.get(messages, F.lit(0))["content"])


def without_system(messages: Column) -> Column:
    """The messages after a leading system message."""
    return F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def last_answer(messages: Column) -> Column:
    """Content of a trailing assistant message, else NULL."""
    last = F.get(messages, F.size(messages) - 1)
    return F.when(last["role"] == "assistant", last["content"])


def without_last_answer(messages: Column) -> Column:
    last = F.get(messages, F.size(messages) - 1)
    return F.when(last["role"] == "assistant", F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def with_system(messages: Column, system: Column) -> Column:
    """The messages with ``system`` in front, in the place of a system message if there is one; NULL ``system``: unchanged."""
    return F.when(system.isNull(), messages).otherwise(F.concat(F.array(message("system", system)), without_system(messages)))


def history_to_messages(history: Column, system: Column | None = None) -> Column:
    """``array<array<string>>`` of (query, response) as messages; NULL texts are skipped."""
    turns = F.flatten(F.transform(history, lambda h: F.array(message("user", F.get(h, F.lit(0))), message("assistant", F.get(h, F.lit(1))))))
    turns = F.filter(turns, lambda m: m["content"].isNotNull())
    return turns if system is None else F.when(system.isNotNull(), F.concat(F.array(message("system", system)), turns)).otherwise(turns)


def messages_to_history(messages: Column) -> Column:
    """Struct of ``system``, ``history`` (pairs before the last), ``query`` and ``response`` (NULL where the last turn has none).

    After a leading system message the roles must alternate user, assistant; else the struct is NULL.
    """
    def build(m: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / 2).cast("int")), lambda i: F.array(F.get(m, 2 * i)["content"], F.get(m, 2 * i + 1)["content"]))
        regular = F.forall(F.transform(m, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: F.coalesce(ok, F.lit(False)))
        return F.when(
            regular & (F.size(m) > 0),
            let(pairs, lambda p: F.struct(F.slice(p, F.lit(1), F.size(p) - 1).alias("history"), F.get(F.get(p, F.size(p) - 1), F.lit(0)).alias("query"), F.get(F.get(p, F.size(p) - 1), F.lit(1)).alias("response"))),
        )

    rest = let(without_system(messages), build)
    return F.when(rest.isNotNull(), F.struct(system_of(messages).alias("system"), rest["history"].alias("history"), rest["query"].alias("query"), rest["response"].alias("response")))


def text_content(messages: Column) -> Column:
    """Messages whose contents are any values as messages of texts: a text stays, anything else becomes JSON. NULL stays NULL."""
    def text(m: Column) -> Column:
        shown = F.to_json(F.struct(m["content"].alias("v")))
        inner = F.substring(shown, F.lit(6), F.length(shown) - 6)  # what stands in {"v":...}
        return F.when(m["content"].isNotNull(), F.when(inner.startswith('"'), F.get_json_object(shown, "$.v")).otherwise(inner))

    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), text(m).alias("content")))


def aliased_roles(messages: Column) -> Column:
    """``tool_response`` becomes ``tool``."""
    return F.transform(messages, lambda m: F.struct(F.when(m["role"] == "tool_response", "tool").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def without_reasoning(messages: Column, keep_last: bool = True) -> Column:
    """Assistant messages without what stands before their last ``</think>``; with ``keep_last`` the last message stays whole."""
    def cut(m: Column, i: Column, n: Column) -> Column:
        text = F.when(m["content"].contains("</think>"), F.btrim(F.substring_index(m["content"], "</think>", -1), F.lit(" \n\t\r"))).otherwise(m["content"])
        old = (m["role"] == "assistant") & (i < n - 1 if keep_last else F.lit(True))
        return F.struct(m["role"].alias("role"), F.when(old, text).otherwise(m["content"]).alias("content"))

    return let(F.struct(messages.alias("m"), F.size(messages).alias("n")), lambda s: F.transform(s["m"], lambda m, i: cut(m, i, s["n"])))


def flattened(messages: Column) -> Column:
    """``Role: content`` of every message with content, a line each."""
    said = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.array_join(F.transform(said, lambda m: F.concat(F.initcap(F.coalesce(m["role"], F.lit(""))), F.lit(": "), m["content"])), "\n")


def media_of(parts: Column, kind: str, tag: str | None = None) -> Column:
    """URLs of one kind (image, audio, video) among content parts ``array<struct<type, text, url>>``."""
    return F.transform(F.filter(parts, lambda p: p["type"].isin(kind, f"{kind}_url")), lambda p: p["url"])


def text_of_parts(parts: Column) -> Column:
    """Texts of content parts one after the other, a tag ``<kind>`` for each medium."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("<"), F.regexp_replace(p["type"], "_url$", ""), F.lit(">")))), "")


def as_list(scalar_or_list: Column) -> Column:
    """A scalar medium as a list of one; NULL stays NULL."""
    return F.when(scalar_or_list.isNotNull(), F.array(scalar_or_list))


def one_at_most(**columns: Column) -> Column:
    """A check that fails the query where two of the named columns are set together; NULL where it holds."""
    set_ = F.lit(0)
    for c in columns.values():
        set_ = set_ + c.isNotNull().cast("int")
    return F.assert_true(set_ <= 1, F.lit(f"only one of {', '.join(columns)} may be set"))


def confident(predictions: Column, threshold: float = 0.5) -> Column:
    """Those of ``array<struct<..., score>>`` whose score is above a threshold."""
    return F.filter(predictions, lambda p: p["score"] > threshold)


def printable(text: Column, limit: int = 1000, shown: int = 50) -> Column:
    """A long non-prose value cut for a log."""
    return F.when(F.length(text) >= limit, F.concat(F.lit("<<<base64:"), F.left(text, F.lit(shown)), F.lit("..>>>"))).otherwise(text)


def appended(messages: Column, role: str, content: Column) -> Column:
    return F.concat(messages, F.array(message(role, content)))


def cut_for_retry(text: Column, tip: str, marks: tuple[str, ...] = ("<answer>", "</think>")) -> Column:
    """``text`` up to the first of the marks it holds, and a tip to think again."""
    cut = text
    for mark in reversed(marks):
        cut = F.when(text.contains(mark), F.substring_index(text, mark, 1)).otherwise(cut)
    return F.concat(cut, F.lit(tip))


def repeated(df: DataFrame, n: int, number: str = "copy") -> DataFrame:
    """Every row n times, numbered from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(number)) if n > 0 else df.where("false").withColumn(number, F.lit(0))


@dataclass(frozen=True)
class ChatTemplate:
    """How messages become one text. ``{{SYSTEM}}`` and ``{{QUERY}}`` are replaced; ``{{ROUND}}`` is the 1-based turn.

    Without a ``system_prefix`` the ``prefix`` may hold ``{{SYSTEM}}``, which is empty where there is no system message.
    ``{{BOS}}`` and ``{{EOS}}`` are the marks of a model's tokenizer, where a format leaves them to it.
    """

    name: str
    prefix: str = ""
    system_prefix: str | None = None
    prompt: str = "{{QUERY}}"
    separator: str = ""
    suffix: str = ""
    default_system: str | None = None
    extra: dict = field(default_factory=dict)

    def marked(self, bos: str = "<s>", eos: str = "</s>") -> ChatTemplate:
        """The template with a tokenizer's marks filled in."""
        fill = lambda x: None if x is None else x.replace("{{BOS}}", bos).replace("{{EOS}}", eos)
        return replace(self, **{k: fill(getattr(self, k)) for k in ("prefix", "system_prefix", "prompt", "separator", "suffix")})


_TEMPLATES: dict[str, ChatTemplate] = {}


def register_template(template: ChatTemplate, again: bool = False) -> ChatTemplate:
    if template.name in _TEMPLATES and not again:
        raise ValueError(f"template {template.name} is registered already")
    _TEMPLATES[template.name] = template
    return template


def templates() -> list[str]:
    """The names of all registered templates."""
    return sorted(_TEMPLATES)


def get_template(name: str) -> ChatTemplate:
    return _TEMPLATES[name]


# The marks of widespread public chat formats.
register_template(ChatTemplate("chatml", system_prefix="<|im_start|>system\n{{SYSTEM}}<|im_end|>\n", prompt="<|im_start|>user\n{{QUERY}}<|im_end|>\n<|im_start|>assistant\n", separator="<|im_end|>\n", suffix="<|im_end|>"))
register_template(ChatTemplate("default", system_prefix="{{SYSTEM}}\n\n", prompt="### Human:\n{{QUERY}}\n\n### Assistant:\n", separator="\n\n", suffix="</s>"))
register_template(ChatTemplate("llama3", prefix="<|begin_of_text|>", system_prefix="<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{{SYSTEM}}<|eot_id|>", prompt="<|start_header_id|>user<|end_header_id|>\n\n{{QUERY}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", separator="<|eot_id|>", suffix="<|eot_id|>"))
_GEMMA_TURN = "<start_of_turn>user\n{{QUERY}}<end_of_turn>\n<start_of_turn>model\n"
register_template(ChatTemplate("gemma", prefix="<bos>", system_prefix="<bos><start_of_turn>system\n{{SYSTEM}}<end_of_turn>\n", prompt=_GEMMA_TURN, separator="<end_of_turn>\n", suffix="<end_of_turn>"))
register_template(ChatTemplate("phi3", system_prefix="<|system|>\n{{SYSTEM}}<|end|>\n", prompt="<|user|>\n{{QUERY}}<|end|>\n<|assistant|>\n", separator="<|end|>\n", suffix="<|end|>"))
register_template(ChatTemplate("phi4", system_prefix="<|im_start|>system<|im_sep|>{{SYSTEM}}<|im_end|>", prompt="<|im_start|>user<|im_sep|>{{QUERY}}<|im_end|><|im_start|>assistant<|im_sep|>", separator="<|im_end|>", suffix="<|im_end|>"))
register_template(ChatTemplate("deepseek_v2_5", prefix="<｜begin▁of▁sentence｜>{{SYSTEM}}", prompt="<｜User｜>{{QUERY}}<｜Assistant｜>", separator="<｜end▁of▁sentence｜>", suffix="<｜end▁of▁sentence｜>"))
register_template(ChatTemplate("deepseek_coder", prefix="{{SYSTEM}}", prompt="### Instruction:\n{{QUERY}}\n### Response:\n", separator="\n<|EOT|>\n", suffix="\n<|EOT|>", default_system="You are an AI programming assistant, utilizing the Deepseek Coder model, developed by Deepseek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer\n"))
register_template(ChatTemplate("mistral_2501", prefix="<s>", system_prefix="<s>[SYSTEM_PROMPT]{{SYSTEM}}[/SYSTEM_PROMPT]", prompt="[INST]{{QUERY}}[/INST]", separator="</s>", suffix="</s>"))
register_template(ChatTemplate("zephyr", system_prefix="<|system|>\n{{SYSTEM}}</s>\n", prompt="<|user|>\n{{QUERY}}</s>\n<|assistant|>\n", separator="</s>\n", suffix="</s>"))
register_template(ChatTemplate("sus", prefix="{{SYSTEM}}", prompt="### Human: {{QUERY}}\n\n### Assistant: ", separator="<|endoftext|>", suffix="<|endoftext|>"))
register_template(ChatTemplate("orion", prefix="<s>{{SYSTEM}}", prompt="Human: {{QUERY}}\n\nAssistant: </s>", separator="</s>", suffix="</s>"))
register_template(ChatTemplate("xverse", prefix="{{SYSTEM}}", prompt="Human: {{QUERY}}\n\nAssistant: ", separator="{{EOS}}", suffix="{{EOS}}"))
register_template(ChatTemplate("ziya", prefix="{{BOS}}{{SYSTEM}}", prompt="<human>:{{QUERY}}\n<bot>:", separator="\n", suffix="{{EOS}}"))
register_template(ChatTemplate("bluelm", prefix="{{BOS}}{{SYSTEM}}", prompt="[|Human|]:{{QUERY}}[|AI|]:", suffix="{{EOS}}"))
register_template(ChatTemplate("codefuse", system_prefix="<s>system\n{{SYSTEM}}\n", prompt="<s>human\n{{QUERY}}\n<s>bot\n", separator="{{EOS}}\n", suffix="{{EOS}}"))
register_template(ChatTemplate("codefuse_codellama", prefix="{{SYSTEM}}", prompt="<|role_start|>human<|role_end|>{{QUERY}}<|role_start|>bot<|role_end|>", suffix="{{EOS}}"))
register_template(ChatTemplate("llama2", prefix="<s>[INST] ", system_prefix="<s>[INST] <<SYS>>\n{{SYSTEM}}\n<</SYS>>\n\n", prompt="{{QUERY}} [/INST]", separator="</s><s>[INST] ", suffix="</s>"))


def rendered(messages: Column, template: ChatTemplate, bos: str = "<s>", eos: str = "</s>") -> Column:
    """Messages in the format of a template: system, then each user message and its answer; an open turn ends the text.

    ``bos`` and ``eos`` are the marks of the model's tokenizer, for formats that leave them to it.

    Messages must alternate user, assistant after a leading system message; NULL contents are empty.
    """
    template = template.marked(bos, eos)
    system = F.coalesce(system_of(messages), F.lit(template.default_system))
    head = F.lit(template.prefix)
    if template.system_prefix is None and "{{SYSTEM}}" in template.prefix:
        head = F.replace(head, F.lit("{{SYSTEM}}"), F.coalesce(system, F.lit("")))
    elif template.system_prefix is not None:
        head = F.when(system.isNotNull(), F.replace(F.lit(template.system_prefix), F.lit("{{SYSTEM}}"), system)).otherwise(head)

    def body(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            content = F.coalesce(x["content"], F.lit(""))
            asked = F.replace(F.replace(F.lit(template.prompt), F.lit("{{ROUND}}"), F.floor(i / 2 + 1).cast("string")), F.lit("{{QUERY}}"), content)
            after = F.when(i == F.size(m) - 1, F.lit(template.suffix)).otherwise(F.lit(template.separator))
            return F.when(x["role"] == "user", asked).otherwise(F.concat(content, after))

        return F.array_join(F.transform(m, one), "")

    return F.concat(head, let(without_system(messages), body))


def loss_weights(messages: Column, mode: str = "default") -> Column:
    """One weight a message: 1 for answers, 0 for the rest; 'last_round' only the last answer, 'all' everything."""
    if mode == "all":
        return F.transform(messages, lambda _: F.lit(1.0))
    if mode == "last_round":
        return let(
            F.struct(messages.alias("m"), F.size(messages).alias("n")),
            lambda s: F.transform(s["m"], lambda x, i: F.when((x["role"] == "assistant") & (i >= s["n"] - 1), 1.0).otherwise(0.0)),
        )
    return F.transform(messages, lambda x: F.when(x["role"] == "assistant", 1.0).otherwise(0.0))


# ---- prompts --------------------------------------------------------------------------------------------------
# The texts that evaluation prompts are made of.
MATH_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."
CODE_SYSTEM = "You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests."
CODE_HEAD = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. You will NOT return anything except for the program.\n\n"
CODE_WITH_STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters."
CODE_WITHOUT_STARTER = "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."


def math_prompt(problem: Column) -> Column:
    return F.concat(problem, F.lit(MATH_SUFFIX))


def choice_prompt(subject: Column, question: Column, options: list[Column]) -> Column:
    """The multiple-choice prompt: heading with the subject, the question and one line for each option, lettered from A."""
    lines = [F.concat(F.lit(f"{chr(65 + i)}. "), o, F.lit("\n")) for i, o in enumerate(options)]
    return F.concat(F.lit("以下是中国关于"), subject, F.lit("考试的单项选择题，请选出其中的正确答案。\n"), question, F.lit("\n"), *lines)


def code_prompt(question: Column, starter: Column) -> Column:
    has = F.coalesce(F.btrim(starter, F.lit(" \t\n\r")), F.lit("")) != ""
    tail = F.when(has, F.concat(F.lit(CODE_WITH_STARTER + "\n```python\n"), starter, F.lit("\n```\n\n"))).otherwise(F.lit(CODE_WITHOUT_STARTER + "\n\n```python\n# YOUR CODE HERE\n```\n\n"))
    return F.concat(F.lit(CODE_HEAD + "Question:\n"), question, F.lit("\n\n"), tail)


def filled(template: Column, value: Column, slot: str = "{{QUERY}}") -> Column:
    return F.replace(template, F.lit(slot), value)


def class_prompt(sentence: Column, labels: list[str], task: str = "", pair: Column | None = None) -> Column:
    """A classification task as text generation: the sentence (or pair), its categories, and the slot for the answer."""
    head = F.concat(F.lit("Sentence: "), sentence) if pair is None else F.concat(F.lit("Sentence1: "), sentence, F.lit("\nSentence2: "), pair)
    return F.concat(F.lit(f"Task: {task}\n"), head, F.lit(f"\nCategory: {', '.join(labels)}\nOutput: "))


def label_text(label: Column, labels: list[str]) -> Column:
    """The text of a 0-based label; NULL for NULL or a number out of range."""
    return F.get(F.array(*[F.lit(x) for x in labels]), label.cast("int"))


def number_text(value: Column, digits: int = 1) -> Column:
    """A number with so many digits after the point, as C and Python print it: its exact binary value is rounded, exact ties go to the even digit.

    NULL gives NULL; infinite numbers, NaN and those from 2^63 on are left to Java's printer.
    """
    x = value.cast("double")
    scale = 10.0**digits
    split = lambda a: (134217729.0 * a) - (134217729.0 * a - a)
    whole = F.floor(F.abs(x))
    r = F.abs(x) - whole.cast("double")
    p, rh, sh = r * scale, split(r), split(scale)
    error = ((rh * sh - p) + rh * (scale - sh) + (r - rh) * sh) + (r - rh) * (scale - sh)  # p + error is r * scale exactly
    low = F.floor(p)
    rest = p - low.cast("double")
    odd = F.pmod(low if digits else whole, F.lit(2)) == 1
    k = low + F.when((rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd))), 1).otherwise(0)
    over = F.when(k >= int(scale), 1).otherwise(0)
    tail = F.concat(F.lit("."), F.lpad((k - over * int(scale)).cast("string"), digits, "0")) if digits else F.lit("")
    text = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), (whole + over).cast("string"), tail)
    return F.when(F.abs(x) < 2.0**63, text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def without_defaults(columns: dict[str, object]) -> Column:
    """JSON of the given columns, leaving out those equal to their default."""
    return F.to_json(F.struct(*[F.nullif(F.col(c), F.lit(d)).alias(c) for c, d in columns.items()]))
