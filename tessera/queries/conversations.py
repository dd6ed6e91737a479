"""Reshaping of conversations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import agents as G, clean as C, messages as M
from tessera.queries.registry import query
from tessera.runtime import table

_BODY = "CASE WHEN messages[1].role = 'system' THEN messages[2:] ELSE messages END"
_SYSTEM = "CASE WHEN messages[1].role = 'system' THEN messages[1].content END"


def _chats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chats").where("size(messages) > 0").select("sample_id", "messages", "channel", "lang")


@query("""
SELECT sample_id, i AS turn, n, md5(coalesce(prompt, '')) AS prompt_md5, md5(coalesce(response, '')) AS response_md5 FROM (
  SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n, messages[i].content AS prompt, messages[i + 1].content AS response
  FROM (SELECT sample_id, messages, unnest(range(1, len(messages))) AS i FROM chats WHERE len(messages) >= 2) WHERE messages[i].role = 'user' AND messages[i + 1].role = 'assistant')""")
def conversation_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each user message with the answer right after it."""
    pairs = C.pair_by_role(table(spark, root, "chats").select("sample_id", "messages"))
    counts = F.size(F.filter(F.sequence(F.lit(1), F.size("messages") - 1), lambda i: (F.element_at("messages", i)["role"] == "user") & (F.element_at("messages", i + 1)["role"] == "assistant")))
    return pairs.select(
        "sample_id", F.col("turn").cast("long").alias("turn"), counts.cast("long").alias("n"), F.md5(F.coalesce("prompt", F.lit(""))).alias("prompt_md5"), F.md5(F.coalesce("response", F.lit(""))).alias("response_md5")
    )


@query(f"""
WITH b AS (SELECT sample_id, {_SYSTEM} AS system, {_BODY} AS m FROM chats WHERE len(messages) > 0),
ok AS (SELECT * FROM b WHERE len(m) > 0 AND len(list_filter(range(1, len(m) + 1), lambda i: m[i].role IS DISTINCT FROM CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0)
SELECT sample_id, system, (len(m) + 1) // 2 - 1 AS past_turns, md5(coalesce(m[(len(m) - 1) // 2 * 2 + 1].content, '')) AS query_md5, CASE WHEN len(m) % 2 = 0 THEN md5(coalesce(m[len(m)].content, '')) END AS response_md5
FROM ok""")
def messages_to_history(spark: SparkSession, root: str) -> DataFrame:
    """Messages as system, past turns, query and response."""
    h = _chats(spark, root).select("sample_id", F.size(M.without_system(F.col("messages"))).alias("n"), M.messages_to_history(F.col("messages")).alias("h")).where("h IS NOT NULL")
    return h.select(
        "sample_id", "h.system", F.size("h.history").cast("long").alias("past_turns"), F.md5(F.coalesce("h.query", F.lit(""))).alias("query_md5"),
        F.when(F.col("n") % 2 == 0, F.md5(F.coalesce("h.response", F.lit("")))).alias("response_md5"),
    )


@query("""
SELECT question_id, list_transform(list_filter(m, lambda x: x.content IS NOT NULL), lambda x: x.role) AS roles,
  md5(array_to_string(list_transform(list_filter(m, lambda x: x.content IS NOT NULL), lambda x: x.content), '|')) AS contents_md5
FROM (SELECT question_id, list_concat([{'role': 'system', 'content': coalesce(category, 'none')}], flatten(list_transform(turns, lambda t: [{'role': 'user', 'content': t}, {'role': 'assistant', 'content': lang}]))) AS m FROM questions)""")
def history_to_messages(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of query and response as messages, with a system message; missing responses are skipped."""
    q = table(spark, root, "questions")
    m = M.history_to_messages(F.transform("turns", lambda t: F.array(t, F.col("lang"))), F.coalesce("category", F.lit("none")))
    made = q.select("question_id", m.alias("m"))
    return made.select("question_id", F.col("m.role").alias("roles"), F.md5(F.array_join("m.content", "|")).alias("contents_md5"))


@query(f"SELECT sample_id, {_SYSTEM} AS system, len({_BODY}) AS n_rest, md5(coalesce(({_BODY})[1].content, '')) AS first_md5 FROM chats WHERE len(messages) > 0")
def split_system(spark: SparkSession, root: str) -> DataFrame:
    """The leading system message apart from the rest."""
    return _chats(spark, root).select("sample_id", M.system_of(F.col("messages")).alias("system"), M.without_system(F.col("messages")).alias("m")).select(
        "sample_id", "system", F.size("m").cast("long").alias("n_rest"), F.md5(F.coalesce(F.get("m", F.lit(0))["content"], F.lit(""))).alias("first_md5")
    )


@query("""SELECT sample_id, CASE WHEN messages[-1].role = 'assistant' THEN md5(coalesce(messages[-1].content, '')) END AS label_md5,
  CASE WHEN messages[-1].role = 'assistant' THEN len(messages) - 1 ELSE len(messages) END AS n_prompt FROM chats WHERE len(messages) > 0""")
def pop_label(spark: SparkSession, root: str) -> DataFrame:
    """The trailing answer as a label, apart from the prompt."""
    m = F.col("messages")
    has = F.get(m, F.size(m) - 1)["role"] == "assistant"
    return _chats(spark, root).select(
        "sample_id", F.when(has, F.md5(F.coalesce(M.last_answer(m), F.lit("")))).alias("label_md5"), F.size(M.without_last_answer(m)).cast("long").alias("n_prompt")
    )


@query(f"""SELECT sample_id, copy, md5(array_to_string(list_transform(list_concat([{{'role': 'system', 'content': 'Be brief.'}}], {_BODY}), lambda x: x.role || ':' || coalesce(x.content, '')), '|')) AS prompt_md5
FROM (SELECT sample_id, CASE WHEN messages[-1].role = 'assistant' THEN messages[:-2] ELSE messages END AS messages FROM chats WHERE len(messages) > 0), range(3) r(copy)""")
def sampling_requests(spark: SparkSession, root: str) -> DataFrame:
    """Requests for sampling: the system prompt replaced, the trailing answer dropped, each repeated three times."""
    m = M.with_system(M.without_last_answer(F.col("messages")), F.lit("Be brief."))
    rows = M.repeated(_chats(spark, root).select("sample_id", m.alias("m")), 3)
    return rows.select("sample_id", F.col("copy").cast("long").alias("copy"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit("")))), "|")).alias("prompt_md5"))


def _template_sql(t: M.ChatTemplate) -> str:
    lit = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    slot = lambda x, name, value: lit(x).replace("{{" + name + "}}", f"' || {value} || '")
    t = t.marked()
    if t.default_system is not None:
        system = f"coalesce(system, {lit(t.default_system)})"
    else:
        system = "system"
    if t.system_prefix is None:
        head = slot(t.prefix, "SYSTEM", f"coalesce({system}, '')")
    else:
        head = f"CASE WHEN {system} IS NOT NULL THEN {slot(t.system_prefix, 'SYSTEM', system)} ELSE {lit(t.prefix)} END"
    said = f"CASE WHEN m[i].role = 'user' THEN {slot(t.prompt, 'QUERY', "coalesce(m[i].content, '')")} ELSE coalesce(m[i].content, '') || CASE WHEN i = len(m) THEN {lit(t.suffix)} ELSE {lit(t.separator)} END END"
    return f"SELECT sample_id, '{t.name}' AS template, md5({head} || array_to_string(list_transform(range(1, len(m) + 1), lambda i: {said}), '')) AS text_md5 FROM b"


@query(f"WITH b AS (SELECT sample_id, {_SYSTEM} AS system, {_BODY} AS m FROM chats WHERE len(messages) > 0) " + " UNION ALL ".join(_template_sql(M.get_template(n)) for n in M.templates()))
def render_templates(spark: SparkSession, root: str) -> DataFrame:
    """Messages rendered in every registered format."""
    each = F.array(*[F.struct(F.lit(n).alias("template"), F.md5(M.rendered(F.col("messages"), M.get_template(n))).alias("text_md5")) for n in M.templates()])
    return _chats(spark, root).select("sample_id", F.explode(each).alias("e")).select("sample_id", "e.*")


@query(f"""
SELECT sample_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT sample_id,
  CASE WHEN system IS NOT NULL THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END ||
  array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].role = 'user' THEN '<|im_start|>user' || chr(10) || coalesce(m[i].content, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
    ELSE coalesce(m[i].content, '') || '<|im_end|>' || CASE WHEN i = len(m) THEN '' ELSE chr(10) END END), '') AS t
  FROM (SELECT sample_id, {_SYSTEM} AS system, {_BODY} AS m FROM chats WHERE len(messages) > 0))""")
def render_chatml(spark: SparkSession, root: str) -> DataFrame:
    """Messages rendered in the ChatML format."""
    return _chats(spark, root).select("sample_id", M.rendered(F.col("messages"), M.get_template("chatml")).alias("t")).select("sample_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(f"""
SELECT sample_id, md5(t) AS text_md5 FROM (SELECT sample_id,
  CASE WHEN system IS NOT NULL THEN '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || system || '<|eot_id|>' ELSE '<|begin_of_text|>' END ||
  array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].role = 'user' THEN '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || coalesce(m[i].content, '') || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
    ELSE coalesce(m[i].content, '') || '<|eot_id|>' END), '') AS t
  FROM (SELECT sample_id, {_SYSTEM} AS system, {_BODY} AS m FROM chats WHERE len(messages) > 0))""")
def render_llama3(spark: SparkSession, root: str) -> DataFrame:
    """Messages rendered with header tokens."""
    return _chats(spark, root).select("sample_id", F.md5(M.rendered(F.col("messages"), M.get_template("llama3"))).alias("text_md5"))


@query("""SELECT sample_id, md5(array_to_string(list_transform(list_filter(messages, lambda m: coalesce(m.content, '') <> ''), lambda m: upper(m.role[1]) || m.role[2:] || ': ' || m.content), chr(10))) AS text_md5
FROM chats WHERE len(messages) > 0""")
def flatten_messages(spark: SparkSession, root: str) -> DataFrame:
    """Messages as lines of role and content, empty ones left out."""
    return _chats(spark, root).select("sample_id", F.md5(M.flattened(F.col("messages"))).alias("text_md5"))


@query("""
SELECT sample_id, md5(array_to_string(list_transform(range(1, len(messages) + 1), lambda i: CASE WHEN messages[i].role = 'assistant' AND i < len(messages) AND contains(messages[i].content, '</think>')
  THEN trim(string_split(messages[i].content, '</think>')[-1], ' ' || chr(10) || chr(9) || chr(13)) ELSE coalesce(messages[i].content, '') END), '|')) AS text_md5
FROM chats WHERE len(messages) > 0""")
def strip_reasoning(spark: SparkSession, root: str) -> DataFrame:
    """Earlier answers without their reasoning."""
    m = M.without_reasoning(F.col("messages"))
    return _chats(spark, root).select("sample_id", F.md5(F.array_join(F.transform(m, lambda x: F.coalesce(x["content"], F.lit(""))), "|")).alias("text_md5"))


_E = "chr(10)"


@query(r"""
SELECT question_id, md5(turns[1] || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.') AS math_md5,
  md5('以下是中国关于' || coalesce(category, 'none') || '考试的单项选择题，请选出其中的正确答案。' || chr(10) || turns[1] || chr(10) || 'A. ' || coalesce(lang, '-') || chr(10) || 'B. yes' || chr(10) || 'C. no' || chr(10) || 'D. unknown' || chr(10)) AS choice_md5,
  md5(replace('Answer at length: {{QUERY}} Thanks.', '{{QUERY}}', turns[1])) AS filled_md5
FROM questions WHERE turns[1] IS NOT NULL""")
def prompt_templates(spark: SparkSession, root: str) -> DataFrame:
    """The math, multiple-choice and free templates over the first turn of each question."""
    t = F.get("turns", F.lit(0))
    options = [F.coalesce("lang", F.lit("-")), F.lit("yes"), F.lit("no"), F.lit("unknown")]
    return table(spark, root, "questions").where(t.isNotNull()).select(
        "question_id",
        F.md5(M.math_prompt(t)).alias("math_md5"),
        F.md5(M.choice_prompt(F.coalesce("category", F.lit("none")), t, options)).alias("choice_md5"),
        F.md5(M.filled(F.lit("Answer at length: {{QUERY}} Thanks."), t)).alias("filled_md5"),
    )


@query(
    "SELECT sample_id, md5('" + M.CODE_HEAD.replace("\n", "' || chr(10) || '") + "Question:' || chr(10) || p || chr(10) || chr(10) || CASE WHEN trim(coalesce(s, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN '"
    + M.CODE_WITH_STARTER + "' || chr(10) || '```python' || chr(10) || s || chr(10) || '```' || chr(10) || chr(10) ELSE '" + M.CODE_WITHOUT_STARTER
    + "' || chr(10) || chr(10) || '```python' || chr(10) || '# YOUR CODE HERE' || chr(10) || '```' || chr(10) || chr(10) END) AS prompt_md5 FROM (SELECT sample_id, messages[1].content AS p, CASE WHEN channel = 'code' THEN channel WHEN channel = 'math' THEN '  ' END AS s FROM chats WHERE messages[1].content IS NOT NULL)"
)
def code_prompts(spark: SparkSession, root: str) -> DataFrame:
    """The code template with and without starter code."""
    p = F.get("messages", F.lit(0))["content"]
    starter = F.when(F.col("channel") == "code", F.col("channel")).when(F.col("channel") == "math", F.lit("  "))
    return table(spark, root, "chats").where(p.isNotNull()).select("sample_id", F.md5(M.code_prompt(p, starter)).alias("prompt_md5"))


@query("""
SELECT run_id, step, 'Task: acceptance' || chr(10) || 'Sentence: ' || task || chr(10) || 'Category: rejected, accepted' || chr(10) || 'Output: ' AS prompt,
  CASE accept WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' END AS response, count(*) AS n
FROM draft_steps WHERE accept IN (0, 1) AND task IS NOT NULL GROUP BY ALL""")
def cls_generation(spark: SparkSession, root: str) -> DataFrame:
    """Labels as texts to generate; rows without a valid label are dropped."""
    labels = ["rejected", "accepted"]
    rows = table(spark, root, "draft_steps").where("task IS NOT NULL").select("run_id", "step", M.class_prompt(F.col("task"), labels, "acceptance").alias("prompt"), M.label_text(F.col("accept"), labels).alias("response"))
    return rows.where("response IS NOT NULL").groupBy("run_id", "step", "prompt", "response").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT run_id, step, printf('%.1f', conf) AS response FROM draft_steps WHERE conf IS NOT NULL AND abs(conf * 10 - floor(conf * 10) - 0.5) > 1e-6")
def regression_to_text(spark: SparkSession, root: str) -> DataFrame:
    """Numbers as texts with one digit, without the halves that its SQL leaves out; ``regression_to_text_all`` has every row."""
    c = F.col("conf")
    return table(spark, root, "draft_steps").where(c.isNotNull() & (F.abs(c * 10 - F.floor(c * 10) - 0.5) > 1e-6)).select("run_id", "step", M.number_text(c).alias("response")).distinct()


@query()
def regression_to_text_all(spark: SparkSession, root: str) -> DataFrame:
    """Numbers as texts with one digit: every row with a number, halves among them."""
    return table(spark, root, "draft_steps").where("conf IS NOT NULL").select("run_id", "step", M.number_text(F.col("conf")).alias("response")).distinct()


@query("""
WITH c AS (SELECT DISTINCT id, choices, orm FROM candidates WHERE choices IS NOT NULL AND orm IS NOT NULL),
s AS (SELECT id, list_filter(range(1, len(choices) + 1), lambda i: choices[i] IS NOT NULL AND orm[i] > 0) AS pos, list_filter(range(1, len(choices) + 1), lambda i: choices[i] IS NOT NULL AND orm[i] <= 0) AS neg, choices FROM c)
SELECT id, md5(choices[p]) AS positive_md5, len(neg) AS n_negative, md5(array_to_string(list_transform(neg, lambda i: choices[i]), '|')) AS negative_md5, count(*) AS n FROM (SELECT id, choices, neg, unnest(pos) AS p FROM s) GROUP BY ALL""")
def reranker_expand(spark: SparkSession, root: str) -> DataFrame:
    """One row for each positive answer with all negative ones."""
    zipped = F.arrays_zip("choices", "orm")
    rows = table(spark, root, "candidates").where("choices IS NOT NULL AND orm IS NOT NULL").select("id", "choices", "orm").distinct().select("id", zipped.alias("z"))
    rows = rows.select("id", F.filter("z", lambda x: x["choices"].isNotNull() & (x["orm"] > 0)).alias("pos"), F.filter("z", lambda x: x["choices"].isNotNull() & (x["orm"] <= 0)).alias("neg"))
    return (
        rows.select("id", F.explode("pos").alias("p"), F.col("neg.choices").alias("neg"))
        .select("id", F.md5("p.choices").alias("positive_md5"), F.size("neg").cast("long").alias("n_negative"), F.md5(F.array_join("neg", "|")).alias("negative_md5"))
        .groupBy("id", "positive_md5", "n_negative", "negative_md5")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("""SELECT id, i - 1 AS pos, md5(choices[i]) AS choice_md5, orm[i] AS orm, count(*) AS n FROM (SELECT id, choices, orm, unnest(range(1, len(choices) + 1)) AS i FROM candidates WHERE choices IS NOT NULL) GROUP BY ALL""")
def unbatch_choices(spark: SparkSession, root: str) -> DataFrame:
    """Columns of arrays as rows (choices with their scores by position)."""
    rows = table(spark, root, "candidates").where("choices IS NOT NULL").select("id", "orm", F.posexplode("choices").alias("pos", "choice"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.md5("choice").alias("choice_md5"), F.get("orm", F.col("pos")).alias("orm")).groupBy("id", "pos", "choice_md5", "orm").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT question_id, coalesce('System: ' || category || chr(10), '') || array_to_string(list_filter(turns, lambda t: t IS NOT NULL), chr(10)) AS query FROM questions WHERE turns IS NOT NULL""")
def rows_to_requests(spark: SparkSession, root: str) -> DataFrame:
    """Turns joined by lines into one query, with an optional system line."""
    head = F.coalesce(F.concat(F.lit("System: "), F.col("category"), F.lit("\n")), F.lit(""))
    return table(spark, root, "questions").where("turns IS NOT NULL").select("question_id", F.concat(head, F.array_join("turns", "\n")).alias("query"))


@query("""SELECT sample_id, list_transform(messages, lambda m: CASE WHEN m.role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE) AS default_weights,
  list_transform(range(1, len(messages) + 1), lambda i: CASE WHEN messages[i].role = 'assistant' AND i = len(messages) THEN 1.0 ELSE 0.0 END::DOUBLE) AS last_round_weights FROM chats WHERE len(messages) > 0""")
def loss_scale(spark: SparkSession, root: str) -> DataFrame:
    """The loss weight of each message under two strategies."""
    m = F.col("messages")
    return _chats(spark, root).select("sample_id", M.loss_weights(m).alias("default_weights"), M.loss_weights(m, "last_round").alias("last_round_weights"))


@query("""SELECT sample_id, CASE WHEN length(c) >= 1000 THEN '<<<base64:' || c[1:50] || '..>>>' ELSE '(' || length(c) || ')' END AS shown FROM (SELECT sample_id, messages[1].content AS c FROM chats) WHERE c IS NOT NULL""")
def printable_values(spark: SparkSession, root: str) -> DataFrame:
    """Long values cut for logs."""
    c = F.get("messages", F.lit(0))["content"]
    return table(spark, root, "chats").where(c.isNotNull()).select("sample_id", F.when(F.length(c) >= 1000, M.printable(c)).otherwise(F.concat(F.lit("("), F.length(c).cast("string"), F.lit(")"))).alias("shown"))


@query("""SELECT sample_id, md5(string_split(c, '. ')[1] || ' (think again)') AS retry_md5 FROM (SELECT sample_id, messages[-1].content AS c FROM chats WHERE messages[-1].role = 'assistant') WHERE c IS NOT NULL""")
def multi_turn_retry(spark: SparkSession, root: str) -> DataFrame:
    """Answers cut at a mark, with a tip to go on."""
    c = M.last_answer(F.col("messages"))
    return table(spark, root, "chats").where(c.isNotNull()).select("sample_id", F.md5(M.cut_for_retry(c, " (think again)", (". ",))).alias("retry_md5"))


@query("""SELECT sample_id AS id, messages[1].role AS first_role, coalesce(channel, 'general') AS source FROM chats WHERE len(messages) > 0""")
def column_mapping(spark: SparkSession, root: str) -> DataFrame:
    """Renamed columns, unused ones dropped, a default for missing values."""
    renamed = _chats(spark, root).withColumnsRenamed({"sample_id": "id", "channel": "source"}).withColumn("first_role", F.col("messages")[0]["role"])
    return renamed.fillna({"source": "general"}).select("id", "first_role", "source")


@query("""SELECT request_id, CASE WHEN cached_tokens = 0 THEN '{' ELSE '{"cached_tokens":' || cached_tokens || ',' END || '"completion_tokens":' || completion_tokens || '}' AS body, count(*) AS n
FROM request_counters WHERE cached_tokens IS NOT NULL AND completion_tokens IS NOT NULL AND completion_tokens <> -1 GROUP BY ALL""")
def drop_defaults(spark: SparkSession, root: str) -> DataFrame:
    """JSON bodies without the fields that equal their default."""
    rows = table(spark, root, "request_counters").where("cached_tokens IS NOT NULL AND completion_tokens IS NOT NULL AND completion_tokens <> -1")
    return rows.select("request_id", M.without_defaults({"cached_tokens": 0, "completion_tokens": -1}).alias("body")).groupBy("request_id", "body").agg(F.count(F.lit(1)).alias("n"))


@query()
def tool_prompts(spark: SparkSession, root: str) -> DataFrame:
    """Tool lists made from the sources of the documents, rendered in every format."""
    d = table(spark, root, "documents").where("source IS NOT NULL").groupBy(F.lower(F.translate(F.trim("source"), "-", "_")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tools = F.to_json(F.array(F.struct(F.col("name"), F.concat(F.lit("Reads "), "name").alias("description"), F.struct(F.lit("object").alias("type")).alias("parameters"))))
    rows = d.select("name", tools.alias("tools"))
    parts = [rows.select("name", F.lit(f).alias("format"), G.tool_prompts(F.col("tools"), f).alias("prompt")) for f in sorted(G.FORMATS)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


def _parts_sql(text: str, weights: dict, regex: bool = False) -> str:
    """``list<struct(content, weight)>`` of a text: delimiters are set off by marks, which then split it."""
    esc = (lambda k: k) if regex else re.escape
    marked = f"regexp_replace({text}, '({'|'.join(esc(k) for k in sorted(weights, key=len, reverse=True))})', chr(1) || '\\1' || chr(2), 'gs')"
    parts = f"string_split({marked}, chr(1))"
    test = (lambda k: f"regexp_full_match(k, '{k}', 's')") if regex else (lambda k: f"k = '{k}'")
    first = "CASE " + " ".join(f"WHEN {test(k)} THEN {float(w[0])}" for k, w in weights.items()) + " ELSE 1.0 END"
    follow = "1.0" if regex else "CASE " + " ".join(f"WHEN k = '{k}' THEN {float(w[-1])}" for k, w in weights.items()) + " ELSE 1.0 END"
    one = f"CASE WHEN contains(x, chr(2)) THEN [struct_pack(content := split_part(x, chr(2), 1), weight := ({first.replace('k =', 'split_part(x, chr(2), 1) =').replace('match(k,', 'match(split_part(x, chr(2), 1),')})::DOUBLE), struct_pack(content := split_part(x, chr(2), 2), weight := ({follow.replace('k =', 'split_part(x, chr(2), 1) =')})::DOUBLE)] ELSE [struct_pack(content := x, weight := 1.0::DOUBLE)] END"
    return f"list_filter(flatten(list_transform({parts}, lambda x: {one})), lambda y: y.content <> '')"


@query(f"""
WITH c AS (SELECT sample_id, messages[-1].content AS t FROM chats WHERE len(messages) > 0), s AS (SELECT sample_id, {_parts_sql('t', {'Answer:': (2.0, 2.0), 'therefore': (1.5, 0.5), ', ': (0.25, 1.0)})} AS s FROM c WHERE t IS NOT NULL)
SELECT sample_id, i - 1 AS part, md5(s[i].content) AS content_md5, s[i].weight AS weight FROM (SELECT sample_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def split_by_delimiters(spark: SparkSession, root: str) -> DataFrame:
    """Contents cut at delimiters, each part with the weight of its delimiter."""
    c = F.get("messages", F.size("messages") - 1)["content"]
    rows = table(spark, root, "chats").where("size(messages) > 0").select("sample_id", G.weighted_sections(c, {"Answer:": (2.0, 2.0), "therefore": (1.5, 0.5), ", ": (0.25, 1.0)}).alias("s"))
    return rows.where("s IS NOT NULL").select("sample_id", F.posexplode("s").alias("part", "p")).select("sample_id", F.col("part").cast("long").alias("part"), F.md5("p.content").alias("content_md5"), "p.weight")


# Every chat with marks of agent formats in the place of punctuation, so that all modes have something to cut.
_MARKS = ((", ", " Action: "), (". ", " Observation: "), ("? ", " <tool_call>x</tool_call> "), (" and ", " ✿ARGS✿: "), (" und ", " <think> </think> "))
_MARKED_SQL = "m.content"
for _old, _new in _MARKS:
    _MARKED_SQL = f"replace({_MARKED_SQL}, '{_old}', '{_new}')"


def _mode_sql(name: str) -> str:
    scale = G.LOSS_SCALES[name]
    weights = scale.delimiters or scale.patterns
    whole = "[struct_pack(content := t, weight := {}::DOUBLE)]".format
    if scale.everything:
        cut = whole("1.0")
    else:
        cut = _parts_sql("t", weights, scale.delimiters is None) if weights else whole("1.0")
        for k, w in (scale.queries or {}).items():
            cut = f"CASE WHEN contains(before, '{k}') THEN {whole(w)} ELSE {cut} END"
        if scale.last_round:
            cut = f"CASE WHEN i = n THEN {cut} ELSE {whole('0.0')} END"
        cut = f"CASE WHEN role = 'assistant' THEN {cut} ELSE {whole('0.0')} END"
    return f"SELECT sample_id, '{name}' AS mode, i, {cut} AS s FROM u WHERE t IS NOT NULL"


@query(f"""
WITH l AS (SELECT sample_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM chats WHERE len(messages) > 0),
t AS (SELECT sample_id, i, len(messages) AS n, messages[i].role AS role, messages[i] AS m, messages[i - 1] AS b FROM l WHERE messages[i] IS NOT NULL),
u AS (SELECT sample_id, i, n, role, {_MARKED_SQL} AS t, CASE WHEN i > 1 THEN {_MARKED_SQL.replace('m.content', 'b.content')} END AS before FROM t),
a AS ({' UNION ALL '.join(_mode_sql(m) for m in G.LOSS_SCALES)})
SELECT sample_id, mode, sum(len(s))::BIGINT AS parts, round(sum(list_sum(list_transform(s, lambda x: x.weight * length(x.content)))), 4) AS weighed, sum(list_sum(list_transform(s, lambda x: length(x.content))))::BIGINT AS chars FROM a GROUP BY sample_id, mode""")
def loss_scale_modes(spark: SparkSession, root: str) -> DataFrame:
    """Every conversation under every registered mode of loss weights: parts, and characters plain and weighted."""
    def marked(m):
        out = m["content"]
        for old, new in _MARKS:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.when(m.isNotNull(), F.struct(m["role"].alias("role"), out.alias("content")))

    rows = _chats(spark, root).select("sample_id", F.transform("messages", marked).alias("m"))
    each = rows.select("sample_id", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), G.loss_sections(F.col("m"), k).alias("s")) for k in G.LOSS_SCALES])).alias("e")).select("sample_id", "e.mode", "e.s")
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    return each.where(F.size("s") > 0).select("sample_id", "mode", F.size("s").cast("long").alias("parts"), F.round(total(lambda x: x["weight"] * F.length(x["content"])), 4).alias("weighed"), total(lambda x: F.length(x["content"])).cast("long").alias("chars"))
