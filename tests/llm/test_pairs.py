import pytest
from pyspark.sql import functions as F

from tessera.llm import pairs as P

MESSAGES = "array<struct<role:string,content:string>>"
Q = "Describe the link between the quiet mill and the tall bridge for readers in Osnorvek."


@pytest.mark.parametrize("answer", [None, "", "  \n", "​", "```\n\n```", "<think>\n</think>", "**Answer**:", "答案：", "N/A", "(no response)", "...", "-", "[empty]", "<|assistant|>" * 15, "<|assistant|>" * 16, "N/A " * 40, "N/A " * 60, "-" * 900 + "\n" * 900])
def test_empty(answer):
    assert P.defects(Q, answer)[0] == "empty"


def test_every_rule_that_fires_comes_out():
    assert P.defects(Q, None) == ["empty"] and P.defects(Q, "...") == ["empty", "truncated"]
    assert P.defects(Q, "<|assistant|> It is so. " * 20) == []


@pytest.mark.parametrize(
    "answer",
    [
        "I'm sorry, but I can't help with that request.",
        "REGRETTABLY, MY ANSWER TO THIS HAS TO BE NO.",
        "You want to know about the tall mill. I have to pass on this one, even in general terms.",
        "抱歉，我无法回答这个问题。",
        "申し訳ありませんが、この質問にお答えすることはできません。",
        "Leider muss ich diese Bitte ablehnen.",
        "Je suis désolé, je ne peux pas aider pour cette demande.",
        "Lo siento, no puedo ayudar con esa petición.",
        "Lamento, mas não posso ajudar com esse pedido.",
        "К сожалению, вынужден отклонить эту просьбу.",
    ],
)
def test_refusal(answer):
    assert P.defects(None, answer)[0] == "refusal"


# Phrasings written along with the families, some known before: they guard against regressions and measure no recall.
PHRASINGS = {
    "en": "I refuse.|I must refuse to answer.|That's not something I can do for you.|I'm not going to answer this.|Unfortunately I'm not permitted to talk about it.|This request is against my policy.|Sorry, no can do.|We are unable to process this request.|I shall not speak about it; I can't explain why.",
    "de": "Tut mir leid, das geht leider nicht.|Ich weigere mich, das zu schreiben.|Das ist mir nicht gestattet.|Darüber spreche ich nicht.|Diese Anfrage kann ich leider nicht bearbeiten.",
    "fr": "Je regrette, mais ce n'est pas possible.|Je m'abstiens de tout commentaire.|Il m'est impossible de répondre à cette demande.|Désolé, je n'ai pas le droit d'en parler.",
    "es": "Me niego a responder.|Lamentablemente, no es posible atender esta solicitud.|No me está permitido hablar de ello.|Prefiero no opinar.",
    "pt": "Recuso-me a responder.|Infelizmente, não é possível.|Não tenho permissão para falar disso.|Peço desculpa, mas não consigo ajudar.",
    "ru": "К сожалению, с этим помочь не получится.|Я отказываюсь отвечать.|Мне запрещено это обсуждать.|Извините, но это невозможно.",
    "zh": "恕难从命。|这个我帮不了你。|很遗憾，我无权透露。|对不起，这个要求我做不到。",
    "ja": "申し訳ありませんが、その件については触れられません。|ご要望には応じられません。|すみませんが、お手伝いできません。|お力になれません。",
}


@pytest.mark.parametrize("language", sorted(PHRASINGS))
def test_other_phrasings(language):
    said = PHRASINGS[language].split("|")
    assert sum("refusal" in P.defects(Q, x) for x in said) >= 0.8 * len(said)


def test_refusals_of_any_length():
    assert P.defects(Q, "I'm sorry, but I can't help with that request. " * 10) == ["refusal"]
    assert "refusal" in P.defects(Q, "You want to know about the tall bridge. The quiet mill is what readers ask about. " + "I won't go into that. " * 3)
    assert P.defects(Q, "I can't say who built it, but this is known. " + "The mill by the river feeds the bridge, and the town paid for both of them. " * 4) == []


@pytest.mark.parametrize(
    "answer",
    [
        "He wrote: I can't answer that today.", "The clerk said, “I cannot help you,” and closed the window.", "Er kann heute nicht helfen.", "The bridge cannot be crossed in winter.", "Unfortunately, the mill is not open on Sundays.",
        "Le pont n'est pas ouvert en hiver.", "El molino no puede abrir por la nieve.", "Мельница не может работать зимой.", "这座桥冬天不能通行。", "この橋は冬に渡ることができません。", "他说他不能回答这个问题。", "彼は質問に答えられませんでした。",
        "Der Müller antwortete: Ich kann dir nicht helfen.", "Do not answer the door.", "In this letter the writer declines the offer of the town.", "```\nprint('I cannot help')\n```",
    ],
)
def test_no_refusal(answer):
    assert "refusal" not in P.defects("Why did he leave?", answer)


@pytest.mark.parametrize(
    "answer",
    [
        "The sign read that guests are unable to enter despite the rain.",
        "The clerk at Nuprali said she was sorry for the delay of 12 minutes.",
        "Sorry for the confusion above; the figure for Haroom is 12.",
        "Thank you for asking about Nenutar. It is a town by the river.",
        "Yes.", "1284", "Option B", "True", "About 1104 metres.", "Omdraco", "\\boxed{5}", "The result is \\boxed{477}", "It costs 5 coins. \n\nAnswer: 223",
        "Here they are:\n\n- the open mill of Lamba\n- the sturdy pump of Zedor\n- the sealed garden of Rubor", "```python\nprint(1)\n```", "好。", "**It is done.**", "“It is done.”",
    ],
)
def test_sound_answers(answer):
    assert P.defects(Q, answer) == []


@pytest.mark.parametrize(
    "answer",
    [
        "The quiet mill feeds the tall bridge, which",
        "The quiet mill feeds the tall bridge and the worn…",
        "The quiet mill feeds the tall bri (to be continued)",
        "养蜂人估算出厚厚的账本，而鲁迪蒙的石桥边的磨坊公开（未完待续）",
        "First take $60 = 960$. Then",
        "Take this:\n\n```python\ndef f(x):\n    return",
        "The result is \\boxed{4",
        "The mill counted 2322,",
        "The quiet mill feeds the bridge (see",
        "严格来说，大约1029位客人看到玻璃温室保存着一整排木",
    ],
)
def test_truncated(answer):
    assert P.defects(None, answer) == ["truncated"]


@pytest.mark.parametrize("answer", [Q, f"You asked: {Q}", f"> {Q}", Q.upper(), f"{Q}\n\n{Q}", Q.replace("the quiet", "quiet")])
def test_echo(answer):
    assert P.defects(Q, answer)[0] == "echo"


@pytest.mark.parametrize("question", ["¿Qué debe hacer el equipo cuando la sala de archivos copia todo el envío?", "Draft a note that says the painted mill copies the narrow lantern before noon."])
def test_words_of_repetition_in_the_text_ask_for_none(question):
    assert P.defects(question, question)[0] == "echo"


def test_no_echo():
    text = "The quiet mill feeds the tall bridge in the valley."
    assert P.defects(f"Repeat the following text exactly as it stands:\n{text}", text) == []
    assert P.defects(Q, f"{Q}\n\nIt is said that the mill was built long before the bridge, and that both were paid for by the town.") == []


def test_language():
    german = "Die Mühle versorgt die Brücke, und der Turm steht nicht weit von dem Fluss."
    assert P.defects(Q, german) == ["wrong_language"]
    assert P.defects("Answer in German, please: " + Q, german) == []
    assert P.defects(Q, german + " The mill stands by the river and feeds the bridge with its water.") == []
    assert P.defects("请介绍一下磨坊和桥之间的关系。", "この橋は川の近くにあります。") == ["wrong_language"]
    # the question has a passage in the answer's language
    assert P.defects("请介绍一下磨坊和桥之间的关系。 What is the link between the mill and the bridge in the valley?", "The mill is near the bridge, and it feeds the town with water.") == []


def chats(spark, rows):
    return spark.createDataFrame(rows, f"sample_id long, messages {MESSAGES}, rec_id string, m string, pos int")


def test_table_with_every_kind_of_row(spark):
    rows = [
        (1, [("user", "How is it?"), ("assistant", None)], "clash", "x", 1),
        (2, [("system", "s"), ("user", "How is it?"), ("assistant", "It is fine."), ("user", "And you?")], None, None, None),
        (3, None, None, None, None),
        (4, [], None, None, None),
        (5, [("assistant", "")], None, None, None),  # answers nothing
        (6, [("user", None), ("assistant", "I won't go into that.")], None, None, None),
        (7, [None, ("user", "a"), ("assistant", "")], None, None, None),
        (1, [("user", "How is it?"), ("assistant", None)], "clash", "x", 1),
        (None, [("user", "a"), ("assistant", " ")], None, None, None),
        (8, [("user", "a"), ("assistant", "word " * 200_000 + "end.")], None, None, None),
    ]
    got = P.broken_pairs(chats(spark, rows), "sample_id").collect()
    assert sorted((r["rec_id"] or "", r["pos"], r["defects"][0]) for r in got) == [("", 1, "empty"), ("1", 1, "empty"), ("1", 1, "empty"), ("6", 1, "refusal"), ("7", 2, "empty")]
    assert P.broken_pairs(chats(spark, []), "sample_id").count() == 0


def test_choices(spark):
    df = spark.createDataFrame(
        [("a", [("user", Q), ("assistant", "x")], ["", None, Q, "It is fine."]), ("b", None, None), ("c", None, [None]), ("d", [], [])],
        f"id string, messages {MESSAGES}, choices array<string>",
    )
    got = P.broken_pairs(df, "id", choices="choices").collect()
    assert sorted((r["rec_id"], r["pos"], r["defects"][0]) for r in got) == [("a", 0, "empty"), ("a", 1, "empty"), ("a", 2, "echo"), ("c", 0, "empty")]


def test_p1_on_the_tables(spark, small):
    rows = P.p1_found(spark, small).collect()
    assert {r["defect"] for r in rows} <= set(P.RULES) and len(rows) == len(set(rows)) and len(rows) > 0
    assert P.p1_found(spark, small).columns == ["tab", "rec_id", "pos", "defect"]
