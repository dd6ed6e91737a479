"""Problem 1: broken question and answer pairs.

Method: ordered rules on each pair, one vectorised pass over the conversations and no shuffle (but for the
redelivered candidates). Every rule that fires is emitted by ``defects``; since an answer has one defect at most,
``p1_found`` keeps the first in the order of RULES: an empty answer is nothing else, a refusal needn't be
complete, a copied question needn't be in the answer's language.

1. empty: nothing but blanks, marks, markup, a bare heading or a placeholder is left;
2. refusal: sentences of the answer decline in one of eight languages (inability, unwillingness, rules, apology and
   denial, outside quotations), and what is left besides courtesies and the question's words is less than half;
3. echo: what is left after a short lead-in is a run of the question's own wording (copied prefixes included),
   unless the question asks for its repetition;
4. wrong_language: script, then function words, of the whole answer point to another language than the
   question's, unless the question asks for that language;
5. truncated: an unclosed fence, formula, bracket or quotation, a mark of continuation, or an abrupt ending.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.runtime import spread, table

RULES = ("empty", "refusal", "echo", "wrong_language", "truncated")

#: Longest lead-in (words, or characters of a script without blanks) before a copied question.
LEAD_WORDS = 8
#: An echo holds at least so many words (characters of a script without blanks) of the question.
ECHO_WORDS, ECHO_CHARACTERS = 4, 10

# ---- Fixed values: placeholders and headings, folded to words -------------------------------------------------
PLACEHOLDERS = frozenset(
    """
n a|na|null|none|nil|nan|empty|no response|no answer|response|answer|the answer|final answer|solution|result|output|reply|assistant|undefined|
not available|not applicable|missing|blank|todo|tbd|placeholder|no content|no output|no reply|no text|answer here|your answer here|
k a|keine antwort|antwort|lösung|ergebnis|leer|sin respuesta|respuesta|solución|vacío|pas de réponse|aucune réponse|réponse|solution|vide|
sem resposta|resposta|solução|vazio|нет ответа|ответ|решение|пусто|答案|回答|答|解答|无|暂无|空|空白|没有回答|无回答|无答案|暂无答案|无内容|
回答なし|答え|なし|該当なし|未回答
""".replace("\n", "").split("|")
)

PLACEHOLDER_WORDS = max(len(set(p.split())) for p in PLACEHOLDERS)

# ---- Declining: families of phrases by language ----------------------------------------------------------------
# A sentence, folded to lower-case words, declines if it says in the first person that the speaker can't, mustn't or
# won't talk or help, if it appeals to rules, or if an apology stands with a denial of what was asked. The words below
# are fixed values; the families are built from them.
_SPEAK = {
    "en": r"help|assist|answer|respond|reply|provide|comment|discuss|fulfill?|comply|go (?:into|there|along)|do (?:that|this|it|so|such)|support|share|offer|give|talk|speak|engage|continue|complete|accept|process|write|generate|create|produce|say|tell|advise|weigh in|take (?:that|this|it|part)|meet|grant|satisfy|touch|get into|cover|address|handle|recommend|reveal|disclose|explain|elaborate|describe|entertain|serve|proceed|oblige|be (?:of|any) (?:help|assistance|use)|participate|agree|honou?r|work on|act on|deal with",
    "de": r"helfen|weiterhelfen|aushelfen|beantworten|antworten|äußern|sagen|geben|eingehen|unterstützen|besprechen|nachkommen|erfüllen|sprechen|reden|erteilen|mitteilen|bieten|anbieten|liefern|erklären|schreiben|behandeln|entsprechen|machen|tun|dienen|teilen|kommentieren|diskutieren|annehmen|bearbeiten|verraten|mitwirken",
    "fr": r"aider|répondre|donner|fournir|parler|discuter|commenter|traiter|satisfaire|accéder|aborder|dire|proposer|offrir|partager|expliquer|écrire|faire|continuer|poursuivre|entrer|évoquer|accepter|exécuter|prononcer|assister|révéler|me prononcer|m exprimer|donnerai suite",
    "es": r"ayudar\w*|responder\w*|contestar\w*|entrar|hablar\w*|ofrecer\w*|comentar\w*|proporcionar\w*|dar\w*|atender\w*|cumplir\w*|discutir\w*|tratar\w*|decir\w*|compartir\w*|explicar\w*|escribir\w*|hacer\w*|continuar|satisfacer\w*|aceptar\w*|opinar|abordar\w*|facilitar\w*|complacer\w*|revelar\w*",
    "pt": r"ajudar\w*|responder\w*|entrar|falar|oferecer|comentar|fornecer|dar|atender|cumprir|discutir|tratar|dizer|partilhar|compartilhar|explicar|escrever|fazer|continuar|satisfazer|aceitar|opinar|abordar|auxiliar|revelar",
    "ru": r"помочь|помогать|ответить|отвечать|обсуждать|обсудить|предоставить|выполнить|выполнять|говорить|рассказать|рассказывать|сказать|комментировать|прокомментировать|дать|давать|написать|писать|касаться|высказаться|высказываться|объяснить|объяснять|поддержать|продолжить|продолжать|содействовать|делать|сделать|посоветовать|раскрыть|исполнить|удовлетворить",
}
_NOT_EN = r"(?:can ?not|can ?t|could not|couldn ?t|won ?t|will not|wouldn ?t|would not|may not|must not|mustn ?t|shouldn ?t|should not|don ?t|do not|(?:am|m|is|re|are|be) (?:\w+ )?(?:unable|not|prohibited|forbidden|barred|restricted|prevented)|never|no longer)"
_ASKED_EN = r"(?:this|that|it|such|your|the|these|those|any) ?(?:question|request|topic|subject|matter|query|one|task|kind|inquiry)?s?"
_DECLINES = {
    "en": (
        rf"\b(?:i|we) (?:\w+ ){{0,2}}?{_NOT_EN} (?:\w+ ){{0,5}}?(?:{_SPEAK['en']})\b",
        r"\b(?:i|we) (?:\w+ ){0,4}?(?:decline|refuse|pass on|say no|opt out|abstain|sit this|bow out|draw the line|turn (?:this|that|it|your|you)|leave (?:this|that|it|the|your))\b",
        r"\b(?:i|we) (?:ll|will|must|have to|need to|am going to|m going to) (?:\w+ )?(?:pass|skip|leave (?:this|that|it))\b",
        r"\b(?:i|we) (?:d|would|ll|will)?(?: \w+){0,2}? ?(?:rather|prefer|choose|elect)(?: to)? (?:not|leave|skip|avoid|refrain|keep out|stay)\b|\b(?:i|we) (?:d|would)? ?(?:prefer|rather) (?:\w+ ){0,2}?(?:weren ?t|didn ?t)\b",
        r"\b(?:i|we) (?:do not|don ?t) feel (?:able|comfortable|free|right)\b|\b(?:i|we) (?:m|am|re|are) (?:\w+ )?(?:not|un)(?: \w+)? ?(?:able|allowed|permitted|willing|comfortable|going|equipped|authori[sz]ed|qualified|position|prepared|supposed|free|here) ?(?:to|with|of|for|in)?\b",
        rf"\b(?:this|that|it|such \w+|your \w+|{_ASKED_EN})\b.{{0,30}}?\b(?:isn ?t|is not|s not|not|outside|beyond|exceeds|past)\b (?:\w+ ){{0,3}}?(?:i|we|my|our|me|us)\b (?:\w+ )?(?:can|am|m|may|will|would|wish|ll|scope|remit|limits|role|purview|able|allowed|to|willing|mandate|comfortable)\b",
        r"\b(?:my|our|the) (?:\w+ )?(?:guidelines|rules|instructions|policies|policy|programming|principles|guidance|terms|restrictions|safety rules) (?:\w+ )?(?:keep|prevent|forbid|stop|prohibit|bar|rule|do(?:es)? ?n ?t (?:allow|let|permit)|do(?:es)? not (?:allow|let|permit)|won ?t (?:allow|let|permit)|prohibits|forbids|prevents|say no)",
        r"\b(?:against|contrary to|violates?|breaks?) (?:my|our) (?:\w+ )?(?:guidelines|rules|instructions|policies|policy|programming|principles)\b",
        r"\b(?:i|we) (?:was|am|m|were) (?:built|made|designed|told|trained|instructed|asked|programmed) (?:to (?:stay away|avoid|refuse|decline|steer clear|keep out)|not to)\b",
        r"\bmy (?:answer|reply|response)\b.{0,20}\b(?:has to be|must be|is|remains) (?:a )?no\b|\bthe answer (?:from me )?(?:is|has to be|must be) no\b",
        r"\bthere (?:is|s) (?:nothing|no (?:answer|way|help)) (?:\w+ )?(?:i|we) (?:can|could|may|am|m)\b|\bno (?:answer|help|comment) (?:can be given|from me|is possible here)\b|\bno comment\b",
        r"\b(?:would ?n ?t|would not|isn ?t|is not) (?:be )?(?:appropriate|proper|right|ok|okay|possible) (?:for me|to (?:answer|help|discuss|respond|comment))\b|\bis off (?:the table|limits)\b",
        r"\bas an? (?:ai|artificial|language|large language)\b.{0,40}\b(?:can ?not|can ?t|not able|unable|not allowed|won ?t|do not|don ?t)\b",
        r"\b(?:sorry|afraid|apolog\w+|regret\w*|unfortunately)\b.{0,40}\b(?:i|we|that|this|it)\b.{0,25}\b(?:not possible|impossible|can ?t be done|cannot be done|decline|refuse|unable|out of the question|no can do|rather|prefer|pass|leave|can ?t|cannot|won ?t)\b(?! (?:\w+ ){0,2}?(?:see|find|remember|wait))",
        r"\byour (?:request|question) (?:has been|is|must be|was|will be) (?:declined|refused|denied|rejected)\b|\bcount me out\b|\bno can do\b",
    ),
    "de": (
        rf"\b(?:ich|wir) (?:\w+ ){{0,2}}?(?:kann|darf|könnte|möchte|werde|will|mag|muss|soll|können|dürfen|werden|wollen|möchten)\b (?:\w+ ){{0,7}}?(?:nicht|kein\w*|nichts|niemals)\b (?:\w+ ){{0,5}}?(?:{_SPEAK['de']})\b",
        rf"\b(?:kann|darf|könnte|möchte|werde|will|mag|muss|soll|können|dürfen) (?:ich|wir)\b (?:\w+ ){{0,7}}?(?:nicht|kein\w*|nichts)\b (?:\w+ ){{0,5}}?(?:{_SPEAK['de']})\b",
        r"\b(?:kann|darf|möchte|werde|muss|will) (?:ich|wir)\b.{0,40}\b(?:nicht|keine|passen|ablehnen|verweigern|verzichten)\b|\b(?:ich|wir) (?:\w+ )?(?:muss|möchte|werde|will|müssen)\b.{0,60}\b(?:ablehnen|passen|verweigern|absehen|verzichten|zurückweisen|enthalten)\b",
        r"\b(?:ich|wir) (?:lehne|verweigere|weigere|verzichte|enthalte|passe|bedaure|lehnen|verweigern)\b|\blehne ich\b|\bverweigere ich\b|\b(?:gehe|antworte|helfe|rede|spreche|sage|gebe|schreibe|mache|äußere|beantworte|bespreche) ich (?:\w+ ){0,4}?(?:nicht|nichts|keine?)\b|\bich (?:gehe|antworte|helfe|rede|spreche|sage|gebe|schreibe|mache|äußere|beantworte|bespreche) (?:\w+ ){0,5}?(?:nicht|nichts|keine?)\b",
        r"\b(?:ich bin|bin ich|wir sind) (?:\w+ ){0,3}?(?:nicht|außerstande|außer stande) ?(?:\w+ ){0,3}?(?:in der lage|befugt|berechtigt|bereit|imstande|zuständig|ermächtigt|autorisiert)?\b",
        r"\b(?:meine|unsere|die) (?:\w+ )?(?:vorgaben|regeln|richtlinien|anweisungen|grundsätze|bestimmungen|vorschriften)\b.{0,20}\b(?:erlauben|verbieten|gestatten|lassen|untersagen|hindern|verhindern)\b|\b(?:ist|wird|bleibt) mir (?:\w+ )?(?:nicht (?:erlaubt|möglich|gestattet)|untersagt|verboten|unmöglich)\b|\bmir (?:ist|sind) .{0,30}\b(?:nicht (?:erlaubt|möglich|gestattet)|untersagt|verboten)\b|\bverstößt gegen meine\b",
        r"\baußerhalb dessen was ich\b|\bvon mir (?:gibt es )?(?:dazu |hierzu )?(?:keine|nichts)\b|\b(?:dazu|hierzu|darüber|davon) (?:gibt es|bekommen sie|erhalten sie|bekommst du) von mir (?:keine|nichts)\b|\bnicht meine aufgabe\b",
        r"\b(?:tut mir (?:\w+ )?leid|leider|bedauerlicherweise|bedaure|entschuldigung|sorry)\b.{0,60}\b(?:geht|möglich|gehen|machbar|kann|darf|drin|weiterhelfen|helfen)\b.{0,12}\bnicht\b|\b(?:tut mir (?:\w+ )?leid|leider|bedaure|entschuldigung)\b.{0,60}\bnicht (?:\w+ )?(?:möglich|helfen|weiterhelfen|machbar|erlaubt|gehen|beantworten|eingehen)\b",
        r"\bals (?:ki|sprachmodell|künstliche\w*)\b.{0,60}\b(?:nicht|keine?)\b",
    ),
    "fr": (
        rf"\b(?:je|j|nous) (?:n |ne )?(?:\w+ )?(?:peux|puis|pourrai|pourrais|saurais|souhaite|veux|vais|dois|compte|pouvons|voulons|aimerais)(?: \w+){{0,3}}? (?:pas|rien|plus|guère|aucun\w*)\b|\bje ne (?:puis|saurais) (?:\w+ ){{0,3}}?(?:{_SPEAK['fr']})\b",
        r"\bje (?:ne |n )(?:suis|serai|serais) (?:\w+ )?pas (?:\w+ )?(?:en mesure|autorisée?|habilitée?|capable|à même|disposée?|en position|qualifiée?|censée?|là pour|prête?)\b|\bne suis pas en mesure\b",
        r"\bje (?:ne )?(?:donnerai|répondrai|parlerai|aborderai|dirai|ferai|fournirai|commenterai|traiterai|discuterai|réponds|parle|discute|commente|aborde|fais|traite)\b (?:\w+ ){0,2}?(?:pas|rien)\b",
        r"\bje (?:\w+ )?(?:préfère|préférerais|choisis de|tiens à) ne pas\b|\bje (?:dois|vais|suis obligée? de|suis contrainte? de|me vois contrainte? de|souhaite)\b.{0,20}\b(?:refuser|décliner|passer mon tour|laisser|abstenir|rejeter)\b|\bje (?:refuse|décline|m abstiens|m abstiendrai|passe mon tour|rejette)\b",
        r"\b(?:mes|les|nos) (?:\w+ )?(?:consignes|règles|instructions|directives|principes|conditions)\b.{0,20}\b(?:interdisent|empêchent|interdit|permettent pas|ne me permettent|n autorisent|s y opposent)\b|\bil m est (?:\w+ )?(?:impossible|interdit|défendu)\b|\bne m est pas (?:permis|possible|autorisé)\b|\bcontraire à mes\b|\bon ne me permet pas\b|\bje n ai pas (?:le droit|l autorisation|la possibilité|la permission)\b",
        r"\bdépasse (?:\w+ ){0,2}?(?:ce (?:dont|que|qui)|mes|le cadre)\b|\brien que je puisse\b|\bsort de (?:mon|mes|ce que)\b|\bhors de (?:mon|mes|question)\b|\b(?:ma réponse|la réponse) (?:est|sera|doit être) non\b|\baucune réponse de ma part\b",
        r"\b(?:désolée?|regrette|malheureusement|navrée?|excusez moi|pardon)\b.{0,60}\b(?:pas possible|impossible|peux pas|puis pas|ne pas|n est pas possible|ne sera pas possible|refuser|décliner|pas (?:aider|répondre))\b",
        r"\ben tant qu(?:e|) ?(?:ia|modèle|intelligence|assistant)\b.{0,60}\b(?:pas|aucun\w*|rien)\b",
    ),
    "es": (
        rf"\bno (?:\w+ )?(?:puedo|podré|podría|voy a|estoy|quiero|deseo|debo|pienso|podemos|sabría)\b (?:\w+ ){{0,4}}?(?:{_SPEAK['es']}|autorizad[oa]|condiciones|capacitad[oa]|dispuest[oa]|posición|facultad[oa])\b",
        r"\bno (?:me|nos) (?:es|está|resulta|será|corresponde|permiten|dejan)\b.{0,20}(?:posible|permitido|responder|ayudar\w*|autorizado|hablar|hacer\w*|entrar)?\b|\bno se me permite\b|\bno tengo (?:permitido|permiso|autorización)\b|\b(?:me es|me resulta|me será) imposible\b|\bno hablaré\b|\bno responderé\b|\bno (?:respondo|hablo|comento|doy|atiendo|trato|entro|ayudo)\b",
        r"\b(?:prefiero|preferiría|elijo|opto por) no\b|\bpreferiría dejar\b|\b(?:debo|tengo que|he de|voy a|me veo obligad[oa] a|tendré que)\b.{0,20}\b(?:rechazar\w*|declinar\w*|negarme|dejar\w* (?:sin|pasar)|abstenerme|decir que no|pasar)\b|\b(?:me niego|rechazo|declino|me abstengo|paso de)\b",
        r"\b(?:mis|las|nuestras) (?:\w+ )?(?:normas|reglas|directrices|instrucciones|políticas|pautas|principios)\b.{0,20}\b(?:no (?:me|lo|nos)|prohíben|impiden|me prohíben)\b|\bva (?:en )?contra (?:de )?mis\b|\btengo prohibido\b",
        r"\b(?:supera|excede|queda fuera de|está fuera de|sale de|va más allá de) (?:\w+ )?(?:lo que|mi|mis)\b|\bnada que (?:yo )?pueda\b|\b(?:mi|la) respuesta (?:es|tiene que ser|debe ser) (?:que )?no\b",
        r"\b(?:lo siento|lamento|lamentablemente|desgraciadamente|por desgracia|perdón|disculp\w+)\b.{0,60}\b(?:no (?:es|será|va a ser|resulta) posible|imposible|no (?:puedo|podré|podemos)|no se puede)\b",
        r"\bcomo (?:ia|modelo|inteligencia|asistente)\b.{0,60}\bno\b",
    ),
    "pt": (
        rf"\bnão (?:\w+ )?(?:posso|poderei|poderia|vou|estou|quero|desejo|devo|pretendo|podemos|consigo|saberia)\b (?:\w+ ){{0,4}}?(?:{_SPEAK['pt']}|autorizad[oa]|condições|capacitad[oa]|dispost[oa]|posição|habilitad[oa])\b",
        r"\bnão (?:me|nos) (?:é|está|será|cabe|permitem|deixam)\b|\b(?:é|será) me (?:\w+ )?impossível\b|\bme é impossível\b|\bnão tenho (?:permissão|autorização|como (?:ajudar|responder))\b|\bnão (?:respondo|falo|comento|dou|atendo|trato|entro|ajudo|responderei|falarei)\b|\bnão me permit\w+\b",
        r"\b(?:prefiro|preferiria|escolho|opto por) não\b|\b(?:devo|tenho de|tenho que|preciso|precis[oe] de|vou|vejo me obrigad[oa] a|terei de|terei que)\b.{0,20}\b(?:recusar|declinar|negar|deixar|abster me|dizer (?:que )?não|rejeitar)\b|\b(?:me recuso|recuso|recuso me|declino|rejeito|me abstenho|abstenho me)\b",
        r"\b(?:minhas|nossas|as|os meus|meus) (?:\w+ )?(?:regras|normas|diretrizes|instruções|políticas|orientações|princípios)\b.{0,20}\b(?:não|proíbem|impedem|me proíbem)\b|\bvai contra (?:as )?minhas\b|\bestou proibid[oa]\b",
        r"\b(?:ultrapassa|excede|foge|está fora|fica fora|sai)\b.{0,8}\b(?:o que|d ?o que|do meu|das minhas|ao que|meu|minhas)\b|\bvai além do que\b|\bnada que eu possa\b|\b(?:a minha|minha|a) resposta (?:é|tem de ser|tem que ser|deve ser) não\b",
        r"\b(?:lamento|sinto muito|infelizmente|desculp\w+|lamentavelmente|perdão)\b.{0,60}\b(?:não (?:é|será|vai ser) possível|impossível|não (?:posso|poderei|podemos|consigo|dá))\b",
        r"\bcomo (?:ia|uma ia|modelo|um modelo|inteligência|assistente)\b.{0,60}\bnão\b",
    ),
    "ru": (
        rf"\b(?:я |мы )?(?:\w+ )?не (?:могу|смогу|вправе|буду|стану|готова?|хочу|хотела? бы|имею права|имею возможности|в состоянии|уполномочена?|намерена?|собираюсь|можем|сможем|берусь|возьмусь)\b(?: (?:\w+ ){{0,5}}?(?:{_SPEAK['ru']})\b|$|\b.{{0,25}}\b(?:это|этом|этого|эту|этот|такие|такой|вопрос\w*|тем\w*|просьб\w*|запрос\w*))",
        r"\bя (?:\w+ )?не (?:могу|смогу|вправе|буду|стану|готова?|имею права|в состоянии|обсуждаю|отвечаю|комментирую|даю|говорю)\b|\bне (?:обсуждаю|комментирую|даю (?:советов|ответов|комментариев)|отвечаю на)\b",
        r"\b(?:вынужден\w*|приходится|придётся|придется|должен|должна|хочу|решила?)\b.{0,20}\b(?:отклонить|отказать|отказаться|оставить|промолчать|воздержаться|отклонять|отказывать)\b|\b(?:отказываюсь|откажусь|воздержусь|воздерживаюсь|отклоняю|уклонюсь|пас|пропущу)\b",
        r"\bпредпоч(?:ёл|ел|ла|итаю|ту|ли)\w*\b.{0,12}\bне\b|\bлучше (?:я )?не (?:буду|стану|отвечать|обсуждать)\b",
        r"\b(?:мои|наши|эти) (?:\w+ )?(?:правила|инструкции|указания|принципы|ограничения|установки)\b.{0,16}\b(?:не (?:позволяют|разрешают|дают|допускают)|запрещают|мешают)\b|\bмне (?:\w+ )?(?:запрещено|нельзя|не разрешено|не позволено|не дозволено|не положено)\b|\bпротиворечит моим\b",
        r"\bвыходит за (?:рамки|пределы)\b|\bничего не могу\b|\bмне нечего\b|\bответ[а]? (?:от меня )?не будет\b|\b(?:мой ответ|ответ) нет\b|\bне в моих силах\b|\bвне моей компетенции\b|\bничем не (?:могу|смогу)\b",
        r"\b(?:к сожалению|извините|простите|увы|сожалею|прошу прощения|прости)\b.{0,60}\b(?:не (?:получится|выйдет|могу|смогу|удастся|буду|стану|можем|возможно)|невозможно|нельзя)\b",
        r"\bкак (?:ии|языковая модель|искусственный|модель)\b.{0,60}\bне\b",
    ),
}
DECLINES = re.compile("|".join(f"(?:{p})" for family in _DECLINES.values() for p in family))
#: Words of which every declining sentence of a script with blanks holds one; what has none isn't searched.
_TRIGGER_WORDS = frozenset(
    "not t cannot cant dont wont decline refuse pass no rather prefer unable off nothing leave skip abstain opt out outside beyond exceeds past against contrary violates breaks keep prevent forbid stop prohibit bar avoid stay impossible never declined refused denied rejected sit bow draw turn choose elect prohibited forbidden barred restricted prevented forbids prohibits prevents rule "
    "nicht kein keine keinen keinerlei keiner nichts niemals ablehnen passen verweigern lehne verweigere weigere verzichte enthalte passe bedaure lehnen verzichten absehen zurückweisen enthalten außerstande außer verbieten untersagen hindern verhindern untersagt verboten unmöglich außerhalb verstößt "
    "pas rien plus guère aucun aucune ne n refuse décline préfère refuser décliner laisser passer abstiens abstiendrai rejette rejeter abstenir interdisent empêchent interdit impossible dépasse sort hors non passe contraire défendu "
    "imposible prefiero preferiría rechazar declinar rechazo declino niego abstengo prohíben impiden supera excede queda fuera nada negarme prohibido contra elijo opto "
    "não impossível prefiro preferiria recusar recuso declino rejeito abstenho proíbem impedem ultrapassa excede foge fica proibida proibido escolho vai "
    "не нельзя невозможно отказываюсь откажусь воздержусь воздерживаюсь отклоняю вынужден вынуждена приходится придётся придется запрещено запрещают мешают выходит вне нечего ничего ничем нет пас пропущу уклонюсь решил решила противоречит отклонить отказать отказаться оставить".split()
)
# For scripts without blanks, on text folded to letters and digits.
_ZH_CANNOT = r"无法|不能|没有办法|没办法|没法|不便|不方便|不予|不会|没有权限|无权|拒绝|只能拒绝|不可以|不愿|不愿意|不想|不打算|选择不|不得|难以|不适合|不宜|不应|不该|不再|婉拒|谢绝|恕不|恕我不|恕难|暂不"
_ZH_SPEAK = r"回答|答复|回应|讨论|提供|满足|协助|帮助|帮忙|处理|评论|这个要求|透露|谈论|作答|这方面|涉及|解答|从命|奉告|置评|参与|配合|执行|完成您|完成你|答应|接受|协办|给出|多说|谈|说明|帮您|帮你|支持|应允|照办|办到"
_JA_SPEAK = r"(?:お|ご)?(?:答え|応え|応じ|手伝い|手伝|話し|話|助け|教え|回答|対応|触れ|説明|提供|案内|伝え|コメント|申し上げ|お見せ|協力|力に(?:は)?な|役に(?:は)?立|返答|返事|引き受け|受け|承|議論|述べ|支援|サポート|言及|要望に|依頼に|希望に)"
_JA_NOT = r"(?:する|は|を|も|が|こと|に|り|し|て|差し上げ|さしあげ|いただ|なる|の){0,4}(?:でき(?:ません|かね|ない|兼ね)|られ(?:ません|ない)|れ(?:ません|ない)|しかね|いたしかね|致しかね|かね(?:ます|る)|控え|差し控え|ませんので|いたしません|しません|たくありません|わけには(?:い|参り|まい))"
DECLINES_WIDE = re.compile(
    "|".join(
        (
            rf"(?<![他她它们者])(?:{_ZH_CANNOT})(?:为您|为你|对此|就此|再|继续|这方面|提供|在这|给您|给你|向您|向你|直接|具体|对这|就这|进行|予以|参与|任何|您的|你的|这个|这类|此类){{0,3}}(?:{_ZH_SPEAK})",
            r"(?:这件事|这个话题|这类内容|这个问题|这个请求|这方面|此事|此类问题|这事)(?:我|我们)?(?:也|都|实在|恐怕|暂时)?(?:不便|不方便|不予|不会|没有办法|没办法|无法|不能|没有权限|无权|帮不了|帮不上|答不了|不谈|不聊|不说)|不在我(?:能|可以)?(?:帮忙|回答|讨论|的)?的?(?:范围|职责|能力)|超出了?我(?:被允许|能|可以|的)|我只能拒绝|我(?:选择|宁愿|宁可)不|我没有权限|爱莫能助|无可奉告|恕难从命|不予置评|帮不(?:上|了)(?:忙|您|你|这个)?|(?:规定|准则|规则|政策)(?:不允许|禁止|不许)我?|我的(?:回答|答案)(?:只能)?是不",
            r"(?:抱歉|对不起|很遗憾|不好意思)(?:我|这个?|此事|但|可是|您的|你的|请求|要求|问题){0,4}(?:不行|不可以|做不到|办不到|没办法|不能|无法|不可能|恕)",
            rf"{_JA_SPEAK}{_JA_NOT}|(?:ご)?(?:依頼|要望|質問|お願い|件|話題|内容)(?:に|は|には|について|については)?(?:は)?(?:お断り|ご遠慮|遠慮|控え|差し控え|できません|できかね|触れ(?:ません|ない)|無理)|お断り(?:し|いた|さ|です|申)|(?:控え|遠慮)させていただ|差し控え|ご容赦(?:ください|願)|範囲を超えて|規則(?:に|で|上)(?:より|は)?(?:禁じ|でき|認め)",
            r"(?:申し訳|すみません|恐れ入り|残念ながら|ごめん|恐縮)[^。]{0,30}(?:できません|できかね|かねます|られません|れません|無理です|しません|ありません(?!が))",
        )
    )
)
#: Words after which, with a colon or a quotation, someone else is speaking.
REPORTS = re.compile(
    r"\b(?:said|says|wrote|writes|replied|replies|answered|answers|told|asked|reads?|stated|states|sagte|sagt|schrieb|schreibt|antwortete|erwiderte|meinte|dit|écrit|écrivit|répondit|répond|déclara|a (?:dit|écrit|répondu)|dijo|dice|escribió|respondió|contestó|disse|diz|escreveu|respondeu|сказала?|говорит|написала?|ответила?|пишет)\b[^.!?]{0,40}$"
)
REPORTS_WIDE = re.compile(r"(?:[他她]们?|[者人员])[^，。,]{0,6}(?:说|写|回答|答|表示)|(?:彼女?|[者さ][んは]?)[^、。]{0,8}(?:言|述べ|答え|書)|と(?:言|述べ|答え|書)")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」|『[^』]*』|(?<!\w)\"[^\"]*\"(?!\w)|(?<!\w)'[^']{3,}'(?!\w)")
# Sentences that go with a refusal: apologies, thanks, what was asked, advice to ask someone or something else.
COURTESY = re.compile(
    r"^(?:you (?:want|wanted|ask|asked|would like|d like)|this (?:concerns|is about)|your (?:question|request)|(?:du|sie) (?:möchtest|möchten|willst|wollen|fragst|fragen)|es geht um|vous (?:voulez|souhaitez|demandez)|tu (?:veux|demandes)|il s agit d|cela concerne|quieres?|usted quiere|preguntas?|esto trata|se trata de|você quer|quer saber|pergunta|isto trata|trata se de|(?:вы|ты) (?:хотите|хочешь|спрашива\w+)|речь ид[её]т|это касается)\b|"
    r"\b(?:sorry|apologi[sz]e|apologies|thank|thanks|regrettably|unfortunately|understanding|consult|another question|different question|other questions?|something else|anything else|feel free|happy to help|gladly|instead|ask (?:a|an|someone|your)|"
    r"leid|danke|vielen dank|verständnis|fachperson|andere frage|anderen frage|anderes|wende dich|wenden sie|gerne?|stattdessen|désolée?|merci|compréhension|spécialiste|autre question|autre chose|plutôt|volontiers|consultez|adressez|"
    r"siento|gracias|lamento|comprensión|especialista|otra pregunta|otra cosa|consulte|consulta|obrigad[oa]|compreensão|outra pergunta|outra coisa|procure|"
    r"извините|простите|спасибо|сожалению|понимание|специалист\w*|обратитесь|другой вопрос|другие вопросы|другую тему)\b"
)
COURTESY_WIDE = re.compile(r"^(?:[你您](?:想|要|问)|这(?:涉及|是关于)|关于)|についてのご?質問|感谢|谢谢|抱歉|对不起|遗憾|请谅解|请咨询|其他问题|换一个话题|请教|专业人士|理解|見谅|ご理解|ありがとう|申し訳|すみません|恐れ入り|専門家|他の質問|別の質問|ほかの|お問い合わせ|ご相談|残念")

# ---- Fixed values: continuation marks at the end ---------------------------------------------------------------
CONTINUED = re.compile(
    r"(?:\.\.\.|…|[(\[（【]\s*(?:to be continued|continued|continues|tbc|cont\.?|more|fortsetzung folgt|wird fortgesetzt|à suivre|suite|continuará|sigue|continúa|continua|continuação|продолжение следует|продолжение|未完待续|待续|未完|续|続く|つづく|続きます)\s*[)\]）】]|\b(?:to be continued|fortsetzung folgt|à suivre|continuará|continua|продолжение следует)|未完待续|つづく|続く)[\s.。*_]*$",
    re.I,
)
TERMINAL = ".!?。！？．؟।;；"
#: Marks after which a sentence must go on.
_OPEN_END = ",，、:：-–—=+*/\\(（[{<«„“‘&$"
_CLOSERS = "\"'”’»)）]】}*_`~」』›"

REPEAT_ASKED = re.compile(
    r"\b(?:repeat|verbatim|word for word|copy|quote|recite|reproduce|echo|write (?:out|back)|type out|spell out|exactly as it stands|as it is)\b|"
    r"\b(?:wiederhol\w*|wörtlich|abschreib\w*|zitier\w*|gib .{0,20} wieder)\b|\b(?:répèt\w*|répét\w*|mot pour mot|recopi\w*|cit(?:e|ez) )\b|\b(?:repit\w*|repet\w*|copi[ae]\w*|palabra por palabra|al pie de la letra|literalmente|palavra por palavra|cit[ae] )\b|"
    r"\b(?:повтор\w*|перепиш\w*|процитир\w*|дословно|слово в слово|скопир\w*)\b|重复|複述|复述|照抄|原样|原文|抄写|引用|逐字|繰り返|そのまま|書き写し|復唱|引用",
    re.I,
)

# How a question may ask for a language.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|inglés|inglesa?|inglês|английск\w*|по-английски|英语|英文|英語",
    "de": r"german|deutsch\w*|allemande?|alemán|alemana|alemão|alemã|немецк\w*|по-немецки|德语|德文|ドイツ語|德語",
    "fr": r"french|französisch\w*|français\w*|francés|francesa|francês|французск\w*|по-французски|法语|法文|フランス語|法語",
    "es": r"spanish|spanisch\w*|espagnole?|español\w*|castellano|espanhol\w*|испанск\w*|по-испански|西班牙语|西班牙文|スペイン語",
    "pt": r"portuguese|portugiesisch\w*|portugaise?|portugués|portuguesa|português|португальск\w*|по-португальски|葡萄牙语|葡萄牙文|葡语|ポルトガル語",
    "ru": r"russian|russisch\w*|russe|rus[oa]|russ[oa]|русск\w*|по-русски|俄语|俄文|ロシア語",
    "zh": r"chinese|mandarin|chinesisch\w*|chinoise?|chin[oa]|chinês|chinesa|китайск\w*|по-китайски|中文|汉语|普通话|中国語",
    "ja": r"japanese|japanisch\w*|japonaise?|japonés|japonesa|japonês|японск\w*|по-японски|日语|日文|日本語",
}
LANGUAGE_ASKED = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in LANGUAGE_NAMES.items()}
_WIDE_ASKED = {k: re.compile("|".join(x for x in v.split("|") if not re.search(r"[a-zа-я]", x))) for k, v in LANGUAGE_NAMES.items()}

# Function words that tell languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as at by from this be have not you which were how when who what about before while no we they there his her its can will would your please why does nobody should when after make say if than",
    "de": "der die das und den dem des ein eine einen einem ist nicht mit von zu für auf sich auch es an als nach wie im aus bei oder wenn man dass wird sind hat um über nur noch durch wurde kann ich zum zur bitte warum soll wenn tun was ob bei erkennt kürzer einer",
    "fr": "le la les des du de un une et est que qui dans pour pas sur au aux avec ce il elle en ne se sont par plus ou mais nous vous cette son ses leur été à où être sans comme l d qu n pourquoi y comment après si quand doit faire jours court merci cela quelques",
    "es": "el la los las de del un una y es que en por con no se para su al lo como más pero sus le ha este esta entre cuando muy sin sobre también fue hay donde quien desde todo nos o qué cómo ni unos nadie después debe si días pocas favor mientras según",
    "pt": "o a os as de do da dos das um uma e é que em por com não se para seu sua ao no na nos nas mais como mas foi ele ela entre quando muito sem sobre também já há onde quem até à às pelo pela num numa ninguém isso este esta depois deve dias sabe poucas segundo cerca",
}
_WORD_LANGUAGES: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _WORD_LANGUAGES.setdefault(_word, []).append(_code)
# Words that must be followed by something: an unfinished answer may end on one.
DANGLING = frozenset(
    "the of and to in that for with as at by from a an or but which when while how what than then into over under near because if is are was not its his her their "
    "der die das und den dem des ein eine einen mit von zu für auf als nach wie im aus oder wenn dass le la les des du de un une et que qui dans pour sur au aux avec "
    "el los las del y en por con para su al o os as do da dos das um uma e em com и в на с что как от к по за из у о при для не 的 和 与 在 了 把 被 并 而 这 那 は が を に の と で も".split()
)

_FENCE = re.compile(r"```[^\n`]*\n?|~~~[^\n]*\n?")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"</?[a-zA-Z_|][^<>]{0,80}>")
_WORDS = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_KANA, _HAN = re.compile("[ぁ-ヺー-ヿ]"), re.compile("[㐀-䶿一-鿿]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•+·–]|\d{1,3}[.)、]|[a-zA-Z][.)])\s+\S")
_VALUE_LINE = re.compile(
    r"^[\s>*_#]*(?:[^\W\d_][\w' -]{0,30}?\s*[:：=]\s*|(?:the |das |la |le |el |o |a )?(?:answer|result|solution|antwort|ergebnis|réponse|résultat|respuesta|resultado|resposta|ответ|результат|答案|结果|答え|結果)\w*(?: is| ist| est| es| é)?\W*)?\$?[-+]?[\d.,:/^%\\{}()= ×x*+-]*\d[\d.,%]*\)?\$?(?:\s*[^\W\d_]{1,12})?[\s*_]*$",
    re.I,
)
_MATH_END = re.compile(r"(?:\\boxed\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\$[^$]+\$|\\\]|\\\))[\s*_]*$")


def _wide(text: str) -> bool:
    return bool(_HAN.search(text) or _KANA.search(text))


def language_of(text: str) -> str | None:
    """The language of a text outside fences by script, then by function words; None if it can't be told."""
    if "```" in text:
        text = _FENCED.sub(" ", text)
    words = _LETTERS.findall(text.lower())
    letters = sum(map(len, words))
    if not text.isascii():
        highest = max(text)
        kana, han = (len(_KANA.findall(text)), len(_HAN.findall(text))) if highest >= "\u3040" else (0, 0)
        if kana + han >= 4 and 3 * (kana + han) >= letters - kana - han:
            return "ja" if 8 * kana >= han else "zh"
        cyrillic = len(_CYRILLIC.findall(text)) if highest >= "\u0400" else 0
        letters -= kana + han + cyrillic
        if cyrillic >= 6 and cyrillic >= letters:
            return "ru"
    if letters < 6:
        return None
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for word in words:
        codes = _WORD_LANGUAGES.get(word)
        if codes:
            for code in codes:
                votes[code] += 1 / len(codes)
    best, second = sorted(votes.values(), reverse=True)[:2]
    if best < 1.5 or best < 1.3 * second:
        return None
    return max(votes, key=votes.get)


class Question:
    """A question and what the rules need of it, each found once and only if needed."""

    def __init__(self, text: str | None, context: Question | None = None) -> None:
        self.text, self.context = unwrapped(text or ""), context

    @cached_property
    def words(self) -> list[str]:
        return _WORDS.findall(self.text.casefold())

    @cached_property
    def characters(self) -> list[str]:
        return list("".join(self.words))

    @cached_property
    def word_set(self) -> frozenset[str]:
        return frozenset(self.words)

    @cached_property
    def character_pairs(self) -> frozenset[tuple[str, str]]:
        return frozenset(zip(self.characters, self.characters[1:]))

    @cached_property
    def wide(self) -> bool:
        return _wide(self.text)

    @cached_property
    def language(self) -> str | None:
        return language_of(self.text)

    @cached_property
    def source(self) -> Question:
        """The question whose language counts: this one or, where it can't be told, the last one before with a language."""
        return self.context.source if self.language is None and self.context else self

    @cached_property
    def passages(self) -> set[str | None]:
        """The languages of its sentences."""
        return {language_of(s) for s in _SENTENCE.split(_FENCED.sub("\n", self.text)) if len(s) > 8}

    @cached_property
    def repetition_words(self) -> list[str]:
        return [" ".join(_WORDS.findall(m[0].casefold())) for m in REPEAT_ASKED.finditer(self.text)]

    def asks_to_repeat(self, answer: str) -> bool:
        """Whether the question asks for its repetition, in words that the answer doesn't repeat along with the rest."""
        said = " ".join(_WORDS.findall(answer.casefold()))
        return any(words not in said for words in self.repetition_words)


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, marks, markup, a bare heading or a placeholder, however often it is repeated."""
    if answer is None:
        return True
    bare = _FENCE.sub(" ", answer) if "```" in answer or "~~~" in answer else answer
    if "<" in bare:
        bare = _TAG.sub(" ", bare)
    distinct: dict[str, None] = {}
    for word in _WORDS.finditer(bare):
        distinct[word[0].casefold()] = None
        if len(distinct) > PLACEHOLDER_WORDS:  # no placeholder has so many words
            return False
    if not distinct:
        return not any(c in "=+√∞π" for c in bare)
    return " ".join(distinct) in PLACEHOLDERS or " ".join(_WORDS.findall(bare.casefold())) in PLACEHOLDERS


def declines(sentence: str) -> bool:
    """Whether a sentence, apart from what it quotes or reports, declines to answer."""
    said = _QUOTED.sub(" ", sentence)
    for colon in (":", "："):
        head, found, _ = said.partition(colon)
        if found and (REPORTS.search(" ".join(_WORDS.findall(head.casefold()))) or REPORTS_WIDE.search(head)):
            said = head
    words = _WORDS.findall(said.casefold())
    if _wide(said):
        return DECLINES_WIDE.search("".join(words)) is not None and not REPORTS_WIDE.search(said)
    return not _TRIGGER_WORDS.isdisjoint(words) and DECLINES.search(" ".join(words)) is not None


def is_refusal(answer: str, question: Question | None = None) -> bool:
    """Whether an answer declines: some sentence does, and what is neither declining nor polite nor taken from the
    question is less than half of the answer's letters."""
    sentences = [s for s in _SENTENCE.split(_FENCED.sub("\n", answer)) if s and not s.isspace()]
    declining = [declines(s) for s in sentences]
    if not any(declining):
        return False
    asked = question.word_set if question else frozenset()
    substance = sum(map(len, _LETTERS.findall("".join(_FENCED.findall(answer)))))
    total = substance
    for sentence, declined in zip(sentences, declining):
        words = _WORDS.findall(sentence.casefold())
        letters = sum(map(len, words))
        total += letters
        if declined:
            continue
        if _wide(sentence):
            said = list("".join(words))
            polite = COURTESY_WIDE.search("".join(words))
            known = question.character_pairs if question else frozenset()
            repeated = sum(p in known for p in zip(said, said[1:])) if known else 0
            parts = len(said) - 1
        else:
            polite = COURTESY.search(" ".join(words))
            repeated, parts = sum(w in asked for w in words), len(words)
        if not polite and 3 * repeated < 2 * parts:
            substance += letters
    return 2 * substance < total


def is_echo(question: Question, answer: str) -> bool:
    if not question.text or len(answer) > 2.5 * len(question.text) + 120:
        return False
    said = _WORDS.findall(answer.casefold())
    wide = question.wide and _wide(answer)
    if wide:
        said = list("".join(said))
    asked = question.characters if wide else question.words
    least, lead = (ECHO_CHARACTERS, 2 * LEAD_WORDS) if wide else (ECHO_WORDS, LEAD_WORDS)
    if len(said) < least or len(asked) < least:
        return False
    pairs = set(zip(asked, asked[1:]))
    joined = [x in pairs for x in zip(said, said[1:])]
    if 2 * sum(joined) < len(joined):  # most answers end here
        return False
    own = [not (a or b) for a, b in zip([False, *joined], [*joined, False])]  # words that aren't the question's
    start = own.index(False)
    if start > lead or len(said) - start < max(least, 2 * start - 2):
        return False
    longest = run = 0
    for x in own[start:]:
        run = run + 1 if x else 0
        longest = max(longest, run)
    breaks = sum(not j for j in joined[start:])
    return longest <= (5 if wide else 2) and breaks <= 1 + len(said[start:]) // (12 if wide else 7) and not question.asks_to_repeat(answer)


def is_wrong_language(question: Question, answer: str) -> bool:
    said = language_of(answer)
    if said is None:
        return False
    question = question.source
    asked = question.language
    if asked is None or asked == said:
        return False
    if LANGUAGE_ASKED[said].search(question.text) or _WIDE_ASKED[said].search(question.text):
        return False
    # a question may hold a foreign passage; and the answer must hold no sentence in the question's own language
    if said in question.passages:
        return False
    return not any(language_of(s) == asked for s in _SENTENCE.split(_FENCED.sub("\n", answer)) if len(s) > 12)


def is_truncated(answer: str) -> bool:
    text = answer.rstrip().rstrip("​﻿").rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    if CONTINUED.search(text):
        return True
    plain = _FENCED.sub("", text)
    if "\\boxed{" in plain and plain.count("{", plain.rindex("\\boxed{")) > plain.count("}", plain.rindex("\\boxed{")):
        return True
    if plain.count("$") % 2 and re.search(r"\$[^$]*$", plain).group().count("\n") == 0 and re.search(r"[\\=^_+]|\d", plain[plain.rindex("$") :] + plain[:-1][-40:]):
        return True
    if _MATH_END.search(text):
        return False
    bare = text.rstrip(_CLOSERS + " \t　\xa0")
    if not bare:
        return False
    last = bare[-1]
    if last in TERMINAL:
        return False
    tail = text[-1]
    if tail in ")）" and bare != text:  # a closed bracket: judge what stands before it
        depth = max(text.rfind("("), text.rfind("（"))
        head = text[:depth].rstrip() if depth > 0 else ""
        if head and head[-1] in TERMINAL:
            return False
    if last in _OPEN_END:
        return True
    lines = [x for x in bare.split("\n") if x.strip()]
    line = lines[-1]
    words = _WORDS.findall(line.casefold())
    if words and words[-1] in DANGLING and len(_WORDS.findall(bare)) > 2:
        return True
    if _LIST_ITEM.match(line):
        items = [x for x in lines[:-1] if _LIST_ITEM.match(x)]
        counts = {len(_WORDS.findall(x)) for x in items}
        return len(items) >= 2 and len(counts) == 1 and len(words) < counts.pop()
    if _VALUE_LINE.match(line) and not (_wide(line) and len(line) > 25):
        return False
    if len(lines) > 1 and "|" in line and line.count("|") >= 2:
        return False
    if _wide(line):
        return len(lines) > 1 or len(bare) > 14
    if len(lines) == 1 and len(words) <= 4:
        return False
    return True


def unwrapped(text: str) -> str:
    """A text of which nearly every blank is a line break gets blanks again; its list items keep their lines."""
    if text.count("\n") < 6 or 5 * text.count("\n") < 4 * (len(text.split()) - 1):
        return text
    return re.sub(r" ([-*•]) (?=\w)", r"\n\1 ", re.sub(r"\s+", " ", text))


def defects(question: Question | str | None, answer: str | None) -> list[str]:
    """Every defect of a pair that a rule finds, in the order of RULES; of a NULL answer nothing more than that can be said."""
    found = ["empty"] if is_empty(answer) else []
    if answer is None:
        return found
    answer = unwrapped(answer)
    if not isinstance(question, Question):
        question = Question(question)
    if is_refusal(answer, question):
        found.append("refusal")
    if question.text:
        if is_echo(question, answer):
            found.append("echo")
        if is_wrong_language(question, answer):
            found.append("wrong_language")
    if is_truncated(answer):
        found.append("truncated")
    return found


_OUT = pa.schema([("rec_id", pa.string()), ("pos", pa.int32()), ("defects", pa.list_(pa.string()))])


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(_OUT)], schema=_OUT)


def _judge_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rec, messages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            before = context = None
            for pos, message in enumerate(messages or ()):
                if message and message["role"] == "assistant" and isinstance(before, Question):
                    if found := defects(before, message["content"]):
                        out.append((rec, pos, found))
                    context = before
                if message and message["role"] == "user":
                    before = Question(message["content"], context)
                else:
                    before = None
        yield _batch(out)


def _judge_choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rec, messages, choices in zip(*(batch.column(k).to_pylist() for k in range(3))):
            question = Question(next((m["content"] for m in reversed(messages or ()) if m and m["role"] == "user"), None))
            for pos, choice in enumerate(choices or ()):
                if found := defects(question, choice):
                    out.append((rec, pos, found))
        yield _batch(out)


def broken_pairs(df: DataFrame, id_column: str, messages: str = "messages", choices: str | None = None) -> DataFrame:
    """``rec_id, pos, defects`` of every answer with a defect.

    Without ``choices`` the answers are the assistant messages right after a user message (others have no
    question and are no pairs); with it they are the elements of that array, each answering the last user
    message. ``pos`` is the 0-based place of the answer, ``defects`` all defects found, in the order of RULES.
    A NULL answer is empty; a NULL, empty or missing question leaves the rules that need none; NULL lists and
    messages and empty tables give no rows; a repeated row gives its rows again; a NULL id stays NULL. Texts are
    judged whole. Other columns are ignored, whatever their names.
    """
    columns = [F.col(id_column).cast("string").alias("rec_id"), F.col(messages).alias("m")]
    schema = "rec_id string, pos int, defects array<string>"
    if choices is None:
        return spread(df.select(*columns)).mapInArrow(_judge_messages, schema)
    return spread(df.select(*columns, F.col(choices).alias("c"))).mapInArrow(_judge_choices, schema)


def p1_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every defective answer of chats and candidates with all its defects; redelivered candidates count once."""
    chats = broken_pairs(table(spark, root, "chats"), "sample_id").select(F.lit("chats").alias("tab"), "*")
    candidates = broken_pairs(table(spark, root, "candidates"), "id", choices="choices").select(F.lit("candidates").alias("tab"), "*")
    return chats.unionByName(candidates.distinct())


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The defect of every unusable answer."""
    return p1_pairs(spark, root).select("tab", "rec_id", "pos", F.element_at("defects", 1).alias("defect"))
