"""Problem 4: find defective question-answer pairs and name the defect.

Prompt and answer are compared as token sequences: an answer is a *copy* if the shingles of its tokens are
contained in the prompt and the longest common subsequence with the (repeated) prompt covers it. A *refusal*
is found by aligning the classes of an answer's tokens (speaker, negation, ability, act, lack, regret ...) with
refusal templates, in order and close together, sentence by sentence. What remains is compared by language and
looked at where it ends. Whether a last word is cut off is decided by how often it and longer words that start
with it stand inside texts, counted over all texts; that is the only shuffle, on words.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage, spread

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
SHINGLE = 2
CONTAINED = 0.8  # of the answer's shingles that the prompt must hold
COVERED = 0.9  # of the answer's tokens in the common subsequence
LEAST_COPY = 3  # tokens; a shorter answer may well name something that the question mentions
CUT_RATIO = 20  # a last word is cut off if some longer word is so many times as frequent inside texts
LEAST_COUNT = 3

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,60}>|<!--.*?-->", re.S)
# Placeholders, labels and words by which answers and languages are told.
PLACEHOLDERS = frozenset(
    "n a|na|none|null|nil|nan|todo|to do|tbd|tba|fixme|xxx|no answer|no answer given|no response|empty|blank|placeholder|undefined|unknown|answer|answer here|your answer here|insert answer here|insert answer|lorem ipsum|missing|not applicable|not available|"
    "keine antwort|leer|aucune réponse|pas de réponse|vide|sin respuesta|vacío|k a|s o|s r".split("|")
)
LABEL = re.compile(r"^\W*(?:question|q|frage|pregunta|prompt|user|the question(?: is| was)?|you ask(?:ed)?|query|die frage|la question|la pregunta)\s*[:：-]\s*", re.I)
STOP = {
    "en": "the a an of and to in is are was were be been has have had that this these those which with for from on at by as it its their they we our not than then when while after before because would could should will can may into over such each most what who how why where does do did yes no only",
    "de": "der die das den dem des ein eine einer eines einem einen und zu zum zur ist sind war waren wird werden hat haben nicht mit für auf aus bei nach von vom im am als auch noch nur dass weil wenn aber oder sich es sie wir ich ihr ihre sein seine diese dieser dieses wie was wer warum um bis durch über gegen keine kein schon sehr ja nein jetzt man welche werden",
    "fr": "le la les un une des du de et à au aux est sont était été a ont ne pas que qui dans pour par sur avec sans sous plus ce cette ces il elle ils elles nous vous je leur leurs son sa ses on mais ou où donc car si même être avoir fait oui non quelles quels pourquoi comment très parce dont",
    "es": "el la los las un una unos unas de del y a al en es son era fue ha han no que se con por para sin sobre más este esta estos estas su sus lo le les como pero o si porque cuando donde muy ya hay está están ser sí qué por quién cuál cuándo también entre hasta desde nos me",
}
_STOPS: dict[str, list[str]] = {}
for _lang, _words in STOP.items():
    for _w in dict.fromkeys(_words.split()):
        _STOPS.setdefault(_w, []).append(_lang)
_LETTERS = {"de": re.compile(r"[äöüß]|sch\b|ung\b|keit\b|ieren\b"), "fr": re.compile(r"[èêçœùûîô]|\b[cdjlmnqst]['’][a-zéèê]|eux\b|ée?s?\b|oir\b"), "es": re.compile(r"[ñ¿¡]|ción\b|[íóú]\w|ado\b|aron\b|amos\b"), "en": re.compile(r"ing\b|tion\b|ed\b|\bth|n't\b")}
#: Words after which no phrase or sentence ends.
OPEN_END = frozenset(
    "the a an of and to in is are was were be been has have had that this these those which with for from on at by as its their our than when while after before because would could should will can may into over such each whose or but if nor per via about between among under during without within through do does an your my his her whether although though since until unless where very more most less many much "
    "der die das den dem des ein eine einer eines einem einen und oder zu zum zur ist sind war mit für auf aus bei nach von vom im am als dass weil wenn aber sich wird werden hat haben durch über gegen um sowie ins zwischen ohne unter obwohl damit seine ihre diese dieser "
    "le la les un une des du de et ou à au aux est sont dans pour par sur avec sans sous que qui dont ce cette ces leur leurs son sa ses mais car si ainsi parce lorsque afin entre très chez "
    "el los las unos unas del y o a al en es son con por sin sobre este esta su sus lo como pero porque cuando según hacia desde hasta entre para e u muy más".split()
)
_SELF = "i me my myself i'm i'd i've i'll im ich mir mich mein je j moi me mon yo mí mi lamento siento puedo tengo dispongo debo podría sé conozco quiero"
_CLASSES = {
    "self": _SELF,
    "ai": "ai assistant model ki assistent sprachmodell modèle assistante asistente modelo",
    "sorry": "sorry apologies apologize apologise afraid unfortunately regret regrettably leider leid bedaure bedauere tut désolé désolée malheureusement regrette excusez lamento siento lamentablemente desgraciadamente disculpa disculpe perdón",
    "neg": "not no cannot can't won't couldn't don't isn't unable never nothing neither nicht kein keine keinen nichts ne pas n aucun aucune rien no ningún ninguna nada incapable außerstande incapaz impossible unmöglich imposible without doesn't wouldn't aren't haven't lack",
    "able": "can able possible allowed permitted comfortable position willing capable authorised authorized kann können könnte möglich lage darf peux puis pouvoir possible capable mesure puedo podría posible capaz permitido supposed",
    "act": "answer answering help assist say provide discuss determine tell comment respond share know address give offer confirm speculate find see access beantworten antworten sagen helfen wissen angeben geben auskunft répondre dire aider fournir donner savoir réponse contestar responder ayudar decir proporcionar dar saber respuesta do reply cover",
    "have": "have has find see habe haben finde liegen ai avez trouve dispose tengo dispongo encuentro hay was given",
    "lack": "information access context details enough data knowledge way sufficient informationen zugriff zugang angaben kontext accès informations information données suffisamment contexte acceso información datos suficiente suficientes contexto permission",
    "decline": "decline refuse must ablehnen verweigern muss refuser dois refuse rechazar negarme debo decline refrain abstain pass",
    "outside": "outside beyond scope against guidelines policy policies außerhalb hors dehors fuera alcance richtlinien normas",
    "q": "question request topic frage anfrage question demande pregunta solicitud petición",
}
_CLASS: dict[str, list[str]] = {}
for _c, _words in _CLASSES.items():
    for _w in dict.fromkeys(_words.split()):
        _CLASS.setdefault(_w, []).append(_c)
#: Refusals as classes in order; each ends within REACH tokens of its start.
TEMPLATES = tuple(
    tuple(t.split())
    for t in (
        "sorry self neg act", "sorry self neg able", "self neg able act", "self neg act", "neg able self act", "self neg have lack", "self have neg lack", "self neg lack act", "neg lack self act", "neg able act self", "self neg able act q", "q self neg act", "q able self neg act",
        "sorry self decline act", "self decline act", "sorry neg self act", "sorry neg act", "ai self neg", "self ai neg", "ai neg lack", "ai self neg lack", "outside self able", "q outside self", "sorry q outside", "self neg able", "neg self act", "neg able q act", "q neg able act", "able self neg act", "sorry outside self", "self neg sorry act", "neg lack q act", "self ai sorry",
        "neg have lack act", "sorry act neg self", "sorry neg able",
    )
)
_WANTS = tuple(map(frozenset, TEMPLATES))
REACH = 16
#: Self and ability in one word, of languages without a pronoun.
_SELF_ABLE = frozenset("puedo podría tengo dispongo lamento siento sé".split())


def clean(answer: str) -> str:
    """The answer without its answer tags, other markup and invisible signs."""
    text = html.unescape(answer)
    text = _TAG.sub(" ", text)
    return re.sub(r"[​-‏⁠﻿­]", "", text).strip()


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def question_of(prompt: str) -> str:
    """Of a prompt with instructions around it, the lines that ask; else all of it."""
    asking = [x for x in prompt.split("\n") if "?" in x]
    return "\n".join(asking) if asking else prompt


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """Whether the answer says nothing beyond the prompt: its shingles are the prompt's and so is its order of tokens."""
    if not answer or not prompt:
        return False
    if len(answer) < LEAST_COPY:
        return answer == prompt
    known = set(prompt)
    last_cut = answer[-1] not in known and any(w.startswith(answer[-1]) for w in known)
    body = answer[:-1] if last_cut else answer
    if len(body) < LEAST_COPY or not known.issuperset(body):
        return False
    again = prompt + prompt[: SHINGLE - 1] if len(body) > len(prompt) else prompt  # over the seam, where it is said more than once
    have = {tuple(again[i : i + SHINGLE]) for i in range(len(prompt))}
    own = [tuple(body[i : i + SHINGLE]) for i in range(len(body) - SHINGLE + 1)]
    if sum(s in have for s in own) < CONTAINED * len(own):
        return False
    times = -(-len(body) // len(prompt)) + 1
    return lcs(body, prompt * times) >= COVERED * len(body)


@functools.lru_cache(maxsize=20_000)
def _asked(prompt: str) -> tuple[str, list[str], list[str], str | None]:
    """Of a prompt: its question, the tokens of that and of all of it, and its language; kept, as prompts repeat themselves."""
    text = clean(prompt)
    question = question_of(text)
    asks = tokens(question)
    return question, asks, asks if question == text else tokens(text), language(question)


def without_echo(text: str, want: list[str]) -> str:
    """The answer after a repetition of its question, if it starts with one; the text itself otherwise."""
    body = LABEL.sub("", text, count=1)
    found = list(WORD.finditer(body))
    if want and len(found) > len(want) and [m.group().lower().replace("’", "'") for m in found[: len(want)]] == want:
        return body[found[len(want) - 1].end() :].lstrip(" ?:.!\"'”»\n\t-–—")
    return text


def is_refusal(text: str) -> bool:
    """Aligns each sentence with the templates."""
    for sentence in re.split(r"(?<=[.!?])\s+|\n+|;|(?<!\w)--(?!\w)|\s[–—]\s", text):
        words = [p for w in tokens(sentence) for p in (w.split("'") if w[:2] in ("j'", "n'", "d'", "l'", "c'", "m'") else [w])]
        classes = [frozenset(_CLASS.get(w, ())) | ({"self", "able"} if w in _SELF_ABLE else set()) for w in words]
        spoken = any("self" in c or "ai" in c for c in classes) or bool(re.match(r"(?i)\W*(?:sorry|apolog|unfortunately|leider|malheureusement|lo siento|désol)", sentence))
        impersonal = re.match(r"(?i)\W*(?:it is|it's|it isn't|there is|es ist|il (?:est|n'est|m'est)|no es|no hay|das kann|dazu|diese frage|this (?:question|request)|that is|die frage|cette question|esta pregunta)", sentence)
        if not spoken and not impersonal:
            continue
        present = frozenset().union(*classes)
        for t, wants in zip(TEMPLATES, _WANTS, strict=True):
            if not wants <= present:
                continue
            if not spoken and "self" in t:
                continue
            if not spoken and not (set(t) & {"q", "outside", "lack", "able"}):
                continue
            if _aligned(classes, t):
                return True
    return False


def _aligned(classes: list[frozenset[str]], template: tuple[str, ...]) -> bool:
    """Whether the template's classes stand in order on different tokens within REACH of each other."""
    for start, c in enumerate(classes):
        if template[0] not in c:
            continue
        k = 1
        for other in classes[start + 1 : start + REACH]:
            if k == len(template):
                break
            if template[k] in other:
                k += 1
        if k == len(template):
            return True
    return False


def language(text: str) -> str | None:
    """en, de, fr or es, if the words tell clearly; quoted parts are not asked."""
    text = re.sub(r'"[^"]{0,80}"|“[^”]{0,80}”|«[^»]{0,80}»', " ", text.lower())
    score = dict.fromkeys(STOP, 0.0)
    for w in WORD.findall(text):
        for lang in _STOPS.get(w, ()):
            score[lang] += 1 / len(_STOPS[w])
    for lang, p in _LETTERS.items():
        score[lang] += 0.6 * min(len(p.findall(text)), 6)
    (best, most), (_, next_) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best if most >= 1 and most >= 1.8 * next_ else None


def ends_open(text: str) -> bool:
    """Whether the text stops where no phrase does: after a word or a sign that needs more, or without its last sentence's end."""
    end = text.rstrip()
    if not end:
        return False
    if re.search(r"[,:;(\[{–—-]$|[,;:]\s*[\"“«'(]$|\s[\"“«'(]$", end):
        return True
    closed = re.search(r"[.!?…。！？][\"'”’»)\]]*$", end)
    last = WORD.findall(end)
    if not last:
        return False
    if end.endswith(("...", "…")) and len(last) > 3:
        return True
    if not closed:
        if last[-1].lower() in OPEN_END and len(last) > 1 and end[-1].isalnum():
            return True
        plain = re.sub(r"\b(?:al|e\.g|i\.e|etc|cf|vs|Fig|Sect|Sec|Eq|Tab|No|pp?|approx|z\.B|d\.h|bzw|ca|Nr|Dr|Mr|Ms|St|ej|p\.\s?ej|art)\.", " ", end)
        if re.search(r"[a-zà-ÿß0-9)%\"”»]{2,}[.!?]\s+[A-ZÀ-Ý¿¡\"“«(]", plain):
            return True
    return end.count("(") > end.count(")") and not closed


def judge(prompt: str | None, answer: str | None) -> tuple[str | None, str | None]:
    """(defect or null, last word if only the word counts can tell whether it is cut off)."""
    text = clean(answer) if answer else ""
    words = tokens(text)
    if not words or " ".join(re.findall(r"\w+", text.lower())) in PLACEHOLDERS:
        return "empty", None
    _, asks, whole, asked = _asked(prompt or "")
    said = without_echo(text, asks)
    if is_refusal(said):
        return "refusal", None
    bare = tokens(LABEL.sub("", text, count=1))
    if is_copy(asks, bare) or whole is not asks and is_copy(whole, bare):
        return "copy", None
    told = language(said) if asked else None
    if told and asked != told:
        return "language", None
    if ends_open(said):
        return "truncated", None
    last = re.search(r"([^\W\d_]{2,})\W{0,2}$", said)
    cut = last and not re.search(r"[.!?…]\W*$", said) and len(tokens(said)) > 1
    return None, last.group(1).lower() if cut else None


def defects(df: DataFrame, keys: list[str], prompt: str, answer: str, corpus: DataFrame, corpus_text: str) -> DataFrame:
    """(keys, defect): one row a defective pair. ``corpus`` holds the texts whose words are counted.

    Null and blank answers are empty; a null or blank prompt can neither be copied nor differ in language.
    """
    schema = df.select(*keys).schema.add("defect", "string").add("last_word", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            found = [judge(p, a) for p, a in zip(column(prompt).to_pylist(), column(answer).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(column, keys), pa.array([d for d, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], names=[*keys, "defect", "last_word"])

    judged = cut_lineage(spread(df.select(*keys, prompt, answer)).mapInArrow(run, schema))  # read twice below
    # How often words stand inside texts: all words but each text's last.
    inside = F.regexp_extract_all(F.lower(F.regexp_replace(corpus_text, r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*$", "")), F.lit(r"\p{L}{2,40}"), F.lit(0))
    counts = corpus.select(F.explode(inside).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    asked = judged.where("last_word is not null").select(F.col("last_word").alias("begin")).distinct()
    longer = (
        counts.select("n", F.explode(F.transform(F.sequence(F.lit(2), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("begin"))
        .where(F.length("begin") >= 2).groupBy("begin").agg(F.max("n").alias("longer"))
    )
    cut = (
        asked.join(longer, "begin").join(counts.withColumnRenamed("word", "begin"), "begin", "left")
        .where(F.col("longer") > CUT_RATIO * F.coalesce("n", F.lit(0))).select(F.col("begin").alias("last_word"), F.lit(True).alias("cut"))
    )
    defect = F.coalesce("defect", F.when(F.col("cut"), F.lit("truncated")))
    # Most pairs have no word to look up; they are spread over the join instead of meeting in one task.
    apart = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("string"))
    rows = judged.withColumn("__at", F.coalesce("last_word", apart))
    return rows.join(cut.withColumnRenamed("last_word", "__at"), "__at", "left").select(*keys, defect.alias("defect")).where("defect is not null")
