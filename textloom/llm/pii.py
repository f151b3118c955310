"""Problem 3: personal information in free text, by a skip-chain conditional random field.

Tokens are labelled B/I/O for five kinds (email, phone, id_number, street, name). Chain features are words,
shapes, small word lists and the like of a token and its two neighbours on each side. Distant tokens
with the same word, or with the same part of a hyphenated word or a possessive (case and accents aside), are joined by skip edges that favour one kind for both, so that
a name recognised in a signature also counts in running text; loopy sum-product messages run until none of
a document moves any more. The field is trained here, on text that a generator writes with its mentions marked.

A document is labelled as a whole and by itself: one narrow pass over Arrow batches, no shuffle.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import crf
from textloom.session import spread

KINDS = ("email", "phone", "id_number", "street", "name")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
KIND_OF = np.array([-1, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4])
BEGINS = np.array([False, True, False] + [True, False] * 4)
OFFSETS = (-2, -1, 0, 1, 2)
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street": "[STREET]", "name": "[NAME]"}

_GAP = r"(?:[ \t]|\r?\n[\s>|]*)"
#: The sign or word that stands for the at of an address, spelled-out forms included, and what follows it.
_AT = re.compile(rf"(?:@|[\[({{]{_GAP}?[aA][tT]{_GAP}?[\])}}]{_GAP}?|(?<=\s)[aA][tT]{_GAP}(?=[\w-]+{_GAP}[dD][oO][tT]{_GAP}))[\w-]+(?:(?:\.|{_GAP}?[\[({{]{_GAP}?[dD][oO][tT]{_GAP}?[\])}}]{_GAP}?|{_GAP}[dD][oO][tT]{_GAP})[\w-]+)*")
_LOCAL = re.compile(r"[\w.+%-]*")  # of the text turned round
#: Encoded data, a line break with the quote marks after it, a word, a code of letters and digits, a run of digits, any other sign.
_TOKEN = re.compile(
    r"[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w+/=])"
    r"|[A-Za-z0-9+/=]{40,}"
    r"|\r?\n[\s>|]*"
    r"|[^\W\d_]+\d\w*|\d+[^\W\d_]+\d\w*"
    r"|[^\W\d_]+(?:['’-][^\W\d_]+)*"
    r"|[+(]{0,2}\d+(?:[ .\-/()\xa0]{1,3}\d+)*(?:-?[A-Za-z](?![^\W_]))?"
    r"|[^\w\s]|_+"
)


def tokenize(text: str) -> list[str]:
    """The tokens of a text; an address is one token, however it is spelled."""
    out: list[str] = []
    end = 0
    for m in _AT.finditer(text):
        a = m.start()
        if text[a] != "@" and a > end and text[a - 1].isspace():
            a = len(text[end:a].rstrip(" \t\r\n>|")) + end
        b = a
        a -= _LOCAL.match(text[end:a][::-1]).end()
        if a == b:
            continue  # nothing before the at
        out += _TOKEN.findall(text, end, a)
        out.append(text[a : m.end()])
        end = m.end()
    return out + _TOKEN.findall(text, end) if end else _TOKEN.findall(text)


_ALNUM = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CODE = re.compile(r"[^\W\d_]+\d\w*|\d+[^\W\d_]+\d\w*")

# Word lists, in lower case and without accents.
GIVEN = (
    "aaron adam ahmed aiko alan alex alice amir amy ana anders andrea andrew anna anne anton astrid beatriz ben bjorn boris brian camille carla carlos carmen charlotte chase chen chidi chloe chris ciaran clara claire daniel dario "
    "david delphine diana diego dmitri drew eero elena elif elena emeka emil emily emma eric erik eva faith farida fatima felix fernando francois frank freya gabriel george goran grace greta hana hannah hans hassan helen helene henry hope hugo ian ibrahim "
    "iker ines ingrid irina isabel ivan jack jacob james jan jana jane javier jean jennifer john jonas jose julia june jurgen karen karim karl kate kenji kevin kim kofi lars laura lea leila lena leo liam linda linnea lisa lucas lucia luis maja mara marc "
    "maria marie mark marta martin mateo matthias max may maya mei michael miguel mila miles milo mohammed nadia naomi nina noah noor nora olga oliver omar oskar pablo patrick paul pavel pedro peter petra philippe pierre piotr priya quentin rachel rafael raj rita robert "
    "rosa rose sam samir sandra sara sarah sasha simon skye sofia soren stefan sunita susan sven theo thomas tim tomasz tom ursula valentina vera viktor wanda will william yara yuki yusuf zoe"
).split()
PARTICLES = "de la van von der den del di da dos du le bin ibn al el".split()
TITLES = "mr mrs ms miss dr prof professor sir madam herr frau hr fr monsieur madame mme mlle m sr sra srta señor señora don dona doktor".split()
MONTHS = "january february march april may june july august september october november december januar februar marz mai juni juli oktober dezember janvier fevrier mars avril juin juillet aout septembre octobre novembre decembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre jan feb mar apr jun jul aug sep sept oct nov dec".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miercoles jueves viernes sabado domingo".split()
STREETS = "street st road rd lane ln avenue ave drive dr close gardens terrace way hill court ct place pl square sq blvd boulevard crescent grove row walk park rue chemin allee quai impasse cours calle avenida avda plaza paseo camino carrer carretera strasse str weg gasse platz ring via viale piazza".split()
STREET_END = re.compile(r"(?:stra(?:ss|ß)e|str|weg|gasse|platz|allee|ufer|damm|ring|straat|laan)$")
GREETINGS = "hi hello hey dear hallo liebe lieber guten tag morning good bonjour salut cher chere chers hola buenos dias estimado estimada querido querida moin".split()
CLOSINGS = "best regards cheers thanks sincerely wishes yours greetings grusse gruss grussen cordialement amicalement saludos saludo atentamente merci danke gracias bien toi journee".split()
HEADERS = "from to cc bcc von an de a para kopie participant attendee attention contact contacts sender recipient signed".split()
SAID = "wrote writes schrieb schreibt ecrit escribio escribe said".split()
ASK = "ask ring call meet met with spoke talk told thank thanks tell asked invite by see cc copy".split()
PHONE_WORDS = "tel phone telephone mobile mob cell fon fax call ring dial whatsapp text sms number handy movil t m f p ext extension answers line desk hotline reach".split()
ID_WORDS = "ssn passport passeport pasaporte reisepass dni nie nif nino ni tin id itin national identity insurance social security tax steuer-id steuer steueridentifikationsnummer steuernummer sozialversicherungsnummer personalausweis ausweis licence license driving permis conduire fuhrerschein numero secu securite sociale cpf curp nhs sin bsn pesel ausweisnummer identidad fiscal driver's licence".split()
OTHER_NUMBERS = "order ticket build version invoice step page pages seite section table figure room build issue case ref reference bug item chapter port line row rows shard release isbn doi serial parcel tracking registered percent gb mb minutes hours epochs points euro eur usd".split()
ROLES = "cluster status alerts alert billing helpdesk help desk submissions submission registry no reply noreply no-reply eval bot info support admin office team list mailer daemon postmaster webmaster sales service news newsletter jobs careers hr accounts library events press security notifications robot editor editors committee chair press".split()
PLACE_WORDS = "lab labs institute group library university department dept office corpus dataset collection project paper model system meeting call room team branch school college centre center hospital hotel gmbh inc ltd".split()
ADDRESS_WORDS = "box po p.o flat apartment apt suite floor bis address parcels ship deliver office meet live lives lived".split()
_LISTS = {"given": GIVEN, "particle": PARTICLES, "title": TITLES, "month": MONTHS, "day": DAYS, "street": STREETS, "greeting": GREETINGS, "closing": CLOSINGS, "header": HEADERS, "said": SAID, "ask": ASK, "phone": PHONE_WORDS, "idword": ID_WORDS, "other": OTHER_NUMBERS, "role": ROLES, "placeword": PLACE_WORDS, "addressword": ADDRESS_WORDS}
_MEMBER: dict[str, list[str]] = {}
for _name, _words in _LISTS.items():
    for _w in _words:
        _MEMBER.setdefault(_w, []).append(_name)


def fold(word: str) -> str:
    """Lower case without accents."""
    low = word.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


_DIGITS = str.maketrans("0123456789", "9999999999")


def _number(token: str) -> str:
    """Feature names of a number: its digits, groups and signs."""
    s = token.translate(_DIGITS)
    groups = [len(g) for g in re.findall("9+", s)]
    n, letter = sum(groups), s[-1].isalpha()
    f = ["number", f"n{min(n, 16)}", f"groups{min(len(groups), 8)}", "g:" + ".".join(map(str, groups[:7]))]
    f += ["plus"] * ("+" in s) + ["paren"] * ("(" in s or ")" in s) + ["slash"] * ("/" in s) + ["dots"] * ("." in s) + ["dash"] * ("-" in s) + ["spaces"] * (" " in s) + ["letter"] * letter
    f += ["long"] * (n >= 7) + ["phonelen"] * (9 <= n <= 14) + ["one"] * (len(groups) == 1) + ["tiny"] * (n <= 2) + ["house"] * (n <= 3) + ["solid8"] * (len(groups) == 1 and n >= 8)
    return "|".join([*f, *["long&letter"] * (letter and n >= 7)])


def _type(token: str) -> tuple[str, tuple[str, ...]]:
    """A token's type key, and the words by which it is joined to its like, the whole one first, if it is capitalised; of an
    address, its local part after a mark."""
    if _WORD.fullmatch(token):
        if len(token) < 2 or not token[0].isupper():
            return token, ()
        whole = _fold(token)
        bare = re.sub("['’]s$", "", whole)
        parts = [x for x in bare.split("-") if len(x) > 2] if "-" in bare else []
        return token, tuple(dict.fromkeys((whole, bare, *parts)))
    if "\n" in token and not token.strip("\r\n\t >|\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\xa0"):
        return "\n\n" if token.count("\n") > 1 else "\n", ()
    if len(token) == 1 and not token.isalnum() or token[0] == "_" and not token.strip("_"):
        return token[0], ()
    if len(token) >= 40 and re.fullmatch(r"[A-Za-z0-9+/=]+", token):
        return "\x07", ()
    if _CODE.fullmatch(token):
        shape = re.sub("9+", "9", re.sub(r"[^\W\d]+", "A", token.translate(_DIGITS)))
        return f"\x06{min(len(token), 14)}|{shape}", ()
    if token[0].isdigit() or token[0] in "+(" and any(c.isdigit() for c in token):
        if "@" not in token and not re.search(r"(?i)[a-z]{2}", token):
            return "\x05" + _number(token), ()
    local = re.match(r"[\w.+%-]*", token).group()
    return ("\x01@" if "@" in token else "\x01at"), ("\x01" + fold(local),)


class _Types(dict):
    """Types by token, kept as far as memory should go."""

    def __missing__(self, token: str) -> tuple[str, tuple[str, ...]]:
        if len(self) > 500_000:
            self.clear()
        found = _type(token)
        if len(token) <= 40:
            self[token] = found
        return found


_TYPES = _Types()
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


class Text:
    """Tokens of one text as type keys, with what is needed to join and to place them."""

    __slots__ = ("keys", "folded", "tokens")

    def __init__(self, text: str, address_field: bool) -> None:
        self.tokens = tokenize(text)
        found = list(map(_TYPES.__getitem__, self.tokens))
        self.keys = list(map(_FIRST, found))
        self.folded = [x for x in enumerate(map(_SECOND, found)) if x[1]]  # by the words they are joined by
        if address_field:
            self.keys = [k + "\x04" for k in self.keys]

    def look_up(self, addresses: str) -> None:
        """Marks the words that occur in the addresses."""
        for i, (w, *_) in self.folded:
            if w in addresses and w[0] != "\x01":
                self.keys[i] = "\x02" + self.keys[i]


@functools.lru_cache(maxsize=300_000)
def _fold(word: str) -> str:
    return fold(word)


def describe(key: str) -> list[str]:
    """Feature names of a type key."""
    f = ["bias"]
    named = key[0] == "\x02"
    if named:
        key = key[1:]
    if key.endswith("\x04"):
        key = key[:-1]
        f.append("field")
    if key in ("\n", "\n\n"):
        return [*f, "newline", "blank" if key == "\n\n" else "newline1"]
    if key[0] == "\x01":
        return [*f, "email", "email" + key[1:]]
    if key[0] == "\x07":
        return [*f, "blob"]
    if key[0] == "\x05":
        return [*f, *key[1:].split("|")]
    if key[0] == "\x06":
        size, shape = key[1:].split("|")
        return [*f, "code", "code" + size, "c:" + shape, *(["code_caps"] if shape[0] == "A" else [])]
    word = key
    if not word[0].isalpha():
        return [*f, "sign", "s=" + word]
    low = _fold(word)
    cap, upper = word[0].isupper(), word.isupper()
    f += ["word", "w=" + low, "cap" if cap else "lower", *(["upper"] if upper and len(word) > 1 else []), *(["initial"] if len(word) == 1 and cap else [])]
    lists = list(_MEMBER.get(low, ()))
    if cap and "-" in low and low.split("-")[0] in _MEMBER:
        lists += [x for x in _MEMBER[low.split("-")[0]] if x == "given"]
    f += lists
    if STREET_END.search(low) and len(low) > 5:
        f.append("streetend")
        if cap:
            f.append("cap&streetend")
    if cap:
        f += ["cap&" + x for x in lists] or ["cap&unknown"]
        if len(word) > 2:
            f.append("cap:" + low[-3:])
        if "'" in word or "’" in word:
            f.append("cap&quote")
        if "-" in word:
            f.append("cap&dash")
        if len(word) <= 3:
            f.append("cap&short")
        if named:
            f += ["named", *("named&" + x for x in lists)]
            if not lists:
                f.append("named&unknown")
    return f


class Features:
    """Numbers of feature names; names met after training are unknown and left out."""

    def __init__(self, number: dict[str, int] | None = None) -> None:
        self.number = number or {}
        self.open = number is None

    def __call__(self, key: str) -> list[int]:
        if self.open:
            return [self.number.setdefault(n, len(self.number) + 1) for n in describe(key)]
        return [i for n in describe(key) if (i := self.number.get(n))]


def skip_edges(texts: list[Text]) -> np.ndarray:
    """Pairs of tokens, of all texts laid end to end: each capitalised word with its next occurrence in the text, and so with
    the next one that shares a part of it."""
    edges: dict[tuple[int, int], None] = {}
    base = 0
    for t in texts:
        last: dict[str, int] = {}
        for i, words in t.folded:
            if words[0][0] != "\x01":
                for w in words:
                    if w in last:
                        edges[last[w], base + i] = None
                    last[w] = base + i
        base += len(t.keys)
    return np.array(list(edges), np.int64).reshape(-1, 2).T


def address_words(*texts: Text) -> str:
    """The local parts of every address in the texts, where names are looked up."""
    return " ".join(w[1:] for t in texts for _, (w, *_) in t.folded if w[0] == "\x01")


def spans(tokens: list[str], labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, last token + 1, kind) of the mentions in BIO labels; an I of another kind begins a mention too."""
    kinds = KIND_OF[labels]
    out = []
    for i in np.flatnonzero(kinds >= 0).tolist():
        if out and out[-1][1] == i and out[-1][2] == kinds[i] and not BEGINS[labels[i]]:
            out[-1] = (out[-1][0], i + 1, out[-1][2])
        else:
            out.append((i, i + 1, int(kinds[i])))
    return out


def trim(tokens: list[str], a: int, b: int) -> tuple[int, int]:
    """Without signs and line breaks at the ends."""
    while a < b and not _ALNUM.search(tokens[a]):
        a += 1
    while b > a and not _ALNUM.search(tokens[b - 1]):
        b -= 1
    return a, b


def normal(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


@functools.lru_cache(maxsize=300_000)
def sound(kind: int, text: str) -> str:
    """The mention's normal form, or nothing if it lacks what a mention of the kind has at least: the exact check after the field."""
    value = normal(text)
    digits = sum(c.isdigit() for c in value)
    ok = (len(value) > 3, 6 <= digits <= 17, digits >= 5, digits >= 1 and len(value) > digits, digits == 0 and len(value) > 0)[kind]
    return value if ok else ""


# ---------------------------------------------------------------- the generator of the training text

_ON = "gra plo ski tre vel dor mun fli que bai cro hal nes zur pim thi wek lor sta jix".split()
_OFF = "gel nax dom stiff ris kort wen lait pesk dril mox tain belt rusk fond zel quin hatt vose lim".split()
_O = (  # no mention; {W} an invented capitalised word, {n} a small number, {N} a long one, {w} a lower-case noun, {M} a month, {D} a day
    "The room in {W} is free from {n}:30 on.", "It seems that {W} and {W} share {n} {w}; one has to go.", "My notes from {M} say that {W} needs {n} GB.", "Let us move the {W} call to {D}.", "Please note that order {N}-{n} is late.", "Ticket #{N} covers the same {w}, build {n}.{n}.{n}.",
    "Will you send the {w} before {D}?", "I hope the {w} works. Hope to hear more soon.", "We may start in {M}. May I ask about {W}?", "Mark the {w} as done.", "They chase the same {w}. Prices rose by {n} percent.", "In {W} gibt es nur {n} Plätze.", "Der Bericht für {W} liegt im Ordner.", "Le modèle {W} obtient {n}.{n}.",
    "En {W} solo quedan {n} plazas.", "Results on {W} show a gain of {n} points over {W}.", "Subject: {W} meeting {n}:15", "Betreff: AW: {W}: table lookup", "Question on {W}", "The faith of {W} in the {w} is great.", "Grace period ends on {D}.", "I drew a {w} of {W}.", "Version {n}.{n}.{n} of {W} came out on {n}.{n}.2024.",
    "Sent: {n} {M} 2024 {n}:{n}", "On 2024-03-{n} {n}:{n} it failed.", "Registered office: {W}. Registered number {N}.", "Programme Lead | {W} Lab", "Head of Sales, {W} Institute", "Postdoc, {W} Group", "Librarian, {W} Library", "Get the {W} app for your phone", "{W} takes over the {w} part and {W} keeps the rest.", "Reviewers want one more test on {W}.", "{W} splits each {w} in {n} parts.",
    "[{n}:{n}:{n}] step={n} loss={n}.{n} shard=10.0.{n}.{n}", "Attached is the {w} from {M}, with the notes on {W}.", "Thanks for the {w}, it was great.", "Dear all,", "Hi all,", "Liebe Runde,", "Chers tous,", "Estimados colegas:", "Buenos días:", "Best regards", "Kind regards,", "The vendor asked for {W}; I said no.", "Invoice {N} of {W} was paid.", "{n} Sätze aus {W} wurden geprüft.", "Somebody should ask whether {W} can wait.", "Nobody told me about {W}.", "Nach {n} Versuchen ist {W} fertig.", "Für {W} gilt das nicht, {n}.º B, {W}", "Annotators liked {W}.", "B {W}", "Could you look over the {w} before {D}?", "Could {W} handle {n} rows?", "Die Zahlen aus {W} passen nicht.",
    "Tracking number {N} is for {W}.", "Call it a day. Ring the bell. Ask for more.", "The password for {W} was changed.", "You get this mail as a member of the {W} list.", "Der Datensatz {W} hat {n} Zeilen, Seite {n}.", "Lunch in {W} is on.", "Ask {W} users first.", "Copy {W} to {W}.", "With {W}, the score is {n}.", "Serial {N}/{n} and part {n}-{N} are out of stock.", "The {W} paper by the {W} team cites {W}.",
    "Meet us in {W}.", "From {W} to {W} it takes {n} minutes.", "{W} et al. report {n}.{n}.", "Reach {n} points or stop.", "{W}, {W} and {W} were left out.", "CONFIDENTIALITY NOTICE:", "Welcome to {W}!", "Is {W} part of {W}?", "Two of the {n} splits overlap.", "El esquema de {W} ya está.", "Hemos repetido {W} con {n} pruebas.", "ISBN 978-{n}-{N}", "At {n}:{n} the {W} {w} went down.", "the {w} team said {M} is fine", "DO NOT USE {U} BEFORE {M}.", "{U} AND {U} DROPPED {n} PERCENT.",
)
_NAME = (
    "I spoke with {name} about the {w}.", "Ask for {T} {name} at the front desk.", "{T} {name} signed the {w} yesterday.", "Could {name} look at {W}?", "{name} wrote:", "* {name} [{n}/{n}/2024 {n}:{n}]:", "{name} schrieb am {n}.{n}.2024:", "Hi {name},", "Hello {name},", "Dear {name},", "{name},", "Bonjour {name},", "Hola {name}:", "Hallo {name},", "Guten Tag {name},", "Good morning {name},", "Salut {name},",
    "From: {name} <{email}>", "Von: {name} <{email}>", "De: {name} <{email}>", "*From:* {name} <{email}>", "To: {name}", "*To:* {name}", "An: {name}", "Para: {name}", "À: {name}", "Cc: {name}; {name}", "On {n}/{n}/2024 {n}:{n} {name} wrote:", "On Mon, Mar {n}, 2024 at {n}:{n}, {name} <{email}> wrote:", "Am 2024-02-{n} {n}:{n} schrieb {name} <{email}>:", "Le {n}/{n}/2024 {n}:{n}, {name} <{email}> a écrit :", "El {n}/{n}/2024, {name}\n<{email}> escribió:",
    "{name} <{email}> writes:", "Kind regards,\n{name}", "Best,\n{name}", "Cheers\n{name}", "Thanks,\n{name}\n--\n{name}", "Viele Grüße\n{name}", "Cordialement\n{name}", "Saludos,\n{name}\n\n{name}\nPostdoc | {W} Lab", "***\n{name}\nHead of Sales, {W} Group", "-- \n{name}\nLibrarian, {W} Library", "—\n{name}\nData Steward | {W} Institute\nTel. {phone}\n{email} (preferred)", "Contacts: {name} ({phone}), {name} ({email}).", "Participant: {name}", "Thank {name} for me.", "{name} and {name} will come on {D}.", "Tell {name} that {W} is late.", "The talk by {name} was on {W}.", "I met {name} in {W}.", "{name} asked for a copy of the {w}.",
    "My colleague {name} is away until {D}.", "{T} {name} and {T} {name} agreed.", "Has {name} seen the {w}?", "Could {name} take over the {w}?", "The {w} came from {name}, as far as I know.", "A {w} by {name} is due {D}.", "{name} thinks {W} is slow.", "as {name} said, {W} needs {n} GB", "please send it to {name} ({phone})", "{name} from {W} joined.", "{name}'s {w} is on {W}.", "El informe lo hizo {name}.", "Das hat {name} in {W} geprüft.", "{name} a relu le texte.", "___________\n{name}\nResearch Engineer, {W} Lab\nphone {phone}", "{name} signed for {W}.", "You know {name}, don't you?", "according to {name}, {W} works", "{name} | {W} Lab",
)
_PHONE = ("New mobile: {phone}, the old one is dead.", "Call {phone} after lunch.", "Ring me under {phone} ext. {n} if it breaks.", "WhatsApp {phone} is fine.", "Tel. {phone}", "Tel: {phone}", "T: {phone}", "phone {phone}", "{phone}", "Phone: {phone}", "The desk answers on {phone} until five.", "M {phone}", "Mobile {phone}", "my number is {phone}", "Fax {phone}", "You reach us at {phone}.", "Telefon: {phone}", "Tél. {phone}", "Móvil: {phone}", "or dial {phone} x{n}", "text me on {phone}.", "Hotline {phone}, {D} only")
_ID = ("My {I} is {id}, please keep it safe.", "The form wants a {I} ({id}).", "{I} {id} is on file.", "For the contract they need the {I}: {id}.", "{I}: {id}", "{I} no. {id}", "the {I} number {id} was wrong", "{I} Nr. {id}", "His {I} was {id}.", "{I} {id}", "Please check {I} {id} for {name}.", "Mein {I} ist {id}.", "mon {I} est {id}", "mi {I} es {id}", "{I}\n{id}.", "I lost my {I} ({id}) in {W}.", "we hold {I} {id} for this person", "{I} is {id}")
_STREET = ("Parcels go to {street}, {W}.", "We meet at {street}, {W}, second floor.", "The new address is {street}, {n}{n}123 {W}.", "Ship it to: {street}, {W}", "{street}, {W} 00{n}{n}", "{street}, 00{n}{n} {W}", "{street}", "{street} in {W}", "Flat {n}, {street}, {W}", "We meet at Flat {n}, {street}, {W}.", "I live at {street}.", "The office at {street} is closed.", "{street}, {n}.º B, {W}", "Send it to {street} in {W}, please.", "Deliver to {street}, floor {n}.", "Come to {street} à {W}.", "Address: {street}", "{street} à {W}", "We moved from {street} to {street}.", "Parcels go to {street} à {W}.")
_MAIL = ("Send the form to <{email}>, not to me.", "Please copy {email} on the reply.", "mailto:{email} works too.", "You can reach the office at {email}.", "The account is registered under {email}; nothing else.", "E: {email}", "{email}", "{email} (preferred)", "E-mail: {email}", "<{email}> wrote:", "<{email}> writes:", "write to {email}, {email} or call {phone}", "Questions go to {email}.")
_FIELD = ('{name} <{email}>', '{name} <{email}>', '"{rname}" <{email}>', '"{last}', '{first}" <{email}>', '{email}', '{email} ({name})', '{first} <{EMAIL}>', '{role} <{email}>', '{role} <{rmail}>', '{name} <{email}', '{rmail}', "'{name}' <{email}>", '{name}', '{first}" <{email}', '{rname} <{email}>')
_ROLE_NAMES = ("Cluster Status", "Billing", "Helpdesk", "Submissions", "No Reply", "Registry", "Alerts", "Eval Bot", "Info", "Support", "News Desk", "Library Office", "Team List", "Mailer Daemon", "Press Office", "{W} Team", "{W} List", "{W} Library", "{W} Bot", "Job Robot")
_NOUNS = "report draft table branch config sample run form plan file budget review".split()
_IDS = ("SSN", "social security number", "passport", "passport no.", "DNI", "national ID", "NI number", "tax ID", "Steuer-ID", "numéro de sécu", "driving licence", "insurance number", "National Insurance", "identity card", "Personalausweis", "NIF", "NIE", "TIN", "permis de conduire", "Führerschein", "Sozialversicherungsnummer", "driver's license", "ID card", "health insurance")


class _Writer:
    """Writes texts with their mentions: (text, [(start, end, kind)])."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def invented(self) -> str:
        r = self.r
        return (r.choice(_ON) + r.choice(_OFF) + (r.choice(_OFF) if r.random() < 0.15 else "")).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def person(self) -> dict[str, str]:
        r = self.r
        known = r.random() < 0.85
        first = r.choice(GIVEN).capitalize() if known else self.invented()
        first = {"Soren": "Sören", "Bjorn": "Björn", "Helene": "Hélène", "Zoe": "Zoë", "Lucia": "Lucía", "Theo": "Théo"}.get(first, first)
        last = self.invented()
        if r.random() < 0.1:
            last = r.choice(("de la ", "van ", "von ", "van der ", "del ")) + last
        elif r.random() < 0.08:
            last = r.choice(("O'", "Mac", "D'")) + last
        if r.random() < 0.08:
            last += "-" + self.invented()
        a, b = fold(first), fold(last).replace(" ", "").replace("'", "")
        local = r.choice((f"{a}.{b}", f"{b}.{a[0]}", f"{a[0]}{b}", f"{a}.{b[:4]}{self.digits(2)}", f"{a[0]}{b}+x1"))
        return {"first": first, "last": last, "mail": f"{local}@{self.domain()}"}

    def domain(self) -> str:
        r = self.r
        return f"{r.choice(('mail.', 'lab.', 'dept-', ''))}{self.invented().lower()}{r.choice(('', '-data', 'uni', 'works'))}.{r.choice(('example', 'invalid', 'test', 'example.com', 'example.org'))}"

    def name(self, p: dict[str, str]) -> str:
        r, first, last = self.r, p["first"], p["last"]
        x = r.random()
        out = f"{first} {last}" if x < 0.5 else first if x < 0.74 else last if x < 0.79 else f"{last}, {first}" if x < 0.86 else f"{first} {r.choice('ABDEHJKLMRST')}. {last}" if x < 0.91 else f"{first} {last[0].upper()}." if x < 0.95 else f"{first[0]}. {last}"
        return out.upper() if r.random() < 0.05 else out.replace(" ", "\n", 1) if r.random() < 0.03 else out

    def email(self, p: dict[str, str]) -> str:
        r, m = self.r, p["mail"]
        x = r.random()
        if x < 0.75:
            return m if r.random() < 0.9 else m.upper()
        if x < 0.83:
            return m.replace("@", " [at] ").replace(".", " [dot] ") if r.random() < 0.5 else m.split("@")[0] + " [at] " + m.split("@")[1].replace(".", " [dot] ")
        if x < 0.92:
            return m.replace("@", " (at) ")
        return m.split("@")[0] + " at " + m.split("@")[1].replace(".", " dot ")

    def phone(self) -> str:
        r, d = self.r, self.digits
        return r.choice((
            lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"1{d(10)}", lambda: f"+44 20 {d(4)} {d(4)}", lambda: f"020 {d(4)} {d(4)}", lambda: f"07{d(3)} {d(3)} {d(3)}", lambda: f"+44 (0)7{d(3)} {d(6)}", lambda: f"+49-30-{d(5)}-{d(3)}",
            lambda: f"030 / {d(5)} {d(3)}", lambda: f"0049 30 {d(8)}", lambda: f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"01 {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+34 {d(3)} {d(3)} {d(3)}", lambda: f"+34{d(9)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}",
        ))()

    def id(self) -> str:
        r, d = self.r, self.digits
        up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        return r.choice((
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: d(9), lambda: f"{d(8)}{up(1)}", lambda: f"{d(8)}-{up(1)}", lambda: f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", lambda: f"{up(2)}{d(6)}{up(1)}", lambda: f"{up(2)}{d(7)}", lambda: f"{up(1)}{d(8)}", lambda: d(11), lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}",
            lambda: f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{up(5)}{d(6)}{up(2)}", lambda: f"{up(1)}{d(7)}{up(1)}", lambda: f"{up(1)}{d(2)}{up(1)}{d(5)}", lambda: f"{up(3)}-{d(3)}-{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(2)} {d(6)} {up(1)} {d(3)}", lambda: d(13), lambda: d(10),
        ))()

    def street(self) -> str:
        r = self.r
        n = str(r.randint(1, 480)) + (r.choice("abcABC") if r.random() < 0.15 else "")
        w = self.invented()
        kind = r.choice(("Street", "Road", "Lane", "Hill", "Close", "Drive", "Gardens", "Terrace", "Way", "Blvd", "Avenue", "Court", "St.", "Square", "Place"))
        x = r.random()
        if x < 0.36:
            out = f"{n} {w} {kind}"
            if r.random() < 0.2:
                out = out.upper()
            return out
        if x < 0.43:
            return f"{n} Old {w} Way"
        if x < 0.56:
            return f"{w}{r.choice(('straße', 'str.', 'weg', 'gasse', 'platz', 'strasse'))} {n}"
        if x < 0.61:
            return f"{r.choice(('Am', 'An der', 'Zum', 'Im'))} {w} {n}"
        if x < 0.76:
            return f"{n}{r.choice(('', ' bis', ' bis,', ','))} {r.choice(('rue', 'rue de', 'avenue', 'boulevard', 'place de', 'chemin de', 'rue du'))} {w}"
        if x < 0.88:
            return f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Calle de', 'Paseo de', 'C/'))} {w}{r.choice((' ', ' ', ', '))}{n}"
        return f"{r.choice(('P.O. Box', 'PO Box', 'Post Office Box', 'Postfach', 'BP', 'Apartado'))} {n}"

    def fill(self, template: str, people: list[dict[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.r
        out, marks, at = [], [], 0
        who = r.choice(people)
        for piece in re.split(r"(\{\w+\})", template):
            kind = -1
            if piece.startswith("{"):
                key = piece[1:-1]
                if key in ("name", "first", "last", "rname", "email", "EMAIL", "rmail"):
                    kind = 0 if "mail" in key.lower() else 4
                    if key == "name":
                        who = r.choice(people) if r.random() < 0.4 else who
                    piece = {"name": lambda: self.name(who), "first": lambda: who["first"], "last": lambda: who["last"], "rname": lambda: f"{who['last']}, {who['first']}", "email": lambda: self.email(who), "EMAIL": lambda: who["mail"].upper(), "rmail": lambda: r.choice(("info", "billing", "cluster-status", "no-reply", "helpdesk", "registry", "eval-bot")) + "@" + self.domain()}[key]()
                elif key in ("phone", "id", "street"):
                    kind = {"phone": 1, "id": 2, "street": 3}[key]
                    piece = getattr(self, key)()
                else:
                    piece = {"W": self.invented, "U": lambda: self.invented().upper(), "w": lambda: r.choice(_NOUNS), "n": lambda: str(r.randint(1, 99)), "N": lambda: self.digits(r.randint(5, 8)), "M": lambda: r.choice(MONTHS[:12]).capitalize(), "D": lambda: r.choice(DAYS[:7]).capitalize(), "T": lambda: r.choice(("Dr.", "Ms", "Mr", "Mrs", "Prof.", "Herr", "Frau", "Mr.", "Dr")), "I": lambda: r.choice(_IDS), "role": lambda: r.choice(_ROLE_NAMES).replace("{W}", self.invented())}[key]()
            if kind >= 0:
                marks.append((at, at + len(piece), kind))
            out.append(piece)
            at += len(piece)
        return "".join(out), marks

    def document(self) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.r
        people = [self.person() for _ in range(r.randint(1, 3))]
        text, marks = "", []
        for _ in range(r.randint(3, 12)):
            pool = r.choices((_O, _NAME, _PHONE, _ID, _STREET, _MAIL), (7, 5, 1.3, 1.3, 1.3, 1))[0]
            own, m = self.fill(r.choice(pool), people)
            text += r.choice((" ", " ", "\n", "\n\n")) if text else ""
            marks += [(a + len(text), b + len(text), k) for a, b, k in m]
            text += own
        if r.random() < 0.25:  # wrapped lines: some blanks become breaks, which moves nothing
            text = "".join("\n" if c == " " and r.random() < 0.06 else c for c in text)
        return text, marks

    def field(self) -> tuple[str, list[tuple[int, int, int]]]:
        return self.fill(self.r.choice(_FIELD), [self.person()])


def gold(text: str, tokens: list[str], marks: list[tuple[int, int, int]]) -> list[int]:
    """Labels of the tokens from marked mentions."""
    labels, at, open_ = [], 0, -1
    for t in tokens:
        a = text.index(t, at)
        at = a + len(t)
        hit = next(((i, k) for i, (x, y, k) in enumerate(marks) if a < y and at > x), None)
        labels.append(0 if hit is None else 1 + 2 * hit[1] + (hit[0] == open_))
        open_ = hit[0] if hit else -1
    return labels


@functools.lru_cache(maxsize=1)
def model(documents: int = 4000, fields: int = 800, epochs: int = 6, seed: int = 11) -> tuple[crf.Field, dict[str, int]]:
    """The field and its feature numbers, trained on generated text."""
    w, features = _Writer(seed), Features()
    feats: list[list[int]] = []
    labels: list[int] = []
    lengths: list[int] = []
    texts: list[Text] = []
    for _ in range(documents + fields):
        field_only = w.r.random() < fields / (documents + fields)
        text, marks = w.field() if field_only else w.document()
        # Addresses in the text, sometimes held back: names must be known without them too.
        t = Text(text, field_only)
        t.look_up(address_words(t) if w.r.random() < 0.75 else "")
        texts.append(t)
        feats += [features(k) for k in t.keys]
        labels += gold(text, t.tokens, marks)
        lengths.append(len(t.keys))
    features.open = False
    field = crf.Field(LABELS, OFFSETS, len(features.number) + 1)
    crf.train(field, feats, labels, lengths, epochs=epochs)
    # The skip potential, piecewise: how much more often two joined tokens are of the same kind than by chance.
    a, b = skip_edges(texts)
    kind = KIND_OF[np.array(labels)] + 1
    joint = np.ones((6, 6))
    np.add.at(joint, (kind[a], kind[b]), 1)
    np.add.at(joint, (kind[b], kind[a]), 1)
    joint /= joint.sum()
    ratio = np.sqrt(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    ratio = np.clip(ratio, 0.3, 3.0)
    field.skip = ratio[np.ix_(KIND_OF + 1, KIND_OF + 1)].astype(np.float32)
    return field, features.number


class Finder:
    """Finds mentions in many texts at once; one per worker."""

    def __init__(self, field: crf.Field, number: dict[str, int]) -> None:
        self.field = field
        self.scores = crf.Scores(field, Features(number))

    def find(self, texts: list[Text]) -> list[list[tuple[int, int, int, str]]]:
        """For each text its mentions as (first token, last token + 1, kind, normal form)."""
        sizes = np.array([len(t.keys) for t in texts], np.int64)
        if not sizes.sum():
            return [[] for _ in texts]
        types = self.scores.types([k for t in texts for k in t.keys])
        unary = self.scores.unary(types, sizes)
        labels = crf.infer(self.field, unary, sizes, skip_edges(texts)).argmax(axis=1)
        out, at = [], 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            own = []
            for a, b, k in spans(t.tokens, labels[at : at + n]):
                a, b = trim(t.tokens, a, b)
                if a < b and (value := sound(k, "".join(t.tokens[a:b]))):
                    own.append((a, b, k, value))
            out.append(own)
            at += n
        return out


def redact(text: str, tokens: list[str], found: list[tuple[int, int, int, str]]) -> str:
    """The text with each mention replaced by its placeholder; all else unchanged."""
    out, end, at, k = [], 0, 0, 0
    for a, b, kind, _ in found:
        while k <= b - 1:
            start = text.index(tokens[k], at)
            at = start + len(tokens[k])
            if k == a:
                out.append(text[end:start])
            k += 1
        out.append(PLACEHOLDER[KINDS[kind]])
        end = at
    return "".join([*out, text[end:]])


CHUNK = 2_000  # messages that are labelled together


def _scan(df: DataFrame, key: str, text: str, sender: str, receivers: str, schema: str, emit: Callable) -> DataFrame:
    field, number = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field, number)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
                rows = list(zip(get(key), get(text), get(sender), get(receivers), strict=True))
                texts, owner = [], []
                for i, (_, body, from_, to) in enumerate(rows):
                    own = []
                    for name, j, part in [("content", 0, body), ("from_address", 0, from_), *(("to_addresses", j, x) for j, x in enumerate(to or ()))]:
                        if part:
                            own.append(Text(part, name != "content"))
                            owner.append((i, name, j))
                    known = address_words(*own)
                    for t in own:
                        t.look_up(known)
                    texts += own
                yield emit(rows, texts, owner, finder.find(texts))

    return spread(df.select(key, text, sender, receivers)).mapInArrow(run, schema)


def mentions(df: DataFrame, key: str = "row_id", text: str = "content", sender: str = "from_address", receivers: str = "to_addresses") -> DataFrame:
    """(key, field, kind, value): each distinct mention of each row. Null, empty and blank texts and null entries
    have none. ``value`` has the mention's letters and digits only, in lower case."""
    names = {"content": text, "from_address": sender, "to_addresses": receivers}

    def emit(rows, texts, owner, found):  # noqa: ANN001, ANN202
        out = dict.fromkeys((rows[i][0], names[f], KINDS[k], v, i) for (i, f, _), own in zip(owner, found, strict=True) for _, _, k, v in own)
        cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:4])], names=[key, "field", "kind", "value"])

    return _scan(df, key, text, sender, receivers, f"`{key}` long, field string, kind string, value string", emit)


def redacted(df: DataFrame, key: str = "row_id", text: str = "content", sender: str = "from_address", receivers: str = "to_addresses") -> DataFrame:
    """(key, text, sender, receivers): the same columns with typed placeholders; nulls stay null."""

    def emit(rows, texts, owner, found):  # noqa: ANN001, ANN202
        body, from_, to = [r[1] for r in rows], [r[2] for r in rows], [None if r[3] is None else list(r[3]) for r in rows]
        for t, (i, f, j), own in zip(texts, owner, found, strict=True):
            if f == "content":
                body[i] = redact(body[i], t.tokens, own)
            elif f == "from_address":
                from_[i] = redact(from_[i], t.tokens, own)
            else:
                to[i][j] = redact(to[i][j], t.tokens, own)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(body, pa.string()), pa.array(from_, pa.string()), pa.array(to, pa.list_(pa.string()))], names=[key, text, sender, receivers])

    return _scan(df, key, text, sender, receivers, f"`{key}` long, `{text}` string, `{sender}` string, `{receivers}` array<string>", emit)
