"""Problem 5: keep of an e-mail only what its sender newly wrote.

Every non-blank line gets one of six labels by a conditional random field over the lines of a message:
new, intro (lines that introduce or head earlier mail), quoted (marked lines), forwarded (earlier mail without
marks), signature, notice. Features are the line's form (quote marks, header words, sign-off formulas, contact
data, rules, legal wording ...), those of the two lines before and after it, blank lines around it, and what was seen
further up. The field is trained here, on messages that a generator writes together with their labels;
nothing of the data is used for it. Messages are independent, so it all is one narrow pass.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import crf
from textloom.llm.gate import Gate
from textloom.session import spread

LABELS = ("new", "intro", "quoted", "forwarded", "signature", "notice")
NEW = 0
OFFSETS = (-2, -1, 0, 1, 2)

# Words and phrases by which mail programs and writers mark the parts of a message.
HEADER_WORDS = (
    "from to cc bcc sent date subject reply-to von an gesendet datum betreff kopie de à a para cc envoyé date objet "
    "enviado fecha asunto da data oggetto inviato aan verzonden onderwerp"
).split()
SAID = "wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe|ha scritto|schreef"
CLOSINGS = (
    "sincerely|sincerely yours|yours sincerely|yours faithfully|yours truly|yours|best|all the best|best wishes|best regards|kind regards|"
    "warm regards|warmly|regards|with kind regards|with best wishes|cheers|thanks|thanks a lot|many thanks|thank you|thanks again|"
    "thx|take care|talk soon|see you|respectfully|cordially|br|kr|"
    "mit freundlichen grüßen|mit freundlichen gruessen|freundliche grüße|viele grüße|beste grüße|liebe grüße|herzliche grüße|schöne grüße|gruß|grüße|mfg|vg|lg|danke|vielen dank|"
    "cordialement|bien cordialement|bien à toi|bien à vous|bonne journée|bonne soirée|amicalement|salutations|merci|merci d'avance|sincères salutations|à bientôt|"
    "saludos|un saludo|un cordial saludo|saludos cordiales|cordialmente|atentamente|un abrazo|gracias|muchas gracias|hasta pronto"
)
GREETINGS = "hi|hello|hey|dear|good morning|good afternoon|good evening|hallo|liebe|lieber|guten tag|guten morgen|sehr geehrte|moin|bonjour|salut|chers?|chères?|cher|chère|hola|buenos días|buenas tardes|estimad[oa]s?|querid[oa]s?"
NOTICE = (
    "confidential|vertraulich|confidentiel|confidencial|intended (?:only )?for|intended (?:reader|recipient)|addressee|destinataire|destinatario|empfänger bestimmt|richtige[rn]? adressat|"
    "in error|irrtümlich|par erreur|por error|not the intended|unauthori[sz]ed|forbidden|prohibited|privileged|disclaimer|liability|responsibility|secure medium|attachments? (?:is|are)|"
    "registered (?:office|number|in)|company number|handelsregister|geschäftsführer|siège social|before printing|environment|think before you print|virus|"
    "unsubscribe|mailing list|this list|the list|leave the|abmelden|désabonner|darse de baja|you (?:are )?receiv(?:e|ed|ing) this|opinions expressed|views expressed|internal use|do not (?:share|copy|distribute)|usage interne|uso interno|interner gebrauch|does not form a contract|"
    "löschen sie|benachrichtigen sie|veuillez (?:supprimer|avertir)|elimine|bórrelo|avise al remitente|this (?:e-?mail|message|communication)|ce message|este (?:mensaje|correo)|diese (?:e-?mail|nachricht)"
)
DEVICE = r"(?:sent|written|typed|verstuurd) (?:from|with|on|via) (?:my|a|the)\b|^get (?:the )?.{1,40}\bfor\b|von mein\w+ .{1,30} (?:gesendet|geschickt)|gesendet (?:mit|von)|envoyé (?:de|depuis) m|enviado (?:desde|con)|sent from|téléchargez|descarga"
ROLES = frozenset(
    "engineer manager lead head director professor postdoc student librarian steward officer assistant analyst researcher scientist developer consultant coordinator editor administrator lecturer fellow president secretary lab labs institute group library "
    "university department dept faculty team inc ltd gmbh leiter leiterin chef directeur director directora".split()
)
STREETS = frozenset("street st road rd lane avenue ave drive close gardens terrace way hill court place square blvd boulevard rue calle plaza avenida box flat am".split())
STREET = r"\b(?:street|st|road|rd|lane|avenue|ave|drive|close|gardens|terrace|way|hill|court|place|square|blvd|boulevard|rue|calle|plaza|avenida|p\.? ?o\.? box|flat)\b|^am \w+ \d"
STREET_END = r"(?:straße|strasse|str\.) \d|(?:weg|gasse|platz) \d"
_MARK = re.compile(r"^\s*((?:(?:[>|»]|:>)\s?)+)")
_DATE = r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\b(?:mon|tue|wed|thu|fri|sat|sun)\w*,? |\d{1,2}:\d{2}"


def _forms(flags: int, *pairs: tuple[str, str]) -> list[tuple[str, re.Pattern[str]]]:
    return [(name, re.compile(p, flags)) for name, p in pairs]


#: Forms of a line's text without its quote marks, matched from its start, in lower case.
FORMS = _forms(
    0,
    ("said_open", rf"(?:on|am|le|el|il|op) .*(?:{_DATE})"),
    ("said_name", r"(?:<[^<> ]+@[^<> ]+>|[^.?!<]*<[^<> ]+@[^<> ]+>) ?(?:" + SAID + r")"),
    ("said_star", r"\*? ?[^.?!@\[]{2,60}\[[^\]]*\d[^\]]*\]\s*:\s*$"),
    ("original", r"[-=_ ]{2,}\s*(?:original|forwarded|ursprüngliche|weitergeleitete|message|mensaje|messaggio|begin|anfang|oorspronkelijk)"),
    ("header", r"\*?(?:" + "|".join(HEADER_WORDS) + r") ?:\*? ?"),
    ("header_mail", r"\*?[\w-]{1,10} ?:\*? ?.*@"),
    ("closing", rf"(?:{CLOSINGS})\s*[,.!–-]*\s*$"),
    ("closing_head", rf"(?:{CLOSINGS})\b.{{0,25}}$"),
    ("greeting", rf"(?:{GREETINGS})\b.{{0,45}}[,:!]?\s*$"),
    ("delimiter", r"(?:--|—|–|-{3,12}|_{3,20}|\*{3,12}|={3,12}|~{3,12}|#{3,12})\s*$"),
    ("rule", r"[-_=*~#]{13,}\s*$"),
    ("phone", r"(?:(?:tel|phone|mobile|mob|t|m|fax|f|cell|office|fon|téléphone|móvil|handy)\.?:? ?)?\+?[\d(][\d ()./-]{6,}(?: ?(?:ext|x)\.? ?\d+)?\s*$"),
    ("email", r"(?:(?:e|e-?mail|mail|m)\.?:? ?)?<?[\w.+-]+@[\w.-]+>?(?: ?\([^)]*\))?\s*$"),
    ("web", r"(?:(?:w|web)\.?:? ?)?(?:https?://|www\.)\S+\s*$"),
    ("bar", r"[^|]{2,50} \| [^|]{2,50}"),
    ("ps", r"p\.? ?p?\.?s\b"),
    ("mail_only", r"<[^<> ]+@[^<> ]+>$"),
)
ANY = _forms(0, ("bullet", r"(?:[-*•]|\d{1,2}[.)])\s+\S"), ("bracket", r"\["), ("lower", r"[a-zß-ÿ]"))
#: Forms that need the case.
CASED = _forms(
    0,
    ("names", r"(?:[A-ZÀ-Ý][\w'’.-]*|de|la|van|von|der|del|di|da|y|und)(?: (?:[A-ZÀ-Ý][\w'’.-]*|de|la|van|von|der|del|di|da|y|und)){0,4}\s*$"),
    ("name_comma", r"[A-ZÀ-Ý][\w'’-]+(?: [A-ZÀ-Ý][\w'’-]+)?,\s*$"),
    ("notice_caps", r"[A-Z][A-Z ]{8,}:?\s*$"),
)
SAID_END = rf"(?:{SAID})\s*(?:am .*)?:?\s*$"
#: Forms looked for anywhere in a line, if its words allow them: the gate is derived from the patterns and leaves no match out.
SEARCHED = {"said": SAID_END, "notice": NOTICE, "device": DEVICE}
_SEARCHED = [(name, re.compile(x)) for name, x in SEARCHED.items()]
GATE = Gate(list(SEARCHED.values()), lambda w: w.removeprefix("~") not in ("this", "my", "a", "the", "in", "is", "are", "on", "for", "of", "do", "no", "not", "only"))
_STREET, _STREET_END = re.compile(STREET), re.compile(STREET_END)
_WORDS, _STOPS = re.compile(r"[^\W\d_]+"), re.compile(r"[.?!…][\"')]*$")
OTHER = ("said", "device", "notice", "role", "street", "digit", "end", "colon", "comma")
NAMES = [*(n for n, _ in (*FORMS, *ANY, *CASED)), *OTHER]
LINE = [
    "bias", *NAMES, "mark", "mark_deep", "mark_number", "empty_core", "short", "mid", "long", "words1", "words2", "words4",
    "blank_before", "blank_after", "first", "last", "own_name", "run_start", "run_end", "run_single", "seen_intro", "seen_header2", "seen_rule_header", "seen_closing", "seen_sign",
    "far_closing", "mark&seen_intro", "single&!intro", "single&seen_intro", "single&number", "single&number&intro", "names&own", "header&mark", "header&!mark", "short&!end", "notice&!end", "notice&end", "closing&comma", "names&after_closing", "greeting&mark", "star&colon", "rule&!mark", "names&blank_before", "said&!mark",
]
INDEX = {n: i + 1 for i, n in enumerate(LINE)}


@functools.lru_cache(maxsize=200_000)
def _core(line: str) -> tuple[int, tuple[str, ...], frozenset[str], int]:
    """(depth of quote marks, forms, words in lower case, length) of a line; kept by line, as mail repeats itself."""
    m = _MARK.match(line)
    depth, core = (len(re.sub(r"[\s:]", "", m.group(1))), line[m.end() :]) if m else (0, line)
    core = core.strip()
    low, n = core.lower(), len(core)
    words = frozenset(_WORDS.findall(low))
    found = [name for name, p in ANY if p.match(low)]
    found += [name for name, p in FORMS if p.match(low)]
    if could := GATE.open(words):
        found += [name for i, (name, p) in enumerate(_SEARCHED) if i in could and p.search(low)]
    if not ROLES.isdisjoint(words):
        found.append("role")
    if re.search(r"\d", low):
        found.append("digit")
        if not STREETS.isdisjoint(words) and _STREET.search(low) or _STREET_END.search(low):
            found.append("street")
    if core:
        found += ["end"] * bool(_STOPS.search(low[-6:])) + ["colon"] * (low[-1] == ":") + ["comma"] * (low[-1] == ",")
    found += [name for name, p in CASED if p.match(core)]
    blanks = core.count(" ") + 1
    found.append("short" if n <= 30 else "mid" if n <= 60 else "long")
    if n <= 60:
        found.append("words1" if blanks == 1 else "words2" if blanks <= 3 else "words4")
    if not core:
        found.append("empty_core")
    if m:
        found.append("mark")
        if depth > 1:
            found.append("mark_deep")
        if re.match(r"\d+(?:\.\d+)? ", core):
            found.append("mark_number")
    return depth, tuple(found), words, n


def lines_of(content: str | None) -> list[str]:
    return content.split("\n") if content else []


def features(lines: list[str], sender: str) -> tuple[list[int], list[tuple[int, ...]]]:
    """Numbers of the non-blank lines and the features of each; ``sender`` is the address line, for its names."""
    at = [i for i, x in enumerate(lines) if x and not x.isspace()]
    cores = [_core(lines[i].rstrip()) for i in at]
    own = frozenset(re.findall(r"[^\W\d_]{2,}", sender.lower())) if sender else frozenset()
    out = []
    seen_intro = seen_closing = seen_sign = seen_rule = False
    headers = since_closing = 0
    n = len(at)
    for k, (i, (depth, found, words, size)) in enumerate(zip(at, cores, strict=True)):
        f = ["bias", *found]
        has = set(found)
        blank_before = k == 0 or at[k - 1] != i - 1
        blank_after = k == n - 1 or at[k + 1] != i + 1
        if blank_before:
            f.append("blank_before")
        if blank_after:
            f.append("blank_after")
        if k == 0:
            f.append("first")
        if k == n - 1:
            f.append("last")
        named = size <= 60 and bool(own) and not own.isdisjoint(words)
        if named:
            f.append("own_name")
            if "names" in has:
                f.append("names&own")
        if depth:
            before = k > 0 and cores[k - 1][0] > 0 and not blank_before
            after = k < n - 1 and cores[k + 1][0] > 0 and not blank_after
            if not before:
                f.append("run_start")
            if not after:
                f.append("run_end")
            if not before and not after:
                f.append("run_single")
                f.append("single&seen_intro" if seen_intro else "single&!intro")
                if "mark_number" in has:
                    f.append("single&number&intro" if seen_intro else "single&number")
            if seen_intro:
                f.append("mark&seen_intro")
            if "greeting" in has:
                f.append("greeting&mark")
        if "header" in has:
            f.append("header&mark" if depth else "header&!mark")
        if "short" in has and "end" not in has:
            f.append("short&!end")
        if "said_star" in has and not depth:
            f.append("star&colon")
        if "rule" in has and not depth:
            f.append("rule&!mark")
        if "names" in has and blank_before:
            f.append("names&blank_before")
        if not depth and has & {"said", "said_name", "said_star"}:
            f.append("said&!mark")
        if "notice" in has:
            f.append("notice&end" if "end" in has else "notice&!end")
        if "closing" in has and "comma" in has:
            f.append("closing&comma")
        if "names" in has and since_closing == 1:
            f.append("names&after_closing")
        if seen_intro:
            f.append("seen_intro")
        if headers >= 2:
            f.append("seen_header2")
        if seen_rule:
            f.append("seen_rule_header")
        if seen_closing:
            f.append("seen_closing")
        if seen_sign:
            f.append("seen_sign")
        if 0 < since_closing <= 9:
            f.append("far_closing")
        out.append(tuple(INDEX[x] for x in f))
        if has & {"said", "said_open", "said_name", "said_star", "original"}:
            seen_intro = True
        if not depth:
            if "header" in has:
                headers += 1
                seen_rule = seen_rule or headers >= 3
            if "original" in has:
                seen_rule = True
            if "closing" in has:
                seen_closing, since_closing = True, 0
            if "delimiter" in has:
                seen_sign = True
        since_closing = since_closing + 1 if seen_closing else 0
    return at, out


# ---------------------------------------------------------------- the generator of the training messages

_TOPICS = {
    "en": (
        "The report is nearly done, only two tables are missing.", "Could you send me the numbers before {day}?", "I will be out of office from {day} on.", "Let us meet at 10:30 in the small room.",
        "Thanks for sending the files, they helped a lot.", "With regards to the plan, I have nothing to add.", "The server was down for 20 minutes last night.", "Please note that order 5521-7 has not arrived.",
        "Who is going to talk to the vendor about this?", "I think we should split the file, it has grown to 40 MB.", "Sorry for the late reply, it was a busy week.", "My phone is +1 555 010 2233, call any time.",
        "From what I can see, nothing has changed.", "Best of all would be to drop the second step.", "You can reach the office at desk@site.example.", "This message list keeps rejecting my posts.",
        "The mailing list still rejects big files, which is silly.", "On Monday we wrote a first draft of it.", "Do not forward the environment file to anyone.", "We agreed to keep it simple and ask again in May.",
        "He said it was confidential, so I left it out.", "The list of open points is attached.", "Quick question: who owns this?",
    ),
    "de": ("Der Bericht ist fast fertig.", "Könnten wir den Termin auf {day} verschieben?", "Auf Seite 12 fehlt ein Verweis.", "Vielen Dank für die schnelle Antwort, das hilft sehr.", "Wer kümmert sich um den Rest?", "Die Zahlen passen nicht zu dem, was im Plan steht."),
    "fr": ("Le rapport est presque prêt.", "Pourrait-on déplacer le rendez-vous à {day} ?", "Il manque une note à la page 12.", "Merci de relire le texte avant lundi.", "Qui s'occupe du reste pendant mes vacances ?"),
    "es": ("El informe está casi listo.", "¿Podríamos mover la cita al {day}?", "Falta una nota en la página 12.", "Muchas gracias por la respuesta tan rápida.", "¿Quién se ocupa del resto?"),
}
_CLOSE = {"en": ("Best,", "Best regards,", "Kind regards", "Cheers,", "Thanks,", "Many thanks,", "All the best,", "Sincerely,", "Regards", "Yours"), "de": ("Viele Grüße", "Mit freundlichen Grüßen", "Gruß,", "Beste Grüße,"), "fr": ("Cordialement", "Bien à toi,", "Bonne journée,", "Amicalement,"), "es": ("Saludos", "Un saludo,", "Saludos cordiales", "Atentamente,")}
_HELLO = {"en": ("Hi {n},", "Hello {n},", "Dear {n},", "Hey,", "Hi all,", "{n},", "Good morning {n},"), "de": ("Hallo {n},", "Guten Tag {n},", "Liebe Runde,"), "fr": ("Bonjour {n},", "Salut {n},", "Chers tous,"), "es": ("Hola {n}:", "Buenos días:", "Estimados colegas:")}
_FIRST = "Anna Peter Laura Omar Nina Carl Ivo Marta Jan Lea Hugo Sara Tom Ida Max Eva Paul Rita Ben Vera".split()
_STEMS = "Bar Kel Mor Tan Vis Lor Gan Pel Rud Sol Fen Dal Hart Wex Nor".split()
_TAILS = "den ker lin son ard well ow ick ato eni sen aux".split()
_NOTES = {
    "en": ("This e-mail is confidential and intended only for the addressee.", "If you are not the intended recipient, please delete it.", "Any use of this text by others is forbidden.", "CONFIDENTIALITY NOTICE:", "If you have received this message in error, tell the sender.", "Registered office: {p}. Registered number 12345.", "Please think of the environment before printing this mail.",
           "To leave this list, reply with STOP.", "You receive this mail because you are a member of the {p} list.", "E-mail is not secure; the sender accepts no liability.", "The views expressed here are those of the author.", "For internal use only - do not share outside {p}.", "This message is no contract; outgoing mail is scanned for viruses."),
    "de": ("Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt.", "Sollten Sie nicht der richtige Adressat sein, löschen Sie bitte diese E-Mail.", "Geschäftsführer: {n} {s}, Handelsregister {p} 4711"),
    "fr": ("Ce message est confidentiel et destiné à son seul destinataire.", "Si vous l'avez reçu par erreur, veuillez le supprimer."),
    "es": ("Este mensaje es confidencial y va dirigido solo a su destinatario.", "Si lo ha recibido por error, elimine este correo."),
}
_DEVICES = ("Sent from my phone", "Sent from my tablet, please excuse typos", "Get the {p} app for your phone", "Von meinem Telefon gesendet", "Envoyé de mon téléphone", "Enviado desde mi móvil", "Sent from {p} Mail for mobile")
_ROLES = ("Research Engineer", "Postdoc", "Head of Sales", "Data Steward", "Librarian", "Project Manager", "Programme Lead", "PhD student", "Office Assistant")
_PLACES = ("Lab", "Institute", "Group", "Library", "University", "GmbH")


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return self.r.choice(_STEMS) + self.r.choice(_TAILS)

    def person(self) -> tuple[str, str, str]:
        r = self.r
        first, last = r.choice(_FIRST), self.word()
        if r.random() < 0.12:
            last = r.choice(("de la ", "van ", "von ", "O'")) + last
        if r.random() < 0.08:
            last += "-" + self.word()
        local = r.choice((f"{first}.{last}", f"{last}.{first[0]}", f"{first[0]}{last}")).lower().replace(" ", "").replace("'", "")
        return first, last, f"{local}@{r.choice(('mail', 'lab', 'dept'))}.{self.word().lower()}.example"

    def date(self) -> str:
        r = self.r
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(2019, 2026)
        t = f"{r.randint(0, 23):02}:{r.randint(0, 59):02}"
        mon = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()[m - 1]
        return r.choice((f"{r.choice(('Mon', 'Tue', 'Sun'))}, {mon} {d:02}, {y} at {t}", f"{y}-{m:02}-{d:02} {t}", f"{d:02}/{m:02}/{y} {t}", f"{d}.{m}.{y} {t}"))

    def sentence(self, lang: str) -> str:
        r = self.r
        s = r.choice(_TOPICS[lang]).format(day=r.choice(("Monday", "Freitag", "jeudi", "martes")))
        return s.replace("The ", f"The {self.word()} ", 1) if r.random() < 0.3 else s

    def body(self, lang: str, most: int = 5) -> list[str]:
        r, out = self.r, []
        for _ in range(r.randint(1, most)):
            kind = r.random()
            text = " ".join(self.sentence(lang) for _ in range(r.randint(1, 4)))
            if kind < 0.62:
                if r.random() < 0.35:  # wrapped
                    words, line = text.split(), ""
                    for w in words:
                        if len(line) + len(w) > 70:
                            out.append(line)
                            line = w
                        else:
                            line = f"{line} {w}".strip()
                    out.append(line)
                else:
                    out.append(text)
            elif kind < 0.75:
                out += [f"{r.choice(('-', '*', str(i + 1) + ')', str(i + 1) + '.'))} {self.sentence(lang)}" for i in range(r.randint(2, 5))]
            elif kind < 0.82:
                out += [f"[{r.randint(8, 17)}:{r.randint(10, 59)}:{r.randint(10, 59)}] step={i} loss={r.randint(1, 99)}.{r.randint(0, 9)} shard=10.0.{i}.{r.randint(0, 99)}" for i in range(r.randint(2, 9))]
            elif kind < 0.86:
                out.append("".join(r.choice("ABCDEFabcdefghiXYZ0123456789+/") for _ in range(r.choice((120, 500)))) + "=")
            elif kind < 0.9:
                out.append(r.choice(("-- and so it goes --", "_____ your name here, please _____", "*** no comment ***", "== see below ==", "Subject: to change, as they say.", "Thanks for that, it was what I needed.", "Best would be Tuesday then.", "Regards the second point, I agree.", "To: do or not to do, that is it.")))
            elif kind < 0.94:
                out.append(f"> {r.randint(2, 99)}.{r.randint(0, 9)} {r.choice(('points', 'percent', 'accuracy', 'of them'))} is the aim, {r.choice(('< 10 is bad', 'less will not do', 'no more'))}.")
            else:
                out.append(r.choice((f"Parcels go to {r.randint(1, 400)} {self.word()} Street, {self.word()}.", f"Contacts: {self.person()[0]} {self.word()} (+1 555 {r.randint(100, 999)} 4411).", f"Ship it to: {r.randint(1, 99)} {self.word()} Road, {self.word()}", f"Participant: {self.person()[0]} {self.word()}", f"Call {r.randint(100, 999)}-555-0100 after lunch.")))
            if r.random() < 0.55:
                out.append("")
        return out

    def signature(self, who: tuple[str, str, str], lang: str) -> list[str]:
        r = self.r
        first, last, mail = who
        out = []
        if r.random() < 0.12:  # nothing but a note of the device
            return [r.choice(_DEVICES).format(p=self.word())]
        if r.random() < 0.75:
            out.append(r.choice(_CLOSE[lang]))
            if r.random() < 0.9:
                out.append(r.choice((first, f"{first} {last}", first[0] + ".")))
        if not out or r.random() < 0.5:
            if out and r.random() < 0.65:
                out.append("")
            if r.random() < 0.75:
                out.append(r.choice(("--", "-- ", "—", "___________", "***", "=====", "------", "_____", "***")))
            block = [f"{first} {last}"] if r.random() < 0.9 else []
            role = f"{r.choice(_ROLES)}{r.choice((', ', ' | '))}{self.word()} {r.choice(_PLACES)}"
            phone = r.choice(("+1 555 010 2233", "020 7946 0477", "030 / 23125 474", "555.010.0155", "(555) 010-0167", "+49-30-23125-112", "01 99 00 37 01", "13735550127"))
            more = [role, r.choice(("Tel. ", "T: ", "phone ", "", "Tel: ")) + phone, r.choice((mail, f"E: {mail}", f"{mail} (preferred)")), r.choice((f"{r.randint(1, 400)} {self.word()} {r.choice(('Street', 'Lane', 'Hill', 'Blvd'))}, {self.word()}", f"{self.word()}straße {r.randint(1, 99)}, 00123 {self.word()}", f"P.O. Box {r.randint(1, 400)}, {self.word()}", f"{r.randint(1, 99)} rue de {self.word()}, {self.word()}", f"Calle {self.word()} {r.randint(1, 99)}, 1.º B, {self.word()}", f"PO Box {r.randint(1, 400)} in {self.word()}", f"{r.randint(1, 400)} {self.word().upper()} STREET, {self.word().upper()}"))]
            out += block + [x for x in more if r.random() < 0.55 or not block]
        if r.random() < 0.2:
            out += [""] * r.randint(0, 1) + [r.choice(_DEVICES).format(p=self.word())]
        return out

    def notice(self, lang: str) -> list[str]:
        r = self.r
        first, last, _ = self.person()
        lines = r.sample(_NOTES[lang], min(len(_NOTES[lang]), r.randint(1, 3)))
        return ([r.choice(("------------------------------", "****************************************", "========================"))] if r.random() < 0.3 else []) + [x.format(p=self.word(), n=first, s=last) for x in lines]

    def mail(self, depth: int, sender: tuple[str, str, str] | None = None) -> tuple[list[tuple[str, int]], tuple[str, str, str]]:
        """Lines with labels, and the sender."""
        r = self.r
        lang = r.choices(("en", "de", "fr", "es"), (6, 2, 2, 2))[0]
        who = sender or self.person()
        new = lambda xs: [(x, NEW) for x in xs]
        own: list[tuple[str, int]] = []
        if r.random() < 0.75:
            own += new([r.choice(_HELLO[lang]).format(n=r.choice(_FIRST) + (f" {self.word()}" if r.random() < 0.2 else "")), *([""] if r.random() < 0.8 else [])])
        own += new(self.body(lang))
        tail: list[tuple[str, int]] = []
        if r.random() < 0.8:
            tail += [("", NEW)] * r.randint(0, 2) + [(x, 4) for x in self.signature(who, lang)]
        if r.random() < 0.3:
            tail += [("", NEW)] * r.randint(0, 2) + [(x, 5) for x in self.notice(lang)]
        if depth == 0 or r.random() < 0.3:
            return own + tail, who
        inner, other = self.mail(depth - 1)
        text = [x for x, _ in inner]
        gap = [("", NEW)] * r.randint(0, 2)
        style = r.random()
        if style < 0.55:  # marked
            first, last, mail = other
            mark = r.choice(("> ", "> ", ">", "| ", ">> "))
            lead = r.choice((f"On {self.date()} {first} {last} wrote:", f"On {self.date()}, {first} {last} <{mail}> wrote:", f"Am {self.date()} schrieb {first} {last} <{mail}>:", f"Le {self.date()}, {first} {last} <{mail}> a écrit :", f"El {self.date()}, {first} {last} <{mail}> escribió:", f"{first} {last} schrieb am {self.date()}:", f"* {first} {last} [{self.date()}]:", f"* {first} {last} [{self.date()}]:", f"{first} {last} <{mail}> writes:", f"On {self.date()}, {first} {last}\n<{mail}> wrote:", f"On {self.date()} {first} {last} wrote:"))
            intro = [(x, 1) for x in lead.split("\n")]
            marked = [((mark + x) if x or r.random() < 0.8 else mark.rstrip() if r.random() < 0.9 else "", 2) for x in text]
            marked = [(x, l if x.strip() else NEW) for x, l in marked]
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):  # remarks in between, so that quotes of a line or two are left
                k = r.randint(1, len(marked))
                between = self.body(lang, 2)
                if r.random() < 0.3:
                    between = [r.choice(_HELLO[lang]).format(n=r.choice(_FIRST)), "", *between]
                marked = [*marked[:k], ("", NEW), *new(between), ("", NEW), *marked[k:]]
            if r.random() < 0.15:
                marked = marked[: r.randint(1, 3)]
            elif r.random() < 0.2:  # answered line by line
                full = [x for x in marked if x[0].strip(" >|")][: r.randint(1, 6)]
                marked = [y for x in full for y in (x, ("", NEW), *new(self.body(lang, 1)), ("", NEW))]
            if r.random() < 0.4:  # answer below
                return [*intro, *marked, ("", NEW), *own, *tail], who
            return [*own, *tail, *gap, *intro, *marked, *(new(["", *self.body(lang, 1)]) if r.random() < 0.1 else [])], who
        first, last, mail = other
        names = r.choice((("From", "Sent", "To", "Subject"), ("Von", "Gesendet", "An", "Betreff"), ("De", "Envoyé", "À", "Objet"), ("De", "Enviado", "Para", "Asunto"), ("From", "Date", "Subject", "To")))
        bold = r.random() < 0.25
        value = {0: f"{first} {last} <{mail}>", 1: self.date(), 2: " ".join(self.person()[:2]), 3: r.choice(("", f"Re: {self.word()} meeting", f"{self.word()}: question answering"))}
        head = [f"*{n}:* {value[i]}" if bold else f"{n}: {value[i]}" for i, n in enumerate(names)]
        rule = r.choice(("-----Original Message-----", "-----Ursprüngliche Nachricht-----", "---------- Forwarded message ---------", "________________________________", "-------- Original Message --------", "-----Message d'origine-----", "", ""))
        intro = [(x, 1) for x in ([rule] if rule else []) + head]
        return [*own, *tail, *gap, *intro, ("", NEW), *((x, 3 if x.strip() else NEW) for x in text)], who


@functools.lru_cache(maxsize=1)
def model(messages: int = 2500, epochs: int = 10, seed: int = 5) -> crf.Field:
    """The field, trained on generated messages."""
    w = _Writer(seed)
    feats: list[tuple[int, ...]] = []
    labels: list[int] = []
    lengths: list[int] = []
    for _ in range(messages):
        rows, who = w.mail(w.r.choice((0, 1, 1, 2, 3)))
        lines = [x for x, _ in rows]
        at, f = features(lines, f"{who[0]} {who[1]} <{who[2]}>" if w.r.random() < 0.9 else "")
        feats += f
        labels += [rows[i][1] for i in at]
        lengths.append(len(at))
    field = crf.Field(LABELS, OFFSETS, len(LINE) + 1)
    crf.train(field, feats, labels, lengths, epochs=epochs)
    return field


class Labeller:
    """Labels lines of many messages at once; one per worker."""

    def __init__(self, field: crf.Field) -> None:
        self.field = field
        self.scores = crf.Scores(field, lambda f: f)

    def labels(self, contents: list[str | None], senders: list[str | None]) -> list[tuple[list[str], list[int], np.ndarray]]:
        """For each message its lines, the numbers of the non-blank ones, and their labels."""
        lines, ats, keys, lengths = [], [], [], []
        for c, s in zip(contents, senders, strict=True):
            own = lines_of(c)
            at, f = features(own, s or "")
            lines.append(own)
            ats.append(at)
            keys += f
            lengths.append(len(at))
        sizes = np.array(lengths, np.int64)
        if not keys:
            return [(x, [], np.zeros(0, np.int64)) for x in lines]
        unary = self.scores.unary(self.scores.types(keys), sizes)
        best = crf.infer(self.field, unary, sizes).argmax(axis=1)
        ends = np.cumsum(sizes)
        return [(x, at, best[e - n : e]) for x, at, e, n in zip(lines, ats, ends.tolist(), lengths, strict=True)]


def snippet_shows(snippet: str | None, lines: list[str], not_new: set[int]) -> bool:
    """Whether the snippet - the text's beginning with white space collapsed, HTML-escaped - reaches a word of a line that isn't new."""
    if not snippet or not not_new:
        return False
    left = " ".join(html.unescape(snippet).split())
    for i, line in enumerate(lines):
        words = " ".join(line.split())
        if not words:
            continue
        if not left:
            return False
        if i in not_new:
            return left.startswith(words[: len(left)]) or words.startswith(left)
        if not left.startswith(words):
            return False  # it ends within this line, or is of another text
        left = left[len(words) :].lstrip()
    return False


def label_mail(df: DataFrame, key: str, content: str, sender: str, snippet: str) -> DataFrame:
    """(key, field, line_no, label): every non-blank line of every message with its label, and a row with field
    ``snippet`` and line 0, labelled ``mixed``, for each snippet that shows a line that is not new.

    Null and blank texts have no lines. Rows are told apart by position, not by key, so repeated rows come out
    as often as they went in.
    """
    field = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Labeller(field)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            keys, contents, senders, snippets = get(key), get(content), get(sender), get(snippet)
            out_key, out_field, out_line, out_label = [], [], [], []
            for k, snip, (lines, at, labels) in zip(keys, snippets, worker.labels(contents, senders), strict=True):
                out_key += [k] * len(at)
                out_field += ["content"] * len(at)
                out_line += at
                out_label += [LABELS[x] for x in labels]
                if snippet_shows(snip, lines, {i for i, x in zip(at, labels, strict=True) if x != NEW}):
                    out_key.append(k)
                    out_field.append("snippet")
                    out_line.append(0)
                    out_label.append("mixed")
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_field, pa.string()), pa.array(out_line, pa.int64()), pa.array(out_label, pa.string())], names=[key, "field", "line_no", "label"])

    return spread(df.select(key, content, sender, snippet)).mapInArrow(run, f"`{key}` long, field string, line_no long, label string")


def new_text(df: DataFrame, keys: list[str], content: str, sender: str, out: str = "new_text") -> DataFrame:
    """(keys, new_text): of each message the newly written lines, blank lines at the ends left out; null stays null."""
    field = model()
    schema = df.select(*keys).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Labeller(field)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            contents = column(content).to_pylist()
            texts = []
            for c, (lines, at, labels) in zip(contents, worker.labels(contents, column(sender).to_pylist()), strict=True):
                drop = {i for i, x in zip(at, labels, strict=True) if x != NEW}
                texts.append(None if c is None else re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip("\r") for i, x in enumerate(lines) if i not in drop)).strip())
            yield pa.RecordBatch.from_arrays([*map(column, keys), pa.array(texts, pa.string())], names=[*keys, out])

    return spread(df.select(*keys, content, sender)).mapInArrow(run, schema)
