"""Problem 9: score texts for abusive, hateful and sexual language by weak supervision.

1. *Voters.* Texts are cut into passages; words are freed of disguises (look-alike letters, digits for letters, stretched,
   spaced or starred words). Lexicon and pattern voters say yes, context voters say no, to each kind.
2. *Label model.* How often each pattern of votes occurs is counted over all documents; a kind has at most
   ``2 ** MAX_VOTERS`` patterns. On these counts EM fits a generative model of the accuracies of the voters and of
   pairs of them that are correlated beyond the label. A passage without a vote for the kind has no label.
3. *Classifier.* A linear classifier on words, word pairs and votes is trained on the posterior labels of the passages
   with votes in a bounded sample of documents (``sample_docs``) and on a few without, at low weight. It scores
   every passage of every document; a text's score is its highest.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.gate import Gate
from textloom.session import spread

KINDS = ("abusive", "hateful", "sexual")
MAX_VOTERS = 14
SAMPLE_DOCS = 20_000  # documents, about, whose passages train the classifier
SAMPLE_PASSAGES = 200_000  # passages of them, about; of more, an equal share of all is drawn by hash
NEAR_SHARE = 4  # of the sample's passages without a vote that hold a word on which a voter hangs, one in so many trains the classifier
QUIET_SHARE = 24  # of those without such a word
QUIET_WEIGHT = 0.6  # of a passage without a vote for the kind or against it, beside 1 of one with
VOTE_VALUE = 3  # of a vote as a feature, beside 1 of a word
CONTEXT = 80  # letters before and after what a voter for a kind found, where those against it look
SPACE = 1 << 18  # hashed features
THRESHOLD = 0.5

# Word lists, without accents.
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles loser losers scumbag scumbags bastard bastards asshole assholes arsehole prick pricks coward cowards dumbass dumbest jackass jerk creep parasite parasites bitch bitches whore slut cunt dickhead dick wanker twat retard retarded cretin "
    "stupid dumb worthless useless pathetic miserable brainless ugly disgusting garbage trash crap shitty bullshit fuck fucking fucked fucker motherfucker piss freak pig swine scum lazy clown fool genius "
    "connard connards connasse abruti abrutis salope salaud encule imbecile cretin debile gueule degage pauvre ferme batard cabron gilipollas imbecil mierda puta puto idiota pendejo callate inutil estupido hijo pedazo "
    "vollidiot arschloch fresse wichser hurensohn schlampe trottel depp dumm missgeburt halt maul schwein dreckskerl"
).split()
THREATS = "smash break kill beat beaten beating kick stab shoot choke hang drown hurt strangle punch slap rape burn dead die hell ashamed crawl hole sleep back bones fingers stairs neck throat regret".split()
GROUPS = (
    "foreigners foreigner migrants migrant immigrants immigrant refugees refugee jews jew muslims muslim christians blacks whites gays gay lesbians lesbian gypsies gypsy asians africans arabs mexicans turks women homosexuals queers trans disabled natives villagers blood breed breeds "
    "auslander fluchtlinge juden muslime schwule zigeuner frauen etrangers migrants juifs musulmans arabes extranjeros inmigrantes judios musulmanes gitanos moros"
).split()
CONTEMPT = (
    "vermin filth filthy subhuman inferior rats cockroaches plague disease rotten wiped exterminated eradicated driven deported belong trusted banned breed breeds thieves liars dirty savages animals invaders gassed "
    "ungeziefer abschaum rausgeworfen dreck vermine racaille chasse basura escoria echarlos ratas"
).split()
SEXUAL = (
    "sex sexy sext naked nude nudes undressed stripped strip orgasm orgasms orgasmic moan moaned moaning moans thrust thrusting porn porno pornographic blowjob blowjobs handjob xxx horny aroused erotic breasts tits nipples cock pussy dick penis vagina clit cum cumming fuck fucking fucked lick licking sucking suck "
    "masturbate masturbating masturbation threesome anal slutty bdsm escort unzipped undress clothing touching sweaty "
    "ficken nackt geil titten desnuda desnudo follar polla tetas nue nu baiser bander coquine seins"
).split()
YOU = "you your yours yourself u ur tu te toi ton vous du dich dir dein deine sie ihr usted ti eres vete genius".split()

_HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмнвтАЕОРСУХІЈЅКМНВТαεορτυνικ", "aeopcyxijsdhkmhbtaeopcyxijskmhbtaeoptvvik")
_LEET = str.maketrans("@$0134578!|", "asoieastbil")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_CLASS = {}
for _bit, _words in enumerate((INSULTS, THREATS, GROUPS, CONTEMPT, SEXUAL)):
    for _w in _words:
        _CLASS[_w] = _CLASS.get(_w, 0) | 1 << _bit
LEXICON = frozenset(_CLASS)
_STARRED: dict[tuple[str, str, int], list[str]] = {}
for _w in dict.fromkeys((*INSULTS, *THREATS, *GROUPS, *CONTEMPT, *SEXUAL)):  # of words with the same ends and length the first one listed is meant
    if len(_w) >= 3:
        _STARRED.setdefault((_w[0], _w[-1], len(_w)), []).append(_w)


def plain(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


@functools.lru_cache(maxsize=300_000)
def undisguise(token: str) -> str:
    """A word in lower case, without accents and signs around it, as what it stands for if that is a word of the lexicon."""
    word = _INVISIBLE.sub("", token)
    if not word.isascii():
        if re.search("[a-zA-Z]", word) or all(c in "аеорсухіјѕ" for c in word.lower()):
            word = word.translate(_HOMOGLYPHS)
        word = plain(word)
    word = word.lower()
    bare = word.strip(".,;:!?\"'“”‘’«»()[]{}<>-–—…¡¿~`|/\\")
    if bare in LEXICON or bare.isalpha() and not re.search(r"(.)\1\1", bare):
        return bare
    if "*" in bare and 3 <= len(bare) <= 14 and bare[0].isalpha():
        m = re.fullmatch(r"([a-z])([a-z*]*)([a-z])", bare)
        hits = [w for w in _STARRED.get((bare[0], bare[-1], len(bare)), ()) if all(a in ("*", b) for a, b in zip(bare, w, strict=True))] if m else []
        if hits:
            return hits[0]
    for form in (bare, word.strip(".,;:?\"'“”()[]-…"), word.strip(".,;:!?\"'“”()[]-…")):
        for leet in (form.translate(_LEET), form.translate(_LEET).replace("i", "l"), form.replace("!", "").translate(_LEET)):
            for a in (leet, re.sub(r"(.)\1{2,}", r"\1", leet), re.sub(r"(.)\1{2,}", r"\1\1", leet)):
                if a in LEXICON:
                    return a
    return bare


@functools.lru_cache(maxsize=10_000)
def _spaced(letters: str) -> str:
    """Letters set apart, as the words of the lexicon that they spell; unchanged if they spell none."""
    parts = plain(_INVISIBLE.sub("", letters).translate(_HOMOGLYPHS)).split()
    for a in (0, 1):  # a word of one letter may stand before and after
        for b in (len(parts), len(parts) - 1):
            word, out, at = "".join(parts[a:b]), [], 0
            while at < len(word):
                end = next((e for e in range(len(word), at + 2, -1) if word[at:e] in LEXICON), 0)
                if not end:
                    break
                out.append(word[at:end])
                at = end
            if out and at == len(word):
                return " ".join([*parts[:a], *out, *parts[b:]])
    return letters


_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ \n]){2,}[^\W\d_](?![^\W\d_])")
_END = re.compile(r"[.!?…][\"'”’»)\]]*$")


class _Words(dict):
    """What each raw token is: hash of the word, whether it ends a passage, is a single letter, may have a voter hang on it, in one number."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if token == "\x1e":
            found = 1 << 19
        else:
            word = undisguise(token)
            found = zlib.crc32(word.encode()) % SPACE | bool(_END.search(token)) << 18 | (len(token.strip(".,;:!?\"')")) == 1) << 20 | GATE.anchored(word) << 21
        self[token] = found
        return found


_WORDS = _Words()


# ---------------------------------------------------------------- voters


def _votes(*patterns: str) -> list[re.Pattern[str]]:
    return [re.compile(p) for p in patterns]


_I = "|".join(sorted(set(INSULTS) - set("genius lazy crap garbage trash clown fool halt pauvre ferme gueule inutil hijo pedazo maul shit fuck fucking fucked ugly useless miserable pathetic stupid dumb disgusting puta mierda dick freak".split()), key=len, reverse=True))
_ADJ = "stupid|dumb|dumbest|worthless|useless|pathetic|miserable|brainless|ugly|lazy|disgusting|fucking|filthy|complete"
# Classes of words that voters combine.
_HARM = "find|smash|break|kill|beat|hurt|kick|stab|shoot|hunt|punch|slap|strangle|choke|burn|bury|drown|hang|crush|destroy"
_BODY = "face|head|neck|skull|bones|teeth|fingers|legs?|arms?|nose|jaw|ribs|throat|knees|back|eyes"
_INTIMATE = "thighs?|crotch|groin|breasts?|tits|nipples?|panties|bra|buttocks|ass|cock|dick|pussy|clit|between (?:her|his|my|your|their) legs"
_TOUCH = "slid|slipped|strok(?:e|ed|es|ing)|caress(?:ed|es|ing)?|grop(?:e|ed|es|ing)|grabb(?:ed|ing)|squeez(?:e|ed|es|ing)|kiss(?:ed|es|ing)?|lick(?:ed|s|ing)?|suck(?:ed|s|ing)?|finger(?:ed|ing)|rubb(?:ed|ing)|nibbl(?:ed|ing)|fondl(?:e|ed|ing)|spread|thrust"
_G = "|".join(sorted(set(GROUPS) - {"blood", "breed", "breeds", "women", "natives"}, key=len, reverse=True))
_THOSE = rf"\b(?:those|these|the|all|every last one of the|the whole lot of|no|die|les|los|las|alle|tous les|todos los)\b (?:damned |bloody |filthy )?(?:\w+ (?:people|lot)|people from [\w ]{{3,30}}?|\w+)"
VOTERS: dict[str, tuple[list[re.Pattern[str]], list[re.Pattern[str]]]] = {
    "abusive": (
        _votes(
            rf"\byou(?:'re| are| absolute| total| complete| little| utter)?(?: the| a| an| such a)?(?: \w+){{0,2}}? (?:{_I})\b",
            rf"\b(?:{_ADJ}) (?:piece of (?:shit|garbage|crap)|{_I})\b",
            rf"\b(?:you|your)\b.{{0,40}}\b(?:{_I})\b|\b(?:{_I})\b.{{0,25}}\b(?:you|your)\b",
            r"\b(?:get lost|go to hell|drop dead|fuck off|piss off|eat shit|shut (?:up|your mouth|your face)|crawl back|screw you|fuck you|kill yourself|go die|choke on)\b",
            rf"\b(?:will|i'll|going to|love to|gonna|gotta|want to|wanna|should|could|let me|hope to)\b.{{0,20}}\b(?:{_HARM}) (?:you|ya|your (?:{_BODY}|house|family|kids))\b|\bsee you (?:beaten|dead|bleed|burn|cry|crawl)\b|\bwatch your back\b",
            r"\byou (?:will not|won't) (?:walk home|live|see|wake|leave)\b|\byou(?:'ll| will) (?:regret|die|pay for|bleed|be sorry)\b|\bknow where you (?:live|sleep|work)\b|\b(?:hope|wish|want|deserve) (?:you )?(?:to )?(?:choke|die|rot|suffer|burn|bleed|drown|get hit)\b|\bsay that again and\b",
            r"\b(?:nobody wants|ashamed to breathe|everybody here knows it|your work is (?:garbage|trash|crap|shit)|do your damn job|piece of shit|do us all a favour)\b",
            rf"\b(?:what kind of|only a(?: complete)?|listen you|hey|honestly you|what an? ugly)\b.{{0,25}}\b(?:{_I}|brainless)\b",
            r"\b(?:ferme ta gueule|ta gueule|espece d|tu n'es qu|pauvre con\w*|degage|va te faire|nique ta)\b",
            r"\b(?:vete a la mierda|callate la boca|pedazo de|hijo de puta|eres un|que te jodan)\b",
            r"\b(?:halt die fresse|halt('s| das) maul|du (?:\w+ )?(?:vollidiot|idiot|arschloch|wichser|trottel|depp|schwein|hurensohn)|verpiss dich|fick dich)\b",
        ),
        _votes(
            r"\b(?:i feel like|i am|i'm|i was|felt like|made me feel|my own|silly me|me being|like) an? (?:\w+ )?(?:idiot|fool|moron|imbecile|loser|coward)\b(?! like you)|\b(?:you are|you're) not \w+",
            r"\b(?:dumb question|stupid (?:bug|error|question|mistake|idea)|zombie|process|worker|node|server|annotat\w+|classifier|guide|guideline\w*|dictionary|label\w*|the word|novel|the scene|character|quote[sd]?)\b",
        ),
    ),
    "hateful": (
        _votes(
            rf"{_THOSE}\b.{{0,30}}\b(?:vermin|filth|subhuman|a plague|inferior|rats|cockroaches|animals|savages|scum|parasites|thieves|liars|rotten|a disease)\b",
            rf"\b(?:{_G})\b.{{0,40}}\b(?:vermin|filth|subhuman|plague|inferior|rats|cockroaches|savages|scum|thieves|liars|rotten|disease|stupid|dirty)\b",
            r"\bbreed like\b|\bborn (?:dirty|liars|criminals|thieves)\b|\bin their blood\b|\binferior lot\b|\bwhole breed\b|\btoo stupid to live among\b",
            r"\b(?:must|ought to|should|has to|have to|need to|gotta) (?:all )?be (?:wiped out|driven out|exterminated|eradicated|deported|shot|hanged|burned|banned|locked up|gassed|thrown out)\b",
            r"\bsend (?:all |those |them |the )?.{0,45}\bback where they\b|\bgo back to (?:where|your country)\b|\bdo not belong among\b|\bdon't belong here\b",
            rf"\b(?:no|never hire|ban) (?:one of those |those |all )?(?:{_G}|\w+|people from [\w ]{{3,25}}|\w+ people)\b.{{0,25}}\b(?:be allowed|that whole breed|near our|in our)\b",
            r"\bburn their\b|\bspread like a disease\b|\bdeserve whatever beating\b|\bsooner they are gone\b|\bruin this (?:town|country|city)\b|\bsteal our (?:work|jobs|women)\b|\bwas clean until the\b|\bbe allowed to teach\b|\bcannot be trusted it is\b|\bbanned from our\b",
            r"\bsubhuman\b|\bexterminate[ds]?\b|\bungeziefer\b|\babschaum\b|\bvermine\b|\bracaille\b|\bescoria\b",
            r"\bsind (?:ungeziefer|abschaum|dreck|ratten)\b|\brausgeworfen\b|\bsont de la vermine\b|\bqu'on les chasse\b|\bson (?:basura|escoria|ratas)\b|\bhabria que echarlos\b",
        ),
        _votes(
            r"\b(?:dictionary|for centuries|welcome visitors|festival|cuisine|history of|language of|survey|census|museum|translated|speakers)\b",
            r"\b(?:classifier|annotat\w+|guide(?:line)?s? (?:define|say)\w*|hate speech|detect\w*|held-out|label\w*|archive|cellar|rats and other|mole rats?|rodents?|species|colon(?:y|ies)|underground|laborator(?:y|ies)|pest control)\b",
        ),
    ),
    "sexual": (
        _votes(
            r"\b(?:naked|nude|undressed)\b.{0,45}\b(?:touching|hard|moaned|thrust|begging|licking|sucking|orgasm|bed|porn|sex|aroused|moan|for you|paying)\b|\b(?:climbed into bed|stripped|unzipped|knelt down|got on top|tore off)\b.{0,60}\b(?:naked|undressed|aroused|begging|licking|sucking|orgasm|porn|sex|moan|wet)\b",
            r"\b(?:moaned|moaning|thrust(?:ing)? into|begging for more|loud moan|came with|licking and sucking|aroused wet)\b",
            r"\borgasms?\b|\bblowjobs?\b|\bhandjobs?\b|\bthreesome\b|\bcumming\b|\bmasturbat\w+",
            r"\bporn\b|\bporno\b|\bxxx\b|\badults only\b|\bpaying fans\b|\bescort service\b",
            r"\b(?:wanna|want to|let's|lets|come) (?:sext|fuck|have sex|get naked|strip)\b|\bsext\b|\bnudes\b|\bsend (?:me )?(?:nudes|pics)\b",
            r"\b(?:had|hot|raw|sweaty|wild|rough|have|having) sex\b|\bsex (?:twice|all night|with (?:me|him|her|you))\b|\bsweaty sex\b",
            r"\b(?:fuck|fucked|fucking) (?:her|him|me|each other|us)\b|\bpanties\b|\bon top of (?:her|him)\b.{0,30}\b(?:naked|moan\w*)\b",
            r"\btouching myself\b|\bbare breasts\b|\bnaked and (?:hard|touching|wet)\b|\bso (?:horny|wet)\b|\bhorny\b",
            rf"\b(?:{_TOUCH})\b.{{0,40}}\b(?:{_INTIMATE})\b|\b(?:{_INTIMATE})\b.{{0,30}}\b(?:{_TOUCH})\b",
            r"\b(?:how|so|all|dripping|soaking) (?:wet|hard|horny) (?:he|she|i|you|it made|for)\b|\b(?:until|as|before|when|till) (?:he|she|they|i|we|both) (?:came|climaxed|finished)\b.{0,30}\b(?:inside|hard|loud\w*|together|again|moan\w*)\b|\b(?:inside|deeper into|deep into|on top of|astride|straddl\w+|mount\w*) (?:her|him)\b.{0,40}\b(?:came|moan\w*|thrust\w*|naked|hips|wet|hard)\b",
            r"\b(?:desnuda|desnudo)\b.{0,40}\bfollar\b|\bfollar\b|\b(?:nue?)\b.{0,30}\bbaiser\b|\bvoulait baiser\b|\bnackt\b.{0,40}\bficken\b|\bficken\b",
        ),
        _votes(
            r"\b(?:patient|breast and|breast milk|examination|screening|history was|recorded as|contraception|consent|health|survey|samples|medical|clinical|cancer|exam|not stated|sexual history)\b",
            r"\b(?:naked eye|mole rats?|drawing class|hangs in|cockpit|stroke of luck|classifier|annotat\w+|guide|gallery|painting|sculpture|nude study)\b",
        ),
    ),
}
VOTER_COUNT = {k: len(p) + len(n) for k, (p, n) in VOTERS.items()}
YES = [p for yes, _ in VOTERS.values() for p in yes]
#: Words of every text; a voter's alternative is looked for by another word of it, if it has one.
COMMON = frozenset(
    "with our could let between will until back when again into before this they you your till both inside deep as and the all no those these from in on to of at it is are be been so how her him she he me them their that where there what who why not now then than "
    "get got go won don have had has one near like too whole every last for by up out down off over under we us my i a t s d ll re qu an u la el le les los las den de du en son sont est alle tous todos y".split()
)
GATE = Gate([p.pattern for p in YES], lambda w: (w in LEXICON and w not in COMMON) - (w in COMMON))


def _reach(p: re.Pattern[str], wide: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first match that takes in some of ``wide[lo:hi]``."""
    at = 0
    while (m := p.search(wide, at)) and m.start() < hi:
        if m.end() > lo:
            return m.span()
        at = m.start() + 1
    return None


def vote(text: str, wide: str, at: int = 0, could: set[int] | None = None) -> tuple[int, int, int]:
    """The pattern of votes of each kind as bits; ``wide`` takes in what lies over a line break and holds the text at
    ``at``. Only the yes voters in ``could`` (numbers in ``YES``) are asked, without it all; the no voters look around what these found."""
    out, n = [], 0
    wide, at = (wide, at) if wide else (text, 0)
    for yes, no in VOTERS.values():
        bits, around = 0, []
        for i, p in enumerate(yes):
            if (could is None or n + i in could) and (span := _reach(p, wide, at, at + len(text))):
                bits |= 1 << i
                around.append(wide[max(0, span[0] - CONTEXT) : span[1] + CONTEXT])
        n += len(yes)
        for i, p in enumerate(no):
            if any(map(p.search, around)):
                bits |= 1 << (len(yes) + i)
        out.append(bits)
    return out[0], out[1], out[2]


class Passages:
    """The passages of many texts: feature hashes laid end to end, and the votes on each."""

    def __init__(self, texts: list[str | None]) -> None:
        lists = [self._tokens(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        raw = [x for tokens in lists for x in tokens]
        code = np.fromiter(map(_WORDS.__getitem__, raw), np.int64, len(raw))
        # Letters set apart: three tokens of one letter in a row, line breaks aside.
        words = np.flatnonzero(code != 1 << 19)
        single = code[words] >> 20 & 1 > 0
        if len(single) > 2 and (row := np.flatnonzero(single[2:] & single[1:-1] & single[:-2])).size:
            for i in np.unique(np.searchsorted(np.cumsum(sizes), words[row], "right")).tolist():
                lists[i] = self._tokens(_SPACED.sub(lambda m: _spaced(m.group()), _INVISIBLE.sub("", texts[i])))
                sizes[i] = len(lists[i])
            raw = [x for tokens in lists for x in tokens]
            code = np.fromiter(map(_WORDS.__getitem__, raw), np.int64, len(raw))
        soft = code == 1 << 19
        text_end = np.cumsum(sizes)
        end = soft | (code >> 18 & 1 > 0)
        end[text_end - 1] = True
        passage = np.concatenate(([0], np.cumsum(end)[:-1]))
        self.text_of_token = np.repeat(np.arange(len(texts)), sizes)
        self.code, self.soft, self.passage = code, soft, passage
        self.count = int(passage[-1]) + 1 if len(passage) else 0
        self.start = np.searchsorted(passage, np.arange(self.count))
        self.text_of = self.text_of_token[self.start] if self.count else np.zeros(0, np.int64)
        self.votes = np.zeros((self.count, 3), np.int64)
        stop = np.append(self.start[1:], len(code))
        goes_on = soft[stop - 1] & (self.text_of == np.append(self.text_of[1:], -1))  # into the next passage, over a line break
        near = np.zeros(self.count, bool)
        near[passage[code >> 21 & 1 > 0]] = True
        self.near = near
        words = lambda p: [w for x in raw[self.start[p] : stop[p]] if x != "\x1e" and (w := undisguise(x))]
        for p in np.flatnonzero(near).tolist():
            own = words(p)
            before = words(p - 1) if p and goes_on[p - 1] else []
            after = words(p + 1) if goes_on[p] else []
            if could := GATE.open(own, [*before, *after]):  # of a match over a line break, the passage with its telling word gets the vote
                text, lead = " ".join(own), " ".join(before) + " " if before else ""
                self.votes[p] = vote(text, lead + " ".join((text, *after)) if before or after else "", len(lead), could)

    def sort(self) -> np.ndarray:
        """Of each passage 1 if it has a vote of any kind, 2 if it has none but a word on which a voter hangs, else 0."""
        return np.where(self.votes.any(axis=1), 1, np.where(self.near, 2, 0))

    @staticmethod
    def _tokens(text: str | None) -> list[str]:
        """The words of a text; a passage is a sentence's part in a line, and voters look over line breaks."""
        tokens: list[str] = []
        if text:
            for line in (text if text.isascii() else _INVISIBLE.sub("", text)).split("\n"):
                tokens += line.split()
                tokens.append("\x1e")
        tokens.append("\x1e")
        return tokens

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(passage, feature) of words and pairs of neighbouring words."""
        keep = np.flatnonzero(~self.soft)
        one, p = self.code[keep] & (SPACE - 1), self.passage[keep]
        same = p[1:] == p[:-1]
        two = (one[:-1] * 31 + one[1:] * 17 + 7) % SPACE
        return np.concatenate((p, p[1:][same])), np.concatenate((one, two[same]))


# ---------------------------------------------------------------- the label model


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class LabelModel:
    """P(label | votes) of one kind among the passages with at least one vote for it.

    Voters for the kind look for one wording each, so that they are silent says nothing: each has an accuracy, that of
    its votes. Correlated pairs of them have accuracies of their own for the first alone, the second alone and both. Voters
    against it look at every such passage: each has a rate of voting for true and for false passages.
    """

    BALANCE = 0.6  # of true passages among those with votes, before the votes are looked at
    ACCURACY, AGAINST = 0.8, (0.4, 0.01)  # what voters are written for: accuracy; rate of votes against on false and on true passages
    COUNT = 20.0  # votes that this is worth, however many there are in the data

    def __init__(self, n_yes: int, n_no: int) -> None:
        self.n, self.n_yes = n_yes + n_no, n_yes
        self.accuracy = np.full(n_yes, self.ACCURACY)
        self.against = np.repeat(np.array(self.AGAINST)[:, None], n_no, axis=1)  # [label, voter]
        self.pairs: list[tuple[int, int]] = []
        self.pair_base = self.pair_accuracy = np.zeros((0, 3))

    def _units(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What was seen, as 0 and 1: votes of the voters for the kind that stand alone, then three cells a pair; and the votes against it."""
        votes = patterns[:, None] >> np.arange(self.n) & 1
        seen = votes[:, : self.n_yes].copy()
        cells = []
        for i, j in self.pairs:
            seen[:, [i, j]] = 0
            cells += [votes[:, i] & ~votes[:, j] & 1, votes[:, j] & ~votes[:, i] & 1, votes[:, i] & votes[:, j]]
        return np.column_stack([seen, *cells]), votes[:, self.n_yes :]

    def _logits(self, seen: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pattern, and what each unit adds to it."""
        each = seen * _logit(np.concatenate((self.accuracy, self.pair_accuracy.ravel())))
        d0, d1 = self.against
        z = _logit(np.array(self.BALANCE)) + no @ np.log(d1 / d0) + (1 - no) @ np.log((1 - d1) / (1 - d0)) + each.sum(axis=1)
        return z, each

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(true | votes); without a vote for the kind nothing is known, which is told as 0."""
        z, _ = self._logits(*self._units(patterns))
        return np.where(patterns & ((1 << self.n_yes) - 1), _chance(z), 0.0)

    def _rounds(self, patterns: np.ndarray, counts: np.ndarray, rounds: int) -> None:
        """EM; a voter's accuracy is taken from what the others say of its passages, for its own vote would confirm itself."""
        seen, no = self._units(patterns)
        base = np.concatenate((np.full(self.n_yes, self.ACCURACY), self.pair_base.ravel()))
        met = counts @ seen
        for _ in range(rounds):
            z, each = self._logits(seen, no)
            right = (counts[:, None] * seen * _chance(z[:, None] - each)).sum(axis=0)
            new = np.clip((self.COUNT * base + right) / (self.COUNT + met), 0.02, 0.99)
            self.accuracy, self.pair_accuracy = new[: self.n_yes], new[self.n_yes :].reshape(-1, 3)
            post = _chance(z)
            for y, w in enumerate((counts * (1 - post), counts * post)):
                self.against[y] = (self.COUNT * self.AGAINST[y] + w @ no) / (self.COUNT + w.sum())

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 25, most_pairs: int = 4, least: float = 0.15) -> None:
        """EM on how often each pattern of votes occurs; then again with the most correlated pairs."""
        some = (patterns & ((1 << self.n_yes) - 1)) > 0
        patterns, counts = patterns[some], counts[some]
        if not len(patterns):
            return
        self._rounds(patterns, counts, rounds)
        # Correlation beyond the label: of the votes given each label, weighted by how likely it is.
        post, votes = self.posterior(patterns), patterns[:, None] >> np.arange(self.n_yes) & 1
        excess = np.zeros((self.n_yes, self.n_yes))
        for w in (counts * (1 - post), counts * post):
            if w.sum() > 20:
                mean = w @ votes / w.sum()
                cov = (votes * w[:, None]).T @ votes / w.sum() - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                excess = np.maximum(excess, cov / np.outer(sd, sd))
        pairs, taken = [], set()
        for i, j in sorted(((i, j) for i in range(self.n_yes) for j in range(i)), key=lambda p: -excess[p]):
            if len(pairs) < most_pairs and excess[i, j] >= least and not taken & {i, j}:
                pairs.append((i, j))
                taken |= {i, j}
        if pairs:
            self.pairs = pairs
            z = [(_logit(self.accuracy[i]), _logit(self.accuracy[j]), 1 - min(1.0, excess[i, j])) for i, j in pairs]
            self.pair_base = np.array([[_chance(x) for x in (a, b, max(a, b) + new * min(a, b))] for a, b, new in z])  # the second of two that agree anyway says little
            self.pair_accuracy = self.pair_base.copy()
            self._rounds(patterns, counts, rounds)


# ---------------------------------------------------------------- the classifier


class Linear:
    """Logistic regression of one kind on hashed words, word pairs and votes."""

    def __init__(self, voters: int) -> None:
        self.w = np.zeros(SPACE + voters + 1, np.float32)

    def fit(self, passage: np.ndarray, feature: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.4, l2: float = 3e-6) -> None:
        """AdaGrad on the whole sample; labels are probabilities."""
        n = len(label)
        self.w[-1] = -3.0
        total = np.full(len(self.w), 1e-8)
        used = np.unique(feature)
        local = np.searchsorted(used, feature)
        norm = weight.sum()
        for _ in range(rounds):
            z = np.bincount(passage, weights=self.w[feature], minlength=n) + self.w[-1]
            err = (label - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weight / norm
            g = np.bincount(local, weights=err[passage], minlength=len(used)) - l2 * self.w[used]
            total[used] += g * g
            self.w[used] += rate * g / np.sqrt(total[used])
            g0 = err.sum()
            total[-1] += g0 * g0
            self.w[-1] += rate * g0 / np.sqrt(total[-1])

    def score(self, passage: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(passage, weights=self.w[feature], minlength=n) + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _with_votes(passage: np.ndarray, feature: np.ndarray, votes: np.ndarray, voters: int) -> tuple[np.ndarray, np.ndarray]:
    at, which = np.nonzero(votes[:, None] >> np.arange(voters) & 1)
    return np.concatenate((passage, np.repeat(at, VOTE_VALUE))), np.concatenate((feature, np.repeat(SPACE + which, VOTE_VALUE)))


def _patterns(df: DataFrame, text: str) -> pd.DataFrame:
    """(kind, pattern, n) over all documents; the number of rows is bounded by the voters. As kind 3 and pattern 0, 1
    or 2, how many passages have no vote of any kind, have one, and have none but hold a word on which a voter hangs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                p = Passages(whole.slice(at, CHUNK).column(0).to_pylist())
                for k in range(3):
                    values, n = np.unique(p.votes[:, k], return_counts=True)
                    for v, c in zip(values.tolist(), n.tolist(), strict=True):
                        total[k, v] = total.get((k, v), 0) + c
                for v, c in enumerate(np.bincount(p.sort(), minlength=3).tolist()):
                    total[3, v] = total.get((3, v), 0) + c
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in total], "pattern": [v for _, v in total], "n": list(total.values())}, pa.schema([("kind", pa.int64()), ("pattern", pa.int64()), ("n", pa.int64())]))

    return spread(df.select(text)).mapInArrow(run, "kind long, pattern long, n long").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).toPandas()


CHUNK = 1_000  # documents that are looked at together


def _sample(df: DataFrame, key: str, text: str, sample_docs: int, passages: list[int]) -> list:
    """Passages of a bounded sample of documents, by hash: all with votes, every NEAR_SHARE-th and every QUIET_SHARE-th other one, or an equal
    share of them where more than SAMPLE_PASSAGES are to be expected from the numbers of ``passages`` of each sort in all documents."""
    docs = min(1.0, sample_docs / max(1, df.count()))
    shares = np.array([1 / QUIET_SHARE, 1.0, 1 / NEAR_SHARE])
    expected = docs * float(shares @ passages)
    of_passages = min(1.0, SAMPLE_PASSAGES / max(1.0, expected))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                p = Passages(batch.column(1).to_pylist())
                # Each passage is drawn by its text's key and its place, so that what is said often is drawn more likely.
                key_hash = np.asarray(batch.column(0)).astype(np.uint64)[p.text_of]
                draw = (key_hash ^ (np.arange(p.count, dtype=np.uint64) - np.searchsorted(p.text_of, p.text_of).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
                share = shares[p.sort()] * of_passages
                passage, feature = p.features()
                real = np.bincount(passage, minlength=p.count) > 0
                take = np.flatnonzero(real & (draw < share * (1 << 24)))
                order = np.argsort(passage, kind="stable")
                lo, hi = np.searchsorted(passage[order], take), np.searchsorted(passage[order], take, "right")
                f = feature[order]
                yield pa.RecordBatch.from_pydict(
                    {"features": [f[a:b].tolist() for a, b in zip(lo, hi, strict=True)], "votes": p.votes[take].tolist()},
                    pa.schema([("features", pa.list_(pa.int64())), ("votes", pa.list_(pa.int64()))]),
                )

    hashed = df.select(F.xxhash64(key).alias("h"), text)
    chosen = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(docs * (1 << 30)))  # drawn where the rows lie: no row is moved for it
    return spread(chosen).mapInArrow(run, "features array<long>, votes array<long>").dropDuplicates(["features", "votes"]).collect()


def train(df: DataFrame, key: str, text: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[LabelModel], list[Linear]]:
    """Label models from the vote patterns of all documents, classifiers from a bounded sample."""
    counts = _patterns(df, text)
    n_of = counts[counts["kind"] == 3].set_index("pattern")["n"]
    rows = sorted(_sample(df, key, text, sample_docs, [int(n_of.get(v, 0)) for v in range(3)]), key=lambda r: r["features"])
    passage = np.repeat(np.arange(len(rows)), [len(r["features"]) for r in rows]) if rows else np.zeros(0, np.int64)
    feature = np.array([f for r in rows for f in r["features"]], np.int64)
    votes = np.array([r["votes"] for r in rows], np.int64).reshape(-1, 3)
    models, classifiers = [], []
    for k, kind in enumerate(KINDS):
        yes, no = VOTERS[kind]
        m, c = LabelModel(len(yes), len(no)), Linear(VOTER_COUNT[kind])
        own = counts[counts["kind"] == k].sort_values("pattern")
        if len(own):
            m.fit(own["pattern"].to_numpy(), own["n"].to_numpy(float))
        if len(rows):
            weight = np.where(votes[:, k] > 0, 1.0, QUIET_WEIGHT)
            c.fit(*_with_votes(passage, feature, votes[:, k], VOTER_COUNT[kind]), m.posterior(votes[:, k]), weight)
        models.append(m)
        classifiers.append(c)
    return models, classifiers


def score_documents(df: DataFrame, key: str, text: str, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(key, abusive, hateful, sexual): each document's scores from 0 to 1. Null and blank texts score 0."""
    _, classifiers = train(df, key, text, sample_docs)
    weights = df.sparkSession.sparkContext.broadcast([c.w for c in classifiers])  # three times SPACE numbers, whatever the data
    schema = df.select(key).schema.add("abusive", "double").add("hateful", "double").add("sexual", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = []
        for kind, w in zip(KINDS, weights.value, strict=True):
            c = Linear(VOTER_COUNT[kind])
            c.w = w
            linear.append(c)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                p = Passages(batch.column(1).to_pylist())
                passage, feature = p.features()
                out = []
                real = np.bincount(passage, minlength=p.count) > 0
                for k, (kind, c) in enumerate(zip(KINDS, linear, strict=True)):
                    s = np.where(real, c.score(*_with_votes(passage, feature, p.votes[:, k], VOTER_COUNT[kind]), p.count), 0.0)
                    best = np.zeros(batch.num_rows)
                    np.maximum.at(best, p.text_of, s)
                    out.append(pa.array(np.round(best, 6)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[key, *KINDS])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def found(scores: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, kind) of each score of at least ``threshold``."""
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS])
    return scores.select(key, F.inline(listed)).where(F.col("score") >= threshold).select(key, "kind")
