"""Personal data in free text: deobfuscating transducers with offsets, detectors, and the way back to the source."""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attune.llm.common import spread
from attune.llm.text import normalise
from attune.storage import cut

KINDS = ("email", "phone", "id_number", "address", "name")


class Tape:
    """A text under rewriting; every character knows the source span it stands for."""

    def __init__(self, source: str):
        self.source = source
        self.text, at = normalise(source)
        if at is None:
            self.start = self.stop = None
        else:
            self.start = at
            self.stop = at + 1

    def _maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.stop = self.start + 1
        return self.start, self.stop

    def rewrite(self, pattern: re.Pattern, to: str | Callable[[re.Match], str]) -> None:
        """Replace every match; all characters of a replacement stand for the whole match."""
        found = list(pattern.finditer(self.text))
        if not found:
            return
        start, stop = self._maps()
        text, starts, stops, last = [], [], [], 0
        for m in found:
            new = to(m) if callable(to) else to
            a, b = m.span()
            if a == b:
                continue
            text += [self.text[last:a], new]
            starts += [start[last:a], np.full(len(new), start[a])]
            stops += [stop[last:a], np.full(len(new), stop[b - 1])]
            last = b
        text.append(self.text[last:])
        starts.append(start[last:])
        stops.append(stop[last:])
        self.text, self.start, self.stop = "".join(text), np.concatenate(starts), np.concatenate(stops)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the characters a..b."""
        if self.start is None:
            return a, b
        return int(self.start[a]), int(self.stop[b - 1])


# Transducers -----------------------------------------------------------------------------------------

_AT_WORD = r"(?:at|arroba|ät|klammeraffe|chez)"
_DOT_WORD = r"(?:dot|punkt|punto|point)"
#: What a text must hold for a written sign of an address.
_AT_SIGN = re.compile(rf"[ \t](?:@|{_AT_WORD})[ \t]+[\w-]{{2,63}}(?:\.\w|[ \t]+{_DOT_WORD}[ \t])|[\[({{<][ \t]*(?:@|{_AT_WORD})[ \t]*[\])}}>]|@[\w.-]+[ \t]+{_DOT_WORD}[ \t]|[ \t]{_DOT_WORD}[ \t]+[\w+.-]+@")
_DOT_INSIDE = re.compile(r"\.\w")
_DOT_NAMES = _DOT_WORD[3:-1].split("|")
_AT_BRACKET = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:@|{_AT_WORD})[ \t]*[\])}}>][ \t]*", re.I)
_DOT_BRACKET = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:\.|{_DOT_WORD})[ \t]*[\])}}>][ \t]*", re.I)
_AT_SPACED = re.compile(rf"(?<=\w)[ \t]+(?:@|{_AT_WORD})[ \t]+(?=[\w-]{{2,63}}(?:\.|[ \t]+{_DOT_WORD}[ \t]+)[\w-]{{2}})", re.I)
_DOT_SPACED = re.compile(rf"(?<=\w)[ \t]+{_DOT_WORD}[ \t]+(?=\w)", re.I)
_DOMAIN_WORDS = re.compile(rf"@[\w-]+(?:\.[\w-]+)*(?:[ \t]+{_DOT_WORD}[ \t]+[\w-]+)+", re.I)
_LOCAL_WORDS = re.compile(rf"[\w+-]+(?:[ \t]+{_DOT_WORD}[ \t]+[\w+-]+)+(?=@)", re.I)

#: Names of the digits in the four languages.
DIGITS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"\b(?:(?:double|triple)[ -])?{_DIGIT}(?:[ ,-]{{1,2}}(?:(?:double|triple)[ -])?{_DIGIT}){{4,20}}\b", re.I)


def _at_sign(low: str) -> bool:
    """Whether a text in lower case holds a written sign of an address; the marks that every form needs are looked for first."""
    marks = "@" in low or any(c in low for c in "[({<") or any(d in low for d in _DOT_NAMES) or _DOT_INSIDE.search(low)
    return bool(marks and _AT_SIGN.search(low))


def _spells(low: str) -> bool:
    """Whether five names of digits follow each other."""
    words = low.replace("-", " ").replace(",", " ").split()
    # of five words in a row one stands at every fifth place
    if not any(w in DIGITS or w in ("double", "triple") or w.strip(".;:!?()[]\"'") in DIGITS for w in words[4::5]):
        return False
    run = 0
    for w in words:
        if w in DIGITS or w.strip(".;:!?()[]\"'") in DIGITS:
            run += 1
            if run > 4:
                return True
        elif w not in ("double", "triple"):
            run = 0
    return False


def _spell(m: re.Match) -> str:
    out, times = "", 1
    for w in re.findall(r"\w+", m[0].lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out, times = out + DIGITS[w] * times, 1
    return out


def deobfuscate(source: str) -> Tape:
    """Look-alikes, invisible and compatibility characters, spelled digits and written at and dot signs resolved."""
    tape = Tape(source)
    text = tape.text
    low = text.lower()
    if _at_sign(low):
        if any(c in text for c in "[({<"):
            tape.rewrite(_AT_BRACKET, "@")
            if "@" in tape.text:
                tape.rewrite(_DOT_BRACKET, ".")
        tape.rewrite(_AT_SPACED, "@")
        if "@" in tape.text:
            # word by word inside an address only, so that prose keeps its words
            for outer in (_DOMAIN_WORDS, _LOCAL_WORDS):
                while m := outer.search(tape.text):
                    at = _DOT_SPACED.search(tape.text, m.start(), m.end())
                    if not at:
                        break
                    _cut(tape, at.start(), at.end(), ".")
    if _spells(low):
        tape.rewrite(_SPELLED, _spell)
    return tape


def _cut(tape: Tape, a: int, b: int, new: str) -> None:
    """Replace one span."""
    start, stop = tape._maps()
    tape.text = tape.text[:a] + new + tape.text[b:]
    tape.start = np.concatenate([start[:a], np.full(len(new), start[a]), start[b:]])
    tape.stop = np.concatenate([stop[:a], np.full(len(new), stop[b - 1]), stop[b:]])


# Detectors -------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}(?![\w@])")

_E = r"(?![\w-]|[.,]\d)"
_B = r"(?<![\w./=#-])"
PHONES = [
    re.compile(p)
    for p in (
        rf"{_B}\+\d{{1,3}}(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{{1,5}}\)?){{2,6}}{_E}",  # +49 (0)30 23125-840
        rf"{_B}\(\d{{3,5}}\)[ .-]?\d{{3}}[ .-]?\d{{4}}{_E}",  # (555) 019-8825
        rf"{_B}\d{{3}}[.-]555[.-]\d{{4}}{_E}|{_B}\d{{3}}-\d{{3}}-\d{{4}}{_E}",  # 231-555-0166
        rf"{_B}00\d? \d{{3}} \d{{3,4}} \d{{3,4}}{_E}",  # 001 555 0163 394
        rf"{_B}0\d{{2}} \d{{4}} \d{{4}}{_E}|{_B}07\d{{9}}{_E}|{_B}07\d{{3}} \d{{6}}{_E}|{_B}01\d{{2,3}} \d{{5,7}}{_E}",  # 020 7946 0446
        rf"{_B}0\d{{2,4}}[/ -]\d{{3,5}}[ -]?\d{{2,5}}{_E}|{_B}0\d{{2,4}}/\d{{5,9}}{_E}",  # 030 23125 836, 0171/3920016
        rf"{_B}0[1-9](?:[ .-]\d{{2}}){{4}}{_E}",  # 06.39.98.25.84
        rf"{_B}[679]\d{{2}}(?:[ .-]\d{{2}}){{3}}{_E}|{_B}[679]\d{{2}}(?:[ .-]\d{{3}}){{2}}{_E}",  # 600 00 13 85
        rf"{_B}9\d[ -]\d{{3}}[ -]\d{{4}}{_E}",  # 91-000-1643
    )
]
_RUN_START = re.compile(r"\d")
#: A bare run of digits is a number of that person only after one of these.
_PHONE_CUE = re.compile(r"(?i)(?:\btel(?:ef\w*)?\.?|\btél\w*\.?|\bphone|\bmobile|\bcall|\btext|\bhandy|\bfax|\bmóvil|\bportable|\bllám\w+|\berreich\w+|\bappel\w+|\bhelpline\b[^.\n]{0,30})[ :]*(?:me (?:on|at) |no\.? |nr\.? |is |al |unter |am |au )?$")
_BARE = re.compile(rf"{_B}\d{{7,15}}{_E}")

_ID_SURE = [
    re.compile(p)
    for p in (
        rf"{_B}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{_E}",  # QQ 44 06 28 D
        rf"{_B}[XYZ]-?\d{{7}}-?[A-Z]{_E}|{_B}\d{{8}}-?[A-HJ-NP-TV-Z]{_E}",  # X0002411J, 00091126-T
        rf"{_B}[12] ?\d{{2}} ?(?:0[1-9]|[1-9]\d) ?(?:\d{{2}}|2[AB]) ?\d{{3}} ?\d{{3}}(?: ?\d{{2}})?{_E}",  # 1 15 13 99 735 399 27
    )
]
_SSN = re.compile(rf"{_B}\d{{3}}([ -])\d{{2}}\1\d{{4}}{_E}")
_COUNTED = re.compile(r"\s*(?:rows?|lines?|items?|boxes|files?|times|percent|%|Zeilen|lignes|filas|words?|points?)\b")
#: What comes before a number that names a person.
_ID_CUE = re.compile(
    r"(?i)(?:\bSSN|\bID|\bI\.D\.|\bdoc|\bdocumento|\bpassport|\bpasaporte|\bpasseport|\breisepass|\bDNI|\bNIE|\bNIF|\bNIR|steuer-?ID|steuernummer|ausweis\w*|\bidentit\w+|(?:insurance|security|identity|social|tax|licen[cs]e) (?:number|no\.?)|sozialversicherung\w*|versicherungsnummer|sécurité sociale|seguridad social|\bNINO?)"
    r"[ ]?(?:number|no\.?|nr\.?|núm\.?|n°)?[ ]?(?:is|es|est|lautet|ist|[:=#])?[ ]*$"
)
_ID_ANY = re.compile(rf"{_B}(?=[A-Z0-9 -]*\d[A-Z0-9 -]*\d)[A-Z0-9]{{1,12}}(?:[ -][A-Z0-9]{{1,6}}){{0,7}}(?![\w])")

_UP = r"[A-ZÀ-ÖØ-Þ]"
_W = rf"{_UP}[\w'’]*[\w](?:-{_UP}?[\w'’]+)?"
_EN_WAY = r"(?:Street|St|Road|Rd|Lane|Ln|Close|Drive|Avenue|Ave|Row|Rise|Way|Court|Hill|Place|Square|Terrace|Gardens|Grove|Crescent|Walk|Mews|Boulevard|Blvd|Parkway|Green)"
_EN_CAPS = "(?:" + _EN_WAY[3:].upper()
_DE_WAY = r"(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|pfad|steig|chaussee)"
_FR_WAY = r"(?:rue|avenue|impasse|chemin|boulevard|place|quai|allée|cours|route|passage|square|sentier)"
_ES_WAY = r"(?:calle|camino|plaza|avenida|paseo|ronda|carretera|travesía|callejón|cuesta)"
_LINK = r"(?:de la |de las |de los |de l['’]|del |des |du |de |d['’]|la |le |les |los |las |el )?"
ADDRESSES = [
    re.compile(p)
    for p in (
        rf"(?<![\w.-])(?<!Table )(?<!table )\d{{1,5}} ?[a-zA-Z]?,? (?:{_W} ){{1,3}}(?:{_EN_WAY}|{_EN_CAPS})(?![\w])",
        rf"(?<!\w)(?:(?:{_W} )?(?:{_W})?(?i:{_DE_WAY})|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Beim|Hinter dem|Unter den) {_W}(?: {_W})?) \d{{1,4}} ?[a-z]?(?![\w]|[.,]\d)",
        rf"(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter|[a-zA-Z]))?,? (?i:{_FR_WAY} {_LINK})(?:{_W})(?: (?i:{_LINK})?{_W})?",
        rf"(?<!\w)(?i:{_ES_WAY} {_LINK}){_W}(?: (?:{_LINK})?{_W})?,? (?:n[.º°o]{{1,2}} ?)?\d{{1,4}} ?[a-zA-Z]?(?![\w]|[.,]\d)",
    )
]

#: Ordinary wording that announces a name, in the four languages; what a corpus uses besides is learned.
CUES = """my name is,name is,i am called,mein name ist,ich heiße,je m'appelle,mon nom est,me llamo,mi nombre es,best wishes,kind regards,best regards,warm regards,regards,sincerely,yours truly,
mit freundlichen grüßen,viele grüße,herzliche grüße,cordialement,bien à vous,un saludo,saludos,atentamente,signed,signed by,written by,author,signature,unterzeichnet,firmado,signé,dear,lieber,liebe,cher,chère,estimado,estimada"""
TITLES = frozenset("dr prof mr mrs ms mme mlle monsieur madame herr herrn frau señor señora señorita sr sra".split())
_CUE_END: dict[str, list[list[str]]] = {}
for _cue in CUES.replace("\n", "").split(","):
    _CUE_END.setdefault(_cue.split()[-1], []).append(_cue.split()[:-1])

_PHRASES = [c for c in CUES.replace("\n", "").split(",") if c != "name is"]
_CAPITALS = re.compile(rf"{_UP}[^\W\d_]*(?:['’-][^\W\d_]+)*(?:\.|,)? {_UP}")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Words that begin sentences or join others and never are part of a full name, in lower case.
_NO_NAME = frozenset(
    "the a an this that these those and or but so of to in on at it i we you he she they my your our their is was are run word as no not for with from by if when please here there what who "
    "der die das ein eine und oder ich du wir ihr sie es im am zu von mit für auf le la les un une et ou je tu nous vous il elle du des el los las una y o yo en por para con que si".split()
)


def _possible(w: str) -> bool:
    """Whether a word in lower case may be part of a name: an initial, or no small word, title or announcing word."""
    return len(w) == 1 or not (w in _NO_NAME or w in TITLES or w in _CUE_END)


def _case(w: str) -> int:
    """0 lower, 1 capitalised, 2 upper case, -1 other; hyphenated and mixed names count as capitalised."""
    if w.islower():
        return 0
    if len(w) > 1 and w.isupper():
        return 2
    return 1 if w[0].isupper() else -1


class Words:
    """The words of a text with their places."""

    def __init__(self, text: str):
        self.text = text
        self.words = _TOKEN.findall(text)
        self.low = " ".join(self.words).lower().split(" ") if self.words else []

    @functools.cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKEN.finditer(self.text)]

    def gap(self, i: int) -> str:
        """What stands between word i and the next."""
        return self.text[self.spans[i][1] : self.spans[i + 1][0]] if i + 1 < len(self.spans) else "\n"

    def full(self, i: int) -> tuple[int, str, str] | None:
        """A full name's shape from word i: (number of words, given name, family name); an initial is a given name of one letter.

        Shapes: A B, A I. B, I. B, I. I. B, and B, A or B, A I. or B, I. with a comma. All words share their case.
        """
        w, n = self.words, len(self.words)
        kind = _case(w[i])
        if kind < 0 or i + 1 >= n:
            return None
        first = i
        if len(w[i]) == 1:
            if kind == 0:
                return None
            while i + 1 < n and len(w[i]) == 1 and self.gap(i) == ". " and i - first < 3:
                i += 1
            return (i - first + 1, w[first], w[i]) if i > first and len(w[i]) > 1 and _case(w[i]) >= 1 else None
        gap = self.gap(i)
        if gap == " ":
            if len(w[i + 1]) == 1 and i + 2 < n and self.gap(i + 1) == ". " and w[i + 1].isupper() == (kind > 0):
                return (3, w[i], w[i + 2]) if _case(w[i + 2]) == kind and len(w[i + 2]) > 1 else None
            return (2, w[i], w[i + 1]) if _case(w[i + 1]) == kind and len(w[i + 1]) > 1 else None
        if gap == ", ":
            if len(w[i + 1]) == 1:
                return (2, w[i + 1], w[i]) if kind and w[i + 1].isupper() and self.gap(i + 1)[:1] == "." else None
            if _case(w[i + 1]) == kind:
                more = i + 2 < n and self.gap(i + 1) == " " and len(w[i + 2]) == 1 and w[i + 2].isupper() and self.gap(i + 2)[:1] == "."
                return (3 if more else 2), w[i + 1], w[i]
        return None

    def end(self, i: int, count: int) -> int:
        """Where a name of ``count`` words ends; the stop of a last initial belongs to it."""
        j = self.spans[i + count - 1][1]
        return j + 1 if len(self.words[i + count - 1]) == 1 and self.text[j : j + 1] == "." else j

    def cued(self, i: int) -> bool:
        """Whether ordinary wording or a title announces a name at word i."""
        if i == 0:
            return False
        gap = self.gap(i - 1)
        if len(gap) > 4:
            return False
        last = self.low[i - 1]
        if last in TITLES:
            return gap in (" ", ". ")
        for before in _CUE_END.get(last, ()):
            k = len(before)
            if self.low[max(0, i - 1 - k) : i - 1] == before and gap.strip() in ("", ":", ",", ",\n") and (k or gap.strip() or last not in ("signed", "author", "signature", "regards")):
                return True
        return False

    def frame(self, i: int, count: int) -> tuple[str, str]:
        """What stands next to a name of ``count`` words: the word or mark before and after it."""
        gap = self.text[: self.spans[0][0]] if i == 0 else self.gap(i - 1)
        mark = gap.strip()
        left = "^" if i == 0 or "\n" in gap else "." if mark[-1:] in (".", "!", "?") and mark else self.low[i - 1] + mark[-1:]
        at = self.end(i, count)
        after = self.text[at : at + 3]
        bare = after.lstrip(" \t")
        right = "^" if not bare or bare[0] in "\r\n" else bare[0] if not bare[0].isalpha() else self.low[i + count] if i + count < len(self.low) else "^"
        return left, right

    def places(self) -> Iterator[Place]:
        """Where a full name may stand, in order."""
        words, low = self.words, self.low
        for i in range(len(words) - 1):
            announced = i > 0 and (low[i - 1] in TITLES or low[i - 1] in _CUE_END)
            # a capitalised word needs another one or an initial's stop; in other case only an announced name counts
            if not announced and not (words[i][0].isupper() and (words[i + 1][0].isupper() or len(words[i]) == 1)):
                continue
            shape = self.full(i)
            if shape and _possible(shape[1].lower()) and _possible(shape[2].lower()):
                cue = announced and self.cued(i)
                if cue or _case(shape[2]) == 1:
                    yield i, shape[0], shape[1].lower(), shape[2].lower(), *self.frame(i, shape[0]), cue

    def runs(self) -> Iterator[tuple[list[str], list[Place]]]:
        """Places that share words, with those words in lower case; the first word of a run has place 0."""
        run: list[Place] = []
        end = 0
        for p in self.places():
            if run and p[0] >= end:
                yield self.low[run[0][0] : end], [(q[0] - run[0][0], *q[1:]) for q in run]
                run = []
            end = max(end, p[0] + p[1]) if run else p[0] + p[1]
            run.append(p)
        if run:
            yield self.low[run[0][0] : end], [(q[0] - run[0][0], *q[1:]) for q in run]


#: Word, number of words, given and family name in lower case, the frame's word or mark before and after it, whether wording announces it.
Place = tuple[int, int, str, str, str, str, bool]


# What makes a name's word, a frame and a word in other use, of numbers or of columns.


def _is_name(c, named, total, inside):
    """A name's word mostly stands where a name may, and often where one surely is."""
    return (c >= 2) & (10 * named >= total) & (2 * inside >= total)


def _is_frame(yes, no):
    """At least four different names of known words stand in a frame and they are most of what does."""
    return (yes >= 4) & (yes > 1.5 * no)


def _is_other(named, total):
    return (total >= 2) & (3 * named < total)


def _is_common(total, inside):
    return 2 * inside < total


class Tally:
    """Counts of texts that names are learned from: words, those where a name may stand, runs of places, names in frames."""

    def __init__(self) -> None:
        self.total: Counter[str] = Counter()
        self.inside: Counter[str] = Counter()
        self.runs: Counter[tuple] = Counter()
        self.pairs: set[tuple[str, str, str, str]] = set()

    def add(self, text: str) -> None:
        p = Words(deobfuscate(text).text)
        self.total.update(p.low)
        for words, places in p.runs():
            self.inside.update(words)
            self.runs[tuple(words), tuple(places)] += 1
            self.pairs.update((left, right, g, f) for _, _, g, f, left, right, _ in places)

    def __len__(self) -> int:
        return len(self.total) + len(self.runs) + len(self.pairs)

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        yield from (("word", w, n, self.inside[w]) for w, n in self.total.items())
        yield from (("run", json.dumps(r, ensure_ascii=False), n, 0) for r, n in self.runs.items())
        yield from (("pair", json.dumps(p, ensure_ascii=False), 1, 0) for p in self.pairs)


@dataclass(frozen=True)
class Names:
    """What a corpus teaches about names: given and family names, frames they stand in, and words in other use."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    frames: frozenset[tuple[str, str]] = frozenset()
    other: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()  # those of ``other`` that mostly stand where no name may

    @functools.cached_property
    def _lexicon(self) -> frozenset[str]:
        return self.given | self.family | TITLES

    def named(self, runs: Iterable[tuple[tuple, int]]) -> tuple[Counter[str], Counter[str], Counter[str]]:
        """Given names, family names and all words of what surely are names: announced, in a learned frame, or of known words."""
        given, family, named = Counter(), Counter(), Counter()
        for (words, places), times in runs:
            sure = set()
            for i, n, g, f, left, right, cue in places:
                if cue or (left, right) in self.frames or (g in self.given and f in self.family):
                    if len(g) > 1:
                        given[g] += times
                    family[f] += times
                    sure.update(range(i, i + n))
            for j in sure:
                named[words[j]] += times
        return given, family, named

    def framed(self, pairs: Iterable[tuple[str, str, str, str]]) -> dict[tuple[str, str], list[int]]:
        """How many different names of known and of other words stand in each frame."""
        seen: dict[tuple[str, str], list[int]] = {}
        for left, right, g, f in pairs:
            seen.setdefault((left, right), [0, 0])[0 if (g in self.given or len(g) == 1) and f in self.family else 1] += 1
        return seen

    @classmethod
    def learn(cls, texts: list[str], rounds: int = 3) -> Names:
        """Bootstrap from ordinary wording: names it announces teach words, names of known words teach frames, and so on.

        ``learned`` does the same over a table.
        """
        t = Tally()
        for text in texts:
            if text:
                t.add(text)
        model = cls()
        for _ in range(rounds):
            given, family, named = model.named(t.runs.items())
            of = lambda c: frozenset(w for w, n in c.items() if _is_name(n, named[w], t.total[w], t.inside[w]))  # noqa: B023, E731
            model = replace(model, given=of(given), family=of(family))
            model = replace(model, frames=frozenset(k for k, (yes, no) in model.framed(t.pairs).items() if _is_frame(yes, no)))
        other = frozenset(w for w, c in t.total.items() if _is_other(named[w], c))
        return replace(model, other=other, common=frozenset(w for w in other if _is_common(t.total[w], t.inside[w])))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Names of a deobfuscated text."""
        if not _CAPITALS.search(text):
            # without two capitalised words in a row only known words and announced ones are left
            low = text.lower()
            if not any(c in low for c in _PHRASES) and self._lexicon.isdisjoint(_TOKEN.findall(low)):
                return
        p = Words(text)
        low, given, family = p.low, self.given, self.family
        i, n = 0, len(low)
        while i < n - 1:
            w = low[i]
            small = not p.words[i][0].isupper()
            # an announced name may be written in lower case
            if small and i and (low[i - 1] in TITLES or low[i - 1] in _CUE_END) and p.cued(i) and (shape := p.full(i)) and not any(x in _NO_NAME or x in self.common for x in shape[1:]):
                yield p.spans[i][0], p.end(i, shape[0])
                i += shape[0]
                continue
            if small and w not in given and w not in family:
                i += 1
                continue
            shape = p.full(i) if _possible(w) else None
            if shape and self._is(p, i, *shape):
                yield p.spans[i][0], p.end(i, shape[0])
                i += shape[0]
            else:
                i += 1

    def _is(self, p: Words, i: int, count: int, given: str, family: str) -> bool:
        g, f = given.lower(), family.lower()
        if not (_possible(g) and _possible(f)):
            return False
        knows = (g in self.given or len(g) == 1) + (f in self.family)
        if knows == 2:
            return True
        if _case(family) == 0:
            return knows == 1 and g not in self.other and f not in self.other
        if p.cued(i):
            return True
        comma = p.low[i] == f and count > 1 and p.low[i] != g
        if knows == 1 and len(g) > 1:
            return g not in self.other and f not in self.other and (not comma or f in self.family or p.frame(i, count) in self.frames)
        if p.frame(i, count) in self.frames and not {g, f} <= self.other:
            return g not in self.other or f not in self.other
        # neither word is known in any use: a pair of capitalised words amid small ones
        if len(g) > 1 and not comma and _case(family) == 1 and g not in self.other and f not in self.other:
            before = i > 0 and p.words[i - 1].islower() and p.gap(i - 1) == " "
            after = i + count < len(p.words) and p.words[i + count].islower() and p.gap(i + count - 1) == " "
            return before or after
        return False


#: Runs of digits that may hold a number.
_RUN = re.compile(r"\d(?:[ ().,/+-]{0,3}[\dA-Z]){5,}")
#: International account numbers, country and check digits first.
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_WAYS = {
    1: re.compile(r"straße |strasse |str\. |weg |allee |gasse |platz |ring |damm |ufer |pfad |steig |chaussee |\b(?:am|an de[rn]|auf de[mr]|im|in der|zu[mr]|beim|hinter dem|unter den) [a-zäöüß-]+(?: [a-zäöüß-]+)? \d"),
    3: re.compile(r"calle|camino|plaza|avenida|paseo|ronda|carretera|travesía|callejón|cuesta"),
}


def _numbers(text: str, add: Callable[[int, int, str], None]) -> None:
    """Identity numbers, addresses and telephone numbers of a text that holds digits."""
    runs = [m.span() for m in _RUN.finditer(text)]
    # numbers named as identity numbers first: some look like telephone numbers
    zones: list[list[int]] = []
    for x, y in runs:
        lo, hi = max(0, x - 24), min(len(text), y + 12)
        if zones and lo <= zones[-1][1]:
            zones[-1][1] = hi
        else:
            zones.append([lo, hi])
    for lo, hi in zones:
        for m in _IBAN.finditer(text, lo, hi):
            add(*m.span(), "id_number")
        for m in _ID_ANY.finditer(text, lo, hi):
            if 6 <= sum(c.isdigit() for c in m[0]) <= 18 and _ID_CUE.search(text, max(0, m.start() - 40), m.start()):
                add(*m.span(), "id_number")
    low = None
    for k, p in enumerate(ADDRESSES):
        if k in _WAYS:
            low = low or text.lower()
            if not _WAYS[k].search(low):
                continue
        for m in p.finditer(text):
            add(*m.span(), "address")
    for lo, hi in zones:
        for p in PHONES:
            for m in p.finditer(text, lo, hi):
                if 7 <= sum(c.isdigit() for c in m[0]) <= 15 and not _COUNTED.match(text, m.end()):
                    add(*m.span(), "phone")
        for m in _SSN.finditer(text, lo, hi):
            if not _COUNTED.match(text, m.end()):
                add(*m.span(), "id_number")
        for p in _ID_SURE:
            for m in p.finditer(text, lo, hi):
                add(*m.span(), "id_number")
        for m in _BARE.finditer(text, lo, hi):
            if _PHONE_CUE.search(text, max(0, m.start() - 60), m.start()):
                add(*m.span(), "phone")


def detect(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a deobfuscated text, not overlapping, in order; earlier kinds of KINDS win."""
    taken: list[tuple[int, int, str]] = []
    starts: list[int] = []

    def add(a: int, b: int, kind: str) -> None:
        # spans are kept in order, so only the neighbours can overlap
        at = bisect.bisect_left(starts, a)
        if a < b and (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            starts.insert(at, a)
            taken.insert(at, (a, b, kind))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    if _RUN_START.search(text):
        _numbers(text, add)
    for a, b in names.spans(text):
        add(a, b, "name")
    return taken


def find(source: str | None, names: Names) -> Iterator[tuple[int, int, str]]:
    """Spans (start, end, kind) in the source text."""
    if not source:
        return
    tape = deobfuscate(source)
    for a, b, kind in detect(tape.text, names):
        yield (*tape.span(a, b), kind)


def said(text: str) -> str:
    """Letters and digits of a span, in lower case, accents composed."""
    return "".join(c for c in unicodedata.normalize("NFC", text).lower() if c.isalnum())


def redact(source: str | None, names: Names) -> str | None:
    """The source with every span replaced by its typed placeholder; all other characters as they were."""
    if not source:
        return source
    out, last = [], 0
    for a, b, kind in find(source, names):
        if a < last:
            continue
        out += [source[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, source[last:]])


#: Entries that a task counts before it passes them on.
_HELD = 200_000


def learned(df: DataFrame, key: str, text: str, rounds: int = 3) -> Names:
    """Names and frames learned on all texts, as ``Names.learn`` does.

    One pass counts words, runs of places and names in frames in the tasks; the rounds read only these distinct
    items, and the driver gets the words and frames that are learned. The key is not needed.
    """
    sc = df.sparkSession.sparkContext

    def count(batches):
        import pyarrow as pa

        def batch_of(t: Tally) -> pa.RecordBatch:
            cols = list(zip(*t.rows(), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["what", "item", "total", "inside"])

        t = Tally()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    t.add(x)
                    if len(t) >= _HELD:
                        yield batch_of(t)
                        t = Tally()
        yield batch_of(t)

    counts = spread(df.select(text)).mapInArrow(count, "what STRING, item STRING, total BIGINT, inside BIGINT")
    counts = cut(counts.groupBy("what", "item").agg(F.sum("total").alias("total"), F.sum("inside").alias("inside")))
    part = lambda what: counts.where(F.col("what") == what)
    words, runs, pairs = part("word").select("item", "total", "inside"), part("run").select("item", "total"), part("pair").select("item")
    model = Names()
    for k in range(rounds):
        sent = sc.broadcast(model)

        def name(batches, sent=sent):
            import pyarrow as pa

            for batch in batches:
                c = sent.value.named(zip(map(json.loads, batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True))
                items = list(c[2])  # every word of a given or family name is one of these
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), *(pa.array([x[w] for w in items], pa.int64()) for x in c)], names=["item", "given", "family", "named"])

        sums = runs.mapInArrow(name, "item STRING, given BIGINT, family BIGINT, named BIGINT").groupBy("item").agg(*(F.sum(c).alias(c) for c in ("given", "family", "named")))
        last = k == rounds - 1
        named, total, inside = F.coalesce("named", F.lit(0)), F.col("total"), F.col("inside")
        of = {c: _is_name(F.coalesce(c, F.lit(0)), named, total, inside) for c in ("given", "family")}
        if last:
            of |= {"other": _is_other(named, total), "common": _is_other(named, total) & _is_common(total, inside)}
        found = words.join(sums, "item", "left" if last else "inner").select("item", *(v.alias(c) for c, v in of.items())).where(functools.reduce(lambda a, b: a | b, map(F.col, of))).toArrow()
        model = replace(model, **{c: frozenset(found.filter(found[c])["item"].to_pylist()) for c in of})
        sent.destroy()
        sent = sc.broadcast(model)

        def frame(batches, sent=sent):
            import pyarrow as pa

            for batch in batches:
                seen = sent.value.framed(map(json.loads, batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in seen], pa.string()) for j in (0, 1)] + [pa.array([x[j] for x in seen.values()], pa.int64()) for j in (0, 1)], names=["before", "after", "yes", "no"])

        seen = pairs.mapInArrow(frame, "before STRING, after STRING, yes BIGINT, no BIGINT").groupBy("before", "after").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        model = replace(model, frames=frozenset((r["before"], r["after"]) for r in seen.where(_is_frame(F.col("yes"), F.col("no"))).select("before", "after").collect()))
        sent.destroy()
    return model


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", names: Names | None = None) -> DataFrame:
    """key, kind, pii_text, start, end of every piece of personal data (positions count characters).

    Only maps over the two columns, whole texts whatever their length; null and empty texts give no row,
    repeated rows give theirs again. ``names`` are learned from all rows of the table where not given.
    """
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(learned(df, key, text) if names is None else names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b, what in find(t, sent.value):
                    keys.append(k)
                    rows.append((what, said(t[a:b]), a, b))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=[key, "kind", "pii_text", "start", "end"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, kind STRING, pii_text STRING, start INT, end INT")


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text", names: Names | None = None) -> DataFrame:
    """key and text of every row with typed placeholders in place of personal data; nulls stay null."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(learned(df, key, text) if names is None else names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t, sent.value) for t in batch.column(1).to_pylist()], pa.string())], names=[key, text])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, `{text}` STRING")
