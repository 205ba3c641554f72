"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and pair features."""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attune.llm.common import spread
from attune.llm.linear import calibrate, distinct, grams, logistic
from attune.llm.text import flat

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
BITS = 17
SIZE = 1 << BITS

# What stands in for an answer, framings of an answer, and the parts that refusals are put together from.
STAND_INS = ["", " ", "   ", "\n", "\u200b", "-", "--", "...", "\u2026", ".", "N/A", "n/a", "N.A.", "None", "none", "null", "NULL", "nan", "NaN", "{}", "[]", "()", '""', "''", "<empty>", "empty", "<none>", "(none)", "no output", "no response", "TODO", "tbd", "undefined", "?"]
FRAMES = ["{}", '"{}"', "Paraphrase: {}", 'Paraphrase: "{}"', "Rewrite: {}", "Output: {}", "**{}**", "Answer: {}", "Sure! {}", "{}", "My rewrite is: {}", "<p>{}</p>", "`{}`", "> {}", "The paraphrase is: {}", "\u00ab{}\u00bb", "- {}", "Result: {}"]
REFUSALS = {
    "en": (
        "|Sorry, |I am sorry, however |I'm afraid |Apologies, |I regret that |Regrettably, |As an assistant |As a responsible model |Unfortunately, |I have to say no, |Thanks, yet |As an AI |I understand your wish, though ".split("|"),
        "I cannot|I can't|I'm unable to|I am not able to|I won't|I will not|I must refuse to|I have to decline to|I do not want to|I don't feel comfortable to|I'm not comfortable to|I am not allowed to|I'd rather not|it is against my rules to|it would be wrong to|it is not right for me to|it is not appropriate to|my instructions forbid me to|nobody here will".split("|"),
        "rewrite|rephrase|reword|paraphrase|process|handle|help with|assist with|join in|support|engage with|be part of|go along with|continue with|give a version of|work on|soften|repeat|provide a rewrite of|complete the request for".split("|"),
        "this remark|such a comment|that post|hate speech|the text above|offensive language|insults of this sort|what was sent|abuse|attacks on people|content like that|this input|the comment|your message|a sentence of this kind|hateful language|the given words".split("|"),
        "||| since it is offensive| because it breaks the usage policy| as it could hurt somebody| for safety reasons| because it insults people| as it attacks a person|; may I help in another way|, let us keep the talk friendly".split("|"),
    ),
    "passive": (
        "|Note: |Sorry: ".split("|"),
        "this input|the request|your sentence|the comment|such language|the content|the text|this message".split("|"),
        "was blocked|has been refused|cannot be rewritten|was flagged as harmful|will not be processed|is withheld|violates the policy on hate|breaks the content rules|is not something I can rewrite|must be declined".split("|"),
        "|||, so no rewrite is given|, and no version is offered| by the safety filter| because of its language".split("|"),
    ),
    "de": ("|Leider |Entschuldigung, |Bedaure, ".split("|"), "kann ich|ich kann|will ich|darf ich|werde ich|möchte ich".split("|"), "diesen Kommentar|so eine Nachricht|den Text oben|solche Beleidigungen|diese Eingabe".split("|"), "nicht bearbeiten|nicht weiterhelfen|dabei nicht helfen|nicht umschreiben|nicht umformulieren|keinesfalls wiedergeben|aus Sicherheitsgründen ablehnen|nicht behandeln, das verstößt gegen die Regeln".split("|")),
    "fr": ("|Malheureusement |Pardon, |Je regrette, ".split("|"), "je ne peux pas|je ne veux pas|je ne vais pas|il m'est interdit de|je dois refuser de".split("|"), "aider avec|reformuler|réécrire|traiter|paraphraser|reprendre".split("|"), "ce commentaire|une telle phrase|de telles insultes|le texte ci-dessus|cette entrée, elle enfreint les règles".split("|")),
    "es": ("|Por desgracia |Perdón, |Lamento decir que ".split("|"), "no puedo|no quiero|no voy a|no se me permite|debo negarme a".split("|"), "ayudar con|reformular|reescribir|tratar|parafrasear|procesar".split("|"), "este comentario|una frase así|tales insultos|el texto de arriba|esta entrada, infringe las normas".split("|")),
}
#: Sound sentences that look like refusals: they speak about not following or about being sorry and go on.
ANSWERS = ["I'm sorry to say that {}", "Sorry, but {}", "Unfortunately, {}", "I apologise if this is blunt, but {}", "I cannot see why {}", "I won't hide that {}", "I refuse to believe that {}", "Désolé, mais {}", "Leider: {}", "Ich kann dem nicht folgen, denn {}", "Je ne peux pas être d'accord: {}", "No puedo estar de acuerdo: {}", "Perdón, pero {}"]
_ENGLISH = 7  # so many of them are English


def refusal(rng: random.Random, lang: str = "en") -> str:
    """A refusal in ``lang`` put together from parts of one form."""
    kind = lang if lang in ("de", "fr", "es") else rng.choice(("en", "en", "passive"))
    text = " ".join(part for part in (rng.choice(x).strip() for x in REFUSALS[kind]) if part)
    text = text.replace(" ,", ",").replace(" ;", ";")
    return text[:1].upper() + text[1:] + rng.choice((".", ".", ".", "", "!"))


#: Frequent short words of the four languages.
FUNCTION_WORDS = {
    "en": "the a an of to in and is was that it for on with as at by this be are have has had not no but or from they you we my your which so if would should could about while since unless though although because when than one could please does who its".split(),
    "de": "der die das und ist nicht ein eine zu den von mit dem auf für im des als auch es an wird aus bei nach dass ich du wir ihr sie hat war wurde aber sodass weil obwohl während schon noch einmal vom zum zur kein niemand dein deine".split(),
    "fr": "le la les un une des et est de du en que qui ne pas pour dans ce cette sur au aux par plus avec son sa ses nous vous je tu il elle mais ou si alors parce été a à n'a c'est déjà ta ton ma mon mes merci".split(),
    "es": "el la los las un una y es de del en que no por para con se su sus al lo como más pero o si ya este esta yo tú nos fue ha muy así porque aunque mientras sin tu mi dos día año todo nadie".split(),
}
_OF = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws}
_TELLS = {w: k for w, k in _OF.items() if sum(w in v for v in FUNCTION_WORDS.values()) == 1}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_FRAME = re.compile(r"^[\s\"'“”«»*`>_-]*(?:<p>)?(?:(?:final |the )?(?:paraphrase|rewrite|output|answer|rewritten(?: text| sentence)?|here is (?:the|a|my) (?:rewrite|paraphrase)|result)(?: is)?\s*:)?[\s\"'“”«»*`>_-]*", re.I)


_OTHER_SCRIPT = re.compile("[^\\W\\d_\x00-\u024f]")
_LATIN_LETTER = re.compile("[A-Za-z\u00c0-\u024f]")
_TWO_LETTERS = re.compile(r"[^\W\d_][\W\d_]*[^\W\d_]")
_NO_LETTER = re.compile(r"[\W_]+")


def language(text: str, words: list[str] | None = None) -> tuple[str, float]:
    """Guess by script and function words: (language or script, share of the evidence); '' when there is none."""
    if not text.isascii() and (other := len(_OTHER_SCRIPT.findall(text))) and other > len(_LATIN_LETTER.findall(text)):
        return "other", other / (other + len(_LATIN_LETTER.findall(text)))
    found = [k for w in (_tokens(text) if words is None else words) if (k := _TELLS.get(w))]
    if not found:
        return "", 0.0
    best = max(FUNCTION_WORDS, key=found.count)
    return best, found.count(best) / len(found)


def _tokens(t: str) -> list[str]:
    return _WORD.findall(t.lower())


def _bin(x: float) -> int:
    return int(min(max(x, 0), 1) * 10 + 1e-9)


_PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[.!?;:,\n。]")
_STOP = frozenset(".!?。")


@dataclass(frozen=True)
class Usage:
    """How words are used in the sample: words, and words and word pairs that end sentences."""

    words: frozenset[str] = frozenset()
    last: frozenset[str] = frozenset()
    last_pair: frozenset[tuple[str, str]] = frozenset()
    stock: frozenset[str] = frozenset()  # short answers to sentences they share no word with, given at least thrice

    @classmethod
    def of(cls, texts: list[str], least: int = 2) -> Usage:
        words, last, pair = Counter(), Counter(), Counter()
        for t in texts:
            piece = _PIECE.findall(t.lower())
            known = [w for w in piece[:-1] if w[0].isalnum()]  # a broken text may end inside a word
            words.update(set(known))
            for i in range(2, len(piece)):
                if piece[i] in _STOP and piece[i - 1][0].isalnum():
                    last[piece[i - 1]] += 1
                    pair[piece[i - 2], piece[i - 1]] += 1
        return cls(*(frozenset(k for k, n in c.items() if n >= least) for c in (words, last, pair)))


def _tail(text: str, w: list[str], sentence: list[str], usage: Usage) -> list[str]:
    """How an answer ends: with a stop or not, in a known way or not, and whether the sentence goes on there."""
    bare = text.rstrip()
    end = "none" if not bare else "stop" if bare[-1] in ".!?。…\"'”»)*`>:" else "word" if bare[-1].isalnum() else "other"
    out = [f"end={end}"]
    if w and end == "word":
        out.append(f"word={w[-1] in usage.words}")
        out.append(f"last={w[-1] in usage.last}")
        if len(w) > 1:
            out.append(f"pair={(w[-2], w[-1]) in usage.last_pair}")
        state = "away"
        for i in range(1, len(sentence) - 1) if len(w) >= 3 else ():
            if sentence[i] == w[-2] and sentence[i - 1] == w[-3]:
                nxt = sentence[i + 1]
                if nxt == w[-1]:
                    after = sentence[i + 2] if i + 2 < len(sentence) else "."
                    state = "inside" if after[0].isalnum() else "end"
                elif nxt.startswith(w[-1]):
                    state = "broken"
                if state == "end":
                    break
        out.append(f"tail={state}")
        if len(w) > 1:
            out.append(f"tail={state}/pair={(w[-2], w[-1]) in usage.last_pair}/word={w[-1] in usage.words}")
    return out


@functools.lru_cache(maxsize=1 << 12)
def _seen(text: str) -> tuple[str, list[str], frozenset[str]]:
    """A text as read, its words and their set; sentences come with several answers."""
    t = flat(text)
    w = _tokens(t)
    return t, w, frozenset(w)


def dense(sentence: str | None, reasoning: str | None, paraphrase: str | None, usage: Usage) -> list[str]:
    """Pair features as names."""
    (s, sw, known), (r, rw, _), (p, pw, _) = (_seen(x or "") for x in (sentence, reasoning, paraphrase))
    out = []
    pieces = _PIECE.findall(s.lower())
    for name, text, words, raw in (("r", r, rw, reasoning), ("p", p, pw, paraphrase)):
        out.append(f"{name}:len={min(len(words), 8)}")
        if raw is None or not _TWO_LETTERS.search(text):
            out.append(f"{name}:void")
        if len(words) <= 4:
            if len(words) <= 2:
                out.append(f"{name}:short={' '.join(words)}")
            if " ".join(words) in usage.stock:
                out.append(f"{name}:stock")
        out += [f"{name}:{f}" for f in _tail(text, words, pieces, usage)]
    # what the reasoning quotes from the sentence says nothing about its own language
    own = [w for w in rw if w not in known]
    ls, lr, lp = language(s, sw), language(" ".join(own), own), language(p, pw)
    out.append(f"lang:r={'en' if lr[0] == 'en' else 'none' if not lr[0] else 'foreign'}")
    if lr[0] == "other":
        out.append("lang:r=script")
    if ls[0] and lp[0]:
        out.append(f"lang:p={'same' if ls[0] == lp[0] else 'differs'}")
        if ls[0] != lp[0]:
            out.append(f"lang:p=differs{_bin(lp[1])}")
            if lp[0] == "other":
                out.append("lang:p=script")
        # a rewrite may go on in another language
        new = [w for w in pw if w not in known]
        ln = language(" ".join(new), new)
        out.append(f"lang:new={'none' if not ln[0] else 'same' if ln[0] == ls[0] else f'differs{min(len(new) // 4, 3)}'}")
    if p:
        at = _FRAME.match(p)
        core = _tokens(p[at.end() :]) if at and at.end() else pw
        if sw and core:
            b = set(core)
            both = len(known & b)
            cover, kept = both / len(known), both / len(b)
            out += [f"cover={_bin(cover)}", f"kept={_bin(kept)}"]
            if core == sw:
                out.append("same")
            if f" {' '.join(sw)} " in f" {' '.join(core)} ":
                out.append("holds")
            letters = _letters(s)
            # whether it holds the sentence but for marks, blanks and case
            out.append(f"letters={len(letters) >= 8 and letters in _letters(p)}")
            out.append(f"lost={min(len(known) - both, 6)}")
    return out


def _letters(t: str) -> str:
    return _NO_LETTER.sub("", t.lower())


def _hash(names: list[str]) -> list[int]:
    return [_number(n) for n in names]


@functools.lru_cache(maxsize=1 << 14)
def _number(name: str) -> int:
    return zlib.crc32(name.encode()) & (SIZE - 1)


def features(pairs: list[tuple[str | None, str | None, str | None]], usage: Usage, kept: dict | None = None) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse features (row, number below 2 * SIZE, value) per defect: pair features beside hashed n-grams.

    ``empty`` and ``copy`` see the pair features, ``other_language`` those on language; ``truncated`` also the last characters
    and words of both answers; ``refusal`` the n-grams of the rewrite's own wording. N-grams of a row share
    the weight of nine pair features. ``kept`` holds pair features already made.
    """
    kept = {} if kept is None else kept
    names = [kept.get(p) or kept.setdefault(p, dense(*p, usage)) for p in pairs]
    rows = np.repeat(np.arange(len(pairs)), [len(n) for n in names])
    pair = rows, np.array([h for n in names for h in _hash(n)], np.int64), np.ones(len(rows))
    spoken = np.array([x.startswith("lang:") for n in names for x in n], bool)
    tongue = tuple(x[spoken] for x in pair)

    def join(r: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = 3 / np.sqrt(np.maximum(np.bincount(r, minlength=len(pairs)), 1))
        return np.concatenate([pair[0], r]), np.concatenate([pair[1], f + SIZE]), np.concatenate([pair[2], value[r]])

    refusal = join(*distinct(*grams([_own(p[0], p[2]) for p in pairs], (3, 4, 5, 6), BITS, 1), BITS))
    ends, owner = [], []
    for i, (_, reasoning, paraphrase) in enumerate(pairs):
        for name, t in (("r", reasoning), ("p", paraphrase)):
            t, w, _ = _seen(t or "")
            t = t.rstrip().lower()
            if t:
                got = [f"{name}e{n}:{t[-n:]}" for n in (1, 2, 3)] + [f"e:{' '.join(w[-n:])}|{t[-1] in _STOP}" for n in (1, 2)]
                ends += got
                owner += [i] * len(got)
    truncated = join(np.array(owner, np.int64), np.array(_hash(ends), np.int64))
    return {"empty": pair, "copy": pair, "other_language": tongue, "truncated": truncated, "refusal": refusal}


def _own(sentence: str | None, rewrite: str | None) -> str:
    """The rewrite's own wording: words it shares with the sentence are hidden."""
    known = _seen(sentence or "")[2]
    return " ".join("_" if w in known else w for w in _seen(rewrite or "")[1])


@dataclass
class Classifier:
    weights: dict[str, np.ndarray]
    thresholds: dict[str, float]
    usage: Usage

    def score(self, pairs: list[tuple[str | None, str | None, str | None]], kept: dict | None = None) -> dict[str, np.ndarray]:
        """Log-odds over the threshold per defect."""
        out = {}
        for name, (rows, feats, values) in features(pairs, self.usage, kept).items():
            w = self.weights[name]
            out[name] = np.bincount(rows, w[feats] * values, len(pairs)) + w[-1] - self.thresholds[name]
        return out


def synthesise(sound: list[tuple[str, str, str]], langs: list[str], rng: random.Random, stock: list[str] = ()) -> tuple[list[tuple[str | None, str | None, str | None]], list[set[str]]]:
    """Broken copies of pairs: cut, copied, swapped, refused and emptied answers, with their labels.

    ``stock`` holds short answers that the data give to many sentences.
    """
    by: dict[str, list[int]] = {}
    for i, k in enumerate(langs):
        by.setdefault(k, []).append(i)

    def cut(t: str) -> str:
        n = len(t)
        if n < 12:
            return t
        for _ in range(4):
            k = rng.randrange(max(3, n // 10), n - 3)
            if rng.random() < 0.5 and " " in t[:k]:
                k = t.rindex(" ", 0, k)
            # a cut where a clause ends is no break that anyone could see
            if k and t[k - 1].isalnum() and t[k : k + 1] not in (".", "!", "?", ";", ",", ":") and any(c.isalnum() for c in t[k:]):
                return t[:k]
        return t

    foreign = ["这条评论攻击了个人，而不是问题本身。", "我觉得这份表格晚了三个星期，请再看一下。", "Автор говорит о людях, хотя речь шла о расписании.", "Я думаю, этот рецепт никому не понятен.", "Il commento attacca la persona e non il problema.", "De opmerking valt de persoon aan.", "コメントは人を攻撃しています。", "O comentário ataca a pessoa e não o problema."]
    out: list[tuple[str | None, str | None, str | None]] = []
    y: list[set[str]] = []
    for i, (s, r, p) in enumerate(sound):
        k = rng.randrange(10)
        if k <= 1:
            which = rng.random()
            void = rng.choice(stock if stock and rng.random() < 0.3 else STAND_INS + [None])
            out.append((s, r, void) if which < 0.5 else (s, void, p) if which < 0.8 else (s, void, void))
            y.append({"empty"})
        elif k == 2:
            out.append((s, r, cut(p)))
            y.append({"truncated"} if out[-1][2] != p else set())
        elif k == 3:
            out.append((s, cut(r), p))
            y.append({"truncated"} if out[-1][1] != r else set())
        elif k in (4, 9):
            out.append((s, r, refusal(rng, langs[i])))
            y.append({"refusal"})
        elif k == 5:
            form = rng.choice((s, s, s.upper(), s.lower(), s.rstrip(".!?"), "  ".join(s.split()), re.sub(r"[^\w\s]", "", s)))
            out.append((s, r, rng.choice(FRAMES).format(form)))
            y.append({"copy"})
        elif k == 6:
            others = [x for x in by if x != langs[i] and x] if langs[i] else []
            q = sound[rng.choice(by[rng.choice(others)])][2] if others and rng.random() < 0.8 else rng.choice(foreign)
            out.append((s, r, q))
            y.append({"other_language"})
        elif k == 7:
            others = [x for x in by if x not in ("en", "")]
            q = sound[rng.choice(by[rng.choice(others)])][2] if others and rng.random() < 0.6 else rng.choice(foreign)
            out.append((s, q, p))
            y.append({"other_language"})
        else:
            body = p[:1].lower() + p[1:]
            out.append((s, r, rng.choice(ANSWERS[:_ENGLISH] if langs[i] == "en" else ANSWERS[_ENGLISH:]).format(body)))
            y.append(set() if langs[i] == "en" or language(out[-1][2])[0] == langs[i] else {"other_language"})
    return out, y


def _related(sentence: str, rewrite: str, least: float = 0.25) -> bool:
    """Whether a rewrite takes up the sentence; others are no examples of sound ones, whatever their wording."""
    known, words = _seen(sentence)[2], _seen(rewrite)[2]
    return len(known & words) >= least * len(words)


def _stock(pairs: list[tuple[str | None, str | None, str | None]], words: int = 4, times: int = 3) -> frozenset[str]:
    given: dict[str, set[str]] = {}
    for s, *answers in pairs:
        known = _seen(s or "")[2]
        for t in answers:
            w = _seen(t or "")[1]
            if 0 < len(w) <= words and not known.intersection(w):
                given.setdefault(" ".join(w), set()).add(s or "")
    return frozenset(t for t, to in given.items() if len(to) >= times)


def train(pairs: list[tuple[str | None, str | None, str | None]], seed: int = 3) -> Classifier:
    """Fit on given pairs and their broken copies; taken as sound are pairs whose rewrite takes up the sentence, less those a first fit calls broken."""
    rng = random.Random(seed)
    keep = [p for p in pairs if p[0] and p[1] and p[2] and len(p[2].split()) >= 3 and len(p[1].split()) >= 3 and _related(p[0], p[2])]
    # answers in the sentence's language that do not take it up: where later fits find a refusal, they are examples of one
    aside = [p for p in pairs if p[0] and p[1] and p[2] and len(p[2].split()) >= 3 and not _related(p[0], p[2]) and language(flat(p[0]))[0] == language(flat(p[2]))[0]]
    usage = replace(Usage.of([flat(t) for p in keep for t in p]), stock=_stock(pairs))
    weights = {name: np.zeros(2 * SIZE + 1) for name in DEFECTS}
    thresholds = dict.fromkeys(DEFECTS, 0.0)
    turns = 3
    kept: dict = {}
    for turn in range(turns):
        if not keep:
            break
        final = turn == turns - 1
        langs = [language(flat(p[0]))[0] for p in keep]
        broken, labels = synthesise(keep, langs, rng, sorted(usage.stock))
        if turn and aside:
            sure = Classifier(weights, thresholds, usage).score(aside, kept)["refusal"] > -1
            more = [p for p, hit in zip(aside, sure, strict=True) if hit]
            broken, labels = broken + more, labels + [{"refusal"}] * len(more)
        data, y = keep + broken, [set()] * len(keep) + labels
        feats = features(data, usage, kept)
        test = np.array([final and rng.random() < 0.2 for _ in data])
        # gentle at first: broken pairs among the given ones must not be learned by heart as sound
        how = {"l2": 1e-6, "rounds": 16, "rate": 0.5} if final else {"l2": 1e-4, "rounds": 5, "rate": 0.2}
        for name in DEFECTS:
            target = np.array([float(name in t) for t in y])
            rows, f, value = feats[name]
            use = ~test[rows]
            # both classes weigh alike while the given pairs are cleaned, so that zero lies between them
            even = np.where(target > 0, len(y) / max(target.sum(), 1), len(y) / max((1 - target).sum(), 1))
            w = logistic(rows[use], f[use], value[use], target, 2 * SIZE, np.where(test, 0.0, np.sqrt(even) if final else even), **how)
            weights[name] = w
            if final:
                score = np.bincount(rows, w[f] * value, len(data)) + w[-1]
                thresholds[name] = calibrate(score[test], target[test])
        if not final:
            s = Classifier(weights, thresholds, usage).score(keep, kept)
            bad = np.any([s[name] > 0 for name in DEFECTS], axis=0)
            keep = [p for p, b in zip(keep, bad, strict=True) if not b]
    return Classifier(weights, thresholds, usage)


def classifier(df: DataFrame, key: str, sentence: str, reasoning: str, paraphrase: str, sample_rows: int = 5_000, seed: int = 3) -> Classifier:
    """Train on at most about ``sample_rows`` rows picked by a hash of the key."""
    n = df.count()
    pick = df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(n, 1))) < sample_rows) if n > sample_rows else df
    rows = pick.select(F.col(sentence), F.col(reasoning), F.col(paraphrase)).limit(2 * sample_rows).collect()
    return train(sorted(((r[0], r[1], r[2]) for r in rows), key=lambda p: tuple(x or "" for x in p)), seed)


def broken_pairs(df: DataFrame, key: str = "gen_id", sentence: str = "sentence", reasoning: str = "result.reasoning", paraphrase: str = "result.paraphrase", model: Classifier | None = None, rows: int = 1_000) -> DataFrame:
    """key, defect, score (log-odds over the threshold) of every defective pair; a pair may have several.

    A null result, or an answer without a letter, is ``empty`` and, having no wording, nothing else. Whole
    texts are read, ``rows`` pairs at a time; the corpus is only mapped over; the model (a few MB) is broadcast. A null sentence
    leaves the defects that need none. Repeated rows give theirs again; an empty table gives none.
    """
    model = model or classifier(df, key, sentence, reasoning, paraphrase)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            pairs = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            keys, names, scores = [], [], []
            if pairs:
                every = sent.value.score(pairs)
                for i in range(len(pairs)):
                    got = {n: float(every[n][i]) for n in DEFECTS if every[n][i] > 0}
                    if "empty" in got:
                        # without wording an answer cannot show another defect; the other answer still can
                        void = [not _TWO_LETTERS.search(flat(t or "")) for t in pairs[i][1:]]
                        if all(void):
                            got = {"empty": got["empty"]}
                    for n, v in got.items():
                        keys.append(batch.column(0)[i].as_py())
                        names.append(n)
                        scores.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "defect", "score"])

    chosen = df.select(F.col(key), F.col(sentence).alias("s"), F.col(reasoning).alias("r"), F.col(paraphrase).alias("p"))
    return spread(chosen).mapInArrow(run, f"`{key}` {kind}, defect STRING, score DOUBLE")
