"""Offset-preserving normalisation of text: what a reader sees, with the way back to the source."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

#: Letters of other scripts that look like Latin ones, pairwise (letter, Latin letter).
LOOKALIKE = dict(
    zip(
        "аеорсухіјѕһԁԛԝкмтвнгпАВЕКМНОРСТУХІЈЅԌԚԜαοερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwkmtbhrnABEKMHOPCTYXIJSGQWaoepviktuxABEZHIKMNOPTYX",
        strict=True,
    )
)

_MIXED = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[" + "".join(LOOKALIKE) + "]")
_LATIN = re.compile("[A-Za-z]")
_LOOK = str.maketrans(LOOKALIKE)


@functools.lru_cache(maxsize=1 << 14)
def seen(ch: str) -> str:
    """One character as it reads: compatibility forms resolved, invisible ones gone, blanks as a blank."""
    if ch > "\x9f" and unicodedata.category(ch) == "Cf":  # format characters, which readers do not see
        return ""
    flat = unicodedata.normalize("NFKC", ch)
    if flat.isspace() and ch not in "\n\r\t":
        return " "
    return flat


@functools.lru_cache(maxsize=1 << 16)
def _plain(ch: str) -> bool:
    """Whether a character reads as itself wherever it stands."""
    return ch < "\x80" or (seen(ch) == ch and not unicodedata.combining(ch) and ch not in LOOKALIKE)


def normalise(text: str) -> tuple[str, np.ndarray | None]:
    """The text as it reads and, per character of it, the position in ``text`` (None: unchanged).

    Combining marks join the letter before them; letters that only look Latin become Latin inside words
    that hold a Latin letter, so words of other scripts stay.
    """
    if text.isascii() or not (odd := [c for c in set(text) if not _plain(c)]):
        return text, None
    parts: list[str] = []
    at: list[np.ndarray] = []
    done = 0
    for m in re.finditer(f"[{re.escape(''.join(sorted(odd)))}]", text):
        i, ch = m.start(), m[0]
        if i > done:
            parts.append(text[done:i])
            at.append(np.arange(done, i))
        done = i + 1
        if unicodedata.combining(ch) and parts:
            both = unicodedata.normalize("NFC", parts[-1][-1] + ch)
            if len(both) == 1:
                parts[-1] = parts[-1][:-1] + both
            continue
        if new := seen(ch):
            parts.append(new)
            at.append(np.full(len(new), i))
    if done < len(text):
        parts.append(text[done:])
        at.append(np.arange(done, len(text)))
    s = "".join(parts)
    if _FOREIGN.search(s):
        s = _MIXED.sub(lambda m: m[0].translate(_LOOK) if _LATIN.search(m[0]) and _FOREIGN.search(m[0]) else m[0], s)
    return s, np.concatenate(at) if at else np.empty(0, np.int64)


def back(at: np.ndarray | None, start: int, end: int, length: int) -> tuple[int, int]:
    """Span of the source text for the span start..end of the normalised one; ``length`` of the source."""
    if at is None:
        return start, end
    if start >= end:
        return (int(at[start]) if start < len(at) else length,) * 2
    stop = int(at[end]) if end < len(at) else length
    last = int(at[end - 1])
    # invisible characters after the last one belong to nobody, combining marks to it
    return int(at[start]), max(last + 1, min(stop, last + 1))


def flat(text: str) -> str:
    """The normalised text without the way back."""
    return normalise(text)[0]
