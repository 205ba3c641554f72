"""Text functions: Column in, Column out, inside the JVM. Null text gives null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables that results depend on.
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
URL = r"https?://\S+|www\.\S+"
HANDLE = r"@\S+"
# Letters and blanks of every script as Python's \w and \s have them; the JVM's own classes are ASCII.
LETTER = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"[{LETTER}]+(?:['-][{LETTER}]+)*|[^{LETTER}{BLANK}]"
MARK = r"^[!-/:-@\[-^`{-~]+\z"
CONTRACTIONS = (("can 't", "can't"), ("i 'm", "i'm"), (" n't", "n't"), (" 've", "'ve"), (" 're", "'re"), (" 'll", "'ll"), (" 'd", "'d"), (" 's", "'s"))
NEGATIONS = ("not", "no", "nor", "against", "never", "none", "nobody", "nothing", "nowhere", "neither", "without", "scarcely", "hardly", "barely")
STOP_WORDS = ("a", "an", "the", "and", "or", "but", "if", "of", "at", "by", "for", "with", "to", "from", "in", "on", "is", "are", "was", "were", "be", "been", "so", "as", "than", "then", "that", "this", "these", "those", "has", "have", "had", "do", "does", "did")
PRONOUNS = ("i", "me", "my", "mine", "we", "us", "our", "ours", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs")
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: What western emoticons stand for, and the faces with that meaning.
EMOTICONS = {
    "Very happy": ":-)) :))",
    "Happy face or smiley": ":-) :) :-] :]",
    "Happy face smiley": ":-3 :3 :-> :> 8-) :o) :-} :} :c) :^) =] =)",
    "Laughing, big grin or laugh with glasses": ":-D :D 8-D 8D X-D XD =D =3 B^D",
    "Frown, sad, andry or pouting": ":-( :( :-c :c :-< :< :-[ :[ :-|| >:[ :{ :@ >:(",
    "Crying": ":'-( :'(",
    "Tears of happiness": ":'-) :')",
    "Surprise": ":-O :O :-o :o",
    "Shock": ":-0",
    "Yawn": "8-0 >:O",
    "Kiss": ":-* :* :X",
    "Wink or smirk": ";-) ;) *-) *) ;-] ;] ;^) ;D",
    "Tongue sticking out, cheeky, playful or blowing a raspberry": ":-P :P X-P XP :b =p >:P",
    "Skeptical, annoyed, undecided, uneasy or hesitant": ":-/ :/ >:/ =/ :L =L :S",
    "Straight face": ":-| :|",
    "Embarrassed or blushing": ":$",
    "Sealed lips or wearing braces or tongue-tied": ":-x :x :-# :# :-& :&",
    "Angel, saint or innocent": "O:-) O:) 0:-3 0:3 0:-) 0:)",
    "Evil or devilish": ">:-) >:) }:-) }:) 3:-) 3:) >;)",
    "Cool": "|;-)",
    "Bored": "|-O",
    "Tongue-in-cheek": ":-J",
    "Party all night": "#-)",
    "Drunk or confused": "%-) %)",
    "Dump": "<:-|",
}
LOOKALIKES = {"a": "a@*4", "i": "i*l1", "o": "o*0@", "u": "u*v", "v": "v*u", "l": "l1", "e": "e*3", "s": "s$5", "t": "t7"}


def strip_ip(c: Column) -> Column:
    """Without dotted quads."""
    return F.regexp_replace(c, IP, "")


def strip_url(c: Column) -> Column:
    """Without web addresses."""
    return F.regexp_replace(c, URL, "")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "")


def collapse_space(c: Column) -> Column:
    """Two and more blanks become one."""
    return F.regexp_replace(c, " {2,}", " ")


def unaccent(c: Column) -> Column:
    """Latin letters without their accents; other scripts stay."""
    return F.replace(F.replace(F.replace(F.translate(c, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def strip_html(c: Column) -> Column:
    """Visible text of HTML: scripts and styles gone, tags as blanks, common entities resolved, trimmed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<[A-Za-z/!][^<>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def mask_users(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """Handles as @USER, except those in ``keep`` (lower case, without @)."""
    if not keep:
        return F.regexp_replace(c, HANDLE, "@USER")
    words = "|".join(sorted(keep))
    return F.regexp_replace(c, rf"@(?!(?i:{words})(?!\S))\S+", "@USER")


def squeeze(c: Column) -> Column:
    """A letter that stands three times or more in a row stands twice."""
    return F.regexp_replace(c, r"([^\W\d_])\1{2,}", "$1$1")


def strip_emoji(c: Column) -> Column:
    """Without emoji; emoticons that stand alone become what they stand for."""
    s = F.regexp_replace(c, "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]", "")
    # a longer face is never read as a shorter one: neither side may go on with a letter, digit or mark of a face
    for words, faces in EMOTICONS.items():
        either = "|".join(re.escape(f) for f in sorted(faces.split(), key=len, reverse=True))
        s = F.regexp_replace(s, rf"(?<![\w:;=<>|#%}}*]){'(?:' + either + ')'}(?![\w()\[\]|])", words)
    return s


def tidy(c: Column) -> Column:
    """Unquoted, single blanks, no blank before punctuation, contractions joined, sentences capitalised."""
    s = F.regexp_replace(c, r"^[\"']+|[\"']+$", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"\s+([.,!?;:])", "$1")
    for a, b in CONTRACTIONS:
        s = F.regexp_replace(s, f"(?i){a}", b)
    parts = F.filter(F.transform(F.split(s, r"\."), lambda t: F.trim(t)), lambda t: t != "")
    joined = F.array_join(F.transform(parts, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))), ". ")
    return F.when(F.endswith(s, F.lit(".")), F.concat(joined, F.lit("."))).otherwise(joined)


def clean(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """The whole cleaning in its fixed order; handles in ``keep`` are disguised words, not users."""
    for step in (strip_ip, strip_url, unaccent, strip_html, lambda x: mask_users(x, keep), squeeze, strip_emoji, tidy):
        c = step(c)
    return c


def word_tokens(c: Column) -> Column:
    """Words (inner apostrophes and hyphens kept) and single punctuation marks."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def irrelevant(w: Column) -> Column:
    """Whether a token says nothing: stop word (case matters, negations count), ASCII mark, number or pronoun."""
    stop = w.isin(*[s for s in STOP_WORDS if s not in NEGATIONS])
    return stop | w.rlike(MARK) | w.rlike(r"^-?\p{Nd}+(\.\p{Nd}+)?\z") | F.lower(w).isin(*PRONOUNS)


def contains_cjk(c: Column) -> Column:
    return c.rlike("[\\x{4e00}-\\x{9fff}]")


def sentences(c: Column) -> Column:
    """Sentences: cut at line ends and after .!? before a blank; no empty ones."""
    parts = F.split(c, rf"[\r\n]+|(?<=[.!?])[{BLANK}]+")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, rf"^[{BLANK}]+|[{BLANK}]+\z", "")), lambda t: t != "")


def chain_steps(c: Column) -> Column:
    """Steps of a reasoning chain: sentences without trailing dots and blanks, tabs as blanks, no empty ones."""
    return F.filter(F.transform(sentences(c), lambda t: F.regexp_replace(F.translate(t, "\t", " "), r"[. ]+\z", "")), lambda t: t != "")


def between(c: Column, start: str, end: str) -> Column:
    """Text between two literal marks, trimmed; null if either is missing or nothing stands between."""
    s = F.regexp_replace(F.regexp_extract(c, rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1), r"^\s+|\s+$", "")
    return F.when(s != "", s)


def after(c: Column, start: str) -> Column:
    """Text after a literal mark up to the line end; null if missing or empty."""
    s = F.trim(F.regexp_extract(c, rf"\Q{start}\E\s*:?\s*([^\r\n]*)", 1))
    return F.when(s != "", s)


#: Marks of a reasoning and a rewrite in free answers; the first rule whose guard occurs wins.
CASCADE = (
    ("Final Paraphrase", ("Final Reasoning", "Final Paraphrase"), "Final Paraphrase"),
    ("Final Reasoning", ("Final Reasoning", "The final paraphrase generated is:"), "The final paraphrase generated is"),
    ("Final Answer", ("final_reasoning", "Final Answer"), "Final Answer"),
    ("Proposed Paraphrase", ("final_reasoning", "Proposed Paraphrase"), "Proposed Paraphrase"),
    ("Generate Paraphrase", ("final_reasoning", "Generate Paraphrase"), "The revised sentence will be"),
    ("Construct Paraphrase:", ("final_reasoning", "Construct Paraphrase:"), "New sentence:"),
    ("final_paraphrase", ("final_reasoning", "final_paraphrase"), "final_paraphrase"),
)


def extract_answer(c: Column) -> Column:
    """struct(reasoning, paraphrase) of a free answer by CASCADE; null where no rule gives both."""
    rules = []
    for guard, (a, b), mark in CASCADE:
        r, p = between(c, a, b), after(c, mark)
        rules.append(F.when(F.contains(c, F.lit(guard)), F.struct(r.alias("reasoning"), p.alias("paraphrase"))))
    first = F.coalesce(*rules)
    return F.when(first["reasoning"].isNotNull() & first["paraphrase"].isNotNull(), first)


def pre_post(c: Column) -> Column:
    """Without code fences, bold marks, outer quotes and a leading colon."""
    s = F.replace(F.regexp_replace(c, r"```[a-z]*", ""), F.lit("**"), F.lit(""))
    s = F.regexp_replace(F.trim(s), r"^:\s*", "")
    return F.trim(F.regexp_replace(s, r"^[\"']+|[\"']+$", ""))


def cut_at(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def json_block(c: Column) -> Column:
    """The fenced JSON block, else the widest braces; null if there are none."""
    fenced = F.regexp_extract(c, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    wide = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(wide != "", wide)


def kv_lines(c: Column) -> Column:
    """Values of the two ``key: value`` lines after two dropped lines; the raw text where they are missing."""
    lines = F.slice(F.split(c, "\n"), 3, 2)
    value = lambda i: F.trim(F.regexp_extract(F.get(lines, i), r"^[^:]*:(.*)$", 1))
    good = (F.size(lines) == 2) & F.get(lines, 0).contains(":") & F.get(lines, 1).contains(":")
    return F.when(good, F.array(value(0), value(1))).otherwise(F.array(c))


def truncate_words(c: Column, limit: int, keep: int) -> Column:
    """Over ``limit`` words, the first ``keep``."""
    w = F.split(c, " ")
    return F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, keep), " ")).otherwise(c)


def conversation(messages: Column, system: Column, roles: tuple[str, str], sep: str, sep2: str | None = None) -> Column:
    """A prompt from messages (array of strings, taking turns); with ``sep2`` the separators take turns too."""
    role = lambda i: F.when(i % 2 == 0, roles[0]).otherwise(roles[1])
    end = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2 or sep)
    return F.concat(system, F.lit(sep), F.array_join(F.transform(messages, lambda m, i: F.concat(role(i), F.lit(": "), m, end(i))), ""))


def swap_answers(c: Column) -> Column:
    """Assistant 1 and Assistant 2 change places."""
    s = F.replace(c, F.lit("Assistant 1"), F.lit("\x01"))
    s = F.replace(s, F.lit("Assistant 2"), F.lit("Assistant 1"))
    return F.replace(s, F.lit("\x01"), F.lit("Assistant 2"))


def parse_score(c: Column) -> Column:
    """array of two scores of the first line (commas as blanks); (-1, -1) unless there are exactly two numbers."""
    parts = F.split(F.replace(F.split(c, "\n")[0], F.lit(","), F.lit(" ")), " ")
    bad = F.array(F.lit(-1.0), F.lit(-1.0))
    nums = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == 2) & ~F.exists(nums, lambda x: x.isNull()), nums).otherwise(bad)


def parse_scores(c: Column, n: int) -> Column:
    """n blank-separated numbers; null otherwise."""
    nums = F.transform(F.split(F.trim(c), r"\s+"), lambda p: p.try_cast("double"))
    return F.when((F.size(nums) == n) & ~F.exists(nums, lambda x: x.isNull()), nums)


def rename_chain(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def leaks_identity(c: Column, words: list[str]) -> Column:
    """Whether any word is part of the lower-cased text."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), w))


def yes_no(answer: Column, positive: bool) -> Column:
    """1 for the good answer of a question, 0 for the bad one, null for anything else."""
    a = F.lower(F.trim(answer))
    return F.when(a == "yes", 1 if positive else 0).when(a == "no", 0 if positive else 1)


def stop_partial(c: Column, stop: str) -> Column:
    """Whether the text ends with a non-empty beginning of the stop string."""
    tests = [F.endswith(c, F.lit(stop[:k])) for k in range(1, len(stop) + 1)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
