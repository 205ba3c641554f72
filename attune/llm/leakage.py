"""Evaluation texts inside a corpus: BM25 with block-max WAND over the items, then alignment of the words."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attune.llm.common import spread
from attune.llm.text import flat

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]|\\(?=[\"/\\])")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:nbsp|amp|quot|lt|gt|#\d+);")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case words as read: look-alikes, invisible characters, escapes, tags and layout do not matter."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(flat(text).lower())


@dataclass
class Index:
    """Inverted index of the items. Postings of a term: item numbers ascending, impacts, and blocks."""

    vocabulary: dict[str, int]
    postings: list[tuple[list[int], list[float]]]  # per term: items, BM25 impact of one occurrence in the query
    blocks: list[tuple[list[int], list[float]]]  # per term: last item and highest impact of each block
    bound: np.ndarray  # per term: highest impact, 0 for words no item has
    items: list[np.ndarray]  # term ids per item, shared wording as -2
    ids: list[int]
    threshold: float
    triples: list[set[int]]  # per item: its own runs of three words
    run: np.ndarray  # all of those runs, ascending
    holder: np.ndarray  # the item each belongs to
    own: list[np.ndarray]  # per item: its own words, ascending


@dataclass
class Statistics:
    """What all items together say, however many indexes they are dealt to."""

    n: int
    mean: float  # own words per item
    common: Counter  # items per word, shared wording left out
    shared: set[int]  # hashes of runs that are nobody's own
    threshold: float


_K1, _B = 1.2, 0.75


def _own(w: list[str], shared: set[int], shared_run: int) -> list[bool]:
    """Which words of an item stand in no shared run."""
    own = [True] * len(w)
    for j in range(len(w) - shared_run + 1):
        if hash(tuple(w[j : j + shared_run])) in shared:
            own[j : j + shared_run] = [False] * shared_run
    return own


def _impacts(w: list[str], own: list[bool], s: Statistics) -> dict[str, float]:
    """BM25 impact of each own word of an item."""
    count = Counter(x for x, mine in zip(w, own, strict=True) if mine)
    size = sum(count.values())
    idf = lambda x: math.log(1 + (s.n - s.common[x] + 0.5) / (s.common[x] + 0.5))
    return {x: idf(x) * c * (_K1 + 1) / (c + _K1 * (1 - _B + _B * size / s.mean)) for x, c in count.items()}


def gather(rows: Callable[[], Iterable[str]], least: int, shared: int, shared_run: int, slack: float) -> Statistics:
    """Statistics of all item texts in three passes over ``rows()``, keeping counts only.

    Runs of ``shared_run`` words that ``shared`` items or more have are nobody's own. The threshold is ``slack``
    times the lowest score that any ``least`` consecutive own words of any item give that item: a verbatim passage
    of that length is always retrieved.
    """
    runs: Counter = Counter()
    for t in rows():
        w = words(t)
        runs.update({hash(tuple(w[j : j + shared_run])) for j in range(len(w) - shared_run + 1)})
    s = Statistics(0, 1.0, Counter(), {r for r, c in runs.items() if c >= shared}, math.inf)
    total = 0
    for t in rows():
        if w := words(t):
            mine = [x for x, own in zip(w, _own(w, s.shared, shared_run), strict=True) if own]
            s.n, total = s.n + 1, total + len(mine)
            s.common.update(set(mine))
    s.mean = max(total / max(s.n, 1), 1.0)
    low = math.inf
    for t in rows():
        w = words(t)
        own = _own(w, s.shared, shared_run)
        impact = _impacts(w, own, s)
        for j in range(len(w) - least + 1):
            if all(own[j : j + least]):
                low = min(low, sum(impact[x] for x in set(w[j : j + least])))
    s.threshold = slack * low
    return s


def build(rows: list[tuple[int, str | None]], stats: Statistics, shared_run: int, block: int) -> Index:
    """Index of (item_id, text) under the statistics of all items."""
    texts = [(i, w) for i, w in ((i, words(t)) for i, t in sorted(rows)) if w]
    vocabulary: dict[str, int] = {}
    own: list[np.ndarray] = []
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for d, (_, w) in enumerate(texts):
        mine = _own(w, stats.shared, shared_run)
        ids = np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64)
        ids[~np.array(mine)] = -2
        own.append(ids)
        for x, v in _impacts(w, mine, stats).items():
            lists[vocabulary[x]].append((d, v))
    postings, blocks, bound = [], [], np.zeros(len(vocabulary) + 1)
    for t in range(len(vocabulary)):
        docs, score = [d for d, _ in lists[t]], [v for _, v in lists[t]]
        postings.append((docs, score))
        blocks.append(([docs[min(j + block, len(docs)) - 1] for j in range(0, len(docs), block)], [max(score[j : j + block]) for j in range(0, len(docs), block)]))
        bound[t] = max(score, default=0.0)
    three = [triples(o) for o in own]
    run = np.array([r for t in three for r in t], np.int64)
    holder = np.repeat(np.arange(len(three)), [len(t) for t in three])
    by = np.argsort(run, kind="stable")
    return Index(vocabulary, postings, blocks, bound, own, [i for i, _ in texts], stats.threshold, three, run[by], holder[by], [np.unique(o[o >= 0]) for o in own])


def _runs(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three known words as numbers (hashed, as vocabularies have no bound), and where they begin."""
    a, b, c = terms[:-2], terms[1:-1], terms[2:]
    at = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0)) if len(terms) > 2 else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = a[at].astype(np.uint64)
        for x in (b, c):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[at].astype(np.uint64)
    return h.view(np.int64), at


def triples(terms: np.ndarray) -> set[int]:
    """Runs of three known words."""
    return set(_runs(terms)[0].tolist())


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """Every item whose BM25 score for the distinct terms of ``query`` reaches ``threshold``, with its score.

    Lists are kept in the order of their current item. The pivot is the first list at which the sum of the
    term bounds reaches the threshold; if the bounds of the blocks that hold the pivot item do not reach it,
    all lists up to the pivot jump behind the nearest block end, else the item is scored.
    """
    cursors = [[index.postings[t][0][0], 0, 0, t] for t in query if index.postings[t][0]]
    found = []
    end = len(index.items)
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for j, c in enumerate(cursors):
            total += index.bound[c[3]]
            if total >= threshold:
                pivot = j
                break
        if pivot < 0:
            break
        target = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
            pivot += 1
        total, nearest = 0.0, end
        for c in cursors[: pivot + 1]:
            last, most = index.blocks[c[3]]
            while c[2] < len(last) and last[c[2]] < target:
                c[2] += 1
            if c[2] < len(last):
                total += most[c[2]]
                nearest = min(nearest, last[c[2]] + 1)
        if total < threshold:
            jump = min(nearest, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
            moving = cursors[: pivot + 1]
        elif cursors[0][0] == target:
            score = sum(index.postings[c[3]][1][c[1]] for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((target, score))
            jump, moving = target + 1, cursors[: pivot + 1]
        else:
            jump, moving = target, [c for c in cursors[:pivot] if c[0] < target]
        for c in moving:
            docs = index.postings[c[3]][0]
            while c[1] < len(docs) and docs[c[1]] < jump:
                c[1] += 1
            c[0] = docs[c[1]] if c[1] < len(docs) else end
        cursors = [c for c in cursors if c[0] < end]
    return found


def overlap(doc: np.ndarray, item: np.ndarray, edit: float) -> float:
    """Best local alignment of two word sequences: one per equal word, ``edit`` off per changed word."""
    best = 0.0
    steps = np.arange(len(item) + 1) * edit
    prev = np.zeros(len(item) + 1)
    for w in doc:
        row = np.zeros(len(item) + 1)
        np.maximum(prev[:-1] + np.where(item == w, 1.0, -edit), prev[1:] - edit, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        if (m := row.max()) > best:
            best = m
        prev = row
    return best


def narrow(index: Index, among: list[int], terms: Iterable[int]) -> Index:
    """The lists of ``terms`` cut down to a few items; a block each, as they are short."""
    postings, blocks, bound = {}, {}, {}
    for t in terms:
        docs, score = index.postings[t]
        at = [k for d in among if (k := bisect.bisect_left(docs, d)) < len(docs) and docs[k] == d]
        if at:
            postings[t] = [docs[k] for k in at], [score[k] for k in at]
            bound[t] = max(postings[t][1])
            blocks[t] = [docs[at[-1]]], [bound[t]]
    return replace(index, postings=postings, blocks=blocks, bound=bound)


def at_most(doc: np.ndarray, item: np.ndarray, edit: float) -> float:
    """Bound on ``overlap``: in the aligned range a word that the item has gains one at the most, any other costs an edit.

    ``item`` holds the item's words in ascending order.
    """
    place = np.minimum(np.searchsorted(item, doc), len(item) - 1)
    total = np.cumsum(np.where(item[place] == doc, 1.0, -edit))
    return float((total - np.minimum.accumulate(np.append(0.0, total[:-1]))).max())


def leaks(index: Index, text: str | None, window: int, step: int, score: float, edit: float, runs: int = 4) -> list[int]:
    """Item ids whose wording the text holds: passages that retrieve an item, checked by alignment.

    An item is accepted with ``runs`` common runs of three words and ``score``. So only items that share as many
    runs with the whole text and whose bound on the score is high enough are looked for, and only by windows near
    such runs: that loses nothing and spares most texts the search.
    """
    at = index.vocabulary
    terms = np.array([at.get(w, -1) for w in words(text)], np.int64)
    run, where = _runs(terms)
    if len(run) < runs or not len(index.run):
        return []
    lo, hi = np.searchsorted(index.run, run, "left"), np.searchsorted(index.run, run, "right")
    hit = hi > lo
    if np.count_nonzero(hit) < runs:
        return []
    held = {(int(index.holder[k]), int(r)) for a, b, r in zip(lo[hit], hi[hit], run[hit], strict=True) for k in range(a, b)}
    possible = {d for d, n in Counter(d for d, _ in held).items() if n >= runs and at_most(terms, index.own[d], edit) >= score}
    if not possible:
        return []
    sums = np.concatenate([[0.0], np.cumsum(index.bound[terms])])  # bound[-1] is 0: words no item has
    starts = np.arange(0, max(len(terms) - window, 0) + step, step)
    starts = starts[starts < len(terms)]
    ends = np.minimum(starts + window, len(terms))
    marks = np.zeros(len(terms) + 1, np.int64)
    marks[where[hit] + 1] = 1
    marks = np.cumsum(marks)
    near = marks[np.minimum(ends + window, len(terms))] - marks[np.maximum(starts - window, 0)] >= runs
    hot = np.flatnonzero(near & (sums[ends] - sums[starts] >= index.threshold))
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    few = narrow(index, sorted(possible), {t for t in terms.tolist() if t >= 0}) if len(hot) else index
    for j in hot:
        lo, hi = int(starts[j]), int(ends[j])
        for d, _ in block_max_wand(few, [t for t in set(terms[lo:hi].tolist()) if t in few.bound], index.threshold):
            s = spans[d]
            if s and lo <= s[-1][1]:
                s[-1] = (s[-1][0], hi)
            else:
                s.append((lo, hi))
    found = []
    for d, s in spans.items():
        for lo, hi in s:
            part = terms[max(0, lo - window) : hi + window]  # the passage may go on beyond the windows that retrieved it
            if len(triples(part) & index.triples[d]) >= runs and overlap(part, index.items[d], edit) >= score:
                found.append(index.ids[d])
                break
    return found


def contaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 13, window: int = 28, step: int = 8, score: float = 11.0, edit: float = 1.5, shared: int = 4, shared_run: int = 8, slack: float = 0.9, block: int = 16, items_per_index: int = 20_000) -> DataFrame:
    """Distinct (doc key, item key) of every document that holds an item's own words, wholly or in part.

    Passages are windows of ``window`` words every ``step``; each retrieves all items above the index's
    threshold and an alignment of the passage with the item decides: equal words in order less ``edit`` per
    changed, added or missing word must reach ``score`` (that takes four common runs of three words at the
    least, which is looked up before searching). Whole texts are read, the corpus is only mapped
    over (no shuffle) and the index is broadcast: it holds at most ``items_per_index`` items, more items make
    more indexes and one pass each, under the statistics of all items, so their number changes no result. Wording that ``shared`` items have in common (instructions) counts for
    none. Null and empty texts on either side give nothing; repeated rows give one.
    """
    spark = docs.sparkSession
    total = items.count()
    parts = max(1, -(-total // items_per_index))
    keys = items.schema[item_key].dataType.simpleString()
    doc_kind = docs.schema[doc_key].dataType.simpleString()
    rows = spread(docs.select(doc_key, doc_text))
    named = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("k IS NOT NULL AND t <> ''").distinct()
    stats = gather(lambda: (r["t"] for r in named.select("t").toLocalIterator()), least, shared, shared_run, slack)
    out = None
    for p in range(parts):
        chosen = named.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == p) if parts > 1 else named
        index = build([(r["k"], r["t"]) for r in chosen.collect()], stats, shared_run, block)
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            import pyarrow as pa

            for batch in batches:
                a, b = [], []
                for k, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    for i in leaks(sent.value, t, window, step, score, edit):
                        a.append(k.as_py())
                        b.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b, pa.int64())], names=[doc_key, item_key])

        part = rows.mapInArrow(run, f"`{doc_key}` {doc_kind}, `{item_key}` BIGINT")
        out = part if out is None else out.unionByName(part)
    return out.select(doc_key, F.col(item_key).cast(keys).alias(item_key)).distinct()
