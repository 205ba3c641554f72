import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attune.llm import abuse, consensus, defects, forest, leakage, linear, pii, queries, ranking, text, tokens
from tests.llm import unseen

VOCABULARY = f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


# 1


def rankings(spark, rows):
    return spark.createDataFrame(rows, "idx INT, user_id INT, ranking MAP<STRING,INT>, extra STRING")


def test_consensus_follows_careful_annotators(spark):
    rng = random.Random(1)
    names, rows, truth = list("abcdefghi"), [], {}
    for i in range(60):
        order = rng.sample(names, 9)
        truth[i] = order[0]
        for u in range(4):  # careful
            rows.append((i, u, {m: min(5, max(1, 1 + (k + 1) // 2 + (rng.random() < 0.2))) for k, m in enumerate(order)}, "x"))
        for u in range(10, 16):  # random
            rows.append((i, u, {m: rng.randint(1, 5) for m in names}, "x"))
    c = consensus.consensus(rankings(spark, rows + rows[:5]))
    got = {r["item"]: r["label"] for r in c.scores.where("place = 1").collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.8
    w = {r["annotator"]: r["weight"] for r in c.annotators.collect()}
    assert min(w[u] for u in range(4)) > 5 * max(w[u] for u in range(10, 16))
    assert 0 < c.agreement.first()["alpha"] < 1


def test_consensus_edges(spark):
    rows = [(1, 1, {"A_b": 1, "c": 2}, None), (1, 1, {"A_b": 1, "c": 2}, None), (2, 1, None, None), (3, 2, {"c": None, "d": 9}, None), (4, 2, {" A-B ": 1, "c": 1}, None), (None, 2, {"c": 1}, None)]
    c = consensus.consensus(rankings(spark, rows))
    assert {(r["item"], r["label"]) for r in c.scores.where("place = 1").collect()} == {(1, "a-b"), (4, "a-b")}
    empty = consensus.consensus(rankings(spark, []))
    assert empty.scores.count() == 0 and empty.annotators.count() == 0


# 4


def games(spark, rows):
    return spark.createDataFrame(rows, "modela STRING, modelb STRING, result INT, model INT")


def test_ranking_recovers_strengths_and_both_forms_agree(spark):
    rng = random.Random(2)
    true = {m: 1.6**-i for i, m in enumerate("abcdef")}
    rows = []
    for i in range(6000):
        x, y = rng.sample("abcdef", 2) if rng.random() < 0.6 else ("a", rng.choice("bcdef"))
        rows.append((x, y, 1 if rng.random() < true[x] / (true[x] + true[y]) else 2, i))
    local = ranking.global_ranking(games(spark, rows)).orderBy("place").collect()
    assert [r["model"] for r in local] == list("abcdef")
    far = ranking.global_ranking(games(spark, rows), max_local=2, tol=1e-8).orderBy("place").collect()
    for a, b in zip(local, far, strict=True):
        assert (a["place"], a["model"], a["wins"]) == (b["place"], b["model"], b["wins"]) and a["strength"] == pytest.approx(b["strength"], rel=1e-6)


def test_ranking_forms_agree_without_a_finite_maximum(spark):
    rows = [("a", "b", 1, 1), ("a", "b", 1, 2), ("b", "c", 1, 3), ("c", "b", 1, 4), ("a", "c", 0, 5), ("d", "a", 1, 6)]
    local, far = (ranking.global_ranking(games(spark, rows), max_local=m, prior=6.0, tol=1e-8).orderBy("place").collect() for m in (1_000, 2))
    assert [r["model"] for r in local] == [r["model"] for r in far]
    assert [r["strength"] for r in far] == pytest.approx([r["strength"] for r in local], rel=1e-6)


def test_ilsr_is_the_maximum_likelihood():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 20, (5, 5)).astype(float)
    np.fill_diagonal(w, 0)
    s = ranking.ilsr(w)
    expected = (w + w.T) * s[:, None] / (s[:, None] + s[None, :] + np.eye(5))
    np.fill_diagonal(expected, 0)
    assert expected.sum(1) == pytest.approx(w.sum(1), rel=1e-6)  # the likelihood's gradient is zero


def test_ranking_edges(spark):
    rows = [("A_b", "c", 1, 1), ("a-b ", "c", 1, 2), ("c", "c", 1, 3), (None, "c", 1, 4), ("c", "a-b", 7, 5), ("c", "a-b", None, 6)]
    got = ranking.global_ranking(games(spark, rows)).collect()
    assert [(r["place"], r["model"]) for r in got] == [(1, "a-b"), (2, "c")] and got[0]["comparisons"] == 2
    assert ranking.global_ranking(games(spark, [])).count() == 0
    ties = ranking.global_ranking(games(spark, [("x", "y", 0, 1)])).collect()
    assert [r["model"] for r in ties] == ["x", "y"]


# 5


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, vector ARRAY<FLOAT>, cosine STRING")


def test_forest_recall_and_exactness(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 24))
    x = np.vstack([base, base[:300] + 0.3 * rng.standard_normal((300, 24))]) * rng.uniform(0.1, 20, (1800, 1))
    got = {(r["id"], r["other"]) for r in forest.similar(vectors(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]), dim=24, k=3, least=0.8, block=64, rows_per_bucket=400).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    assert len(got & want) / len(want) > 0.97 and len(got & want) == len(got)


def test_forest_edges(spark):
    v = [1.0, 0.0, 0.5, 0.2]
    bad = [(100, None, "a"), (101, [], "a"), (102, [0.0] * 4, "a"), (103, [float("nan")] * 4, "a"), (104, [1.0] * 3, "a"), (105, [1.0, None, 1.0, 1.0], "a"), (106, [float("inf")] * 4, "a"), (None, v, "a")]
    copies = [(i, [c * (1 + i % 3) for c in v], "a") for i in range(40)]
    got = forest.similar(vectors(spark, copies + copies[:3] + bad), dim=4, k=5, least=0.8).collect()
    near = {}
    for r in got:
        near.setdefault(r["id"], []).append(r["other"])
    assert set(near) == set(range(40)) and all(len(x) == 5 and i not in x for i, x in near.items())
    assert sorted(near[39]) == [0, 1, 2, 3, 4] and sorted(near[2]) == [0, 1, 3, 4, 5]
    assert forest.similar(vectors(spark, []), dim=4).count() == 0
    assert forest.similar(vectors(spark, copies[:1]), dim=4).count() == 0


def test_forest_deals_out_a_hot_string():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 8)).astype(np.float32)
    x[:700] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = forest.fit(x, 2, 10, 8, 1)
    size = np.bincount(m.bucket(m.strings(x, 0), np.arange(2000), 0), minlength=10)
    assert size.max() < 450


def hot_group(share, noise, rows=6000, dim=24):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((rows, dim))
    m = int(rows * share)
    x[:m] = x[0] + noise * rng.standard_normal((m, dim))
    return x.astype(np.float32), m


@pytest.mark.parametrize("share,noise", [(0.4, 0.003), (0.4, 0.02), (0.2, 0.001)])
def test_forest_recall_in_a_hot_group_of_distinct_near_vectors(spark, share, noise):
    x, m = hot_group(share, noise)
    got = {(r["id"], r["other"]) for r in forest.similar(vectors(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]), dim=24, k=3, least=0.8, block=64, rows_per_bucket=1000).where(f"id < {m}").collect()}
    u = x[:m].astype(float) / np.linalg.norm(x[:m].astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    # any row as near as the third counts, as such cosines are equal up to rounding
    third = -np.partition(-s, 2, axis=1)[:, 2]
    assert sum(s[a, b] >= third[a] for a, b in got) / (3 * m) > 0.9


def test_forest_splits_a_hot_string_by_tree():
    x, m = hot_group(0.4, 1e-5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = forest.fit(x, 2, 12, 16, 1, 0.1)
    ids = np.arange(len(x))
    a, b = (model.bucket(model.strings(x, t), ids, t, x)[:m] for t in range(2))
    assert len(np.unique(a)) > 1 and len(np.unique(b)) > 1
    assert np.bincount(a).max() < 2 * len(x) / 12
    assert len(np.unique(np.stack([a, b]), axis=1).T) > max(len(np.unique(a)), len(np.unique(b)))


def test_forest_windows_reach_over_borders():
    x, _ = hot_group(0, 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = forest.fit(x, 2, 6, 16, 1, 0.1)
    strings = model.strings(x, 0)
    rows, above = model.guests(strings, 0)
    assert 5 * 90 <= len(rows) <= 5 * 110
    assert (above == model.bucket(strings, np.arange(len(x)), 0)[rows] + 1).all()


# 6


@pytest.fixture(scope="module")
def enc():
    return tokens.encoding(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_encoding_round_trip(t):
    e = tokens.encoding(VOCABULARY)
    assert tokens.decode(e, tokens.encode(e, t)) == t


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" " * 30, "\n\n\n", "   ", "a" * 50, "\x1c\x1d", "👩‍👧"])), max_size=30))
def test_cut_texts_encode_like_whole_ones(parts):
    e, old = tokens.encoding(VOCABULARY), (tokens.LONG_BLANKS, tokens._BLANKS)
    t = "".join(parts)
    try:
        tokens.LONG_BLANKS, tokens._BLANKS = 2, tokens.re.compile(f"[{tokens.SPACE}]{{5,}}")
        whole, cut = e.encode_ordinary(t), [i for c in tokens.chunks(t, 7) for i in tokens.encode(e, c)]
        assert tokens.encode(e, t) == whole and cut == whole
    finally:
        tokens.LONG_BLANKS, tokens._BLANKS = old


def test_encoding_extremes(spark, enc):
    long = "a" * 300_000 + " " * 1_200_000 + "b" + "\n" * 50_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (4, "<|endoftext|> é", 0), (4, "<|endoftext|> é", 0)], "doc_id BIGINT, text STRING, ids INT")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, "doc_id", "text", VOCABULARY).collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[4]
    assert tokens.decode(enc, got[3]) == long
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


def test_encoding_equals_the_other_library(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for s in ("Hello  world's \n\n x", "日本語のコメント ²½™ é", "\ttabs\t and   blanks  ", "👩‍👧 family"):
        assert tokens.encode(enc, s) == t.encode(s, add_special_tokens=False).ids


# 7

ITEM = "Nobody at the depot hid the fountain, yet every frosty inkwell there wrapped it against the wind while two silent drummers counted pumpkins near the quarry."
HEAD = "Read the sentence and its three rewrites, then put the rewrites in order of how civil they sound to you. "


def test_leakage_cases(spark):
    rng = random.Random(4)
    other = [HEAD + " ".join(rng.choice("amber kettle violin ropeworks marble thimble gently polished beside under seven tailors orchard lantern".split()) for _ in range(30)) for _ in range(20)]
    items = spark.createDataFrame([(1, HEAD + ITEM, 0), (2, None, 0), (3, "", 0), *[(10 + i, t, 0) for i, t in enumerate(other)]], "item_id INT, text STRING, doc_id INT")
    cut = " ".join(ITEM.split()[3:20])
    docs = [
        "noise before. " + ITEM + " noise after.",
        "> " + ITEM.upper().replace(" ", "\n> "),
        "pre " + cut + " post",
        "x " + ITEM.replace("fountain", "pond").replace("silent", "loud") + " y",
        "w" + ITEM.replace("e", "e​"),
        HEAD + "something else entirely",
        "He said nobody at the depot hid and left.",
        " ".join(sorted(ITEM.split())),
        None,
        "",
        "filler words " * 20_000 + ITEM,
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)] + [(0, docs[0], 1)], "doc_id BIGINT, text STRING, item_id INT")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.contaminated(df, items).collect()}
    assert got == {(i, 1) for i in (0, 1, 2, 3, 4, 10)}
    assert leakage.contaminated(df.limit(0), items).count() == 0
    assert leakage.contaminated(df, items.limit(0)).count() == 0
    blocks = leakage.contaminated(df, items, items_per_index=8)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got


def test_block_max_wand_equals_exhaustive_scoring():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=40))) for i in range(80)]
    ix = leakage.build(rows, leakage.gather(lambda: (t for _, t in rows), 5, 10**9, 8, 0.5), 8, 4)
    for _ in range(150):
        q = sorted({ix.vocabulary[w] for w in rng.choices(list(ix.vocabulary), k=8)})
        want = {}
        for t in q:
            for d, s in zip(*ix.postings[t], strict=True):
                want[d] = want.get(d, 0) + s
        for th in (1.0, 3.0, 5.0):
            got = leakage.block_max_wand(ix, q, th)
            assert {d for d, _ in got} == {d for d, s in want.items() if s >= th}


# 8

CASES = [
    ("My name is Ilka Brandemark and I wrote the first reply.", {("name", "ilkabrandemark")}),
    ("cc Szelbek, José please", {("name", "szelbekjosé")}),
    ("Mit freundlichen Grüßen, anton vantongel", {("name", "antonvantongel")}),
    ("Write to bram.wielandt AT mail DOT example if the form fails.", {("email", "bramwielandtatmaildotexample")}),
    ("Reply-To: petra+forum [at] example [dot] net", {("email", "petraforumatexampledotnet")}),
    ("mail x@e​xample.org!", {("email", "xexampleorg")}),
    ("Call me on 020 7946 0446 after six.", {("phone", "02079460446")}),
    ("Sie erreichen mich unter +49 (0)30 23125-840.", {("phone", "4903023125840")}),
    ("call zero seven seven zero zero nine zero zero six five one", {("phone", "zerosevensevenzerozeroninezerozerosixfiveone")}),
    ("SSN QQ 44 06 28 D was typed", {("id_number", "qq440628d")}),
    ("Mi DNI es X0002411J.", {("id_number", "x0002411j")}),
    ("I live at 135b Cobbler's Row, second floor.", {("address", "135bcobblersrow")}),
    ("Ich wohne Am Alten Kran 185, dritter Stock.", {("address", "amaltenkran185")}),
    ("J'habite au 76, rue des Tilleuls.", {("address", "76ruedestilleuls")}),
    ("Vivo en Calle del Olmo 37, segundo piso.", {("address", "calledelolmo37")}),
    ("The log says 10.60.6 and 460-61-6000 rows. ISBN 978-0-00-39639-0. Order no. 2626277 contains 2 boxes.", set()),
    ("Table 56 Lane 1 was the best. Main Street opinion shifted by 53 percent. @moss_11 #thread9 nobody@ bounced", set()),
]


#: People that no table and no list names.
UNSEEN = """Please forward the contract to [Beatriz Carvalho] today.
[Kevin O'Brien] and [Aisha Rahman] reviewed the draft.
We met [Giovanni Ferrari] after the talk.
Yesterday [Priya Natarajan] sent the logs.
The keys are with [Magnus Lindahl] until noon.
Dr. [Wolfgang Reiter] will call back.
Best regards, [Chloe Dubarry-Kent]
I heard from [Tariq Siddiqui] that the plan changed.
The note by [Olena Kravchuk] is on the desk.
My name is [Jack T. Sundberg] and I agree.
Frau [Hannelore Zieglmeier] stimmt zu.
Je m'appelle [Bérengère Caillaux].""".split("\n")


@pytest.fixture(scope="module")
def names(spark):
    return pii.learned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")


@pytest.mark.parametrize("t,want", CASES)
def test_personal_data(names, t, want):
    assert {(k, pii.said(t[a:b])) for a, b, k in pii.find(t, names)} == want


@pytest.mark.parametrize("t", UNSEEN)
def test_unseen_names(names, t):
    want = re.findall(r"\[(.*?)\]", t)
    t = re.sub(r"[\[\]]", "", t)
    assert [t[a:b] for a, b, k in pii.find(t, names)] == want


def test_account_numbers_are_no_phones(names):
    t = "Pay to DE89 3704 0044 0532 0130 00 by Monday."
    assert [(t[a:b], k) for a, b, k in pii.find(t, names)] == [("DE89 3704 0044 0532 0130 00", "id_number")]


def test_names_learned_from_wording():
    """Names that one wording announces teach another wording, which teaches further names."""
    people = [f"{a} {b}" for a in ("Ona", "Pio", "Rue", "Sef", "Tia") for b in ("Vost", "Wend", "Xant")]
    texts = [f"My name is {p}. The list is long." for p in people] + [f"the memo from {p} says no" for p in people] + ["the memo from Uma Yarrow says no", "Cedar Lite gave an answer", "cedar wood and lite beer", "cedar and lite"]
    n = pii.Names.learn(texts)
    assert ("from", "says") in n.frames and "ona" in n.given and "vost" in n.family
    t = "the memo from Uma Yarrow says no, Cedar Lite says yes to pio wend"
    assert [t[a:b] for a, b, _ in pii.find(t, n)] == ["Uma Yarrow", "pio wend"]


def test_names_learned_from_all_rows(spark):
    """People and wording that stand in a few of 12,000 rows are learned, as from the texts at once."""
    people = [f"{a} {b}" for a in ("Ona", "Pio", "Rue", "Sef", "Tia") for b in ("Vost", "Wend", "Xant")]
    texts = [f"My name is {p}. The list is long." for p in people] + [f"the memo from {p} says no" for p in people] + ["Best regards, Ona Vost and Pio Wend, Rue Xant", None, ""]
    texts += [f"Cedar Lite gave answer {k} to the list" for k in range(12_000 - len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(5)
    n = pii.learned(df, "doc_id", "text")
    assert n == pii.Names.learn(texts)
    assert n.given == {"ona", "pio", "rue", "sef", "tia"} and n.family == {"vost", "wend", "xant"} and ("from", "says") in n.frames and {"cedar", "lite", "list"} <= n.other


def test_redaction_keeps_the_rest(spark):
    t = "Hi​, my name is Mira Yarborne ; write to mira AT mail DOT example.\r\nBye"
    df = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (3, "", "x")], "doc_id BIGINT, text STRING, kind STRING")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert got == {1: "Hi​, my name is [NAME] ; write to [EMAIL].\r\nBye", 2: None, 3: ""}
    assert pii.personal_data(df).count() == 2 and pii.personal_data(df.limit(0)).count() == 0


def test_long_text_is_read_whole(names):
    t = "word " * 100_000 + "Call me on 020 7946 0446 after six."
    assert [k for _, _, k in pii.find(t, names)] == ["phone"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé́​ѕо½ ＠.9AT[at] \n"), max_size=40))
def test_spans_map_back(t):
    s, at = text.normalise(t)
    assert at is None or (len(at) == len(s) and all(0 <= i < len(t) for i in at) and list(at) == sorted(at))
    for a, b, _ in pii.find(t, pii.Names()):
        assert 0 <= a < b <= len(t)
    unicodedata.normalize("NFC", pii.redact(t, pii.Names()))


# 2 and 3


def test_linear_model_learns_and_calibrates():
    good, bad = [f"the garden plan {i} is fine" for i in range(60)], [f"you rotten fool {i}" for i in range(60)]
    m = linear.NaiveBayesLinear.fit(good + bad, np.array([0.0] * 60 + [1.0] * 60))
    s = m.score(["you rotten liar", "the garden is fine", ""])
    assert s[0] > 0 > s[1]
    assert linear.calibrate(np.array([3.0, 2.0, -2.0, -3.0]), np.array([1, 1, 0, 0])) == pytest.approx(0, abs=1)


@pytest.fixture(scope="module")
def detector(spark, small):
    """As the query trains it, on the smallest tables."""
    from pyspark.sql import functions as F

    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    label = F.lower("label")
    return abuse.detector(read("paraphrase_vectors"), "id", "sentence", F.when(label == "toxic", True).when(label == "non-toxic", False), read("combined_corpus"), "idx", "paraphrase", read("profanity_wordlist"))


def test_abuse_unseen_wording(detector):
    """Fifty abusive and fifty harmless wordings that stand in no list and no table."""
    rough, fine = detector.score(unseen.ABUSIVE) > 0, detector.score(unseen.HARMLESS) > 0
    assert len(unseen.ABUSIVE) == len(unseen.HARMLESS) == 50
    assert rough.mean() >= 0.9 and fine.mean() <= 0.4


def test_abuse_needs_no_seed_wording_of_the_tables(spark, small):
    """Seed sentences are general: none stands in a table."""
    texts = set()
    for name, cols in (("combined_corpus", "sentence, explode_outer(paraphrase) p"), ("paraphrase_vectors", "sentence, paraphrase p"), ("documents", "text sentence, text p")):
        for r in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").selectExpr(*[c.strip() for c in cols.split(", ")]).collect():
            texts |= {abuse.read(t) for t in r if t}
    whole = "\n".join(texts)
    long = [t for t in abuse.WORTHLESS + abuse.FINE if len(t.split()) >= 3]
    assert [t for t in long if abuse.read(t) in whole] == []


def test_abuse_learns_from_labels_some_of_which_are_wrong():
    rng = random.Random(1)
    heads = [f"The {a} of the {b}" for a in ("plan", "list", "draft", "map") for b in ("club", "bus", "match")]
    tails = ["is late by three weeks", "needs another look", "gives the wrong price twice", "was changed without asking"]
    rows = [f"{rng.choice(heads)} {rng.choice(tails)}." for _ in range(600)]
    marked = [(r + " Snarks have mush for brains." * (i % 3 == 0) + " The vermin visit is on Friday." * (i % 3 == 1), (i % 3 == 0) ^ (rng.random() < 0.2)) for i, r in enumerate(rows)]
    d = abuse.train(marked, rows, ["snark", "vermin"])
    s = d.score(["The map of the club is late. Snarks have mush for brains.", "Sn@rks have mush for brains.", "The vermin visit is on Friday.", rows[0], "", None])
    assert list(s > 0) == [True, True, False, False, False, False]


def test_long_sentences_are_read_in_runs():
    clauses = [f"part number{c}," for c in "abcdefgh"]
    got = abuse.units(" ".join(clauses))
    runs = [abuse.read(" ".join(clauses[i : i + 6])) for i in range(3)]
    assert set(runs) <= set(got) and set(map(abuse.read, clauses)) <= set(got) and len(got) == 11
    assert abuse.read(" ".join(clauses[:3])) in abuse.units(" ".join(clauses[:3]))


def test_abuse_edges(spark, detector):
    df = spark.createDataFrame([(1, None, None, "a"), (2, "", [], "a"), (3, "Fine words. " * 3000 + "You rotten idiot.", [None, "You rotten idiot"], None)], "idx INT, sentence STRING, paraphrase ARRAY<STRING>, source STRING")
    got = {r["idx"]: r for r in abuse.scored(df, detector, "idx", "sentence", "paraphrase", ("source",)).collect()}
    assert got[1]["sentence_score"] is None and got[2]["rewrite_score"] is None
    assert got[3]["sentence_score"] > 0 and got[3]["rewrite_score"] > 0
    assert abuse.scored(df.limit(0), detector, "idx", "sentence", "paraphrase").count() == 0


@pytest.fixture(scope="module")
def classifier(spark):
    return defects.classifier(queries.table(spark, "/root/testdata/sf0.01", "paraphrase_generation"), "gen_id", "sentence", "result.reasoning", "result.paraphrase")


def test_defects_held_out(classifier):
    s, r = "The wool order is late by three weeks and nobody told the volunteers, you rotten snark!", "No new claim is added. The style stays informal."
    good = "Sorry, but the wool order is late by three weeks and nobody told the volunteers."
    cases = [
        ((s, r, good), set()),
        ((s, r, good.rstrip(".")), set()),
        ((s, r, "I am not able to follow this, because the wool order is late by three weeks and nobody told the volunteers."), set()),
        ((s, r, ""), {"empty"}),
        ((s, r, None), {"empty"}),
        ((s, "N/A", good), {"empty"}),
        ((None, None, None), {"empty"}),
        ((s, r, "Sorry, but the wool order is late by three we"), {"truncated"}),
        ((s, "No new claim is added. The style sta", good), {"truncated"}),
        ((s, r, "I'm sorry, but I cannot help with hateful content."), {"refusal"}),
        ((s, r, f'Paraphrase: "{s}"'), {"copy"}),
        ((s, r, s.upper()), {"copy"}),
        ((s, r, "Es tut mir leid, aber die Anleitung für den Kessel kommt drei Wochen zu spät."), {"other_language"}),
        ((s, "Стиль остался прежним, грубые слова убраны.", good), {"other_language"}),
    ]
    got = classifier.score([c[0] for c in cases])
    wrong = [(c[0], want, have) for i, (c, want) in enumerate([(c, c[1]) for c in cases]) if (have := {n for n in defects.DEFECTS if got[n][i] > 0}) != want]
    assert wrong == []


def test_refusals_of_unseen_wording(classifier):
    """Refusals that no part list spells out; a few may be missed, a sound rewrite may not be taken for one."""
    s, r = "The choir rota is a mess and you are a fool!", "No new claim is added. The style stays informal."
    refused = """I have to turn this down because it attacks people.
I can't take part in rewording abuse.
That is not a text I can work with.
Let us talk about something else, I will not rewrite insults.
This goes against what I may produce.
My policy does not permit paraphrases of hateful remarks.
I must pass on this one, the language is abusive.
I cannot fulfil a wish like this.
I am sorry, I can't reword hateful messages.
Rewriting such words is not possible for me.
I decline to process that.
As an assistant I will not touch slurs.""".split("\n")
    got = classifier.score([(s, r, t) for t in refused] + [(s, r, "The choir rota is a mess."), (s, r, "Sorry, but the choir rota is hard to read.")])["refusal"] > 0
    assert got[:-2].mean() >= 0.9 and not got[-2:].any()


def test_defects_edges(spark, classifier):
    schema = "gen_id BIGINT, sentence STRING, result STRUCT<reasoning: STRING, paraphrase: STRING>, defect STRING"
    df = spark.createDataFrame([(1, "a b c.", None, "x"), (2, None, ("", ""), "x")], schema)
    got = {(r["gen_id"], r["defect"]) for r in defects.broken_pairs(df, model=classifier).collect()}
    assert got == {(1, "empty"), (2, "empty")}
    assert defects.broken_pairs(df.limit(0), model=classifier).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_with_its_columns(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    want = {"p1_found": ["idx", "model"], "p2_found": ["gen_id", "defect"], "p3_found": ["idx", "field"], "p4_found": ["place", "model"], "p5_found": ["id_a", "id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind", "pii_text"]}
    if name in want:
        assert df.columns == want[name]
        rows = [str(r) for r in df.collect()]
        assert rows and len(rows) == len(set(rows))
    else:
        assert df.count() > 0
