import hashlib
import itertools
import math
import os
import random
import re
import string
import subprocess
import sys
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attune.functions import python_text, scalars
from attune.functions import text as X
from attune.operators import agreement, arena, inference, joins, ordering, pairs, profanity, ranks, sampling, sets, similarity, stats, summaries
from attune.plans import base, catalog
from tests.parity import connect, plain, rows_of_sql

BATTLE = "a STRING, b STRING, result INT"


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([("i", m, s) for m, s in (("a", 9.0), ("b", 7.0), ("c", 9.0), ("d", 5.0))], "item STRING, m STRING, s DOUBLE")
    r = {x["m"]: x for x in ranks.name_order_rank(ranks.ranked(df, ["item"], "s", "m"), ["item"], "s", "m").collect()}
    assert [r[m]["rank_dense"] for m in "abcd"] == [1, 2, 1, 3]
    assert [r[m]["rank_competition"] for m in "abcd"] == [1, 3, 1, 4]
    assert [r[m]["rank_fractional"] for m in "abcd"] == [1.5, 3, 1.5, 4]
    assert [r[m]["rank_name_order"] for m in "abcd"] == [1, 2, 3, 4]


def test_ranks_null_scores_come_last_and_empty_is_empty(spark):
    df = spark.createDataFrame([("i", "a", None), ("i", "b", 1.0)], "item STRING, m STRING, s DOUBLE")
    r = {x["m"]: x["rank_dense"] for x in ranks.ranked(df, ["item"], "s", "m").collect()}
    assert r == {"b": 1, "a": 2}
    assert ranks.ranked(df.limit(0), ["item"], "s", "m").count() == 0


def test_bracket_merge_moves_all_ties(spark):
    first = spark.createDataFrame([(1, 0, "a", 3), (1, 0, "b", 3), (1, 0, "c", 4), (1, 1, "d", 3)], "idx INT, triplet INT, model STRING, rank INT")
    final = spark.createDataFrame([(1, 0, 3, 1)], "idx INT, triplet INT, rank INT, new_rank INT")
    got = {r["model"]: r["rank"] for r in ranks.bracket_merge(first, final).collect()}
    assert got == {"a": 1, "b": 1, "c": 4, "d": 3}


def test_wins_fraction_and_ties(spark):
    b = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "a", 0), ("a", "c", 0)], BATTLE)
    assert {r["model"]: (r["wins"], r["battles"]) for r in pairs.wins(b).collect()} == {"a": (1, 4), "b": (1, 3), "c": (0, 1)}
    f = {(r["model"], r["opponent"]): r["fraction"] for r in pairs.win_fraction(b).collect()}
    assert f["a", "b"] == 0.5 and f["a", "c"] is None
    assert pairs.wins(b.limit(0)).count() == 0


@pytest.mark.parametrize("votes,want", [((1, 1, 2), 1), ((0, 1, 2), 0), ((2, 2, 2), 2), ((1, 1, 2, 2), 0)])
def test_majority(spark, votes, want):
    df = spark.createDataFrame([(7, v) for v in votes], "idx INT, vote INT")
    assert pairs.majority(df, ["idx"], "vote").first()["majority"] == want


def elo_loop(rows):
    r = {}
    for a, b, z in rows:
        x, y = r.get(a, 1000.0), r.get(b, 1000.0)
        e = 1 / (1 + 10 ** ((y - x) / 400))
        s = {1: 1.0, 2: 0.0, 0: 0.5}[z]
        r[a], r[b] = x + 4 * (s - e), y + 4 * (1 - s - (1 - e))
    return r


def test_elo_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, *rng.sample("abcde", 2), rng.randrange(3)) for i in range(400)]
    got = pairs.elo(spark.createDataFrame([("g", *r) for r in rows], f"g STRING, i INT, {BATTLE}"), ["g"], ["i"])
    assert {r["model"]: r["rating"] for r in got.collect()} == pytest.approx(elo_loop([r[1:] for r in rows]), abs=1e-9)
    first = pairs.elo(spark.createDataFrame([("g", 1, "a", "b", 1)], f"g STRING, i INT, {BATTLE}"), ["g"], ["i"])
    assert {r["model"]: r["rating"] for r in first.collect()} == {"a": 1002.0, "b": 998.0}


def test_elo_bootstrap_orders_a_clear_winner(spark):
    b = spark.createDataFrame([("a", "b", 1)] * 50 + [("b", "c", 1)] * 50, BATTLE)
    r = {x["model"]: x for x in pairs.elo_bootstrap(b, 20).collect()}
    assert r["a"]["median"] > r["b"]["median"] > r["c"]["median"]
    assert r["a"]["lower"] <= r["a"]["median"] <= r["a"]["upper"] + 1


def test_debias(spark):
    df = spark.createDataFrame([([8.0, 6.0], [7.0, 9.0]), ([8.0, 6.0], [8.0, 6.0])], "f ARRAY<DOUBLE>, r ARRAY<DOUBLE>")
    assert col(df, pairs.debias(F.col("f"), F.col("r"))) == [[8.5, 6.5], [7.0, 7.0]]


def test_compare3_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (float("nan"), 1.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    assert col(df, pairs.compare3(F.col("a"), F.col("b"))) == [2, 1, 0, None, None]


def test_parse_score(spark):
    for text, want in (("8, 6", [-1, -1]), ("8,6", [8, 6]), ("8 6\nwhy", [8, 6]), ("n/a", [-1, -1]), ("", [-1, -1])):
        assert one(spark, text, X.parse_score) == want


def test_text_functions(spark):
    assert one(spark, "can't e-mail, 3.5!", X.word_tokens) == ["can't", "e-mail", ",", "3", ".", "5", "!"]
    assert one(spark, "soooo goood", X.squeeze) == "soo good"
    assert one(spark, "@ann hi @anna me@x.com", X.mask_users) == "@USER hi @USER me@USER"
    assert one(spark, "@fool stays, @ann goes", lambda c: X.mask_users(c, ("fool,", "fool"))).startswith("@fool stays")
    assert one(spark, "a  b . c", X.collapse_space) == "a b . c"
    assert one(spark, "<p>Hi &amp; bye<script>x()</script></p>", X.strip_html) == "Hi & bye"
    assert one(spark, "'it is  done . now'", X.tidy) == "It is done. Now"
    assert one(spark, "Café ñandú straße", X.unaccent) == "Cafe nandu strasse"
    assert one(spark, "see you :( \U0001f600", X.strip_emoji) == "see you Frown, sad, andry or pouting "
    assert one(spark, ":-)) ;) >:( 12:3 a:b http://x", X.strip_emoji) == "Very happy Wink or smirk Frown, sad, andry or pouting 12:3 a:b http://x"
    assert one(spark, "hi @Bob and @r$e", lambda c: X.clean(c, ("r\\$e",))) == "Hi @user and @r$e"
    assert one(spark, "x {\"a\": 1} y", X.json_block) == '{"a": 1}'
    assert one(spark, "Assistant 1 beats Assistant 2", X.swap_answers) == "Assistant 2 beats Assistant 1"
    assert one(spark, None, X.strip_ip) is None and one(spark, "", X.tidy) == ""
    assert one(spark, "answer###", lambda c: X.stop_partial(c, "###Human")) is True
    got = one(spark, "Final Reasoning: polite\nFinal Paraphrase: Hello there.\nmore", X.extract_answer)
    assert got["reasoning"] == ": polite" and got["paraphrase"] == "Hello there."
    assert one(spark, "nothing here", X.extract_answer) is None


def test_very_long_text(spark):
    t = "word " * 200_000
    assert one(spark, t, lambda c: F.size(X.word_tokens(c))) == 200_000
    assert one(spark, t, lambda c: F.length(X.clean(c))) == 5 * 200_000 - 1


def test_python_text(spark):
    assert one(spark, "['a', 1]", python_text.parse_literal) == ["a", "1"]
    assert one(spark, "__import__('os')", python_text.parse_literal) is None
    assert one(spark, "<b>x</b><style>y</style> z", python_text.parse_html) == "x z"
    assert one(spark, "<U+00E9>\t", python_text.unescape_codepoints) == "é "
    assert one(spark, "é", python_text.escape_unicode) == "\\xe9"
    assert one(spark, None, python_text.full_unaccent) is None


def test_profanity_equals_brute_force(spark):
    words = ["snark", "blob", "tosser"]
    texts = ["you sn@rk and 8lob", "a bl0b, t0$$er!", "snarks blobby", "", None, "SNARK snark"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    listed = spark.createDataFrame([(w,) for w in [*words, None]], "word STRING")
    got = {(r["id"], r["token"], r["word"]) for r in profanity.matches(df, "id", "text", listed).collect()}
    import re

    want = set()
    for i, t in enumerate(texts):
        for tok in re.findall(r"[A-Za-z0-9@$*!]+", t or ""):
            for w in words:
                if len(tok) == len(w) and all(c in X.LOOKALIKES.get(k, k) for c, k in zip(tok.lower(), w, strict=True)):
                    want.add((i, tok, w))
    assert got == want and want


def test_profanity_as_first_query_of_a_session(small):
    """Columns of a session's first query have the low numbers that Spark also gives lambda variables."""
    code = f"""
from attune.plans import catalog
from attune.session import session
spark = session("local[2]", 2, **{{"spark.driver.memory": "1g"}})
print("ROWS", len(catalog.QUERIES["txt_profanity_detect"](spark, {small!r}).collect()))
"""
    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=300)
    import pyarrow.parquet as pq

    words = {w.lower() for w in pq.read_table(f"{small}/profanity_wordlist.parquet")["word"].to_pylist() if w}
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    tokens = {(k, t) for k, text in docs.items() for t in re.findall(r"[A-Za-z0-9@$*!]+", text or "")}
    want = [(k, t, w) for k, t in tokens for w in words if len(t) == len(w) and all(c in X.LOOKALIKES.get(l, l) for c, l in zip(t.lower(), w, strict=True))]
    assert want and f"ROWS {len(want)}\n" in run.stdout, run.stderr[-2000:]


def walked(text, words):
    """(token, word) of the walk over a text, character by character."""
    inside = lambda c: c in string.ascii_letters + string.digits + "@$*\"'" or unicodedata.category(c)[0] in "LM"
    spelled = lambda f, w: len(f) == len(w) and all(c in X.LOOKALIKES.get(k, k) for c, k in zip(f, w, strict=True))
    runs, begin = [], None
    for i, c in enumerate(text + " "):
        if inside(c):
            begin = i if begin is None else begin
        elif begin is not None:
            runs.append((begin, i))
            begin = None
    following = max([1, *[sum(not inside(c) for c in w) for w in words]])
    forms = {(t, t) for t in re.findall(r"[A-Za-z0-9@$*!]+", text)}
    for i, (a, b) in enumerate(runs):
        for _, end in runs[i : i + following + 1]:
            forms |= {(text[a:b], text[a:end]), (text[a:b], "".join(filter(inside, text[a:end])))}
    return {(t, w) for t, f in forms for w in words if spelled(f.lower(), w)}


def test_profanity_walk_joins_words_as_brute_force_does(spark):
    words = ["snark", "tosser", "glim the blob", "blob-head", "imbécil", "b!tz", "a"]
    texts = ["sn ark", "s\nn\n@rk", "s n a rk", "t0s, ... $er!", "Glim The BLOB glim  the blob", "bl0b-head", "IMBÉCIL! imb écil", "he's \"snark\"", "l'snark", "snаrk sn\u0301ark", "B!TZ", "snark", "x snar k", "4", "", None]
    rng = random.Random(5)
    texts += ["".join(rng.choices(["s", "n", "ark", "@rk", "to", "5S", "er", "glim", "the", "blob", "head", "é", "'", "!", "-", " ", "  ", "\n", "…"], k=400)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = [tuple(r) for r in profanity.walk(df, "id", "text", spark.createDataFrame([(f" {w.title()} ",) for w in words] + [(None,), (" ",)], "word STRING")).collect()]
    assert set(got) == {(i, *x) for i, t in enumerate(texts) for x in walked(t or "", words)} and len(got) == len(set(got))
    assert {(0, "sn", "snark"), (1, "s", "snark"), (3, "t0s", "tosser"), (4, "Glim", "glim the blob"), (5, "bl0b", "blob-head"), (6, "imb", "imbécil"), (8, "snark", "snark"), (12, "snar", "snark"), (13, "4", "a")} <= set(got)
    assert not {i for i, _, w in got if w == "snark"} & {2, 9} and sum(x[0] == 4 for x in got) == 1


def test_profanity_detect_walks_as_first_query_of_a_session(small):
    code = f"""
from attune.plans import catalog
from attune.session import session
spark = session("local[2]", 2, **{{"spark.driver.memory": "1g"}})
print("ROWS", sorted(tuple(r) for r in catalog.QUERIES["txt_profanity_detect"](spark, {small!r}).collect()))
"""
    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=300)
    import pyarrow.parquet as pq

    words = {w.strip().lower() for w in pq.read_table(f"{small}/profanity_wordlist.parquet")["word"].to_pylist() if w}
    docs = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {(r["doc_id"], *x) for r in docs for x in walked(r["text"] or "", words)}
    assert any(len(t) < len(w) for _, t, w in want) and f"ROWS {sorted(want)}\n" in run.stdout, run.stderr[-2000:]


def test_arrays_and_maps(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], {"a": 2, "b": 1})], "v ARRAY<INT>, m MAP<STRING,INT>")
    assert df.select(scalars.regroup(F.col("v"), 2)).first()[0] == [[1, 2], [3, 4], [5]]
    assert len(df.select(scalars.upper_triangle(F.col("v"))).first()[0]) == 10
    assert [e["key"] for e in df.select(scalars.entries_by_value(F.col("m"))).first()[0]] == ["b", "a"]
    assert df.select(scalars.updated(F.col("m"), F.create_map(F.lit("a"), F.lit(9)))).first()[0] == {"a": 9, "b": 1}
    empty = spark.createDataFrame([([],)], "v ARRAY<INT>")
    assert empty.select(scalars.regroup(F.col("v"), 2)).first()[0] == []
    assert empty.select(scalars.upper_triangle(F.col("v"))).first()[0] == []


def test_row_index_equals_sorted_order(spark):
    rng = random.Random(3)
    keys = [(rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(keys, "k INT, i INT").repartition(7)
    got = sorted((r["row_index"], r["k"], r["i"]) for r in ordering.row_index(df, [F.col("k"), F.col("i")]).collect())
    assert [x[0] for x in got] == list(range(3000)) and [x[1:] for x in got] == sorted(keys)
    assert ordering.row_index(df.limit(0), [F.col("k")]).count() == 0


def test_sets_and_sampling(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1)], "id INT, t STRING, s INT")
    assert {r["id"]: r["t"] for r in sets.last_wins(df, ["id"], [F.col("s")]).collect()} == {1: "y", 2: None}
    assert sets.first_by_digest(df, "t", [F.col("id")]).count() == 2
    assert sampling.sample_n(df, "id", 0, 1).count() == 0
    assert col(df, sampling.choice(F.array("t"), F.col("id"), 1)) == ["x", "y", ""]
    with pytest.raises(Exception, match="unknown key"):
        joins.lookup_strict(df, spark.createDataFrame([(1, "v")], "id INT, v STRING"), "id", "v").collect()


def test_skewed_digest_keeps_one(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"))
    got = sets.first_by_digest(df, "t", [F.col("id")])
    assert got.count() == 20_001 and got.where("t = 'same'").first()["id"] == 0


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_rouge_l_and_levenshtein_equal_loops(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices("abcd", k=rng.randrange(9))), " ".join(rng.choices("abcd", k=rng.randrange(9)))) for _ in range(60)] + [(None, "a"), ("é", "e")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    for r in df.select("a", "b", similarity.rouge_l(F.col("a"), F.col("b")).alias("s"), F.levenshtein("a", "b").alias("d")).collect():
        x, y = (r["a"] or "").split(), (r["b"] or "").split()
        x, y = ([w for w in v if w.isascii()] for v in (x, y))
        want = 2 * lcs(x, y) / (len(x) + len(y)) if x and y and lcs(x, y) else 0.0
        assert r["s"] == pytest.approx(want)
        if r["a"] == "é":
            assert r["d"] == 1


def test_topk_rules(spark):
    rows = [(i, [1.0, 0.0], "same") for i in range(6)] + [(9, [1.0, 0.1], "other"), (10, [0.0, 0.0], "zero"), (11, None, "null")]
    df = spark.createDataFrame(rows, "id INT, v ARRAY<DOUBLE>, t STRING")
    q = df.where("id = 0")
    legacy = similarity.topk(q, df, "id", "v", "t", 3)
    strict = similarity.topk(q, df, "id", "v", "t", 3, strict=True)
    assert col(legacy, "id") == [] and col(strict, "id") == [9]


def test_pairwise_summary_in_blocks_equals_one_block(spark):
    rng = random.Random(4)
    rows = [("g", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [("g", 99, [0.0] * 4), ("g", 98, None), ("lone", 1, [1.0] * 4)]
    df = spark.createDataFrame(rows, "g STRING, i INT, v ARRAY<DOUBLE>")
    one = {r["g"]: r for r in similarity.pairwise_summary(df, "g", "i", "v").collect()}
    many = {r["g"]: r for r in similarity.pairwise_summary(df, "g", "i", "v", block=20).collect()}
    assert set(one) == set(many) == {"g"}
    for c in ("mean", "std", "low", "high"):
        assert one["g"][c] == pytest.approx(many["g"][c])


def test_self_bleu_equals_pairs(spark):
    texts = ["a b a b", "a b c", "d e", ""]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g STRING, i INT, t STRING")
    got = {r["i"]: r["self_bleu"] for r in similarity.self_bleu(df, ["g"], "i", "t").collect()}
    for i, t in enumerate(texts[:3]):
        logs = 0.0
        for n in (1, 2):
            grams = lambda s, n=n: [tuple(s.split()[k : k + n]) for k in range(len(s.split()) - n + 1)]
            mine = grams(t)
            hit = sum(min(mine.count(g), max(grams(o).count(g) for j, o in enumerate(texts) if j != i)) for g in set(mine))
            logs += math.log((hit or 0.1) / len(mine))
        assert got[i] == pytest.approx(math.exp(logs / 2))


def test_statistics(spark):
    df = spark.createDataFrame([("g", 0.05), ("g", 0.05)], "g STRING, p DOUBLE")
    r = stats.fisher_combine(df, ["g"], "p").first()
    assert r["chi2"] == pytest.approx(11.9829, abs=1e-4) and r["dof"] == 4 and r["p"] == pytest.approx(0.01748, abs=1e-5)
    p = spark.createDataFrame([(0.5, 20), (1.0, 5), (None, 9)], "r DOUBLE, n INT").select(stats.student_p(F.col("r"), F.col("n"))).collect()
    assert p[0][0] == pytest.approx(0.02477, abs=1e-4) and p[1][0] == 0 and p[2][0] is None
    rng = random.Random(5)
    rows = [("g", rng.randrange(5), rng.randrange(4)) for _ in range(80)]
    d = stats.somers_d(spark.createDataFrame(rows, "g STRING, x INT, y INT"), ["g"], "x", "y").first()["d"]
    num = den = 0
    for (_, a, b), (_, c, e) in itertools.combinations(rows, 2):
        if a != c:
            den += 1
            num += (a - c) * (b - e) > 0
            num -= (a - c) * (b - e) < 0
    assert d == pytest.approx(num / den)
    perm = stats.permutation_p(spark.createDataFrame([("g", float(i), float(i)) for i in range(12)], "g STRING, x DOUBLE, y DOUBLE"), ["g"], "x", "y", rounds=500).first()
    assert perm["r"] == pytest.approx(1) and perm["p"] < 0.01


def test_kappa_and_information(spark):
    same = spark.createDataFrame([(i, u, i % 3) for i in range(9) for u in (1, 2)], "i INT, u INT, v INT")
    assert agreement.cohen(same, ["i"], "u", "v").first()["kappa"] == pytest.approx(1)
    assert agreement.fleiss(same, ["i"], "v", 2).first()["kappa"] == pytest.approx(1)
    xy = spark.createDataFrame([(i % 2, i % 2) for i in range(8)], "x INT, y INT")
    assert agreement.mutual_information(xy, "x", "y").first()["mi"] == pytest.approx(math.log(2))


def test_studentised_range_and_nemenyi(spark):
    """Five per cent points from the usual tables, and a pair worked out by hand."""
    points = spark.createDataFrame([(2.772, 2), (3.314, 3), (3.633, 4), (4.474, 10)], "q DOUBLE, k INT")
    assert [r[0] for r in points.select(stats.range_p(F.col("q"), F.col("k"))).collect()] == pytest.approx([0.05] * 4, abs=2e-4)
    rows = [(i, s, v) for i in range(6) for s, v in zip("xyz", (3.0, 2.0, 1.0), strict=True)]
    got = {(r["a"], r["b"]): r for r in stats.nemenyi(spark.createDataFrame(rows, "i INT, s STRING, v DOUBLE"), ["i"], "s", "v").collect()}
    assert got["x", "z"]["q"] == pytest.approx(2 / math.sqrt(3 * 4 / (12 * 6))) and got["x", "z"]["p"] < 0.01 < got["x", "y"]["p"]


def test_permutations_of_few_rows_are_all_taken(spark):
    few = spark.createDataFrame([("g", float(i), float(i)) for i in range(4)], "g STRING, x DOUBLE, y DOUBLE")
    assert stats.permutation_p(few, ["g"], "x", "y").first()["p"] == pytest.approx(2 / 24)  # this order and its reverse


def test_kappa_of_all_annotators(spark, small):
    """Every pair by brute force."""
    rated = {}
    for r in base.rankings(spark, small).collect():
        rated.setdefault(r["user_id"], {}).setdefault((r["idx"], r["model"]), set()).add(r["rank"])
    want = {}
    for a, b in itertools.combinations(sorted(rated), 2):
        both = [(x, y) for k in rated[a].keys() & rated[b].keys() for x in rated[a][k] for y in rated[b][k]]
        if not both:
            continue
        n = len(both)
        po = sum(x == y for x, y in both) / n
        ca, cb = (Counter(p[i] for p in both) for i in (0, 1))
        pe = sum(ca[v] * cb[v] for v in ca) / n**2
        want[a, b] = (po - pe) / (1 - pe) if pe < 1 else None
    got = {(r["a"], r["b"]): r["kappa"] for r in catalog.QUERIES["agg_kappa_cohen"](spark, small).collect()}
    assert got.keys() == want.keys() and any(a > 3 or b > 6 for a, b in got)
    assert all(got[k] == (None if w is None else pytest.approx(w)) for k, w in want.items())


def test_composite_keys_of_all_lines(spark, small):
    got = {r["k"]: r["n"] for r in catalog.QUERIES["jn_composite_key"](spark, small).collect()}
    want = Counter(f"{r[0]}\t{r[1]}" for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect())
    assert got == want


def python_sentences(t):
    return [x for x in (p.strip() for p in re.split(r"[\r\n]+|(?<=[.!?])\s+", t)) if x]


def python_tokens(t):
    return re.findall(r"\b\w+(?:['-]\w+)*\b|[^\w\s]", t)


def python_irrelevant(w):
    return (w in X.STOP_WORDS and w not in X.NEGATIONS) or (w in string.punctuation and w != "_") or bool(re.fullmatch(r"-?\d+(\.\d+)?", w)) or w.lower() in X.PRONOUNS


UNTIDY = ["Café déjà-vu — ça va? Ούτος ΣΑΣ.\tİstanbul straße ½ x² 🙂👍🏽 “don't”", "a.\u00a0b!\u2003c\n\t\nd", "naïve e\u0301 \u0663 3.5 _ ٣ I HE", "Step one.\tStep\ttwo.. \u00a0\n . \nFin é. ", " \t ", ""]


def test_text_functions_of_every_script_equal_python(spark):
    rows = spark.createDataFrame([(t,) for t in UNTIDY], "t STRING")
    got = {r[0]: r[1:] for r in rows.select("t", X.word_tokens(F.col("t")), F.filter(X.word_tokens(F.col("t")), X.irrelevant), X.sentences(F.col("t")), X.chain_steps(F.col("t"))).collect()}
    for t in UNTIDY:
        steps = [re.sub(r"[. ]+$", "", s.replace("\t", " ")) for s in python_sentences(t)]
        assert got[t] == (python_tokens(t), [w for w in python_tokens(t) if python_irrelevant(w)], python_sentences(t), [s for s in steps if s])


@pytest.mark.parametrize("name", ["txt_word_tokens", "txt_irrelevant_word", "txt_random_case", "txt_sent_tokenize", "txt_chain_normalise", "udf_batch_model"])
def test_texts_of_every_script(spark, small, name):
    """All rows by brute force."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r["text"] is not None}
    gens = {r["gen_id"]: r["result"] for r in base.generations(spark, small).collect() if r["result"] is not None}
    steps = lambda t: [s for s in (re.sub(r"[. ]+$", "", s.replace("\t", " ")) for s in python_sentences(t)) if s]
    even = lambda k: int(hashlib.md5(f"17:{k}".encode()).hexdigest()[:7], 16) % 2 == 0
    want = {
        "txt_word_tokens": lambda: {k: (" ".join(python_tokens(t)),) for k, t in docs.items()},
        "txt_irrelevant_word": lambda: {k: (sum(map(python_irrelevant, w)), len(w)) for k, t in docs.items() if (w := python_tokens(t))},
        "txt_random_case": lambda: {k: (t.upper() if even(k) else t.lower(),) for k, t in docs.items()},
        "txt_sent_tokenize": lambda: {k: (len(python_sentences(t)),) for k, t in docs.items()},
        "txt_chain_normalise": lambda: {k: ("|".join(steps(r["reasoning"])),) for k, r in gens.items() if r["reasoning"] is not None},
        "udf_batch_model": lambda: {k: ("S: " + " ".join(reversed(r["paraphrase"].split())),) for k, r in gens.items() if r["paraphrase"] is not None},
    }[name]()
    df = catalog.QUERIES[name](spark, small)
    key = "gen_id" if "gen_id" in df.columns else "doc_id"
    values = [c for c in df.columns if c != key]
    got = {r[key]: tuple(r[c] for c in values) for r in df.collect()}
    assert got == want


def test_variants_of_words_of_any_length(spark, small, tmp_path):
    table = {"a": "a@*4", "i": "i*l1", "o": "o*0@", "e": "e*3", "s": "s$5", "t": "t7"}
    spell = lambda w: {(w, "".join(x)) for x in itertools.product(*[table.get(c, c) for c in w])}
    words = {r["word"].lower() for r in spark.read.parquet(f"{small}/profanity_wordlist.parquet").collect() if r["word"]}
    got = [tuple(r) for r in catalog.QUERIES["txt_variants"](spark, small).select("word", "variant").collect()]
    assert len(got) == len(set(got)) and set(got) == set().union(*map(spell, words))
    spark.createDataFrame([("Aioaioab",), ("",), (None,)], "word STRING").write.parquet(f"{tmp_path}/profanity_wordlist.parquet")
    many = [tuple(r) for r in catalog.QUERIES["txt_variants"](spark, str(tmp_path)).where("word <> ''").select("word", "variant").collect()]
    assert len(many) == 4**7 and set(many) == spell("aioaioab")


def test_summaries(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 4.0, None)], "g STRING, v DOUBLE")
    r = summaries.distribution(df, ["g"], "v").first()
    assert r["upper_median"] == 3 and r["p25"] == 1.75 and r["mean"] == 2.5
    empty = spark.createDataFrame([(1, None)], "a INT, b INT")
    assert summaries.drop_all_null(empty).columns == ["a"]


def test_hot_key_upper_median(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"), (F.col("id") % 11).cast("double").alias("v"))
    got = {r["g"]: r["upper_median"] for r in summaries.distribution(df, ["g"], "v").collect()}
    assert got["hot"] == 5


def test_battles_and_filter(spark):
    state = "STRUCT<model_name: STRING, messages: ARRAY<STRING>>"
    log = spark.createDataFrame(
        [
            (1, "leftvote", ["", ""], [("bard", ["hi", "x"]), ("alpaca", ["hi", "y"])], "u", "en"),
            (2, "rightvote", ["m", "m"], [("m", ["hi"]), ("m", ["hi"])], "u", "en"),
            (3, "chat", ["a", "b"], [("a", ["hi"]), ("b", ["hi"])], "u", "en"),
            (4, "tievote", ["a", "b"], [("a", ["I am Bard"]), ("b", ["hi"])], "u", "en"),
        ],
        f"ts INT, type STRING, models ARRAY<STRING>, states ARRAY<{state}>, ip STRING, lang STRING",
    )
    rows = arena.clean_battles(log, ["i am bard"]).collect()
    assert [(r["ts"], r["model_a"], r["winner"], r["anony"]) for r in rows] == [(1, "palm-2", "model_a", True)]


def test_retries_ask_only_failed_rows(spark):
    asked = spark.sparkContext.accumulator(0)

    def attempt(rows, trial):
        def f(b):
            asked.add(len(b))
            return b.assign(answer=["ok" if i % trial == 0 or trial == 3 else None for i in b["id"]])

        return inference.map_chunks(rows, f, "id BIGINT, answer STRING")

    out = inference.with_retries(spark.range(10), "id", attempt, F.col("answer") == "ok", trials=3)
    assert out.count() == 10 and out.where("answer IS NULL").count() == 0 and asked.value == 10


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "b", 1, "n", 5)], "a STRING, b STRING, result INT, model STRING, wins INT")
    assert pairs.wins(df).count() == 2
    r = spark.createDataFrame([("i", "x", 1.0, 7)], "item STRING, label STRING, score DOUBLE, n INT")
    assert ranks.ranked(r, ["item"], "score", "label").first()["n"] == 7
