"""Text cleaning, tokenisation, extraction and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from attune.functions import python_text as P
from attune.functions import text as X
from attune.operators import profanity
from attune.plans.base import GENERATIONS, generations
from attune.plans.registry import query, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _map(spark, d, column):
    return _docs(spark, d).select("doc_id", column.alias("out"))


def _t():
    """The text column; columns exist only while a session does."""
    return F.col("text")


@query(r"SELECT doc_id, regexp_replace(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '', 'g') AS out FROM documents")
def txt_strip_ip(spark, d):
    return _map(spark, d, X.strip_ip(_t()))


@query(r"SELECT doc_id, regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g') AS out FROM documents")
def txt_strip_url(spark, d):
    return _map(spark, d, X.strip_url(_t()))


@query(r"SELECT doc_id, regexp_replace(text, '\d+', '', 'g') AS out FROM documents")
def txt_strip_digits(spark, d):
    return _map(spark, d, X.strip_digits(_t()))


@query(r"SELECT doc_id, regexp_replace(text, ' {2,}', ' ', 'g') AS out FROM documents")
def txt_collapse_space(spark, d):
    return _map(spark, d, X.collapse_space(_t()))


@query(f"SELECT doc_id, replace(replace(replace(translate(text, '{X.ACCENTED}', '{X.PLAIN}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS out FROM documents")
def txt_unaccent(spark, d):
    return _map(spark, d, X.unaccent(_t()))


@query()
def txt_unaccent_full(spark, d):
    return _map(spark, d, P.full_unaccent(_t()))


@query()
def txt_strip_html(spark, d):
    """By a real parser; the JVM form is X.strip_html."""
    return _map(spark, d, P.parse_html(_t()))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[A-Za-z/!][^<>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS out FROM documents""")
def txt_strip_html_fast(spark, d):
    return _map(spark, d, X.strip_html(_t()))


@query(r"SELECT doc_id, regexp_replace(text, '@\S+', '@USER', 'g') AS out FROM documents")
def txt_user_mask(spark, d):
    return _map(spark, d, X.mask_users(_t()))


@query()
def txt_squeeze(spark, d):
    """Needs a back reference, which the SQL side's regular expressions lack."""
    return _map(spark, d, X.squeeze(_t()))


@query()
def txt_emoji(spark, d):
    return _map(spark, d, X.strip_emoji(_t()))


@query()
def txt_tidy(spark, d):
    return _map(spark, d, X.tidy(_t()))


@query()
def txt_clean_all(spark, d):
    return _map(spark, d, X.clean(_t()))


@query()
def txt_word_tokens(spark, d):
    """Word tokens of all texts; no SQL, as the engines' word classes differ beyond ASCII. Checked by brute force."""
    return _docs(spark, d).where(_t().isNotNull()).select("doc_id", F.array_join(X.word_tokens(_t()), " ").alias("out"))


@query()
def txt_token_offsets(spark, d):
    return _docs(spark, d).select("doc_id", P.token_offsets(_t()).alias("out"))


@query()
def txt_irrelevant_word(spark, d):
    """Irrelevant and all word tokens of every text that has any; checked by brute force."""
    t = _docs(spark, d).select("doc_id", F.explode(X.word_tokens(_t())).alias("w"))
    return t.groupBy("doc_id").agg(F.count(F.when(X.irrelevant(F.col("w")), 1)).alias("irrelevant"), F.count("*").alias("n"))


@query()
def txt_profanity_detect(spark, d):
    """Words that alone or joined with the next ones spell a listed word under look-alike characters; checked by brute force in the tests."""
    return profanity.walk(_docs(spark, d), "doc_id", "text", table(spark, d, "profanity_wordlist"))


@query(r"""SELECT doc_id, list_sort(list(DISTINCT w)) AS words FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE w IN (SELECT lower(word) FROM profanity_wordlist) GROUP BY 1""")
def txt_profanity_plain(spark, d):
    """Listed words in their plain spelling per document."""
    t = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all(F.lower(_t()), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    w = table(spark, d, "profanity_wordlist").select(F.lower("word").alias("w")).distinct()
    return t.join(w, "w", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("w")).alias("words"))


@query()
def txt_profanity_normalise(spark, d):
    """Disguised words in their canonical spelling."""
    m = profanity.matches(_docs(spark, d), "doc_id", "text", table(spark, d, "profanity_wordlist")).where("token <> word")
    g = m.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("token", "word"))).alias("m"))
    j = _docs(spark, d).join(g, "doc_id")
    return j.select("doc_id", F.aggregate("m", _t(), lambda acc, x: F.replace(acc, x["token"], x["word"])).alias("out"))


@query()
def txt_contains_profanity(spark, d):
    m = profanity.matches(_docs(spark, d), "doc_id", "text", table(spark, d, "profanity_wordlist")).select("doc_id").distinct()
    return _docs(spark, d).select("doc_id").join(m.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("contains"))


@query("""WITH RECURSIVE m AS (SELECT * FROM (VALUES ('a', ['a', '@', '*', '4']), ('i', ['i', '*', 'l', '1']), ('o', ['o', '*', '0', '@']), ('e', ['e', '*', '3']), ('s', ['s', '$', '5']), ('t', ['t', '7'])) x(k, v)),
w AS (SELECT lower(word) AS word FROM profanity_wordlist), r AS (SELECT word, '' AS s, 0 AS n FROM w UNION ALL SELECT r.word, r.s || u.c, r.n + 1 FROM r, LATERAL (SELECT unnest(coalesce((SELECT v FROM m WHERE k = substr(r.word, r.n + 1, 1)), [substr(r.word, r.n + 1, 1)])) AS c) u WHERE r.n < length(r.word))
SELECT DISTINCT word, s AS variant FROM r WHERE n = length(word)""")
def txt_variants(spark, d):
    """All spellings of every word under a look-alike table.

    A spelling is a number whose digits choose the letters. The numbers are dealt out over rows in runs, so no
    array holds more than ``run`` of them however long the word.
    """
    table_ = {"a": "a@*4", "i": "i*l1", "o": "o*0@", "e": "e*3", "s": "s$5", "t": "t7"}
    run = 4096
    options = lambda c: F.coalesce(*[F.when(c == k, F.array(*[F.lit(x) for x in v])) for k, v in table_.items()], F.array(c))
    w = table(spark, d, "profanity_wordlist").where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct()
    w = w.withColumn("o", F.transform(F.split("word", ""), options))
    w = w.withColumn("n", F.aggregate("o", F.lit(1).cast("long"), lambda n, x: n * F.size(x)))
    # runs in blocks of runs, so that their own array stays small as well
    w = w.select("word", "o", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {run * run}"))).alias("far"))
    runs = lambda c, end: F.explode(F.sequence(F.col(c) * run, F.least(F.col(c) * run + (run - 1), end)))
    w = w.select("word", "o", "n", runs("far", F.expr(f"(n - 1) DIV {run}")).alias("near")).repartition("word", "near")
    w = w.select("word", "o", runs("near", F.col("n") - 1).alias("at"))
    start = F.struct(F.lit("").alias("s"), F.col("at").alias("rest"))
    pick = lambda acc, x: F.struct(F.concat(acc["s"], F.get(x, (acc["rest"] % F.size(x)).cast("int"))).alias("s"), ((acc["rest"] - acc["rest"] % F.size(x)) / F.size(x)).cast("long").alias("rest"))
    return w.select("word", F.aggregate("o", start, pick)["s"].alias("variant"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '[一-鿿]'), false) AS cjk FROM documents")
def txt_contains_cjk(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(X.contains_cjk(_t()), F.lit(False)).alias("cjk"))


@query()
def txt_split_sentences(spark, d):
    """Sentences with their delimiters and whether they need translating; look-behind has no SQL twin."""
    return _docs(spark, d).select("doc_id", F.explode(X.sentences(_t())).alias("s")).select("doc_id", "s", X.contains_cjk(F.col("s")).alias("cjk"))


@query()
def txt_sent_tokenize(spark, d):
    """Number of sentences of every text; checked by brute force, as the engines' blanks differ beyond ASCII."""
    return _docs(spark, d).where(_t().isNotNull()).select("doc_id", F.size(X.sentences(_t())).cast("long").alias("n"))


@query()
def txt_chain_normalise(spark, d):
    """Steps of every reasoning; checked by brute force, as the engines' blanks differ beyond ASCII."""
    r = F.col("result.reasoning")
    return generations(spark, d).where(r.isNotNull()).select("gen_id", F.array_join(X.chain_steps(r), "|").alias("out"))


_ANSWER = "'Final Reasoning' || chr(10) || result.reasoning || chr(10) || 'Final Paraphrase: ' || replace(result.paraphrase, chr(10), ' ')"


def _answers(spark, d):
    g = generations(spark, d).where("result IS NOT NULL AND trim(result.reasoning) <> '' AND trim(replace(result.paraphrase, '\n', '')) <> ''")
    text = F.concat(F.lit("Final Reasoning\n"), F.col("result.reasoning"), F.lit("\nFinal Paraphrase: "), F.replace(F.col("result.paraphrase"), F.lit("\n"), F.lit(" ")))
    return g.select("gen_id", text.alias("text"))


_GOOD = "result IS NOT NULL AND trim(result.reasoning) <> '' AND trim(replace(result.paraphrase, chr(10), '')) <> ''"


@query(f"WITH {GENERATIONS}, a AS (SELECT gen_id, {_ANSWER} AS text FROM g WHERE {_GOOD}) SELECT gen_id, nullif(regexp_replace(regexp_extract(text, '(?s)Final Reasoning(.*?)Final Paraphrase', 1), '^\\s+|\\s+$', '', 'g'), '') AS out FROM a")
def txt_between(spark, d):
    return _answers(spark, d).select("gen_id", X.between(_t(), "Final Reasoning", "Final Paraphrase").alias("out"))


@query(f"WITH {GENERATIONS}, a AS (SELECT gen_id, {_ANSWER} AS text FROM g WHERE {_GOOD}) SELECT gen_id, nullif(trim(regexp_extract(text, 'Final Paraphrase\\s*:?\\s*([^\\r\\n]*)', 1)), '') AS paraphrase FROM a")
def txt_extract_cascade(spark, d):
    return _answers(spark, d).select("gen_id", F.coalesce(X.extract_answer(_t())["paraphrase"], X.after(_t(), "Final Paraphrase")).alias("paraphrase"))


@query(f"""WITH {GENERATIONS} SELECT gen_id, trim(regexp_replace(regexp_replace(trim(replace(regexp_replace('```json ' || result.paraphrase || '**', '```[a-z]*', '', 'g'), '**', '')), '^:\\s*', ''), '^["'']+|["'']+$', '', 'g')) AS out FROM g WHERE result.paraphrase IS NOT NULL""")
def txt_pre_post(spark, d):
    return generations(spark, d).where("result.paraphrase IS NOT NULL").select("gen_id", X.pre_post(F.concat(F.lit("```json "), F.col("result.paraphrase"), F.lit("**"))).alias("out"))


@query("SELECT doc_id, string_split(text, 'Final Solution')[1] AS out FROM documents")
def txt_cut_at_marker(spark, d):
    return _map(spark, d, X.cut_at(_t(), "Final Solution"))


@query("""SELECT event_id, regexp_extract('answer ```json ' || props || ' ``` end', '(?s)```json\\s*(\\{.*?\\})\\s*```', 1) AS block, (props->>'k')::INT AS k FROM events""")
def txt_json_block(spark, d):
    e = table(spark, d, "events").select("event_id", "props", X.json_block(F.concat(F.lit("answer ```json "), F.col("props"), F.lit(" ``` end"))).alias("block"))
    return e.select("event_id", "block", F.from_json("block", "k INT")["k"].alias("k"))


@query("SELECT n_nationkey, n_name AS first, 'region ' || n_regionkey AS second FROM nation")
def txt_parse_kv_lines(spark, d):
    t = F.concat(F.lit("a\nb\nname: "), F.col("n_name"), F.lit("\nplace: region "), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", X.kv_lines(t).alias("v")).select("n_nationkey", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, ' ')) > 60 THEN array_to_string(string_split(text, ' ')[:40], ' ') ELSE text END AS out FROM documents")
def txt_truncate_words(spark, d):
    return _map(spark, d, X.truncate_words(_t(), 60, 40))


@query(f"WITH {GENERATIONS} SELECT gen_id, 'Sentence: ' || sentence || chr(10) || 'Words: ' || coalesce(array_to_string(shap_values, ', '), '') || chr(10) || 'Label: ' || coalesce(label, -1)::VARCHAR AS prompt FROM g WHERE sentence IS NOT NULL")
def txt_prompt_format(spark, d):
    g = generations(spark, d).where("sentence IS NOT NULL")
    return g.select("gen_id", F.concat(F.lit("Sentence: "), "sentence", F.lit("\nWords: "), F.coalesce(F.array_join("shap_values", ", "), F.lit("")), F.lit("\nLabel: "), F.coalesce("label", F.lit(-1.0)).cast("string")).alias("prompt"))


@query("SELECT source, max((len(string_split(text, ' ')) + 20 >= 200)::INT)::INT AS abort FROM documents WHERE text IS NOT NULL GROUP BY 1")
def txt_prompt_too_long(spark, d):
    return _docs(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").where("text IS NOT NULL").groupBy("source").agg(F.max((F.size(F.split(_t(), " ")) + 20 >= 200).cast("int")).alias("abort"))


@query(f"WITH {GENERATIONS} SELECT gen_id, 'Rewrite.###Human: ' || sentence || '###Assistant: ' || result.paraphrase || '</s>' AS prompt FROM g WHERE sentence IS NOT NULL AND result.paraphrase IS NOT NULL")
def txt_conv_prompt(spark, d):
    g = generations(spark, d).where("sentence IS NOT NULL AND result.paraphrase IS NOT NULL")
    return g.select("gen_id", X.conversation(F.array("sentence", "result.paraphrase"), F.lit("Rewrite."), ("Human", "Assistant"), "###", "</s>").alias("prompt"))


@query("SELECT doc_id, replace(replace(replace('Assistant 1 ' || text || ' Assistant 2', 'Assistant 1', chr(1)), 'Assistant 2', 'Assistant 1'), chr(1), 'Assistant 2') AS out FROM documents")
def txt_swap_answers(spark, d):
    return _map(spark, d, X.swap_answers(F.concat(F.lit("Assistant 1 "), _t(), F.lit(" Assistant 2"))))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE -1 END AS a, CASE WHEN event_id % 3 = 0 THEN (user_id)::DOUBLE ELSE -1 END AS b FROM events""")
def txt_parse_score(spark, d):
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(v, F.lit(" "), u, F.lit("\nwhy"))).when(F.col("event_id") % 3 == 1, F.concat(v, F.lit(", "), u)).otherwise("n/a")
    return table(spark, d, "events").select("event_id", X.parse_score(text).alias("s")).select("event_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


@query("SELECT event_id, value AS a, user_id::DOUBLE AS b, 7.5::DOUBLE AS c FROM events")
def txt_parse_scores_n(spark, d):
    text = F.concat_ws("  ", F.col("value").cast("string"), F.col("user_id").cast("string"), F.lit("7.5"))
    return table(spark, d, "events").select("event_id", X.parse_scores(text, 3).alias("s")).select("event_id", *[F.col("s")[i].alias(n) for i, n in enumerate("abc")])


@query()
def txt_random_case(spark, d):
    """Every text in upper or lower case; checked by brute force, as the engines' case rules differ beyond ASCII."""
    from attune.operators.sampling import whole

    return _docs(spark, d).where(_t().isNotNull()).select("doc_id", F.when(whole(F.col("doc_id"), 17) % 2 == 0, F.upper(_t())).otherwise(F.lower(_t())).alias("out"))


@query("SELECT n_nationkey, n_name AS name FROM nation")
def txt_strip_h3(spark, d):
    t = F.concat(F.lit("<h3>Model A: "), F.col("n_name"), F.lit("</h3>"))
    return table(spark, d, "nation").select("n_nationkey", F.regexp_extract(t, r"<h3>.*: (.*)</h3>", 1).alias("name"))


@query("SELECT DISTINCT model, replace(replace(model, 'tarn', 'marsh'), '-preview', '-2') AS renamed FROM paraphrase_generation")
def txt_rename_models(spark, d):
    return table(spark, d, "paraphrase_generation").select("model", X.rename_chain(F.col("model"), [("tarn", "marsh"), ("-preview", "-2")]).alias("renamed")).distinct()


@query("SELECT doc_id, coalesce(contains(lower(text), 'lumen') OR contains(lower(text), 'language model') OR contains(lower(text), 'plumb-r1'), false) AS leaked FROM documents")
def txt_leaked_identity(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(X.leaks_identity(_t(), ["lumen", "language model", "plumb-r1"]), F.lit(False)).alias("leaked"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(STANDARD|SMALL)') THEN 'plain' WHEN regexp_matches(p_name, 'ing$') THEN 'ring' ELSE 'other' END AS kind FROM part")
def txt_title_rules(spark, d):
    """The first rule whose pattern a title matches names its kind."""
    rules = F.when(F.col("p_type").rlike("^(STANDARD|SMALL)"), "plain").when(F.col("p_name").rlike("ing$"), "ring").otherwise("other")
    return table(spark, d, "part").select("p_partkey", rules.alias("kind"))


@query()
def txt_ctc_fix(spark, d):
    return _map(spark, d, P.unescape_codepoints(_t()))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN 0 END AS good, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN 1 END AS bad FROM events")
def txt_yes_no(spark, d):
    a = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "error", "no ").otherwise("maybe")
    return table(spark, d, "events").select("event_id", X.yes_no(a, True).alias("good"), X.yes_no(a, False).alias("bad"))


@query("SELECT idx, replace(array_to_string(paraphrase, '<AND>'), '<AND>', ' and ') AS joined FROM (SELECT DISTINCT idx, paraphrase FROM combined_corpus)")
def txt_or_and_answer(spark, d):
    c = table(spark, d, "combined_corpus").select("idx", "paraphrase").distinct()
    return c.select("idx", F.replace(F.array_join("paraphrase", "<AND>"), F.lit("<AND>"), F.lit(" and ")).alias("joined"))


@query()
def txt_unicode_escape(spark, d):
    return _map(spark, d, P.escape_unicode(_t()))


@query("SELECT n_nationkey, 'fewshot' AS kind, n_nationkey AS n FROM nation")
def txt_experiment_name(spark, d):
    name = F.concat(F.lit("results/run_fewshot_"), F.col("n_nationkey").cast("string"), F.lit("_examples.json"))
    pattern = r"run_([a-z]+)_(\d+)_examples"
    return table(spark, d, "nation").select("n_nationkey", F.regexp_extract(name, pattern, 1).alias("kind"), F.regexp_extract(name, pattern, 2).cast("int").alias("n"))


@query("SELECT doc_id, coalesce(ends_with(text, '.') OR ends_with(text, '.\n') OR ends_with(text, '.\n#'), false) AS partial FROM documents".replace("\n", "' || chr(10) || '"))
def txt_stop_partial(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(X.stop_partial(_t(), ".\n#"), F.lit(False)).alias("partial"))


@query()
def txt_strip_markdown(spark, d):
    """Markdown marks removed: headings, quotes, list marks, emphasis, code, links."""
    s = F.regexp_replace(_t(), r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)", "")
    s = F.regexp_replace(s, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return _map(spark, d, F.regexp_replace(s, r"(\*\*|__|\*|`{1,3})", ""))


@query()
def txt_detect_lang(spark, d):
    """Language by function words per document: the best of four, or unknown."""
    words = {"en": "the and is of to", "de": "der die und ist nicht", "fr": "le les est une des", "es": "el los una que y"}
    tokens = F.split(F.lower(_t()), r"[^\p{L}]+")

    def count(listed: list[str]):
        return F.size(F.filter(tokens, lambda w: w.isin(*listed)))

    counts = [F.struct(count(ws.split()).alias("n"), F.lit(k).alias("lang")) for k, ws in words.items()]
    best = F.array_max(F.array(*counts))
    return _map(spark, d, F.when(best["n"] > 0, best["lang"]).otherwise("unknown"))
