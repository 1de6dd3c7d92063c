import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.functions import score as S
from pagelens.functions import text as T
from pagelens.operators import scoring
from pagelens.operators.metrics import WEIGHTS
from pagelens.plans.audit import text_entities, text_metrics


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("a  b\t\nc", "a b c"), ("Hi!!! What??", "Hi! What?"), ("site.com ,x", "site. com, x"), ("“q” ‘s’", "\"q\" 's'"), ("", "")],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, T.normalize_text, raw) == want


def test_normalize_text_keeps_null(spark):
    assert one(spark, T.normalize_text, None) is None


def test_casing(spark):
    assert one(spark, lambda c: T.normalize_text(c, "lower"), "AbC") == "abc"
    assert one(spark, lambda c: T.normalize_text(c, "sentence"), "HELLO there. WORLD") == "Hello there. World"


def test_sentences_and_words(spark):
    assert one(spark, T.sentences, "One two. Three four! five. Six?") == ["One two.", "Three four! five.", "Six?"]
    assert one(spark, T.words, "Don't re-run it, 42 times") == ["don't", "re-run", "it", "times"]
    assert one(spark, T.words, None) == []


def test_word_edges_are_ascii(spark):
    assert one(spark, T.words, "étre mentê") == ["tre", "ment"]


def test_comparison_key_of_other_scripts_is_empty(spark):
    assert one(spark, T.comparison_key, "Привет, мир") == ""
    assert one(spark, T.comparison_key, "  A-b, C! ") == "a-b c"


def test_fnv1a(spark):
    h = 0x811C9DC5
    for c in "a|b|c":
        h = ((h ^ ord(c)) * 16777619) % 2**32
    assert one(spark, T.fnv1a, "a|b|c") == f"{h:08x}"
    assert one(spark, T.fnv1a, "") == "811c9dc5"


def test_urls(spark):
    assert one(spark, T.url_host, "https://u@Www.A.com:80/x") == "www.a.com"
    assert one(spark, T.is_valid_url, "ftp:/x") is False
    assert one(spark, T.is_valid_url, "HTTP://x.y") is True


def test_half_up_and_grade(spark):
    row = spark.range(1).select(S.half_up(F.lit(2.345), 2), S.clamp_score(F.lit(120.0)), S.grade(F.lit(79.99)), S.grade(F.lit(None).cast("double"))).first()
    assert tuple(row) == (2.35, 100.0, "C", "N/A")


def test_truncate(spark):
    assert one(spark, lambda c: T.truncate(c, 3), "ab cd") == "ab…"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(list(WEIGHTS)), st.floats(0, 5, allow_nan=False)))
def test_weights_sum_to_one(given_weights):
    out = scoring.normalize_weights(given_weights)
    assert set(out) == set(WEIGHTS) and abs(sum(out.values()) - 1) < 1e-4 and min(out.values()) >= 0


def test_text_metrics_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "One plain sentence of text stands here today. And another one follows it.")], "doc_id long, text string")
    got = {(r.doc_id, r.metric): r.score for r in text_metrics(rows).collect()}
    assert got[1, "readability"] is None and got[2, "clarity"] is None
    assert 0 < got[3, "readability"] <= 100


def test_entities(spark):
    rows = spark.createDataFrame([(1, "Mail joe@x.org or joe@x.org on 2024-01-02, call 555-123-4567. By author Ann Lee in Paris for $20 at https://a.io/p")], "doc_id long, text string")
    got = {(r.type, r.value) for r in text_entities(rows).collect()}
    assert {("email", "joe@x.org"), ("date", "2024-01-02"), ("money", "$20"), ("person", "Ann Lee"), ("location", "Paris"), ("url", "https://a.io/p")} <= got
    assert sum(k == "email" for k, _ in got) == 1


def test_texts_are_normalised_and_searched_once(spark):
    from pagelens.plans.catalog import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("text_tokens").count("(?=[A-Za-z])") == 1  # for sentences and words
    assert plan("text_frequent_words").count("regexp_extract_all") == 1  # no filter on the number of words under the explode


def test_normalising_takes_rare_and_plain_texts_alike(spark):
    texts = ["a  b \n\t c", "a \x00 ,b", "wait !\x00! now??yes", "‘a’  ,  “b”", "a . , b ;c", "''x``", "a　 b　", "CafÃ© ,x", "  a  ", "!! ??", "x\xa0\xa0y .z"]
    wanted = ["a b c", "a, b", "wait! now? yes", "'a', \"b\"", "a., b; c", '"x"', "a b", "Café, x", "a", "!?", "x y. z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.normalize_text(F.col("text")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == wanted


def test_dropping_empty_keys_normalises_nothing(spark):
    from pagelens.operators.normalize import normalize_signals

    chars = [chr(i) for i in range(0x3100) if i % 97 == 0 or i < 0x180 or 0x2000 <= i < 0x2150]
    made = spark.createDataFrame([(c,) for c in chars], "c string")
    assert made.where(T.has_key(F.col("c")) != (T.comparison_key(F.col("c")) != "")).count() == 0
    signals = spark.createDataFrame([], "page_id long, section string, pos int, type string, value string, confidence double, meta map<string,string>")
    plan = normalize_signals(signals.repartition(2, "page_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("[A-Za-z])" in line for line in plan.split("\n") if "Filter" in line)


def test_page_stats_expand_no_rows(spark):
    from pagelens.operators.normalize import page_stats

    kept = spark.createDataFrame([], "page_id long, section string, pos int, type string, value string, confidence double, meta map<string,string>, key string").repartition(2)
    flags = spark.createDataFrame([], "page_id long, visible_text string, element_text string").repartition(2)
    extract = spark.createDataFrame([], "page_id long, density double, extractable boolean").repartition(2)
    plan = page_stats(kept, flags, extract)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Expand" not in plan


def test_classes_without_nested_ranges_mean_the_same(spark):
    """Words, sentences, keys and white space against the patterns as they are said, on texts of odd characters."""
    import random

    rnd = random.Random(5)
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    word = f"(?=[a-zA-ZÀ-ſ]){edge}[a-zA-ZÀ-ſ]+(?:['-][a-zA-ZÀ-ſ]+)*{edge}"
    bits = [*" \t\n\r\f\x0b\xa0\u1680\u2003\u2028\u3000\ufeff\x00\x7f\x85,.!?;:-'_aAzZéÉßſÀ×÷İK09½日‘“«Ã\"`", "  ", " ,", ". A", "!!", "don't", "foo-bar9", "éa", "aé", "x_y"]
    rows = spark.createDataFrame([("".join(rnd.choice(bits) for _ in range(rnd.randrange(14))),) for _ in range(4000)], "t string")
    n = F.col("n")
    rows = rows.withColumn("n", T.normalize_text(F.col("t"))).cache()
    want = {
        "words": F.regexp_extract_all(F.lower(n), F.lit(word), F.lit(0)).eqNullSafe(T.words_of_normal(n)),
        "sentences": F.filter(F.transform(F.split(n, r"(?<=[.!?])\s+(?=[A-ZÀ-ſ])"), lambda x: F.trim(x)), lambda s: s != "").eqNullSafe(T.sentences_of_normal(n)),
        "keys": F.trim(F.regexp_replace(F.regexp_replace(F.lower(n), "[^A-Za-z0-9_ -]+", ""), " {2,}", " ")).eqNullSafe(T.key_of_normal(n)),
        "space": F.trim(F.regexp_replace("t", f"{T.SPACE}+", " ")).eqNullSafe(T.collapse_space(F.col("t"))),
    }
    assert {k: rows.where(~same).count() for k, same in want.items()} == dict.fromkeys(want, 0)
    assert "A-Za-z" not in T.key_of_normal(n)._jc.toString()  # a negated class of ranges took ten times as long


def test_texts_not_searched_for_a_kind_have_none_of_it(spark):
    from pagelens.operators import entities

    parts = ["by John Smith", "owner  Ann Lee", "May 3, 2020", "3 May 2021", "1/2/2020", "12 kg", "5 people", "$5", "€3.10", "100 USD", "12 Main Street", "555-123-4567", "+49 30 1234 5678", "x@y.com", "@some_one", "http://a.bc/d", "iPhone", "Acme Inc", "Foo Pro", "Paris", "word", "Words"]
    texts = [*parts, *(f"{a} and {b}." for a in parts for b in parts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.id, r.type, r.value) for r in entities.extract_entities(rows, "id", "t").collect()}
    every = rows.select("id", *(entities.values_of(k, F.col("t")).alias(k) for k, _, _ in entities.KINDS)).collect()
    assert got == {(r.id, k, v) for r in every for k, _, _ in entities.KINDS for v in r[k]} and {k for _, k, _ in got} == {k for k, _, _ in entities.KINDS}


def test_audits_carry_texts_once(spark):
    """A page's text is lowered once for all keywords of domains, and no text is written with the stats."""
    from pagelens.operators import dom, evidence
    from pagelens.plans.audit import PageAudit

    text = "<main><h1>A title of it</h1><noscript>hid<b>den</b></noscript><p>buy now , to the checkout.</p><svg><text>drawn</text></svg></main>"
    a = PageAudit(spark.createDataFrame([(1, "http://a.b/", text), (2, None, "<main><p>One  text</p> of two</main>"), (3, None, "")], "page_id long, url string, html string"))
    assert not {"visible_text", "element_text", "sentence_list", "word_list"} & set(a.stats.columns)
    plan = evidence.domain_profile(a.nodes, a.texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(element_text") == 1
    got = {r.page_id: (r.visible_text, r.element_text) for r in a.texts.collect()}
    assert got == {1: ("A title of itbuy now , to the checkout.", "A title of ithiddenbuy now , to the checkout.drawn"), 2: ("One text of two",) * 2, 3: ("", "")}
    assert dom.has_any(F.lit("x"), ["lazy", "lazyload", "data-lazy", "e-con"])._jc.toString().count("contains") == 2
