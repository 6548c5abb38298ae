"""Hand-checked cases of the text rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.lexicon import CONTRACTIONS, FILLERS, STOPWORDS, domain_lexicon
from lexiloom.functions.normal import erfc, upper_tail
from lexiloom.plans.catalog import lemmatize


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens, "don't Café x''s 'cause rock'n'roll' 2x _a") == ["don't", "café", "x''s", "cause", "rock'n'roll", "2x", "_a"]
    assert one(spark, T.tokens, None) == []


def test_tokens_equal_the_word_pattern(spark):
    texts = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="abzÉß中'_ 09.\n-", max_size=30))
    def collect(t):
        texts.append(t)

    collect()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.tokens(F.col("x")).alias("w")).collect()
    assert all(r["w"] == re.findall(r"\b[\w']+\b", texts[r["i"]].lower()) for r in rows)


def test_ngrams_and_short_texts(spark):
    assert one(spark, lambda x: T.ngrams(T.tokens(x), 2), "a b\nc") == ["a b", "b c"]
    assert one(spark, lambda x: T.ngrams(T.tokens(x), 4), "a b") == []


def test_contractions(spark):
    cases = {"I'm gonna": "I am going to", "I'LL": "I will", "'til": "'until", "'cause": "'cause", "ya'll": "you'll"}
    cases |= {"So I'm, uh, WON'T. don'tx xdon't": "So I am, uh, Will not. don'tx xdon't", "": "", "none here": "none here", "can't can't": None}
    cases["can't can't"] = " ".join([CONTRACTIONS["can't"]] * 2)
    assert {k: one(spark, T.expand_contractions, k) for k in cases} == cases
    assert one(spark, T.expand_contractions, None) is None
    alone = {c: one(spark, T.expand_contractions, f"a {c} b") for c in ("gonna", "Gonna", "y'all're")}
    assert alone["gonna"] == "a going to b" and alone["Gonna"] == "a Going to b"
    assert len(CONTRACTIONS) == 101


def test_possessive_gerund_and_boundaries(spark):
    assert one(spark, T.strip_possessive, "mama's house café's x") == "mama house café x"
    for word, stem in {"falling": "fal", "king": "king", "running": "run", "bring": "bring", "making": "mak"}.items():
        assert one(spark, T.gerund, word) == stem
    assert one(spark, T.stopword_only, "the 2x") and not one(spark, T.stopword_only, "the love")
    assert one(spark, T.boundary_bigram, "the dark") and not one(spark, T.boundary_bigram, "dark the")
    assert one(spark, T.strip_boundaries, "the dark to") == "dark"
    assert one(spark, T.strip_boundaries, "the") == ""


def test_lexicon_sizes_and_lemmas(spark):
    assert len(domain_lexicon()) == 266 and len(STOPWORDS) == 205 and len(FILLERS) == 38
    rows = spark.createDataFrame([("nothin makin oh x 2x talkin\nrunnin",), (None,)], "text string")
    assert [r["lemmatized"] for r in lemmatize(rows).collect()] == ["noth make talk\nrun", ""]


def test_upper_tail_does_not_vanish(spark):
    p = spark.createDataFrame([(0.0,), (1.959963984540054,), (12.0,)], "z double").select(upper_tail(F.col("z")).alias("p")).collect()
    assert p[0]["p"] == 0.5 and abs(p[1]["p"] - 0.025) < 1e-12 and 0 < p[2]["p"] < 1e-30


def test_complementary_error_function(spark):
    import math

    xs = [k / 64 for k in range(-400, 1700)] + [0.46875, 4.0, 26.5, 27.6, -30.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert all(abs(g - math.erfc(x)) <= 1e-13 * math.erfc(x) or math.erfc(x) < 1e-300 for g, x in zip(got, xs))
