"""Tagged n-grams, stored results and the experiment facade."""

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import annotated, lemmas, morphology, stored
from lexiloom.operators.experiment import PAIRS, Experiment, matrix_table, run_matrix
from lexiloom.operators.selectors import LogOddsSelector, TfidfSelector, check_artists
from lexiloom.plans.catalog import lemmatize


def test_tagged_rules(spark):
    words = F.array(*(F.struct(F.lit(w).alias("lemma"), F.lit(p).alias("pos")) for w, p in (("The", "DET"), ("Dark", "ADJ"), ("night", "NOUN"), (" ", "X"), ("of", "ADP"))))
    got = spark.range(1).select(annotated.valid_ngrams(words, F.array(F.lit("the"), F.lit("of"))).alias("g")).first()["g"]
    assert got == ["dark", "night", "dark_night"]
    tags = spark.createDataFrame([("JJR",), ("VBD",), ("NN",), ("RB",), ("DT",), ("",), (None,)], "t string")
    assert [r[0] for r in tags.select(annotated.wordnet_pos(F.col("t"))).collect()] == ["a", "v", "n", "r", None, None, None]
    assert spark.createDataFrame([(" [Chorus] la *la* ",)], "x string").select(annotated.clean_marks(F.col("x"))).first()[0] == "la la"


def test_stored_results_depend_on_everything(spark, tmp_path):
    built = []

    def build(df):
        built.append(1)
        return df

    a, b = spark.range(5).toDF("x"), spark.range(6).toDF("x")
    for df, params in ((a, {"k": 1}), (a, {"k": 1}), (a, {"k": 2}), (b, {"k": 1})):
        assert stored.stored(str(tmp_path), "t", params, [df], lambda df=df: build(df)).count() == df.count()
    assert len(built) == 3


def test_experiment(spark, tmp_path):
    rows = spark.range(120).select("id", F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double")).alias("x"), F.concat(F.lit("c"), F.col("id") % 2).alias("y"))
    e = Experiment(rows.where("id % 4 <> 0 or id % 8 = 0"), rows.where("id % 3 = 0"), "id", "x", "y", subsample=0.9)
    e.tune({"max_features": (1, 2), "min_samples_leaf": (1, 5)}, "min_samples_leaf", True, folds=2, trees=3, n_initial=2, n_iterations=1, candidates=50)
    assert len(e.history) == 3 and e.evaluation().where("label = 'macro avg'").first()["f1"] == 1.0
    assert e.importance([0], 1).first()["importance"] > 0
    e.save_report(str(tmp_path / "r"))
    report = spark.read.text(str(tmp_path / "r")).agg(F.array_join(F.collect_list("value"), "\n")).first()[0]
    assert all(w in report for w in ("macro avg", "training time", "importance feature_0", "iteration 1"))
    e.save(str(tmp_path / "e"))
    back = Experiment.load(str(tmp_path / "e"), e.train, e.test)
    assert back.history == e.history and sorted(map(tuple, back.evaluation().collect())) == sorted(map(tuple, e.evaluation().collect()))
    lr = Experiment(e.train, e.test, "id", "x", "y").fit({"C": 1.0, "l1_ratio": 0.5}, max_iter=50)
    assert "coefficient feature_0 c1" in lr.report()
    lr.save(str(tmp_path / "l"))
    assert Experiment.load(str(tmp_path / "l"), e.train, e.test).scores().first()["macro_f1"] == 1.0
    with pytest.raises(ValueError):
        Experiment(e.train, e.test, "id", "x", "y").report()


def test_experiment_matrix(spark):
    rows = spark.range(90).select("id", (F.col("id") % 2).cast("string").alias("cat2"), (F.col("id") % 3).cast("string").alias("cat3"))
    at = lambda c: rows.withColumn("x", F.array(c.cast("double"), F.lit(1.0)))
    sets = {"fs": at(F.col("id") % 6), "topic": at(F.col("id") % 2), "style": at(F.col("id") % 3)}
    done = run_matrix({k: v.where("id % 5 <> 0") for k, v in sets.items()}, {k: v.where("id % 5 = 0") for k, v in sets.items()}, "id", ["cat2", "cat3"], rf={"max_features": 1, "min_samples_leaf": 1}, trees=5, max_iter=50)
    table = {(r["label"], r["features"], r["classifier"]): r for r in matrix_table(spark, done).collect()}
    assert len(table) == 14 and {(f, c) for _, f, c in table} == set(PAIRS)
    assert table["cat2", "topic", "rf"]["macro_f1"] == 1.0 == table["cat3", "style", "rf"]["macro_f1"] == table["cat2", "combined", "lr"]["macro_f1"]
    assert table["cat3", "topic", "rf"]["macro_f1"] < 0.9 and 0 < table["cat2", "fs", "lr"]["baseline_f1"] < 1


# Documents of the selectors' fixtures.
TFIDF_TRAIN = [("love you baby love", "pop", "artist1"), ("rock and roll music", "rock", "artist2"), ("baby love you so", "pop", "artist3"),
               ("rock music forever", "rock", "artist2"), ("dance all night long", "dance", "artist4"), ("dance music baby", "dance", "artist5")]
ODDS_TRAIN = [("love you baby love love baby", "pop", "artist1"), ("rock hard rock guitar heavy metal", "rock", "artist2"), ("baby love you forever baby", "pop", "artist3"),
              ("rock guitar heavy rock", "rock", "artist2"), ("dance all night dance floor music", "dance", "artist4"), ("dance music dance beat", "dance", "artist5")]
TEST = [("love rock baby", "pop", "artist6"), ("dance forever", "dance", "artist7")]


def lyrics(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, lyrics string, genre string, artist string")


def test_tfidf_selector(spark, tmp_path):
    train, test = lyrics(spark, TFIDF_TRAIN), lyrics(spark, TEST)
    make = lambda folder=None: TfidfSelector("id", "lyrics", "genre", "artist", min_artists=1, k=5, folder=folder)
    with pytest.raises(ValueError, match="Must call fit"):
        make().transform(test)
    s = make(str(tmp_path))
    names = s.fit(train).feature_names()
    assert names and len(names) == s.vocabulary.count() and names == make(str(tmp_path)).fit(train).feature_names() == make().fit(train).feature_names()
    for docs in (train, test):
        cells = s.transform(docs).collect()
        assert {r["term_idx"] for r in cells} <= set(range(len(names))) and {r["id"] for r in cells} <= {r["id"] for r in docs.collect()}
        text = {r["id"]: f" {r['lyrics']} " for r in docs.collect()}
        assert all(text[r["id"]].count(f" {names[r['term_idx']]} ") >= 1 for r in cells)
    with pytest.raises(ValueError, match="artist"):
        make().fit(train.drop("artist"))


def test_log_odds_selector(spark, tmp_path):
    train, test = lyrics(spark, ODDS_TRAIN), lyrics(spark, TEST)
    s = LogOddsSelector("id", "lyrics", "genre", "artist", min_artists=1, fdr=0.95, folder=str(tmp_path / "kept"))
    for f in (lambda: s.transform(test), lambda: s.threshold(0.1), lambda: s.save_scores("x")):
        with pytest.raises(ValueError, match="Must call fit"):
            f()
    names = s.fit(train).feature_names()
    assert names and s.fit_transform(train).count() > 0 and s.transform(test).count() > 0
    assert set(s.threshold(0.05).feature_names()) <= set(names) and s.threshold(0.95).feature_names() == names
    s.save_scores(str(tmp_path / "scores"))
    back = LogOddsSelector("id", "lyrics", "genre", "artist", min_artists=1, fdr=0.95).load_scores(spark, str(tmp_path / "scores"))
    assert back.feature_names() == names
    with pytest.raises(ValueError, match="artist6"):
        check_artists(test, "artist", train)
    check_artists(train, "artist", train)


def test_lemmas_with_plugged_in_parts(spark):
    docs = spark.createDataFrame([(1, "Running dogs\n\nbetter oh 2x a cats"), (2, None), (3, "dogs ran")], "id long, text string")
    dictionary = spark.createDataFrame([("dogs", "n", "dog"), ("cats", "n", "cat"), ("better", "a", "good"), ("ran", "v", "run"), ("ran", "n", "ran")], "word string, pos string, lemma string")
    table = spark.createDataFrame([("better", "JJR"), ("ran", "VBD")], "word string, tag string")
    by_function = lambda words: ["JJR" if w == "better" else "VBD" if w == "ran" else "NN" for w in words]
    for tagger in (table, by_function):
        got = {r["id"]: r["lemmatized"] for r in lemmas.lemmatize(docs, "id", "text", dictionary=dictionary, tagger=tagger).collect()}
        assert got == {1: "run dog\n\ngood cat", 2: "", 3: "dog run"}
    tagged = {r["id"]: (r["lemmas"], r["tagged"]) for r in lemmas.tagged_text(docs, "id", "text", table, dictionary=dictionary).collect()}
    assert tagged[3] == ("dog run", "dogs|X ran|VBD") and tagged[2] == ("", "") and tagged[1][1].split("\n")[2].startswith("better|JJR oh|X")
    plain = {r["id"]: r["lemmatized"] for r in lemmas.lemmatize(docs, "id", "text").collect()}
    assert plain == {r["id"]: r["lemmatized"] for r in lemmatize(docs).select("id", "lemmatized").collect()}


def test_dictionary_lemmas(spark):
    """Regular and irregular forms, forms of forms, ties, unknown words and classes."""
    entries = ["dog", "church", "wolf", "glass", "man", "fly", "run", "running", "make", "bake", "big", "larg", "large", "better", "good", "hop", "hope", "s"]
    dictionary = spark.createDataFrame([(e, None) for e in entries] + [("mice", "v"), ("mouse", "n")], "lemma string, pos string")
    irregular = spark.createDataFrame([("mice", "n", "mouse"), ("better", "a", "good"), ("ran", "v", "run"), ("odd", "n", "unknown")], "word string, pos string, lemma string")
    cases = {("dogs", "n"): "dog", ("churches", "n"): "church", ("wolves", "n"): "wolf", ("glasses", "n"): "glass", ("men", "n"): "man", ("flies", "v"): "fly", ("running", "v"): "running",
             ("makes", "v"): "make", ("baking", "v"): "bake", ("baked", "v"): "bake", ("larger", "a"): "larg", ("mice", "n"): "mouse", ("mice", "v"): "mice", ("better", "a"): "good", ("ran", "v"): "run",
             ("odd", "n"): "odd", ("xyzzy", "v"): "xyzzy", ("dogs", "r"): "dogs", ("dogs", None): "dog", ("dogs", "other"): "dog", ("dogss", "n"): "dog", ("hoped", "v"): "hop", ("", "n"): "", ("ss", "n"): "s"}
    words = spark.createDataFrame([*cases, *list(cases)[:3], (None, "n"), ("s" * 300, "n")], "word string, pos string")
    got = {(r["word"], r["pos"]): r["lemma"] for r in morphology.dictionary_lemmas(words, dictionary, irregular).collect()}
    assert got.pop(("s" * 300, "n")) == "s"
    assert got == cases
    assert morphology.dictionary_lemmas(words.where("false"), dictionary).count() == 0
