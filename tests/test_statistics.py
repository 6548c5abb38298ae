"""Vocabulary selection, splits, agreement, metrics, searches and topics on small cases."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import agreement, classify, experiment, forests, grouping, metrics, ranking, terms, topics, tuning
from lexiloom.plans import models
from lexiloom.plans.catalog import one_standard_error, select_local_maximum
from lexiloom.sources import tables

LYRICS = [
    (1, "love you baby love", "pop", "artist1"),
    (2, "rock and roll music", "rock", "artist2"),
    (3, "baby love you so", "pop", "artist3"),
    (4, "rock music forever", "rock", "artist2"),
    (5, "dance all night long", "dance", "artist4"),
    (6, "dance music baby", "dance", "artist5"),
]


@pytest.fixture(scope="module")
def grams(spark):
    docs = spark.createDataFrame(LYRICS, "doc_id int, text string, genre string, artist string")
    return terms.ngram_counts(docs, ["doc_id", "genre", "artist"], "text", (1, 2, 3)).cache()


def test_class_tfidf_selects_and_transforms(spark, grams):
    vocab = terms.select_features(grams, "genre", "artist", min_artists=1, k=5)
    names = {r["ngram"] for r in vocab.collect()}
    assert {"love", "rock", "dance"} <= names
    again = {r["ngram"] for r in terms.select_features(grams, "genre", "artist", min_artists=1, k=5).collect()}
    assert names == again
    rows = terms.transform(grams, ["doc_id"], vocab).where("doc_id = 1").join(vocab, "term_idx").collect()
    assert {r["ngram"]: r["cnt"] for r in rows}["love"] == 2


def test_log_odds_prior_and_signs(spark, grams):
    counts = terms.class_counts(grams, "genre", "artist", min_artists=1)
    scores = {(r["ngram"], r["genre"]): r["z"] for r in terms.log_odds(grams, "genre", "artist", min_artists=1).where("`order` = 1").collect()}
    assert scores["love", "pop"] > 0 > scores["love", "rock"]
    assert len(scores) % 3 == 0  # a full grid


def test_benjamini_hochberg_hand_case_and_simulation(spark):
    tests = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.03, 0.04, 0.9)], "p double")
    assert [r["passes_bh"] for r in terms.benjamini_hochberg(tests, 0.05).orderBy("p").collect()] == [True] * 4 + [False]
    rng = np.random.default_rng(0)
    z = rng.standard_normal(5000)
    signal = rng.random(5000) < 0.1
    z[signal] = rng.uniform(3, 6, signal.sum())
    p = np.round([0.5 * math.erfc(v / math.sqrt(2)) for v in z], 5)  # rounded: ties, zeros
    df = spark.createDataFrame([(i, float(v), bool(s)) for i, (v, s) in enumerate(zip(p, signal))], "i int, p double, s boolean")
    got = {r["i"] for r in terms.benjamini_hochberg(df, 0.01).where("passes_bh").collect()}
    ordered = np.sort(p)
    ok = np.flatnonzero(ordered <= 0.01 * np.arange(1, 5001) / 5000)
    assert got == set(np.flatnonzero(p <= ordered[ok[-1]]).tolist())
    assert np.mean([not signal[i] for i in got]) <= 0.05
    assert terms.benjamini_hochberg(df.limit(0), 0.01).count() == 0


def test_modes_and_split(spark):
    rows = [("A", "rock"), ("A", "pop"), *[("B", "pop")] * 4, ("C", "rock"), (None, "rock"), ("D", None)]
    df = spark.createDataFrame(rows, "artist string, genre string")
    assert {r["artist"]: r["genre"] for r in grouping.mode_rarer(df, "artist", "genre").collect()}["A"] == "rock"
    assert {r["artist"]: r["genre"] for r in grouping.mode_first(df, "artist", "genre").collect()}["A"] == "pop"
    assert grouping.mode_ties(df, "artist", "genre").where("artist = 'A'").count() == 2
    members = spark.range(50).select(F.col("id").alias("artist"), (F.col("id") % 3).cast("string").alias("genre"))
    split = grouping.group_split(members, "artist", "genre")
    assert split.count() == 50 and split.where("part = 'test'").count() == 10
    test, train = split.where("part = 'test'"), split.where("part = 'train'")
    grouping.check_disjoint(test, train, "artist")
    with pytest.raises(ValueError):
        grouping.check_disjoint(split, split, "artist")


def test_agreement(spark):
    wide = spark.createDataFrame([(1, 5, 0, 1), (2, 0, 3, 1), (3, 0, 0, 1)], "user_id long, cat5_n_pop long, cat5_n_rock long, cat12_n_x long")
    votes = agreement.unpivot_votes(wide, "user_id", 5)
    f1 = agreement.simulate(votes, "user_id", 3)
    assert {r["f1"] for r in f1.collect()} == {1.0}  # unanimous; the row without votes is left out
    assert {r["genre"] for r in agreement.summary(f1).collect()} == {"macro", "pop", "rock"}
    with pytest.raises(ValueError):
        agreement.unpivot_votes(wide, "user_id", 25)
    split = spark.createDataFrame([(k, 1, 1) for k in range(400)], "user_id long, cat5_n_a long, cat5_n_b long")
    mean = agreement.simulate(agreement.unpivot_votes(split, "user_id", 5), "user_id", 5).agg(F.avg("f1")).first()[0]
    assert abs(mean - 0.5) < 0.05
    some = spark.createDataFrame([(1, "pop", 5), (2, "rock", 3), (2, "pop", 1), (3, "jazz", 2)], "user_id long, genre string, votes long")
    drawn = agreement.simulate(some, "user_id", 300)  # keys without a row for each genre
    assert drawn.count() == 900 and drawn.where("genre = 'jazz'").agg(F.min("f1")).first()[0] == 1.0
    assert agreement.simulate(some.where("false"), "user_id", 300).count() == 0


def test_metrics_absent_class(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    levels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    found = {r["label"]: r["f1"] for r in metrics.per_class(pairs, "t", "p", levels).collect()}
    assert found["c"] == 0.0 and abs(found["a"] - 2 / 3) < 1e-12
    assert abs(metrics.macro(pairs, "t", "p").first()["kappa"] - 0.4) < 1e-12


# Held-out likelihoods of 2 to 20 topics.
HELD_OUT = [-6.94062, -6.933906, -6.923932, -6.924336, -6.778203, -6.761375, -6.750403, -6.747771, -6.722467, -6.721688,
            -6.701063, -6.688849, -6.670395, -6.677086, -6.68211, -6.672833, -6.671521, -6.667709, -6.662946]


def test_number_of_topics(spark):
    series = list(zip(range(2, 21), HELD_OUT))
    assert topics.choose_topics(series) == 4
    assert topics.choose_topics([(2, 1.0), (3, 2.0), (4, float("nan"))]) == 3
    with pytest.raises(ValueError):
        topics.choose_topics([(2, float("nan"))])
    df = spark.createDataFrame([(1, k, v) for k, v in series] + [(2, k, float(k)) for k in range(5)], "g int, k int, v double")
    assert {r["g"]: r["best_k"] for r in select_local_maximum(df, ["g"], "k", "v").collect()} == {1: 4, 2: 4}


def test_one_standard_error(spark):
    h = spark.createDataFrame([(0.79, 0.01, 50), (0.80, 0.02, 10), (0.77, 0.01, 90)], "s double, e double, leaf int")
    assert one_standard_error(h, "s", "e", "leaf").first()["leaf"] == 50


def test_search_finds_resumes_and_prefers_parsimony(tmp_path):
    calls = []

    def evaluate(p):
        calls.append(p)
        return 1 - (p["min_samples_leaf"] - 30) ** 2 / 1e4, 0.001

    make = lambda: tuning.Search({"min_samples_leaf": (1, 100)}, evaluate, n_initial=6, n_iterations=6, candidates=300, checkpoint=str(tmp_path))
    search = make()
    search.run()
    best = search.best_within_error("min_samples_leaf", True)
    assert abs(best["min_samples_leaf"] - 30) <= 5
    n = len(calls)
    assert make().run() == search.history and len(calls) == n
    points = tuning.latin_hypercube({"C": (0.01, 100.0)}, 50, 1)
    assert sum(p["C"] < 1 for p in points) == 25
    with pytest.raises(ValueError):
        tuning.Surrogate([{"a": 1}], [float("nan")])


def test_structural_topics_recover_two_topics(spark):
    rng = np.random.default_rng(1)
    rows = [(d, int(t), 1) for d in range(60) for t in rng.integers(0, 10, 40) + 10 * (d % 2)]
    dtm = spark.createDataFrame(rows, "doc int, term_idx int, one int").groupBy("doc", "term_idx").agg(F.sum("one").alias("cnt"))
    level = spark.range(60).select(F.col("id").cast("int").alias("doc"), (F.col("id") % 2).cast("string").alias("level"))
    docs = topics.as_documents(dtm, "doc", level, ["0", "1"]).cache()
    model = topics.fit_structural(docs, "doc", 20, 2, iterations=15)
    assert np.allclose(model.beta.sum(1), 1)
    top = {r["doc"] % 2: int(np.argmax(r["theta"])) for r in model.transform(docs, "doc", prevalence=True).collect()}
    assert set(top.values()) == {0, 1}
    shares = [max(r["theta"]) for r in model.transform(docs, "doc", prevalence=True).collect()]
    assert np.mean(shares) > 0.9


def test_topics_keep_all_conversations(spark, tmp_path):
    """Conversations without a selected word have the prior's shares; without any selected word all have them."""
    rows = [(c, 0, ("user", "system")[c % 2], " ".join(f"word{chr(97 + (c % 2) * 10 + k % 10)}" for k in range(c, c + 12))) for c in range(60)]
    odd = [(60, 0, "user", None), (61, 0, "assistant", ""), (62, 1000, "user", "seldom used"), (62, 0, "user", "other")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows + odd, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    docs, size = models._topic_documents(spark, str(tmp_path))
    found = {r["artist"]: r for r in docs.collect()}
    assert size >= 20 and sorted(found) == list(range(63))
    assert found[60]["terms"] == [] and found[62]["terms"] == [] and len(found[61]["x"]) == 3
    for f in (models.lda_topics, models.stm_topics, models.ctm_topics):
        shares = {r["artist"]: r["theta"] for r in f(spark, str(tmp_path)).collect()}
        assert len(shares) == 63 and np.allclose([sum(v) for v in shares.values()], 1)
        if f is models.lda_topics:
            assert np.allclose(shares[60], 0.25)
    spark.createDataFrame(rows[:8], schema).write.parquet(f"{tmp_path}/few/conversations.parquet")
    assert models._topic_documents(spark, f"{tmp_path}/few")[1] == 1 and models.stm_topics(spark, f"{tmp_path}/few").count() == 8


def topic_docs(spark, seed=1, n=80):
    rng = np.random.default_rng(seed)
    rows = [(d, int(t), 1) for d in range(n) for t in rng.integers(0, 10, 40) + 10 * (d % 2)]
    dtm = spark.createDataFrame(rows, "doc int, term_idx int, one int").groupBy("doc", "term_idx").agg(F.sum("one").alias("cnt"))
    return topics.as_documents(dtm, "doc").cache()


def test_topic_inference_in_batches_equals_single_documents():
    rng = np.random.default_rng(3)
    beta, mu = rng.dirichlet(np.ones(30), 4), rng.standard_normal((5, 3))
    inverse = np.linalg.inv(np.cov(rng.standard_normal((3, 50))) + np.eye(3))
    sizes = [7, 0, 12, 1, 20]
    terms_, counts = [rng.choice(30, n, replace=False) for n in sizes], [rng.integers(1, 5, n).astype(float) for n in sizes]
    both = topics.infer(np.concatenate(terms_), np.concatenate(counts), np.r_[0, np.cumsum(sizes)], mu, inverse, beta)
    for d in range(5):
        one = topics.infer(terms_[d], counts[d], np.array([0, sizes[d]]), mu[d : d + 1], inverse, beta)
        assert np.allclose(both[0][d], one[0][0], atol=1e-4) and np.allclose(both[1][d], one[1][0], atol=1e-4) and abs(both[3][d] - one[3][0]) < 1e-6
        eta, n = one[0][0], counts[d].sum()
        theta = np.exp(np.r_[eta, 0]) / np.exp(np.r_[eta, 0]).sum()
        phi = beta[:, terms_[d]] * theta[:, None]
        gradient = ((phi / np.maximum(phi.sum(0), 1e-300)) * counts[d]).sum(1)[:-1] - n * theta[:-1] - inverse @ (eta - mu[d])
        assert np.abs(gradient).max() < 1e-2 and np.isclose(one[2].sum(), n)


def test_topic_start_side_by_side_fits_and_sums_in_a_tree(spark, monkeypatch):
    docs = topic_docs(spark)
    beta = topics.spectral_start(docs, 20, [2, 3])[2]
    assert {b[:10].sum() > 0.9 for b in beta} == {True, False}
    many = topics.fit_structural_many(docs, 20, [2, 3], iterations=6, tolerance=0.0)
    alone = topics.fit_structural(docs, "doc", 20, 2, iterations=6, tolerance=0.0)
    assert np.allclose(many[2].beta, alone.beta) and len(many[3].bounds) == 6 and many[2].bounds[-1] >= many[2].bounds[0]
    monkeypatch.setattr(topics, "FAN_IN", 2)
    again = topics.fit_structural(docs.repartition(5).cache(), "doc", 20, 2, iterations=6, tolerance=0.0)
    assert np.allclose(again.beta, alone.beta, atol=1e-8)


def test_convex_weights_are_the_best_ones():
    """Against a projection onto the simplex by every set of active weights."""
    rng = np.random.default_rng(3)
    for k in (1, 2, 4):
        rows = rng.dirichlet(np.ones(12), k)
        gram = rows @ rows.T
        points = np.vstack([rng.dirichlet(np.ones(12), 30), rows])
        found = topics.convex_weights(gram, points @ rows.T)
        assert np.allclose(found.sum(1), 1) and (found >= 0).all()
        for point, c in zip(points, found):
            best = np.inf
            for chosen in range(1, 2**k):
                at = [j for j in range(k) if chosen >> j & 1]
                system = np.block([[2 * gram[np.ix_(at, at)], np.ones((len(at), 1))], [np.ones((1, len(at))), np.zeros((1, 1))]])
                w = np.linalg.lstsq(system, np.append(2 * rows[at] @ point, 1), rcond=None)[0][:-1]
                if (w >= -1e-12).all():
                    best = min(best, ((point - w @ rows[at]) ** 2).sum())
            assert ((point - c @ rows) ** 2).sum() <= best + 1e-8


def test_spectral_start_equals_the_dense_recovery(spark, monkeypatch):
    """Topics of a corpus with anchor words, against the whole co-occurrence matrix."""
    monkeypatch.setattr(topics, "WORDS", 7)
    rng = np.random.default_rng(5)
    beta = np.vstack([rng.dirichlet(np.full(30, 3.0)) for _ in range(3)])
    beta[:, :3] = np.eye(3) * 0.2  # a word of its own for each topic
    beta /= beta.sum(1, keepdims=True)
    rows = []
    for d, theta in enumerate(rng.dirichlet(np.full(3, 0.2), 300)):
        rows += [(d, int(t), int(c)) for t, c in enumerate(rng.multinomial(80, theta @ beta)) if c]
    dtm = spark.createDataFrame(rows, "doc int, term_idx int, cnt long")
    docs = topics.as_documents(dtm, "doc").repartition(4).cache()
    start = topics.spectral_start(docs, 30, [2, 3])
    counts = np.zeros((300, 30))
    for d, t, c in rows:
        counts[d, t] = c
    n = counts.sum(1)
    q = sum((np.outer(c, c) - np.diag(c)) / (m * (m - 1)) for c, m in zip(counts, n))
    anchors, mass = topics.anchor_words(docs, 30, 3)
    assert np.allclose(mass, q.sum(1)) and set(anchors) == {0, 1, 2}
    dense = q / q.sum(1, keepdims=True)
    own = dense[anchors]
    weights = topics.convex_weights(own @ own.T, dense @ own.T)
    weights[anchors] = np.eye(3)
    expected = (weights * mass[:, None]).T
    expected = expected / expected.sum(1, keepdims=True) + 0.01 / 30
    assert np.allclose(start[3], expected / expected.sum(1, keepdims=True), atol=1e-5)
    order = [int(np.argmax(start[3][:, k])) for k in range(3)]
    assert sorted(order) == [0, 1, 2] and np.abs(start[3][order] - beta).max() < 0.05


def test_topic_pipeline_stores_checks_and_goes_on(spark, tmp_path, monkeypatch):
    docs, words = topic_docs(spark), [f"w{k}" for k in range(20)]
    options = {"topic_numbers": [2, 3, 4], "iterations": 8}
    with pytest.raises(ValueError):
        topics.TopicPipeline(str(tmp_path)).transform(docs, "doc", words)
    first = topics.TopicPipeline(str(tmp_path), **options).tune_and_fit(docs, "doc", words)
    assert [k for k, _ in first.results] == [2, 3, 4] and len(first.model.beta) == topics.choose_topics(first.results)
    back = topics.TopicPipeline(str(tmp_path)).load(spark)
    assert np.allclose(back.model.beta, first.model.beta) and back.model.vocabulary == words
    shares = back.transform(docs, "doc", words).collect()
    assert len(shares) == 80 and all(abs(sum(r["theta"]) - 1) < 1e-9 for r in shares)
    with pytest.raises(ValueError):
        back.transform(docs, "doc", words[::-1])
    monkeypatch.setattr(topics, "fit_structural_many", None)  # all values are stored
    assert topics.search_topics(docs, "doc", 20, [2, 3, 4], checkpoint=f"{tmp_path}/search", iterations=8) == first.results
    top = terms.top_terms(terms.frex(back.model.weights(spark), "topic", "term"), "topic", "term", "frex", 3).collect()
    assert len(top) == 3 * len(first.model.beta)
    found = topics.search_lda(docs, "doc", 20, [2], iterations=3)
    assert found[0][0] == 2 and found[0][1] < 0


def test_topic_jobs_are_run_once(spark, tmp_path):
    docs, words = topic_docs(spark, n=40), [f"w{k}" for k in range(20)]
    jobs = {("cat2", "topics"): (docs, words), ("cat2", "style"): (docs, words)}
    first = topics.run_topic_jobs(jobs, "doc", str(tmp_path), topic_numbers=[2, 3], iterations=3)
    again = topics.run_topic_jobs(jobs, "doc", str(tmp_path), topic_numbers=[2, 3], iterations=3)
    assert set(first) == set(again) == set(jobs) and all(not p.results for p in again.values())
    assert all(np.allclose(first[j].model.beta, again[j].model.beta) for j in jobs)


def test_classifier_dispatch_and_fit(spark):
    with pytest.raises(ValueError):
        classify.Classifier({"depth": 3})
    rows = spark.range(80).select(F.col("id"), F.array((F.col("id") % 2).cast("double"), F.rand(1)).alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    for params in ({"C": 1.0, "l1_ratio": 0.5}, {"max_features": 2, "min_samples_leaf": 1}):
        model = classify.Classifier(params, trees=5, max_iter=50).fit(rows, "x", "y")
        wrong = model.predict(rows, "id").join(rows.select("id", "y"), "id").where("y <> predicted").count()
        assert wrong == 0


def test_model_queries_do_the_whole_job(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.standard_normal(4) + 2 * (k % 2)], str(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>, y string")
    search, done = experiment.cross_validated_search(df, "vec_id", "x", "y", {"max_features": (1, 4)}, folds=3, trees=2)
    score, error = search.evaluate({"max_features": 2, "min_samples_leaf": 1})
    done()
    assert 0.5 < score <= 1 and 0 <= error < 0.3 and error != 0.01
    assert (search.n_initial, search.n_iterations, search.stop, search.jump, search.candidates) == (20, 50, 15, 5, 10_000)
    seen = {}
    monkeypatch.setattr(models, "_features", lambda *_: df)
    monkeypatch.setattr(classify, "permutation_importance", lambda m, r, k, positions, repeats=5: seen.update(positions=positions, repeats=repeats))
    models.permutation_importance(spark, "")
    assert seen == {"positions": [0, 1, 2, 3], "repeats": 5}
    monkeypatch.setattr(models, "_topic_documents", lambda *_: (df, 4))
    monkeypatch.setattr(topics, "diagnose_topics", lambda d, k, size, numbers, **options: seen.update(numbers=numbers, **options) or [topics.Diagnosis(2, -1.0)])
    models.search_topics(spark, "")
    assert seen["numbers"] == list(range(2, 21)) and "iterations" not in seen
    fits = []
    monkeypatch.setattr(forests, "score_many", lambda s, table, some: fits.append(some) or [np.eye(2, dtype=int) * f.max_features + 1 for f in some])
    assert models.tuning_history(spark, "").where("iteration = 0").count() == 20
    assert {(f.fold, f.trees) for some in fits for f in some} == {(k, 500) for k in range(5)} and [len(some) for some in fits][:2] == [100, 5]
    assert max(f.min_samples_leaf for f in fits[0]) > 90 and {f.max_features for f in fits[0]} == {1, 2, 3, 4}
    e = experiment.Experiment(df, df, "vec_id", "x", "y")
    monkeypatch.setattr(e, "fit", lambda params: seen.update(params=params) or e)
    fits.clear()
    e.tune({"max_features": (1, 4), "min_samples_leaf": (1, 3)}, "min_samples_leaf", True, n_initial=2, n_iterations=0)
    assert {(f.fold, f.trees) for some in fits for f in some} == {(k, 500) for k in range(5)}
    dealt = df.withColumn("fold", F.floor(F.col("vec_id") / 2) % 2)
    assert experiment.cross_validate(dealt, "x", "y", {"C": 1.0, "l1_ratio": 0.5}, 2, max_iter=20)[0] > 0.8


def test_permutation_importance_finds_the_telling_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(k % 2), float(rng.standard_normal()), 1.0], str(k % 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y string")
    model = classify.Classifier({"C": 1.0, "l1_ratio": 0.5}, max_iter=100).fit(df, "x", "y")
    found = {r["feature"]: r["importance"] for r in classify.permutation_importance(model, df, "id", [0, 1, 2], 5).collect()}
    assert 0.4 < found[0] < 0.6 and abs(found[1]) < 0.02 and found[2] == 0


def test_ranks_are_exact_and_in_buckets(spark):
    rng = np.random.default_rng(8)
    names = sorted({"".join(rng.choice(list("aé😀 zZ'"), rng.integers(1, 9))) for _ in range(600)})
    df = spark.createDataFrame([(int(k % 2) + 1, n) for k, n in enumerate(names)], "`order` int, ngram string").repartition(7)
    got = [(r["order"], r["ngram"]) for r in ranking.rank_by_name(df, "order", "ngram").orderBy("rank").collect()]
    want = sorted(((k % 2 + 1, n) for k, n in enumerate(names)), key=lambda x: (x[0], x[1].encode()))
    assert got == want and [r["rank"] for r in ranking.rank_by_name(df, "order", "ngram").orderBy("rank").collect()] == list(range(1, len(names) + 1))
    rows = [(k, None if k % 5 == 0 else k % 3, int(rng.integers(0, 40))) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    got = {r["id"]: r["rank"] for r in ranking.rank_in_buckets(df, ["g"], F.floor(F.col("v") / 7), ["v", "id"]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    plan = terms.vocabulary(df.select(F.col("g").alias("order"), F.col("v").cast("string").alias("ngram")))._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(_range" in plan  # what is numbered in one task are the ranges
    weights = spark.createDataFrame([(k % 3, float(rng.choice([0.0, 1e-300, 0.25, 0.5, 3.0, 1e9, rng.random()]))) for k in range(300)], "g int, v double").cache()
    got = ranking.average_rank(weights, ["g"], "v").toPandas()
    assert np.allclose(got["rank"], got.groupby("g")["v"].rank())


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi"\nthere, you', "x")], "track_id int, lyrics string, pmax1 string")
    tables.write_csv(rows, str(tmp_path / "c"), index="track_id")
    back = tables.csv(spark, str(tmp_path / "c"), "track_id int, lyrics string, pmax1 string").first()
    assert back["lyrics"] == 'say "hi"\nthere, you'
    matrix = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0)], "i long, j long, value double")
    tables.write_matrix_market(matrix, str(tmp_path / "m"), 2, 2)
    assert {tuple(r) for r in tables.matrix_market(spark, str(tmp_path / "m")).collect()} == {(1, 2, 3.0), (2, 1, 1.0)}
    big = spark.range(100_000).select((F.col("id") + 1).alias("i"), (F.col("id") % 7 + 1).alias("j"), F.lit(0.5).alias("value")).repartition(5)
    tables.write_matrix_market(big, str(tmp_path / "big"), 100_000, 7)
    parts = sorted(p for p in os.listdir(tmp_path / "big") if p.startswith("part-"))
    whole = "".join((tmp_path / "big" / p).read_text() for p in parts)
    assert len(parts) > 3 and whole.startswith("%%MatrixMarket matrix coordinate real general\n100000 7 100000\n") and whole.count("\n") == 100_002
    assert tables.matrix_market(spark, str(tmp_path / "big")).exceptAll(big).count() == 0 == big.exceptAll(tables.matrix_market(spark, str(tmp_path / "big"))).count()
    (tmp_path / "terms").mkdir()
    names = [f"w{(k * 7919) % 100_003}" for k in range(30_000)]
    (tmp_path / "terms" / "b.csv").write_text("term\n" + "\n".join(names[20_000:]) + "\n")
    (tmp_path / "terms" / "a.csv").write_text("term\n" + "\n".join(names[:20_000]) + "\n")
    numbered = tables.term_list(spark, str(tmp_path / "terms"))
    assert [r["term"] for r in numbered.orderBy("term_idx").collect()] == names and numbered.agg(F.max("term_idx")).first()[0] == 29_999
    text = tables.numbered(spark.read.option("maxPartitionBytes", 20_000).text(str(tmp_path / "terms" / "a.csv")))
    assert [r["value"] for r in text.orderBy("at").collect()] == ["term", *names[:20_000]]
    assert tables.drop_matching(rows, "PMAX").columns == ["track_id", "lyrics"]
    with pytest.raises(ValueError):
        tables.feature_table(spark, str(tmp_path), "other", 5)
    words = spark.createDataFrame([(0, "a"), (1, "b")], "term_idx long, ngram string")
    tables.write_matrix(matrix, words, str(tmp_path / "dtm"))
    cells, vocabulary = tables.read_matrix(spark, str(tmp_path / "dtm"))
    assert sorted(map(tuple, cells.collect())) == [(1, 2, 3.0), (2, 1, 1.0)] and vocabulary.count() == 2
    tables.write_metadata(spark, {"k": [1, "é"]}, str(tmp_path / "meta"))
    assert tables.read_metadata(spark, str(tmp_path / "meta")) == {"k": [1, "é"]}


def test_streaming_counts(spark, tmp_path):
    from lexiloom.streaming import documents

    rows = spark.createDataFrame([(1, "a b c", "en"), (2, None, "en"), (3, "x", "de")], "doc_id long, text string, lang string")
    rows.write.parquet(str(tmp_path / "s"))
    stream = documents.running_counts(documents.stream(spark, str(tmp_path / "s"), rows.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from counted").collect()} == {("en", 2, 3), ("de", 1, 1)}
    finally:
        q.stop()


def test_streamed_tables_survive_replays_and_restarts(spark, tmp_path):
    from lexiloom.streaming import documents

    schema = "doc_id long, text string, lang string"
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "term_idx long, ngram string")
    first = spark.createDataFrame([(1, "a b a", "en"), (2, None, "en")], schema)
    more = spark.createDataFrame([(3, "b c", "de"), (1, "a", "en")], schema)
    source, kept, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    first.coalesce(1).write.parquet(source)
    counts = documents.batch_counts(vocab)
    documents.keep_all(documents.stream(spark, source, first.schema), counts, kept, marks).awaitTermination()
    once = sorted(map(tuple, documents.kept_counts(spark, kept).collect()))
    assert once == [(1, 0, 2), (1, 1, 1)]
    documents.keep_batch(counts(first), 0, kept)  # a replay
    assert sorted(map(tuple, documents.kept_counts(spark, kept).collect())) == once
    more.coalesce(1).write.mode("append").parquet(source)
    documents.keep_all(documents.stream(spark, source, first.schema), counts, kept, marks).awaitTermination()  # a restart
    assert sorted(map(tuple, documents.kept_counts(spark, kept).collect())) == [(1, 0, 3), (1, 1, 1), (3, 1, 1)]
    model = topics.TopicModel(np.array([[0.9, 0.1], [0.1, 0.9]]), np.zeros((1, 1)), np.eye(1), 2, np.ones(1))
    documents.keep_all(documents.stream(spark, source, first.schema), documents.batch_shares(model, vocab), str(tmp_path / "theta"), str(tmp_path / "marks2")).awaitTermination()
    shares = {r["doc_id"]: r["theta"] for r in spark.read.parquet(str(tmp_path / "theta")).where("doc_id <> 1").collect()}
    assert shares[2] == [0.5, 0.5] and shares[3][1] > 0.5


def test_counts_in_slices(spark, monkeypatch):
    texts = ["the red cat sat on a red mat", "a red cat", "", None, "red cat sat on 3 mats", "one"]
    docs = spark.createDataFrame([(t, "xyz"[k % 2] if k < 5 else None, f"a{k % 3}" if k != 1 else None) for k, t in enumerate(texts)], "text string, label string, artist string")
    rows = terms.ngram_rows(docs, ["label", "artist"], "text", (1, 2, 3, 4))
    for least in (2, 3):
        expected = {(r[0], r[1], tuple(r[2])) for r in terms._counts_by_class(rows, "label", "artist", ["x", "y"], least, True, True).collect()}
        monkeypatch.setattr(terms, "SLICE", 10)
        found = terms._sliced_counts(docs, "text", [1, 2, 3, 4], "label", "artist", ["x", "y"], least, True, True)
        assert len(found.inputFiles()) > 1
        found = [(r[0], r[1], tuple(r[2])) for r in found.collect()]
        assert len(found) == len(expected) and set(found) == expected and (found or least == 3)
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_tests_that_cannot_pass_are_only_counted(spark):
    scores = spark.createDataFrame([(1, f"g{k}", "x", z) for k, z in enumerate([9.0, 8.0, 5.0, 0.1, -1.0, -6.0])], "order int, ngram string, label string, z double")
    assert [r["ngram"] for r in terms.select_by_log_odds(scores, 0.001).orderBy("term_idx").collect()] == ["g0", "g1", "g2"]
    low = spark.createDataFrame([(0.0009,)], "p double")
    assert terms.benjamini_hochberg(low, 0.001, m=1).first()["passes_bh"] and not terms.benjamini_hochberg(low, 0.001, m=2).first()["passes_bh"]


def test_documents_are_held_against_a_vocabulary_before_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red cat red cat sat"), (1, "red cat"), (2, None)], "id int, text string")
    vocab = spark.createDataFrame([(0, 1, "red"), (1, 2, "red cat")], "term_idx long, order int, ngram string")
    for most in (terms.SENT, 1):
        monkeypatch.setattr(terms, "SENT", most)
        assert {tuple(r) for r in terms.transform_documents(docs, ["id"], "text", (1, 2), vocab).collect()} == {(1, 0, 3), (1, 1, 3)}


def test_topic_logits_are_at_their_modes():
    """Newton steps end where the gradient vanishes, also from a wide prior over many topics."""
    rng = np.random.default_rng(3)
    k, v, n = 12, 60, 8
    beta, inverse = rng.dirichlet(np.ones(v), k), np.eye(k - 1) / 20
    terms_ = np.concatenate([np.sort(rng.choice(v, 30, replace=False)) for _ in range(n)])
    counts, offsets = rng.integers(1, 9, n * 30).astype(float), np.arange(n + 1) * 30
    eta, _, expected, _ = topics.infer(terms_, counts, offsets, np.zeros((n, k - 1)), inverse, beta)
    drawn = expected.reshape(k, n, 30).sum(2).T
    gradient = (drawn - drawn.sum(1, keepdims=True) * topics._shares(eta))[:, :-1] - eta @ inverse
    assert np.abs(gradient).max() < 1e-3


def test_topic_search_plans_each_step_from_written_documents(spark, monkeypatch):
    from lexiloom.operators import stored

    docs = spark.createDataFrame([(i, [0, 1], [1.0, 2.0], [1.0]) for i in range(40)], "doc long, terms array<int>, counts array<double>, x array<double>")
    names, parts, write = [], [], stored.written
    monkeypatch.setattr(stored, "written", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(topics, "fit_structural_many", lambda d, *a, **k: parts.append(topics._partitions(d)) or {2: None})
    topics.diagnose_topics(docs.coalesce(1), "doc", 2, [2])
    assert names == ["documents"] and parts[0] > 1  # written once, and on more than one core


def test_search_fits_points_that_come_again_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), float(i % 3)], str(i % 2)) for i in range(40)], "id long, f array<double>, c string")
    fits = []
    monkeypatch.setattr(forests, "score_many", lambda s, table, some: fits.extend(some) or [np.eye(2, dtype=int) * f.max_features + 1 for f in some])
    search, done = experiment.cross_validated_search(rows, "id", "f", "c", {"max_features": (1, 2), "min_samples_leaf": (1, 2)}, folds=2, trees=3, n_initial=8, n_iterations=4)
    history = search.run()
    done()
    assert len(history) == 12 and len(fits) == len(set(fits)) == 2 * len({tuple(h["params"].values()) for h in history})
