"""Models fitted side by side and forests against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import classify, experiment, forests, many


def made(spark, n=260, d=6, classes=3, seed=1, flat=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.standard_normal((n, d)) * (1 + np.arange(d)) + np.eye(classes, d)[y] * 2
    x[:, 1] = np.round(x[:, 1])  # equal values
    if flat:
        x[:, -1] = 3.0
    rows = [(k, v.tolist(), f"c{c}") for k, (v, c) in enumerate(zip(x, y))] + [(n, None, "c0"), (n + 1, [0.0] * d, None)]
    return spark.createDataFrame(rows, "id long, x array<double>, y string")


def test_folds_and_shares_follow_from_ranks(spark):
    from lexiloom.operators.grouping import hash_rank

    rows = made(spark)
    dealt, names = many.deal(rows, "id", "x", "y", folds=4)
    got = {r["id"]: r for r in dealt.collect()}
    assert names == ["c0", "c1", "c2"] and len(got) == 260
    ranked = hash_rank(rows.where("x is not null and y is not null"), "id", "y", 42, "r").collect()
    for f in range(4):
        for c in names:
            others = sorted((r["r"], r["id"]) for r in ranked if r["y"] == c and got[r["id"]]["fold"] != f)
            for share in (0.1, 0.37, 0.5, 1.0):
                take = -(-len(others) * share // 1)
                mine = {i for _, i in others if got[i]["need"][f] < share}
                assert mine == {i for _, i in others[: int(take)]}


@pytest.mark.parametrize("full", [512, 0])
def test_models_side_by_side_are_as_good_as_alone(spark, monkeypatch, full):
    monkeypatch.setattr(many, "FULL", full)
    rows = made(spark)
    dealt, names = many.deal(rows, "id", "x", "y")
    dealt = dealt.repartition(3).cache()
    tasks = [many.Task(1.0, 0.5, 0), many.Task(0.1, 0.9, 1, 0.5), many.Task(0.05, 0.0, 2, 0.3), many.Task(1.0, 1.0)]
    models = many.fit_many(dealt, 3, tasks, max_iter=150)
    assert not full or all(m.steps < 150 for m in models)
    pdf = dealt.toPandas()
    x, y, need = np.array(pdf["x"].tolist()), pdf["y"].to_numpy(), np.array(pdf["need"].tolist())

    def objective(m, b, c, at):
        n, counts = at.sum(), np.bincount(y[at], minlength=3)
        logits = (x[at] / np.where(x[at].std(0) > 0, x[at].std(0), 1)) @ b.T + c
        log = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        w = n / (3 * counts)
        return -(w[y[at]] * log[np.arange(n), y[at]]).mean() + (m.task.l1_ratio * np.abs(b).sum() + (1 - m.task.l1_ratio) / 2 * (b**2).sum()) / (m.task.C * n)

    trained, tested = many.confusions(dealt, 3, models)
    for k, m in enumerate(models):
        f = m.task.fold
        at = np.ones(len(y), bool) if f is None else (pdf["fold"].to_numpy() != f) & (need[:, f] < m.task.share)
        assert m.rows == at.sum() == trained[k].sum()
        alone = classify.Classifier({"C": m.task.C, "l1_ratio": m.task.l1_ratio}).fit(spark.createDataFrame([(a.tolist(), str(b)) for a, b in zip(x[at, :-1], y[at])], "x array<double>, y string"), "x", "y")
        theirs = np.hstack([alone.model.coefficientMatrix.toArray(), np.zeros((3, 1))])
        assert objective(m, m.coefficients, m.intercepts, at) <= objective(m, theirs, alone.model.interceptVector.toArray(), at) + (1e-4 if full else 1e-2)
        said = ((x / m.scale) @ m.coefficients.T + m.intercepts).argmax(1)
        table = np.zeros((3, 3), int)
        if f is not None:
            np.add.at(table, (y[pdf["fold"] == f], said[pdf["fold"] == f]), 1)
        assert (tested[k] == table).all()


def test_macro_f1_equals_the_metric(spark):
    from lexiloom.operators import metrics

    table = np.array([[5, 1, 0], [2, 7, 0], [0, 0, 0]])
    pairs = spark.createDataFrame([(str(t), str(p)) for t in range(3) for p in range(3) for _ in range(table[t, p])], "t string, p string")
    assert abs(many.macro_f1(table) - metrics.macro(pairs, "t", "p").first()["macro_f1"]) < 1e-12


def test_absent_classes_and_one_row(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0, 1.0], "a"), (3, [0.0, 0.0], "b")], "id long, x array<double>, y string")
    curve = many.learning_curve(rows, "id", "x", "y", {"C": 1.0, "l1_ratio": 0.5}, [0.5, 1.0], folds=2).collect()
    assert len(curve) == 2
    with pytest.raises(ValueError):
        many.learning_curve(rows.where("false"), "id", "x", "y", {"C": 1.0, "l1_ratio": 0.5}, [1.0])


def plain_tree(table, fit, number):
    """One tree by recursion over lists, with the same draws."""
    rows = table.training(fit)
    sizes = np.bincount(table.y[rows], minlength=table.classes)
    class_weight = len(rows) / ((sizes > 0).sum() * np.maximum(sizes, 1))
    root = forests.tree_hashes(fit.seed, np.array([number]))
    times = forests.times_drawn(root, table.keys[rows])[0]
    drawn = [(r, t * class_weight[table.y[r]]) for r, t in zip(rows.tolist(), times.tolist()) if t]

    def impurity_score(side):
        sums = np.zeros(table.classes)
        for r, w in side:
            sums[table.y[r]] += w
        return (sums**2).sum() / sums.sum()

    def node(own, h):
        totals = np.zeros(table.classes)
        for r, w in own:
            totals[table.y[r]] += w
        best = None
        if len(own) >= max(2, 2 * fit.min_samples_leaf) and (totals > 0).sum() > 1:
            order = forests.drawn_features(np.array([h], np.uint64), table.x.shape[1])[0].tolist()
            m = fit.max_features
            varies = [len({table.x[r, j] for r, _ in own}) > 1 for j in order]
            chosen = order[:m] if any(varies[:m]) else [j for j, v in zip(order, varies) if v][:1]
            for j in chosen:
                values = sorted({table.x[r, j] for r, _ in own})
                for a, b in zip(values, values[1:]):
                    left, right = [e for e in own if table.x[e[0], j] <= a], [e for e in own if table.x[e[0], j] > a]
                    if min(len(left), len(right)) >= fit.min_samples_leaf:
                        score = round(impurity_score(left) + impurity_score(right), 9)
                        if best is None or score > best[0]:
                            best = (score, j, (a + b) / 2, left, right)
        if best is None:
            return (totals / totals.sum()).round(9).tolist()
        hashes = [int(forests.children(np.array([h], np.uint64), side)[0]) for side in (0, 1)]
        return best[1], round(best[2], 9), node(best[3], hashes[0]), node(best[4], hashes[1])

    return node(drawn, int(root[0]))


def as_nested(trees, at):
    if trees.feature[at] < 0:
        return trees.value[at].round(9).tolist()
    return int(trees.feature[at]), round(float(trees.threshold[at]), 9), as_nested(trees, trees.left[at]), as_nested(trees, trees.right[at])


@pytest.mark.parametrize("max_features, least, fold", [(2, 1, None), (6, 1, 0), (1, 1, 1), (3, 7, None)])
@pytest.mark.parametrize("slice_", [1 << 14, 40])
def test_trees_equal_brute_force(spark, monkeypatch, max_features, least, fold, slice_):
    monkeypatch.setattr(forests, "SLICE", slice_)
    dealt, names = many.deal(made(spark, n=90), "id", "x", "y", folds=3)
    table = forests.small_table(dealt, len(names), "id")
    fit = forests.Fit(max_features, least, 6, fold)
    trees = forests.grow_block(table, fit, np.arange(6))
    for t in range(6):
        assert as_nested(trees, trees.root[t]) == plain_tree(table, fit, t)
    alone = forests.grow_block(table, fit, np.array([4]))
    assert as_nested(alone, 0) == as_nested(trees, 4)  # a tree doesn't depend on its block


def test_forests_side_by_side_equal_forests_alone(spark, monkeypatch):
    monkeypatch.setattr(forests, "BLOCK", 4)
    monkeypatch.setattr(forests, "SENT", 2000)
    rows = made(spark)
    dealt, names = many.deal(rows, "id", "x", "y", folds=3)
    table = forests.small_table(dealt, 3, "id")
    fits = [forests.Fit(m, leaf, 10, f) for m, leaf in ((2, 1), (4, 9)) for f in range(3)]
    counts = forests.score_many(spark, table, fits)
    for fit, got in zip(fits, counts):
        votes = forests.grow_block(table, fit, np.arange(10)).votes(table.x[table.fold == fit.fold])
        expected = np.zeros((3, 3), int)
        np.add.at(expected, (table.y[table.fold == fit.fold], np.round(votes, 9).argmax(1)), 1)
        assert (got == expected).all()
    model = forests.ForestModel.fit(spark, table, forests.Fit(3, 1, 10))
    assert len(model._groups()) > 1
    voted = {r["id"]: r["_votes"] for r in model.add_votes(dealt.repartition(3), "x").collect()}
    whole = forests.grow_block(table, forests.Fit(3, 1, 10), np.arange(10))
    for r in dealt.collect():
        assert np.allclose(voted[r["id"]], whole.votes(np.array([r["x"]]))[0])


def test_forest_learns_and_large_tables_take_another_way(spark, monkeypatch):
    rows = made(spark, n=400, flat=False)
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0 and x is not null and y is not null")
    for small in (1 << 25, 0):
        monkeypatch.setattr(forests, "SMALL", small)
        model = classify.Classifier({"max_features": 2, "min_samples_leaf": 2}, trees=60).fit(train, "x", "y")
        assert isinstance(model.model, forests.ForestModel) == bool(small)
        right = model.add_predictions(test).agg(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]
        assert right > 0.6


def test_search_goes_on_from_the_shared_folder(spark, tmp_path):
    rows, space = made(spark), {"C": (0.01, 10.0), "l1_ratio": (0.0, 1.0)}
    options = {"n_initial": 4, "n_iterations": 2, "candidates": 50, "folds": 3, "checkpoint": str(tmp_path)}
    search, done = experiment.cross_validated_search(rows, "id", "x", "y", space, **options)
    first = search.run()
    done()
    again, done = experiment.cross_validated_search(rows, "id", "x", "y", space, **options)
    again.evaluate = again.evaluate_many = None  # nothing is left to evaluate
    assert again.run() == first and len(first) >= 5 and all(np.isfinite(h["score"]) for h in first)
    done()


def test_trees_are_read_as_arrow_arrays(spark):
    from lexiloom.operators import forests

    blocks = spark.createDataFrame([(0, low, [0], [1, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.5, 0.5, 1.0, 0.0, 0.0, low / 40]) for low in (0, 20)], forests.SCHEMA).orderBy("low")
    for a, b in zip(forests.read_trees(forests._arrow_rows(blocks), 2), forests.read_trees(blocks.collect(), 2), strict=True):
        assert all((getattr(a, n) == getattr(b, n)).all() for n in ("root", "feature", "threshold", "left", "right", "value"))


@pytest.mark.parametrize("sent", [1 << 26, 3000])
def test_forests_of_large_tables_are_whole_and_exact(spark, monkeypatch, tmp_path, sent):
    """The trees of a table that isn't sent at once, however rows and features are dealt; before, they had bins and 30 levels."""
    from lexiloom.operators import deep

    rows = made(spark, n=400).where("x is not null and y is not null")
    params = {"max_features": 2, "min_samples_leaf": 1}
    small = classify.Classifier(params, trees=30).fit(rows, "x", "y")
    expected = {r["id"]: r["_votes"] for r in small.model.add_votes(rows, "x").collect()}
    for name, value in (("SMALL", 0), ("SENT", sent), ("ENTRIES", 1600)):
        monkeypatch.setattr(forests, name, value)
    monkeypatch.setattr(deep, "CHUNK", 8 * 400 * 2)
    large = classify.Classifier(params, trees=30).fit(rows.repartition(3), "x", "y")
    large.save(spark, f"{tmp_path}/large")
    for model in (large, classify.Classifier.load(spark, f"{tmp_path}/large")):
        assert isinstance(model.model, deep.DeepForest) and sorted(r[0] for r in model.model.trees.select("number").collect()) == list(range(30))
        voted = {r["id"]: r["_votes"] for r in model.model.add_votes(rows.repartition(2), "x").collect()}
        assert voted.keys() == expected.keys() and all(np.allclose(voted[k], expected[k]) for k in expected)
    said = [{r["id"]: r["predicted"] for r in m.predict(rows, "id").collect()} for m in (small, large)]
    assert said[0] == said[1]


def test_packed_trees_vote_alike_and_deep_ones_are_whole():
    from lexiloom.operators import deep

    n = 160
    x = np.column_stack([np.arange(n, dtype=float), np.ones(n)])
    table = forests.Table(x, np.arange(n) % 2, np.full(n, -1), np.arange(n), 3)
    fit = forests.Fit(2, 1, 4)
    columns = deep.Columns(table.y, table.keys, 3, 2)
    for j in range(2):
        columns.put(j, x[:, j])
    block = forests.grow_block(columns, fit, np.arange(4))

    def levels(at):
        return 0 if block.feature[at] < 0 else 1 + max(levels(block.left[at]), levels(block.right[at]))

    assert max(levels(root) for root in block.root) > 30
    assert all(as_nested(block, block.root[t]) == plain_tree(table, fit, t) for t in range(4))
    packed = forests.pack(block)
    assert np.allclose(sum(forests.unpack(raw).votes(x) for _, raw in packed), block.votes(x)) and sum(nodes for nodes, _ in packed) == len(block.feature)
    assert all(as_nested(forests.unpack(raw), 0) == as_nested(block, root) for (_, raw), root in zip(packed, block.root))


@pytest.mark.parametrize("rows", [0, 2])
def test_large_tables_without_rows_or_of_several_widths_raise(spark, monkeypatch, rows):
    monkeypatch.setattr(forests, "SMALL", 0)
    ragged = spark.createDataFrame([([1.0], "a"), ([1.0, 2.0], "b")][:rows], "x array<double>, y string")
    with pytest.raises(ValueError, match="no rows|1 to 2 features"):
        classify.Classifier({"max_features": 1, "min_samples_leaf": 1}, trees=2).fit(ragged, "x", "y")


def test_forests_are_kept_by_tree_and_old_ones_are_read(spark, tmp_path):
    """A task wrote and read blocks of up to 20 trees at a time, tens of MB in a row."""
    dealt, _ = many.deal(made(spark), "id", "x", "y", folds=3)
    table = forests.small_table(dealt, 3, "id")
    model = forests.ForestModel.fit(spark, table, forests.Fit(3, 1, 10))
    assert sorted(r["number"] for r in model.trees.collect()) == list(range(10))
    t = forests.grow_block(table, forests.Fit(3, 1, 10), np.arange(10))
    row = (0, 0, *(a.tolist() for a in (t.root, t.feature, t.threshold, t.left, t.right)), t.value.ravel().tolist())
    spark.createDataFrame([row], forests.SCHEMA).withColumn("classes", F.lit(3)).write.parquet(f"{tmp_path}/old")
    model.save(f"{tmp_path}/new")
    for path in ("old", "new"):
        found = forests.ForestModel.load(spark, f"{tmp_path}/{path}")
        assert all(np.allclose(r["_votes"], t.votes(np.array([r["x"]]))[0]) for r in found.add_votes(dealt, "x").collect())
