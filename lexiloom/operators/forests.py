"""Random forests of many fits grown together, without a limit of depth.

A search or a matrix of experiments needs thousands of trees on one table:
trees of several parameters, each without a fold.  A tree's draws are hashes of
its number, of rows and of nodes, so any task can grow any tree, again if it is
lost.  Tables up to ``SMALL`` bytes of features are broadcast once, and blocks
of trees are dealt over the tasks; all trees of a block grow side by side, a
level at a time, over presorted values, and splits are exact.  Only votes or
finished trees leave a task.  For larger tables see :mod:`.deep`.

Splits maximise the decrease of Gini impurity with balanced class weights.  A
node draws ``max_features`` features (one more that isn't constant, where all
of them are) and is split while it is impure and both sides keep
``min_samples_leaf`` different rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 32 << 20  # bytes of features that are sent to all executors
BLOCK, ENTRIES = 20, 1 << 18  # trees that grow side by side, and rows of theirs
SLICE = 1 << 14  # values sorted at a time, which stay in a core's cache
BITS = 22  # of a place within a slice, and of a code; more where a node alone has more rows
#: Chances of drawing a row at most 0, 1, 2, ... times, with a mean of 1.
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass(frozen=True)
class Fit:
    """Parameters of a forest, and the fold that it doesn't train on."""

    max_features: int
    min_samples_leaf: int
    trees: int
    fold: int | None = None
    seed: int = 42


@dataclass
class Table:
    """A small table in one place: features, their order by value, classes, folds and hashes of the rows' keys."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    keys: np.ndarray
    classes: int
    codes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.codes = np.empty(self.x.shape[::-1], np.int64)  # features x rows
        for j in range(self.x.shape[1]):
            self.codes[j] = np.unique(self.x[:, j], return_inverse=True)[1]

    def distinct(self, j: int) -> np.ndarray:
        """A feature's values by code."""
        return np.unique(self.x[:, j])

    def training(self, fit: Fit) -> np.ndarray:
        return np.flatnonzero(self.fold != fit.fold) if fit.fold is not None else np.arange(len(self.y))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tree_hashes(seed: int, trees: np.ndarray) -> np.ndarray:
    return mix(mix(trees.astype(np.uint64) + np.uint64(1)) ^ mix(np.full(1, seed % 2**64, np.uint64)))


def times_drawn(trees: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each tree (hash) draws each row (hash of its key): trees x rows."""
    u = (mix(trees[:, None] ^ mix(keys.astype(np.uint64))[None]) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, u, "right").astype(np.int64)


def drawn_features(nodes: np.ndarray, features: int) -> np.ndarray:
    """All features in the order in which each node (hash) draws them: nodes x features."""
    return np.argsort(mix(nodes[:, None] ^ mix(np.arange(1, features + 1, dtype=np.uint64))[None]), axis=1, kind="stable")


def children(nodes: np.ndarray, side: int) -> np.ndarray:
    return mix(nodes + np.uint64(0x9E3779B97F4A7C15 * (side + 1) % 2**64))


@dataclass
class Trees:
    """Nodes of some trees.  ``feature`` is -1 in leaves; rows with a value up to
    ``threshold`` go to ``left``; ``value``: shares of the classes in a leaf."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the shares of the leaves that rows fall into."""
        out = np.zeros((len(x), self.value.shape[1]))
        for root in self.root:
            at = np.full(len(x), root)
            going = np.arange(len(x))
            while len(going):
                f = self.feature[at[going]]
                going, f = going[f >= 0], f[f >= 0]
                here = at[going]
                at[going] = np.where(x[going, f] <= self.threshold[here], self.left[here], self.right[here])
            out += self.value[at]
        return out


def _runs(g: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]])


def best_splits(group: np.ndarray, code: np.ndarray, y: np.ndarray, w: np.ndarray, least: int, classes: int) -> tuple[np.ndarray, ...]:
    """Of each group of rows: its number, the best score (-inf without a split), the
    code up to which rows go left and the next one, and whether codes differ.

    The score is the sum over both sides of the squared class weights by the
    side's weight.  Squares of running class weights follow from each row's own
    class alone, so the work doesn't grow with the number of classes.
    """
    n = len(group)
    code = code.astype(np.int64, copy=False)
    bits = max(BITS, n.bit_length(), int(code.max()).bit_length())
    below = (1 << bits) - 1
    places = np.arange(n)
    key = group << 2 * bits
    key |= code << bits
    key |= places
    key.sort()
    order = key & below
    g, c = key >> 2 * bits, (key >> bits) & below
    y, w = y[order], w[order]
    starts = _runs(g)
    sizes = np.diff(np.r_[starts, n])
    last = starts + sizes - 1
    run = np.repeat(np.arange(len(starts)), sizes)
    # Running weight of a row's own class, from rows in the order of group, class and place.
    by_class = g * classes
    by_class += y
    by_class <<= bits
    by_class |= places
    by_class.sort()
    at = by_class & below
    first = _runs(by_class >> bits)
    each = np.diff(np.r_[first, n])
    own = w[at]
    upto = np.cumsum(own)
    ends = upto[first + each - 1]
    begins = np.r_[0.0, ends[:-1]]
    before, whole = np.empty(n), np.empty(n)
    before[at], whole[at] = upto - own - np.repeat(begins, each), np.repeat(ends - begins, each)

    def within(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums within groups, and the groups' sums."""
        total = np.cumsum(values)
        ends = total[last]
        begins = np.r_[0.0, ends[:-1]]
        total -= begins[run]
        return total, ends - begins

    before *= 2
    before += w
    before *= w
    squares, all_squares = within(before)
    whole *= w
    products, _ = within(whole)
    left, all_left = within(w)
    ok = np.empty(n, bool)
    np.not_equal(c[1:], c[:-1], out=ok[:-1])
    ok[last] = False
    if least > 1:
        place = places - starts[run] + 1
        ok &= (place >= least) & (sizes[run] - place >= least)
    at = np.flatnonzero(ok)
    best = np.full(len(starts), -np.inf)
    cut = after = np.zeros(len(starts), np.int64)
    if len(at):
        own = run[at]
        here, sums = squares[at], left[at]
        score = here / sums + (all_squares[own] - 2 * products[at] + here) / (all_left[own] - sums)
        score = np.round(score, 9)  # equal ones stay equal however they were summed
        begin = _runs(own)
        top = np.maximum.reduceat(score, begin)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[begin, len(at)])))
        hit = hit[_runs(own[hit])]  # the first of equals
        best[own[begin]] = top
        cut, after = cut.copy(), after.copy()
        cut[own[begin]], after[own[begin]] = c[at[hit]], c[at[hit] + 1]
    return g[starts], best, cut, after, c[starts] != c[last]


def grow(codes: np.ndarray, y: np.ndarray, row: np.ndarray, weight: np.ndarray, tree: np.ndarray, hashes: np.ndarray, fit: Fit, classes: int, threshold) -> Trees:
    """Trees over entries (``row`` of ``codes`` and ``y``, its ``weight``, and its
    ``tree`` as a position in ``hashes``, their roots' hashes).  ``threshold(feature,
    code, next code)`` gives the values to split at."""
    d = len(codes)
    m = min(max(1, int(fit.max_features)), d)
    node, nodes, parts, base = tree.astype(np.int64), hashes, [], 0
    while len(nodes):
        n = len(nodes)
        totals = np.bincount(node * classes + y[row], weight, n * classes).reshape(n, classes)
        count = np.bincount(node, minlength=n)
        open_ = np.flatnonzero((count >= 2 * fit.min_samples_leaf) & (count >= 2) & ((totals > 0).sum(1) > 1))
        feature, low, high = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(open_):
            dense = np.full(n, -1)
            dense[open_] = np.arange(len(open_))
            inside = dense[node] >= 0
            row, weight, node = row[inside], weight[inside], dense[node[inside]]
            order = drawn_features(nodes[open_], d)
            best, constant = np.full(len(open_), -np.inf), np.ones(len(open_), bool)

            def look(which: np.ndarray, columns: np.ndarray) -> None:
                """Best splits of the open nodes ``which`` by their features ``columns``, a slice at a time."""
                place = np.full(len(open_), -1)
                place[which] = np.arange(len(which))
                at = np.flatnonzero(place[node] >= 0) if len(which) < len(open_) else np.arange(len(node))
                width = max(1, SLICE // max(1, len(at)))
                for a in range(0, columns.shape[1], width):
                    some = columns[:, a : a + width]
                    s = some.shape[1]
                    own = place[node[at]]
                    group = (own[:, None] * s + np.arange(s)).ravel()
                    cells = np.repeat(row[at], s)
                    g, score, c, after, differ = best_splits(group, codes[some[own].ravel(), cells], y[cells], np.repeat(weight[at], s), fit.min_samples_leaf, classes)
                    owner, slot = which[g // s], g % s
                    constant[owner[differ]] = False
                    top = np.lexsort((slot, -score, owner))
                    top = top[_runs(owner[top])]
                    o = owner[top]
                    up = score[top] > best[o]
                    o, top = o[up], top[up]
                    best[o] = score[top]
                    feature[open_[o]], low[open_[o]], high[open_[o]] = some[place[o], slot[top]], c[top], after[top]

            _in_slices(np.bincount(node, minlength=len(open_)), look, np.arange(len(open_)), order[:, :m])
            flat = np.flatnonzero(constant & (m < d))
            if len(flat):  # the first feature that isn't constant
                at = np.flatnonzero(np.isin(node, flat))
                by = at[np.argsort(node[at], kind="stable")]
                begin = _runs(node[by])
                values = codes[:, row[by]]
                differ = (np.maximum.reduceat(values, begin, axis=1) > np.minimum.reduceat(values, begin, axis=1)).T
                ranked = np.take_along_axis(differ, order[flat], 1)
                some = ranked.any(1)
                if some.any():
                    _in_slices(np.bincount(node, minlength=len(open_)), look, flat[some], order[flat[some], ranked[some].argmax(1)][:, None])
        split = np.flatnonzero(feature >= 0)
        left, right = np.full(n, -1), np.full(n, -1)
        left[split] = base + n + 2 * np.arange(len(split))
        right[split] = left[split] + 1
        cut = np.zeros(n)
        cut[split] = threshold(feature[split], low[split], high[split])
        parts.append((feature, cut, left, right, totals / np.maximum(totals.sum(1, keepdims=True), 1e-300)))
        base += n
        if not len(split):
            break
        turn = np.full(n, -1)
        turn[split] = np.arange(len(split))
        where = open_[node]
        inside = turn[where] >= 0
        row, weight, where = row[inside], weight[inside], where[inside]
        node = 2 * turn[where] + (codes[feature[where], row] > low[where])
        nodes = np.stack([children(nodes[split], 0), children(nodes[split], 1)], 1).ravel()
    return Trees(np.arange(len(hashes)), *(np.concatenate(p) for p in zip(*parts)))


def _in_slices(sizes: np.ndarray, look, which: np.ndarray, columns: np.ndarray) -> None:
    """``look`` at runs of whole nodes of a slice together; a node alone may have more rows."""
    ends, low = np.cumsum(sizes[which]), 0
    while low < len(which):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        look(which[low:high], columns[low:high])
        low = high


def grow_block(table: Table, fit: Fit, numbers: np.ndarray) -> Trees:
    """The trees of some numbers of a forest."""
    rows = table.training(fit)
    y, k = table.y[rows], table.classes
    sizes = np.bincount(y, minlength=k)
    weights = np.where(sizes > 0, len(rows) / (max((sizes > 0).sum(), 1) * np.maximum(sizes, 1)), 0.0)
    hashes = tree_hashes(fit.seed, numbers)
    drawn = times_drawn(hashes, table.keys[rows])
    drawn[drawn.sum(1) == 0] = 1  # a tree that drew nothing takes all
    tree, at = np.nonzero(drawn)
    values = [table.distinct(j) for j in range(len(table.codes))]

    def threshold(feature: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.array([_middle(values[f][a], values[f][b]) for f, a, b in zip(feature.tolist(), low.tolist(), high.tolist())])

    return grow(table.codes, table.y, rows[at], drawn[tree, at] * weights[y[at]], tree, hashes, fit, k, threshold)


def _middle(a: float, b: float) -> float:
    half = a / 2 + b / 2
    return half if a <= half < b else a


def small_table(rows: DataFrame, classes: int, key: str | None = None) -> Table | None:
    """``x, y`` and perhaps ``fold`` in one place, where they are counted to be small enough.

    Draws go by the hash of ``key``; without one, by the row's place in the
    order of its contents.
    """
    size = rows.agg(F.count("*").alias("n"), F.sum(F.size("x") * 8).alias("bytes")).first()
    if not size["n"] or size["bytes"] > SMALL:
        return None
    fold = F.col("fold") if "fold" in rows.columns else F.lit(-1)
    found = rows.select("x", "y", fold.alias("fold"), (F.xxhash64(key) if key else F.xxhash64("x", "y")).alias("h")).toArrow().combine_chunks()
    order = np.argsort(found["h"].to_numpy(), kind="stable")  # the same in every run
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
    keys = found["h"].to_numpy()[order] if key else np.arange(found.num_rows)
    return Table(x[order], found["y"].to_numpy()[order].astype(np.int64), found["fold"].to_numpy()[order], keys, classes)


def _units(spark: SparkSession, fits: list[Fit], rows: int, each: int = 4) -> DataFrame:
    """``fit, low, high``: blocks of trees, dealt evenly over the tasks, of which each core gets ``each``."""
    block = max(1, min(BLOCK, ENTRIES // max(1, rows)))
    units = [(k, low, min(low + block, fit.trees)) for k, fit in enumerate(fits) for low in range(0, fit.trees, block)]
    tasks = max(1, min(len(units), each * spark.sparkContext.defaultParallelism))
    dealt = [u for t in range(tasks) for u in units[t::tasks]]
    return spark.createDataFrame(dealt, "fit int, low int, high int").repartitionByRange(tasks, F.xxhash64("fit", "low"))


def score_many(spark: SparkSession, table: Table, fits: list[Fit]) -> np.ndarray:
    """Confusion counts (fits x truth x prediction) of each forest on its own fold."""
    held, k = spark.sparkContext.broadcast(table), table.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            votes: dict[int, np.ndarray] = {}
            for f, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                fit = fits[f]
                v = grow_block(table, fit, np.arange(low, high)).votes(table.x[table.fold == fit.fold])
                votes[f] = votes[f] + v if f in votes else v
            yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.int32()), pa.array([v.tobytes() for v in votes.values()], pa.binary())], ["fit", "votes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, votes = held.value, {}
        for batch in batches:
            for f, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(raw.as_py())
                votes[f] = votes[f] + v if f in votes else v
        out = []
        for f, v in votes.items():
            truth = table.y[table.fold == fits[f].fold]
            said = np.round(v.reshape(-1, k), 9).argmax(1)
            out.append(np.bincount(truth * k + said, minlength=k * k).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.int32()), pa.array(out, pa.binary())], ["fit", "counts"])

    found = _units(spark, fits, len(table.y)).mapInArrow(run, "fit int, votes binary").repartition("fit").mapInArrow(add, "fit int, counts binary").collect()
    held.destroy()
    out = np.zeros((len(fits), k, k), np.int64)
    for row in found:
        out[row["fit"]] = np.frombuffer(row["counts"], np.int64).reshape(k, k)
    return out


def pack(trees: Trees) -> list[tuple[int, bytes]]:
    """Each tree by itself, with its number of nodes: a leaf's shares are kept where they aren't 0, and inner nodes have none."""
    out = []
    owner = np.zeros(len(trees.feature), np.int64)
    owner[trees.root] = np.arange(len(trees.root))
    level = trees.root
    while len(level):
        level = level[trees.feature[level] >= 0]
        below = trees.left[level], trees.right[level]
        for side in below:
            owner[side] = owner[level]
        level = np.concatenate(below)
    k = trees.value.shape[1]
    for number in range(len(trees.root)):
        own = np.flatnonzero(owner == number)
        feature = trees.feature[own].astype(np.int32)
        inner = feature >= 0
        left = np.searchsorted(own, trees.left[own[inner]]).astype(np.int32)
        value = np.where(inner[:, None], 0.0, trees.value[own]).ravel()
        at = np.flatnonzero(value)
        head = np.array([len(own), k, len(left), len(at)], np.int64)
        parts = (head, feature, trees.threshold[own[inner]], left, at.astype(np.int64), value[at])
        out.append((len(own), zlib.compress(b"".join(p.tobytes() for p in parts), 1)))
    return out


def unpack(raw: bytes) -> Trees:
    raw, at = zlib.decompress(raw), 0

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, count, at)
        at += found.nbytes
        return found

    n, k, inner, shares = take(np.int64, 4).tolist()
    feature = take(np.int32, n).astype(np.int64)
    threshold, left, right, value = np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n * k)
    own = np.flatnonzero(feature >= 0)
    threshold[own] = take(np.float64, inner)
    left[own] = take(np.int32, inner)
    right[own] = left[own] + 1
    where = take(np.int64, shares)
    value[where] = take(np.float64, shares)
    return Trees(np.zeros(1, np.int64), feature, threshold, left, right, value.reshape(n, k))


PACKED = "fit int, number int, nodes int, tree binary"


def packed(fit: int, low: int, trees: Trees) -> pa.RecordBatch:
    """Rows of ``PACKED`` of the trees from number ``low`` on."""
    found = pack(trees)
    n = len(found)
    arrays = [pa.array([fit] * n, pa.int32()), pa.array(range(low, low + n), pa.int32()), pa.array([c for c, _ in found], pa.int32()), pa.array([raw for _, raw in found], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["fit", "number", "nodes", "tree"])


def grow_many(spark: SparkSession, table: Table, fits: list[Fit]) -> DataFrame:
    """All trees of all fits, a row for each (``PACKED``); write it before it is read twice."""
    held = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                yield packed(f, low, grow_block(held.value, fits[f], np.arange(low, high)))

    return _units(spark, fits, len(table.y)).mapInArrow(run, PACKED)


#: Blocks of trees as forests were saved before.
SCHEMA = "fit int, low int, root array<int>, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"


def read_trees(rows, classes: int) -> list[Trees]:
    """Blocks of trees from rows of ``SCHEMA``."""
    kinds = {"root": np.int64, "feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64}
    return [Trees(*(np.array(r[n], kind) for n, kind in kinds.items()), np.array(r["value"], float).reshape(-1, classes)) for r in rows]


def _arrow_rows(blocks: DataFrame) -> Iterator[dict[str, pa.Array]]:
    """Rows of ``SCHEMA`` as Arrow arrays: as lists of Python numbers they take about ten times the memory."""
    table = blocks.toArrow()
    for i in range(table.num_rows):
        yield {n: table[n][i].values for n in ("root", "feature", "threshold", "left", "right", "value")}


#: Bytes of trees, or of rows, that are sent to all executors at a time.
SENT = 64 << 20
PIECE = 1 << 10  # rows whose votes are added together


def votes_in_place(trees: DataFrame, classes: int, rows: DataFrame, features: str, name: str) -> DataFrame:
    """``rows`` with the sums of the class shares of ``trees``, which stay where they are written.

    Rows are written once and sent to the trees in slices of ``SENT`` bytes; a
    task holds a slice, its votes and the trees of one batch.
    """
    from .stored import written, written_in_slices

    spark = rows.sparkSession
    kept = written(rows.withColumn("_at", F.monotonically_increasing_id()), "voters")
    x = F.col(features).cast("array<double>")
    slices = max(1, -(-(kept.agg(F.sum(F.size(x) * 8)).first()[0] or 0) // SENT))
    own = kept.select("_at", x.alias("_x"), F.pmod(F.xxhash64("_at"), F.lit(slices)).alias("_slice"))

    def votes_of(number: int) -> Iterator[DataFrame]:
        found = own.where(F.col("_slice") == number).select("_at", "_x").toArrow().combine_chunks()
        n = found.num_rows
        points = found["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        held = spark.sparkContext.broadcast((found["_at"].to_numpy(), points))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            votes = None
            for batch in batches:
                for raw in batch.column(0):
                    v = unpack(raw.as_py()).votes(held.value[1])
                    votes = v if votes is None else votes + v
            if votes is not None:
                pieces = range(0, len(votes), PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array([votes[a : a + PIECE].tobytes() for a in pieces], pa.binary())], ["piece", "votes"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for a, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    v = np.frombuffer(raw.as_py())
                    sums[a] = sums[a] + v if a in sums else v
            for a, v in sums.items():
                at = held.value[0][a : a + PIECE]
                offsets = pa.array(np.arange(len(at) + 1) * classes, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.ListArray.from_arrays(offsets, pa.array(v))], ["_at", name])

        few = trees.select("tree").coalesce(4 * spark.sparkContext.defaultParallelism)
        yield few.mapInArrow(run, "piece int, votes binary").repartition("piece").mapInArrow(add, f"_at long, `{name}` array<double>")
        held.destroy()  # the votes are written by now

    found = (df for number in range(slices) for df in votes_of(number))
    votes = written_in_slices(found, "votes") if slices > 1 else [written(df, "votes") for df in found][0]
    return kept.join(votes, "_at").select(*rows.columns, name)


class ForestModel:
    """A grown forest: a written table of packed trees."""

    def __init__(self, trees: DataFrame, classes: int):
        self.trees, self.classes = trees, classes

    @staticmethod
    def fit(spark: SparkSession, table: Table, fit: Fit) -> ForestModel:
        from .stored import written

        return ForestModel(written(grow_many(spark, table, [fit]), "forest"), table.classes)

    def _groups(self) -> list[list[int]]:
        """Trees that are sent together."""
        sizes = self.trees.select("number", (F.col("nodes") * (32 + 8 * self.classes)).alias("bytes")).orderBy("number").collect()
        out, total = [[]], 0
        for r in sizes:
            if out[-1] and total + r["bytes"] > SENT:
                out.append([])
                total = 0
            out[-1].append(r["number"])
            total += r["bytes"]
        return out

    def add_votes(self, rows: DataFrame, features: str, name: str = "_votes") -> DataFrame:
        """``rows`` with the sums of the trees' class shares; few trees are sent to the rows, many stay where they are."""
        spark, k = rows.sparkSession, self.classes
        groups = self._groups()
        if len(groups) > 1:  # a chain of groups would have a Python process for each
            return votes_in_place(self.trees, k, rows, features, name)
        out = rows.select(F.struct("*").alias("_row"), F.col(features).cast("array<double>").alias("_x"), F.array_repeat(F.lit(0.0), k).alias(name))
        for group in groups:
            found = self.trees.where(F.col("number").isin(group)).orderBy("number").select("tree").toArrow()["tree"]
            held = spark.sparkContext.broadcast([unpack(raw.as_py()) for raw in found])

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
                    votes = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
                    for trees in held.value:
                        votes = votes + trees.votes(x)
                    offsets = pa.array(np.arange(batch.num_rows + 1) * k, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(votes.ravel()))], batch.schema.names)

            out = out.mapInArrow(run, out.schema)
        return out.select("_row.*", name)

    def save(self, path: str) -> None:
        self.trees.withColumn("classes", F.lit(self.classes)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        trees = spark.read.parquet(path)
        if "root" in trees.columns:
            return _repacked(trees)
        return ForestModel(trees.drop("classes"), trees.first()["classes"])


def _repacked(blocks: DataFrame) -> ForestModel:
    """A forest that was saved as blocks of trees (``SCHEMA``)."""
    from .stored import written

    k = blocks.first()["classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, low in enumerate(batch["low"].to_pylist()):
                for trees in read_trees([{n: batch[n][row].values for n in ("root", "feature", "threshold", "left", "right", "value")}], k):
                    yield packed(0, low, trees)

    return ForestModel(written(blocks.drop("classes").mapInArrow(run, PACKED), "forest"), k)
