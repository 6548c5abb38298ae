"""Near-duplicate embeddings by sorted projection passes.

1. Vectors that are equal (and have equal labels) form a class, which its
   smallest id stands for.
2. In each pass every vector gets a key: the signs of its projections on
   ``BITS`` random directions, concatenated.  Vectors are range-partitioned and
   sorted by label and key, and each is compared with the ``window`` next ones.
   The ends of neighbouring partitions are compared in a second step.  A task
   hands on a spanning set of its verified links, not all pairs.
3. The links of all passes are united to components.
4. Links are counted exactly within each component: its members are dealt into
   blocks and a task multiplies two blocks, a slice at a time.  Groups of any
   size are counted in full; only counts leave the tasks.

Vectors travel as the input has them (32-bit floats, or doubles) and are
normalised in double precision where they are compared.

Two vectors with the cosine c agree in a bit with the chance p = 1 - acos(c)/pi,
so a pass finds a pair among n vectors of a label with a chance of about
p ** log2(n / window), if nothing else links the two.  As many passes are made
as leave such a pair at the threshold unfound with a chance of ``miss`` or less
in the largest label, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .components import connected_components
from .storage import materialize, small

COSINE = 0.93
PASSES = 16  # at least
MISS = 1e-4
WINDOW = 64
BITS = 62
ROWS_PER_PARTITION = 50_000
BLOCK, SLICE = 1024, 128
BROADCAST_ROWS = 100_000  # components of more than a block (20 bytes each) that go to all executors
HEAVY = 1000  # a class of more than 1/HEAVY of the rows is heavy, so there are fewer than HEAVY
SEED = 5


def passes_for(n: int, window: int, cosine: float, miss: float = MISS) -> int:
    """Passes after which an isolated pair at ``cosine`` among ``n`` vectors is unfound with a chance of about ``miss`` at most."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    found = agree ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if found >= 1 else max(PASSES, math.ceil(math.log(miss) / math.log1p(-found)))


def _directions(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, dim]).standard_normal((dim, BITS))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1, scaled first so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _by_length(raw: pa.Array, item: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and units of the vectors of each length in a column of bytes."""
    raw = raw.cast(pa.large_binary())
    _, o, data = raw.buffers()
    o = np.frombuffer(o, np.int64, len(raw) + 1, raw.offset * 8)
    sizes, data = np.diff(o), np.frombuffer(data, np.uint8)
    if len(sizes) and (sizes == sizes[0]).all():
        yield np.arange(len(sizes)), _units(data[o[0] : o[-1]].view(item).reshape(len(sizes), -1))
        return
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        grid = data[o[at][:, None] + np.arange(size)]
        yield at, _units(grid.reshape(-1).view(item).reshape(len(at), -1))


def _label_hashes(labels: pa.Array) -> np.ndarray:
    """A 64-bit hash of each label's text; null labels count as empty."""
    data, offsets = ta.utf8(labels)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    out = np.zeros(len(labels), np.uint64)
    out[some] = ta.word_hashes(data, offsets[:-1][some], offsets[1:][some], _PLAIN)
    return out


_PLAIN = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)


def _profile(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, hash_a, hash_b, unit``; ``unit`` (the vector's bytes) and hashes are null where nothing links."""
    item = _item(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, batch.column(2)
            offsets = column.offsets.to_numpy()
            values = column.values.fill_null(float("nan")).to_numpy().astype(item) if len(column.values) else np.zeros(0, item)
            some = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            sizes, of_label = np.diff(offsets), _label_hashes(batch.column(1))
            keys, good, units = np.zeros((2, n), np.uint64), np.zeros(n, bool), [None] * n
            for dim in np.unique(sizes[some & (sizes > 0)]).tolist():
                at = np.flatnonzero(some & (sizes == dim))
                whole = len(at) == n
                x = values[offsets[0] : offsets[-1]].reshape(n, dim) if whole else values[offsets[at][:, None] + np.arange(dim)]
                x = x + np.array(0, item)  # no negative zeros
                top = np.abs(x).max(1)
                at, x = at[np.isfinite(top) & (top > 0)], x[np.isfinite(top) & (top > 0)]
                bits = x.astype(np.float64).view(np.uint64)
                for k, salt in enumerate((0x51ED270B, 0xA3C59AC3)):
                    h = ta.mix(of_label[at] + np.uint64(salt + dim))
                    for j in range(dim):
                        h = ta.mix(h * np.uint64(0xD6E8FEB86659FD93) + bits[:, j])
                    keys[k, at] = h
                good[at] = True
                packed, width = x.tobytes(), dim * x.itemsize
                for k, row in enumerate(at.tolist()):
                    units[row] = packed[k * width : (k + 1) * width]
            cells = [pa.array(keys[k].view(np.int64), mask=~good) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cells, pa.array(units, pa.binary())], ["vec_id", "label", "hash_a", "hash_b", "unit"])

    narrow = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast(_floats(vectors, vector_col)))
    return narrow.mapInArrow(run, "vec_id long, label string, hash_a long, hash_b long, unit binary")


def _item(vectors: DataFrame, vector_col: str) -> str:
    return "<f4" if _floats(vectors, vector_col) == "array<float>" else "<f8"


def _floats(vectors: DataFrame, vector_col: str) -> str:
    kind = vectors.schema[vector_col].dataType
    return "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"


def _keys(reps: DataFrame, passes: int, item: str) -> DataFrame:
    """One row per vector and pass: ``pass, label, dim, key, vec_id, unit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column(2), item) if batch.num_rows else ():
                ids, label, unit = (batch.column(c).take(pa.array(at)) for c in (0, 1, 2))
                n, dim = x.shape
                for number in range(passes):
                    signs = np.einsum("nd,db->nb", x, _directions(number, dim)) > 0
                    key = (signs.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number, np.int32)), label, pa.array(np.full(n, dim, np.int32)), pa.array(key), ids, unit], ["pass", "label", "dim", "key", "vec_id", "unit"]
                    )

    return reps.select("vec_id", "label", "unit").mapInArrow(run, "pass int, label string, dim int, key long, vec_id long, unit binary")


def _spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, root) that connect what the links a[k] - b[k] connect."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _compare(keys: list[str], window: int, cosine: float, ends: bool, item: str):
    """Links among neighbours of sorted rows; with ``ends`` also the first and last rows of the partition."""
    names = ["kind", "boundary", "pass", "label", "dim", "key", "vec_id", "other", "unit"]

    def links(rows: pa.Table, fresh_from: int) -> pa.RecordBatch:
        ids = rows.column("vec_id").to_numpy()
        group = np.zeros(len(ids), bool)
        for k in keys:
            values = rows.column(k).to_numpy() if k != "label" else rows.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            group[1:] |= values[1:] != values[:-1]
        group = np.cumsum(group)
        found_a, found_b = [], []
        for at, x in _by_length(rows.column("unit").combine_chunks(), item):
            for step in range(1, min(window, len(at) - 1) + 1):
                near = np.flatnonzero((group[at[step:]] == group[at[:-step]]) & (at[step:] >= fresh_from))
                if len(near):
                    good = near[np.einsum("ij,ij->i", x[near], x[near + step]) >= cosine]
                    found_a.append(at[good])
                    found_b.append(at[good + step])
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        left, right = _spanning(ids, a, b)
        n = len(left)
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int32(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), *none, pa.array(left), pa.array(right), pa.nulls(n, pa.binary())], names)

    def edge(rows: pa.Table, boundary: int) -> pa.RecordBatch:
        n = rows.num_rows
        cells = [rows.column(k).combine_chunks() for k in ("pass", "label", "dim", "key", "vec_id")]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.full(n, boundary, np.int64)), *cells, pa.nulls(n, pa.int64()), rows.column("unit").combine_chunks()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept: pa.Table | None = None
        head: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            fresh = 0
            if kept is not None:
                fresh = kept.num_rows
                rows = pa.concat_tables([kept, rows])
            if head is None or head.num_rows < window:
                head = rows.slice(0, window) if fresh == 0 or head is None else pa.concat_tables([head, rows.slice(fresh)]).slice(0, window)
            yield links(rows, fresh)
            kept = rows.slice(max(0, rows.num_rows - window))
        if ends and kept is not None:
            here = TaskContext.get().partitionId()
            yield edge(head, here - 1)
            yield edge(kept, here)

    return run


_OUT = "kind int, boundary long, pass int, label string, dim int, key long, vec_id long, other long, unit binary"


_GROUP = ["component_id", "i", "j"]


def _counts(members: DataFrame, cosine: float, item: str) -> DataFrame:
    """``vec_id, n``: vectors (copies counted) that each member links to across its group's blocks."""

    def count(rows: pa.Table) -> pa.RecordBatch:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        side, ids, copies = (rows.column(c).to_numpy() for c in ("side", "vec_id", "copies"))
        links = np.zeros(len(ids), np.int64)
        for at, x in _by_length(rows.column("unit").combine_chunks(), item):
            left, right = (np.flatnonzero(side[at] == k) for k in (i, j))
            for low in range(0, len(left), SLICE):
                own = left[low : low + SLICE]
                near = np.einsum("ik,jk->ij", x[own], x[right]) >= cosine
                if i == j:
                    near[np.arange(len(own)), np.searchsorted(right, own)] = False
                links[at[own]] += (near * copies[at[right]]).sum(1)
                if i != j:
                    links[at[right]] += (near * copies[at[own], None]).sum(0)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["vec_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in _GROUP])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield count(rows.slice(low, high - low))
            kept = rows.slice(int(cuts[-1]))
        if kept is not None:
            yield count(kept)

    laid = members.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return laid.select(*_GROUP, "side", "unit", "vec_id", "copies").mapInArrow(run, "vec_id long, n long")


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    passes: int | None = None,
    window: int = WINDOW,
    miss: float = MISS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors are compared when their labels are equal and not null and their
    lengths are equal, by the cosine in double precision.  Vectors that are
    null, empty or zero, or hold null or non-finite components, link with
    nothing.  ``n_links``: other vectors linked directly; ``component_id``: the
    smallest id reachable by links; ``kept``: whether it is the vector's own.
    Rows with equal ids share one component, and the links of their vectors
    count for all of them; those with a null id link with nothing and have no
    component.
    Other columns are ignored; an empty table gives an empty result.
    ``passes`` follow from the largest label's size and ``miss`` where not given.
    """
    item = _item(vectors, vector_col)
    base = materialize(_profile(vectors, id_col, vector_col, label_col), "vec-profile")
    valid = base.where("unit is not null and vec_id is not null")
    classes = valid.groupBy("hash_a", "hash_b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "vec-classes")
    reps = valid.join(classes.select(F.col("rep").alias("vec_id"), "hash_a", "hash_b", "copies"), ["vec_id", "hash_a", "hash_b"]).dropDuplicates(["vec_id", "hash_a", "hash_b"])
    reps = materialize(reps.select("vec_id", "label", "unit", "copies"), "vec-reps")
    total, largest = reps.groupBy("label", F.length("unit")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    passes = passes_for(largest, window, cosine, miss) if passes is None else passes
    n = max(1, -(-total * passes // ROWS_PER_PARTITION))
    order = ["pass", "label", "dim", "key", "vec_id"]
    group = ["pass", "label", "dim"]
    laid = _keys(reps, passes, item).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialize(laid.select(*order, "unit").mapInArrow(_compare(group, window, cosine, n > 1, item), _OUT), "vec-links")
    links = found.where("kind = 0").select("vec_id", "other")
    if n > 1:
        ends = found.where("kind = 1").select("boundary", *order, "unit")
        ends = ends.repartition("boundary").sortWithinPartitions("boundary", *order)
        links = links.unionByName(ends.mapInArrow(_compare(["boundary", *group], window, cosine, False, item), _OUT).select("vec_id", "other"))
    groups = materialize(connected_components(links, "vec_id", "other").withColumnRenamed("node", "vec_id"), "vec-groups")

    # Most components fill no block; those that fill several are found after aggregation.
    large = groups.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    large = materialize(large, "vec-large")
    members = (
        groups.join(F.broadcast(large) if small(large, BROADCAST_ROWS) else large, "component_id", "left")
        .join(reps, "vec_id")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("component_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "unit", "vec_id", "copies")
    )
    counts = _counts(members, cosine, item).groupBy("vec_id").agg(F.sum("n").alias("n"))
    of_class = materialize(
        classes.join(groups.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .where("copies > 1 or component_id is not null")
        .select("hash_a", "hash_b", "copies", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "vec-classes-done",
    )
    keys = ["hash_a", "hash_b"]
    heavy = F.broadcast(of_class.where(F.col("copies") * HEAVY > base.count()).select(*keys, F.col("component_id").alias("heavy_id"), F.col("n_links").alias("heavy_links")))
    marked = base.select("vec_id", *keys).join(heavy, keys, "left")
    named = F.col("vec_id").isNotNull()
    settled = F.col("hash_a").isNull() | F.col("heavy_id").isNotNull() | ~named
    done = marked.where(settled).select("vec_id", F.when(named, F.col("heavy_links")).alias("n_links"), F.when(named, F.col("heavy_id")).alias("component_id"))
    rest = marked.where(~settled).join(of_class.select(*keys, "n_links", "component_id"), keys, "left").select("vec_id", "n_links", "component_id")
    return (
        done.unionByName(rest)
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
