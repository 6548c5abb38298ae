"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its number of distinct
   shingles, a 128-bit hash of its word sequence and its MinHash signature.
   Documents with equal sequences form a class; its smallest id stands for it.
2. Signatures are cut into bands.  Each bucket's smallest document is its
   leader and every other member a candidate partner of the leader.  Buckets
   are never expanded into pairs at this point.
3. Candidates are compared a batch of signature values at a time.  After each
   batch the posterior of the similarity (uniform prior) is looked up and the
   pair is dropped when the chance that it reaches the threshold is below
   ``miss_probability``.  What is left is verified on full shingle sets.
4. Verified links are contracted to components.  Only buckets that still hold
   several components can hide further links.  The documents that such buckets
   connect are dealt into blocks; a task takes a pair of blocks, keeps pairs
   that share a band, drops some by the same Bayesian test, verifies the others
   on full sets and returns links only.  No bucket is capped and no pairs of a
   group are emitted.  However the documents are dealt, a pair is compared where
   it shares a band and is in different components, and nowhere else.
5. The components of all verified links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import connected_components
from .storage import bounded_batches, materialize, small

BANDS, ROWS = 25, 5
BATCH = 25
MISS_PROBABILITY = 1e-6
BLOCK = 256
BLOCK_BYTES = 4 << 20
PAIRS = 256  # pairs of texts whose sets are made at once
BROADCAST_ROWS = 100_000  # clusters of more than a block (40 bytes each) that go to all executors
HEAVY = 1000  # a class of more than 1/HEAVY of the rows is heavy, so there are fewer than HEAVY
SEED = 91


@lru_cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(h: np.ndarray, row: np.ndarray, n_rows: int, values: int) -> np.ndarray:
    """MinHash values of each row's set: ``n_rows`` x ``values``; rows without a set keep the maximum."""
    out = np.full((values, n_rows), 0xFFFFFFFF, np.uint32)
    if len(h):
        x = (h >> np.uint64(32)).astype(np.uint32)
        y = h.astype(np.uint32)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rows = row[first]
        for k, (a, b) in enumerate(zip(*_multipliers(values), strict=True)):
            z = (x ^ b) * a
            z ^= z >> np.uint32(15)
            z += y
            z *= a
            out[k, rows] = np.minimum.reduceat(z, first)
    return np.ascontiguousarray(out.T)


@lru_cache
def least_matches(threshold: float, miss: float, values: int, batch: int) -> tuple[tuple[int, int], ...]:
    """For n = batch, 2 batch, ...: the fewest matches of n with which a pair stays.

    With m of n values equal and a uniform prior, the similarity's posterior is
    Beta(m + 1, n - m + 1); the pair stays while P(similarity >= threshold) is
    at least ``miss``.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in sorted({*range(batch, values, batch), values}):
        need = n + 1
        for m in range(n, -1, -1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() < miss * density.sum():
                break
            need = m
        out.append((n, need))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float, batch: int) -> np.ndarray:
    """Which rows of two aligned signature arrays pass every batch."""
    alive, equal, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, need in least_matches(threshold, miss, left.shape[1], batch):
        equal = equal + (left[alive, done:n] == right[alive, done:n]).sum(1)
        keep = equal >= need
        alive, equal, done = alive[keep], equal[keep], n
    return alive


def _matrix(column: pa.Array, values: int) -> np.ndarray:
    data, _ = _binary(column)
    return data.view(np.uint32).reshape(len(column), values)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, o, data = column.buffers()
    o = np.frombuffer(o, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8), o - o[0]


def profile(docs: DataFrame, shingle: int, values: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, seq_a, seq_b, sig, n_bytes`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.utf8(batch.column(1))
            for low, high in ta.chunks(offsets):
                n, o = high - low, offsets[low : high + 1] - offsets[low]
                d = data[offsets[low] : offsets[high]]
                starts, ends, row = ta.words(d, o)
                hashes = ta.word_hashes(d, starts, ends)
                seq_a, seq_b = ta.sequence_hashes(hashes, row, n)
                h, at = ta.distinct(*ta.shingles(hashes, row, n, shingle))
                sig = signatures(h, at, n, values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, n),
                        pa.array(np.bincount(at, minlength=n) if len(at) else np.zeros(n, np.int64), pa.int64()),
                        pa.array(seq_a.view(np.int64)),
                        pa.array(seq_b.view(np.int64)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.array(np.diff(o)),
                    ],
                    ["doc_id", "n_shingles", "seq_a", "seq_b", "sig", "n_bytes"],
                )

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, seq_a long, seq_b long, sig binary, n_bytes long")


def _bands(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """``bucket, doc_id``: one row per band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1), bands * per_band).astype(np.uint64)
            key = np.zeros((len(sig), bands), np.uint64)
            for k in range(per_band):
                key = ta.mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, k::per_band] + np.arange(1, bands + 1, dtype=np.uint64))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, bands))], ["bucket", "doc_id"])

    return rows.select("doc_id", "sig").mapInArrow(run, "bucket long, doc_id long")


def _bayes(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float, values: int) -> DataFrame:
    """Pairs ``a, b`` that the sequential test keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = survivors(_matrix(batch.column(2), values), _matrix(batch.column(3), values), threshold, miss, BATCH)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    # The leader first: its rows meet in one key of a plain join, the test's tasks get even ones.
    joined = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b"
    )
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    out = []
    data, offsets = ta.utf8(column)
    for low, high in ta.chunks(offsets):
        d, o = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, row = ta.words(d, o)
        h, at = ta.distinct(*ta.shingles(ta.word_hashes(d, starts, ends), row, high - low, shingle))
        out += np.split(h, np.searchsorted(at, np.arange(1, high - low)))
    return out


def _exact(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for low in range(0, batch.num_rows, PAIRS):
                left, right = (_sets(batch.column(c).slice(low, PAIRS), shingle) for c in (2, 3))
                for k, (x, y) in enumerate(zip(left, right, strict=True), low):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if common and 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of sets reach the threshold; each left set meets all its partners at once."""
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    good = np.zeros(len(left), bool)
    for low, high in zip(*_runs(left)):
        mine = sets[left[low]]
        for at in range(low, high, 512):
            others = [sets[k] for k in right[at : min(at + 512, high)]]
            sizes = np.array([len(x) for x in others])
            joined = np.concatenate(others)
            found = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
            common = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
            good[at : at + len(others)] = 100 * common >= percent * (len(mine) + sizes - common)
    return order[good]


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return [0, *cuts.tolist()] if len(sorted_values) else [], [*cuts.tolist(), len(sorted_values)] if len(sorted_values) else []


_UNIT = ["kind", "unit", "i", "j"]


def _share_band(left: np.ndarray, right: np.ndarray, per_band: int) -> np.ndarray:
    return (left == right).reshape(len(left), left.shape[1] // per_band, per_band).all(2).any(1)


def _within(members: DataFrame, shingle: int, threshold: float, percent: int, miss: float, bands: int, per_band: int) -> DataFrame:
    """Links between different components among the members of each unit that share a band.

    ``members``: kind, unit, i, j, side, doc_id, component_id, sig, text.  A
    group (kind, unit, i, j) holds two blocks; only pairs across the blocks
    count, or within the one block where i = j.  Only links leave the task.
    """

    values = bands * per_band

    def compare(rows: pa.Table) -> pa.RecordBatch:
        group = np.stack([rows.column(k).to_numpy() for k in _UNIT])
        side, doc, comp = (rows.column(k).to_numpy() for k in ("side", "doc_id", "component_id"))
        sig = _matrix(rows.column("sig").combine_chunks(), values)
        a, b = [], []
        for step in range(1, len(doc)):
            same = (group[:, step:] == group[:, :-step]).all(0)
            if not same.any():
                break
            at = np.flatnonzero(same & (comp[step:] != comp[:-step]) & ((side[step:] != side[:-step]) | (group[2, step:] == group[3, step:])))
            if len(at):
                at = at[survivors(sig[at], sig[at + step], threshold, miss, BATCH)]
                at = at[_share_band(sig[at], sig[at + step], per_band)]
                a.append(at)
                b.append(at + step)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a):
            needed, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets = _sets(rows.column("text").take(pa.array(needed)), shingle)
            good = _linked(sets, place[: len(a)], place[len(a) :], percent)
            a, b = doc[a[good]], doc[b[good]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            keys = np.stack([rows.column(k).to_numpy() for k in _UNIT])
            other = np.flatnonzero((keys != keys[:, -1:]).any(0))
            if len(other):
                yield compare(rows.slice(0, int(other[-1]) + 1).combine_chunks())
                rows = rows.slice(int(other[-1]) + 1)
            kept = rows
        if kept is not None:
            yield compare(kept.combine_chunks())

    return (
        members.repartition(*_UNIT).sortWithinPartitions(*_UNIT).select(*_UNIT, "side", "doc_id", "component_id", "sig", "text").mapInArrow(run, "a long, b long")
    )


def _residual(crowded: DataFrame, first: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of the units within which further links may hide, for :func:`_within`.

    A unit is a set of documents that buckets with several components connect.
    Where such a set is far larger than its largest bucket, each bucket is a
    unit instead.  Units are dealt into blocks of about ``BLOCK`` documents and
    ``BLOCK_BYTES`` of text.
    """
    labelled = crowded.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    labelled = materialize(labelled, "minhash-labelled")
    spread = labelled.groupBy("bucket").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi").select("bucket")
    mixed = materialize(labelled.join(spread, "bucket"), "minhash-mixed")
    clusters = connected_components(mixed, "leader", "doc_id").select(F.col("node").alias("doc_id"), F.col("component_id").alias("cluster"))
    placed = materialize(mixed.join(clusters, "doc_id").join(reps.select("doc_id", "n_bytes").distinct(), "doc_id"), "minhash-clusters")
    # Clusters that fill no more than a block need no numbers; the others are found after aggregation.
    members = placed.groupBy("cluster", "doc_id").agg(F.max("n").alias("most"), F.max("n_bytes").alias("n_bytes"))
    large = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.max("most").alias("most"), F.sum("n_bytes").alias("bytes")).where(f"docs > {BLOCK} or bytes > {BLOCK_BYTES}")
    loose = F.col("docs") > F.greatest(4 * F.col("most"), F.lit(BLOCK))
    large = materialize(large.select("cluster", loose.alias("loose"), _parts(F.col("docs"), F.col("bytes")).alias("in_cluster")), "minhash-large")
    few = small(large, BROADCAST_ROWS)
    known = placed.join(F.broadcast(large) if few else large, "cluster", "left")
    # Documents of a loose cluster once per bucket, of the others once.
    by_bucket = known.where("loose").select(F.lit(1).alias("kind"), F.col("bucket").alias("unit"), "doc_id", "component_id", "n_bytes")
    own = by_bucket.groupBy("unit").agg(_parts(F.count("*"), F.sum("n_bytes")).alias("parts")).where("parts > 1")
    own = materialize(own, "minhash-buckets-large")
    by_bucket = by_bucket.join(F.broadcast(own) if small(own, BROADCAST_ROWS) else own, "unit", "left")
    whole = known.where("not coalesce(loose, false)").select(F.lit(0).alias("kind"), F.col("cluster").alias("unit"), "doc_id", "component_id", F.col("in_cluster").alias("parts")).distinct()
    units = whole.unionByName(by_bucket.select(*whole.columns)).withColumn("parts", F.coalesce("parts", F.lit(1)))
    units = materialize(units, "minhash-units")
    return (
        units.join(reps.select("doc_id", "sig"), "doc_id")
        .join(texts, "doc_id")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("kind", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "doc_id", "component_id", "sig", "text")
    )


def _parts(docs: Column, size: Column) -> Column:
    """Blocks that documents of this number and size are dealt into."""
    return F.ceil(F.greatest(docs / BLOCK, size / BLOCK_BYTES, F.lit(1.0))).cast("int")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss_probability: float = MISS_PROBABILITY,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Two documents are linked when their sets of distinct ``shingle``-word runs
    have 100 * intersection >= ``percent`` * union; ``component_id`` is the
    smallest id reachable by links and ``kept`` marks it.  A pair at the
    threshold shares no band with a chance of (1 - t**rows)**bands (5e-5 at
    0.8; 4e-7 at 0.85), and is dropped by the sequential test with one of about
    ``miss_probability``.

    Null, empty and blank texts have an empty set and stay alone.  A text with
    fewer words than ``shingle`` is one shingle.  Repeated rows of one id and
    text have one component; rows of one id with different texts are documents
    of their own, each in its text's component.  Rows with a null id have no
    component and are not kept.  Other columns are ignored; an empty table gives
    an empty result.
    """
    values, threshold = bands * rows, percent / 100
    base = materialize(profile(docs, shingle, values, id_col, text_col), "minhash-profile")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    with_set = base.where("n_shingles > 0 and doc_id is not null")
    classes = with_set.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = materialize(
        with_set.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sig", "n_bytes").distinct(),
        "minhash-classes",
    )
    members = materialize(_bands(reps, bands, rows), "minhash-bands")
    leaders = members.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    crowded = materialize(members.join(leaders, "bucket"), "minhash-buckets")

    stars = crowded.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    rep_texts = texts.join(reps.select("doc_id"), "doc_id", "left_semi")
    kept = materialize(_bayes(stars, reps, threshold, miss_probability, values), "minhash-survivors")
    links = materialize(_exact(kept, _only(rep_texts, kept), shingle, percent), "minhash-links")
    first = materialize(connected_components(links, "a", "b"), "minhash-first")

    inside = _residual(crowded, first, reps, rep_texts)
    more = materialize(_within(inside, shingle, threshold, percent, miss_probability, bands, rows), "minhash-more-links")
    groups = first if more.isEmpty() else connected_components(first.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(more), "a", "b")
    groups = groups.select(F.col("node").alias("rep"), "component_id")

    # Only classes of several rows or in a group differ from their documents' own ids.
    of_class = classes.join(groups, "rep", "left").where("n > 1 or component_id is not null")
    of_class = materialize(of_class.select("seq_a", "seq_b", "n", F.coalesce("component_id", "rep").alias("component_id")), "minhash-groups")
    heavy = F.broadcast(of_class.where(F.col("n") * HEAVY > base.count()).select("seq_a", "seq_b", F.col("component_id").alias("heavy_id")))
    marked = base.select("doc_id", "n_shingles", "seq_a", "seq_b").join(heavy, ["seq_a", "seq_b"], "left")
    settled = F.col("doc_id").isNull() | (F.col("n_shingles") == 0) | F.col("heavy_id").isNotNull()
    done = marked.where(settled).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("heavy_id", "doc_id")).alias("component_id"))
    rest = marked.where(~settled).join(of_class.select("seq_a", "seq_b", "component_id"), ["seq_a", "seq_b"], "left")
    both = done.unionByName(rest.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _only(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return texts.join(needed, "doc_id", "left_semi").distinct()
