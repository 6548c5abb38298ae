"""Operators over whole tables against brute force, with hot groups, nulls, repeats and empty tables."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import components, decontaminate, embedding_dedup, minhash, quality, queries, sharding, storage, toxicity

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_sets(texts, size):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    return out


def brute_groups(texts, size):
    """All pairs that share a shingle."""
    sets, own = shingle_sets(texts, size), Sets(texts)
    holders = defaultdict(list)
    for i in sorted(sets):
        for j, c in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                own.join(i, j)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), own.find(i)) for i in texts}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (None, 3)]
    own = Sets({x for p in pairs for x in p if x is not None})
    for a, b in pairs:
        if a is not None and b is not None:
            own.join(a, b)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component_id"] for r in components.connected_components(df, "a", "b").collect()}
    want = {x: own.find(x) for p in pairs if None not in p for x in p}
    assert got == want


def test_components_take_few_shuffles(spark, monkeypatch):
    """Three shuffles a round: each is as many tasks as there are shuffle partitions, however few the links."""
    shuffles = []

    def counted(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return storage.materialize(df, name)

    monkeypatch.setattr(components, "materialize", counted)
    pairs = [(k, 3000 + k % 7) for k in range(200)] + [(3000 + k, 3001 + k) for k in range(6)] + [(5000, 5001)] * 3
    got = {r["node"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: 5000 if x >= 5000 else 0 for p in pairs for x in p}
    assert sum(shuffles) <= 2 * 7, shuffles


def test_components_of_chains_loops_and_nothing(spark):
    """Long chains in odd orders, cliques with repeated links, a node with itself alone, and no links."""
    rng = random.Random(7)
    ids = rng.sample(range(-5000, 5000), 600)
    pairs = [*zip(ids[:500], ids[1:501]), *((a, b) for a in ids[520:540] for b in ids[520:540]), (ids[550], ids[550]), (None, ids[560])]
    own = Sets({x for p in pairs for x in p if x is not None})
    for a, b in pairs[:-1]:
        own.join(a, b)
    df = spark.createDataFrame(pairs + pairs, "a long, b long")
    rows = components.connected_components(df, "a", "b").collect()
    assert sorted((r["node"], r["component_id"]) for r in rows) == sorted((x, own.find(x)) for x in {x for p in pairs[:-1] for x in p})
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def near_copies(seed, groups, words=60):
    """Groups of near copies around the threshold, exact copies, short, empty and null texts."""
    rng = random.Random(seed)
    texts, n = {}, 0
    for size, edits in groups:
        base = [f"w{rng.randrange(9999)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(words)] = f"e{rng.randrange(9999)}"
            texts[n] = "  ".join(w).upper() if rng.random() < 0.3 else " ".join(w)
            n += 1
    for t in ("a", "A", "a b", "b a", "", None, " \n", "c d e", "c d e", "x y " * 400):
        texts[n] = t
        n += 1
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_against_all_pairs(spark, size):
    texts = near_copies(size, [(40, 0), (300, 5), (60, 3), (30, 9), *[(2, 4)] * 40])
    df = spark.createDataFrame([(i, t, 1, "s", 3) for i, t in texts.items()] + [(None, "a b", 1, "s", 3)], "doc_id long, text string, bucket int, sig string, n int")
    rows = minhash.near_duplicates(df, shingle=size).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == brute_groups(texts, size)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_blocks_and_loose_units(spark, monkeypatch):
    """Small blocks, so that units fall into many and a chain of buckets is split."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = near_copies(11, [(90, 6), (50, 7), (25, 8)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert got == brute_groups(texts, 2)


def test_sequential_test_keeps_similar_pairs():
    steps = minhash.least_matches(0.8, 1e-6, 125, 25)
    assert [n for n, _ in steps] == [25, 50, 75, 100, 125] and all(m < 0.8 * n for n, m in steps)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (4000, 125), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.82, a, a + np.uint32(1))
    c = np.where(rng.random(a.shape) < 0.3, a, a + np.uint32(1))
    assert len(minhash.survivors(a, b, 0.8, 1e-6, 25)) == 4000 and len(minhash.survivors(a, c, 0.8, 1e-6, 25)) == 0


def brute_vectors(rows):
    own, links = Sets([r[0] for r in rows]), Counter()
    good = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for k, (i, l, v) in enumerate(good):
        for j, m, w in good[:k]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                own.join(i, j)
                links[i] += 1
                links[j] += 1
    return {i: (links[i], own.find(i)) for i, _, _ in rows}


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_PARTITION", 1500)  # several partitions, so that their ends meet
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "SLICE", 5)
    rng = np.random.default_rng(4)
    rows = []
    for label, size in ((0, 150), (1, 40), (2, 3), (2, 2)):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(x) for x in np.float32(centre + 0.12 * rng.standard_normal(16))], label) for k in range(size)]
    rows += [(len(rows) + k, [float(x) for x in np.float32(rng.standard_normal(16))], k % 4) for k in range(200)]
    rows += [(1000 + k, rows[3][1], 0) for k in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [None] * 16, 0), (2005, rows[0][1], None), (2006, rows[0][1][:8], 0), (2007, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, n int, unit string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_equal_ids_and_doubles(spark):
    """Rows of one id share its component and links; large and tiny doubles don't overflow."""
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.0, 2.0], "a"), (0, [1e300, 1e280], "a"), (5, [1e-300, 0.0], "b"), (6, [3e-310, 0.0], "b"), (7, [-0.0, 1.0], "b"), (8, [0.0, 1.0], "b"), (9, [1.0], "b"), (None, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    want = [(False, 1, 2, 0), (False, 1, 2, 0), (False, 2, 1, 0), (False, 0, 1, 0), (False, 5, 1, 5), (False, 6, 1, 5), (False, 7, 1, 7), (False, 8, 1, 7), (False, 9, 0, 9), (True, 0, 0, None)]
    assert got == sorted(want)


def test_embedding_passes_follow_the_largest_label(spark):
    for n in (1, 5_000, 50_000, 1_000_000, 30_000_000):
        found = (1 - np.arccos(0.93) / np.pi) ** max(0, np.log2(n / 64))
        assert (1 - found) ** embedding_dedup.passes_for(n, 64, 0.93) <= 1.01e-4
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, 32))
    y -= (y * x[:600]).sum(1, keepdims=True) * x[:600]
    y = 0.931 * x[:600] + np.sqrt(1 - 0.931**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.r_[x, y])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(df, window=4).where("vec_id >= 6000").collect()}
    assert got == {6000 + k: k for k in range(600)}


def brute_items(texts, items):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    weight = lambda s: sum(len(w.encode()) for w in s)
    found = {}
    for i, t in items.items():
        w = words(t)
        size = min(5, len(w))
        if not w:
            continue
        a = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        for d, text in texts.items():
            v = words(text)
            own = min(size, len(v))
            s = [tuple(v[k : k + own]) for k in range(len(v) - own + 1)] if v else []
            n = len(w) - size + 1
            for k in range(max(1, len(s) - n + 1)):
                b = Counter(s[k : k + n])
                keys = set(a) | set(b)
                j = sum(min(a[x], b[x]) * weight(x) for x in keys) / sum(max(a[x], b[x]) * weight(x) for x in keys)
                if b and j >= 0.8 and j > found.get((d, i), 0):
                    found[d, i] = j
    return found


def test_decontamination_against_all_windows(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    items = {k: " ".join(word() for _ in range(rng.choice([6, 12, 30, 31, 50]))) for k in range(12)}
    items |= {50: "unseen pair", 51: "", 52: None, 53: items[0], 54: "solo"}
    texts = {k: " ".join(word() for _ in range(rng.randrange(1, 120))) for k in range(60)}
    for k in range(20, 50):
        t = items[k % 12].split()
        if k % 3 == 0:
            t[-1] += "."
        texts[k] = f"{texts[k]} {' '.join(t)} {texts[k]}".upper() if k % 2 else " ".join(t)
    texts |= {100: None, 101: "", 102: "an unseen pair here", 103: texts[20], 104: "w1 " * 20_000, 105: "solo"}
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, size int, content string")
    bench = spark.createDataFrame([(k, t, 7) for k, t in items.items()], "item_id long, text string, start int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(docs, bench).collect()}
    want = brute_items(texts, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    flags = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag(docs, bench).collect()}
    assert flags == {d: any(x == d for x, _ in want) for d in texts}
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.flag(docs, bench.limit(0)).collect()} == {False}


def test_long_items_in_repetitive_texts(spark, monkeypatch):
    """A long item with changed words in a text that repeats it; windows are laid out in slices."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(3000)}" for _ in range(600)]
    near = [w if k % 60 else "x" for k, w in enumerate(words)]
    items = {1: " ".join(words), 2: "la " * 40}
    texts = {1: " ".join([*near, *words[:300], *near, "tail"]), 2: "la " * 5000, 3: " ".join(words[:200])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "CELLS", 5000)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(docs, bench).collect()}
    want = brute_items(texts, items)
    assert set(got) == set(want) == {(1, 1), (2, 2)} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_fingerprints_within_the_radius_share_a_block():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(bit)
        assert any((a ^ b) >> (8 * k) & 255 in decontaminate._NEAR for k in range(8))
    assert len(decontaminate._NEAR) == 37 and max(bin(m).count("1") for m in decontaminate._NEAR) == 2


def test_minimum_cost_flow():
    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        supply = [rng.randrange(50) for _ in range(n)]
        capacity = sharding.equal_capacities(sum(supply), m)
        flow = sharding.minimum_cost_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply and [sum(r[j] for r in flow) for j in range(m)] == capacity
        moved = sum(flow[i][j] for i in range(n) for j in range(m) if i != j)
        assert moved == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))
    with pytest.raises(ValueError):
        sharding.minimum_cost_flow([3], [1, 1])


def test_room_that_makes_shards_equal():
    rng = random.Random(3)
    for _ in range(200):
        loads, total = [rng.randrange(40) for _ in range(rng.randrange(1, 8))], rng.randrange(200)
        room = sharding.fill(loads, total)
        after = [a + b for a, b in zip(loads, room)]
        assert sum(room) == total and min(room) >= 0 and all(b == 0 or a <= min(after) + 1 for a, b in zip(after, room))


def check_plan(rows, texts, shards):
    """Every row once, gapless slots, its own size; returns the shards of each text and the bytes of each shard."""
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in texts)
    text = dict(texts)
    sizes, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = text[r["doc_id"]]
        assert r["size"] == 8 + len((t or "").encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(shards))
    return of_text, sizes


def test_resharding_and_rewriting(spark, tmp_path):
    rng = random.Random(6)
    texts = ["copy " * 20] * 700 + ["é" * rng.randrange(300) for _ in range(1300)] + [None, None, "", ""]
    docs = spark.createDataFrame([(k, t, 9, 9) for k, t in enumerate(texts)], "doc_id long, text string, size int, shard int")
    rows = sharding.reshard(sharding.measure(docs, old_shards=5), 8, blocks=16).collect()
    of_text, sizes = check_plan(rows, list(enumerate(texts)), 8)
    share = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 608
    assert all(len(s) == 1 for t, s in of_text.items() if t != texts[0]) and len(of_text[texts[0]]) <= -(-700 * 108 // (share // 4))
    plan = spark.createDataFrame(rows)
    written = sharding.rewrite(docs, plan, str(tmp_path / "d"), file_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "d"))
    assert written == list(range(8)) and back.count() == len(texts)
    assert len(list((tmp_path / "d").glob("shard=*/*.parquet"))) > 8
    assert sharding.reshard(sharding.measure(docs.limit(0)), 8).count() == 0
    still = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 1, 0)], "doc_id long, old int, shard int, slot long")
    assert sharding.rewrite(docs, still, str(tmp_path / "e")) == []


def test_resharding_moves_as_little_as_the_flow(spark):
    """Groups of one row each, small against a shard: what moves is what the flow moves, but for the cuts."""
    rng = random.Random(1)
    texts = [(k, f"{k} " + "x" * rng.randrange(60)) for k in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    place = F.when(F.col("doc_id") < 2000, F.lit(0)).otherwise(F.lit(1))
    rows = sharding.reshard(sharding.measure(docs, old=place), 4, blocks=8).collect()
    check_plan(rows, texts, 4)
    old, total = Counter(), sum(r["size"] for r in rows)
    for r in rows:
        old[r["old"]] += r["size"]
    least = total - sum(min(old[k], total / 4) for k in range(4))
    assert abs(sum(r["size"] for r in rows if r["old"] != r["shard"]) - least) <= 4 * 80


def test_resharding_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 3 + [(1, None), (2, "a"), (None, "b")], "doc_id long, text string")
    rows = sharding.reshard(sharding.measure(docs), 2, whole=1).collect()
    assert len(rows) == 6 and len({(r["shard"], r["slot"]) for r in rows}) == 6


@needs_tables
def test_resharding_of_whole_tables(spark):
    rows = queries.op10_sharding(spark, FOLDER).collect()
    texts = [(r["doc_id"], r["text"]) for r in queries._table(spark, FOLDER, "documents").collect()]
    of_text, sizes = check_plan(rows, texts, 24)
    assert all(len(s) == 1 for s in of_text.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(2 * sum(sizes.values()) / 24 / sharding.FINE, max(r["size"] for r in rows) / 8)


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = queries._table(spark, FOLDER, "documents"), queries._table(spark, FOLDER, "labels")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 200_000)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [d for d in truth if d in rows and rows[d]["held_out"]]
    assert np.mean([rows[d]["predicted"] == truth[d] for d in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in rows.items() if r["predicted"]}
    assert {r["score"] for r in quality.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def plain_statistics(t):
    """The statistics of one text, counted one by one."""
    raw = t.encode()
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    w = re.findall(rb"[^\x20\x09-\x0d]+", low)
    own = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    symbols, marks = set(b"#$%&*+/<=>@[\\]^_`{|}~"), set(b"!?")
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    size, some = sum(map(len, w)), max(len(w), 1)
    chars, letters = max(size, 1), max(sum(map(letter, raw)), 1)
    runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []
    n_runs = max(len(runs), 1)
    share = lambda x, of: np.log(x / of + 1e-3)
    return [
        np.log1p(len(w)), np.log(size / some + 1), share(len(set(w)), some), share(sum(a == b for a, b in zip(w, w[1:])), some),
        share(n_runs - max(len(set(runs)), 1), n_runs), share(max(Counter(w).values(), default=0), some), share(sum(65 <= c <= 90 for c in raw), letters),
        share(sum(c in symbols for c in raw), chars), share(sum(c in marks for c in raw), chars), share(sum(48 <= c <= 57 for c in raw), chars),
        share(sum(all(c in symbols for c in x) for x in own), some), share(sum(x[-1] in symbols | marks for x in own), some), share(raw.count(b"."), some),
        share(raw.count(b"\n"), some), share(sum(c >= 128 for c in raw), chars)]


@needs_tables
def test_quality_query_against_brute_force(spark):
    docs, labels = (queries._table(spark, FOLDER, n).collect() for n in ("documents", "labels"))
    x = {r["doc_id"]: plain_statistics(r["text"] or "") for r in docs}
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    train = [(x[r["doc_id"]], r["quality"]) for r in labels if r["doc_id"] in x and r["quality"] is not None and not out(r["doc_id"])]
    a, y = np.array([v for v, _ in train]), np.array([q for _, q in train])
    scatter = [np.cov(a[y == k].T, bias=True) for k in (0, 1)]
    pooled, densities = sum(s * (y == k).mean() for k, s in enumerate(scatter)), []
    for k in (0, 1):
        cov = 0.7 * scatter[k] + 0.3 * pooled
        cov = 0.95 * cov + 0.05 * (np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
        inverse, mean, log_det = np.linalg.inv(cov), a[y == k].mean(0), np.linalg.slogdet(cov)[1]
        densities.append(lambda v, i=inverse, m=mean, d=log_det: -0.5 * ((v - m) @ i @ (v - m) + d))
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, FOLDER).collect()}
    assert set(got) == set(x) and all(r["held_out"] == out(d) and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    difference = {d: densities[1](np.array(v)) - densities[0](np.array(v)) for d, v in x.items()}
    model = quality.train(quality.features(queries._table(spark, FOLDER, "documents")), quality.training_sample(queries._table(spark, FOLDER, "labels")))
    for d, r in got.items():
        want = 1 / (1 + np.exp(-np.clip(model.slope * np.arcsinh(difference[d]) + model.intercept, -30, 30)))
        assert abs(r["score"] - want) < 1e-6
    assert model.slope > 0


@needs_tables
def test_classifiers_on_odd_rows(spark):
    """Repeated rows, clashing column names, null ids, texts and labels; no rows."""
    docs, labels = queries._table(spark, FOLDER, "documents").select("doc_id", "text"), queries._table(spark, FOLDER, "labels")
    odd = spark.createDataFrame([(-1, None), (-1, None), (-2, ""), (None, "a text")], "doc_id long, text string")
    more = docs.unionByName(odd).unionByName(docs.orderBy("doc_id").limit(3)).withColumn("y", F.lit(1)).withColumn("score", F.lit("x")).withColumn("x", F.lit(2)).withColumn("h", F.lit(0))
    labels = labels.unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1)], labels.schema)).withColumn("text", F.lit("clash")).withColumn("x", F.lit(1))
    rows = quality.classify(more, labels).collect()
    assert len(rows) == more.count() and len({r["score"] for r in rows if r["doc_id"] == -1}) == 1
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    kept = quality.keep_good(more, labels)
    assert kept.columns == more.columns and kept.count() <= more.count()
    model = toxicity.train(more, labels)
    graded = toxicity.score(more, model).collect()
    assert len(graded) == more.count() and {(r["toxic"], r["grade"]) for r in graded if r["doc_id"] in (-1, -2)} == {(0, 0)}
    assert toxicity.score(more.limit(0), model).count() == 0


@needs_tables
def test_toxicity_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in queries._table(spark, FOLDER, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in queries._table(spark, FOLDER, "labels").collect() if r["toxic"] is not None}

    def features(text):
        raw = text.encode().lower()  # A-Z
        raw = re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes([0xC3, m[0][1] + 0x20]), raw)
        w = re.findall(rb"[a-z\x80-\xff]+", raw)
        return [(x, 0) for x in w] + [(x[:k], 1) for k in toxicity.BEGINNINGS for x in w if len(x) > k], len(w)

    found = {d: features(t) for d, t in docs.items()}
    train = sorted(d for d in labels if d in docs and zlib.crc32(str(d).encode()) % 5)
    n, t = Counter(), Counter()
    for d in train:
        for f in set(found[d][0]):
            n[f] += 1
            t[f] += labels[d]
    toxic = sum(labels[d] for d in train)
    z = {}
    for f in n:
        a, b = t[f] + 0.5, n[f] - t[f] + 0.5
        z[f] = (np.log(a / (toxic + 1 - a)) - np.log(b / (len(train) - toxic + 1 - b))) / np.sqrt(1 / a + 1 / b) if t[f] >= 5 else 0
    vocabulary = sorted(f for f in n if z[f] > 2)
    assert 0 < len(vocabulary) < toxicity.FEATURES

    def row(d):
        c = Counter(found[d][0])
        counts = [c[f] for f in vocabulary]
        return np.log1p([*counts, 1000 * sum(counts) / max(found[d][1], 1)])

    def spread(d):
        own = [set(features(x)[0]) for x in re.split(r"[.!?\n]", docs[d])]
        own = [x for x in own if x]
        return sum(bool(x & set(vocabulary)) for x in own) / max(len(own), 1)

    x = np.array([row(d) for d in train])
    share = np.array([spread(d) for d in train]).astype(np.float32).astype(float)
    marked = np.array([labels[d] == 1 for d in train])
    grade = np.where(marked, 1 + (share > np.median(share[marked])), 0)
    weights, cuts = toxicity.fit_ordinal(x.astype(np.float32).astype(float), grade)
    for r in queries.op9_toxicity(spark, FOLDER).collect():
        below = 1 / (1 + np.exp(-np.clip(cuts - row(r["doc_id"]) @ weights, -40, 40)))
        assert abs(r["severity"] - (1 - below).sum()) < 1e-3 and r["toxic"] == int(1 - below[0] >= 0.5)


def test_discriminant_distances():
    rng = np.random.default_rng(2)
    x = np.r_[rng.standard_normal((300, 3)), rng.standard_normal((200, 3)) * 2 + 3]
    y = np.r_[np.zeros(300, int), np.ones(200, int)]
    model = quality.Discriminant.fit(x, y, to_pooled=0.2, to_unit=0.1)
    logs = []
    for mean, factor in zip(model.means, model.factors):
        cov = factor @ factor.T
        d = x - mean
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0])
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = queries._table(spark, folder, "documents"), queries._table(spark, folder, "labels")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 100_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.score(docs.select("doc_id", "text").unionByName(odd), model).collect()}
    held = [(r["doc_id"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    hit = [rows[d]["toxic"] for d, t in held if t == 1]
    false = [rows[d]["toxic"] for d, t in held if t == 0]
    assert np.mean(hit) >= 0.85 and np.mean(false) <= 0.02
    assert all(rows[d]["toxic"] == 0 for d in (-1, -2, -3))
    assert all(abs(r["severity"]) <= 2 and r["grade"] in (0, 1, 2) for r in rows.values())
    assert toxicity.train(docs.limit(0), labels) is None and {r["severity"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 2))
    grade = np.digitize(2 * x[:, 0] + 0.3 * rng.logistic(size=600), [-1, 1])
    weights, cuts = toxicity.fit_ordinal(x, grade)
    assert weights[0] > 1 > abs(weights[1]) and cuts[0] < cuts[1]


@pytest.fixture(scope="module")
def pipeline_rows(spark):
    return pytest.importorskip("corpus_pipeline").run(spark, "/root/testdata/sf0.001").collect()


@needs_tables
def test_pipeline_stages(spark, pipeline_rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = queries._table(spark, folder, "documents")
    labels, bench = queries._table(spark, folder, "labels"), queries._table(spark, folder, "benchmark")
    stage = [f for _, f in pipeline.STAGES]
    good = stage[0](spark, docs, folder)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"]}
    one = stage[1](spark, good, folder).collect()
    groups = brute_groups({r["doc_id"]: r["text"] for r in good.collect()}, 5)
    assert {r["doc_id"] for r in one} == {i for i, (_, c) in groups.items() if i == c}
    kept = stage[2](spark, spark.createDataFrame(one, docs.schema), folder).collect()
    held = brute_items({r["doc_id"]: r["text"] for r in one}, {r["item_id"]: r["text"] for r in bench.collect()})
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in one} - {d for d, _ in held}
    clean = stage[3](spark, spark.createDataFrame(kept, docs.schema), folder)
    assert clean.columns == docs.columns and clean.count() == len(kept)
    assert clean.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0
    last = stage[4](spark, clean, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last) and len(last) == len(kept)
    assert sorted(map(tuple, pipeline_rows)) == sorted(map(tuple, last))


@needs_tables
def test_pipeline_on_odd_rows(spark, pipeline_rows, tmp_path):
    """Repeated rows and ids, nulls, empty texts, an extra column; then no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        queries._table(spark, folder, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = queries._table(spark, folder, "documents")
    twice = docs.orderBy("doc_id").limit(40)
    odd = spark.createDataFrame([(-5, None), (-6, ""), (None, "one text without an id"), (None, None)], "doc_id long, text string")
    rows = docs.unionByName(twice).unionByName(twice).withColumn("sig", F.lit("clash")).unionByName(odd, allowMissingColumns=True)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    once = {r["doc_id"]: r["n_tokens"] for r in pipeline_rows}
    done = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in done if r["doc_id"] in once} == once
    assert len([r for r in done if r["doc_id"] is not None and r["doc_id"] >= 0]) == len(once)
    stage = pipeline.near_dedup(spark, rows, folder)
    assert stage.columns == rows.columns and stage.where("doc_id is null").count() == 2
    assert not [p for p in os.listdir(os.path.join(spark.conf.get("spark.checkpoint.dir"), "lexiloom")) if p.startswith("pipeline-quality")]
    rows.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
