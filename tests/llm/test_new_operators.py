"""Fill-in-the-middle, whitening and URL filters against brute force, with nulls, repeats, clashing names and empty tables."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import fill_in_middle, queries, skew, url_filter, whitening

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain_fim(doc_id, text, sentinels=("<P>", "<S>", "<M>"), pattern=r"[^\n]*\n|[^\n]+"):
    """With a list of all units."""
    text, (p, s, m) = text or "", sentinels
    units = re.findall(pattern, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(x in text for x in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def test_fill_in_middle_against_lists(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BATCH", 2000)
    rng = random.Random(1)
    alphabet = ["a", "é", "\n", "\n\n", "𝄞", "<", "P", ">", "<P", "S>", "\r", " ", "<S", "M>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "\n", "one", "a\nb", "a <P> b\nc", "<<S>\n", "line\n" * 50_000, "x" * 300_000 + "\n" + "y", "ends\n"]
    rows = [(k, t, "clash", 3) for k, t in enumerate(texts)] + [(5, texts[5], "again", 4), (None, "a\nb\nc\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    done = fill_in_middle.transform(docs)
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((tuple(r) for r in done.collect()), key=repr)
    assert got == sorted(((i, *plain_fim(i, t)) for i, t, *_ in rows), key=repr)
    back = done.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle.transform(docs.where("false")).count() == 0


def test_fill_in_middle_of_other_units_and_shares(spark):
    docs = spark.createDataFrame([(f"k{k}", f"one  two three{k} four") for k in range(200)], "id string, body string")
    done = fill_in_middle.transform(docs, unit=r"\S+\s*", percent=60, spm_percent=0, sentinels=("[pre]", "[suf]", "[mid]"), id_col="id", text_col="body")
    rows = done.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert all(r["n"] == 4 and r["back"] == f"one  two three{r['id'][1:]} four" for r in rows)
    assert 90 <= sum(r["form"] == "psm" for r in rows) <= 150 and {r["form"] for r in rows} == {"psm", "plain"}
    for bad in (("<a>", "<a>", "<b>"), ("ab", "ba", "c"), ("", "<a>", "<b>"), ("xyx", "1", "2"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(docs, sentinels=bad, id_col="id", text_col="body")


def test_fill_in_middle_keeps_broken_bytes(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61ff0a62c30a63")).cast("string").alias("text"))
    done = fill_in_middle.transform(docs)
    back = done.select(F.hex(fill_in_middle.restore(F.col("output"), F.col("form")).cast("binary"))).distinct().collect()
    assert [r[0] for r in back] == ["61FF0A62C30A63"]


def test_matcher_is_lazy():
    unit = re.compile(fill_in_middle.LINES)
    text = "a\n" * 10
    assert fill_in_middle.count_units(unit, text) == 10
    assert [fill_in_middle.cut_places(unit, text, a, b) for a, b in ((0, 0), (0, 10), (3, 3), (2, 9))] == [(0, 0), (0, 20), (6, 6), (4, 18)]


def brute_whitening(x, k):
    """Dense covariance of the distinct rows."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors / np.sqrt(values), values / (centred**2).sum() * n


def check_whitening(rows, ids, x, k=4):
    n, deviations, whitened, explained = brute_whitening(x, k)
    at = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * k and len(at) == len(set(ids)) * k
    for j in range(k):
        ours = np.array([at[i, j + 1]["whitened"] for i in ids])
        sign = 1 if ours @ whitened[:, j] > 0 else -1
        assert np.abs(ours - sign * whitened[:, j]).max() < 1e-8
        assert abs(at[ids[0], j + 1]["explained"] - explained[j]) < 1e-12
    assert all(r["n"] == n and r["identity_error"] < 1e-10 for r in rows)
    assert [at[i, 1]["deviation"] for i in ids] == deviations.tolist()


@pytest.mark.parametrize("dim, block", [(64, 16), (40, 8), (6, 16), (4, 16)])
def test_whitening_against_dense(spark, monkeypatch, dim, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "ROWS", 50)
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((700, dim)) @ np.diag(np.linspace(1.3, 1, dim))
    v[300:500] = v[7]  # a hot vector
    v[:100] *= 200  # wider integers
    x = np.floor(256 * v)
    rows = [(k, r.tolist(), "clash", 1.0) for k, r in enumerate(v)]
    extra = [(1000, None, "", 0.0), (1001, [float("nan")] * dim, "", 0.0), (1002, [1.0] * (dim - 1) + [None], "", 0.0), (1003, [float("inf")] + [0.0] * (dim - 1), "", 0.0)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, component string, n double").repartition(5)
    out = whitening.whiten(df).collect()
    check_whitening(out, list(range(700)), x.astype(np.int64))


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == []
    assert make([(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []  # equal: no component
    line = make([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)] + [(9, [1.0])])  # one component, and a vector of another length
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(k, 1) for k in (0, 1, 2, 3, 4, 9)]
    assert [r["deviation"] is None and r["whitened"] is None for r in line if r["vec_id"] == 9] == [True]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line)
    huge = make([(1, [1e300, 0.0]), (2, [-1e300, 3.0]), (3, [4e9, 1.0]), (None, [0.0, 7.0])])
    assert {r["vec_id"] for r in huge} == {1, 2, 3, None} and all(r["deviation"] is None for r in huge if r["vec_id"] == 1)
    assert all(np.isfinite(r["whitened"]) for r in huge)


def test_deviations_next_to_the_limit():
    n, sums = 3, [5, -7]
    x = np.array([[0, 0], [1 << 30, 3], [(1 << 31) // 2, (1 << 31) // 3], [1_012_333_333, 1], [3_037_000_499 // 3, 0], [3_037_000_501 // 3 + 2, 0]])
    exact = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]
    got = whitening._deviations(x, n, np.array([s % 2**64 for s in sums], np.uint64), sums)
    assert got == [e if e < 2**63 else None for e in exact]
    assert any(g is None for g in got) and got[0] is not None


def test_packing_is_canonical():
    x = np.array([[0, -1], [32767, -32768], [32768, 0], [2**31 - 1, -(2**31)], [2**31, 5], [-(2**40), 2**62]])
    packed = whitening._pack(x)
    import pyarrow as pa

    assert [p[0] for p in packed] == [2, 2, 4, 4, 8, 8]
    assert (whitening._unpack(pa.array(packed, pa.binary()), 2) == x).all()
    assert (whitening._unpack(pa.array(packed, pa.binary()).slice(2, 3), 2) == x[2:5]).all()
    assert whitening._unpack(pa.array([], pa.binary()), 2).shape == (0, 2)


@needs_tables
def test_whitening_query(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    good = [r for r in table if r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    out = queries.op12_embedding_whitening(spark, FOLDER).collect()
    check_whitening(out, [r["vec_id"] for r in good], np.floor(256 * np.array([r["embedding"] for r in good], float)).astype(np.int64))


RULES = queries.URL_RULES


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not m:
        return "", "", None
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1])
    return host, m[2], (host + (m[2] or "/") + (m[3] or "")) if host else None


def plain_rule(host, path):
    best = None
    for action, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return best


def plain_verdicts(rows, edges):
    """Classes by a search from each URL."""
    near = {}
    for u, v in edges:
        a, b = plain_parts(u)[2], plain_parts(v)[2]
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for page_id, url in rows:
        host, path, key = plain_parts(url)
        own = plain_rule(host, path)
        seen, todo = {key}, [key]
        while todo:
            for k in near.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        actions = {r[0] for k in seen if k in near for r in [plain_rule(*plain_parts("x://" + k)[:2])] if r}
        verdict = own[0] if own else "block" if "block" in actions and "allow" not in actions else "allow"
        out.append((page_id, host, path, own[1] if own else None, verdict))
    return sorted(out, key=repr)


HOSTS = ["a.net", "b.example.net", "www.example.com", "x.example.com", "y.org", "plain.info", "other.info", "deep.plain.info", "third.info", "fourth.info"]
PATHS = ["/en/1", "/de/2", "/fr/3", "/", "", "/en/1?page=2", "/z#top"]


def planted_pages(seed=3, n=500):
    """Pages with links in all forms, and the edges that they mean."""
    rng, rows, edges = random.Random(seed), [], []
    for k in range(n):
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}{'' if rng.random() < 0.2 else k % 90}"
        to = f"https://{rng.choice(HOSTS)}{rng.choice(PATHS)}{k % 83}"
        html = rng.choice(["<html><body>canonical text</body>", None, "", "<p>refresh</p>"])
        kind = rng.randrange(14)
        if kind == 0:
            html = f'<html><head><LINK href="{to}" rel="canonical"></head>'
        elif kind == 1:
            html = f"<meta http-equiv='Refresh' content='0; URL={to}'>"
        elif kind == 2:
            html = f"<link rel=canonical href={to}><link rel='stylesheet' href='https://a.net/en/9'>"
        elif kind == 3:
            html, to = "<link rel='nofollow canonical' href='/moved?a=1&amp;b=2'>", re.match(r"(.*?://[^/?#]*)", url)[1] + "/moved?a=1&b=2"
        elif kind == 4:
            html, to = "<link rel='canonical' href='//a.net/en/7'>", "http://a.net/en/7"
        elif kind == 5:
            html, to = "<link rel='canonical' href='?q=1'>", re.match(r"(.*?://[^?#]*)", url)[1] + "?q=1"
        elif kind == 6:
            m = re.match(r"(.*?://[^/?#]*)([^?#]*/)?", url)
            html, to = "<link rel='canonical' href='sibling'>", m[1] + (m[2] or "/") + "sibling"
        elif kind == 7:
            html, to = f"<!-- <link rel='canonical' href='{to}'> --><script>var a=\"<link rel='canonical' href='{to}'>\"</script>", None
        elif kind == 8:
            html, to = "<link rel='canonical' href='mailto:a@b.c'><meta http-equiv='refresh' content='30'>", None
        else:
            to = None
        if to:
            edges.append((url, to))
        rows.append((k % (n - 10), url, html, "clash"))
    rows += [(9001, None, "<link rel='canonical' href='http://a.net/'>", ""), (9002, "no scheme", "x", ""), (9003, "://", "", ""), (9004, "HTTP://WWW.A.NET", None, ""), (None, "http://a.net/x", "", "")]
    return rows, edges


def test_url_filter_against_search(spark, monkeypatch, tmp_path):
    rows, edges = planted_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").repartition(4)
    expected = plain_verdicts([r[:2] for r in rows], edges)
    without = plain_verdicts([r[:2] for r in rows], [])
    assert sum(a != b for a, b in zip(expected, without)) > 10  # the method decides some
    got = url_filter.judge(pages, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HEAVY", 20)
    assert sorted(map(tuple, url_filter.judge(pages, RULES).collect()), key=repr) == expected
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(queries.OP13_SQL).fetchall(), key=repr) == expected


def test_redirect_hubs_and_chains(spark):
    hub = [(f"http://s{k}.info/", "http://hub.info/") for k in range(300)] + [("http://hub.info/", "http://bad.net/a")]
    chain = [(f"http://c.info/{k}", f"http://c.info/{k + 1}") for k in range(60)] + [("http://c.info/60", "http://q.example.com/de/1")]
    saved = [("http://t.info/1", "http://bad.net/b"), ("http://t.info/1", "https://fine.org/fr/1"), (None, "http://a.net/"), ("http://a.net/", None), ("http://self.info", "https://self.info/")]
    urls = [u for e in hub + chain + saved for u in e if u] + ["http://alone.info/", "http://t.info/1#x"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    redirects = spark.createDataFrame(hub + chain + saved, "source string, target string")
    got = sorted(map(tuple, url_filter.judge(pages, RULES, redirects=redirects).collect()), key=repr)
    assert got == plain_verdicts(list(enumerate(urls)), [e for e in hub + chain + saved if None not in e])
    verdicts = {urls[r[0]]: r[4] for r in got}
    assert verdicts["http://s5.info/"] == verdicts["http://c.info/0"] == "block"
    assert verdicts["http://t.info/1"] == verdicts["http://alone.info/"] == "allow"  # an allowed alias takes precedence
    empty = url_filter.judge(pages.where("false"), RULES, redirects=redirects.where("false"))
    assert empty.count() == 0 and url_filter.judge(pages, []).where("verdict = 'block' or rule is not null").count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, [("drop", "net", "/")])


def test_join_of_counted_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 10)
    rows = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7").withColumn("v", F.col("k") * 2)
    got = skew.join_counted(rows, keys, "k", 1000)
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, rows.join(keys, "k").select("k", "id", "v").collect()))


@needs_tables
@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_url_filter"])
def test_new_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = queries.queries()[name](spark, FOLDER)
    assert df.columns == columns
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_training_gathers_are_bounded(spark, monkeypatch):
    """One id repeated ten thousand times, with equal and with different texts."""
    from lexiloom.llm import quality, toxicity

    monkeypatch.setattr(quality, "GATHERED", 500)
    same = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("good words in a row.").alias("text"))
    other = spark.range(10_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("bad "), F.col("id").cast("string")).alias("text"))
    rest = spark.range(3, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain "), F.repeat(F.lit("word "), F.col("id").cast("int"))).alias("text"))
    docs = same.unionByName(other).unionByName(rest)
    assert quality.bounded(same, 500).count() == 1 and 0 < quality.bounded(other, 500).count() < 1000 and quality.bounded(rest, 500).count() == 37
    labels = spark.range(1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    gathered = []
    fit = quality.Discriminant.fit
    monkeypatch.setattr(quality.Discriminant, "fit", lambda x, y: gathered.append(len(y)) or fit(x, y))
    scored = quality.classify(docs, labels)
    assert scored.count() == 20_037 and 0 < gathered[0] < 1000
    ordinal = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda x, g: gathered.append(len(g)) or ordinal(x, g))
    toxicity.train(docs, labels, max_rows=250)
    assert 0 < gathered[-1] < 1000
