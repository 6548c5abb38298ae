"""n-gram tables, document-term counts and vocabulary selection.

Counts live in long tables (document, order, ngram, count).  n-grams are
exploded once per query, pre-aggregated before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import text as T
from lexiloom.operators.ranking import average_rank, rank_by_name
from lexiloom.operators.stored import written, written_in_slices

#: Characters of text whose n-grams are shuffled at a time, and the most slices that n-grams are dealt into.
SLICE, SLICES = 8_000_000, 16
#: Terms of a vocabulary that is sent to all tasks.
SENT = 200_000


def ngram_rows(docs: DataFrame, keys: list[str], text: str, orders: Iterable[int]) -> DataFrame:
    """``keys..., order, ngram, cnt`` with a row for each occurrence, for sums over documents."""
    grams = T.ngrams_of_orders(F.col("_w"), orders)
    exploded = docs.select(*keys, T.tokens(F.col(text)).alias("_w")).select(*keys, F.explode(grams).alias("_g"))
    return exploded.select(*keys, "_g.order", "_g.ngram", F.lit(1).cast("long").alias("cnt"))


def ngram_counts(docs: DataFrame, keys: list[str], text: str, orders: Iterable[int]) -> DataFrame:
    """``keys..., order, ngram, cnt`` with a row for each document and n-gram."""
    return ngram_rows(docs, keys, text, orders).groupBy(*keys, "order", "ngram").agg(F.sum("cnt").alias("cnt"))


def artists_per_ngram(grams: DataFrame, artist: str) -> DataFrame:
    """Different artists of each n-gram; distinct pairs first, so that a frequent n-gram is no single task's set."""
    return grams.where(F.col(artist).isNotNull()).select("order", "ngram", artist).distinct().groupBy("order", "ngram").agg(F.count("*").alias("artists"))


def vocabulary(grams: DataFrame) -> DataFrame:
    """``term_idx, order, ngram`` by order and name."""
    terms = written_in_slices([grams.select("order", "ngram").distinct()], "terms")
    return rank_by_name(terms, "order", "ngram").select((F.col("rank") - 1).cast("long").alias("term_idx"), "order", "ngram")


def word_windows(words: DataFrame, keys: list[str], most: int, slices: int) -> DataFrame:
    """A row for each word of arrays ``_w`` of them: it and the next ones, ``most`` together
    (``_0, _1, ...``, null beyond the end), and the slice (``_slice``) that the first two give."""
    w = F.col("_w")
    window = lambda x, i: F.struct(x.alias("_0"), *(F.get(w, i + j).alias(f"_{j}") for j in range(1, max(2, most))))
    rows = words.select(*keys, F.explode(F.transform(w, window)).alias("_g")).select(*keys, "_g.*")
    return rows.withColumn("_slice", F.pmod(F.xxhash64("_0", "_1"), F.lit(slices)).cast("int"))


def window_ngrams(windows: DataFrame, keys: list[str], orders: Iterable[int]) -> DataFrame:
    """:func:`ngram_rows` of the n-grams that begin the windows."""
    gram = lambda n: F.when(F.col(f"_{n - 1}").isNotNull(), F.concat_ws(" ", *(f"_{j}" for j in range(n))))
    exploded = windows.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("order"), gram(n).alias("ngram")) for n in orders))).alias("_g"))
    return exploded.select(*keys, "_g.order", "_g.ngram", F.lit(1).cast("long").alias("cnt")).where("ngram is not null")


def transform_documents(docs: DataFrame, keys: list[str], text: str, orders: Iterable[int], vocab: DataFrame) -> DataFrame:
    """:func:`transform` of the n-grams of documents, which are held against the
    vocabulary where they are made: only its terms are shuffled.  A vocabulary of
    more than ``SENT`` terms is joined with the counts instead."""
    vocab = written(vocab, "vocabulary")
    if vocab.count() > SENT:
        return transform(ngram_counts(docs, keys, text, orders), keys, vocab)
    return transform(ngram_rows(docs, keys, text, orders), keys, F.broadcast(vocab)).groupBy(*keys, "term_idx").agg(F.sum("cnt").alias("cnt"))


def transform(grams: DataFrame, keys: list[str], vocab: DataFrame) -> DataFrame:
    """Document-term counts over a fixed vocabulary: ``keys..., term_idx, cnt``."""
    return grams.join(vocab.select("order", "ngram", "term_idx"), ["order", "ngram"]).select(*keys, "term_idx", "cnt")


def aggregate_rows(dtm: DataFrame, member: str) -> DataFrame:
    """Sum of the rows of each member: ``member, term_idx, cnt``."""
    return dtm.groupBy(member, "term_idx").agg(F.sum("cnt").alias("cnt"))


def class_tfidf(grams: DataFrame, label: str) -> DataFrame:
    """``order, label, ngram, count, tf, idf, tfidf`` from document frequencies within classes.

    tf: share of the class's document counts of that order; idf: ln((classes +
    1) / (classes with the n-gram + 1)) + 1.  ``grams`` has one row per document
    and n-gram.
    """
    count = grams.groupBy("order", label, "ngram").agg(F.count("*").alias("count"))
    per_class = count.groupBy("order", label).agg(F.sum("count").alias("total"))
    with_it = count.groupBy("order", "ngram").agg(F.count("*").alias("with_it"))
    classes = F.broadcast(grams.select(label).distinct().agg(F.count("*").alias("classes")))
    idf = F.log((F.col("classes") + 1) / (F.col("with_it") + 1)) + 1
    return (
        count.join(F.broadcast(per_class), ["order", label])
        .join(with_it, ["order", "ngram"])
        .crossJoin(classes)
        .select("order", label, "ngram", "count", (F.col("count") / F.col("total")).alias("tf"), idf.alias("idf"))
        .withColumn("tfidf", F.col("tf") * F.col("idf"))
    )


def top_by_class(scores: DataFrame, label: str, k: int) -> DataFrame:
    """The ``k`` n-grams of greatest tf-idf of each order and class; of equals the first by name."""
    order = Window.partitionBy("order", label).orderBy(F.desc("tfidf"), "ngram")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_features(grams: DataFrame, label: str, artist: str, *, min_artists: int = 20, k: int = 100) -> DataFrame:
    """Vocabulary of class tf-idf: scores over all n-grams, then those of enough artists, then the top per class."""
    scores = class_tfidf(grams, label)
    enough = artists_per_ngram(grams, artist).where(F.col("artists") >= min_artists).select("order", "ngram")
    return vocabulary(top_by_class(scores.join(enough, ["order", "ngram"], "left_semi"), label, k))


def usable(min_artists: int, stopwords: bool = True, boundary: bool = True) -> Column:
    """Condition on (ngram, artists) before log odds are computed."""
    out = F.col("artists") >= min_artists
    if stopwords:
        out = out & ~T.stopword_only(F.col("ngram"))
    return out & ~T.boundary_bigram(F.col("ngram")) if boundary else out


def classes(rows: DataFrame, label: str) -> list:
    """The classes in order; they are few by nature."""
    return sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().collect())


def _counts_by_class(grams: DataFrame, label: str, artist: str, labels: list, min_artists: int, stopwords: bool, boundary: bool, distinct_hashes: bool = False) -> DataFrame:
    """``order, ngram, y`` of usable n-grams; ``y``: counts in the order of ``labels``.

    The counts of an n-gram's artists are summed first, with a class in each
    column, so that the artists are rows to count and nothing is read twice.
    Whether there are two different artists at least, the least and the
    greatest hash of them tell without that, where no two artists have the same
    (``distinct_hashes``).
    """
    columns = [f"_c{k}" for k in range(len(labels))]
    sums = [F.sum(F.when(F.col(label) == v, F.col("cnt")).otherwise(0)).alias(c) for c, v in zip(columns, labels)]
    if min_artists <= 2 and distinct_hashes:
        h = F.when(F.col(artist).isNotNull(), F.xxhash64(artist))
        both = grams.groupBy("order", "ngram").agg(F.min(h).alias("_low"), F.max(h).alias("_high"), *sums)
        artists = F.when(F.col("_low").isNull(), 0).when(F.col("_low") == F.col("_high"), 1).otherwise(2)
        both = both.withColumn("artists", artists)
    else:
        own = grams.groupBy("order", "ngram", artist).agg(*sums)
        both = own.groupBy("order", "ngram").agg(F.count(artist).alias("artists"), *(F.sum(c).alias(c) for c in columns))
    return both.where(usable(min_artists, stopwords, boundary)).select("order", "ngram", F.array(*columns).alias("y"))


def _sliced_counts(docs: DataFrame, text: str, orders: Iterable[int], label: str, artist: str, labels: list, min_artists: int, stopwords: bool, boundary: bool) -> DataFrame:
    """Written :func:`_counts_by_class` of the n-grams of documents, a slice of the n-grams at a time.

    All n-grams of a large table take many times its size in shuffle files.
    Words are written once; an n-gram is in the slice of its first two words.
    """
    told = docs.agg(F.sum(F.length(text)).alias("chars"), F.countDistinct(artist).alias("a"), F.countDistinct(F.xxhash64(artist)).alias("h")).first() if min_artists <= 2 else docs.agg(F.sum(F.length(text)).alias("chars")).first()
    options = labels, min_artists, stopwords, boundary, min_artists <= 2 and told["a"] <= told["h"]
    slices = min(SLICES, -(-(told["chars"] or 0) // SLICE))
    if slices <= 1:
        return written(_counts_by_class(ngram_rows(docs, [label, artist], text, orders), label, artist, *options), "class-counts")
    # Words have no two first words in common, but are few different ones: they are counted by themselves.
    longer, keys = [n for n in orders if n > 1], [label, artist]
    words = written(docs.select(*keys, T.tokens(F.col(text)).alias("_w")), "words")
    windows = word_windows(words, keys, max(orders), slices)
    parts = [window_ngrams(windows, keys, [1])] if 1 in orders else []
    parts += [window_ngrams(windows.where(F.col("_slice") == k), keys, longer) for k in range(slices) if longer]
    return written_in_slices((_counts_by_class(rows, label, artist, *options) for rows in parts), "class-counts")


def _long(counts: DataFrame, labels: list, label: str, kind: str, **values: Column) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(v).cast(kind).alias(label), *(f(k).alias(n) for n, f in values.items())) for k, v in enumerate(labels)))
    return counts.select("order", "ngram", F.explode(cells).alias("c")).select("order", "ngram", "c.*")


def class_counts(grams: DataFrame, label: str, artist: str, *, labels: list | None = None, min_artists: int = 20, stopwords: bool = True, boundary: bool = True) -> DataFrame:
    """``order, ngram, label, y`` of all usable n-grams and classes, zeros included.

    ``labels``: the classes; where not given they are looked up in ``grams``,
    which makes the n-grams once more.
    """
    labels = classes(grams, label) if labels is None else labels
    if not labels:
        return grams.select("order", "ngram", label, F.col("cnt").alias("y")).limit(0)
    counts = _counts_by_class(grams, label, artist, labels, min_artists, stopwords, boundary)
    return _long(counts, labels, label, dict(grams.dtypes)[label], y=lambda k: F.col("y")[k])


def log_odds(grams: DataFrame, label: str, artist: str, *, labels: list | None = None, prior: float = 1.0, min_artists: int = 20, stopwords: bool = True, boundary: bool = True) -> DataFrame:
    """``order, ngram, label, z``: z-scores of the log odds of each usable n-gram in a class against all others.

    The prior of an n-gram is its share of all counts of its order times
    ``prior``, so the priors of an order sum to ``prior``.  The sums over
    classes and orders come from the same counts and are a few rows.
    ``labels`` as for :func:`class_counts`.
    """
    labels = classes(grams, label) if labels is None else labels
    if not labels:
        return grams.select("order", "ngram", label, F.lit(0.0).alias("z")).limit(0)
    # Written, as the totals come from them too: n-grams are made and counted once.
    counts = written(_counts_by_class(grams, label, artist, labels, min_artists, stopwords, boundary), "class-counts")
    return _scored(counts, labels, label, dict(grams.dtypes)[label], prior)


def document_log_odds(docs: DataFrame, text: str, orders: Iterable[int], label: str, artist: str, *, labels: list | None = None, prior: float = 1.0, min_artists: int = 20, stopwords: bool = True, boundary: bool = True) -> DataFrame:
    """:func:`log_odds` of the n-grams of documents, counted a slice of the n-grams at a time."""
    labels = classes(docs, label) if labels is None else labels
    if not labels:
        return log_odds(ngram_rows(docs, [label, artist], text, orders), label, artist, labels=labels)
    counts = _sliced_counts(docs, text, list(orders), label, artist, labels, min_artists, stopwords, boundary)
    return _scored(counts, labels, label, dict(docs.dtypes)[label], prior)


def _scored(counts: DataFrame, labels: list, label: str, kind: str, prior: float) -> DataFrame:
    """z-scores of written counts."""
    totals = counts.groupBy("order").agg(F.array(*(F.sum(F.col("y")[k]) for k in range(len(labels)))).alias("n_c"))
    t = counts.join(F.broadcast(totals), "order")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    t = t.withColumn("y_g", total("y")).withColumn("n", total("n_c")).withColumn("a", F.lit(prior) * F.col("y_g") / F.col("n"))

    def z(k: int) -> Column:
        y, n_c = F.col("y")[k].cast("double"), F.col("n_c")[k].cast("double")
        y_g, n_all, a = F.col("y_g"), F.col("n"), F.col("a")
        inside, rest = y + a, n_c - y + F.lit(prior) - a
        other, other_rest = y_g - y + a, n_all - n_c - y_g + y + F.lit(prior) - a
        delta = F.log(inside / rest) - F.log(other / other_rest)
        return delta / F.sqrt(1 / inside + 1 / rest + 1 / other + 1 / other_rest)

    return _long(t, labels, label, kind, z=z)


def _reachable(p: str, fdr: float) -> Column:
    """No greater p can pass, as r <= m; with room for rounding."""
    return F.col(p) <= F.lit(fdr * (1 + 1e-9))


def benjamini_hochberg(tests: DataFrame, fdr: float, p: str = "p", m: int | None = None) -> DataFrame:
    """``tests`` with ``passes_bh``: all p up to the greatest p_(r) <= fdr * r / m.

    ``m``: the number of tests, where ``tests`` lacks some of p above ``fdr``;
    these can't pass and are only counted.

    Ranks are counted without ordering all rows in one task: equal p are
    counted first, then running counts are taken within bins of p that follow
    its order, and the counts of lower bins are added.
    """
    per_p = tests.where(_reachable(p, fdr)).groupBy(p).agg(F.count("*").alias("n"))
    bin_ = F.when(F.col(p) <= 0, F.lit(-4096)).otherwise(F.greatest(F.lit(-4095), F.floor(F.log2(F.col(p)) * 64).cast("int")))
    binned = per_p.withColumn("bin", bin_)
    sizes = binned.groupBy("bin").agg(F.sum("n").alias("in_bin"))  # at most 4,097 rows
    lower = sizes.withColumn("below", F.coalesce(F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = tests.agg(F.count(p).alias("m")) if m is None else tests.sparkSession.range(1).select(F.lit(m).alias("m"))
    running = F.sum("n").over(Window.partitionBy("bin").orderBy(p))
    ranked = binned.withColumn("running", running).join(F.broadcast(lower.select("bin", "below")), "bin").crossJoin(F.broadcast(total))
    rank = F.col("below") + F.col("running")
    cut = ranked.where(F.col(p) <= F.lit(fdr) * rank / F.col("m")).agg(F.max(p).alias("bh_cut"))
    return tests.crossJoin(F.broadcast(cut)).withColumn("passes_bh", F.coalesce(F.col(p) <= F.col("bh_cut"), F.lit(False))).drop("bh_cut")


def select_by_log_odds(scores: DataFrame, fdr: float) -> DataFrame:
    """Vocabulary of the n-grams that pass jointly over all orders and classes with z > 0."""
    from lexiloom.functions.normal import upper_tail

    tests = scores.withColumn("p", upper_tail(F.col("z")))
    low = written(tests.where(_reachable("p", fdr)), "tests")
    return vocabulary(benjamini_hochberg(low, fdr, m=tests.where("p is not null").count()).where("passes_bh and z > 0"))


def align_vocabularies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Positions of common terms in two vocabularies."""
    return old.select("ngram", F.col("term_idx").alias("old_idx")).join(new.select("ngram", F.col("term_idx").alias("new_idx")), "ngram")


def _ranked_weights(weights: DataFrame, topic: str, term: str) -> DataFrame:
    """``topic, term, w, beta, exclusive, ecdf_f, ecdf_e``: shares in the topic and
    of the term, and their ranks in the topic as parts of its terms."""
    per_topic = weights.groupBy(topic).agg(F.sum("w").alias("w_topic"), F.count("*").alias("n"))  # few rows
    b = weights.join(F.broadcast(per_topic), topic).withColumn("beta", F.col("w") / F.col("w_topic"))
    per_term = b.groupBy(term).agg(F.sum("beta").alias("beta_term"))
    exclusive = F.coalesce(F.round(F.try_divide("beta", "beta_term"), 12), F.lit(0.0))
    # Rounded, so that equal shares that were summed up in another order stay equal.
    b = b.join(per_term, term).select(topic, term, "w", "n", "beta", exclusive.alias("exclusive"), F.round("beta", 15).alias("_beta"))
    ranked = average_rank(average_rank(written(b, "weights"), [topic], "_beta", "rank_f"), [topic], "exclusive", "rank_e")
    return ranked.select(topic, term, "w", "beta", "exclusive", (F.col("rank_f") / F.col("n")).alias("ecdf_f"), (F.col("rank_e") / F.col("n")).alias("ecdf_e"))


def frex(weights: DataFrame, topic: str, term: str, *, share: float = 0.7) -> DataFrame:
    """Lift and FREX of topic-term weights: the harmonic mean of ranks by frequency and exclusivity."""
    b = _ranked_weights(weights, topic, term)
    p_term = weights.groupBy(term).agg(F.sum("w").alias("w_t")).crossJoin(F.broadcast(weights.agg(F.sum("w").alias("w_all"))))
    b = b.join(p_term.select(term, (F.col("w_t") / F.col("w_all")).alias("p_term")), term)
    score = 1 / (F.lit(share) / F.col("ecdf_f") + F.lit(1 - share) / F.col("ecdf_e"))
    return b.select(topic, term, "beta", F.coalesce(F.try_divide(F.col("beta"), F.col("p_term")), F.lit(0.0)).alias("lift"), score.alias("frex"))


def exclusivity(weights: DataFrame, topic: str, term: str, *, top: int = 10, share: float = 0.7) -> DataFrame:
    """``topic, exclusivity``: the sum over a topic's ``top`` terms of the harmonic
    mean of their ranks by exclusivity (weight ``share``) and by frequency."""
    b = _ranked_weights(weights, topic, term)
    score = 1 / (F.lit(share) / F.col("ecdf_e") + F.lit(1 - share) / F.col("ecdf_f"))
    return top_terms(b.withColumn("score", score), topic, term, "w", top).groupBy(topic).agg(F.sum("score").alias("exclusivity"))


def top_terms(scores: DataFrame, topic: str, term: str, value: str, n: int) -> DataFrame:
    order = Window.partitionBy(topic).orderBy(F.desc(value), term)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
