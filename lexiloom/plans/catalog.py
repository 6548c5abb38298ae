"""All queries of the library by name, with their SQL.

Stand-ins: ``documents`` are tracks with ``lang`` as genre and ``source`` as
artist; ``conversations`` are tracks with ``role`` as genre and the
conversation as artist; ``orders`` map customers (artists) to priorities
(genres); ``lineitem`` is a sparse matrix; ``events`` are votes; ``labels`` are
truth and prediction; ``embeddings`` are classifier features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions import text as T
from lexiloom.functions.lexicon import BOUNDARY_WORDS, CONTRACTIONS, FILLERS, STOPWORDS, domain_lexicon
from lexiloom.functions.normal import upper_tail, upper_tail_sql
from lexiloom.operators import agreement, annotated, grouping, metrics, morphology, terms, topics
from lexiloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import lexiloom.plans.models  # noqa: F401  registers the model queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


P = T.WORD.replace("'", "''")
TOKENS = f"""tok AS (
  SELECT doc_id, lang, source, unnest(l) AS t, generate_subscripts(l, 1) AS p
  FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '{P}') AS l FROM documents))"""
CONVERSATIONS = "conv_id AS doc_id, turn, role, conv_id AS artist, text FROM conversations"
DOCUMENTS = "doc_id, 0 AS turn, lang AS role, source AS artist, text FROM documents"


def _grams_sql(rows: str, orders: int = 4) -> str:
    """n-gram counts of each document (doc_id, turn), with role as class and artist."""
    return f"""tok AS (
  SELECT doc_id, turn, role, artist, unnest(l) AS t, generate_subscripts(l, 1) AS p
  FROM (SELECT doc_id, turn, role, artist, regexp_extract_all(lower(coalesce(text, '')), '{P}') AS l FROM (SELECT {rows}))),
flag AS (SELECT *, CASE WHEN t IN ({_quoted(STOPWORDS)}) OR regexp_matches(t, '^\\d+\\S*$') THEN 1 ELSE 0 END AS s FROM tok),
near AS (
  SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3,
    lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(s, 3) OVER w AS s3
  FROM flag WINDOW w AS (PARTITION BY doc_id, turn ORDER BY p)),
ng AS (
  SELECT doc_id, turn, role, artist, 1 AS o, t AS g, s AS stop, t AS first FROM near
  UNION ALL SELECT doc_id, turn, role, artist, 2, t || ' ' || t1, s * s1, t FROM near WHERE t1 IS NOT NULL
  UNION ALL SELECT doc_id, turn, role, artist, 3, t || ' ' || t1 || ' ' || t2, s * s1 * s2, t FROM near WHERE t2 IS NOT NULL AND {orders} >= 3
  UNION ALL SELECT doc_id, turn, role, artist, 4, t || ' ' || t1 || ' ' || t2 || ' ' || t3, s * s1 * s2 * s3, t FROM near WHERE t3 IS NOT NULL AND {orders} >= 4),
cnt AS (SELECT doc_id, turn, role, artist, o, g, any_value(stop) AS stop, any_value(first) AS first, count(*) AS cnt FROM ng GROUP BY doc_id, turn, role, artist, o, g)"""


CONV, DOCN = _grams_sql(CONVERSATIONS), _grams_sql(DOCUMENTS)
BOUNDARY = _quoted(BOUNDARY_WORDS)


def _monroe_sql(grams: str, min_artists: int) -> str:
    return f"""{grams},
art AS (SELECT o, g, any_value(stop) AS stop, any_value(first) AS first, count(DISTINCT artist) AS artists FROM cnt GROUP BY o, g),
kept AS (SELECT o, g FROM art WHERE artists >= {min_artists} AND stop = 0 AND NOT (o = 2 AND first IN ({BOUNDARY}))),
y AS (
  SELECT k.o, k.g, r.role, coalesce(s.y, 0) AS y
  FROM kept k CROSS JOIN (SELECT DISTINCT role FROM cnt WHERE role IS NOT NULL) r
  LEFT JOIN (SELECT o, g, role, sum(cnt) AS y FROM cnt GROUP BY o, g, role) s ON s.o = k.o AND s.g = k.g AND s.role = r.role),
tot AS (
  SELECT *, (sum(y) OVER (PARTITION BY o, g))::DOUBLE AS yg, (sum(y) OVER (PARTITION BY o, role))::DOUBLE AS nc, (sum(y) OVER (PARTITION BY o))::DOUBLE AS n FROM y),
pri AS (SELECT *, yg / n AS a FROM tot),
z AS (
  SELECT o, g, role, (ln((y + a) / (nc - y + 1 - a)) - ln((yg - y + a) / (n - nc - yg + y + 1 - a)))
    / sqrt(1 / (y + a) + 1 / (nc - y + 1 - a) + 1 / (yg - y + a) + 1 / (n - nc - yg + y + 1 - a)) AS z
  FROM pri)"""


MONROE, MONROE_DOCS = _monroe_sql(CONV, 20), _monroe_sql(DOCN, 2)
MONROE_VOCAB = f"""{MONROE_DOCS},
pv AS (SELECT o, g, role, z, {upper_tail_sql("z")} AS p FROM z),
rk AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER () AS m FROM pv),
cut AS (SELECT max(p) AS cut FROM rk WHERE p <= (0.001::DOUBLE * r) / m),
mv AS (SELECT row_number() OVER (ORDER BY o, g) - 1 AS term_idx, o, g FROM (SELECT DISTINCT o, g FROM pv, cut WHERE p <= cut AND z > 0))"""
TFIDF = f"""{CONV},
f AS (SELECT o, role, g, count(*) AS c FROM cnt WHERE o <= 3 GROUP BY o, role, g),
s AS (
  SELECT o, role, g, c, c::DOUBLE / sum(c) OVER (PARTITION BY o, role) AS tf,
    ln(((SELECT count(DISTINCT role) FROM conversations) + 1)::DOUBLE / (count(*) OVER (PARTITION BY o, g) + 1)) + 1 AS idf FROM f),
art AS (SELECT o, g, count(DISTINCT artist) AS artists FROM cnt GROUP BY o, g),
top AS (
  SELECT *, row_number() OVER (PARTITION BY o, role ORDER BY round(tf * idf, 12) DESC, g) AS rank
  FROM s SEMI JOIN (SELECT o, g FROM art WHERE artists >= 20) k USING (o, g))"""


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.parquet(spark, folder, "documents")


def _conv(spark: SparkSession, folder: str) -> DataFrame:
    c = tables.parquet(spark, folder, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), "turn", "role", F.col("conv_id").alias("artist"), "text")


def _conv_grams(spark: SparkSession, folder: str, orders=(1, 2, 3, 4)) -> DataFrame:
    return terms.ngram_counts(tables.spread(_conv(spark, folder)), ["doc_id", "turn", "role", "artist"], "text", orders)


def _conv_gram_rows(spark: SparkSession, folder: str) -> DataFrame:
    return terms.ngram_rows(tables.spread(_conv(spark, folder)), ["role"], "text", (1, 2, 3, 4))


def _doc_grams(spark: SparkSession, folder: str, orders=(1, 2, 3, 4)) -> DataFrame:
    return terms.ngram_counts(tables.spread(_docs(spark, folder).select("doc_id", "lang", "source", "text")), ["doc_id", "lang", "source"], "text", orders)


def _doc_gram_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each occurrence: for sums over documents, which then take one shuffle."""
    return terms.ngram_rows(tables.spread(_docs(spark, folder).select("text")), [], "text", (1, 2, 3, 4))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return tables.parquet(spark, folder, "orders")


# --- projection, filters, joins -------------------------------------------


@query(
    """SELECT doc_id, lang, source FROM documents LEFT JOIN labels USING (doc_id)
    WHERE text IS NOT NULL AND lang IS NOT NULL AND lang IN ('en') AND source <> 'src0' AND quality <> 0 AND toxic <> 1"""
)
def corpus_filter(spark, folder):
    d = _docs(spark, folder).join(tables.parquet(spark, folder, "labels"), "doc_id", "left")
    keep = F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("lang").isin("en") & (F.col("source") != "src0")
    return d.where(keep & (F.col("quality") != 0) & (F.col("toxic") != 1)).select("doc_id", "lang", "source")


@query("SELECT o_orderkey AS track_id, o_custkey AS artist, o_orderpriority AS cat5 FROM orders")
def project_rename(spark, folder):
    return _orders(spark, folder).select(F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("artist"), F.col("o_orderpriority").alias("cat5"))


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_acctbal FROM supplier"
)
def cast_by_name(spark, folder):
    return tables.cast_all_but(tables.parquet(spark, folder, "supplier"), ("s_acct",))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def semi_join_ids(spark, folder):
    good = tables.parquet(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return _orders(spark, folder).select("o_orderkey", "o_custkey").join(good, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def _dictionary(spark, folder) -> DataFrame:
    return tables.parquet(spark, folder, "benchmark").select(F.explode(T.alphabetic_words(F.col("text"))).alias("word")).distinct()


ALPHA = """dict AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) AS w FROM benchmark) WHERE regexp_matches(w, '^\\p{L}+$')),
alpha AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\\s+')) AS w FROM documents) WHERE regexp_matches(w, '^\\p{L}+$')),
ratio AS (
  SELECT d.doc_id, count(a.w) AS words, coalesce(count(k.word)::DOUBLE / nullif(count(a.w), 0), 0) AS ratio
  FROM documents d LEFT JOIN alpha a ON a.doc_id = d.doc_id LEFT JOIN dict k ON k.word = a.w GROUP BY d.doc_id)"""


def vocabulary_ratio(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, words, ratio``: share of the letter-only words that the dictionary has; 0 without any."""
    words = docs.select("doc_id", F.explode(T.alphabetic_words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    known = words.join(dictionary.withColumn("known", F.lit(1)), "word", "left")
    share = known.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.coalesce("known", F.lit(0))).alias("hits"))
    return docs.select("doc_id").join(share, "doc_id", "left").select(
        "doc_id", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce(F.try_divide("hits", "words"), F.lit(0.0)).alias("ratio")
    )


@query(f"WITH {ALPHA} SELECT doc_id, words, round(ratio, 9) AS ratio FROM ratio")
def vocab_ratio(spark, folder):
    return vocabulary_ratio(_docs(spark, folder), _dictionary(spark, folder)).withColumn("ratio", F.round("ratio", 9))


# Words of English documents of the training folds that occur twice or more.
ENGLISH_WORDS = """SELECT w AS word FROM (SELECT unnest(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\\s+')) AS w FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0)
  WHERE regexp_matches(w, '^\\p{L}+$') GROUP BY w HAVING count(*) >= 2"""
_CHARS = """SELECT {k}, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS gram FROM (
  SELECT doc_id, lang, unnest(l) AS c, generate_subscripts(l, 1) AS p FROM (
    SELECT doc_id, lang, string_split(' ' || lower(coalesce(text, '')) || ' ', '') AS l FROM documents WHERE {where})) WINDOW w AS (PARTITION BY doc_id ORDER BY p)"""
CONFIDENCE = f"""cg AS ({_CHARS.format(k="lang", where="lang IS NOT NULL AND doc_id % 5 <> 0")}),
cw AS (SELECT gram, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang <> 'en') AS b FROM cg WHERE gram IS NOT NULL GROUP BY gram),
cm AS (SELECT gram, ln((a + 1)::DOUBLE / (sum(a) OVER () + count(*) OVER ())) - ln((b + 1)::DOUBLE / (sum(b) OVER () + count(*) OVER ())) AS weight FROM cw),
cd AS ({_CHARS.format(k="doc_id", where="true")}),
cs AS (SELECT doc_id, sum(weight) / count(*) AS w FROM cd JOIN cm USING (gram) GROUP BY doc_id),
conf AS (SELECT doc_id, coalesce(1 / (1 + exp(-20 * w)), 0.5) AS confidence FROM (SELECT doc_id FROM documents) LEFT JOIN cs USING (doc_id))"""


def _confidence(spark, folder) -> DataFrame:
    """English against the other languages, learned on four folds of the documents."""
    d = _docs(spark, folder)
    model = annotated.language_model(d.where("doc_id % 5 <> 0"), "lang", "text", "en")
    return annotated.language_confidence(d.select("doc_id", "text"), model, "doc_id", "text")


@query(f"WITH {CONFIDENCE} SELECT doc_id, round(confidence, 6) AS confidence FROM conf")
def english_confidence(spark, folder):
    return _confidence(spark, folder).select("doc_id", F.round("confidence", 6).alias("confidence"))


ALPHA_ENGLISH = ALPHA.replace(ALPHA[ALPHA.index("(") + 1 : ALPHA.index("),\nalpha")], ENGLISH_WORDS)


@query(f"WITH {ALPHA_ENGLISH}, {CONFIDENCE} SELECT doc_id FROM ratio JOIN conf USING (doc_id) WHERE ratio > 0.75 AND round(confidence, 9) > 0.75")
def english_filter(spark, folder):
    """Documents of a language confidence and a share of dictionary words above 0.75 each."""
    d = _docs(spark, folder)
    words = d.where("lang = 'en' and doc_id % 5 <> 0").select(F.explode(T.alphabetic_words(F.col("text"))).alias("word"))
    english = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").select("word")
    return vocabulary_ratio(d, english).join(_confidence(spark, folder), "doc_id").where((F.col("ratio") > 0.75) & (F.round("confidence", 9) > 0.75)).select("doc_id")


@query(f"WITH {ALPHA} SELECT i AS step, count(*) FILTER (ratio < 0.1::DOUBLE + i * 0.01::DOUBLE) AS rejected FROM ratio CROSS JOIN range(40) r(i) GROUP BY i")
def threshold_sweep(spark, folder):
    """Rejected documents at each threshold, counted in one pass."""
    r = vocabulary_ratio(_docs(spark, folder), _dictionary(spark, folder))
    one = r.agg(*(F.count_if(F.col("ratio") < F.lit(0.1) + F.lit(i) * F.lit(0.01)).alias(f"t{i}") for i in range(40)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("step"), F.col(f"t{i}").alias("rejected")) for i in range(40)))).alias("r")).select("r.step", "r.rejected")


@query(f"WITH {ALPHA} SELECT w AS word, count(*) AS n FROM alpha ANTI JOIN dict ON w = word GROUP BY w")
def oov_terms(spark, folder):
    words = _docs(spark, folder).select(F.explode(T.alphabetic_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(_dictionary(spark, folder), "word", "left_anti").select("word", "n")


# --- text -------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT doc_id, t AS token, count(*) AS n FROM tok GROUP BY doc_id, t")
def tokens(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(f'WITH {DOCN} SELECT o AS "order", g AS ngram, sum(cnt)::BIGINT AS n FROM cnt GROUP BY o, g')
def ngrams_all_orders(spark, folder):
    return _doc_gram_rows(spark, folder).groupBy("order", "ngram").agg(F.sum("cnt").alias("n"))


@query(
    """SELECT count(*) AS docs, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.75) AS q75
    FROM (SELECT len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS n FROM documents)"""
)
def tokens_per_doc_stats(spark, folder):
    n = _docs(spark, folder).select(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).alias("n"))
    return n.agg(F.count("*").alias("docs"), *(F.percentile("n", q).alias(k) for k, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))))


@query(f'WITH {DOCN} SELECT o AS "order", g AS ngram FROM cnt GROUP BY o, g HAVING any_value(stop) = 0')
def stopword_only_filter(spark, folder):
    g = _doc_gram_rows(spark, folder).select("order", "ngram").distinct()
    return g.where(~T.stopword_only(F.col("ngram")))


@query(f'WITH {DOCN} SELECT o AS "order", g AS ngram FROM cnt WHERE NOT (o = 2 AND first IN ({BOUNDARY})) GROUP BY o, g')
def boundary_filter(spark, folder):
    return _doc_gram_rows(spark, folder).select("order", "ngram").distinct().where(~T.boundary_bigram(F.col("ngram")))


@query(
    f"""WITH {DOCN} SELECT DISTINCT g AS ngram, regexp_replace(regexp_replace(g, '^(a|an|the|to)( |$)', ''), '(^| )(a|an|the|to)$', '') AS stripped FROM cnt"""
)
def boundary_strip(spark, folder):
    return _doc_gram_rows(spark, folder).select("ngram").distinct().select("ngram", T.strip_boundaries(F.col("ngram")).alias("stripped"))


GERUND = """CASE WHEN regexp_matches(t, '^.{3,}?ing$') THEN
  CASE WHEN right(left(t, length(t) - 3), 1) = left(right(left(t, length(t) - 3), 2), 1) THEN left(t, length(t) - 4) ELSE left(t, length(t) - 3) END ELSE t END"""


@query(f"WITH {TOKENS} SELECT DISTINCT t AS token, {GERUND} AS stem FROM tok")
def gerund_rule(spark, folder):
    t = _docs(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", T.gerund(F.col("token")).alias("stem"))


# Sources have no apostrophes: one is put after every "e" that ends a word.
@query(r"SELECT doc_id, md5(regexp_replace(replace(coalesce(text, ''), 'e ', 'e''s '), '([\p{L}\p{N}_]+)''s ', '\1 ', 'g')) AS digest FROM documents")
def strip_possessive(spark, folder):
    made = F.replace(F.coalesce("text", F.lit("")), F.lit("e "), F.lit("e's "))
    return _docs(spark, folder).select("doc_id", F.md5(T.strip_possessive(made).cast("binary")).alias("digest"))


_LEXICON = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(domain_lexicon().items()))


@query(
    f"""WITH {TOKENS}, mine AS (SELECT t || 'in' AS t FROM tok UNION ALL SELECT t FROM tok)
    SELECT t AS token, coalesce(v, t) AS replaced, count(*) AS n FROM mine LEFT JOIN (VALUES {_LEXICON}) x(k, v) ON k = t GROUP BY t, v"""
)
def domain_lexicon_lookup(spark, folder):
    words = _docs(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = words.unionByName(words.select(F.concat("token", F.lit("in")).alias("token"), "n")).groupBy("token").agg(F.sum("n").alias("n"))
    lexicon = spark.createDataFrame(sorted(domain_lexicon().items()), "token string, word string")
    return words.join(F.broadcast(lexicon), "token", "left").select("token", F.coalesce("word", "token").alias("replaced"), "n")


def _contraction_cases() -> list[tuple[int, str, str]]:
    """Every contraction that stands between blanks as a whole (begins and ends
    with a letter, and with no earlier entry before an apostrophe), small and
    with a capital, and what it stands for."""
    earlier, plain = [], []
    for c, full in CONTRACTIONS.items():
        if c[0].isalpha() and c[-1].isalpha() and not any(c.startswith(e + "'") for e in earlier):
            plain += [(c, full), (c[0].upper() + c[1:], full[0].upper() + full[1:].lower())]
        earlier.append(c)
    return [(k, *pair) for k, pair in enumerate(plain)]


_CASES = _contraction_cases()
_CASE_VALUES = ", ".join("({}, {}, {})".format(k, *("'" + x.replace("'", "''") + "'" for x in pair)) for k, *pair in _CASES)


# The texts have no contractions of their own.
@query(
    f"""SELECT doc_id, replace(coalesce(text, ''), ' a ', ' ' || expansion || ' ') AS expanded
    FROM documents JOIN (VALUES {_CASE_VALUES}) v(k, contraction, expansion) ON k = doc_id % {len(_CASES)}"""
)
def contractions_expanded(spark, folder):
    """Contractions written out; each document has another one put into its text, in place of an article."""
    cases = F.array(*(F.lit(c) for _, c, _ in _CASES))
    put = F.concat(F.lit(" "), F.get(cases, F.pmod("doc_id", F.lit(len(_CASES)))), F.lit(" "))
    made = F.replace(F.coalesce("text", F.lit("")), F.lit(" a "), put)
    return _docs(spark, folder).select("doc_id", T.expand_contractions(made).alias("expanded"))


def lemmatize(docs: DataFrame, text: str = "text", dictionary: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``lemmatized``: per line and word the domain lexicon, the
    gerund rule and ``dictionary`` (a lemma of each known word; a parameter, as
    no lexical database is at hand); fillers, single characters and words with
    digits are dropped."""

    def look(words: dict[str, str], w):
        """The hashed set of keys decides first; only words in it search the map."""
        if not words:
            return w
        pairs = F.create_map(*(F.lit(x) for pair in sorted(words.items()) for x in pair))
        return F.when(w.isin(*sorted(words)), F.try_element_at(pairs, w)).otherwise(w)

    lines = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda line: F.array_join(
            F.filter(F.transform(F.transform(T.tokens(line), lambda w: look(domain_lexicon(), w)), lambda w: look(dictionary or {}, T.gerund(w))), T.keep_lemma), " "
        ),
    )
    return docs.withColumn("lemmatized", F.array_join(lines, "\n"))


_RULE_VALUES = ", ".join(f"('{p}', '{old}', '{new}', {k})" for p, rules in morphology.RULES.items() for k, (old, new) in enumerate(rules))


@query(
    f"""WITH RECURSIVE {TOKENS}, w AS (SELECT DISTINCT t AS word, pos FROM tok, (VALUES ('n'), ('v'), ('a'), ('r')) p(pos)),
    dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '{P}')) AS form FROM benchmark),
    rules(pos, old, new, k) AS (VALUES {_RULE_VALUES}),
    forms(word, pos, depth, place, form) AS (
      SELECT word, pos, 0, [0], word FROM w
      UNION ALL SELECT f.word, f.pos, f.depth + 1, f.place || [r.k], left(f.form, length(f.form) - length(r.old)) || r.new
      FROM forms f JOIN rules r ON r.pos = f.pos AND ends_with(f.form, r.old) AND length(f.form) + length(r.new) > length(r.old)),
    best AS (SELECT f.word, f.pos, arg_min(f.form, (greatest(depth, 1), length(f.form), depth, place)) AS lemma FROM forms f SEMI JOIN dict USING (form) GROUP BY f.word, f.pos)
    SELECT w.word, w.pos, coalesce(best.lemma, w.word) AS lemma FROM w LEFT JOIN best ON best.word = w.word AND best.pos = w.pos"""
)
def dictionary_lemmas(spark, folder):
    """Lemmas of all words of ``documents`` in each word class, by the words of ``benchmark`` as a dictionary."""
    words = _docs(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    classes = words.select("word", F.explode(F.array(*(F.lit(p) for p in "nvar"))).alias("pos"))
    entries = tables.parquet(spark, folder, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("lemma")).distinct()
    return morphology.dictionary_lemmas(classes, entries.withColumn("pos", F.lit(None).cast("string")))


@query(
    f"""WITH ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    tk AS (SELECT doc_id, k, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, k, regexp_extract_all(lower(line), '{P}') AS l FROM ln)),
    lx AS (SELECT doc_id, k, p, coalesce(v, t) AS t FROM tk LEFT JOIN (VALUES {_LEXICON}) x(token, v) ON token = t),
    kp AS (SELECT * FROM (SELECT doc_id, k, p, {GERUND} AS t FROM lx) WHERE length(t) > 1 AND t NOT IN ({_quoted(FILLERS)}) AND NOT regexp_matches(t, '\\p{{Nd}}')),
    jn AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY p) AS line FROM kp GROUP BY doc_id, k)
    SELECT ln.doc_id, string_agg(coalesce(jn.line, ''), chr(10) ORDER BY ln.k) AS lemmatized FROM ln LEFT JOIN jn ON jn.doc_id = ln.doc_id AND jn.k = ln.k GROUP BY ln.doc_id"""
)
def lemmatized_documents(spark, folder):
    return lemmatize(_docs(spark, folder)).select("doc_id", "lemmatized")


@query(f"WITH {TOKENS} SELECT DISTINCT t AS token FROM tok WHERE length(t) > 1 AND t NOT IN ({_quoted(FILLERS)}) AND NOT regexp_matches(t, '\\p{{Nd}}')")
def kept_lemmas(spark, folder):
    """Different words that are no filler, longer than a character and without digits."""
    t = _docs(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return t.where(T.keep_lemma(F.col("token")))


@query(
    f"""WITH {TOKENS} SELECT DISTINCT t AS tag, CASE upper(left(t, 1)) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'N' THEN 'n' WHEN 'R' THEN 'r' END AS pos FROM tok"""
)
def pos_map(spark, folder):
    """Word classes of treebank tags, whatever their case; words stand for tags."""
    t = _docs(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("tag")).distinct()
    return t.select("tag", annotated.wordnet_pos(F.col("tag")).alias("pos"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace('[Intro] ' || coalesce(text, '') || ' *x2* ', '\[[^\[\]]*\]', '', 'g'), '\*+', '', 'g'))) AS digest FROM documents""")
def marks_cleaned(spark, folder):
    """Texts without bracketed parts and asterisks; both are put in."""
    made = F.concat(F.lit("[Intro] "), F.coalesce("text", F.lit("")), F.lit(" *x2* "))
    return _docs(spark, folder).select("doc_id", F.md5(annotated.clean_marks(made).cast("binary")).alias("digest"))


# A stand-in for tags: the part of speech by the length of the word.
_POS = ("NOUN", "DET", "ADP", "VERB", "ADJ", "PART", "X")
TAGGED = f"""{CONV}, pos AS (SELECT doc_id, turn, p, t, ['NOUN', 'DET', 'ADP', 'VERB', 'ADJ', 'PART', 'X'][length(t) % 7 + 1] AS pos,
  t IN ({_quoted(STOPWORDS)}) AS stop FROM tok),
near2 AS (SELECT *, lead(t) OVER w AS t1, lead(pos) OVER w AS pos1, lead(stop) OVER w AS stop1 FROM pos WINDOW w AS (PARTITION BY doc_id, turn ORDER BY p)),
valid AS (SELECT doc_id, t AS g FROM near2 WHERE pos IN ('NOUN', 'VERB', 'ADJ') AND NOT stop
  UNION ALL SELECT doc_id, t || '_' || t1 FROM near2 WHERE t1 IS NOT NULL AND (pos IN ('NOUN', 'VERB', 'ADJ') OR pos1 IN ('NOUN', 'VERB', 'ADJ'))
    AND NOT (stop AND stop1) AND pos NOT IN ('DET', 'ADP', 'PART') AND pos1 NOT IN ('DET', 'ADP', 'PART'))"""


@query(f"WITH {TAGGED} SELECT g AS ngram, count(*) AS n FROM valid GROUP BY g")
def tagged_ngrams(spark, folder):
    """Valid n-grams of tagged words; tags by word length, as no tagger is at hand."""
    tags = F.array(*(F.lit(p) for p in _POS))
    words = F.transform(T.tokens(F.col("text")), lambda t: F.struct(t.alias("lemma"), F.element_at(tags, F.length(t) % 7 + 1).alias("pos")))
    stop = F.array(*(F.lit(w) for w in sorted(STOPWORDS)))
    rows = _conv(spark, folder).select(words.alias("_w"))  # a column of its own: tagged once, not for each n-gram
    grams = rows.select(F.explode(annotated.valid_ngrams(F.col("_w"), stop, (1, 2))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("n"))


@query("SELECT floor(n / 100)::BIGINT AS bucket, count(*) AS docs FROM (SELECT len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS n FROM documents) GROUP BY ALL")
def tokens_per_doc_histogram(spark, folder):
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    return _docs(spark, folder).select(F.floor(n / 100).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("docs"))


# --- counts, modes, splits ----------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def genre_counts(spark, folder):
    return grouping.counts(_orders(spark, folder), "o_orderpriority")


@query("SELECT lang, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY lang")
def genre_rel_freq(spark, folder):
    return grouping.relative_frequency(_docs(spark, folder), "lang")


@query(
    """SELECT coalesce(a.role, b.role) AS role, coalesce(a.s, 0) AS left_share, coalesce(b.s, 0) AS right_share FROM
    (SELECT role, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM conversations WHERE conv_id % 5 <> 0 GROUP BY role) a FULL JOIN
    (SELECT role, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM conversations WHERE conv_id % 5 = 0 GROUP BY role) b ON a.role = b.role"""
)
def genre_freq_compare(spark, folder):
    """Role shares of the training and test fold."""
    c = tables.parquet(spark, folder, "conversations")
    return grouping.compare_frequencies(c.where("conv_id % 5 <> 0"), c.where("conv_id % 5 = 0"), "role")


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_kept, round(count(*) FILTER (n_chars > 1000)::DOUBLE / count(*) * 100, 2) AS percent FROM documents GROUP BY lang")
def genre_filter_rate(spark, folder):
    return grouping.filter_rate(_docs(spark, folder), F.col("n_chars") > 1000, "lang")


@query(
    """SELECT round((2 * sum(i * n)::DOUBLE / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*)) * count(*) / (count(*) - 1), 9) AS gini, count(*) AS classes
    FROM (SELECT n, row_number() OVER (ORDER BY n, source) AS i FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))"""
)
def genre_gini(spark, folder):
    return grouping.gini(_docs(spark, folder), "source").withColumn("gini", F.round("gini", 9))


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality, toxic")
def confusion_matrix(spark, folder):
    return metrics.confusion(tables.parquet(spark, folder, "labels"), "quality", "toxic")


MODES = """n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority),
g AS (SELECT o_orderpriority, count(*) AS overall FROM orders GROUP BY o_orderpriority)"""


@query(
    f"""WITH {MODES} SELECT o_custkey, o_orderpriority, n FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, overall, o_orderpriority) AS r FROM n JOIN g USING (o_orderpriority)) WHERE r = 1"""
)
def artist_genre_mode(spark, folder):
    return grouping.mode_rarer(_orders(spark, folder), "o_custkey", "o_orderpriority")


@query(f"WITH {MODES} SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM n) WHERE r = 1")
def group_label_mode(spark, folder):
    return grouping.mode_first(_orders(spark, folder), "o_custkey", "o_orderpriority")


@query(f"WITH {MODES} SELECT o_custkey, o_orderpriority, n FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS r FROM n) WHERE r = 1")
def artist_genre_mode_ties(spark, folder):
    return grouping.mode_ties(_orders(spark, folder), "o_custkey", "o_orderpriority")


_A = "((({k} % 999983) * 7919 + 42 * 104729 + 12345) % 999983)"
HASH = f"(({_A} * {_A} + 31 * {_A}) % 999983)"


SPLIT = f"""{MODES},
    m AS (SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM n) WHERE r = 1),
    s AS (SELECT o_orderpriority, count(*) * 0.2::DOUBLE AS quota FROM m GROUP BY o_orderpriority),
    q AS (SELECT o_orderpriority, floor(quota) + CASE WHEN row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, o_orderpriority)
      <= (SELECT ceil(count(*) * 0.2::DOUBLE) FROM m) - (SELECT sum(floor(quota)) FROM s) THEN 1 ELSE 0 END AS take FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASH.format(k="o_custkey")}, o_custkey) AS r FROM m),
    sp AS (SELECT o_custkey, o_orderpriority, CASE WHEN r <= take THEN 'test' ELSE 'train' END AS part FROM r JOIN q USING (o_orderpriority))"""


@query(f"WITH {SPLIT} SELECT o_custkey, o_orderpriority, part FROM sp")
def group_split(spark, folder):
    return grouping.group_split(_orders(spark, folder), "o_custkey", "o_orderpriority")


@query(f"WITH {SPLIT} SELECT count(*) AS members_in_both FROM (SELECT o_custkey FROM sp WHERE part = 'test' INTERSECT SELECT o_custkey FROM sp WHERE part = 'train')")
def split_overlap(spark, folder):
    """Members that both parts of a split have: none."""
    parts = grouping.group_split(_orders(spark, folder), "o_custkey", "o_orderpriority")
    both = parts.where("part = 'test'").join(parts.where("part = 'train'").select("o_custkey"), "o_custkey", "left_semi")
    return both.agg(F.count("*").alias("members_in_both"))


@query(f"SELECT doc_id, lang FROM documents ORDER BY {HASH.format(k='doc_id')}, doc_id LIMIT 5")
def sample_rows(spark, folder):
    """A random sample of five rows, for a log."""
    return _docs(spark, folder).select("doc_id", "lang").orderBy(grouping.arithmetic_hash(F.col("doc_id"), 42), "doc_id").limit(5)


@query(f"SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(k='doc_id')}, doc_id) - 1) % 5)::INT AS fold FROM documents")
def kfold_assign(spark, folder):
    return grouping.kfold(_docs(spark, folder), "doc_id", "lang")


@query(
    f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(k='doc_id')}, doc_id) AS r,
    count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= ceil(n * 0.3::DOUBLE)"""
)
def stratified_subsample(spark, folder):
    return grouping.stratified_subsample(_docs(spark, folder).select("doc_id", "lang"), "doc_id", "lang", 0.3)


@query(
    f"""WITH n AS (SELECT o_orderpriority AS drawn, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_orderpriority),
    c AS (SELECT drawn, (sum(n) OVER (ORDER BY drawn) - n)::DOUBLE / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY drawn)::DOUBLE / sum(n) OVER () AS hi FROM n)
    SELECT o_orderkey, o_orderpriority, drawn FROM orders JOIN c ON {HASH.format(k="o_orderkey")} / 999983::DOUBLE >= lo AND {HASH.format(k="o_orderkey")} / 999983::DOUBLE < hi WHERE o_orderkey % 5 = 0"""
)
def random_baseline(spark, folder):
    o = _orders(spark, folder)
    return grouping.random_baseline(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), "o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, l_partkey AS term_idx, sum(l_quantity) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey")
def artist_dtm(spark, folder):
    rows = tables.parquet(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("term_idx"), F.col("l_quantity").alias("cnt"))
    return terms.aggregate_rows(rows.join(_orders(spark, folder).select("o_orderkey", "o_custkey"), "o_orderkey"), "o_custkey")


@query("SELECT conv_id, quantile_cont(turn, 0.5) AS median_turn, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def artist_lyrics_agg(spark, folder):
    c = tables.parquet(spark, folder, "conversations")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return c.groupBy("conv_id").agg(F.percentile("turn", 0.5).alias("median_turn"), F.md5(joined.cast("binary")).alias("digest"))


# --- terms --------------------------------------------------------------------


@query(f'WITH {CONV} SELECT doc_id, turn, o AS "order", g AS ngram, cnt FROM cnt')
def dtm_counts(spark, folder):
    return _conv_grams(spark, folder).select("doc_id", "turn", "order", "ngram", "cnt")


@query(f'WITH {CONV} SELECT row_number() OVER (ORDER BY o, g) - 1 AS term_idx, o AS "order", g AS ngram FROM (SELECT DISTINCT o, g FROM cnt)')
def vocab_build(spark, folder):
    return terms.vocabulary(_conv_gram_rows(spark, folder))


@query(
    f"""WITH {CONV}, a AS (SELECT g, row_number() OVER (ORDER BY o, g) - 1 AS old_idx FROM (SELECT DISTINCT o, g FROM cnt WHERE role = 'user')),
    b AS (SELECT g, row_number() OVER (ORDER BY o, g) - 1 AS new_idx FROM (SELECT DISTINCT o, g FROM cnt WHERE role = 'assistant'))
    SELECT g AS ngram, old_idx, new_idx FROM a JOIN b USING (g)"""
)
def vocab_align(spark, folder):
    g = _conv_gram_rows(spark, folder)
    return terms.align_vocabularies(terms.vocabulary(g.where("role = 'user'")), terms.vocabulary(g.where("role = 'assistant'")))


@query(f'WITH {CONV} SELECT o AS "order", g AS ngram, count(DISTINCT artist) AS artists FROM cnt GROUP BY o, g')
def ngram_artist_count(spark, folder):
    return terms.artists_per_ngram(_conv_grams(spark, folder), "artist")


@query(f'WITH {TFIDF} SELECT o AS "order", role, g AS ngram, c AS "count", round(tf, 9) AS tf, round(idf, 9) AS idf, round(tf * idf, 9) AS tfidf FROM s')
def genre_tfidf(spark, folder):
    s = terms.class_tfidf(_conv_grams(spark, folder, (1, 2, 3)), "role")
    return s.select("order", "role", "ngram", "count", *(F.round(c, 9).alias(c) for c in ("tf", "idf", "tfidf")))


def _fs_top(spark, folder, k=100):
    g = _conv_grams(spark, folder, (1, 2, 3))
    scores = terms.class_tfidf(g, "role").withColumn("tfidf", F.round("tfidf", 12))
    enough = terms.artists_per_ngram(g, "artist").where("artists >= 20").select("order", "ngram")
    return terms.top_by_class(scores.join(enough, ["order", "ngram"], "left_semi"), "role", k)


@query(f'WITH {TFIDF} SELECT o AS "order", role, g AS ngram, rank FROM top WHERE rank <= 100')
def fs_topk(spark, folder):
    return _fs_top(spark, folder).select("order", "role", "ngram", F.col("rank").cast("long").alias("rank"))


@query(f'WITH {TFIDF} SELECT row_number() OVER (ORDER BY o, g) - 1 AS term_idx, o AS "order", g AS ngram FROM (SELECT DISTINCT o, g FROM top WHERE rank <= 100)')
def fs_vocab(spark, folder):
    return terms.vocabulary(_fs_top(spark, folder))


@query(
    f"""WITH {TFIDF}, v AS (SELECT row_number() OVER (ORDER BY o, g) - 1 AS term_idx, o, g FROM (SELECT DISTINCT o, g FROM top WHERE rank <= 100))
    SELECT doc_id, turn, term_idx, cnt FROM cnt JOIN v USING (o, g)"""
)
def fs_transform(spark, folder):
    keys = ["doc_id", "turn", "role", "artist"]
    return terms.transform_documents(tables.spread(_conv(spark, folder)), keys, "text", (1, 2, 3), terms.vocabulary(_fs_top(spark, folder))).select("doc_id", "turn", "term_idx", "cnt")


@query(f'WITH {MONROE} SELECT o AS "order", g AS ngram, role, y::BIGINT AS y FROM y')
def monroe_counts(spark, folder):
    rows = terms.ngram_rows(_conv(spark, folder), ["role", "artist"], "text", (1, 2, 3, 4))
    return terms.class_counts(rows, "role", "artist", labels=terms.classes(_conv(spark, folder), "role"))


@query(f'WITH {MONROE} SELECT o AS "order", g AS ngram, role, round(z, 6) AS z FROM z')
def monroe_z(spark, folder):
    rows = terms.ngram_rows(_conv(spark, folder), ["role", "artist"], "text", (1, 2, 3, 4))
    return terms.log_odds(rows, "role", "artist", labels=terms.classes(_conv(spark, folder), "role")).withColumn("z", F.round("z", 6))


@query(f"""WITH {MONROE} SELECT o AS "order", g AS ngram, role, round({upper_tail_sql("z")}, 9) AS p FROM z""")
def monroe_p(spark, folder):
    """One-sided p-values of the log odds."""
    rows = terms.ngram_rows(_conv(spark, folder), ["role", "artist"], "text", (1, 2, 3, 4))
    scores = terms.log_odds(rows, "role", "artist", labels=terms.classes(_conv(spark, folder), "role"))
    return scores.select("order", "ngram", "role", F.round(upper_tail(F.col("z")), 9).alias("p"))


def _document_scores(spark, folder) -> DataFrame:
    """Of all orders jointly; ``source`` has 20 values, of which an n-gram must be in two."""
    docs = tables.spread(_docs(spark, folder).select("lang", "source", "text"))
    return terms.document_log_odds(docs, "text", (1, 2, 3, 4), "lang", "source", labels=terms.classes(_docs(spark, folder), "lang"), min_artists=2)


@query(f'WITH {MONROE_VOCAB} SELECT term_idx, o AS "order", g AS ngram FROM mv')
def monroe_vocab(spark, folder):
    return terms.select_by_log_odds(_document_scores(spark, folder), 0.001)


@query(f"WITH {MONROE_VOCAB} SELECT doc_id, term_idx, cnt FROM cnt JOIN mv USING (o, g)")
def monroe_transform(spark, folder):
    vocab = terms.select_by_log_odds(_document_scores(spark, folder), 0.001)
    docs = tables.spread(_docs(spark, folder).select("doc_id", "lang", "source", "text"))
    return terms.transform_documents(docs, ["doc_id", "lang", "source"], "text", (1, 2, 3, 4), vocab).select("doc_id", "term_idx", "cnt")


P_VALUE = "l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem)"


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, {P_VALUE} * {P_VALUE} * {P_VALUE} AS p FROM lineitem),
    r AS (SELECT p, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER () AS m FROM p),
    c AS (SELECT max(p) AS cut FROM r WHERE p <= (0.3::DOUBLE * r) / m)
    SELECT l_orderkey, l_linenumber, round(p, 9) AS p, coalesce(p <= (SELECT cut FROM c), false) AS passes_bh FROM p"""
)
def bh_fdr(spark, folder):
    line = tables.parquet(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    x = F.col("l_extendedprice") / F.col("top")
    tests = line.crossJoin(F.broadcast(line.agg(F.max("l_extendedprice").alias("top")))).select("l_orderkey", "l_linenumber", (x * x * x).alias("p"))
    return terms.benjamini_hochberg(tests, 0.3).withColumn("p", F.round("p", 9))


WEIGHTS = "w AS (SELECT l_returnflag AS topic, l_partkey AS term, sum(l_quantity) AS w FROM lineitem GROUP BY l_returnflag, l_partkey)"
FREX = f"""{WEIGHTS}, b AS (SELECT *, w / sum(w) OVER (PARTITION BY topic) AS beta, sum(w) OVER (PARTITION BY term) / sum(w) OVER () AS pt FROM w),
e AS (SELECT *, round(beta / sum(beta) OVER (PARTITION BY term), 12) AS ex, round(beta, 15) AS rb FROM b),
r AS (SELECT *, (rank() OVER (PARTITION BY topic ORDER BY rb) + (count(*) OVER (PARTITION BY topic, rb) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY topic) AS f1,
  (rank() OVER (PARTITION BY topic ORDER BY ex) + (count(*) OVER (PARTITION BY topic, ex) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY topic) AS e1 FROM e),
frex AS (SELECT topic, term, beta, beta / pt AS lift, 1 / (0.7::DOUBLE / f1 + 0.3::DOUBLE / e1) AS frex FROM r)"""


def _weights(spark, folder):
    line = tables.parquet(spark, folder, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("topic"), F.col("l_partkey").alias("term")).agg(F.sum("l_quantity").alias("w"))


@query(
    """WITH p AS (SELECT l_partkey AS doc, l_returnflag AS topic, sum(l_quantity) AS w FROM lineitem GROUP BY l_partkey, l_returnflag),
    s AS (SELECT doc, topic, w / sum(w) OVER (PARTITION BY doc) AS share FROM p)
    SELECT x.topic AS a, y.topic AS b, round(corr(x.share, y.share), 6) AS r FROM s x JOIN s y ON x.doc = y.doc AND x.topic < y.topic GROUP BY x.topic, y.topic"""
)
def topic_correlation(spark, folder):
    w = _weights(spark, folder)
    total = w.groupBy("term").agg(F.sum("w").alias("all"))
    shares = w.join(total, "term").select(F.col("term").alias("doc"), "topic", (F.col("w") / F.col("all")).alias("share"))
    return topics.topic_correlation(shares, "doc", "topic", "share").withColumn("r", F.round("r", 6))


@query(f"WITH {WEIGHTS}, b AS (SELECT *, w / sum(w) OVER (PARTITION BY topic) AS beta, sum(w) OVER (PARTITION BY term) / sum(w) OVER () AS pt FROM w) SELECT topic, term, round(beta, 9) AS beta, round(beta / pt, 9) AS lift FROM b")
def lift_scores(spark, folder):
    return terms.frex(_weights(spark, folder), "topic", "term").select("topic", "term", F.round("beta", 9).alias("beta"), F.round("lift", 9).alias("lift"))


@query(f"WITH {FREX} SELECT topic, term, round(frex, 6) AS frex FROM frex")
def frex_scores(spark, folder):
    return terms.frex(_weights(spark, folder), "topic", "term").select("topic", "term", F.round("frex", 6).alias("frex"))


@query(
    f"""WITH {FREX}, k AS (SELECT r.topic, 1 / (0.7::DOUBLE / e1 + 0.3::DOUBLE / f1) AS score, row_number() OVER (PARTITION BY r.topic ORDER BY r.w DESC, r.term) AS place FROM r)
    SELECT topic, round(sum(score), 6) AS exclusivity FROM k WHERE place <= 10 GROUP BY topic"""
)
def topic_exclusivity(spark, folder):
    return terms.exclusivity(_weights(spark, folder), "topic", "term").select("topic", F.round("exclusivity", 6).alias("exclusivity"))


@query(
    f"""WITH {TOKENS}, pres AS (SELECT DISTINCT doc_id, t FROM tok),
    w AS (SELECT lang AS topic, t, count(*) AS w FROM tok WHERE lang IS NOT NULL GROUP BY lang, t),
    top AS (SELECT * FROM (SELECT topic, t, row_number() OVER (PARTITION BY topic ORDER BY w DESC, t) AS rank FROM w) WHERE rank <= 10),
    pairs AS (SELECT a.topic, a.t AS high, b.t AS low FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank),
    n AS (SELECT t, count(*) AS n FROM pres GROUP BY t),
    nb AS (SELECT p.topic, p.high, p.low, count(*) AS n FROM pairs p JOIN pres x ON x.t = p.high JOIN pres y ON y.t = p.low AND y.doc_id = x.doc_id GROUP BY ALL)
    SELECT p.topic, round(sum(ln((coalesce(nb.n, 0) + 0.01::DOUBLE) / (n.n + 0.01::DOUBLE))), 6) AS coherence
    FROM pairs p JOIN n ON n.t = p.high LEFT JOIN nb ON nb.topic = p.topic AND nb.high = p.high AND nb.low = p.low GROUP BY p.topic"""
)
def topic_coherence(spark, folder):
    """Semantic coherence of the ten commonest words of each language in all documents."""
    words = _docs(spark, folder).select("doc_id", "lang", F.explode(T.tokens(F.col("text"))).alias("term"))
    weights = words.where("lang is not null").groupBy(F.col("lang").alias("topic"), "term").agg(F.count("*").alias("w"))
    top = terms.top_terms(weights, "topic", "term", "w", 10)
    found = topics.semantic_coherence(words.select(F.col("doc_id").alias("doc"), "term").distinct(), terms.written(top, "top"))
    return found.select("topic", F.round("coherence", 6).alias("coherence"))


@query(f"WITH {WEIGHTS} SELECT topic, term, w, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS r FROM w) WHERE r <= 10")
def top_terms(spark, folder):
    return terms.top_terms(_weights(spark, folder), "topic", "term", "w", 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {WEIGHTS} SELECT topic, term, w, r AS rank FROM (SELECT topic, term, w - 250 AS w, row_number() OVER (PARTITION BY topic ORDER BY abs(w - 250) DESC, term) AS r FROM w) WHERE r <= 20")
def top_coefs(spark, folder):
    """Greatest weights by size, whatever the sign."""
    w = _weights(spark, folder).withColumn("w", F.col("w") - 250).withColumn("size", F.abs("w"))
    return terms.top_terms(w, "topic", "term", "size", 20).select("topic", "term", "w", F.col("rank").cast("long").alias("rank"))


# --- agreement ------------------------------------------------------------------


def _wide(spark, folder):
    e = tables.parquet(spark, folder, "events")
    names = sorted(r[0] for r in e.where("event_type is not null").select("event_type").distinct().collect())  # a handful of kinds
    wide = e.groupBy("user_id").pivot("event_type", names).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("user_id", *(F.col(f"`{c}`").alias(f"cat5_n_{c}") for c in names))


VOTES = """votes AS (SELECT u.user_id, t.event_type AS genre, count(e.event_id) AS votes FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
  LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY u.user_id, t.event_type)"""
CDF = f"""{VOTES}, cdf AS (SELECT user_id, genre, (sum(votes) OVER w - votes)::DOUBLE / sum(votes) OVER (PARTITION BY user_id) AS lo,
  sum(votes) OVER w::DOUBLE / sum(votes) OVER (PARTITION BY user_id) AS cdf FROM votes WINDOW w AS (PARTITION BY user_id ORDER BY genre ROWS UNBOUNDED PRECEDING))"""
CDF = CDF.replace("sum(votes) OVER w::DOUBLE", "(sum(votes) OVER w)::DOUBLE")


def _draws(rater: int) -> str:
    a = f"((user_id * 7919 + i * 104729 + {rater * 15_485_863 + 12_345}) % 999983)"
    return f"((({a} * {a} + 31 * {a} + user_id) % 999983) + 0.5::DOUBLE) / 999983"


ITERATIONS = 10_000
IRA = f"""{CDF}, u AS (SELECT user_id, i, {_draws(0)} AS u0, {_draws(1)} AS u1 FROM (SELECT DISTINCT user_id FROM cdf) CROSS JOIN range({ITERATIONS}) r(i)),
d AS (SELECT user_id, i, (SELECT min_by(genre, c.cdf) FROM cdf c WHERE c.user_id = u.user_id AND u.u0 <= c.cdf AND NOT (u.u0 <= c.lo)) AS a,
  (SELECT min_by(genre, c.cdf) FROM cdf c WHERE c.user_id = u.user_id AND u.u1 <= c.cdf AND NOT (u.u1 <= c.lo)) AS b FROM u),
t AS (SELECT i, g.genre, count(*) FILTER (a = g.genre AND b = g.genre) AS tp, count(*) FILTER (a <> g.genre AND b = g.genre) AS fp, count(*) FILTER (a = g.genre AND b <> g.genre) AS fn
  FROM d CROSS JOIN (SELECT DISTINCT genre FROM cdf) g GROUP BY i, g.genre),
mc AS (SELECT i::INT AS iteration, genre, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM t)"""


@query(f"WITH {VOTES} SELECT user_id, genre, votes FROM votes")
def votes_unpivot(spark, folder):
    return agreement.unpivot_votes(_wide(spark, folder), "user_id", 5)


@query(f"WITH {VOTES} SELECT user_id, genre, votes FROM votes WHERE NOT regexp_matches(genre, '(?i)CLICK|login')")
def votes_drop_cols(spark, folder):
    return agreement.unpivot_votes(tables.drop_matching(_wide(spark, folder), "CLICK|login"), "user_id", 5)


@query(f"WITH {CDF} SELECT user_id, genre, round(cdf, 9) AS cdf FROM cdf")
def vote_cdf(spark, folder):
    return agreement.vote_cdf(agreement.unpivot_votes(_wide(spark, folder), "user_id", 5), "user_id").select("user_id", "genre", F.round("cdf", 9).alias("cdf"))


def _simulated(spark, folder):
    return agreement.simulate(agreement.unpivot_votes(_wide(spark, folder), "user_id", 5), "user_id", ITERATIONS)


@query(f"WITH {IRA} SELECT iteration, genre, round(f1, 9) AS f1 FROM mc")
def ira_mc(spark, folder):
    return _simulated(spark, folder).withColumn("f1", F.round("f1", 9))


@query(
    f"""WITH {IRA}, x AS (SELECT genre, f1 FROM mc UNION ALL SELECT 'macro', avg(f1) FROM mc GROUP BY iteration)
    SELECT genre, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM x GROUP BY genre"""
)
def ira_summary(spark, folder):
    return agreement.summary(_simulated(spark, folder)).select("genre", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, count(value) AS n FROM events GROUP BY event_type")
def cv_mean_se(spark, folder):
    s = agreement.mean_and_error(tables.parquet(spark, folder, "events"), "event_type", "value")
    return s.select("event_type", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), "n")


# --- metrics ----------------------------------------------------------------------

TALLY = """l AS (SELECT quality AS t, toxic AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
k AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn
  FROM (SELECT t AS label FROM l UNION SELECT p FROM l) CROSS JOIN l GROUP BY label),
s AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM k)"""


def _labels(spark, folder):
    return tables.parquet(spark, folder, "labels")


@query(f"WITH {TALLY} SELECT label, tp, fp, fn, precision, recall, f1, support FROM s")
def per_class_f1(spark, folder):
    return metrics.per_class(_labels(spark, folder), "quality", "toxic")


@query(f"WITH {TALLY} SELECT round(avg(f1), 9) AS macro_f1, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall FROM s")
def macro_metrics(spark, folder):
    names = ("macro_f1", "macro_precision", "macro_recall")
    return metrics.macro(_labels(spark, folder), "quality", "toxic").select(*(F.round(c, 9).alias(c) for c in names))


@query(
    f"""WITH {TALLY}, o AS (SELECT sum(tp)::DOUBLE / sum(support) AS po, sum((tp + fp) * support)::DOUBLE / (sum(support) * sum(support)) AS pe FROM s)
    SELECT round((po - pe) / (1 - pe), 9) AS kappa, round(po, 9) AS accuracy FROM o"""
)
def kappa(spark, folder):
    return metrics.macro(_labels(spark, folder), "quality", "toxic").select(F.round("kappa", 9).alias("kappa"), F.round("accuracy", 9).alias("accuracy"))


@query(
    f"""WITH {TALLY} SELECT label::VARCHAR AS label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM s
    UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM s
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM s"""
)
def classification_report(spark, folder):
    r = metrics.report(_labels(spark, folder), "quality", "toxic")
    return r.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


# --- model selection ---------------------------------------------------------------


def select_local_maximum(series: DataFrame, by: list[str], k: str, value: str) -> DataFrame:
    """First interior local maximum of each series by ``k``, else the greatest value (the first of equals)."""
    known = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    order = Window.partitionBy(*by).orderBy(k)
    near = known.withColumn("before", F.lag(value).over(order)).withColumn("after", F.lead(value).over(order))
    local = F.min(F.when((F.col(value) > F.col("before")) & (F.col(value) > F.col("after")), F.col(k)))
    return near.groupBy(*by).agg(F.coalesce(local, F.max_by(k, F.struct(value, -F.col(k)))).alias("best_k"))


@query(
    """WITH v AS (SELECT user_id, (event_id % 19)::BIGINT AS k, max(value) AS h FROM events GROUP BY user_id, event_id % 19),
    n AS (SELECT *, lag(h) OVER w AS b, lead(h) OVER w AS a FROM v WINDOW w AS (PARTITION BY user_id ORDER BY k))
    SELECT user_id, coalesce(min(k) FILTER (h > b AND h > a), (SELECT k FROM v x WHERE x.user_id = n.user_id ORDER BY h DESC, k LIMIT 1)) AS best_k FROM n GROUP BY user_id"""
)
def select_best_k(spark, folder):
    e = tables.parquet(spark, folder, "events").groupBy("user_id", (F.col("event_id") % 19).alias("k")).agg(F.max("value").alias("h"))
    return select_local_maximum(e, ["user_id"], "k", "h")


def one_standard_error(history: DataFrame, score: str, error: str, parsimony: str, highest: bool = True) -> DataFrame:
    """The candidate of the most parsimonious value among those within one error of the best."""
    finite = history.where(F.col(score).isNotNull() & (F.abs(F.col(score).cast("double")) < float("inf")))
    best = finite.agg(F.max_by(F.struct(F.col(score).alias("s"), F.col(error).alias("e")), F.struct(score, -F.col(error))).alias("best"))
    near = finite.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("best.s") - F.col("best.e")).drop("best")
    order = [F.desc(parsimony) if highest else F.asc(parsimony), F.desc(score)]
    return near.orderBy(*order).limit(1)


@query(
    """WITH h AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se, count(*) AS leaf FROM events GROUP BY event_type),
    b AS (SELECT mean, se FROM h ORDER BY mean DESC, se LIMIT 1)
    SELECT event_type, leaf FROM h WHERE mean >= (SELECT mean - se FROM b) ORDER BY leaf DESC, mean DESC LIMIT 1"""
)
def one_se_rule(spark, folder):
    s = agreement.mean_and_error(tables.parquet(spark, folder, "events"), "event_type", "value")
    return one_standard_error(s.withColumnRenamed("n", "leaf"), "mean", "se", "leaf").select("event_type", "leaf")


@query("SELECT lang, count(*) AS n, (SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*)) AS weight FROM documents GROUP BY lang")
def class_weights(spark, folder):
    """Balanced weights: rows / (classes * rows of the class)."""
    n = grouping.counts(_docs(spark, folder).where("lang is not null"), "lang")
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select("lang", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    SELECT dim::INT AS dim, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY dim"""
)
def std_scale(spark, folder):
    """Population standard deviation of each feature, which scaling without centring divides by."""
    x = tables.parquet(spark, folder, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    v = F.col("v").cast("double")
    return x.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))


@query("SELECT doc_id, n_chars AS style_length, quality AS topic_quality FROM documents JOIN labels USING (doc_id)")
def feature_concat(spark, folder):
    """Features of two tables side by side, by key and not by position."""
    style = _docs(spark, folder).select("doc_id", F.col("n_chars").alias("style_length"))
    return style.join(_labels(spark, folder).select("doc_id", F.col("quality").alias("topic_quality")), "doc_id")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The ten n-grams of orders 1 to 4 of the greatest log odds of each language's documents."""
    scores = _document_scores(spark, folder)
    return terms.top_terms(scores, "lang", "ngram", "z", 10).select("lang", "order", "ngram", F.round("z", 6).alias("z"), "rank")


@query(f'WITH {MONROE_DOCS} SELECT role AS lang, o AS "order", g AS ngram, round(z, 6) AS z FROM z')
def flagship_scores(spark, folder):
    return _document_scores(spark, folder).select("lang", "order", "ngram", F.round("z", 6).alias("z"))
