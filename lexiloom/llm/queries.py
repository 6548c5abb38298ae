"""One query per operator of this package, over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embedding_dedup, fill_in_middle, minhash, pii, quality, secret_scan, sharding, toxicity, url_filter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of ``documents`` as ``labels.quality`` marks it."""
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.3)


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of ``embeddings`` of one label with a cosine of 0.93 or more."""
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"), cosine=0.93)


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def _digest(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    """Counts of the kinds, digest of their spans, and all spans."""
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    of = F.transform(spans, lambda s: s["kind"])
    counts = [F.size(F.filter(of, _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(spans).alias("spans")]


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in ``documents``, and the words next to it that reveal it."""
    found = pii.detect(_table(spark, folder, "documents"))
    return found.select("doc_id", *_digest(F.col("spans"), pii.KINDS))


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of ``documents`` whose two-word shingle sets have a similarity of 0.8 or more."""
    return minhash.near_duplicates(_table(spark, folder, "documents"), shingle=2, percent=80)


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in ``documents``, weak parts only where complementary ones are near."""
    found = secret_scan.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", *_digest(F.col("spans"), secret_scan.KINDS[:3]))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op6_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of ``documents``, and the texts that they decode to, as digests."""
    back = bpe.round_trip(_table(spark, folder, "documents"), tokenizer_path())
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which ``documents`` hold items of ``benchmark``."""
    return decontaminate.flag(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` and one with control strings, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(tricky).alias("text"))
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = chat.format_conversations(turns)
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS merged,
    replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS name
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN merged THEN 7 ELSE 12 + length(name) + 2 + 8 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity grades of ``documents``, learned from ``labels.toxic``."""
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` moved from 16 shards (by hash of the id) to 24 of near equal bytes."""
    plan = sharding.reshard(sharding.measure(_table(spark, folder, "documents"), old_shards=16), 24)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` cut by lines into prefix, suffix and middle, and restored, as digests."""
    done = fill_in_middle.transform(_table(spark, folder, "documents"))
    back = fill_in_middle.restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` on the four greatest components of their distinct vectors, whitened."""
    return whitening.whiten(_table(spark, folder, "embeddings"), components=4, scale=256)


# The rules of the contract.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the URLs of ``pages``, with the links that the pages declare."""
    return url_filter.judge(_table(spark, folder, "pages"), URL_RULES)


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, len(embedding) AS d, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id
"""

OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p, len(l) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents)
), g AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, CASE WHEN n = 1 THEN w ELSE w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY p) END AS g FROM t) WHERE g IS NOT NULL
), s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT g.doc_id, g, n FROM g JOIN s USING (doc_id)),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""


OP11_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), r AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS r1, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS r2, ('0x' || d[25:32])::BIGINT % 100 AS r4,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM h
), c AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS prefix, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
    array_to_string(u[greatest(r1, r2) + 1:], '') AS suffix, CASE WHEN plain THEN 'plain' WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""

OP13_SQL = r"""
WITH RECURSIVE rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?i)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')
), attributes AS (
  SELECT url, lower(tag[2:5]) AS kind, trim(regexp_replace(regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')) AS rel,
    trim(regexp_replace(regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')) AS equiv,
    replace(trim(regexp_replace(regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')), '&amp;', '&') AS href,
    replace(trim(regexp_replace(regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')), '&amp;', '&') AS content
  FROM tags
), links AS (
  SELECT url, CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN trim(regexp_extract(content, '(?i)^[\s0-9.]*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)) END AS link
  FROM attributes
), targets AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN starts_with(link, '?') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || link
    WHEN starts_with(link, '#') THEN url
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || link END AS target
  FROM links WHERE link <> ''
), parts AS (
  SELECT DISTINCT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) AS query
  FROM (SELECT url FROM pages UNION SELECT target FROM targets) WHERE url IS NOT NULL
), keys AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS key FROM parts
), own AS (
  SELECT host, path, arg_max(action, (len(rhost || rpath), action = 'allow')) AS action, arg_max(rhost || rpath, (len(rhost || rpath), action = 'allow')) AS rule
  FROM (SELECT DISTINCT host, path FROM (SELECT host, path FROM keys UNION SELECT host, '/' FROM keys)) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
), edges AS (
  SELECT DISTINCT a.key AS a, b.key AS b FROM targets t JOIN keys a ON a.url = t.url JOIN keys b ON b.url = t.target WHERE a.key <> b.key
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
classes AS (SELECT a AS key, min(b) AS class FROM reach GROUP BY a),
decided AS (
  SELECT class, bool_or(action = 'block') AS blocks, coalesce(bool_or(action = 'allow'), false) AS allows
  FROM classes JOIN (SELECT DISTINCT key, host, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM keys) USING (key) LEFT JOIN own USING (host, path) GROUP BY class
), aliases AS (SELECT key FROM classes JOIN decided USING (class) WHERE blocks AND NOT allows)
SELECT page_id, coalesce(k.host, '') AS host, coalesce(k.path, '') AS path, o.rule, CASE WHEN o.action IS NOT NULL THEN o.action WHEN x.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM pages p LEFT JOIN keys k ON k.url = p.url LEFT JOIN own o ON o.host = k.host AND o.path = k.path LEFT JOIN aliases x ON x.key = k.key
"""


def queries() -> dict[str, Query]:
    found = (
        op1_quality_classifier,
        op2_embedding_near_dedup,
        op3_pii,
        op4_minhash_near_dedup,
        op5_secret_scan,
        op6_byte_level_bpe,
        op7_benchmark_decontamination,
        op8_chat_formatting,
        op9_toxicity,
        op10_sharding,
        op11_fill_in_middle,
        op12_embedding_whitening,
        op13_url_filter,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_near_dedup": OP2_SQL,
        "op4_minhash_near_dedup": OP4_SQL,
        "op8_chat_formatting": OP8_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op13_url_filter": OP13_SQL,
    }
