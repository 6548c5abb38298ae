"""Personal data, and the words that reveal it, with Spark expressions only.

Emails, IP addresses, card and phone numbers are found by pattern.  Each value
found is a protected entity e.  Every other word of a text is a term t, and the
corpus says how much a term tells about an entity.  Over the distinct texts,

    IC(e)     = -log2 p(e)                    what there is to disclose
    PMI(t, e) = log2(p(e|t) / p(e))           what t discloses of it
    hidden    = IC(e) - PMI(t, e)             bits that t leaves hidden

with p(e) the share of all texts that mention e, and p(e|t) that among the
texts with t, taken at its lower confidence bound (Wilson, ``Z`` deviations),
so that a few coincidences don't count: three texts of three leave 0.93 bits
hidden, seven of seven 0.47, two of two 1.23.  A term that discloses at least
half of IC(e) is generalised where at most ``generalise`` bits stay hidden, and
removed where at most ``remove`` do, in every text that holds it, with the
entity or without.

Only entities in ``least(generalise)`` texts or more and terms that are in as
many of those texts can get there; this drops nothing that the bounds would
keep, and it is what keeps the tables of terms small.

Positions come from cutting the text at the matches: the lengths of the pieces
and of the matches add up to the offsets, in code points.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small

KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "cut")  # generalised, removed

# The base patterns, written so that they neither rescan long
# runs nor recurse.  A match begins where the last one ended or where no
# character of its first run precedes; what repeats takes one character a step.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"\p{L}{3,}"

BLOCK = 256  # matches whose positions are added up at a time
GENERALISE, REMOVE = 1.0, 0.5  # bits left hidden
SHARE = 0.5  # of the entity's information
Z = 1.645  # deviations of the lower bound
BROADCAST_ROWS = 100_000  # terms or keys (about 50 bytes each) that go to all executors
SALTS = 64
LISTED_TERMS = 2000  # disclosing terms (a few dozen kilobytes) that are looked up without a join

_EMPTY = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (start, end, value) of the pattern's matches where ``guard`` holds.

    Sums run over blocks of ``BLOCK`` matches, so that the work stays linear in
    their number.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(values, gaps, lambda v, g: F.struct(F.coalesce(F.length(v), F.lit(0)).alias("size"), F.length(g).alias("gap"), v.alias("value")))

    def laid(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(p, b * BLOCK + 1, BLOCK)
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda s, x: s + x["size"] + x["gap"]))
        begins = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        within = lambda b, at: F.aggregate(
            part(b),
            F.struct(at.alias("at"), F.expr(_EMPTY).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        located = F.flatten(F.transform(F.zip_with(blocks, begins, lambda b, at: F.struct(b.alias("b"), at.alias("at"))), lambda z: F.when(z["b"].isNotNull(), within(z["b"], z["at"])).otherwise(F.expr(_EMPTY))))
        return F.filter(located, lambda m: m["value"].isNotNull())

    # transform over a one-element array binds the pairs once.
    found = F.element_at(F.transform(F.array(pairs), laid), 1)
    return F.when(guard, found).otherwise(F.expr(_EMPTY))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    worth = F.transform(
        F.filter(digits, lambda d: d != ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _tagged(found: Column, kind: str, test=None) -> Column:
    kept = F.filter(found, test) if test else found
    return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the base kinds, by kind as listed and start."""
    digit = text.rlike("[0-9]")
    length = lambda m: F.length(_digits(m["value"]))
    return F.concat(
        _tagged(matches(text, EMAIL, F.contains(text, F.lit("@"))), "email"),
        _tagged(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), "ip", lambda m: F.forall(F.split(m["value"], r"\."), _small)),
        _tagged(matches(text, CARD, digit), "card", lambda m: length(m).between(16, 19) & F.when(length(m).between(16, 19), _luhn(m["value"])).otherwise(F.lit(False))),
        _tagged(matches(text, PHONE, F.contains(text, F.lit("+"))), "phone", lambda m: length(m).between(8, 15)),
    )


def lower_bound(n: Column, of: Column) -> Column:
    """Wilson's lower confidence bound of a share n / of."""
    z2 = Z * Z
    p = n / of
    return (p + z2 / (2 * of) - Z * F.sqrt((p * (1 - p) + z2 / (4 * of)) / of)) / (1 + z2 / of)


def least(bits: float) -> int:
    """The fewest texts of as many with which at most ``bits`` stay hidden: n / (n + Z^2) >= 2^-bits."""
    share = 2.0**-bits
    return max(1, math.ceil(Z * Z * share / (1 - share) - 1e-9)) if bits > 0 else 1 << 62


def text_keys(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("key_b")]


KEYS = ["key_a", "key_b"]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    """The distinct lower-cased words outside of emails, the only base spans with letters."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)), F.lower))


def _meet(rows: DataFrame, other: DataFrame, how: str = "inner", weight: Column | None = None) -> DataFrame:
    """``rows`` joined with a written table of one row per text key, where one text may have a third of all rows.

    A small ``other`` is broadcast.  Else every key of ``rows`` is dealt over
    ``SALTS`` tasks, each with its own copy of the other side's rows.
    """
    if small(other, BROADCAST_ROWS, weight):
        return rows.join(F.broadcast(other), KEYS, how)
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [*KEYS, "_salt"], how).drop("_salt")


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if small(table, BROADCAST_ROWS) else table


def disclosing_terms(found: DataFrame, texts: DataFrame, generalise: float, remove: float) -> DataFrame | None:
    """``term, cut`` of the terms that disclose an entity, or None where no entity is in enough texts.

    ``found``: key_a, key_b, entities, words of all rows, as :func:`_found`
    makes them; ``texts``: key_a, key_b, text.  The texts with entities say
    which terms are in enough texts with one; only these are counted in all.
    """
    support = least(generalise)
    mentions = found.where(F.size("entities") > 0).groupBy(*KEYS).agg(F.first("entities").alias("entities"), F.first("words").alias("words"))
    mentions = materialize(mentions, "pii-mentions")
    per_text = mentions.select(*KEYS, F.explode("entities").alias("entity"))
    # Entities of the same texts have the same terms: one of them stands for all.
    marks = F.count("*").alias("n_e"), F.sum(F.xxhash64(*KEYS).cast("decimal(38,0)")).alias("mark_a"), F.sum(F.xxhash64("key_b", "key_a").cast("decimal(38,0)")).alias("mark_b")
    known = per_text.groupBy("entity").agg(*marks).where(F.col("n_e") >= support)
    known = materialize(known.groupBy("n_e", "mark_a", "mark_b").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "pii-entities")
    if known.isEmpty():
        return None
    held = per_text.join(_few(known), "entity").groupBy(*KEYS).agg(F.collect_list(F.struct("entity", "n_e")).alias("e"))
    words = held.join(mentions.select(*KEYS, "words"), KEYS).select("e", F.explode("words").alias("term"))
    both = words.select("term", F.explode("e").alias("e")).groupBy("e.entity", "e.n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    both = materialize(both, "pii-together")
    n_t = _texts_with(found, texts, materialize(both.select("term").distinct(), "pii-candidates"))
    total = float(found.select(*KEYS).distinct().count())
    bound = lower_bound(F.col("n_te").cast("double"), F.col("n_t").cast("double"))
    p_e, hidden = F.col("n_e") / F.lit(total), -F.log2(bound)
    telling = both.join(n_t, "term").where((hidden <= generalise + 1e-9) & (F.log2(bound / p_e) > 0) & (F.log2(bound / p_e) >= SHARE * -F.log2(p_e)))
    telling = telling.groupBy("term").agg(F.min(hidden).alias("hidden")).select("term", (F.col("hidden") <= remove + 1e-9).alias("cut"))
    return materialize(telling, "pii-telling")


def _texts_with(found: DataFrame, texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n_t``: in how many distinct texts each of the terms is.

    All rows are counted where they are, and what copies add is taken off: so
    no text is shuffled but one of each that occurs several times.
    """

    def counted(rows: DataFrame, weight: Column) -> DataFrame:
        words = rows.select(weight.alias("w"), F.explode(_words(F.col("text"))).alias("term"))
        if small(terms, BROADCAST_ROWS):
            return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("w").alias("n_t"))
        return words.groupBy("term").agg(F.sum("w").alias("n_t")).join(terms, "term", "left_semi")

    n_t = counted(texts, F.lit(1))
    repeated = found.groupBy(*KEYS).agg(F.count("*").alias("copies")).where("copies > 1")
    repeated = materialize(repeated, "pii-repeated")
    if not repeated.isEmpty():
        once = _meet(texts, repeated).groupBy(*KEYS, "copies").agg(F.first("text").alias("text"))
        n_t = n_t.unionByName(counted(once, 1 - F.col("copies"))).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    return n_t


def added_spans(found: DataFrame, texts: DataFrame, generalise: float, remove: float) -> DataFrame | None:
    """``key_a, key_b, more``: spans (kind, start, end) of the disclosing terms in each distinct text that holds some."""
    telling = disclosing_terms(found, texts, generalise, remove)
    if telling is None or telling.isEmpty():
        return None
    words = texts.select(*KEYS, _words(F.col("text")).alias("words"))
    listed = small(telling, LISTED_TERMS)
    if listed:
        # So few terms stand in the plan as a hashed set; only what they hit is ever laid out.
        rows = telling.collect()
        general, cuts = (_set(r["term"] for r in rows if r["cut"] == cut) for cut in (False, True))
        hits = words.where(F.expr(f"exists(words, w -> w IN ({general}) OR w IN ({cuts}))")).select(*KEYS)
    else:
        hits = words.select(*KEYS, F.explode("words").alias("term")).join(_few(telling), "term").select(*KEYS, "term", "cut")
        hits = materialize(hits.distinct(), "pii-hits")
    places = materialize(hits.select(*KEYS).distinct(), "pii-places")
    own = _meet(texts, places).groupBy(*KEYS).agg(F.first("text").alias("text"))
    emails = matches(F.col("text"), EMAIL, F.contains("text", F.lit("@")))
    # Words are looked for in the pieces between the emails.
    begins = F.concat(F.array(F.lit(0)), F.transform(emails, lambda m: m["end"]))
    pieces = F.zip_with(F.split("text", EMAIL, -1), begins, lambda piece, at: F.struct(piece.alias("piece"), at.alias("at")))
    located = F.flatten(F.transform(pieces, lambda p: F.transform(matches(p["piece"], WORD, F.lit(True)), lambda m: _moved(m, p["at"]))))
    whole = F.transform(matches(F.col("text"), WORD, F.lit(True)), lambda m: _moved(m, F.lit(0)))
    laid = own.select(*KEYS, F.when(F.contains("text", F.lit("@")), located).otherwise(whole).alias("words"))
    if listed:
        both = F.expr(f"transform(filter(words, w -> w.term IN ({general}) OR w.term IN ({cuts})), w -> struct(w.term IN ({cuts}) AS cut, w.start, w.end))")
        spans = laid.select(*KEYS, F.sort_array(both).alias("more"))
    else:
        each = laid.select(*KEYS, F.explode("words").alias("w")).select(*KEYS, "w.*")
        spans = each.join(hits, [*KEYS, "term"]).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("cut", "start", "end"))).alias("more"))
    more = F.transform("more", lambda s: F.struct(F.when(s["cut"], ADDED[1]).otherwise(ADDED[0]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return materialize(spans.select(*KEYS, more.alias("more")), "pii-added")


def _set(terms: Iterable[str]) -> str:
    """Terms, which are letters only, as a list for IN."""
    return ", ".join(f"'{t}'" for t in sorted(terms)) or "''"


def _moved(m: Column, by: Column) -> Column:
    return F.struct(F.lower(m["value"]).alias("term"), (m["start"] + by).alias("start"), (m["end"] + by).alias("end"))


def _entities(base: Column) -> Column:
    """Hashes of the values: emails without case, numbers by their digits."""
    value = lambda s: F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))
    return F.array_distinct(F.transform(base, lambda s: F.xxhash64(s["kind"], value(s))))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = _text(text_col)
    return docs.select(*text_keys(text), text.alias("text"))


def _found(rows: DataFrame, *more: str) -> DataFrame:
    """Of rows with key_a, key_b, text: their keys, base spans (kind, start, end), entities, and the words of those with entities."""
    base = rows.select(*more, *KEYS, "text", base_spans(F.col("text")).alias("base"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    words = F.when(F.size("base") > 0, _words(F.col("text")))
    return materialize(base.select(*more, *KEYS, plain.alias("spans"), _entities(F.col("base")).alias("entities"), words.alias("words")), "pii-base")


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, key_a, key_b, spans`` of every row: all spans as (kind, start, end).

    ``key_a, key_b`` tell different texts apart.  Spans come by kind (the base
    kinds as listed, then ``term`` and ``cut``) and start, in code points, end
    exclusive.  Null and empty texts have none.  Evidence is counted in
    distinct texts, so that exact copies add nothing.  Repeated rows each have
    a row; other columns don't count; an empty table gives an empty result.
    """
    text = _text(text_col)
    found = _found(docs.select(F.col(id_col).alias("doc_id"), *text_keys(text), text.alias("text")), "doc_id")
    added = added_spans(found, _texts(docs, text_col), generalise, remove)
    if added is None:
        return found.select("doc_id", *KEYS, "spans")
    both = _meet(found.select("doc_id", *KEYS, "spans"), added, "left", F.size("more"))
    return both.select("doc_id", *KEYS, F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with base spans and generalised terms as tags, and removed terms cut."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # A span that begins inside what went before keeps only its rest.
    apart = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["end"] > acc["at"],
                F.concat(acc["out"], F.array(F.struct(F.greatest(acc["at"], s["start"]).alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def build(a: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(a, lambda s: s["end"]))
        pieces = F.zip_with(
            F.concat(F.transform(a, lambda s: s["start"]), F.array(F.length(text))),
            ends,
            lambda start, before: F.substr(text, before + 1, start - before),
        )
        tags = F.transform(a, lambda s: F.when(s["kind"] == ADDED[1], F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.array_join(F.zip_with(pieces, tags, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")

    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(F.array(apart), build), 1))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Rows of ``docs`` with all columns; texts are redacted, null texts stay null."""
    texts = _texts(docs, text_col)
    added = added_spans(_found(texts), texts, generalise, remove)
    text = _text(text_col)
    rows = docs.select(F.struct("*").alias("_doc"), *text_keys(text), F.transform(base_spans(text), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("_spans"))
    if added is not None:
        both = _meet(rows, added, "left", F.size("more"))
        rows = both.select("_doc", F.when(F.col("more").isNull(), F.col("_spans")).otherwise(F.concat("_spans", "more")).alias("_spans"))
    whole = F.col("_doc")[text_col]
    clean = F.when(F.size("_spans") == 0, whole).otherwise(redact(whole, F.col("_spans")))
    return rows.select(*(clean.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns))
