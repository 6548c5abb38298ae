"""Dictionary morphology: lemmas by detaching suffixes.

A word's candidates are itself and what the rules of its word class make of it;
where none is in the dictionary, the rules are applied to the candidates again,
until nothing is left.  Candidates are made as arrays of each distinct word,
and accepted by a join with the dictionary, which may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes and their replacements by word class (noun, verb, adjective); adverbs have none.
RULES = {
    "n": (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "r": (),
}


def _detached(forms: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """What the rules make of the forms, in order, each once."""

    def of(form: Column) -> Column:
        made = [F.when(F.endswith(form, F.lit(old)), F.concat(F.substr(form, F.lit(1), F.length(form) - len(old)), F.lit(new))) for old, new in rules]
        return F.filter(F.array(*made), lambda x: x.isNotNull() & (x != ""))

    return F.array_distinct(F.flatten(F.transform(forms, of)))


def candidates(word: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Array of (level, place, form): the word and its first forms are level 1, forms of forms follow."""
    if not rules:
        return F.array(F.struct(F.lit(1).alias("level"), F.lit(0).alias("place"), word.alias("form")))
    none = F.array().cast("array<string>")

    def step(state: Column, level: Column) -> Column:
        more = F.when(F.size(state["last"]) > 0, _detached(state["last"], rules)).otherwise(none)
        named = F.transform(more, lambda form, k: F.struct(level.alias("level"), (k + 1).cast("int").alias("place"), form.alias("form")))
        return F.struct(more.alias("last"), F.concat(state["all"], named).alias("all"))

    begin = F.struct(F.array(word).alias("last"), F.array(F.struct(F.lit(1).alias("level"), F.lit(0).alias("place"), word.alias("form"))).alias("all"))
    # A level makes every form shorter, or ends it; so there are no more levels than letters.
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), begin, step, lambda state: state["all"])


def dictionary_lemmas(words: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``word, pos, lemma`` of distinct ``word, pos`` (n, v, a, r; others count as n).

    ``dictionary``: ``lemma, pos``, a null pos for all classes; ``exceptions``:
    ``word, pos, lemma`` of irregular forms, which take no rules.  Of the
    accepted forms of the first level that has any, the shortest is the lemma,
    of equals the first rule's; a word without any stays as it is.
    """
    known = words.where(F.col("word").isNotNull()).select("word", F.col("pos")).distinct()
    kind = F.when(F.col("pos").isin(*RULES), F.col("pos")).otherwise(F.lit("n"))
    made = F.when(kind == "v", candidates(F.col("word"), RULES["v"])).when(kind == "a", candidates(F.col("word"), RULES["a"])).when(kind == "r", candidates(F.col("word"), ()))
    rows = known.select("word", "pos", kind.alias("_k"), made.otherwise(candidates(F.col("word"), RULES["n"])).alias("_c"))
    if exceptions is not None:
        irregular = exceptions.groupBy(F.col("word").alias("_w"), F.col("pos").alias("_p")).agg(F.sort_array(F.collect_set("lemma")).alias("_l"))
        named = F.transform("_l", lambda form, k: F.struct(F.lit(1).alias("level"), (k + 1).cast("int").alias("place"), form.alias("form")))
        own = F.concat(F.slice("_c", 1, 1), named)
        rows = rows.join(irregular, (F.col("word") == F.col("_w")) & (F.col("_k") == F.col("_p")), "left").withColumn("_c", F.when(F.col("_l").isNotNull(), own).otherwise(F.col("_c")))
    forms = rows.select("word", "pos", "_k", F.explode("_c").alias("c")).select("word", "pos", "_k", "c.*")
    entries = dictionary.select(F.col("lemma").alias("form"), F.explode(F.when(F.col("pos").isNull(), F.array(*(F.lit(p) for p in RULES))).otherwise(F.array("pos"))).alias("_k")).distinct()
    best = F.min_by("form", F.struct("level", F.length("form"), "place")).alias("lemma")
    accepted = forms.join(entries, ["form", "_k"], "left_semi").groupBy("word", "pos").agg(best)
    found = known.alias("k").join(accepted.alias("a"), (F.col("k.word") == F.col("a.word")) & F.col("k.pos").eqNullSafe(F.col("a.pos")), "left")
    return found.select("k.word", "k.pos", F.coalesce("a.lemma", "k.word").alias("lemma"))
