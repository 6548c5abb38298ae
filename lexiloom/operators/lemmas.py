"""Lemmas and tagged words with dictionaries and taggers that are plugged in.

A tagger is a table ``word, tag`` (the tag of each known word), or a function
of a list of words that gives as many tags and runs on Arrow batches.  A lemma
dictionary is a table ``word, pos, lemma`` with the word classes a, v, n, r.
Words go through joins with these tables, so that a dictionary may have any
size; nothing of it is held in an expression.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.lexicon import domain_lexicon

from .annotated import wordnet_pos

Tagger = DataFrame | Callable[[list[str]], list[str]]


def words_by_line(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, place, word``: the lower-cased words of each line; lines without words have one null word."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "_l"))
    return lines.select(key, "line", F.posexplode_outer(T.tokens(F.col("_l"))).alias("place", "word"))


def tag(words: DataFrame, tagger: Tagger, key: str) -> DataFrame:
    """``words`` with ``tag``; a table tags word by word, a function sees whole lines."""
    if isinstance(tagger, DataFrame):
        return words.join(tagger.select("word", "tag").dropDuplicates(["word"]), "word", "left")
    lines = words.where("word is not null").groupBy(key, "line").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("_w"))

    @F.pandas_udf("array<string>")
    def of(column: pd.Series) -> pd.Series:
        return column.map(lambda w: list(tagger(list(w))))

    tagged = lines.withColumn("_t", of(F.transform("_w", lambda w: w["word"])))
    cells = F.transform(F.arrays_zip("_w", "_t"), lambda z: F.struct(z["_w"]["place"].alias("place"), z["_t"].alias("tag")))
    flat = tagged.select(key, "line", F.explode(cells).alias("c")).select(key, "line", "c.*")
    return words.join(flat, [key, "line", "place"], "left")


def lemmas(docs: DataFrame, key: str, text: str, *, dictionary: DataFrame | None = None, tagger: Tagger | None = None, lexicon: dict[str, str] | None = None) -> DataFrame:
    """``key, line, place, word, lemma, tag``: the domain lexicon, the gerund rule, and the dictionary by word class.

    Words without a tag, or with one of another kind, are looked up as nouns;
    words that the dictionary lacks stay.  ``lexicon`` replaces the domain
    lexicon.  Without a dictionary the lemma is the rule's stem.
    """
    own = domain_lexicon() if lexicon is None else lexicon
    spark = docs.sparkSession
    words = words_by_line(docs, key, text)
    words = tag(words, tagger, key) if tagger is not None else words.withColumn("tag", F.lit(None).cast("string"))
    known = spark.createDataFrame(sorted(own.items()), "word string, _v string")  # a few hundred rows
    stems = words.join(F.broadcast(known), "word", "left").withColumn("_stem", T.gerund(F.coalesce("_v", "word"))).drop("_v")
    if dictionary is None:
        return stems.select(key, "line", "place", "word", F.col("_stem").alias("lemma"), "tag")
    table = dictionary.select(F.col("word").alias("_stem"), F.col("pos").alias("_pos"), "lemma").dropDuplicates(["_stem", "_pos"])
    classed = stems.withColumn("_pos", F.coalesce(wordnet_pos(F.col("tag")), F.lit("n")))
    found = classed.join(table, ["_stem", "_pos"], "left")
    return found.select(key, "line", "place", "word", F.coalesce("lemma", "_stem").alias("lemma"), "tag")


def lemmatize(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """``key, lemmatized``: lemmas that aren't fillers, single characters or with digits, line by line; options as for :func:`lemmas`."""
    rows = lemmas(docs, key, text, **options)
    kept = F.when(F.col("word").isNotNull() & T.keep_lemma(F.col("lemma")), F.struct("place", "lemma"))
    lines = rows.groupBy(key, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda w: w["lemma"]), " ").alias("_l"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "_l"))), lambda x: x["_l"]), "\n").alias("lemmatized"))


def tagged_text(docs: DataFrame, key: str, text: str, tagger: Tagger, **options) -> DataFrame:
    """``key, lemmas, tagged``: lemmas of each line, and ``word|TAG`` for each word, blank-separated; lines are kept."""
    rows = lemmas(docs, key, text, tagger=tagger, **options)
    some = F.col("word").isNotNull()
    cells = F.when(some, F.struct("place", F.lower("lemma").alias("lemma"), F.concat("word", F.lit("|"), F.coalesce("tag", F.lit("X"))).alias("pair")))
    lines = rows.groupBy(key, "line").agg(F.sort_array(F.collect_list(cells)).alias("_w"))
    joined = lambda name: F.array_join(F.transform("_w", lambda w: w[name]), " ").alias(name)
    lines = lines.select(key, F.struct("line", joined("lemma"), joined("pair")).alias("_l"))
    out = lines.groupBy(key).agg(F.sort_array(F.collect_list("_l")).alias("_l"))
    return out.select(key, *(F.array_join(F.transform("_l", lambda x: x[old]), "\n").alias(new) for old, new in (("lemma", "lemmas"), ("pair", "tagged"))))
