"""Text rules as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import BOUNDARY_WORDS, CONTRACTIONS, FILLERS, STOPWORDS

#: A word: letters, digits and underscores of any script, with inner apostrophes.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*[\p{L}\p{N}_]|[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Lower-cased words; null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(words: Column, order: int) -> Column:
    """Runs of ``order`` words joined by blanks; the text is one run across line breaks."""
    if order == 1:
        return words
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (order - 1)), lambda i: F.array_join(F.slice(words, i, order), " "))
    return F.when(F.size(words) >= order, runs).otherwise(F.array().cast("array<string>"))


def ngrams_of_orders(words: Column, orders: Iterable[int]) -> Column:
    """Array of (order, ngram)."""
    parts = [_tagged(ngrams(words, n), n) for n in orders]
    return F.concat(*parts)


def _tagged(grams: Column, order: int) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(order).alias("order"), g.alias("ngram")))


def is_stopword(word: Column) -> Column:
    return word.isin(*sorted(STOPWORDS)) | word.rlike(r"^\d+\S*$")


def stopword_only(ngram: Column) -> Column:
    """All blank-separated parts are stop words or begin with a digit."""
    return F.forall(F.filter(F.split(F.lower(ngram), r"\s+"), lambda x: x != ""), is_stopword)


def boundary_bigram(ngram: Column) -> Column:
    """A bigram that begins with an article or ``to``."""
    parts = F.split(ngram, " ")
    return (F.size(parts) == 2) & F.element_at(parts, 1).isin(*BOUNDARY_WORDS)


def strip_boundaries(ngram: Column) -> Column:
    """Without one article or ``to`` at either end."""
    parts = F.filter(F.split(ngram, r"\s+"), lambda x: x != "")
    first = F.when((F.size(parts) > 0) & F.try_element_at(parts, F.lit(1)).isin(*BOUNDARY_WORDS), F.slice(parts, 2, 1 << 20)).otherwise(parts)
    last = F.when((F.size(first) > 0) & F.try_element_at(first, F.lit(-1)).isin(*BOUNDARY_WORDS), F.slice(first, 1, F.greatest(F.size(first) - 1, F.lit(0)))).otherwise(first)
    return F.array_join(last, " ")


def gerund(word: Column) -> Column:
    """``-ing`` off stems of three characters or more; a doubled last letter is made single."""
    stem = F.regexp_extract(word, r"^(.{3,}?)ing$", 1)
    single = F.when(F.substring(stem, -1, 1) == F.substring(stem, -2, 1), F.substr(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
    return F.when(stem == "", word).otherwise(single)


def expand_contractions(text: Column) -> Column:
    """Contractions between word boundaries written out, the first entry that fits
    at a place; a capital first letter makes the first letter of what replaces it
    a capital and the others small.

    The text is split into contractions and what stands between them, which are
    put together again.
    """
    w = r"[\p{L}\p{N}_]"
    edge = rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    pattern = rf"(?i){edge}(?:{'|'.join(re.escape(c) for c in CONTRACTIONS)}){edge}"
    full = F.create_map(*(F.lit(x) for pair in CONTRACTIONS.items() for x in pair))

    def written_out(found: Column) -> Column:
        out = F.element_at(full, F.lower(found))
        capital = F.concat(F.upper(F.substring(out, 1, 1)), F.lower(F.substr(out, F.lit(2))))
        return F.when(found.rlike(r"^\p{Lu}"), capital).otherwise(out)

    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda gap, c: F.concat(gap, F.when(c.isNotNull(), written_out(c)).otherwise(F.lit("")))), "")


def strip_possessive(text: Column) -> Column:
    w = r"[\p{L}\p{N}_]"
    return F.regexp_replace(text, rf"(?<!{w})({w}+)'s(?!{w})", "$1")


def keep_lemma(word: Column) -> Column:
    """Not a filler, longer than one character and without digits."""
    return ~word.isin(*sorted(FILLERS)) & (F.length(word) > 1) & ~word.rlike(r"\p{Nd}")


def alphabetic_words(text: Column) -> Column:
    """Blank-separated words of letters only, lower-cased."""
    return F.filter(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
