"""Counts, shares, modes and splits by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import rank_in_buckets


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def relative_frequency(df: DataFrame, key: str) -> DataFrame:
    n = counts(df.where(F.col(key).isNotNull()), key)
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def compare_frequencies(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Shares in two tables side by side; 0 where a value is missing."""
    a = relative_frequency(left, key).select(key, F.col("share").alias("left_share"))
    b = relative_frequency(right, key).select(key, F.col("share").alias("right_share"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("left_share", F.lit(0.0)).alias("left_share"), F.coalesce("right_share", F.lit(0.0)).alias("right_share"))


def filter_rate(df: DataFrame, kept: Column, key: str) -> DataFrame:
    """Percent of each key's rows that a condition keeps, to two digits."""
    n, good = F.count("*"), F.count_if(kept)
    return df.groupBy(key).agg(n.alias("n"), good.alias("n_kept"), F.round(F.try_divide(good, n) * 100, 2).alias("percent"))


def gini(df: DataFrame, key: str) -> DataFrame:
    """Gini coefficient of the counts of a key, corrected for their number."""
    # Keys of equal counts are counted first: no more different counts than the root of twice the rows.
    n = counts(df, key).groupBy("n").agg(F.count("*").alias("keys"))
    below = F.coalesce(F.sum("keys").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("keys") * F.col("below") + F.col("keys") * (F.col("keys") + 1) / 2  # their sum
    size, total, weighted = F.sum("keys"), F.sum(F.col("n") * F.col("keys")), F.sum(F.col("n") * ranks)
    raw = 2 * weighted / (size * total) - (size + 1) / size
    return n.withColumn("below", below).agg(F.try_divide(raw * size, size - 1).alias("gini"), F.coalesce(size, F.lit(0)).alias("classes"))


def _by_member(df: DataFrame, member: str, label: str) -> DataFrame:
    return counts(df.where(F.col(member).isNotNull() & F.col(label).isNotNull()), member, label)


def mode_rarer(df: DataFrame, member: str, label: str) -> DataFrame:
    """Each member's most frequent label; of equals the one that is rarer overall, then the first by name."""
    overall = counts(df.where(F.col(label).isNotNull()), label).withColumnRenamed("n", "overall")
    n = _by_member(df, member, label).join(F.broadcast(overall), label)
    best = F.min_by(F.col(label), F.struct(-F.col("n"), "overall", label))
    return n.groupBy(member).agg(best.alias(label), F.max("n").alias("n"))


def mode_first(df: DataFrame, member: str, label: str) -> DataFrame:
    """Each member's most frequent label; of equals the first by name."""
    n = _by_member(df, member, label)
    return n.groupBy(member).agg(F.min_by(F.col(label), F.struct(-F.col("n"), label)).alias(label), F.max("n").alias("n"))


def mode_ties(df: DataFrame, member: str, label: str) -> DataFrame:
    """Each member's most frequent labels, all of equals."""
    n = _by_member(df, member, label)
    return n.join(n.groupBy(member).agg(F.max("n").alias("n")), [member, "n"]).select(member, label, "n")


def arithmetic_hash(key: Column, seed: int) -> Column:
    """A number from 0 to 999,982 that any engine computes alike."""
    a = F.pmod(F.pmod(key, F.lit(999_983)) * 7919 + seed * 104_729 + 12_345, F.lit(999_983))
    return F.pmod(a * a + a * 31, F.lit(999_983))


def hash_rank(df: DataFrame, key: str, label: str, seed: int, name: str) -> DataFrame:
    """``df`` with ``name``: the rank, from 1, of each row within its label by the hash of its key.

    A label may have any share of the rows: ranks are counted in buckets of the
    hash and not in one task per label.
    """
    rows = df.withColumn("_h", arithmetic_hash(F.col(key), seed))
    return rank_in_buckets(rows, [label], F.floor(F.col("_h") / 1000), ["_h", key], name).drop("_h")


def group_split(df: DataFrame, member: str, label: str, *, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``member, label, part``: members, stratified by their main label, in ``test`` or ``train``.

    Each stratum gives the floor of its share, and those of the largest
    remainders one more, until ceil(share * members) are in the test part.
    Rows follow their member, so no member is in both parts.
    """
    members = mode_first(df, member, label).select(member, label)
    strata = counts(members, label).withColumn("quota", F.col("n") * share)
    total = strata.agg(F.ceil(F.sum("n") * share).alias("wanted"), F.sum(F.floor("quota")).alias("floors"))
    remainder = Window.orderBy(F.desc(F.round(F.col("quota") - F.floor("quota"), 9)), label)  # one row per label
    strata = strata.crossJoin(F.broadcast(total)).withColumn("place", F.row_number().over(remainder))
    strata = strata.select(label, (F.floor("quota") + (F.col("place") <= F.col("wanted") - F.col("floors")).cast("int")).alias("take"))
    ranked = hash_rank(members, member, label, seed, "r").join(F.broadcast(strata), label)
    return ranked.select(member, label, F.when(F.col("r") <= F.col("take"), "test").otherwise("train").alias("part"))


def check_disjoint(left: DataFrame, right: DataFrame, member: str) -> None:
    """Raise ``ValueError`` with up to five members that both tables have."""
    both = [r[0] for r in left.select(member).intersect(right.select(member)).limit(5).collect()]
    if both:
        raise ValueError(f"members in both parts: {both}")


def kfold(df: DataFrame, key: str, label: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """``key, label, fold``: the rows of each label dealt in turn, by hash."""
    return hash_rank(df.select(key, label), key, label, seed, "_r").select(key, label, F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int").alias("fold"))


def stratified_subsample(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """The first ceil(share * n) rows of each label by hash."""
    size = counts(df, label).select(F.col(label).alias("_l"), F.ceil(F.col("n") * share).alias("_take"))  # one row per label
    ranked = hash_rank(df, key, label, seed, "_r")
    return ranked.join(F.broadcast(size), F.col(label).eqNullSafe(F.col("_l"))).where(F.col("_r") <= F.col("_take")).drop("_r", "_l", "_take")


def random_baseline(train: DataFrame, test: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Each test row with a label drawn from the training shares (inverse distribution function)."""
    n = counts(train.where(F.col(label).isNotNull()), label)
    upto = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = n.withColumn("hi", F.sum("n").over(upto)).crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))
    bands = F.broadcast(cdf.select(F.col(label).alias("drawn"), ((F.col("hi") - F.col("n")) / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi")))
    u = arithmetic_hash(F.col(key), seed) / F.lit(999_983)
    return test.withColumn("u", u).join(bands, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(key, label, "drawn")
