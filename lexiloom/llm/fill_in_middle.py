"""Fill-in-the-middle transformation with a lazy two-pass matcher.

A text is cut into units, the matches of a pattern from left to right.  The
first pass counts them; the two cuts are then ranks drawn from a hash of the
document's id.  The second pass advances a lazy match iterator to the smaller
and on to the larger rank and keeps two offsets.  No unit is ever stored, so
beside the text and its output the matcher takes the same memory for any
number of units.

Documents are cut where they are: nothing is shuffled, and outputs leave a
task in batches of about ``BATCH`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
BATCH = 4 << 20


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no two of them can overlap in a text; then the first occurrence of each is the one put there."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} could be mistaken for each other")
    if len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")
    return sentinels


def count_units(unit: re.Pattern[str], text: str) -> int:
    """First pass."""
    return sum(1 for _ in unit.finditer(text))


def cut_places(unit: re.Pattern[str], text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of the ranks ``low`` <= ``high`` end (0: before the first one)."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def draws(seed: int, id_col: str) -> list[Column]:
    """The first four groups of eight hexadecimal digits of sha256 of ``seed:id`` as numbers; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(
    docs: DataFrame, *, unit: str = LINES, seed: int = 7, percent: int = 100, spm_percent: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` of every whole text.

    ``n`` is the number of units.  The prefix ends after the smaller of
    h1 % (n+1) and h2 % (n+1) units, the middle after the larger one; the rest
    is the suffix.  What no unit matches belongs to the part of the next unit.
    ``form``: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
    middle, for ``spm_percent`` of 100 ids) with a sentinel before each part,
    or ``plain``, the text itself, which is that of ``100 - percent`` of 100
    ids, of empty texts and of those that hold a sentinel.  Lengths are in code
    points and null for plain texts.

    A null text counts as empty, a null id as an empty one.  Every row of a
    repeated id is transformed alike if its text is the same.  Texts of any
    length are taken whole; broken UTF-8 keeps its bytes, each counted as a
    code point.  Other columns don't matter, an empty table gives an empty one.
    """
    prefix, suffix, middle = _checked(sentinels)
    compiled = re.compile(unit)

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        n = count_units(compiled, text)
        if not text or h3 % 100 >= percent or any(s in text for s in sentinels):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = cut_places(compiled, text, low, high)
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, "".join((suffix, text[b:], prefix, text[:a], middle, text[a:b]))
        return n, "psm", a, b - a, "".join((prefix, text[:a], suffix, text[b:], middle, text[a:b]))

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, rows = 0, 0, []

            def done(end: int, batch=batch) -> pa.RecordBatch:
                cells = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *cells], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py() or b""
                row = one(raw.decode("utf-8", "surrogateescape"), *(batch.column(k)[i].as_py() for k in range(2, 6)))
                rows.append((*row[:4], row[4].encode("utf-8", "surrogateescape")))
                size += len(rows[-1][4])
                if size >= BATCH:
                    yield done(i + 1)
                    begin, size, rows = i + 1, 0, []
            if rows:
                yield done(batch.num_rows)

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *draws(seed, id_col))
    out = narrow.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from output and form alone.

    The first occurrence of each sentinel is the one put there, since texts
    with a sentinel stay plain and sentinels can't overlap with anything.
    """
    prefix, suffix, middle = _checked(sentinels)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.instr(output, second), F.instr(output, middle)
        begin = F.lit(len(first) + 1)
        return F.substr(output, begin, a - begin), F.substr(output, a + len(second), b - a - len(second)), F.substr(output, b + len(middle))

    psm, spm = parts(prefix, suffix), parts(suffix, prefix)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
