"""Secret scans with multipart credential linking.

Three kinds of secrets are strong by themselves: assignments to names such as
``password``, access keys and long hexadecimal runs.  Others are weak and mean
nothing alone: identifiers (user and account names, email addresses), mixed
tokens, and endpoints (URLs, named hosts, IPv4 addresses and hosts with ports).
Each part has a scope, its span widened by ``SCOPE`` code points to both sides.
The scopes of access identifiers, secrets and endpoints of one text are
interval-joined, and a weak part is reported only when parts of the other two
roles, or a strong secret and one other role, lie within its scope.

The join is a sorted sweep: per role, the nearest part on each side of a part
decides whether any part of that role is in scope, so the work is n log n for
any number of parts and no pairs are built.

A text without an assigned name, an access key or a run of 20 characters that
a token is made of can't have a span; a linear search over the Arrow column
leaves such texts out before any Python code looks at them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches


SCOPE = 120
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2

# The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

# May follow "=", ":" or a quote; the run is taken whole, so that the work stays linear in its length.
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_USER = re.compile(r"""(?i:\b(?:user(?:name|_id)?|login|account|client_?id|key_?id))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.@-]{3,})""")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ADDRESS = re.compile(r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?::[0-9]{1,5})?(?![0-9A-Za-z.]?[0-9A-Za-z])")
_PORT = re.compile(r"(?<![A-Za-z0-9.-])(?=[A-Za-z0-9-]++\.)[A-Za-z0-9.-]++:[0-9]{2,5}(?![0-9A-Za-z])")
_AFTER_SCHEME = re.compile(r"://[A-Za-z0-9][^\s\"'<>|]{2,}")
_SCHEME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-"
_HOST = re.compile(r"""(?i:\b(?:host|endpoint|server|base_?url))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9][A-Za-z0-9.:/_-]{3,})""")

# What a text with any span has: a strong secret or a token.
_SOME = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[A-Za-z0-9+/_-]{20}"

#: Reported kinds in their order; the weak ones follow the base.
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")


def _base(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, role) of the strong secrets."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign", SECRET) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", IDENTIFIER) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", SECRET) for m in HEX.finditer(text)]
    return out


def _urls(text: str) -> Iterator[tuple[int, int]]:
    """URLs with a scheme of any case and of two characters or more; the scheme is
    looked for backwards, so that each character is passed once."""
    floor = 0
    for m in _AFTER_SCHEME.finditer(text):
        run = text[floor : m.start()]
        run = run[len(run.rstrip(_SCHEME)) :].lstrip("0123456789+.-")
        if len(run) >= 2:
            yield m.start() - len(run), m.end()
        floor = m.end()


def _weak(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(1), m.end(1), "identifier", IDENTIFIER) for m in _USER.finditer(text)]
        out += [(m.start(1), m.end(1), "endpoint", ENDPOINT) for m in _HOST.finditer(text)]
        out += [(m.start(), m.end(), "endpoint", ENDPOINT) for m in _PORT.finditer(text)]
    if "://" in text:
        out += [(start, end, "endpoint", ENDPOINT) for start, end in _urls(text)]
    if "@" in text:
        out += [(m.start(), m.end(), "identifier", IDENTIFIER) for m in _MAIL.finditer(text)]
    if "." in text:
        out += [(m.start(), m.end(), "endpoint", ENDPOINT) for m in _ADDRESS.finditer(text)]
    out += [(m.start(), m.end(), "token", SECRET) for m in _MIXED.finditer(text)]
    return out


def _meets(starts: list[int], tops: list[int], start: int, end: int) -> bool:
    """Whether a part meets [start, end); ``starts`` are sorted, ``tops`` their running greatest ends."""
    last = bisect_left(starts, end) - 1
    return last >= 0 and tops[last] > start


def scan_text(text: str, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans (start, end, kind) by start and kind, and credentials: the first
    and last code point of each run of linked parts."""
    strong = _base(text)
    weak = _weak(text)
    covered = sorted((s, e) for s, e, _, _ in strong)
    begins, tops = [s for s, _ in covered], []
    for _, e in covered:
        tops.append(max(e, tops[-1] if tops else 0))
    weak = sorted({w for w in weak if not _meets(begins, tops, w[0], w[1])})
    by_role: dict[tuple[int, bool], tuple[list[int], list[int]]] = {}
    for part in sorted(strong + weak):
        for key in ((part[3], False), (part[3], True)) if part[2] in KINDS[:3] else ((part[3], False),):
            starts, ends = by_role.setdefault(key, ([], []))
            starts.append(part[0])
            ends.append(max(part[1], ends[-1] if ends else 0))

    def near(role: int, part: tuple[int, int, str, int], strong_only: bool = False) -> bool:
        if (role, strong_only) not in by_role:
            return False
        starts, ends = by_role[role, strong_only]
        return _meets(starts, ends, part[0] - scope, part[1] + scope)

    kept = []
    for part in weak:
        others = [role for role in (IDENTIFIER, SECRET, ENDPOINT) if role != part[3] and near(role, part)]
        if len(others) == 2 or (others and any(near(role, part, True) for role in others)):
            kept.append(part)
    order = {k: n for n, k in enumerate(KINDS)}
    spans = sorted(((s, e, k) for s, e, k, _ in strong + kept), key=lambda x: (x[0], order[x[2]], x[1]))
    credentials: list[list] = []
    for s, e, k, role in sorted(strong + kept):
        if credentials and s <= credentials[-1][1] + scope:
            credentials[-1][1] = max(credentials[-1][1], e)
            credentials[-1][2].add(role)
        else:
            credentials.append([s, e, {role}])
    return spans, [(s, e) for s, e, roles in credentials if len(roles) > 1]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans, credentials`` of every row.

    ``spans``: array of (start, end, kind) in code points, end exclusive, by
    start and then by kind as in ``KINDS``; ``credentials``: extents of runs of
    parts of at least two roles within each other's scopes.  A weak part that
    overlaps a strong one is left to that one.  Null and empty texts have
    neither; bytes that aren't UTF-8 count as U+FFFD.  Texts of any length are
    scanned whole, in a time that grows as their length does, with any number
    of blanks around ``=`` and ``:``.  Repeated rows each have a
    row; other columns don't count; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(batch.column(1), _SOME), False).to_numpy(zero_copy_only=False))
            sizes = np.zeros((2, n), np.int32)
            spans, linked = [], []
            for row, text in zip(some.tolist(), batch.column(1).take(pa.array(some)).to_pylist()):
                found, credentials = scan_text(text, scope)
                sizes[:, row] = len(found), len(credentials)
                spans += found
                linked += credentials
            columns = [pa.array([x[k] for x in spans], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
            extents = [pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)]
            cells = []
            for size, fields, names in ((sizes[0], columns, ["start", "end", "kind"]), (sizes[1], extents, ["start", "end"])):
                cells.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays(fields, names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", "spans", "credentials"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long"), F.make_valid_utf8(F.col(text_col).cast("string")))
    return narrow.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>, credentials array<struct<start:long,end:long>>")
