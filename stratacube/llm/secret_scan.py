"""Secrets in texts: three exact patterns, and strings whose characters are spread too evenly for words.

Candidate strings are the runs of letters, digits and the signs of base64.  A window slides over each; its Shannon entropy
is kept up to date from the counts of the character that leaves and of the one that enters, in whole numbers, so that no
rounding adds up.  The narrowest character class that holds all of a window decides which entropy is too high for it.
Windows over the limit that meet become one span, unless the allow-list knows the string or an exact match covers it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratacube.llm import textbuf as tb

# The exact kinds in their order, with their patterns and least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base36", "entropy_base64")
#: Characters of a window, and the least entropy in bits for windows of hex digits, of digits and letters of one case, and of base64.
WINDOW = 20
LIMITS = (3.0, 3.6, 3.8)
#: A window is no secret with fewer digits, or (base64) fewer capital or small letters.
LEAST_OF_A_KIND = 2
#: Strings that look random and are not secret: UUIDs, alphabets and counts, dummies, checksums that say so, paths in addresses.
ALLOWED = (
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])",
    r"(?i)[A-Za-z0-9+/_=-]*(?:abcdefgh|01234567|12345678|qwertyui|xxxxxx|example|placeholder|changeme|dummy|redacted)[A-Za-z0-9+/_=-]*",
    r"(?i)(?:sha1|sha256|sha384|sha512|md5|checksum|integrity|digest|commit)[-:= \"']{1,4}[A-Za-z0-9+/_=-]+",
    r"(?i)https?://[^\s?#]+",
)
_RESULT = "spans array<struct<kind:string,start:bigint,end:bigint,entropy:double>>"
_SCALE = 1 << 20
_digit, _hex, _small, _capital, _sign = (np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in (b"0123456789", b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"+/_=-"))
_hex_capital = _digit | (np.isin(np.arange(256), np.frombuffer(b"ABCDEF", np.uint8)))
_candidate = _digit | _small | _capital | _sign


def window_entropy(text: np.ndarray, width: int) -> np.ndarray:
    """Bits of Shannon entropy of each window of ``width`` bytes.

    With c log2 c in 2^-20ths, a byte that enters where c others like it stand adds f(c + 1) - f(c), and one that leaves takes
    that away again.
    """
    n = len(text)
    if n < width:
        return np.zeros(0)
    f = np.array([0] + [round(c * math.log2(c) * _SCALE) for c in range(1, width + 1)])
    step = np.diff(f)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)  # like bytes among the width - 1 before, and after
    for k in range(1, width):
        same = text[k:] == text[:-k]
        before[k:] += same
        after[:-k] += same
    enters, leaves = np.cumsum(step[before]), np.cumsum(step[after])
    total = enters[width - 1 :].copy()
    total[1:] -= leaves[: n - width]
    return math.log2(width) - total / (_SCALE * width)


def _windows_with(mask: np.ndarray, width: int) -> np.ndarray:
    sums = np.r_[0, np.cumsum(mask)]
    return sums[width:] - sums[:-width]


def entropy_spans(data: np.ndarray, offs: np.ndarray, window: int, limits: tuple[float, float, float]) -> list[tuple[int, int, int, int, float]]:
    """(row, kind, start, end, highest entropy) of what the windows over their limit cover, in bytes."""
    start, end, row = tb.words(data, offs, ~_candidate)
    long = end - start >= window
    start, end, row = start[long], end[long], row[long]
    if not len(start):
        return []
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    text = data[at]
    bits = window_entropy(text, window)
    digits, small, capital, signs = (_windows_with(m[text], window) for m in (_digit, _small, _capital, _sign))
    one_hex = (_windows_with(_hex[text], window) == window) | (_windows_with(_hex_capital[text], window) == window)
    letters = small + capital
    mixed = (digits >= LEAST_OF_A_KIND) & (letters >= LEAST_OF_A_KIND)
    kind = np.where(one_hex, 0, np.where((signs == 0) & ((small == 0) | (capital == 0)), 1, 2))
    mixed &= (kind < 2) | ((small >= LEAST_OF_A_KIND) & (capital >= LEAST_OF_A_KIND))
    hot = np.flatnonzero(mixed & (bits >= np.array(limits)[kind]) & (of[: len(bits)] == of[window - 1 :]))
    if not len(hot):
        return []
    # windows of one string that meet are one span, of the widest class among them
    fresh = np.flatnonzero(np.r_[True, (hot[1:] > hot[:-1] + window) | (of[hot[1:]] != of[hot[:-1]])])
    stop = np.r_[fresh[1:], len(hot)] - 1
    kinds, most = np.maximum.reduceat(kind[hot], fresh), np.maximum.reduceat(bits[hot], fresh)
    first, last = at[hot[fresh]], at[hot[stop]] + window
    return [(int(r), 3 + int(k), int(a), int(b), float(h)) for r, k, a, b, h in zip(row[of[hot[fresh]]], kinds, first, last, most, strict=True)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limits: tuple[float, float, float] = LIMITS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(id, spans), one row per input row: kind, start and end (code points, end exclusive), entropy of each span.

    Exact kinds, leftmost and without overlap within a kind: assign, a name of a secret with a value of six or more
    characters; access, key ids of twenty or more; hex, runs of twenty-four or more small hex digits; their entropy is
    null.  The other kinds come from windows of ``window`` characters with at least the entropy of ``limits``; those that
    lie within an exact span, or within a match of ``allowed``, are left out.  Sorted by start, then in the order of
    ``KINDS``.  Null counts as empty, and empty texts have no spans.  Repeated rows are scanned each by itself; other
    columns are not read, so their names do not matter.
    """

    def run(batches):
        rules = [re.compile(p.encode()) for p in allowed]
        for batch in batches:
            for r0, r1, data, offs in tb.slices(batch.column(1)):
                raw, n = data.tobytes(), r1 - r0
                found: list[list] = [[] for _ in range(n)]
                for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    found[r] += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(raw, a, b) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
                    found[r] += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= ACCESS_LEAST]
                start, end, row = tb.words(data, offs, ~_hex)
                for k in np.flatnonzero(end - start >= HEX_LEAST).tolist():
                    found[int(row[k])].append((int(start[k]), 2, int(end[k]), None))
                known: dict[int, list] = {}
                for r, kind, a, b, bits in entropy_spans(data, offs, window, limits):
                    if any(x <= a and b <= y for x, k, y, _ in found[r] if k < 3):
                        continue
                    if r not in known:
                        known[r] = [m.span() for p in rules for m in p.finditer(raw, int(offs[r]), int(offs[r + 1]))]
                    if not any(x <= a and b <= y for x, y in known[r]):
                        found[r].append((a, kind, b, bits))
                signs = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                flat = [(r, *s) for r, spans in enumerate(found) for s in sorted(spans, key=lambda s: s[:3])]
                cut = np.r_[0, np.cumsum([len(spans) for spans in found])].astype(np.int32)
                base = signs[offs[:-1]]
                of = np.array([x[0] for x in flat], dtype=np.int64)
                place = [pa.array(signs[np.array([x[k] for x in flat], dtype=np.int64)] - base[of]) for k in (1, 3)]
                spans = pa.StructArray.from_arrays([pa.array([KINDS[x[2]] for x in flat], pa.string()), *place, pa.array([x[4] for x in flat], pa.float64())], ["kind", "start", "end", "entropy"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, n), pa.ListArray.from_arrays(pa.array(cut), spans)], ["id", "spans"])

    schema = docs.select(F.col(id_col).alias("id")).schema
    for field in StructType.fromDDL(_RESULT):
        schema = schema.add(field)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tb.frugal(run), schema)
