"""License notices: exact phrases, and short notices with errors found by pigeonhole seeds and verified by bounded-error matching."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratacube.llm import textbuf as tb

# Phrases that count word for word, with their labels.
EXACT = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Short notices looked for with errors, as lower-case words, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the creative commons attribution": "cc-by",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "all rights reserved": "all-rights-reserved",
}
#: One error for every so many characters of a notice.
CHARS_PER_ERROR = 12
_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,errors:bigint>>"
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[48:58] = IS_GAP[65:91] = IS_GAP[97:123] = IS_GAP[128:] = False


def errors_allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_ERROR)


@functools.cache
def _tools():
    exact = [(re.compile(rf"(?<![^ \n]){phrase}(?![^ \n])"), label) for phrase, label in EXACT.items()]
    seeds = ahocorasick.Automaton()
    where: dict[str, list] = {}
    patterns = {}
    for notice in NOTICES:
        k = errors_allowed(notice)
        cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            where.setdefault(notice[a:b], []).append((notice, a))
        # each piece of a longer notice must be whole words; errors are counted in characters
        patterns[notice] = regex.compile(rf"(?b)(?:\b{regex.escape(notice)}\b){{e<={k}}}")
    for seed, places in where.items():
        seeds.add_word(seed, (len(seed), tuple(places)))
    seeds.make_automaton()
    return exact, seeds, patterns


def plain(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words with one blank between them, a line feed at the end of each row; where each row begins."""
    low = tb.LOWER[data]
    low[IS_GAP[data]] = 32
    start = np.zeros(len(low), dtype=bool)
    start[offs[:-1][offs[:-1] < len(low)]] = True
    keep = low != 32
    keep[1:] |= (low[:-1] != 32) & ~start[1:]
    kept = np.flatnonzero(keep)
    row = np.searchsorted(offs, kept, side="right") - 1
    rows = len(offs) - 1
    count = np.bincount(row, minlength=rows)
    out = np.full(len(kept) + rows, 10, dtype=np.uint8)
    out[np.arange(len(kept)) + row] = low[kept]
    return out, np.r_[0, np.cumsum(count + 1)]


def _matches(pattern, text: str, lo: int, hi: int, least: int) -> Iterator:
    """Best match of the window, and those of what lies before and after it, in order."""
    parts = [(lo, hi, None)]
    while parts:
        a, b, m = parts.pop()
        if m is not None:
            yield m
        elif b - a >= least and (m := pattern.search(text, a, b)) and m.end() > m.start():
            parts += [(m.end(), b, None), (a, b, m), (a, m.start(), None)]


def _notices(text: str, bounds: np.ndarray) -> list[tuple[int, str, int, int, int]]:
    """(row, notice, start, end, errors) of every verified place."""
    _, seeds, patterns = _tools()
    windows: dict[tuple[int, str], list[list[int]]] = {}
    for end, (length, places) in seeds.iter(text):
        begin = end - length + 1
        row = int(np.searchsorted(bounds, begin, side="right")) - 1
        for notice, a in places:
            k = errors_allowed(notice)
            lo, hi = max(int(bounds[row]), begin - a - k - 1), min(int(bounds[row + 1]) - 1, begin - a + len(notice) + k + 1)
            held = windows.setdefault((row, notice), [])
            if held and lo <= held[-1][1]:
                held[-1][1] = max(held[-1][1], hi)
            else:
                held.append([lo, hi])
    found = []
    for (row, notice), spans in windows.items():
        for lo, hi in spans:
            for m in _matches(patterns[notice], text, lo, hi, len(notice) - errors_allowed(notice)):
                found.append((row, notice, m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per input row.

    Words are runs of bytes outside ASCII signs and blanks, after lowering A-Z.  n_base counts the places of the
    exact phrases; first_word and last_word are the smallest and largest word at which one starts, null if none.
    spans lists every notice found with errors: label, start and end in the text reduced to words and single
    blanks, errors.  score is 1 for an exact phrase, else the largest share of a notice's characters that match,
    0 without any.  Null counts as empty, and empty texts have no words and no labels.  Repeated rows are
    scanned each by itself; other columns are not read.
    """

    def run(batches):
        exact, _, _ = _tools()
        for batch in batches:
            for r0, r1, data, offs in tb.slices(batch.column(1)):
                n = r1 - r0
                flat, bounds = plain(data, offs)
                text = flat.tobytes().decode("latin-1")
                begins = np.flatnonzero((flat > 32) & np.r_[True, flat[:-1] <= 32])
                first = np.searchsorted(begins, bounds[:-1])
                places: dict[int, list[int]] = {}
                labels: dict[int, set[str]] = {}
                for pattern, label in exact:
                    for m in pattern.finditer(text):
                        r = int(np.searchsorted(bounds, m.start(), side="right")) - 1
                        places.setdefault(r, []).append(int(np.searchsorted(begins, m.start()) - first[r]))
                        labels.setdefault(r, set()).add(label)
                more: dict[int, list] = {}
                for r, notice, a, b, errors in _notices(text, bounds):
                    more.setdefault(r, []).append({"label": NOTICES[notice], "start": int(a - bounds[r]), "end": int(b - bounds[r]), "errors": errors, "share": 1 - errors / len(notice)})
                cols: list[list] = [[], [], [], [], [], [], []]
                for r in range(n):
                    p, base, fuzzy = places.get(r, []), labels.get(r, set()), more.get(r, [])
                    score = 1.0 if p else max((max(0.0, x["share"]) for x in fuzzy), default=0.0)
                    for c, v in zip(cols, (len(p), min(p, default=None), max(p, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in fuzzy})), score, [{k: x[k] for k in ("label", "start", "end", "errors")} for x in fuzzy]), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, n), pa.array(np.diff(np.r_[first, len(begins)])), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = docs.select(F.col(id_col).alias("id")).schema
    for field in StructType.fromDDL(_RESULT):
        schema = schema.add(field)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tb.frugal(run), schema)
