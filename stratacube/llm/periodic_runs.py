"""Periodic runs of words: branching tandem repeats found on an enhanced suffix array, rotated into squares and merged into runs.

The words of many documents are looked at together as numbers that differ from document to document, so that no match
leaves its own.  Prefix doubling orders the suffixes; its ranks for every power of two also tell how far two places
agree, ahead and behind.  The intervals of equal prefixes come from the previous and next smaller common prefix, without a
tree.  In an interval of depth d, a suffix i of any child but the largest is one half of a tandem repeat where the suffix
at i + d or i - d is in the interval too, in another child.  Each such repeat ends a run: it is rotated to the left as long
as the words agree, and repeats of one stretch are one run, that of the smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratacube.llm import textbuf as tb

#: Steps that all pointers take together.
ROUNDS = 32
_RESULT = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def word_numbers(data: np.ndarray, offs: np.ndarray):
    """(start, end, row, number) of every word; equal words of all rows have equal numbers."""
    start, end, row = tb.words(data, offs)
    bounds = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[~tb.IS_SPACE[data]])])
    return start, end, row, kept.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_ranks(numbers: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... numbers of every suffix, until no two are equal.

    ``numbers`` holds a value of its own at the end of each document, so suffixes of different documents never agree.
    """
    _, rank = np.unique(numbers, return_inverse=True)
    ranks, n, h = [rank.astype(np.int32)], len(numbers), 1
    while True:
        rank = ranks[-1]
        # only groups of equal suffixes are ordered anew; a group keeps the place of its first
        size = np.bincount(rank)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return ranks
        ahead = np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)], -1)
        key = rank[open_].astype(np.int64) * (n + 1) + ahead + 1
        by = np.argsort(key, kind="stable")
        key = key[by]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, rank[open_[by]][1:] != rank[open_[by]][:-1]]
        first = np.maximum.accumulate(np.where(group, np.arange(len(by)), 0))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
        if h == 1:  # dense ranks become places in order, so that groups have room for what they split into
            rank = (np.cumsum(size) - size)[rank].astype(np.int32)
        new = rank.copy()
        new[open_[by]] = rank[open_[by]] + (head - first)
        ranks.append(new)
        h *= 2


def agree(ranks: list[np.ndarray], one: np.ndarray, two: np.ndarray, back: bool = False) -> np.ndarray:
    """How many numbers from ``one`` and ``two`` on (with ``back``: before them) are equal; the places differ."""
    one, two, n = one.copy(), two.copy(), len(ranks[0])
    out = np.zeros(len(one), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        if back:
            ok = (one >= step) & (two >= step)
            a, b = np.where(ok, one - step, 0), np.where(ok, two - step, 0)
        else:
            ok = (one < n) & (two < n)
            a, b = np.where(ok, one, 0), np.where(ok, two, 0)
        more = ok & (ranks[k][a] == ranks[k][b])
        out += more * step
        one, two = (one - more * step, two - more * step) if back else (one + more * step, two + more * step)
    return out


def smaller_before(v: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element with a smaller value, -1 where there is none.

    Pointers of all elements jump at once over what they have passed; the few that have far to go then go one by one.
    """
    at = np.arange(-1, len(v) - 1)
    at[v == v.min()] = -1
    open_ = np.flatnonzero(at >= 0)
    for _ in range(ROUNDS):
        open_ = open_[v[at[open_]] >= v[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    if len(open_):
        value, to = v.tolist(), at.tolist()
        for i in open_.tolist():
            j = to[i]
            while j >= 0 and value[j] >= value[i]:
                j = to[j]
            to[i] = j
        at = np.array(to, dtype=at.dtype)
    return at


def tandem_ends(ranks: list[np.ndarray], copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of the branching tandem repeats whose half stands at ``copies`` places or more."""
    where = ranks[-1]
    n = len(where)
    order = np.empty(n, dtype=np.int64)
    order[where] = np.arange(n)
    depth = np.zeros(n + 1, dtype=np.int64)  # depth[k]: what the suffixes at k - 1 and k share
    depth[1:n] = agree(ranks, order[:-1], order[1:])
    left = smaller_before(depth)
    right = n - smaller_before(depth[::-1])[::-1]
    # an interval is named by its first boundary; the boundaries of equal depth in it part its children
    wide = np.flatnonzero((depth > 0) & (right - left >= copies))
    if not len(wide):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = wide[np.lexsort((wide, left[wide], depth[wide]))]
    same = np.r_[False, (left[by][1:] == left[by][:-1]) & (depth[by][1:] == depth[by][:-1])]
    # children: before each boundary, and after the last of an interval
    last = np.r_[~same[1:], True]
    low = np.where(same, np.r_[0, by[:-1]], left[by])
    child_low, child_high = np.r_[low, by[last]], np.r_[by, right[by[last]]]
    name = np.r_[by, by[last]]
    group = np.r_[np.cumsum(~same) - 1, (np.cumsum(~same) - 1)[last]]
    size = child_high - child_low
    # all children but the largest of each interval
    ranked = np.lexsort((size, group))
    largest = ranked[np.r_[group[ranked][1:] != group[ranked][:-1], True]]
    small = np.ones(len(size), dtype=bool)
    small[largest] = False
    child_low, child_high, name, size = child_low[small], child_high[small], name[small], size[small]
    child = np.repeat(np.arange(len(size)), size)
    suffix = order[child_low[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)]
    d, lo, hi = depth[name[child]], left[name[child]], right[name[child]]
    places, halves = [], []
    for other, at in ((suffix + d, suffix), (suffix - d, suffix - d)):
        ok = np.flatnonzero((other >= 0) & (other < n))
        seat = where[other[ok]]
        inside = (seat >= lo[ok]) & (seat < hi[ok]) & ((seat < child_low[child[ok]]) | (seat >= child_high[child[ok]]))
        places.append(at[ok[inside]])
        halves.append(d[ok[inside]])
    return np.concatenate(places), np.concatenate(halves)


def runs_of(numbers: np.ndarray, least_length: int, least_copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least ``least_length`` and ``least_copies`` periods, by start, then period."""
    ranks = suffix_ranks(numbers)
    place, half = tandem_ends(ranks, least_copies)
    begin = place - agree(ranks, place, place + half, back=True) if len(place) else place
    length = place + 2 * half - begin
    by = np.lexsort((half, length, begin))
    begin, length, half = begin[by], length[by], half[by]
    first = np.r_[True, (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])] if len(by) else np.zeros(0, bool)
    begin, length, half = begin[first], length[first], half[first]
    good = (length >= least_length) & (length >= least_copies * half)
    by = np.lexsort((half[good], begin[good]))
    return begin[good][by], length[good][by], half[good][by]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_copies: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed), one row per input row.

    Words are what stands between the blanks [\\x20\\x09-\\x0D], numbered from 0.  runs lists start, length and period of
    every maximal stretch with that smallest period, at least ``least_length`` words and ``least_copies`` (2 or more)
    periods long, by start, then period.  collapsed is the text with one blank between words and of every run its first
    period only.  Null counts as empty; texts without words have no runs and an empty collapsed text.  Repeated rows are
    looked at each by itself; other columns are not read, so their names do not matter.
    """
    if least_copies < 2:
        raise ValueError("a run repeats its period at least once")

    def run(batches):
        for batch in batches:
            for r0, r1, data, offs in tb.slices(batch.column(1)):
                n = r1 - r0
                start, end, row, number = word_numbers(data, offs)
                count = np.bincount(row, minlength=n)
                base = np.cumsum(count) - count
                # a document's words, then a number that stands nowhere else
                names = np.empty(len(row) + n, dtype=np.int64)
                names[np.arange(len(row)) + row] = row * (len(row) + 1) + number
                names[np.cumsum(count + 1) - 1] = n * (len(row) + 1) + np.arange(n)
                begin, length, period = runs_of(names, least_length, least_copies) if len(row) else (np.zeros(0, np.int64),) * 3
                of = np.searchsorted(np.cumsum(count + 1), begin, side="right")
                gone = np.zeros(len(row) + 1, dtype=np.int64)
                np.add.at(gone, begin - of + period, 1)
                np.add.at(gone, begin - of + length, -1)
                keep = np.cumsum(gone)[:-1] == 0
                cut = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(begin - of - base[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(cut), runs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, n), pa.array(count), lists, joined(data, start[keep], end[keep], row[keep], n)], ["id", "n_words", "runs", "collapsed"])

    schema = docs.select(F.col(id_col).alias("id")).schema
    for field in StructType.fromDDL(_RESULT):
        schema = schema.add(field)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tb.frugal(run), schema)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The words at (start, end) of each row with one blank between them."""
    width = end - start
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    kept = data[np.cumsum(inside)[:-1] > 0]
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    room = width + ~last
    out = np.full(int(room.sum()), 32, dtype=np.uint8)
    out[np.arange(len(kept)) + np.repeat(np.cumsum(~last) - ~last, width)] = kept
    size = np.zeros(rows, dtype=np.int64)
    np.add.at(size, row, room)
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(out)])


def brute_force(words: list[str], least_length: int = 6, least_copies: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by trying every period at every place; for tests."""
    found, n = {}, len(words)
    for q in range(1, n // least_copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_copies * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((a, b, q) for (a, b), q in found.items())
