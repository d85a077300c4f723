"""Ranked lexical search: a block-wise inverted index, and a search that goes term at a time first, then document at a time.

The index is a table with one row for each block of documents: the terms, the documents of each and how often they hold
it.  A block is searched where it lies, so no list of a common term is ever in one place.  In a block the short lists of
an item are summed up term at a time; the accumulators that this leaves are then one more iterator with a bound on what
it gives.  It joins the long lists in a document-at-a-time pass: lists that together cannot reach the worst of the best
documents so far bring no documents, they are only looked up for those that the others bring, and only while these can
still get there.  The best documents of a task are carried from block to block; those of all tasks are merged in two steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb
from stratacube.llm.license_scan import IS_GAP
from stratacube.sources.workspace import Workspace

#: Text of one block, and blocks of one file of the index.
BLOCK_BYTES, FILE_BLOCKS = 8 << 20, 8
#: Text of the items that are searched for in one pass over the index.
ITEM_BYTES = 2 << 20
#: A list is short when it holds at most one in so many documents of a block.
SHORT_SHARE = 8
#: Documents that the pass goes through at a time.
WINDOW = 1024
#: Groups in which the best of the tasks are merged first.
MERGE = 64
_INDEX = "n_docs long, n_terms long, ids array<bigint>, lengths array<int>, terms array<binary>, bounds array<int>, docs array<int>, times array<int>"


def terms(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every term of ``column`` in order: runs of letters, digits and signs beyond ASCII, A-Z lowered."""
    rows, parts = [np.zeros(0, np.int64)], [pa.array([], pa.binary())]
    for r0, _, data, offs in tb.slices(column):
        low = tb.LOWER[data]
        start, end, row = tb.words(low, offs, IS_GAP)
        bounds = np.r_[0, np.cumsum(end - start)].astype(np.int32)
        parts.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(low[~IS_GAP[low]])]))
        rows.append(row + r0)
    return np.concatenate(rows), pa.concat_arrays(parts)


def _lists(columns: list[tuple[np.ndarray, type]]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, kind)) for c, kind in columns]


def index_block(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row of the index: for each term of the block its documents, in order, and how often each holds it."""
    row, found = terms(texts)
    coded = found.dictionary_encode()
    n = max(1, len(ids))
    key, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + row, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(coded.dictionary) + 1, dtype=np.int64) * n)
    lengths = np.bincount(row, minlength=len(ids))
    lists = _lists([(ids, pa.int64()), (lengths, pa.int32()), (coded.dictionary, pa.binary()), (bounds, pa.int32()), (key % n, pa.int32()), (times, pa.int32())])
    return pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())]), pa.array([len(row)]), *lists], [c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    """The index of all ``docs``, written; a row is a block of about ``BLOCK_BYTES`` of text, a longer text stands alone."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            _, offs = tb.text_buffer(batch.column(1))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(offs, offs[row] + BLOCK_BYTES - size, side="right")) - 1)
                held.append(batch.slice(row, end - row))
                size += int(offs[end] - offs[row])
                row = end
                if size >= BLOCK_BYTES or row < batch.num_rows:
                    yield index_block(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)))
                    held, size = [], 0
        if held:
            yield index_block(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    index = texts.mapInArrow(tb.frugal(run), _INDEX)
    index.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_BLOCKS).parquet(f"{ws.path}/index")
    return ws.load("index", index)


class Items:
    """The items of one pass: their ids, the terms of all, and each item's terms with how often it holds them."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        row, found = terms(texts)
        coded = found.dictionary_encode()
        n = max(1, len(coded.dictionary))
        key, times = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        cut = np.searchsorted(key, np.arange(len(ids) + 1) * n)
        self.ids, self.terms = ids, coded.dictionary
        self.lists = [(key[a:b] % n, times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.weight = np.zeros(len(self.terms), np.int64)


class Best:
    """The ``k`` best (score, id) so far; equal scores by ascending id, null first."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def push(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.known, known]
        by = np.lexsort((ids, known, -score))[: self.k]
        self.score, self.id, self.known = score[by], ids[by], known[by]
        if len(by) == self.k:
            self.least = int(self.score[-1])


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, least: int, take) -> None:
    """Give ``take`` the (documents, scores) that can be among the best; it returns the score that the next ones must reach.

    ``lists`` are (documents in order, what each gives) of the item's terms.
    """
    sums = np.zeros(n_docs, np.int64)
    long = []
    for docs, gain in lists:
        if len(docs) * SHORT_SHARE <= n_docs:
            sums[docs] += gain
        else:
            long.append((int(gain.max()), docs, gain))
    held = np.flatnonzero(sums)
    if len(held):
        long.append((int(sums.max()), held, sums[held]))
    long.sort(key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in long])
    for lo in range(0, n_docs if long else 0, WINDOW):
        must = int(np.searchsorted(reach, least))  # the lists before this one cannot bring a document by themselves
        if must == len(long):
            return
        score = np.zeros(WINDOW, np.int64)
        for _, docs, gain in long[must:]:
            a, b = np.searchsorted(docs, (lo, lo + WINDOW))
            score[docs[a:b] - lo] += gain[a:b]
        some = np.flatnonzero(score)
        for k in range(must - 1, -1, -1):
            some = some[score[some] + reach[k] >= least]
            if not len(some):
                break
            _, docs, gain = long[k]
            at = np.minimum(np.searchsorted(docs, some + lo), len(docs) - 1)
            hit = docs[at] == some + lo
            score[some[hit]] += gain[at[hit]]
        some = some[score[some] >= least]
        if len(some):
            least = take(some + lo, score[some])


def _column(batch: pa.RecordBatch, k: int, r: int) -> np.ndarray:
    values = batch.column(k)[r].values
    return values.to_numpy(zero_copy_only=False)


def _frequencies(items: Items):
    """(term, df) of the items' terms over the blocks of a task."""

    def run(batches):
        df = np.zeros(len(items.terms), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                at = pc.index_in(items.terms, value_set=batch.column(0)[r].values).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
                width = np.diff(_column(batch, 1, r))
                df[some] += width[at[some].astype(np.int64)]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], ["term", "df"])

    return run


def _search(items: Items, n: int, total: int, k: int):
    """(item, doc_id, score): the best of the blocks of a task."""

    def run(batches):
        best = [Best(k) for _ in items.lists]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(2)[r].values
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                m = 100 - 25 + (25 * _column(batch, 3, r).astype(np.int64) * n) // max(1, total)
                at = pc.index_in(items.terms, value_set=batch.column(4)[r].values).fill_null(-1).to_numpy(zero_copy_only=False)
                bounds, docs, times = (_column(batch, c, r).astype(np.int64) for c in (5, 6, 7))
                lists = {}
                for t in np.flatnonzero(at >= 0).tolist():
                    a, b = bounds[at[t]], bounds[at[t] + 1]
                    tf = times[a:b]
                    lists[t] = docs[a:b], items.weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs[a:b]]))
                for top, (held, repeats) in zip(best, items.lists, strict=True):

                    def take(found, score, top=top):
                        top.push(score, ids[found], known[found])
                        return top.least

                    mine = [(lists[t][0], lists[t][1] * c if c > 1 else lists[t][1]) for t, c in zip(held.tolist(), repeats.tolist(), strict=True) if t in lists]
                    search_block(mine, len(ids), top.least, take)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(item):
            found = pa.array(np.concatenate([b.id for b in best]), mask=~np.concatenate([b.known for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), items.ids.take(pa.array(item)), found, pa.array(np.concatenate([b.score for b in best]))], ["item", "item_id", "doc_id", "score"])

    return run


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``k`` documents of highest score above 0, best first.

    A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and gives w (10^9 tf div (1000 tf + 12 m)), with m = 75 +
    25 n N div L for a document of n terms, N documents with terms and L terms in all; an item's repeated terms count
    as often as they stand there.  Scores are exact integers.  Equal scores are ranked by ascending id, a null id
    first.  Null and empty texts have no terms: such documents are never found and such items get no rows.  Repeated
    documents are ranked each by itself; repeated rows of ``items`` give one list.  Items of one id and different texts
    each give a list under that id.  Other columns are not read, so their names do not matter; empty tables give no rows.

    Items are searched for in passes over the index of about ``ITEM_BYTES`` of their text each, so that what goes to the
    tasks does not grow with their number.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "search")
    index = build_index(docs, id_col, text_col, ws)
    size = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = int(size[0] or 0), int(size[1] or 0)
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).alias("text")).distinct()
    asked = ws.save(asked, "items")
    passes = -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    schema = asked.select(F.lit(0).cast("int").alias("item"), "item_id").schema.add("doc_id", "long").add("score", "long")
    found = spark.createDataFrame([], schema).select(F.lit(0).alias("part"), F.lit(0).alias("pass"), "*")
    for p in range(passes):
        now = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).toArrow().combine_chunks()
        if not now.num_rows:
            continue
        wanted = Items(*(now.column(c).combine_chunks() for c in (0, 1)))
        for row in index.select("terms", "bounds").mapInArrow(tb.frugal(_frequencies(wanted)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            wanted.weight[row["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * row["df"] + 1)))
        hits = index.mapInArrow(tb.frugal(_search(wanted, n, total, k)), schema)
        found = found.unionByName(hits.select(F.pmod(F.spark_partition_id(), F.lit(MERGE)).alias("part"), F.lit(p).alias("pass"), "*"))
    near = _best(found, ["part", "pass", "item"], k).drop("rank")
    return _best(near, ["pass", "item"], k).select("item_id", "rank", "doc_id", "score")


def brute_force(texts: list[tuple[int | None, str | None]], item: str, k: int) -> list[tuple[int, int | None, int]]:
    """(rank, doc_id, score) of one item by scoring every document; for tests."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, words(t)) for i, t in texts]
    n, total = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df: dict[str, int] = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, w in docs:
        m = 75 + (25 * len(w) * n) // max(1, total)
        score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 12 * m)) for t in words(item) if t in w)
        if score > 0:
            out.append((-score, i is not None, i or 0, i))
    return [(r, i, -s) for r, (s, _, _, i) in enumerate(sorted(out)[:k], 1)]
