"""Best-fit packing of tokenised documents, local first, then up a tree of ever fewer partitions."""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb
from stratacube.sources.workspace import Workspace

#: Bins that miss no more than this many tokens are closed where they are made.
SLACK = 4
#: Partitions merged into one by a round, and bins that one task of a round packs.
FAN_IN, TASK_BINS = 4, 200_000
#: Entries of a worker's memo of encoded text pieces; it only saves time.
MEMO = 1 << 19


class Encoder:
    """ids of whole texts by a byte-level BPE file, each distinct piece of text encoded once.

    The pre-tokenizer always starts a token at a space that is followed by a visible character and always gives
    such a line feed a token of its own, so texts may be cut there and the pieces encoded apart.  The strings of
    special tokens are found before that, as the plain tokenizer does; blanks before one end their text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in special):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(special, key=lambda t: -len(t.content)))) if special else None
        self._forget()

    def _forget(self):
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, owner = [], []
        for a in range(0, len(pieces), 5000):  # as the words of one text, which costs less than texts of their own
            e = self.tokenizer.encode(pieces[a : a + 5000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            owner.append(np.array(e.word_ids, np.int64) + a)
        count = np.bincount(np.concatenate(owner), minlength=len(pieces))
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *ids])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.start, self.count = keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and where each row's begin (n + 1 offsets)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        visible = ~tb.IS_SPACE[data]
        visible &= (data != 0xC2) & ((data < 0xE1) | (data > 0xE3)) & (data > 0x20)  # lead bytes of wide blanks, control separators
        cut = np.zeros(n + 1, dtype=bool)
        visible[offs[:-1][offs[:-1] < n]] = False  # a row's last blank is followed by nothing
        follows = np.flatnonzero(((data[:-1] == 0x20) | (data[:-1] == 0x0A)) & visible[1:])
        cut[follows] = True
        cut[follows[data[follows] == 0x0A] + 1] = True
        if self.special and self.special.search(raw := data.tobytes()):
            found = [m.span() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in self.special.finditer(raw, a, b)]
            for a, b in found:
                cut[max(0, a - 1) : b] = False
            for a, b in found:
                cut[[a, b]] = True
        cut[offs] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], n]
        keys = tb.span_hash(tb.prefix_hash(data), start, end)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        unknown = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(unknown):
            raw = data.tobytes()
            self._learn(distinct[unknown], [raw[start[i] : end[i]].decode("utf-8", "replace") for i in first[unknown].tolist()])
            at = np.searchsorted(self.keys, distinct)
        count, begin = self.count[at][back], self.start[at][back]
        total = np.r_[0, np.cumsum(count)]
        flat = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return flat, total[np.searchsorted(start, offs)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and one end id, cut only where longer than capacity."""

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for r0, r1, data, offs in tb.slices(batch.column(1)):
                ids, at = enc.encode(data, offs)
                rows, pieces, starts, lengths, crcs = [], [], [], [], []
                for r in range(r1 - r0):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(end_id)).astype("<u4")
                    a, k, n = 0, 0, len(own)
                    b = n % capacity or min(n, capacity)
                    while a < n:
                        rows.append(r0 + r)
                        pieces.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        crcs.append(zlib.crc32(own[a:b]))
                        a, b, k = b, b + capacity, k + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tb.frugal(run), "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin; longest items first, each into the fullest bin that holds it."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    spaces: list[int] = []  # distinct free spaces, sorted
    holders: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect.bisect_left(spaces, size)
        if k < len(spaces):
            space = spaces[k]
            b = holders[space].pop()
            if not holders[space]:
                spaces.pop(k)
                del holders[space]
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = space - size
        if left:
            if left not in holders:
                bisect.insort(spaces, left)
                holders[left] = []
            holders[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _pack_partition(capacity: int, level: int):
    """Rows (item columns..., size, part) of one partition get (bin, offset, fill)."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part = table.column("part")[0].as_py()
        sizes = table.column("size").to_numpy()
        for a in range(0, len(sizes), TASK_BINS):
            own = sizes[a : a + TASK_BINS]
            bins, offsets, fill = best_fit(own, capacity)
            number = (level << 58) + (part << 32) + a + bins
            rows = table.slice(a, len(own)).drop_columns(["size", "part"])
            rows = rows.append_column("bin", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fill[bins]))
            yield from rows.to_batches()

    return run


def pack(items: DataFrame, capacity: int, ws: Workspace) -> DataFrame:
    """``items`` (any columns, length) with sequence_id and offset, gapless from 0 in each sequence.

    Round 0 packs each partition of the input by best fit and closes bins that lack at most SLACK tokens.  Every
    further round takes the underfull bins of FAN_IN partitions as items of one, packs them by best fit again
    and closes what has become full.  Rounds end when one partition holds all that is left or a round no longer
    saves a bin in a thousand; each task sees at most TASK_BINS bins at a time, so no task grows with the corpus.
    """
    schema = items.schema
    for name in ("bin", "offset", "fill"):
        schema = schema.add(name, "long")
    rows = items.withColumns({"size": F.col("length"), "part": F.spark_partition_id().cast("long")})
    placed = ws.save(rows.mapInArrow(_pack_partition(capacity, 0), schema), "placed")
    under = placed.groupBy("bin", "fill").agg(F.first(F.lit(1)).alias("one")).where(f"fill < {capacity - SLACK}").select("bin", "fill")
    under = ws.save(under, "under0")
    n, level, maps = under.count(), 0, []
    parts = max(1, placed.select("bin").rdd.getNumPartitions())
    while n > 1:
        level += 1
        parts = max(-(-parts // FAN_IN), -(-n // TASK_BINS), 1)
        spread = under.select(F.col("bin").alias("child"), F.col("fill").alias("size")).repartition(parts, "child").withColumn("part", F.spark_partition_id().cast("long"))
        step = ws.save(spread.mapInArrow(_pack_partition(capacity, level), "child long, bin long, offset long, fill long"), f"map{level}")
        maps.append(step.select("child", "bin", "offset"))
        under = ws.save(step.groupBy("bin").agg(F.first("fill").alias("fill")).where(f"fill < {capacity - SLACK}"), f"under{level}")
        before, n = n, under.count()
        after = step.select(F.count_distinct("bin")).first()[0]
        if parts == 1 or before - after < before / 1000:
            break
    final = None
    for step in reversed(maps):  # from the top down: where a bin of this level ends up
        if final is not None:
            up = final.select(F.col("child").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("above"))
            step = step.join(up, "bin", "left").select("child", F.coalesce("top", "bin").alias("bin"), (F.col("offset") + F.coalesce("above", F.lit(0))).alias("offset"))
        final = step
    if final is None:
        return placed.withColumnRenamed("bin", "sequence_id").drop("fill")
    final = ws.save(final, "moves")
    moved = placed.join(final.select(F.col("child").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("above")), "bin", "left")
    names = [c for c in placed.columns if c not in ("bin", "offset", "fill")]
    return moved.select(*names, F.coalesce("top", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("above", F.lit(0))).alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of a document.

    A document is the ids of its whole text and one end id; null and empty texts are the end id alone.  Only
    documents longer than ``capacity`` are cut, into pieces of exactly that length but for a shorter first one.
    Repeated rows are documents of their own.  An empty table packs into no sequence.  Ties between bins and
    between equal lengths are broken by order within the partition.
    """
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.save(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, capacity, ws)
