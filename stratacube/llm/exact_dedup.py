"""Exact dedup by content sort: sampled splitters, external sort, neighbouring full comparisons."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb
from stratacube.sources.workspace import Workspace

#: Characters of the text that splitters hold; the driver's sample of them stays small however long texts are.
SPLITTER_CHARS = 48
#: Pieces of runs at the edges of partitions, a hundred bytes each, that are handed to every task; more of them are joined.
MOST_PIECES = 1 << 17


def _runs(batches):
    """Of one sorted partition: where neighbours differ in full, and for each row its run's size and last row."""
    ids, shas, new, part, last = [], [], [], None, None
    for batch in batches:
        text = batch.column(1)
        differs = np.ones(len(text), dtype=bool)
        if len(text) > 1:
            differs[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        if last is not None and len(text):
            differs[0] = text[0].as_py() != last
        if len(text):
            last, part = text[-1].as_py(), batch.column(3)[0].as_py()
        ids.append(batch.column(0))
        shas.append(batch.column(2))
        new.append(differs)
    if part is None:
        return
    ids, shas, new = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(shas).combine_chunks(), np.concatenate(new)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(new)]
    run = np.cumsum(new) - 1
    edge = (run == 0) | (run == len(start) - 1)
    is_last = np.zeros(len(new), dtype=bool)
    is_last[end - 1] = True
    whole = pa.RecordBatch.from_arrays([ids, shas, ids.take(pa.array(end[run] - 1)), pa.array((end - start)[run]), pa.array(edge), pa.array(is_last), pa.array(np.full(len(new), part, dtype=np.int32))], ["id", "sha", "run_id", "run_size", "edge", "is_last", "part"])
    for a in range(0, len(new), 20000):
        yield whole.slice(a, 20000)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per input row.

    Rows are ranged over (start of the text, its hash, id) by sampled splitters and sorted; equal texts stand
    side by side, and only a full comparison of neighbours makes them equal.  As the id is part of the range
    key, a group that holds a third of all rows spreads over as many partitions as its rows fill; the pieces
    of a group, at most two rows per partition, are put together afterwards.  Of equal texts the row with the
    largest id stays; null ids come first, so they lose to any other.  Null text counts as empty.  Repeated
    rows are members of their group like any others, and one of them is kept.  No rows, no groups.
    """
    ws = Workspace(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    key = [F.substring("text", 1, SPLITTER_CHARS), F.xxhash64("text"), F.col("id")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    placed = rows.repartitionByRange(*key).sortWithinPartitions(key[0], key[1], "text", "id")
    placed = placed.select("id", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.spark_partition_id().alias("part"))
    runs = ws.save(placed.mapInArrow(tb.frugal(_runs), "id long, sha string, run_id long, run_size long, edge boolean, is_last boolean, part int"), "runs")
    # at most two pieces of runs for each partition: small by construction, whatever the size of a group
    pieces = ws.save(runs.where("edge AND is_last").groupBy(F.col("sha").alias("piece_sha")).agg(F.sum("run_size").alias("all_size"), F.max_by("run_id", "part").alias("all_id"), F.max("part").alias("last_part")), "pieces")
    pieces = F.broadcast(pieces) if pieces.limit(MOST_PIECES + 1).count() <= MOST_PIECES else pieces
    out = runs.join(pieces, (F.col("sha") == F.col("piece_sha")) & F.col("edge"), "left")
    return out.select(
        "id", F.when(F.col("last_part").isNotNull(), F.col("all_id")).otherwise(F.col("run_id")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"), (F.col("is_last") & (F.col("part") == F.coalesce("last_part", "part"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    A row whose id and text are both repeated is one document and stays once.  Rows are told apart by id and text:
    of rows without id, or of one id, only those with a kept text stay.
    """
    ws = Workspace(docs.sparkSession, "exact")
    own, one, sha = (tb.unused(n, docs.columns) for n in ("__own", "__id", "__sha"))
    kept = ws.save(exact_groups(docs, id_col, text_col, normalise).where("kept").select(F.col("id").alias(one), F.col("text_sha256").alias(sha)).distinct(), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    out = docs.withColumn(own, F.sha2(F.encode(text, "UTF-8"), 256))
    out = out.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(one)) & (F.col(own) == F.col(sha)), "left_semi")
    total = docs.select(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("d")).first()
    if total.n != total.d:
        out = out.dropDuplicates([id_col, own])
    return out.drop(own)
