"""Repeated byte strings across a corpus: longest-previous-factor arrays over the places where a repeat is possible.

A suffix array of a whole corpus is out of reach, so suffixes are compared only where they can be equal for
``min_bytes`` bytes.  Each window of that length is owned by its smallest gram (winnowing); equal windows are owned by
equal grams at equal distance.  Grams that occur once own no repeat.  Stretches of windows that are equal as a whole
are one class: all but the earliest have a previous factor at least as long as the stretch.  The classes that share a
gram are cut into cells of a few windows around a core of nearly ``min_bytes`` bytes.  Cells with equal cores meet in one
suffix array; its common prefixes and, for each suffix, the previous and next smaller places in suffix order give the
longest previous factor, and a window is a repeat when that is ``min_bytes`` or more.  A core shared by more cells
than one array should hold is settled window by window, by counting instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb
from stratacube.sources.workspace import Workspace

#: Bytes of one suffix array inside a task.
ARRAY_BYTES = 4 << 20
#: Windows of one cell, and cells of one core that one suffix array takes.
CELL, CORE_CELLS = 32, 8192
#: Stretches of a gram from which its classes are dealt out in parts, one part for so many, and the most parts.
PART_ROWS, MOST_PARTS = 4096, 64
_ALL = np.uint64(2**64 - 1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    m = len(v)
    padded = np.full(-(-m // w) * w, _ALL, dtype=np.uint64)
    padded[:m] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - w + 1], ahead[w - 1 : m])


def stretches(data: np.ndarray, offs: np.ndarray, min_bytes: int):
    """(row, start, windows, lead, gram, context) of each maximal run of windows with one owner."""
    k = max(1, min_bytes // 4)
    n = len(data)
    empty = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    if n < min_bytes:
        return empty
    prefix = tb.prefix_hash(data)
    gram = tb.mix((prefix[k:] - prefix[:-k]) * tb.powers(n)[1][: n - k + 1])
    bits = np.uint64(n.bit_length())
    where = (np.uint64(1) << bits) - np.uint64(1)
    own = (sliding_min((gram & ~where) | np.arange(n - k + 1, dtype=np.uint64), min_bytes - k + 1) & where).astype(np.int64)
    ends = np.zeros(n + 1, dtype=np.int32)
    a, b = offs[:-1], offs[1:] - min_bytes + 1
    ok = b > a
    np.add.at(ends, a[ok], 1)
    np.add.at(ends, b[ok], -1)
    valid = np.cumsum(ends[: len(own)]) > 0
    own[~valid] = -1
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    width = np.diff(np.r_[start, len(own)])
    good = own[start] >= 0
    start, width = start[good], width[good]
    at = own[start]
    second = tb.prefix_hash(data, 1)
    context = tb.span_hash(second, start, start + width - 1 + min_bytes, 1)
    return np.searchsorted(offs, start, side="right") - 1, start, width, at - start, gram[at], context


def suffix_order(text: np.ndarray, at: np.ndarray, place: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` at ``at`` in the order of their first ``reach`` bytes, then of ``place``; and where in it other bytes begin.

    Eight bytes a round, and in each round only the suffixes of groups that these bytes tell apart; most suffixes here
    share long prefixes.
    """
    eights = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(reach + 16, np.uint8)], 8)
    order = np.arange(len(at))
    head = np.zeros(len(at) + 1, dtype=bool)
    head[0] = head[-1] = True
    act = order.copy()
    for k in range(0, reach, 8):
        if len(act) < 2:
            break
        key = np.ascontiguousarray(eights[at[order[act]] + k]).view(">u8").ravel().astype(np.uint64)
        if reach - k < 8:
            key >>= np.uint64(8 * (8 - reach + k))
        start = np.flatnonzero(head[act])
        group = np.cumsum(head[act]) - 1
        apart = key != key[start][group]
        if not apart.any():
            continue
        some = np.logical_or.reduceat(apart, start)[group]
        sub, key, group = act[some], key[some], group[some]
        by = np.lexsort((key, group))
        order[sub] = order[sub[by]]
        key = key[by]
        head[sub[1:]] |= key[1:] != key[:-1]
        alone = head[:-1] & head[1:]
        act = act[~alone[act]]
    if len(act):
        order[act] = order[act[np.lexsort((place[order[act]], np.cumsum(head[act])))]]
    return order, head[:-1]


def common_prefixes(prefix: np.ndarray, one: np.ndarray, two: np.ndarray, reach: int) -> np.ndarray:
    """Bytes, up to ``reach``, that the suffixes at ``one`` and ``two`` share, by bisection over hashes of spans."""
    room = np.minimum(len(prefix) - 1 - np.maximum(one, two), reach)
    low, high = np.zeros(len(one), np.int64), room.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        a, b = one[open_], two[open_]
        same = tb.span_hash(prefix, a, a + mid) == tb.span_hash(prefix, b, b + mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def smaller_before(place: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element with a smaller value, -1 where there is none; pointers jump over what they have passed."""
    at = np.arange(-1, len(place) - 1)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[place[at[open_]] > place[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def longest_previous_factors(text: np.ndarray, at: np.ndarray, place: np.ndarray, reach: int, any_other: bool = False) -> np.ndarray:
    """For the suffixes of ``text`` at ``at``, which stand at ``place`` in the corpus: longest previous factor, up to ``reach`` bytes.

    In suffix order the earlier suffix that shares most with one is the nearest before it or after it with a smaller
    place.  With ``any_other`` later suffixes count too: then the one that shares most is a neighbour.
    """
    order, head = suffix_order(text, at, place, reach)
    prefix, start, seat, group = tb.prefix_hash(text), at[order], place[order], np.cumsum(head)
    n = len(order)
    here = np.arange(n)
    if any_other:
        around = (here - 1, here + 1)
    else:
        around = (smaller_before(seat), n - 1 - smaller_before(seat[::-1])[::-1])
    factor = np.zeros(n, dtype=np.int64)
    for other in around:
        some = np.flatnonzero((other >= 0) & (other < n))
        same = group[some] == group[other[some]]
        factor[some[same]] = np.minimum(reach, len(text) - np.maximum(start[some[same]], start[other[some[same]]]))
        some = some[~same]
        factor[some] = np.maximum(factor[some], common_prefixes(prefix, start[some], start[other[some]], reach))
    out = np.empty(n, np.int64)
    out[order] = factor
    return out


def _cells_in_order(min_bytes: int, keep_first: bool):
    """Settle cells (core, id, kh, start, windows, bytes) of a partition sorted by core."""

    def settle(rows):
        cores, ids, khs, starts, wins, raw = zip(*rows, strict=True)
        wins = np.array(wins)
        lengths = np.array([len(x) for x in raw])
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        base = np.cumsum(lengths) - lengths
        cell = np.repeat(np.arange(len(wins)), wins)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(wins) - wins, wins)
        # places in the corpus, as ranks of (id, kh, start)
        by = np.lexsort((np.array(starts), np.array(khs), np.array([-(2**63) if x is None else x for x in ids])))
        seat = np.empty(len(wins), dtype=np.int64)
        seat[by] = np.arange(len(wins))
        hit = longest_previous_factors(text, base[cell] + nth, seat[cell] * CELL + nth, min_bytes, any_other=not keep_first) >= min_bytes
        flag = np.zeros(len(hit) + 1, dtype=bool)
        flag[:-1] = hit
        fresh = flag[:-1] & np.r_[True, ~hit[:-1] | (cell[1:] != cell[:-1])]
        first = np.flatnonzero(fresh)
        stop = np.flatnonzero(flag[:-1] & (~flag[1:] | np.r_[cell[1:] != cell[:-1], True]))
        out = cell[first].tolist()
        return [[ids[c] for c in out], [khs[c] for c in out], [starts[c] + int(x) for c, x in zip(out, nth[first], strict=True)], [starts[c] + int(x) + min_bytes for c, x in zip(out, nth[stop], strict=True)]]

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= ARRAY_BYTES:
                    yield _spans(settle(held))
                    held, size = [], 0
                last, size = row[0], size + len(row[5])
                held.append(row)
        if held:
            yield _spans(settle(held))

    return run


def _windows(min_bytes: int):
    """Each window of cells (core, id, kh, start, windows, bytes) by core, two hashes of its bytes, and place."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                data, offs = tb.text_buffer(part.column(5))
                wins = part.column(4).to_numpy().astype(np.int64)
                cell = np.repeat(np.arange(len(wins)), wins)
                nth = np.arange(len(cell)) - np.repeat(np.cumsum(wins) - wins, wins)
                at = offs[:-1][cell] + nth
                hashes = [pa.array(tb.span_hash(tb.prefix_hash(data, k), at, at + min_bytes, k).view(np.int64)) for k in (0, 1)]
                take = [part.column(k).take(pa.array(cell)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([take[0], *hashes, take[1], take[2], pa.array(part.column(3).to_numpy()[cell] + nth)], ["core", "h0", "h1", "id", "kh", "lo"])

    return run


def _spans(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "kh", "lo", "hi"])


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, min_bytes: int, keep_first: bool, ws: Workspace) -> DataFrame:
    """(id, kh, lo, hi): byte ranges, one per stretch, whose windows of ``min_bytes`` bytes also start elsewhere (earlier)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("kh", F.xxhash64("text"))

    def find(batches):
        for batch in batches:
            for r0, r1, data, offs in tb.slices(batch.column(2)):
                row, start, width, lead, gram, context = stretches(data, offs, min_bytes)
                rows = pa.array(row + r0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start - offs[row]), pa.array(width.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["id", "kh", "lo", "width", "lead", "gram", "context"])

    anchors = ws.save(texts.where(F.octet_length("text") >= min_bytes).select("id", "kh", "text").mapInArrow(tb.frugal(find), "id long, kh long, lo long, width int, lead int, gram long, context long"), "anchors")
    # tables of their own on the short side of each join, so that Spark can split a gram or class that is hot on the long side
    twice = ws.save(anchors.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram", F.least(F.ceil(F.col("c") / PART_ROWS), F.lit(MOST_PARTS)).cast("int").alias("parts")), "twice")
    cand = ws.save(anchors.join(twice, "gram"), "cand")
    ws.drop("anchors", "twice")
    key = ["gram", "lead", "width", "context"]
    classes = ws.save(cand.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct("id", "kh", "lo")).alias("rep"), F.max("parts").alias("parts")), "classes")
    # a class may hold most of all stretches: each of its parts meets a row of its own
    reps = classes.where("c > 1").select(*key, "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = cand.withColumn("part", F.pmod(F.xxhash64("id", "kh", "lo"), F.col("parts")).cast("int"))
    whole = dealt.join(reps, [*key, "part"])
    if keep_first:
        whole = whole.where(~F.struct("id", "kh", "lo").eqNullSafe(F.col("rep")))
    whole = whole.select("id", "kh", "lo", (F.col("lo") + F.col("width") + (min_bytes - 1)).alias("hi"))

    # stretches that share a gram but differ as a whole: one representative of each, cut into cells
    several = ws.save(classes.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "several")
    open_ = classes.join(several, "gram", "left_semi").groupBy(F.col("rep.id").alias("id"), F.col("rep.kh").alias("kh")).agg(F.collect_list(F.struct(F.col("rep.lo").alias("lo"), "lead", "width")).alias("parts"))
    open_ = ws.save(open_, "open")
    pick = open_.withColumnsRenamed({"id": "id2", "kh": "kh2"})
    joined = texts.join(pick, F.col("id").eqNullSafe(F.col("id2")) & (F.col("kh") == F.col("kh2"))).select("id", "kh", "text", "parts")

    def cells(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            size = 0
            for i, parts in enumerate(batch.column(3).to_pylist()):
                raw = batch.column(2)[i].as_py().encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                prefix = tb.prefix_hash(data, 1)
                at = np.array([(p["lo"], p["lead"], p["width"]) for p in parts], dtype=np.int64)
                # distance of window start to gram runs from lead down to lead - width + 1; cells lie on a grid of that distance
                for lo, lead, width in at.tolist():
                    o = lead
                    while o > lead - width:
                        floor = (o // CELL) * CELL
                        stop = max(floor, lead - width + 1)
                        first, count = lo + lead - o, o - stop + 1
                        # every window of the grid cell holds these bytes, from its last start to its first end
                        a, b = lo + lead - floor, lo + lead - floor - CELL + 1 + min_bytes
                        core = (int(tb.span_hash(prefix, np.array([a]), np.array([b]), 1)[0]) ^ floor * 0x9E3779B97F4A7C15) & (2**64 - 1)
                        piece = raw[first : first + count - 1 + min_bytes]
                        for c, v in zip(out, (core - 2**63, batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), first, count, piece), strict=True):
                            c.append(v)
                        size += len(piece)
                        o = stop - 1
                if size > 8 << 20:
                    yield _cells(out)
                    out, size = [[], [], [], [], [], []], 0
            yield _cells(out)

    def _cells(columns):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["core", "id", "kh", "lo", "windows", "raw"])

    cut = ws.save(joined.mapInArrow(tb.frugal(cells), "core long, id long, kh long, lo long, windows int, raw binary"), "cells")
    cores = ws.save(cut.groupBy("core").agg(F.count("*").alias("c")).where("c > 1"), "cores")
    met = cut.join(cores.where(f"c <= {CORE_CELLS}").select("core"), "core", "left_semi")
    met = met.repartition("core").sortWithinPartitions("core").select("core", "id", "kh", "lo", "windows", "raw")
    parts = met.mapInArrow(tb.frugal(_cells_in_order(min_bytes, keep_first)), "id long, kh long, lo long, hi long")
    if cores.where(f"c > {CORE_CELLS}").limit(1).count():
        crowd = cut.join(cores.where(f"c > {CORE_CELLS}").select("core"), "core", "left_semi").mapInArrow(tb.frugal(_windows(min_bytes)), "core long, h0 long, h1 long, id long, kh long, lo long")
        crowd = ws.save(crowd, "crowd")
        same = ws.save(crowd.groupBy("core", "h0", "h1").agg(F.count("*").alias("c"), F.min(F.struct("id", "kh", "lo")).alias("rep")).where("c > 1").drop("c"), "same")
        hits = crowd.join(same, ["core", "h0", "h1"])
        hits = hits.where(~F.struct("id", "kh", "lo").eqNullSafe(F.col("rep"))) if keep_first else hits
        parts = parts.unionByName(hits.select("id", "kh", "lo", (F.col("lo") + min_bytes).alias("hi")))
    # a representative that has copies is wholly covered unless the first copy is kept
    return whole.unionByName(parts)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, keep_first: bool = True, whole_chars: bool = False, columns: tuple[str, str, str, str] = ("n_bytes", "n_removed", "n_spans", "kept"), kept_text: str | None = None) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, n_spans and kept (binary), named by ``columns``, one row per input row.

    Every byte covered by a string of ``min_bytes`` bytes that also starts elsewhere is removed, whether in the
    same text or another, overlaps included; strings are judged on the input.  With ``keep_first`` only strings
    that start earlier, by (id, position), count, so the first copy stays.  With ``whole_chars`` removed runs are
    narrowed to whole characters, so that what is kept is UTF-8 again.  Texts are whole UTF-8 byte strings;
    null counts as empty.  Repeated rows are copies of each other when both are there to compare: rows of equal
    id and text share their decision.  Shorter texts and empty tables lose nothing.  ``kept_text`` names a further
    column with what is kept as a string, without the halves of characters that a cut leaves.  Input columns of the
    same names as the results are replaced.
    """
    ws = Workspace(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, id_col, text_col, min_bytes, keep_first, ws)
    added = [*columns, *([kept_text] if kept_text else [])]
    own = tb.others(docs.columns, added)
    text_, spans_, id_, kh_ = (tb.unused(n, docs.columns) for n in ("__text", "__spans", "__id", "__kh"))
    per_doc = spans.groupBy("id", "kh").agg(F.collect_list(F.struct("lo", "hi")).alias(spans_)).withColumnsRenamed({"id": id_, "kh": kh_})
    base = docs.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_))
    joined = base.join(per_doc, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_) == F.col(kh_)), "left").drop(id_, kh_)

    def remove(batches):
        for batch in batches:
            names = batch.schema.names
            text, spans = batch.column(names.index(text_)), batch.column(names.index(spans_))
            lists = spans.to_pylist() if spans.null_count < len(spans) else [None] * len(spans)
            sizes, removed, runs, kept = [], [], [], []
            for raw, found in zip(tb.to_utf8(text), lists, strict=True):
                gone, pieces, at = [], [], 0
                for s in sorted(found or [], key=lambda s: s["lo"]):
                    if gone and s["lo"] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], s["hi"])
                    else:
                        gone.append([s["lo"], s["hi"]])
                if whole_chars:
                    for run in gone:
                        while run[0] < run[1] and raw[run[0]] & 0xC0 == 0x80:
                            run[0] += 1
                        while run[0] < run[1] < len(raw) and raw[run[1]] & 0xC0 == 0x80:
                            run[1] -= 1
                for a, b in gone:
                    pieces.append(raw[at:a])
                    at = b
                pieces.append(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
                kept.append(b"".join(pieces))
            found = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            if kept_text:
                found.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i, c in enumerate(names) if c not in (text_, spans_)] + found, [*own, *added])

    schema = base.select(*own).schema
    for name, kind in zip(added, ("long", "long", "long", "binary", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(tb.frugal(remove), schema)


def sha256_hex(column: str):
    return F.sha2(F.col(column), 256)


def brute_force(texts: list[bytes], min_bytes: int, keep_first: bool) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, sha256 of the rest) of each text, by a dictionary of all windows; for tests."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - min_bytes + 1):
            seen.setdefault(t[j : j + min_bytes], []).append((i, j))
    masks = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for i, j in places[1:] if keep_first else places if len(places) > 1 else []:
            masks[i][j : j + min_bytes] = b"\1" * min_bytes
    out = []
    for t, m in zip(texts, masks, strict=True):
        rest = bytes(b for b, x in zip(t, m, strict=True) if not x)
        out.append((sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(rest).hexdigest()))
    return out
