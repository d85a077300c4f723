"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice; lossless decoding.

Pieces hold blanks only at their front and never a line feed, so a text falls apart into segments, a run of blanks
and the word after it, whose lattices are independent.  A slice of rows builds the lattice of each distinct segment
once.  A position that no piece spans is on every path, so segments are cut there once more, and the parts are filtered
and sampled all together; long parts, of texts without blanks, are followed one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb

_META = b"\xe2\x96\x81"
#: Bytes of a part of a segment beyond which it is followed by itself.
DEEP = 64
#: Scores below this stand for pieces that the model was given, not for what it has learnt.
GIVEN = -1e6


class Pieces:
    """Bytes and weights of a piece model's vocabulary; the blank sign counts as a blank."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, score = [], []
        self.byte_id = np.zeros(256, dtype=np.int64)
        by_length: dict[int, list[int]] = {}
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(model.id_to_piece(i).encode().replace(_META, b" "))
                if raw[-1] and b"\n" not in raw[-1]:
                    by_length.setdefault(len(raw[-1]), []).append(i)
            score.append(model.get_score(i) if raw[-1] and not model.is_byte(i) else -np.inf)
        self.length = np.array([len(r) for r in raw])
        self.most = int(self.length.max())
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        # a merge model scores a piece by its negative rank, and by Zipf's law a piece of rank r weighs 1 / r; other
        # models score by log probability; given pieces and bytes weigh less than any other
        score = np.array(score)
        learnt = score > GIVEN
        if (score[learnt] == np.round(score[learnt])).all():
            score[learnt] = -np.log(1.0 - np.minimum(score[learnt], 0.0))
        score[~learnt] = score[learnt].min(initial=0.0) - 1.0
        self.weight = alpha * score
        self.tables = []
        self.maybe = np.zeros(1 << 20, dtype=bool)  # by hash: whether some piece may be meant
        self.longest = np.full(1 << 24, 2, dtype=np.uint8)  # by first three bytes: the longest piece that begins so
        for r in raw:
            if len(r) > 2:
                k = (r[0] << 16) | (r[1] << 8) | r[2]
                self.longest[k] = max(self.longest[k], len(r))
        prefix = tb.prefix_hash(self.bytes)
        for n, ids in sorted(by_length.items()):
            ids = np.array(ids)
            keys = tb.span_hash(prefix, self.start[ids], self.start[ids] + n)
            order = np.argsort(keys)
            self.tables.append((n, keys[order], ids[order]))
            self.maybe[keys >> np.uint64(44)] = True

    def lattice(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Edges (from, to, piece) over byte positions of x; no edge leaves its segment, which is [start, end)."""
        seg_end = np.repeat(ends, ends - starts)
        prefix = tb.prefix_hash(x)
        lead = (x & 0xC0) != 0x80  # pieces begin at characters
        chars = at = np.flatnonzero(lead)
        after = np.r_[x[1:], np.zeros(2, np.uint8)]
        opening = (x.astype(np.int32) << 16) | (after[: len(x)].astype(np.int32) << 8) | after[1 : len(x) + 1]
        reach = np.minimum(self.longest[opening], seg_end - np.arange(len(x)))
        source, target, piece = [], [], []
        for n, keys, ids in self.tables:
            p = at = at[reach[at] >= n]  # longer pieces start at fewer places
            if not len(p):
                break
            h = tb.span_hash(prefix, p, p + n)
            some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            p, h = p[some], h[some]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            source.append(p[hit])
            target.append(p[hit] + n)
            piece.append(ids[k[hit]])
        a = np.concatenate(source) if source else np.zeros(0, np.int64)
        b = np.concatenate(target) if target else np.zeros(0, np.int64)
        p = np.concatenate(piece) if piece else np.zeros(0, np.int64)
        # characters without a piece of their own fall back to bytes
        char_end = np.r_[chars[1:], len(x)]
        single = np.zeros(len(x) + 1, dtype=bool)
        own_end = np.zeros(len(x) + 1, dtype=np.int64)
        own_end[chars] = char_end
        single[a[own_end[a] == b]] = True
        bare = ~single[chars[np.cumsum(lead) - 1]] if len(x) else np.zeros(0, bool)
        q = np.flatnonzero(bare)
        return np.r_[a, q], np.r_[b, q + 1], np.r_[p, self.byte_id[x[q]]]

    def filter_forward(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, base: np.ndarray, size: int) -> np.ndarray:
        """log of the summed weights of all paths from a part's start to each position; edges sorted by (depth, to)."""
        alpha = np.full(size + 1, -np.inf)
        depth = b - base
        level = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else []
        reach = np.full(size + 1, -np.inf)  # alpha by position as a target; where a part begins it counts as 0
        for i, s in enumerate(level):
            if depth[s] > DEEP:
                break
            e = level[i + 1] if i + 1 < len(level) else len(b)
            from_start = a[s:e] == base[s:e]
            v = np.where(from_start, 0.0, reach[a[s:e]]) + w[s:e]
            t = b[s:e]
            cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            top = np.maximum.reduceat(v, cut)
            total = np.add.reduceat(np.exp(v - np.repeat(np.where(np.isfinite(top), top, 0.0), np.diff(np.r_[cut, len(t)]))), cut)
            with np.errstate(divide="ignore"):
                reach[t[cut]] = np.where(np.isfinite(top), top + np.log(total), -np.inf)
        rest = int(np.searchsorted(depth, DEEP, side="right"))
        known: dict[int, float] = {}
        for source, target, weight, first in zip(a[rest:].tolist(), b[rest:].tolist(), w[rest:].tolist(), base[rest:].tolist()):
            v = weight + (0.0 if source == first else known[source] if source in known else float(reach[source]))
            before = known.get(target, -math.inf)
            top = max(v, before)
            known[target] = top + math.log(math.exp(v - top) + math.exp(before - top)) if top > -math.inf else top
        if known:
            reach[list(known)] = list(known.values())
        alpha[:] = reach
        return alpha


_loaded: dict = {}


def pieces(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Pieces(path, alpha)
    return _loaded[path, alpha]


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with one blank put in front, as one buffer; starts of its segments; where each row begins (n + 1)."""
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(offs))
    x = np.full(len(data) + rows, 32, dtype=np.uint8)
    x[np.arange(len(data)) + row + 1] = data
    bounds = offs + np.arange(rows + 1)
    cut = np.zeros(len(x) + 1, dtype=bool)
    cut[bounds[:-1]] = True
    cut[1:-1] |= (x[1:] == 32) & (x[:-1] != 32)
    feed = np.flatnonzero(x == 10)
    cut[feed] = True
    cut[feed + 1] = True
    return x, np.flatnonzero(cut[:-1]), bounds


def _draw_alone(key: int, end: int, origin: int, first_edge: np.ndarray, within: np.ndarray, a: np.ndarray, first: int) -> list[int]:
    """The edges of one long part from its end back to its start, by the draws that ``_uniform`` gives; ``first`` is the step of the first."""
    steps = np.arange(first, first + end - origin, dtype=np.uint64)
    draws = _uniform(np.uint64(key), steps)
    out, at = [], end
    for u in draws:
        edge = int(first_edge[at])
        while u >= within[edge]:
            edge += 1
        out.append(edge)
        at = int(a[edge])
        if at == origin:
            break
    return out


def _uniform(key: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    turn = np.uint64((step + 1) * 0xD1B54A32D192ED03 % 2**64) if isinstance(step, int) else (step + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    h = tb.mix(key + turn)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def sample_slice(model: Pieces, data: np.ndarray, offs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all rows, offsets of each row's ids, log probability of each row's sample)."""
    rows = len(offs) - 1
    x, start, bounds = segments(data, offs)
    end = np.r_[start[1:], len(x)]
    _, first, back = np.unique(tb.span_hash(tb.prefix_hash(x), start, end), return_index=True, return_inverse=True)
    # the distinct segments side by side, one unused position after each so that no start is also an end
    length = (end - start)[first]
    u_start = np.cumsum(length + 1) - (length + 1)
    size = int((length + 1).sum())
    y = np.zeros(size, dtype=np.uint8)
    put = np.repeat(u_start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    y[put] = x[np.repeat(start[first], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)]
    a, b, p = model.lattice(y, u_start, u_start + length + 1)
    inside = y[a] != 0
    real_end = np.repeat(u_start + length, length + 1)
    inside = (b <= real_end[a]) & (a < real_end[a])
    a, b, p = a[inside], b[inside], p[inside]
    # parts: segments cut at the positions that no edge spans
    spans = np.cumsum(np.bincount(a + 1, minlength=size + 2) - np.bincount(b, minlength=size + 2))[:size]
    opens = spans == 0
    opens[u_start + length] = False
    opens[u_start] = True
    part_start = np.flatnonzero(opens)
    part_of = np.cumsum(opens) - 1
    part_end = np.minimum(np.r_[part_start[1:], size], real_end[part_start])
    base = part_start[part_of[a]]
    if model.most >= 64:
        raise ValueError("pieces of 64 bytes and more are not supported")
    order = np.argsort(((b - base) << 40) | (b << 6) | (b - a))  # pieces are shorter than 64 bytes
    a, b, p, base = a[order], b[order], p[order], base[order]
    w = model.weight[p]
    alpha = model.filter_forward(a, b, w, base, size)
    before = np.where(a == base, 0.0, alpha[a])
    ok = np.isfinite(before) & np.isfinite(alpha[b])
    a, b, p, w, before = a[ok], b[ok], p[ok], w[ok], before[ok]
    share = np.exp(before + w - alpha[b])
    # likely edges first, so that few are looked at; the order within a position depends on the segment alone
    by = np.argsort((b << 26) | ((np.clip(1.0 - share, 0.0, 1.0) * (2**20 - 1)).astype(np.int64) << 6) | (b - a))
    a, b, p, w, share = a[by], b[by], p[by], w[by], share[by]
    node_first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    first_edge = np.zeros(size + 1, dtype=np.int64)
    first_edge[b[node_first]] = node_first
    within = np.cumsum(share)
    within -= np.repeat(within[node_first] - share[node_first], np.diff(np.r_[node_first, len(b)]))
    last_of = np.r_[node_first[1:], len(b)] - 1
    within[last_of] = 2.0  # the last edge takes what rounding leaves
    # the places of the parts, in the order of the text
    parts = np.diff(np.r_[part_of[u_start], len(part_start)])[back]
    before_seg = np.r_[0, np.cumsum(parts)]
    place = np.repeat(part_of[u_start][back] - before_seg[:-1], parts) + np.arange(before_seg[-1])
    at, origin = part_end[place], part_start[place]
    row = np.repeat(np.searchsorted(bounds, start, side="right") - 1, parts)
    row_first = before_seg[np.searchsorted(start, bounds)]
    seq = np.arange(len(place)) - row_first[row]
    mixed = tb.mix(keys)[row] + seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    deep = at - origin > DEEP
    live = np.flatnonzero(~deep)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(place), dtype=np.int64)
    logp = -alpha[at]
    while len(live):
        edge = first_edge[at[live]]
        u = _uniform(mixed[live], len(steps))
        on = np.flatnonzero(u >= within[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= within[edge[on]]]
        steps.append((live, p[edge]))
        count[live] += 1
        logp[live] += w[edge]
        at[live] = a[edge]
        live = live[at[live] != origin[live]]
    alone = {}
    for i in np.flatnonzero(deep).tolist():
        edges = _draw_alone(int(mixed[i]), int(at[i]), int(origin[i]), first_edge, within, a, 0)
        alone[i], count[i] = p[edges[::-1]], len(edges)
        logp[i] += w[edges].sum()
    out_start = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), dtype=np.int32)
    for k, (who, what) in enumerate(steps):
        ids[out_start[who] + count[who] - 1 - k] = what
    for i, what in alone.items():
        ids[out_start[i] : out_start[i] + len(what)] = what
    row_start = np.r_[out_start, len(ids)][row_first]
    return ids, row_start, np.bincount(row, logp, minlength=rows)


def sample_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """(id, pieces, log_prob), one row per input row: a segmentation drawn from the piece lattice of the whole text.

    Each path has probability in proportion to the product of its pieces' weights; ``alpha`` sharpens them.  The
    draw depends on seed, id and text only, so any partitioning and any retry gives the same pieces.  Null and
    empty texts are the leading blank alone.  Characters without a piece fall back to bytes.  Repeated rows get
    equal pieces; other columns are not read.
    """

    def run(batches):
        model = pieces(model_path, alpha)
        for batch in batches:
            keys = tb.mix(batch.column(1).to_numpy().view(np.uint64) + np.uint64(seed % 2**64))
            for r0, r1, data, offs in tb.slices(batch.column(2), 1 << 20):
                ids, at, logp = sample_slice(model, data, offs, keys[r0:r1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(logp)], ["id", "pieces", "log_prob"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("id").schema.add("pieces", _ints()).add("log_prob", "double")
    return rows.mapInArrow(tb.frugal(run), schema)


def _ints():
    from pyspark.sql.types import ArrayType, IntegerType

    return ArrayType(IntegerType())


def decode_pieces(rows: DataFrame, model_path: str, pieces_col: str = "pieces", out_col: str = "text") -> DataFrame:
    """``rows`` with the pieces column replaced by the text it stands for; null and empty piece lists give an empty text."""
    own = tb.others(rows.columns, (pieces_col, out_col))

    def run(batches):
        model = pieces(model_path, 1.0)
        for batch in batches:
            lists = batch.column(len(own))
            lists = lists.fill_null([]) if lists.null_count else lists
            offs = lists.offsets.to_numpy()
            texts = []
            for r0 in range(0, batch.num_rows, 500):
                part = offs[r0 : r0 + 501].astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)[part[0] : part[-1]]
                n = model.length[ids]
                ends = np.r_[0, np.cumsum(n)]
                raw = model.bytes[np.repeat(model.start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
                cut = ends[part - part[0]].tolist()
                # the blank that was put in front goes again
                texts += [raw[a + (raw[a : min(a + 1, b)] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(texts, pa.string())], [*own, out_col])

    return rows.select(*own, pieces_col).mapInArrow(tb.frugal(run), rows.select(*own).schema.add(out_col, "string"))
