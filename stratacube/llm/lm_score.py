"""Corpus language model as a weighted backoff automaton, and the scores of texts under it.

Counts of words, pairs and triples are exact for every token of the corpus, and each of them is an arc.  Documents are
dealt into blocks of bounded size.  A block sends each of its distinct n-grams once, as packed sorted hashes dealt over
ranges of the hash; the range adds the counts of all blocks up and sends them back in the order in which they came.  Of
a corpus of very many blocks, groups of them are added up first, range by range, and each group is then a sender like a
block, so that a block never sends more than a fixed number of packets.  A second exchange of the same kind adds up what
the arcs of a word or pair take of its mass.  With these the block builds the part of the automaton that its own texts can reach, so the whole is never held in one place, and reads its
texts with it: from left to right, each text carrying its state from token to token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb
from stratacube.sources.workspace import Workspace

#: Text bytes of one block.
BLOCK_BYTES = 12 << 20
#: log2 of the most senders of one exchange, and of the most ranges that one of them sends to.
FAN_BITS = 12
#: Count taken from each arc for backing off, and what is added to each unigram count.
DISCOUNT, ADDED = 0.75, 0.1
END = np.uint64(0x5DEECE66D1CE4E5B)
#: Tokens of a text that are read in one go; a text is read in several such parts at once, each begun two tokens early.
PART = 512
_PREV = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row and one END after them; where each row's tokens begin (n + 1)."""
    data = tb.LOWER[data]
    start, end, row = tb.words(data, offs)
    h = tb.span_hash(tb.prefix_hash(data), start, end)
    rows = len(offs) - 1
    out = np.full(len(h) + rows, END, dtype=np.uint64)
    out[np.arange(len(h)) + row] = h
    return out, np.r_[0, np.cumsum(np.bincount(row, minlength=rows) + 1)]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted keys, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys in which equal ones are neighbours and that is the keys' own, and the keys in it."""
    bits = np.uint64(max(1, len(key).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    by = (np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)  # far faster than argsort
    s = key[by]
    if (s[1:] < s[:-1]).any():  # keys that differ in their lowest bits only
        by = np.argsort(key, kind="stable")
        s = key[by]
    return by, s


def _pack(a: np.ndarray) -> bytes:
    """Values of eight bytes, laid out by place of the byte and compressed."""
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpack(b: bytes, dtype=np.int64) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.Codec("zstd").decompress(b[8:], n * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view(dtype)


def _pack_keys(k: np.ndarray) -> bytes:
    return _pack(np.diff(k, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _ranges(keys: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Where each of n ranges of the hash begins in sorted keys (n + 1), which have their first ``skip`` bits in common."""
    rest = (keys << np.uint64(skip)) >> np.uint64(32)
    return np.searchsorted((rest * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def _packets(sender: int, n: int, order: int, keys: np.ndarray, values: np.ndarray, lane: int = 0, skip: int = 0) -> list[tuple]:
    """Rows of SENT: the sorted keys and their values, cut into n ranges that are numbered from ``lane``."""
    cut = _ranges(keys, n, skip).tolist()
    return [(sender, order, lane + r, _pack_keys(keys[a:b]), _pack(values[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


def _with_next(key: np.ndarray, h: np.ndarray, on: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams ``key[on]``, which end at ``place[on]``, with the token after each; in parts that stay in the cache."""
    out = np.empty(len(on), np.uint64)
    for a in range(0, len(on), 1 << 15):
        part = on[a : a + (1 << 15)]
        out[a : a + len(part)] = tb.mix(key[part] * _PREV + h[place[part] + 1])
    return out


class Block:
    """Tokens of a block's rows, and for orders 1 to 3 (index 0 to 2) its distinct n-grams by hash.

    ``at`` is the word, and the pair, that ends at each token (-1: nothing before it in the row), ``keys`` the sorted
    hashes, ``count`` the occurrences in training rows, ``context`` and ``tail`` the n-grams without its last and its
    first word.  Only what is in ``want`` is made.
    """

    def __init__(self, text: pa.ChunkedArray, held: np.ndarray, want: tuple[str, ...] = ("count", "at", "context", "tail")):
        text = text.combine_chunks()
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        parts, lengths = [], []
        for _, _, data, offs in tb.slices(text):
            h, bounds = tokens(data, offs)
            parts.append(h)
            lengths.append(np.diff(bounds))
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.bounds = np.r_[0, np.cumsum(lengths)]
        self.h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        fresh = np.repeat(held.astype(bool), lengths)
        key, place = self.h, np.arange(len(self.h))
        follows = np.ones(len(self.h), dtype=bool)  # the token has one before it in its row
        follows[self.bounds[:-1]] = False
        self.at, self.keys, self.count, self.context, self.tail = [], [], [], [None], [None]
        for order in range(3):
            if order:  # the n-grams of one word less, each with the word after it in the same row
                on = np.flatnonzero(np.r_[follows[1:], False][place])
                key, place = _with_next(key, self.h, on, place), place[on] + 1
            by, s = _sorted(key)
            new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            self.keys.append(s[start])
            if "count" in want:
                plain = np.diff(np.r_[start, len(s)])
                known = np.add.reduceat((~fresh)[place[by]].astype(np.int64), start) if fresh.any() and len(start) else plain
                self.count.append(known)
            if order and ("context" in want or "tail" in want):
                one = place[by[start]]
                self.context.append(self.at[order - 1][one - 1] if "context" in want else None)
                self.tail.append(self.at[order - 1][one] if "tail" in want else None)
            if "at" in want and order < 2:
                at = np.full(len(self.h), -1, dtype=np.int32)
                at[place[by]] = np.cumsum(new, dtype=np.int32) - 1
                self.at.append(at)


def _packed(rows: DataFrame, n_blocks: int) -> DataFrame:
    """(block, rows): the rows of each block of a batch as one compressed Arrow stream."""

    def run(batches):
        for batch in batches:
            block = batch.column(0).to_numpy()
            by = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.r_[True, block[by][1:] != block[by][:-1]]) if len(by) else np.zeros(0, np.int64)
            own = pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])
            out = []
            for part in np.split(by, cut[1:]) if len(by) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(own.take(pa.array(part)))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[by[cut]], pa.int32()), pa.array(out, pa.binary())], ["block", "rows"])

    blocked = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int").alias("block"), *rows.columns)
    return blocked.mapInArrow(tb.frugal(run), "block int, rows binary")


def _rows(left: pa.Table) -> pa.Table:
    """The rows of a block, in an order that does not depend on the order in which its parts came."""
    parts = sorted(left.column("rows").to_pylist())
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts])


SENT = "block int, n int, part long, keys binary, v binary"
BACK = "block int, n int, part long, v binary, own long, mass long"
_SENT = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("v", pa.binary())])
_BACK = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("part", pa.int64()), ("v", pa.binary()), ("own", pa.int64()), ("mass", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Sums:
    """The packets of one range: its distinct sorted ``keys`` with the ``total`` of their values and whether several senders have them (``shared``).

    ``at`` is the key of each place in the packets and ``first`` whether its sender is the first with a value for it.
    """

    def __init__(self, sent: pa.Table):
        self.rows = sorted(zip(*(sent.column(c).to_pylist() for c in ("block", "n", "part", "keys", "v")), strict=True), key=lambda r: r[0])
        self.order, self.part = self.rows[0][1:3]
        self.kind = np.int64 if self.order > 0 else np.float64
        keys, values = [_unpack_keys(r[3]) for r in self.rows], [_unpack(r[4], self.kind) for r in self.rows]
        self.cut = np.cumsum([len(k) for k in keys])[:-1]
        k, v = np.concatenate(keys), np.concatenate(values)
        by = np.argsort(k, kind="stable")
        s = k[by]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        times = np.diff(np.r_[start, len(s)])
        self.keys, self.shared = s[start], times > 1
        self.at = np.empty(len(k), np.int64)
        self.at[by] = np.repeat(np.arange(len(start)), times)
        self.total = np.add.reduceat(v[by], start)
        some = by[v[by] > 0]
        self.first = np.zeros(len(k), dtype=bool)
        self.first[some[np.r_[True, self.at[some][1:] != self.at[some][:-1]]] if len(some) else some] = True

    def counts(self) -> pa.Table:
        """To every sender, for its keys: the count, whether others have the key, whether it is the first with a value."""
        parts = (np.split(x, self.cut) for x in (self.total[self.at], self.shared[self.at], self.first))
        return _table([(*r[:3], _pack(t * 4 + w * 2 + o), int(o.sum()), int(t[o].sum())) for r, t, w, o in zip(self.rows, *parts, strict=True)], _BACK)

    def masses(self) -> pa.Table:
        return _table([(*r[:3], _pack(t), 0, 0) for r, t in zip(self.rows, np.split(self.total[self.at], self.cut), strict=True)], _BACK)

    def answered(self, back: pa.Table) -> pa.Table:
        """What came back for the group of these senders, as an answer to each of them."""
        given = _answers(back, self.order, self.kind)
        if self.order < 0:
            self.total = given
            return self.masses()
        self.total = given >> 2
        self.shared |= (given & 2) > 0
        self.first &= ((given & 1) > 0)[self.at]
        return self.counts()


def _count(sent: pa.Table) -> pa.Table:
    return Sums(sent).counts()


def _masses(sent: pa.Table) -> pa.Table:
    return Sums(sent).masses()


def _n_ranges(senders: int, fan_bits: int) -> int:
    """Ranges of the hash that each of so many senders sends to."""
    return senders // 2 + 1 if senders <= 1 << fan_bits else 1 << fan_bits


def exchange(sent: DataFrame, senders: int, merge, ws: Workspace, name: str, fan_bits: int = FAN_BITS, skip: int = 0) -> DataFrame:
    """Rows of BACK: what ``merge`` makes of all packets (rows of SENT) of a range, for every sender.

    More than 2^fan_bits senders are taken together in groups of so many; a task adds up one range of one group, and the
    groups are the senders of an exchange within that range.  Each sender has at most 2^fan_bits packets an order, so
    their number grows with the number of blocks, times one more for each level.
    """
    if senders <= 1 << fan_bits:
        return ws.save(sent.groupBy("n", "part").applyInArrow(merge, BACK), name)
    groups = (senders - 1 >> fan_bits) + 1
    ranges, skip = _n_ranges(groups, fan_bits), skip + fan_bits

    def combine(rows: pa.Table) -> pa.Table:
        s = Sums(rows)
        return _table(_packets(s.rows[0][0] >> fan_bits, ranges, s.order, s.keys, s.total, s.part << fan_bits, skip), _SENT)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return Sums(left).answered(right) if len(left) else _table([], _BACK)

    sent = ws.save(sent, f"{name}_sent_{skip}").withColumn("group", F.shiftright("block", fan_bits))
    above = exchange(sent.groupBy("group", "n", "part").applyInArrow(combine, SENT), groups, merge, ws, f"{name}_{skip}", fan_bits, skip)
    above = above.withColumn("lane", F.shiftright("part", fan_bits))
    back = sent.groupBy("group", "n", "part").cogroup(above.groupBy("block", "n", "lane")).applyInArrow(answer, BACK)
    return ws.save(back, name)


def _answers(back: pa.Table, n: int, kind=np.int64) -> np.ndarray:
    """What came back for order n, in the order of the keys that were sent."""
    rows = sorted((p, v) for m, p, v in zip(*(back.column(c).to_pylist() for c in ("n", "part", "v")), strict=True) if m == n)
    return np.concatenate([_unpack(v, kind) for _, v in rows]) if rows else np.zeros(0, kind)


class Counts:
    """Corpus counts of a block's n-grams, which of them training rows have, and what their arcs take."""

    def __init__(self, own: Block, back: pa.Table):
        both = [_answers(back, n) for n in (1, 2, 3)]
        self.count, first, shared = [b >> 2 for b in both], [(b & 1).astype(bool) for b in both], [(b & 2).astype(bool) for b in both]
        self.kept = [c > 0 for c in self.count]
        #: Sums of this block's share of the arcs of each context, and the contexts that other blocks have too.
        self.taken, self.wider = [], shared[:2]
        for n in (1, 2):
            arc = self.kept[n] & first[n]
            self.taken.append(np.bincount(own.context[n][arc], self.count[n][arc] - DISCOUNT, minlength=len(own.keys[n - 1])).astype(np.float64))  # an empty one is of integers

    def complete(self, back: pa.Table) -> None:
        for n in (0, 1):
            self.taken[n][self.wider[n]] = _answers(back, -1 - n, np.float64)


class Automaton:
    """The part of the weighted backoff automaton that the texts of a block can reach.

    State 0 is empty, then comes one for each known word of the block and one for each known pair.  An arc reads a word:
    it has its discounted share of its state's count and, of the mass that all arcs of the state leave, what the state
    behind the failure arc gives the word; it leads to the state of the last two words, or of the last.  Where a state
    has no arc for a word its failure arc is taken, which costs ``backoff`` and reads nothing; the empty state reads
    every word, known or not.  The arcs are ``key`` (state and word, sorted), ``to`` and ``logp``.
    """

    def __init__(self, own: Block, c: Counts, norm: float):
        word, pair, triple = c.kept
        left = [1 - c.taken[n] / np.maximum(c.count[n], 1) for n in (0, 1)]
        self.read = np.log10((c.count[0] + ADDED) / norm)
        n = int(word.sum())
        self.word_state, self.pair_state = np.where(word, np.cumsum(word, dtype=np.int32), 0), n + np.cumsum(pair, dtype=np.int32)
        last = own.tail[1]  # of a pair
        self.fail = np.r_[np.zeros(n + 1, np.int32), self.word_state[last[pair]]]
        self.backoff = np.log10(np.maximum(np.r_[1.0, left[0][word], left[1][pair]], 1e-12))
        self.bits = np.int64(max(1, len(word).bit_length()))
        arcs = int(pair.sum()), int(triple.sum())
        key, to, logp = np.empty(sum(arcs), np.int64), np.empty(sum(arcs), np.int32), np.empty(sum(arcs))
        from_, by, mine = own.context[1][pair], last[pair], slice(arcs[0])
        key[mine] = (self.word_state[from_].astype(np.int64) << self.bits) | by
        to[mine] = self.pair_state[pair]
        logp[mine] = np.log10((c.count[1][pair] - DISCOUNT) / c.count[0][from_] + left[0][from_] * 10 ** self.read[by])
        two = np.zeros(len(pair))
        two[pair] = logp[mine]
        from_, by, mine = own.context[2][triple], own.tail[2][triple], slice(arcs[0], None)
        key[mine] = (self.pair_state[from_].astype(np.int64) << self.bits) | last[by]
        to[mine] = self.pair_state[by]
        logp[mine] = np.log10((c.count[2][triple] - DISCOUNT) / c.count[1][from_] + left[1][from_] * 10 ** two[by])
        del two, from_, by, left
        order = np.argsort(key)
        self.key, self.to, self.logp = key[order], to[order], logp[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each state gives its word, and the states after it."""
        here, gain, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        bottom = np.ones(len(state), dtype=bool)
        open_ = np.flatnonzero(here)
        while len(open_):
            wanted = (here[open_] << self.bits) | word[open_]
            by = np.argsort(wanted)  # searches in order stay in the cache
            open_, arc = open_[by], _find(self.key, wanted[by])
            hit = arc >= 0
            read, arc, open_ = open_[hit], arc[hit], open_[~hit]
            gain[read] += self.logp[arc]
            after[read] = self.to[arc]
            bottom[read] = False
            gain[open_] += self.backoff[here[open_]]
            here[open_] = self.fail[here[open_]]
            open_ = open_[here[open_] > 0]
        gain[bottom] += self.read[word[bottom]]
        after[bottom] = self.word_state[word[bottom]]
        return gain, after

    def traverse(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each token of the rows, read from left to right from the empty state.

        All rows are read at once.  Long rows are read in parts: the state after two tokens does not depend on what was
        before them, so a part that begins two tokens early carries the right state into its own tokens.
        """
        size = np.diff(bounds)
        parts = -(-size // PART)
        row = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = bounds[row] + nth * PART
        stop = np.minimum(start + PART, bounds[row + 1])
        begin = np.maximum(start - 2, bounds[row])
        by = np.argsort(begin - stop, kind="stable")  # the longest first, so that those still reading come first
        begin, start, stop = begin[by], start[by], stop[by]
        length = stop - begin
        out, state = np.zeros(len(words)), np.zeros(len(begin), np.int64)
        reading = len(length)
        for t in range(int(length.max(initial=0))):
            while reading and length[reading - 1] <= t:
                reading -= 1
            at = begin[:reading] + t
            gain, state[:reading] = self.step(state[:reading], words[at])
            own = at >= start[:reading]
            out[at[own]] = gain[own]
        return out


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Learns from rows where ``held_out`` is not true; scores all.  Tokens are the lower-cased (A-Z) words between
    blanks and one end token; null and empty texts are the end token alone.  base_score is the add-0.1 unigram
    log10 probability, score that of the automaton of orders one to three.  Both are probabilities over the seen
    tokens and one class of unseen ones.  Without training rows every token is unseen.  Repeated rows count and
    are scored each; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(size // block_bytes) + 1
    parts = _n_ranges(n_blocks, fan_bits)
    texts = _packed(rows, n_blocks)

    def open_(left: pa.Table, *want: str) -> tuple[Block, pa.Table]:
        own = _rows(left)
        return Block(own.column("text"), own.column("held_out").to_numpy(), want), own

    def gather(left: pa.Table) -> pa.Table:
        own, block = open_(left, "count")[0], left.column("block")[0].as_py()
        return _table([r for n in range(3) for r in _packets(block, parts, n + 1, own.keys[n], own.count[n])], _SENT)

    sent = texts.groupBy("block").applyInArrow(gather, SENT)
    counts = exchange(sent, n_blocks, _count, ws, "counts", fan_bits)
    total, distinct = counts.where("n = 1").agg(F.coalesce(F.sum("mass"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], _SENT)
        own, block = open_(left, "at", "context")[0], left.column("block")[0].as_py()
        c = Counts(own, right)
        return _table([r for n in (0, 1) for r in _packets(block, parts, -1 - n, own.keys[n][c.wider[n]], c.taken[n][c.wider[n]])], _SENT)

    shares = texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(share, SENT)
    masses = exchange(shares, n_blocks, _masses, ws, "masses", fan_bits)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own, given = open_(left, "at", "context", "tail")
        given = given.select(["id", "held_out"])
        c = Counts(own, right)
        own.h = own.keys = None  # a task's memory is that of its block's arrays; what has been used goes at once
        c.complete(right)
        words, bounds = own.at[0], own.bounds
        known = (c.count[0] > 0)[words]
        model = Automaton(own, c, total + ADDED * (distinct + 1))
        del own, c
        at = bounds[:-1]
        known, base, full = (np.add.reduceat(x, at) for x in (known.astype(np.int64), model.read[words], model.traverse(words, bounds)))
        return pa.table([given.column("id"), given.column("held_out"), pa.array(np.diff(bounds)), pa.array(known), pa.array(np.full(len(at), total, np.int64)), pa.array(base), pa.array(full)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = rows.select("id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return texts.groupBy("block").cogroup(counts.unionByName(masses).groupBy("block")).applyInArrow(score, schema)
