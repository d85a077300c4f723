"""Language ID by error-correcting output codes over byte trigrams."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb

#: Hash places of a trigram, and the weight that unseen trigrams get.
FEATURES, PRIOR = 1 << 15, 0.5
#: Languages that a model learns at most; its counts and weights are languages x FEATURES, on the driver and broadcast.
MOST_LANGUAGES = 512
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each trigram of letters and single blanks; every row counts as having blanks around it."""
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(offs))
    t = np.full(len(data) + rows + 1, 32, dtype=np.uint8)
    t[np.arange(len(data)) + row + 1] = _FOLD[data]
    capital = np.flatnonzero((t[:-1] == 0xC3) & (t[1:] >= 0x80) & (t[1:] <= 0x9E) & (t[1:] != 0x97)) + 1
    t[capital] += 0x20
    a, b, c = t[:-2], t[1:-1], t[2:]
    starts = offs[:-1] + np.arange(rows)  # where a row's leading blank stands
    apart = (b == 32) & ((a == 32) | (c == 32))
    apart[starts[1:] - 1] = True  # the end of one row and the start of the next
    keep = np.flatnonzero(~apart)
    h = (a[keep].astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b[keep].astype(np.uint32) * np.uint32(0x85EBCA6B)) ^ (c[keep].astype(np.uint32) * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64), np.searchsorted(starts, keep, side="right") - 1


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits of the languages for up to five, else 12 random bits per doubling."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        bits = [b for b in itertools.product((-1, 1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, dtype=np.int8).T
    rng = np.random.Generator(np.random.PCG64(n))
    size = int(12 * np.ceil(np.log2(n)))
    return max((rng.choice(np.array([-1, 1], dtype=np.int8), (n, size)) for _ in range(20)), key=lambda m: min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i)))


class Model:
    """Binary trigram classifiers, one for each bit, with the weight of each bit in decoding."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        share = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * counts.shape[1]) if len(langs) else counts
        weights, spread = [], []
        for bit in self.code.T:
            on, off = share[bit == 1], share[bit == -1]
            w = np.log(on.mean(axis=0)) - np.log(off.mean(axis=0)) if len(on) and len(off) else np.zeros(FEATURES)
            weights.append(w)
            mean = share @ w  # expected evidence per trigram in each language
            right = (mean * bit).min() if len(mean) else 0.0
            spread.append(max(1e-3, float(right)))
        self.weights = np.array(weights, dtype=np.float32).T.copy() if weights else np.zeros((FEATURES, 1), np.float32)
        #: Evidence per trigram at which a bit counts as sure; a bit weighs as much as it keeps its languages apart.
        self.scale = np.array(spread, dtype=np.float64)
        self.bit_weight = self.scale / self.scale.sum() if len(spread) else np.ones(1)

    def decode(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword by weighted hinge loss and its margin over the next, 0 (ambiguous) to 1."""
        margin = np.clip(evidence / self.scale, -4, 4)
        loss = np.maximum(0.0, 1.0 - margin[:, None, :] * self.code[None, :, :]) @ self.bit_weight
        best = loss.argmin(axis=1)
        if len(self.langs) < 2:
            return best, np.ones(len(best))
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1] + two[:, 0], 1e-12), 0.0, 1.0)


def train(docs: DataFrame, text_col: str, lang_col: str, training: Column) -> Model:
    """Trigram counts of all rows where ``training`` holds and the language is known, summed by Spark.

    What reaches the driver is one count for each language and hash place, however many rows there are; more than
    ``MOST_LANGUAGES`` languages are an error, found before anything is collected.
    """

    def run(batches):
        langs: dict[str, int] = {}
        counts = np.zeros((0, FEATURES), dtype=np.int64)
        for batch in batches:
            names = batch.column(1).to_pylist()
            for name in names:
                langs.setdefault(name, len(langs))
            if len(langs) > len(counts):
                counts = np.vstack([counts, np.zeros((len(langs) - len(counts), FEATURES), dtype=np.int64)])
            number = np.array([langs[x] for x in names], dtype=np.int64)
            for r0, r1, data, offs in tb.slices(batch.column(0)):
                h, row = trigrams(data, offs)
                counts += np.bincount(number[r0:r1][row] * FEATURES + h, minlength=counts.size).reshape(counts.shape)
        for name, k in langs.items():
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[k][at])], ["lang", "feature", "c"])

    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    table = rows.mapInArrow(tb.frugal(run), "lang string, feature int, c long").groupBy("lang", "feature").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), FEATURES))
    index = {x: i for i, x in enumerate(langs)}
    counts[[index[x] for x in table.column("lang").to_pylist()], table.column("feature").to_numpy()] = table.column("c").to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; both see the text only.

    A null text, one without a letter, or a model that has learned nothing gives ``und`` and 0.  A score near 0
    flags an ambiguous text.  Columns of these names in the input are replaced.
    """
    spark = docs.sparkSession
    own, helper = tb.others(docs.columns, (lang_out, score_out)), tb.unused("__text", docs.columns)
    shared = spark.sparkContext.broadcast(model)  # languages x FEATURES, a fixed size
    schema = docs.select(*own).schema.add(lang_out, "string").add(score_out, "double")

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            text = batch.column(batch.schema.names.index(helper))
            pred, score = [], []
            for r0, r1, data, offs in tb.slices(text):
                h, row = trigrams(data, offs)
                count = np.bincount(row, minlength=r1 - r0)
                total = np.zeros((r1 - r0, m.weights.shape[1]))
                some = np.flatnonzero(count)
                if len(some) and m.langs:
                    total[some] = np.add.reduceat(m.weights[h], (np.cumsum(count) - count)[some], axis=0, dtype=np.float64)
                best, sure = m.decode(total / np.maximum(count, 1)[:, None]) if m.langs else (np.zeros(r1 - r0, int), np.zeros(r1 - r0))
                none = count == 0
                wide = np.bincount(np.searchsorted(offs, np.flatnonzero(data >= 0x80), side="right") - 1, minlength=r1 - r0) > 0
                plain = np.bincount(np.searchsorted(offs, np.flatnonzero((data < 0x80) & (_FOLD[data] != 32)), side="right") - 1, minlength=r1 - r0) > 0
                for i in np.flatnonzero(wide & ~plain).tolist():  # only other scripts and signs: ask what they are
                    none[i] |= not any(c.isalpha() for c in text[r0 + i].as_py())
                none |= ~wide & ~plain
                if not m.langs:
                    none[:] = True
                best = np.where(none, len(m.langs), best)
                pred += names[best].tolist()
                score += np.where(none, 0.0, sure).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i, c in enumerate(batch.schema.names) if c != helper] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*own, lang_out, score_out])

    return docs.select(*own, F.col(text_col).cast("string").alias(helper)).mapInArrow(tb.frugal(run), schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score), one row per input row; learned from the rows outside fold ``held``.

    Rows without id are in no fold: they are not learned from and not held out.  Repeated rows are learned from as
    often as they stand there.  An empty table gives an empty result.
    """
    model = train(docs, text_col, lang_col, ~(fold(id_col, parts) == held))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col, parts) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model, "text").select("id", "held_out", "lang_pred", "score")
