"""Payload columns in a content-defined chunk store: gear-hash cuts, digests deduplicated by joins, verified reassembly.

A document's container row holds its own chunks; chunks that occur more than once are held by digest in a store
of their own, each once.  Only digests are exchanged to find out which; the answer comes back to the documents as
a Bloom filter of bounded size, so payloads of unshared chunks never move.  A chunk that the filter takes for shared
by mistake is held by digest too, which costs a little room and changes no result; so does a filter that is full.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb
from stratacube.sources.workspace import Workspace

UNIT, PAD = 576, b"\xff"
#: Least and greatest bytes of a chunk, and how many leading zero bits of the rolling hash make a cut.
LEAST, GREATEST, CUT_BITS = 512, 16384, 11
LEVEL = 6
#: Bits of the filter for each shared chunk, and at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 26
GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 2**32, size=256, dtype=np.uint64).astype(np.uint32)
_CHUNK = "array<struct<digest:binary,size:int,stored:binary>>"


def payload(raw: bytes) -> bytes:
    """The bytes filled up with 255 to a positive multiple of UNIT."""
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload; a cut depends on the 32 bytes before it and on the chunk's start only."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    h = GEAR[data]
    step = 1
    while step < 32:  # h[i] = sum of GEAR[data[i - j]] << j for j < 32
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, base, k = [], 0, 0
    for p in payloads:
        ends, start, stop = [], base, base + len(p)
        while k < len(marks) and marks[k] <= base:
            k += 1
        while start < stop:
            while k < len(marks) and marks[k] < start + LEAST:
                k += 1
            end = min(start + GREATEST, stop, marks[k] if k < len(marks) else stop)
            ends.append(end - base)
            start = end
        out.append(ends)
        base = stop
    return out


def chunks(payloads: list[bytes]):
    for p, ends in zip(payloads, cuts(payloads), strict=True):
        yield [p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _groups(raws: list[bytes], limit: int = 4 << 20):
    group, size = [], 0
    for i, r in enumerate(raws):
        group.append(i)
        size += len(r)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def feature(body: bytes) -> str:
    """Mean, deviation, entropy of the samples and share of steps across the middle, as fixed decimals."""
    x = np.frombuffer(body, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    mean = float(share @ np.arange(256))
    spread = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    p = share[share > 0]
    above = x > 127
    return f"mean={mean:.3f};sd={spread:.3f};entropy={float(-(p @ np.log2(p))) + 0.0:.4f};crossings={np.count_nonzero(above[1:] != above[:-1]) / len(x):.4f}"


def _places(digest: bytes, m: int) -> list[int]:
    return [int.from_bytes(digest[8 * k : 8 * k + 7], "big") % m for k in range(4)]


def _filter(shared: DataFrame) -> tuple[np.ndarray, int]:
    """(words, bits) of a Bloom filter of the digests, put together by Spark word by word."""
    m = 1024
    n = shared.count()
    while m < FILTER_BITS * n and m < FILTER_MOST:
        m *= 2
    place = [F.expr(f"cast(conv(hex(substring(digest, {8 * k + 1}, 7)), 16, 10) as bigint) % {m}") for k in range(4)]
    bits = shared.select(F.explode(F.array(*place)).alias("at")).select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    table = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(m // 64, dtype=np.int64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return words, m


def store_payloads(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write every text's payload; returns (containers, chunks) as read back.

    A container: id, kh (hash of the text), n_bytes, parts (digest, size, stored bytes or null where held by digest).
    A chunk: digest, stored bytes, once for each digest.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def digests(batches):
        for batch in batches:
            raws = tb.to_utf8(batch.column(0))
            for group in _groups(raws):
                found = [hashlib.sha256(c).digest() for parts in chunks([payload(raws[i]) for i in group]) for c in parts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    shared = ws.save(texts.select("text").mapInArrow(tb.frugal(digests), "digest binary").groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest"), "shared")
    sieve = docs.sparkSession.sparkContext.broadcast(_filter(shared))

    def write(batches):
        z = zstandard.ZstdCompressor(level=LEVEL)
        words, m = sieve.value
        sent: set[bytes] = set()  # by this task
        for batch in batches:
            raws = tb.to_utf8(batch.column(2))
            for group in _groups(raws):
                out: list[list] = [[], [], [], [], [], [], []]
                for i, parts in zip(group, chunks([payload(raws[i]) for i in group]), strict=True):
                    made = []
                    for c in parts:
                        digest = hashlib.sha256(c).digest()
                        by_digest = all((int(words[x >> 6]) >> (x & 63)) & 1 for x in _places(digest, m))
                        stored = None if by_digest and digest in sent else z.compress(c)
                        if by_digest and stored is not None:
                            sent.add(digest)
                            for col, v in zip(out, (None, None, None, None, digest, stored, "chunk"), strict=True):
                                col.append(v)
                        made.append({"digest": digest, "size": len(c), "stored": None if by_digest else stored})
                    for col, v in zip(out, (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(raws[i]), made, None, None, "doc"), strict=True):
                        col.append(v)
                part = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("stored", pa.binary())])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(part), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["id", "kh", "n_bytes", "parts", "digest", "stored", "kind"])

    schema = f"id long, kh long, n_bytes long, parts {_CHUNK}, digest binary, stored binary, kind string"
    media = ws.save(texts.select("id", F.xxhash64("text").alias("kh"), "text").mapInArrow(tb.frugal(write), schema), "media", partition_by=["kind"])
    store = ws.save(media.where("kind = 'chunk'").groupBy("digest").agg(F.first("stored").alias("stored")), "chunks")
    ws.drop("media/kind=chunk")
    return media.where("kind = 'doc'").select("id", "kh", "n_bytes", "parts"), store


def read_payloads(docs: DataFrame, store: DataFrame, each, schema: str) -> DataFrame:
    """``each(id, n_bytes, payload, stored chunks) -> dict`` for every container, its payload put together and verified."""

    def assemble(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            refs = batch.column(3) if batch.num_columns > 3 else None
            rows = []
            for i in range(batch.num_rows):
                found = {r["digest"]: r["stored"] for r in refs[i].as_py() or ()} if refs is not None else {}
                stored, body = [], []
                for p in batch.column(2)[i].as_py():
                    piece = p["stored"] if p["stored"] is not None else found[p["digest"]]
                    plain = z.decompress(piece)
                    if len(plain) != p["size"] or hashlib.sha256(plain).digest() != p["digest"]:
                        raise ValueError(f"chunk {p['digest'].hex()} of document {batch.column(0)[i]} is damaged")
                    stored.append(piece)
                    body.append(plain)
                rows.append(each(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), b"".join(body), stored))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    linked = F.exists("parts", lambda p: p["stored"].isNull())
    plain = docs.where(~linked).select("id", "n_bytes", "parts").mapInArrow(tb.frugal(assemble), schema)
    split = docs.where(linked).select("id", "kh", "n_bytes", "parts")
    refs = split.select("id", "kh", F.explode(F.filter("parts", lambda p: p["stored"].isNull())).alias("p")).select("id", "kh", F.col("p.digest").alias("digest")).distinct().join(store, "digest")
    refs = refs.groupBy(F.col("id").alias("id2"), F.col("kh").alias("kh2")).agg(F.collect_list(F.struct("digest", "stored")).alias("refs"))
    whole = split.join(refs, F.col("id").eqNullSafe(F.col("id2")) & (F.col("kh") == F.col("kh2")), "left").select("id", "n_bytes", "parts", "refs").mapInArrow(tb.frugal(assemble), schema)
    return plain.unionByName(whole)


RESULT = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(doc_id, n_bytes, body: bytes, stored: list[bytes]) -> dict:
    form = b"".join(stored)
    return {
        "id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-32:]),
        "media_bytes": len(form), "media_sha256": hashlib.sha256(form).hexdigest(), "feature": feature(body),
    }


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT, one row per input row: each text stored as 8-bit samples in the chunk store, read back and described.

    The stored form of a document is the ordered sequence of its compressed chunks, wherever they are held; its
    size and digest depend on the text alone.  Null counts as empty; an empty text is one unit of padding.
    Repeated rows are stored once more but share their chunks.  Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "media")
    return read_payloads(*store_payloads(docs, ws, id_col, text_col), _digest, RESULT)
