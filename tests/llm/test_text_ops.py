"""Packing, extraction, languages, media, pieces, scores and licenses: brute force, round trips, odd cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratacube.llm import html_text, language_id, license_scan, lm_score, media, packing, piece_sampling
from tests.llm import corpus

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_packing_is_lossless_and_tight(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    end = "<|endoftext|>"
    extra = ["a  b \n\n c", "x  y z", f"it's we'll {end}  end ", "tab\tx\r\ny\x1cz \x85 q", f"x\n\n{end}\n\ny  {end} {end}{end}", end[:6], f"{end[6:]} a", f" {end}", f"{end}\n", "a\n\n"]
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    out = packing.best_fit_packing(docs, BPE, capacity=512).toPandas().sort_values(["id", "piece"])
    for r in docs.collect():
        ids = np.array([*tk.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        own = out[out.id == r.doc_id]
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 512).all() and own.length.max() <= 512
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 512
    assert out.sequence_id.nunique() <= 1.01 * math.ceil(out.length.sum() / 512) + 1


def test_pieces_of_text_are_encoded_as_the_whole():
    import random

    from tokenizers import Tokenizer

    tk, own, rng = Tokenizer.from_file(BPE), packing.Encoder(BPE), random.Random(1)
    bits = ["<|endoftext|>", " ", "\n", "a", "bc", " the", "<|end", "text|>", "é", "\t", ".", " x", "\u3000", "12"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    raw = [t.encode() for t in texts]
    ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    for i, t in enumerate(texts):
        assert tk.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist(), t


def test_best_fit_against_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 11, size=6)
        bins, offsets, fill = packing.best_fit(sizes, 10)
        assert fill.max() <= 10 and fill.sum() == sizes.sum()
        least = next(k for k in range(1, 7) for way in itertools.product(range(k), repeat=6) if max(sum(s for s, w in zip(sizes, way) if w == b) for b in range(k)) <= 10)
        assert len(fill) <= least + 1


def test_packing_tree_merges_underfull_bins(spark):
    items = spark.range(4000).selectExpr("id", "1 + id * 7919 % 300 AS length").repartition(64)
    from stratacube.sources.workspace import Workspace

    out = packing.pack(items, 512, Workspace(spark, "t")).toPandas()
    assert len(out) == 4000 and out.groupby("sequence_id").length.sum().max() <= 512
    assert out.sequence_id.nunique() <= 1.01 * math.ceil(out.length.sum() / 512)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    odd = packing.best_fit_packing(corpus.odd(spark), BPE).toPandas()
    assert odd[odd.id.isin([0, 1])].length.tolist() == [1, 1] and (odd.id == 5).sum() == 2 and odd[odd.id == 7].length.sum() > 30000
    assert packing.best_fit_packing(corpus.none(spark), BPE).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-banner">We use the cookies of a site to see what you do and that is all of it here.</div>
<article><header><h1>A  headline</h1></header><p>The first of the <b>paragraphs</b> is the one that has many words of the kind &amp; it is long.<br>same block</p><p>Short.</p><script>var x='<p>no</p>'</script>
<div class="ad">Buy it</div><!-- <p>hidden</p> --><p>And the last of the paragraphs has a <a href=y>link</a> in it, but it is not all of it, as it should be.</p><section id="comments"><p>I am the first of the readers to say that this is not what it was in the past.</p></section></article>
<aside>More</aside><form><label>mail</label></form><footer>&copy; all</footer></body></html>"""


def test_html_rules():
    assert html_text.main_text(PAGE) == "A headline\nThe first of the paragraphs is the one that has many words of the kind & it is long. same block\nShort.\nAnd the last of the paragraphs has a link in it, but it is not all of it, as it should be."
    plain = "<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>It was the best of the times and it was the worst of the times, as they say in the book of that name.</p><p>So it is.</p><p>And there was a king with a large jaw and a queen with a plain face on the throne of England then.</p><div>contact</div></body>"
    assert html_text.main_text(plain).split("\n")[:3] == ["It was the best of the times and it was the worst of the times, as they say in the book of that name.", "So it is.", "And there was a king with a large jaw and a queen with a plain face on the throne of England then."]
    named = "<body><div class=site-menu>Home</div><div id=main-content><h1>Title</h1><p>It was the best of the times and it was the worst of the times, as they say in the book.</p><figure><figcaption>A caption</figcaption></figure><p class='ad'>Buy<p>The end of it is the end of the book that they have all been reading for a long time.</p><ul><li class=comment><p>Me first</p></li></ul></div><div>contact us</div></body>"
    assert html_text.main_text(named).split("\n") == ["Title", "It was the best of the times and it was the worst of the times, as they say in the book.", "A caption", "The end of it is the end of the book that they have all been reading for a long time."]
    assert html_text.main_text("a < b <article><p>1 < 2 & 3</p><p title=\"x>y\">z") == "1 < 2 & 3\nz"


def test_html_rules_decide_inside_and_outside_articles():
    long = "It was the best of the times and it was the worst of the times, as they say in the book of that name."
    end = "And there was a king with a large jaw and a queen with a plain face on the throne of England then."
    assert html_text.main_text(f"<body><div>{long}</div><article><p>{end}</p></article><div>contact</div></body>") == f"{long}\n{end}"
    links = "<ul><li><a href=1>one more of the stories</a></li><li><a href=2>two</a></li></ul>"
    keys = " ".join(f"keyword{k}" for k in range(40))
    page = f"<body><article><p>{long}</p><p>Short.</p>{links}<p>{keys}</p>{links}</article></body>"
    assert html_text.main_text(page) == f"{long}\nShort."
    assert html_text.main_text(f"<article><p>{long}</p><p>{keys}</p></article>") == f"{long}\n{keys}"
    assert html_text.main_text(f"<main><p>{long}</p><article class='related'><p>{end}</p></article></main>") == long
    assert html_text.main_text(f"<main><article class='post tag-social'><p>{end}</p></article></main>") == end


def test_html_work_grows_with_the_page():
    import time

    end = "And there was a king with a large jaw and a queen with a plain face on the throne of England then."
    took = []
    for n in (20_000, 100_000):
        for page, lines in ((f"<body><article><p>{end}</p>" + "<p>ab cd</p>" * n, n + 1), (f"<body><article><p>{end}</p>" + "<div>" * 2000 + "</p></section>" * n, 1), ("<p class=ad><article>" * 50 + "<div>" * 2000 + "</p>" * n + f"<p>{end}</p>", 0)):
            began = time.process_time()
            text = html_text.main_text(page)
            took.append((time.process_time() - began) / n)
            assert len(text.split("\n")) == max(1, lines)
    assert max(took) < 2e-4


def test_second_pass_is_that_of_a_plain_search():
    import random

    rng = random.Random(4)
    long = "It was the best of the times and it was the worst of the times, as they say in the book of that name."
    for _ in range(300):
        found = [(rng.choice((long, "short", "x" * 90, " ".join(["word"] * 60))), rng.choice((0.0, 0.0, 0.9)), rng.random() < 0.2, rng.randint(0, 2)) for _ in range(rng.randint(1, 25))]
        got = html_text.classify(found)
        decided = [None if not o and link <= 0.5 and (len(t) < html_text.SHORT or t.startswith("xx") or (t.startswith("word") and a)) else (not o and link <= 0.5 and t == long) for t, link, o, a in found]
        some = any(a and not o for _, _, o, a in found)
        for i, (_, _, _, a) in enumerate(found):
            if decided[i] is not None:
                assert got[i] == decided[i]
                continue
            near = [[j for j in js if decided[j] is not None and found[j][3] == a and not (a and found[j][2])][:1] for js in (range(i - 1, -1, -1), range(i + 1, len(found)))]
            b, c = (x[0] if x else None for x in near)
            if b is None and c is None or some and not a and None in (b, c):
                want = bool(a)
            elif None in (b, c):
                want = decided[c if b is None else b]
            else:
                want = decided[b] if decided[b] == decided[c] else bool(a) if i - b == c - i else decided[b if i - b < c - i else c]
            assert got[i] == want


def test_html_articles_of_the_pages(spark):
    import html as escape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = "\n".join(s for s in (" ".join(escape.unescape(re.sub(r"<[^>]*>", " ", q)).split()) for q in re.split(r"<p>|</p>|</h1>", article)) if s)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, "x", 3), (2, "", None, 4), (3, "<article><p>ok</p></article>" * 2, "y", None), (None, "no tags", "z", 1)], "page_id long, html string, text string, n_chars int")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract_main_text(odd).orderBy(F.col("page_id").asc_nulls_last()).collect()][:3] == [(1, "", 0), (2, "", 0), (3, "ok\nok", 5)]
    assert html_text.extract_main_text(odd.limit(0)).count() == 0


def test_languages_held_out_and_odd(spark):
    docs = spark.read.parquet(DOCS)
    got = language_id.identify(docs).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    held = got.where("held_out")
    assert held.count() > 30 and held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    # nothing but the text is an input
    blind = language_id.predict(docs.select(F.lit(1).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")), language_id.train(docs, "text", "lang", F.lit(True)))
    assert blind.where("lang_pred = 'und'").count() == 0
    odd = {r.id: r for r in language_id.identify(corpus.odd(spark)).collect() if r.id is not None}
    assert [odd[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and odd[0].score == 0 and odd[8].lang_pred in ("en", "fr")
    assert language_id.identify(corpus.none(spark)).count() == 0
    assert language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    m = language_id.codewords(n)
    assert min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i)) >= max(1, m.shape[1] // 5)
    assert all(-1 in bit and 1 in bit for bit in m.T) or n > 5


def test_media_round_trip(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(corpus.odd(spark).select("doc_id", "text"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    got = media.media_columns(docs).collect()
    want = Counter()
    for (i, t), k in texts.items():
        raw = (t or "").encode()
        body = media.payload(raw)
        want[i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])] += k
    assert Counter((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert media.media_columns(corpus.none(spark)).count() == 0


def test_chunks_follow_content():
    body = media.payload(corpus.prose(4, 4000).encode())
    a, b = list(media.chunks([body, b"x" * 700 + body]))
    assert b"".join(a) == body and all(len(c) <= media.GREATEST for c in a) and all(len(c) >= media.LEAST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) // 2


def test_cuts_and_features_are_the_plain_ones():
    """Cuts against a hash rolled byte by byte over each payload by itself, features against plain sums."""
    rng = np.random.default_rng(8)
    bodies = [media.payload(b) for b in (b"", b"a", corpus.prose(3, 9000).encode(), bytes(rng.integers(0, 256, 90_000).astype(np.uint8)), b"z" * 50_000, corpus.prose(4, 700).encode() * 3)]
    for body, ends in zip(bodies, media.cuts(bodies), strict=True):
        want, start, h = [], 0, 0
        for i, byte in enumerate(body):
            h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
            size = i + 1 - start
            if (size >= media.LEAST and h >> (32 - media.CUT_BITS) == 0) or size == media.GREATEST or i + 1 == len(body):
                want.append(i + 1)
                start = i + 1
        assert ends == want
        n, c = len(body), Counter(body)
        mean = sum(b * k for b, k in c.items()) / n
        spread = math.sqrt(sum(k * (b - mean) ** 2 for b, k in c.items()) / n)
        entropy = -sum(k / n * math.log2(k / n) for k in c.values())
        steps = sum((a > 127) != (b > 127) for a, b in itertools.pairwise(body)) / n
        got = dict(x.split("=") for x in media.feature(body).split(";"))
        assert [float(got[k]) for k in ("mean", "sd", "entropy", "crossings")] == pytest.approx([mean, spread, entropy, steps], abs=6e-4)


def test_a_shared_chunk_is_stored_once(spark):
    """Documents that have a passage in common refer to its chunks by digest, and the store has each of them once."""
    from stratacube.sources.workspace import Workspace

    rng = np.random.default_rng(9)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 60_000))
    docs = spark.createDataFrame([(k, corpus.prose(20 + k, 200 + 50 * k) + passage) for k in range(4)], "doc_id long, text string")
    containers, store = media.store_payloads(docs, Workspace(spark, "t"))
    parts = [[bytes(p["digest"]) for p in r.parts if p["stored"] is None] for r in containers.collect()]
    digests = [bytes(r.digest) for r in store.collect()]
    plain = [{hashlib.sha256(c).digest() for c in next(iter(media.chunks([media.payload(r.text.encode())])))} for r in docs.collect()]
    common = set.intersection(*plain)
    assert len(common) > 10 and all(common <= set(p) for p in parts) and len(digests) == len(set(digests)) and common <= set(digests)


def test_damaged_store_is_noticed(spark):
    from stratacube.sources.workspace import Workspace

    docs = spark.createDataFrame([(1, corpus.prose(6, 900))], "doc_id long, text string")
    store, chunks = media.store_payloads(docs, Workspace(spark, "t"))
    broken = store.withColumn("parts", F.transform("parts", lambda p: F.struct(p["digest"].alias("digest"), (p["size"] + 1).alias("size"), p["stored"].alias("stored"))))
    with pytest.raises(Exception, match="damaged"):
        media.read_payloads(broken, chunks, media._digest, media.RESULT).collect()


def test_pieces_are_lossless_and_reproducible(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(corpus.odd(spark).select("doc_id", "text"))
    drawn = piece_sampling.sample_pieces(docs, PIECES, seed=3)
    back = piece_sampling.decode_pieces(drawn, PIECES)
    assert Counter((r.id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    again = {(r.id, tuple(r.pieces)) for r in piece_sampling.sample_pieces(docs.repartition(7), PIECES, seed=3).collect()}
    assert again == {(r.id, tuple(r.pieces)) for r in drawn.collect()}
    other = {(r.id, tuple(r.pieces)) for r in piece_sampling.sample_pieces(docs, PIECES, seed=4).collect()}
    assert len(again - other) > 100
    assert piece_sampling.sample_pieces(corpus.none(spark), PIECES).count() == 0


def test_piece_sampling_has_the_lattice_distribution():
    """Frequencies of the segmentations of one word against all of them, weighed one by one."""
    model = piece_sampling.Pieces(PIECES, 1.0)
    raw = [bytes(model.bytes[s : s + n]) for s, n in zip(model.start, model.length)]
    word = b" there"
    ids = {r: i for i, r in reversed(list(enumerate(raw))) if i > 258 and r}
    paths = {}

    def walk(at, path):
        if at == len(word):
            paths[tuple(path)] = math.exp(sum(model.weight[i] for i in path))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in ids:
                walk(end, [*path, ids[word[at:end]]])

    walk(0, [])
    n = 20000
    text = b"there" * 1
    data = np.frombuffer(text * n, dtype=np.uint8)
    out, at, logp = piece_sampling.sample_slice(model, data, np.arange(n + 1) * len(text), np.arange(n).astype(np.uint64))
    seen = Counter(tuple(out[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    total = sum(paths.values())
    assert set(seen) <= set(paths) and len(paths) > 5
    for path, w in paths.items():
        assert seen[path] / n == pytest.approx(w / total, abs=0.015)
    first = tuple(out[at[0] : at[1]].tolist())
    assert logp[0] == pytest.approx(math.log(paths[first] / total), abs=1e-6)


def test_long_texts_without_blanks():
    """Lossless, reproducible beside other texts, and the log probability is that of the pieces drawn, over all paths."""
    import time

    model = piece_sampling.Pieces(PIECES, 1.0)
    rng = np.random.default_rng(3)
    texts = ["=" * 9000, "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20000))), "ab" * 4000, bytes(rng.integers(97, 123, 30000, dtype=np.uint8)).decode(), "x", "=" * 200]
    raw = [t.encode() for t in texts]
    keys = np.arange(len(raw)).astype(np.uint64)
    began = time.process_time()
    ids, at, logp = piece_sampling.sample_slice(model, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], keys)
    assert time.process_time() - began < 2e-5 * sum(map(len, raw))
    for i, r in enumerate(raw):
        own = ids[at[i] : at[i + 1]]
        assert b"".join(bytes(model.bytes[model.start[k] : model.start[k] + model.length[k]]) for k in own) == b" " + r
        one, _, p = piece_sampling.sample_slice(model, np.frombuffer(r, np.uint8), np.array([0, len(r)]), keys[i : i + 1])
        assert one.tolist() == own.tolist() and p[0] == pytest.approx(logp[i], rel=1e-9)
    # all paths of the shortest deep one, summed by a plain forward pass
    word, known = b" " + raw[5], {}
    for i in range(model.length.size - 1, 258, -1):
        if model.length[i]:
            known[bytes(model.bytes[model.start[i] : model.start[i] + model.length[i]])] = model.weight[i]
    total = [0.0] + [-math.inf] * len(word)
    for e in range(1, len(word) + 1):
        for k in range(max(0, e - 64), e):
            if word[k:e] in known:
                total[e] = np.logaddexp(total[e], total[k] + known[word[k:e]])
    own = ids[at[5] : at[6]]
    assert logp[5] == pytest.approx(model.weight[own].sum() - total[-1], abs=1e-6)


def test_scores_base_and_model(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Unseen WORDS only xqzzy")], "doc_id long, text string"))
    held = language_id.fold("doc_id", 10) == 0
    got = {r.id: r for r in lm_score.lm_scores(docs, held, block_bytes=100_000).collect()}
    tok = {r.doc_id: [*re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().translate(corpus.LOW)), None] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tok}
    c = Counter(w for i, ws in tok.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    own = [r for i, r in got.items() if out[i] and i < 10**6]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert lm_score.lm_scores(corpus.none(spark), F.lit(False)).count() == 0
    assert lm_score.lm_scores(corpus.odd(spark), F.lit(False)).count() == 13
    assert lm_score.lm_scores(docs, F.lit(True)).where("n_known > 0 OR train_tokens > 0").count() == 0


def test_scores_use_every_pair_and_triple(spark):
    """Against a plain model of all n-grams, over several blocks; rare ones count however large the corpus."""
    texts = [corpus.prose(k % 7, 200, 60) for k in range(12)] + [corpus.prose(50 + k, 400, 3000) for k in range(8)] + ["rare pair here", "rare pair here too", "rare pair gone", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 3
    got = {r.id: r for r in lm_score.lm_scores(docs, held, block_bytes=4000).collect()}
    tok = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(corpus.LOW)), None] for t in texts]
    c = Counter(tuple(w[k : k + n]) for i, w in enumerate(tok) if i % 5 != 3 for n in (1, 2, 3) for k in range(len(w) - n + 1))
    kinds = Counter(g[:-1] for g in c)
    n, v = sum(x for g, x in c.items() if len(g) == 1), kinds[()]

    def p(g):
        if len(g) == 1:
            return (c[g] + 0.1) / (n + 0.1 * (v + 1))
        h = c[g[:-1]]
        return max(c[g] - 0.75, 0) / h + 0.75 * kinds[g[:-1]] / h * p(g[1:]) if h else p(g[1:])

    for i, w in enumerate(tok):
        assert got[i].score == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))), rel=1e-9)


def one_block(texts, held):
    """A block and the counts that come back to it when it is the only one."""
    own = lm_score.Block(pa.chunked_array([pa.array(texts)]), np.array(held))
    back = [lm_score._count(lm_score._table(lm_score._packets(0, 1, n + 1, own.keys[n], own.count[n]), lm_score._SENT)) for n in range(3)]
    return own, lm_score.Counts(own, pa.concat_tables(back))


def test_groups_of_blocks_are_added_up_first(spark, monkeypatch):
    """Any number of levels gives the same scores, and four times the blocks send about four times the packets."""
    texts = [corpus.prose(k % 9, 150, 80) for k in range(60)] + ["rare pair here", "rare pair here too", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 3
    saved = {}

    class Counted(lm_score.Workspace):
        def save(self, df, name, partition_by=None):
            out = super().save(df, name, partition_by)
            saved[name] = out.count()
            return out

    monkeypatch.setattr(lm_score, "Workspace", Counted)
    want = {r.id: r for r in lm_score.lm_scores(docs, held, block_bytes=2000).collect()}
    assert set(saved) == {"counts", "masses"}
    packets = []
    for size in (8000, 2000):
        saved.clear()
        got = {r.id: r for r in lm_score.lm_scores(docs, held, block_bytes=size, fan_bits=1).collect()}
        assert {"counts_1_2", "masses_1_2"} <= set(saved)  # three levels at the least
        packets.append(saved["counts"])
        assert set(got) == set(want)
        for i, r in want.items():
            assert got[i][:5] == r[:5] and got[i][5:] == pytest.approx(r[5:], rel=1e-12)
    assert packets[1] <= 5 * packets[0]


def test_sums_of_groups_keep_one_first_sender():
    """Counts of senders taken two at a time are those of all at once; each key with a value has one first sender."""
    rng = np.random.default_rng(4)
    sent = []
    for block in range(4):
        keys = np.unique(rng.integers(0, 2**63, 30).astype(np.uint64) // np.uint64(2**58) << np.uint64(58))
        sent.append((keys, rng.integers(0, 3, len(keys))))
    table = lambda rows: lm_score._table([x for r in rows for x in r], lm_score._SENT)
    flat = lm_score._count(table([lm_score._packets(b, 1, 1, *s) for b, s in enumerate(sent)])).to_pylist()
    pairs = [table([lm_score._packets(b, 1, 1, *sent[b]) for b in two]) for two in ((0, 1), (2, 3))]
    sums = [lm_score.Sums(p) for p in pairs]
    above = lm_score._count(table([lm_score._packets(g, 1, 1, s.keys, s.total) for g, s in enumerate(sums)]))
    found = [r for g, p in enumerate(pairs) for r in lm_score.Sums(p).answered(above.filter(pa.compute.equal(above["block"], g))).to_pylist()]
    assert [(r["block"], lm_score._unpack(r["v"]).tolist(), r["own"], r["mass"]) for r in found] == [(r["block"], lm_score._unpack(r["v"]).tolist(), r["own"], r["mass"]) for r in flat]
    assert sum(r["mass"] for r in flat) == sum(int(v.sum()) for _, v in sent)


def test_automaton_is_a_distribution():
    """From every state the weights of all words and of the unseen class add up to one."""
    rng = np.random.default_rng(0)
    own, c = one_block([" ".join(rng.choice(list("abcdef"), size=300, p=[0.4, 0.2, 0.15, 0.1, 0.1, 0.05])), "never"], [False, True])
    total = int(c.count[0].sum())
    m = lm_score.Automaton(own, c, total + 0.1 * (c.kept[0].sum() + 1))
    states = 1 + c.kept[0].sum() + c.kept[1].sum()
    assert len(m.fail) == len(m.backoff) == states and len(m.key) == c.kept[1].sum() + c.kept[2].sum() and c.kept[0].sum() == 7
    words = np.arange(len(own.keys[0]))  # the six, the end, and one that was never read
    for s in range(states):
        gain, after = m.step(np.full(len(words), s), words)
        assert (10**gain).sum() == pytest.approx(1.0, abs=1e-9) and (after[~c.kept[0]] == 0).all()
    # an arc leads where its word belongs: on from there by another arc or by failure arcs to the empty state
    assert (m.fail[m.to] > 0).all() and (m.fail[m.fail] == 0).all()


@pytest.mark.parametrize("part", [1, 2, 3, 7, 512])
def test_traversal_carries_its_state(monkeypatch, part):
    """Parts of any size give what one token after the other gives."""
    rng = np.random.default_rng(part)
    texts = [" ".join(rng.choice(list("abcdxyz"), size=n)) for n in (0, 1, 2, 3, 40, 130)]
    own, c = one_block(texts, [False, False, False, True, False, True])
    m = lm_score.Automaton(own, c, c.count[0].sum() + 0.1 * (c.kept[0].sum() + 1))
    want = []
    for a, b in itertools.pairwise(own.bounds.tolist()):
        state = np.zeros(1, np.int64)
        for w in own.at[0][a:b]:
            gain, state = m.step(state, np.array([w]))
            want.append(float(gain[0]))
    monkeypatch.setattr(lm_score, "PART", part)
    assert m.traverse(own.at[0], own.bounds).tolist() == pytest.approx(want, abs=1e-12)


def test_license_base_fuzzy_and_odd(spark):
    texts = ["Under the MIT license.", "x under  THE\tmit-License under the mit license", "Licensed under the Apache Licence, Version 2.0", "GNU Generel Public Licence v3", "a cc-by-nc b", "cc by ncs", None, "", "nothing here about it", "under the mit licensed", "cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(corpus.LOW))
        places = sorted((k, label) for p, label in license_scan.EXACT.items() for q in [[x.encode() for x in p.split()]] for k in range(len(w)) if w[k : k + len(q)] == q)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert got[2].labels == "apache-2" and got[2].n_base == 0 and 0.8 < got[2].score < 1 and got[3].labels == "gpl" and got[8].labels == ""
    assert license_scan.scan_licenses(corpus.odd(spark)).count() == 13
    assert license_scan.scan_licenses(corpus.none(spark)).count() == 0


def test_damaged_notice_directly_before_an_intact_one(spark):
    notice = max(license_scan.NOTICES, key=len)
    w = notice.split()
    damaged = " ".join([w[0][:-2] + w[0][-1], *w[1:]])
    docs = spark.createDataFrame([(1, f"{damaged} the {notice}"), (2, f"{notice} the {damaged}"), (3, f"{damaged} {notice} {damaged}")], "doc_id long, text string")
    got = {r.id: [x.errors for x in r.spans if x.label == license_scan.NOTICES[notice]] for r in license_scan.scan_licenses(docs).collect()}
    assert got == {1: [1, 0], 2: [0, 1], 3: [1, 0, 1]}


def test_piece_query_returns_the_pieces(spark, data):
    from stratacube.llm import queries

    got = queries.op7_piece_sampling(spark, data)
    assert got.where("pieces IS NULL OR size(pieces) <> n_pieces OR xxhash64(pieces) <> pieces_hash").count() == 0
    back = piece_sampling.decode_pieces(got.select("doc_id", "pieces"), PIECES)
    assert got.join(back, "doc_id").where("sha2(text, 256) <> text_sha256").count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_damaged_notices_against_all_places(spark):
    """Labels and least errors against the edit distance of every stretch of whole words."""
    import random

    rng = random.Random(11)
    short = [n for n in license_scan.NOTICES if len(n) < 50]
    texts = []
    for _ in range(50):
        notice = list(rng.choice(short))
        for _ in range(rng.randint(0, license_scan.errors_allowed("".join(notice)) + 1)):
            k = rng.randrange(len(notice))
            kind = rng.choice("sdi")
            notice[k : k + (kind != "i")] = [] if kind == "d" else [rng.choice("abcdefgz")]
        words = [rng.choice(["of", "the", "public", "licence", "general", "xq", "all"]) for _ in range(rng.randint(0, 8))]
        at = rng.randint(0, len(words))
        texts.append(" ".join([*words[:at], "".join(notice), *words[at:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in license_scan.scan_licenses(docs).collect()}
    found = 0
    for i, text in enumerate(texts):
        flat = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
        starts = [m.start() for m in re.finditer(r"\b\w", flat)]
        ends = [m.end() for m in re.finditer(r"\w\b", flat)]
        want = {}
        for notice in license_scan.NOTICES:
            k = license_scan.errors_allowed(notice)
            least = min((_edits(notice, flat[a:b]) for a in starts for b in ends if abs(b - a - len(notice)) <= k), default=k + 1)
            if least <= k:
                label = license_scan.NOTICES[notice]
                want[label] = min(least, want.get(label, k))
        labels = set(filter(None, got[i].labels.split(",")))
        assert labels - set(filter(None, got[i].base_labels.split(","))) <= set(want) <= labels, (flat, want, got[i].labels)
        for label, least in want.items():
            assert min(x.errors for x in got[i].spans if x.label == label) == least, (flat, label)
        found += len(want)
    assert found > 20


def test_languages_against_a_plain_count(spark):
    """Counts, bit classifiers, weighted decoding and margins, all by hand from the texts."""
    docs = spark.createDataFrame([(i, corpus.prose(i % 3, 12, 60).replace("e", "eEöÉ_ "[i % 3 * 2]), f"l{i % 3}") for i in range(30)] + [(90, "Éa 1b", "l0"), (91, None, "l1"), (92, "x", None)], "doc_id long, text string, lang string")

    def features(text):
        t = [32]
        for b in text.encode():
            c = b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else b if b >= 128 else 32
            t.append(c + 32 if t[-1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97 else c)
        t.append(32)
        out = []
        for a, b, c in zip(t, t[1:], t[2:]):
            if not (b == 32 and (a == 32 or c == 32)):
                h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) % 2**32
                h ^= h >> 15
                out.append((h * 0x2C1B3C6D) % 2**32 >> 17)
        return out

    rows = docs.collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang and r.text is not None]
    langs = sorted({r.lang for r in learn})
    counts = {x: Counter(f for r in learn if r.lang == x for f in features(r.text)) for x in langs}
    share = np.array([[counts[x][f] + 0.5 for f in range(language_id.FEATURES)] for x in langs])
    share /= share.sum(axis=1, keepdims=True)
    code = [b for b in itertools.product((-1, 1), repeat=len(langs)) if b[0] == 1 and -1 in b]
    weights = [np.log(share[[k for k in range(len(langs)) if b[k] == 1]].mean(axis=0)) - np.log(share[[k for k in range(len(langs)) if b[k] == -1]].mean(axis=0)) for b in code]
    scale = [max(1e-3, min(float(share[k] @ w) * b[k] for k in range(len(langs)))) for b, w in zip(code, weights)]
    for r in language_id.identify(docs).collect():
        text = next(x.text for x in rows if x.doc_id == r.id)
        f = features(text or "")
        if not f:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        margin = [max(-4.0, min(4.0, float(np.mean(w[f])) / s)) for w, s in zip(weights, scale)]
        loss = sorted((sum(s * max(0.0, 1 - m * b[k]) for m, b, s in zip(margin, code, scale)) / sum(scale), langs[k]) for k in range(len(langs)))
        assert r.lang_pred == loss[0][1] and r.score == pytest.approx((loss[1][0] - loss[0][0]) / (loss[1][0] + loss[0][0]), abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_pages_with_columns_named_like_the_results(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>" + "It was the best of the days and there is not much that we have to say about it. " * 6 + "</p></article>", "old", 5, "x")], "page_id long, url string, html string, TEXT string, N_CHARS int, __html string")
    got = html_text.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "__html", "text", "n_chars"]
    r = got.first()
    assert r["n_chars"] == len(r["text"]) > 50 and r["__html"] == "x"


def test_languages_nine_and_too_many(spark, monkeypatch):
    """More languages than exhaustive codewords are made for, and more than a model takes."""
    rng = np.random.default_rng(8)
    letters = [list("".join(chr(97 + (k * 7 + j * 3) % 26) for j in range(7))) for k in range(9)]
    rows = [(i, " ".join("".join(rng.choice(letters[i % 9], size=int(rng.integers(3, 8)))) for _ in range(40)), f"l{i % 9}") for i in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r for r in language_id.identify(docs).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 50 and np.mean([got[i]["lang_pred"] == f"l{i % 9}" for i in held]) > 0.95
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 8)
    with pytest.raises(ValueError, match="languages"):
        language_id.identify(docs)
