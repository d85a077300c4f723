"""The thin queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.llm import exact_dedup, html_text, language_id, lexical_search, license_scan, lm_score, media, ngram_join, packing, periodic_runs, piece_sampling, secret_scan, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100, count_links=True)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is kept of every text, and the kept text itself."""
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_bytes=400, keep_first=False, kept_text="left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", suffix_dedup.sha256_hex("kept").alias("kept_sha256"), F.col("left").alias("text"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return out.withColumnRenamed("id", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and the digests of them and of what decoding them gives."""
    path = tokenizer_file("piece_bpe_32k.model")
    drawn = piece_sampling.sample_pieces(_table(spark, sf_dir, "documents"), path, seed=7)
    drawn = drawn.select("id", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "log_prob", F.col("pieces").alias("given"), "pieces")
    decoded = piece_sampling.decode_pieces(drawn, path)
    return decoded.select(F.col("id").alias("doc_id"), "n_pieces", "pieces_hash", "log_prob", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), F.col("given").alias("pieces"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals; sums in another order differ far below that."""
    held = language_id.fold("doc_id", 10) == 0
    out = lm_score.lm_scores(_table(spark, sf_dir, "documents"), held).withColumnRenamed("id", "doc_id")
    return out.withColumns({c: F.rint(F.col(c) * 1e6) / 1e6 for c in ("base_score", "score")})


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _joined_spans(spans: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans in their order, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    exact = secret_scan.KINDS[:3]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in exact]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined_spans("spans", exact), 256).alias("base_sha256"), _joined_spans("spans").alias("spans"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of every tenth document, by the checksum of its id, repeated from some word on."""
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("w")
    g = F.floor(F.col("h") / 10)
    changed = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", h.alias("h"), changed.alias("w")).withColumn("a", F.when(n > 0, (g % n).cast("int")))
    cut = cut.withColumn("p", (F.floor((n - F.col("a")) / (g % 8 + 3)) + 1).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    words = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), n)
    return cut.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    named = found.withColumn("m", longest)
    return named.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.expr("1000 * m.length div -m.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_language_id": op5_language_id,
    "op6_media_columns": op6_media_columns,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_lm_score": op8_lm_score,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op1_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        i AS (SELECT doc_id, len(w) AS words, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
        t AS (SELECT doc_id, words, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT DISTINCT doc_id, w || ' ' || w2 || ' ' || w3 AS g FROM t WHERE w3 IS NOT NULL UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
        s AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS whole FROM g GROUP BY doc_id),
        n AS (SELECT w.doc_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN min(w.doc_id) OVER (PARTITION BY whole) END AS class_id FROM w LEFT JOIN s USING (doc_id)),
        k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        d AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x),
        reach AS (SELECT doc_id, doc_id AS far FROM n UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.far = e.x)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(far) AS component_id, any_value(class_id) AS class_id, coalesce(any_value(n_links), 0) AS n_links
        FROM n JOIN reach USING (doc_id) LEFT JOIN d USING (doc_id) GROUP BY n.doc_id, n.n""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_lm_score": f"""
        WITH RECURSIVE crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents
          UNION ALL SELECT doc_id, s, k + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)
          FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substring(s, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
        fold AS (SELECT doc_id, xor(c, 4294967295) % 10 = 0 AS held_out FROM crc WHERE k = 8 * length(s)),
        w AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x20\\x09-\\x0D]+'), '') AS w FROM documents),
        i AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
        t AS (SELECT doc_id, held_out, w, lag(w, 1) OVER o AS b, lag(w, 2) OVER o AS a FROM i JOIN fold USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        c2 AS (SELECT b, w, count(*) AS c FROM t WHERE NOT held_out AND b IS NOT NULL GROUP BY b, w),
        c3 AS (SELECT a, b, w, count(*) AS c FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, w),
        k1 AS (SELECT b, sum(c) AS c, count(*) AS kinds FROM c2 GROUP BY b), k2 AS (SELECT a, b, sum(c) AS c, count(*) AS kinds FROM c3 GROUP BY a, b),
        n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) AS v FROM c1),
        p1 AS (SELECT t.*, coalesce(c1.c, 0) AS c, (coalesce(c1.c, 0) + 0.1) / (total + 0.1 * (v + 1)) AS p1, total FROM t CROSS JOIN n LEFT JOIN c1 ON t.w = c1.w),
        p2 AS (SELECT p1.*, CASE WHEN k1.c IS NULL THEN p1 ELSE greatest(coalesce(c2.c, 0) - 0.75, 0) / k1.c + 0.75 * k1.kinds / k1.c * p1 END AS p2
          FROM p1 LEFT JOIN k1 ON p1.b = k1.b LEFT JOIN c2 ON p1.b = c2.b AND p1.w = c2.w),
        p3 AS (SELECT p2.*, CASE WHEN k2.c IS NULL THEN p2 ELSE greatest(coalesce(c3.c, 0) - 0.75, 0) / k2.c + 0.75 * k2.kinds / k2.c * p2 END AS p3
          FROM p2 LEFT JOIN k2 ON p2.a = k2.a AND p2.b = k2.b LEFT JOIN c3 ON p2.a = c3.a AND p2.b = c3.b AND p2.w = c3.w)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, total AS train_tokens,
               round_even(sum(log10(p1)) * 1e6, 0) / 1e6 AS base_score, round_even(sum(log10(p3)) * 1e6, 0) / 1e6 AS score FROM p3 GROUP BY doc_id, held_out, total""",
    "op12_periodic_runs": """
        WITH RECURSIVE crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents
          UNION ALL SELECT doc_id, s, k + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)
          FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substring(s, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
        h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = 8 * length(s)),
        w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        ap AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w JOIN h USING (doc_id)),
        i AS (SELECT doc_id, w, a, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p, unnest(range(n)) AS i FROM ap),
        t AS (SELECT doc_id, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM i),
        e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
        g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
        lead_ AS (SELECT doc_id, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
        listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
               CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN lead_ USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_lexical_search": f"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
        tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
        total AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
        m AS (SELECT doc_id, CAST(75 + (25 * n * docs) // terms AS BIGINT) AS m FROM n, total),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
        s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
              FROM (SELECT item_id, t, count(*) AS k FROM q GROUP BY ALL) JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
}
