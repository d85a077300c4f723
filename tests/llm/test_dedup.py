"""Exact, near and passage dedup against brute force, and their odd cases."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacube.llm import exact_dedup, ngram_join, queries, suffix_dedup
from stratacube.sources.workspace import Workspace
from tests.llm import corpus


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_components_match_all_pairs(spark, monkeypatch, width, num):
    docs = corpus.planted(spark)
    want = corpus.components([(r.doc_id, r.text) for r in docs.collect()], width, num, 100)
    # with hardly any and with many shingles last in the order, these handed out or joined, few and many pairs left to the last round
    for frequent, most, centres in ((128, 1 << 20, 16), (4, 1 << 20, 2), (4, 0, 1)):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        monkeypatch.setattr(ngram_join, "MOST_FREQUENT", most)
        monkeypatch.setattr(ngram_join, "CENTRES", centres)
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, width=width, num=num, den=100).collect()}
        assert got == want
    assert sum(i != c for i, (_, c) in want.items()) > 20


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_links_match_all_pairs(spark, monkeypatch, width, num):
    docs = corpus.planted(spark)
    want = corpus.link_counts([(r.doc_id, r.text) for r in docs.collect()], width, num, 100)
    bounds = ((512, 1 << 17), (2, 1 << 17), (512, 300))  # components in one block, and in many by number and by size
    for sets, shingles in bounds if num == 90 else bounds[1:2]:
        monkeypatch.setattr(ngram_join, "LINK_SETS", sets)
        monkeypatch.setattr(ngram_join, "LINK_SHINGLES", shingles)
        got = ngram_join.ngram_components(docs, width=width, num=num, den=100, count_links=True)
        assert {r.id: r.n_links for r in got.collect()} == want
    assert max(want.values()) > 3


def test_a_large_family_of_near_copies_has_all_its_links(spark):
    words = corpus.prose(61, 300).split(" ")
    texts = [" ".join([*words[:k], "odd", *words[k:]]) for k in range(0, 300, 3)] + [" ".join(words[: 60 + k]) for k in range(0, 240, 5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])], "doc_id long, text string")
    want = corpus.link_counts(list(enumerate([r.text for r in docs.collect()])), 3, 90, 100)
    got = ngram_join.ngram_components(docs, count_links=True).collect()
    assert sorted((r.n_shingles, r.n_links) for r in got) == sorted((len(corpus.shingle_set(t, 3)), want[i]) for i, t in enumerate([r.text for r in docs.collect()]))


def test_shared_members_are_counted_over_many_columns():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40000, n)) for n in (30000, 20000, 5, 0)]
    side = lambda s: (np.concatenate(s), np.array([len(x) for x in s]))
    got = ngram_join._shared(side(sets), side(sets[::-1]))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[::-1]] for x in sets]


def test_ngram_odd_cases(spark):
    links = {(r.id, r.n_shingles): r.n_links for r in ngram_join.ngram_components(corpus.odd(spark), count_links=True).collect()}
    assert links[(0, 0)] == 0 and links[(1, 0)] == 0 and links[(3, 1)] == 0 and links[(6, 118)] == 2
    assert ngram_join.ngram_components(corpus.none(spark), count_links=True).count() == 0
    got = ngram_join.ngram_components(corpus.odd(spark)).collect()
    by = {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None}
    assert len(got) == 13
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[4] == (1, 4)
    assert by[5][1] == 5 and by[6][1] == 5
    assert by[7][0] == len(corpus.shingle_set(corpus.prose(5, 30000), 3))
    assert ngram_join.ngram_components(corpus.none(spark)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m, shared in ((40, 40, 30), (700, 650, 600), (9000, 8000, 7900), (300, 280, 0)):
        members = rng.integers(0, 2**62, n + m - shared, dtype=np.int64).astype(np.uint64)
        x, y = ngram_join._bitmap(np.sort(members[:n])), ngram_join._bitmap(np.sort(members[n - shared :]))
        assert len(x) * 64 >= 2 * n and len(x) % 8 == 0
        longs = min(len(x), len(y))
        least = int(np.bitwise_count((ngram_join._folded(x, longs) ^ ngram_join._folded(y, longs)).view(np.uint64)).sum())
        assert 0.6 * (n + m - 2 * shared) <= least <= n + m - 2 * shared


def test_near_copies_are_dropped_by_row_not_by_id(spark):
    text = corpus.prose(31, 120)
    near = text.replace(" ", "  ", 3) + " end"
    other = corpus.prose(32, 120)
    rows = [(5, text, "a"), (7, near, "b"), (5, other, "c"), (9, other, "d"), (None, other + " x", "e"), (11, None, "f"), (11, None, "g"), (12, " \t", "h"), (3, "few words", "i"), (3, "few words", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = ngram_join.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.n for r in out.collect()) == ["a", "c", "f", "g", "h", "i"]
    assert ngram_join.drop_near_copies(docs.limit(0)).count() == 0
    odd = corpus.odd(spark)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in ngram_join.drop_near_copies(odd).collect()) == [(False, i) for i in (0, 1, 2, 3, 4, 5, 7, 8, 9)] + [(True, 0), (True, 0)]


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup_matches_all_windows(spark, monkeypatch, keep_first):
    monkeypatch.setattr(suffix_dedup, "CORE_CELLS", 3 if keep_first else 8192)  # with and without cores settled by counting
    docs = corpus.planted(spark, 40)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = suffix_dedup.brute_force([t.encode() for _, t in rows], 120, keep_first)
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(docs, min_bytes=120, keep_first=keep_first).collect()}
    assert [got[i] for i, _ in rows] == want
    assert sum(w[0] > 0 for w in want) > 20


@pytest.mark.parametrize("keep_first", [False, True])
def test_a_class_of_very_many_stretches_is_dealt_over_tasks(spark, monkeypatch, keep_first):
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", 4, raising=False)
    text, other = (corpus.prose(k, 80).encode("ascii", "ignore").decode()[:n] for k, n in ((8, 120), (9, 119)))
    docs = spark.createDataFrame([(i, text) for i in range(200)] + [(300, other), (301, other + "x"), (302, other + "x")], "doc_id long, text string")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spans = suffix_dedup.repeated_spans(docs, "doc_id", "text", 120, keep_first, Workspace(spark, "dealt"))
        rows = spans.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    first = {0, 301} if keep_first else set()
    assert sorted((r.id, r.lo, r.hi) for r in rows) == [(i, 0, 120) for i in [*range(200), 301, 302] if i not in first]
    by_task = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(by_task) > 8 and max(by_task) < 60


def test_suffix_dedup_within_one_text_and_periods(spark):
    texts = ["ab" * 300, "xyz " * 50 + corpus.prose(8, 60) + " " + "xyz " * 50, "q" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for keep_first in (False, True):
        got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(docs, min_bytes=100, keep_first=keep_first).collect()}
        assert [got[i] for i in range(3)] == suffix_dedup.brute_force([t.encode() for t in texts], 100, keep_first)


def test_suffix_array_orders_suffixes():
    text = np.frombuffer(b"banana bandana banana", dtype=np.uint8)
    raw = text.tobytes()
    at = np.arange(len(raw))
    place = at[::-1].copy()
    for reach in (5, 8, 9, 21):
        order, head = suffix_dedup.suffix_order(text, at, place, reach)
        keys = [raw[i : i + reach].ljust(reach, b"\0") for i in order.tolist()]
        assert [(k, place[i]) for k, i in zip(keys, order)] == sorted((k, place[i]) for k, i in zip(keys, order))
        assert head.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_longest_previous_factors_by_brute_force():
    rng = np.random.default_rng(5)
    for reach, letters in ((6, 2), (9, 3), (40, 2), (200, 1)):
        text = rng.integers(97, 97 + letters, 300).astype(np.uint8)
        at = np.sort(rng.choice(300, 90, replace=False))
        place = rng.permutation(90)
        raw = text.tobytes()

        def share(i, j):
            k = 0
            while k < reach and max(i, j) + k < 300 and raw[i + k] == raw[j + k]:
                k += 1
            return k

        previous = suffix_dedup.longest_previous_factors(text, at, place, reach)
        other = suffix_dedup.longest_previous_factors(text, at, place, reach, any_other=True)
        for i in range(90):
            all_ = [(place[j] < place[i], share(at[i], at[j])) for j in range(90) if j != i]
            assert previous[i] == max([k for earlier, k in all_ if earlier], default=0)
            assert other[i] == max(k for _, k in all_)


def test_suffix_query_at_400_bytes_against_all_windows(spark, data):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    want = suffix_dedup.brute_force([t.encode() for _, t in rows], 400, False)
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, data).collect()}
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i, _ in rows] == want
    assert any(w[0] for w in want)
    for i, t in rows:
        assert got[i].n_bytes == len(t.encode()) and (got[i].n_removed > 0 or got[i].text == t)


def test_suffix_odd_cases(spark):
    out = suffix_dedup.suffix_dedup(corpus.odd(spark), min_bytes=60, keep_first=True, whole_chars=True)
    assert out.count() == 13 and "source" in out.columns
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert rows[0].n_bytes == 0 and bytes(rows[0].kept) == b"" and rows[5].n_removed == 0 and rows[6].n_removed == rows[6].n_bytes
    assert suffix_dedup.suffix_dedup(corpus.none(spark)).count() == 0
    named = suffix_dedup.suffix_dedup(corpus.odd(spark), min_bytes=60, columns=("a", "b", "c", "d"), kept_text="e")
    assert named.columns == [*corpus.odd(spark).columns, "a", "b", "c", "d", "e"] and {r.kept for r in named.collect()} == {"y"}
    cut = spark.createDataFrame([(0, "é" * 100), (1, "aé" + "é" * 99)], "doc_id long, text string")
    for r in suffix_dedup.suffix_dedup(cut, min_bytes=31, whole_chars=True).collect():
        bytes(r.kept).decode()


def test_exact_groups_match_sql_and_odd_cases(spark):
    docs = corpus.planted(spark)
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    want = sorted(duckdb.sql(queries.ORACLE_SQL["op9_exact_dedup"]).fetchall())
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(docs).select("id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    odd = exact_dedup.exact_groups(corpus.odd(spark)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.id is None, r.id) for r in odd if r.text_sha256 == empty) == [(False, 0), (False, 1), (True, None)]
    assert all(r.keep_id == 1 and r.group_size == 3 for r in odd if r.text_sha256 == empty)
    assert sum(r.kept for r in odd) == len({r.text_sha256 for r in odd})
    kept = exact_dedup.drop_exact_copies(corpus.odd(spark))
    assert kept.columns == corpus.odd(spark).columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 6").count() == 1
    assert exact_dedup.exact_groups(corpus.none(spark)).count() == 0


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_a_group_over_many_partitions_is_one_group(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MOST_PIECES", most)  # pieces handed to every task, or joined
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('own text ', id), 'the same text') AS text")
    got = exact_dedup.exact_groups(docs.repartition(16))
    assert got.where("kept").count() == 4000 - 2666 + 1
    assert got.where("group_size > 1").selectExpr("min(keep_id)", "max(keep_id)", "min(group_size)", "max(group_size)").first() == (3998, 3998, 2666, 2666)


def test_exact_copies_are_dropped_by_row_not_by_id(spark):
    rows = [(None, "kept without id"), (None, "copy"), (7, "copy"), (5, "text a"), (9, "text a"), (5, "text b"), (None, "kept without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert got == [(0, "kept without id"), (5, "text b"), (7, "copy"), (9, "text a")]
