"""The stages one by one against brute force on their own input, and the whole run."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from stratacube.llm import suffix_dedup
from tests.llm import corpus

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    stages = dict(cp.STAGES)
    docs = corpus.planted(spark)
    docs = docs.union(spark.createDataFrame([(9001, None, None, None, None), (9002, "123 456", "en", "s", 7), (9003, "", "en", "s", 0)], docs.schema))
    ids = lambda df: {r.doc_id for r in df.collect()}
    one = stages["language_id"](spark, docs, DATA)
    assert one.columns == docs.columns and ids(docs) - ids(one) == {9001, 9002, 9003}
    two = stages["exact_dedup"](spark, one, DATA)
    best = {}
    for r in one.collect():
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    assert ids(two) == set(best.values()) and two.columns == docs.columns
    three = stages["ngram_join"](spark, two, DATA)
    linked = corpus.components([(r.doc_id, r.text) for r in two.collect()], cp.SHINGLE_WORDS, cp.SIMILARITY, 100)
    assert ids(three) == {i for i, (_, c) in linked.items() if i == c} and len(ids(three)) < len(ids(two))
    four = stages["suffix_dedup"](spark, three, DATA)
    rows = sorted((r.doc_id, r.text) for r in three.collect())
    want = suffix_dedup.brute_force([t.encode() for _, t in rows], cp.PASSAGE_BYTES, True)
    after = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns
    for (i, t), (gone, _, _) in zip(rows, want, strict=True):
        assert 0 <= len(t.encode()) - len(after[i].text.encode()) - 0 <= gone and (gone > 0 or after[i].text == t) and after[i].n_chars == len(after[i].text)
        assert gone - (len(t.encode()) - len(after[i].text.encode())) <= 6
    assert any(gone for gone, _, _ in want)
    five = stages["packing"](spark, four, DATA)
    assert ids(five) == set(after)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    """Nulls, empty and very long texts, repeated rows and ids, and the columns of other names come through."""
    stage, odd = dict(cp.STAGES)[name], corpus.odd(spark)
    more = odd.limit(1).select(F.lit(6).cast("long").alias("doc_id"), F.lit(corpus.prose(9, 80)).alias("text"), *(F.col(c) for c in odd.columns[2:]))
    docs = odd.union(more)  # another text of an id that a copy has
    out = stage(spark, docs, DATA)
    none = stage(spark, corpus.none(spark), DATA)
    assert none.count() == 0 and none.columns == out.columns
    got = out.collect()
    ids = sorted((r.doc_id for r in got if r.doc_id is not None))
    if name == "packing":
        assert len(got) > 14 and set(ids) == set(range(10))
        return
    assert out.columns == odd.columns and all(r.kept == "y" and r.n == 8 for r in got)
    want = {"language_id": [3, 4, 5, 5, 6, 6, 7, 8], "exact_dedup": [1, 2, 3, 4, 6, 6, 7, 8, 9], "ngram_join": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]}
    assert ids == want.get(name, [0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9])


#: Names that helpers and results have, in other cases too.
NAMES = ["__text", "__own", "__id", "__sha", "__hash", "__kh", "__spans", "__lang", "__sure", "__kept", "__n_removed", "KEPT", "N_Bytes", "component", "Score", "LANG_pred"]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_columns_of_clashing_names_come_through(spark, name):
    passage = corpus.prose(31, 80)
    rows = [(1, corpus.prose(1, 120) + " " + passage), (2, corpus.prose(2, 90) + " " + passage), (3, corpus.prose(3, 100)), (3, corpus.prose(3, 100)), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, N_CHARS int")
    docs = docs.select("*", *(F.lit(f"is {n}").alias(n) for n in NAMES))
    out = dict(cp.STAGES)[name](spark, docs, DATA)
    got = out.collect()
    assert got
    if name == "packing":
        return
    assert out.columns == docs.columns
    for r in got:
        assert [r[n] for n in NAMES] == [f"is {n}" for n in NAMES] and r["N_CHARS"] == len(r["text"] or "")


def test_run(spark):
    out = cp.run(spark, DATA)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {cp.SEQUENCE_TOKENS}").count() == 0
    assert out.select("doc_id").distinct().count() > 150


def test_no_document_is_dropped_for_its_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {r.doc_id for r in cp.language_stage(spark, docs, DATA).select("doc_id").collect()}
    assert all(r.doc_id in left for r in docs.collect() if len(re.findall(r"[^\W\d_]{2,}", r.text or "")) > 20)


def test_all_are_registered():
    import __spark_entry__ as e

    names = [k for k in e.queries() if k == "pipeline" or k[:2] == "op" and k[2:3].isdigit()]
    assert len(names) == 14 and {k.split("_")[0] for k in names} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
