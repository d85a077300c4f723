"""A training corpus from raw documents, in five stages that each write a table the next one reads.

Language ID, exact dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.  Every stage takes
(spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of documents.

Rows are told apart by id and text, so null and repeated ids are decided row by row.  Null and letterless texts go in
the first stage; a stage that meets them by itself keeps one null or empty text as an exact copy, and all of them
otherwise.  Further columns of any name are carried along.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.llm import exact_dedup, language_id, ngram_join, packing, suffix_dedup
from stratacube.llm.queries import tokenizer_file
from stratacube.llm.textbuf import unused
from stratacube.sources.workspace import Workspace

#: A text whose two nearest codewords are this close to a tie has no language.
LEAST_SCORE = 0.02
#: Words of a shingle and the similarity, in hundredths, from which documents are near copies.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Bytes of a repeated passage; passages of over fifty words are longer.
PASSAGE_BYTES = 200
SEQUENCE_TOKENS, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts of no language: null, letterless or ambiguous ones."""
    model = language_id.train(docs, "text", "lang", F.lit(True))
    lang, sure = unused("__lang", docs.columns), unused("__sure", docs.columns)
    found = language_id.predict(docs, model, "text", lang, sure)
    return found.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_SCORE)).drop(lang, sure)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id; texts without words all stay."""
    return ngram_join.drop_near_copies(docs, width=SHINGLE_WORDS, num=SIMILARITY, den=100)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, already has; a null text stays null."""
    own = tuple(unused(n, docs.columns) for n in ("__n_bytes", "__n_removed", "__n_spans", "__kept"))
    found = suffix_dedup.suffix_dedup(docs, min_bytes=PASSAGE_BYTES, keep_first=True, whole_chars=True, columns=own)
    _, removed, _, kept = own
    text = F.when(F.col(removed) > 0, F.decode(kept, "UTF-8")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    for c in docs.columns:
        if c.lower() == "n_chars":
            found = found.withColumn(c, F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType))
    return found.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token sequences: one row per piece with its sequence and place."""
    out = packing.best_fit_packing(docs, tokenizer_file(TOKENIZER), capacity=SEQUENCE_TOKENS, end_id=END_ID)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("suffix_dedup", passage_stage),
    ("packing", packing_stage),
]

#: None: byte-pair encoding and similarity components are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the rows of the last."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)  # no later stage reads it
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
