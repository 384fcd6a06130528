"""A corpus from raw documents to token ids: each stage works on what its predecessor kept.

toxicity -> line dedup -> SimHash near-dedup -> mixing to target weights -> byte-level BPE.
run() writes every stage's result as Parquet in the shared folder and rereads it as the next stage's documents.

Defined cases: a null text is no toxic one, has no lines and no SimHash, takes no room in the mixture and has null ids; so
has an empty text, but for an empty list of ids. Texts of any length are read whole by every stage. Rows with the same
doc_id and text are one row after line dedup: of those that differ in other columns the least as JSON stays. Ties go by
doc_id, then by row key. Without labelled documents of both kinds the first stage warns and keeps all. An empty table
gives no rows. Columns beyond those of documents, whatever their names, stay as they are till the last stage, which
returns doc_id, token_ids, n_tokens and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import bpe, line_dedup, mixing, simhash, toxicity
from lumenseek.llm.common import fresh, written
from lumenseek.llm.queries import SHARE, WEIGHTS, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any severity is under a half, after a fit on labels of the documents given."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, "expected_severity", "p_toxic", "severity")
    scored = toxicity.score(docs, model, docs.columns, names=names)
    return scored.filter(F.col(names[1]) < 0.5).drop(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, WEIGHTS, share=SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near_copies),
    ("mixing", mix_sources),
    ("byte bpe", encode),
]

#: MinHash, SimHash, a fitted model and BPE merges can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
