"""Corpus pipeline over `documents`: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before kept, and the table that it returns is written as Parquet
and reread as the next one's `docs`. All but the last return the columns of
documents. Rows keep their values; only whole rows go or are repeated.

Edge cases: those of the operators. A null doc_id is in no near-duplicate group
and stays; of rows that share doc_id and text one stays, rows of one doc_id with
different texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epilake.llm import decontaminate, lang_id, mixing, near_dup, tokens
from epilake.llm.tables import only, read_table


def language_id(spark, docs, sf_dir):
    """Learns language models from the rows with lang and drops the documents that they reject."""
    model = lang_id.train(docs.select("doc_id", "text", "lang"))
    packed = docs.select("text", F.struct(*(c for c in docs.columns if c != "text")).alias("_row"))  # texts once, no clash of names
    kept = lang_id.predict(packed, model, keep=("text", "_row")).where(~F.col("rejected"))
    return kept.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark, docs, sf_dir):
    """One document (a doc_id with a text) of each near-duplicate group: that with the smallest doc_id. Rows that share
    both are one document; null and empty texts, and null doc_ids, are in no group."""
    return near_dup.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    """Drops the documents in which a benchmark item is found."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Repeats and thins the sources to their target weights."""
    return mixing.mix(docs)


def token_output(spark, docs, sf_dir):
    """Writes the token ids of the mixed corpus and reads their digests back."""
    return tokens.tokenize_and_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", token_output),
]

#: The language models and near-duplicate groups have no SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to `documents`; each one's result is written to the shared folder and read back, what it wrote on the way is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = only(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
