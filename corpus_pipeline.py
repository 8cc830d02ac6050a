"""A corpus pipeline of five stages, each applying one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. The first four
return the columns of ``documents``, the last the pieces of the packed
sequences. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crossbook.llm import decontaminate, langid, line_dedup, packing, simhash
from crossbook.llm.common import read_table
from crossbook.llm.token_files import shared_folder
from crossbook.llm.tokens import default_tokenizer


def language_id(spark, docs, sf_dir):
    """Documents whose language cannot be told go."""
    return langid.keep_identified(docs)


def dedup_lines(spark, docs, sf_dir):
    """Cross-site boilerplate lines leave all documents but the first."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
                          ).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark, docs, sf_dir):
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """What is left, as pieces of packed sequences."""
    return packing.pack_documents(docs, default_tokenizer(), 2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashes of shingles and tokenizer ids have no SQL form; the tests hold
#: every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what each returns is written to the
    shared folder and read from there."""
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
