"""The corpus pipeline: five stages, each over all rows that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next docs with the columns of
``documents``, the last one the encoded corpus. ``run`` writes every stage to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.llm import byte_bpe, decontaminate, ngram_join, pii, quality_classifier
from cindergrid.llm.queries import site, table, tokenizer
from cindergrid.session import cut_lineage


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"), *site())


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one of smallest id; of repeated rows of an id one stays. Rows
    without id can't stand for a group and stay."""
    return ngram_join.first_of_groups(docs)


def benchmark(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    masked = pii.redact(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark, docs, sf_dir):
    """The corpus as packed token ids, with their number and the digest of what they decode to."""
    path = tokenizer()
    coded = byte_bpe.decode(byte_bpe.encode(docs, path), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]

#: Learned models and similarity joins have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
