"""Bounded, repeatable samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
_STEPS = 1 << 30


def sample_labels(labels: DataFrame, label: str, train: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and ``label`` of at most ``rows`` training documents, the first by a hash of the id.

    Labels of one document are merged first; a document labelled both ways is left out. A threshold
    on the hash, from the number of labels, keeps what is sorted near ``rows``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(
        F.min(label).alias(label), F.max(label).alias("_most")
    ).where(F.col(label) == F.col("_most"))
    share = min(1.0, 1.1 * rows / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(_STEPS))
    near = known.withColumn("_place", place).where(F.col("_place") <= int(share * _STEPS))
    return near.orderBy("_place", "doc_id").limit(rows).select("doc_id", label)


def sample_documents(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label of the sample; the sample is small enough to broadcast by its limit."""
    chosen = F.broadcast(sample_labels(labels, label, train, rows))
    return docs.select("doc_id", "text").join(chosen, "doc_id")
