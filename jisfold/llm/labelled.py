"""A bounded sample of labelled documents, gathered for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents.

    labels: the id and the label (0 or 1); null ids and labels are left out,
    and an id with several labels gets the commoner one (a tie: 1).  ``learn``
    says which ids may be learnt from.  The ids with the smallest hashes are
    taken, so the sample is the same in every run.  Of documents that share a
    text and a label, one stays, so that copies do not outweigh the rest; a
    null text is empty.  Only the chosen ids are sent to all tasks, and their
    number is bounded.
    """
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).where(learn)
    own = own.groupBy(doc_id).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64(doc_id), doc_id).limit(bound).withColumnRenamed(doc_id, "__id")
    found = docs.select(doc_id, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(doc_id) == F.col("__id"))
    return found.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min_by("text", doc_id).alias("text"), F.min(doc_id).alias("doc_id")).select("doc_id", "text", "label")
