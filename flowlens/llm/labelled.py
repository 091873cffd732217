"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import held_out, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y, weight): about per_class labelled documents of each class, none held out.

    The labels are thinned before they meet the documents, at a rate set by a count of each class, so the sample is
    bounded at any size; a hash of the id says which they are. weight undoes the thinning. An id labelled twice counts
    once, with its largest label; null ids and null labels are left out, and null text is empty.
    """
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    given = given.groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}  # two rows
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / sizes.get(0, 1))))
    place = F.pmod(F.xxhash64("label_id", F.lit(label_col)), F.lit(1 << 30)) / F.lit(1 << 30)
    # bounded, so it may be broadcast: about 2 x per_class rows of three numbers
    chosen = F.broadcast(written(given.where(place < rate).withColumn("weight", 1 / rate), f"labels-{label_col}"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y", "weight")
