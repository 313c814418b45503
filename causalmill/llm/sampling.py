"""Bounded training samples: a share of the labelled rows by a hash of the key, so that it is the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1 << 30


def sample(labelled: DataFrame, docs: DataFrame | None, per_class: int, key: str = "_key", label: str = "_label") -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label with their texts, and {label: rows of that label in all of ``labelled``}.

    ``labelled``: key and label (and the text, if ``docs`` is None); ``docs``: key and ``_text``. All labelled rows are counted; the sample holds the keys
    whose hash is below the class's share, so its expected size is bounded by ``per_class`` times the number of labels. Equal rows count once.
    """
    labelled = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per label
    share = F.lit(0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label) == F.lit(value), F.lit(PARTS if n <= per_class else int(PARTS * per_class / n))).otherwise(share)
    few = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(PARTS)) < share)
    if docs is not None:
        few = docs.join(F.broadcast(few.select(key, label).distinct()), key)
    return few.select(key, label, "_text").dropDuplicates(), counts
