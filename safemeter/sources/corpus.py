"""Corpus files: JSON lines with explicit types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prompt_hash
from ..operators.checks import label_family_mismatch
from ..schemas import CORPUS, FAMILIES, LABELS, columns_of


def read_corpus(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """The corpus at ``path``; the stored hash is ignored and computed again.

    ``strict``: raise where a label contradicts its family or either is unknown.
    """
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)
    out = rows.withColumn("prompt_hash", prompt_hash(F.col("text")))
    if strict:
        bad = label_family_mismatch(out).unionByName(out.where(~F.col("family").isin(*FAMILIES) | ~F.col("label").isin(*LABELS)))
        if first := bad.take(1):
            raise ValueError(f"label and family disagree or are unknown: {first[0]}")
    return out


def write_corpus(corpus: DataFrame, path: str, *, mode: str = "errorifexists") -> int:
    """Write one JSON object per line, hash included; the number of rows written, counted on the way."""
    seen = Observation("written")
    rows = corpus.withColumn("prompt_hash", prompt_hash(F.col("text"))).select(*columns_of(CORPUS))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]
