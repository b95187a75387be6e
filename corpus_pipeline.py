"""From raw documents to padded batches: the stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safemeter.llm import decontaminate, near_dup, packing, pii, quality
from safemeter.llm._common import table, written
from safemeter.llm.queries import PSEUDONYM_KEY, token_lengths


#: Fewest words of a document that stays.  The query of operator 3 asks for 50; here short clean documents stay too,
#: and the ratio alone judges them.
MIN_WORDS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go.

    Null, empty and wordless texts go.  Rows are judged one by one, so repeated rows share
    their fate and a null id changes nothing, but that such a row is never trusted.  Without
    labels all ratios are 0 and only the base rules decide.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), min_words=MIN_WORDS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard similarity 0.8 or more.

    It is the one of the least id, then of the least digest of its text.  Null and wordless
    texts are one group.  Rows equal in id and text count as one; rows with a null id stay.
    """
    return near_dup.keep_one(docs, of=near_dup.similar)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words repeat the benchmark go.

    Null and wordless texts stay.  An id that several rows share goes if one of them is
    contaminated; rows with a null id stay.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses become pseudonyms; ``n_chars`` follows the text.

    Every row stays, with a null text null; equal rows stay equal.
    """
    out = pii.pseudonymised(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sequences with bucket, batch and slot.

    A null or empty text is one sequence of no tokens; repeated rows and rows with a null id
    are packed each; columns other than id and text are left behind.
    """
    return packing.packed(token_lengths(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("length_packing", length_packing),
]
#: Hashed ratios, SimHash components and keyed permutations are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it.

    Other columns of ``documents`` go along to the last stage but one.  An empty table gives an
    empty result at every stage.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
