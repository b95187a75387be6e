"""The pipeline's stages against the operators' brute-force meaning, on whole small tables."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from safemeter.llm import queries

from .test_operators import base_counts, low_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_whole_rows(spark, stages):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in stages[:-1]:
        assert docs.columns == before.columns
    sizes = [before.count(), *(d.count() for d in stages[:4])]
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_pseudonyms", "length_packing"]


def least_of_similar(texts):
    """The least id of each group that chains of pairs with a Jaccard similarity of 0.8 or more make."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = of(a), of(b)
            root[max(x, y)] = min(x, y)
    return {of(i) for i in sets}


def test_stage_decisions(spark, stages):
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    start, good, single, clean, masked = (rows(d) for d in (spark.read.parquet(f"{SF}/documents.parquet"), *stages[:4]))
    for i, t in start.items():
        n, _, _, _, repeated = base_counts(t)
        if n < 1 or 100 * repeated > 50 * n:
            assert i not in good
    assert set(single) == least_of_similar(good)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low_words(r["text"])
        size = min(13, len(w))
        windows |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
    for i, t in single.items():
        w, hit = low_words(t), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        assert (i in clean) == (not hit or 20 * len(hit) < len(w))
    for i, t in clean.items():
        for email in re.findall(r"[a-z]+\.\d\d@mail\d\.example\.com", t):
            assert email not in masked[i]
    assert set(clean) == set(masked) == {r["doc_id"] for r in stages[4].collect()}


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").count().collect()
    want = stages[4].groupBy("doc_id").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


LONG = "The quick brown fox jumps over the lazy dog while seventeen other animals look on in silence. " * 300
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, LONG, "en", "s", 1), (4, LONG, "en", "s", 1), (None, "a short note about nothing", None, None, None),
    (None, "a short note about nothing", None, None, None), (5, "Write to me at jo.doe@mail1.example.com or call (415) 555-2671 now.", "en", "s", 2), (6, "x", "en", "s", 1), (6, "another text", "en", "s", 1),
]
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, an id of two texts, and columns named like those of the operators."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    return docs.withColumns({"fingerprint": F.lit("f"), "n_tokens": F.lit(None).cast("int"), "found": F.lit(1), "spans": F.lit("s"), "row": F.lit(0), "Batch": F.lit("b"), "matches": F.lit(2)})


def at(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())


def test_quality_of_odd_rows(spark, odd):
    got = STAGE["quality_rules"](spark, odd, SF)
    assert got.columns == odd.columns and all(t.strip() for _, t in at(got))
    assert sum(i == 4 for i, _ in at(got)) in (0, 2) and STAGE["quality_rules"](spark, odd.limit(0), SF).count() == 0


def test_near_dedup_of_odd_rows(spark, odd):
    got = STAGE["simhash_near_dedup"](spark, odd, SF)
    assert got.columns == odd.columns
    assert at(got) == sorted([(1, ""), (4, LONG), (5, ODD[7][1]), (6, "x"), (6, "another text"), (-1, ODD[5][1]), (-1, ODD[5][1])])
    assert STAGE["simhash_near_dedup"](spark, odd.limit(0), SF).count() == 0


def test_decontamination_of_odd_rows(spark, odd):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first()["text"]
    docs = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(6).cast("long"), "text": F.lit(item)}))
    got = STAGE["benchmark_decontamination"](spark, docs, SF)
    assert got.columns == odd.columns and at(got) == [x for x in at(odd) if x[0] != 6]
    assert STAGE["benchmark_decontamination"](spark, odd.limit(0), SF).count() == 0


def test_pseudonyms_of_odd_rows(spark, odd):
    got = STAGE["pii_pseudonyms"](spark, odd, SF)
    assert got.columns == odd.columns and got.count() == len(ODD) and got.where("n_chars <> char_length(text)").count() == 0
    changed = {i for (i, a), (_, b) in zip(at(got), at(odd), strict=True) if a != b}
    assert changed == {5} and got.where("text is null").count() == 1 and STAGE["pii_pseudonyms"](spark, odd.limit(0), SF).count() == 0


def test_packing_of_odd_rows(spark, odd):
    got = STAGE["length_packing"](spark, odd, SF).collect()
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(r["length"])
    assert sum(r["segment"] == 0 for r in got) == len(ODD) and whole[1] == whole[2] == [0]
    assert sorted(whole[4]) == sorted(2 * sorted(whole[4])[::2]) and STAGE["length_packing"](spark, odd.limit(0), SF).count() == 0
