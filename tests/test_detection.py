"""The fast tier, runs and the stream."""

import itertools
import math
import random
import re
import shutil
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from safemeter.operators import fast_tier, term_chunks, term_regression
from safemeter.plans import driver_tables, measure
from safemeter.schemas import RUNS, columns_of
from safemeter.sources.shared import evened
from safemeter.sources.store import RunStore
from safemeter.streaming import replay


@pytest.fixture(scope="module")
def halves(spark):
    """Labelled documents, those to fit on and those to score."""
    corpus = driver_tables.prompts(spark, "/root/testdata/sf0.001")
    return corpus.where("doc_id % 2 = 0"), corpus.where("doc_id % 2 = 1")


def test_tfidf_by_hand(spark):
    train = spark.createDataFrame([("aa bb aa", "attack"), ("aa cc", "benign"), ("bb cc", "benign")], "text string, label string")
    tier = fast_tier.fit(train)
    terms = tier.vocabulary.vocabulary
    assert sorted(terms) == ["aa", "bb", "cc"]  # pairs occur once each
    row = tier.features(train.limit(1)).first()["features"].toArray()
    idf = math.log(4 / 3) + 1
    norm = math.hypot(2 * idf, idf)
    assert row[terms.index("aa")] == pytest.approx(2 * idf / norm) and row[terms.index("bb")] == pytest.approx(idf / norm)
    scores = [r["tier1_score"] for r in tier.score(spark.createDataFrame([("aa aa",), ("cc",), (None,), ("",)], "text string")).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] > scores[1]
    with pytest.raises(ValueError):
        fast_tier.fit(train.where("label = 'benign'"))


def test_run_from_corpus_to_store_and_stream_equals_batch(spark, halves, tmp_path):
    train, held = halves
    tier = fast_tier.fit(train)
    manifest = spark.createDataFrame([("run", "d", "1", "h", "v", "stub", "1", 7, 0.3, 0.7, "g")], "run_id string, dataset_name string, dataset_version string, dataset_hash string, detector_version string, judge_model string, policy_version string, seed long, low_threshold double, high_threshold double, git_sha string")
    manifest = manifest.withColumns({"status": F.lit("completed"), "started_at": F.lit("2026-01-01").cast("timestamp"), "completed_at": F.lit("2026-01-02").cast("timestamp"), "configuration_hash": F.lit(""), "baseline_run_id": F.lit(None).cast("string")}).select(*columns_of(RUNS))
    t = measure.scored_run(held, ["doc_id"], tier, manifest)
    store = RunStore(spark, str(tmp_path / "store"))
    n = held.count()
    assert measure.land(store, t)["events"] == n and store.joined("run").count() == n
    assert set(t.events.columns) == {"run_id", "event_id", "ts", "prompt_hash", "text"}  # blind
    root = str(tmp_path)
    files = replay.publish(held, ["doc_id"], f"{root}/e", f"{root}/t", rows_per_file=n // 3 + 1)
    stream = measure.detections_of(replay.subscribe(spark, f"{root}/e"), tier, low=0.3, high=0.7)
    batches = []
    replay.land(stream, f"{root}/out", f"{root}/c", keys=["event_id"], also=(lambda df, k: batches.append(k),)).awaitTermination()
    assert len(batches) == files == 3
    for again in ("c2", "c3"):
        replay.land(stream, f"{root}/out", f"{root}/{again}", keys=["event_id"]).awaitTermination()
    got = replay.landed(spark, f"{root}/out", stream.schema)
    want = t.detections.select(*got.columns)
    assert got.count() == n and got.exceptAll(want).count() == 0
    other = measure.detections_of(replay.subscribe(spark, f"{root}/e"), tier, low=0.0, high=0.1)
    with pytest.raises(Exception, match="another payload"):
        replay.land(other, f"{root}/out", f"{root}/c4", keys=["event_id"]).awaitTermination()


_PAID = "k string, n long, at timestamp, tags array<string>"


def _landing(spark, root, checkpoint="c", **options):
    replay.land(spark.readStream.schema(_PAID).parquet(f"{root}/in"), f"{root}/out", f"{root}/{checkpoint}", keys=["k"], **options).awaitTermination()
    return sorted(tuple(r) for r in replay.landed(spark, f"{root}/out", spark.createDataFrame([], _PAID).schema).select("k", "n").collect())


def _offer(spark, root, rows):
    full = [(k, n, datetime(2026, 1, 1, microsecond=7), ["x", None]) for k, n in rows]
    spark.createDataFrame(full, _PAID).coalesce(1).write.mode("append").parquet(f"{root}/in")


def test_landing_keeps_its_keys_as_state_and_reads_nothing_back(spark, tmp_path):
    root = str(tmp_path)
    _offer(spark, root, [("a", 1), ("b", None), ("b", None), ("c", 2**53 + 1)])
    assert _landing(spark, root) == [("a", 1), ("b", None), ("c", 2**53 + 1)]
    shutil.move(f"{root}/out", f"{root}/aside")  # the same query goes on without what it landed
    _offer(spark, root, [("b", None), ("d", 4), ("a", 1)])
    assert _landing(spark, root) == [("d", 4)]
    shutil.copytree(f"{root}/aside", f"{root}/out", dirs_exist_ok=True)
    _offer(spark, root, [("e", 5)])
    assert _landing(spark, root, "new") == [("a", 1), ("b", None), ("c", 2**53 + 1), ("d", 4), ("e", 5)]  # another query starts from what lies there


@pytest.mark.parametrize("first, then, checkpoint", [([("a", 1)], [("a", 2)], "c"), ([("a", None)], [("a", 0)], "new"), ([("b", 1)], [("a", 1), ("a", 2)], "c")])
def test_landing_refuses_another_payload(spark, tmp_path, first, then, checkpoint):
    root = str(tmp_path)
    _offer(spark, root, first)
    assert _landing(spark, root) == first
    _offer(spark, root, then)
    with pytest.raises(Exception, match="another payload"):
        _landing(spark, root, checkpoint)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").select("k", "n").collect()) == first


def test_landing_tried_again_after_a_crash_leaves_one_copy(spark, tmp_path):
    root = str(tmp_path)

    def crash(batch, n):
        raise RuntimeError("lost")

    _offer(spark, root, [("a", 1), ("b", 2)])
    with pytest.raises(Exception, match="lost"):
        _landing(spark, root, also=(crash,))  # the batch is written, but not committed
    assert spark.read.parquet(f"{root}/out").count() == 2
    seen = []
    assert _landing(spark, root, also=(lambda batch, n: seen.append(batch.count()),)) == [("a", 1), ("b", 2)] and seen == [2]


def test_payload_digests_tell_values_and_nulls_apart(spark):
    rows = [("k", None, 1), ("k", "", 1), ("k", "null", 1), ("k", None, None), ("k", "1", None)]
    schema = "k string, a string, b int"
    df = spark.createDataFrame(rows, schema)
    made = [r[0] for r in df.select(replay.payload_digest(df.schema, ["k"])).collect()]
    assert len(set(made)) == len(rows)
    deep = spark.createDataFrame([("k", {"m": 1.5}, bytearray(b"x"), [None, 1])], "k string, m map<string, double>, y binary, l array<int>")
    assert len(deep.select(replay.payload_digest(deep.schema, ["k"])).first()[0]) == 64
    assert deep.select(replay.payload_digest(deep.select("k").schema, ["k"])).first()[0] == ""


def test_few_or_uneven_splits_are_dealt_out_and_even_ones_stay(spark):
    rows = spark.range(0, 4000, 1, 8)
    assert evened(rows) is rows and evened(spark.range(0)) is not None
    for uneven in (rows.coalesce(1), rows.repartition(8, F.least("id", F.lit(3000)))):
        dealt = evened(uneven.coalesce(1), "id", probe=uneven.coalesce(1))
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 4000 and max(sizes) < 1500
    one = spark.createDataFrame([("aa bb cc",), ("bb cc",), (None,), ("",), ("aa bb",)], "text string").coalesce(1)
    assert {tuple(r) for r in fast_tier.document_frequency(one).collect()} == {("aa", 2), ("bb", 3), ("cc", 2), ("aa bb", 2), ("bb cc", 2)}


def test_document_frequency_is_counted_in_chunks_and_added_up_in_tasks_of_bounded_text(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "Dd", "x", "éé", "١٢", "a_b"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += [None, "", "x", "aa", "aa-bb\tAA bb", " ".join(["ee", "ff"] * 40)] * 2
    want = Counter()
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        want.update({*w, *map(" ".join, itertools.pairwise(w))})
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    size = sum(len((t or "").encode()) for t in texts)
    monkeypatch.setattr(fast_tier, "TEXT_PER_TASK", 300)
    for chunk, pairs, batch in ((64 << 20, 1 << 18, 10_000), (600, 7, 10_000), (600, 7, 3), (1, 1, 10_000)):
        monkeypatch.setattr(fast_tier, "CHUNK", chunk)
        monkeypatch.setattr(fast_tier, "PAIRS", pairs)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for least in (1, 2):
                got = fast_tier.document_frequency(rows, min_documents=least)
                assert {tuple(r) for r in got.collect()} == {x for x in want.items() if x[1] >= least}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.rdd.getNumPartitions() == -(-size // 300) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = rows.where("text is null")
    assert fast_tier.document_frequency(none, min_documents=1).count() == fast_tier.document_frequency(rows.limit(0)).count() == 0


def test_fit_keeps_the_whole_vocabulary_of_its_sample(spark):
    train = spark.createDataFrame([(f"aa{k % 5} bb", "attack" if k % 2 else "benign") for k in range(20)], "text string, label string")
    assert len(fast_tier.fit(train).vocabulary.vocabulary) == 11
    assert "bb" in fast_tier.fit(train, sample=12).vocabulary.vocabulary


def test_term_tables_equal_a_converged_library_fit(spark, halves):
    """Coefficients, intercept and scores of the table fit against Spark's own optimiser run to convergence."""
    train, held = halves
    model, tier = term_regression.fit(train), fast_tier.fit(train)
    n, positive = train.count(), train.where("label = 'attack'").count()
    weight = F.when(F.col("y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    rows = tier.features(train.withColumn("y", (F.col("label") == "attack").cast("double"))).withColumn("weight", weight)
    library = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=1000, tol=1e-15).fit(rows)
    want = dict(zip(tier.vocabulary.vocabulary, library.coefficients.toArray().tolist(), strict=True))
    got = {r["term"]: r["coefficient"] for r in model.terms.collect()}
    assert got.keys() == want.keys() and max(abs(got[t] - want[t]) for t in want) < 1e-6 and abs(model.intercept - library.intercept) < 1e-6
    tier.model = fast_tier._model(spark, library.coefficients, library.intercept)
    scores = {r["doc_id"]: r["tier1_score"] for r in tier.score(held).collect()}
    same = {r["doc_id"]: r["tier1_score"] for r in term_regression.scored(held, model, "doc_id").collect()}
    assert same.keys() == scores.keys() and max(abs(same[k] - scores[k]) for k in scores) < 1e-6
    steep = term_regression.gradient(train, model).agg(F.max(F.abs("gradient"))).first()[0]
    assert steep < 1e-8


def test_term_tables_on_odd_rows(spark):
    train = spark.createDataFrame([("aa bb aa", "attack"), ("aa cc", "benign"), (None, "benign"), ("aa cc", "benign"), ("", "attack")], "text string, label string")
    model = term_regression.fit(train)
    rows = spark.createDataFrame([(1, "aa aa"), (2, None), (3, ""), (4, "zz")], "k long, text string")
    got = {r["k"]: r["tier1_score"] for r in term_regression.scored(rows, model, "k").collect()}
    assert len(got) == 4 and got[2] == got[3] == got[4] and all(0 < s < 1 for s in got.values())
    assert term_regression.scored(rows.limit(0), model, "k").count() == 0
    with pytest.raises(ValueError):
        term_regression.fit(train.where("label = 'benign'"))
    with pytest.raises(ValueError):
        term_regression.fit(train.limit(0))


def test_given_coefficients(spark):
    train = spark.createDataFrame([("aa bb",), ("aa bb",), ("cc",)], "text string")
    tier = fast_tier.with_coefficients(train, lambda t: float(len(t)), -1.0)
    got = [r[0] for r in tier.score(spark.createDataFrame([("aa bb",), ("zz",)], "text string")).select("tier1_score").collect()]
    # three terms of equal weight: two words of two characters, their pair of five
    assert got[0] == pytest.approx(1 / (1 + math.exp(1 - 9 / math.sqrt(3)))) and got[1] == pytest.approx(1 / (1 + math.e))


def test_term_tables_take_every_text_and_copies_of_texts(spark):
    """More texts than the sample of the row-by-row tier, most of them copies; the gradient vanishes and all texts count."""
    n = fast_tier.SAMPLE + 50
    train = spark.range(n).select(F.concat(F.lit("aa"), F.col("id") % 7, F.lit(" bb cc"), F.col("id") % 3).alias("text"), F.when(F.col("id") % 5 == 0, "attack").otherwise("benign").alias("label"))
    model = term_regression.fit(train)
    assert model.texts == n
    assert term_regression.gradient(train, model).agg(F.sqrt(F.sum(F.col("gradient") ** 2))).first()[0] < 1e-6
    given = term_regression.with_coefficients(train, F.lit(0.5), 0.0)
    assert given.texts == n and given.terms.agg(F.max("documents")).first()[0] == n  # "bb" is in every text


def test_term_counts_of_odd_texts(spark):
    rows = [("AA bb aa",), ("x",), ("",), (None,), ("bb bb bb",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(fast_tier.term_counts(F.col("text"))).collect()]
    counts = [None if r is None else {x["term"]: x["tf"] for x in r} for r in got]
    assert counts == [{"aa": 2, "bb": 1, "aa bb": 1, "bb aa": 1}, None, None, None, {"bb": 3, "bb bb": 2}]


def _vectors(texts, n, documents):
    """TF-IDF rows of length 1 over the terms in two documents or more, by hand."""
    out = []
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        x = {k: tf * (math.log((n + 1) / (documents[k] + 1)) + 1) for k, tf in Counter([*w, *map(" ".join, itertools.pairwise(w))]).items() if documents[k] >= 2}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.append({k: v / norm for k, v in x.items()})
    return out


def _odd_texts():
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "Dd", "x", "éé", "a_b", "ÄÖ", "ω1", "東京", "١٢"]
    texts = [" ".join(rng.choice(words if k % 3 else words[:8]) for _ in range(rng.randrange(14))) for k in range(90)]
    return [*texts, *texts[:30], None, "", "x", "aa-bb\tAA  bb", " ".join(["bb", "cc"] * 400)]


def _documents(texts):
    out = Counter()
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        out.update({*w, *map(" ".join, itertools.pairwise(w))})
    return out


@pytest.mark.parametrize("chunk, pairs, block, texts_at_once, buckets", [(64 << 20, 1 << 18, 1 << 17, 1 << 16, 8 << 20), (600, 7, 5, 1 << 16, 500), (1, 1, 1, 3, 100)])
def test_terms_meet_in_arrays_whatever_their_chunks_and_the_optimum_is_that_of_all_rows(spark, monkeypatch, chunk, pairs, block, texts_at_once, buckets):
    """A text that comes again, also with another label, is one text with more weight; no row is made for a term of a text."""
    for name, value in (("CHUNK", chunk), ("PAIRS", pairs), ("BLOCK", block), ("TEXTS", texts_at_once), ("TEXT_PER_TASK", buckets)):
        monkeypatch.setattr(term_chunks, name, value)
    texts = _odd_texts()
    label = [k % 4 == 0 for k in range(len(texts))]
    n, documents, y = len(texts), _documents(texts), [float(x) for x in label]
    train = spark.createDataFrame([(k, t, "attack" if a else "benign") for k, (t, a) in enumerate(zip(texts, label, strict=True))], "k long, text string, label string").coalesce(2)
    assert term_regression.numbered_texts(train, "text", "label").count() == len({t or "" for t in texts}) < n
    model = term_regression.fit(train)
    terms = {r["term"]: r for r in model.terms.collect()}
    assert model.texts == n and {t: r["documents"] for t, r in terms.items()} == {t: d for t, d in documents.items() if d >= 2}
    rows = _vectors(texts, n, documents)
    want = [1 / (1 + math.exp(-(model.intercept + sum(v * terms[t]["coefficient"] for t, v in x.items())))) for x in rows]
    got = {r["k"]: r["tier1_score"] for r in term_regression.scored(train, model, "k").collect()}
    assert len(got) == n and all(got[k] == pytest.approx(p, abs=1e-12) for k, p in enumerate(want))
    slope = [(n / (2 * sum(y)) if a else n / (2 * (n - sum(y)))) * (p - a) for p, a in zip(want, y, strict=True)]
    steep = {t: r["coefficient"] + sum(s * x.get(t, 0.0) for s, x in zip(slope, rows, strict=True)) for t, r in terms.items()}
    assert abs(sum(slope)) < 1e-8 and max(map(abs, steep.values())) < 1e-8
    other = term_regression.TermModel(model.terms.withColumn("coefficient", F.col("coefficient") + F.length("term")), 0.5, n, 0)
    p = [1 / (1 + math.exp(-(0.5 + sum(v * (terms[t]["coefficient"] + len(t)) for t, v in x.items())))) for x in rows]
    slope = [(n / (2 * sum(y)) if a else n / (2 * (n - sum(y)))) * (q - a) for q, a in zip(p, y, strict=True)]
    found = {r["term"]: r["gradient"] for r in term_regression.gradient(train, other).collect()}
    assert found.keys() == {None, *terms} and found[None] == pytest.approx(sum(slope))
    assert all(found[t] == pytest.approx(terms[t]["coefficient"] + len(t) + sum(s * x.get(t, 0.0) for s, x in zip(slope, rows, strict=True))) for t in terms)


def test_words_of_latin_texts_are_the_same_in_arrow_and_in_spark(spark):
    every = "".join(f"{chr(c)}ab{chr(c)}{chr(c)} " for c in range(0x250))
    words = spark.createDataFrame([(every,)], "text string").select(F.lower("text"), fast_tier.words_of(F.col("text"))).first()
    assert term_chunks.words_in(pa.array([words[0], None]), pa.nulls(2, pa.list_(pa.string()))).to_pylist() == [words[1], []]


def test_packed_numbers_come_back():
    for x in ([], [0], [2**31 - 1, 0, 5, 5, 2**31 - 1], list(range(0, 90000, 7)) * 2):
        x = np.array(x, np.int32)
        assert (term_chunks.unpacked(pa.py_buffer(term_chunks.packed(x)), len(x)) == x).all()


def test_equal_texts_are_scored_once_and_no_term_of_a_text_is_a_row(spark, monkeypatch):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["aa bb", "aa bb", None, "", "bb cc", "aa bb"])], "k long, text string")
    model = term_regression.with_coefficients(rows, F.length("term").cast("double"), 0.0)
    seen, plain = [], term_regression._of_chunks
    monkeypatch.setattr(term_regression, "_of_chunks", lambda df, *rest: (seen.append(df.count()), plain(df, *rest))[1])
    out = term_regression.scored(rows, model, "k")
    scores = {r["k"]: r["tier1_score"] for r in out.collect()}
    assert seen == [3] and scores[0] == scores[1] == scores[5] != scores[4] and scores[2] == scores[3] == 0.5
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_landing_asks_no_python_for_its_state_and_takes_null_keys(spark, tmp_path):
    root = str(tmp_path)
    _offer(spark, root, [(None, 1), ("a", 1), (None, 1), ("b", 2)])
    stream = spark.readStream.schema(_PAID).parquet(f"{root}/in")
    query = replay.land(stream, f"{root}/out", f"{root}/c", keys=["k"])
    query.awaitTermination()
    assert {o["operatorName"] for o in query.lastProgress["stateOperators"]} == {"dedupe"}
    _offer(spark, root, [("c", 3), (None, 1)])
    replay.land(stream, f"{root}/out", f"{root}/new", keys=["k"]).awaitTermination()  # all rows come again, and what has landed
    got = spark.read.parquet(f"{root}/out").select("k", "n").collect()
    assert len(got) == 4 and {tuple(r) for r in got} == {(None, 1), ("a", 1), ("b", 2), ("c", 3)}
    _offer(spark, root, [(None, 2)])
    with pytest.raises(Exception, match="another payload"):
        replay.land(stream, f"{root}/out", f"{root}/c", keys=["k"]).awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 4
