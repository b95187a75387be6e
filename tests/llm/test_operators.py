"""Each operator against brute force and on the awkward inputs its docstring defines."""

import hashlib
import hmac
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from safemeter.llm import chat, decontaminate, language, near_dup, packing, pii, quality, sharding, suffix_dedup, tokens
from safemeter.llm.queries import BYTE_BPE_JSON, BYTE_BPE_RANKS, tokenizer_path

WORDS = "alpha beta Gamma delta epsilon zeta eta theta iota kappa été über señor".split()
DOCS = "doc_id long, text string, lang string, source string, Tokens int, fingerprint string"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, empty, null, blank and one very long text."""
    rng = random.Random(5)
    rows = [text(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = text(rng, 40)
    rows += [rows[3], rows[3], rows[7] + " tail", "x " + rows[7], rows[9][:120] + rows[10][20:180], passage + rows[1], rows[2] + passage, "", None, " \t\n", "a", "aaaa" * 40, "aaaa" * 41]
    rows += [text(rng, 20000), "ß" * 60, passage]
    return [(i, t, "en" if i % 3 else None, "s", 1, "f") for i, t in enumerate(rows)] + [(5, rows[5], "en", "s", 1, "f"), (None, rows[6], "en", "s", 1, "f")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(spark, docs, corpus, none, tmp_path):
    from tokenizers import Tokenizer

    path, cache = tokenizer_path(BYTE_BPE_JSON), str(tmp_path / "cache")
    tok = Tokenizer.from_file(path)
    want = sorted((i or -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t, *_ in corpus)
    got = lambda df: sorted((r[0] or -1, r[1], r[2]) for r in df.collect())
    assert got(tokens.count_tokens(docs, path, cache)) == want
    stored = tokens.stored(spark, cache, tokens.tokenizer_digest(path))
    assert stored.count() == len({t or "" for _, t, *_ in corpus})
    assert got(tokens.count_tokens(docs, path, cache)) == want and stored.count() == tokens.stored(spark, cache, tokens.tokenizer_digest(path)).count()
    assert got(tokens.count_tokens(docs.coalesce(1), path, str(tmp_path / "one-split"))) == want
    more = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("  <|endoftext|> \n\n it's 12 　x")).alias("text"))
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False)) for r in more.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(more, path, cache).collect()} == want
    assert tokens.count_tokens(none, path, cache).count() == 0
    assert tokens.count_tokens(none, path, str(tmp_path / "other")).count() == 0


def test_piecewise_counts_equal_whole_counts():
    from pathlib import Path

    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE_JSON)
    rng, tok = random.Random(1), Tokenizer.from_file(path)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", " ", "​", "᠎", "a", "Z", "é", "ß", "1", "22", ".", "...", "'s", "'ll", "<|endoftext|>", "漢字", "😀", "क्", "́", "﻿", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    of = tokens.counter(".json", Path(path).read_bytes())
    assert of(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_other_tokenizers(docs):
    import public_tokenizers as P

    ranks = tokens.encoded(docs.select("doc_id", "text"), P.path(BYTE_BPE_RANKS), pattern=P.PATTERN)
    same = tokens.encoded(docs.select("doc_id", "text"), P.path(BYTE_BPE_JSON))
    assert sorted(map(tuple, ranks.collect()), key=str) == sorted(map(tuple, same.collect()), key=str)
    assert tokens.encoded(docs.select("text", "doc_id"), P.path("piece_bpe_32k.model")).where("n_tokens > 0").count() > 50


def test_language_held_out_accuracy(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.trained(docs, sample=100)
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "12 + 3 = 15 !"), (10**6 + 2, "")], "doc_id long, text string")
    got = language.identified(docs.select("doc_id", "text").unionByName(extra), model)
    bare = {r["doc_id"]: (r["language"], r["score"], r["rejected"]) for r in got.where("doc_id >= 1000000").collect()}
    assert set(bare.values()) == {("und", 0.0, True)}
    seen = got.join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert seen.where("language = lang").count() / seen.count() > 0.98
    assert seen.where("score < 0 or score > 1").count() == 0
    held = {r["doc_id"] for r in docs.where(language.held_out()).collect()}
    assert held == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    empty = language.trained(none)
    assert language.identified(none, empty).count() == 0
    assert {r["language"] for r in language.identified(extra, empty).collect()} == {"und"}


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_ratio(spark, docs, corpus, none):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)] + [(3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels, threshold=0.0).collect()
    want = Counter((i, *base_counts(t)) for i, t, *_ in corpus)
    assert Counter(tuple(r)[:6] for r in got) == want
    good = {i for i in range(40) if i % 4 and i != 3}
    counts = [defaultdict(int), defaultdict(int)]
    for i, t, *_ in corpus:
        b = np.frombuffer((t or "").encode(), np.uint8)
        for g in quality.buckets(b, 4).tolist():
            counts[0][g] += 1
            counts[1][g] += i in good
    total = [sum(c.values()) for c in counts]
    llr = lambda g: round((np.log((counts[1][g] + 1) / (total[1] + 65536)) - np.log((counts[0][g] + 1) / (total[0] + 65536))) * quality.SCALE)
    texts = {i: t for i, t, *_ in corpus}
    for r in got:
        grams = quality.buckets(np.frombuffer((texts[r["doc_id"]] or "").encode(), np.uint8), 4).tolist()
        mean = sum(map(llr, grams)) / len(grams) / quality.SCALE if grams else None
        assert r["llr"] == (pytest.approx(mean, abs=1e-6) if grams else None)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and (not grams or mean >= 0))
    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.judged(none, labels).count() == 0 and quality.judged(docs, labels.limit(0)).where("llr <> 0").count() == 0


def test_quality_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 0 and kept").count() == 0
    assert got.where("quality = 1 and not kept").count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(30, n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 5))
        bounds, padding = packing.optimal_boundaries(lengths, counts, k)
        cost = lambda bs: sum(int(c) * (min(b for b in bs if b >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))
        assert padding == cost(bounds) == min(cost(s) for s in combinations(lengths.tolist(), min(k, n)) if lengths[-1] in s)
    assert packing.optimal_boundaries(np.zeros(0), np.zeros(0), 3) == ([], 0)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 700)) for i in range(500)] + [(7, 20), (7, 20), (None, None), (1000, 5000), (1001, 0)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, n_tokens long"), max_length=512, buckets=4, token_budget=2048).toPandas()
    assert got["length"].sum() == sum(n or 0 for _, n in rows)
    assert got.groupby("doc_id")["segment"].count()[1000] == 10
    assert not got.duplicated(["batch", "slot"]).any()
    assert sorted(got["batch"].unique()) == list(range(got["batch"].nunique()))
    for _, b in got.groupby("batch"):
        assert b["bucket"].nunique() == 1 and sorted(b["slot"]) == list(range(len(b)))
        assert len(b) <= max(1, 2048 // b["padded_length"].iloc[0]) and (b["length"] <= b["padded_length"]).all()
    full = got.groupby(["bucket", "batch"]).size().groupby("bucket")
    assert all((sizes.sort_values().iloc[1:] == sizes.max()).all() for _, sizes in full)
    assert packing.packed(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def low_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, docs, corpus, none):
    texts = {i: t for i, t, *_ in corpus}
    long = " ".join(low_words(texts[73])[100:130]).upper()
    items = [("a", texts[1]), ("a", texts[1]), ("b", "alpha, beta"), ("c", texts[75]), ("d", None), ("e", "!!"), (None, texts[2]), ("f", long), ("g", "kappa")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id string, text string, doc_id int")
    windows = defaultdict(set)
    for item, t in items:
        w = low_words(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    sizes = {len(w) for w in windows}
    want = Counter()
    for i, t, *_ in corpus:
        w, hit, found = low_words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (s := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= s
                    hit |= set(range(k, k + size))
        want[(i, len(w), len(hit), ",".join(sorted(found - {None})), bool(hit) and 20 * len(hit) >= len(w))] += 1
    got = decontaminate.contamination(docs, bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    clean = decontaminate.keep_clean(docs, bench)
    bad = {r["doc_id"] for r in got if r["contaminated"]} - {None}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, *_ in corpus if i not in bad)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_guarantee():
    """Any 13 words shared have a fingerprint in common, wherever they stand."""
    rng = random.Random(3)
    span = [rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(13)]
    import pyarrow as pa

    from safemeter.llm._bytes import ByteHash

    hashes = []
    for _ in range(50):
        t = " ".join([*(str(rng.random()) for _ in range(rng.randint(0, 9))), *span, *(str(rng.random()) for _ in range(5))])
        for *_, found, _ in decontaminate._grams(pa.array([t]), 13, 5, [13], ByteHash(5)):
            hashes += [set(found[0][3].tolist())]
    assert set.intersection(*hashes)


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(ids, fps, budget=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[find(k)] for k in range(len(ids))]


def test_near_duplicates(spark, docs, corpus, none):
    ids, fps = [i for i, *_ in corpus], [slow_fingerprint(t) for _, t, *_ in corpus]
    got = near_dup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in got) == Counter(zip(ids, fps, reachable(ids, fps), strict=True))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for c in reachable(ids, fps) if c is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want) and kept.where("doc_id is null").count() == 1
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_one(none).count() == 0


def test_keep_one_decides_by_row(spark):
    rng = random.Random(8)
    a, b, c = (text(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (0, c), (3, text(rng, 80)), (None, b)]
    for of in (near_dup.near_duplicates, near_dup.similar):
        kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), of=of)
        assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (1, b), (0, c), rows[6], rows[7]])


def test_texts_of_equal_xxhash64_are_told_apart(spark):
    one, two = "iK2ZWeqhFWCEPyYngFb51yBMWXaSCrUZoL8g5ubbbPIa84yRn BUbHoWC8FJowoR", "fO7ejYQdFWCEPyYngFb51yBMWXaSCrUZKZ@loLh;bPIa84yRn BUbHoWC8FJowoR"
    df = spark.createDataFrame([(1, one), (2, two), (3, one), (4, None), (4, "")], "doc_id long, text string")
    assert df.limit(2).select(F.xxhash64("text")).distinct().count() == 1
    assert sorted(map(tuple, near_dup.similar(df).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (4, 4)]
    kept = near_dup.keep_one(df, of=near_dup.similar)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_similar_links_edited_copies(spark, docs, corpus, none):
    rng = random.Random(9)
    texts = []
    for n in (60, 100, 400):
        for edits in range(1, 1 + n // 40):
            words = [f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(n)]
            other = list(words)
            for k in range(edits):
                other[(2 * k + 1) * n // (2 * edits)] = "edited"
            texts += [" ".join(words), " ".join(other)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t, *_ in corpus if i is not None]
    sets = [near_dup.shingles(t, 5) for _, t in rows]
    forest = near_dup.Forest(len(rows))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum(a < len(texts) for a, _ in pairs) > 5
    forest.link(*map(np.array, zip(*pairs, strict=True)))
    least = {}
    for (i, _), r in zip(rows, forest.label, strict=True):
        least[r] = min(least.get(r, i), i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, near_dup.similar(df).collect()))
    assert got == Counter((i, least[r]) for (i, _), r in zip(rows, forest.label, strict=True))
    assert sorted(r["doc_id"] for r in near_dup.keep_one(df, of=near_dup.similar).collect()) == sorted(least.values())
    assert near_dup.similar(none).count() == 0


@pytest.mark.parametrize(("levels", "most"), [(6, 65536), (3, 20)])
def test_trie_walk_finds_all_links(spark, levels, most, monkeypatch):
    rng = np.random.default_rng(levels)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    chain = near[:100] ^ np.uint64(7)
    dense = base[0] ^ np.arange(256, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, chain, dense, [np.uint64(0), np.uint64(2**64 - 1)]]))
    monkeypatch.setattr(near_dup, "LEAST_LEVELS", levels)
    monkeypatch.setattr(near_dup, "MOST_IN_PAIR", most)
    edges = near_dup.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fingerprint long"))
    ends = edges.collect()
    assert all((e["a"] % 2**64 ^ e["b"] % 2**64).bit_count() <= 64 for e in ends)
    got = {r["node"]: r["root"] for r in near_dup.components(edges).collect()}
    forest = near_dup.Forest(len(fps))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    forest.link(i, j)
    signed = fps.view(np.int64)
    least = {}
    for k, r in enumerate(forest.label):
        least[r] = min(least.get(r, 2**63), int(signed[k]))
    assert {int(s): got.get(int(s), int(s)) for s in signed} == {int(s): least[r] for s, r in zip(signed, forest.label, strict=True)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (7, 6)]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "user", "bye"), (1, 3, "user", "bye"), (1, 2, None, "?"), (2, 0, "system", "alone"), (None, 5, "a", "x"), (None, None, "b", "y")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    got = chat.rotated(df).collect()
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: r["position"]):
        whole[(r["conv_id"], r["perspective"])].append(r)
    assert set(whole) == {(1, "user"), (1, "assistant"), (1, "unknown"), (None, "a"), (None, "b")}
    for (conv, me), rows in whole.items():
        said = sorted(((-1 if t is None else t, w or "unknown", x or "") for c, t, w, x in turns if c == conv))
        assert [r["position"] for r in rows] == list(range(len(said)))
        out, at = "", 0
        for r, (_, who, x) in zip(rows, said, strict=True):
            head = "<|im_start|>" + ("system" if who == "system" else "assistant" if who == me else f"user name={who}") + "\n"
            assert r["segment"] == head + x + "<|im_end|>\n" and r["trained"] == (who == me) and r["role"] == ("system" if who == "system" else "assistant" if who == me else "user")
            assert (r["start"], r["end"]) == (at + len(head), at + len(head) + len(x))
            out += r["segment"]
            at = len(out)
            assert out[r["start"] : r["end"]] == x
    assert chat.rotated(df.limit(0)).count() == 0


def luhn(s):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    good = {
        "card": ["4539578763621486", "4539 5787 6362 1486", "3714-496353-98431"], "phone": ["+1 (162) 555-6820", "(415) 555-2671", "+49 30 1234567"],
        "ip": ["106.158.249.239", "1.2.3.4"], "date": ["1984-02-29", "31/12/1999", "24.12.2010", "2001/01/31", "02/28/2000"], "ssn": ["123-45-6789"],
        "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], "email": ["ue.97@mail5.example.com", "A.b-C1@x.org"],
        "secret": ['token = "7702344ead31d5951aabbccdd0011', "API_KEY: Zx9Zx9Zx9Zx9Zx9Zx9"],
    }
    bad = ["4539578763621487", "999.1.1.1", "1.2.3.4.5", "02/30/2001", "000-12-1234", "DE00 3704 0044 0532 0130 00", "127.0.0.1", "9234567890123456", "12345", "a@b", "1700-01-01"]
    rows = [(k, v) for k, vs in good.items() for v in vs]
    df = spark.createDataFrame([(i, f"see {v}, or {v}.", 1) for i, (_, v) in enumerate(rows)] + [(100 + i, f"see {v} now", 1) for i, v in enumerate(bad)] + [(200, None, 1), (201, "", 1), (202, "x" * 200_000 + " 4539578763621486", 1)], "doc_id long, text string, found int")
    out = {r["doc_id"]: r for r in pii.pseudonymised(df, "k", found_col="hits").collect()}
    for i, (kind, v) in enumerate(rows):
        hits = out[i]["hits"]
        assert [h["kind"] for h in hits] == [kind, kind] and hits[0]["value"] == v, (kind, v, hits)
        new = hits[0]["pseudonym"]
        assert new == hits[1]["pseudonym"] != v and out[i]["text"] == f"see {new}, or {new}."
        shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
        if kind not in ("ip", "secret"):
            assert shape(new) == shape(v)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new)) and new[0] == v[0]
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in new.split("."))
    for i, v in enumerate(bad):
        assert out[100 + i]["text"] == f"see {v} now" and out[100 + i]["hits"] == []
    assert out[200]["text"] is None and out[201]["text"] == "" and out[202]["text"].startswith("x" * 200_000) and len(out[202]["hits"]) == 1
    same = pii.pseudonymised(df.where("doc_id in (0, 1)"), "k").collect()
    assert re.sub(r"\D", "", same[0]["text"]) == re.sub(r"\D", "", same[1]["text"])  # one card, two spellings
    other = pii.pseudonymised(df.where("doc_id = 0"), "another key").first()["text"]
    assert other != out[0]["text"] and pii.pseudonymised(df.limit(0), "k").count() == 0


def test_no_local_part_stays(spark):
    """Local parts of other scripts, of signs only and of one letter; equal ones stay linked, others stay apart."""
    local = ["иван", "ü", "李雷", "josé.1", "_", "+-%", "مريم", *"abcdefghijklmnopqrstuvwxyz0123456789"]
    rows = [(k, f"to {x}@site.cn, {x}@site.cn") for k, x in enumerate(local)]
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k", found_col="found").collect()
    new = {}
    for r in got:
        old = local[r["doc_id"]]
        assert [f["value"] for f in r["found"]] == [f"{old}@site.cn"] * 2
        a, b = re.fullmatch(r"to ([A-Za-z0-9._%+-]{1,64})@site\.cn, ([A-Za-z0-9._%+-]{1,64})@site\.cn", r["text"]).groups()
        assert a == b != old
        new[old] = a
    assert len(set(new.values())) == len(local)


def test_pseudonyms_of_long_secrets_and_timestamps(spark):
    long, day = "a1B2" * 60, "2024-01-05"
    rows = [(0, f"token: {long} end"), (1, f"at {day}T10:00:00Z, {day}t23 and {day}."), (2, f"{day}Tuesday {day}T77"), (3, f"secret={long[:129]}\u00e9"), (4, f"password={long[:128]}-")]
    out = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id int, text string"), "k", found_col="hits").collect()}
    for i in (0, 3, 4):
        assert [h["kind"] for h in out[i]["hits"]] == ["secret"] and long[:20] not in out[i]["text"]
    hits = out[1]["hits"]
    new = hits[0]["pseudonym"]
    assert [(h["kind"], h["value"], h["pseudonym"]) for h in hits] == [("date", day, new)] * 3 and new != day
    assert out[1]["text"] == f"at {new}T10:00:00Z, {new}t23 and {new}." and out[2]["text"] == rows[2][1]


def slow_feistel(cells, radices, key, tweak):
    n, half = len(cells), len(cells) // 2
    for r in range(1, pii.ROUNDS + 1):
        odd = r % 2 == 1
        seen = cells[half:] if odd else cells[:half]
        digest = hmac.new(key.encode(), "|".join([tweak, str(r), str(n), ",".join(map(str, seen))]).encode(), "sha256").hexdigest()
        added = [int(digest[i % 16 * 4 : i % 16 * 4 + 4], 16) for i in range(n)]
        cells = [(x + added[i]) % radices[i] if (i < half) == odd else x for i, x in enumerate(cells)]
    return cells


def slow_pseudonym(kind, v, key):
    """The rules of each format, one value at a time; None for secrets and e-mail addresses."""
    digits = [int(c) for c in v if c.isdigit()]
    fill = lambda shape, new: "".join(str(new.pop(0)) if c.isdigit() else c for c in shape)
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        a, g, s = slow_feistel([a - (2 if a > 666 else 1), g - 1, s - 1], [898, 99, 9999], key, "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{s + 1:04d}"
    if kind == "ip":
        x = list(map(int, v.split(".")))
        while True:
            x = slow_feistel(x, [256] * 4, key, "ip")
            if ".".join(map(str, x)) not in ("0.0.0.0", "127.0.0.1", "255.255.255.255"):
                return ".".join(map(str, x))
    if kind == "card":
        kept = 1 if digits[0] == 4 else 4
        new = digits[:kept] + slow_feistel(digits[kept:-1], [10] * (len(digits) - kept - 1), key, "card")
        return fill(v, [*new, next(d for d in range(10) if luhn("".join(map(str, [*new, d]))))])
    if kind == "phone" and not v.startswith("+"):
        x = [d - 2 if i in (0, 3) and d > 1 else d for i, d in enumerate(digits)]
        radices = [(8 if digits[i] > 1 else 2) if i in (0, 3) else 10 for i in range(10)]
        new = slow_feistel(x, radices, key, "phone|" + ",".join(map(str, radices)))
        return fill(v, [d + 2 if i in (0, 3) and digits[i] > 1 else d for i, d in enumerate(new)])
    if kind == "date" and v[4] == "-":
        n = (date.fromisoformat(v) - date(1800, 1, 1)).days
        a, b = slow_feistel([n // 773, n % 773], [189, 773], key, "date")
        return str(date(1800, 1, 1) + timedelta(a * 773 + b))
    return None


def test_pseudonyms_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(4)
    extra = [f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}, 10.{rng.randint(0, 255)}.0.7 ({rng.randint(200, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} {date(1990, 1, 1) + timedelta(rng.randint(0, 9999))}." for _ in range(100)]
    more = spark.createDataFrame(list(enumerate(extra, 10**6)), "doc_id long, text string")
    seen, n = Counter(), 0
    for r in pii.pseudonymised(docs.unionByName(more), "k", found_col="hits").where("size(hits) > 0").collect():
        for h in r["hits"]:
            want = slow_pseudonym(h["kind"], h["value"], "k")
            if want is not None and not h["value"].startswith("666-"):
                assert h["pseudonym"] == want, h
                seen[h["kind"]] += 1
            assert h["pseudonym"] in r["text"]
            n += 1
    assert min(seen[k] for k in ("ssn", "ip", "phone", "date")) >= 50 and n > 400


def test_pseudonyms_are_valid_and_distinct(spark):
    """Distinct valid values give distinct valid values; a second pass finds every one of them."""
    rng = random.Random(8)
    ssn = {f"{a:03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for a in range(1, 900) if a != 666 for _ in range(2)}
    phone = {f"({rng.randint(2, 9)}{rng.randint(0, 99):02d}) {rng.randint(2, 9)}{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}" for _ in range(1500)}
    day = {t for k in range(0, 146097, 97) for d in [date(1800, 1, 1) + timedelta(k)] for t in (f"{d:%m/%d}/{d.year}", f"{d:%d/%m}/{d.year}")}
    secret = {f"token={''.join(rng.choice('0123456789abcdef') for _ in range(16))}" for _ in range(500)} | {f"token={rng.randint(0, 10**16 - 1):016d}" for _ in range(200)}
    for kind, values in (("ssn", ssn), ("phone", phone), ("date", day), ("secret", {v for v in secret if re.search("[0-9]", v)})):
        df = spark.createDataFrame([(v,) for v in sorted(values)], "text string").repartition(8)
        once = pii.pseudonymised(df, "k", found_col="hits").cache()
        assert once.where("size(hits) = 1").count() == len(values), kind
        new = {r[0] for r in once.select("text").collect()}
        assert len(new) == len(values), kind
        assert pii.pseudonymised(once.select("text"), "k", found_col="hits").where(F.expr(f"size(hits) = 1 and hits[0].kind = '{kind}'")).count() == len(values), kind
        once.unpersist()
    assert not [v for v in {pii_one(spark, v) for v in ("(212) 555-0100", "(907) 299-0000")} if not re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", v)]


def pii_one(spark, v):
    return pii.pseudonymised(spark.createDataFrame([(v,)], "text string"), "k").first()["text"]


def test_the_key_is_in_no_plan(spark):
    out = pii.pseudonymised(spark.createDataFrame([("123-45-6789",)], "text string"), "a very secret key")
    shown = out._jdf.queryExecution().toString()
    inner, outer = pii.Key.padded("a very secret key")
    assert "very secret" not in shown and inner.hex() not in shown.lower() and "very secret" not in str(out._jdf.queryExecution().executedPlan())
    with pytest.raises(ValueError):
        pii.pseudonymised(out, "k", found_col="TEXT")


def test_feistel_is_a_permutation(spark):
    df = spark.createDataFrame([(a, b) for a in range(7) for b in range(30)], "a int, b int")
    key = pii.Key(*map(F.lit, pii.Key.padded("k")))
    moved = pii.feistel(F.array("a", "b"), F.array(F.lit(7), F.lit(30)), key, F.lit("t"))
    got = {tuple(r[:2]): tuple(r[2]) for r in df.select("a", "b", moved).collect()}
    assert len(set(got.values())) == 210
    assert all(v == tuple(slow_feistel(list(k), [7, 30], "k", "t")) for k, v in got.items())
    days = spark.range(20000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymised(days, "k").distinct().count() == 20000


def test_sharding(spark, docs, corpus, none):
    got = sharding.sharded(docs, shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    texts = {i: t for i, t, *_ in corpus}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    of, slots, total = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        of[texts[r["doc_id"]] or ""].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(int)
    for _, t, *_ in corpus:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += size(t)
    sizes = [groups[d] for d in sorted(groups)]

    def shards(capacity):
        n, now = 1, 0
        for s in sizes:
            n, now = (n + 1, s) if now + s > capacity else (n, now + s)
        return n

    best = next(c for c in range(max(max(sizes), sum(sizes) // 7), sum(sizes) + 1) if shards(c) <= 7)
    assert max(total.values()) <= best
    order = sorted((r["digest"], r["shard"]) for r in got)
    assert [s for _, s in order] == sorted(s for _, s in order)
    assert sharding.sharded(none).count() == 0


def test_sharding_of_many_groups_is_exact(monkeypatch):
    rng = random.Random(3)
    for trial in range(120):
        n, shards = rng.choice([1, 2, 5, 30, 200, 1000]), rng.choice([1, 2, 3, 7, 40])
        groups = sorted((hashlib.sha256(f"{trial}-{i}".encode()).hexdigest(), rng.choice([16, rng.randint(16, 3000)])) for i in range(n))
        if trial % 3 == 0:
            k = rng.randrange(n)
            groups[k] = (groups[k][0], rng.randint(1000, 200_000))

        def blocks(_, digits, within=None, groups=groups):
            out = {}
            for d, b in groups:
                if within is None or d[: len(within[0])] in within:
                    x = out.setdefault(d[:digits], [0, 0, 0])
                    out[d[:digits]] = [x[0] + b, x[1] + 1, max(x[2], b)]
            return [(k, *v) for k, v in out.items()]

        monkeypatch.setattr(sharding, "_blocks", blocks)
        monkeypatch.setattr(sharding, "FIRST_DIGITS", rng.choice([1, 2]))
        monkeypatch.setattr(sharding, "AT_ONCE", rng.choice([0, 20]))
        capacity, starts = sharding.boundaries(None, shards)
        low, high = max(b for _, b in groups), sum(b for _, b in groups)
        while low < high:
            mid, used, now = (low + high) // 2, 1, 0
            for _, b in groups:
                used, now = (used + 1, b) if now + b > mid else (used, now + b)
            low, high = (low, mid) if used <= shards else (mid + 1, high)
        total = [0] * shards
        for d, b in groups:
            total[sum(s <= d for s in starts)] += b
        assert capacity == low and max(total) <= capacity


def test_suffix_dedup(spark, docs, corpus, none):
    first = {}
    for i, t, *_ in sorted(corpus, key=lambda r: 2**63 if r[0] is None else r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], 2**63 if i is None else i)
    want = Counter()
    for i, t, *_ in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (2**63 if i is None else i):
                gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want[(i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    got = suffix_dedup.deduplicated(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == want
    assert suffix_dedup.deduplicated(none).count() == 0


def test_suffix_dedup_of_near_copies_and_short_periods(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = []
    for i in range(40):
        a, n = rng.randint(0, 2500), rng.randint(30, 400)
        t = base[a : a + n]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("xyz") + t[k + 1 :]
        rows.append((i, t + rng.choice(["", "ab" * rng.randint(10, 60), "a" * rng.randint(40, 120)])))
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        assert got[i] == "".join(c for c, g in zip(t, gone, strict=True) if not g)


def thue_morse(n, a, b):
    """Two texts of ``n`` characters that sums of powers modulo 2 ** 64 cannot tell apart."""
    x = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[k] for k in x), "".join((b, a)[k] for k in x)


def test_alike_but_unequal_strings_stay_apart(spark, labels_of_none):
    x, y = thue_morse(1024, "a", "b")
    docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x} {x} {x} {y} {y} {y}"), (3, f"{x}\n{x}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels_of_none).collect()}
    assert [got[k]["n_dup_lines"] for k in (1, 2, 3)] == [0, 0, 1]
    assert got[2]["n_repeat_words"] == 0
    u, v = thue_morse(512, "a", "b")
    bench = spark.createDataFrame([("i", u)], "item_id string, text string")
    hits = decontaminate.contamination(spark.createDataFrame([(1, u), (2, v)], "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["n_hit"] for r in hits} == {1: 1, 2: 0}
    kept = suffix_dedup.deduplicated(spark.createDataFrame([(1, x[:64]), (2, y[:64]), (3, x[:64] + y[:64])], "doc_id long, text string")).collect()
    want = brute_removed([(1, x[:64]), (2, y[:64]), (3, x[:64] + y[:64])])
    assert {r["doc_id"]: r["n_removed"] for r in kept} == want


def brute_removed(rows):
    first, gone = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = t.encode()
        gone[i] = len({p for k in range(len(b) - 49) if first[b[k : k + 50]] < i for p in range(k, k + 50)})
    return gone


@pytest.fixture(scope="module")
def labels_of_none(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("period", sorted(suffix_dedup.COVERS))
def test_cover_has_every_difference(period):
    cover = suffix_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("period", [7, 13, 21, 31])
def test_suffix_dedup_by_any_cover_id_type_and_block(spark, period, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "SORT_ROWS", 300)
    rng = random.Random(period)
    base = text(rng, 300)
    rows = []
    for i in range(60):
        a = rng.randint(0, 1500)
        rows.append((i, base[a : a + rng.randint(20, 300)] + rng.choice(["", "!", " und so"]) + base[300 : 300 + rng.randint(0, 90)]))
    docs = spark.createDataFrame([(f"{i:03d}", t, 1) for i, t in rows], "key string, body string, spans int")
    got = suffix_dedup.deduplicated(docs, id_col="key", text_col="body", period=period).collect()
    assert {int(r["key"]): r["n_removed"] for r in got} == brute_removed(rows)
    with pytest.raises(ValueError):
        suffix_dedup.deduplicated(docs, length=20)


def test_suffix_dedup_with_more_blocks_than_buckets(spark, monkeypatch):
    """Blocks are cut by bytes where the id changes, in any number; a bucket of the table then holds several."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SORT_ROWS", 50)
    rng = random.Random(4)
    base = text(rng, 200)
    rows = [(i, base[(a := rng.randint(0, 900)) : a + rng.randint(0, 200)]) for i in range(150)]
    rows += [(7, base[100:300]), (7, base[150:400]), (160, ""), (160, None), (161, "x" * 3000), (162, "x" * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first, want = {}, Counter()
    encoded = [(i, (t or "").encode()) for i, t in rows]
    for i, t in encoded:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    for i, t in encoded:
        gone = {p for k in range(len(t) - 49) if first[t[k : k + 50]] < i for p in range(k, k + 50)}
        want[(i, len(gone))] += 1
    limit = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        got = suffix_dedup.deduplicated(docs).collect()
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", limit)
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == want
    cut = suffix_dedup._blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).toDF("id", "t").repartitionByRange(2, "id").sortWithinPartitions("id"), 500)
    sizes = cut.groupBy("block").agg(F.sum(F.octet_length("t") + suffix_dedup.ROW_BYTES).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("block").collect()
    assert len(sizes) > 20 and all(x["high"] < y["low"] for x, y in zip(sizes, sizes[1:], strict=False))
    assert all(r["n"] <= 500 + 3064 for r in sizes)


def slow_vector(t, idf):
    """TF-IDF of hashed byte 2- and 3-grams, from the rule."""
    low = bytearray(b" ")
    for c in t:
        if c.isascii():
            low += (c.lower() if c.isalpha() else " ").encode()
        else:
            low += (c.lower() if "À" <= c <= "Þ" and c != "×" else c).encode()
    low += b" "
    n = Counter()
    for size in (2, 3):
        for k in range(len(low) - size + 1):
            g = bytes(low[k : k + size])
            if g.strip(b" "):
                n[((int.from_bytes(g, "big") + size) * 0x9E3779B97F4A7C15 % 2**64) >> 52] += 1
    v = np.zeros(language.DIMENSIONS)
    for d, c in n.items():
        v[d] = math.log(1 + c) * idf[d]
    return v / (np.sqrt((v * v).sum()) or 1)


def test_language_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    model = language.trained(docs, sample=40)
    again = language.trained(docs.repartition(5), sample=40)
    assert model.languages == again.languages and (model.centroids == again.centroids).all()
    train = docs.where(~language.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    seen = np.zeros(language.DIMENSIONS)
    for r in train:
        seen += slow_vector(r["text"], np.ones(language.DIMENSIONS)) > 0
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + seen)) + 1)
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    for r in docs.where("text is not null").limit(60).collect():
        cosine = model.centroids @ slow_vector(r["text"], model.idf)
        mine = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"]):
            assert mine["language"] == "und"
            continue
        assert math.isclose(mine["score"], min(1, max(0, cosine.max())), abs_tol=1e-6)
        assert mine["language"] in {model.languages[k] for k in np.flatnonzero(cosine > cosine.max() - 1e-9)}


def test_language_of_short_many_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.trained(docs, sample=40)
    rows = [(1, "a", 9, "x"), (1, "a", 9, "x"), (2, "x", 9, "x"), (3, "é", 9, "x"), (4, "漢", 9, "x"), (5, "...", 9, "x"), (None, "und das ist gut", 9, "x"), (6, "퟿", 9, "x")]
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string, score int, language string"), model).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["language"] == "und"} == {5, 6}
    assert len({(r["language"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    import pyarrow as pa

    assert max(j - i for i, j, _ in language.vectors(pa.array(["ab cd ef"] * 5000))) <= language.ROWS
    many = spark.range(2000).selectExpr("id as doc_id", "'a b' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError):
        language.trained(many)


def test_an_added_token_with_a_space_is_counted_whole():
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    facts = json.loads(Path(tokenizer_path(BYTE_BPE_JSON)).read_text())
    assert tokens.ends_before_white_space(facts)
    facts["added_tokens"].append({"id": 60000, "content": "so long", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    assert not tokens.ends_before_white_space(facts)
    tok = Tokenizer.from_str(json.dumps(facts))
    texts = ["well so long then", "so  long", "so long so long"]
    assert tokens.counter(".json", json.dumps(facts).encode())(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        assert not tokens.ends_before_white_space(json.loads(Path(tokenizer_path(BYTE_BPE_JSON)).read_text()) | change)


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    from pathlib import Path

    vocabulary = Path(tokenizer_path(BYTE_BPE_JSON)).read_bytes()
    rng = random.Random(2)
    texts = ["漢字" * rng.randint(1, 400) + text(rng, 40) for _ in range(60)]
    want = tokens.counter(".json", vocabulary)(texts)
    monkeypatch.setattr(tokens, "MEMO_BYTES", 500)
    of = tokens.counter(".json", vocabulary)
    assert [n for k in range(0, 60, 7) for n in of(texts[k : k + 7])] == want


def test_warm_cache_encodes_only_what_is_missing(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path(BYTE_BPE_JSON), str(tmp_path / "cache")
    rng = random.Random(6)
    rows = [(i, text(rng, 20)) for i in range(200)] + [(i, "the same again") for i in range(200, 600)] + [(None, None), (None, ""), (7, "the same again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = tokens.tokenizer_digest(path)
    tokens.count_tokens(docs.where("doc_id % 2 = 0"), path, cache).count()
    first = tokens.stored(spark, cache, digest).count()
    assert first == 101  # a hundred texts of their own and the one that many share
    seen = []
    encoded = tokens.encoded
    monkeypatch.setattr(tokens, "encoded", lambda df, *a, **k: (seen.append(df.count()), encoded(df, *a, **k))[1])
    got = tokens.count_tokens(docs, path, cache)
    cold = tokens.count_tokens(docs, path, str(tmp_path / "cold"))
    assert sum(seen[:1]) == 101 and tokens.stored(spark, cache, digest).count() == 202  # the other hundred and the empty text
    assert sorted(map(str, got.collect())) == sorted(map(str, cold.collect())) and got.count() == len(rows)
    clash = docs.withColumns({"N_Tokens": F.lit("x"), "n_bytes": F.lit(1), "content": F.lit("c"), "n": F.lit(0)})
    assert tokens.count_tokens(clash, path, cache).count() == len(rows)
    assert tokens.encoded(clash, path).columns == ["doc_id", "n_bytes", "content", "n", "n_tokens"]


def test_trie_of_one_crowded_prefix(spark, monkeypatch):
    """All fingerprints share their first 40 bits: pairs go down until they are of bounded size."""
    monkeypatch.setattr(near_dup, "MOST_IN_PAIR", 200)
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 24, 3000, dtype=np.uint64) | np.uint64(0xABCDE12345 << 24))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fingerprint long")
    sizes = []
    for level, pairs in near_dup.node_pairs(df, 3, near_dup.Scratch(spark, "t")):
        top = fps >> np.uint64(64 - level)
        n = Counter(top.tolist())
        sizes += [n[r["a"]] + (n[r["b"]] if r["a"] != r["b"] else 0) for r in pairs.collect()]
    assert max(sizes) <= 200 and min(sizes) > 0
    got = {r["node"]: r["root"] for r in near_dup.components(near_dup.links(df)).collect()}
    forest = near_dup.Forest(len(fps))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    forest.link(i, j)
    signed = fps.view(np.int64).tolist()
    least = {}
    for k, r in enumerate(forest.label.tolist()):
        least[r] = min(least.get(r, 2**63), signed[k])
    assert {s: got.get(s, s) for s in signed} == {s: least[r] for s, r in zip(signed, forest.label.tolist(), strict=True)}


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64) * np.uint64(2**50 + 1)) for n in (0, 1, 50, 3000, 4000, 4001)]
    want = [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets[:4]]
    assert near_dup._overlaps(sets[:4], sets[1:]).tolist() == want


@pytest.mark.parametrize("rows", [512, 7])
def test_similar_texts_without_their_original(spark, rows, monkeypatch):
    """Edited copies of a text that is not there: few are similar to one another, and no link is lost."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", rows)
    rng = random.Random(12)
    base = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(160)]
    texts = []
    for _ in range(70):
        w = list(base)
        for k in rng.sample(range(160), rng.choice([1, 2, 3, 4])):
            w[k] = f"edit{rng.random()}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    sets = [near_dup.shingles(t, 5) for t in texts]
    forest = near_dup.Forest(len(texts))
    linked = [(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    forest.link(*(np.array(x) for x in zip(*linked, strict=True)))
    assert 1 < len(set(forest.label.tolist())) < len(texts)
    assert got == dict(enumerate(forest.label.tolist()))
