"""Token counts through a digest cache.

A count is stored under two digests: that of the normalised content and that of the
tokenizer's version (library, its version, vocabulary file).  Counting joins the contents'
digests to the stored counts, encodes each distinct missing content once, appends those
counts to the cache and joins again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import evened
from ._common import Scratch, bit_filter, in_filter, skew_join, text_or_empty

LIBRARY = {".json": "tokenizers", ".tiktoken": "tiktoken", ".model": "sentencepiece"}
#: Bytes of pieces whose counts a task remembers before it starts anew, and characters of the longest such piece.
MEMO_BYTES, MEMO_PIECE = 32 << 20, 64
#: What a remembered piece takes beside its own bytes.
_ENTRY_BYTES = 150
#: Bits of the filter that tells texts encoded in place from those that are joined first.
FILTER_BITS = 1 << 24
#: Before white space that follows a visible character below U+1680 every byte-level
#: pattern ends a token, so the pieces between such places can be counted apart.
_CUT = "(?<=[!-~\xa1-ᙿ])(?=[ \t-\r])"


def tokenizer_digest(path: str) -> str:
    """Digest of the library, its version and the vocabulary file."""
    library = LIBRARY[Path(path).suffix]
    return hashlib.sha256(f"{library} {version(library)}\n".encode() + Path(path).read_bytes()).hexdigest()


def ends_before_white_space(facts: dict) -> bool:
    """Whether the tokenizer ends a token before white space that follows a visible character, whatever surrounds it.

    So it is for byte-level pre-tokenizing by the usual pattern without a normalizer, unless
    an added token holds white space or takes in its neighbours.
    """
    split = facts.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    reach = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in facts.get("added_tokens") or ())
    return plain and not facts.get("normalizer") and not reach


def counter(suffix: str, vocabulary: bytes, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; no added tokens, whole texts."""
    if suffix == ".json":
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(vocabulary.decode())
        tok.no_truncation()
        tok.no_padding()
        encode = lambda texts: list(map(len, tok.encode_batch_fast(texts, add_special_tokens=False)))
        if not ends_before_white_space(json.loads(vocabulary)):
            return encode
        cut, memo, held = re.compile(_CUT), {}, 0

        def by_piece(texts: list[str]) -> list[int]:
            nonlocal held
            parts = [cut.split(t) for t in texts]
            if held > MEMO_BYTES:
                memo.clear()
                held = 0
            new = list({p for ps in parts for p in ps if len(p) <= MEMO_PIECE and p not in memo})
            memo.update(zip(new, encode(new), strict=True))
            held += sum(map(len, new)) + _ENTRY_BYTES * len(new)
            long = [p for ps in parts for p in ps if len(p) > MEMO_PIECE]
            rest = iter(encode(long) if long else ())
            return [sum(memo[p] if len(p) <= MEMO_PIECE else next(rest) for p in ps) for ps in parts]

        return by_piece
    if suffix == ".tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        tok = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(tok.encode_ordinary(t)) for t in texts]
    import sentencepiece

    tok = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
    return lambda texts: [len(x) for x in tok.encode(texts, num_threads=1)]


def encoded(texts: DataFrame, path: str, *, text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """``texts`` without ``text_col``, with ``n_tokens`` of it; the vocabulary travels with the job.

    Null text counts as empty.  An ``n_tokens`` column that was there is replaced.  Repeated rows
    are encoded each; an empty table gives an empty result.
    """
    vocabulary = texts.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    suffix = Path(path).suffix
    others = [c for c in texts.columns if c != text_col and c.lower() != "n_tokens"]
    kept = [texts.columns.index(c) for c in others]
    place = texts.columns.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of = None
        gc.disable()  # millions of live strings and no cycles
        try:
            for b in batches:
                of = of or counter(suffix, vocabulary.value, pattern)
                column, n = b.column(place), []
                for k in range(0, b.num_rows, 256):
                    n += of([x or "" for x in column.slice(k, 256).to_pylist()])
                yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(n, pa.int64())], [*others, "n_tokens"])
        finally:
            gc.enable()

    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in others)
    return texts.mapInArrow(count, f"{kinds}n_tokens long")


def stored(spark: SparkSession, cache_dir: str, tokenizer: str) -> DataFrame | None:
    """``content``, ``n_tokens`` stored for that tokenizer digest, one row per content."""
    path = f"{cache_dir}/tokenizer={tokenizer}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("content binary, n_tokens long").parquet(path)


def count_tokens(docs: DataFrame, path: str, cache_dir: str, *, id_col: str = "doc_id", text_col: str = "text", normalised: Column | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    ``normalised``: the content that is counted, an expression over ``docs`` that must not
    change the count (the text itself, null as empty, by default).  Repeated rows and equal
    texts are encoded once, and so is nothing that ``cache_dir`` holds.  Missing counts are
    appended to it by one writer at a time; should two have written the same content, the
    reader takes one of the equal counts.  Null ids are ids like others.  Empty tables give an
    empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    tokenizer = tokenizer_digest(path)
    content = text_or_empty(text_col) if normalised is None else normalised
    source = docs.select(F.col(id_col), content.alias("t"))
    dealt = evened(source, probe=docs)
    if dealt is not source:  # texts are digested and encoded where they are read
        source = scratch.written(dealt, "dealt")
    keyed = source.select(id_col, F.octet_length("t").cast("long").alias("n_bytes"), F.unhex(F.sha2("t", 256)).alias("content"))
    known = stored(spark, cache_dir, tokenizer)
    wanted = keyed.groupBy("content").agg(F.count("*").alias("n"))
    wanted = scratch.written(wanted.withColumn("place", F.xxhash64("content")), "wanted")
    texts = source.select(F.unhex(F.sha2("t", 256)).alias("content"), "t")
    missing = wanted if known is None else scratch.written(wanted.join(known.select("content").distinct(), "content", "left_anti"), "missing")
    if not missing.isEmpty():
        # texts that are missing for sure are encoded where they are; those that may be there, or occur more than once, are joined
        unsure = missing.where("n > 1") if known is None else missing
        bits = bit_filter(unsure, "place", FILTER_BITS)
        shared = spark.sparkContext.broadcast(bits)

        def marked(want: bool) -> DataFrame:
            def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(in_filter(shared.value, b.column(2).to_numpy()) == want))

            placed = texts.withColumn("place", F.xxhash64("content"))
            return placed.mapInArrow(some, "content binary, t string, place long").drop("place")

        joined = marked(True).join(missing.select("content"), "content", "left_semi") if known is not None else marked(True)
        chosen = joined.dropDuplicates(["content"])
        for part in [chosen] if known is not None else [chosen, marked(False)]:
            encoded(part, path, text_col="t", pattern=pattern).write.mode("append").parquet(f"{cache_dir}/tokenizer={tokenizer}")
        known = stored(spark, cache_dir, tokenizer)
    if known is None:  # there are no rows
        return keyed.select(id_col, "n_bytes", F.lit(None).cast("long").alias("n_tokens"))
    one = known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")) if _many_writers(known) else known
    return skew_join(keyed, one, "content", wanted).select(id_col, "n_bytes", "n_tokens")


def _many_writers(known: DataFrame) -> bool:
    """Whether some content is stored more than once."""
    return not known.groupBy("content").count().where("count > 1").isEmpty()
