"""Token counts through a digest cache.

The cache is a table in a folder: a count for each pair of a tokenizer's digest and a content digest. A run hashes the normalised
texts, joins the distinct digests to the stored counts, encodes one text of each digest that is missing, appends those counts and
then reads every document's count from the cache. Texts travel only where their digest is missing; equal ones are brought together
before the shuffle. Counts of a digest are the same whoever writes them, so a job that is run twice or at the same time as another
may store a digest twice, which reading evens out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.session import BROADCAST_ROWS, join_hot, settle

#: Words whose counts a worker remembers, about; characters of text that it counts at a time.
WORDS, PIECE = 1 << 20, 1 << 22
ASCII_SPACE, UPPER, LOWER = r"[\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=4)
def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer: its file, the library that runs it and that library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__} ".encode() + f.read()).hexdigest()


@functools.lru_cache(maxsize=4)
def _traits(path: str) -> tuple[bool, bool, tuple[str, ...]]:
    """Whether a tokenizer lowers letters, whether it makes one space of white space and drops it between words, its added tokens."""
    if path.endswith(".model"):
        return False, False, ()
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    listed = lambda x, inner: [] if not x else x[inner] if x["type"] == "Sequence" else [x]
    steps, cuts = listed(j.get("normalizer"), "normalizers"), listed(j.get("pre_tokenizer"), "pretokenizers")
    lowers = any(s["type"] == "Lowercase" for s in steps)
    one_space = any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    # words without white space are kept, what is between them goes
    drops = any(c["type"] == "Split" and c["behavior"] == "Removed" and c["invert"] and r"[^\s\p{L}\p{N}]+" in c["pattern"].get("Regex", "") for c in cuts)
    added = tuple(t["content"] for t in j.get("added_tokens", []))
    plain = not any(re.search(r"\s", t) for t in added)
    return lowers, one_space and drops and plain, added


def normalised(text: Column, path: str) -> Column:
    """The text without differences that the tokenizer does not see: case of A-Z where it lowers letters, runs of ASCII white space
    where it makes one space of them. Texts that hold an added token, in whatever case, stay as they are, as such tokens are looked
    for before. Null counts as empty."""
    lowers, spaces, added = _traits(path)
    own = F.coalesce(text, F.lit(""))
    low = F.translate(own, UPPER, LOWER)
    same = low if lowers else own
    same = F.regexp_replace(same, ASCII_SPACE, " ") if spaces else same
    if added and (lowers or spaces):
        special = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.translate(str.maketrans(UPPER, LOWER)))) for t in added])
        same = F.when(special, own).otherwise(same)
    return same


@functools.lru_cache(maxsize=2)
def _counter(path: str):  # noqa: ANN202
    """Function from texts to their numbers of tokens, made once in each worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    encode = lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    if not _traits(path)[1]:
        return encode
    seen: dict[bytes, int] = {}

    def count(texts: list[str]) -> list[int]:
        # no token reaches across white space: the library sees each stretch between it once
        split = [t.encode().split() for t in texts]
        if len(seen) > WORDS:
            seen.clear()
        new = list({w for words in split for w in words} - seen.keys())
        for k in range(0, len(new), 1_024):
            seen.update(zip(some := new[k : k + 1_024], encode([w.decode() for w in some])))
        return [sum(map(seen.__getitem__, words)) for words in split]

    return count


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version, each digest once. A cache that is not there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema("digest binary, n_tokens long").parquet(path.toString()).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2_048) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row, through the cache in the folder `cache`.

    Null and empty texts have no bytes and no tokens; rows that are equal, or whose ids are, are rows like others; an empty table
    gives an empty result; no other column is read, so their names can't clash; very long texts are counted whole.
    """
    spark, path = docs.sparkSession, path or default_path()
    version = tokenizer_version(path)
    content = F.unhex(F.sha2(normalised(F.col(text_col), path), 256))
    slim = settle(docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), content.alias("_content")), "token-digests")
    known = read_cache(spark, cache, version)
    missing = settle(slim.select(F.col("_content").alias("digest")).distinct().join(known.select("digest"), "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        texts = docs.select(content.alias("digest"), F.col(text_col).alias("text"))
        if n <= BROADCAST_ROWS:  # few new texts: the others do not travel
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n > BROADCAST_ROWS:
            texts = texts.join(missing, "digest", "left_semi")

        def encode(batches):  # noqa: ANN001, ANN202
            count = _counter(path)
            for b in batches:
                sizes = np.cumsum(pc.coalesce(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(b):
                    to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE)))
                    some = b.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(count([t or "" for t in some.column(1).to_pylist()]), pa.int64())], ["digest", "n_tokens"])
                    at = to

        texts.mapInArrow(encode, "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/version={version}")
    counts = read_cache(spark, cache, version)
    out = join_hot(slim, counts, "_content", "digest")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
