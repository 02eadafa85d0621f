"""Token counts, whitening and ranking: against plain versions, and on odd tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlay_jobs.llm import ranking, token_counts, whitening
from overlay_jobs.session import new_path

DOCS = "doc_id long, text string, digest string, n string, _content string, terms string, x int, _row int, score string"
ODD = ["", None, "a", " \t\n ", "İstanbul ΑΣ ΟΔΟΣ. It's", "é É x y z\x0bq\x1cr\x85s", "<|endoftext|>Hello<|ENDOFTEXT|> A <|startoftext|>b", "MIXED case  Text\n\nhere", "mixed CASE text here", "don't WON'T I'LL 12 3.5", "日本語 テキスト 𝔘𝔫𝔦", "ab" * 40_000, "Word " * 60_000, "ǅ ß ﬁ ﻿ x"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "d", "n", "c", "t", 1, 2, "s") for i, t in rows], DOCS)


def salad(rng, n, words=300):
    return " ".join(f"{rng.choice('bcdfgh')}{rng.randrange(words)}{rng.choice('aeiou')}" for _ in range(n))


# token counts
def plain_counts(texts, path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts(spark):
    rng = random.Random(3)
    texts = ODD + [salad(rng, rng.randrange(1, 3_000)) for _ in range(30)] + ["same text"] * 40
    rows = [*enumerate(texts), (None, "no id"), (3, "same id")]
    cache = new_path(spark, "cache")
    got = token_counts.count_tokens(docs(spark, rows), cache).collect()
    want = plain_counts([t for _, t in rows], token_counts.default_path())
    plain = sorted((str(i), len((t or "").encode()), n, n > 2_048) for (i, t), n in zip(rows, want))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == plain
    assert any(r["over_limit"] for r in got)


def test_token_cache_is_used_and_grows(spark):
    cache = new_path(spark, "cache")
    version = token_counts.tokenizer_version(token_counts.default_path())
    stored = lambda: spark.read.parquet(f"{cache}/version={version}")
    token_counts.count_tokens(docs(spark, [(1, "One  Text"), (2, "one text"), (3, "another")]), cache).collect()
    assert stored().count() == 2  # equal after normalising
    token_counts.count_tokens(docs(spark, [(1, "ONE text"), (2, "third")]), cache).collect()
    assert stored().count() == 3  # only the miss was added
    stored().withColumn("n_tokens", F.lit(77).cast("long")).write.mode("append").parquet(f"{cache}/version={version}")  # digests twice
    got = token_counts.count_tokens(docs(spark, [(1, "one text"), (2, "fourth"), (3, "ANOTHER")]), cache).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 77, 2: plain_counts(["fourth"], token_counts.default_path())[0], 3: 77}


@pytest.mark.parametrize("few", [0, 100_000])
def test_token_counts_of_other_tokenizers(spark, monkeypatch, few):
    """Byte-level and sentencepiece files, where nothing may be normalised; misses by broadcast or not; one text a third of the rows."""
    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", few)
    texts = [*ODD[:11], *["hot text"] * 8]
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, want in (("byte_bpe_50k.json", plain_counts(texts, public_tokenizers.path("byte_bpe_50k.json"))), ("piece_bpe_32k.model", [len(own.encode(t or "")) for t in texts])):
        got = token_counts.count_tokens(docs(spark, list(enumerate(texts))), new_path(spark, "cache"), path=public_tokenizers.path(name)).collect()
        assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["doc_id"])] == want


# whitening
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, whitened double")


def plain_whitening(rows, count=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (dim - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    free = np.array(fit, float) - np.array(sums) / n
    e, axes = np.linalg.eigh(free.T @ free / n)
    e, axes = e[::-1][:count], axes[:, ::-1][:, :count]
    return kept, n, sums, e, axes, np.trace(free.T @ free / n)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=9) * np.arange(1, 10) / 20).tolist()) for i in range(300)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (400, [0.1, 0.2]), (401, None), (402, [float("nan")] * 9), (403, [0.0, None] * 4), (404, [float("inf")] * 9), (405, [])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    kept, n, sums, e, axes, trace = plain_whitening(rows)
    assert len(got) == 4 * len(kept)
    by_id = collections.defaultdict(list)
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        by_id[r["vec_id"], r["component"]].append(r)
    for k in range(4):
        want = {i: (np.array(v) - np.array(sums) / n) @ axes[:, k] / np.sqrt(e[k]) for i, v in kept}
        one = 1 if by_id[10, k + 1][0]["whitened"] * want[10] > 0 else -1
        for i, v in kept:
            for r in by_id[i, k + 1]:
                assert math.isclose(r["whitened"], one * want[i], rel_tol=1e-7, abs_tol=1e-9) or i in (1, None)
                assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums)) or i in (1, None)
                assert math.isclose(r["explained"], e[k] / trace, rel_tol=1e-9)


def test_whitening_of_equal_and_missing_variances(spark):
    cross = [(i, [0.5 * s if d == i // 2 else 0.0 for d in range(3)]) for i, s in enumerate([1, -1] * 3)]  # three equal roots
    got = whitening.whiten(vectors(spark, cross)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and all(abs(r["explained"] - 1 / 3) < 1e-12 and r["identity_error"] < 1e-9 for r in got)
    line = [(i, [i / 8, i / 4]) for i in range(5)] + [(9, [0.5, 1.0])] * 50  # one direction, one vector in most rows
    got = whitening.whiten(vectors(spark, line)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and {r["n"] for r in got} == {5}
    got = whitening.whiten(vectors(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, 0.0)] * 2
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    far = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [1.0, 3e15]), (3, [-2.0, 7.0])])).collect()  # beyond doubles' whole numbers
    assert len(far) == 6 and all(r["identity_error"] < 1e-4 for r in far)


def test_exact_polynomial(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (7, 7)).astype(object)
    for m in (a @ a.T, (a @ a.T) * 10**25, np.diag([4, 4, 4, 1, 0, 0, 9]).astype(object), np.zeros((3, 3), object)):
        got = whitening.characteristic_polynomial(spark, m)
        d = len(m)
        c, power, want = [1], np.zeros((d, d), object), []  # by traces: k c_k = -tr(m (m_k + c_(k-1)))
        for k in range(1, d + 1):
            power = m @ (power + c[-1] * np.eye(d, dtype=int).astype(object))
            c.append(-int(np.trace(power)) // k)
        want = c[::-1]
        assert got == want
    roots, scale = whitening.largest_roots(whitening.characteristic_polynomial(spark, np.diag([4, 4, 4, 1, 0, 0, 9]).astype(object)), 5)
    assert [r >> scale for r in roots] == [9, 4, 4, 4, 1]
    near = np.diag([10**12, 10**12 + 1, 5]).astype(object)  # a gap of 10^-12
    roots, scale = whitening.largest_roots(whitening.characteristic_polynomial(spark, near), 2)
    assert [abs(whitening.null_vectors(near, r, scale, 1)[0]).round(12).tolist() for r in roots] == [[0, 1, 0], [1, 0, 0]]


# ranking
def plain_rank(rows, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(cut(t))) for i, t in rows]
    own = [(i, c) for i, c in own if c]
    total, length = len(own), sum(c.total() for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 100 - 90 + (90 * c.total() * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i, s))
        out += [(item, n + 1, i, s) for n, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranking(spark, monkeypatch, small):
    if small:  # several blocks of items, shards, pivots and blocks of postings, bounds from few rows
        for name, value in {"ITEMS": 4, "TERMS": 60, "SHARD": 16, "BLOCK": 4, "SAMPLE_ROWS": 20, "PIVOTS": 3, "GROUPS": 4}.items():
            monkeypatch.setattr(ranking, name, value)
    rng = random.Random(11)
    rows = [(i, salad(rng, rng.randrange(1, 200), 60)) for i in range(250)]
    rows += [(300 + i, "Hot COPY of b1a text") for i in range(150)] + [(None, "b2a b3e"), (7, "b2a b3e"), (900, ""), (901, None), (902, "?!"), (903, "Ünïcode ÄÖ b5a" + " w" * 50_000)]
    items = [(n, salad(rng, rng.randrange(1, 40), 60)) for n in range(12)] + [(50, None), (51, ""), (52, "zzz unknown"), (53, "hot copy B1A hot"), (None, "ünïcode Äö"), (3, "b2a b3e")]
    got = ranking.rank(docs(spark, rows), spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, _item string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_rank(rows, items)))
    none = docs(spark, [])
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranking.rank(none, asked).count() == 0 and ranking.rank(docs(spark, rows), asked.limit(0)).count() == 0


def test_blocks_are_skipped():
    """Documents of a few topics: most blocks stay closed, and the best are the same."""
    rng = np.random.default_rng(2)
    topics = [rng.choice(400, 40, replace=False) for _ in range(12)]
    own = [np.sort(rng.choice(topics[i % 12], 20, replace=False)) for i in range(600)]
    ends, terms = np.append(0, np.cumsum([len(t) for t in own])), np.concatenate(own).astype(np.int64)
    shard = ranking._Shard(terms, ends, rng.integers(1, 4, len(terms)), np.full(600, 40), 600, 24_000)
    weight = rng.integers(500, 5_000, 400)
    shard.cluster(weight)
    seen = collections.Counter()
    for item in range(24):
        at = np.flatnonzero(np.isin(shard.terms, topics[item % 12][:12]))
        w = weight[shard.terms[at]]
        every = shard.dense[:, at].astype(np.int64) @ w
        least = int(np.sort(every)[-10])
        rows, scores = shard.best(at, w, 0, 10, seen)
        assert set(rows.tolist()) == set(np.flatnonzero(every >= least).tolist()) and (every[rows] == scores).all()
    assert seen["opened"] < seen["blocks"] / 2
