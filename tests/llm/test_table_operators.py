"""Mixing, top-k, repeats, archives, near-duplicates, the pipeline: against plain versions, and on odd tables."""

import base64
import collections
import hashlib
import itertools
import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from overlay_jobs.functions.graph import connected_components
from overlay_jobs.llm import minhash, mixing, queries, repeats, topk, warc
from overlay_jobs.session import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, rounds int"


def docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None, "clash", 1) for i, t, s in rows], DOCS)


def word_salad(rng, n, words=400):
    return " ".join(f"{rng.choice('bcdfgh')}{rng.randrange(words)}{rng.choice('aeiou')}" for _ in range(n))


# mixing
def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = sum(w[s] for s in free)
        level = (total - sum(fixed.values())) / share if share else 0
        over = [s for s in free if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **{s: w[s] * level for s in free}}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 300)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(1000, None, "a"), (1001, "", "e"), (None, "x y", "b"), (7, "x y z", "b")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, largest = plain_targets(sizes), collections.Counter(), collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    rows_taken = mixing.take(docs(spark, rows))
    assert rows_taken.columns == docs(spark, []).columns
    assert rows_taken.count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.take(docs(spark, [])).count() == 0


def test_mixing_refines_digit_by_digit(spark, monkeypatch):
    """Digits of two bits: many rounds of refining one cell."""
    monkeypatch.setattr(mixing, "BITS", 2)
    monkeypatch.setattr(mixing, "DIGITS", 30)
    rng = random.Random(17)
    rows = [(n, " ".join("w" for _ in range(rng.randrange(1, 40))), "abc"[n % 3]) for n in range(300)]
    out = mixing.mix(docs(spark, rows)).collect()
    for s in "abc":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6


def test_mixing_of_null_and_repeated_rows(spark):
    """Rows without ids or with one id are placed each for itself, and equal rows are taken one by one."""
    rng = random.Random(3)
    rows = [(None, " ".join("w" for _ in range(rng.randrange(1, 10))) + f" u{n}", "ab"[n % 2]) for n in range(200)]
    rows += [(5, "one text of five words", "ab"[n % 2]) for n in range(120)] + [(6, None, "a"), (6, "", "b")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    equal = [(1, "a b c d", "a")] * 50 + [(2, "a b c d", "b")] * 50
    frame = docs(spark, equal).repartition(4)
    got = mixing.mix(frame).collect()
    assert sum(r["taken"] for r in got if r["source"] == "a") in (284, 288) and sum(r["taken"] for r in got if r["source"] == "b") in (112, 116)
    assert mixing.take(frame).count() == sum(r["copies"] for r in got)


# top-k
def test_top_k(spark):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(12)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(700)] + [(50, None), (1001, [0.1, float("nan")]), (1002, [None, 1.0]), (None, vec()), (1003, []), (1004, vec()[:5]), (1005, vec()), (1005, vec()), (1006, [float("inf")])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, pivot int")
    fine = [(r["vec_id"], [math.floor(256 * c) for c in r["embedding"]]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = {i: v for i, v in fine if i % 50 == 0}
    assert set(got) == set(asked)
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in fine if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(twice, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 0, 131072), (0, 1, 0, 131072), (0, 2, 1, 32768), (0, 2, 1, 65536)]
    lone = spark.createDataFrame([(0, [1e306, 1.0])], "vec_id long, embedding array<double>")  # 256e306 is no double
    assert topk.top_k(lone, F.lit(True)).count() == 0


@pytest.mark.parametrize("outlier", [4e5, 1e30, 1e200, 7e305])
def test_top_k_with_a_few_large_vectors(spark, outlier):
    """Large vectors among ordinary ones, as queries and as candidates, repeated ids included."""
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)] + [(50, [outlier] * 6), (301, [-outlier] * 6), (302, [outlier, 0.5, 0.0, 0.0, 0.0, 0.0]), (100, [0.25] * 6), (350, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, row long")
    fine = [(i, [math.floor(256 * c) if abs(c) < 1e300 else int(256 * c) for c in v]) for i, v in rows]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for m, (i, c) in enumerate(fine) if m != n)[:5]
            want += [(q, r + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


@pytest.mark.parametrize("size", [4e5, 1e7, 1e30])
def test_top_k_of_large_components(spark, size):
    """Products beyond 2^53 and beyond a long are ranked by their whole values."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(150)] + [(200, [size] * 6), (201, [size] * 6), (250, [-size] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = [(r["vec_id"], [math.floor(256 * c) for c in r["embedding"]]) for r in df.collect()]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, v in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in fine if i != q)[:5]
            assert sorted(got[q]) == [(n + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(best)]


# repeated strings
def plain_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return out


def test_copies_are_gathered_once(spark, monkeypatch):
    """Many copies of a text that shares a passage with another: what is gathered for it is bounded by its own anchors."""
    rng, places = random.Random(31), []
    text, other = word_salad(rng, 300), word_salad(rng, 300)
    other = other[:500] + text[300:900] + other[900:]
    texts = [text] * 40 + [other]
    settle = repeats.settle

    def watched(df, name):
        out = settle(df, name)
        if name == "repeats-places":
            places.append(out)
        return out

    monkeypatch.setattr(repeats, "settle", watched)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs(spark, [(n, t, "s") for n, t in enumerate(texts)])).collect())
    assert got == collections.Counter((n, *x) for n, x in enumerate(plain_repeats(texts)))
    own = [[s["at"] for s in r["spots"]] for r in places[0].collect()]
    assert own and all(len(x) == len(set(x)) for x in own)


def test_repeats(spark):
    rng = random.Random(12)
    passages = [word_salad(rng, 150) for _ in range(3)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "d" * 2000, "ab" * 500, "é" * 500, "é" * 500]
    for n in range(60):
        p = rng.choice(passages)
        a = rng.randrange(len(p) - 450)
        texts.append(word_salad(rng, rng.randrange(100)) + p[a : a + rng.randrange(300, 1200)] + word_salad(rng, rng.randrange(100)))
        if n % 6 == 0:
            texts.append(texts[-1])
            k = rng.randrange(len(texts[-1]))
            texts.append(texts[-1][:k] + "Z" + texts[-1][k + 1 :])
    ids = [n // 2 for n in range(len(texts))]  # ids repeat
    rows = docs(spark, [(i, t, "s") for i, t in zip(ids, texts)])
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(rows).collect())
    assert got == collections.Counter((i, *x) for i, x in zip(ids, plain_repeats(texts)))
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_of_other_lengths_with_what_stays(spark, tmp_path):
    """Spans and bytes for any length; the query has the text that stays, not only figures of it."""
    rng = random.Random(51)
    planted = " ".join(f"ö{rng.randrange(1000)}" for _ in range(60))  # 60 words, under 400 bytes
    texts = [None, "é" * 150, *(word_salad(rng, 80) for _ in range(5))]
    texts += [f"{word_salad(rng, 90)} {planted} {word_salad(rng, 90)}" for _ in range(3)] + [word_salad(rng, 40) + "ø" + texts[2] + "é", word_salad(rng, 40) + "ù" + texts[2] + "à"]
    assert len(planted.encode()) < 400 < len(texts[2])
    rows = docs(spark, [(n, t, "s") for n, t in enumerate(texts)])
    for length in (16, 250, 400, 407):
        got = {r["doc_id"]: r for r in repeats.remove_repeats(rows, length=length).collect()}
        for n, (t, x) in enumerate(zip(texts, plain_repeats(texts, length))):
            raw, spans = (t or "").encode(), [(s["start"], s["end"]) for s in got[n]["spans"]]
            assert tuple(got[n][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == x
            assert len(spans) == x[2] and sum(b - a for a, b in spans) == x[1]
            left = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
            assert bytes(got[n]["kept"]) == left and hashlib.sha256(left).hexdigest() == x[3]
        assert all((planted.encode() in bytes(got[n]["kept"])) == (length >= 400) for n in (7, 8, 9))
    with pytest.raises(ValueError):
        repeats.remove_repeats(rows, length=15)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.op3_repeats(spark, str(tmp_path)).collect()}
    assert [got[n] for n in range(10)] == ["", "é" * 150, "", *texts[3:10]]  # 2 stands again in 10 and 11
    assert [got[n] for n in (10, 11)] == [texts[n][: -1 - len(texts[2])] + "\ufffd" for n in (10, 11)]  # half of é and à is a repeat


# archives
def test_archives(spark):
    rng = random.Random(8)
    rows = [(n, f"http://x/{n}\r\nWARC-Type: fake", rng.choice(["<p>same</p>", "", None, "x" * 700_000, f"<p>{n} é</p>"])) for n in range(60)] + [(59, "again", "<p>same</p>"), (None, None, "<p>same</p>"), (None, None, "<p>alone</p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = new_path(spark, "warc")
    warc.write_archive(df.repartition(3), path)
    out = warc.read_archive(spark, path).collect()
    assert len(out) == len(rows)
    most = {}
    for n, _, h in rows:
        if n is not None:
            most[h or ""] = max(most.get(h or "", -1), n)
    want = collections.Counter()
    for n, _, h in rows:
        p = (h or "").encode()
        first = most.get(h or "")
        revisit = first is not None and n != first and sum((x[2] or "") == (h or "") for x in rows) > 1
        want[n, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    # the bundle is a plain Zstandard file, and a frame can be read on its own
    content = spark.read.parquet(path).orderBy("bundle").head()["content"]
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    frames = b"".join(zstandard.ZstdDecompressor().decompress(content[a : a + n]) for a, n in warc.seek_table(content))
    assert whole == frames and whole.startswith(b"WARC/1.1\r\n")
    ids = spark.createDataFrame([(3,), (7,), (999,)], "page_id long")
    assert {r["page_id"] for r in warc.fetch(spark, path, ids).collect()} == {3, 7}
    # every record of the bundles, some asked for twice, the null id among them
    ids = spark.createDataFrame([(n, "clash") for n in [*range(60), None, 5, 5]], "page_id long, bundle string")
    assert collections.Counter(map(tuple, warc.fetch(spark, path, ids).collect())) == collections.Counter(map(tuple, out))
    assert warc.fetch(spark, path, ids.limit(0)).count() == 0
    empty = new_path(spark, "warc")
    warc.write_archive(df.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


# near-duplicates
def plain_classes(rows, least=0.8):
    bags = [minhash._bag(t or "") for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or minhash.overlap(bags[i], bags[j]) >= least:
            up[max(find(i), find(j))] = min(find(i), find(j))
    least_id = {}
    for i, (n, _, _) in enumerate(rows):
        if n is not None:
            least_id[find(i)] = min(least_id.get(find(i), n), n)
    return [least_id.get(find(i)) for i in range(len(rows))]


def test_near_pairs_among_texts_of_one_template(spark, monkeypatch):
    """Texts that share a template at about 0.7 are apart; each has one text at 0.85, and every such pair is a link."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 40, raising=False)  # buckets of several blocks
    rnd = random.Random(29)
    word = lambda: f"w{rnd.randrange(10**6)}"
    template, rows = [word() for _ in range(165)], []
    for k in range(150):
        tail = [word() for _ in range(35)]
        rows += [(2 * k, " ".join(template + tail), "s"), (2 * k + 1, " ".join(template + tail[:23] + [word() for _ in range(12)]), "s")]
    bags = [minhash._bag(t) for _, t, _ in rows]
    near = {i: {j for j in range(300) if i != j and minhash.overlap(bags[i], bags[j]) >= 0.8} for i in range(300)}
    assert all(near[i] == {i ^ 1} for i in range(300))
    out = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == [(i, i & ~1, 1) for i in range(300)]


def test_near_duplicates(spark):
    rng = random.Random(21)
    rows = [(n, word_salad(rng, 120), "s") for n in range(60)]
    for n in range(60, 200):
        w = rows[rng.randrange(4)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((n, " ".join(w), "s"))
    rows += [(300, None, "s"), (301, "", "s"), (302, " \n", "s"), (303, "one two", "s"), (304, "one  two", "s"), (305, "two one", "s"), (None, rows[0][1], "s"), (306, "x " * 9000, "s"), (307, "x " * 9100, "s"), (0, rows[0][1], "s")]
    out = minhash.near_duplicates(docs(spark, rows)).collect()
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in out)
    assert got == collections.Counter((r[0], c) for r, c in zip(rows, plain_classes(rows)))
    assert {r["class_id"] for r in out if r["is_first"]} == {r["class_id"] for r in out}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_registers_agree_like_weighted_jaccard():
    import numpy as np

    a = np.repeat(np.arange(300, dtype=np.uint64), [1 + i % 7 for i in range(300)])
    b = np.repeat(np.arange(100, 400, dtype=np.uint64), [1 + i % 3 for i in range(300)])
    ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    true = sum(min(n, cb[x]) for x, n in ca.items()) / sum(max(ca[x], cb[x]) for x in {*ca, *cb})
    hits = []
    for salt in range(40):
        mixed = [minhash._mix(x + np.uint64(salt * 1_000_003)) for x in (a, b)]
        text = np.repeat([0, 1], [len(a), len(b)])
        s = minhash.signatures(2, text, np.concatenate(mixed))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - true) < 0.02


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(90)] + [(5, None), (6, 6)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline
def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(31)
    prose = lambda: " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(150))
    base = [prose() for _ in range(12)]
    rows = [(n, t, "ab"[n % 2]) for n, t in enumerate(base)]
    rows += [(20, base[0], "a"), (21, base[1] + " tail", "b"), (22, "too short", "a"), (23, None, "a"), (24, base[2] + " password = abcdefghijklmnop", "a"), (25, prose() + " token: 'abcdefghijklmnop' end", None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "source_mix", "encode"]
    kept = corpus_pipeline.quality_rules(spark, frame, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {22, 23}
    first = corpus_pipeline.near_dedup(spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in first.collect()} == {*range(12), 25} and first.count() == 13 and set(first.columns) == set(frame.columns)
    clean = corpus_pipeline.secret_scans(spark, first, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[25].endswith(" [assign]' end") and texts[3] == base[3]
    mixed = corpus_pipeline.source_mix(spark, clean, str(tmp_path))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: c for i, c in want.items() if c})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter({i: c for i, c in want.items() if c})
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
