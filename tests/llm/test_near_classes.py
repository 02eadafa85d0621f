"""Classes without counted links: pairs are passed over only where they change nothing."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from overlay_jobs.llm import minhash
from tests.llm.test_table_operators import docs, plain_classes, word_salad


def template_rows(rnd):
    word = lambda: f"w{rnd.randrange(10**6)}"
    template, rows = [word() for _ in range(165)], []
    for k in range(60):
        tail = [word() for _ in range(35)]
        rows += [(2 * k, " ".join(template + tail), "s"), (2 * k + 1, " ".join(template + tail[:23] + [word() for _ in range(12)]), "s")]
    return rows


def chain_rows(rnd):
    """Texts that drift: neighbours are near, ends are not; mixed with a large group of near copies."""
    words, rows = word_salad(rnd, 150, 10**6).split(), []
    for n in range(60):
        words[2 * n : 2 * n + 2] = [f"x{n}", f"y{n}"]
        rows.append((n, " ".join(words), "s"))
    base = word_salad(rnd, 150, 10**6).split()
    for n in range(60, 160):
        own = list(base)
        own[rnd.randrange(150)] = f"z{n}"
        rows.append((n, " ".join(own), "s"))
    return rows


@pytest.mark.parametrize("make", [template_rows, chain_rows])
@pytest.mark.parametrize("block", [8])
def test_classes_equal_those_of_all_pairs(spark, monkeypatch, make, block):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block)
    rows = make(random.Random(5))
    got = minhash.near_duplicates(docs(spark, rows), links=False).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(zip([r[0] for r in rows], plain_classes(rows)))
    assert "n_links" not in got[0]
    bags = [minhash._bag(t) for _, t, _ in rows]
    want = {i: sum(i != j and rows[i][1] != rows[j][1] and minhash.overlap(bags[i], bags[j]) >= 0.8 for j in range(len(rows))) for i in range(len(rows))}
    counted = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["n_links"] for r in counted} == {rows[i][0]: n for i, n in want.items()}
    assert sorted((r["doc_id"], r["class_id"], r["is_first"]) for r in counted) == sorted((r["doc_id"], r["class_id"], r["is_first"]) for r in got)


def test_hot_keys_are_broadcast(spark, monkeypatch):
    from overlay_jobs import session
    from overlay_jobs.functions import graph

    for module in (session, graph):
        monkeypatch.setattr(module, "HOT_LEAST", 3)
        monkeypatch.setattr(module, "HOT_SHARE", 20)
    rnd = random.Random(9)
    rows = chain_rows(rnd) + [(500 + k, "one text that stands here very often", "s") for k in range(90)]
    got = minhash.near_duplicates(docs(spark, rows), links=False).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(zip([r[0] for r in rows], plain_classes(rows)))
    assert sum(r["is_first"] for r in got) == len({r["class_id"] for r in got})


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (1, "a b c d e f", "s"), (3, "other words", "s"), (None, None, "s")]
    frame = docs(spark, rows)
    for name in ("id", "key", "row", "own_id", "own_key", "is_first", "_gone_id", "n", "bucket"):
        frame = frame.withColumn(name, F.lit(name))
    got = minhash.keep_one(frame)
    assert got.columns == frame.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == {1: 1, 3: 1, None: 1}
    assert minhash.keep_one(docs(spark, [])).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls only, and columns whose names the stages use themselves."""
    import corpus_pipeline

    good = " ".join(f"word{i} and" for i in range(80))
    tables = {"empty": [], "nulls": [(None, None, None)] * 3, "mixed": [(1, good, None), (None, good + " tail", "s"), (2, None, "s"), (2, "", None)]}
    for name, rows in tables.items():
        frame = docs(spark, rows)
        for extra in ("key", "row", "copies", "bucket", "edge", "at", "_text", "spans"):
            frame = frame.withColumn(extra, F.lit(extra))
        path = tmp_path / name
        frame.write.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(path))
            assert set(frame.columns) >= {"doc_id", "text", "source", "key", "spans"}
        kept = corpus_pipeline.run(spark, str(path)).count()
        assert (kept > 0) == (name == "mixed")
