"""Ranked lexical search over postings in geometric blocks.

Documents become vectors of term impacts, over the terms that a block of items asks for. Documents that are alike (nearest of a few
pivots, which a bounded sample gives) go to the same shard. In a shard every term has its posting list; the list is ordered by the finer
groups of its documents and cut into blocks of similar documents, each with a summary: for every term the largest impact in the block.
An item's score in a block can't exceed the product of its weights with that summary, in whole numbers, so a block is skipped only
when that bound is below the item's k-th best score so far, which begins with the best of the sample. Lists whose terms cannot reach
that score together are not opened at all: a document that is only in those can't win. Every document that is left is scored
exactly; nothing in the result depends on pivots or sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlay_jobs.session import discard, settle

#: Items of a block at most, and their terms, about; documents of a shard at most, about; postings of a block at most.
ITEMS, TERMS, SHARD, BLOCK = 512, 32_768, 1_024, 32
#: Documents of the sample that gives pivots and the first bounds; pivots; groups within a shard; dimensions in which documents are compared.
SAMPLE_ROWS, PIVOTS, GROUPS, SKETCH = 2_048, 48, 32, 64
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BILLION = 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return TERM.findall((text or "").encode().lower())


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items with at least one term, (id, terms), a bounded number at a time. Only a block of them is at the driver."""
    some, size = [], 0
    for r in items.select(id_col, text_col).toLocalIterator():
        terms = sorted(set(terms_of(r[1])))
        if some and (len(some) == ITEMS or size + len(terms) > TERMS):
            yield some
            some, size = [], 0
        if terms:
            some.append((r[0], terms))
            size += len(terms)
    if some:
        yield some


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms, counts: a row per document with a term; the vocabulary's terms in rising order."""

    def count(batches):  # noqa: ANN001, ANN202
        for b in batches:
            n, ends, terms, counts, kept = [], [0], [], [], []
            for at, text in enumerate(b.column(1)):
                own = Counter(terms_of(text.as_py()))
                if own:
                    found = sorted((vocabulary[t], own[t]) for t in own.keys() & vocabulary.keys())
                    terms += [t for t, _ in found]
                    counts += [c for _, c in found]
                    ends.append(len(terms))
                    n.append(own.total())
                    kept.append(at)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, k)) for v, k in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), *lists], [id_col, "n", "terms", "counts"])

    schema = docs.select(id_col).schema.simpleString()[7:-1] + ",n:bigint,terms:array<int>,counts:array<bigint>"
    return docs.select(id_col, text_col).mapInArrow(count, schema)


class _Shard:
    """Postings of some documents: rows, terms (numbered within the shard) and impacts, and the blocks of a list once it is asked for."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, counts: np.ndarray, n: np.ndarray, total: int, length: int):
        m = 10 + 90 * n * total // length  # 100 - 90 + (90 n N) div L
        size = np.diff(ends)
        row = np.repeat(np.arange(len(n)), size)
        impact = _BILLION * counts // (1_000 * counts + 8 * m[row])
        self.terms, local = np.unique(terms, return_inverse=True)
        self.dense = np.zeros((len(n), len(self.terms)), np.int32)  # an impact is less than a million
        self.dense[row, local] = impact
        self.largest = self.dense.max(axis=0, initial=0).astype(np.int64)
        by_term = np.argsort(local, kind="stable")
        self.rows, self.starts = row[by_term], np.searchsorted(local[by_term], np.arange(len(self.terms) + 1))
        self.group = np.zeros(len(n), np.int64)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def cluster(self, weight: np.ndarray) -> None:
        """Groups of similar rows: a few rounds of nearest means of the sketches."""
        sketch = _sketch(self.dense * weight[self.terms], self.terms)
        self.group = _near(sketch, _means(sketch, GROUPS)) if len(sketch) > BLOCK else self.group

    def list_blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a term's list, where its blocks begin (and the end), and each block's largest impact by term."""
        if t not in self.blocks:
            rows = self.rows[self.starts[t] : self.starts[t + 1]]
            rows = rows[np.argsort(self.group[rows], kind="stable")]
            own = self.group[rows]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            within = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            begin = np.flatnonzero(within % BLOCK == 0)
            self.blocks[t] = rows, np.append(begin, len(rows)), np.maximum.reduceat(self.dense[rows], begin, axis=0)
        return self.blocks[t]

    def best(self, terms: np.ndarray, weight: np.ndarray, least: int, k: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores that reach `least` and the k-th best among them. terms: rising, of the shard."""
        scored, rows, scores = np.zeros(len(self.dense), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = weight * self.largest[terms]
        order = np.argsort(reach, kind="stable")
        lists = order[np.cumsum(reach[order]) >= max(least, 1)][::-1]  # what comes before them is not enough alone
        for at in lists.tolist():
            own, ends, summary = self.list_blocks(int(terms[at]))
            bound = summary[:, terms].astype(np.int64) @ weight
            for some in _waves(np.argsort(-bound, kind="stable")):
                some = some[bound[some] >= max(least, 1)]
                if seen is not None:
                    seen["opened"] += len(some)
                if not len(some):
                    break
                new = np.concatenate([own[ends[b] : ends[b + 1]] for b in some.tolist()])
                new = new[~scored[new]]
                if len(new):
                    scored[new] = True
                    s = self.dense[np.ix_(new, terms)].astype(np.int64) @ weight
                    rows, scores = np.append(rows, new[s >= max(least, 1)]), np.append(scores, s[s >= max(least, 1)])
                    if len(scores) >= k:
                        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                        rows, scores = rows[scores >= least], scores[scores >= least]
            if seen is not None:
                seen["blocks"] += len(bound)
        return rows, scores


def _waves(order: np.ndarray) -> Iterator[np.ndarray]:
    """The best block, then more and more at a time."""
    at, n = 0, 1
    while at < len(order):
        yield order[at : at + n]
        at, n = at + n, 4 * n


def _sketch(vectors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Unit vectors of SKETCH dimensions: each term has a direction of signs that its number gives."""
    bits = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bits ^= bits >> np.uint64(29)
    bits *= np.uint64(0xBF58476D1CE4E5B9)
    bits ^= bits >> np.uint64(32)
    signs = ((bits[:, None] >> np.arange(SKETCH, dtype=np.uint64)) & np.uint64(1)).astype(float) * 2 - 1
    out = vectors.astype(float) @ signs
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _near(sketch: np.ndarray, means: np.ndarray) -> np.ndarray:
    return (sketch @ means.T).argmax(axis=1)


def _means(sketch: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    means = sketch[np.unique(np.linspace(0, len(sketch) - 1, min(n, len(sketch))).astype(int))]
    for _ in range(rounds):
        near = _near(sketch, means)
        means = np.array([sketch[near == i].mean(axis=0) if (near == i).any() else m for i, m in enumerate(means)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return means


def _shard(table: pa.Table, total: int, length: int) -> _Shard:
    table = table.combine_chunks()
    terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
    if isinstance(terms, pa.ChunkedArray):
        terms, counts = terms.chunk(0), counts.chunk(0)
    ends = np.asarray(terms.offsets, np.int64)
    return _Shard(np.asarray(terms.flatten(), np.int64), ends - ends[0], np.asarray(counts.flatten(), np.int64), np.asarray(table.column("n"), np.int64), total, length)


def _search(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """_item (its place in the block), id, score: for every item what can be among its k best."""
    words = sorted({t for _, terms in items for t in terms})
    vocabulary = {t: i for i, t in enumerate(words)}
    vectors = settle(_vectors(docs, vocabulary, id_col, text_col), "ranking-vectors")
    total, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    schema = "_item int," + docs.select(id_col).schema.simpleString()[7:-1] + ",score long"
    held = {r[0]: r[1] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row per term of the block
    if not held:
        return docs.sparkSession.createDataFrame([], schema)
    weight = np.array([math.floor(1_000 * math.log((2 * total + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(words))], np.int64)
    weight = np.maximum(weight, 0)  # df <= N, so that the logarithm is never below 0
    asked = [np.array(sorted(vocabulary[t] for t in terms if vocabulary[t] in held), np.int64) for _, terms in items]

    some = vectors.where(F.size("terms") > 0)
    sample = some.orderBy(F.xxhash64(F.col(id_col), "n", "terms", "counts")).limit(SAMPLE_ROWS).select("n", "terms", "counts").toArrow()
    first = _shard(sample, total, length)
    means = _means(_sketch(first.dense * weight[first.terms], first.terms), PIVOTS)
    bounds = []
    for terms in asked:
        here = np.isin(terms, first.terms)
        at = np.searchsorted(first.terms, terms[here])
        scores = first.dense[:, at].astype(np.int64) @ weight[terms[here]]
        bounds.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0)

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for at in range(0, len(b), SHARD):
                part = pa.Table.from_batches([b.slice(at, SHARD)])
                own = _shard(part.select(["n", "terms", "counts"]), total, length)
                near = _near(_sketch(own.dense * weight[own.terms], own.terms), means)
                yield from part.append_column("pivot", pa.array(near, pa.int32())).to_batches()

    placed = settle(some.mapInArrow(place, some.schema.simpleString()[7:-1] + ",pivot:int").withColumn("_row", F.monotonically_increasing_id()), "ranking-placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / SHARD).alias("slices"))  # a row per pivot
    dealt = placed.join(F.broadcast(sizes), "pivot").withColumn("slice", F.pmod(F.xxhash64("_row"), F.col("slices")))

    def search(shard: pa.Table) -> pa.Table:
        own = _shard(shard.select(["n", "terms", "counts"]), total, length)
        own.cluster(weight)
        order = pc.sort_indices(shard.select([id_col]), sort_keys=[(id_col, "ascending")], null_placement="at_end").to_numpy()
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        n, row, score = [], [], []
        for item, (terms, least) in enumerate(zip(asked, bounds)):
            at = np.searchsorted(own.terms, terms)
            here = own.terms[np.minimum(at, len(own.terms) - 1)] == terms
            rows, scores = own.best(at[here], weight[terms[here]], least, k)
            first_k = np.lexsort((place_of[rows], -scores))[:k]  # of equal scores the k first ids can win
            rows, scores = rows[first_k], scores[first_k]
            n.append(np.full(len(rows), item, np.int32))
            row.append(rows)
            score.append(scores)
        return pa.Table.from_arrays([pa.array(np.concatenate(n)), shard.column(id_col).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(score))], ["_item", id_col, "score"])

    out = settle(dealt.groupBy("pivot", "slice").applyInArrow(search, schema), "ranking-found")
    discard(vectors, placed)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item, rank, id, score: the k best documents with a score above 0 for every item; equal scores by rising id, null ids last.

    Terms, weights and scores are whole numbers: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), a document scores the sum of
    weight * ((10^9 tf) div (1000 tf + 8 (10 + (90 n N) div L))) over an item's terms. Null and empty texts have no terms: such
    documents count in nothing, such items have no rows. Each row of either table counts, repeated ids and rows too, and every
    item row is ranked for itself; empty tables give an empty result; no other column is read, so names can't clash; very long
    texts are read whole. Items are taken in blocks, each of which reads the documents once.
    """
    spark = docs.sparkSession
    kinds = items.select(F.col(item_id)).schema, docs.select(F.col(id_col)).schema
    names = [f"{kinds[0].simpleString()[7:-1]}", "rank:int", f"{kinds[1].simpleString()[7:-1]}", "score:bigint"]
    out = None
    for block in _item_blocks(items, item_id, item_text):
        found = _search(docs, block, k, id_col, text_col)
        best = Window.partitionBy("_item").orderBy(F.desc("score"), F.col(id_col).asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        keys = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"_item int, {kinds[0].simpleString()[7:-1].replace(':', ' ', 1)}")
        found = found.join(F.broadcast(keys), "_item").select(item_id, "rank", id_col, "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], ",".join(names)) if out is None else out
