"""Near-duplicates by BagMinHash signatures of five-word shingles, banding, and exact multiset overlap.

A text is a bag of shingles. Each shingle of count c owns Poisson processes over the discretised weight axis: one for each of the
blocks (0, 1], (1, 2], (2, 4], (4, 8] ... up to c, with the block's length as its rate; a point of a block is halved down to
a unit cell and counts only below c. Every point has a time and a register; a register keeps its earliest time. Two bags agree in
a register with exactly the probability of their weighted Jaccard similarity. Points later than the last register's time cannot
matter, so a text stops drawing early. BANDS bands of ROWS registers make candidate pairs: all pairs of a bucket's members. Texts
are dealt to blocks, and two blocks that meet in a bucket are compared at once on the whole texts, so that a pair is no row of its
own: rows grow with the members times the blocks they meet. Verified links make classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.functions.graph import connected_components
from overlay_jobs.session import discard, join_hot, settle

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Texts and bytes of text in a block, about.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 4 << 20
#: Rows of a bucket for each of its salts; rounds of comparing one text of each label.
SALT_ROWS, ROUNDS = 4096, 6
#: Shingles that are multiplied out at a time, and products that are listed at a time.
DENSE, LISTED = 4096, 1 << 21
#: Bytes of text that are signed side by side.
BATCH = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (SplitMix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of texts laid end to end. A text of one to four words is one shingle."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[starts < len(data)]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # polynomial of a word's bytes: difference of running sums, brought to a common power
    powers = np.full(len(data), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(inside, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers)])
    stop = np.append(first[1:], len(data))
    inverse = np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    words = _mix((sums[stop] - sums[first]) * inverse[first])
    text = np.searchsorted(starts, first, side="right") - 1
    last = np.searchsorted(text, text, side="right")  # end of the words of the same text
    at = np.arange(len(words))
    own = np.zeros(len(words), np.uint64)
    padded = np.append(words, np.zeros(WORDS, np.uint64))
    for k in range(WORDS):
        own = _mix(own * _GOLDEN + np.where(at + k < last, padded[at + k], np.uint64(k + 1)))
    start_of_text = np.append(True, text[1:] != text[:-1])
    keep = (at + WORDS <= last) | start_of_text
    return text[keep], own[keep]


def signatures(n_texts: int, text: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """Times of the earliest points, one row of REGISTERS per text; infinite for a text without words."""
    registers = np.full(n_texts * REGISTERS, np.inf)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.append(True, (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])) if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(text)))
    text, shingle = text[at], shingle[at]
    # blocks (0, 1], (1, 2], (2, 4] ...: lower end and length
    own = [(text, shingle, np.zeros(len(text), np.int64), np.ones(len(text), np.int64), count)]
    low = 1
    while (more := count > low).any():
        own.append((text[more], shingle[more], np.full(more.sum(), low), np.full(more.sum(), low), count[more]))
        low *= 2
    text, shingle, low_, rate, count = (np.concatenate(x) for x in zip(*own))
    seed = _mix(shingle + _mix(low_.astype(np.uint64) * _GOLDEN + np.uint64(1)))
    time = np.zeros(len(seed))
    worst = np.full(n_texts, np.inf)
    n = 0
    while len(seed):
        n += 1
        a = _mix(seed + np.uint64(2 * n * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        b = _mix(a ^ np.uint64(0xD6E8FEB86659FD93))
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = ((b >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
        cell = low_ + ((b & np.uint64(0xFFFFFFFF)).astype(np.int64) * rate >> 32)
        valid = cell < count
        np.minimum.at(registers, text[valid] * REGISTERS + register[valid], time[valid])
        drawn = np.unique(text)
        worst[drawn] = registers.reshape(n_texts, REGISTERS)[drawn].max(axis=1)
        going = time < worst[text]
        text, low_, rate, count, seed, time = (x[going] for x in (text, low_, rate, count, seed, time))
    return registers.reshape(n_texts, REGISTERS)


def band_keys(texts: pa.Array) -> list[np.ndarray | None]:
    """BANDS keys of each text; None for texts without words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    out: list[np.ndarray | None] = []
    if not len(texts):
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    at = 0
    while at < len(texts):
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH))), len(texts))
        part = data[offsets[at] : offsets[to]]
        starts = offsets[at:to] - offsets[at]
        # of texts that begin at the same byte all but the last are empty
        text, shingle = shingle_hashes(part, starts)
        times = signatures(to - at, text, shingle)
        bits = _mix(times.view(np.uint64))
        keys = np.zeros((to - at, BANDS), np.uint64)
        for r in range(ROWS):
            keys = _mix(keys * _GOLDEN + bits[:, r::ROWS])
        keys = _mix(keys + np.arange(BANDS, dtype=np.uint64) * _GOLDEN)
        worded = np.isfinite(times[:, 0])
        out += [k if w else None for k, w in zip(keys.view(np.int64), worded)]
        at = to
    return out


def bands(text: Column) -> Column:
    """The band keys of a text (array of long); null for a text without words."""

    @F.arrow_udf("array<bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array(band_keys(texts), pa.list_(pa.int64()))

    return sign(text)


def _bag(text: str) -> Counter:
    w = text.encode().split()
    return Counter(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else Counter([tuple(w)] if w else [])


def overlap(a: Counter, b: Counter) -> float:
    """Multiset Jaccard similarity."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b) if len(a) <= len(b) else sum(min(n, a[x]) for x, n in b.items() if x in a)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _token_bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and token of the shingles of texts, by text. The k-th time a shingle stands in a text is a token of its own,
    so the overlap of two bags is that of two sets."""
    out, i = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    ends = np.cumsum([len(t) for t in texts])
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH))), len(texts))
        part = texts[i:j]
        starts = np.cumsum([0, *(len(t) for t in part[:-1])])
        text, shingle = shingle_hashes(np.frombuffer(b"".join(part), np.uint8), starts)
        order = np.lexsort((shingle, text))
        text, shingle = text[order], shingle[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1]))) if len(text) else np.zeros(0, np.int64)
        nth = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
        out.append((text + i, _mix(shingle + nth.astype(np.uint64) * _GOLDEN)))
        i = j
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _common(text_a: np.ndarray, token_a: np.ndarray, n_a: int, text_b: np.ndarray, token_b: np.ndarray, n_b: int, known: np.ndarray) -> np.ndarray:
    """Tokens that each text of one side shares with each of the other. known: the tokens that can be shared, in order."""
    out = np.zeros((n_a, n_b))
    if not len(known):
        return out
    sides = []
    for text, token in ((text_a, token_a), (text_b, token_b)):
        at = np.minimum(np.searchsorted(known, token), len(known) - 1)
        own = np.flatnonzero(known[at] == token)
        own = own[np.argsort(at[own], kind="stable")]
        sides.append((text[own], at[own], np.bincount(at[own], minlength=len(known))))
    (ta, ka, da), (tb, kb, db) = sides
    # a token of many texts is multiplied out, of few its pairs are listed
    heavy = da * db * 16 > n_a * n_b
    ids = np.flatnonzero(heavy)
    for k in range(0, len(ids), DENSE):
        part = ids[k : k + DENSE]
        x, y = np.zeros((len(part), n_a), np.float32), np.zeros((len(part), n_b), np.float32)
        for m, t, own in ((x, ta, ka), (y, tb, kb)):
            lo, hi = np.searchsorted(own, part[0]), np.searchsorted(own, part[-1], side="right")
            within = np.flatnonzero(heavy[own[lo:hi]]) + lo
            m[np.searchsorted(part, own[within]), t[within]] = 1
        out += x.T @ y
    few = np.flatnonzero(~heavy[ka])
    ta, ka = ta[few], ka[few]
    start = np.cumsum(db) - db
    sums = np.concatenate([[0], np.cumsum(db[ka])])
    i = 0
    while i < len(ta):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + LISTED, side="right")) - 1)
        times = db[ka[i:j]]
        nth = np.arange(sums[j] - sums[i]) - np.repeat(sums[i:j] - sums[i], times)
        out += np.bincount(np.repeat(ta[i:j], times) * n_b + tb[np.repeat(start[ka[i:j]], times) + nth], minlength=n_a * n_b).reshape(n_a, n_b)
        i = j
    return out


def _stars(near: np.ndarray, key: list[bytes]) -> list[tuple[int, int]]:
    """Links from the least key of each component of a symmetric table to its others."""
    left, out = np.ones(len(near), bool), []
    for s in range(len(near)):
        todo, own = [s] if left[s] else [], []
        left[s] = False
        while todo:
            u = todo.pop()
            own.append(u)
            new = np.flatnonzero(near[u] & left)
            left[new] = False
            todo += new.tolist()
        if len(own) > 1:
            root = min(own, key=key.__getitem__)
            out += [(root, v) for v in own if v != root]
    return out


def _near(text: np.ndarray, token: np.ndarray, n: int, on_left: np.ndarray, least: float) -> np.ndarray:
    """Which of n texts are near to each other: of one block all pairs, of two blocks those across."""
    size = np.bincount(text, minlength=n).astype(np.float64)
    near = np.zeros((n, n), bool)
    if on_left.all():
        known, count = np.unique(token, return_counts=True)
        both = _common(text, token, n, text, token, n, known[count > 1])
        near[:] = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= least - 1e-12
        np.fill_diagonal(near, False)
        return near
    a, b = np.flatnonzero(on_left), np.flatnonzero(~on_left)
    place = np.zeros(n, np.int64)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    left = on_left[text]
    both = _common(place[text[left]], token[left], len(a), place[text[~left]], token[~left], len(b), np.intersect1d(token[left], token[~left]))
    across = both / np.maximum(size[a][:, None] + size[b][None, :] - both, 1) >= least - 1e-12
    near[np.ix_(a, b)], near[np.ix_(b, a)] = across, across.T
    return near


LINKS = "a binary, b binary, n bigint"
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def _links(rows: pa.Table, least: float) -> pa.RecordBatch:
    """Rows (i, j, on_left, key, text) of whole pairs of blocks, by pair -> a text's number of links (b is null), and pairs that
    join what all links join (n is 0)."""
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    key, on_left = rows["key"].to_pylist(), rows["on_left"].to_numpy()
    text, token = _token_bags(rows["text"].to_pylist())
    begin = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    a, b, n = [], [], []
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(i)]):
        x, y = np.searchsorted(text, [lo, hi])
        near = _near(text[x:y] - lo, token[x:y], hi - lo, on_left[lo:hi], least)
        count = near.sum(axis=1)
        for k in np.flatnonzero(count).tolist():
            a.append(key[lo + k])
            b.append(None)
            n.append(int(count[k]))
        for u, v in _stars(near, key[lo:hi]) if count.any() else ():
            a.append(key[lo + u])
            b.append(key[lo + v])
            n.append(0)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], schema=_LINKS)


def compare_blocks(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_links() over batches that are in the order of the pairs of blocks; a pair may go on in the next batch."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            edge = np.flatnonzero((i != i[-1]) | (j != j[-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0
            if cut or (held and (held[-1].column("i")[-1].as_py(), held[-1].column("j")[-1].as_py()) != (int(i[0]), int(j[0]))):
                yield _links(pa.Table.from_batches([*held, batch.slice(0, cut)]), least)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _links(pa.Table.from_batches(held), least)

    return compare


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, links: bool = True) -> DataFrame:
    """One row per input row: id, class_id (the smallest id in its class of near-duplicates), n_links (other texts that its text is
    near; only with `links`), is_first (whether it is the row that stands for its class).

    Equal texts are one class from the start and are signed once a row but compared once in all, so a group of copies costs no
    more than its rows. Null counts as empty; texts without words are near only to equal texts; very long texts are signed and
    compared whole. Rows with a null id get the class of their text and are never first unless all its ids are null. Repeated
    rows are copies of each other and are first together. An empty table gives an empty result; other columns are not read.

    Bands find a pair of similarity 0.8 with probability 0.9999; verification is on 64-bit hashes of shingles. For the classes, pairs
    whose texts are in one class already are passed over, which changes no class; all other pairs that share a bucket are verified.
    With `links` all pairs of a class are compared as well, as near texts are in one class: work with the square of a class.
    """
    out = _classes(docs, id_col, text_col, least, links)
    return out.select(F.col("id").alias(id_col), "class_id", *(["n_links"] if links else []), "is_first")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows that stand for their classes, once each, with all their columns; cases as for near_duplicates().

    What goes is taken out by id and text in a merge join at any size: it grows with the input. Only rows that stand twice in the
    table are brought together to be reduced to one; which one of rows with equal id and text stays is open if they differ
    elsewhere. Columns may have any names.
    """
    out = settle(_classes(docs, id_col, text_col, least, False).select("id", "key", "is_first"), "near-rows")
    twice = settle(out.where("is_first").groupBy("id", "key").count().where("count > 1").drop("count"), "near-repeated")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))
    gone = out.where("NOT is_first").drop("is_first").union(twice)
    kept = rows.join(gone.hint("merge"), same, "left_anti")
    if twice.limit(1).count():
        kept = kept.union(rows.join(twice, same, "left_semi").dropDuplicates(["own_id", "own_key"]))
    return kept.select("row.*")


def _parts(rows: Column, size: Column) -> Column:
    """Number of blocks for so many texts of so many bytes."""
    return F.ceil(F.greatest(rows / BLOCK_TEXTS, size / BLOCK_BYTES)).cast("int")


def _at_home(members: DataFrame, *more: str) -> DataFrame:
    """members (key, bucket, n, parts, more) -> key, more, block: a text is at home in its largest bucket, and a bucket is dealt to
    its parts."""
    homes = members.groupBy("key", *more).agg(F.max(F.struct("n", "bucket", "parts")).alias("h"))
    return homes.select("key", *more, F.xxhash64("h.bucket", F.pmod(F.xxhash64("key"), F.col("h.parts"))).alias("block"))


def _meetings(members: DataFrame, name: str) -> DataFrame:
    """members (key, bucket, n, block, label) -> i, j, on_left, key, label: the pairs of blocks that share a bucket and hold texts of
    several labels, by member. Blocks are a bucket's own, so that no pair stands twice. Buckets of many members are salted: none is
    one task's.
    """
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    others = members.groupBy("bucket", "n", F.col("block").alias("other")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    others = others.select(F.col("bucket").alias("at"), "other", "lo", "hi", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    own = members.withColumn("own_salt", F.pmod(F.xxhash64("key"), salts).cast("int"))
    meets = (F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label"))
    met = own.join(others, (F.col("bucket") == F.col("at")) & (F.col("own_salt") == F.col("salt")) & meets)
    return settle(met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("on_left"), "key", "label"), name)


def _verified(met: DataFrame, least: float, name: str, counted: bool = False) -> DataFrame:
    """Pairs of blocks with texts (i, j, on_left, label, text) -> LINKS, between labels; with counts only if they are asked for."""
    met = met.select("i", "j", "on_left", F.col("label").alias("key"), "text").repartition("i", "j").sortWithinPartitions("i", "j", "on_left", "key")
    links = met.mapInArrow(compare_blocks(least), LINKS)
    return settle(links if counted else links.where("b IS NOT NULL AND a <> b"), name)


def _within(rows: DataFrame, least: float, name: str) -> DataFrame:
    """Links of all pairs within blocks: rows (block, label, text)."""
    return _verified(rows.select(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(True).alias("on_left"), "label", "text"), least, name)


def _relabelled(state: DataFrame, found: DataFrame, name: str) -> tuple[DataFrame, int]:
    """state (key, block, label), and links between labels -> labels by component, and how many links there were. A label is the
    least key of its texts."""
    n = found.count()
    if not n:
        return state, 0
    out = join_hot(state, connected_components(found.select("a", "b")), "label", "node").select("key", "block", F.coalesce("component", "label").alias("label"))
    out = settle(out, name)
    discard(found, state)
    return out, n


def _components(shared: DataFrame, state: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """key, label for the texts of shared (key, bucket, size, n, parts): equal labels for texts that links join. state: key, block,
    label (the key itself at first); texts: key, block, text.

    First all pairs of a block, a text in one block. Then, where a bucket with several labels is larger than a block, the same for
    one text of each of its labels, for as long as that joins many of them. Last all pairs of blocks in buckets with several
    labels that were not in one block from the start; texts of a label of many are blocks of their own.
    """
    found = _within(texts.withColumn("label", F.col("key")), least, "near-links-first")
    texts = texts.drop("block")
    state, _ = _relabelled(state, found, "near-state-first")
    members, n = shared, 0
    while True:
        members = settle(members.drop("label", "block").join(state, "key"), f"near-labelled-{n}")
        labels = members.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("block").alias("b0"), F.max("block").alias("b1"))
        last, members = members, settle(members.join(labels.where("l0 <> l1 AND b0 <> b1").select("bucket"), "bucket"), f"near-open-{n}")
        discard(last)
        rows, parts = members.agg(F.count("*"), F.max("parts")).head()
        if not rows:
            return state
        if parts == 1 or n == ROUNDS:
            break
        one = members.groupBy("bucket", "label").agg(F.min(F.struct("key", "size")).alias("one"))
        crowd = members.select("bucket", "label").distinct().groupBy("bucket").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int"))
        one = one.select("bucket", "label", "one.key").join(crowd, "bucket")
        met = settle(_at_home(one, "label"), f"near-ones-{n}")
        found = _within(met.join(texts, "key"), least, f"near-links-{n}")
        state, joined = _relabelled(state, found, f"near-state-{n}")
        n += 1
        if 4 * joined < met.count():
            n = ROUNDS  # few labels are joined this way: the rest pair by pair
        discard(met)
    placed, block = members, F.xxhash64("bucket")
    if parts > 1:
        # a label of many is dealt to blocks of its own, the others share blocks
        crowds = members.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("size").alias("bytes"))
        crowds = settle(crowds.select("bucket", "label", "k", "bytes", _parts(F.col("k"), F.col("bytes")).alias("own"), (_parts(2 * F.col("k"), 2 * F.col("bytes")) > 1).alias("many")), "near-crowds")
        pools = crowds.where("NOT many").groupBy("bucket").agg(_parts(F.sum("k"), F.sum("bytes")).alias("pools"))
        placed = members.join(crowds.where("many").drop("k", "bytes"), ["bucket", "label"], "left").join(pools, "bucket", "left")
        own_block = F.xxhash64("bucket", "label", F.pmod(F.xxhash64("key"), F.col("own")))
        block = F.when(F.col("many"), own_block).otherwise(F.xxhash64("bucket", F.pmod(F.xxhash64("label"), F.col("pools"))))
    last, members = members, settle(placed.withColumn("block", block).select("key", "bucket", "n", "block", "label"), "near-last")
    discard(last)
    met = _meetings(members, "near-last-met")
    found = _verified(met.join(texts.hint("merge"), "key"), least, "near-links-last")
    discard(members, met)
    return _relabelled(state, found, "near-state-last")[0]


def _links_in_classes(classes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """LINKS of all pairs of texts within classes (node, component, size), as links are never between classes.

    A class is dealt to blocks by its rows and bytes; a text goes to each pair of blocks that has its own, so pairs of texts are
    compared once, a class of one block in one place.
    """
    groups = classes.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    groups = settle(groups.select(F.col("component").alias("of"), _parts(F.col("n"), F.col("bytes")).alias("parts")), "near-groups")
    own = join_hot(settle(classes.select("node", "component"), "near-grouped"), groups, "component", "of").where("parts IS NOT NULL")
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = lambda c: F.xxhash64("component", c)
    met = own.select(block(F.least("own", "other")).alias("i"), block(F.greatest("own", "other")).alias("j"), (F.col("own") <= F.col("other")).alias("on_left"), F.col("node").alias("label"))
    met = settle(met, "near-grouped-met")
    return _verified(met.join(texts.select("key", "text").hint("merge"), F.col("label") == F.col("key")), least, "near-links", True)


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float, with_links: bool) -> DataFrame:
    """id, key of the text, class_id, n_links (with_links), is_first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_key(F.col(text_col)).alias("key"))
    signed = settle(own.select("id", "key", F.octet_length("text").alias("size"), bands(F.col("text")).alias("bands")), "near-signatures")
    copies = settle(signed.groupBy("key").agg(F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("size").alias("size")), "near-copies")
    rows = copies.where(F.col("bands").isNotNull()).select("key", "least", "size", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1").select("bucket", "n", _parts(F.col("n"), F.col("bytes")).alias("parts"))
    shared = settle(rows.join(buckets, "bucket"), "near-shared")
    # the row with the smallest id stands for its text, so that copies do not meet in one task
    homes = settle(_at_home(shared, "least").withColumnRenamed("key", "asked"), "near-homes")
    shared = shared.drop("least")
    # homes grow with the input: a merge join at any size
    texts = own.join(homes.hint("merge"), (F.col("key") == F.col("asked")) & F.col("id").eqNullSafe(F.col("least"))).select("key", "block", F.col("text").cast("binary").alias("text"))
    texts = settle(texts.dropDuplicates(["key"]), "near-texts")
    state = homes.select(F.col("asked").alias("key"), "block", F.col("asked").alias("label"))
    named = copies.select("key", "least")
    classes = _components(shared, state, texts, least).select(F.col("key").alias("node"), F.col("label").alias("component"))
    if with_links:
        classes = settle(classes, "near-components")
        sizes = copies.select(F.col("key").alias("node"), "size")
        links = _links_in_classes(classes.join(sizes, "node"), texts, least)
        degree = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
        named = named.join(degree, F.col("key") == F.col("a"), "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    named = named.join(classes, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    named = settle(named.drop("a", "node"), "near-named")
    discard(texts, homes)
    # the least id of a class, and of texts that share it the least key, stands for the class; null ids come last
    order = F.struct(F.col("least").isNull().alias("no_id"), "least", "key")
    firsts = settle(named.groupBy("component").agg(F.min(order).alias("f")).select(F.col("component").alias("of"), "f"), "near-firsts")
    more = ["n_links"] if with_links else []
    named = join_hot(named, firsts, "component", "of").select(F.col("key").alias("text_key"), F.col("f.least").alias("class_id"), (F.col("f.key") == F.col("key")).alias("leads"), *more)
    out = join_hot(signed.select("id", "key"), settle(named, "near-classes"), "key", "text_key")
    return out.select("id", "key", "class_id", *more, (F.col("leads") & F.col("id").eqNullSafe(F.col("class_id"))).alias("is_first"))
