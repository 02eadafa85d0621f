"""Removal of repeated byte strings: suffixes are ordered by digits, most significant first, and only through LENGTH bytes.

Two suffixes belong together if their first LENGTH bytes (or as many as are asked for) are equal; deeper order is never looked
at. A suffix of a text is not a row of its own at first: every string of LENGTH bytes has an anchor in its first WINDOW bytes
(where a hash of eight bytes is smallest), and the suffixes that share an anchor travel as one row. The digits of a pass are
hashes of the bytes that all suffixes of a row have in common; groups of one end there, as nothing repeats them. The passes are

  1. the run of suffixes of an anchor, on the LENGTH - WINDOW + 1 bytes from the anchor on,
  2. runs of BLOCK suffixes, on the bytes that those have in common,
  3. single suffixes, on their LENGTH bytes.

In passes 1 and 2 a group whose rows agree in everything their suffixes cover is finished: all its strings repeat. Of rows that
agree so while others in their group differ, one goes on as a partner of the others. What is left in the end in groups of two or
more is exactly the repeated strings. Groups are counted by partial aggregates and joined back to their rows, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlay_jobs.session import settle

LENGTH, WINDOW, BLOCK = 400, 200, 25
#: Shorter strings than this would end before the eight bytes of an anchor do.
SHORTEST = 16
#: Bytes of text that are searched for anchors at a time.
BATCH = 1 << 20

RUNS = "text binary, at int, lo int, hi int, core bigint, cover bigint"
_RUNS = pa.schema([("text", pa.binary()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("core", pa.int64()), ("cover", pa.int64())])


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last string start of every run in texts laid end to end. bounds: text offsets and the end."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.ndarray((n,), "<u8", padded, 0, (1,)).copy()
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0x94D049BB133111EB)
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # ties go to the left
    width = 1
    while width * 2 <= window:
        least[: n - width] = np.minimum(least[: n - width], least[width:])
        width *= 2
    rest = window - width
    least = np.minimum(least[: n - rest], least[rest:]) if rest else least
    size = np.diff(bounds)
    starts = np.arange(n) + length <= np.repeat(bounds[1:], size)
    p = np.flatnonzero(starts)
    if not len(p):
        return (np.zeros(0, np.int64),) * 3
    at = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)))
    ends = np.append(new[1:], len(p)) - 1
    return at[new], p[new], p[ends]


def _parts(length: int) -> tuple[int, int]:
    """WINDOW and BLOCK for strings of that length."""
    return length * WINDOW // LENGTH, length * BLOCK // LENGTH


def _runs(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Pass 1: (key, bytes) of texts -> the rows of their anchors."""
    window = _parts(length)[0]
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or texts.buffers()[2] is None:
            continue
        raw = np.frombuffer(texts.buffers()[2], np.uint8)
        i = 0
        while i < len(texts):
            j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH))), len(texts))
            data, bounds = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            at, first, last = anchors(data, bounds, length, window)
            own = np.searchsorted(bounds, at, side="right") - 1
            start, stop = bounds[own], bounds[own + 1]
            left, right = np.maximum(start, at - window + 1), np.minimum(stop, at + length)
            view = memoryview(np.ascontiguousarray(data))
            core = [xxhash.xxh3_64_intdigest(view[a : a + length - window + 1]) for a in at.tolist()]
            cover = [xxhash.xxh3_64_intdigest(view[a:b], c) for a, b, c in zip(left.tolist(), right.tolist(), (at - left + 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i + k] for k in own.tolist()], pa.binary()), pa.array((at - start).astype(np.int32)), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32)), _signed(core), _signed(cover)], schema=_RUNS)
            i = j


def _finished_and_open(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with core, cover and wants: those whose strings all repeat, and those that the next pass splits.

    Rows that agree in core and cover are stood for by the place (text, at) that comes first; it goes on only as a partner (wants
    false), in as many rows as its text has copies.
    """
    groups = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("cover").alias("lo_cover"), F.max("cover").alias("hi_cover"), F.max("wants").alias("wanted")).where("n > 1 AND wanted")
    groups = settle(groups.select("core", (F.col("lo_cover") != F.col("hi_cover")).alias("mixed")), f"repeats-{name}-groups")
    rows = settle(rows.join(groups, "core"), f"repeats-{name}-rows")
    same = rows.groupBy("core", "cover").agg(F.count("*").alias("n"), F.min(F.struct("text", "at")).alias("first"))
    same = settle(same.where("n > 1"), f"repeats-{name}-same")
    marked = rows.join(same, ["core", "cover"], "left")
    finished = marked.where("n IS NOT NULL AND wants")
    open_ = marked.where(F.col("mixed") & (F.col("n").isNull() | ((F.col("first.text") == F.col("text")) & (F.col("first.at") == F.col("at"))))).withColumn("wants", F.col("wants") & F.col("n").isNull())
    return finished, open_.drop("n", "first", "mixed")


def _cut(text: pa.Array, spots: pa.Array, length: int) -> pa.Array:
    """What the strings of each spot (at, lo, hi, wants) cover, with the bytes before the anchor counted."""
    out, window = [], _parts(length)[0]
    for t, own in zip(text, spots.to_pylist()):
        t, rows = t.as_py(), []
        for s in own:
            left = max(0, s["at"] - window + 1)
            rows.append({**s, "left": s["at"] - left, "bytes": t[left : s["at"] + length]})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("wants", pa.bool_()), ("left", pa.int32()), ("bytes", pa.binary())])))


def _blocks(left: pa.Array, lo: pa.Array, hi: pa.Array, data: pa.Array, length: int) -> pa.Array:
    """Pass 2: the blocks of a spot. A block is numbered; its strings begin block * size ... + size - 1 bytes before the anchor."""
    out, size = [], _parts(length)[1]
    for at, a, b, t in zip(left.to_pylist(), lo.to_pylist(), hi.to_pylist(), data.to_pylist()):
        rows = []
        for block in range(a // size, b // size + 1):
            near, far = block * size, block * size + size - 1
            core = t[at - near : at - far + length] if at >= near else b""
            from_ = max(0, at - far)
            rows.append({"block": block, "core": xxhash.xxh3_64_intdigest(core, block + 1) - (1 << 63), "cover": xxhash.xxh3_64_intdigest(t[from_ : at - near + length], at - from_ + 1) - (1 << 63)})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("core", pa.int64()), ("cover", pa.int64())])))


def _strings(left: pa.Array, lo: pa.Array, hi: pa.Array, data: pa.Array, blocks: pa.Array, length: int) -> pa.Array:
    """Pass 3: the strings of the blocks of a spot that are still open: bytes before the anchor, and 128 bits of hash."""
    out, size = [], _parts(length)[1]
    for at, a, b, t, own in zip(left.to_pylist(), lo.to_pylist(), hi.to_pylist(), data.to_pylist(), blocks.to_pylist()):
        rows = []
        for x in own:
            for d in range(max(a, x["block"] * size), min(b, x["block"] * size + size - 1) + 1):
                rows.append({"before": d, "wants": x["wants"], "hash": xxhash.xxh3_128_digest(t[at - d : at - d + length])})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("before", pa.int32()), ("wants", pa.bool_()), ("hash", pa.binary())])))


def _span(from_: str, to: str) -> list:
    return [F.col("text"), F.expr(from_).cast("int").alias("a"), F.expr(to).cast("int").alias("b")]


def repeated_spans(texts: DataFrame, key_col: str, bytes_col: str, id_col: str, length: int = LENGTH) -> DataFrame:
    """text (a key), a, b: byte ranges (end beyond the text possible) that strings of length bytes cover which start elsewhere too.

    Rows with the same key must have the same bytes; each row counts as a text of its own. The row with the smallest id stands for
    its key where bytes are cut out, so that copies do not meet in one task.
    """

    @F.arrow_udf("array<struct<at: int, lo: int, hi: int, wants: boolean, left: int, bytes: binary>>")
    def cut(text: pa.Array, spots: pa.Array) -> pa.Array:
        return _cut(text, spots, length)

    @F.arrow_udf("array<struct<block: int, core: bigint, cover: bigint>>")
    def block(left: pa.Array, lo: pa.Array, hi: pa.Array, data: pa.Array) -> pa.Array:
        return _blocks(left, lo, hi, data, length)

    @F.arrow_udf("array<struct<before: int, wants: boolean, hash: binary>>")
    def single(left: pa.Array, lo: pa.Array, hi: pa.Array, data: pa.Array, blocks: pa.Array) -> pa.Array:
        return _strings(left, lo, hi, data, blocks, length)

    if length < SHORTEST:
        raise ValueError(f"strings must have {SHORTEST} bytes at least")
    window, size = _parts(length)
    runs = settle(texts.select(F.col(key_col).alias("text"), F.col(bytes_col).alias("data")).mapInArrow(lambda batches: _runs(batches, length), RUNS), "repeats-runs")
    done1, open1 = _finished_and_open(runs.withColumn("wants", F.lit(True)), "1")
    spans = done1.select(*_span(f"greatest(0, at - {window - 1})", f"at + {length}"))
    first = texts.groupBy(F.col(key_col).alias("key")).agg(F.min(id_col).alias("first"))
    # copies of a text bring the same rows: one of each goes on, so that what is gathered is bounded by the text's own anchors
    open1 = open1.select("text", "at", "lo", "hi", "wants").distinct()
    spots = open1.groupBy("text").agg(F.collect_list(F.struct("at", "lo", "hi", "wants")).alias("spots"))
    spots = settle(spots.join(first, F.col("text") == F.col("key")).drop("key"), "repeats-places")
    held = texts.select(F.col(key_col).alias("own"), F.col(id_col).alias("id"), F.col(bytes_col).alias("data")).join(spots, (F.col("own") == F.col("text")) & F.col("id").eqNullSafe(F.col("first")))
    held = held.select("text", F.explode(cut("data", "spots")).alias("s")).select("text", "s.*").dropDuplicates(["text", "at"])
    spots = settle(held, "repeats-spots")
    blocks = spots.select("text", "at", "wants", F.explode(block("left", "lo", "hi", "bytes")).alias("s")).select("text", "at", "wants", "s.*")
    done2, open2 = _finished_and_open(blocks, "2")
    spans = spans.union(done2.select(*_span(f"greatest(0, at - {size} * block - {size - 1})", f"at - {size} * block + {length}")))
    left = open2.groupBy(F.col("text").alias("t"), F.col("at").alias("p")).agg(F.collect_list(F.struct("block", "wants")).alias("blocks"))
    strings = spots.drop("wants").join(left, (F.col("text") == F.col("t")) & (F.col("at") == F.col("p")))
    strings = strings.select("text", "at", F.explode(single("left", "lo", "hi", "bytes", "blocks")).alias("s")).select("text", "at", "s.before", "s.wants", "s.hash")
    strings = settle(strings, "repeats-strings")
    twice = settle(strings.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeats-twice")
    last = strings.where("wants").join(twice, "hash").select(*_span("at - before", f"at - before + {length}"))
    return spans.union(last)


def _remove(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The maximal removed runs of each text, and the bytes that stay."""
    out = []
    for t, own in zip(text.cast(pa.binary()), spans.to_pylist()):
        t, runs, kept, done = t.as_py(), [], [], 0
        for a, b in sorted((s["a"], min(s["b"], len(t))) for s in own or []):
            if runs and a <= runs[-1]["end"]:  # touching ones are one
                runs[-1]["end"] = max(runs[-1]["end"], b)
            else:
                runs.append({"start": a, "end": b})
        for run in runs:
            kept.append(t[done : run["start"]])
            done = run["end"]
        out.append({"spans": runs, "kept": b"".join([*kept, t[done:]])})
    return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_key": F.unhex(F.md5(text)), "_bytes": text.cast("binary")})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, n_bytes (of the text), n_removed, n_spans, kept_sha256 (of the bytes that stay), spans (the maximal
    removed runs in order: start, end, in bytes) and kept (the bytes that stay; a cut may go through a character).

    Every byte goes that a string of length bytes (16 at least) covers which starts anywhere else as well. Null counts as empty;
    texts shorter than length keep everything; repeated rows repeat each other and go whole if they are long enough; ids are not
    looked at; an empty table gives an empty result; other columns are not read.
    """
    own = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t").select("id", "_key", "_bytes")
    spans = repeated_spans(own, "_key", "_bytes", "id", length).groupBy("text").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = settle(spans, "repeats-spans")
    remove = F.arrow_udf(_remove, "struct<spans: array<struct<start: bigint, end: bigint>>, kept: binary>")
    out = own.join(spans, F.col("_key") == F.col("text"), "left").select("id", remove("_bytes", "spans").alias("r")).select("id", "r.*")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_bytes = (F.octet_length("kept") + removed).alias("n_bytes")
    return out.select(F.col("id").alias(id_col), n_bytes, removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans", "kept")
