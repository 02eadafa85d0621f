"""BPE encoding and decoding with a tokenization automaton.

The merges are taken in order; each one, `a b -> c`, changes the automaton over tokens by a gadget: an arc c is laid beside every
path a, b; the arc b is taken away from the state behind a; and c's own state starts as a copy of b's. What is left in the end
accepts exactly the token sequences that BPE produces, and one sequence for each word. The table of states and arcs is kept
sparse: a state is a reference to the one it was copied from, with the number of its gadget, and one exception for each arc that
a gadget took away (`removed`); a full table of 50,000 merges would have 2.5 billion cells.

Words are read byte by byte by the determinised form: a state is the set of arcs under way, and its last token is that of the
word so far, as every prefix has one. Its transition table is filled by subset construction as words ask for transitions, and
then only looked up. Texts are cut into words by arrays over parts of a batch, each different word of a part is walked once, and
ids are laid out for all texts of it at a time; decoding joins the labels of the ids. A worker holds the ids of one part only: they
leave it part by part.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Words and transitions that are kept per worker before the tables start anew; slots of the transition arrays; characters that
#: are cut into words at a time; longest word that is walked beside others.
KEPT, SLOTS, BATCH, LONG = 250_000, 1 << 20, 1 << 19, 256
#: Kinds of characters: symbols, letters, numbers, the blank, other white space.
SYMBOL, LETTER, NUMBER, BLANK, SPACE = range(5)
# Endings that stand as words of their own after an apostrophe, by their first letter.
ENDINGS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


@functools.cache
def kinds() -> np.ndarray:
    """Kind of each code point."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[32] = BLANK
    return out


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in texts laid end to end, as byte-level BPE splits them. codes: code points; first: offsets of texts.

    A word is a run of letters, numbers or symbols with the one blank before it; of white space before a word all but the last
    character are a word, and that is one too unless it is the blank. An ending after an apostrophe that begins a word ends it.
    """
    n = len(codes)
    kind = kinds()[codes]
    new_text = np.zeros(n + 1, bool)
    new_text[first[first < n]] = True
    new_text[n] = True
    space = kind >= BLANK
    group = np.where(space, np.uint8(BLANK), kind)
    starts = new_text[:n].copy()
    starts[1:] |= group[1:] != group[:-1]
    after = np.flatnonzero(starts[1:] & ~new_text[1:n] & space[:-1] & ~space[1:]) + 1  # words with white space before them
    starts[after - 1] = True
    starts[after[kind[after - 1] == BLANK]] = False
    quote = np.flatnonzero((codes == 39) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[~new_text[quote + 1]]
    for letter, rest in ENDINGS.items():
        at = quote[codes[quote + 1] == ord(letter)]
        if rest:
            at = at[at + 2 < n]
            at = at[(codes[at + 2] == ord(rest)) & ~new_text[at + 2]]
        end = at + 2 + len(rest)
        starts[at + 1] = False
        starts[end[end < n]] = True
    return np.flatnonzero(starts)


def byte_alphabet() -> dict[str, int]:
    """The characters that vocabulary files write for bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list, added: dict[str, int]):
        letter = byte_alphabet()
        spell = lambda t: bytes(letter[x] for x in t)
        size = max([*vocabulary.values(), *added.values()]) + 1
        self.label = [b""] * size
        for t, i in vocabulary.items():
            self.label[i] = spell(t)
        for t, i in added.items():
            self.label[i] = t.encode()
        #: the sparse table: arcs b taken away from the state behind a by a gadget's number, and what each state is a copy of
        self.removed: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = [-1] * size
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self._lay_gadget(k, vocabulary[a], vocabulary[b], vocabulary[a + b])
        #: (node << 8 | byte) -> node over labels; node -> token; whether labels go on from it
        self.trie: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for i in vocabulary.values():
            if i not in self.parts and len(self.label[i]) != 1:
                continue  # no path of merges leads to it
            node = 0
            for b in self.label[i]:
                self.goes_on[node] = True
                key = node << 8 | b
                if (found := self.trie.get(key)) is None:
                    found = self.trie[key] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
                node = found
            self.token[node] = i
        self.added = {t: np.array([i], np.uint32) for t, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.arcs: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        self.lengths = np.array([len(x) for x in self.label])
        self._start_anew()

    def _lay_gadget(self, k: int, a: int, b: int, c: int) -> None:
        if not all(len(self.label[x]) == 1 or x in self.parts for x in (a, b)) or not self.allowed(a, b, k):
            return  # no path a, b is left: earlier gadgets took it away
        self.removed.setdefault((a, b), k)
        if c not in self.parts:
            self.parts[c], self.born[c] = (a, b), k

    def _start_anew(self) -> None:
        """An empty transition table: only the start, where a word's first arc begins. A set of arcs under way is kept as bytes."""
        self.sets: list[bytes] = [array("i", (-1, 0)).tobytes()]
        self.numbers = {self.sets[0]: 0}
        self.last = np.full(1 << 16, -1, np.int32)
        self.transitions: dict[int, int] = {}
        #: the same for look-ups side by side: (state << 8 | byte) and next state at a slot by hash, or one of those after it
        self.slot_key, self.slot_state = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)

    def allowed(self, q: int, c: int, before: int) -> bool:
        """Whether state q has the arc c once the gadgets numbered under `before` are in place."""
        k = self.removed.get((q, c))
        if k is not None and k < before:
            return False
        born_q, born_c = self.born[q], self.born[c]
        if born_c < 0 and born_q < 0:
            return True
        if born_c < born_q:  # q's state began as a copy of that of its right part
            return self.allowed(self.parts[q][1], c, born_q)
        x, y = self.parts[c]
        if x == y == q:
            return False  # of equal tokens in a row the leftmost two are merged
        return self.allowed(q, x, born_c) and self.allowed(x, y, born_c)

    def arc(self, q: int, c: int) -> bool:
        if q < 0:
            return True
        found = self.arcs.get(q << 32 | c)
        if found is None:
            if len(self.arcs) >= KEPT:
                self.arcs.clear()
            found = self.arcs[q << 32 | c] = self.allowed(q, c, 1 << 60)
        return found

    def _transition(self, state: int, byte: int) -> int:
        """The state after a byte: arcs under way go on, the one that ends in an allowed token gives the last token."""
        last, under_way, own = -1, array("i"), memoryview(self.sets[state]).cast("i").tolist()
        for q, node in zip(own[::2], own[1::2]):
            if (node := self.trie.get(node << 8 | byte)) is None:
                continue
            if last < 0 and self.token[node] >= 0 and self.arc(q, self.token[node]):
                last = self.token[node]
            if self.goes_on[node]:
                under_way.extend((q, node))
        under_way.extend((last, 0))
        new = under_way.tobytes()
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.sets)
            self.sets.append(new)
            if number >= len(self.last):
                self.last = np.append(self.last, np.full(len(self.last), -1, np.int32))
            self.last[number] = last
        key = state << 8 | byte
        self.transitions[key] = number
        if 2 * len(self.transitions) < SLOTS:
            slot = self._slot(key)
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.slot_key[slot], self.slot_state[slot] = key, number
        return number

    @staticmethod
    def _slot(key):  # noqa: ANN001, ANN205
        return (key * 0x9E3779B1 >> 7) % SLOTS

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """Next states for (state << 8 | byte); transitions that are asked for the first time are built."""
        slot, out, open_ = self._slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_state[slot[open_[hit]]]
            open_ = open_[(found >= 0) & ~hit]
            slot[open_] = (slot[open_] + 1) % SLOTS
        missing = np.flatnonzero(out < 0)
        if len(missing):
            asked, where = np.unique(keys[missing], return_inverse=True)
            built = [self.transitions.get(k) or self._transition(k >> 8, k & 255) for k in asked.tolist()]
            out[missing] = np.array(built)[where]
        return out

    def walk(self, word: bytes) -> list[int]:
        """Token ids of the one path that spells the word."""
        state, states, transitions = 0, [], self.transitions
        for byte in word:
            state = transitions.get(state << 8 | byte) or self._transition(state, byte)
            states.append(state)
        last, out, end = self.last[states].tolist(), [], len(word)
        while end:
            out.append(last[end - 1])
            end -= len(self.label[out[-1]])
        return out[::-1]

    def walk_many(self, words: list[bytes]) -> list[bytes]:
        """walk() of many words side by side; ids as little-endian 32-bit integers."""
        if len(self.transitions) >= KEPT:
            self._start_anew()
        order = sorted((i for i in range(len(words)) if len(words[i]) <= LONG), key=lambda i: -len(words[i]))
        out: list[bytes] = [b""] * len(words)
        for i in range(len(words)):
            if len(words[i]) > LONG:
                out[i] = np.array(self.walk(words[i]), "<u4").tobytes()
        if not order:
            return out
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.int64)
        size = np.array([len(words[i]) for i in order])
        begin = np.cumsum(size) - size
        state, last = np.zeros(len(order), np.int64), np.zeros(len(data), np.int64)
        running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for j, n in enumerate(running.tolist()):
            state[:n] = self._next(state[:n] << 8 | data[begin[:n] + j])
            last[begin[:n] + j] = self.last[state[:n]]
        # back from the ends: each last token leads to the place where the one before it ends
        end, steps, going = size.copy(), [], np.flatnonzero(size)
        while len(going):
            token = last[begin[going] + end[going] - 1]
            steps.append((going, token))
            end[going] -= self.lengths[token]
            going = going[end[going] > 0]
        count = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(order))
        stop = np.cumsum(count)
        flat = np.zeros(stop[-1], "<u4")
        for r, (w, token) in enumerate(steps):
            flat[stop[w] - 1 - r] = token
        raw = flat.tobytes()
        for i, a, b in zip(order, (stop - count).tolist(), stop.tolist()):
            out[i] = raw[4 * a : 4 * b]
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words = {}
            new = words
        found = dict(zip(new, self.walk_many(new)))
        self.words.update((w, x) for w, x in found.items() if len(w) <= 64)
        return [found[w] if w in found else self.words[w] for w in words]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.split_added is not None and any(t in text for text in texts for t in self.added):
            parts = [[p for p in self.split_added.split(text) if p] for text in texts]
            plain = iter(self.encode_many_plain([p for own in parts for p in own if p not in self.added]))
            return [np.concatenate([np.zeros(0, np.uint32), *(self.added[p] if p in self.added else next(plain) for p in own)]) for own in parts]
        return self.encode_many_plain(texts)

    def encode_many_plain(self, texts: list[str]) -> list[np.ndarray]:
        ends = np.cumsum([len(t) for t in texts])
        out, at = [], 0
        while at < len(texts):
            to = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH))), len(texts))
            out += self._encode_batch(texts[at:to])
            at = to
        return out

    def _encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        data = np.frombuffer(joined.encode(), np.uint8)
        first = np.cumsum([0, *map(len, texts)])
        starts = word_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), first[:-1])
        begin = np.flatnonzero((data & 0xC0) != 0x80)[starts] if len(data) != len(joined) else starts
        size = np.diff(np.append(begin, len(data)))
        # words are told apart by hashes; that equal hashes are equal words is then checked byte by byte
        within = np.arange(len(data)) - np.repeat(begin, size)
        powers = np.cumprod(np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64))
        hashes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[within], begin)
        which, _ = pd.factorize(hashes)
        of = np.zeros(which.max() + 1, np.int64)
        of[which[::-1]] = np.arange(len(which))[::-1]  # the first word of each hash
        model = of[which]
        if (size != size[model]).any() or (data != data[np.repeat(begin[model], size) + within]).any():
            which = of = np.arange(len(begin))
        raw = data.tobytes()
        own = self._ids([raw[a : a + n] for a, n in zip(begin[of].tolist(), size[of].tolist())])
        count = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, offset = np.frombuffer(b"".join(own), "<u4"), np.cumsum(count) - count
        times = count[which]
        end = np.cumsum(times)
        ids = flat[np.arange(end[-1]) + np.repeat(offset[which] - end + times, times)]
        cuts = np.append(0, end)[np.searchsorted(starts, first)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.label.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Compiled once in each worker. path: a JSON file of byte-level BPE (model.vocab, model.merges, added_tokens)."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    return Automaton(j["model"]["vocab"], j["model"]["merges"], {t["content"]: t["id"] for t in j["added_tokens"]})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(text: Column, path: str | None = None) -> Column:
    """struct<n_tokens long, ids binary> of a text; ids are unsigned 32-bit integers, little-endian. Null text: no tokens."""
    path = path or default_path()

    @F.arrow_udf("struct<n_tokens: bigint, ids: binary>")
    def encode(texts: pa.Array) -> pa.Array:
        ids = automaton(path).encode_many([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["n_tokens", "ids"])

    return encode(text)


def bpe_decode(ids: Column, path: str | None = None) -> Column:
    """Text of ids as bpe_encode() gives them, special tokens kept. Null: null."""
    path = path or default_path()

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        own = automaton(path)
        return pa.array([None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in column.to_pylist()], pa.string())

    return decode(ids)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and return digests of both.

    One row per input row: id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens; ties and repeated rows
    are coded each for itself; an empty table gives an empty result; other columns are not touched, so their names can't clash; very long
    texts are coded whole. with_ids adds them (little-endian, 32 bits); else they stay in the Python task, as they would be larger than the text on
    their way back.
    """
    path = path or default_path()
    more = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), *([StructField("ids", BinaryType())] if with_ids else [])]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField(id_col, own.schema["id"].dataType), *more])
    return own.mapInArrow(lambda batches: coded(batches, path, with_ids), schema)


def coded(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids: a batch out for about BATCH bytes of text, so
    that neither side holds the ids of more than that, or of one text."""
    own = automaton(path)
    for batch in batches:
        texts, at = batch.column(1), 0
        sizes = np.cumsum(pc.coalesce(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        while at < len(texts):
            to = min(max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH))), len(texts))
            count, digests, decoded, packed = [], [], [], []
            for ids in own.encode_many([t or "" for t in texts.slice(at, to - at).to_pylist()]):
                raw = ids.astype("<u4").tobytes()
                count.append(len(ids))
                digests.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if with_ids:
                    packed.append(raw)
            columns = {"id": batch.column(0).slice(at, to - at), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(packed, pa.binary())} if with_ids else {}))
            at = to
