"""Secret scans with one combined deterministic automaton.

Every rule is a regular expression over bytes; its syntax tree gives the raw states. All rules together become one automaton by
subset construction (its start is always open), which is minimised and laid out as transition arrays over classes of bytes. One
pass over the bytes of a batch runs it on many pieces of text side by side; pieces begin after bytes that bring every state back
to the start, so no match crosses them. Where a rule fires, the automaton of the reversed expressions, run from the end of the
piece, marks where spans may start, and the rule's own automaton, run from there, gives the longest span.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Text is cut into pieces of about so many bytes, which the automaton reads side by side; pieces that are left when fewer than
#: LANES still run are read one by one.
PIECE, LANES = 512, 16


#: Rules to a word of bits; there are as many words as the rules need.
WORD = 62


def _joined(words: tuple[int, ...]) -> int:
    return functools.reduce(operator.or_, (w << WORD * n for n, w in enumerate(words)))


@dataclass(frozen=True)
class Rule:
    """Spans are the leftmost longest matches of head + value, without overlaps; those whose value has less than `least` bytes
    drop out. The head must not be able to give back what the value could begin with."""

    kind: str
    head: bytes
    value: bytes
    least: int = 1


#: The first three are the base kinds; the others add spans. A run of hex digits is whole, so its length can stand in the expression.
RULES = (
    Rule("assign", rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", rb"[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", b"", rb"AKIA[A-Z0-9]+", 18),
    Rule("hex", b"", rb"[0-9a-f]{16,}"),
    Rule("github", b"", rb"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", b"", rb"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", b"", rb"eyJ[A-Za-z0-9_-]{4,}\.eyJ[A-Za-z0-9_.-]+", 36),
    Rule("pem", b"", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def expression(pattern: bytes) -> tuple:
    """A regular expression as ("set", bytes), ("cat", parts), ("alt", parts) or ("star", part)."""
    return _expression(syntax.parse(pattern), False)


def _expression(tree, any_case: bool) -> tuple:  # noqa: ANN001
    parts: list[tuple] = []
    for what, arg in tree:
        name = str(what)
        if name == "LITERAL":
            both = {arg, *bytes([arg]).lower(), *bytes([arg]).upper()} if any_case else {arg}
            parts.append(("set", frozenset(both)))
        elif name == "IN":
            own = frozenset(b for kind, x in arg for b in ([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1)))
            parts.append(("set", own))
        elif name == "SUBPATTERN":
            parts.append(_expression(arg[3], any_case or bool(arg[1] & syntax.SRE_FLAG_IGNORECASE)))
        elif name == "BRANCH":
            parts.append(("alt", tuple(_expression(x, any_case) for x in arg[1])))
        elif name == "MAX_REPEAT":
            low, high, own = arg[0], arg[1], _expression(arg[2], any_case)
            parts += [own] * low
            parts += [("star", own)] if high == syntax.MAXREPEAT else [("alt", (own, ("cat", ())))] * (high - low)
        else:
            raise ValueError(f"{name} has no place in a rule")
    return ("cat", tuple(parts))


def _reversed(x: tuple) -> tuple:
    what, arg = x
    if what == "cat":
        return ("cat", tuple(_reversed(y) for y in reversed(arg)))
    if what == "alt":
        return ("alt", tuple(map(_reversed, arg)))
    return x if what == "set" else ("star", _reversed(arg))


@dataclass(frozen=True, eq=False)
class Automaton:
    classes: np.ndarray  # byte -> class
    step: np.ndarray  # state * n_classes + class -> state * n_classes
    fired: np.ndarray  # state * n_classes -> bits of the first WORD rules that end here
    more: tuple[np.ndarray, ...]  # the same of the next WORD rules, and so on
    resets: np.ndarray  # byte -> whether it brings every state to the start
    n_classes: int

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        """step and fired for reading one byte after the other."""
        return self.step.tolist(), [_joined(words) for words in zip(self.fired.tolist(), *(w.tolist() for w in self.more))]


def _positions(rules: tuple[tuple, ...]) -> tuple[list, list[set], set, dict[int, int]]:
    """Sets of bytes at each position of the rules' expressions, positions that may follow, those that may come first, and the
    rules' bits of the last ones."""
    chars: list[frozenset] = []
    follow: list[set] = []

    def build(x: tuple) -> tuple[bool, set, set]:
        what, arg = x
        if what == "set":
            chars.append(arg)
            follow.append(set())
            return False, {len(chars) - 1}, {len(chars) - 1}
        if what == "star":
            _, first, last = build(arg)
            for p in last:
                follow[p] |= first
            return True, first, last
        if what == "alt":
            parts = [build(y) for y in arg]
            return any(e for e, _, _ in parts), set().union(*(f for _, f, _ in parts)), set().union(*(z for _, _, z in parts))
        empty, first, last = True, set(), set()
        for y in arg:
            e, f, z = build(y)
            for p in last:
                follow[p] |= f
            first = first | f if empty else first
            last = last | z if e else z
            empty = empty and e
        return empty, first, last

    start: set = set()
    bits: dict[int, int] = {}
    for k, rule in enumerate(rules):
        _, first, last = build(rule)
        start |= first
        for p in last:
            bits[p] = bits.get(p, 0) | 1 << k
    return chars, follow, start, bits


def compile_expressions(rules: tuple[tuple, ...], anchored: bool = False) -> Automaton:
    """Subset construction over all expressions, then minimisation by splitting classes of states until none splits.

    Anchored: matches begin at the first byte only; state 0 is then the start and state 1 the dead one.
    """
    chars, follow, start, bits = _positions(rules)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in c for c in chars), len(kinds)) for b in range(256)], np.uint8)
    member = [[bool(sig[p]) for p in range(len(chars))] for sig in kinds]
    begin = frozenset({-1}) if anchored else frozenset()
    ids, todo, rows = {begin: 0}, [begin], []
    if anchored:
        ids[frozenset()] = 1
        todo.append(frozenset())
    while todo:
        state = todo.pop(0)
        reach = set().union(*(follow[p] for p in state if p >= 0))
        if not anchored or -1 in state:
            reach |= start
        row = []
        for has in member:
            nxt = frozenset(p for p in reach if has[p])
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    table = np.array(rows)
    out = [functools.reduce(operator.or_, (bits.get(p, 0) for p in s), 0) for s in ids]
    masks: dict[int, int] = {}
    block = np.array([masks.setdefault(m, len(masks)) for m in out])
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    names = 0
    for b in block:  # the start gets number 0
        if order[b] < 0:
            order[b], names = names, names + 1
    block = order[block]
    small = np.zeros((names, len(member)), np.int64)
    small[block] = block[table]
    n, words = len(member), []
    for k in range(0, max(1, len(rules)), WORD):
        words.append(np.zeros(names * n, np.int64))
        words[-1][block * n] = [m >> k & ((1 << WORD) - 1) for m in out]
    resets = (small == 0).all(axis=0)[classes]
    return Automaton(classes, (small * n).astype(np.int32).reshape(-1), words[0], tuple(words[1:]), resets, n)


@dataclass(frozen=True)
class Compiled:
    rules: tuple[Rule, ...]
    combined: Automaton  # all rules, forwards
    starts: Automaton  # all rules reversed: fires where a span may start
    spans: tuple[Automaton, ...]  # each rule by itself, anchored
    heads: tuple[Automaton | None, ...]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    """Done once, on the driver; tasks get the tables."""
    return _compiled(rules)


@functools.lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> Compiled:
    whole = tuple(expression(r.head + r.value) for r in rules)
    heads = tuple(compile_expressions((expression(r.head),), True) if r.head else None for r in rules)
    return Compiled(rules, compile_expressions(whole), compile_expressions(tuple(map(_reversed, whole))), tuple(compile_expressions((x,), True) for x in whole), heads)


def scan(data: np.ndarray, starts: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run the automaton over the bytes of texts that begin at `starts`; gives begin, end and fired bits of pieces where a rule fired."""
    resets = np.flatnonzero(auto.resets[data]) + 1
    cuts = resets[np.minimum(np.searchsorted(resets, np.arange(PIECE, len(data), PIECE)), len(resets) - 1)] if len(resets) else resets
    begin = np.unique(np.concatenate([starts, cuts]))
    begin = begin[begin < len(data)]
    if not len(begin):
        return begin, begin, begin
    length = np.diff(np.append(begin, len(data)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    kinds = auto.classes[data]
    state, every = np.zeros(len(begin), np.int32), (auto.fired, *auto.more)
    fired = [np.zeros(len(begin), np.int64) for _ in every]
    # pieces are sorted by length: those still running are the first ones
    running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    done = len(running)
    for j, n in enumerate(running.tolist()):
        if n < LANES:
            done = j
            break
        now = auto.step[state[:n] + kinds[begin[:n] + j]]
        state[:n] = now
        for seen, out in zip(fired, every):
            seen[:n] |= out[now]
    step, out = auto.lists
    for i in range(int(running[done]) if done < len(running) else 0):
        now, seen = int(state[i]), 0
        for kind in kinds[begin[i] + done : begin[i] + length[i]].tolist():
            now = step[now + kind]
            seen |= out[now]
        for n, word in enumerate(fired):
            word[i] |= seen >> WORD * n & ((1 << WORD) - 1)
    hit = np.flatnonzero(functools.reduce(operator.or_, fired))
    hit = hit[np.argsort(begin[hit])]
    bits = np.array([_joined(words) for words in zip(*(word[hit].tolist() for word in fired))], object)
    return begin[hit], begin[hit] + length[hit], bits


def _longest(auto: Automaton, kinds: list[int], at: int) -> int:
    """End of the longest match of an anchored automaton that begins at a place; -1 if there is none."""
    step, out = auto.lists
    dead, now, end = auto.n_classes, 0, -1
    for i in range(at, len(kinds)):
        now = step[now + kinds[i]]
        if now == dead:
            break
        if out[now]:
            end = i + 1
    return end


def cut(piece: np.ndarray, bits: int, compiled: Compiled) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) of the spans in a piece where the rules of `bits` fired."""
    step, out = compiled.starts.lists
    now, marks = 0, []
    for kind in reversed(compiled.starts.classes[piece].tolist()):
        now = step[now + kind]
        marks.append(out[now] & bits)
    marks.reverse()
    found = []
    for k, rule in enumerate(compiled.rules):
        if not bits >> k & 1:
            continue
        kinds, head, done = compiled.spans[k].classes[piece].tolist(), compiled.heads[k], 0
        head_kinds = head.classes[piece].tolist() if head else []
        for at in [i for i, m in enumerate(marks) if m >> k & 1]:
            if at < done:
                continue
            done = _longest(compiled.spans[k], kinds, at)
            value = _longest(head, head_kinds, at) if head else at
            if done - value >= rule.least:
                found.append((at, done, k))
    return found


def find(texts: pa.Array, compiled: Compiled | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, end, number of the rule) of each secret of each text, in code points, by start and then rule."""
    compiled = compiled or compile_rules()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    if not len(texts) or buffer is None or offsets[-1] == offsets[0]:
        return found
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = 0
    while at < len(texts):  # about 4 MB at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20))))
        to = min(to, len(texts))
        part, base = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        begins, ends, bits = scan(part, base[:-1], compiled.combined)
        owners = np.searchsorted(base, begins, side="right") - 1
        for begin, end, bit, owner in zip(begins.tolist(), ends.tolist(), bits.tolist(), owners.tolist()):
            found[at + owner] += [(begin + a, begin + b, k) for a, b, k in cut(part[begin:end], bit, compiled)]
        for owner in set(owners.tolist()):
            if spans := found[at + owner]:
                text = part[base[owner] : base[owner + 1]]
                points = np.cumsum((text & 0xC0) != 0x80)  # code points up to a byte
                place = lambda x: int(points[x - 1]) if x else 0
                found[at + owner] = sorted((place(a - int(base[owner])), place(b - int(base[owner])), k) for a, b, k in spans)
        at = to
    return found


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of secrets in a text, by start and then in the rules' order; offsets in code points, end exclusive. Null text: none."""
    compiled = compile_rules(rules)

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in x] for x in find(texts, compiled)], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return spans(text)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every secret replaced by [kind]; of overlapping ones the longer cover counts. Null stays null."""

    compiled = compile_rules(rules)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, spans in enumerate(find(texts, compiled)):
            if spans:
                parts, done = [], 0
                for a, b, k in spans:
                    if a >= done:
                        parts += [out[i][done:a], f"[{rules[k].kind}]"]
                    done = max(done, b)
                out[i] = "".join([*parts, out[i][done:]])
        return pa.array(out, pa.string())

    return redact(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id and `spans` (array of kind, start, end).

    Null and empty texts have no spans; repeated rows are scanned each for itself; an empty table gives an empty result; other
    columns are not touched, so their names can't clash. Very long texts are scanned whole.
    """
    return docs.select(F.col(id_col), secret_spans(F.col(text_col), rules).alias("spans"))

