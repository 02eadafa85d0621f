"""Personal data: base patterns, and a semi-Markov conditional random field that adds whole spans around them.

The field scores whole candidate segments (not single characters): its features see a segment's digits, groups, separators,
check digit and the words before it. Stretches of text that could hold data, wherever they stand in it, are split into tokens; a
segment is at most MAX_TOKENS tokens, typed by one of the kinds or left outside. All kinds compete in one dynamic programme per
stretch, so that boundaries and kinds are chosen together; base spans are fixed in it, and only what they leave free is typed.
Tokens beside stretches are outside by construction, which makes decoding stretch by stretch the same as decoding the text.

Training maximises the likelihood of labelled stretches (sums over all segmentations by forward and backward passes). Labels are
the base spans of a bounded sample, and the same with their surface marks taken away, as people also write them: phones without
plus, with other separators, after a cue; cards in groups with dots or slashes; addresses with dots or @ spelled out. Stretches of
the sample that hold no base span, numbers with a wrong check digit, dates and amounts are labelled as outside.
"""

from __future__ import annotations

import math
import random
import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

KINDS = ("email", "ip", "card", "phone")
#: Longest segment, in tokens; rows that training reads at most, windows that it takes from them at most, and from one of them.
MAX_TOKENS, TRAIN_ROWS, TRAIN_WINDOWS, TEXT_WINDOWS = 24, 4_000, 400, 8
#: What a span must win over being outside, in log-likelihood: false alarms cost more than misses.
MARGIN = 2.0
#: Characters of context that a window shows before a stretch.
CONTEXT = 64

_AFTER_AT = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the fixed patterns, each kind leftmost and without overlaps, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        if m := _AFTER_AT.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), 0))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return out


# stretches and their segments
_NUMBER = re.compile(r"[+(]?[0-9](?:(?:[\x20.()/-]|\[\.\]|\x20dot\x20)*[0-9])+")
_AT = re.compile(r"\x20?[\[(]at[\])]\x20?|\x20at\x20")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++")
_TOKEN = re.compile(r"[0-9]+|[\[(](?:at|dot|\.)[\])]|[A-Za-z]+|.", re.S)
#: Words that people write before data of a kind.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "ip": ("ip", "host", "server", "address"),
    "email": ("email", "mail", "contact", "write"),
}
_CUES = {w: KINDS.index(k) for k, words in CUES.items() for w in words}
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W{0,3}\Z")
Stretch = tuple[str, str]  # a stretch and the word before it


def stretches(text: str) -> list[tuple[int, int]]:
    """Where numbers of seven digits or more stand, and addresses with their marks spelled out."""
    out = []
    if _DIGIT.search(text):
        out = [(m.start(), m.end()) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and len(_digits(m[0])) >= 7]
    if "at)" in text or "at]" in text or " dot " in text:
        done = 0
        for m in _AT.finditer(text):
            host = _HOST.match(text, m.end())
            if host is None or m.start() < done or (m[0] == " at " and "dot" not in host[0]):
                continue
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, host.end()))
                done = host.end()
    return sorted(out)


def features(segment: str, kind: int, cue: str) -> list[str] | None:
    """Names of the whole-span features of a segment under a kind; None if no such span can be of the kind."""
    digits = _digits(segment)
    n = len(digits)
    own_cue = f"cue {_CUES.get(cue, -1) == kind}"
    if kind == 0:
        at = "@" if "@" in segment else "brackets" if "at)" in segment or "at]" in segment else "word" if " at " in segment else None
        if at is None or not segment[0].isalnum() or not segment[-1].isalnum():
            return None
        host = re.split(r"@|[\[(]at[\])]|\x20at\x20", segment)[-1].strip()
        dot = "." if "." in host else "spelled" if "dot" in host else "none"
        return ["bias", f"at {at}", f"dot {dot}", f"host ends in letters {host[-1:].isalpha()}", own_cue]
    if not 4 <= n <= 19 or not (segment[-1].isdigit() and (segment[0].isdigit() or segment[0] in "+(")) or segment.count("(") != segment.count(")"):
        return None
    groups = [len(g) for g in re.findall(r"[0-9]+", segment)]
    parts = re.findall(r"[0-9]+", segment)
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", segment)) - {" "})) or ("blank" if " " in segment else "none")
    if kind == 1:
        if len(parts) != 4:
            return None
        fine = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        return ["bias", f"parts fit {fine}", f"marks {marks}", own_cue]
    if n < 7:
        return None
    size = str(n) if n <= 16 else "many"
    shape = "-".join(map(str, groups)) if len(groups) <= 5 else "other"
    own = ["bias", f"digits {size}", f"groups {min(len(groups), 6)}", f"shape {shape}", f"marks {marks}", f"plus {segment[0] == '+'}", own_cue, f"{own_cue}, digits {size}"]
    if kind == 2:
        own.append(f"check digit {luhn(digits)}, card length {n >= 13}")
    return own


def _side(c: str) -> str:
    """What stands beside a segment in its stretch."""
    return "nothing" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c == " " else "mark"


def segments(stretch: Stretch, taken: tuple[tuple[int, int], ...] = ()) -> tuple[int, list[tuple[int, int, int, list[str]]]]:
    """Number of tokens, and (first token, end token, kind, features) of every segment that could be of a kind. taken: character
    ranges that no segment may touch."""
    text, cue = stretch
    ends = [0, *(m.end() for m in _TOKEN.finditer(text))]
    out = []
    for i in range(len(ends) - 1):
        if text[ends[i]] in " .-)/[]":
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(ends) - 1) + 1):
            piece = text[ends[i] : ends[j]]
            if any(a < ends[j] and ends[i] < b for a, b in taken):
                break
            sides = f"before {_side(text[: ends[i]][-1:])}", f"after {_side(text[ends[j] : ends[j] + 1])}"
            for kind in range(4):
                if (f := features(piece, kind, cue)) is not None:
                    out.append((i, j, kind, [f"{kind} {x}" for x in (*f, *sides)]))
    return len(ends) - 1, out


def train(examples: list[tuple[Stretch, list[tuple[int, int, int]]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> dict[str, float]:
    """Weights by gradient ascent on the log-likelihood. examples: stretches with their spans (start, end, kind) in characters."""
    names: dict[str, int] = {}
    rows, every, sizes, gold_of = [], [], [], []
    for (text, cue), gold in examples:
        n, segs = segments((text, cue))
        starts = [0, *(m.end() for m in _TOKEN.finditer(text))]
        if not segs:
            continue
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        from_: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        first = len(sizes)
        for s, (i, j, k, f) in enumerate(segs, first):
            into[j].append((s, i))
            from_[i].append((s, j))
            every += [names.setdefault(x, len(names)) for x in f]
            sizes.append(len(f))
            gold_of.append((starts[i], starts[j], k) in gold)
        rows.append((n, into, from_, [(s, i, j) for s, (i, j, _, _) in enumerate(segs, first)]))
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    if not rows:
        return {}
    flat, size = np.array(every), np.array(sizes)
    begin, wanted = np.cumsum(size) - size, np.array(gold_of, float)
    for _ in range(rounds):
        scores, chance = np.add.reduceat(w[flat], begin).tolist(), np.zeros(len(size))
        for n, into, from_, own in rows:
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1], *(ahead[i] + scores[s] for s, i in into[j])]) if into[j] else ahead[j - 1]
            for i in range(n - 1, -1, -1):
                behind[i] = _logsum([behind[i + 1], *(behind[j] + scores[s] for s, j in from_[i])]) if from_[i] else behind[i + 1]
            for s, i, j in own:
                chance[s] = math.exp(min(0.0, ahead[i] + scores[s] + behind[j] - ahead[n]))
        gradient = np.bincount(flat, np.repeat(wanted - chance, size), len(names)) - decay * len(rows) * w
        squares += gradient**2
        w += rate * gradient / np.sqrt(squares)
    return {x: float(w[i]) for x, i in names.items()}


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def decode(stretch: Stretch, weights: dict[str, float], margin: float = MARGIN, taken: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int, int]]:
    """Best segmentation; spans (start, end, kind) in characters of the stretch, none that touches `taken`."""
    n, segs = segments(stretch, taken)
    into: list[list[tuple[float, int, int]]] = [[] for _ in range(n + 1)]
    for i, j, kind, f in segs:
        if (score := sum(weights.get(x, 0.0) for x in f) - margin) > 0:
            into[j].append((score, i, kind))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for score, i, kind in into[j]:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    ends = [0, *(m.end() for m in _TOKEN.finditer(stretch[0]))]
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((ends[i], ends[j], kind))
            j = i
    return out[::-1]


def _cue(text: str, at: int) -> str:
    m = _WORD_BEFORE.search(text[max(0, at - CONTEXT) : at])
    return m[1].lower() if m else ""


def added_spans(text: str, base: list[tuple[int, int, int]], weights: dict[str, float], margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """Spans that the field finds beside the base spans."""
    if not weights:
        return []
    out: list[tuple[int, int, int]] = []
    for a, b in stretches(text):
        if a and text[a - 1].isalnum() or text[b : b + 1].isalnum():
            continue
        taken = tuple((x - a, y - a) for x, y, _ in base if x < b and a < y)
        out += [(a + x, a + y, k) for x, y, k in decode((text[a:b], _cue(text, a)), weights, margin, taken)]
    return out


def variants(piece: str, kind: int, draw: random.Random) -> list[tuple[Stretch, bool]]:
    """A base span with its surface marks taken away, after a cue or not, and whether it still counts as data of its kind."""
    digits, cue = _digits(piece), draw.choice(CUES[KINDS[kind]])
    if kind == 3:
        own = digits[-10:]
        grouped = f"{own[:-7]}{{0}}{own[-7:-4]}{{0}}{own[-4:]}"
        mark = draw.choice("-. /")
        return [((piece.lstrip("+"), cue), True), ((grouped.format(mark), cue), True), ((f"({own[:-7]}) {own[-7:-4]}-{own[-4:]}", ""), True), ((grouped.format(draw.choice("-.")), ""), True), ((own, cue), True), ((own, ""), False), ((own[:8], ""), False), ((f"{own[:4]}-{own[4:6]}-{own[6:8]}", ""), False)]
    if kind == 2:
        mark = draw.choice("./-")
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + draw.randrange(1, 10)) % 10)
        return [((mark.join(groups), ""), True), ((mark.join(groups), cue), True), (("  ".join(groups), ""), True), ((wrong, ""), False), ((mark.join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), ""), False)]
    if kind == 1:
        parts = piece.split(".")
        large = [str(int(p) % 256 + 300) for p in parts]
        return [(("[.]".join(parts), ""), True), ((" dot ".join(parts), draw.choice([cue, ""])), True), ((".".join(large), ""), False), (("-".join(parts), ""), False), (("/".join(parts), ""), False)]
    local, _, host = piece.partition("@")
    at, dot = draw.choice([" (at) ", "(at)", " [at] ", "[at]", " at "]), draw.choice([" (dot) ", "[dot]", " dot "])
    spelled = host.replace(".", " dot " if at == " at " else draw.choice([dot, "."]))
    return [((local + at + spelled, draw.choice([cue, ""])), True), ((local + " [at] " + host, ""), True)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, limit: int = TRAIN_WINDOWS) -> dict[str, float]:
    """Train on at most `rows` texts (those with the smallest hashes of id and text) and at most `limit` windows of them.

    A window is what stands around a base span or another stretch, wherever it is in a whole text. If the sample has no base span,
    windows are drawn from the texts of the whole table. No texts, or none with data in the table: no weights, a warning, and then
    nothing is added to the base spans.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    hashed = docs.where(F.col(text_col).rlike("[0-9@]")).select(h.alias("h"), F.col(text_col).alias("t"))
    last = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h")).head()[0]
    around = F.arrow_udf(_windows, "array<struct<text: string, labelled: boolean>>")
    for some in () if last is None else (hashed.where(F.col("h") <= last), hashed):
        found = some.select("h", F.explode(around("t")).alias("w")).select("h", "w.*").distinct()
        # half of the windows hold base spans where there are as many
        parts = [found.where(c).orderBy("h", "text").limit(limit // 2).collect() for c in ("labelled", "NOT labelled")]
        if parts[0]:
            return train(_examples([r["text"] for part in parts for r in part]))
    warnings.warn("no text has a base span: nothing is added to the base spans", stacklevel=2)
    return {}


def _windows(texts: pa.Array) -> pa.Array:
    """A few windows of each whole text: base spans first, then other stretches."""
    out = []
    for t in texts:
        text = t.as_py() or ""
        base = sorted(base_spans(text))
        free = [s for s in stretches(text) if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        spots = [(a, b, True) for a, b, _ in base[:TEXT_WINDOWS]] + [(a, b, False) for a, b in free[: TEXT_WINDOWS // 2]]
        out.append([{"text": text[max(0, a - CONTEXT) : b + CONTEXT], "labelled": own} for a, b, own in spots if b - a <= 4 * CONTEXT])
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("labelled", pa.bool_())])))


def _examples(windows: list[str]) -> list:
    """Stretches with their spans: those of the windows, and the variants of their base spans."""
    out: list = []
    for window in windows:
        draw = random.Random(window)
        base = base_spans(window)
        for a, b in stretches(window):
            out.append(((window[a:b], _cue(window, a)), [(x - a, y - a, k) for x, y, k in base if a <= x and y <= b]))
        for a, b, k in base:
            out += [(stretch, [(0, len(stretch[0]), k)] if counts else []) for stretch, counts in variants(window[a:b], k, draw)]
    return out


FOUND = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"


def pii_spans(text: Column, weights: dict[str, float], margin: float = MARGIN) -> Column:
    """Spans of personal data by kind as in KINDS, then start; offsets in code points, end exclusive; `base` tells those of the
    fixed patterns. Null text: none."""

    @F.arrow_udf(FOUND)
    def spans(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text = t.as_py() or ""
            base = base_spans(text)
            rows.append(sorted([(k, a, b, True) for a, b, k in base] + [(k, a, b, False) for a, b, k in added_spans(text, base, weights, margin)]))
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in x] for x in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))

    return spans(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per input row: id and `spans` (array of kind, start, end, base) over the whole text.

    Null and empty texts have no spans; repeated rows are searched each for itself; an empty table gives an empty result; other
    columns are not touched, so their names can't clash; very long texts are searched whole. Spans of different kinds may overlap
    where the base patterns do; added spans touch no other span.
    """
    weights = fit(docs, id_col, text_col) if weights is None else weights
    return docs.select(F.col(id_col), pii_spans(F.col(text_col), weights, margin).alias("spans"))
