"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a condition on measures of a text. On a bounded sample the cascade times every rule's measures and counts which
rules reject together; rules then stand in the order of rejection per cost, of texts that the rules before them let pass, in one
CASE expression, whose later branches run only for texts that the earlier ones let pass. The order changes the time, never the
verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Rows of the sample that orders the rules at most; timings of which the least counts.
SAMPLE_ROWS, TIMINGS = 1_000, 3
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order: runs of other characters than blank, tab, line feed, vertical tab, form feed, return."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(_text(text), BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), "[^\\p{L}]+", "")).cast("long")


def n_repeat_words(text: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that stand in the text twice or more, the first one included.

    Windows are told apart by 64-bit hashes. Where no hash stands twice that is all; else they are sorted with their places and
    compared with their neighbours: n log n for a text.
    """

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        own = lambda h: F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda a, i: F.xxhash64(a, *(F.get(h, i + k) for k in range(1, width))))
        return let(hashed, lambda h: F.when(F.size(h) >= width, own(h)).otherwise(F.array().cast("array<bigint>")))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def same(s: Column, ordered: Column, k: Column) -> Column:
        return F.coalesce(F.get(ordered, k)["h"] == s["h"], F.lit(False))

    def repeated(ordered: Column) -> Column:
        return F.sort_array(F.transform(F.filter(ordered, lambda s, k: same(s, ordered, k - 1) | same(s, ordered, k + 1)), lambda s: s["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))), F.lit(0).cast("long"), lambda total, n: total + n)

    none = F.lit(0).cast("long")
    in_full = lambda h: let(placed(h), lambda ordered: let(repeated(ordered), lambda at: covered(at)))
    return let(words(text), lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(in_full(h))))


MEASURES: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_letters": n_letters, "n_repeat_words": n_repeat_words}


class Measures(dict):
    """Measures of a text by name: columns that are there already, or expressions over the text."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        super().__init__(known or {})
        self.text = text

    def __missing__(self, name: str) -> Column:
        return MEASURES[name](self.text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]
    base: bool = False


#: The first two are the base rules; the others take out texts that are hardly prose.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50, True),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], True),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
)


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejection per cost, from a sample of at most sample_rows rows that are drawn without looking at any column.

    The next rule is always the one that rejects most per cost of the rows that those before it let pass. A rule's cost is the
    least of a few timings over the sample, beyond the time of a condition that costs nothing, in powers of two, so that noise
    hardly changes the order; ties go to the cheaper rule, then by the rules' own order. known: measures that are there anyhow.
    """
    rows = docs.count()
    share = min(1.0, 1.2 * sample_rows / max(rows, 1))
    sample = docs.select(F.col(text_col).alias("t")).where(F.rand(17) < share).limit(sample_rows).persist()
    try:
        own = Measures(F.col("t"))
        rejected = [F.coalesce(rule.rejects(own), F.lit(False)) for rule in rules]
        mask = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(rejected)), F.lit(0))
        seen = {r["mask"]: r["count"] for r in sample.select(mask.alias("mask")).groupBy("mask").count().collect()}  # 2^rules rows at most
        free = Measures(F.col("t"), dict.fromkeys(known, F.length("t")))
        timed = [F.length("t") < 0, *(F.coalesce(rule.rejects(free), F.lit(False)) for rule in rules)]
        base, *spent = [min(_seconds(sample.agg(F.count_if(c))) for _ in range(TIMINGS)) for c in timed]
    finally:
        sample.unpersist()
    cost = [2.0 ** math.ceil(math.log2(max(t - base, 0.01))) for t in spent]
    left, ordered = list(range(len(rules))), []
    while left:
        gain = {k: sum(n for m, n in seen.items() if m >> k & 1 and not any(m >> done & 1 for done in ordered)) for k in left}
        ordered.append(max(left, key=lambda k: (gain[k] / cost[k], -cost[k], -k)))
        left.remove(ordered[-1])
    return [rules[k] for k in ordered]


def _seconds(job: DataFrame) -> float:
    began = time.perf_counter()
    job.collect()  # one row
    return time.perf_counter() - began


def first_failed(measures: Measures, ordered: list[Rule]) -> Column:
    """Name of the first rule of the cascade that rejects the text; null if it passes them all."""
    out = F.when(F.coalesce(ordered[0].rejects(measures), F.lit(False)), F.lit(ordered[0].name))
    for rule in ordered[1:]:
        out = out.when(F.coalesce(rule.rejects(measures), F.lit(False)), F.lit(rule.name))
    return out


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with all their columns.

    A null text counts as empty, has no words and goes. Repeated rows get the same verdict. An empty table stays empty. No column
    is added, so names can't clash, and no other column is looked at. Very long texts are judged whole.
    """
    return docs.where(first_failed(Measures(F.col(text_col)), order_rules(docs, text_col, rules)).isNull())


#: Measures that judge() returns; it works out others only where the cascade comes to them.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, the measures of RETURNED, base_failed (a base rule rejects), kept. Cases as for keep_good().

    Rules over returned measures cost nothing more and stand before those that read the text again.
    """
    measured = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *(MEASURES[name](F.col(text_col)).alias(name) for name in RETURNED))
    known = Measures(F.col("_text"), {name: F.col(name) for name in RETURNED})
    ordered = order_rules(docs, text_col, rules, known=RETURNED)
    base = F.lit(False)
    for rule in rules:
        base = base | rule.rejects(known) if rule.base else base
    return measured.select(id_col, *RETURNED, base.alias("base_failed"), first_failed(known, ordered).isNull().alias("kept"))
