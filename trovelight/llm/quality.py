"""Quality rules as a short-circuit cascade.

plan_cascade() runs every rule on a sample of the documents, measures what each costs and how much it
rejects, and orders the rules by rejection per cost. apply_cascade() then runs them in that order over
all documents and stops at a document's first failed rule. The order changes the work, never the verdict.
"""

from __future__ import annotations

import string
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_bytes

SYMBOLS = b"#*$%&|<>"


class TextFacts:
    """Counts of one text, each made when a rule first asks for it. Words are runs of anything but ASCII white space."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        solid = self.data.translate(None, SPACE_BYTES)
        return len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        """ASCII capitals."""
        return len(self.data) - len(self.data.translate(None, string.ascii_uppercase.encode()))

    @cached_property
    def n_lower(self) -> int:
        return len(self.data) - len(self.data.translate(None, string.ascii_lowercase.encode()))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside some 3-word window that the text holds twice or more."""
        words = self.words
        if len(words) < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:  # so that the product below stays under 2**63
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        twin = np.zeros(len(ranked), bool)
        twin[1:] = ranked[1:] == ranked[:-1]
        twin[:-1] |= twin[1:].copy()
        at = order[twin]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[at + k] = True
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[TextFacts], bool]


#: The base rules of the contract, then the method's own. Thresholds far from what prose of any language shows.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
MORE_RULES = (
    Rule("symbols", lambda t: 4 * t.n_symbols > t.n_words),
    Rule("shouting", lambda t: t.n_upper >= 50 and 2 * t.n_upper > t.n_upper + t.n_lower),
    Rule("repeated_lines", lambda t: t.n_dup_lines >= 10 and 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", lambda t: 2 * t.word_chars < 3 * t.n_words or t.word_chars > 100 * t.n_words),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Cascade:
    """Rules in the order they run, with seconds a text and the share of all sampled texts rejected."""

    rules: tuple[Rule, ...]
    cost: dict[str, float]
    rejects: dict[str, float]


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 2000, seed: int = 17) -> Cascade:
    """Order rules by rejection per cost on about sample_rows documents; ties keep the order given.

    Each next rule is the one that rejects most per cost of what the rules ahead of it leave of the sample.
    The sample only sets the order of work. An empty sample keeps the order given.
    """
    n = docs.count()
    schema = "rule int, fails bigint, texts bigint, seconds double"  # of a rule: its seconds; without one: texts by the bits of the rules they fail
    fields = pa.schema([("rule", pa.int32()), ("fails", pa.int64()), ("texts", pa.int64()), ("seconds", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            rows, fails = [], [0] * len(texts)
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                fails = [bits | bool(rule.fails(TextFacts(x))) << k for bits, x in zip(fails, texts, strict=True)]
                rows.append((k, None, len(texts), time.perf_counter() - began))
            rows += [(None, bits, n, None) for bits, n in Counter(fails).items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    sample = docs.select(text_col) if n <= sample_rows else docs.select(text_col).sample(fraction=sample_rows / n, seed=seed)
    found = sample.mapInArrow(measure, schema).groupBy("rule", "fails").agg(F.sum("texts").alias("texts"), F.sum("seconds").alias("seconds")).collect()
    cost = {rules[r.rule].name: max(r.seconds / r.texts, 1e-9) for r in found if r.rule is not None and r.texts}
    left = {r.fails: r.texts for r in found if r.rule is None}
    total = max(sum(left.values()), 1)
    rejects = {rule.name: sum(n for bits, n in left.items() if bits >> k & 1) / total for k, rule in enumerate(rules)}
    ordered, waiting = [], list(range(len(rules)))
    while waiting:
        worth = {k: sum(n for bits, n in left.items() if bits >> k & 1) / cost.get(rules[k].name, 1) for k in waiting}
        best = max(waiting, key=lambda k: (worth[k], -k))
        ordered.append(rules[best])
        waiting.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return Cascade(tuple(ordered), cost, rejects)


def apply_cascade(docs: DataFrame, cascade: Cascade, id_col: str = "doc_id", text_col: str = "text", facts: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the facts asked for (names of TextFacts, all of them counts), kept.

    One row per row of docs. Null text counts as empty, null and repeated ids come back as they are,
    other columns are ignored. Texts are read whole.
    """
    rules = cascade.rules
    fields = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in facts], ("kept", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in facts]
            kept = []
            for data in as_bytes(batch.column(1)):
                text = TextFacts(data)
                kept.append(not any(rule.fails(text) for rule in rules))
                for column, fact in zip(columns, facts, strict=True):
                    column.append(getattr(text, fact))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(kept, pa.bool_())], schema=fields)

    schema = ", ".join(["doc_id bigint", *[f"{f} bigint" for f in facts], "kept boolean"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, schema)


def kept_documents(docs: DataFrame, cascade: Cascade, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they were. Null text counts as empty."""
    rules = cascade.rules
    names = docs.columns
    at = names.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (TextFacts(x) for x in as_bytes(batch.column(at)))
            yield batch.filter(pa.array([not any(rule.fails(t) for rule in rules) for t in texts], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


