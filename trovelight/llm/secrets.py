"""Secret scans with one combined automaton.

The rules, reversed, form a single minimal automaton. One pass over a text's bytes, last to first,
marks every place where a match of some rule begins. From there a rule's own anchored automaton runs to
the longest end, and matches are taken leftmost first, without overlap, rule by rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules, parse, reverse
from .common import as_bytes


@dataclass(frozen=True)
class SecretRule:
    """accept looks at a match's bytes once it is found; a match that it refuses still takes up its place."""

    kind: str
    pattern: str
    ignore_case: bool = False
    accept: Callable[[bytes], bool] | None = None


def _value_of_8(match: bytes) -> bool:
    """The value of an assignment, behind its first : or =, spaces and a quote, has 8 characters or more."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 8


_KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE_RULES = (
    SecretRule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", accept=_value_of_8),
    SecretRule("access", "AKIA[A-Z0-9]+", accept=lambda m: len(m) >= 16),
    SecretRule("hex", "[0-9a-f]{32,}"),
)
MORE_RULES = (
    # The key goes with its header lines, its base64 lines and its end; where the end is missing, the first word of the line behind it may go along.
    SecretRule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----(\r?\n(Proc-Type|DEK-Info):[^\r\n]*)*(\r?\n)?(\r?\n[A-Za-z0-9+/=]+)*(\r?\n-----END ([A-Z]+ )*PRIVATE KEY-----)?"),
    SecretRule("code_host", "gh[pousr]_[A-Za-z0-9]{20,}"),
    SecretRule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Scanner:
    rules: tuple[SecretRule, ...]
    backward: Automaton
    forward: tuple[Automaton, ...]

    @staticmethod
    def of(rules: tuple[SecretRule, ...]) -> Scanner:
        trees = [parse(r.pattern, r.ignore_case) for r in rules]
        return Scanner(rules, compile_rules([reverse(t) for t in trees], anchored=False), tuple(compile_rules([t], anchored=True) for t in trees))

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bits of the rules with a match that begins there), last place first: the one byte pass."""
        auto = self.backward
        table, accepting, state = auto.table, auto.accepting, auto.start
        found = []
        for i, c in enumerate(data.translate(auto.classes)[::-1], 1):
            state = table[state + c]
            if state >= accepting:
                found.append((len(data) - i, auto.marks[state // auto.width]))
        return found

    def longest(self, rule: int, data: bytes, start: int) -> int:
        auto = self.forward[rule]
        table, classes, state, end = auto.table, auto.classes, auto.start, start
        for i in range(start, len(data)):
            state = table[state + classes[data[i]]]
            if state == auto.dead:
                break
            if state >= auto.accepting:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, end exclusive, by start and then rule."""
        found = self.starts(data)
        if not found:
            return []
        out, free = [], [0] * len(self.rules)
        for at, bits in reversed(found):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and at >= free[k]:
                    free[k] = end = self.longest(k, data, at)
                    if rule.accept is None or rule.accept(data[at:end]):
                        out.append((at, end, k))
        if out and not data.isascii():
            # Code points ahead of a byte: bytes ahead of it that don't continue one.
            ahead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            out = [(int(ahead[a]), int(ahead[b]), k) for a, b, k in out]
        return sorted(out, key=lambda x: (x[0], x[2]))


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row of docs, by start and then in rule order.

    Offsets are code points, end exclusive. Null and empty texts have no spans; null and repeated ids
    come back as they are; other columns are ignored.
    """
    scanner = Scanner.of(rules)
    fields = pa.schema([("doc_id", pa.int64()), ("spans", SPAN_TYPE)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": scanner.rules[k].kind, "start": a, "end": b} for a, b, k in scanner.spans(x)] for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_TYPE)], schema=fields)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(scan, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each span of a secret replaced by mask (overlapping spans by one); all rows and columns stay."""
    scanner = Scanner.of(rules)
    at = docs.columns.index(text_col)

    def clean(data: bytes) -> str:
        text, done, parts = data.decode("utf-8", "replace"), 0, []
        for start, end, _ in scanner.spans(data):
            if start >= done:
                parts += [text[done:start], mask]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at)
            new = pa.array([None if null else clean(x) for x, null in zip(as_bytes(old), old.is_null().to_pylist(), strict=True)], old.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(scan, docs.schema)
