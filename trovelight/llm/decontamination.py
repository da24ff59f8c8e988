"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds every run of words of the test items. A document's words are streamed through it; at
each word its state and the matching length tell the longest run of item words that ends there. Windows are
marks on states: a window that ends at a word is a mark on the state or one behind it by suffix links, no
longer than the matching length.

Items are cut into pieces that overlap by a window less a word, so a piece is bounded, and come in blocks of
bounded size: an automaton per block is built on the driver and broadcast. Documents are never moved; with
several blocks only documents with matches are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, unused
from .words import plain_words, word_parts

#: Text of the items that one automaton holds at most, with one piece more: some 170,000 words, 340,000 states.
ITEM_BYTES = 1 << 20
#: Bytes of text in a piece of an item.
PIECE_BYTES = 1 << 16


class ItemAutomaton:
    """Generalised suffix automaton of word sequences with marks for windows. State 0 is the root."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.marks: list[list[tuple[int, int]]] = []  # of each state: (words, number of the window)
        self.up: list[int] = []  # nearest state with marks, itself included
        self.items: list[list[str]] = []  # of each window: the items that hold it
        self.least = 1 << 30

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """q if it is as short as p and word make it, else a state split off from it that is."""
        if self.length[q] == self.length[p] + 1:
            return q
        split = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = split
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = split
            p = self.link[p]
        return split

    def _extend(self, p: int, word: int) -> int:
        if (q := self.next[p].get(word)) is not None:
            return self._split(p, q, word)
        made = self._state(self.length[p] + 1, {}, 0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][word], word)
        return made

    @classmethod
    def of(cls, pieces: list[tuple[str, bytes, int]]) -> ItemAutomaton:
        """pieces: item, its words joined by spaces, words of a window."""
        made = cls()
        number = made.vocabulary
        told = [(item, [number.setdefault(w, len(number)) for w in text.split()], size) for item, text, size in pieces]
        for _, ids, _ in told:
            state = 0
            for word in ids:
                state = made._extend(state, word)
        made.marks = [[] for _ in made.length]
        window: dict[tuple[int, int], int] = {}
        for item, ids, size in told:
            made.least = min(made.least, size)
            state = n = 0
            for word in ids:  # the state of the last size words, word by word
                state, n = made.next[state][word], min(n + 1, size)
                while made.length[made.link[state]] >= n:
                    state = made.link[state]
                if n == size:
                    if (state, size) not in window:
                        window[state, size] = len(made.items)
                        made.marks[state].append((size, len(made.items)))
                        made.items.append([])
                    held = made.items[window[state, size]]
                    if not held or held[-1] != item:
                        held.append(item)
        made.up = [-1] * len(made.length)
        for s in sorted(range(1, len(made.length)), key=made.length.__getitem__):
            made.up[s] = s if made.marks[s] else made.up[made.link[s]]
        return made

    def matches(self, data: bytes) -> tuple[int, list[list[int]], set[str]]:
        """(words of a text, runs [start, end) of words inside windows, items whose windows occur)."""
        follow, link, length, up, least, get = self.next, self.link, self.length, self.up, self.least, self.vocabulary.get
        state = n = at = 0
        runs: list[list[int]] = []
        seen: set[int] = set()
        for words in word_parts(data):
            for k, word in enumerate(map(get, words), at):
                if word is None:
                    state = n = 0
                    continue
                to = follow[state].get(word)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = follow[state].get(word)
                state, n = to or 0, n + 1 if to else 0
                if n >= least and (mark := up[state]) >= 0:
                    longest = self._occurring(mark, n, seen)
                    if longest:
                        _cover(runs, k - longest + 1, k + 1)
            at += len(words)
        return at, runs, {item for w in seen for item in self.items[w]}

    def _occurring(self, mark: int, n: int, seen: set[int]) -> int:
        """Words of the longest window of at most n words among a state's marks and those behind it; all go to seen."""
        longest = 0
        while mark >= 0:
            for size, window in self.marks[mark]:
                if size <= n:
                    seen.add(window)
                    longest = max(longest, size)
            mark = self.up[self.link[mark]]
        return longest


def _cover(runs: list[list[int]], start: int, end: int) -> None:
    """Add [start, end), which ends behind all of runs, to runs that don't touch."""
    while runs and runs[-1][1] >= start:
        start = min(start, runs.pop()[0])
    runs.append([start, end])


def item_pieces(items: DataFrame, id_col: str, text_col: str, length: int, coverage: float) -> DataFrame:
    """item, text (words joined by spaces, about PIECE_BYTES at most), size: words of the item's window. Items without words give none."""
    fields = pa.schema([("item", pa.string()), ("text", pa.binary()), ("size", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                size = min(length, max(1, ceil(coverage * sum(map(len, word_parts(data))))))
                tail: list[bytes] = []
                for words in word_parts(data, PIECE_BYTES):
                    words = tail + words
                    tail = words[len(words) - size + 1 :] if len(words) >= size else words
                    if len(words) >= size:
                        yield pa.RecordBatch.from_pylist([{"item": item, "text": b" ".join(words), "size": size}], schema=fields)

    told = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return told.mapInArrow(cut, "item string, text binary, size int")


SPANS = "array<struct<start: bigint, end: bigint, first_byte: bigint, end_byte: bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))


def _with_bytes(data: bytes, runs: list[list[int]]) -> list[dict[str, int]]:
    """Runs of words with the bytes from the first word's start to the last one's end."""
    out, todo, first = [], iter(runs), 0
    start, end = next(todo, (-1, -1))
    for at, m in enumerate(re.finditer(rb"[^ ]+", plain_words(data))) if runs else ():
        if at == start:
            first = m.start()
        if at == end - 1:
            out.append({"start": start, "end": end, "first_byte": first, "end_byte": m.end()})
            start, end = next(todo, (-1, -1))
    return out


def _scan(docs: DataFrame, automaton: ItemAutomaton | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_hash, n_words, spans, items of every row of docs, by one automaton."""
    held = docs.sparkSession.sparkContext.broadcast(automaton or ItemAutomaton.of([]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = held.value.matches
        for batch in batches:
            counts, spans, items = [], [], []
            for data in as_bytes(batch.column(2)):
                n, runs, found = find(data)
                counts.append(n)
                spans.append(_with_bytes(data, runs))
                items.append(sorted(found))
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_hash", "n_words", "spans", "items"])

    told = docs.select(F.col(id_col).alias("doc_id"), _row_hash(text_col).alias("row_hash"), F.col(text_col).cast("string").alias("text"))
    return told.mapInArrow(run, f"doc_id {kind}, row_hash bigint, n_words bigint, spans {SPANS}, items array<string>")


def _row_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def item_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", length: int = 10, coverage: float = 1.0, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, row_hash (of the text), n_words, spans, items.

    An item's window is length consecutive words of it, or so many as make up the share coverage of the item if these are
    fewer (one at least). spans are the maximal runs of words inside occurrences of windows, as word positions and as
    bytes of the UTF-8 text; items are the ids, as sorted strings, of the items with occurring windows. A null or empty text has no words, a null
    or empty item no windows; no items match nothing. Rows that repeat an item's id are one item with several texts;
    items without an id are one named by the empty string. Repeated rows of docs and null ids come back as they are; no rows
    give none. Texts are read whole, a few megabytes of words at a time.
    """
    pieces = materialize(item_pieces(items, item_id_col, item_text_col, length, coverage), "item-pieces")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    of_block = lambda b: [(r.item, bytes(r.text), r.size) for r in pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()]
    if blocks == 1:
        return _scan(docs, ItemAutomaton.of(of_block(0)), id_col, text_col)
    scanned = [materialize(_scan(docs, ItemAutomaton.of(of_block(b)), id_col, text_col).where(F.size("spans") > 0), "matches") for b in range(blocks)]
    found = scanned[0]
    for more in scanned[1:]:
        found = found.unionByName(more)
    merged = found.groupBy("doc_id", "row_hash").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = merged.select(F.col("doc_id").alias("mid"), F.col("row_hash").alias("mhash"), _joined("spans").alias("m_spans"), F.col("items").alias("m_items"))
    counted = _scan(docs, None, id_col, text_col)
    both = counted.join(merged, F.col("doc_id").eqNullSafe(F.col("mid")) & (F.col("row_hash") == F.col("mhash")), "left")
    return both.select("doc_id", "row_hash", "n_words", F.coalesce("m_spans", "spans").alias("spans"), F.coalesce("m_items", "items").alias("items"))


def _joined(spans: str) -> Column:
    """Sorted spans with those that touch made one."""

    def add(held: Column, s: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], s["end_byte"]).alias("end_byte"))
        touches = (F.size(held) > 0) & (last["end"] >= s["start"])
        return F.when(touches, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(wide))).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS), add)


def remove_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.5, **options: object) -> DataFrame:
    """docs without the spans of item_matches(), each from its first word's start to its last one's end.

    A row of whose words more than the share most are in spans goes altogether. Every other row stays, repeated ones
    too, with its columns, whatever their names; a text without spans, null among them, is as it was.
    """
    found = item_matches(docs, items, id_col, text_col, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    hits = found.where(F.size("spans") > 0).select("doc_id", "row_hash", "spans", (hit > most * F.col("n_words")).alias("goes")).distinct()
    spans, goes, key, code = (unused(docs, name) for name in ("spans", "goes", "match_id", "match_hash"))
    hits = hits.select(F.col("doc_id").alias(key), F.col("row_hash").alias(code), F.col("spans").alias(spans), F.col("goes").alias(goes))
    both = docs.join(hits, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (_row_hash(f"`{text_col}`") == F.col(code)), "left").where(F.coalesce(~F.col(goes), F.lit(True)))
    data = F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(spans, lambda s: F.array(s["first_byte"], s["end_byte"]))), F.array(F.octet_length(data).cast("long")))
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring(data, (F.get(edges, 2 * k) + 1).cast("int"), (F.get(edges, 2 * k + 1) - F.get(edges, 2 * k)).cast("int")))
    text = F.when(F.col(spans).isNull(), F.col(f"`{text_col}`").cast("string")).otherwise(F.decode(F.aggregate(kept, F.lit(b""), lambda a, b: F.concat(a, b)), "UTF-8"))
    return both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
