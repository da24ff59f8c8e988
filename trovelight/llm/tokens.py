"""Byte-level BPE over whole texts, and token counts by offset-mapped attribution.

A document is encoded once. Byte-level tokens tile the text's bytes, so their lengths give each token's
span; spans of sections (here: paragraphs or lines) come from the text. An interval join of the two sorted
lists attributes every token. A token that crosses section boundaries goes, whole, to the section with most
of its bytes, the earlier one on a tie; bytes between sections (separators) count for the section before
them, those ahead of the first for the first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes


@lru_cache(maxsize=4)
def byte_bpe(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...] = ()):  # noqa: ANN201
    """(encode, lengths): bytes to a list of ids, and the byte length of each token by id. Special strings in a text are one id each."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max([*ranks.values(), *(i for _, i in specials)]) + 1, dtype=np.int64)
    for token, rank in [*ranks.items(), *((s.encode(), i) for s, i in specials)]:
        lengths[rank] = len(token)
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
    names = [s.encode() for s, _ in specials]

    def encode(data: bytes) -> list[int]:
        text = data.decode("utf-8", "replace")
        return encoder.encode(text, allowed_special="all") if any(s in data for s in names) else encoder.encode_ordinary(text)

    return encode, lengths


#: Fixed value: the special string of the 50k vocabulary and its id.
SPECIALS = (("<|endoftext|>", 50256),)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a public vocabulary; both are parameters of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


#: Where sections end: a section is text between separators, without them. Empty sections don't count.
PARAGRAPHS = rb"\n[ \t]*\n\s*"
LINES = rb"\n"


def section_spans(data: bytes, separator: bytes) -> np.ndarray:
    """Rows (start, end) in bytes of the non-empty sections, in order."""
    cuts = [m.span() for m in re.finditer(separator, data)]
    starts = [0, *(b for _, b in cuts)]
    ends = [*(a for a, _ in cuts), len(data)]
    return np.array([(a, b) for a, b in zip(starts, ends, strict=True) if b > a], dtype=np.int64).reshape(-1, 2)


def attribute(token_lengths: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Tokens of each section. Every token of a text with a section is counted once; see the module's rule."""
    if not len(sections):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(token_lengths)
    starts = ends - token_lengths
    edges = sections[1:, 0]  # section k owns the bytes from edge k - 1 up to edge k
    first = np.searchsorted(edges, starts, "right")
    last = np.searchsorted(edges, ends - 1, "right")
    owner = first.copy()
    for t in np.nonzero(first != last)[0]:  # few: tokens across an edge
        bounds = np.concatenate([[starts[t]], edges[first[t] : last[t]], [ends[t]]])
        owner[t] = first[t] + int(np.argmax(np.diff(bounds)))
    return np.bincount(owner, minlength=len(sections))


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, separator: bytes = LINES, id_col: str = "doc_id", text_col: str = "text", specials: tuple[tuple[str, int], ...] = SPECIALS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, sections array<struct<start, end, n_tokens>>.

    start and end are code points, end exclusive. The sections' tokens sum to n_tokens; a text of
    separators alone has tokens but no sections. Null and empty texts have neither. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())]))
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("sections", kind)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = byte_bpe(ranks_path, pattern, specials)
        for batch in batches:
            totals, places, offsets = [], [], [0]
            for data in as_bytes(batch.column(1)):
                ids = np.array(encode(data), dtype=np.int64)
                spans = section_spans(data, separator)
                counts = attribute(lengths[ids], spans)
                if not data.isascii() and len(spans):
                    # Code points ahead of byte i: bytes up to i that don't continue one.
                    ahead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                    spans = ahead[spans]
                totals.append(len(ids))
                places.append(np.column_stack([spans, counts]))
                offsets.append(offsets[-1] + len(spans))
            rows = np.concatenate(places) if places else np.zeros((0, 3), dtype=np.int64)
            structs = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], names=["start", "end", "n_tokens"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), lists], schema=fields)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id bigint, n_tokens bigint, sections array<struct<start: bigint, end: bigint, n_tokens: bigint>>")


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", specials: tuple[tuple[str, int], ...] = SPECIALS) -> DataFrame:
    """Documents as pieces of at most capacity ids: doc_id, piece, start, length, ids (little-endian uint32 bytes).

    A document is its ids and then end_id. One that is longer than capacity is cut into pieces of
    capacity ids, all but the first, which takes the remainder. Null and empty texts are end_id alone.
    Every row is a document of its own, also where ids are null or repeat. Other columns are not looked at;
    an empty table gives no pieces. A worker holds one text's ids at a time beside a batch's pieces.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = byte_bpe(ranks_path, pattern, specials)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = np.array([*encode(data), end_id], dtype="<u4")
                start, stop = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((doc_id, piece, start, stop - start, ids[start:stop].tobytes()))
                    start, stop = stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, fields, strict=True)], schema=fields)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")
