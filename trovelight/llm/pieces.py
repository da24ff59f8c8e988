"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary of a merge-type model gives the merges: two neighbours join if their text is a piece, best
score first, leftmost on a tie. While the agenda is worked off, each candidate merge is skipped with the
dropout rate. A unit is a run of spaces with the word behind it; no piece reaches across. A hash keyed by seed,
document and the unit's place in it decides which of its candidates are skipped (as the gaps between skips,
which are geometric), so every occurrence of a word is segmented by itself, and alike in a rerun. What is
remembered are results by unit and skipped candidates, which any occurrence may meet; the decisions never are.
Rate 0 gives the model's own segmentation. Characters that are no piece become byte pieces, and so does a
literal U+2581, which would otherwise come back as a space.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches

SPACE = "▁"
_RAW = "\udc81"  # no text holds a lone surrogate; it stands for a literal U+2581 while a text is cut
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public model; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)

#: Longer units are rare and are segmented one by one.
LONG = 32
#: Beyond all candidates of an agenda.
_NONE = np.int32(1 << 30)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_keys(document: int, seed: int, n: int) -> np.ndarray:
    """The hash seeds of the n units of a document, by place."""
    return _mix(np.arange(n, dtype=np.uint64) * _GOLDEN + np.uint64(xxhash.xxh64_intdigest(str(document), seed & 0xFFFFFFFFFFFFFFFF)))


def skip_gaps(keys: np.ndarray, nth: int | np.ndarray, rate: float) -> np.ndarray:
    """Candidates that are not skipped ahead of the nth skip and behind the one before: a hash of key and nth."""
    if rate >= 1:
        return np.zeros(np.broadcast(keys, nth).shape, np.int64)
    share = ((_mix(keys + _GOLDEN * np.asarray(nth + 1, np.uint64)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return np.minimum(np.log(share) / np.log1p(-rate), 2.0**31).astype(np.int64)


class Results:
    """Ids of nodes, one behind the other, in arrays that grow. An item is a node's ids as bytes."""

    def __init__(self) -> None:
        self.begin, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.nodes = self.used = 0

    def __len__(self) -> int:
        return self.nodes

    def __getitem__(self, node: int) -> bytes:
        return self.ids[self.begin[node] : self.begin[node] + self.count[node]].tobytes()

    def extend(self, nodes: int) -> None:
        """More nodes, without ids so far."""
        self.nodes += nodes
        if self.nodes > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * self.nodes), np.resize(self.count, 2 * self.nodes)

    def put(self, nodes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        ends = self.used + np.cumsum(counts)
        self.begin[nodes], self.count[nodes] = ends - counts, counts
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def joined(self, nodes: np.ndarray, others: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all nodes in turn, and how many each has; others gives those at some places."""
        counts = self.count[nodes]
        for i, ids in others.items():
            counts[i] = len(ids)
        starts = np.cumsum(counts) - counts
        from_ = np.repeat(self.begin[nodes] - starts, counts)
        from_ += np.arange(len(from_))
        for i, ids in others.items():
            from_[starts[i] : starts[i] + len(ids)] = 0
        out = self.ids[from_]
        for i, ids in others.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, counts


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.byte_id = [0] * 256
        self.raw = np.full(n, b"", object)
        for i in range(n):
            if model.is_byte(i):
                value = int(self.pieces[i][3:5], 16)
                self.byte_id[value], self.raw[i] = i, bytes([value])
            elif not model.is_control(i) and not model.is_unknown(i):
                self.raw[i] = self.pieces[i].replace(SPACE, " ").encode()
        # For batches: ids of characters (beyond the vocabulary where they are no piece), and all joins of two symbols.
        self.char_id = {c: self.ids[c] for c in self.ids if len(c) == 1}
        for c in sorted({c for piece in self.ids for c in piece} - set(self.char_id)):
            self.char_id[c] = n + len(self.char_id)
        known = self.ids | self.char_id
        self.of_char = np.full(0x110000, -2, np.int32)
        self.of_char[[ord(c) for c in self.char_id]] = list(self.char_id.values())
        self.agenda_key = np.full(n + 1, _NONE, np.int32)  # the last one is that of no piece
        self.slot_key, self.slot_id = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, np.int32)
        for rank, piece in enumerate(sorted((p for p in self.ids), key=lambda p: self.rank[p])):
            made = self.ids[piece]
            self.agenda_key[made] = rank << 6
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                if a is not None and b is not None:
                    key = a << 20 | b
                    slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44
                    while self.slot_key[slot] >= 0:
                        slot = (slot + 1) & 0xFFFFF
                    self.slot_key[slot], self.slot_id[slot] = key, made
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered: results (nodes) by unit and skipped candidates. Node 0 stands for long units."""
        self.units, self.skips = [""], [b""]
        self.made = Results()
        self.made.extend(1)
        self.popped = np.zeros(1 << 16, np.int64)
        self.root: dict[str, int] = {}
        self.child: dict[int, int] = {}  # by node << 8 | the next candidate that is skipped

    def segment(self, unit: str, skips: Collection[int] = ()) -> tuple[int, ...]:
        """Ids of one unit by agenda; skips are the candidates to skip, by their number in the order of the agenda."""
        rank, nth = self.rank, -1
        parts: list[str | None] = list(unit)
        n = len(parts)
        agenda = [(rank[pair], i, pair) for i, pair in enumerate(map(add, unit, unit[1:])) if pair in rank]
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapify(agenda)
            while agenda:
                _, i, pair = heappop(agenda)
                left, j = parts[i], after[i]
                if left is None or j >= n or left + parts[j] != pair:
                    continue  # one of the two has merged otherwise since
                nth += 1
                if nth in skips:
                    continue
                parts[i], parts[j] = pair, None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    wider = pair + parts[k]
                    if wider in rank:
                        heappush(agenda, (rank[wider], i, wider))
                if (h := before[i]) >= 0:
                    wider = parts[h] + pair
                    if wider in rank:
                        heappush(agenda, (rank[wider], h, wider))
        ids = self.ids
        out: list[int] = []
        for part in parts:
            if part is not None:
                found = ids.get(part)
                if found is None:
                    out += [self.byte_id[b] for b in part.replace(_RAW, SPACE).encode("utf-8", "replace")]
                else:
                    out.append(found)
        return tuple(out)

    def remember(self, units: list[str], skips: list[bytes]) -> range:
        """Nodes of units of at most LONG characters and their skipped candidates: segment() of many units at once."""
        first = len(self.made)
        nodes = range(first, first + len(units))
        self.units += units
        self.skips += skips
        self.made.extend(len(units))
        if len(self.made) > len(self.popped):
            self.popped = np.resize(self.popped, 2 * len(self.made))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        for low, high in ((1, 8), (9, 16), (17, LONG)):
            rows = np.nonzero((lengths >= low) & (lengths <= high))[0]
            for at in range(0, len(rows), 16384):
                part = rows[at : at + 16384]
                chosen = part.tolist()
                self.popped[first + part], symbols = self._rounds([units[i] for i in chosen], lengths[part], [skips[i] for i in chosen])
                self._spell(first + part, [units[i] for i in chosen], symbols)
        return nodes

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of left and right joined, -1 where they don't join: a look-up by open addressing."""
        wanted = left.astype(np.int64) << 20 | right
        slot = (wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)
        there = self.slot_key[slot]
        hit = there == wanted
        found = np.where(hit, self.slot_id[slot], np.int32(-1))
        open_ = np.flatnonzero(~hit & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & 0xFFFFF
            there = self.slot_key[slot[open_]]
            hit = there == wanted[open_]
            found[open_[hit]] = self.slot_id[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def _rounds(self, units: list[str], lengths: np.ndarray, skips: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates worked off of each unit, and its symbols in a column. Each round pops one candidate of every agenda.

        The character at place p of unit r is at p * n + r of all arrays, so a round's least candidates are minima
        of whole lines. A candidate is its rank * 64 + its place.
        """
        n, wide = len(units), int(lengths.max())
        flat = np.frombuffer(b"".join(skips), np.uint8)
        skipped = np.zeros((2 + int(flat.max(initial=0)), n), bool)  # none in the last line
        skipped[flat, np.repeat(np.arange(n), np.fromiter(map(len, skips), np.int64, n))] = True
        popped, nth = np.zeros(n, np.int64), 0
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = place * n + owner
        symbol = np.full((wide + 1) * n, -1, np.int32)  # the last line stands for the ends
        symbol[at] = self.of_char[flat]
        after = np.arange(n, (wide + 2) * n)
        after[(lengths - 1) * n + np.arange(n)] = wide * n + np.arange(n)
        before = np.arange(-n, (wide + 1) * n - n)  # below 0 ahead of the first
        joined = np.full(wide * n, -1, np.int32)
        agenda = np.full((wide, n), _NONE, np.int32)
        line = agenda.reshape(-1)

        def offer(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            known = np.flatnonzero((left >= 0) & (right >= 0))
            made = np.full(len(at), -1, np.int32)
            made[known] = self._pairs(left[known], right[known])
            joined[at] = made
            line[at] = self.agenda_key[made] + (at // n).astype(np.int32)

        inner = at[place + 1 < lengths[owner]]
        offer(inner, symbol[inner], symbol[inner + n])
        rows, every = np.arange(n), agenda
        while len(rows):
            least = every.min(axis=0)
            live = least < _NONE
            if not live.all():
                popped[rows[~live]] = nth
                rows, least = rows[live], least[live]
                if not len(rows):
                    break
            i = (least & 63) * n + rows
            line[i] = _NONE
            if nth < len(skipped) - 1:
                i = i[~skipped[nth, rows]]
            nth += 1
            j = after[i]
            k = after[j]
            made = joined[i]
            symbol[i], symbol[j] = made, -1
            line[j] = _NONE
            after[i], before[k] = k, i
            h = before[i]
            ahead = h >= 0
            h = h[ahead]
            offer(np.concatenate([i, h]), np.concatenate([made, symbol[h]]), np.concatenate([symbol[k], made[ahead]]))
            every = agenda if len(rows) == n else agenda[:, rows]
        return popped, symbol.reshape(wide + 1, n)[:wide]

    def _spell(self, nodes: np.ndarray, units: list[str], symbols: np.ndarray) -> None:
        """Put the ids of units by their symbols, a column for each."""
        shown = symbols >= 0
        self.made.put(nodes, shown.sum(axis=0, dtype=np.int32), np.ascontiguousarray(symbols.T)[np.ascontiguousarray(shown.T)])
        odd = np.nonzero(((symbols < -1) | (symbols >= len(self.pieces))).any(axis=0))[0]
        spelt: list[int] = []
        ends = []
        for r, line in zip(odd.tolist(), symbols[:, odd].T.tolist(), strict=True):  # characters that are no piece
            for ch, x in zip(units[r], line, strict=False):
                if 0 <= x < len(self.pieces):
                    spelt.append(x)
                elif x != -1:
                    spelt += [self.byte_id[b] for b in ch.replace(_RAW, SPACE).encode("utf-8", "replace")]
            ends.append(len(spelt))
        self.made.put(nodes[odd], np.diff(ends, prepend=0).astype(np.int64), np.array(spelt, np.int32))

    def encode_many(self, texts: list[str], documents: list[int], rate: float = 0.0, seed: int = 0, remember: int = 600_000) -> list[np.ndarray]:
        """Ids of each text. Seed, document and place decide the skipped merges of each unit."""
        if len(self.made) > remember:  # memory stays bounded, and the result is the same
            self.forget()
        cut = [_UNIT.findall(SPACE + t.replace(SPACE, _RAW).replace(" ", SPACE)) if t else [] for t in texts]
        units = list(chain.from_iterable(cut))
        node = np.fromiter(map(self.root.get, units, repeat(0)), np.int64, len(units))
        new = np.nonzero(node == 0)[0]
        unknown = [units[i] for i in new.tolist()]
        wanted = [u for u in set(unknown) if len(u) <= LONG]
        self.root.update(zip(wanted, self.remember(wanted, [b""] * len(wanted)), strict=True))
        node[new] = np.fromiter(map(self.root.get, unknown, repeat(0)), np.int64, len(unknown))
        keys = np.concatenate([unit_keys(d, seed, len(c)) for d, c in zip(documents, cut, strict=True)]) if cut else np.zeros(0, np.uint64)
        at, nth = np.full(len(units), -1, np.int64), 0
        still = np.nonzero(node)[0] if rate > 0 else np.zeros(0, np.int64)
        while len(still):  # on to the node of the next skip, where there is one
            at[still] += 1 + skip_gaps(keys[still], nth, rate)
            nth += 1
            still = still[at[still] < self.popped[node[still]]]
            steps, back = np.unique(node[still] << 8 | at[still], return_inverse=True)
            steps = steps.tolist()
            new = [s for s in steps if s not in self.child]
            skips = [self.skips[s >> 8] + bytes((s & 255,)) for s in new]
            self.child.update(zip(new, self.remember([self.units[s >> 8] for s in new], skips), strict=True))
            node[still] = np.fromiter(map(self.child.__getitem__, steps), np.int64, len(steps))[back]
        others = {}
        for i in np.nonzero(node == 0)[0].tolist():
            skips = np.cumsum(1 + skip_gaps(keys[i], np.arange(3 * len(units[i])), rate)) - 1 if rate > 0 else np.zeros(0, np.int64)
            others[i] = np.array(self.segment(units[i], set(skips.tolist())), np.int32)
        flat, counts = self.made.joined(node, others)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, cut)])]
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def encode(self, text: str, rate: float = 0.0, seed: int = 0, document: int = 0) -> list[int]:
        return self.encode_many([text], [document], rate, seed)[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text whose encoding, at any rate and seed, is ids."""
        return b"".join(self.raw[np.asarray(ids, np.int64)].tolist())[1:].decode("utf-8", "replace") if len(ids) else ""


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>; one row per row of docs. Null and empty texts have no ids. Other columns are ignored."""
    bound_batches(docs.sparkSession, "2m")
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in as_bytes(batch.column(1))]
            ids = model.encode_many(texts, [d or 0 for d in batch.column(0).to_pylist()], rate, seed)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat).cast(fields.field("ids").type)], schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: what encode_pieces() was given. Null ids and empty ones are the empty text."""
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            texts = [model.decode(x) for x in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(fields.field("ids").type), pa.array(texts, pa.string())], schema=fields)

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, ids array<int>, text string")
