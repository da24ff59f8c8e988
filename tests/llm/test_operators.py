"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trovelight.llm.exact_dedup import MisraGries, exact_dedup
from trovelight.llm.line_dedup import apply_bitmaps, line_bitmaps
from trovelight.llm.packing import best_fit, pack_sequences
from trovelight.llm.pieces import PieceModel, decode_pieces, encode_pieces, model_path
from trovelight.llm.quality import RULES, TextFacts, apply_cascade, kept_documents, plan_cascade
from trovelight.llm.secrets import RULES as SECRET_RULES
from trovelight.llm.secrets import Scanner, redact_secrets, secret_spans
from trovelight.llm.simhash import segments, simhash, simhash_components
from trovelight.llm.suffix import multikey_quicksort, remove_repeats
from trovelight.llm.tokens import LINES, attribute, section_spans, section_token_counts, token_pieces, vocabulary

#: Names that the operators use for themselves.
CLASH = {"kept": "1", "fp": "2", "runs": "3", "digest": "4", "key": "5", "spans": "6", "h1": "7", "lines": "8", "row": "9", "n_chars": "10"}


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [words(r, r.randint(1, 120)) for _ in range(40)]
    rows = list(base)
    rows += [b.replace(" ", "  \n", 1) for b in base[:10]] + base[:15] + base[:1] * 30
    rows += [b + " x" for b in base[10:25]] + [b.upper() for b in base[:5]]
    common = "Shared  LINE"
    rows += [f"{common}\n{words(r, 8)}\n shared  line\t\n" for _ in range(14)]
    rows += [None, "", "", "\n\n", "é" * 3000, "long " * 20000, "token=abcdefgh12 é password: 'x' AKIA" + "A1" * 8, "0123456789abcdef" * 3]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % len(texts) if len(texts) % 3 else i, t) for i, t in enumerate(texts)]
    rows.append((None, texts[0]))
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def test_misra_gries_bound():
    r = random.Random(1)
    items = [min(int(r.expovariate(0.2)), 60) for _ in range(4000)]
    summary = MisraGries(10)
    for at in range(0, 4000, 171):
        summary.add(Counter(items[at : at + 171]))
    for x, n in Counter(items).items():
        assert n - 4000 / 11 <= summary.low[x] <= n


def test_exact_dedup(docs, rows, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = sorted((repr(i), repr(k := min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), i == k, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    for share in (1 / 256, 1 / 8):
        got = sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, share=share).collect())
        assert got == want
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize(("keep_first", "heavy"), [(False, 1000), (True, 2)])
def test_line_dedup(docs, rows, none, keep_first, heavy):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for d, t in set(rows):
        for k, line in enumerate((t or "").split("\n")):
            if key(line):
                seen[key(line)].add((d if d is not None else -1, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), k, d, t))
    want = []
    for d, t in rows:
        kept = []
        for k, line in enumerate((t or "").split("\n")):
            places = seen[key(line)] if key(line) else set()
            n_docs = len({p[3:] for p in places})
            first = min(places, default=None, key=lambda p: p[:3])
            if n_docs < 10 or keep_first and first[2:] == (k, d, t):
                kept.append(line)
        want.append((repr(d), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    out = apply_bitmaps(docs, line_bitmaps(docs, keep_first=keep_first, heavy_keys=heavy))
    assert set(CLASH) <= set(out.columns)
    got = [(repr(r.doc_id), r["_n_lines"], r["_n_dropped"], r["_kept_text"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert apply_bitmaps(none, line_bitmaps(none)).count() == 0


def repeat_words(w):
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_quality(docs, rows, none):
    cascade = plan_cascade(docs)
    assert sorted(r.name for r in cascade.rules) == sorted(r.name for r in RULES)
    facts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((repr(r.doc_id), *[r[f] for f in facts], r.kept) for r in apply_cascade(docs, cascade, facts=facts).collect())
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        some = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want.append((repr(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(some) - len(set(some)), repeat_words(w), not any(r.fails(TextFacts(t.encode())) for r in RULES)))
    assert got == sorted(want)
    back = plan_cascade(docs, rules=RULES[::-1])
    assert kept_documents(docs, back).count() == sum(r[-1] for r in got)
    assert kept_documents(docs, cascade).columns == docs.columns
    assert apply_cascade(none, plan_cascade(none)).count() == 0


def test_secrets_against_regex():
    patterns = [re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")]
    scanner = Scanner.of(SECRET_RULES)
    r = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "AKIA", "ABCD1234", "0123456789abcdef", "beef", ":", "=", " ", "'", '"', "==", "x", "é", "\n", "_", "A1"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        want = []
        for k, p in enumerate(patterns):
            for m in p.finditer(text.encode()):
                if not (k == 0 and len(m[1]) < 8 or k == 1 and len(m[0]) < 16 or k == 2 and len(m[0]) < 32):
                    want.append((len(text.encode()[: m.start()].decode()), len(text.encode()[: m.end()].decode()), k))
        assert [s for s in scanner.spans(text.encode()) if s[2] < 3] == sorted(want, key=lambda x: (x[0], x[2]))


def test_secret_operator(docs, rows, none):
    found = {repr(r.doc_id): [(s.kind, s.start, s.end) for s in r.spans] for r in secret_spans(docs).collect()}
    assert len(found) == len({repr(i) for i, _ in rows})
    for i, t in rows:
        if t and t.startswith("token"):
            assert [k for k, _, _ in found[repr(i)]] == ["assign", "access"]
    clean = redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not any(r.spans for r in secret_spans(clean).collect())
    assert clean.where("text is null").count() == docs.where("text is null").count()
    assert secret_spans(none).count() == 0


def test_sections():
    lengths = np.array([2, 3, 1, 4, 2])  # bytes 0-2, 2-5, 5-6, 6-10, 10-12
    assert attribute(lengths, np.array([[0, 4], [5, 9], [9, 12]])).tolist() == [2, 2, 1]
    assert attribute(np.array([2]), np.array([[0, 1], [1, 2]])).tolist() == [1, 0]  # a tie goes to the earlier
    assert section_spans(b"\n\nab\n\nc\n", LINES).tolist() == [[2, 4], [6, 7]]


def test_token_counts(docs, rows, none, bpe):
    out = section_token_counts(docs, *vocabulary())
    got = {(repr(r.doc_id), r.n_tokens, tuple((s.start, s.end, s.n_tokens) for s in r.sections)) for r in out.collect()}
    for i, t in rows:
        mine = [g for g in got if g[0] == repr(i) and g[1] == len(bpe.encode(t or "", add_special_tokens=False).ids)]
        assert mine
        for _, n, sections in mine:
            if sections:
                assert sum(s[2] for s in sections) == n
            if (t or "").replace("\n", "") and len(mine) == 1:
                spans = [m.span() for m in re.finditer(r"[^\n]+", t)]
                assert [s[:2] for s in sections] == spans
    assert section_token_counts(none, *vocabulary()).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_constraints(score):
    lengths = np.array([random.Random(2).randint(1, 100) for _ in range(1)] + [random.Random(k).randint(1, 100) for k in range(300)])
    where, offset = best_fit(lengths, 100, 4, 6000.0, score, (1.0, 0.5, 0.5))if lengths.max() ** 2 <= 6000 else best_fit(lengths, 100, 4, 10000.0, score, (1.0, 0.5, 0.5))
    for b in set(where.tolist()):
        mine = lengths[where == b]
        assert mine.sum() <= 100 and len(mine) <= 4 and (mine**2).sum() <= 10000
        order = np.argsort(offset[where == b])
        assert (np.cumsum(mine[order]) - mine[order]).tolist() == offset[where == b][order].tolist()


def test_packing(docs, rows, none, bpe):
    pieces = token_pieces(docs, *vocabulary(), capacity=64).cache()
    packed = pack_sequences(pieces, pieces.count(), tokens=64, shard_items=50).collect()
    by = defaultdict(list)
    for p in packed:
        by[p.sequence_id].append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = Counter()
    for p in packed:
        total[p.doc_id] += p.length
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
    want = Counter()
    for i, t in rows:
        want[i] += len(bpe.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == want
    assert len(by) <= sum(total.values()) / 64 * 1.2 + 5
    empty = token_pieces(none, *vocabulary())
    assert pack_sequences(empty, empty.count()).count() == 0


def brute_components(fps, distance):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, rows, none):
    got = Counter((repr(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash_components(docs).collect())
    fps = [simhash((t or "").encode()) for _, t in rows]
    labels = brute_components(fps, 4)
    smallest = {c: min((i for (i, _), x in zip(rows, labels, strict=True) if x == c and i is not None), default=None) for c in set(labels)}
    assert got == Counter((repr(i), fp, smallest[c]) for (i, _), fp, c in zip(rows, fps, labels, strict=True))
    assert simhash_components(none).count() == 0


@pytest.mark.parametrize(("block", "refined"), [(3, None), (2048, None), (2048, 1.0), (3, 1.0), (2048, 0.4)])
def test_links_in_crowded_buckets(spark, block, refined):
    from trovelight.llm.components import connected_components
    from trovelight.llm.simhash import links

    r = random.Random(9)
    fps = set()
    for _ in range(6):
        center = r.getrandbits(64)
        for _ in range(120):
            x = center
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps | {r.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(x - (1 << 64) * (x >> 63),) for x in fps], "fp long")
    found = {x.node % (1 << 64): x.component for x in connected_components(links(df, len(fps), 4, block, refined)).collect()}
    labels = brute_components(fps, 4)
    groups, ours = defaultdict(set), defaultdict(set)
    for x, c in zip(fps, labels, strict=True):
        groups[c].add(x)
        ours[found.get(x, ("alone", x))].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_refined_buckets_step_by_step(spark):
    """Rows of a fingerprint: 24 as long as buckets are small, five times as many at last, no jump between; refined buckets keep all links."""
    from trovelight.llm.simhash import bucket_rows, refined_share

    r = random.Random(12)
    pairs = []
    for _ in range(400):
        x = r.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))))
    df = spark.createDataFrame([(x - (1 << 64) * (x >> 63),) for p in pairs for x in p], "fp long").distinct()
    rows = {}
    for n in (1 << 20, 1 << 26, 3 << 25, 1 << 27, 3 << 26, 1 << 28, 1 << 36):
        rows[n] = bucket_rows(df, n, 4).count() / df.count()
        assert 0 <= refined_share(n, 21) <= 1
    told = list(rows.values())
    assert told[0] == told[1] and 23 < told[0] < 25 and told == sorted(told) and 115 < told[-1] < 121
    assert all(b < a + 41 for a, b in zip(told, told[1:-1], strict=False))
    for refined in (0.0, 0.5, 1.0):
        held = defaultdict(lambda: ([], []))
        for x in bucket_rows(df, 1, 4, refined).collect():
            held[x.key][x.probe].append(x.fp % (1 << 64))
        met = {frozenset((a, b)) for table, probes in held.values() for a in table for b in [*table, *probes]}
        assert all(frozenset(p) in met for p in pairs)


def test_segments_cover():
    for distance, count in ((4, 3), (4, 2), (4, 5), (8, 3)):
        parts = segments(distance, count)
        r = random.Random(distance + count)
        for _ in range(2000):
            bits = sum(1 << b for b in r.sample(range(64), distance))
            assert any(bin(bits >> shift & (1 << width) - 1).count("1") <= radius for shift, width, radius in parts)


def brute_repeats(data, length):
    """(id, bytes, kept bytes, removed runs) of each (id, bytes)."""
    counts = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if counts[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((repr(i), len(d), bytes(x for x, g in zip(d, gone, strict=True) if not g), runs))
    return sorted(out)


def removed(df, **options):
    return sorted((repr(r.doc_id), r.n_bytes, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in remove_repeats(df, **options).collect())


@pytest.mark.parametrize(("length", "options"), [(40, {}), (25, {"bucket_rows": 9, "heavy_grams": 3}), (400, {}), (400, {"bucket_rows": 5}), (7, {"bucket_rows": 20})])
def test_remove_repeats(docs, rows, none, length, options):
    data = [(i, (t or "").encode()[:4000].decode("utf-8", "ignore")) for i, t in rows]
    short = docs.sparkSession.createDataFrame(data, "doc_id long, text string")
    assert removed(short, length=length, **options) == brute_repeats([(i, t.encode()) for i, t in data], length)
    assert remove_repeats(none, length=length).count() == 0


@pytest.mark.parametrize("bucket_rows", [4, 30, 8192])
def test_repeats_across_boundaries(spark, bucket_rows):
    """Passages with many contexts each, near copies, periodic and binary-like texts, over buckets small and large."""
    r = random.Random(17)
    passage = "".join(r.choice("abcdefg \0") for _ in range(130))
    base = words(r, 200)
    texts = []
    for k in range(60):
        a, b = sorted((r.randrange(131), r.randrange(131)))
        texts.append("".join(r.choice("xyz\0") for _ in range(r.randrange(50))) + passage[a:b] + "".join(r.choice("xyz\0") for _ in range(r.randrange(50))))
        texts.append("".join(r.choice("xy") for _ in range(r.randrange(30))) + passage)
        texts.append(passage + "".join(r.choice("xy") for _ in range(r.randrange(30))))
        near = list(base)
        for _ in range(r.randrange(12)):
            near[r.randrange(len(near))] = r.choice("abc")
        texts.append("".join(near))
    texts += ["ab" * 100, "ab" * 90 + "c", "\0" * 70, "\0" * 61 + "q"]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert removed(df, length=60, bucket_rows=bucket_rows) == brute_repeats([(i, t.encode()) for i, t in data], 60)


def test_multikey_quicksort():
    r = np.random.default_rng(3)
    for n, high in ((0, 2), (1, 2), (500, 2), (3000, 3), (400, 1 << 62)):
        x = r.integers(0, high, (n, 5)).astype(np.uint64)
        order = multikey_quicksort(x)
        assert sorted(order.tolist()) == list(range(n))
        assert x[order].tolist() == sorted(x.tolist())


def test_anchors_by_parts(spark, monkeypatch):
    from trovelight.llm import suffix

    r = random.Random(4)
    df = spark.createDataFrame([(1, 1, words(r, 400)), (2, 2, "ab" * 300), (3, 3, "short")], "doc_id long, key long, text string")
    want = sorted(suffix.anchor_rows(df, 40, 20).collect())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "key": [1, 2, 3], "text": [x.text for x in df.orderBy("doc_id").collect()]})
    monkeypatch.setattr(suffix, "PART", 64)
    got = [tuple(x.values()) for out in suffix.anchor_finder(40, 20)(iter([batch])) for x in out.to_pylist()]
    assert sorted(got) == [tuple(x) for x in want]


def test_pieces(docs, rows, none):
    import sentencepiece

    model, given = PieceModel(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    odd = [" a", " a  b ", "a\tb\nc", "ａ①", "日本語 テスト🙂", "a\x00b", " " * 40, "x" * 80, ""]
    for t in odd + [t or "" for _, t in rows][:60]:
        assert model.encode(t[:3000]) == given.encode(t[:3000])
    for t in [*odd, "▁x▁ ▁", "﷐"]:
        for rate in (0.0, 0.1, 0.6):
            assert model.decode(model.encode(t, rate, 7, 3)) == t
    text = words(random.Random(1), 200)
    assert model.encode(text, 0.3, 1, 1) == PieceModel(model_path()).encode(text, 0.3, 1, 1)
    assert model.encode(text, 0.3, 1, 1) != model.encode(text, 0.3, 2, 1)
    back = decode_pieces(encode_pieces(docs, model_path(), 0.2, 5), model_path())
    assert Counter((repr(r.doc_id), r.text) for r in back.collect()) == Counter((repr(i), t or "") for i, t in rows)
    assert decode_pieces(encode_pieces(none, model_path()), model_path()).count() == 0


def test_dropout_by_occurrence(spark):
    """Each occurrence of a word has its own segmentation, with the odds of merge-dropout, alike in any batch."""
    model, rate = PieceModel(model_path()), 0.3
    word = "▁information"
    text = " ".join(["information"] * 3000)
    seen = Counter()
    for ids in (model.encode(text, rate, 1, 5), model.encode(text, rate, 1, 6)):
        parts, now = [], []
        for i in ids:
            if model.pieces[i].startswith("▁") and now:
                parts.append(tuple(now))
                now = []
            now.append(i)
        parts.append(tuple(now))
        assert len(parts) == 3000 and len(set(parts)) > 20
        seen.update(parts)
    r = random.Random(4)

    class Coin:
        def __contains__(self, _):
            return r.random() < rate

    want = Counter(model.segment(word, Coin()) for _ in range(6000))
    for ids, n in want.most_common(5):
        assert abs(n - seen[ids]) < 6 * (2 * n) ** 0.5
    assert model.encode(text, rate, 1, 5) != model.encode(text, rate, 1, 6)
    texts = [text[:500], "x" * 80 + " " + text[:300], "", "naïve ▁ 日本語 " * 9]
    many = model.encode_many(texts, [1, 2, 3, 4], rate, 9)
    assert [x.tolist() for x in many] == [PieceModel(model_path()).encode(t, rate, 9, d) for d, t in enumerate(texts, 1)]
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    one, two = (r.ids for r in encode_pieces(df, model_path(), 0.1, 1).orderBy("doc_id").collect())
    assert one != two and one == model.encode(text, 0.1, 1, 1)
    for skips in ((), (0,), (0, 2), (1, 3), (2,)):
        node = model.remember([word], [bytes(skips)])[0]
        assert np.frombuffer(model.made[node], "<i4").tolist() == list(model.segment(word, skips))


def plain_merges(model, unit, skips):
    """Merge-dropout spelled out: of all neighbours that join, the best and leftmost one that was not skipped, again and again."""
    parts, dead, nth = [(k, k + 1) for k in range(len(unit))], set(), -1
    while True:
        options = [(model.rank[unit[a:c]], a, k, (a, b, c)) for k, ((a, b), (_, c)) in enumerate(zip(parts, parts[1:], strict=False)) if unit[a:c] in model.rank and (a, b, c) not in dead]
        if not options:
            break
        _, a, k, name = min(options)
        nth += 1
        if nth in skips:
            dead.add(name)
        else:
            parts[k : k + 2] = [(a, name[2])]
    out = []
    for a, b in parts:
        piece = unit[a:b]
        out += [model.ids[piece]] if piece in model.ids else [model.byte_id[x] for x in piece.encode()]
    return tuple(out)


def test_pieces_held_in_arrays():
    """What is remembered lies in arrays, which grow and are dropped without changing an id."""
    model, r = PieceModel(model_path()), random.Random(8)
    words = ["".join(r.choice("etaoinshrdlué\U0001f642") for _ in range(r.randint(1, 40))) for _ in range(70_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)] + ["", "  ", words[0]]
    documents = list(range(len(texts)))
    first = model.encode_many(texts, documents, 0.1, 3)
    assert model.made.ids.dtype == np.int32 and len(model.made) > 1 << 16
    assert all(np.array_equal(a, b) for a, b in zip(first, model.encode_many(texts, documents, 0.1, 3, remember=1000), strict=True))
    for t, ids in zip(texts[:20], model.encode_many(texts[:20], documents[:20]), strict=True):
        assert ids.tolist() == [i for w in t.split(" ") for i in model.segment("▁" + w)]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_merges_of_many_units(rate):
    """Units segmented at once, one by one by agenda, and by a plain loop give the same ids under the same skips."""
    model, r = PieceModel(model_path()), random.Random(int(100 * rate))
    real = ["▁international", "▁organisation", "▁the", "▁unbelievably", "ing", "▁▁▁x", "▁straße", "▁日本語", "▁a" * 9, "▁information" * 2, "▁\U0001f642é"]
    units = [*real, *("▁" + "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 24))) for _ in range(300))] * 3
    skips = [tuple(k for k in range(60) if r.random() < rate) for _ in units]
    want = [plain_merges(model, u, set(s)) for u, s in zip(units, skips, strict=True)]
    assert [model.segment(u, set(s)) for u, s in zip(units, skips, strict=True)] == want
    short = [(u, bytes(s)) for u, s in zip(units, skips, strict=True) if len(u) <= 32]
    nodes = model.remember([u for u, _ in short], [s for _, s in short])
    assert [tuple(np.frombuffer(model.made[k], "<i4").tolist()) for k in nodes] == [w for u, w in zip(units, want, strict=True) if len(u) <= 32]
