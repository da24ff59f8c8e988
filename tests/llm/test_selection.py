"""Ranked search, decontamination and importance resampling against brute force, on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.llm import importance
from trovelight.llm.decontamination import ItemAutomaton, item_matches, remove_matches
from trovelight.llm.importance import TournamentTree, resample
from trovelight.llm.queries import QUERIES
from trovelight.llm.ranked_search import Chunk, ranked_search
from trovelight.llm.words import word_parts

SF = "/root/testdata/sf0.001"


def plain(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def words(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    r = random.Random(11)
    items = [(k, words(r, r.choice((1, 2, 5, 9, 10, 11, 40)), "abcd")) for k in range(40)]
    items += [(3, "second text of item three"), (None, "Nameless Item"), (50, None), (51, ""), (52, "..."), (53, "É über İx 日本語 a1"), (54, items[6][1]), (10, items[12][1])]
    docs = [words(r, r.randint(0, 60), "abcd") for _ in range(60)]
    for k in range(60):
        cut = (items[r.randrange(40)][1]).split()
        a = r.randrange(len(cut))
        docs.append(words(r, 12) + ", " + " - ".join(cut[a:]).upper() + "\n" + words(r, r.randint(0, 9)))
    docs += [docs[0]] * 5 + [None, "", "...", "é über İX 日本語. A1 z", "a b " * 4000, "SECOND text, of item three", items[6][1] + items[6][1]]
    rows = [(k, t) for k, t in enumerate(docs)]
    rows += [(None, docs[70]), (None, docs[71]), (5, docs[5]), (5, docs[72]), (900, docs[3])]
    return rows, items


@pytest.fixture(scope="module")
def frames(spark, data):
    docs = spark.createDataFrame(data[0], "doc_id long, text string")
    for name in ("item_id", "n", "terms", "spans", "goes", "match_id", "score", "place", "rank", "range"):
        docs = docs.withColumn(name, F.lit("1"))
    return docs.repartition(4).cache(), spark.createDataFrame(data[1], "item_id long, text string").withColumn("doc_id", F.lit(1)).repartition(2).cache()


def test_word_parts():
    text = ("Ab,c\xa0é  x9 " * 50).encode()
    for part in (1, 7, 1 << 22):
        assert [w.decode() for p in word_parts(text, part) for w in p] == plain(text.decode())


def brute_search(docs, items, k):
    docs = [(i, Counter(plain(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 75 + (25 * c.total() * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(repr(item), rank, repr(None if gone else i), -s) for rank, (s, gone, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "options"), [(20, {}), (3, {"chunk_postings": 50}), (7, {"query_bytes": 300, "chunk_postings": 500})])
def test_ranked_search(data, frames, k, options):
    docs, items = frames
    found = ranked_search(docs, items, k=k, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.schema["rank"].dataType.simpleString() == "int"
    assert Counter((repr(r.item_id), r.rank, repr(r.doc_id), r.score) for r in found.collect()) == brute_search(*data, k)
    assert ranked_search(docs.where("doc_id < 0"), items, k=k).count() == 0
    assert ranked_search(docs, items.where("item_id < 0"), k=k).count() == 0


def test_threshold_stops_early():
    """Lists are read no further than the threshold asks, and ties at the k-th place still go by id."""
    r = np.random.default_rng(2)
    n = 20_000
    doc = np.repeat(np.arange(n), 3)
    impact = np.sort(r.pareto(1.0, 3 * n) * 1000).astype(np.int64)[r.permutation(3 * n)]
    chunk = Chunk(np.arange(n)[::-1].copy(), doc, np.tile(np.arange(3), n), impact, 3)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    (scores, ids), read = chunk.search(np.arange(3), np.array([1, 2, 1]), 10, nothing)
    total = impact.reshape(-1, 3) @ np.array([1, 2, 1])
    order = np.lexsort((chunk.doc_ids, -total))[:10]
    assert scores.tolist() == total[order].tolist() and ids.tolist() == chunk.doc_ids[order].tolist()
    assert read < n / 10
    flat = Chunk(np.arange(n)[::-1].copy(), np.arange(n), np.zeros(n, np.int64), np.full(n, 7), 1)
    (scores, ids), read = flat.search(np.array([0]), np.array([1]), 10, nothing)
    assert ids.tolist() == list(range(10)) and read == n  # all are equal: none may be left out
    assert flat.search(np.array([0]), np.array([1]), 2, (np.array([9, 8]), np.array([4, 5])))[1] == 0


def brute_matches(docs, items, length, coverage):
    windows = {}
    for item, text in items:
        w = plain(text)
        size = min(length, max(1, math.ceil(coverage * len(w))))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = plain(text)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        starts = sorted(x for x in hit if x - 1 not in hit)
        ends = sorted(x + 1 for x in hit if x + 1 not in hit)
        out.append((repr(i), len(w), tuple(zip(starts, ends, strict=True)), tuple(sorted(found))))
    return out


@pytest.mark.parametrize(("length", "coverage", "item_bytes"), [(10, 1.0, 1 << 20), (10, 1.0, 150), (4, 1.0, 1 << 20), (10, 0.4, 1 << 20), (3, 0.2, 400), (1, 1.0, 1 << 20)])
def test_item_matches(data, frames, length, coverage, item_bytes):
    docs, items = frames
    found = item_matches(docs, items, length=length, coverage=coverage, item_bytes=item_bytes).collect()
    want = brute_matches(*data, length, coverage)
    assert any(w[2] for w in want)
    assert Counter((repr(r.doc_id), r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in found) == Counter(want)
    texts = {(r.doc_id, r.row_hash): r.text for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash")).collect()}
    for r in found:
        text = (texts[r.doc_id, r.row_hash] or "").encode()
        for s in r.spans:
            assert plain(text[s.first_byte : s.end_byte].decode()) == plain(text.decode())[s.start : s.end]


def test_matches_of_nothing(frames):
    docs, items = frames
    assert item_matches(docs.where("doc_id < 0"), items).count() == 0
    assert item_matches(docs, items.where("item_id < 0")).where("size(spans) > 0 or size(items) > 0").count() == 0


def test_long_items_in_pieces(spark):
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(30_000))  # several pieces, and several automata
    w = long.split()
    docs = [(k, "x " + " ".join(w[a : a + n]) + " y") for k, (a, n) in enumerate((r.randrange(29_000), r.choice((9, 10, 60, 900))) for _ in range(50))]
    docs.append((99, long))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = item_matches(df, spark.createDataFrame([("a", long)], "item_id string, text string"), item_bytes=100_000)
    for row in found.collect():
        n = len(docs[min(row.doc_id, 50)][1].split()) - (0 if row.doc_id == 99 else 2)
        assert [(s.start, s.end) for s in row.spans] == ([] if n < 10 else [(0, n)] if row.doc_id == 99 else [(1, n + 1)])


def test_automaton_lengths():
    """On small alphabets, which split many states: windows of every length, each item's own."""
    r = random.Random(8)
    for _ in range(60):
        items = [(str(k), words(r, r.randint(1, 12), "ab"), r.randint(1, 6)) for k in range(r.randint(1, 8))]
        items = [(i, t, min(n, len(t.split()))) for i, t, n in items]
        made = ItemAutomaton.of([(i, t.encode(), n) for i, t, n in items])
        text = words(r, 80, "ab").split()
        hit, found = set(), set()
        for item, t, n in items:
            w = t.split()
            for a in range(len(w) - n + 1):
                for k in range(len(text) - n + 1):
                    if text[k : k + n] == w[a : a + n]:
                        hit |= set(range(k, k + n))
                        found.add(item)
        n_words, runs, got = made.matches(" ".join(text).encode())
        assert n_words == 80 and got == found and {x for a, b in runs for x in range(a, b)} == hit
        assert all(a[1] < b[0] for a, b in pairwise(runs))


def test_remove_matches(data, frames):
    docs, items = frames
    want = []
    for (i, t), (_, n, runs, _) in zip(data[0], brute_matches(*data, 10, 1.0), strict=True):
        if sum(b - a for a, b in runs) <= 0.5 * n:
            found = list(re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or ""))
            for a, b in reversed(runs):
                t = t[: found[a].start()] + t[found[b - 1].end() :]
            want.append((repr(i), repr(t)))
    out = remove_matches(docs, items)
    assert out.columns == docs.columns and len(want) < len(data[0])
    assert Counter((repr(r.doc_id), repr(r.text)) for r in out.collect()) == Counter(want)


def brute_resample(docs, targets, percent=5, least=20):
    def features(t):
        w = plain(t)
        return [crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in targets:
        t.update(features(text))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain(text)) >= least))
    able = sorted((x for x in rows if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[: len(able) * percent // 100]
    left = Counter(rows) - Counter(drawn)
    return Counter((repr(x[0]), *x[1:4], k) for k, x in enumerate(drawn, 1)) + Counter({(repr(x[0]), *x[1:4], None): n for x, n in left.items()})


def resampled(df):
    return Counter((repr(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("percent", "least", "range_rows"), [(5, 20, 250_000), (60, 1, 40), (100, 0, 10), (1, 20, 250_000), (30, 5, 1)])
def test_resample(data, frames, percent, least, range_rows, monkeypatch):
    monkeypatch.setattr(importance, "SAMPLES", 3)
    docs, items = frames
    found = resample(docs, items, percent=percent, min_words=least, range_rows=range_rows)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in found.schema} == {"bigint"}
    assert resampled(found) == brute_resample(data[0], [t for _, t in data[1]], percent, least)


def test_resample_odd_tables(spark, frames):
    docs, items = frames
    assert resample(docs.where("doc_id < 0"), items).count() == 0
    assert resampled(resample(docs, items.where("item_id < 0"))).total() == docs.count()
    r = random.Random(3)
    same = [(7, words(r, 30))] * 3000 + [(k, words(r, 25)) for k in range(100)]  # rows alike, which no key tells apart
    df = spark.createDataFrame(same, "doc_id long, text string").repartition(5)
    for percent in (50, 98):
        assert resampled(resample(df, items, percent=percent, range_rows=200)) == brute_resample(same, [x.text for x in items.collect()], percent)


def test_tournament_tree():
    r = random.Random(6)
    for k in range(12):
        runs = [sorted((r.randrange(50), r.randrange(9)) for _ in range(r.choice((0, 1, 30)))) for _ in range(k)]
        assert list(TournamentTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_bucket_parts():
    text = ("Ab c\xa0d e9 f, " * 40).encode()
    whole = [x for _, part in importance.bucket_parts(text) for x in part.tolist()]
    w = plain(text.decode())
    assert Counter(whole) == Counter(crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1))


def test_bucket_parts_by_parts(monkeypatch):
    text = ("Ab c\xa0d e9 f, " * 40).encode()
    want = Counter(x for _, part in importance.bucket_parts(text) for x in part.tolist())
    monkeypatch.setattr(importance, "word_parts", lambda data: word_parts(data, 5))
    assert Counter(x for _, part in importance.bucket_parts(text) for x in part.tolist()) == want


def test_query_of_resampling(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert resampled(QUERIES["op13_importance_resampling"](spark, SF)) == brute_resample(docs, items)
