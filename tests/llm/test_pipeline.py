"""corpus_pipeline.run() against a plain Python version of its stages, written without the library."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
_KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
SECRETS = (
    (rf"""{_KEYWORDS}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("AKIA[A-Z0-9]+", 0, 16),
    ("[0-9a-f]+", 0, 32),
    (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\r?\n(?:Proc-Type|DEK-Info):[^\r\n]*)*(?:\r?\n)?(?:\r?\n[A-Za-z0-9+/=]+)*(?:\r?\n-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 0),
    ("gh[pousr]_[A-Za-z0-9]{20,}", 0, 0),
    ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def good(t):
    w = words_of(t)
    n = len(w)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = len({i + k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    bad = (n < 50, 100 * repeated > 50 * n, 4 * sum(c in "#*$%&|<>" for c in t) > n, upper >= 50 and upper > lower, dup >= 10 and 2 * dup > len(lines), 2 * sum(map(len, w)) < 3 * n or sum(map(len, w)) > 100 * n)
    return not any(bad)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def first_lines(docs, least=10):
    """Texts by id without lines of least documents or more, but for their first occurrence."""
    key = lambda x: lower(x.strip(SPACES))
    seen, first = defaultdict(set), {}
    for i, t in sorted(docs.items()):
        for k, line in enumerate(t.split("\n")):
            seen[key(line)].add(i)
            first.setdefault(key(line), (i, k))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not key(x) or len(seen[key(x)]) < least or first[key(x)] == (i, k)) for i, t in docs.items()}


def shingles(t, n=5):
    w = words_of(lower(t))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def near_roots(texts):
    """The smallest number reachable from each text over links of 5-word similarity 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                x, y = sorted((root[a], root[b]))
                root = [x if z == y else z for z in root]
    return root


def masked(t):
    spans = []
    for pattern, group, least in SECRETS:
        spans += [m.span() for m in re.finditer(pattern, t) if len(m[group]) >= least]
    done, parts = 0, []
    for a, b in sorted(spans):
        if a >= done:
            parts += [t[done:a], "[SECRET]"]
        done = max(done, b)
    return "".join([*parts, t[done:]])


def test_stages(spark, bpe):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = first_lines({i: t for i, t in docs.items() if good(t)})
    names = sorted(docs)
    roots = near_roots([docs[i] for i in names])
    kept = [i for k, i in enumerate(names) if roots[k] == k]
    want = {i: len(bpe.encode(masked(docs[i]), add_special_tokens=False).ids) + 1 for i in kept}
    got, used = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(used) <= sum(got.values()) / 2048 + 3


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns named as the operators name theirs."""
    r = random.Random(3)
    prose = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(80)) for _ in range(6)]
    rows = [(3, prose[0]), (None, prose[0]), (None, prose[1]), (5, prose[0]), (5, prose[2]), (5, prose[2]), (7, prose[0]), (8, None), (None, None), (9, ""), (10, " \n"), (11, prose[3] + " token=abcdefgh1"), (12, " ".join(prose) * 40), (None, prose[4]), (None, prose[4])]
    df = frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    for name in ("gone", "row", "shard", "sequence_id", "offset", "own_id", "n", "first", "_kept_text", "_n_lines", "runs", "fp", "text_hash", "piece"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


def test_near_dedup_by_row(spark):
    docs = frame(spark, [(3, "A a"), (None, "A a"), (None, "B b"), (5, "A a"), (5, "C c"), (5, "C c"), (7, "A a"), (None, "D"), (None, "D"), (8, None), (9, ""), (None, " ")])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == Counter([(3, "A a"), (None, "B b"), (5, "C c"), (None, "D"), (8, None)])


def test_odd_rows_in_each_stage(spark, odd, bpe):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    out = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    assert told(out["quality_rules"]) == sorted((x for x in rows if good(x[1] or "")), key=key)
    assert told(out["line_dedup"]) == sorted(((i, t or "") for i, t in rows), key=key)
    near = told(out["near_dedup"])
    assert len([t for _, t in near if not (t or "").strip()]) == 1 and len(near) == len({t for _, t in rows if (t or "").strip()}) + 1
    assert (3, rows[[i for i, _ in rows].index(3)][1]) in near
    assert told(out["secret_scans"]) == sorted(((i, None if t is None else masked(t)) for i, t in rows), key=key)
    packed = Counter()
    for r in out["best_fit_packing"].collect():
        packed[r.doc_id] += r.length
    want = Counter()
    for i, t in rows:
        want[i] += len(bpe.encode(t or "", add_special_tokens=False).ids) + 1
    assert packed == want
    for name in ("quality_rules", "line_dedup", "near_dedup", "secret_scans"):
        assert out[name].columns == odd.columns
        for own in ("_kept_text", "_n_lines", "runs"):
            assert {r[0] for r in out[name].select(own).distinct().collect()} <= {own}


def test_blocks_of_a_bucket():
    """Components of a block by matrix products are those of all its pairs."""
    from trovelight.llm.near_dedup import block_links, common_counts

    r = random.Random(1)
    sets = []
    for _ in range(60):
        base = {r.randrange(200) for _ in range(40)}
        sets += [base - set(r.sample(sorted(base), 3)) | {r.randrange(10**6) for _ in range(r.randrange(9))} for _ in range(3)]
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    counts = common_counts(arrays[:100], arrays[100:], columns=64)
    assert counts.tolist() == [[len(a & b) for b in sets[100:]] for a in sets[:100]]

    def joined(n, edges):
        root = list(range(n))
        for a, b in edges:
            x, y = sorted((root[a], root[b]))
            root = [x if z == y else z for z in root]
        return root

    similar = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    every = [(a, b) for a in range(180) for b in range(a) if similar(a, b)]
    assert joined(180, block_links((list(range(180)), []), (arrays, []), 8)) == joined(180, every)
    across = block_links((list(range(100)), list(range(100, 180))), (arrays[:100], arrays[100:]), 8)
    assert joined(180, across) == joined(180, [(a, b) for a, b in every if b < 100 <= a])


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where("n_chars <> char_length(text)").count() == 0


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_one_of_many_copies_is_packed(spark, bpe, tmp_path):
    """Twelve copies of a text, and of another in lines: one copy's text of each reaches the sequences."""
    r = random.Random(8)
    prose = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(90)) for _ in range(2)]
    prose[1] = prose[1].replace(" ", "\n", 3)
    rows = [(12 * k + i, t, "en", "s", len(t)) for k, t in enumerate(prose) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
    for k, t in enumerate(prose):
        assert got[12 * k] == len(bpe.encode(t, add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("limits", [{}, {"block": 7}, {"block_bytes": 4000}])
def test_near_copies_of_five_words(spark, limits):
    """Links are those of exact 5-word similarity 0.8 or more, also where fingerprints of 64 bits are far apart."""
    from trovelight.llm.near_dedup import near_representatives

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = ["", None, " \n", "one two", "One  TWO"]
    for n in [6] * 25 + [60]:
        base = [word() for _ in range(120)]
        for changes in [0, 1, 2, 2, 3, 6] * (n // 6):
            w = list(base)
            for k in r.sample(range(120), changes if n == 6 else r.randrange(9)):
                w[k] = word()
            texts.append(" ".join(w))
    docs = frame(spark, list(enumerate(texts)))
    kept = near_representatives(docs, **limits) if limits else corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(near_roots([t or "" for t in texts])))


def test_near_copies_of_a_table(spark):
    """Components of all documents of sf0.01 are those of all pairs at 0.8, with long texts' blocks too; none is missed."""
    from trovelight.llm.near_dedup import near_components

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((x.doc_id, x.text or "") for x in docs.collect())
    roots = near_roots([t for _, t in rows])
    want = {i: rows[root][0] for (i, _), root in zip(rows, roots, strict=True)}
    for limits in ({}, {"block_bytes": 1 << 14}):
        assert {x.doc_id: x.component_id for x in near_components(docs, **limits).collect()} == want
