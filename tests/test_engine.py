"""Chunks, search, graph, history, memory, storage and streams on small tables."""

import io
import json
import math
import os
import random
import sqlite3
import time
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovelight.functions import arrow as A
from trovelight.functions import constants as K
from trovelight.operators import corpus, export, graph, grep, history, index, memory, rank, render, search
from trovelight.plans import api, catalogue
from trovelight.sources import readers, writers


def chunks(text, size, overlap=0, **more):
    return [text[a:b] for a, b in A.Chunker(size, overlap, **more)(text)]


def test_chunks_prefer_sentences():
    assert chunks("One. Two. Three", 9) == ["One. Two.", "Three"]
    assert chunks("甲。乙。丙丁", 4) == ["甲。乙。", "丙丁"]
    assert chunks("abcdef", 2, separators=("",)) == ["ab", "cd", "ef"]
    assert chunks("", 5) == [] and chunks("  \n ", 2) == []
    assert chunks("abcdefgh", 4, 2, separators=("",)) == ["abcd", "cdef", "efgh"]


def test_chunks_keep_blocks_whole():
    table = "| a | b |\n| c | d |\n| e | f |\n"
    assert table.strip() in chunks("Lead text here.\n" + table + "After that.", 24)
    fence = "```py\nx = 1. \ny = 2. \nz = 3. \n```\n"
    assert any(fence.strip() in c for c in chunks("Some words. " * 3 + "\n" + fence + "End. ", 30))
    assert chunks("Title\n" + table, 28)[0] == ("Title\n" + table).strip()


def test_chunk_offsets(spark):
    text = "# H\n\n" + "Word one. " * 50 + "\n\n## Sub\n\n" + "More here! " * 40
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = corpus.chunk_rows(docs, 120).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))
    assert all(text[r.char_start : r.char_end] == r.text == r.text.strip() for r in rows)
    with pytest.raises(ValueError, match="overlap"):
        A.Chunker(5, 5)


def test_nodes_and_headings(spark):
    docs = spark.createDataFrame([("d", "Guide V2", "# A\n\nx. \n\n## B\n\ny. \n\n# C\n\nz.", "g.md")], "doc_id string, title string, text string, source_file string")
    nodes = {r.node_id: r for r in corpus.build_nodes(docs, 8).collect()}
    leaves = sorted((n for n in nodes.values() if n.is_leaf), key=lambda n: n.ordinal)
    assert {n.source_version for n in nodes.values()} == {"v2"}
    assert leaves[0].prev_id is None and leaves[0].next_id == leaves[1].node_id and leaves[-1].next_id is None
    assert any(n.heading_path == "A > B" for n in leaves) and leaves[-1].heading_path == "C"
    assert history.violations(spark.createDataFrame(list(nodes.values())), graph.structure_edges(spark.createDataFrame(list(nodes.values())))).count() == 0


def test_align(spark):
    df = spark.createDataFrame([("abcabc", ["abc", "bc", "zz", "a"])], "document string, texts array<string>")
    assert [tuple(s) for s in corpus.align_texts(df).first().spans] == [(0, 3), (4, 6), (-1, -1), (-1, -1)]


BODIES = ["reinforced concrete beam design", "concrete concrete mix", "steel beam", "混凝土结构设计", "foo_bar concrete", "beam foo then bar", "nothing here at all", "concrete beam beam steel"]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(f"n{i}", f"n{i}", f"d{i % 2}", i, f"T{i}", "", b, b, True, True, "chunk", "p", "current", f"f{i}.md") for i, b in enumerate(BODIES)]
    return spark.createDataFrame(rows, "node_key string, node_id string, doc_id string, ordinal int, title string, heading_path string, body_plain string, body_md string, is_active boolean, is_leaf boolean, kind string, parent_id string, source_version string, ref_path string").cache()


def ask(spark, *rows):
    return spark.createDataFrame([(i, t, m, list(must)) for i, (t, m, must) in enumerate(rows)], "query_id int, text string, mode string, must array<string>")


def test_bm25_against_sqlite(spark, nodes):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(k UNINDEXED, t)")
    tokens = {r.node_id: " ".join(r.t) for r in nodes.select("node_id", index.T.fts_tokens("body_plain").alias("t")).collect()}
    con.executemany("INSERT INTO f VALUES (?, ?)", tokens.items())
    asked = ask(spark, ("concrete beam", "or", ()), ("foo_bar", "or", ()), ("混凝土", "or", ()), ("concrete beam", "and", ()), ("steel", "or", ("beam",)))
    texts = ['"concrete" OR "beam"', '"foo_bar"', '"混凝土" OR "混凝" OR "凝土"', '"concrete" AND "beam"', '"beam" AND "steel"']
    found = search.scores(search.compile_queries(asked), index.postings(nodes), index.doc_stats(nodes)).collect()
    for q, match in enumerate(texts):
        want = dict(con.execute("SELECT k, bm25(f, 1.2, 0.4) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.node_key: r.score for r in found if r.query_id == q}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_cascade_relaxes(spark, nodes):
    asked = ask(spark, ("concrete beam", "and", ()), ("concrete zebra", "and", ()), ("beam", "or", ("zebra",)), ("zebra", "or", ()))
    rows = search.cascade(asked, index.postings(nodes), index.doc_stats(nodes)).collect()
    assert {(r.query_id, r.level) for r in rows} == {(0, 1), (1, 2), (2, 3)}


def test_fallback_and_exclusion(spark, nodes):
    hits = search.like_fallback(ask(spark, ("einforce", "or", ())), nodes, 5).collect()
    assert [r.node_id for r in hits] == ["n0"]
    assert search.exclude_terms(nodes, ["CONCRETE", "t2"]).count() == 4 - 1
    said = {r.query_id: r.match for r in search.match_expression(ask(spark, ("a1 b1", "or", ("c1",)), ("a1 b1", "and", ()))).collect()}
    assert said == {0: '"c1" AND "a1" OR "b1"', 1: '"a1" AND "b1"'}


def test_aliases_in_search(spark):
    aliases = spark.createDataFrame([("Steel Frame", "steelframe", True), ("Steel Beam", "steelbeam", True), ("Wood", "wood", True), ("steel old", "steelold", False)], "alias string, normalized_alias string, is_active boolean")
    rows = search.expand_with_aliases(ask(spark, ("steel", "or", ())), aliases).orderBy("n").collect()
    assert [r.alias for r in rows] == ["steelbeam", "steelframe"]


def test_mentions_and_references(spark):
    cols = "doc_id string, source_version string, node_id string, kind string, label string, title string, ordinal int, body_plain string, is_active boolean, is_leaf boolean"
    nodes = spark.createDataFrame(
        [
            ("d", "v1", "a1", "article", "第一条", "第一条 总则", 1, "x", True, True),
            ("d", "v1", "c1", "chunk", "", "", 2, "参见第一条。总则适用", True, True),
            ("d", "v1", "c2", "chunk", "", "", 3, "the cat concatenates", True, True),
            ("e", "v1", "c3", "chunk", "", "", 1, "总则", True, True),
        ],
        cols,
    )
    assert [(r.from_node_id, r.to_node_id) for r in graph.reference_edges(nodes).collect()] == [("c1", "a1")]
    assert [(r.from_node_id, r.confidence) for r in graph.title_mention_edges(nodes.where("kind = 'chunk'"), nodes).collect()] == [("c1", 0.9)]
    names = spark.createDataFrame([("d", "v1", n, n, "t", True, 1.0) for n in ("cat", "con", "x")], "doc_id string, source_version string, alias string, normalized_alias string, target_node_id string, is_active boolean, confidence double")
    assert [r.from_node_id for r in graph.alias_mention_edges(nodes.where("kind = 'chunk'"), names).collect()] == ["c2"]


def test_alias_rules(spark):
    rows = [("d", "v1", True, True, "article", "n1", "第二条 房屋租赁期限", "以下简称“租期”，", ["租 期"]), ("d", "v1", True, True, "chunk", "n2", "T", "简称甲方", [])]
    nodes = spark.createDataFrame(rows, "doc_id string, source_version string, is_active boolean, is_leaf boolean, kind string, node_id string, title string, body_plain string, aliases array<string>")
    found = {(r.normalized_alias, r.source, r.confidence) for r in graph.extract_aliases(nodes).collect()}
    assert found == {("租期", "frontmatter_alias", 1.0), ("房屋租赁期限", "title", 1.0), ("房租期", "title_abbreviation", 0.92)}


def test_cooccurrence(spark):
    rows = [("d", "v", f"n{i}", i, t, True) for i, t in enumerate(["alpha beta gamma", "alpha beta gamma delta", "alpha zeta", "12 34 56"])]
    edges = graph.cooccurrence_edges(spark.createDataFrame(rows, "doc_id string, source_version string, node_id string, ordinal int, body_plain string, is_active boolean")).collect()
    assert {(e.from_node_id, e.to_node_id, e.confidence) for e in edges} == {("n0", "n1", 0.75), ("n1", "n0", 0.75)}


def test_upsert_and_dedupe(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in graph.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_weights_clamp_in_order(spark):
    rows = [("q", "n", d, i) for i, d in enumerate([2.0] * 11 + [-3.0] * 12 + [1.0])]
    df = spark.createDataFrame(rows, "query_norm string, node_id string, delta double, seq int").withColumn("ts", F.timestamp_seconds("seq"))
    r = memory.fold_weights(df.repartition(5), ["query_norm", "node_id"], ["ts", "seq"]).first()
    assert (r.weight, r.pos_count, r.neg_count) == (-9.0, 12, 12)
    later = memory.learned_weights(memory.fold_weights(df.where("seq < 11"), ["query_norm", "node_id"], ["ts", "seq"]), F.timestamp_seconds(F.lit(10 + 30 * 86400))).first()
    assert math.isclose(later.weight, 10.0)


def test_history(spark):
    old = spark.createDataFrame([("a", "v1"), ("b", "v1")], "doc_id string, source_version string")
    new = spark.createDataFrame([("b", "v1"), ("c", "v2")], "doc_id string, source_version string")
    merged = {(r.doc_id, r.is_active) for r in history.merge_history(old, new, history.KEYS["docs"]).collect()}
    assert merged == {("a", False), ("b", True), ("c", True)}
    again = history.merge_history(history.merge_history(old, new, ["doc_id"]).select(*old.columns), new, ["doc_id"])
    assert {(r.doc_id, r.is_active) for r in again.collect()} == merged
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert maps.select(history.map_diff(F.col("x"), F.col("y")).alias("d")).first().d == ["a", "b", "c"]


def test_point_lookup(spark):
    rows = [("n1", "v1", True), ("n1", "v2", True), ("n2", "v1", True), ("n3", "v1", False)]
    nodes = spark.createDataFrame(rows, "node_id string, source_version string, is_active boolean")
    assert [(r.node_id, r.source_version) for r in api.get_node(nodes, ["n2", "n1", "n2", "n3", "zz"]).collect()] == [("n2", "v1"), ("n1", "v2")]


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(0, 5), (1, 50), (2, 1)], "pos int, n int").withColumn("q", F.lit(1))
    assert [r.pos for r in render.within_budget(df, F.col("n"), 10, ["q"], ["pos"]).collect()] == [0]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "alpha beta", "a", "alpha " + "x" * 300 + " beta", 1), (1, "alpha beta", "b", "alpha beta", 2), (1, "alpha beta", "c", "alpha only", 3)], "query_id int, text string, node_id string, body_plain string, rank int")
    assert [r.node_id for r in rank.proximity_rerank(hits).orderBy("rank").collect()] == ["b", "a", "c"]


def test_bundle_is_deterministic(spark, nodes):
    linked = corpus.sibling_links(nodes)
    whole = api.Corpus(linked, edges=graph.structure_edges(linked))
    asked = ask(spark, ("concrete beam", "or", ()), ("einforce", "or", ()), ("zebra", "and", ()))
    first = {r.query_id: (r.markdown, tuple(r.node_ids)) for r in api.bundle(whole, asked, api.preset("standard", limit=3)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    second = {r.query_id: (r.markdown, tuple(r.node_ids)) for r in api.bundle(whole, asked.repartition(3), api.preset("standard", limit=3)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == second and first.keys() == {0, 1, 2}
    assert first[1][1][0] == "n0" and first[2][1] == () and "## References" in first[2][0]
    tight = api.bundle(whole, asked, api.preset("standard", limit=3, max_chars=300)).where("query_id = 0").first()
    assert tight.exhausted and len(tight.markdown) < 700 and "BUDGET EXHAUSTED" in tight.markdown


def test_edge_types_and_policy():
    assert api.parse_edge_types(None) == K.DEFAULT_WALK and api.parse_edge_types("prev, next prev") == ("prev", "next")
    with pytest.raises(ValueError, match="zigzag"):
        api.parse_edge_types("zigzag")
    state, trace = api.run_policy({"next": "go", "n": 0}, {"go": lambda s: {"n": s["n"] + 1, "next": "go"}}, budget=3)
    assert state["n"] == 3 and trace == ["go"] * 3


def test_vacuum(spark, nodes):
    some = nodes.withColumn("is_active", F.col("ordinal") > 2)
    text = spark.createDataFrame([("n1", "a"), ("n5", "b"), ("zz", "c")], "node_key string, body string")
    kept, counts = api.vacuum({"nodes": some, "edges": graph.structure_edges(corpus.sibling_links(some)).limit(0), "node_text": text})
    assert {r.table: (r.before, r.after) for r in counts.collect()} == {"nodes": (8, 5), "edges": (0, 0), "node_text": (3, 1)}
    lost = spark.createDataFrame([("n5", "gone", True)], "from_node_id string, to_node_id string, is_active boolean")
    with pytest.raises(ValueError, match="edge_end gone"):
        api.vacuum({"nodes": some, "edges": lost})
    assert kept["nodes"].count() == 5


def test_search_lines(spark):
    docs = spark.createDataFrame([("f", "one two\nthree")], "ref_path string, text string")
    assert api.search_lines(docs, query="three zero").count() == 1 and api.search_lines(docs, "^t").count() == 1
    with pytest.raises(ValueError, match="pattern"):
        api.search_lines(docs)


def test_snapshots(spark, tmp_path):
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.current() is None and not store.has("t")
    store.publish({"t": spark.range(3), "u": spark.range(1)})
    store.publish({"t": spark.range(5)}, keep_others=True)
    with pytest.raises(RuntimeError, match="no"):
        store.publish({"t": spark.range(9)}, check=lambda read: (_ for _ in ()).throw(RuntimeError("no")))
    assert store.read("t").count() == 5 and store.read("u").count() == 1
    for n in (6, 7):
        store.publish({"t": spark.range(n)}, keep_others=True)
    assert store.read("t").count() == 7 and store.read("u").count() == 1
    assert len(list((tmp_path / "s" / "pointers").glob("0*"))) == 2


def test_snapshot_of_another_publisher(spark, tmp_path):
    """Of two publishers with one base the second is refused, and what the first wrote stays."""
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    store.publish({"t": spark.range(3)})
    other = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(RuntimeError, match="newer"):
        store.publish({"t": spark.range(9)}, check=lambda read: other.publish({"t": spark.range(4)}))
    assert store.read("t").count() == 4
    assert not writers.create_text_file(spark, f"file://{tmp_path}/s/pointers/00000001", "x")


def test_fold_in_blocks(spark):
    """A fold in blocks is the plain loop, whatever the block."""
    r = random.Random(3)
    rows = [("q", k, float(r.choice([1, 2, -3, -3, 5, 0]))) for k in range(400)] + [("p", 1, -2.0)]
    df = spark.createDataFrame(rows, "query_norm string, seq long, delta double").withColumn("ts", F.timestamp_seconds("seq"))
    want = 0.0
    for _, _, d in rows[:400]:
        want = min(want + d, 20.0) if d >= 0 else max(want + d, -10.0)
    for block in (1, 7, 1000):
        got = {x.query_norm: (x.weight, x.pos_count, x.neg_count) for x in memory.fold_weights(df, ["query_norm"], ["ts", "seq"], block=block).collect()}
        assert got == {"q": (want, sum(d > 0 for _, _, d in rows[:400]), sum(d < 0 for _, _, d in rows[:400])), "p": (-2.0, 0, 1)}


@pytest.mark.parametrize("partitions", [1, 8, 23, 200])
def test_ranks_of_equal_texts(spark, partitions):
    """Copies of a text keep the order of their ids, however the rows are dealt."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    bodies = [" ".join(r.choice(words) for _ in range(25)) for _ in range(12)] * 6
    nodes = spark.createDataFrame([(f"n{i:03d}", f"n{i:03d}", i, 1, "", "", b) for i, b in enumerate(bodies)], "node_key string, node_id string, doc_id int, ordinal int, title string, heading_path string, body_plain string").repartition(7)
    asked = ask(spark, (" ".join(words[:20]), "or", ()), (" ".join(words[5:9]), "or", ("w1",)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = search.ranked(search.scores(search.compile_queries(asked), index.postings(nodes), index.doc_stats(nodes)), nodes, asked, 30).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for q in (0, 1):
        order = [(x.score, x.doc_id) for x in found if x.query_id == q]
        assert order == sorted(order) and len({s for s, _ in order}) <= 12
    assert len([x for x in found if x.query_id == 0]) == 30


def test_probing_finds_what_scanning_finds(spark, nodes):
    """A query with a rare required term looks the others up by node; the scores are those of the scan."""
    posts, stats = index.postings(nodes), index.doc_stats(nodes)
    both = ask(spark, ("concrete beam steel", "or", ("mix",)), ("concrete beam steel", "or", ()))
    found = {(x.query_id, x.node_key): x.score for x in search.scores(search.compile_queries(both), posts, stats).collect()}
    alone = {x.node_key: x.score for x in search.scores(search.compile_queries(ask(spark, ("mix", "or", ()))), posts, stats).collect()}
    assert [k for q, k in found if q == 0] == ["n1"]
    assert math.isclose(found[0, "n1"], found[1, "n1"] + alone["n1"], rel_tol=1e-9)


def test_index_on_disk(spark, nodes, tmp_path):
    index.build_index(nodes, f"file://{tmp_path}/i", partitions=4)
    posts, stats = index.read_index(spark, f"file://{tmp_path}/i")
    assert stats.count() == 8
    asked = ask(spark, ("foo_bar", "or", ()), ("concrete beam", "and", ()))
    mine = lambda p, s: sorted((x.query_id, x.node_key, x.score) for x in search.scores(search.compile_queries(asked), p, s).collect())
    assert mine(posts, stats) == mine(index.postings(nodes), index.doc_stats(nodes))
    few = index.read_postings(spark, f"file://{tmp_path}/i", ["beam", "zebra"], 4)
    assert {(x.node_key, x.tf) for x in few.collect()} == {("n0", 1), ("n2", 1), ("n5", 1), ("n7", 2)}


def test_answer_with_cache(spark, nodes):
    """The second answer comes from the cache until it is too old; the log gets a row per query."""
    now = lambda s: F.timestamp_seconds(F.lit(s))
    cache = spark.createDataFrame([], api.CACHE_SCHEMA)
    corpus_ = api.Corpus(nodes)
    asked = ask(spark, ("concrete beam", "or", ()), ("steel", "or", ()))
    one = api.answer(corpus_, asked, api.preset("quick"), cache, now(1000))
    first = {x.query_id: x.markdown for x in one.bundles.collect()}
    assert one.log.count() == 2 and {x.cmd for x in one.log.collect()} == {"bundle"}
    two = api.answer(corpus_, asked, api.preset("quick"), one.cache, now(1200))
    assert {x.query_id: x.markdown for x in two.bundles.collect()} == first and two.bundles.where("cached").count() == 2
    late = api.answer(corpus_, asked, api.preset("quick"), one.cache, now(1400))
    other = api.answer(corpus_, asked, api.preset("standard"), one.cache, now(1200))
    assert late.bundles.where("cached").count() == 0 == other.bundles.where("cached").count()
    assert other.cache.count() == 4


def test_history_verb(spark):
    log = spark.createDataFrame([("a", "Steel beam", 3, 10), ("b", "concrete", 1, 20)], "query_id string, query_text string, hits_count int, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    rows, md = api.history(log, "STEEL")
    assert [x.query_id for x in rows.collect()] == ["a"]
    assert "`a` Steel beam (3)" in md.first().markdown


def test_bodies_from_files_are_guarded(spark):
    nodes = lambda path: spark.createDataFrame([("n", path, "", True)], "node_id string, ref_path string, body_md string, is_leaf boolean")
    files = spark.createDataFrame([("a/b.md", "---\nid: 1\n---\n\ntext \n\n")], "ref_path string, md string")
    assert export.bodies_from_files(nodes("a/b.md"), files).first().body_md == "text\n"
    for bad, said in (("../b.md", "outside"), ("/b.md", "outside"), ("c.md", "missing"), ("", "without")):
        with pytest.raises(Exception, match=said):
            export.bodies_from_files(nodes(bad), files).collect()


def test_export_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d", "v1", "D", "f", "p", "h", True), ("d", "v2", "D2", "f", "p", "h", True)], "doc_id string, source_version string, title string, source_file string, source_path string, doc_hash string, is_active boolean")
    rows = [("d", v, f"n{k}", "chunk", "l", "t", "r", k, f"n{k}.md", True, True, f"text {k}\n", "") for v in ("v1", "v2") for k in (2, 1)]
    nodes_ = spark.createDataFrame(rows, "doc_id string, source_version string, node_id string, kind string, label string, title string, parent_id string, ordinal int, ref_path string, is_leaf boolean, is_active boolean, body_md string, body_plain string").withColumns({"prev_id": F.lit(None).cast("string"), "next_id": F.lit(None).cast("string")})
    edges = spark.createDataFrame([("d", "v1", "next", "n1", "n2", True, 1.0)], "doc_id string, source_version string, edge_type string, from_node_id string, to_node_id string, is_active boolean, confidence double")
    aliases = spark.createDataFrame([("d", "v1", "A", "a", "n1", "exact", 1.0, "title", True)], "doc_id string, source_version string, alias string, normalized_alias string, target_node_id string, alias_level string, confidence double, source string, is_active boolean")
    texts = export.leaf_texts(nodes_)
    assert {x.text for x in texts.collect()} == {"text 1\n\ntext 2\n"}
    parts = export.sections(docs, nodes_, edges, aliases, export.manifest_rows(docs, texts))
    writers.export_contract(parts, f"file://{tmp_path}/e")
    back = writers.read_contract(spark, f"file://{tmp_path}/e", parts)
    assert {k: v.count() for k, v in back.items()} == {"documents": 2, "nodes": 4, "edges": 1, "aliases": 1, "locators": 4}
    assert [x.source_version for x in export.latest_documents(back["documents"]).collect()] == ["v2"]
    assert [(x.pos, x.node_id) for x in export.children(back["nodes"], back["documents"]).orderBy("pos").collect()] == [(1, "n1"), (2, "n2")]
    writers.write_canonical_texts(texts, f"file://{tmp_path}/t")
    found = sorted(p.read_text() for p in (tmp_path / "t").rglob("part-*.txt"))
    assert found == ["text 1\n\ntext 2\n"] * 2
    digest = lambda df: export.binding_digest(df, F.col("node_id"), ["doc_id", "source_version", "node_id"]).first().sha256
    assert digest(nodes_) == digest(nodes_.repartition(3)) != digest(nodes_.where("ordinal = 1"))
    assert export.audit_markdown(spark.createDataFrame([("b", "1"), ("a", "2")], "name string, value string"), "Run").first().markdown == "# Run\n\n- a: `2`\n- b: `1`\n"
    assert export.alias_fingerprints(aliases).count() == 1


def test_chunks_decode_and_docx_errors():

    assert A.decode(("a" * 2_000_000 + "é").encode("cp1252")).endswith("é")
    with pytest.raises(A.ExtractError, match="DOCX"):
        A.read_file("x.docx", b"no zip")


def test_shards(spark, tmp_path):
    rows = [(f"ab{i:03d}", i) for i in range(12)] + [("b", 1), ("con", 2), (" ", 3)]
    df = spark.createDataFrame(rows, "name string, v int")
    counts = {r.shard: r["count"] for r in writers.prefix_shards(df, "name", max_rows=5).groupBy("shard").count().collect()}
    assert counts == {"ab00": 10, "ab01": 2, "b": 1, "c": 1, "": 1}
    writers.write_sharded_index(df, f"file://{tmp_path}/i", "name", max_rows=5)
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"file://{tmp_path}/i/shards")
    assert back.count() == 15
    names = spark.createDataFrame([("con",), ("a.b",), ("",), ("ok",)], "s string").select(writers.shard_file_name(F.col("s")).alias("n"))
    assert [r.n for r in names.collect()] == ["U0063-006F-006E", "U0061-002E-0062", "_EMPTY", "ok"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# Title V3\r\n\r\ntext".encode())
    (tmp_path / "b.txt").write_bytes("Part\n===\nbody".encode())
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "c.docx").write_bytes(packed.getvalue())
    docs = {r.doc_id: r for r in readers.documents_of(readers.read_folder(spark, f"file://{tmp_path}")).collect()}
    assert docs["a"].title == "Title V3" and docs["a"].source_version == "v3" and docs["a"].text == "# Title V3\n\ntext\n"
    assert docs["b"].text == "# Part\nbody\n"
    assert docs["c"].text == "## Head\n\nText\n"
    with pytest.raises(ValueError, match="only"):
        A.read_file("x.csv", b"")


def test_node_tree(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(
        '{"type":"doc","doc_id":"d","title":"Doc V4"}\n'
        '{"doc_id":"d","node_id":"n1","kind":"chunk","ordinal":1,"body":"one","aliases":"x,y"}\n'
        '{"doc_id":"d","node_id":"n2","kind":"chunk","ordinal":"2","is_active":"no"}\n'
        '{"doc_id":"e","node_id":"m","kind":"chunk","body_md":"z","confidence":0.5}\n'
    )
    docs, nodes = readers.read_node_tree(spark, f"file://{tmp_path}/t.jsonl")
    assert {r.doc_id: r.source_version for r in docs.collect()} == {"d": "v4", "e": "current"}
    found = {r.node_id: r for r in nodes.collect()}
    assert found["n1"].next_id == "n2" and found["n1"].aliases == ["x", "y"] and found["n1"].body_plain == "one\n"
    assert not found["n2"].is_active and found["n2"].title == "n2" and found["m"].confidence == 0.5
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="not JSON"):
        readers.read_node_tree(spark, f"file://{tmp_path}/bad.jsonl")[1].collect()


def test_markdown_tree_round_trip(spark, nodes, tmp_path):
    writers.write_markdown_tree(nodes, f"file://{tmp_path}/m")
    files = [p.read_text() for p in (tmp_path / "m").rglob("part-*.txt")]
    assert len(files) == len(BODIES) and all(f.startswith('---\ndoc_id: "') for f in files)


def test_canonical_json():
    assert writers.canonical_json({"b": 0.12345678, "a": [1, {"z": 2.0}]}) == '{\n  "a": [\n    1,\n    {\n      "z": 2.0\n    }\n  ],\n  "b": 0.123457\n}\n'


def test_line_search(spark):
    docs = spark.createDataFrame([("f1", "a,b\nxyz\nA，b"), ("f2", None)], "ref_path string, text string")
    assert [r.line_number for r in grep.grep_tolerant(docs, "A,b").collect()] == [3]
    assert [r.line_number for r in grep.grep_tolerant(docs, "a,b").collect()] == [1]
    assert grep.grep_any(docs, ["xyz", "A"], per_file=1).count() == 1
    queries = spark.createDataFrame([(1, ["a", "b"])], "query_id int, tokens array<string>")
    assert [(r.line_number, r.n_tokens) for r in grep.grep_queries(docs, queries, 5).orderBy("pos").collect()] == [(1, 2), (3, 1)]


def test_mentions_broadcast_no_side(spark):
    """The planner can't tell how many words a text has, so no join may put one side into the driver."""
    chunks = spark.createDataFrame([("d", "v", "c1", 1, "beam, Beam and load"), ("d", "v", "c2", 2, "a beamer")], "doc_id string, source_version string, node_id string, ordinal int, body_plain string")
    names = spark.createDataFrame([("d", "v", "beam", "beam", f"n{k}", 0.5) for k in range(2500)] + [("d", "v", "load", "load", "n7", 1.0), ("d", "v", "beam", "beam", "c1", 1.0)], "doc_id string, source_version string, name string, form string, target_node_id string, confidence double")
    edges = graph.mention_edges(chunks, names, per_doc=None)
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.from_node_id, r.to_node_id, r.confidence) for r in edges.collect()) == sorted(("c1", f"n{k}", 1.0 if k == 7 else 0.5) for k in range(2500))


def test_title_mentions_are_whole(spark, tmp_path):
    """A brand with more than a million mentions keeps all of them, as its SQL says."""
    from trovelight.plans.catalogue_more import MORE

    spark.range(1010).selectExpr("id AS p_partkey", "'hot bolt' AS p_name", "'b' AS p_brand", "5 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert MORE["title_mention_edges"](spark, str(tmp_path)).count() == 1010 * 1010


def test_mentions_meet_in_all_tasks(spark, tmp_path, monkeypatch):
    """Edges are made by as many tasks as a shuffle has: what the join is dealt out by is what it joins on, so that no second
    shuffle is put in and made small. Classes of several blocks and shares give each pair once, and none of a node with itself."""
    from trovelight.plans.catalogue_more import MORE

    spark.range(600).selectExpr("id AS p_partkey", "if(id % 3 = 0, 'hot bolt', 'old hot') AS p_name", "'b' AS p_brand", "5 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(graph, "MEMBERS", 50)
    edges = MORE["title_mention_edges"](spark, str(tmp_path))
    found = edges.collect()
    assert len(found) == len(set(found)) == 600 * 200 + 400 * 400
    join = edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("ShuffledHashJoin")[1].splitlines()
    side = [line for line in join if "Exchange" in line]
    assert "REPARTITION_BY_NUM" in side[0]
    assert edges.rdd.getNumPartitions() == 4
    nodes = spark.createDataFrame([("d", "v", f"n{k}", "article", "", "Beam", True, True, k, "beam") for k in range(300)], "doc_id string, source_version string, node_id string, kind string, label string, title string, is_active boolean, is_leaf boolean, ordinal int, body_plain string")
    pairs = [(r.from_node_id, r.to_node_id) for r in graph.title_mention_edges(nodes, nodes, per_doc=None).collect()]
    assert len(pairs) == len(set(pairs)) == 300 * 299 and all(a != b for a, b in pairs)


def test_references_are_not_shuffled(spark):
    """Nodes that cite a label meet its articles in blocks, each pair once, and what comes out of that join isn't grouped again."""
    rows = [(f"a{k}", "第1条", "参见 第1条") for k in range(2500)] + [("b", "第2条", "依据第1条，参见 第2条，参见第1條"), ("a0", "第2条", "")]
    nodes = spark.createDataFrame([("d", "v", n, "article", label, True, True, body) for n, label, body in rows], "doc_id string, source_version string, node_id string, kind string, label string, is_active boolean, is_leaf boolean, body_plain string")
    edges = graph.reference_edges(nodes)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[: plan.index("Join")]
    found = edges.select("from_node_id", "to_node_id").collect()
    assert len(found) == len(set(found)) == 2500 * 2499 + 2500


def test_chunks_of_a_batch_are_no_objects(spark):
    """40,000 chunks of a batch go into Arrow's lists; an object for each would take some hundred bytes more."""
    texts = pa.array(["x" * 2000] * 2000)
    cut = A.chunk_document(100, 0, ("",)).func
    cut(texts[:1])
    tracemalloc.start()
    found = cut(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.values) == 40_000 and peak < 6_000_000


def test_files_are_dealt_out(spark, tmp_path):
    """Files of a table of one split are read in as many tasks as a shuffle has."""
    from trovelight.plans.catalogue_more import MORE

    spark.range(400).selectExpr("id AS p_partkey", "'hot bolt' AS p_name", "'LARGE' AS p_type", "5 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    told = MORE["extracted_files"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(told) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in told) == 400


def test_word_counts_of_repeated_keys(spark):
    docs = spark.createDataFrame([("en", 1, "beam beam load"), ("en", 2, "beam"), ("en", 2, "beam load"), ("de", 2, "beam"), ("en", None, "beam"), ("en", 3, None)], "lang string, doc_id long, text string")
    found = {(r.lang, r.word): (r.n, r.docs) for r in index.word_counts(docs).collect()}
    assert found == {("en", "beam"): (5, 2), ("en", "load"): (2, 2), ("de", "beam"): (1, 1)}


def test_stream_equals_batch(spark, tmp_path):
    """Files that arrive one by one, with rows that are repeated and rows that are late, over two runs."""
    from trovelight.streaming import memory as stream

    schema = "query_norm string, node_id string, seq long, delta double, at long"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    hot = [("q", "n", i, [2.0, 2.0, 2.0, -3.0, 1.0][i % 5], 1000 + i * 600) for i in range(60)]
    ties = [("q", "m", i, d, 1010) for i, d in [(9, 30.0), (10, -3.0), (11, 30.0)]]
    first = frame([*hot[:40], *ties, hot[3], (None, "n", 1, 1.0, 1000), ("q", "n", 500, None, 1000)])
    second = frame([*hot[40:], hot[41], ("q", "n", 600, -9.0, 1005), ("z", "z", 0, 0.0, 200_000)])  # the row of 1005 is behind the watermark by then
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/store")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = []
    for name, rows in [("a", first), ("b", second)]:
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream.fold_available(source, store, f"file://{tmp_path}/ck", delay="30 minutes", bucket_ms=60_000)
        got.append({(r.query_norm, r.node_id): (r.weight, r.pos_count, r.neg_count, r.last_used) for r in stream.weights_of(store).collect()})
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    for n, found in zip((36, 60), got, strict=True):  # the buckets of the first 36 end 30 minutes ahead of 24,400 s
        batch = frame([*hot[:n], *ties])
        want = {(r.query_norm, r.node_id): (r.weight, r.pos_count, r.neg_count, r.last_used) for r in memory.fold_weights(batch, ["query_norm", "node_id"], ["ts", "seq"]).collect()}
        assert found == want
    # A batch applied again changes nothing.
    move = spark.createDataFrame([("q", "n", 0, 5.0, float("-inf"), 20.0, 1, 0, 7)], stream._MOVES)
    sink = stream.weights_sink(store)
    sink(move, 50)
    once = sorted(stream.weights_of(store).collect())
    sink(move, 50)
    assert sorted(stream.weights_of(store).collect()) == once and ("q", "n", 50) in [(r.query_norm, r.node_id, r.batch_id) for r in once]


def test_stream_states_are_few(spark, tmp_path):
    """A state holds a bucket of a share of the keys, not of one key: each state costs a call of Python for its rows and one for its timer."""
    from trovelight.streaming import memory as stream

    rows = spark.range(400).selectExpr("'q' || id AS query_norm", "'n' AS node_id", "id AS seq", "1.0D AS delta", "timestamp_seconds(1000 + id) AS ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    with stream.state_in_rocksdb(spark):
        run = stream.moves(source).writeStream.format("memory").queryName("few").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    timers = max(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in run.recentProgress)
    assert 0 < timers <= 8


def test_streams_of_the_log(spark, tmp_path):
    """Repeated ids go, counts by window equal a batch's, and an upsert by batches keeps the last row of a key."""
    from trovelight.streaming import memory as stream

    rows = [(f"i{k % 50}", f"q{k % 3}", 1000 + 60 * (k % 50)) for k in range(60)]
    log = spark.createDataFrame(rows, "query_id string, query_norm string, at long").withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", "end", 99999)], "query_id string, query_norm string, at long").withColumn("timestamp", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: stream.arrivals(spark, f"{tmp_path}/in", "query_id string, query_norm string, timestamp timestamp")

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.query_id for r in run(stream.once(source()), "once_only", "append")) == sorted({f"i{k}" for k in range(50)} | {"end"})
    counted = {(r.start, r.query_norm): r.queries for r in run(stream.counts_by_window(source(), "1 hour"), "counted", "append")}
    want = log.groupBy(F.window("timestamp", "1 hour").start.alias("start"), "query_norm").count().collect()
    assert counted == {(r.start, r.query_norm): r["count"] for r in want}
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/store")
    sink = stream.upsert_sink(store, "t", ["k"])
    for batch, (k, v) in enumerate([("a", 1), ("b", 2), ("a", 3), ("a", 3)]):
        sink(spark.createDataFrame([(k, v)], "k string, v int"), batch)
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [("a", 3), ("b", 2)]


def test_limits_of_extraction(spark, tmp_path):
    def slow(path, data):
        if "hang" in path:
            time.sleep(600)
        if "die" in path:
            os._exit(1)
        return A.read_file(path, data)

    rows = [("a.txt", b"one"), ("hang.txt", b"x"), ("b.md", "Gr\u00fc\u00dfe".encode()), ("die.txt", b"x"), ("long.txt", b"y" * 200), ("c.docx", b"x"), (None, b"x"), ("n.txt", None), ("d.txt", b"")]
    df = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    found = [tuple(r.x) for r in df.select(A.extract_limited(1, 100, slow)("path", "content").alias("x")).collect()]
    assert [t for t, _ in found] == ["one", None, "Gr\u00fc\u00dfe", None, None, None, None, None, ""]
    told = [e for _, e in found]
    assert told[1] == "not read within 1 seconds" and told[3] == "the reader's process ended" and told[4] == "text has more than 100 characters"
    assert told[5].startswith("not a DOCX document") and told[6] == told[7] == "no path or content" and told[0] is told[2] is told[8] is None
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b" " * 5_000_000)
    with pytest.raises(A.ExtractError, match="more than 1000000 bytes"):
        A.docx_markdown(bomb.getvalue(), 1_000_000)
    (tmp_path / "ok.md").write_text("# T\n")
    (tmp_path / "big.md").write_text("z" * 2000)
    (tmp_path / "no.bin").write_text("x")
    read = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.extract_folder(spark, f"file://{tmp_path}", most_bytes=1000).collect()}
    assert read["ok.md"] == ("# T\n", None) and read["big.md"] == (None, "file has 2000 bytes, more than 1000") and read["no.bin"][0] is None and read["no.bin"][1]


def test_pages_of_a_tree(spark):
    from trovelight.operators import tree

    chunks_ = spark.createDataFrame([("d", f"chunk-{k}", k, s) for k, s in enumerate([[], ["T"], ["T", "A"], ["T", "A"], ["T", "B"]])] + [("e", "chunk-0", 0, [])], "doc_id string, chunk_id string, ordinal int, stack array<string>")
    toc = corpus.chapter_toc(chunks_)
    pages = {x.doc_id: x.markdown for x in tree.contents_page(toc, spark.createDataFrame([("d", "D"), ("f", "F")], "doc_id string, title string")).collect()}
    assert pages["f"] == "# F 章节目录\n\n> 无章节信息。\n"
    assert pages["d"] == "# D 章节目录\n\n| 章节 | Chunk 范围 |\n|---|---|\n| (未分类) | chunk-0 ~ chunk-0 |\n| T | chunk-1 ~ chunk-1 |\n| A | chunk-2 ~ chunk-3 |\n| B | chunk-4 ~ chunk-4 |\n\n共 4 章，5 个 chunks。\n"
    docs = spark.createDataFrame([("d", "D", "f.md", "/p/f.md", "v1", "h", "x")], "doc_id string, title string, source_file string, source_path string, source_version string, doc_hash string, active_parser string")
    md = tree.metadata_page(docs).first().markdown
    read = readers.metadata_lines(spark.createDataFrame([(md,)], "text string")).first()
    assert (read.source_file, read.source_path, read.source_version, read.doc_hash, read.active_parser) == ("f.md", "/p/f.md", "v1", "h", "x")
    stats = corpus.chunk_statistics(spark.createDataFrame([("d", "abc"), ("d", "abcde")], "doc_id string, text string"))
    report = json.loads(tree.structure_report(docs, stats).first().json)
    assert report["selected_report"]["stats"] == {"chunk_count": 2, "avg_chunk_chars": 4.0, "min_chunk_chars": 3, "max_chunk_chars": 5} and report["runner_ups"] == []


def test_text_of_a_tree(spark):
    from trovelight.operators import tree

    rows = [
        ("c1", "chapter", None, 2, "intro\n\nfirst\nmore"), ("s1", "section", "c1", 1, "first\nmore"), ("s2", "section", "c1", 2, "head\n\nleaf line\nx"),
        ("l1", "block", "s2", 1, "leaf line\nother"), ("i1", "item", "c1", 3, "item"), ("u1", "block", "i1", 1, "under item"), ("c0", "chapter", "", 1, "  zero \n"), ("lost", "block", "nowhere", 1, "lost"),
    ]
    nodes_ = spark.createDataFrame([("d", "v", i, k, p, o, f"{i}.md", True, b) for i, k, p, o, b in rows], "doc_id string, source_version string, node_id string, kind string, parent_id string, ordinal int, ref_path string, is_active boolean, body_md string")
    assert tree.tree_texts(nodes_).first().text == "zero\n\nintro\n\nfirst\nmore\n\nhead\n\nleaf line\nother\n"
    by = tree.ids_by_content(spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "path string, text string"))
    ids = {x.path: x.doc_id for x in by.collect()}
    assert ids["b"] == ids["a"] + "-2" and len(set(ids.values())) == 3


def test_names_paths_errors_hooks():
    from trovelight import errors
    from trovelight.operators import tree

    assert tree.safe_name("my-books") == "my-books" and tree.below("/r/", "a/../b") == "/r/b"
    for bad in ("", "-a", "a--b", "A", "a" * 65):
        with pytest.raises(errors.ConfigError):
            tree.safe_name(bad)
    for bad in ("../x", "/x", "a/../../x", "C:/x", "", "keep"):
        with pytest.raises(errors.ConfigError):
            tree.below("/r", bad, ("keep",))
    try:
        raise KeyError("x") from errors.IntegrityError("y")
    except KeyError as e:
        assert errors.exit_code(e) == 4
    assert errors.exit_code(KeyError()) == 1

    def known(df):
        return df

    hooks = api.Hooks(allowed=("known",))
    hooks.add("pre_search", known)
    with pytest.raises(errors.ConfigError):
        hooks.add("pre_search", lambda df: df)


def test_rewrites_from_every_node(spark, tmp_path):
    # One user looked at 30 nodes; the other learned only the oldest of them.
    rows = [(i, f"2024-01-01 00:00:{i:02}", 1, "click", f'{{"k": {i}}}') for i in range(30)] + [(30, "2024-01-02 00:00:00", 2, "view", '{"k": 0}')]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["rewrite_suggestions"](spark, str(tmp_path)).collect()] == [("1", "User 2 view", 1)]
