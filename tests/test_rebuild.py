"""Rebuild of what a change reaches, and state that several writers share."""

import random
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trovelight.errors import BuildError, IntegrityError
from trovelight.operators import corpus, rebuild
from trovelight.plans import api
from trovelight.sources import writers

ROW = "doc_id string, source_fingerprint string, body string"


def sources(spark, texts):
    rows = [(k, f"{v}#{k}", v.split("~")[0]) for k, v in texts.items()]
    return spark.createDataFrame(rows, ROW)


def extract(rows):
    return rows.select("doc_id", F.concat(F.lit("Title "), "doc_id").alias("title"), F.lit("f.md").alias("source_file"), F.col("body").alias("text"))


def nodes_of(spark, store):
    like = corpus.build_nodes(extract(sources(spark, {"a": "x"})))
    return {tuple(map(str, x)) for x in rebuild.stored(store, "nodes", like).collect()}, {tuple(map(str, x)) for x in rebuild.stored(store, "edges", rebuild.document_edges(like)).collect()}


def run(store, df, **options):
    asked = []

    def watched(rows):
        asked.extend(x.doc_id for x in rows.select("doc_id").collect())
        return extract(rows)

    done = rebuild.rebuild(store, df, watched, buckets=16, **options)
    return done, sorted(asked), {x.doc_id: x.change for x in done.changes.collect()}


def test_rebuild_equals_a_full_build(spark, tmp_path):
    """Changed, added, removed, renamed and dependent documents: tables as after a full build, only parts reached written."""
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    old = {f"d{i}": f"text of {i}. " * (1 + 150 * (i % 3)) for i in range(30)}
    done, asked, changes = run(store, sources(spark, old))
    assert done.kind == "full" and asked == sorted(old) and set(changes.values()) == {"added"}
    before = store.parts("nodes")

    same, asked, changes = run(store, sources(spark, old))
    assert same.version is None and asked == [] and set(changes.values()) == {"unchanged"} and store.parts("nodes") == before

    new = dict(old) | {"d1": "another text", "d2": old["d2"] + "~renamed", "e1": "a new one"}
    del new["d3"]
    depends = spark.createDataFrame([("d7", "d1"), ("d8", "d7"), ("d7", "d8"), ("d9", "d2"), ("gone", "d8"), ("d10", "d11")], "doc_id string, on_doc_id string")
    done, asked, changes = run(store, sources(spark, new), depends=depends)
    want = {"d1": "rebuild", "d2": "metadata_only", "e1": "added", "d3": "removed", "d7": "dependent", "d8": "dependent"}
    assert done.kind == "part" and {k: v for k, v in changes.items() if v != "unchanged"} == want
    assert asked == sorted(["d1", "d2", "e1", "d7", "d8"])  # others aren't extracted
    after = store.parts("nodes")
    touched = {f"nodes/bucket={b}" for b in done.parts["nodes"]}
    assert {k for k in before | after if before.get(k) != after.get(k)} == touched and 0 < len(touched) < len(before)

    fresh = writers.SnapshotStore(spark, f"file://{tmp_path}/fresh")
    run(fresh, sources(spark, new))
    assert nodes_of(spark, store) == nodes_of(spark, fresh)
    assert store.parts("docs").keys() == fresh.parts("docs").keys()
    like = sources(spark, new).withColumn("text_fingerprint", F.lit(""))
    rows = lambda s: sorted(map(tuple, rebuild.stored(s, "docs", like).collect()))
    assert rows(store) == rows(fresh)


def test_rebuild_at_the_edges(spark, tmp_path):
    """Other parameters build all anew; no documents leave empty tables; null texts are documents; a broken build changes nothing."""
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("a", "1", None), ("b", "2", "text")], ROW)
    run(store, df, config={"size": 1, "generated_at": "today"})
    done, _, _ = run(store, df, config={"size": 1, "generated_at": "tomorrow"})
    assert done.version is None
    done, asked, _ = run(store, df, config={"size": 2})
    assert done.kind == "full" and asked == ["a", "b"]
    state = store.current()
    twice = lambda d: (lambda n: n.unionByName(n))(corpus.build_nodes(d))
    with pytest.raises(IntegrityError):
        run(store, spark.createDataFrame([("b", "3", "other")], ROW), config={"size": 2}, cut=twice)
    assert store.current() == state
    done, _, changes = run(store, df.limit(0), config={"size": 2})
    assert set(changes.values()) == {"removed"} and nodes_of(spark, store) == (set(), set()) and store.parts("docs") == {}
    assert rebuild.toolchain_checksum({"a": 1}) != rebuild.toolchain_checksum({"a": 2})


def test_nodes_without_a_shuffle(spark):
    """Chunks, headings and neighbours told inside a document's row are those that joins and windows give, and nothing is shuffled (F9)."""
    r = random.Random(5)
    parts = ["# A  b \n", "##\tC\n", "###### d\n", "####### e\n", "#\n", "# \x0b\n", "#f\n", "```\n", "``` x\n", " # g\n", "\n", "words é 𝄞 of a line\n", "#  \x0c h", "\r# i\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "# only"]
    docs = spark.createDataFrame([(f"d{k}", f"T{k}", t, "f.md") for k, t in enumerate(texts)], "doc_id string, title string, text string, source_file string")
    nodes = corpus.build_nodes(docs, 30)
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    id_of = F.concat("doc_id", F.lit(":chunk:"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
    chunks = corpus.heading_stacks(corpus.chunk_rows(docs, 30), corpus.heading_rows(docs)).select("doc_id", "ordinal", F.lit("").alias("parent_id"), F.lit("chunk").alias("kind"), id_of.alias("node_id"), F.array_join("stack", " > ").alias("path"), "text", "char_start", "char_end")
    want = corpus.sibling_links(chunks).select("node_id", "path", "text", "char_start", "char_end", "prev_id", "next_id").collect()
    found = nodes.where("is_leaf").select("node_id", "heading_path", "body_md", "char_start", "char_end", "prev_id", "next_id").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, want))) and len({x.heading_path for x in found}) > 20
    assert nodes.where("not is_leaf and prev_id is null and next_id is null").count() == len(texts)


@pytest.mark.parametrize("case", ["more ids than are broadcast", "scattered parts"])
def test_rebuild_by_the_other_ways(spark, tmp_path, monkeypatch, case):
    """Ids too many to broadcast, and parts of many small files, give the tables of a full build; columns for extract alone aren't held (F9)."""
    store, fresh = (writers.SnapshotStore(spark, f"file://{tmp_path}/{n}") for n in ("s", "fresh"))
    old = {f"d{i}": f"text of {i}. " * (1 + 150 * (i % 3)) for i in range(12)}
    new = dict(old) | {"d1": "another text", "d2": old["d2"] + "~renamed", "e1": "a new one"}
    del new["d3"]
    build = lambda s, t: rebuild.rebuild(s, sources(spark, t), extract, buckets=2, unheld=("body",))
    build(store, old)
    files = lambda s: [len(list((tmp_path / p.split(f"{tmp_path}/")[1]).glob("*.parquet"))) for p in s.parts("nodes").values()]
    assert files(store) == [1, 1] and not store.scattered("nodes", [0, 1], most=1)
    if case == "scattered parts":
        build(store, dict(old) | {f"d{i}": f"other {i}" for i in range(6)})
        assert max(files(store)) > 1 and store.scattered("nodes", [0, 1], most=1) and not store.scattered("nodes", [0, 1], most=1, small=1)
        monkeypatch.setattr(writers.SnapshotStore, "scattered", lambda *_: True)
    else:
        monkeypatch.setattr(rebuild, "MOST_IDS", 0)
    assert build(store, new).kind == "part"
    assert case != "scattered parts" or files(store) == [1, 1]
    build(fresh, new)
    assert nodes_of(spark, store) == nodes_of(spark, fresh)
    like = sources(spark, new).drop("body").withColumn("text_fingerprint", F.lit(""))
    rows = lambda s: sorted(map(tuple, rebuild.stored(s, "docs", like).collect()))
    assert rows(store) == rows(fresh) and "body" not in spark.read.parquet(*store.parts("docs").values()).columns


def test_a_rebuild_whose_base_has_moved(spark, tmp_path):
    """A rebuild whose base another one has replaced is refused; the verb builds once more from the newest state."""
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    rebuild.rebuild(store, sources(spark, {"a": "one"}), extract, buckets=4)
    meddled = []

    def slow(rows):
        if not meddled:
            meddled.append(1)
            rebuild.rebuild(store, sources(spark, {"a": "two"}), extract, buckets=4)
        return extract(rows)

    with pytest.raises(BuildError):
        rebuild.rebuild(store, sources(spark, {"a": "three"}), slow, buckets=4)
    meddled.clear()
    done = api.reindex(store, sources(spark, {"a": "three", "b": "x"}), slow, buckets=4)
    assert done.kind == "part" and {"three", "x"} <= {y for x in nodes_of(spark, store)[0] for y in x}


def at_once(*work):
    errors = []

    def guarded(f):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=guarded, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []


def test_writers_at_once(spark, tmp_path):
    """Rows that six writers add at once all stay, and so does each writer's change of a bounded table; merged parts are one."""
    store = lambda: writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    at_once(*[lambda i=i: store().append("log", spark.range(10 * i, 10 * i + 10)) for i in range(6)])
    schema = spark.range(1).schema
    assert sorted(x.id for x in store().read_parts("log", schema).collect()) == list(range(60))
    more = lambda i: lambda held: spark.range(i, i + 1) if held is None else held.unionByName(spark.range(i, i + 1))
    at_once(*[lambda i=i: store().update("cache", more(i)) for i in range(4)], lambda: store().append("log", spark.range(60, 61)))
    assert sorted(x.id for x in store().read("cache").collect()) == list(range(4))
    store().merge_parts("log", schema)
    assert len(store().parts("log")) == 1 and store().read_parts("log", schema).count() == 61


def test_a_pointer_dropped_while_it_is_read(spark, tmp_path):
    """A pointer that goes between planning and reading is told as one that was gone before, so that writers try again."""
    store = writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    store.publish({"t": spark.range(1)})
    pointer = tmp_path / "s" / "pointers" / "00000001"

    class Read:
        def text(self, path):
            df = spark.read.text(path)
            pointer.unlink()
            return df

    store.spark = type("Session", (), {"read": Read()})()
    with pytest.raises(PySparkException, match="NOT_EXIST"):
        store._tables(1)


def test_answers_at_once(spark, tmp_path):
    """Two callers who ask at once leave both log rows and both results; feedback is read by the next."""
    docs = spark.createDataFrame([("a", "T", "steel beam holds", "f"), ("b", "U", "concrete wall", "f")], "doc_id string, title string, text string, source_file string")
    held = api.Corpus(corpus.build_nodes(docs))
    now = lambda s: F.timestamp_seconds(F.lit(s))
    ask = lambda q: spark.createDataFrame([(f"q-{q}", q, "or", [])], "query_id string, text string, mode string, must array<string>")
    store = lambda: writers.SnapshotStore(spark, f"file://{tmp_path}/s")
    at_once(*[lambda q=q: api.answer_stored(held, ask(q), api.preset("quick"), store(), now(1000)).collect() for q in ("steel", "concrete")])
    log = api.stored_log(store())
    assert sorted((x.query_text, x.hits_count) for x in log.collect()) == [("concrete", 1), ("steel", 1)]
    assert {x.cached for q in ("steel", "concrete") for x in api.answer_stored(held, ask(q), api.preset("quick"), store(), now(1100)).collect()} == {True}
    api.feedback_stored(store(), "q-steel", log.where("query_text = 'steel'").first().top_node_ids[0], "positive")
    assert store().parts("node_feedback") and api.stored_log(store()).count() == 4
    with pytest.raises(ValueError, match="feedback"):
        api.feedback_stored(store(), "q", "n", "so-so")
