"""Archives, their index and its merge."""

import base64
import gzip
import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trovelight.llm.warc import LoserTree, capture_histories, parse_records, read_archives, url_key, write_archives


def test_loser_tree():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com:80/A?b=C#d", "com,example)/a?b=c"), ("https://m.x.org", "org,x,m)/"), ("", ")/"), ("http://[bad", "http://[bad")])
def test_url_key(url, key):
    assert url_key(url) == key


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h{k % 3}.org/{k % 5}", f"<p>{k % 7}</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né") for k in range(60)]
    rows += [(60, None, None), (61, "http://a b\n/", ""), (None, "x", "only"), (None, "y", None), (62, "z", "long é" * 40000), (5, "http://h2.org/0", "<p>5</p> twice"), (5, "http://h2.org/0", "<p>5</p> twice")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 40])
def test_round_trip(spark, pages, least):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    latest, times = {}, {}
    for i, d in rows:
        times[d] = times.get(d, 0) + 1
        latest[d] = max([x for x in (latest.get(d), i) if x is not None], default=None)
    want = []
    for i, d in rows:
        again = len(d) >= least and times[d] > 1 and latest[d] is not None and i != latest[d]
        want.append((repr(i), len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if again else "response", repr(latest[d] if again else None)))
    merged = capture_histories(pages, min_revisit_bytes=least, max_records=7)
    found = merged.collect()
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to)) for r in found) == sorted(want)
    keys = [(r.url_key, r.time) for r in found]
    assert keys == sorted(keys)


def test_null_times(spark, pages):
    """A page without a capture time is there all the same, at its id's time."""
    timed = pages.withColumn("at", F.when(F.col("page_id") % 2 == 0, F.lit("2024-05-06 07:08:09").cast("timestamp")))
    found = capture_histories(timed, time_col="at").collect()
    want = Counter((repr(r.page_id), "2024-05-06T07:08:09Z" if r.page_id is not None and r.page_id % 2 == 0 else time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(r.page_id or 0))) for r in pages.collect())
    assert Counter((repr(r.page_id), r.time) for r in found) == want


def test_lost_records_are_an_error(spark, pages, monkeypatch):
    from trovelight.llm import warc

    monkeypatch.setattr(warc, "read_archives", lambda spark, path: read_archives(spark, path).where("page_id <> 7"))
    with pytest.raises(ValueError, match="67 records were written"):
        capture_histories(pages)


def test_no_pages(pages):
    assert capture_histories(pages.where("page_id < 0")).count() == 0


def test_files_are_archives(spark, pages, tmp_path):
    write_archives(pages, f"file://{tmp_path}/w")
    n = 0
    for f in (tmp_path / "w").rglob("part-*"):
        content = f.read_bytes()
        plain = gzip.decompress(content)
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
        for offset, headers, block in parse_records(content, chunk=1000):
            assert plain[offset:].startswith(b"WARC/1.1\r\n") and len(block) == int(headers["content-length"])
            n += 1
    assert n == pages.count()


def test_archives_are_bounded(spark, tmp_path):
    """Pages of several MB, small ones and one hot payload: no archive holds more payload than asked, or it holds one record."""
    r = random.Random(6)
    big = ["".join(r.choice("abc<>") for _ in range(1000)) * n for n in (3000, 3100, 700, 600, 650)]
    rows = [(k, f"http://x.org/{k}", t) for k, t in enumerate([*big, *(["hot"] * 300), *(f"page {k}" * 50 for k in range(300))])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    write_archives(df, f"file://{tmp_path}/w", archive_bytes=1_500_000)
    sizes = []
    for f in (tmp_path / "w").rglob("part-*"):
        blocks = [len(block) for _, _, block in parse_records(f.read_bytes())]
        sizes += blocks
        assert len(blocks) == 1 or sum(blocks) < 1_700_000
    assert len(sizes) == len(rows)
    found = capture_histories(df, archive_bytes=1_500_000).collect()
    assert sorted((x.page_id, x.payload_bytes) for x in found) == [(i, len(t)) for i, _, t in rows]
    assert sum(x.record_type == "revisit" for x in found) == 299


def test_merge_keeps_runs_apart(spark):
    from trovelight.llm.warc import INDEX_TYPE, merge_runs

    r = random.Random(2)
    rows = [(f"run{r.randrange(9)}", f"k{r.randrange(5)}", f"t{r.randrange(4)}", r.choice([None, r.randrange(50)]), k, 1, "response", 1, "d", None) for k in range(3000)]
    df = spark.createDataFrame(rows, INDEX_TYPE).repartition(7)
    found = [(x.url_key, x.time, x.page_id is None, x.page_id or 0, x.run, x.offset) for x in merge_runs(df, 500).collect()]
    assert len(found) == 3000 and found == sorted(found)


def test_broken_archive():
    with pytest.raises(ValueError, match="inside"):
        list(parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
