"""WARC archives and their capture index, merged externally.

write_archives() turns pages into WARC 1.1 records (responses, and revisits of equal payloads) and lets
Spark's writer put them, gzip-compressed, wherever Spark can write. read_archives() parses them again and
gives one locally sorted capture run per archive. merge_runs() range-partitions the runs by URL key,
timestamp and record, and merges each partition's share of the k runs, as they are, with a loser tree, so that
partitions in order are the global capture history. Nothing sorts a run again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialize, release

_RECORD = "urn:trovelight:page:"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # of Spark's conv
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Archives hold about so many payload bytes at most (one record may be larger).
ARCHIVE_BYTES = 64 << 20
#: Payload sizes that are written together, so that a count of records bounds an archive's bytes.
SIZE_CLASSES = (0, 32 << 10, 512 << 10, 8 << 20, 64 << 20)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, port, path and query, lower-cased; scheme, www. and fragment go."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32(digest) -> F.Column:  # noqa: ANN001
    """Upper-case base32, as WARC headers have it, of a SHA-1 digest (20 bytes)."""
    told = F.hex(digest)
    parts = [F.lpad(F.conv(F.substring(told, k + 1, 10), 16, 32), 8, "0") for k in range(0, 40, 10)]
    return F.translate(F.concat(*parts), _DIGITS, _ALPHABET)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, max_records: int = 20000) -> int:
    """Write one WARC record per row of pages, in archives of at most max_records; the number of records.

    Of records with equal payloads of at least min_revisit_bytes bytes the one with the largest id is a
    response and the others, rows without an id among them, are revisits of it; if none has an id, all
    are responses. Repeated rows are records each. Null payloads are empty, null URLs too. Without time_col, and
    where it is null, capture times are id seconds after 1970 (1970 itself without an id). White space and control characters in a URL come
    percent-encoded. Large payloads are written apart, fewer to an archive, so an archive holds
    archive_bytes of payload at most, or one record. No pages give an empty folder of archives.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    at = F.timestamp_seconds(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    at = F.coalesce(F.col(time_col).cast("timestamp"), at) if time_col else at
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"), at.alias("at"))
    slim = materialize(rows.select("id", "digest", "size"), "digests")
    same = slim.where(F.col("size") >= min_revisit_bytes)
    latest = same.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "refers_to")
    revisits = same.join(latest, F.col("digest") == F.col("d")).where(~F.col("id").eqNullSafe(F.col("refers_to"))).select(F.col("id").alias("rid"), "d", "refers_to").distinct()
    largest = slim.agg(*[F.max(F.when(F.col("size").between(low, high - 1), F.col("size"))).alias(str(low)) for low, high in _classes()], F.count("*").alias("records")).first()
    for low, high in _classes():
        if largest[str(low)] is not None or low == 0:
            most = max(1, min(max_records, archive_bytes // max(largest[str(low)] or 1, 1)))
            _write_class(rows.where(F.col("size").between(low, high - 1)), revisits, f"{path}/size-from={low}", most)
    release(slim)
    return largest["records"]


def _classes() -> list[tuple[int, int]]:
    return list(zip(SIZE_CLASSES, [*SIZE_CLASSES[1:], 1 << 62], strict=True))


def _write_class(rows: DataFrame, revisits: DataFrame, path: str, max_records: int) -> None:
    marked = rows.join(revisits.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    stamp = F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(F.col("url"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_RECORD}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", stamp),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit(f"<{_RECORD}"), F.col("refers_to"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    # The writer ends each row with LF, which completes the record's CR LF CR LF.
    record = F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))
    marked.select(record.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def parse_records(content: bytes, chunk: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the plain stream, headers by lower-case name, block) of each record; content plain or gzip."""
    unzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
    held, at, base = bytearray(), 0, 0

    def more() -> bool:
        nonlocal at
        if at >= len(content):
            return False
        part = content[at : at + chunk]
        at += chunk
        held.extend(unzip.decompress(part) if unzip else part)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in held[:end].decode("utf-8").split("\r\n")[1:])}
        stop = end + 4 + int(headers["content-length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield base, headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]
        base += stop + 4


INDEX_FIELDS = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
INDEX_TYPE = "run string, url_key string, time string, page_id bigint, offset bigint, length bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def _id(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(_RECORD)
    return int(digits) if digits else None


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is None, row[3] or 0, row[0], row[4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record of the archives under path: each archive is a run sorted by URL key, time and id.

    A response's bytes and digest are those of its payload as read, checked against its header; a
    revisit's come from its headers.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, headers, block in parse_records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    if headers["warc-type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                            raise ValueError(f"record {headers['warc-record-id']} of {run} does not match its digest")
                    rows.append((run, url_key(headers["warc-target-uri"]), headers["warc-date"], _id(headers["warc-record-id"]), offset, len(block), headers["warc-type"], size, digest, _id(headers.get("warc-refers-to"))))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(INDEX_FIELDS), INDEX_FIELDS, strict=True)], schema=INDEX_FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("run"), "content").mapInArrow(index, INDEX_TYPE)


class LoserTree:
    """Merge of k sorted iterators with one comparison per level: inner nodes hold losers, the root the winner."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [0] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            won = self.winner
            yield self.heads[won][2]
            self.heads[won] = self._next(won)
            node = (won + self.k) // 2
            while node:
                if self._beats(self.losers[node], won):
                    self.losers[node], won = won, self.losers[node]
                node //= 2
            self.winner = won


def merge_runs(index: DataFrame, rows_per_partition: int = 250_000, n: int | None = None) -> DataFrame:
    """index (n rows, counted if not given) in global order: partitions in order, and rows in each, by URL key, time, id, run and offset.

    Each partition gets its share of the sorted runs as the shuffle hands them on, block by block, and holds them as
    Arrow columns. Whatever stretch of them ascends is a run to the loser tree, which reads the runs a slice at a
    time; so an order that a shuffle breaks costs more runs and no rows. Rows without an id come last of their time. No rows give none.
    """
    n = index.count() if n is None else n
    names = INDEX_FIELDS.names

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), INDEX_FIELDS)
        if not table.num_rows:
            return
        keys = map(_order, _slices(table, 0, table.num_rows))
        edges = [0, *(k for k, (a, b) in enumerate(pairwise(keys), 1) if b < a), table.num_rows]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), INDEX_FIELDS, strict=True)], schema=INDEX_FIELDS)
            out.clear()
            return made

        for row in LoserTree([_slices(table, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)], _order):
            out.append(row)
            if len(out) == 8192:
                yield flush()
        if out:
            yield flush()

    parts = max(1, -(-n // rows_per_partition), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = ["url_key", "time", F.col("page_id").asc_nulls_last()]
    return index.select(*names).repartitionByRange(parts, *by, "run", "offset").mapInArrow(merge, INDEX_TYPE)


def _slices(table: pa.Table, first: int, end: int, step: int = 1024) -> Iterator[tuple]:
    for at in range(first, end, step):
        part = table.slice(at, min(step, end - at))
        yield from zip(*(part[name].to_pylist() for name in INDEX_FIELDS.names), strict=True)


def capture_histories(pages: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write pages as archives, read them back, and give their capture index in global order (see merge_runs).

    Archives that hold more or fewer records than there are pages are an error. Without a path they are deleted once they are read.
    """
    spark = pages.sparkSession
    archives = path or fresh_path(spark, "warc")
    written = write_archives(pages, archives, **options)
    runs = materialize(read_archives(spark, archives), "capture-runs")
    if (found := runs.count()) != written:
        raise ValueError(f"{written} records were written to {archives} and {found} are there")
    if not path:
        discard(spark, archives)
    return merge_runs(runs, n=written)
