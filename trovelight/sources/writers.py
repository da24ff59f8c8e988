"""Writing: snapshots behind a pointer, Markdown trees, sharded look-up tables, JSON exports."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import BuildError
from ..operators.common import broadcast_if_small
from ..operators.export import SECTIONS, canonical_path
from ..operators.render import node_markdown


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def create_text_file(spark: SparkSession, path: str, text: str) -> bool:
    """A small new file in any store that Spark reaches, whole or not at all; False if the path is taken."""
    fs, target, jvm = _fs(spark, path)
    if fs.exists(target):
        return False
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:  # a rename that doesn't overwrite lets one of several writers win
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(part, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:  # noqa: BLE001  what Java throws
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


class SnapshotStore:
    """Tables in versioned folders. Pointers are numbered files that never change: the largest number holds.

    A pointer maps each table to the version that has it. It is created once its tables are complete, so readers
    see the old state or the new, and a publisher whose base has moved on meanwhile is refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> list[int]:
        fs, folder, _ = _fs(self.spark, f"{self.root}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _tables(self, number: int) -> dict[str, str]:
        try:
            rows = self.spark.read.text(f"{self.root}/pointers/{number:08d}").collect()
        except Py4JJavaError as e:  # it was there when the read was planned
            if "FILE_NOT_EXIST" in str(e) or "FileNotFoundException" in str(e):
                raise PySparkException(f"NOT_EXIST: pointer {number} of {self.root} was dropped by another writer") from e
            raise
        return json.loads("\n".join(r.value for r in rows))

    def current(self) -> str | None:
        found = self._pointers()
        return f"{found[-1]:08d}" if found else None

    def tables(self) -> list[str]:
        """Names of the tables that the newest pointer has."""
        found = self._pointers()
        return sorted(self._tables(found[-1])) if found else []

    def has(self, table: str) -> bool:
        return table in self.tables()

    def read(self, table: str) -> DataFrame:
        found = self._pointers()
        if not found:
            raise FileNotFoundError(f"{self.root} holds no snapshot")
        return self.spark.read.parquet(f"{self.root}/{self._tables(found[-1])[table]}/{table}")

    def publish(self, tables: dict[str, DataFrame | Callable], check=None, keep: int = 2, keep_others: bool = False, base: str | None = "") -> str:  # noqa: ANN001
        """Write the tables, let check(read) refuse them, then switch. With keep_others the other tables stay as they are.

        A table may be given as a function of read, by which it is made from those written ahead of it.

        The states of the newest keep pointers stay readable; folders that none of them names go. base, if given, is what
        current() told when the caller began to read; a newer state is refused.
        """
        before = self._pointers()
        if base != "" and base != self.current():
            raise BuildError(f"{self.root} has a newer state than the one that this build began with")
        base = before[-1] if before else 0
        version = f"v={base + 1:08d}-{uuid.uuid4().hex[:8]}"
        new = lambda table: self.spark.read.parquet(f"{self.root}/{version}/{table}")
        for name, df in tables.items():
            (df(new) if callable(df) else df).write.parquet(f"{self.root}/{version}/{name}")
        if check is not None:
            check(new)
        listed = (self._tables(base) if keep_others and base else {}) | dict.fromkeys(tables, version)
        self._switch(base, listed, version, before, keep)
        return version

    def _switch(self, base: int, listed: dict[str, str], version: str, before: list[int], keep: int) -> None:
        """Let the pointer after base tell of listed; the version goes if another writer was first."""
        if not self._point(base, listed):
            self._drop(version)
            raise BuildError(f"{self.root} has a newer state than the one that this build began with")
        self._clear([*before, base + 1], keep)

    def _point(self, base: int, listed: dict[str, str]) -> bool:
        return create_text_file(self.spark, f"{self.root}/pointers/{base + 1:08d}", json.dumps(listed, sort_keys=True))

    def _clear(self, held: list[int], keep: int) -> None:
        """Drop what only pointers ahead of the newest keep name. Several writers may do so at once."""

        def named(numbers: list[int]) -> set[str]:
            out: set[str] = set()
            for n in numbers:
                try:
                    out |= set(self._tables(n).values())
                except PySparkException:  # another writer has dropped it
                    continue
            return out

        kept = named(held[-keep:])
        for old in [*sorted(named(held[:-keep]) - kept), *(f"pointers/{n:08d}" for n in held[:-keep])]:
            self._drop(old)

    # --- tables in parts: a pointer names each part's version, as "table/bucket=7" or "table/part=..." ---

    def parts(self, table: str) -> dict[str, str]:
        """The parts of a table, as the newest pointer has them, and their folders."""
        found = self._pointers()
        listed = self._tables(found[-1]) if found else {}
        return {k: f"{self.root}/{v}/{k}" for k, v in sorted(listed.items()) if k.startswith(f"{table}/")}

    def read_parts(self, table: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
        """A table in parts, or some buckets of it, without the column bucket; no rows if there is none."""
        found = self.parts(table)
        paths = list(found.values()) if buckets is None else [found[k] for b in buckets if (k := f"{table}/bucket={b}") in found]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scattered(self, table: str, buckets: list[int], most: int = 8, small: int = 16 << 20) -> bool:
        """True if these buckets of a table have more than most files each on average, and small ones."""
        found = self.parts(table)
        sums = [fs.getContentSummary(p) for b in buckets if (k := f"{table}/bucket={b}") in found for fs, p, _ in [_fs(self.spark, found[k])]]
        files = sum(x.getFileCount() for x in sums)
        return files > most * len(sums) and sum(x.getLength() for x in sums) < small * files

    def publish_parts(self, tables: dict[str, DataFrame | Callable], written: dict[str, list[int]] | None, whole: dict[str, DataFrame] | None = None, base: str | None = "", check=None, keep: int = 2, lying: dict[str, DataFrame] | None = None) -> str:  # noqa: ANN001
        """Write parts of tables by their column bucket (and whole small tables), then switch.

        Of the buckets in written (None: all) what is written takes the place of what was there, none where no row is left; other parts stay
        where they are. A table may be given as a function of read, by which it is made from those written ahead of it. Rows of a table in
        lying are read from its parts, so they are written where they are read instead of being shuffled. check(read) sees the rows just written.
        """
        before = self._pointers()
        if base != "" and base != self.current():
            raise BuildError(f"{self.root} has a newer state than the one that this build began with")
        number = before[-1] if before else 0
        version = f"v={number + 1:08d}-{uuid.uuid4().hex[:8]}"
        listed = self._tables(number) if number else {}
        schemas = {}
        new = lambda table: self.spark.read.schema(schemas[table]).option("recursiveFileLookup", "true").parquet(f"{self.root}/{version}/{table}")
        for name, given in tables.items():
            path = f"{self.root}/{version}/{name}"
            df = given(new) if callable(given) else given
            schemas[name] = df.drop("bucket").schema
            dealt = df.hint("rebalance", "bucket")  # large buckets may be several files
            both = dealt.unionByName(lying[name]) if lying and name in lying else dealt
            both.write.partitionBy("bucket").parquet(path, compression="zstd")
            fs, folder, _ = _fs(self.spark, path)
            made = [int(n.split("=")[1]) for x in fs.listStatus(folder) if (n := x.getPath().getName()).startswith("bucket=")]
            for k in [k for k in listed if k.startswith(f"{name}/bucket=")]:
                if written is None or int(k.split("=")[1]) in written[name]:
                    del listed[k]
            listed |= {f"{name}/bucket={b}": version for b in made}
        for name, df in (whole or {}).items():
            df.write.parquet(f"{self.root}/{version}/{name}")
            listed[name] = version
        if check is not None:
            check(new)
        self._switch(number, listed, version, before, keep)
        return version

    def _retry(self, once: Callable[[], bool], attempts: int) -> None:
        for n in range(attempts):
            if once():
                return
            time.sleep(random.uniform(0, 0.02 * 2 ** min(n, 6)))
        raise BuildError(f"{self.root}: others were first {attempts} times")

    def append(self, table: str, rows: DataFrame, attempts: int = 30, keep: int = 2) -> str:
        """Add rows to a table in parts. They are written once; only the pointer is tried again where writers meet, so all writers' rows stay."""
        name = uuid.uuid4().hex
        version, part = f"v=added-{name}", f"{table}/part={name}"
        rows.write.parquet(f"{self.root}/{version}/{part}")

        def once() -> bool:
            before = self._pointers()
            try:
                listed = self._tables(before[-1]) if before else {}
            except PySparkException:  # the pointer was dropped meanwhile
                return False
            last = before[-1] if before else 0
            if not self._point(last, listed | {part: version}):
                return False
            self._clear([*before, last + 1], keep)
            return True

        self._retry(once, attempts)
        return version

    def merge_parts(self, table: str, schema: StructType, keep: int = 2) -> str:
        """Write the parts there are as one. Parts that others add meanwhile stay beside it."""
        merged = self.parts(table)
        name = uuid.uuid4().hex
        version, part = f"v=added-{name}", f"{table}/part={name}"
        self.spark.read.schema(schema).parquet(*merged.values()).write.parquet(f"{self.root}/{version}/{part}")

        def once() -> bool:
            before = self._pointers()
            try:
                listed = self._tables(before[-1])
            except PySparkException:
                return False
            if not set(merged) <= set(listed):
                self._drop(version)
                raise BuildError(f"{self.root}: the parts of {table} were merged by another writer")
            if not self._point(before[-1], {k: v for k, v in listed.items() if k not in merged} | {part: version}):
                return False
            self._clear([*before, before[-1] + 1], keep)
            return True

        self._retry(once, 30)
        return version

    def update(self, table: str, make: Callable[[DataFrame | None], DataFrame], attempts: int = 30, keep: int = 2) -> None:
        """Replace a table by make(what it holds, or None), made again from the newest state where another writer was first. For bounded tables."""

        def once() -> bool:
            try:
                base = self.current()
                held = self.read(table) if base and self.has(table) else None
                self.publish({table: make(held)}, keep=keep, keep_others=True, base=base)
            except (BuildError, PySparkException) as e:
                if isinstance(e, BuildError) or "NOT_EXIST" in str(e) or "PATH_NOT_FOUND" in str(e):
                    return False
                raise
            return True

        self._retry(once, attempts)

    def _drop(self, name: str) -> None:
        fs, path, _ = _fs(self.spark, f"{self.root}/{name}")
        fs.delete(path, True)


def write_markdown_tree(nodes: DataFrame, path: str) -> None:
    """Each node's Markdown with frontmatter, in folders by document."""
    meta = {c: F.col(c) for c in ("doc_id", "node_id", "kind", "label", "title", "parent_id", "source_version", "ordinal", "is_leaf", "is_active") if c in nodes.columns}
    rows = nodes.select(F.col("doc_id").alias("doc"), node_markdown(meta, F.coalesce("body_md", F.lit(""))).alias("value"))
    rows.write.mode("overwrite").partitionBy("doc").option("maxRecordsPerFile", 1).text(path)


def prefix_shards(rows: DataFrame, name: str, max_rows: int = 200, max_len: int = 4) -> DataFrame:
    """rows with shard: the shortest prefix of name, up to max_len characters, that max_rows rows at most share.

    Prefixes that more rows share are counted map-side in one pass; they are few, and broadcast if they are.
    """
    clean = F.trim(F.coalesce(F.col(name), F.lit("")))
    prefixes = F.array(*[F.substring(clean, 1, n) for n in range(1, max_len)])
    counts = rows.select(F.posexplode(prefixes).alias("n", "prefix")).groupBy("n", "prefix").agg(F.count("*").alias("rows")).where(F.col("rows") > max_rows)
    large = broadcast_if_small(counts.select((F.col("n") + 1).alias("n"), "prefix"))
    out = rows.withColumns({f"_p{n}": F.substring(clean, 1, n) for n in range(1, max_len + 1)})
    for n in range(1, max_len):
        out = out.join(large.where(F.col("n") == n).select(F.col("prefix").alias(f"_k{n}")), F.col(f"_p{n}") == F.col(f"_k{n}"), "left")
    shard = F.col(f"_p{max_len}")
    for n in range(max_len - 1, 0, -1):
        shard = F.when(F.col(f"_k{n}").isNull(), F.col(f"_p{n}")).otherwise(shard)
    return out.withColumn("shard", shard).drop(*[f"_p{n}" for n in range(1, max_len + 1)], *[f"_k{n}" for n in range(1, max_len)])


#: Names that some file systems keep for devices.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]]


def shard_file_name(shard: Column) -> Column:
    """A shard's name as a file name: U and code points where a character or the name isn't allowed."""
    cut = F.substring(shard, 1, 32)
    codes = F.array_join(F.transform(F.filter(F.split(cut, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c)), 4, "0")), "-")
    odd = F.upper(cut).isin(*RESERVED) | cut.rlike(r'[\x00-\x1f<>:"/\\|?*. ]')
    return F.when(cut == "", "_EMPTY").when(odd, F.concat(F.lit("U"), codes)).otherwise(cut)


def write_sharded_index(rows: DataFrame, path: str, name: str, **limits: int) -> None:
    """Tab-separated files by shard, and _shards with shard and row count."""
    placed = prefix_shards(rows, name, **limits).withColumn("shard", shard_file_name(F.col("shard")))
    placed.repartition("shard").sortWithinPartitions("shard", name).write.mode("overwrite").partitionBy("shard").option("sep", "\t").option("header", "true").csv(f"{path}/shards")
    placed.groupBy("shard").agg(F.count("*").alias("rows")).coalesce(1).orderBy("shard").write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{path}/_shards")


def export_contract(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per section of operators.export.sections(), each globally sorted by its keys."""
    for section, rows in sections.items():
        rows.orderBy(*SECTIONS[section]).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{section}")


def read_contract(spark: SparkSession, path: str, like: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections of an export, with the schemas of `like`."""
    return {section: spark.read.schema(df.schema).json(f"{path}/{section}") for section, df in like.items()}


def write_canonical_texts(texts: DataFrame, path: str) -> None:
    """Canonical texts (doc_id, source_version, text), one file each, in a folder named by canonical_path()."""
    rows = texts.select(canonical_path().alias("file"), F.regexp_replace("text", r"\n\z", "").alias("value"))
    rows.write.mode("overwrite").partitionBy("file").option("maxRecordsPerFile", 1).text(path)


def write_manifest(manifest: DataFrame, path: str, title: str) -> None:
    """Manifest rows as JSON lines, sorted, with the corpus title in each."""
    manifest.withColumn("corpus_title", F.lit(title)).orderBy("doc_id", "source_version", F.desc("active_version")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_build_state(state: DataFrame, path: str) -> None:
    """One JSON line per document and version, sorted; a complete new folder takes the place of the old one."""
    state.orderBy("doc_id", "source_version").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def canonical_json(value: object) -> str:
    """Sorted keys, floats to six places, a line feed at the end."""

    def rounded(v: object) -> object:
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, dict):
            return {str(k): rounded(x) for k, x in v.items()}
        return [rounded(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(rounded(value), ensure_ascii=False, sort_keys=True, indent=2) + "\n"
