"""Documents to packed training sequences: five stages, each one operator of trovelight.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents. Stages are written as Parquet and reread, so a lost executor never reaches back
further than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm.common import materialize, release
from trovelight.llm.line_dedup import apply_bitmaps, line_bitmaps, line_columns
from trovelight.llm.near_dedup import near_representatives
from trovelight.llm.packing import PACKING_WEIGHTS, pack_sequences
from trovelight.llm.quality import kept_documents, plan_cascade
from trovelight.llm.secrets import redact_secrets
from trovelight.llm.tokens import token_pieces, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_lengths(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its texts are now, if it has that column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some quality rule rejects go.

    A null or empty text has too few words, so its row goes. Repeated rows are judged alike; ids and other
    columns are not looked at and stay as they are. An empty table stays empty. Texts are read whole.
    """
    return kept_documents(docs, plan_cascade(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, but for their first occurrence by doc_id and position; documents stay.

    Rows with equal id and text are one document and lose the same lines; rows without an id are documents by
    their text and come first. A null text becomes an empty one. An empty table stays empty. Columns stay, whatever
    their names; n_chars is counted again.
    """
    *_, kept = line_columns(docs)
    lined = apply_bitmaps(docs, line_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True))
    return _with_lengths(lined.select(*[F.col(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their 5-word shingles, the one with the smallest doc_id stays.

    Rows are told by id and text, so a row never takes along another with its id, or another without one. A
    row without an id stays only if no row of its group has one; ties go by a hash of the text. Of rows
    with equal id and text one stays. Texts without words (null, empty) are one group. An empty table stays empty;
    texts are shingled whole; columns stay, whatever their names.
    """
    return near_representatives(docs, shingle=5, tenths=8, seed=42)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, with its columns, and a null text stays null. n_chars is counted again."""
    return _with_lengths(redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence of at most 2048 tokens and their place in it.

    Every row is a document, also where ids repeat or are null; a null or empty text is its end token alone.
    An empty table gives no pieces. Of other columns only the id is returned.
    """
    pieces = token_pieces(docs, *vocabulary(), capacity=2048, end_id=0)
    told = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack_sequences(told, told.count(), tokens=2048, weights=PACKING_WEIGHTS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: XXH64 fingerprints and tokens are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, done = materialize(stage(spark, docs, sf_dir), name), docs
        release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
