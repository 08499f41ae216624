"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A column beside those of the documents.
KEY = "_tidemark_key"
#: And those of a bitmap of keys; the columns of documents are one, ``row``, beside them.
PLACE, WORD, BITS = f"{KEY}_place", f"{KEY}_word", f"{KEY}_bits"
#: Rows and bytes of an Arrow batch between Spark and Python.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` where they are larger.

    A batch is held several times over, and texts may be long. Jobs call this once; operators leave the session alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))
    return spark


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as bigint and ``text`` with null as empty; every other column, clashing names included, is left out."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))


def as_row(docs: DataFrame) -> DataFrame:
    """``row``: all columns of ``docs`` as one struct, so that none clashes with what is put beside them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def of_row(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Rows of a table that is broadcast, and of one whose ids are broadcast as a bitmap; beyond it texts are joined by a shuffle.
BROADCAST_ROWS, BITMAP_ROWS = 500_000, 8_000_000


def rows_of(texts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The inner join of ``texts`` with ``found`` by ``key``, moving as few texts as the size of ``found`` allows.

    Up to ``BROADCAST_ROWS``, ``found`` is broadcast. Up to ``BITMAP_ROWS``, a bitmap of its keys' hashes, 16 bits for
    each key, is broadcast first, and only texts that pass it are shuffled. A larger ``found`` is joined as it is.
    """
    n = found.count()
    if n <= BROADCAST_ROWS:
        return texts.join(F.broadcast(found), key)
    if n <= BITMAP_ROWS:
        texts = _bitmap_filtered(texts, found, key, n)
    return texts.join(found, key)


def rows_without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` whose ``key`` is not in ``gone`` (key), null keys included; moves texts as sparingly as ``rows_of``."""
    n = gone.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), key, "left_anti")
    if n > BITMAP_ROWS:
        return docs.join(gone, key, "left_anti")
    placed, met = _placed(docs, gone, key, n)
    clear = placed.where(~met).select(*docs.columns)
    return clear.unionByName(placed.where(met).select(*docs.columns).join(gone, key, "left_anti"))


def _bitmap_filtered(texts: DataFrame, found: DataFrame, key: str, n: int) -> DataFrame:
    placed, met = _placed(texts, found, key, n)
    return placed.where(met).select(*texts.columns)


def _placed(texts: DataFrame, found: DataFrame, key: str, n: int) -> tuple[DataFrame, Column]:
    """``texts`` beside their words of a bitmap of ``found``'s keys, and whether a row's bit is set."""
    words = 1 << max(1, (n // 4).bit_length())
    place = F.xxhash64(F.col(key), F.lit(3))
    word = F.shiftrightunsigned(place, 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr(f"shiftleft(1L, cast(pmod({PLACE}, 64) as int))")
    bits = found.select(place.alias(PLACE), word.alias(WORD)).groupBy(WORD).agg(F.bit_or(bit).alias(BITS))
    placed = texts.withColumn(PLACE, place).withColumn(WORD, word)
    return placed.join(F.broadcast(bits), WORD, "left"), F.coalesce(F.col(BITS).bitwiseAND(bit) != 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, so that a lost executor costs one read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: as ``checkpointed``, but compressed and by columns."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
