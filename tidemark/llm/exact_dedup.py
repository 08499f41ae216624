"""Exact deduplication by a Golomb-coded fingerprint exchange and a byte-wise check of the suspects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, as_row, ascii_lower, checkpointed, id_and_text, of_row, rows_of, rows_without, text_or_empty
from .exchange import ANSWER, SENT, answered, answers, sent_blobs

#: Fingerprints a partition of the exchange holds, about.
PART_ROWS = 250_000


def _marked(docs: DataFrame, part_rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, k (a hash of id and text), sha, and keep_id and group_size where it has copies."""
    norm = id_and_text(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    digests = norm.select("doc_id", F.xxhash64("norm").alias("h"), F.xxhash64("doc_id", "norm").alias("k"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    rows = checkpointed(digests)
    parts = max(1, -(-rows.count() // part_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prints = rows.select("h", F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(parts)).cast("int").alias("part"))

    def send(table: pa.Table) -> pa.Table:
        values = np.unique(table["h"].to_numpy().astype(np.uint64))
        return pa.Table.from_batches([sent_blobs(table["part"][0].as_py(), values, parts)])

    def suspects(table: pa.Table, back: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().astype(np.uint64)
        values, times = np.unique(h, return_counts=True)
        seen = answered(back, len(values)) | (times > 1)
        return pa.table({"h": pa.array(values[seen].view(np.int64))})

    back = answers(prints.groupBy("part").applyInArrow(send, SENT)).select(*[c.split()[0] for c in ANSWER.split(", ")])
    suspect = checkpointed(prints.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(suspects, "h bigint").distinct())
    texts = rows_of(norm.withColumn("h", F.xxhash64("norm")), suspect, "h")
    groups = texts.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    return rows.drop("h").join(groups, "sha", "left")


def exact_duplicates(docs: DataFrame, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z; the row with the largest doc_id stays.

    Fingerprints (64 bits) and digests of all texts are read once and kept in the shared folder. Partitions and owners
    exchange them as in ``exchange``; what comes back are suspected fingerprints. Texts that have one, and no others (see
    ``rows_of``), are then grouped by all their bytes, with partial sums before the shuffle, so a very large group
    arrives as one row per task.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty and
    forms a group with empty texts. Rows that repeat a doc_id within a group all count in group_size and all are kept
    if theirs is the largest. A null doc_id is the smallest. An empty table gives no rows; other columns are ignored.
    """
    out = _marked(docs, part_rows, id_col, text_col)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, and of each group of equal texts the row with the largest id alone.

    Of rows that repeat that id with that text, or of copies that all have a null id, the one with the least hash of
    all its columns, as JSON, stays. Null text counts as empty. An empty table gives no rows. Columns of any name and type,
    maps too, are carried as one.
    """
    copies = checkpointed(_marked(docs, PART_ROWS, id_col, text_col).where("group_size is not null").select("doc_id", "keep_id", F.col("k").alias(KEY)))
    gone = copies.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(KEY)
    again = copies.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(KEY).count().where("count > 1").select(KEY)
    row = as_row(docs)
    keyed = row.select("row", F.xxhash64(F.col(f"row.`{id_col}`").cast("bigint"), ascii_lower(text_or_empty(f"row.`{text_col}`"))).alias(KEY))
    rest = rows_without(keyed, checkpointed(gone.union(again).distinct()), KEY).select("row")
    if not again.isEmpty():
        one = rows_of(keyed, again, KEY).groupBy(KEY).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        rest = rest.union(one.select("row"))
    return of_row(rest, docs)
