"""Line deduplication in DataFrame functions: hashes travel and are sorted, bitmaps of dropped lines come back.

1. Each line of at least ``min_chars`` characters becomes (96 bits of hash, document, position); texts stay where they are.
2. A key that stands on fewer than ``min_docs`` lines can't be in as many documents; sums by key, combined in each task
   first, leave only the others. A key with very many lines is dealt to slots of about ``SLOT_LINES``.
3. What is left is partitioned by ranges of (key, slot) and sorted by document and position within them. A stream over
   each slot yields the first occurrences of its ``min_docs`` largest documents and no more; they tell whether the key is
   in enough documents, and in which it stays.
4. The positions that go are gathered by document as a run-length coded bitmap, which is joined to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, text_or_empty, written

#: Lines of a key that are sorted together, about.
SLOT_LINES = 256
#: What a null id counts as.
_NO_ID = -(1 << 63)
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h", "g"]
_ROW = ["document", "print"]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """document and print (which together name a row, equal rows alike), text, and the whole row in ``held``."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    text = text_or_empty(f"held.`{text_col}`")
    return held.select(F.coalesce(F.col(f"held.`{id_col}`").cast("bigint"), F.lit(_NO_ID)).alias("document"), F.xxhash64(text).alias("print"), text.alias("text"), "held")


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """document, print, at (from 0), and the hashes of each line's key that is long enough."""
    line = rows.select(*_ROW, F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("at", "line"))
    key = line.select(*_ROW, "at", F.btrim("line", F.lit(_SPACE)).alias("key")).where(F.char_length("key") >= min_chars)
    return key.select(*_ROW, "at", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def _staying(repeated: DataFrame, min_docs: int) -> DataFrame:
    """h, g, stays: keys in at least ``min_docs`` documents, and the largest document of each."""
    slot = Window.partitionBy(*_KEY, "slot").orderBy(F.desc("document"), "print", "at")
    ranged = repeated.repartitionByRange(F.col("h"), F.col("g"), F.col("slot"))
    first = ranged.withColumn("nth", F.dense_rank().over(Window.partitionBy(*_KEY, "slot").orderBy(F.desc("document")))).where(F.col("nth") <= min_docs)
    first = first.withColumn("before", F.lag("document").over(slot)).where(~F.col("before").eqNullSafe(F.col("document")))
    found = first.groupBy(*_KEY).agg(F.max("document").alias("stays"), F.count_distinct("document").alias("n"))
    return found.where(F.col("n") >= min_docs).drop("n")


def _runs(positions: Column) -> Column:
    """Sorted positions as an array of (first, last), one for each run of neighbours."""
    begins = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    ends = F.filter(positions, lambda p, i: F.coalesce(F.get(positions, i + 1) != p + 1, F.lit(True)))
    return F.arrays_zip(begins.alias("first"), ends.alias("last"))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document, print, runs: for each row that loses lines, an array of the first and last of each run of them (from 0).

    ``document`` is the id (null as the smallest bigint), ``print`` a hash of the text.
    """
    return _dropped(_identified(docs, id_col, text_col), min_chars, min_docs)


def _dropped(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    lines = written(_lines(rows, min_chars), "lines")
    # Written, so that both sides of the join are plain exchanges: adaptive execution can split a frequent key then.
    keys = written(lines.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= min_docs), "line-keys")
    slot = F.pmod(F.xxhash64(*_ROW, "at"), F.ceil(F.col("lines") / SLOT_LINES))
    repeated = written(lines.join(keys, _KEY).select(*lines.columns, slot.alias("slot")), "repeated-lines")
    gone = repeated.join(written(_staying(repeated, min_docs), "line-keys"), _KEY).where("document != stays")
    return gone.groupBy(*_ROW).agg(F.sort_array(F.collect_set("at")).alias("at")).select(*_ROW, _runs(F.col("at")).alias("runs"))


def _with_runs(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """held, lines, n_dropped and ``kept``, the lines that stay, for every row."""
    rows = _identified(docs, id_col, text_col)
    found = written(_dropped(rows, min_chars, min_docs), "dropped-lines")
    met = rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, _ROW, "left")
    runs = F.transform("runs", lambda r, i: F.concat(F.array_repeat(F.lit(True), r["first"] - F.coalesce(F.get(F.col("runs"), i - 1)["last"], F.lit(-1)) - 1), F.array_repeat(F.lit(False), r["last"] - r["first"] + 1)))
    lines = F.split("text", "\n")
    flagged = F.filter(F.arrays_zip(lines.alias("line"), F.flatten(runs).alias("stays")), lambda x: F.coalesce(x["stays"], F.lit(True)))
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform(flagged, lambda x: x["line"]), "\n"))
    n_dropped = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return met.select("held", F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(n_dropped, F.lit(0).cast("bigint")).alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops lines whose key is in at least ``min_docs`` documents, except in the largest document that holds it.

    Lines are what lies between newlines; a line's key is without space and 0x09-0x0D at both ends and with A-Z lowered.
    Keys shorter than ``min_chars`` characters stay everywhere. Returns doc_id, n_lines, n_dropped, and kept_sha256 of the
    other lines joined by newlines.

    Null or empty text is one empty line. A document is an id: rows that repeat one count once, and all its lines of a
    key stay or go together; null ids are one document, the smallest. A line that repeats within a document counts
    once. Keys are equal if 96 bits of hash are. Texts of any length are taken whole; an empty table gives no rows; other
    columns are ignored.
    """
    out = _with_runs(docs, min_chars, min_docs, id_col, text_col)
    return out.select(F.col(f"held.`{id_col}`").cast("bigint").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and without the lines that ``line_dedup`` drops; other texts, null included, are unchanged."""
    out = _with_runs(docs, min_chars, min_docs, id_col, text_col)
    cut = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col(f"held.`{text_col}`")).alias(text_col)
    return out.select(*[cut if c == text_col else F.col(f"held.`{c}`").alias(c) for c in docs.columns])
