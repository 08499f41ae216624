"""SimHash near-duplicates: segment popcounts put fingerprints on a grid, a range join finds those that can be near.

The 64 bits are 16 segments of 4; a fingerprint's counts of set bits are a point in 16 dimensions. Flipping a bit
changes one count by one, so the Manhattan distance of two points is never more than the Hamming distance of their
fingerprints. Points within distance 2 share a grid cell within distance 1 of both: each distinct fingerprint enters
its own cell and the 32 beside it, cells are joined, and what meets is verified by its exact Hamming distance.

With more fingerprints cells grow fuller. A full cell is cut by the grid of 2-bit segments, and what is full there, as in
a very large group of near copies, by the grid of single bits, whose cells are fingerprints. All that meet in one of
those are within 2 bits of each other, so they need no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, as_row, checkpointed, id_and_text, of_row, rows_without
from .components import connected_components
from .near_copies import near_copy_links

_SPACES = "\x09\x0a\x0b\x0c\x0d"
#: A cell with more fingerprints than this is not joined pair by pair.
CELL_PAIRS = 24
#: Bits of a segment in each grid.
WIDTHS = (4, 2, 1)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text; as ``fingerprints``, for one text."""
    return int(_fingerprints([text], shingle)[0])


def _fingerprints(texts: list[str], shingle: int) -> np.ndarray:
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {c: " " for c in _SPACES})
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes, sizes = [], []
    for t in texts:
        t = t.translate(table) if not t.isascii() else t.lower().translate(table)
        words = [w for w in t.split(" ") if w]
        if len(words) < shingle:
            own = [digest(" ".join(words), 42)] if words else []
        else:
            own = [digest(s, 42) for s in map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
        hashes += own
        sizes.append(len(own))
    sizes = np.array(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        most = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > sizes[full][:, None]
        out[full] = np.packbits(most, axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a bit is 1 if set in over half the XXH64 hashes (seed 42) of all ``shingle``-word shingles, repeats
    included, of the text with A-Z lower-cased. Fewer words: the whole sequence. No words: 0."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_fingerprints(part.column(1).to_pylist(), shingle).view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def segment_counts(fp: Column, width: int) -> Column:
    """Set bits of each segment of ``width`` bits (1, 2 or 4), each count in the segment's own bits of a bigint."""
    if width == 1:
        return fp
    pairs = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(pairs), F.shiftrightunsigned(fp, 1).bitwiseAND(pairs)
    if width == 2:
        return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    ones = F.lit(0x1111111111111111)
    return low.bitwiseAND(ones) + high.bitwiseAND(ones) + F.shiftrightunsigned(low, 2).bitwiseAND(ones) + F.shiftrightunsigned(high, 2).bitwiseAND(ones)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(at: Column, width: int) -> Column:
    """The grid cell of a point and those beside it."""
    if width == 1:
        return F.array(at, *[at.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    beside = []
    for i in range(0, 64, width):
        count = F.shiftrightunsigned(at, i).bitwiseAND(F.lit((1 << width) - 1))
        for step, able in ((1, count < width), (-1, count > 0)):
            beside.append(F.when(able, at.bitwiseXOR(F.shiftleft(count.bitwiseXOR(count + step), i))))
    return F.array_compact(F.array(at, *beside))


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp): links whose components are those of all pairs at 2 or fewer bits.

    Cells of up to ``CELL_PAIRS`` fingerprints are joined and verified pair by pair. Those of fuller cells enter the next
    grid. In the last one, of single bits, two fingerprints share a cell exactly if they differ by at most two bits, and
    each cell ties its members to the smallest. That is exact, and grows with the members, not with their pairs.
    """
    inside, links = prints.select("fp"), None
    for width in WIDTHS[:-1]:
        points = inside.withColumn("at", segment_counts(F.col("fp"), width))
        dealt = points.select("fp", "at", F.explode(_cells(F.col("at"), width)).alias("cell"))
        often = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        met = checkpointed(dealt.join(often, "cell"))
        few = met.where(F.col("held") <= CELL_PAIRS)
        other = few.select("cell", F.col("fp").alias("fp2"), F.col("at").alias("at2"))
        pairs = few.join(other, "cell").where((F.col("fp") < F.col("fp2")) & ((F.col("at") != F.col("at2")) | (F.col("cell") == F.col("at"))))
        near = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
        links = near if links is None else links.union(near)
        inside = met.where(F.col("held") > CELL_PAIRS).select("fp").distinct()
        if inside.isEmpty():
            return links.distinct()
    names = inside.select("fp", F.explode(_cells(F.col("fp"), 1)).alias("cell"))
    least = names.groupBy("cell").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1").select("cell", "least")
    tied = names.join(least, "cell").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return links.union(tied).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by fingerprints that differ in at most 2 bits, and their component's smallest doc_id.

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id. Equal fingerprints are one node,
    so copies are never paired. Null or blank text has fingerprint zero and links like any other. Null ids are never
    the smallest unless a component has no other. Repeated rows stay. An empty table gives no rows; other columns are
    ignored.
    """
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = checkpointed(connected_components(near_links(nodes.select("fp"))))
    rooted = nodes.join(roots, nodes["fp"] == roots["key"]).select("fp", "least_id", "root")
    component = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(component, "root").select(F.col("fp").alias("named_fp"), "component_id")
    every = nodes.join(named, nodes["fp"] == named["named_fp"], "left").select(F.col("fp").alias("node"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = prints.join(every, prints["fp"] == every["node"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): documents whose fingerprints differ by 1 or 2 bits, one pair for each two fingerprints, as ``near_links`` ties them.

    Texts without words and null ids are left out.
    """
    prints = fingerprints(docs, shingle, id_col, text_col).where("fp <> 0 and doc_id is not null")
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    a, b = (nodes.select(F.col("fp").alias(c), F.col("least_id").alias(f"id_{c}")) for c in "ab")
    return near_links(nodes.select("fp")).join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the documents that are not the smallest id of their group of near copies.

    Groups join the pairs whose Jaccard similarity of shingle sets is at least ``similarity``. The grid proposes what is
    within 2 SimHash bits; at this similarity most fingerprints differ by about 10 bits, where no grid prunes, so MinHash
    buckets propose the rest. All proposals are verified in ``near_copies``: a SimHash counts repeats, so texts within 2
    bits may share little. Texts without words are not each other's near copies here: they stay, and so do null ids and
    rows that repeat an id that stays. An empty table gives no rows.
    """
    links = near_copy_links(id_and_text(docs, id_col, text_col), similarity, shingle, near_pairs(docs, shingle, id_col, text_col))
    gone = connected_components(links).where("key <> root").select(F.col("key").alias(KEY))
    keyed = as_row(docs).withColumn(KEY, F.col(f"row.`{id_col}`").cast("bigint"))
    return of_row(rows_without(keyed, checkpointed(gone), KEY), docs)
