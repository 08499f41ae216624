"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each 5-word shingle is hashed once; its high bits name one of ``BINS`` bins and each bin keeps its least hash. A bin
without a shingle copies the bin that its own probe sequence, a fixed pseudo-random one for each bin, meets first
among the filled ones (optimal densification). Of each bin the low 8 bits are kept. Two fingerprints' share of equal
bins, corrected for the one in 256 that are equal by chance, estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

BINS, BITS, SHINGLE = 128, 8, 5
#: Probes of an empty bin before the filled bins are ranked for it one by one, which happens in very short texts.
PROBES = 10
#: Documents of a range of ids that one window partition holds, about.
BUCKET_ROWS = 20_000
#: Ranges at most; with more documents than these hold, ranges grow instead.
MOST_BUCKETS = 50_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _least_by_bin(hashes: Column) -> Column:
    """The least hash of each bin, in the order of the bins: after sorting, the first of each run of high bits."""
    return _let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))


def _bin(h: Column) -> Column:
    """The bin of a hash: its 7 high bits, in the order in which signed hashes sort."""
    return F.shiftrightunsigned(h, 57).cast("int").bitwiseXOR(F.lit(64))


def _half(p: Column, low: Column, high: Column) -> Column:
    return F.when(p < 64, low).otherwise(high)


def _densified(least: Column) -> Column:
    """One signed byte for each bin: the low bits of its own or its donor's least hash."""

    def with_bins(bins: Column) -> Column:
        def mask(upper: bool) -> Column:
            inside = F.filter(bins, lambda b: (b >= 64) if upper else (b < 64))
            return F.aggregate(inside, F.lit(0).cast("bigint"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))

        def with_masks(masks: Column) -> Column:
            low, high = masks[0], masks[1]

            def filled(p: Column) -> Column:
                return F.call_function("shiftrightunsigned", _half(p, low, high), p).bitwiseAND(F.lit(1).cast("bigint")) == 1

            def rank(p: Column) -> Column:
                below = _half(p, low, high).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), p)))
                return F.bit_count(below) + F.when(p < 64, 0).otherwise(F.bit_count(low))

            def donor(i: Column) -> Column:
                chosen = F.when(filled(i), i)
                for k in range(PROBES):
                    p = F.hash(i, F.lit(k)).bitwiseAND(F.lit(BINS - 1))
                    chosen = chosen.when(filled(p), p)
                ranked = F.array_min(F.transform(bins, lambda b: F.struct(F.hash(i, b, F.lit(-1)).alias("h"), b.alias("b"))))
                return chosen.otherwise(ranked["b"])

            low_bits = lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")) - 128).cast("tinyint")
            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: low_bits(F.get(least, rank(donor(i)))))

        return _let(F.array(mask(False), mask(True)), with_masks)

    return _let(F.transform(least, _bin), with_bins)


def fingerprint(text: Column) -> Column:
    """array<tinyint> of ``BINS`` values; empty where the text has no words. Fewer than 5 words are one shingle."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    least = _let(hashed, lambda w: _least_by_bin(shingles(w)))
    return _let(least, lambda x: F.when(F.size(x) > 0, _densified(x)).otherwise(F.array().cast("array<tinyint>")))


def as_text(fp: Column) -> Column:
    """The packed bits in hex."""
    digits = F.array(*[F.lit(f"{v:02x}") for v in range(256)])
    return F.array_join(F.transform(fp, lambda v: F.get(digits, v.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1. Two texts without words: 1; one without: 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)).cast("double") / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.least(F.greatest((equal - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``doc_id``, by halving steps; -1 where it is null."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    below = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) <= doc_id), at + step).otherwise(at)
    return F.when(doc_id.isNull(), -1).otherwise(F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), below))


def with_next(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (doc_id, text, fp) with the text and fp of the next row in descending doc_id; after the last, the first.

    Ids are cut into ranges of about equal numbers of rows, at quantiles of all ids, and each range is one window
    partition; there are at most ``MOST_BUCKETS``, so the table of their first rows, which is broadcast, is bounded. The
    first row of a range is also sent to the range above it, as the row after its last one. Equal ids follow each other
    by text, in one range; null ids come last.
    """
    spark = rows.sparkSession
    n = rows.count()
    several = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # ranges for each task, so that tasks are about equal
    buckets = min(max(1, -(-n // bucket_rows), min(n, several)), MOST_BUCKETS)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets))).first()[0] if shares else None
    bounds = sorted(set(cuts or []))
    bucket = _range_of(F.col("doc_id"), bounds)
    firsts = sorted(rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("first_id")).collect())
    above = [firsts[(i + 1) % len(firsts)][0] for i in range(len(firsts))]
    places = [(b, first, to) for (b, first), to in zip(firsts, above, strict=True)]
    firsts = spark.createDataFrame(places, "first_bucket int, first_id bigint, to_bucket int")
    held = rows.withColumn("bucket", bucket)
    held = held.join(F.broadcast(firsts), (held["bucket"] == firsts["first_bucket"]) & held["doc_id"].eqNullSafe(firsts["first_id"]), "left")
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    guest = F.when(F.col("to_bucket").isNotNull(), F.struct(F.col("to_bucket").alias("b"), F.lit(True).alias("guest")))
    dealt = held.select("doc_id", "text", "fp", F.explode(F.array_compact(F.array(own, guest))).alias("place"))
    dealt = dealt.select("doc_id", "text", "fp", F.col("place.b").alias("b"), F.col("place.guest").alias("guest"))
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    ahead = dealt.withColumn("next", F.lead(F.struct("text", "fp")).over(order)).where(~F.col("guest"))
    return ahead.select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how alike the fingerprints are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in descending doc_id. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null text is empty: 0 characters, an empty fingerprint. A single row is its own next.
    Repeated rows stay, one after the other. An empty table gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    both = with_next(rows.withColumn("fp", fingerprint(F.col("text"))))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    out = both.select("doc_id", n.cast("bigint").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
