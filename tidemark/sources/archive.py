"""Archives: manifests with digests, their check, and reports written in one piece."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, directory: str) -> DataFrame:
    """path (below the directory), sha256 and bytes of every file but manifest.json, digested where the files are read."""
    root = directory.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].lstrip("/") + "/" if ":" in root else root + "/"
    out = files.select(F.substr(name, F.lit(len(base) + 1)).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return out.where("path <> 'manifest.json'")


def mismatches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, not listed, or differ; and listed paths that leave the directory."""
    both = expected.alias("e").join(found.alias("f"), "path", "full_outer")
    why = F.when(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."), "escapes")
    why = why.when(F.col("f.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unlisted").when((F.col("e.sha256") != F.col("f.sha256")) | (F.col("e.bytes") != F.col("f.bytes")), "differs")
    return both.select("path", why.alias("reason")).where("reason is not null")


def write_report(path: str, value) -> None:
    """A small report as JSON with sorted keys, no NaN, replaced in one step; tables are written by ``df.write`` instead."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    text = json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".report-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def markdown(title: str, metrics: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small table of metrics; null is a dash. More than ``limit`` rows are an error, and none is cut."""
    rows = metrics.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report: write them as a table")
    head = metrics.columns
    show = lambda v: "—" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]]
    return "\n".join(lines) + "\n"
