"""Reports and snapshots as versions that are published whole: tasks write parts, and one manifest makes them visible.

``df.write.format("tidemark_archive").mode("append").save(path)`` writes the rows of a DataFrame as JSON lines with keys in order.
Each task writes one part of its own name and tells its digest. Only when all have done so is the manifest, which lists the
parts, put in the place of the one before; until then, and if a task or the job fails, readers see the version before.
``spark.read.format("tidemark_archive").schema(...).load(path)`` reads the parts of the manifest and no other file, each in a
task of its own, and refuses a part whose digest differs. Paths are anything that pyarrow opens: shared folders, HDFS, S3.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MANIFEST, VERSION = "manifest.json", 1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def canonical(value) -> str:
    """JSON with keys in order, no spaces, and neither NaN nor infinities."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str)


def plain(value):
    """A row's values as JSON has them."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def manifest_of(path: str) -> dict:
    """The manifest that is published at ``path``; a version it doesn't know, or parts outside the folder, are refused."""
    system, root = opened(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        found = json.loads(f.read())
    if found.get("version") != VERSION or any("/" in p["name"] or p["name"].startswith(".") for p in found["parts"]):
        raise ValueError(f"{path}: the manifest is not one of version {VERSION}")
    return found


@dataclass
class Written(WriterCommitMessage):
    part: dict


@dataclass
class Part(InputPartition):
    part: dict


class PublishedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_archive"

    def schema(self) -> str:
        return manifest_of(self.options["path"])["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PublishedReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PublishedWriter(self.options["path"], schema)


class PublishedWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.ddl = path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def write(self, iterator) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name, digest, rows, size = f"part-{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0, 0
        try:
            with system.open_output_stream(f"{root}/{name}") as f:
                for row in iterator:
                    line = (canonical(plain(row)) + "\n").encode()
                    digest.update(line)
                    f.write(line)
                    rows, size = rows + 1, size + len(line)
        except BaseException:
            system.delete_file(f"{root}/{name}")
            raise
        return Written({"name": name, "sha256": digest.hexdigest(), "rows": rows, "bytes": size})

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        parts = sorted((m.part for m in messages if m), key=lambda p: p["name"])
        text = canonical({"version": VERSION, "schema": self.ddl, "rows": sum(p["rows"] for p in parts), "parts": parts})
        temporary = f"{root}/.{uuid.uuid4().hex}"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(temporary) as f:
            f.write(text.encode())
        system.move(temporary, f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.part['name']}")


class PublishedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, [f.name for f in schema]

    def partitions(self):
        return [Part(p) for p in manifest_of(self.path)["parts"]] or [Part({})]

    def read(self, partition):
        part = partition.part
        if not part:
            return
        system, root = opened(self.path)
        with system.open_input_stream(f"{root}/{part['name']}") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != part["sha256"]:
            raise ValueError(f"{part['name']} is not what was published")
        for line in data.splitlines():
            row = json.loads(line)
            yield tuple(row.get(n) for n in self.names)
