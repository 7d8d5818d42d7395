"""Contents of a repository's objects, read by one long-lived process for each partition, and snapshots made of them."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.paths import escapes

OBJECT = "oid string, type string, size long, content binary"
#: Bytes of contents that are handed over at once, about.
BATCH_BYTES = 32 << 20
SYMLINK = "120000"


def _answers(process: subprocess.Popen, oids: list[str]) -> Iterator[tuple]:
    """The answer to each id in turn: id, type, size, contents. An unknown id has the type missing."""
    for oid in oids:
        if not oid or not oid.isalnum():
            raise ValueError(f"malformed object id {oid!r}")
        process.stdin.write(oid.encode() + b"\n")
        process.stdin.flush()
        header = process.stdout.readline().decode().split()
        if len(header) == 2 and header[1] == "missing":
            yield oid, "missing", None, None
            continue
        if len(header) != 3 or not header[2].isdigit():
            raise ValueError(f"malformed object header {' '.join(header)!r}")
        content = process.stdout.read(int(header[2]))
        if len(content) != int(header[2]) or process.stdout.read(1) != b"\n":
            raise ValueError(f"object {oid} ends early")
        yield oid, header[1], int(header[2]), content


def read_objects(wanted: DataFrame, git_dir: str) -> DataFrame:
    """wanted: oid. Each distinct id once: oid, type (missing if there is no such object), size, content. All executors must see ``git_dir``; null ids are left out."""
    import pyarrow as pa

    schema = pa.schema([("oid", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def read(batches):
        process = subprocess.Popen(["git", "--git-dir", git_dir, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                rows, held = [], 0
                for row in _answers(process, batch.column(0).to_pylist()):
                    rows.append(row)
                    held += row[2] or 0
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        finally:
            process.stdin.close()
            process.kill()
            process.wait()

    return wanted.select("oid").where("oid is not null").distinct().mapInArrow(read, OBJECT)


def link_escapes(path: Column, target: Column) -> Column:
    """Whether a symbolic link at ``path`` points out of the tree: its target, read from the link's folder, is absolute or leaves the root."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    return target.startswith("/") | escapes(F.concat(folder, target))


def snapshot(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """manifest: path, blob_sha, mode; objects: as ``read_objects`` returns them. path, blob_sha, mode, size, content, executable (0/1).

    A file whose object is missing or no blob, and a link that points out of the tree, are errors.
    """
    own = manifest.select("path", "blob_sha", "mode").join(objects.select(F.col("oid").alias("blob_sha"), "type", "size", "content"), "blob_sha", "left")
    link = (F.col("mode") == SYMLINK) & link_escapes(F.col("path"), F.col("content").cast("string"))
    said = F.when(~F.col("type").eqNullSafe(F.lit("blob")), "no blob for ").when(link, "symbolic link leaves the tree at ")
    path = F.when(said.isNull(), F.col("path")).otherwise(F.raise_error(F.concat(said, "path")))
    return own.select(path.alias("path"), "blob_sha", "mode", "size", "content", (F.col("mode") == "100755").cast("long").alias("executable"))
