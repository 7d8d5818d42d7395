"""What the training-data operators share: shared-folder tables, text as bytes, vectorised hashes."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+`` and of ``bytes.split()``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Set here where it is unset, on a local master; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")  # one process: there is nothing to share with
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free(taken: list[str], *names: str) -> list[str]:
    """``names``, each under as many underscores as no column of ``taken`` has, whatever the case."""
    known = {c.lower() for c in taken}
    mark = "_"
    while any(f"{mark}{n}".lower() in known for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it again.

    The files outlive lost executors. They stay until the folder is emptied, as with checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; a cluster gets it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as one uint8 array and the n + 1 offsets of its rows; null: empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; UTF-8 sequences stay."""
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words that begin before it (n + 1).

    Words never cross rows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = np.ones(n + 1, bool)
    first[1:n] = ~inside[:-1]
    first[offsets] = True
    start = np.flatnonzero(inside & first[:n])
    last = np.ones(n + 1, bool)
    last[1:n] = ~inside[1:]  # last[i + 1]: the byte after i is no word byte
    last[offsets] = True
    end = np.flatnonzero(inside & last[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by polynomial prefix sums; equal bytes, equal hashes."""
    n = len(data)
    if not n or not len(start):
        return np.zeros(len(start), np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(np.arange(1, 257, dtype=np.uint64))[data] * powers(_BASE, n), out=total[1:])
        back = powers(inverse, n)
        return mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; made on the driver, for use in Python workers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(batch, text: int, size: int = 1 << 18):
    """Parts of an Arrow batch of about ``size`` bytes of text, so that arrays of many bytes a byte stay small: (first row, last row + 1, flat bytes, offsets)."""
    data, at = flat_bytes(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + size)) - 1), batch.num_rows)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
