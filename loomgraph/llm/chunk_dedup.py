"""Substring dedup (9): content-defined chunks, deduplicated by digest.

A gear hash rolls over the bytes; its upper bits are a function of the last 32 bytes alone, so boundaries move with
their content and an insertion changes only the chunks that it touches. Chunks lie between MIN and MAX bytes. Each
document sends one row for each distinct digest. Digests that occur more than once are found by a partial
aggregate; their places go back to the documents by an equi-join that Spark can split where a digest is hot. Of a
digest's places the first of the first document stays, all others go, however short their run.

Rows that share id and text are copies: one of them is judged with the others' places in mind, the rest go whole. So a
list of chunks is made once for each different document, not for each copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import arrow_schema, cut, documents, mixed, ship, slices, text_of

MIN, MAX, BITS = 32, 256, 5
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - k]] << k over the 32 last bytes of the row; by doubling the window five times."""
    n = len(data)
    h = _GEAR[data]
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(5):
        w = 1 << j
        if n > w:
            h[w:] += np.where(place[w:] >= w, h[:-w], 0).astype(np.uint32) << np.uint32(w)
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Of each row: the ends of its chunks, counted from the row's start; the last is its length. None for an empty row."""
    h = gear(data, offsets)
    marks = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    at = np.searchsorted(marks, offsets, side="right")
    out = []
    for k in range(len(offsets) - 1):
        lo, n = int(offsets[k]), int(offsets[k + 1] - offsets[k])
        ends, last = [], 0
        for c in (marks[at[k] : at[k + 1]] - lo).tolist():
            if c - last < MIN:
                continue
            while c - last > MAX:
                last += MAX
                ends.append(last)
            if c - last >= MIN:
                ends.append(c)
                last = c
        while n - last > MAX:
            last += MAX
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document (digest null; n its bytes, chunks their number) and each of its distinct digests (n: how often; spans: int32 pairs)."""
    import pyarrow as pa
    import xxhash

    ship(docs.sparkSession)
    schema = "doc_id long, hash long, digest binary, n long, chunks long, spans binary"
    kinds = arrow_schema(schema)

    def cut_up(batches):
        for whole in batches:
            for lo, hi, data, at in slices(whole, 1, 1 << 21):
                batch, raw = whole.slice(lo, hi - lo), data.tobytes()
                out: list[list] = [[] for _ in kinds]
                for k, ends in enumerate(boundaries(data, at)):
                    one, own = batch.column(0)[k].as_py(), raw[at[k] : at[k + 1]]
                    h = xxhash.xxh3_64_intdigest(own) - (1 << 63)
                    found: dict[bytes, list[int]] = {}
                    last = 0
                    for e in ends:
                        found.setdefault(hashlib.blake2b(own[last:e], digest_size=16).digest(), []).extend((last, e))
                        last = e
                    m = len(found)
                    out[0] += [one] * (m + 1)
                    out[1] += [h] * (m + 1)
                    out[2] += [*found, None]
                    out[3] += [*(len(s) // 2 for s in found.values()), len(own)]
                    out[4] += [0] * m + [len(ends)]
                    out[5] += [*(np.array(s, np.int32).tobytes() for s in found.values()), None]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(cut_up, schema)


def _spans(rows: list[tuple[bytes, bool]]) -> tuple[list[tuple[int, int]], int]:
    """rows: (spans, whether the first of them stays). The removed runs, and the bytes of all repeated chunks."""
    places = sorted((a, b, k == 0 and first) for spans, first in rows for k, (a, b) in enumerate(np.frombuffer(spans, np.int32).reshape(-1, 2).tolist()))
    removed: list[tuple[int, int]] = []
    for a, b, stays in places:
        if not stays:
            if removed and removed[-1][1] == a:
                removed[-1] = (removed[-1][0], b)
            else:
                removed.append((a, b))
    return removed, sum(b - a for a, b, _ in places)


def chunk_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_chunks, n_repeated (bytes in chunks that occur elsewhere), n_removed, n_spans, spans (removed, in bytes).

    The first place of a chunk in the first document stays. Documents are in order of id, a null id after all others,
    and then of their texts' hashes, so rows of one id (or of none) with different texts are documents of their own. Of rows that
    share both, one is first, and all bytes of the others go. Null text is empty text: no bytes, no chunks. Texts are
    cut up whole, however long. Other columns are ignored. An empty table gives none.
    """
    import pyarrow as pa

    found = cut(chunks(docs, text, doc_id), "chunks")
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    own = F.struct(last.alias("id"), F.col("doc_id").isNull().alias("none"), "hash")
    repeated = found.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("places"), F.min(own).alias("first")).where("places > 1")
    back = found.where("digest is not null").select(own.alias("own"), "digest", "spans").join(repeated, "digest").select("own", F.struct("digest", "spans", (F.col("own") == F.col("first")).alias("first")).alias("chunk"))
    lists = back.groupBy("own").agg(F.collect_set("chunk").alias("chunks"))  # a set: copies give equal chunks
    each = found.where("digest is null").groupBy(own.alias("own")).agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n_bytes"), F.first("chunks").alias("n_chunks"), F.count(F.lit(1)).alias("copies"))
    rows = each.join(lists, "own", "left")
    schema = "doc_id long, copies long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, spans array<struct<from_byte:int,to_byte:int>>"
    kinds = arrow_schema(schema)

    def judged(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                out: list[list] = [[] for _ in kinds]
                for one, copies, n, m, found in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    removed, all_ = _spans([(r["spans"], r["first"]) for r in found or ()])
                    for x, v in zip(out, (one, copies, n, m, all_, sum(b - a for a, b in removed), len(removed), [{"from_byte": a, "to_byte": b} for a, b in removed]), strict=True):
                        x.append(v)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    firsts = cut(rows.select("doc_id", "copies", "n_bytes", "n_chunks", "chunks").mapInArrow(judged, schema), "judged-chunks")
    whole = F.when(F.col("n_bytes") > 0, F.array(F.struct(F.lit(0).alias("from_byte"), F.col("n_bytes").cast("int").alias("to_byte")))).otherwise(F.col("spans"))
    others = firsts.where("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), "copies"))).select("doc_id", "n_bytes", "n_chunks", "n_repeated", F.col("n_bytes").alias("n_removed"), F.size(whole).cast("long").alias("n_spans"), whole.alias("spans"))
    return firsts.drop("copies").unionByName(others)


def without_repeats(texts: list[str], spans: list[list[tuple[int, int]]]) -> list[str]:
    """The texts without their removed bytes; a character that a cut splits goes too."""
    out = []
    for t, own in zip(texts, spans, strict=True):
        data, last, kept = t.encode(), 0, b""
        for a, b in own:
            kept += data[last:a]
            last = b
        out.append((kept + data[last:]).decode(errors="ignore"))
    return out


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(documents(spark, sf_dir)).drop("spans")
