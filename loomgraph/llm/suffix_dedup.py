"""Suffix-array dedup (3): removes every byte that a repeated string of LENGTH bytes covers.

Every window of LENGTH bytes has an anchor, the place of the least gram hash among its first WINDOW grams. An anchor
depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and all that is equal to
a window is found among the anchors with the same next KEY bytes. That is how suffixes are distributed:

1. Keys of all anchors are counted by a partial aggregate. A key that stands once has no repeated window. A key
   all of whose anchors have the same whole context (all bytes that their windows cover) has repeated windows only.
2. The other keys' contexts, each distinct one once, go to tasks by key. A task sorts the suffixes of its
   contexts by the difference-cover algorithm: it names the triples at places 1 and 2 modulo 3 by sorting them, recurses on
   the names until they are distinct, sorts the remaining suffixes by their first byte and the rank
   of the next, merges both, and compares each window with the adjacent one in full.
3. Windows found repeated go back to the documents, whose bytes are cut accordingly.

Two bitmaps of a fixed size tell the second scan which anchors may matter; what they pass wrongly is told apart by
exact joins. A key with more than MOST contexts isn't sorted in one task: its windows are counted by their 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import arrow_schema, cut, documents, flat_bytes, mixed, ship, span_hashes, text_of

LENGTH = 200
GRAM = 16
WINDOW = 128
#: Bytes from an anchor on that every window of it holds.
KEY = LENGTH - (WINDOW - 1)
MAP_BITS = 27
MAP_BLOCK = 1 << 20
SLICE = 1 << 18
CHUNK = 2 << 20
MOST = 12_000
#: Integer keys of the suffix sort stay below this.
WIDEST = 1 << 63


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place, first and last window start of each anchor (places in the flat bytes).

    The anchor of a window of LENGTH bytes is the place of the least hash among its first WINDOW grams, the last of
    equal ones: a function of the window's bytes. Every window start inside a row has one; windows of an anchor are adjacent.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    with np.errstate(over="ignore"):
        h = mixed(np.arange(1, 257, dtype=np.uint64))[data]
        w = 1
        while w < GRAM:
            h[: n - w] = h[: n - w] * np.uint64(0x9E3779B97F4A7C15 + 2 * w) + h[w:]
            w *= 2
        h = (h * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF00000000)
    h |= np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    w = 1
    while w < WINDOW:
        h[: n - w] = np.minimum(h[: n - w], h[w:])
        w *= 2
    place = 0xFFFFFFFF - (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    valid = np.flatnonzero(np.arange(n) + LENGTH <= offsets[1:][row])
    if not len(valid):
        return none, none, none, none
    at, own = place[valid], row[valid]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    last = np.concatenate([new[1:], [len(valid)]]) - 1
    return own[new], at[new], valid[new], valid[last]


def anchor_keys(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what all windows of an anchor share, and of all that they cover together with their places."""
    key = span_hashes(data, place, place + KEY)
    whole = span_hashes(data, first, last + LENGTH)
    return key.view(np.int64), mixed(whole ^ ((place - first) * 256 + (place - last)).astype(np.uint64)).view(np.int64)


def _slices(batch, text: int):
    """Parts of a batch of about SLICE bytes: (first row, last row + 1, flat bytes, offsets)."""
    data, at = flat_bytes(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE)) - 1)
        hi = min(hi, batch.num_rows)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _ranked(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, and their number."""
    order = np.argsort(key)
    own = key[order]
    step = np.ones(len(key), np.int32)
    step[1:] = own[1:] != own[:-1]
    del own
    np.cumsum(step, out=step)
    rank = np.empty(len(key), np.int32)
    rank[order] = step
    return rank, int(step[-1]) if len(step) else 0


def _paired(a: np.ndarray, b: np.ndarray, b_end: int) -> np.ndarray:
    """Orders pairs of integers; those of ``b`` are below ``b_end``."""
    out = a.astype(np.int64)
    out *= b_end
    out += b
    return out


def _doubled(s: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Orders the pairs of adjacent integers of ``s`` at ``at``."""
    return _paired(s[at], s[at + 1], end)


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The places of ``s`` (integers from 1) in the order of their suffixes.

    Places and ranks are 32-bit and what isn't needed any more goes at once: a task sorts contexts of megabytes.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    end = int(s.max()) + 1
    padded = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int32, copy=False)
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, np.int32), np.arange(2, n, 3, np.int32)])
    # The triples' names: pairs first where a key would be wider than 64 bits.
    name, high = _doubled(padded, sample, end), end * end
    if high * end >= WIDEST:
        name, high = _ranked(name)
    name, distinct = _ranked(_paired(name, padded[sample + 2], end))
    if distinct == len(sample):
        order = np.empty(len(sample), np.int32)
        order[name - 1] = np.arange(len(sample), dtype=np.int32)
    else:
        order = suffix_order(name)
    del name
    sorted_ = sample[order]
    del sample, order
    rank = np.zeros(n + 3, np.int32)
    rank[sorted_] = np.arange(1, len(sorted_) + 1, dtype=np.int32)
    sorted_ = sorted_[sorted_ < n]
    zero, ranks = np.arange(0, n, 3, np.int32), n + 3
    key = _paired(padded[zero], rank[zero + 1], ranks)
    order = np.argsort(key)
    zero, key = zero[order], key[order]
    del order
    # How many suffixes of either kind in the sample go before each remaining one.
    part = sorted_[sorted_ % 3 == 1]
    before = np.searchsorted(_paired(padded[part], rank[part + 1], ranks), key)
    del key
    part = sorted_[sorted_ % 3 == 2]
    pair, other, high = _doubled(padded, part, end), _doubled(padded, zero, end), end * end
    if high * ranks >= WIDEST:
        pair = _ranked(np.concatenate([pair, other]))[0]
        pair, other = pair[: len(part)], pair[len(part) :]
    before += np.searchsorted(_paired(pair, rank[part + 2], ranks), _paired(other, rank[zero + 2], ranks))
    del pair, other, part, padded, rank
    before += np.arange(len(zero))
    out = np.empty(n, np.int32)
    rest = np.ones(n, bool)
    rest[before] = False
    out[before] = zero
    out[rest] = sorted_
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each context: which of its windows of ``length`` bytes stands in another place of any context too."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    symbols = data.astype(np.int32) + 2
    symbols[start + sizes] = 1
    windows = np.maximum(sizes - length + 1, 0)
    edges = np.zeros(len(data) + 1, np.int8)
    some = windows > 0
    edges[start[some]] = 1
    edges[(start + windows)[some]] = -1
    valid = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    del edges
    order = suffix_order(symbols)
    del symbols
    order = order[valid[order]]
    found = np.zeros(len(data), bool)
    if len(order) > 1:
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        for lo in range(0, len(order) - 1, 20_000):
            a, b = order[lo : min(lo + 20_000, len(order) - 1)], order[lo + 1 : lo + 20_001]
            same = (view[a] == view[b]).all(axis=1)
            found[a[same]] = True
            found[b[same]] = True
    return [found[a : a + w] for a, w in zip(start.tolist(), windows.tolist(), strict=True)]


def _mapped(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bitmaps(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand that are repeated, and of those whose contexts differ. counts: key, mixed."""
    import pyarrow as pa

    def marked(batches):
        maps = np.zeros((2, (1 << MAP_BITS) // 8), np.uint8)
        for batch in batches:
            at = _mapped(batch.column(0).to_numpy())
            bit = (128 >> (at & 7)).astype(np.uint8)
            differ = batch.column(1).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(maps[0], at >> 3, bit)
            np.bitwise_or.at(maps[1], at[differ] >> 3, bit[differ])
        for k in (0, 1):
            for block in range((1 << MAP_BITS) // MAP_BLOCK):
                part = maps[k, block * MAP_BLOCK // 8 : (block + 1) * MAP_BLOCK // 8]
                if part.any():
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["map", "block", "bits"])

    def joined(table):
        bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"map": table["map"][:1], "block": table["block"][:1], "bits": pa.array([zlib.compress(bits.tobytes(), 1)])})

    schema = "map int, block int, bits binary"
    out = np.zeros((2, (1 << MAP_BITS) // 8), np.uint8)
    for r in counts.select("key", "mixed").mapInArrow(marked, schema).groupBy("map", "block").applyInArrow(joined, schema).collect():
        out[r["map"], r["block"] * MAP_BLOCK // 8 : (r["block"] + 1) * MAP_BLOCK // 8] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out[0], out[1]


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _sorted_contexts(batches):
    """A mapInArrow function over rows by key: (key, whole, n, context) -> (key, whole, windows): bits, first window first."""
    import pyarrow as pa

    held: dict[tuple[int, int], list] = {}
    size, last = 0, None

    def flush():
        keys = list(held)
        found = repeated_windows([held[k][1] for k in keys])
        packed = [np.packbits(np.ones(len(f), bool) if held[k][0] > 1 else f).tobytes() for k, f in zip(keys, found, strict=True)]
        return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(packed, pa.binary())], ["key", "whole", "windows"])

    for batch in batches:
        for key, whole, n, context in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != last and size > CHUNK:
                yield flush()
                held.clear()
                size = 0
            last = key
            own = held.get((key, whole))
            if own:
                own[0] += n
            else:
                held[key, whole] = [n, context]
                size += len(context)
    if held:
        yield flush()


def _exploded(batches):
    """(key, whole, n, context) -> a row for each window: (key, whole, window, a, b, n), a and b its hash."""
    import pyarrow as pa

    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            data, at = flat_bytes(part.column(3))
            windows = np.diff(at) - LENGTH + 1
            row = np.repeat(np.arange(len(windows)), windows)
            number = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            start = at[:-1][row] + number
            a = span_hashes(data, start, start + LENGTH)
            b = span_hashes(data[::-1].copy(), len(data) - start - LENGTH, len(data) - start)
            take = pa.array(row)
            yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column(2).take(take)], ["key", "whole", "window", "a", "b", "n"])


def _by_hashes(contexts: DataFrame) -> DataFrame:
    """The windows of contexts whose keys have too many of them, counted by hash: key, whole, window numbers."""
    lines = cut(contexts.mapInArrow(_exploded, "key long, whole long, window int, a long, b long, n long"), "windows")
    several = lines.groupBy("a", "b").agg(F.sum("n").alias("places")).where("places > 1").select("a", "b")
    return lines.join(several, ["a", "b"]).groupBy("key", "whole").agg(F.collect_set("window").alias("numbers"))


def repeated_spans(docs: DataFrame, most: int = MOST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, hash (of the text) and runs: a list of (first window start, windows, bits) for documents with repeated windows.

    bits null: all windows of the run are repeated.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("hash"), text_of(text).alias("text"))

    def keyed(batches):
        for batch in batches:
            for _, _, data, at in _slices(batch, 2):
                _, place, first, last = anchors(data, at)
                key, whole = anchor_keys(data, place, first, last)
                yield pa.record_batch([pa.array(key), pa.array(whole)], ["key", "whole"])

    counted = rows.mapInArrow(keyed, "key long, whole long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    counts = cut(counted.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed"), "low"), "keys")
    shared = spark.sparkContext.broadcast(_bitmaps(counts))
    schema = "doc_id long, hash long, key long, whole long, first int, windows int, n long, context binary"
    kinds = arrow_schema(schema)

    def found(batches):
        repeated, differ = shared.value
        sent: dict[tuple[int, int], list] = {}

        def flush():
            m = len(sent)
            columns = [[None] * m, [None] * m, [k[0] for k in sent], [k[1] for k in sent], [None] * m, [None] * m, [v[0] for v in sent.values()], [v[1] for v in sent.values()]]
            sent.clear()
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)

        size = 0
        for batch in batches:
            for lo, _, data, at in _slices(batch, 2):
                row, place, first, last = anchors(data, at)
                key, whole = anchor_keys(data, place, first, last)
                where = _mapped(key)
                use = np.flatnonzero(_is_set(repeated, where))
                own = pa.array(row[use] + lo)
                none = lambda f: pa.nulls(len(use), f.type)  # noqa: E731, B023
                start = (first - at[:-1][row])[use].astype(np.int32)
                yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(key[use]), pa.array(whole[use]), pa.array(start), pa.array((last - first + 1)[use].astype(np.int32)), none(kinds.field(6)), none(kinds.field(7))], schema=kinds)
                for k in use[_is_set(differ, where[use])].tolist():
                    pair = (int(key[k]), int(whole[k]))
                    if pair in sent:
                        sent[pair][0] += 1
                    else:
                        sent[pair] = [1, data[first[k] : last[k] + LENGTH].tobytes()]
                        size += len(sent[pair][1])
            if size > 16 << 20:
                yield flush()
                size = 0
        yield flush()

    lines = cut(rows.mapInArrow(found, schema), "anchors")
    places = lines.where("context is null").select("doc_id", "hash", "key", "whole", "first", "windows")
    contexts = lines.where("context is not null").select("key", "whole", "n", "context")
    many = cut(contexts.groupBy("key").count().where(F.col("count") > most).select("key"), "many")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = contexts.join(many, "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
    sorted_ = few.mapInArrow(_sorted_contexts, "key long, whole long, windows binary").select("key", "whole", F.col("windows").alias("bits"), F.lit(None).cast("array<int>").alias("numbers"))
    hashed = _by_hashes(contexts.join(many, "key", "left_semi")).select("key", "whole", F.lit(None).cast("binary").alias("bits"), "numbers")
    alike = counts.where("not mixed").select("key", F.col("low").alias("whole"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<int>").alias("numbers"))
    known = cut(sorted_.unionByName(hashed).unionByName(alike), "repeated-windows")
    back = places.join(known, ["key", "whole"]).select("doc_id", "hash", F.struct("first", "windows", "bits", "numbers").alias("run"))
    return back.groupBy("doc_id", "hash").agg(F.collect_set("run").alias("runs"))  # a set: repeated rows give equal runs


def _covered(runs, n: int) -> list[tuple[int, int]]:
    """The maximal byte spans that repeated windows cover."""
    start = np.zeros(n + 1, np.int64)
    for r in runs:
        a, w = r["first"], r["windows"]
        if r["numbers"] is not None:
            at = a + np.array(r["numbers"])
        elif r["bits"] is None:
            at = np.arange(a, a + w)
        else:
            at = a + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:w])
        start[at] = 1
    at = np.flatnonzero(start)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(at) > LENGTH]))
    end = at[np.concatenate([new[1:] - 1, [len(at) - 1]])] + LENGTH
    return list(zip(at[new].tolist(), end.tolist(), strict=True))


def remove_repeats(docs: DataFrame, most: int = MOST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed), kept (the bytes left).

    A byte goes when some 200-byte string that covers it starts in another place too, of the same text or another;
    overlapping places count, and all is judged on the input. No string crosses texts. Null text is empty text. Texts
    below 200 bytes stay whole. Rows with equal texts, and repeated rows, are places of their own, so their texts go
    whole if they have 200 bytes. A null id is carried as null. Other columns are ignored.
    """
    import pyarrow as pa

    runs = repeated_spans(docs, most, text, doc_id)
    none = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    both = rows.withColumn("_id", none).join(runs.select(none, "hash", "runs"), ["_id", "hash"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from_byte:int,to_byte:int>>, kept binary"
    kinds = arrow_schema(schema)

    def judged(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                data, at = flat_bytes(batch.column(1))
                raw = data.tobytes()
                out: list[list] = [[] for _ in kinds]
                for k, (one, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    body = raw[at[k] : at[k + 1]]
                    gone = _covered(own, len(body)) if own else []
                    ends = [0, *(x for span in gone for x in span), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                    for x, v in zip(out, (one, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"from_byte": a, "to_byte": b} for a, b in gone], kept), strict=True):
                        x.append(v)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return both.mapInArrow(judged, schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans", "kept")
