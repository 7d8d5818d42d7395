"""Exact dedup (10): a minimal perfect hash over the distinct digests of a history.

1. Texts are compared by their SHA-256; null counts as empty. The history is reduced to its distinct
   digests by a partial aggregate, so a group of any size leaves one row for each map task.
2. The digests are dealt to shards of a bounded number of keys. Each shard gets a minimal perfect hash
   (hash and displace): keys fall into small buckets, and each bucket has a displacement under which
   all its keys meet free slots; n keys fill the slots 0 .. n - 1.
3. A slot holds the full digest and the locator of the winner (the largest id) and the group's size.
4. Documents look themselves up: shard and bucket give the displacement, that gives the slot, and the
   slot's full digest is compared byte by byte. A key that the history lacks reaches some slot too; the
   comparison tells it apart. Such nonmembers are grouped among themselves.

Both lookups are equi-joins on integers, which Spark can split where a digest is hot. Nothing is collected
but one count.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.llm.common import cut, documents, free, ship, text_of

SHARD_KEYS = 20_000
BUCKETS = SHARD_KEYS // 3


def digest_of(text: str = "text") -> Column:
    return F.sha2(text_of(text).cast("binary"), 256)


def _piece(digest: Column, at: int) -> Column:
    """44 bits of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 1 + at, 11), 16, 10).cast("long")


def _pieces(hexes: list[str], salt: int = 0) -> np.ndarray:
    hexes = [hashlib.sha256(f"{x}:{salt}".encode()).hexdigest() for x in hexes] if salt else hexes
    return np.array([[int(x[a : a + 11], 16) for a in (11, 22, 33)] for x in hexes], np.int64).reshape(-1, 3)


def _salted(digest: Column, salt: Column) -> Column:
    return F.when(salt > 0, F.sha2(F.concat(digest, F.lit(":"), salt.cast("string")).cast("binary"), 256)).otherwise(digest)


def displacements(hexes: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n different keys: the buckets that have keys, their two displacements and salts, and every key's slot.

    A key is three integers a, b, c; b and c are those of the salted key. slot = (b % n + d0 * (c % n) + d1) % n,
    bucket = a % buckets. The largest buckets come first; for each, d1 runs over all slots before d0 grows, and d0 before the
    salt. A bucket of one key just takes the next free slot.
    """
    n = len(hexes)
    pieces = _pieces(hexes)
    bucket, b, c = pieces[:, 0] % buckets, pieces[:, 1] % n, pieces[:, 2] % n
    order = np.argsort(bucket, kind="stable")
    bound = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(bound)
    d0, d1, salt, slot = (np.zeros(k, np.int64) for k in (buckets, buckets, buckets, n))
    free_ = np.ones(n, bool)
    shift = np.arange(min(n, 256), dtype=np.int64)

    def fitted(b: np.ndarray, c: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        for e in range(n + 1):
            base = (b + e * c) % n
            if len(set(base.tolist())) < len(base):
                continue
            for lo in range(0, n, len(shift)):
                tried = (base[:, None] + lo + shift) % n
                fits = free_[tried].all(axis=0)
                if fits.any():
                    at = int(fits.argmax())
                    return e, (lo + at) % n, tried[:, at]
        return None

    for k in np.argsort(-size, kind="stable"):
        if size[k] < 2:
            break
        keys = order[bound[k] : bound[k + 1]]
        found = fitted(b[keys], c[keys])
        while found is None:
            salt[k] += 1
            again = _pieces([hexes[i] for i in keys.tolist()], int(salt[k]))
            found = fitted(again[:, 1] % n, again[:, 2] % n)
        d0[k], d1[k], slot[keys] = found
        free_[slot[keys]] = False
    single = np.flatnonzero(size == 1)
    keys = order[bound[single]]
    slot[keys] = np.flatnonzero(free_)
    d1[single] = (slot[keys] - b[keys]) % n
    used = np.flatnonzero(size)
    return used, d0[used], d1[used], salt[used], slot


def _build(table, buckets: int):
    """One shard: its seeds (slot null) and its slots (bucket null), as rows of one table."""
    import pyarrow as pa

    table = table.sort_by("digest")
    hexes = table["digest"].to_pylist()
    used, d0, d1, salt, slot = displacements(hexes, buckets)
    n, m = len(hexes), len(used)
    shard = table["shard"][0].as_py()
    none = lambda kind, k: pa.nulls(k, kind)
    i64 = pa.int64()
    seeds = [pa.array([shard] * m, i64), pa.array(used, i64), pa.array(d0, i64), pa.array(d1, i64), pa.array(salt, i64), pa.array([n] * m, i64), none(i64, m), none(pa.string(), m), none(i64, m), none(i64, m)]
    slots = [pa.array([shard] * n, i64), none(i64, n), none(i64, n), none(i64, n), none(i64, n), none(i64, n), pa.array(slot, i64), table["digest"].combine_chunks().cast(pa.string()), table["keep_id"].combine_chunks(), table["group_size"].combine_chunks()]
    names = ["shard", "bucket", "d0", "d1", "salt", "n_slots", "slot", "digest", "keep_id", "group_size"]
    return pa.concat_tables([pa.table(seeds, names), pa.table(slots, names)])


def build_index(history: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_keys: int = SHARD_KEYS, buckets: int = BUCKETS) -> dict:
    """The index over ``history``: seeds and slots as DataFrames (written tables), and the numbers of shards and of buckets in each."""
    ship(history.sparkSession)
    distinct = cut(
        history.select(digest_of(text).alias("digest"), F.col(doc_id).cast("long").alias("_id")).groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "digests",
    )
    shards = max(1, -(-distinct.count() // shard_keys))
    built = cut(
        distinct.withColumn("shard", F.pmod(_piece(F.col("digest"), 0), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lambda table: _build(table, buckets), "shard long, bucket long, d0 long, d1 long, salt long, n_slots long, slot long, digest string, keep_id long, group_size long"),
        "perfect-hash",
    )
    return {
        "shards": shards,
        "buckets": buckets,
        "seeds": built.where("slot is null").select("shard", "bucket", "d0", "d1", "salt", "n_slots"),
        "slots": built.where("slot is not null").select("shard", "slot", "digest", "keep_id", "group_size"),
    }


def look_up(rows: DataFrame, index: dict) -> DataFrame:
    """rows: text_sha256 and others, none of which begins with an underscore. Adds keep_id and group_size of the history's group; null where the history lacks the digest."""
    d, n = F.col("text_sha256"), F.col("_n")
    seeds = index["seeds"].select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"), F.col("d0").alias("_d0"), F.col("d1").alias("_d1"), F.col("salt").alias("_salt"), F.col("n_slots").alias("_n"))
    slots = index["slots"].select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("digest").alias("_digest"), "keep_id", "group_size")
    own = _salted(d, F.col("_salt"))
    return (
        rows.withColumn("_shard", F.pmod(_piece(d, 0), F.lit(index["shards"])))
        .withColumn("_bucket", F.pmod(_piece(d, 11), F.lit(index["buckets"])))
        .join(seeds, ["_shard", "_bucket"], "left")
        .withColumn("_slot", (F.pmod(_piece(own, 22), n) + F.col("_d0") * F.pmod(_piece(own, 33), n) + F.col("_d1")) % n)
        .join(slots, ["_shard", "_slot"], "left")
        .withColumn("keep_id", F.when(F.col("_digest") == d, F.col("keep_id")))
        .withColumn("group_size", F.when(F.col("_digest") == d, F.col("group_size")))
        .drop("_shard", "_bucket", "_slot", "_d0", "_d1", "_salt", "_n", "_digest")
    )


def exact_groups(docs: DataFrame, history: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    history: rows that came before; their winners stand, and members of ``docs`` are repeats of them. None: the
    documents are their own history. Nonmembers group among themselves.

    Null text is empty text. Of equal texts the largest id wins; a null id never wins over another, and a
    group of null ids alone has keep_id null and keeps its rows. Rows that repeat the winner's id and text
    are kept alike (they are the winner); ``without_repeats`` makes them one. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text).alias("text_sha256"))
    found = look_up(rows, build_index(docs if history is None else history, text, doc_id))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    if history is None:
        return found.select("doc_id", "keep_id", "group_size", stays, "text_sha256")
    found = cut(found, "looked-up")
    fresh = found.where("group_size is null").select("doc_id", "text_sha256")
    groups = fresh.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    members = found.where("group_size is not null").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256")
    return members.unionByName(fresh.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", stays, "text_sha256"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of winners that share id and text one."""
    sha, keep, rows = free(docs.columns, "sha", "keep", "rows")
    winners = exact_groups(docs, None, text, doc_id).where("kept").groupBy(F.col("text_sha256").alias(sha)).agg(F.first("keep_id").alias(keep), F.count(F.lit(1)).alias(rows))
    own = docs.withColumn(sha, digest_of(text))
    once = cut(own.join(winners, sha).where(F.col(doc_id).cast("long").eqNullSafe(F.col(keep))).select(*docs.columns, sha, rows), "winners")
    several = once.where(F.col(rows) > 1).dropDuplicates([sha])
    return once.where(F.col(rows) == 1).unionByName(several).select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
