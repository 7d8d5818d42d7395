"""N-gram Jaccard join (4): MinHash banding, then verification on full n-gram sets.

1. Rows of equal sets (by a 128-bit digest) are one set class. MinHash bands, whose number and rows are chosen for the
   target recall at the least cost, give buckets; a shuffle on band hashes finds those of several set classes.
2. Two classes are candidates when they share a bucket. Buckets that hang together are compared as one unit, if they have
   no more than BLOCK members and MOST_WORDS words; larger ones bucket by bucket, and a larger bucket in pairs of blocks of that
   size. A pair is looked at in the first band that it shares, so in either way just the same pairs are, once each.
3. A unit's texts are compared in one task on their n-grams themselves, not on hashes. What leaves the task is each
   member's number of links and a spanning forest of them, so it grows with the members, not with their pairs.
4. The forests' components are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import cut, documents, free, lowered, mixed, powers, ship, slices, span_hashes, text_of, words

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.999


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, unlike: float = 0.3, price: float = 1000.0) -> tuple[int, int]:
    """(bands, rows): for each number of rows the fewest bands that find a pair of that similarity with probability ``recall``; of these the ones of least cost.

    The cost is one for each hash, and ``price`` times the probability that a pair of similarity ``unlike`` becomes a candidate.
    """
    best, least = (1, 1), float("inf")
    for rows in range(1, 13):
        bands = 1
        while 1 - (1 - similarity**rows) ** bands < recall:
            bands += 1
        cost = bands * rows + price * (1 - (1 - unlike**rows) ** bands)
        if cost < least:
            best, least = (bands, rows), cost
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's text: sorted distinct hashes of its n-grams of lower-cased words, and the n + 1 offsets of the rows.

    A text of fewer words is one n-gram of all of them; a text without words has none.
    """
    data = lowered(data)
    start, end, first = words(data, offsets)
    h = span_hashes(data, start, end)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    left = first[1:][row] - np.arange(len(h))  # words from here to the row's end
    with np.errstate(over="ignore"):
        p = powers(np.uint64(0xD6E8FEB86659FD93), ngram)
        total = np.zeros(len(h), np.uint64)
        for k in range(ngram):
            part = np.zeros(len(h), np.uint64)
            part[: len(h) - k] = h[k:]
            part[left <= k] = 0
            total += part * p[k]
        total = mixed(total)
    whole = (left >= ngram) | (np.arange(len(h)) == first[:-1][row])
    total, row = total[whole], row[whole]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    total, row = total[new], row[new]
    return total, np.searchsorted(row, np.arange(len(count) + 1))


def band_hashes(sets: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` 64-bit hashes for each set; an empty set's are 0."""
    n = len(at) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    starts = at[:-1][full]
    with np.errstate(over="ignore"):
        for b in range(bands):
            total = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                salt = mixed(np.array([1 + b * rows + r], np.uint64))
                total = mixed(total ^ np.minimum.reduceat(mixed_once(sets ^ salt), starts))
            out[full, b] = total
    return out


def mixed_once(h: np.ndarray) -> np.ndarray:
    """A cheaper bijection for hashes that are spread already."""
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


#: The most set classes, and words, that are compared at once; more are compared block by block.
BLOCK = 1024
MOST_WORDS = 1 << 20
SALTS = 16


def digests(sets: np.ndarray, at: np.ndarray) -> list[str]:
    """32 hexadecimal digits for each set, by a sum and an exclusive or of its members' hashes and its size."""
    n = len(at) - 1
    lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        with np.errstate(over="ignore"):
            lo[full] = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
            hi[full] = np.bitwise_xor.reduceat(mixed(sets + np.uint64(0x14057B7EF767814F)), at[:-1][full])
            hi ^= np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [f"{a:016x}{b:016x}" for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


#: Bytes of text whose words are hashed together; a process takes about 45 bytes for each.
TOGETHER = 1 << 19


def _sets_made(rest: list[str], at_text: int, bands: int, per_band: int, ngram: int):
    """A mapInArrow function: the columns ``rest`` and what set_table adds."""
    import pyarrow as pa

    def made(batches):
        for whole in batches:
            for lo, hi, data, offsets in slices(whole, at_text, TOGETHER):
                batch = whole.slice(lo, hi - lo)
                found, at = shingle_sets(data, offsets, ngram)
                hashes = band_hashes(found, at, bands, per_band).view(np.int64)
                last = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * bands), pa.array(hashes.reshape(-1)))
                own = [batch.column(batch.schema.get_field_index(c)) for c in rest]
                yield pa.record_batch([*own, pa.array(digests(found, at)), pa.array(np.diff(at)), pa.array(np.diff(words(data, offsets)[2])), last], [*rest, "digest", "n_grams", "n_words", "bands"])

    return made


def set_table(rows: DataFrame, bands: int, per_band: int, ngram: int) -> DataFrame:
    """rows: text and others that stay. Adds digest, n_grams, n_words and bands (array of long); the text goes."""
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest) + ", digest string, n_grams long, n_words long, bands array<long>"
    return rows.mapInArrow(_sets_made(rest, rows.columns.index("text"), bands, per_band, ngram), schema)


def salted(rows: DataFrame, key: str, own: str, few: DataFrame) -> DataFrame:
    """rows left join few on ``key``, where many rows may share one key: each goes to one of SALTS copies of it by the hash of ``own``. few: one row for each key."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges: v, hub (strings; members of a hub belong together). One row for each v: v, root (the least v that it is connected with).

    Each round every hub takes the least root of its members, every member the least of its hubs', and then the root of
    its root, so roots travel twice as far each round. Rows are one for each edge; nothing is collected but a count. Only roots that
    have moved are looked up, by salted keys, so the members of a large component are spread.
    """
    roots = cut(edges.groupBy("v").agg(F.min("v").alias("root")), f"{label}-roots")
    while True:
        hubs = edges.join(roots, "v").groupBy("hub").agg(F.min("root").alias("low"))
        near = edges.join(hubs, "hub").groupBy("v").agg(F.min("low").alias("low"))
        moved = cut(roots.join(near, "v").select("v", F.least("root", "low").alias("root"), (F.col("low") < F.col("root")).alias("moved")), f"{label}-moved")
        far = moved.select("root").distinct().join(moved.select(F.col("v").alias("root"), F.col("root").alias("far")).where("far < root"), "root")
        roots = cut(salted(moved, "root", "v", far).select("v", F.coalesce("far", "root").alias("root"), (F.col("moved") | F.col("far").isNotNull()).alias("moved")), f"{label}-roots")
        if roots.where("moved").isEmpty():
            return roots.select("v", "root")


def gram_sets(texts: list[bytes], ngram: int) -> list[np.ndarray]:
    """Each text's set of n-grams of lower-cased words, as numbers: equal n-grams of the texts have equal numbers. By the words themselves, without hashes."""
    known: dict[bytes, int] = {}
    split = [t.lower().split() for t in texts]
    ids = np.fromiter((known.setdefault(w, len(known) + 1) for own in split for w in own), np.int64, sum(map(len, split)))
    size = np.array([len(x) for x in split])
    row = np.repeat(np.arange(len(split)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(ids))
    gram = np.zeros(len(ids), np.int64)
    for k in range(ngram):
        part = np.zeros(len(ids), np.int64)
        part[: len(ids) - k] = ids[k:]
        part[left <= k] = 0
        # Named anew at each word, so that a number never outgrows 64 bits.
        _, gram = np.unique(gram * (len(known) + 1) + part, return_inverse=True)
    first = np.cumsum(size) - size
    whole = (left >= ngram) | (np.arange(len(ids)) == np.repeat(first, size))
    key = np.unique(row[whole] * (int(gram.max(initial=0)) + 1) + gram[whole])
    bound = np.searchsorted(key, np.arange(len(split) + 1) * (int(gram.max(initial=0)) + 1))
    return [key[a:b] % (int(gram.max(initial=0)) + 1) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def intersections(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with all others (rows: the first, columns: all)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    gram = np.concatenate(sets) if n else np.zeros(0, np.int64)
    _, gram, times = np.unique(gram, return_inverse=True, return_counts=True)
    shared = times[gram] > 1
    owner, gram = owner[shared], gram[shared]
    used, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((split, n), np.float32)
    width = max(256, 4_000_000 // max(1, n))
    for lo in range(0, len(used), width):
        a, b = np.searchsorted(gram, (lo, lo + width))
        x = np.zeros((n, min(width, len(used) - lo)), np.float32)
        x[owner[a:b], gram[a:b] - lo] = 1
        out += x[:split] @ x.T
    return out


def first_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of band hashes against rows of band hashes: the first band that a pair shares; the number of bands if none."""
    out = np.full((len(a), len(b)), a.shape[1], np.int16)
    for k in range(a.shape[1] - 1, -1, -1):
        out[a[:, k][:, None] == b[:, k][None, :]] = k
    return out


def _verified(similarity: float, ngram: int, pairs: bool):
    """A mapInArrow function over rows sorted by unit: (unit, band, side, v, copies, bands, text). band: of the bucket that the unit is (-1: several buckets)."""
    import pyarrow as pa

    def judged(rows: list[tuple]) -> list[tuple]:
        # side 0: the block itself; side 1: the other block of a pair of blocks, or none: then all pairs within the block
        rows = sorted({(r[2], r[3]): r for r in rows}.values(), key=lambda r: (r[2], r[3]))
        n, split = len(rows), sum(r[2] == 0 for r in rows)
        sets = gram_sets([r[6].encode() for r in rows], ngram)
        size = np.array([len(x) for x in sets], np.float64)
        bands = np.array([r[5] for r in rows], np.int64).reshape(n, -1)
        same = intersections(sets, split)
        near = same >= similarity * (size[:split, None] + size[None, :] - same) - 1e-6
        first = first_bands(bands[:split], bands)
        near &= first == rows[0][1] if rows[0][1] >= 0 else first < bands.shape[1]
        if n > split:
            near[:, :split] = False
        else:
            near = np.triu(near, 1)
        a, b = np.nonzero(near & (same > 0))
        copies = np.array([r[4] for r in rows], np.int64)
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        if pairs:
            return [(rows[i][3], rows[j][3], None, float(same[i, j] / (size[i] + size[j] - same[i, j]))) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        root = list(range(n))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
        return [(rows[i][3], rows[find(i)][3], int(links[i]), None) for i in range(n) if links[i]]

    def units(batches) -> Iterator[list[tuple]]:
        held, unit = [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):  # so that few texts stand twice in memory
                part = batch.slice(lo, 100)
                for row in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                    if row[0] != unit and held:
                        yield held
                        held = []
                    unit = row[0]
                    held.append(row)
        if held:
            yield held

    def run(batches):
        out = []
        names = ["v", "hub", "links", "similarity"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64()]
        flush = lambda: pa.record_batch([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], names)
        for rows in units(batches):
            out += judged(rows)
            if len(out) > 20_000:
                yield flush()
                out.clear()
        yield flush()

    return run


def unit_table(edges: DataFrame, classes: DataFrame, block: int, most_words: int) -> DataFrame:
    """v and its units: a list of (unit, band, side). edges: v, band, hub; classes: v, n_words. See the module's text for what a unit is."""
    groups = components(edges.select("v", "hub"), "candidates")
    sized = groups.join(classes.select("v", "n_words"), "v")
    total = sized.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words"))
    large = total.where((F.col("size") > block) | (F.col("words") > most_words)).select("root", F.lit(True).alias("large"))
    placed = cut(salted(groups, "root", "v", large), "placed")
    whole = placed.where("large is null").select("v", F.struct(F.col("root").alias("unit"), F.lit(-1).alias("band"), F.lit(0).alias("side")).alias("u"))
    members = edges.join(placed.where("large").select("v"), "v").join(classes.select("v", "n_words"), "v")
    # Buckets of the same members have the same pairs; the first of them stands for all.
    marks = F.xxhash64("v")
    buckets = members.groupBy("band", "hub").agg(F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words"), F.bit_xor(marks).alias("a"), F.sum(F.shiftright(F.xxhash64("v", F.lit(1)), 24)).alias("b"))
    first = buckets.groupBy("size", "words", "a", "b").agg(F.min(F.struct("band", "hub")).alias("s")).select("s.hub", "size", "words")
    blocks = first.withColumn("blocks", F.ceil(F.greatest(F.col("size") / block, F.col("words") / most_words)).cast("int")).select("hub", "blocks")
    # A block meets itself and, as side 0, each later block.
    dealt = salted(members.select("v", "band", "hub"), "hub", "v", blocks).where("blocks is not null").withColumn("mine", F.pmod(F.xxhash64("v", F.lit(2)), F.col("blocks")).cast("int"))
    others = F.expr("transform(sequence(0, blocks - 1), x -> struct(concat_ws(':', hub, least(x, mine), greatest(x, mine)) as unit, band, cast(x < mine as int) as side))")
    return whole.unionByName(dealt.select("v", F.explode(others).alias("u"))).groupBy("v").agg(F.collect_list("u").alias("units"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, ngram: int = NGRAM, block: int = BLOCK, most_words: int = MOST_WORDS, text: str = "text", doc_id: str = "doc_id", pairs: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, n_copies, text_hash (xxhash64) and root.

    Two rows are linked when they share a MinHash band and the Jaccard similarity of their sets of n-grams (lower-cased words
    between ASCII white space) is ``similarity`` or more; a pair of just that similarity shares one with probability ``recall``.
    A class is a connected component of links; its id is its least doc_id, and ``root``, a digest, is its own where ids are
    null or repeated. n_links counts the other rows that the row is linked with, copies included; n_copies the rows of
    the same set.

    pairs: return v, hub (digests of linked set classes) and similarity instead; membership is in set_table.
    Null text counts as empty. Texts without words are copies of each other and linked with nothing else; a shorter
    text than an n-gram is one n-gram of all its words. class_id is null where a class has no id. Repeated rows are copies. Texts
    are read whole; one is a unit's block of its own if it has more than ``most_words`` words. Other columns are ignored. An
    empty table gives none.
    """
    bands, per_band = choose_bands(similarity, recall)
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = cut(set_table(rows, bands, per_band, ngram), "sets")
    # The text to compare is named by id and hash; only copies share both.
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = marked.groupBy(F.col("digest").alias("v")).agg(F.min(name).alias("named"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("min_id"), F.first("bands").alias("bands"), F.max("n_grams").alias("n_grams"), F.max("n_words").alias("n_words"))
    classes = cut(classes, "set-classes")
    members = classes.where("n_grams > 0").select("v", F.posexplode("bands").alias("band", "hash")).select("v", "band", F.concat_ws(":", "band", "hash").alias("hub"))
    full = members.groupBy("hub").count().where("count > 1").select("hub")
    edges = cut(members.join(full, "hub"), "buckets")
    units = cut(unit_table(edges, classes, block, most_words), "units")
    wanted = classes.join(units, "v").select("v", F.col("named.none").alias("none"), F.coalesce("named.doc_id", F.lit(0)).alias("id"), F.col("named.text_hash").alias("text_hash"), "copies", "bands", "units")
    texts = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash", "text")
    fetched = texts.join(wanted, ["none", "id", "text_hash"]).dropDuplicates(["v"]).select("v", "copies", "bands", "text", F.explode("units").alias("u"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = fetched.select("u.unit", "u.band", "u.side", "v", "copies", "bands", "text").repartition(tasks, "unit").sortWithinPartitions("unit")
    judged = dealt.mapInArrow(_verified(similarity, ngram, pairs), "v string, hub string, links long, similarity double")
    if pairs:
        return judged.select("v", "hub", "similarity")
    judged = cut(judged, "links")
    forest = judged.select("v", "hub").unionByName(judged.select(F.col("hub").alias("v"), "hub")).distinct()
    tops = components(cut(forest, "forest"), "classes")
    links = judged.groupBy("v").agg(F.sum("links").alias("links"))
    named = classes.select("v", "min_id", "copies").join(tops, "v", "left").join(links, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = cut(named, "named")
    ids = named.groupBy("root").agg(F.min("min_id").alias("class_id"))
    found = salted(named, "root", "v", ids).select(F.col("v").alias("digest"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return marked.select("doc_id", "digest", "text_hash").join(found, "digest").select("doc_id", "class_id", "n_links", "n_copies", "text_hash", "root")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **parameters) -> DataFrame:
    """A row of each class, with all columns, whatever their names: the one of the least id, a null id after all others; of several the text of the least hash; of repeated rows one."""
    none, own, digest = free(docs.columns, "none", "id", "hash")
    found = near_duplicates(docs, text=text, doc_id=doc_id, **parameters)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(own), F.col("text_hash").alias(digest))).alias("s")).select("s.*")
    marked = docs.withColumns({none: F.col(doc_id).cast("long").isNull(), own: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), digest: F.xxhash64(text_of(text))})
    return marked.join(stay, [none, own, digest], "left_semi").dropDuplicates([none, own, digest]).select(*docs.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
