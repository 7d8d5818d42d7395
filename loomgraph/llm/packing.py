"""Best-fit packing (7): documents into sequences of several permitted lengths.

Documents are cut to pieces of at most the greatest length. Pieces are dealt to shards of about SHARD pieces by a
hash, so no shard grows with the input. A shard is packed in one task, pieces in descending order: a piece goes to the open
bin that it fits best; if none has room, a bin of the least-cost length is opened. The cost of opening a length is the room
that the piece would leave and that the pieces still to come, by their number at each size, can't be expected to
fill, plus OVERHEAD for the sequence itself. At last each bin takes the least permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import arrow_schema, cut, documents, ship, text_of
from loomgraph.llm.mixing import WORD, n_words

LENGTHS = (256, 512, 1024, 2048)
#: Words that a sequence costs besides its length.
OVERHEAD = 8
SHARD = 20_000


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Of pieces in descending order of size (each from 1 to the greatest length): each one's bin, and each bin's length."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    left = np.bincount(np.array(sizes, np.int64), minlength=most + 1)  # pieces still to come, by size
    to_come = int((left * np.arange(most + 1)).sum())
    bin_of, room_of, used = [], [], []
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins with room, in order
    for s in sizes:
        left[s] -= 1
        to_come -= s
        k = bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            b, room = len(used), _opened(s, lengths, left, to_come, overhead)
            used.append(0)
            room_of.append(room)
        used[b] += s
        bin_of.append(b)
        if room > s:
            insort(rooms, (room - s, b))
    return bin_of, [next(x for x in lengths if x >= u) for u in used]


def _opened(size: int, lengths: tuple[int, ...], left: np.ndarray, to_come: int, overhead: int) -> int:
    """The length with the least cost for each word that it is expected to hold."""
    best, cost = 0, float("inf")
    for x in lengths:
        room = x - size
        if room < 0:
            continue
        # Pieces come in descending order: what still fits is the smaller ones, if there are enough of them.
        fits = int((left[: room + 1] * np.arange(min(room, len(left) - 1) + 1)).sum()) if room else 0
        held = size + min(room, fits)
        each = (next(y for y in lengths if y >= held) + overhead) / held
        if each < cost - 1e-12:
            best, cost = x, each
    return best


def pieces(sized: DataFrame, most: int) -> DataFrame:
    """sized: doc_id, text_hash, size. A row for each piece: doc_id, text_hash, from_word, n (words), piece (a number of its own); documents without words have none."""
    cut_up = sized.where("size > 0").withColumn("from_word", F.explode(F.expr(f"sequence(0L, size - 1, {most}L)")))
    return cut_up.select("doc_id", "text_hash", "from_word", F.least(F.lit(most).cast("long"), F.col("size") - F.col("from_word")).alias("n"), F.monotonically_increasing_id().alias("piece"))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD, overhead: int = OVERHEAD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each sequence: seq_id, length, used, and the lists doc_ids, text_hashes, from_words, n_words, in order of place.

    Every word of every row is in one sequence. doc_id and text_hash (xxhash64) together say whose words they are: rows
    that share both have the same words; ``sequences`` writes them out. Null and empty texts have no words and are in none. A null
    id is carried as null. Repeated rows are packed as often as they stand, dealt to shards by a number of each piece, so
    that no shard holds all of them. Ties are in order of id, hash and place. An empty table gives none. Other columns are ignored.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), n_words(text).alias("size"))
    rows = cut(pieces(sized, max(lengths)), "pieces")  # written, so that the pieces' numbers stay
    shards = max(1, -(-rows.count() // shard))
    schema = "seq_id string, length long, used long, doc_ids array<long>, text_hashes array<long>, from_words array<long>, n_words array<long>"
    kinds = arrow_schema(schema)

    def packed(table):
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("from_word", "ascending")])
        ids, hashes, start, n = (table[c].to_pylist() for c in ("doc_id", "text_hash", "from_word", "n"))
        own = table["shard"][0].as_py()
        bin_of, length = pack(n, lengths, overhead)
        held: list[list[int]] = [[] for _ in length]
        for k, b in enumerate(bin_of):
            held[b].append(k)
        lists = lambda x: [[x[k] for k in ks] for ks in held]
        made = ([f"{own}-{b}" for b in range(len(length))], length, [sum(n[k] for k in ks) for ks in held], lists(ids), lists(hashes), lists(start), lists(n))
        return pa.table([pa.array(x, f.type) for x, f in zip(made, kinds, strict=True)], schema=kinds)

    return rows.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))).drop("piece").groupBy("shard").applyInArrow(packed, schema)


def sequences(packed: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """seq_id, length, used and ``text``: the words of each sequence, joined by single spaces, in order of place.

    packed: what ``pack_documents`` made of ``docs``. Each different text of an id is read once and cut to its pieces.
    """
    place = packed.select("seq_id", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "from_words", "n_words")).alias("place", "p"))
    wanted = place.select("seq_id", "place", F.col("p.doc_ids").alias("id"), F.col("p.text_hashes").alias("hash"), F.col("p.from_words").alias("from_word"), F.col("p.n_words").alias("n"))
    texts = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.xxhash64(text_of(text)).alias("own_hash"), text_of(text).alias("words")).dropDuplicates(["own_id", "own_hash"])
    both = wanted.join(texts, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")))
    piece = F.array_join(F.slice(F.regexp_extract_all("words", F.lit(WORD), F.lit(0)), (F.col("from_word") + 1).cast("int"), F.col("n").cast("int")), " ")
    lists = both.select("seq_id", F.struct("place", piece.alias("piece")).alias("part")).groupBy("seq_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return packed.select("seq_id", "length", "used").join(lists, "seq_id").select("seq_id", "length", "used", F.array_join(F.transform("parts", lambda x: x["piece"]), " ").alias("text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
