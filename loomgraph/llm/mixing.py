"""Mixing sources to target weights (6): Sainte-Lague apportionment of equal-token blocks. DataFrame operations only.

1. Sizes: words of each document; sources in order of code point, null last, weigh 5, 2, 1, 5, 2, 1 ...
   Their targets share all words by weight; a target stops at 3 times its source's size and the excess goes
   to the others by weight until none is above (water filling, solved by one sorted running sum).
2. All words are blocks of BLOCK words. The blocks are seats, allocated to the sources by the highest
   quotients target / (2k + 1). Below a safe divisor all but n of the seats are known at once; only as
   many quotients as can still win are ranked (at most 4n rows for n sources), so the number of blocks may be
   anything.
3. Each source's quota is apportioned to its shards in the same way, by their sizes, in two steps: first to groups of
   shards, then within each group. A shard holds about SHARD_DOCS documents and a group GROUP_SHARDS shards, whatever
   the source's size, so a source that holds a third of all rows is many groups. Documents are dealt to shards by id and text, so
   only rows that share both must share a shard. Rounding may leave a shard with more blocks than three times its
   words; what is beyond, a block at most for each shard, is not taken.
4. In a shard, the documents stand in a seeded order; its words are a line that is laid up to three times. The
   quota's blocks are taken from the start: whole rounds first, then a last part that ends inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomgraph.llm.common import cut, documents, free, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 16
SHARD_DOCS = 4096
GROUP_SHARDS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds rank (from 0), weight and target. The windows run over one row for each source."""
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = everything.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")).cast("double") / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .drop("cap", "ratio", "capped", "level")
    )


def sainte_lague(votes: DataFrame, group: list[str], order: str) -> DataFrame:
    """votes: columns of ``group``, ``order`` (ranks ties within the group), votes double, seats long (the group's). Adds quota long.

    Seats of a group go to its rows by the highest quotients votes / (2k + 1); a row without votes gets none.
    """
    own = Window.partitionBy(*[F.col(c) for c in group])
    n, total, seats = F.count(F.lit(1)).over(own), F.sum("votes").over(own), F.col("seats")
    # At the divisor total / (2 seats - n) no more than the seats are given, at total / (2 seats + n) no fewer.
    sure = F.when((2 * seats > F.col("n")) & (F.col("total") > 0), F.floor(F.col("votes") * (2 * seats - F.col("n")) / (2 * F.col("total")) + 0.5)).otherwise(F.lit(0))
    most = F.when(F.col("total") > 0, F.floor(F.col("votes") * (2 * seats + F.col("n")) / (2 * F.col("total")) + 0.5)).otherwise(F.lit(0))
    counted = votes.withColumn("n", n).withColumn("total", total).withColumn("sure", sure.cast("long")).withColumn("most", most.cast("long"))
    counted = counted.withColumn("left", seats - F.sum("sure").over(own))
    quotient = F.col("votes") / (2 * (F.col("sure") + F.col("j")) + 1)
    rivals = (
        counted.where("votes > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - F.col("sure") + 1))).withColumn("quotient", quotient)
        .withColumn("place", F.row_number().over(own.orderBy(F.col("quotient").desc(), F.col(order), F.col("j"))))
        .where("place <= left").groupBy(*group, order).agg(F.count(F.lit(1)).alias("more"))
    )
    keys = [*group, order]
    return counted.join(rivals, keys, "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0))).drop("n", "total", "sure", "most", "left", "more")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, and ``at``, the row's place in its shard's line.

    Null text has no words and is taken 0 times; a null source is a source of its own, the last. The seeded order is by id
    (null: the word null) and text. Rows with the same id and text are alike: which of them is cut is not
    defined, and does not matter to the rows returned. No words at all: every target and taken is 0. An empty table gives
    none. Other columns are ignored.
    """
    sized = cut(_sized(docs, doc_id, text, source), "sizes")
    return _mixed(sized, weights, most, block, seed, shard_docs).select("doc_id", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), F.md5(text_of(text).cast("binary")).alias("hash"))


def _mixed(sized: DataFrame, weights: tuple[int, ...], most: int, block: int, seed: str, shard_docs: int) -> DataFrame:
    """sized: doc_id, source, size, hash (of the text)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sources.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs)), weights, most)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    # The blocks in all: as many as the words fill.
    ballots = targets.withColumn("votes", F.col("target")).withColumn("all_", F.lit(0)).withColumn("seats", F.floor(total / block).cast("long"))
    quotas = cut(sainte_lague(ballots, ["all_"], "rank").select(F.col("source").alias("_source"), "source_size", "target", "rank", "quota", "shards"), "quotas")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "hash"))
    placed = (
        sized.join(quotas, F.col("source").eqNullSafe(quotas["_source"])).drop("_source")
        .withColumn("drawn", drawn).withColumn("shard", F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long") % F.col("shards"))
        .withColumn("part", F.col("shard") % F.ceil(F.col("shards") / GROUP_SHARDS))
    )
    shards = placed.groupBy("rank", "part", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    parts = shards.groupBy("rank", "part").agg(F.sum("shard_size").cast("double").alias("votes"), F.first("quota").alias("seats"))
    given = sainte_lague(parts, ["rank"], "part").select("rank", "part", F.col("quota").alias("seats"))
    votes = shards.drop("quota").join(given, ["rank", "part"]).withColumn("votes", F.col("shard_size").cast("double"))
    taken = sainte_lague(votes, ["rank", "part"], "shard").select("rank", "shard", F.col("shard_size"), F.least(F.col("quota") * block, F.col("shard_size") * most).alias("words"))
    line = Window.partitionBy("rank", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("words") - rounds * F.col("shard_size")
    return (
        placed.join(taken, ["rank", "shard"]).withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0)))
        .withColumn("taken", rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at"))))
    )


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: a document stands as often as it is taken whole; a rest is one more row.

    The rest's text is its first words, joined by one space each. What is not taken is not there. Of rows that share id, source
    and text each gets one of their shares.
    """
    p = {"weights": WEIGHTS, "most": MOST, "block": BLOCK, "seed": SEED, "shard_docs": SHARD_DOCS} | parameters
    own_id, own_source, size, own_hash, taken, number, take = free(docs.columns, "id", "source", "size", "hash", "taken", "n", "take")
    keys = [own_id, own_source, own_hash]
    # Rows that share id, source and text are told apart by their number, on both sides.
    alike = Window.partitionBy(*keys)
    shares = _mixed(cut(_sized(docs, doc_id, text, source), "sizes"), **p).select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("hash").alias(own_hash), F.col("size").alias(size), F.col("taken").alias(taken))
    shares = shares.withColumn(number, F.row_number().over(alike.orderBy(taken)))
    rows = docs.withColumns({own_id: F.col(doc_id).cast("long"), own_source: F.col(source).cast("string"), own_hash: F.md5(text_of(text).cast("binary"))})
    rows = rows.withColumn(number, F.row_number().over(alike.orderBy(F.lit(0))))
    same = [rows[c].eqNullSafe(shares[c]) for c in (own_id, own_source)] + [rows[c] == shares[c] for c in (own_hash, number)]
    both = rows.join(shares, same[0] & same[1] & same[2] & same[3]).where(shares[taken] > 0).select(*[rows[c] for c in docs.columns], shares[size], shares[taken])
    rest = F.col(taken) % F.col(size)
    lengths = F.concat(F.array_repeat(F.col(size), (F.col(taken) / F.col(size)).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    cut_text = F.when(F.col(take) == F.col(size), F.col(text)).otherwise(F.array_join(F.slice(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col(take).cast("int")), " "))
    out = both.withColumn(take, F.explode(lengths)).withColumn(text, cut_text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.select(*docs.columns)


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


#: seats of the votes in {votes}, grouped by {group}, ties by {tie}; gives {name}(group, tie, quota).
_SEATS = """
{name}_a AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS n, sum(votes) OVER (PARTITION BY {group}) AS total FROM {votes}),
{name}_b AS (SELECT *,
  CASE WHEN 2 * seats > n AND total > 0 THEN CAST(floor(votes * (2 * seats - n) / (2 * total) + 0.5) AS BIGINT) ELSE 0 END AS sure,
  CASE WHEN total > 0 THEN CAST(floor(votes * (2 * seats + n) / (2 * total) + 0.5) AS BIGINT) ELSE 0 END AS most FROM {name}_a),
{name}_c AS (SELECT *, seats - sum(sure) OVER (PARTITION BY {group}) AS left_ FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(0, most - sure + 2)) AS j FROM {name}_c WHERE votes > 0),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY votes / (2 * (sure + j) + 1) DESC, {tie}, j) AS place FROM {name}_d),
{name}_f AS (SELECT {group}, {tie}, count(*) AS more FROM {name}_e WHERE place <= left_ GROUP BY {group}, {tie}),
{name} AS (SELECT c.*, c.sure + coalesce(f.more, 0) AS quota FROM {name}_c c LEFT JOIN {name}_f f ON c.{group} = f.{group} AND c.{tie} = f.{tie})"""

OP6_SQL = (
    r"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(text, '')) AS hash, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
t1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
t2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM t1),
t3 AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM t2),
t4 AS (SELECT *, CAST((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
   / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t3),
lvl AS (SELECT level FROM t4 WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t5 AS (SELECT source, source_size, n_docs, rank, least(CAST(cap AS DOUBLE), (SELECT level FROM lvl) * weight) AS target FROM t4),
t6 AS (SELECT *, target AS votes, 0 AS all_, CAST(floor((SELECT sum(source_size) FROM src) / 16) AS BIGINT) AS seats FROM t5),"""
    + _SEATS.format(name="q", votes="t6", group="all_", tie="rank")
    + """,
placed AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.rank, q.quota, md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || s.hash) AS drawn,
   CAST(ceil(q.n_docs / 4096) AS BIGINT) AS shards FROM sized s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
placed2 AS (SELECT *, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) % shards AS shard, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) % shards % CAST(ceil(shards / 4096) AS BIGINT) AS part FROM placed),
sh AS (SELECT rank, part, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(quota) AS quota FROM placed2 GROUP BY rank, part, shard),
pa AS (SELECT rank, part, CAST(sum(shard_size) AS DOUBLE) AS votes, any_value(quota) AS seats FROM sh GROUP BY rank, part),"""
    + _SEATS.format(name="u", votes="pa", group="rank", tie="part")
    + """,
sv AS (SELECT sh.rank, sh.part, sh.shard, sh.shard_size, CAST(sh.shard_size AS DOUBLE) AS votes, u.quota AS seats, concat(sh.rank, ':', sh.part) AS own FROM sh JOIN u ON sh.rank = u.rank AND sh.part = u.part),"""
    + _SEATS.format(name="w", votes="sv", group="own", tie="shard")
    + """,
took AS (SELECT rank, shard, shard_size, least(quota * 16, shard_size * 3) AS words FROM w),
line AS (SELECT p.*, t.shard_size, t.words, coalesce(sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY drawn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_,
   CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds FROM placed2 p JOIN took t ON p.rank = t.rank AND p.shard = t.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(rounds * size + greatest(0, least(size, words - rounds * shard_size - at_)) AS BIGINT) AS taken FROM line
"""
)
