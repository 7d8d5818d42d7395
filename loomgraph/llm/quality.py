"""Quality classifier (1): weak labels by expectation-maximisation, then a hashed linear scorer.

1. Overlapping heuristic labellers vote on each text: bad, good, or no vote. Votes are one integer for each row.
2. All rows' vote patterns are counted; there are at most 3 ** 8 of them, whatever the input. On these counts
   expectation-maximisation estimates each labeller's rates of good and bad votes under either class and the share of
   good texts, and gives every pattern the posterior probability of being good.
3. A linear scorer over hashed features learns from the posteriors on a sample of about SAMPLE rows, those whose
   hashes are lowest. Features are word shapes (runs of classes of bytes), words, and how a word follows another.
4. Every row is scored; a row is accepted at a probability of a half or more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import SPACE, arrow_schema, documents, free, ship, slices, span_hashes, text_of, words

SAMPLE = 12_000
FEATURE_BITS = 16
ACCEPT = 0.5
#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 of non-ASCII characters, 4 punctuation of prose; other punctuation is a class by byte.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 4
_PROSE = np.zeros(256, bool)
_PROSE[:] = SPACE
_PROSE[_CLASS <= 4] = True

#: Labellers: name, figure from which it votes bad, figure up to which it votes good (none: it never does).
LABELLERS = (
    ("odd_bytes", 0.04, None),
    ("upper_letters", 0.3, None),
    ("repeated_words", 0.12, None),
    ("lone_marks", 0.08, None),
    ("marked_words", 0.08, None),
    ("digit_bytes", 0.35, None),
    ("few_words", 0.7, None),
    ("odd_words", 0.3, 0.1),
)


def figures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' figures of each row: shares between 0 and 1; nan where there is nothing to measure."""
    n = len(offsets) - 1
    start, end, first = words(data, offsets)
    per_row = lambda flags, at: np.add.reduceat(np.concatenate([flags, [0]]), np.minimum(at[:-1], len(flags))) * (np.diff(at) > 0)
    n_bytes, n_words = np.diff(offsets), np.diff(first)
    cls = _CLASS[data]
    letters = per_row((cls <= 1).astype(np.int64), offsets)
    h = span_hashes(data, start, end)
    row = np.repeat(np.arange(n), n_words)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    odd = np.concatenate([[0], np.cumsum(~_PROSE[data])])
    alnum = np.concatenate([[0], np.cumsum(cls <= 3)])
    marks, plain = odd[end] - odd[start], alnum[end] - alnum[start]
    order = np.lexsort((h, row))
    new = np.ones(len(h), np.int64)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[1:] != row[:-1])
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), np.nan)
    many = np.where(n_words >= 20, n_words, 0)
    return {
        "odd_bytes": share(per_row((~_PROSE[data]).astype(np.int64), offsets), n_bytes),
        "upper_letters": share(per_row((cls == 1).astype(np.int64), offsets), np.where(letters >= 20, letters, 0)),
        "repeated_words": share(per_row(again, first), np.where(n_words >= 4, n_words, 0)),
        "lone_marks": share(per_row((plain == 0).astype(np.int64), first), n_words),
        "marked_words": share(per_row((marks >= 2).astype(np.int64), first), n_words),
        "digit_bytes": share(per_row((cls == 2).astype(np.int64), offsets), n_bytes),
        "few_words": 1 - share(per_row(new, first), many),
        "odd_words": share(per_row(((marks >= 1) | (plain == 0) | (end - start > 40)).astype(np.int64), first), n_words),
    }


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One integer a row: digits to base 3, the first labeller's lowest; 0 no vote, 1 bad, 2 good."""
    found, out = figures(data, offsets), np.zeros(len(offsets) - 1, np.int64)
    for k, (name, bad, good) in enumerate(LABELLERS):
        x = found[name]
        out += np.where(np.isnan(x), 0, np.where(x >= bad, 1, 0 if good is None else np.where(x <= good, 2, 0))) * 3**k
    return out


def posteriors(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Each pattern's probability of being good; and the labellers' rates, labellers x (bad, good) x (no vote, bad, good)."""
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((len(LABELLERS), 2, 3))
    count = np.array([patterns[k] for k in keys], np.float64)
    vote = np.array([[k // 3**j % 3 for j in range(len(LABELLERS))] for k in keys])
    one = np.eye(3)[vote]  # patterns x labellers x votes
    # At first a labeller calls two good texts of a hundred bad, and three bad ones of ten.
    rates = np.tile(np.array([[0.4, 0.3, 0.3], [0.28, 0.02, 0.7]]), (len(LABELLERS), 1, 1))
    good = 0.8
    for _ in range(rounds):
        ll = np.einsum("pjv,jcv->pc", one, np.log(rates))
        odds = ll[:, 1] - ll[:, 0] + np.log(good / (1 - good))
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        weight = np.stack([count * (1 - p), count * p])
        total = np.einsum("cp,pjv->jcv", weight, one) + np.array([[1.0, 1.0, 1.0], [1.0, 0.2, 1.0]])
        rates = total / total.sum(axis=2, keepdims=True)
        good = float(np.clip((weight[1].sum() + 8) / (count.sum() + 10), 0.05, 0.95))
    return dict(zip(keys, p.tolist(), strict=True)), rates


def features(data: np.ndarray, offsets: np.ndarray, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed features and values of a sparse matrix. A row's values are shares of its words; there is always feature 0, 1."""
    n = len(offsets) - 1
    start, end, first = words(data, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    cls = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hashes(cls[keep] + 1, place[start], place[end])
    own = span_hashes(data, start, end)
    again = np.zeros(len(own), np.uint64)
    again[1:] = ((own[1:] == own[:-1]) & (row[1:] == row[:-1])).astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    share = 1 / np.maximum(np.diff(first), 1)[row]
    with np.errstate(over="ignore"):
        hashed = [shape & mask, (shape * np.uint64(3) + again * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask, (own >> np.uint64(7)) & mask]
    key = np.concatenate([np.arange(n, dtype=np.int64) << bits, *((row << bits) + x.astype(np.int64) for x in hashed)])
    value = np.concatenate([np.ones(n), share, share, 0.3 * share])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value = np.add.reduceat(value, new) if len(new) else value
    return key[new] >> bits, key[new] & int(mask), value


def learn(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, bits: int = FEATURE_BITS, rounds: int = 150) -> np.ndarray:
    """Weights of logistic regression on soft targets: full-batch gradients, each weight with its own decaying step, a small ridge."""
    w, power = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    n = max(1, len(target))
    for _ in range(rounds):
        z = np.bincount(rows, values * w[cols], n)[: len(target)]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.bincount(cols, values * error[rows], 1 << bits) / n + 1e-6 * w
        power += slope * slope
        w -= 0.5 * slope / np.sqrt(power)
    return w.astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> dict:
    """Posteriors of all vote patterns, the labellers' rates, and the scorer's weights."""
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(text_of(text).alias("text"))

    def counted(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for _, _, data, at in slices(batch, 0):
                for v, n in zip(*np.unique(votes(data, at), return_counts=True), strict=True):
                    seen[int(v)] = seen.get(int(v), 0) + int(n)
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    counts = {r.votes: r.n for r in rows.mapInArrow(counted, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    known, rates = posteriors(counts)
    below = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, sample / max(1, total)) * (1 << 64)))
    # The hash is of the text, so copies are in the sample together; the number of distinct texts in it is as expected.
    chosen = rows.where(F.xxhash64("text") <= F.lit(below))

    def featured(batches):
        for batch in batches:
            for _, _, data, at in slices(batch, 0):
                r, c, x = features(data, at)
                bound = np.searchsorted(r, np.arange(len(at)))
                parts = list(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True))
                cols = [c[a:b].astype(np.int32).tobytes() for a, b in parts]
                values = [x[a:b].astype(np.float32).tobytes() for a, b in parts]
                yield pa.record_batch([pa.array(votes(data, at)), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], ["votes", "cols", "values"])

    # Equal features are one example, however often they stand.
    found = chosen.dropDuplicates(["text"]).mapInArrow(featured, "votes long, cols binary, values binary").collect()
    cols = [np.frombuffer(r["cols"], np.int32) for r in found]
    at = np.repeat(np.arange(len(found)), [len(c) for c in cols])
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    weights = learn(at, flat(cols, np.int32), flat([np.frombuffer(r["values"], np.float32) for r in found], np.float32), np.array([known[r["votes"]] for r in found]))
    return {"posterior": known, "rates": rates, "weights": weights}


NAMES = ("votes", "posterior", "score", "accepted")


def judge(docs: DataFrame, model: dict | None = None, text: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """``docs`` with its columns and votes (long), posterior, score (double) and accepted (boolean), under ``names``; columns of these names are replaced.

    Null text counts as empty; a text without words has no votes but the prior and feature, and is judged by them.
    Repeated rows get equal results. An empty table fits no weights and returns no rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    model = fit(docs, text=text) if model is None else model
    shared = spark.sparkContext.broadcast((model["posterior"], model["weights"]))
    own = docs.drop(*names)
    at_text = own.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), *(f"`{n}` {kind}" for n, kind in zip(names, ("long", "double", "double", "boolean"), strict=True))])
    kinds = arrow_schema(schema)

    def judged(batches):
        known, weights = shared.value
        for whole in batches:
            for lo, hi, data, at in slices(whole, at_text):
                batch = whole.slice(lo, hi - lo)
                v = votes(data, at)
                r, c, x = features(data, at)
                z = np.bincount(r, x * weights[c], len(v))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                columns = [*batch.columns, pa.array(v), pa.array([known.get(int(k), 0.5) for k in v], pa.float64()), pa.array(p), pa.array(p >= ACCEPT)]
                yield pa.record_batch([a.cast(f.type) for a, f in zip(columns, kinds, strict=True)], names=kinds.names)

    return own.mapInArrow(judged, schema)


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, whatever their names."""
    names = free(docs.columns, *NAMES)
    return judge(docs, text=text, names=tuple(names)).where(F.col(names[-1])).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "votes", "posterior", "score", "accepted")
