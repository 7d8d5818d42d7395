"""LM scoring (2): online logistic mixing of hashed-context bit predictors, beside a smoothed unigram base.

A text is its tokens: lower-cased words between ASCII white space, then one end. The model codes them in order, bit by bit, and
gives each bit a probability from what went before it in the text; so its probabilities are a distribution over token
sequences, the same that the base scores, and total bits per byte follow from them.

* A frequent word is its path in a binary tree (a prefix code by counts, with the end and an escape). Four predictors read the
  bits' counts under contexts: none (exact counts), and, hashed, the group that the text so far belongs to, the word before, and
  the group with the last bytes of the word before. Groups stand for the values of a column (the language); which one a text
  belongs to is read from its own words, as they come. What these contexts share is scored once in a batch of texts.
* Any other word is the escape, and then its bytes, bit by bit, closed by a space. Five predictors read counts under
  the last 1, 2, 3 and 4 bytes of the word, and all of it so far. This cost depends on the word alone, so every distinct one is
  scored once, and words meet documents again in an equi-join.
* Counts come from every training document. They are sums, so tasks add them up in any order.
* Predictions are mixed in the logistic domain. A gate, by how often the long contexts have been seen, chooses the weights. The
  weights are learned online, batch after batch in a fixed order, from predictions that leave out the bit itself, on all training
  text. It is dealt to shards of a fixed size by hash; what they have learned is averaged in whole numbers, so neither cores nor the
  order of tasks change a score.
* A refinement table, learned adaptively in the same pass, maps the mixed prediction to the frequency with which it
  came true, by gate, with interpolation between its cells.

What reaches the driver is the frequent words (HEAD at most, of WORD_BYTES at most), the tables, whose sizes follow the
training text up to 2 ** MOST_BITS slots each, and the weights. Beyond that size contexts share slots more often.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import SPACE, arrow_schema, cut, documents, flat_bytes, lowered, mixed, powers, ship, slices, text_of

#: Frequent words are the HEAD most frequent ones that stand twice at least and have no more than WORD_BYTES bytes.
HEAD = 100_000
WORD_BYTES = 64
#: The most frequent values of the column are a group each, all others together are the last.
GROUPS = 8
#: A table has two to four slots for each training token (spelling: 16 to 32 for each word), between these numbers of bits.
LEAST_BITS, MOST_BITS = 16, 21
FLOOR = 0.2
CELLS = 33
#: Tokens of a learning shard, distinct words of a spelling shard, events of a batch.
SHARD_TOKENS, SHARD_WORDS = 1 << 22, 1 << 19
BATCH = 1 << 17
#: Tokens whose contexts are taken together in learning and in scoring: the more, the more they share.
TOGETHER, SCORED = 1 << 21, 1 << 20
WINDOW = 1 << 12
#: The share of the curvature that the online Newton step remembers; it is measured on each of the first batches, then on every fourth.
MEMORY = 0.95
END = b" "
BLOCK_SLOTS = 1 << 16
#: Blocks that are added up in one task.
FAN_IN = 256
FIXED = 1 << 12
_LOG = np.log(np.arange(1 << 16) + FLOOR).astype(np.float32)
_K1, _K2, _K3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


# Mixing


def squash(x: np.ndarray) -> np.ndarray:
    """x: between -8 and 8."""
    return 1 / (1 + np.exp(-x))


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower cell of the refinement table for each mixed prediction, and how far it is from there to the next."""
    at = (x + 8) * np.float32((CELLS - 1) / 16)
    low = np.minimum(at.astype(np.int64), CELLS - 2)
    return low, at - low


class Learner:
    """Weights (gates x inputs and a bias) and refinement counts, learned batch after batch."""

    def __init__(self, gates: int, inputs: int):
        self.gates, self.inputs, self.steps = gates, inputs, np.zeros(gates, np.int64)
        self.weights = start_weights(gates, inputs)
        self.curve = np.tile(np.eye(inputs + 1), (gates, 1, 1)) * 10
        self.seen = np.zeros(gates)
        self.refined = np.zeros((gates, CELLS, 2))

    def step(self, inputs: list[np.ndarray], gate: np.ndarray, hit: np.ndarray, value: np.ndarray | None = None) -> None:
        """inputs: each predictor's predictions of the events, or what a table has for them. One Newton step of each gate that has events; predictions come before the step."""
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        gate, hit, x = gate.take(order), hit.take(order).astype(np.float32), np.ones((self.inputs + 1, len(order)), np.float32)
        for k, one in enumerate(inputs):
            x[k] = one.take(order) if one.dtype == np.float32 else value_of(one.take(order))
        value = None if value is None else value.take(order)
        bound = np.searchsorted(gate, np.arange(self.gates + 1))
        z = np.empty(len(order), np.float32)
        own = np.flatnonzero(np.diff(bound))
        parts = [slice(bound[g], bound[g + 1]) for g in own.tolist()]
        for g, part in zip(own.tolist(), parts, strict=True):
            z[part] = self.weights[g].astype(np.float32) @ x[:, part]
        z = np.clip(z, -8, 8)
        p = squash(z)
        error, bend = hit - p, p * (1 - p)
        if value is not None:
            error, bend = error * value, bend * value
        slope = np.stack([x[:, part] @ error[part] for part in parts])
        for g, part in zip(own.tolist(), parts, strict=True):
            if self.steps[g] < 8 or self.steps[g] % 4 == 0:  # the curvature changes slowly
                self.curve[g] = self.curve[g] * MEMORY + (x[:, part] * bend[part]) @ x[:, part].T
        self.steps[own] += 1
        curve = self.curve[own]
        ridge = 1 + 1e-3 * np.trace(curve, axis1=1, axis2=2)
        self.weights[own] += np.linalg.solve(curve + np.eye(self.inputs + 1) * ridge[:, None, None], slope[:, :, None])[:, :, 0]
        self.seen += np.diff(bound) if value is None else np.add.reduceat(np.append(value, 0).astype(np.float64), np.minimum(bound[:-1], len(value))) * (np.diff(bound) > 0)
        low, rest = _cells(z)
        key = 2 * (gate.astype(np.int64) * CELLS + low) + hit.astype(np.int64)
        n = 2 * self.gates * CELLS
        left = 1 - rest
        if value is not None:
            left, rest = left * value, rest * value
        self.refined += (np.bincount(key, left, n) + np.bincount(key + 2, rest, n)).reshape(self.refined.shape)

    def parts(self) -> np.ndarray:
        """What is added up over shards, in whole numbers: weights by examples, examples, refinement counts."""
        return np.rint(np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, self.refined.ravel()]) * FIXED).astype(np.int64)


def start_weights(gates: int, inputs: int) -> np.ndarray:
    out = np.full((gates, inputs + 1), 1 / inputs)
    out[:, -1] = 0
    return out


def averaged(parts: np.ndarray, gates: int, inputs: int) -> dict:
    """weights and refined (probabilities) of the sum of all shards' parts."""
    total = parts.astype(np.float64) / FIXED
    a, b = gates * (inputs + 1), gates * (inputs + 2)
    weights, seen, refined = total[:a].reshape(gates, -1), total[a:b], total[b:].reshape(gates, CELLS, 2)
    weights = np.where(seen[:, None] > 0, weights / np.maximum(seen, 1e-9)[:, None], start_weights(gates, inputs))
    centre = squash(np.linspace(-8, 8, CELLS))
    refined = (refined[..., 1] + 20 * centre) / (refined.sum(axis=-1) + 20)
    low, rest = _cells(_LEVELS)
    one = (squash(_LEVELS) + refined[:, low] * (1 - rest) + refined[:, low + 1] * rest) / 2
    return {"weights": weights.astype(np.float32), "logs": np.log10(np.maximum(np.stack([1 - one, one], axis=-1), 1e-5)).astype(np.float32).ravel()}


#: Mixed predictions are rounded to 128ths, so that what follows from them is read from a table.
_LEVELS = np.linspace(-8, 8, 16 * 128 + 1)


def mixed_log10(model: dict, st: list[np.ndarray], gate: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """log10 of each bit's probability, from the predictors' stretched predictions, or what a table has for them."""
    weights, gate = model["weights"] * np.float32(128), gate.astype(np.int64)
    plain = weights[:, -1] + np.float32(8 * 128 + 0.5)  # cut off below, so it rounds
    for k, one in enumerate(st):
        if one.dtype != np.float32:
            weights[:, k] /= 320
            plain -= weights[:, k] * 4096
    x = plain.take(gate, mode="clip")
    for k, one in enumerate(st):
        by = weights[:, k].copy().take(gate, mode="clip")
        by *= one if one.dtype == np.float32 else one >> 3
        x += by
    np.clip(x, 0, len(_LEVELS) - 1, out=x)
    gate *= len(_LEVELS)
    gate += x.astype(np.int64)
    gate *= 2
    gate += hit
    return model["logs"].take(gate, mode="clip")


# Tables of counts


def compressed(counts: np.ndarray) -> bytes:
    """Whole numbers, most of them small: one byte each, and the large ones with their places."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(len(large).to_bytes(4, "little") + large.astype(np.uint32).tobytes() + counts[large].astype(np.int64).tobytes() + small.tobytes(), 1)


def expanded(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, offset=4 + 12 * n).astype(np.int64)
    out[np.frombuffer(raw, np.uint32, n, 4)] = np.frombuffer(raw[4 + 4 * n : 4 + 12 * n], np.int64)
    return out


def emitted(tables: list[np.ndarray], shard: int):
    """Blocks of slots x 2 counts: (block, part, counts), for ``summed``."""
    import pyarrow as pa

    block = 0
    for table in tables:
        for lo in range(0, len(table), BLOCK_SLOTS):
            part = table[lo : lo + BLOCK_SLOTS]
            if part.any():
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([shard], pa.int64()), pa.array([compressed(part.reshape(-1))])], ["block", "part", "counts"])
            block += 1


BLOCKS = "block int, part long, counts binary"


def _added(table):
    import pyarrow as pa

    total = 0
    for data in table["counts"].to_pylist():
        total = total + expanded(data)
    return pa.table({"block": table["block"][:1], "part": table["part"][:1], "counts": pa.array([compressed(total)])})


def summed(blocks: DataFrame) -> DataFrame:
    """Each block's sum over all parts; FAN_IN of them at a time, so that no task holds all parts of a block."""
    most = None
    while most is None or most > 0:
        blocks = cut(blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("block", "part").applyInArrow(_added, BLOCKS), "blocks")
        most = blocks.agg(F.coalesce(F.max("part"), F.lit(0)).alias("most")).first()["most"]
    return blocks


def tables_of(parts: Iterable[tuple[int, bytes]], sizes: list[int]) -> list[np.ndarray]:
    """The counts of each predictor, packed: the number of 0s in the lower 16 bits, of 1s in the upper; larger ones are halved together."""
    out = [np.zeros(n, np.uint32) for n in sizes]
    first = np.cumsum([0, *(-(-n // BLOCK_SLOTS) for n in sizes)])
    for block, data in parts:
        k = int(np.searchsorted(first, block, side="right")) - 1
        own = expanded(data).reshape(-1, 2)
        over = np.maximum(own.max(axis=1), 65_535)[:, None] / 65_535
        small = np.minimum(np.rint(own / over), 65_535).astype(np.uint32)
        small = np.where((own > 0) & (small == 0), 1, small).astype(np.uint32)
        lo = (block - int(first[k])) * BLOCK_SLOTS
        out[k][lo : lo + len(own)] = small[:, 0] | small[:, 1] << np.uint32(16)
    return out


#: Levels of a context's count: 0, then up to 1, 3, 15, 63, 255 and more.
LEVELS = (1, 2, 4, 16, 64, 256)
_LEVEL_OF = np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), side="right").astype(np.int32)


def level_of(n: np.ndarray) -> np.ndarray:
    return _LEVEL_OF[np.minimum(n, LEVELS[-1])]


def _coded(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of counts: ln(p / (1 - p)) in 320ths, and the level of their sum in the lowest three bits, as 16 bits."""
    x = np.clip(np.rint((_LOG[one] - _LOG[zero]) * 320), -4095, 4095).astype(np.int32) + 4096
    return (np.where(zero + one == 0, 4096, x) << 3 | level_of(zero + one)).astype(np.uint16)


def stretched(packed: np.ndarray) -> np.ndarray:
    """What a table of counts predicts, by slot."""
    return _coded((packed & np.uint32(0xFFFF)).astype(np.int32), (packed >> np.uint32(16)).astype(np.int32))


def without_itself(packed: np.ndarray) -> np.ndarray:
    """What the table predicts for one of its own bits without that bit: at 2 * slot for a 0, at 2 * slot + 1 for a 1."""
    zero, one = (packed & np.uint32(0xFFFF)).astype(np.int32), (packed >> np.uint32(16)).astype(np.int32)
    return np.stack([_coded(np.maximum(zero - 1, 0), one), _coded(zero, np.maximum(one - 1, 0))], axis=1).reshape(-1)


def _beside(tables: list[np.ndarray]) -> list[np.ndarray]:
    """``without_itself`` of those that are still counts."""
    return [x if x.dtype == np.uint16 else without_itself(x) for x in tables]


def value_of(coded: np.ndarray) -> np.ndarray:
    return ((coded >> 3).astype(np.float32) - 4096) * np.float32(1 / 320)


# Spelling of words that aren't frequent


#: Bytes of context of each predictor (0: the whole word so far).
ORDERS = (1, 2, 3, 4, 0)
#: Gates of a bit: the upper four levels of the whole word so far; below them, the levels of its last 4 bytes, with and without the whole having been seen.
SPELL_GATES = 4 + 2 * (len(LEVELS) + 1)


def spell_bits(n_words: int) -> tuple[int, ...]:
    """Bits of each predictor's table for so many distinct words."""
    most = min(MOST_BITS, max(LEAST_BITS, (16 * n_words).bit_length()))
    return tuple(min(b, most) for b in (16, 18, most, most, most))


class Spelling:
    """The flat bytes of words, each closed by a space, with their contexts' hashes.

    once: bytes that follow the same bytes in several words stand once; place says which of them each byte of the words is.
    """

    def __init__(self, words: list[bytes], once: bool = False):
        self.data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        self.length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.cumsum(self.length) - self.length
        n = len(self.data)
        place = np.arange(n) - np.repeat(self.start, self.length)
        h = np.full(n, 0x1234567, np.uint32)
        self.hashes = []
        with np.errstate(over="ignore"):
            for k in range(1, max(ORDERS) + 1):
                longer = np.flatnonzero(place >= k)
                h[longer] = h[longer] * np.uint32(0x2C1B3C6D) + self.data[longer - k] + np.uint32(0x297A2D39)
                self.hashes.append(h.copy())
            base = np.uint64(0x9E3779B97F4A7C15)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=total[1:])
            back = powers(np.uint64(pow(int(base), -1, 1 << 64)), n)
            at = np.repeat(self.start, self.length)
            whole = (total[:n] - total[at]) * back[at]
            self.hashes.append(((whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
            if once:
                key = (total[1:] - total[at]) * back[at]
                order = np.argsort(key)
                new = np.concatenate([[True], np.diff(key[order]) != 0])
                self.place = np.empty(n, np.int64)
                self.place[order] = np.cumsum(new) - 1
                kept = order[new]
                self.data, self.hashes = self.data[kept], [x[kept] for x in self.hashes]

    def slots(self, bits: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Of each bit of a byte: which one, what it is, and each predictor's slot that its context and the byte's higher bits lead to."""
        # The bits of a half byte share a page of 16 neighbouring slots.
        upper, lower = self.data >> 4 | 16, self.data & 15 | 16
        for half, page in ((upper, np.uint32(1)), (lower, upper.astype(np.uint32))):
            with np.errstate(over="ignore"):
                page = page * _K1
                pages = [(((h + page) * _K2 >> np.uint32(36 - b)) << np.uint32(4)).astype(np.int64) for h, b in zip(self.hashes, bits, strict=True)]
            for bit in (3, 2, 1, 0):
                place = half >> (bit + 1)
                yield bit + 4 * (half is upper), half >> bit & 1, [p | place for p in pages]


def _spell_gate(bit: int, four: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of the levels of two contexts."""
    return bit * SPELL_GATES + _SPELL.take(whole.astype(np.int64) * 8 + four)


_SPELL = np.array([whole - 3 if whole > 2 else 4 + 2 * min(four, len(LEVELS)) + (whole > 0) for whole in range(8) for four in range(8)])


def _batches_of_words(words: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for k, w in enumerate(words):
        held += len(w) + 1
        if held >= size or k == len(words) - 1:
            yield lo, k + 1
            lo, held = k + 1, 0


def _spell_counted(batches, bits: tuple[int, ...], shard: int):
    """word, c -> blocks of the tables' counts."""
    tables = [np.zeros((1 << b, 2), np.uint32) for b in bits]
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), np.minimum(batch.column(1).to_numpy(), 1 << 24).astype(np.uint32)
        for lo, hi in _batches_of_words(words, 1 << 20):
            s = Spelling(words[lo:hi], once=True)
            weight = np.bincount(s.place, np.repeat(counts[lo:hi], s.length)).astype(np.uint32)
            for _, right, slots in s.slots(bits):
                for table, slot in zip(tables, slots, strict=True):
                    np.add.at(table.reshape(-1), 2 * slot + right, weight)
    yield from emitted(tables, shard)


def _spell_learned(batches, packed: list[np.ndarray], bits: tuple[int, ...]) -> np.ndarray:
    """word, c -> the shard's parts."""
    learner, own = Learner(8 * SPELL_GATES, len(ORDERS)), _beside(packed)
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for lo, hi in _batches_of_words(words, BATCH // 8):
            s = Spelling(words[lo:hi], once=True)
            value = np.bincount(s.place, np.repeat(counts[lo:hi], s.length)).astype(np.float32)
            for bit, hit, slots in s.slots(bits):
                found = [table.take(2 * slot + hit, mode="clip") for table, slot in zip(own, slots, strict=True)]
                learner.step(found, _spell_gate(bit, *(v & 7 for v in found[3:])), hit, value)
    return learner.parts()


def word_scores(model: dict, words: list[bytes]) -> np.ndarray:
    """log10 of each word's probability by its spelling."""
    if not words:
        return np.zeros(0)
    s = Spelling(words, once=True)
    total = np.zeros(len(s.data))
    sizes = tuple(len(table).bit_length() - 1 for table in model["stretch"])
    for bit, hit, slots in s.slots(sizes):
        st = [table.take(slot, mode="clip") for table, slot in zip(model["stretch"], slots, strict=True)]
        total += mixed_log10(model, st, _spell_gate(bit, *(v & 7 for v in st[3:])), hit)
    return np.add.reduceat(total[s.place], s.start)


# Tokens


class Code:
    """Frequent words as paths of a binary tree, and what a text's tokens say about its group.

    Symbols: 0 the end, 1 the escape, 2 .. the words in order. counts: symbols x groups.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts
        n = len(words) + 2
        self.n = n
        total = np.maximum(counts.sum(axis=1), 1)
        heap = [(int(c), k) for k, c in enumerate(total)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            side[y] = 1
            heapq.heappush(heap, (a + b, node))
        climb, at = [], np.arange(n)
        root = 2 * n - 2
        while (at != root).any():
            climb.append((np.where(at == root, -1, parent[at] - n), side[at]))
            at = np.where(at == root, root, parent[at])
        nodes, bits = np.stack([a for a, _ in climb[::-1]], axis=1), np.stack([b for _, b in climb[::-1]], axis=1)
        here = nodes >= 0
        self.length = here.sum(axis=1)
        self.start = np.cumsum(self.length) - self.length
        nodes, self.bits = nodes[here], bits[here]
        # Four bits in a row share a page of 16 neighbouring slots: its hash, with the place in the page in the lowest four bits.
        entry = np.arange(len(nodes))
        deep = entry - np.repeat(self.start, self.length)
        # Paths as binary fractions, by which tokens are sorted: the first 64 bits.
        self.path = np.bitwise_or.reduceat(np.where(deep < 64, self.bits.astype(np.uint64) << (63 - np.minimum(deep, 63)).astype(np.uint64), np.uint64(0)), self.start)
        self.rank = np.empty(n, np.int64)
        self.rank[np.argsort(self.path, kind="stable")] = np.arange(n)
        deep %= 4
        slot = np.ones(len(nodes), np.uint32)
        for j in (3, 2, 1):
            slot = np.where(deep >= j, 2 * slot + self.bits[np.maximum(entry - j, 0)].astype(np.uint32), slot)
        with np.errstate(over="ignore"):
            self.nodes = ((nodes[entry - deep].astype(np.uint32) + np.uint32(1)) * _K1 * _K3 & ~np.uint32(15)) | slot.astype(np.uint32)
        # What the exact counts of each node predict.
        times = np.repeat(counts.sum(axis=1), self.length)
        one = np.bincount(nodes, times * self.bits, n - 1)[nodes]
        zero = np.bincount(nodes, times, n - 1)[nodes] - one
        self.suffix = np.array([1, 2, *(zlib.crc32(w[-2:]) & 0xFFFFFF for w in words), 0], np.uint32)  # of the last bytes; at last of no word
        self.plain = np.where(one + zero > 0, np.log((one + FLOOR) / (zero + FLOOR)), 0).astype(np.float32)
        # A twentieth of each group's distribution is that of all: a few odd words don't decide, and a group without texts is like all.
        group, share = counts.sum(axis=0), total / total.sum()
        self.logs = np.log(0.95 * np.where(group > 0, counts / np.maximum(group, 1), share[:, None]) + 0.05 * share[:, None])
        self.prior = np.log(group + 1.0)
        # Groups without texts are all alike; two of them tell as much as all do.
        keep = np.sort(np.concatenate([np.flatnonzero(group > 0), np.flatnonzero(group == 0)[:2]]))
        # Sums for a group are only compared, so those of the first are taken off.
        self.kept, self.kept_logs, self.kept_prior = keep, self.logs[:, keep[1:]] - self.logs[:, keep[:1]], (self.prior[keep[1:]] - self.prior[keep[0]])[:, None]


def pieces_of(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end at white space, so that the words of a very long one are never held at once."""
    if len(raw) <= size:
        yield raw
        return
    space = np.flatnonzero(SPACE[np.frombuffer(raw, np.uint8)])
    lo = 0
    while lo < len(raw):
        k = int(np.searchsorted(space, lo + size))
        hi = int(space[k]) if k < len(space) else len(raw)
        yield raw[lo:hi]
        lo = hi


#: Texts that are longer than this alone are taken by parts.
LONG = 1 << 23


def parts_of(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts as they are, or one very long one in parts: first text, last text + 1, flat bytes, offsets."""
    if len(at) > 2 or len(data) <= LONG:
        yield 0, len(at) - 1, data, at
    else:
        for piece in pieces_of(data.tobytes()):
            yield 0, 1, np.frombuffer(piece, np.uint8), np.array([0, len(piece)])


def indexed(data: np.ndarray, at: np.ndarray) -> tuple:
    """Of texts (flat bytes and their n + 1 offsets): each word's number, for each text the number of words before it (n + 1), and the different words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(lowered(data))]))
    first, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
    full = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]) > 0
    if not full.all():  # white space at a text's begin or end has an empty word beside it
        first, words = np.concatenate([[0], np.cumsum(full)])[first], words.filter(pa.array(full))
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), first, found.dictionary.cast(pa.binary())


def symbols_of(data: np.ndarray, at: np.ndarray, known, rare_too: bool = True) -> tuple:
    """Of texts (flat bytes and their n + 1 offsets): the symbols of their tokens, each text's end last, and where texts begin; and of each
    different word that has no symbol in each text that has it (unless not rare_too): the text, the word, how often. known: the words with symbols,
    as an Arrow array.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(at) - 1
    index, first, words = indexed(data, at)
    own = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(2)
    text = np.repeat(np.arange(n), np.diff(first))
    symbol = np.zeros(len(index) + n, np.int32)
    rare = own == 1
    symbol[np.arange(len(index)) + text] = own.take(index)
    if not rare_too:
        return symbol, first[:-1] + np.arange(n)
    other = np.flatnonzero(rare[index])
    key, times = np.unique(text[other] * max(1, len(own)) + index[other], return_counts=True)
    text, word = np.divmod(key, max(1, len(own)))
    return symbol, first[:-1] + np.arange(n), text, words.take(pa.array(word)), times


def tokens_of(data: np.ndarray, at: np.ndarray, known, rare_too: bool = True) -> tuple:
    """The same, of a very long text a part of it at a time."""
    import pyarrow as pa

    if len(at) > 2 or len(data) <= LONG:
        return symbols_of(data, at, known, rare_too)
    symbols, rare = [], Counter()
    for _, _, part, place in parts_of(data, at):
        symbol, _, *found = symbols_of(part, place, known, rare_too)
        symbols.append(symbol[:-1])
        if rare_too:
            for w, c in zip(found[1].to_pylist(), found[2].tolist(), strict=True):
                rare[w] += c
    symbols.append(np.zeros(1, np.int32))
    if not rare_too:
        return np.concatenate(symbols), np.zeros(1, np.int64)
    return np.concatenate(symbols), np.zeros(1, np.int64), np.zeros(len(rare), np.int64), pa.array(list(rare), pa.binary()), np.array(list(rare.values()), np.int64)


def token_groups(code: Code, symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of all tokens: 3 times the group that the text before it fits best, and 0 to 2 for how sure that is. starts: where texts begin (ascending, from 0)."""
    n, kept, logs, prior = len(symbol), code.kept, code.kept_logs, code.kept_prior
    out = np.zeros(n, np.uint8)
    carry = np.zeros(len(prior))
    for lo in range(0, n, 1 << 14):
        hi = min(n, lo + (1 << 14))
        total = np.zeros((len(prior), hi - lo + 1))
        np.cumsum(logs.take(symbol[lo:hi], axis=0).T, axis=1, out=total[:, 1:])
        after, total = total[:, -1].copy(), total[:, :-1]  # of the tokens before, in this window
        heads = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo
        edge = np.concatenate([[0] if not len(heads) or heads[0] else [], heads, [hi - lo]]).astype(np.int64)
        base = total[:, edge[:-1]] - prior
        if len(edge) > len(heads) + 1:  # the window begins within a text
            base[:, 0] -= carry
        total -= np.repeat(base, np.diff(edge), axis=1)
        top, second, first = np.zeros(hi - lo), np.full(hi - lo, -np.inf), np.zeros(hi - lo, np.uint8)
        for k, one in enumerate(total, 1):
            first[one > top + 1e-9] = k  # rounding errors, which depend on the texts before, don't decide
            np.maximum(second, np.minimum(top, one), out=second)
            np.maximum(top, one, out=top)
        gap = np.round(top - second, 6)
        out[lo:hi] = 3 * kept.astype(np.uint8).take(first) + (gap >= 1) + (gap >= 4)
        carry = after - base[:, -1] - prior[:, 0]
    return out


def _scattered(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of integers of so many bits; x is overwritten."""
    most = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        x *= np.uint64(0x9E3779B97F5)
        x &= most
        x ^= x >> np.uint64(bits // 2)
        x *= np.uint64(0xC2B2AE3D27D)
    x &= most
    return x


def _in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits (uint64, overwritten) in order, and where each stood; equal ones as they stood."""
    n = (len(key) - 1).bit_length()
    if bits + n > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    key <<= np.uint64(n)  # with their places in the lowest bits: whole numbers alone are sorted faster than places by keys
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << n) - 1)).view(np.int64)
    key >>= np.uint64(n)
    return key, order


def distinct(code: Code, symbol: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different tokens in their contexts: group, word before, symbol, how often each stands, and which of them each token is.

    Contexts are in order of a hash; those of one context in order of their paths, so that neighbours share bits.
    """
    before = np.full(len(symbol), code.n, np.int32)
    before[1:] = symbol[:-1]
    before[starts] = code.n
    group = token_groups(code, symbol, starts)
    bits = code.n.bit_length()
    key = group.astype(np.uint64)
    key <<= np.uint64(bits)
    key |= before.view(np.uint32)
    key = _scattered(key, bits + 5)
    key <<= np.uint64(bits)
    key |= code.rank.take(symbol).view(np.uint64)
    key, order = _in_order(key, 2 * bits + 5)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(new)
    first, times = order[at], np.diff(at, append=len(key))
    del key
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return group[first], before[first], symbol[first], times, place


def in_blocks(n: int, size: int = 64) -> np.ndarray:
    """0 .. n - 1, blocks of neighbours in order of a hash: what is learned from together is of many contexts."""
    blocks = np.argsort(mixed(np.arange(1, -(-n // size) + 1, dtype=np.uint64)), kind="stable")
    order = (blocks[:, None] * size + np.arange(size)).reshape(-1)
    return order[order < n]


def shared_bits(code: Code, group: np.ndarray, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Of tokens: how many first bits each has in common with the one before it; 0 where that stands in another context."""
    out = np.zeros(len(symbol), np.int64)
    path = code.path[symbol]
    # A float of 53 bits may be rounded up to the next power of 2: then one bit less is shared.
    same = 64 - np.frexp((path[1:] ^ path[:-1]).astype(np.float64))[1]
    out[1:] = np.where((group[1:] == group[:-1]) & (before[1:] == before[:-1]), np.minimum(same, code.length[symbol[1:]] - 1), 0)
    return out


def contexts_of(code: Code, group: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Each hashed predictor's context; the lowest four bits are left to the place in a page."""
    group, before, end = group.astype(np.uint32), before.astype(np.uint32), code.suffix[before]
    with np.errstate(over="ignore"):
        contexts = [(group + np.uint32(1)) * np.uint32(0x27D4EB2F), (before + np.uint32(7)) * _K2, (end + np.uint32(3)) * np.uint32(0x2C1B3C6D) + (group // np.uint32(3)) * np.uint32(0x51ED270B)]
        return [(c ^ (c >> np.uint32(15))) * _K3 & ~np.uint32(15) for c in contexts]


TOKEN_INPUTS = 4
#: Gates: whether the group is sure, four levels of the group with the last bytes, five of the word before.
TOKEN_GATES = 2 * 4 * 5
_LAST, _ONE = np.array([0, 1, 2, 2, 3, 3, 3, 3]) * 5, np.array([0, 1, 1, 2, 3, 4, 4, 4])
_GATES = (np.array([0, 20])[:, None, None] + _LAST[:, None] + _ONE).reshape(-1)


def token_bits(n_tokens: int) -> tuple[int, ...]:
    """Bits of each hashed predictor's table for so many training tokens."""
    return (min(MOST_BITS, max(LEAST_BITS, (2 * n_tokens).bit_length())),) * (TOKEN_INPUTS - 1)


def events(code: Code, symbol: np.ndarray, shared: np.ndarray, contexts: list[np.ndarray], bits: tuple[int, ...], sides: bool = False) -> tuple:
    """The different bits of tokens, in order; bits that a token shares with the one before it stand there.

    Returns the first bit of each token (of those that it doesn't share; each has one); of each bit its token, its place in the code, the bit;
    each hashed predictor's slots (sides: twice that, and the bit); and the bits that tokens after theirs share: which bits, their tokens, and the first token that no longer shares it.
    """
    n, shared = len(symbol), shared.copy()
    shared[0] = 0
    times = code.length[symbol] - shared
    first = np.cumsum(times) - times
    token = np.repeat(np.arange(n), times)
    at = (code.start[symbol] + shared - first).take(token)
    at += np.arange(len(token))
    after = (shared > np.arange(max(1, int(shared.max())))[:, None]).reshape(-1)
    edge = np.append(np.flatnonzero(after[1:] != after[:-1]), len(after) - 1)  # row by row, a row begins with a token that shares nothing
    begin, end = edge[0 : len(edge) // 2 * 2 : 2], edge[1::2] + 1
    depth = begin // n
    begin -= depth * n
    end -= depth * n
    wide = first[begin] + depth - shared[begin], begin, end
    slots = []
    with np.errstate(over="ignore"):
        node, hit = code.nodes.take(at, mode="clip"), code.bits.take(at, mode="clip")
        place = node & np.uint32(15)
        if sides:
            place <<= np.uint32(1)
            place |= hit.view(np.uint8)
        for c, b in zip(contexts, bits, strict=True):
            h = np.repeat(c, times)
            h += node  # of a page all bits have the same upper 28 bits
            h >>= np.uint32(32 - b)
            if sides:
                h <<= np.uint32(1)
            h ^= place
            slots.append(h.astype(np.int64))
    return first, token, at, hit, slots, wide


def _held(many: np.ndarray, token: np.ndarray, wide: tuple) -> np.ndarray:
    """How often each bit stands, of how often its tokens do."""
    out, total = many.take(token), np.concatenate([[0], np.cumsum(many)])
    out[wide[0]] = total[wide[2]] - total[wide[1]]
    return out


def _totals(cost: np.ndarray, first: np.ndarray, wide: tuple) -> np.ndarray:
    """Each token's sum over its bits, shared ones too."""
    n, share = len(first), cost[wide[0]]
    more = np.bincount(wide[1] + 1, share, n + 1) - np.bincount(wide[2], share, n + 1)
    return np.add.reduceat(cost, first, dtype=np.float64) + np.cumsum(more)[:n]


def _token_gate(sure: np.ndarray, one: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of what the word before and the group with its last bytes predict."""
    level = last & 7
    level <<= 3
    level |= one & 7
    level |= sure.astype(np.uint16) << 6
    return _GATES.take(level, mode="clip")


def _windows(n: int) -> Iterator[slice]:
    return (slice(lo, min(n, lo + WINDOW)) for lo in range(0, n, WINDOW))


def token_scores(model: dict, code: Code, symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of each text's probability, but for the spelling of words that have no symbol."""
    group, before, own, _, place = distinct(code, symbol, starts)
    contexts, sure, shared = contexts_of(code, group, before), group % 3 == 2, shared_bits(code, group, before, own)
    sizes = tuple(len(table).bit_length() - 1 for table in model["stretch"])
    each = np.zeros(len(own))
    for w in _windows(len(own)):
        first, token, at, hit, slots, wide = events(code, own[w], shared[w], [c[w] for c in contexts], sizes)
        found = [table.take(slot, mode="clip") for table, slot in zip(model["stretch"], slots, strict=True)]
        gate = _token_gate(sure[w].take(token), *found[1:])
        each[w] = _totals(mixed_log10(model, [code.plain.take(at, mode="clip"), *found], gate, hit), first, wide)
    return np.add.reduceat(each[place], starts)


def _token_counted(batches, code: Code, bits: tuple[int, ...], shard: int):
    """ids of training texts (binary) -> blocks of the tables' counts."""
    tables = [np.zeros((1 << b, 2), np.uint32) for b in bits]
    for symbol, starts in _joined(batches):
        group, before, own, many, _ = distinct(code, symbol, starts)
        contexts, shared = contexts_of(code, group, before), shared_bits(code, group, before, own)
        for w in _windows(len(own)):
            _, token, _, _, slots, wide = events(code, own[w], shared[w], [c[w] for c in contexts], bits, True)
            value = _held(many[w], token, wide).astype(np.uint32)
            for table, slot in zip(tables, slots, strict=True):
                np.add.at(table.reshape(-1), slot, value)
    yield from emitted(tables, shard)


def _token_learned(batches, code: Code, packed: list[np.ndarray], bits: tuple[int, ...]) -> np.ndarray:
    """ids of a shard's training texts, in order -> the shard's parts."""
    learner, tables = Learner(TOKEN_GATES, TOKEN_INPUTS), _beside(packed)
    for symbol, starts in _joined(batches):
        found = distinct(code, symbol, starts)[:4]
        order = in_blocks(len(found[0]))
        group, before, own, many = (x[order] for x in found)
        contexts, sure, shared = contexts_of(code, group, before), group % 3 == 2, shared_bits(code, group, before, own)
        for w in _windows(len(own)):
            _, token, at, hit, slots, wide = events(code, own[w], shared[w], [c[w] for c in contexts], bits, True)
            found = [table.take(slot, mode="clip") for table, slot in zip(tables, slots, strict=True)]
            learner.step([code.plain.take(at, mode="clip"), *found], _token_gate(sure[w].take(token), *found[1:]), hit, _held(many[w], token, wide).astype(np.float32))
    return learner.parts()


def _joined(batches, size: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed ids of texts, in their order, whole texts of ``size`` tokens or more together: flat ids, starts. What is together follows the rows' order alone, not the batches."""
    held, total = [], 0
    flat = lambda: (np.concatenate(held), np.cumsum([0, *map(len, held[:-1])]))
    for batch in batches:
        data, at = flat_bytes(batch.column(batch.schema.get_field_index("ids")))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            held.append(unpacked_ids(data[a:b]))
            total += len(held[-1])
            if total >= size:
                yield flat()
                held, total = [], 0
    if held:
        yield flat()


def packed_ids(ids: np.ndarray) -> bytes:
    """The lower 16 bits of all ids, then the upper ones, of which most are 0: so they compress."""
    return (ids & 0xFFFF).astype(np.uint16).tobytes() + (ids >> 16).astype(np.uint8).tobytes()


def unpacked_ids(data: np.ndarray) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data[: 2 * n].tobytes(), np.uint16).astype(np.int32) | data[2 * n :].astype(np.int32) << 16


# Jobs


def is_held_out(doc_id) -> bool:
    """Whether crc32 of the id's text is a multiple of 10; a null id has the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def groups_of(rows: DataFrame, group: str | None) -> dict:
    """The most frequent values of the column: value -> group. All others are the last group."""
    if group is None:
        return {}
    found = rows.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(GROUPS - 1).collect()
    return {r[group]: k for k, r in enumerate(found)}


def vocabulary(rows: DataFrame, groups: dict) -> DataFrame:
    """rows: doc_id, text, value. word (binary), c0, c1 ...: its numbers of training tokens in each group; 0 where only held-out texts have it."""

    def counted(batches):
        import pyarrow as pa

        for whole in batches:
            for lo, hi, data, at in slices(whole, 1, 1 << 23):
                batch = whole.slice(lo, hi - lo)
                held = [is_held_out(x) for x in batch.column(0).to_pylist()]
                # Held-out texts are a group of their own, whose words count 0.
                own = np.array([GROUPS if h else groups.get(x, GROUPS - 1) for h, x in zip(held, batch.column(2).to_pylist(), strict=True)], np.int64)
                for a, b, part, place in parts_of(data, at):
                    index, first, word = indexed(part, place)
                    key = index * (GROUPS + 1) + np.repeat(own[a:b], np.diff(first))
                    c = np.bincount(key, minlength=(GROUPS + 1) * len(word)).reshape(-1, GROUPS + 1)
                    c[c[:, :GROUPS].any(axis=1), GROUPS] = 0
                    k, g = np.nonzero(c)
                    yield pa.record_batch([word.take(pa.array(k)), pa.array((g % GROUPS).astype(np.int32)), pa.array(np.where(g < GROUPS, c[k, g], 0))], ["word", "own", "c"])
                ends = np.bincount(own, minlength=GROUPS + 1)[:GROUPS]
                yield pa.record_batch([pa.array([END] * GROUPS, pa.binary()), pa.array(np.arange(GROUPS, dtype=np.int32)), pa.array(ends)], ["word", "own", "c"])

    found = rows.mapInArrow(counted, "word binary, own int, c long")
    return found.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("own") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(GROUPS)])


def _all():
    return sum((F.col(f"c{k}") for k in range(GROUPS)), F.lit(0))


def least_count(counts: DataFrame, most: int) -> int:
    """The least c such that no more than ``most`` rows of ``counts`` (c) have it or more; by counts of the rows at powers of 2 and, between two of them, at each eighth."""
    total, least = 0, None
    # A count and its three leading bits after the first: at most eight values for each power of 2.
    rounded = F.expr("CASE WHEN c > 0 THEN c - c % shiftleft(1L, greatest(0, CAST(floor(log2(c)) AS INT) - 3)) ELSE 0L END")
    for c, n in sorted(((r["c"], r["n"]) for r in counts.select(rounded.alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        total += n
        if total > most:
            return c + 1 if least is None else least
        least = c
    return 0 if least is None else least


def code_of(words: DataFrame, head: int = HEAD) -> Code:
    """The code of the most frequent words of a vocabulary."""
    short = words.select("*", _all().alias("c")).where((F.col("word") != F.lit(END)) & (F.octet_length("word") <= WORD_BYTES) & (F.col("c") >= 2))
    names = [f"c{k}" for k in range(GROUPS)]
    top = short.where(F.col("c") >= least_count(short.select("c"), head)).toArrow().to_pydict()
    counts = np.stack([np.array(top[c], np.int64) for c in names], axis=1) if top["word"] else np.zeros((0, GROUPS), np.int64)
    order = sorted(range(len(top["word"])), key=lambda k: (-top["c"][k], top["word"][k]))
    totals = words.agg(*[F.sum(c).alias(c) for c in names]).first()
    end = words.where(F.col("word") == F.lit(END)).select(*names).first() or [0] * GROUPS
    all_ = np.array([x or 0 for x in totals], np.int64)
    escape = all_ - np.array(list(end), np.int64) - counts.sum(axis=0)
    return Code([top["word"][k] for k in order], np.concatenate([np.array([list(end)], np.int64), escape[None], counts[order]]))


def _collected(parts: DataFrame, gates: int, inputs: int) -> dict:
    """parts: place, value. Added up in whole numbers."""
    out = np.zeros(gates * (inputs + 2) + 2 * gates * CELLS, np.int64)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return averaged(out, gates, inputs)


def _as_rows(parts: np.ndarray):
    import pyarrow as pa

    own = np.flatnonzero(parts)
    return pa.record_batch([pa.array(own.astype(np.int32)), pa.array(parts[own])], ["place", "value"])


def fit_spelling(words: DataFrame) -> dict:
    """The model of words (word, c) by their spelling."""
    spark = words.sparkSession
    n_words = words.count()
    bits = spell_bits(n_words)
    shards = max(1, n_words // SHARD_WORDS)
    # Shards follow the words' hashes, so each is a fair sample of all, and the same on any cluster. Words that begin alike stand together, for what
    # they share is taken once; beginnings are in order of a hash.
    dealt = words.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.substring("word", 1, 4)), "word")

    def counted(batches):
        for shard, own in _by_shard(batches):
            yield from _spell_counted(own, bits, shard)

    packed = tables_of(((r.block, r.counts) for r in summed(dealt.mapInArrow(counted, BLOCKS)).toLocalIterator()), [1 << b for b in bits])
    shared = spark.sparkContext.broadcast(_beside(packed))

    def learned(batches):
        for _, own in _by_shard(batches):
            yield _as_rows(_spell_learned(own, shared.value, bits))

    model = _collected(dealt.mapInArrow(learned, "place int, value long"), 8 * SPELL_GATES, len(ORDERS))
    shared.destroy()
    return model | {"stretch": [stretched(x) for x in packed]}


def _by_shard(batches) -> Iterator[tuple[int, Iterator]]:
    """Rows sorted by their last column, shard: each shard's number and its batches."""
    from itertools import chain, groupby

    def parts():
        for batch in batches:
            shard = batch.column(batch.num_columns - 1).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b > a:
                    yield int(shard[a]), batch.slice(a, b - a)

    for shard, own in groupby(parts(), key=lambda x: x[0]):
        first = next(own)[1]
        yield shard, chain([first], (x for _, x in own))


def fit_tokens(rows: DataFrame, code: Code, n_train: int) -> dict:
    """The model of the tokens of training texts. rows: doc_id, text."""
    spark = rows.sparkSession
    bits = token_bits(n_train)
    shards = max(1, n_train // SHARD_TOKENS)
    shared_code = spark.sparkContext.broadcast(code)

    def coded(batches):
        import pyarrow as pa
        import xxhash

        known = pa.array(shared_code.value.words, pa.binary())
        for whole in batches:
            for lo, hi, data, at in slices(whole, 1, 1 << 21):
                symbol, starts = tokens_of(data, at, known, False)
                ids, keys = [], []
                for doc_id, own in zip(whole.column(0).slice(lo, hi - lo).to_pylist(), np.split(symbol, starts[1:]), strict=True):
                    if not is_held_out(doc_id):
                        ids.append(packed_ids(own))
                        keys.append(xxhash.xxh3_64_intdigest(ids[-1], doc_id & 0xFFFFFFFF) - (1 << 63))
                keys = np.array(keys, np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(ids, pa.binary()), pa.array((keys % shards).astype(np.int32))], ["key", "ids", "shard"])

    dealt = cut(rows.select("doc_id", "text").mapInArrow(coded, "key long, ids binary, shard int"), "coded")

    def counted(batches):
        from pyspark import TaskContext

        yield from _token_counted(batches, shared_code.value, bits, TaskContext.get().partitionId())

    packed = tables_of(((r.block, r.counts) for r in summed(dealt.select("ids").mapInArrow(counted, BLOCKS)).toLocalIterator()), [1 << b for b in bits])
    shared = spark.sparkContext.broadcast(_beside(packed))

    def learned(batches):
        for _, own in _by_shard(batches):
            yield _as_rows(_token_learned(own, shared_code.value, shared.value, bits))

    # Shards and the order within them follow the texts' hashes, so they are the same on any cluster. Equal keys have equal ids.
    again = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key")
    model = _collected(again.mapInArrow(learned, "place int, value long"), TOKEN_GATES, TOKEN_INPUTS)
    shared.destroy()
    shared_code.destroy()
    return model | {"stretch": [stretched(x) for x in packed]}


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: str | None = "lang", head: int = HEAD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    The model and the base learn from the rows whose id's crc32 isn't a multiple of 10; ``group`` names the column whose values
    groups stand for (None: one group); only training rows' values are used. Null text is empty text, one end token. A null
    id is held out. Repeated rows get equal scores and count as often as they stand. Without any training text all counts
    are 0: the base then gives each token log10(0.1 / 0.1). An empty table gives none. bits_per_byte is null for an empty
    text. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    group = group if group in docs.columns else None
    value = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), value.alias("value"))
    words = cut(vocabulary(rows, groups_of(rows, "value" if group else None)), "vocabulary")
    total = words.agg(F.coalesce(F.sum(_all()), F.lit(0)), F.count(F.when(_all() > 0, 1))).first()
    n_train, n_distinct = int(total[0]), int(total[1])
    code = code_of(words, head)
    known = spark.createDataFrame([(w,) for w in [END, *code.words]], "word binary")
    rare = cut(words.select("word", _all().alias("c")).join(known, "word", "left_anti").sortWithinPartitions("word"), "rare")  # neighbours share their beginnings
    spelling = spark.sparkContext.broadcast(fit_spelling(rare.where("c > 0")))

    def spelled(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_pylist()
            cost = np.concatenate([word_scores(spelling.value, own[lo:hi]) for lo, hi in _batches_of_words(own, 1 << 18)]) if own else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cost)], ["word", "c", "cost"])

    costs = cut(rare.mapInArrow(spelled, "word binary, c long, cost double"), "word-scores")
    spelling.destroy()
    rows = rows.select("doc_id", "text")
    model = fit_tokens(rows, code, n_train)
    shared = spark.sparkContext.broadcast((code, model))
    schema = "doc_id long, hash long, word binary, times long, n_tokens long, n_bytes long, known long, base double, logp double"
    kinds = arrow_schema(schema)

    def parts(batches):
        import pyarrow as pa
        import xxhash

        code, model = shared.value
        known, counts = pa.array(code.words, pa.binary()), code.counts.sum(axis=1)
        base = np.log10(counts + 0.1)
        base[1], has = 0, counts > 0
        has[1] = False

        def lines(*columns):
            """Columns that aren't given are 0."""
            columns += (np.zeros(len(columns[0]), np.int64),) * (len(kinds) - len(columns))
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)

        def scored(held):
            *columns, symbol, starts = zip(*held, strict=True)
            shift = np.cumsum([0, *map(len, symbol[:-1])])
            score = token_scores(model, code, np.concatenate(symbol), np.concatenate([a + b for a, b in zip(starts, shift, strict=True)]))
            h = np.concatenate(columns[1])
            # The row's own line has a word that no vocabulary holds, another for each text.
            own = np.full((len(h), 9), ord(" "), np.uint8)
            own[:, 1:] = h.view(np.uint64).astype(">u8").view(np.uint8).reshape(len(h), 8)
            word = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.arange(0, 9 * len(h) + 1, 9, dtype=np.int32)), pa.py_buffer(own)])
            return lines(pa.concat_arrays(columns[0]), h, word, np.zeros(len(h), np.int64), *map(np.concatenate, columns[2:]), score)

        held, total = [], 0
        for whole in batches:
            for lo, hi, data, at in slices(whole, 1, 1 << 23):
                raw, doc_id = data.tobytes(), whole.column(0).slice(lo, hi - lo)
                h = (np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                symbol, starts, text, word, times = tokens_of(data, at, known)
                yield lines(doc_id.take(pa.array(text)), h[text], word, times)
                held.append((doc_id, h, np.diff(starts, append=len(symbol)), np.diff(at), np.add.reduceat(has[symbol].astype(np.int64), starts), np.add.reduceat(base[symbol], starts), symbol, starts))
                total += len(symbol)
                del raw, text, word, times
                if total >= SCORED:
                    yield scored(held)
                    held, total = [], 0
        if held:
            yield scored(held)

    lines = rows.mapInArrow(parts, schema)
    n, c = F.col("times"), F.coalesce("c", F.lit(0))
    # A partition's share of the different words is small beside its lines, which needn't be sorted.
    joined = lines.join(costs.hint("shuffle_hash"), "word", "left").select(
        "doc_id", "hash", "n_tokens", "n_bytes",
        (F.col("known") + F.when(c > 0, n).otherwise(0)).alias("known"),
        (F.col("base") + n * F.log10(c + 0.1)).alias("base"),
        (F.col("logp") + F.when(n > 0, n * F.col("cost")).otherwise(0.0)).alias("logp"),
    )
    # Rows that share id and text are summed together and told apart again by their number.
    own = joined.groupBy("doc_id", "hash").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_bytes", "known", "base", "logp")], F.count(F.when(F.col("n_tokens") > 0, 1)).alias("rows"))
    each = own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    per = {x: F.col(x) / F.col("rows") for x in ("n_tokens", "n_bytes", "known", "base", "logp")}
    tokens = per["n_tokens"].cast("long")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    floor = float(np.log10(n_train + 0.1 * (n_distinct + 1)))
    return each.select(
        "doc_id", held_out.alias("held_out"), tokens.alias("n_tokens"), per["known"].cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (per["base"] - tokens * floor).alias("base_score"), per["logp"].alias("score"), per["n_bytes"].cast("long").alias("n_bytes"),
        F.when(F.col("n_bytes") > 0, -F.col("logp") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


