"""Each operator against brute force or SQL on small tables that hold the odd cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import chunk_dedup, exact_dedup, licenses, lm_score, media, mixing, near_dup, packing, quality, registry, suffix_dedup
from loomgraph.llm.common import flat_bytes, slices, words

PROSE = "The river ran past the old mill and the people of the town came down to see it every morning before work began in the fields "


def prose(seed, n):
    rng = np.random.default_rng(seed)
    own = PROSE.split()
    return " ".join(own[k] for k in rng.integers(0, len(own), n)) + "."


def odd_rows():
    shared = prose(99, 80)
    rows = [(k, prose(k, 30 + 7 * k), "en" if k % 3 else "fr", f"s{k % 4}") for k in range(24)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, "  \n\t ", "en", "s1"), (33, "one", "en", "s2"), (None, prose(3, 51), "en", "s3"), (None, None, "en", "s3")]
    rows += [(40, prose(5, 65), "en", "s1"), (41, prose(5, 65), "en", "s1"), (41, prose(5, 65), "en", "s1"), (2, prose(2, 44), "en", "s2")]
    rows += [(50, prose(50, 40) + " " + shared, "en", "s0"), (51, shared + " " + prose(51, 60), "en", "s9"), (52, prose(52, 20) + " " + shared + " " + prose(53, 20), "de", "s9")]
    rows += [(60, "x" * 30_000, "en", "s0"), (61, prose(61, 5000), "en", "s0"), (62, "É" * 150 + " und " * 90, "de", "s5"), (63, "be " * 200, "en", "s0"), (64, "WOW!! " * 60, "en", "s1")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, digest string, score string, key string, unit string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "i", "d", "s", "y", "u") for r in odd_rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows):
    return Counter(tuple(r) for r in rows)


def texts():
    return [(r[0], r[1] or "") for r in odd_rows()]


def test_words_split_like_bytes():
    import pyarrow as pa

    column = pa.array([t for _, t in texts()] + [" a\x0bb ", "\x1c\x85 c"])
    data, at = flat_bytes(column)
    start, end, first = words(data, at)
    for k, t in enumerate(column.to_pylist()):
        assert [data[a:b].tobytes() for a, b in zip(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]])] == t.encode().split()
    parts = [(lo, hi) for lo, hi, _, _ in slices(pa.record_batch([column], ["t"]), 0, 5000)]
    assert parts[0][0] == 0 and parts[-1][1] == len(column) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_flat_bytes_of_sliced_arrays_with_nulls():
    import pyarrow as pa

    data, at = flat_bytes(pa.array(["ab", None, "ç", ""]).slice(1, 2))
    assert data.tobytes() == "ç".encode() and at.tolist() == [0, 0, 2]


def test_exact_groups(docs, none):
    want, groups = [], defaultdict(list)
    for i, t in texts():
        groups[t].append(i)
    for i, t in texts():
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert by_row(exact_dedup.exact_groups(docs).collect()) == by_row(want)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.without_repeats(none).columns == none.columns
    clashing = docs.withColumns({c: F.lit(c) for c in ("_sha", "_rows", "_keep_id", "_keep", "_shard", "_digest")})
    left = exact_dedup.without_repeats(clashing)
    assert left.columns == clashing.columns and all(r["_sha"] == "_sha" and r["_rows"] == "_rows" for r in left.collect()) and sorted(r["text"] or "" for r in left.collect()) == sorted(groups)


def test_history_removes_members_and_groups_the_rest(spark):
    old = spark.createDataFrame([(9, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "a"), (11, "c"), (12, "c"), (13, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(new, old).collect()}
    assert got == {10: (9, 2, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 1, True)}


def hexes_of(n, salt=""):
    return [hashlib.sha256(f"{salt}{k}".encode()).hexdigest() for k in range(n)]


def check_perfect(hexes, buckets):
    n = len(hexes)
    used, d0, d1, salt, slot = exact_dedup.displacements(hexes, buckets)
    assert sorted(slot.tolist()) == list(range(n))
    at = np.searchsorted(used, exact_dedup._pieces(hexes)[:, 0] % buckets)
    for k, x in enumerate(hexes):
        _, b, c = exact_dedup._pieces([x], int(salt[at[k]]))[0]
        assert (b % n + d0[at[k]] * (c % n) + d1[at[k]]) % n == slot[k]
    return salt


@pytest.mark.parametrize("n", [1, 2, 3, 100, 3000])
def test_hash_is_perfect_and_minimal(n):
    check_perfect(hexes_of(n), exact_dedup.BUCKETS)


def test_keys_that_agree_get_a_salt():
    """Two keys that agree in all that a bucket looks at; and very many small shards, of which some hold such keys."""
    pair = ["0" * 11 + "1" * 11 + "2" * 11 + "3" * 11 + end * 20 for end in "ab"]
    assert check_perfect(pair, 1).tolist() != [0]
    assert sum(bool(check_perfect(hexes_of(2, f"{k}-"), 1).any()) for k in range(2000)) > 100


def test_salted_seeds_are_looked_up(spark):
    """With one bucket for each shard of a few keys, salts are needed; every row must still find its group."""
    docs = spark.createDataFrame([(k, f"t{k % 60}") for k in range(120)], "doc_id long, text string")
    index = exact_dedup.build_index(docs, shard_keys=2, buckets=1)
    assert index["seeds"].where("salt > 0").count() > 0
    rows = docs.select("doc_id", exact_dedup.digest_of().alias("text_sha256"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.look_up(rows, index).collect()}
    assert got == {k: (k % 60 + 60, 2) for k in range(120)}


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_model(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union == 0 or len(sets[a] & sets[b]) / union >= similarity:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = defaultdict(list)
    for k in range(n):
        classes[find(k)].append(rows[k][0])
    return Counter((rows[k][0], min((i for i in classes[find(k)] if i is not None), default=None), links[k]) for k in range(n))


def near_rows():
    rows = texts()
    for k in range(40):
        own = prose(7, 120).split()
        for j in range(k % 5):
            own[(13 * k + 29 * j) % 120] = f"w{k}"
        rows.append((100 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("block, most_words", [(1024, 1 << 20), (4, 1 << 20), (1024, 300)])
def test_near_duplicates(spark, none, block, most_words):
    """In one unit, bucket by bucket, and in pairs of blocks."""
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, links string")
    got = near_dup.near_duplicates(docs, block=block, most_words=most_words)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == near_model(rows)
    assert near_dup.near_duplicates(none).count() == 0


def test_near_pairs_and_survivors(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = near_dup.near_duplicates(docs, pairs=True).collect()
    assert pairs and all(r["similarity"] >= 0.8 for r in pairs) and len({frozenset((r["v"], r["hub"])) for r in pairs}) == len(pairs)
    classes = {c for _, c, _ in near_model(rows)}
    left = near_dup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, classes))


def test_every_class_keeps_a_row_where_ids_are_null_or_repeated(spark):
    own = [prose(200 + k, 60) for k in range(6)]
    rows = [(None, t) for t in own[:3]] + [(None, own[0])] + [(7, t) for t in own[3:5]] + [(7, own[3]), (8, own[4]), (9, own[5])]
    left = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_row(left) == Counter([*((None, t) for t in own[:3]), (7, own[3]), (7, own[4]), (9, own[5])])


def test_survivors_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "x", "y", "z"), (3, "a b c d e f", "p", "q", "r")], "doc_id long, text string, _hash string, _id string, root string")
    assert [tuple(r) for r in near_dup.one_of_each(docs).collect()] == [(3, "a b c d e f", "p", "q", "r")]


def test_bands_reach_the_recall():
    bands, rows = near_dup.choose_bands(0.8, 0.999)
    assert rows > 1 and 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)
    assert near_dup.choose_bands(0.5, 0.9) != near_dup.choose_bands(0.9, 0.9)


def test_sets_take_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    whole = pa.record_batch([pa.array(range(5000)), pa.array([prose(k % 50, 60 + k % 7) * 4 for k in range(5000)])], ["doc_id", "text"])
    made = near_dup._sets_made(["doc_id"], 1, 18, 5, 5)
    tracemalloc.start()
    for _ in made([whole]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.nbytes > 1 << 22 and peak < 40 << 20
    few = whole.slice(3, 300)
    together = pa.Table.from_batches(made([few]))
    monkeypatch.setattr(near_dup, "TOGETHER", 1 << 12)
    apart = list(made([few]))
    assert len(apart) > 50 and pa.Table.from_batches(apart).combine_chunks().equals(together.combine_chunks())


def test_gram_sets_are_exact():
    texts_ = [prose(k, n).encode() for k, n in ((1, 0), (2, 3), (3, 40), (3, 41), (4, 5))] + [b"", b"One two"]
    sets = near_dup.gram_sets(texts_, 5)
    want = [shingles(t.decode()) for t in texts_]
    for a in range(len(sets)):
        for b in range(len(sets)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


def test_removed_bytes(spark, docs, none):
    rows = [t.encode() for _, t in texts()]
    places = Counter(b[k : k + 200] for b in rows for k in range(len(b) - 199))
    want = []
    for (i, _), b in zip(texts(), rows):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if places[b[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for most in (suffix_dedup.MOST, 2):
        assert by_row(suffix_dedup.remove_repeats(docs, most).drop("spans", "kept").collect()) == by_row(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in [*range(12), 100, 301]:
        for m in (2, 3, 50):
            s = rng.integers(1, m, n).astype(np.int64)
            assert suffix_dedup.suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_order_of_wide_keys(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDEST", 1)
    rng = np.random.default_rng(2)
    for n in (3, 4, 5, 100, 301):
        for m in (2, 50, 10**6):
            s = rng.integers(1, m, n).astype(np.int64)
            assert suffix_dedup.suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_sort_takes_little_memory():
    import tracemalloc

    contexts = [(prose(k % 50, 60) + prose(k, 60)).encode()[:300] for k in range(2000)]
    tracemalloc.start()
    suffix_dedup.repeated_windows(contexts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(map(len, contexts))


def test_mixing_equals_its_sql(docs, tmp_path):
    docs.select("doc_id", "text", "source").toPandas().to_parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM '{tmp_path}/d.parquet'")
    want = con.sql(mixing.OP6_SQL).fetchall()
    got = mixing.mix(docs).collect()
    assert by_row(got) == by_row(want)
    taken, targets, sizes = defaultdict(int), {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(t - n * target) <= n * 2 * mixing.BLOCK for (target, _), t in taken.items() for n in (round(t / target) if target else 0,))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixture_takes_what_the_mix_says(spark, docs):
    """With extra columns under names that the operators use themselves, null ids, and one id and text in two sources."""
    more = [(None, prose(500 + k, 30), f"s{k % 2}") for k in range(6)] + [(70, prose(70, 33), "s0"), (70, prose(70, 33), "s7")]
    docs = docs.select("doc_id", "text", "source", "n_chars").unionByName(spark.createDataFrame([(*r, 0) for r in more], "doc_id long, text string, source string, n_chars long"))
    for c in ("_id", "_size", "_hash", "_taken", "_n", "_take", "__taken", "rank", "shard"):
        docs = docs.withColumn(c, F.lit(c))
    sized = docs.withColumn("size", mixing.n_words())
    taken = Counter()
    for r in mixing._mixed(mixing._sized(docs, "doc_id", "text", "source"), mixing.WEIGHTS, mixing.MOST, mixing.BLOCK, mixing.SEED, mixing.SHARD_DOCS).collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    made = Counter()
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and sized.count() == docs.count()
    for r in out.collect():
        made[r["doc_id"], r["source"]] += len((r["text"] or "").encode().split())
        assert r["_taken"] == "_taken" and r["__taken"] == "__taken"
    assert +made == +taken


@pytest.mark.parametrize("seats", [0, 1, 3, 7, 50, 999])
def test_sainte_lague(spark, seats):
    votes = [5.5, 1.0, 1.0, 0.0, 12.25, 3.0]
    df = spark.createDataFrame([(0, k, v, seats) for k, v in enumerate(votes)], "g int, k int, votes double, seats long")
    got = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "k").collect()}
    want = Counter()
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[k] += 1
    assert got == {k: want[k] for k in range(len(votes))}


def test_packing_loses_no_word(docs, none):
    lengths = (16, 64, 256)
    packed = near_dup.cut(packing.pack_documents(docs, lengths, shard=40), "packed")
    got = packed.collect()
    covered = defaultdict(list)
    for r in got:
        assert r["used"] == sum(r["n_words"]) <= r["length"] and r["length"] in lengths
        assert all(x < r["used"] for x in lengths if x < r["length"])  # no shorter one would do
        for i, a, n in zip(r["doc_ids"], r["from_words"], r["n_words"]):
            covered[i] += range(a, a + n)
    want = defaultdict(list)
    for i, t in texts():
        want[i] += range(len(t.encode().split()))
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert packing.pack_documents(none).count() == 0
    # The sequences written out hold the words of every row, in their order within each piece.
    out = {r["seq_id"]: r["text"].split(" ") for r in packing.sequences(packed, docs).collect()}
    by_hash = {(r["doc_id"], r["h"]): (r["text"] or "").encode().split() for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    for r in got:
        words_ = [w for i, h, a, n in zip(r["doc_ids"], r["text_hashes"], r["from_words"], r["n_words"]) for w in by_hash[i, h][a : a + n]]
        assert [w.encode() for w in out[r["seq_id"]]] == words_ and len(words_) == r["used"]


def test_repeated_rows_are_dealt_to_many_shards(spark):
    same = spark.createDataFrame([(None, "a b c")] * 400, "doc_id long, text string")
    got = packing.pack_documents(same, (16, 64), shard=50).collect()
    assert sum(r["used"] for r in got) == 1200 and len({r["seq_id"].split("-")[0] for r in got}) == 8


def test_pack_fits_best():
    bins, length = packing.pack([60, 50, 40, 14, 4], (64, 128), 0)
    assert sum(length) <= 192 and bins[3] == bins[1]


def test_media_round_trip(docs, none):
    rows = media.media_table(docs).collect()
    want = Counter(i for i, _ in texts())
    assert Counter(r["doc_id"] for r in rows) == want
    by_text = defaultdict(set)
    for r in rows:
        payload, rate = media.from_wav(r["media"])
        own = payload[: r["n_bytes"]]
        assert rate == media.RATE and len(payload) % 576 == 0 and len(payload) == r["payload_bytes"] > 0 and set(payload[r["n_bytes"] :]) <= {255}
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        table = media.clips_from_arrow(r["clips"])
        assert r["clips_sha256"] == hashlib.sha256(r["clips"]).hexdigest() and all(0 <= x["start_s"] < x["end_s"] for x in r["segments"])
        assert table.schema.field("clip").type.shape == [media.CLIP, media.BANDS] and len(table) == -(-r["n_frames"] // media.CLIP)
        by_text[own].add((r["feature"], r["media_sha256"]))
    assert set(by_text) == {t.encode() for _, t in texts()} and all(len(v) == 1 for v in by_text.values())
    assert media.media_table(none, ("doc_id", "feature")).count() == 0


def test_resampling_keeps_a_low_tone():
    t = np.arange(8000) / 8000
    out = media.resampled(np.sin(2 * np.pi * 200 * t).astype(np.float32))
    power = np.abs(np.fft.rfft(out[100:5100] * np.hanning(5000)))
    assert len(out) == 6000 and abs(int(power.argmax()) * 6000 / 5000 - 200) < 3


def test_hysteresis_holds_between_thresholds():
    mel = np.zeros((9, media.BANDS), np.float32)
    mel[2], mel[3], mel[6] = 2.0, 0.05, -3.0
    assert media.segments(mel)[0][0] == 2


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def test_license_base_places(spark, docs, none):
    more = ["MIT License, mit-license; Apache\nLICENSE 2.0", "cc by cc by-sa GNU General Public License v3", "xmit license mit licenses", "ÉMIT license MIT-License"]
    rows = texts() + [(900 + k, t) for k, t in enumerate(more)]
    table = docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(900 + k, t, "") for k, t in enumerate(more)], "doc_id long, text string, kept string"))
    got = defaultdict(list)
    for r in licenses.scan_licenses(table).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((k, label) for label, p in PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split())
        want = (len(own), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert want in [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[i]]
        for r in got[i]:
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("text, first", [
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0:declaration"), ("Licensed under the Apache License, Version 2.0", "apache-2.0:notice"),
    ("see http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0:address"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit:clause-0"),
])
def test_license_rules_suppress_what_they_contain(text, first):
    s = licenses.Scanner()
    found = s.scan(text.encode())["detections"]
    assert [s.rules[k].name for _, _, k in found] == [first]


def test_license_rules_are_hundreds_of_patterns():
    """Most of the notices match a text made of themselves, and every rule's keyword stands in what it matches."""
    assert len({r.pattern for r in licenses.rules()}) > 400 and sum("clause" in r.name for r in licenses.rules()) > 150
    plain = [r for r in licenses.rules() if "clause" in r.name and re.fullmatch(r"[a-z0-9 ]+", re.sub(r"\(\?:[^()]*\)\?", "", r.pattern).replace("licen[sc]e", "license").replace("  ", " ").strip())]
    scanner = licenses.Scanner()
    for r in plain:
        text = " ".join(re.sub(r"\(\?:[^()]*\)\?", "", r.pattern).replace("licen[sc]e", "license").split())
        if re.fullmatch(r.pattern, text):
            assert r.keyword in text, r
            assert scanner.scan(text.encode())["detections"], r
    assert len(plain) > 80


def test_license_scan_is_linear_in_the_text():
    import time

    scanner, took = licenses.Scanner(), []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        assert len(scanner.scan(b"the mit license " * n)["base"]) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_lm_scores(spark, docs, none):
    rows = texts()
    got = defaultdict(list)
    for r in lm_score.score(docs, head=50).collect():
        got[r["doc_id"]].append(r)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter()
    tokens = {(i, t): t.encode().lower().split() + [b" "] for i, t in rows}
    for i, t in rows:
        if not held(i):
            count.update(tokens[i, t])
    n, v = sum(count.values()), len(count)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i, t])
        assert any(r["n_tokens"] == len(tokens[i, t]) and r["n_known"] == sum(count[w] > 0 for w in tokens[i, t]) and r["train_tokens"] == n and r["held_out"] == held(i) and abs(r["base_score"] - base) < 1e-6 for r in got[i])
        assert all(r["score"] < 0 for r in got[i])
    assert lm_score.score(none).count() == 0


def lm_model(words, ids):
    """A code of the words and the model of their sequences (lists of ids), all in memory."""
    import pyarrow as pa

    counts = np.zeros((len(words) + 2, lm_score.GROUPS), np.int64)
    for k, own in enumerate(ids):
        np.add.at(counts, (own, k % 2), 1)
    code = lm_score.Code(words, counts)
    bits = lm_score.token_bits(1)
    batch = pa.record_batch([pa.array([lm_score.packed_ids(np.array(x, np.int32)) for x in ids], pa.binary())], ["ids"])
    blocks = [(r["block"][0].as_py(), r["counts"][0].as_py()) for r in lm_score._token_counted([batch], code, bits, 0)]
    packed = lm_score.tables_of(blocks, [1 << b for b in bits])
    parts = lm_score._token_learned([batch], code, packed, bits)
    return code, lm_score.averaged(parts, lm_score.TOKEN_GATES, lm_score.TOKEN_INPUTS) | {"stretch": [lm_score.stretched(x) for x in packed]}


def test_lm_tokens_are_a_distribution_that_depends_on_order():
    """After any tokens the probabilities of all symbols sum to one."""
    words = [b"the", b"cat", b"sat", b"mat", b"on"]
    code, model = lm_model(words, [[2, 3, 4, 6, 2, 5, 0], [2, 5, 4, 0], [2, 3, 4, 0], [1, 3, 0]] * 50)
    for before in ([], [2], [2, 3], [1, 4], [2, 3, 4, 6]):
        two = [np.array([*before, s], np.int32) for s in range(code.n)]
        starts = np.cumsum([0, *map(len, two[:-1])])
        scores = lm_score.token_scores(model, code, np.concatenate(two), starts)
        first = lm_score.token_scores(model, code, np.array(before, np.int32), np.array([0])) if before else 0
        assert abs((10 ** (scores - first)).sum() - 1) < 1e-3
    one = lambda *ids: lm_score.token_scores(model, code, np.array(ids, np.int32), np.array([0]))[0]
    assert one(2, 3, 4, 6, 2, 5, 0) > one(5, 2, 6, 4, 3, 2, 0) + 1


def test_lm_contexts_do_not_depend_on_windows():
    """A text's contexts are its own, in whatever company and however many windows it takes."""
    rng = np.random.default_rng(0)
    code, _ = lm_model([b"a", b"b", b"c"], [[2, 3, 0], [4, 4, 0]])
    texts_ = [rng.integers(0, 5, n).astype(np.int32) for n in (5, 70_000, 1, 140_000, 3)]
    starts = np.cumsum([0, *map(len, texts_[:-1])])
    groups = lm_score.token_groups(code, np.concatenate(texts_), starts)
    for a, t in zip(starts.tolist(), texts_):
        assert (groups[a : a + len(t)] == lm_score.token_groups(code, t, np.array([0]))).all()
    group, before, own, many, place = lm_score.distinct(code, np.concatenate(texts_), starts)
    assert many.sum() == len(place) == starts[-1] + 3 and (own[place] == np.concatenate(texts_)).all() and (group[place] == groups).all() and (before[place][starts] == code.n).all()
    counts = rng.integers(0, 3, 1000) * rng.integers(0, 1000, 1000)
    assert (lm_score.expanded(lm_score.compressed(counts)) == counts).all()
    ids = np.array([0, 1, 65_535, 65_536, 99_999], np.int32)
    assert (lm_score.unpacked_ids(np.frombuffer(lm_score.packed_ids(ids), np.uint8)) == ids).all()


def test_lm_spelling_is_a_distribution():
    """After any prefix the probabilities of all bytes sum to one, so those of words do not exceed it."""
    import pyarrow as pa

    known, bits = pa.record_batch([pa.array([b"abc", b"abd"], pa.binary()), pa.array([5, 2])], ["word", "c"]), lm_score.spell_bits(2)
    packed = lm_score.tables_of([(r["block"][0].as_py(), r["counts"][0].as_py()) for r in lm_score._spell_counted([known], bits, 0)], [1 << b for b in bits])
    parts = lm_score._spell_learned([known], packed, bits)
    model = lm_score.averaged(parts, 8 * lm_score.SPELL_GATES, len(lm_score.ORDERS)) | {"stretch": [lm_score.stretched(x) for x in packed]}
    one = [bytes([a]) for a in range(256) if a not in b" \t\n\r\x0b\x0c"]
    total = sum(10**x for x in lm_score.word_scores(model, one))
    assert 0 < total <= 1 + 1e-3
    s = lm_score.word_scores(model, [b"abc", b"abd", b"zzz"])
    assert s[0] > s[2] and s[1] > s[2]


def test_lm_bits_that_neighbours_share_are_scored_once():
    rng = np.random.default_rng(1)
    words = [b"w%d" % k for k in range(300)]
    ids = [[*(rng.zipf(1.3, 40) % 301 + 1).tolist(), 0] for _ in range(200)]
    code, model = lm_model(words, ids)
    symbol, starts = np.concatenate(ids).astype(np.int32), np.cumsum([0, *map(len, ids[:-1])])
    group, before, own, many, place = lm_score.distinct(code, symbol, starts)
    contexts, shared, bits = lm_score.contexts_of(code, group, before), lm_score.shared_bits(code, group, before, own), lm_score.token_bits(1)
    first, token, at, hit, slots, wide = lm_score.events(code, own, shared, contexts, bits)
    alone = lm_score.events(code, own, np.zeros_like(shared), contexts, bits)
    assert len(alone[2]) == code.length[own].sum() and len(at) < 0.8 * len(alone[2])
    # A bit's cost and how often it stands come out as if each token had its own.
    cost = rng.random(1 << bits[0])
    assert np.allclose(lm_score._totals(cost[slots[1]], first, wide), lm_score._totals(cost[alone[4][1]], alone[0], alone[5]))
    times = lambda e: np.bincount(2 * e[4][1] + e[3], lm_score._held(many, e[1], e[5]), 2 << bits[0])
    assert (times((first, token, at, hit, slots, wide)) == times(alone)).all()
    assert np.allclose(lm_score.token_scores(model, code, symbol, starts), [lm_score.token_scores(model, code, np.array(x, np.int32), np.array([0]))[0] for x in ids], atol=1e-4)


def test_lm_tokens_of_many_texts_at_once(monkeypatch):
    import pyarrow as pa

    texts_ = [b"The cat\x0bsat", b"", b" \t", "CAT \u00c9cole\u00a0x the dog dog".encode(), b"cat"]
    known = pa.array([b"the", b"cat"], pa.binary())
    place = {b"the": 2, b"cat": 3}
    data, at = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, *map(len, texts_)])
    symbol, starts, text, word, times = lm_score.tokens_of(data, at, known)
    assert [x.tolist() for x in np.split(symbol, starts[1:])] == [[*(place.get(w, 1) for w in t.lower().split()), 0] for t in texts_]
    rare = {(k, w): c for k, t in enumerate(texts_) for w, c in Counter(t.lower().split()).items() if w not in place}
    assert dict(zip(zip(text.tolist(), word.to_pylist()), times.tolist())) == rare
    one = np.frombuffer(b" ".join(texts_), np.uint8)
    whole = lm_score.tokens_of(one, np.array([0, len(one)]), known)
    monkeypatch.setattr(lm_score, "LONG", 8)
    parts = lm_score.tokens_of(one, np.array([0, len(one)]), known)
    assert (whole[0] == parts[0]).all() and dict(zip(whole[3].to_pylist(), whole[4].tolist())) == dict(zip(parts[3].to_pylist(), parts[4].tolist()))


def test_lm_sorts_keys_with_their_places():
    """Contexts are sorted as whole numbers with their places in the lowest bits, by places where that doesn't fit; both alike."""
    rng = np.random.default_rng(2)
    key = rng.integers(0, 300, 5000).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    for bits in (9, 60):
        got, place = lm_score._in_order(key.copy(), bits)
        assert (got == key[order]).all() and (place == order).all()
    assert lm_score._in_order(np.array([7], np.uint64), 3)[1].tolist() == [0]
    assert len(set(lm_score._scattered(np.arange(1 << 12, dtype=np.uint64), 12).tolist())) == 1 << 12


def test_lm_spelling_hashes_a_page_once():
    """The bits of a half byte stand in one page of 16 slots, and each place of the tree has a slot of its own."""
    s = lm_score.Spelling([bytes([a]) for a in range(33, 127)])
    seen = {}
    for bit, hit, slots in s.slots(lm_score.spell_bits(100)):
        assert (hit == s.data >> bit & 1).all()
        for k, slot in enumerate(slots):
            seen.setdefault((k, bit // 4), []).append(slot)
    for rows in seen.values():
        assert len(rows) == 4 and all((r >> 4 == rows[0] >> 4).all() for r in rows)
        assert all(((r & 15) >> k == 1).all() for k, r in enumerate(rows))


def test_lm_words_beside_white_space():
    texts_ = [b"", b" ", b" a", b"a ", b"\x0b a\t\tB\r\n", "a\u00a0b \u2003".encode(), b"a"]
    data, at = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, *map(len, texts_)])
    index, first, words = lm_score.indexed(data, at)
    words = words.to_pylist()
    assert b"" not in words and [[words[k] for k in index[a:b]] for a, b in zip(first, first[1:])] == [t.lower().split() for t in texts_]
    import pyarrow as pa

    known = pa.array([b"a"], pa.binary())
    with_rare, alone = lm_score.tokens_of(data, at, known), lm_score.tokens_of(data, at, known, False)
    assert len(alone) == 2 and all((x == y).all() for x, y in zip(with_rare, alone))


def test_lm_pieces_of_long_texts():
    raw = ("ab  c\n" * 1000 + "x" * 5000 + " y").encode()
    assert b"".join(lm_score.pieces_of(raw, 100)) == raw and [w for p in lm_score.pieces_of(raw, 100) for w in p.split()] == raw.split()


def test_lm_sums_blocks_in_several_steps(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN_IN", 3)
    one = lm_score.compressed(np.array([1, 300]))
    blocks = spark.createDataFrame([(k % 2, k, one) for k in range(40)], "block int, part long, counts binary")
    got = {r["block"]: lm_score.expanded(r["counts"]).tolist() for r in lm_score.summed(blocks).collect()}
    assert got == {0: [20, 6000], 1: [20, 6000]}


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    one = {(r["doc_id"], r["n_bytes"], r["score"]) for r in lm_score.score(docs.coalesce(1), head=50).collect()}
    other = {(r["doc_id"], r["n_bytes"], r["score"]) for r in lm_score.score(docs.repartition(7), head=50).collect()}
    assert {(i, n, round(s, 6)) for i, n, s in one} == {(i, n, round(s, 6)) for i, n, s in other}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_lm_beats_the_base_on_held_out_texts(spark):
    rows = registry.QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_quality(spark, docs, none):
    out = quality.judge(docs)
    assert set(docs.columns) - {"score"} <= set(out.columns) and out.count() == len(odd_rows())
    assert quality.judge(none).count() == 0
    mine = docs.withColumns({c: F.lit(c) for c in ("votes", "posterior", "score", "accepted", "_accepted")})
    left = corpus_pipeline.quality_stage(spark, mine, "")
    assert left.columns == mine.columns and 0 < left.count() < len(odd_rows()) and all(r["score"] == "score" and r["accepted"] == "accepted" for r in left.collect())


def test_quality_against_labels(spark, sf):
    got = registry.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["accepted"] for r in good) >= 0.98 * len(good) and sum(not r["accepted"] for r in bad) >= 0.9 * len(bad)


def test_quality_estimates_rates():
    """Labellers that err at known rates: the estimates come near, and the posteriors tell the classes apart."""
    rng = np.random.default_rng(0)
    patterns, truth = Counter(), Counter()
    for _ in range(20_000):
        good, v = rng.random() < 0.8, 0
        for j in range(len(quality.LABELLERS)):
            v += 3**j * int(rng.random() < (0.02 if good else 0.5))
        patterns[v] += 1
        truth[v, good] += 1
    known, rates = quality.posteriors(dict(patterns))
    assert abs(rates[:, 0, 1].mean() - 0.5) < 0.1 and rates[:, 1, 1].mean() < 0.05
    right = sum(n for (v, good), n in truth.items() if (known[v] > 0.5) == good)
    assert right > 0.97 * 20_000


def test_chunks_resist_insertions():
    rng = np.random.default_rng(5)
    a = rng.integers(97, 123, 5000).astype(np.uint8)
    b = np.concatenate([a[:1000], np.frombuffer(b"inserted", np.uint8), a[1000:]])
    cut = lambda x: {x[p:q].tobytes() for p, q in zip([0, *chunk_dedup.boundaries(x, np.array([0, len(x)]))[0]], chunk_dedup.boundaries(x, np.array([0, len(x)]))[0])}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 4


def test_chunk_dedup_equals_a_model(spark, docs, none):
    import xxhash

    # Unrelated texts under one id and under none, and copies of them.
    more = [(7, prose(400, 200)), (7, prose(401, 200) + prose(400, 200)), (None, prose(402, 150)), (None, prose(402, 150)), (None, prose(402, 150) + " " + prose(403, 150))]
    docs = docs.select("doc_id", "text", "digest").unionByName(spark.createDataFrame([(*r, "d") for r in more], "doc_id long, text string, digest string"))
    rows = sorted(texts() + more, key=lambda r: (r[0] if r[0] is not None else 1 << 63, xxhash.xxh3_64_intdigest(r[1].encode())))
    places, found, earlier, want = defaultdict(list), [], Counter(), Counter()
    for n, (_, t) in enumerate(rows):
        data = np.frombuffer(t.encode(), np.uint8)
        ends = chunk_dedup.boundaries(data, np.array([0, len(data)]))[0]
        found.append(list(zip([0, *ends], ends)))
        for a, b in found[n]:
            places[t.encode()[a:b]].append((n, a))
    for n, (i, t) in enumerate(rows):
        data = t.encode()
        repeated = [(a, b) for a, b in found[n] if len(places[data[a:b]]) > 1]
        gone = sum(b - a for a, b in repeated if earlier[i, t] or min(places[data[a:b]]) != (n, a))
        earlier[i, t] += 1
        want[i, len(data), len(found[n]), sum(b - a for a, b in repeated), gone] += 1
    out = chunk_dedup.chunk_dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_chunks"], r["n_repeated"], r["n_removed"]) for r in out) == want
    assert all(r["n_removed"] == sum(x["to_byte"] - x["from_byte"] for x in r["spans"]) and r["n_spans"] == len(r["spans"]) for r in out)
    assert chunk_dedup.chunk_dedup(none).count() == 0
    assert chunk_dedup.without_repeats(["aéb"], [[(0, 2)]]) == ["b"]


def test_passages_of_over_fifty_words_go(spark):
    rows = []
    for k in range(60):
        rng = np.random.default_rng(300 + k)
        own, shared, other = (" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n)) for n in (60, 51, 60))
        rows += [(2 * k, own + " " + shared), (2 * k + 1, shared + " " + other)]
    later = [r for r in chunk_dedup.chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] % 2]
    assert all(r["n_removed"] == r["n_repeated"] for r in later)
    assert sum(r["n_removed"] > 0 for r in later) >= 58


def test_pipeline(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = near_dup.cut(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.toPandas())
    bad = [i for i in kept[0].doc_id if labels.get(i) == 0]
    assert len(bad) <= 0.1 * sum(v == 0 for v in labels.values())
    assert kept[1].text.is_unique and set(kept[1].text) == set(kept[0].text)
    classes = near_model(list(zip(kept[1].doc_id, kept[1].text)))
    assert sorted(kept[2].doc_id) == sorted({c for _, c, _ in classes})
    mixed = near_dup.cut(corpus_pipeline.STAGES[3][1](spark, docs, sf), "mixed")
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    assert sum(r["used"] for r in packed) == sum(len((r["text"] or "").encode().split()) for r in mixed.collect())


def test_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]
