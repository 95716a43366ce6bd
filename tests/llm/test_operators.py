"""Each operator against a brute-force version, an exact round trip or held-out
accuracy, and on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from itertools import permutations, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import bpe, common, components, langid, lm, media, mixing, quality, simhash, token_files, topk, toxicity
from jisfold.llm.pretokens import chunks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "One two", "a b c d e", "a b c d e", "a b c d f", "é 日本 😀 <|endoftext|> x", LONG, LONG, "\x00 \x1c y"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, FP string, token_ids int"


def odd_documents(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2"][i % 3], None, -1.0, "x", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here", "en", "s1", 1, 0.0, "y", 1), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


# 1 SimHash


def brute_fingerprint(text, k):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint((t or "").encode(), 4) == brute_fingerprint(t, 4)


def brute_components(values, radius):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_shards_find_all_links(spark, monkeypatch):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(25)]
    values = list({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(12)} | {0, 1})
    expected = brute_components(values, 4)
    monkeypatch.setattr(simhash, "SHARD", 16)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = components.components(simhash.links(nodes, 4)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    want = {}
    for v, g in expected.items():
        want.setdefault(g, set()).add(signed(v))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_block_plans_are_complete():
    rnd = random.Random(0)
    for n in (10, 10**8, 10**11):
        masks = [m % (1 << 64) for m in simhash.block_plan(n, 4)]
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a ^ sum(1 << x for x in rnd.sample(range(64), 4))
            assert any(a & m == b & m for m in masks)


def test_tree_search():
    rng = np.random.default_rng(1)
    for shape in ((500,), (300, 3)):
        values = rng.integers(0, 1 << 63, shape, dtype=np.uint64)
        values[::7] = values[0] ^ np.uint64(5)
        values = np.unique(values, axis=0)
        bits = np.bitwise_count(values[:, None] ^ values[None])
        expected = set(zip(*np.nonzero((bits if len(shape) == 1 else bits.sum(-1)) <= 60), strict=True))
        found = {(a, b) for q, v in simhash.BKTree(values).search(values, 60) for a, b in zip(q, v, strict=True)}
        assert found == expected


def test_tree_follows_few_edges():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    tree = simhash.BKTree(values)
    found = {(a, b) for q, v in tree.search(values[:300], 4) for a, b in zip(q.tolist(), v.tolist(), strict=True)}
    assert {(i, i) for i in range(300)} <= found
    assert tree.visits < 0.25 * 300 * len(values)


def test_near_duplicates_of_odd_documents(spark):
    rows = simhash.near_duplicates(odd_documents(spark), 4, 4).collect()
    assert len(rows) == odd_documents(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, []).append(r)
    assert min(r.doc_id for r in by["0" * 16] if r.doc_id is not None) == 0
    assert {r.component_id for r in by["0" * 16]} == {0}
    assert {r.component_id for r in rows if r.doc_id in (9, 10)} == {9}
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    kept = simhash.dedup(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids[0] == 0 and 1 not in ids and 9 in ids and 10 not in ids and ids.count(5) == 1 and 6 not in ids and ids[-1] is None
    assert simhash.dedup(empty(spark)).count() == 0
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(300)]
    other = [f"w{rnd.randint(0, 9999)}" for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base[:150] + other[:150]))], "doc_id long, text string")
    assert {r.doc_id for r in simhash.dedup(df).collect()} == {1, 3, 4}
    clashing = df.selectExpr("doc_id", "text", "1 as row", "2 as node", "3 as fp", "4 as keys", "5 as component", "6 as doc", "7 as least")
    kept = simhash.dedup(clashing)
    assert kept.columns == clashing.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [(1, 2, 3, 4, 5, 6, 7)] * 3


def test_dedup_counts_a_repeated_passage_once(spark):
    rnd = random.Random(3)
    line = " ".join(f"menu{i}" for i in range(10))
    texts = [" ".join([line] * 20 + [f"w{rnd.randint(0, 10**9)}" for _ in range(200)]) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.dedup(df).collect()} == set(range(6))


def test_dedup_decides_at_the_similarity_itself(spark):
    rnd = random.Random(9)
    rows, kept = [], set()
    for k in range(300):
        # distinct words: n shingles, and m of them in the shorter text
        n, m = rnd.choice([(5, 4), (10, 8), (100, 80), (4, 3), (9, 7), (100, 79)])
        words = [f"w{rnd.randint(0, 10**12)}" for _ in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: m + 4]))]
        kept |= {2 * k} if 5 * m >= 4 * n else {2 * k, 2 * k + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.dedup(df).collect()} == kept


def test_sketches_shuffle_once(spark):
    nodes = spark.createDataFrame([(bytes(80),)], "fp binary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = simhash.sketch_links(nodes, 10, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one for the sizes of shards, one for the fingerprints
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_dedup_leaves_texts_where_they_are(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} and more of them") for i in range(200)], "doc_id long, text string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.dedup(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
        assert kept.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


@pytest.mark.parametrize("most", [8192, 0])
def test_rows_by_number(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BITMAPS", most)
    wanted = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 1 << 33, (1 << 33) + 8, (5 << 33) + 40000]
    near = sorted({n + d for n in wanted for d in (-9, -8, -1, 0, 1, 8, 9) if n + d >= 0})
    held = spark.createDataFrame([(f"d{n}", n) for n in near], "doc string, row long")
    numbers = spark.createDataFrame([(n,) for n in [*wanted, *wanted[:3], 1 << 40]], "row long")
    found = simhash.rows_numbered(held, numbers)
    assert found.columns == ["doc", "row"]
    assert sorted((r.row, r.doc) for r in found.collect()) == [(n, f"d{n}") for n in wanted]
    assert simhash.rows_numbered(held, numbers.where("row < 0")).count() == 0


def test_components_are_split_by_bytes(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{rnd.randint(0, 10**9)}" for _ in range(400)]
    rows = [(i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in range(0, 400, 10)]
    df = spark.createDataFrame([*rows, (1000, "a text of its own with no near one")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "PART_BYTES", 20_000)
    members = df.selectExpr("1L as component", "doc_id as node", "text", "octet_length(text) as size")
    met = {}
    for r in simhash.component_parts(members).collect():
        met.setdefault((r.low, r.high), []).append(r)
    assert max(sum(len(r.text) for r in x) for x in met.values()) < 2 * 2 * 20_000 < sum(len(t) for _, t in rows)
    pairs = {(a.node, b.node) for x in met.values() for a in x for b in x}
    assert len(pairs) == 41 * 41
    assert {r.doc_id for r in simhash.dedup(df).collect()} == {0, 1000}


def test_set_links_connect_as_all_pairs_do(spark):
    rnd = random.Random(8)
    for _ in range(50):
        base = [rnd.sample(range(60), 20) for _ in range(3)]
        sets = [np.unique(np.array(rnd.choice(base)[: rnd.randint(14, 20)] + rnd.sample(range(60), rnd.randint(0, 4)), np.uint64)) for _ in range(25)]

        def groups(links, n=len(sets)):
            label = list(range(n))
            for a, b in links:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(i for i in range(n) if label[i] == x) for x in label}

        own = [set(x.tolist()) for x in sets]
        pairs = [(i, j) for i in range(25) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
        assert groups(zip(*simhash.set_links(sets, 0.8), strict=True)) == groups(pairs)


# 2 mixing


def test_targets_stop_at_the_cap():
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 8)
        sizes, weights = [rnd.randint(0, 100) for _ in range(n)], [rnd.choice([5, 2, 1]) for _ in range(n)]
        out = mixing.capped_targets(sizes, weights, sum(sizes), 3)
        assert all(t <= 3 * s + 1e-9 for t, s in zip(out, sizes, strict=True))
        assert math.isclose(sum(out), sum(sizes), abs_tol=1e-6)
        free = [t / w for t, s, w in zip(out, sizes, weights, strict=True) if t < 3 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def test_flow_is_largest_and_cheapest():
    rnd = random.Random(4)
    for _ in range(60):
        p, s = rnd.randint(1, 3), rnd.randint(1, 2)
        capacity = [rnd.randint(0, 2) for _ in range(p)]
        members = [rnd.sample(range(s), rnd.randint(1, s)) for _ in range(p)]
        quota = [rnd.randint(0, 4) for _ in range(s)]
        costs = [0, 1, 4]
        arcs = [(i, j) for i in range(p) for j in members[i]]

        def price(used, cap):
            return sum(costs[min(k // cap, 2)] for k in range(used)) if cap else 0

        best = None
        for flow in product(range(5), repeat=len(arcs)):
            out = [sum(f for f, a in zip(flow, arcs, strict=True) if a[0] == i) for i in range(p)]
            into = [sum(f for f, a in zip(flow, arcs, strict=True) if a[1] == j) for j in range(s)]
            if all(o <= 3 * c for o, c in zip(out, capacity, strict=True)) and all(x <= y for x, y in zip(into, quota, strict=True)):
                key = (-sum(flow), sum(price(o, c) for o, c in zip(out, capacity, strict=True)))
                best = min(best or key, key)
        found = mixing.separate_flows(capacity, members, quota, costs)
        out = [sum(f for (i, _), f in found.items() if i == k) for k in range(p)]
        assert (-sum(found.values()), sum(price(o, c) for o, c in zip(out, capacity, strict=True))) == best


def test_mix_of_odd_and_overlapping_documents(spark):
    taken, plan = mixing.mix(odd_documents(spark), F.array("source"))
    rows = taken.collect()
    assert len(rows) == odd_documents(spark).count()
    assert {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    assert list(plan["sources"]) == ["ss1", "ss2", "~"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_documents(spark), F.array("source"))[0].collect()))
    assert mixing.mix(empty(spark), F.array("source"))[0].count() == 0
    both = spark.createDataFrame([(i, "w " * (1 + i % 7), ["a"] if i % 3 else ["a", "b"]) for i in range(300)], "doc_id long, text string, s array<string>")
    taken, plan = mixing.mix(both, F.col("s"), weights=(1, 3))
    total = sum(r.taken for r in taken.collect())
    assert abs(total - sum(x["take"] for x in plan["patterns"].values())) <= 2
    assert mixing.mixed_documents(both, F.col("s"), weights=(1, 3)).columns == both.columns


def test_equal_rows_are_taken_one_by_one(spark):
    rows = [(1, "a b c", "x")] * 6 + [(10 + i, "w " * 10, "y") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, plan = mixing.mix(docs, F.array("source"), weights=(3, 1))
    found = taken.groupBy("pattern").agg(F.sum("taken").alias("n"), F.count("*").alias("rows")).collect()
    for r in found:
        target = plan["sources"][r.pattern[0]]["target"]
        assert r.rows == 6 and target - (3 if r.pattern[0] == "sx" else 10) < r.n <= target + 0.5
    clashing = docs.selectExpr("doc_id", "text", "source", "1 as copies", "2 as tie", "3 as id", "4 as doc")
    assert mixing.mixed_documents(clashing, F.array("source")).columns == clashing.columns


def test_mixed_documents_go_on_after_one_that_does_not_fit(spark):
    rnd = random.Random(5)
    rows = [(1000 * s + i, "w " * (900 if i % 20 == 0 else rnd.randint(5, 60)), f"s{s}") for s in range(8) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, source string")
    _, plan = mixing.mix(docs, F.array("source"))
    got = mixing.mixed_documents(docs, F.array("source")).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r["count"] for r in got}
    for name, p in plan["patterns"].items():
        own = [(i, len(t.split())) for i, t, s in [*rows, *rows[:3]] if name == (f"s{s}",)]
        whole, once = p["take"] // p["words"], {i for i, _ in own}
        repeated = {i: sum(i == j for j, _ in own) for i in once}
        extra = {i for i in once if copies.get(i, 0) // repeated[i] > whole}
        short = p["take"] % p["words"] - sum(n for i, n in own if i in extra)
        left = [n * repeated[i] for i, n in own if i not in extra]
        assert short >= 0 and (not left or short < min(left)), (name, short, min(left))


# 3 BPE


def test_bpe_equals_the_library(library):
    coder, decoder = bpe.ByteBPE(VOCABULARY), bpe.Decoder(VOCABULARY)
    rnd = random.Random(7)
    some = ["a", "e", "th", "the", " ", "  ", "\n", "\t", "1", "<|endoftext|>", "'s", "'ll", "é", "日本", "😀", "　", "\x85", "\x1c", "!!", "aaaa", " ", "\x00", "²", "\r\n", "́"]
    for text in [t or "" for t in TEXTS] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        mine = coder.encode(pa.array([text]))[0]
        assert np.frombuffer(mine, "<u4").tolist() == ids, text
        assert decoder.decode(mine) == library.decode(ids, skip_special_tokens=False) == text
        assert "".join(chunks(text)) == text


def test_bpe_columns(spark):
    rows = bpe.bpe_decode(bpe.bpe_encode(odd_documents(spark), VOCABULARY), VOCABULARY)
    assert rows.schema["token_ids"].dataType == T.BinaryType()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.token_ids) // 4 for r in rows.collect())
    again = bpe.bpe_round_trip(odd_documents(spark), VOCABULARY)
    assert again.columns == rows.columns and sorted(map(repr, again.collect())) == sorted(map(repr, rows.collect()))
    assert bpe.bpe_encode(empty(spark), VOCABULARY).count() == 0


# 4 quality, 8 toxicity


def labelled(spark, n=400):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        w = [rnd.choice("the of and with from house tree river stone light".split()) + rnd.choice(["", ".", ","]) for _ in range(rnd.randint(30, 120))]
        if bad:
            w = [x + "$$$" for x in w]
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["vile", "rotten", "foul"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_machine_score_has_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    index, x = np.array([3, 70, 900]), np.array([0.5, -1.0, 2.0])
    pairs = sum(x[a] * x[b] * (m.factors[index[a]] @ m.factors[index[b]]) for a, b in permutations(range(3), 2)) / 2
    assert math.isclose(m.score(index, x), 0.3 + x @ m.linear[index] + pairs)


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    machine = quality.fit(docs, labels, F.col("doc_id") % 3 != 0)
    rows = quality.scores(docs, machine).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.score >= 0.7) == r.quality for r in rows) / len(rows) > 0.97
    kept = quality.keep(odd_documents(spark), machine)
    assert kept.columns == odd_documents(spark).columns
    assert all(0 <= r.score <= 1 for r in quality.scores(odd_documents(spark), machine).collect())
    assert quality.scores(empty(spark), machine).count() == 0


def test_nothing_to_learn_from(spark):
    docs, labels = labelled(spark, 8)
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.scores(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    assert max(r.score for r in toxicity.detect(docs, toxicity.fit(docs, none, F.lit(True))).collect()) < 0.5
    same = labels.where("quality = 1")
    assert min(r.score for r in quality.scores(docs, quality.fit(docs, same, F.lit(True))).collect()) > 0.9
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    quality.fit(docs, nulls, F.lit(True))
    toxicity.fit(docs, nulls, F.lit(True))


def test_maximal_segments():
    rnd = random.Random(5)
    for _ in range(300):
        s = [rnd.choice([-2, -1, 1, 2, 3]) for _ in range(rnd.randint(0, 9))]

        def split(a, b):
            """Ruzzo and Tompa's definition: the best segment, then both sides."""
            best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[3], best[4]
            return [*split(a, i), (i, j, float(best[0])), *split(j, b)]

        found = toxicity.segments(np.array(s, float))
        assert sorted(x for _, _, x in found) == sorted(x for _, _, x in split(0, len(s)))
        assert all(math.isclose(sum(s[b:e]), x) for b, e, x in found)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    detector = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    rows = toxicity.detect(docs, detector).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r["score"] >= 0.5) == r.toxic for r in rows) / len(rows) > 0.97
    for r in rows:
        for p in r.passages:
            assert 0 <= p.begin < p.end <= len(r.text.split()) and p.chance <= toxicity.SIGNIFICANT
    assert all(0 <= r["score"] <= 1 for r in toxicity.detect(odd_documents(spark), detector).collect())
    assert toxicity.detect(empty(spark), detector).count() == 0


# 5 language


def test_passes_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes, n = np.array([3, 0, 5, 1, 4]), 3
    scores, move = rng.normal(size=(sizes.sum(), n)), rng.normal(size=(n, n))
    order, widths = langid.side_by_side(sizes)
    p, counts = langid.passes(scores[order], widths, move, True)
    by_word = np.empty_like(p)
    by_word[order] = p
    expected_counts = np.zeros((n, n))
    for first, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        total, marginal, pairs = 0, np.zeros((size, n)), np.zeros((n, n))
        for y in product(range(n), repeat=int(size)):
            w = math.exp(sum(scores[first + i, y[i]] for i in range(size)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for i in range(size):
                marginal[i, y[i]] += w
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        assert np.allclose(by_word[first : first + size], marginal / total)
        expected_counts += pairs / total
    assert np.allclose(counts, expected_counts)


def test_language_held_out_and_switches(spark):
    rnd = random.Random(1)
    kinds = {"en": "the of and with from thing house".split(), "fr": "le la et avec dans maison eau".split()}
    rows = [(i, " ".join(rnd.choice(kinds[y]) for _ in range(rnd.randint(5, 40))), y) for i in range(200) for y in [["en", "fr"][i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 3 != 0)
    found = langid.predict(docs, model).where("doc_id % 3 = 0").collect()
    assert all(r.lang_pred == r.lang for r in found)
    labels = langid.label_words(model, "the house with thing of the and from le maison avec eau dans la et la")
    assert [y for _, y in labels] == ["en"] * 8 + ["fr"] * 8
    odd = langid.predict(odd_documents(spark), model).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (0, 1, 2)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.keep(odd_documents(spark), model).columns == odd_documents(spark).columns
    nothing = langid.fit(docs, F.lit(False))
    assert {(r.lang_pred, r["score"]) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(empty(spark), model).count() == 0
    one = langid.fit(docs.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"en"}


# 6 language model


def test_scores_equal_counting(spark):
    docs = odd_documents(spark)
    held = common.fold_of("doc_id", 7) == 2
    rows = lm.scores(docs, held).collect()
    texts = [(r.doc_id, words(r.text) + [""], r.h) for r in docs.withColumn("h", held).collect()]
    counts = Counter(w for _, ws, h in texts if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for _, ws, _ in texts)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == expected
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    assert lm.scores(empty(spark), held).count() == 0
    nothing = lm.scores(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in nothing} == {(0, 0, 0.0)}


def test_ids_of_any_type_come_back(spark):
    docs = odd_documents(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    held = common.fold_of("doc_id", 7) == 2
    found = lm.scores(docs, held)
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    expected = [(r.doc_id or "", r.h, len(words(r.text)) + 1) for r in docs.withColumn("h", held).collect()]
    assert sorted((r.doc_id or "", r.held_out, r.n_tokens) for r in found.collect()) == sorted(expected)


def test_base_score_keeps_its_digits_near_zero(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = lm.scores(docs, F.lit(False)).select("base_score").distinct().collect()
    assert len(rows) == 1 and math.isclose(rows[0].base_score, math.log10(20_001 / 20_002), rel_tol=1e-12)


@pytest.fixture(scope="module")
def language_model(spark):
    rnd = random.Random(2)
    pool = [f"w{i}{e}" for i in range(1500) for e in ("ing", "ed", "s")]  # more words than single leaves
    rows = [(i, " ".join(rnd.choices(pool, [1 / (k + 1) ** 0.5 for k in range(len(pool))], k=rnd.randint(0, 120))).upper()) for i in range(400)]
    chunks = lm.pack(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 0)
    counts = lm.word_counts(chunks)
    statistics = lm.Statistics(counts)
    weights = lm.train(chunks, statistics)
    return rows, statistics, weights, lm.score_chunks(chunks, counts, statistics, weights).collect()


def brute_leaf_chance(weights, before, leaf):
    """The chance of a leaf after the three words ``before`` (None: no word)."""
    x = [1 << 32 if w is None else zlib.crc32(w.encode()) for w in before]
    mask = (1 << 64) - 1
    hashes = [(v + f * 0x9E3779B9) * 0x9E3779B97F4A7C15 & mask for f, v in enumerate([*x, x[0] * 31 + x[1] & mask], 1)]
    chance = 1.0
    for level in range(3):
        node, branch = leaf // 16 ** (3 - level), leaf // 16 ** (2 - level) % 16
        z = weights.biases[level][node].astype(float)
        for h in hashes:
            row = h >> 48 if not level else (((h >> 20) + node * 0xD6E8FEB86659FD93 & mask) * 0x9FB21C651E98DF25 & mask) >> 48
            z = z + weights.tables[level][row]
        z = np.exp(z - z.max())
        chance *= z[branch] / z.sum()
    return chance


def test_scores_equal_a_walk_through_the_tree(language_model):
    rows, statistics, weights, found = language_model
    counts = Counter(w for i, t in rows if i % 5 for w in words(t) + [""])
    single = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: lm.SINGLES]]
    leaf = lambda w: single.index(w) if w in single else lm.SINGLES + int(lm.endings(pa.array([w.encode()]))[0])
    totals = Counter()
    for w, c in counts.items():
        if w not in single:
            totals[leaf(w)] += c + 1
    by = {r.doc_id: r for r in found}
    assert len(by) == len(rows) and all(t.any() for t in weights.tables) and len(totals) > 100
    for i, t in rows[:60]:
        own, before, score = words(t) + [""], [None] * 3, 0.0
        for w in own:
            share = 1 if w in single else (counts[w] + 1) / (totals[leaf(w)] + 1)
            score += math.log10(brute_leaf_chance(weights, before, leaf(w)) * share)
            before = [w, *before[:2]]
        assert math.isclose(by[i].score, score, rel_tol=1e-3), (i, by[i].score, score)


def test_chances_of_all_words_sum_to_one(language_model):
    rows, statistics, weights, _ = language_model
    vocabulary = pa.array(sorted({w.encode() for i, t in rows if i % 5 for w in words(t)} | {b""}), pa.binary())
    place, leaves = statistics.place(vocabulary)
    counts = Counter(w.encode() for i, t in rows if i % 5 for w in words(t) + [""])
    share = np.where(leaves < lm.SINGLES, 1.0, np.array([counts[w] + 1 for w in vocabulary.to_pylist()]) / statistics.leaf_totals[leaves])
    rng = np.random.default_rng(0)
    for _ in range(5):
        context = np.repeat(rng.integers(1 << 63, size=(lm.FEATURES, 1), dtype=np.uint64), lm.LEAVES, 1)
        chance = 10 ** weights.log_chance(context, np.arange(lm.LEAVES))
        assert math.isclose(chance.sum(), 1, abs_tol=1e-3)
        # one unknown word in each leaf by ending
        unknown = (chance[lm.SINGLES :] / statistics.leaf_totals[lm.SINGLES :]).sum()
        assert math.isclose((chance[leaves] * share).sum() + unknown, 1, abs_tol=1e-3)


def test_head_is_bounded_and_the_tail_is_joined(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(300)], [300 / (k + 1) for k in range(300)], k=60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for i, t in rows for w in words(t) + [""])
    n, v = sum(counts.values()), len(counts)
    for head in (0, 5, 40, 1000):
        monkeypatch.setattr(lm, "HEAD", head)
        statistics = lm.Statistics(lm.word_counts(lm.pack(docs, F.lit(False))))
        assert len(statistics.head) <= head and all(counts[w.decode()] == c for w, c in zip(statistics.head.to_pylist(), statistics.head_counts, strict=True))
        found = {r.doc_id: r for r in lm.scores(docs, F.lit(False)).collect()}
        for i, t in rows:
            assert math.isclose(found[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t) + [""]), rel_tol=1e-9)
            assert found[i].n_known == found[i].n_tokens


def test_gradients_are_summed_by_row():
    rng = np.random.default_rng(3)
    for sizes in ([1], [lm.STEP], [3, 1, 7, 8, 9, 2, 500, 1], list(range(1, 30)), [1] * 700 + [2] * 90 + [40] * 9):
        own = rng.permutation(np.repeat(rng.permutation(lm.ROWS)[: len(sizes)], sizes)).astype(np.uint16)
        g = rng.normal(size=(len(own), lm.WAYS)).astype(np.float32)
        row, many, sums = lm._summed(g, own, *np.full((2, lm.STEP, lm.WAYS), np.nan, np.float32))
        assert sorted(row) == sorted(set(own.tolist()))
        for r, n, found in zip(row, many, sums, strict=True):
            assert n == (own == r).sum() and np.allclose(found, g[own == r].sum(0, dtype=np.float64), atol=1e-3)


def test_gradient_steps_learn():
    rng = np.random.default_rng(0)
    tokens = np.tile(np.arange(6), 400)
    context = lm.contexts(tokens, np.array([len(tokens)]), rng.integers(0, 1 << 32, 6).astype(np.uint64))
    uniform = [np.full((lm.WAYS**k, lm.WAYS), -math.log(lm.WAYS), np.float32) for k in range(lm.LEVELS)]
    own, leaves = lm.Weights(uniform), tokens * 613
    seen = [np.ones(lm.ROWS, np.float32) for _ in range(lm.LEVELS)]
    assert np.allclose(own.log_chance(context, leaves), -math.log10(lm.LEAVES), atol=1e-4)
    for _ in range(60):
        own.steps(seen, context, leaves)
    assert (10 ** own.log_chance(context, leaves)).mean() > 0.5
    total = lm.Weights(uniform)
    for _ in range(3):
        r = own.row(0).to_pylist()[0]
        total.add(r["used"], r["weights"])
    assert np.allclose(total.mean().tables[0], own.tables[0].astype(np.float16), atol=1e-3)


# 7 top-k


def test_top_k_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for name, value in (("SHARD", 7), ("TILE", 2), ("GROUP", 9), ("QUERIES", 3), ("FAN", 2)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 3]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4), (70, [1.0] * 3), (None, [1.0] * 4)]
    # scores beyond 64 bits, and rows that share an id (of a candidate, of a query)
    rows += [(64, [1e300] * 4), (65, [3e15, -1.0, 0.0, 1.0]), (80, [-1e300, 1e300, 1e300, 1e300]), (7, rows[7][1]), (20, [1.0, 0.0, 0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    low, high = -(1 << 63), (1 << 63) - 1
    held = lambda x: min(max(x, low), high)
    flat = [(i, [held(math.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    found = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
    asked = sorted({i for i, _ in flat if i % 10 == 0})
    assert asked == [0, 10, 20, 30, 40, 50, 80]
    for q in asked:
        expected = sorted((-held(sum(a * b for a, b in zip(e, c, strict=True))), i) for j, e in flat if j == q for i, c in flat if i != q)[:5]
        got = sorted((r["rank"], -r.score, r.vec_id) for r in found if r.query_id == q)
        assert [(s, i) for _, s, i in got] == expected
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
    assert {r.query_id for r in found} == set(asked)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert len(topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()) == 2


# 9 token files


def test_words_round_trip():
    rng = np.random.default_rng(0)
    for k in range(120):
        n = int(rng.integers(0, 12_000)) if k % 3 else int(rng.integers(0, 20))
        bits = rng.integers(0, 65, n) if k % 2 else rng.integers(0, 17, n)
        values = np.array([int.from_bytes(rng.bytes(8), "little") >> (64 - int(b)) if b else 0 for b in bits], np.uint64)
        if k % 5 == 0:
            values[:] = 0
        sizes, left = [], n
        while left:
            sizes.append(int(rng.integers(0, left + 1)) if left > 3 else left)
            left -= sizes[-1]
        ids = [None if s % 7 == 0 else i for i, s in enumerate(sizes)]
        file = token_files.TokenFile(token_files.dump(ids, sizes, values))
        got = list(file.documents())
        assert [g[0] for g in got] == ids and [len(g[1]) for g in got] == sizes
        assert not n or np.array_equal(np.concatenate([g[1] for g in got]), values)
        if n > token_files.BLOCK:
            assert np.array_equal(file.blocks(1, 2), values[token_files.BLOCK : 2 * token_files.BLOCK])
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 80)


def test_files_of_odd_documents(spark, library, tmp_path):
    folder = f"file://{tmp_path}/files"
    files = token_files.write_texts(odd_documents(spark), folder, VOCABULARY, ids_per_file=2000)
    assert len(files) > 2
    rows = token_files.read(spark, folder, files, token_files.crc32, T.StructType([T.StructField("ids_crc32", T.LongType())])).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_documents(spark).collect()), key=lambda x: (x is not None, x))
    texts = {i: t for i, t in enumerate(TEXTS)}
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert token_files.write_texts(empty(spark), folder + "-none", VOCABULARY) == []


def test_library_ids_by_parts(library):
    own = token_files.LibraryIds(VOCABULARY)
    own.known.limit = 50
    rnd = random.Random(3)
    some = ["a", " the", "  ", "\n", "<|endoftext|>", "'s", " é", "日本", "　", "!!", ". ", ", b", "1"]
    for _ in range(30):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 12))) for _ in range(40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


# 10 media


def test_items_stay_aligned():
    page = "<h1>T</h1><script>x</script><figure><img src='media:AB' alt='a'><figcaption>cap <b>one</b></figcaption></figure>text<figure><figcaption>early</figcaption><img src=b.png></figure><img src=c alt=alone><p>end"
    found = media.items(page)
    assert [(i["kind"], i["text"] or i["source"], i["digest"], i["caption"]) for i in found] == [
        ("text", "T", None, None), ("media", "media:AB", "ab", "cap one"), ("text", "text", None, None),
        ("media", "b.png", None, "early"), ("media", "c", None, "alone"), ("text", "end", None, None),
    ]
    assert [i["position"] for i in found] == list(range(6))
    assert media.items("") == []


def test_pictures():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.padded(bytes(range(256)) * 20)[: max(192, -(-n // 192) * 192)]
        assert media.from_png(media.to_png(payload)) == payload
    damaged = bytearray(media.to_png(media.padded(b"abc")))
    damaged[45] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        media.from_png(bytes(damaged))


def test_media_of_odd_documents(spark):
    store = media.write_media(odd_documents(spark))
    html = F.concat(F.lit("<p>x</p><img src='media:"), "digest", F.lit("' alt=c><img src='media:00'>"))
    pages = media.sequences(store.select("doc_id", "n_bytes", html.alias("html")))
    rows = media.resolve(pages, media.by_digest(media.facts(store)), ["doc_id", "n_bytes"]).collect()
    assert len(rows) == 2 * odd_documents(spark).count()
    for r in rows:
        if r.position == 1 and r.doc_id is not None:
            payload = media.padded((TEXTS[r.doc_id] or "").encode())
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r.caption == "c" and r.n_bytes == len((TEXTS[r.doc_id] or "").encode())
        if r.position == 2:
            assert r.payload_sha256 is None
    assert len({r.media_sha256 for r in rows if r.position == 1 and r.doc_id in (9, 10)}) == 1
    none = media.write_media(empty(spark))
    assert media.facts(none).count() == 0 and none.count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (5, None), (200, 201), (201, 200)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {200: 200, 201: 200}
    assert components.components(links.where("false")).count() == 0


def test_appended_columns_replace_clashing_ones(spark):
    out = common.append_columns(odd_documents(spark), T.StructType([T.StructField("SCORE", T.DoubleType())]), lambda: lambda b: [[1.0] * b.num_rows])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "FP", "token_ids", "SCORE"]
