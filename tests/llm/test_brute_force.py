"""The queries that SQL can't express, over a small table, against plain
versions of their definitions."""

import hashlib
import html
import math
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from jisfold.llm import langid, media, quality, queries, toxicity
from jisfold.llm.common import fold_of, table

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with null, empty, short, repeated and nearly equal documents added."""
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    long = max((r.text for r in rows if r.text), key=len)
    changed = long.split(" ")
    changed[len(changed) // 2] = "other"
    odd = [None, "", " \t\n", "one", "One two", "1 2 3", "a b c d e", "A B c d e", "a b c d f", "é 日本 😀 x", "\x00 \x1c y", long, long + " more", " ".join(changed)]
    new = [(10_000 + i, t, [None, "en"][i % 2], "s", None) for i, t in enumerate(odd)]
    new += [(20_000 + i, " ".join((r.text or "").split()[:5]), r.lang, r.source, None) for i, r in enumerate(rows[:60])]
    new += [new[4], new[4], (None, "no id", "en", "s", None), (None, None, None, None, None)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.unionByName(spark.createDataFrame(new, docs.schema)).repartition(3).write.parquet(f"{path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{path}/labels.parquet")
    return path


def remainder(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def paired(rows, docs):
    """Rows of a query with the texts of their ids, each text as often as it is."""
    texts = {}
    for d in docs:
        texts.setdefault(d.doc_id, []).append(d.text)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d.doc_id is None, d.doc_id or 0) for d in docs)
    return [(r, texts[r.doc_id][0]) for r in rows if len(set(texts[r.doc_id])) == 1]


def test_op1(spark, folder):
    docs = table(spark, folder, "documents").collect()

    def fingerprint(text):
        w = words(text)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    own = [(d.doc_id, fingerprint(d.text)) for d in docs]
    distinct = {f for _, f in own}
    group = {f: f for f in distinct}
    for a, b in product(distinct, repeat=2):
        if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {f: new if g == old else g for f, g in group.items()}
    least = {}
    for i, f in own:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    expected = sorted((repr(i), f"{f:016x}", repr(least.get(group[f]))) for i, f in own)
    found = queries.op1_simhash(spark, folder).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in found) == expected
    assert any(len({f for i, f in own if group[f] == g}) > 1 for g in set(group.values()))


def test_op4(spark, folder):
    docs = table(spark, folder, "documents")
    machine = quality.fit(docs, table(spark, folder, "labels"), fold_of("doc_id", 4) != 2)
    features = quality.Features()
    for r, text in paired(queries.op4_quality(spark, folder).collect(), docs.collect()):
        index, x = features.of((text or "").encode())
        v = machine.factors[index].astype(float) * x[:, None]
        all_pairs = v @ v.T
        score = machine.bias + x @ machine.linear[index] + (all_pairs.sum() - np.trace(all_pairs)) / 2
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, score)))), abs_tol=1e-6)
        assert (r.held_out, r.predicted) == (remainder(r.doc_id, 4) == 2, int(r.score >= 0.7))


def test_op5(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.fit(docs, fold_of("doc_id", 3) != 1)
    assert len(model.languages) > 1
    n, checked = len(model.languages), 0
    for r, text in paired(queries.op5_langid(spark, folder).collect(), docs.collect()):
        assert r.held_out == (remainder(r.doc_id, 3) == 1)
        flat, _ = langid.words_of(pa.array([text], pa.string()))
        own = flat.to_pylist()
        if len(own) > 6:
            continue
        found = [langid.features(w) for w in own]
        scores = [sum((model.weights[f].astype(float) for f in x), np.zeros(n)) for x in found]
        chance, total = np.zeros(n), 0.0
        for path in product(range(n), repeat=len(own)):
            weight = math.exp(sum(scores[i][y] for i, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += weight
            for i, y in enumerate(path):
                chance[y] += weight * bool(found[i])
        lettered = sum(map(bool, found))
        if not lettered:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = chance / total / lettered
        assert math.isclose(r.score, share.max(), abs_tol=1e-4) and share[model.languages.index(r.lang_pred)] >= share.max() - 1e-4
        checked += len(own) > 2
    assert checked > 30


def test_op8(spark, folder):
    docs = table(spark, folder, "documents")
    detector = toxicity.fit(docs, table(spark, folder, "labels"), fold_of("doc_id", 5) != 0)
    assert detector.scores
    passages = 0
    for r, text in paired(queries.op8_toxicity(spark, folder).collect(), docs.collect()):
        assert (r.held_out, r.predicted) == (remainder(r.doc_id, 5) == 0, int(r.score >= 0.5))
        own = (text or "").encode().split()
        if len(own) > 300:
            continue
        s = [detector.word(w) for w in own]
        total = np.concatenate(([0.0], np.cumsum(s)))

        def split(a, b, total=total):
            """The best segment, then those on both sides of it."""
            gain = total[None, a + 1 : b + 1] - total[a:b, None]
            gain[np.tril_indices(b - a, -1)] = -np.inf
            if b <= a or gain.max() <= 1e-12:
                return []
            ties = np.argwhere(gain >= gain.max() - 1e-9)
            i, j = min(ties.tolist(), key=lambda t: (t[1] - t[0], t[0]))
            return [*split(a, a + i), (a + i, a + j + 1, float(gain[i, j])), *split(a + j + 1, b)]

        found, seen, strength = split(0, len(s)), set(), []
        chances = [1 - math.exp(-detector.k * len(own) * math.exp(-detector.rate * x)) for _, _, x in found]
        for (b, e, _), p in zip(found, chances, strict=True):
            if tuple(own[b:e]) not in seen:
                strength.append(math.log1p(min(300.0, -math.log10(max(p, 1e-300)))))
            seen.add(tuple(own[b:e]))
        strength.sort(reverse=True)
        a, b, c = detector.weights
        score = a * strength[0] + b * math.log1p(sum(strength[1:])) + c if strength else c
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, score)))), abs_tol=1e-6)
        significant = sorted((x, p) for (_, _, x), p in zip(found, chances, strict=True) if p <= toxicity.SIGNIFICANT)
        assert np.allclose(sorted((p.score, p.chance) for p in r.passages), significant, atol=1e-9)
        passages += len(significant)
    assert passages > 0


def test_op10(spark, folder):
    rows = queries.op10_media(spark, folder).collect()
    for r, text in paired(rows, table(spark, folder, "documents").collect()):
        data = (text or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        sha, name = hashlib.sha256(payload).hexdigest(), "without id" if r.doc_id is None else str(r.doc_id)
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha, zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        means = [sum(payload[c::3]) * 1000 // (len(payload) // 3) for c in range(3)]
        levels = [sum(1 for x in payload if x >> 5 == k) * 1000 // len(payload) for k in range(8)]
        assert r.feature == f"rows={len(payload) // 192};mean={','.join(map(str, means))};levels={','.join(map(str, levels))}"
        items = [("text", f"Document {name}", "", ""), ("media", f"media:{sha}", f"Payload of {name}", sha), ("text", f"{len(data)} bytes", "", ""), ("text", "Source:", "", ""), ("media", "media:", "none", "")]
        lines = "\n".join("\t".join((str(i), *map(html.unescape, x))) for i, x in enumerate(items))
        assert (r.n_items, r.position, r.caption) == (5, 1, f"Payload of {name}")
        assert r.sequence_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_columns_of_any_name_stay(spark, folder):
    docs = table(spark, folder, "documents")
    clashing = docs.select("*", *[F.lit(7).alias(n) for n in ("Score", "score_", "__quality", "__lang", "__id", "lang_pred", "lang_shares", "h", "k", "order")])
    machine = quality.fit(clashing, table(spark, folder, "labels"), fold_of("doc_id", 4) != 2)
    model = langid.fit(clashing, fold_of("doc_id", 3) != 1)
    for kept in (quality.keep(clashing, machine), langid.keep(clashing, model)):
        assert kept.columns == clashing.columns
        assert {tuple(r)[5:] for r in kept.distinct().collect()} == {(7,) * 10}
    assert quality.keep(clashing, machine).count() == quality.keep(docs, machine).count()
    assert langid.keep(clashing, model).count() == langid.keep(docs, model).count()


def test_rare_languages_are_learnt(spark):
    rows = [(i, f"the house of thing number{i} and with", "en") for i in range(400)] + [(1_000 + i, f"maison avec eau dans la rue{i} et le", "fr") for i in range(4)]
    rows += [(2_000 + i, "copied text again and again", "xx") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), bound=12)
    assert model.languages == ["en", "fr", "xx"]
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(found[i] == y for i, _, y in rows) > 0.98 * len(rows)
