"""WARC archive, importance resampling and tokenizer alignment."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from jisfold.llm import alignment, resample, warc
from jisfold.llm.common import new_path, table

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAGES = "page_id long, url string, html string, digest string, payload int, size string"
ROWS = [
    (3, "http://a/", "<p>x</p>", "d", 1, "s"), (1, "http://b/\r\nX: y", "<p>x</p>", "d", 1, "s"), (2, None, "", None, None, None), (5, "u", None, None, None, None),
    (None, "u", "<p>x</p>", None, None, None), (None, "u", "only null ids", None, None, None), (None, "v", "only null ids", None, None, None),
    (7, "u", "é日😀\r\n\r\nWARC/1.1\r\n", None, None, None), (7, "u", "é日😀\r\n\r\nWARC/1.1\r\n", None, None, None), (8, "u", "é日😀\r\n\r\nWARC/1.1\r\n", None, None, None), (9, "u", "long " * 200_000, None, None, None),
]


def archive(spark, rows, **options):
    folder = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, PAGES), folder, **options)
    return folder


def expected(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [p for p, _, h, *_ in rows if (h or "").encode() == body and p is not None]
        keeper = min(ids) if ids and len(body) >= least else None
        revisit = keeper is not None and page != keeper
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 9])
def test_archive(spark, least):
    found = warc.read(spark, archive(spark, ROWS, least_bytes=least)).collect()
    number = lambda x: None if x is None else int(x)
    assert sorted(repr((number(r.page_id), len(r.payload), r.payload_digest, r.record_type, number(r.refers_to))) for r in found) == expected(ROWS, least)


def test_payloads_are_stored_once_also_where_most_records_share_one(spark):
    rows = [(i, "u", "hot" if i % 3 else f"p{i % 5}", None, None, None) for i in range(300)]
    folder = archive(spark, rows)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h for _, _, h, *_ in rows})
    assert warc.read(spark, folder).where("record_type = 'response'").count() == len({h for _, _, h, *_ in rows})


def test_exported_files_are_records(spark, tmp_path):
    records = warc.read(spark, archive(spark, ROWS))
    warc.export(records, f"file://{tmp_path}/out")
    parsed, pages = [], {}
    for path in sorted((tmp_path / "out").glob("*.gz")):
        data = gzip.open(path).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            block, end, data = data[:size], data[size : size + 4], data[size + 4 :]
            assert end == b"\r\n\r\n"
            http, _, body = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK\r\n")
            parsed.append(fields)
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                pages[fields["WARC-Record-ID"]] = body
            else:
                assert body == b""
    assert len(parsed) == len(ROWS)
    assert all(x["WARC-Refers-To"] in pages for x in parsed if x["WARC-Type"] == "revisit")
    assert not any("X" in x for x in parsed) and any(x.get("WARC-Target-URI") == "http://b/%0D%0AX: y" for x in parsed)


def test_a_changed_or_missing_payload_fails(spark):
    folder = archive(spark, ROWS[:4])
    for some in (spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "cast('other' as binary) as payload"), spark.read.parquet(f"{folder}/payloads").limit(1)):
        other = new_path(spark, "warc")
        some.write.parquet(f"{other}/payloads")
        spark.read.parquet(f"{folder}/records").write.parquet(f"{other}/records")
        with pytest.raises(Exception, match="is not what its digest says"):
            warc.read(spark, other).collect()


def test_empty_archive(spark):
    assert warc.read(spark, archive(spark, [])).count() == 0


def brute_resample(docs, target, share, least, most, n_buckets, seed):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words, now = [], ""
        for c in low + " ":
            if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z":
                now += c
            elif now:
                words.append(now)
                now = ""
        return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + n_buckets) / ((s[b] + 1) * (all_t + n_buckets))))
    rows = []
    for doc, text in docs:
        words, own = features(text)
        weight = math.floor(sum(gain(bucket(f)) for f in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    n = len(drawn) * share[0] // share[1]
    ranks = [(*r[:4], k if k <= n else None) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(map(repr, ranks))


@pytest.mark.parametrize("most, n_buckets", [(1, 50), (2, 10_000), (3, 200_003)])
def test_resampling_equals_brute_force(spark, most, n_buckets):
    rng = random.Random(7)
    vocabulary = ["the", "The", "é", "日本", "x1", "o'clock", "a-b", "--", "rare", "\x00", "ß"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(120)]
    docs += [(None, "The rare x1 " * 9), (500, None), (501, ""), (7, "the the"), (7, docs[7][1]), (502, "the " * 70_000 + "rare"), (503, "-- !")]
    target = ["The rare 日本", "rare rare", None, ""]
    df = spark.createDataFrame([(*d, "c", 1, 2) for d in docs], "doc_id long, text string, bucket string, row int, score int").repartition(3)
    args = dict(share=(30, 100), least_words=5, most=most, n_buckets=n_buckets, seed="s")
    found = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **args)
    assert sorted(map(repr, map(tuple, found.collect()))) == brute_resample(docs, target, (30, 100), 5, most, n_buckets, "s")


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, docs).count() == 0
    assert [tuple(r) for r in resample.resample(docs, none, least_words=3).select("doc_id", "n_features", "rank").collect()] == [(1, 2, None)]


def brute_align(docs):
    pair = alignment.Pair(A, B)
    found, count = [], Counter()
    for doc, text in docs:
        whole = (" " + (text or "")).encode()
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids if text else [], pair.b.encode(text) if text else []
        if b"".join(pair.bytes_a[x] for x in a) != whole or b"".join(pair.bytes_b[x] for x in b) != whole:
            a = b = []

        def spans(ids, of):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(of[x])))
                at += len(of[x])
            return out

        sa, sb = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]] if len(a) < 400 else None
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [(start, end) for start, end in zip([0, *cuts], cuts)]
        text_of = ";".join(f"{','.join(str(x) for x, (p, q) in zip(a, sa) if s <= p and q <= e)}|{','.join(str(x) for x, (p, q) in zip(b, sb) if s <= p and q <= e)}" for s, e in groups)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
        count.update(links)
    most = {}
    for (x, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(repr((d, na, nb, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), h)) for d, na, nb, g, links, h in found)


def texts_to_align():
    rng = random.Random(11)
    bits = ["the", "The", " ", "  ", "\n", "\t", "\x1c", "\x1f!", "é", "日本語", "😀", "don't", "12345", "foo_bar", "　", " ", "\u0085", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "Å", "\x00", "antidisestablishmentarianism", "\r\n", "...", "ⅷ"]
    docs = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 25)))) for i in range(150)]
    return docs + [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "x "), (205, "▁"), (206, "a \n"), (7, docs[7][1]), (None, "no id"), (207, "▁▁ a")]


def test_alignment_equals_brute_force_and_the_relational_form(spark):
    docs = texts_to_align()
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, row int, chunk string, n_a int").repartition(3)
    expected = brute_align(docs)
    assert sorted(map(repr, map(tuple, alignment.align(df, A, B).collect()))) == expected
    assert sorted(map(repr, map(tuple, alignment.align_relational(df, A, B).collect()))) == expected


def test_forms_of_the_alignment_agree_on_documents(spark):
    docs = table(spark, SF, "documents", "doc_id", "text")
    one, other = alignment.align(docs, A, B), alignment.align_relational(docs, A, B)
    assert one.count() == docs.count() and one.exceptAll(other).count() == 0


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(table(spark, SF, "documents", "doc_id", "text").where("false"), A, B).count() == 0
