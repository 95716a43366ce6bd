"""One query for each operator, with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import alignment, bpe, langid, lm, media, mixing, quality, resample, simhash, token_files, topk, toxicity, warc
from jisfold.llm.common import fold_of, new_path, table

VOCABULARY = "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, radius=4)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn; no document is taken more than three times."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    taken, plan = mixing.mix(docs, F.array("source"), (5, 2, 1), 1.0, 3)
    sources = spark.createDataFrame([(n, x["size"], x["target"]) for n, x in plan["sources"].items()], "name string, source_size long, target double")
    found = taken.join(F.broadcast(sources), F.col("pattern")[0] == F.col("name"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM s
), a AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, n) AS k FROM w
), c AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE - 3.0 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_words,
         (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM a
), f AS (
  SELECT min(k) AS k FROM c WHERE 3.0 * source_size * left_weight > left_words * weight
), t AS (
  SELECT source, source_size,
         CASE WHEN f.k IS NULL OR c.k < f.k THEN 3.0::DOUBLE * source_size
              ELSE (SELECT left_words FROM c WHERE c.k = f.k) * weight / (SELECT left_weight FROM c WHERE c.k = f.k) END::DOUBLE AS target
  FROM c CROSS JOIN f
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest
  FROM t
), p AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.rest,
         size > 0 AND sum(size) OVER (PARTITION BY d.source ORDER BY o) <= rest AS more
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), g AS (
  SELECT source, max(rest) - sum(CASE WHEN more THEN size ELSE 0 END) AS gap FROM p GROUP BY source
), l AS (
  SELECT p.source, o, row_number() OVER (PARTITION BY p.source ORDER BY size DESC, o) AS n
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
  WHERE NOT more AND size > 0 AND size <= gap
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN (whole + more::BIGINT + (l.o IS NOT NULL)::BIGINT) * size ELSE 0 END)::BIGINT AS taken
FROM p LEFT JOIN l ON p.source IS NOT DISTINCT FROM l.source AND p.o = l.o AND l.n = 1
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and the text decoded from them."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.bpe_round_trip(docs, path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the ids outside fold 2 of 4."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    machine = quality.fit(docs, labels, fold_of("doc_id", 4) != 2)
    found = quality.scores(docs, machine)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", predicted.alias("predicted"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the ids outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs, fold_of("doc_id", 3) != 1)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "lang_shares")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum-entropy scores of every document, learnt from the ids outside fold 2 of 7."""
    return lm.scores(table(spark, sf_dir, "documents", "doc_id", "text"), fold_of("doc_id", 7) == 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the ids outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    detector = toxicity.fit(docs, labels, fold_of("doc_id", 5) != 0)
    found = toxicity.detect(docs, detector)
    predicted = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", predicted.alias("predicted"), "passages")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector, by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids as Simple-8b files and reads them back."""
    docs, folder = table(spark, sf_dir, "documents", "doc_id", "text"), new_path(spark, "token-files")
    files = token_files.write_texts(docs, folder, public_tokenizers.path(VOCABULARY))
    return token_files.read(spark, folder, files, token_files.crc32, T.StructType([T.StructField("ids_crc32", T.LongType())]))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as a picture, makes a page that interleaves text
    and two references (the picture as a figure, and one without payload), and
    resolves the references to what the stored bytes hold; sequence_sha256 is of
    all items in order: position, kind, text or source, caption, payload."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    store = media.write_media(docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without id"))
    figure = F.concat(F.lit("<figure><img src='media:"), "digest", F.lit("' alt='payload'><figcaption>Payload of "), name, F.lit("</figcaption></figure>"))
    head, tail = F.lit("<article><p>Document "), F.lit("<p>Source: <img src='media:' alt='none'></p></article>")
    html = F.concat(head, name, F.lit("</p>"), figure, F.lit("<p>"), F.col("n_bytes").cast("string"), F.lit(" bytes</p>"), tail)
    pages = media.sequences(store.select("doc_id", "n_bytes", "part", "digest", html.alias("html")))
    found = media.aligned(pages, media.facts(store), ["doc_id", "n_bytes", "part", "digest"], on=("digest", "part"))
    figure = F.filter("items", lambda x: x["payload"].isNotNull())[0]
    line = lambda x: F.concat_ws("\t", x["position"].cast("string"), x["kind"], F.coalesce(x["text"], x["source"]), F.coalesce(x["caption"], F.lit("")), F.coalesce(x["payload"]["payload_sha256"], F.lit("")))
    digest = F.sha2(F.array_join(F.transform("items", line), "\n"), 256).alias("sequence_sha256")
    found = found.select("doc_id", "n_bytes", F.size("items").alias("n_items"), digest, figure.alias("f"))
    return found.select("doc_id", "n_bytes", *[F.col(f"f.payload.{f.name}") for f in media.FACTS.fields], "n_items", "f.position", "f.caption", "sequence_sha256")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a record of a content-addressed archive, and reads
    the archive back."""
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    found = warc.read(spark, folder)
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    return found.select(F.col("page_id").cast("long").alias("page_id"), size, "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(d, (i // 8 * 10 + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
FROM g
"""


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten in a hundred documents, drawn by their likeness to the benchmark's words."""
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return resample.resample(docs, target, share=(10, 100), least_words=20, most=1, n_buckets=10_000, seed="2024")


#: crc32 by its table, which the rule makes; words are counted before it is applied.
OP12_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM docs) GROUP BY ALL
), bw AS (
  SELECT x, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY x
), h AS (
  SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)
), b AS (
  SELECT x, xor(list_reduce(range(strlen(x)), lambda c, i: xor(c >> 8, t[(xor(c & 255, ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT))::INTEGER + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM h, t
), c AS (
  SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM (
    SELECT bucket, n AS s, 0 AS t FROM dw JOIN b USING (x) UNION ALL SELECT bucket, 0, n FROM bw JOIN b USING (x)) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM c
), m AS (
  SELECT r, floor(sum(gain * n) / sum(n))::BIGINT AS weight FROM dw JOIN b USING (x) JOIN g USING (bucket) GROUP BY r
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN m USING (r)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM k
"""


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public vocabularies over every document, aligned by bytes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.align(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_simhash": op1_simhash, "op2_mix": op2_mix, "op3_bpe": op3_bpe, "op4_quality": op4_quality, "op5_langid": op5_langid, "op6_lm": op6_lm, "op7_top_k": op7_top_k, "op8_toxicity": op8_toxicity, "op9_token_files": op9_token_files, "op10_media": op10_media, "op11_warc": op11_warc, "op12_resample": op12_resample, "op13_align": op13_align}
ORACLES: dict[str, str] = {"op2_mix": OP2_SQL, "op7_top_k": OP7_SQL, "op11_warc": OP11_SQL, "op12_resample": OP12_SQL}
