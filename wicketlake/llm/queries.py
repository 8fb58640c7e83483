"""Registered queries of this folder: thin digests of the operators, with SQL where SQL can say the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.llm import (
    ann_forest,
    centroids,
    checks,
    common,
    embedding_dedup,
    language_id,
    licenses,
    merkle,
    mixing,
    secret_rules,
    sentencepiece_codec,
    sharding,
    simhash,
    token_counts,
    url_filters,
)
from wicketlake.plans.registry import Entry

ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        ENTRIES[name] = Entry(build, sql)
        return build

    return add


@query("op6_token_counts")
def op6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts.token_counts(docs, "byte_bpe_50k.json", limit=1024, keep=["doc_id"])


@query("op10_sentencepiece")
def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentencepiece_codec.encode_and_decode(docs, "piece_bpe_32k.model", keep=["doc_id"])


@query("op3_license_scan")
def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = licenses.license_scan(docs, keep=["doc_id"])
    base, more = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    words = F.transform("places", lambda p: p["word"])
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        licenses.label_list(base).alias("base_labels"),
        licenses.label_list(base, more).alias("labels"),
        score.alias("score"),
    )


@query("op2_simhash_near_duplicates")
def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash.simhash_components(docs, shingle=3, radius=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op9_source_mix", checks.OP9)
def op9(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    text, row = F.col("text"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    narrow = common.checkpointed(
        docs.select(
            "doc_id", "source", F.md5(F.coalesce(text, F.lit(""))).alias("mark"), row.alias("row"),
            mixing.word_count(text).alias("size"), mixing.letter_share(text).alias("quality"),
        )
    )
    mixed = mixing.mix(narrow, "size", "quality", ["doc_id", "mark", "row"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


BASE_KINDS = [r.kind for r in secret_rules.BASE]


@query("op4_secret_scan")
def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_rules.secret_scan(docs)
    count = lambda kind: F.size(secret_rules.of_kind(F.col("spans"), [kind])).cast("long").alias(f"n_{kind}")
    base = secret_rules.listed(secret_rules.of_kind(F.col("spans"), BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(base, 256).alias("base_sha256"), secret_rules.listed(F.col("spans")).alias("spans")
    )


OP1_SQL = """
WITH rules(verdict, r_host, r_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest
), urls AS (
  SELECT row_number() OVER () AS n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut
), fit AS (
  SELECT n, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(verdict, length(r_host || r_path)) AS verdict
  FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fit USING (n)
"""


@query("op1_url_filters", OP1_SQL)
def op1(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = url_filters.filter_urls(pages, url_filters.rule_table(spark, url_filters.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_embedding_near_duplicates")
def op5(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_dedup.embedding_components(vectors, threshold=0.9)


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    predicted = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return predicted.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op8_nearest_neighbours")
def op8(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann_forest.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op11_merkle_manifest", checks.OP11)
def op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS)
    return merkle.merkle_manifest(docs, fanout=16, every=5)


@query("op12_histogram_shards", checks.OP12)
def op12(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharding.shard_documents(docs, shards=24)


@query("op13_centroid_clusters", checks.OP13)
def op13(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.clusters(vectors, k=16, rounds=3)
