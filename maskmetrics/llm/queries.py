"""The registered queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, language_model, mixing, ngram_join, periodic_runs, pii, resampling, sharding, topk, toxicity, url_filters, warc
from .common import crc_remainder
from .oracles import ORACLE_SQL as ORACLE_SQL

#: For the test tables alone; set spark.maskmetrics.pii.key to a secret for anything else.
PII_TEST_KEY = "not a secret: for test tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"), F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    return language_id.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.learn(docs.where(~held_out), labels)
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.maskmetrics.pii.key", PII_TEST_KEY)
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: The rules (host, path, verdict) of op11's contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rules_of(spark, URL_RULES)).drop("url")


def periodised(text: str, doc_id: str) -> Column:
    """The text; of documents whose crc32(doc_id) is divisible by 10, with its words made periodic from one of them on."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.call_function("div", n - a, F.pmod(g, F.lit(8)) + 3)
        at = F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")))
        put = lambda ap: F.transform(words, lambda w, i: F.when(i < ap["a"], w).otherwise(F.get(words, ap["a"] + F.pmod(i - ap["a"], ap["p"]))))
        return F.when(n > 0, F.array_join(F.transform(at, put)[0], " "))

    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    # bound to a variable by the transform, so that it is worked out once
    changed = F.transform(F.array(words), repeated)[0]
    return F.coalesce(F.when(F.pmod(h, F.lit(10)) == 0, changed), F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodised("text", "doc_id").alias("text"))
    found = periodic_runs.detected(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.call_function("div", F.col("best.length") * 1000, -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "clicks"), signal="linear", cap=900, bucket="day", zone="Europe/Berlin").withColumnRenamed("avg", "avg_cents")


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_topk": op9_topk,
    "op10_decontamination": op10_decontamination,
    "op11_url_filters": op11_url_filters,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_resampling": op13_resampling,
}
