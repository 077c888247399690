"""The operators over the given tables, one query each, with SQL where it can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, interleave, licenses, line_frequency, mixing, ngram_join, oracles, order_minhash, pseudonyms, ranked, repair_files, rollups, runs, urls
from barloom.llm.common import WORD, documents, importable
from barloom.session import checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Demonstration key of the registered query; real runs pass their own.
KEY = "registered-query"


def query(name: str, sql: str | None = None):
    def wrap(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return plan(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return plan

    return wrap


@query("op1_license_scan")
def op1(spark, sf_dir):
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query("op2_order_minhash")
def op2(spark, sf_dir):
    return order_minhash.edit_fingerprints(documents(spark, sf_dir))


@query("op3_interleave_shards", oracles.SHARDS)
def op3(spark, sf_dir):
    rows = interleave.interleaved_shards(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op4_line_frequency", oracles.LINES)
def op4(spark, sf_dir):
    found = line_frequency.line_quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


@query("op5_bpe_lexicon")
def op5(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), VOCABULARY, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_url_vocabulary", oracles.urls(urls.STRICT, urls.SOFT, urls.MIN_SOFT, urls.RULES))
def op6(spark, sf_dir):
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op7_token_rollups", oracles.ROLLUPS)
def op7(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    return rollups.rolled_up(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), path)


@query("op8_entropy_mix")
def op8(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op9_feistel_pseudonyms")
def op9(spark, sf_dir):
    return pseudonyms.pseudonymise(documents(spark, sf_dir), KEY).select("doc_id", "text", "n_replaced", "kinds")


@query("op10_prefix_tree_join")
def op10(spark, sf_dir):
    return ngram_join.ngram_components(documents(spark, sf_dir), words=3, share=90)


def made_periodic(docs: DataFrame) -> DataFrame:
    """`documents` with every tenth text, by the checksum of its id, repeated from some word on; rows without an id stay."""
    words, h = F.col("_words"), F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size(words), F.expr("crc32(cast(doc_id as string)) div 10")
    first = (g % n).cast("int")
    period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
    at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, at(i) + 1)), " ")
    text = F.coalesce(F.col("text"), F.lit(""))
    # Words are cut only in the texts that change.
    rows = docs.select("doc_id", text.alias("text"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), 0)).alias("_words"))
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    found = runs.periodic_runs(made_periodic(documents(spark, sf_dir)))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    better = lambda a, b: F.when((a["length"] == b["length"]) & (a["start"] == b["start"]), a["period"] - b["period"]).when(
        a["length"] == b["length"], a["start"] - b["start"]).otherwise(b["length"] - a["length"])
    best = F.get(F.array_sort("runs", lambda a, b: F.signum(better(a, b)).cast("int")), F.lit(0))
    rows = found.withColumn("_best", best).withColumn("_lines", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
                       F.col("_best.period").alias("period"), F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
                       F.sha2(F.array_join("_lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_ranked_search", oracles.RANKED)
def op12(spark, sf_dir):
    return ranked.search_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


@query("op13_repair_files")
def op13(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    repair_files.write_token_files(documents(spark, sf_dir), path, VOCABULARY)
    return repair_files.read_documents(repair_files.token_files(spark, path), with_ids=False)
