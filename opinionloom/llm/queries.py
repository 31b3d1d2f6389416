"""The operators of this package as queries over whole tables, with production parameters."""

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from . import compression, linededup, mixing, packing, ranked, records, repetition, secrets, sharding, simhash, simplex, suffixes, topk
from .common import read


def op1_mixing(spark, sf_dir):
    done = mixing.mix(read(spark, sf_dir).select("doc_id", "text", "source"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark, sf_dir):
    done = linededup.drop_common_lines(read(spark, sf_dir), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_secrets(spark, sf_dir):
    found = secrets.find_secrets(read(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", *[secrets.count_of("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"),
    )


def op4_packing(spark, sf_dir):
    docs = read(spark, sf_dir).select("doc_id", "text")
    return packing.pack(docs, packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("byte_bpe_50k.tiktoken"), capacity=2048)


def op5_suffix_dedup(spark, sf_dir):
    done = suffixes.drop_repeats(read(spark, sf_dir).select("doc_id", "text"), length=400, keep="none")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_sharding(spark, sf_dir):
    shards = {f"shard-{n:03d}": 2 if n < 16 else 1 for n in range(112)}
    return sharding.assign_shards(read(spark, sf_dir).select("doc_id"), shards).select("doc_id", "slot", "shard")


def op7_quality_rules(spark, sf_dir):
    done = repetition.measured(read(spark, sf_dir).select("doc_id", "text"))
    return done.drop("text")


def op8_simhash(spark, sf_dir):
    done = simhash.near_duplicates(read(spark, sf_dir).select("doc_id", "text"))
    return done.select(
        F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"), "n_near",
    )


def op9_topk(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20, scale=64)


def op10_quality(spark, sf_dir):
    return compression.classify(read(spark, sf_dir), read(spark, sf_dir, "labels"), label="quality", threshold=0.3)


def op11_clusters(spark, sf_dir):
    return simplex.cluster(read(spark, sf_dir, "embeddings"), dims=64, k=8, rounds=10, scale=1024, salt="3")


def op12_ranked_search(spark, sf_dir):
    return ranked.ranked_search(read(spark, sf_dir), read(spark, sf_dir, "benchmark"), k=20)


def op13_records(spark, sf_dir):
    path = shared_folder(spark, "token-records")
    records.write_records(read(spark, sf_dir), path, packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    return records.read_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {
    x.__name__: x
    for x in (
        op1_mixing, op2_line_dedup, op3_secrets, op4_packing, op5_suffix_dedup, op6_sharding, op7_quality_rules, op8_simhash,
        op9_topk, op10_quality, op11_clusters, op12_ranked_search, op13_records,
    )
}
