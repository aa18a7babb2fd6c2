"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm import quality_model
from cardmill.llm.common import documents, labels, whole
from cardmill.llm.divergence import source_divergence
from cardmill.llm.lexical import search
from cardmill.llm.line_dedup import remove_repeated_runs
from cardmill.llm.mpeg import mpeg_decode, mpeg_encode
from cardmill.llm.oracles import LINE_DEDUP, QUALITY_RULES, RANKED_SEARCH, SOURCE_DIVERGENCE, SUBSTRING_DEDUP
from cardmill.llm.packing import pack_documents
from cardmill.llm.passages import remove_repeated_passages
from cardmill.llm.pieces import decode, encode_documents, load_pieces
from cardmill.llm.quality import quality_rules
from cardmill.llm.secrets import PATTERNS, scan_secrets, told
from cardmill.llm.sharding import shard_documents
from cardmill.llm.simhash import hexadecimal, near_duplicates
from cardmill.llm.toxicity import fit, held_out, score_documents

Query = Callable[[SparkSession, str], DataFrame]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    base = of(*PATTERNS)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(spans).alias("spans")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir))
    return score_documents(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_threshold").alias("threshold"),
        (F.col("_score") >= F.col("_threshold")).alias("rejected"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(documents(spark, sf_dir), 13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = whole("text").cast("binary")
    fill = F.when(F.octet_length(payload) == 0, 64).otherwise(F.pmod(-F.octet_length(payload), F.lit(64)))
    padded = F.concat(payload, F.unhex(F.repeat(F.lit("00"), fill)))
    stored = documents(spark, sf_dir).select(
        "doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), mpeg_encode(padded).alias("media")
    )
    read = stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        mpeg_decode("media").alias("audio"),
    )
    audio = F.col("audio")
    back = audio["payload"]
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(back).cast("long").alias("payload_bytes"),
        F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            ";",
            F.concat_ws("/", audio["version"], audio["layer"], audio["sample_rate"], audio["channels"]),
            audio["frames"],
            audio["samples"],
            audio["checked"],
            audio["bad_checksums"],
            audio["variable_bitrate"],
            F.element_at(audio["seek_offsets"], -1),
        ).alias("feature"),
        audio["frames"].alias("frames"),
        audio["duration_s"].alias("duration_s"),
        audio["promised_frames"].alias("promised_frames"),
        audio["unsynchronised_bytes"].alias("unsynchronised_bytes"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_runs(documents(spark, sf_dir), 3, 50)
    return kept.select(
        "doc_id",
        (F.col("n_chars") - F.char_length(whole("text"))).alias("n_removed_chars"),
        F.sha2(whole("text"), 256).alias("kept_sha256"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, pieces = documents(spark, sf_dir), load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode_documents(docs, pieces)
    back = decode("ids", pieces)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(back, 256).alias("decoded_sha256"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_vocabulary(), 1024, 2)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir), 3, 200)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.fit(docs, labels(spark, sf_dir))
    return quality_model.score_quality(docs, model).select(
        "doc_id",
        quality_model.held_out("doc_id").alias("held_out"),
        F.col("_quality").alias("score"),
        (F.col("_quality") >= quality_model.CUT).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_classifier": op13_quality_classifier,
}

#: SQL for the operators that DuckDB can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op7_quality_rules": QUALITY_RULES,
    "op8_line_dedup": LINE_DEDUP,
    "op11_lexical_search": RANKED_SEARCH,
    "op12_source_divergence": SOURCE_DIVERGENCE,
}
