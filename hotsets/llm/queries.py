"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from hotsets.llm import chat, decontam, hostrules, licenses, linededup, merkle, packing, prefixtrie, quality, simhash, toxicity, urlfilter, winnow
from hotsets.llm.common import handoff, table
from hotsets.llm.ranks import ranked


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.fingerprint_edits(table(spark, sf_dir, "documents"), gram=4, window=8)
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        winnow.marks_text(F.col("marks")).alias("fingerprint"),
                        winnow.marks_text(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_report(table(spark, sf_dir, "documents"), min_words=3, min_near_words=5, min_chars=20)
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scores = [F.col(c).alias("score" if c == "toxic" else f"{c}_score") for c in toxicity.CHAIN]
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), *scores, (F.col("toxic") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = decontam.n_hit(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), size=4096, end_id=2)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.col("places.start")
    both = F.array_union("places.label", "found.label")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
                        F.array_join(F.array_sort(both), ",").alias("labels"), F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("score"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.union(extra), _vocabulary("byte_bpe_50k.json")))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hostrules.judge_documents(table(spark, sf_dir, "documents"), max_rate=0.5)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_blocked")


def shared_beginnings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations of which each begins with the first h turns of the first of its hundred
    (h: CRC-32 of its decimal id, modulo 6) and goes on with its own turns after its first h.

    A conversation without an id keeps its turns.
    """
    h = F.coalesce(F.crc32(F.col("conv").cast("string")) % 6, F.lit(0))
    placed = ranked(prefixtrie.turn_digests(rows), ["conv"], ["turn", "digest"])
    ids = handoff(placed.select("conv").distinct())
    placed = placed.select("conv", F.col("pos").alias("turn"), "digest", "chars")
    first = placed.where("turn < 5 and conv is not null").withColumnRenamed("conv", "base")
    begun = ids.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base")).join(first, "base").where("turn < h")
    turns = (begun.select("conv", F.lit(0).alias("part"), "turn", "digest", "chars")
             .union(placed.where(F.col("turn") >= h).select("conv", F.lit(1), "turn", "digest", "chars")))
    known = F.coalesce("conv", F.lit(prefixtrie.NO_ID)).alias("conv")
    return turns.select(known, "part", "turn", "digest", "chars"), ids.select(known)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(*shared_beginnings(table(spark, sf_dir, "conversations")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, folded again after one in seven rows was changed."""
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"),
                       changed.alias("changed"))
    found = merkle.dataset_manifest(rows, arity=2).withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


REGISTRY = {
    "op1_simhash": op1_simhash,
    "op2_winnowing": op2_winnowing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_url_filter": op9_url_filter,
    "op10_chat": op10_chat,
    "op11_host_rules": op11_host_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle": op13_merkle,
}
