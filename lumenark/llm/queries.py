"""The registered queries of this subpackage: thin views of the operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import centroids, chat, decontamination, jaccard, license_scan, packing, phrases, pii, quality_classifier, quality_rules, secret_scan, storage, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    failed = (F.col("failed").bitwiseAND(F.lit(quality_rules.POLICIES["base"].mask)) != 0).alias("base_failed")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, quality_rules.verdict(), F.col("failed").alias("failed_bits"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    places = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["rule"], m["first"], m["last"])), ",")
    return found.select("doc_id", "n_sentences", "n_known", F.size("matches").cast("bigint").alias("n_matches"), names.alias("licenses"), places.alias("matches"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), jaccard.Spec(k=4, num=85, den=100))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, with_payload=False).where("record_type IS NOT NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _chat_log(rows: DataFrame) -> DataFrame:
    """The log that leads to the rows: assistants stream a draft, start again and stream the text in two parts; others send a first version and edit it."""
    # Rows that share a turn are messages of their own.
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text, half = F.coalesce("text", F.lit("")), (F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    event = lambda k, kind, t: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), t.alias("t"))
    streamed = F.array(event(0, "delta", F.lit("a draft <|")), event(1, "regenerate", F.lit("")), event(2, "delta", F.left(text, half)), event(3, "delta", F.substring(text, half + 1, F.length(text))))
    edited = F.array(event(0, "message", F.lit("a first version")), event(1, "edit", text))
    log = rows.withColumn("nth", nth).withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return log.select("conv_id", "turn", "nth", F.struct("turn", "e.k").alias("seq"), "e.kind", "role", F.col("e.t").alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.format_events(_chat_log(rows), message=("turn", "nth"), seq="seq")
    turns = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = chat.loss_text(F.col("formatted"), F.col("loss"))
    return out.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(under).cast("bigint").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(centroids.cluster(_table(spark, sf_dir, "embeddings")))


#: Rules of op13, the longest first to win.
URL_RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    listed = url_filter.cascade(url_filter.all_keys(pages), url_filter.tracked_keys(pages))
    return url_filter.judge(pages, URL_RULES, listed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_license_scan": op3_license_scan,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard": op6_jaccard,
        "op7_pii": op7_pii,
        "op8_warc": op8_warc,
        "op9_chat": op9_chat,
        "op10_packing": op10_packing,
        "op11_phrases": op11_phrases,
        "op12_centroids": op12_centroids,
        "op13_url_filter": op13_url_filter,
    }
