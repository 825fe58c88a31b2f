"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, classifier, divergence, gif, licenses, mixing, ngram_join, packing, pii, quality_rules, secret_scan, token_files, vector_codes


#: Stands in for a secret that a deployment would read from its vault.
PII_KEY = "quire-demonstration-key"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("pii", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return pii.pseudonymise(docs, key=PII_KEY).select("doc_id", "text", *(count(k) for k in pii.KINDS))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs, quality_rules.references(docs)).drop("text", "lang")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(_read(spark, sf_dir, "documents")).schedule()


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    made = chat.windows(rows).select("conv_id", "window", F.length("formatted").alias("chars"), chat.read_turns(F.col("formatted"), F.col("repeated")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = made.select("conv_id", F.struct("window", F.size("turns").alias("n"), written.alias("text"), "loss").alias("w"), "chars")
    whole = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return whole.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"),
        F.sha2(joined("text"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_windows",
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(licenses.planted(), "doc_id long, text string")
    found = licenses.find(_read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(planted))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = classifier.train(docs, labels.where(~held_out))
    scored = classifier.score(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    images = gif.encode(docs).drop("text")
    payload = F.col("payload")
    seen = F.expr("aggregate(frames, array_repeat(0L, 64), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))")
    last = F.element_at("frames", -1)
    return gif.decode(images).select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), last["start_ms"] + last["delay_ms"]), F.concat(F.lit("colours="), F.array_join(seen.cast("array<string>"), ","))).alias("feature"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, words=secret_scan.learn(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in secret_scan.KINDS),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.Codes(_read(spark, sf_dir, "embeddings"))
    return made.coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.Audit(_read(spark, sf_dir, "documents")).report()


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return files.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_ngram_join, op2_pii, op3_quality_rules, op4_mixing, op5_chat, op6_licenses, op7_classifier, op8_gif, op9_packing, op10_secrets, op11_vector_codes, op12_divergence, op13_token_files)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_licenses": licenses.oracle("doc_id, digest, licence, coalesce(notices, '') AS notices"),
        "op11_vector_codes": vector_codes.oracle(),
        "op12_divergence": divergence.ORACLE,
    }
