"""Recordings and transcript documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("m4a", "mp3", "wav", "flac")

TOKEN = (
    "text string, start double, end double, speaker string, language string, confidence_strength string, text_confidence string, "
    "timing_confidence string, speaker_confidence string, review_status string, review_reasons array<string>, original_text string"
)
DOCUMENT = f"format int, recording_name string, duration double, language string, tokens array<struct<{TOKEN.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>"


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, bytes, changed of the audio files right in folder, by name."""
    files = spark.read.format("binaryFile").load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
    return out.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*AUDIO)).orderBy(F.lower("name"))


def parsed_documents(raw: DataFrame, body: str = "body") -> DataFrame:
    """Transcripts from JSON texts: fields that are missing or of another type have their defaults; a
    document without the name of a recording is dropped."""
    return raw.select(F.from_json(body, DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).select("d.*").where("recording_name is not null")


def words_of(documents: DataFrame) -> DataFrame:
    """The words of transcripts in order; a strength that is no number within 0 and 1 is null."""
    rows = documents.select(F.col("recording_name").alias("recording"), F.posexplode("tokens").alias("pos", "t")).select("recording", "pos", "t.*")
    strength = F.expr("try_cast(confidence_strength as double)")
    valid = (strength >= 0) & (strength <= 1)
    return rows.select(
        "recording", F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), "start", "end", F.when(F.col("speaker") != "", F.col("speaker")).alias("speaker"),
        F.coalesce("language", F.lit("unknown")).alias("language"), F.when(valid, strength).alias("strength"), F.coalesce("text_confidence", F.lit("unresolved")).alias("text_confidence"),
        F.coalesce("review_reasons", F.array().cast("array<string>")).alias("reasons"), "original_text",
    )


def documents_of(words: DataFrame, keys: tuple[str, ...] = ("recording",)) -> DataFrame:
    """Transcripts as JSON texts, words nested in order: recording, body."""
    rest = [c for c in words.columns if c not in (*keys, "pos")]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", *rest))), lambda x: F.struct(*(x[c].alias(c) for c in rest)))
    return words.groupBy(*keys).agg(ordered.alias("tokens")).select(*keys, F.to_json(F.struct(F.lit(1).alias("format"), F.col(keys[-1]).cast("string").alias("recording_name"), "tokens")).alias("body"))


def write_documents(bodies: DataFrame, path: str, by: str = "folder") -> None:
    bodies.write.mode("append").partitionBy(by).text(path) if by in bodies.columns else bodies.select("body").write.mode("append").text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder of text for each recording."""
    reports.select("recording", "body").write.mode("append").partitionBy("recording").text(path)
