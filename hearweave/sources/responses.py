"""Readers of services' raw answers: JSON or text in, one schema of tokens out.

raw: recording, offset (seconds of the chunk in the recording), body (the answer). Broken JSON gives no
tokens. All readers end in: recording, provider, token_index, text, start, end, speaker, log_probability,
confidence, language, is_punctuation, is_audio_event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearweave.functions import columns as C

COLUMNS = ("recording", "provider", "token_index", "text", "start", "end", "speaker", "log_probability", "confidence", "language", "is_punctuation", "is_audio_event")


def _finished(df: DataFrame, provider: str, **given: Column) -> DataFrame:
    none = {"start": "double", "end": "double", "speaker": "string", "log_probability": "double", "confidence": "double", "language": "string"}
    values = {c: F.lit(None).cast(kind) for c, kind in none.items()} | given
    values.setdefault("is_punctuation", C.is_punctuation_only(values["text"]))
    values.setdefault("is_audio_event", F.lit(False))
    return df.select("recording", F.lit(provider).alias("provider"), F.col("k").cast("long").alias("token_index"), *(values[c].alias(c) for c in COLUMNS[3:]))


def elevenlabs(raw: DataFrame) -> DataFrame:
    """Words with type, seconds, speaker_id and logprob; an end before its start is the start."""
    schema = "language_code string, words array<struct<text string, type string, start double, end double, speaker_id string, logprob double>>"
    rows = raw.withColumn("_a", F.from_json("body", schema)).select("*", F.posexplode("_a.words").alias("k", "w"))
    kind, start = F.col("w.type"), F.col("w.start") + F.col("offset")
    return _finished(
        rows, "elevenlabs", text=F.coalesce("w.text", F.lit("")), start=start, end=F.greatest(start, F.col("w.end") + F.col("offset")), speaker=F.col("w.speaker_id"),
        log_probability=F.col("w.logprob"), language=C.language_of(F.col("_a.language_code")), is_punctuation=kind.isin("spacing", "punctuation"), is_audio_event=kind == "audio_event",
    )


def openai(raw: DataFrame) -> DataFrame:
    """Plain text: words between blanks, without times."""
    words = F.filter(F.split("body", r"\s+"), lambda x: x != "")
    return _finished(raw.select("recording", F.posexplode(words).alias("k", "w")), "openai", text=F.col("w"))


def microsoft(raw: DataFrame) -> DataFrame:
    """Phrases with a locale and milliseconds; phrases without words are cut at blanks, untimed."""
    schema = "phrases array<struct<text string, locale string, words array<struct<text string, offsetMilliseconds long, durationMilliseconds long>>>>"
    phrases = raw.withColumn("_a", F.from_json("body", schema)).select("recording", "offset", F.posexplode("_a.phrases").alias("p", "ph"))
    plain = F.transform(F.filter(F.split("ph.text", r"\s+"), lambda x: x != ""), lambda x: F.struct(x.alias("text"), F.lit(None).cast("long").alias("offsetMilliseconds"), F.lit(None).cast("long").alias("durationMilliseconds")))
    words = F.when(F.size("ph.words") > 0, F.col("ph.words")).otherwise(plain)
    rows = phrases.select("recording", "offset", "p", F.col("ph.locale").alias("locale"), F.posexplode(words).alias("i", "w"))
    from pyspark.sql import Window

    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("recording", "offset").orderBy("p", "i")) - 1)
    start = F.col("w.offsetMilliseconds") / 1000 + F.col("offset")
    end = start + F.greatest(F.lit(0), "w.durationMilliseconds") / 1000
    return _finished(rows, "microsoft", text=F.col("w.text"), start=start, end=end, language=C.language_of(F.col("locale")))


def assemblyai(raw: DataFrame, slack: float = 1.0) -> DataFrame:
    """Words in milliseconds with letters for speakers. raw also has window_start and window_end, null for
    whole recordings: where all words lie within a window's length and end before its start, times count
    from the window."""
    schema = "words array<struct<text string, start long, end long, speaker string, confidence double>>"
    a = raw.withColumn("_w", F.from_json("body", schema)["words"]).withColumn("_last", F.array_max(F.transform("_w", lambda x: x["end"])) / 1000)
    inside = (F.col("_last") < F.col("window_start")) & (F.col("_last") <= F.col("window_end") - F.col("window_start") + slack)
    shift = F.when(inside, F.col("window_start")).otherwise(F.lit(0.0)) + F.col("offset")
    rows = a.select("recording", shift.alias("shift"), F.posexplode("_w").alias("k", "w"))
    start = F.col("w.start") / 1000 + F.col("shift")
    return _finished(rows, "assemblyai", text=F.coalesce("w.text", F.lit("")), start=start, end=F.greatest(start, F.col("w.end") / 1000 + F.col("shift")), speaker=F.col("w.speaker"), confidence=F.col("w.confidence"))


def deepgram(raw: DataFrame) -> DataFrame:
    """Words in seconds with numbers for speakers; the punctuated form is preferred."""
    schema = "words array<struct<word string, punctuated_word string, start double, end double, speaker int, confidence double>>"
    rows = raw.select("recording", "offset", F.posexplode(F.from_json("body", schema)["words"]).alias("k", "w"))
    start = F.col("w.start") + F.col("offset")
    return _finished(rows, "deepgram", text=F.coalesce("w.punctuated_word", "w.word", F.lit("")), start=start, end=F.greatest(start, F.col("w.end") + F.col("offset")), speaker=F.col("w.speaker").cast("string"), confidence=F.col("w.confidence"))
