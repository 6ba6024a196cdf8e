"""Transcripts as text to read. Every line is a row (recording, section, part, line_no, line), so that a text of any length is written line by line,
in order; only a turn, or the turns of one speaker in a row, is ever held as a whole."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearweave.functions import columns as C
from hearweave.operators import windows as W

WIDTH, LEAST_WIDTH = 78, 20
ORDER = ("section", "part", "line_no")
# Wording of the texts.
NO_WORDS, NOBODY, NO_TIME = "This recording produced no words.", "Unknown speaker", "--:--"


def wrapped(width: int) -> Callable[[Column], Column]:
    """Lines of a text, words kept whole where they fit; an empty text is one empty line."""

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        return pd.Series([textwrap.wrap(t or "", width=max(LEAST_WIDTH, width)) or [""] for t in texts], dtype=object)

    return lines


def _numbered(df: DataFrame, section: int, part: str, lines: Column) -> DataFrame:
    each = df.select("recording", F.lit(section).alias("section"), F.col(part).cast("long").alias("part"), F.posexplode(lines).alias("line_no", "line"))
    return each.withColumn("line_no", F.col("line_no").cast("long"))


def listed(names: Column) -> Column:
    """a, b and c; none if there are none."""
    many = F.concat(F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(names, -1))
    return F.when(F.size(names) < 1, "none").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(many)


def plain_lines(words: DataFrame, headers: DataFrame, speakers: DataFrame, width: int = WIDTH) -> DataFrame:
    """The literal text by turns, each under its time and its speaker's name.

    words: recording, pos, text (as it is shown; empty ones are left out), start, speaker (null goes with the turn it stands in). headers: recording, name, duration,
    transcribed, services (names in order; null: none); a recording without a header has no text. speakers: recording, speaker, name;
    one without a name is called by its label.
    """
    w = W.by("recording")
    carried = F.coalesce("speaker", F.last("speaker", ignorenulls=True).over(W.before(w)))
    own = words.select("recording", "pos", "text", "start", carried.alias("speaker"))
    change = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.row_number().over(w) == 1)
    turns = W.joined_text(own.withColumn("turn", W.islands(change, w)).withColumn("text", F.nullif("text", F.lit(""))), ("recording", "turn"))
    heads = own.withColumn("turn", W.islands(change, w)).groupBy("recording", "turn").agg(F.min_by(F.struct("start", "speaker"), "pos").alias("h"))
    said = turns.join(heads, ["recording", "turn"]).where("body != ''").select("recording", "turn", "body", "h.*")
    said = said.join(headers.select("recording"), "recording", "left_semi").join(speakers, ["recording", "speaker"], "left")
    name = F.when(F.col("speaker").isNull(), NOBODY).otherwise(F.coalesce("name", F.concat(F.lit("Speaker "), "speaker")))
    time = F.when(F.col("start").isNull(), NO_TIME).otherwise(C.clock(F.col("start")))
    heading = F.concat(F.lit("["), time, F.lit("] "), name, F.lit(":"))
    body = _numbered(said.withColumn("_w", wrapped(width)("body")), 1, "turn", F.concat(F.array(F.lit(""), heading), "_w"))
    text = lambda label, value: F.concat(F.lit(label + ": "), value)
    services = listed(F.coalesce("services", F.array().cast("array<string>")))
    lines = F.array_compact(
        F.array(
            text("Recording", F.coalesce("name", F.lit(""))), F.when(F.col("duration").isNotNull(), text("Length", C.clock(F.col("duration")))),
            F.when(F.col("transcribed") != "", text("Transcribed", C.readable_time(F.col("transcribed")))), text("Services", services),
        )
    )
    head = _numbered(headers.withColumn("_p", F.lit(0)), 0, "_p", lines)
    silent = headers.join(words.select("recording").distinct(), "recording", "left_anti").withColumn("_p", F.lit(0))
    return head.unionByName(body).unionByName(_numbered(silent, 1, "_p", F.array(F.lit(""), F.lit(NO_WORDS))))


def smooth_lines(turns: DataFrame, headers: DataFrame, warnings: DataFrame, width: int = WIDTH) -> DataFrame:
    """The edited text: speakers' names over what they say, without times.

    turns: recording, part, number, speaker, text; empty ones are dropped, and then neighbours of one speaker are joined, but across no warning.
    warnings: recording, part, warning; each stands in front of its part. headers: recording, name, model (null or empty if unknown).
    """
    said = turns.where("text != ''").select("recording", "part", F.lit(1).alias("k"), F.col("number").cast("long").alias("number"), "speaker", "text")
    warned = warnings.where("warning is not null").select(
        "recording", "part", F.lit(0).alias("k"), F.lit(0).cast("long").alias("number"), F.lit(None).cast("string").alias("speaker"), F.concat(F.lit("[WARNING: "), "warning", F.lit("]")).alias("text")
    )
    w = Window.partitionBy("recording").orderBy("part", "k", "number")
    rows = said.unionByName(warned).join(headers.select("recording"), "recording", "left_semi")
    change = (F.col("k") == 0) | ~F.lag("k").over(w).eqNullSafe(1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    blocks = rows.withColumns({"block": W.islands(change, w), "_at": F.row_number().over(w)})
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), " ")
    whole = blocks.groupBy("recording", "block").agg(F.min("k").alias("k"), F.first("speaker").alias("speaker"), texts.alias("body")).withColumn("_w", wrapped(width)("body"))
    heading = F.when(F.col("k") == 0, F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.concat(F.coalesce("speaker", F.lit(NOBODY)), F.lit(":"))))
    by = F.when(F.col("model") != "", F.concat(F.lit(" by "), "model")).otherwise("")
    edited = F.concat(F.lit("Edited"), by, F.lit(" for easy reading. transcript.txt holds the literal words."))
    head = _numbered(headers.withColumn("_p", F.lit(0)), 0, "_p", F.array(F.concat(F.lit("Recording: "), F.coalesce("name", F.lit(""))), edited))
    return head.unionByName(_numbered(whole, 1, "block", F.concat(heading, "_w")))


def write_texts(lines: DataFrame, path: str) -> None:
    """A folder of one text file for each recording, its lines in order; a task sorts and streams them, so no text is held in memory."""
    ordered = lines.repartition("recording").sortWithinPartitions("recording", *ORDER)
    ordered.select("recording", F.col("line").alias("value")).write.mode("append").partitionBy("recording").text(path)
