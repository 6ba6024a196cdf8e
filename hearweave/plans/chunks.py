"""Recordings too large for a service, cut to chunks that overlap in speech and are halved where they are still too large.

Everything is a row for a chunk; levels, of which there are many, meet the few handovers by buckets of time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearweave.plans import reconcile

# The share of levels that are at most as loud as speech, how far below that is speech still, and the
# greatest share of a chunk that an overlap, a search or a tail may take.
SPEECH_SHARE, WITHIN, TENTH = 0.9, 20.0, 0.1


def handovers(planned: DataFrame, durations: DataFrame, search: float, least: float) -> DataFrame:
    """Where a chunk hands over to the next: recording, chunk (from 1), at.

    planned: recording, boundary (from 1), planned, at (a quiet moment near planned). In order, no chunk gets shorter than least, none reaches
    search beyond its plan, and no tail shorter than least is left; the first boundary that cannot be so ends the list.
    """
    ordered = F.array_sort(F.collect_list(F.struct("boundary", F.col("planned"), F.col("at"))))
    d = F.col("duration")

    def step(done: Column, b: Column) -> Column:
        at = F.least(F.greatest(b["at"], done["last"] + least), b["planned"] + search, d - least)
        over = done["over"] | (d - b["planned"] <= least) | (at <= done["last"])
        kept = F.struct(F.concat(done["places"], F.array(at)).alias("places"), at.alias("last"), over.alias("over"))
        ended = F.struct(done["places"].alias("places"), done["last"].alias("last"), over.alias("over"))
        return F.when(over, ended).otherwise(kept)

    none = F.struct(F.array().cast("array<double>").alias("places"), F.lit(0.0).alias("last"), F.lit(False).alias("over"))
    folded = planned.groupBy("recording").agg(ordered.alias("_b")).join(durations, "recording")
    places = F.aggregate("_b", none, step)["places"]
    return folded.select("recording", F.posexplode(places).alias("chunk", "at")).withColumn("chunk", F.col("chunk").cast("long") + 1)


def speech_levels(levels: DataFrame) -> DataFrame:
    """What the spoken parts of each recording measure: the level that SPEECH_SHARE of its windows lie below."""
    w = Window.partitionBy("recording")
    ranked = levels.withColumns({"_k": F.row_number().over(w.orderBy("level")), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_k") == F.least("_n", F.floor(F.col("_n") * SPEECH_SHARE) + 1)).select("recording", F.col("level").alias("speech"))


def overlaps(places: DataFrame, levels: DataFrame, least: float, most: float, window: float, wanted: float) -> DataFrame:
    """places with overlap: how far a chunk reaches back over its handover, so that wanted seconds of speech lie in it; from least to most. A
    recording without levels has least. levels: recording, t (start of a window of that many seconds), level; one moment is measured once."""
    if wanted <= 0 or most <= least:
        return places.withColumn("overlap", F.lit(float(least)))
    loud = levels.join(speech_levels(levels), "recording").where(F.col("level") > F.col("speech") - WITHIN).select("recording", "t", F.floor(F.col("t") / most).alias("bucket"))
    reach = F.sequence(F.floor((F.col("at") - most) / most), F.floor(F.col("at") / most))
    near = places.withColumn("bucket", F.explode(reach)).join(loud, ["recording", "bucket"]).where((F.col("t") >= F.col("at") - most) & (F.col("t") < F.col("at")))
    nearest = F.row_number().over(Window.partitionBy("recording", "chunk").orderBy(F.desc("t")))
    heard = near.withColumn("k", nearest).where(F.round((F.col("k") - 1) * window, 9) < wanted)
    far = heard.groupBy("recording", "chunk").agg(F.max(F.col("at") - F.col("t")).alias("far"))
    overlap = F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce("far", F.lit(least))))
    return places.join(far, ["recording", "chunk"], "left").withColumn("overlap", overlap).drop("far")


def cut(durations: DataFrame, places: DataFrame) -> DataFrame:
    """Chunks from places (with overlap) on: recording, chunk (from 0), start, end, overlap. A recording without places is one chunk."""
    zero = F.lit(0.0)
    first = durations.select("recording", F.lit(0).cast("long").alias("chunk"), zero.alias("at"), zero.alias("overlap"))
    w = Window.partitionBy("recording").orderBy("chunk")
    rows = first.unionByName(places.select("recording", "chunk", "at", F.least("overlap", "at").alias("overlap"))).join(durations, "recording")
    end = F.coalesce(F.lead("at").over(w), F.col("duration"))
    return rows.select("recording", "chunk", (F.col("at") - F.col("overlap")).alias("start"), end.alias("end"), "overlap")


def halved(chunks: DataFrame, repeat: float, most_bytes: float) -> DataFrame:
    """Chunks of more than most_bytes cut in halves, these again, until every piece fits: recording, chunk (numbered anew), start, end, overlap, fits.

    A piece of a second or less is not cut further, so it may not fit. chunks also have bytes_per_second, as measured, which must be above zero or null (never cut). A second half starts up to repeat seconds before the middle,
    a quarter of what is halved at most, so pieces shrink by a quarter at least each time.
    """
    piece = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("overlap").alias("overlap"))
    rate = F.col("bytes_per_second")

    def pieces(p: Column) -> Column:
        length = p["end"] - p["start"]
        middle, back = (p["start"] + p["end"]) / 2, F.least(F.lit(float(max(0.0, repeat))), length / 4)
        left = F.struct(p["start"].alias("start"), middle.alias("end"), p["overlap"].alias("overlap"))
        right = F.struct((middle - back).alias("start"), p["end"].alias("end"), back.alias("overlap"))
        return F.when(F.coalesce((length * rate > most_bytes) & (length > 1.0), F.lit(False)), F.array(left, right)).otherwise(F.array(p))

    size = (F.col("end") - F.col("start")) * rate
    times = F.when(size > most_bytes, F.ceil(F.log(size / most_bytes) / math.log(4 / 3)) + 1).otherwise(0).cast("int")
    rounds = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    split = F.aggregate(rounds, F.array(piece), lambda done, _: F.flatten(F.transform(done, pieces)))
    out = chunks.select("recording", F.col("chunk").alias("_c"), rate.alias("_rate"), F.posexplode(split).alias("_p", "x"))
    number = F.row_number().over(Window.partitionBy("recording").orderBy("_c", "_p")).cast("long") - 1
    return out.select("recording", number.alias("chunk"), "x.start", "x.end", "x.overlap", F.coalesce((F.col("x.end") - F.col("x.start")) * F.col("_rate") <= most_bytes, F.lit(True)).alias("fits"))


def chunks(levels: DataFrame, longest: float, length: float, search: float, shortest: float, overlap: tuple[float, float], window: float, wanted: float) -> DataFrame:
    """All chunks of all recordings: planned about length apart, at quiet moments, with speech in their overlaps. longest: what a service takes; overlap: the least and the
    most a chunk repeats. Searches, overlaps and least chunks are a tenth of longest at most. A recording of at most longest stays whole."""
    tenth = longest * TENTH
    search, shortest, low = min(search, tenth), min(shortest, tenth), min(overlap[0], tenth)
    durations = levels.groupBy("recording").agg(F.max("t").alias("duration"))
    large = durations.where(F.col("duration") > longest)
    heard = levels.join(large.select("recording"), "recording", "left_semi")
    places = handovers(reconcile.chunk_plan(heard, length, search), large, search, shortest)
    return cut(durations, overlaps(places, heard, low, min(max(overlap[1], low), tenth), window, wanted))
