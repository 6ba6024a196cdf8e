"""Chunks of one recording stitched to one list of words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal words that a text seam needs; words a second that speech has at most.
LEAST_RUN, WORDS_A_SECOND = 3, 6


def seams(chunks: DataFrame) -> DataFrame:
    """Each chunk with the end of the one before and how they meet: first, abutting or overlapping."""
    w = Window.partitionBy("recording", "provider").orderBy("chunk")
    was = F.lag("end").over(w)
    kind = F.when(was.isNull(), "first").when(F.abs(was - F.col("start")) <= 1e-6, "abutting").otherwise("overlapping")
    return chunks.withColumns({"was_end": was, "seam": kind, "overlap": F.greatest(F.lit(0.0), was - F.col("start"))})


def by_time(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words of timed chunks: at each overlap, those whose middle is before its middle come from the
    earlier chunk and the others from the later one. chunks: recording, provider, chunk, start, end."""
    c = seams(chunks)
    w = Window.partitionBy("recording", "provider").orderBy("chunk")
    low = F.when(F.col("seam") == "overlapping", (F.col("start") + F.col("was_end")) / 2)
    cut = c.withColumn("low", low).withColumn("high", F.lead("low").over(w)).select("recording", "provider", "chunk", "low", "high")
    middle = (F.col("start") + F.col("end")) / 2
    kept = (F.col("low").isNull() | (middle >= F.col("low"))) & (F.col("high").isNull() | (middle < F.col("high")))
    order = Window.partitionBy("recording", "provider").orderBy("chunk", "token_index")
    out = tokens.join(cut, ["recording", "provider", "chunk"]).where(kept).drop("low", "high")
    return out.withColumn("token_index", (F.row_number().over(order) - 1).cast("long"))


def text_seam(before: list[str], after: list[str], overlap: float) -> tuple[int, int, str]:
    """How many words to keep of before and to skip of after, and how that was found.

    The longest run of LEAST_RUN or more equal forms that ends before and starts within the first words
    of after that the overlap can hold; without one, the overlap's share of both is halved.
    """
    reach = min(len(after), math.ceil(overlap * WORDS_A_SECOND))
    best = (0, 0)
    # a run ends with the last word of before
    ends = [k for k, word in enumerate(after) if before and word == before[-1]]
    for start in range(reach if ends else 0):
        n = 0
        for end in reversed(ends):
            length = end - start + 1
            if length < LEAST_RUN:
                break
            if length <= len(before) and before[-length:] == after[start : end + 1]:
                n = length
                break
        if n > best[0]:
            best = (n, start)
    if best[0]:
        return len(before), best[0] + best[1], "matched"
    return len(before), min(len(after), round(reach / 2)), "uncertain"


def by_text(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """seam log of untimed chunks: recording, provider, chunk, skipped, how. Each seam sees only the last
    and first words that its overlap can hold. tokens: recording, provider, chunk, token_index, form."""
    s = seams(chunks).where("seam = 'overlapping'").select(F.col("recording").alias("_recording"), F.col("provider").alias("_provider"), F.col("chunk").alias("_chunk"), "overlap")

    def join(words: pa.Table, met: pa.Table) -> pa.Table:
        found: dict[str, list] = {name: [] for name in schema.names}
        for provider in pc.unique(met["_provider"]).to_pylist():
            seen = met.filter(pc.equal(met["_provider"], provider)).sort_by("_chunk")
            own = words.filter(pc.equal(words["provider"], provider)).sort_by([("chunk", "ascending"), ("token_index", "ascending")])
            chunk, index, form = own["chunk"].to_numpy(), own["token_index"].to_numpy(), own["form"].to_pylist()
            for k, overlap in zip(seen["_chunk"].to_pylist(), seen["overlap"].to_pylist()):
                low, mid, high = np.searchsorted(chunk, (k - 1, k, k + 1)).tolist()
                most = math.ceil(overlap * WORDS_A_SECOND) * 2
                first = low + int(np.searchsorted(index[low:mid], mid - low - most))
                last = mid + int(np.searchsorted(index[mid:high], most))
                if first < mid or mid < last:
                    _, skip, how = text_seam(form[first:mid], form[mid:last], overlap)
                    for name, value in zip(schema.names, (met["_recording"][0].as_py(), provider, k, skip, how)):
                        found[name].append(value)
        return pa.table(found, schema=schema)

    schema = pa.schema([("recording", pa.int64()), ("provider", pa.string()), ("chunk", pa.int64()), ("skipped", pa.int64()), ("how", pa.string())])
    # all words and seams of a recording meet in one call, so words are dealt by recording alone
    own = tokens.select("recording", "provider", "chunk", "token_index", "form").groupBy("recording")
    return own.cogroup(s.groupBy("_recording")).applyInArrow(join, "recording long, provider string, chunk long, skipped long, how string")
