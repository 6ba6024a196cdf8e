"""Ordered operators over the words of a recording. Each sorts a recording once; rows of one recording
number some ten thousand, so a window's partition stays small however many recordings there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearweave.functions import columns as C


def by(*keys: str, order: tuple[str, ...] = ("pos",)) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def until(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def following(w: Window) -> Window:
    return w.rowsBetween(0, Window.unboundedFollowing)


def next_known(value: str, keys: tuple[str, ...], order: tuple[str, ...] = ("pos",)) -> Column:
    """The first value that is known in the rows behind. A frame of all rows behind is read anew for each row; this passes each once."""
    names = lambda cols: ", ".join(f"`{c}`" for c in cols)
    return F.expr(f"lead(`{value}`) IGNORE NULLS OVER (PARTITION BY {names(keys)} ORDER BY {names(order)})")


def islands(change: Column, w: Window) -> Column:
    """Numbers runs: a new one wherever change holds."""
    return F.sum(F.when(change, 1).otherwise(0)).over(until(w)).cast("long")


def running_number(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], to: str = "token_index") -> DataFrame:
    """Numbers words from 0 across chunks."""
    return df.withColumn(to, (F.row_number().over(by(*keys, order=order)) - 1).cast("long"))


def attach_punctuation(df: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """Words with the marks that follow them: (keys, group, text, marks). Leading marks go to the first word."""
    w = by(*keys)
    word = ~C.is_punctuation_only(F.col(text))
    g = F.greatest(F.sum(word.cast("long")).over(until(w)), F.lit(1))
    rows = df.select(*keys, "pos", F.col(text).alias("_t"), word.alias("_w"), g.alias("group"))
    first = F.min(F.when(F.col("_w"), F.struct("pos", "_t")))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_w"), F.struct("pos", "_t")))), lambda x: x["_t"]), "")
    return rows.groupBy(*keys, "group").agg(first.alias("_f"), marks.alias("marks")).select(*keys, "group", F.col("_f._t").alias("text"), "marks")


def cut_flags(df: DataFrame, keys: tuple[str, ...], gap: float = 0.6) -> DataFrame:
    """cut: whether a region may end after the word: a sentence end, another speaker next, or a pause."""
    w = by(*keys)
    sentence = F.col("text").rlike(r"[.!?…][\"'”’)\]]*$")
    speaker = F.lead("speaker").over(w)
    turn = speaker.isNotNull() & F.col("speaker").isNotNull() & (speaker != F.col("speaker"))
    pause = F.coalesce(F.round(F.lead("start").over(w) - F.col("end"), 6) >= gap, F.lit(False))
    return df.withColumn("cut", sentence | F.coalesce(turn, F.lit(False)) | pause)


def neighbour_share(df: DataFrame, keys: tuple[str, ...], flag: str, reach: int, to: str) -> DataFrame:
    """The share of rows within reach on both sides, the row included, for which flag holds."""
    return df.withColumn(to, F.avg(F.col(flag).cast("double")).over(by(*keys).rowsBetween(-reach, reach)))


def column_quality(df: DataFrame, keys: tuple[str, ...], reach: int = 4) -> DataFrame:
    """quality of alignment columns from status, likeness and forced, and the agreement around them."""
    # What each kind of column is worth alone.
    base = {"exact": 1.0, "format_equivalent": 0.9, "merge": 0.8, "split": 0.8, "substitution": 0.5, "insertion": 0.3, "deletion": 0.3}
    value = F.lit(0.0)
    for status, v in base.items():
        value = F.when(F.col("status") == status, v).otherwise(value)
    agree = df.withColumn("_agree", F.col("status").isin("exact", "format_equivalent"))
    near = neighbour_share(agree, keys, "_agree", reach, "_near")
    likeness = F.when(F.col("status") == "substitution", 0.6 + 0.4 * F.col("likeness")).otherwise(1.0)
    forced = F.when(F.col("forced"), 0.85).otherwise(1.0)
    return near.withColumn("quality", C.clamp(value * (0.5 + 0.5 * F.col("_near")) * likeness * forced)).drop("_agree", "_near")


def speaker_boundaries(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """boundary: the label differs from the last one before that is known."""
    last = F.last("speaker", ignorenulls=True).over(before(by(*keys)))
    return df.withColumn("boundary", F.coalesce(F.col("speaker").isNotNull() & last.isNotNull() & (F.col("speaker") != last), F.lit(False)))


def overlapping_words(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """overlapping: the word starts before the last one of another speaker ends, or the next one does so."""
    w = by(*keys)

    def clash(a_end: Column, a_speaker: Column, b_start: Column, b_speaker: Column) -> Column:
        return F.coalesce((b_start < a_end) & (a_speaker != b_speaker), F.lit(False))

    first = clash(F.lag("end").over(w), F.lag("speaker").over(w), F.col("start"), F.col("speaker"))
    second = clash(F.col("end"), F.col("speaker"), F.lead("start").over(w), F.lead("speaker").over(w))
    return df.withColumn("overlapping", first | second)


def turns(df: DataFrame, keys: tuple[str, ...], carry: bool = False) -> DataFrame:
    """Runs of one speaker: keys, turn, speaker, start, end, n_words, words.

    Words without speaker or time are left out; with carry, an unknown speaker continues the run.
    """
    w = by(*keys)
    if carry:
        df = df.withColumn("speaker", F.coalesce("speaker", F.last("speaker", ignorenulls=True).over(before(w))))
        change = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.row_number().over(w) == 1)
    else:
        df = df.where("speaker is not null and start is not null")
        change = F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lit(True))
    runs = df.withColumn("turn", islands(change, w))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy(*keys, "turn").agg(
        F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words"), words.alias("words")
    )


def short_turns(runs: DataFrame, keys: tuple[str, ...], least: float = 1.0, many: int = 3) -> DataFrame:
    """Concerns about runs of turns below least seconds: one "frequent_changes" for many together, else
    a "very_short" each."""
    w = by(*keys, order=("turn",))
    short = F.col("end") - F.col("start") < least
    marked = runs.withColumn("_s", short).withColumn("_run", islands(~F.col("_s"), w)).where("_s")
    sized = marked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_run")))
    concern = F.when(F.col("_n") >= many, "frequent_changes").otherwise("very_short")
    group = F.when(F.col("_n") >= many, -F.col("_run")).otherwise(F.col("turn"))
    return sized.groupBy(*keys, concern.alias("concern"), group.alias("_g")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_turns")).drop("_g")


def context_words(df: DataFrame, keys: tuple[str, ...], reach: int = 4) -> DataFrame:
    """before and after: the words within reach on each side, joined."""
    w = by(*keys)
    # missing words are left out
    return df.withColumns(
        {
            "before": F.concat_ws(" ", *(F.lag("text", k).over(w) for k in range(reach, 0, -1))),
            "after": F.concat_ws(" ", *(F.lead("text", k).over(w) for k in range(1, reach + 1))),
        }
    )


def smoothed(df: DataFrame, keys: tuple[str, ...], value: str, to: str, reach: int = 4, fade: float = 0.6) -> DataFrame:
    """Sum of value * fade^distance over reach words on both sides."""
    w = by(*keys)
    terms = [F.col(value)]
    for k in range(1, reach + 1):
        terms += [F.coalesce(f(value, k).over(w), F.lit(0.0)) * fade**k for f in (F.lag, F.lead)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(to, total)


def present_near(df: DataFrame, keys: tuple[str, ...], flag: str, to: str, reach: int = 20) -> DataFrame:
    """Whether flag holds anywhere within reach positions on both sides."""
    return df.withColumn(to, F.max(F.col(flag).cast("int")).over(by(*keys).rowsBetween(-reach, reach)) == 1)


def repeated_beside(df: DataFrame, keys: tuple[str, ...], form: str) -> DataFrame:
    """repeated: the nearest word with a form on either side has this form."""
    full = df.withColumn("_full", F.when(F.col(form) != "", F.col(form)))
    left = F.last("_full", ignorenulls=True).over(before(by(*keys)))
    right = next_known("_full", keys)
    same = F.coalesce(left == F.col(form), F.lit(False)) | F.coalesce(right == F.col(form), F.lit(False))
    return full.withColumn("repeated", same & (F.col(form) != "")).drop("_full")


def sentence_starts(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """starts_sentence: the first word, and words after one that ends a sentence; blank words pass it on."""
    w = by(*keys)
    ends = F.when(F.trim("text") != "", F.col("text").rlike(r"[.!?…][\"'”’)\]]*$"))
    return df.withColumn("starts_sentence", F.coalesce(F.last(ends, ignorenulls=True).over(before(w)), F.lit(True)))


def runs_of(df: DataFrame, keys: tuple[str, ...], flag: str, to: str = "run") -> DataFrame:
    """Rows for which flag holds, with the number of their unbroken run."""
    return df.withColumn(to, islands(~F.col(flag), by(*keys))).where(F.col(flag))


def disputes(df: DataFrame, keys: tuple[str, ...], flag: str, batch: int = 30) -> DataFrame:
    """Runs of doubtful words and the batch of batch runs each goes in: keys, ordinal, first, last, text, batch."""
    runs = runs_of(df, keys, flag)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    spans = runs.groupBy(*keys, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), text.alias("text"))
    out = spans.withColumn("ordinal", (F.row_number().over(by(*keys, order=("first",))) - 1).cast("long"))
    return out.withColumn("batch", F.floor(F.col("ordinal") / batch)).drop("run")


def phrases_to_realign(df: DataFrame, keys: tuple[str, ...], flag: str, gap: float = 0.75, most: int = 300) -> DataFrame:
    """Runs of words that want alignment, parted by pauses over gap; the first most of each recording."""
    w = by(*keys)
    wanted = df.where(F.col(flag))
    pause = F.coalesce(F.round(F.col("start") - F.lag("end").over(w), 6) > gap, F.lit(True)) | F.coalesce(F.col("pos") - F.lag("pos").over(w) > 1, F.lit(False))
    runs = wanted.withColumn("phrase", islands(pause, w)).where(F.col("phrase") <= most)
    return runs.groupBy(*keys, "phrase").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words"))


def doubt_stretches(df: DataFrame, keys: tuple[str, ...], flag: str) -> DataFrame:
    """Stretches of words with a doubtful speaker, each with the pair of speakers in question: the
    word's own and the nearest other one (the earlier, if tied)."""
    w = by(*keys)
    runs = df.withColumn("_run", islands(F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lit(True)), w))
    edge = runs.groupBy(*keys, "_run").agg(F.first("speaker").alias("_s"), F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    e = by(*keys, order=("_run",))
    edge = edge.withColumns({"_ls": F.lag("_s").over(e), "_lp": F.lag("_b").over(e), "_rs": F.lead("_s").over(e), "_rp": F.lead("_a").over(e)})
    doubted = runs.where(F.col(flag) & F.col("speaker").isNotNull()).join(edge.select(*keys, "_run", "_ls", "_lp", "_rs", "_rp"), [*keys, "_run"])
    left = F.col("_ls").isNotNull() & (F.col("_rs").isNull() | (F.col("pos") - F.col("_lp") <= F.col("_rp") - F.col("pos")))
    other = F.when(left, F.col("_ls")).otherwise(F.col("_rs"))
    pair = F.array_join(F.array_sort(F.array_compact(F.array("speaker", other))), "/")
    paired = doubted.withColumn("pair", pair)
    new = F.coalesce((F.col("pair") != F.lag("pair").over(w)) | (F.col("pos") - F.lag("pos").over(w) > 1), F.lit(True))
    return paired.withColumn("stretch", islands(new, w)).groupBy(*keys, "stretch").agg(
        F.first("pair").alias("pair"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_words")
    )


def hang_rejected(df: DataFrame, keys: tuple[str, ...], kept: str) -> DataFrame:
    """For each rejected word, holder: the next kept word's pos, or the last one's."""
    w = by(*keys)
    place = F.when(F.col(kept), F.col("pos"))
    holder = F.coalesce(F.first(place, ignorenulls=True).over(following(w)), F.last(place, ignorenulls=True).over(until(w)))
    return df.withColumn("holder", holder).where(~F.col(kept) & F.col("holder").isNotNull())


def joined_text(df: DataFrame, keys: tuple[str, ...], to: str = "body") -> DataFrame:
    """The text of a recording; tokens of closing marks alone stick to the word before."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    glued = F.transform(ordered, lambda x: F.when(x["text"].rlike(r"^[.,!?;:…)\]}%”’]+$"), x["text"]).otherwise(F.concat(F.lit(" "), x["text"])))
    return df.groupBy(*keys).agg(F.ltrim(F.array_join(glued, "")).alias(to))


def word_budget_parts(runs: DataFrame, keys: tuple[str, ...], budget: int = 2000, order: str = "turn") -> DataFrame:
    """Deals turns in order to parts of at most budget words (a longer turn has its own): adds part."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col("n_words").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("fill"), F.array().cast("array<struct<turn:bigint,part:bigint>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["fill"] == 0) | (a["fill"] + x["n"] <= budget)
        part = F.when(fits, a["part"]).otherwise(a["part"] + 1)
        fill = F.when(fits, a["fill"] + x["n"]).otherwise(x["n"])
        return F.struct(part.alias("part"), fill.alias("fill"), F.concat(a["done"], F.array(F.struct(x["turn"].alias("turn"), part.alias("part")))).alias("done"))

    parts = runs.groupBy(*keys).agg(ordered.alias("_o")).select(*keys, F.explode(F.aggregate("_o", start, step, lambda a: a["done"])).alias("_p"))
    return parts.select(*keys, F.col("_p.turn").alias(order), F.col("_p.part").alias("part"))


def known_span(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """gap_start and gap_end of words without time: the last known end before, the first known start
    after; where one is missing the other stands for both."""
    a = F.last("end", ignorenulls=True).over(before(by(*keys)))
    b = next_known("start", keys)
    return df.withColumns({"gap_start": F.coalesce(a, b), "gap_end": F.coalesce(b, a)})
