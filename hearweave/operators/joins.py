"""Joins of words with what other tables say about them. Interval joins have equality keys: the
recording and a bucket of time, so no recording is compared with itself in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearweave.functions import columns as C

#: Seconds of a bucket in interval joins.
BUCKET = 30.0


def bucketed(df: DataFrame, start: str, end: str, to: str = "bucket", width: float = BUCKET) -> DataFrame:
    """A row for each bucket of time that a span touches."""
    a, b = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(to, F.explode(F.sequence(a, F.greatest(a, b))))


def interval_join(left: DataFrame, right: DataFrame, key: str = "recording", width: float = BUCKET) -> DataFrame:
    """Pairs whose spans overlap, each once. left has start and end, right start_2 and end_2."""
    a = bucketed(left, "start", "end", "_bucket", width)
    b = bucketed(right, "start_2", "end_2", "_bucket", width)
    both = a.join(b, [key, "_bucket"]).where(C.overlaps(F.col("start"), F.col("end"), F.col("start_2"), F.col("end_2")))
    # a pair that meets in several buckets counts in the first of them
    return both.where(F.col("_bucket") == F.floor(F.greatest("start", "start_2") / width)).drop("_bucket")


def best_turn(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Each word with the turn that shares most seconds with it, the earliest if tied; words outside
    all turns are left out. turns: recording, turn, speaker_2, start_2, end_2."""
    pairs = interval_join(words, turns)
    shared = F.round(C.shared_seconds(F.col("start"), F.col("end"), F.col("start_2"), F.col("end_2")), 6)
    best = pairs.withColumn("_s", shared).where("_s > 0").groupBy("recording", "pos").agg(
        F.max_by(F.struct("turn", "speaker_2", "_s"), F.struct("_s", -F.col("turn"))).alias("_b")
    )
    return best.select("recording", "pos", F.col("_b.turn").alias("turn"), F.col("_b.speaker_2").alias("speaker_2"), F.col("_b._s").alias("shared"))


def label_overlaps(home: DataFrame, foreign: DataFrame) -> DataFrame:
    """Seconds that each pair of labels of two services shares: recording, speaker, speaker_2, shared."""
    pairs = interval_join(home, foreign)
    s = C.shared_seconds(F.col("start"), F.col("end"), F.col("start_2"), F.col("end_2"))
    return pairs.groupBy("recording", "speaker", "speaker_2").agg(F.sum(s).alias("shared"))


def anchors(tokens: DataFrame, backbone: str, other: str, least: int = 3) -> DataFrame:
    """Words of least letters or more that stand exactly once on both sides: recording, form, pos, pos_2."""

    def once(provider: str, name: str) -> DataFrame:
        own = tokens.where((F.col("provider") == provider) & (F.length("form") >= least))
        return own.groupBy("recording", "form").agg(F.count("*").alias("_n"), F.min("pos").alias(name)).where("_n = 1").drop("_n")

    return once(backbone, "pos").join(once(other, "pos_2"), ["recording", "form"])


def heard(words: DataFrame, tokens: DataFrame, order: tuple[str, ...] = C.PROVIDERS) -> DataFrame:
    """What every service heard at a word: its distinct texts in order, services in report order."""
    texts = tokens.groupBy("recording", "pos", "provider").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])), " ").alias("t"))
    rank = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("provider") == name, k).otherwise(rank)
    lines = texts.groupBy("recording", "pos").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), F.concat_ws(": ", "provider", "t").alias("s")))).alias("_l"))
    said = F.array_join(F.transform("_l", lambda x: x["s"]), "; ")
    return words.join(lines, ["recording", "pos"], "left").withColumn("heard", said).drop("_l")


def heard_here(order: tuple[str, ...] = C.PROVIDERS) -> Column:
    """heard of a row that has a column of text for each service of order, null if it heard nothing."""
    lines = [F.when(F.col(name).isNotNull(), F.concat_ws(": ", F.lit(name), name)) for name in order]
    return F.when(F.coalesce(*lines).isNotNull(), F.concat_ws("; ", *lines))


def vocabulary_match(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Each word with the first term of its form: match (exact, equivalent, misrecognition or none) and term.

    A known misrecognition blocks the looser match. words: text, form; terms: term, form, wrong_form, arrival.
    """

    def firsts(key: str, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("arrival")
        return terms.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(F.col(key).alias("_key"), F.col("term").alias(name))

    plain = terms.withColumn("_plain", F.lower(F.trim("term")))
    w = Window.partitionBy("_plain").orderBy("arrival")
    exact = plain.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(F.col("_plain").alias("_key"), F.col("term").alias("_exact"))
    out = words.join(exact, F.lower(F.trim("text")) == exact["_key"], "left").drop("_key")
    wrong = firsts("wrong_form", "_wrong")
    out = out.join(wrong, out["form"] == wrong["_key"], "left").drop("_key")
    loose = firsts("form", "_loose")
    out = out.join(loose, out["form"] == loose["_key"], "left").drop("_key")
    match = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_wrong").isNotNull(), "misrecognition").when(F.col("_loose").isNotNull(), "equivalent").otherwise("none")
    term = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_wrong").isNotNull(), F.col("_wrong")).otherwise(F.col("_loose"))
    return out.withColumns({"match": match, "term": term}).drop("_exact", "_wrong", "_loose")


def rule_for(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Each word with the replacement of the rule for its form: one of its language first, else the
    first where either language is unknown. rules: form, language, replacement, ordinal."""
    # one row for each form, with a map of its few languages, so that words are joined once
    first = rules.groupBy("form", "language").agg(F.min_by(F.struct("replacement", "ordinal"), "ordinal").alias("_r"))
    looked = first.groupBy("form").agg(
        F.map_from_entries(F.collect_list(F.struct("language", F.col("_r.replacement").alias("r")))).alias("_own"), F.min_by("_r.replacement", "_r.ordinal").alias("_any")
    )
    out = words.join(looked, "form", "left")
    own = F.try_element_at("_own", F.col("language"))
    found = F.coalesce(own, F.when(F.col("language") == "unknown", F.col("_any")).otherwise(F.try_element_at("_own", F.lit("unknown"))))
    return out.withColumn("replacement", found).drop("_own", "_any")


def apply_rules(words: DataFrame, rules: DataFrame, analysed: DataFrame, weak: float = 0.55) -> DataFrame:
    """action for the words of recordings not analysed before: replaced (with replacement) or queued."""
    new = words.join(analysed, "recording", "left_anti").where(~C.is_punctuation_only(F.col("text")) & ~F.col("human_corrected"))
    ruled = rule_for(new, rules)
    fires = F.col("replacement").isNotNull() & (F.col("replacement") != F.col("text"))
    action = F.when(fires, "replaced").when(F.col("strength") < weak, "queued")
    return ruled.withColumn("action", action).where("action is not null")


def corrections(before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What a review changed: keys, kind (text or speaker), was, now. An empty speaker is none."""
    b = after.select(*keys, F.col("text").alias("_t"), F.col("speaker").alias("_s"))
    both = before.join(b, list(keys))
    who = lambda c: F.when(F.col(c) != "", F.col(c))
    changes = F.array_compact(
        F.array(
            F.when(F.trim("text") != F.trim("_t"), F.struct(F.lit("text").alias("kind"), F.col("text").alias("was"), F.col("_t").alias("now"))),
            F.when(~who("speaker").eqNullSafe(who("_s")), F.struct(F.lit("speaker").alias("kind"), F.col("speaker").alias("was"), F.col("_s").alias("now"))),
        )
    )
    return both.select(*keys, F.explode(changes).alias("_c")).select(*keys, "_c.*")


def corrected(words: DataFrame, edits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Words with edits (keys, new_text, new_speaker) applied: the first original text is kept; a changed
    text is high confidence with strength 1. The same text is no change."""
    joined = words.join(edits, list(keys), "left")
    new = F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))
    speaker = F.col("new_speaker").isNotNull() & ~F.col("new_speaker").eqNullSafe(F.col("speaker"))
    return joined.withColumns(
        {
            "original_text": F.when(new, F.coalesce("original_text", "text")).otherwise(F.col("original_text")),
            "strength": F.when(new, 1.0).otherwise(F.col("strength")),
            "human_corrected": F.col("human_corrected") | new | speaker,
            "reasons": F.when(new | speaker, F.array().cast("array<string>")).otherwise(F.col("reasons")),
            "text": F.when(new, F.col("new_text")).otherwise(F.col("text")),
            "speaker": F.when(speaker, F.col("new_speaker")).otherwise(F.col("speaker")),
        }
    ).drop("new_text", "new_speaker")


def to_analyse(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Recordings without a mark, or whose file differs from it. files, marks: recording, mark."""
    m = marks.select("recording", F.col("mark").alias("_was"))
    return files.join(m, "recording", "left").where(~F.col("mark").eqNullSafe(F.col("_was")) | F.col("_was").isNull()).drop("_was")


def departed(marks: DataFrame, files: DataFrame) -> DataFrame:
    """Recordings with a mark whose file is no longer there."""
    return marks.join(files.select("recording"), "recording", "left_anti")


def usable_results(results: DataFrame, tokens: DataFrame) -> DataFrame:
    """Answers without an error that have words. results: recording, provider, error; tokens: recording, provider."""
    return results.where(F.col("error").isNull()).join(tokens.select("recording", "provider"), ["recording", "provider"], "left_semi")


def checked_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Model answers and why each is refused: second answer, unknown span, malformed, wrong original
    text, keep that changes, high risk, another word count, text not offered; else accepted. Spans
    nobody answered are listed too.

    spans: span, text, high_risk, offered (array); decisions: span, ordinal, action, from_text, to_text.
    """
    nth = F.row_number().over(Window.partitionBy("span").orderBy("ordinal"))
    d = decisions.withColumn("_n", nth)
    both = d.join(spans, "span", "full_outer")
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    plain = lambda c: F.lower(F.trim(c))
    told = F.transform("offered", lambda o: F.lower(F.trim(o)))
    each = F.forall(F.split(plain(F.col("to_text")), r"\s+"), lambda w: F.array_contains(told, w))
    verdict = (
        F.when(F.col("ordinal").isNull(), "unanswered")
        .when(F.col("text").isNull(), "unknown_span")
        .when(F.col("_n") > 1, "second_answer")
        .when(~F.col("action").isin("keep", "replace"), "malformed")
        .when(plain(F.col("from_text")) != plain(F.col("text")), "wrong_original_text")
        .when((F.col("action") == "keep") & (plain(F.col("to_text")) != plain(F.col("text"))), "keep_changes")
        .when((F.col("action") == "replace") & F.col("high_risk"), "high_risk")
        .when((F.col("action") == "replace") & (words(F.col("to_text")) != words(F.col("text"))), "word_count")
        .when((F.col("action") == "replace") & ~(F.array_contains(told, plain(F.col("to_text"))) | each), "not_offered")
        .otherwise("accepted")
    )
    return both.select("span", "ordinal", "action", verdict.alias("verdict"))


def second_opinions(disputes: DataFrame, answers: DataFrame, ceiling: float = 0.85) -> DataFrame:
    """Disputes with what a second service said: outcome (confirmed, settled, kept_high_risk,
    new_reading, unanswered), the text, and the strength under a ceiling.

    disputes: dispute, text, form, candidates (forms), high_risk, strength; answers: dispute, answer_form, answer.
    """
    j = disputes.join(answers, "dispute", "left")
    known = F.array_contains("candidates", F.col("answer_form"))
    same = F.col("answer_form") == F.col("form")
    outcome = (
        F.when(F.col("answer_form").isNull(), "unanswered")
        .when(F.col("high_risk") & ~same, "kept_high_risk")
        .when(same, "confirmed")
        .when(known, "settled")
        .otherwise("new_reading")
    )
    text = F.when(outcome == "settled", F.col("answer")).otherwise(F.col("text"))
    strength = F.when(outcome.isin("confirmed", "settled"), F.least(F.greatest("strength", F.lit(0.78)), F.lit(ceiling))).otherwise(F.col("strength"))
    return j.select("dispute", outcome.alias("outcome"), text.alias("text"), strength.alias("strength"))


def second_speakers(words: DataFrame, found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Speakers by a second service: kept with review if its label maps to none; agreed (high from a
    coverage of 0.6); else the mapped one, flagged, with the old as alternative.

    found: recording, pos, speaker_2; mapping: recording, speaker_2, mapped, coverage.
    """
    j = words.join(found, ["recording", "pos"]).join(mapping, ["recording", "speaker_2"], "left")
    outcome = F.when(F.col("mapped").isNull(), "kept").when(F.col("mapped").eqNullSafe(F.col("speaker")), "agreed").otherwise("moved")
    confidence = F.when(outcome == "kept", "review_required").when(outcome == "moved", "review_required").when(F.col("coverage") >= 0.6, "high").otherwise("review_suggested")
    return j.select("recording", "pos", outcome.alias("outcome"), F.when(outcome == "moved", F.col("mapped")).otherwise(F.col("speaker")).alias("speaker"), F.when(outcome == "moved", F.col("speaker")).alias("alternative"), confidence.alias("confidence"))


def boundary_disputes(disputes: DataFrame, turns: DataFrame, reach: float = 0.5) -> DataFrame:
    """Disputes whose span, widened by reach, holds a change of speaker. disputes: recording, dispute, start, end."""
    w = Window.partitionBy("recording").orderBy("turn")
    change = turns.withColumn("_n", F.lead("start").over(w)).where("_n is not null")
    points = change.select("recording", F.col("_n").alias("at"), F.col("_n").alias("start_2"), (F.col("_n") + 1e-6).alias("end_2"))
    wide = disputes.withColumns({"start": F.col("start") - reach, "end": F.col("end") + reach + 2e-6})
    return interval_join(wide, points).select("recording", "dispute").distinct()


def equivalent(a_form: Column, a_dropped: Column, a_german: Column, b_form: Column, b_dropped: Column, b_german: Column) -> Column:
    """Whether two texts are the same spoken evidence, from their forms. Not transitive."""
    return (a_form == b_form) | ((a_german | b_german) & (a_dropped == b_dropped))
