"""Counts, shares and reliabilities. All group by few keys after partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearweave.functions import columns as C

#: Prior of a service's reliability, outcomes that a dimension needs, bands of evidence.
PRIOR, PRIOR_WEIGHT, LEAST_OUTCOMES = 0.9, 50, 30
EVIDENCE = ((500, "strong"), (50, "fair"), (30, "some"))


def dimension(spark, name: str, values: tuple) -> DataFrame:
    """A small table of fixed values in order: (name, ordinal)."""
    return spark.createDataFrame(list(zip(values, range(len(values)))), f"{name} string, ordinal int")


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """provider, bucket, chosen, corrected: each outcome counts overall and in its buckets. Amounts are
    signed; corrected is at most chosen, and neither is below 0."""
    buckets = F.array_compact(
        F.array(
            F.lit("overall"),
            F.concat(F.lit("vocabulary:"), "category"),
            F.when(F.col("is_numeric"), "numeric:yes"),
            F.when(F.col("is_proper_noun"), "proper_noun:yes"),
            F.concat(F.lit("language:"), "language"),
        )
    )
    rows = outcomes.select("provider", F.explode(buckets).alias("bucket"), "amount", F.when(F.col("corrected"), F.col("amount")).otherwise(0).alias("bad"))
    sums = rows.groupBy("provider", "bucket").agg(F.sum("amount").alias("chosen"), F.sum("bad").alias("corrected"))
    chosen = F.greatest(F.lit(0), "chosen")
    return sums.select("provider", "bucket", chosen.alias("chosen"), F.greatest(F.lit(0), F.least("corrected", chosen)).alias("corrected"))


def reliability(chosen: Column, corrected: Column) -> Column:
    """The share of words that stood, smoothed towards PRIOR."""
    return (chosen - corrected + PRIOR * PRIOR_WEIGHT) / (chosen + PRIOR_WEIGHT)


def correction_rate(chosen: Column, corrected: Column) -> Column:
    return F.when(chosen > 0, corrected / chosen)


def word_weights(words: DataFrame, counters: DataFrame) -> DataFrame:
    """weight of each word's service: from the first dimension with LEAST_OUTCOMES (vocabulary, numeric,
    proper noun, language), else overall, else PRIOR. counters has few rows (services by buckets)."""
    known = counters.withColumn("w", reliability(F.col("chosen"), F.col("corrected")))
    table = known.groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("chosen", "w")))).alias("_m"))
    joined = words.join(table, "provider", "left")

    def look(bucket: Column) -> Column:
        return F.try_element_at("_m", bucket)

    def enough(bucket: Column) -> Column:
        return F.when(look(bucket)["chosen"] >= LEAST_OUTCOMES, look(bucket)["w"])

    weight = F.coalesce(
        enough(F.concat(F.lit("vocabulary:"), "category")),
        F.when(F.col("is_numeric"), enough(F.lit("numeric:yes"))),
        F.when(F.col("is_proper_noun"), enough(F.lit("proper_noun:yes"))),
        enough(F.concat(F.lit("language:"), "language")),
        F.when(look(F.lit("overall"))["chosen"] > 0, look(F.lit("overall"))["w"]),
        F.lit(PRIOR),
    )
    return joined.withColumn("weight", weight).drop("_m")


def confidence_reliability(outcomes: DataFrame) -> DataFrame:
    """confidence, ordinal, reviewed, corrected for all four categories."""
    counts = outcomes.groupBy("confidence").agg(F.count("*").alias("reviewed"), F.count_if("corrected").alias("corrected"))
    dim = dimension(outcomes.sparkSession, "confidence", C.CONFIDENCE)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dim.join(counts, "confidence", "left").select("confidence", "ordinal", zero("reviewed"), zero("corrected"))


def moved_weights(counters: DataFrame) -> DataFrame:
    """provider, weight for voting: the default, moved by the overall reliability where there is one."""
    spark = counters.sparkSession
    defaults = spark.createDataFrame(list(C.RELIABILITY.items()), "provider string, standard double")
    overall = counters.where("bucket = 'overall'").drop("bucket")
    moved = F.col("standard") * reliability(F.col("chosen"), F.col("corrected")) / PRIOR
    return defaults.join(overall, "provider", "left").select("provider", F.when(F.col("chosen") > 0, moved).otherwise(F.col("standard")).alias("weight"))


def service_statistics(counters: DataFrame) -> DataFrame:
    """A row for every service, used or not: provider, chosen, corrected, rate, weight, evidence."""
    dim = dimension(counters.sparkSession, "provider", C.PROVIDERS)
    overall = dim.join(counters.where("bucket = 'overall'"), "provider", "left").fillna(0, ["chosen", "corrected"])
    band = F.lit("too little")
    for least, name in reversed(EVIDENCE):
        band = F.when(F.col("chosen") >= least, name).otherwise(band)
    c, d = F.col("chosen"), F.col("corrected")
    return overall.select("provider", "chosen", "corrected", correction_rate(c, d).alias("rate"), reliability(c, d).alias("weight"), band.alias("evidence"))


def repeated(df: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """keys, n of what happened least times or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: Categories of mistakes in the order of reports.
MISTAKES = ("high_risk", "number", "name", "wording", "speaker")


def mistake_counts(mistakes: DataFrame) -> DataFrame:
    """category, ordinal, n of all categories, also of those without a mistake. mistakes: category."""
    counts = mistakes.groupBy("category").agg(F.count("*").alias("n"))
    return dimension(mistakes.sparkSession, "category", MISTAKES).join(counts, "category", "left").select("category", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))


def alignment_quality(columns: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """quality and agreement of each service with the backbone: recording, provider, quality, agreement.
    columns: recording, provider, status, quality. missing: recording, provider of services that aligned
    nothing; they have 0 for both."""
    agrees = F.avg(F.col("status").isin("exact", "format_equivalent").cast("double"))
    out = columns.groupBy("recording", "provider").agg(F.avg("quality").alias("quality"), agrees.alias("agreement"))
    if missing is None:
        return out
    none = missing.select("recording", "provider").distinct().join(out, ["recording", "provider"], "left_anti")
    return out.unionByName(none.select("recording", "provider", F.lit(0.0).alias("quality"), F.lit(0.0).alias("agreement")))


def mistake_category(high_risk: Column, number: Column, name: Column) -> Column:
    return F.when(high_risk, "high_risk").when(number, "number").when(name, "name").otherwise("wording")


def learned_corrections(df: DataFrame) -> DataFrame:
    """provider, wrong_form, right_form, wrong, right (first spellings), n, last_at from provider, wrong,
    right, at. Texts that are equal but for case and spaces are no corrections."""
    plain = lambda c: F.lower(F.trim(c))
    rows = df.withColumns({"wrong_form": plain(F.col("wrong")), "right_form": plain(F.col("right"))}).where("wrong_form != right_form")
    return rows.groupBy("provider", "wrong_form", "right_form").agg(
        F.min_by("wrong", "at").alias("wrong"), F.min_by("right", "at").alias("right"), F.count("*").alias("n"), F.max("at").alias("last_at")
    )


def correction_terms(corrections: DataFrame, least: int = 2) -> DataFrame:
    """Terms worth sending: the right text of corrections of least occurrences, with its wrong forms."""
    often = corrections.where(F.col("n") >= least)
    return often.groupBy("right_form").agg(
        F.min("right").alias("term"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("wrong_form")), "|").alias("wrong_forms")
    )


def confidence_distribution(words: DataFrame, category: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each category, n and the percentage with one decimal; all four categories are there."""
    counts = words.groupBy(*keys).agg(*(F.count_if(F.col(category) == name).alias(f"_{name}") for name in C.CONFIDENCE))
    each = F.array(*(F.struct(F.lit(name).alias(category), F.col(f"_{name}").alias("n")) for name in C.CONFIDENCE))
    total = sum((F.col(f"_{name}") for name in C.CONFIDENCE[1:]), F.col(f"_{C.CONFIDENCE[0]}"))
    rows = counts.select(*keys, total.alias("_total"), F.inline(each))
    return rows.select(*keys, category, "n", F.round(F.when(F.col("_total") > 0, 100.0 * F.col("n") / F.col("_total")).otherwise(0.0), 1).alias("percent"))


def services_report(requests: DataFrame) -> DataFrame:
    """Per recording and service: requests, failed ones, seconds of those that answered."""
    return requests.groupBy("recording", "provider").agg(
        F.count("*").alias("n_requests"), F.count_if("failed").alias("n_failed"), F.sum(F.when(~F.col("failed"), F.col("seconds")).otherwise(0.0)).alias("seconds"),
        F.bool_or(~F.col("failed")).alias("answered"),
    )


def second_opinions(requests: DataFrame) -> DataFrame:
    """Requests and seconds per purpose and service, with totals per purpose and of all; transcription
    and smoothing are left out."""
    rows = requests.where(~F.col("purpose").isin("transcription", "smoothing"))
    return rows.rollup("purpose", "provider").agg(F.count("*").alias("n_requests"), F.sum("seconds").alias("seconds"))


def untimed_share(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Words without an audible span, and whether they are most."""
    n = F.count_if(F.col("start").isNull() | (F.col("end") <= F.col("start")))
    return words.groupBy(*keys).agg(F.count("*").alias("n_words"), n.alias("n_untimed"), (n / F.count("*") > 0.5).alias("most"))


def extents(tokens: DataFrame) -> DataFrame:
    """First and last position that each service covers."""
    return tokens.groupBy("recording", "provider").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def dominant_language(words: DataFrame) -> DataFrame:
    """The most frequent known language of a recording (the first seen, if tied), else en."""
    known = words.where("language is not null and language != 'unknown'").groupBy("recording", "language").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = known.groupBy("recording").agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))
    return words.select("recording").distinct().join(best, "recording", "left").select("recording", F.coalesce("language", F.lit("en")).alias("language"))


def speakers_in_order(words: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Labels by first speech, each with the known name of its place."""
    first = words.where("speaker is not null").groupBy("recording", "speaker").agg(F.min("pos").alias("first"))
    n = F.row_number().over(Window.partitionBy("recording").orderBy("first", "speaker"))
    out = first.withColumn("place", n.cast("long"))
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return out.withColumn("name", F.get(known, F.col("place").cast("int") - 1))


def surplus_speakers(runs: DataFrame, expected: int) -> DataFrame:
    """Turns of speakers beyond the expected number, ranked by total seconds."""
    totals = runs.groupBy("recording", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    ranked = totals.withColumn("_r", F.row_number().over(Window.partitionBy("recording").orderBy(F.desc(F.round("total", 6)), "speaker")))
    return runs.join(ranked.where(F.col("_r") > expected).select("recording", "speaker"), ["recording", "speaker"], "left_semi")


def representatives(occurrences: DataFrame, *keys: str) -> DataFrame:
    """Each group's most frequent text; ties go to a measured one, the weakest, the first seen."""
    counts = occurrences.groupBy(*keys, "detected").agg(F.count("*").alias("n"), F.min("strength").alias("least"), F.min(F.struct("recording", "pos")).alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col("least").isNull(), "least", "first")
    return counts.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*keys, F.col("detected").alias("representative"), "n")


def review_groups(occurrences: DataFrame, *keys: str) -> DataFrame:
    """Groups as a reviewer sees them: occurrences, files, range of strengths, what is done."""
    return occurrences.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("recording").alias("n_recordings"), F.min("strength").alias("least"), F.max("strength").alias("most"),
        F.count_if("reviewed").alias("n_reviewed"),
        F.when(F.bool_and("reviewed"), "reviewed").when(F.bool_or("reviewed"), "partly").otherwise("open").alias("state"),
    )


def learned_names(names: DataFrame) -> DataFrame:
    """Names by case-folded text and language, with the union of their wrong forms and the first date."""
    rows = names.withColumn("key", F.lower("text")).where(F.size(F.split("text", r"\s+")) <= 3)
    wrong = F.array_sort(F.collect_set(F.when(F.lower("wrong") != F.col("key"), F.lower("wrong"))))
    return rows.groupBy("key", "language").agg(F.min_by("text", "at").alias("text"), F.array_join(wrong, "|").alias("wrong_forms"), F.min("at").alias("at"))


def derived_rules(occurrences: DataFrame) -> DataFrame:
    """One rule for each form and language: the latest decision's. Removed words teach none."""
    decided = occurrences.where("replacement is not null and replacement != '' and replacement != detected")
    latest = F.max_by("replacement", "decided_at").alias("replacement")
    return decided.groupBy("form", "language").agg(latest, F.max("decided_at").alias("decided_at"))


def signed_notes(old: DataFrame, new: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """What changed between two notes: -1 for a withdrawn value, +1 for a new one."""
    a, b = old.select(*keys, F.col(value).alias("was")), new.select(*keys, F.col(value).alias("now"))
    both = a.join(b, list(keys), "full_outer").where("not (was <=> now)")
    rows = F.array_compact(F.array(F.when(F.col("was").isNotNull(), F.struct(F.col("was").alias(value), F.lit(-1).alias("amount"))), F.when(F.col("now").isNotNull(), F.struct(F.col("now").alias(value), F.lit(1).alias("amount")))))
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, f"_r.{value}", "_r.amount")


def costs(requests: DataFrame, rates: DataFrame, surcharged: str = "assemblyai", surcharge: float = 0.20) -> DataFrame:
    """Minutes times rate per service, dearer for one service when terms are sent. A service without a
    rate is listed as unpriced with no amount. rates: provider, rate per minute."""
    joined = requests.join(rates, "provider", "left")
    more = F.when((F.col("provider") == surcharged) & F.col("terms_sent"), 1 + surcharge).otherwise(1.0)
    amount = F.col("seconds") / 60 * F.col("rate") * more
    return joined.groupBy("provider").agg(F.count("*").alias("n_requests"), F.sum(amount).alias("amount"), F.bool_and(F.col("rate").isNull()).alias("unpriced"))
