"""Column expressions: everything here stays inside Spark's code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Services in the order reports name them, and how far each is believed.
PROVIDERS = ("elevenlabs", "openai", "microsoft", "assemblyai", "deepgram")
RELIABILITY = {"openai": 1.00, "elevenlabs": 0.95, "microsoft": 0.90, "assemblyai": 0.85, "deepgram": 0.75}
UNKNOWN_RELIABILITY = 0.70
BACKBONE_ORDER = ("elevenlabs", "assemblyai", "deepgram", "microsoft", "openai")

# Confidence categories from best to worst, with the least strength of each.
CONFIDENCE = ("high", "review_suggested", "review_required", "unresolved")
LEAST_STRENGTH = (0.78, 0.55, 0.30)

# Prefixes of language codes.
LANGUAGE_PREFIXES = {"en": ("en", "eng"), "de": ("de", "deu", "ger"), "af": ("af", "afr")}

# Parameters of strengths (floor and span of each signal).
DECISIVENESS, ACOUSTIC, ALIGNMENT, LANGUAGE = (0.60, 0.40), (0.70, 0.30), (0.70, 0.30), (0.85, 0.15)
ASSUMED_ACOUSTIC, HIGH_RISK_PENALTY, VOCABULARY_BONUS = 0.80, 0.75, 1.10
LOW_ACOUSTIC, WEAK_ALIGNMENT = 0.55, 0.50
INDEPENDENCE, MOST_FACTOR = 0.60, 0.99


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def share(floor_span: tuple[float, float], signal: Column) -> Column:
    return F.lit(floor_span[0]) + F.lit(floor_span[1]) * signal


# Languages and text


def language_of(code: Column, prefixes: dict[str, tuple[str, ...]] = LANGUAGE_PREFIXES) -> Column:
    """The language of a code such as "en", "EN_gb" or " de-AT "; else unknown."""
    c = F.regexp_replace(F.lower(F.trim(code)), "_", "-")
    out = F.lit("unknown")
    for name, heads in reversed(prefixes.items()):
        out = F.when(reduce(Column.__or__, [(c == h) | c.startswith(h + "-") for h in heads]), name).otherwise(out)
    return out


def is_punctuation_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{P}\s]+", "") == ""


def is_spoken(punctuation: Column, audio_event: Column) -> Column:
    return ~F.coalesce(punctuation, F.lit(False)) & ~F.coalesce(audio_event, F.lit(False))


def looks_like_name(text: Column) -> Column:
    """Any word with a capital first letter and a lower-case letter."""
    return text.rlike(r"(^|\s)\p{Lu}\S*\p{Ll}")


def looks_like_name_alone(text: Column) -> Column:
    """Two letters or more, the first a capital, some lower-case."""
    return text.rlike(r"^\p{Lu}.+$") & text.rlike(r"\p{Ll}")


def looks_like_name_in_sentence(text: Column, starts_sentence: Column) -> Column:
    """An acronym, a capital inside, or a first capital unless a sentence starts here."""
    acronym = text.rlike(r"^\p{Lu}{2,}$")
    inside = text.rlike(r"^.\S*\p{Lu}")
    return acronym | inside | (text.rlike(r"^\p{Lu}") & ~starts_sentence)


# Confidence


def category_for(strength: Column) -> Column:
    out = F.lit(CONFIDENCE[-1])
    for name, least in reversed(list(zip(CONFIDENCE, LEAST_STRENGTH))):
        out = F.when(strength >= least, name).otherwise(out)
    return out


def ordinal(category: Column) -> Column:
    """0 for the best category; null and unknown ones count as the worst."""
    out = F.lit(len(CONFIDENCE) - 1)
    for k, name in enumerate(CONFIDENCE[:-1]):
        out = F.when(category == name, k).otherwise(out)
    return out


def weakest(*categories: Column) -> Column:
    """The worst of categories; without any, unresolved."""
    if not categories:
        return F.lit(CONFIDENCE[-1])
    worst = F.greatest(*map(ordinal, categories), F.lit(0))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), worst + 1)


def text_strength(
    support: Column, runner_up: Column, acoustic: Column, alignment: Column, language: Column, in_vocabulary: Column,
    high_risk: Column, contesting: Column,
) -> Column:
    """The strength of a decision from its evidence, in [0, 1]. A missing acoustic value is no doubt."""
    out = clamp(support) * share(DECISIVENESS, clamp(support - runner_up))
    out = out * share(ACOUSTIC, F.coalesce(acoustic, F.lit(ASSUMED_ACOUSTIC)))
    out = out * share(ALIGNMENT, clamp(alignment)) * share(LANGUAGE, clamp(language))
    out = out * F.when(in_vocabulary, VOCABULARY_BONUS).otherwise(1.0)
    out = out * F.when(high_risk & (contesting > 0), HIGH_RISK_PENALTY).otherwise(1.0)
    return clamp(out)


def text_reasons(acoustic: Column, alignment: Column, contesting: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(acoustic < LOW_ACOUSTIC, "low_acoustic_confidence"),
            F.when(alignment < WEAK_ALIGNMENT, "weak_alignment"),
            F.when(contesting > 0, "provider_disagreement"),
        )
    )


def recorded_strength(strength: Column, category: Column) -> Column:
    """A high category is never recorded below its least strength."""
    return F.when(category == "high", F.greatest(strength, F.lit(LEAST_STRENGTH[0]))).otherwise(strength)


def timing_confidence(status_strength: Column, alignment: Column) -> Column:
    return category_for(status_strength * share(ALIGNMENT, clamp(alignment)))


def speaker_confidence(speaker: Column, disputed: Column, overlapping: Column) -> Column:
    return (
        F.when(speaker.isNull(), "unresolved").when(overlapping, "review_required").when(disputed, "review_suggested").otherwise("high")
    )


def acoustic_confidence(log_probability: Column, confidence: Column) -> Column:
    """exp of the log probability, else the confidence, within [0, 1]; null if neither is there."""
    return clamp(F.coalesce(F.exp(log_probability), confidence))


def combined(scores: Column) -> Column:
    """One score from several services': 1 - product of (1 - score * INDEPENDENCE^rank), best first."""
    ordered = F.sort_array(F.transform(scores, lambda s: clamp(s, 0.0, MOST_FACTOR)), asc=False)
    doubts = F.transform(ordered, lambda s, k: 1.0 - s * F.pow(F.lit(INDEPENDENCE), k))
    return 1.0 - F.aggregate(doubts, F.lit(1.0), lambda a, d: a * d)


def provider_language_weight(provider: Column, third_share: Column, third_enabled: Column, limited: str = "microsoft") -> Column:
    """One service does not speak the third language: full weight up to a share of 0.15 of it, then
    falling to 0.2 at 0.75, and none from there."""
    s = F.coalesce(third_share, F.lit(0.0))
    fall = 1.0 - (s - 0.15) / 0.60 * 0.8
    weight = F.when(s >= 0.75, 0.0).when(s <= 0.15, 1.0).otherwise(fall)
    return F.when((provider == limited) & third_enabled, weight).otherwise(1.0)


# Spans and formats


def padded(start: Column, end: Column, before: float, after: float, limit: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), start - before), F.least(end + after, F.coalesce(limit, end + after))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict on both sides: spans that only touch do not overlap."""
    return (a_start < b_end) & (b_start < a_end)


def shared_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; halves round to even."""
    s = F.bround(F.greatest(seconds, F.lit(0.0)), 0).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def spoken_duration(seconds: Column) -> Column:
    """A duration in words, without parts that are zero; "Unknown" for null."""
    s = F.bround(F.greatest(seconds, F.lit(0.0)), 0).cast("long")

    def part(n: Column, unit: str) -> Column:
        return F.when(n == 1, f"1 {unit}").when(n > 1, F.concat(n.cast("string"), F.lit(f" {unit}s")))

    said = F.concat_ws(" ", part(F.floor(s / 3600), "hour"), part(F.floor(s % 3600 / 60), "minute"), part(s % 60, "second"))
    return F.when(seconds.isNull(), "Unknown").when(s == 0, "0 seconds").otherwise(said)


def file_size(n: Column) -> Column:
    """Bytes in units of 1024, with one decimal from kilobytes on."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 1), F.lit(" " + unit))).otherwise(out)
    return out


def planned_gain(loudness: Column, peak: Column, target: float, most: float, ceiling: float, limiter: Column) -> tuple[Column, Column]:
    """The gain to reach target, and which limit cut it (gain, peak or none)."""
    wanted = F.lit(target) - loudness
    first = F.least(wanted, F.lit(most))
    room = F.lit(ceiling) - peak
    gain = F.when(limiter, first).otherwise(F.least(first, room))
    return gain, F.when(~limiter & (room < first), "peak").when(wanted > most, "gain").otherwise("none")


def rendered(text: Column, confidence: Column, candidate_texts: Column) -> Column:
    """The word, or its readings while it is unresolved."""
    choices = F.array_join(F.array_distinct(candidate_texts), " / ")
    open_ = (confidence == "unresolved") & (F.size(candidate_texts) > 0)
    return F.when(open_, F.concat(F.lit("[UNCERTAIN: "), choices, F.lit("]"))).otherwise(text)


# Words of names that are credentials, names that are none, and how credentials begin.
SECRET_WORDS = (
    "key", "keys", "secret", "secrets", "token", "password", "passwd", "passphrase", "credential", "credentials",
    "authorization", "authorisation", "auth", "bearer", "signature",
)
NO_SECRETS = ("key_terms", "keyterms", "key_term", "keyword", "keywords", "key_words", "key_phrases", "keyphrases")
SECRET_BEGINNINGS = ("sk-", "sk_", "xi-", "ghp_", "bearer ", "basic ")
#: Letters of a value of hexadecimal digits, or of letters and digits alone, that is a credential.
SECRET_HEX, SECRET_OPAQUE = 32, 40


def is_secret_name(name: Column) -> Column:
    """Whether a word of a setting's name says that it is a credential."""
    low = F.lower(F.trim(name))
    return ~low.isin(*NO_SECRETS) & F.arrays_overlap(F.split(low, "[^a-z0-9]+"), F.array(*map(F.lit, SECRET_WORDS)))


def is_secret_value(value: Column) -> Column:
    v = F.trim(value)
    begins = reduce(Column.__or__, [F.lower(v).startswith(x) for x in SECRET_BEGINNINGS])
    opaque = F.length(v) >= F.when(v.rlike("[^0-9a-fA-F]"), SECRET_OPAQUE).otherwise(SECRET_HEX)
    return begins | (opaque & ~v.rlike("[^A-Za-z0-9]"))


def redacted(settings: Column) -> Column:
    """A map of settings with credentials replaced, known by a word of the name or by the value."""
    return F.transform_values(settings, lambda k, v: F.when(is_secret_name(k) | is_secret_value(v), "[redacted]").otherwise(v))


# Risky values

# Currency signs, units that stick to a number, endings of days, digits of a long run.
CURRENCIES = ("$", "€", "£", "¥", "₹")
UNITS = (
    "kg", "g", "mg", "mcg", "ml", "l", "km", "cm", "mm", "m", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "mmol",
    "mmhg", "bpm", "iu",
)
DAY_ENDINGS = ("st", "nd", "rd", "th", ".")
LONG_RUN = 7


def cleaned(text: Column) -> Column:
    """Lower case, without marks at the edges; % and currency signs stay, and a minus before a digit."""
    edges = r"[\p{P}&&[^%]]"
    low = F.regexp_replace(F.lower(F.trim(text)), f"^{edges}*[-‐‑‒–—―−](?=\\d)", "−")
    low = F.regexp_replace(F.regexp_replace(low, f"^{edges}+", ""), f"{edges}+$", "")
    return F.translate(low, "−", "-")


def _digits(parts: Column, *sizes: tuple[int, int]) -> Column:
    """Whether parts are as many runs of digits as sizes has, each of a size within its bounds."""
    each = [F.get(parts, F.lit(k)).rlike(f"^\\d{{{a},{b}}}$") for k, (a, b) in enumerate(sizes)]
    return (F.size(parts) == len(sizes)) & reduce(Column.__and__, [F.coalesce(x, F.lit(False)) for x in each])


def _written_date(text: Column) -> Column:
    parts = F.split(text, "[-/.]")
    return _digits(parts, (1, 2), (1, 2)) | _digits(parts, (1, 2), (1, 2), (2, 4))


def has_ambiguous_separator(clean: Column) -> Column:
    """A cleaned number whose comma or full stop means another number in another language."""
    parts = F.split(clean, "[.,]")
    grouped = (F.length(F.get(parts, F.lit(0))) <= 3) & F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.length(x) == 3)
    number = F.forall(parts, lambda x: x.rlike("^\\d+$")) & ((F.size(parts) == 2) | grouped)
    return (F.size(parts) > 1) & (number | _written_date(clean))


def shows_risk(text: Column) -> Column:
    """Whether a text, cleaned or not, can show a risk by itself: every shape has one of these, and few words do."""
    return text.rlike("[0-9%" + "".join(CURRENCIES) + "]")


def risk_categories(text: Column) -> Column:
    """Categories that a cleaned word shows by itself; a product code only if nothing else fits."""
    clock = F.split(text, "[:h.]")
    time = _digits(clock, (1, 2), (2, 2)) | (_digits(clock, (1, 2), (2, 2), (2, 2)) & text.rlike(":\\d\\d$"))
    marks = F.length(text) - F.length(F.translate(text, "./", ""))
    date = (
        _digits(F.split(text, "[-/]"), (4, 4), (1, 2), (1, 2))
        | (_written_date(text) & (marks >= 2))
        | _digits(F.split(text, "/"), (1, 2), (2, 2))
        | _digits(F.split(text, "/"), (1, 2), (4, 4))
    )
    day = F.coalesce(F.regexp_extract(text, "^\\d{1,2}(\\D+)$", 1).isin(*DAY_ENDINGS), F.lit(False))
    year = text.rlike("^\\d{4}$") & text.substr(1, 2).isin("19", "20")
    numbers = F.split(F.regexp_replace(text, "^v", ""), "\\.")
    version = F.forall(numbers, lambda x: x.rlike("^\\d+$")) & (text.startswith("v") | (F.size(numbers) > 2))
    quantity = F.regexp_extract(text, "^\\d+(?:[.,]\\d+)?\\s*(\\D+)$", 1).isin(*UNITS) | has_ambiguous_separator(text)
    long_run = text.rlike(f"^\\d{{{LONG_RUN},}}$")
    money = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in CURRENCIES]) | text.rlike("^r\\d")
    kinds = (
        ("percentage", F.contains(text, F.lit("%"))), ("money", money), ("time", time), ("date", date | day | year), ("version_number", version),
        ("quantity", quantity), ("telephone", long_run), ("account_number", long_run),
    )
    found = F.array_compact(F.array(*(F.when(holds, name) for name, holds in kinds)))
    code = F.forall(F.split(text, "[-/]"), lambda x: x.rlike("^[a-z0-9]+$")) & text.rlike("[a-z]") & text.rlike("\\d")
    none = F.array().cast("array<string>")
    # the first that is not empty; named once each, as an expression is computed wherever it is named
    kind = F.flatten(F.slice(F.filter(F.array(found, F.when(code, F.array(F.lit("product_code"))).otherwise(none)), lambda x: F.size(x) > 0), 1, 1))
    return F.when(shows_risk(text), kind).otherwise(none)


def numbers_disagree(first: Column, second: Column, first_value: Column, second_value: Column) -> Column:
    """Whether two cleaned readings name different numbers; values are the numbers they name, if they do.
    Ambiguous separators always disagree, and so does a number with what is none."""
    numeric = first.rlike("\\d") | second.rlike("\\d") | first_value.isNotNull() | second_value.isNotNull()
    return (
        F.when(first == second, False)
        .when(has_ambiguous_separator(first) | has_ambiguous_separator(second), True)
        .when(first_value.isNull() | second_value.isNull(), numeric)
        .otherwise(first_value != second_value)
    )


# What is done with a word next

# Reasons that doubt a text, and states of timing that are worth measuring again.
TEXT_DOUBTS = ("provider_disagreement", "proper_name_disagreement", "numeric_disagreement", "high_risk_entity", "low_acoustic_confidence", "escalation_unresolved")
WORTH_REALIGNING = ("mapped_substitution", "shared", "approximate", "unaligned", "uncertain")


def needs_review(reasons: Column, pending: Column) -> Column:
    return pending | (F.size(reasons) > 0)


def needs_word_review(reasons: Column, pending: Column) -> Column:
    """Any reason but a doubtful speaker; or pending without any."""
    return (F.size(F.array_remove(reasons, "speaker_uncertain")) > 0) | (pending & (F.size(reasons) == 0))


def text_in_doubt(reasons: Column, pending: Column, corrected: Column, confidence: Column, readings: Column) -> Column:
    """Whether a model has a question to answer: a doubted text, and several readings."""
    doubted = (confidence != "high") | F.arrays_overlap(reasons, F.array(*map(F.lit, TEXT_DOUBTS)))
    return ~corrected & needs_review(reasons, pending) & doubted & (F.size(F.array_distinct(F.filter(readings, lambda x: x != ""))) > 1)


def may_enter_transcript(timing: Column, corrected: Column) -> Column:
    return (timing != "unaligned") | corrected


def needs_forced_alignment(timing: Column, alignment: Column, settled: Column, enabled: Column) -> Column:
    return enabled & (settled | timing.isin(*WORTH_REALIGNING) | alignment.isin("merge", "split"))


def allowed_languages(third_enabled: Column) -> Column:
    """The languages a recording may hold, by its configuration."""
    return F.when(F.coalesce(third_enabled, F.lit(False)), F.array(*map(F.lit, ("en", "de", "af")))).otherwise(F.array(F.lit("en"), F.lit("de")))


# Times and answers


def parsed_time(stamp: Column) -> Column:
    """An ISO 8601 time, or null."""
    return stamp.try_cast("timestamp_ntz")


def readable_time(stamp: Column) -> Column:
    """17 August 2026 at 10:04; what is no time stays as it is."""
    return F.coalesce(F.date_format(parsed_time(stamp), "dd MMMM yyyy 'at' HH:mm"), stamp)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, if both can be read and do not fall."""
    seconds = F.timestamp_diff("MICROSECOND", parsed_time(start), parsed_time(end)) / 1e6
    return F.when(seconds >= 0, seconds)


def answered_turns(body: Column) -> tuple[Column, Column]:
    """The turns of a model's answer (array of number, text; trimmed, the last of a repeated number), and what is
    wrong with the answer, if anything: then there are no turns, but for a repeated number."""
    answer = F.try_parse_json(body)
    is_a = lambda v, *kinds: F.coalesce(reduce(Column.__or__, [F.schema_of_variant(v).startswith(k) for k in kinds]), F.lit(False))
    raw = F.try_variant_get(answer, "$.turns", "array<variant>")
    number = lambda v: F.try_variant_get(v, "$.number", "variant")
    text = lambda v: F.try_variant_get(v, "$.text", "variant")
    turns = F.transform(raw, lambda v: F.struct(F.try_variant_get(v, "$.number", "bigint").alias("number"), F.trim(F.try_variant_get(v, "$.text", "string")).alias("text")))
    numbers = F.transform(turns, lambda t: t["number"])
    last = F.filter(turns, lambda t, k: ~F.array_contains(F.slice(numbers, k + 2, F.size(numbers)), t["number"]))
    problem = (
        F.when(F.coalesce(F.trim(body), F.lit("")) == "", "the answer was empty")
        .when(answer.isNull(), "the answer was not valid JSON")
        .when(raw.isNull(), "the answer had no list of turns")
        .when(F.exists(raw, lambda v: ~is_a(v, "OBJECT")), "the answer held a turn that was not an object")
        .when(F.exists(raw, lambda v: ~is_a(number(v), "BIGINT")), "the answer held a turn with no number")
        .when(F.exists(raw, lambda v: ~is_a(text(v), "STRING")), "the answer held a turn with no text")
        .when(F.size(F.array_distinct(numbers)) < F.size(numbers), "the answer gave a turn more than once")
    )
    none = F.array().cast("array<struct<number:bigint,text:string>>")
    return F.when(problem.isNull() | problem.endswith("more than once"), last).otherwise(none), problem


# Smoothing guard

MARKER = r"\[UNCERTAIN[^\]]*\]"


def markers_in(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit("(" + MARKER + ")"), F.lit(1)))


def turn_problem(literal: Column, edited: Column, fillers: tuple[str, ...], kept: float = 0.8, most: int = 2) -> Column:
    """What is wrong with the smooth text of a turn: a changed marker, a dropped turn that said more than most
    meaningful words, or too few of its words kept; else null."""
    own = F.array_distinct(meaningful_words(literal, fillers))
    left = F.size(F.array_intersect(own, meaningful_words(edited, fillers)))
    return (
        F.when(markers_in(literal) != markers_in(edited), "marker")
        .when(F.trim(edited) == "", F.when(F.size(own) > most, "left_out"))
        .when((F.size(own) > 0) & (left / F.size(own) < kept), "lost_words")
    )


def meaningful_words(text: Column, fillers: tuple[str, ...]) -> Column:
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(text, MARKER, " "), r"[\p{P}]", "")), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*fillers))
