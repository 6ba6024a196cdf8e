"""What queries move: words of a recording stay where its text is, and readings of a place where its word is."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hearweave.functions import forms as N
from hearweave.operators import joins, windows
from hearweave.plans import reconcile, stitch

TEXTS = ("the Cat sat, 12 cats sat on 5kg of Müller", "to be or not to be that is the question", "one")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, TEXTS[k % 3], "en", "web", 10) for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "the cat sat on a mat")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.sql("select id as event_id, timestamp'2026-01-01' as ts, id as user_id, double(id) as value from range(20)").write.parquet(f"{d}/events.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _dealt(df):
    """By what rows are dealt, other than texts dealt on purpose."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENSURE_REQUIREMENTS", _plan(df))


@pytest.mark.parametrize("name", ["flagship", "x5_reconcile", "x15_learned_weights", "k2_winners", "g17_combined", "j1_heard", "n6_equivalence", "g18_readings"])
def test_places_are_not_gathered(spark, tables, name):
    assert not [x for x in _dealt(__spark_entry__.queries()[name](spark, tables)) if "pos" in x]


@pytest.mark.parametrize("name", ["j13_known_span", "w13_repeated_beside", "j12_rematch", "s8_documents", "x8_speakers", "n18_risk_here"])
def test_words_are_not_dealt(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, tables)
    assert "REPARTITION_BY_COL" in _plan(df) and "SortMergeJoin" not in _plan(df)
    # what is summed up at the end moves sums
    assert len(_dealt(df)) <= (name in ("s8_documents", "n18_risk_here", "j12_rematch")), _dealt(df)


def test_seams_do_not_deal_words(spark, tables):
    df = __spark_entry__.queries()["x1_text_seams"](spark, tables)
    assert all("recording" not in x for x in _dealt(df)) and "Join" not in _plan(df)


def test_no_frame_is_read_anew(spark):
    df = spark.createDataFrame([(1, 0, None, None, "a"), (1, 1, 2.0, 3.0, ""), (1, 2, None, None, "a"), (1, 3, None, None, "b")], "recording long, pos long, start double, end double, f string")
    spans, beside = windows.known_span(df, ("recording",)), windows.repeated_beside(df, ("recording",), "f")
    assert not any("unboundedfollowing" in _plan(x).lower() for x in (spans, beside))
    assert [(x["gap_start"], x["gap_end"]) for x in spans.orderBy("pos").collect()] == [(2.0, 2.0), (None, None), (3.0, 3.0), (3.0, 3.0)]
    assert [x["repeated"] for x in beside.orderBy("pos").collect()] == [True, False, True, False]


def test_only_signs_are_cleaned(spark, tables):
    assert re.search(r"Filter [^\n]*RLIKE", _plan(__spark_entry__.queries()["n15_risk_shapes"](spark, tables)))


def test_vote_in_a_row_is_the_vote_over_rows(spark):
    r = random.Random(4)
    names = ("deepgram", "openai", "elevenlabs", "microsoft")
    made = []
    for pos in range(400):
        row = {"recording": pos % 3, "pos": pos}
        for k, name in enumerate(names):
            text = r.choice(("cat", "Cat", "cät", "5kg", "12%", "cot"))
            one = (text, text.lower(), r.choice((None, 0.2, 0.6, 0.9)), r.choice((0.3, 0.8, None)), k == 2, r.choice(("none", "exact", "equivalent", "misrecognition")), r.choice((1.0, 0.5)))
            row[name] = None if r.random() < 0.3 else one
        made.append(row)
    one = "struct<text:string,form:string,acoustic:double,quality:double,is_backbone:boolean,vocabulary:string,language_weight:double>"
    places = spark.createDataFrame([tuple(x.values()) for x in made], "recording long, pos long, " + ", ".join(f"{n} {one}" for n in names))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("provider"), F.col(n).alias("x")) for n in names)))
    rows = places.select("recording", "pos", each.alias("e")).select("recording", "pos", "e.provider", "e.x.*").where("form is not null")
    weights = spark.createDataFrame([("openai", 0.5), ("microsoft", 0.95)], "provider string, weight double")
    for w in (None, weights):
        got = reconcile.voted(places, names, w)
        # what counts of a risk, as that of a place without a rival counts nowhere
        pick = lambda df: {(x["recording"], x["pos"]): x for x in df.select("recording", "pos", "text", "form", "score", "rival", "rival_score", "acoustic", F.round("quality", 9).alias("quality"), "n_services", "n_contesting", "in_vocabulary", F.expr("risky and rival is not null").alias("risky"), F.round("strength", 9).alias("strength"), "category", "unresolved", "reasons", "kept").collect()}
        assert pick(got) == pick(reconcile.decided(reconcile.scored(rows, w), services=len(names)))


def test_rounding():
    assert reconcile.half_up(reconcile.np.array([0.1234565, 0.1234575, 0.12345649, 1.0, 0.0]), 6).tolist() == [0.123457, 0.123458, 0.123456, 1.0, 0.0]


def test_same_but_for_case(spark):
    pairs = [("Cat", "cAT"), ("Müller", "MüLLER"), ("Müller", "MÜller"), ("CAN'T", "can't"), ("a", "b"), ("Á", "á"), ("K", "k")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", N.same_but_for_case(F.col("a"), F.col("b")).alias("x"))
    for x in df.collect():
        assert not x["x"] or N.all_forms(x["a"]) == N.all_forms(x["b"])
    assert [x["x"] for x in df.collect()] == [True, True, False, True, False, True, False]


def test_groups_of_different_texts(spark):
    said = [["Jurgen", "Jürgen", "Juergen"], ["Juergen", None, "Jürgen"], ["cat", "cot", None]]
    out = reconcile.equivalent_groups(spark.createDataFrame([(x,) for x in said], "texts array<string>")).collect()
    assert {tuple(x["texts"]): x["groups"] for x in out} == {tuple(said[0]): 2, tuple(said[1]): 1, tuple(said[2]): 2}


def test_heard_here(spark):
    df = spark.createDataFrame([("a", None, "b"), (None, None, None)], "elevenlabs string, openai string, microsoft string")
    assert [x["h"] for x in df.select(joins.heard_here(("elevenlabs", "openai", "microsoft")).alias("h")).collect()] == ["elevenlabs: a; microsoft: b", None]


def test_seams_of_two_services(spark):
    said = {("a", 0): "x y one two three", ("a", 1): "one two three z", ("b", 0): "p q r", ("b", 1): "s t u"}
    tokens = [(7, p, c, k, w) for (p, c), t in said.items() for k, w in enumerate(t.split())]
    chunks = [(7, p, c, c * 10.0, c * 10.0 + 12) for p, c in said]
    out = stitch.by_text(
        spark.createDataFrame(tokens, "recording long, provider string, chunk long, token_index long, form string"), spark.createDataFrame(chunks, "recording long, provider string, chunk long, start double, end double")
    )
    want = {(p, 1): stitch.text_seam(said[p, 0].split(), said[p, 1].split(), 2.0)[1:] for p in "ab"}
    assert {(x["provider"], x["chunk"]): (x["skipped"], x["how"]) for x in out.collect()} == want


def test_seams_are_those_of_all_runs():
    def plain(before, after, overlap):
        reach = min(len(after), stitch.math.ceil(overlap * stitch.WORDS_A_SECOND))
        runs = [(n, -k) for k in range(reach) for n in range(stitch.LEAST_RUN, min(len(before), len(after) - k) + 1) if before[-n:] == after[k : k + n]]
        if not runs:
            return len(before), min(len(after), round(reach / 2)), "uncertain"
        return len(before), max(runs)[0] - max(runs)[1], "matched"

    r = random.Random(3)
    for _ in range(5000):
        a, b = ([r.choice("ab" if r.random() < 0.5 else "abc") for _ in range(r.randrange(14))] for _ in range(2))
        overlap = r.choice((0.0, 0.5, 2.0))
        assert stitch.text_seam(a, b, overlap) == plain(a, b, overlap)
    # a run of thousands is found without trying each length
    long = [str(k) for k in range(6000)]
    assert stitch.text_seam(long, long, 1000.0) == (6000, 6000, "matched")
