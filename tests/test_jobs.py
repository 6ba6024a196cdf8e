import json
import random

from pyspark.sql import functions as F

from hearweave.operators import alignment, joins, matching, windows
from hearweave.plans import grouping, reconcile, stitch
from hearweave.sources import files, responses
from hearweave.streaming import jobs


def _cost(a, b, steps):
    total = 0.0
    for i, i2, j, j2 in steps:
        status, _, _ = alignment.described(a[i:i2], b[j:j2])
        if status in ("insertion", "deletion"):
            total += 1.0
        elif status in ("merge", "split"):
            total += 0.15
        else:
            x, y = alignment.N.all_forms(a[i]), alignment.N.all_forms(b[j])
            same = x[6] == y[6] or ((x[8] or y[8]) and x[7] == y[7])
            total += 0.0 if a[i] == b[j] else 0.05 if same else 1.4 - 0.6 * alignment.N.ratio(x[6], y[6])
    return total


def test_alignment_is_cheapest():
    r = random.Random(2)
    words = ["data", "base", "database", "twenty", "five", "25", "Jürgen", "Jurgen", "cat", "cot"]

    def best(a, b):
        """Every path, by recursion over prefixes."""
        memo = {}

        def go(i, j):
            if (i, j) in memo:
                return memo[i, j]
            if not i and not j:
                return 0.0
            options = []
            for x, y in ((1, 1), (1, 0), (0, 1), (2, 1), (3, 1), (1, 2), (1, 3)):
                if i >= x and j >= y:
                    if x > 1 or y > 1:
                        p, q = alignment.N.all_forms(" ".join(a[i - x : i])), alignment.N.all_forms(" ".join(b[j - y : j]))
                        if not (p[6] == q[6] or ((p[8] or q[8]) and p[7] == q[7])):
                            continue
                    options.append(go(i - x, j - y) + _cost(a[i - x : i], b[j - y : j], [(0, x, 0, y)]))
            memo[i, j] = min(options)
            return memo[i, j]

        return go(len(a), len(b))

    for _ in range(60):
        a, b = ([r.choice(words) for _ in range(r.randint(0, 6))] for _ in range(2))
        steps = alignment.align(a, b)
        assert [k for i, i2, _, _ in steps for k in range(i, i2)] == list(range(len(a)))
        assert [k for _, _, j, j2 in steps for k in range(j, j2)] == list(range(len(b)))
        assert abs(_cost(a, b, steps) - best(a, b)) < 1e-9


def test_aligned_on_spark(spark):
    r = random.Random(3)
    left = [f"w{k}" if k % 3 else "the" for k in range(120)]
    right = [x for k, x in enumerate(left) if k % 11]
    rows = [(1, "elevenlabs", k, x, x) for k, x in enumerate(left)] + [(1, "openai", k, x, x) for k, x in enumerate(right)]
    tokens = spark.createDataFrame(rows, "recording long, provider string, pos long, text string, form string")
    out = alignment.aligned(tokens, "elevenlabs").collect()
    assert sum(x["status"] == "deletion" for x in out) == 11 and sum(x["status"] == "exact" for x in out) == 109
    assert r.random() < 1 and alignment.rising_run([(1, 5), (2, 1), (3, 2), (4, 9), (5, 3)]) == [(2, 1), (3, 2), (5, 3)]


def test_grouping_pairs_are_complete(spark):
    r = random.Random(4)
    words = list({"".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(120)})
    forms = spark.createDataFrame([(w,) for w in words], "form string")
    got = {(x["a"], x["b"]) for x in grouping.similar_pairs(forms).collect()}
    long = [w for w in words if len(w) >= 4]
    assert got == {(a, b) for a in long for b in long if a < b and alignment.N.ratio(a, b) >= grouping.LIKENESS}


def test_blocks_of_long_chains(spark):
    order = sorted(range(60), key=lambda k: k * 37 % 60)  # neighbours are far apart in the order of names
    chains = [("a", list(range(60))), ("b", order)]
    pairs = [(f"{x}{a:02d}", f"{x}{b:02d}") for x, c in chains for a, b in zip(c, c[1:])]
    found = grouping.blocks(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {r["form"]: r["block"] for r in found} == {f"{x}{k:02d}": f"{x}00" for x, c in chains for k in c} and len(found) == 120


def test_grouped_words(spark):
    rows = [("bosch", "en", 0.40, 1), ("bosche", "en", 0.42, 2), ("bosch", "de", 0.41, 3), ("ledger", "en", 0.2, 4), ("ledgers", "en", 0.5, 5), ("bosch", "unknown", 0.41, 6)]
    df = spark.createDataFrame(rows, "form string, language string, strength double, decided_at long")
    got = {(x["form"], x["language"]): x["group"] for x in grouping.grouped(df).collect()}
    assert got["bosch", "en"] == got["bosche", "en"] == got["bosch", "unknown"] != got["bosch", "de"]
    assert got["ledger", "en"] != got["ledgers", "en"]


def test_text_seams():
    assert stitch.text_seam("a b c d e".split(), "c d e f".split(), 2.0) == (5, 3, "matched")
    assert stitch.text_seam("a b".split(), "x y z w".split(), 1.0)[2] == "uncertain"


def test_label_map(spark):
    rows = [(1, "s0", "A", 5.0), (1, "s0", "B", 4.0), (1, "s1", "B", 3.0), (1, "s1", "C", 1.0)]
    out = {x["speaker_2"]: x["mapped"] for x in matching.label_map(spark.createDataFrame(rows, "recording long, speaker string, speaker_2 string, shared double")).collect()}
    assert out == {"A": "s0", "B": "s1", "C": None}


def test_rematch(spark):
    words = [(1, 0, "t0", "bosch", 1.0, "to", "about"), (1, 5, "t5", "bosch", 1.5, "with", "again"), (1, 9, "t9", "x", 3.0, "", "")]
    saved = [(1, 10, 0, "gone", "bosch", 1.25, "with", "again"), (1, 11, 1, "t0", "bosch", 1.0, "to", "about"), (1, 12, 2, "gone", "x", 9.0, "", "")]
    s = spark.createDataFrame(saved, "recording long, occurrence long, ordinal long, token string, form string, start double, before string, after string")
    w = spark.createDataFrame(words, "recording long, pos long, token string, form string, start double, before string, after string")
    assert {x["occurrence"]: x["pos"] for x in matching.rematched(s, w).collect()} == {10: 5, 11: 0, 12: None}


def test_answer_words(spark):
    d = spark.createDataFrame([(1, 7, 1.0, 2.0), (1, 8, 2.1, 2.2)], "recording long, dispute long, start double, end double")
    a = spark.createDataFrame([(1, 0, "yes", 1.2, 1.6), (1, 1, "no", 2.15, 2.25)], "recording long, pos long, text string, start double, end double")
    assert {x["dispute"]: x["heard"] for x in matching.answer_words(d, a).collect()} == {7: "yes", 8: "no"}


def test_escalation_windows(spark):
    rows = [(1, 0, 0.0, 1.0, False), (1, 1, 8.0, 9.0, True), (1, 2, 30.0, 31.0, False), (1, 3, 38.0, 95.0, False)]
    d = spark.createDataFrame(rows, "recording long, dispute long, start double, end double, third boolean")
    got = [(x["start"], x["end"], x["n_disputes"], x["third"]) for x in reconcile.escalation_windows(d).orderBy("window").collect()]
    assert got == [(0.0, 14.0, 2, True), (25.0, 36.0, 1, False), (33.0, 100.0, 1, False)]


def test_window_requests(spark):
    rows = [(1, 0, True), (1, 1, False), (2, 0, True), (3, 0, True), (1, 2, None)]
    on = spark.createDataFrame([(1, True), (1, True), (2, False)], "recording long, enabled boolean")
    out = reconcile.window_requests(spark.createDataFrame(rows, "recording long, window long, third boolean"), "p", "f", on)
    got = {(x["recording"], x["window"]): (x["model"], x["strength"]) for x in out.collect()}
    decides = ("p", "deciding")
    assert got == {(1, 0): ("f", "informing"), (1, 1): decides, (2, 0): decides, (3, 0): decides, (1, 2): decides} and out.count() == len(rows)


def test_high_risk_is_never_settled(spark):
    rows = [(1, 0, "openai", "R500", "r500", 0.99, 1.0, True, "none", 1.0), (1, 0, "deepgram", "R600", "r600", 0.05, 0.1, False, "none", 1.0)]
    r = spark.createDataFrame(rows, "recording long, pos long, provider string, text string, form string, acoustic double, quality double, is_backbone boolean, vocabulary string, language_weight double")
    places = spark.createDataFrame([(1, 0, 0, 1.0)], "recording long, pos long, n_silent long, language_support double")
    assert reconcile.decided(reconcile.scored(r), places).first()["category"] == "unresolved"


def test_scopes(spark):
    c = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 3, 4), (1, 5, 5)], "recording long, first long, last long")
    got = {x["pos"]: x["scope"] for x in reconcile.scopes(c).collect()}
    assert got[1] == got[2] == got[3] == got[4] and len({got[0], got[1], got[5]}) == 3


def test_broken_answers(spark):
    raw = spark.createDataFrame([(1, 0.0, "{broken"), (2, 0.0, json.dumps({"words": [{"text": "a", "start": 2.0, "end": 1.0}]}))], "recording long, offset double, body string")
    rows = responses.elevenlabs(raw).collect()
    assert [(x["recording"], x["text"], x["start"], x["end"]) for x in rows] == [(2, "a", 2.0, 2.0)]
    bodies = [(json.dumps({"tokens": []}),), (json.dumps({"recording_name": "x", "tokens": [{"text": "a", "confidence_strength": 7}, {"confidence_strength": 0.5}]}),)]
    words = files.words_of(files.parsed_documents(spark.createDataFrame(bodies, "body string"))).orderBy("pos").collect()
    assert [(w["text"], w["strength"]) for w in words] == [("a", None), ("", 0.5)]


def test_audio_files(spark, tmp_path):
    for name in ("b.MP3", "A.wav", "x.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert [x["name"] for x in files.recordings(spark, str(tmp_path)).collect()] == ["A.wav", "b.MP3"]


def test_word_budget(spark):
    rows = [(1, k, n) for k, n in enumerate((5, 4, 3, 20, 1))]
    got = windows.word_budget_parts(spark.createDataFrame(rows, "recording long, turn long, n_words long"), ("recording",), 10)
    assert [x["part"] for x in got.orderBy("turn").collect()] == [0, 0, 1, 2, 3]


def test_decision_checks(spark):
    spans = spark.createDataFrame([(1, "the cat", False, ["the cat", "a cot"]), (2, "R5", True, ["R6"]), (3, "x", False, ["y"])], "span long, text string, high_risk boolean, offered array<string>")
    told = [(1, 1, "replace", "the cat", "a cot"), (1, 2, "keep", "the cat", "the cat"), (2, 3, "replace", "R5", "R6"), (9, 4, "keep", "", "")]
    out = joins.checked_decisions(spans, spark.createDataFrame(told, "span long, ordinal long, action string, from_text string, to_text string")).collect()
    assert sorted((x["span"], x["verdict"]) for x in out) == [(1, "accepted"), (1, "second_answer"), (2, "high_risk"), (3, "unanswered"), (9, "unknown_span")]


def test_intake_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "recording long, pos long, text string, form string, language string, human_corrected boolean, strength double"
    spark.createDataFrame([(1, 0, "bosh", "bosh", "en", False, 0.4), (1, 1, "fine", "fine", "en", False, 0.9), (1, 2, "odd", "odd", "en", False, 0.3)], schema).write.parquet(str(source))
    rules = spark.createDataFrame([("bosh", "en", "Bosch", 1)], "form string, language string, replacement string, ordinal long")
    for _ in range(2):  # the second run finds no new file
        jobs.intake(spark.readStream.schema(schema).parquet(str(source)), rules, jobs.replace(str(out)), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(out)).select("pos", "action").orderBy("pos").collect()
    assert [tuple(x) for x in got] == [(0, "replaced"), (2, "queued")]


def test_newest_rules_stream(spark, tmp_path):
    schema = "folder string, form string, language string, replacement string, decided_at long"
    source = str(tmp_path / "in")
    spark.createDataFrame([("f", "a", "en", "A", 1), ("f", "a", "en", "B", 3), ("f", "a", "en", "C", 2)], schema).coalesce(1).write.parquet(source)
    out = jobs.run_once(jobs.newest_rules(spark.readStream.schema(schema).parquet(source)), f"file://{tmp_path}", "update").collect()
    assert [x["replacement"] for x in out] == ["B"]


def test_entry(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert queries["s7_languages"](spark, "/root/testdata/sf0.001").where(F.col("language") == "af").count() == 0
