"""Risky values, speakers, disputes, answers and the whole job against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from hearweave.functions import columns as C
from hearweave.functions import forms as N
from hearweave.operators import alignment
from hearweave.plans import reconcile, risks, speakers, whole


def _column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers():
    said = {
        "twenty five": "25", "einundzwanzig": "21", "eine Million": "1 million", "ein tausend": "1000", "ein Uhr": "1 uhr", "ein": "ein", "hundert": "hundert", "einhundert": "100",
        "zweitausend fünf": "2005", "nineteen eighty four": "nineteen eighty four", "vyf en ses": "vyf en ses", "honderd en vyf": "105", "R15,000": "r15000", "$1,000.50": "$1000.50",
        "1.000,50": "1.000,50", "-1,200": "-1200", "often": "often", "fuenfundzwanzig": "25", "two thousand three hundred and four": "2304", "in 2024 25 people": "in 2024 25 people",
    }
    for text, want in said.items():
        assert N.number_form(text) == want, text
    assert N.read_number("fünfzig") == 50 and N.read_number("25 people") is None and N.is_number_word("and") and not N.is_number_word("people")


def test_redaction(spark):
    names = {"api_key": True, "auth": True, "Access-Token": True, "keyword": False, "keyterms": False, "monkey": False, "max_tokens": False, "author": False, "note": False}
    values = {"sk_live": True, "Basic abc": True, "bearer x": True, "a1" * 16: True, "z" * 40: True, "z" * 39: False, "en-GB": False, "": False}
    assert _column(spark, names, C.is_secret_name) == list(names.values())
    assert [bool(x) for x in _column(spark, values, C.is_secret_value)] == list(values.values())
    shown = _column(spark, [{"auth": "abc", "keyterms": "x", "k": "sk_live"}], C.redacted, "map<string,string>")[0]
    assert shown == {"auth": "[redacted]", "keyterms": "x", "k": "[redacted]"}


def test_risk_shapes(spark):
    want = {
        "12%": {"percentage"}, "R500": {"money"}, "€5": {"money"}, "10:30": {"time"}, "10:30:05": {"time"}, "2024-05-06": {"date"}, "5/6/24": {"date"}, "05/2024": {"date"}, "1999": {"date"}, "3rd": {"date"},
        "v1.2": {"version_number"}, "5kg": {"quantity"}, "5.6": {"quantity"}, "1,500": {"quantity"}, "5-6-24": {"product_code"} - {"product_code"}, "0821234567": {"telephone", "account_number"}, "abc-12": {"product_code"},
        "word": set(), "12.05": {"time", "quantity"}, "-5": set(), "25": set(), "(25)": set(),
    }
    found = _column(spark, want, lambda x: C.risk_categories(C.cleaned(x)))
    assert {k: set(v) for k, v in zip(want, found)} == want
    assert _column(spark, ["“(-5)”", "…Word.", "50%,", "−7"], C.cleaned) == ["-5", "word", "50%", "-7"]


def _risks(words, keywords):
    """Categories of each place, by the rules on a list of (clean, numeric, value)."""
    out = [set() for _ in words]
    for i, (w, _, _) in enumerate(words):
        for word, category, needs in keywords:
            reach = [j for j in range(max(0, i - 3), min(len(words), i + 4)) if words[j][1]]
            if w == word and (reach or not needs):
                for j in range(min([i, *reach]), max([i, *reach]) + 1):
                    out[j].add(category)
    run = []
    for i, (w, _, v) in enumerate([*words, ("", False, None)]):
        if (w.isdigit() and len(w) <= 3) or (v is not None and v < 100 and w.isalpha()):
            run.append(i)
            continue
        if len(run) >= 4:
            for j in run:
                out[j] |= {"telephone", "account_number"}
        run = []
    dates = {w for w, c, _ in keywords if c == "date"} | {"1999"}
    for i, (w, _, _) in enumerate(words):
        near = [j for j in range(max(0, i - 3), min(len(words), i + 4)) if j != i and words[j][0] in dates]
        before = [x for x, _, _ in words[max(0, i - 2) : i]]
        led = [i - 1] if before[-1:] == ["am"] else [i - 2] if before == ["on", "the"] else []
        if w == "fifteenth":
            out[i].add("date")
        elif w == "first" and (near or led):
            for j in range(min([i, *(near or led)]), max([i, *(near or led)]) + 1):
                out[j].add("date")
    for i, (w, _, _) in enumerate(words):
        if w == "1999":
            out[i].add("date")
    claimed = [bool(x) for x in out]
    for i, (w, numeric, _) in enumerate(words):
        if numeric and not claimed[i] and w != "one":
            out[i].add("quantity")
    return out


def test_risks_by_context(spark):
    r = random.Random(1)
    kinds = {"rand": (False, None), "may": (False, None), "account": (False, None), "five": (True, 5), "one": (True, 1), "12": (True, 12), "1999": (True, 1999), "first": (False, None), "fifteenth": (False, None), "am": (False, None), "on": (False, None), "the": (False, None), "word": (False, None)}
    keywords = [("rand", "money", True), ("may", "date", False), ("account", "account_number", True)]
    texts = [[r.choice(list(kinds)) for _ in range(r.randint(1, 14))] for _ in range(120)]
    rows = [(k, i, w, *kinds[w]) for k, words in enumerate(texts) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "recording long, pos long, clean string, numeric boolean, number_value long")
    kw = spark.createDataFrame(keywords, "word string, category string, needs_number boolean")
    got = {}
    for x in risks.find_risks(df, kw).collect():
        assert x["category"] not in got.setdefault((x["recording"], x["pos"]), set())
        got[x["recording"], x["pos"]].add(x["category"])
    near = {}
    for x in risks.risks_at(df, kw).collect():
        near.setdefault((x["recording"], x["pos"]), set()).add(x["category"])
    for k, words in enumerate(texts):
        data = [(w, *kinds[w]) for w in words]
        want = _risks(data, keywords)
        for i in range(len(words)):
            assert got.get((k, i), set()) == want[i], (words, i)
            a = max(0, i - 3)
            assert near.get((k, i), set()) == _risks(data[a : i + 4], keywords)[i - a], (words, i)


def test_risk_of_candidates(spark):
    """Each reading is put in among the words in turn; a reading beside no known word stands alone."""
    r = random.Random(2)
    kinds = {"rand": (False, None), "may": (False, None), "five": (True, 5), "one": (True, 1), "12": (True, 12), "1999": (True, 1999), "first": (False, None), "fifteenth": (False, None), "am": (False, None), "word": (False, None)}
    keywords = [("rand", "money", True), ("may", "date", False)]
    texts = [[r.choice(list(kinds)) for _ in range(r.randint(1, 12))] for _ in range(60)]
    said = [(k, i, r.choice(list(kinds))) for k, words in enumerate(texts) for i in range(len(words)) for _ in range(2)] + [(99, 0, "five"), (99, 1, "word")]
    words = spark.createDataFrame([(k, i, w, kinds[w][1]) for k, ws in enumerate(texts) for i, w in enumerate(ws)], "recording long, pos long, text string, number_value long")
    candidates = spark.createDataFrame([(n, *x, kinds[x[2]][1]) for n, x in enumerate(said)], "n long, recording long, pos long, text string, number_value long")
    kw = spark.createDataFrame(keywords, "word string, category string, needs_number boolean")
    got = {x["n"]: x["risks"] for x in risks.of_candidates(candidates, words, kw).collect()}
    assert len(got) == len(said)
    for n, (k, i, w) in enumerate(said):
        around = [*texts[k][max(0, i - 3) : i], w, *texts[k][i + 1 : i + 4]] if k < 99 else [w]
        want = _risks([(x, *kinds[x]) for x in around], keywords)[min(i, 3) if k < 99 else 0]
        assert set(got[n]) == want and len(got[n]) == len(want), (around, w)


def test_ordinals(spark):
    want = {"fifteenth": "high", "ersten": "low", "zwölften": "high", "zwoelfte": "high", "einundzwanzigsten": "high", "twenty-first": "high", "een-en-twintigste": "high", "second": "low", "achten": "low", "forest": None, "achtzehnte": "high"}
    assert _column(spark, want, risks.ordinal_rank) == list(want.values())


def test_numbers_disagree(spark):
    rows = [("25", "25", 25, 25, False), ("25", "twenty-five", 25, 25, False), ("25", "26", 25, 26, True), ("1,500", "1500", 1500, 1500, True), ("25", "people", 25, None, True), ("a", "b", None, None, False)]
    df = spark.createDataFrame(rows, "a string, b string, x long, y long, want boolean")
    assert df.where(C.numbers_disagree(F.col("a"), F.col("b"), F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_decided_speakers(spark):
    rows = [(1, "a", 0, "s0"), (1, "a", 1, "s0"), (1, "a", 2, "s1"), (1, "a", 3, None), (1, "a", 4, "s1"), (1, "b", 0, "A"), (1, "b", 1, "B"), (1, "b", 2, "C"), (1, "b", 4, "C"), (2, "a", 0, None), (2, "b", 0, None)]
    df = spark.createDataFrame([(*x, float(x[2]), x[2] + 0.5) for x in rows], "recording long, provider string, pos long, speaker string, start double, end double")
    got = {(x["recording"], x["pos"]): (x["speaker"], x["confidence"], x["reasons"]) for x in speakers.decided_speakers(df, "a").collect()}
    doubt = ["speaker_uncertain"]
    assert got == {(1, 0): ("s0", "high", []), (1, 1): ("s0", "review_suggested", doubt), (1, 2): ("s1", "high", []), (1, 3): (None, "unresolved", doubt), (1, 4): ("s1", "high", []), (2, 0): (None, "high", [])}


def test_answers(spark):
    turns = '{"turns": [{"number": 1, "text": " a "}, {"number": 2, "text": ""}]}'
    bodies = {"": "the answer was empty", "{x": "the answer was not valid JSON", "{}": "the answer had no list of turns", '{"turns": 3}': "the answer had no list of turns", '{"turns": [3]}': "the answer held a turn that was not an object", '{"turns": [{"text": "a"}]}': "the answer held a turn with no number", '{"turns": [{"number": true, "text": "a"}]}': "the answer held a turn with no number", '{"turns": [{"number": 1, "text": 2}]}': "the answer held a turn with no text", '{"turns": [{"number": 1, "text": "a"}, {"number": 1, "text": "b"}]}': "the answer gave a turn more than once", turns: None}
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    told, problem = C.answered_turns(F.col("body"))
    got = {x["body"]: (x["p"], [tuple(t) for t in x["t"]]) for x in df.select("body", told.alias("t"), problem.alias("p")).collect()}
    assert {b: p for b, (p, _) in got.items()} == bodies
    assert got[turns][1] == [(1, "a"), (2, "")] and [t for b, (p, t) in got.items() if p and "more than once" in p] == [[(1, "b")]]


def test_times(spark):
    shown = {"2026-08-17T10:04:00": "17 August 2026 at 10:04", "soon": "soon", "2026-08-17T10:04:00+02:00": "17 August 2026 at 10:04"}
    assert _column(spark, shown, C.readable_time) == list(shown.values())


def _plain_cost(a, b):
    """The cheapest path's cost over all cells."""
    x, y = [N.all_forms(w) for w in a], [N.all_forms(w) for w in b]
    agree = lambda p, q: p[6] == q[6] or ((p[8] or q[8]) and p[7] == q[7])
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [0.0] if not i and not j else []
            if i and j:
                ways.append(best[i - 1, j - 1] + (0.0 if a[i - 1] == b[j - 1] else 0.05 if agree(x[i - 1], y[j - 1]) else 1.4 - 0.6 * N.ratio(x[i - 1][6], y[j - 1][6])))
            ways += [best[i - 1, j] + 1.0] if i else []
            ways += [best[i, j - 1] + 1.0] if j else []
            for k in range(2, 11):
                if i >= k and j and (k <= 3 or all(f[12] for f in x[i - k : i])) and agree(N.all_forms(" ".join(a[i - k : i])), y[j - 1]):
                    ways.append(best[i - k, j - 1] + 0.15)
                if j >= k and i and (k <= 3 or all(f[12] for f in y[j - k : j])) and agree(N.all_forms(" ".join(b[j - k : j])), x[i - 1]):
                    ways.append(best[i - 1, j - k] + 0.15)
            best[i, j] = min(ways)
    return best[len(a), len(b)]


def test_alignment_in_a_band():
    r = random.Random(5)
    words = ["data", "base", "database", "twenty", "five", "25", "Jürgen", "Jurgen", "cat", "cot", "one", "hundred", "and", "125", *(f"w{k}" for k in range(12))]
    for seed in range(60):
        a = [r.choice(words) for _ in range(r.randint(1, 24))]
        b = [w for w in a for w in ([] if r.random() < 0.08 else [r.choice(words)] if r.random() < 0.08 else [w, r.choice(words)] if r.random() < 0.08 else [w])]
        b = b[5:] + [r.choice(words) for _ in range(9)] if seed % 9 == 0 else b
        steps = alignment.align(a, b)
        assert [k for i, i2, _, _ in steps for k in range(i, i2)] == list(range(len(a))) and [k for _, _, j, j2 in steps for k in range(j, j2)] == list(range(len(b)))
        total = 0.0
        for i, i2, j, j2 in steps:
            total += 1.0 if i == i2 or j == j2 else 0.15 if i2 - i > 1 or j2 - j > 1 else _plain_cost(a[i:i2], b[j:j2])
        assert abs(total - _plain_cost(a, b)) < 1e-9


def test_full_job(spark):
    said = "we should sign the contract tomorrow in Bosch street".split()
    rows = []
    for provider, words in (("elevenlabs", said), ("openai", said), ("microsoft", [w if w != "Bosch" else "Bosh" for w in said if w != "the"])):
        rows += [(1, provider, k, w, w.lower(), k * 1.0, k + 0.8, "s0" if provider == "elevenlabs" else None, -0.05, "en") for k, w in enumerate(words)]
    t = spark.createDataFrame(rows, "recording long, provider string, pos long, text string, form string, start double, end double, speaker string, log_probability double, language string")
    out = {x["pos"]: x for x in whole.full_job(t, "elevenlabs").collect()}
    assert [out[k]["text"] for k in range(len(said))] == said and all(x["kept"] for x in out.values())
    assert out[0]["category"] == "high" and out[0]["timing_status"] == "exact" and out[0]["speaker"] == "s0" and out[0]["language"] == "en"
    assert "proper_name_disagreement" in out[7]["reasons"]


def test_full_job_knows_risks_by_context(spark):
    """A contested word between an amount and its currency is risky only with keywords; numbers that differ are told."""
    heard = {"elevenlabs": "we paid fifteen cool rand then", "openai": "we paid fifteen cool rand then", "microsoft": "we paid fifty kool rand then"}
    rows = []
    for provider, text in heard.items():
        rows += [(1, provider, k, w, w.lower(), k * 1.0, k + 0.8, "s0", -0.05, "en") for k, w in enumerate(text.split())]
    t = spark.createDataFrame(rows, "recording long, provider string, pos long, text string, form string, start double, end double, speaker string, log_probability double, language string")
    kw = spark.createDataFrame([("rand", "money", True)], "word string, category string, needs_number boolean")
    plain = {x["pos"]: x for x in whole.full_job(t, "elevenlabs").collect()}
    near = {x["pos"]: x for x in whole.full_job(t, "elevenlabs", keywords=kw).collect()}
    assert [near[k]["text"] for k in range(6)] == heard["elevenlabs"].split()
    assert plain[3]["category"] != "unresolved" and near[3]["category"] == "unresolved" and "high_risk_entity" in near[3]["reasons"]
    assert near[2]["category"] == "unresolved" and {"high_risk_entity", "numeric_disagreement"} <= set(near[2]["reasons"]) and "numeric_disagreement" not in near[3]["reasons"]
    assert "high_risk_entity" not in near[4]["reasons"] and near[5]["category"] == plain[5]["category"]


def test_words_put_in(spark):
    said = "we should sign the contract tomorrow in Bosch street".split()
    more = said[:3] + ["really"] + said[3:] + ["please", "please"]
    rows = []
    for provider, words in (("elevenlabs", said), ("openai", more), ("microsoft", [*more[:-1], "um"])):
        rows += [(1, provider, k, w, w.lower(), k * 1.0, k + 0.8, "s0", -0.05 if w != "um" else -3.0, "en") for k, w in enumerate(words)]
    t = spark.createDataFrame(rows, "recording long, provider string, pos long, text string, form string, start double, end double, speaker string, log_probability double, language string")
    out = sorted(((x["pos"], x["inserted"], x["text"], x["kept"], x["start"], x["end"]) for x in whole.full_job(t, "elevenlabs").collect()))
    assert [x[2] for x in out if x[1] == 0] == said
    put = [x[:4] for x in out if x[1]]
    assert put[0] == (2, 1, "really", True) and put[1][:3] == (8, 1, "please") and put[1][3]
    assert sorted(x[2] for x in put[2:]) == ["please", "um"] and not [x for x in put[2:] if x[2] == "um"][0][3]
    assert [x[4:] for x in out if x[2] == "really"] == [(2.8, 3.0)]


def test_readings_join_the_first_equivalent(spark):
    r = random.Random(5)
    texts = ["Jurgen", "Jürgen", "Juergen", "jurgen,", "25", "twenty-five", "Bosch"]
    rows = [(k, j, f"p{j}", r.choice(texts)) for k in range(150) for j in range(r.randint(1, 5))]
    readings = N.with_forms(spark.createDataFrame(rows, "recording long, k long, provider string, text string"), "text").withColumn("pos", F.lit(0))
    got = {(x["recording"], x["k"]): x["form"] for x in reconcile.by_first_equivalent(readings.select("recording", "pos", "k", "provider", "text", "norm", "norm_dropped", "german"), "k").collect()}
    differs = 0
    for k in range(150):
        groups = []
        for _, j, _, text in (x for x in rows if x[0] == k):
            f = N.all_forms(text)
            home = next((g for g in groups if g[6] == f[6] or ((g[8] or f[8]) and g[7] == f[7])), None)
            if home is None:
                groups.append(home := f)
            assert got[k, j] == home[6]
            differs += home[6] != f[6]
    assert differs and len(got) == len(rows)
