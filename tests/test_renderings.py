"""Rendered texts against plain loops."""

import random
import textwrap
from pathlib import Path

from pyspark.sql import functions as F

from hearweave.functions import columns as C
from hearweave.plans import renderings


def _texts(lines):
    out = {}
    for x in lines.orderBy("recording", *renderings.ORDER).collect():
        out.setdefault(x["recording"], []).append(x["line"])
    return out


def _clock(s):
    s = round(max(0, s))
    return f"{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"


def test_plain_text(spark, tmp_path):
    r = random.Random(3)
    words = []
    for k in range(1, 20):
        speaker = None
        for p in range(r.randint(0, 120)):
            speaker = r.choice(["a", "b", None]) if r.random() < 0.15 else speaker
            words.append((k, p, r.choice(["twenty-five", "word", "x" * 90, ",", ".", "", "Ünïcode"]), r.choice([None, p * 40.0]), speaker if r.random() < 0.9 else None))
    headers = [(k, f"rec {k}", r.choice([None, k * 500.0]), r.choice([None, "", "2026-08-17T10:04:00"]), ["One", "Two", "Three"][: k % 4]) for k in range(1, 21)]
    names = [(k, "a", f"Anna {k}") for k in range(1, 20)]
    df = spark.createDataFrame(words, "recording long, pos long, text string, start double, speaker string")
    heads = spark.createDataFrame(headers, "recording long, name string, duration double, transcribed string, services array<string>")
    lines = renderings.plain_lines(df, heads, spark.createDataFrame(names, "recording long, speaker string, name string"), 40)
    got = _texts(lines)
    assert len(got) == 20
    for k, name, duration, when, services in headers:
        own = [x for x in words if x[0] == k]
        want = [f"Recording: {name}"] + ([f"Length: {_clock(duration)}"] if duration is not None else []) + (["Transcribed: 17 August 2026 at 10:04"] if when else [])
        want += ["Services: " + ("none" if not services else services[0] if len(services) == 1 else ", ".join(services[:-1]) + " and " + services[-1])]
        turns = []
        for _, _, text, start, speaker in own:
            if not turns or (speaker is not None and speaker != turns[-1][0]):
                turns.append((speaker, start, []))
            if text and turns[-1][2] and text in ",.":
                turns[-1][2][-1] += text
            elif text:
                turns[-1][2].append(text)
        want += [] if own else ["", "This recording produced no words."]
        for speaker, start, said in turns:
            if said:
                want += ["", f"[{'--:--' if start is None else _clock(start)}] " + ("Unknown speaker" if speaker is None else f"Anna {k}" if speaker == "a" else "Speaker b") + ":", *textwrap.wrap(" ".join(said), 40)]
        assert got[k] == want, k
    renderings.write_texts(lines, str(tmp_path / "out"))
    for k in (1, 7, 20):
        (file,) = Path(tmp_path / "out" / f"recording={k}").glob("part-*")
        assert file.read_text().split("\n")[:-1] == got[k]
    assert renderings.plain_lines(df.limit(0), heads.limit(0), spark.createDataFrame(names, "recording long, speaker string, name string")).count() == 0


def test_smooth_text(spark):
    r = random.Random(8)
    turns = [(k, p, n, r.choice("ab"), r.choice(["", None, "yes, I said so and more words to fill the line", "no"])) for k in range(1, 25) for p in range(3) for n in range(p * 5, p * 5 + r.randint(0, 5))]
    warnings = [(k, p, "kept as it was, since the answer failed") for k in range(1, 25) for p in range(3) if r.random() < 0.4]
    headers = [(k, f"rec {k}", r.choice([None, "", "m1"])) for k in range(1, 25)]
    lines = renderings.smooth_lines(
        spark.createDataFrame(turns, "recording long, part long, number long, speaker string, text string"), spark.createDataFrame(headers, "recording long, name string, model string"),
        spark.createDataFrame(warnings, "recording long, part long, warning string"), 30,
    )
    got = _texts(lines)
    for k, name, model in headers:
        want, last = [f"Recording: {name}", f"Edited{' by ' + model if model else ''} for easy reading. transcript.txt holds the literal words."], None
        blocks = []
        for p in range(3):
            blocks += [(None, f"[WARNING: {x[2]}]") for x in warnings if x[:2] == (k, p)]
            for _, _, _, speaker, text in (x for x in turns if x[:2] == (k, p) and x[4]):
                if blocks and blocks[-1][0] == speaker:
                    blocks[-1] = (speaker, blocks[-1][1] + " " + text)
                else:
                    blocks.append((speaker, text))
        for speaker, text in blocks:
            want += ["", *([f"{speaker}:"] if speaker else []), *textwrap.wrap(text, 30)]
        assert got[k] == want, k


def test_spoken_duration(spark):
    rows = [(0.0, "0 seconds"), (61.0, "1 minute 1 second"), (3600.0, "1 hour"), (7322.4, "2 hours 2 minutes 2 seconds"), (None, "Unknown"), (-5.0, "0 seconds")]
    df = spark.createDataFrame(rows, "s double, want string")
    assert df.where(~C.spoken_duration(F.col("s")).eqNullSafe(F.col("want"))).count() == 0
