"""Chunk plans against a plain loop over each recording."""

import math
import random

from hearweave.plans import chunks


def _cut_in_two(piece, rate, repeat, most):
    start, end, overlap = piece
    if (end - start) * rate <= most or end - start <= 1:
        return [piece]
    middle, back = (start + end) / 2, min(repeat, (end - start) / 4)
    return _cut_in_two((start, middle, overlap), rate, repeat, most) + _cut_in_two((middle - back, end, back), rate, repeat, most)


def _plain(levels, longest, length, search, shortest, overlap, window, wanted):
    tenth, d = longest * 0.1, max(t for t, _ in levels)
    if d <= longest:
        return [(0.0, d, 0.0)]
    search, shortest, low = min(search, tenth), min(shortest, tenth), min(overlap[0], tenth)
    most = min(max(overlap[1], low), tenth)
    n, places = math.ceil(d / length), [0.0]
    for b in range(1, n):
        ideal = round(b * d / n, 6)
        if d - ideal <= shortest:
            break
        near = [(round(x, 1), round(abs(t - ideal), 6), t) for t, x in levels if round(abs(t - ideal), 6) <= search]
        at = min(max(min(near)[2] if near else ideal, places[-1] + shortest), ideal + search, d - shortest)
        if at <= places[-1]:
            break
        places.append(at)
    speech = sorted(x for _, x in levels)[min(len(levels) - 1, int(len(levels) * 0.9))]
    out = []
    for k, at in enumerate(places):
        voiced, reach = 0.0, low
        for t in sorted((t for t, x in levels if at - most <= t < at and x > speech - 20), reverse=True):
            if round(voiced, 9) >= wanted:
                break
            reach, voiced = max(reach, min(most, at - t)), voiced + window
        reach = 0.0 if k == 0 else min(at, reach)
        out.append((at - reach, places[k + 1] if k + 1 < len(places) else d, reach))
    return out


def test_chunks_overlap_in_speech_and_fit(spark):
    r = random.Random(4)
    levels = {}
    for k in range(30):
        quiet = False
        levels[k] = []
        for t in range(r.choice([30, 200, 900])):
            quiet = quiet != (r.random() < 0.1)
            levels[k].append((t * 1.0, float(r.choice([-60, -59.96, -70] if quiet else [-20, -25, -45]))))
    settings = (100.0, 70.0, 8.0, 6.0, (2.0, 9.0), 1.0, 3.0)
    rows = [(k, t, x) for k, each in levels.items() for t, x in each]
    out = chunks.chunks(spark.createDataFrame(rows, "recording long, t double, level double"), *settings)
    got = {}
    for x in out.orderBy("recording", "chunk").collect():
        got.setdefault(x["recording"], []).append((x["start"], x["end"], x["overlap"]))
    assert {k: [tuple(round(v, 6) for v in x) for x in each] for k, each in got.items()} == {k: [tuple(round(v, 6) for v in x) for x in _plain(levels[k], *settings)] for k in levels}
    assert max(len(x) for x in got.values()) > 5 and len({x[2] for each in got.values() for x in each}) > 4


def test_halving_until_all_fit(spark):
    r = random.Random(6)
    rows = [(k, c, c * 100.0, c * 100.0 + r.choice([0.5, 3.0, 40.0, 100.0]), 2.0 * (c > 0), r.choice([0.5, 3.0, 40.0, 300.0, None])) for k in range(25) for c in range(r.randint(1, 4))]
    df = spark.createDataFrame(rows, "recording long, chunk long, start double, end double, overlap double, bytes_per_second double")
    got = {}
    for x in chunks.halved(df, 3.0, 130.0).orderBy("recording", "chunk").collect():
        got.setdefault(x["recording"], []).append((x["chunk"], x["start"], x["end"], x["overlap"], x["fits"]))
    want = {}
    for k, _, start, end, overlap, rate in rows:
        pieces = _cut_in_two((start, end, overlap), rate, 3.0, 130.0) if rate else [(start, end, overlap)]
        for a, z, o in pieces:
            want.setdefault(k, []).append((len(want.get(k, [])), a, z, o, (z - a) * (rate or 0) <= 130.0))
    assert got == want and any(not x[4] for each in got.values() for x in each)
    empty = chunks.halved(df.limit(0), 3.0, 130.0)
    assert empty.count() == 0
