"""Whitening, hard negatives and token files against brute force."""

import io
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from hearweave.llm import hard_negatives, token_files, whitening  # noqa: E402
from hearweave.llm.queries import tokenizer  # noqa: E402
from hearweave.llm.warc_zip import Ranges  # noqa: E402

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, x int, k int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "clash", 1, 2) for i, v, g in rows], SCHEMA)


def odd_rows():
    return [(900, None, 1), (901, [1.0, None, 0.0, 2.0], 1), (902, [1.0, NAN, 0.0, 2.0], 1), (903, [INF, 0.0, 0.0, 2.0], 1), (904, [], 1)]


# Whitening


def test_square_sums_are_exact():
    r = np.random.default_rng(3)
    for top in (10, 1 << 20, 1 << 53):
        y = r.integers(-top, top, (7, 5))
        want = [sum((int(a[i]) + int(a[j]) if i != j else int(a[i])) ** 2 for a in y) for i in range(5) for j in range(i, 5)]
        assert whitening.square_sums(y) == want


def test_covariance_by_polarisation():
    r = random.Random(4)
    rows = [[r.randint(99_000, 101_000) for _ in range(4)] for _ in range(23)]
    n, sums = len(rows), [sum(c) for c in zip(*rows)]
    y = np.array([[v - s // n for v, s in zip(row, sums)] for row in rows])
    got = whitening.covariance(n, sums, whitening.square_sums(y))
    for i in range(4):
        for j in range(4):
            assert got[i, j] == float(sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in rows) / n)


def test_whitening(spark):
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 1 + j) + (k % 3) for j in range(4)], 1) for k in range(300)]
    rows += [rows[3], rows[3], (None, rows[4][1], None)]
    got = whitening.whitened(vectors(spark, rows + odd_rows()).repartition(5), components=3).collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows])
    n, sums = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    assert len(got) == 3 * n and {g["n"] for g in got} == {n} and all(g["identity_error"] < 1e-9 for g in got)
    assert [sorted(g["component"] for g in got if g["vec_id"] == 7)] == [[1, 2, 3]]
    for k in (0, 3, 9):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums))
        for g in (g for g in got if g["vec_id"] == k):
            c = -g["component"]
            want = (x[k] - sums / n) @ axes[:, c] / math.sqrt(values[c])
            assert g["deviation"] == deviation and abs(g["whitened"]) == pytest.approx(abs(want), abs=1e-6)
            assert g["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    for c in (1, 2, 3):  # one sign for all rows
        own = {g["vec_id"]: g["whitened"] for g in got if g["component"] == c}
        plain = {k: (x[k] - sums / n) @ axes[:, -c] for k in range(300)}
        assert len({(own[k] > 0) == (plain[k] > 0) for k in plain if abs(plain[k]) > 1}) == 1


def test_whitening_without_spread(spark):
    got = whitening.whitened(vectors(spark, [(k, [float(k), 1.0, 2.0], 0) for k in range(4)] + [(9, [5.0], 0), (10, [1e300, -1e300], 0)])).collect()
    own = {(g["vec_id"], g["component"]): g for g in got}
    assert own[0, 1]["explained"] == 1.0 and own[0, 1]["whitened"] is not None and own[0, 2]["whitened"] is None and own[0, 2]["explained"] == 0.0
    assert own[9, 1]["n"] == 1 and own[9, 1]["whitened"] is None and own[10, 1]["deviation"] == 0
    assert whitening.whitened(vectors(spark, [])).collect() == [] and whitening.whitened(vectors(spark, odd_rows())).collect() == []


def test_deviation_beyond_a_long(spark):
    got = whitening.whitened(vectors(spark, [(0, [0.0], 0), (1, [1e15], 0)]), components=1).collect()
    assert [g["deviation"] for g in got] == [None, None] and [abs(g["whitened"]) for g in got] == pytest.approx([1.0, 1.0])


# Hard negatives


def test_scores_by_tables():
    r = np.random.default_rng(8)
    for d, top in ((1, 3), (8, 256), (13, 1 << 24), (64, 257)):
        x, a = r.integers(-top, top + 1, (50, d)), r.integers(-top, top + 1, d)
        planes = hard_negatives.bit_planes(x, top.bit_length() + 2)
        assert hard_negatives.scores(hard_negatives.subset_tables(a), planes).tolist() == (x @ a).tolist()


def plain_mined(rows, is_anchor, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * c) for c in v], g) for i, v, g in rows if i is not None and g is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i in sorted({i for i, _, _ in rows if is_anchor(i)}):
        _, a, own = min(((0, v, g) for j, v, g in rows if j == i), key=lambda x: (x[2], x[1]))
        scored = sorted((-sum(p * q for p, q in zip(a, v)), j, g) for j, v, g in rows if j != i and len(v) == len(a))
        for s, p, _ in [x for x in scored if x[2] == own][:positives]:
            band = [x for x in scored if x[2] != own and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, k, x[1], -s, -x[0]) for k, x in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize("cut", [(32_768, 4_096, 1_024, 24), (40, 3, 10, 6)])
def test_hard_negatives(spark, monkeypatch, cut):
    for name, v in zip(("SHARD", "BLOCK", "SMALL", "FEWEST"), cut):
        monkeypatch.setattr(hard_negatives, name, v)
    r = random.Random(11)
    rows = [(k, [round(r.gauss(0.3 * (k % 4), 0.5), 1) for _ in range(11)], k % 4) for k in range(260)]
    rows += [(1000 + k, rows[10][1], k % 4) for k in range(60)]  # many ties
    rows += [rows[20], rows[20], rows[21], (None, rows[5][1], 1), (2000, rows[5][1], None), (2010, [0.5, 0.25], 1), (2011, [0.5, 0.5], 1), (2012, [0.25, 0.25], 2)]
    got = hard_negatives.mined(vectors(spark, rows + odd_rows()), F.col("id") % 10 == 0)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(g[n] for n in names) for g in got.collect()) == plain_mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_edges(spark):
    is_anchor = F.col("id") % 10 == 0
    assert hard_negatives.mined(vectors(spark, []), is_anchor).collect() == []
    assert hard_negatives.mined(vectors(spark, odd_rows()), is_anchor).collect() == []
    assert hard_negatives.mined(vectors(spark, [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)]), is_anchor).count() == 1
    moved = hard_negatives.mined(vectors(spark, [(0, [1.0], 1), (1, [1.0], 2), (2, [0.5], 3)]), is_anchor, relabel=F.when(F.col("id") == 0, 2).otherwise(F.col("label")))
    assert [(g["positive_id"], g["negative_id"], g["positive_score"], g["negative_score"]) for g in moved.collect()] == [(1, 2, 65536, 32768)]


# Token files


def file_of(lists):
    out = io.BytesIO()
    writer = token_files.Writer(out)
    for k, ids in lists:
        writer.add(k, np.array(ids, np.uint64))
    writer.close()
    return token_files.Reader(Ranges(pa.PythonFile(io.BytesIO(out.getvalue()), "r"))), out.getvalue()


def test_words_round_trip():
    r = random.Random(2)
    for _ in range(60):
        n, top = r.choice([0, 1, 5, 300, 4095, 4096, 4097, 9000]), r.choice([1, 2, 9, 60_000, 1 << 30, 1 << 60, 1 << 64])
        ids = np.array([r.randrange(top) if r.random() < 0.8 else 0 for _ in range(n)], np.uint64)
        words, first, escapes = token_files.encode(ids)
        assert len(first) == -(-n // token_files.BLOCK) + 1 and (top < 1 << 60 or (escapes >= 1 << 60).all())
        back = [token_files.decode(words[int(a) : int(b)], escapes)[0] for a, b in zip(first, first[1:])]
        back = [x[: token_files.BLOCK] for x in back]
        assert (np.concatenate([*back, np.zeros(0, np.uint64)])[:n] == ids).all()
    assert len(token_files.encode(np.zeros(4096, np.uint64))[0]) == 18 and len(token_files.encode(np.full(4096, 3, np.uint64))[0]) == 137


def test_file_reads_any_document():
    r = random.Random(6)
    lists = [(k if k % 5 else None, [r.randrange(r.choice([2, 70_000, 1 << 63])) for _ in range(r.choice([0, 1, 40, 5000]))]) for k in range(40)]
    reader, data = file_of(lists)
    assert reader.keys == [k for k, _ in lists] and reader.ids == sum(len(x) for _, x in lists)
    for k, (_, ids) in enumerate(lists):
        assert reader.document(k).tolist() == ids
    joined: dict[int, list] = {}
    ended = []
    for k, ends, ids in reader.pieces():
        joined.setdefault(k, []).extend(ids.tolist())
        ended += [k] if ends else []
    assert [joined.get(k, []) for k in range(40)] == [x for _, x in lists] and all(k in ended for k in joined)
    with pytest.raises(ValueError):
        token_files.Reader(Ranges(pa.PythonFile(io.BytesIO(b"x" * 100), "r")))
    empty, _ = file_of([])
    assert empty.ids == 0 and list(empty.pieces()) == []


def library():
    t = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


ODD = ["a", "Zß", "straße", "naïve,", "don't", "it's.", "'s", "x'll", "12", "a1", "\n", "\t", " ", " ", "\x1c", "\x85", "...", "<|endoftext|>", "<|", "endoftext|>", "中文", "🙂", "é", "", "ǅ", "×", "ɐ", "\\", "a\nb", "\r\n", "_x", "ﬁ", "​"]


def test_ids_are_the_librarys():
    r = random.Random(12)
    want, ids = library(), token_files.Ids(tokenizer("byte_bpe_50k.json"), bound=300)
    texts = [None, "", " ", "  ", " a", "a ", "a  b", "\n a"] + ["".join(r.choice(ODD) + r.choice(["", " ", " ", "  " if r.random() < 0.05 else " "]) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert [x.tolist() for x in ids(pa.array(part, pa.string()))] == [want(x) for x in part]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 2)
    r = random.Random(13)
    rows = [(k, " ".join(r.choice(ODD) for _ in range(r.randint(0, 60)))) for k in r.sample(range(-50, 5000), 120)]
    rows += [rows[0], rows[0], (rows[1][0], "other"), (None, "none"), (None, None), (7000, None), (7001, ""), (7002, "word " * 20_000)]
    docs = spark.createDataFrame([(k, x, "c", 1) for k, x in rows], "doc_id long, text string, key string, h int").repartition(3)
    got = sorted(token_files.archived(docs, tokenizer("byte_bpe_50k.json")).collect(), key=lambda g: g["start"])
    want = library()
    assert len(got) == len(rows) and [g["start"] for g in got] == np.cumsum([0, *(g["n_tokens"] for g in got)])[:-1].tolist()
    keys = [g["doc_id"] for g in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    plain = [(k, len(want(x)) + 1, zlib.crc32(np.array([*want(x), 0], "<u4").tobytes())) for k, x in rows]
    order = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    assert sorted(((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got), key=order) == sorted(plain, key=order)
    assert token_files.archived(docs.where("false"), tokenizer("byte_bpe_50k.json")).collect() == []


def test_plain_parts_skip_the_whole_encoder(monkeypatch):
    # parts of letters, marks and single line ends go to the model together, whatever surrounds them
    r = random.Random(14)
    want, ids = library(), token_files.Ids(tokenizer("byte_bpe_50k.json"))
    some = ["a", "don", "it", "straße", "Ñué", "ɏ", "A", "the"]
    marks = ["", "", ".", "'", "...", "'.", "<|", "|>", "$$", "\\"]
    parts = list({"\n".join(r.choice(some) + r.choice(some) + r.choice(marks) for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(2000)})
    seen = []

    class Counted:
        def __init__(self, library):
            self.library, self.model = library, library.model

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(ids, "library", Counted(ids.library))
    assert [x.tolist() for x in ids(pa.array([" ".join(["a", *parts]), *(f"a {x}" for x in parts)]))] == [want(" ".join(["a", *parts])), *(want(f"a {x}") for x in parts)]
    assert set(seen) == {"a"} and ids.apart
    # without that rule for its tokens all parts go to the whole encoder
    ids.parts.clear()
    ids.apart = False
    assert ids(pa.array(["a " + " ".join(parts)]))[0].tolist() == want("a " + " ".join(parts)) and len(set(seen)) == len(parts) + 1
