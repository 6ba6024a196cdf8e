"""Each operator against a plain definition, on small tables with nulls, empty and long texts, ties,
repeated rows and clashing columns."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import weakref
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from hearweave.llm import bpe_codec, common, decontaminate, jaccard_join, nearest, ordinal_quality, secret_scan, token_counts, toxicity, url_filter, warc_zip  # noqa: E402
from hearweave.llm.queries import RULES, pattern, tokenizer  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, texts, extra=True):
    rows = [(k, x, "e", "s", len(x or ""), 1, "c") for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, score string")


def texts(seed=0, n=60):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))) for _ in range(n)]
    for k in range(12):  # near copies
        w = out[k].split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, out[0], out[0], None, "", "  \n ", "word " * 3000, "é漢字 ß", "one two"]


def test_bpe_matches_library(spark):
    ranks = bpe_codec.read_ranks(tokenizer("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = bpe_codec.BpeCodec(ranks, pattern())
    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice(r.choice(["ab ", "aeiou", "  \n\t\xa0x", "éüñ漢字", "0123", "=-.!'", "the ", "eeee"])) for _ in range(r.randint(0, 60)))
        assert codec.encode_text(s) == known.encode_ordinary(s)
        assert codec.decode(codec.encode_text(s)) == s.encode()
    for s in ("a" * 5000, "ab" * 3000, "=-" * 2000, " " * 999):
        assert codec.encode_text(s) == known.encode_ordinary(s)
    rows = {x["doc_id"]: x for x in bpe_codec.digests(docs(spark, texts()), tokenizer("byte_bpe_50k.tiktoken"), pattern()).collect()}
    for k, x in enumerate(texts()):
        ids = known.encode_ordinary(x or "")
        assert rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()


def test_bpe_in_slices():
    # many texts at once, with tables that are dropped again and again
    ranks = bpe_codec.read_ranks(tokenizer("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = bpe_codec.BpeCodec(ranks, pattern(), bound=300)
    r = random.Random(3)
    odd = ["a", "it's", "'s", "x'll", "12", "a1", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "...", "<|endoftext|>", "漢字", "🙂", "é", "", "a\nb", "\na", "a\n", "Wort.\nNext", "\r\n", "_x", "\u200b", "\0"]
    many = [None, "", " ", "  ", " a", "a ", "a  b", "\n a"] + ["".join(r.choice(odd) + r.choice(["", " ", " ", " "]) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    for a in range(0, len(many), 150):
        part = many[a : a + 150]
        ids, ends = codec.encode_texts(pa.array(part, pa.string()))
        assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:])] == [known.encode_ordinary(x or "") for x in part]
    assert codec.encode_texts(pa.array([], pa.string()))[1].tolist() == [0]


def test_codec_leaves_a_worker_that_other_operators_use(monkeypatch):
    """As in a pipeline, where the encoder's tables stood in each worker while later tasks needed the memory."""
    batch = pa.RecordBatch.from_arrays([pa.array(["alpha beta", None])], names=["text"])
    ask = lambda: bpe_codec.codec_of(tokenizer("byte_bpe_50k.tiktoken"), pattern())
    kept = lambda: bpe_codec.codec_of.cache_info().currsize
    ask().encode_texts(batch.column("text"))
    gone = weakref.ref(ask())
    assert [x.num_rows for x in common.slices([batch], "text", keeps=bpe_codec.codec_of)] == [2] and kept() == 1
    list(common.slices([batch], "text"))  # used just now: a plan may have tasks of both
    assert kept() == 1 and gone() is ask()
    monkeypatch.setattr(common, "IDLE_S", 0)
    list(common.slices([batch], "text", keeps=bpe_codec.codec_of))  # a task of its own operator
    assert kept() == 1 and gone() is ask()
    list(common.slices([batch], "text"))
    assert kept() == 0 and gone() is None
    assert ask().encode_text("alpha beta")


def test_bpe_encodes_a_word_once(monkeypatch):
    # whatever marks and lines stand beside it
    codec = bpe_codec.BpeCodec(bpe_codec.read_ranks(tokenizer("byte_bpe_50k.tiktoken")), pattern())
    encoded, encode = [], codec.encode
    monkeypatch.setattr(codec, "encode", lambda data: encoded.append(data) or encode(data))
    codec.encode_text("x " + " ".join(f"{w}{m}" for w in ("ernhat", "ouandi", "thesti") for m in ("", ".", ",", "!?", "...", ".\nNext", "\nLast")))
    assert len(encoded) == len(set(encoded))
    # long texts are not kept beyond the bound of bytes
    monkeypatch.setattr(common, "KNOWN_BYTES", 1000)
    for k in range(5):
        codec.encode_text("a " + f"{k}ab" * 1000)
    assert len(codec.rest.names) == 1


def test_bpe_join_is_associative():
    codec = bpe_codec.BpeCodec(bpe_codec.read_ranks(tokenizer("byte_bpe_50k.tiktoken")), pattern())
    r = random.Random(2)
    for _ in range(300):
        a, b, c = (bytes(r.choice(b"abcdefth") for _ in range(r.randint(1, 9))) for _ in range(3))
        x, y, z = map(codec.merged, (a, b, c))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.merged(a + b + c)


def test_empty_tables(spark):
    empty = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert bpe_codec.digests(empty, tokenizer("byte_bpe_50k.tiktoken"), pattern()).count() == 0
    assert decontaminate.judged(docs(spark, ["a b"]), bench).first()["n_hit"] == 0
    assert decontaminate.judged(empty, bench).count() == 0
    assert secret_scan.reported(empty).count() == 0
    assert jaccard_join.near_components(empty).count() == 0
    assert token_counts.count_tokens(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.judged(docs(spark, ["a", None]), labels).count() == 2
    assert ordinal_quality.judged(docs(spark, ["a", None]), labels).count() == 2
    assert warc_zip.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, vectors).count() == 0


def test_warc_round_trip(spark):
    same = "<p>" + "x" * 200
    rows = [(5, "http://a", same), (3, "http://b\r\nX: y", same), (9, None, same), (1, "http://c", None), (2, "u", ""), (4, "v", "short"), (6, "w", "short"), (7, "z", "é" * 60), (None, "n", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in warc_zip.archived(pages).collect()}
    assert len(found) == len(rows)
    assert found[3]["record_type"] == "response" and found[5]["refers_to"] == 3 and found[9]["refers_to"] == 3 and found[None]["refers_to"] == 3
    for page_id, _, html in rows:
        body = (html or "").encode()
        assert found[page_id]["payload_bytes"] == len(body)
        assert found[page_id]["payload_digest"] == hashlib.sha256(body).hexdigest()
    assert found[4]["record_type"] == found[6]["record_type"] == "response"


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64, tmp_path):
    data = warc_zip.package([b"one", b"three"], ["1", "2"], zip64)
    if zip64:  # an end record as large archives have it
        end = data.rfind(warc_zip.END)
        size, start = (int.from_bytes(data[end + k : end + k + 4], "little") for k in (12, 16))
        big = warc_zip.END64 + (44).to_bytes(8, "little") + bytes(12) + (2).to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + start.to_bytes(8, "little")
        locator = warc_zip.LOCATOR64 + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
        data = data[:end] + big + locator + warc_zip.END + bytes(4) + b"\xff" * 12 + bytes(2)
    path = tmp_path / "x.wacz"
    path.write_bytes(data)
    with pa.OSFile(str(path)) as f:
        reader = warc_zip.Ranges(f)
        members = warc_zip.members(reader)
        assert reader.at(*members[warc_zip.ARCHIVE]) == b"onethree"
        assert reader.at(*members[warc_zip.INDEX]) == b"1 0 3\n2 3 5\n"
    if not zip64:
        assert zipfile.ZipFile(io.BytesIO(data)).read(warc_zip.ARCHIVE) == b"onethree"


def _contamination(text, items):
    w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hit, ids = set(), set()
    for item, x in items:
        v = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (x or "").encode()))
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit.update(range(j, j + n))
                    ids.add(item)
    return len(w), len(hit), sorted(map(str, ids))


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    r = random.Random(3)
    passage = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (20, 13, 5, 1, 40)]
    items = [*enumerate(passage, 7), (20, None), (21, ""), (22, passage[0]), (3, "ß É")]
    own = [x if x is None or k % 3 else f"{x} {passage[k % 5].upper()}, {passage[(k + 1) % 5]}" for k, x in enumerate(texts())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs(spark, own).withColumnRenamed("score", "hit_spans"), bench, block_bytes=block).collect()
    for row in found:
        n, hit, ids = _contamination(own[row["doc_id"]], items)
        assert (row["n_words"], sum(s["end"] - s["start"] for s in row["hit_spans"]), row["hit_items"]) == (n, hit, ids)
    clean = {x["doc_id"] for x in decontaminate.clean(docs(spark, own), bench).collect()}
    assert clean == {k for k, x in enumerate(own) if not (lambda n, h, _: h and 20 * h >= n)(*_contamination(x, items))}


def _longest(w, v):
    """The longest common run of words of two texts: (length, first start in v, in w)."""
    best = (0, 0, 0)
    for i in range(len(v)):
        for j in range(len(w)):
            n = 0
            while i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_longest_matches(spark, block):
    r = random.Random(13)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(n))) for k, n in enumerate((40, 30, 13, 5, 1, 0))]
    cut = lambda k, a, b: " ".join(items[k][1].split()[a:b])
    own = [f"one {cut(0, 3, 33)} two {cut(0, 10, 30)}", f"{cut(1, 0, 14)} x {cut(1, 12, 30)}", cut(2, 0, 13), cut(3, 0, 4), cut(3, 0, 5), None, "", "word " * 500, cut(0, 3, 33)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda x: [w.decode() for w in decontaminate.words_of((x or "").encode())]
    for row in decontaminate.find_contamination(docs(spark, own), bench, block_bytes=block).collect():
        w = split(own[row["doc_id"]])
        for m in row["longest_matches"]:
            v = split(items[int(m["item"])][1])
            assert m["length"] == _longest(w, v)[0]
            assert w[m["start"] : m["start"] + m["length"]] == v[m["item_start"] : m["item_start"] + m["length"]]
    for row in decontaminate.longest_matches(docs(spark, own), bench, block_bytes=block).collect():
        v = split(items[int(row["item"])][1])
        assert row["length"] == max(_longest(split(x), v)[0] for x in own)
        if row["length"]:
            w = split(own[row["doc_id"]])
            assert w[row["start"] : row["start"] + row["length"]] == v[row["item_start"] : row["item_start"] + row["length"]]


def test_clean_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, "s", 0.5), (2, None, 6, "t", None)], "doc_id long, text string, n_words int, found string, toxicity double")
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for kept in (decontaminate.clean(d, bench), toxicity.clean(d, labels)):
        assert kept.columns == d.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, d.collect()))


def test_longest_match():
    test = decontaminate.TestSet([(1, b"a b c d e f")])
    shard = decontaminate.Shard([b"x a b c d y".split(), b"c d e".split()], test)
    assert shard.longest().tolist() == [4]


BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def test_secrets():
    r = random.Random(4)
    bits = ["Password: abc", "token = 'abcdef12'", "api_key:xyzxyzxyz", "AKIA" + "A1" * 8, "AKIAX", "0af" * 8, "0af" * 9, "é", " ", "secret=\"", "passwd:1.2/3=4", "\n", "x"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))
        base, found = secret_scan.find_secrets(text)
        assert base == want and set(want) <= set(found)


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: "".join(f"%{c:02x}" for c in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    ],
)
def test_wrapped_secrets(wrap):
    inner = wrap("the password=hunter2222 here")
    text = f"see é {inner} end"
    base, found = secret_scan.find_secrets(text)
    assert not base and len(found) == 1 and found[0][1] == 0
    assert text.index(inner) <= found[0][0] < found[0][2] <= text.index(inner) + len(inner)
    assert "hunter" not in str(secret_scan.find_secrets(secret_scan.mask_spans(text, found, "[SECRET]")))


@pytest.mark.parametrize("squeeze", [bytes, gzip.compress])
def test_equal_encoded_secrets(squeeze):
    blob = base64.b64encode(squeeze(b"the password=hunter2222 here")).decode()
    twice = base64.b64encode(f"{blob} {blob}".encode()).decode()
    text = f"one {blob} two\n{blob} three {twice} {blob}"
    _, found = secret_scan.find_secrets(text)
    places = [m.start() for m in re.finditer(re.escape(blob), text)]
    assert len(places) == 3 and all(any(p <= a < b <= p + len(blob) for a, _, b in found) for p in places)
    assert sum(text.index(twice) <= a < b <= text.index(twice) + len(twice) for a, _, b in found) == 2
    masked = secret_scan.mask_spans(text, found, "[SECRET]")
    assert not secret_scan.find_secrets(masked)[1]


@pytest.mark.parametrize("beside", ["\xa0", "\u3000", "\u202f", "\xad", "\u200b", "\u200d", "\ufeff", "\0", "\x1b"])
@pytest.mark.parametrize("squeeze", [bytes, gzip.compress, zstandard.compress])
def test_secrets_beside_unprintable(beside, squeeze):
    blob = base64.b64encode(squeeze(f"{beside}the password=hunter2222 here".encode())).decode()
    assert [k for _, k, _ in secret_scan.find_secrets(f"see {blob} end")[1]] == [0]


@pytest.mark.parametrize("squeeze", [gzip.compress, zstandard.compress])
def test_secrets_in_later_members(squeeze):
    data = squeeze(b"nothing") + squeeze(b" here, ") + squeeze(b"token=abcdef12")
    for tail in (b"", b"garbage"):
        assert [k for _, k, _ in secret_scan.find_secrets(base64.b64encode(data + tail).decode())[1]] == [0]


@pytest.mark.parametrize("squeeze", [gzip.compress, zlib.compress, zstandard.compress])
def test_secrets_far_inside(squeeze):
    blob = base64.b64encode(squeeze(b"some words, " * (6 << 20) + b"AKIA" + b"A1" * 8)).decode()
    text = f"a {blob} b"
    assert secret_scan.find_secrets(text)[1] == [(2, 1, 2 + len(blob))]


@pytest.mark.parametrize("before", ["https://h/cb/", "key_", "id-", "word/", "x", "ab", "abc", "path/to/"])
@pytest.mark.parametrize("squeeze", [bytes, gzip.compress, zlib.compress, zstandard.compress, base64.b64encode])
def test_glued_secrets(before, squeeze):
    for after in ("", "/tail", "_x"):
        blob = base64.urlsafe_b64encode(squeeze(b"the password=hunter2222 here")).decode().rstrip("=")
        text = f"see {before}{blob}{after} end"
        _, found = secret_scan.find_secrets(text)
        assert [k for _, k, _ in found] == [0] and text.index(blob) <= found[0][0] < found[0][2] <= text.index(blob) + len(blob)
        assert not secret_scan.find_secrets(secret_scan.mask_spans(text, found, "[SECRET]"))[1]


@pytest.mark.parametrize("squeeze", [bytes, gzip.compress, zlib.compress, zstandard.compress])
@pytest.mark.parametrize(("width", "part"), [(64, "\n"), (76, "\r\n"), (76, "\n  "), (10, "\n")])
def test_wrapped_lines(squeeze, width, part):
    r = random.Random(12)
    words = " ".join(r.choice(WORDS) for _ in range(40))
    for n in range(60):
        blob = base64.b64encode(squeeze(f"{words} {'x' * n} AKIA{'B2' * 8} {words}".encode())).decode()
        lines = part.join(blob[k : k + width] for k in range(0, len(blob), width))
        for text in (lines, f"cert\n{lines}\nend", f"cert: {lines} end"):
            _, found = secret_scan.find_secrets(text)
            at = text.index(lines)
            assert [k for _, k, _ in found] == [1] and at <= found[0][0] < found[0][2] <= at + len(lines)


def test_pieces(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 40)
    r = random.Random(11)
    bits = ["password: abcdef", "token = token = abcdef", "AKIA" + "A1" * 8, "0af" * 9, " ", ",", "\n", "\n\n", "é", "word", "%41", base64.b64encode(b"secret=abcdef").decode()]
    for _ in range(500):
        text = "".join(r.choice(bits) for _ in range(60))
        pieces = list(secret_scan._pieces(iter([text[k : k + 7] for k in range(0, len(text), 7)])))
        assert "".join(pieces) == text
        count = lambda x: len(secret_scan.scan(x))
        assert sum(map(count, pieces)) == count(text)


def test_escapes_with_other_bytes():
    text = "x %FF%70assword=hunter22 é"
    assert secret_scan.find_secrets(text)[1] == [(text.index("%70"), 0, text.index(" é"))]
    inner = base64.b64encode("é %74oken=abcdef12 ü".encode()).decode()
    nested = "".join(f"\\u{ord(c):04x}" for c in inner)
    spans = secret_scan.find_secrets(f"a {nested} b")[1]
    assert len(spans) == 1 and 2 <= spans[0][0] < spans[0][2] <= 2 + len(nested)
    again = text
    for _ in range(6):  # layers within layers end
        again = base64.b64encode(again.encode()).decode()
    assert [k for _, k, _ in secret_scan.find_secrets(f"deep {again}")[1]] == [0]


def test_secret_documents(spark):
    own = [None, "", "token=abcdef", "clean words", "%41" * 5, "x" * 100_000]
    rows = {r["doc_id"]: r for r in secret_scan.reported(docs(spark, own)).collect()}
    assert rows[2]["spans"] == "assign:0:12" and rows[2]["n_assign"] == 1 and rows[0]["spans"] == "" and rows[5]["spans"] == ""
    kept = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs(spark, own)).collect()}
    assert kept[2] == "[SECRET]" and kept[3] == "clean words" and kept[0] is None


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q", "http://com/en/1", "https://xcom/en/1", "x://www.net/de/9", "x://a.example.net/de/8#f", None, "no scheme", "x://org", "x://b.org/es/?", "x://b.org/es/?"]
    pages = spark.createDataFrame([(k, u, "v", "r") for k, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert found[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert found[1] == ("com", "/en/1", "com/en/", "block") and found[2][2:] == (None, "allow")
    assert found[3][2:] == ("net/de/", "allow") and found[4][2:] == ("example.net/de/8", "block")
    assert found[5] == found[6] == ("", "", None, "allow") and found[7] == ("org", "", None, "allow")
    assert found[8][2:] == found[9][2:] == ("org/es/", "block")
    many = spark.range(2000).selectExpr("'block' verdict", "concat('h', id, '.x') host", "'/' path")
    hit = spark.range(0, 4000, 7).selectExpr("id page_id", "concat('t://s.h', id, '.x/q') url")
    assert url_filter.judge_urls(hit, many).where("verdict = 'block'").count() == len(range(0, 2000, 7))


def test_clashing_columns(spark):
    """Columns named as what operators use inside stay as they are, or are left out."""
    names = "__url _best _host shard block d x id _sha several first prefix bits tok grp cell0 failed numbers values part found before toxicity _key stays".split()
    extra = [F.lit(k).alias(n) for k, n in enumerate(names)]
    d = docs(spark, texts()[:20]).select("*", *extra)
    for made in (token_counts.count_tokens(d, tokenizer("byte_bpe_50k.json")), secret_scan.scan_documents(d), bpe_codec.round_trip(d, tokenizer("byte_bpe_50k.tiktoken"), pattern()), jaccard_join.one_of_each(d)):
        rows = made.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(names)))]
    grades = spark.createDataFrame([(k, k % 3) for k in range(20)], "doc_id long, grade int")
    assert ordinal_quality.grade_documents(d, ordinal_quality.fit(d, grades)).select(*names).distinct().count() == 1
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("t://a.com/en/x").alias("url"), F.col("text").alias("html"), *names)
    judged = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    assert judged.where("verdict = 'block' and __url = 0 and _best = 1").count() == 20
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "verdict string, host string, path string")).count() == 0
    assert warc_zip.archived(pages).count() == 20
    vectors = spark.range(30).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), *(e for n, e in zip(names, extra)))
    assert nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=3).count() == 6
    assert jaccard_join.near_components(d).count() == 20


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 24))
    x[7] = x[8]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (5020, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    right = 0
    for q in range(0, 1200, 20):
        own = sorted(got[q])
        assert [a for a, _, _ in own] == list(range(1, 21)) and all(abs(scores[q, v] - s) < 1e-9 for _, v, s in own)
        assert own == sorted(own, key=lambda t: (-t[2], t[1]))
        right += len({v for _, v, _ in own} & set(np.argsort(-scores[q])[:20].tolist()))
    assert right / (60 * 20) >= 0.9 and set(got) == set(range(0, 1200, 20))


def test_nearest_of_other_lengths(spark):
    rows = [(k, [float(k + 1), 1.0]) for k in range(5)] + [(20, [2.0]), (40, [1.0, 2.0, 3.0]), (41, [0.5, 0.5, 0.5]), (60, [3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect()]
    data = dict(rows)
    want = []
    for q in (0, 20, 40, 60):
        same = [(-sum(a * b for a, b in zip(data[q], v)), k) for k, v in data.items() if k != q and len(v) == len(data[q])]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(sorted(same), 1)]
    assert sorted(found) == sorted(want)


def _brute(own, words, num):
    sets = []
    for x in own:
        w = (x or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    up = list(range(len(own)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in range(len(own))}


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, words, num, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "ASK", 2)
    monkeypatch.setattr(jaccard_join, "ANSWER", 4)
    own = texts(6)
    r = random.Random(7)
    for _ in range(25):  # a chain of near copies
        w = own[-1].split() if len(own[-1].split()) > 20 else " ".join(r.choice(WORDS) for _ in range(50)).split()
        w[r.randrange(len(w))] = r.choice(WORDS)
        own.append(" ".join(w))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(docs(spark, own), words=words, num=num).collect()}
    want = _brute(own, words, num)
    assert found == want
    kept = sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs(spark, own), words=words, num=num).collect())
    assert kept == sorted(k for k, (n, c) in want.items() if not n or c == k)


def test_jaccard_repeated_rows(spark):
    d = docs(spark, ["a b c d e f g h", "x y z", None]).unionByName(docs(spark, ["a b c d e f g h"]))
    assert sorted(str(r["doc_id"]) for r in jaccard_join.one_of_each(d).collect()) == ["0", "1", "2"]


def test_jaccard_shared_and_null_ids(spark):
    a, b, c, e, f, g, h = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcefgh")
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c + " more"), (None, None), (2, a + " x"), (2, e), (3, f), (3, g), (4, g), (3, f), (5, h), (5, h + " y"), (5, ""), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in jaccard_join.one_of_each(d).collect()]
    sure = [(1, a), (None, b), (None, None), (2, e), (3, f), (3, g), (5, ""), (5, None)]
    either = [[(None, c), (None, c + " more")], [(5, h), (5, h + " y")]]
    assert all(left.count(x) == 1 for x in sure) and all(sum(map(left.count, x)) == 1 for x in either)
    assert len(left) == len(sure) + len(either)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    own = [*texts(), "a<|endoftext|>b <|endoftext|> c", "tab\t here \n  and  there", "nul\0 x"]
    for r in token_counts.count_tokens(docs(spark, own), tokenizer("byte_bpe_50k.json")).collect():
        x = own[r["doc_id"]] or ""
        assert r["n_tokens"] == len(known.encode(x, add_special_tokens=False).ids) and r["n_bytes"] == len(x.encode())


def test_toxicity(spark):
    r = random.Random(8)
    own, marks = [], []
    for k in range(600):
        w = [r.choice(WORDS) for _ in range(40)]
        toxic = k % 8 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(["grubmuk", "grubmoll", "zonkhead"])
        own.append(" ".join(w))
        marks.append((k, 1, int(toxic)))
    own += [None, ""]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = toxicity.judged(docs(spark, own), labels).collect()
    held = [x for x in rows if x["held_out"] and x["doc_id"] < 600]
    assert len(held) > 150 and all(x["predicted"] == (x["doc_id"] % 8 == 0) for x in held)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) and 0 <= x["score"] <= 1 for x in rows)
    assert toxicity.clean(docs(spark, own), labels).columns == docs(spark, own).columns


def test_toxicity_contexts():
    g = toxicity.Grammar({"": 2.2, "oaf$": 4.0}, {c: -3.0 if c & 3 else 0.0 for c in range(8)}, 0.05)
    assert g.score("you oaf") > 0.9 > g.score("he is not an oaf") and g.score("they said oaf") < 0.9
    assert g.score("I will kill you") > 0.8 > g.score("I will kill time") and g.score(None) == pytest.approx(0.05)


def _plain_matches(g, words):
    """The grammar's matches by plain rules: (context, evidence without its weight)."""
    out, quoted, clause = [], False, []
    for w in [*words, "."]:
        if toxicity._FIXED.get(w) != toxicity.END:
            clause.append((w, *g.classes[w]))
            continue
        kinds = [k for _, k, _ in clause]
        target, meant, own = (k in kinds for k in (toxicity.TARGET, toxicity.INTENT, toxicity.SELF))
        told = False
        for n, (_, kind, evidence) in enumerate(clause):
            quoted ^= kind == toxicity.QUOTE
            told = told or kind == toxicity.REPORT
            before = kinds[max(0, n - toxicity.REACH) : n]
            if toxicity.PAUSE in before:
                before = before[len(before) - before[::-1].index(toxicity.PAUSE) :]
            marks = (1 if toxicity.NEGATION in before else 0) | (2 if told or quoted else 0) | (4 if target else 0)
            if kind == toxicity.INSULT:
                out.append((marks, evidence))
            elif (kind == toxicity.THREAT and target and (meant or own)) or (kind == toxicity.HARM and target and meant):
                out.append((marks | 8, evidence))
        clause = []
    return out


def test_toxicity_composition():
    r = random.Random(14)
    g = toxicity.Grammar({"": 2.2, "oaf$": 4.0, "grub": 3.0, "!zap$": 2.0}, {c: -c / 10 for c in range(16)}, 0.05)
    bits = ["oaf", "grubby", "zap", "kill", "beat", "you", "ich", "i", "will", "not", "nie", "said", '"', ",", ".", "word", "time", "!"]
    for _ in range(3000):
        words = [r.choice(bits) for _ in range(r.randint(0, 25))]
        got, want = g.matches(words), _plain_matches(g, words)
        assert [c for _, c in got] == [c for c, _ in want] and [v + c / 10 for v, c in got] == pytest.approx([v for _, v in want])


def test_toxicity_threats():
    g = toxicity.Grammar({}, {}, 0.05)
    for s in ("I will murder you.", "We will beat you up", "You will be stabbed!", "Ich töte dich", "Je vais te tuer", "Voy a matarte, te digo"):
        assert g.score(s) > 0.7
    for s in ("I will not murder you", "We will never beat you up", "She said he will kill you", "Er sagte, ich töte dich", "I will kill time", "I beat you at chess"):
        assert g.score(s) < 0.7


def test_toxicity_learns_threats(spark):
    own, marks = [], []
    for k in range(900):
        own.append(f"so they say {WORDS[k % 19]} {WORDS[k % 17]} {k}. " + (f"i will flurb you {k % 7}" if k % 9 == 0 else f"we flurb on {WORDS[k % 13]}" if k % 5 == 0 else "nothing"))
        marks.append((k, 1, int(k % 9 == 0)))
    g = toxicity.fit(docs(spark, own), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert "!flurb$" in g.lexicon and "flurb$" not in g.lexicon
    assert g.score("tomorrow i will flurb you") > 0.7 > g.score("we flurb you gently") and g.score("i will not flurb you") < 0.7


def test_quality(spark):
    r = random.Random(9)
    own, grades = [], []
    for k in range(450):
        g = k % 3
        own.append(" ".join(r.choice(WORDS[:6] if r.random() < (0.9, 0.5, 0.1)[g] else WORDS[10:]) for _ in range(50)))
        grades.append((k, g))
    model = ordinal_quality.fit(docs(spark, own), spark.createDataFrame(grades, "doc_id long, grade int"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    rows = ordinal_quality.grade_documents(docs(spark, own).where(ordinal_quality.held_out()), model).collect()
    assert sum(round(x["expected_grade"]) == x["doc_id"] % 3 for x in rows) / len(rows) > 0.8
    assert all(0 <= x["tail_probability"] <= 1 for x in rows)


def test_toxicity_contexts_outweigh_evidence():
    for seen in (5, 20, 100, 1000, 10**6):
        g = toxicity.Grammar({"": 2.2, "trash$": math.log(2 * seen + 1), "!flurb$": math.log(2 * seen + 1)}, {}, 0.02)
        assert g.score("you are trash") > 0.7 and g.score("i will flurb you") > 0.7
        for s in ("you are not trash", "he said trash", 'they wrote "trash" and "trash"', "i will not flurb you", "not trash, never trash, no trash at all"):
            assert g.score(s) < 0.7


def test_toxicity_needs_an_object():
    g = toxicity.Grammar({}, {}, 0.05)
    harmless = (
        "You should destroy the old backups before you leave.", "My van burned while you slept", "you will smash the record", "shall we beat the eggs until you like them",
        "I can't kill you", "I didn't kill you", "I cannot kill you", "You shouldn't kill yourself", "Morocco is a country in Africa", "tras la puerta", "a clever disguise",
        "the clowns came to town", "die Sonne scheint", "She said you should go die", "I will never hurt you",
    )
    for s in harmless:
        assert g.score(s) < 0.7, s
    for s in ("kill yourself", "Go die", "I hope you die", "I will unalive you", "we are going to destroy you", "you will be murdered", "Ich werde dich töten", "van a matarte, a ti"):
        assert g.score(s) > 0.7, s


def test_toxicity_learns_whole_words(spark):
    own = [f"{WORDS[k % 19]} {WORDS[k % 17]} {k} " + ("morons all" if k % 4 == 0 else "morocco now" if k % 4 == 1 else "fine") for k in range(400)]
    g = toxicity.fit(docs(spark, own), spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int"))
    assert {"morons$", "all$"} <= set(g.lexicon) and all(e == "" or e.endswith("$") for e in g.lexicon)
    assert g.score("morons") > 0.7 > g.score("morocco")


def test_toxicity_fit_against_counts(spark):
    """The lexicon by plain counting: texts with the same least hashed three words count once for a word."""
    r = random.Random(17)
    own = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 30))) + (f" {r.choice(['glub', 'snark', 'prat'])}" if r.random() < 0.4 else "") for _ in range(900)]
    own += [own[4]] * 40 + ["word glub " * 3000]
    y = {k: int(any(w in x for w in ("glub", "snark")) and r.random() < 0.97) for k, x in enumerate(own)}
    g = toxicity.fit(docs(spark, own), spark.createDataFrame([(k, 1, v) for k, v in y.items()], "doc_id long, quality int, toxic int"))
    seen: dict[tuple, int] = {}
    for k, x in enumerate(own):
        if zlib.crc32(str(k).encode()) % 3 == 1:
            continue
        words = toxicity.tokens(x)
        sign = min((xxhash.xxh64_intdigest(" ".join(words[j : j + 3])) for j in range(max(1, len(words) - 2))), default=0)
        for w in {*words, ""}:
            if w not in toxicity._FIXED:
                seen[w, sign] = max(seen.get((w, sign), 0), y[k])
    counts: dict[str, list[int]] = {}
    for (w, _), v in seen.items():
        counts.setdefault(w, []).append(v)
    base = sum(counts[""]) / len(counts[""])
    tried = sum(len(v) > 1 or w == "" for w, v in counts.items())
    least = math.ceil(math.log(max(tried, 2) / toxicity.CHANCE) / -math.log(base))
    want = {w + "$" for w, v in counts.items() if w and sum(v) >= least and sum(v) >= toxicity.PRECISION * len(v)}
    assert want and want == {e for e in g.lexicon if e}
