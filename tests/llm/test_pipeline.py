"""The corpus pipeline on a small corpus, stage by stage against plain rules."""

import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from hearweave.llm import bpe_codec  # noqa: E402
from hearweave.llm.queries import pattern, tokenizer  # noqa: E402

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in "ran tel vis mok sun dap fex".split()]


def corpus():
    r = random.Random(21)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage = say(30)
    texts = [say(80) for _ in range(40)]
    toxic = [f"{say(20)} you {r.choice(['grubmuk', 'zonkhead'])} {say(20)}" for _ in range(300)]
    near = texts[0].split()
    near[5] = "changed"
    special = [texts[0], " ".join(near), f"{say(5)} {passage} {say(5)}", f"{say(30)} token=abcdef123456 {say(10)}", None, "", "  ", None]
    rows = [(k, x, "en", "web", len(x or "")) for k, x in enumerate([*texts, *special, *toxic, *(say(60) for _ in range(900))])]
    rows += [rows[3], (None, say(40), None, None, None), (5, say(40), "en", None, 1)]
    return rows, passage, len(texts), len(special), len(toxic)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, passage, n, m, toxic = corpus()
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    marks = [(k, 1, int(n + m <= k < n + m + toxic)) for k in range(len(rows) - 3)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run(spark, folder):
    rows, passage, n, m, toxic = corpus()
    out = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    at = {name: n + k for k, name in enumerate(("copy", "near", "contaminated", "secret", "null", "empty", "blank", "null2"))}
    gone = {at["copy"], at["near"], at["contaminated"], *range(n + m, n + m + toxic)}
    kept = sorted((x[0] is None, x[0] or 0, x[1] or "") for k, x in enumerate(rows) if x[0] not in gone and k != len(rows) - 3)
    mask = lambda x: x.replace("token=abcdef123456", "[SECRET]")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out) == [(a, b, mask(x)) for a, b, x in kept]
    known = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=bpe_codec.read_ranks(tokenizer("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in out:
        text = r["text"] or ""
        assert list(r["ids"]) == known.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["text"] is None or r["n_chars"] == len(text) or "[SECRET]" not in text


def test_stages_keep_columns_and_empty_tables(spark, folder):
    empty = spark.createDataFrame([], FIELDS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, folder).columns == empty.columns, name
        assert stage(spark, empty, folder).count() == 0, name
    assert corpus_pipeline.encoding_stage(spark, empty, folder).count() == 0
