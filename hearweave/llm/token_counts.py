"""Token counts by a two-tier lookup inside the map tasks.

Tier one is a broadcast table of the token counts of frequent pre-tokens, found by counting all
texts: each task sends a bounded summary of its own counts, never its pre-tokens. Tier two is a
cache in each worker; what it misses goes to the tokenizer library once.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.bpe_codec import parts_of
from hearweave.llm.common import slices, with_columns

#: Entries of the broadcast table; with pre-tokens of at most TABLE_CHARS characters that bounds it.
TABLE_ROWS, TABLE_CHARS = 65_536, 32
#: Counters a task holds, and those it reports.
TASK_COUNTERS, TASK_REPORTS = 200_000, 8_192
#: Entries of a worker's cache beside the table; beyond it is emptied before the next slice.
CACHE = 400_000


def frequent_parts(docs: DataFrame, text: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """(part, n): the most frequent space-led pre-token runs over all rows of docs.

    A task that holds more than TASK_COUNTERS counters drops those seen once; it reports its
    TASK_REPORTS largest. Only these summaries are shuffled. The counts guide the table alone, never
    the result.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, text):
            for x in batch.column(text).to_pylist():
                counts.update((parts_of(x or "") or [""])[1:])
            least = 1
            while len(counts) > TASK_COUNTERS:
                counts = Counter({k: n for k, n in counts.items() if n > least})
                least *= 2
        top = [(k, n) for k, n in counts.most_common(TASK_REPORTS) if n > 1 and len(k) <= TABLE_CHARS and "\0" not in k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"]
        )

    reports = docs.select(text).mapInArrow(summary, "part string, n long")
    return reports.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(rows)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens"
) -> DataFrame:
    """docs with the UTF-8 bytes and the tokens of text, as the tokenizers library counts them
    without added special tokens (special strings inside a text count as it treats them).

    Only for byte-level BPE files whose pre-tokenizer has the GPT-2 pattern: their pre-tokens end
    before every space that follows no white space. Null counts as empty: 0 and 0. Repeated rows are
    counted each. Other columns are kept; those named as the results are replaced.
    """
    table = [r["part"] for r in frequent_parts(docs, text).collect()]
    # the library's counts of the table, once for all workers: parts, and a byte for each count
    known = dict(zip(table, _library(tokenizer_path)([" " + x for x in table])))
    small = {k: n for k, n in known.items() if n < 256}
    shared = docs.sparkSession.sparkContext.broadcast(("\0".join(small), bytes(small.values())))

    def make():
        parts, counts = shared.value
        fixed = dict(zip(parts.split("\0"), counts)) if counts else {}
        look = dict(fixed)
        library = _library(tokenizer_path)

        def count(texts: list[str | None]) -> dict:
            nonlocal look
            split = [parts_of(x or "") for x in texts]
            heads = library([(x or "") if p is None else p[0] for x, p in zip(texts, split)])
            if len(look) > len(fixed) + CACHE:
                look = dict(fixed)
            missing = list({x for p in split if p for x in p[1:]} - look.keys())
            look.update(zip(missing, library([" " + x for x in missing])))
            get = look.__getitem__
            return {
                n_bytes: [len((x or "").encode()) for x in texts],
                n_tokens: [h + sum(map(get, p[1:])) if p else h for h, p in zip(heads, split)],
            }

        return count

    return with_columns(docs, text, make, f"`{n_bytes}` long, `{n_tokens}` long")


def loaded(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _library(path: str):
    tokenizer = loaded(path)
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
