"""Benchmark decontamination with suffix arrays of the training texts.

Each shard (a slice of rows in a map task) gets a suffix array of its words. Every suffix of every
benchmark item is looked up in it by binary search, which gives its longest verbatim match there and
where it stands. Suffixes that match at least a window lead to all places of that window; windows
that follow each other in both texts make one longer match. Training suffixes whose first word no
item has match nothing and are left out of the array.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearweave.llm.common import slices, stored, unused, with_columns

#: Consecutive words of a window; an item with fewer is one window.
WINDOW = 13
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark goes in blocks.
BLOCK_BYTES = 8 << 20

#: Bytes of words are kept, A-Z in lower case; all others become spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """Words [0-9A-Za-z and all beyond ASCII]+, with A-Z in lower case."""
    return data.translate(_FOLD).split()


class TestSet:
    """The words of benchmark items as numbers, one item after the other, each with -1 after it.

    suffixes: where they begin (every word of every item). left: the words from a place to its item's
    end; need: those of the window that begins there, 0 if none does.
    """

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        words: list[int] = []
        sizes: list[int] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append(item)
                sizes.append(len(ids))
                words += [*ids, -1]
        size = np.array(sizes, np.int64)
        self.words = np.array(words, np.int32)
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])[: len(size)].astype(np.int64)
        self.owner = np.repeat(np.arange(len(size)), size + 1)
        whole = np.repeat(size, size + 1)
        self.left = whole - (np.arange(len(words)) - self.begin[self.owner] if words else np.zeros(0, np.int64))
        self.need = np.where(self.left >= window, window, np.where(self.left == whole, self.left, 0))
        self.suffixes = np.flatnonzero(self.left)
        self.depth = int(size.max(initial=0))


class Shard:
    """A suffix array over the words of several texts, with 0 for words that no item has and between texts."""

    def __init__(self, texts: list[list[bytes]], test: TestSet):
        self.test = test
        get = test.vocabulary.get
        self.begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        self.words = np.zeros(int(self.begin[-1]) + 1, np.int32)
        for at, words in zip(self.begin.tolist(), texts):
            self.words[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        self.array = self._suffixes()

    def _suffixes(self) -> np.ndarray:
        """Places of the suffixes, sorted by as many words as the longest item has: ranks by one word make
        ranks by two, these by four, and so on, until all differ. What follows a 0 is not told apart."""
        rank = self.words.astype(np.int64)
        places = np.flatnonzero(rank)
        reach, kinds = 1, 0
        while reach < self.test.depth and kinds < len(places):
            after = np.zeros(len(rank), np.int64)
            after[:-reach] = rank[reach:]
            found, dense = np.unique(rank[places] * (rank.max() + 1) + after[places], return_inverse=True)
            rank[places] = dense + 1
            reach, kinds = 2 * reach, len(found)
        return places[np.argsort(rank[places], kind="stable")]

    def _compare(self, places: np.ndarray, suffixes: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes at places against those of the benchmark, within the first most words, and
        how many words they share."""
        order, common = np.zeros(len(places), np.int8), np.zeros(len(places), np.int64)
        open_, depth = np.arange(len(places)), 0
        while len(open_):
            if most is not None:
                open_ = open_[most[open_] > depth]
            a, b = self.words[places[open_] + depth], self.test.words[suffixes[open_] + depth]
            same = a == b
            order[open_[~same]] = np.where(a[~same] < b[~same], -1, 1)
            open_ = open_[same]
            common[open_] += 1
            depth += 1
        return order, common

    def _bound(self, suffixes: np.ndarray, most: np.ndarray | None = None, after: bool = False) -> np.ndarray:
        """For each suffix, binary search for the first place that is not before it (or that is after it)."""
        low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(self.array), np.int64)
        for _ in range(max(1, math.ceil(math.log2(len(self.array) + 1)))):
            todo = low < high
            middle = (low + high) // 2
            order, _ = self._compare(self.array[np.minimum(middle, len(self.array) - 1)], suffixes, most)
            before = todo & ((order < 0) | (after & (order == 0)))
            low = np.where(before, middle + 1, low)
            high = np.where(todo & ~before, middle, high)
        return low

    def longest_of_suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the benchmark, the words of its longest match here, and where that begins."""
        suffixes = self.test.suffixes
        if not len(self.array):
            return np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
        at, last = self._bound(suffixes), len(self.array) - 1
        beside = [self.array[np.clip(k, 0, last)] for k in (at - 1, at)]
        one, two = (self._compare(places, suffixes)[1] for places in beside)
        return np.maximum(one, two), np.where(one >= two, *beside)

    def longest(self) -> np.ndarray:
        """For each item, the words of its longest match in this shard."""
        found = np.zeros(len(self.test.items), np.int64)
        np.maximum.at(found, self.test.owner[self.test.suffixes], self.longest_of_suffixes()[0])
        return found

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows (as places of the benchmark) and the places of all their occurrences here."""
        test = self.test
        most, _ = self.longest_of_suffixes()
        windows = test.suffixes[(test.need[test.suffixes] > 0) & (most >= test.need[test.suffixes])]
        if not len(windows):
            return windows, windows
        need = test.need[windows]
        low, high = self._bound(windows, need), self._bound(windows, need, after=True)
        n = high - low
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(windows, n), self.array[np.repeat(low, n) + offset]


def hits(texts: list[bytes | None], test: TestSet) -> list[dict]:
    """For each text: n_words, spans (disjoint stretches of words inside windows), items with windows in it,
    and longest: for each of these items its longest match, the first if tied (item, item_start, start, length)."""
    split = [words_of(x or b"") for x in texts]
    shard = Shard(split, test)
    out = [{"n_words": len(x), "spans": [], "items": [], "longest": []} for x in split]
    windows, places = shard.matches()
    if not len(windows):
        return out
    owner, need = test.owner[windows], test.need[windows]

    order = np.argsort(places, kind="stable")
    start, until = places[order], np.maximum.accumulate(places[order] + need[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > until[:-1]]))
    for a, b in zip(start[first].tolist(), until[np.append(first[1:], len(start)) - 1].tolist()):
        k = int(np.searchsorted(shard.begin, a, "right")) - 1
        at = int(shard.begin[k])
        out[k]["spans"].append({"start": a - at, "end": b - at})

    # windows one behind the other in both texts are one match
    order = np.lexsort([windows, places - windows, owner])
    w, p = windows[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1] + 1) | (p[1:] != p[:-1] + 1) | (owner[order][1:] != owner[order][:-1])]))
    length = need[order][first] + np.diff(np.append(first, len(w))) - 1
    w, p, item = w[first], p[first], owner[order][first]
    text = np.searchsorted(shard.begin, p, "right") - 1
    names = np.array(test.items, object)[item]
    best: dict[tuple[int, str], tuple] = {}
    for k in np.lexsort([w, p, -length]).tolist():
        best.setdefault((int(text[k]), names[k]), (int(w[k] - test.begin[item[k]]), int(p[k] - shard.begin[text[k]]), int(length[k])))
    for (k, name), (item_start, start_, size) in sorted(best.items()):
        out[k]["items"].append(name)
        out[k]["longest"].append({"item": name, "item_start": item_start, "start": start_, "length": size})
    return out


def _block_count(items: DataFrame, bound: int) -> int:
    return max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / bound))


def _blocks(benchmark: DataFrame, item: str, text: str, bound: int) -> Iterator[tuple[int, Broadcast]]:
    """The number of blocks, and each block's items with text, of about bound bytes, broadcast as they are; a
    block's broadcast is taken back before the next one is collected."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    items = items.where("text is not null").withColumn("item", F.coalesce("item", F.lit("")))
    n = _block_count(items, bound)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        shared = benchmark.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in part.collect()])
        yield n, shared
        if n > 1:
            shared.destroy()


_SETS: dict[tuple[str, int], TestSet] = {}


def _test_set(shared: Broadcast, number: str, window: int) -> TestSet:
    """The block's suffixes, made once in each worker."""
    if (number, window) not in _SETS:
        _SETS.clear()
        _SETS[number, window] = TestSet(shared.value, window)
    return _SETS[number, window]


_FOUND = "n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>,longest:array<struct<item:string,item_start:int,start:int,length:int>>"


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, block_bytes: int, to: str) -> DataFrame:
    """docs with what hits says of each row, as a struct in the column to."""
    out, before = docs, None
    for n, shared in _blocks(benchmark, item, item_text, block_bytes):
        number = uuid.uuid4().hex

        def make(shared=shared, number=number) -> Callable:
            test = _test_set(shared, number, window)
            return lambda texts: {to: hits([x.encode() if isinstance(x, str) else x for x in texts], test)}

        out = with_columns(out, text, make, f"`{to}` struct<{_FOUND}>")
        if before is not None:
            out = out.withColumn(to, _both(F.col(to), F.col(before))).drop(before)
        if n > 1:
            before = unused(out, "before")
            out = stored(out, "searched").withColumnRenamed(to, before)
    return out.withColumnRenamed(before, to) if before else out


def _both(x: Column, y: Column) -> Column:
    """What two blocks say of a row, together."""
    spans = F.aggregate(
        F.array_sort(F.concat(x["spans"], y["spans"])),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(s["end"], F.element_at(done, -1)["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    items = F.array_sort(F.array_union(x["items"], y["items"]))
    every = F.concat(x["longest"], y["longest"])
    best = lambda name: F.array_max(
        F.transform(F.filter(every, lambda m: m["item"] == name), lambda m: F.struct(m["length"], -m["start"], -m["item_start"]))
    )
    longest = F.transform(
        items,
        lambda name: F.struct(
            name.alias("item"), (-best(name)["col3"]).alias("item_start"), (-best(name)["col2"]).alias("start"), best(name)["length"].alias("length")
        ),
    )
    return F.struct(x["n_words"].alias("n_words"), spans.alias("spans"), items.alias("items"), longest.alias("longest"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words (long), hit_spans (array of struct start, end: disjoint stretches of words
    inside benchmark windows, end exclusive), hit_items (array of string: sorted ids of items
    with a window in the text) and longest_matches (for each of these items its longest verbatim match:
    item, item_start, start, length, in words; the first if tied).

    Rows stay where they are; texts of any length are searched whole. The benchmark is broadcast by
    blocks of block_bytes, each passing over all rows; with several, each pass is written to the shared
    folder, so that one block at a time is held. Null texts and texts without words have no words and no
    hits; items without words match nothing; an item repeated under one id counts once; a null id is an
    empty one; an empty benchmark hits nothing; an empty table stays empty. Rows that repeat are judged
    each. Columns of docs with the names of the results are replaced, all others kept.
    """
    to = unused(docs, "found")
    found = _searched(docs, benchmark, text, item, item_text, window, block_bytes, to)
    names = {"n_words": "n_words", "hit_spans": "spans", "hit_items": "items", "longest_matches": "longest"}
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), *(F.col(f"`{to}`.{f}").alias(n) for n, f in names.items()))


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each item with words its longest verbatim match in all texts, of any length: item, length, item_start,
    key, start (0 and nulls if it shares no word). Of equally long ones the least key is named.

    Each task reports one row an item; these are summed up by item.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    out = None
    for n, shared in _blocks(benchmark, item, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = TestSet(shared.value, WINDOW)
            best: dict[str, tuple] = {name: (0, None, None, None) for name in test.items}
            for batch in slices(batches, text):
                keys = batch.column(key).to_pylist()
                shard = Shard([words_of((x or "").encode()) for x in batch.column(text).to_pylist()], test)
                length, place = shard.longest_of_suffixes()
                for k in np.flatnonzero(length):
                    suffix, name = test.suffixes[k], test.items[test.owner[test.suffixes[k]]]
                    if length[k] > best[name][0]:
                        row = int(np.searchsorted(shard.begin, place[k], "right")) - 1
                        best[name] = (int(length[k]), int(suffix - test.begin[test.owner[suffix]]), keys[row], int(place[k] - shard.begin[row]))
            yield pa.RecordBatch.from_pylist([{"item": name, "length": a, "item_start": b, key: c, "start": d} for name, (a, b, c, d) in best.items()], made)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = f"item string, length long, item_start long, `{key}` {kind}, start long"
        made = to_arrow_schema(StructType.fromDDL(schema))
        rows = docs.select(key, text).mapInArrow(run, schema)
        order = F.struct(-F.col("length"), F.col(key).isNull(), F.col(key), F.col("start"), F.col("item_start"))
        found = rows.groupBy("item").agg(F.min_by(F.struct("length", "item_start", key, "start"), order).alias("best")).select("item", "best.*")
        if n > 1:
            found = stored(found, "longest")
        out = found if out is None else out.unionByName(found)
    order = F.struct(-F.col("length"), F.col(key).isNull(), F.col(key), F.col("start"), F.col("item_start"))
    return out.groupBy("item").agg(F.min_by(F.struct("length", "item_start", key, "start"), order).alias("best")).select("item", "best.*")


def _hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda done, x: done + x["end"] - x["start"])


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated, and longest_words (of the
    longest verbatim match with an item that has a window here, else 0)."""
    found = find_contamination(docs.select(key, "text"), benchmark)
    longest = F.coalesce(F.array_max(F.transform("longest_matches", lambda m: m["length"])), F.lit(0)).cast("long")
    return found.select(
        key,
        "n_words",
        _hit_words("hit_spans").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        longest.alias("longest_words"),
    ).select(
        key, "n_words", "n_hit", "n_items", "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_words",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows: those of whose words a twentieth or more are hit. All columns
    stay as they are."""
    to = unused(docs, "found")
    found = _searched(docs, benchmark, "text", "item_id", "text", WINDOW, BLOCK_BYTES, to)
    n_hit = _hit_words(f"`{to}`.spans")
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(f"`{to}`.n_words")))).drop(to)
