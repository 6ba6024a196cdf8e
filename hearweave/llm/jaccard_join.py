"""Exact n-gram Jaccard join of documents with signature trees.

Documents with equal shingle sets form a class. Two classes can only link if they share one of the
first shingles of both in a common order (frequent shingles last, then by hash), so each class meets
its possible partners in the buckets of these few shingles. With somewhat more of the first shingles
links must share several of them, so a class with fewer shared ones is left out from the start. A
bucket is searched with a signature tree: nodes hold the OR of their sets' bitmaps and their range of
sizes, and a dual traversal drops node pairs whose maximum possible overlap is too small.

What remains is not sent out pair by pair. A bucket gives the pairs of a forest over its groups, the
likeliest first, which are verified on whole sets; the groups that link are joined, pairs that failed
are remembered, and buckets with further pairs between different groups are searched again, until no
pair is left. So the pairs follow the number of classes, not the square of a group's size.

Before that, classes with the same least shingle, in either of two orders, are held against each other
on whole sets. Pairs that met there are settled, so buckets skip them too.
Groups and buckets are cut into blocks of bounded size; no task gets an unbounded one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.common import let_go, removed, slices, stored, with_columns
from hearweave.llm.url_filter import possible

#: Classes of a block of a group; of a block of a bucket: those asking, and those answering.
GROUP, ASK, ANSWER = 1024, 256, 512
#: The order's frequent shingles: seen in so many documents of a slice, in all of so many; their number.
HOT_LOCAL, HOT_ALL, HOT_ROWS = 4, 48, 200_000
#: Linked sets must share one of so many shingles of the smaller among their first ones.
SHARED = 20
#: Bits of a set's bitmap for each shingle, rounded up to a power of two, within these.
WIDE, LEAST_BITS, MOST_BITS = 2, 128, 4096
#: Children of a tree node; words of bitmaps handled at a time.
FAN, WORDS = 8, 1 << 20
#: Pairs that a class may offer to a group grow by this factor from round to round.
MORE = 8
#: Rows of blocks that are searched at once; longer blocks have a tree of their own.
HELD, SMALL = 1 << 14, 24
#: Bytes of a shingle in the sets that are sent.
SENT = 6
_MULTIPLY, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


class Shingler:
    """Sets of hashed word shingles; A-Z are lower-cased and words parted by ASCII white space."""

    def __init__(self, words: int):
        self.words = words

    def _mixed(self, hashes: np.ndarray, reach: int) -> np.ndarray:
        n = len(hashes) - reach + 1
        made = np.full(n, reach, np.uint64)
        for k in range(reach):
            made = (made ^ hashes[k : n + k]) * _MULTIPLY
            made ^= made >> np.uint64(29)
            made += _ADD
        return made

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted set of each text."""
        out: list[np.ndarray] = []
        start, size = 0, 0
        for k, x in enumerate(texts):
            size += len(x or "")
            if size > 1 << 20 or k == len(texts) - 1:
                out += self._some(texts[start : k + 1])
                start, size = k + 1, 0
        return out

    def _some(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [x.encode().lower().split() if x else [] for x in texts]
        sizes = [len(x) for x in split]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, sum(sizes))
        all_ = self._mixed(hashes, self.words) if len(hashes) >= self.words else hashes[:0]
        out, at = [], 0
        for n in sizes:
            made = all_[at : at + n - self.words + 1] if n >= self.words else self._mixed(hashes[at : at + n], n) if n else hashes[:0]
            made = np.sort(made)
            if n:
                new = np.ones(len(made), bool)
                np.not_equal(made[1:], made[:-1], out=new[1:])
                made = made[new]
            out.append(made)
            at += n
        return out


def digest(shingles: np.ndarray) -> list[int]:
    """The two halves of a set's digest."""
    return np.frombuffer(xxhash.xxh128(shingles.tobytes()).digest(), np.int64).tolist()


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (WIDE * len(shingles) - 1).bit_length()))
    marks = np.zeros(bits, np.uint8)
    marks[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def packed(shingles: np.ndarray) -> bytes:
    """The upper bytes of each shingle, in order. At 48 bits a set pair differs from its hashes as rarely
    as hashes collide."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, :SENT] = part
    return whole.view(">u8").ravel().astype(np.uint64)


def leasts(shingles: np.ndarray) -> list[int]:
    """The least shingle in two orders."""
    other = shingles * _MULTIPLY
    other ^= other >> np.uint64(31)
    return [int(shingles.min().view(np.int64)), int((other * _MULTIPLY).min().view(np.int64))]


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap on fewer words: halves are OR-combined."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


class SignatureTree:
    """Sets in order of size and bitmap, with nodes over FAN of them, over FAN of these, and so on.

    labels: numbers of each set; two sets of which any label is equal are no pair.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, labels: list[np.ndarray]):
        self.order = np.lexsort([*(bits[:, k] for k in range(min(2, bits.shape[1]))), labels[0], sizes])
        bits, sizes = bits[self.order], sizes[self.order]
        marks = np.stack([x[self.order] for x in labels], axis=1)
        excess = sizes - np.bitwise_count(bits).sum(axis=1)
        one = [bits, sizes, sizes, excess, marks, marks]
        self.levels = [one]
        while len(one[0]) > FAN:
            cut = np.arange(0, len(one[0]), FAN)
            ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            one = [way.reduceat(x, cut, axis=0) for way, x in zip(ways, one)]
            self.levels.append(one)

    def _open(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold a link."""
        bits, low, high, excess, least, most = self.levels[level]
        a, b = low[i], low[j]
        keep = (den * high[i] >= num * b) & (den * high[j] >= num * a)
        keep &= ~((least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j])).any(axis=1)
        i, j = i[keep], j[keep]
        a, b = low[i], low[j]
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(common + np.minimum(excess[i], excess[j]), np.minimum(high[i], high[j]))
        keep[keep] = may_link(a, b, bits[i], bits[j], num, den) if level == 0 else (num + den) * bound >= num * (a + b)
        return keep

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of sets (their numbers) that may link by their bitmaps, and how many bits differ."""
        most = max(FAN * FAN, WORDS // self.levels[0][0].shape[1])
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        work = [(top, i, j)]
        while work:
            level, i, j = work.pop()
            if len(i) > most:
                work += [(level, i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)]
                continue
            if level == 0:
                different = i != j
                i, j = i[different], j[different]
            keep = self._open(level, i, j, num, den)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                bits = self.levels[0][0]
                yield self.order[i], self.order[j], np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                continue
            n = len(self.levels[level - 1][0])
            # children of each pair; of a node with itself, each pair of children once
            steps = np.arange(FAN)
            x = (i[:, None, None] * FAN + steps[None, :, None]).repeat(FAN, axis=2).ravel()
            y = (j[:, None, None] * FAN + steps[None, None, :]).repeat(FAN, axis=1).ravel()
            inside = (x < n) & (y < n) & (x <= y)
            work.append((level - 1, x[inside], y[inside]))


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m shingles may link by their bitmaps x and y (rows): each bit of one that
    the other lacks is a shingle that the other lacks."""
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return (num + den) * most >= num * (n + m)


def candidates(sizes: np.ndarray, bitmaps: list[np.ndarray], labels: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets that may link, from a tree for each width of bitmaps; sets of the next width are in it too."""
    sizes = sizes.astype(np.int64)
    widths = np.array([len(x) for x in bitmaps])
    for width in np.unique(widths):
        rows = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(rows) < 2:
            continue
        bits = np.stack([folded(bitmaps[k], width) for k in rows])
        later = np.where(widths[rows] == width, -1 - np.arange(len(rows)), 0)  # pairs of two wider sets come with their own width
        tree = SignatureTree(sizes[rows], bits, [*(x[rows] for x in labels), later])
        for i, j, apart in tree.pairs(num, den):
            yield rows[i], rows[j], apart


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def joined(self, a: int, b: int) -> bool:
        """Joins a and b; whether they were apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _in_groups(df: DataFrame, keys: tuple[str, ...], work: Callable[[pa.Table], list], schema: str) -> DataFrame:
    """work on the rows of each combination of keys, which are few enough for one task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = list(to_arrow_schema(StructType.fromDDL(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(tables: list[pa.Table]) -> pa.RecordBatch:
            columns = work(pa.concat_tables(tables).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names)], names=[f.name for f in names])

        let_go()
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = [table[k].to_numpy() for k in keys]
            new = np.zeros(len(table), bool)
            for x in ids:
                new[1:] |= x[1:] != x[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(table)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                now = tuple(x[a] for x in ids)
                if held and now != last:
                    yield done(held)
                    held = []
                last = now
                held.append(table.slice(a, b - a))
        if held:
            yield done(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def hot_shingles(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Hashes of shingles of many documents, HOT_ROWS at most, sorted. They only order the shingles:
    any list gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words).many
        for batch in slices(batches, text):
            values, n = np.unique(np.concatenate(shingles(batch.column(text).to_pylist())), return_counts=True)
            often = n >= HOT_LOCAL
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["shingle", "n"]
            )

    counts = docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= HOT_ALL).orderBy(F.desc("n"), "shingle").limit(HOT_ROWS).collect()
    return np.sort(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64))


def _signed(docs: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """key, n, d1, d2 (a digest of the set), prefix, bits, lows for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, text, words))

    def make():
        shingles, hot = Shingler(words).many, shared.value

        def run(texts: list[str | None]) -> dict:
            out: dict[str, list] = {k: [] for k in ("n", "d1", "d2", "prefix", "bits", "lows")}
            for s in shingles(texts):
                d1, d2 = digest(s)
                n = len(s)
                length = n + (num * n) // -den + max(1, n // SHARED) if n else 0
                if n and len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    s = np.concatenate([s[~often], s[often]])
                for k, v in zip(out, (n, d1, d2, (s[:length] >> np.uint64(16)).view(np.int64), bitmap(s).tobytes() if n else b"", leasts(s) if n else [])):
                    out[k].append(v)
            return out

        return run

    return with_columns(docs.select(key, text), text, make, "n long, d1 long, d2 long, prefix array<long>, bits binary, lows array<long>", (text,))


def _sets(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, n, bits, lows, shingles of classes, from the text of one of their documents each."""
    wanted = classes.select("id", "n", "bits", "lows", "d1", "d2", F.col("rep").alias("doc"))
    bodies = docs.select(F.col(key).alias("doc"), F.col(text).alias("body"))
    found = possible(bodies, wanted, "doc").withColumnRenamed("doc", "doc_").join(wanted.hint("shuffle_hash"), F.col("doc_").eqNullSafe(F.col("doc")))

    def make():
        shingles = Shingler(words).many

        def run(texts: list[str | None]) -> dict:
            sets = shingles(texts)
            both = [digest(s) for s in sets]
            return {"shingles": [packed(s) for s in sets], "e1": [a for a, _ in both], "e2": [b for _, b in both]}

        return run

    made = with_columns(found.drop("doc", "doc_"), "body", make, "shingles binary, e1 long, e2 long", ("body",))
    # an id may stand on several rows: of other texts, or repeated; then a class is there more than once
    return made.where("d1 = e1 and d2 = e2").select("id", "n", "bits", "lows", "shingles")


def _cells(sets: DataFrame) -> DataFrame:
    """id, place, low, part: the blocks of the groups of the same least shingle, in each of the orders."""
    rows = sets.select("id", F.posexplode("lows").alias("place", "low")).distinct()
    groups = rows.groupBy("place", "low").count().where("count > 1")
    return rows.join(groups, ["place", "low"]).select("id", "place", "low", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / GROUP)).alias("part"))


def _local_links(sets: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """(id, root): verified links within cells, of which all pairs are held against each other."""
    dealt = cells.join(sets.select("id", "n", "bits", "shingles"), "id")

    def work(table: pa.Table) -> list:
        ids, index = np.unique(table["id"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return [[], []]
        table = table.take(index)
        data = table["shingles"].to_pylist()
        sets_: dict[int, np.ndarray] = {}
        union = Union(len(ids))
        for i, j, apart in candidates(table["n"].to_numpy(), _arrays(table["bits"]), [np.arange(len(ids))], num, den):
            for k in np.argsort(apart, kind="stable"):
                a, b = int(i[k]), int(j[k])
                if union.find(a) != union.find(b):
                    for x in (a, b):
                        if x not in sets_:
                            sets_[x] = unpacked(data[x])
                    if linked(sets_[a], sets_[b], num, den):
                        union.join(a, b)
        roots = [union.find(k) for k in range(len(ids))]
        moved = [k for k, r in enumerate(roots) if k != r]
        return [ids[moved], ids[[roots[k] for k in moved]]]

    return _in_groups(dealt, ("place", "low", "part"), work, "id long, root long")


def _bucket_rows(grouped: DataFrame) -> DataFrame:
    """The rows of the blocks of buckets with several groups, from tok, id, grp.

    A small bucket is one block (side -1). Of others, classes outside the largest group ask and all
    answer, so that a block has ASK and ANSWER of them.
    """
    by_group = grouped.groupBy("tok", "grp").count()
    buckets = by_group.groupBy("tok").agg(F.max_by("grp", F.struct("count", "grp")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    buckets = buckets.where(F.col("all") > F.col("most"))
    one = F.col("all") <= ANSWER
    asking, answering = F.ceil((F.col("all") - F.col("most")) / ASK).cast("int"), F.ceil(F.col("all") / ANSWER).cast("int")
    rows = grouped.join(buckets, "tok").withColumns({"asking": asking, "answering": answering, "hash": F.xxhash64("id")})
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = lambda n: F.pmod(F.col("hash"), F.col(n)).cast("int")
    place = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    answers = every("asking", lambda p: place(p, own("answering"), 0))
    asks = F.when(F.col("grp") != F.col("main"), every("answering", lambda q: place(own("asking"), q, 1)))
    places = F.when(one, F.array(place(F.lit(0), F.lit(0), -1))).when(asks.isNull(), answers).otherwise(F.concat(answers, asks))
    return rows.select("tok", "id", "grp", F.inline(places))


def _small_pairs(starts: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], labels: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """candidates of many small blocks at once; block k has the rows from starts[k] to starts[k + 1]. Each
    is a tree of one node."""
    lengths = np.diff(starts)
    widths = np.array([len(x) for x in bitmaps])
    for length in np.unique(lengths[(lengths > 1) & (lengths <= SMALL)]):
        begin = starts[:-1][lengths == length]
        x, y = np.triu_indices(length, 1)
        i, j = (begin[:, None] + x).ravel(), (begin[:, None] + y).ravel()
        keep = (den * sizes[i] >= num * sizes[j]) & (den * sizes[j] >= num * sizes[i])
        for label in labels:
            keep &= label[i] != label[j]
        i, j = i[keep], j[keep]
        width = np.minimum(widths[i], widths[j])
        for w in np.unique(width):
            a, b = i[width == w], j[width == w]
            rows, number = np.unique(np.concatenate([a, b]), return_inverse=True)
            bits = np.stack([folded(bitmaps[k], w) for k in rows])
            for k in range(0, len(a), WORDS // w):
                u, v = bits[number[k : min(k + WORDS // w, len(a))]], bits[number[len(a) + k : len(a) + min(k + WORDS // w, len(a))]]
                c, d = a[k : k + WORDS // w], b[k : k + WORDS // w]
                good = may_link(sizes[c], sizes[d], u, v, num, den)
                if good.any():
                    yield c[good], d[good], np.bitwise_count(u[good] ^ v[good]).sum(axis=1, dtype=np.int64)


def _chosen(a: list[int], b: list[int], g: np.ndarray, h: np.ndarray, limit: int) -> list[int]:
    """Of a block's pairs (a in group g, b in group h), the likeliest first: a forest over the groups
    (limit 0), or at most limit of a class with a group."""
    taken = []
    if not limit:
        _, first = np.unique(np.stack([np.minimum(g, h), np.maximum(g, h)]), axis=1, return_index=True)
        names, number = np.unique(np.concatenate([g, h]), return_inverse=True)
        x, y, union = number[: len(g)].tolist(), number[len(g) :].tolist(), Union(len(names))
        return [k for k in np.sort(first).tolist() if union.joined(x[k], y[k])]
    met: Counter = Counter()
    for k, (x, y, p, q) in enumerate(zip(a, b, g.tolist(), h.tolist())):
        if met[x, q] < limit and met[y, p] < limit:
            met[x, q] += 1
            met[y, p] += 1
            taken.append(k)
    return taken


def _bucket_pairs(rows: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """(tok, a, b): of each block those pairs of different groups that may link, have not met in a cell and
    have not failed: with limit 0 a forest over the groups, else at most limit of a class with a group.
    The likeliest come first. A row without a and b says that the bucket has more.

    rows: tok, p, q, side, id, n, bits, grp, cell0, cell1, failed.
    """

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        tok, ids, grp = table["tok"].to_numpy(), table["id"].to_numpy(), table["grp"].to_numpy()
        sizes, bitmaps = table["n"].to_numpy().astype(np.int64), _arrays(table["bits"])
        side = table["side"].to_numpy().astype(np.int64)
        labels = [grp, table["cell0"].to_numpy(), table["cell1"].to_numpy(), np.where(side < 0, -1 - np.arange(len(ids)), side)]
        found = list(_small_pairs(starts, sizes, bitmaps, labels, num, den))
        for k in np.flatnonzero(np.diff(starts) > SMALL):
            at = slice(starts[k], starts[k + 1])
            found += ((i + at.start, j + at.start, d) for i, j, d in candidates(sizes[at], bitmaps[at], [x[at] for x in labels], num, den))
        i, j, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        turn = ids[i] > ids[j]
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        if table["failed"].null_count < len(ids):
            failed = {(x, y) for x, others in zip(ids.tolist(), table["failed"].to_pylist()) for y in others or ()}
            new = np.array([pair not in failed for pair in zip(ids[i].tolist(), ids[j].tolist())], bool)
            i, j, apart = i[new], j[new], apart[new]
        block = np.searchsorted(starts, i, "right") - 1
        order = np.lexsort([ids[j], ids[i], apart, block])
        i, j, block = i[order], j[order], block[order]
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
        out: tuple[list, list, list] = ([], [], [])
        for x, y in zip(cuts, cuts[1:]):
            a, b = ids[i[x:y]], ids[j[x:y]]
            taken = _chosen(a.tolist(), b.tolist(), grp[i[x:y]], grp[j[x:y]], limit)
            more = [None] if len(taken) < y - x else []
            for column, values in zip(out, ([int(tok[i[x]])] * (len(taken) + len(more)), [*a[taken].tolist(), *more], [*b[taken].tolist(), *more])):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["tok", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[pa.Table] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(pa.Table.from_batches([batch]))
                if sum(map(len, held)) < HELD:
                    continue
            if not held:
                continue
            table = pa.concat_tables(held).combine_chunks()
            new = np.zeros(len(table), bool)
            new[:1] = True
            for k in ("tok", "p", "q"):
                x = table[k].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new)
            # the last block may go on in the next batch
            end = len(table) if batch is None else int(starts[-1])
            held = [table.slice(end)] if batch is not None else []
            if end:
                yield work(table.slice(0, end), np.append(starts[starts < end], end))

    keys = ("tok", "p", "q")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "tok long, a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link by their whole sets."""

    def one(x: str) -> DataFrame:
        return possible(sets.select(F.col("id").alias(x), F.col("shingles").alias(f"shingles_{x}")), pairs.select(x), x)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles_a"):
            sides = zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist())
            keep = [linked(unpacked(x), unpacked(y), num, den) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(link, "a long, b long")


def _far_links(shared: DataFrame, sets: DataFrame, cells: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """groups (id, comp) with the links in buckets joined in, from shared (tok, id); see the module."""
    cell = lambda k: F.max(F.when(F.col("place") == k, F.xxhash64("low", "part"))).alias(f"cell{k}")
    met = cells.groupBy("id").agg(cell(0), cell(1))
    none = lambda k: F.coalesce(f"cell{k}", F.xxhash64("id", F.lit(k))).alias(f"cell{k}")
    known = stored(sets.select("id", "n", "bits").join(met, "id", "left").select("id", "n", "bits", none(0), none(1)).dropDuplicates(["id"]), "known_sets")
    failed, limit = None, 0
    while True:
        grouped = shared.join(groups, "id", "left").select("tok", "id", F.coalesce("comp", "id").alias("grp"))
        rows = _bucket_rows(grouped).join(known, "id")
        if failed is None:
            rows = rows.withColumn("failed", F.lit(None).cast("array<long>"))
        else:
            rows = rows.join(failed.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("failed")), "id", "left")
        out = stored(_bucket_pairs(rows, num, den, limit), "pairs")
        pairs = out.where("a is not null").select("a", "b").distinct()
        links = stored(_verified(pairs, sets, num, den), "links")
        groups = components(groups.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(links))
        more = out.where("a is null").select("tok").distinct()
        if not more.limit(1).count():
            return groups
        new = pairs.join(links, ["a", "b"], "left_anti")
        failed = stored(new if failed is None else failed.union(new), "failed")
        shared = stored(shared.join(more, "tok", "left_semi"), "left")
        limit = MORE * max(1, limit)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): the least id reachable from each id on an edge. Labels spread along edges and
    jump to the label of their label, until none changes."""
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).union(edges.select(F.col(b), F.col(a)))
    both = stored(both.where("id != next").distinct(), "edges")
    labels = both.groupBy("id").agg(F.min("next").alias("least")).select("id", F.least("id", "least").alias("comp"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "next", "comp": "near"}), "next").groupBy("id").agg(F.min("near").alias("near"))
        spread = labels.join(near, "id", "left").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = stored(spread.join(jump, "comp", "left").select("id", F.least("comp", "far").alias("comp"), "was"), "labels")
        labels = new.select("id", "comp")
        if not new.where("comp != was").limit(1).count():
            return labels


def _placed(docs: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """near_components, with each row's digest of its set (d1, d2) and first_class: of the classes
    of its component, its own is the one with the least key."""
    rows = stored(_signed(docs, key, text, words, num, den), "rows")
    first = {c: F.first(c).alias(c) for c in ("n", "prefix", "bits", "lows")}
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min(key).alias("rep"), *first.values())
    full = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    names = stored(rows.select(key, "n", "d1", "d2"), "row_names")
    removed(rows)

    # a shuffled row is a shingle and one number: the class, and whether the shingle is among its first ones
    least = F.ceil(F.col("n") * num / den)
    mark = lambda place: 2 * F.col("id") + (place <= F.col("n") - least).cast("long")
    tokens = full.select(F.inline(F.transform("prefix", lambda t, k: F.struct(t.alias("tok"), mark(k).alias("mark")))))
    counts = tokens.groupBy("tok").count().where("count > 1").select("tok")
    known = stored(tokens.join(counts, "tok").select("tok", F.shiftright("mark", 1).alias("id"), (F.col("mark") % 2 == 1).alias("first")), "known")
    enough = F.greatest(F.lit(1), F.floor(least / SHARED))
    often = known.groupBy("id").agg(F.count("*").alias("of"))
    ids = stored(often.join(full.select("id", "n"), "id").where(F.col("of") >= enough).select("id"), "ids")
    shared = stored(known.where("first").join(ids, "id", "left_semi").select("tok", "id"), "shared")
    involved = stored(full.drop("prefix").join(ids, "id", "left_semi"), "involved")
    classes = stored(full.select("id", "d1", "d2", "rep"), "class_names")
    removed(full, known)
    sets = stored(_sets(docs, involved, key, text, words), "sets")
    removed(involved)

    cells = stored(_cells(sets), "cells")
    local = stored(_local_links(sets, cells, num, den), "local")
    comps = _far_links(shared, sets, cells, components(local, "id", "root"), num, den)
    removed(sets, shared)

    placed = classes.select("d1", "d2", "id", "rep").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = placed.join(comps.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "id")).alias("least"))
    first_class = F.coalesce(F.col("least.id") == F.col("id"), F.lit(True)).alias("first_class")
    named = placed.join(least, "comp", "left").select("d1", "d2", F.col("id").alias("class_id"), F.coalesce("least.rep", "rep").alias("component_id"), first_class)
    out = names.join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key))
    return out.select(key, F.col("n").alias("n_shingles"), own.alias("component_id"), "class_id", "d1", "d2", "first_class")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the least key reachable by links, its own
    included), class_id (equal for equal shingle sets).

    Two texts link if den * intersection >= num * union of their sets of shingles of words words (a
    shorter text's only shingle is all of it). No link is lost. Null texts and texts without words
    have no shingles and link with nothing: their component is their own key. Rows with a null key
    take part; their component is null only if no linked row has a key. Repeated rows are one class.
    Empty tables give no rows. Other columns of docs are left out.
    """
    return _placed(docs, key, text, words, num, den).select(key, "n_shingles", "component_id", "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked texts: one of the least key (a null key comes after
    all others). Rows without words all stay. Keys need not be unique: rows of one key, or of none,
    are told apart by their sets of shingles."""
    found = _placed(docs, key, text, words, num, den)
    stays = (F.col("n_shingles") == 0) | (F.col("first_class") & F.col(key).eqNullSafe(F.col("component_id")))
    names = stored(found.select(F.col(key).alias("_key"), "n_shingles", F.col("d1").alias("_e1"), F.col("d2").alias("_e2"), stays.alias("stays")), "names")
    gone = names.where("not stays").select("_key").distinct()
    repeated = names.groupBy("_key").count().where("count > 1").select("_key")
    same = lambda of: docs[key].eqNullSafe(of["_key"])
    left = docs.join(gone.hint("shuffle_hash"), same(gone), "left_anti")
    if not repeated.limit(1).count():
        return left

    def make():
        shingles = Shingler(words).many

        def run(texts: list[str | None]) -> dict:
            sets = shingles(texts)
            both = [digest(s) for s in sets]
            return {"_n": [len(s) for s in sets], "_d1": [a for a, _ in both], "_d2": [b for _, b in both]}

        return run

    again = stored(with_columns(docs.join(repeated, same(repeated), "left_semi"), text, make, "_n long, _d1 long, _d2 long"), "again")
    kept = names.where("stays and n_shingles > 0").join(repeated.withColumnRenamed("_key", "_own"), F.col("_key").eqNullSafe(F.col("_own")), "left_semi")
    of = again[key].eqNullSafe(kept["_key"]) & (F.col("_d1") == F.col("_e1")) & (F.col("_d2") == F.col("_e2"))
    one = again.where("_n > 0").join(kept, of, "left_semi").dropDuplicates([key, "_d1", "_d2"])
    parts = one.unionByName(again.where("_n = 0")).select(*docs.columns)
    return left.join(repeated, same(repeated), "left_anti").unionByName(parts)
