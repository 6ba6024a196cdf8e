"""Hard negatives for contrastive training, scored by the method of the Four Russians.

Vectors are whole numbers, and candidates are kept as bit planes: a byte holds one bit of eight dimensions. For an
anchor and eight dimensions a table has the sum of the anchor's entries for each of the 256 bytes, so a candidate's inner
product is one lookup for every byte, shifted by its plane and added up. Scores are exact and of all pairs of
an anchor and a row, in blocks: a shard of rows meets a block of anchors in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearweave.llm.common import removed, slices, stored

# Fixed value: an entry c becomes floor(SCALE * c).
SCALE = 256
#: floor(SCALE * c) is held within this, so that scores of up to 16,384 dimensions fit a long.
LARGEST = 1 << 24
#: Rows of a shard and anchors of a block; small inputs are cut into up to FEWEST shards of SMALL rows or more.
SHARD, BLOCK, SMALL, FEWEST = 32_768, 4_096, 1_024, 24
#: Rows scored at a time, so that tables and scores stay in a core's cache.
AT_ONCE = 8_192


def bit_planes(x: np.ndarray, planes: int) -> np.ndarray:
    """x (rows of whole numbers, two's complement in planes bits) as bytes: plane, group of eight dimensions, row."""
    n, d = x.shape
    bits = (x[:, None, :] >> np.arange(planes)[:, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed.transpose(1, 2, 0)) if n else np.zeros((planes, -(-d // 8), 0), np.uint8)


def subset_tables(anchor: np.ndarray) -> np.ndarray:
    """Sums of the anchor's entries for each byte, for each group of eight dimensions."""
    padded = np.zeros(-(-len(anchor) // 8) * 8, np.int64)
    padded[: len(anchor)] = anchor
    tables = np.zeros((len(padded) // 8, 256), np.int64)
    for k, column in enumerate(padded.reshape(-1, 8).T):
        # a table of k entries and the same with the next one added
        tables[:, 1 << k : 2 << k] = tables[:, : 1 << k] + column[:, None]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products of the anchor of tables with all rows of planes."""
    out = np.zeros(planes.shape[2], np.int64)
    for k, plane in enumerate(planes):
        part = tables[0][plane[0]]
        for table, codes in zip(tables[1:], plane[1:]):
            part += table[codes]
        # the last plane is the sign's
        out += -(part << k) if k == len(planes) - 1 else part << k
    return out


def taking_part(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, x, d, label) of the rows with an id, a label, and a vector of finite entries; x has whole numbers."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x"), F.col(label).cast("long").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & (F.size("x") > 0))
    held = F.transform("x", lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * SCALE)))
    return rows.select("id", "label", F.transform(held, lambda v: F.floor(v).cast("int")).alias("x"), F.size("x").alias("d"))


def _packed(rows: DataFrame) -> DataFrame:
    """rows with their bit planes in place of x; a row number for dealing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            d, planes = batch.column("d").to_numpy(), batch.column("planes").to_numpy()
            bits: list[bytes | None] = [None] * len(d)
            for size, n in {*zip(d.tolist(), planes.tolist())}:
                at = np.flatnonzero((d == size) & (planes == n))
                x = batch.column("x").take(pa.array(at)).flatten().to_numpy().reshape(len(at), size)
                for k, row in zip(at, bit_planes(x, n).transpose(2, 0, 1)):
                    bits[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "d", "shard")), pa.array(bits, pa.binary())], names=["id", "label", "d", "shard", "bits"])

    return rows.mapInArrow(run, "id long, label long, d int, shard int, bits binary")


def _best(order: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of order, ties by smaller id."""
    at = np.arange(len(order))
    if len(order) > k:
        at = np.flatnonzero(order >= np.partition(order, len(order) - k)[len(order) - k])
    return at[np.lexsort([ids[at], -order[at]])[:k]]


def _scored(some: pa.Table, asking: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor: its place in asking, and the ids, labels and scores of the shard's rows."""
    if not len(some) or not len(asking):
        return
    ids, labels = some["id"].to_numpy(), some["label"].to_numpy()
    groups = -(-some["d"][0].as_py() // 8)
    bits = np.frombuffer(b"".join(some["bits"].to_pylist()), np.uint8).reshape(len(some), -1, groups)
    parts = [np.ascontiguousarray(bits[a : a + AT_ONCE].transpose(1, 2, 0)) for a in range(0, len(bits), AT_ONCE)]
    for k, x in enumerate(asking["x"].to_pylist()):
        tables = subset_tables(np.array(x, np.int64))
        yield k, ids, labels, np.concatenate([scores(tables, p) for p in parts])


def mined(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Column | None = None,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, out_of: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where anchors (a condition on id) holds. An anchor's positives are the first rows of its label by
    inner product (ties by smaller id); its negatives for a positive are the first rows of other labels whose score times out_of lies
    between low and high times the positive's. Fewer are returned only where there are fewer. Both are looked for among all rows.

    Rows without an id or a label, or whose vector is null, empty or holds null or non-finite entries take no part. relabel, an
    expression on id and label, gives the label to use. Rows with an anchor's id are the anchor itself; of several of them the one of the least
    label and vector asks. Other repeated rows count each. Vectors are scored among those of as many entries. Entries beyond
    LARGEST / SCALE count as that. Empty tables give no rows.
    """
    rows = taking_part(vectors, key, vector, label)
    rows = rows.withColumn("label", relabel.cast("long")) if relabel is not None else rows
    # bits of the largest entry, and its sign's
    widest = F.max(F.ceil(F.log2(F.array_max(F.transform("x", lambda v: F.abs(v))) + 1)))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), (F.coalesce(widest, F.lit(0)) + 1).cast("int").alias("planes"), F.count_if(anchors).alias("asking"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD), F.least(F.lit(FEWEST), F.ceil(F.col("n") / SMALL)))
    sizes = sizes.where("asking > 0").select("d", "planes", shards.cast("int").alias("shards"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("blocks"))
    sizes = stored(sizes, "sizes")  # a row for each length of vectors
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    candidates = stored(_packed(rows.join(sizes, "d").withColumn("shard", deal("shards", F.monotonically_increasing_id())).select("id", "label", "d", "shard", "planes", "x")), "planes")
    asking = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "x", "d")).alias("a")).select("id", "a.*")
    asking = stored(asking.join(sizes, "d").select("id", "label", "x", "d", "shards", deal("blocks", "id").alias("block")), "anchors")

    spread = candidates.join(sizes.select("d", "blocks"), "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("d", "shard", "block", "id", "label", "bits").groupBy("d", "shard", "block")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    keys = ("d", "shard", "block")

    def near(some: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        names, own = ask["id"].to_pylist(), ask["label"].to_pylist()
        for k, ids, labels, s in _scored(some, ask):
            at = np.flatnonzero((labels == own[k]) & (ids != names[k]))
            best = at[_best(s[at], ids[at], positives)]
            out += zip([names[k]] * len(best), ids[best].tolist(), s[best].tolist())
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"anchor": pa.array(a, pa.int64()), "positive": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    found = spread.cogroup(asking.select("d", every, "block", "id", "label", "x").groupBy(*keys)).applyInArrow(near, "anchor long, positive long, score long")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    each = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive", "score"))).alias("positives"))
    asked = stored(asking.join(each.withColumnRenamed("anchor", "id"), "id"), "positives")

    def hard(some: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        names, own, wanted = ask["id"].to_pylist(), ask["label"].to_pylist(), ask["positives"].to_pylist()
        for k, ids, labels, s in _scored(some, ask):
            for p in wanted[k]:
                # whole bounds of the band, by division that rounds up and down
                least, most = -(-low * p["score"] // out_of), high * p["score"] // out_of
                at = np.flatnonzero((s >= least) & (s <= most) & (labels != own[k]) & (ids != names[k]))
                best = at[_best(s[at], ids[at], negatives)]
                m = len(best)
                out += zip([names[k]] * m, [p["place"]] * m, [p["positive"]] * m, [p["score"]] * m, ids[best].tolist(), s[best].tolist())
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"), columns, kinds)})

    # the place tells repeated positives apart
    band = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    schema = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    result = spread.cogroup(asked.select("d", every, "block", "id", "label", "x", "positives").groupBy(*keys)).applyInArrow(hard, schema)
    result = result.withColumn("rank", F.row_number().over(band)).where(F.col("rank") <= negatives)
    result = stored(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    removed(candidates, asking, asked, sizes)
    return result
