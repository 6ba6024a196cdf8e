"""Token ids in binary files, coded by Simple-8b words.

A file holds the ids of documents one after the other, cut into blocks of BLOCK ids. A block is a row of 64-bit words:
the upper four bits of a word select how many ids it holds and in how many bits each; ids that fit no selector are
escaped to a table at the file's end. The footer has where each block's words begin, and each document's key and number
of ids, so that any ids can be read without what stands before them, and whole blocks are decoded by array operations.

Little-endian layout: MAGIC, words (uint64), footer, trailer. Footer: first word of each block, and the end (uint64); escaped ids
(uint64); for each document its number of ids (uint64), key (int64) and whether it has one (uint8). Trailer: offset of the
footer, numbers of blocks, escaped ids, documents and ids (uint64 each), MAGIC.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearweave.llm.common import Known, gathered, new_path, slices, stored
from hearweave.llm.token_counts import loaded
from hearweave.llm.warc_zip import Ranges, opened

MAGIC = b"hwsimp8b"
# Ids in a word and bits of each, by selector; a run of zeros takes none. Selector 0 is an escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240)
BITS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0)
#: Ids of a block; a file is closed when it has this many ids; ids coded at a time, and decoded.
BLOCK, FILE_IDS, WAITING, AT_ONCE = 4_096, 1 << 23, 1 << 20, 1 << 20
#: Rows and bytes of text that are encoded at a time: the known parts are indexed anew each time.
ENCODED_ROWS, ENCODED_BYTES = 10_000, 16 << 20
#: Most tasks that read files.
MOST_TASKS = 20_000
#: Files that manifest rows are summed over before the sums are summed.
GROUP = 1_024


# Words


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of ids (uint64), where each block's begin, and the escaped ids; ids are a whole number of blocks but for the last.

    A word takes as many of the next ids as fit; places behind a block's end count as zeros.
    """
    n = len(ids)
    blocks, wide = -(-n // BLOCK), BLOCK + max(COUNTS)
    padded = np.zeros((blocks, wide), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        padded[whole, : n - whole * BLOCK] = ids[whole * BLOCK :]
    # compared in as few bytes as they need
    narrow = padded.astype(np.min_scalar_type(ids.max(initial=0)))
    best = np.zeros((blocks, BLOCK), np.uint8)
    # from the selector that holds least, so that those that hold more overwrite it; where one fits nowhere, none of the next does
    for s in range(14, -1, -1):
        s = s or 15
        fits = narrow < 1 << BITS[s]
        span = 1
        while span < COUNTS[s]:
            step = min(span, COUNTS[s] - span)
            fits = fits[:, : fits.shape[1] - step] & fits[:, step:]
            span += step
        fits = fits[:, :BLOCK]
        if not fits.any():
            break
        np.copyto(best, np.uint8(s), where=fits)
    # all blocks take their words side by side
    counts = np.array(COUNTS)[best].ravel()
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = n - (blocks - 1) * BLOCK
    at, base, taken = np.zeros(blocks, np.int64), np.arange(blocks) * BLOCK, np.zeros(blocks * BLOCK, bool)
    left = np.arange(blocks)
    while len(left):
        place = base[left] + at[left]
        taken[place] = True
        at[left] += counts[place]
        left = left[at[left] < ends[left]]
    starts = np.flatnonzero(taken)
    first = np.concatenate([[0], np.cumsum(np.bincount(starts // BLOCK, minlength=blocks))]).astype(np.uint64)
    selectors, flat = best.ravel()[starts], padded.ravel()
    at = starts // BLOCK * wide + starts % BLOCK
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        own = np.flatnonzero(selectors == s)
        for k in range(COUNTS[s] if len(own) else 0):
            words[own] |= flat[at[own] + k] << np.uint64(k * BITS[s])
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, first, flat[at[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, places behind a block's end too, and where each word's ids begin among them."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s] if len(own) else 0):
            out[at[own] + k] = (words[own] >> np.uint64(k * BITS[s])) & mask
    own = np.flatnonzero(selectors == 0)
    out[at[own]] = escapes[words[own].astype(np.int64)]
    return out, at


# Files


class Writer:
    """Writes one file to an open stream, block by block; only the footer is kept."""

    def __init__(self, out):
        self.out, self.words, self.ids = out, 0, 0
        self.firsts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.escaped = 0
        self.waiting: list[np.ndarray] = []
        self.waits = 0
        self.sizes: list[int] = []
        self.keys: list[int | None] = []
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.sizes.append(len(ids))
        self.keys.append(key)
        self.waiting.append(ids)
        self.waits += len(ids)
        self.ids += len(ids)
        if self.waits >= WAITING:
            self._flush(self.waits // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        words, first, escapes = encode(ids[:n].astype(np.uint64))
        escape = words >> np.uint64(60) == 0
        words[escape] += np.uint64(self.escaped)
        self.escaped += len(escapes)
        self.escapes.append(escapes)
        self.firsts.append(first[:-1] + np.uint64(self.words))
        self.words += len(words)
        self.out.write(words.astype("<u8").tobytes())
        self.waiting, self.waits = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.waits)
        first = np.concatenate([*self.firsts, np.array([self.words], np.uint64)])
        escapes = np.concatenate(self.escapes)
        known = np.array([k is not None for k in self.keys], np.uint8)
        self.out.write(first.astype("<u8").tobytes() + escapes.astype("<u8").tobytes() + np.array(self.sizes, "<u8").tobytes())
        self.out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes() + known.tobytes())
        self.out.write(struct.pack("<5Q", len(MAGIC) + 8 * self.words, len(first) - 1, len(escapes), len(self.sizes), self.ids) + MAGIC)


class Reader:
    """Reads the footer of a file, and then the words of the ids that are asked for."""

    def __init__(self, file: Ranges):
        self.file = file
        tail = file.at(file.size - 48, 48)
        if tail[40:] != MAGIC or file.at(0, len(MAGIC)) != MAGIC:
            raise ValueError("no file of token ids")
        foot, blocks, escapes, docs, self.ids = struct.unpack("<5Q", tail[:40])
        raw, at = file.at(foot, file.size - 48 - foot), 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(raw[at - n * np.dtype(kind).itemsize : at], kind)

        self.first, self.escapes, self.sizes = take(blocks + 1, "<u8"), take(escapes, "<u8"), take(docs, "<u8").astype(np.int64)
        keys, known = take(docs, "<i8"), take(docs, "u1")
        self.keys = [k if has else None for k, has in zip(keys.tolist(), known.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, decoded from their blocks only."""
        if start >= end:
            return np.zeros(0, np.uint64)
        a, b = start // BLOCK, -(-end // BLOCK)
        low, high = int(self.first[a]), int(self.first[b])
        words = np.frombuffer(self.file.at(len(MAGIC) + 8 * low, 8 * (high - low)), "<u8")
        ids, at = decode(words, self.escapes)
        # only what stands in the block: the words of each begin anew
        begins = at[(self.first[a : b + 1] - self.first[a]).astype(np.int64)]
        whole = [ids[x : x + min(BLOCK, self.ids - k * BLOCK)] for k, x in zip(range(a, b), begins)]
        return np.concatenate(whole)[start - a * BLOCK : end - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def pieces(self) -> Iterator[tuple[int, bool, np.ndarray]]:
        """All documents in order, in pieces of AT_ONCE ids at most: number, whether it ends here, ids."""
        doc = 0
        for a in range(0, self.ids, AT_ONCE):
            ids, at = self.read(a, min(a + AT_ONCE, self.ids)), a
            while doc < len(self.sizes) and at < a + len(ids):
                end = min(int(self.starts[doc + 1]), a + len(ids))
                yield doc, end == self.starts[doc + 1], ids[at - a : end - a]
                doc, at = doc + int(end == self.starts[doc + 1]), end


# Tokens

# Letters, then ASCII marks, and more of both behind single line ends: each run, with the space before it, is a match of the GPT-2 pattern
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"
_PLAIN = rf"^[{_LETTERS}]+[{_MARKS}]*(\n[{_LETTERS}]+[{_MARKS}]*)*$"
# bytes of such parts and of the spaces before them, and two of them that stand in different matches
_BYTES, _ACROSS = rb"[A-Za-z\xc3-\xc9\x80-\xbf!-/:-@\[-`{-~\n ]*", rb"[A-Za-z\x80-\xbf][!-/:-@\[-`{-~\n ]|[!-/:-@\[-`{-~][\n ]|\n[A-Za-z\xc3-\xc9]"
#: Plain parts that the model takes at once, as one text.
TOGETHER = 64


class Ids:
    """The tokenizer library's ids of texts, each different part between single spaces encoded once for a while.

    For byte-level BPE files with the GPT-2 pattern: their pre-tokens end before a space that follows no white space. Plain parts go
    straight to the library's model, many at once: no token reaches from one match of the pattern into the next, as is checked of all
    tokens. All other parts go to its whole encoder. Beyond bound parts all are dropped.
    """

    def __init__(self, path: str, bound: int = 1_500_000):
        from tokenizers import Tokenizer

        self.library, self.bound = loaded(path), bound
        self.model = Tokenizer(self.library.model)
        # the printable stand-in of each byte, as byte-level files write it
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        more = iter(range(256, 512))
        self.printed = np.array([b if b in printed else next(more) for b in range(256)], "<u4")
        back = {chr(x): b for b, x in enumerate(self.printed)}
        tokens = self.library.get_vocab(with_added_tokens=False)
        space = chr(self.printed[32])
        self.leads = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.leads[[k for x, k in tokens.items() if x[:1] == space]] = True
        made = (bytes(map(back.__getitem__, x)) for x in tokens if all(c in back for c in x))
        self.apart = not any(re.fullmatch(_BYTES, x) and re.search(_ACROSS, x) for x in made)
        self.parts = Known(self._parts)

    def _plain(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts, each after a space: a part's first id is that of a token with the space."""
        if not len(names):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, offsets, data = pc.binary_join_element_wise(" ", names, "").buffers()
        letters = self.printed[np.frombuffer(data, np.uint8)[: np.frombuffer(offsets, np.int32)[len(names)]]]
        cuts = [*np.flatnonzero(letters == self.printed[32])[::TOGETHER].tolist(), len(letters)]
        text = letters.tobytes().decode("utf-32-le")
        made = self.model.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x.ids for x in made), np.uint32)
        return flat, np.diff(np.append(np.flatnonzero(self.leads[flat]), len(flat)))

    def _parts(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each after a space."""
        plain = pc.match_substring_regex(names, _PLAIN) if self.apart else pa.array(np.zeros(len(names), bool))
        others = names.filter(pc.invert(plain)).to_pylist()
        made = [x.ids for x in self.library.encode_batch_fast([" " + x for x in others], add_special_tokens=False)]
        flat, sizes = self._plain(names.filter(plain))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(made), np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, made), np.int64, len(made))])
        # back to the order of names
        chosen = plain.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(chosen), np.flatnonzero(~chosen)]))
        return gathered(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        cut = pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x85\p{Z}] ")
        parts = pc.split_pattern(texts, " ")
        whole = pc.or_(cut, pc.equal(pc.utf8_length(texts), 0)).to_numpy(zero_copy_only=False)
        # the first part has no space before it
        heads = pc.if_else(pa.array(whole), texts, pc.list_element(parts, 0)).to_pylist()
        head_ids = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(heads, add_special_tokens=False)]
        counts = pc.list_value_length(parts).to_numpy()
        # parts that are asked for: neither first ones nor those of texts that are encoded whole
        asked = np.ones(counts.sum(), bool)
        asked[np.cumsum(counts) - counts] = False
        if whole.any():
            asked[np.repeat(whole, counts)] = False
        coded = parts.flatten().filter(pa.array(asked)).dictionary_encode()
        self.parts.bounded(self.bound - len(coded.dictionary))
        flat, own = self.parts.ids(self.parts.rows(coded.dictionary)[coded.indices.to_numpy()])
        at = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(np.where(whole, 0, counts - 1))])]
        return [np.concatenate([h, flat[a:b]]) for h, a, b in zip(head_ids, at[:-1], at[1:])]


@lru_cache(maxsize=1)
def worker_ids(path: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(path)


# On Spark


def write_files(docs: DataFrame, folder: str, make: Callable[[], Callable[[pa.Array], list[np.ndarray]]], end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of text, each document's followed by end, by ascending key to files in folder; returns (part, file, path, docs,
    ids) of finished tasks. make() runs once in a task and gives the function from texts to ids.

    Null keys come first. Rows of one key stand by a hash of their text; equal rows in any order, dealt to any number of tasks. A
    task that runs again writes under other names, so nothing half-written is read.
    """
    ties = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("k"))
    ordered = ties.repartitionByRange("key", "h", "k").sortWithinPartitions("key", "h", "k").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, place = opened(folder)
        where.create_dir(place, recursive=True)
        context, tokens = TaskContext.get(), make()
        out = path = writer = None
        n = 0

        def close() -> pa.RecordBatch:
            writer.close()
            out.close()
            values = {"part": context.partitionId(), "file": n, "path": path, "docs": len(writer.sizes), "ids": writer.ids}
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values.values(), kinds)], names=list(values))

        for batch in slices(batches, "text", ENCODED_ROWS, ENCODED_BYTES):
            keys = batch.column("key").to_pylist()
            for key_, ids in zip(keys, tokens(batch.column("text"))):
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{n}-{uuid.uuid4().hex[:8]}.s8b"
                    path, out = f"{folder}/{name}", where.open_output_stream(f"{place}/{name}")
                    writer = Writer(out)
                writer.add(key_, np.append(ids, ids.dtype.type(end)))
                if writer.ids >= FILE_IDS:
                    yield close()
                    writer, n = None, n + 1
        if writer is not None:
            yield close()

    return ordered.mapInArrow(run, "part int, file int, path string, docs long, ids long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """manifest with start, the ids of all files before: sums within groups of GROUP tasks, and over the sums."""
    files = manifest.withColumn("g", F.floor(F.col("part") / GROUP))
    groups = files.groupBy("g").agg(F.sum("ids").alias("n"))
    before = groups.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    inside = F.sum("ids").over(Window.partitionBy("g").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("_in", F.coalesce(inside, F.lit(0).cast("long"))).join(before.select("g", "base"), "g").withColumn("start", F.col("base") + F.col("_in")).drop("g", "_in", "base")


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files in manifest (see with_starts): key, start, n_tokens, ids_crc32 of its ids as little-endian unsigned
    32-bit numbers. Files are read and decoded in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, place = opened(r["path"])
                with where.open_input_file(place) as file:
                    reader = Reader(Ranges(file))
                    sums, crc = [], 0
                    for _, ends, ids in reader.pieces():
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        if ends:
                            sums.append(crc)
                            crc = 0
                starts, sizes = reader.starts[:-1] + r["start"], reader.sizes
                for a in range(0, len(sums), 10_000):
                    part = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.keys[part], pa.int64()), pa.array(starts[part]), pa.array(sizes[part]), pa.array(sums[part], pa.int64())],
                        names=["key", "start", "n_tokens", "ids_crc32"],
                    )

    tasks = min(max(1, manifest.count()), MOST_TASKS)
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def archived(docs: DataFrame, tokenizer_path: str, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of docs to files in the shared folder and reads them back: key, start, n_tokens, ids_crc32.

    Ids are those of the tokenizers library without added special tokens. Null and empty texts have the end id alone; texts of any
    length are whole; repeated rows are documents of their own; an empty table gives no files and no rows. Columns
    besides key and text are not read.
    """
    manifest = stored(write_files(docs, new_path(docs.sparkSession, "tokens"), lambda: worker_ids(tokenizer_path), end, key, text), "manifest")
    return read_files(with_starts(manifest)).withColumnRenamed("key", key)
