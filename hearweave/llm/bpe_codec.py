"""Byte-level BPE as a monoid: encode halves, join neighbours, decode up the tree.

A token list is the BPE encoding of its bytes if and only if each two neighbours alone encode to
themselves. So joining two encodings needs work only at the boundary: a window of tokens around it
is encoded anew, and grows until the tokens at its rims fit their outer neighbours; everything
outside is then proved stable.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.common import Known, gathered, with_columns

#: Bytes that are merged directly; longer pieces are halved.
LEAF = 6
#: Encoded parts that a worker keeps, and pieces of them, in tables of KNOWN_BYTES at most; beyond these bounds all are dropped.
CACHE = 1_000_000
#: Leaves and windows, and pairs of neighbours, that a worker keeps: each of two generations.
LEAVES = 200_000
#: Ids that are decoded at once; longer lists are halved.
HALF = 1 << 18

#: Whitespace right before a space: then text can't be cut in front of that space.
_SPACES = re.compile(r"\s ")
# all white space, as a set of Arrow's patterns
_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def parts_of(text: str) -> list[str] | None:
    """text cut in front of its single spaces, which are left out from the second part on. None if
    a space follows other whitespace.

    No match of a GPT-style pattern reaches over such a cut: it needs white space in its middle.
    """
    return None if _SPACES.search(text) else text.split(" ")


class Cache(dict):
    """A dict that makes missing values. At its bound the older of two generations goes."""

    def __init__(self, make: Callable, bound: int = 200_000):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        return value


class BpeCodec:
    """Encodes pieces by ranks, as greedy merging of the lowest rank does, by tree reduction."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, bound: int = CACHE):
        self.ranks, self.bound = ranks, bound
        self.bytes = {v: k for k, v in ranks.items()}
        self.tokens = pa.array([self.bytes.get(k) for k in range(max(self.bytes, default=0) + 1)], pa.binary())
        self.find = regex.compile(pattern).findall
        self.leaves, self.pairs = Cache(self.merged, LEAVES), Cache(self._pair, LEAVES)
        self.pieces, self.rest = Known(self._pieces), Known(self._parts)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merges neighbours of the lowest rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        parts = [data[k : k + 1] for k in range(len(data))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < 1 << 30:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 30)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 30)
        return tuple(ranks[x] for x in parts)

    def _pair(self, pair: tuple[int, int]) -> tuple[int, ...]:
        """The encoding of two tokens' bytes: the pair itself, if they fit."""
        return self.merged(self.bytes[pair[0]] + self.bytes[pair[1]])

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both, from the encodings of each."""
        if not left or not right:
            return left + right
        window = self.pairs[pair := (left[-1], right[0])]
        if window == pair:
            return left + right
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            if reach > 1:
                data = b"".join(map(self.bytes.__getitem__, left[a:] + right[:b]))
                window = self.leaves[data] if len(data) <= 2 * LEAF else self.merged(data)
            if (not a or self.pairs[pair := (left[a - 1], window[0])] == pair) and (b == len(right) or self.pairs[pair := (window[-1], right[b])] == pair):
                return left[:a] + window + right[b:]
            reach *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if len(data) <= LEAF:
            return self.leaves[data]
        middle = len(data) // 2
        left, right = data[:middle], data[middle:]
        if len(right) <= LEAF:
            return self.join(self.leaves[left], self.leaves[right])
        return self.join(self.encode(left), self.encode(right))

    def _pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        made = [self.encode(x) for x in names.cast(pa.binary()).to_pylist()]
        return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _piece_rows(self, found: list[str]) -> np.ndarray:
        coded = pa.array(found, pa.string()).dictionary_encode()
        return self.pieces.rows(coded.dictionary)[coded.indices.to_numpy()]

    def _parts(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts after their spaces: those of their pieces, between which nothing merges, one after the other.

        Parts that end in no white space are searched as one text; a piece with a space in front begins a part.
        """
        alone = pc.match_substring_regex(names, rf"^$|[{_SPACE}]$")
        found = self.find(" " + " ".join(names.filter(pc.invert(alone)).to_pylist())) if not pc.all(alone).as_py() else []
        begins = [k for k, x in enumerate(found) if x[0] == " "]
        for x in names.filter(alone).to_pylist():
            begins.append(len(found))
            found += self.find(" " + x)
        flat, sizes = self.pieces.ids(self._piece_rows(found))
        sizes = np.add.reduceat(sizes, begins)
        # back to the order of names
        last = alone.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)]))
        return gathered(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each begins (and the last ends). Null is empty."""
        self.pieces.bounded(self.bound)
        self.rest.bounded(self.bound)
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(parts).to_numpy()
        # texts that are searched whole, and the first parts of the others, which have no space before them
        whole = pc.match_substring_regex(texts, rf"[{_SPACE}] ").to_numpy(zero_copy_only=False)
        asked = np.ones(counts.sum(), bool)
        asked[np.cumsum(counts) - counts] = False
        if whole.any():
            asked[np.repeat(whole, counts)] = False
        heads = pc.if_else(pa.array(whole), texts, pc.list_element(parts, 0)) if len(texts) else texts
        found = [self.find(x) for x in heads.to_pylist()]
        head, head_sizes = self.pieces.ids(self._piece_rows(list(chain.from_iterable(found))))
        head_ends = np.concatenate([[0], np.cumsum(head_sizes)])[np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])]
        coded = parts.flatten().filter(pa.array(asked)).dictionary_encode()
        rest, sizes = self.rest.ids(self.rest.rows(coded.dictionary)[coded.indices.to_numpy()])
        rest_ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.where(whole, 0, counts - 1))])]
        # a text's first part before its others
        starts = np.stack([head_ends[:-1], len(head) + rest_ends[:-1]], axis=1).ravel()
        values = gathered(np.concatenate([head, rest]), starts, np.stack([np.diff(head_ends), np.diff(rest_ends)], axis=1).ravel())
        return values.astype(np.int32), head_ends + rest_ends

    def encode_text(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return bytes(memoryview(self.decoded(pa.array(ids, pa.int32()))[0]))

    def decoded(self, ids: pa.Array) -> tuple[bytes | pa.Buffer, np.ndarray]:
        """The bytes of ids and where each id's begin (and the last's end), concatenated up the tree of halves."""
        if len(ids) <= HALF:
            taken = self.tokens.take(ids)
            _, offsets, data = taken.buffers()
            at = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
            return (data or pa.py_buffer(b""))[int(at[0]) : int(at[-1])], (at - at[0]).astype(np.int64)
        middle = len(ids) // 2
        (a, x), (b, y) = self.decoded(ids[:middle]), self.decoded(ids[middle:])
        return b"".join((memoryview(a), memoryview(b))), np.concatenate([x, x[-1] + y[1:]])


@lru_cache(maxsize=1)
def codec_of(ranks_path: str, pattern: str) -> BpeCodec:
    """The codec of a worker, with its caches: later tasks of the same worker go on with them, until tasks of other
    operators let it go."""
    return BpeCodec(read_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the token ids of text in the column to (array of int).

    The rows stay where they are: nothing is shuffled, and a worker keeps at most CACHE parts.
    Null or empty text: no ids. An empty table stays empty. Repeated rows each have their ids; texts of
    any length are encoded whole. Other columns are kept; one named as the result is replaced.
    ranks_path must be readable on every executor.
    """

    def make():
        codec = codec_of(ranks_path, pattern)
        return lambda texts: {to: _lists(*codec.encode_texts(texts))}

    return with_columns(docs, text, make, f"`{to}` array<int>", arrow=True, keeps=codec_of)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the bytes of ids in the column to. Null or no ids: no bytes. The pattern is not used; with
    that of the encoder a worker needs one codec only."""

    def make():
        codec = codec_of(ranks_path, pattern)
        return lambda lists: {to: _decoded(codec, lists)}

    return with_columns(docs, ids, make, f"`{to}` binary", arrow=True, keeps=codec_of)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """encode_documents and decode_documents of its ids, in one pass of each worker."""

    def make():
        codec = codec_of(ranks_path, pattern)

        def run(texts: pa.Array) -> dict:
            lists = _lists(*codec.encode_texts(texts))
            return {ids: lists, decoded: _decoded(codec, lists)}

        return run

    return with_columns(docs, text, make, f"`{ids}` array<int>, `{decoded}` binary", arrow=True, keeps=codec_of)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _decoded(codec: BpeCodec, lists: pa.Array) -> pa.Array:
    """The bytes of each list of ids."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    data, at = codec.decoded(lists.flatten())
    offsets = at[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes the ids again, and returns per row: key, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(docs.select(key, text), ranks_path, pattern, text, "ids", "decoded")
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
