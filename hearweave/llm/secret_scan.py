"""Secret scans that unwrap encodings.

A text is the first layer of a worklist. Each layer is scanned; URL escapes, Unicode escapes,
base64 runs (over line ends too, and glued to other letters) and compressed data in it give further layers, until no new layer appears (a layer seen
before at the same places is not taken again; an equal one at other places is). Every layer knows
where in the text each of its characters came from, so that findings become spans of the text.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import re
import sys
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.common import with_columns

KINDS = ("assign", "access", "hex")
#: Inflated data is scanned in pieces of about so many characters, so that a small text can't fill a worker.
PIECE = 4 << 20
#: Compressed bytes that are opened, and inflated bytes that are held, at a time.
CHUNK, OPENED = 16 << 10, 1 << 20

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over line ends.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_NOT_64 = re.compile(r"[^A-Za-z0-9+/_-]+")
#: Decoded bytes that are UTF-8 (others are lone surrogates) and enough for a secret.
_UTF8 = re.compile(r"[^\ud800-\udfff]{12,}")
#: How gzip, zstd and zlib begin in base64.
_PACKED = re.compile(r"(?=H4sI|KLUv/[Q-Za-f]|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r]))")

#: Where a text can be cut, after the match: no secret, escape or base64 run stands across.
_CUT = re.compile(r"""[^A-Za-z0-9+/_.=\-"':\x20\t\r\n%\\&#;{}]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])|\n(?=\r?\n)""")

_AS_HEX = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_AS_64 = bytes(98 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_-") else 32 for c in range(256))

Span = tuple[int, int, int]


def scan(text: str, data: bytes | None = None) -> list[Span]:
    """(start, kind number, end) of each base secret in text itself, in order.

    Matches are leftmost and do not overlap within a kind; those that are too short are dropped
    after matching.
    """
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    found: list[Span] = []
    low = data.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in data.translate(_AS_HEX):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the place of each of its characters in the first text.

    places: starts and ends there of its characters, as two arrays; one (start, end) if all have the same;
    None for the first text itself.
    """

    def __init__(self, text: str, places: tuple[np.ndarray, np.ndarray] | tuple[int, int] | None):
        self.text, self.places = text, places

    def key(self) -> tuple:
        """Equal for layers that give the same spans."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        if self.places is None or isinstance(self.places[0], int):
            return digest.digest(), self.places
        for x in self.places:
            digest.update(x)
        return digest.digest(), len(self.text)

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.places is None:
            return start, end
        starts, ends = self.places
        if isinstance(starts, int):
            return starts, ends
        return int(starts[start]), int(ends[start:end].max())

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray] | tuple[int, int]:
        """Starts and ends of characters made from those from first to last, which are in order."""
        if self.places is None:
            return first, last + 1
        starts, ends = self.places
        return (starts, ends) if isinstance(starts, int) else (starts[first], ends[last])

    def inner(self) -> Iterator["Layer"]:
        """The layers one decoding further."""
        text, data = self.text, self.text.encode("utf-8", "surrogatepass")
        if "%" in text and (layer := self._escapes(_URL, _from_url)):
            yield layer
        if ("\\" in text or "&#" in text) and (layer := self._escapes(_UNICODE, _from_unicode)):
            yield layer
        if "\n" in text:  # before its lines, whose findings may be parts of the whole run's
            for m in _WRAPPED.finditer(text):
                if m.end() - m.start() >= 16 and len(run := _NOT_64.sub("", m[0])) >= 16:
                    yield from self._run(run, [k for k in range(m.start(), m.end()) if not _NOT_64.match(text, k)], m.end())
        if b"b" * 16 in data.translate(_AS_64):
            for m in _BASE64.finditer(text):
                run = m[0].rstrip("=")
                yield from self._run(run, range(m.start(), m.start() + len(run)), m.end())

    def _run(self, run: str, where: Sequence[int], end: int) -> Iterator["Layer"]:
        """The layers in a base64 run. where: the place of each of its characters; end: that of its padding's end.

        Other characters may be glued to what is encoded, so that it may begin at any of them.
        """
        run = run.replace("-", "+").replace("_", "/")
        phases = [bytearray(_from_base64(run[k:])) for k in range(4)]
        opened = 0
        for m in _PACKED.finditer(run):
            k = m.start()
            if k < opened or (found := _inflated(memoryview(phases[k % 4])[k // 4 * 3 :])) is None:
                continue
            pieces, used = found
            opened = min(len(run), k - (used * -4 // 3))
            span = self.span(where[k], end if len(run) - opened < 2 else where[opened - 1] + 1)
            for piece in pieces:
                yield Layer(piece, span)
            phases[k % 4][k // 4 * 3 : k // 4 * 3 + used] = b"\xff" * used  # what is opened is no text
        place = np.asarray(where)
        for k, data in enumerate(phases):
            body, last, at = data.decode("utf-8", "surrogateescape"), 0, 0
            for m in _UTF8.finditer(body):
                at += len(body[last : m.start()].encode("utf-8", "surrogateescape"))
                last = m.start()
                if _worth(m[0]):
                    yield self._within(place, k, at, m[0])

    def _escapes(self, pattern: re.Pattern, decode) -> "Layer | None":
        """This layer with each match of pattern replaced by what it stands for: decode gives the characters,
        and for each the part of the match that it comes from."""
        pieces: list[str] = []
        firsts: list[np.ndarray] = []
        lasts: list[np.ndarray] = []
        at, changed = 0, False
        for m in pattern.finditer(self.text):
            if (made := decode(m)) is None:
                continue
            body, starts, ends = made
            pieces += [self.text[at : m.start()], body]
            plain = np.arange(at, m.start())
            firsts += [plain, m.start() + np.asarray(starts, np.int64)]
            lasts += [plain, m.start() + np.asarray(ends, np.int64) - 1]
            at, changed = m.end(), True
        if not changed:
            return None
        pieces.append(self.text[at:])
        plain = np.arange(at, len(self.text))
        return Layer("".join(pieces), self.spans(np.concatenate([*firsts, plain]), np.concatenate([*lasts, plain])))

    def _within(self, where: np.ndarray, phase: int, at: int, body: str) -> "Layer":
        """body, whose bytes are those from the at-th on of a base64 run from phase on, four characters for three."""
        sizes = np.fromiter((len(c.encode()) for c in body), np.int64, len(body)) if not body.isascii() else np.ones(len(body), np.int64)
        until = at + np.cumsum(sizes)
        first, last = phase + (until - sizes) * 4 // 3, phase - (until * -4 // 3) - 1
        return Layer(body, self.spans(where[first], where[last]))


def _worth(text: str) -> bool:
    """Whether a layer has a secret or further layers."""
    return bool(scan(text) or _BASE64.search(text) or _URL.search(text) or _UNICODE.search(text) or _WRAPPED.search(text))


Made = tuple[str, list[int], list[int]]


def _from_url(m: re.Match) -> Made | None:
    """The characters of a run of escapes, three letters for each byte; bytes that are no UTF-8 stay escaped."""
    data = bytes.fromhex(m[0].replace("%", ""))
    body, starts, ends, at, any_ = [], [], [], 0, False
    for c in data.decode("utf-8", "surrogateescape"):
        if "\ud800" <= c <= "\udfff":
            body.append(m[0][at : at + 3])
            starts += range(at, at + 3)
            ends += range(at + 1, at + 4)
            at += 3
            continue
        n = 3 * len(c.encode())
        body.append(c)
        starts.append(at)
        ends.append(at + n)
        at += n
        any_ = True
    return ("".join(body), starts, ends) if any_ else None


def _from_unicode(m: re.Match) -> Made | None:
    code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
    return (chr(code), [0], [m.end() - m.start()]) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _from_base64(run: str) -> bytes:
    """The bytes of a run of the standard letters; a last letter that makes no byte is left out."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _inflated(data: memoryview) -> tuple[Iterator[str], int] | None:
    """The text compressed in data, in pieces, and of how many bytes; None unless gzip, zlib or zstd of UTF-8.

    It is opened twice, first to see whether all of it is such text.
    """
    ends = [0]
    try:
        for _ in _decoded(data, ends):
            pass
    except (zlib.error, zstandard.ZstdError, EOFError, UnicodeDecodeError):
        return None
    return _pieces(_decoded(data, ends)), ends[-1]


def _opened(data: memoryview, ends: list[int]) -> Iterator[bytes]:
    """The bytes compressed in data, a few at a time: of all members of a gzip file and all zstd frames,
    whose ends are added to ends.

    What follows the last one is left out. Of a gzip or zstd that ends too early, what is there.
    """
    zstd = data[:4] == b"\x28\xb5\x2f\xfd"
    magic = data[:4] if zstd else data[:2]
    size = CHUNK // 256 if zstd else CHUNK  # 128 KB may stand in four bytes of a zstd
    at = 0
    while at == 0 or (magic[:1] != b"\x78" and data[at : at + len(magic)] == magic):
        member = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj() if zstd else zlib.decompressobj(47)
        first, held = at == 0, b""
        while not member.eof:
            if not held:
                held = data[at : at + size]
                at += len(held)
                if not held:
                    if magic[:1] == b"\x78":
                        raise EOFError
                    ends.append(at)
                    return
            try:
                out = member.decompress(held) if zstd else member.decompress(held, OPENED)
            except (zlib.error, zstandard.ZstdError):
                if first:
                    raise
                return
            held = b"" if zstd else member.unconsumed_tail
            if out:
                yield out
        at -= len(member.unused_data)
        ends.append(at)


def _decoded(data: memoryview, ends: list[int]) -> Iterator[str]:
    reader = codecs.getincrementaldecoder("utf-8")()
    for part in _opened(data, ends):
        yield reader.decode(part)


def _pieces(parts: Iterator[str]) -> Iterator[str]:
    """The parts joined to pieces of PIECE characters or somewhat more, cut where _CUT says; a text
    that can't be cut stays whole."""
    held: list[str] = []
    size, least = 0, PIECE
    for part in parts:
        held.append(part)
        size += len(part)
        if size < least:
            continue
        text = "".join(held)
        start = max(0, size - (PIECE >> 2))
        last = max((m.end() for m in _CUT.finditer(text, start)), default=0)
        if not last and size > PIECE:
            last = max((m.end() for m in _CUT.finditer(text)), default=0)
        if last:
            yield text[:last]
        held = [text[last:]]
        size = len(held[0])
        least = PIECE if last else 2 * size
    if size:
        yield "".join(held)


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans of text, and all spans including those from inner layers, each in order."""
    if not text:
        return [], []
    base = scan(text)
    found: list[Span] = []
    wide: list[list[tuple[int, int]]] = [[] for _ in KINDS]  # of each kind those in no other, in order

    def add(start: int, kind: int, end: int) -> None:
        spans = wide[kind]
        at = bisect.bisect_right(spans, (start, sys.maxsize))
        if at and spans[at - 1][1] >= end:
            return
        found.append((start, kind, end))
        at = last = bisect.bisect_left(spans, (start, 0))
        while last < len(spans) and spans[last][1] <= end:
            last += 1
        spans[at:last] = [(start, end)]

    for span in base:
        add(*span)
    seen, work = set(), [Layer(text, None).inner()]
    while work:  # depth first, so that few pieces of inflated data are held
        if (inner := next(work[-1], None)) is None:
            work.pop()
            continue
        if (key := inner.key()) in seen:
            continue
        seen.add(key)
        work.append(inner.inner())
        for start, kind, end in scan(inner.text):
            a, b = inner.span(start, end)
            add(a, kind, b)
    return base, sorted(found)


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and all_spans: arrays of struct(start, kind, end), code points, end exclusive.

    Rows stay where they are. Null or empty text: no spans. An empty table stays empty. Texts and all their inner layers
    are scanned whole, inflated data in pieces. Repeated rows are scanned each. Other columns are kept;
    those named as the results are replaced.
    """

    def make():
        def run(texts: list[str | None]) -> dict:
            found = [find_secrets(x) for x in texts]
            struct = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]
            return {"base_spans": [struct(b) for b, _ in found], "all_spans": [struct(a) for _, a in found]}

        return run

    kind = "array<struct<start:int,kind:string,end:int>>"
    return with_columns(docs, text, make, f"base_spans {kind}, all_spans {kind}")


def _joined(column: str):
    return F.array_join(
        F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def reported(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex (base), base_sha256, spans (all)."""
    found = scan_documents(docs.select(key, "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
        _joined("all_spans").alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mask (spans that touch become one)."""

    def make():
        def run(texts: list[str | None]) -> dict:
            return {"text": [mask_spans(x, find_secrets(x)[1], mask) for x in texts]}

        return run

    return with_columns(docs, "text", make, "text string").select(*docs.columns)


def mask_spans(text: str | None, spans: list[Span], mask: str) -> str | None:
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mask]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])
