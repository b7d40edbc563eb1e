"""Secret scans through nested encodings.

Each text starts a worklist with itself as the only layer.  A layer is scanned, then unwrapped in every way that
applies: URL escapes, Unicode escapes, two-byte characters, base64, and compressed streams inside any of these.  Whatever comes out and
was not seen before in this text joins the worklist, until nothing new appears; so cycles end, and the depth has
no limit.  Every layer knows for each of its characters the span of the original text it came from, and a secret
found in a layer is reported at the original span of its characters.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = (8, 16, 32)
_NAMES = ("passw", "secret", "token", "api_key", "apikey")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}"
                      r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_UNICODE = re.compile(r"(?:\\u\{|\\u|\\U|\\x|%u|&#[xX])([0-9A-Fa-f]+)[};]?|&#([0-9]+);")
#: Runs over several lines, of any width and with any indent.
_BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+")
_WORD = re.compile(r"[A-Za-z0-9+/_-]+")
#: ASCII text in two-byte characters, either byte first; the zero bytes stand in the layer as characters.
_WIDE = re.compile(r"(?:[\t\n\r -~]\0){8,}|(?:\0[\t\n\r -~]){8,}")
_SEPARATOR = re.compile(r"[+/_-]")
_STANDARD = str.maketrans("-_", "+/")
#: Decompressed content is scanned in pieces of this many bytes, each with the end of the one before it.
PIECE_BYTES, OVERLAP = 8 << 20, 2 << 20
_INPUT_BYTES = 64 << 10
#: Characters by which a stream behind a separator is known.
_HEAD_CHARS = 128
_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


@dataclass
class Layer:
    """``start[i]:end[i]`` is the original span of character i; ``fresh`` counts decoded characters before each."""
    text: str
    start: np.ndarray
    end: np.ndarray
    fresh: np.ndarray | None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def touches(self, a: int, b: int) -> bool:
        return self.fresh is None or self.fresh[b] > self.fresh[a]


def find(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of one layer, unordered."""
    out = []
    folded = text.lower()
    if any(name in folded for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST[0]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST[1]]
    # every long hex run lies in a run of the wider base64 alphabet
    for a, b in _runs(text) if runs is None else runs:
        if b - a >= LEAST[2]:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST[2]]
    return out


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def opened(data: bytes):
    """A decompressor for the stream that begins here, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _member(machine, data: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    """Content of one stream; returns the bytes behind it, or None if it breaks off."""
    is_zlib, is_zstd = hasattr(machine, "copy"), not hasattr(machine, "copy") and not hasattr(machine, "needs_input")
    while True:
        try:
            if is_zstd:     # knows no bound of its output, but a few bytes of input hold few blocks
                out, data = machine.decompress(data[:256]), data[256:]
            else:
                out = machine.decompress(data, PIECE_BYTES)
                data = machine.unconsumed_tail if is_zlib else b""
        except _BROKEN:
            return None
        if out:
            yield out
        if machine.eof:
            return machine.unused_data + data
        if not data and (is_zstd or not out):
            data = next(more, b"")
            if not data:
                return None


class Content:
    """Content of the streams that ``pieces`` hold one after another, in bounded pieces; ``whole`` if they are all."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.whole = pieces, True

    def __iter__(self) -> Iterator[bytes]:
        more = (piece[k:k + _INPUT_BYTES] for piece in self.pieces for k in range(0, len(piece), _INPUT_BYTES))
        data, members = next(more, b""), 0
        while True:
            while len(data := data.lstrip(b"\0") if members else data) < 6 and (piece := next(more, b"")):
                data += piece
            machine = opened(data)
            if machine is None:
                break
            data = yield from _member(machine, data, more)
            if data is None:
                self.whole = False
                return
            members += 1
        if members and data:     # scanned as part of the layer itself
            self.whole = False


def _pieces(content: Iterable[bytes]) -> Iterator[bytes]:
    held, size = [], 0
    for part in content:
        held.append(part)
        size += len(part)
        if size >= PIECE_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _readable(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _decoded(raw: str) -> bytes | None:
    if len(raw) % 4 == 1:
        raw = raw[:-1]
    try:
        return base64.b64decode(raw.translate(_STANDARD) + "=" * (-len(raw) % 4))
    except (binascii.Error, ValueError):
        return None


def _promising(text: str) -> bool:
    """Whether unprintable text can hold a secret or a further layer."""
    folded = text.lower()
    return ("%" in text or "\\" in text or "&#" in text or "\n" in text or "AKIA" in text
            or any(name in folded for name in _NAMES) or _RUN.search(text) is not None
            or "\0" in text and _WIDE.search(text) is not None)


def _begins_stream(raw: str) -> bool:
    """Whether these first characters of a base64 run open a compressed stream that does not break off at once."""
    if opened(_decoded(raw[:8]) or b"") is None:
        return False
    data = _decoded(raw[:_HEAD_CHARS])
    try:
        opened(data).decompress(data)
    except _BROKEN:
        return False
    return True


class Unwrapper:
    """The layers of one text."""

    def __init__(self, text: str, most: int | None):
        self.most, self.cut, self.layers = most, 0, 0
        self.runs = _runs(text)
        self.base = find(text, self.runs)
        self.found = set(self.base)
        self.seen: set = set()
        self.work: list[Layer] = []
        self._expand(text, None)
        while self.work:
            layer = self.work.pop()
            self.layers += 1
            for a, kind, b in find(layer.text):
                if layer.touches(a, b):
                    start, end = layer.origin(a, b)
                    self.found.add((start, kind, end))
            self._expand(layer.text, layer)

    def _push(self, text: str, start: np.ndarray, end: np.ndarray, fresh: np.ndarray | None) -> None:
        key = (hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(start[0]), int(end[-1])) if text else None
        if key and key not in self.seen:
            self.seen.add(key)
            self.work.append(Layer(text, start, end, fresh))

    def _expand(self, text: str, layer: Layer | None) -> None:
        if "%" in text:
            self._escapes(text, layer, _URL, self._url)
        if "\\" in text or "&#" in text or "%u" in text:
            self._escapes(text, layer, _UNICODE, self._unicode)
        if "\0" in text:
            for m in _WIDE.finditer(text):
                start, end = self._inside(layer, m.start(), m.end())
                self._push(m[0].replace("\0", ""), start[0::2], end[1::2], None)
        runs = self.runs if layer is None else _runs(text)
        done = 0
        blocks = [m.span() for m in _BLOCK.finditer(text) if m.end() - m.start() >= 16] if "\n" in text else []
        read = [span for span in blocks if self._lines(text, layer, *span)]
        for a, b in runs:
            while done < len(read) and read[done][1] <= a:
                done += 1
            if done < len(read) and read[done][0] <= a:
                continue
            if not self._base64(text, layer, np.arange(a, b), text[a:b]):
                for m in re.finditer(r"[A-Za-z0-9]{16,}", text[a:b]):
                    if m.end() - m.start() < b - a:
                        self._base64(text, layer, np.arange(a + m.start(), a + m.end()), m[0])
                self._behind_prefix(text, layer, a, b)

    def _behind_prefix(self, text: str, layer: Layer | None, a: int, b: int) -> None:
        """Read a run again without what stands before its code.

        Bytes that start at any separator are among those of the first separator at the same place of a group of
        four, so each place is tried once; a compressed stream must begin where the bytes do, so all separators
        are looked at for one.
        """
        tried = {0}
        for m in _SEPARATOR.finditer(text, a, b - 16):
            at = m.end()
            fits = (at - a) % 4 not in tried
            if fits or _begins_stream(text[at:min(b, at + _HEAD_CHARS)]):
                tried.add((at - a) % 4)
                self._base64(text, layer, np.arange(at, b), text[at:b])

    def _lines(self, text: str, layer: Layer | None, a: int, b: int) -> bool:
        """Read a block of lines as one run, from its first line to its end; true if that gives text or a stream.

        Otherwise it may begin at a later line or end before the last one: each place of a line in a group of four
        characters is tried once, and every line where a stream begins.
        """
        words = list(_WORD.finditer(text, a, b))
        raw = "".join(m[0] for m in words)
        if len(raw) < 16 or layer is not None and not layer.touches(a, b):
            return False
        places = np.concatenate([np.arange(m.start(), m.end()) for m in words])
        if self._base64(text, layer, places, raw):
            return True
        tried, at = {0}, 0
        last = len(raw) - len(words[-1][0])
        if last >= 16:
            self._base64(text, layer, places[:last], raw[:last])
        for m in words:
            fits = at % 4 not in tried
            tried.add(at % 4)
            if at and (fits or opened(_decoded(raw[at:at + 8]) or b"")):
                self._base64(text, layer, places[at:], raw[at:])
                if last - at >= 16:
                    self._base64(text, layer, places[at:last], raw[at:last])
            at += len(m[0])
        return False

    def _inside(self, layer: Layer | None, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if layer is None:
            places = np.arange(a, b, dtype=np.int64)
            return places, places + 1
        return layer.start[a:b], layer.end[a:b]

    def _base64(self, text: str, layer: Layer | None, places: np.ndarray, raw: str) -> bool:
        if len(raw) < 16 or layer is not None and not layer.touches(int(places[0]), int(places[-1]) + 1):
            return False
        data = _decoded(raw)
        if data is None:
            return False
        if layer is None:
            start, end = places, places + 1
        else:
            start, end = layer.start[places], layer.end[places]
        # byte i takes bits 8i to 8i + 8, hence characters 8i // 6 to (8i + 7) // 6
        at = np.arange(len(data), dtype=np.int64) * 8
        return self._bytes(data, start[at // 6], end[(at + 7) // 6])

    def _bytes(self, data: bytes, start: np.ndarray, end: np.ndarray) -> bool:
        """Take in bytes as a layer; true if they are printable text or whole compressed streams."""
        if opened(data) is not None and self._streams(data, int(start.min()), int(end.max())):
            return True
        text = _readable(data)
        printable = text is not None and text.replace("\n", " ").replace("\r", " ").replace("\t", " ").isprintable()
        if text is None:
            text = data.decode("latin-1")
        if not printable and not _promising(text):
            return False
        if len(text) == len(data):
            self._push(text, start, end, None)
        else:
            widths = _utf8_widths(data)
            heads = np.concatenate(([0], np.cumsum(widths)[:-1]))
            self._push(text, start[heads], end[heads + widths - 1], None)
        return printable

    def _streams(self, data: bytes, low: int, high: int) -> bool:
        """Take in what compressed streams hold, and streams directly inside them; true if all could be read."""
        source, chain, whole = (lambda: iter((data,))), set(), True
        while True:
            content, digest = Content(source()), hashlib.blake2b(digest_size=16)
            n, size, head, carry = 0, 0, b"", ""
            for piece in _pieces(content):
                if self.most is not None and size + len(piece) > self.most:
                    self.cut += 1
                    piece = piece[:self.most - size]
                    content.pieces = None
                digest.update(piece)
                size += len(piece)
                text = _readable(piece) if not n else None
                text = carry + (piece.decode("latin-1") if text is None else text)
                self._push(text, np.broadcast_to(np.int64(low), len(text)), np.broadcast_to(np.int64(high), len(text)), None)
                head = head or piece
                n += 1
                if content.pieces is None:
                    break
                # any number of spaces means the same to a rule
                carry = re.sub("  +", "  ", text)[-OVERLAP:] if len(piece) >= PIECE_BYTES else ""
            whole = whole and content.whole and n > 0
            key = digest.digest()
            if not n or key in chain or opened(head) is None:
                return whole
            chain.add(key)
            source = (lambda held=head: iter((held,))) if n == 1 else (lambda outer=source: iter(Content(outer())))

    def _escapes(self, text: str, layer: Layer | None, pattern: re.Pattern, decode) -> None:
        """A layer that is this one with every escape replaced."""
        pieces, starts, ends, fresh, at = [], [], [], [], 0
        for m in pattern.finditer(text):
            new, lows, highs = decode(m[0], m.start(), layer)
            if new is None:
                continue
            s, e = self._inside(layer, at, m.start())
            pieces += [text[at:m.start()], new]
            starts += [s, lows]
            ends += [e, highs]
            fresh += [np.zeros(len(s), dtype=np.int64), np.ones(len(lows), dtype=np.int64)]
            at = m.end()
        if not pieces:
            return
        s, e = self._inside(layer, at, len(text))
        fresh.append(np.zeros(len(s), dtype=np.int64))
        marks = np.concatenate(([0], np.cumsum(np.concatenate(fresh))))
        self._push("".join(pieces) + text[at:], np.concatenate([*starts, s]), np.concatenate([*ends, e]), marks)

    def _url(self, run: str, at: int, layer: Layer | None):
        data = bytes.fromhex(run.replace("%", ""))
        start, end = self._inside(layer, at, at + len(run))
        low, high = start[0::3], end[2::3]
        if self._looks_squeezed(data):
            self._bytes(data, low, high)
        text = _decode_lossy(data)
        if len(text) == len(data):
            return text, low, high
        widths = _utf8_widths(data)
        heads = np.concatenate(([0], np.cumsum(widths)[:-1]))
        return text, low[heads], high[heads + widths - 1]

    def _unicode(self, run: str, at: int, layer: Layer | None):
        chars, lows, highs = [], [], []
        start, end = self._inside(layer, at, at + len(run))
        for m in _ONE_UNICODE.finditer(run):
            code = int(m[1], 16) if m[1] else int(m[2])
            if chars and 0xDC00 <= code < 0xE000 and 0xD800 <= chars[-1] < 0xDC00:
                chars[-1] = 0x10000 + ((chars[-1] - 0xD800) << 10) + code - 0xDC00
                highs[-1] = end[m.end() - 1]
                continue
            chars.append(code)
            lows.append(start[m.start()])
            highs.append(end[m.end() - 1])
        codes = [c if c < 0x110000 and not 0xD800 <= c < 0xE000 else 0xFFFD for c in chars]
        low, high = np.array(lows, dtype=np.int64), np.array(highs, dtype=np.int64)
        if codes and max(codes) < 256 and self._looks_squeezed(bytes(codes)):
            self._bytes(bytes(codes), low, high)
        return "".join(map(chr, codes)), low, high

    def _looks_squeezed(self, data: bytes) -> bool:
        return opened(data) is not None


def _utf8_widths(data: bytes) -> np.ndarray:
    """Bytes of each character of valid UTF-8."""
    heads = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    return np.diff(np.append(heads, len(data)))


def _decode_lossy(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def spans_text(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def _scan(most: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                one = Unwrapper(text or "", most)
                kinds = [kind for _, kind, _ in one.base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(spans_text(one.base).encode()).hexdigest(),
                             spans_text(one.found), len(one.found), one.layers, one.cut))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_layers", "n_cut"])
    return run


def scan_secrets(docs: DataFrame, max_stream_bytes: int | None = None) -> DataFrame:
    """The secrets of every row of ``docs`` (doc_id, text; more columns are ignored), one row each.

    n_assign, n_access, n_hex and base_sha256 speak of the text as given; ``spans`` lists those and what the decoded
    layers add, as ``kind:start:end`` in code points of the original text, by start, kind and end.  A secret of a
    decoded layer is listed if at least one of its characters was decoded; one inside a compressed stream has the
    span of the whole stream.  Bytes out of base64 are scanned whatever they are, as UTF-8 or else Latin-1, and eight or more
    ASCII characters of two bytes each (UTF-16) as what they spell; runs join over line ends and indents, and are read
    again from behind a prefix that ends in one of ``+/_-``.  A null text is empty; a row with a null or repeated ``doc_id`` is scanned like any
    other.  Compressed streams are read to their end, with those that follow, in pieces of 8 MB that overlap by 2 MB,
    so an encoded run of more than 2 MB can fall apart at the edge of a piece; its parts are scanned.  A number for
    ``max_stream_bytes`` bounds the content of each stream, and ``n_cut`` counts those that are longer.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(_scan(max_stream_bytes), (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, "
        "n_layers long, n_cut long"))
