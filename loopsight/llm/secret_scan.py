"""Secret scans by a recursive decoding worklist."""

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import free, text_batches, trimmed

KINDS = ("assign", "access", "hex")
#: Fixed values of the contract.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_FORM = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on over line breaks, also such as are written \\n; each line but the last ends with it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
#: Where compressed data begin within others, as bytes and as Latin-1 characters.
_PACKED = r"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]"
_PACKED_BYTES, _PACKED_CHARS = re.compile(_PACKED.encode(), re.DOTALL), re.compile(_PACKED)
_WIDE = re.compile(r"[^\x00-\xff]")
_BYTE_ESCAPES = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[nrt\\'\"]")

#: Bytes of compressed data that are inflated and scanned at a time, and how many of them the next piece begins with again.
PIECE, OVERLAP = 8 << 20, 256 << 10
#: Compressed layers within compressed layers, and bytes inflated of one document. Escapes and base64 shrink with every layer and
#: so end by themselves; only inflation grows. What goes on beyond is counted as cut, and its place is a span to redact.
DEPTH, INFLATE_BYTES = 64, 4 << 30


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of each base match, in code points, leftmost and non-overlapping per kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


class _Layer:
    """A text and where each of its characters comes from in the whole text.

    marks are (start here, start there, end there, step): from `start here` on, each character
    stands for the same span (step 0) or for one character each (step 1).
    """

    def __init__(self, text: str, marks: list[tuple[int, int, int, int]], depth: int):
        self.text, self.marks, self.depth = text, marks, depth
        self.starts = [m[0] for m in marks]

    def key(self) -> bytes:
        """Stands for the text and where it lies: two layers of one key have the same matches at the same spans."""
        return hashlib.sha256(f"{self.marks} {self.text}".encode("utf-8", "surrogatepass")).digest()

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        """Span in the whole text, and whether any of it had been decoded."""
        if end <= start:
            end = start + 1
        i, j = (bisect.bisect_right(self.starts, x) - 1 for x in (start, end - 1))
        low, high = self.marks[i], self.marks[j]
        first = low[1] + (start - low[0]) * low[3]
        last = high[1] + (end - high[0]) if high[3] else high[2]
        return first, last, any(not m[3] for m in self.marks[i : j + 1])


def _percent(token: str) -> list[tuple[str, int]]:
    """Characters and how many characters of token each took."""
    text = bytes.fromhex(token.replace("%", "")).decode("utf-8", "replace")
    if "\ufffd" in text:
        text = bytes.fromhex(token.replace("%", "")).decode("latin-1")
        return [(c, 3) for c in text]
    return [(c, 3 * len(c.encode())) for c in text]


def _unicode(token: str) -> list[tuple[str, int]]:
    if token[1] == "x":
        return [(chr(int(token[2:], 16)), 4)]
    if token[1] == "U" or token[2] == "{":
        code = int(token[2:].strip("{}"), 16)
        return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", len(token))]
    units = bytes.fromhex(token.replace("\\u", ""))
    text = units.decode("utf-16-be", "replace")
    if len(text.encode("utf-16-be")) != len(units):
        return [("\ufffd", 6)] * (len(units) // 2)
    return [(c, 6 * (len(c.encode("utf-16-be")) // 2)) for c in text]


def _unescaped(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every escape of one sort decoded in its place."""
    out, marks, at, here = [], [], 0, 0

    def mark(first: int, last: int, step: int) -> None:
        if step or not marks or marks[-1][1:] != (first, last, 0):
            marks.append((here, first, last, step))

    def copied(end: int) -> None:
        nonlocal at, here
        while at < end:  # over the marks that the piece runs through
            i = bisect.bisect_right(layer.starts, at) - 1
            start, there, last, step = layer.marks[i]
            upto = min(end, layer.starts[i + 1] if i + 1 < len(layer.starts) else end)
            mark(there + (at - start) * step, last, step)
            out.append(layer.text[at:upto])
            here += upto - at
            at = upto

    for m in pattern.finditer(layer.text):
        copied(m.start())
        for char, took in decode(m[0]):
            first, last, _ = layer.span(at, at + took)
            mark(first, last, 0)
            out.append(char)
            at += took
            here += 1
        at = m.end()
    if not marks or not out:
        return None
    copied(len(layer.text))
    return _Layer("".join(out), marks, layer.depth)


def _latin(token: str) -> list[tuple[str, int]]:
    """URL escapes as bytes, one character each; in forms + is a space."""
    if token == "+":
        return [(" ", 1)]
    return [(c, 3) for c in bytes.fromhex(token.replace("%", "")).decode("latin-1")]


def _byte(token: str) -> list[tuple[str, int]]:
    simple = {"n": "\n", "r": "\r", "t": "\t"}
    return [(chr(int(token[2:], 16)) if token[1] in "xu" else simple.get(token[1], token[1]), len(token))]


def _unpacker(data: bytes):
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _unpacked(unpack, data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What one member holds, as it comes, and how far data has been read; ends at the member's end or at damage."""
    whole = isinstance(unpack, bz2.BZ2Decompressor | lzma.LZMADecompressor)
    rest = b""
    try:
        while not unpack.eof:
            if not rest and (not whole or unpack.needs_input):
                if at >= len(data):
                    return
                rest = data[at : at + 4096]
                at += len(rest)
            got = unpack.decompress(rest, 1 << 16)
            rest = b"" if whole else unpack.unconsumed_tail
            if unpack.eof:
                at -= len(unpack.unused_data)
            yield got, at
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def _inflated(data: bytes) -> Iterator[tuple[bytes, int]]:
    """What data begin with if that's gzip, zlib, bzip2 or xz, in pieces of up to PIECE bytes, and how many bytes have been read.

    Members that follow each other are one; of a damaged one, what comes before the damage. A piece
    begins with the last OVERLAP bytes of the one before.
    """
    held, fresh, at = bytearray(), False, 0
    while at < len(data) and (unpack := _unpacker(data[at : at + 8])) is not None:
        begin = at
        for got, at in _unpacked(unpack, data, begin):
            held += got
            fresh = fresh or bool(got)
            if len(held) >= PIECE:
                yield bytes(held), at
                del held[:-OVERLAP]
                fresh = False
        if not unpack.eof or at == begin:
            break
    if fresh:
        yield bytes(held), at


def _raw_deflated(data: bytes) -> bytes | None:
    """The text that data is if they are deflated without a header, to their very end; up to PIECE bytes."""
    try:
        unpack = zlib.decompressobj(-15)
        out = unpack.decompress(data, PIECE)
        return out if unpack.eof and not unpack.unused_data and len(out) >= 8 and out.decode("utf-8") else None
    except (zlib.error, UnicodeDecodeError):
        return None


def _texts(data: bytes) -> str:
    """data as text; bytes that aren't UTF-8 as Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _decoded64(token: str) -> bytes:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _unfolded(token: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A run without its line breaks, and (start there, start, end) of each of its lines."""
    lines, at, size, parts = [], 0, 0, []
    for m in [*_BREAK.finditer(token), None]:
        end = m.start() if m else len(token)
        lines.append((size, at, end))
        parts.append(token[at:end])
        size += end - at
        at = m.end() if m else end
    return "".join(parts), lines


def _line_marks(data: bytes, text: str, lines: list[tuple[int, int, int]], skipped: int, span) -> list[tuple[int, int, int, int]]:
    """Marks of decoded text: each character stands for the line, or the two lines, that it was decoded from."""
    borders = {0: (lines[0][1], lines[0][2])}
    for (_, first, _), (size, start, end) in zip(lines, lines[1:]):
        bits = max(0, size - skipped) * 6
        if bits % 8:
            borders[bits // 8] = (first, end)
        borders[-(-bits // 8)] = (start, end)
    marks, utf8 = [], len(text) != len(data)
    here = at = 0
    for place, (start, end) in sorted(borders.items()):
        place = min(place, len(data))
        here += len(data[at:place].decode("utf-8", "ignore")) if utf8 else place - at
        at = place
        if marks and marks[-1][0] == here:
            marks.pop()
        marks.append((here, *span(start, end), 0))
    return marks


def scan_text(text: str | None) -> tuple[list, list, int, list]:
    """(base, all, layers, cut): base matches, all matches with decoded ones, layers read, spans of layers that weren't read to their end.

    Every layer that URL escapes, Unicode escapes, base64 (also over line breaks, and after other
    characters of its alphabet) or compressed data (in base64 or escaped bytes) yield is scanned and
    unwrapped in turn. A layer already seen at the same place ends its branch, so cycles end; the
    same content at another place is read again, as its matches have other spans.
    """
    text = text or ""
    base = find_secrets(text)
    spans = set(base)
    if "%" not in text and "\\" not in text and not _BASE64.search(text) and not _WRAPPED.search(text):
        return sorted(base, key=_order), sorted(spans, key=_order), 1, []
    work, cut, size = [_Layer(text, [(0, 0, len(text), 1)], 0)], set(), 0
    seen = {work[0].key()}

    def inflated(data: bytes, first: int, last: int, depth: int, found: list) -> int:
        """Adds the layers that data begin with; how many of its bytes they take, 0 if it isn't compressed."""
        nonlocal size
        used = 0
        for out, used in _inflated(data):
            size += len(out)
            if size > INFLATE_BYTES or depth >= DEPTH:
                cut.add((first, last))
                break
            found.append((out, first, last, depth + 1))
        return used

    while work:
        layer = work.pop()
        if len(layer.marks) > 1 or layer.marks[0][3] == 0:
            for start, end, kind in find_secrets(layer.text):
                first, last, changed = layer.span(start, end)
                if changed:
                    spans.add((first, last, kind))
        inner = []
        if "%" in layer.text:
            inner.append(_unescaped(layer, _PERCENT, _percent))
        if "\\" in layer.text:
            inner.append(_unescaped(layer, _UNICODE, _unicode))
        packed: list[tuple[bytes, int, int, int]] = []  # bytes, where they come from, compressed layers around them
        for sign, pattern, decode in (("%", _PERCENT, _latin), ("+", _FORM, _latin), ("\\", _BYTE_ESCAPES, _byte)):
            raw = _unescaped(layer, pattern, decode) if sign in layer.text and (sign != "+" or "%" in layer.text) else None
            for m in _PACKED_CHARS.finditer(raw.text) if raw else ():
                rest = raw.text[m.start() :]
                rest = rest[: stop.start()] if (stop := _WIDE.search(rest)) else rest
                data = rest.encode("latin-1")
                used = next((n for _, n in _inflated(data)), 0)
                if used:
                    first, last, _ = raw.span(m.start(), m.start() + used)
                    packed.append((data, first, last, layer.depth))
        for m in _BASE64.finditer(layer.text):
            for skip in range(4):  # a token may follow others of its characters
                data = _decoded64(m[0][skip:])
                first, last, _ = layer.span(m.start() + skip, m.end())
                inner.append(_Layer(_texts(data), [(0, first, last, 0)], layer.depth))
                packed.append((data, first, last, layer.depth))
        for m in _WRAPPED.finditer(layer.text):
            token, lines = _unfolded(m[0])
            if len(token) < 16:
                continue
            span = lambda start, end: layer.span(m.start() + start, m.start() + end)[:2]
            for skip in range(4):
                data = _decoded64(token[skip:])
                within = _texts(data)
                inner.append(_Layer(within, _line_marks(data, within, lines, skip, span), layer.depth))
                packed.append((data, *span(0, len(m[0])), layer.depth))
        while packed:  # compressed layers may lie in each other
            data, first, last, depth = packed.pop()
            starts = {m.start() for m in _PACKED_BYTES.finditer(data)}
            starts |= {0} if _unpacker(data[:8]) else set()
            key = hashlib.sha256(b"%d %d " % (first, last) + data).digest()
            if key in seen:
                continue
            found: list[tuple[bytes, int, int, int]] = []
            done = 0
            for start in sorted(starts):
                if start >= done:
                    done = max(done, start + inflated(data[start:], first, last, depth, found))
            if not found and (out := _raw_deflated(data)):
                found.append((out, first, last, depth + 1))
            if found:
                seen.add(key)
            inner += [_Layer(_texts(x[0]), [(0, first, last, 0)], x[3]) for x in found]
            packed += found
        for x in inner:
            if x is not None:
                key = x.key()
                if key not in seen:
                    seen.add(key)
                    work.append(x)
    return sorted(base, key=_order), sorted(spans, key=_order), len(seen), sorted(cut)


def _order(span: tuple[int, int, int]) -> tuple[int, int, int]:
    return span[0], span[2], span[1]


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def cleaned(text: str) -> str:
    """text without its secrets and without what couldn't be read to its end."""
    _, spans, _, cut = scan_text(text)
    return redacted(text, sorted([*spans, *((a, b, -1) for a, b in cut)], key=_order))


def redacted(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """text with each run of overlapping spans replaced by mark."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


_FOUND = pa.struct(
    [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()),
     ("spans", pa.string()), ("layers", pa.int64()), ("cut", pa.int64())]
)


def secret_spans(text):
    """A struct column: counts of base matches by kind, base and all spans, layers read, and spans of layers not read to their end.

    Null and empty texts have no spans and one layer; equal texts have equal results. Spans read kind:start:end, by start, then
    kind; offsets are code points of the whole text. A match in a decoded layer is reported at the
    span of the whole text that it was decoded from.
    """

    text_batches()

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base string, spans string, layers long, cut long")
    def of(column: pa.Array) -> pa.Array:
        out = []
        for value in column.to_pylist():
            base, spans, layers, cut = scan_text(value)
            n = [sum(1 for x in base if x[2] == k) for k in range(3)]
            row = (n[0], n[1], n[2], _joined(base), _joined(spans), layers, len(cut))
            out.append(dict(zip(_FOUND.names, row, strict=True)))
        return pa.array(out, type=_FOUND)

    return of(text)


def redact_secrets(documents: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """documents with secrets in their texts replaced by [SECRET], and n_chars set to the new length.

    What holds a layer that wasn't read to its end is replaced too, as it may hold one. Rows without
    either, null texts among them, stay as they are, and so do all other columns.
    """

    text_batches()

    @F.arrow_udf("string")
    @trimmed
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([cleaned(x) if x else x for x in column.to_pylist()], type=pa.string())

    (name,) = free(documents.columns, "clean")
    out = documents.withColumn(name, clean.asNondeterministic()(documents[f"`{text}`"]))
    changed = ~F.col(name).eqNullSafe(F.col(f"`{text}`"))
    if n_chars and n_chars in documents.columns:
        out = out.withColumn(n_chars, F.when(changed, F.length(name).cast("long")).otherwise(F.col(f"`{n_chars}`")))
    return out.withColumn(text, F.col(name)).drop(name)
