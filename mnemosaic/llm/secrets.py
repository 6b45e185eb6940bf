"""Secret scans by a recursive decoding worklist.

The text itself is the first layer. Every layer is scanned; then each way to unwrap it (URL escapes,
Unicode escapes, base64 runs also over several lines, compressed data in such runs) puts its result on
the worklist, until no layer gives a new one. Equal content is unwrapped once, and what is found in it is mapped through
every place where it stands; content within itself is not unwrapped again, so cycles end. Each layer
knows which characters of the layer above its own came from, and spans are mapped back.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Decompressed data is scanned in windows of about so many bytes. A window ends with a line that no match and no
#: wrapped run can go on from, else with a character that none has. A stretch without either is cut when it has HELD bytes, and
#: OVERLAP of them are scanned again: patterns have no upper length, so what is found in a part is found in the whole.
WINDOW, HELD, OVERLAP = 4 << 20, 32 << 20, 64 << 10
#: No pattern goes over such a character.
OUTSIDE = re.compile(rb"[^A-Za-z0-9+/_.=:\"'%\\{}\x20\t\r\n-]")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|((?:\\u[0-9a-fA-F]{4})+)|\\x([0-9a-fA-F]{2})|\\U([0-9a-fA-F]{8})")
FORM = re.compile(r"\+|(?:%[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{16,}+(?![^\s=]))*+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{1,15}+(?![^\s=]))?={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Stretches of decoded bytes that are text, no shorter than the shortest secret; and the beginnings of compressed data.
PRINTED = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
#: Text in 16-bit units, either end first.
WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}|(?:\x00[\t\r\n\x20-\x7e]){12,}")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: A text without any of these has no secret in any layer. A wider filter than the patterns above, never narrower.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx][0-9a-fA-F{]|[A-Za-z0-9+/_-]{16}"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one layer, leftmost and non-overlapping per kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class Places:
    """Where the characters of a layer came from: pieces (start here, source start, source end, exact)."""

    def __init__(self, pieces: list[tuple[int, int, int, bool]]):
        self.pieces, self.starts = pieces, [p[0] for p in pieces]

    def span(self, start: int, end: int) -> tuple[int, int]:
        a = self.pieces[bisect.bisect_right(self.starts, start) - 1]
        b = self.pieces[bisect.bisect_right(self.starts, end - 1) - 1]
        first = a[1] + (start - a[0]) if a[3] else a[1]
        last = b[1] + (end - b[0]) if b[3] else b[2]
        return first, last


def _rewritten(text: str, pattern: re.Pattern, decode) -> tuple[str, Places] | None:
    parts, pieces, at, here = [], [], 0, 0
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None or new == m.group():
            continue
        if m.start() > at:
            pieces.append((here, at, m.start(), True))
            parts.append(text[at : m.start()])
            here += m.start() - at
        if new:
            pieces.append((here, m.start(), m.end(), False))
            parts.append(new)
            here += len(new)
        at = m.end()
    if not at:
        return None
    if at < len(text):
        pieces.append((here, at, len(text), True))
        parts.append(text[at:])
    return ("".join(parts), Places(pieces)) if pieces else None


def _form(m: re.Match) -> str:
    return " " if m.group() == "+" else _url(m)


def _url(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


def _escape(m: re.Match) -> str | None:
    try:
        if m.group(1):
            return chr(int(m.group(1), 16))
        if m.group(3) or m.group(4):
            return chr(int(m.group(3) or m.group(4), 16))
        return bytes.fromhex(m.group(2).replace("\\u", "")).decode("utf-16-be", "replace")
    except (ValueError, OverflowError):
        return None


def _decompressor(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return zlib.decompressobj() if len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0 else None


def _inflated(raw: bytes) -> Iterator[bytes]:
    """Pieces of the decompressed data of all members that follow one another, as far as it can be read."""
    while (d := _decompressor(raw)) is not None:
        rest = raw
        while not d.eof:
            try:
                got = d.decompress(rest, WINDOW)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if got:
                yield got
            rest = getattr(d, "unconsumed_tail", b"")
            if not got and not d.eof:
                return
        raw = d.unused_data.lstrip(b"\x00")


def _cut(held: bytearray) -> tuple[int, int]:
    """(where a window of the held bytes ends, where the next begins); zeros to wait for more."""
    cut = held.rfind(b"\n")
    while cut >= 0:
        start = held.rfind(b"\n", 0, cut) + 1
        if cut - start > 1 << 12 or not re.fullmatch(rb"[A-Za-z0-9+/_-]{16,}", bytes(held[start:cut]).strip()):
            return cut + 1, cut + 1
        cut = start - 1
    last = None
    for last in OUTSIDE.finditer(held, max(0, len(held) - OVERLAP)):
        pass
    if last:
        return last.end(), last.end()
    return (len(held), len(held) - OVERLAP) if len(held) >= HELD else (0, 0)


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    held, tried = bytearray(), 0
    for piece in pieces:
        held += piece
        if len(held) - tried < WINDOW:
            continue
        end, begin = _cut(held)
        if end:
            yield held[:end].decode("utf-8", "replace")
            del held[:begin]
            tried = 0
        else:
            tried = len(held)
    if held:
        yield held.decode("utf-8", "replace")


def _raw_deflate(raw: bytes) -> Iterator[bytes]:
    """Pieces of what a whole run of deflated data without a header says, of any length; none unless it ends where the run does.

    Its end has to be seen first, so it is read twice: once to the end, keeping nothing, then for its pieces.
    """

    def pieces() -> Iterator[bytes]:
        d, rest = zlib.decompressobj(-15), raw
        while not d.eof:
            got = d.decompress(rest, WINDOW)
            rest = d.unconsumed_tail
            if not got and not d.eof:
                raise zlib.error("it ends early")
            yield got
        if d.unused_data:
            raise zlib.error("it ends before the run")

    try:
        for _ in pieces():
            pass
    except zlib.error:
        return
    yield from pieces()


class Decoded:
    """Where the characters of a stretch of decoded base64 came from: computed for a span, not kept for each."""

    def __init__(self, text: str, byte: int, skip: int, lines: list[tuple[int, int]]):
        self.text, self.byte, self.skip, self.lines = text, byte, skip, lines
        self.starts = [x[0] for x in lines]

    def source(self, at: int) -> int:
        here, there = self.lines[bisect.bisect_right(self.starts, at) - 1]
        return there + at - here

    def span(self, start: int, end: int) -> tuple[int, int]:
        first = self.byte + len(self.text[:start].encode("utf-8", "surrogatepass"))
        last = first + len(self.text[start:end].encode("utf-8", "surrogatepass"))
        return self.source(self.skip + first * 4 // 3), self.source(self.skip - (-last * 4 // 3) - 1) + 1


def _unbase64(text: str) -> Iterator[tuple[str, Places | Decoded, str]]:
    """Stretches of text and compressed data in base64 runs. A run is read from each of its first four characters, as one may be glued to a name before it."""
    for m in BASE64.finditer(text):
        lines, joined, n = [], [], 0
        for part in RUN.finditer(text, m.start(), m.end()):
            lines.append((n, part.start()))
            joined.append(part.group())
            n += len(joined[-1])
        run = "".join(joined).replace("-", "+").replace("_", "/")
        for skip in range(4):
            some = run[skip:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            if len(some) < 12:
                break
            raw = base64.b64decode(some + "=" * (-len(some) % 4))
            for x in MAGIC.finditer(raw):
                for window in _windows(_inflated(raw[x.start() :])):
                    yield window, Places([(0, m.start(), m.end(), False)]), "compressed"
            if skip == 0 or lines[0][1] > m.start():
                for window in _windows(_raw_deflate(raw)):
                    yield window, Places([(0, m.start(), m.end(), False)]), "compressed"
            for x in WIDE.finditer(raw):
                wide = x.group()
                yield wide.decode("utf-16-le" if wide[1] == 0 else "utf-16-be"), Places([(0, m.start(), m.end(), False)]), "utf-16"
            whole = False
            for x in PRINTED.finditer(raw):
                try:
                    plain = x.group().decode("utf-8")
                except UnicodeDecodeError:
                    plain = x.group().decode("latin-1").encode("ascii", "replace").decode()
                whole |= x.span() == (0, len(raw))
                yield plain, Decoded(plain, x.start(), skip, lines), "base64"
            if whole:
                break


def unwrapped(text: str) -> Iterator[tuple[str, Places | Decoded, str]]:
    """Each layer directly below a text."""
    if "%" in text and (x := _rewritten(text, URL, _url)):
        yield *x, "url"
    if "%" in text and "+" in text and (x := _rewritten(text, FORM, _form)):
        yield *x, "form"
    if "\\" in text and (x := _rewritten(text, ESCAPE, _escape)):
        yield *x, "unicode"
    yield from _unbase64(text)


def find_secrets(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layer): spans of the text in code points; layer is empty for base spans."""
    text = text or ""
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    spans: dict[tuple[str, int, int], str] = dict.fromkeys(scan(text), "")
    done: dict[bytes, dict[tuple[str, int, int], str]] = {}
    work = [(digest(text), unwrapped(text), spans, None, "")]
    active = {work[0][0]}

    def put(found: dict[tuple[str, int, int], str], places: Places | Decoded, how: str, above: dict[tuple[str, int, int], str]) -> None:
        for (kind, a, b), path in found.items():
            above.setdefault((kind, *places.span(a, b)), f"{how}>{path}" if path else how)

    while work:
        key, layers, found, places, how = work[-1]
        if (layer := next(layers, None)) is None:
            work.pop()
            active.discard(key)
            done[key] = found
            if work:
                put(found, places, how, work[-1][2])
            continue
        below, inner, name = layer
        below_key = digest(below)
        if below_key in done:
            put(done[below_key], inner, name, found)
        elif below_key in active:
            put(dict.fromkeys(scan(below), ""), inner, name, found)
        else:
            active.add(below_key)
            work.append((below_key, unwrapped(below), dict.fromkeys(scan(below), ""), inner, name))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(*s, how) for s, how in sorted(spans.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans array<struct<kind, start, end, layer>> in order of start, then kind.

    Null and empty texts have no spans; texts of any length are scanned whole. Repeated rows stay,
    other columns are not read, an empty table gives an empty one. There is no shuffle.
    """
    out = "doc_id long, spans array<struct<kind:string,start:long,end:long,layer:string>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "layer")
        for b in batches:
            text = b.column("text")
            may = pc.fill_null(pc.match_substring_regex(text, ANY), False)
            found = [[dict(zip(names, s)) for s in find_secrets(t.as_py())] if m.as_py() else [] for t, m in zip(text, may)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def digest_columns() -> list[Column]:
    base = F.filter("spans", lambda s: s["layer"] == "")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]
