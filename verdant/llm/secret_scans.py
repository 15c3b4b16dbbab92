"""Secret scans through nested encodings: a worklist of decoded layers, each rescanned, spans mapped back.

A layer is a text with, for each of its characters, the place in the original text it came from. The
worklist starts with the original and unwraps every layer four ways: percent escapes, Unicode escapes,
base64 runs, and compressed data inside any of them. It ends when no new layer appears; a layer is new if its
text has not been seen for the same stretch of the original, which also ends cycles. Escapes are undone
within the whole layer, so that a secret half of which is escaped is found too. Decoded bytes are never
judged by what characters they hold: they are read as UTF-8, else Latin-1, and with NULs as UTF-16 too.
Base64 is read from each of the four digits a run may start at, line by line and joined over line breaks; where
both readings have a finding, both are reported, as lines may be values of their own or parts of one.

Compressed data (gzip, zlib, bzip2, xz) is found at any place of decoded bytes, also of bytes written with
percent or backslash escapes, and read member after member. What it inflates to is scanned as text and, where it
holds compressed data again, put on the worklist as bytes, so layers may be nested to any depth and data that
inflates to itself ends like any other cycle. It may grow: beyond ``LAYER_LIMIT`` bytes it is reported as
``oversize`` with its span and read on in stretches of that size, each overlapping half of the one before.

Cases: NULL text counts as empty; repeated rows and NULL ids are scanned row by row; an empty table gives
an empty result; only the two columns named are read. Texts are handled one by one, whole, in batches
that Spark bounds; nothing is kept between them, so a lost task is simply run again.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "oversize")
LAYER_LIMIT = 1 << 26

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = r"[\x20\t]*+(?:[\r\n]|\\[rn])++(?:[\x20\t>#*|]|[\r\n]|\\[rn])*+"  # also written \\n, also quoted or commented
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
_DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAKS = re.compile(_BREAK)
_WIDE = re.compile(rb"(?:[\x01-\x7f]\0){12}|(?:\0[\x01-\x7f]){12}")  # the shortest finding, token=abcdef, has 12 characters
_PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|\+")
_PERCENT_BYTES = re.compile(r"(?<![!-~])[!-$&-~]*+%[!-~]*+")  # runs that hold the sign
_ESCAPED_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,2})\}|\\U000000([0-9A-Fa-f]{2})|\\[0-7]{1,3}|\\[abtnvfr\\'\"]")
_ESCAPED_BYTES = re.compile(r"(?<![\x20-\x7e])[\x20-\x5b\x5d-\x7e]*+\\[\x20-\x7e]*+")
_LETTERS = dict(zip("abtnvfr", "\a\b\t\n\v\f\r"))
_PIECE, _PART = 1 << 10, 1 << 20
# zlib headers: method 8, window of 2^8 to 2^15, four levels, no dictionary, divisible by 31.
_ZLIB = [bytes([c, f]) for c in range(0x08, 0x80, 0x10) for f in range(256) if (c * 256 + f) % 31 == 0 and not f & 0x20]
_ENGINES = (
    (b"\x1f\x8b\x08", lambda: zlib.decompressobj(31)),
    (b"BZh", bz2.BZ2Decompressor),
    (b"\xfd7zXZ\x00", lzma.LZMADecompressor),
    *((header, zlib.decompressobj) for header in _ZLIB),
)
_MAGIC = re.compile(b"|".join(re.escape(magic) for magic, _ in _ENGINES))
_TO_STANDARD = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns in one text, per kind leftmost and not overlapping."""
    found = []
    lowered = text.lower()  # only decides whether the slower pattern is tried
    if any(word in lowered for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text; ``place`` maps a stretch of it into its parent's text, ``whole`` is its stretch of the original, ``flat`` all it knows.

    A layer with ``data`` is inflated bytes that hold compressed data again; its text is empty."""

    def __init__(
        self,
        text: str,
        via: str = "",
        parent: Layer | None = None,
        place: Callable[[int, int], tuple[int, int]] | None = None,
        whole: tuple[int, int] | None = None,
        data: bytes | None = None,
    ):
        self.text, self.via, self.parent, self.place, self.data = text, via, parent, place, data
        self.flat = parent is None and whole is not None
        self.whole = whole or (0, len(text))
        self.rivals: list[tuple[int, int, int]] = []  # findings of earlier, likelier readings of the same bytes
        self.stored: bytes | None = None

    def key(self) -> tuple[bytes | str, bool, int, int]:
        """What tells layers apart: the text or the bytes, and the stretch of the original."""
        if self.data is None and len(self.text) < 1024:
            return self.text, False, *self.whole
        raw = self.text.encode("utf-8", "surrogatepass") if self.data is None else self.data
        return hashlib.sha256(raw).digest(), self.data is not None, *self.whole

    def wait(self) -> None:
        """While it waits, a large inflated layer is kept compressed, so that many of them need no more room than the data they came from."""
        raw = self.text.encode("utf-8", "surrogatepass") if self.data is None else self.data
        if self.flat and len(raw) * 8 > LAYER_LIMIT:
            self.stored = zlib.compress(raw, 1)
            self.text, self.data = "", None if self.data is None else b""

    def resume(self) -> None:
        if self.stored is not None:
            raw, self.stored = zlib.decompress(self.stored), None
            self.text, self.data = (raw.decode("utf-8", "surrogatepass"), None) if self.data is None else ("", raw)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            (start, end), layer = layer.place(start, end), layer.parent
        return layer.whole if layer.flat else (start, end)

    def spliced(self, pieces: list[tuple[int, int, list[tuple[str, int, int]]]], via: str) -> Layer:
        """The layer with each stretch (start, end) replaced by characters (char, start, end) of this layer's places."""
        out, news, olds, at, n = [], [], [], 0, 0  # where in the new text a stretch starts; its old place or its characters
        for start, end, chars in [*pieces, (len(self.text), len(self.text), [])]:
            for stretch, old in ((self.text[at:start], at), ("".join([c for c, _, _ in chars]), chars)):
                if stretch:
                    out.append(stretch)
                    news.append(n)
                    olds.append(old)
                    n += len(stretch)
            at = end

        def char(i: int) -> tuple[int, int]:
            k = bisect_right(news, i) - 1
            return olds[k][i - news[k]][1:] if isinstance(olds[k], list) else (olds[k] + i - news[k], olds[k] + i - news[k] + 1)

        return Layer("".join(out), f"{self.via}/{via}", self, lambda start, end: (char(start)[0], char(end - 1)[1]), self.whole)


def _percent(layer: Layer) -> Iterator[Layer]:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            decoded, width = raw.decode(), lambda c: len(c.encode())
        except UnicodeDecodeError:
            decoded, width = raw.decode("latin-1"), lambda c: 1
        at, chars = m.start(), []
        for c in decoded:
            chars.append((c, at, at + 3 * width(c)))
            at += 3 * width(c)
        pieces.append((m.start(), m.end(), chars))
    if pieces:
        yield layer.spliced(pieces, "url")


def _unicode(layer: Layer) -> Iterator[Layer]:
    pieces, high = [], None  # high: the first half of a surrogate pair
    for m in _UNICODE.finditer(layer.text):
        code = int(next(g for g in m.groups() if g), 16)
        if high and 0xDC00 <= code < 0xE000 and high[1] == m.start():
            pieces[-1] = (high[0], m.end(), [(chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00), high[0], m.end())])
        elif code < 0x110000:
            pieces.append((m.start(), m.end(), [("\ufffd" if 0xD800 <= code < 0xE000 else chr(code), m.start(), m.end())]))
        high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
    if pieces:
        yield layer.spliced(pieces, "unicode")


def _parts(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """(what one more piece inflates to, place read up to) of the compressed member at ``at``; the last place is -1 unless the member is whole."""
    make = next(m for magic, m in _ENGINES if data.startswith(magic, at))
    engine = make()
    try:
        while not engine.eof and at < len(data):
            piece = data[at : at + _PIECE]
            at += len(piece)
            out = engine.decompress(piece, *_most(engine))
            while not engine.eof and not getattr(engine, "needs_input", True):
                yield out, at
                out = engine.decompress(b"", *_most(engine))
            yield out, at - len(engine.unused_data)
    except (zlib.error, OSError, EOFError, ValueError, MemoryError, lzma.LZMAError):
        pass
    if not engine.eof:
        yield b"", -1


def _most(engine) -> tuple[int, ...]:
    return (_PART,) if hasattr(engine, "needs_input") else ()  # a piece for zlib grows a thousandfold at most


def _streams(data: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
    """(text bytes, start, end, whether there is more) of all compressed data at any place; members that follow each other are one.

    More than ``LAYER_LIMIT`` bytes come in stretches that overlap by half of it."""
    at = 0
    while m := _MAGIC.search(data, at):
        at, upto, held, more = m.start(), m.start(), bytearray(), False
        while at >= 0 and _MAGIC.match(data, at):
            for out, end in _parts(data, at):
                held += out
                upto = max(upto, end)
                while len(held) > LAYER_LIMIT:
                    more = True
                    yield bytes(held[:LAYER_LIMIT]), m.start(), len(data), more
                    del held[: max(1, LAYER_LIMIT // 2)]
            if end < 0:
                break
            at = end
            while data[at : at + 1] == b"\0":  # padding between members
                at += 1
        if held:
            yield bytes(held), m.start(), len(data) if more else upto, more
        at = max(m.start() + 1, at)


def _inflated(layer: Layer, data: bytes, place: Callable[[int, int], tuple[int, int]], via: str) -> Iterator[Layer]:
    """The texts of all compressed data in the bytes, and the inflated bytes as a layer of their own where they hold compressed data again."""
    if not _MAGIC.search(data):
        return
    for inner, start, end, more in _streams(data):
        whole = layer.origin(*place(start, end))
        if more:
            yield Layer("", "oversize", whole=whole)
        if _MAGIC.search(inner):
            yield Layer("", f"{layer.via}/{via}", whole=whole, data=inner)
        for text, _ in _texts(inner):
            yield Layer(text, f"{layer.via}/{via}", whole=whole)


def _packed(layer: Layer) -> Iterator[Layer]:
    yield from _inflated(layer, layer.data, lambda start, end: (start, end), "inflate")


def _texts(data: bytes) -> Iterator[tuple[str, Callable[[int], int]]]:
    """(text, byte at which its i-th character starts) of every way to read the bytes; UTF-16 of either order and parity where it has room for a secret."""
    try:
        text = data.decode()
        yield text, (lambda i: i) if len(text) == len(data) else _offsets(text, 0, lambda c: len(c.encode()))
    except UnicodeDecodeError:
        yield data.decode("latin-1"), lambda i: i
    if _WIDE.search(data):
        reads = [(f, data[f : len(data) - (len(data) - f) % 2].decode(c, "replace")) for f in (0, 1) for c in ("utf-16-le", "utf-16-be")]
        for first, text in sorted(reads, key=lambda r: -len(r[1].encode("ascii", "ignore"))):
            yield text, _offsets(text, first, lambda c: 4 if c > "\uffff" else 2)


def _offsets(text: str, first: int, width: Callable[[str], int]) -> Callable[[int], int]:
    known: list[int] = []

    def at(i: int) -> int:
        if not known:
            known.extend(accumulate(map(width, text), initial=first))
        return known[i]

    return at


def _read(layer: Layer, data: bytes, place: Callable[[int, int], tuple[int, int]], via: str) -> Iterator[Layer]:
    """The layers of decoded bytes; ``place`` tells where in the layer's text a stretch of bytes stands."""
    rivals: list[tuple[int, int, int]] = []
    for text, byte in _texts(data):
        if text:
            inner = Layer(text, f"{layer.via}/{via}", layer, lambda start, end, byte=byte: place(byte(start), byte(end)), layer.origin(*place(0, len(data))))
            inner.rivals = rivals
            yield inner


def _runs(text: str) -> Iterator[tuple[str, Callable[[int, int], tuple[int, int]]]]:
    """(digits, place of digits i to j in the text) of every base64 run, then of the runs joined over line breaks."""
    for m in _BASE64.finditer(text):
        digits = m[0].rstrip("=")
        yield digits, lambda i, j, m=m, n=len(digits): (m.start() + i, m.end() if j >= n else m.start() + j)
    if "\n" in text or "\r" in text or "\\" in text:
        for m in _WRAPPED.finditer(text):
            if m.end() - m.start() <= 16:
                continue
            parts, firsts, at, n = [], [], m.start(), 0  # firsts: (digit, its place) at the start of each line
            for gap in [*_BREAKS.finditer(text, m.start(), m.end()), None]:
                parts.append(text[at : gap.start() if gap else m.end()].rstrip("="))
                firsts.append((n, at))
                n, at = n + len(parts[-1]), gap.end() if gap else at
            if n >= 16:
                yield "".join(parts), lambda i, j, m=m, n=n, firsts=firsts: (_unwrapped(firsts, i), m.end() if j >= n else _unwrapped(firsts, j - 1) + 1)


def _unwrapped(firsts: list[tuple[int, int]], i: int) -> int:
    digit, at = firsts[bisect_right(firsts, i, key=lambda f: f[0]) - 1]
    return at + i - digit


def _base64(layer: Layer) -> Iterator[Layer]:
    """Every run is read from its first four digits on, so that digits before the data (a path, a name) spoil none of it."""
    for digits, place in _runs(layer.text):
        standard = digits.translate(_TO_STANDARD)
        for skip in range(4):
            body = standard[skip : len(standard) - ((len(standard) - skip) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            # byte i stands in the base64 digits i * 4 / 3 and the next one or two
            where = lambda i, j, place=place, skip=skip: place(skip + i * 4 // 3, skip - (-j * 4 // 3))
            yield from _read(layer, data, where, "base64")
            yield from _inflated(layer, data, where, "base64/inflate")


def _unescaped(layer: Layer, stretches: re.Pattern, escape: re.Pattern, value: Callable[[re.Match], bytes], via: str) -> Iterator[Layer]:
    """What compressed bytes written with escapes inflate to; characters that need no escape stand for themselves."""
    for m in stretches.finditer(layer.text):
        out, news, olds, at, n = [], [], [], m.start(), 0
        for e in [*escape.finditer(layer.text, m.start(), m.end()), None]:
            end = e.start() if e else m.end()
            for raw, start, step in ((layer.text[at:end].encode("latin-1"), at, 1), (value(e) if e else b"", end, 0)):
                if raw:
                    out.append(raw)
                    news.append(n)
                    olds.append((start, step, e.end() if e else end))
                    n += len(raw)
            at = e.end() if e else end

        def where(i: int, j: int, news=news, olds=olds) -> tuple[int, int]:
            a, b = bisect_right(news, i) - 1, bisect_right(news, j - 1) - 1
            return olds[a][0] + (i - news[a]) * olds[a][1], olds[b][0] + j - news[b] if olds[b][1] else olds[b][2]

        yield from _inflated(layer, b"".join(out), where, f"{via}/inflate")


def _packed_percent(layer: Layer) -> Iterator[Layer]:
    if not _PERCENT.search(layer.text):  # compressed bytes are never all printable
        return
    for plus in (b"+", b" ") if "+" in layer.text else (b"+",):
        yield from _unescaped(layer, _PERCENT_BYTES, _PERCENT_BYTE, lambda e, plus=plus: plus if e[0] == "+" else bytes.fromhex(e[0][1:]), "url")


def _packed_escapes(layer: Layer) -> Iterator[Layer]:
    if not _ESCAPED_BYTE.search(layer.text):
        return
    yield from _unescaped(layer, _ESCAPED_BYTES, _ESCAPED_BYTE, _escaped_value, "unicode")


def _escaped_value(e: re.Match) -> bytes:
    if e[0][1] in "xuU":
        return bytes([int(next(g for g in e.groups() if g), 16)])
    return bytes([int(e[0][1:], 8) & 255]) if e[0][1] in "01234567" else _LETTERS.get(e[0][1], e[0][1]).encode("latin-1")


def scan_text(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, via) of all findings; ``via`` names the layers undone, empty for the plain ones."""
    found = {span: "" for span in base_spans(text)}
    work = [Layer(text)]
    seen = {work[0].key()}
    while work:
        layer = work.pop()
        layer.resume()
        for inner in _unwrapped_layers(layer):
            if inner.via == "oversize":
                found.setdefault((inner.whole[0], 3, inner.whole[1]), "oversize")
                continue
            key = inner.key()
            if key in seen:
                continue
            seen.add(key)
            here: list[tuple[int, int, int]] = []
            for start, kind, end in base_spans(inner.text):
                first, last = inner.origin(start, end)
                if not any(k == kind and first < e and s < last for s, k, e in inner.rivals):
                    found.setdefault((first, kind, last), inner.via[1:])
                    here.append((first, kind, last))
            inner.rivals += here
            inner.wait()
            work.append(inner)
    return [(*span, via) for span, via in sorted(found.items())]


def _unwrapped_layers(layer: Layer) -> Iterator[Layer]:
    if layer.data is not None:
        yield from _packed(layer)
        return
    for unwrap, sign in ((_percent, "%"), (_packed_percent, "%"), (_unicode, "\\"), (_packed_escapes, "\\"), (_base64, "")):
        if sign in layer.text:
            yield from unwrap(layer)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): per row its findings as (kind, start, end, via), by start, kind and end, in code points."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("found", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _FIELDS])))]
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())]))
        for batch in rows:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "via": via} for s, k, e, via in scan_text(x.as_py() or "")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, schema)


_FIELDS = (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("via", T.StringType()))


def redact_text(text: str) -> str:
    """The text with every finding replaced by ``[kind]``; overlapping findings become one, named after the first."""
    out, at, upto = [], 0, 0
    for start, kind, end, _ in scan_text(text):
        if start >= upto:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = upto = max(upto, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, secrets replaced; ``n_chars`` follows where the column is there and the text changed."""
    at = docs.columns.index(text)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [None if (v := x.as_py()) is None else redact_text(v) for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    if n_chars not in docs.columns:
        return docs.mapInArrow(batches, docs.schema)
    names = docs.columns
    # A NULL length stays NULL; others are the length of the text that is left.
    return docs.mapInArrow(batches, docs.schema).select(
        *[F.when(F.col(c).isNotNull() & F.col(text).isNotNull(), F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(c) for c in names]
    )


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
