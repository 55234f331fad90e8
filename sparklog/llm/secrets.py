"""Secrets in whole texts, also inside nested URL, Unicode, base64 and compressed layers.

Base spans come from three patterns over the text itself. The worklist then decodes the
text (its URL or Unicode units in place, its base64 runs by themselves and joined across
line breaks), scans what comes out, and goes on with what is encoded in that, until no new
layer appears. A base64 run that gives no clean text is read from all four offsets, so
characters before it do no harm. Compressed blocks are unpacked as streams to their end, all
members and all compressions of them, and scanned in windows that overlap. A layer's hash is kept, so a layer that
decodes to one seen before ends there. Each decoded character keeps the span of the
original text that it came from; a hit in a layer is reported with that span.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparklog.llm import runtime

# The kinds and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Cheap tests of whole columns for what the patterns and decoders could use.
HAS_SECRET = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
HAS_LAYER = r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&#|[A-Za-z0-9+/_-]{16}"
#: Compressed bytes are handed over in slices (what one gives stays small), and what is unpacked is known by so many first bytes.
SLICE, FIRST = 256, 1 << 16
#: Unpacked text is scanned in windows of so many characters or more, which overlap by so many or more.
WINDOW, OVERLAP = 1 << 20, 1 << 16
#: A window is not cut within a run of these.
RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;\r\n"

URL_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNI_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: The shortest secret is 12 bytes (``token=`` and six more), which base64 writes in 16 characters.
B64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over lines: a run with the run that ends the line before and those that begin the lines after it.
B64_BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++\r?\n[ \t]*)?[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)*={0,2}")


#: Where a compressed block may begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68\x78]")
_STANDARD = str.maketrans("-_", "+/")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns (leftmost, non-overlapping per kind; failing matches dropped), by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


Layer = tuple[str, list[int], list[int]]  # text, and where each character begins and ends in the original


def _substitute(text: str, unit: re.Pattern, decode, step, starts: list[int], ends: list[int]) -> Layer | None:
    """The whole text with its units decoded in place. step: characters of a match that a decoded one comes from (None: all)."""
    at = 0
    out: list[str] = []
    b: list[int] = []
    e: list[int] = []
    for m in unit.finditer(text):
        got = decode(m)
        if got is None:
            continue
        out += (text[at : m.start()], got)
        stops = list(accumulate(map(step, got), initial=m.start())) if step else [m.start(), m.end()]
        b += starts[at : m.start()] + [starts[i] for i in stops[:-1]]
        e += ends[at : m.start()] + [ends[i - 1] for i in stops[1:]]
        at = m.end()
    if not at:
        return None
    out.append(text[at:])
    return "".join(out), b + starts[at:], e + ends[at:]


def _url(m: re.Match) -> str:
    return _text(unquote_to_bytes(m[0]))


def _uni(m: re.Match) -> str | None:
    code = int(m[1] or m[2] or m[4], 16) if not m[3] else int(m[3])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _clean(text: str) -> bool:
    return all(c.isprintable() or c in "\t\r\n" for c in text)


def _text(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that is none stands as one surrogate."""
    return raw.decode("utf-8", "surrogateescape")


def _tool(head: bytes):
    """A decompressor for a member or frame that begins so; None for other bytes."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    return None


def _feed(tool, data: bytes) -> Iterator[bytes]:
    """What a decompressor makes of some more bytes; a ValueError if they are damaged."""
    try:
        if not isinstance(tool, bz2.BZ2Decompressor):
            yield tool.decompress(data)
            return
        yield tool.decompress(data, WINDOW)
        while not tool.eof and not tool.needs_input:
            yield tool.decompress(b"", WINDOW)
    except (zlib.error, OSError, EOFError, RuntimeError) as e:
        raise ValueError("damaged") from e
    except Exception as e:  # zstandard's own error class
        if type(e).__name__ != "ZstdError":
            raise
        raise ValueError("damaged") from e


def _begins(head: bytes) -> bool:
    """Whether bytes begin a compressed block, by trying."""
    tool = _tool(head)
    try:
        return tool is not None and next(_feed(tool, head[:SLICE])) is not None
    except ValueError:
        return False


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What all members and frames of a stream hold, one after the other; from bytes that are none on, these as they are."""
    tool, held = None, b""
    slices = (bytes(c[i : i + SLICE]) for c in chunks for i in range(0, len(c), SLICE))
    for piece in chain(slices, (None,)):
        held += piece or b""
        while held and (len(held) >= 4 or tool is not None or piece is None):
            if tool is None and (tool := _tool(held)) is None:
                yield held
                yield from slices
                return
            given, held = held, b""
            try:
                yield from filter(None, _feed(tool, given))
            except ValueError:
                yield given
                yield from slices
                return
            if tool.eof:
                held, tool = tool.unused_data.lstrip(b"\0"), None


def _unpacked(raw: bytes) -> Iterator[bytes] | None:
    """What a compressed block holds, in chunks, once no compression is left; None for other bytes.

    A block that holds itself ends at its second turn."""
    if not _begins(raw[:SLICE]):
        return None
    head, rest, seen = bytes(raw), iter(()), set()
    while _begins(head[:SLICE]) and (key := hashlib.sha256(head[:FIRST]).digest()) not in seen:
        seen.add(key)
        chunks, rest = _inflate(chain((head,), rest)), iter(())
        head = b""
        for chunk in chunks:
            head += chunk
            if len(head) >= FIRST:
                rest = chunks
                break
    return chain((head,), rest)


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """A stream as texts that overlap, none of them cut within an encoded run or a row of spaces."""
    tool = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    text = ""
    for chunk in chunks:
        text += tool.decode(chunk)
        if len(text) >= WINDOW:
            keep = min(len(text) - OVERLAP, len(text.rstrip(RUN_CHARS)), len(text.rstrip(" ")) - 64)
            if keep > 0:
                yield text
                text = text[keep:]
    text += tool.decode(b"", True)
    if text:
        yield text


def _width(c: str) -> int:
    """Bytes that a character of ``_text`` comes from."""
    n = ord(c)
    return 1 if n < 0x80 or 0xDC80 <= n < 0xDD00 else 2 if n < 0x800 else 3 if n < 0x10000 else 4


def _base64(run: re.Match, starts: list[int], ends: list[int]) -> Iterator[Layer]:
    """What a run holds if that is clean text, else what it holds from each of the four offsets, compressed blocks unpacked."""
    at = [i for i, c in enumerate(run[0], run.start()) if c not in "= \t\r\n"]
    body = "".join(run.string[i] for i in at).translate(_STANDARD)
    for shift in range(4):
        part = body[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        for m in MAGIC.finditer(raw):
            chunks = _unpacked(memoryview(raw)[m.start() :])
            first = at[shift + m.start() * 8 // 6]
            for text in _windows(chunks) if chunks is not None else ():
                yield text, [starts[first]] * len(text), [ends[run.end() - 1]] * len(text)
        text = _text(raw)
        b, e, n = [], [], 0
        for c in text:
            b.append(starts[at[shift + n * 8 // 6]])
            n += _width(c)
            e.append(ends[at[shift + (n * 8 - 1) // 6]])
        yield text, b, e
        if not shift and len(body) % 4 != 1 and _clean(text):
            return


def _decoded(source: str, starts: list[int], ends: list[int]) -> Iterator[Layer | None]:
    """What one step of decoding makes of a text."""
    if "%" in source:
        yield _substitute(source, URL_UNIT, _url, lambda c: 3 * _width(c), starts, ends)
    if "\\" in source or "&#" in source:
        yield _substitute(source, UNI_UNIT, _uni, None, starts, ends)
    for pattern in (B64_RUN, B64_BLOCK):
        for m in pattern.finditer(source):
            if pattern is B64_RUN or "\n" in m[0]:
                yield from _base64(m, starts, ends)


def layers(text: str) -> Iterator[Layer]:
    """All decoded layers of a text, each once."""
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [_decoded(text, list(range(len(text))), list(range(1, len(text) + 1)))]
    while work:
        for layer in work[-1]:
            if layer is None or not layer[0]:
                continue
            key = hashlib.sha256(f"{layer[1][0]}:{layer[2][-1]}:{layer[0]}".encode("utf-8", "surrogatepass")).digest()
            if key not in seen:
                seen.add(key)
                yield layer
                work.append(_decoded(*layer))
                break
        else:
            work.pop()


def find_secrets(text: str, decode: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans (base ones and those of decoded layers, mapped back)."""
    base = scan(text)
    if not decode:
        return base, base
    more = set()
    for layer, starts, ends in layers(text):
        for kind, b, e in scan(layer):
            more.add((kind, starts[b], max(ends[b:e])))
    return base, sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def digest_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, base counts, base spans and all spans as text (null text: empty).

    Texts without a trace of a secret or an encoding, by column-wise tests that hold for whatever the
    patterns and decoders take, are not opened. Repeated rows each have their result, rows without an id
    none, an empty table gives no rows, and other columns are ignored. Time grows in proportion to a text
    and what its layers hold.
    """
    runtime.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string()), ("n_layered", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            layered = pc.match_substring_regex(text, HAS_LAYER).to_numpy(zero_copy_only=False)
            plain = pc.match_substring_regex(text, HAS_SECRET).to_numpy(zero_copy_only=False)
            rows = []
            for i in range(batch.num_rows):
                if not (layered[i] or plain[i]):
                    rows.append((0, 0, 0, "", "", 0))
                    continue
                base, full = find_secrets(text[i].as_py(), bool(layered[i]))
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), digest_spans(base), digest_spans(full), len(full) - len(base)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema.types[1:]))], schema=schema)

    return runtime.texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_layered long")
