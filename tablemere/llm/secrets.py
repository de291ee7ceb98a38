"""Secret scan with a recursive decoding worklist."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemere.llm.common import map_texts

KINDS = ("assign", "access", "hex")
#: Bytes of a compressed layer that are scanned at once; a larger one is scanned in windows that overlap by so many bytes.
LAYER_BYTES, OVERLAP = 32 << 20, 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_URLSAFE = str.maketrans("-_", "+/")
#: Two or more lines that are nothing but base64, as MIME and PEM have them; the last may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_UTF16 = re.compile(rb"(?:[^\x00]\x00){8,}|(?:\x00[^\x00]){8,}")
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) that stand in the text itself; ends are exclusive, in code points."""
    found = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if low and any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _ordered(spans: set[Span] | list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class _Layer:
    """A decoded text with the span of the original text that each of its characters comes from."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None) -> None:
        self.text, self.start, self.end = text, start, end

    def span(self, i: int, j: int) -> tuple[int, int]:
        if self.start is None:
            return i, j
        return int(self.start[i:j].min()), int(self.end[i:j].max())

    def replaced(self, parts: list[tuple[int, int, str]]) -> _Layer:
        """With the stretches (from, to, text) replaced; each new character stands for its whole stretch."""
        texts, starts, ends, at = [], [], [], 0
        own_start = np.arange(len(self.text)) if self.start is None else self.start
        own_end = np.arange(1, len(self.text) + 1) if self.end is None else self.end
        for i, j, new in [*parts, (len(self.text), len(self.text), "")]:
            texts += [self.text[at:i], new]
            starts.append(own_start[at:i])
            ends.append(own_end[at:i])
            if new:
                a, b = self.span(i, j)
                starts.append(np.full(len(new), a))
                ends.append(np.full(len(new), b))
            at = j
        return _Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def inner(self, i: int, j: int, text: str) -> _Layer:
        """A layer of its own, all of which comes from one stretch."""
        a, b = self.span(i, j)
        return _Layer(text, np.full(len(text), a), np.full(len(text), b))


class _Text(_Layer):
    """A decoded text whose places don't matter, for all of it comes from one stretch."""

    def replaced(self, parts: list[tuple[int, int, str]]) -> _Layer:
        texts, at = [], 0
        for i, j, new in parts:
            texts += [self.text[at:i], new]
            at = j
        return _Text("".join([*texts, self.text[at:]]))

    def inner(self, i: int, j: int, text: str) -> _Layer:
        return _Text(text)


def _percent(layer: _Layer) -> Iterator[_Layer]:
    parts = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        if len(text) == len(raw):  # one sign each: keep the places exact
            parts += [(m.start() + 3 * k, m.start() + 3 * k + 3, c) for k, c in enumerate(text)]
        else:
            parts.append((m.start(), m.end(), text))
    if parts:
        yield layer.replaced(parts)


def _escapes(layer: _Layer) -> Iterator[_Layer]:
    parts, held = [], None
    for m in _ESCAPE.finditer(layer.text):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if held and 0xDC00 <= code < 0xE000 and held[1] == m.start():  # the second half of a pair
            parts.append((held[0], m.end(), chr(0x10000 + ((held[2] - 0xD800) << 10) + code - 0xDC00)))
            held = None
            continue
        held = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code)))
    if parts:
        yield layer.replaced(parts)


def _chunks(raw: bytes) -> Iterator[bytes]:
    """What is in a compression layer, in parts, all members of it; what comes before an error counts."""
    size = LAYER_BYTES // 8 + 1
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        try:
            with zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(raw, read_across_frames=True) as r:
                while part := r.read(size):
                    yield part
        except zstandard.ZstdError:
            pass
        return
    while raw:
        if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0):
            work = zlib.decompressobj(47)
        elif raw[:3] == b"BZh":
            work = bz2.BZ2Decompressor()
        elif raw[:6] == b"\xfd7zXZ\x00":
            work = lzma.LZMADecompressor(memlimit=128 << 20)
        else:
            return
        try:
            part = work.decompress(raw, size)
            while part or not work.eof:
                if part:
                    yield part
                left = getattr(work, "unconsumed_tail", b"")
                if work.eof or not (left or part):
                    break
                part = work.decompress(left, size)
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            return
        raw = work.unused_data.lstrip(b"\0") if work.eof else b""


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """One compression layer less, in overlapping windows if it is large; nothing if there is none."""
    held, size, first = [], 0, True
    for part in _chunks(raw):
        held.append(part)
        size += len(part)
        if size > LAYER_BYTES:
            whole = b"".join(held)
            yield whole
            held, size, first = [whole[-OVERLAP:]], min(OVERLAP, len(whole)), False
    if first and size or size > OVERLAP or not first and len(held) > 1:
        yield b"".join(held)


def _clean(raw: bytes) -> str | None:
    """The text in some bytes; None if they aren't plain text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not _ODD.search(text) else None


def _texts_of(raw: bytes, seen: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """The texts in some bytes, through any number of compressions; bytes that aren't UTF-8 count as latin-1, and UTF-16 as what it spells."""
    digest = hashlib.sha256(raw).digest()
    if digest in seen:
        return
    packed = False
    for less in _unpacked(raw):
        packed = True
        yield from _texts_of(less, seen | {digest})
    if packed:
        return
    try:
        yield raw.decode()
    except UnicodeDecodeError:
        yield raw.decode("latin-1")
    if b"\0" in raw:
        yield from (m[0].replace(b"\0", b"").decode("latin-1") for m in _UTF16.finditer(raw))
    yield from _embedded(raw, seen | {digest})


def _embedded(raw: bytes, seen: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """Texts of the compressed stretches that start within some bytes."""
    for m in _MAGIC.finditer(raw):
        for less in _unpacked(raw[m.start() :]) if m.start() else ():
            yield from _texts_of(less, seen)


def _base64(layer: _Layer) -> Iterator[_Layer]:
    """Layers of each run, and of runs that line ends part.

    A run that is plain or compressed text as a whole is one stretch. It may
    also begin before the encoded part (a path or a name that is glued to it):
    so all four alignments are decoded with each byte's own place, and
    compressed parts are looked for after each sign that can part a path.
    """
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            run = m[0].rstrip("=")
            at = None
            if pattern is _WRAPPED:
                at = np.array([k for k, c in enumerate(run) if not c.isspace()])
                run = "".join(run.split())
            run = run.translate(_URLSAFE)
            for o in range(4):
                part = run[o : len(run) - ((len(run) - o) % 4 == 1)]
                if len(part) < 2:
                    continue
                raw = base64.b64decode(part + "=" * (-len(part) % 4))
                if o == 0:
                    if _clean(raw) is not None or next(_unpacked(raw), None) is not None:
                        for text in _texts_of(raw):
                            yield layer.inner(m.start(), m.end(), text)
                        continue
                starts = {u.start() for u in _MAGIC.finditer(raw)}
                starts |= {(k - o) // 4 * 3 for k in (x.end() for x in re.finditer(r"[/+]", run)) if (k - o) % 4 == 0 and k >= o}
                if isinstance(layer, _Text):
                    yield _Text(raw.decode("latin-1"))
                    yield from map(_Text, (u[0].replace(b"\0", b"").decode("latin-1") for u in _UTF16.finditer(raw)))
                    yield from (_Text(t) for k in sorted(starts) if k < len(raw) for less in _unpacked(raw[k:]) for t in _texts_of(less))
                    continue
                first = o + np.arange(len(raw)) // 3 * 4 + np.arange(len(raw)) % 3
                begin = first if at is None else at[first]
                last = np.minimum(first + 1, len(run) - 1)
                end = (last if at is None else at[last]) + 1
                end = np.minimum(end, m.end() - m.start())
                a, b = m.start() + begin, m.start() + end
                if layer.start is not None:
                    a, b = layer.start[a], np.maximum(layer.end[b - 1], layer.end[a])
                yield _Layer(raw.decode("latin-1"), a, b)
                if b"\0" in raw:
                    for u in _UTF16.finditer(raw):
                        keep = [k for k in range(u.start(), u.end()) if raw[k]]
                        yield _Layer(u[0].replace(b"\0", b"").decode("latin-1"), a[keep], b[keep])
                for k in sorted(starts):
                    if k < len(raw):
                        for less in _unpacked(raw[k:]):
                            for text in _texts_of(less):
                                yield _Layer(text, np.full(len(text), a[k:].min()), np.full(len(text), b[k:].max()))


def _decoded(layer: _Layer) -> Iterator[_Layer]:
    yield from _base64(layer)
    if "%" in layer.text:
        yield from _percent(layer)
    if "\\" in layer.text or "&#" in layer.text:
        yield from _escapes(layer)


def _digest(layer: _Layer) -> bytes:
    """A layer's text and places."""
    made = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass"))
    if layer.start is not None:
        made.update(np.asarray(layer.start, np.int64).tobytes())
        made.update(np.asarray(layer.end, np.int64).tobytes())
    return made.digest()


def _kinds(text: str, known: dict[bytes, set[str]]) -> set[str]:
    """Kinds of all spans in a text's layers, each distinct text looked at once."""
    own = _digest(_Text(text))
    if own in known:
        return known[own]
    found, seen, work = {k for k, _, _ in base_spans(text)}, {own}, [_decoded(_Text(text))]
    while work and len(found) < len(KINDS):
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if (name := _digest(_Text(inner.text))) in seen:
            continue
        seen.add(name)
        if name in known:
            found |= known[name]
            continue
        found |= {k for k, _, _ in base_spans(inner.text)}
        work.append(_decoded(_Text(inner.text)))
    known[own] = found
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, in order.

    A worklist of layers: each is scanned, then unwrapped once more by every
    decoder; what comes out is put on the list unless the same text from the
    same places was on it before, until the list is empty. Layers that come
    from one stretch as a whole need only the kinds of what is in them: these
    are found once for each distinct text, wherever it stands. Spans of inner
    layers are those of the characters of the original that they were decoded
    from.
    """
    base = base_spans(text)
    found, seen, known, work = set(base), set(), {}, [_decoded(_Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        a, b = layer.span(0, len(layer.text))
        if (layer.start == a).all() and (layer.end == b).all():
            found |= {(kind, a, b) for kind in _kinds(layer.text, known)}
            continue
        if (name := _digest(layer)) in seen:
            continue
        seen.add(name)
        found |= {(kind, *layer.span(i, j)) for kind, i, j in base_spans(layer.text)}
        work.append(_decoded(layer))
    return _ordered(base), _ordered(found)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch under spans replaced by ``mark``."""
    out, at, open_from, open_to = [], 0, None, -1
    for _, i, j in [*sorted(spans, key=lambda s: s[1]), ("", len(text) + 1, len(text) + 1)]:
        if open_from is not None and i > open_to:
            out += [text[at:open_from], mark]
            at, open_from = open_to, None
        if i <= len(text):
            open_from, open_to = (i, j) if open_from is None else (open_from, max(open_to, j))
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,stop:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, base, spans) for each whole text, and with ``redact`` also (clean): the text without its secrets.

    base and spans are arrays of (kind, start, stop). A null text counts as
    empty, and its clean text is null; repeated rows give repeated rows; an
    empty table gives none. Other columns are not read.
    """

    def run(data: np.ndarray, offs: np.ndarray, nulls: np.ndarray) -> dict[str, object]:
        raw, base, spans, clean = data.tobytes(), [], [], []
        row = lambda found: [{"kind": k, "start": i, "stop": j} for k, i, j in found]
        for i, j, null in zip(offs[:-1].tolist(), offs[1:].tolist(), nulls.tolist(), strict=True):
            t = raw[i:j].decode("utf-8", "replace")
            own, every = all_spans(t)
            base.append(row(own))
            spans.append(row(every))
            if redact:
                clean.append(None if null else redacted(t, every) if every else t)
        made = {"base": pa.array(base, _ARROW), "spans": pa.array(spans, _ARROW)}
        return made | ({"clean": pa.array(clean, pa.string())} if redact else {})

    return map_texts(docs, run, [doc_id], text, f"base {_SPANS}, spans {_SPANS}" + ", clean string" * redact, nulls=True)


def digests(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``'s rows."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return scanned.select(
        doc_id, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
