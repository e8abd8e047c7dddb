"""Secret scans over nested encodings.

Each text starts a worklist of layers. A layer is scanned for secrets and then for encoded parts: URL escapes, Unicode escapes,
base64 runs, which may be wrapped over lines, and compressed bytes inside all of them. What an encoded part decodes to is a new layer; a layer seen before at the same
span of the text is dropped, so that the worklist ends at a fixpoint. Every layer keeps, for each of its characters, the span of
the original text that it came from: findings are told, and cut out, there. A layer that stands at several spans is read once.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import math
import re
import zlib
from collections import Counter, deque

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from weft.llm.common import rows, small_batches, texts

NAMES = r"api[_-]?key|access[_-]?key|secret(?:[_-]?(?:access[_-]?)?key)?|client[_-]?secret|private[_-]?key|auth[_-]?token|access[_-]?token|token|passw(?:or)?d|passwd|pwd"
NOISE = r"[^\w\s\"'=:]{0,8}"
#: (rule, what a text must hold for the pattern to be tried, pattern; group 1 is the secret).
RULES = [
    ("assignment", ("=", ":"), re.compile(rf"(?i)(?<![a-z0-9])(?:{NAMES}){NOISE}[\"']?\s*[:=]>?{NOISE}\s*[\"']?([A-Za-z0-9_\-./+=~]{{12,}})")),
    ("hex", ('"', "'", "`"), re.compile(r"[\"'`]([0-9a-fA-F]{32,})[\"'`]")),
    ("cloud key id", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])(A[KS]IA[0-9A-Z]{16})(?![A-Za-z0-9])")),
    ("repository token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-"), re.compile(r"\b((?:gh[pousr]_|github_pat_|glpat-)[A-Za-z0-9_-]{20,})")),
    ("service key", ("sk-", "sk_live_", "rk_live_", "xox", "AIza"), re.compile(r"(?<![A-Za-z0-9])((?:sk-|[sr]k_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,})")),
    ("signed token", ("eyJ",), re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)")),
    ("private key", ("-----BEGIN",), re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z))")),
    ("url password", ("://",), re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:([^\s/:@]{3,})@")),
]
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Base64 that goes on over line breaks, and its lines.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}(?![A-Za-z0-9+/_=-])")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Escaped bytes that aren't text: what must be there for the parts to be tried, parts that may hold them, and one byte of those.
RAW = [
    ("url", re.compile(r"%[0189A-Fa-f]"), re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!*()+-])+"), re.compile(r"%([0-9A-Fa-f]{2})|(.)")),
    ("unicode", re.compile(r"\\x[0189A-Fa-f]|\\u00[0189A-Fa-f]|\\u\{|\\U000000|&#"), re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,2}\}|\\U000000[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[ -\[\]-~])+"), re.compile(r"(?:\\x|\\u00|\\u\{|\\U000000|&#[xX](?=[0-9A-Fa-f]{1,2};))([0-9A-Fa-f]{1,2})[};]?|&#(?:0*)(1?[0-9]{1,2}|2[0-4][0-9]|25[0-5]);|\\(.)|(.)")),
]
MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x20\x3f\x5e\x7d\x9c\xbb\xda\xf9]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
CONTROL = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0"))
ONE = re.compile(r"\\u\{?([0-9A-Fa-f]+)\}?|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
#: Most bytes that one compressed part may open to: a guard against bombs. What is larger is reported as such and kept closed.
OPENED = 64 << 20
FOUND = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string()), ("digest", pa.string())])


class TooLarge(Exception):
    pass


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(rule, start, end) of the secrets of one layer as it stands."""
    out = []
    for rule, must, pattern in RULES:
        if any(m in text for m in must):
            for m in pattern.finditer(text):
                value = m[1]
                # a value that is a plain word is prose about a secret, not one
                if rule != "assignment" or (any(map(str.isdigit, value)) or not value.isalpha()) and entropy(value) >= 2.5:
                    out.append((rule, m.start(1), m.end(1)))
    return out


def _stream(raw: bytes) -> tuple[bytes, int] | None:
    """(raw decompressed, how many of its bytes that took), None where it doesn't start with compressed bytes."""
    try:
        if raw[:2] == b"\x1f\x8b":
            out, rest = [], raw
            while rest[:2] == b"\x1f\x8b":  # members follow one another
                member = zlib.decompressobj(31)
                try:
                    out.append(member.decompress(rest, OPENED + 1 - sum(map(len, out))))
                except zlib.error:
                    if not out:
                        raise
                    break
                if sum(map(len, out)) > OPENED:
                    raise TooLarge
                if not member.eof:
                    # a first member that is cut off isn't read, a later one as far as it goes
                    if len(out) == 1:
                        return None
                    rest = b""
                    break
                rest = member.unused_data
            return b"".join(out), len(raw) - len(rest)
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(raw) as f:
                got = f.read(OPENED + 1)
            if len(got) > OPENED:
                raise TooLarge
            whole = zstandard.ZstdDecompressor().decompressobj()
            whole.decompress(raw)
            return got, len(raw) - len(whole.unused_data)
        if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
            press = zlib.decompressobj()
        elif raw[:3] == b"BZh":
            press = bz2.BZ2Decompressor()
        elif raw[:6] == b"\xfd7zXZ\x00":
            press = lzma.LZMADecompressor()
        else:
            return None
        got = press.decompress(raw, OPENED + 1)
        if len(got) > OPENED:
            raise TooLarge
        return got, len(raw) - len(press.unused_data)
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        return None


def opened(raw: bytes) -> bytes | None:
    """raw decompressed, None where it isn't compressed."""
    return got[0] if (got := _stream(raw)) else None


def readable(raw: bytes) -> str | None:
    """raw as text, None if it isn't UTF-8 with hardly any control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    bad = sum(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)
    return text if text and bad * 20 <= len(text) else None


def _spliced(text: str, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, list[int], list[int]]:
    """text with parts (start, end, [(character, start, end)]) replaced; for each character the span it came from."""
    out, lo, hi, at = [], [], [], 0
    for start, end, chars in parts:
        out.append(text[at:start])
        lo += range(at, start)
        hi += range(at + 1, start + 1)
        for c, a, b in chars:
            out.append(c)
            lo.append(a)
            hi.append(b)
        at = end
    out.append(text[at:])
    lo += range(at, len(text))
    hi += range(at + 1, len(text) + 1)
    return "".join(out), lo, hi


def _percent(text: str):
    parts = []
    for m in PERCENT.finditer(text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        got = readable(raw)
        if got is None:
            continue
        chars, at = [], m.start()
        for c in got:
            n = 3 * len(c.encode())
            chars.append((c, at, at + n))
            at += n
        parts.append((m.start(), m.end(), chars))
    return _spliced(text, parts) if parts else None


def _escapes(text: str):
    parts = []
    for m in ESCAPE.finditer(text):
        chars: list[tuple[str, int, int]] = []
        for one in ONE.finditer(m[0]):
            point = int(next(g for i, g in enumerate(one.groups()) if g is not None), 10 if one[4] else 16)
            a, b = m.start() + one.start(), m.start() + one.end()
            if chars and 0xDC00 <= point < 0xE000 and 0xD800 <= ord(chars[-1][0]) < 0xDC00:
                point, a = 0x10000 + ((ord(chars[-1][0]) - 0xD800) << 10) + point - 0xDC00, chars.pop()[1]
            if point <= 0x10FFFF:
                chars.append((chr(point), a, b))
        parts.append((m.start(), m.end(), chars))
    return _spliced(text, parts) if parts else None


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _decoded(layer: str):
    """(encoding, layer with its escapes undone and their spans) for URL and Unicode escapes, where there are any."""
    if "%" in layer and (got := _percent(layer)):
        yield "url", got
    if ("\\" in layer or "&#" in layer) and (got := _escapes(layer)):
        yield "unicode", got


def _digest(secret: str) -> str:
    return hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _raw_bytes(part: str, one: re.Pattern, name: str) -> tuple[bytes, list[int], list[int]]:
    """The bytes that an escaped part stands for, and where each starts and ends in it. A plus stands for a space in URLs."""
    out, lo, hi = bytearray(), [], []
    for m in one.finditer(part):
        if m.lastindex == len(m.groups()):
            out.append(32 if name == "url" and m[0] == "+" else ord(m[0]))
        elif m.lastindex == 1:
            out.append(int(m[1], 16))
        else:
            out.append(int(m[2]) if m.lastindex == 2 else CONTROL.get(m[3], ord(m[3])))
        lo.append(m.start())
        hi.append(m.end())
    return bytes(out), lo, hi


def _wrapped(layer: str, block: re.Match, read) -> list[tuple[list[tuple[int, int]], tuple]]:
    """(spans of lines, what read says of them) for lines of base64 that are one run: all of a block, or else those of one width
    with a shorter first and last one, or without."""
    lines, out, i, fresh = [m.span() for m in LINE.finditer(layer, *block.span())], [], 0, True
    wide, n = [b - a for a, b in lines], len(lines)
    while i + 1 < n:
        w = max(wide[i], wide[i + 1])
        j = i + 1
        while j < n and wide[j] == w:
            j += 1
        ends = [n] if fresh else []
        for end in dict.fromkeys([*ends, *([j + 1] if j < n and wide[j] < w else []), j]):
            if end - i > 1 and (got := read(run := "".join(layer[a:b] for a, b in lines[i:end]))):
                # lines after the end of compressed bytes are others
                need, k = _needed(run), i
                while k < end and need > 0:
                    need -= wide[k]
                    k += 1
                if k - i > 1:
                    out.append((lines[i:k], got))
                i, fresh = max(k, i + 1), True
                break
        else:
            i, fresh = (i + 1 if wide[i] < w else j), False
    return out


def _needed(run: str) -> int:
    """How many characters of a base64 run its compressed bytes take; all where it isn't compressed."""
    try:
        got = _stream(_base64(run))
    except TooLarge:
        got = None
    return -(-got[1] * 4 // 3) if got else len(run)


def _cut(layer: str, lines: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Lines of a wrapped run that can't be read alone, as a secret of the run is cut by their end. Where the next line has a
    secret of its own, they may be runs of their own all the same."""
    run = "".join(layer[a:b] for a, b in lines)
    text = readable(_base64(run))
    if text is None:  # compressed: its start alone would open to a cut text
        return {lines[0]}
    out, ends, at = set(), [], 0
    for a, b in lines:
        at += b - a
        ends.append(at * 3 // 4)
    for _, a, b in secret_spans(text):
        a, b = len(text[:a].encode()), len(text[:b].encode())
        for k in range(bisect.bisect_right(ends, a), bisect.bisect_left(ends, b)):
            alone = _base64(layer[slice(*lines[k + 1])])
            if not (alone and (alone := readable(alone)) and secret_spans(alone)):
                out.add(lines[k])
    return out


def scan(text: str | None) -> list[tuple[str, int, int, str, str]]:
    """(rule, start, end, layers, digest) of all secrets of a text: span in the text, the encodings around it from the outside
    in, and a hash of the secret itself. A secret seen at the same span in several layers is told once, for the least nested;
    different secrets at one span, as those of an encoded file, have a row each."""
    if not text:
        return []
    found: dict[tuple[int, int, str], tuple[str, str]] = {}
    spans: dict[str, list[tuple[int, int]]] = {}
    # a layer under a base64 run has one span for all its characters: it is read once, and told for every span it stands at
    pending: dict[int, str] = {}
    hidden: dict[int, tuple[list[tuple[str, str]], list[tuple[tuple[str, ...], int]]]] = {}
    runs: dict[int, tuple[tuple[str, ...], int | None] | None] = {}

    def tell(rule, a, b, chain, digest):
        # of a wrapped run and a line of it the line is told
        if not any(a <= x and y <= b for x, y in spans.setdefault(digest, [])):
            spans[digest].append((a, b))
            found[a, b, digest] = (rule, ">".join(chain))

    def kept(layer: str) -> int:
        key = hash(layer)
        if key not in hidden:
            pending[key] = layer
        return key

    def inside(raw: bytes, names: tuple[str, ...]) -> tuple[tuple[str, ...], int] | None:
        """The encodings of bytes and the key of the layer in them, or of a bomb."""
        seen, first = {hash(raw)}, raw
        try:
            # compressed bytes may open to themselves
            while (got := opened(raw)) is not None and hash(got) not in seen:
                names = (*names, "compressed")
                seen.add(hash(got))
                raw = got
        except TooLarge:
            key = hash(first)
            hidden[key] = ([("compressed bomb", _digest(first.hex()))], [])
            return names, key
        return (names, kept(new)) if (new := readable(raw)) else None

    def unwrapped(run: str) -> tuple[tuple[str, ...], int] | None:
        key = hash(run)
        if key not in runs:
            runs[key] = None if (raw := _base64(run)) is None else inside(raw, ("base64",))
        return runs[key]

    def blobs(layer: str) -> list[tuple[int, int, tuple[str, ...], int]]:
        """Base64 runs, wrapped ones, and compressed bytes among escapes: (start, end, encodings, key). Lines that can be read
        alone come before the wrapped run that they are in."""
        out, cut = [], set()
        for block in WRAPPED.finditer(layer) if "\n" in layer else ():
            for lines, got in _wrapped(layer, block, unwrapped):
                out.append((lines[0][0], lines[-1][1], *got))
                cut |= _cut(layer, lines)
        out = [(*m.span(), *got) for m in BASE64.finditer(layer) if m.span() not in cut and (got := unwrapped(m[0]))] + out
        for name, there, part, one in RAW:
            for m in part.finditer(layer) if there.search(layer) else ():
                if there.search(m[0]):
                    raw, lo, hi = _raw_bytes(m[0], one, name)
                    at = 0
                    while at < len(raw) and (start := MAGIC.search(raw, at)):
                        at, n = start.start(), len(raw) - start.start()
                        try:
                            if (got := _stream(raw[at:])) is None:
                                at += 1
                                continue
                            n = got[1]
                        except TooLarge:
                            pass
                        if got := inside(raw[at : at + n], (name,)):
                            out.append((m.start() + lo[at], m.start() + hi[at + n - 1], *got))
                        at += n
        return out

    def opened_layer(key: int):
        """The secrets of a hidden layer and the layers in it."""
        if key not in hidden:
            layer = pending.pop(key)
            secrets = [(rule, _digest(layer[a:b])) for rule, a, b in secret_spans(layer)]
            inner: dict[tuple[tuple[str, ...], int], None] = {}
            for name, decoded in _decoded(layer):
                inner[(name,), kept(decoded[0])] = None
            for _, _, names, new in blobs(layer):
                inner[names, new] = None
            hidden[key] = (secrets, list(inner))
        return hidden[key]

    seen: set = set()
    work: deque[tuple] = deque([(text, None, None, ())])
    while work:
        layer, lo, hi, chain = work.popleft()
        if isinstance(layer, int):
            secrets, inner = opened_layer(layer)
            for rule, digest in secrets:
                tell(rule, lo, hi, chain, digest)
            for names, new in inner:
                if (new, lo, hi) not in seen:
                    seen.add((new, lo, hi))
                    work.append((new, lo, hi, (*chain, *names)))
            continue
        for rule, a, b in secret_spans(layer):
            tell(rule, a if lo is None else lo[a], b if hi is None else hi[b - 1], chain, _digest(layer[a:b]))
        for name, (new, ls, hs) in _decoded(layer):
            if lo is not None:
                ls, hs = [lo[a] for a in ls], [hi[b - 1] for b in hs]
            # the same characters from the same places: URL escapes and Unicode ones may be undone in either order
            if new and (mark := (hash(new), hash(tuple(ls)), hash(tuple(hs)))) not in seen:
                seen.add(mark)
                work.append((new, ls, hs, (*chain, name)))
        for a, b, names, new in blobs(layer):
            a, b = a if lo is None else lo[a], b if hi is None else hi[b - 1]
            if (new, a, b) not in seen:
                seen.add((new, a, b))
                work.append((new, a, b, (*chain, *names)))
    return sorted((rule, a, b, layers, digest) for (a, b, digest), (rule, layers) in found.items())


def redact(text: str | None, found: list[tuple], mark: str = "[SECRET]") -> str | None:
    """text with the spans of findings replaced by a mark; spans that overlap are one."""
    spans = sorted((a, b) for _, a, b, *_ in found)
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, start, end, layers, digest), a row for every secret found in docs; start and end count characters.

    Null and empty texts and texts without secrets have no row. Repeated rows have theirs each time, null doc_ids stay null, an
    empty table gives an empty one; columns other than doc_id and text aren't read. A narrow pass: no shuffle.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if got := scan(text.as_py()):
                    doc_id = doc_id.as_py()
                    out += [(doc_id, *x) for x in got]
            yield rows(out, FOUND)

    return texts(docs).mapInArrow(run, "doc_id bigint, rule string, start int, end int, layers string, digest string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets of column text replaced and n_chars counted anew; no row goes, other columns stay as they are.

    Null and empty texts, null doc_ids and repeated rows stay as they are; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            columns = {c: batch[c] for c in names}
            texts = batch["text"].to_pylist()
            found = [scan(x) for x in texts]
            if any(found):
                texts = [redact(x, f) for x, f in zip(texts, found)]
                columns["text"] = pa.array(texts, pa.string())
                n = [len(x) if f else None for x, f in zip(texts, found)]
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([k if k is not None else old for k, old in zip(n, batch["n_chars"].to_pylist())], pa.int64())
            yield pa.record_batch(list(columns.values()), names)

    return docs.mapInArrow(run, schema)
