"""Secrets in text: patterns, and encoded material that is decoded and parsed first."""

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from agestrata.llm.store import in_small_batches

#: Kinds of spans, in the order in which those at one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt", "encoded")
BASE = KINDS[:3]

# The three base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: White space and slashes in a key may be escaped, as in JSON, more than once too.
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"
    r"((?:[A-Za-z0-9+/=\s:,]|\\+(?:[nrt/]|u000[9AaDd])|-(?!----))*)-----END \1-----"
)
ESCAPED = re.compile(r"\\+([nrt/]|u000[9AaDd])")
# Three segments, from the start of any: a header that names an algorithm has 11 bytes, a
# signature 16. Looking ahead leaves the segments after the first to be starts as well.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{15,}+)\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{22,}+)")
JWT_REST = re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
OBJECT_START = re.compile(rb"\s*(?:$|\{\s*(?:$|\"))")
# The shortest credential, as token=abcdef, has 12 bytes: 16 characters, or 24 hex digits.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")
# Lines of base64 or hex with nothing else in them but for the ends of the first and last.
BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|\\+r\\+n|\\+n)[ \t]*+")
LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap, those too short dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _decode64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``; None if its length
    is not in the shortest form or does not fit."""
    if at + 2 > end:
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > end:
            return None
        n = int.from_bytes(data[start : start + k])
        if n < 0x80 or data[start] == 0:
            return None
        start += k
    return (tag, start, start + n) if start + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start`` to ``end`` exactly."""
    out = []
    while start < end:
        element = _element(data, start, end)
        if element is None:
            return None
        out.append(element)
        start = element[2]
    return out


INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_private_der(data: bytes) -> bool:
    """A private key in DER whose nested lengths all fit: RSA (a version and at least eight
    integers), EC (version 1 and an octet string), or a wrapped key (version, an algorithm
    with its object id, and an octet string)."""
    whole = _element(data, 0, len(data))
    if whole is None or whole[0] != SEQUENCE or whole[2] != len(data):
        return False
    parts = _children(data, whole[1], whole[2])
    if not parts or len(parts) < 2 or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if version in (0, 1) and len(parts) >= 9 and all(t == INTEGER for t in tags[:9]):
        return all(p[2] > p[1] for p in parts)
    if version == 1 and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16:
        return all(t & 0xE0 == 0xA0 for t in tags[2:])
    if version in (0, 1) and len(parts) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == OBJECT_ID and parts[2][2] - parts[2][1] >= 16
    return False


SSH_MAGIC = b"openssh-key-v1\0"


def is_private_ssh(data: bytes) -> bool:
    """An OpenSSH private key: magic, cipher, derivation and its options as strings with
    lengths, a number of keys, and as many public keys before the private part."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4])
        if at + 4 > len(data) or at + 4 + n > len(data):
            return False
        at += 4 + n
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):
        n = int.from_bytes(data[at : at + 4])
        if at + 4 > len(data) or not n or at + 4 + n > len(data):
            return False
        at += 4 + n
    return at == len(data)


def _json_object(data: bytes | None) -> dict | None:
    try:
        value = json.loads(data.decode("utf-8")) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(run: str) -> bool:
    """Header and payload are JSON objects, the header names an algorithm, and there is a
    signature of 16 bytes at least."""
    header, payload, signature = (_decode64(part) for part in run.split("."))
    head = _json_object(header)
    return (
        head is not None and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"
        and _json_object(payload) is not None and signature is not None and len(signature) >= 16
    )


def _decode16(run: str) -> bytes | None:
    try:
        return bytes.fromhex(run)
    except ValueError:
        return None


def _texts(data: bytes, errors: str) -> Iterator[tuple[str, str]]:
    """``data`` as text, and its coding: UTF-8, and UTF-16 of either order where it has the
    zero bytes of that. ``errors`` says what becomes of bytes that are none."""
    whole = data[: len(data) // 2 * 2]
    for coding in ("utf-8", "utf-16-le", "utf-16-be") if b"\0" in data else ("utf-8",):
        try:
            yield (data if coding == "utf-8" else whole).decode(coding, errors if coding == "utf-8" else "replace"), coding
        except UnicodeDecodeError:
            continue


def _credentials(text: str) -> list[tuple[str, int, int]]:
    """What stands in decoded text: a credential, or something that is one once decoded;
    decoding shortens it, so that ends. Bare hex digits are none."""
    return [span for span in base_spans(text) if span[0] != "hex"] or confirmed_spans(text)


def _holds_secret(data: bytes) -> bool:
    return any(_credentials(text) for text, _ in _texts(data, "strict"))


def _confirmed(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_private_der(data):
        return "der"
    if is_private_ssh(data):
        return "ssh"
    return "encoded" if _holds_secret(data) else None


def _starts(text: str, start: int) -> list[int]:
    """Where a run found at ``start`` may begin: the letter of an escape is not part of it."""
    return [start, start + 1] if text[start - 1 : start] == "\\" and text[start] in "nrt" else [start]


def _inside(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """A secret in the run of base64 at ``start`` to ``end`` that does not begin with it, as
    after a prefix or a path. Keys begin after a separator and end with the run; text is
    looked for at all four alignments, and its span begins with the last separator before
    it that has its alignment, or else with the run. Work is linear in the run."""
    starts = [m.end() for m in re.finditer(r"[/_+-]", text[start:end])]
    body = text[start:end].rstrip("=")
    for at in starts:
        # Both kinds of keys are told by their first bytes, a DER key by its length too.
        if body.startswith("M", at):
            head = _decode64(body[at : at + 8]) or b""
            n = head[1] & 0x7F if len(head) == 6 else 5
            told = 0 if n > 4 and (len(head) < 6 or head[1] >= 0x80) else (
                2 + n if head[1] < 0x80 else 2 + n + int.from_bytes(head[2 : 2 + n])
            )
            if told != (len(body) - at) * 3 // 4:
                continue
        elif not body.startswith("b3BlbnNzaC1rZXktdjEA", at):
            continue
        data = _decode64(body[at:])
        if data and (is_private_der(data) or is_private_ssh(data)):
            return ("der" if is_private_der(data) else "ssh", start + at, end)
    for k in range(4):
        run = body[k:]
        data = _decode64(run[:-1] if len(run) % 4 == 1 else run)
        for decoded, coding in _texts(data, "surrogateescape") if data else ():
            found = _credentials(decoded)
            if found:
                before = decoded[: min(s for _, s, _ in found)]
                skipped = 2 * len(before) if coding != "utf-8" else len(before.encode("utf-8", "surrogateescape"))
                first = k + skipped // 3 * 4
                return ("encoded", start + max((s for s in starts if s <= first and s % 4 == k), default=0), end)
    return None


def _token_start(segment: str) -> int | None:
    """Where the header of a signed token begins in a first segment that may have a prefix."""
    for at in [0, *(m.end() for m in re.finditer("[_-]", segment))]:
        head = _decode64(segment[at : at + 8]) if len(segment) - at >= 15 else None
        if head and OBJECT_START.match(head) and _json_object(_decode64(segment[at:])) is not None:
            return at
    return None


def _line_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans over several lines: those of one width, with or without the line before, which
    may begin further right, and the one after, which may be shorter."""
    found = []
    for m in LINES.finditer(text) if "\n" in text or "\\n" in text else ():
        breaks = list(BREAK.finditer(text, m.start(), m.end()))
        lines = list(zip([m.start(), *(b.end() for b in breaks)], [*(b.start() for b in breaks), m.end()]))
        lines[0] = (_starts(text, m.start())[-1], lines[0][1])
        # The padding of the last line is no part of its width.
        width = [e - s for s, e in lines]
        width[-1] = len(text[slice(*lines[-1])].rstrip("="))
        i = done = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and width[j] == width[i]:
                j += 1
            tails = (j + 1, j) if j < len(lines) else (j,)
            heads = (i, i - 1) if i > done else (i,)
            for first, last in [(h, t) for h in heads for t in tails if t - h > 1]:
                run = "".join(text[s:e] for s, e in lines[first:last])
                kind = _confirmed(_decode64(run)) or _confirmed(_decode16(run))
                if kind:
                    found.append((kind, lines[first][0], lines[last - 1][1]))
                    j = done = last
                    break
            i = j
    return found


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of base64 or hex that decode to something with the structure of a secret."""
    found = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            body = ESCAPED.sub(lambda x: {"r": "", "t": "\t", "/": "/"}.get(x[1], "" if x[1] in ("u000d", "u000D") else "\n"), m[2])
            # Header lines of an armoured key end with a blank line.
            body = re.sub(r"\s", "", body.replace("\r", "").rsplit("\n\n", 1)[-1])
            data = _decode64(body)
            encrypted = data is not None and _element(data, 0, len(data)) is not None and "ENCRYPTED" in m[0]
            if data and (is_private_der(data) or is_private_ssh(data) or encrypted):
                found.append(("pem", m.start(), m.end()))
    for m in JWT.finditer(text) if "." in text else ():
        at = _token_start(m[1])
        if at is not None:
            end = JWT_REST.match(text, m.end(1)).end()
            if is_signed_token(text[m.start() + at : end]):
                found.append(("jwt", m.start() + at, end))
    taken = sorted((s, e) for _, s, e in found)
    found += [x for x in _line_spans(text) if not any(s < x[2] and x[1] < e for s, e in taken)]
    taken = [(s, e) for _, s, e in found]
    for pattern, decode in ((BASE64, _decode64), (HEX_ANY, _decode16)):
        for m in pattern.finditer(text):
            for start in _starts(text, m.start()):
                if any(s <= start < e for s, e in taken):
                    break
                kind = _confirmed(decode(text[start : m.end()]))
                if kind:
                    found.append((kind, start, m.end()))
                    break
            else:
                span = _inside(text, *m.span()) if pattern is BASE64 else None
                if span and not any(s < span[2] and span[1] < e for s, e in taken):
                    found.append(span)
    return found


def _listed(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with every span replaced; spans that overlap become one mark."""
    out, at, end = [], 0, 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` per row.

    Base spans are those of three patterns. Others are added where base64 or hex decodes
    to a private key (nested lengths parsed), a signed token (header and payload parsed) or
    text, UTF-8 or UTF-16, that holds a credential; a prefix before it in the run is no
    hindrance. Positions are code points, ends exclusive. A NULL text is
    empty and has none; rows are independent, so repeated ones repeat; other columns are
    left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = confirmed_spans(text)
                digest = hashlib.sha256(_joined(_listed(base)).encode()).hexdigest()
                n = [sum(k == kind for k, _, _ in base) for kind in BASE]
                rows.append((*n, digest, _joined(_listed(base + more)), len(more)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` in ``text`` replaced by ``mark`` and, where
    there is a column ``n_chars``, the new length in it. Rows and other columns stay."""
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts, changed = list(batch.columns), batch.column(at).to_pylist(), False
            lengths = batch.column(count).to_pylist() if count is not None else []
            for i, text in enumerate(texts):
                spans = base_spans(text) + confirmed_spans(text) if text else []
                if spans:
                    texts[i], changed = redacted(text, spans, mark), True
                    if count is not None:
                        lengths[i] = len(texts[i])
            if changed:
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if count is not None:
                    columns[count] = pa.array(lengths, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return in_small_batches(docs).mapInArrow(run, docs.schema)
