"""Credentials embedded in source and configuration: find and redact.

A text is scanned for credentials by public token formats, key blocks, URLs, headers and named values. Literals that are
base64, hex, percent or backslash encoded are decoded, recursively, and scanned again; binary results are read as key
containers by their grammar. A credential found below an encoded literal redacts the whole enclosing literal.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Hit(NamedTuple):
    start: int
    end: int
    rule: str


# fixed values: public token formats of services, and words of credential names
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA)[A-Z2-7][A-Z0-9]{15}"
    r"|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|gl(?:pat|ptt|dt|rt|cbt)-[A-Za-z0-9_-]{20,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{16,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{20,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}"
    r"|sk-[A-Za-z0-9_-]{32,}|[a-z]{2,8}_(?:pat|token|key|secret)_[A-Za-z0-9]{24,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"
    r")(?![A-Za-z0-9])"
)
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")  # a format above, whose parts are not opened
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(.*?)-----END \1-----", re.S)
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]{3,})@(?=[A-Za-z0-9\[])")
_PAIR = re.compile(r"(?i)(?<=[;\"'`\s?&])(?:password|pwd|accountkey|sharedaccesskey|sharedsecret)=([^;\"'`\s&]{4,})(?=[;\"'`&])")
_NETRC = re.compile(r"(?i)\b(?:machine\s+\S+\s+)?login\s+\S+\s+password\s+(\S{4,})")
_HEADER = re.compile(r"(?i)\b(?:authorization\\?[\"']?\s*[:=,]\s*\\?[\"'`]?\s*(?:basic|bearer|token|digest|apikey)|bearer)\s+([A-Za-z0-9._~+/=-]{12,})")
_COMMAND = re.compile(r"(?i)(?<=\s)(?:--(?:password|passwd|token|secret|api-key|auth-token)(?:=|\s+)|(?:-u|--user)\s+[\"']?[\w.@-]+:)[\"']?([^\s\"'`]{6,})")
_SQL = re.compile(r"(?i)\b(?:identified\s+by|with\s+(?:encrypted\s+)?password|set\s+password\s*=)\s*'([^'\n]{4,})'")
_QUERY = re.compile(r"(?i)[?&](?:access_token|auth_token|token|api_?key|sig|signature|client_secret)=([A-Za-z0-9._~+/%-]{16,})")
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|creds?|credentials?|bearer|jwt)(\\?[\"'`]?\]?\)?(?:\s*:\s*[A-Za-z]{3,9}(?=\s*=))?\s*(?::=|=>|==?|[:,])[ \t]*)")
_PROSE = re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd|secret|token|api[ -]?key|credentials?)(?:\s+(?:is|was|to|for now))?\s*[:=]?[ \t]+[\"'`]?([^\s\"'`,;]{8,})")
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|<!--|;|-\s|>|rem\b)", re.I)
_PASS_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "secret"}
_TOKEN_WORDS = {"token", "auth", "cred", "creds", "credential", "credentials", "bearer", "jwt", "apikey", "accesskey", "secretkey", "privatekey"}
_KEY_KINDS = {"api", "access", "secret", "private", "deploy", "signing", "encryption", "auth", "master", "account", "shared", "service", "client", "app", "storage", "webhook"}
_STAND_IN = re.compile(
    r"(?i)^(?:[x*.•#_-]+|(.)\1+|<.*|\$.*|%[({].*|\{.*|\[.*|&.*|@.*|!.*|null|none|nil|true|false|undefined|redacted|removed|hidden|masked|secret|password|passwd|token|default|empty|required|optional"
    r"|.*change[_-]?(?:me|this|it).*|.*(?:redacted|placeholder|not[_-]?a[_-]?real|goes[_-]?here).*"
    r"|(?:your|my|our|the|some|insert|enter|replace|put|add|fill|use|dummy|fake|example|sample|todo|tbd|fixme)(?:[_ -]?[a-z]+)*(?:[_-]?(?:here|\d{1,3}))?|abc123|123456\d*|secret123|password\d{0,4}|hunter2)$"
)
_CONFIG = re.compile(r"(?:^|/)(?:\.env[^/]*|\.netrc|\.npmrc|\.pypirc|dockerfile|[^/]*\.(?:env|ya?ml|sh|bash|zsh|ini|cfg|conf|config|properties|toml|md|rst|txt|tfvars))$", re.I)
_LITERAL = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
#: A run of plain characters and escapes; begun at its first character only, so that long runs are read once.
_ESCAPED = re.compile(r"(?<![A-Za-z0-9._~+/=:@%\\-])(?:[A-Za-z0-9._~+/=:@-]++|%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4})++")
_JWK = re.compile(r"\{[^{}]*\"kty\"[^{}]*\}")
_JWK_PART = re.compile(r"\"(?:d|k)\"\s*:\s*\"([A-Za-z0-9_-]{16,})\"")
_HEX = re.compile(r"(?:[0-9a-f]{2}){10,}|(?:[0-9A-F]{2}){10,}")
_QUOTE, _BARE = re.compile(r"(?:[frbu]{1,2})?(\\?[\"'`])"), re.compile(r"[^\s\"'`,;)}\]<>|]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_.\-\s]+")


def stands_in(value: str) -> bool:
    """Placeholders, blanked-out values and references to variables, files or vaults."""
    if _STAND_IN.match(value) or value.endswith("EXAMPLE") or value.endswith("EXAMPLEKEY"):
        return True
    if value.startswith(("/", "./", "~/", "../", "file:", "vault:", "arn:", "op://", "env:")) and "/" in value:
        return value.count("/") > 1 or value[:1] in "/.~" and re.search(r"[a-z]{3,}", value) is not None and not re.search(r"\d[A-Z]|[A-Z]\d", value)
    return "${" in value or "{{" in value or "<" in value and ">" in value


def looks_random(value: str, least: int = 8) -> bool:
    """Letters with digits or symbols, and upper and lower case, a symbol or a run of digits among them."""
    if len(value) < least or not re.search(r"[A-Za-z]", value):
        return False
    mixed = re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)
    if not re.search(r"\d", value):
        return bool(mixed and re.search(r"[A-Za-z][!@#$%^&*~+][A-Za-z]", value))
    return bool(mixed or re.search(r"[!@#$%^&*~+=]", value) or re.search(r"\d{2,}", value))


def _kind(name: str) -> str:
    """"pass", "token" or "" by the last words of a name."""
    words = [w.lower() for w in _CAMEL.split(name) if w]
    if not words:
        return ""
    if words[-1] in _PASS_WORDS:
        return "pass"
    if words[-1] in _TOKEN_WORDS:
        return "token"
    if words[-1] == "key" and len(words) > 1 and words[-2] in _KEY_KINDS:
        return "token"
    return ""


def _fits(kind: str, value: str) -> bool:
    if stands_in(value) or len(value) < 6 or re.search(r"\s", value):
        return False
    if "://" in value or "(" in value and ")" in value or value.startswith("-----"):
        return False
    if kind == "pass":
        if re.search(r"\d", value):
            return bool(re.search(r"[A-Za-z]", value)) or len(value) >= 8
        odd = re.search(r"[!@#$%^&*~+]", value) and re.search(r"[A-Za-z]", value)
        return bool(odd or re.search(r"[a-z][A-Z].*[a-z][A-Z]|[A-Z]{2}[a-z]", value) and not re.search(r"[_.-]", value) and len(value) >= 8)
    if len(value) < 12 or re.fullmatch(r"[\d.,:-]+", value):
        return False
    if re.fullmatch(r"[0-9a-f]{24,}|[0-9A-F]{24,}", value):
        return True
    return bool(re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and not re.fullmatch(r"[a-z]+(?:[_.-][a-z]+)*[_.-]?\d{1,4}|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[a-z]+(?:_[a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)+", value)) or (
        len(value) >= 20 and re.fullmatch(r"[A-Za-z+/=]+", value) is not None and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", value)) > len(value) // 4
    )


def _named(text: str, config: bool) -> Iterator[Hit]:
    for m in _NAMED.finditer(text):
        start = m.start(1)
        a = start
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_-."):
            a -= 1
        kind = _kind(text[a:start])
        if not kind:
            continue
        at = m.end()
        q = _QUOTE.match(text, at)
        if q:
            line_end = text.find("\n", at)
            end = text.find(q[1], q.end(), line_end if line_end >= 0 else len(text))
            if end > q.end() and _fits(kind, text[q.end() : end]):
                yield Hit(q.end(), end, "named")
            continue
        if m[1].strip() == ",":
            continue
        line = text.rfind("\n", 0, a) + 1
        if config or _COMMENT.match(text[line:a]):
            v = _BARE.match(text, at)
            if v and _fits(kind, v[0]) and (config or looks_random(v[0])):
                yield Hit(v.start(), v.end(), "named")


def _prose(text: str, config: bool) -> Iterator[Hit]:
    for m in _PROSE.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        if not (_COMMENT.match(text[line : m.start()]) or config or re.search(r"//|#|\*", text[line : m.start()])):
            continue
        value = m[1].rstrip(".:)")
        if not stands_in(value) and looks_random(value) and not re.search(r"[()\[\]{}]|://|^--", value) and not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}|[a-z_]+\d{1,2}", value):
            yield Hit(m.start(1), m.start(1) + len(value), "prose")


# fixed values: object identifiers (as their DER contents) of private key algorithms, of password-based encryption and of PKCS#12 contents
_KEY_ALGORITHMS = {
    bytes.fromhex("2a864886f70d010101"): "rsa", bytes.fromhex("2a864886f70d01010a"): "rsa", bytes.fromhex("2a8648ce3d0201"): "ec", bytes.fromhex("2a8648ce380401"): "integer",
    bytes.fromhex("2a864886f70d010301"): "integer", bytes.fromhex("2b656e"): "octets", bytes.fromhex("2b656f"): "octets", bytes.fromhex("2b6570"): "octets", bytes.fromhex("2b6571"): "octets",
}
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_PFX_CONTENTS = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))
_INTEGER, _BITS, _OCTETS, _NULL, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30


def _elements(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the DER elements that fill a range exactly; None where they do not."""
    out, end = [], len(data) if end is None else end
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
            if n < 0x80:  # not the shortest form
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _sequence(data: bytes) -> list[tuple[int, int, int]] | None:
    """The elements of bytes that are one DER sequence from first to last."""
    top = _elements(data)
    return _elements(data, top[0][1], top[0][2]) if top and len(top) == 1 and top[0][0] == _SEQUENCE else None


def _small(data: bytes, part: tuple[int, int, int]) -> int:
    """The value of a one-byte integer; -1 for anything else."""
    return data[part[1]] if part[0] == _INTEGER and part[2] - part[1] == 1 else -1


def _rsa_or_dsa(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Version and whole numbers: eight of RSA, whose modulus is the product of its primes, or five of DSA."""
    version = _small(data, parts[0])
    if version == 1 and len(parts) == 10 and parts[9][0] == _SEQUENCE:
        parts = parts[:9]  # further primes
    if version not in (0, 1) or len(parts) not in (6, 9) or any(t != _INTEGER or b <= a for t, a, b in parts):
        return False
    n, *rest = (int.from_bytes(data[a:b], "big") for _, a, b in parts[1:])
    if len(parts) == 6:
        return n.bit_length() >= 512 and all(0 < x < n for x in rest)
    return n.bit_length() >= 256 and (version == 1 or rest[2] * rest[3] == n)


def _sec1(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Version 1, the secret octets, then a curve and a public point, if any, under their context tags."""
    if len(parts) < 2 or _small(data, parts[0]) != 1 or parts[1][0] != _OCTETS or not 16 <= parts[1][2] - parts[1][1] <= 72:
        return False
    tags = [t for t, _, _ in parts[2:]]
    if tags != sorted(set(tags)) or any(t not in (0xA0, 0xA1) for t in tags):
        return False
    inner = [_elements(data, a, b) for _, a, b in parts[2:]]
    return all(x and len(x) == 1 and x[0][0] == (_BITS if t == 0xA1 else x[0][0]) and x[0][0] in (_BITS, _OID, _SEQUENCE) for t, x in zip(tags, inner))


def _pkcs8(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Version, a known algorithm, and octets that hold a key of that algorithm."""
    if len(parts) < 3 or _small(data, parts[0]) not in (0, 1) or parts[1][0] != _SEQUENCE or parts[2][0] != _OCTETS or any(t not in (0xA0, 0xA1, 0x81) for t, _, _ in parts[3:]):
        return False
    algorithm = _elements(data, parts[1][1], parts[1][2])
    if not algorithm or algorithm[0][0] != _OID:
        return False
    kind, key = _KEY_ALGORITHMS.get(data[algorithm[0][1] : algorithm[0][2]]), data[parts[2][1] : parts[2][2]]
    inner = _sequence(key)
    if kind in ("rsa", "ec"):
        return bool(inner) and (_rsa_or_dsa if kind == "rsa" else _sec1)(key, inner)
    one = _elements(key)
    return bool(kind and one and len(one) == 1 and one[0][0] == (_INTEGER if kind == "integer" else _OCTETS) and one[0][2] - one[0][1] >= 16)


def _encrypted(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """An algorithm of password-based encryption with its parameters, and whole cipher blocks."""
    if len(parts) != 2 or parts[0][0] != _SEQUENCE or parts[1][0] != _OCTETS:
        return False
    algorithm, size = _elements(data, parts[0][1], parts[0][2]), parts[1][2] - parts[1][1]
    known = algorithm and len(algorithm) == 2 and algorithm[0][0] == _OID and algorithm[1][0] == _SEQUENCE
    return bool(known and data[algorithm[0][1] : algorithm[0][2]].startswith(_PASSWORD_BASED) and size >= 32 and size % 8 == 0)


def _pfx(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """PKCS#12: version 3, contents of a known type under an explicit tag, and a check value, if any."""
    if len(parts) not in (2, 3) or _small(data, parts[0]) != 3 or any(t != _SEQUENCE for t, _, _ in parts[1:]):
        return False
    content = _elements(data, parts[1][1], parts[1][2])
    return bool(content and len(content) == 2 and content[0][0] == _OID and data[content[0][1] : content[0][2]] in _PFX_CONTENTS and content[1][0] == 0xA0 and _elements(data, content[1][1], content[1][2]))


def _openssh(data: bytes) -> bool:
    """The fields of the OpenSSH format: cipher, key derivation, public keys, and a private part that fills the rest."""
    magic, fields = b"openssh-key-v1\0", []
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for _ in range(3):
        fields.append(string())
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if None in fields or not 1 <= count <= 16:
        return False
    keys = [string() for _ in range(count)]
    private = string()
    if None in keys or not private or at != len(data) or not all(k[4:].startswith((b"ssh-", b"ecdsa-", b"sk-")) for k in keys):
        return False
    return fields[0] != b"none" and len(private) % 8 == 0 or private[:4] == private[4:8]


def is_private_key(data: bytes) -> bool:
    """Whether bytes are, from first to last, a private key container: PKCS#1, DSA, SEC1, PKCS#8 (plain or encrypted), PKCS#12 or OpenSSH.

    Digests, public keys, certificates and other short sequences follow none of these grammars.
    """
    if data[:1] != b"\x30":
        return _openssh(data)
    parts = _sequence(data)
    return bool(parts) and any(grammar(data, parts) for grammar in (_rsa_or_dsa, _sec1, _pkcs8, _encrypted, _pfx))


def _unescaped(literal: str) -> bytes:
    """Percent and backslash escapes of a literal opened, all else kept."""
    out, at = [], 0
    for m in _ESCAPE.finditer(literal):
        out.append(literal[at : m.start()].encode())
        out.append(unquote_to_bytes(m[0]) if m[0][0] == "%" else bytes([int(m[0][2:], 16)]) if m[0][1] == "x" else chr(int(m[0][2:], 16)).encode("utf-8", "surrogatepass"))
        at = m.end()
    return b"".join([*out, literal[at:].encode()])


def _decoded(literal: str) -> Iterator[bytes]:
    """What a run of base64 or hex characters may stand for."""
    if _HEX.fullmatch(literal):
        yield binascii.unhexlify(literal)
    body = literal.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (ValueError, binascii.Error):
            return


def _as_text(data: bytes) -> str | None:
    """Printable text in UTF-8, or in UTF-16 where every other byte is zero."""
    wide = len(data) % 2 == 0 and len(data) > 8 and data[1::2].count(0) > len(data) * 3 // 8
    try:
        text = data.decode("utf-16-le" if wide else "utf-8")
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or all(c.isprintable() or c in "\r\n\t\ufeff" for c in text) else None


def _holds(data: bytes) -> str:
    """The rule by which decoded bytes hold a credential, at any depth of further layers; "" if they hold none."""
    if is_private_key(data):
        return "encoded key"
    inner = _as_text(data)
    return "encoded" if inner and any(True for _ in _scan(inner, True)) else ""


def _layers(text: str) -> Iterator[Hit]:
    """Encoded literals of a text that hold credentials. Every layer is shorter than the one it is in, so opening them ends."""
    signed = [m.span() for m in _JWT.finditer(text)] if ".eyJ" in text else []
    for m in _LITERAL.finditer(text):
        literal = m[0]
        if literal.isalpha() and (literal.islower() or literal.isupper()):
            continue
        k = bisect_right(signed, (m.start(), len(text))) - 1
        if k >= 0 and m.start() < signed[k][1]:
            continue
        rule = next(filter(None, map(_holds, _decoded(literal))), "")
        if rule:
            yield Hit(m.start(), m.end(), rule)
    if "%" in text or "\\x" in text or "\\u" in text:
        for m in _ESCAPED.finditer(text):
            if len(_ESCAPE.findall(m[0])) >= 2 and (rule := _holds(_unescaped(m[0]))):
                yield Hit(m.start(), m.end(), rule)


def _scan(text: str, config: bool) -> Iterator[Hit]:
    if "PRIVATE KEY" in text:
        for m in _BLOCK.finditer(text):
            if len(re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m[2])) >= 32:
                yield Hit(m.start(), m.end(), "key block")
    for m in _FORMATS.finditer(text):
        tail = m[0][-16:]
        if not m[0].endswith("EXAMPLE") and not re.search(r"(?i)(.)\1{6,}|your|xxxx", tail):
            yield Hit(m.start(), m.end(), "format")
    if "://" in text:
        for m in _URL.finditer(text):
            if not stands_in(m[2]) and not re.fullmatch(r"(?i)(?:\{.*\}|\$.*|%s|pass|pw|password|secret|token|pwd)", m[2]) and "{" not in m[2]:
                yield Hit(m.start(2), m.end(2), "url")
    for pattern, rule, random in ((_PAIR, "pair", False), (_NETRC, "netrc", False), (_HEADER, "header", True), (_COMMAND, "command", True), (_SQL, "sql", False), (_QUERY, "query", True)):
        for m in pattern.finditer(text):
            value = m[1]
            if not stands_in(value) and (looks_random(value) if random else len(value) >= 4) and "(" not in value:
                yield Hit(m.start(1), m.end(1), rule)
    yield from _named(text, config)
    yield from _prose(text, config)
    if '"kty"' in text:
        for m in _JWK.finditer(text):
            yield from (Hit(m.start() + part.start(1), m.start() + part.end(1), "key object") for part in _JWK_PART.finditer(m[0]))
    yield from _layers(text)


def find(text: str, path: str | None = None) -> list[Hit]:
    """Credentials of a text, in order, the widest of overlapping ones."""
    hits = sorted(set(_scan(text, bool(path is not None and _CONFIG.search(path)))), key=lambda h: (h.start, -h.end))
    kept: list[Hit] = []
    for h in hits:
        if kept and h.start < kept[-1].end:
            if h.end <= kept[-1].end:
                continue
            if h.rule == "encoded":  # runs over the end of a plainer find: the literal as a whole is hidden
                kept[-1] = Hit(kept[-1].start, h.end, "encoded")
            continue
        kept.append(h)
    return kept


def redact(text: str, hits: list[Hit]) -> str:
    """The text with every credential's characters replaced by ``x``; length, line breaks and all else stay."""
    out, at = [], 0
    for h in hits:
        out += [text[at : h.start], re.sub(r"\\[nr]|[\r\n]|.", lambda m: m[0] if m[0][0] in "\\\r\n" and m[0] != "\\" else "x", text[h.start : h.end])]
        at = h.end
    return "".join(out) + text[at:]


def _over(chunks: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows = [r for pos, path, text in zip(pdf["chunk_pos"].tolist(), pdf["path"].tolist(), pdf["text"].tolist()) for r in rows_of(pos, path, text)]
            yield pd.DataFrame(rows, columns=names)

    wanted = chunks.select(F.col("chunk_pos").cast("long").alias("chunk_pos"), "path", "text")
    return wanted.where("chunk_pos IS NOT NULL").mapInPandas(run, schema)


def secrets(chunks: DataFrame) -> DataFrame:
    """One row per distinct credential value of a row: chunk_pos, secret.

    chunks: chunk_pos, path, text. A NULL or empty text has none; a NULL path counts as source code; repeated rows give
    their rows each; texts are scanned whole. Map-only.
    """

    def rows(pos: int, path: str | None, text: str | None) -> list[tuple]:
        return [(pos, s) for s in dict.fromkeys(text[h.start : h.end] for h in find(text, path))] if text else []

    return _over(chunks, "chunk_pos long, secret string", rows)


def redacted(chunks: DataFrame) -> DataFrame:
    """Every row with its credentials hidden: chunk_pos, text, n_secrets. NULL texts stay NULL."""

    def rows(pos: int, path: str | None, text: str | None) -> list[tuple]:
        hits = find(text, path) if text else []
        return [(pos, redact(text, hits) if hits else text, len(hits))]

    return _over(chunks, "chunk_pos long, text string, n_secrets int", rows)
