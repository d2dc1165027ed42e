"""Credentials in source code and configuration: found by place, and masked in place.

Candidates are quoted strings, assigned values and long tokens. For each, Shannon entropy over its own alphabet (digits,
hex, alphanumeric, base64) is compared with a threshold that falls short of the alphabet's maximum by an amount that
shrinks with length; under a secret's name a weaker threshold and a password shape suffice. Excluded are placeholders,
masks, references to variables and stores, names and labels, checksums, ids, public keys and certificates. Values inside
addresses, connection strings, headers and printable base64 are looked at as values of their own.

``find`` works on whole texts, one pass per row, in Arrow batches; nothing is shuffled, so skew has no effect.
``mask`` replaces every character of a credential by ``*`` except line ends and keeps length, quotes and lines.

Cases: null or empty content gives no finding; bytes that are not UTF-8 are read as Latin-1 characters in place; several
credentials on a line are one finding per line in ``found`` but each is masked; repeated rows are found each; columns other
than the id and the content are ignored.
"""

from __future__ import annotations

import base64
import binascii
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Finding(NamedTuple):
    start: int
    end: int
    kind: str


# --- names ---------------------------------------------------------------------------------------------------------
# Fixed words: how secrets are named in code, in some languages.
SECRET_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "pass", "pw", "kennwort", "passwort", "contrasena", "contraseña", "motdepasse", "motpasse", "senha",
    "secret", "credential", "credentials", "creds", "apikey", "accesskey", "privatekey", "encryptionkey", "signingkey", "secretkey", "authkey", "accountkey", "sharedkey", "storagekey", "masterkey", "apitoken", "token", "authorization", "auth", "bearer", "jwt", "dsn", "connectionstring",
)
# Fixed words: with one of these as a part of a name, the value is about a secret and not one.
ABOUT_WORDS = frozenset(
    "id ids name names label labels file path dir type types header headers env var variable field column charset alphabet pattern regex length size count max min limit tokens url uri endpoint host user username hint policy prompt placeholder message title text format template ttl expiry expires expiration timeout rotation enabled required version algorithm algo scheme mode class kind provider index options slot block map public verify verification host cache partition sort primary foreign row integrity checksum sha hash digest etag fingerprint ref reference source store manager stream estimate budget reset page form screen error".split()
)
KEY_WORDS = frozenset("api access private encryption signing secret auth account shared storage master service client deploy license admin root".split())

CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def name_parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-zA-Zñ]+", CAMEL.sub("_", name).lower()) if p]


def secret_name(name: str) -> bool:
    """Whether a value of this name would be a secret."""
    parts = name_parts(name)
    if parts and parts[-1] in ("slot", "options", "block", "map", "value", "default", "field"):
        parts = parts[:-1]
    if not parts or any(p in ABOUT_WORDS for p in parts):
        return False
    joined = "".join(parts)
    if parts[-1] in ("key", "keys"):
        return any(p in KEY_WORDS for p in parts[:-1])
    return any(p in SECRET_WORDS or p.rstrip("s") in SECRET_WORDS for p in parts) or any(joined.endswith(w) for w in SECRET_WORDS if len(w) > 4) or any(w in joined for w in SECRET_WORDS if len(w) > 7)


# --- values --------------------------------------------------------------------------------------------------------
REFERENCE = re.compile(
    r"""^(?:[$%]\{?\{?[\w.\-: ]+\}?\}?%?$|\$\(|\{\{|<[^<>]*>$|%[\w]+%$|\#\{|@\w+@$|\[[^\]]*\]$
    |(?:env|ssm|vault|secret|secrets|keyvault|file|ref|arn|gcp|sm|op|kms|config|param)s?[:/]|(?:process\.env|os\.environ|os\.getenv|ENV\[|Environment\.)|(?:/|\./|~/|[A-Z]:\\)[\w./\\\-]+$)""",
    re.VERBOSE | re.IGNORECASE,
)
PLACEHOLDER = re.compile(
    r"^(?:x+|\*+|\.+|-+|_+|0+|\?+|#+|todo|tbd|fixme|none|null|nil|undefined|true|false|yes|no|n/?a|empty|redacted|masked|hidden|removed|secret|password|passwd|pass|token|changeme|change[-_ ]?it|replace[-_ ]?\w*|example|sample|dummy|test|testing|default|foo|bar|foobar|bearer|basic|user|username|placeholder)$"
    r"|your[-_ ]|[-_ ]here$|insert[-_ ]|change[-_ ]?me|replace[-_ ]?(?:me|this|with)|put[-_ ]|enter[-_ ]|example|placeholder|redacted|x{6,}|X{6,}|\*{4,}|dummy|not[-_ ]?a[-_ ]?real|1234567890|abcdefghij|ABCDEFGHJKLM|0123456789|^(.)\1+$",
    re.IGNORECASE,
)
UUID = re.compile(r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$")
HEX = re.compile(r"^[0-9a-fA-F]+$")
BASE64 = re.compile(r"^[A-Za-z0-9+/_\-]+={0,2}$")
PUBLIC = re.compile(r"^(?:sha(?:1|224|256|384|512)[-:]|md5[-:]|ssh-(?:rsa|ed25519|dss)|ecdsa-|data:|https?://[^\s:@/]+(?:[:/?#]|$)|-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST)|\^|[\w.]+\.(?:py|go|cs|js|ts|json|ya?ml|toml|xml|pem|key|crt|txt)$)", re.IGNORECASE)
WORDY = re.compile(r"^[A-Za-z][a-z]*(?:[-_./: ][A-Za-z]?[a-z]*)*$|^[A-Z]+(?:_[A-Z]+)*$|^[a-z]+(?:[A-Z][a-z]+)*$")


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def alphabet_bits(value: str) -> float:
    if value.isdigit():
        return math.log2(10)
    if HEX.match(value):
        return 4.0
    if value.isalnum():
        return math.log2(62)
    return 6.0 if BASE64.match(value) else math.log2(94)


def random_looking(value: str, slack: float = 0.0) -> bool:
    """Entropy against what a random text of this length and alphabet shows on average, less a margin falling with length."""
    n = len(value)
    if n < 8:
        return False
    size = 2 ** alphabet_bits(value)
    expected = math.log2(size) - max(0.0, math.log2(size / n)) - min(n, size) / (2 * max(n, size)) * 1.0
    margin = 0.35 + 4.0 / n + slack
    return entropy(value) >= expected - margin


def placeholder(value: str) -> bool:
    return bool(REFERENCE.search(value) or PLACEHOLDER.search(value))


def password_shape(value: str) -> bool:
    """Of a kind people choose: letters with digits or marks, without spaces."""
    if not 6 <= len(value) <= 128 or re.search(r"\s", value):
        return False
    classes = bool(re.search(r"[a-z]", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^A-Za-z0-9]", value))
    return classes >= 2 and bool(re.search(r"\d", value) or re.search(r"[!?*#@%&+=^~$]", value))


def secret_value(value: str) -> bool:
    """Whether a value under a secret's name is a literal secret."""
    if len(value) < 6 or placeholder(value) or PUBLIC.search(value) or UUID.match(value) or WORDY.match(value):
        return False
    if " " in value or re.search(r"[(){}\[\]<>;,]", value):
        return False
    if re.match(r"^[a-z_]+:\d+$", value) or re.match(r"^\d{1,9}$", value):
        return False
    return random_looking(value, 0.25) if len(value) >= 24 else password_shape(value) or random_looking(value)


# --- places --------------------------------------------------------------------------------------------------------
# Fixed formats of widely used services.
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w\-]{20,}|xox[abprs]-[\w\-]{16,}|(?:sk|rk|pk)_(?:live|test|prod)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|AIza[\w\-]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|[a-z]{2,8}_(?:prod|live|stage|test|dev)_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9\-]{24,}|eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{8,})(?![A-Za-z0-9])"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END [A-Z0-9 ]+-----")
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.\-]{1,20}://([^\s:/@'\"<>`]*):([^\s/'\"`]+?)@(?=[\w\[$%{<])", re.IGNORECASE)
CONNECTION = re.compile(r"(?<![\w\-])(?:password|pwd|passwd|accountkey|sharedaccesskey|access_token|api_key|apikey|token|secret)\s{0,2}=\s{0,2}([^;\s'\"`&,]{4,})", re.IGNORECASE | re.MULTILINE)
SCHEME = re.compile(r"\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/=_\-.~]{8,})")
QUOTES = re.compile(r"""(\"\"\"|'''|["'`])((?:\\.|(?!\1)[^\\])*?)\1""")
JOINED = re.compile(r"[ \t]*\+[ \t]*")
# the name before a value, read at the end of what precedes it
BEFORE = re.compile(r"""(?P<name>[A-Za-z_ñÑ$@\-][\w\-.ñÑ$]*(?:[ ][A-Za-z_][\w\-]*){0,8})["'`\])}*]{0,4}[ \t]*(?:=>|:=|\?\?=|=|:|,|\||>|\(|[ \t])[ \t]*(?:[A-Za-z_.<>]{0,30}[(\[{][ \t]*)?[rbufRBUF@$]{0,2}$""")
TYPED = re.compile(r"[ \t]*:[ \t]*[\w<>\[\]|.? ]{1,40}(?==[ \t]*[rbufRBUF@$]{0,2}$)|[ \t]*\{[ \t]*get;[^}]*\}")
OPENS = re.compile(r"\b(?:open|connect|login|dial|authenticate|signin)\w{0,12}\([^()]*,[ \t]*[rbufRBUF@$]{0,2}$", re.IGNORECASE)
BARE = re.compile(r"""^[ \t]*(?:[#/*;+>|\-]{1,3}[ \t]*)?(?:export[ \t]+|set[ \t]+|-e[ \t]+|old[ \t]+)?["'`]?(?P<name>[A-Za-z_][\w\-. ]{1,60}?)["'`]?[ \t]*(?:=|:)[ \t]*(?P<value>[^\s"'`]{6,}?)[;,]?(?:[ \t]+[(#/].*)?\r?$""")
ATTRIBUTE = re.compile(r"""\b(?:key|name)="(?P<name>[\w\-.]+)"[ \t]+value="(?P<value>[^"]{4,})\"""")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z][\w\-.]{1,60})>(?P<value>[^<>\s][^<>\n]{3,})</")
HEADER = re.compile(r"^(?P<name>[A-Za-z][\w\-]{1,40}):[ \t]*(?P<value>\S{4,})$")
PAIR_NAME = re.compile(r"^[ \t-]*[\"']?(?:name|key)[\"']?[ \t]*:[ \t]*[\"']?(?P<name>[\w\-.]+)[\"']?,?[ \t]*\r?$")
PAIR_VALUE = re.compile(r"^[ \t]*[\"']?(?:value|val)[\"']?[ \t]*:[ \t]*[\"']?(?P<value>[^\s\"']{4,})[\"']?,?[ \t]*\r?$")
LONG = re.compile(r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/=_\-])")
# parts of every secret's name: only lines with one of them are looked at by name
HINTS = ("pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "kennwort", "contrase", "mot_de", "motde", "mot-de", "mot de", "senha", "dsn", "bearer", "jwt", "connectionstring")
LOGIN = ("open(", "connect(", "login(", "dial(", "authenticate(")


UNPRINTABLE = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def decoded(value: str) -> str | None:
    """Printable text behind base64, if that is what it is."""
    if len(value) < 8 or not BASE64.match(value):
        return None
    try:
        raw = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    if len(raw) < 6 or UNPRINTABLE.search(raw):
        return None
    try:
        plain = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return plain if plain.isascii() or all(c.isprintable() or c in "\t\n\r\ufeff" for c in plain) else None


def inner(text: str, at: int, findings: list[Finding], depth: int = 0) -> None:
    """Credentials that show by themselves, whatever they stand under."""
    for m in PROVIDER.finditer(text):
        value = m[0]
        body = re.split(r"[_\-.]", value, maxsplit=1)[-1] if not value.startswith(("AKIA", "ASIA", "AIza", "eyJ")) else value[4:]
        if not re.search(r"x{5,}|X{5,}|\*{3,}|\.{3,}|EXAMPLE", value) and entropy(body) > 2.6:
            findings.append(Finding(at + m.start(), at + m.end(), "provider_token"))
    for m in PRIVATE.finditer(text) if "PRIVATE KEY" in text else ():
        end = PRIVATE_END.search(text, m.end())
        body = text[m.end() : end.start() if end else len(text)]
        if len(re.sub(r"[^A-Za-z0-9+/]", "", body)) >= 24 and not re.search(r"\.\.\.|x{8,}|X{8,}|\*{6,}|<[^>]*>|\$\{", body):
            findings.append(Finding(at + m.start(), at + (end.end() if end else len(text)), "private_key"))
    for m in ADDRESS.finditer(text) if "://" in text and "@" in text else ():
        if address_password(m[2]):
            findings.append(Finding(at + m.start(2), at + m.end(2), "address"))
    for m in CONNECTION.finditer(text) if any(w in text.lower() for w in ("password=", "pwd=", "passwd=", "key=", "token=", "secret=", "password =", "pwd =")) else ():
        if not placeholder(m[1]) and (password_shape(m[1]) or random_looking(m[1])):
            findings.append(Finding(at + m.start(1), at + m.end(1), "connection"))
    for m in SCHEME.finditer(text) if "Basic " in text or "Bearer " in text or "Token " in text else ():
        plain = decoded(m[2]) if m[1] == "Basic" else None
        if plain is not None:
            user, colon, password = plain.partition(":")
            if colon and address_password(password):
                findings.append(Finding(at + m.start(2), at + m.end(2), "header"))
        elif m[1] != "Basic" and secret_value(m[2]):
            findings.append(Finding(at + m.start(2), at + m.end(2), "header"))
    if depth == 0:
        for m in LONG.finditer(text):
            plain = decoded(m[0])
            if plain is not None:
                hidden: list[Finding] = []
                inner(plain, 0, hidden, 1)
                named(plain, 0, hidden)
                unnamed(plain, 0, hidden)
                if hidden:
                    findings.append(Finding(at + m.start(), at + m.end(), "encoded"))


def address_password(value: str) -> bool:
    value = html.unescape(value)
    return len(value) >= 4 and not placeholder(value) and not re.search(r"[${}<>%]{2}|^[<$%{]|^\*+$", value) and value.lower() not in ("postgres", "root", "admin", "guest", "rabbit", "user", "mysql", "redis")


def before(prefix: str) -> str:
    m = BEFORE.search(TYPED.sub(" ", prefix[-160:]))
    return " ".join(word.rsplit(".", 1)[-1] for word in m["name"].split()) if m else ""


def is_secret_name(phrase: str) -> bool:
    """A name, or a phrase of prose with one ("db pass for the stage box")."""
    if secret_name(phrase.split()[-1] if phrase.split() else ""):
        return True
    return " " in phrase and secret_name(phrase)


def line_findings(line: str, at: int, previous: str, findings: list[Finding]) -> None:
    """Values under a secret's name, and values that show by themselves, in one line."""
    parts: list[tuple[int, int]] = []
    pieces: list[tuple[str, list[tuple[int, int]], int]] = []
    for m in QUOTES.finditer(line):
        span = (m.start(2), m.end(2))
        if pieces and JOINED.fullmatch(line, pieces[-1][1][-1][1] + len(m[1]), m.start()):
            text, parts, begin = pieces[-1]
            pieces[-1] = (text + m[2], [*parts, span], begin)
        else:
            pieces.append((m[2], [span], m.start()))
    for value, parts, begin in pieces:
        if len(value) < 4:
            continue
        hits: list[Finding] = []
        if len(parts) > 1:
            inner(value, 0, hits)
        header = HEADER.match(value)
        if not hits and header and secret_name(header["name"]) and literal(header["value"]):
            start = at + parts[0][0] + header.start("value")
            findings.append(Finding(start, start + len(header["value"]), "named"))
            continue
        prefix = line[max(0, begin - 400) : begin]
        if hits or literal(value) and (is_secret_name(before(prefix)) or OPENS.search(prefix) and opening(value)):
            findings += [Finding(at + s, at + e, "named") for s, e in parts if e > s]
    for pattern in (ATTRIBUTE, ELEMENT):
        for m in pattern.finditer(line):
            if secret_name(m["name"]) and literal(html.unescape(m["value"])):
                findings.append(Finding(at + m.start("value"), at + m.end("value"), "named"))
    m = BARE.match(line)
    if m and is_secret_name(m["name"].strip()) and literal(m["value"]) and not re.search(r"[()]|\.\w+\(|^[a-zA-Z]\w*(?:\.[a-zA-Z]\w*)+$", m["value"]):
        findings.append(Finding(at + m.start("value"), at + m.end("value"), "named"))
    value = PAIR_VALUE.match(line)
    if value:
        name = PAIR_NAME.match(previous)
        if name and secret_name(name["name"]) and literal(value["value"]):
            findings.append(Finding(at + value.start("value"), at + value.end("value"), "named"))


def opening(value: str) -> bool:
    """Whether an unnamed argument of a login-like call is a secret by itself: identifiers and digests look random too."""
    return not HEX.match(value) and (not value.isalnum() or not 15 <= len(value) <= 23 or bool(re.fullmatch(r"(?:[A-Z]?[a-z]{3,})+\d{1,4}", value)))


# Fixed words: values of these names are random and open to all.
OPEN_WORDS = ABOUT_WORDS | frozenset("commit revision rev cert certificate md uuid guid signature sig etag nonce trace span request correlation cursor chunk data image icon font sourcemap wasm buffer seed salt oid thumbprint tag snapshot".split())
ARMOUR = re.compile(r"-----BEGIN (?:(?!PRIVATE)[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST|MESSAGE|SIGNATURE)-----.*?(?:-----END|\Z)", re.DOTALL)
MARKS = "!#$%&*?@^~"
# a quoted value with marks that neither base64 nor a path has, and nothing that separates
MARKED = re.compile(r"""(?P<q>["'`])(?=[^"'`\n]*[!#$%&*?@^~])(?P<value>[A-Za-z0-9!#$%&*+\-.=?@^_~|]{16,})(?P=q)""")
WRAPPED_FROM = 64  # characters of a literal that has its line for itself: from here on it is data stored as code
RUN = re.compile(r"""(["'])(?:(?!\1)[^\\\n])*\1(?:\s*\+\s*(["'])(?:(?!\2)[^\\\n])*\2)+""")
ENTRY = re.compile(r"""[ \t]*[+(\[]?[ \t]*[rbufRBUF@$]{0,2}(?:(?P<q>["'`])(?:(?!(?P=q)).)*(?P=q)[ \t]*[,+.;)\]\\]*[ \t]*|[A-Za-z0-9+/=_\-]{20,}\\?)\r?""")


def scattered(value: str) -> bool:
    """Whether letters and digits change as often as by chance; a capital that begins a word is no change."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in value if c.isalnum()]
    changes = sum(a != b and (a, b) != ("u", "l") for a, b in zip(kinds, kinds[1:]))
    return "d" in kinds and len(set(kinds)) > 1 and changes >= 0.22 * len(kinds)


def unnamed(text: str, at: int, findings: list[Finding]) -> None:
    """Quoted strings and long tokens that are random by their entropy alone, whatever their name, unless it says they are open."""
    for m in RUN.finditer(text) if re.search(r"""["']\s*\+\s*["']""", text) else ():
        spans = [q.span(2) for q in QUOTES.finditer(text, m.start(), m.end())]
        value = "".join(text[a:b] for a, b in spans)
        hits: list[Finding] = []
        inner(value, 0, hits, 1)
        if hits:
            findings += [Finding(at + a, at + b, "joined") for a, b in spans if b > a]
    for m in MARKED.finditer(text):
        value = m["value"]
        if sum(c in MARKS for c in value) > len(value) // 3 or re.search(r"[?&]\w+=", value) or not scattered(value) or not random_looking(value) or not secret_value(value):
            continue
        name = before(text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - 400) : m.start()])
        if not any(p in OPEN_WORDS for p in name_parts(name)):
            findings.append(Finding(at + m.start("value"), at + m.end("value"), "random"))
    armour: list[tuple[int, int]] | None = None
    for m in LONG.finditer(text):
        value = m[0]
        if HEX.match(value) or value.isalnum() and len(value) <= 23 or not scattered(value) or not random_looking(value) or not secret_value(value):
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        if ENTRY.fullmatch(text, start, end):  # a line of a table of literals or of wrapped data, beside another one or as long as those are
            if len(value) >= WRAPPED_FROM:
                continue
            above = text.rfind("\n", 0, max(0, start - 1)) + 1
            below = text.find("\n", end + 1)
            if start and ENTRY.fullmatch(text, above, start - 1) or end < len(text) and ENTRY.fullmatch(text, end + 1, len(text) if below < 0 else below):
                continue
        lead = text[max(start, m.start() - 400) : m.start()]
        quoted = re.search(r"""["'`]$""", lead) is not None
        if not quoted and not re.search(r"(?:^|[=:,>(|][ \t]*|[ \t])$", lead) or not quoted and not re.match(r"""[\s;,)<|"'`]|$""", text[m.end() : m.end() + 1]):
            continue
        if quoted and text[m.end() : m.end() + 1] != lead[-1]:
            continue
        if re.search(r"(?:ssh-\w+|ecdsa-[\w\-]+|base64,|sha\d{1,3}[-:=]|://\S*)[ \t]*$", lead, re.IGNORECASE):
            continue
        name = before(lead[:-1] if quoted else lead)
        if any(p in OPEN_WORDS for p in name_parts(name)):
            continue
        if armour is None:
            armour = [a.span() for a in ARMOUR.finditer(text)] if "-----BEGIN" in text else []
        if not any(a <= m.start() < b for a, b in armour):
            findings.append(Finding(at + m.start(), at + m.end(), "random"))


def named(text: str, at: int, findings: list[Finding]) -> None:
    """Values under a secret's name, in the lines that have a word of the kind (and the line after a name of its own)."""
    low = text.lower()
    starts = set()
    for hint in (*HINTS, *LOGIN):
        place = low.find(hint)
        while place >= 0:
            starts.add(low.rfind("\n", 0, place) + 1)
            end = low.find("\n", place)
            place = low.find(hint, end) if end >= 0 else -1
    for start in sorted(starts):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        line = text[start:end]
        line_findings(line, at + start, "", findings)
        if PAIR_NAME.match(line):
            stop = text.find("\n", end + 1)
            stop = len(text) if stop < 0 else stop
            line_findings(text[end + 1 : stop], at + end + 1, line, findings)


def literal(value: str) -> bool:
    """A secret, plain or as the base64 of one; the base64 of a placeholder is none."""
    plain = decoded(value) if len(value) >= 8 and not HEX.match(value) else None
    if plain is not None and plain.strip():
        opened = secret_value(plain.strip()) or bool(PROVIDER.search(plain)) and not PLACEHOLDER.search(plain) or any(address_password(m[2]) for m in ADDRESS.finditer(plain))
        if opened or plain.isascii():  # beyond ASCII, random bytes may be text by chance
            return opened
    return secret_value(value)


def find(text: str) -> list[Finding]:
    """The credentials of a text, by place, without overlaps."""
    findings: list[Finding] = []
    if text:
        inner(text, 0, findings)
        named(text, 0, findings)
        unnamed(text, 0, findings)
    findings.sort(key=lambda f: (f.start, -f.end))
    kept: list[Finding] = []
    for f in findings:
        if kept and f.start < kept[-1].end:
            if f.end > kept[-1].end:
                kept[-1] = Finding(kept[-1].start, f.end, kept[-1].kind)
            continue
        kept.append(f)
    return kept


def line_numbers(text: str, findings: list[Finding]) -> list[int]:
    out, line, at = [], 1, 0
    for f in findings:
        line += text.count("\n", at, f.start)
        at = f.start
        out.append(line)
    return out


def mask(text: str) -> str:
    """The text with every credential's characters replaced; length, lines and everything around stay."""
    parts, at = [], 0
    for f in find(text):
        parts += [text[at : f.start], re.sub(r"[^\r\n]", "*", text[f.start : f.end])]
        at = f.end
    return "".join([*parts, text[at:]]) if parts else text


def text_of(raw: bytes | str | None) -> str:
    if raw is None:
        return ""
    if isinstance(raw, str):
        return raw
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


# --- Spark ---------------------------------------------------------------------------------------------------------
def scan(table: DataFrame, row_id: str, content: str = "content") -> DataFrame:
    """One row per credential: row_id, line_no, start, length (in characters), kind."""
    schema = pa.schema([("row_id", pa.int64()), ("line_no", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text_of(raw.as_py())
                found = find(text)
                rows += [(key, line, f.start, f.end - f.start, f.kind) for f, line in zip(found, line_numbers(text, found))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return table.select(F.col(row_id).cast("bigint"), content).mapInArrow(run, "row_id bigint, line_no int, start int, length int, kind string")


def found(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines on which a credential begins: src_table, row_id, line_no."""
    parts = [scan(table, key).select(F.lit(name).alias("src_table"), "row_id", "line_no") for name, table, key in (("files", files, "file_id"), ("context_facts", facts, "fact_id"))]
    # a line with several credentials is one row
    return parts[0].unionByName(parts[1]).dropDuplicates()


def redacted(table: DataFrame, row_id: str, content: str = "content") -> DataFrame:
    """row_id, content with credentials masked (null stays null), n_masked; of rows with at least one credential."""
    binary = dict(table.dtypes)[content] == "binary"
    schema = pa.schema([("row_id", pa.int64()), ("content", pa.binary() if binary else pa.string()), ("n_masked", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = raw.as_py()
                n = len(find(text_of(value)))
                if n:
                    masked = mask(text_of(value))
                    if binary:
                        try:
                            value.decode("utf-8")
                            masked = masked.encode("utf-8")
                        except UnicodeDecodeError:
                            masked = masked.encode("latin-1")
                    rows.append((key, masked, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return table.select(F.col(row_id).cast("bigint"), content).mapInArrow(run, f"row_id bigint, content {'binary' if binary else 'string'}, n_masked int")
