"""An exact JSON reader over bytes: extents, validity, navigation, text rewriting and edits.

Documents are bytes, positions are byte offsets.  One regular expression finds
the tokens and an explicit stack follows the nesting, so depth costs no Python
stack.  Everything here runs in Python workers; the column operators use it
where Spark's own functions do not give the exact text or position.
"""

from __future__ import annotations

import json as _json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Any

MAX_DEPTH = 10_000
WHITE = b" \t\n\r"
KINDS = ("invalid", "null", "bool", "number", "string", "array", "object")

_SPACE = re.compile(rb"[ \t\n\r]*")
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_NO_BRACKET = bytes(k for k in range(256) if k not in b"[]{}")
_LOOSE_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.S)
_LITERAL = {b"t": b"true", b"f": b"false", b"n": b"null"}


class JsonError(ValueError):
    """offset is one more than the byte at fault, or 0 if unknown."""

    def __init__(self, message: str, offset: int = 0) -> None:
        super().__init__(message)
        self.message, self.offset = message, offset


class SyntaxFault(JsonError):
    pass


class TypeFault(JsonError):
    """A value that does not fit its target; field is its path."""

    def __init__(self, message: str, field: str = "", offset: int = 0) -> None:
        super().__init__(message, offset)
        self.field = field


@dataclass(frozen=True)
class Token:
    """kind: one of KINDS, or '{', '}', '[', ']', 'key'; [start, end) are its bytes; depth counts the containers around it."""

    kind: str
    start: int
    end: int
    depth: int


def _skip(data: bytes, at: int) -> int:
    return _SPACE.match(data, at).end()


def _char(data: bytes, at: int) -> str:
    b = data[at : at + 1]
    return repr(b.decode("latin-1")) if b else "end of input"


def scalar(data: bytes, at: int) -> tuple[str, int]:
    """(kind, end) of the string, number or literal at `at`."""
    b = data[at : at + 1]
    if b == b'"':
        m = _STRING.match(data, at)
        if not m:
            raise SyntaxFault(*_string_fault(data, at))
        return "string", m.end()
    if b in _LITERAL and b:
        word = _LITERAL[b]
        if data.startswith(word, at):
            return ("null" if word == b"null" else "bool"), at + len(word)
        k = at
        while k < len(data) and k - at < len(word) and data[k] == word[k - at]:
            k += 1
        if k == len(data):
            raise SyntaxFault("unexpected end of JSON input", k)
        raise SyntaxFault(f"invalid character {_char(data, k)} in literal {word.decode()}", k + 1)
    m = _NUMBER.match(data, at)
    if m:
        return "number", m.end()
    if at >= len(data):
        raise SyntaxFault("unexpected end of JSON input", len(data))
    if b == b"-":
        if at + 1 >= len(data):
            raise SyntaxFault("unexpected end of JSON input", len(data))
        raise SyntaxFault(f"invalid character {_char(data, at + 1)} in numeric literal", at + 2)
    raise SyntaxFault(f"invalid character {_char(data, at)} looking for beginning of value", at + 1)


def _string_fault(data: bytes, at: int) -> tuple[str, int]:
    k = at + 1
    while k < len(data) and data[k] != 0x22:
        if data[k] < 0x20:
            return f"invalid character {_char(data, k)} in string literal", k + 1
        if data[k] == 0x5C:
            nxt = data[k + 1 : k + 2]
            if nxt == b"u":
                for j in range(k + 2, k + 6):
                    if j >= len(data):
                        return "unexpected end of JSON input", len(data)
                    if data[j] not in b"0123456789abcdefABCDEF":
                        return f"invalid character {_char(data, j)} in \\u hexadecimal character escape", j + 1
                k += 6
                continue
            if not nxt:
                break
            if nxt not in b'"\\/bfnrt':
                return f"invalid character {_char(data, k + 1)} in string escape code", k + 2
            k += 2
            continue
        k += 1
    return "unexpected end of JSON input", len(data)


def tokens(data: bytes, at: int = 0, whole: bool = True, max_depth: int = MAX_DEPTH) -> Iterator[Token]:
    """The tokens of the value at `at`; whole: nothing but white space may follow.  SyntaxFault at the first fault."""
    stack: list[int] = []  # '{' or '['
    at = _skip(data, at)
    state = "value"  # value, first (a value or ]), key, firstkey, after
    while True:
        b = data[at : at + 1]
        if state in ("key", "firstkey"):
            if b == b"}" and state == "firstkey":
                stack.pop()
                yield Token("}", at, at + 1, len(stack))
                at, state = at + 1, "after"
            else:
                if b != b'"':
                    if not b:
                        raise SyntaxFault("unexpected end of JSON input", len(data))
                    raise SyntaxFault(f"invalid character {_char(data, at)} looking for beginning of object key string", at + 1)
                _, end = scalar(data, at)
                yield Token("key", at, end, len(stack))
                at = _skip(data, end)
                if data[at : at + 1] != b":":
                    if at >= len(data):
                        raise SyntaxFault("unexpected end of JSON input", len(data))
                    raise SyntaxFault(f"invalid character {_char(data, at)} after object key", at + 1)
                at, state = _skip(data, at + 1), "value"
                continue
        elif state in ("value", "first"):
            if b == b"{" or b == b"[":
                if len(stack) >= max_depth:
                    raise SyntaxFault("exceeded max depth", at + 1)
                yield Token(b.decode(), at, at + 1, len(stack))
                stack.append(b[0])
                at, state = _skip(data, at + 1), "firstkey" if b == b"{" else "first"
                continue
            if b == b"]" and state == "first":
                stack.pop()
                yield Token("]", at, at + 1, len(stack))
                at, state = at + 1, "after"
            else:
                kind, end = scalar(data, at)
                yield Token(kind, at, end, len(stack))
                at, state = end, "after"
        if state == "after":
            if not stack:
                if whole:
                    at = _skip(data, at)
                    if at < len(data):
                        raise SyntaxFault(f"invalid character {_char(data, at)} after top-level value", at + 1)
                return
            at = _skip(data, at)
            b = data[at : at + 1]
            inside = stack[-1]
            if b == b",":
                at, state = _skip(data, at + 1), "key" if inside == 0x7B else "value"
            elif b == (b"}" if inside == 0x7B else b"]"):
                stack.pop()
                yield Token(b.decode(), at, at + 1, len(stack))
                at += 1
            elif not b:
                raise SyntaxFault("unexpected end of JSON input", len(data))
            else:
                raise SyntaxFault(f"invalid character {_char(data, at)} after {'object key:value pair' if inside == 0x7B else 'array element'}", at + 1)


def _refuse(word: str) -> None:
    raise ValueError(word)


class _Scanner:
    """The standard library's scanner, over Latin-1 text, in which a character is a byte; made anew where it is sent to."""

    def __init__(self) -> None:
        self.scan = _json.JSONDecoder(parse_int=float, parse_constant=_refuse).scan_once

    def __reduce__(self) -> tuple:
        return _Scanner, ()


_SCANNER = _Scanner()
_PLAIN_DEPTH = 500


def _plain(data: bytes) -> str | None:
    """The document as Latin-1 text if the standard scanner takes it whole; None says nothing, the exact reader decides."""
    if data.count(b"[") + data.count(b"{") > _PLAIN_DEPTH and _depth(data) > _PLAIN_DEPTH:
        return None
    text = data.decode("latin-1")
    try:
        end = _SCANNER.scan(text, _skip(data, 0))[1]
    except (ValueError, StopIteration, RecursionError):
        return None
    return text if _skip(data, end) == len(data) else None


def _brackets(data: bytes) -> bytes:
    """The brackets outside strings."""
    return (_LOOSE_STRING.sub(b"", data) if b'"' in data else data).translate(None, _NO_BRACKET)


def _depth(data: bytes) -> int:
    """The nesting by brackets outside strings."""
    import numpy as np

    # bit 5 makes square brackets curly
    shape = np.frombuffer(_brackets(data), np.uint8) | 0x20
    return max(0, int(((shape == 0x7B).astype(np.int64) - (shape == 0x7D)).cumsum().max(initial=0)))


_WS = rb"[ \t\n\r]*+"
_SOUND = rb"(?:" + _STRING.pattern + rb"|" + _NUMBER.pattern + rb"|true|false|null)"
_KEY = _STRING.pattern + _WS + rb":" + _WS
#: A container's opening, of an object with its first key.
_OPENER = re.compile(rb"\[" + _WS + rb"|\{" + _WS + _KEY)
_OPENERS = re.compile(rb"(?:\[++" + _WS + rb"|\{" + _WS + _KEY + rb")++")
_CLOSERS = re.compile(rb"[\]}]++(?:" + _WS + rb"[\]}]++)*+")
#: Scalars with a comma after each, without and with keys.
_ITEMS = re.compile(rb"(?:" + _SOUND + _WS + rb"," + _WS + rb")++")
_MEMBERS = re.compile(rb"(?:" + _KEY + _SOUND + _WS + rb"," + _WS + rb")++")
_CLOSE = bytes.maketrans(b"[{", b"]}")


def _walk(data: bytes, max_depth: int = MAX_DEPTH) -> None:
    """Raises what tokens() raises over a whole document, but passes over runs of brackets, items and members in one step each."""
    stack = bytearray()
    at = _skip(data, 0)
    state = "value"  # as in tokens()
    while True:
        b = data[at : at + 1]
        if state in ("key", "firstkey"):
            run = _MEMBERS.match(data, at)
            if run:
                at, state = run.end(), "key"
                b = data[at : at + 1]
            if b == b"}" and state == "firstkey":
                stack.pop()
                at, state = at + 1, "after"
            else:
                if b != b'"':
                    if not b:
                        raise SyntaxFault("unexpected end of JSON input", len(data))
                    raise SyntaxFault(f"invalid character {_char(data, at)} looking for beginning of object key string", at + 1)
                _, end = scalar(data, at)
                at = _skip(data, end)
                if data[at : at + 1] != b":":
                    if at >= len(data):
                        raise SyntaxFault("unexpected end of JSON input", len(data))
                    raise SyntaxFault(f"invalid character {_char(data, at)} after object key", at + 1)
                at, state = _skip(data, at + 1), "value"
                continue
        elif state in ("value", "first"):
            if stack and stack[-1] == 0x5B:
                run = _ITEMS.match(data, at)
                if run:
                    at, state = run.end(), "value"
                    b = data[at : at + 1]
            if b == b"{" or b == b"[":
                run = _OPENERS.match(data, at)
                shape = _brackets(run[0]) if run else b
                if len(stack) + len(shape) > max_depth:
                    fit = max_depth - len(stack)
                    if len(shape) < len(run[0] if run else b):
                        at = next(islice(_OPENER.finditer(data, at), fit, None)).start()
                    else:
                        at += fit
                    raise SyntaxFault("exceeded max depth", at + 1)
                stack += shape
                if run:
                    at, state = run.end(), "first" if shape.endswith(b"[") else "value"
                else:
                    at, state = _skip(data, at + 1), "firstkey"
                continue
            if b == b"]" and state == "first":
                stack.pop()
                at, state = at + 1, "after"
            else:
                _, at = scalar(data, at)
                state = "after"
        if state == "after":
            at = _skip(data, at)
            if not stack:
                if at < len(data):
                    raise SyntaxFault(f"invalid character {_char(data, at)} after top-level value", at + 1)
                return
            b = data[at : at + 1]
            inside = stack[-1]
            if b == b",":
                at, state = _skip(data, at + 1), "key" if inside == 0x7B else "value"
            elif b == (b"}" if inside == 0x7B else b"]"):
                run = _CLOSERS.match(data, at)
                shape = run[0] if run.end() - at == 1 else run[0].translate(None, WHITE)
                wanted = bytes(stack[: -len(shape) - 1 : -1]).translate(_CLOSE)
                if shape == wanted:
                    at = run.end()
                else:
                    # as many as fit; what comes then is looked at on its own
                    fit = next((k for k, (x, y) in enumerate(zip(shape, wanted, strict=False)) if x != y), min(len(shape), len(wanted)))
                    shape = shape[:fit]
                    for _ in shape:
                        at = _skip(data, at) + 1
                del stack[len(stack) - len(shape) :]
            elif not b:
                raise SyntaxFault("unexpected end of JSON input", len(data))
            else:
                raise SyntaxFault(f"invalid character {_char(data, at)} after {'object key:value pair' if inside == 0x7B else 'array element'}", at + 1)


def check(data: bytes) -> JsonError | None:
    """The first fault of a document, or None."""
    if _plain(data) is not None:
        return None
    try:
        _walk(data)
    except JsonError as e:
        return e
    return None


def valid(data: bytes) -> bool:
    return check(data) is None


def value_end(data: bytes, at: int, max_depth: int = MAX_DEPTH) -> int:
    """Where the value at `at` ends, checked."""
    end = at
    for t in tokens(data, at, whole=False, max_depth=max_depth):
        end = t.end
    return end


def first_extent(data: bytes) -> tuple[int, int] | None:
    """[start, end) of the first value, by quotes and brackets only, if all of the input's quotes and brackets match."""
    depth, at, start, end, stack = 0, 0, -1, -1, []
    while at < len(data):
        b = data[at : at + 1]
        if b in (b" ", b"\t", b"\n", b"\r"):
            at += 1
            continue
        if start < 0:
            start = at
        if b == b'"':
            m = _LOOSE_STRING.match(data, at)
            if not m:
                return None
            at = m.end()
        elif b in (b"{", b"["):
            stack.append(b)
            depth += 1
            at += 1
            continue
        elif b in (b"}", b"]"):
            if not stack or (stack.pop() == b"{") != (b == b"}"):
                return None
            depth -= 1
            at += 1
        elif b in (b",", b":"):
            if end < 0 and depth == 0:
                end = at if start < at else -1
                if end < 0:
                    return None
            at += 1
            continue
        else:
            while at < len(data) and data[at] not in b' \t\n\r"{}[],:':
                at += 1
        if depth == 0 and end < 0:
            end = at
    return (start, end) if start >= 0 and end > start and not stack else None


# --- strings and numbers ----------------------------------------------------------------------

_ESCAPES = {0x22: '"', 0x5C: "\\", 0x2F: "/", 0x62: "\b", 0x66: "\f", 0x6E: "\n", 0x72: "\r", 0x74: "\t"}


def repair(data: bytes) -> str:
    """UTF-8 text; each byte that is no part of a valid sequence becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode())
                out.append("�")
                at += e.start + 1
        return "".join(out)


def unquote(raw: bytes) -> str:
    """The text of a string literal; surrogate halves that stand alone become U+FFFD."""
    body = raw[1:-1]
    if b"\\" not in body:
        return repair(body)
    out, at = [], 0
    while True:
        k = body.find(b"\\", at)
        if k < 0:
            out.append(repair(body[at:]))
            return "".join(out)
        out.append(repair(body[at:k]))
        c = body[k + 1]
        if c != 0x75:
            out.append(_ESCAPES.get(c, chr(c)))
            at = k + 2
            continue
        code, at = int(body[k + 2 : k + 6], 16), k + 6
        if 0xD800 <= code < 0xDC00 and body[at : at + 2] == b"\\u":
            low = int(body[at + 2 : at + 6], 16)
            if 0xDC00 <= low < 0xE000:
                out.append(chr(0x10000 + (code - 0xD800 << 10) + low - 0xDC00))
                at += 6
                continue
        out.append("�" if 0xD800 <= code < 0xE000 else chr(code))


_QUOTE = {0x22: '\\"', 0x5C: "\\\\", 0x08: "\\b", 0x0C: "\\f", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}
_QUOTE |= {k: f"\\u{k:04x}" for k in range(0x20) if k not in _QUOTE}
HTML = {0x3C: "\\u003c", 0x3E: "\\u003e", 0x26: "\\u0026", 0x2028: "\\u2028", 0x2029: "\\u2029"}
_LINES = {k: HTML[k] for k in (0x2028, 0x2029)}


def quote(text: str | bytes, html: bool = True) -> str:
    """A string literal; bytes that are no UTF-8 become the escape of U+FFFD."""
    if isinstance(text, bytes):
        try:
            text = text.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(text):
                try:
                    out.append(quote(text[at:].decode(), html)[1:-1])
                    break
                except UnicodeDecodeError as e:
                    out.append(quote(text[at : at + e.start].decode(), html)[1:-1] + "\\ufffd")
                    at += e.start + 1
            return '"' + "".join(out) + '"'
    return '"' + text.translate(_QUOTE | (HTML if html else _LINES)) + '"'


def float_text(x: float, single: bool = False) -> str:
    """The shortest digits that read back the same: plain from 1e-6 to 1e21, else with an exponent without padding."""
    if x != x or x in (float("inf"), float("-inf")):
        raise JsonError(f"unsupported value: {x}")
    if single:
        import numpy as np

        digits = np.format_float_scientific(np.float32(x), unique=True, trim="-")
    else:
        digits = repr(float(x))
        if "e" not in digits:
            from decimal import Decimal

            digits = f"{Decimal(digits):e}"
    sign = "-" if digits[0] == "-" else ""
    mantissa, _, exponent = digits.lstrip("-").partition("e")
    whole, _, part = mantissa.partition(".")
    figures, power = (whole + part).rstrip("0") or "0", int(exponent)
    if figures == "0" or whole == "0":
        return sign + "0"
    if x and (abs(x) < 1e-6 or abs(x) >= 1e21):
        return f"{sign}{figures[0]}{'.' + figures[1:] if len(figures) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):0{1 if power < 0 else 2}d}"
    if power < 0:
        return sign + "0." + "0" * (-power - 1) + figures
    if len(figures) <= power + 1:
        return sign + figures + "0" * (power + 1 - len(figures))
    return sign + figures[: power + 1] + "." + figures[power + 1 :]


# --- navigation -------------------------------------------------------------------------------


def kind_at(data: bytes, at: int) -> str:
    b = data[at : at + 1]
    return {b"{": "object", b"[": "array", b'"': "string", b"t": "bool", b"f": "bool", b"n": "null"}.get(b, "number" if b and b in b"-0123456789" else "invalid")


def members(data: bytes, at: int, plain: str | None = None) -> Iterator[tuple[tuple[int, int] | None, int, int]]:
    """(extent of the key or None, start, end) of each child of the container at `at`, in document order, duplicates too.

    plain: what _plain gave for the document, whose scalars and containers are then passed over in one step.
    """
    if plain is not None:
        key, is_object = None, data[at] == 0x7B
        at = _skip(data, at + 1)
        while data[at] not in b"]}":
            if is_object:
                key = (at, _STRING.match(data, at).end())
                at = _skip(data, _skip(data, key[1]) + 1)
            end = _SCANNER.scan(plain, at)[1]
            yield key, at, end
            at = _skip(data, end)
            if data[at] == 0x2C:
                at = _skip(data, at + 1)
        return
    base, key, start = None, None, -1
    for t in tokens(data, at, whole=False):
        if base is None:
            base = t.depth
            continue
        if t.depth == base + 1:
            if t.kind == "key":
                key = (t.start, t.end)
            elif t.kind in "{[":
                start = t.start
            elif t.kind in "}]":
                yield key, start, t.end
                key = None
            else:
                yield key, t.start, t.end
                key = None


_PARTS: dict[str, tuple[str, ...]] = {}


def _parts(path: str) -> tuple[str, ...]:
    if path not in _PARTS:
        if len(_PARTS) >= 1024:
            _PARTS.clear()
        _PARTS[path] = tuple(split_path(path))
    return _PARTS[path]


def split_path(path: str) -> list[str]:
    """The dotted parts with their escapes; '' is the root and a last dot is nothing."""
    if not path:
        return []
    parts, now, at = [], [], 0
    while at < len(path):
        c = path[at]
        if c == "\\" and at + 1 < len(path):
            now.append(path[at : at + 2])
            at += 2
            continue
        if c == ".":
            parts.append("".join(now))
            now = []
        else:
            now.append(c)
        at += 1
    if now:
        parts.append("".join(now))
    return parts


def unescape_part(part: str) -> str:
    return re.sub(r"\\(.)", r"\1", part, flags=re.S)


def part_index(part: str) -> int | None:
    return int(part) if part.isascii() and part.isdigit() and int(part) < 1 << 63 else None


def is_wild(part: str) -> bool:
    return "*" in part or "?" in part


def glob(part: str) -> re.Pattern[bytes]:
    """* is any run and ? any one byte."""
    raw = unescape_part(part).encode()
    return re.compile(b"".join({0x2A: b".*", 0x3F: b"."}.get(c, re.escape(bytes([c]))) for c in re.sub(rb"\*+", b"*", raw)), re.S)


def glob_match(pattern: bytes, text: bytes) -> bool:
    """Without a regular expression's backtracking: one star is remembered at a time."""
    p = t = 0
    star, mark = -1, 0
    while t < len(text):
        if p < len(pattern) and pattern[p] == 0x2A:
            star, mark = p, t
            p += 1
        elif p < len(pattern) and (pattern[p] == 0x3F or pattern[p] == text[t]):
            p, t = p + 1, t + 1
        elif star >= 0:
            mark += 1
            p, t = star + 1, mark
        else:
            return False
    return all(c == 0x2A for c in pattern[p:])


def step(data: bytes, at: int, part: str, plain: str | None = None) -> tuple[int, int] | None:
    """The extent of the child that a path part names: the first field of that name or glob, or the element of that number."""
    kind = kind_at(data, at)
    if kind not in ("object", "array"):
        return None
    if kind == "array":
        n = 0 if is_wild(part) else part_index(unescape_part(part))
        if n is None:
            return None
        for k, (_, a, z) in enumerate(members(data, at, plain)):
            if k == n:
                return a, z
        return None
    wild, name = is_wild(part), unescape_part(part)
    pattern = name.encode() if wild else b""
    for key, a, z in members(data, at, plain):
        text = unquote(data[key[0] : key[1]])
        if glob_match(pattern, text.encode()) if wild else text == name:
            return a, z
    return None


def find(data: bytes, path: str) -> tuple[int, int] | None:
    """The extent of the value at a path of a document, None if there is none or the document is invalid."""
    try:
        at, plain = _skip(data, 0), _plain(data)
        end = len(data.rstrip(WHITE)) if plain is not None else value_end(data, at)
        if _skip(data, end) != len(data):
            return None
        here = (at, end)
        for part in _parts(path):
            got = step(data, here[0], part, plain)
            if got is None:
                return None
            here = got
        return here
    except JsonError:
        return None


# --- text to text -----------------------------------------------------------------------------


def compact(data: bytes) -> bytes:
    return b"".join(_pieces(data))


def _pieces(data: bytes) -> Iterator[bytes]:
    open_before = True  # nothing to part with a comma yet
    for t in tokens(data):
        if t.kind in ("}", "]"):
            yield data[t.start : t.end]
            open_before = False
            continue
        if not open_before:
            yield b","
        yield data[t.start : t.end]
        if t.kind == "key":
            yield b":"
        open_before = t.kind in ("{", "[", "key")


def indent(data: bytes, prefix: bytes = b"", by: bytes = b"\t") -> bytes:
    """One element a line, ': ' after keys, empty containers closed; white space before the value goes, that after it stays."""
    out: list[bytes] = []
    opened, before, end = False, True, 0
    for t in tokens(data):
        if t.kind in ("}", "]"):
            if not opened:
                out.append(b"\n" + prefix + by * t.depth)
            out.append(data[t.start : t.end])
            opened, before = False, False
        else:
            if opened or not before:
                out.append((b"" if opened else b",") + b"\n" + prefix + by * t.depth)
            out.append(data[t.start : t.end])
            if t.kind == "key":
                out.append(b": ")
            opened = t.kind in ("{", "[")
            before = t.kind == "key"
        end = t.end
    return b"".join(out) + data[end:]


def escape_html(data: bytes) -> bytes:
    for k, v in HTML.items():
        data = data.replace(chr(k).encode(), v.encode())
    return data


# --- edits ------------------------------------------------------------------------------------


def _build(parts: Sequence[str], raw: bytes) -> bytes:
    """The tail of a path that does not exist yet, around the value."""
    for k in range(len(parts) - 1, -1, -1):
        name = unescape_part(parts[k])
        n = part_index(name)
        if n is not None or name == "-1":
            if name != "-1" and n != 0:
                raise JsonError(f"index {name} is past the end of a new array")
            raw = b"[" + raw + b"]"
        else:
            raw = b"{" + quote(name, html=False).encode() + b":" + raw + b"}"
    return raw


def set_raw(data: bytes, path: str, raw: bytes) -> bytes:
    """The document with the value at path replaced or put in; all other bytes stay."""
    if not path:
        raise JsonError("the path is empty")
    parts = _parts(path)
    if any(is_wild(p) for p in parts):
        raise JsonError("a path with wildcards cannot be set")
    try:
        path.encode()
    except UnicodeEncodeError:
        raise JsonError("the path is not UTF-8") from None
    fault = check(raw)
    if fault:
        raise JsonError(f"the new value: {fault.message}", fault.offset)
    plain = _plain(data)
    fault = check(data) if plain is None else None
    if fault:
        raise fault
    raw = raw.strip(WHITE)
    at, end = _skip(data, 0), len(data.rstrip(WHITE))
    for k, part in enumerate(parts):
        kind, name = kind_at(data, at), unescape_part(part)
        if kind not in ("object", "array"):
            raise JsonError(f"a {kind} has no member {name!r}")
        children = list(members(data, at, plain))
        if kind == "array":
            n = len(children) if name == "-1" else part_index(name)
            if n is None or n > len(children):
                raise JsonError(f"index {name!r} is not in an array of {len(children)}")
            hit = children[n] if n < len(children) else None
            new = _build(parts[k + 1 :], raw) if hit is None else b""
        else:
            hit = next((c for c in children if unquote(data[c[0][0] : c[0][1]]) == name), None)
            new = quote(name, html=False).encode() + b":" + _build(parts[k + 1 :], raw) if hit is None else b""
        if hit is None:
            spot = children[-1][2] if children else at + 1
            return data[:spot] + (b"," if children else b"") + new + data[spot:]
        at, end = hit[1], hit[2]
    return data[:at] + raw + data[end:]


def delete(data: bytes, path: str) -> bytes:
    """The document without the (first) member at path and one comma; as it is if there is none."""
    if not path:
        raise JsonError("the path is empty")
    parts = _parts(path)
    if any(is_wild(p) for p in parts):
        raise JsonError("a path with wildcards cannot be deleted")
    plain = _plain(data)
    fault = check(data) if plain is None else None
    if fault:
        raise fault
    at = _skip(data, 0)
    for k, part in enumerate(parts):
        kind, name = kind_at(data, at), unescape_part(part)
        if kind not in ("object", "array"):
            return data
        children = list(members(data, at, plain))
        if kind == "array":
            n = len(children) - 1 if name == "-1" and k == len(parts) - 1 else part_index(name)
            hit = n if n is not None and 0 <= n < len(children) else None
        else:
            hit = next((j for j, c in enumerate(children) if unquote(data[c[0][0] : c[0][1]]) == name), None)
        if hit is None:
            return data
        if k == len(parts) - 1:
            begin = lambda c: c[0][0] if c[0] else c[1]
            if hit + 1 < len(children):
                return data[: begin(children[hit])] + data[begin(children[hit + 1]) :]
            a = children[hit - 1][2] if hit else begin(children[hit])
            return data[:a] + data[children[hit][2] :]
        at = children[hit][1]
    return data


# --- streams of values ------------------------------------------------------------------------


def values(data: bytes) -> Iterator[tuple[int, int]]:
    """Extents of values that stand one after another with or without white space; SyntaxFault where none begins or ends."""
    at = _skip(data, 0)
    while at < len(data):
        end = value_end(data, at)
        yield at, end
        at = _skip(data, end)


# --- encoding ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    escape_html: bool = True
    validate_strings: bool = True
    sort_map_keys: bool = True
    omit_zero_struct_fields: bool = False


STD = Options()
FAST = Options(escape_html=False, validate_strings=False)


class Number(str):
    """Digits that are written as they are."""


class _Literal(str):
    pass


def encode(x: Any, options: Options = STD, single: bool = False) -> str:
    """Compact JSON of Python values, of any depth; dict keys are text, sorted bytewise if asked."""
    out, todo = [], [x]
    while todo:
        v = todo.pop()
        if isinstance(v, _Literal):
            out.append(v)
        elif isinstance(v, dict):
            keys = sorted(v, key=lambda k: str(k).encode()) if options.sort_map_keys else list(v)
            parts: list[Any] = [_Literal("{")]
            for n, k in enumerate(keys):
                parts += [_Literal(("," if n else "") + quote(str(k), options.escape_html) + ":"), v[k]]
            todo += reversed([*parts, _Literal("}")])
        elif isinstance(v, (list, tuple)):
            parts = [_Literal("[")]
            for n, item in enumerate(v):
                parts += [_Literal(","), item] if n else [item]
            todo += reversed([*parts, _Literal("]")])
        elif hasattr(v, "tolist"):
            todo.append(v.tolist())
        else:
            out.append(_scalar(v, options, single))
    return "".join(out)


def _scalar(x: Any, options: Options, single: bool) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Number):
        text = str(x) or "0"
        if not _NUMBER.fullmatch(text.encode()):
            raise JsonError(f"invalid number literal {text!r}")
        return text
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return float_text(x, single)
    if isinstance(x, str):
        return quote(x, options.escape_html)
    if isinstance(x, (bytes, bytearray)):
        import base64

        return f'"{base64.b64encode(bytes(x)).decode()}"'
    raise JsonError(f"unsupported type: {type(x).__name__}")


def _has_infinity(tree: Any) -> bool:
    todo = [tree]
    while todo:
        v = todo.pop()
        if isinstance(v, float) and v in (float("inf"), float("-inf")):
            return True
        todo.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
    return False


def decode(data: bytes, use_number: bool = False) -> Any:
    """Nested dicts, lists and scalars; the last of equal keys counts; a number past the doubles is a TypeFault."""
    if _plain(data) is not None and b"\\ud" not in data and b"\\uD" not in data:
        kind = Number if use_number else float
        try:
            out = _json.JSONDecoder(parse_int=kind, parse_float=kind).decode(data.decode())
            if use_number or not _has_infinity(out):
                return out
        except UnicodeDecodeError:
            pass  # the exact reader repairs
    fault = check(data)
    if fault:
        raise fault
    stack: list[tuple[Any, str | None]] = []
    root: Any = None
    key: str | None = None

    def put(v: Any) -> None:
        nonlocal root
        if not stack:
            root = v
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][key] = v
        else:
            stack[-1][0].append(v)

    for t in tokens(data):
        raw = data[t.start : t.end]
        if t.kind == "key":
            key = unquote(raw)
        elif t.kind in ("{", "["):
            v: Any = {} if t.kind == "{" else []
            put(v)
            stack.append((v, key))
        elif t.kind in ("}", "]"):
            stack.pop()
        elif t.kind == "string":
            put(unquote(raw))
        elif t.kind == "number":
            x = float(raw)
            if not use_number and x in (float("inf"), float("-inf")):
                raise TypeFault(f"cannot decode number {raw.decode()} into a double", offset=t.end)
            put(Number(raw.decode()) if use_number else x)
        else:
            put(_json.loads(raw))
    return root
