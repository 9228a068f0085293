"""C text: lexing, call arguments, constant and affine expressions.

These are small state machines over one row's text, which column expressions cannot
hold; each is a plain function with an Arrow UDF around it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

_LITERAL = re.compile(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_BRACKET, _ROUND, _STOP = re.compile(r"[()\[\]{},]"), re.compile(r"[()]"), re.compile(r"[()\[\]{};]")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|\d+")


def strip_comments(text: str) -> str:
    """Comments become one blank (their newlines stay); strings are untouched."""
    return _LITERAL.sub(lambda m: " " + "\n" * m[0].count("\n") if m[0].startswith("/") else m[0], text)


def mask_strings(text: str) -> str:
    """String and character contents become ``_``; comments go."""
    return _LITERAL.sub(lambda m: m[0][0] + "_" * (len(m[0]) - 2) + m[0][-1] if m[0][0] in "\"'" else " ", text)


def split_arguments(text: str) -> list[str]:
    """Top-level comma parts; brackets nest, quotes protect."""
    plain, depth, parts, start = mask_strings(text), 0, [], 0
    if len(plain) != len(text):
        text = plain = strip_comments(text)
        plain = mask_strings(text)
    for m in _BRACKET.finditer(plain):
        i, c = m.start(), m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return parts + [last] if parts or last else []


def calls(text: str) -> list[tuple[str, list[str], int]]:
    """(name, arguments, line) of each call with balanced brackets, outermost and inner."""
    text = strip_comments(text)
    plain = mask_strings(text)
    out = []
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", plain):
        if m[1] in {"if", "for", "while", "switch", "return", "sizeof"}:
            continue
        depth, i = 1, m.end()
        for b in _ROUND.finditer(plain, i):
            depth, i = depth + (1 if b[0] == "(" else -1), b.end()
            if depth == 0:
                break
        if depth == 0:
            out.append((m[1], split_arguments(text[m.end() : i - 1]), plain.count("\n", 0, m.start()) + 1))
    return out


def statements(text: str) -> list[tuple[int, int, str]]:
    """(line, depth, statement) of a C text: what ends at ``;``, ``{`` or ``}`` outside brackets, over line breaks.

    Comments are gone, strings stay. ``depth`` counts the open braces before the statement.
    """
    text = strip_comments(text)
    plain = mask_strings(text)
    out, start, depth, inner = [], 0, 0, 0
    for m in _STOP.finditer(plain):
        i, c = m.start(), m[0]
        inner += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        if c in "{};" and (inner <= 0 or c != ";"):
            body = text[start:i]
            if body.strip():
                out.append((plain.count("\n", 0, start + len(body) - len(body.lstrip())) + 1, depth, re.sub(r"\s+", " ", body.strip())))
            depth += {"{": 1, "}": -1}.get(c, 0)
            start, inner = i + 1, 0
    return out


def function_ranges(text: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of C function bodies, by brace matching on masked text."""
    plain = mask_strings(strip_comments(text))
    out, at = [], 0
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*)?\{", plain):
        if m.start() < at or m[1] in {"if", "for", "while", "switch"}:
            continue
        depth, i = 1, m.end()
        while i < len(plain) and depth:
            depth += {"{": 1, "}": -1}.get(plain[i], 0)
            i += 1
        if depth == 0:
            out.append((m[1], plain.count("\n", 0, m.start()) + 1, plain.count("\n", 0, i) + 1))
            at = i
    return out


class _Affine:
    """Recursive descent over + - * / % << >> & | ~ and brackets, to constant + coefficients."""

    ORDER = [{"|"}, {"&"}, {"<<", ">>"}, {"+", "-"}, {"*", "/", "%"}]

    def __init__(self, text: str):
        self.tokens = re.findall(r"0[xX][0-9a-fA-F]+|\d+|[A-Za-z_]\w*(?:->\w+|\.\w+)*|<<|>>|[-+*/%&|~()]|\S", text)
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def binary(self, level: int):
        if level == len(self.ORDER):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.ORDER[level]:
            left = self.apply(self.take(), left, self.binary(level + 1))
        return left

    def unary(self):
        token = self.take() if self.peek() is not None else None
        if token == "-":
            return self.apply("*", (-1, {}), self.unary())
        if token == "+":
            return self.unary()
        if token == "~":
            c, k = self.unary()
            return None if k else (~c, {})
        if token == "(":
            inner = self.binary(0)
            if self.peek() != ")":
                raise ValueError
            self.take()
            return inner
        if token and _NUMBER.fullmatch(token):
            return int(token, 0 if token[:2].lower() == "0x" or token == "0" or token[0] != "0" else 8), {}
        if token and re.match(r"[A-Za-z_]", token):
            return 0, {token: 1}
        raise ValueError

    @staticmethod
    def apply(op, a, b):
        if a is None or b is None:
            raise ValueError
        (c, k), (d, m) = a, b
        if op in "+-":
            s = 1 if op == "+" else -1
            both = {x: k.get(x, 0) + s * m.get(x, 0) for x in {*k, *m}}
            return c + s * d, {x: v for x, v in both.items() if v}
        if op == "*":
            if k and m:
                raise ValueError
            f, (e, n) = (c, b) if not k else (d, a)
            return f * e, {x: f * v for x, v in n.items() if f * v}
        if op == "<<" and not m:
            return _Affine.apply("*", a, (1 << d, {}))
        if k or m:
            raise ValueError
        if op in "/%":
            q = abs(c) // abs(d) * (1 if (c < 0) == (d < 0) else -1)
            return (q if op == "/" else c - q * d), {}
        return {">>": c >> d, "&": c & d, "|": c | d}[op], {}


def affine(text: str) -> tuple[int, dict[str, int]] | None:
    """(constant, coefficients) of a linear expression; None for any other."""
    try:
        p = _Affine(text)
        out = p.binary(0)
        return out if p.peek() is None else None
    except (ValueError, ZeroDivisionError, IndexError):
        return None


def constant(text: str) -> int | None:
    got = affine(text)
    return got[0] if got and not got[1] and abs(got[0]) < 1 << 63 else None


def string_length(text: str) -> int | None:
    """Bytes of a C string literal, escapes counted once, adjacent literals joined."""
    parts = re.findall(r'"((?:\\.|[^"\\\n])*)"', text)
    if not parts or re.sub(r'"(?:\\.|[^"\\\n])*"|\s', "", text):
        return None
    return sum(len(re.sub(r"\\(?:x[0-9a-fA-F]+|[0-7]{1,3}|.)", "_", p).encode()) for p in parts)


def scanf_conversions(text: str) -> list[tuple[str, int | None]]:
    """(conversion, width) of each storing conversion of a scanf format."""
    out = []
    for star, width, kind in re.findall(r"%(?!%)(\*?)(\d*)(?:hh|h|ll|l|j|z|t|L)?(\[\^?\]?[^\]]*\]|[a-zA-Z])", text.replace("%%", "")):
        if not star:
            out.append(("[" if kind.startswith("[") else kind, int(width) if width else None))
    return out


def _udf(f, kind: str):
    """A function of a column; the UDF itself needs a session and is made on use."""

    def of(column):
        arrow = to_arrow_type(DataType.fromDDL(kind))

        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            texts = values.to_pylist()
            known = {x: f(x) for x in set(texts) if x is not None}  # equal texts of a batch are read once
            return pa.array([None if x is None else known[x] for x in texts], arrow)

        return run(column)

    return of


strip_comments_udf = _udf(strip_comments, "string")
mask_strings_udf = _udf(mask_strings, "string")
split_arguments_udf = _udf(split_arguments, "array<string>")
calls_udf = _udf(lambda x: [{"name": n, "args": a, "line": line} for n, a, line in calls(x)], "array<struct<name:string,args:array<string>,line:int>>")
statements_udf = _udf(lambda x: [{"line": n, "depth": k, "text": t} for n, k, t in statements(x)], "array<struct<line:int,depth:int,text:string>>")
constant_udf = _udf(constant, "long")
string_length_udf = _udf(string_length, "int")
scanf_udf = _udf(lambda x: [{"conversion": c, "width": w} for c, w in scanf_conversions(x)], "array<struct<conversion:string,width:int>>")
function_ranges_udf = _udf(lambda x: [{"name": n, "first": a, "last": b} for n, a, b in function_ranges(x)], "array<struct<name:string,first:int,last:int>>")
