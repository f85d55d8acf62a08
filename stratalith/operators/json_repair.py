"""Repair of malformed JSON, as language models and broken writers leave it.

A reader goes through a text once with a stack of what is open: it leaves out
prose around the outermost object or list and code fences, takes bare words and
single quotes for strings, puts in missing commas and colons, drops superfluous
ones, and closes what a truncated text leaves open.  A quote that a word follows
does not end a string.  A key without a value gets null; nothing else is made up.  Spark then parses the result, so what is not
valid JSON is null.

Edge cases: valid JSON is given back as it is.  Null, empty and other texts
without an object or list give null.  Depth has no limit but memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .keep import by_value

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?(?:\*/|$)|[{}\[\],:]|"(?:[^"\\]|\\.|\\$|"(?=\s*[A-Za-z_])(?!\s*(?:true|false|null)\b))*"?|'(?:[^'\\]|\\.|\\$|'(?=\s*[A-Za-z_])(?!\s*(?:true|false|null)\b))*'?|[^\s{}\[\],:"']+""", re.S)
_NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
#: Words of other languages that JSON has by another name.
_WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "null"}


def _string(token: str) -> str:
    """A quoted or bare token as a JSON string."""
    if token[0] in "\"'":
        body = token[1:-1] if len(token) > 1 and token[-1] == token[0] and not re.search(r"(?<!\\)(\\\\)*\\.$", token[1:]) else token[1:]
        known = r'(\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})|\\(.?)|"'  # escapes that JSON has, others, bare quotes
        body = re.sub(known, lambda m: m[1] or ('\\"' if m[0] == '"' else "\\\\" + m[2] if m[2] else ""), body, flags=re.S)
        return '"' + re.sub(r"[\x00-\x1f]", lambda m: json.dumps(m[0])[1:-1], body) + '"'
    return json.dumps(token, ensure_ascii=False)


def _valid(text: str) -> bool:
    def unknown(word: str) -> None:
        raise ValueError(word)  # NaN and Infinity are no JSON

    try:
        json.loads(text, parse_constant=unknown)
    except (ValueError, RecursionError):
        return False
    return True


def _value(token: str) -> str:
    if token[0] in "\"'":
        return _string(token)
    return _WORDS.get(token.lower()) or (token if _NUMBER.fullmatch(token) else _string(token))


def repaired(text: str | None) -> str | None:
    """The first object or list of a text as valid JSON, or None."""
    if not text:
        return None
    if _valid(text):
        return text
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    out: list[str] = []
    open_: list[str] = []  # brackets that close what is open
    wants = ""  # of the innermost: k(ey), c(olon), v(alue), n(ext: a comma or an end)
    words: list[str] = []  # bare words of one string

    def put(piece: str) -> None:
        """A value, or a key where one is due."""
        nonlocal wants
        if wants == "n":
            out.append(",")
            wants = "k" if open_[-1] == "}" else "v"
        if wants == "c":
            out.append(":")
            wants = "v"
        out.append(piece)
        wants = "c" if wants == "k" else "n"

    def flush() -> None:
        if words:
            token = " ".join(words)
            words.clear()
            put(_string(token) if wants == "k" or (wants == "n" and open_[-1] == "}") else _value(token))

    def close() -> None:
        nonlocal wants
        if open_[-1] == "}" and wants in ("c", "v"):
            out.append(":null" if wants == "c" else "null")
        if out[-1] == ",":
            out.pop()
        out.append(open_.pop())
        wants = "n"

    for m in _TOKEN.finditer(text, start.start()):
        token = m[0]
        if token[0].isspace() or token.startswith(("//", "/*")):
            continue
        if token in "{[":
            flush()
            if open_ and wants == "k":  # an object where a key is due: one brace too many
                continue
            if open_:
                if wants == "n":
                    out.append(",")
                    if open_[-1] == "}":
                        out.pop()
                        continue
                elif wants == "c":
                    out.append(":")
            out.append(token)
            open_.append("}" if token == "{" else "]")
            wants = "k" if token == "{" else "v"
        elif token in "}]":
            flush()
            if token not in open_:
                continue
            while open_[-1] != token:
                close()
            close()
            if not open_:
                break
        elif token == ",":
            flush()
            if wants in ("c", "v") and open_[-1] == "}":
                out.append(":null" if wants == "c" else "null")
                wants = "n"
            if wants == "n":
                out.append(",")
                wants = "k" if open_[-1] == "}" else "v"
        elif token == ":":
            flush()
            if wants == "c":
                out.append(":")
                wants = "v"
        elif token[0] in "\"'":
            flush()
            put(_string(token))
        else:
            words.append(token)
    flush()
    while open_:
        close()
    result = "".join(out)
    return result if _valid(result) else None


def repair(rows: DataFrame, text: str, out: str = "repaired") -> DataFrame:
    """rows with the repaired JSON of a column in another one; null where Spark cannot parse it either."""
    by_value(__name__)

    @pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: repaired(t) if isinstance(t, str) else None)

    found: Column = run(F.col(text))
    return rows.withColumn(out, found).withColumn(out, F.when(F.try_parse_json(out).isNotNull(), F.col(out)))
