"""Mending of JSON that a model has cut off, left unquoted, fenced, encoded twice or ended with commas: one pass with a stack."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json|JSON)?\s*(.*?)\s*(?:```|\Z)", re.S)
_GAP = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)*", re.S)
_SPACE = re.compile(r"\s*")
_STOP = {'"': re.compile(r'["\\]'), "'": re.compile(r"['\\]"), "“": re.compile(r"[”\\]")}
_BARE = re.compile(r"[^,:{}\[\]\n]*")
_WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
MISSING = object()


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that opens at a quote, and the place behind it. A quote inside that nothing structural follows is part of the string."""
    quote, out, i = text[at], [], at + 1
    stop = _STOP[quote]
    while True:
        found = stop.search(text, i)
        if not found:
            out.append(text[i:])
            return "".join(out), len(text)
        j = found.start()
        out.append(text[i:j])
        if text[j] == "\\":
            code = text[j + 1 : j + 2]
            digits = text[j + 2 : j + 6]
            if code == "u" and re.fullmatch("[0-9a-fA-F]{4}", digits):
                out.append(chr(int(digits, 16)))
                i = j + 6
            else:
                out.append(_ESCAPES.get(code, code))
                i = j + 2
            continue
        behind = _SPACE.match(text, j + 1).end()
        if behind >= len(text) or text[behind] in ",:}]\"'“":
            return "".join(out), j + 1
        out.append(text[j])
        i = j + 1


def _word(raw: str):
    raw = raw.strip()
    if raw.lower() in _WORDS:
        return _WORDS[raw.lower()]
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def mend(text: str):
    """The value that the text most likely meant; MISSING if it holds no object, array or string with one."""
    fence = _FENCE.search(text)
    if fence and fence.group(1):
        text = fence.group(1)
    text = text.strip()
    if text.startswith('"'):  # encoded twice
        try:
            inner = json.loads(text)
        except ValueError:
            inner = _string(text, 0)[0]
        if isinstance(inner, str) and re.match(r"\s*[{\[]", inner):
            text = inner
    start = re.search(r"[{\[]", text)
    if not start:
        return MISSING
    i, root, stack = start.start(), MISSING, []  # stack: [container, pending key]

    def put(value) -> None:
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        else:
            top[0][top[1]], top[1] = value, MISSING

    def close() -> None:
        done = stack.pop()
        if isinstance(done[0], dict) and done[1] is not MISSING:
            done[0][done[1]] = None

    while i < len(text):
        i = _GAP.match(text, i).end()
        if i >= len(text):
            break
        c = text[i]
        wants_key = bool(stack) and isinstance(stack[-1][0], dict) and stack[-1][1] is MISSING
        if c in "{[":
            value = {} if c == "{" else []
            if not stack:
                root = value
            elif wants_key:  # an object without its key: it joins the array around it, if there is one
                close()
                if not stack:
                    break
                continue
            else:
                put(value)
            stack.append([value, MISSING])
            i += 1
        elif c in "}]":
            kind = dict if c == "}" else list
            if any(isinstance(x[0], kind) for x in stack):
                while not isinstance(stack[-1][0], kind):
                    close()
                close()
            i += 1
            if not stack:
                break
        elif c in ",:":
            if c == "," and stack and isinstance(stack[-1][0], dict) and stack[-1][1] is not MISSING:
                put(None)
            i += 1
        else:
            if c in _STOP:
                value, i = _string(text, i)
            else:
                end = _BARE.match(text, i).end()
                value, i = _word(text[i:end]), max(end, i + 1)
            if wants_key:
                stack[-1][1] = value if isinstance(value, str) else json.dumps(value)
            else:
                put(value)
    while stack:
        close()
    return root


def mend_text(text: str | None) -> tuple[str | None, bool, str | None]:
    """(JSON, whether it had to be mended, error)."""
    if text is None:
        return None, False, "null"
    try:
        value = json.loads(text)
        if isinstance(value, (dict, list)):
            return text, False, None
    except (ValueError, RecursionError):
        pass
    try:
        value = mend(text)
        return (None, True, "no JSON") if value is MISSING else (json.dumps(value, ensure_ascii=False), True, None)
    except RecursionError:
        return None, True, "nested too deep"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("mended", T.BooleanType()), T.StructField("error", T.StringType())]))
def mend_json(x: pd.Series) -> pd.DataFrame:
    """json, mended, error of each text: well-formed objects and arrays stay as they are."""
    return pd.DataFrame([mend_text(s) for s in x], columns=["json", "mended", "error"])
