"""Replies of a model as relations. Bracket matching is no regular language, so these are vectorised Python functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THOUGHTS = re.compile(r"<(think|thinking|reasoning)>.*?</\1>", re.DOTALL | re.IGNORECASE)
ITEM = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("line", "confidence") else T.StringType()) for n in ("line", "severity", "title", "body", "fix", "confidence")]))
FREE = re.compile(r"^\s*(?:[-*]\s*)?(?:\*\*)?Line (\d+)(?:\*\*)?\s*:\s*(.+)$", re.IGNORECASE)


def balanced(text: str, open_: str, close: str, at: int) -> int:
    """Where the bracket at a place is closed, strings left out; -1 if it is not."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == open_:
            depth += 1
        elif c == close:
            depth -= 1
            if not depth:
                return i
    return -1


def first_json(text: str | None, open_: str, close: str, kind: type) -> str | None:
    """The first balanced part that parses as the kind, thoughts left out."""
    text = THOUGHTS.sub("", text or "")
    at = text.find(open_)
    while at >= 0:
        end = balanced(text, open_, close, at)
        if end >= 0:
            try:
                if isinstance(json.loads(text[at : end + 1]), kind):
                    return text[at : end + 1]
            except ValueError:
                pass
        at = text.find(open_, at + 1)
    return None


@F.pandas_udf(T.StringType())
def json_array(text: pd.Series) -> pd.Series:
    return text.map(lambda t: first_json(t, "[", "]", list))


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(lambda t: first_json(t, "{", "}", dict))


def _number(value, other):
    try:
        return int(value)
    except (TypeError, ValueError):
        return other


def parsed(text: str | None) -> list[dict]:
    """Items of a reply: a JSON array, else lines of tab-separated fields, else lines that begin with a line number."""
    found = first_json(text, "[", "]", list)
    if found is not None:
        items = []
        for x in json.loads(found):
            line = _number(x.get("line"), 0) if isinstance(x, dict) else 0
            confidence = _number(x.get("confidence", 7), 7) if line > 0 else 0
            if line > 0 and confidence >= 5:
                items.append({k: str(x[k]) if x.get(k) not in (None, "") else None for k in ("severity", "title", "body", "fix")} | {"line": line, "confidence": confidence})
        return items
    out = []
    for raw in THOUGHTS.sub("", text or "").splitlines():
        cells = raw.split("\t")
        if len(cells) >= 2 and _number(cells[0].strip(), 0) > 0:
            out.append({"line": int(cells[0]), "severity": None, "title": None, "body": "\t".join(cells[1:]).strip(), "fix": None, "confidence": 7})
        elif m := FREE.match(raw):
            out.append({"line": int(m[1]), "severity": None, "title": None, "body": m[2].strip(), "fix": None, "confidence": 7})
    return out


@F.pandas_udf(ITEM)
def review_items(text: pd.Series) -> pd.Series:
    return text.map(parsed)


def without_marks(code: Column) -> Column:
    """Code of a suggested fix without the marks of a diff."""
    return F.regexp_replace(F.regexp_replace(code, r"(?m)^(?:\+\+\+|---|@@).*\n?", ""), r"(?m)^\+ ?", "")


#: What a secret looks like on an added line, and references that are none.
SECRET = r"ghp_[A-Za-z0-9]{36}|\bsk-[A-Za-z0-9_-]{20,}|\bAKIA[A-Z0-9]{16}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----|(?i:password|passwd|secret|token|api_?key)\w*[\"']?\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']"
REFERENCE = r"\$\{\{\s*secrets\.|os\.environ|process\.env|getenv\("


def is_secret_line(text: Column) -> Column:
    """Whether an added line has a literal secret. The rule is an interpretation: its source is not to be had."""
    return text.rlike(SECRET) & ~text.rlike(REFERENCE)
