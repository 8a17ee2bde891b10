"""Credentials in text: tokens of known forms, values assigned to secret names, key blocks and known secrets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"
# Public forms of tokens, as beginning, alphabet of the rest, and least and greatest length of the rest.
WORD, URLSAFE, UPPER = "A-Za-z0-9", "A-Za-z0-9_-", "0-9A-Z"
TOKEN_FORMS = [
    *[(p, WORD, 16, None) for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")], ("github_pat_", WORD + "_", 20, None),
    *[(p + s, URLSAFE, 16, None) for p in ("sk", "pk", "rk", "xoxb", "xoxa", "xoxp", "xoxr", "xoxs") for s in "-_"],
    ("AKIA", UPPER, 16, 16), ("ASIA", UPPER, 16, 16), ("AIza", URLSAFE, 30, 45),
]
# Parts of names whose values are secret; names are compared without dashes and underscores.
SECRET_NAMES = ["token", "secret", "password", "passwd", "apikey", "accesskey", "privatekey", "credential", "auth"]
LEAST_VALUE, LEAST_BEARER, LEAST_KNOWN = 4, 12, 8

_TOKEN = re.compile(r"(?<!\w)(?:" + "|".join(f"{p}[{a}]{{{lo},{hi or ''}}}" for p, a, lo, hi in TOKEN_FORMS) + r")(?!\w)")
_BLOCK_EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
_BEARER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._~+/=-")
_VALUE_END = frozenset(" \t\r\n\f\v,;}]")


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the private key blocks; a block without an end is none."""
    out, start = [], None
    for m in _BLOCK_EDGE.finditer(text):
        if m.group(1) == "BEGIN":
            start = m.start() if start is None else start
        elif start is not None:
            out.append((start, m.end()))
            start = None
    return out


def bearer_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the word bearer with the token behind it."""
    out, low, at = [], text.lower(), 0
    while (at := low.find("bearer", at)) >= 0:
        first = at + 6
        while first < len(text) and text[first].isspace():
            first += 1
        end = first
        while end < len(text) and text[end] in _BEARER:
            end += 1
        whole = first > at + 6 and end - first >= LEAST_BEARER and not (at and (text[at - 1].isalnum() or text[at - 1] == "_"))
        if whole:
            out.append((at, end))
        at = end if whole else at + 6
    return out


def _value(text: str, at: int) -> int | None:
    """Where the value that begins at ``at`` ends: quoted on its line, or bare up to a blank or a sign that closes."""
    if text.startswith(REDACTED, at):
        return None
    quote = text[at : at + 1]
    if quote and quote in "\"'":
        close = text.find(quote, at + 1)
        if close - at > LEAST_VALUE and "\n" not in text[at + 1 : close]:
            return close + 1
    end = at
    while end < len(text) and text[end] not in _VALUE_END:
        end += 1
    return end if end - at >= LEAST_VALUE else None


def assigned_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values that stand behind a secret name and a colon or equals sign."""
    out = []
    for m in re.finditer("[:=]", text):
        if out and m.start() < out[-1][1]:
            continue
        last = m.start()
        while last and text[last - 1].isspace():
            last -= 1
        first = last
        while first and text[first - 1] in _NAME:
            first -= 1
        name = text[first:last].lower().replace("-", "").replace("_", "")
        if not any(s in name for s in SECRET_NAMES):
            continue
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        if end := _value(text, at):
            out.append((at, end))
    return out


def without_secrets(text: str | None, known: tuple[str, ...] = ()) -> str | None:
    """The text with ``[REDACTED]`` for every credential: known ones first, the longest first, then by form."""
    if not text:
        return text
    for s in sorted({k for k in known if k and len(k) >= LEAST_KNOWN}, key=len, reverse=True):
        text = text.replace(s, REDACTED)
    for find in (key_blocks, lambda t: [m.span() for m in _TOKEN.finditer(t)], bearer_values, assigned_values):
        for a, b in reversed(find(text)):
            text = text[:a] + REDACTED + text[b:]
    return text


def redact_secrets(c: Column, known: tuple[str, ...] = ()) -> Column:
    """The text without credentials; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_secrets(t, known))

    return run(c)


@F.pandas_udf(T.BooleanType())
def _holds(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bool(t) and without_secrets(t) != t)


def holds_secret(c: Column) -> Column:
    """Whether a text holds a credential; false for null."""
    return _holds(F.coalesce(c, F.lit("")))
