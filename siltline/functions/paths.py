"""Local paths in text, found by a scanner of roots, separators and segments; technical text is left as it is.

A place is a root only if no letter or digit stands before it: a drive letter with its colon and a separator, the same
without the colon if the next segment is ``Users``, two backslashes and the name of a server, a variable that stands for
a local folder, or a named project folder. From there segments are read: blanks belong to them, separators may be
doubled. A path ends at a character that no segment holds, such as the ``>`` of a prompt, at the end of its line, and
where the next drive begins. ``n//2``, ``I/O``, dates and addresses with a scheme have no root and stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for each kind of path.
MARKS = {"share": "<UNC_PATH>", "drive": "<LOCAL_WINDOWS_PATH>", "variable": "<LOCAL_PATH_ENV_VAR>", "project": "<LOCAL_PROJECT_PATH>"}
# Variables that stand for local folders, and folders of a project that aren't published.
VARIABLES = frozenset(["userprofile", "localappdata", "appdata", "temp", "tmp", "homepath", "homedrive", "userdomain"])
PROJECT_FOLDERS = (".venv", ".agent", "chrome_session")
DEPTH, LENGTH = 8, 120  # folders of a drive path and characters of each: a stray letter in prose takes no whole paragraph

_BARRED = frozenset('\\/:*?"<>|\r\n')
_SEPARATORS = frozenset("\\/")


def _letter(text: str, at: int) -> bool:
    return at < len(text) and text[at].isascii() and text[at].isalpha()


def _separators(text: str, at: int) -> int:
    """Where the separators that begin at ``at`` end."""
    while at < len(text) and text[at] in _SEPARATORS:
        at += 1
    return at


def _segment(text: str, at: int, most: int | None = None) -> int:
    """Where the segment that begins at ``at`` ends; it never holds the start of another drive."""
    end = len(text) if most is None else min(len(text), at + most)
    while at < end and text[at] not in _BARRED and not (_letter(text, at) and text[at + 1 : at + 2] == ":"):
        at += 1
    return at


def _folders(text: str, at: int, depth: int | None, most: int | None) -> int:
    """Where the segments and separators that begin at ``at`` end."""
    while depth is None or depth > 0:
        end = _segment(text, at, most)
        after = _separators(text, end)
        if end == at or after == end:
            return end
        at, depth = after, None if depth is None else depth - 1
    return _segment(text, at, most)


def _root(text: str, at: int, folders: tuple[str, ...]) -> tuple[str, int] | None:
    """(kind, end of the path) if a path begins at ``at``."""
    c, before = text[at], text[at - 1] if at else " "
    if c == "\\" and text[at + 1 : at + 2] == "\\" and not before.isalnum() and before not in ":\\":
        server = _segment(text, at + 2)
        if any(x.isspace() for x in text[at + 2 : server]):
            return None
        share = _separators(text, server)
        end = _folders(text, share, None, None)
        return ("share", end) if server > at + 2 and share > server and end > share else None
    if c == "%" and (close := text.find("%", at + 1, at + 20)) > 0 and text[at + 1 : close].lower() in VARIABLES:
        rest = _separators(text, close + 1)
        return "variable", _folders(text, rest, None, None) if rest > close + 1 else rest
    if before.isalnum():
        return None
    if _letter(text, at):
        colon = text[at + 1 : at + 2] == ":"
        first = at + 1 + colon
        inside = _separators(text, first)
        if inside > first:
            home = text[inside : inside + 5].lower() == "users" and text[inside + 5 : inside + 6] in _SEPARATORS
            if colon or home:
                return "drive", _folders(text, inside, DEPTH, LENGTH)
    for f in folders:
        if text[at : at + len(f)].lower() == f and text[at + len(f) : at + len(f) + 1] in _SEPARATORS:
            return "project", _folders(text, _separators(text, at + len(f)), None, None)
    return None


def find_paths(text: str | None, folders: tuple[str, ...] = PROJECT_FOLDERS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the local paths of a text, from left to right."""
    out, at = [], 0
    if not text or not any(x in text for x in ("\\", "%", ":/", *(f + "/" for f in folders), "/Users")):
        return out
    while at < len(text):
        hit = _root(text, at, folders)
        if hit:
            out.append((at, hit[1], hit[0]))
            at = hit[1]
        else:
            at += 1
    return out


def without_paths(text: str | None, folders: tuple[str, ...] = PROJECT_FOLDERS) -> tuple[str | None, int]:
    """The text with a mark for each local path, and their number; a text without paths comes back as it is."""
    spans = find_paths(text, folders)
    if not spans:
        return text, 0
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], MARKS[kind]]
        at = b
    return "".join([*parts, text[at:]]).rstrip(" \t"), len(spans)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def _redacted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([without_paths(t) for t in texts], columns=["text", "n"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _kinds(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted({k for _, _, k in find_paths(t)}))


def _suspect(c: Column) -> Column:
    """The texts that may hold a path at all; only they are sent to Python."""
    return F.when(c.rlike(r"[\\%]|:/|(?i:/users)|" + "|".join(f.replace(".", r"\.") + "/" for f in PROJECT_FOLDERS)), c)


def redact_paths(c: Column) -> Column:
    """struct(text, n): the text with a mark for each local path, and how many there were; null stays null."""
    r = _redacted(_suspect(c))
    return F.struct(F.coalesce(r["text"], c).alias("text"), F.coalesce(r["n"], F.lit(0)).alias("n"))


def path_kinds(c: Column) -> Column:
    """The kinds of local path that stand in the text, sorted; none for null."""
    return _kinds(F.coalesce(_suspect(c), F.lit("")))


def contained(c: Column) -> Column:
    """Whether a path stays below its folder by what is written: not empty, not absolute, no drive, no share, no way up; false for null."""
    way_up = r"(^|[\\/])\.\.([\\/]|$)"
    return F.coalesce((F.trim(c) != "") & ~c.rlike(r"^\s*([\\/]|[A-Za-z]:)") & ~c.rlike(way_up) & ~F.contains(c, F.lit("\x00")), F.lit(False))
