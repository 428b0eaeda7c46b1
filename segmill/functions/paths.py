"""Path functions: normal form, patterns, categories and safety, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the five categories of an inventory.
CATEGORIES = {
    "scripts": (".ks", ".tjs", ".rpy", ".rpyc", ".txt", ".scn", ".mes", ".mjo", ".ss", ".json"),
    "archives": (".xp3", ".nsa", ".ns2", ".sar", ".arc", ".pfs", ".pac", ".dat", ".cpk"),
    "images": (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".g00", ".gxt", ".akb", ".cbg"),
    "fonts": (".ttf", ".otf", ".ttc", ".woff", ".woff2"),
    "executables": (".exe", ".dll"),
}


def normal_path(path: Column, casefold: bool = False) -> Column:
    """Slashes forward, none at the ends, letters small.

    ``casefold`` goes through Python for full case folding; without it lower case stands in, which is the
    same for ASCII paths.
    """
    plain = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    if not casefold:
        return F.lower(plain)

    @F.pandas_udf("string")
    def fold(paths: pd.Series) -> pd.Series:
        return paths.map(str.casefold, na_action="ignore")

    return fold(plain)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` and ``?`` cross slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))
            if end < 0:
                out.append("\\[")
                continue
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[^" + inner[1:] + "]" if inner.startswith("!") else "[" + ("\\" + inner if inner.startswith("^") else inner) + "]")
            i = end + 1
        else:
            out.append("\\" + c if c in "\\.^$+{}()|]" else c)
    return "(?s)^" + "".join(out) + "$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """The last suffix with its dot, in small letters; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.*[^.](\.[^.]+)$", 1))


def category(ext: Column) -> Column:
    """Category of an extension (with its dot), NULL outside all of them."""
    chosen = F.lit(None).cast("string")
    for name, own in reversed(CATEGORIES.items()):
        chosen = F.when(ext.isin(*own), F.lit(name)).otherwise(chosen)
    return chosen


def is_safe(path: Column, allow_colon: bool = True) -> Column:
    """A relative path that stays inside its root: not absolute, no parent step, no drive, not empty."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = plain.rlike(r"^/") | plain.rlike(r"^[A-Za-z]:") | plain.rlike(r"(?:^|/)\.\.(?:/|$)") | (plain == "")
    return ~(bad if allow_colon else bad | plain.contains(":"))
