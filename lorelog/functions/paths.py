"""Paths: globs, attribute rules, directories, extensions and stems."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Root patterns of generated and vendored files that come with a form for any depth; fixed values.
_ROOT_AND_DEEP = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "composer.lock", "go.sum", "Cargo.lock", "poetry.lock",
    "vendor/**", "node_modules/**", "third_party/**", "Pods/**", "dist/**", "build/**", "out/**", "target/**",
)
_ANY_DEPTH = ("*.lock", "*.min.js", "*.min.css", "*.map", "*.generated.*", "*.pb.go", "*_pb2.py", "migrations/**", "*.snap")
EXCLUDED_PATHS = tuple(x for p in _ROOT_AND_DEEP for x in (p, f"**/{p}")) + tuple(f"**/{p}" for p in _ANY_DEPTH)


def glob_regex(glob: str) -> str:
    """A regular expression for a whole path: ** for any folders (none too), * and ? inside one, [] and {,}."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            return "^(?s:" + out + "(?:/.*)?)$"
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return "^(?s:" + out + ")$"


def attribute_glob(pattern: str) -> str:
    """An attributes pattern as a glob: without a slash it holds at any depth, a leading one anchors, a trailing one takes the folder."""
    glob = pattern
    if "/" not in glob.rstrip("/"):
        glob = "**/" + glob
    glob = glob.removeprefix("/")
    return glob + "**" if glob.endswith("/") else glob


def parse_attributes(text: str) -> list[tuple[str, list[str]]]:
    """(glob, attributes) of the lines of an attributes file; comments and macros are left out."""
    rows = []
    for line in text.splitlines():
        parts = line.split()
        if len(parts) > 1 and not parts[0].startswith(("#", "[attr]")):
            rows.append((attribute_glob(parts[0]), parts[1:]))
    return rows


def any_glob(path: Column, globs) -> Column:
    globs = list(globs)
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def is_excluded(path: Column, globs=EXCLUDED_PATHS, attributes: str = "") -> Column:
    """Excluded by a glob or marked generated; the negated mark comes first and wins."""
    marks = parse_attributes(attributes)
    keep = [g for g, a in marks if "-linguist-generated" in a or "linguist-generated=false" in a]
    drop = [g for g, a in marks if "linguist-generated" in a or "linguist-generated=true" in a]
    return F.when(any_glob(path, keep), F.lit(False)).otherwise(any_glob(path, [*globs, *drop]))


def binary_attribute(path: Column, attributes: str) -> Column:
    """true or false where an attribute decides, null where the content does; the last line that fits wins."""
    out = F.lit(None).cast("boolean")
    for glob, names in parse_attributes(attributes):
        said = None
        for name in names:
            if name in ("binary", "-diff"):
                said = F.lit(True)
            elif name == "diff":
                said = F.lit(False)
            elif name == "!diff" or name.startswith("diff="):
                said = F.lit(None).cast("boolean")
        if said is not None:
            out = F.when(path.rlike(glob_regex(glob)), said).otherwise(out)
    return out


def has_nul(content: Column, sniffed: int = 8000) -> Column:
    """Whether one of the first bytes is zero; the pattern walks whole bytes of the hexadecimal form."""
    return F.hex(F.substring(content, 1, sniffed)).rlike("^(?:[0-9A-F]{2})*?00")


def with_exclusion(changes: DataFrame, path: str = "path", globs=EXCLUDED_PATHS, attributes: str = "") -> DataFrame:
    """Adds ``excluded``.  The rules run once per different path; the answers come back by an equi-join."""
    distinct = changes.select(F.col(path).alias("__path")).distinct()
    judged = distinct.withColumn("excluded", is_excluded(F.col("__path"), globs, attributes))
    return changes.join(judged, F.col(path).eqNullSafe(F.col("__path")), "left").drop("__path")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The lower-cased base name without any extension; a leading dot belongs to the name."""
    return F.lower(F.regexp_extract(base_name(path), "(?s)^(.[^.]*)", 1))


def extension(path: Column) -> Column:
    """Lower-cased text behind the base name's last dot, empty if there is none or it is the first character."""
    return F.lower(F.regexp_extract(base_name(path), "(?s)^.+\\.([^.]*)$", 1))


def directory(path: Column, depth: int) -> Column:
    """The first ``depth`` folders, null for a path that isn't that deep."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))
