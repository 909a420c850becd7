"""Scalar expressions on paths, ids and text that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of each file extension.
LANGUAGES = {"dart": "dart", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go", "py": "python", "pyi": "python", "rs": "rust", "swift": "swift", "kt": "kotlin", "h": "objectivec", "m": "objectivec", "mm": "objectivec"}
#: Node kinds that hold members.
CONTAINERS = ["file", "class", "mixin", "enum", "extension", "extension_type", "interface", "struct", "record", "type"]


def language(file: str | Column) -> Column:
    """The language of a path by its last extension, ``unknown`` for others, null for null."""
    extension = F.element_at(F.split(file, r"\."), -1)
    names = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.when(extension.isNotNull(), F.coalesce(names[extension], F.lit("unknown")))


def utf16_order(text: str | Column) -> Column:
    """A sort key that orders text by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def repository(file: str | Column) -> Column:
    return F.substring_index(file, "/", 1)


def directory(file: str | Column) -> Column:
    """The first two segments of a path's directory below the repository, ``.`` for none."""
    parts = F.split(file, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.when(F.size(inner) < 1, ".").otherwise(F.array_join(F.slice(inner, 1, 2), "/"))


def terms(text: str | Column) -> Column:
    """The distinct terms of a text: words of letters and digits in lower case, and the pieces of words in camel case."""
    word = F.lit(r"([\p{L}\p{N}]+)")
    words = F.regexp_extract_all(text, word, F.lit(1))
    pieces = F.regexp_extract_all(F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), word, F.lit(1))
    return F.array_distinct(F.transform(F.concat(words, pieces), F.lower))


def under(file: str | Column, scope: str) -> Column:
    """Whether a path is ``scope`` or lies below it; a prefix that ends within a name does not count."""
    file = F.col(file) if isinstance(file, str) else file
    return (file == scope) | file.startswith(scope.rstrip("/") + "/")


def glob(file: str | Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a path fits one of the globs ``include`` and none of ``exclude``: ``*`` takes any characters, those of directories too, ``?`` one, ``[..]`` one of some, ``{a,b}`` one of several texts."""

    def pattern(text: str) -> str:
        out, depth, at = "", 0, 0
        while at < len(text):
            c = text[at]
            end = text.find("]", at + 2)
            if c == "*":
                out += "" if out.endswith(".*") else ".*"
            elif c == "?":
                out += "."
            elif c == "[" and end > 0:
                inner = text[at + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
                at = end
            elif c == "{":
                out, depth = out + "(?:", depth + 1
            elif c == "}" and depth:
                out, depth = out + ")", depth - 1
            elif c == "," and depth:
                out += "|"
            else:
                out += re.escape(c)
            at += 1
        return f"(?:{out})"

    file = F.col(file) if isinstance(file, str) else file
    fits = file.rlike("(?s)^(?:" + "|".join(map(pattern, include)) + ")$") if include else F.lit(False)
    return fits & ~file.rlike("(?s)^(?:" + "|".join(map(pattern, exclude)) + ")$") if exclude else fits


def test_path(file: str | Column) -> Column:
    """Whether a path looks like a test's."""
    file = F.col(file) if isinstance(file, str) else file
    return file.rlike(r"(^|/)(tests?|integration_test|__tests__)/|_test\.|\.test\.|\.spec\.|Test\.(java|kt)$")
