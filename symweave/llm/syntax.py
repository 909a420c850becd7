"""Source files that do not parse: per-file verdicts and rates per repository and language."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.grammars import GRAMMARS, grammar
from symweave.llm.lexers import lexer
from symweave.session import ship, spread

#: The grammar of each file extension.
EXTENSIONS = {"dart": "dart", "ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "java": "java", "go": "go", "py": "py", "rs": "rs", "swift": "swift", "kt": "kt", "m": "objc", "h": "objc"}
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: .*)?$", re.M)
#: Nested calls of a parse, about ten for each bracket; beyond it brackets alone are judged.
DEPTH = 2_000_000
#: Python's own limits of nested brackets and of levels of indentation.
PYTHON_BRACKETS, PYTHON_INDENTS = 200, 99
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _plain(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n")


def _nesting(kinds: list[str], texts: list[str], most: int, indents: int) -> int:
    """The token at which brackets do not match, or at which they or indentation are nested beyond ``most`` and ``indents``, -1 for none; the end counts if brackets are open there."""
    open_brackets: list[str] = []
    depth = 0
    for i, (kind, t) in enumerate(zip(kinds, texts)):
        if t in ("(", "[", "{"):
            open_brackets.append(t)
            if len(open_brackets) > most:
                return i
        elif t in _CLOSES:
            if not open_brackets or open_brackets.pop() != _CLOSES[t]:
                return i
        elif kind == "INDENT":
            depth += 1
            if depth > indents:
                return i
        elif kind == "DEDENT":
            depth -= 1
    return len(kinds) - 1 if open_brackets else -1


def _bounded(language: str, text: str, kinds: list[str], texts: list[str]) -> int:
    """The token at which a Python text goes beyond the language's own nesting, -1 for none and for other languages."""
    if language == "py" and (text.count("(") + text.count("[") + text.count("{") > PYTHON_BRACKETS or kinds.count("INDENT") > PYTHON_INDENTS):
        at = _nesting(kinds, texts, PYTHON_BRACKETS, PYTHON_INDENTS)
        return at if at >= 0 and (texts[at] in ("(", "[", "{") or kinds[at] == "INDENT") else -1
    return -1


def accepts(text: str, language: str) -> bool | None:
    """Whether the grammar of a language takes the whole text; null if it is nested too deep to tell and its brackets match."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
    kinds, texts, _, lines = lexer(language)(_plain(text))
    try:
        return _bounded(language, text, kinds, texts) < 0 and grammar(language).accepts(kinds, texts, lines)
    except RecursionError:
        return None if _nesting(kinds, texts, len(kinds), len(kinds)) < 0 else False


def parse(text: str, language: str) -> tuple[int, int, bool]:
    """(position of the furthest failure or -1, end of the text, whether a token there has no end). The whole text must be taken."""
    text = _plain(text)
    kinds, texts, places, lines = lexer(language)(text)
    at = _bounded(language, text, kinds, texts)
    at = at if at >= 0 else grammar(language).parse(kinds, texts, lines)
    return (-1, len(text), False) if at < 0 else (places[at], len(text), kinds[at] == "EOF" or (kinds[at] == "BAD" and at + 2 >= len(kinds)))


def judge(text: str, language: str) -> tuple[bool | None, int | None, int | None, str | None]:
    """(valid, line and position of the furthest failure, cause) of a text.

    Causes: ``conflict`` (a merge marker stands among the tokens), ``truncated`` (the text ends too early), ``other_language`` (the
    grammar of another language takes all of it), ``syntax``. Of a text nested beyond DEPTH only the brackets are judged: it is invalid if they do not match, else valid is null and the cause ``too_deep``.
    """
    good = accepts(text, language)
    if good or good is None:
        return good, None, None, None if good else "too_deep"
    plain = _plain(text)
    try:
        at, _, open_end = parse(plain, language)
    except RecursionError:
        kinds, texts, places, _ = lexer(language)(plain)
        token = _nesting(kinds, texts, len(kinds), len(kinds))
        at, open_end = places[token], kinds[token] == "EOF"
    line = plain.count("\n", 0, at) + 1
    cause = "syntax"
    start = plain.rfind("\n", 0, at) + 1
    if _MARKER.match(plain, start) or (_MARKER.search(plain) and set(lexer(language)(plain)[2]) & {m.start() for m in _MARKER.finditer(plain)}):
        cause = "conflict"
    elif at >= len(plain.rstrip()) or open_end:
        cause = "truncated"
    elif any(accepts(plain, other) for other in GRAMMARS if other != language):
        cause = "other_language"
    return False, line, at, cause


def language_of(file: str) -> Column:
    """The grammar for a file's extension, null for others."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return names[F.element_at(F.split(file, r"\."), -1)]


def syntax_verdicts(sources: DataFrame, causes: bool = True) -> DataFrame:
    """``(file, language, valid, line, position, cause)`` for every row with a text and a known extension.

    Each text goes through the packrat grammar of its extension's language and must be taken whole; line and position are those of the
    furthest failure, cause as in :func:`judge`, found by a second parse of invalid texts; without ``causes`` these three are null. A text is parsed where it is read; only a scan of fewer partitions than cores is shared out first.

    A leading byte-order mark and CRLF are no errors, empty and blank texts are valid. valid is null for a text nested too deep to judge whose brackets match. Null texts, null files and unknown
    extensions give no row. Repeated rows give repeated verdicts; an empty table none. Extra columns are ignored. Long texts are parsed whole.
    """
    ship(sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(1).to_pylist()
            found = [judge(t.as_py(), lang) if causes else (accepts(t.as_py(), lang), None, None, None) for t, lang in zip(batch.column(2), languages)]
            valid, line, position, cause = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(valid, pa.bool_()), pa.array(line, pa.int32()), pa.array(position, pa.int32()), pa.array(cause, pa.string())],
                names=["file", "language", "valid", "line", "position", "cause"],
            )

    rows = sources.select("file", language_of("file").alias("language"), "text").where(F.col("text").isNotNull() & F.col("language").isNotNull())
    return spread(rows).mapInArrow(run, "file string, language string, valid boolean, line int, position int, cause string")


def invalid_files(sources: DataFrame) -> DataFrame:
    """``(file)``: each file once that has a text its language's grammar rejects."""
    return syntax_verdicts(sources, causes=False).where("not valid").select("file").distinct()


def syntax_rates(sources: DataFrame) -> DataFrame:
    """``(repo, language, n_files, n_invalid, share, n_conflict, n_truncated, n_other_language, n_too_deep)``; a file counts once and is invalid if one of its texts is, too deep if one of them is and none is invalid."""
    bad = F.coalesce(~F.col("valid"), F.lit(False))
    per_file = syntax_verdicts(sources).groupBy("file", "language").agg(F.max(F.struct(bad.alias("bad"), F.col("cause"))).alias("v"))
    count = lambda c: F.count(F.when(F.col("v.cause") == c, 1)).alias(f"n_{c}")
    out = per_file.groupBy(F.substring_index("file", "/", 1).alias("repo"), "language").agg(F.count("*").alias("n_files"), F.count(F.when(F.col("v.bad"), 1)).alias("n_invalid"), *map(count, ("conflict", "truncated", "other_language", "too_deep")))
    return out.withColumn("share", F.col("n_invalid") / F.col("n_files"))


def diagnostics_report(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``(language, n_files, n_invalid, n_reported, n_wrong)``: what the current diagnostics of the files say of the verdicts.

    A file is reported if one of its diagnostics is an error; a missing severity means error, text that is not JSON is no diagnostic.
    n_reported counts invalid files that are reported, n_wrong valid ones. Files without a row count as not reported.
    """
    per_file = syntax_verdicts(sources).groupBy("file", "language").agg(F.coalesce(F.max(~F.col("valid")), F.lit(False)).alias("bad"))
    newest = files.where(F.col("file").isNotNull()).groupBy("file").agg(F.max_by("diagnostics", F.coalesce(F.col("indexed_at"), F.lit("0001-01-01").cast(files.schema["indexed_at"].dataType))).alias("diagnostics"))
    parsed = F.transform("diagnostics", lambda d: F.from_json(d, "severity string, code string, message string"))
    said = F.exists(parsed, lambda d: (d["message"].isNotNull() | d["code"].isNotNull() | d["severity"].isNotNull()) & (F.coalesce(d["severity"], F.lit("error")) == "error"))
    joined = per_file.join(newest.select("file", F.coalesce(said, F.lit(False)).alias("said")), "file", "left")
    said_so = F.coalesce("said", F.lit(False))
    return joined.groupBy("language").agg(F.count("*").alias("n_files"), F.count(F.when(F.col("bad"), 1)).alias("n_invalid"), F.count(F.when(F.col("bad") & said_so, 1)).alias("n_reported"), F.count(F.when(~F.col("bad") & said_so, 1)).alias("n_wrong"))
