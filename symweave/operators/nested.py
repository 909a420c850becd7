"""Deeply nested semi-structured records as related flat tables that keep parent and file."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import ship

#: Keys that hold lists; a single object there counts as place 0.
LIST_KEYS = frozenset(["nodes", "edges", "diagnostics", "related", "fixes", "edits", "symbols", "relations", "tests", "children", "bindings", "uses", "statements", "controls"])
#: The columns of the fixed-width rows of a packed ast.
PACKED = {
    "bindings": ("id", "name", "kind", "type", "line", "end", "offset", "end_offset", "scope"),
    "uses": ("line", "end", "offset", "end_offset", "scope", "binding", "read", "write"),
    "statements": ("line", "end", "offset", "end_offset", "scope", "block"),
    "controls": ("line", "end", "offset", "end_offset", "scope", "kind"),
}


class Repeated(dict):
    """An object whose text may repeat a key: the first value of each key, and all of them in ``pairs``."""

    def __init__(self, pairs: list):
        super().__init__(reversed(pairs))
        self.pairs = pairs

    def add(self, key: str, value) -> None:
        self.pairs.append((key, value))
        self.setdefault(key, value)


class Number:
    """A number that int and float do not take, as its text."""

    def __init__(self, text: str):
        self.text = text


def _object(pairs: list) -> dict:
    found = dict(pairs)
    return found if len(found) == len(pairs) else Repeated(pairs)


def _float(text: str):
    value = float(text)
    return value if math.isfinite(value) else Number(text)


def _int(text: str):
    try:
        return int(text)
    except ValueError:
        return Number(text)


def _reject(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_reject, parse_float=_float, object_pairs_hook=_object).decode
_decode_one = json.JSONDecoder(parse_constant=_reject, parse_float=_float, parse_int=_int).decode
_dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')
_CONTROL = re.compile(r"\\(?:u00([01][0-9a-f])|.)")
_ESCAPE = re.compile(r"\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|(u[dD][89a-fA-F])|.)", re.S)


def stream_decode(text: str):
    """The value of a JSON text, read token by token with a stack of its own, so that depth has no limit but memory; ValueError if it is none.

    The C decoder takes over what is nested less deep; see :func:`parse`.
    """
    match, at, end = _TOKEN.match, 0, len(text.rstrip(" \t\n\r"))
    root: list = []
    stack: list = [root]
    keys: list = [None]
    # what may come: a value, a value or the end of a list, a key or the end of an object, a key, a colon, a comma or an end
    want = "value"
    while at < end:
        m = match(text, at)
        if m is None:
            raise ValueError(at)
        at = m.end()
        sign, string, plain = m.groups()
        top = stack[-1]
        if want in ("key", "key or end") and string:
            keys[-1], want = _decode_one(string), "colon"
        elif want == "colon" and sign == ":":
            want = "value"
        elif want in ("value", "value or end") and (string or plain or sign in ("{", "[")):
            new = Repeated([]) if sign == "{" else [] if sign == "[" else _decode_one(string or plain)
            if type(top) is Repeated:
                top.add(keys[-1], new)
            else:
                top.append(new)
            want = "comma or end"
            if sign:
                stack.append(new)
                keys.append(None)
                want = "key or end" if sign == "{" else "value or end"
        elif len(stack) > 1 and want in ("comma or end", "key or end", "value or end") and sign == ("}" if type(top) is Repeated else "]"):
            stack.pop()
            keys.pop()
            want = "comma or end"
        elif len(stack) > 1 and want == "comma or end" and sign == ",":
            want = "key" if type(top) is Repeated else "value"
        else:
            raise ValueError(at)
    if len(stack) > 1 or len(root) != 1:
        raise ValueError(end)
    return root[0]


def _read(text: str):
    """The value of a JSON text; ValueError if it is none. Half a pair of surrogates is no character, so a text with one is none."""
    if ("\\ud" in text or "\\uD" in text) and any(m.group(1) for m in _ESCAPE.finditer(text)):
        raise ValueError(text)
    try:
        return _decode(text)
    except json.JSONDecodeError:
        raise
    except (RecursionError, ValueError):
        # nested too deeply, or an integer of more digits than int takes
        return stream_decode(text)


def parse(record: str | None):
    """The value that a record stands for: JSON, or a JSON string that holds JSON, encoded any number of times; None if there is none."""
    while isinstance(record, str):
        try:
            record = _read(record)
        except ValueError:
            return None
    return record


def objects(value, *, listed: bool = True) -> Iterator[tuple[str, str, str, int, dict]]:
    """``(path, parent path, table, ordinal, object)`` of every object that stands in a list, or of every other one, in document order.

    The value is walked with a stack of its own, so depth has no limit but memory. ``table`` is the path without places; the
    parent is the nearest object above that stands in a list itself, empty for the record. A packed row stands as an object with the columns of PACKED,
    and as the list that it is for what stands in it. All values of a repeated key are walked.
    """
    stack = [(value, "", "", "", 0, False, "", False)]
    while stack:
        item, path, parent, tab, ordinal, place, key, packed = stack.pop()
        below = []
        if isinstance(item, dict):
            if listed if place else not listed:
                yield path, parent, tab, ordinal, item
            if place:
                parent = path
            packed = item.get("format") == "pcg-ast-1"
            root = item is value
            dot, tdot = path + "." if path else "", tab + "." if tab else ""
            for k, v in item.items() if type(item) is dict else item.pairs:
                kind = type(v)
                if kind is str and root and k == "intent":
                    v = parse(v)
                    kind = type(v)
                if kind is list:
                    if v:
                        below.append((v, dot + k, parent, tdot + k, 0, False, k, packed))
                elif kind is dict or kind is Repeated:
                    if k in LIST_KEYS:
                        below.append((v, dot + k + "[0]", parent, tdot + k + "[]", 0, True, k, False))
                    else:
                        below.append((v, dot + k, parent, tdot + k, 0, False, k, False))
        else:
            if place:
                if listed:
                    yield path, parent, tab, ordinal, dict(zip(PACKED[key], item))
                parent = path
            names = PACKED.get(key) if packed else None
            rows = tab + "[]"
            for i, v in enumerate(item):
                kind = type(v)
                if kind is dict or kind is Repeated:
                    below.append((v, f"{path}[{i}]", parent, rows, i, True, key, False))
                elif kind is list and v:
                    below.append((v, f"{path}[{i}]", parent, rows, i, names is not None and len(v) == len(names), key, False))
        below.reverse()
        stack += below


def _deep(value) -> bool:
    return isinstance(value, dict) or (type(value) is list and any(type(x) in (dict, Repeated, list) for x in value))


def _encode(value) -> str:
    """JSON without blanks, the digits of escapes in capitals."""
    text = _dump(value)
    return _CONTROL.sub(lambda m: "\\u00" + m[1].upper() if m[1] else m[0], text) if "\\u00" in text else text


def _number(value) -> str:
    """The text of a number as other writers of JSON have it: without exponent from 1e-6 to below 1e21."""
    if type(value) is Number:
        return value.text
    text = repr(value)
    if "e" not in text:
        return text
    digits, _, power = text.partition("e")
    power = int(power)
    if not -7 < power < 21:
        return f"{digits}e{power}"
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, part = digits.partition(".")
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{whole}{part}"
    return f"{sign}{whole}{part}{'0' * (power - len(part))}.0"


def _json(value, *, width: int | None = None) -> str | None:
    """The JSON text of a value, written with a stack of its own.

    With ``width``, objects are null, and so are lists of that width right in the value, because they are rows elsewhere; None if nothing else is left.
    """
    out, left = [], width is None
    stack: list = [(False, value, 0)]
    while stack:
        done, x, depth = stack.pop()
        kind = type(x)
        if done:
            out.append(x)
        elif kind is list and not (width and depth == 1 and len(x) == width):
            left = left or not x
            stack.append((True, "]", 0))
            for i in range(len(x) - 1, -1, -1):
                stack.append((False, x[i], depth + 1))
                if i:
                    stack.append((True, ",", 0))
            out.append("[")
        elif kind is dict or kind is Repeated or kind is list:
            if width is not None:
                out.append("null")
                continue
            stack.append((True, "}", 0))
            pairs = list(x.items()) if kind is dict else x.pairs
            for i in range(len(pairs) - 1, -1, -1):
                stack.append((False, pairs[i][1], depth + 1))
                stack.append((True, ("," if i else "") + _encode(pairs[i][0]) + ":", 0))
            out.append("{")
        else:
            left = left or x is not None
            out.append(_number(x) if kind is float or kind is Number else _encode(x))
    return "".join(out) if left else None


def _plain(value) -> str | None:
    kind = type(value)
    if value is None or kind is str:
        return value
    if kind is int:
        return str(value)
    if kind is float or kind is Number:
        return _number(value)
    if kind is list and any(type(x) in (float, Number) for x in value):
        return _json(value)
    return _encode(value)


def triples(record: str | None, *, listed: bool = True, whole: dict[str, list[str]] | None = None) -> Iterator[tuple[int, str, str, str, int, str, str | None]]:
    """``(number, table, object path, parent path, ordinal, field, value)`` of every field of every object of a record that is no object itself.

    The number tells objects of one path apart, as keys may hold dots and brackets or be repeated; of a repeated field the first value counts.
    A list is one value, written as JSON; objects in it, which have rows of their own, are null there, and a list of nothing else is no field. Numbers and
    booleans keep their JSON form. An object without such fields gives one triple with an empty field. The fields that ``whole`` names for a table
    are JSON with all that is in them.
    """
    value = parse(record)
    if not isinstance(value, (dict, list)):
        return
    for number, (path, parent, tab, ordinal, item) in enumerate(objects(value, listed=listed)):
        some = False
        full = whole.get(tab, ()) if whole else ()
        for k, v in item.items():
            if k in full:
                v = _json(v) if _deep(v) else _plain(v)
            elif _deep(v):
                v = _json(v, width=len(PACKED[k]) if k in PACKED and item.get("format") == "pcg-ast-1" else 0)
                if v is None:
                    continue
            elif item is value and k == "intent" and type(v) is str and isinstance(parse(v), (dict, list)):
                continue
            else:
                v = _plain(v)
            some = True
            yield number, tab, path, parent, ordinal, k, v
        if not some:
            yield number, tab, path, parent, ordinal, "", None


def current(files: DataFrame, columns: list[str]) -> DataFrame:
    """The row with the greatest indexed_at of each file; ties by the greatest values, null times are the oldest."""
    row = F.struct("indexed_at", *columns)
    return files.where(F.col("file").isNotNull()).groupBy("file").agg(F.max(row).alias("row")).select("file", *[F.col(f"row.{c}").alias(c) for c in columns])


def nested_objects(files: DataFrame, *, record: str = "record", whole: dict[str, list[str]] | None = None) -> DataFrame:
    """``(file, path, parent, table, ordinal, fields)``: every object that stands in a list of a file's current record.

    Each record is read in its task into path-value-ordinal triples, grouped by their repeated ancestor; the fields
    of one object come out as a map from which :func:`flat_table` pivots a table, see :func:`triples`. parent is the path of the nearest listed object above, empty under the record itself.

    A record or ``intent`` that is a JSON string holding JSON stands for it, however often it was encoded; a single object under a key of LIST_KEYS is place 0; null elements keep
    their place and give no row; null, empty, cut or otherwise invalid records give none. NaN, Infinity and half a pair of surrogates are
    invalid. Any depth and any number is read. Rows of a packed ast are objects if they have their section's width, and objects in them stand in a list as others do. A repeated key
    gives the objects of all its values. Only the row with the greatest indexed_at of a file counts. Repeated
    rows count once. An empty table gives no rows; extra columns are ignored.
    """
    return _grouped(files, record, True, whole)


def single_objects(files: DataFrame, *, record: str = "record", whole: dict[str, list[str]] | None = None) -> DataFrame:
    """The other objects in the columns and by the rules of :func:`nested_objects`: the record itself and every object that stands in no list."""
    return _grouped(files, record, False, whole)


def _grouped(files: DataFrame, record: str, listed: bool, whole: dict[str, list[str]] | None) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, paths, parents, tables, places, maps = columns = [], [], [], [], [], []
        size = 0

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(parents, pa.string()), pa.array(tables, pa.string()), pa.array(places, pa.int32()), pa.array(maps, pa.map_(pa.string(), pa.string()))]
            out = pa.RecordBatch.from_arrays(arrays, names=["file", "path", "parent", "table", "ordinal", "fields"])
            for x in columns:
                x.clear()
            return out

        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1)):
                last = None
                for number, tab, path, parent, ordinal, k, v in triples(text.as_py(), listed=listed, whole=whole):
                    if number != last:
                        if len(paths) > 50_000 or size > 50_000_000:
                            yield batch()
                            size = 0
                        names.append(file)
                        paths.append(path)
                        parents.append(parent)
                        tables.append(tab)
                        places.append(ordinal)
                        maps.append([])
                        last = number
                        size += 3 * len(path)
                    if k or v is not None:
                        maps[-1].append((k, v))
                        size += len(v or "")
        yield batch()

    return current(files, [record]).select("file", F.col(record).cast("string")).mapInArrow(run, "file string, path string, parent string, table string, ordinal int, fields map<string,string>")


def flat_table(objects_of: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One flat table of :func:`nested_objects`: file, path, parent, ordinal and the given fields as columns (null where a field is absent)."""
    rows = objects_of.where(F.col("table") == table)
    return rows.select("file", "path", "parent", "ordinal", *[F.col("fields").getItem(c).alias(f"f_{c}") for c in columns])


def table_sizes(objects_of: DataFrame) -> DataFrame:
    """``(table, n_rows, n_files, n_linked)`` of every flat table that the records hold; n_linked counts rows under another object."""
    return objects_of.groupBy("table", "file").agg(F.count("*").alias("n"), F.count(F.when(F.col("parent") != "", 1)).alias("l")).groupBy("table").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"), F.sum("l").alias("n_linked"))
