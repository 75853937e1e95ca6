"""Deeply nested records to related flat tables, in one pass.

A depth-first visitor walks each record once and emits every row of every output table as (tag, keys, payload). The rows
are written partitioned by tag, so each flat table is one folder that gets its schema on read and is scanned alone.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import Scratch, ship_package

#: The flat tables. ``unreadable`` has the deliveries that hold no record.
TAGS = ("record", "shape", "point", "unreadable")
_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\Z")

PAYLOADS = {
    "record": "version string, image_path string, image_height int, image_width int, flags string",
    "shape": "label string, labels array<string>, shape_type string, group_id bigint, flags string, depth int",
    "point": "x double, y double",
    "unreadable": "reason string",
}
EMITTED = "tag string, record_id bigint, delivery_id bigint, copy bigint, row_key string, parent_key string, pos int, payload struct<" + ", ".join(f"{t}: struct<{p.replace(' ', ': ').replace(',:', ',')}>" for t, p in PAYLOADS.items()) + ">"


def number(v: object) -> float | None:
    """A finite number, quoted or not; booleans, NaN and anything else give None."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        if not _NUMBER.match(v):
            return None
        v = float(v)
    if isinstance(v, (int, float)):
        try:
            f = float(v)
        except OverflowError:
            return None
        return f if math.isfinite(f) else None
    return None


# --- JSON of any depth -------------------------------------------------------------------------------------------------

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_CONSTANTS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
#: More digits than Python converts at once; such a number is read as a float.
_LONG_NUMBER = 4000


def _scalar(m: re.Match) -> object:
    if m[0] in _CONSTANTS:
        return _CONSTANTS[m[0]]
    return float(m[0]) if m[1] or m[2] or len(m[0]) > _LONG_NUMBER else int(m[0])


def parse_deep(text: str) -> object:
    """JSON parsed with a stack of its own, so that no depth is too great; ValueError where the text is none."""
    n, at = len(text), _SPACE.match(text, 0).end()
    open_: list[dict | list] = []
    keys: list[str] = []
    while True:
        # a value starts here
        c = text[at : at + 1]
        value: object
        if c in ("{", "["):
            open_.append({} if c == "{" else [])
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
                value = open_.pop()
            else:
                if c == "{":
                    key, at = _key(text, at)
                    keys.append(key)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1)
        elif m := _SCALAR.match(text, at):
            value, at = _scalar(m), m.end()
        else:
            raise ValueError(f"no value at {at}")
        # it ends here; close whatever ends with it
        while True:
            at = _SPACE.match(text, at).end()
            if not open_:
                if at != n:
                    raise ValueError(f"more text at {at}")
                return value
            inside = open_[-1]
            if isinstance(inside, dict):
                inside[keys.pop()] = value
            else:
                inside.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(inside, dict):
                    key, at = _key(text, at)
                    keys.append(key)
                break
            if c != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError(f"neither , nor an end at {at}")
            value = open_.pop()
            at += 1


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no : at {at}")
    return key, _SPACE.match(text, at + 1).end()


def parse(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return parse_deep(text)
    except json.JSONDecodeError:
        raise
    except ValueError:  # a number longer than Python converts
        return parse_deep(text)


def to_text(v: object) -> str:
    """JSON text of a parsed value, of any depth."""
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, v)]
    while todo:
        written, x = todo.pop()
        if written:
            out.append(x)
        elif isinstance(x, dict) and x:
            todo.append((True, "}"))
            for k, (key, y) in reversed(list(enumerate(x.items()))):
                todo += [(False, y), (True, ("{" if k == 0 else ", ") + json.dumps(key, ensure_ascii=False) + ": ")]
        elif isinstance(x, list) and x:
            todo.append((True, "]"))
            for k, y in reversed(list(enumerate(x))):
                todo += [(False, y), (True, "[" if k == 0 else ", ")]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


# --- the record --------------------------------------------------------------------------------------------------------


def readable(raw: str | None) -> dict | None:
    """The record in a delivery, out of a byte-order mark, JSON text held in JSON strings and envelopes, however many; None if
    there is none. Every step goes on with a part of what it had, so it ends."""
    v: object = raw
    while True:
        if isinstance(v, str):
            try:
                v = parse(v.lstrip("﻿").strip())
            except ValueError:
                return None
        elif isinstance(v, dict):
            if "shapes" in v:
                return v
            inner = [x for x in v.values() if isinstance(x, dict) and ("shapes" in x or len(v) <= 2)]
            inner = inner or [x for x in v.values() if isinstance(x, str) and "shapes" in x]
            inner = inner or [x for x in v.values() if isinstance(x, list) and len(x) == 1 and isinstance(x[0], (dict, list, str))]
            if len(inner) != 1:
                return None
            v = inner[0]
        elif isinstance(v, list) and len(v) == 1:
            v = v[0]
        else:
            return None


def point(v: object) -> tuple[float, float] | None:
    if isinstance(v, dict):
        x, y = number(v.get("x")), number(v.get("y"))
    elif isinstance(v, list) and len(v) >= 2:
        x, y = number(v[0]), number(v[1])
    else:
        return None
    return None if x is None or y is None else (x, y)


def labels(v: object) -> list[str]:
    """Labels come as text, as a list of texts or as an object with a name."""
    out: list[str] = []
    for x in v if isinstance(v, list) else [v]:
        x = x.get("name") if isinstance(x, dict) else x
        if x is not None and not isinstance(x, (dict, list)):
            out.append(x if isinstance(x, str) else to_text(x))
    return out


def _int(v: object, bits: int) -> int | None:
    f = number(v)
    return int(f) if f is not None and abs(f) < 2 ** (bits - 1) else None


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else to_text(v)


def _flags(v: object) -> str | None:
    return to_text(v) if isinstance(v, dict) and v else None


def visit(rec: dict) -> Iterator[tuple[str, str, str | None, int, tuple]]:
    """Depth first, with a stack of its own: (tag, row key, parent key, position, payload in the order of PAYLOADS)."""
    yield "record", "", None, 0, (_text(rec.get("version")), _text(rec.get("imagePath")), _int(rec.get("imageHeight"), 32), _int(rec.get("imageWidth"), 32), _flags(rec.get("flags")))
    stack: list[tuple[str, int, int, dict]] = []

    def push(entries: object, parent: str, depth: int) -> None:
        if isinstance(entries, list):
            stack.extend((parent, i, depth, s) for i, s in reversed(list(enumerate(entries))) if isinstance(s, dict))

    push(rec.get("shapes"), "", 0)
    while stack:
        parent, i, depth, s = stack.pop()
        key = f"{parent}.{i}" if parent else str(i)
        names = labels(s.get("label"))
        yield "shape", key, parent, i, (names[0] if names else None, names, _text(s.get("shape_type")), _int(s.get("group_id"), 64), _flags(s.get("flags")), depth)
        points = s.get("points")
        if isinstance(points, list):
            for j, p in enumerate(points):
                if (xy := point(p)) is not None:
                    yield "point", f"{key}#{j}", key, j, xy
        push(s.get("children"), key, depth + 1)


_STRUCTS = {
    "record": pa.struct([("version", pa.string()), ("image_path", pa.string()), ("image_height", pa.int32()), ("image_width", pa.int32()), ("flags", pa.string())]),
    "shape": pa.struct([("label", pa.string()), ("labels", pa.list_(pa.string())), ("shape_type", pa.string()), ("group_id", pa.int64()), ("flags", pa.string()), ("depth", pa.int32())]),
    "point": pa.struct([("x", pa.float64()), ("y", pa.float64())]),
    "unreadable": pa.struct([("reason", pa.string())]),
}
_PAYLOAD = pa.struct(list(_STRUCTS.items()))
_KEYS = pa.schema([("tag", pa.string()), ("record_id", pa.int64()), ("delivery_id", pa.int64()), ("copy", pa.int64()), ("row_key", pa.string()), ("parent_key", pa.string()), ("pos", pa.int32())])
_ARROW = _KEYS.append(pa.field("payload", _PAYLOAD))
#: Rows, and characters of keys, held before a batch is given on: deep records have long keys.
_FLUSH, _FLUSH_CHARS = 20_000, 16 << 20


def _batch(tag: str, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    cols = list(zip(*rows, strict=True))
    own = _STRUCTS[tag]
    fields = [pa.array(c, own.field(k).type) for k, c in enumerate(zip(*cols[-1], strict=True))]
    structs = [pa.StructArray.from_arrays(fields, fields=list(own)) if t == tag else pa.nulls(n, s) for t, s in _STRUCTS.items()]
    keys = [pa.array([tag] * n, pa.string())] + [pa.array(c, f.type) for c, f in zip(cols[:-1], list(_KEYS)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*keys, pa.StructArray.from_arrays(structs, fields=list(_PAYLOAD))], schema=_ARROW)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[str, list[tuple]] = {t: [] for t in TAGS}
    chars, copy = 0, TaskContext.get().partitionId() << 40
    for b in batches:
        for rid, did, raw in zip(*(b.column(c) for c in ("record_id", "delivery_id", "raw")), strict=True):
            rid, did, raw = rid.as_py(), did.as_py(), raw.as_py()
            rec = readable(raw)
            copy += 1
            if rid is None or rec is None:
                reason = "no record id" if rid is None else "null" if raw is None else "empty" if not raw.strip() else "not readable"
                held["unreadable"].append((rid, did, copy, "", None, 0, (reason,)))
                continue
            for tag, key, parent, pos, payload in visit(rec):
                held[tag].append((rid, did, copy, key, parent, pos, payload))
                chars += 2 * len(key)
                if len(held[tag]) >= _FLUSH or chars >= _FLUSH_CHARS:
                    for t, rows in held.items():
                        if rows and (t == tag or chars >= _FLUSH_CHARS):
                            yield _batch(t, rows)
                            held[t] = []
                    chars = sum(2 * len(r[3]) for rows in held.values() for r in rows)
    for t, rows in held.items():
        if rows:
            yield _batch(t, rows)


def emit_tagged(deliveries: DataFrame, record_col: str = "record_id", delivery_col: str = "delivery_id", raw_col: str = "raw") -> DataFrame:
    """One row for each row of each flat table, of every readable delivery, and one for each delivery that is not. Other columns,
    whatever their names, are not read.

    Null, empty, cut-off or foreign raw text and a null record id give a row tagged ``unreadable`` with the reason. Neither the
    depth of shapes nor the number of envelopes is bounded.
    """
    ship_package(deliveries.sparkSession)
    c = deliveries.select(F.col(record_col).cast("bigint").alias("record_id"), F.col(delivery_col).cast("bigint").alias("delivery_id"), F.col(raw_col).cast("string").alias("raw"))
    return c.mapInArrow(_emit, EMITTED)


def flatten_records(deliveries: DataFrame, record_col: str = "record_id", delivery_col: str = "delivery_id", raw_col: str = "raw") -> dict[str, DataFrame]:
    """records, shapes and points of nested records: {"record", "shape", "point"} as DataFrames with their schemas applied, and
    {"unreadable"}: (record_id, delivery_id, reason) of each delivery that holds no record.

    Every row has record_id, row_key and parent_key: a point's parent_key is its shape's row_key, a shape's that of its
    parent shape or "" for the record itself. row_key is the path of positions ("3.0.1"; a point adds "#" and its own).
    The emitted rows are written once, partitioned by tag. A record delivered several times is represented by its smallest
    readable delivery_id (null ids sort last), and by one row where that delivery is repeated: each row read has a number of its
    own (``copy``), by which its rows are chosen, so a record that holds most deliveries is spread over all tasks. An empty
    input gives four empty tables.
    """
    spark = deliveries.sparkSession
    scratch = Scratch(spark, "nested")
    tagged = scratch.write(emit_tagged(deliveries, record_col, delivery_col, raw_col), ["tag"])
    first = F.min(F.struct(F.coalesce("delivery_id", F.lit(2**63 - 1)).alias("d"), "copy"))
    chosen = tagged.filter("tag = 'record'").groupBy("record_id").agg(first.alias("m")).select("record_id", F.col("m.copy").alias("copy"))
    out = {}
    for tag in TAGS:
        rows = tagged.filter(F.col("tag") == tag)
        if tag == "unreadable":
            out[tag] = rows.select("record_id", "delivery_id", "payload.unreadable.*")
            continue
        rows = rows.join(chosen, ["record_id", "copy"], "left_semi")
        out[tag] = rows.select("record_id", "row_key", "parent_key", "pos", f"payload.{tag}.*")
    return out
