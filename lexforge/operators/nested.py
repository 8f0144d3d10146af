"""Deeply nested JSON records to flat, linked tables (problem 1).

``shred`` reads each record once and streams it out as path-value-ordinal triples. ``objects`` groups the
triples by their repeated ancestor, the object that holds them, as they stream by: the triples of one
object never leave their record, so nothing is shuffled. ``group_tables`` pivots each group of paths into
one table; ``identified_objects`` reads the identity columns of the same objects and links each to its
nearest identified ancestor.

Defined results: null, empty or invalid JSON gives no triples; JSON kept as text inside JSON is
entered at any depth, text that only looks like JSON stays a value; field names are compared without
case and separators; a repeated name within one object keeps the last value, as in JSON practice; a
list of objects, a single object in its place, and objects that only stand for a list ("items", "item_0")
belong to the same table; an object without values of its own is a row without fields, so that links hold.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

OBJECTS = "record_id string, delivery long, table_path string, node int, parent_path string, parent_node int, ancestors array<int>, ordinals array<int>, cells map<string,array<string>>"
TRIPLES = "record_id string, delivery long, table_path string, node int, ancestors array<int>, ordinals array<int>, field string, value string"

#: The fields that give an object its identity, in order of precedence.
IDENTITY_FIELDS = ("occurrence_id", "difference_id", "trace_id", "impact_id", "finding_id", "table_id", "ref_id")


def squash(name: str) -> str:
    """A field name without case and separators: changeId, CHANGE-ID and change_id agree."""
    return "".join(c for c in name.lower() if c.isalnum())


def snake(name: str) -> str:
    """A readable canonical spelling of a field name."""
    return re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")


def _reject_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\r\n]*")
_ATOM = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _parse_deep(text: str):
    """JSON without recursion, for records nested beyond the interpreter's stack."""
    stack: list[tuple[object, str | None]] = []
    at, n = _SPACE.match(text).end(), len(text)
    while True:
        # one value starts at `at`
        c = text[at : at + 1]
        if c in ("{", "["):
            box: object = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = box, at + 1
            else:
                if c == "{":
                    key, at = _key(text, at)
                    stack.append((box, key))
                else:
                    stack.append((box, None))
                continue
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError("not JSON")
            value, at = json.loads(m[0]), m.end()
        # close as many containers as end here
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != n:
                    raise ValueError("text after the value")
                return value
            box, key = stack.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c = text[at : at + 1]
            at = _SPACE.match(text, at + 1).end()
            if c == ",":
                if isinstance(box, dict):
                    key, at = _key(text, at)
                stack.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not JSON")
            value = box


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("a name was expected")
    key, at = json.decoder.scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("a colon was expected")
    return key, _SPACE.match(text, at + 1).end()


def parse(text: str):
    """The value of a JSON text; ValueError if it is invalid."""
    try:
        return json.loads(text.strip("\ufeff \t\r\n"), parse_constant=_reject_constant)
    except RecursionError:
        return _parse_deep(text.strip("\ufeff \t\r\n"))


def _enter(value):
    """Follow JSON kept as text inside JSON to the object or list it holds, else the value itself."""
    inner = value
    while isinstance(inner, str):
        if inner.lstrip("\ufeff \t\r\n")[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = parse(inner)
        except ValueError:
            return value
    return inner if isinstance(inner, (dict, list)) else value


_NUMBERED = re.compile(r"(?:item|entry|element)?_?\d+", re.I)
_WRAPPERS = frozenset({"item", "items", "entry", "entries", "element", "elements"})
_LENGTHS = frozenset({"count", "total", "size", "length", "n"})


def _unwrap(value):
    """Objects that only stand for a list: {"count": 2, "items": [...]} and {"item_0": ..., "item_1": ...}.

    A length beside the items is what the rows say themselves.
    """
    while isinstance(value, dict):
        names = {squash(k): k for k in value}
        held = [k for n, k in names.items() if n in _WRAPPERS]
        if len(held) != 1 or not all(n in _LENGTHS for n, k in names.items() if k != held[0]) or len(names) != len(value):
            break
        inner = _enter(value[held[0]])
        if not isinstance(inner, (dict, list)) or any(isinstance(v, (dict, list)) for k, v in value.items() if k != held[0]):
            break
        value = inner
    if isinstance(value, dict) and value and all(_NUMBERED.fullmatch(k) for k in value):
        return list(value.values())
    return value


def walk(root, wanted: set[str] | None = None, opened=None) -> Iterator[tuple]:
    """(table path, node, ancestors, ordinals, field, value) of every scalar, in document order.

    node is the object's number in document order; ancestors are the numbers of the enclosing objects,
    outermost first; ordinals are the list positions on the way. wanted: squashed names to keep. opened is
    called with (table path, node, ancestors, ordinals) of every object before its first triple.
    """
    count = 0
    # path is where objects found here belong, home the table of the object that holds the value
    stack = [(_enter(root), "", "", -1, (), (), "")]
    while stack:
        value, path, home, owner, ancestors, ordinals, name = stack.pop()
        if isinstance(value, dict):
            node, count = count, count + 1
            if owner >= 0:
                ancestors = (*ancestors, owner)
            if opened:
                opened(path, node, ancestors, ordinals)
            for k, v in reversed(value.items()):
                v = _unwrap(_enter(v))
                if isinstance(v, (dict, list)):
                    stack.append((v, f"{path}.{snake(k)}" if path else snake(k), path, node, ancestors, ordinals, k))
                elif wanted is None or squash(k) in wanted:
                    stack.append((v, path, path, node, ancestors, ordinals, k))
        elif isinstance(value, list):
            for i in range(len(value) - 1, -1, -1):
                v = _unwrap(_enter(value[i]))
                if isinstance(v, (dict, list)) or wanted is None or squash(name) in wanted:
                    stack.append((v, path, home, owner, ancestors, (*ordinals, i), name))
        else:
            text = value if value is None or isinstance(value, str) else json.dumps(value)
            yield home, owner, ancestors, ordinals, snake(name), text


def grouped(root) -> list[tuple]:
    """(table path, node, parent path, parent node, ancestors, ordinals, cells) of every object of a record.

    cells are the object's triples by field, values in document order. A record that is a list of scalars
    hangs on no object (node -1).
    """
    found: dict[int, tuple] = {}

    def opened(path, node, ancestors, ordinals):
        parent = ancestors[-1] if ancestors else None
        found[node] = (path, node, None if parent is None else found[parent][0], parent, ancestors, ordinals, {})

    for path, node, ancestors, ordinals, field, text in walk(root, opened=opened):
        if node not in found:
            found[node] = (path, node, None, None, ancestors, (), {})
        found[node][6].setdefault(field, []).append(text)
    return list(found.values())


def shred(df: DataFrame, record_id: str, json_col: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Path-value-ordinal triples of every record; fields restricts them to these names (any spelling).

    A delivery is one JSON text of a record; node numbers are unique within it.
    """
    wanted = None if fields is None else {squash(f) for f in fields}
    schema = pa.schema(
        [("record_id", pa.string()), ("delivery", pa.int64()), ("table_path", pa.string()), ("node", pa.int32()), ("ancestors", pa.list_(pa.int32())), ("ordinals", pa.list_(pa.int32())), ("field", pa.string()), ("value", pa.string())]
    )

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for rid, delivery, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    value = parse(text)
                except ValueError:
                    continue
                rows += [(rid, delivery, *t) for t in walk(value, wanted)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    source = df.where(F.col(json_col).isNotNull() & (F.trim(json_col) != "") & F.col(record_id).isNotNull())
    return source.select(F.col(record_id).cast("string"), F.xxhash64(json_col), json_col).mapInArrow(run, TRIPLES)


def objects(df: DataFrame, record_id: str, json_col: str) -> DataFrame:
    """One row (columns OBJECTS) for each object of every record: its triples grouped as they stream by.

    parent_path and parent_node name the enclosing object's row. Repeated deliveries repeat their rows.
    """
    ints = pa.list_(pa.int32())
    schema = pa.schema(
        [("record_id", pa.string()), ("delivery", pa.int64()), ("table_path", pa.string()), ("node", pa.int32()), ("parent_path", pa.string()), ("parent_node", pa.int32()), ("ancestors", ints), ("ordinals", ints), ("cells", pa.map_(pa.string(), pa.list_(pa.string())))]
    )

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for rid, delivery, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    value = parse(text)
                except ValueError:
                    continue
                rows += [(rid, delivery, *o[:6], list(o[6].items())) for o in grouped(value)]
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    source = df.where(F.col(json_col).isNotNull() & (F.trim(json_col) != "") & F.col(record_id).isNotNull())
    return source.select(F.col(record_id).cast("string"), F.xxhash64(json_col), json_col).mapInArrow(run, OBJECTS)


def objects_of(triples: DataFrame) -> DataFrame:
    """The same from triples that come from elsewhere, by a shuffle on their object; repetitions fall away."""
    cell = F.struct("field", "ordinals", "value")
    rows = triples.groupBy("record_id", "delivery", "table_path", "node").agg(F.first("ancestors").alias("ancestors"), F.min("ordinals").alias("ordinals"), F.array_sort(F.collect_set(cell)).alias("x"))
    names = F.array_distinct(F.transform("x", lambda c: c["field"]))
    cells = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter("x", lambda c: c["field"] == n), lambda c: c["value"])))
    dot = F.size(F.split("table_path", r"\.")) - 1
    above = F.when(F.col("table_path") != "", F.array_join(F.slice(F.split("table_path", r"\."), F.lit(1), dot), "."))
    return rows.select("record_id", "delivery", "table_path", "node", above.alias("parent_path"), F.try_element_at("ancestors", F.lit(-1)).alias("parent_node"), "ancestors", "ordinals", cells.alias("cells"))


#: Folders over which the tables of staged objects are spread, whatever the number of tables.
FOLDERS = 64


def _folder(path) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(FOLDERS)).cast("int")


def stage_objects(rows: DataFrame, name: str = "objects") -> DataFrame:
    """objects written once, in folders by table, so that a table reads little more than its own rows.

    The rows are balanced over files by table first: a hot table is split, small ones fill few files.
    """
    return stage(rows.withColumn("folder", _folder("table_path")).hint("rebalance", "table_path"), name, "folder")


def group_tables(rows: DataFrame, fields: dict[str, list[str]] | None = None, max_fields: int = 20_000) -> dict[str, DataFrame]:
    """One table for each group of paths that hang on the same (repeated) ancestor.

    rows: objects (best staged by ``stage_objects``) or triples. Each row of a table is one object:
    record_id, delivery, node, parent_path, parent_node, ordinals and its fields as columns; a field with
    several values (a list of scalars) is their JSON list. fields gives the columns of each path; if it is
    None they are looked up, which collects schema names only, never values. More than max_fields names
    (as where ids serve as field names) are refused, as they are data then: give the fields.
    """
    if "cells" not in rows.columns:
        rows = objects_of(rows)
    if fields is None:
        names = rows.select("table_path", F.explode_outer(F.map_keys("cells")).alias("field")).distinct().limit(max_fields + 1).collect()
        if len(names) > max_fields:
            raise ValueError(f"more than {max_fields} fields")
        fields = {}
        for path, name in sorted(names, key=lambda r: (r[0], r[1] or "")):
            fields.setdefault(path, []).extend([] if name is None else [name])
    fixed = ("record_id", "delivery", "node", "parent_path", "parent_node", "ordinals")
    out = {}
    for path, names in fields.items():
        mine = rows.where((F.col("table_path") == path) & (F.col("node") >= 0))
        if "folder" in rows.columns:
            mine = mine.where(F.col("folder") == _folder(F.lit(path)))
        one = lambda n: F.try_element_at("cells", F.lit(n))
        values = [F.when(F.size(one(n)) > 1, F.to_json(one(n))).otherwise(F.try_element_at(one(n), F.lit(1))).alias(n if n not in fixed else f"{n}_") for n in names]
        out[path] = mine.select(*fixed, *values)
    return out


def identified(rows: DataFrame, identity: tuple[str, ...] = IDENTITY_FIELDS) -> DataFrame:
    """(record_id, parent_id, child_id) of every object among the rows (columns OBJECTS) that has an identity.

    The parent is the nearest enclosing object with an identity, else the record. An object with several
    identity fields takes the first of ``identity``. Equal rows of several deliveries count once.
    """
    order = F.create_map(*[x for i, f in enumerate(identity) for x in (F.lit(squash(f)), F.lit(i))])
    named = F.transform(F.map_entries("cells"), lambda e: F.struct(order[F.replace(e["key"], F.lit("_"), F.lit(""))].alias("rank"), F.try_element_at(F.filter(e["value"], lambda v: v.isNotNull()), F.lit(1)).alias("value")))
    own = F.array_min(F.filter(named, lambda x: x["rank"].isNotNull() & x["value"].isNotNull()))["value"]
    found = rows.where("node >= 0").select("record_id", "delivery", "node", "ancestors", own.alias("id")).where("id is not null")
    # collect_set is combined map-side; a group is one JSON text, however often it was delivered
    groups = found.groupBy("record_id", "delivery").agg(F.collect_set(F.struct("node", "id", "ancestors")).alias("found"))
    ids = groups.select("record_id", "found", F.map_from_arrays(F.transform("found", lambda x: x["node"]), F.transform("found", lambda x: x["id"])).alias("ids"))
    flat = ids.select("record_id", "ids", F.explode("found").alias("x"))
    nearest = F.try_element_at(F.filter(F.transform("x.ancestors", lambda a: F.try_element_at("ids", a)), lambda v: v.isNotNull()), F.lit(-1))
    return flat.select("record_id", F.coalesce(nearest, F.col("record_id")).alias("parent_id"), F.col("x.id").alias("child_id")).distinct()


def identified_objects(df: DataFrame, record_id: str, json_col: str, identity: tuple[str, ...] = IDENTITY_FIELDS) -> DataFrame:
    """``identified`` of all objects of df's records."""
    return identified(objects(df, record_id, json_col), identity)
