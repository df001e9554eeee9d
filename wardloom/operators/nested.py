"""Deeply nested JSON records to related flat tables, by shared inlining.

1.  :func:`schema_graph` walks every record and collects the distinct edges *element -> element*, each with
    whether the child repeats (stands in a list).  An element is named by its field.
2.  :func:`plan_tables` decides on the graph: an element gets a table of its own if it is the root, repeats
    under any parent, is shared by several parents, or lies on a cycle; every other element is a singleton
    below one parent and is inlined into the parent's row as dotted columns.
3.  :func:`shred` walks every record again and emits one row per instance of a table element, with its key
    (record key and node path), its parent's key, its position and the inlined values.
4.  :func:`flat_table` gives one element's rows as a flat table with a column per inlined value.

Scalar members of a list are instances of the list's element too: rows with a ``value`` and no object.  An
empty list, or an empty object that is inlined, is kept as the text ``[]`` or ``{}`` in its parent's row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "$"

#: Beyond so many distinct edges the graph is not collected; every element then gets its own table.
MAX_EDGES = 20_000

_INTS = pa.int32()
_SPACE = " \t\r\n"


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def _iterative_decode(text: str):
    """JSON of any depth, for texts nested deeper than the standard decoder's stack."""
    scan, pos, n = json.JSONDecoder(parse_constant=_refuse), 0, len(text)
    stack: list = []
    holder: list = []

    def skip(i: int) -> int:
        while i < n and text[i] in _SPACE:
            i += 1
        return i

    def put(value) -> None:
        if not stack:
            holder.append(value)
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        else:
            stack[-1][0][stack[-1][1]] = value

    expect_value, may_close = True, False
    while True:
        pos = skip(pos)
        if pos >= n:
            break
        c = text[pos]
        if expect_value and stack and isinstance(stack[-1][0], dict):
            if c == "}" and may_close:
                stack.pop()
                pos, expect_value, may_close = pos + 1, False, False
                continue
            if c != '"':
                raise ValueError("a field name was expected")
            name, pos = scan.raw_decode(text, pos)
            pos = skip(pos)
            if text[pos : pos + 1] != ":":
                raise ValueError("a colon was expected")
            stack[-1][1] = name
            pos = skip(pos + 1)
            c = text[pos : pos + 1]
        elif expect_value and stack and c == "]" and may_close:
            stack.pop()
            pos, expect_value, may_close = pos + 1, False, False
            continue
        if expect_value:
            if c in ("{", "["):
                value: dict | list = {} if c == "{" else []
                put(value)
                stack.append([value, None])
                pos, may_close = pos + 1, True
            else:
                value, pos = scan.raw_decode(text, pos)
                put(value)
                expect_value = False
            continue
        if not stack:
            raise ValueError("text goes on after the value")
        if c == ",":
            pos, expect_value, may_close = pos + 1, True, False
        elif c == ("]" if isinstance(stack[-1][0], list) else "}"):
            stack.pop()
            pos += 1
        else:
            raise ValueError("a comma was expected")
    if stack or not holder:
        raise ValueError("the text ends early")
    return holder[0]


def read_json(text: str):
    """The JSON value of ``text``; ValueError if it cannot be read to its end (NaN and Infinity included)."""
    try:
        return _decode(text)
    except RecursionError:
        return _iterative_decode(text)


def opened(value):
    """``value``, or the object or list that it is the text of (also of a text of a text)."""
    while isinstance(value, str):
        head = value.lstrip(_SPACE)[:1]
        if head not in ("{", "[", '"') or not head:
            return value
        try:
            inner = read_json(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        if isinstance(inner, str) and opened(inner) is inner:
            return value
        value = inner
    return value


@dataclass(frozen=True)
class Shape:
    """How to read records: ``list_fields`` hold a list even where a lone object stands."""

    list_fields: frozenset[str] = frozenset()


@dataclass
class Plan:
    """Result of the analysis.  ``tables`` of None means every element has its own table."""

    tables: frozenset[str] | None
    columns: dict[str, list[str]] = field(default_factory=dict)

    def has_table(self, element: str) -> bool:
        return self.tables is None or element in self.tables


def _edges(root, shape: Shape, out: set) -> None:
    """Adds (parent, child, repeated, object) for everything below a record's root."""
    todo = [(root, "", ROOT, False)]
    while todo:
        value, parent, name, repeated = todo.pop()
        if isinstance(value, list):
            for member in value:
                todo.append((opened(member), parent, name, True))
            if not value and parent and not repeated:
                out.add((parent, name, False, False))
            continue
        is_object = isinstance(value, dict)
        if is_object and not repeated and name in shape.list_fields:
            repeated = True
        out.add((parent, name, repeated, is_object))
        if is_object:
            if not value and parent and not repeated:
                out.add((parent, name, False, False))
            for k, v in value.items():
                todo.append((opened(v), name, k, False))


def schema_graph(records: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Distinct (parent, child, repeated, is_object) edges of all records' ``metadata``.

    ``records`` needs a string column ``metadata``; texts that are not JSON add nothing.  The edges are
    made distinct inside each partition first, so the shuffle carries the schema, not the data.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                try:
                    root = read_json(text)
                except ValueError:
                    continue
                root = opened(root)
                if isinstance(root, (dict, list)):
                    _edges(root, shape, seen)
        rows = sorted(seen)
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
        names = ["parent", "child", "repeated", "is_object"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    found = records.select("metadata").mapInArrow(walk, "parent string, child string, repeated boolean, is_object boolean")
    return found.distinct()


def _on_cycles(children: dict[str, set[str]]) -> set[str]:
    """Elements that reach themselves."""
    out = set()
    for start in children:
        seen, todo = set(), list(children[start])
        while todo:
            x = todo.pop()
            if x == start:
                out.add(start)
                break
            if x not in seen:
                seen.add(x)
                todo.extend(children.get(x, ()))
    return out


def plan_tables(edges: list[tuple[str, str, bool, bool]]) -> Plan:
    """The shared-inlining decision for a schema graph (see the module's text)."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    repeated: set[str] = set()
    objects = {ROOT}
    for parent, child, many, is_object in edges:
        if many:
            repeated.add(child)
        if is_object:
            objects.add(child)
            parents.setdefault(child, set()).add(parent)
            if parent:
                children.setdefault(parent, set()).add(child)
    shared = {e for e in objects if len(parents.get(e, ())) > 1}
    tables = frozenset({ROOT} | repeated | shared | _on_cycles(children))
    scalars: dict[str, set[str]] = {}
    for parent, child, many, is_object in edges:
        if not many and not is_object and parent:
            scalars.setdefault(parent, set()).add(child)
    plan = Plan(tables)
    for t in sorted(tables):
        found, todo, seen = set(), [(t, "")], {t}
        while todo:
            element, prefix = todo.pop()
            found |= {prefix + c for c in scalars.get(element, ())}
            for child in children.get(element, ()):
                if child not in tables and child not in seen:
                    seen.add(child)
                    todo.append((child, f"{prefix}{child}."))
        plan.columns[t] = sorted(found)
    return plan


def analyse(records: DataFrame, shape: Shape = Shape(), max_edges: int = MAX_EDGES) -> Plan:
    """:func:`plan_tables` of the records' own schema graph.

    The graph is bounded by the number of field names, not by the records; one with more than
    ``max_edges`` edges (names made from data) is not brought to the driver, and nothing is inlined.
    """
    edges = [tuple(r) for r in schema_graph(records, shape).limit(max_edges + 1).collect()]
    return plan_tables(edges) if len(edges) <= max_edges else Plan(None)


#: Columns of :func:`shred` besides origin and record_key.
NODE_COLUMNS = (
    ("element", pa.string(), "string"),
    ("node_path", pa.string(), "string"),
    ("parent_element", pa.string(), "string"),
    ("parent_path", pa.string(), "string"),
    ("position", pa.int32(), "int"),
    ("in_list", pa.bool_(), "boolean"),
    ("is_object", pa.bool_(), "boolean"),
    ("columns", pa.string(), "string"),
)


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if value is True:
        return "true"
    if value is False:
        return "false"
    return json.dumps(value)


def _inline(value: dict, plan: Plan, shape: Shape, path: str, prefix: str, into: dict, below: list) -> None:
    """Collects the inlined values of one table row, and the table instances directly below it."""
    for name, raw in value.items():
        child = opened(raw)
        where = f"{path}.{name}" if path else name
        if isinstance(child, list):
            if child:
                below.append((child, name, where, True, None))
            else:
                into[prefix + name] = "[]"
        elif isinstance(child, dict):
            if name in shape.list_fields:
                below.append((child, name, f"{where}[0]", True, 0))
            elif plan.has_table(name):
                below.append((child, name, where, False, None))
            elif child:
                _inline(child, plan, shape, where, f"{prefix}{name}.", into, below)
            else:
                into[prefix + name] = "{}"
        else:
            into[prefix + name] = child


def nodes(root, plan: Plan, shape: Shape) -> Iterator[tuple]:
    """The rows of one record, parents before children; see :data:`NODE_COLUMNS`."""
    root = opened(root)
    if not isinstance(root, (dict, list)):
        return
    todo: list = [(root, ROOT, "", isinstance(root, list), None, None, None)]
    while todo:
        value, element, path, in_list, position, parent, parent_path = todo.pop()
        if isinstance(value, list):
            for i in range(len(value) - 1, -1, -1):
                todo.append((opened(value[i]), element, f"{path}[{i}]", True, i, parent, parent_path))
            continue
        if not isinstance(value, dict):
            yield element, path, parent, parent_path, position, in_list, False, {"value": value}
            continue
        values: dict = {}
        below: list = []
        _inline(value, plan, shape, path, "", values, below)
        yield element, path, parent, parent_path, position, in_list, True, values
        for child, name, where, listed, at in reversed(below):
            todo.append((child, name, where, listed, at, element, path))


def shred(records: DataFrame, plan: Plan, shape: Shape = Shape(), values: bool = True) -> DataFrame:
    """One row per instance of a table element of every record.

    ``records`` has origin, record_key and metadata (text).  The result has origin, record_key and
    :data:`NODE_COLUMNS`: ``element`` names the table, (origin, record_key, node_path) is the row's key,
    (origin, record_key, parent_path) its parent's, ``columns`` the inlined values as a JSON object of
    texts (left null with ``values=False``).  Null, empty, blank and unreadable metadata, and metadata
    that is a single scalar, give no row.  Of a name that an object has twice the last value counts.
    """
    names = ["origin", "record_key", *(n for n, _, _ in NODE_COLUMNS)]
    types = [pa.string(), pa.string(), *(t for _, t, _ in NODE_COLUMNS)]
    chunk = 8_000_000  # characters of paths and values in a batch, about

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        for batch in batches:
            for origin, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                try:
                    root = read_json(text)
                except ValueError:
                    continue
                for *node, kept in nodes(root, plan, shape):
                    packed = json.dumps({k: _text(v) for k, v in kept.items()}, ensure_ascii=False) if values else None
                    rows.append((origin, key, *node, packed))
                    weight += 200 + 2 * len(node[1]) + len(packed or "")
                    if weight >= chunk:
                        yield pack(rows)
                        rows, weight = [], 0
        yield pack(rows)

    schema = "origin string, record_key string, " + ", ".join(f"{n} {t}" for n, _, t in NODE_COLUMNS)
    return records.select("origin", "record_key", "metadata").mapInArrow(walk, schema)


def flat_table(shredded: DataFrame, plan: Plan, element: str) -> DataFrame:
    """The flat table of ``element``: keys, parent keys, position, and a text column per inlined value.

    An inlined value whose name equals a key column gets the prefix ``v_``.  Where the plan is of no schema
    graph (too many names for columns), ``values`` is the map of all of the element's values instead.
    """
    keys = ["origin", "record_key", "node_path", "parent_element", "parent_path", "position"]
    wanted = [*plan.columns.get(element, []), "value"]
    rows = shredded.where(F.col("element") == element)
    kind = "map<string,string>"
    rows = rows.withColumn("_values", F.from_json("columns", kind))
    picked = [F.element_at("_values", F.lit(c)).alias(f"v_{c}" if c in keys else c) for c in dict.fromkeys(wanted)]
    return rows.select(*keys, *picked, *([F.col("_values").alias("values")] if plan.tables is None else []))


def table_columns(shredded: DataFrame) -> DataFrame:
    """(element, name, filled): every inlined column of every flat table, with the number of rows that have a value."""
    values = shredded.select("element", F.explode(F.from_json("columns", "map<string,string>")).alias("name", "v"))
    return values.groupBy("element", "name").agg(F.count("v").alias("filled"))


def check_keys(shredded: DataFrame) -> DataFrame:
    """(element, n_rows, repeated_keys, orphans) of every flat table.

    ``repeated_keys`` are rows whose key (origin, record key, node path) another row has too, ``orphans`` rows
    whose parent's key no row has.  Both are 0 if keys and foreign keys hold.
    """
    key = ["origin", "record_key", "node_path"]
    rows = shredded.select(*key, "element", "parent_path")
    # a key's rows and the rows that point to it meet in one aggregate, which combines on the map side
    own = rows.select(*key, "element", F.lit(1).alias("own"), F.lit(0).alias("points"), F.lit(None).cast("string").alias("child"))
    up = rows.where("parent_path is not null").select("origin", "record_key", F.col("parent_path").alias("node_path"), F.lit(None).cast("string").alias("element"), F.lit(0).alias("own"), F.lit(1).alias("points"), F.col("element").alias("child"))
    met = own.unionByName(up).groupBy(*key, "child", "element").agg(F.sum("own").alias("own"), F.sum("points").alias("points"))
    per_key = met.groupBy(*key).agg(F.sum("own").alias("own"), F.max("element").alias("element"), F.map_from_entries(F.collect_list(F.when(F.col("points") > 0, F.struct("child", "points")))).alias("children"))
    mine = per_key.where("own > 0").select("element", F.col("own").alias("n_rows"), F.when(F.col("own") > 1, F.col("own")).otherwise(0).alias("repeated_keys"), F.lit(0).cast("long").alias("orphans"))
    lost = per_key.where("own = 0").select(F.explode("children").alias("element", "orphans")).select("element", F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("repeated_keys"), "orphans")
    return mine.unionByName(lost).groupBy("element").agg(*[F.sum(c).alias(c) for c in ("n_rows", "repeated_keys", "orphans")])
