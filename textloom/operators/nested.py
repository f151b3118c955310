"""Flat tables out of deeply nested records.

A schema merged over *all* records is inferred first, distributed, on the JVM. Then each level of arrays is
exploded into rows of child objects, which carry their parent's surrogate key and their place in the
array, and the rows so won are exploded again for the next level, down to the deepest array of the schema. All levels
are steps of one narrow stage: no level needs another scan, and no join is made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row while levels are exploded. form: 0 an object, 1 an array, 2 a scalar.
ROW = "place:int,form:int,kind:string,path:string,parent_path:string,ordinal:int,node_key:bigint,parent_key:bigint,value:variant"


@dataclass
class Node:
    """What a place in the records holds, merged over all records; a place may hold several kinds."""

    fields: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None
    scalar: str | None = None
    mixed: bool = False  # values of unlike types meet here

    def has_array(self) -> bool:
        return self.element is not None or any(c.has_array() for c in self.fields.values())


def parse_schema(text: str) -> Node:
    """The schema text of ``schema_of_variant_agg`` as a tree; field names may be back-quoted."""
    pos = 0

    def word() -> str:
        nonlocal pos
        m = re.compile(r"[^<>,:()]+(\([^)]*\))?").match(text, pos)
        pos = m.end()
        return m.group().strip()

    def name() -> str:
        nonlocal pos
        while text[pos] == " ":
            pos += 1
        if text[pos] != "`":
            m = re.compile(r"[^:]*").match(text, pos)
            pos = m.end()
            return m.group()
        m = re.compile(r"`((?:[^`]|``)*)`").match(text, pos)
        pos = m.end()
        return m.group(1).replace("``", "`")

    def node() -> Node:
        nonlocal pos
        while text[pos] == " ":
            pos += 1
        if text.startswith("OBJECT<", pos):
            pos += 7
            out = Node()
            while text[pos] != ">":
                key = name()
                pos += 1  # the colon
                out.fields[key] = node()
                if text[pos] == ",":
                    pos += 1
            pos += 1
            return out
        if text.startswith("ARRAY<", pos):
            pos += 6
            out = Node(element=node())
            pos += 1
            return out
        kind = word()
        return Node(scalar=kind, mixed=kind == "VARIANT")

    return node()


def with_variant(df: DataFrame, json_col: str, out: str) -> DataFrame:
    """Adds the parsed record; text that is no JSON, or cut off, gives null. A record that was encoded as a JSON string, however
    often, is unwrapped: each encoding doubles the marks before the innermost quotes, so a text of
    n letters has log2(n) + 2 levels at most, and so many steps are made where it starts with a quote."""
    quoted = lambda t: t.rlike(r'^[ \t\r\n]*"')
    step = lambda t, _: F.when(quoted(t), F.try_variant_get(F.try_parse_json(t), "$", "string")).otherwise(t)
    raw = F.col(json_col)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.length(raw) + 1)).cast("int") + 2)
    return df.withColumn(out, F.try_parse_json(F.when(quoted(raw), F.aggregate(steps, raw, step)).otherwise(raw)))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field(value: str, key: str, kind: str = "variant") -> str:
    """SQL for a field of an object. A path can't hold every name, a map of the object's fields can."""
    if "?" not in key and "\\" not in key:
        for quote in ("'", '"'):
            if quote not in key:
                return f"try_variant_get({value}, {_literal(f'$[{quote}{key}{quote}]')}, '{kind}')"
    got = f"try_element_at(try_variant_get({value}, '$', 'map<string,variant>'), {_literal(key)})"
    return got if kind == "variant" else f"try_variant_get({got}, '$', '{kind}')"


def infer(df: DataFrame, variant: str) -> Node:
    """The schema merged over every record. Where unlike types meet, the objects and the arrays met
    there are inferred by themselves, so that no nested object is lost."""
    text = df.agg(F.schema_of_variant_agg(variant).alias("s")).first()["s"]
    root = parse_schema(text) if text else Node()

    def settle(values: DataFrame, node: Node) -> None:
        if node.mixed:
            node.mixed = False
            kinds = values.where(F.col("v").isNotNull()).withColumn("of", F.schema_of_variant("v"))
            only = lambda prefix: F.schema_of_variant_agg(F.when(F.col("of").startswith(prefix), F.col("v")))
            met = kinds.agg(only("OBJECT").alias("OBJECT"), only("ARRAY").alias("ARRAY")).first()
            for prefix in ("OBJECT", "ARRAY"):
                if met[prefix] and met[prefix].startswith(prefix):
                    part = parse_schema(met[prefix])
                    settle(kinds.where(F.col("of").startswith(prefix)).select("v"), part)
                    node.fields, node.element = node.fields or part.fields, node.element or part.element
            return
        for key, child in node.fields.items():
            if _any_mixed(child):
                settle(values.select(F.expr(_field("v", key)).alias("v")), child)
        if node.element is not None and _any_mixed(node.element):
            settle(values.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")), node.element)

    if _any_mixed(root):
        settle(df.select(F.col(variant).alias("v")), root)
    return root


def _any_mixed(node: Node) -> bool:
    return node.mixed or any(map(_any_mixed, node.fields.values())) or (node.element is not None and _any_mixed(node.element))


def _nested(value: str) -> str:
    return f"(startswith(schema_of_variant({value}), 'OBJECT') or startswith(schema_of_variant({value}), 'ARRAY'))"


@dataclass
class _Place:
    """An array's element in the schema, with what the rows there need to be exploded further."""

    number: int
    level: int
    kind: str
    node: Node


class _Levels:
    """Writes, level by level, the expression that turns a row into the rows of the arrays directly below it."""

    def __init__(self, tree: Node, key: str, scalars: bool) -> None:
        self.key, self.scalars = f"`{key}`", scalars
        self.places = [_Place(0, 0, "$", tree)]
        self.children: dict[int, list[str]] = {}
        at = 0
        while at < len(self.places):
            self.children[at] = self._below(self.places[at])
            at += 1
        self.depth = max(p.level for p in self.places)

    def _below(self, place: _Place) -> list[str]:
        root = place.number == 0
        if root:
            parent, parent_key = "'$'", f"xxhash64({self.key}, '$')"
        elif place.node.element is None:
            parent, parent_key = "path", "node_key"
        else:  # an array in an array is no object: what is in it belongs to the object around both
            parent, parent_key = "if(form = 1, parent_path, path)", "if(form = 1, parent_key, node_key)"
        out = []

        def arrays(node: Node, value: str, path: str, kind: str) -> None:
            for name, child in node.fields.items():
                if child.has_array():
                    arrays(child, _field(value, name), f"{path}.{name}" if path else name, name)
            if node.element is not None:
                new = _Place(len(self.places), place.level + 1, kind, node.element)
                self.places.append(new)
                out.append(self._elements(new, value, path, parent, parent_key, root))

        arrays(place.node, "value", "", place.kind)
        return out

    def _elements(self, place: _Place, array: str, path: str, parent: str, parent_key: str, root: bool) -> str:
        node = place.node
        before = f"{_literal(path)}, " if root else f"path, {_literal('.' + path)}, " if path else "path, "
        could_be_object = bool(node.fields) or (node.scalar is None and node.element is None)
        if could_be_object and node.element is None and node.scalar is None:
            form = "if(is_variant_null(x), 3, 0)"
        else:
            form = "case when x is null or is_variant_null(x) then 3 when startswith(schema_of_variant(x), 'OBJECT') then 0 when startswith(schema_of_variant(x), 'ARRAY') then 1 else 2 end"
        row = (
            f"transform(coalesce(try_variant_get({array}, '$', 'array<variant>'), array()), (x, i) -> struct({place.number} as place, {form} as form, {_literal(place.kind)} as kind, "
            f"concat({before}'[', i, ']') as path, {parent} as parent_path, i as ordinal, 0L as node_key, {parent_key} as parent_key, x as value))"
        )
        wanted = [f for f, wants in ((0, could_be_object), (1, node.element is not None), (2, self.scalars)) if wants]
        return f"filter({row}, r -> r.value is not null and r.form in ({', '.join(map(str, wanted or [-1]))}))"

    def explode(self, rows: DataFrame) -> DataFrame:
        names = [f.split(":")[0] for f in ROW.split(",")]
        own = f"array(struct({', '.join(names)}))"
        for level in range(self.depth):
            at = {p.number: self.children[p.number] for p in self.places if p.level == level and self.children[p.number]}
            whole = lambda parts: parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
            if level == 0:
                listed = whole(at[0])
            else:
                listed = f"concat({own}, case place {' '.join(f'when {n} then {whole(parts)}' for n, parts in at.items())} else cast(array() as array<struct<{ROW}>>) end)"
            rows = rows.select(self.key, F.expr(f"inline({listed})"))
            rows = rows.withColumn("node_key", F.expr(f"if(place in ({', '.join(str(p.number) for p in self.places if p.level == level + 1)}), xxhash64({self.key}, path), node_key)"))
        return rows


def nodes(df: DataFrame, key: str, variant: str, tree: Node | None = None, scalars: bool = False) -> DataFrame:
    """(key, kind, path, parent_path, ordinal, node_key, parent_key, value) of each object that is an element of an array.

    ``kind`` is the name of the array that holds the object, ``path`` is unique within the record,
    ``parent_path`` is that of the nearest enclosing object in an array, else ``$``; ``node_key`` and ``parent_key`` are
    their surrogate keys, hashes of record key and path. Null elements
    keep their position and give no row; empty, null and missing arrays give none; records that are
    null or cannot be parsed give none. With ``scalars``, of each scalar that is an element of an array instead.
    """
    tree = tree or infer(df, variant)
    levels = _Levels(tree, key, scalars)
    if not levels.depth:
        tree = Node(element=Node(fields={"none": Node(scalar="STRING")}))  # no array anywhere: an array of the records themselves gives no row either
        levels = _Levels(tree, key, scalars)
    rows = levels.explode(df.where(F.col(variant).isNotNull()).select(F.col(key), F.col(variant).alias("value")))
    return rows.where(F.col("form") == (2 if scalars else 0)).select(key, "kind", "path", "parent_path", "ordinal", "node_key", "parent_key", "value")


def _leaves(node: Node) -> dict[tuple[str, ...], bool]:
    """Paths of the scalar fields below an object, through objects to any depth; whether objects or arrays may stand there as well."""
    out: dict[tuple[str, ...], bool] = {}
    for key, child in node.fields.items():
        nested = bool(child.fields) or child.element is not None
        if child.scalar is not None or not nested:
            out[key,] = nested
        out |= {(key, *sub): also for sub, also in _leaves(child).items()}
    return out


def _kinds(tree: Node) -> tuple[dict[str, dict[tuple[str, ...], bool]], dict[str, None]]:
    """Paths of the scalar fields by kind, merged over every place where an array of that name occurs, and the kinds of the arrays that hold scalars."""
    objects: dict[str, dict[tuple[str, ...], bool]] = {}
    scalars: dict[str, None] = {}

    def walk(node: Node, kind: str) -> None:
        for key, child in node.fields.items():
            walk(child, key)
        hop = node
        while hop.element is not None:
            hop = hop.element
            if hop.fields:
                own = objects.setdefault(kind, {})
                for path, also in _leaves(hop).items():
                    own[path] = own.get(path, False) or also
                walk(Node(fields=hop.fields), kind)
            if hop.scalar is not None:
                scalars[kind] = None

    walk(tree, "$")
    return objects, scalars


def flat_tables(df: DataFrame, key: str, json_col: str) -> dict[str, DataFrame]:
    """One flat table per kind of object, and ``$`` for the records themselves.

    Each has the record's key, ``path, parent_path, ordinal, node_key, parent_key`` and the kind's scalar fields as strings; fields of
    sub-objects, at any depth, are named ``object.field`` with the dots written as ``_``. A field that
    clashes with one of the key columns gets a trailing underscore. An array of scalars gives a
    table of its name with ``value``, or its name and ``_values`` where objects stand in arrays of that
    name too. Objects in a record that is an array itself are in ``$[]``.
    """
    parsed = with_variant(df.select(key, json_col), json_col, "__v")
    tree = infer(parsed, "__v")
    rows = nodes(parsed, key, "__v", tree)
    taken = {key.lower(), "path", "parent_path", "ordinal", "node_key", "parent_key"}

    def columns(fields: dict[tuple[str, ...], bool], value: str) -> list[Column]:
        seen = set(taken)
        out = []
        for f, also_nested in fields.items():
            name = "_".join(f) or "value"
            while name.lower() in seen:
                name += "_"
            seen.add(name.lower())
            got = value
            for part in f[:-1]:
                got = _field(got, part)
            field = F.expr(_field(got, f[-1], "string") if f else f"try_variant_get({value}, '$', 'string')")
            if also_nested:
                field = F.when(~F.expr(_nested(_field(got, f[-1]))), field)
            out.append(field.alias(name))
        return out

    objects, scalars = _kinds(tree)
    base = (key, "path", "parent_path", "ordinal", "node_key", "parent_key")
    tables = {kind if kind != "$" else "$[]": rows.where(F.col("kind") == kind).select(*base, *columns(fields, "value")) for kind, fields in objects.items()}
    values = nodes(parsed, key, "__v", tree, scalars=True)
    for kind in scalars:
        name = kind
        while name in tables or name == "$":
            name += "_values"
        tables[name] = values.where(F.col("kind") == kind).select(*base, *columns({(): False}, "value"))
    tables["$"] = parsed.where(F.col("__v").isNotNull()).select(key, F.lit("$").alias("path"), F.xxhash64(key, F.lit("$")).alias("node_key"), *columns(_leaves(tree), "__v"))
    return tables


def array_nodes(df: DataFrame, key: str, array_col: str) -> DataFrame:
    """As :func:`nodes` for a typed column of structs: its non-null elements, without going deeper."""
    return df.select(F.col(key), F.posexplode(array_col)).where(F.col("col").isNotNull()).select(
        key,
        F.lit(array_col).alias("kind"),
        F.concat(F.lit(array_col + "["), F.col("pos").cast("string"), F.lit("]")).alias("path"),
        F.lit("$").alias("parent_path"),
        F.col("pos").alias("ordinal"),
        "col",
    )
