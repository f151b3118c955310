"""Flat tables out of nested records, against a walk in Python."""

import json

from textloom.operators import nested as N

RAW = [
    {"a": [{"b": [{"c": 1}, None, {"c": [{"d": 2}]}]}, {"b": None}], "x": {"y": [{"z": 1}]}},
    {"a": {"b": [{"c": 3}]}},  # an object where others have an array
    {"a": [1, "s", [{"deep": True}], {}]},
    {},
    [],
    {"quo'te d": [{"k": 1}], "dot.ted": [{"k": 2}]},
]


def walk(rid, x, path, parent, out):
    if isinstance(x, dict):
        for k, v in x.items():
            walk(rid, v, f"{path}.{k}" if path else k, parent, out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            p = f"{path}[{i}]"
            if isinstance(v, dict):
                out.add((rid, p, parent))
                walk(rid, v, p, p, out)
            else:
                walk(rid, v, p, parent, out)


def test_nodes_match_walk(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(RAW)]
    rows += [(10, json.dumps(json.dumps(RAW[0]))), (11, json.dumps(json.dumps(json.dumps(RAW[1])))), (12, rows[0][1][:-5]), (13, None), (14, ""), (15, '"plain"')]
    df = N.with_variant(spark.createDataFrame(rows, "id long, raw string"), "raw", "v")
    got = {tuple(r) for r in N.nodes(df, "id", "v").select("id", "path", "parent_path").collect()}
    want: set = set()
    for i, x in enumerate(RAW):
        walk(i, x, "", "$", want)
    walk(10, RAW[0], "", "$", want)
    walk(11, RAW[1], "", "$", want)
    assert got == want


def test_flat_tables_keep_clashing_names(spark):
    df = spark.createDataFrame([(1, json.dumps({"h": [{"path": "p", "ordinal": 5, "n": {"m": "v"}}], "id": 3}))], "id long, raw string")
    tables = N.flat_tables(df, "id", "raw")
    row = tables["h"].first()
    assert (row["path"], row["path_"], row["ordinal_"], row["n_m"], row["parent_path"]) == ("h[0]", "p", "5", "v", "$")
    assert tables["$"].first()["id_"] == "3"


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, raw string")
    parsed = N.with_variant(df, "raw", "v")
    assert N.nodes(parsed, "id", "v").count() == 0
    assert list(N.flat_tables(df, "id", "raw")) == ["$"]


def test_array_nodes_skip_null_elements(spark):
    df = spark.createDataFrame([(1, [("a",), None, ("b",)]), (2, None), (3, [])], "row_id long, messages array<struct<id:string>>")
    assert [tuple(r) for r in N.array_nodes(df, "row_id", "messages").select("row_id", "path", "ordinal").collect()] == [(1, "messages[0]", 0), (1, "messages[2]", 2)]


def test_flat_tables_drop_no_value(spark):
    raw = [
        {"id": "m", "labelIds": ["a", None, "b"], "payload": {"mimeType": "t", "body": {"size": 3}, "parts": [{"scan": {"engine": {"name": "e", "version": 2}}, "tags": [[1], [2, 3]]}]}},
        {"id": "n", "payload": {"parts": {"mimeType": "one", "tags": [4]}, "body": "cut"}, "mix": [{"k": 1}, 5, "s"]},
        [{"root": 1}, 6],
    ]
    tables = N.flat_tables(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(raw)], "rid long, raw string"), "rid", "raw")
    top = {r["rid"]: r.asDict() for r in tables["$"].collect()}
    assert (top[0]["payload_mimeType"], top[0]["payload_body_size"], top[0]["payload_body"]) == ("t", "3", None)
    assert (top[1]["payload_parts_mimeType"], top[1]["payload_body"]) == ("one", "cut")
    part = tables["parts"].first()
    assert (part["path"], part["scan_engine_name"], part["scan_engine_version"]) == ("payload.parts[0]", "e", "2")
    of = lambda name: sorted(tuple(r) for r in tables[name].select("rid", "path", "parent_path", "ordinal", "value").collect())
    assert of("labelIds") == [(0, "labelIds[0]", "$", 0, "a"), (0, "labelIds[2]", "$", 2, "b")]
    assert of("tags") == [(0, f"payload.parts[0].tags[{i}][{j}]", "payload.parts[0]", j, v) for i, j, v in ((0, 0, "1"), (1, 0, "2"), (1, 1, "3"))] + [(1, "payload.parts.tags[0]", "$", 0, "4")]
    assert of("mix_values") == [(1, "mix[1]", "$", 1, "5"), (1, "mix[2]", "$", 2, "s")]
    assert tables["$[]"].first()["root"] == "1" and of("$_values") == [(2, "[1]", "$", 1, "6")]
