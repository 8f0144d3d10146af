import json

from hypothesis import given, settings
from hypothesis import strategies as st
from lexforge.operators import nested
from lexforge.operators.nested import _parse_deep

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=25)


@given(JSON)
@settings(max_examples=150, deadline=None)
def test_parser_without_recursion_agrees(value):
    for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
        assert _parse_deep(text) == json.loads(text)


def test_parser_without_recursion_rejects():
    for bad in ("", "{", "[1,]", '{"a" 1}', "1 2", "tru", '{"a":1,}', "[1 2]", '{1:2}', '"x', "NaN"):
        try:
            _parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_very_deep_records():
    text = '{"ref_id":"a","x":' * 30_000 + "1" + "}" * 30_000
    assert nested.parse(text)["x"]["ref_id"] == "a"


def objects(spark, rows):
    df = spark.createDataFrame(rows, "id string, data string, record_id string, node int")
    return {tuple(r) for r in nested.identified_objects(df, "id", "data").collect()}


def test_identified_objects(spark):
    inner = json.dumps({"TraceId": "t2", "upstream": [{"trace-id": "t3"}]})
    rows = [
        ("r1", json.dumps({"occurrence_id": "o1", "b": [{"x": 1, "c": {"differenceId": "d1"}}, {"difference_id": None, "ev": {"TRACE_ID": "t1"}}]}), None, 1),
        ("r2", json.dumps({"wrap": json.dumps([{"ref_id": 7, "deep": inner}])}), "x", None),
        ("r3", '{"ref_id": "z"', None, None),
        ("r3", "", None, None),
        ("r3", None, None, None),
        ("r4", "null", None, None),
        (None, '{"ref_id": "q"}', None, None),
        ("r5", json.dumps({"note": "{not json", "list": "[1, 2"}), None, None),
        ("r6", json.dumps({"late": {"ref_id": "child"}, "ref_id": "parent", "trace_id": "second"}), None, None),
    ]
    expected = {("r1", "r1", "o1"), ("r1", "o1", "d1"), ("r1", "o1", "t1"), ("r2", "r2", "7"), ("r2", "7", "t2"), ("r2", "t2", "t3"), ("r6", "r6", "second"), ("r6", "second", "child")}
    assert objects(spark, rows + rows) == expected


def test_deliveries_and_empty_tables(spark):
    rows = [("r", json.dumps({"ref_id": "a"}), None, None), ("r", json.dumps({"ref_id": "a", "more": [{"ref_id": "b"}]}), None, None)]
    assert objects(spark, rows) == {("r", "r", "a"), ("r", "a", "b")}
    assert objects(spark, []) == set()


def test_tables_keep_values_and_links(spark):
    data = {"id": "p", "node": "clash", "items": [{"name": "x", "tags": ["u", "v"]}, {"name": None, "sub": {"k": True}}]}
    df = spark.createDataFrame([("r", json.dumps(data)), ("s", json.dumps({"items": {"name": "single"}}))], "id string, data string")
    tables = nested.group_tables(nested.shred(df, "id", "data"))
    assert set(tables) == {"", "items", "items.sub"}
    assert tables[""].where("id is not null").first()["node_"] == "clash"
    items = {(r["record_id"], r["name"], r["tags"], r["parent_node"]) for r in tables["items"].collect()}
    assert items == {("r", "x", '["u","v"]', 0), ("r", None, None, 0), ("s", "single", None, 0)}
    assert [r["k"] for r in tables["items.sub"].collect()] == ["true"]


def test_objects_in_place_of_lists(spark):
    data = {"rows": {"count": 2, "Items": [{"ref_id": "a"}, {"ref_id": "b"}]}, "notes": {"item_0": {"ref_id": "c"}, "item1": {"ref_id": "d", "items": [{"x": 1}], "count": 1}}, "items": 5}
    df = spark.createDataFrame([("r", json.dumps(data))], "id string, data string")
    assert {tuple(r)[1:] for r in nested.identified_objects(df, "id", "data").collect()} == {("r", x) for x in "abcd"}
    tables = nested.group_tables(nested.shred(df, "id", "data"))
    assert set(tables) == {"", "rows", "notes", "notes.items"}
    assert sorted((r["ref_id"], list(r["ordinals"])) for r in tables["notes"].collect()) == [("c", [0]), ("d", [1])]


def flat(tables):
    out = set()
    for path, t in tables.items():
        for r in t.collect():
            d = r.asDict()
            out.add((path, d.pop("record_id"), d.pop("node"), d.pop("parent_path"), d.pop("parent_node"), tuple(d.pop("ordinals")), tuple(sorted((k, v) for k, v in d.items() if k != "delivery" and v is not None))))
    return out


def test_tables_of_staged_objects(spark):
    """Links resolve, objects without values are rows too, and every scalar stands in one cell."""
    deep = {"a": {"only": {"child": {"k": 1}}}, "rows": [{"v": [1, None, "x"], "sub": []}, {}, {"v": "y", "sub": {"w": False}}], "top": "t"}
    texts = [("r", json.dumps(deep)), ("s", json.dumps([{"top": "u"}, {"rows": json.dumps([{"v": 5}])}])), ("n", "[1, 2]"), ("bad", "{"), ("z", "{}")]
    df = spark.createDataFrame(texts, "id string, data string")
    tables = nested.group_tables(nested.stage_objects(nested.objects(df, "id", "data")))
    rows = flat(tables)
    keys = {(path, record, node) for path, record, node, *_ in rows}
    assert len(keys) == len(rows)
    assert all((parent_path, record, parent) in keys for _, record, _, parent_path, parent, _, _ in rows if parent is not None)
    assert set(tables) == {"", "a", "a.only", "a.only.child", "rows", "rows.sub"}
    cells = {(path, record, *c) for path, record, _, _, _, _, fields in rows for c in fields}
    assert ("rows", "r", "v", '["1",null,"x"]') in cells and ("rows", "s", "v", "5") in cells and ("rows.sub", "r", "w", "false") in cells and ("a.only.child", "r", "k", "1") in cells
    assert {r[1] for r in rows} == {"r", "s", "z"} and sum(r[0] == "rows" for r in rows) == 4
    # grouped by a shuffle, objects without values are missing, and ordinals are those of the first value
    bare = lambda rows: {(*r[:5], r[6]) for r in rows if r[6]}
    assert bare(flat(nested.group_tables(nested.shred(df.union(df), "id", "data")))) == bare(rows)
    assert nested.group_tables(nested.objects(df.limit(0), "id", "data")) == {}
