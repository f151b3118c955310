"""Packing in blocks, stored tokens, tools, benchmark contexts, sources and streams of the second round."""

import json
import random

import pytest
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import buckets as B
from textloom.operators import conversations as C
from textloom.operators import evaluation as E
from textloom.operators import explore as X
from textloom.operators import logprobs as L
from textloom.operators import packing as P
from textloom.operators import retrieval as R
from textloom.operators import synthesis as S
from textloom.operators import tools
from textloom.sources import files, sinks
from textloom.streaming import streams


@pytest.mark.parametrize("mode", P.MODES)
@pytest.mark.parametrize("shards", [1, 3])
def test_pack_in_blocks_is_one_walk(spark, mode, shards):
    r = random.Random(4)
    lengths = [r.choice((0, 1, 1, 3, 7, 16, 17, 40)) for _ in range(900)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "ord long, n long").repartition(5)
    got = {(x["shard"], x["ord"]): (x["bin"], x["pos"]) for x in P.pack(df, "ord", "n", 16, mode, shards).collect()}
    for shard in range(shards):
        own = [(i, n) for i, n in enumerate(lengths) if i % shards == shard]
        seen: dict[int, int] = {}
        for (i, _), b in zip(own, P.greedy_bins([n for _, n in own], 16, mode)):
            assert got[shard, i] == (b, seen.get(b, 0))
            seen[b] = seen.get(b, 0) + 1
    assert P.pack(df.limit(0), "ord", "n", 16, mode, shards).count() == 0


def test_walk_all_matches_greedy():
    r = random.Random(8)
    for mode in P.MODES:
        for _ in range(60):
            lengths = [r.randint(0, 12) for _ in range(r.randint(0, 60))]
            fill, closed, items = P.walk_all(lengths, 9, mode)
            for f in range(10):
                bins = P.greedy_bins(lengths + [0], 9, mode, f)
                assert closed[f] == bins[-1], (mode, lengths, f)


def test_stored_element_cases(spark):
    rows = [
        (1, [("user", "a b", None, None), ("assistant", "x", [5, 151645], [(0, 5, -0.5)]), ("user", "c", [7], None), ("assistant", "y", [9], [(0, 9, -1.0), (0, 8, -2.0)])]),
        (2, [("assistant", "x", [5, 151645], None)]), (3, []), (4, [None, ("user", None, None, None)]),
    ]
    out = {r["conv_id"]: r for r in C.to_stored_element(spark.createDataFrame(rows, f"conv_id long, messages {C.STORED}"), "qwen").collect()}
    first = out[1]["input_ids"]
    assert first[5:7] == [151645, 198] and first[7:] == [151644, 77091, 198, 5, 151645, 198, 151644, 872, 198, 7, 151645, 198, 151644, 77091, 198, 9]
    assert [(t["token_idx"], t["token_id"]) for t in out[1]["targets"]] == [(10, 5), (22, 9), (22, 8)] and first[10] == 5 and first[22] == 9
    assert out[2]["input_ids"] == [151644, 77091, 198, 5, 151645] and out[3]["input_ids"] == [] and out[4]["input_ids"] == [151644, 872, 198]


def test_training_rows_keep_the_leading_mass(spark):
    dense = [[-0.1, -2.5, -5.0], [-0.7, -0.7, -9.0], [-3.0, -3.0, -3.0]]
    df = spark.createDataFrame([(1, "sys", [("user", "q", None, None, None), ("assistant", "a", [1, 2, 3], dense, [[1, 9, 8], [2, 7, 6], [3, 5, 4]])])], "id long, ctx string, messages array<struct<role:string,content:string,token_ids:array<int>,top_logprobs:array<array<double>>,top_ids:array<array<int>>>>")
    row = C.training_rows(df, "id", "ctx", 0.95).first()
    assert row["system_prompt"] == "sys" and row["messages"][0]["logprobs"] is None
    assert [(t["token_idx"], t["token_id"]) for t in row["messages"][1]["logprobs"]] == [(0, 1), (0, 9), (1, 2), (1, 7), (2, 3)]
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            L.leading_mass("a", "b", bad)


def test_ragged_rows_and_empty_places(spark):
    df = spark.createDataFrame([(1, [[-1.0], [], None, [-2.0, -3.0]]), (2, []), (3, None)], "id long, r array<array<double>>")
    got = {r["id"]: (r["p"], r["i"]) for r in df.select("id", L.pad_ragged("r").alias("p")).withColumn("i", L.padded_ids("p")).collect()}
    assert got[1][0] == [[-1.0, -1000.0], [-1000.0] * 2, [-1000.0] * 2, [-2.0, -3.0]] and got[1][1][3] == [-1, -1] and got[2] == ([], []) and got[3][0] is None
    sparse = spark.createDataFrame([(1, 0, 5, -0.1)], "id long, token_idx int, token_id int, logprob double")
    places = spark.createDataFrame([(1, 0), (1, 1)], "id long, token_idx int")
    assert {r["token_idx"]: len(r["alternatives"]) for r in L.alternatives(sparse, ["id"], places).collect()} == {0: 1, 1: 0}


def test_tools_run_in_groups(spark):
    seen = []

    def half(calls):
        seen.append(len(calls))
        return [12 / c["n"] for c in calls]

    rows = [(1, "half", '{"n": 3}'), (2, "half", '{"n": 0}'), (3, "none", "{}"), (4, "half", "[1]"), (5, "half", "{"), (6, "half", None), (7, None, "{}")]
    out = {r["id"]: r for r in tools.run_tools(spark.createDataFrame(rows, "id long, name string, arguments string"), {"half": half}).collect()}
    assert (out[1]["response"], out[1]["success"], out[1]["error"]) == ("4.0", True, None)
    assert not any(out[i]["success"] for i in range(2, 8)) and "ZeroDivisionError" in out[2]["error"] and "unknown tool" in out[3]["error"] and "KeyError" in out[6]["error"]


def test_ask_tries_again_and_counts(spark):
    tried = []

    def flaky(systems, prompts):
        tried.append(1)
        if len(tried) < 3:
            raise TimeoutError("busy")
        return ["one two" for _ in prompts]

    df = spark.createDataFrame([("s t", "a b c")], "s string, p string").coalesce(1)
    row = S.ask(df, "s", "p", "out", flaky, tries=3, wait=0.01).first()
    assert row["out"] == "one two" and row["out_error"] is None and tuple(row["out_usage"]) == (5, 2, 3)
    failed = S.ask(df, "s", "p", "out", lambda s, p: 1 / 0, tries=2, wait=0.01).first()
    assert failed["out"] is None and "ZeroDivisionError" in failed["out_error"] and failed["out_usage"]["tries"] == 2


def test_note_prompts_and_excerpts(spark):
    pats = spark.createDataFrame([(f"p{i}", {f"n{j}": f"note {i} {j} " * 5 for j in range(4)}) for i in range(3)], "pid string, notes map<string,string>")
    rows = S.note_prompts(pats, "pid", "notes", spark.range(40), "id", "x", 2, 3, 20).collect()
    assert len(rows) == 40 and {r["n_notes"] for r in rows} == {2, 3} and len({r["pid"] for r in rows}) == 3 and all(r["context"].count("... ") >= r["n_notes"] for r in rows)
    assert S.note_prompts(pats.limit(0), "pid", "notes", spark.range(3), "id", "x", 1, 1, 5).count() == 0
    got = spark.range(20).select(S.excerpt(F.lit("a b c d e f g h"), "x", "id", 2, 4, "A book.").alias("t")).collect()
    assert all(r["t"].startswith("A book.\n\n") and 2 <= len(r["t"].split()[2:]) <= 4 for r in got)
    assert S and spark.range(1).select(S.excerpt(F.lit("a b"), "x", "id", 5, 9, "B").alias("t")).first()["t"] == "B\n\na b"


def test_translation_context(spark):
    words = F.create_map(F.lit("am"), F.array(F.lit("one"), F.lit("two")), F.lit("bo"), F.array(F.lit("go")))
    pairs = F.array(F.struct(F.lit("x").alias("original"), F.lit("y").alias("translation")))
    text = spark.range(1).select(S.translation_context(F.lit("BOOK"), "A grammar", True, S.word_lines(words), pairs).alias("t")).first()["t"]
    assert text.startswith('Here is the book, "A grammar":\nSTART OF GRAMMAR BOOK\nBOOK\nEND') and "am: one,two\nbo: go\nEND OF WORD LIST" in text and "\nx:y\n" in text
    assert "WORD LIST" not in spark.range(1).select(S.translation_context(F.lit("B"), "t", False).alias("t")).first()["t"]


def test_haystack_sizes(spark):
    units = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d"), (1, 2, "e f"), (2, 0, "")], "doc long, pos int, t string")
    assert [tuple(r) for r in S.haystack_size(units, "doc", "pos", "t", 20, 4).collect()] == [(1, 8, 2, 16)]
    used = S.shrink_to_fit(spark.createDataFrame([(40, 100), (40, 130), (40, 500), (3, 101)], "n long, t long"), "n", "t", 100, F.lit(2), 5).collect()
    assert [r["used"] for r in used] == [40, 25, None, None]


def test_assignments_name_literals_and_variables(spark):
    row = spark.range(1).select(*[T.assignment(F.lit("A"), F.lit("B"), s, F.lit(x)).alias(f"{s}{x}") for s in T.ASSIGNMENTS for x in (True, False)]).first()
    assert (row["rulerTrue"], row["rulerFalse"]) == ("VAR A = 'B'", "VAR A = VAR B") and row["pythonTrue"].endswith("`A = 'B'`") and row["wordsFalse"].endswith("'A' is equivalent to 'B'.")


def test_buckets_and_configs():
    class Odd:
        def __str__(self):
            return "odd"

    assert X.plain_config({"a": {"b": Odd(), "c": [1, {"d": Odd()}]}, "n": None, "t": True}) == {"a": {"b": "odd", "c": ["1", {"d": "odd"}]}, "n": None, "t": True}
    assert X.plain_config(None) is None
    with pytest.raises(KeyError):
        X.slices(None, ["none of that name"])


def test_more_recent(spark):
    rows = spark.createDataFrame([("2025-06-01_to_2025-06-30", "2025-05-01_to_2025-05-31"), ("all_time", "2025-05-01_to_2025-05-31"), (None, "all_time"), ("2025-05-01_to_x", "2025-05-01_to_y")], "a string, b string")
    assert [r[0] for r in rows.select(B.more_recent(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_cached_results_and_slices(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert X.cached(spark, str(tmp_path), "k", make).count() == 3 and X.cached(spark, str(tmp_path), "k", make).count() == 3 and len(made) == 1
    X.slice_of("large")(lambda df: df.where("id > 1"))
    assert X.slices(spark.range(4), ["large"])["large"].count() == 2


def test_sources_by_kind(spark, tmp_path):
    df = lambda *ids: spark.createDataFrame([(i, [("user", "a")]) for i in ids], "conv_id long, messages array<struct<role:string,content:string>>").coalesce(1)
    df(1, 2, 3).write.parquet(str(tmp_path / "one.parquet"))
    df(4, 5).write.parquet(str(tmp_path / "hub" / "data" / "a.parquet"))
    df(6).write.parquet(str(tmp_path / "hub" / "b.parquet"))
    for v, i in (("v2", 7), ("v10", 8)):
        df(i).write.parquet(str(tmp_path / "store" / v / "rows.parquet"))
    rows = files.load_sources(spark, [{"path": str(tmp_path / "one.parquet"), "limit": 2}, {"path": str(tmp_path / "hub"), "type": "shards"}, str(tmp_path / "store") + ":latest", str(tmp_path / "store") + ":v2"])
    assert [r["conv_id"] for r in rows.orderBy("source_no", "ord").collect()] == [1, 2, 4, 5, 8, 7]
    with pytest.raises(ValueError):
        files.resolve_source(spark, {"path": "x", "type": "odd"})
    with pytest.raises(FileNotFoundError):
        files.artifact_version(str(tmp_path / "hub"))
    assert files.row_count(spark, str(tmp_path / "one.parquet")) == 3 and files.row_count(spark, str(tmp_path / "no.parquet")) is None
    assert files.inline_text(spark, "a", "b").count() == 2


def test_legacy_rows_and_samples(spark, tmp_path):
    for name, data, want in (("a", {"x": 1, "rows": [1, 2], "data": [3]}, ["1", "2"]), ("b", [{"k": 1}], ['{"k":1}']), ("c", {"n": 1, "odd": ["z"]}, ['"z"']), ("d", {"n": 1}, []), ("e", {"data": [1], "examples": [2]}, ["2"])):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        assert [r["row"] for r in files.read_legacy_rows(spark, str(tmp_path / f"{name}.json")).orderBy("pos").collect()] == want
    path = sinks.write_sample([{"context": "c", "queries": [{"query": "q", "answers": ["1", "2"]}]}], str(tmp_path), "niah", {"n": 1})
    assert [tuple(r) for r in files.read_benchmark_sample(spark, path, 0).collect()] == [("c", "q", ["1", "2"])]
    with pytest.raises(IndexError):
        files.read_benchmark_sample(spark, path, 1)


def test_records_encoded_often_and_deep(spark):
    from textloom.operators import nested as N

    text = json.dumps({"a": [{"b": 1}]})
    for _ in range(7):
        text = json.dumps(text)
    deep: dict = {"x": 1}
    for _ in range(13):
        deep = {"k": [deep, 5]}
    df = spark.createDataFrame([(1, text), (2, json.dumps(deep)), (3, "\n\t" + json.dumps(json.dumps({"a": [{}]})))], "id long, raw string")
    rows = N.nodes(N.with_variant(df, "raw", "v"), "id", "v").collect()
    assert [r["path"] for r in rows if r["id"] == 1] == ["a[0]"] and max(r["path"].count("[") for r in rows if r["id"] == 2) == 13 and [r["path"] for r in rows if r["id"] == 3] == ["a[0]"]
    keys = {(r["id"], r["path"]): r["node_key"] for r in rows}
    assert all(r["parent_key"] == keys[r["id"], r["parent_path"]] for r in rows if r["parent_path"] != "$") and len(set(keys.values())) == len(rows)


def test_retrieval_edges(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(50, None), (51, [0.0, 0.0])], "id long, v array<float>")
    q = v.where("id = 4").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = [tuple(r) for r in R.cosine_top_k(v, "id", "v", q, "q", "qv", 3).orderBy("rank").collect()]
    assert [(i, n) for _, i, s, n in got] == [(19, 1), (16, 2), (13, 3)] and R.cosine_top_k(v, "id", "v", q, "q", "qv", 0).count() == 0 and R.cosine_top_k(v.limit(0), "id", "v", q, "q", "qv", 2).count() == 0
    chunks = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None), (4, "")], "id long, t string")
    asked = spark.createDataFrame([(9, "hen fox fox")], "q long, t string")
    assert {r["id"] for r in R.bm25(chunks, "id", "t", asked, "q", "t").collect()} == {1, 2} and R.bm25(chunks.limit(0), "id", "t", asked, "q", "t").count() == 0


def test_chrf_edges(spark):
    pairs = spark.createDataFrame([("abc", "abc"), (None, "x"), ("", "")], "p string, r string")
    assert 0 < E.chrf(pairs, "p", "r").first()["chrf"] < 100 and E.chrf(pairs.limit(1), "p", "r").first()["chrf"] == 100


def test_streams_of_prefixes_and_metrics(spark, tmp_path):
    schema = "conv long, ord long, messages array<string>"
    spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b"]), (2, 0, ["a"]), (1, 2, ["a", "c", "d"]), (1, 3, ["a", "c"])], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.known_prefixes(stream, "conv", "ord", "messages").writeStream.format("memory").queryName("prefixes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("prefixes").collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 0, 0)]
    spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "step long, loss double").write.parquet(str(tmp_path / "m"))
    m = streams.metrics_by_step(spark.readStream.schema("step long, loss double").parquet(str(tmp_path / "m")), "step", ["loss"])
    q = m.writeStream.format("memory").queryName("steps").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("steps").collect()) == [(1, 2, 3.0), (2, 1, 1.0)]
