"""llm operators: brute force, round trips, held-out accuracy, and what nulls, empty, long and repeated texts give."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import crf, gate, leak, mail, mix, pack, pairs, pii, split, tokens, toxic

# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("size,overlap", [(30, 5), (30, 0), (40, 30), (2, 1), (1, 0), (10, 9)])
def test_split(spark, size, overlap):
    texts = ["", "abc", "x" * 100, "Hello there. " * 30, "a😀b é" * 40, "para one is here\n\npara two is there and long\n\nthree " * 5, None, " \n" * 50, "w" * 29 + " " + "v" * 31]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id int, text string, body string")
    rows = split.split_items(df, "text", size, overlap).orderBy("id", "piece_no").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["id"] == i]
        if t is None:
            assert not own
            continue
        assert "".join(p["piece"][p["overlap"] :] for p in own) == t
        assert all(len(p["piece"]) <= size for p in own) and (len(own) > 1) == (len(t) > size)
        before = ""
        for p in own:
            assert p["overlap"] == (min(overlap, len(before)) if p["piece_no"] else 0) and before.endswith(p["piece"][: p["overlap"]])
            before += p["piece"][p["overlap"] :]


def test_split_cuts_at_boundaries(spark):
    text = "One two three. Four five six. Seven eight nine.\n\nTen eleven twelve. Thirteen."
    rows = split.split_items(spark.createDataFrame([(text,)], "text string"), "text", 60, 0).collect()
    assert rows[0]["piece"].endswith("\n\n")
    kept = split.split_items(spark.createDataFrame([("abcdefgh", "mine")], "piece string, overlap string"), "piece", 5, 1)
    assert kept.columns == ["piece_", "overlap_", "piece_no", "overlap", "piece"] and kept.first()["overlap_"] == "mine"
    with pytest.raises(ValueError):
        split.pattern(10, 10)


# ---------------------------------------------------------------- crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    field = crf.Field("ABC", (0,), 1)
    field.trans[:], field.start[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(7, 3)).astype(np.float32)
    got = crf.infer(field, scores, np.array([4, 3]))
    for lo, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = field.start[path[0]] + sum(scores[lo + i, y] for i, y in enumerate(path)) + sum(field.trans[a, b] for a, b in zip(path, path[1:]))
            for i, y in enumerate(path):
                total[i, y] += np.exp(w)
        assert np.allclose(got[lo : lo + n], total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_skip_edges_pull_labels_together():
    field = crf.Field("AB", (0,), 1)
    field.skip = np.array([[3.0, 0.3], [0.3, 3.0]], np.float32)
    scores = np.array([[3, 0], [0, 0], [0, 0.5]], np.float32)
    alone, joined = crf.infer(field, scores, np.array([3])), crf.infer(field, scores, np.array([3]), np.array([[0], [2]]))
    assert alone[2].argmax() == 1 and joined[2].argmax() == 0


# ---------------------------------------------------------------- 3


def test_pii_held_out():
    finder, w = pii.Finder(*pii.model()), pii._Writer(77)
    docs = [w.document() for _ in range(300)] + [w.field() for _ in range(150)]
    texts = [pii.Text(x, i >= 300) for i, (x, _) in enumerate(docs)]
    for t in texts:
        t.look_up(pii.address_words(t))
    hit = extra = missed = 0
    for (x, marks), own in zip(docs, finder.find(texts)):
        got, want = {(k, v) for _, _, k, v in own}, {(k, pii.normal(x[a:b])) for a, b, k in marks}
        hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.93


def test_address_with_a_long_local_part():
    local = "a" * 140 + ".b"
    assert pii.tokenize(f"write to {local}@mail.example now") == ["write", "to", f"{local}@mail.example", "now"]


def test_names_are_joined_by_their_parts():
    t = pii.Text("Anna-Lena came. Lena's draft, Anna and Lena", False)
    assert {(t.tokens[a], t.tokens[b]) for a, b in pii.skip_edges([t]).T.tolist()} == {("Anna-Lena", "Lena's"), ("Anna-Lena", "Anna"), ("Lena's", "Lena")}


def test_messages_reach_the_end_of_a_long_chain():
    # 12 occurrences; only the first is known, the others are told by their edge to the one before.
    field = crf.Field("AB", (0,), 1)
    field.skip = np.array([[8.0, 0.1], [0.1, 8.0]], np.float32)
    scores = np.array([[6, 0]] + [[0, 0.2]] * 11, np.float32)
    got = crf.infer(field, scores, np.array([12]), np.array([range(11), range(1, 12)]), tolerance=0.001)
    assert got.argmax(axis=1).tolist() == [0] * 12


def test_pii_edges(spark):
    rows = [
        (1, "Call 020 7946 0011 now.\n\nBest,\nRosa Keld", '"Keld, Rosa" <rosa.keld@mail.dorn.example>', ["Billing <billing@dorn.example>", None, ""], "x"),
        (1, "Call 020 7946 0011 now.\n\nBest,\nRosa Keld", '"Keld, Rosa" <rosa.keld@mail.dorn.example>', None, "x"),
        (2, None, None, None, None), (3, "", " ", [], "y"), (4, "a" * 50_000 + "\n" + "word " * 20_000, None, [], "z"),
    ]
    df = spark.createDataFrame(rows, "row_id long, content string, from_address string, to_addresses array<string>, kind string")
    found = [tuple(r) for r in pii.mentions(df).collect()]
    assert found.count((1, "content", "phone", "02079460011")) == 2 and (1, "from_address", "name", "keldrosa") in found and (1, "to_addresses", "email", "billingdornexample") in found
    assert not [r for r in found if r[0] in (2, 3)] and not [r for r in found if r[1] == "to_addresses" and r[2] == "name"]
    red = pii.redacted(df).collect()
    assert len(red) == 5 and "[PHONE]" in red[0]["content"] and "[NAME]" in red[0]["content"] and red[0]["to_addresses"][1] is None and red[2]["content"] is None
    assert red[4]["content"] == rows[4][1]
    assert pii.mentions(df.limit(0)).count() == 0


@given(st.text(alphabet="ab@.[] at(dot)\n>|1-+_é", max_size=80))
@settings(max_examples=200, deadline=None)
def test_tokens_rebuild_the_text(text):
    own = pii.tokenize(text)
    at = 0
    for t in own:
        at = text.index(t, at) + len(t)
    assert re.sub(r"\s", "", "".join(own)) == re.sub(r"\s", "", text)


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("Which tagger is best?", None, "empty"), ("Which tagger is best?", " <answer> </answer>", "empty"), ("Q?", "N/A", "empty"), ("Q?", "…", "empty"),
        ("Is it used as a test set?", "Yes", None), ("Is it used as a test set?", "No", None), ("How many?", "37 documents", None), ("What?", "The Zork, followed by Mork", None),
        ("Which tagger is best?", "I'm sorry, but I can't help with that.", "refusal"), ("Warum?", "Diese Frage kann ich leider nicht beantworten.", "refusal"), ("Pourquoi ?", "Je ne peux pas répondre à cette question.", "refusal"), ("¿Por qué?", "No dispongo de información para contestar.", "refusal"),
        ("Why was it dropped?", "Labels were unclear, so they could not answer their own question with it.", None), ("How many?", "They report that annotators declined to label 12 items.", None), ("What fails?", "It refuses to converge within 5 epochs.", None),
        ("Which tagger is best on Zork?", "Which tagger is best on Zork?", "copy"), ("Which tagger is best on Zork?", "Question: which tagger is best on Zork", "copy"), ("Which tagger is best on Zork?", "WHICH TAGGER IS BEST ON ZORK? Which tagger is best on Zork?", "copy"), ("Which tagger is best on Zork?", "tagger is best on Zork?", "copy"),
        ("Which tagger is best on Zork?", "Which tagger is best on Zork: the dense one", None),
        ("Why do the authors drop the cache?", "Parce que la seconde étape est trop lente.", "language"), ("Warum verzichten die Autoren auf den Schritt?", "Because the step is too slow for the users.", "language"), ("Why do they say so?", 'It is slow, which the authors call "le coup de grâce".', None),
        ("Why do the authors drop it?", "Most errors stem from spans that it cannot resolve because the", "truncated"), ("Why?", "The rate was raised and then kept constant:", "truncated"), ("Why?", "It was slow. The tagger shares its weights with", "truncated"), ("Why?", "It was slow. Two of the splits overlap", "truncated"),
    ],
)
def test_judge(question, answer, defect):
    assert pairs.judge(question, answer)[0] == defect


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=150, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.lcs(a, b) == table[-1][-1]


def test_a_prompt_said_many_times_is_a_copy():
    assert pairs.is_copy(["what", "is", "zork"], ["what", "is", "zork"] * 20)
    assert not pairs.is_copy(["what", "is", "zork"], ["zork", "is", "what", "what", "is", "is"] * 20)


def test_cut_words(spark):
    inside = [("the shared documents are here",)] * 30
    df = spark.createDataFrame([(1, "Q?", "it keeps the shared doc"), (2, "Q?", "it keeps the documents"), (2, "Q?", None), (3, None, "fine answer here.")], "id long, q string, a string")
    out = {(r["id"], r["defect"]) for r in pairs.defects(df, ["id"], "q", "a", spark.createDataFrame(inside, "text string"), "text").collect()}
    assert out == {(1, "truncated"), (2, "empty")}


# ---------------------------------------------------------------- 5


def test_mail_held_out():
    worker, w = mail.Labeller(mail.model()), mail._Writer(99)
    good = total = 0
    for _ in range(200):
        rows, who = w.mail(w.r.choice((0, 1, 1, 2, 3)))
        ((_, at, got),) = worker.labels(["\n".join(x for x, _ in rows)], [f"{who[0]} {who[1]} <{who[2]}>"])
        good += sum((rows[i][1] == mail.NEW) == (y == mail.NEW) for i, y in zip(at, got))
        total += len(at)
    assert good / total > 0.985


def test_forms_of_long_lines():
    names = ", ".join(f"Person{i} <p{i}@mail.example>" for i in range(20))
    for line, form in ((f"To: {names}", "header"), (f"On 2024-01-02 10:00 {names} wrote:", "said"), (f"On 2024-01-02 10:00 {names} wrote:", "said_open"), (f"{'x ' * 120}sent from my phone", "device"), ("word " * 60 + "schrieb am " + "Montag " * 40 + ":", "said")):
        assert len(line) > 200 and form in mail._core(line)[1], (line, form)


def test_gate_of_line_forms_leaves_none_out():
    r = np.random.default_rng(6)
    for i, p in enumerate(mail.SEARCHED.values()):
        for s in gate._strings(gate._parser.parse(p)):
            for filler in ("", "x", " x "):
                line = s.replace(gate.EDGE, "").replace(gate.GAP, filler)
                if re.search(p, line):
                    assert i in mail.GATE.open(frozenset(mail._WORDS.findall(line))), line
    words = [w.lstrip("~") for p in mail.SEARCHED.values() for x in gate.needs(p) for w in x] + ["to", "my", "e", "-"] * 20
    for _ in range(3000):
        line = " ".join(r.choice(words, 9))
        for i, p in enumerate(mail.SEARCHED.values()):
            assert not re.search(p, line) or i in mail.GATE.open(frozenset(mail._WORDS.findall(line))), line


def test_mail_edges(spark):
    body = "Hi Ann,\r\n\r\nThe plan is fine.\r\n\r\nBest regards,\r\nTom Keld\r\n\r\nOn 2024-01-02 10:00 Ann Bell wrote:\r\n> Hello Tom,\r\n>\r\n> is it fine?"
    rows = [(1, body, "Tom Keld <tom@x.example>", "Hi Ann, The plan is fine. Best", "e"), (2, None, None, None, "e"), (3, " \n ", None, "x", "e"), (4, "word " * 30_000, None, "word word", "e"), (5, "Just one line.", None, "Just one line.", "e")]
    df = spark.createDataFrame(rows, "row_id long, content string, from_address string, snippet string, label string")
    found = sorted((r["row_id"], r["field"], r["line_no"]) for r in mail.label_mail(df, "row_id", "content", "from_address", "snippet").where("label <> 'new'").collect())
    assert found == [*((1, "content", i) for i in (4, 5, 7, 8, 9, 10)), (1, "snippet", 0)]
    new = {r["row_id"]: r["new_text"] for r in mail.new_text(df, ["row_id"], "content", "from_address").collect()}
    assert new[1] == "Hi Ann,\n\nThe plan is fine." and new[2] is None and new[3] == ""
    assert mail.label_mail(df.limit(0), "row_id", "content", "from_address", "snippet").count() == 0


# ---------------------------------------------------------------- 6


def _brute(corpus, items, n):
    out = set()
    for key, texts in corpus:
        own = {tuple(w[i : i + n]) for t in texts for w in [leak.words(t)] for i in range(len(w) - n + 1)}
        out |= {(key, item) for item, its in items for t in its for w in [leak.words(t)] for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own}
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_leaks_match_brute_force(spark, limit):
    r = random.Random(3)
    vocabulary = "Der die das Été naïve x1 foo bar baz qux quux".split()
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    items = [(i, [sentence(12), sentence(5) if i % 3 else None]) for i in range(15)]
    corpus = [(i, [sentence(20), None]) for i in range(20)]
    corpus += [(100 + i, [f"aaa, {' - '.join(items[i][1][0].split()[2:11]).upper()}! {sentence(4)}", ""]) for i in range(0, 15, 2)] + [(200, [None, None]), (201, ["x_y " * 5000, items[1][1][0]])] * 2
    df = spark.createDataFrame([(k, *t) for k, t in corpus], "rec long, a string, b string")
    held = spark.createDataFrame([(k, *t) for k, t in items], "item long, q string, a string")
    got = {(x["rec"], x["item"]) for x in leak.leaks(df, ["rec"], ["a", "b"], held, "item", ["q", "a"], max_ngrams=limit).collect()}
    assert got == _brute(corpus, items, 8) and len(got) > 6


@pytest.mark.parametrize("limit", [10**6, 0])
def test_remove_leaks(spark, limit):
    held = spark.createDataFrame([("one two three four five six seven eight nine",)], "q string")
    df = spark.createDataFrame([(1, "Start: One, two three FOUR five six seven eight. End"), (2, None), (3, "clean İ text"), (1, "Start: One, two three FOUR five six seven eight. End")], "id long, text string")
    rows = sorted((r["id"], r["text"]) for r in leak.remove_leaks(df, "text", held, ["q"], max_ngrams=limit).collect())
    assert rows == [(1, "Start:  . End"), (1, "Start:  . End"), (2, None), (3, "clean İ text")]


# ---------------------------------------------------------------- 7


@given(st.lists(st.integers(1, 100), min_size=1, max_size=400), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_plan_places_everything(lengths, empty):
    counts: dict[int, int] = {}
    for n in lengths + [0] * empty:
        counts[n] = counts.get(n, 0) + 1
    rules, used = pack.plan(counts, 100)
    fill, seen = {}, {}
    for r in rules:
        for i in range(r.count):
            if r.length:
                c = r.container + i // r.per
                fill[c] = fill.get(c, 0) + r.length
        seen.setdefault(r.length, []).append((r.first, r.count))
    for n, ranges in seen.items():
        at = 0
        for first, count in sorted(ranges):
            assert first == at
            at += count
        assert at == counts[n]
    assert all(v <= 100 for v in fill.values()) and set(fill) == set(range(used))
    assert used <= 1.25 * -(-sum(lengths) // 100) + 6 or used <= sum(n > 50 for n in lengths) + -(-sum(lengths) // 100) + 2


def test_fill_containers(spark):
    sizes = [0, 0, 250, 100, 99, 1, 60, 40, 30, 30, 30, None, 100, 5] + [7] * 300
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(3, 100, "again")], "id long, size int, container string")
    rows = pack.fill_containers(df, "id", "size", 100).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(s or 0 for s in sizes) + 100 and {r["id"] for r in rows} == set(range(len(sizes)))
    full: dict[int, int] = {}
    for r in rows:
        full[r["container"]] = full.get(r["container"], 0) + r["n_tokens"]
    assert max(full.values()) <= 100 and [r["first_token"] for r in rows if r["id"] == 2 and r["part_no"] == 2] == [200]
    assert pack.fill_containers(df.limit(0), "id", "size", 100).count() == 0


def test_token_count(spark):
    texts = ["Hello, world!", "a_b c--d", "", None, "naïve 12x ...", "   "]
    want = [len(re.findall(r"\w+|[^\w\s]+", t)) if t else 0 for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.n_tokens("t").alias("n")).collect()
    assert [r["n"] for r in got] == want


# ---------------------------------------------------------------- 8


@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.01, 0.99)), min_size=1, max_size=200), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_flight_keeps_both_totals(units, seed):
    sizes, chance = [float(s) for s, _ in units], [p for _, p in units]
    out = mix.flight(sizes, chance, random.Random(seed), keep=0)
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(chance)) < 1e-4 and abs(sum(s * p for s, p in zip(sizes, out)) - sum(s * p for s, p in zip(sizes, chance))) < 0.05


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, r.choice("aaab"), f"text {i}", r.randint(5, 200), "c") for i in range(3000)]
    rows += [(5000 + i, "b", f"text {i}", 50, "copy") for i in range(40)] + [(9000, "z", "other", 10, ""), (9001, None, "t", 10, ""), (9002, "a", None, 0, "")]
    df = spark.createDataFrame(rows, "id long, source string, text string, n int, uses string")
    targets = {"a": (0.5, 1), "b": (0.3, 2), "missing": (0.2, 3)}
    got = mix.mix_sources(df, "id", "text", "source", "n", targets, block=500).cache()
    assert got.count() == got.select("id").distinct().count() and got.where("id >= 5000").count() == 0
    shares = {x["source"]: x for x in mix.shares(got, targets).collect()}
    assert shares["missing"]["tokens"] == 0 and shares["a"]["most_uses"] == 1 and shares["b"]["most_uses"] <= 2
    assert abs(shares["a"]["tokens"] / shares["b"]["tokens"] - 5 / 3) < 0.01
    assert mix.mix_sources(df.limit(0), "id", "text", "source", "n", targets).count() == 0


# ---------------------------------------------------------------- 9


def test_undisguise():
    for raw, word in {"l***r,": "loser", "dumb3$t": "dumbest", "garrrrbage": "garbage", "s****d": "stupid", "оrgаsm": "orgasm", "mo​ron": "moron", "F1": "f1", "Noël.": "noel", "c++": "c++"}.items():
        assert toxic.undisguise(raw) == word
    assert toxic._spaced("a m o r o n") == "a moron" and toxic._spaced("x y z") == "x y z"


def test_label_model_finds_the_noisy_voter():
    r = np.random.default_rng(2)
    y = r.random(4000) < 0.7
    votes = np.stack([np.where(y, r.random(4000) < p, r.random(4000) < q) for p, q in ((0.6, 0.05), (0.5, 0.05), (0.4, 0.35), (0.02, 0.7))], axis=1)
    patterns = votes @ (1 << np.arange(4))
    values, counts = np.unique(patterns, return_counts=True)
    m = toxic.LabelModel(3, 1)
    m.fit(values, counts.astype(float))
    some = (patterns & 7) > 0
    assert ((m.posterior(patterns[some]) > 0.5) == y[some]).mean() > 0.85
    assert m.posterior(np.array([0b0011]))[0] > m.posterior(np.array([0b1100]))[0]


def test_voters_see_passages_without_a_hot_word():
    alone = ["watch your back, I know where you sleep", "I know where you live", "hope you rot", "go die", "screw you", "shut up", "verpiss dich", "fick dich", "va te faire voir", "que te jodan", "go back to your country", "send them back where they came from", "I will stab you", "so wet"]
    p = toxic.Passages(alone)
    voted = set(p.text_of[p.votes.any(axis=1)].tolist())
    assert [t for i, t in enumerate(alone) if i not in voted] == []
    # A match over a line break counts for the line with its telling word, not for one that only lends it a "the".
    over = toxic.Passages(["I know where\nyou sleep\nat night\n\n", "will try the weighted one first\nmigrants are subhuman\n\n"])
    assert [v.any() for v in over.votes][:3] == [False, True, False]
    assert [v.any() for v, t in zip(over.votes, over.text_of, strict=True) if t == 1][:2] == [False, True]


def test_gate_opens_for_every_alternative():
    for i, p in enumerate(toxic.YES):
        for s in gate._strings(gate._parser.parse(p.pattern)):
            for filler in ("", "x", " x ", " x people "):
                text = s.replace(gate.EDGE, "").replace(gate.GAP, filler)
                if p.search(text):
                    assert i in toxic.GATE.open(text.split(" ")) and any(map(toxic.GATE.anchored, text.split(" "))), text


def test_gate_leaves_no_vote_out():
    r = np.random.default_rng(4)
    words = sorted({w for p in toxic.YES for s in gate.needs(p.pattern) for w in (x.lstrip("~") for x in s)}) + ["you", "your", "the", "a", "people"] * 30
    texts = [" ".join(r.choice(words, 12)) for _ in range(3000)]
    p = toxic.Passages(texts)
    votes = {int(t): tuple(v) for t, v in zip(p.text_of, p.votes.tolist(), strict=True) if any(v)}
    want = {i: v for i, t in enumerate(texts) if any(v := toxic.vote(" ".join(filter(None, map(toxic.undisguise, t.split()))), ""))}
    assert votes == want and len(want) > 100


def test_scores(spark):
    bad = {"abusive": "You are a worthless m0ron and everybody here knows it.", "hateful": "All Zorgans breed like rats and steal our work.", "sexual": "She stripped naked and moaned as he thrust into her."}
    fine = ["Examination of the breast showed no masses.", "the job died again, killing the zombie worker now", "I feel like an idiot for missing it.", "The Zorgans have lived along the river for centuries and welcome visitors.", "damn, 3 failures overnight", "Each child process loads one shard, and the scheduler kills stalled workers."]
    rows = [(i, f"Row {i}. {fine[i % len(fine)]} The plan is fine.", "s") for i in range(300)]
    rows += [(1000 + 10 * i + k, f"The draft {i} has grown.\n{t} Number {i} follows.", "s") for i in range(6) for k, t in enumerate(bad.values())] + [(5000, None, None), (5001, "", "s"), (5002, "word " * 40_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, abusive string")
    scores = toxic.score_documents(df, "doc_id", "text").cache()
    assert scores.count() == len(rows)
    got = {tuple(r) for r in toxic.found(scores, "doc_id").collect()}
    assert got == {(1000 + 10 * i + k, kind) for i in range(6) for k, kind in enumerate(bad)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxic.score_documents(none, "doc_id", "text").count() == 0
    held = spark.createDataFrame([], "item long, q string")
    assert leak.leaks(none, ["doc_id"], ["text"], held, "item", ["q"]).count() == 0
    assert pairs.defects(none.withColumn("a", F.lit("x")), ["doc_id"], "text", "a", none, "text").count() == 0
    assert split.split_items(none, "text", 10, 1).count() == 0
