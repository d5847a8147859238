import re

import pytest
from pyspark.sql import functions as F

from qcorpus.operators import analytics, catalog, dedupe, layout, lifecycle, merge, pieces, publish, search, similarity
from qcorpus.queries import QUERIES
from qcorpus.storage import stored


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    once = merge.merge_upsert(target, source, ["k"])
    assert rows(once) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(merge.merge_upsert(once, source, ["k"])) == rows(once)


def test_upsert_condition_sees_both_sides(spark):
    target = spark.createDataFrame([(1, "flagged"), (2, "kept")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string")
    got = merge.merge_upsert(target, source, ["k"], condition=F.col("old.v") == "flagged")
    assert rows(got) == [(1, "x"), (2, "kept")]


def test_insert_absent_is_null_safe(spark):
    target = spark.createDataFrame([(None, 1)], "k int, v int")
    source = spark.createDataFrame([(None, 2), (5, 3)], "k int, v int")
    assert rows(merge.insert_absent(target, source, ["k"], null_safe=True), "v") == [(1,), (3,)]


def test_append_numbered(spark):
    target = spark.createDataFrame([("s", 4)], "g string, n int")
    source = spark.createDataFrame([("s", 1, None), ("s", 2, None), ("t", 3, None), ("s", 4, 9)], "g string, k int, n int")
    assert rows(merge.append_numbered(target, source, "g", ["k"], "n"), "k", "n") == [(1, 5), (2, 6), (3, 1), (4, 9)]


@pytest.mark.parametrize("old,new,status,result", [
    (None, ("h", "ready"), "ready", "inserted"), (("h", "in_review"), ("x", "held"), "in_review", "waiting"),
    (("h", "published"), ("h", "ready"), "published", "unchanged"), (("h", "published"), ("x", "ready"), "ready", "changed"),
    (("h", "held"), ("h", "ready"), "ready", "unchanged"),
])
def test_intake_states(spark, old, new, status, result):
    stored = spark.createDataFrame([(1, *old)] if old else [], "k int, content_hash string, status string")
    got = lifecycle.record_intake(stored, spark.createDataFrame([(1, *new)], "k int, content_hash string, status string"), ["k"])
    assert rows(got, "status", "result") == [(status, result)]


def test_changes_against_the_latest_artifact(spark):
    stored = spark.createDataFrame([("s", "u", "a", 1), ("s", "u", "b", 2)], "source string, url string, sha256 string, fetched_at int")
    got = lifecycle.classify_changes(stored, spark.createDataFrame(
        [("s", "u", "b", 200), ("s", "u", "a", 200), ("s", "v", "a", 200), ("s", "u", "z", 304)], "source string, url string, sha256 string, http_status int"))
    assert rows(got, "url", "sha256", "change") == [("u", "a", "changed"), ("u", "b", "unchanged"), ("u", "z", "unchanged"), ("v", "a", "new")]


def test_removed_keeps_what_a_person_decided(spark):
    known = spark.createDataFrame([("s", "gone"), ("s", "ignored"), ("s", "back")], "source string, url string")
    found = spark.createDataFrame([("s", "back"), ("s", "ignored2")], "source string, url string")
    removed = spark.createDataFrame([("s", "ignored", "ignored"), ("s", "back", "flagged"), ("s", "ignored2", "ignored")], "source string, url string, status string")
    got = lifecycle.reconcile_removed(known, found, removed)
    assert rows(got, "url", "status") == [("back", "restored"), ("gone", "flagged"), ("ignored", "ignored"), ("ignored2", "ignored")]


def test_error_rate_is_null_without_recent_jobs(spark):
    jobs = spark.sql("SELECT 's' AS source, timestamp'2024-01-01' AS created, 'failed' AS status, 5 AS ms UNION ALL SELECT 't', timestamp'2024-06-01', 'completed', 7")
    got = lifecycle.source_health(jobs, "source", "created", F.col("status"), F.col("ms"), 30, F.lit("2024-06-02").cast("timestamp"))
    assert rows(got, "source", "recent_jobs", "error_rate", "avg_runtime_ms") == [("s", 0, None, 5.0), ("t", 1, 0.0, 7.0)]


def test_top_entities_drop_nulls_after_the_limit(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("a",)] * 2 + [("b",)], "e string")
    assert rows(analytics.top_entities(df, "e", 2)) == [("a", 2)]


def test_latest_per_key_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2020, "y"), (1, 2019, "z")], "k int, year int, v string")
    assert rows(catalog.latest_per_key(df, ["k"], [F.desc_nulls_last("year")]), "v") == [("y",)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_pairs_equal_brute_force(spark):
    import random

    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    texts = []
    for _ in range(40):
        t = " ".join(random.choice(words) for _ in range(random.randint(3, 9)))
        texts += [t, t[: len(t) // 2] + random.choice("xyz ") + t[len(t) // 2 + 1 :]]
    texts = sorted({" ".join(t.split()) for t in texts})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = rows(similarity.similar_pairs(df, None, 0.85), "a", "b")
    want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and 1 - edit(a, b) / max(len(a), len(b)) >= 0.85)
    assert got == want and want


def decide(spark, text, options, answers, corpus, remembered=None):
    schema = "id long, text string, options array<string>, answers array<string>"
    got = dedupe.decide(spark.createDataFrame([(1, text, options, answers)], schema), spark.createDataFrame(corpus, schema), remembered=remembered)
    r = got.first()
    return r["outcome"], r["existing"], r["suggestion"]


CORPUS = [(10, "What is the capital city of the old republic in 1999?", ["a", "b"], ["a"]), (11, "Something else entirely, with other words", ["c", "d"], ["c"])]


@pytest.mark.parametrize("text,options,answer,want", [
    ("what is the CAPITAL city of the old republic in 1999", ["a", "b"], ["a"], ("same", 10, None)),
    ("What is the capital city of the old republic in 1999?", ["a", "x"], ["a"], ("conflicting", 10, "same")),
    ("What is the capital city of the old republic in 1999?", ["a", "b"], ["b"], ("conflicting", 10, "different")),
    ("What is the capitol city of the old republic in 1999?", ["a", "b"], ["a"], ("near", 10, "same")),
    ("What is the capital city of the old republic in 1998?", ["a", "b"], ["a"], ("near", 10, "different")),
    ("Nothing of the kind at all", ["a"], ["a"], ("unique", None, None)),
])
def test_decisions(spark, text, options, answer, want):
    assert decide(spark, text, options, answer, CORPUS) == want


def test_decisions_that_are_remembered(spark):
    from qcorpus.functions.text import normalize_text

    kind = "id long, text string, options array<string>, answers array<string>"
    near = "What is the capitol city of the old republic in 1999?"
    probes = spark.createDataFrame([(1, CORPUS[0][1], ["a", "x"], ["a"]), (2, CORPUS[0][1], ["a", "y"], ["a"]), (3, near, ["a", "b"], ["a"]), (4, near, ["a"], ["a"]), (5, CORPUS[0][1], ["a", "z"], ["a"])], kind)
    notes = [(10, CORPUS[0][1], ["a", "x"], ["a"], "skipped", 1), (10, CORPUS[0][1], ["a", "x"], ["a"], "same", 2), (10, CORPUS[0][1], ["a", "y"], ["a"], "skipped", None), (10, near, ["a", "b"], ["a"], "skipped", 1), (10, near, ["a"], ["a"], "different", 1)]
    remembered = spark.createDataFrame(notes, "existing long, text string, options array<string>, answers array<string>, status string, decided_at int").withColumn("norm", normalize_text(F.col("text")))
    got = dedupe.decide(probes, spark.createDataFrame(CORPUS, kind), remembered=remembered)
    assert rows(got, "probe", "outcome", "existing") == [(1, "remembered_same", 10), (2, "remembered_skipped", 10), (3, "remembered_skipped", 10), (4, "near", 10), (5, "conflicting", 10)]


def test_the_same_question_in_the_own_set_is_preferred(spark):
    kind = "id long, text string, options array<string>, answers array<string>, question_set string"
    t = CORPUS[0][1]
    corpus = spark.createDataFrame([(10, t, ["a"], ["a"], "s"), (11, t, ["a"], ["a"], "t"), (12, t, ["b"], ["a"], "u")], kind)
    probes = spark.createDataFrame([(1, t, ["a"], ["a"], "t"), (2, t, ["a"], ["a"], "u"), (3, t, ["c"], ["a"], "t")], kind)
    assert rows(dedupe.decide(probes, corpus), "probe", "outcome", "existing", "in_set") == [(1, "same", 11, True), (2, "same", 10, False), (3, "conflicting", 10, None)]


def test_decisions_cover_all_turns_and_the_benchmark(spark, tmp_path):
    t = "Which of the following rivers flows through the capital of the old republic, number "
    turns = [(1, 0, t + "aa"), (1, 1, t + "AA!"), (3, 0, t + "aa"), (5, 0, t + "bb"), (2, 0, "A benchmark item, word for word"), (4, 0, "Something else altogether"), (4, 1, "something else altogether")]
    spark.createDataFrame([(*x[:2], "user", x[2]) for x in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "A benchmark item, word for word"), (8, "Unlike")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = rows(QUERIES["dedupe_decisions"](spark, str(tmp_path)), "probe", "outcome", "existing")
    assert got == [(1000, "same", 3000), (1001, "same", 3000), (2000, "conflicting", -8), (3000, "same", 1000), (4000, "unique", None), (4001, "unique", None), (5000, "near", 1000)]
    flow = {r["conv_id"]: r for r in QUERIES["publish_flow"](spark, str(tmp_path)).collect()}
    assert sorted(flow) == [1, 2, 3, 4, 5] and flow[2]["held"] == 1


def test_audit_reports_copies_and_pairs_from_085(spark, tmp_path):
    t = "0123456789 abcdefghij klmnopqrst uvwxyz"
    turns = [(1, 0, "user", t), (1, 1, "user", t.upper()), (2, 0, "bot", f"{t}!"), (3, 0, "user", t[:-5] + "-----+uvxyz"), (4, 0, "user", t[:-6] + "zzzzzz"), (5, 0, "user", t[:-5] + "zzzzz"), (6, 0, "user", t[:20])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r)[:5] + (round(r["similarity"], 3), r["options_match"]) for r in QUERIES["near_dup_items"](spark, str(tmp_path)).collect()]
    assert ("exact", 1, 0, 1, 1, 1.0, True) in found and ("same_wording", 1, 0, 2, 0, 1.0, False) in found
    assert ("similar", 1, 0, 5, 0, 0.897, True) in found and ("similar", 2, 0, 5, 0, 0.897, False) in found
    assert not [r for r in found if 6 in (r[1], r[3])] and [r[5] for r in found] == sorted((r[5] for r in found), reverse=True)


def test_profile_threshold_is_checked():
    for wrong in ({"threshold": 0.4}, {"identity": "number"}):
        with pytest.raises(ValueError):
            dedupe.Profile(**wrong)


def test_waves(spark):
    t = "the very same long question text about rivers and lakes number"
    df = spark.createDataFrame([(1, 0, t + " aa"), (1, 1, t + " ab"), (1, 2, "nothing like the others, not at all"), (1, 3, t + " ac")], "batch long, position long, text string")
    assert rows(dedupe.plan_waves(df), "position", "wave") == [(0, 0), (1, 1), (2, 0), (3, 2)]


def test_waves_join_no_rows_of_other_batches(spark):
    t = "the same first question of all batches"
    df = spark.createDataFrame([(b, p, t) for b in range(3) for p in range(2)], "batch long, position long, text string")
    assert rows(dedupe.plan_waves(df)) == [(b, p, p) for b in range(3) for p in range(2)]
    plan = pieces.candidates(df.select(F.struct("batch", "position").alias("id"), F.col("batch").alias("part"), "text"), 0.9, within=True)._jdf.queryExecution().optimizedPlan().toString()
    keys = [x for x in plan.splitlines() if "Join Inner" in x and "(key#" in x]
    assert keys and all(re.search(r"\((batch|part)#\d+L? = (batch|part)#\d+L?\)", x) for x in keys)


def test_waves_are_longest_paths(spark):
    a, b = "one question of the batch that repeats", "one question of the batch that repeated"
    data = [("x", 1, a), ("x", 2, "nothing like the others here"), ("x", 3, b), ("x", 3, a), ("x", 3, a), ("x", 4, None), ("x", 4, None), ("x", 9, b), ("y", 1, b), ("y", 2, ""), ("y", 3, "")]
    df = spark.createDataFrame(data, "batch string, position int, text string")
    got = rows(dedupe.plan_waves(df))
    assert [r for r in got if r[1] != 3] == [("x", 1, 0), ("x", 2, 0), ("x", 4, 0), ("x", 4, 0), ("x", 9, 3), ("y", 1, 0), ("y", 2, 0)]
    assert sorted(w for x, p, w in got if (x, p) == ("x", 3)) in ([1, 1, 2], [1, 2, 2]) and [r for r in got if r[0] == "y" and r[1] == 3] == [("y", 3, 0)]
    assert dedupe.plan_waves(df.limit(0)).count() == 0


def test_waves_of_many_copies_take_no_round_each(spark, monkeypatch):
    stores = []
    monkeypatch.setattr(dedupe, "stored", lambda df, name: stores.append(name) or stored(df, name))
    a, b = "one question of the batch that repeats", "one question of the batch that repeated"
    data = [("x", p, (a, b)[p % 2]) for p in range(30)] + [("y", p, a) for p in range(500)] + [("y", None, a), (None, 1, a), (None, 2, a)]
    got = dedupe.plan_waves(spark.createDataFrame(data, "batch string, position int, text string")).collect()
    assert sorted((r["batch"], r["position"], r["wave"]) for r in got if r["batch"] and r["position"] is not None) == [("x", p, p) for p in range(30)] + [("y", p, p) for p in range(500)]
    assert [r["wave"] for r in got if r["batch"] is None or r["position"] is None] == [0, 0, 0] and len(stores) < 5


def test_key_status_moves_forward_only(spark):
    sets = spark.createDataFrame([("a", "final"), ("b", "none")], "slug string, key_status string")
    new = spark.createDataFrame([("a", "provisional"), ("b", "provisional"), ("c", "none")], "slug string, key_status string")
    assert rows(publish.upsert_question_sets(sets, new)) == [("a", "final"), ("b", "provisional"), ("c", "none")]


def test_review_answers(spark):
    df = spark.createDataFrame([(["Red ", "blue", "Green"], a) for a in ("red", "Green | red", "purple", "blue | purple")], "o array<string>, a string")
    assert [r[0] for r in df.select(publish.review_answer_keys(F.col("o"), F.col("a"))).collect()] == [["A"], ["A", "C"], None, None]


def test_search_ranks_titles_first_and_needs_all_words(spark):
    docs = spark.createDataFrame([(1, "binary trees", "x"), (2, "other", "binary trees"), (3, "binary", "y")], "id long, title string, body string")
    index = search.postings(docs, "id", ["title", "body"])
    got = search.search(index, spark.createDataFrame([("binary tree",), ("the",)], "query string"))
    assert [(r["id"], r["place"]) for r in got.orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_lines_compare_with_the_first_word(spark):
    words = spark.createDataFrame([(1, 1, f"w{i}", 10.0 * i, 10.0 * i + 8, t, t + 5) for i, t in enumerate([0.0, 2.0, 4.0, 6.0])], "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double")
    assert rows(layout.group_lines(words), "line", "text") == [(0, "w0 w1"), (1, "w2 w3")]


def test_running_lines_go(spark):
    lines = spark.createDataFrame([(1, p, n, t, t + 10, 0.0, 50.0, x) for p in range(3) for n, t, x in ((0, 5.0, f"Page {p}"), (1, 300.0, f"body {p}"))], "doc_id long, page int, line int, top double, bottom double, x0 double, x1 double, text string")
    assert [r["text"] for r in layout.strip_running_text(lines, 800.0).orderBy("page").collect()] == ["body 0", "body 1", "body 2"]


def boxes(spark, lines):
    """Word boxes of lines of (page, top, ((x0, text), ...)); a letter is five points wide."""
    rows = [(1, p, t, float(x), x + 5.0 * len(t), float(top), top + 8.0) for p, top, words in lines for x, t in words]
    return spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double")


def test_segments_and_options(spark):
    lines = [
        (0, 0, ((0, "front"),)), (0, 20, ((0, "Q1"), (15, "Which"), (45, "of"), (60, "(A)"), (80, "is"))), (0, 40, ((0, "it?"),)), (0, 60, ((0, "(A)127"), (100, "(B)"), (118, "two"))),
        (1, 0, ((0, "more"), (30, "(C)"), (50, "not"))), (1, 20, ((0, "Q2"), (15, "And?"))), (1, 40, ((0, "(A)"), (20, "x"))),
    ]
    words = layout.line_words(boxes(spark, lines))
    labels = layout.segment(layout.group_lines(boxes(spark, lines)), label=r"^Q(\d+)\b").select("doc_id", "page", "line", "label")
    got = layout.split_options(words.join(labels, ["doc_id", "page", "line"])).orderBy("label").collect()
    assert [(r["label"], r["stem"], [tuple(o) for o in r["options"]]) for r in got] == [
        (1, "Q1 Which of (A) is\nit?", [("A", "127"), ("B", "two more (C) not")]), (2, "Q2 And?", [("A", "x")])]


def test_key_tables(spark):
    profile = {"number": ("Q. No.",), "qtype": ("Question Type", "Q. Type"), "key": ("Key/Range",)}
    pages = [
        (0, 0, ((0, "Answer"), (40, "key"))), (0, 20, ((0, "Q."), (15, "No."), (100, "Question"), (200, "Key/"))), (0, 30, ((105, "Type"), (195, "Range"))),
        (0, 50, ((5, "1"), (105, "NAT"), (180, "4.2"), (199, "to"), (213, "5"))), (0, 70, ((5, "x"), (105, "MCQ"), (200, "A"))), (1, 0, ((5, "2"), (105, "MCQ"), (200, "B"))),
        (2, 0, ((100, "Key/Range"), (200, "Q. No."), (300, "Q. Type"))), (2, 20, ((110, "C"), (210, "3"), (310, "MSQ"))),
    ]
    got = layout.key_table(layout.line_words(boxes(spark, pages)), profile).orderBy("number").collect()
    assert [(r["number"], r["page"], r["values"], r["error"]) for r in got] == [
        (1, 0, {"number": "1", "qtype": "NAT", "key": "4.2 to 5"}, None), (2, 1, {"number": "2", "qtype": "MCQ", "key": "B"}, None), (3, 2, {"number": "3", "qtype": "MSQ", "key": "C"}, None)]
    none = layout.key_table(layout.line_words(boxes(spark, pages[4:6])), profile).collect()
    assert [(r["number"], r["error"]) for r in none] == [(None, "no header")]


@pytest.mark.parametrize("hold,refused", [(False, "failed"), (True, "held")])
def test_positions_that_are_taken(spark, hold, refused):
    stored = spark.createDataFrame([(1, "P1"), (2, "P2"), (3, "P2-D")], "id int, stable_id string")
    rows = [(10, "P1", "P1-D", None, False), (11, "P1", "P1-D", None, True), (12, "P2", "P2-D", None, True), (13, "P9", "P9-D", 2, False), (14, "N", "N-D", None, False), (15, "N", "N-D", None, None), (16, "P1", "P1-E", 1, True)]
    incoming = spark.createDataFrame(rows, "id int, stable_id string, distinct_id string, existing int, force_new boolean")
    assert rows_of(publish.resolve_questions(incoming, stored, ["id"], hold)) == [
        (10, refused, 1, "P1"), (11, "created", None, "P1-D"), (12, "linked", 3, "P2-D"), (13, "linked", 2, "P9"), (14, "created", None, "N"), (15, refused, None, "N"), (16, "created", None, "P1-E")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_new_wording_in_place(spark):
    questions = spark.createDataFrame([(1, "Old *text*", "plain", "a*b"), (2, "Same", "plain", "e"), (3, "Left", "plain", None)], "id int, question_text string, text_format string, explanation string")
    options = spark.createDataFrame([(10, 1, 0, "A", "x"), (11, 1, 1, "B", "y"), (20, 2, 0, "A", "z"), (30, 3, 0, "A", "w")], "id int, question_id int, position int, option_key string, option_text string")
    from qcorpus.functions.text import content_hash, normalize_text

    variants = spark.createDataFrame([(1, "New text!")], "question_id int, text string").withColumn("content_hash", content_hash(normalize_text(F.col("text"))))
    kind = "id int, question_text string, text_format string, explanation string, options array<struct<key:string,text:string>>"
    chosen = spark.createDataFrame([(1, "new text", "markdown", None, [("B", "p"), ("C", "q")]), (2, "SAME", "plain", "f", [("A", "zz")]), (3, "Other", "plain", None, []), (9, "t", "plain", None, [])], kind)
    q, o, v, errors = publish.reword_questions(questions, options, variants.select("question_id", "content_hash", "text"), chosen)
    assert rows_of(q) == [(1, "new text", "markdown", "a\\*b"), (2, "SAME", "plain", "f"), (3, "Left", "plain", None)]
    assert rows_of(o) == [(10, 1, 0, "B", "p"), (11, 1, 1, "C", "q"), (20, 2, 0, "A", "zz"), (30, 3, 0, "A", "w")]
    assert [(r["question_id"], r["text"]) for r in v.collect()] == [(1, "Old *text*")] and rows_of(errors) == [(3, "another number of options"), (9, "the question does not exist")]


def test_nearest_column(spark):
    cells = spark.createDataFrame([(1, 0, "c", 12.0, 18.0), (1, 0, "d", 90.0, 99.0)], "doc_id long, page int, text string, x0 double, x1 double")
    headers = spark.createDataFrame([(1, 0, "no", 10.0, 20.0), (1, 0, "key", 80.0, 100.0)], "doc_id long, page int, column string, x0 double, x1 double")
    assert rows(layout.nearest_column(cells, headers), "text", "column") == [("c", "no"), ("d", "key")]


def test_answer_keys(spark):
    cases = [
        ("NAT", "1 to 2 OR 5 to 6", [(1, 2), (5, 6)]), ("NAT", "\u22123  to \u20131.5 or 0to0", [(-3, -1.5), (0, 0)]), ("NAT", "7", None), ("NAT", "5 to 2", None), ("NAT", "1 to 2 OR", None),
        ("NAT", "2 OR 3", None), ("MCQ", " a ", ["A"]), ("MCQ", "A;B", None), ("MCQ", "E", None), ("MSQ", "c, A", ["C", "A"]), ("MSQ", "A;A", None), ("MSQ", "A B", None), ("XX", "A", None), ("MCQ", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases] + [("MSQ", "mta")], "k string, r string")
    got = [r[0] for r in df.select(layout.answer_value(F.col("k"), F.col("r"))).collect()]
    assert [v["ranges"] and [tuple(x) for x in v["ranges"]] or v["keys"] for v in got[:-1]] == [c[2] for c in cases]
    assert [v["error"] is None for v in got] == [c[2] is not None for c in cases] + [True] and [v["marks_to_all"] for v in got] == [False] * len(cases) + [True]


@pytest.mark.parametrize("stages,status,summary", [
    ([("fetch", "completed", 0, None), ("parse", "completed", 0, None)], "completed", None), ([("fetch", "running", 0, None)], "failed", None),
    ([("fetch", "completed", 0, None), ("parse", "running", 0, None)], "partial", None), ([("fetch", "completed", 2, None), ("parse", "completed", 1, None)], "partial", "fetch: 2 item(s) failed; parse: 1 item(s) failed"),
    ([("fetch", "completed", 2, None), ("parse", "failed", 0, "no page")], "partial", "parse: no page"), ([("fetch", "failed", 3, "a"), ("parse", "failed", 0, None)], "failed", "fetch: a"),
])
def test_job_status(spark, stages, status, summary):
    df = spark.createDataFrame([("j", i, *s) for i, s in enumerate(stages)], "job string, position int, stage string, status string, failed_items int, error string")
    assert rows(lifecycle.finalize_jobs(df), "status", "error_summary") == [(status, summary)]


def test_job_queue(spark):
    schema = "id int, status string, job_type string, run_id string, run_position int, created_at int, started_at timestamp, completed_at timestamp, error_summary string"
    jobs = spark.createDataFrame([(i, s, t, r, p, c, None, None, None) for i, (s, t, r, p, c) in enumerate([
        ("queued", "a", "r", 2, 1), ("queued", "a", "r", 1, 1), ("running", "a", "q", 0, 0), ("running", "a", None, 0, 0), ("queued", "a", None, 0, 0), ("queued", "b", "q", 0, 5)])], schema)
    now = F.lit("2024-01-01").cast("timestamp")
    state = lambda df: [r["status"] for r in df.orderBy("id").collect()]
    assert state(lifecycle.requeue_interrupted(jobs, "a")) == ["queued", "queued", "queued", "running", "queued", "queued"]
    assert state(lifecycle.cancel_run(jobs, "q", now)) == ["queued", "queued", "running", "running", "queued", "cancelled"]
    claimed = lifecycle.claim_next(jobs, "a", now)
    assert state(claimed) == ["queued", "running", "running", "running", "queued", "queued"] and claimed.where("started_at is not null").count() == 1
    assert state(lifecycle.start_jobs(jobs, spark.createDataFrame([(4,)], "id int"), now)) == ["queued", "queued", "running", "running", "running", "queued"]


def test_content_ids(spark):
    df = spark.createDataFrame([("gate", "cs_it x", 2025, None, "civil", "cs-1", 7, "What\u2019s it?", "position"), ("gate", "v", None, "may 2", "s", None, 1234, "e\u0301", "content"), ("g", "v", None, None, "s", None, None, "t", "position")],
                               "e string, v string, y int, l string, s string, h string, n int, t string, i string")
    c = [F.col(x) for x in "evylshnti"]
    import hashlib

    shape = hashlib.sha256("a\x1fb\x1ea".encode()).hexdigest()[:8].upper()
    got = df.select(publish.stable_content_id(*c), publish.stable_content_id(*c, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")), F.col("n") == 7), publish.question_set_slug(*c[:6])).collect()
    content = hashlib.sha256("\u00e9".encode()).hexdigest()[:16].upper()
    assert [tuple(r) for r in got] == [
        ("GATE-CS-IT-X-2025-CIVIL-CS-1-Q007", f"GATE-CS-IT-X-2025-CIVIL-CS-1-Q007-D{shape}", "gate-cs-it-x-2025-civil-cs-1"),
        (f"GATE-V-MAY-2-S-C{content}", f"GATE-V-MAY-2-S-C{content}", "gate-v-may-2-s"), (None, None, "g-v-v1-s")]


def test_patterns_in_urls(spark):
    names = spark.createDataFrame([("Exam One", "https://x/exams/one-long-name?x"), ("other", "https://x/ab/1"), ("AZ-900 basics", None), ("none", "https://y")], "name string, url string")
    registered = spark.createDataFrame([("exam-one", None, None), ("long", None, "/one-long-name"), ("ab", None, "/ab"), ("az", "az-900", None)], "slug string, code string, url_pattern string")
    assert sorted((r["name"], r["slug"]) for r in catalog.match_registered(names, registered).collect()) == [("AZ-900 basics", "az"), ("Exam One", "exam-one"), ("none", None), ("other", "ab")]


def test_stale_reviews_hold_nothing(spark):
    stored = spark.createDataFrame([(1, "h", "in_review", True), (2, "h", "in_review", False), (3, "h", "in_review", None), (4, "h", "published", None)], "k int, content_hash string, status string, review_open boolean")
    new = spark.createDataFrame([(k, "x", "held") for k in range(1, 5)], "k int, content_hash string, status string")
    assert rows(lifecycle.record_intake(stored, new, ["k"]), "k", "status", "result") == [(1, "in_review", "waiting"), (2, "held", "changed"), (3, "held", "changed"), (4, "held", "changed")]


def test_attempts(spark):
    answers = spark.createDataFrame([(1, "a", None, None, None), (1, "b", None, None, None), (2, None, 1.0, 2.0, None), (3, None, None, None, "four")], "question_id int, option_id string, numeric_min double, numeric_max double, text_answer string")
    tries = [(1, 1, ["b", "a", "b"], None, None, "s"), (2, 1, ["a"], None, 5, "s"), (3, 2, None, "1,5", None, "s"), (4, 2, None, "2.1", None, "s"), (5, 3, None, " four", None, "s"), (6, 9, ["a"], None, None, "s"), (7, 1, None, None, None, "s")]
    from qcorpus.operators import practice

    got = practice.record_attempts(spark.createDataFrame(tries, "id int, question_id int, selected array<string>, numeric_answer string, user_id int, session_id string"), answers)
    assert rows(got, "id", "is_correct", "session_id", "first_option") == [
        (1, True, "s", "b"), (2, False, None, "a"), (3, True, "s", None), (4, False, "s", None), (5, True, "s", None), (7, False, "s", None)]


def test_issue_summary(spark):
    df = spark.createDataFrame([(1, "p", "held", '[{"code":"a"},{"code":"a"},{"code":"b"}]'), (2, "p", "held", '[{"code":"a"}]'), (3, "p", "ready", '[{"code":"a"}]'), (4, "q", "ready", None)], "id int, paper string, status string, issues string")
    got = analytics.status_and_issue_summary(df, ["paper"], "status", "issues", "held").orderBy("paper").collect()
    assert [tuple(r) for r in got] == [("p", 3, {"held": 2, "ready": 1}, {"a": 2, "b": 1}), ("q", 1, {"ready": 1}, {})]


def test_append_numbered_covers_all_orders(spark, tmp_path):
    spark.range(12).selectExpr("id % 2 AS o_custkey", "id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(QUERIES["append_numbered_all"](spark, str(tmp_path)), "o_orderkey", "number")
    assert got == [(1, 10), (2, 7), (4, 8), (5, 5), (7, 11), (8, 9), (10, 10), (11, 12)]


def test_words_of_lines_are_not_shuffled(spark):
    plan = QUERIES["layout_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_key_table_looks_for_headers_near_their_words_alone(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(layout, "stored", lambda df, name: kept.setdefault(name, stored(df, name)), raising=False)
    word = lambda line, x, text: ("d", 0, line, float(x), float(x + 5 * len(text)), 10.0 * line, text)
    words = [word(0, 0, "Key"), word(0, 100, "of"), word(1, 0, "No."), word(1, 100, "Answer"), *[word(n, x, t) for n in range(2, 30) for x, t in ((0, str(n)), (100, "C"))]]
    found = layout.key_table(spark.createDataFrame(words, "doc_id string, page int, line int, x0 double, x1 double, top double, text string"), {"number": ("No.",), "key": ("Answer",)})
    got = sorted((r["number"], r["values"]["key"]) for r in found.collect())
    assert got == [(n, "C") for n in range(2, 30)] and sorted(r["line"] for r in kept["heads"].collect()) == [0, 1]
