import pytest
from pyspark.sql import functions as F

from qcorpus.functions import richtext
from qcorpus.operators import catalog, publish, review
from qcorpus.streaming import events


@pytest.mark.parametrize("raw,shown", [
    ("a*b_c <d> [e]", r"a\*b\_c \<d> \[e\]"), ("$5 ~x~ & | a@b", r"\$5 \~x\~ \& \| a\@b"), ("# head", r"\# head"), ("#tag", "#tag"), ("> q", r"\> q"),
    ("1. one", r"1\. one"), ("12) y", r"12\) y"), ("1.", "1."), ("- item", r"\- item"), ("-item", "-item"), ("3.5", "3.5"), ("", ""),
    ("    code", "&#32;   code"), ("\tx", "&#32;x"), ("---", r"\---"), ("  ==- ", r"  \==- "), ("see http://x www.y.z FTP://u awww.x", r"see http\://x www\.y.z FTP\://u awww.x"),
    ("```\n# kept *as is*\n```\n# not", "```\n# kept *as is*\n```\n\\# not"), ("~~~ py\na*b\n```\n~~~~\n*", "~~~ py\na*b\n```\n~~~~\n\\*"),
    ("    ```\n*", "&#32;   \\`\\`\\`\n\\*"),
])
def test_markdown_escape(raw, shown):
    assert richtext.escape_markdown_text(raw) == shown


def test_markdown_with_formulas(spark):
    rows = ["a*\ufdd0x^2\ufdd1 \ufdd0y*\ufdd1", "plain*", "a\ufdd0b", "a\ufdd1b\ufdd0c\ufdd1", "```\n\ufdd0b\ufdd1\n```", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(richtext.escape_markdown(F.col("t"), formulas=True)).collect()] == ["a\\*$x^2$ $y*$", "plain\\*", None, None, None, None]


def test_safe_html(spark):
    df = spark.createDataFrame([("<b> & https://e.org/x?a=1\n'q'",)], "t string")
    assert df.select(richtext.safe_html(F.col("t"))).first()[0] == (
        '&lt;b&gt; &amp; <a href="https://e.org/x?a=1" rel="nofollow noopener">https://e.org/x?a=1</a><br>&#39;q&#39;')


def test_reading_links(spark):
    links = [("Doc", "https://a.org/1"), ("Again", "https://a.org/1"), (" ", "https://b.org"), ("Bad", "javascript:x"), ("Named", "https://c.org")]
    df = spark.createDataFrame([("See https://c.org", links), (None, [])], "e string, l array<struct<text:string,url:string>>")
    got = [r[0] for r in df.select(richtext.with_reading_links(F.col("e"), F.col("l"))).collect()]
    assert got == ["See https://c.org\n\nFurther reading:\n- [Doc](https://a.org/1)\n- [https://b.org](https://b.org)", None]


def test_menu_links(spark):
    urls = ["https://learn.x.org/en-us/", "https://learn.x.org/en-us/training", "https://learn.x.org/en-us/training/deep", "https://y.org/", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(richtext.is_menu_link(F.col("u"), "x.org", ("training",))).collect()] == [True, True, False, False, False]


def test_data_uri(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("https://x",)], "u string")
    got = [r[0] for r in df.select(richtext.data_uri(F.col("u"))).collect()]
    assert got[0]["mime"] == "image/png" and bytes(got[0]["content"]) == b"hi" and got[1] is None


@pytest.mark.parametrize("old,new,removed,added", [
    ("What's the right role for all?", "What's the right level for all?", ["role"], ["level"]), ("What are the two types?", "What are the three types?", ["two"], ["three"]),
    ("What is the best reason?", "What's the single best reason?", ["What", "is"], ["What's", "single"]), ("Which one would you", "which one (would) you?", [], []), ("", "a  b", [], ["a", "b"]),
])
def test_word_difference(old, new, removed, added):
    got = richtext.word_difference(old, new)
    words = lambda side, kind: [d["text"] for d in got[side] if d["kind"] == kind]
    assert (words("existing", "removed"), words("candidate", "added")) == (removed, added)
    assert "".join(d["text"] for d in got["existing"]) == old and "".join(d["text"] for d in got["candidate"]) == new


def test_common_subsequence_equals_the_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        n, m = len(a), len(b)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        want, i, j = [], 0, 0
        while i < n and j < m:
            if a[i] == b[j]:
                want.append((i, j))
            step = (1, 1) if a[i] == b[j] else (1, 0) if best[i + 1][j] >= best[i][j + 1] else (0, 1)
            i, j = i + step[0], j + step[1]
        assert richtext._matches(a, b) == want


def test_line_diff(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), (None, ""), (None, "x"), ("a\nb\nc\nd", "b\nc\ne\nd\nf")], "o string, n string")
    got = [[tuple(h) for h in r[0]] for r in df.select(richtext.line_diff(F.col("o"), F.col("n"))).collect()]
    assert got == [[(2, 2, ["b"], ["c"])], [], [(1, 1, [], ["x"])], [(1, 1, ["a"], []), (4, 3, [], ["e"]), (5, 5, [], ["f"])]]


def test_position_decisions(spark):
    schema = "p int, norm string, options array<string>, answers array<string>"
    old = spark.createDataFrame([(1, "x", ["a"], ["a"]), (2, "x", ["a"], ["a"]), (3, "x", ["a"], ["a"])], schema)
    new = spark.createDataFrame([(1, "x", ["a"], ["a"]), (2, "x", ["b"], ["a"]), (3, "y", ["a"], ["a"]), (4, "z", [], [])], schema)
    got = review.position_decision(new, old, ["p"]).orderBy("p").collect()
    assert [r["decision"] for r in got] == ["same", "same_new", "different", "free"]


def test_quality_codes(spark):
    schema = (
        "question_text string, question_type string, options array<struct<key:string,text:string>>, correct_keys array<string>, answer_text string, "
        "answer_status string, explanation string, needs_review boolean, media array<struct<placement:string,option_key:string>>, exam_slug string, stable_id string, number int"
    )
    ab = [("A", "x"), ("B", "y")]
    rows = [
        ("t", "mcq", ab, ["A"], None, "scored", "e", False, [], "ok", "s1", 1), (None, "mcq", ab[:1], ["Z"], None, "scored", None, None, None, "no", "s2", None),
        ("t FLAG FOR HUMAN REVIEW", "text", [], None, "4", "scored", "e", False, [("stem", "A")], "ok", "s1", 2), ("t", "mcq", [("A", "x"), ("A", "y")], [], None, "scored", "e", False, [("option", "Q")], "ok", "s3", None),
        ("t", "mcq", ab, [], None, "cancelled", "e", False, None, "ok", "s4", None),
    ]
    exams = spark.createDataFrame([("ok",)], "slug string")
    got = {r["stable_id"] + str(r["number"]): ([i["code"] for i in r["issues"]], r["valid"]) for r in publish.quality_issues(spark.createDataFrame(rows, schema), exams, ["number"]).collect()}
    assert got == {
        "s11": ([], True), "s2None": (["MISSING_QUESTION_TEXT", "MCQ_MISSING_OPTIONS", "INVALID_ANSWER_KEY", "MISSING_EXPLANATION", "EXAM_NOT_REGISTERED"], False),
        "s12": (["MEDIA_OPTION_KEY_MISPLACED", "NEEDS_REVIEW", "DUPLICATE_STABLE_CONTENT_ID"], False),
        "s3None": (["DUPLICATE_OPTION_KEYS", "MISSING_ANSWER", "MEDIA_OPTION_NOT_FOUND"], False), "s4None": ([], True),
    }


def test_answer_rows(spark):
    rows = [(1, "mcq", ["A"], None, None), (2, "numerical", None, None, [(1.0, 2.0), (5.0, 5.0)]), (3, "text", None, "four", None)]
    df = spark.createDataFrame(rows, "id int, type string, correct_keys array<string>, answer_text string, ranges array<struct<lo:double,hi:double>>")
    got = sorted((r["id"], r["option_key"], r["text_answer"], r["numeric_min"], r["range_group"]) for r in publish.answer_rows(df).collect())
    assert got == [(1, "A", None, None, None), (2, None, None, 1.0, 0), (2, None, None, 5.0, 1), (3, None, "four", None, None)]


def test_occurrences_change_only_where_facts_differ(spark):
    schema = "question_id int, question_set_id string, marks decimal(5,2), negative_marks decimal(5,2), answer_status string, number int"
    stored = spark.createDataFrame([], schema)
    new = spark.createDataFrame([(1, "s", 1.004, None, "scored", None), (2, "s", 2.0, 0.666, "scored", 7)], "question_id int, question_set_id string, marks double, negative_marks double, answer_status string, number int")
    once = publish.upsert_occurrences(stored, new)
    rows = lambda df: sorted((r["question_id"], float(r["marks"]), r["number"]) for r in df.collect())
    assert rows(once) == [(1, 1.0, 1), (2, 2.0, 7)] and rows(publish.upsert_occurrences(once, new)) == rows(once)


def test_occurrences_keep_marks_of_many_digits(spark):
    kind = "question_id int, question_set_id string, marks {0}, negative_marks {0}, answer_status string, number int"
    stored = spark.createDataFrame([], kind.format("decimal(5,2)"))
    new = spark.createDataFrame([(1, "s", 999.996, 1e9, "scored", None), (2, "s", 1000.0, None, "scored", None)], kind.format("double"))
    once = publish.upsert_occurrences(stored, new)
    facts = lambda df: sorted((r["question_id"], float(r["marks"]), float(r["negative_marks"] or 0), r["number"]) for r in df.collect())
    assert facts(once) == [(1, 1000.0, 1e9, 1), (2, 1000.0, 0.0, 2)] and facts(publish.upsert_occurrences(once, new)) == facts(once)


def test_batches(spark):
    actions = spark.createDataFrame([("a", "created"), ("a", "held"), ("b", "linked"), ("b", "rejected"), ("c", "rejected")], "batch string, action string")
    assert {r["batch"]: r["status"] for r in publish.batch_status(actions, "batch").collect()} == {"a": "needs_decisions", "b": "approved", "c": "not_approved"}


def test_sitemap_files(spark):
    entries = spark.createDataFrame([("https://e.org/?a&b", "2024-01-01T00:00:00Z")], "loc string, lastmod string")
    xml = catalog.sitemap_xml(entries).first()["xml"]
    assert "<url><loc>https://e.org/?a&amp;b</loc><lastmod>2024-01-01T00:00:00Z</lastmod></url>" in xml


def test_streamed_counts(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:0{m}:00", "view") for h in range(3) for m in range(2)]
    spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    query = events.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert [r["n"] for r in spark.table("counts").collect()] == [2, 2, 2]


def test_batch_merge_is_the_same_when_delivered_twice(spark, tmp_path):
    from qcorpus.operators.merge import merge_upsert

    write = events.upsert_into(str(tmp_path / "t"), lambda old, new: merge_upsert(old, new, ["k"]))
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")]))
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/v=1").collect()) == [(1, "b"), (2, "c")]


def test_word_counts_are_those_of_the_tokens_and_hold_none(spark, tmp_path):
    from qcorpus.queries import QUERIES

    said = ["What is  the\nname?", "What was the \n\n name of it?", None, "", "name", "WHAT is, (the) name"]
    turns = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "conv_id long, turn long, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["word_diff_turns"](spark, str(tmp_path))
    want = []
    for k in range(1, len(said)):
        if said[k - 1] is not None:
            d = richtext.word_difference(said[k - 1], said[k] or "")
            n = lambda side, kind: sum(t["kind"] == kind and t["text"].strip(" ") != "" for t in d[side])  # noqa: E731, B023
            want.append((1, k, n("existing", "same"), n("existing", "removed"), n("candidate", "added")))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "candidate" not in found._jdf.queryExecution().executedPlan().toString()
