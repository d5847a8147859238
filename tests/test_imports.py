"""Settings files, import reports, text styles, pages, kept indexes, search ranks and grids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from qcorpus.functions import stemming
from qcorpus.functions.settings import SettingsError, read_settings
from qcorpus.functions.text import font_family, plain_forms
from qcorpus.operators import analytics, catalog, gramindex, layout, merge, search
from qcorpus.sources import definitions, markdown


@pytest.mark.parametrize("text,value", [
    ("", None), ("# only a comment", None), ("a: 1", {"a": 1}), ("a:\n  b:\n    - x\n    - y: 2\n      z: 'it''s'\n  c: [1, {d: \"q, r\"}, []]", {"a": {"b": ["x", {"y": 2, "z": "it's"}], "c": [1, {"d": "q, r"}, []]}}),
    ("- a\n-\n  b: 1\n- - c", ["a", {"b": 1}, "- c"]), ("u: http://x.org/a:b # c\nt: 10:30\ne: ~\nf: false\ng: -1.5e3", {"u": "http://x.org/a:b", "t": "10:30", "e": None, "f": False, "g": -1500.0}),
    ("a: |\n  one\n    two\n\nb: >-\n  x\n  y", {"a": "one\n  two\n", "b": "x y"}), ("list:\n- a\n- b\nrest: 1", {"list": ["a", "b"], "rest": 1}), ("\"k: 1\": v", {"k: 1": "v"}),
])
def test_settings(text, value):
    assert read_settings(text) == value


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: 1\n  b: 2", "a: [1, 2", "a: &x 1", "a: 1\nnot a pair", "a:\n\t- b", "a: \"open"])
def test_settings_that_are_not_read_are_errors(text):
    with pytest.raises(SettingsError):
        read_settings(text)


def test_definition_files(spark, tmp_path):
    for name, text in (("a", "name: one\nlimits:\n  rate: 3"), ("b", "sources:\n  - name: two\n  - {name: three, rate: 4}"), ("c", "name: [open"), ("d", "# nothing")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "source.yaml").write_text(text)
        (tmp_path / name / "other.yaml").write_text("name: no")
    files = definitions.definition_files(spark, f"file://{tmp_path}")
    assert sorted((r["path"].split("/")[-2], r["error"] is not None) for r in files.collect()) == [("a", False), ("b", False), ("c", True), ("d", False)]
    got = definitions.definitions(files, "name string, rate bigint, limits struct<rate:bigint>").where("name is not null").collect()
    assert sorted((r["name"], r["rate"], r["limits"] and r["limits"]["rate"]) for r in got) == [("one", None, 3), ("three", 4, None), ("two", None, None)]


def test_front_matter_with_maps_and_lists():
    found = markdown.file_questions("p", "---\nexam: 'a: b'\ntags: [x, y]\nnested:\n  k: 1\n---\n# Question 1\ntext\n")
    assert dict(found[0]["front_matter"]) == {"exam": "a: b", "tags": '["x", "y"]', "nested": '{"k": 1}'}
    assert markdown.file_questions("p", "---\na: [1\n---\n# Question 1\nt\n")[0]["error"].startswith("front matter")


ITEM = "paper string, codes array<string>, rules array<string>, outcome string, reasons array<string>, issues_after array<string>, math_runs boolean"


def test_import_report_must_add_up(spark):
    rows = [("p", ["math", "figure", "math"], ["glyph"], "recovered", [], [], True), ("p", ["math"], ["glyph"], "still_held", ["deep", "deep"], ["math"], True), ("p", [], [], "kept", ["code"], [], True), ("p", None, None, None, None, None, None)]
    got = analytics.import_report(spark.createDataFrame(rows, ITEM), ["paper"]).first().asDict()
    assert {k: got[k] for k in ("questions", "ready", "held", "flagged", "flagged_math_only", "recovered", "recovered_now_ready", "still_held", "clean_with_math_runs", "kept")} == {
        "questions": 4, "ready": 2, "held": 2, "flagged": 2, "flagged_math_only": 1, "recovered": 1, "recovered_now_ready": 1, "still_held": 1, "clean_with_math_runs": 1, "kept": 1}
    assert got["held_by_issues"] == {"figure+math": 1, "math": 1} and got["still_held_by_reason"] == {"deep": 1} and got["kept_by_reason"] == {"code": 1} and got["by_detector_rule"] == {"glyph": 2}
    assert analytics.import_report(spark.createDataFrame([], ITEM), ["paper"]).count() == 0
    with pytest.raises(Exception, match="recovered \\+ still_held"):
        analytics.import_report(spark.createDataFrame([("p", ["math"], ["glyph"], "lost", [], [], True)], ITEM), ["paper"]).collect()


def test_observed_counts_reconcile(spark):
    df, seen = analytics.observed(spark.range(10), "import", total=F.count("*"), even=F.count_if(F.col("id") % 2 == 0), odd=F.count_if(F.col("id") % 2 == 1))
    df.write.format("noop").mode("overwrite").save()
    assert analytics.reconcile(seen, "total", "even", "odd") == {"total": 10, "even": 5, "odd": 5}
    with pytest.raises(ValueError, match="add up"):
        analytics.reconcile(seen, "total", "even")


def test_text_styles(spark):
    row = spark.createDataFrame([("ﬁ Ａ① \U0001d465²", "BCDGEE+Cambria Math"), (None, None), ("plain", "Courier New")], "t string, f string")
    assert [tuple(r) for r in row.select(plain_forms(F.col("t")), font_family(F.col("f"))).collect()] == [("fi A1 x2", "cambriamath"), (None, ""), ("plain", "couriernew")]
    words = [(1, 0, 0, 1.0, "x", "Courier", False), (1, 0, 0, 2.0, "y", "Times", False), (1, 0, 1, 1.0, "a", "Consolas", False), (1, 0, 1, 2.0, "b", "Mono", False), (1, 0, 1, 3.0, "c", None, None), (1, 0, 2, 1.0, "m", "Mono", True)]
    got = layout.code_lines(spark.createDataFrame(words, "doc_id int, page int, line int, x0 double, text string, font string, math boolean")).orderBy("line").collect()
    assert [(r["text"], r["code"]) for r in got] == [("x y", False), ("a b c", True), ("m", False)]


def test_pages_without_questions_have_empty_lists(spark):
    exams = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, name string")
    docs = catalog.question_documents(
        spark.createDataFrame([(1, "q", "t")], "id int, slug string, text string"), spark.createDataFrame([(10, 1, 2, "B", "y"), (11, 1, 1, "A", "x")], "id int, question_id int, sequence int, option_key string, option_text string"),
        spark.createDataFrame([(1, 10), (1, 11), (1, None)], "question_id int, correct_option_id int"), spark.createDataFrame([(1, 1, "i2"), (1, 0, "i1")], "question_id int, position int, storage_key string"))
    occurrences = spark.createDataFrame([("a", 1, "s", "m", 2020), ("a", 1, "t", None, 2024), ("a", 9, "t", "m", 2024)], "slug string, question_id int, question_set string, subject string, year int")
    import json

    got = {r["slug"]: json.loads(r["document"]) for r in catalog.browse_documents(exams, occurrences, docs).collect()}
    assert got["b"] == {"slug": "b", "name": "B", "question_count": 0, "subjects": [], "sets": [], "questions": []}
    assert [q["set"] for q in got["a"]["questions"]] == ["t", "s"] and got["a"]["subjects"] == [{"slug": "m", "count": 1}]
    assert got["a"]["questions"][0]["question"] == {"id": 1, "slug": "q", "text": "t", "options": [{"key": "A", "text": "x"}, {"key": "B", "text": "y"}], "correct": ["A", "B"], "images": ["i1", "i2"]}


def test_ranks_of_a_large_group(spark):
    rows = [("g" if i % 10 else None, i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = merge.ranked(df, ["g"], ["k"], "rank").collect()
    for g in ("g", None):
        own = sorted((r["k"], r["rank"]) for r in got if r["g"] == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1)) and len(own) == sum(x[0] == g for x in rows)


# layout


def test_grid_finds_each_overlap_once(spark):
    rng = random.Random(2)
    box = lambda: (lambda x, y: (x, x + rng.choice([0.0, 3.0, 80.0, 400.0]), y, y + rng.choice([0.5, 10.0, 300.0])))(rng.uniform(-50, 500), rng.uniform(-50, 700))
    boxes = [(1, p, i, *box()) for p in (0, 1) for i in range(60)]
    regions = [(1, p, i, *box()) for p in (0, 1) for i in range(40)]
    names = "x0 double, x1 double, top double, bottom double"
    got = layout.overlapping(spark.createDataFrame(boxes, f"doc_id int, page int, box int, {names}"), spark.createDataFrame(regions, f"doc_id int, page int, region int, {names}"), side=50.0).collect()
    want = sorted((p, i, j) for _, p, i, a, b, c, d in boxes for _, q, j, e, f, g, h in regions if p == q and a < f and b > e and c < h and d > g)
    assert sorted((r["page"], r["box"], r["region"]) for r in got) == want and want


def test_lines_above_a_label_lead_into_it(spark):
    #       page line top bottom text
    lines = [(0, 0, 0.0, 8.0, "cover"), (0, 1, 10.0, 30.0, "tall"), (0, 2, 20.0, 28.0, "Q1 first"), (0, 3, 30.0, 38.0, "body"), (0, 4, 40.0, 55.0, "next one's figure"), (0, 5, 41.0, 46.0, "clear of it"),
             (0, 6, 44.0, 52.0, "leads"), (0, 7, 50.0, 58.0, "Q2 second"), (1, 0, 0.0, 90.0, "tall on another page"), (1, 1, 60.0, 68.0, "Q3 third")]
    df = spark.createDataFrame([(7, *x, 0.0, 9.0) for x in lines], "doc_id int, page int, line int, top double, bottom double, text string, x0 double, x1 double")
    labels = lambda tolerance: [r["label"] for r in layout.segment(df, r"^Q(\d+)", lead_tolerance=tolerance).orderBy("page", "line").collect()]
    assert labels(0.0) == [None, 1, 1, 1, 1, 1, 2, 2, 3, 3]
    assert labels(5.0) == [None, 1, 1, 1, 2, 2, 2, 2, 3, 3]


# search


def test_stems():
    pairs = "consignment consign consolatory consolatori generously generous communities communiti hopping hop hoping hope flies fli dies die cries cri relational relat conditional condit skies sky dying die news news inning inning proceed proceed happy happi enjoy enjoy knightly knight kneeled kneel licensing licens abilities abil"
    words = pairs.split()
    assert [(w, stemming.stem_word(w)) for w in words[::2]] == list(zip(words[::2], words[1::2]))
    assert stemming.lexeme("h2o") == "h2o" and stemming.lexeme("größen") == "größen" and len(stemming.STOP_WORDS) == 127


def plain_rank(places):
    if len(places) == 1:
        ws = [w for _, w in places[0]]
        most = max(ws)
        at = ws.index(most)
        return (most + sum(w / (i + 1) ** 2 for i, w in enumerate(ws)) - most / (at + 1) ** 2) / 1.64493406685
    left = 1.0
    for i, p in enumerate(places):
        for q in places[:i]:
            for a, v in p:
                for b, w in q:
                    if a != b:
                        d = abs(a - b)
                        left *= 1 - math.sqrt(v * w * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
    return 1 - left


def test_search_index_grows_and_is_found_again(spark, tmp_path):
    docs = [(1, "Running wolves", "the wolf runs " * 3 + "home"), (2, "The of", "wolf and runner"), (3, None, "wolves " * 5 + "x " * 150 + "run"), (4, "home", None), (5, "", "run wolf")]
    df = spark.createDataFrame(docs, "id long, title string, body string")
    asked = spark.createDataFrame([("running wolf",), ("homes",), ("the",), ("",)], "query string")
    index = search.SearchIndex(spark, f"file://{tmp_path}/words", buckets=4, segments=2).add(df.where("id <= 3"), "id", ["title", "body"])
    index.add(df.where("id > 3"), "id", ["title", "body"])
    got = [tuple(r) for r in index.search(asked).orderBy("query", "place").collect()]

    def places(doc):
        out, after = {}, 0
        for text, weight in zip(doc[1:], (1.0, 0.4)):
            own = [(i + 1 + after, w) for i, w in enumerate((text or "").lower().split()) if w not in stemming.STOP_WORDS]
            for at, w in own:
                out.setdefault(stemming.lexeme(w), []).append((at, weight))
            after = own[-1][0] if own else after
        return out

    want = []
    for q, words in (("homes", ["home"]), ("running wolf", ["run", "wolf"])):
        hits = [(round(plain_rank([p[w] for w in words]), 6), d[0]) for d in docs if all(w in (p := places(d)) for w in words)]
        want += [(q, i, s, n) for n, (s, i) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1])), 1)]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))
    assert sorted(map(tuple, search.scan(df, "id", ["title", "body"], search.WEIGHTS, asked).collect())) == sorted(got)
    spark.sql(f"DROP TABLE {index.rows.name}")  # as in a new session
    again = search.SearchIndex(spark, f"file://{tmp_path}/words", buckets=4, segments=2).open()
    assert sorted(map(tuple, again.search(asked).collect())) == sorted(got)


def test_clicks_are_remembered_for_their_user(spark):
    log = spark.createDataFrame([(1, 7, "q", None), (2, None, "r", None), (3, 8, "s", 5)], "id long, user_id long, query string, clicked_id long")
    clicks = spark.createDataFrame([(1, 7, 50, 1), (1, 7, 51, 2), (1, 9, 52, 3), (2, None, 53, 1), (4, 7, 54, 1)], "log_id long, user_id long, result_id long, at long")
    assert sorted(tuple(r) for r in search.clicked(log, clicks).collect()) == [(1, 7, "q", 51), (2, None, "r", 53), (3, 8, "s", 5)]


def test_gram_index_grows_and_is_found_again(spark, tmp_path):
    rng = random.Random(4)
    words = ["river", "mountain", "valley", "rivers", "mount", "vale", "sea", "seaside"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), i % 3 == 0) for i in range(80)] + [(80, None, False), (81, "", False), (82, "zzz qqq", True)]
    df = spark.createDataFrame(rows, "owner long, text string, variant boolean")
    index = gramindex.TrigramIndex(spark, f"file://{tmp_path}/grams", 4).build(df.where("owner < 50"))
    index.insert(df.where("owner >= 40"))  # some are there already
    index.insert(df)
    probes = df.where("owner % 5 = 0 or owner = 82").select(F.col("owner").alias("id"), "text")

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = set()
    for p, t, _ in rows:
        if (p % 5 == 0 or p == 82) and t:
            hits = []
            for o, u, v in rows:
                if u and min(len(t), len(u)) >= max(len(t), len(u)) * 0.9 * 0.85:
                    s = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
                    if s >= 0.3:
                        hits.append((-s, o, v))
            want |= {(p, o, v) for _, o, v in sorted(hits)[:5]}
    got = {(r["a"], r["owner"], r["variant"]) for r in index.top(probes, 0.9, 5).collect()}
    assert got == want
    for name in ("texts", "owners", "postings", "order"):
        spark.sql(f"DROP TABLE {index._part(name).name}")
    assert {(r["a"], r["owner"], r["variant"]) for r in gramindex.TrigramIndex(spark, f"file://{tmp_path}/grams", 4).open().top(probes, 0.9, 5).collect()} == want
