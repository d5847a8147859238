from pyspark.sql import functions as F

from qcorpus.sources import markdown, pages, sites

FILE = """---
exam: sample
subject: "algorithms"
---
# Question 1
What is sorted?

- A. a list
- B. a heap

**Answer:** A
**Explanation:** because
it is

# Question 2
```
- A. not an option
```
**Answer:** 4
"""


def test_markdown_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.md").write_text(FILE)
    (tmp_path / "README.md").write_text(FILE)
    (tmp_path / "bad.md").write_text("no front matter")
    got = markdown.parse_markdown(markdown.markdown_files(spark, str(tmp_path))).orderBy(F.col("number").asc_nulls_last()).collect()
    assert [(r["number"], r["answer"], r["error"]) for r in got] == [(1, "A", None), (2, "4", None), (None, None, "no front matter")]
    assert got[0]["front_matter"]["subject"] == "algorithms" and got[0]["explanation"] == "because\nit is"
    assert [tuple(o) for o in got[0]["options"]] == [("A", "a list"), ("B", "a heap")] and got[1]["options"] == []


def test_quizzes_make_nothing_up(spark):
    html = """<fieldset><legend>Pick <b>one</b></legend><label>x</label><label class="is-correct">y</label><label>x</label>
    <div class="rationale">why</div></fieldset><fieldset><legend>Lone</legend><label>z</label></fieldset>
    <fieldset><legend>None right</legend><label>p</label><label>q</label></fieldset>"""
    got = pages.parse_quizzes(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("number").collect()
    assert [(r["question_text"], r["correct_keys"], r["error"]) for r in got] == [
        ("Pick one", ["B"], None), ("Lone", [], "fewer than two options"), ("None right", [], "no correct option")]


def test_links(spark):
    html = '<a href="/a">1</a><a class="x" href="b?x=1&amp;y=2#f">2</a><a href="mailto:q">3</a><a href="//h.org/c">4</a><a href="#t">5</a>'
    got = pages.links(spark.createDataFrame([("https://e.org/dir/p", html)], "url string, html string")).collect()
    assert sorted(r["target"] for r in got) == ["https://e.org/a", "https://e.org/dir/b?x=1&y=2", "https://h.org/c"]


def test_retirement(spark):
    box = "<p>It was retired.</p><div class='note'>All were retired.</div><div id=b class='big Warning'><b>Warning</b> {}</div><div class=other>x</div>"
    cases = {
        "Course fees rise. Paper K7 has been retired since spring! Candidates sit paper K8. K7 is replaced by K8.": "Paper K7 has been retired since spring! K7 is replaced by K8.",
        "Both papers were RETIRED": "Both papers were RETIRED", "Paper K7 is going to be retired soon.": None, "Nothing changes.": None, "": None,
    }
    df = spark.createDataFrame([(box.format(t),) for t in cases] + [("<div class='forewarning'>K7 is retired.</div>",), (None,)], "t string")
    got = [r[0] for r in df.select(pages.retirement_notice(F.col("t"))).collect()]
    assert got == [*cases.values(), None, None]
    two = "<div class=warning>Soon to be retired.</div><div class=warning>K9 is retired.</div>"
    assert spark.createDataFrame([(two,)], "t string").select(pages.retirement_notice(F.col("t"))).first()[0] == "K9 is retired."


def test_allowed_urls_take_subdomains(spark):
    urls = spark.createDataFrame([("https://a.ok.org/x",), ("https://ok.org/",), ("https://notok.org/",), ("https://off.org/",)], "url string")
    sources = spark.createDataFrame([("ok.org", True), ("off.org", False)], "host string, enabled boolean")
    assert sorted(r["url"] for r in pages.allowed_urls(urls, sources).collect()) == ["https://a.ok.org/x", "https://ok.org/"]


BLOCK = """<div class="bix-div-container x"><div class=bix-td-qtxt>What is &lt;b&gt; of <b>{}</b>?</div>
<div class="bix-td-option-val">1</div><div class="bix-td-option-val">{}</div><input type=hidden class="jq-hdnakq" value="B"><div class="bix-ans-description">since {}</div></div>"""
CARD = """<div class="exam-question-card"><div class="card-header">Question #1</div><div class="question-body"><p class="card-text">Introductory Info of it</p>
<p class="card-text">Which letter comes second {}?</p><ul><li class="multi-choice-item">A. first<li class="multi-choice-item">B. second</ul><span class="correct-answer">{}</span></div></div>"""


def test_site_parsers(spark):
    cases = [
        ("https://www.blocks.org/a", BLOCK.format("x", "2", "it is") * 2 + BLOCK.format("y", "", "image") + "<div class=bix-div-container><p class=bix-td-qtxt>short</p></div>"),
        ("https://cards.org/a", CARD.format("here", "B") + CARD.format("there", "") + "<div class='exam-question-card'>no body</div>"),
        ("https://text.org/a", "<article class='entry-content'><p>1. Name the river of the town by the sea.<p>No question, only some words.</p><div class='collapse'>Answer: b</div><p>Is this a question of the page?</p></article><p>2. Outside of the content it stands.</p>"),
        ("https://else.org/a", "<div class='quiz'><p>Which of these is one?</p><ul><li>a) this</li><li>b) that</li><li>none</li></ul></div>"),
        ("https://else.org/b", "<p>Is there no quiz in here?</p><p>None.</p>"), ("https://else.org/c", None), ("https://else.org/d", "<p <b"),
    ]
    hosts = spark.createDataFrame([("blocks.org", "blocks"), ("cards.org", "cards"), ("text.org", "paragraphs")], "host string, profile string")
    found = sites.parse_sites(spark.createDataFrame(cases, "url string, html string"), hosts).orderBy("url", "number").collect()
    got = [(r["url"][8:], r["parser"], r["question_text"], [o["text"] for o in r["options"]], r["answer"], r["explanation"], r["error"]) for r in found]
    assert got == [
        ("cards.org/a", "cards", "Which letter comes second here?", ["A. first", "B. second"], "B. second", None, None),
        ("cards.org/a", "cards", "Which letter comes second there?", ["A. first", "B. second"], None, None, "no answer"),
        ("else.org/a", "any", "Which of these is one?", ["a) this", "b) that"], None, None, "no answer"),
        ("else.org/b", "any", "Is there no quiz in here?", [], None, None, "fewer than two options"),
        ("text.org/a", "paragraphs", "1. Name the river of the town by the sea.", [], "Answer: b", None, "fewer than two options"),
        ("text.org/a", "paragraphs", "Is this a question of the page?", [], None, None, "fewer than two options"),
        ("www.blocks.org/a", "blocks", "What is <b> of x ?", ["1", "2"], "B", "since it is", None),
    ]


def test_reachable_pages(spark):
    page = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [("https://e.org/list", page("/list?page=2", "/about")), ("https://e.org/list?page=2", page("list?page=3", "/list")), ("https://e.org/list?page=3", page("/gone?page=9", "list?page=2")),
            ("https://e.org/about", page("/list?page=7")), ("https://e.org/list?page=7", None)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = sites.reachable(df, spark.createDataFrame([("https://e.org/list",), ("https://e.org/no",)], "url string")).collect()
    assert sorted((r["url"][14:], r["depth"]) for r in got) == [("list", 0), ("list?page=2", 1), ("list?page=3", 2)]


def test_pages_of_a_batch_go_to_spark_together():
    import pyarrow as pa

    html = "<div class='quiz'><p>Which status has order {0}?</p><ul><li>a) F</li><li>b) O</li></ul></div>"
    columns = [[f"https://else.org/{k}" for k in range(2500)], ["default"] * 2500, [html.format(k) for k in range(2500)]]
    found = list(sites._parse(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["url", "profile", "html"])])))
    assert len(found) == 3 and [u for b in found for u in b.column("url").to_pylist()] == columns[0]


def test_plain_pages_have_the_same_tree():
    def whole(html):
        tree = sites._Tree()
        tree.feed(html)
        tree.close()
        return tree.open[0]

    for html in ("", "a > b", "<P>x<p ID='1'>y</p >z<br>", "<div class='a b'><li>1<li>2</div>tail</div>", "<img src=\"x\" alt=''><a href='u?x=1'>t</a>"):
        assert sites._plain_tree(html) == whole(html) == sites.page_tree(html)
    for html in ("&amp;", "<b/>", "<!-- c -->", "<script>1</script>", "<p a>", "<3", "<p id=1>"):
        assert sites._plain_tree(html) is None and sites.page_tree(html) == whole(html)
