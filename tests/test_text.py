import unicodedata

import pytest
from pyspark.sql import functions as F

from qcorpus.functions import answers
from qcorpus.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def plain_hash(text):
    h = 5381
    for c in text:
        h = ((h << 5) + h ^ ord(c)) & 0xFFFFFFFF
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits or "0"


CASES = {
    "What is   2 + 2?": "what is 2  2",
    "It — which": "it  which",
    "CafÉ": "café",
    "Café": "café",
    "മലയാളം": "മലയാളം",
    "?!": "",
    "": "",
    " x y\x85": "x y",
}


@pytest.mark.parametrize("raw", CASES)
def test_normalize_and_hash(spark, raw):
    assert one(spark, tx.normalize_text(F.col("t")), t=raw) == CASES[raw]
    assert one(spark, tx.content_hash(tx.normalize_text(F.col("t"))), t=raw) == plain_hash(unicodedata.normalize("NFC", CASES[raw]))


def test_null_stays_null(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t=None) is None


def test_trigrams(spark):
    assert one(spark, tx.trigrams(F.col("t")), t="Word two") == ["  w", " wo", "wor", "ord", "rd ", "  t", " tw", "two", "wo "]


def test_edit_similarity_counts_code_points(spark):
    got = one(spark, tx.edit_similarity(F.col("a"), F.col("b")), a="café", b="cafe")
    assert got == pytest.approx(0.75)
    assert one(spark, tx.edit_similarity(F.col("a"), F.col("b")), a="", b="") == 1.0


@pytest.mark.parametrize("raw,kept", [("3 of two 4", ["3", "two", "4"]), ("first of three types twice", ["first", "three", "twice"]), ("none", [])])
def test_numbers(spark, raw, kept):
    assert one(spark, tx.numbers_in(F.col("t")), t=raw) == kept


@pytest.mark.parametrize("url,host", [("https://www.A.example.com/x?y#z", "a.example.com"), ("not a url", None)])
def test_host(spark, url, host):
    assert one(spark, tx.host(F.col("t")), t=url) == host


def test_boilerplate_goes(spark):
    cases = {"Rationale:\nExtracted directly from X Learn today.": None, "A  \n extracted directly from x learn: y\n\n\nB": "A\n\nB", "Extracted directly from X Learned": "Extracted directly from X Learned", None: None, "": None}
    for raw, left in cases.items():
        assert one(spark, tx.strip_boilerplate(F.col("t"), ("Extracted directly from X Learn",)), t=raw) == left


def test_hashes_of_many_texts(spark):
    texts = ["", "a", "\u00e9\u4e2d\U0001f600", "x" * 5000, *["t" * n for n in range(100)]]
    assert tx._hashes(texts) == [plain_hash(t) for t in texts]


def test_shapes(spark):
    df = spark.createDataFrame([(["B", "a ", "e\u0301!", "\u00e9"], ["B"], [(4.24, 4.26)], "4 ")], "o array<string>, c array<string>, r array<struct<lo:double,hi:double>>, t string")
    no_range = F.array().cast("array<struct<lo:double,hi:double>>")
    row = df.select(answers.option_set(F.col("o")), *[answers.correct_set(F.lit(k), F.col("c"), r, F.col("t")) for k, r in (
        ("mcq", F.col("r")), ("multiple_correct", F.col("r")), ("numerical", F.col("r")), ("numerical", no_range), ("text", F.col("r")), ("other", F.col("r")))]).first()
    assert list(row) == [["a", "b", "\u00e9"], ["b"], ["b"], ["4.24..4.26"], ["4"], ["4"], []]
    assert df.select(answers.option_set(F.array().cast("array<string>"))).first()[0] == []


def test_shapes_of_published_questions(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    options = spark.createDataFrame([(10, 1, "A!"), (11, 1, "b"), (12, 1, "B ")], "id int, question_id int, option_text string")
    rows = [(1, 11, None, None, None, None), (2, None, None, None, 1.0, 2.0), (2, None, "x", 3.0, None, None), (3, None, None, 3.5, None, 9.0)]
    kind = "question_id int, correct_option_id int, text_answer string, numerical_answer double, numeric_min double, numeric_max double"
    got = answers.published_shape(questions, options, spark.createDataFrame(rows, kind)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(["a", "b"], ["b"]), ([], ["1.0..2.0", "x"]), ([], ["35"])]


def test_key_list(spark):
    got = spark.createDataFrame([([],), (["A"],), (["A", "B"],), (["A", "B", "D"],)], "k array<string>").select(tx.key_list(F.col("k"))).collect()
    assert [r[0] for r in got] == ["", "A", "A and B", "A, B and D"]


@pytest.mark.parametrize("raw,value", [("3,5", 3.5), ("3.5", 3.5), (" -2 ", -2.0), ("1,2.3", None), ("x", None), (".5", 0.5)])
def test_parse_number(spark, raw, value):
    assert one(spark, answers.parse_number(F.col("t")), t=raw) == value


def test_grade_numeric(spark):
    rows = spark.createDataFrame(
        [("2,0", [(1.0, 2.0)], None), ("2.1", [(1.0, 2.0)], None), ("4.50", [], "4.5"), ("four", [], "four"), (None, [], "4")],
        "raw string, ranges array<struct<lo:double,hi:double>>, text string",
    )
    assert [r[0] for r in rows.select(answers.grade_numeric(F.col("raw"), F.col("ranges"), F.col("text"))).collect()] == [True, False, True, True, False]


def test_grade_selection_needs_the_exact_set(spark):
    rows = spark.createDataFrame([(["A", "B", "A"], ["B", "A"]), (["A"], ["A", "B"]), ([], []), (None, ["A"])], "s array<string>, c array<string>")
    assert [r[0] for r in rows.select(answers.grade_selection(F.col("s"), F.col("c"))).collect()] == [True, False, False, False]
