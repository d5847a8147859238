"""Publishing in rounds against publishing one question after another."""

import random

from pyspark.sql import functions as F
from test_pieces import alike, grams

from qcorpus.operators import waves

INCOMING = (
    "id long, batch string, position int, text string, options array<string>, answers array<string>, stable_id string, question_set string, number int, "
    "marks double, negative_marks double, answer_status string, media array<struct<storage_key:string,position:int>>, valid boolean"
)


def empty_store(spark, questions=(), variants=(), occurrences=(), media=()):
    return waves.Store(
        spark.createDataFrame(list(questions), "id long, stable_id string, text string, options array<string>, answers array<string>"),
        spark.createDataFrame(list(variants), "question_id long, text string"),
        spark.createDataFrame(list(occurrences), "question_id long, question_set_id string, number int, marks decimal(5,2), negative_marks decimal(5,2), answer_status string"),
        spark.createDataFrame(list(media), "question_id long, storage_key string, position int"),
    )


def norm(text):
    return " ".join("".join(c for c in " ".join(text.lower().split()) if c.isalnum() or c == " ").strip().split(" ")) if text is not None else None


def one_by_one(rows, questions, variants, occurrences, media, threshold=0.9):
    """What the rounds must come to: each question is checked against all that stands when its turn comes."""
    standing = [(q[0], norm(q[2]), q[3], q[4], q[1], 0) for q in questions]
    shapes = {q[0]: (q[3], q[4]) for q in questions}
    standing += [(v[0], norm(v[1]), *shapes[v[0]], None, 0) for v in variants]
    have, seen, keys, out = {(o[0], o[1]) for o in occurrences}, {(m[0], m[1]) for m in media}, [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        i, batch, _, text, options, answers, sid, own_set, *_ , images, valid = r
        n = norm(text)
        if not valid or n is None:
            out[i] = ("rejected", "invalid", None, False)
            continue
        exact = [e for e in standing if e[1] == n]
        same = [e for e in exact if (e[2], e[3]) == (options, answers)]
        near = [e for e in standing if e[1] != n and alike(n, e[1]) >= threshold and len(grams(n) & grams(e[1])) >= 0.3 * len(grams(n) | grams(e[1])) > 0]
        held = [e for e in standing if e[4] is not None and e[4] == sid]
        if same:
            out[i] = ("linked", "same", min(same, key=lambda e: (e[5], e[0]))[0])
        elif exact:
            out[i] = ("held", "conflicting", min(exact, key=lambda e: (e[5], e[0]))[0], False)
            continue
        elif near:
            g = grams(n)
            best = min(near, key=lambda e: (-alike(n, e[1]), -len(g & grams(e[1])) / len(g | grams(e[1])), e[0]))
            out[i] = ("held", "near", best[0], False)
            continue
        elif held:
            out[i] = ("held", "position", min(e[0] for e in held), False)
            continue
        else:
            out[i] = ("created", "unique", i)
            standing.append((i, n, options, answers, sid, 1))
        question = out[i][2]
        out[i] = (*out[i], (question, own_set) not in have)
        have.add((question, own_set))
        seen |= {(question, m[0]) for m in images or []}
    return out, have, seen


def test_rounds_equal_one_by_one(spark):
    rng = random.Random(11)
    base = [f"what is the {w} of the {v} in question number {k}" for k, (w, v) in enumerate([("sum", "angles"), ("mass", "moon"), ("name", "river"), ("speed", "sound")])]
    chain = "a chain of words that changes a little at each step of the way"
    texts = base + [b.upper() + "?" for b in base] + [b.replace("the", "teh", 1) for b in base] + [chain[:k] + "x" * k + chain[k:] for k in range(9)]
    rows = []
    for i in range(150):
        text = rng.choice([*texts, None, f"unlike {i} {rng.random()}"])
        shape = rng.choice([["a", "b"], ["a", "c"]]), rng.choice([["a"], ["b"]])
        media = rng.choice([None, [], [(f"k{i % 5}", 0)], [("k1", 0), ("k2", 1)]])
        rows.append((1000 + i, f"b{rng.randrange(5)}", rng.randrange(30), text, *shape, rng.choice([None, f"s{rng.randrange(60)}"]), f"set{rng.randrange(3)}", i, 1.0, 0.25, "scored", media, rng.random() > 0.1))
    questions = [(1, "s1", base[0], ["a", "b"], ["a"]), (2, "s2", "another stored question of some length", ["x"], ["x"])]
    variants, occurrences, media = [(2, base[1] + " please")], [(1, "set0", 1, None, None, "scored")], [(1, "k1", 0)]
    store = empty_store(spark, questions, variants, occurrences, media)
    report, after = waves.publish_in_order(spark.createDataFrame(rows, INCOMING), store)
    got = {r["id"]: (r["action"], r["outcome"], r["question"], r["added"]) for r in report.collect()}
    want, have, seen = one_by_one(rows, questions, variants, occurrences, media)
    assert got == want and len(got) == 150 and {a for a, *_ in got.values()} == {"created", "linked", "held", "rejected"}
    assert {(r["question_id"], r["question_set_id"]) for r in after.occurrences.collect()} == have
    assert {(r["question_id"], r["storage_key"]) for r in after.media.collect()} == seen
    assert sorted(r["id"] for r in after.questions.collect()) == sorted([1, 2, *(i for i, a in got.items() if a[0] == "created")])
    # publishing again creates nothing and adds nothing
    again, _ = waves.publish_in_order(spark.createDataFrame(rows, INCOMING), after)
    repeat = {r["id"]: (r["action"], r["question"], r["added"]) for r in again.collect()}
    assert all(repeat[i][2] is False for i in got) and all(repeat[i] == ("linked", got[i][2], False) for i in got if got[i][0] in ("created", "linked"))


def test_two_like_questions_of_a_batch_are_created_then_linked(spark):
    row = lambda i, p: (i, "b", p, "The same question twice?", ["a", "b"], ["a"], f"s{i}", "set", p, 1.0, 0.0, "scored", None, True)
    report, _ = waves.publish_in_order(spark.createDataFrame([row(5, 2), row(9, 1)], INCOMING), empty_store(spark))
    assert {r["id"]: (r["action"], r["question"]) for r in report.collect()} == {9: ("created", 9), 5: ("linked", 9)}
    counts, audit = waves.batch_reports(report)
    assert counts.select("published", "added", "already_in_set", "held", "failed", "status").collect() == [(2, 1, 1, 0, 0, "approved")]
    assert audit.first()["action"] == "approve"
    many = [(i, "b", i, "The same question many times?", ["a"], ["a"], None, f"set{i % 2}", i, 1.0, 0.0, "scored", None, True) for i in range(300)]
    report, _ = waves.publish_in_order(spark.createDataFrame(many, INCOMING), empty_store(spark))
    assert sorted(report.groupBy("action").count().collect()) == [("created", 1), ("linked", 299)] and report.agg(F.max("round")).first()[0] == 1


def test_media_is_uploaded_once_and_intake_follows(spark):
    rows = [(1, "b", 1, "t", [], [], None, "s", 1, 1.0, 0.0, "scored", [("k1", 0), ("k2", 1)], True), (2, "b", 2, "u", [], [], None, "s", 1, 1.0, 0.0, "scored", [("k2", 0), ("k3", 0)], True),
            (3, "b", 3, "v", [], [], None, "s", 1, 1.0, 0.0, "scored", [("k9", 0)], False)]
    keys = waves.missing_media(spark.createDataFrame(rows, INCOMING), spark.createDataFrame([("k3",)], "storage_key string"))
    assert sorted(r[0] for r in keys.collect()) == ["k1", "k2"]
    actions = spark.createDataFrame([(1, "created", 1), (2, "skipped", None), (3, "held", 8)], "id long, action string, question long")
    intake = spark.createDataFrame([(1, "approved", None), (2, "approved", None), (3, "approved", None), (4, "new", None)], "id long, status string, question_id long")
    assert sorted(tuple(r) for r in waves.mirrored_intake(actions, intake, ["id"]).collect()) == [(1, "published", 1), (2, "rejected", None), (3, "approved", None), (4, "new", None)]
