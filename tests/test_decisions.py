"""Duplicate decisions on a small fixture with copies, other shapes and near copies, against SQL that compares all pairs."""

import random

from oracle import differences

from qcorpus.functions import text as tx
from qcorpus.plans.documents import norm_sql
from qcorpus.queries import QUERIES

SQL = f"""
WITH p AS (SELECT conv_id * 1000 + turn AS id, conv_id AS c, {norm_sql('text')} AS n, [role] AS o FROM conversations WHERE text IS NOT NULL),
c AS (SELECT id, c, n, o, ['a'] AS a FROM p UNION ALL SELECT -1 - item_id, NULL, {norm_sql('text')}, []::VARCHAR[], []::VARCHAR[] FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT p.id AS probe, c.id AS e, p.o = c.o AS om, ['a'] = c.a AS am FROM p JOIN c ON p.n = c.n AND coalesce(p.c <> c.c, true)),
ex AS (SELECT DISTINCT ON (probe) probe, e, om, am FROM x ORDER BY probe, (om AND am) DESC, e),
y AS (SELECT p.id AS probe, c.id AS e, p.o = c.o AS om, ['a'] = c.a AS am, p.n AS pn, c.n AS cn, 1 - levenshtein(p.n, c.n) / greatest(length(p.n), length(c.n))::DOUBLE AS sim FROM p JOIN c
  ON coalesce(p.c <> c.c, true) AND least(length(p.n), length(c.n)) >= 0.9 * greatest(length(p.n), length(c.n)) WHERE p.id NOT IN (SELECT probe FROM ex)),
nr AS (SELECT DISTINCT ON (probe) *, list_filter(string_split(pn, ' '), lambda w: regexp_full_match(w, '\\d+') OR w IN {tx.NUMBER_WORDS}) = list_filter(string_split(cn, ' '), lambda w: regexp_full_match(w, '\\d+') OR w IN {tx.NUMBER_WORDS}) AS nm
  FROM y WHERE sim >= 0.9 ORDER BY probe, sim DESC, e)
SELECT p.id AS probe, CASE WHEN ex.om AND ex.am THEN 'same' WHEN ex.e IS NOT NULL THEN 'conflicting' WHEN nr.e IS NOT NULL THEN 'near' ELSE 'unique' END AS outcome, coalesce(ex.e, nr.e) AS existing,
  CASE WHEN ex.e IS NOT NULL THEN 1.0::DOUBLE ELSE sim END AS similarity, coalesce(ex.om, nr.om) AS options_match, coalesce(ex.am, nr.am) AS answer_match,
  CASE WHEN ex.om AND ex.am THEN NULL WHEN ex.e IS NOT NULL THEN CASE WHEN ex.am THEN 'same' ELSE 'different' END WHEN nr.e IS NOT NULL THEN CASE WHEN nr.om AND nr.am AND nm THEN 'same' ELSE 'different' END END AS suggestion
FROM p LEFT JOIN ex ON ex.probe = p.id LEFT JOIN nr ON nr.probe = p.id
"""


def test_decisions_equal_all_pairs(spark, tmp_path):
    rng = random.Random(9)
    base = [" ".join(rng.choices("what is the sum of two angles in a triangle near river one 12 three".split(), k=rng.randint(4, 25))) for _ in range(12)]
    turns = []
    for conv in range(30):
        for turn in range(4):
            text = rng.choice([*base, None, f"unlike all the others {rng.random()} {conv}"])
            if text and rng.random() < 0.5:
                i = rng.randrange(len(text))
                text = rng.choice([text.upper(), text[:i] + "x" + text[i:], text.replace("12", "13"), text + "?"])
            turns.append((conv, turn, rng.choice(["user", "assistant"]), text))
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/parts/conversations")
    spark.createDataFrame([(i, t) for i, t in enumerate(base[:10])] + [(90, None), (91, base[11] + "y")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/parts/benchmark")
    for name in ("conversations", "benchmark"):
        next((tmp_path / "parts" / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    found = QUERIES["dedupe_decisions"](spark, str(tmp_path))
    alone, wanted, n = differences(spark, found, SQL, str(tmp_path))
    assert not alone and not wanted and n == sum(t is not None for *_, t in turns)
    assert {r["outcome"] for r in found.select("outcome").distinct().collect()} == {"same", "conflicting", "near", "unique"}
