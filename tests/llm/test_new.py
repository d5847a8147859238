"""The operators of the third round against brute force, on the smallest tables and on odd ones."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qcorpus.llm import dialogue, infill, multiset
from qcorpus.llm.common import table
from qcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fingerprints


def plain_edits(rows):
    """(id, n_chars, hash of the edited text) of each row, in the operator's order of rows without an id of their own."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out.append((d, len(t), sha(t[: len(t) - half] + after[:half])))
    return out


def common(a, b):
    """Share of sentences that two texts have in common, by their counts."""
    split = lambda t: [x for x in re.split(r"\n|(?<=[.!?])\s", t) if x]
    x, y = split(a), split(b)
    keys = {*x, *y}
    counts = np.array([[x.count(k), y.count(k)] for k in keys], float).reshape(-1, 2)
    return 1 - ((counts[:, 0] - counts[:, 1]) ** 2).sum() / max(1, (counts**2).sum())


@needs_data
def test_multiset_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op11_multiset_hash"](spark, SF).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(plain_edits(docs.items()))
    prints = {}
    for r in got:
        key = tuple(sorted(docs[r["doc_id"]].split("\n")))
        assert prints.setdefault(r["fingerprint"], key) == key
    assert len(prints) == len({tuple(sorted(t.split("\n"))) for t in docs.values()})
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    off = [r["near_next"] - max(0, common(docs[r["doc_id"]], docs[after[r["doc_id"]]])) for r in got]
    assert np.mean(np.abs(off)) < 0.08 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    half = [t[: len(t) - len(t) // 2] + docs[after[d]][: len(t) // 2] for d, t in docs.items()]
    near = {r["doc_id"]: r["near_edited"] for r in got}
    off = [near[d] - common(t, e) for (d, t), e in zip(docs.items(), half)]
    assert np.mean(np.abs(off)) < 0.08


@pytest.mark.parametrize("buckets", [1, 3, 70])
def test_edits_of_odd_tables(spark, buckets):
    long = "One. Two? " * 30_000
    rows = [(5, "a\nb. c"), (3, None), (9, ""), (7, "ä€😀\n" * 3), (1, long), (None, "x y"), (-4, "tail\n"), (8, "a\nb. c")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"bucket": F.lit("x"), "key": F.lit(1), "text_": F.lit(2)})
    got = multiset.edited_fingerprints(df, buckets=buckets).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(d), n, h) for d, n, h in plain_edits(rows))
    assert multiset.edited_fingerprints(df.limit(0), buckets=buckets).count() == 0
    (one,) = multiset.edited_fingerprints(df.where("doc_id = 5"), buckets=buckets).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha("a\nba\nb")


def test_repeated_rows_follow_each_other(spark):
    rows = [(2, "abcd")] * 5 + [(1, "wxyz"), (2, "efgh"), (None, "q"), (None, "q")]
    got = multiset.edited_fingerprints(spark.createDataFrame(rows, DOCS), buckets=2).collect()
    assert len(got) == 9
    edits = sorted(r["edited_sha256"] for r in got if r["doc_id"] == 2)
    own = [sha("abab")] * 4
    # the rows of id 2 stand by a hash of their text: the copies, then the other row, or the other way
    assert edits in (sorted([*own, sha("abef"), sha("efwx")]), sorted([*own, sha("abwx"), sha("efab")]))


def test_fingerprints_add_up(spark):
    texts = {"whole": "one. two\nthree\nfour! five", "turned": "four! five\none. two\nthree", "part": "three", "rest": "one. two\nfour! five", "empty": ""}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "name string, text string")
    rows = multiset.vectors(df, ["name"], {0: "text"}).drop("side")
    of = {r["name"]: r["vector"] for r in rows.collect()}
    assert of["whole"] == of["turned"] and of["whole"] != of["rest"]
    lit = lambda name: F.lit(of[name])
    one = spark.range(1).select(
        multiset.plus(lit("rest"), lit("part")).alias("sum"), multiset.minus(lit("whole"), lit("part")).alias("less"),
        multiset.likeness(lit("whole"), lit("turned")).alias("same"), multiset.likeness(lit("whole"), lit("empty")).alias("none"),
        multiset.likeness(lit("empty"), lit("empty")).alias("both"), multiset.as_string(lit("part")).alias("digits"),
    ).first()
    assert one["sum"] == of["whole"] and one["less"] == of["rest"] and (one["same"], one["none"], one["both"]) == (1.0, 0.0, 1.0)
    assert re.fullmatch(r"[0-9a-f]{640}", one["digits"])


def test_fingerprints_run_without_python(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], DOCS)
    plan = multiset.edited_fingerprints(df.repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# fill in the middle


def plain_infill(d, t):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = sha(f"42:{'' if d is None else d}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return d, n, "plain", None, None, sha(t), sha(t)
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return d, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(t)


@needs_data
def test_infill_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = QUERIES["op13_fill_in_middle"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(plain_infill(*r) for r in docs)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_of_odd_tables(spark):
    some = ["", None, " ", "\n\t x", "a", "a ", "ä € 😀 b", "<<S<M", "<", "x<P>y", "P> <S", "\x0b\x0c\r a", "long wörd " * 200_000]
    rows = [(i, t) for i, t in enumerate(some * 12)] + [(None, "a b c"), (0, "q w e"), (0, "q w e"), (-7, "m n")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("clash"), "form": F.lit(3), "kept": F.lit(4)})
    found = infill.restore(infill.infill(df, keep_text=False)).collect()
    want = sorted((plain_infill(*r) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], sha(r["infill_text"]), sha(r["restored_text"])) for r in found), key=str) == want
    assert {r["kept"] for r in found} == {4}
    assert infill.restore(infill.infill(df.limit(0))).count() == 0
    by_n = infill.infill(df.select(F.col("doc_id").alias("n"), "text").limit(5), id_col="n")
    assert "_infill_id" in by_n.columns and by_n.count() == 5


def test_pieces_do_not_change_the_outputs(monkeypatch):
    texts = [("w%d " % i * (i % 7)).encode() for i in range(60)]
    ids = list(range(60))
    whole = infill.arrange(texts, ids, 100, 50, 1)
    monkeypatch.setattr(infill, "_PIECE", 5)
    assert infill.arrange(texts, ids, 100, 50, 1) == whole and infill.rebuilt(whole[0], whole[2]) == texts


# conversation repair


def plain_faults(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(rows):
    """The least (cost, audit) and what it leaves, by a forward search over automaton states."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for (p, x), q in go.items():
                if x != "s" and p in states:
                    c, audit, lines = states[p]
                    new = (c + 5, audit + "I", [*lines, names[x] + ":"])
                    states[q] = min(states.get(q, new), new)
        return states

    states = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for p, (c, audit, lines) in states.items():
            options = [(p, (c + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (p, role[:1]) in go:
                    options.append((go[p, role[:1]], (c + more, audit + "K", [*lines, f"{role}:{text}"])))
                options += [(go[p, x], (c + 1 + more, audit + "R", [*lines, f"{names[x]}:{text}"])) for x in "ua" if (p, x) in go]
            for q, new in options:
                after[q] = min(after.get(q, new), new)
        states = inserted(after)
    return min(states[q] for q in (0, 3) if q in states)


def every_repair(rows):
    """The least (cost, audit) of all edits with at most two insertions in a gap."""
    best = None
    letters = ["D" if f in ("blank", "duplicate") else "KRD" for _, _, f in rows]
    for edits in itertools.product(*letters):
        cost = sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and r[2] == "truncated") for e, r in zip(edits, rows))
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            options = ["?" * gaps[0]]
            for e, (role, _, _), n in zip(edits, rows, gaps[1:]):
                options.append(("" if e == "D" else role[:1] if e == "K" else "?") + "?" * n)
            pattern = "".join(options)
            fits = re.fullmatch(r"([s]?([u?][a?])+)?", pattern) is not None and not pattern.startswith("s?") or re.fullmatch(r"s([u?][a?])+", pattern)
            if fits:
                audit = "I" * gaps[0] + "".join(e + "I" * n for e, n in zip(edits, gaps[1:]))
                new = (cost + 5 * sum(gaps), audit)
                best = min(best or new, new)
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_reports(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in plain_damage(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, _, _ in own} - {None}
        found = plain_faults([r[1:] for r in own])
        faults = [f for _, _, f in found]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = plain_repair(found) if own else (0, "", [])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


@needs_data
def test_conversation_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_conversation_repair"](spark, SF).collect()]
    assert sorted(got, key=str) == plain_reports(rows)


def test_cells_equal_every_repair():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "t", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(1, 4))]
        assert plain_repair(rows)[:2] == every_repair(rows)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "x", ""]), "t", rng.choice(["", "", "truncated", "duplicate"])) for _ in range(rng.randint(1, 40))]
        marks = {"": str, "truncated": lambda x: x.upper().replace("-", "_"), "duplicate": lambda x: "!"}
        shapes = "".join(marks[f](r[0] if r[:1] in ("s", "u", "a") else "-") for r, _, f in rows)
        assert dialogue.best(dialogue.parse(shapes)) == plain_repair(rows)[:2]
        cut = rng.randint(0, len(shapes))
        assert dialogue.best(dialogue.combine(dialogue.parse(shapes[:cut]), dialogue.parse(shapes[cut:]))) == plain_repair(rows)[:2]


def test_repair_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", 4)  # conversations span blocks
    rng = random.Random(3)
    texts = ["Hi.", "no end", "", None, " \n", "Well?", "ok!\t", "a b"]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for conv in [*range(40), None]:
        for i in range(rng.choice([1, 2, 5, 30])):
            rows.append((conv, rng.choice([i, i, i, None, 99]) if conv == 3 else i, rng.choice(roles), rng.choice(texts) if i % 3 else f"Row {i}."))
    rows = [r for r in rows if r[0] != 3] + [(3, i if i % 4 else None, "user", f"Row {i}.") for i in range(9) if i % 4 or not i]
    rows += [(7, 5, "user", "same."), (7, 5, "user", "same.")] + [(1000, 2, "user", "x" * 300_000 + ".")] + [(2000, i, "assistant", "Same.") for i in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    distinct = {}
    for r in rows:
        distinct.setdefault((r[0], r[1]), set()).add(r[2:])
    keep = [r for r in rows if len(distinct[r[0], r[1]]) == 1]  # the plain version has no digest for rows that tie
    df = frame.withColumns({"report": F.lit(1), "place": F.lit("p")})
    want = plain_reports(keep)
    tied = {r[0] for r in rows} - {r[0] for r in keep} | {r[0] for r in rows if len(distinct[r[0], r[1]]) > 1}
    got = sorted((tuple(r) for r in dialogue.repair(dialogue.damaged(df), df).collect()), key=str)
    assert {r[0] for r in got} == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    assert [r for r in got if r[0] not in tied] == [r for r in want if r[0] not in tied] and len(tied) < 10
    assert dialogue.repair(dialogue.damaged(df.limit(0)), df.limit(0)).count() == 0


# faults of earlier rounds


def test_slices_go_by_what_texts_unpack_to():
    import pyarrow as pa
    import zstandard

    from qcorpus.llm import recompress

    packer = zstandard.ZstdCompressor(level=3)
    text = b"all work and no play " * 5000
    batch = pa.record_batch({"text": pa.array([packer.compress(text)] * 300 + [None], pa.binary()), "i": pa.array(range(301))})
    slices = list(recompress._unpacked(batch, "text", 1 << 20))
    assert [len(t) for _, t in slices][:2] != [301] and max(sum(map(len, t)) for _, t in slices) <= (1 << 20) + len(text)
    assert [x for part, _ in slices for x in part.column("i").to_pylist()] == list(range(301)) and slices[-1][1][-1] == b""


def test_repetitive_texts_take_little_memory():
    """A whole Arrow batch of texts that compress to almost nothing."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa, zstandard
from qcorpus.llm import recompress
packer = zstandard.ZstdCompressor(level=3)
frames = [packer.compress((f"w{i} " + "the same few words again " * 400).encode()) for i in range(3000)]
none = pa.array([[]] * 3000, pa.list_(pa.int64()))
batch = pa.record_batch({"_place": pa.array(range(3000)), "text": pa.array(frames, pa.binary()), "flags": none, "flag_checks": none})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in recompress._emit_windows(iter([batch]), 20))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), check=True)
    assert int(out.stdout.split()[1]) < 500


def test_main_text_keeps_what_only_sounds_like_boilerplate():
    from qcorpus.llm import linebreaks

    story = "A sentence of the story that goes on. " * 10
    for mark in ("class='side-by-side'", "class='related-work'", "id='search-results-explained'"):
        page = f"<body><nav>x</nav><article><p>{story}</p><div {mark}><p>Inner words.</p></div></article></body>"
        assert linebreaks.main_text(page) == f"{story.strip()}\nInner words."
    assert linebreaks.main_text("<article><p>Para <span class=\"share\">one</p><p>Two</p></article>") == "Para one\nTwo"
    for between in ("<div class=ad>Buy</div><aside>More</aside><form>Name</form>", "<nav>a</nav><nav>b</nav><nav>c</nav><nav>d</nav>"):
        assert linebreaks.main_text(f"<body><p>{story}</p>{between}<p>Tiny closing.</p></body>") == f"{story.strip()}\nTiny closing."
    for mark in ("site-footer", "main-nav", "cookie_notice", "ad", "related posts", "comments"):
        assert linebreaks.main_text(f"<body><p>{story}</p><div class='{mark}'>Gone</div></body>") == story.strip()


def test_start_of_the_chain_is_fitted():
    from qcorpus.llm import toxcrf

    texts = [f"idiot word{i} other plain words of text number {i}" for i in range(60)] + [f"plain words of text number {i} and word{i}" for i in range(60)]
    field = toxcrf.train(texts, [1] * 60 + [0] * 60)
    assert field.start[1] != 0 and field.power in toxcrf.POWERS
    # the gradient of the log-likelihood by the start is the difference of tags and marginals
    rng = np.random.default_rng(1)
    emission, inside, transition = rng.normal(size=(1, 5)), np.ones((1, 5), bool), rng.normal(size=(2, 2))

    def partition(start):
        total = 0.0
        for tags in itertools.product((0, 1), repeat=5):
            total += np.exp(start[tags[0]] + sum(e * t for e, t in zip(emission[0], tags)) + sum(transition[a][b] for a, b in zip(tags, tags[1:])))
        return np.log(total)

    start, step = np.array([0.0, 0.3]), np.array([0.0, 1e-5])
    slope = (partition(start + step) - partition(start - step)) / 2e-5
    marginal, _ = toxcrf.forward_backward(emission, inside, transition, start)
    assert np.isclose(slope, marginal[0, 0])
