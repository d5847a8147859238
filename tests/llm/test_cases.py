"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qcorpus.llm import decontam, hilbert, langcnn, linebreaks, packing, recompress, repetition, simhash, toxcrf, warc
from qcorpus.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
CLASH = "doc_id long, text string, n_words int, hash string, key string, doc long, fp long, u int, v int, lang_pred string, bin int, shard int"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "h", "k", 1, 2, 3, 4, "l", 5, 6) for i, t in zip(ids, texts)], CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a long one, copies, a repeated row and a null id."""
    texts = [None, "", " \n\t ", "short one", LONG, LONG, "a b c d e f g h", "a b c d e f g h", "no id"]
    return documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 6, None])


def by_id(df, column):
    return sorted(((r["doc_id"], r[column]) for r in df.collect()), key=str)


def test_repetition(spark, odd):
    found = repetition.repetition(repetition.with_line_counts(odd))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == 9 and rows[0]["n_words"] == 0 and rows[4]["n_words"] == 60_000 and rows[4]["longest_repeat"] == 1
    assert rows[6]["hash"] == "h" and not rows[1]["repetitive"]
    assert repetition.repetition(odd.limit(0)).count() == 0


def plain_repeats(words, least):
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and i + n < len(words) and j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best[i] = max(best[i], n)
    inside = [any(best[p] >= least and p <= i < p + best[p] for p in range(i + 1)) for i in range(len(words))]
    return best, inside


def test_suffix_array_equals_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        docs = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(40))] for _ in range(3)]
        symbols = np.array([x for d in docs for x in d], np.int64)
        owner = np.repeat(np.arange(3), [len(d) for d in docs])
        best = repetition.longest_repeats(symbols, owner)
        want = [plain_repeats(d, 3) for d in docs]
        assert best.tolist() == [x for b, _ in want for x in b]
        assert repetition.covered(best, 3).tolist() == [x for _, c in want for x in c]


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this page.</div>
<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>First   paragraph<br>goes
on.<p>Caf&eacute; &lt;ok&gt; <b>bold<p>Last.</article><section id="comments"><p>A long reader comment that should not be kept at all.</p></section>
<aside><p>Sidebar</p></aside><form><p>Sign up</p></form><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "just words", "x"), (5, "u", "<p>cut off <b>here</b> <a hre", "x"), (1, "u", PAGE, "x")]
    got = linebreaks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = "Head & line\nFirst paragraph goes on.\nCafé <ok> bold\nLast."
    assert linebreaks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, text), (1, text), (2, ""), (3, ""), (4, "just words"), (5, "cut off here")]


def test_main_text_without_article_element():
    body = "".join(f"<p>{'A sentence of the story that goes on for a while. ' * 3}</p>" for _ in range(5))
    page = f"<body><div id='menu'><a href='/'>x</a></div><div>{body}</div><div class='comments'><p>{'reader words ' * 40}</p></div><div class=footer>end</div></body>"
    text = linebreaks.main_text(page)
    assert text.count("\n") == 4 and "reader" not in text and "end" not in text


def test_main_text_keeps_a_short_end_after_an_advert():
    story, end = "A sentence of the story that goes on. " * 130, "The last paragraph, which closes the story. " * 7
    links = "<p><a href='/a'>One other story of the site</a> | <a href='/b'>And one more of them</a></p>"
    page = f"<body><p>{story}</p><div class='advert'>Buy</div><p>{end}</p><aside>x</aside>{links}</body>"
    assert linebreaks.main_text(page) == f"{story.strip()}\n{end.strip()}"


def test_the_window_decides_what_is_text():
    story = "A sentence of the story that goes on. " * 30
    page = f"<body><p>{story}</p><div class='ad'>Buy</div><p>The end.</p><ul>{'<li><a>one more link</a></li>' * 5}</ul><p>Stray words</p></body>"
    assert linebreaks.main_text(page) == f"{story.strip()}\nThe end."
    assert linebreaks.main_text(page, window=1) == story.strip()


def test_main_text_keeps_links_of_the_text():
    story = "A sentence of the story that goes on. " * 10
    link = "<p><a href='/'>A paragraph that is a link as a whole</a></p>"
    for page in (f"<body><p>{story}</p>{link}<p>{story}</p></body>", f"<article><p>{story}</p>{link}<p>{story}</article>"):
        assert linebreaks.main_text(page).split("\n") == [story.strip(), "A paragraph that is a link as a whole", story.strip()]


def test_main_text_leaves_out_comments_that_are_articles():
    page = "<main><p>Kept.</p><section class='comments'><article class='comment'><p>Out</p></article></section><p>Too.</p></main>"
    assert linebreaks.main_text(page) == "Kept.\nToo."


def test_unclosed_and_odd_markup_takes_linear_time():
    import time

    for unit in ("<div class='ad'>x", "<a \"", "<a '", "<p class=ad>y", "<span class=ad>z<p>", "</div></p>", "<!--", "<script>", "<li><ul>w", "<b class=menu>"):
        took = []
        for n in (20_000, 40_000):
            began = time.perf_counter()
            linebreaks.main_text("<body>" + unit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 5, (unit, took)
    text = linebreaks.main_text("<article>" + "<p>Some words of a long page." * 400_000)
    assert text.count("\n") == 399_999


def test_main_text_in_a_container_named_after_its_sidebar():
    page = "<body><div class='with sidebar'><article><p>Kept.<p>Too.</article><div class='sidebar'>Out</div></div></body>"
    assert linebreaks.main_text(page) == "Kept.\nToo."


def plain_contained(docs, items, n=5, threshold=0.8):
    import re

    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for d, t in docs:
        for i, u in items:
            q = shingles(u)
            if d is not None and q and len(q & shingles(t)) >= threshold * len(q):
                out.add((d, i))
    return out


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination_equals_brute_force(spark, odd, broadcast_rows):
    rng = random.Random(4)
    w = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(w) for _ in range(k))) for i, k in enumerate([3, 5, 12, 30, 90, 300])] + [(9, None), (10, "")]
    docs = [(i, " ".join(rng.choice(w) for _ in range(50)) + f" {t or ''} and more " + " ".join(rng.choice(w) for _ in range(400))) for i, (_, t) in enumerate(items)]
    cut = items[4][1].split()
    docs += [(20, " ".join(cut[:80])), (21, " ".join(cut[:60])), (22, None), (None, items[3][1]), (0, items[2][1].upper()), (23, f"{LONG} {items[3][1]} {LONG}")]
    table = documents(spark, [t for _, t in docs], [d for d, _ in docs])
    bench = spark.createDataFrame([(*x, 1) for x in items + items[:1]], "item_id long, text string, hash int")
    got = decontam.contained_items(table, bench, broadcast_rows=broadcast_rows).collect()
    docs = [(d, "\n\n".join(t or "" for e, t in docs if e == d)) for d in {d for d, _ in docs}]
    assert {(r["doc_id"], r["item_id"]) for r in got} == plain_contained(docs, items) and len(got) >= 5
    left = decontam.decontaminate(table, bench)
    ids = {d for d, _ in docs} | {None}
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == ids - {r["doc_id"] for r in got}
    assert decontam.contained_items(table.limit(0), bench.limit(0)).count() == 0


def test_fingerprint_equals_brute_force():
    for text in ("", "one", "Two Words", "a b c d e f a b c", LONG):
        words = text.lower().split()
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == want


def test_masks_cover_every_three_positions():
    from itertools import combinations

    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    assert all(any(m & sum(1 << i for i in c) == 0 for m in masks) for c in combinations(range(64), 3))


def plain_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {frozenset(v for v in values if find(v) == r) for r in map(find, values)}


@pytest.mark.parametrize("bucket_rows", [1024, 3])
def test_links_equal_brute_force(spark, bucket_rows):
    """With tiny buckets every link comes from the exact split of large ones."""
    from qcorpus.llm.graph import components

    rng = random.Random(6)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(63)
        for _ in range(12):
            values.add(v)
            for _ in range(rng.choice([1, 2, 3, 4])):
                v ^= 1 << rng.randrange(63)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = components(simhash.near_links(fps, 3, bucket_rows)).groupBy("root").agg(F.collect_set("node").alias("n")).collect()
    assert {frozenset(r["n"]) for r in found} == {c for c in plain_components(sorted(values), 3) if len(c) > 1}


def test_near_duplicates(spark, odd):
    got = by_id(simhash.near_duplicates(odd), "component_id")
    assert got == sorted([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (None, None)], key=str)
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 3, 4, 6, None], key=str)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.deduplicate(odd.limit(0)).count() == 0


def test_deduplicate_loses_no_text(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "thirteen fourteen fifteen sixteen"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "w"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (None, None, "x"), (7, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    want = [(3, a, "x"), (5, b, "w"), (None, c, "x"), (7, "", "x")]
    for most in (1_000_000, 0):
        kept = simhash.deduplicate(df, broadcast_rows=most)
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def plain_cut(rows, window):
    seen, out = {}, []
    for d, t in sorted(rows):
        words = (t or "").split()
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), (d, i))
    for d, t in rows:
        words = (t or "").split()
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] < (d, i) for j in range(i, i + window)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [20, 7])
def test_substring_removal_equals_brute_force(spark, window):
    rng = random.Random(window)
    parts = [[f"{rng.randrange(30)}" for _ in range(rng.randrange(10, 150))] for _ in range(5)]
    rows = []
    for d in rng.sample(range(1000), 50):
        words = []
        for _ in range(rng.randrange(4)):
            part = rng.choice(parts)
            at = rng.randrange(len(part))
            words += part[at : at + rng.randrange(5, 120)] + ["z"] * rng.choice([0, 0, 50]) + [f"{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        rows.append((d, " ".join(words)))
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, keep_text=False)
    assert sorted(tuple(r) for r in got.collect()) == plain_cut(rows, window)


def test_substring_removal_cases(spark, odd):
    got = recompress.remove_repeats(odd)
    rows = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    assert got.count() == 9 and rows[4, 60_000]["n_removed"] == 0 and rows[5, 60_000]["n_removed"] == 60_000 and rows[5, 60_000]["text"] == ""
    assert rows[0, 0]["text"] is None and rows[2, 0]["text"] == " \n\t " and rows[6, 8]["n_removed"] == 0 and rows[3, 2]["hash"] == "h"
    assert recompress.remove_repeats(odd.limit(0)).count() == 0 and got.columns.count("n_words") == 1


def test_substring_removal_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a + " x"), (None, a), (7, b), (7, "y " + b), (7, "y " + b), (3, b + " " + b), (9, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    want = [row[1:] for row in plain_cut([(i, r["text"]) for i, r in enumerate(order)], 20)]
    got = recompress.remove_repeats(df, keep_text=False)
    assert sorted(tuple(r)[2:] for r in got.collect()) == sorted(want)


def test_checks_tell_spans_apart():
    names = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64)
    names[200:300] = names[50:150]
    checks = recompress.SpanChecks(names)
    starts = np.arange(380)
    values = checks.of(starts, starts + 20)
    assert (values[200:281] == values[50:131]).all() and len(np.unique(values)) == 380 - 81


@pytest.mark.parametrize("bin_pieces", [8, 1 << 14])
def test_packing(spark, odd, bin_pieces):
    from qcorpus.llm.common import staged

    pieces = staged(packing.token_pieces(odd, tokenizer_path()), "pieces")
    got = packing.pack(pieces, bin_pieces=bin_pieces).collect()
    assert len(got) == pieces.count() and sum(r["length"] for r in got if r["doc_id"] in (0, 1, 2)) == 3
    places = {}
    for r in got:
        assert 1 <= r["length"] <= 4096
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 4096
    assert packing.pack(staged(packing.token_pieces(odd.limit(0), tokenizer_path()), "none")).count() == 0


def test_word_ids_equal_the_tokenizer():
    ids = packing.WordIds(tokenizer_path())
    texts = ["Hello, World!!! it's o'clock... 'tis ÀÉ, 12ab.. don't'll. a.b.c. <|endoftext|>, x́,, ½, naïve—dash… (x)", LONG[:5000], "", "\x85 \xa0x", "İstanbul ΣΑΣ ﬁne ªº 中文 e\u0301te"]
    texts += ["x <|endoftext|> y", "x <|EndOfText|> y", "a<|startoftext|>", "<|endoftext|" + ">"]
    plain = Tokenizer.from_file(tokenizer_path())
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(want[5], "<u4").tolist() == [343, 49407, 344]
    assert ids.documents([t.encode() for t in texts]) == want == ids.documents([t.encode() for t in texts])


def test_sum_of_squares_equals_brute_force():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 21, 300)
    sequence, offset = packing.sum_of_squares(lengths, 20)
    counts, want = {}, []
    for n in lengths.tolist():
        def total(gap_from, gap_to):
            c = dict(counts)
            for g, step in ((gap_from, -1), (gap_to, 1)):
                if g not in (None, 0):
                    c[g] = c.get(g, 0) + step
            return sum(v * v for v in c.values())
        options = [(total(g, g - n), 0, g) for g, v in counts.items() if v and g >= n] + [(total(None, 20 - n), 1, None)]
        g = min(options)[2]
        for x, step in ((g, -1), ((20 if g is None else g) - n, 1)):
            if x not in (None, 0):
                counts[x] = counts.get(x, 0) + step
        want.append(20 if g is None else g)
    assert offset.tolist() == [20 - g for g in want]


def test_hilbert_curve_steps_to_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    index = hilbert.hilbert_index(points, 3)
    assert sorted(index.tolist()) == list(range(512))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("bucket_rows", [20_000, 2])
def test_hilbert_shards(spark, odd, bucket_rows):
    df = odd.select("doc_id", F.substring("text", 1, 20).alias("text"), F.length("text").alias("size"), "shard")
    dims = [hilbert.quantiles(df, "text"), hilbert.level(F.col("size"))]
    got = hilbert.hilbert_shards(df, dims, ["doc_id", "size"], shards=4, bucket_rows=bucket_rows).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(s) for s in slots.values()) == [2, 2, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in order)
    assert [c for c in hilbert.hilbert_shards(df, dims, ["doc_id"]).columns] == ["doc_id", "text", "size", "curve_index", "shard", "slot"]
    assert hilbert.hilbert_shards(df.limit(0), dims, ["doc_id"]).count() == 0


def test_hilbert_copies_of_a_row_are_whole(spark):
    df = spark.range(100).select(F.when(F.col("id") < 40, None).otherwise(F.col("id")).alias("doc_id"))
    got = hilbert.hilbert_shards(df, [F.coalesce(F.col("doc_id") % 16, F.lit(0))] * 2, ["doc_id"], shards=8, bucket_rows=3).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(r["doc_id"] is None for r in got) == 40 and {len(s) for s in slots.values()} == {12, 13}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quantiles_keep_the_order(spark):
    df = spark.createDataFrame([(None,)] + [(f"v{i % 50:02}",) for i in range(500)] + [("v07",)] * 300, "v string")
    got = sorted(df.select("v", hilbert.quantiles(df, "v").alias("q")).distinct().collect(), key=lambda r: (r["v"] is not None, r["v"]))
    cells = [r["q"] for r in got]
    assert cells == sorted(cells) and cells[0] == 0 and max(cells) <= 15 and len(set(cells)) >= 8
    assert [r["q"] for r in got if r["v"] == "v07"][0] < [r["q"] for r in got if r["v"] == "v08"][0]


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_quantiles_of_many_values_are_exact(spark, coalesced):
    rng = random.Random(7)
    # many more values than any sample of bounds, some of them frequent, one in three cells at once, and nulls
    counts = {f"v{rng.randrange(1 << 40):x}": rng.choice([1, 1, 1, 2, 9]) for _ in range(25_000)} | {"v7": 16_000}
    rows = spark.createDataFrame([*counts.items(), (None, 500)], "v string, n int")
    df = rows.select("v", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    want, below, total = {None: 0}, 0, sum(counts.values())
    for v in sorted(counts):
        want[v] = below * 16 // total
        below += counts[v]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)  # one range or several
    try:
        quantile = hilbert.quantiles(df, "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = df.select("v", quantile.alias("q")).distinct().collect()
    assert len(got) == len(want) and {r["v"]: r["q"] for r in got} == want and 8 < len(set(want.values())) < 16


def test_quantiles_of_numbers_and_nothing(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") - 500.5).alias("v"), F.lit(None).cast("int").alias("none"))
    df = df.unionByName(spark.sql("select double('nan') as v, cast(null as int) as none"))
    got = df.select("v", hilbert.quantiles(df, "v").alias("q"), hilbert.quantiles(df, "none").alias("none")).collect()
    values = [r["v"] for r in got if r["v"] is not None and r["v"] == r["v"]]
    want = {v: i * 16 // (len(values) + 1) for i, v in enumerate(sorted(values))}
    assert all(r["q"] == (want[r["v"]] if r["v"] in want else 0 if r["v"] is None else 15) for r in got) and {r["none"] for r in got} == {0}
    assert df.limit(0).select(hilbert.quantiles(df.limit(0), "v")).count() == 0


def test_language(spark, odd):
    rng = random.Random(1)
    words = {"aa": ["and", "the", "with", "over"], "bb": ["und", "der", "mit", "über"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(8, 200)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)] + [(200, "12 34", "aa"), (201, None, "aa"), (202, "and", None)]
    net = langcnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    got = langcnn.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), net).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["lang_score"] <= 1 for r in got)
    rows = {r["doc_id"]: r for r in langcnn.identify(odd, net).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and rows[0]["lang_score"] == 0 and rows[4]["hash"] == "h"
    assert langcnn.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langcnn.identify(odd, None).collect()} == {"und"} and langcnn.identify(odd.limit(0), net).count() == 0


def plain_marginals(emission, transition, start):
    from itertools import product

    total, ones = 0.0, np.zeros(len(emission))
    for tags in product((0, 1), repeat=len(emission)):
        weight = np.exp(start[tags[0]] + sum(e * t for e, t in zip(emission, tags)) + sum(transition[a][b] for a, b in zip(tags, tags[1:])))
        total += weight
        ones += weight * np.array(tags)
    return ones / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    transition, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    emission = rng.normal(size=(4, 7))
    inside = np.arange(7) < np.array([7, 4, 1, 6])[:, None]
    marginal, _ = toxcrf.forward_backward(emission, inside, transition, start)
    for e, i, m in zip(emission, inside, marginal):
        assert np.allclose(m[i], plain_marginals(e[i], transition, start))


def test_a_long_chain_is_one_chain():
    """Rows that go on with the chain of the row before give the marginals of the whole chain."""
    rng = np.random.default_rng(8)
    field = toxcrf.Field({}, rng.normal(size=(2, 2)) * 2, rng.normal(size=2), (0.0, 1.0))
    emissions = [rng.normal(size=n).tolist() for n in (1000, 0, 3, 128, 256, 129)]
    _, _, got = toxcrf.marginals(field, emissions)
    t, s = np.exp(field.transition), np.exp(field.start)
    for e, m in zip(emissions, got):
        gain = [np.array([1, np.exp(x)]) for x in e]
        ahead, back = [], [np.ones(2)]
        for i, g in enumerate(gain):
            v = (ahead[-1] @ t if i else s) * g
            ahead.append(v / v.sum())
        for g in gain[:0:-1]:
            v = t @ (g * back[-1])
            back.append(v / v.sum())
        want = [a * b / (a @ b) for a, b in zip(ahead, back[::-1])]
        assert np.allclose(m, [w[1] for w in want])


def test_toxicity(spark, odd):
    rng = random.Random(9)
    good = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    def text(bad):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 300))]
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(["Vilest", "rotten", "foul"])
        return " ".join(words)
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    field = toxcrf.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    tests = [(i, text(i % 2), i % 2) for i in range(60)]
    got = toxcrf.score(spark.createDataFrame(tests, "doc_id long, text string, toxic int"), field).collect()
    assert sum((r["toxic_score"] >= 0.5) == r["toxic"] for r in got) >= 58
    spans = {r["text"][s["start"] : s["end"]] for r in got for s in r["toxic_spans"]}
    assert spans and all(w in ("Vilest", "rotten", "foul") for s in spans for w in s.split())
    rows = toxcrf.score(odd, field).collect()
    assert len(rows) == 9 and all(0 <= r["toxic_score"] <= 1 for r in rows) and toxcrf.score(odd.limit(0), field).count() == 0
    one_kind = toxcrf.fit(odd.withColumn("toxic", F.lit(0)))
    assert all(r["toxic_score"] < 0.5 for r in toxcrf.score(odd, one_kind).collect())


def test_warc_round_trip(spark, tmp_path):
    import base64

    long = "<p>" + "x" * 2_000_000
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", long), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    warc.write_archives(pages, f"file://{tmp_path}/w", records_per_file=3)
    records = warc.read_archives(spark, f"file://{tmp_path}/w")
    found = warc.resolve_revisits(records).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in found if r["page_id"] == 5) == [(5, "response"), (5, "revisit")] and len(found) == len(rows)
    got = {r["page_id"]: r for r in sorted(found, key=lambda r: r["record_type"], reverse=True)}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert {p: r["payload_digest"] for p, r in got.items()} == {p: digest(t) for p, _, t in rows}
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 7: ("response", None), None: ("revisit", 1)}
    assert got[2]["payload_bytes"] == 4 and got[7]["payload_bytes"] == len(long)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect()}
    assert payloads[5] == rows[4][2] and payloads[7] == long
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_keeps_every_row(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (None, "a", "y"), (None, "b", "y"), (None, "b", "y"), (2, "w", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    records = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] or 0, r["url"]) for r in records) == sorted((p or 0, u) for p, u, _ in rows)
    ids = {r["record_id"]: r["record_type"] for r in records}
    assert len(ids) == len(rows) and sorted(ids.values()) == ["response"] * 3 + ["revisit"] * 4
    assert all(ids[r["refers_to_id"]] == "response" for r in records if r["record_type"] == "revisit")
    found = warc.resolve_revisits(spark.createDataFrame(records)).collect()
    assert len(found) == len(rows) and all(r["payload_bytes"] == 1 for r in found)
    small = warc.plan_records(pages.withColumn("row", F.lit(1)).withColumn("payload", F.lit("p")), least_bytes=2)
    assert small.count() == small.where("record_type = 'response'").count() == len(rows)
