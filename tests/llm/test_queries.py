"""The registered queries and the pipeline on the smallest tables, against brute force."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from test_cases import plain_components, plain_contained, plain_cut

import corpus_pipeline
from qcorpus.llm import hilbert, langcnn, simhash, toxcrf
from qcorpus.llm.common import staged, table
from qcorpus.llm.queries import QUERIES, held_out, tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def plain_groups(rows):
    """Smallest id of each document's group of linked fingerprints."""
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    group = {v: c for c in plain_components(sorted(set(prints.values())), 3) for v in c}
    least = defaultdict(lambda: 1 << 62)
    for d, f in prints.items():
        least[group[f]] = min(least[group[f]], d)
    return {d: least[group[f]] for d, f in prints.items()}, prints


def token_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, docs):
    """Every piece is there once, with its tokens' checksum, and sequences are full from 0 without gaps."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = set()
    for d, t in docs:
        ids = token_ids(tokenizer, t)
        for i, at in enumerate(range(0, len(ids), 4096)):
            piece = np.array(ids[at : at + 4096], "<u4")
            want.add((d, i, at, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096
    assert len(spans) <= 1.02 * sum(n for s in spans.values() for _, n in s) / 4096 + 2


def test_simhash_query(spark):
    groups, prints = plain_groups(texts(table(spark, SF, "documents")))
    got = QUERIES["op4_simhash"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups and {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints


def test_recompression_query(spark):
    rows = texts(table(spark, SF, "documents"))
    assert sorted(tuple(r) for r in QUERIES["op5_recompression"](spark, SF).collect()) == plain_cut(rows, 20)


def test_packing_query(spark):
    check_packing(QUERIES["op6_sum_of_squares_packing"](spark, SF).collect(), texts(table(spark, SF, "documents")))


def test_shards_query(spark):
    rows = dict(texts(table(spark, SF, "documents")))
    got = QUERIES["op7_hilbert_shards"](spark, SF).collect()
    slots = defaultdict(list)
    for r in got:
        data = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # rows stand along the curve, whose index is that of their cells
    index = hilbert.hilbert_index(np.array([[r["lang_cell"], r["source_cell"], r["size_cell"]] for r in got]), hilbert.BITS)
    assert index.tolist() == [r["curve_index"] for r in got]
    along = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in along] == sorted(r["curve_index"] for r in got)
    # a filter on a dimension leaves out the shards whose range of values it misses
    for column in ("lang", "source"):
        ranges = [(min(v), max(v)) for s in slots for v in [[r[column] for r in got if r["shard"] == s and r[column] is not None]]]
        values = {r[column] for r in got if r[column] is not None}
        touched = np.mean([sum(low <= v <= high for low, high in ranges) for v in values])
        assert touched < 7, (column, touched)


def test_held_out_rows_are_those_of_the_checksum(spark):
    for d, h in table(spark, SF, "documents").select("doc_id", held_out()).collect():
        assert h == (zlib.crc32(str(d).encode()) % 5 == 0)


def altered(spark, tmp_path, name, change):
    """A copy of the tables in which the held-out rows of one have other labels."""
    for other in ("documents", "labels"):
        df = table(spark, SF, other)
        if other == name:
            df = df.withColumns(change)
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{other}.parquet")
    return f"file://{tmp_path}"


def test_language_query(spark, tmp_path):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = sorted(QUERIES["op8_language_cnn"](spark, SF).collect())
    mine = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in mine]) > 0.9
    net = langcnn.fit(docs.where(~held_out()), key=F.xxhash64("doc_id"))
    for r in got:
        p = plain_language(net, (rows[r["doc_id"]]["text"] or "").encode())
        assert abs(p.max() - r["score"]) < 1e-4 and net.languages[int(p.argmax())] == r["lang_pred"]
    other = altered(spark, tmp_path, "documents", {"lang": F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))})
    assert sorted(QUERIES["op8_language_cnn"](spark, other).collect()) == got


def plain_language(net, text):
    """Convolution, pooling and softmax written out place by place."""
    total = np.zeros(len(net.languages))
    for at in range(0, len(text), langcnn.WINDOW):
        part = text[at : at + langcnn.WINDOW]
        x = net.embed[np.frombuffer(part.ljust(langcnn.WINDOW), np.uint8)]
        answers = []
        for f in range(net.filters.shape[1]):
            kernel, span = net.filters[:, f].reshape(-1, langcnn.EMBED), max(langcnn.WIDTHS)
            answers.append(max((x[i : i + span] * kernel).sum() for i in range(len(x) - span + 1)))
        z = np.maximum(np.array(answers) + net.bias, 0) @ net.dense + net.dense_bias
        total += len(part) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if len(text) > 20 * langcnn.WINDOW:
            return langcnn.predict(net, [text])[0]  # long texts would take too long here
    return total / total.sum()


def test_toxicity_query(spark, tmp_path):
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    found = QUERIES["op9_toxicity_crf"](spark, SF)
    got = sorted((r["doc_id"], r["score"], r["predicted"], r["held_out"]) for r in found.collect())
    mine = [r for r in got if r[0] in toxic and r[3]]
    assert len(mine) > 10 and np.mean([r[2] == toxic[r[0]] for r in mine]) > 0.85
    other = altered(spark, tmp_path, "labels", {"toxic": F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    again = QUERIES["op9_toxicity_crf"](spark, other)
    assert sorted((r["doc_id"], r["score"], r["predicted"], r["held_out"]) for r in again.collect()) == got
    # one scalar recursion over the whole text, word by word
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels").where(~held_out())
    field = toxcrf.fit(docs.join(toxcrf.draw_labels(labels), "doc_id"), key=F.xxhash64("doc_id"), shares=toxcrf.label_counts(labels))
    scores = {r[0]: r[1] for r in got}
    for d, text in texts(docs)[:40]:
        assert abs(plain_score(field, text or "") - scores[d]) < 1e-6


def plain_score(field, text):
    gain = [np.array([1, np.exp(np.clip(field.emission(w.lower()), -30, 30))]) for w in re.findall(r"[^\W\d_]+", text)]
    t, v, ahead, back = np.exp(field.transition), np.exp(field.start), [], [np.ones(2)]
    for i, g in enumerate(gain):
        v = (v @ t if i else v) * g
        v = v / v.sum()
        ahead.append(v)
    for g in gain[:0:-1]:
        w = t @ (g * back[-1])
        back.append(w / w.sum())
    certain = sum((a[1] * b[1] / (a @ b)) ** field.power for a, b in zip(ahead, back[::-1]))
    return 1 / (1 + np.exp(-(field.curve[0] + field.curve[1] * toxcrf.density(certain, len(gain)))))


def test_warc_query(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in table(spark, SF, "pages").collect()]
    first = {}
    for p, h in sorted(pages):
        first.setdefault(h, p)
    got = {r["page_id"]: r for r in QUERIES["op10_warc_revisits"](spark, SF).collect()}
    assert len(got) == len(pages)
    for p, h in pages:
        assert got[p]["payload_bytes"] == len(h) and got[p]["refers_to"] == (None if first[h] == p else first[h])


def test_main_text_query_keeps_all_blocks(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in QUERIES["op2_main_text"](spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pipeline_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for (name, stage), nxt in zip(corpus_pipeline.STAGES, ["language", "near", "cut", "leaks", "packed"]):
        rows = texts(docs)
        out = staged(stage(spark, docs, SF), name)
        if nxt == "packed":
            check_packing(out.collect(), rows)
            break
        assert out.columns == columns
        got = texts(out)
        if nxt == "language":
            net = langcnn.fit(docs.where(~held_out()), key=F.xxhash64("doc_id"))
            want = [(d, t) for d, t in rows if t and regex.search(r"\p{L}", t) and langcnn.predict(net, [t.encode()]).max() >= 0.5]
        elif nxt == "near":
            groups, _ = plain_groups(rows)
            want = [(d, t) for d, t in rows if groups[d] == d]
        elif nxt == "cut":
            digests = {d: (n, g, s) for d, n, g, s in plain_cut(rows, 20)}
            assert {d for d, _ in got} == {d for d, (n, g, _) in digests.items() if n > g}
            assert all(hashlib.sha256(" ".join(t.split()).encode()).hexdigest() == digests[d][2] for d, t in got)
            before = dict(rows)
            want = [(d, before[d] if not digests[d][1] else t) for d, t in got]
        else:
            leaks = {d for d, _ in plain_contained(rows, [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])}
            assert leaks
            want = [(d, t) for d, t in rows if d not in leaks]
        assert got == want
        docs = out


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty, long and repeated texts, null and repeated ids, clashing columns, and an empty table."""
    documents = table(spark, SF, "documents").limit(60)
    extra = {"n_words": F.lit(-1), "lang_pred": F.lit("keep"), "fp": F.lit(2), "key": F.lit("k"), "_place": F.lit(3), "n_removed": F.lit(-2), "hash": F.lit("h")}
    long = " ".join(f"w{i}" for i in range(40_000))
    story = "the water of the river and the house of the people in the north are what they were in the old days of this land"
    odd = [(900, None), (901, ""), (902, "12 34"), (903, long), (None, story), (904, story), (904, "an other text with the same id, about the towns and the people of the land by the sea"), (None, None)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], documents.schema)
    docs = documents.unionByName(more).unionByName(more).withColumns(extra)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    where = f"file://{tmp_path}"
    for docs in (table(spark, where, "documents"), table(spark, where, "documents").limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, docs, where), name)
            assert out.columns == docs.columns
            rows = out.collect()
            assert {(r["n_words"], r["lang_pred"], r["_place"], r["n_removed"]) for r in rows} <= {(-1, "keep", 3, -2)}
            if name == "near_dedup" and docs.head(1):
                kept = [(r["doc_id"], r["text"]) for r in rows if r["text"] and (r["text"] == story or r["text"].startswith("an other"))]
                assert all(kept.count(x) == 1 for x in kept) and (None, story) not in kept
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, where)
        assert packed.count() >= docs.count()


def test_pipeline_leaves_only_its_result(spark):
    from qcorpus.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"best_fit_packing"}
