"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set if over half of the text's shingle hashes have it set. Fingerprints
within a radius r are found with the 2**(r+1) - 1 bit masks of a covering family (Pagh, 2016):
every bit position gets a vector of r+1 bits, and the mask of a non-zero vector v keeps the
positions whose vector has an odd product with v. Some v is orthogonal to the vectors of any r
positions, so every pair within the radius agrees in some table.

Texts with equal fingerprints are first merged. Fingerprints that share a bucket are compared
in blocks of at most ``bucket_rows``; a larger bucket is split exactly by neighbourhood keys: two
fingerprints are within r = a + b bits if a value is within a bits of one and within b bits of
the other, so each fingerprint is dealt to all values within b bits (over the bits that the mask
leaves free), and a value links all that reach it to the smallest that reaches it within a bits.
A value is reached by a bounded number of fingerprints, so no group of copies lands in one task,
and the links grow with the rows, not with the square of a group. Links are joined to components
in Spark (:mod:`.graph`).

Defined cases: null and empty texts have no word, fingerprint zero, and are linked like others;
texts of fewer than ``n`` words have one shingle, all their words; a null id takes part, but
names a component only where no other id is in it; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, staged
from .graph import components

_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, n: int = 3) -> int:
    """SimHash of UTF-8 ``text``: XXH64 (seed 42) of its n-word shingles, strict majority per bit."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= n:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)  # big-endian, highest byte first
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(rows), 1 << 16):
        counts += np.bincount((rows[at : at + (1 << 16)] + _LANES).ravel(), minlength=2048)
    ones = counts.reshape(8, 1, 256) @ _BYTES
    bits = ones.ravel() * 2 > len(rows)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices([batch], "text"):
            values = np.fromiter((fingerprint(x.as_py() or b"", n) for x in part.column("text")), np.uint64, part.num_rows)
            columns = [part.column("doc_id"), part.column("text_key"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp"])


def with_fingerprints(df: DataFrame, id_col="doc_id", text_col="text", n=3) -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and its fingerprint as a signed 64-bit integer."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, n), "doc_id long, text_key long, fp long")


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """2**(radius+1) - 1 masks of 64 bits, of which one spares any ``radius`` positions."""
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % (2 ** (radius + 1)))
    return [
        sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between ``values`` within the radius that span each of their components."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    # a breadth-first walk from each root, level by level
    links, reached = [], label == np.arange(len(values))
    front = reached.copy()
    while front.any():
        step = near & front[None, :] & ~reached[:, None]
        hit = step.any(axis=1)
        links += zip(np.flatnonzero(hit).tolist(), step[hit].argmax(axis=1).tolist())
        reached |= hit
        front = hit
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = [], []
        for members in batch.column("fps"):
            values = np.asarray(members.values).view(np.uint64)
            for a, b in _forest(values, radius):
                u.append(int(values[a].view(np.int64)))
                v.append(int(values[b].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _neighbourhoods(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    near, far = radius // 2, radius - radius // 2
    flips = []
    for mask in masks:
        free = [1 << i for i in range(64) if not mask >> i & 1]
        sums = [sum(c) for k in range(far + 1) for c in combinations(free, k)]
        close = sum(1 for k in range(near + 1) for _ in combinations(free, k))
        flips.append((np.array(sums, np.uint64), close))
    for batch in batches:
        tables = batch.column("t").to_numpy()
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for t in np.unique(tables):
            own = fps[tables == t]
            change, close = flips[t]
            for at in range(0, len(own), 256):
                some = own[at : at + 256]
                keys = (some[:, None] ^ change[None, :]).ravel().view(np.int64)
                is_near = np.tile(np.arange(len(change)) < close, len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(np.repeat(some, len(change)).view(np.int64)), pa.array(is_near)],
                    names=["t", "key", "fp", "near"],
                )


def near_links(fps: DataFrame, radius: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """(u, v) links whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for t, m in enumerate(masks)])
    dealt = fps.select("fp", F.inline(tables))
    sizes = dealt.groupBy("t", "part").agg(F.count("*").alias("n")).where("n > 1")
    sizes = staged(sizes, "buckets")
    small = dealt.join(sizes.where(F.col("n") <= bucket_rows), ["t", "part"])
    small = small.groupBy("t", "part").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = small.mapInArrow(lambda batches: _bucket_links(batches, radius), "u long, v long")
    if not sizes.where(F.col("n") > bucket_rows).head(1):
        return links
    large = dealt.join(sizes.where(F.col("n") > bucket_rows), ["t", "part"]).select("t", "fp")
    large = large.repartition("t", "fp")
    reach = large.mapInArrow(lambda batches: _neighbourhoods(batches, masks, radius), "t int, key long, fp long, near boolean")
    hubs = reach.groupBy("t", "key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n"))
    hubs = hubs.where("hub is not null and n > 1")
    more = reach.join(hubs, ["t", "key"]).where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return links.unionByName(more)


def _groups(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in ``rows``: their component and its smallest id."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(nodes.select("fp"), radius, bucket_rows))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return nodes.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", n=3, radius=3, bucket_rows=1024) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links of at most ``radius`` bits reach."""
    rows = staged(with_fingerprints(df, id_col, text_col, n).drop("text_key"), "fingerprints")
    return rows.join(_groups(rows, radius, bucket_rows), "fp").select("doc_id", "fp", "component_id")


def deduplicate(df: DataFrame, id_col="doc_id", text_col="text", n=3, radius=3, bucket_rows=1024, broadcast_rows=1_000_000) -> DataFrame:
    """``df`` with one row of each group of near-duplicates.

    It is the row of the smallest id, rows without an id coming last; of rows that share that id, the
    one whose text hashes lowest, and of rows that also share the text the smallest by all columns.
    What goes is named by id and text together, so an id that several texts share loses no other
    text; it is broadcast only if it has at most ``broadcast_rows`` rows.
    """
    own = ["_sim_none", "_sim_id", "_sim_key"]
    rows = with_fingerprints(df, id_col, text_col, n)
    rows = rows.groupBy(F.col("doc_id").isNull().alias("_sim_none"), F.coalesce("doc_id", F.lit(0)).alias("_sim_id"), F.col("text_key").alias("_sim_key"), "fp")
    rows = staged(rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "texts")
    groups = rows.join(_groups(rows, radius, bucket_rows).select("fp", "root"), "fp")
    first = groups.groupBy("root").agg(F.min(F.struct(*own)).alias("first"))
    groups = staged(groups.join(first, "root").select(*own, "n", (F.struct(*own) == F.col("first")).alias("stays")), "groups")

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.limit(broadcast_rows + 1).count() <= broadcast_rows else rows

    number = F.col(id_col).cast("long")
    marked = df.withColumns({"_sim_none": number.isNull(), "_sim_id": F.coalesce(number, F.lit(0)), "_sim_key": F.xxhash64(text_col)})
    kept = marked.join(small(groups.where("not stays").select(*own)), own, "left_anti")
    twice = groups.where("stays and n > 1").select(*own)
    if not twice.head(1):
        return kept.select(df.columns)
    twice = small(twice)
    whole = F.struct(*[F.col(c) for c in df.columns])
    once = kept.join(twice, own, "left_semi").groupBy(*own).agg(F.min(whole).alias("_row")).select("_row.*")
    return kept.join(twice, own, "left_anti").select(df.columns).unionByName(once)
