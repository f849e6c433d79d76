"""SimHash near-duplicates by multi-index hashing.

Fingerprint: texts are lower-cased (A-Z only) and cut into words at ASCII white space; of the XXH64 values of all
k-word shingles, repeats included, each bit is set that is set in over half of them.  A text of fewer than k words is
one shingle; one without words (null too) has fingerprint zero, which is linked like any other.

Index: the fingerprint is cut into segments, and each distinct fingerprint is written under all keys of a small Hamming
ball around each segment.  Two fingerprints within the stated distance meet under at least one key (pigeonhole), where
the complete distance decides.  A bucket is searched from one member at a time among those not yet reached, so that it
yields a spanning forest, not all pairs, and a family of near copies costs about one comparison a member (buckets of
at most SMALL rows are simply compared).  A bucket
of over RUN_LIMIT fingerprints is not held by one task: it is dealt out anew by pairs of its parts.  What is left is
`graph.components`.  A scheme with a `similarity` takes its keys from BANDS bands of BAND least hashes instead, because
balls miss pairs that differ in many bits, and takes the components as candidates: within each, the texts are linked the
same way if their shingle sets have that Jaccard similarity, exactly; sketches with SLACK only spare comparisons.
Nothing is capped.  Copies of a fingerprint are one node whatever their number; with a `similarity`, fingerprints are of distinct
shingles, and only texts of the same shingle set are one node, so that equal fingerprints are compared like others.

Cases.  doc_ids that repeat are one document in the result's `component_id` and a row each; null doc_ids take part,
and are a component's id only if it has no other.  Empty tables give empty results.  Other columns are ignored by
`classes` and kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, packed, slices, stored, table, unpacked
from .graph import components

RUN_LIMIT = 200_000
SMALL = 16  # rows of a bucket whose pairs are all looked at; the links of larger ones span its components only
SEED = 42


@dataclass(frozen=True)
class Scheme:
    """shingle: words a shingle; words: 64-bit words a fingerprint; distance: most differing bits of a link; segments:
    (word, shift, width); radius: 1 or 2, bits that two linked fingerprints may differ by within the segment where they meet."""

    shingle: int
    words: int
    distance: int
    segments: tuple[tuple[int, int, int], ...]
    radius: int
    similarity: float = 0.0  # if set, what fingerprints link are candidates, and sketches decide


#: Three words, 3 of 64 bits: one of the two halves differs by one bit at most, so that no link is missed.
EXACT = Scheme(3, 1, 3, ((0, 0, 32), (0, 32, 32)), 1)
#: Five words.  Candidates have a band in common, which two texts of similarity 0.8 lack with probability (1 - 0.8^3)^16
#: = 0.00001, and differ in at most 44 of 128 bits, six deviations above what such texts differ by (an angle of 27
#: degrees, 19.4 bits, deviation 4.05).  A link is a similarity of 0.8 or more.
SIMILAR = Scheme(5, 2, 44, (), 0, 0.8)
BANDS, BAND = 16, 3
TURNS = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) for i in range(2 * BANDS * BAND)], dtype=np.uint64).reshape(2, -1, 1)
SLACK = 0.2  # below the similarity, of sketches whose sets are compared; their deviation is 0.025
BINS = 256  # of a sketch, 16 bits each
EMPTY = 0xFFFF
SKETCH_LIMIT = 5_000  # texts that one task compares with each other
BYTES_LIMIT = 32 << 20  # of their text


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Of each of BINS classes of the hashes (by their lowest bits) 16 bits of the least one; EMPTY if there is none."""
    out = np.full(BINS, EMPTY, dtype=np.uint16)
    turned = np.sort(hashes << np.uint64(56) | hashes >> np.uint64(8))
    bins = (turned >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))) if len(bins) else []
    out[bins[first]] = (turned[first] & np.uint64((1 << 56) - 1)) % np.uint64(EMPTY)
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: of BAND orders of the hashes the least ones."""
    least = np.full(BANDS * BAND, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        turned = (hashes[None, at : at + 4096] ^ TURNS[0]) * (TURNS[1] | np.uint64(1))
        turned = (turned ^ turned >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, turned.min(1))
    rows = least.reshape(BANDS, BAND)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), no) for no, row in enumerate(rows)], dtype=np.uint64)


SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
AT_ONCE = 1 << 15  # shingles that are hashed at once


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all shingles in their order, repeats included; few bytes a shingle whatever the length of the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = SPACE[raw]
    words = np.where(space, np.uint8(32), raw)[~(space & np.concatenate(([True], space[:-1])))] if len(raw) else raw
    if len(words) and words[-1] == 32:
        words = words[:-1]
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    gaps = np.flatnonzero(words == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(words)]))
    if len(starts) >= shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    data, out = words.tobytes(), np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), AT_ONCE):
        some = zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist(), strict=True)
        out[at : at + AT_ONCE] = np.fromiter((xxhash.xxh64_intdigest(data[a:b], seed) for a, b in some), dtype=np.uint64)
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """Each bit is set that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        count += np.unpackbits(hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * count > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int, words: int, nodes: list | None = None) -> list[int]:
    """The fingerprint's words as unsigned integers.  nodes: gets the text's node (a digest of its shingle set) and
    bands, and the fingerprint is of distinct shingles.  Further words come from the hashes mixed once more."""
    hashes = shingle_hashes(text, shingle)
    if nodes is not None:
        hashes = np.unique(hashes)
        nodes.append((xxhash.xxh3_64_intdigest(hashes.tobytes()) if len(hashes) else 0, bands(hashes)))
    out = []
    for _ in range(words):
        out.append(majority(hashes))
        hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return out


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The columns of docs except text, f0, f1, ... (signed 64-bit words), and `node` and `bands` where the scheme needs them."""
    kept = [c for c in docs.columns if c != "text"]
    names = kept + [f"f{w}" for w in range(scheme.words)] + ["node", "bands"] * bool(scheme.similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes: list | None = [] if scheme.similarity else None
            prints = np.array([fingerprint(t.as_py(), scheme.shingle, scheme.words, nodes) for t in batch.column("text")], dtype=np.uint64)
            prints = prints.reshape(-1, scheme.words).view(np.int64)
            columns = [batch.column(c) for c in kept] + [pa.array(np.ascontiguousarray(prints[:, w])) for w in range(scheme.words)]
            if nodes is not None:
                columns.append(pa.array(np.array([n for n, _ in nodes], dtype=np.uint64).view(np.int64)))
                flat = np.concatenate([b for _, b in nodes]).view(np.int64) if nodes else np.empty(0, np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [f"{c} {t}" for c, t in docs.dtypes if c != "text"] + [f"f{w} long" for w in range(scheme.words)] + ["node long", "bands array<long>"] * bool(scheme.similarity)
    return docs.mapInArrow(run, ", ".join(kinds))


def _keys(scheme: Scheme) -> Column:
    """All keys of a fingerprint: the balls around its segments."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def ball(no: int, word: int, shift: int, width: int) -> Column:
        value = F.shiftrightunsigned(f"f{word}", shift).bitwiseAND(F.lit((1 << width) - 1))
        bits = F.sequence(F.lit(0), F.lit(width - 1))
        if scheme.radius == 1:  # of two that differ in one bit, one has it clear: setting it gives the other
            around = F.transform(bits, lambda i: value.bitwiseOR(one(i)))
        else:  # one step from either side
            around = F.transform(bits, lambda i: value.bitwiseXOR(one(i)))
        values = F.array_distinct(F.concat(F.array(value), around))
        return F.transform(values, lambda v: v.bitwiseOR(F.lit(no << 40)))

    return F.flatten(F.array(*[ball(no, *segment) for no, segment in enumerate(scheme.segments)]))


def close_prints(distance: int):
    """Whether fingerprints differ by at most that many bits: one against several."""
    return lambda one, many: np.bitwise_count(many ^ one).sum(1, dtype=np.int64) <= distance


def close_sketches(similarity: float):
    """Whether sketches agree in that share of the bins that either has anything in."""

    def close(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        a, b = np.ascontiguousarray(one).view(np.uint16), np.ascontiguousarray(many).view(np.uint16)
        same = ((a == b) & (a != EMPTY)).sum(1)
        return same >= similarity * ((a != EMPTY) | (b != EMPTY)).sum(1)

    return close


def close_sets(sets: list[np.ndarray], similarity: float):
    """Whether the sets of that number have the similarity: one against several."""
    sketches = np.array([sketch(x) for x in sets]).view(np.uint64)
    maybe = close_sketches(similarity - SLACK)

    def close(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        a, many = sets[int(one)], many.tolist()
        near = maybe(sketches[int(one)], sketches[many])
        for i in np.flatnonzero(near).tolist():
            b = sets[many[i]]
            common = len(np.intersect1d(a, b, assume_unique=True))
            near[i] = common >= similarity * (len(a) + len(b) - common) - 1e-9
        return near

    return close


def forest(prints: np.ndarray, nodes: np.ndarray, close) -> list[tuple[int, int]]:
    """Links that span the components of one bucket.  prints: (n, words), uint64."""
    nodes, first = np.unique(nodes, return_index=True)
    prints = prints[first]
    left = np.arange(1, len(nodes))
    todo, links, start = [0] if len(nodes) else [], [], 0
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        at = todo.pop()
        near = close(prints[at], prints[left])
        if near.any():
            found = left[near]
            links.extend((int(nodes[at]), int(nodes[x])) for x in found)
            todo.extend(found.tolist())
            left = left[~near]
    return links


def _bucket_links(words: int, near, limit: int):
    """For rows sorted by k0, k1: links (a, b); runs of over `limit` rows come back as they are (deferred)."""
    names = ["a", "b", "k0", "k1"] + [f"f{w}" for w in range(words)]

    def out(links, deferred):
        a, b = (np.array([x[i] for x in links], dtype=np.int64) for i in (0, 1))
        rows = np.concatenate(deferred) if deferred else np.empty((0, 3 + words), dtype=np.int64)
        n, m = len(links), len(rows)
        pad = lambda x: pa.array(np.concatenate([np.zeros(n, np.int64), x]), mask=np.arange(n + m) < n)
        columns = [pa.array(np.concatenate([a, rows[:, 2]])), pa.array(np.concatenate([b, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)]
        columns += [pad(rows[:, 0]), pad(rows[:, 1])] + [pad(rows[:, 3 + w]) for w in range(words)]
        return pa.RecordBatch.from_arrays(columns, names)

    def close(parts: list[np.ndarray], over: bool, links: list, deferred: list) -> None:
        if over:
            deferred.extend(parts)
        elif sum(map(len, parts)) > 1:
            rows = np.concatenate(parts)
            links.extend(forest(np.ascontiguousarray(rows[:, 3:]).view(np.uint64), rows[:, 2], near))

    def small(rows: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """All links in runs of at most SMALL rows, for all runs at once: each row against the next, the one after, ..."""
        sizes = np.where(sizes <= SMALL, sizes, 0)
        left = np.zeros(len(rows), dtype=np.int64)  # rows of the same run behind this one
        for k in range(1, int(sizes.max(initial=0))):
            of = np.flatnonzero(sizes > k)
            left[bounds[of + 1] - 1 - k] = k
        found, bits = [], rows[:, 3:].view(np.uint64)
        for k in range(1, int(left.max(initial=0)) + 1):
            i = np.flatnonzero(left >= k)
            i = i[rows[i, 2] != rows[i + k, 2]]
            i = i[near(bits[i], bits[i + k])]
            found += zip(rows[i, 2].tolist(), rows[i + k, 2].tolist(), strict=True)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False  # the run that is still open: its key, its rows (k0, k1, node, f0, ...)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            links, deferred = [], []
            bounds = np.concatenate(([0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1, [len(rows)]))
            done = 0  # runs of this batch that are dealt with
            if key is not None and key == tuple(rows[0, :2]):
                held.append(rows[: bounds[1]])
                done = 1
            if key is not None and (not done or len(bounds) > 2):
                close(held, over or sum(map(len, held)) > limit, links, deferred)
                key, held, over = None, [], False
            if done < len(bounds) - 1:
                sizes = np.diff(bounds)
                sizes[:done] = sizes[-1] = 0  # dealt with; still open
                links.extend(small(rows, bounds, sizes))
                for r in np.flatnonzero(sizes > SMALL).tolist():
                    if r >= done:
                        close([rows[bounds[r] : bounds[r + 1]]], bounds[r + 1] - bounds[r] > limit, links, deferred)
                key, held, over = tuple(rows[-1, :2]), [rows[bounds[-2] :]], False
            if sum(map(len, held)) > limit:
                deferred.extend(held)
                held, over = [], True
            yield out(links, deferred)
        if held:
            links, deferred = [], []
            close(held, over or sum(map(len, held)) > limit, links, deferred)
            yield out(links, deferred)

    return run, "a long, b long, k0 long, k1 long, " + ", ".join(f"f{w} long" for w in range(words))


def _links_in_buckets(rows: DataFrame, words: int, near, limit: int) -> DataFrame:
    """(a, b) of rows k0, node, f0, ...: links that span each bucket's components."""
    names = [f"f{w}" for w in range(words)]
    rows = rows.select("k0", F.lit(0).cast("long").alias("k1"), "node", *names)
    run, schema = _bucket_links(words, near, limit)
    found = stored(rows.repartition("k0").sortWithinPartitions("k0", "k1").mapInArrow(run, schema), "simhash-links")
    linked, large = found.where("k0 is null").select("a", "b"), found.where("k0 is not null")
    if large.isEmpty():
        return linked
    rows = large.select("k0", F.col("a").alias("node"), *names)
    parts = rows.groupBy("k0").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(limit)).cast("long").alias("parts"))
    rows = rows.join(parts, "k0").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    rows = rows.select("k0", pair.alias("k1"), "node", *names)
    run, schema = _bucket_links(words, near, 1 << 62)
    return linked.unionByName(rows.repartition("k0", "k1").sortWithinPartitions("k0", "k1").mapInArrow(run, schema).select("a", "b"))


def links(prints: DataFrame, scheme: Scheme, limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b): links between the nodes of `node, f0, ...` that have the components of all links within the distance."""
    keys = F.col("bands") if scheme.similarity else _keys(scheme)
    rows = prints.select(F.explode(keys).alias("k0"), "node", *[f"f{w}" for w in range(scheme.words)])
    return _links_in_buckets(rows, scheme.words, close_prints(scheme.distance), limit)


def confirmed(texts: DataFrame, scheme: Scheme, limit: int = SKETCH_LIMIT) -> DataFrame:
    """(a, b): links by exact similarity between `node, text` of the same `root`.  A large root is dealt out by pairs of
    its parts."""
    size = F.greatest(2 * F.count(F.lit(1)) / F.lit(limit), 2 * F.sum(F.octet_length("text")) / F.lit(BYTES_LIMIT))
    parts = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), size.alias("size"))
    parts = parts.select("root", F.when((F.col("n") <= limit) & (F.col("size") <= 2), 1).otherwise(F.ceil("size")).cast("long").alias("parts"))
    rows = texts.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    rows = rows.select(F.col("root").alias("k0"), pair.alias("k1"), "node", "text").repartition("k0", "k1").sortWithinPartitions("k0", "k1")

    def linked(held: list) -> pa.RecordBatch:
        found = []
        if len(held) > 1:
            found = forest(np.arange(len(held)), np.array([n for n, _ in held], dtype=np.int64), close_sets([x for _, x in held], scheme.similarity))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # of the open group, the nodes and their shingle sets
        for batch in slices(batches):
            for k0, k1, node, text in zip(*batch.columns, strict=True):
                if key != (k0.as_py(), k1.as_py()):
                    yield linked(held)
                    key, held = (k0.as_py(), k1.as_py()), []
                held.append((node.as_py(), shingle_set(text.as_py(), scheme.shingle)))
        yield linked(held)

    return rows.mapInArrow(run, "a long, b long")


def _rooted(prints: DataFrame, scheme: Scheme, by: str, limit: int = RUN_LIMIT, docs: DataFrame | None = None) -> DataFrame:
    """The columns of _key and component: the least `by` of each node's component.  docs: where a scheme with a
    similarity finds the texts by doc_id and mark."""
    words = [f"f{w}" for w in range(scheme.words)]
    if scheme.similarity:  # what has the same node has the same fingerprint and bands
        one = F.min(F.struct("doc_id", "mark")).alias("one")
        distinct = prints.groupBy("node").agg(F.min(by).alias("least"), one, *[F.min(c).alias(c) for c in (*words, "bands")])
    else:
        distinct = prints.groupBy(*words).agg(F.min(by).alias("least")).withColumn("node", F.col("f0") if scheme.words == 1 else F.xxhash64(*words))
    distinct = stored(distinct, "simhash-distinct")
    roots = components(links(distinct, scheme, limit))
    if scheme.similarity:
        wanted = distinct.join(roots, "node").select("node", "root", F.col("one.doc_id").alias("id"), F.col("one.mark").alias("mark"))
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_mark"), "text")
        same = texts["doc_id"].eqNullSafe(wanted["id"]) & (texts["text_mark"] == wanted["mark"])
        texts = stored(texts.join(wanted, same).select("root", "node", "text"), "simhash-texts")
        roots = components(confirmed(texts, scheme))
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return stored(rooted.join(smallest, "root").select(*_key(scheme), "component"), "simhash-rooted")


def _key(scheme: Scheme) -> list[str]:
    """The columns that tell nodes apart."""
    return ["node"] if scheme.similarity else [f"f{w}" for w in range(scheme.words)]


def classes(docs: DataFrame, scheme: Scheme = EXACT, limit: int = RUN_LIMIT) -> DataFrame:
    """One row per document: doc_id, f0, ..., component_id (smallest doc_id of its component)."""
    words = [f"f{w}" for w in range(scheme.words)]
    mark = [F.xxhash64("text").alias("mark")] if scheme.similarity else []
    prints = stored(fingerprints(docs.select("doc_id", *mark, "text"), scheme), "simhash-prints")
    return join_hot(prints, _rooted(prints, scheme, "doc_id", limit, docs), _key(scheme), "doc_id").select("doc_id", *words, F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, *schemes: Scheme) -> DataFrame:
    """docs with one document a component: the one with the smallest doc_id (null last), all columns.  Several schemes
    (SIMILAR if none is given): components are those of the links of all of them.

    Rows are told apart by doc_id and text; rows that share both stay or go together (exact deduplication is another
    operator's work).
    """
    mark, own = F.xxhash64("text"), None
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    schemes = schemes or (SIMILAR,)
    for scheme in schemes:
        prints = stored(fingerprints(docs.select("doc_id", mark.alias("mark"), "text"), scheme), "simhash-prints")
        rooted = _rooted(prints.select("*", rank.alias("rank")), scheme, "rank", docs=docs)
        one = join_hot(prints, rooted, _key(scheme), "doc_id").select("doc_id", "mark", "component")
        own = one if own is None else own.unionByName(one)
    if len(schemes) > 1:
        own = stored(own.select(rank.alias("rank"), "component", F.xxhash64("doc_id", "mark").alias("a"), F.xxhash64("component.doc_id", "component.mark").alias("b")), "simhash-own")
        rows = own.select("rank", "a").distinct().join(components(own.where("a <> b").select("a", "b")).withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        own = rows.join(rows.groupBy("root").agg(F.min("rank").alias("component")), "root").select("rank.doc_id", "rank.mark", "component")
    going = own.where(rank != F.col("component")).select("doc_id", "mark").distinct()
    rows = packed(docs).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text_mark"))
    same = rows["id"].eqNullSafe(going["doc_id"]) & (rows["text_mark"] == going["mark"])
    return unpacked(rows.join(going, same, "left_anti").select("row"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), EXACT)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
