"""Operator 4: near-duplicate documents by consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import flat_bytes, gram_hashes, mix, slices, small_side, stored, word_hashes

SHINGLE = 5
#: Samples of a signature: 16 bands of 3. A bucket is a pair of bands out of the same group of bands, so it needs six
#: equal samples. Groups of 6, 5 and 5 bands give 35 buckets a document, and at a similarity of 0.8 two documents share
#: at least one with probability 0.997 (0.9998 at 0.85).
BAND_ROWS, BAND_GROUPS = 3, (6, 5, 5)
SAMPLES = BAND_ROWS * sum(BAND_GROUPS)
#: Equal samples, of 48, below which a pair is not compared further: at a similarity of 0.8, 38.4 are expected with a
#: deviation of 2.8, so that a similar pair falls below with probability 1e-6.
LEAST_EQUAL = 24
#: Nodes of one bucket, on either side, that are compared at a time, rows of such blocks in one task, and shingles held next to each other.
BLOCK_NODES, BLOCK_ROWS, BLOCK_SHINGLES = 256, 4096, 1 << 20
#: Bytes of texts that meet in one task, about.
TASK_BYTES = 8 << 20
#: Counters of the sketch that finds the shingles whose documents are counted.
CELL_BITS = 20
#: Shingles in less than this share of all documents have the full weight.
RARE = 1 / 500
#: How far a rare shingle outweighs one that is in every document. Mild, because shingles of a large group of
#: near copies are frequent for that very reason.
IDF_SPAN = 0.25

_rng = np.random.default_rng(20240229)
_POOL = 1 << 16  # random variates are drawn from pools of this size by 16 bits of a hash each
_R = _rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
_R_INV = 1 / _R
_LN_C = np.log(_rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
_BETA = _rng.random(_POOL).astype(np.float32)
_SEEDS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)[:, None]
_PAIRS = np.array([p for n, first in zip(BAND_GROUPS, np.cumsum((0,) + BAND_GROUPS)) for p in combinations(range(first, first + n), 2)])


def shingles_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every text its distinct shingle hashes, ascending, and how often each occurs.

    A shingle is five words; a text of fewer words, but not none, is one shingle.
    """
    for part in slices(texts):
        words, at = word_hashes(*flat_bytes(part))
        grams = gram_hashes(words, SHINGLE)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else gram_hashes(words[a:b], b - a) if b > a else grams[:0]
            yield np.unique(own, return_counts=True)


def cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Idf:
    """Inverse document frequencies: 1 + IDF_SPAN for rare shingles, down to 1 for those in every document.

    ``frequent`` (ascending) are the shingles in at least the share ``RARE``
    of the documents, with their exact weights; in between, the weight falls
    with the logarithm of the share. It depends on shares alone, so two texts are as
    similar in a small corpus as in a large one of the same mixture. The number of such shingles is
    at most the mean number of shingles in a document, divided by ``RARE``, whatever the number of documents.
    """

    def __init__(self, frequent: np.ndarray, share: np.ndarray):
        self.frequent = frequent
        self.weights = 1.0 + IDF_SPAN * np.clip(np.log(1 / np.maximum(share, RARE)) / np.log(1 / RARE), 0.0, 1.0)
        self.maybe = np.zeros(1 << CELL_BITS, bool)
        self.maybe[cells(frequent)] = True

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), 1.0 + IDF_SPAN)
        at = np.flatnonzero(self.maybe[cells(shingles)])
        if len(at):
            place = np.minimum(np.searchsorted(self.frequent, shingles[at]), len(self.frequent) - 1)
            known = self.frequent[place] == shingles[at]
            out[at[known]] = self.weights[place[known]]
        return out


def weigh(shingles: np.ndarray, counts: np.ndarray, idf: Idf) -> np.ndarray:
    return (1.0 + np.log(counts)) * idf.of(shingles)


def sample(shingles: np.ndarray, weights: np.ndarray, block: int = 2048) -> np.ndarray:
    """Improved consistent weighted sampling: 48 samples, each equal for two sets with the probability of their weighted Jaccard similarity."""
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    ln_w, row = np.log(weights).astype(np.float32), np.arange(SAMPLES)
    for at in range(0, len(shingles), block):
        u = shingles[at : at + block]
        h = (u ^ _SEEDS) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        part = h.view(np.uint16).reshape(SAMPLES, len(u), 4)  # three of the four 16-bit parts pick the variates
        r, beta = _R[part[:, :, 1]], _BETA[part[:, :, 3]]
        t = _R_INV[part[:, :, 1]]
        t *= ln_w[at : at + block]
        t += beta
        np.floor(t, out=t)
        ln_a = t - beta
        ln_a += np.float32(1)
        ln_a *= r
        np.subtract(_LN_C[part[:, :, 2]], ln_a, out=ln_a)
        first = ln_a.argmin(axis=1)
        low = ln_a[row, first]
        better = low < best
        best[better] = low[better]
        drawn = mix(u[first] + t[row, first].astype(np.int64).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        out[better] = drawn[better]
    return out


def bucket_keys(samples: np.ndarray) -> np.ndarray:
    bands = gram_hashes(samples, BAND_ROWS)[::BAND_ROWS]
    a, b = _PAIRS.T
    return mix(mix(bands[a] * np.uint64(3) + bands[b]) + np.arange(len(_PAIRS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: Idf) -> float:
    """Weighted Jaccard similarity of two texts' shingles: sum of the smaller weights by sum of the larger."""
    wa, wb = weigh(*a, idf), weigh(*b, idf)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    all_ = wa.sum() + wb.sum() - both
    return float(both / all_) if all_ else 0.0


def inverse_frequencies(texts: DataFrame) -> Idf:
    """The weights of all shingles, from the documents among ``texts`` (one column, ``text``) that hold them.

    A sketch of fixed size adds 1 to a shingle's cell for every document that
    holds it. Only shingles in cells of at least the share ``RARE`` can be frequent;
    these are counted exactly, with partial sums in every task.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, docs = np.zeros(1 << CELL_BITS, np.int64), 0
        for part in parts:
            for piece in slices(part.column(0)):
                found = [cells(u) for u, _ in shingles_of(piece)]
                docs += len(found)
                np.add.at(load, np.concatenate(found), 1)
        rows = load.astype(np.uint32 if load.max() < 1 << 32 else np.uint64).reshape(256, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(256)], pa.int32()), pa.array([docs, *[0] * 256], pa.int64()),
             pa.array([b"", *[r.astype(np.uint64).tobytes() for r in rows]], pa.binary())], names=["slice", "docs", "load"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for part in parts:
            for at, docs, load in zip(*(c.to_pylist() for c in part.columns)):
                one = total.setdefault(at, [0, np.zeros(len(load) // 8, np.uint64)])
                one[0] += docs
                one[1] += np.frombuffer(load, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()),
             pa.array([t[1].tobytes() for t in total.values()], pa.binary())], names=["slice", "docs", "load"])

    schema = "slice int, docs long, load binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect()  # 8 MB
    got = {r["slice"]: r for r in rows}
    docs = got[-1]["docs"] if -1 in got else 0
    if not docs:
        return Idf(np.zeros(0, np.uint64), np.zeros(0))
    load = np.concatenate([np.frombuffer(got[i]["load"], np.uint64) for i in range(256)])
    least = int(np.ceil(RARE * docs))
    full = texts.sparkSession.sparkContext.broadcast(load >= least)

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part.column(0)):
                found = np.concatenate([u[full.value[cells(u)]] for u, _ in shingles_of(piece)] or [np.zeros(0, np.uint64)])
                u, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counted = texts.select("text").mapInArrow(exact, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = counted.toArrow()  # see Idf for the bound
    shingles = counted.column(0).to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return Idf(shingles[order], counted.column(1).to_numpy()[order] / docs)


def components(edges: DataFrame) -> DataFrame:
    """(nid, label): the smallest node of the connected part of every node of ``edges`` (a, b).

    Each step takes the least label among a node's neighbours and then the label
    of that label, so chains shorten by more than half each time.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("nid")).agg(F.min("b").alias("m")).select("nid", F.least("nid", "m").alias("label")), "labels")
    n = labels.count()
    while n:
        seen = both.join(small_side(labels.select(F.col("nid").alias("b"), "label"), n), "b")
        low = seen.groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("m"))
        low = stored(labels.join(low, "nid").select("nid", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels", n)
        jump = small_side(low.select(F.col("nid").alias("label"), F.col("label").alias("further")), n)
        moved = stored(low.join(jump, "label").select("nid", "old", F.least("label", "further").alias("label")), "labels", n)
        labels = moved.select("nid", "label")
        if not moved.where("old <> label").limit(1).count():
            break
    return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = 2) -> DataFrame:
    """Put every document into a class of near duplicates.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. A
    document's shingles are weighted by (1 + ln tf) x idf, with document
    frequencies over all documents. Equal texts are one node. Nodes whose
    signatures share a bucket are compared on their whole texts; those with a weighted Jaccard
    similarity of at least ``threshold`` are linked, and a class is a
    connected part.

    No bucket is capped. Most links are found in ``rounds`` that compare all
    nodes of a bucket with one of them, its centre. The first centre is the node that meets
    most others over all its buckets: the original among its edited copies,
    and the same one in many buckets. In each of the later ``rounds`` it is another node for every
    bucket, and only nodes of another class than the centre's are compared.
    Then the buckets that still hold several classes are finished: every node
    outside a bucket's largest class is compared with all nodes of other
    classes in it (``_links_of_rest``), so the classes don't depend on the centres.

    Returns one row per input row: the id, ``class_id`` (the smallest id in
    the class), ``class_size`` (rows), ``text_md5``, and ``class_md5`` (the smallest MD5 of the class's texts, which
    tells classes apart also where ids are null or repeated; null for null texts). Documents with null text are each a class of their
    own, with their own id. Texts without words (also the empty text) are
    only ever equal to the very same text. Repeated rows are copies of each other. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows))

    width = -np.log(threshold * (1 - 1e-9))

    @F.arrow_udf("struct<keys:array<bigint>,samples:binary,bin:int>")
    def sketch(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            keys, at, drawn, bins = [], [0], [], []
            for u, n in shingles_of(part):
                w = weigh(u, n, idf.value)
                s = sample(u, w) if len(u) else None
                bins.append(int(np.log(w.sum()) / width) if len(u) else 0)
                keys.append(bucket_keys(s).astype(np.int64) if len(u) else np.zeros(0, np.int64))
                at.append(at[-1] + len(keys[-1]))
                drawn.append(s.astype(np.uint16).tobytes() if len(u) else b"")
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), pa.array(drawn, pa.binary()), pa.array(bins, pa.int32())],
                                             names=["keys", "samples", "bin"])

    md5 = F.md5(F.col("text").cast("binary"))
    nodes = rows.select("id", md5.alias("text_md5"), F.octet_length("text").alias("bytes"), sketch("text").alias("s")).groupBy("text_md5").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("s").alias("s"), F.first("bytes").alias("bytes"))
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()), "dedup-nodes")

    buckets = nodes.select("nid", F.col("s.bin").alias("bin"), "bytes", F.posexplode("s.keys").alias("pair", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = buckets.join(shared, "key")
    members = stored(members, "dedup-members")
    degree = members.groupBy("nid").agg(F.sum("n").alias("degree"))
    n_hit = degree.count()
    members = stored(members.join(small_side(degree, n_hit), "nid").select("key", "pair", "nid", "bin", "bytes", "degree"), "dedup-members")
    hit = stored(members.select("nid").distinct(), "dedup-hit")
    wanted = nodes.join(small_side(hit, hit.count()), "nid").select("nid", F.col("text_md5").alias("md5"), F.col("first_id"), F.col("s.samples").alias("samples"),
                                                                        F.col("s.keys").alias("keys"), "bytes")
    wanted = stored(wanted, "dedup-wanted")
    n_wanted = wanted.count()
    texts = rows.join(small_side(wanted.select("nid", "md5", "first_id"), n_wanted), (md5 == F.col("md5")) & F.col("id").eqNullSafe(F.col("first_id")))
    texts = stored(texts.groupBy("nid").agg(F.first("text").alias("text")), "dedup-texts")

    links, checked, labels, n_labels = None, None, None, 0
    for round_ in range(rounds if n_wanted else 0):
        pairs = _pairs_of_round(members, labels, n_labels, round_)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        new = _compare(stored(pairs, "dedup-pairs"), wanted, n_wanted, texts, idf, threshold)
        found = new.where("linked").select("a", "b")
        links = found if links is None else links.union(found)
        checked = new if checked is None else checked.union(new)
        labels = components(links)
        n_labels = labels.count()
    if labels is None:
        nodes = nodes.withColumn("label", F.col("nid"))
    else:
        nodes = nodes.join(small_side(labels, n_labels), "nid", "left")
    nodes = nodes.withColumn("label", F.coalesce("label", "nid"))
    if labels is not None:
        merged = components(_links_of_rest(members, labels, n_labels, wanted, n_wanted, texts, idf, threshold))
        merged = merged.select(F.col("nid").alias("label"), F.col("label").alias("further"))
        nodes = nodes.join(small_side(merged, merged.count()), "label", "left").withColumn("label", F.coalesce("further", "label"))
    nodes = stored(nodes.select("text_md5", "first_id", "copies", "label"), "dedup-labels")
    classes = nodes.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"),
                                         F.min("text_md5").alias("class_md5"))
    of_text = stored(nodes.join(classes, "label").select(F.col("text_md5").alias("_md5"), "class_id", "class_size", "class_md5"), "dedup-classes")
    ids = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("text_md5"))
    return ids.join(small_side(of_text, of_text.count()), F.col("text_md5") == F.col("_md5"), "left").select(
        F.col("id").alias(id_col), F.when(F.col("text_md5").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_md5", "class_md5")


def _pairs_of_round(members: DataFrame, labels: DataFrame | None, n_labels: int, round_: int) -> DataFrame:
    """The (a, b) pairs of nodes to compare: the members (key, nid) of each bucket with its centre of this round."""
    if round_:  # only buckets that hold several classes
        known = small_side(labels, n_labels)
        members = members.join(known, "nid", "left").select("key", "nid", "degree", F.coalesce("label", "nid").alias("label"))
        open_ = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
        members = stored(members.join(open_, "key"), "dedup-open")
        # Flipping bits that depend on bucket and round makes some node the least one.
        flip = F.xxhash64("key", F.lit(round_))
        centres = members.groupBy("key").agg(F.min(F.col("nid").bitwiseXOR(flip)).alias("c")).select("key", F.col("c").bitwiseXOR(flip).alias("centre"))
        of_centre = small_side(labels.select(F.col("nid").alias("centre"), F.col("label").alias("cl")), n_labels)
        centres = centres.join(of_centre, "centre", "left").select("key", "centre", F.coalesce("cl", "centre").alias("cl"))
        trial = members.join(centres, "key").where("label <> cl")
    else:
        first = members.groupBy("key").agg(F.max(F.struct("degree", "nid")).alias("c")).select("key", F.col("c.nid").alias("centre"))
        trial = members.join(first, "key").where("nid <> centre")
    return trial.select(F.least("nid", "centre").alias("a"), F.greatest("nid", "centre").alias("b")).distinct()


def _compare(pairs: DataFrame, wanted: DataFrame, n_wanted: int, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, linked) for every pair of nodes: signatures first, then whole texts."""

    @F.arrow_udf("int")
    def equal(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), SAMPLES) for c in (a, b))
        return pa.array((x == y).sum(axis=1), pa.int32())

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y, idf.value) for x, y in zip(shingles_of(a), shingles_of(b))], pa.float64())

    signed = small_side(wanted.select("nid", "samples"), n_wanted, 100_000)
    near = (pairs.join(signed.select(F.col("nid").alias("a"), F.col("samples").alias("sa")), "a")
            .join(signed.select(F.col("nid").alias("b"), F.col("samples").alias("sb")), "b")
            .select("a", "b", equal("sa", "sb").alias("n")))
    near = stored(near, "dedup-near")
    close = near.where(F.col("n") >= LEAST_EQUAL).select("a", "b")
    n = close.count()
    one = texts.withColumnRenamed("nid", "a").join(small_side(close, n), "a").select("a", "b", F.col("text").alias("ta"))
    two = texts.withColumnRenamed("nid", "b").join(small_side(close, n), "b").select("a", "b", F.col("text").alias("tb"))
    same = one.join(two, ["a", "b"]).select("a", "b", (alike("ta", "tb") >= threshold).alias("linked"))
    return stored(near.select("a", "b").join(same, ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked")),
                  "dedup-compared")


def _links_of_rest(members: DataFrame, labels: DataFrame, n_labels: int, wanted: DataFrame, n_wanted: int, texts: DataFrame, idf,
                   threshold: float) -> DataFrame:
    """(a, b): labels of classes to merge, from all pairs of nodes of different classes that share a bucket.

    A bucket is first split by the sums of the nodes' weights: two texts of at least
    ``threshold`` have sums within that ratio, so their bins are the same or next to each other, and every node goes
    to the parts of its own bin and the next. One node of each pair lies
    outside the part's largest class. These nodes and all nodes of the part
    are dealt into blocks by hashes of the nodes, of some ``BLOCK_NODES`` nodes and ``TASK_BYTES`` of text at most on
    either side, so that rows grow with the pairs by that factor and a crowded bucket
    is spread over many tasks. A pair with ``LEAST_EQUAL`` equal samples is compared on the
    whole texts, in the first bucket that it shares only. A block returns
    the links that join its classes, not every link.
    """
    own = members.join(small_side(labels, n_labels), "nid", "left").select(
        "key", "pair", "nid", "bin", "bytes", F.coalesce("label", "nid").alias("label"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("span"))
    sizes = own.groupBy("key", "span", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy("key", "span").agg(
        F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("most.n < n")

    def cuts(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / TASK_BYTES))

    sizes = sizes.select("key", "span", F.col("most.label").alias("largest"),
                         cuts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("rows"), cuts(F.col("n"), F.col("bytes")).alias("cols"))
    open_ = stored(own.join(sizes, ["key", "span"]).withColumn("rest", F.col("label") != F.col("largest")), "dedup-open")
    dealt = F.xxhash64("nid", F.lit(1))
    left = open_.where("rest").withColumn("row", F.pmod(dealt, "rows")).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    right = open_.withColumn("col", F.pmod(dealt, "cols")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    blocks = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False))).select(
        F.xxhash64("key", "span", "row", "col").alias("block"), "pair", "nid", "bin", "span", "label", "rest", "asks")
    blocks = stored(blocks, "dedup-blocks")
    parts = 1 + blocks.count() // BLOCK_ROWS
    signed = small_side(wanted.select("nid", "samples", "keys"), n_wanted, 25_000)

    def near(rows: pa.Table) -> pa.Table:
        block, pair, nid, label, bin_, span = (rows.column(c).to_numpy() for c in ("block", "pair", "nid", "label", "bin", "span"))
        rest, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "asks"))
        drawn = np.frombuffer(b"".join(rows.column("samples").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, len(_PAIRS))
        order = np.argsort(block, kind="stable")
        out = [[], [], [], [], []]
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            i, j = at[asks[at]], at[~asks[at]]
            other = (label[i][:, None] != label[j]) & (~rest[j] | (nid[i][:, None] < nid[j]))
            other &= np.maximum(bin_[i][:, None], bin_[j]) == span[at[0]]  # two nodes of one bin meet in two parts
            x, y = np.nonzero(other)
            x, y = i[x], j[y]
            close = (drawn[x] == drawn[y]).sum(axis=1) >= LEAST_EQUAL
            x, y = x[close], y[close]
            here = (keys[x] == keys[y]).argmax(axis=1) == pair[at[0]]
            x, y = x[here], y[here]
            if len(x):
                ids, first, of = np.unique(nid[np.concatenate([x, y])], return_index=True, return_inverse=True)
                for c, v in zip(out, (block[at[0]], ids, label[np.concatenate([x, y])[first]], of[: len(x)], of[len(x) :])):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in out[1:]]], names=["block", "nids", "labels", "a", "b"])

    schema = "block long, nids array<long>, labels array<long>, a array<long>, b array<long>"
    found = stored(blocks.join(signed, "nid").withColumn("part", F.pmod("block", F.lit(parts))).groupBy("part").applyInArrow(near, schema), "dedup-rest")
    sized = wanted.select("nid", "bytes")
    held = found.select("block", F.explode("nids").alias("nid")).join(small_side(sized, n_wanted), "nid").agg(F.sum("bytes")).first()[0] or 0
    parts = 1 + held // TASK_BYTES
    result = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        uniq, first = np.unique(texts.column("nid").to_numpy(), return_index=True)
        shingles = dict(zip(uniq.tolist(), shingles_of(texts.column("text").combine_chunks().take(pa.array(first)))))
        links = [p for nids, labels, a, b in zip(*(pairs.column(c).to_pylist() for c in ("nids", "labels", "a", "b")))
                 for p in joining([shingles[i] for i in nids], np.array(labels), np.array(a), np.array(b), idf.value, threshold)]
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in links], schema=result)

    needed = found.select(F.pmod("block", F.lit(parts)).alias("part"), F.explode("nids").alias("nid")).distinct().join(texts, "nid")
    pairs = found.select(F.pmod("block", F.lit(parts)).alias("of_part"), "nids", "labels", "a", "b")
    links = needed.select("part", "nid", "text").groupBy("part").cogroup(pairs.groupBy("of_part")).applyInArrow(link, "a long, b long")
    return stored(links.distinct(), "dedup-merged")


def joining(own: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, a: np.ndarray, b: np.ndarray, idf: Idf,
            threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of labels joined by the pairs (a, b) of texts of at least ``threshold``; pairs that are joined already are passed over."""
    weights = [weigh(*o, idf) for o in own]
    total, length, now = np.array([w.sum() for w in weights]), np.array([len(w) for w in weights]), labels.copy()
    least = threshold * (1 - 1e-9)  # sums in another order may differ in their last bits; ``similarity`` decides
    order = np.argsort(a, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        i, others = int(a[at[0]]), b[at]
        u, w = own[i][0], weights[i]
        others = others[(now[others] != now[i]) & (np.minimum(total[others], total[i]) >= least * np.maximum(total[others], total[i]))]
        for run in np.split(others, np.flatnonzero(np.diff(np.cumsum(length[others]) // BLOCK_SHINGLES)) + 1):
            run = run[now[run] != now[i]]
            if not len(run):
                continue
            theirs, heavy = np.concatenate([own[j][0] for j in run]), np.concatenate([weights[j] for j in run])
            place = np.minimum(np.searchsorted(u, theirs), len(u) - 1)
            shared = np.where(u[place] == theirs, np.minimum(w[place], heavy), 0.0)
            both = np.add.reduceat(shared, np.concatenate([[0], np.cumsum(length[run])[:-1]]))
            for j in run[both >= least * (total[i] + total[run] - both)].tolist():
                if now[j] != now[i] and similarity(own[i], own[j], idf) >= threshold:
                    yield int(labels[i]), int(labels[j])
                    now[now == now[j]] = now[i]


def keep_first(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, of which each class of near duplicates keeps the one with the smallest id.

    Of rows that repeat that id, with the same text or another text of the class, one stays. Texts of different classes all stay,
    also if they have the same id or none. Documents with null text all stay, but for repeated ids, of which one row
    stays; those without an id are all different documents.
    """
    found = near_duplicates(docs, threshold, id_col, text_col)
    first = found.where(F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("text_md5").isNotNull() | F.col(id_col).isNotNull()))
    kept = stored(first.groupBy(F.col("class_md5"), F.when(F.col("class_md5").isNull(), F.col(id_col)).alias("_alone")).agg(
        F.first(id_col).alias("_id"), F.min("text_md5").alias("_md5"), F.count("*").alias("_rows")).select("_id", "_md5", "_rows"), "dedup-kept")
    n = kept.count()
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*own).alias("_row"), F.col(id_col).alias("_rid"), F.md5(F.col(text_col).cast("binary")).alias("_rmd5"))
    joined = keyed.join(small_side(kept, n), F.col("_rid").eqNullSafe(F.col("_id")) & F.col("_rmd5").eqNullSafe(F.col("_md5")))
    single = joined.where("_rows = 1").select("_row")
    # Only rows that repeat an id are brought together.
    repeated = joined.where("_rows > 1").groupBy("_id", "_md5").agg(F.first("_row").alias("_row")).select("_row")
    unnamed = keyed.where(F.col("_rid").isNull() & F.col("_rmd5").isNull()).select("_row")
    return single.union(repeated).union(unnamed).select("_row.*")
