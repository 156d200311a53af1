"""Near-duplicate documents by BagMinHash signatures, banding and exact verification of multiset overlap.

A document is the multiset of its shingles of five words (lower case, split at ``[\\x20\\x09-\\x0D]``); two documents are near duplicates when the
weighted Jaccard similarity of their multisets is at least 0.8.

Signatures. A shingle of count w is the levels (0, w]. Dyadic blocks (0, 1], (1, 2], (2, 4], ... each carry an independent Poisson process whose
rate is the block's length; a point falls on one of M components, and in a block that w covers only in part on one level of the block, whose bits
are drawn from the top, so points above w are left out. A component's value is the first point that falls on it, over all shingles; two
documents have the same value with a probability that is exactly their weighted Jaccard similarity. Points beyond the time at which all
components are filled aren't drawn, so a signature costs O(n + M log M).

Banding. 48 bands of 7 components: a pair at 0.8 shares no band once in 80,000 times, and is the rarer missed the closer it is. Equal texts
are one node from the start, so copies cost nothing further.

Links. In each bucket the member that shares most buckets with others is the pivot (the original of a group of edited copies is such a one), and
every member is compared with it. That links most groups, without their pairs. Buckets whose members are still in different components are
then compared completely: blocks of 2,048 members meet in pairs of blocks in numpy, and only pairs of different components whose signatures agree
on at least 0.8 less 3.5 standard errors come out. Every pair that comes out of either step is verified on its whole texts, and links make
components by hooking and contraction in tables. No bucket is capped; a bucket of n members that stay unlinked costs n^2 / 2 comparisons of 448 bytes,
dealt over (n / 2048)^2 / 2 tasks, and sends each member, 830 bytes, to n / 2048 of them. Nothing is collected, and no table is broadcast by this code: joins of tables that
grow carry a merge hint, and small ones are left to adaptive execution, which broadcasts a side only where its measured size is below the session's threshold.

Defined cases: a null text counts as empty; texts without words are equal to each other and near no other; a text of one to four words is one
shingle; null ids sort last; of repeated rows exactly one stays; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, Taken, small_batches, text_of

WIDTH, THRESHOLD, BANDS, ROWS, M = 5, 0.8, 48, 7, 448
#: Members of a block. A member of a bucket of n goes to n / BLOCK tasks; a pair of blocks makes a matrix of 32 MB.
BLOCK = 2048
#: Least estimated similarity of a pair that is verified.
LIKELY = THRESHOLD - 3.5 * (THRESHOLD * (1 - THRESHOLD) / M) ** 0.5
#: Chance that one-byte components of different values agree.
BYTE = 1 / 256

U = np.uint64
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a document, sorted, and their counts; words: a hash of each."""
    n = len(words)
    if n == 0:
        return np.empty(0, U), np.empty(0, np.int64)
    if n < WIDTH:
        return mixed((words * SPREAD[:n]).sum(keepdims=True, dtype=U) + U(n)), np.ones(1, np.int64)
    m = n - WIDTH + 1
    total = np.zeros(m, U)
    for k in range(WIDTH):
        total += words[k : k + m] * SPREAD[k]
    return np.unique(mixed(total), return_counts=True)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two documents, from the hashes of their words."""
    (x, nx), (y, ny) = shingles(a), shingles(b)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    same = int(np.minimum(nx[i], ny[j]).sum())
    return same / (int(nx.sum()) + int(ny.sum()) - same)


def bag_minhash(items: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int, reach: float = 4.0) -> np.ndarray:
    """(docs, M) first points; items, counts and doc (0 to docs - 1) name the multisets, of which none is empty."""
    out = np.full(docs * M, np.inf)
    weight = np.bincount(doc, weights=counts, minlength=docs)
    until = M / np.maximum(weight, 1) * (np.log(M) + reach)
    # Processes: block 0 is level 1; block k is the levels above 2^(k-1) up to 2^k.
    top = np.ceil(np.log2(counts)).astype(np.int64)
    which = np.repeat(np.arange(len(items)), top + 1)
    block = np.arange(len(which)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    size = np.left_shift(1, np.maximum(block - 1, 0))
    seed = mixed(items[which] + block.astype(U) * SPREAD[1])
    home, limit, at = doc[which], counts[which], np.zeros(len(which))
    part = limit < np.left_shift(1, block)  # covered in part
    step = np.zeros(1, U)
    while len(seed):
        step += SPREAD[:1]
        draw = mixed(seed + step)
        at = at - np.log(((draw >> U(11)).astype(float) + 0.5) * 2.0**-53) / size
        on = at <= until[home]
        if not on.all():
            seed, home, limit, at, size, part, draw = seed[on], home[on], limit[on], at[on], size[on], part[on], draw[on]
            if not len(seed):
                break
        more = mixed(draw ^ SPREAD[2])
        cell, value = home * M + (more % U(M)).astype(np.int64), at
        if part.any():
            level = size + 1 + ((mixed(more ^ SPREAD[3]) >> U(1)).astype(np.int64) & (size - 1))
            inside = ~part | (level <= limit)
            cell, value = cell[inside], value[inside]
        np.minimum.at(out, cell, value)
    out = out.reshape(docs, M)
    open_ = np.flatnonzero(np.isinf(out).any(axis=1))
    if len(open_):
        again = np.isin(doc, open_)
        place = np.zeros(docs, np.int64)
        place[open_] = np.arange(len(open_))
        out[open_] = bag_minhash(items[again], counts[again], place[doc[again]], len(open_), reach + 6)
    return out


def short_form(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each component, and the bucket (band and 48 bits of its values) of each band."""
    bits = mixed(first.view(U))
    band = np.zeros((len(bits), BANDS), U)
    for k in range(ROWS):
        band = mixed(band * SPREAD[4] + bits[:, k : BANDS * ROWS : ROWS])
    return (bits & U(255)).astype(np.uint8), ((band >> U(16)) | (np.arange(BANDS, dtype=U) << U(48))).astype(np.int64)


def word_list(text: Column) -> Column:
    """Words, joined by one space."""
    text = F.lower(text)
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    # Most texts have single spaces, which spares them the pattern.
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def word_hashes(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(words, " "), lambda w: F.xxhash64(w)))


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(U), offsets


def sketched(docs: DataFrame) -> DataFrame:
    """From key binary and words array<long>: key, sig binary and bands array<long> (both null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = x.column(0).to_pylist()
            values, offsets = lists(x.column(1))
            seen: dict[bytes, int] = {}
            for k, key in enumerate(keys):
                seen.setdefault(key, k)
            todo = [k for k in seen.values() if offsets[k + 1] > offsets[k]]
            sig: dict[int, bytes] = {}
            bands: dict[int, np.ndarray] = {}
            while todo:
                part, load = [], 0
                while todo and load < 400_000:
                    part.append(todo.pop())
                    load += int(offsets[part[-1] + 1] - offsets[part[-1]])
                own = [shingles(values[offsets[k] : offsets[k + 1]]) for k in part]
                doc = np.repeat(np.arange(len(part)), [len(i) for i, _ in own])
                short, buckets = short_form(bag_minhash(np.concatenate([i for i, _ in own]), np.concatenate([c for _, c in own]), doc, len(part)))
                for k, s, b in zip(part, short, buckets, strict=True):
                    sig[k], bands[k] = s.tobytes(), b
            rows = list(seen.values())
            yield pa.record_batch(
                [pa.array([keys[k] for k in rows], pa.binary()), pa.array([sig.get(k) for k in rows], pa.binary()), pa.array([bands.get(k) for k in rows], pa.list_(pa.int64()))],
                ["key", "sig", "bands"],
            )

    return docs.mapInArrow(run, "key binary, sig binary, bands array<bigint>")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities (len(a), len(b)) of one-byte signatures."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = (b == row).mean(axis=1)
    return (out - BYTE) / (1 - BYTE)


def within_buckets(rows: DataFrame) -> DataFrame:
    """rows: task, side (0 and 1: member of the first and second block; 2: of the only block), nid, root, sig, bands and bucket, dealt and
    sorted by task. Pairs (a, b) of different components that are likely near duplicates, each in the first bucket that it shares: that one
    holds different components as well, and where one of the two is its pivot, the pair has been compared already."""

    def pairs(nid: np.ndarray, root: np.ndarray, side: np.ndarray, sig: np.ndarray, bands: np.ndarray, bucket: np.ndarray) -> list[np.ndarray]:
        if side[0] == 2:
            i, j = np.nonzero(np.triu(agreement(sig, sig) >= LIKELY, 1) & (root[:, None] != root))
        else:
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = np.nonzero((agreement(sig[p], sig[q]) >= LIKELY) & (root[p][:, None] != root[q]))
            i, j = p[i], q[j]
        first = (bands[i] == bands[j]).argmax(axis=1) == bucket[0] >> 48
        return [np.stack([nid[i[first]], nid[j[first]]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for x in batches:
            own = [x.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            own.append(np.frombuffer(b"".join(x.column(4).to_pylist()), np.uint8).reshape(-1, M))
            own.append(lists(x.column(5))[0].view(np.int64)[: BANDS * x.num_rows].reshape(-1, BANDS))
            own.append(x.column(6).to_numpy())
            if rest is not None:
                own = [np.concatenate([r, o]) for r, o in zip(rest, own, strict=True)]
            task = own[0]
            edge = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            out = [p for a, b in zip(edge[:-1], edge[1:], strict=True) for p in pairs(*(own[k][a:b] for k in (2, 3, 1, 4, 5, 6)))]
            rest = [o[edge[-1] :] for o in own]
            if out:
                yield found(out)
        if rest is not None:
            yield found(pairs(*(rest[k] for k in (2, 3, 1, 4, 5, 6))))

    def found(out: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(out, axis=1)
        return pa.record_batch([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, words_a, words_b; those with an overlap of at least THRESHOLD, and the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            (v, p), (w, q) = lists(x.column(2)), lists(x.column(3))
            same = np.array([overlap(v[p[k] : p[k + 1]], w[q[k] : q[k + 1]]) for k in range(x.num_rows)], float)
            hit = pa.array(same >= THRESHOLD)
            yield pa.record_batch([x.column(0).filter(hit), x.column(1).filter(hit), pa.array(same).filter(hit)], ["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double")


def components(edges: DataFrame, done: Settled, tag: str) -> DataFrame:
    """(nid, root) of every node of an edge (a, b); root is the component's smallest node. Each round hooks every root on its smallest
    neighbour, follows two hooks on, and contracts the edges."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = done.keep(ends.select("u").union(ends.select("v")).distinct().select(F.col("u").alias("nid"), F.col("u").alias("root")), f"{tag}-label0")
    k = 0
    while not ends.isEmpty():
        k += 1
        both = ends.union(ends.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("p")).filter("p < u")
        for _ in range(2):
            after = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(after, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        hook = done.keep(hook, f"{tag}-hook{k}")
        label = done.keep(label.join(hook.select(F.col("u").alias("root"), "p"), "root", "left").select("nid", F.coalesce("p", "root").alias("root")), f"{tag}-label{k}")
        ends = ends.join(hook.select("u", F.col("p").alias("pu")), "u", "left").join(hook.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", "left")
        ends = ends.select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")).filter("u <> v")
        ends = done.keep(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{tag}-ends{k}")
        if k > 1:
            for name in ("label", "ends", "hook"):
                done.drop(f"{tag}-{name}{k - 1}")
    return label


def linked(keyed: DataFrame) -> DataFrame:
    """(key, root) of every distinct text that is near another one; keyed: words, and key, their MD5; root: a number of its class."""
    done = Settled(keyed.sparkSession, "near")
    nodes = sketched(keyed.select("key", word_hashes(F.col("words")).alias("hashes"))).filter("sig is not null").groupBy("key").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = done.keep(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    # Buckets of two members and more, each with its pivot.
    bands = nodes.select("nid", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = done.keep(bands.join(buckets.hint("merge"), "bucket"), "members")
    central = members.groupBy("nid").agg(F.sum("n").alias("central"))
    ranked = members.join(central.hint("merge"), "nid").select("bucket", "nid", F.struct("central", "nid").alias("c"))
    pivots = done.keep(ranked.groupBy("bucket").agg(F.max("c").alias("c")).select("bucket", F.col("c.nid").alias("pivot")), "pivots")
    stars = members.join(pivots.hint("merge"), "bucket").filter("nid <> pivot").select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")).distinct()
    sig = nodes.select("nid", "sig")
    near = done.keep(likely(stars, sig), "likely")

    # Texts of the nodes that a likely pair of the first step holds; the second step adds few.
    texts = texts_of(near, nodes, keyed, done, "texts")
    links = done.keep(compared(near, texts), "links")
    label = components(links, done, "star")

    # Buckets that still hold different components.
    placed = members.filter("n > 2").join(label.hint("merge"), "nid", "left").select("bucket", "nid", "n", F.coalesce("root", "nid").alias("root"))
    mixed_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    mixed_ = placed.join(mixed_.hint("merge"), "bucket").join(pivots.hint("merge"), "bucket").filter("nid <> pivot")
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("nid"), count).cast("int")
    tasks = mixed_.select("bucket", "nid", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") == low, 0).otherwise(1)
    tasks = tasks.select(F.xxhash64("bucket", low, high).alias("task"), side.alias("side"), "nid", "root", "bucket").join(nodes.select("nid", "sig", "bands").hint("merge"), "nid")
    tasks = tasks.select("task", "side", "nid", "root", "sig", "bands", "bucket").repartition("task").sortWithinPartitions("task")
    more = done.keep(within_buckets(tasks).distinct(), "more")
    extra = compared(more, texts_of(more, nodes, keyed, done, "texts2")) if not more.isEmpty() else links.limit(0)
    links = links.unionByName(done.keep(extra, "links2"))
    label = components(links.select("a", "b"), done, "all")
    roots = done.keep(label.join(nodes.select("nid", "key").hint("merge"), "nid").select("key", "root"), "roots")
    done.drop_all_but("roots")
    return roots


def likely(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in at least LIKELY of their components. Bytes are compared in numpy."""
    left, right = sig.select(F.col("nid").alias("a"), F.col("sig").alias("x")), sig.select(F.col("nid").alias("b"), F.col("sig").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, q = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, M) for k in (2, 3))
            hit = pa.array(((p == q).mean(axis=1) - BYTE) / (1 - BYTE) >= LIKELY)
            yield pa.record_batch([x.column(0).filter(hit), x.column(1).filter(hit)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def texts_of(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, done: Settled, tag: str) -> DataFrame:
    """(nid, words) of the nodes in the pairs."""
    need = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct().join(nodes.select("nid", "key"), "nid")
    return done.keep(keyed.join(need.hint("merge"), "key").groupBy("key", "nid").agg(F.first("words").alias("words")).select("nid", "words"), tag)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left, right = texts.select(F.col("nid").alias("a"), F.col("words").alias("wa")), texts.select(F.col("nid").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return verified(both.select("a", "b", word_hashes(F.col("wa")).alias("words_a"), word_hashes(F.col("wb")).alias("words_b")))


def key_of(text: str) -> Column:
    return F.unhex(F.md5(word_list(text_of(text))))


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id (doc_id), class_id (smallest id of the class), class_size, kept (one row of each class) and key."""
    own, done = Taken(docs), Settled(docs.sparkSession, "class")
    # Words are cut once; what follows reads this table.
    words = own.rows.select(F.col(own.at(doc_id)).alias("doc_id"), word_list(text_of(own.at(text))).alias("words"))
    rows = done.keep(words.select("doc_id", F.unhex(F.md5("words")).alias("key"), F.monotonically_increasing_id().alias("r"), "words"), "rows")
    root = linked(rows.select("key", "words"))
    rows = done.keep(rows.drop("words"), "ids")
    done.drop("rows")
    named = rows.join(root.hint("merge"), "key", "left").withColumn("c", F.coalesce(F.col("root").cast("string"), F.hex("key")))
    best = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), F.col("r").alias("r"))).alias("b"), F.count(F.lit(1)).alias("class_size"))
    return named.join(best.hint("merge"), "c").select("doc_id", F.col("b.i").alias("class_id"), "class_size", (F.col("r") == F.col("b.r")).alias("kept"), "key")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each class one with the smallest id."""
    own = Taken(docs)
    keep = near_classes(docs, text, doc_id).filter("kept").select("key", F.col("doc_id").alias("id"))
    # Rows that share both the id and the words of the one that stays are its repetitions; the join has put them together.
    rows = own.rows.withColumn("key", key_of(own.at(text))).join(keep.hint("merge"), "key").filter(F.col(own.at(doc_id)).eqNullSafe(F.col("id")))
    return own.back(rows.dropDuplicates(["key"]), own.stay())


def op2(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    small_batches(spark)
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")
