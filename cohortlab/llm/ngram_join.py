"""Near-duplicate join: Jaccard similarity of word n-gram sets, by MinHash banding and exact verification.

1. Texts with the same words are one *class* (128-bit digest of the lower-cased words); only one representative of each
   goes on, with the number of its documents.
2. Every text gets ``bands x rows`` minima; bands and rows are chosen so that a pair at the threshold shares a band with
   the target recall, at the least chance for pairs far below it. Bands are hashed and shuffled; a band value of several
   classes is a bucket.
3. In a bucket, pairs whose share of equal minima is near the threshold or above are linked; a bucket gives out links to
   the first member of each linked set, never its pairs. Buckets over ``BLOCK`` members are cut into blocks, and every
   pair of blocks is a unit of work of its own, so no task holds a large bucket and none of its pairs is left out.
   Connected sets of these links are the candidate groups.
4. Groups are verified on whole n-gram sets, each pair of members once, again in pairs of blocks, whose number follows the
   group's members and n-grams. The verified links are counted, and their connected sets are the near-duplicate classes.

Classes are named by numbers that are dealt when the list of classes is written, so no two share a name; n-grams are
compared by 64-bit hashes within pairs.

Defined cases: a text of fewer words than n has one n-gram, all its words; a null or blank text has none and is a class
of its own with no links; equal documents link to each other; a class id is the least doc_id of its documents (a null
doc_id counts as the largest); rows that repeat are documents each; ties of a similarity with the threshold are links; a
very long text is compared whole, in a block of its own; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import by_bytes, drop, frame, mix64, save, sieved, utf8

N, THRESHOLD, TARGET_RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Members of a block of a bucket; members and n-grams of a block of a candidate group.
BLOCK, VERIFY_BLOCK, VERIFY_GRAMS = 256, 256, 1 << 20
_SEED = 7


@lru_cache
def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """``bands, rows``: of those that reach the recall at the threshold with at most ``most`` minima, the one whose
    chance to share a band, taken over all similarities below the threshold, is least."""
    grid, best = np.linspace(0, threshold, 200), None
    for rows in range(1, min(most, 300) + 1):
        share = threshold**rows  # the chance of equal minima in one band
        wanted = np.log1p(-recall) / np.log1p(-share) if share < 1 else 1.0
        if wanted * rows <= most and (bands := max(1, int(np.ceil(wanted)))) * rows <= most:
            false = float((1 - (1 - grid**rows) ** bands).mean())
            best = min(best or (false, bands, rows), (false, bands, rows))
    if best is None:
        raise ValueError("the recall can't be reached with so few minima")
    return best[1], best[2]


def slack(threshold: float, hashes: int) -> float:
    """The share of equal minima below which a pair is no candidate: five standard errors under the threshold."""
    return threshold - 5 * float(np.sqrt(threshold * (1 - threshold) / hashes))


class _Words(dict):
    """Hashes of words, emptied after each task: Python workers live on beside the stages after theirs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _release() -> None:
    _words.clear()
    pa.default_memory_pool().release_unused()


def shingles(words: list[bytes], n: int = N) -> np.ndarray:
    """The distinct n-grams as ascending 64-bit hashes."""
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = max(1, min(n, len(h)))
    if not len(h):
        return h
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


@lru_cache
def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(1, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """``len(sets) x hashes`` minima of 32-bit hashes; the sets are not empty."""
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), hashes), np.uint32)
    for j, (a, b) in enumerate(zip(*_multipliers(hashes), strict=True)):
        x = low * a + (high ^ b)
        x ^= x >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, h, key, n_grams, minima``: the digest of the text, that of its words, how many n-grams it has, and the
    minima; the last three are null for a text without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids, hashes = b["t"].tolist(), b["id"].tolist(), b["h"].tolist()
            for a, z in by_bytes([len(t) for t in texts], 1 << 19):
                split = [t.lower().split() for t in texts[a:z]]
                some = [i for i, ws in enumerate(split) if ws]
                sets = [shingles(split[i], n) for i in some]
                found = dict(zip(some, zip(map(len, sets), minima(sets, bands * rows) if some else [], strict=True), strict=True))
                rest = lambda k, ws: (hashlib.md5(b" ".join(ws)).digest(), found[k][0], found[k][1].tobytes()) if ws else (None, None, None)
                yield frame([(None if pd.isna(i) else int(i), h, *rest(k, ws)) for k, (i, h, ws) in enumerate(zip(ids[a:z], hashes[a:z], split, strict=True))], ["id", "h", "key", "n_grams", "minima"])
        _release()

    return _texts(docs, id_col, text_col).mapInPandas(run, "id long, h string, key binary, n_grams long, minima binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).withColumn("h", F.md5("t"))


def band_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """``rep, band``: a row per representative and band, ``band`` a hash of the band's number and minima."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.frombuffer(b"".join(b["minima"]), np.uint32).reshape(len(b), bands, rows).astype(np.uint64)
                h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(b), bands)).copy()
                for i in range(rows):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
                yield pd.DataFrame({"rep": np.repeat(b["rep"].to_numpy(), bands), "band": h.ravel().view(np.int64)})

    return reps.select("rep", "minima").mapInPandas(run, "rep long, band long")


def block_units(members: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Deal the members of every group to its units of work: pairs of its ``blocks``, the block of a member given by a
    hash. Adds ``unit`` and ``side`` (0 or 1: the unit's first or second block; 2: a unit of one block)."""
    own = F.pmod(F.xxhash64("rep"), F.col("__n")).cast("int")
    df = members.withColumn("__n", blocks.cast("int")).withColumn("__a", own).withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    side = F.when(F.col("__a") == F.col("__b"), 2).when(F.col("__a") < F.col("__b"), 0).otherwise(1)
    unit = F.concat_ws("/", F.col(group), F.least("__a", "__b"), F.greatest("__a", "__b"))
    # the unit of block a alone is (a, a); a member of block a takes part in it once
    return df.withColumn("unit", F.xxhash64(unit)).withColumn("side", side).drop("__n", "__a", "__b")


def per_unit(units: DataFrame, work: Callable[[pd.DataFrame], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each unit; small units share a task, one unit is held at a time."""
    parts = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            u = b["unit"].to_numpy()
            cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
            out: list[tuple] = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                part = b.iloc[a:z]
                if held and held[0]["unit"].iloc[0] != u[a]:
                    out += work(pd.concat(held))
                    held = []
                held.append(part)
            if out:
                yield frame(out, names)
        if held and (out := work(pd.concat(held))):
            yield frame(out, names)

    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInPandas(run, schema)


def _roots(n: int, pairs_a: np.ndarray, pairs_b: np.ndarray) -> np.ndarray:
    """The least member of each one's connected set."""
    root = np.arange(n)
    if not len(pairs_a):
        return root
    while True:
        low = np.minimum(root[pairs_a], root[pairs_b])
        new = root.copy()
        np.minimum.at(new, pairs_a, low)
        np.minimum.at(new, pairs_b, low)
        np.minimum.at(new, root[pairs_a], low)
        np.minimum.at(new, root[pairs_b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(side: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of near pairs, those that the unit stands for: all of one block, or one block with the other."""
    near = np.triu(near, 1)
    if (side != 2).any():
        near &= side[:, None] != side[None, :]
    return np.nonzero(near)


def candidate_links(units: DataFrame, hashes: int, least: float) -> DataFrame:
    """``a, b``: in each unit, members and the first of their sets that are linked by near-equal minima."""

    def work(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.drop_duplicates("rep").sort_values("rep")
        if len(pdf) < 2:
            return []
        rep = pdf["rep"].to_numpy()
        m = np.frombuffer(b"".join(pdf["minima"]), np.uint32).reshape(len(rep), hashes)
        if len(rep) == 2:
            return [(int(rep[1]), int(rep[0]))] if (m[0] == m[1]).mean() >= least else []
        same = np.zeros((len(rep), len(rep)), np.uint16)
        for column in np.ascontiguousarray(m.T):
            same += column[:, None] == column[None, :]
        root = _roots(len(rep), *_pairs(pdf["side"].to_numpy(), same >= least * hashes))
        return [(int(rep[i]), int(rep[r])) for i, r in enumerate(root) if r != i]

    return per_unit(units, work, ["a", "b"], "a long, b long")


def _few_shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share, pair by pair."""
    shared = np.zeros((len(sets), len(sets)), np.int32)
    for i, x in enumerate(sets):
        for j in range(i):
            shared[i, j] = shared[j, i] = len(np.intersect1d(x, sets[j], assume_unique=True))
    return shared


def _many_shared(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The same through the lists of sets that hold an n-gram; equal lists are added up first."""
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    times = Counter(g.tobytes() for g in np.split(owner, np.flatnonzero(np.diff(column)) + 1) if len(g) > 1)
    shared = np.zeros((len(sets), len(sets)), np.int32)
    for key, n in times.items():
        g = np.frombuffer(key, np.int32)
        shared[np.ix_(g, g)] += n
    return shared


def verified_links(units: DataFrame, threshold: float) -> DataFrame:
    """``a, b, links``: in each unit, every member with verified links, the first of its linked set and how many
    documents it links to (each member counts as many as its class has)."""

    def work(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.drop_duplicates("rep").sort_values("rep")
        if len(pdf) < 2:
            return []
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        sizes = np.array([len(s) for s in sets])
        shared = _few_shared(sets) if len(sets) <= 6 else _many_shared(sets, sizes)
        union = sizes[:, None] + sizes[None, :] - shared
        a, b = _pairs(pdf["side"].to_numpy(), shared >= threshold * union - 1e-9)
        root = _roots(len(rep), a, b)
        links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        return [(int(rep[i]), int(rep[root[i]]), int(links[i])) for i in np.flatnonzero(links)]

    return per_unit(units, work, ["a", "b", "links"], "a long, b long, links long")


def components(links: DataFrame) -> DataFrame:
    """``rep, old, root``: the least member of the connected set of every end of a link. Each round sends the least label of
    a member's neighbours to it and then shortens chains by following labels; rounds are written to the shared folder."""
    # a member that several units linked to other firsts ties these firsts together: (member, least) and (first, least)
    own = links.where("a <> b").select("a", "b").withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), "a"))
    links = own.select("a", F.col("m").alias("b")).unionByName(own.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = save(both.distinct(), "links")
    labels = save(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rep"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["rep"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["rep"] == near["a"]).select("rep", F.col("root").alias("old"), F.least("root", "m").alias("mid"))
        up = labels.select(F.col("rep").alias("__r"), F.col("root").alias("__up"))
        before, labels = labels, save(step.join(up, step["mid"] == up["__r"], "left").select("rep", "old", F.coalesce(F.least("mid", "__up"), "mid").alias("root")), "labels")
        drop(before)
        if labels.where("old <> root").isEmpty():
            drop(edges)
            return labels


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links``: the least doc_id of the document's near-duplicate class and how many other
    documents have a similarity of ``threshold`` or more with it."""
    bands, rows = choose_bands(threshold, recall)
    signed = save(signatures(docs, bands, rows, n, id_col, text_col), "minima")
    keyed = signed.where("key is not null")
    # tables that hold minima or bands go as soon as the candidates are known, so that they don't lie beside the texts' shuffle
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h"))
    grouped = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"), F.first("minima").alias("minima"), F.first("n_grams").alias("n_grams"))
    # numbers of the written list, so that null and repeated doc_ids do no harm
    reps = save(grouped.select("key", "copies", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), "minima", "n_grams", F.monotonically_increasing_id().alias("rep")), "classes")
    banded = save(band_rows(reps, bands, rows), "bands")
    buckets = save(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = banded.join(buckets, "band").select("rep", "band", "size")
    units = block_units(members, "band", F.ceil(F.col("size") / BLOCK)).join(reps.select("rep", "minima"), "rep")
    groups = components(candidate_links(units.select("unit", "side", "rep", "minima"), bands * rows, slack(threshold, bands * rows)))
    keys, told_by = save(signed.select("id", "key"), "keys"), save(reps.drop("minima"), "reps")
    drop(signed, banded, buckets, reps)
    wanted = save(groups.select("rep", "root").join(told_by.select("rep", "key", "copies", "first_id", "first_h", "n_grams"), "rep"), "wanted")
    sizes = save(wanted.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK), F.ceil(F.sum("n_grams") / VERIFY_GRAMS)).alias("blocks")), "group-sizes")
    sized = save(wanted.join(sizes, "root"), "wanted")
    links = save(verified_links(block_units(_sets(docs, sized, n, id_col, text_col), "root", F.col("blocks")), threshold), "links-verified")
    drop(groups, wanted, sizes, sized)
    roots = components(links).select("rep", "root")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    told = save(told_by.select("key", "rep", "copies", "first_id").join(roots, "rep", "left").join(counts, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "told")
    firsts = save(told.groupBy("root").agg(F.min("first_id").alias("class_id")), "firsts")
    classes = save(told.join(firsts, "root").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes-told")
    out = keys.where("key is not null").join(classes, "key").select("id", "class_id", "n_links")
    alone = keys.where("key is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def _sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """The whole n-gram sets of the wanted representatives, read from the text of a document of each, which is found by its
    id and the digest of its text; rows that repeat both are one before their text is used."""
    names = ["rep", "root", "blocks", "copies"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a, z in by_bytes([len(t) for t in b["t"]], 1 << 21):
                part = b.iloc[a:z]
                yield part[names].assign(grams=[shingles(t.lower().split(), n).tobytes() for t in part["t"]])
        _release()

    # the wanted grow with the texts, so they are merged at every size, with the texts that a sieve of them lets through
    asked = wanted.select(F.col("first_id").alias("id"), F.col("first_h").alias("h"))
    texts, wanted = sieved(_texts(docs, id_col, text_col), asked, ["id", "h"]).where("__maybe").drop("__maybe"), wanted.hint("merge")
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["first_id"]) & (texts["h"] == wanted["first_h"]))
    chosen = found.groupBy("rep").agg(F.first("t").alias("t"), *[F.first(c).alias(c) for c in names[1:]])
    return chosen.mapInPandas(run, "rep long, root long, blocks long, copies long, grams binary")
