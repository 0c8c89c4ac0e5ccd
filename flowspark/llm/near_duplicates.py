"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialize, slices, worker_memory

SHINGLE_WORDS = 5
#: 50 bands of 5 rows: two sets of similarity 0.75 share no band with probability 1.4e-6.
BANDS, ROWS = 50, 5
SKETCH_BITS = 1024
#: Bits of the parity bitmap of a whole set, see ``set_parity``.
PARITY_BITS = 2048
#: Almost five standard errors (0.036) of the sketch's estimate below 0.75: a true link is turned away with probability 1.2e-6, as by the bands.
SKETCH_FLOOR = 0.58
MEMBERS_PER_BLOCK = 2048
#: So many ids of documents, at most, are sent to every task instead of shuffling the texts.
BROADCAST_IDS = 200_000

_random = np.random.default_rng(20240229)
MULTIPLY = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
ADD = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
FOLD = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class WordKeys(dict):
    """64-bit keys of words, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit keys of the text's 5-word shingles, A-Z lower-cased; of all its words if it has fewer."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if not words:
            return np.zeros(0, np.uint64)
        keys = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE_WORDS, len(words))
        found = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            found = mixed(found * MIX + keys[i : len(keys) - n + 1 + i])
        return np.unique(found)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (MULTIPLY * x[at : at + 512] + ADD).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * MIX).astype(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """Parity of how many (function, minimum) samples fall on each of the sketch's bits."""
    samples = mixed(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32)))
    places = (samples % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SKETCH_BITS) & 1).tobytes()


def set_parity(shingles: np.ndarray) -> bytes:
    """Parity of how many shingles of the whole set fall on each bit.

    Every bit in which two such bitmaps differ takes at least one shingle that one set has alone,
    so more differing bits than the threshold allows single shingles rule a link out for certain.
    """
    return np.packbits(np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def sketch_similarity(odd_bits):
    """Estimated similarity from the number of bits in which two odd sketches differ (numpy array or number)."""
    inside = np.maximum(1 - 2 * np.asarray(odd_bits) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(inside)


#: The most bits in which the sketches of a candidate pair may differ.
MOST_ODD_BITS = int(np.flatnonzero(sketch_similarity(np.arange(SKETCH_BITS // 2)) >= SKETCH_FLOOR)[-1])


def word_keys() -> WordKeys:
    return worker_memory(("words",), WordKeys)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits), bands, sketch and parity of each row; the last four are null for an empty set."""

    def sign(batches):
        words = word_keys()
        for batch in slices(batches):
            n, keys, bands, sketches, parities = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = words.shingles(text)
                n.append(len(found))
                if not len(found):
                    for column in (keys, bands, sketches, parities):
                        column.append(None)
                    continue
                least = minhashes(found)
                keys.append(set_key(found))
                bands.append(band_keys(least))
                sketches.append(odd_sketch(least))
                parities.append(set_parity(found))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(parities, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", "sketch", "parity"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, sketch binary, parity binary")


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, set_key and the full shingle set of each row."""

    def sets(batches):
        words = word_keys()
        for batch in slices(batches):
            found = [words.shingles(x) for x in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([set_key(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "set_key", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, set_key binary, shingles array<long>")


def alike(pairs: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose lengths, odd sketches and set parities allow a link."""
    sides = [told.select(*[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n_shingles", "sketch", "parity")]) for s in "ab"]
    both = pairs.join(sides[1], F.col("b") == F.col("doc_id_b")).join(sides[0], F.col("a") == F.col("doc_id_a"))
    both = both.select("a", "b", "n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b", "parity_a", "parity_b")
    kinds = dict(pairs.dtypes)

    def compare(batches):
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(n_a), -1) for i in (4, 5, 6, 7)]
            odd, differ = (np.bitwise_count(bits[i] ^ bits[i + 1]).sum(axis=1, dtype=np.int64) for i in (0, 2))
            keep = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (odd <= MOST_ODD_BITS) & ((100 + percent) * differ <= (100 - percent) * (n_a + n_b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(compare, f"a {kinds['a']}, b {kinds['b']}")


def confirmed(pairs: DataFrame, docs: DataFrame, repeated: bool, percent: int = 75) -> DataFrame:
    """Those (a, b) whose full sets have 100 x intersection >= percent x union.

    Sets are made of the texts of the documents in ``pairs`` only. Of ``repeated`` doc_ids the
    largest set counts, as in ``one_set_an_id``.
    """
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
    sets = shingle_sets(docs.join(broadcast_if_small(named, BROADCAST_IDS), "doc_id", "left_semi"))
    if repeated:
        sets = sets.groupBy("doc_id").agg(F.max_by("shingles", F.struct(F.size("shingles"), "set_key")).alias("shingles"))
    sets = materialize(sets.select("doc_id", "shingles"), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("_a", "_b"))
    found = materialize(both.where((100 + percent) * common >= percent * (F.size("_a") + F.size("_b"))).select("a", "b"), "links")
    discard(sets, named)
    return found


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; a root is its component's least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each an aggregation and a
    join, until the edges stay as they are, and writes the edges after each round; a hub's edges
    are split by Spark's skew join.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = materialize(edges.select(hi, lo).where("hi <> lo").distinct(), "edges")
    state = None
    while True:
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        hung = small.select("hi", F.col("m").alias("lo")).unionAll(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo"))
        last, now = now, materialize(hung.distinct(), "edges")
        discard(last)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def cross_pairs(members: DataFrame, best_only: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of one band but different components whose odd sketches agree well enough.

    members: band, doc_id, root, n_shingles, sketch, parity and bands, all bands of the table that
    the document is in. A band's members are dealt into blocks of about 2048 and every two blocks
    are compared as one group, so no group holds more than two blocks; only pairs that pass the
    tests of length, sketch and parity leave it, and of those only the closest of each two
    components (``best_only``) or each pair in the first band that it has in common. Groups lie
    one after another in their partitions, most with two or three rows, and are compared as they pass.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / MEMBERS_PER_BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    # Few bands have several blocks, so the members stay where they are until they are dealt.
    dealt = members.join(broadcast_if_small(materialize(sizes, "blocks"), BROADCAST_IDS), "band", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("_block")).alias("i"), F.greatest(o, F.col("_block")).alias("j")))
    dealt = dealt.withColumn("_two", F.explode(others)).select("band", "_two.i", "_two.j", "_block", "doc_id", "root", "n_shingles", "sketch", "parity", "bands")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    kind = dict(members.dtypes)["doc_id"]

    def pairs_of(group: pd.DataFrame) -> list[tuple]:
        ids, roots, n = group["doc_id"].to_numpy(), group["root"].to_numpy(), group["n_shingles"].to_numpy()
        bits, parity = (np.frombuffer(b"".join(group[c]), np.uint64).reshape(len(group), -1) for c in ("sketch", "parity"))
        band, first = int(group["band"].iat[0]), group["_block"].to_numpy() == group["i"].iat[0]
        same = group["i"].iat[0] == group["j"].iat[0]
        rows = np.flatnonzero(first)
        columns = rows if same else np.flatnonzero(~first)
        shared: dict[int, set] = {}
        best: dict[tuple, tuple] = {}
        found = []
        for x in rows:
            near = columns[columns > x] if same else columns
            near = near[(roots[near] != roots[x]) & (100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x]))]
            if not len(near):
                continue
            near = near[np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1) <= MOST_ODD_BITS]
            odd = np.bitwise_count(parity[near] ^ parity[x]).sum(axis=1, dtype=np.int64)
            possible = (100 + percent) * odd <= (100 - percent) * (n[near] + n[x])
            for y, o in zip(near[possible].tolist(), odd[possible].tolist(), strict=True):
                if best_only:
                    key = (min(roots[x], roots[y]), max(roots[x], roots[y]))
                    best[key] = min(best.get(key, (1 << 30, 0, 0)), (o, int(x), y))
                    continue
                for z in (x, y):
                    if z not in shared:
                        shared[z] = set(group["bands"].iat[z])
                if min(shared[x] & shared[y]) == band:
                    found.append((x, y))
        return [(ids[x], ids[y]) for x, y in ([v[1:] for v in best.values()] if best_only else found)]

    def compare(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            keys = rows[["band", "i", "j"]].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ends = [*edges.tolist(), *([len(rows)] if batch is None else [])]
            found, at = [], 0
            for end in ends:
                if end - at > 1:
                    found += pairs_of(rows.iloc[at:end])
                at = end
            held = rows.iloc[at:]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    found = dealt.mapInPandas(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_set_an_id(ids: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """doc_ids of several rows, and (doc_id, n_shingles, set_key) of the largest set (ties: the greatest key) where they have several sets; None where there are none."""
    empty = F.coalesce("set_key", F.lit(b""))
    several = ids.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"), F.min(empty).alias("_lo"), F.max(empty).alias("_hi"), F.max(F.struct("n_shingles", "set_key")).alias("_best"))
    several = materialize(several.where("_n > 1"), "repeated-ids")
    differing = several.where("_lo <> _hi").select("doc_id", F.col("_best.n_shingles").alias("n_shingles"), F.col("_best.set_key").alias("set_key"))
    return (None, None) if several.isEmpty() else (several.select("doc_id"), None if differing.isEmpty() else differing)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    1. Rows with equal shingle sets form a class, whose least doc_id stands for it.
    2. Each class compares itself with the least member of the band that it shares most bands
       with, by odd sketch and set parity first; the full sets confirm the link. This joins a
       group of copies of any size with one comparison each.
    3. In bands whose members are not yet all in one component, members of different components
       are compared by odd sketch and set parity, in blocks: first only the closest pair of each two components
       goes on to its full sets, which joins most of what belongs together; then every pair that
       passes does.
    4. Components are merged; component_id is the least doc_id that can be reached.

    Null or empty text, or text without words: an empty set, linked with nothing. A null doc_id
    is linked with nothing and has a null component_id. Rows of one doc_id are one document: they
    get one result, by the largest of their sets if their texts differ. Very long texts are hashed
    whole. Other columns are not read; an empty table gives an empty result. Stored tables are
    removed once the next ones are written.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs), "signatures")
    ids = materialize(signed.select("doc_id", "n_shingles", "set_key"), "ids")
    repeated, chosen = one_set_an_id(ids)
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    if chosen is not None:
        differing = chosen.select("doc_id", F.col("set_key").alias("_key"))
        usable = usable.join(differing, "doc_id", "left").where(F.col("_key").isNull() | (F.col("_key") == F.col("set_key"))).drop("_key")
        best = chosen.select("doc_id", F.struct("n_shingles", "set_key").alias("_best"))
        ids = ids.join(best, "doc_id", "left").select("doc_id", *[F.when(F.col("_best").isNull(), F.col(c)).otherwise(F.col(f"_best.{c}")).alias(c) for c in ("n_shingles", "set_key")])
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = usable.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = reps if repeated is None else reps.dropDuplicates(["doc_id"])
    reps = materialize(reps.select("doc_id", "n_shingles", "bands", "sketch", "parity"), "representatives")
    discard(signed)

    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("center"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = materialize(rows.join(shared, "band"), "bands")
    told = materialize(reps.select("doc_id", "n_shingles", "sketch", "parity").join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "sketches")
    discard(reps)
    # Texts of the documents that share a band; the others are not needed any more.
    near = materialize(docs.join(broadcast_if_small(told.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi"), "texts")
    stars = members.where("doc_id <> center").groupBy("doc_id", "center").agg(F.count("*").alias("_n"))
    stars = stars.groupBy("doc_id").agg(F.max_by("center", F.struct("_n", "center")).alias("center"))
    stars = materialize(alike(stars.select(F.col("center").alias("a"), F.col("doc_id").alias("b")), told, percent), "stars")
    links = confirmed(stars, near, repeated is not None, percent)
    discard(stars)
    roots = connected_components(links)

    for best_only in (True, False):
        rooted = members.join(roots, members["doc_id"] == roots["node"], "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        # Of bands with the same members, by two 64-bit sums and the count, one is enough.
        by_band = rooted.groupBy("band").agg(
            F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n"), *[F.sum(F.xxhash64("doc_id", F.lit(seed)).cast("decimal(38,0)")).alias(f"_s{seed}") for seed in (1, 2)]
        )
        split = by_band.where("_lo <> _hi").groupBy("_n", "_s1", "_s2").agg(F.min("band").alias("band")).select("band")
        apart = materialize(rooted.join(split, "band", "left_semi"), "apart")
        mine = apart.groupBy("doc_id").agg(F.collect_list("band").alias("bands"))
        pairs = materialize(cross_pairs(apart.join(told.join(mine, "doc_id"), "doc_id"), best_only, percent), "pairs")
        discard(apart)
        more = None if pairs.isEmpty() else confirmed(pairs, near, repeated is not None, percent)
        if more is not None and not more.isEmpty():
            links = links.unionAll(more)
            roots = connected_components(links)
        discard(pairs)
    discard(members, told, near)

    grouped = ids.join(classes, "set_key", "left")
    grouped = grouped.join(roots, grouped["rep"] == roots["node"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "rep", "doc_id"))
    return grouped.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
