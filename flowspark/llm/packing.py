"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, with_earlier, worker_memory

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_WINDOWS = 64
BROADCAST_PLACES = 500_000


class WordIds(dict):
    """Token ids of a run without blanks as little-endian uint32 bytes, remembered for up to ``limit`` runs.

    Half of these are young: when that many are, they become the old ones and the old ones that
    were not used since are forgotten. So a vocabulary beyond the limit loses rare runs only. Runs
    of more than ``longest`` characters are not remembered.

    Words that differ in capitals or in marks behind them are looked up once. The vocabulary's pre-tokenizer never joins across a blank, so a text's ids are those of its runs in turn.
    """

    #: Latin letters that stand for themselves in NFC and have one lower-case letter each, then ASCII marks.
    word = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+)([!-/:-@\[-`{-~]*)")
    #: The byte-level alphabet: bytes that show nothing stand for the characters from 256 on.
    shown = {byte: 256 + i for i, byte in enumerate([*range(33), *range(127, 161), 173])}
    longest = 100

    def __init__(self, tokenizer, limit: int = 1_200_000):
        super().__init__()
        self.tokenizer, self.model, self.limit, self.old = tokenizer, tokenizer.model, limit, {}

    def __missing__(self, run: str) -> bytes:
        if 2 * len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if (found := self.old.get(run)) is None:
            found = self.make(run)
        if len(run) <= self.longest:
            self[run] = found
        return found

    def make(self, run: str) -> bytes:
        match = self.word.fullmatch(run)
        if not match:
            return self.ids_of(self.tokenizer.encode(run, add_special_tokens=False).ids)
        letters, marks = match.groups()
        low = letters.lower()
        if low != run:
            # Letters and the marks behind them are one piece each to the pre-tokenizer.
            return self[low] + self[marks] if marks else self[low]
        # The normalizer leaves such a word alone.
        return self.ids_of([t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.shown))])

    @staticmethod
    def ids_of(numbers: list[int]) -> bytes:
        return np.array(numbers, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def word_ids(tokenizer_path: str) -> WordIds:
    return worker_memory(("ids", tokenizer_path), lambda: load_word_ids(tokenizer_path))


def load_word_ids(tokenizer_path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(tokenizer_path))


def tokenize(docs: DataFrame, tokenizer_path: str, window: int = TIERS[-1], batch_bytes: int = 4_000_000) -> DataFrame:
    """Token ids of every document, cut into pieces of at most ``window`` ids.

    Columns doc_id, start, length, ids (binary, little-endian uint32), doc_tokens. Each document's
    ids are followed by one id 1, so null and empty texts give one piece of length 1. Only doc_id
    and text are read; an empty table gives no pieces; repeated rows give repeated pieces.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def cut(batches):
        ids, end = word_ids(tokenizer_path), np.array([END_ID], "<u4").tobytes()

        def table(doc_ids, rows) -> pa.RecordBatch:
            row, start, length, data, total = zip(*rows, strict=True)
            arrays = [doc_ids.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, 1000):
            doc_ids, rows, held = batch.column(0), [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = ids.encode(text or "") + end
                total = len(data) // 4
                if total <= window:
                    rows.append((i, 0, total, data, total))
                else:
                    rows += [(i, at, min(window, total - at), data[4 * at : 4 * (at + window)], total) for at in range(0, total, window)]
                held += len(data)
                if held >= batch_bytes:
                    yield table(doc_ids, rows)
                    rows, held = [], 0
            if rows:
                yield table(doc_ids, rows)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def plan_windows(counts: dict[int, int], tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS) -> list[tuple[int, int, list[int]]]:
    """Windows for a histogram of piece lengths: (tier, how many such windows, lengths in order).

    Pieces belong to the smallest tier that holds them. Windows of the longest tier are opened by
    its own pieces and their gaps filled with the longest pieces of shorter tiers that fit. Then
    each shorter tier, from the longest, keeps the windows that its pieces fill exactly, as many
    as make whole step groups of ``step_windows`` times the longest tier's tokens; the rest share
    windows of the longest tier, filled the same way. The work depends on the number of different
    lengths (at most the window), not on the number of pieces.
    """
    left = np.zeros(tiers[-1] + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[int, int, list[int]]] = []

    def fill(size: int, opener: int, exact: bool) -> None:
        """Windows of ``size`` opened by pieces of length ``opener``, until none is left."""
        while left[opener]:
            pattern, used, gap = [opener], {opener: 1}, size - opener
            while gap:
                fits = np.flatnonzero(left[1 : gap + 1]) + 1
                at = next((int(x) for x in fits[::-1] if left[x] > used.get(int(x), 0)), 0)
                if not at:
                    break
                pattern.append(at)
                used[at] = used.get(at, 0) + 1
                gap -= at
            if exact and gap:
                return
            n = int(min(left[x] // k for x, k in used.items()))
            for x, k in used.items():
                left[x] -= n * k
            plan.append((size, n, pattern))

    def whole_groups(size: int) -> None:
        """Give back the last windows of ``size`` that make no whole step group."""
        spare = sum(n for tier, n, _ in plan if tier == size) % (step_windows * tiers[-1] // size)
        while spare:
            tier, n, pattern = plan.pop()
            back = min(n, spare)
            spare -= back
            for x in pattern:
                left[x] += back
            if n > back:
                plan.append((tier, n - back, pattern))

    for i in range(len(tiers) - 1, -1, -1):
        shortest = tiers[i - 1] + 1 if i else 1
        for opener in range(tiers[i], shortest - 1, -1):
            fill(tiers[i], opener, exact=i < len(tiers) - 1)
        if i < len(tiers) - 1:
            whole_groups(tiers[i])
    for opener in range(tiers[-1], 0, -1):
        fill(tiers[-1], opener, exact=False)
    return plan


def plan_places(plan, tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS) -> list[tuple]:
    """(length, block, block size, first, last, sequence, offset, tier, window in tier, step groups of tier, windows of tier).

    The pieces of a length, numbered from 0, take its places in the order of the plan. Places lie
    in blocks of numbers, about as many blocks as a length has entries, and an entry is listed in
    each block that it reaches into; so a piece meets only the few entries of its own block.
    """
    taken: dict[int, int] = {}
    found, sequence, of_tier = [], 0, dict.fromkeys(tiers, 0)
    for tier, n, pattern in plan:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            found.append((length, first, first + n, sequence, offset, tier, of_tier[tier]))
            taken[length] = first + n
            offset += length
        sequence += n
        of_tier[tier] += n
    entries: dict[int, int] = {}
    for length, *_ in found:
        entries[length] = entries.get(length, 0) + 1
    size = {length: -(-taken[length] // entries[length]) for length in entries}
    # The longest tier's last group would be a rest: its windows are spread evenly over the nearest number of groups.
    groups = {tier: max(1, round(n * tier / (step_windows * tiers[-1]))) for tier, n in of_tier.items()}
    return [
        (length, block, size[length], first, last, start, offset, tier, before, groups[tier], of_tier[tier])
        for length, first, last, start, offset, tier, before in found
        for block in range(first // size[length], (last - 1) // size[length] + 1)
    ]


def pack(pieces: DataFrame, tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS, rows_per_bucket: int = 2_000) -> DataFrame:
    """Place pieces (doc_id, start, length and any further columns) in windows without cutting them again.

    Adds sequence_id, offset, tier and step_group. Only the histogram of lengths (at most
    ``tiers[-1]`` rows) comes to the driver, where ``plan_windows`` makes windows of it; the n-th
    piece of a length takes the n-th place planned for that length. Places are numbered by a
    two-level count over hash buckets, so a length that a third of all pieces have is never in
    one task. A step group holds windows of one tier with ``step_windows * tiers[-1]`` tokens, so
    groups of all tiers weigh the same; those of the longest tier, which takes the rest, differ by
    one window from each other. Input columns with the added names are replaced. Pieces of
    repeated rows take a place each; those without doc_id are spread over 64 buckets more.
    """
    spark = pieces.sparkSession
    added = ("sequence_id", "offset", "tier", "step_group")
    pieces = pieces.drop(*added)
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % 64).otherwise(0)
    own = materialize(pieces.select("length", F.xxhash64("doc_id", "start", salt).alias("key"), F.struct(*pieces.columns).alias("row")), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(histogram.values()) // rows_per_bucket))
    places = plan_places(plan_windows(histogram, tiers, step_windows), tiers, step_windows)
    few = len(places) <= BROADCAST_PLACES
    names = ["length", "block", "size", "first", "last", "sequence", "offset", "tier", "before", "groups", "windows"]
    places = spark.createDataFrame(places, ", ".join(f"{n} {'int' if n == 'tier' else 'long'}" for n in names))
    sizes = places.select("length", "size").distinct()  # one row a length, at most the window's
    places = places.drop("size")

    own = own.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    earlier = own.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = with_earlier(earlier, ["length"], "bucket").drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "row.doc_id", "row.start"))
    ranked = own.withColumn("inside", inside).join(earlier, ["length", "bucket"]).withColumn("rank", F.col("earlier") + F.col("inside") - 1)
    ranked = ranked.join(F.broadcast(sizes), "length").withColumn("block", F.expr("rank div size"))
    placed = ranked.join(F.broadcast(places) if few else places, ["length", "block"]).where("rank >= first and rank < last").withColumn("window", F.col("before") + F.col("rank") - F.col("first"))
    step = F.expr("(window * groups) div windows")
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in pieces.columns],
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
        "tier",
        F.concat(F.col("tier").cast("string"), F.lit("-"), step.cast("string")).alias("step_group"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Tokenize, cut and pack, with each piece's ids replaced by their crc32."""
    pieces = tokenize(docs, tokenizer_path)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
