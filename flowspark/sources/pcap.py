"""Captures as tables: classic little-endian microsecond PCAP, and PCAPNG of either byte order, read in byte ranges.

A first pass walks each range's record headers and says where its first record begins, where the
record after its last one begins, how many packets it holds and which interfaces it names. A range in
the middle of a file finds its first record by a chain of plausible headers; the chain is then held
against the end of the range before, and a range that began wrong is walked again from there. So the
packets and their numbers are those of one walk through the file, however it is cut.
"""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

# Fixed values of the formats: magics, block types, option number, link types (Ethernet, Linux cooked 1 and 2) and the last second of 32 bits.
PCAP_MAGIC, NG_MAGIC = b"\xd4\xc3\xb2\xa1", b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, ENHANCED = 0x0A0D0D0A, 1, 6
TIME_RESOLUTION = 9
LINK_TYPES = (1, 113, 276)
LAST_SECOND = 0xFFFFFFFF
MAX_RECORD, CHAIN = 1 << 18, 8

SCHEMA = "file string, packet_index long, byte_offset long, data_link_type int, ts_us long, captured_length long, original_length long, bytes binary, warning string"
SUMMARY = "file string, size long, part long, start long, next long, packets long, order string, links array<int>, resolutions array<int>, resets boolean, fault string"
RANGE_BYTES = 64 << 20


class Damaged(ValueError):
    """A capture that cannot be read on."""


def micros(ticks: int, resolution: int) -> int:
    """Timestamp ticks (10^-n s, or 2^-n s with the high bit set) as microseconds, halves rounded up; seconds beyond 32 bits end at the last."""
    per_second = 2 ** (resolution & 0x7F) if resolution & 0x80 else 10**resolution
    return min((ticks * 2_000_000 + per_second) // (2 * per_second), LAST_SECOND * 1_000_000 + 999_999)


@dataclasses.dataclass
class Piece:
    """Bytes ``data`` of a file of ``size`` bytes, from offset ``base`` on; ``more`` reads a piece of the file."""

    data: bytes
    base: int
    size: int
    more: object = None

    def take(self, at: int, n: int) -> bytes:
        """``n`` bytes at an offset of the file, fewer at its end."""
        inside = at - self.base
        if 0 <= inside and inside + n <= len(self.data):
            return self.data[inside : inside + n]
        n = max(0, min(n, self.size - at))
        if 0 <= inside and inside + n <= len(self.data):
            return self.data[inside : inside + n]
        return self.more(at, n) if self.more and n else b""


def classic_link(head: bytes) -> int:
    """Link type of a classic capture's header."""
    if len(head) < 24:
        raise Damaged("unsupported capture header")
    _, major, minor, _, _, snap, link = struct.unpack_from("<IHHIIII", head)
    if (major, minor) != (2, 4) or not snap or link not in LINK_TYPES:
        raise Damaged("unsupported capture header")
    return link


def classic(w: Piece, link: int, at: int, stop: int) -> Iterator[tuple]:
    """(offset, link type, ts_us, original length, where its bytes are, their number, offset of the next) of records that begin before ``stop``."""
    while at < stop:
        head = w.take(at, 16)
        if len(head) < 16:
            raise Damaged("capture ends inside a record header")
        sec, usec, size, original = struct.unpack("<IIII", head)
        if at + 16 + size > w.size:
            raise Damaged("capture ends inside a packet")
        yield at, link, sec * 1_000_000 + usec, original, at + 16, size, at + 16 + size
        at += 16 + size


class Blocks:
    """The state of a walk through PCAPNG blocks: byte order, and the interfaces (link type, time resolution) of the section."""

    def __init__(self, order: str = "<", links=()):
        self.order, self.links, self.reset, self.end = order, list(links), False, 0

    def walk(self, w: Piece, at: int, stop: int) -> Iterator[tuple]:
        """Enhanced packets as ``classic`` gives records; other blocks, unknown interfaces and other link types are passed over."""
        self.end = at
        while at < stop:
            head = w.take(at, 12)
            if len(head) < 12:
                raise Damaged("capture ends inside a block")
            if head[:4] == NG_MAGIC:
                self.order, self.links, self.reset = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), [], True
            kind, size = struct.unpack_from(self.order + "II", head)
            if size < 12 or size % 4 or at + size > w.size:
                raise Damaged("capture ends inside a block")
            if kind == INTERFACE:
                self.links.append(self.interface(w.take(at, size)))
            elif kind == ENHANCED:
                if size < 32:
                    raise Damaged("packet block is too short")
                interface, high, low, captured, original = struct.unpack(self.order + "IIIII", w.take(at + 8, 20))
                if captured > size - 32:
                    raise Damaged("packet is longer than its block")
                if interface < len(self.links) and self.links[interface][0] in LINK_TYPES:
                    link, resolution = self.links[interface]
                    yield at, link, micros(high << 32 | low, resolution), original, at + 28, captured, at + size
            at += size
            self.end = at

    def interface(self, block: bytes) -> tuple[int, int]:
        link, resolution, option = struct.unpack_from(self.order + "H", block, 8)[0], 6, 16
        while option + 4 <= len(block) - 4:
            code, length = struct.unpack_from(self.order + "HH", block, option)
            if code == TIME_RESOLUTION and length == 1:
                resolution = block[option + 4]
            if not code:
                break
            option += 4 + (length + 3) // 4 * 4
        return link, resolution


def plausible(w: Piece, at: int, order: str | None) -> bool:
    """Whether a chain of records (or, with a byte order, blocks) seems to begin here."""
    for _ in range(CHAIN):
        if at == w.size:
            return True
        if order is None:
            head = w.take(at, 16)
            if len(head) < 16:
                return False
            _, usec, size, original = struct.unpack("<IIII", head)
            if usec >= 1_000_000 or size > MAX_RECORD or not original or original > 1 << 26 or at + 16 + size > w.size:
                return False
            at += 16 + size
        else:
            head = w.take(at, 8)
            if len(head) < 8:
                return False
            _, size = struct.unpack(order + "II", head)
            if size < 12 or size % 4 or at + size > w.size or w.take(at + size - 4, 4) != head[4:8]:
                return False
            at += size
    return True


def first_record(w: Piece, begin: int, stop: int, order: str | None) -> int:
    """The first offset in the range where a chain of records begins; ``stop`` if there is none."""
    if order is not None:
        begin += -begin % 4
    return next((at for at in range(begin, stop, 4 if order else 1) if plausible(w, at, order)), stop)


def source_of(path: str):
    """The file system and the path in it of a file that Spark names."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Source:
    """One open file at a time, read in pieces."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, at: int, n: int) -> bytes:
        if path != self.path:
            self.close()
            store, name = source_of(path)
            self.path, self.file = path, store.open_input_file(name)
        return self.file.read_at(n, at)

    def window(self, path: str, begin: int, end: int, size: int) -> Piece:
        return Piece(self.read(path, begin, max(0, min(end, size) - begin)), begin, size, lambda at, n: self.read(path, at, n))

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.path, self.file = None, None


def summary(source: Source, path: str, size: int, part: int, range_bytes: int, start: int | None, order: str | None) -> dict:
    """What the first pass says of one range; ``start`` and ``order`` where the range before has told them."""
    begin, stop = part * range_bytes, min((part + 1) * range_bytes, size)
    head = source.read(path, 0, 24)
    found = {"file": path, "size": size, "part": part, "start": begin, "next": None, "packets": 0, "order": None, "links": [], "resolutions": [], "resets": False, "fault": None}
    w = source.window(path, begin, stop, size)
    try:
        if head[:4] == PCAP_MAGIC:
            link = classic_link(head)
            found["start"] = at = start if start is not None else 24 if not part else first_record(w, begin, stop, None)
            for record in classic(w, link, at, stop):
                found["packets"] += 1
                at = record[-1]
            found["next"] = at
        elif head[:4] == NG_MAGIC:
            guess = order or ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">")
            found["start"] = at = start if start is not None else 0 if not part else first_record(w, begin, stop, guess)
            # Packets are counted by a second look, when the interfaces before the range are known.
            blocks = Blocks(guess)
            try:
                for _ in blocks.walk(w, at, stop):
                    pass
            finally:
                found |= {"order": blocks.order, "links": [x for x, _ in blocks.links], "resolutions": [x for _, x in blocks.links], "resets": blocks.reset, "next": blocks.end}
        else:
            raise Damaged("not a supported capture")
    except Damaged as fault:
        found["fault"] = str(fault)
    return found


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def capture_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The first pass over all captures under ``path``: one row for each range (columns of ``SUMMARY``), with right beginnings.

    Ranges after a fault are left out. Each turn walks only the ranges again whose beginning does not
    fit the end of the one before; as a rule there is none.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    parts = files.select("*", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L) div {range_bytes}L)")).alias("part"))
    schema = arrow_schema(spark, SUMMARY)

    def walk(batches):
        source = Source()
        try:
            for batch in batches:
                yield as_batch([summary(source, r["file"], r["size"], r["part"], range_bytes, r["start"], r["order"]) for r in batch.to_pylist()], schema)
        finally:
            source.close()

    first = parts.select("file", "size", "part", F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("order"))
    found = stored(first.repartition("file", "part").mapInArrow(walk, SUMMARY), "capture-ranges")
    order = Window.partitionBy("file").orderBy("part")
    while True:
        broken = F.max(F.col("fault").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        joined = found.withColumns({"broken": F.coalesce(broken, F.lit(0)) > 0, "begins": F.lag("next").over(order), "was": F.lag("order").over(order)})
        # A record longer than a range may reach over several: those hold none of their own.
        wrong = ~F.col("broken") & F.col("begins").isNotNull() & (F.col("begins") != F.col("start"))
        joined = stored(joined.withColumn("wrong", wrong), "capture-ranges")
        if not joined.where("wrong").limit(1).count():
            return joined.where("not broken").select(found.columns)
        again = joined.where("wrong").select("file", "size", "part", F.col("begins").alias("start"), F.col("was").alias("order"))
        kept = joined.where("not wrong").select(found.columns)
        found = stored(kept.unionByName(again.repartition("file", "part").mapInArrow(walk, SUMMARY)), "capture-ranges")


def packets_in(w: Piece, row: dict, head: bytes) -> Iterator[tuple]:
    if head[:4] == PCAP_MAGIC:
        return classic(w, classic_link(head), row["start"], row["stop"])
    return Blocks(row["order"] or "<", zip(row["links"], row["resolutions"], strict=True)).walk(w, row["start"], row["stop"])


def sorted_when_joined(packets: DataFrame) -> DataFrame:
    """Packets that joins sort and never broadcast: Spark takes their size from the few rows of the ranges that hold them."""
    return packets.hint("merge")


def read_ranges(spark: SparkSession, ranges: DataFrame, range_bytes: int, rows_per_batch: int = 5_000) -> DataFrame:
    """The packets of the ranges of ``capture_ranges``, in columns of ``SCHEMA``."""
    order = Window.partitionBy("file").orderBy("part")
    # The interfaces before a range: those since the last section, which few blocks of a file name.
    section = F.sum(F.col("resets").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = ranges.withColumn("section", F.coalesce(section, F.lit(0)))
    ends = ranges.withColumn("ended", F.coalesce(F.sum(F.col("resets").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    named = ends.where(F.size("links") > 0).select(F.col("file").alias("_file"), F.col("ended").alias("_section"), F.col("part").alias("_part"), F.col("links").alias("_links"), F.col("resolutions").alias("_resolutions"))
    before = own.select("file", "part", "section").join(named, (F.col("file") == F.col("_file")) & (F.col("section") == F.col("_section")) & (F.col("_part") < F.col("part")))
    lists = before.groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("_part", "_links", "_resolutions"))).alias("all"))
    lists = lists.select("file", "part", F.flatten("all._links").alias("links"), F.flatten("all._resolutions").alias("resolutions"))
    was = F.lag("order").over(order)
    plan = own.withColumn("order", F.coalesce(was, "order")).drop("links", "resolutions").join(lists, ["file", "part"], "left")
    plan = plan.withColumns({"links": F.coalesce("links", F.array().cast("array<int>")), "resolutions": F.coalesce("resolutions", F.array().cast("array<int>")), "stop": F.least(F.col("next"), F.col("size"))})
    plan = stored(plan.select("file", "size", "part", "start", "stop", "order", "links", "resolutions", "fault"), "capture-plan")
    schema = arrow_schema(spark, SCHEMA)

    def walk(batches, count: bool):
        source = Source()
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    head = source.read(row["file"], 0, 24)
                    known = head[:4] in (PCAP_MAGIC, NG_MAGIC)
                    row["stop"] = row["stop"] if row["stop"] is not None else row["size"]
                    w = source.window(row["file"], row["start"], min(row["stop"], row["start"] + range_bytes + MAX_RECORD), row["size"])
                    held, n = [], 0
                    try:
                        for at, link, ts, original, place, size, _ in packets_in(w, row, head) if known else ():
                            if count:
                                n += 1
                                continue
                            held.append((row["file"], row["base"] + n, at, link, ts, size, original, w.take(place, size), None))
                            n += 1
                            if len(held) == rows_per_batch:
                                yield held
                                held = []
                    except Damaged:
                        pass  # the plan says what is wrong
                    if count:
                        yield [(row["file"], row["part"], n)]
                        continue
                    if row["fault"]:
                        if not row["base"] + n:
                            raise Damaged(f"{row['file']}: {row['fault']}")
                        held.append((row["file"], *[None] * 7, row["fault"]))
                    if held:
                        yield held
        finally:
            source.close()

    counts_schema = arrow_schema(spark, "file string, part long, n long")

    def counts(batches):
        for rows in walk(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), counts_schema, strict=True)], schema=counts_schema)

    def packets(batches):
        for rows in walk(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = plan.repartition("file", "part")
    own = stored(spread.mapInArrow(counts, "file string, part long, n long"), "capture-counts")
    base = F.sum("n").over(order) - F.col("n")
    numbered = spread.join(own.withColumn("base", base).drop("n"), ["file", "part"])
    return sorted_when_joined(numbered.repartition("file", "part").mapInArrow(packets, SCHEMA))


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All packets of the captures under ``path``: one task for each range of ``range_bytes``, of files of any size.

    packet_index counts from 0 in each file. A fault after the first packet ends a file with a
    warning row; before, it is an error. Files are read by ranges from local folders and the object
    and Hadoop stores that Arrow knows.
    """
    return read_ranges(spark, capture_ranges(spark, path, range_bytes), range_bytes)


def fetch_bytes(packets: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The bytes of packets given as references (file, byte_offset, captured_length): adds or replaces ``bytes``.

    References are sorted by file and offset; those less than ``gap`` bytes apart are read in one
    piece of ``most`` bytes at most, and nothing else of a file is read but its first four bytes.
    """
    names = [c for c in packets.columns if c != "bytes"]
    kinds = dict(packets.dtypes)

    def fetch(batches):
        source, magic = Source(), {}
        try:
            for batch in batches:
                files, offsets, sizes = (batch.column(names.index(c)).to_pylist() for c in ("file", "byte_offset", "captured_length"))
                data: list = [None] * batch.num_rows
                places = []
                for file, at in zip(files, offsets, strict=True):
                    if file is not None and file not in magic:
                        magic[file] = 16 if source.read(file, 0, 4) == PCAP_MAGIC else 28
                    places.append(at + magic[file] if file is not None and at is not None else None)
                i = 0
                while i < len(files):
                    if places[i] is None or sizes[i] is None:
                        i += 1
                        continue
                    j, end = i, places[i] + sizes[i]
                    while j + 1 < len(files) and files[j + 1] == files[i] and places[j + 1] is not None and sizes[j + 1] is not None and 0 <= places[j + 1] - places[j] and places[j + 1] - end <= gap and max(end, places[j + 1] + sizes[j + 1]) - places[i] <= most:
                        j += 1
                        end = max(end, places[j] + sizes[j])
                    piece = source.read(files[i], places[i], end - places[i])
                    for k in range(i, j + 1):
                        data[k] = piece[places[k] - places[i] : places[k] - places[i] + sizes[k]]
                    i = j + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*names, "bytes"])
        finally:
            source.close()

    ordered = packets.select(names).repartitionByRange("file", "byte_offset").sortWithinPartitions("file", "byte_offset")
    return sorted_when_joined(ordered.mapInArrow(fetch, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "bytes binary"])))


def records(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of one capture that is in memory whole."""
    w, n = Piece(data, 0, len(data)), 0
    try:
        if data[:4] == PCAP_MAGIC:
            found = classic(w, classic_link(data), 24, len(data))
        elif data[:4] == NG_MAGIC:
            found = Blocks().walk(w, 0, len(data))
        else:
            raise Damaged("not a supported capture")
        for at, link, ts, original, place, size, _ in found:
            yield name, n, at, link, ts, size, original, data[place : place + size], None
            n += 1
    except Damaged as fault:
        if not n:
            raise Damaged(f"{name}: {fault}") from None
        yield name, None, None, None, None, None, None, None, str(fault)


def pcap_bytes(packets: list[tuple[int, int, bytes]], link: int = 1) -> bytes:
    """A classic capture of (ts_us, original_length, bytes)."""
    head = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(data), original) + data for ts, original, data in packets)
