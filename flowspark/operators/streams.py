"""Payloads of a flow in packet order: retransmissions, bounded reassembly, HTTP requests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scan import BLOCK, with_running

# Request methods, each followed by a blank.
HTTP_METHODS = ["GET", "POST", "PUT", "HEAD", "DELETE", "OPTIONS", "PATCH", "CONNECT", "TRACE"]
MAX_PACKETS, MAX_BYTES = 128, 128 * 1024


def segments_from_conversations(spark: SparkSession, folder: str, repeat: bool = False) -> DataFrame:
    """Turns as segments of a flow; with ``repeat`` every third turn is seen again a thousand packets later."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").where("text is not null")
    rows = turns.select(F.col("conv_id").alias("flow_index"), F.col("turn").alias("packet_index"), F.col("role").alias("direction"), F.col("text").alias("payload"), (F.col("turn") * 100).cast("long").alias("sequence"), F.lit(0).cast("long").alias("acknowledgement"))
    return rows.unionByName(rows.where("packet_index % 3 = 0").withColumn("packet_index", F.col("packet_index") + 1000)) if repeat else rows


def retransmissions(segments: DataFrame) -> DataFrame:
    """Segments whose direction, sequence and acknowledgement numbers, length and payload their flow had before."""
    key = ["flow_index", "direction", "sequence", "acknowledgement", F.sha2(F.col("payload").cast("binary"), 256), F.octet_length("payload")]
    ranked = segments.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("packet_index"))).where("_at > 1")
    return ranked.select("flow_index", "packet_index", "direction", F.octet_length("payload").cast("long").alias("payload_length"))


def contributions(segments: DataFrame, carry: bool = False) -> DataFrame:
    """What each TCP segment adds to its direction in packet order: action, trimmed and added bytes, and whether the direction is tainted by a gap.

    A direction's first segment says where its stream begins and what comes next. A segment that
    begins there goes on; one that begins later is the first gap, after which nothing is looked at.
    One that begins inside what was seen is trimmed or left out whole, if it reaches to where the stream goes on
    at least, has the acknowledgement number of the last one, and its bytes are those that were
    seen; else overlaps are no longer looked for in this direction. Repeated segments (see
    ``retransmissions``) are left out before. Sequence numbers do not wrap: those behind the first
    one's end the search too. Empty segments are left out.

    Each direction is folded in one pass over rows sorted by packet; what is kept of it are four
    numbers and as many of its last bytes as a segment may have.
    """
    size = F.octet_length("payload")
    key = ["flow_index", "direction", "sequence", "acknowledgement", F.sha2(F.col("payload").cast("binary"), 256), size]
    again = F.row_number().over(Window.partitionBy(*key).orderBy("packet_index")) > 1
    kinds = dict(segments.dtypes)
    original = F.col("original_length") if "original_length" in segments.columns else size
    rows = segments.where(size > 0).select("flow_index", "direction", "packet_index", F.col("sequence").cast("long"), F.col("acknowledgement").cast("long"), original.cast("long").alias("original"), F.col("payload").cast("binary").alias("payload"), again.alias("again"))
    ordered = rows.repartition("flow_index", "direction").sortWithinPartitions("flow_index", "direction", "packet_index")
    names = ["flow_index", "direction", "packet_index", "action", "trimmed", "added", "tainted"] + ["payload"] * carry

    def fold(batches):
        key, state = None, None
        for batch in batches:
            flows, directions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for now, sequence, acknowledgement, sent, payload, repeated in zip(zip(flows, directions, strict=True), *(batch.column(i).to_pylist() for i in range(3, 8)), strict=True):
                if now != key:
                    key, state = now, Contribution()
                found.append(state.take(sequence, acknowledgement, sent, payload, repeated))
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], *[batch.column(6)] * carry], names=names)

    return ordered.mapInArrow(fold, f"flow_index {kinds['flow_index']}, direction {kinds['direction']}, packet_index {kinds['packet_index']}, action string, trimmed long, added long, tainted boolean{', payload binary' * carry}")


class Contribution:
    """What is known of one direction: where it began and goes on, the last acknowledgement, and its last bytes."""

    KEPT = 1 << 16

    def __init__(self):
        self.base = self.following = self.acknowledgement = None
        self.tail, self.held, self.searching, self.tainted = b"", 0, True, False

    def go_on(self, end: int, acknowledgement: int, payload: bytes) -> None:
        self.following, self.acknowledgement = end, acknowledgement
        self.held += len(payload)
        self.tail = (self.tail + payload)[-self.KEPT :]

    def take(self, sequence: int, acknowledgement: int, sent: int, payload: bytes, repeated: bool) -> tuple[str, int, int, bool]:
        size, end = len(payload), sequence + sent
        if self.tainted:
            return "after gap", 0, size, True
        if repeated:
            return "repeated", size, 0, False
        if self.base is None:
            self.base = sequence
            self.go_on(end, acknowledgement, payload)
            return "first", 0, size, False
        if not self.searching:
            return "not looked at", 0, size, False
        if sequence == self.following:
            self.go_on(end, acknowledgement, payload)
            return "next", 0, size, False
        if sequence > self.following:
            self.tainted = True
            return "gap", 0, size, True
        overlap = self.following - sequence
        # Where a segment was captured in part, the bytes seen end before the place where the stream goes on.
        whole = sequence - self.base + overlap <= self.held and overlap <= len(self.tail)
        seen = self.tail[len(self.tail) - overlap :] if whole else None
        if sequence < self.base or acknowledgement != self.acknowledgement or overlap > size or payload[:overlap] != seen:
            self.searching = False
            return "not the same", 0, size, False
        if overlap >= size:
            return "known", size, 0, False
        self.go_on(end, acknowledgement, payload[overlap:])
        return "trimmed", overlap, size - overlap, False


def overlapping_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as TCP segments of which some overlap, repeat, differ, leave gaps, change the acknowledgement or pass the end of the sequence numbers.

    Each turn is one or two segments: kinds follow from conversation and turn. The texts are ASCII,
    so that their lengths are bytes.
    """
    turns = spark.read.parquet(f"{folder}/conversations.parquet").where("text is not null")
    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    text = F.regexp_replace("text", "[^ -~]", "?")
    own = turns.select("conv_id", "role", "turn", text.alias("text")).where("text <> ''")
    own = own.withColumns(
        {
            "before": F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.when(F.col("conv_id") % 5 == 0, (1 << 32) - 300).otherwise(1000),
            "was": F.coalesce(F.lag("text").over(order), F.lit("")),
            "kind": (F.col("conv_id") * 7 + F.col("turn") * 5) % 12,
        }
    )
    kind, n, back = F.col("kind"), F.length("text"), F.least(F.length("was"), F.lit(5))
    behind = F.expr("right(was, 5)")
    first = F.struct(
        (F.col("turn") * 10).alias("packet_index"),
        F.when(kind.isin(0, 5), F.concat(behind, F.col("text"))).when(kind == 1, F.concat(F.expr("substring('#####', 1, least(length(was), 5))"), F.col("text"))).otherwise(F.col("text")).alias("payload"),
        ((F.col("before") - F.when(kind.isin(0, 1, 5), back).otherwise(0) + F.when(kind == 2, 100).otherwise(0)) % (1 << 32)).alias("sequence"),
        F.when(kind == 5, 1).otherwise(0).cast("long").alias("acknowledgement"),
    )
    tail = F.least(n, F.lit(3))
    second = F.struct(
        (F.col("turn") * 10 + 1).alias("packet_index"),
        F.when(kind == 3, F.col("text")).when(kind == 4, F.expr("right(text, 3)")).alias("payload"),
        ((F.col("before") + F.when(kind == 4, n - tail).otherwise(0)) % (1 << 32)).alias("sequence"),
        F.lit(0).cast("long").alias("acknowledgement"),
    )
    each = own.select(F.col("conv_id").alias("flow_index"), F.col("role").alias("direction"), F.explode(F.array(first, second)).alias("segment"))
    return each.select("flow_index", "direction", "segment.*").where("payload is not null")


def reassembled_by_contribution(segments: DataFrame, max_packets: int = MAX_PACKETS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each direction's bytes as its segments contribute them (see ``contributions``), up to its first gap and within a budget, with marks of their quality.

    Columns byte_count, content_md5, packets_used, first_gap (the packet at which a gap stopped it), by_packets and
    by_bytes (which budget cut it), without_payload (packets that carry nothing) and suppressed (bytes known before).
    """
    order = ["packet_index"]
    placed = with_running(segments.withColumn("_way", F.struct("flow_index", "direction")), "_way", order, sums={"_at": F.lit(1)}).drop("_way", BLOCK)
    total = placed.groupBy("flow_index", "direction").agg(F.count("*").alias("_n"), F.max((F.col("_at") < max_packets) & (F.octet_length("payload") == 0)).alias("without_payload"))
    inside = placed.where(F.col("_at") < max_packets).drop("_at")
    own = contributions(inside, carry=True).withColumn("_way", F.struct("flow_index", "direction"))
    whole = own.withColumn("_taken", F.when(~F.col("tainted"), F.col("added")).otherwise(0))
    run = with_running(whole, "_way", order, sums={"_before": F.col("_taken")}).drop("_way", BLOCK)
    seen = ~F.col("tainted") & (F.col("_before") < max_bytes)
    piece = F.when(seen & (F.col("added") > 0), F.struct("packet_index", F.substring(F.col("payload"), (F.col("trimmed") + 1).cast("int"), F.least(F.col("added"), F.lit(max_bytes) - F.col("_before")).cast("int")).alias("bytes")))
    found = run.groupBy("flow_index", "direction").agg(
        F.sort_array(F.collect_list(piece)).alias("_pieces"),
        F.min(F.when(F.col("tainted"), F.col("packet_index"))).alias("_gap"),
        F.max(~F.col("tainted") & (F.col("added") > 0) & (F.col("_before") + F.col("added") > max_bytes)).alias("by_bytes"),
        F.max(F.when(F.col("added") > 0, seen & (F.col("trimmed") > 0)).otherwise(~F.col("tainted") & (F.col("_before") <= max_bytes))).alias("suppressed"),
    )
    joined = found.join(total, ["flow_index", "direction"])
    data = F.array_join(F.transform("_pieces", lambda x: F.hex(x["bytes"])), "")
    return joined.select("flow_index", "direction", (F.length(data) / 2).cast("long").alias("byte_count"), F.md5(F.unhex(data)).alias("content_md5"), F.size("_pieces").cast("long").alias("packets_used"), F.when(~F.col("by_bytes"), F.col("_gap")).alias("first_gap"), (F.col("_n") > max_packets).alias("by_packets"), "by_bytes", "without_payload", "suppressed")


def reassembled(segments: DataFrame, max_packets: int = MAX_PACKETS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each direction's payload in packet order within a budget of packets and bytes, and whether the budget cut it."""
    order = Window.partitionBy("flow_index", "direction").orderBy("packet_index")
    size = F.octet_length("payload")
    ranked = segments.withColumns({"_at": F.row_number().over(order), "_bytes": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    inside = (F.col("_at") <= max_packets) & (F.col("_bytes") <= max_bytes)
    kept = F.sort_array(F.collect_list(F.when(inside, F.struct("packet_index", "payload"))))
    found = ranked.groupBy("flow_index", "direction").agg(kept.alias("_kept"), F.count("*").alias("packets_seen"))
    text = F.array_join(F.transform("_kept", lambda x: x["payload"]), "")
    return found.select("flow_index", "direction", F.size("_kept").cast("long").alias("packets_used"), F.octet_length(text).cast("long").alias("byte_count"), F.md5(text.cast("binary")).alias("content_md5"), (F.col("packets_seen") > F.size("_kept")).alias("truncated"))


def requests_from_pages(spark: SparkSession, folder: str) -> DataFrame:
    """An HTTP request for each page, so that payload rules have text to look at."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").where("url is not null")
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    text = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\nAccept: */*\r\n\r\n"))
    text = F.when(F.col("page_id") % 10 == 3, F.lit("SSH-2.0-client\r\n")).when(F.col("page_id") % 10 == 7, F.concat(F.lit("GETX "), path)).otherwise(text)
    return pages.select(F.col("page_id").alias("packet_index"), text.alias("payload"))


def in_pieces(streams: DataFrame, size: int = 700) -> DataFrame:
    """Streams (flow_index, direction, data) as segments of ``size`` bytes."""
    many = F.expr(f"sequence(0, greatest(octet_length(data) - 1, 0) div {size})")
    each = streams.select("flow_index", "direction", "data", F.explode(many).alias("n"))
    return each.select("flow_index", "direction", F.col("n").cast("long").alias("packet_index"), F.expr(f"substring(data, n * {size} + 1, {size})").alias("payload"))


def http_segments(spark: SparkSession, folder: str) -> DataFrame:
    """A request for each page and its answers: whole, chunked, cut, followed by another answer or by bytes that are none."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("page_id is not null")
    kind, body = F.col("page_id") % 6, F.coalesce(F.col("html"), F.lit("")).cast("binary")
    raw = lambda text: F.lit(text).cast("binary")
    n = F.octet_length(body)
    request = F.concat(F.lit("GET /p/"), F.col("page_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: a.example\r\nX: y\r\n\r\n"))
    more = raw("HTTP/1.1 404 Not Found\r\n\r\n")
    counted = lambda size: F.concat(raw("HTTP/1.1 200 OK\r\nContent-Length: "), size.cast("string").cast("binary"), raw("\r\n\r\n"), body)
    digits = F.lower(F.hex(n)).cast("binary")
    chunk = F.when(n > 0, F.concat(digits, raw("\r\n"), body, raw("\r\n"))).otherwise(raw(""))
    chunked = lambda end: F.concat(raw("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"), chunk, raw(end))
    response = F.when(kind == 0, F.concat(counted(n), more)).when(kind == 1, F.concat(chunked("0\r\n\r\n"), more)).when(kind == 2, F.concat(raw("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"), body, raw("\x01not hex\n")))
    response = response.when(kind == 3, counted(n + 10)).when(kind == 4, F.concat(counted(n), more, raw("\x00garbage"))).otherwise(counted(n))
    streams = pages.select(F.col("page_id").alias("flow_index"), F.explode(F.array(F.struct(F.lit("request").alias("direction"), request.cast("binary").alias("data")), F.struct(F.lit("response").alias("direction"), response.alias("data")))).alias("s"))
    return in_pieces(streams.select("flow_index", "s.*"))


def number_bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def page_host() -> Column:
    return F.concat(F.lit("host-"), (F.col("page_id") % 50).cast("string"), F.lit(".example.org"))


def dns_packets(spark: SparkSession, folder: str) -> DataFrame:
    """An answer for each page, of eight record types in turn, with names that point back; some with a pointer to itself, some cut."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("page_id is not null")
    page, kind = F.col("page_id"), F.col("page_id") % 10
    hexed = lambda digits: F.unhex(F.lit(digits))
    raw = lambda text: F.lit(text).cast("binary")
    label = F.concat(F.lit("h"), page.cast("string")).cast("binary")
    size = F.octet_length(label)
    domain = number_bytes(F.lit(0xC000) + 13 + size, 2)  # points at example.org
    named = lambda text: F.concat(number_bytes(F.lit(len(text)), 1), raw(text), domain)
    text = F.concat(F.lit("v="), page.cast("string")).cast("binary")
    data = (
        F.when(kind == 0, F.concat(hexed("c00002"), number_bytes(page % 250, 1))).when(kind == 1, named("ns")).when(kind == 2, named("www")).when(kind == 3, named("host")).when(kind == 4, F.concat(number_bytes(page % 100, 2), named("mail")))
        .when(kind == 5, F.concat(number_bytes(F.octet_length(text), 1), text)).when(kind == 6, F.concat(hexed("20010db8" + "00" * 10), number_bytes(page % 60000, 2))).when(kind == 7, F.concat(hexed("00010002"), number_bytes(page % 1000, 2), named("srv"))).otherwise(hexed("00"))
    )
    code = F.when(kind == 0, 1).when(kind == 1, 2).when(kind == 2, 5).when(kind == 3, 12).when(kind == 4, 15).when(kind == 5, 16).when(kind == 6, 28).when(kind == 7, 33).otherwise(1)
    question = F.concat(number_bytes(size, 1), label, hexed("07"), raw("example"), hexed("03"), raw("org"), hexed("00"), number_bytes(code, 2), hexed("0001"))
    owner = F.when(kind == 8, number_bytes(F.lit(0xC000) + 12 + F.octet_length(question), 2)).otherwise(hexed("c00c"))
    answer = F.when(kind == 9, hexed("c00c0001")).otherwise(F.concat(owner, number_bytes(code, 2), hexed("00010000003c"), number_bytes(F.octet_length(data), 2), data))
    message = F.concat(number_bytes(page % 65536, 2), hexed("8180" + "0001" * 2 + "0000" * 2), question, answer)
    return pages.select(page.alias("packet_index"), message.alias("payload"))


def client_hello(host: Column) -> Column:
    """A ClientHello message that names a server."""
    hexed = lambda digits: F.unhex(F.lit(digits))
    name, n = host.cast("binary"), F.octet_length(host)
    extension = F.concat(hexed("0000"), number_bytes(n + 5, 2), number_bytes(n + 3, 2), hexed("00"), number_bytes(n, 2), name)
    body = F.concat(hexed("0303" + "11" * 32 + "00" + "00021301" + "0100"), number_bytes(n + 9, 2), extension)
    return F.concat(hexed("01"), number_bytes(n + 52, 3), body)


def tls_segments(spark: SparkSession, folder: str) -> DataFrame:
    """A ClientHello over two records for each page, then encrypted ones, and an alert, data or bytes that are no record."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("page_id is not null")
    kind = F.col("page_id") % 4
    hexed = lambda digits: F.unhex(F.lit(digits))
    hello = client_hello(page_host())
    rest = F.expr("substring(hello, 21)")
    record = lambda kind, size, body: F.concat(hexed(f"{kind}0303"), number_bytes(size, 2), body)
    last = F.when(kind == 1, hexed("1503030002" + "0228")).when(kind == 2, hexed("170303012c" + "77" * 300)).when(kind == 3, hexed("ff" * 9)).otherwise(hexed(""))
    made = pages.withColumn("hello", hello)
    data = F.concat(record("16", F.lit(20), F.expr("substring(hello, 1, 20)")), record("16", F.octet_length(rest), rest), hexed("140303000101"), hexed("1603030010" + "55" * 16), last)
    return in_pieces(made.select(F.col("page_id").alias("flow_index"), F.lit("A->B").alias("direction"), data.alias("data")), 33)


def certificate_segments(spark: SparkSession, folder: str) -> DataFrame:
    """A TLS Certificate message for each page, of a certificate that names the page's host; every ninth holds something else."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("page_id is not null")
    hexed = lambda digits: (F.unhex(F.lit(digits)), F.lit(len(digits) // 2))
    text = lambda value: (value.cast("binary"), F.length(value))
    joined = lambda *parts: (F.concat(*[b for b, _ in parts]), sum((n for _, n in parts[1:]), parts[0][1]))

    def tlv(tag: str, *parts):
        data, n = joined(*parts)
        return F.concat(F.unhex(F.lit(f"{tag}82")), number_bytes(n, 2), data), n + 4

    name = lambda value: tlv("30", tlv("31", tlv("30", hexed("0603550403"), tlv("0c", text(value)))))
    host = page_host()
    day = lambda year: tlv("17", text(F.concat(F.lit(str(year)), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("01000000Z"))))
    names = tlv("30", tlv("82", text(host)), tlv("82", text(F.concat(F.lit("www."), host))))
    extensions = tlv("a3", tlv("30", tlv("30", hexed("0603551d0f" + "0101ff" + "040100"), ), tlv("30", hexed("0603551d11"), tlv("04", names))))
    issuer = F.concat(F.lit("CA "), (F.col("page_id") % 7).cast("string"))
    body = tlv("30", hexed("a003020102"), hexed("020105"), hexed("3000"), name(issuer), tlv("30", day(24), day(34)), name(host), hexed("3000"), extensions)
    certificate, n = tlv("30", body, hexed("3000"), hexed("0300"))
    made = pages.withColumn("certificate", F.when(F.col("page_id") % 9 == 4, F.unhex(F.lit("04023000"))).otherwise(certificate)).withColumn("n", F.octet_length("certificate"))
    message = F.concat(F.unhex(F.lit("160303")), number_bytes(F.col("n") + 10, 2), F.unhex(F.lit("0b")), number_bytes(F.col("n") + 6, 3), number_bytes(F.col("n") + 3, 3), number_bytes(F.col("n"), 3), F.col("certificate"))
    return in_pieces(made.select(F.col("page_id").alias("flow_index"), F.lit("B->A").alias("direction"), message.alias("data")), 100)


def text_hint(payload: Column) -> Column:
    """``http`` or ``ssh`` by how the payload begins."""
    http = payload.startswith("HTTP/1.")
    for method in HTTP_METHODS:
        http = http | payload.startswith(f"{method} ")
    return F.when(http, "http").when(payload.startswith("SSH-"), "ssh")


def http_service(payload: Column, use_path: bool = False) -> Column:
    """The Host header of a request, else on request the path.

    Only header lines count, up to the first empty one; they end in CR LF or LF. A host that is no plain name is none.
    """
    request = f"^(?:{'|'.join(HTTP_METHODS)}) "
    host = F.trim(F.regexp_extract(payload, f"(?i){request}[^\\n]*\\n(?:(?!host:)[^\\r\\n][^\\n]*\\n)*?host:[ \\t]*([^\\r\\n]*)", 1))
    host = F.when(payload.rlike(request) & host.rlike("^[A-Za-z0-9._-]+$"), host)
    path = F.nullif(F.regexp_extract(payload, "^[A-Z]+ ([^ \\r\\n]+)", 1), F.lit(""))
    return F.coalesce(host, path) if use_path else host


def hinted(packets: DataFrame) -> DataFrame:
    hint = text_hint(F.col("payload"))
    return packets.select("packet_index", hint.alias("hint"), F.when(hint == "http", http_service(F.col("payload"))).alias("service"))
