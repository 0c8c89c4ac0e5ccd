"""Texts of addresses, times, sizes, counts and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol numbers and names, names of hints where upper case is not enough, and short layer names.
PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 50: "ESP", 58: "ICMPv6", 132: "SCTP", 253: "ARP"}
HINT_NAMES = {"bittorrent": "BitTorrent", "possible_tls": "Possible TLS", "possible_quic": "Possible QUIC", "mdns": "mDNS"}
SHORT_LAYERS = {"EthernetII": "EII", "VLAN": "Vl", "IPv4": "Ip4", "IPv6": "Ip6"}
TCP_FLAGS = [(0x80, "CWR"), (0x40, "ECE"), (0x20, "URG"), (0x10, "ACK"), (0x08, "PSH"), (0x04, "RST"), (0x02, "SYN"), (0x01, "FIN")]


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def choose(value: Column, names: dict, otherwise: Column) -> Column:
    found = otherwise
    for key, name in names.items():
        found = F.when(value == key, F.lit(name)).otherwise(found)
    return found


def protocol_text(protocol: Column) -> Column:
    return choose(protocol, PROTOCOLS, F.lit("unknown"))


def hint_text(hint: Column) -> Column:
    return F.when(hint.isNull(), F.lit("")).otherwise(choose(hint, HINT_NAMES, F.upper(hint)))


def address_text(address: Column) -> Column:
    """Dotted for 4 bytes, eight groups of four hexadecimal digits for 16."""
    digits = F.lower(F.hex(address))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10)
    v6 = F.concat_ws(":", *[F.substring(digits, 4 * i + 1, 4) for i in range(8)])
    return F.when(F.octet_length(address) == 4, F.concat_ws(".", *[byte(i) for i in range(4)])).otherwise(v6)


def endpoint_text(address: Column, port: Column) -> Column:
    host = address_text(address)
    return F.when(F.octet_length(address) == 4, F.concat(host, F.lit(":"), port.cast("string"))).otherwise(F.concat(F.lit("["), host, F.lit("]:"), port.cast("string")))


def time_of_day(ts_us: Column) -> Column:
    """``HH:MM:SS.uuuuuu`` of the day in UTC."""
    micros, seconds = ts_us % 1_000_000, F.floor(ts_us / 1_000_000) % 86400
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(pad(F.floor(seconds / 3600), 2), F.lit(":"), pad(F.floor(seconds / 60) % 60, 2), F.lit(":"), pad(seconds % 60, 2), F.lit("."), pad(micros, 6))


def size_text(size: Column) -> Column:
    """Bytes in units of 1024 with one decimal, left out if it is 0."""
    found = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        scaled = F.round(size / float(1024**power), 1)
        whole = F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(scaled.cast("decimal(20,1)").cast("string"))
        found = F.when(size >= 1024**power, F.concat(whole, F.lit(f" {unit}"))).otherwise(found)
    return found


def count_text(count: Column) -> Column:
    return F.translate(F.format_number(count, 0), ",", " ")


def percent_text(percent: Column) -> Column:
    """Whole from 1 on, two decimals below, ``<0.01%`` for less."""
    small = F.concat(percent.cast("decimal(10,2)").cast("string"), F.lit("%"))
    whole = F.concat(F.round(percent, 0).cast("long").cast("string"), F.lit("%"))
    return F.when(percent <= 0, F.lit("0%")).when(percent < 0.01, F.lit("<0.01%")).when(percent < 1, small).otherwise(whole)


def tree_percent_text(percent: Column) -> Column:
    """One decimal from 1 on, left out if it is 0; two below, ``<0.01%`` for less."""
    one = F.round(percent, 1)
    large = F.when(one == F.floor(one), F.floor(one).cast("string")).otherwise(one.cast("decimal(10,1)").cast("string"))
    return F.when(percent <= 0, F.lit("0%")).when(percent < 0.01, F.lit("<0.01%")).when(percent < 1, F.concat(percent.cast("decimal(10,2)").cast("string"), F.lit("%"))).otherwise(F.concat(large, F.lit("%")))


def hex_dump(data: Column) -> Column:
    """Lines of offset, 16 bytes in hexadecimal and their printable characters."""
    digits, size = F.lower(F.hex(data)), F.octet_length(data)

    def line(at: Column) -> Column:
        n = F.least(F.lit(16), size - at)
        codes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, (2 * (at + i) + 1).cast("int"), F.lit(2)))
        shown = F.regexp_replace(F.decode(F.substring(data, (at + 1).cast("int"), n.cast("int")), "ISO-8859-1"), "[^\\x20-\\x7E]", ".")
        return F.concat(F.lpad(F.lower(F.hex(at)), 8, "0"), F.lit("  "), F.rpad(F.array_join(codes, " "), 47, " "), F.lit("  "), shown)

    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1, F.lit(16)), line), "\n")).otherwise("")


def flags_text(flags: Column) -> Column:
    return F.concat_ws("|", *[F.when(flags.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in TCP_FLAGS])


def path_text(path: Column) -> Column:
    return F.array_join(path, " -> ")


def layer_kind(layer: Column) -> Column:
    """A layer's name without its identifier."""
    return F.regexp_replace(layer, "\\(.*$", "")


# Full names of layers where they differ from a path's, and how identifiers are called.
FULL_LAYERS = {"EthernetII": "Ethernet II", "LinuxSll": "Linux SLL", "LinuxSll2": "Linux SLL2"}
IDENTIFIERS = {"vid": "VID", "label": "label", "isid": "I-SID", "vni": "VNI", "teid": "TEID", "key": "key", "spi": "SPI"}


def display_layer(layer: Column) -> Column:
    """A layer as it is shown: its full name and, in brackets, what identifies it, hexadecimal digits in capitals."""
    name, value = F.regexp_extract(layer, "\\((\\w+)=", 1), F.regexp_extract(layer, "=(.*)\\)$", 1)
    value = F.when(value.startswith("0x"), F.concat(F.lit("0x"), F.upper(F.substring(value, 3, 16)))).otherwise(value)
    full = choose(layer_kind(layer), FULL_LAYERS, layer_kind(layer))
    return F.when(name == "", full).otherwise(F.concat(full, F.lit(" ("), choose(name, IDENTIFIERS, name), F.lit(" "), value, F.lit(")")))


def display_path(path: Column) -> Column:
    return F.array_join(F.transform(path, display_layer), " -> ")


def compact_path(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: choose(layer_kind(x), SHORT_LAYERS, layer_kind(x))), "|")


def csv_field(value: Column) -> Column:
    """Quoted, quotes doubled, if the text holds a comma, a quote, a line break, a tab or a space."""
    return F.when(value.rlike('[,"\\r\\n\\t ]'), F.concat(F.lit('"'), F.regexp_replace(value, '"', '""'), F.lit('"'))).otherwise(value)


def csv_path(path: Column) -> Column:
    """One line without blanks around the arrows."""
    return F.replace(F.trim(F.regexp_replace(path, "[\\r\\n\\t ]+", " ")), F.lit(" -> "), F.lit("->"))


def file_name(text: Column, length: int = 32) -> Column:
    """Letters, digits, dots, dashes and underscores; each run of anything else is one underscore."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, length)
