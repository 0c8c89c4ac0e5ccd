"""What payloads tell: hint, service name and version, for many packets at once; names are read one by one only where a hint calls for them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .streams import HTTP_METHODS

# First bytes of text protocols, multicast groups, magic numbers and QUIC versions.
SMTP, POP3 = ("220 ", "220-", "EHLO ", "HELO ", "MAIL FROM:"), ("+OK", "-ERR", "USER ", "PASS ")
IMAP = re.compile(rb"\* OK|[A-Za-z0-9]+ (LOGIN|CAPABILITY)")
MDNS_GROUPS = (bytes([224, 0, 0, 251]), bytes.fromhex("ff0200000000000000000000000000fb"))
DHCP_MAGIC, STUN_MAGIC = 0x63825363, 0x2112A442
QUIC_VERSIONS = {1: "v1", 0xFF00001D: "draft29", 0x6B3343CF: "v2"}
NAMES = ["dns", "tls", "http", "ssh", "smtp", "pop3", "imap", "bittorrent", "mdns", "quic", "dhcp", "stun", "igmp", "igmpv1", "igmpv2", "igmpv3"]
PLAUSIBLE = re.compile(r"[A-Za-z0-9._-]+")
SCHEMA = "hint string, service string, tls_version string, quic_version string"


class Payloads:
    """Payloads as places in one buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data, self.at, self.size = np.concatenate([data, np.zeros(256, np.uint8)]), at, size

    def number(self, offset: int, size: int) -> np.ndarray:
        """Big-endian number; -1 beyond the payload's end."""
        total = np.zeros(len(self.at), np.int64)
        for j in range(offset, offset + size):
            total = total << 8 | self.data[self.at + np.where(self.size > j, j, 0)]
        return np.where(self.size >= offset + size, total, -1)

    def begins(self, text: str) -> np.ndarray:
        found = self.size >= len(text)
        for j, c in enumerate(text.encode("latin-1")):
            found &= self.data[self.at + np.where(self.size > j, j, 0)] == c
        return found

    def one(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i] + self.size[i]].tobytes()


def host_of(payload: bytes) -> str | None:
    """The Host of a request: lines up to the first empty one, ended by CR LF or, where none follows, LF; null for one that is no name."""
    if not payload.startswith(tuple(f"{m} ".encode() for m in HTTP_METHODS)):
        return None
    at = 0
    while at < len(payload):
        end, step = payload.find(b"\r\n", at), 2
        if end < 0:
            end, step = payload.find(b"\n", at), 1
        if end < 0:
            end, step = len(payload), 0
        line = payload[at:end]
        if not line:
            return None
        if line[:5].lower() == b"host:":
            name = line[5:].strip(b" \t\r\n").decode("latin-1")
            return name if PLAUSIBLE.fullmatch(name) else None
        if not step:
            return None
        at = end + step
    return None


def question_of(message: bytes, at: int) -> str | None:
    """The first question's name in a DNS message; null if it is cut, compressed or empty."""
    labels = []
    while at < len(message) and (size := message[at]):
        if size >= 64 or at + 1 + size > len(message):
            return None
        labels.append(message[at + 1 : at + 1 + size].decode("latin-1"))
        at += 1 + size
    return ".".join(labels) or None if at < len(message) else None


def server_name_of(payload: bytes) -> str | None:
    """The server name of a TLS ClientHello that one record begins with."""
    if len(payload) < 6 or payload[0] != 22 or payload[5] != 1:
        return None
    return hello_name(payload[9:])


def hello_name(hello: bytes) -> str | None:
    """The server name in a ClientHello's body: any number of extensions, as far as the bytes go."""
    number = lambda at, size: int.from_bytes(hello[at : at + size], "big") if at + size <= len(hello) else None
    at = 34
    for size in (1, 2, 1):  # session id, cipher suites, compression methods
        length = number(at, size)
        if length is None:
            return None
        at += size + length
    total = number(at, 2)
    if total is None:
        return None
    at, end = at + 2, min(at + 2 + total, len(hello))
    while at + 4 <= end:
        kind, size = number(at, 2), number(at + 2, 2)
        if kind == 0:
            length = number(at + 7, 2)
            fits = length is not None and hello[at + 6] == 0 and length + 5 <= size and at + 4 + size <= end
            return hello[at + 9 : at + 9 + length].decode("latin-1") or None if fits else None
        at += 4 + size
    return None


def dotted(address: bytes) -> str:
    return ".".join(map(str, address))


def arp_text(message: bytes | None) -> str | None:
    """What an ARP message asks or says."""
    if message is None:
        return None
    if len(message) < 8:
        return "ARP"
    hardware, size, code = message[4], message[5], int.from_bytes(message[6:8], "big")
    if len(message) < 8 + 2 * hardware + 2 * size:
        return "ARP"
    if message[:6] != b"\0\1\x08\0\6\4":
        return f"ARP opcode {code}" if code else "ARP"
    sender, target = message[14:18], message[24:28]
    if code in (1, 2) and sender == target and any(sender):
        return f"Gratuitous ARP for {dotted(sender)}"
    if code == 1:
        return f"Who has {dotted(target)}? Tell {dotted(sender)}" if any(sender) else f"ARP probe for {dotted(target)}"
    if code == 2:
        return f"{dotted(sender)} is at {':'.join(f'{x:02x}' for x in message[8:14])}"
    return f"ARP opcode {code}"


def igmp_text(message: bytes, target: bytes) -> tuple[str, str]:
    """IGMP's version and what the message says; the group is the message's, else the packet's destination."""
    group = dotted(message[4:8] if any(message[4:8]) else target)
    kind = message[0]
    if kind == 0x11:
        return ("igmpv2" if message[1] else "igmpv1"), f"Group-Specific Query {group}" if any(message[4:8]) else "General Query"
    if kind in (0x12, 0x16):
        return ("igmpv1" if kind == 0x12 else "igmpv2"), f"Membership Report {group}"
    if kind == 0x17:
        return "igmpv2", f"Leave Group {group}"
    if kind == 0x22:
        return "igmpv3", "IGMPv3 Membership Report"
    return "igmp", f"Unknown IGMP Type 0x{kind:02x}"


def find_hints(data: np.ndarray, at: np.ndarray, size: np.ndarray, protocol: np.ndarray, src_port: np.ndarray, dst_port: np.ndarray, targets: pa.Array, control: pa.Array) -> dict[str, pa.Array]:
    """The columns of ``SCHEMA``: the first rule that fits a payload. Fragments and packets without a payload (size 0) have no hint."""
    p = Payloads(data, np.where(size > 0, at, 0), size)
    filled = size > 0
    tcp, udp = filled & (protocol == 6), filled & (protocol == 17)
    on = lambda *ports: np.isin(src_port, ports) | np.isin(dst_port, ports)
    any_of = lambda texts: np.logical_or.reduce([p.begins(t) for t in texts])
    rows = lambda mask, rule: np.array([bool(rule(i)) for i in np.flatnonzero(mask)], bool)
    hint = np.zeros(len(size), np.int32)

    def mark(mask: np.ndarray, name: str) -> None:
        hint[mask & (hint == 0)] = NAMES.index(name) + 1

    first, second = p.number(0, 1), p.number(1, 1)
    length = p.number(3, 2)
    mark(tcp & on(53) & (size >= 14) & (p.number(6, 2) > 0), "dns")
    mark(tcp & (first >= 20) & (first <= 23) & (second == 3) & (p.number(2, 1) >= 0) & (p.number(2, 1) <= 4) & (length >= 1) & (length <= 18432), "tls")
    mark(tcp & (p.begins("HTTP/1.") | any_of([f"{m} " for m in HTTP_METHODS])), "http")
    mark(tcp & p.begins("SSH-"), "ssh")
    mark(tcp & on(25, 587) & any_of(SMTP), "smtp")
    mark(tcp & on(110) & any_of(POP3), "pop3")
    mail = tcp & on(143) & (hint == 0)
    mail[mail] = rows(mail, lambda i: IMAP.match(p.one(i)))
    mark(mail, "imap")
    mark(tcp & p.begins("\x13BitTorrent protocol") & (size >= 68), "bittorrent")

    group = udp & on(5353)
    group[group] = rows(group, lambda i: targets[int(i)].as_py() in MDNS_GROUPS)
    mark(group & (size >= 12) & ((p.number(4, 4) > 0) | (p.number(8, 4) > 0)), "mdns")
    mark(udp & on(53) & (size >= 12) & (p.number(4, 2) > 0), "dns")
    mark(udp & on(443) & (size >= 7) & (first & 0xC0 == 0xC0) & (p.number(1, 4) != 0), "quic")
    mark(udp & on(67, 68) & (size >= 240) & (p.number(236, 4) == DHCP_MAGIC), "dhcp")
    stun = p.number(2, 2)
    mark(udp & (size >= 20) & (first & 0xC0 == 0) & (stun % 4 == 0) & (p.number(4, 4) == STUN_MAGIC) & (stun + 20 == size), "stun")

    named = lambda name: hint == NAMES.index(name) + 1
    service: list = [None] * len(size)
    questions = p.number(4, 2) > 0
    for mask, read in (
        (named("http"), host_of),
        (named("tls"), server_name_of),
        (named("dns") & tcp, lambda x: question_of(x, 14)),
        ((named("dns") & udp) | (named("mdns") & questions), lambda x: question_of(x, 12)),
    ):
        for i in np.flatnonzero(mask):
            service[i] = read(p.one(i))
    for i in np.flatnonzero(protocol == 253):
        service[i] = arp_text(control[int(i)].as_py())
    for i in np.flatnonzero((protocol == 2) & control.is_valid().to_numpy(zero_copy_only=False)):
        name, service[i] = igmp_text(control[int(i)].as_py(), targets[int(i)].as_py())
        hint[i] = NAMES.index(name) + 1
    version = p.number(1, 2)
    tls = np.where(version == 0x0303, 1, np.where(version == 0x0304, 2, 3))
    quic = np.full(len(size), len(QUIC_VERSIONS) + 1)
    for k, value in enumerate(QUIC_VERSIONS, 1):
        quic[p.number(1, 4) == value] = k
    pick = lambda names, number: pa.array([None, *names], pa.string()).take(pa.array(number, pa.int32()))
    return {
        "hint": pick(NAMES, hint),
        "service": pa.array(service, pa.string()),
        "tls_version": pick(["tls12", "tls13", "unknown"], np.where(named("tls"), tls, 0)),
        "quic_version": pick([*QUIC_VERSIONS.values(), "unknown"], np.where(named("quic"), quic, 0)),
    }
