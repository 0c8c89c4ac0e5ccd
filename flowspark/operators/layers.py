"""A machine that walks the layers of many packets at once, over the bytes of an Arrow batch.

Every packet has a cursor and a selector that names its next layer. A turn groups the packets by
selector, reads each group's headers with array operations and moves cursors and selectors on, until
no packet has a next layer or ``MAX_DEPTH`` turns are over. So tags, labels, extension headers and
tunnels may nest in any order, and the work of a turn does not depend on how packets are mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import hints

# Link types, EtherTypes, PPP and IP protocol numbers, ports, limits, and the texts of reasons.
LINK_ETHERNET, LINK_SLL, LINK_SLL2 = 1, 113, 276
IPV4, IPV6, ARP, BRIDGED, EOIP = 0x0800, 0x86DD, 0x0806, 0x6558, 0x6400
VLAN_TYPES, MPLS_TYPES = (0x8100, 0x88A8, 0x9100), (0x8847, 0x8848)
PBB, MACSEC, PPPOE_DISCOVERY, PPPOE_SESSION = 0x88E7, 0x88E5, 0x8863, 0x8864
MIN_ETHERTYPE = 0x0600
MAX_DEPTH, MAX_LABELS = 48, 16
EXTENSIONS, FRAGMENT, AH, ESP, GRE = (0, 43, 60), 44, 51, 50, 47
ICMP, IGMP, IP_IN_IP, TCP, UDP, IPV6_IN_IP, ICMPV6, SCTP, OF_ARP = 1, 2, 4, 6, 17, 41, 58, 132, 253
VXLAN_PORT, GENEVE_PORT, GTPU_PORT = 4789, 6081, 2152
DISCOVERY = {0x09: "PPPoE Discovery PADI", 0x07: "PPPoE Discovery PADO", 0x19: "PPPoE Discovery PADR", 0x65: "PPPoE Discovery PADS", 0xA7: "PPPoE Discovery PADT"}
PPP_CONTROL = {0xC021: "PPP LCP control packet", 0x8021: "PPP IPCP control packet", 0x8057: "PPP IPv6CP control packet"}
UNSUPPORTED, NO_KEY = "Unsupported or malformed packet", "Could not extract flow key"

# Selectors: an EtherType as it is, an IP protocol or IPv6 next header above its base, and names for the rest.
V4, V6 = 1 << 16, 1 << 17
OTHER = 1 << 18
(ROOT_ETHERNET, ROOT_SLL, ROOT_SLL2, LLC, MPLS, MPLS_PAYLOAD, INNER_ETHERNET, VXLAN, GENEVE, GTPU) = range(OTHER, OTHER + 10)
DONE, FAILED = -1, -2
IN_PBB, IN_WIRE = 1, 2

#: What a packet keeps when an overlay inside its UDP payload turns out not to be one.
KEPT = ("src_at", "dst_at", "address_size", "protocol", "src_port", "dst_port", "payload_at", "cap", "end", "n_labels")


class Machine:
    """The state of a batch of packets, as arrays by packet."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, links: np.ndarray, originals: np.ndarray):
        n = len(starts)
        self.begin = starts
        self.data = np.concatenate([data, np.zeros(64, np.uint8)])
        self.at, self.cap = starts.astype(np.int64), (starts + lengths).astype(np.int64)
        self.end = self.at + np.maximum(lengths, originals)  # where the packet ends as it was sent
        self.kind = np.full(n, FAILED, np.int64)
        for link, root in ((LINK_ETHERNET, ROOT_ETHERNET), (LINK_SLL, ROOT_SLL), (LINK_SLL2, ROOT_SLL2)):
            self.kind[links == link] = root
        self.src_at, self.dst_at, self.payload_at = (np.zeros(n, np.int64) for _ in range(3))
        self.address_size, self.protocol, self.src_port, self.dst_port, self.flags, self.n_labels, self.within = (np.zeros(n, np.int32) for _ in range(7))
        self.sequence, self.acknowledgement = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.fragmented, self.overlay, self.labelled, self.tunnelled = (np.zeros(n, bool) for _ in range(4))
        self.reason = np.zeros(n, np.int32)
        self.texts: dict[str, int] = {}
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        self.kept: dict[str, np.ndarray] = {}
        self.fail(np.flatnonzero(self.kind == FAILED), UNSUPPORTED)

    # Reading: numbers at an offset from the cursor; callers have asked ``has`` before.

    def has(self, i: np.ndarray, size) -> np.ndarray:
        return self.at[i] + size <= np.minimum(self.cap[i], self.end[i])

    def number(self, i: np.ndarray, offset, size: int, little: bool = False) -> np.ndarray:
        first = np.minimum(self.at[i] + offset, len(self.data) - size)
        parts = [self.data[first + j].astype(np.int64) for j in range(size)]
        total = np.zeros(len(i), np.int64)
        for x in reversed(parts) if little else parts:
            total = total << 8 | x
        return total

    # Moving on.

    def text(self, text: str) -> int:
        return self.texts.setdefault(text, len(self.texts))

    def layer(self, i: np.ndarray, name: str, values: np.ndarray | None = None, at: np.ndarray | None = None) -> None:
        """Add a layer, whose header begins at the cursor unless ``at`` says where, to the paths; ``values`` fill the name's pattern."""
        if values is None:
            number = np.full(len(i), self.text(name), np.int32)
        else:
            different, place = np.unique(values, return_inverse=True)
            number = np.array([self.text(name.format(int(v))) for v in different], np.int32)[place] if len(i) else np.zeros(0, np.int32)
        self.layers.append((i, number, self.at[i] if at is None else at))
        self.n_labels[i] += 1

    def go(self, i: np.ndarray, size, kind) -> None:
        self.at[i] += size
        self.kind[i] = kind

    def done(self, i: np.ndarray, payload=None) -> None:
        self.kind[i] = DONE
        if payload is not None:
            self.payload_at[i] = self.at[i] + payload

    def fail(self, i: np.ndarray, reason: str, own_tunnel: bool = True) -> None:
        """End packets without a flow. Inside an overlay the outer UDP flow stands; inside another tunnel no key is found."""
        back = self.overlay[i]
        for name, values in self.kept.items():
            getattr(self, name)[i[back]] = values[i[back]]
        self.kind[i[back]] = DONE
        i = i[~back]
        self.kind[i] = FAILED
        self.reason[i] = np.where(self.tunnelled[i] & own_tunnel, self.text(NO_KEY), self.text(reason))

    def split(self, i: np.ndarray, good: np.ndarray, reason: str) -> np.ndarray:
        """Packets that pass; the others end for ``reason``."""
        if not good.all():
            self.fail(i[~good], reason)
            i = i[good]
        return i

    def split_labelled(self, i: np.ndarray, good: np.ndarray, reason: str, other: str | None = None) -> np.ndarray:
        """Like ``split``; behind MPLS the reason names the inner header (and else is ``other``, if given)."""
        bad = i[~good]
        self.fail(bad[self.labelled[bad]], f"Inner {reason}")
        self.fail(bad[~self.labelled[bad]], other or reason)
        return i[good]

    def by_type(self, i: np.ndarray, size, kind: np.ndarray) -> None:
        """Go on with an EtherType: a length means LLC, and what a PBB or pseudowire frame may hold is checked."""
        self.at[i] += size
        framed = kind < MIN_ETHERTYPE
        self.kind[i] = np.where(framed, LLC, np.where(np.isin(kind, MPLS_TYPES), MPLS, kind))
        short = i[framed]
        self.end[short] = np.minimum(self.end[short], self.at[short] + kind[framed])
        known = np.isin(kind, (IPV4, IPV6, ARP, *VLAN_TYPES)) | framed
        for where, reason in ((IN_PBB, "Unknown PBB inner EtherType"), (IN_WIRE, "Unknown MPLS pseudowire inner EtherType")):
            self.fail(i[~known & (self.within[i] == where)], reason)
        over = i[~known | (kind == ARP)]
        self.fail(over[self.overlay[over]], UNSUPPORTED)

    # Layers. Each reads the headers of the packets ``i`` at their cursors.

    def ethernet(self, i: np.ndarray, truncated: str = "Link-layer header truncated") -> None:
        i = self.split(i, self.has(i, 14), truncated)
        kind = self.number(i, 12, 2)
        self.layer(i[kind >= MIN_ETHERTYPE], "EthernetII")
        self.layer(i[kind < MIN_ETHERTYPE], "IEEE 802.3")
        self.by_type(i, 14, kind)

    def inner_ethernet(self, i: np.ndarray) -> None:
        self.ethernet(i, "Inner Ethernet header truncated")

    def cooked(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 16), "Link-layer header truncated")
        self.layer(i, "LinuxSll")
        self.by_type(i, 16, self.number(i, 14, 2))

    def cooked_2(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 20), "Link-layer header truncated")
        self.layer(i, "LinuxSll2")
        self.by_type(i, 20, self.number(i, 0, 2))

    def vlan(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 4), "Link-layer header truncated")
        self.layer(i, "VLAN(vid={})", self.number(i, 0, 2) & 0xFFF)
        self.by_type(i, 4, self.number(i, 2, 2))

    def llc(self, i: np.ndarray) -> None:
        wire, pbb = self.within[i] == IN_WIRE, self.within[i] == IN_PBB
        snap = self.has(i, 8) & (self.number(i, 0, 3) == 0xAAAA03) & np.isin(self.number(i, 6, 2), (IPV4, IPV6, ARP))
        self.fail(i[wire & ~snap], "Unknown MPLS payload")
        self.fail(i[pbb & ~snap], UNSUPPORTED)
        i = i[~(wire | pbb) | snap]
        i = self.split(i, self.has(i, 3), "LLC header truncated")
        i = self.split(i, self.number(i, 0, 3) == 0xAAAA03, "Non-SNAP LLC frame")
        i = self.split(i, self.has(i, 8), "SNAP header truncated")
        kind = self.number(i, 6, 2)
        good = np.isin(kind, (IPV4, IPV6, ARP))
        kind = kind[good]
        i = self.split(i, good, "Unknown SNAP PID")
        self.layer(i, "LLC/SNAP")
        self.by_type(i, 8, kind)

    def pbb(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 4), "PBB I-TAG truncated")
        i = self.split(i, self.has(i, 18), "Inner Ethernet header truncated")
        self.layer(i, "PBB(isid=0x{:06x})", self.number(i, 1, 3))
        self.within[i] = IN_PBB
        self.go(i, 4, INNER_ETHERNET)

    def macsec(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 2), "MACsec SecTAG truncated")
        i = self.split(i, self.has(i, 6), "MACsec packet number truncated")
        header = np.where(self.number(i, 0, 1) & 0x20, 14, 6)
        good = self.has(i, header)
        header = header[good]
        i = self.split(i, good, "MACsec SCI truncated")
        i = self.split(i, self.has(i, header + 16), "MACsec ICV truncated")
        self.fail(i, "MACsec protected payload not decrypted")

    def pppoe_discovery(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 6), "PPPoE Discovery header truncated")
        code = self.number(i, 1, 1)
        for value, reason in DISCOVERY.items():
            self.fail(i[code == value], reason)
        self.fail(i[~np.isin(code, list(DISCOVERY))], "PPPoE Discovery packet")

    def pppoe_session(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 6), "PPPoE Session header truncated")
        i = self.split(i, self.number(i, 0, 2) == 0x1100, UNSUPPORTED)
        i = self.split(i, self.has(i, 8), "PPP protocol field truncated")
        protocol = self.number(i, 6, 2)
        for value, reason in PPP_CONTROL.items():
            self.fail(i[protocol == value], reason)
        good = np.isin(protocol, (0x21, 0x57))
        self.fail(i[~good & ~np.isin(protocol, list(PPP_CONTROL))], "Unknown PPP protocol")
        i, protocol = i[good], protocol[good]
        self.layer(i, "PPPoE")
        self.layer(i, "PPP", at=self.at[i] + 6)
        self.go(i, 8, np.where(protocol == 0x21, IPV4, IPV6))

    def mpls(self, i: np.ndarray) -> None:
        """All labels of the stack: packets leave the loop at its bottom."""
        self.labelled[i] = True
        for _ in range(MAX_LABELS):
            i = self.split(i, self.has(i, 4), "MPLS label header truncated")
            entry = self.number(i, 0, 4)
            self.layer(i, "MPLS(label={})", entry >> 12)
            bottom = (entry & 0x100) != 0
            self.go(i[bottom], 4, MPLS_PAYLOAD)
            i = i[~bottom]
            self.at[i] += 4
        self.fail(i, "MPLS bottom-of-stack not found")

    def mpls_payload(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 1), "Missing MPLS inner payload")
        version = self.number(i, 0, 1) >> 4
        self.kind[i[version == 4]], self.kind[i[version == 6]] = IPV4, IPV6
        i = i[(version != 4) & (version != 6)]
        controlled = self.has(i, 2) & (self.number(i, 0, 2) == 0)
        good = ~controlled | self.has(i, 4)
        controlled = controlled[good]
        i = self.split(i, good, "MPLS pseudowire control word truncated")
        start = np.where(controlled, 4, 0)
        good = self.has(i, start + 14)
        start = start[good]
        i = self.split(i, good, "Inner Ethernet header truncated")
        self.layer(i, "MPLS PW")
        self.within[i] = IN_WIRE
        self.go(i, start, INNER_ETHERNET)

    def arp(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 8), "ARP header truncated")
        hardware, size = self.number(i, 4, 1), self.number(i, 5, 1)
        good = self.has(i, 8 + 2 * hardware + 2 * size)
        hardware, size = hardware[good], size[good]
        i = self.split(i, good, "ARP header truncated")
        good = (self.number(i, 2, 2) == IPV4) & (size == 4)
        hardware = hardware[good]
        i = self.split(i, good, UNSUPPORTED)
        self.src_at[i], self.dst_at[i] = self.at[i] + 8 + hardware, self.at[i] + 12 + 2 * hardware
        self.address_size[i], self.protocol[i] = 4, OF_ARP
        self.done(i)

    def ipv4(self, i: np.ndarray) -> None:
        i = self.split_labelled(i, self.has(i, 20), "IPv4 header truncated")
        first, total = self.number(i, 0, 1), self.number(i, 2, 2)
        header = (first & 15) * 4
        good = (first >> 4 == 4) & (header >= 20) & self.has(i, header) & ((total == 0) | (total >= header))
        header, total = header[good], total[good]
        i = self.split_labelled(i, good, "IPv4 header truncated", UNSUPPORTED)
        parts = (self.number(i, 6, 2) & 0x3FFF) != 0
        good = (total == 0) | (self.at[i] + total <= self.end[i])
        header, total, parts = header[good], total[good], parts[good]
        i = self.split(i, good, NO_KEY)
        self.end[i] = np.where(total == 0, self.end[i], self.at[i] + total)
        self.layer(i, "IPv4")
        self.addresses(i, 12, 16, 4)
        self.protocol[i] = self.number(i, 9, 1)
        self.fragments(i, parts)
        self.go(i[~parts], header[~parts], V4 + self.protocol[i[~parts]])

    def ipv6(self, i: np.ndarray) -> None:
        i = self.split_labelled(i, self.has(i, 40), "IPv6 header truncated")
        i = self.split(i, self.number(i, 0, 1) >> 4 == 6, UNSUPPORTED)
        size = self.number(i, 4, 2)
        good = self.at[i] + 40 + size <= self.end[i]
        size = size[good]
        i = self.split(i, good, NO_KEY)
        self.end[i] = self.at[i] + 40 + size
        self.layer(i, "IPv6")
        self.addresses(i, 8, 24, 16)
        self.protocol[i] = self.number(i, 6, 1)
        self.go(i, 40, V6 + self.protocol[i])

    def addresses(self, i: np.ndarray, source: int, target: int, size: int) -> None:
        self.src_at[i], self.dst_at[i], self.address_size[i] = self.at[i] + source, self.at[i] + target, size

    def fragments(self, i: np.ndarray, parts: np.ndarray) -> None:
        """Fragments end at their IP header; no overlay holds one."""
        parts = i[parts]
        self.fail(parts[self.overlay[parts]], UNSUPPORTED)
        parts = parts[~self.overlay[parts]]
        self.fragmented[parts] = True
        self.done(parts)

    def outside(self, i: np.ndarray) -> np.ndarray:
        """Packets outside overlays: those hold TCP, UDP or SCTP only."""
        self.fail(i[self.overlay[i]], UNSUPPORTED)
        return i[~self.overlay[i]]

    def extension(self, i: np.ndarray) -> None:
        i = self.outside(i)
        good = self.has(i, 2)
        i = self.split(i, good, NO_KEY)
        size = (self.number(i, 1, 1) + 1) * 8
        good = self.has(i, size)
        size = size[good]
        i = self.split(i, good, NO_KEY)
        self.next_header(i, size)

    def next_header(self, i: np.ndarray, size) -> None:
        base = self.kind[i] & (V4 | V6)
        self.protocol[i] = self.number(i, 0, 1)
        self.go(i, size, base + self.protocol[i])

    def fragment_header(self, i: np.ndarray) -> None:
        i = self.outside(i)
        i = self.split(i, self.has(i, 8), NO_KEY)
        parts = (self.number(i, 2, 2) & 0xFFF9) != 0
        self.protocol[i[parts]] = self.number(i[parts], 0, 1)
        self.fragments(i, parts)
        self.next_header(i[~parts], 8)

    def authentication(self, i: np.ndarray) -> None:
        i = self.outside(i)
        i = self.split(i, self.has(i, 12), NO_KEY)
        size = (self.number(i, 1, 1) + 2) * 4
        good = (size >= 12) & self.has(i, size)
        size = size[good]
        i = self.split(i, good, NO_KEY)
        self.layer(i, "AH(spi=0x{:08x})", self.number(i, 4, 4))
        self.next_header(i, size)

    def encrypted(self, i: np.ndarray) -> None:
        i = self.outside(i)
        i = self.split(i, self.has(i, 8), NO_KEY)
        self.layer(i, "ESP(spi=0x{:08x})", self.number(i, 0, 4))
        self.done(i)

    def control_message(self, i: np.ndarray) -> None:
        i = self.outside(i)
        self.done(self.split(i, self.has(i, 2), UNSUPPORTED))

    def group_message(self, i: np.ndarray) -> None:
        i = self.outside(i)
        i = self.split(i, self.has(i, 1), "Missing IGMP payload")
        i = self.split(i, self.has(i, 8), "IGMP header truncated")
        group = i[(self.number(i, 0, 1) != 0x22) & (self.number(i, 4, 4) != 0)]
        self.dst_at[group] = self.at[group] + 4
        self.done(i)

    def ports(self, i: np.ndarray, name: str) -> None:
        self.src_port[i], self.dst_port[i] = self.number(i, 0, 2), self.number(i, 2, 2)
        self.layer(i, name)

    def tcp(self, i: np.ndarray) -> None:
        i = self.split_labelled(i, self.has(i, 20), "TCP header truncated")
        header = (self.number(i, 12, 1) >> 4) * 4
        good = (header >= 20) & self.has(i, header)
        header = header[good]
        i = self.split(i, good, NO_KEY)
        self.ports(i, "TCP")
        self.sequence[i], self.acknowledgement[i], self.flags[i] = self.number(i, 4, 4), self.number(i, 8, 4), self.number(i, 13, 1)
        self.done(i, header)

    def sctp(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 12), NO_KEY)
        self.ports(i, "SCTP")
        self.done(i, 12)

    def udp(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 8), "UDP header truncated")
        size = self.number(i, 4, 2)
        good = (size >= 8) & (self.at[i] + size <= self.end[i])
        size = size[good]
        i = self.split(i, good, UNSUPPORTED)
        self.end[i] = self.at[i] + size
        self.ports(i, "UDP")
        self.done(i, 8)
        for port, kind in ((VXLAN_PORT, VXLAN), (GENEVE_PORT, GENEVE), (GTPU_PORT, GTPU)):
            inner = i[(self.dst_port[i] == port) & ~self.overlay[i]]
            if len(inner):
                for name in KEPT:
                    self.kept.setdefault(name, getattr(self, name).copy())[inner] = getattr(self, name)[inner]
                self.overlay[inner] = True
                self.go(inner, 8, kind)

    def vxlan(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 8), UNSUPPORTED)
        i = self.split(i, (self.number(i, 0, 4) == 0x08000000) & (self.number(i, 7, 1) == 0), UNSUPPORTED)
        self.layer(i, "VXLAN(vni={})", self.number(i, 4, 3))
        self.go(i, 8, INNER_ETHERNET)

    def geneve(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 8), UNSUPPORTED)
        first = self.number(i, 0, 1)
        header = 8 + (first & 0x3F) * 4
        good = (first >> 6 == 0) & self.has(i, header) & (self.number(i, 2, 2) == BRIDGED)
        header = header[good]
        i = self.split(i, good, UNSUPPORTED)
        self.layer(i, "Geneve(vni={})", self.number(i, 4, 3))
        self.go(i, header, INNER_ETHERNET)

    def gtpu(self, i: np.ndarray) -> None:
        start = self.at.copy()
        i = self.split(i, self.has(i, 8), UNSUPPORTED)
        flags, size = self.number(i, 0, 1), self.number(i, 2, 2)
        good = (flags >> 5 == 1) & ((flags & 0x10) != 0) & (self.number(i, 1, 1) == 0xFF) & self.has(i, 8 + size)
        flags, size = flags[good], size[good]
        i = self.split(i, good, UNSUPPORTED)
        teid = self.number(i, 4, 4)
        self.end[i] = self.at[i] + 8 + size
        optional = (flags & 7) != 0
        self.at[i] += 8
        good = ~optional | self.has(i, 4)
        flags, optional, teid = flags[good], optional[good], teid[good]
        i = self.split(i, good, UNSUPPORTED)
        following = np.where((flags & 4) != 0, self.number(i, 3, 1), 0)
        self.at[i] += np.where(optional, 4, 0)
        while (more := following != 0).any():
            j = i[more]
            step = self.number(j, 0, 1) * 4
            good = self.has(j, 1) & (step >= 4) & self.has(j, step)
            following[more] = np.where(good, self.number(j, step - 1, 1), 0)
            self.at[j[good]] += step[good]
            if not good.all():
                bad = np.zeros(len(i), bool)
                bad[np.flatnonzero(more)[~good]] = True
                following, teid = following[~bad], teid[~bad]
                i = self.split(i, ~bad, UNSUPPORTED)
        version = self.number(i, 0, 1) >> 4
        good = self.has(i, 1) & np.isin(version, (4, 6))
        version, teid = version[good], teid[good]
        i = self.split(i, good, UNSUPPORTED)
        self.layer(i, "GTP-U(teid=0x{:08x})", teid, start[i])
        self.kind[i] = np.where(version == 4, IPV4, IPV6)

    def gre(self, i: np.ndarray) -> None:
        i = self.outside(i)
        i = self.split(i, self.has(i, 4), NO_KEY)
        flags, kind = self.number(i, 0, 2), self.number(i, 2, 2)
        bridged = (flags & 0xB007 == 0x2001) & (kind == EOIP) & (self.kind[i] == V4 + GRE)
        self.eoip(i[bridged])
        i, flags, kind = i[~bridged], flags[~bridged], kind[~bridged]
        fields = [(flags & bit) != 0 for bit in (0x8000, 0x2000, 0x1000)]
        header = 4 + 4 * sum(x.astype(np.int64) for x in fields)
        good = (flags & ~0xB000 == 0) & self.has(i, header) & (kind >= MIN_ETHERTYPE)
        header, kind, flags = header[good], kind[good], flags[good]
        i = self.split(i, good, NO_KEY)
        keyed = (flags & 0x2000) != 0
        self.layer(i[keyed], "GRE(key=0x{:08x})", self.number(i[keyed], np.where(flags[keyed] & 0x8000, 8, 4), 4))
        self.layer(i[~keyed], "GRE")
        self.tunnelled[i] = True
        self.by_type(i[kind != BRIDGED], header[kind != BRIDGED], kind[kind != BRIDGED])
        self.go(i[kind == BRIDGED], header[kind == BRIDGED], INNER_ETHERNET)

    def eoip(self, i: np.ndarray) -> None:
        i = self.split(i, self.has(i, 8), NO_KEY)
        size = self.number(i, 4, 2)
        good = self.has(i, 8 + size)
        size = size[good]
        i = self.split(i, good, NO_KEY)
        self.layer(i, "GRE(key=0x{:08x})", self.number(i, 6, 2, little=True))
        self.tunnelled[i] = True
        self.end[i] = self.at[i] + 8 + size
        self.go(i, 8, INNER_ETHERNET)

    def ip_in_ip(self, i: np.ndarray) -> None:
        i = self.outside(i)
        self.tunnelled[i] = True
        first = self.protocol[i] == IP_IN_IP
        self.ipv4(i[first])
        self.ipv6(i[~first])

    def unknown(self, i: np.ndarray) -> None:
        ip = self.kind[i] & (V4 | V6) != 0
        self.fail(i[ip], NO_KEY)
        self.fail(i[~ip], UNSUPPORTED)

    def run(self) -> None:
        for _ in range(MAX_DEPTH):
            active = np.flatnonzero(self.kind >= 0)
            if not len(active):
                return
            kinds = self.kind[active]
            for kind in np.unique(kinds):
                SELECTORS.get(int(kind), Machine.unknown)(self, active[kinds == kind])
        self.unknown(np.flatnonzero(self.kind >= 0))

    # What was found, as Arrow arrays.

    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the packets' layers in flat arrays of their texts' numbers and of where their headers begin."""
        n = len(self.kind)
        columns = [np.concatenate([x[k] for x in self.layers] or [np.zeros(0, np.int64)]) for k in range(3)]
        order = np.argsort(columns[0], kind="stable")
        rows, numbers, places = (c[order] for c in columns)
        first = np.searchsorted(rows, np.arange(n))
        kept = np.arange(len(rows)) - first[rows] < self.n_labels[rows]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[kept], minlength=n))]).astype(np.int32)
        return offsets, numbers[kept], places[kept]

    def paths(self) -> pa.Array:
        offsets, numbers, _ = self.in_order()
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(self.texts), pa.string()).take(pa.array(numbers, pa.int32())))

    def bytes_at(self, starts: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
        """Pieces of the batch's bytes as a binary array, copied in one go."""
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        buffers = [pa.array(valid).buffers()[1] if valid is not None else None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[place])]
        return pa.Array.from_buffers(pa.binary(), len(starts), buffers)

    def control(self, found: np.ndarray) -> pa.Array:
        """ARP, ICMP and IGMP messages from their header on, null for other packets."""
        own = found & ~self.fragmented & np.isin(self.protocol, (ICMP, IGMP, ICMPV6, OF_ARP))
        sizes = np.where(own, np.maximum(np.minimum(self.cap, self.end) - self.at, 0), 0)
        return self.bytes_at(np.where(own, self.at, 0), sizes, own)

    def payloads(self) -> np.ndarray:
        inside = np.minimum(self.cap, self.end) - self.payload_at
        return np.where(self.payload_at > 0, np.maximum(inside, 0), 0)

    def columns(self) -> dict[str, pa.Array]:
        found, whole = self.kind == DONE, ~self.fragmented
        ported = found & whole & np.isin(self.protocol, (TCP, UDP, SCTP))
        is_tcp = ported & (self.protocol == TCP)
        sizes = np.where(ported, self.payloads(), 0)
        masked = lambda values, kind: pa.array(np.where(values < 0, 0, values), kind, mask=~is_tcp)
        reasons = pa.array([*self.texts], pa.string())
        addressed = found & (self.address_size > 0)
        size = np.where(addressed, self.address_size, 0)
        return {
            "family": pa.array(["IPv4", "IPv6"]).take(pa.array((self.address_size == 16).astype(np.int8))),
            "src_addr": self.bytes_at(self.src_at, size, addressed),
            "dst_addr": self.bytes_at(self.dst_at, size, addressed),
            "src_port": pa.array(np.where(ported, self.src_port, 0), pa.int32()),
            "dst_port": pa.array(np.where(ported, self.dst_port, 0), pa.int32()),
            "protocol": pa.array(self.protocol, pa.int32(), mask=~found),
            "path": self.paths(),
            "tcp_flags": pa.array(np.where(is_tcp, self.flags, 0), pa.int32()),
            "sequence": masked(self.sequence, pa.int64()),
            "acknowledgement": masked(self.acknowledgement, pa.int64()),
            "is_ip_fragmented": pa.array(self.fragmented & found),
            "payload_length": pa.array(sizes, pa.int64()),
            "payload": self.bytes_at(np.where(sizes > 0, self.payload_at, 0), sizes),
            "control": self.control(found),
            "reason": reasons.take(pa.array(self.reason, mask=found)),
        }


SELECTORS = {
    ROOT_ETHERNET: Machine.ethernet, ROOT_SLL: Machine.cooked, ROOT_SLL2: Machine.cooked_2, LLC: Machine.llc, MPLS: Machine.mpls, MPLS_PAYLOAD: Machine.mpls_payload, INNER_ETHERNET: Machine.inner_ethernet,
    VXLAN: Machine.vxlan, GENEVE: Machine.geneve, GTPU: Machine.gtpu, PBB: Machine.pbb, MACSEC: Machine.macsec, PPPOE_DISCOVERY: Machine.pppoe_discovery, PPPOE_SESSION: Machine.pppoe_session,
    IPV4: Machine.ipv4, IPV6: Machine.ipv6, ARP: Machine.arp, V6 + FRAGMENT: Machine.fragment_header,
    **dict.fromkeys(VLAN_TYPES, Machine.vlan), **{V6 + x: Machine.extension for x in EXTENSIONS},
    **{base + x: f for base in (V4, V6) for x, f in {AH: Machine.authentication, ESP: Machine.encrypted, GRE: Machine.gre, ICMP: Machine.control_message, ICMPV6: Machine.control_message, IGMP: Machine.group_message,
       IP_IN_IP: Machine.ip_in_ip, IPV6_IN_IP: Machine.ip_in_ip, TCP: Machine.tcp, UDP: Machine.udp, SCTP: Machine.sctp}.items()},
}

SCHEMA = "family string, src_addr binary, dst_addr binary, src_port int, dst_port int, protocol int, path array<string>, tcp_flags int, sequence long, acknowledgement long, is_ip_fragmented boolean, payload_length long, payload binary, control binary, reason string, " + hints.SCHEMA


def machine_over(packets: pa.Array, links: pa.Array, originals: pa.Array | None = None) -> Machine:
    """A machine that has walked packets given as bytes (none null), link types and, if known, lengths as sent."""
    if packets.type != pa.binary():
        packets = packets.cast(pa.binary())
    n = len(packets)
    offsets = np.frombuffer(packets.buffers()[1], np.int32)[packets.offset : packets.offset + n + 1].astype(np.int64)
    data = np.frombuffer(packets.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and packets.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    sent = lengths if originals is None else originals.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # One byte before all packets: an offset of 0 means that nothing was found.
    machine = Machine(np.concatenate([np.zeros(1, np.uint8), data]), offsets[:-1] - offsets[0] + 1, lengths, links.fill_null(0).to_numpy(zero_copy_only=False), sent)
    machine.run()
    return machine


def walk_layers(packets: pa.Array, links: pa.Array, originals: pa.Array | None = None) -> dict[str, pa.Array]:
    """The columns of ``SCHEMA`` for packets as ``machine_over`` takes them."""
    machine = machine_over(packets, links, originals)
    found = machine.columns()
    sizes = found["payload_length"].to_numpy()
    ports = (found[c].to_numpy() for c in ("src_port", "dst_port"))
    return found | hints.find_hints(machine.data, machine.payload_at, sizes, machine.protocol, *ports, found["dst_addr"], found["control"])
