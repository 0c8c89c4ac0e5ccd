"""Alignment of two tokenizers: shared cuts, groups of tokens between them, and links between overlapping tokens."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AgingMemory, discard, materialize, narrow, run_numbers, slices, widen, worker_memory

#: A link's key is A id * 2^32 + B id.
B_BITS = 32
#: Parts of a text that both tokenizers cut apart: a blank after a character that is no white space begins the next one.
PART = re.compile(r" (?:[^ ]+|(?<=\s) )*")
REMEMBERED, LONGEST_REMEMBERED, ENCODED_AT_ONCE, TEXTS_AT_ONCE = 80_000, 64, 4_000, 32


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, by character."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenizerPair:
    """Tokenizers A (byte-level BPE) and B (pieces with byte fallback), and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        of_char, vocabulary = byte_level(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        #: B never joins across a blank unless a piece has one behind another character; then texts are not cut.
        self.cuts_at_blanks = not any("▁" in p.lstrip("▁") for p in pieces)
        self.memory = AgingMemory(REMEMBERED)

    def parts(self, text: str) -> list[str]:
        parts = PART.findall(f" {text}") if self.cuts_at_blanks else [f" {text}"]
        if parts[-1] == " ":  # B adds no blank to nothing
            parts[-2:] = ["".join(parts[-2:])]
        return parts

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for texts that begin with the blank that B adds itself; None where bytes differ from the text's."""
        found = []
        for text, a, b in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            data = text.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a.ids)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data
            found.append((np.array(a.ids, np.int64), np.array(b, np.int64)) if same else None)
        return found

    def groups_of(self, parts: list[str]) -> list:
        """For each part: its groups as text, its links' keys as bytes, and its tokens of A and B and groups; None where bytes differ.

        Parts are encoded many at a time, joined where the cut between them is sure.
        """
        joined, size = [[]], 0
        for i, part in enumerate(parts):
            if size + len(part) > ENCODED_AT_ONCE or part[-1:].isspace() or "▁" in part:
                joined.append([])
                size = 0
            joined[-1].append(i)
            size += len(part)
            if part[-1:].isspace() or "▁" in part:
                size = ENCODED_AT_ONCE
        joined = [m for m in joined if m]
        found: list = [None] * len(parts)
        for at in range(0, len(joined), TEXTS_AT_ONCE):
            some = joined[at : at + TEXTS_AT_ONCE]
            ids = self.encode(["".join(parts[i] for i in m) for m in some])
            encoded = [(m, x) for m, x in zip(some, ids, strict=True) if x is not None or len(m) == 1]
            alone = [i for m, x in zip(some, ids, strict=True) if x is None and len(m) > 1 for i in m]
            encoded += zip([[i] for i in alone], self.encode([parts[i] for i in alone]), strict=True)
            for members, pair in encoded:
                if pair is not None:
                    lengths = [len(parts[i].encode()) for i in members]
                    for i, record in zip(members, self.records(*pair, np.cumsum(lengths)), strict=True):
                        found[i] = record
        return found

    def records(self, a: np.ndarray, b: np.ndarray, part_ends: np.ndarray) -> list[tuple]:
        cuts_a, cuts_b, link_a, link_b, links_at = align_bitsets(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        text_a, text_b = [*map(str, a.tolist())], [*map(str, b.tolist())]
        groups, from_a, from_b = [], 0, 0
        for to_a, to_b in zip(cuts_a.tolist(), cuts_b.tolist(), strict=True):
            groups.append(f"{','.join(text_a[from_a:to_a])}|{','.join(text_b[from_b:to_b])}")
            from_a, from_b = to_a, to_b
        keys = (a[link_a] << B_BITS) | b[link_b]
        group_ends = np.cumsum(self.length_a[a])[cuts_a - 1]
        records, before = [], (0, 0, 0, 0)
        for now in zip(np.searchsorted(group_ends, part_ends, "right").tolist(), np.searchsorted(links_at, part_ends, "right").tolist(), strict=True):
            to_a, to_b = int(cuts_a[now[0] - 1]), int(cuts_b[now[0] - 1])
            records.append((";".join(groups[before[0] : now[0]]), keys[before[1] : now[1]].tobytes(), to_a - before[2], to_b - before[3], now[0] - before[0]))
            before = (*now, to_a, to_b)
        return records


def packed(positions: np.ndarray, n_words: int) -> np.ndarray:
    """A bitset in 64-bit words with a bit for each position."""
    bits = np.zeros(n_words * 64, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """Positions of all set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each position: whole words by their running popcount, the rest by a masked one."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)


def align_bitsets(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Alignment of two divisions of the same bytes, given where their tokens end.

    Returns, for each shared cut, how many tokens of A and of B lie before it; and for each link
    the numbers of its tokens and where its overlap ends. Two tokens overlap in one run of bytes,
    which ends where either ends: so each bit of the union of both bitsets is one link.
    """
    if not len(ends_a):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    n_words = (int(ends_a[-1]) >> 6) + 1
    in_a, in_b = packed(ends_a, n_words), packed(ends_b, n_words)
    cuts, links = select(in_a & in_b), select(in_a | in_b)
    return rank(in_a, cuts) + 1, rank(in_b, cuts) + 1, rank(in_a, links), rank(in_b, links), links


class Parts(dict):
    """Parts seen in a run of documents, numbered in order of appearance."""

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        return number


def resolve(pair: TokenizerPair, parts: list[str]) -> list:
    """Records of parts, remembered from earlier runs or made in one go."""
    records = [pair.memory.find(p) for p in parts]
    missing = [i for i, r in enumerate(records) if r is None]
    for i, record in zip(missing, pair.groups_of([parts[i] for i in missing]), strict=True):
        records[i] = record if record is not None else ()
        if len(parts[i]) <= LONGEST_REMEMBERED:
            pair.memory.keep(parts[i], records[i])
    return records


def runs(batches, pair: TokenizerPair, run_chars: int):
    """Documents in runs of about ``run_chars`` characters: (ids, numbers of each document's parts, records of the parts)."""
    ids, numbers, parts, held = [], [], Parts(), 0
    for batch in slices(batches, 256):
        for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            numbers.append(np.fromiter(map(parts.__getitem__, pair.parts(text)), np.int32) if text else np.zeros(0, np.int32))
            held += len(text or "") + 100
            if held >= run_chars:
                yield ids, numbers, resolve(pair, list(parts))
                ids, numbers, parts, held = [], [], Parts(), 0
    if ids:
        yield ids, numbers, resolve(pair, list(parts))


def groups_text(numbers: np.ndarray, records: list) -> str:
    """A document's groups, or '' if the bytes of one of its parts differ."""
    found = [records[i] for i in numbers.tolist()]
    return ";".join([r[0] for r in found]) if all(found) else ""


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    return worker_memory(("pair", path_a, path_b), lambda: TokenizerPair(path_a, path_b))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, run_chars: int = 1_500_000) -> DataFrame:
    """doc_id and the groups of every text, as ``a1,a2|b1;a3|b2,b3``: ids of A and B between cuts where tokens of both end.

    Texts that are null, empty, or whose joined token bytes differ from a blank and the text, have
    ''. Repeated rows give repeated rows, no row gives none; texts of any length are taken whole.
    Only doc_id and text are read, so other columns cannot clash. One pass, no shuffle.
    """

    def groups(batches):
        pair = tokenizer_pair(path_a, path_b)
        for ids, numbers, records in runs(batches, pair, run_chars):
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), pa.array([groups_text(n, records) for n in numbers], pa.string())], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(groups, f"doc_id {dict(docs.dtypes)['doc_id']}, groups string")


def counted_runs(docs: DataFrame, path_a: str, path_b: str, run_chars: int) -> DataFrame:
    """One row per run of documents: their digests, the parts of each, and each part's links by place in the run's different keys."""
    kind = dict(docs.dtypes)["doc_id"]
    columns = {"run": "bigint", "ids": f"array<{kind}>", "totals": "binary", "digests": "array<string>", "parts": "binary", "part_links": "binary", "links": "binary", "n_parts": "int", "keys": "array<bigint>", "counts": "array<bigint>"}

    def count(batches):
        pair, number = tokenizer_pair(path_a, path_b), run_numbers()
        for ids, numbers, records in runs(batches, pair, run_chars):
            texts = [groups_text(n, records) for n in numbers]
            numbers = [n if t else n[:0] for n, t in zip(numbers, texts, strict=True)]
            every = np.concatenate(numbers)
            n_links = np.array([len(r[1]) // 8 if r else 0 for r in records], np.int64)
            per_part = np.array([r[2:] if r else (0, 0, 0) for r in records], np.int64).reshape(-1, 3)
            per_part = np.column_stack([per_part, n_links])
            totals = np.array([per_part[n].sum(axis=0) for n in numbers], np.int64).reshape(-1, 4)
            totals = np.column_stack([totals, [len(n) for n in numbers]])
            used = np.bincount(every, minlength=len(records))
            flat = np.frombuffer(b"".join(r[1] for r in records if r), np.int64)
            keys, place = np.unique(flat, return_inverse=True)
            counts = np.bincount(place, np.repeat(used, n_links).astype(np.float64), len(keys)).astype(np.int64)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            row = {
                "run": next(number), "ids": [i.as_py() for i in ids], "totals": totals.tobytes(), "digests": digests, "parts": narrow(every),
                "part_links": narrow(n_links), "links": narrow(place), "n_parts": len(n_links), "keys": keys, "counts": counts,
            }
            types = {"run": pa.int64(), "ids": pa.list_(ids[0].type), "totals": pa.binary(), "digests": pa.list_(pa.string()), "parts": pa.binary(), "part_links": pa.binary(), "links": pa.binary(), "n_parts": pa.int32(), "keys": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], types[c]) for c in columns], names=list(columns))

    return docs.select("doc_id", "text").mapInArrow(count, ", ".join(f"{c} {t}" for c, t in columns.items()))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, run_chars: int = 1_500_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A pair of ids counts as often as a link of any document holds it. Each run of documents names
    its different pairs once; their counts are summed over all runs by one aggregation, joined back
    to the runs, and added up per document there, so what is shuffled are pairs of runs and not
    links. Texts without tokens (see ``align_tokens``) have zeros and ''. Repeated rows count each time.
    """
    kind = dict(docs.dtypes)["doc_id"]
    counted = materialize(counted_runs(docs, path_a, path_b, run_chars), "aligned")
    pairs = counted.select("run", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "pair")).select("run", "at", "pair.keys", "pair.counts").withColumnRenamed("keys", "key")
    corpus = pairs.groupBy("key").agg(F.sum("counts").alias("count"))
    corpus = materialize(corpus.where("count > 0").withColumn("b", F.col("key").bitwiseAND((1 << B_BITS) - 1)), "pair-counts")
    highest = corpus.groupBy("b").agg(F.max("count").alias("highest"))
    # ``highest`` has at most one row for each id of B's vocabulary.
    judged = corpus.join(F.broadcast(highest), "b").select("key", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = pairs.where("counts > 0").select("run", "at", "key").join(judged, "key").groupBy("run").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    both = counted.drop("keys", "counts").join(back, "run", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add_up(batches):
        for batch in slices(batches, 1):
            run = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            totals = np.frombuffer(run["totals"][0].as_py(), np.int64).reshape(-1, 5)
            parts = widen(run["parts"][0].as_py(), int(totals[:, 4].sum()))
            part_links = widen(run["part_links"][0].as_py(), run["n_parts"][0].as_py())
            links = widen(run["links"][0].as_py(), int(part_links.sum()))
            found = run["found"].flatten()
            size = int(links.max(initial=-1)) + 1
            count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if len(found):
                at = found.field("at").to_numpy()
                count[at] = found.field("count").to_numpy()
                best[at] = found.field("best").to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(part_links)])
            per_part = np.column_stack([np.diff(running(x[links])[ends]) for x in (best, count)])
            ends = np.concatenate([[0], np.cumsum(totals[:, 4])])
            sums = [np.diff(running(per_part[parts, j])[ends]) for j in range(2)]
            ids = run["ids"].values.slice(run["ids"].offsets[0].as_py(), len(totals))
            digests = run["digests"].values.slice(run["digests"].offsets[0].as_py(), len(totals))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, totals[:, :4].T), *map(pa.array, sums), digests], names=names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    result = materialize(both.mapInArrow(add_up, schema), "alignment")
    discard(counted, corpus)
    return result


def running(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, and of all."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
