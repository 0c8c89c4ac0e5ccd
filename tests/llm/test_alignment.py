"""Alignment of two tokenizers against a plain version over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowspark.llm import alignment
from flowspark.llm.common import AgingMemory

SF = "/root/testdata/sf0.001"
PLANTED = [
    None, "", " ", "   ", "a", "word", " leading", "trailing ", "trailing  ", "two  blanks", "three   blanks here", "line\n  indented\n\tx \n", "nb sp 　wide   x",
    "sep\x1c x\x1d  y \x85 z", "▁marked text", "plain and ▁ mark", "<|endoftext|> and <s> </s> <0x41> <unk>", "漢字かな交じり文 日本語", "emoji \U0001f600\U0001f468‍\U0001f469 é é", "\x00 nul \x07",
    "don't they'll I'm 's 't", "1234567 1,234.5 0x1f", "x" * 5000, "ab " * 3000, "漢" * 3000, "w\n" * 50, "the the the", "the the the", " \n \n ", "\r\n a\r\n b",
]


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenizerPair(*alignment.default_tokenizers())


BYTE_OF = alignment.byte_level()


def bytes_a(token):
    return bytes(BYTE_OF[c] for c in token)


def plain(rows):
    """Straight from the definition: whole texts encoded, ends compared, every overlapping pair looked at."""
    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    found, pairs = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        byte_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        pieces = ([bytes_a(a.id_to_token(i)) for i in ids_a], [byte_b(i) for i in ids_b])
        if any(b"".join(x) != (" " + (text or "")).encode() for x in pieces):
            ids_a, ids_b, pieces = [], [], ([], [])
        spans = [[(int(e) - len(p), int(e)) for e, p in zip(np.cumsum([len(p) for p in x]), x)] for x in pieces]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], [0, 0]
        for cut in cuts:
            sides = []
            for side, ids in enumerate((ids_a, ids_b)):
                first = at[side]
                while at[side] < len(ids) and spans[side][at[side]][1] <= cut:
                    at[side] += 1
                sides.append(",".join(map(str, ids[first : at[side]])))
            groups.append("|".join(sides))
        links, low = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while low < len(ids_b) and spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(ids_b) and spans[1][j][0] < e:
                links.append((i, ids_b[j]))
                j += 1
        pairs.update(links)
        text = ";".join(groups)
        found.append([doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""])
    best = {}
    for (_, j), n in pairs.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((d, na, nb, ng, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), h) for d, na, nb, ng, links, h in found), key=str)


def test_planted_texts(spark):
    rows = list(enumerate(PLANTED)) + [(None, "a text without id"), (3, "   "), (26, "the the the")]
    table = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id long, text string, groups string, run int")
    wanted = plain(rows)
    for run_chars in (50, 1_500_000):
        found = alignment.alignment_report(table, *alignment.default_tokenizers(), run_chars=run_chars)
        assert sorted((tuple(r) for r in found.collect()), key=str) == wanted
    groups = {(r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in alignment.align_tokens(table, *alignment.default_tokenizers()).collect()}
    assert groups == {(w[0], w[-1]) for w in wanted}
    assert alignment.alignment_report(table.where("false"), *alignment.default_tokenizers()).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert sorted((tuple(r) for r in alignment.op12_tokenizer_alignment(spark, SF).collect()), key=str) == plain(rows)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t ▁'.,1漢\x1c  "), max_size=30), max_size=8))
def test_parts_of_any_text(texts):
    own = alignment.tokenizer_pair(*alignment.default_tokenizers())
    for text in texts:
        parts = own.parts(text)
        assert "".join(parts) == f" {text}"
        whole = own.groups_of([f" {text}"])[0]
        records = alignment.resolve(own, parts)
        assert (whole[0] if whole else "") == alignment.groups_text(np.arange(len(parts)), records)


@settings(deadline=None)
@given(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400)), st.integers(401, 500))
def test_bitsets(ends_a, ends_b, last):
    a, b = np.array(sorted(ends_a | {last})), np.array(sorted(ends_b | {last}))
    cuts_a, cuts_b, link_a, link_b, _ = alignment.align_bitsets(a, b)
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    assert cuts_a.tolist() == [int((a <= c).sum()) for c in shared] and cuts_b.tolist() == [int((b <= c).sum()) for c in shared]
    spans = lambda x: list(zip([0, *x.tolist()[:-1]], x.tolist()))
    wanted = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if s < f and t < e]
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == wanted


def test_memory_forgets_the_oldest():
    memory = AgingMemory(3)
    for i in range(100):
        memory.keep(i, i * 2)
        assert memory.find(0) == 0 and memory.find(i) == 2 * i
    assert len(memory.young) + len(memory.old) <= 6 and memory.find(50) is None
