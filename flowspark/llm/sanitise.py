"""Personal data: patterns, and terms whose co-occurrence in the corpus reveals them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, broadcast_if_small, free_name, materialize, slices

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
#: Fixed patterns of the base kinds. A digit run that fails as an address fails from each of its digits, so only its first is tried.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NAME_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPLIT = re.compile(r"[\x20\x09-\x0D]+")
DIGITS_ONLY = re.compile(r"[^0-9]+")
#: What is no part of a term at either end of a word.
MARKS = ".,;:!?\"'()[]|"

CONTEXT_WORDS = 5
MIN_CONTEXTS = 2
#: A term is generalised when its pointwise mutual information with an entity is this share of the entity's information, and removed at the second.
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: At most so many terms are sent to every task; beyond, documents are joined with their terms.
BROADCAST_TERMS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find_emails(text: str):
    """Leftmost non-overlapping matches; a run of name characters without an @ behind it is passed over once."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        start = at + len(text[at:sign].rstrip(NAME_CHARS))
        found = EMAIL.match(text, start) if start < sign else None
        if found:
            yield found.span()
        at = found.end() if found else sign + 1


def is_address(text: str) -> bool:
    parts = [x.lstrip("0") for x in text.split(".")]
    return all(len(x) <= 3 and int(x or "0") <= 255 for x in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their test are dropped, not retried."""
    spans = []
    if "@" in text:
        spans += [("email", *m) for m in find_emails(text)]
    if DIGIT.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if is_address(m.group())]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = DIGITS_ONLY.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS_ONLY.sub("", m.group())) <= 15]
    return spans


def entities_of(kind: str, value: str) -> tuple[str, str, str]:
    """What a value stands for: itself in one spelling, its group (mail domain, network, issuer, area) and its kind."""
    if kind == "email":
        value = value.lower()
        return f"email:{value}", f"domain:{value.rpartition('@')[2]}", "kind:email"
    if kind == "ip":
        return f"ip:{value}", f"network:{'.'.join(value.split('.')[:2])}", "kind:ip"
    value = DIGITS_ONLY.sub("", value)
    return f"{kind}:{value}", f"{kind}-prefix:{value[: 6 if kind == 'card' else 4]}", f"kind:{kind}"


def term_of(word: str) -> str:
    return word.strip(MARKS).lower()


def words_before(text: str, end: int, n: int) -> list[str]:
    """The last ``n`` words that end before ``end``, whole however long they are."""
    reach = 200
    while True:
        start = max(0, end - reach)
        found = WORD.findall(text, start, end)
        if start == 0 or len(found) > n:  # the first word may be cut
            return found[-n:]
        reach *= 4


def joint_intervals(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda x: x[1]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def contexts_of(text: str) -> dict[tuple[str, str], set[str]]:
    """(entity, term): the word contexts in which the text has them together.

    Contexts are the five words on each side of a stretch of protected values; no part of any
    value is a term. (entity, "") and ("", term) stand for each of the two alone.
    """
    found: dict[tuple[str, str], set[str]] = {}
    spans = base_spans(text)
    starts, ends = joint_intervals(spans)
    masked = "".join(text[a:b] + " " * (e - b) for a, b, e in zip([0, *ends], [*starts, len(text)], [*ends, len(text)], strict=True))
    near = []
    for start, end in zip(starts, ends, strict=True):
        after = [m.group() for m in islice(WORD.finditer(masked, end), CONTEXT_WORDS)]
        words = [term_of(w) for w in words_before(masked, start, CONTEXT_WORDS) + after]
        near.append((hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), set(words) - {""}))
    for kind, start, end in spans:
        mark, terms = near[bisect_left(ends, end)]
        for entity in entities_of(kind, text[start:end]):
            found.setdefault((entity, ""), set())
            for term in terms:
                found.setdefault((entity, term), set()).add(mark)
                found.setdefault(("", term), set())
    return found


def entity_counts(docs: DataFrame) -> DataFrame:
    """(entity, term, n, n_contexts): documents with an entity and a term close by, and how many of their contexts differ.

    Rows with an empty term count the documents of an entity, rows with an empty entity those with
    a term near any. A document counts once, with all its contexts of a pair as one.
    """

    def count(batches):
        for batch in slices(batches):
            rows = [(e, t, ",".join(sorted(marks))) for text in batch.column(0).to_pylist() for (e, t), marks in contexts_of(text).items()]
            if rows:
                entity, term, mark = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(entity, pa.string()), pa.array(term, pa.string()), pa.array(mark, pa.string())], names=["entity", "term", "mark"])

    holding = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    each = holding.mapInArrow(count, "entity string, term string, mark string").withColumn("mark", F.xxhash64("mark"))
    return each.groupBy("entity", "term").agg(F.count("*").alias("n"), F.count_distinct("mark").alias("n_contexts"))


class Listed(dict):
    """The listed term that a word stands for, or None; remembered for up to ``limit`` words."""

    def __init__(self, terms, limit: int = 50_000):
        super().__init__()
        self.terms, self.limit = terms, limit

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.limit:
            self.clear()
        term = term_of(word)
        found = self[word] = term if term in self.terms else None
        return found


def term_counts(docs: DataFrame, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, n_term): how many documents hold each listed term.

    Up to ``broadcast_terms`` terms are sent to all tasks, and each task counts before it hands
    anything on. More terms are joined with the documents' distinct words instead.
    """
    few = terms.limit(broadcast_terms + 1).collect()
    if len(few) > broadcast_terms:
        each = document_terms(docs).join(terms, "term", "left_semi")
        return each.groupBy("term").agg(F.count("*").alias("n_term"))
    shared = docs.sparkSession.sparkContext.broadcast({r["term"] for r in few})

    def count(batches):
        listed, totals = Listed(shared.value), Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text and shared.value:
                    totals.update({listed[w] for w in SPLIT.split(text)} - {None})
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def document_terms(docs: DataFrame) -> DataFrame:
    """The distinct terms of each document with a key of its text, one a row."""

    def split(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                terms = sorted({term_of(w) for w in SPLIT.split(text or "")} - {""})
                for at in range(0, len(terms), 10_000):
                    part = terms[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(part), pa.string()), pa.array(part, pa.string())], names=["key", "term"])

    return docs.select(text_key(), "text").mapInArrow(split, "key string, term string")


def text_key():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("key")


def disclosing_terms(docs: DataFrame, counts: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(entity, term, n_entity, n_term, n_both, share, action) for terms that give an entity away.

    With N documents, n(e) and n(t) that hold entity and term, and n(e,t) that hold both close
    together: information IC(e) = log2(N / n(e)), disclosure PMI(e,t) = log2(N n(e,t) / (n(e) n(t))),
    share = PMI / IC. Entities are single values, their groups and their kinds. A term needs
    ``min_contexts`` documents with different contexts, so copies of one text are no evidence.
    Counts cover all documents.
    """
    total = float(max(docs.count(), 1))
    information = F.log2(F.lit(total) / F.col("n_entity"))

    def share(n_term):
        return F.when(information > 0, F.log2(F.lit(total) * F.col("n_both") / (F.col("n_entity") * n_term)) / information)

    entities = counts.where("term = ''").select("entity", F.col("n").alias("n_entity"))
    near = counts.where("entity = ''").select("term", F.col("n").alias("n_near"))
    pairs = counts.where("entity <> '' and term <> ''").where(F.col("n_contexts") >= min_contexts).select("entity", "term", F.col("n").alias("n_both"))
    pairs = pairs.join(broadcast_if_small(entities, broadcast_terms), "entity").join(near, "term")
    # A term is in at least as many documents as it is near an entity in, so common words are settled here.
    pairs = materialize(pairs.where(share(F.col("n_near")) >= generalise_at), "entity-terms")
    spread = term_counts(docs, pairs.select("term").distinct(), broadcast_terms)
    judged = pairs.join(spread, "term").withColumn("n_term", F.greatest("n_term", "n_both")).withColumn("share", share(F.col("n_term")))
    action = F.when(F.col("share") >= remove_at, "remove").otherwise("generalise")
    return judged.where(F.col("share") >= generalise_at).select("entity", "term", "n_entity", "n_term", "n_both", "share", action.alias("action"))


def all_spans(text: str, terms: dict[str, str], listed: Listed) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and (action, start, end) of listed terms outside them."""
    base = base_spans(text)
    if not terms or not any(listed[w] for w in SPLIT.split(text)):
        return base, []
    starts, ends = joint_intervals(base)
    extra = []
    for m in WORD.finditer(text):
        word = m.group()
        term = listed[word]
        if term is None:
            continue
        start = m.start() + len(word) - len(word.lstrip(MARKS))
        end = start + len(word.strip(MARKS))
        at = bisect_left(ends, start + 1)
        if at == len(ends) or starts[at] >= end:
            extra.append((terms[term], start, end))
    return base, extra


def replaced(text: str, base, extra) -> str:
    """The text with each protected value as [KIND], generalised terms as [TERM] and removed ones gone."""
    out, at = [], 0
    for kind, start, end in sorted([*base, *extra], key=lambda x: (x[1], -x[2])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], "" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    """kind:start:end by kind, in the order of ``KINDS`` and ``ACTIONS``, then start."""
    order = (*KINDS, *ACTIONS)
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order.index(x[0]), x[1])))


def sanitise(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """All columns of ``docs`` plus clean_text, base_spans, term_spans and n_email, n_ip, n_card, n_phone.

    Base spans are always kept. A term that discloses an entity (see ``disclosing_terms``) gives it
    away in whatever document it stands, so it adds a span of kind ``generalise`` or ``remove``
    wherever it is found outside base spans; if it discloses several, removal wins. clean_text has
    every span replaced. Null text counts as empty and stays null in clean_text; every row counts
    as a document, repeated ones and those without doc_id too, and equal texts are treated alike;
    an empty table gives no rows; input columns with the added names are replaced. Where two base
    kinds overlap both are reported, and the earlier start is replaced first.
    """
    added = ["clean_text", "base_spans", "term_spans", *[f"n_{k}" for k in KINDS]]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    keep = docs.columns
    counts = materialize(entity_counts(docs), "entity-counts")
    found = disclosing_terms(docs, counts, broadcast_terms=broadcast_terms)
    terms = materialize(found.groupBy("term").agg(F.max("action").alias("action")), "disclosing-terms")
    few = terms.limit(broadcast_terms + 1).collect()
    by_text = len(few) > broadcast_terms
    shared = docs.sparkSession.sparkContext.broadcast({} if by_text else {r["term"]: r["action"] for r in few})
    own = free_name("terms", keep)
    if by_text:
        per_text = document_terms(docs).join(terms, "term").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias(own))
        key = free_name("key", keep)
        docs = docs.withColumn(key, text_key()).join(per_text.withColumnRenamed("key", key), key, "left").drop(key)
    schema = ", ".join([f"`{c}` {k}" for c, k in docs.dtypes if c != own] + ["clean_text string, base_spans string, term_spans string", *[f"n_{k} long" for k in KINDS]])
    types = arrow_schema(docs.sparkSession, schema)

    def clean(batches):
        everywhere = Listed(shared.value)
        for batch in slices(batches):
            texts, rows = batch.column("text").to_pylist(), []
            of_text = batch.column(own).to_pylist() if by_text else [None] * len(texts)
            for text, some in zip(texts, of_text, strict=True):
                terms, listed = (shared.value, everywhere) if not by_text else (dict(some or ()), Listed(dict(some or ())))
                base, extra = all_spans(text or "", terms, listed)
                rows.append((None if text is None else replaced(text, base, extra), joined(base), joined(extra), *[sum(k == kind for k, _, _ in base) for kind in KINDS]))
            new = list(zip(*rows, strict=True)) or [()] * len(added)
            arrays = [batch.column(c) for c in keep] + [pa.array(v, types.field(c).type) for c, v in zip(added, new, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])

    return docs.mapInArrow(clean, schema)


def op5_disclosure_sanitisation(spark, sf_dir: str) -> DataFrame:
    found = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), F.when(F.col("term_spans") != "", F.col("term_spans")))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
