"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import centroids, quality, url_filter
from .common import UPPER

WORD = "'[^\\x20\\x09-\\x0D]+'"


def quality_sql() -> str:
    classes = {k: "'" + v.replace("'", "''") + "'" for k, v in quality.CLASSES.items()}
    counts = ", ".join(f"len(regexp_extract_all(t, {p})) AS n_{c}" for c, p in classes.items())
    names = [*quality.CLASSES, "other"]
    rest = "n_chars - " + " - ".join(f"n_{c}" for c in quality.CLASSES)
    key = " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER o" for j in range(1, quality.WINDOW)]])
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    distance = lambda p, q: f"round(sqrt(greatest(sum({part(p, q)} + {part(q, p)}) / 2, 0)), 6)"
    return f"""WITH d AS (SELECT doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
words AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (SELECT doc_id, i, {key} AS k FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows WHERE k IS NOT NULL) WHERE c > 1),
covered AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least({quality.WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {quality.WINDOW})) AS step FROM again) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {WORD}) GROUP BY 1),
c0 AS (SELECT doc_id, lang, text IS NOT NULL AND lang IS NOT NULL AS known, length(t) AS n_chars, len(w) AS n_words, {counts} FROM d),
c AS (SELECT *, {rest} AS n_other FROM c0),
base AS (SELECT c.*, n_chars - n_blank AS word_chars, coalesce(lines.n, 0) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM c LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
shares AS (SELECT doc_id, lang, n_chars, unnest([{", ".join(f"'{c}'" for c in names)}]) AS class, unnest([{", ".join(f"n_{c}" for c in names)}]) AS n FROM c),
char_refs AS (SELECT lang, class, sum(n)::DOUBLE / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1)::DOUBLE AS q FROM shares WHERE doc_id IN (SELECT doc_id FROM c WHERE known) GROUP BY lang, class),
char_d AS (SELECT doc_id, {distance("p", "q")} AS char_distance FROM (SELECT s.doc_id, s.n::DOUBLE / s.n_chars AS p, r.q FROM shares s JOIN char_refs r ON s.lang = r.lang AND s.class = r.class WHERE s.n_chars >= {quality.MIN_CHARS}) GROUP BY 1),
short AS (SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL AND regexp_full_match(word, '\\p{{L}}+') GROUP BY 1, 2),
common AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM short) WHERE r <= {quality.TOP_WORDS}),
word_total AS (SELECT lang, sum(n_words) AS n_all FROM c WHERE known GROUP BY 1),
word_refs AS (SELECT c.lang, word, c.n::DOUBLE / n_all AS q FROM common c JOIN word_total USING (lang)),
mine AS (SELECT b.doc_id, r.word, r.q, coalesce(k.n, 0)::DOUBLE / b.n_words AS p FROM base b JOIN word_refs r ON r.lang = b.lang LEFT JOIN (SELECT doc_id, word, count(*) AS n FROM words GROUP BY 1, 2) k ON k.doc_id = b.doc_id AND k.word = r.word WHERE b.n_words >= {quality.MIN_WORDS}),
both_words AS (SELECT doc_id, p, q FROM mine UNION ALL SELECT doc_id, 1.0 - sum(p), 1.0 - sum(q) FROM mine GROUP BY 1),
word_d AS (SELECT doc_id, {distance("p", "q")} AS word_distance FROM both_words GROUP BY 1),
judged AS (SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, char_distance, word_distance FROM base LEFT JOIN char_d USING (doc_id) LEFT JOIN word_d USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
NOT base_failed AND coalesce(char_distance, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} AS kept FROM judged"""


def url_sql() -> str:
    weights, bias = url_filter.fit_url_model(url_filter.labelled_urls())
    table = ", ".join(f"({i}, {w})" for i, w in enumerate(weights) if w)
    grams = lambda mark, part: f"SELECT page_id, '{mark}' || substr('^' || {part} || '$', unnest(range(1, greatest(length({part}) - 1, 1) + 1)), 4) AS g FROM u"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules) + " ELSE CASE WHEN score > 0 THEN 'block' ELSE 'allow' END END"
    return f"""WITH weights(bucket, weight) AS (VALUES {table}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS ({grams("h", "host")} UNION ALL {grams("p", "path")}),
s AS (SELECT page_id, {bias} + CAST(coalesce(sum(weight), 0) AS BIGINT) AS score FROM g LEFT JOIN weights ON bucket = ('0x' || substr(md5(g), 1, 4))::INTEGER >> 2 GROUP BY 1),
j AS (SELECT u.*, {rule} AS rule, score FROM u JOIN s USING (page_id))
SELECT page_id, host, path, rule, {verdict} AS verdict, score FROM j"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes by its byte table, which follows from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda acc, b: xor(acc >> 8, ({table}::BIGINT[])[(xor(acc, b) & 255) + 1])))"


def shard_sql(n_shards: int = 8, seed: str = "mix-1") -> str:
    ties = "k, doc_id, text_crc32, size"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
  ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY {ties}) - 0.5)::DOUBLE / (count(*) OVER (PARTITION BY source))::DOUBLE AS share FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY share, source, {ties}) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * {n_shards} // total AS INTEGER) AS shard, pos - ((pos * {n_shards} // total) * total + {n_shards - 1}) // {n_shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""


def centroid_sql(dimensions: int = centroids.DIMENSIONS, k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, seed: int = 3, scale: int = centroids.SCALE) -> str:
    """Every round as two tables: vectors with their nearest centroid, then the centroids' exact floored means."""
    distance = f"list_sum(list_transform(range(1, {dimensions + 1}), lambda i: CAST((v[i] - c[i]) * (v[i] - c[i]) AS BIGINT)))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT row_id, vec_id, v, min(struct_pack(d := CAST({distance} AS BIGINT), cluster := cluster)) AS best FROM kept CROSS JOIN c{n} GROUP BY 1, 2, 3)")
        mean = "CAST((s - (((s % n) + n) % n)) // n AS BIGINT)"
        if n < rounds:
            steps.append(f"m{n} AS (SELECT cluster, list({mean} ORDER BY i) AS c FROM (SELECT best.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dimensions + 1})) AS i) GROUP BY 1, 2) GROUP BY 1)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {k}),
{", ".join(steps)}
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": centroid_sql(), "op2_distribution_divergence": quality_sql(), "op8_url_filter": url_sql(), "op9_interleaved_shards": shard_sql()}
