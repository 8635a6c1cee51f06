"""The queries of this package, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, jaccard, lines, media, mixing, negatives, packing, passages, quality, suffix, toxicity, url_labels, urls, warc
from .common import materialise, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = materialise(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                                     media.to_wav("text").alias("media")), "media")
    read = stored.select("*", media.from_wav("media").alias("m"))
    size = F.octet_length("m.payload")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("m.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("m.payload", -media.BLOCK, media.BLOCK)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "m.frames", F.size("m.codes"), F.lower(F.hex(F.xxhash64("m.times", "m.codes")))).alias("feature"),
        "m.times", "m.codes")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(url_labels.labelled(spark))
    return urls.judge(pages, model, carry=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.assign_positions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id", "source"])
    return (placed.select("row.doc_id", "row.source", "size", "source_size", "target", "taken",
                          F.get("positions", F.lit(0)).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    params = toxicity.Params()
    # the sample is drawn among the labels, before any text is moved
    sample = (labels.filter("toxic is not null and doc_id is not null")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(params.max_rows))
    labelled = materialise(docs.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxic-labels")
    model = toxicity.fit(toxicity.graded(labelled, params), params)
    severity = toxicity.expected_severity(F.col("text"), model)
    return (docs.select("doc_id", severity.alias("s"))
            .select("doc_id", F.round("s", 6).alias("expected_severity"), F.round("s").cast("int").alias("grade"),
                    (F.col("s") >= 0.5).alias("toxic")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.components(docs).select("doc_id", "n_shingles", "component_id")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def byte_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.Packing(tokenizer=byte_bpe()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_length", "tier", "step_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = materialise(quality.measure(docs).select(F.struct("row.doc_id").alias("row"), "lang", "source", *quality.COUNTS, "base_failed"), "quality")
    judged = quality.judge(measured, quality.thresholds(quality.sketch(measured)))
    return judged.select("row.doc_id", *quality.COUNTS, "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), "embedding", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)).alias("is_anchor"))
    return negatives.hard_negatives(vectors)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_media, op3_urls, op4_mixing, op5_toxicity, op6_lines, op7_jaccard, op8_suffix, op9_packing, op10_quality,
                                   op11_collocations, op12_negatives, op13_passages)}


def _number(x: float) -> str:
    return f"{x!r}e0"


def _inverse_sql(kind: int, share: str) -> str:
    """mixing.inverse_demand as SQL, with the same operations in the same order."""
    out, after = "", ""
    for t0, _, w0, slope, before in reversed(mixing.integrated(mixing.SCHEDULES[kind])):
        more = f"({share} - {_number(before)})"
        step = f"{more} / {_number(w0)}" if slope == 0 else (
            f"2.0e0 * {more} / ({_number(w0)} + sqrt(greatest({_number(w0 * w0)} + {_number(2.0 * slope)} * {more}, 0e0)))")
        here = f"({_number(t0)} + {step})"
        out = f"CASE WHEN {share} < {after} THEN {here} ELSE {out} END" if out else here
        after = _number(before)
    return f"least(1e0, greatest(0e0, {out}))"


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

#: Documents (as docs: row id, size, source) to places in the mix.
MIX_CTES = f"""
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
k AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM s),
c AS (SELECT *, kind + 1 AS weight, 3 * source_size AS cap FROM k),
v AS (SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
      FROM c WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_max(level, open) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, kind, least(CAST(cap AS DOUBLE), coalesce(lv.level * weight, 0e0)) AS target FROM c, lv),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, '')))
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2e0 AS middle FROM d),
m AS (SELECT o.*, source_size, kind, target,
             list_filter([0, 1, 2], lambda i: size > 0 AND i * source_size + middle <= target) AS passes
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, source, text, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM documents), {MIX_CTES}
SELECT doc_id, source, size, source_size, target, CAST(len(passes) * size AS BIGINT) AS taken,
       CASE WHEN len(passes) > 0 THEN CASE kind {" ".join(f"WHEN {k} THEN {_inverse_sql(k, '(middle / target)')}" for k in range(3))} END END AS position
FROM m
"""

_KEY_SQL = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From d (doc_id, text) to kept lines; any id that is unique serves.
LINE_CTES = f"""
l AS (SELECT doc_id, pos, lines[pos] AS line FROM (
        SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos FROM (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM d))),
k AS (SELECT *, {_KEY_SQL} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key),
x AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM j GROUP BY 1)
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, text FROM documents), {LINE_CTES}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM x
"""


def quality_ctes(rules: quality.Rules = quality.Rules()) -> str:
    """From d (doc_id, lang, source, text) to q: the counts, base_failed and kept."""
    value = {x: f"CAST(floor(CAST(1000 * {m.top} AS DOUBLE) / {m.bottom}) AS BIGINT)" for x, m in rules.measures.items()}
    edge = lambda v: f"(({v} >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{x}' AS measure, {edge(v)} AS edge FROM base WHERE NOT base_failed" for x, v in value.items())
    limits, names = [], []
    for level, keys in (("own", "lang, source"), ("bylang", "lang"), ("total", "")):
        part = f"PARTITION BY {keys + ', ' if keys else ''}measure"
        pick = ", ".join(
            f"max(CASE WHEN measure = '{x}' THEN {f'q1 - {rules.reach} * greatest(q3 - q1, {m.spread})' if m.both else 'NULL'} END) AS lo_{x}, "
            f"max(CASE WHEN measure = '{x}' THEN CASE WHEN zeros * 2 > n_all THEN {rules.factor} * greatest(coalesce(p1, 0), {m.spread}) "
            f"ELSE q3 + {rules.reach} * greatest(q3 - q1, {m.spread}) END END) AS hi_{x}"
            for x, m in rules.measures.items())
        group = f"GROUP BY {keys}" if keys else ""
        limits.append(f"""{level} AS (SELECT {keys + ', ' if keys else ''}max(n_all) AS n_rows, {pick} FROM (
  SELECT {keys + ', ' if keys else ''}measure, max(n_all) AS n_all, max(zeros) AS zeros,
    min(edge) FILTER (edge > 0 AND (upto - zeros) * 4 >= n_all - zeros) AS p1, min(edge) FILTER (upto * 4 >= n_all) AS q1, min(edge) FILTER (upto * 4 >= 3 * n_all) AS q3 FROM (
    SELECT *, sum(n) OVER ({part}) AS n_all, sum(CASE WHEN edge = 0 THEN n ELSE 0 END) OVER ({part}) AS zeros, sum(n) OVER ({part} ORDER BY edge) AS upto FROM (
      SELECT {keys + ', ' if keys else ''}measure, edge, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL) {group})""")
    for x in rules.measures:
        names += [f"lo_{x}", f"hi_{x}"]
    best = ", ".join(f"CASE WHEN own.n_rows >= {rules.min_rows} THEN own.{c} WHEN bylang.n_rows >= {rules.min_rows} THEN bylang.{c} ELSE total.{c} END AS {c}" for c in names)
    within = " AND ".join([f"coalesce({value[x]} <= hi_{x}, true)" for x in rules.measures]
                          + [f"coalesce({value[x]} >= lo_{x}, true)" for x, m in rules.measures.items() if m.both])
    return rf"""
w0 AS (SELECT *, {WORDS_SQL} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w0 WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT hit) AS n_repeat_words FROM (
   SELECT doc_id, unnest(generate_series(i, i + 7)) AS hit FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win) WHERE times > 1) GROUP BY 1),
base0 AS (SELECT w0.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
   FROM w0 LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base0),
sk AS (SELECT lang, source, measure, edge, count(*) AS n FROM ({values}) GROUP BY ALL),
{", ".join(limits)},
lim AS (SELECT g.lang AS ll, g.source AS ss, {best} FROM (SELECT DISTINCT lang, source FROM sk) g
   LEFT JOIN own ON own.lang IS NOT DISTINCT FROM g.lang AND own.source IS NOT DISTINCT FROM g.source
   LEFT JOIN bylang ON bylang.lang IS NOT DISTINCT FROM g.lang LEFT JOIN total ON true),
q AS (SELECT base.*, CASE WHEN base_failed THEN false ELSE {within} END AS kept
   FROM base LEFT JOIN lim ON lang IS NOT DISTINCT FROM ll AND source IS NOT DISTINCT FROM ss)
"""


_OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS least FROM l UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(least) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

#: A byte is two digits of the text's hexadecimal form.
_OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, h[2 * p - 1 : 2 * p + 98] AS g FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY 1),
x AS (SELECT doc_id, p FROM w JOIN f ON w.g = f.g WHERE first < doc_id),
i AS (SELECT *, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
  SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM x)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 49 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS last, h FROM s JOIN d ON d.doc_id = s.doc_id),
c AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans,
             string_agg(h[2 * last + 1 : 2 * (a - 1)], '' ORDER BY a) || any_value(h)[2 * max(b) + 1 :] AS kept FROM k GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

_OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, size, phrase, count(*) AS f FROM (
        SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase FROM (
          SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM w)))
      GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE size >= 2),
u AS (SELECT lang, phrase, a, k, array_to_string(s[:k], ' ') AS head, array_to_string(s[k + 1:], ' ') AS tail FROM (
        SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c)),
x AS (SELECT u.*, l.f AS l, r.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = head JOIN f r ON r.lang = u.lang AND r.phrase = tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM x) WHERE place = 1),
i AS (SELECT lang, a AS longer, s, m, unnest(generate_series(1, size - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, size - 1)) AS m FROM c WHERE size >= 3)),
d AS (SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(longer) AS longer FROM i GROUP BY ALL)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)) z
JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""

_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_OP13 = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY 1),
h AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS p FROM x JOIN f ON x.g = f.g WHERE first < doc_id),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) FILTER (h.p IS NULL) AS kept, count(h.p) AS n_removed
      FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) u LEFT JOIN h ON h.doc_id = u.doc_id AND h.p = u.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, lang, source, text FROM documents), {quality_ctes()}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept FROM q
"""

ORACLE_SQL: dict[str, str] = {"op1_warc": _OP1, "op4_mixing": _OP4, "op6_lines": _OP6, "op7_jaccard": _OP7, "op8_suffix": _OP8, "op10_quality": _OP10,
                              "op11_collocations": _OP11, "op12_negatives": _OP12, "op13_passages": _OP13}
