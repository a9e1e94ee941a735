"""The queries opN_<name> of this subpackage and their SQL, over the tables of a folder."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import collocations, decontam, exact, fingerprints, interactions, jaccard, licenses, packing, quality, repair, substrings, toxicity, warc
from touchline.llm.common import documents, shared_dir
from touchline.llm.labelled import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1 : i + 20], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 20)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS k FROM w),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(pos, pos + 19)) AS p FROM r WHERE k > 1) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(generate_series(0, len(w) - 1)) AS i FROM d WHERE len(w) > 0)
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS g_doc, unnest(gone) AS p FROM g) WHERE g_doc = doc_id AND p = i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica is the pages as a failing disk would return them: some bytes changed, cut short, or lost."""
    pages = table(spark, sf_dir, "pages")
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    rotten = F.when(page % 97 == 13, F.concat(F.lit("?"), F.expr("substr(html, 2)"))).when(page % 389 == 7, F.expr("substr(html, 1, length(html) - 1)")).otherwise(html)
    ours = pages.select("page_id", warc.record_text(page, F.col("url"), html).alias("record"))
    theirs = pages.where(page % 193 != 5).withColumn("html", rotten).select("page_id", warc.record_text(page, F.col("url"), F.col("html")).alias("record"))
    return warc.audit(ours, theirs).select(F.col("id").alias("page_id"), "file", "offset", "length", "digest", "status")


OP3_SQL = """
WITH r AS (SELECT page_id, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages))
SELECT page_id, page_id // 4096 AS file, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  strlen(record) AS length, sha256(record) AS digest,
  CASE WHEN page_id % 193 = 5 THEN 'missing' WHEN page_id % 97 = 13 THEN CASE WHEN html[1] = '?' THEN 'ok' ELSE 'corrupt' END WHEN page_id % 389 = 7 AND html <> '' THEN 'corrupt' ELSE 'ok' END AS status
FROM r
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_clauses")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    repair.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).write.parquet(files)
    return repair.documents(repair.read(spark, files))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.summary(decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 13) AS width FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, width, array_to_string(w[i + 1 : i + width], ' ') AS gram FROM (SELECT item, w, width, unnest(generate_series(0, len(w) - width)) AS i FROM bw)),
dw AS (SELECT doc_id, width, i AS pos, array_to_string(w[i + 1 : i + width], ' ') AS gram
       FROM (SELECT doc_id, w, width, unnest(generate_series(0, len(w) - width)) AS i FROM d, (SELECT DISTINCT width FROM g) WHERE len(w) >= width)),
h AS (SELECT doc_id, width, pos, item FROM dw JOIN g USING (width, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + width - 1)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 4, 0))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r(doc_id, k) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.k FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, k AS component_id FROM (SELECT doc_id, min(k) AS k FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, g, count(*) AS f FROM (
        SELECT lang, 1 AS m, unnest(w) AS g FROM w
        UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM w
        UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) GROUP BY ALL),
c AS (SELECT lang, m, g AS phrase, f AS a, string_split(g, ' ') AS v FROM g WHERE m > 1 AND f >= 10),
k AS (SELECT lang, m, phrase, a, k, array_to_string(v[1 : k], ' ') AS head, array_to_string(v[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
s AS (SELECT k.lang, phrase, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM k JOIN g x ON x.lang = k.lang AND x.g = head JOIN g y ON y.lang = k.lang AND y.g = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, sub, max(a) AS longer FROM (SELECT lang, a, unnest([v[1] || ' ' || v[2], v[2] || ' ' || v[3]]) AS sub FROM c WHERE m = 3) GROUP BY lang, sub),
f AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.sub = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM f JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions.failures(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return interactions.audit(rows, {x: f"fails_{x}" for x in "ABCDE"})


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
        regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM w),
l AS (SELECT f.*, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM l GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.i AS o1, b.i AS o2, c.i AS o3, d.i AS o4, e.i AS o5 FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform([o1, o2, o3, o4, o5], lambda i: 'ABCDE'[i]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, [o1, o2, o3, o4, o5] AS o FROM o),
p AS (SELECT part, filter_order, step, o[step] AS i, n, good, toxic, fails[o[step]] AS fails_here, fails,
        len(list_filter(o[1 : step - 1], lambda j: fails[j])) > 0 AS before FROM c, s),
r AS (SELECT part, filter_order, step, i, CAST(coalesce(sum(n) FILTER (NOT before AND NOT fails_here), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT before AND fails_here), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (before AND fails_here), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails_here AND len(list_filter(fails, lambda z: z)) = 1), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (NOT before AND fails_here AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT before AND fails_here AND toxic), 0) AS BIGINT) AS toxic_lost
      FROM p GROUP BY part, filter_order, step, i)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_distances(documents(spark, sf_dir))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_toxicity": op4_toxicity,
    "op5_token_ids": op5_token_ids,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_fingerprints": op13_fingerprints,
}
ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op3_warc_fixity": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_collocations": OP11_SQL, "op12_filter_audit": OP12_SQL}
