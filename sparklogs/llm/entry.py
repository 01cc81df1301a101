"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, jaccard, lattice, media, mixing, pieces, quality, resampling, secrets, sharding, substrings, toxicity, wrappers
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents")).drop("repeats")


def op5_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), pieces.vocabulary())


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = sharding.shard(docs, max(1, -(-sharding.total_bytes(docs) // 16)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.describe(media.encode(read(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        F.col("tracks")[0]["codec"].alias("codec"), F.col("tracks")[0]["seconds"].alias("seconds"),
    )


def op8_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.links(read(spark, sf_dir, "embeddings"))


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two increments, whose blobs one ledger takes up: the second scans what the first had not."""
    docs, path = read(spark, sf_dir, "documents"), secrets.new_ledger(spark)
    for part in secrets.increments(docs):
        secrets.record(part, path)
    out = secrets.findings(docs, path)

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    counts = [count(kind) for kind in secrets.BASE_KINDS]
    return out.select(
        "doc_id", *counts, F.sha2(secrets.spans(base), 256).alias("base_sha256"), secrets.spans(F.col("findings")).alias("spans"),
        F.lower(F.hex("blob")).alias("blob"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


def op11_centroid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def op12_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"op1_clause_toxicity": op1_clause_toxicity, "op2_sampled_pieces": op2_sampled_pieces, "op6_token_group_join": op6_token_group_join,
             "op8_lattice_near_dedup": op8_lattice_near_dedup, "op4_suffix_tree_dedup": op4_suffix_tree_dedup,
             "op5_passage_quality": op5_passage_quality}
    found |= {"op7_iso_media": op7_iso_media, "op9_blob_ledger": op9_blob_ledger, "op3_kd_sharding": op3_kd_sharding, "op10_source_mixing": op10_source_mixing}
    found |= {"op11_centroid_search": op11_centroid_search, "op12_radix_resampling": op12_radix_resampling, "op13_wrapper_extraction": op13_wrapper_extraction}
    return found


MIXING_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS digest
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM per
), filled AS (
  SELECT 0 AS round, source, source_size, weight, cap, 0.0::DOUBLE AS target, false AS full_
  FROM weighed
  UNION ALL
  SELECT round + 1, source, source_size, weight, cap,
         CASE WHEN full_ THEN cap ELSE least(cap, level * weight) END, full_ OR level * weight > cap
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) FILTER (full_) OVER (), 0))::DOUBLE
              / sum(weight) FILTER (NOT full_) OVER () AS level
    FROM filled
  ) WHERE round < 40
), targets AS (
  SELECT source, source_size, target FROM filled WHERE round = 40
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
        + greatest(0, least(size, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM ranked
"""


LEDGER_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), rules(place, kind, pattern, part, least) AS (
  VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  (1, 'access', '(AKIA[A-Z0-9]+)', 1, 16),
  (2, 'hex', '([0-9a-f]{32,})', 1, 32),
  (3, 'private', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1, 1),
  (4, 'bearer', '([Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,})', 1, 1),
  (5, 'github', '(gh[pousr]_[A-Za-z0-9]{36,})', 1, 1)
), matched AS (
  SELECT n, place, kind, least, regexp_extract_all(text, pattern, 0) AS m, regexp_extract_all(text, pattern, part) AS p, string_split_regex(text, pattern) AS gaps
  FROM d, rules WHERE regexp_matches(text, pattern)
), spans AS (
  SELECT n, place, kind, len(m[i]) AS size, len(p[i]) >= least AS ok,
         list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: len(g))), 0) AS start
  FROM matched, unnest(range(1, len(m) + 1)) AS t(i)
), named AS (
  SELECT n, place, kind, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM spans WHERE ok
), per AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM named GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM d LEFT JOIN per USING (n)
"""

_REACH = """
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT edges.y, reach.root FROM reach JOIN edges ON edges.x = reach.node),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
"""

SUBSTRINGS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, s, ws[s:s+19] AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(s) WHERE len(ws) >= 20
), later AS (
  SELECT doc_id, s FROM starts QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM later, unnest(range(s, s + 20)) AS t(p)
), words AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), kept AS (
  SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.p) AS kept
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s+3], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(s) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)
), nodes AS (SELECT doc_id AS node FROM documents),""" + _REACH + r"""
SELECT node AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM roots LEFT JOIN sizes ON sizes.doc_id = node
"""
LATTICE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), nodes AS (SELECT vec_id AS node FROM embeddings),""" + _REACH + r"""
SELECT node AS vec_id, (SELECT count(*) FROM edges WHERE x = node) AS n_links, component_id, node = component_id AS kept FROM roots
"""



def _centroids_sql(rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after the other, each a few common table expressions."""
    parts = [r"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""", r"""
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT 8))"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS near FROM (
    SELECT n, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}
  ) GROUP BY n
)""")
        if i < rounds:
            parts.append(f"""
m{i} AS MATERIALIZED (
  SELECT k, list(((s - (s % m + m) % m) // m)::BIGINT ORDER BY j) AS c FROM (
    SELECT near.k AS k, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS m FROM a{i}, unnest(range(1, 65)) AS t(j) GROUP BY ALL
  ) GROUP BY k
),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, near.k::INT AS cluster, near.d::BIGINT AS distance, (sum(near.d) OVER (PARTITION BY near.k))::BIGINT AS cluster_inertia,
       (sum(near.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = near.k
"""


RESAMPLING_SQL = r"""
WITH polynomial AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS step
  FROM unnest(range(0, 256)) AS t(n)
), texts AS (
  SELECT row_number() OVER () AS n, doc_id AS id, text, true AS source FROM documents
  UNION ALL SELECT row_number() OVER (), item_id, text, false FROM benchmark
), words AS MATERIALIZED (
  SELECT n, source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts
), spelled AS (
  SELECT w, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT w FROM words)
), named AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, polynomial
), sums AS (
  SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM words JOIN named USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT n, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN named USING (w) JOIN gains USING (bucket) WHERE source GROUP BY n
), scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (n) WHERE source
), ordered AS (
  SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS many
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * many // 100 THEN place END::BIGINT AS rank FROM ordered
"""


#: Holds for pages that are laid out as those of the given tables are: one article of headings and paragraphs.
PAGES_SQL = r"""
WITH blocks AS (
  SELECT page_id, url, list_transform(
    string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))
  ) AS parts
  FROM pages
), texts AS (
  SELECT page_id, url, array_to_string(list_transform(list_filter(parts, lambda b: b <> ''), lambda b: regexp_replace(b, '&amp;?', '&', 'g')), chr(10) || chr(10)) AS text FROM blocks
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_suffix_tree_dedup": SUBSTRINGS_SQL, "op6_token_group_join": JACCARD_SQL, "op8_lattice_near_dedup": LATTICE_SQL, "op9_blob_ledger": LEDGER_SQL, "op10_source_mixing": MIXING_SQL, "op11_centroid_search": _centroids_sql(), "op12_radix_resampling": RESAMPLING_SQL,
        "op13_wrapper_extraction": PAGES_SQL,
    }
