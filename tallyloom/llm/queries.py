"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import (
    conversations, dual_tree, embedding_dedup, licenses, minhash, mixing, packing, permutation_index, pu_quality, sharding, superkmer, toxicity, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on 3-word shingles at similarity 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.filter("vec_id % 20 = 0"), top=20)


def op4_mixture_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix at weights 1, 2, 3 takes."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("parts")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label at cosine 0.93."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return pu_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as dictionary-compressed WARC records and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_superkmer_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier elsewhere, removed."""
    return superkmer.remove_repeats(_table(spark, sf_dir, "documents"), width=20)


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary file of the box."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024, end=2)


def op11_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by rendezvous hashing of their ids."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40)


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return dual_tree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and least repairs of all conversations, damaged."""
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_permutation_ann": op3_permutation_ann,
    "op4_mixture_schedule": op4_mixture_schedule,
    "op10_min_bin_slack_packing": op10_min_bin_slack_packing,
    "op5_pu_quality": op5_pu_quality,
    "op6_warc_dictionary": op6_warc_dictionary,
    "op7_superkmer_substring_dedup": op7_superkmer_substring_dedup,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_int8_embedding_dedup": op9_int8_embedding_dedup,
    "op11_rendezvous_sharding": op11_rendezvous_sharding,
    "op12_dual_tree_search": op12_dual_tree_search,
    "op13_four_russians_repair": op13_four_russians_repair,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id,
         unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])
                     WHEN len(w) > 0 THEN [w] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_sizes AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM both_sizes JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id)
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

ORACLES["op9_int8_embedding_dedup"] = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""

ORACLES["op7_superkmer_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
single AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (
  SELECT s.doc_id, string_agg(s.w[s.j], ' ' ORDER BY s.j) AS t
  FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.j = s.j WHERE g.j IS NULL GROUP BY s.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(l.js), 0)::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLES["op6_warc_dictionary"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE strlen(html) >= 100 GROUP BY d)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.m <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.m <> p.page_id THEN f.m END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

ORACLES["op4_mixture_schedule"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sized GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, ss * 3.0::DOUBLE AS lim, (sum(ss) OVER ())::DOUBLE AS total FROM src),
r AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, least(lim, max(CASE WHEN level <= lim / weight THEN level END) OVER () * weight) AS target FROM r),
t AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * ss) AS words FROM g),
d AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17/' || doc_id), doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM sized)
SELECT d.doc_id, d.size, t.ss AS source_size, t.target,
       (t.words // greatest(t.ss, 1) * d.size + greatest(0, least(d.size, t.words % greatest(t.ss, 1) - d.ahead)))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

ORACLES["op12_dual_tree_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wanted AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM i),
tfs AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT t, count(*)::BIGINT AS df FROM tfs GROUP BY t), corpus),
lengths AS (SELECT r, doc_id, 100 - 50 + (50 * len(w)::BIGINT * n_docs) // n_words AS m FROM d, corpus WHERE len(w) > 0),
scores AS (
  SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
