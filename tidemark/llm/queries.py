"""The thin contract queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_replay, decontaminate, fim_events, langid_kn, line_dedup, media_copies, merkle_manifest, secrets_crf, simhash_golay, substring_dedup, toxicity, warc_merkle,
    wavelet_store,
)
from .common import held_out, map_docs, saved, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("t")


def op2_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_crf.scan(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets_crf.digest("base"), 256).alias("base_sha256"), secrets_crf.digest("spans").alias("spans"),
    )


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all embeddings drawn as pictures, with a cropped and edited copy of every hundredth.

    The tables have no media column, so each vector is drawn as a 64 x 64 grey picture.
    """
    vectors = table(spark, sf_dir, "embeddings")

    def draw(ids, arrays):
        plain = [media_copies.draw_vector(v) for v in arrays]
        # picture k has the id 2 k and its copy 2 k + 1, so that copies come first in no bucket by their ids alone
        edited = [(2 * i + 1, media_copies.cropped_copy(p)) for i, p in zip(ids, plain) if i is not None and i % 100 == 0]
        return {"id": [None if i is None else 2 * i for i in ids] + [i for i, _ in edited], "content": plain + [p for _, p in edited]}

    pictures = map_docs(vectors, ["vec_id", "embedding"], draw, "id long, content binary")
    found = saved(media_copies.classes(pictures))
    is_copy, plain_id = F.col("id").bitwiseAND(1) == 1, F.shiftright("id", 1).alias("id")
    copies = found.where(is_copy).select(plain_id, F.col("class_id").alias("copy_class"))
    # a class is named by the smallest id of a picture that is not a copy
    names = saved(found.where(~is_copy).groupBy("class_id").agg(F.min(plain_id).alias("name"), F.count("*").alias("members")))
    return found.where(~is_copy).select(plain_id, "class_id", "n_corners").join(names, "class_id").join(copies, "id", "left").select(
        F.col("id").alias("vec_id"), F.col("name").alias("class_id"), "members", "n_corners",
        F.when(F.col("copy_class").isNotNull(), F.col("copy_class") == F.col("class_id")).alias("copy_found"),
    )


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which of every hundred records one has rotted in place, one is lost, one has
    grown, one has been added, and two have changed places."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = F.col("page_id") % 100
    moved = F.when(kind == 55, F.col("page_id") + 1).when(kind == 56, F.col("page_id") - 1).otherwise(F.col("page_id"))
    html = F.when(kind == 7, F.translate("html", "<", "#")).when(kind == 21, F.concat("html", F.lit("<!-- more -->"))).otherwise(F.col("html"))
    replica = pages.where(kind != 13).select(moved.alias("page_id"), "url", html.alias("html"))
    replica = replica.unionByName(pages.where(kind == 34).withColumn("page_id", F.col("page_id") + 10_000_000))
    found = warc_merkle.audit(warc_merkle.records(pages), warc_merkle.records(replica))
    return found.select(
        F.coalesce("record_id", "other_record_id").alias("page_id"), "volume", F.col("slot").cast("long").alias("slot"), "offset", "length",
        "digest", "other_length", "other_digest", "kind",
    )


def op6_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet_store.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)

    return wavelet_store.read_documents(shards, zlib.crc32, "ids_crc32", "long")


def op7_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_replay.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_langid_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid_kn.fit(docs.where(~held_out("doc_id", 4, 2)))
    found = langid_kn.identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    lexicon = toxicity.fit(toxicity.labelled(docs, labels))
    found = toxicity.score(docs, lexicon)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op11_fim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim_events.rewrite(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim_events.restored("output", "form"), 256).alias("restored_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Somebody holds a copy in which every row whose id's crc32 is a multiple of 7 counts one character too many."""
    docs = table(spark, sf_dir, "documents")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claimed = [F.col("n_chars") + touched.cast("int") if c == "n_chars" else c for c in merkle_manifest.FIELDS]
    found = merkle_manifest.manifest(docs, claimed=claimed)
    proof = F.sha2(F.array_join(merkle_manifest.siblings("path"), ""), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), merkle_manifest.folded("claim", "path").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_frequent(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_secrets_crf, op3_media_copies, op4_simhash_golay, op5_warc_merkle,
        op6_wavelet_store, op7_bpe_replay, op8_langid_kn, op9_toxicity, op10_decontaminate, op11_fim_events, op12_merkle_manifest,
        op13_line_dedup,
    )
}

_RECORD = """'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n ||
  'Content-Type: text/html' || n || 'Content-Length: ' || strlen(coalesce(html, '')) || n || n || coalesce(html, '') || n || n"""

#: Records of a table of pages with their places, as ``warc_merkle.records`` lays them out.
_LAID = f"""(SELECT *, coalesce(sum(size) OVER (PARTITION BY k // 4096 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
    row_number() OVER (PARTITION BY page_id ORDER BY k) AS again
  FROM (SELECT page_id, strlen(record) AS size, sha256(record) AS digest, row_number() OVER (ORDER BY page_id, sha256(record)) - 1 AS k
    FROM (SELECT page_id, {_RECORD} AS record FROM (SELECT *, chr(13) || chr(10) AS n FROM {{pages}}))))"""

SQL: dict[str, str] = {
    "op5_warc_merkle": f"""
WITH replica AS (
  SELECT CASE page_id % 100 WHEN 55 THEN page_id + 1 WHEN 56 THEN page_id - 1 ELSE page_id END AS page_id, url,
    CASE page_id % 100 WHEN 7 THEN translate(html, '<', '#') WHEN 21 THEN html || '<!-- more -->' ELSE html END AS html
  FROM pages WHERE page_id % 100 <> 13
  UNION ALL SELECT page_id + 10000000, url, html FROM pages WHERE page_id % 100 = 34
)
SELECT CAST(coalesce(a.page_id, b.page_id) AS BIGINT) AS page_id, CAST(coalesce(a.k, b.k) // 4096 AS BIGINT) AS volume,
  CAST(coalesce(a.k, b.k) % 4096 AS BIGINT) AS slot, CAST(a.first AS BIGINT) AS "offset", CAST(a.size AS BIGINT) AS length, a.digest AS digest,
  CAST(b.size AS BIGINT) AS other_length, b.digest AS other_digest,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'added' ELSE 'changed' END AS kind
FROM {_LAID.format(pages="pages")} a FULL JOIN {_LAID.format(pages="replica")} b ON a.page_id = b.page_id AND a.again = b.again
WHERE a.digest IS DISTINCT FROM b.digest""",
    "op11_fim_events": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS two,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), cut AS (
  SELECT *, array_to_string(u[1:least(one, two)], '') AS prefix, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS middle,
    array_to_string(u[greatest(one, two) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
      coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
    (xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295) % 7) = 0 AS touched FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN touched THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claim,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM rows
), lower AS (
  SELECT 0 AS level, lang, place, n, leaf AS digest FROM leaves
  UNION ALL SELECT level + 1, lang, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM lower WHERE n > 1 GROUP BY level, lang, place // 2
), subroots AS (SELECT lang, level, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY level, place // 2
), root AS (SELECT level, digest FROM upper WHERE n = 1
), steps AS (
  SELECT l.doc_id, t.level AS step, (l.place >> t.level) % 2 AS side, coalesce(s.digest, '') AS sibling FROM leaves l
  JOIN lower t ON t.lang IS NOT DISTINCT FROM l.lang AND t.place = l.place >> t.level AND t.n > 1
  LEFT JOIN lower s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.place = xor(l.place >> t.level, 1)
  UNION ALL
  SELECT l.doc_id, r.level + t.level, (r.place >> t.level) % 2, coalesce(s.digest, '') FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  JOIN upper t ON t.place = r.place >> t.level AND t.n > 1 LEFT JOIN upper s ON s.level = t.level AND s.place = xor(r.place >> t.level, 1)
), fold AS (
  SELECT doc_id, 0 AS step, coalesce(claim, leaf) AS h FROM leaves
  UNION ALL SELECT f.doc_id, f.step + 1, sha256(CASE WHEN s.side = 0 THEN f.h || s.sibling ELSE s.sibling || f.h END) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step
)
SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM root) AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT digest FROM root) AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN (SELECT doc_id, sha256(string_agg(sibling, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id) p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, arg_max(h, step) AS h FROM fold GROUP BY doc_id) f ON f.doc_id = l.doc_id""",
    "op13_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, k, part, translate(trim(part, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 10),
judged AS (SELECT l.*, f.line IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.line = f.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(part, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
}
