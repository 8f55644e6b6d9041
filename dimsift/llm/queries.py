"""The registered queries of these operators, with production parameters and the SQL that has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    debruijn, divergence, fim, forced_split, hash_forest, id_blocks, line_crf, minhash_join, packing, patience, quality_net, token_cache, warc,
)
from .tokenizer_file import TokenizerFile, default_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_debruijn_dedup(spark, sf_dir):
    kept = debruijn.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL["op1_debruijn_dedup"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM w),
e AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS edge FROM windows),
covered AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY edge) AS low FROM e) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(0, 13)) AS pos FROM covered),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op2_forced_boundary_bpe(spark, sf_dir):
    file = TokenizerFile(spark, default_path("byte_bpe_50k.json"))
    return forced_split.round_trip(table(spark, sf_dir, "documents"), file)


@query
def op3_warc_zstd(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    back = warc.archive_pages(pages, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""


@query
def op4_line_labelling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_net.score(docs, quality_net.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_patience_line_dedup(spark, sf_dir):
    kept = patience.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_hash_prefix_forest(spark, sf_dir):
    index = hash_forest.build(table(spark, sf_dir, "embeddings"))
    return hash_forest.search(index, index.where(F.col("vec_id") % 50 == 0))


@query
def op8_minhash_join(spark, sf_dir):
    return minhash_join.jaccard_join(table(spark, sf_dir, "documents"))


SQL["op8_minhash_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
  list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS grams FROM w WHERE len(w) > 0),
sets AS (SELECT min(doc_id) AS node, count(*) AS n_copies, grams FROM s GROUP BY grams),
g AS (SELECT node, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
reach AS (SELECT node, node AS seen FROM sets UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON pairs.a = reach.seen),
classes AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node),
links AS (SELECT a AS node, count(*) AS n_links FROM pairs GROUP BY a)
SELECT s.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies
FROM s JOIN sets USING (grams) JOIN classes USING (node) LEFT JOIN links USING (node)
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM w WHERE len(w) = 0
"""


@query
def op9_token_counts(spark, sf_dir):
    file = TokenizerFile(spark, default_path("word_bpe_49k.json"))
    return token_cache.count_tokens(table(spark, sf_dir, "documents"), file, token_cache.new_cache(spark))


@query
def op10_best_fit_packing(spark, sf_dir):
    file = TokenizerFile(spark, default_path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), file)


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
occ AS (SELECT row_number() OVER () AS doc, lang, source, t FROM d),
words AS (SELECT doc, lang, source, unnest(t) AS term FROM occ),
kept AS (SELECT lang, term, count(*)::HUGEINT AS of_lang FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT lang, source, term, of_lang, coalesce(c, 0)::HUGEINT AS c FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sizes AS (SELECT lang, source, count(*) + sum(c) AS size, count(*) + sum(of_lang) AS lang_size FROM grid GROUP BY lang, source),
p AS (SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 1) // size AS p, 1 + 1000000000::HUGEINT * (of_lang + 1) // lang_size AS q
  FROM grid JOIN sizes USING (lang, source)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_fill_in_middle(spark, sf_dir):
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL["op13_fill_in_middle"] = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
n AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi FROM n),
parts AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query
def op11_id_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = id_blocks.write_ids(docs, TokenizerFile(spark, default_path("word_bpe_49k.json")))
    return id_blocks.read_digests(spark, folder).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
