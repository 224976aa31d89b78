"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import compression, divergence, hilbert, hmm, langid, merkle, mixing, negatives, packing, simhash, topk, toxicity, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash_gray_index")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The same rules as set operations over words, windows and lines.
_OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r),
chars AS (SELECT r, [length(regexp_replace(t, '[^a-z]+', '', 'g')), length(regexp_replace(t, '[^A-Z]+', '', 'g')),
                     length(regexp_replace(t, '[^0-9]+', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g')),
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))] AS k,
                 length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars FROM d),
base AS (SELECT w.r, doc_id, lang, w, len(w) AS n_words, word_chars, k[5] AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, list_append(k, word_chars - list_sum(k)) AS k
         FROM w JOIN chars USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
word AS (SELECT r, lang, unnest(w) AS x FROM w),
top AS (SELECT lang, x, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS bin
        FROM (SELECT lang, x, count(*) AS c FROM word WHERE regexp_full_match(x, '\\p{L}+') GROUP BY lang, x) QUALIFY bin <= 24),
total AS (SELECT lang, sum(n_words) AS n, sum(k[1]) AS k1, sum(k[2]) AS k2, sum(k[3]) AS k3, sum(k[4]) AS k4,
                 sum(k[5]) AS k5, sum(k[6]) AS k6 FROM base GROUP BY lang),
shares AS (SELECT lang, n, [k1, k2, k3, k4, k5, k6] AS ks, greatest(k1 + k2 + k3 + k4 + k5 + k6, 1) AS chars FROM total),
cls AS (SELECT r, i, b.k[i] / greatest(b.word_chars, 1)::DOUBLE AS p, s.ks[i] / s.chars::DOUBLE AS q
        FROM base b JOIN shares s ON b.lang IS NOT DISTINCT FROM s.lang, (SELECT unnest(range(1, 7)) AS i)),
hit AS (SELECT r, bin, count(*) AS c FROM word JOIN top ON word.lang IS NOT DISTINCT FROM top.lang AND word.x = top.x GROUP BY r, bin),
bins AS (SELECT b.r, t.bin, coalesce(h.c, 0) / b.n_words::DOUBLE AS p, t.c / s.n::DOUBLE AS q
         FROM base b JOIN shares s ON b.lang IS NOT DISTINCT FROM s.lang JOIN top t ON b.lang IS NOT DISTINCT FROM t.lang
         LEFT JOIN hit h ON h.r = b.r AND h.bin = t.bin WHERE b.n_words > 0),
wrd AS (SELECT r, p, q FROM bins UNION ALL SELECT r, greatest(1 - sum(p), 0), greatest(1 - sum(q), 0) FROM bins GROUP BY r),
js AS (SELECT 'c' AS kind, r, p, q FROM cls UNION ALL SELECT 'w', r, p, q FROM wrd),
far AS (SELECT r, sqrt(greatest(sum(CASE WHEN kind = 'c' THEN v ELSE 0 END), 0)) AS dc, sqrt(greatest(sum(CASE WHEN kind = 'w' THEN v ELSE 0 END), 0)) AS dw
        FROM (SELECT kind, r, (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS v FROM js)
        GROUP BY r),
ready AS (SELECT b.*, b.n_words < 50 OR 100 * b.n_repeat_words > 50 * b.n_words AS base_failed, dc, dw,
                 s.n < 1000 OR NOT EXISTS (SELECT 1 FROM top t WHERE t.lang IS NOT DISTINCT FROM b.lang) AS guarded
          FROM base b JOIN shares s ON b.lang IS NOT DISTINCT FROM s.lang LEFT JOIN far f ON f.r = b.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (guarded OR (dc <= 0.16 + 1.2 / sqrt(n_words) AND dw <= 0.18 + 1.3 / sqrt(n_words))) AS kept
FROM ready
"""


@query("op10_distribution_divergence", _OP10)
def op10(spark, sf_dir):
    return divergence.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query("op2_hilbert_shards")
def op2(spark, sf_dir):
    return hilbert.shards(table(spark, sf_dir, "documents"))


@query("op4_mix_blocks")
def op4(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_length_buckets")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_hidden_markov")
def op7(spark, sf_dir):
    return hmm.language_model(table(spark, sf_dir, "documents"))


@query("op5_ordinal_toxicity")
def op5(spark, sf_dir):
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_ngram_languages")
def op8(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x::DOUBLE[], v.x::DOUBLE[]) DESC, v.vec_id)::INTEGER AS rank,
       v.vec_id, list_dot_product(q.x::DOUBLE[], v.x::DOUBLE[])::BIGINT AS score
FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20
"""


@query("op3_impact_ordered_top_k", _OP3)
def op3(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op9_url_models")
def op9(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


_OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r AS ar, b.r AS br, a.vec_id AS anchor_id, a.label, a.x, b.vec_id AS positive_id, list_dot_product(a.x, b.x)::BIGINT AS s
      FROM v AS a JOIN v AS b ON a.label = b.label AND a.r <> b.r WHERE a.vec_id % 50 = 0
      QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY s DESC, b.vec_id) <= 5),
n AS (SELECT p.*, c.vec_id AS negative_id, list_dot_product(p.x, c.x)::BIGINT AS t FROM p JOIN v AS c ON p.label <> c.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY ar, br ORDER BY t DESC, negative_id)::INTEGER AS rank, negative_id,
       s AS positive_score, t AS negative_score
FROM n WHERE 50 * s <= 100 * t AND 100 * t <= 95 * s QUALIFY rank <= 3
"""


@query("op11_anchor_tree_negatives", _OP11)
def op11(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


#: Levels as a recursion over runs; proofs and folds walk up level by level.  crc32 is folded bit by bit.
_OP12 = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, *, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS h FROM documents),
c AS (SELECT r, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, k: xor(t // 2, (t % 2) * 3988292384)))) % 3 END AS m FROM f),
l AS (SELECT r, doc_id, lang, sha256(array_to_string(h, '') || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
             CASE WHEN m = 0 THEN sha256(array_to_string(h, '') || coalesce(strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
      FROM f JOIN c USING (r)),
o AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
low AS (SELECT 0 AS k, g, i, n, leaf AS h FROM o
        UNION ALL SELECT k + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY k, g, i // 8, n),
sub AS (SELECT g, h AS subroot, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS k, g AS i, n, subroot AS h FROM sub
         UNION ALL SELECT k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY k, i // 8, n),
root AS (SELECT h AS root FROM high WHERE n = 1),
runs AS (SELECT 0 AS part, k, g, i // 8 AS p, list(h ORDER BY i) AS hs FROM low WHERE n > 1 GROUP BY k, g, i // 8
         UNION ALL SELECT 1, k, 0, i // 8, list(h ORDER BY i) FROM high WHERE n > 1 GROUP BY k, i // 8),
walk AS (SELECT o.r, 0 AS part, runs.k, runs.hs, ((o.i // (8 ** runs.k)::BIGINT) % 8)::BIGINT AS slot FROM o JOIN runs ON runs.part = 0 AND runs.g = o.g AND runs.p = o.i // (8 ** (runs.k + 1))::BIGINT
         UNION ALL SELECT o.r, 1, runs.k, runs.hs, ((o.g // (8 ** runs.k)::BIGINT) % 8)::BIGINT FROM o JOIN runs ON runs.part = 1 AND runs.p = o.g // (8 ** (runs.k + 1))::BIGINT),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, k) AS s, array_to_string(hs[1:slot], '') AS before, array_to_string(hs[slot + 2:], '') AS after FROM walk),
fold AS (SELECT r, 0::BIGINT AS s, coalesce(other, leaf) AS held FROM o
         UNION ALL SELECT r, steps.s, sha256(before || held || after) FROM fold JOIN steps USING (r) WHERE steps.s = fold.s + 1),
last AS (SELECT r, arg_max(held, s) AS folded_root FROM fold GROUP BY r),
proof AS (SELECT r, string_agg(before || after, '' ORDER BY s) AS others FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(others, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM o JOIN sub USING (g) JOIN last USING (r) LEFT JOIN proof USING (r), root
"""


@query("op12_sibling_shift_manifest", _OP12)
def op12(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_compression_quality")
def op13(spark, sf_dir):
    return compression.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
