"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotry.llm import extraction, jaccard, knn, lines, lm, mixing, packing, phrases, quality, rules, secret_scan, trie, urls
from depotry.llm.shared import crc_of_id

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MIX_WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 3.0}
MIX_SEED = 17
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return knn.top_k(vectors, vectors.where("id % 50 = 0"), k=5, scale=256.0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, max_tokens=2048, end_id=0)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_of_id("doc_id") % 4 != 2))
    scored = quality.score(docs.withColumn("held_out", crc_of_id("doc_id") % 4 == 2), model, threshold=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"] <= 2)
    counts = [F.size(secret_scan.of_kind("found", k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base).cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(F.col("found")).alias("spans"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents")).drop("distance2")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, digest=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of_id("doc_id") % 10 == 0).alias("held_out"))
    model = lm.fit(docs.where(~F.col("held_out")))
    return lm.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"), longest=5, min_count=100, top=2000, subsume_pct=100)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"), group=20, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_lm_scoring": op10_lm_scoring,
    "op11_phrases": op11_phrases,
    "op12_urls": op12_urls,
    "op13_trie": op13_trie,
    "op1_top_k": op1_top_k,
    "op2_packing": op2_packing,
    "op3_jaccard": op3_jaccard,
    "op3_links": op3_links,
    "op5_secrets": op5_secrets,
    "op4_quality": op4_quality,
    "op6_rules": op6_rules,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_extraction": op9_extraction,
}

_SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_KEYWORD = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
_ASSIGN = _KEYWORD + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RUN = "[A-Za-z0-9+/_-]+"


def _spans_sql(name: str, pattern: str) -> str:
    """(doc_id, hit, s, e) of a pattern's matches: places from the lengths of matches and of what lies between."""
    return f"""{name}_l AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS b FROM d),
{name}_r AS (SELECT doc_id, unnest(h) AS hit, generate_subscripts(h, 1) AS i, b FROM {name}_l WHERE len(h) > 0),
{name} AS (SELECT doc_id, hit, CAST(sum(length(b[i])) OVER w + sum(length(hit)) OVER w - length(hit) AS BIGINT) AS s, CAST(sum(length(b[i])) OVER w + sum(length(hit)) OVER w AS BIGINT) AS e FROM {name}_r WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def _entropy_sql(window: int) -> str:
    return f"list_max(list_transform(range(length(hit) - {window - 1}), lambda i: list_aggregate(string_split(substr(hit, CAST(i + 1 AS INTEGER), {window}), ''), 'entropy')))"


def _crc_sql(number: str) -> str:
    """crc32 of the decimals of a whole number, bit by bit."""
    bits = "list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))"
    bytes_ = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda x, y: {bits}), 4294967295)"


_ALLOWED = "|".join(secret_scan.ALLOWED)

ORACLES: dict[str, str] = {
    "op1_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM s),
t AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 90 * (x.n + y.n - common)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2""",
    "op5_secrets": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans_sql("a", _ASSIGN)},
{_spans_sql("k", "AKIA[A-Z0-9]+")},
{_spans_sql("x", "[0-9a-f]+")},
{_spans_sql("r", _RUN)},
c AS (SELECT * FROM r WHERE length(hit) >= 20 AND NOT regexp_matches(hit, '{_ALLOWED}', 'i')),
v AS (SELECT doc_id, 0 AS kind, s, e FROM a WHERE length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 8
 UNION ALL SELECT doc_id, 1, s, e FROM k WHERE length(hit) >= 16
 UNION ALL SELECT doc_id, 2, s, e FROM x WHERE length(hit) >= 32
 UNION ALL SELECT doc_id, 3, s, e FROM (SELECT * FROM c WHERE regexp_full_match(hit, '[0-9A-Fa-f]+')) WHERE {_entropy_sql(20)} >= 3.0
 UNION ALL SELECT doc_id, 4, s, e FROM (SELECT * FROM c WHERE length(hit) >= 24) WHERE {_entropy_sql(24)} >= 4.0),
n AS (SELECT *, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][kind + 1] || ':' || s || ':' || e AS span FROM v)
SELECT d.doc_id, CAST(count(*) FILTER (WHERE kind = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (WHERE kind = 2) AS BIGINT) AS n_hex,
 sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind <= 2), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op7_mixing": f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, CASE source WHEN 'src0' THEN 2.0e0 WHEN 'src1' THEN 0.5e0 WHEN 'src2' THEN 3.0e0 ELSE 1.0e0 END AS w FROM n),
r AS (SELECT source, CAST((SELECT sum(n) FROM w) AS DOUBLE) * w / (SELECT sum(w) FROM w) / n AS rate FROM w),
k AS (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 12) AS BIGINT) + 1)) AS k FROM r),
p AS (SELECT source, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
l AS (SELECT source, list(c ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT d.*, len(list_filter(l.cdf, lambda x: x <= CAST(('0x' || substr(md5('{MIX_SEED}:' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0e0)) AS n
      FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(CAST(n AS BIGINT))) AS i FROM d WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS copy_id,
       CAST(('0x' || substr(md5('order {MIX_SEED}:' || doc_id || ':' || i), 1, 13)) AS BIGINT) / 4503599627370496.0e0 AS shuffle_key
FROM e""",
    "op8_line_dedup": f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM s),
k AS (SELECT doc_id, ln, line, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM r),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, h.key IS NOT NULL AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op11_phrases": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, n.n, u.cut, 1000 * c.a::HUGEINT * n.n // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN (SELECT unnest([1, 2, 3, 4]) AS cut) u ON u.cut < c.k JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:u.cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[u.cut + 1:c.k], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
o AS (SELECT c.lang, array_to_string(c.w[i.i:i.i + m.m - 1], ' ') AS phrase, max(c.a) AS longer FROM c JOIN (SELECT unnest(range(1, 6)) AS i) i ON i.i <= c.k JOIN (SELECT unnest([2, 3, 4]) AS m) m ON m.m < c.k AND i.i + m.m - 1 <= c.k GROUP BY 1, 2),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000""",
    "op13_trie": f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, {_crc_sql("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT i.conv_id, 0 AS side, o.pos, o.role, o.text FROM i JOIN o ON o.conv_id = i.base AND o.pos < i.h UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM i JOIN o ON o.conv_id = i.conv_id AND o.pos >= i.h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth, sha256(length(role) || ':' || role || text) AS turn FROM b),
m AS MATERIALIZED (SELECT conv_id, depth, len(regexp_extract_all(text, '{_WORD}')) AS words, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM r
 UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS MATERIALIZED (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM m GROUP BY 1, 2),
p AS MATERIALIZED (SELECT n.*, a.depth AS up_depth, a.conv_id AS up FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth JOIN n a ON a.depth = m.depth AND a.prefix = m.prefix),
c AS (SELECT up AS conv_id, up_depth AS depth, count(*) AS n_children FROM p WHERE up_depth = depth - 1 GROUP BY 1, 2),
s AS (SELECT p.up AS conv_id, p.up_depth AS depth, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, CAST(sum((p.n_convs - 1) * p.words) AS BIGINT) AS saved_tokens FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.depth = p.depth GROUP BY 1, 2),
e AS (SELECT l.prefix, l.depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS k FROM m) l WHERE k = 1 GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.up AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.conv_id = n.conv_id AND s.depth = n.depth LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth AND p.up_depth = n.depth - 1 LEFT JOIN c ON c.conv_id = n.conv_id AND c.depth = n.depth LEFT JOIN e ON e.prefix = n.prefix AND e.depth = n.depth""",
}
