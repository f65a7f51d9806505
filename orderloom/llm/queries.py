"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import bpe, forest, language, layout, packing, periodic, secrets, simhash, substring, token_counts, toxicity, vectors, warc


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path(), capacity=2048)


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_products(_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offsets").alias("n_offsets"),
        F.array_join(F.transform("offsets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("offsets"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.report(_table(spark, sf_dir, "documents"), file_rows=2000, bits=3)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_table(spark, sf_dir, "documents"), least=24, times=3)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = language.predict(docs, language.fit(docs))
    return told.select("doc_id", (language.fold(F.col("doc_id")) == language.HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_best_fit_packing, op3_warc_zstd, op4_exact_topk, op5_bpe, op6_toxicity, op7_simhash, op8_ann_forest, op9_secret_scan, op10_token_counts, op11_clustered_layout, op12_periodic_runs, op13_language_id)}


def _secret_matches() -> str:
    """One row for each text and kind: the least length, whole matches, values, and the lengths of what lies between."""
    kinds = ((0, secrets.ASSIGN, 2), (1, secrets.ACCESS, 0), (2, secrets.HEX, 0), (3, secrets.LIVE, 0))
    return " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, {secrets.LEAST[secrets.KINDS[k]]} AS least, regexp_extract_all(t, '{p}', 0) AS w, regexp_extract_all(t, '{p}', {group}) AS v, "
        f"list_transform(string_split_regex(t, '{p}'), lambda x: len(x)) AS g FROM d"
        for k, p, group in ((k, p.replace("'", "''"), group) for k, p, group in kinds)
    )


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda k: ord(k)::BIGINT)), lambda c, b: {byte}), 4294967295)"


_Z = " + ".join(f"((({c} >> {b}) & 1) << {4 * b + k})" for b in (2, 1, 0) for k, c in enumerate(("c1", "c2", "c3", "c4")))

ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM r)),
l AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)""",
    "op3_warc_zstd": """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT *, octet_length(b) AS n, ('0x' || sha1(b)) AS h FROM p),
t AS (SELECT rid, page_id, n, h, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 3 + 5 * i, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT + 1, 1)), '')), '') AS digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM t)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m""",
    "op4_exact_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS repository FROM documents),
m AS ({_secret_matches()}),
u AS (SELECT rid, kind, least, unnest(w) AS w, unnest(v) AS v, unnest(g[1 : len(w)]) AS g, unnest(range(len(w))) AS i FROM m WHERE len(w) > 0),
s AS (SELECT rid, kind, least, v, sum(g + len(w)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop, len(w) AS n FROM u),
f AS (SELECT rid, kind, v, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM s
      WHERE len(v) >= least AND (kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))),
k AS (SELECT * FROM f WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.rid = f.rid AND b.kind < 3 AND b.start <= f.start AND f.stop <= b.stop)),
h AS (SELECT v, count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, repository)) <= 2 AS live FROM k JOIN d USING (rid) GROUP BY v),
z AS (SELECT k.*, live, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS name FROM k JOIN h USING (v)),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
             count(*) FILTER (live AND kind < 3) AS n_live, count(*) FILTER (NOT live AND kind < 3) AS n_copied FROM z GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (rid)""",
}

ORACLE["op11_clustered_layout"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(octet_length(encode(text)), -1) AS length, {_crc32("doc_id::VARCHAR")} % 365 AS date FROM documents),
c AS (SELECT rid, doc_id, {", ".join(f"(8 * (rank() OVER (ORDER BY {c} NULLS FIRST) - 1)) // count(*) OVER () AS c{k}" for k, c in enumerate(("source", "lang", "length", "date"), 1))} FROM d),
z AS (SELECT *, {_Z} AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST, rid) - 1 AS position FROM z),
f AS (SELECT *, position // 2000 AS file FROM p),
b AS (SELECT file, {", ".join(f"min(c{k}) AS l{k}, max(c{k}) AS h{k}" for k in (1, 2, 3, 4))} FROM f GROUP BY file),
q AS (SELECT DISTINCT z, c1, c2, c3, c4 FROM f),
t AS (SELECT q.z, count(*) AS files_touched FROM q JOIN b ON c1 BETWEEN l1 AND h1 AND c2 BETWEEN l2 AND h2 AND c3 BETWEEN l3 - 1 AND h3 + 1 AND c4 BETWEEN l4 - 1 AND h4 + 1 GROUP BY q.z),
h AS (SELECT DISTINCT file, c1, c2, c3, c4 FROM f),
m AS (SELECT q.z, count(DISTINCT h.file) AS files_matching FROM q JOIN h ON h.c1 = q.c1 AND h.c2 = q.c2 AND abs(h.c3 - q.c3) <= 1 AND abs(h.c4 - q.c4) <= 1 GROUP BY q.z)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched::BIGINT AS files_touched, files_matching::BIGINT AS files_matching,
       concat_ws(',', l1, h1, l2, h2, l3, h3, l4, h4) AS file_bounds
FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)"""

ORACLE["op12_periodic_runs"] = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g FROM t),
p AS (SELECT *, CASE WHEN made THEN g % n ELSE 0 END AS a FROM g),
o AS (SELECT *, CASE WHEN made THEN 1 + (n - a) // (3 + g % 8) ELSE n END AS p FROM p),
x AS (SELECT rid, n, i, w[1 + CASE WHEN i < a OR NOT coalesce(made, false) THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM o)),
e AS (SELECT l.rid, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.rid = r.rid AND l.word = r.word AND r.i > l.i AND r.i - l.i <= l.n // 3),
k AS (SELECT *, count(*) OVER (PARTITION BY rid, q) AS m FROM e),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM k WHERE m >= greatest(24 - q, 2 * q)),
c AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, island HAVING count(*) >= greatest(24 - q, 2 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = c.rid AND b.q < c.q AND b.start <= c.start AND b.start + b.length >= c.start + c.length)),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / q DESC, start, q) = 1),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told FROM r GROUP BY rid),
z AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM r),
y AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN z USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, ((1000 * length) // q)::BIGINT AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN y USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
