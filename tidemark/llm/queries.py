"""The registered ``opN_*`` queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bases, gru_lm, langid, licenses, matroska, mixing, packing, secrets, simhash, topk, url_filter
from .common import table

URL_RULES = (
    url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"), url_filter.Rule("block", "org", "/es/"),
)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    first = F.try_element_at("matches", F.lit(1))
    return found.select(F.col("id").alias("doc_id"), "n_blocks", first["license"].alias("license"), first["differing"].alias("differing"), first["saved"].alias("saved"), F.array_join("matches.license", ",").alias("licenses"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), rules=URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.size("strict_hits").cast("long").alias("n_strict"), F.size("soft_hits").cast("long").alias("n_soft"), "soft_weight")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matroska.read_media(matroska.store_payloads(table(spark, sf_dir, "documents")))
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", 256.0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def held_out(modulus: int):
    """Rows kept from learning: those whose crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(4)))
    found = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gru_lm.fit(docs, held_out(7))
    found = gru_lm.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that come from its counts alone; no network is trained or run for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = gru_lm.count(docs, held_out(7))
    found = gru_lm.base(docs, counts).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict:
    """Each operator's query, and what SQL can express of those that it can't express whole."""
    own = {"op1_license_scan": op1_license_scan, "op2_url_filter": op2_url_filter, "op3_packing": op3_packing, "op4_matroska": op4_matroska, "op5_exact_topk": op5_exact_topk, "op6_language_id": op6_language_id, "op7_mixing": op7_mixing, "op8_gru_lm": op8_gru_lm, "op9_secret_scan": op9_secret_scan, "op10_simhash_dedup": op10_simhash_dedup}
    sources = own | {"op8_base": op8_base}
    return own | {name: lambda spark, sf_dir, of=sources[of], keep=keep: keep(of(spark, sf_dir)) for name, (of, keep, _) in bases.BASES.items()}


def _op2_sql() -> str:
    """The rules and the whole vocabulary, term by term, as regular expressions with boundaries."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = lambda term: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS BIGINT)"
    strict = " + ".join(found(t) for t in url_filter.STRICT)
    soft = " + ".join(found(t) for t in url_filter.SOFT)
    weight = " + ".join(f"{w!r} * {found(t)}" for t, w in sorted(url_filter.SOFT.items()))
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    return f"""
    WITH p AS (SELECT page_id, {low} AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k FROM pages),
    s AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(verdict, rhost, rpath) AS (VALUES {rules}),
    fit AS (SELECT k, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, verdict, rhost || rpath) AS n
            FROM s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
    v AS (SELECT *, {strict} AS n_strict, {soft} AS n_soft, CAST({weight} AS DOUBLE) AS soft_weight FROM s)
    SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN n_strict > 0 OR soft_weight >= {url_filter.SOFT_LIMIT!r} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft, soft_weight
    FROM v LEFT JOIN (SELECT * FROM fit WHERE n = 1) f USING (k)"""


OP5_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT)) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _op2_sql(), "op5_exact_topk": OP5_SQL} | {name: sql for name, (_, _, sql) in bases.BASES.items()}
