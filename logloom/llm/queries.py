"""The queries of this subpackage: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, language_id, mixing, periodic_runs, pii, secrets, toxicity, warc
from .nndescent import near_duplicates
from .ngram_join import Jaccard, jaccard_components
from .sentencepiece_codec import encode_digests
from .shared import Scratch
from .topk import top_k


# The base kinds, with the group and the number of its characters that decide, as the contract gives them.
# Capital and small letters are spelled out, as other letters fold to them where case is ignored.
SECRET_KINDS = (
    ("assign", """(?:([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("web_token", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1),
)


def _secret_kind(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')"


SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(_secret_kind(k, *kind) for k, kind in enumerate(SECRET_KINDS))}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM c),
s AS (SELECT doc_id, k, kind, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b, length(m[i]) AS n
      FROM i WHERE length(g[i]) >= least),
l AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT, ',' ORDER BY b, k) FILTER (k < 3) AS base,
      string_agg(kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT, ',' ORDER BY b, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l USING (doc_id)
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, (1 + 5 * i)::INT, 5))::INT) AS parts FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(parts, lambda n: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((n >> s) & 31))::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM v
"""


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


VERSIONS_SQL = """
WITH t AS (SELECT DISTINCT coalesce(text, '') AS t FROM conversations),
b AS (SELECT coalesce(text, '') AS t FROM conversations UNION ALL SELECT coalesce(text, '') FROM documents),
s AS (SELECT count(*) AS n FROM b WHERE regexp_matches(t, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+-----END [A-Z ]*PRIVATE KEY-----|eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8}'))
SELECT (SELECT count(*) FROM t) AS scanned_first, (SELECT count(DISTINCT t) FROM b) - (SELECT count(*) FROM t) AS scanned_then, 0::BIGINT AS scanned_again,
       (SELECT count(*) FROM b) AS paths, (SELECT count(*) FROM b) AS paths_scanned, (SELECT n FROM s) AS paths_with_secrets
"""


LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / a.n / b.n >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT p.b AS a, r.c FROM r JOIN p ON p.a = r.a),
m AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT l.b AS a, r.c FROM r JOIN l ON l.a = r.a)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) m LEFT JOIN n USING (doc_id)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), Jaccard(width=4, num=85, den=100)).drop("text_hash")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit_documents(docs))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["lang"])), ",")
    return found.select("doc_id", (language_id.fold(found["doc_id"], 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, Scratch(spark, "op3").path("ledger"))
    ledger.update(docs)
    return secrets.digest(ledger.findings(docs))


def secret_ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two updates of one ledger scan: conversations, then these and documents; only blobs unseen so far count."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), "text")
    both = turns.unionByName(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    ledger = secrets.Ledger(spark, Scratch(spark, "versions").path("ledger"))
    scanned = [ledger.update(x, path_col="path") for x in (turns, both, both)]
    found = ledger.findings(both, path_col="path").agg(F.count("*").alias("paths"), F.count_if(F.size("spans") > 0).alias("paths_with_secrets"), F.count("spans").alias("paths_scanned"))
    return found.select(F.lit(scanned[0]).cast("long").alias("scanned_first"), F.lit(scanned[1]).cast("long").alias("scanned_then"), F.lit(scanned[2]).cast("long").alias("scanned_again"), "paths", "paths_scanned", "paths_with_secrets")


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *[F.col(c).cast("long").alias(c) for c in ("mix_place", "mix_block", "mix_release", "mix_due", "mix_phase", "mix_slot")])


def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, secret=spark.conf.get("spark.logloom.pseudonym.key", "for tests only"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learned = labels.where(language_id.fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select(F.col("doc_id").alias("key"), "text"), learned)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (language_id.fold(found["doc_id"], 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def vocabulary(name: str, path: str | None = None) -> bytes:
    """The bytes of a vocabulary file: the public one of this name unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def piece_model(path: str | None = None) -> bytes:
    """The bytes of a SentencePiece model: that of the public 32k vocabulary unless a path is given."""
    return vocabulary("piece_bpe_32k.model", path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), piece_model())


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), piece_model())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeats(_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, least=4, shortest=6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_pfair_mix, op3_secret_ledger, op4_pii_feistel, op5_arc_to_warc, op6_nn_descent, op7_ngram_jaccard, op8_exact_top_k, op9_toxicity, op10_sentencepiece, op11_byte_bpe, op12_token_alignment, op13_periodic_runs, secret_ledger_versions)}


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_ledger": SECRETS_SQL, "op5_arc_to_warc": WARC_SQL, "op6_nn_descent": LINKS_SQL, "op7_ngram_jaccard": JACCARD_SQL, "op8_exact_top_k": TOP_K_SQL, "secret_ledger_versions": VERSIONS_SQL}
