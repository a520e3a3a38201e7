"""The corpus operators' registered queries: thin applications to whole tables, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, gif, jaccard, merkle, mixing, packing, pages, pii, secrets, setsketch, substrings, topk, toxicity
from .common import materialize, table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gif.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), counted=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def public_vocabulary() -> str:
    """Where the public tokenizer's vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_vocabulary())


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.replicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "text", "n_chars", "copy", "shuffle_key")


OP5_SQL = """
WITH RECURSIVE mass AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS mass FROM documents GROUP BY source
), rated AS (
  SELECT source, CASE WHEN mass > 0 THEN pow(mass, 0.5e0) / (SELECT sum(pow(mass, 0.5e0)) FROM mass) * (SELECT sum(mass) FROM mass) / mass ELSE 1e0 END AS rate FROM mass
), parted AS (
  SELECT source, rate, CAST(greatest(ceil(rate / 50e0), 1) AS INT) AS parts FROM rated
), steps AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c, rate / parts AS part_rate FROM parted
  UNION ALL
  SELECT source, k + 1, p * part_rate / (k + 1), c + p * part_rate / (k + 1), part_rate FROM steps WHERE k < 160
), draws AS (
  SELECT d.doc_id, d.source, j.j, (CAST('0x' || substr(md5(concat_ws('|', 'mix-1', CAST(d.doc_id AS VARCHAR), CAST(j.j AS VARCHAR))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(generate_series(1, p.parts)) AS j) j
), counts AS (
  SELECT d.doc_id, count(*) AS n FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c <= d.u AND s.c < 1e0 GROUP BY d.doc_id
), copies AS (
  SELECT doc_id, unnest(generate_series(1, n)) AS copy FROM counts
)
SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, CAST(c.copy AS INT) AS copy,
  md5(concat_ws('|', 'mix-1', CAST(d.doc_id AS VARCHAR), CAST(c.copy AS VARCHAR), 'order')) AS shuffle_key
FROM documents d JOIN copies c ON d.doc_id = c.doc_id
"""


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP6_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history arrives in two increments: the second run scans only what the first one's ledger lacks, and reports on all paths."""
    history = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"), "text")
    arrived = history.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0)
    ledger = materialize(secrets.ledger_rows(secrets.scan(arrived, "doc_id", "version", "text")))
    found = secrets.findings(history, "doc_id", "version", "text", ledger)
    base = [r.kind for r in secrets.BASE_RULES]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed([r.kind for r in secrets.RULES]).alias("spans"))


def _op7_sql() -> str:
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS hit, regexp_extract_all(t, '{p}', {r.group}) AS part, string_split_regex(t, '{p}') AS gap FROM docs WHERE regexp_matches(t, '{p}')")
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e){}, '')"
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hits AS ({" UNION ALL ".join(parts)}),
each AS (SELECT *, unnest(generate_series(1, len(hit))) AS i FROM hits),
found AS (
  SELECT doc_id, rank, kind,
    CAST(list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS s,
    CAST(list_sum(list_transform(gap[1:i], lambda g: length(g))) + list_sum(list_transform(hit[1:i], lambda g: length(g))) AS BIGINT) AS e
  FROM each WHERE length(part[i]) >= least
), sums AS (
  SELECT doc_id, {counts}, sha256({listed.format(f" FILTER (rank < {base})")}) AS base_sha256, {listed.format("")} AS spans FROM found GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN sums USING (doc_id)
"""


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def jaccard_sql(source: str, n: int, num: int, den: int) -> str:
    """CTEs up to ``classes`` (doc_id, n_shingles, component_id) over the relation ``source``."""
    return rf"""
words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM {source}
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) END AS s FROM words
), grams AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
), edges AS MATERIALIZED (
  SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), reach AS (
  SELECT x AS doc_id, x AS r FROM edges UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.doc_id
), classes AS (
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.r, s.doc_id) AS component_id
  FROM sets s LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)
)"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS least FROM windows GROUP BY win
), covered AS (
  SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, unnest(generate_series(0, 12)) AS o FROM windows JOIN firsts USING (win) WHERE least < doc_id)
), marked AS (
  SELECT e.doc_id, e.p, e.word, c.p IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words) e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p
), summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN summed USING (doc_id)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, one tree for each language, checked against texts of which a third were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = merkle.leaf(list((fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}).values()))
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered)
    out = merkle.manifest(docs, "lang", "doc_id", merkle.leaf(list(fields.values())), seen)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified", "tree", "pos")


def _merkle_sql() -> str:
    """The same trees level by level: nodes upwards, then a walk of every leaf through the runs it lies in."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(at: str, start: str, walkers: str) -> str:
        """Nodes, runs and walks of the trees in ``start`` (tree, pos, h, n); ``walkers`` are (row, tree, pos, cur, proof)."""
        return f"""
nodes{at} AS (
  SELECT tree, 0 AS k, pos, h, n FROM {start}
  UNION ALL
  SELECT tree, k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes{at} WHERE n > 1 GROUP BY tree, k, pos // 8, n
), runs{at} AS MATERIALIZED (
  SELECT tree, k, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes{at} WHERE n > 1 GROUP BY tree, k, pos // 8
), walk{at} AS (
  SELECT row, tree, pos, 0 AS k, cur, proof FROM {walkers}
  UNION ALL
  SELECT row, tree, w.pos // 8, w.k + 1, sha256(array_to_string(hs[1:i] || [cur] || hs[i+2:], '')), proof || array_to_string(hs[1:i] || hs[i+2:], '')
  FROM (SELECT *, pos % 8 AS i FROM walk{at}) w JOIN runs{at} r USING (tree) WHERE r.k = w.k AND r.run = w.pos // 8
), tops{at} AS (
  SELECT tree, k, h FROM nodes{at} WHERE n = 1
), done{at} AS (
  SELECT row, tree, cur, proof, t.h FROM walk{at} w JOIN tops{at} t USING (tree) WHERE w.k = t.k
)"""

    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {digest("text")} AS leaf, {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
    xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295) % 3 = 0 AS tampered
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), leaves AS (SELECT tree, pos, leaf AS h, n FROM placed),
walkers AS (SELECT row, tree, pos, CASE WHEN tampered THEN lowered ELSE leaf END AS cur, '' AS proof FROM placed), {climb("", "leaves", "walkers")},
subroots AS (SELECT 0 AS tree, tree AS pos, h, (SELECT count(*) FROM tops) AS n FROM tops),
climbers AS (SELECT row, 0 AS tree, tree AS pos, cur, proof FROM done), {climb("2", "subroots", "climbers")}
SELECT p.doc_id, p.leaf, d.h AS subroot, e.h AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = e.h AS verified, p.tree, p.pos
FROM placed p JOIN done d USING (row) JOIN done2 e USING (row)
"""


def public_vocabularies() -> tuple[str, str]:
    """Where the two vocabularies that are aligned are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_vocabularies()
    found = alignment.align(table(spark, sf_dir, "documents"), path_a, path_b)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.lit(""))
    out = alignment.weigh(found.withColumn("groups_sha256", digest).drop("groups"), alignment.coder(path_a, path_b).size_b)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setsketch.classes(table(spark, sf_dir, "documents"), n=5, num=85, den=100)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_gif_media, op2_pii_surrogates, op3_toxicity, op4_karmarkar_karp_packing, op5_poisson_mixing, op6_exact_topk, op7_secret_ledger, op8_page_text, op9_ngram_jaccard_join, op10_substring_dedup, op11_merkle_manifest, op12_cross_tokenizer_alignment, op13_setsketch_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_poisson_mixing": OP5_SQL, "op6_exact_topk": OP6_SQL, "op7_secret_ledger": _op7_sql(), "op9_ngram_jaccard_join": f"WITH RECURSIVE {jaccard_sql('documents', 4, 85, 100)} SELECT * FROM classes", "op10_substring_dedup": OP10_SQL, "op11_merkle_manifest": _merkle_sql(), "op13_setsketch_dedup": f"WITH RECURSIVE {jaccard_sql('documents', 5, 85, 100)} SELECT *, doc_id = component_id AS kept FROM classes"}
