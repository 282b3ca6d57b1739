"""The registered queries of this subpackage, over whole tables, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import alignment, article, decontaminate, disclosure, language, mixing, packing, paragraphs, simhash, subvectors, toxicity, vafile, warc
from caseloom.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


@query()
def op1_best_fit_shards(spark, folder):
    """All documents in 16 shards of near equal bytes."""
    shards = packing.pack(read(spark, folder, "documents"), shards=16)
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    r"""
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('7:' || doc_id) AS turn
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM words GROUP BY source),
levels AS (
  SELECT source_size, weight, 2 * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER below, 0) AS full_below, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS weight_left
  FROM sources WINDOW below AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT total - full_below::DOUBLE AS remaining, weight_left
  FROM levels WHERE cap > (total - full_below::DOUBLE) * weight / weight_left
  ORDER BY source_size / weight LIMIT 1),
aims AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size <= remaining * weight / weight_left THEN 2.0::DOUBLE * source_size
              ELSE remaining * weight / weight_left END AS target
  FROM sources LEFT JOIN level ON true),
placed AS (
  SELECT doc_id, size, source_size, coalesce(target, 2.0::DOUBLE * source_size) AS target,
         coalesce(sum(size) OVER (PARTITION BY words.source ORDER BY turn, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM words JOIN aims ON words.source IS NOT DISTINCT FROM aims.source),
taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taken"""
)
def op7_water_filled_mix(spark, folder):
    """Words that the mix takes of every document."""
    return mixing.mix(read(spark, folder, "documents")).drop("copies")


@query()
def op9_golay_simhash(spark, folder):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(parts: int, part: int):
    """Whether a document belongs to the part that models never learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


@query()
def op4_naive_bayes_language(spark, folder):
    """Predicted language of every document; a quarter of the documents is held out."""
    docs = read(spark, folder, "documents")
    model = language.train(docs.filter(~held_out(4, 2)))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query()
def op5_factorization_toxicity(spark, folder):
    """Toxicity of every document; a third of the documents is held out."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    seen = labels.filter(~held_out(3, 1)).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(toxicity.sample(docs, seen))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query()
def op10_spaced_seed_overlaps(spark, folder):
    """Overlaps of documents with benchmark items."""
    found = decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.withColumn("similarity", F.col("same_tokens") / F.col("tokens"))


@query(
    """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
)
def op2_va_file_top5(spark, folder):
    """The five vectors with the largest products for every fiftieth vector."""
    return vafile.top_products(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op8_disclosure_spans(spark, folder):
    """Personal data and disclosing terms of every document."""
    found = disclosure.find(read(spark, folder, "documents"))
    counts = [F.col("counts")[number].alias(f"n_{kind}") for number, kind in enumerate(disclosure.KINDS)]
    return found.select("doc_id", *counts, disclosure.base_digest(F.col("base")).alias("base_sha256"), "spans")


@query(
    r"""
WITH hashed AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
spelled AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
           CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)),
           'string_agg', '') AS payload_digest,
         regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '(?s)#.*$', '') AS rest
  FROM hashed),
keyed AS (
  SELECT *, regexp_extract(rest, '^[^/?]*') AS host,
         max(page_id) OVER (PARTITION BY payload_digest) AS latest
  FROM spelled),
named AS (
  SELECT *, array_to_string(list_reverse(string_split(
           regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www[0-9]*\.', ''), '.')), ',') || ')' ||
         coalesce(nullif(lower(substr(rest, length(host) + 1)), ''), '/') AS url_key
  FROM keyed)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to, coalesce(url_key, '') AS url_key,
       row_number() OVER (ORDER BY coalesce(url_key, ''), page_id % 1000000000, page_id) - 1 AS capture_no
FROM named"""
)
def op3_warc_index(spark, folder):
    """Record of every page in the archives, and its place in the merged index.

    The pages have no time of capture; a page counts as captured page_id seconds into the crawl.
    """
    seconds = F.expr("timestampadd(SECOND, pmod(page_id, 1000000000), TIMESTAMP_NTZ'2000-01-01 00:00:00')")
    stamp = F.concat(F.replace(seconds.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    pages = read(spark, folder, "pages").select("page_id", "url", "html", F.coalesce(stamp, F.lit("")).alias("stamp"))
    return warc.archive(pages).drop("stamp")


@query()
def op6_minhash_passages(spark, folder):
    """Paragraphs of passages that repeat across documents."""
    return paragraphs.repeated_passages(read(spark, folder, "documents"))


def _rounds_sql(rounds: int, k: int) -> str:
    """Centroids by exact whole-number rounds, one set of tables per round."""
    assign = """
a{r} AS (
  SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r})
  GROUP BY vec_id, v)"""
    update = """,
c{n} AS (
  SELECT c{r}.c, coalesce(m.w, c{r}.w) AS w FROM c{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c) m ON m.c = c{r}.c)"""
    steps = ",".join(assign.format(r=r) + update.format(r=r, n=r + 1) for r in range(rounds)) + "," + assign.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY digest) - 1 AS c, v AS w FROM (
    SELECT sha256('2:' || vec_id) AS digest, v FROM kept ORDER BY digest LIMIT {k})),{steps}
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


@query(_rounds_sql(5, 40))
def op11_subvector_clusters(spark, folder):
    """Cluster of every vector after five rounds from forty centroids."""
    return subvectors.cluster(read(spark, folder, "embeddings"), k=40, rounds=5, seed=2, dim=64)


@query()
def op13_token_links(spark, folder):
    """Groups and links of the tokens of two tokenizers in every document."""
    return alignment.align(read(spark, folder, "documents"))


@query()
def op12_crf_article_text(spark, folder):
    """Main text of every page."""
    pages = read(spark, folder, "pages")
    return article.extract(pages, article.train(pages))
