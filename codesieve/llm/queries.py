"""Queries of the operators over whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import (
    centroids,
    chat,
    decontam,
    exact_dedup,
    html_extract,
    langid,
    lm,
    mixing,
    resample,
    sharding,
    simhash,
    suffix_dedup,
    warc,
)
from codesieve.llm.common import ship_package, staged, table

LLM_QUERIES: dict = {}
LLM_ORACLE: dict[str, str] = {}

SHARDS, OLD_SHARDS = 16, 12
NEAR_WORDS = 2


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    LLM_QUERIES[function.__name__] = run
    return run


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.reshard(docs, SHARDS, OLD_SHARDS)
    return rows.select(
        "doc_id", F.col("__size").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("__old").alias("old_shard"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


LLM_ORACLE["op5_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, place % 3 + 1 AS weight FROM placed),
filled AS (
    SELECT *, row_number() OVER f AS turn,
           sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
               ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER (
               ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
    FROM weighed WINDOW f AS (ORDER BY source_size / weight, place)),
marked AS (SELECT *, 3 * source_size * weights <= rest * weight AS capped FROM filled),
targets AS (
    SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
        (SELECT arg_min(rest::DOUBLE / weights::DOUBLE, turn) FROM marked WHERE NOT capped) * weight END AS target
    FROM marked),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
runs AS (
    SELECT s.doc_id, s.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
           sum(s.size) OVER (PARTITION BY s.source, hash) AS own
    FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto <= budget THEN 1
                              WHEN upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1
                              ELSE 0 END))::BIGINT AS taken
FROM runs
"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are the stored snapshot, the other rows the new batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = exact_dedup.dedup_against(docs, F.col("doc_id") % 2 == 0)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.col("digest").alias("text_sha256"))


LLM_ORACLE["op7_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), simhash.fingerprint_text(F.col("fp")).alias("fingerprint"),
                       "component_id")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.train(docs.where(langid.fold() != 1))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.identified(docs.select("doc_id", "text"), language_model(docs))
    return rows.select("doc_id", (langid.fold() == 1).alias("held_out"), F.col("__lang").alias("lang_pred"),
                       F.col("__score").alias("score"), F.col("__langs").alias("langs"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_items counts the items with all words of a window within two words of their places."""
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=NEAR_WORDS)
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("near_items"))


LLM_ORACLE["op4_decontamination"] = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
          FROM documents)
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
          FROM benchmark)),
windows AS (
    SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
    FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i
          FROM words WHERE side = 'b' AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
    SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
          FROM words, lengths WHERE side = 'd' AND len(w) >= n)),
found AS (SELECT g.id, g.i, g.n, v.item_id FROM grams g JOIN windows v USING (n, phrase)),
hits AS (
    SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY id),
items AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found) GROUP BY id),
placed AS (
    SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words WHERE side = 'd'),
often AS (SELECT word, count(*) AS c FROM placed GROUP BY word),
phrases AS (
    SELECT phrase, n, row_number() OVER (ORDER BY phrase) AS k FROM (SELECT DISTINCT phrase, n FROM windows)),
terms AS (
    SELECT k, n, unnest(string_split(phrase, ' ')) AS word,
           generate_subscripts(string_split(phrase, ' '), 1) - 1 AS o
    FROM phrases),
rarest AS (
    SELECT k, n, arg_min(word, (c, o)) AS word, arg_min(o, (c, o)) AS o
    FROM terms JOIN often USING (word) GROUP BY k, n HAVING count(*) = n),
slop AS (SELECT unnest([-2, -1, 0, 1, 2]) AS x),
starts AS (SELECT DISTINCT r.k, r.n, p.id, p.p - r.o + x AS s FROM rarest r JOIN placed p USING (word), slop),
close AS (
    SELECT s.k, s.id FROM starts s JOIN terms t USING (k), slop JOIN placed p
        ON p.id = s.id AND p.word = t.word AND p.p = s.s + t.o + x
    GROUP BY s.k, s.id, s.s, s.n HAVING count(DISTINCT t.o) = s.n),
near AS (
    SELECT c.id, count(DISTINCT v.item_id) AS near_items
    FROM close c JOIN phrases USING (k) JOIN windows v USING (phrase) GROUP BY c.id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, 0)::BIGINT AS near_items
FROM words w LEFT JOIN hits USING (id) LEFT JOIN items USING (id) LEFT JOIN near USING (id) WHERE side = 'd'
"""


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = html_extract.extracted(pages.select("page_id", "url", "html"), html_extract.train(pages))
    return rows.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.convert_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id")


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    windows = staged(chat.chat_windows(turns.unionByName(extra)), "chat-windows")
    return chat.read_back(windows).withColumnRenamed("conv", "conv_id")


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.fold(folds=5) == 1
    rows = lm.scores(docs, lm.train(docs, ~held_out))
    return rows.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out)


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumnRenamed("id", "doc_id")


# DuckDB has no CRC-32, so its table of 256 remainders is made and applied to a word's bytes.
LLM_ORACLE["op12_importance_resampling"] = r"""
WITH crc AS (
    SELECT list(c ORDER BY i) AS remainders
    FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
          FROM range(256) t(i))),
texts AS (
    SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
words AS (
    SELECT side, row, doc_id, coalesce(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM texts),
used AS (SELECT side, row, unnest(w) AS word FROM words),
hashes AS (
    SELECT word, xor(list_reduce(
               list_transform(range(1, octet_length(encode(word)) + 1),
                              lambda k: ('0x' || substr(hex(encode(word)), 2 * k - 1, 2))::BIGINT),
               lambda c, b: xor(c // 256, remainders[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM used), crc),
counted AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM used JOIN hashes USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counted),
gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * (t0.s_all + 10000))::DOUBLE / ((s + 1) * (t0.t_all + 10000))::DOUBLE))::BIGINT AS gain
    FROM counted, totals t0),
weights AS (
    SELECT row, sum(gain)::BIGINT AS weight FROM used JOIN hashes USING (word) JOIN gains USING (bucket)
    WHERE side = 'd' GROUP BY row),
scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
           count(*) OVER (PARTITION BY n_features >= 20) AS n
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ranked
"""

CENTRES, ROUNDS = 8, 10


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(table(spark, sf_dir, "embeddings"), CENTRES, ROUNDS)
    return rows.withColumnRenamed("id", "vec_id")


def _clustering_sql(centres: int, rounds: int) -> str:
    """Plain rounds over all pairs of vector and centroid."""
    sql = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS c, v AS m
    FROM kept QUALIFY c < {centres})"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (
    SELECT row, v, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT row, v, c, list_sum([(x - m[i]) * (x - m[i]) for x, i in v])::BIGINT AS d FROM kept, c{r}) GROUP BY row, v)"""
        if r < rounds:
            sql += f""",
s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
    SELECT c, coalesce(g.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) g USING (c))"""
    return sql + f"""
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (row) JOIN c{rounds} USING (c)
"""


LLM_ORACLE["op13_centroid_clustering"] = _clustering_sql(CENTRES, ROUNDS)
