"""One query for each operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.bpe import codec_digest
from ridgeline.llm.centroids import cluster
from ridgeline.llm.chat import rotate_perspectives
from ridgeline.llm.common import documents, table
from ridgeline.llm.embedding import embedding_duplicates
from ridgeline.llm.lines import drop_repeated_lines
from ridgeline.llm.mixing import layout_topic, mix, word_count
from ridgeline.llm.packing import pack_documents
from ridgeline.llm.quality import score, train
from ridgeline.llm.search import top_k
from ridgeline.llm.simhash import simhash_components
from ridgeline.llm.suffix import cut_repeats
from ridgeline.llm.token_count import token_counts
from ridgeline.llm.whitening import whiten

# DuckDB: blanks are \x20 and \x09 to \x0D
LINE_DEDUP = """
WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), words=4, bits=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), limit=0.98)


EMBEDDING = """
WITH RECURSIVE fine AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id, b.vec_id AS other FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.other FROM reached r JOIN links l ON r.other = l.vec_id
), lowest AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counted AS (SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN counted USING (vec_id)
"""


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


# How op5 and the pipeline sort documents into topics: by layout marks, else by length in characters.
TOPIC_MARKS = [("license", "Licensed under"), ("table", " | "), ("symbols", "%%%"), ("shout", "!! ")]
TOPIC_SIZES = [("short", 1000), ("medium", 5000)]
MIX_TEMPER = 0.9
MIX_ROUNDS = 8
MIX_SHARE = 0.65  # of all tokens that op5 and the pipeline keep


def mixing_dims() -> dict[str, Column]:
    topic = layout_topic(F.col("text"), TOPIC_MARKS, TOPIC_SIZES, "long")
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = mixing_dims()
    mixed = mix(documents(spark, sf_dir), dims, word_count(F.col("text")), temper=MIX_TEMPER, rounds=MIX_ROUNDS, share=MIX_SHARE)
    return mixed.select("doc_id", "source", "lang", dims["topic"].alias("topic"), F.round("probability", 9).alias("probability"), "sampled")


def mixing_sql(docs: str = "documents") -> str:
    """The same raking in DuckDB, a table expression for each margin of each round."""
    cases = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPIC_MARKS)
    cases += " " + " ".join(f"WHEN coalesce(length(text), 0) < {size} THEN '{name}'" for name, size in TOPIC_SIZES)
    word = "'[^\\x09-\\x0D\\x20]+'"
    parts = [
        f"d AS (SELECT *, CASE {cases} ELSE 'long' END AS topic, coalesce(len(regexp_extract_all(text, {word})), 0) AS words FROM {docs})",
        f"c0 AS (SELECT source, lang, topic, CAST(sum(words) AS DOUBLE) AS own, CAST(sum(words) AS DOUBLE) * {MIX_SHARE}::DOUBLE AS weight FROM d GROUP BY ALL)",
    ]
    for dim in ("source", "lang", "topic"):
        shares = f"(SELECT {dim}, pow(sum(own), {MIX_TEMPER}) AS s FROM c0 GROUP BY {dim} HAVING sum(own) > 0)"
        parts.append(f"t_{dim} AS (SELECT {dim}, s / sum(s) OVER () * (SELECT sum(own) * {MIX_SHARE}::DOUBLE FROM c0) AS wanted FROM {shares})")
    last = "c0"
    for turn in range(MIX_ROUNDS):
        for dim in ("source", "lang", "topic"):
            step = f"c{turn + 1}_{dim}"
            parts.append(
                f"{step} AS MATERIALIZED (SELECT c.* EXCLUDE (weight), least(own, weight * coalesce(wanted / nullif(sum(weight) OVER (PARTITION BY c.{dim}), 0), 0)) AS weight "
                f"FROM {last} c LEFT JOIN t_{dim} t ON c.{dim} IS NOT DISTINCT FROM t.{dim})"
            )
            last = step
    parts.append(f"p AS (SELECT source, lang, topic, coalesce(weight / nullif(own, 0), 1.0) AS probability FROM {last})")
    parts.append(
        "mixed AS (SELECT d.*, probability, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / pow(16, 13) < probability AS sampled FROM d JOIN p "
        "ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic)"
    )
    return "WITH " + ",\n".join(parts)


MIXING = "SELECT doc_id, source, lang, topic, round(probability, 9) AS probability, sampled FROM mixed"


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).drop("text", "source", "lang", "n_chars")


CHAT_TURNS = 64


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = rotate_perspectives(table(spark, sf_dir, "conversations"), turns=CHAT_TURNS)
    marks = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return chats.select("conv_id", "perspective", "piece", "n_turns", F.sha2("text", 256).alias("text_sha256"), marks.alias("trained"))


CHAT = f"""
WITH placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM placed WHERE role IS DISTINCT FROM 'system'
), parts AS (
    SELECT p.conv_id, speaker, p.place, p.place // {CHAT_TURNS} AS piece, role IS NOT DISTINCT FROM speaker AS own,
        '<|' || CASE WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
            ELSE 'user:' || translate(coalesce(nullif(role, ''), 'unknown'), '|<>' || chr(10) || chr(13), '_____') END || '|>' || chr(10) AS head,
        replace(coalesce(text, ''), '<|', '<\\|') || '<|end|>' || chr(10) AS body
    FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), spread AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, piece ORDER BY place) AS stop FROM parts
)
SELECT conv_id, speaker AS perspective, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns,
    sha256(string_agg(head || body, '' ORDER BY place)) AS text_sha256,
    coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(body) AS VARCHAR) || '-' || CAST(stop AS VARCHAR) END, ',' ORDER BY place), '') AS trained
FROM spread GROUP BY conv_id, speaker, piece
"""


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return top_k(docs, queries, k=10)


# Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
SEARCH = r"""
WITH terms AS (
    SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM documents) GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf) AS words FROM terms GROUP BY doc_id
), totals AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(words) FROM lengths) / (SELECT count(*) FROM documents) AS mean
), weights AS (SELECT term, ln(1 + ((SELECT n FROM totals) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM terms GROUP BY term
), impacts AS (
    SELECT doc_id, term, CAST(round_even(idf * (tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * words / mean))) * 1e6, 0) AS BIGINT) AS impact
    FROM terms JOIN lengths USING (doc_id) JOIN weights USING (term), totals
), scores AS (
    SELECT q.doc_id AS query_id, i.doc_id, CAST(sum(impact) AS BIGINT) AS score
    FROM (SELECT DISTINCT doc_id, term FROM terms WHERE doc_id % 20 = 0) q JOIN impacts i USING (term) GROUP BY ALL
)
SELECT query_id, rank, doc_id, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(documents(spark, sf_dir), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = drop_repeated_lines(docs, min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


CLUSTERS, CLUSTER_ROUNDS = 16, 3


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=CLUSTER_ROUNDS, dim=64, scale=64, seed="1:")


def clustering_sql() -> str:
    """The same rounds in DuckDB, with plain squared distances."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND {finite})""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM kept QUALIFY k < {CLUSTERS})""",
    ]
    for turn in range(CLUSTER_ROUNDS + 1):
        parts.append(
            f"""a{turn} AS MATERIALIZED (
    SELECT place, vec_id, x, k, d FROM (
        SELECT *, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{turn})
    QUALIFY row_number() OVER (PARTITION BY place ORDER BY d, k) = 1)"""
        )
        if turn < CLUSTER_ROUNDS:  # the sum is taken down to a multiple of the count before it is divided
            parts.append(
                f"""c{turn + 1} AS MATERIALIZED (
    SELECT k, coalesce(m, c) AS c FROM c{turn} LEFT JOIN (
        SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
            SELECT k, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
            FROM (SELECT k, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM a{turn}) GROUP BY k, i) GROUP BY k) USING (k))"""
            )
    last = CLUSTER_ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (k)
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=32, scale=64)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=4096, closing=1)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}


def llm_oracles() -> dict[str, str]:
    return {
        "op3_embedding_dedup": EMBEDDING,
        "op5_mixing": f"{mixing_sql()}\n{MIXING}",
        "op7_chat_format": CHAT,
        "op8_top_k_search": SEARCH,
        "op10_line_dedup": LINE_DEDUP,
        "op11_centroid_clustering": clustering_sql(),
    }
