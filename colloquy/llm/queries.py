"""The registered queries of the operators, with production parameters, and SQL where it can say
the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, exact_dedup, html_extract, media, mixing, ngram_join, pii, quality, setsketch, source_audit, token_alignment, toxicity, url_filter
from colloquy.llm.common import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


#: Shares of tokens that the mixed corpus is to have.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the mixing: the language of the documents that have labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"))
    return documents.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each row of embeddings is drawn as one, and some of them edited."""
    return media.find_copies(media.drawn(table(spark, sf_dir, "embeddings")))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_copies(table(spark, sf_dir, "documents"), words=4, percent=80)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"), with_groups=False)


_ALL = (op1_pii, op2_exact_dedup, op3_html_extract, op4_mixing, op5_quality, op6_url_filter, op7_bpe, op8_toxicity, op9_ngram_join, op10_media, op11_setsketch, op12_source_audit, op13_token_alignment)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                     sha256(coalesce(text, '')) AS text_sha256
              FROM documents)
    """,
    "op6_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw_host,
                   CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        hosts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
        rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        fits AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
            FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM hosts h LEFT JOIN fits f ON h.page_id = f.page_id AND f.place = 1
    """,
    "op12_source_audit": r"""
        WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS row FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        said AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM cells JOIN v USING (lang)),
        whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole JOIN v USING (lang)),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - q.q AS value FROM shares s JOIN q ON q.lang = s.lang AND q.term = s.term WHERE s.n > 0 AND s.p > q.q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
