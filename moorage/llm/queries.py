"""The queries of this subpackage over whole tables, and the SQL they must equal."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstokens, decontaminate, embeddings, hardnegatives, htmltext, langid, linededup
from . import sentencepieces, simhash, substrings, toxicity, urls, warczip


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="moorage-")


def byte_model() -> str:
    """Path of the public byte-level vocabulary; executors read the same path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    """Path of the public merge vocabulary; executors read the same path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op2_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document less strings of 400 bytes that occur elsewhere."""
    found = substrings.remove_repeated(_table(spark, folder, "documents"))
    kept = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept, "text")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; unequal: words that the library cut otherwise."""
    documents = _table(spark, folder, "documents")
    found = sentencepieces.encode_decode(documents, piece_model())
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "unequal")


def held_out() -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out."""
    documents = _table(spark, folder, "documents")
    model = langid.learn(documents.where(~held_out()).select("doc_id", "text", "lang"))
    found = langid.predict(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


# Rules of the URL query, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(_table(spark, folder, "pages"), rules)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """How far benchmark items are covered by every document."""
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document less its recurring lines."""
    found = linededup.drop_recurring_lines(_table(spark, folder, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel:
    documents = _table(spark, folder, "documents").where(~held_out())
    return toxicity.learn(documents, _table(spark, folder, "labels"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labels of rows that are not held out."""
    found = toxicity.score(_table(spark, folder, "documents"), toxicity_model(spark, folder))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_passages")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    label = F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = _table(spark, folder, "embeddings").withColumn("label", shifted)
    return hardnegatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of a ZIP package, read back."""
    packages = warczip.write_packages(_table(spark, folder, "pages"))
    page = lambda name: F.nullif(F.col(name), F.lit("")).cast("bigint")
    return warczip.read_records(packages, payloads=False).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op13_token_links(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return crosstokens.token_links(_table(spark, folder, "documents"), byte_model(), piece_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_suffix_array": op2_suffix_array,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_language_id": op4_language_id,
        "op5_url_filter": op5_url_filter,
        "op6_decontamination": op6_decontamination,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_simhash": op8_simhash,
        "op9_line_dedup": op9_line_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_warc": op12_warc,
        "op13_token_links": op13_token_links,
    }


_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

# Fixed values of the line tree, as in the operator.
_FOLDED_LINES = r"""
    texts AS (
        SELECT text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS id
        FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
    folded AS (
        SELECT id, d.line AS place, d.value AS whole,
               trim(regexp_replace(regexp_replace(d.value, '(^|[ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*',
                                                  '\1<*>', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS line
        FROM (SELECT id, unnest(list_zip(range(len(string_split(text, chr(10)))),
                                         string_split(text, chr(10)))) AS z FROM texts) AS t,
             LATERAL (SELECT z[1] AS line, z[2] AS value) AS d)
"""

ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": f"""
        WITH RECURSIVE {_FOLDED_LINES},
        sizes AS (SELECT id, sum(length(whole)) AS total FROM folded GROUP BY id),
        lines AS (
            SELECT *, len(string_split(line, ' ')) AS n,
                   array_to_string(string_split(line, ' ')[1:{linededup.DEPTH}], ' ') AS lead
            FROM folded WHERE line <> '' AND len(string_split(line, ' ')) >= {linededup.MIN_WORDS}),
        firsts AS (SELECT id, n, lead, line, min(length(whole)) AS size FROM lines GROUP BY id, n, lead, line),
        least AS (SELECT line, min(id) AS first FROM firsts GROUP BY line),
        shared AS (
            SELECT id, first, sum(size) AS common FROM firsts JOIN least USING (line)
            WHERE id <> first GROUP BY id, first),
        links AS (
            SELECT s.id AS a, s.first AS b FROM shared s
            JOIN sizes x ON x.id = s.id JOIN sizes y ON y.id = s.first
            WHERE common >= {linededup.COPY_SHARE}::DOUBLE * (x.total + y.total - common)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        roots AS (SELECT a AS id, least(a, min(b)) AS origin FROM reach GROUP BY a),
        origins AS (SELECT id, coalesce(origin, id) AS origin FROM texts LEFT JOIN roots USING (id)),
        counted AS (
            SELECT n, lead, line, count(DISTINCT origin) AS weight
            FROM firsts JOIN origins USING (id) GROUP BY n, lead, line),
        leaves AS (
            SELECT n, lead, sum(weight) AS total FROM counted GROUP BY n, lead
            HAVING sum(weight) >= {linededup.MIN_DOCUMENTS} AND count(*) > 1),
        words AS (
            SELECT n, lead, total, weight, line, unnest(range(n)) AS place, unnest(string_split(line, ' ')) AS word
            FROM counted JOIN leaves USING (n, lead)),
        votes AS (
            SELECT n, lead, total, place, word, sum(weight) AS weight FROM words GROUP BY n, lead, total, place, word),
        shape AS (
            SELECT n, lead, place, word FROM votes WHERE weight * 2 >= total
            QUALIFY row_number() OVER (PARTITION BY n, lead, place ORDER BY weight DESC, word) = 1),
        often AS (SELECT n, lead, place, word FROM votes WHERE weight >= {linededup.MIN_DOCUMENTS}),
        fitting AS (
            SELECT n, lead, line, 'majority' AS template FROM words JOIN shape USING (n, lead, place, word)
            GROUP BY n, lead, line HAVING count(*) >= {linededup.SIMILARITY}::DOUBLE * n
            UNION ALL
            SELECT n, lead, line, 'mask ' || string_agg(place || ' ' || word, ' ' ORDER BY place) AS template
            FROM words JOIN often USING (n, lead, place, word)
            GROUP BY n, lead, line HAVING count(*) >= {linededup.SIMILARITY}::DOUBLE * n),
        spread AS (
            SELECT n, lead, template FROM fitting JOIN firsts USING (n, lead, line) JOIN origins USING (id)
            GROUP BY n, lead, template HAVING count(DISTINCT origin) >= {linededup.MIN_DOCUMENTS}),
        recurring AS (
            SELECT line FROM counted WHERE weight >= {linededup.MIN_EQUAL}
            UNION
            SELECT line FROM fitting JOIN spread USING (n, lead, template)),
        lost AS (SELECT id, place FROM lines JOIN recurring USING (line)),
        kept AS (
            SELECT f.id, count(*) AS n_lines, count(l.place) AS n_dropped,
                   string_agg(f.whole, chr(10) ORDER BY f.place) FILTER (WHERE l.place IS NULL) AS kept_text
            FROM folded f LEFT JOIN lost l ON f.id = l.id AND f.place = l.place GROUP BY f.id)
        SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_dropped, 0)::INTEGER AS n_dropped,
               sha256(coalesce(kept_text, '')) AS kept_sha256
        FROM documents d LEFT JOIN texts USING (text) LEFT JOIN kept USING (id)
    """,
    "op5_url_filter": f"""
        WITH rests AS (
            SELECT page_id, row_number() OVER () AS line,
                   CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id, line,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rests),
        rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
        best AS (
            SELECT line, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM parts JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY line)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best USING (line)
    """,
    "op11_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
    """,
    "op12_warc": """
        WITH heads AS (
            SELECT html, max(page_id) AS response FROM pages WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT page_id, strlen(coalesce(pages.html, ''))::BIGINT AS payload_bytes,
               sha1(coalesce(pages.html, '')) AS payload_digest,
               CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < response THEN response END AS refers_to
        FROM pages LEFT JOIN heads USING (html)
    """,
}
