"""Registered queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.llm import images, langid, licenses, minhash, mixing, packing, pages, pii, search, syncmers, tokens, urls, whitening
from subvox.llm.common import read

#: Vocabulary of the token queries: a file of the tokenizers that are installed on every machine.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints_against_edits(read(spark, folder, "documents", "doc_id", "text"))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents", "doc_id", "text"))


def training(docs: DataFrame) -> DataFrame:
    """The rows that language models may learn from."""
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True)))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.fit(training(docs))
    found = docs.select("doc_id", "text").withColumn("_lang", langid.identify(docs, model))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "_lang.*")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    automaton = tokens.byte_vocabulary(tokenizer_path())
    return docs.withColumn("_n", tokens.token_counts(docs, automaton)).select("doc_id", "_n.*")


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return docs.withColumn("_found", pii.detect(docs, pii.fit(docs))).select("doc_id", "_found.*")


def op6_image_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Images made of the vectors; each fiftieth is searched as a cropped and darkened copy."""
    vectors = read(spark, folder, "embeddings", "vec_id", "embedding")
    return images.find_copies(vectors, images.vector_image, images.cropped, key="vec_id", data="embedding")


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), words=2)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents", "doc_id", "text"), tokenizer_path(), special=True)


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "pages", "page_id", "url", "html")
    return rows.withColumn("_main", pages.extract()).select("page_id", "url", "_main.*")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read(spark, folder, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The rules of the URL query: host and path, and what they say.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "pages", "page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(rows, rules, keep=("page_id",))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings", "vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.rank(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_syncmers, op2_licenses, op3_language, op4_token_counts, op5_personal_data, op6_image_copies, op7_near_duplicates, op8_packing, op9_main_text, op10_mixing, op11_url_filter, op12_whitening, op13_ranked_search, pipeline)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    # Equal sets are one row; sets that share a shingle are compared on full sets, then followed from the smallest document on.
    "op7_near_duplicates": f"""
        WITH RECURSIVE worded AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents
        ), shingled AS (
            SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM worded
        ), sets AS (
            SELECT s, len(s) AS n, min(doc_id) AS first, row_number() OVER () AS c FROM shingled WHERE len(s) > 0 GROUP BY s
        ), numbered AS (
            SELECT c, dense_rank() OVER (ORDER BY x) AS x FROM (SELECT c, unnest(s) AS x FROM sets)
        ), shared AS (
            SELECT a.c AS a, b.c AS b, count(*) AS common FROM numbered a JOIN numbered b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c
        ), links AS (
            SELECT a, b FROM shared JOIN sets p ON p.c = a JOIN sets q ON q.c = b WHERE 100 * common >= 80 * (p.n + q.n - common)
        ), edges AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
            SELECT c, first FROM sets UNION SELECT b, first FROM reached JOIN edges ON a = c
        ), components AS (
            SELECT c, min(first) AS component_id FROM reached GROUP BY c
        )
        SELECT doc_id, len(d.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM shingled d LEFT JOIN sets ON d.s = sets.s LEFT JOIN components USING (c)""",
    "op10_mixing": f"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS size,
                   (('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '~')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents
        ), sums AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, [{", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, {mixing.MOST} * source_size::DOUBLE AS stop,
                   {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS goal FROM sums
        ), climbed AS (
            SELECT *, stop / w AS ratio, row_number() OVER o AS step, coalesce(sum(stop) OVER b, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_weight FROM weighed
            WINDOW o AS (ORDER BY stop / w, source NULLS LAST), b AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), level AS (
            SELECT arg_min((goal - filled) / open_weight, step) AS level FROM climbed WHERE ratio > (goal - filled) / open_weight
        ), targets AS (
            SELECT source, source_size, least(stop, coalesce(level * w, stop)) AS target FROM climbed, level
        ), rated AS (
            SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, {mixing.MOST}) ELSE 0 END AS rate
            FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        ), ordered AS (
            SELECT *, target - sum(floor(rate) * size) OVER (PARTITION BY source) AS rest, sum(size) OVER (PARTITION BY source ORDER BY u, size ROWS UNBOUNDED PRECEDING) AS upto FROM rated
        ), copied AS (
            SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN rate > floor(rate) AND rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies FROM ordered
        )
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied""",
    "op11_url_filter": f"""
        WITH rests AS (
            SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rests
        ), cut AS (
            SELECT r, page_id, {_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
        ), rules AS (
            SELECT rule, says, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath
            FROM (VALUES {", ".join(str(r) for r in URL_RULES)}) AS t(rule, says)
        ), best AS (
            SELECT r, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says
            FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r
        )
        SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM cut LEFT JOIN best USING (r)""",
    "op13_ranked_search": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
        sizes AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
        counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
        spread AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
        asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        weighed AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN spread USING (term), totals),
        scored AS (
            SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
            FROM weighed JOIN counted USING (term) JOIN sizes USING (r), totals GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
