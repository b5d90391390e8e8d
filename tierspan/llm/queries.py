"""Thin queries over the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierspan.llm import chat, exact_dedup, language_id, licenses, mixing, ngram_join, packing, pii, quality_fm, rules, spelling, vector_codes, warc
from tierspan.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


#: The setting with the secret key of pseudonyms, and the key of runs that only check the operator: it hides nothing from anyone.
PII_KEY, CHECK_KEY = "spark.tierspan.pii.key", "a key for checks alone"


def op3_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, CHECK_KEY))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(odd)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filter_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.takes(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(warc.classify(table(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"), all_digests=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_join": op2_ngram_join,
    "op3_feistel_pii": op3_feistel_pii,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_rules": op5_quality_rules,
    "op6_cube_mixing": op6_cube_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_zip_warc": op9_zip_warc,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_language_id": op13_language_id,
}


def _vector_codes_sql() -> str:
    """Four rounds over tables of parts and entries. Integer division is written out, as it must round down."""
    assigned = """
        a{k} AS MATERIALIZED (
            SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
            FROM (SELECT p.vec_id, p.label, p.part, e.entry, list_sum(list_transform(list_zip(p.x, e.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                  FROM parts p JOIN e{k} e USING (part))
            GROUP BY ALL)"""
    refined = """
        s{k} AS (
            SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n
            FROM (SELECT a.part, a.entry, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM a{k} a JOIN parts p USING (vec_id, part)) GROUP BY ALL),
        m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{k} GROUP BY ALL),
        e{next} AS MATERIALIZED (SELECT part, entry, coalesce(m.y, e.y) AS y FROM e{k} e LEFT JOIN m{k} m USING (part, entry))"""
    rounds = ",".join(assigned.format(k=k) + "," + refined.format(k=k, next=k + 1) for k in range(4)) + "," + assigned.format(k=4)
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, label, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM (SELECT *, unnest(range(4)) AS part FROM kept)),
        seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256),
        e0 AS MATERIALIZED (SELECT part, entry, x AS y FROM parts JOIN seeds USING (vec_id)),{rounds},
        books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS h FROM e4),
        coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books"""

def _spelling_sql() -> str:
    """Checksums by half bytes from a table of 16; words one letter apart share what is left when a letter is taken away."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    return f"""
        WITH RECURSIVE r AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS w
            FROM documents),
        c AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM r GROUP BY d, w),
        h AS (
            SELECT w, n, xor(list_reduce(list_transform(range(1, len(x) + 1), lambda i: CAST(strpos('0123456789ABCDEF', x[CAST(i + 2 * (i % 2) - 1 AS INT)]) - 1 AS BIGINT)),
                   lambda a, b: xor(a >> 4, ({table})[(xor(a, b) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM c),
        v AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS w, n FROM h),
        words AS MATERIALIZED (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE len(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
        cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
        one AS (
            SELECT DISTINCT a.word AS a, b.word AS b, b.n AS nb FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
        near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-nb, encode(b))) AS best, max(nb) AS nb FROM one GROUP BY a),
        f AS MATERIALIZED (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 2 * n THEN best END AS form, CASE WHEN nb >= 2 * n THEN nb END AS form_n FROM words LEFT JOIN near USING (word)),
        ends(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT e.word, f.word, f.form FROM ends e JOIN f ON e.form = f.word)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN ends e ON e.word = f.word AND e.form IS NULL"""


ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)""",
    "op4_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, length(regexp_replace(role || chr(0) || text, '(\\|<turn>|<text>|</turn>|###)', '.\1', 'g')) - 1 + 19 AS n FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_zip_warc": """
        SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN strlen(html) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS last
              FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_spelling_variants": _spelling_sql(),
}
