"""The registry of queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierspan.functions import columns, phonology
from tierspan.operators import audio, hierarchy, intervals, positions, resume, resyllabify, staging, writes
from tierspan.plans import project
from tierspan.plans.corpus import sample_rows
from tierspan.plans.query import Entity, Query
from tierspan.session import materialise
from tierspan.sources import awd, synthetic, textgrid, utterances, webmaus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL of the projections
_WORDS = r"""
w0 AS (SELECT conv_id, turn, role, unnest(ws) AS label, generate_subscripts(ws, 1) - 1 AS pos
       FROM (SELECT *, list_filter(string_split_regex(coalesce(text, ''), '[ \n]+'), lambda x: x <> '') AS ws FROM conversations)),
w1 AS (SELECT *, CAST(sum(length(label) + 1) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM w0),
words AS (SELECT conv_id AS audio_id, role AS speaker_id, e - length(label) - 1 AS "start", e - 1 AS "end",
                 (conv_id * 1000 + turn) * 10000 + pos AS identifier, conv_id * 1000 + turn AS parent_id, label FROM w1),
phrases AS (SELECT audio_id, speaker_id, parent_id AS identifier, min("start") AS "start", max("end") AS "end", count(*) AS n_words
            FROM words GROUP BY audio_id, speaker_id, parent_id)"""
_PHONES = _WORDS + r""",
phones AS (SELECT audio_id, speaker_id, "start" + k AS "start", "start" + k + 1 AS "end", identifier * 100 + k AS identifier, identifier AS parent_id,
                  parent_id AS phrase_id, substr(label, CAST(k + 1 AS INT), 1) AS label, lower(substr(label, CAST(k + 1 AS INT), 1)) IN ('a', 'e', 'i', 'o', 'u') AS is_vowel
           FROM (SELECT *, unnest(range(length(label))) AS k FROM words))"""
_SPANS = """
spans AS (SELECT user_id AS audio_id, event_type AS speaker_id, event_id AS identifier, epoch_us(ts) // 1000 AS "start",
                 epoch_us(ts) // 1000 + CAST(floor(value * 60000) AS BIGINT) AS "end" FROM events)"""


def _register(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _query(name: str, sql: str | None = None):
    def put(run):
        _register(name, sql, run)
        return run

    return put


def _q(spark: SparkSession, sf_dir: str, entity: str) -> Query:
    return Query({name: project.table(spark, sf_dir, name) for name in project.GRAPH}, project.GRAPH, entity)


def _lookup(name: str, entity: str, key: str, where: str, steps: Callable[[Query], Query]) -> None:
    """A filtered entity's keys, against a WHERE clause."""
    _register(name, f"SELECT {key} FROM {entity} WHERE {where}", lambda spark, d: steps(_q(spark, d, entity)).rows().select(*key.split(", ")))


# lookups
_lookup("p01_implicit_eq", "orders", "o_orderkey", "o_orderstatus = 'F'", lambda q: q.filter(o_orderstatus="F"))
_lookup("p02_eq", "customer", "c_custkey", "c_nationkey = 3", lambda q: q.filter(c_nationkey__eq=3))
_lookup("p03_gt", "orders", "o_orderkey", "o_totalprice > 200000", lambda q: q.filter(o_totalprice__gt=200000))
_lookup("p04_gte", "part", "p_partkey", "p_size >= 40", lambda q: q.filter(p_size__gte=40))
_lookup("p05_lt", "customer", "c_custkey", "c_acctbal < 0", lambda q: q.filter(c_acctbal__lt=0))
_lookup("p06_lte", "part", "p_partkey", "p_size <= 5", lambda q: q.filter(p_size__lte=5))
_lookup("p07_range", "orders", "o_orderkey", "o_totalprice BETWEEN 100000 AND 150000", lambda q: q.filter(o_totalprice__range=(100000, 150000)))
_lookup("p08_in", "part", "p_partkey", "p_brand IN ('Brand#1', 'Brand#3')", lambda q: q.filter(p_brand__in=["Brand#1", "Brand#3", None]))
_lookup("p08_in_substring", "customer", "c_custkey", "contains('BUILDING or HOUSEHOLD', c_mktsegment)", lambda q: q.filter(c_mktsegment__in="BUILDING or HOUSEHOLD"))
_lookup("p09_contains", "part", "p_partkey", "contains(p_name, 'in')", lambda q: q.filter(p_name__contains="in"))
_lookup("p10_icontains", "customer", "c_custkey", "contains(lower(c_name), 'r#0000000')", lambda q: q.filter(c_name__icontains="R#0000000"))
_lookup("p11_startswith", "part", "p_partkey", "starts_with(p_name, 's')", lambda q: q.filter(p_name__startswith="s"))
_lookup("p12_istartswith", "part", "p_partkey", "starts_with(lower(p_type), 'eco')", lambda q: q.filter(p_type__istartswith="eCo"))
_lookup("p13_endswith", "customer", "c_custkey", "ends_with(c_name, '7')", lambda q: q.filter(c_name__endswith="7"))
_lookup("p14_iendswith", "part", "p_partkey", "ends_with(lower(p_type), 'my')", lambda q: q.filter(p_type__iendswith="MY"))
_lookup("p15_iexact", "customer", "c_custkey", "lower(c_mktsegment) = 'building'", lambda q: q.filter(c_mktsegment__iexact="Building"))
_lookup("p16_regex", "customer", "c_custkey", "regexp_matches(c_name, '#0+[1-3]')", lambda q: q.filter(c_name__regex="#0+[1-3]"))
_lookup("p17_iregex", "part", "p_partkey", "regexp_matches(p_brand, 'BRAND#[25]$', 'i')", lambda q: q.filter(p_brand__iregex="BRAND#[25]$"))
_lookup("p18_len_eq", "part", "p_partkey", "length(p_name) = 10", lambda q: q.filter(p_name__len_eq=10))
_lookup("p19_len_gt", "part", "p_partkey", "length(p_name) > 10", lambda q: q.filter(p_name__len_gt=10))
_lookup("p20_len_lt", "part", "p_partkey", "length(p_name) < 10", lambda q: q.filter(p_name__len_lt=10))
_lookup("p22_exact", "part", "p_partkey", "p_brand = 'Brand#2'", lambda q: q.filter(p_brand__exact="Brand#2"))

# paths and composition
_lookup("p23_scalar_path", "orders", "o_orderkey", "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 5000)", lambda q: q.filter(customer__nation__n_regionkey=2, customer__c_acctbal__gt=5000))
_lookup("p24_exists_path", "nation", "n_nationkey", "n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity = 50)", lambda q: q.filter(customers__orders__lineitems__l_quantity=50.0))
_lookup("p25_relation_len", "customer", "c_custkey", "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12", lambda q: q.filter(orders__len_gt=12))
_lookup("p25_relation_len_empty", "customer", "c_custkey", "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda q: q.filter(orders__len_eq=0))
_lookup("p26_list_equality", "orders", "o_orderkey", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", lambda q: q.filter(lineitems=[]))
_lookup("p27_independent_exists", "customer", "c_custkey", "c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", lambda q: q.filter(orders__o_orderstatus="F", orders__o_orderpriority="1-URGENT"))
_lookup("p28_chain", "orders", "o_orderkey", "o_orderstatus = 'O' AND o_totalprice > 300000", lambda q: q.filter(o_orderstatus="O").filter(o_totalprice__gt=300000))
_lookup("p29_exclude", "orders", "o_orderkey", "NOT (coalesce(o_orderstatus = 'O', false) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))", lambda q: q.exclude(o_orderstatus="O", customer__c_mktsegment="BUILDING"))
_lookup("p29_exclude_many_to_one", "lineitem", "l_orderkey, l_linenumber", "NOT coalesce(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 5), false)", lambda q: q.exclude(part__p_size=5))
_lookup("p29_exclude_counts_and_lists", "orders", "o_orderkey", "NOT ((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 4 AND coalesce(o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1), false))", lambda q: q.exclude(lineitems__len_gt=4, customer__nation__n_regionkey=1))
_lookup("q01_all", "supplier", "s_suppkey", "true", lambda q: q.all())
_lookup("q08_requery", "orders", "o_orderkey", "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1) AND o_totalprice > 250000", lambda q: q.from_items(q.tables["lineitem"].where("l_discount = 0.1").select("l_orderkey")).filter(o_totalprice__gt=250000))

_lookup("q07_computed", "lineitem", "l_orderkey, l_linenumber", "l_extendedprice * (1 - l_discount) > 80000", lambda q: q.filter(net__gt=80000))
_lookup("q07_carried", "orders", "o_orderkey", "NOT coalesce((SELECT c_mktsegment FROM customer WHERE c_custkey = o_custkey), 'none') IN ('BUILDING', 'none')", lambda q: q.exclude(segment__in=["BUILDING", "none"]))
_register("q09_related", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_orderstatus = 'F'", lambda spark, d: _q(spark, d, "nation").filter(n_regionkey=1).related("customers").related("orders").filter(o_orderstatus="F").related("customer").rows().select("c_custkey"))


@_query("h24_link", f'WITH {_PHONES} SELECT p.identifier, w."start" AS parent_start, w.parent_id AS phrase_id, f."start" AS phrase_start FROM phones p JOIN words w ON p.parent_id = w.identifier JOIN phrases f ON w.parent_id = f.identifier')
def _link(spark, d):
    """Phones as syllables of their word: they take its start, and its phrase by way of the word."""
    words = staging.link(project.words(spark, d), project.phrases(spark, d), "words")
    phones = project.phones(spark, d).drop("phrase_id")
    return staging.link(phones, words, "syllables").select("identifier", "parent_start", "phrase_id", "phrase_start")


@_query("q04_get_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def _get_n(spark, d):
    return _q(spark, d, "orders").get_n(50).select("o_orderkey", "o_totalprice")


@_query("q05_order_by_all", "SELECT o_orderkey, c_name, o_totalprice, row_number() OVER (ORDER BY c_mktsegment, o_totalprice DESC, o_orderkey) AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _order_by_all(spark, d):
    """Every order with its place."""
    placed = _q(spark, d, "orders").order_by("customer__c_mktsegment", "-o_totalprice").numbered("place")
    names = project.table(spark, d, "customer").select("c_custkey", "c_name")
    return placed.join(names, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "o_totalprice", "place")


@_query("q06_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def _count(spark, d):
    return _q(spark, d, "orders").filter(o_orderstatus="P").rows().agg(F.count(F.lit(1)).alias("n"))


# scans
@_query("s02_rank_counts", "SELECT 'nation' AS object_type, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _ranks(spark, d):
    out = None
    for name in ("nation", "customer", "orders", "lineitem"):
        one = project.table(spark, d, name).groupBy(F.lit(name).alias("object_type")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("s08_audio_prefix", f'WITH {_WORDS} SELECT identifier, "start" FROM words WHERE audio_id = 5')
def _prefix(spark, d):
    return project.words(spark, d).where("audio_id = 5").select("identifier", "start")


@_query("s09_time_range", f'WITH {_WORDS} SELECT identifier, "start" FROM words WHERE audio_id BETWEEN 3 AND 6 AND "start" >= 100 AND "start" < 400')
def _range(spark, d):
    return project.words(spark, d).where("audio_id BETWEEN 3 AND 6 AND start >= 100 AND start < 400").select("identifier", "start")


@_query("s05_multi_get", "SELECT pos, o_orderkey, o_totalprice FROM (VALUES (0, 7), (1, 3), (2, 99), (3, 7)) v(pos, k) JOIN orders ON o_orderkey = k")
def _multi(spark, d):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 99), (3, 7)], "pos int, k long")
    orders = project.table(spark, d, "orders")
    return wanted.join(orders, wanted["k"] == orders["o_orderkey"]).select("pos", "o_orderkey", "o_totalprice")


@_query("s11_label_index", f"WITH {_WORDS} SELECT identifier, audio_id FROM words WHERE label = 'the'")
def _label(spark, d):
    return project.words(spark, d).where(F.col("label") == "the").select("identifier", "audio_id")


@_query("s10_descendants", f'WITH {_WORDS} SELECT p.identifier AS phrase, count(*) AS n FROM phrases p JOIN words w ON w.audio_id = p.audio_id AND w."start" >= p."start" AND w."start" < p."end" GROUP BY p.identifier')
def _descendants(spark, d):
    return hierarchy.in_window(project.phrases(spark, d), project.words(spark, d)).groupBy(F.col("p_identifier").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@_query("s18_bulk", f"WITH {_WORDS} SELECT w.identifier, p.speaker_id FROM words w JOIN phrases p ON p.identifier = w.parent_id WHERE p.n_words > 100")
def _bulk(spark, d):
    some = project.phrases(spark, d).where("n_words > 100").select(F.col("identifier").alias("parent_id"), "speaker_id")
    return project.words(spark, d).drop("speaker_id").join(some, "parent_id").select("identifier", "speaker_id")


# hierarchy
@_query("h01_parent", f'WITH {_WORDS} SELECT w.identifier, p."start" AS p_start, p.n_words AS p_n_words FROM words w LEFT JOIN phrases p ON p.identifier = w.parent_id')
def _parent(spark, d):
    return hierarchy.with_parent(project.words(spark, d), project.phrases(spark, d)).select("identifier", "p_start", "p_n_words")


@_query("h02_children", f'WITH {_WORDS} SELECT p.identifier AS parent, w.identifier AS child FROM phrases p JOIN words w ON w.parent_id = p.identifier AND w."start" >= p."start" AND w."start" < p."end"')
def _children(spark, d):
    return hierarchy.children(project.phrases(spark, d), project.words(spark, d)).select(F.col("p_identifier").alias("parent"), F.col("identifier").alias("child"))


@_query("h03_overlapping", f'WITH {_WORDS}, p AS (SELECT identifier, audio_id, "start" AS s, "end" + 40 AS e FROM phrases) SELECT p.identifier AS parent, w.identifier AS child FROM p JOIN words w ON w.audio_id = p.audio_id AND w."start" >= s AND w."start" < e AND w.parent_id <> p.identifier')
def _over(spark, d):
    wide = project.phrases(spark, d).withColumn("end", F.col("end") + 40)
    return hierarchy.overlapping(wide, project.words(spark, d)).select(F.col("p_identifier").alias("parent"), F.col("identifier").alias("child"))


@_query("h06_descendants", f"WITH {_PHONES} SELECT p.identifier AS phrase, count(*) AS n_phones, count(*) FILTER (is_vowel) AS n_vowels FROM phrases p JOIN phones f ON f.phrase_id = p.identifier GROUP BY p.identifier")
def _deep(spark, d):
    return project.phones(spark, d).groupBy(F.col("phrase_id").alias("phrase")).agg(F.count(F.lit(1)).alias("n_phones"), F.count_if("is_vowel").alias("n_vowels"))


@_query("h07_preorder", f'WITH {_WORDS}, t AS (SELECT identifier, audio_id, "start", 0 AS l, identifier AS p FROM phrases UNION ALL SELECT identifier, audio_id, "start", 1, parent_id FROM words) SELECT identifier, row_number() OVER (PARTITION BY t.audio_id ORDER BY s.ps, t.p, l, t."start", identifier) AS place FROM t JOIN (SELECT identifier AS p, "start" AS ps FROM phrases) s ON s.p = t.p')
def _preorder(spark, d):
    phrases, words = project.phrases(spark, d).withColumn("label", F.lit("")), project.words(spark, d)
    rows = hierarchy.preorder(("phrase", phrases), ("word", words))
    audio_id = F.when(F.col("level") == "phrase", F.floor(F.col("identifier") / 1000)).otherwise(F.floor(F.col("identifier") / 10_000_000))
    return rows.withColumn("_a", audio_id).withColumn("place", F.row_number().over(Window.partitionBy("_a").orderBy("path")).cast("long")).select("identifier", "place")


@_query("h08_ancestors", f"WITH {_PHONES} SELECT f.identifier, w.identifier AS word_id, p.identifier AS phrase_id FROM phones f JOIN words w ON w.identifier = f.parent_id JOIN phrases p ON p.identifier = w.parent_id")
def _ancestors(spark, d):
    rows = project.phones(spark, d).drop("phrase_id")
    return hierarchy.ancestors(rows, {"word": project.words(spark, d), "phrase": project.phrases(spark, d)}).select("identifier", "word_id", "phrase_id")


@_query("h13_word_codes", f"WITH {_WORDS} SELECT w.identifier, CAST(EXISTS (SELECT 1 FROM phrases p WHERE p.audio_id = w.audio_id AND p.speaker_id <> w.speaker_id AND p.\"start\" - 10 < w.\"end\" AND w.\"start\" < p.\"end\" + 10) AS SMALLINT) AS overlap_code FROM words w")
def _word_codes(spark, d):
    """Words against phrases of others that are heard a little longer, so that turns overlap."""
    wide = project.phrases(spark, d).withColumns({"start": F.col("start") - 10, "end": F.col("end") + 10})
    return intervals.overlap_codes(wide, project.words(spark, d))


@_query("h11_neighbours", f'WITH {_WORDS} SELECT identifier, lag(identifier) OVER w AS prev_id, lead(identifier) OVER w AS next_id FROM words WINDOW w AS (PARTITION BY parent_id ORDER BY "start", identifier)')
def _neighbours(spark, d):
    return hierarchy.siblings(project.words(spark, d)).select("identifier", "prev_id", "next_id")


@_query("h12_overlap", f'WITH {_SPANS} SELECT identifier FROM spans a WHERE EXISTS (SELECT 1 FROM spans b WHERE a.audio_id = b.audio_id AND a.identifier <> b.identifier AND a."start" < b."end" AND b."start" < a."end")')
def _overlap(spark, d):
    s = project.spans(spark, d)
    return intervals.overlaps(s, s).select("identifier")


@_query("h12_overlap_bucketed_all", ORACLE_SQL["h12_overlap"])
def _bucketed_all(spark, d):
    s = project.spans(spark, d)
    return intervals.bucketed_overlaps(s, s, 3_600_000).select("identifier")


@_query("h13_overlap_codes", f'WITH {_SPANS} SELECT identifier, CAST(EXISTS (SELECT 1 FROM spans b WHERE a.audio_id = b.audio_id AND a.identifier <> b.identifier AND a.speaker_id <> b.speaker_id AND a."start" < b."end" AND b."start" < a."end") AS SMALLINT) AS overlap_code FROM spans a')
def _codes(spark, d):
    return intervals.overlap_codes(project.spans(spark, d))


@_query("h14_same_speaker", f'WITH {_SPANS} SELECT identifier FROM (SELECT *, max("end") OVER (PARTITION BY audio_id, speaker_id ORDER BY "start", "end", identifier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans) WHERE "start" < m')
def _same(spark, d):
    return intervals.same_speaker_overlaps(project.spans(spark, d)).select("identifier")


@_query("h15_containment", f'WITH {_SPANS} SELECT i.identifier, arg_max(o.identifier, (o."start", o.identifier)) AS parent_id FROM spans i JOIN spans o ON i.audio_id = o.audio_id AND o.speaker_id = \'click\' AND i.speaker_id <> \'click\' AND i."start" >= o."start" AND i."end" <= o."end" GROUP BY i.identifier')
def _contain(spark, d):
    s = project.spans(spark, d)
    return intervals.contained(s.where("speaker_id = 'click'"), s.where("speaker_id <> 'click'"))


@_query("h16_midpoint", f'WITH {_SPANS} SELECT i.identifier, arg_min(o.identifier, (o."start", o.identifier)) AS span_id FROM spans i JOIN spans o ON i.audio_id = o.audio_id AND o.speaker_id = \'click\' AND i.speaker_id <> \'click\' AND (i."start" + i."end") / 2 BETWEEN o."start" AND o."end" GROUP BY i.identifier')
def _mid(spark, d):
    s = project.spans(spark, d)
    return intervals.midpoint(s.where("speaker_id = 'click'"), s.where("speaker_id <> 'click'"))


@_query("h17_asof", f'WITH {_SPANS}, c AS (SELECT * FROM spans WHERE speaker_id = \'click\'), p AS (SELECT identifier, audio_id, "end" AS t FROM spans WHERE speaker_id <> \'click\') SELECT p.identifier, (SELECT CASE WHEN p.t <= arg_max(c."end", (c."start", c.identifier)) THEN arg_max(c.identifier, (c."start", c.identifier)) END FROM c WHERE c.audio_id = p.audio_id AND c."start" <= p.t) AS span_id FROM p')
def _asof(spark, d):
    s = project.spans(spark, d)
    return intervals.as_of(s.where("speaker_id = 'click'"), s.where("speaker_id <> 'click'").select("audio_id", "identifier", F.col("end").alias("at")))


_SHIFTED = "CASE WHEN l_linenumber % 5 = 0 THEN 0.5 WHEN l_linenumber % 2 = 0 THEN 0.0000005 ELSE 0 END"


@_query("h18_zip", f"WITH l AS (SELECT l_orderkey AS file, l_linenumber AS idx, l_quantity AS lmin FROM lineitem), r AS (SELECT file, idx, lmin + {_SHIFTED.replace('l_linenumber', 'idx')} AS rmin FROM l WHERE idx <> 6) SELECT file, idx, lmin, coalesce(abs(lmin - rmin) <= 0.000001, false) AS aligned FROM l FULL JOIN r USING (file, idx)")
def _zip(spark, d):
    lines = project.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("idx"), "l_linenumber", F.col("l_quantity").cast("double").alias("xmin"))
    left = lines.withColumn("tier", F.lit("words"))
    right = lines.where("idx <> 6").withColumn("tier", F.lit("fon")).withColumn("xmin", F.col("xmin") + F.expr(_SHIFTED))
    both = left.unionByName(right).select("file", "tier", "idx", "xmin", (F.col("xmin") + 1).alias("xmax"), F.lit("").alias("mark"))
    return textgrid.zip_tiers(both, "words", "fon", 1e-6).select("file", "idx", "lmin", "aligned")


@_query("h19_triples", "SELECT stem, c.n AS customer, s.n AS supplier, p.n AS part, c.n IS NOT NULL AND s.n IS NOT NULL AND p.n IS NOT NULL AS complete FROM (SELECT CAST(c_custkey AS VARCHAR) AS stem, c_name AS n FROM customer) c FULL JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS stem, s_name AS n FROM supplier) s USING (stem) FULL JOIN (SELECT CAST(p_partkey AS VARCHAR) AS stem, p_name AS n FROM part) p USING (stem)")
def _triples(spark, d):
    kinds = {t: project.table(spark, d, t).select(F.col(f"{t[0]}_{k}").cast("string").alias("stem"), F.col(f"{t[0]}_name").alias("path")) for t, k in (("customer", "custkey"), ("supplier", "suppkey"), ("part", "partkey"))}
    return awd.pair_sources(**kinds)


@_query("h20_speaker_nav", f"WITH {_WORDS} SELECT speaker_id AS of_speaker, count(*) AS n FROM phrases GROUP BY speaker_id")
def _nav(spark, d):
    phrases = project.phrases(spark, d)
    return hierarchy.speaker_phrases(hierarchy.audio_speakers(phrases), phrases).groupBy("of_speaker").agg(F.count(F.lit(1)).alias("n"))


@_query("h20_speaker_nav_shared", f"WITH {_WORDS} SELECT l.speaker_id AS of_speaker, count(*) AS n FROM (SELECT DISTINCT audio_id, speaker_id FROM phrases) l JOIN phrases p ON p.audio_id = l.audio_id GROUP BY l.speaker_id")
def _nav_shared(spark, d):
    phrases = project.phrases(spark, d)
    return hierarchy.speaker_phrases(hierarchy.audio_speakers(phrases), phrases, shared=True).groupBy("of_speaker").agg(F.count(F.lit(1)).alias("n"))


@_query("h21_audio_nav", f"WITH {_WORDS} SELECT DISTINCT audio_id, speaker_id FROM phrases")
def _audio_nav(spark, d):
    return hierarchy.audio_speakers(project.phrases(spark, d))


@_query("h22_fallback", "SELECT l_orderkey, l_linenumber, CASE WHEN a.vec_id IS NOT NULL THEN 0 WHEN b.vec_id IS NOT NULL THEN 1 WHEN c.vec_id IS NOT NULL THEN 2 END AS depth, CASE WHEN a.vec_id IS NOT NULL THEN a.label WHEN b.vec_id IS NOT NULL THEN b.label ELSE c.label END AS vector FROM lineitem LEFT JOIN embeddings a ON a.vec_id = l_orderkey LEFT JOIN embeddings b ON b.vec_id = l_partkey LEFT JOIN embeddings c ON c.vec_id = l_suppkey")
def _fallback(spark, d):
    rows = project.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = hierarchy.nearest_embedding(rows, [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")], project.table(spark, d, "embeddings"), "vec_id", "label")
    return out.select("l_orderkey", "l_linenumber", "depth", "vector")


# derived columns
@_query("j01_duration", f'WITH {_SPANS} SELECT identifier, "end" - "start" AS duration, ("end" - "start") / 1000 AS seconds, ("start" + "end") / 2 AS middle FROM spans')
def _duration(spark, d):
    return project.spans(spark, d).select("identifier", columns.duration().alias("duration"), columns.seconds(columns.duration()).alias("seconds"), columns.middle(F.col("start"), F.col("end")).alias("middle"))


@_query("j03_trunc_ms", "SELECT event_id, CAST(trunc(value * 1000) AS BIGINT) AS ms FROM events")
def _trunc(spark, d):
    return project.table(spark, d, "events").select("event_id", columns.ms_truncated(F.col("value")).alias("ms"))


@_query("j04_even_ms", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2000 * 1000, 0) AS BIGINT) AS ms FROM lineitem")
def _even(spark, d):
    return project.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", columns.ms_half_even(F.col("l_quantity") / 2000).alias("ms"))


@_query("j06_stress", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unstressed' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' ELSE 'unknown' END AS stress FROM part")
def _stress(spark, d):
    return project.table(spark, d, "part").select("p_partkey", columns.decode(F.col("p_size") % 4, {0: "unstressed", 1: "primary", 2: "secondary"}, "unknown").alias("stress"))


@_query("j07_position", "SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'onset' WHEN 2 THEN 'nucleus' WHEN 3 THEN 'coda' ELSE 'unknown' END AS position FROM part")
def _position(spark, d):
    return project.table(spark, d, "part").select("p_partkey", columns.decode(F.col("p_size") % 5, {1: "onset", 2: "nucleus", 3: "coda"}, "unknown").alias("position"))


@_query("j08_overlap_tri", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE p_retailprice > 950 END AS overlap FROM part")
def _tri(spark, d):
    return project.table(spark, d, "part").select("p_partkey", columns.tri_state(F.col("p_size") % 3, F.col("p_retailprice") > 950).alias("overlap"))


# fixed values: each symbol's type, voice and height
_FEATURES = """f(symbol, type, voice, high) AS (SELECT unnest(string_split(s, ' ')), type, voice, high FROM (VALUES
('g ɡ ɣ ɲ ŋ w j', 'consonant', '+', '+'), ('ʀ', 'consonant', '+', '-'), ('b d d͡ʒ v ð z ʒ m n r ɾ l ʋ ɹ', 'consonant', '+', '0'),
('k ç x', 'consonant', '-', '+'), ('p t ʔ t͡ʃ f θ s ʃ h', 'consonant', '-', '0'), ('i iː y yː ɨ ʉ u uː ɪ ʏ ʊ ui', 'vowel', '+', '+'),
('e eː ø øː o oː ə ɛ ɛː œ œ̃ œː ʌ ɔ ɔː æ æ̃ ɐ a aː ɑ ɑ̃ː ɒ ɒː ɒ̃ː ɛi œy ɑu', 'vowel', '+', '-')) t(s, type, voice, high))"""


@_query("j13_features", f"WITH {_PHONES}, {_FEATURES} SELECT f.type, voice, high, count(*) AS n FROM phones p LEFT JOIN f ON f.symbol = p.label GROUP BY f.type, voice, high")
def _features(spark, d):
    rows = phonology.with_features(project.phones(spark, d))
    return rows.groupBy("type", F.col("features")["voice"].alias("voice"), F.col("features")["high"].alias("high")).agg(F.count(F.lit(1)).alias("n"))


# aggregations
@_query("a02_distinct_speakers", f"WITH {_SPANS} SELECT audio_id, count(DISTINCT speaker_id) AS n FROM spans GROUP BY audio_id")
def _speakers(spark, d):
    return project.spans(spark, d).groupBy("audio_id").agg(F.countDistinct("speaker_id").alias("n"))


@_query("a03_cardinality", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def _cardinality(spark, d):
    c, o = project.table(spark, d, "customer").select("c_custkey"), project.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@_query("a04_span", f'WITH {_WORDS} SELECT parent_id, min("start") AS first, max("end") AS last FROM words GROUP BY parent_id')
def _span(spark, d):
    return project.words(spark, d).groupBy("parent_id").agg(F.min("start").alias("first"), F.max("end").alias("last"))


@_query("a05_label_concat", f"WITH {_WORDS} SELECT parent_id, string_agg(label, ' ' ORDER BY \"start\", identifier) AS label, min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n FROM words GROUP BY parent_id")
def _concat(spark, d):
    return hierarchy.labels_joined(project.words(spark, d), "parent_id")


@_query("a06_duplicates", "SELECT p_name, count(*) AS count FROM part GROUP BY p_name HAVING count(*) > 1")
def _dups(spark, d):
    return writes.duplicate_keys(project.table(spark, d, "part"), ["p_name"])


@_query("a08_max_end", f'WITH {_SPANS} SELECT audio_id, max("end") AS last FROM spans GROUP BY audio_id')
def _max_end(spark, d):
    return project.spans(spark, d).groupBy("audio_id").agg(F.max("end").alias("last"))


@_query("a09_unique", "SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT c_custkey) AS ids FROM customer")
def _unique(spark, d):
    return project.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_name").alias("names"), F.countDistinct("c_custkey").alias("ids"))


@_query("a10_first_last", f'WITH {_WORDS} SELECT parent_id, arg_min(label, ("start", identifier)) AS first_label, arg_max(label, ("start", identifier)) AS last_label FROM words GROUP BY parent_id')
def _first_last(spark, d):
    at = F.struct("start", "identifier")
    return project.words(spark, d).groupBy("parent_id").agg(F.min_by("label", at).alias("first_label"), F.max_by("label", at).alias("last_label"))


# windows and sequences
@_query("w01_pauses", f'WITH {_SPANS}, g AS (SELECT *, CASE WHEN "start" - lag("end") OVER w >= 3600000 THEN 1 ELSE 0 END AS b FROM spans WINDOW w AS (PARTITION BY audio_id, speaker_id ORDER BY "start", identifier)), r AS (SELECT *, sum(b) OVER (PARTITION BY audio_id, speaker_id ORDER BY "start", identifier ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT audio_id, speaker_id, CAST(run AS BIGINT) AS run, min("start") AS first, max("end") AS last, count(*) AS n FROM r GROUP BY audio_id, speaker_id, run')
def _pauses(spark, d):
    return intervals.pause_runs(project.spans(spark, d), 3_600_000).groupBy("audio_id", "speaker_id", "run").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))


@_query("w02_positions", f'WITH {_PHONES}, a AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY "start", identifier) AS i FROM phones), b AS (SELECT *, min(i) FILTER (is_vowel) OVER w AS f, max(i) FILTER (is_vowel) OVER w AS l, count(*) FILTER (is_vowel) OVER w AS n FROM a WINDOW w AS (PARTITION BY parent_id)) SELECT identifier, CAST(CASE WHEN f IS NOT NULL AND l - f + 1 <> n THEN 9 WHEN f IS NULL OR i < f THEN 1 WHEN i <= l THEN 2 ELSE 3 END AS SMALLINT) AS position_code FROM b')
def _positions(spark, d):
    return positions.positions(project.phones(spark, d), "parent_id").select("identifier", "position_code")


@_query("w04_by_position", ORACLE_SQL["w02_positions"].replace("SELECT identifier, CAST(", "SELECT position_code, count(*) AS n FROM (SELECT CAST(") + ") GROUP BY position_code")
def _by_position(spark, d):
    return _positions(spark, d).groupBy("position_code").agg(F.count(F.lit(1)).alias("n"))


@_query("w05_first_appearance_all", f'WITH {_WORDS} SELECT label, min("start") AS first_start FROM words GROUP BY label')
def _first_seen_all(spark, d):
    return positions.first_appearance(project.words(spark, d), "label")


@_query("w06_placeholder", "WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN NULL ELSE l_linenumber * 100 END AS e FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(coalesce(e - 60, c) AS BIGINT) AS \"start\", CAST(coalesce(e, c) AS BIGINT) AS \"end\" FROM (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, e NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM s)")
def _placeholder(spark, d):
    rows = project.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("phrase_id"), "l_linenumber", F.when(F.col("l_discount") <= 0.05, F.col("l_linenumber").cast("long") * 100).alias("end"))
    rows = rows.withColumn("start", F.col("end") - 60).withColumn("phrase_start", F.lit(0).cast("long")).withColumn("idx", F.struct("l_linenumber", "end"))
    return intervals.placeholders(rows).select(F.col("phrase_id").alias("l_orderkey"), "l_linenumber", "start", "end")


@_query("w07_islands", f'WITH {_SPANS}, a AS (SELECT audio_id, "start" AS f, "end" AS l, max("end") OVER (PARTITION BY audio_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans), b AS (SELECT *, sum(CASE WHEN m IS NULL OR f > m + 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT audio_id, min(f) AS first, max(l) AS last, count(*) AS n FROM b GROUP BY audio_id, k')
def _islands(spark, d):
    rows = project.spans(spark, d).select("audio_id", F.col("start").alias("first"), F.col("end").alias("last"))
    return intervals.islands(rows, ["audio_id"], 60_000)


@_query("w08_tail", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def _tail(spark, d):
    return intervals.tail(project.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


# text
_MAPPING = {"th": "θ", "sh": "ʃ", "ng": "ŋ", "a": "ɑ", "e": "ɛ", "ea": "iː"}
_CASES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, 'th', 'θ', 'g'), 'sh', 'ʃ', 'g'), 'ng', 'ŋ', 'g'), 'ea', '1', 'g'), 'a', 'ɑ', 'g'), 'e', 'ɛ', 'g')"


@_query("t06_symbols_all", f"WITH {_WORDS} SELECT DISTINCT label, replace({_CASES.replace("'1'", "chr(57344)")}, chr(57344), 'iː') AS ipa FROM words")
def _symbols_all(spark, d):
    labels = project.words(spark, d).select("label").distinct()
    return labels.select("label", phonology.map_symbols(F.col("label"), _MAPPING)[0].alias("ipa"))


@_query("t07_clean", f"WITH {_WORDS}, u AS (SELECT DISTINCT label, trim(label) AS raw FROM words), b AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '^!', ''), '[.?,*]|\\*[a-z]+', '', 'g')) AS body FROM u) SELECT label, CASE WHEN raw = '_' THEN raw WHEN body = '' THEN raw WHEN starts_with(raw, '!') THEN '!' || body ELSE body END AS cleaned FROM b")
def _clean(spark, d):
    return project.words(spark, d).select("label").distinct().select("label", columns.clean_label(F.col("label")).alias("cleaned"))


@_query("t12_mismatch", "SELECT doc_id FROM documents WHERE n_chars IS DISTINCT FROM length(text)")
def _mismatch(spark, d):
    return project.table(spark, d, "documents").where(~F.col("n_chars").eqNullSafe(F.length("text"))).select("doc_id")


@_query("t12_label_repair", f"WITH {_WORDS} SELECT identifier, label || 'x' AS label, label AS repaired FROM words WHERE identifier % 11 = 0")
def _label_repair(spark, d):
    """Labels that aren't their phones' labels joined, and what they should be."""
    words = project.words(spark, d).withColumn("label", F.when(F.col("identifier") % 11 == 0, F.concat("label", F.lit("x"))).otherwise(F.col("label")))
    return resyllabify.label_mismatches(words, project.phones(spark, d))


@_query("j06_inherited_stress", f"WITH {_PHONES} SELECT f.identifier, CASE length(w.label) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'primary' ELSE NULL END AS stress FROM phones f LEFT JOIN words w ON w.identifier = f.parent_id")
def _stress(spark, d):
    """Phones take the stress of what they belong to."""
    words = project.words(spark, d).withColumn("stress_code", F.when(F.length("label") % 3 == 2, F.lit(None)).otherwise(F.length("label") % 3).cast("short"))
    phones = project.phones(spark, d).withColumn("stress_code", F.lit(None).cast("short"))
    return hierarchy.inherited(phones, words, "stress_code").select("identifier", columns.decode(F.col("stress_code"), {0: "none", 1: "primary"}).alias("stress"))


@_query("t14_speakers", "SELECT c_name AS name, CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE 2000 - (1900 + c_nationkey) END AS SMALLINT) AS age, CAST(CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 9 END AS SMALLINT) AS gender_code, CAST(NULL AS VARCHAR) AS dialect, c_mktsegment AS region FROM customer")
def _speaker_rows(spark, d):
    c = project.table(spark, d, "customer")
    sex = F.when(F.col("c_custkey") % 3 == 0, "sex1").when(F.col("c_custkey") % 3 == 1, "sex2").otherwise("x")
    born = F.when(F.col("c_acctbal") < 0, "unknown").otherwise((1900 + F.col("c_nationkey")).cast("string"))
    return columns.speaker_rows(c.select(F.col("c_name").alias("ID"), sex.alias("sex"), born.alias("birthYear"), F.col("c_mktsegment").alias("resRegion")))


@_query("t15_path", "SELECT page_id, string_split(url, '/')[-2] AS dialect FROM pages")
def _path(spark, d):
    return project.table(spark, d, "pages").select("page_id", columns.audio_dialect(F.col("url")).alias("dialect"))


@_query("t16_explode", f"WITH {_WORDS} SELECT identifier, format('{{}}_{{:06d}}_{{:06d}}', audio_id, \"start\", \"end\") AS filename FROM phrases")
def _utterances(spark, d):
    return project.phrases(spark, d).select("identifier", F.format_string("%d_%06d_%06d", "audio_id", "start", "end").alias("filename"))


# fixed values: each symbol's sonority
_SONORITY = """v(symbol, son) AS (SELECT unnest(string_split(s, ' ')), son FROM (VALUES ('p b t d k g ɡ ʔ t͡ʃ d͡ʒ', 1), ('f v θ ð s z ʃ ʒ ç x ɣ h', 2), ('m n ɲ ŋ', 3), ('r ʀ ɾ l', 4), ('ʋ w ɹ j', 5),
('i iː y yː ɨ ʉ u uː ɪ ʏ ʊ e eː ø øː o oː ə ɛ ɛː œ œ̃ œː ʌ ɔ ɔː æ æ̃ ɐ a aː ɑ ɑ̃ː ɒ ɒː ɒ̃ː ɛi œy ɑu ui', 6)) t(s, son))"""
_PAIR = "(s2 < s1 AND ((s2 <= 2 AND s1 >= 4) OR l2 || l1 IN ('kn', 'ɡn', 'fn')))"
_SYLLABLES = f"""WITH {_PHONES},
{_SONORITY},
q AS (SELECT parent_id, identifier, "start", "end", lower(label) AS label, son FROM phones LEFT JOIN v ON symbol = lower(label)),
a AS (SELECT *, lag(label, 1) OVER w AS l1, lag(label, 2) OVER w AS l2, lag(label, 3) OVER w AS l3, lag(son, 1) OVER w AS s1, lag(son, 2) OVER w AS s2, lag(son, 3) OVER w AS s3,
             count(*) FILTER (son = 6) OVER (PARTITION BY parent_id ORDER BY "start", "end", identifier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             count(*) FILTER (son IS NULL) OVER (PARTITION BY parent_id) = 0 AND count(*) FILTER (son = 6) OVER (PARTITION BY parent_id) > 0 AS ok
      FROM q WINDOW w AS (PARTITION BY parent_id ORDER BY "start", "end", identifier)),
o AS (SELECT *, CASE WHEN son = 6 AND before > 0 THEN CASE
        WHEN s1 < 6 AND s2 < 6 AND s3 < 6 AND l1 <> 'ŋ' AND l2 <> 'ŋ' AND l3 <> 'ŋ'
             AND CASE WHEN l3 IN ('s', 'ʃ') AND l2 <> 'h' THEN {_PAIR} ELSE s3 < s2 AND s2 < s1 AND s3 <= 2 AND s2 >= 4 END THEN 3
        WHEN s1 < 6 AND s2 < 6 AND l1 <> 'ŋ' AND l2 <> 'ŋ' AND ((l2 IN ('s', 'ʃ') AND l1 <> 'h') OR {_PAIR}) THEN 2
        WHEN s1 < 6 AND l1 <> 'ŋ' THEN 1 ELSE 0 END END AS onset FROM a),
b AS (SELECT *, coalesce(onset = 0, false) OR coalesce(lead(onset, 1) OVER w = 1, false) OR coalesce(lead(onset, 2) OVER w = 2, false) OR coalesce(lead(onset, 3) OVER w = 3, false) AS starts
      FROM o WINDOW w AS (PARTITION BY parent_id ORDER BY "start", "end", identifier)),
c AS (SELECT *, CASE WHEN ok THEN CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY parent_id ORDER BY "start", "end", identifier ROWS UNBOUNDED PRECEDING) AS INT) END AS syllable FROM b)
SELECT parent_id, syllable, CASE WHEN syllable IS NOT NULL THEN string_agg(label, ' ' ORDER BY "start", "end", identifier) END AS label,
       CASE WHEN syllable IS NOT NULL THEN min("start") END AS "start", CASE WHEN syllable IS NOT NULL THEN max("end") END AS "end"
FROM c GROUP BY parent_id, syllable"""


@_query("t01_syllables", _SYLLABLES)
def _syllables(spark, d):
    """Syllables of all words; a word with an unknown symbol or no vowel has a null one."""
    phones = project.phones(spark, d).withColumn("label", F.lower("label"))
    return phonology.syllable_groups(phones, "parent_id").select("parent_id", "syllable", "label", "start", "end")


@_query("t03_phrases")
def _syllable_phrases(spark, d):
    """Phrases rebuilt from the phones of each turn, without the characters that are no symbols; a pause is where several were left out."""
    phones = project.phones(spark, d).withColumn("label", F.lower("label")).withColumn("word_id", F.col("parent_id")).where(phonology.phone_type(F.col("label")).isin("vowel", "consonant"))
    return resyllabify.syllabify_phones(phones, project.words(spark, d), "phrase_id", 4)


# writes and sets, computed as result sets
def _halves(spark, d):
    orders = project.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))


@_query("k03_dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _dup_keys(spark, d):
    return writes.duplicate_keys(project.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _levels(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The four levels; there are no syllables."""
    phones = project.phones(spark, d)
    return {"phrases": project.phrases(spark, d), "words": project.words(spark, d), "syllables": phones.limit(0), "phones": phones}


@_query("k07_cascade", f"WITH {_PHONES} SELECT 'phrases' AS level, count(*) AS n FROM phrases WHERE speaker_id <> 'system' UNION ALL SELECT 'words', count(*) FROM words WHERE speaker_id <> 'system' UNION ALL SELECT 'phones', count(*) FROM phones WHERE speaker_id <> 'system' UNION ALL SELECT 'syllables', 0")
def _cascade(spark, d):
    tables = _levels(spark, d)
    left = writes.delete_phrases(tables, tables["phrases"].where("speaker_id = 'system'"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query("k06_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def _delete(spark, d):
    orders = project.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return writes.delete(orders, orders.where("o_orderkey % 3 = 0"), ["o_orderkey"], missing_ok=False)


@_query("k08_rekey", f"WITH {_WORDS} SELECT 'phrases' AS level, CASE WHEN identifier % 5 = 0 THEN -identifier ELSE identifier END AS id, n_words AS value FROM phrases UNION ALL SELECT 'words', CASE WHEN parent_id % 5 = 0 THEN -parent_id ELSE parent_id END, identifier FROM words")
def _rekey(spark, d):
    tables = {"phrases": project.phrases(spark, d), "words": project.words(spark, d)}
    some = tables["phrases"].where("identifier % 5 = 0").select(F.col("identifier").alias("old"), (-F.col("identifier")).alias("new"))
    made = writes.rekey(tables, "phrases", some)
    words = made["words"].select(F.lit("words").alias("level"), F.col("parent_id").alias("id"), F.col("identifier").alias("value"))
    return made["phrases"].select(F.lit("phrases").alias("level"), F.col("identifier").alias("id"), F.col("n_words").alias("value")).unionByName(words)


@_query("k12_append", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 2 = 0")
def _append(spark, d):
    old, rows = _halves(spark, d)
    return writes.append(old, rows, ["o_orderkey"])


@_query("k13_add_missing", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'N' END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def _add_missing(spark, d):
    old, rows = _halves(spark, d)
    return writes.add_missing(old, rows, ["o_orderkey"])


@_query("k14_replace", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def _replace(spark, d):
    old, rows = _halves(spark, d)
    return writes.replace(old, writes.existing(rows, old, ["o_orderkey"]), ["o_orderkey"])


@_query("k15_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def _upsert(spark, d):
    old, rows = _halves(spark, d)
    return writes.upsert(old, rows, ["o_orderkey"])


@_query("k16_split", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS there FROM orders WHERE o_orderkey % 2 = 0")
def _split(spark, d):
    old, rows = _halves(spark, d)
    key = ["o_orderkey"]
    return writes.existing(rows, old, key).select("o_orderkey", F.lit(True).alias("there")).unionByName(writes.new(rows, old, key).select("o_orderkey", F.lit(False).alias("there")))


@_query("k18_report", "WITH c AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type), f AS (SELECT event_type AS kind, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 20) SELECT kind, n, list(event_id ORDER BY event_id) AS samples FROM c JOIN f USING (kind) GROUP BY kind, n")
def _report(spark, d):
    return writes.report(project.table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id"), "kind", "event_id")


@_query("u01_sets", "SELECT k, 'both' AS part FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier) UNION ALL SELECT k, 'left' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier)")
def _sets(spark, d):
    c, s = project.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), project.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return c.intersect(s).withColumn("part", F.lit("both")).unionByName(c.subtract(s).withColumn("part", F.lit("left")))


@_query("u03_multiset", "SELECT l_quantity AS q, 'left' AS side FROM (SELECT l_quantity FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT l_quantity, 'right' FROM (SELECT l_quantity FROM lineitem WHERE l_linenumber = 2 EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_linenumber = 1)")
def _multiset(spark, d):
    rows = project.table(spark, d, "lineitem")
    return writes.multiset_difference(rows.where("l_linenumber = 1").select(F.col("l_quantity").alias("q")), rows.where("l_linenumber = 2").select(F.col("l_quantity").alias("q")))


@_query("u04_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _missing(spark, d):
    return writes.new(project.table(spark, d, "customer").select("c_custkey"), project.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# audio
_GRID = "WITH s AS (SELECT event_id, CAST(trunc(value / 100 * 1000) AS BIGINT) AS a, CAST(trunc(value / 100 * 1000) AS BIGINT) + 100 AS b, 16000 AS r FROM events), f AS (SELECT event_id, greatest(0, CAST(floor((floor(a * r / 1000) - 400) / 160) AS BIGINT) + 1) AS first, least(CAST(floor((160000 - 400) / 160) AS BIGINT), CAST(floor((floor(b * r / 1000) - 1) / 160) AS BIGINT)) AS last FROM s)"


def _grid(spark, d):
    start = columns.ms_truncated(F.col("value") / 100)
    e = project.table(spark, d, "events").select("event_id", start.alias("start"), (start + 100).alias("end"))
    first, last = audio.frame_range(F.col("start"), F.col("end"), F.lit(10_000), F.lit(16_000))
    return e.select("event_id", first.alias("first"), last.alias("last"))


@_query("m01_grid", _GRID + " SELECT event_id, first, last FROM f")
def _m01(spark, d):
    return _grid(spark, d)


@_query("m02_frames", _GRID + " SELECT event_id, frame FROM (SELECT event_id, unnest(range(first, last + 1)) AS frame FROM f) WHERE frame % 2 = 0")
def _m02(spark, d):
    return _grid(spark, d).select("event_id", F.explode(audio.frame_indices(F.col("first"), F.col("last"), even_only=True)).alias("frame"))


@_query("m09_collar", "SELECT event_id, greatest(CAST(trunc(value * 1000) AS BIGINT) - 5000, 0) AS low, least(CAST(trunc(value * 1000) AS BIGINT) + 5000, 60000) AS high FROM events")
def _m09(spark, d):
    at = columns.ms_truncated(F.col("value"))
    low, high = columns.collar(at, at, 5000, F.lit(60_000))
    return project.table(spark, d, "events").select("event_id", low.alias("low"), high.alias("high"))


# imports, replacement and generated data
@_query("k05_replace_trees", f"WITH {_PHONES} SELECT 'words' AS level, identifier, label FROM words WHERE parent_id % 7 <> 0 UNION ALL SELECT 'words', -identifier, 'staged' FROM phrases WHERE identifier % 7 = 0 UNION ALL SELECT 'phones', identifier, label FROM phones WHERE phrase_id % 7 <> 0")
def _trees(spark, d):
    """Phrases with all below them give way to staged ones of one word each."""
    tables = _levels(spark, d)
    staged = {"phrases": tables["phrases"].where("identifier % 7 = 0").withColumn("n_words", F.lit(1).cast("long"))}
    staged["words"] = staged["phrases"].select("audio_id", "speaker_id", "start", "end", (-F.col("identifier")).alias("identifier"), F.col("identifier").alias("parent_id"), F.lit("staged").alias("label"))
    staged |= {level: tables[level].limit(0) for level in ("syllables", "phones")}
    whole = writes.replace_trees(tables, staged)
    return whole["words"].select(F.lit("words").alias("level"), "identifier", "label").unionByName(whole["phones"].select(F.lit("phones").alias("level"), "identifier", "label"))


@_query("k11_links", f"WITH {_SPANS} SELECT speaker_id, audio_id FROM spans GROUP BY speaker_id, audio_id")
def _links(spark, d):
    return project.spans(spark, d).select("speaker_id", "audio_id").dropDuplicates(["speaker_id", "audio_id"])


@_query("k17_resume", "WITH s AS (SELECT c_custkey AS audio_id, c_custkey IN (SELECT o_custkey FROM orders) AS there FROM customer), r AS (SELECT *, CASE WHEN there THEN row_number() OVER (PARTITION BY there ORDER BY audio_id DESC) END AS k FROM s) SELECT audio_id, CASE WHEN NOT there THEN 'import' WHEN k <= 3 THEN 'audit' ELSE 'skip' END AS action FROM r")
def _resume(spark, d):
    sources = project.table(spark, d, "customer").select(F.col("c_custkey").alias("audio_id"))
    return resume.plan(sources, project.table(spark, d, "orders").select(F.col("o_custkey").alias("audio_id")), [F.col("audio_id")])


@_query("k17_audit", f'WITH {_SPANS}, a AS (SELECT audio_id, speaker_id, "start", "end", \'x\' AS label FROM spans), b AS (SELECT audio_id, speaker_id, "start", "end", CASE WHEN identifier % 100 = 0 THEN \'y\' ELSE \'x\' END AS label FROM spans) SELECT DISTINCT audio_id FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))')
def _audit(spark, d):
    s = project.spans(spark, d)
    stored = s.withColumn("label", F.lit("x"))
    return resume.differing(stored, stored.withColumn("label", F.when(F.col("identifier") % 100 == 0, "y").otherwise(F.col("label"))))


@_query("u02_symdiff", "WITH a AS (SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS file, n_name AS speaker FROM nation WHERE n_nationkey % 5 <> 0 AND n_name <> 'COMMENT'), b AS (SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS file, n_name AS speaker FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000) SELECT *, 'ort' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'awd' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _symdiff(spark, d):
    """Nations of a region that aren't blank, against those of its rich customers."""
    nations = project.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("file"), F.col("n_name").alias("tier"))
    rich = project.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    ort = nations.withColumn("mark", F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise("x"))
    return awd.speaker_tier_differences(ort, nations.join(rich, "n_nationkey"))


@_query("u05_dedupe_keys", "SELECT DISTINCT o_custkey FROM orders")
def _dedupe(spark, d):
    return project.table(spark, d, "orders").select("o_custkey").distinct()


@_query("v03_duplicate_identity", f'WITH {_SPANS} SELECT audio_id, speaker_id, "start", count(*) AS count FROM spans GROUP BY audio_id, speaker_id, "start" HAVING count(*) > 1')
def _identity(spark, d):
    return writes.duplicate_keys(project.spans(spark, d), ["audio_id", "speaker_id", "start"])


@_query("h10_siblings", f"WITH {_WORDS} SELECT p.identifier, count(*) - 1 AS n FROM phrases p JOIN phrases o ON o.audio_id = p.audio_id GROUP BY p.identifier")
def _siblings(spark, d):
    p = project.phrases(spark, d)
    per = p.groupBy("audio_id").agg((F.count(F.lit(1)) - 1).alias("n"))
    return p.join(per, "audio_id").select("identifier", "n")


@_query("q03_get_or_none", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17")
def _get(spark, d):
    orders = _q(spark, d, "orders")
    row, none = orders.get_or_none(o_orderkey=17), orders.get_or_none(o_orderkey=-1)
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"]) for r in (row, none) if r], "o_orderkey long, o_totalprice double")


@_query("s16_sample", f"WITH {_WORDS} SELECT greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) AS n, greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) AS n_distinct FROM phrases")
def _sample(spark, d):
    """An exact share, drawn by hash; the rows are ours, so their number is compared."""
    phrases = project.phrases(spark, d)
    drawn = sample_rows(phrases, max(1, int(phrases.count() * 0.25)))
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("identifier").alias("n_distinct"))


_SAID = ", ".join(f"({k}, '{p}')" for k, p in enumerate(synthetic.PHRASES))


@_query("s26_synthetic", f"SELECT c_custkey AS speaker_id, c_custkey * 1000 + p.k AS identifier, CAST(p.k * 8000 AS BIGINT) AS \"start\", p.label FROM customer, (VALUES {_SAID}) p(k, label)")
def _synthetic(spark, d):
    """Every customer says all phrases."""
    return synthetic.generate(spark, project.table(spark, d, "customer").select("c_custkey"))["phrases"].select("speaker_id", "identifier", "start", "label")


_CURRENT = """k AS (SELECT parent_id, identifier, coalesce(count(*) FILTER (is_vowel) OVER (PARTITION BY parent_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM phones),
m AS (SELECT c.parent_id, count(DISTINCT cut) AS n_old, count(DISTINCT syllable) AS n_new, count(DISTINCT cut * 1000 + coalesce(syllable, -1)) AS n_both, bool_and(ok) AS ok FROM c JOIN k USING (parent_id, identifier) GROUP BY c.parent_id),
r AS (SELECT ok AND n_old = n_both AND n_new = n_both AS ok, ok AND n_old = n_new AND n_both > n_old AS applied, ok AND n_old <> n_new AS count_mismatch FROM m)
SELECT ok, applied, count_mismatch, count(*) AS n FROM r GROUP BY ALL"""


@_query("t04_outcomes", _SYLLABLES[: _SYLLABLES.rindex("\nSELECT")] + ",\n" + _CURRENT)
def _outcomes(spark, d):
    """Words cut after each vowel, compared with maximal onsets."""
    phones = project.phones(spark, d).withColumn("label", F.lower("label")).withColumnRenamed("parent_id", "word_id")
    before = F.coalesce(F.sum(F.col("is_vowel").cast("int")).over(Window.partitionBy("audio_id", "word_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = resyllabify.outcomes(phones.withColumn("parent_id", F.col("word_id") * 100 + before))
    return found.groupBy("ok", "applied", "count_mismatch").agg(F.count(F.lit(1)).alias("n"))


_APPLIED = _CURRENT[: _CURRENT.index("r AS (")].rstrip().rstrip(",")


@_query("t05_reposition", _SYLLABLES[: _SYLLABLES.rindex("\nSELECT")] + ",\n" + _APPLIED + """
SELECT c.identifier, min(c."start") OVER (PARTITION BY c.parent_id, c.syllable) AS parent_start,
       CAST(CASE WHEN son = 6 THEN 2 WHEN c."start" < min(c."start") FILTER (son = 6) OVER (PARTITION BY c.parent_id, c.syllable) THEN 1 ELSE 3 END AS SMALLINT) AS position_code
FROM c JOIN m ON m.parent_id = c.parent_id WHERE m.ok AND n_old = n_new AND n_both > n_old""")
def _reposition(spark, d):
    """Words cut after each vowel, rewritten with maximal onsets: where their phones then are."""
    phones = project.phones(spark, d).withColumn("label", F.lower("label"))
    before = F.coalesce(F.sum(F.col("is_vowel").cast("int")).over(Window.partitionBy("audio_id", "parent_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    phones = phones.withColumns({"_word": F.col("parent_id"), "parent_id": F.col("parent_id") * 100 + before})
    # a corpus' phones are stored; here they are made of texts, once, as the operator reads them several times
    phones = materialise(phones, "phones").withColumns({"parent_start": F.lit(None).cast("long"), "position_code": F.lit(9).cast("short")})
    syllables = phones.groupBy("audio_id", F.col("parent_id").alias("identifier"), F.col("_word").alias("parent_id"), "speaker_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.lit("").alias("label")).drop("audio_id")
    moved = resyllabify.resyllabify(project.words(spark, d), syllables, phones.drop("_word"))[2]
    return moved.where("parent_start IS NOT NULL").select("identifier", "parent_start", "position_code")


@_query("t17_status", """
SELECT o_orderkey, CASE WHEN f.k IS NULL THEN 'no_textgrid' WHEN s_suppkey IS NULL OR c_custkey IS NULL THEN 'error' WHEN o_totalprice > 200000 THEN 'skipped' ELSE 'added' END AS status,
       CASE WHEN f.k IS NULL THEN NULL WHEN s_suppkey IS NULL AND c_custkey IS NULL THEN 'no such speaker and audio' WHEN s_suppkey IS NULL THEN 'no such speaker' WHEN c_custkey IS NULL THEN 'no such audio' END AS detail,
       s_suppkey AS speaker_id, c_custkey AS audio_id
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) f ON f.k = o_orderkey
LEFT JOIN supplier ON s_suppkey = o_orderkey % 97 AND s_acctbal > 0 LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def _status(spark, d):
    """Orders as records of utterances: their items are the files, suppliers the speakers and customers the recordings."""
    of = lambda name: project.table(spark, d, name)
    text = lambda c: F.col(c).cast("string")
    records = of("orders").select("o_orderkey", text("o_orderkey").alias("output_filename"), text("o_custkey").alias("audio_filename"), (F.col("o_orderkey") % 97).cast("string").alias("tier_name"))
    files = of("lineitem").where("l_quantity > 40").select(text("l_orderkey").alias("path"))
    speakers = of("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("identifier"), text("s_suppkey").alias("name"))
    audios = of("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("identifier"), text("c_custkey").alias("filename"))
    loaded = of("orders").where("o_totalprice > 200000").select(text("o_orderkey").alias("filename"))
    return webmaus.load_status(records, files, speakers, audios, loaded).select("o_orderkey", "status", "detail", "speaker_id", "audio_id")


@_query("t16_records", r"""
WITH t AS (SELECT conv_id, role, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\*[a-zA-Z]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}''’-]+', ' ', 'g')) AS said FROM conversations),
u AS (SELECT *, array_to_string(list_filter(string_split_regex(said, ' +'), lambda w: w NOT IN ('xxx', 'ggg', 'Xxx', 'mmm') AND regexp_matches(w, '[\p{L}\p{N}]')), ' ') AS text FROM t)
SELECT CAST(conv_id AS VARCHAR) AS recording, role AS tier_name, text, '/out/' || role || '/' || conv_id || '_s-' || turn * 1500 || '-e-' || (turn * 1500 + 1250) || '-ms.TextGrid' AS output_filename FROM u WHERE text <> ''""")
def _records(spark, d):
    """Turns as intervals of a speaker's tier."""
    turns = project.table(spark, d, "conversations")
    at = F.col("turn") * 1.5
    intervals = turns.select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("tier"), F.lit(0).alias("tier_idx"), F.col("turn").cast("int").alias("idx"), at.alias("xmin"), (at + 1.25).alias("xmax"), F.col("text").alias("mark"))
    audios = turns.select(F.col("conv_id").cast("string").alias("file")).distinct().select("file", F.concat(F.lit("/data/comp-a/nl/"), "file", F.lit(".wav")).alias("audio_filename"), F.lit("nl").alias("language"))
    return utterances.utterances(intervals, audios, "/out").select("recording", "tier_name", "text", "output_filename")


_FRAMES = """e AS (SELECT vec_id * 1000 AS id, embedding AS v FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id * 10000000, embedding FROM embeddings WHERE vec_id % 2 = 0),
s AS (SELECT w.identifier, CASE WHEN o.id IS NOT NULL THEN 0 WHEN a.id IS NOT NULL THEN 1 END AS depth, coalesce(o.id, a.id) AS source, coalesce(o.v, a.v) AS v,
             CASE WHEN o.id IS NOT NULL THEN 0 ELSE CAST(floor((w."start" - p."start") * len(a.v) / (p."end" - p."start")) AS INT) END AS first,
             CASE WHEN o.id IS NOT NULL THEN len(o.v) ELSE CAST(ceil((w."end" - p."start") * len(a.v) / (p."end" - p."start")) AS INT) END AS last
      FROM words w LEFT JOIN phrases p ON p.identifier = w.parent_id LEFT JOIN e o ON o.id = w.identifier LEFT JOIN e a ON a.id = p.identifier)"""


@_query("h22_frames", f"WITH {_WORDS}, {_FRAMES} SELECT identifier, depth, source, array_to_string(list_transform(v[first + 1:greatest(last, first + 1)], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS frames FROM s")
def _frames(spark, d):
    """Words with vectors of their own, or with the part of their turn's vector that they cover."""
    vectors = project.table(spark, d, "embeddings")
    framed = F.transform("embedding", lambda x: F.array(x)).alias("frames")
    known = vectors.where("vec_id % 3 <> 0").select((F.col("vec_id") * 1000).alias("identifier"), framed).unionByName(vectors.where("vec_id % 2 = 0").select((F.col("vec_id") * 10000000).alias("identifier"), framed))
    out = hierarchy.segment_embeddings(project.words(spark, d), {"phrases": project.phrases(spark, d)}, known, missing="null")
    return out.select("identifier", "depth", "source", F.array_join(F.transform(F.flatten("frames"), lambda x: F.round(x.cast("double") * 1000000).cast("long")), ",").alias("frames"))


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """Pages as recordings (audio_id, content, duration, sample_rate): their bytes are samples of 8 bits, 8000 a second."""
    little = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    n = F.octet_length(body)
    head = bytes.fromhex("57415645666d74201000000001000100401f0000401f00000100080064617461")
    content = F.concat(F.lit(b"RIFF"), little(n + 36), F.lit(head), little(n), body)
    return project.table(spark, d, "pages").select(F.col("page_id").alias("audio_id"), content.alias("content"), F.floor(n / 8).alias("duration"), F.lit(8000).cast("long").alias("sample_rate"))


@_query("m03_mfcc")
def _mfcc(spark, d):
    """Matrices of all recordings."""
    return audio.mfcc_frames(_recordings(spark, d))


@_query("m05_batch", """
WITH a AS (SELECT page_id, strlen(coalesce(html, '')) // 8 AS duration FROM pages),
s AS (SELECT page_id * 2 AS identifier, 0 AS s, duration AS e, duration FROM a UNION ALL SELECT page_id * 2 + 1, duration // 4, duration // 2, duration FROM a),
r AS (SELECT identifier, greatest(0, CAST(floor((s * 8 - 200) / 80) AS BIGINT) + 1) AS first, least(CAST(floor((duration * 8 - 200) / 80) AS BIGINT), CAST(floor((e * 8 - 1) / 80) AS BIGINT)) AS last FROM s WHERE e > s),
f AS (SELECT identifier, unnest(range(first, last + 1)) AS frame FROM r)
SELECT identifier, count(*) AS n, min(frame) AS first, max(frame) AS last, count(*) * 39 AS coefficients FROM f WHERE frame % 2 = 0 GROUP BY identifier""")
def _batch(spark, d):
    """Frames that two overlapping segments of each recording get: all of it, and its second quarter."""
    audios = _recordings(spark, d)
    whole = audios.select((F.col("audio_id") * 2).alias("identifier"), "audio_id", F.lit(0).cast("long").alias("start"), F.col("duration").alias("end"), "duration", "sample_rate")
    part = whole.withColumns({"identifier": F.col("identifier") + 1, "start": F.floor(F.col("duration") / 4), "end": F.floor(F.col("duration") / 2)})
    frames = audio.batch_mfcc(whole.unionByName(part).where("end > start"), audios)
    return frames.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.sum(F.size("mfcc")).alias("coefficients"))


@_query("v01_violations", f"""WITH {_WORDS},
p AS (SELECT audio_id, speaker_id, identifier, "start", "end" FROM phrases UNION ALL SELECT audio_id, speaker_id, identifier + 1000000000, "start" + 1, "end" FROM phrases WHERE identifier % 5 = 0 AND "end" - "start" > 2
      UNION ALL SELECT audio_id, speaker_id, identifier, "start", "end" FROM phrases WHERE identifier % 11 = 0),
r AS (SELECT *, "start" < max("end") OVER (PARTITION BY audio_id, speaker_id ORDER BY "start", "end", identifier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clash FROM p),
w AS (SELECT w.*, CASE WHEN w.identifier % 13 = 0 THEN 'other' ELSE w.speaker_id END AS speaker, CASE WHEN w.identifier % 17 = 0 THEN NULL ELSE w.label END AS l FROM words w)
SELECT * FROM (
SELECT 'phrases of one speaker overlap' AS kind, count(*) AS n FROM r WHERE clash
UNION ALL SELECT 'ids of phrases occur twice', count(*) FROM (SELECT count(*) OVER (PARTITION BY identifier) AS c FROM p) WHERE c > 1
UNION ALL SELECT 'phrases occur twice', count(*) FROM (SELECT count(*) OVER (PARTITION BY audio_id, speaker_id, "start") AS c FROM p) WHERE c > 1
UNION ALL SELECT 'words and their phrase differ in speaker or audio', count(*) FROM w JOIN (SELECT DISTINCT identifier, speaker_id FROM p) p ON p.identifier = w.parent_id WHERE w.speaker IS DISTINCT FROM p.speaker_id
UNION ALL SELECT 'words without id, audio, times or parent_id', count(*) FROM w WHERE identifier % 17 = 0) WHERE n > 0""")
def _violations(spark, d):
    """Turns of which some are repeated or overlapped, and words of which some have another speaker or lack their start."""
    tables = _levels(spark, d)
    base = ["audio_id", "speaker_id", "identifier", "start", "end"]
    phrases = tables["phrases"].select(*base)
    late = phrases.where("identifier % 5 = 0 AND end - start > 2").select("audio_id", "speaker_id", F.col("identifier") + 1000000000, F.col("start") + 1, "end")
    phrases = phrases.union(late).union(phrases.where("identifier % 11 = 0"))
    ident = F.col("identifier")
    words = tables["words"].withColumns({"speaker_id": F.when(ident % 13 == 0, "other").otherwise(F.col("speaker_id")), "start": F.when(ident % 17 != 0, F.col("start"))})
    none = {name: words.limit(0).withColumn("phrase_id", F.lit(None).cast("long")) for name in ("syllables", "phones")}
    return writes.tree_violations({"phrases": phrases, "words": words} | none).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("j09_gender", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'female' WHEN 2 THEN 'male' END AS gender FROM supplier")
def _gender(spark, d):
    return project.table(spark, d, "supplier").select("s_suppkey", columns.gender(F.col("s_suppkey") % 4).alias("gender"))


@_query("j12_present", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 100000 THEN 'price' END, CASE WHEN o_orderstatus = 'F' THEN 'status' END, 'key') AS present FROM orders")
def _present(spark, d):
    """Which attributes of an order have a value."""
    o = project.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderstatus") == "F", "F").alias("status"), F.col("o_orderkey").alias("key"))
    return o.select("o_orderkey", F.array_join(columns.present(o, ["price", "status", "key"]), ",").alias("present"))


@_query("j14_types", f"WITH {_PHONES}, {_FEATURES} SELECT CASE WHEN p.label = '(' THEN 'other' ELSE f.type END AS type, count(*) AS n FROM (SELECT CASE WHEN label = '.' THEN '(' ELSE lower(label) END AS label FROM phones) p LEFT JOIN f ON f.symbol = p.label GROUP BY ALL")
def _types(spark, d):
    """Letters as phones; full stops stand for what is in brackets."""
    label = F.when(F.col("label") == ".", "(.)").otherwise(F.lower("label"))
    return project.phones(spark, d).groupBy(phonology.phone_type(label).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@_query("m06_invalid", f"WITH {_SPANS} SELECT identifier FROM spans WHERE \"end\" - \"start\" <= 0 OR \"start\" % 1000000 < 1000 OR \"end\" - \"start\" > 50000 OR identifier % 10 = 0")
def _invalid(spark, d):
    """Events as segments of recordings that are too short for some, or whose length isn't known."""
    s = project.spans(spark, d)
    length = F.col("end") - F.col("start")
    # the recording begins a second after a segment that comes early, and ends after fifty seconds
    first = F.when(F.col("start") % 1000000 < 1000, -1).otherwise(0)
    segments = s.select("identifier", first.cast("long").alias("start"), (first + length).cast("long").alias("end"), F.when(F.col("identifier") % 10 != 0, 50000).cast("long").alias("duration"))
    return audio.invalid_spans(segments).select("identifier")


@_query("w03_assign", f"WITH {_PHONES}, {_SONORITY}, q AS (SELECT p.*, son FROM phones p JOIN v ON symbol = lower(label)), s AS (SELECT *, coalesce(count(*) FILTER (son = 6) OVER (PARTITION BY parent_id ORDER BY \"start\", identifier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM q) SELECT identifier, CAST(CASE WHEN son = 6 THEN 2 ELSE 1 END AS SMALLINT) AS position_code FROM s WHERE parent_id % 3 = 0")
def _assign(spark, d):
    """Positions below every third word: what stands before the vowel that ends a syllable is its onset, and so is a tail without a vowel."""
    phones = project.phones(spark, d).withColumn("label", F.lower("label")).where(phonology.phone_type(F.col("label")).isin("vowel", "consonant"))
    vowel = (phonology.phone_type(F.col("label")) == "vowel").cast("int")
    # by recording too, as they are dealt out already
    cut = F.coalesce(F.sum(vowel).over(Window.partitionBy("audio_id", "parent_id").orderBy("start", "identifier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    phones = phones.withColumns({"_word": F.col("parent_id"), "parent_id": F.col("parent_id") * 100 + cut})
    syllables = phones.select("audio_id", F.col("parent_id").alias("identifier"), F.col("_word").alias("parent_id")).distinct().drop("audio_id")
    tables = {"words": project.words(spark, d), "syllables": syllables, "phones": phones.drop("_word")}
    return resyllabify.assign_positions(tables, tables["words"].where("identifier % 3 = 0"), "words").select("identifier", "position_code")


@_query("h10_siblings_of", f"WITH {_WORDS} SELECT identifier FROM words w WHERE parent_id IN (SELECT parent_id FROM words WHERE label LIKE 'Th%') AND label NOT LIKE 'Th%'")
def _siblings_of(spark, d):
    words = project.words(spark, d)
    return hierarchy.siblings_of(words.where("label LIKE 'Th%'"), words).select("identifier")


@_query("h06_descendants_of", f"WITH {_PHONES} SELECT f.identifier FROM phones f JOIN words w ON w.identifier = f.parent_id WHERE length(w.label) > 8")
def _descendants_of(spark, d):
    """Letters as syllables of long words."""
    words = project.words(spark, d)
    return hierarchy.descendants(words.where(F.length("label") > 8), "words", {"syllables": project.phones(spark, d)}, "syllables").select("identifier")


@_query("s12_links", f"WITH {_SPANS}, l AS (SELECT DISTINCT speaker_id, audio_id FROM spans) SELECT speaker_id, audio_id FROM l WHERE audio_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _bridge(spark, d):
    """Speakers and recordings by their links, asked through the recordings' attributes."""
    links = writes.link_speakers(project.spans(spark, d).select("speaker_id", "audio_id").limit(0), project.spans(spark, d).select("speaker_id", "audio_id"))
    audios = project.table(spark, d, "customer").withColumnRenamed("c_custkey", "identifier")
    graph = {"audios": Entity("identifier", ("identifier",), {}, {"speaker_audio": ("speaker_audio", "audio_id")}), "speaker_audio": Entity("speaker_id", ("speaker_id", "audio_id"), {"audio": ("audios", "audio_id")})}
    return Query({"speaker_audio": links, "audios": audios}, graph, "speaker_audio").filter(audio__c_acctbal__gt=0).rows().select("speaker_id", "audio_id")


for _name in ("q05_order_by", "w05_first_appearance", "t06_symbols", "h12_overlap_bucketed"):
    _register(_name, ORACLE_SQL[f"{_name}_all"], QUERIES[f"{_name}_all"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of user turns that start with `th`, longest first."""
    words = project.words(spark, sf_dir).withColumn("duration", columns.duration())
    graph = {"words": Entity("identifier", ("audio_id", "start", "identifier"), {"phrase": ("phrases", "parent_id")}), "phrases": Entity("identifier", ("audio_id", "start", "identifier"), {}, {"words": ("words", "parent_id")})}
    query = Query({"words": words, "phrases": project.phrases(spark, sf_dir)}, graph, "words")
    return query.filter(label__istartswith="th", phrase__speaker_id="user").order_by("-duration").df()


_register("flagship", f"WITH {_WORDS} SELECT audio_id, speaker_id, \"start\", \"end\", identifier, parent_id, label, \"end\" - \"start\" AS duration FROM words WHERE starts_with(lower(label), 'th') AND speaker_id = 'user'", flagship)
