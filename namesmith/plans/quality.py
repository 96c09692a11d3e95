"""Validation over character rows that are broken on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators import corpus as C
from namesmith.operators import quality as Q
from namesmith.plans import Registry
from namesmith.plans import standins as S

AREA = Registry()


def every(n: int) -> Column:
    return F.col("seq") % n == n - 1


# The broken rows, each fault on its own stride.
S.VIEWS["chars_bad"] = """SELECT seq, dataset, printf('OHE-%05d', CASE WHEN seq % 50 = 49 THEN seq ELSE seq + 1 END) AS profile_id,
    CASE WHEN seq % 53 = 52 THEN hangul || hangul ELSE hangul END AS hangul, CASE WHEN seq % 43 = 42 THEN hanja || hanja ELSE hanja END AS hanja,
    CASE WHEN seq % 47 = 46 THEN 'U+0000' WHEN seq % 43 = 42 THEN unicode WHEN seq % 29 = 28 THEN 'U+4E00' ELSE unicode END AS unicode,
    CASE WHEN seq % 41 = 40 THEN '  ' ELSE sound_meaning END AS sound_meaning, CASE WHEN seq % 37 = 36 THEN 'n' ELSE CAST(strokes AS VARCHAR) END AS strokes,
    CASE WHEN seq % 31 = 30 THEN CASE sound_ohaeng WHEN '목' THEN '화' ELSE '목' END ELSE sound_ohaeng END AS sound_ohaeng, resource_ohaeng,
    CASE WHEN seq % 61 = 60 THEN 'maybe' WHEN is_person_name_hanja THEN 'true' ELSE 'false' END AS flag FROM chars"""


def chars_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return S.chars(spark, sf_dir).select(
        "seq", "dataset", F.format_string("OHE-%05d", F.when(every(50), c("seq")).otherwise(c("seq") + 1)).alias("profile_id"),
        F.when(every(53), F.concat("hangul", "hangul")).otherwise(c("hangul")).alias("hangul"),
        F.when(every(43), F.concat("hanja", "hanja")).otherwise(c("hanja")).alias("hanja"),
        F.when(every(47), "U+0000").when(every(43), c("unicode")).when(every(29), "U+4E00").otherwise(c("unicode")).alias("unicode"),
        F.when(every(41), "  ").otherwise(c("sound_meaning")).alias("sound_meaning"),
        F.when(every(37), "n").otherwise(c("strokes").cast("string")).alias("strokes"),
        F.when(every(31), F.when(c("sound_ohaeng") == "목", "화").otherwise("목")).otherwise(c("sound_ohaeng")).alias("sound_ohaeng"),
        "resource_ohaeng",
        F.when(every(61), "maybe").otherwise(c("is_person_name_hanja").cast("string")).alias("flag"),
    )


@AREA.add(
    "d1_source_row_issues",
    S.with_views("chars", "chars_bad", p="SELECT *, seq + 1 AS idx FROM chars_bad", k="SELECT * FROM p WHERE seq % 59 <> 58",
      body="""SELECT idx, profile_id, 'missing_required_fields' AS issue, 'strokes' AS detail FROM p WHERE seq % 59 = 58
      UNION ALL SELECT idx, profile_id, 'unexpected_fields', 'note' FROM k WHERE seq % 67 = 66
      UNION ALL SELECT idx, profile_id, 'duplicate_profile_id', '' FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY idx) AS rn FROM k) WHERE rn > 1
      UNION ALL SELECT idx, profile_id, 'profile_id_sequence_mismatch', printf('OHE-%05d', idx) FROM k WHERE profile_id <> printf('OHE-%05d', idx)
      UNION ALL SELECT idx, profile_id, 'hanja_must_be_single_character', hanja FROM k WHERE length(hanja) <> 1
      UNION ALL SELECT idx, profile_id, 'unicode_mismatch', printf('U+%04X', unicode(hanja)) FROM k WHERE length(hanja) = 1 AND unicode <> printf('U+%04X', unicode(hanja))
      UNION ALL SELECT idx, profile_id, 'hangul_must_be_single_syllable', hangul FROM k WHERE length(hangul) <> 1
      UNION ALL SELECT idx, profile_id, 'empty_sound_meaning', '' FROM k WHERE trim(sound_meaning) = ''
      UNION ALL SELECT idx, profile_id, 'strokes_must_be_integer', strokes FROM k WHERE strokes = 'n'"""),
)
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = chars_bad(spark, sf_dir)
    named = [F.col(f).alias(f) for f in Q.REQUIRED if f != "strokes"]
    note = F.when(every(67), F.lit("x"))
    text = F.to_json(F.struct(*named, note.alias("note")))
    strokes = F.when(every(59), "").otherwise(F.concat(F.lit(', "strokes" : '), F.when(F.col("strokes") == "n", '"n"').otherwise(F.col("strokes")), F.lit(" }")))
    raw = F.when(every(59), text).otherwise(F.concat(F.regexp_replace(text, r"\}$", ""), strokes))
    return Q.source_row_issues(Q.parsed_rows(bad.select("seq", raw.alias("raw")), "raw", "seq"), "seq")


def as_map(df: DataFrame, strokes: str = "strokes", flag: Column | None = None) -> Column:
    entries = [x for f in Q.REQUIRED for x in (F.lit(f), F.col(f if f != "strokes" else strokes).cast("string"))]
    if flag is not None:
        entries += [F.lit("is_person_name_hanja"), flag]
    return F.create_map(*entries)


_DOC = """'한자 ' || hanja || '(' || hangul || ')은 뜻이 ''' || sound_meaning || '''인 인명용 한자이다. 유니코드는 ' || unicode || ', 획수는 ' || strokes
    || '획, 발음오행은 ' || sound_ohaeng || ', 자원오행은 ' || resource_ohaeng || '이다.'"""


@AREA.add(
    "d2_document_issues",
    S.with_views("chars", d="SELECT *, seq + 1 AS idx, CASE WHEN seq % 50 = 49 THEN 'hanja_' || printf('OHE-%05d', seq) ELSE 'hanja_' || profile_id END AS did FROM chars",
      body="""SELECT CAST(0 AS BIGINT) AS idx, '' AS profile_id, 'document_count_mismatch' AS issue, (SELECT count(*) FROM chars) || ':' || (SELECT count(*) FROM chars) + (SELECT count(*) FROM supplier) AS detail
      UNION ALL SELECT idx, profile_id, 'id_mismatch', 'hanja_' || profile_id FROM d WHERE seq % 50 = 49
      UNION ALL SELECT idx, profile_id, 'duplicate_document_id', did FROM d WHERE seq % 50 = 49
      UNION ALL SELECT idx, profile_id, 'empty_document', '' FROM d WHERE seq % 41 = 40
      UNION ALL SELECT idx, profile_id, 'metadata_not_object', '' FROM d WHERE seq % 29 = 28
      UNION ALL SELECT idx, profile_id, 'metadata_value_mismatch', 'strokes' FROM d WHERE seq % 37 = 36 AND seq % 29 <> 28
      UNION ALL SELECT idx, profile_id, 'document_missing_required_terms', hanja || ',' || hangul || ',' || sound_meaning || ',' || unicode || ',' || strokes || ',' || sound_ohaeng || ',' || resource_ohaeng
        FROM d WHERE seq % 41 = 40 AND seq % 29 <> 28
      UNION ALL SELECT idx, profile_id, 'document_missing_required_terms', array_to_string(list_filter([hanja, hangul, sound_meaning, unicode, CAST(strokes AS VARCHAR), sound_ohaeng, resource_ohaeng],
        lambda t: NOT contains('x' || hanja, t)), ',') FROM d WHERE seq % 31 = 30 AND seq % 41 <> 40 AND seq % 29 <> 28"""),
)
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = S.chars(spark, sf_dir)
    built = C.character_text(F.lit("인명용"), F.col("sound_meaning"), F.col("strokes"), F.col("sound_ohaeng"))
    docs = chars.withColumn("_s", F.when(every(37), F.col("strokes") + 1).otherwise(F.col("strokes"))).select(
        "seq", F.when(every(50), F.format_string("hanja_OHE-%05d", "seq")).otherwise(F.concat(F.lit("hanja_"), "profile_id")).alias("id"),
        F.when(every(41), "").when(every(31), F.concat(F.lit("x"), "hanja")).otherwise(built).alias("document"),
        F.when(~every(29), as_map(chars, "_s")).alias("metadata"),
    )
    extra = S.surnames(spark, sf_dir).select(
        (F.col("surname_id") + F.lit(1 << 40)).alias("seq"), F.concat(F.lit("extra_"), "surname_id").alias("id"), F.col("hanja").alias("document"),
        F.create_map(F.lit("hanja"), F.col("hanja")).alias("metadata"),
    )
    return Q.document_issues(chars, docs.unionByName(extra), "seq")


S.VIEWS["records_bad"] = """SELECT seq, seq + 1 AS idx, CASE WHEN seq % 71 = 70 THEN NULL ELSE 'hanja_' || CASE WHEN seq % 73 = 72 THEN 'x' ELSE profile_id END END AS id,
    CASE WHEN seq % 41 = 40 THEN ' ' ELSE 'd' END AS document, seq % 79 = 78 AS no_meta, seq % 59 = 58 AS no_strokes, * EXCLUDE (seq) FROM chars_bad"""


def records_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = chars_bad(spark, sf_dir)
    full = F.map_concat(as_map(bad, flag=F.col("flag")), F.create_map(F.lit("collection"), F.col("dataset")))
    some = F.map_filter(full, lambda k, _v: k != "strokes")
    return bad.select(
        "seq", F.when(~every(71), F.concat(F.lit("hanja_"), F.when(every(73), "x").otherwise(F.col("profile_id")))).alias("id"),
        F.when(every(41), " ").otherwise("d").alias("document"),
        F.when(every(79), F.lit(None)).when(every(59), some).otherwise(full).alias("metadata"),
        (F.col("strokes") != "n").alias("strokes_is_int"),
    )


@AREA.add(
    "d3_index_issues",
    S.with_views("chars", "chars_bad", "records_bad", body="""SELECT idx, '' AS doc_id, 'missing_or_invalid_id' AS issue, '' AS detail FROM records_bad WHERE id IS NULL
      UNION ALL SELECT idx, id, 'duplicate_id', '' FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx) AS rn FROM records_bad WHERE id IS NOT NULL) WHERE rn > 1
      UNION ALL SELECT idx, coalesce(id, ''), 'missing_or_empty_document', '' FROM records_bad WHERE document = ' '
      UNION ALL SELECT idx, coalesce(id, ''), 'metadata_not_object', '' FROM records_bad WHERE no_meta
      UNION ALL SELECT idx, coalesce(id, ''), 'missing_metadata_fields', 'strokes' FROM records_bad WHERE no_strokes AND NOT no_meta
      UNION ALL SELECT idx, id, 'id_profile_id_mismatch', 'hanja_' || profile_id FROM records_bad WHERE id <> 'hanja_' || profile_id AND NOT no_meta"""),
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.index_issues(records_bad(spark, sf_dir), "seq")


S.VIEWS["graph_issues"] = """WITH w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx) AS rid FROM records_bad WHERE id IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY idx) AS rp FROM w WHERE NOT no_meta AND NOT no_strokes)
    SELECT idx, '' AS id, 'missing_or_invalid_id' AS issue, '' AS detail, false AS body FROM records_bad WHERE id IS NULL
    UNION ALL SELECT idx, id, 'duplicate_id', '', false FROM w WHERE rid > 1
    UNION ALL SELECT idx, id, 'missing_or_empty_document', '', false FROM w WHERE document = ' '
    UNION ALL SELECT idx, id, 'metadata_not_object', '', false FROM w WHERE no_meta
    UNION ALL SELECT idx, id, 'missing_metadata_fields', 'strokes', false FROM w WHERE NOT no_meta AND no_strokes
    UNION ALL SELECT idx, id, 'id_profile_id_mismatch', 'hanja_' || profile_id, true FROM f WHERE id <> 'hanja_' || profile_id
    UNION ALL SELECT idx, id, 'duplicate_profile_id', '', true FROM f WHERE rp > 1
    UNION ALL SELECT idx, id, 'invalid_sound_meaning', sound_meaning, true FROM f WHERE trim(sound_meaning) = ''
    UNION ALL SELECT idx, id, 'invalid_strokes', strokes, true FROM f WHERE strokes = 'n'
    UNION ALL SELECT idx, id, 'invalid_is_person_name_hanja', flag, true FROM f WHERE flag = 'maybe'"""
S.VIEWS["graph_valid"] = """SELECT * FROM records_bad WHERE id IS NOT NULL AND NOT no_meta AND NOT no_strokes AND idx NOT IN (SELECT idx FROM graph_issues WHERE body)"""
_GRAPH_VIEWS = ("chars", "chars_bad", "records_bad", "graph_issues", "graph_valid")


@AREA.add("d4_graph_issues", S.with_views(*_GRAPH_VIEWS, body="SELECT idx, id, issue, detail FROM graph_issues"))
def d4_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.graph_rows(records_bad(spark, sf_dir), "seq")[1]


@AREA.add("d4_graph_rows", S.with_views(*_GRAPH_VIEWS, body="SELECT idx, id, dataset, profile_id, hangul, CAST(strokes AS INT) AS strokes, flag = 'true' AS is_person_name_hanja FROM graph_valid"))
def d4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = Q.graph_rows(records_bad(spark, sf_dir), "seq")
    return valid.select("idx", "id", "dataset", "profile_id", "hangul", "strokes", "is_person_name_hanja")


@AREA.add(
    "d5_duplicate_code_points",
    S.with_views(*_GRAPH_VIEWS, u="SELECT unicode, count(*) AS n, min(idx) AS f FROM graph_valid GROUP BY 1 HAVING count(*) > 1",
      body="SELECT g.unicode, profile_id, n, (SELECT count(*) FROM u) AS code_points FROM graph_valid g JOIN (SELECT * FROM u ORDER BY f LIMIT 10) t USING (unicode)"),
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_code_points(Q.graph_rows(records_bad(spark, sf_dir), "seq")[0], "idx")


@AREA.add(
    "d6_inconsistent_readings",
    S.with_views(*_GRAPH_VIEWS, body="SELECT hangul, string_agg(e, ',' ORDER BY e) AS elements FROM (SELECT DISTINCT hangul, sound_ohaeng AS e FROM graph_valid) GROUP BY 1 HAVING count(*) > 1"),
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.inconsistent_readings(Q.graph_rows(records_bad(spark, sf_dir), "seq")[0])


@AREA.add(
    "d7_collection_issues",
    """SELECT 'collection_count_mismatch' AS issue, (SELECT count(*) FROM part) || ':' || (SELECT count(*) FROM part WHERE p_type <> 'PROMO' AND p_partkey <> (SELECT max(p_partkey) FROM part)) AS detail
    UNION ALL SELECT 'sample_ids_not_found', 'part_' || k FROM (SELECT min(p_partkey) AS k FROM part UNION SELECT max(p_partkey) FROM part)
      WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND p_partkey <> (SELECT max(p_partkey) FROM part))""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("part_"), "p_partkey").alias("id"), "p_type")
    last = part.agg(F.max("seq").alias("last"))
    loaded = part.filter("p_type <> 'PROMO'").join(F.broadcast(last), F.col("seq") == F.col("last"), "left_anti")
    return Q.collection_issues(loaded, part, "seq")


@AREA.add(
    "d8_validation_report",
    S.with_views("chars", body="""SELECT 'ok' AS status, true AS ok, count(*) AS source_count, count(*) AS document_count, CAST(0 AS BIGINT) AS issue_count,
      (SELECT string_agg('hanja_' || profile_id, ',' ORDER BY seq) FROM (SELECT * FROM chars ORDER BY seq LIMIT 5)) AS sample_ids FROM chars"""),
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = S.chars(spark, sf_dir)
    docs = chars.select(
        "seq", F.concat(F.lit("hanja_"), "profile_id").alias("id"),
        C.character_text(F.lit("인명용"), F.col("sound_meaning"), F.col("strokes"), F.col("sound_ohaeng")).alias("document"), as_map(chars).alias("metadata"),
    )
    return Q.report(chars, docs, Q.document_issues(chars, docs, "seq"), "seq")
