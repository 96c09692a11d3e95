"""Document records built from dictionaries, laws, papers and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.order import first_per_key, running_index
from namesmith.functions.text import code_point_label, nfkc, split_ko_hanja


def number_documents(rows: DataFrame) -> DataFrame:
    """Documents of number grades; number 0 and rows without a description are skipped."""
    gyeok_ko, gyeok_hanja = split_ko_hanja(F.col("gyeok"))
    fortune_ko, fortune_hanja = split_ko_hanja(F.col("fortune"))
    parts = rows.filter((F.col("num") != 0) & (F.col("description") != "")).select(
        "num", "grade", "description", gyeok_ko.alias("gyeok_ko"), gyeok_hanja.alias("gyeok_hanja"),
        fortune_ko.alias("fortune_ko"), fortune_hanja.alias("fortune_hanja"),
    )
    # Fixed value: template of the document.
    text = F.format_string(
        "%d수 %s(%s) %s(%s) [%s] — %s", "num", "gyeok_ko", "gyeok_hanja", "fortune_ko", "fortune_hanja", "grade", "description"
    )
    return parts.select(
        F.format_string("suri_%d", "num").alias("id"),
        text.alias("document"),
        F.struct(
            F.lit("81suri").alias("type"), F.col("num").alias("suri_num"), "gyeok_ko", "gyeok_hanja", "fortune_ko",
            "fortune_hanja", F.col("grade").alias("gilhyung"),
        ).alias("metadata"),
    )


def triple_documents(rows: DataFrame, seq: str) -> DataFrame:
    """Documents of element triples. The id counts input positions, skipped rows included."""
    placed = running_index(rows, seq, "idx").withColumn(
        "combo", F.replace("combo", F.lit(E.COMPAT_METAL), F.lit("金"))
    )
    e = [F.substring("combo", i, 1) for i in (1, 2, 3)]
    a, b, c = (E.code_of(x) for x in e)
    return placed.filter(F.col("description") != "").select(
        F.format_string("ohaeng_%d", "idx").alias("id"),
        # Fixed value: template of the document.
        F.format_string("오행 조합 %s (%s→%s→%s) — %s", "combo", *e, "description").alias("document"),
        F.struct(
            F.lit("yinyang").alias("type"), "combo", e[0].alias("element1"), e[1].alias("element2"), e[2].alias("element3"),
            E.corpus_relation(a, b).alias("pair1_relation"), E.corpus_relation(b, c).alias("pair2_relation"),
            E.corpus_flow(a, b, c).alias("flow"),
        ).alias("metadata"),
    )


def character_text(kind: Column, meaning: Column, strokes: Column, sound: Column) -> Column:
    # Fixed value: template of the document.
    return F.format_string(
        "한자 %s(%s)은 뜻이 '%s'인 %s 한자이다. 유니코드는 %s, 획수는 %d획, 발음오행은 %s, 자원오행은 %s이다.",
        "hanja", "hangul", meaning, kind, "unicode", strokes, sound, "resource_ohaeng",
    )


def character_documents(chars: DataFrame) -> DataFrame:
    """One document per character profile, profile fields as metadata."""
    return chars.select(
        F.concat(F.lit("hanja_"), "profile_id").alias("id"),
        character_text(F.lit("인명용"), F.col("sound_meaning"), F.col("strokes"), F.col("sound_ohaeng")).alias("document"),
        F.struct(
            F.lit("hanja").alias("type"), F.lit("hanja_profiles").alias("collection"), "profile_id", "hangul", "hanja", "unicode",
            "sound_meaning", "strokes", "sound_ohaeng", "resource_ohaeng", F.lit(True).alias("is_person_name_hanja"),
        ).alias("metadata"),
    )


def surname_documents(surnames: DataFrame, people: DataFrame, existing: DataFrame, seq: str) -> DataFrame:
    """Documents of surname characters the collection lacks, numbered over the kept rows.

    The text keeps 0 strokes where the dictionary has none, the metadata stores 1; a
    reading without an element takes the character's own.
    """
    kept = running_index(surnames.join(existing.select("hanja").distinct(), "hanja", "left_anti"), seq, "idx")
    entry = people.select(F.col("hanja").alias("_key"), F.col("strokes").alias("_strokes"), F.col("sound_meaning").alias("_meaning"))
    rows = (
        kept.withColumn("_key", nfkc(F.col("hanja")))
        .join(entry, "_key", "left")
        .select(
            "hanja", "hangul", "resource_ohaeng", F.format_string("SUR-%05d", "idx").alias("profile_id"),
            F.coalesce("_strokes", F.lit(0)).alias("text_strokes"), F.coalesce("_meaning", F.lit("")).alias("sound_meaning"),
            code_point_label(F.col("hanja")).alias("unicode"), E.sound_element(F.col("hangul")).alias("_sound"),
        )
    )
    return rows.select(
        F.concat(F.lit("hanja_"), "profile_id").alias("id"),
        character_text(F.lit("성씨"), F.col("sound_meaning"), F.col("text_strokes"), F.col("_sound")).alias("document"),
        F.struct(
            F.lit("hanja").alias("type"), "profile_id", "hangul", "hanja", "unicode", "sound_meaning",
            F.greatest("text_strokes", F.lit(1)).alias("strokes"),
            F.coalesce(F.nullif("_sound", F.lit("")), "resource_ohaeng").alias("sound_ohaeng"), "resource_ohaeng",
            F.lit(False).alias("is_person_name_hanja"), F.lit(True).alias("is_surname_hanja"),
        ).alias("metadata"),
    )


def law_documents(articles: DataFrame, seq: str) -> DataFrame:
    """First article per source and number. Numbers already end in ``조``, so the title repeats it."""
    first = first_per_key(
        articles.select("source", "article_num", seq, "title", "raw_text", "normalized_text"), ["source", "article_num"], [seq]
    )
    text = F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text")
    return first.select(
        F.concat(F.lit("law_"), "source", F.lit("_"), "article_num").alias("id"),
        # Parts of the title line.
        F.concat(F.lit("["), "source", F.lit("] 제"), "article_num", F.lit("조("), "title", F.lit(")\n"), text).alias("document"),
        F.struct("source", "article_num", "title", F.lit("law").alias("type")).alias("metadata"),
    )


def word_documents(words: DataFrame, seq: str) -> DataFrame:
    """First entry per native word as a four-line document."""
    first = first_per_key(words.select("name", seq, "meaning", "gender", "trend"), ["name"], [seq])
    return first.select(
        F.concat(F.lit("urimalsam_"), "name").alias("id"),
        F.concat_ws(
            # Labels of the four lines.
            "\n", F.concat(F.lit("[순우리말 이름] "), "name"), F.concat(F.lit("뜻: "), "meaning"),
            F.concat(F.lit("성별 경향: "), "gender"), F.concat(F.lit("최근 추세: "), "trend"),
        ).alias("document"),
        F.struct("name", "meaning", "gender", "trend", F.lit("urimalsam").alias("type")).alias("metadata"),
    )


def paper_documents(chunks: DataFrame, seq: str) -> DataFrame:
    """Chunks with a running number in the id. Every column but the content and the position is metadata, as text; null becomes ''."""
    placed = running_index(chunks, seq, "_i")
    meta = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in chunks.columns if c not in ("content", seq)}
    return placed.select(
        F.concat(F.lit("paper_"), meta["source"], F.lit("_"), meta["page_number"], F.lit("_"), F.col("_i") - 1).alias("id"),
        F.coalesce("content", F.lit("")).alias("document"),
        F.struct(*[v.alias(c) for c, v in meta.items()]).alias("metadata"),
    )


def spacing_need(pages: DataFrame, doc: str, page: str, text: str, sample: int = 5, threshold: float = 5.0) -> DataFrame:
    """Share of blanks over each document's first pages and whether it is too low."""
    from namesmith.functions.order import top_per_key
    from namesmith.functions.text import blank_share

    measured = pages.select(
        doc, page, F.length(text).alias("_chars"), (F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))).alias("_blanks")
    )
    first = top_per_key(measured, [doc], [F.col(page)], sample, "_r")
    share = blank_share(F.col("chars"), F.col("blanks"))
    return (
        first.groupBy(doc)
        .agg(F.sum("_chars").alias("chars"), F.sum("_blanks").alias("blanks"))
        .select(doc, "chars", "blanks", share.alias("blank_percent"), (share < threshold).alias("needs_spacing"))
    )


def surname_dictionary(csv: DataFrame, people: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, missing): CSV keys found in the people dictionary or the manual table;
    the CSV reading wins over the dictionary's, manual rows not in the CSV are appended.

    ``csv`` has (seq, hanja, hangul) unique per character, ``manual`` is a short list.
    """
    element = E.normalized(nfkc(F.col("resource_raw")))
    known = people.filter("hanja <> '' AND resource_raw <> '' AND reading <> ''").select(
        "hanja", F.coalesce(element, "resource_raw").alias("_known")
    )
    extra = manual.select("hanja", F.col("hangul").alias("_m_hangul"), F.col("resource_ohaeng").alias("_m_element"))
    joined = csv.join(known, "hanja", "left").join(extra, "hanja", "left")
    found = joined.filter("_known IS NOT NULL OR _m_element IS NOT NULL").select(
        "hanja",
        F.when(F.col("_known").isNotNull(), F.col("hangul")).otherwise(F.col("_m_hangul")).alias("hangul"),
        F.coalesce("_known", "_m_element").alias("resource_ohaeng"),
    )
    rest = manual.join(csv.select("hanja"), "hanja", "left_anti").select("hanja", "hangul", "resource_ohaeng")
    missing = joined.filter("_known IS NULL AND _m_element IS NULL").select("hanja", "hangul")
    return found.unionByName(rest), missing


# Strokes of the common surnames.
SURNAME_STROKES = {
    "김": 8, "이": 7, "박": 6, "최": 11, "정": 19, "강": 9, "조": 14, "윤": 4,
    "장": 11, "임": 8, "한": 17, "오": 7, "서": 10, "신": 5, "권": 22, "황": 12,
    "안": 6, "송": 7, "전": 6, "홍": 10, "고": 10, "문": 4, "양": 11, "손": 10,
    "배": 14, "백": 5, "허": 11, "유": 9, "남": 9, "심": 8, "노": 16, "하": 9,
    "곽": 15, "성": 7, "차": 7, "주": 6, "우": 9, "구": 8, "라": 20, "민": 13,
}


def surname_strokes(df: DataFrame, surname: str) -> DataFrame:
    """Strokes of a surname written with or without ``씨``/``가``; unknown ones get status error."""
    from namesmith.functions.text import strip

    table = F.create_map(*[F.lit(x) for pair in SURNAME_STROKES.items() for x in pair])
    clean = strip(F.replace(F.replace(F.col(surname), F.lit("씨"), F.lit("")), F.lit("가"), F.lit("")))
    found = F.try_element_at(table, clean)
    return df.select(
        "*", clean.alias("clean_surname"), F.coalesce(found, F.lit(0)).alias("surname_strokes"),
        F.when(found.isNull(), "error").otherwise("success").alias("status"),
    )
