"""Rules that read a table of questions: extraction, routing and answering per route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.once import computed_once
from namesmith.functions.text import contains_any, counted, extract, first_contained, strip
from namesmith.operators import graph as G
from namesmith.operators import lookups as L
from namesmith.session import checkpointed

# The patterns that find terms in a question.
WORD_CHAR = r"[\p{L}\p{N}_]"
PROFILE = rf"(?i)(?<!{WORD_CHAR})(OHE-[0-9]{{5}})(?!{WORD_CHAR})"
IDEOGRAPH = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}])"
SOUND_AFTER = r"(?:음|독음|발음|한글\s*음)\s*(?:은|는|이|가|:)?\s*([가-힣])"
SOUND_BEFORE = r"([가-힣])\s*(?:음|독음)"
MEANING_BEFORE = r"([가-힣]{1,8})\s*(?:뜻|의미)"
MEANING_AFTER = r"(?:뜻|의미)\s*(?:이|가|은|는|으로|와|과|:)?\s*['\"“”‘’]?([가-힣]{1,8})"

# Endings a meaning keyword loses, keywords looked for, and route keywords.
SUFFIXES = ("스러운", "로운", "하는", "하다", "한", "은", "는", "인", "의")
MEANINGS = ("밝", "지혜", "슬기", "맑", "복", "귀", "강", "아름", "평안", "총명", "빛")
STATUS_WORDS = ("상태", "현황", "카운트", "건수", "count", "검증", "적재")
PERMISSION_WORDS = ("인명용", "허용", "출생신고", "등록", "가능한", "가능해", "쓸 수")
RELATION_WORDS = ("상생", "상극", "관계", "생", "극")
RECOMMEND_WORDS = ("추천", "찾", "골라", "후보", "조건", "뜻", "의미", "획", "오행")


def profile_id_in(query: Column) -> Column:
    return F.upper(extract(query, PROFILE))


def characters_in(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(IDEOGRAPH), F.lit(1))
    return F.transform(found, lambda c: F.replace(c, F.lit(E.COMPAT_METAL), F.lit("金")))


def element_in(query: Column) -> Column:
    """First label in fixed order found anywhere, Korean before Chinese; ``획수`` so yields 수."""
    return F.coalesce(first_contained(query, list(E.LABELS)), E.normalized(first_contained(query, list(E.LABELS_HANJA))))


def strokes_in(query: Column) -> Column:
    return extract(query, r"([0-9]{1,2})\s*획").cast("int")


def sound_in(query: Column) -> Column:
    clean = query
    # Words about elements that hide a reading.
    for word in ("발음오행", "자원오행", "오행"):
        clean = F.replace(clean, F.lit(word), F.lit(" "))
    return F.coalesce(extract(clean, SOUND_AFTER), extract(clean, SOUND_BEFORE))


def meaning_stem(keyword: Column) -> Column:
    clean = F.btrim(keyword, F.lit(" '\"“”‘’.,"))
    out = clean
    for suffix in reversed(SUFFIXES):
        out = F.when((F.length(clean) > len(suffix)) & clean.endswith(suffix), F.left(clean, F.length(clean) - len(suffix))).otherwise(out)
    return F.nullif(out, F.lit(""))


def meaning_in(query: Column) -> Column:
    return F.coalesce(
        meaning_stem(extract(query, MEANING_BEFORE)), meaning_stem(extract(query, MEANING_AFTER)), first_contained(query, MEANINGS)
    )


def extracted(questions: DataFrame, query: str) -> DataFrame:
    """Everything the routes need, one column each; null where a question has none."""
    q = F.col("_text")
    return computed_once(
        computed_once(questions, {"_text": strip(F.coalesce(query, F.lit("")))}),
        {
            "profile_id": profile_id_in(q), "characters": characters_in(q), "element": element_in(q), "strokes": strokes_in(q),
            "sound": sound_in(q), "meaning": meaning_in(q),
        },
    )


def classified(questions: DataFrame, query: str) -> DataFrame:
    """Tool and reason per question, in order of precedence."""
    df = extracted(questions, query)
    q = F.col("_text")
    has_char = F.size("characters") > 0
    permission = contains_any(q, PERMISSION_WORDS)
    some = F.col("element").isNotNull() | (F.coalesce("strokes", F.lit(0)) != 0) | F.col("sound").isNotNull() | F.col("meaning").isNotNull()
    routes = (
        (contains_any(q, STATUS_WORDS) & ~has_char & F.col("profile_id").isNull(), "check_graph_status", "적재 상태 확인"),
        (permission & has_char, "check_person_name_hanja", "인명용 한자 허용 여부 확인"),
        (permission, "needs_hanja_for_permission", "한자 문자가 필요함"),
        (F.col("element").isNotNull() & contains_any(q, RELATION_WORDS) & ~q.contains("추천"), "get_ohaeng_relations", "오행 관계 조회"),
        (contains_any(q, RECOMMEND_WORDS) & some, "recommend_hanja_by_ohaeng", "조건 기반 한자 추천"),
        (F.col("profile_id").isNotNull(), "lookup_hanja", "profile_id 기준 조회"),
        (has_char, "lookup_hanja", "한자 문자 기준 조회"),
        (F.col("sound").isNotNull(), "lookup_hanja", "한글 음 기준 조회"),
    )
    tool, reason = F.lit("unsupported"), F.lit("질문 유형을 특정하지 못함")
    for hit, name, why in reversed(routes):
        tool, reason = F.when(hit, name).otherwise(tool), F.when(hit, why).otherwise(reason)
    return computed_once(df, {"tool": tool, "reason": reason}).drop("_text")


def recommended(routed: DataFrame, question_id: str, query: str, permitted: DataFrame, limit: int = 10) -> DataFrame:
    """The recommendation route: the element is a sound element only if the question says so."""
    by_sound = F.col(query).contains("발음")
    asked = routed.filter("tool = 'recommend_hanja_by_ohaeng'").select(
        question_id, F.when(by_sound, F.col("element")).alias("sound_ohaeng"), F.when(~by_sound, F.col("element")).alias("resource_ohaeng"),
        F.col("sound").alias("hangul"), F.col("meaning").alias("meaning_keyword"), "strokes", F.lit(limit).alias("limit"),
    )
    return L.recommend_characters(asked, permitted)


def answered(
    questions: DataFrame, question_id: str, query: str, profiles: DataFrame, edges: DataFrame, pairs: DataFrame, status: DataFrame, limit: int = 10
) -> DataFrame:
    """Each question answered by its route: (question, tool, rank, key, value).

    Every route is one join over its own questions. ``status`` is one row (value). The
    classified questions are written once: the rules read each text once, not per route.
    """
    kept = [question_id, query, "tool", "profile_id", "characters", "element", "strokes", "sound", "meaning"]
    routed = checkpointed(classified(questions, query).select(*kept))
    first_char = F.get("characters", F.lit(0))

    def route(name: str) -> DataFrame:
        return routed.filter(F.col("tool") == name)

    def shaped(df: DataFrame, tool: str, rank: Column, key: Column, value: Column) -> DataFrame:
        return df.select(question_id, F.lit(tool).alias("tool"), rank.cast("int").alias("rank"), key.alias("key"), value.alias("value"))

    by_profile, by_char = F.col("profile_id").isNotNull(), F.size("characters") > 0
    looked_up = route("lookup_hanja").select(
        question_id, F.when(~by_profile & by_char, first_char).alias("hanja"), F.when(~by_profile & ~by_char, F.col("sound")).alias("hangul"), "profile_id",
        F.lit(limit).alias("limit"),
    )
    lookups = L.lookup_characters(looked_up, profiles)
    checks = G.permission_check(route("check_person_name_hanja").select(question_id, first_char.alias("asked")), "asked", profiles, edges)
    relations = G.element_relations(route("get_ohaeng_relations").select(question_id, "element"), "element", pairs)
    recommendations = recommended(routed, question_id, query, G.permitted(profiles, edges), limit)
    load = route("check_graph_status").withColumn("_k", F.lit(1)).join(F.broadcast(status.withColumn("_k", F.lit(1))), "_k")
    one, described = F.lit(1), F.concat_ws(" ", "hanja", "hangul", F.col("strokes").cast("string"))
    parts = [
        shaped(lookups, "lookup_hanja", F.col("rank"), F.col("profile_id"), described),
        shaped(checks, "check_person_name_hanja", F.coalesce("rank", one), F.coalesce("profile_id", F.lit("")), F.col("status")),
        shaped(relations, "get_ohaeng_relations", one, F.col("source"), F.concat_ws("/", "generates", "controls")),
        shaped(recommendations, "recommend_hanja_by_ohaeng", F.col("rank"), F.col("profile_id"), described),
        shaped(load, "check_graph_status", one, F.lit(""), F.col("value")),
        shaped(route("needs_hanja_for_permission"), "needs_hanja_for_permission", one, F.lit(""), F.lit("한자를 포함해 질문해주세요")),
        shaped(route("unsupported"), "unsupported", one, F.lit(""), F.lit("처리할 수 없는 질문 유형")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Words that ask for a stroke search or an element triple.
LUCKY_WORDS = ("어울리는 획수", "吉수", "획수 조합", "역산", "길한 획수")
TRIPLE_WORDS = ("오행 조합", "오행 궁합")


def calculation_route(query: Column) -> tuple[Column, Column]:
    """(route, arguments): stroke search, triple lookup, four frames or guidance."""
    nums = F.regexp_extract_all(query, F.lit(r"([0-9]+)"), F.lit(1))
    triple = F.regexp_extract_all(query, F.lit(f"([{E.LABELS_HANJA}])"), F.lit(1))
    lucky, combo = contains_any(query, LUCKY_WORDS), contains_any(query, TRIPLE_WORDS)
    n = F.size(nums)
    none, one, three = F.lit(""), F.get(nums, F.lit(0)), F.array_join(F.slice(nums, 1, 3), ",")
    cases = (
        (lucky & (n > 0), "lucky", one), (lucky, "guide_surname", none), (combo & (F.size(triple) >= 3), "triple", F.array_join(F.slice(triple, 1, 3), ",")),
        (combo, "guide_triple", none), (n >= 3, "frames", three), (n == 1, "lucky", one),
    )
    route, args = F.lit("guide_strokes"), none
    for hit, name, value in reversed(cases):
        route, args = F.when(hit, name).otherwise(route), F.when(hit, value).otherwise(args)
    return route, args


# Words for the kind, gender and length of a requested name.
GIRL = ("딸", "여아", "여자아이", "여자 아이", "여자이름", "여자 이름", "여자", "여성")
BOY = ("아들", "남아", "남자아이", "남자 아이", "남자이름", "남자 이름", "남자", "남성")
ANY_GENDER = (
    "아들", "딸", "남아", "여아", "남자아이", "여자아이", "남자 아이", "여자 아이", "남자이름", "여자이름", "남자 이름", "여자 이름", "남자", "여자", "남녀",
)
ANY_TYPE = ("한자", "순우리말", "우리말이름", "우리말 이름", "한글이름", "한글 이름")
SINGLE = ("외자", "한 글자", "1글자", "외자이름", "한글자")
NATIVE = ("순우리말", "우리말이름", "우리말 이름", "한글이름", "한글 이름", "순한국어")


def stated_element(query: Column) -> Column:
    """Element named as ``X오행``, Chinese label first; '' if none."""
    return F.coalesce(
        E.normalized(extract(query, f"([{E.LABELS_HANJA}])오행")), extract(query, f"([{E.LABELS}])오행"), F.lit("")
    )


def stated_surname_element(query: Column) -> Column:
    """The same for the element tied to the surname (``성에 X오행``)."""
    return F.coalesce(
        E.normalized(extract(query, rf"성에\s*([{E.LABELS_HANJA}])오행")), extract(query, rf"성에\s*([{E.LABELS}])오행"), F.lit("")
    )


def traits(query: Column) -> dict[str, Column]:
    native = contains_any(query, NATIVE) | query.contains("우리말")
    chinese = query.contains("한자")
    girl, boy = contains_any(query, GIRL), contains_any(query, BOY)
    gender = F.when(girl, "여성").when(boy, "남성").otherwise("남녀")
    return {
        "element": stated_element(query), "surname_element": stated_surname_element(query), "single": contains_any(query, SINGLE),
        "both": native & chinese, "native": native & ~chinese, "girl": girl, "boy": boy,
        "requested": F.coalesce(counted(extract(query, r"([0-9]+)\s*개")), F.lit(0)),
        "paper_query": F.concat(F.lit("최근 2010~2020년대 "), gender, F.lit(" 이름 선호 경향 트렌드 특징 받침 음절 패턴")),
    }


def missing_slots(resolved: DataFrame, query: str) -> DataFrame:
    """What has to be asked back: gender, type, surname character; 'more' if nothing.

    ``resolved`` carries the query beside the surname and character found in it.
    """
    q = F.col(query)
    pure_native = contains_any(q, NATIVE) & ~q.contains("한자")
    slots = F.array_compact(
        F.array(
            F.when(~contains_any(q, ANY_GENDER), "gender"), F.when(~contains_any(q, ANY_TYPE), "type"),
            F.when((F.col("surname") != "") & (F.col("hanja") == "") & ~pure_native, "surname"),
        )
    )
    return resolved.withColumn("missing", F.when(F.size(slots) == 0, "more").otherwise(F.array_join(slots, ",")))


# Actions and collections a routing reply may name.
ACTIONS = ("internal_rag", "graph_db", "sql_db", "external_api", "generate", "clarify")
COLLECTIONS = ("suri_col", "ohaeng_col", "hanja_col", "law_col", "urimalsam_col", "paper_col")


def routing_reply(raw: Column, used_tools: Column) -> Column:
    """Struct (action, collections) of a routing reply: first usable JSON object, fenced
    before bare; an unknown or already used action falls through to generate."""
    nothing = F.array().cast("array<string>")

    def read(pattern: str) -> Column:
        value = F.from_json(extract(raw, pattern), "next STRING, collections STRING")
        listed = F.when(value["collections"].startswith("["), F.from_json(value["collections"], "ARRAY<STRING>"))
        valid = F.filter(F.coalesce(listed, nothing), lambda c: c.isin(*COLLECTIONS))
        fresh = value["next"].isin(*ACTIONS) & ~F.array_contains(used_tools, value["next"])
        return F.when(fresh, F.struct(value["next"].alias("action"), valid.alias("collections"))).when(
            value["next"] == "generate", F.struct(F.lit("generate").alias("action"), nothing.alias("collections"))
        )

    default = F.struct(F.lit("generate").alias("action"), nothing.alias("collections"))
    return F.coalesce(read(r"(?s)```json\s*(\{.*?\})\s*```"), read(r"(?s)(\{[^{}]*\})"), default)


# Words that ask whether a word exists.
VERIFY_WORDS = ("검증", "실제 단어", "존재하는")


def words_to_verify(query: Column) -> Column:
    """Quoted Hangul words, else two to four syllables before a particle; the first three."""
    quoted = F.regexp_extract_all(query, F.lit(r"['\"]([가-힣]+)['\"]"), F.lit(1))
    bare = F.regexp_extract_all(query, F.lit(r"([가-힣]{2,4})(?:이|가|은|는|이라는|라는)"), F.lit(1))
    found = F.slice(F.when(F.size(quoted) > 0, quoted).otherwise(bare), 1, 3)
    return F.when(contains_any(query, VERIFY_WORDS), found).otherwise(F.array().cast("array<string>"))
