"""Conversations resolved to self-contained requests, and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.once import computed_once
from namesmith.functions.order import carried, first_per_key
from namesmith.functions.text import HANGUL, HANJA, contains_any, extract, first_contained, strip

# The header of a recommended name and the line that asks back.
RECOMMENDED = rf"##\s*\[이름\s*\d+\]\s*([{HANGUL}]{{2,5}})"
ASKED_BACK = "아래 정보를 알려주세요"

# Words that mark a follow-up, a naming context, a naming request, a native name.
CONTINUATION = ("더 추천", "2개 더", "3개 더", "하나 더", "몇 개 더", "추가로 추천", "다른 이름", "추가로", "추가")
CONTEXT = ("이름", "추천", "씨", "딸", "아들", "한자", "순우리말", "짓")
REQUEST = ("이름", "작명", "추천", "짓고")
NATIVE = ("순우리말", "우리말이름", "우리말 이름", "한글이름", "한글 이름")


def names_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RECOMMENDED), F.lit(1))


def _history(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every turn with what came before it in its conversation."""
    t, user, assistant = F.col(text), F.col(role) == "user", F.col(role) == "assistant"
    df = computed_once(
        turns,
        {
            "_user": user, "_assistant": assistant, "_context": user & contains_any(t, CONTEXT), "_request": user & contains_any(t, REQUEST),
            "_surname": user & t.contains("씨") & contains_any(t, CONTEXT), "_char": F.when(user, extract(t, f"([{HANJA}]{{1,2}})")),
            "_names": F.when(assistant, names_in(t)).otherwise(F.array().cast("array<string>")),
        },
    )
    text_if = {
        "prev_assistant": (F.col("_assistant"), t), "prev_user": (F.col("_user"), t), "last_request": (F.col("_request"), t),
        "surname_base": (F.col("_surname"), t), "last_char": (F.col("_char").isNotNull(), F.col("_char")), "_any": (F.lit(True), F.lit(1)),
    }
    out = carried(df, [conv], turn, {"first_context": (F.col("_context"), t)}, text_if, {"prev_names": F.col("_names")})
    return out.drop("_user", "_assistant", "_context", "_request", "_surname", "_char", "_names")


def previous_names(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Names recommended in earlier assistant turns, in order, per turn."""
    return _history(turns, conv, turn, role, text).select(conv, turn, role, "prev_names")


def _squeezed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def resolved_requests(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each user turn as one request that stands on its own."""
    df = _history(turns, conv, turn, role, text).filter(F.col(role) == "user")
    msg, names = F.col(text), F.array_join("prev_names", ", ")
    has_names = F.size("prev_names") > 0
    note = F.when(has_names, F.concat(F.lit(" (이미 추천한 이름: "), names, F.lit(" 제외)"))).otherwise("")
    count = F.coalesce(extract(msg, r"(\d+\s*개)"), F.lit("3개"))

    clarified = F.when(
        F.col("first_context").isNotNull() & (F.col("first_context") != F.col("prev_user")), F.concat_ws(" ", "first_context", "prev_user", text)
    ).otherwise(F.concat_ws(" ", "prev_user", text))

    # The patterns and phrases of the rules below.
    kinds = r"(한자\s*이름|순우리말\s*이름|우리말\s*이름|한글\s*이름)"
    base = strip(F.regexp_replace(F.coalesce("surname_base", F.lit("이름")), kinds, ""))
    char = F.coalesce(F.concat(F.lit(" 성씨 한자: "), "last_char"), F.lit(""))
    switched = _squeezed(F.concat(F.concat_ws(" ", base, first_contained(msg, NATIVE), count, F.lit("추천해줘")), char, note))

    plain = F.regexp_replace(strip(F.col("last_request")), r"(하나만?|한\s*개만?|\d+\s*개만?)", "")
    plain = strip(F.regexp_replace(plain, r"(추천\s*해\s*줘|추천\s*해\s*주세요|추천해)", ""))
    plain = F.rtrim(_squeezed(plain), F.lit("."))
    again = F.when(F.col("last_request").isNotNull(), F.concat_ws(" ", plain, count, F.lit("추천해줘"))).otherwise(F.concat(F.lit("이름 "), count, F.lit(" 추천해줘")))

    fresh = F.concat(msg, F.lit(" (이미 추천한 이름 ["), names, F.lit("]과 겹치지 않는 다른 이름으로)"))
    asked_back = F.coalesce(F.col("prev_assistant").contains(ASKED_BACK), F.lit(False)) & (F.coalesce("prev_user", F.lit("")) != "")
    cases = (
        (F.col("_any").isNull(), "unchanged", msg), (asked_back, "clarified", clarified),
        (contains_any(msg, CONTINUATION) & contains_any(msg, NATIVE), "switched", switched), (contains_any(msg, CONTINUATION), "continued", F.concat(again, note)),
        (contains_any(msg, REQUEST) & has_names, "fresh", fresh),
    )
    kind, query = F.lit("unchanged"), msg
    for hit, name, value in reversed(cases):
        kind, query = F.when(hit, name).otherwise(kind), F.when(hit, value).otherwise(query)
    return df.select(conv, turn, kind.alias("kind"), query.alias("query"))


# -- training set --------------------------------------------------------------------------

def cleaned_output(text: Column) -> Column:
    """Leaked context cut out of a model answer."""
    # Marks of leaked context.
    marker = "[원본 추천 결과]"
    out = F.replace(F.replace(text, F.lit(marker + "\n"), F.lit("")), F.lit(marker), F.lit(""))
    return strip(F.regexp_replace(out, r"(?s)\[참고 정보\].*?(?=---|\z)", ""))


def deduplicated(pairs: DataFrame, seq: str, output: str) -> DataFrame:
    """First pair per first recommended name; pairs without a name all stay."""
    # Fixed value: header of the first name.
    name = extract(F.col(output), rf"## \[이름 1\]\s*([{HANGUL}]+)")
    named = computed_once(pairs, {"_name": name})
    first = first_per_key(named.filter("_name IS NOT NULL"), ["_name"], [seq])
    return first.unionByName(named.filter("_name IS NULL")).drop("_name")


def usable_response(response: Column) -> Column:
    text = F.coalesce(response, F.lit(""))
    return (text != "") & ~text.contains("Rate limit") & ~text.contains("Error")


# Surnames with their characters, and the three kinds of prompt.
SURNAMES = {
    "김": "金", "이": "李", "박": "朴", "최": "崔", "정": "鄭", "강": "姜", "조": "趙", "윤": "尹",
    "장": "張", "임": "林", "한": "韓", "오": "吳", "서": "徐", "신": "申", "권": "權", "황": "黃",
    "안": "安", "송": "宋", "전": "全", "홍": "洪", "유": "柳", "고": "高", "문": "文", "양": "梁",
}
KINDS = (("한자", 60), ("순우리말(한글)", 20), ("외자(한 글자) 한자", 20))
FIXED_PROMPTS = (
    "대법원 인명용 한자 규칙에 대해 설명해줘.", "수리 4격이 무엇인지 알려줘.", "오행에서 목생화의 의미는 뭐야?",
    "대법원 인명용 한자에 등록되지 않은 한자를 이름에 쓸 수 있어?", "오행 상극에 대해 설명해줘.", "한글 이름도 가족관계등록부에 올릴 수 있나요?",
    "오행 상생의 종류를 모두 말해줘.", "이름 한자의 획수는 어떻게 계산하나요?", "수리 4격 중 원격은 어떤 시기의 운을 의미하나요?", "수리 4격 중 정격은 무엇을 의미하나요?",
)
STROKE_TRIPLES = ((8, 10, 12), (7, 9, 11), (5, 8, 14), (10, 10, 10), (6, 12, 12), (4, 5, 6), (15, 12, 8), (9, 9, 9), (11, 13, 15), (8, 15, 5))


def _bucket(seed: str, key: Column, size: int) -> Column:
    digest = F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(size))


def name_prompts(rows: DataFrame, key: str, seed: str = "prompt") -> DataFrame:
    """One seeded naming prompt per row: surname, gender, and kind weighted 60/20/20."""
    k = F.col(key)

    def pick(values: list[str], index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    surname = _bucket(seed + ":surname:", k, len(SURNAMES))
    weight = _bucket(seed + ":kind:", k, sum(w for _, w in KINDS))
    kind, edge = F.lit(KINDS[-1][0]), sum(w for _, w in KINDS)
    for name, w in reversed(KINDS):
        edge -= w
        kind = F.when(weight < edge + w, F.when(weight >= edge, F.lit(name)).otherwise(kind)).otherwise(kind)
    gender = pick(["남자아이", "여자아이"], _bucket(seed + ":gender:", k, 2))
    # The phrases of the prompt.
    text = F.concat(
        pick(list(SURNAMES), surname), F.lit("씨 성을 가진 "), gender, F.lit(" "), kind, F.lit(" 이름 1개를 추천해줘. 성은 "), pick(list(SURNAMES.values()), surname), F.lit("야")
    )
    return rows.select(key, text.alias("prompt"))


def fixed_prompts(spark) -> DataFrame:
    """The prompts every training set starts with."""
    strokes = [f"이름 한자의 획수가 각각 {a}획, {b}획, {c}획일 때 수리 4격을 계산해줘." for a, b, c in STROKE_TRIPLES]
    return spark.createDataFrame([(p,) for p in (*strokes, *FIXED_PROMPTS)], "prompt string")


PAIR_SCHEMA = "instruction STRING, input STRING, output STRING, document STRING, metadata MAP<STRING,STRING>"


def training_pairs(rows: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Instruction rows as they are, document rows as questions about them, others dropped."""
    df = rows.select(*keep, F.from_json(raw, PAIR_SCHEMA).alias("_r"), F.json_object_keys(raw).alias("_k"))

    def has(a: str, b: str) -> Column:
        return F.array_contains("_k", a) & F.array_contains("_k", b)

    meta = F.col("_r.metadata")
    kind = F.coalesce(meta["type"], F.lit("지식"))
    title = F.coalesce(meta["title"], meta["collection"], F.lit("작명 지식"))
    question = (
        F.when(kind == "hanja", F.concat(F.lit("인명용 한자 '"), F.coalesce(meta["hanja"], F.lit("")), F.lit("'의 뜻, 획수, 오행 정보를 알려줘.")))
        .when(kind == "law", F.lit("가족관계의 등록 등에 관한 법률 및 인명용 한자 관련 조항을 설명해줘."))
        .otherwise(F.concat(title, F.lit("에 대해 설명해줘.")))
    )
    pair, doc = has("instruction", "output"), has("document", "metadata")
    return df.filter(pair | doc).select(
        *keep, F.when(pair, F.col("_r.instruction")).otherwise(question).alias("instruction"),
        F.when(pair, F.coalesce("_r.input", F.lit(""))).otherwise("").alias("input"), F.when(pair, F.col("_r.output")).otherwise(F.col("_r.document")).alias("output"),
    )


def chat_text(instruction: Column, given: Column, output: Column) -> Column:
    return F.concat(
        F.lit("<|im_start|>user\n"), instruction, F.when(given != "", F.concat(F.lit("\n"), given)).otherwise(""),
        F.lit("<|im_end|>\n<|im_start|>assistant\n"), output, F.lit("<|im_end|>"),
    )
