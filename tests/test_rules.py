"""Hand-computed cases for the rules."""

import random

import pytest
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import frames as FR
from namesmith.functions import text as X
from namesmith.functions.order import carried, first_per_key, permuted, running_index, top_per_key
from namesmith.operators import audit as A
from namesmith.operators import chunk as K
from namesmith.operators import clean as C
from namesmith.operators import dialogue as D
from namesmith.operators import evaluation as V
from namesmith.operators import lookups as L
from namesmith.operators import questions as Q
from namesmith.plans.cleaning import NOISE


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_four_frames(spark):
    got = {k: one(spark, v) for k, v in FR.four_frames(F.lit(8), F.lit(7), F.lit(6)).items()}
    assert got == {"won": 13, "hyung": 15, "yi": 14, "jung": 21}


@pytest.mark.parametrize("n, want", [(81, 81), (82, 1), (162, 81), (1, 1), (0, None), (-3, None)])
def test_wrap(spark, n, want):
    assert one(spark, FR.wrapped(F.lit(n))) == want


@pytest.mark.parametrize("reading, want", [("김", "목"), ("도", ""), ("", ""), ("x", ""), ("나라", "화"), ("힣", "토")])
def test_sound_element(spark, reading, want):
    assert one(spark, E.sound_element(F.lit(reading))) == want


def test_pair_rules_differ(spark):
    wood, fire, earth, metal = F.lit(0), F.lit(1), F.lit(2), F.lit(3)
    assert one(spark, E.lookup_flow(wood, fire, earth)) == "전체 상생"
    assert one(spark, E.lookup_relation(wood, metal)) == "역상극"
    assert one(spark, E.lookup_relation(metal, wood)) == "상극"
    assert one(spark, E.name_relation(wood, metal)) == one(spark, E.name_relation(metal, wood)) == "상극"
    assert one(spark, E.corpus_relation(wood, metal)) == "비화"


@pytest.mark.parametrize("raw, want", [("火", "화"), (" 금 ", "금"), (E.COMPAT_METAL, "금"), ("불", None), ("", None)])
def test_normalized_label(spark, raw, want):
    assert one(spark, E.normalized(F.lit(raw))) == want


def test_strip_and_nfkc(spark):
    assert one(spark, X.strip(F.lit("　\n a b \t"))) == "a b"
    assert one(spark, X.nfkc(F.col("v")), v="ＡＢ" + E.COMPAT_METAL) == "AB金"


def test_split_ko_hanja(spark):
    outer, inner = X.split_ko_hanja(F.lit("발전격(發展格) 뒤(x)"))
    assert (one(spark, outer), one(spark, inner)) == ("발전격", "發展格")
    assert one(spark, X.split_ko_hanja(F.lit(" 그냥 "))[0]) == "그냥"


def test_law_text(spark):
    text = "법제처 3 국가법령정보센터\n가(법)\n가\n나\n다-\n라  마・바 "
    clean = X.law_text_normalized(X.law_page_headers_removed(F.lit(text), "가(법)"))
    assert one(spark, clean) == "가나다라 마, 바"


@pytest.mark.parametrize(
    "line, want",
    [
        ("만들없다", "만들었다"), ("가없다", "가없다"), ("꾸중올", "꾸중을"), ("올해", "올해"), ("손흘 잡다", "손을 잡다"), ("가올", "가올"), ("끼가", "¶가"), ("3끼 먹다", "3끼 먹다"), ("9 하늘", "¶ 하늘"),
        ("'말' 논 뜻", "'말'는 뜻"), ("하늘틀 본다", "하늘를 본다"), ("그이름 좋다", "그이름 좋다"), ("엿기름 올", "엿기름을"), ("농고서 갔다", "놓고서 갔다"), ("'명] 말", "[명] 말"), ("[_] 말", "말"),
        ("[[미] 말", "[비] 말"), ("[명]@가", "[명] ¶가"), ("=== PAGE 3 [본문] ===", "=== PAGE 3 [본문] ==="), ("  12 ", None), ("[_]", None), ("  ", ""),
        ("\u300012\u00a0", None), ("12\u3000", None), ("색\u3000인 3", None), ("9\u3000하늘", "¶\u3000하늘"), ("'말'\u3000논\u00a0뜻", "'말'는\u00a0뜻"), ("하늘틀\u3000본다", "하늘를\u3000본다"), ("그이름\u3000좋다", "그이름\u3000좋다"), ("끼\u00a0가", "¶\u00a0가"),
    ],
)
def test_clean_lines(spark, line, want):
    df = C.with_rules(spark.createDataFrame([(line,)], "line string"), "line")
    assert df.first()["cleaned"] == want


def test_clean_counts(spark):
    df = spark.createDataFrame([("농고서 농고",), ("'명] 'x 동]",), ("7",)], "line string")
    counts = {r["rule"]: r["n"] for r in C.rule_counts(df, "line").collect()}
    assert (counts["nohta_fixed"], counts["pos_fixed"], counts["header_removed"]) == (2, 2, 1)


def _packed(paragraph):
    import re

    if len(paragraph) <= 500:
        return [paragraph]
    out, current = [], ""
    for s in re.split(r"(?<=[.?!])\s+", paragraph):
        if current and len(current) + len(s) > 500:
            out.append(current.strip())
            current = ""
        current += s + " "
    return out + ([current.strip()] if current.strip() else [])


def test_chunks_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join("가" * rng.randint(1, 300) + rng.choice(".?!") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = K.packed_chunks(df, F.array("text"), ["id"]).orderBy("id", "chunk_no").collect()
    got = [[r["chunk"] for r in rows if r["id"] == i] for i in range(len(texts))]
    assert got == [_packed(t) for t in texts]


def test_merged_paragraphs(spark):
    long = "나" * 60
    for text, want in [
        (f"a\n\n{long}\n \nb\n\nc", [f"a {long} b c"]), ("a\n\nb", ["a b"]), (f"{long}\n\n{long}", [long, long]), (" \n\n ", []), (f"{long}\n\nx\ny\n\n{long}", [long, f"x y {long}"]),
    ]:
        assert one(spark, K.merged_paragraphs(F.lit(text))) == want


def test_articles(spark):
    body = "내용이 충분히 길어야 하므로 조금 더 씁니다."
    text = f"머리 제1조(목적) {body} 제2조의2(정의) {body} 제3조(짧다) x"
    rows = K.law_articles(spark.createDataFrame([(1, text)], "id long, text string"), "text", ["id"]).collect()
    assert [(r["article_num"], r["title"]) for r in rows] == [("1조", "목적"), ("2조의2", "정의")]


def test_touching_boxes_do_not_overlap(spark):
    schema = "page long, id long, x0 double, top double, x1 double, bottom double"
    objects = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 0.0, 12.0, 10.0), (1, 3, 15.0, 5.0, 25.0, 40.0), (2, 4, 0.0, 0.0, 9.0, 9.0)], schema)
    boxes = spark.createDataFrame([(1, 9, 12.0, 0.0, 14.0, 9.0), (1, 8, 5.0, 9.0, 9.0, 30.0), (1, 7, 20.0, 39.0, 22.0, 50.0)], schema)
    kept = K.outside_boxes(objects, boxes, ["id"]).select("id").collect()
    assert sorted(r["id"] for r in kept) == [2, 4]


@pytest.mark.parametrize(
    "query, tool",
    [
        ("그래프 상태 확인해줘", "check_graph_status"), ("OHE-00730 한자 조회해줘", "lookup_hanja"), ("牧 한자는 인명용으로 허용되나요?", "check_person_name_hanja"),
        ("목 오행 상생 상극 관계 알려줘", "get_ohaeng_relations"), ("목 오행이고 밝은 뜻 한자 추천해줘", "recommend_hanja_by_ohaeng"), ("오늘 날씨", "unsupported"),
    ],
)
def test_routing_samples(spark, query, tool):
    df = Q.classified(spark.createDataFrame([(1, query)], "id long, query string"), "query")
    assert df.first()["tool"] == tool


def test_surname_with_character(spark):
    rows = [(1, "임씨(任) 이름"), (2, "임(林)씨 이름"), (3, "박씨 성 木오행 朴 이름"), (4, "최씨 이름"), (5, "정씨 漢漢漢 崔 鄭"), (6, "이름")]
    known = spark.createDataFrame([("任", "화"), ("鄭", "토"), ("木", "목")], "hanja string, resource_ohaeng string")
    got = L.resolve_surnames(spark.createDataFrame(rows, "id long, q string"), known, "id", "q")
    found = {r["id"]: (r["surname"], r["hanja"], r["resource_ohaeng"]) for r in got.collect()}
    assert found == {1: ("임", "任", "화"), 2: ("임", "林", ""), 3: ("박", "朴", ""), 4: ("최", "", ""), 5: ("정", "鄭", "토"), 6: ("", "", "")}


def test_greedy_character_drop(spark):
    def section(i, chars):
        return f"\n## [이름 {i}] 가나다 ({chars})\n줄"

    text = "앞" + section(1, "甲乙") + section(2, "乙丙") + section(3, "丙丁") + section(4, "戊己")
    df = spark.createDataFrame([(1, text), (2, "없음")], "id long, text string")
    got = {r["id"]: r["text"] for r in A.repeated_characters_dropped(df, "text").collect()}
    assert got == {1: "앞" + section(1, "甲乙") + section(2, "丙丁") + section(3, "戊己"), 2: "없음"}


def test_drop_keeps_everything_when_nothing_is_left(spark):
    text = "\n## [이름 3] 가나가 (甲乙)\n줄 — 상극\n"
    df = spark.createDataFrame([(1, text, "가")], "id long, text string, surname string")
    assert A.clashes_dropped(df, "text").first()["text"] == text
    assert A.surname_sounds_dropped(df, "text", "surname").first()["text"] == text


def test_verdict_both_directions(spark):
    text = "임씨(목) → 첫째(금) → 둘째(수) — 상생\n임씨(금) → 이름(목) — 좋음"
    assert one(spark, A.verdicts_corrected(F.lit(text))) == "임씨(목) → 첫째(금) → 둘째(수) — 상극\n임씨(금) → 이름(목) — 상극"


def test_sound_lists(spark):
    assert one(spark, A.sound_lists(F.lit('x [["서","연"],["a","지"],[]] y'))) == [["서", "연"], ["지"]]
    assert one(spark, A.sound_lists(F.lit("nothing"))) == []


def test_conversation_cases(spark):
    rows = [
        (1, 0, "user", "김씨 딸 이름 지어줘"), (1, 1, "assistant", "아래 정보를 알려주세요"), (1, 2, "user", "한자 이름, 金"), (1, 3, "assistant", "## [이름 1] 김서연 (徐姸)"),
        (1, 4, "user", "2개 더 추천해줘"), (1, 5, "assistant", "## [이름 1] 김하나 (河娜)"), (1, 6, "user", "순우리말 이름도 추가로"), (1, 7, "user", "다른 질문"), (2, 0, "user", "2개 더"),
    ]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = {(r["conv"], r["turn"]): (r["kind"], r["query"]) for r in D.resolved_requests(df, "conv", "turn", "role", "text").collect()}
    assert got[1, 2] == ("clarified", "김씨 딸 이름 지어줘 한자 이름, 金")
    assert got[1, 4] == ("continued", "한자 이름, 金 2개 추천해줘 (이미 추천한 이름: 김서연 제외)")
    assert got[1, 6] == ("switched", "김씨 딸 이름 지어줘 순우리말 3개 추천해줘 성씨 한자: 金 (이미 추천한 이름: 김서연, 김하나 제외)")
    assert got[1, 7][0] == "unchanged" and got[2, 0] == ("unchanged", "2개 더")


def test_carried_across_blocks(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    out = carried(df, ["k"], "t", {"first": (F.col("t") >= 10, F.col("t"))}, {"last": (F.col("t") % 10 < 2, F.col("t"))}, {"all": F.array("t")}, block=8)
    for r in out.collect():
        before = [t for t in range(r["t"]) if t % 2 == r["k"]]
        assert r["all"] == before
        assert r["first"] == next((t for t in before if t >= 10), None)
        assert r["last"] == next((t for t in reversed(before) if t % 10 < 2), None)


def test_running_index_over_blocks(spark):
    df = spark.range(0, 500, 7).select((F.col("id") * 3).alias("seq"))
    rows = running_index(df, "seq", block=50).orderBy("seq").collect()
    assert [r["idx"] for r in rows] == list(range(1, len(rows) + 1))


def test_permutation_is_complete(spark):
    rows = permuted(spark.range(1000).withColumn("kind", F.lit("a")), ["kind"], "id", "s").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 1001)) and rows[0]["size"] == 1000


def test_first_per_key_is_partial(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    limited = top_per_key(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in limited


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 30))], [rng.choice("abcde") for _ in range(rng.randint(0, 30))]) for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "id long, p string, r string")
    got = {r["id"]: r["lcs"] for r in V.rouge_l(df, "id", "p", "r").collect()}
    assert got == {i: _lcs(a, b) for i, (a, b) in enumerate(pairs)}


def test_bleu_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id long, p string, r string")
    assert V.bleu(V.ngram_overlap(df, "id", "p", "r", 4)).first()["bleu"] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"a": 4.0, "b": "2", "c": 5, "reason": "r"}', (4, 2, 5, "r")), ('```json\n{"a": 1, "b": 2}\n```', (1, 2, 0, "")), ('{"a": "3.0", "b": 1, "c": 1}', (0, 0, 0, "[평가 오류]")),
        ('{"a": null, "b": 1, "c": 1}', (0, 0, 0, "[평가 오류]")), ("none", (0, 0, 0, "[평가 오류]")),
    ],
)
def test_judge_replies(spark, reply, want):
    df = V.judged(spark.createDataFrame([(reply,)], "raw string"), "raw", ("a", "b", "c"))
    assert tuple(df.select("a", "b", "c", "reason").first()) == want


def test_boxes_on_a_grid_against_brute_force(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            x, y = rng.randint(-20, 90), rng.randint(40, 44)
            out.append((i, rng.randint(1, 2), float(x), float(y), float(x + rng.randint(0, 30)), float(y + rng.randint(0, 3))))
        return out

    objects, boxes = some(300), some(40)
    schema = "id int, page int, x0 double, top double, x1 double, bottom double"
    kept = K.outside_boxes(spark.createDataFrame(objects, schema), spark.createDataFrame(boxes, schema), ["id"], (8.0, 2.0))
    want = {o[0] for o in objects if not any(o[1] == b[1] and o[4] > b[2] and o[2] < b[4] and o[5] > b[3] and o[3] < b[5] for b in boxes)}
    assert {r.id for r in kept.collect()} == want and 0 < len(want) < 300


def test_rules_behind_literals_change_what_their_patterns_change(spark):
    patterns = {
        "pos_fixed": C.POS_TAG, "particle_fixed": C.PARTICLE, "eotda_fixed": C.ENDING, "quote_particle_fixed": C.AFTER_QUOTE,
        "noise_bracket_fixed": C.NOISE_BRACKET, "double_mi_fixed": r"\[\[미\]", "def_marker_at_fixed": C.DEFINITION_MARK,
    }
    tags = [f"{tag}!" for tag in ("명의", "의존명사", "접사", "명", "동", "형", "부", "관", "수", "대", "감")]
    lines = spark.createDataFrame([(t,) for t in [*NOISE, *tags, "끼가", "3끼 가", "9 가", "하늘틀 ", "하늘름.", "하늘률]", "하늘논 ", "", None]], "line string")
    for rule in C.RULES:
        row = lines.select("line", rule.apply(F.col("line")).alias("to"), rule.count(F.col("line")).alias("n"))
        if rule.name in patterns:
            same = F.col("n") == F.regexp_count("line", F.lit(patterns[rule.name]))
            assert row.filter(~same & ~F.lit(rule.name in ("eotda_fixed", "double_mi_fixed"))).count() == 0, rule.name
            assert row.filter((F.col("to") != F.col("line")) & ~F.col("line").rlike(patterns[rule.name])).count() == 0, rule.name
            assert row.filter(F.col("line").rlike(patterns[rule.name]) & (F.col("n") == 0)).count() == 0, rule.name
        assert row.filter("line is null and (to is not null)").count() == 0
    plan = C.rule_counts(lines, "line")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the counts themselves; cleaned lines are not made
    assert "Contains" in plan or "CONTAINS" in plan.upper()
