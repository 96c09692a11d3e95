"""The audit chain on small replies."""

from namesmith.operators import chain as CH
from namesmith.plans import standins as S


def section(n, name, chars, s1, s2, flow="중립", extra=""):
    return f"## [이름 {n}] {name} ({chars})\n- 첫째 글자({chars[0]}): 가, {s1}획 [목]\n- 둘째 글자({chars[-1]}): 나, {s2}획 [화]\n**오행 흐름**: 흐름 — {flow}{extra}"


def run(spark, replies, strokes=(), readings=()):
    rows = [(i, t, "김", "金", k, native) for i, (t, k, native) in enumerate(replies)]
    df = spark.createDataFrame(rows, "id long, raw string, surname string, surname_hanja string, surname_strokes int, native boolean")
    out = CH.audited(df, "id", "raw", spark.createDataFrame(list(strokes), "hanja string, strokes int"), spark.createDataFrame(list(readings), "hanja string, hangul string"), S.grades(spark))
    return [r.text for r in out.orderBy("id").collect()]


def test_chain(spark):
    plain = f"머리\n{section(1, '김가나', '甲乙', 1, 3)}\n{section(2, '김다라', '丙丁', 2, 4, '상극')}\n{section(3, '김마바', '戊乙', 1, 3)}"
    got = run(spark, [
        (plain, 0, False), (plain, 0, True), (None, 3, False), ("<think>all of it</think>", 3, False), ("이름 없음\n\n[참고 정보]\n## [이름 1] 김가나 (甲乙)", 3, False),
        (f"{section(7, '김가나', '甲乙', 1, 3, '상극')}\n{section(9, '김가나', '丙丁', 2, 4, '상극')}", 0, True),
        ("## [이름 4] 甲乙 (金甲乙)\n- 이름 글자(甲): 가, 9획 [목]\n**수리**: 원격9(吉)", 2, False),
        (f"{section(1, '김가나', '甲乙', 3, 4)}\n\n{section(2, '김다라', '丙丁', 1, 1)}\n", 0, False),
        (f"{section(5, '김가나', '甲乙', 1, 1, extra=chr(10) + '**수리**: 형격7(大凶)')}\n{section(6, '김다김', '丙丁', 1, 1)}", 0, False),
    ], [("甲", 8)], [("甲", "갑"), ("乙", "을")])
    # a clash goes, then the name that shares a character; native names may share one
    assert [got[0].count("## [이름"), "甲乙" in got[0], "戊乙" in got[0]] == [1, True, False]
    assert "## [이름 1] 김가나" in got[1] and "## [이름 2] 김마바" in got[1] and "丙丁" not in got[1]
    assert got[2:5] == ["", "<think>all of it</think>", "이름 없음"]
    # all clash: they stay, and the repeated reading goes and numbers change
    assert got[5].startswith("\n## [이름 1] 김가나 (甲乙)") and got[5].count("## [이름") == 1
    # one character: surname out of the bracket, reading for characters, dictionary strokes, frames of one character
    grade = {r.num: r.grade for r in S.grades(spark).collect()}
    assert got[6] == f"## [이름 1] 김갑을 (甲乙)\n- 이름 글자(甲): 가, 8획 [목]\n**수리**: 원격8({grade[8]}), 형격10({grade[10]})"
    assert got[7].startswith("## [이름 1]") and got[7].count("\n\n## [이름 2]") == 1
    # the worst frame goes, and what is left is the only name, even with the surname's sound
    assert got[8] == section(1, "김다김", "丙丁", 1, 1)
