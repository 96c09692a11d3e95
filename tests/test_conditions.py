"""Substring conditions and best names against brute force."""

from namesmith.operators import lookups as L
from namesmith.operators import names
from namesmith.plans import standins as S


def test_containing_is_contains(spark):
    texts = ["밝을 명", "밝고 맑다", "a.b*c", "ab", "b", "", None, "aab", "abab", "x\U00020000y", "명 명"]
    words = ["밝", "밝을", "명", "b*", ".", "ab", "aa", "ba", "zz", "az", "\U00020000", "x\U00020000y", "밝을 명이", "aab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id int, t string")
    asked = spark.createDataFrame([(w,) for w in words * 2], "w string")
    got = {(r.w, r.id) for r in L.containing(asked, "w", rows, "t", ["id"]).collect()}
    assert got == {(w, i) for w in words for i, t in enumerate(texts * 2) if t and w in t}


def test_best_names_use_every_character(spark):
    """Many characters of one reading and class, the better ones last by id, and repeated characters."""
    grade = {r.num: r.grade for r in S.grades(spark).collect()}
    chars = [(f"P{i:03d}", "가나다라"[i * i % 4], "甲乙丙丁戊己庚辛壬癸"[i * 7 % 10], (i * 11) % 13 + 1, "목화토금수"[i % 5], i % 6 != 0) for i in range(90)]
    chars += [(f"Q{i:02d}", "나", "甲", 3, "목", True) for i in range(12)]
    surnames = [(j, "김", "가나다마"[j % 4], j % 9 + 1, "목화토금수"[j % 5]) for j in range(12)]
    df = spark.createDataFrame(chars, "profile_id string, hangul string, hanja string, strokes int, resource_ohaeng string, is_person_name_hanja boolean")
    sur = spark.createDataFrame(surnames, "surname_id long, hanja string, hangul string, strokes int, resource_ohaeng string")
    got = {}
    for r in names.best_two_character_names(sur, df, S.grades(spark)).collect():
        got.setdefault(r.surname_id, []).append((r["rank"], r.profile1, r.profile2))
    code = {c: k for k, c in enumerate("목화토금수")}
    of = lambda n: grade[(n - 1) % 81 + 1]
    for sid, _, r, ss, el in surnames:
        out = []
        for a in chars:
            for b in chars:
                e0, e1, e2 = code[el], code[a[4]], code[b[4]]
                if not (a[5] and b[5]) or r in (a[1], b[1]) or a[2] == b[2] or (e1 - e0) % 5 in (2, 3) or (e2 - e1) % 5 > 1:
                    continue
                frames = [of(a[3] + b[3]), of(ss + a[3]), of(ss + b[3]), of(ss + a[3] + b[3])]
                if "大凶" not in frames[:3]:
                    out.append((-sum(g in ("吉", "大吉", "半吉") for g in frames), a[3], b[3], a[0], b[0]))
        want = [(k, x[3], x[4]) for k, x in enumerate(sorted(out)[:10], 1)]
        assert sorted(got.get(sid, [])) == want, sid
