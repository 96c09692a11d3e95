"""Deterministic audit of generated answers, in bulk.

An answer is one row; its sections are an array inside the row, so the drops, repairs and
renumbering need no shuffle. Only facts about characters are joined in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import frames as FR
from namesmith.functions.once import bound, computed_once
from namesmith.functions.order import first_per_key, top_per_key
from namesmith.functions.text import HANGUL, HANJA, extract, strip
from namesmith.operators.chunk import sections_of

# Patterns of the answer format.
HEADER_NAME = rf"##\s*\[이름\s*\d+\]\s*([{HANGUL}]{{2,5}})"
HEADER_CHARS = rf"##\s*\[이름\s*\d+\]\s*[{HANGUL}]+\s*\(([{HANJA}]+)\)"
CHAR_LINE = rf"글자\(([{HANJA}])\)"
CLASH = "— 상극"
DONE = "[수리 계산 완료]"


def rewritten(text: Column, pattern: str, fix: Callable[[Column, Column], Column]) -> Column:
    """Replace every match by ``fix(match, index)``: pieces and matches are zipped again."""
    def whole(t: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda m, i: fix(m, i))
        return F.array_join(F.zip_with(F.split(t, pattern), matches, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return bound(text, whole)


def character_facts(answers: DataFrame, answer_id: str, text: str, dictionary: DataFrame, value: str) -> DataFrame:
    """Add ``facts``: map from the characters of each answer to a dictionary value."""
    seen = answers.select(answer_id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{HANJA}])"), F.lit(1)))).alias("hanja"))
    known = seen.join(dictionary.select("hanja", F.col(value).alias("_v")), "hanja")
    maps = known.groupBy(answer_id).agg(F.map_from_entries(F.collect_list(F.struct("hanja", "_v"))).alias("facts"))
    return answers.join(maps, answer_id, "left")


def dictionary_of(profiles: DataFrame, value: str, order: str) -> DataFrame:
    """Last known value per character; a count of 0 and a blank reading are not known."""
    usable = profiles.filter(~F.col(value).cast("string").isin("", "0")).select("hanja", order, value)
    return first_per_key(usable, ["hanja"], [order], last=True).select("hanja", value)


# -- facts in the text ------------------------------------------------------------------

def stroke_lines(text: Column, facts: Column) -> Column:
    """On lines about a character, every ``N획`` becomes the count of ``facts``, a map by character."""
    def line(t: Column) -> Column:
        def struck(right: Column) -> Column:
            return F.when(right.isNotNull(), F.regexp_replace(t, F.lit(r"\d+획"), F.concat(right.cast("string"), F.lit("획")))).otherwise(t)

        return bound(F.try_element_at(facts, extract(t, CHAR_LINE)), struck)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def strokes_corrected(answers: DataFrame, answer_id: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Stroke counts of a dictionary in place of those printed."""
    with_facts = character_facts(answers, answer_id, text, dictionary.filter("strokes > 0"), "strokes")
    return with_facts.withColumn(text, stroke_lines(F.col(text), F.col("facts"))).drop("facts")


_ONE = f"[{E.LABELS}]"
FLOW_THREE = rf"[{HANGUL}]{{1,4}}씨\({_ONE}\)\s*→\s*첫째\({_ONE}\)\s*→\s*둘째\({_ONE}\)\s*—\s*[^\n]+"
FLOW_TWO = rf"[{HANGUL}]{{1,4}}씨\({_ONE}\)\s*→\s*이름\({_ONE}\)\s*—\s*[^\n]+"


def verdicts_corrected(text: Column) -> Column:
    """Recompute the verdict of every printed element flow."""
    def read(m: Column, shown: Callable[[Column, Column, Column], Column]) -> Column:
        """``shown`` of the surname in front, the labels and the relation of each label to the next."""
        prefix = F.regexp_extract(m, rf"^([{HANGUL}]{{1,4}}씨)", 1)

        def related(labels: Column) -> Column:
            codes = F.transform(labels, E.code_of)
            steps = F.transform(F.arrays_zip(F.slice(codes, 1, 2).alias("a"), F.slice(codes, 2, 2).alias("b")), lambda p: bound(E.distance(p["a"], p["b"]), E.relation_of))
            return bound(steps, lambda r: shown(prefix, labels, r))

        return bound(F.regexp_extract_all(m, F.lit(rf"\(({_ONE})\)"), F.lit(1)), related)

    def at(items: Column, i: int) -> Column:
        return F.get(items, F.lit(i))

    def three(m: Column, _i: Column) -> Column:
        return read(m, lambda p, x, r: F.concat(p, F.lit("("), at(x, 0), F.lit(") → 첫째("), at(x, 1), F.lit(") → 둘째("), at(x, 2), F.lit(") — "), E.overall_relation(at(r, 0), at(r, 1))))

    def two(m: Column, _i: Column) -> Column:
        return read(m, lambda p, x, r: F.concat(p, F.lit("("), at(x, 0), F.lit(") → 이름("), at(x, 1), F.lit(") — "), at(r, 0)))

    return rewritten(rewritten(text, FLOW_THREE, three), FLOW_TWO, two)


def with_grade_map(df: DataFrame, grades: DataFrame) -> DataFrame:
    """Add ``grade_map``: the 81 grades as one map."""
    one = grades.agg(F.map_from_entries(F.collect_list(F.struct("num", "grade"))).alias("grade_map")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


_BLOCKS = r"(?=## \[이름 \d+\])"


def frames_injected(text: Column, surname_strokes: Column, grade_map: Column) -> Column:
    """Computed frames per section, replacing the printed line or put after the flow line."""
    def number(block: Column, label: str) -> Column:
        return extract(block, rf"{label} 글자\([^)]+\)[^,\n]+,\s*(\d+)획").try_cast("int")

    def shown(name: str, n: Column) -> Column:
        grade = F.coalesce(F.try_element_at(grade_map, FR.wrapped(n).cast("int")), F.lit("?"))
        return F.concat(F.lit(name), n, F.lit("("), grade, F.lit(")"))

    def counted(b: Column) -> Column:
        return F.struct(b.alias("b"), number(b, "첫째").alias("s1"), number(b, "둘째").alias("s2"), number(b, "이름").alias("one"))

    def lined(x: Column) -> Column:
        s1, s2, single = x["s1"], x["s2"], x["one"]
        short = F.concat_ws(", ", shown("원격", single), shown("형격", surname_strokes + single))
        full = F.concat_ws(
            ", ", shown("원격", s1 + s2), shown("형격", surname_strokes + s1), shown("이격", surname_strokes + s2), shown("정격", surname_strokes + s1 + s2)
        )
        line = F.concat(F.lit("**수리**: "), F.when(single.isNotNull(), short).when(s1.isNotNull() & s2.isNotNull(), full))
        return F.struct(x["b"].alias("b"), line.alias("line"))

    def fixed(x: Column) -> Column:
        block, line = x["b"], x["line"]
        replaced = F.regexp_replace(block, F.lit(r"\*\*수리\*\*:.*"), line)
        inserted = F.regexp_replace(block, F.lit(r"(\*\*오행 흐름\*\*:[^\n]+)"), F.concat(F.lit("$1\n"), line))
        changed = F.when(block.contains("**수리**:"), replaced).otherwise(inserted)
        usable = block.startswith("## [이름") & ~block.contains(DONE) & line.isNotNull()
        return F.when(usable, changed).otherwise(block)

    blocks = F.transform(F.transform(F.split(text, _BLOCKS), counted), lined)
    return F.when(surname_strokes > 0, F.array_join(F.transform(blocks, fixed), "")).otherwise(text)


# -- drops --------------------------------------------------------------------------------

def _numbered(sections: Column) -> Column:
    return F.transform(
        sections, lambda s, i: F.regexp_replace(s, F.lit(r"(?s)^(.*?## \[이름 )\d+(\])"), F.concat(F.lit("$1"), (i + 1).cast("string"), F.lit("$2")))
    )


def _sections(text: Column) -> Column:
    behind = lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    return F.filter(bound(sections_of(text), behind), lambda s: s.contains("## [이름"))


def _rendered(df: DataFrame, text: str, always: bool) -> DataFrame:
    """Survivors renumbered behind the preamble; unchanged if nothing or everything is left."""
    preamble = F.regexp_replace(F.get(sections_of(F.col(text)), F.lit(0)), r"^\n+", "")
    new = F.concat(preamble, F.array_join(_numbered(F.col("_valid")), ""))
    same = F.size("_valid") == 0
    if not always:
        same = same | (F.size("_valid") == F.size("_all"))
    return df.withColumn(text, F.when(same, F.col(text)).otherwise(new)).drop("_all", "_valid")


def _dropped(answers: DataFrame, text: str, valid: Callable[[Column], Column], always: bool = False) -> DataFrame:
    df = computed_once(answers, {"_all": _sections(F.col(text))})
    return _rendered(computed_once(df, {"_valid": valid(F.col("_all"))}), text, always)


def clashes_dropped(answers: DataFrame, text: str) -> DataFrame:
    return _dropped(answers, text, lambda all_: F.filter(all_, lambda s: ~s.contains(CLASH)), always=True)


def repeated_sounds_dropped(answers: DataFrame, text: str) -> DataFrame:
    """First name per reading without the surname syllable; unreadable headers stay."""
    df = computed_once(answers, {"_all": _sections(F.col(text))})
    sounds = F.transform("_all", lambda s: F.substring(F.regexp_extract(s, HEADER_NAME, 1), 2, 10))
    named = F.transform("_all", lambda s: s.rlike(HEADER_NAME))
    df = computed_once(df, {"_sounds": F.zip_with(sounds, named, lambda s, n: F.when(n, s))})
    valid = F.filter("_all", lambda _s, i: F.get("_sounds", i).isNull() | (F.array_position("_sounds", F.get("_sounds", i)) == i + 1))
    return _rendered(computed_once(df, {"_valid": valid}).drop("_sounds"), text, False)


def repeated_characters_dropped(answers: DataFrame, text: str) -> DataFrame:
    """Greedy: a name goes if it shares a character with an earlier name that stayed."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("seen"), empty.alias("kept"))

    def step(state: Column, s: Column) -> Column:
        chars = F.filter(F.split(F.regexp_extract(s, HEADER_CHARS, 1), ""), lambda c: c != "")
        clash = F.arrays_overlap(state["seen"], chars)
        return F.struct(
            F.when(clash, state["seen"]).otherwise(F.concat(state["seen"], chars)).alias("seen"),
            F.when(clash, state["kept"]).otherwise(F.array_append(state["kept"], s)).alias("kept"),
        )

    return _dropped(answers, text, lambda all_: F.aggregate(all_, start, step)["kept"])


def surname_sounds_dropped(answers: DataFrame, text: str, surname: str) -> DataFrame:
    """Names that end in the surname's syllable go."""
    def keep(s: Column) -> Column:
        name = F.regexp_extract(s, HEADER_NAME, 1)
        return (name == "") | (F.substring(name, -1, 1) != F.col(surname)) | (F.col(surname) == "")

    return _dropped(answers, text, lambda all_: F.filter(all_, keep))


def poor_frames_dropped(answers: DataFrame, text: str) -> DataFrame:
    """Sections with the worst grade on hyung, yi or won go; the text stays if all would."""
    df = computed_once(answers, {text: F.col(text)})
    df = computed_once(df, {"_parts": F.split(text, _BLOCKS)})

    def keep(b: Column) -> Column:
        line = F.regexp_extract(b, r"\*\*수리\*\*:(.+)", 1)
        worst = F.lit(False)
        for frame in ("형격", "이격", "원격"):
            worst = worst | (F.regexp_extract(line, rf"{frame}\d+\(([^)]+)\)", 1) == FR.WORST)
        return b.startswith("## [이름") & ~worst

    df = computed_once(df, {"_kept": F.filter("_parts", keep)})
    head = F.get("_parts", F.lit(0))
    new = F.concat(F.when(head.startswith("## [이름"), F.lit("")).otherwise(head), F.array_join(_numbered(F.col("_kept")), ""))
    return df.withColumn(text, F.when(F.size("_kept") == 0, F.col(text)).otherwise(new)).drop("_parts", "_kept")


# -- repairs --------------------------------------------------------------------------------

FIX_ORDER = ("화", "토", "금", "수", "목")


def replacement_pools(permitted: DataFrame, flagged: DataFrame, order: str) -> DataFrame:
    """(reading, element) to the characters a repair may offer, in order."""
    keys = ["hangul", "resource_ohaeng"]
    first = top_per_key(permitted, keys, [F.col(order)], 5, "_r")
    rest = flagged.join(permitted.select(*keys).distinct(), keys, "left_anti")
    pool = first.unionByName(top_per_key(rest, keys, [F.col(order)], 6, "_r"))
    return pool.groupBy(F.col("hangul").alias("reading"), F.col("resource_ohaeng").alias("fix")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "hanja"))), lambda c: c["hanja"]).alias("chars")
    )


def replacements(answers: DataFrame, answer_id: str, text: str, surname_element: str, readings: DataFrame, pools: DataFrame) -> DataFrame:
    """Proposals for clashing names: second character first, then the first; elements in a
    fixed order; the first combination with a candidate other than the character itself."""
    pattern = rf"글자\([{HANJA}]\)[^\n]+\[{_ONE}\]"
    rows = answers.select(answer_id, F.col(surname_element).alias("_se"), F.explode(_sections(F.col(text))).alias("_s")).filter(F.col("_s").contains(CLASH))
    found = F.regexp_extract_all("_s", F.lit(f"({pattern})"), F.lit(1))
    rows = computed_once(rows, {"_idx": F.regexp_extract("_s", r"## \[이름 (\d+)\]", 1), "_found": found}).filter(F.size("_found") >= 2)

    def char(i: int) -> Column:
        return F.regexp_extract(F.get("_found", F.lit(i)), CHAR_LINE, 1)

    def element(i: int) -> Column:
        return E.code_of(F.regexp_extract(F.get("_found", F.lit(i)), rf"\[({_ONE})\]$", 1))

    rows = computed_once(rows.drop("_s"), {"c1": char(0), "c2": char(1), "e1": element(0), "e2": element(1), "es": E.code_of(F.col("_se"))})

    def clash(a: Column, b: Column) -> Column:
        return E.name_relation(a, b) == "상극"

    order = F.array(*[F.lit(x) for x in FIX_ORDER])
    second = F.filter(order, lambda o: ~clash(F.col("e1"), E.code_of(o)) & ~clash(F.col("es"), F.col("e1")))
    first = F.filter(order, lambda o: ~clash(F.col("es"), E.code_of(o)) & ~clash(E.code_of(o), F.col("e2")))
    options = F.concat(
        F.transform(second, lambda o: F.struct(F.lit(0).alias("turn"), F.col("c2").alias("target"), o.alias("fix"))),
        F.transform(first, lambda o: F.struct(F.lit(1).alias("turn"), F.col("c1").alias("target"), o.alias("fix"))),
    )
    tried = rows.select(answer_id, "_idx", F.explode(options).alias("_o")).select(answer_id, F.col("_idx").alias("name_idx"), "_o.*")
    offered = (
        tried.join(readings.select(F.col("hanja").alias("target"), F.col("hangul").alias("reading")), "target")
        .join(pools, ["reading", "fix"])
        .withColumn("chars", F.array_remove("chars", F.col("target")))
        .filter(F.size("chars") > 0)
    )
    rank = F.struct("turn", F.array_position(order, F.col("fix")))
    best = offered.groupBy(answer_id, "name_idx").agg(F.min_by(F.struct("target", "reading", "fix", "chars"), rank).alias("_b"))
    return best.select(answer_id, "name_idx", "_b.target", "_b.reading", "_b.fix", F.array_join(F.slice("_b.chars", 1, 5), ",").alias("candidates"))


def reading_headers(text: Column, surname: Column, facts: Column) -> Column:
    """Headers that spell the name in characters get its reading from ``facts``, if every character is known."""
    pattern = rf"##\s*\[이름\s*\d+\]\s*[{HANGUL}{HANJA}]{{2,8}}\s*\([{HANJA}]{{1,4}}\)"

    def fix(m: Column, _i: Column) -> Column:
        n = F.regexp_extract(m, r"\[이름\s*(\d+)\]", 1)
        name = F.regexp_extract(m, rf"\]\s*([{HANGUL}{HANJA}]{{2,8}})\s*\(", 1)
        inside = F.regexp_extract(m, rf"\(([{HANJA}]{{1,4}})\)$", 1)

        def headed(read: Column) -> Column:
            known = ~F.exists(read, lambda r: r.isNull()) & facts.isNotNull()
            header = F.concat(F.lit("## [이름 "), n, F.lit("] "), surname, F.array_join(read, ""), F.lit(" ("), inside, F.lit(")"))
            return F.when(known, header).otherwise(m)

        read = F.transform(F.filter(F.split(inside, ""), lambda c: c != ""), lambda c: F.try_element_at(facts, c))
        return F.when(name.rlike(f"[{HANJA}]"), bound(read, headed)).otherwise(m)

    return F.when(F.coalesce(surname, F.lit("")) == "", text).otherwise(rewritten(text, pattern, fix))


def character_headers_fixed(answers: DataFrame, answer_id: str, text: str, surname: str, readings: DataFrame) -> DataFrame:
    """Readings of a dictionary in headers that spell the name in characters."""
    with_facts = character_facts(answers, answer_id, text, readings, "hangul")
    return with_facts.withColumn(text, reading_headers(F.col(text), F.col(surname), F.col("facts"))).drop("facts")


def broken_headers_fixed(text: Column) -> Column:
    """``## [가나다] 이름 (字字)`` to a numbered header, counting from 1 per answer."""
    pattern = rf"##\s*\[[{HANGUL}]{{2,5}}\]\s*(?:전체이름|이름)\s*\([^)\n]+\)"

    def fix(m: Column, i: Column) -> Column:
        name = F.regexp_extract(m, rf"\[([{HANGUL}]{{2,5}})\]", 1)
        return F.concat(F.lit("## [이름 "), i + 1, F.lit("] "), name, F.lit(" ("), F.regexp_extract(m, r"\(([^)\n]+)\)$", 1), F.lit(")"))

    return rewritten(text, pattern, fix)


# The closing notice.
DISCLAIMER = "\n\n---\n\n⚠️ 면책 고지: 추천 이름의 출생신고 가능 여부를 100% 보장하지 않습니다. 최종 확인은 관할 기관을 통해 진행하세요."


def finished(text: Column, query: Column) -> Column:
    """A note where fewer names came than were asked for, and the disclaimer once."""
    asked = extract(query, r"(\d+)\s*개").try_cast("decimal(38,0)")
    given = F.regexp_count(text, F.lit(r"## \[이름 \d+\]"))
    note = F.concat(F.lit("요청하신 "), asked, F.lit("개 중 수리·오행 조건에 부합하는 이름 "), given, F.lit("개를 추천드립니다.\n\n"))
    out = F.when((given > 0) & (given < asked), F.concat(note, text)).otherwise(text)
    return F.concat(out, F.when(out.contains("면책 고지"), F.lit("")).otherwise(F.lit(DISCLAIMER)))


# -- replies of other checks ----------------------------------------------------------------

def _spoken(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))


def verdict_issues(replies: DataFrame, reply_id: str, raw: str) -> DataFrame:
    """Issue lines ``[이름 N] X(…)`` and ``[이름 N] 말:``; none where nothing is wrong."""
    clean = _spoken(F.col(raw))
    chars = rf"\[이름\s*\d+\]\s*[{HANJA}]+\([{HANGUL}]+\)"
    words = rf"\[이름\s*\d+\]\s*[{HANGUL}]+:"
    rows = computed_once(replies.select(reply_id, raw), {"_clean": clean}).filter(~F.col("_clean").contains("이상 없음"))
    found = F.concat(F.regexp_extract_all("_clean", F.lit(f"({chars})"), F.lit(1)), F.regexp_extract_all("_clean", F.lit(f"({words})"), F.lit(1)))
    hits = rows.select(reply_id, F.explode(found).alias("_m"))
    return hits.select(
        reply_id, F.regexp_extract("_m", r"\[이름\s*(\d+)\]", 1).alias("name_idx"), F.regexp_extract("_m", rf"\]\s*([{HANJA}]+)\(", 1).alias("hanja"),
        F.coalesce(extract(F.col("_m"), rf"\(([{HANGUL}]+)\)$"), F.regexp_extract("_m", rf"\]\s*([{HANGUL}]+):", 1)).alias("hangul"),
    )


def sound_lists(raw: Column) -> Column:
    """Array of sound combinations in a reply; items that are not Hangul are left out, and
    anything but a list of lists is an empty result."""
    body = extract(_spoken(raw), r"(?s)(\[.*\])")
    parsed = F.from_json(body, "ARRAY<ARRAY<STRING>>")
    lists = F.filter(F.coalesce(parsed, F.array().cast("array<array<string>>")), lambda c: F.size(c) > 0)
    return F.transform(lists, lambda combo: F.filter(combo, lambda s: s.rlike(rf"^[{HANGUL}]+$")))
