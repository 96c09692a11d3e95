"""Cleaning rules over lines made of noisy fragments and the documents' own lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators import clean as C
from namesmith.plans import Registry
from namesmith.plans import standins as S

AREA = Registry()

# Fragments with the faults the rules look for. {t} is the document line.
NOISE = (
    "{t}", "꾸중올 듣고 손흘 잡았다 올해 바올 {t}", "만들없다 가없다 밥없다 {t}", "끼가을 하늘 3끼 끼 {t}", "9 하늘 19 하늘 9  가 {t}",
    "'단어' 논 뜻 ‘말’눈 해 {t}", "하늘틀 이름 바다름, 군눈 사람눈 나무논. {t}", "엿기름 올 엿기틀, 시름시름 업시률 {t}", "[_] [47] [{ {] [명] [가나] {t}",
    "[[미] 비슷 [미] {t}", "[명] @가나 :@(다 아@하다 . @나 {t}", "'명] 「동] 형! 부; 관_ 수, 대~ 감) 의존명사- 접사. 명의] {t}", "농고서 농아두고 농고 농지 농았다 농고서 {t}",
    "=== PAGE 3 [본문] === {t}", "  12  ", "색  인 7", "아름답고  정겨운 우리말12 ", "[_]", "   ", "", "두   칸  {t}  ", "사람률 나무를 발틀 {t}\"", "집올", "값흘.",
)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): every document line inside one of the fragments."""
    noise = F.array(*[F.lit(x) for x in NOISE])
    lines = F.transform(
        F.split("text", "\n"),
        lambda t, i: F.replace(F.get(noise, ((F.col("doc_id") + i) % len(NOISE)).cast("int")), F.lit("{t}"), t),
    )
    exploded = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return exploded.withColumn("line_no", F.col("line_no") + 1)


S.VIEWS["ocr_lines"] = f"""SELECT doc_id, CAST(n AS INT) AS line_no, replace({S.sql_list(NOISE)}[CAST((doc_id + n - 1) % {len(NOISE)} AS INT) + 1], '{{t}}', t) AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""

# -- the same rules for the SQL side: no look-around there, so neighbours are captured or masked


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def cnt(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS INT)"


_CLOSED_SQL = "(unicode({c}) BETWEEN 44032 AND 55203 AND (unicode({c}) - 44032) % 28 <> 0)"
_HIT = (
    "s[i] IN ('올', '흘') AND i > 1 AND " + _CLOSED_SQL.format(c="s[i - 1]")
    + " AND (i = length(s) OR regexp_full_match(s[i + 1], '[ \\t\\n.,;:!?」』)>''가-힣]'))"
)


def particle_sql(x: str) -> str:
    hit = _HIT.replace("s[", f"{x}[").replace("length(s)", f"length({x})")
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {hit} THEN '을' ELSE {x}[i] END), '')"


def particle_n(x: str) -> str:
    hit = _HIT.replace("s[", f"{x}[").replace("length(s)", f"length({x})")
    return f"CAST(len(list_filter(range(1, length({x}) + 1), lambda i: {hit})) AS INT)"


def ending_sql(x: str) -> str:
    closed = _CLOSED_SQL.format(c=f"{x}[i - 1]")
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {x}[i] = '없' AND i > 1 AND {x}[i + 1] = '다' AND {closed} THEN '었' ELSE {x}[i] END), '')"


def literal_sql(x: str, pairs) -> str:
    for wrong, right in pairs:
        x = f"replace({x}, {q(wrong)}, {q(right)})"
    return x


def literal_n(x: str, pairs, per_line: bool) -> str:
    terms = []
    for wrong, right in pairs:
        terms.append(
            f"CAST(contains({x}, {q(wrong)}) AS INT)" if per_line else f"CAST((length({x}) - length(replace({x}, {q(wrong)}, ''))) / {len(wrong)} AS INT)"
        )
        x = f"replace({x}, {q(wrong)}, {q(right)})"
    return "(" + " + ".join(terms) + ")"


def marker_sql(x: str) -> str:
    return rep(rep(x, r"(^|[^\d])끼([가-힣\s])", r"\1¶\2"), r"(^|\s)9(\s+[가-힣])", r"\1¶\2")


_END = r"""([\s\]\)\.,;:'"<>])"""


def masked_sql(x: str, words: tuple[str, ...], marks: dict[str, int]) -> str:
    """Words that stay, their last syllable behind a mark."""
    for w in words:
        x = f"replace({x}, '{w}', '{w[:-1]}' || chr({marks[w[-1]]}))"
    return x


def reul_sql(x: str) -> str:
    masked = masked_sql(x, C.KEPT_REUL, {"름": 1, "틀": 2})
    return f"replace(replace({rep(masked, '([가-힣]{2})[틀름률]' + _END, chr(92) + '1를' + chr(92) + '2')}, chr(1), '름'), chr(2), '틀')"


def space_sql(x: str) -> str:
    masked = masked_sql(reul_sql(x), C.KEPT_NEUN, {"눈": 1})
    return f"replace({rep(masked, '([가-힣]{2})[논눈]' + _END, chr(92) + '1는' + chr(92) + '2')}, chr(1), '눈')"


def space_n(x: str) -> str:
    return f"({cnt(x, '[가-힣]{2}[틀름률]' + _END)} + {cnt(reul_sql(x), '[가-힣]{2}[논눈]' + _END)})"


def changed(sql, x: str) -> str:
    return f"CAST({sql(x)} <> {x} AS INT)"


_POS = r"""['\[「『]?\s*(명의|의존명사|접사|명|동|형|부|관|수|대|감)\s*[」\]!_,\.;\-\)~]"""
_QUOTE = r"""(['"‘’])\s*[논눈](\s)"""

SQL_RULES = {
    "nohta_fixed": (lambda x: literal_sql(x, C.VERB_FIXES), lambda x: literal_n(x, C.VERB_FIXES, True)),
    "pos_fixed": (lambda x: rep(x, _POS, r"[\1]"), lambda x: cnt(x, _POS)),
    "particle_fixed": (particle_sql, particle_n),
    "eotda_fixed": (ending_sql, lambda x: changed(ending_sql, x)),
    "marker_fixed": (marker_sql, lambda x: changed(marker_sql, x)),
    "quote_particle_fixed": (lambda x: rep(x, _QUOTE, r"\1는\2"), lambda x: cnt(x, _QUOTE)),
    "space_particle_fixed": (space_sql, space_n),
    "false_pos_restored": (lambda x: literal_sql(x, C.RESTORES), lambda x: literal_n(x, C.RESTORES, False)),
    "noise_bracket_fixed": (lambda x: rep(x, r"\[[^가-힣\]]{0,8}\]", ""), lambda x: cnt(x, r"\[[^가-힣\]]{0,8}\]")),
    "double_mi_fixed": (lambda x: rep(x, r"\[\[미\]", "[비]"), lambda x: changed(lambda y: rep(y, r"\[\[미\]", "[비]"), x)),
    "def_marker_at_fixed": (
        lambda x: rep(x, r"([\]>:.])(\s*)@([가-힣(])", r"\1\2 ¶\3"), lambda x: cnt(x, r"[\]>:.]\s*@[가-힣(]"),
    ),
}

_NAMES = {
    "c3_verb_forms": ("nohta_fixed",), "c4_part_of_speech_tags": ("pos_fixed",), "c5_object_particles": ("particle_fixed",),
    "c6_past_endings": ("eotda_fixed",), "c7_example_marks": ("marker_fixed",), "c8_particles_after_quotes": ("quote_particle_fixed",),
    "c9_particles_at_blanks": ("space_particle_fixed",), "c10_restored_words": ("false_pos_restored",),
    "c11_brackets_and_marks": ("noise_bracket_fixed", "double_mi_fixed", "def_marker_at_fixed"),
}


def _rule_query(rules: tuple[str, ...]):
    chosen = [r for r in C.RULES if r.name in rules]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = ocr_lines(spark, sf_dir).withColumn("n", F.lit(0))
        for rule in chosen:
            df = df.select("doc_id", "line_no", (F.col("n") + rule.count(F.col("line"))).alias("n"), rule.apply(F.col("line")).alias("line"))
        return df

    return run


def _rule_sql(rules: tuple[str, ...]) -> str:
    steps, source = {}, "ocr_lines"
    for i, name in enumerate(rules):
        apply, count = SQL_RULES[name]
        n = count("line") if i == 0 else f"n + {count('line')}"
        steps[f"t{i}"] = f"SELECT doc_id, line_no, CAST({n} AS INT) AS n, {apply('line')} AS line FROM {source}"
        source = f"t{i}"
    return S.with_views("ocr_lines", body=f"SELECT * FROM {source}", **steps)


for _name, _rules in _NAMES.items():
    AREA.add(_name, _rule_sql(_rules))(_rule_query(_rules))

_HEADER = "(" + " OR ".join(f"regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), {q(h)})" for h in C.HEADERS) + ")"


@AREA.add("c1_page_separators", S.with_views("ocr_lines", body="SELECT doc_id, line_no, line FROM ocr_lines WHERE starts_with(line, '=== PAGE')"))
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_lines(spark, sf_dir).filter(C.is_separator(F.col("line")))


@AREA.add("c2_without_headers", S.with_views("ocr_lines", body=f"SELECT doc_id, line_no, line FROM ocr_lines WHERE NOT {_HEADER}"))
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_lines(spark, sf_dir).filter(~C.is_header(F.col("line")))


def _chain() -> dict[str, str]:
    steps = {"t0": f"SELECT *, starts_with(line, '=== PAGE') AS sep, NOT starts_with(line, '=== PAGE') AND {_HEADER} AS head, line AS l FROM ocr_lines"}
    for i, (name, (apply, count)) in enumerate(SQL_RULES.items(), 1):
        steps[f"t{i}"] = (
            f"SELECT * EXCLUDE (l), CASE WHEN sep OR head THEN 0 ELSE {count('l')} END AS {name}, CASE WHEN sep OR head THEN l ELSE {apply('l')} END AS l FROM t{i - 1}"
        )
    return steps


_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_DONE = _TRIM.format(x="regexp_replace(l, ' {2,}', ' ', 'g')")


@AREA.add(
    "c12_clean_lines",
    S.with_views("ocr_lines", **_chain(), body=f"""SELECT doc_id, line_no, CASE WHEN sep THEN line ELSE {_DONE} END AS cleaned FROM t{len(SQL_RULES)}
      WHERE sep OR NOT head AND ({_DONE} <> '' OR {_TRIM.format(x='line')} = '')"""),
)
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_lines(ocr_lines(spark, sf_dir), "line").select("doc_id", "line_no", "cleaned")


@AREA.add(
    "c13_rule_counts",
    S.with_views("ocr_lines", **_chain(), body=f"""SELECT unnest({S.sql_list(['header_removed', *SQL_RULES])}) AS rule,
      unnest([CAST(sum(CAST(head AS INT)) AS BIGINT), {', '.join(f'CAST(sum({r}) AS BIGINT)' for r in SQL_RULES)}]) AS n FROM t{len(SQL_RULES)}"""),
)
def c13_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rule_counts(ocr_lines(spark, sf_dir), "line")


@AREA.add(
    "c13_change_log",
    S.with_views("ocr_lines", v=f"SELECT *, {literal_sql('line', C.VERB_FIXES)} AS b, starts_with(line, '=== PAGE') AS sep FROM ocr_lines",
      e=f"""SELECT doc_id, line_no, CASE WHEN NOT sep AND {_HEADER} THEN '[헤더삭제] ' || line WHEN NOT sep AND {rep('b', _POS, chr(91) + chr(92) + '1]')} <> b
        THEN '[품사태그 ' || {cnt('b', _POS)} || '건] ' || substr(b, 1, 60) || ' → ' || substr({rep('b', _POS, chr(91) + chr(92) + '1]')}, 1, 60) END AS entry FROM v""",
      body="SELECT * FROM e WHERE entry IS NOT NULL ORDER BY doc_id, line_no LIMIT 200"),
)
def c13_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.change_log(ocr_lines(spark, sf_dir), "line", ["doc_id", "line_no"])
