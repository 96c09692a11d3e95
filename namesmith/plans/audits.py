"""Audit operators over composed answers, one per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators import audit as A
from namesmith.operators import chain as CH
from namesmith.functions import text as X
from namesmith.plans import Registry
from namesmith.plans import candidates as CD
from namesmith.plans import segments as SG
from namesmith.plans import standins as S

AREA = Registry()

_NL = "chr(10)"
S.VIEWS["answer_lines"] = f"SELECT * EXCLUDE (text), unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS n FROM answers"
S.VIEWS["last_chars"] = "SELECT hanja, max_by(hangul, seq) AS hangul, max_by(strokes, seq) AS strokes FROM chars WHERE is_person_name_hanja GROUP BY 1"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.answers(spark, sf_dir)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chars(spark, sf_dir).filter("is_person_name_hanja")


_LINES = f"SELECT answer_id, string_agg(x, {_NL} ORDER BY n) AS text FROM l GROUP BY 1"


@AREA.add(
    "r1_corrected_strokes",
    S.with_views("chars", "answers", "answer_lines", "last_chars",
      l="SELECT answer_id, n, CASE WHEN c.strokes IS NOT NULL THEN regexp_replace(line, '\\d+획', c.strokes || '획', 'g') ELSE line END AS x FROM answer_lines a LEFT JOIN last_chars c ON c.hanja = regexp_extract(line, '글자\\(([一-鿿])\\)', 1)",
      body=_LINES),
)
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = A.dictionary_of(flagged(spark, sf_dir), "strokes", "seq")
    return A.strokes_corrected(answers(spark, sf_dir), "answer_id", "text", dictionary).select("answer_id", "text")


_FLOW = "'^(.*씨\\(([목화토금수])\\) → 첫째\\(([목화토금수])\\) → 둘째\\(([목화토금수])\\) — ).+$'"


def _flow_code(i: int) -> str:
    return f"(strpos('목화토금수', regexp_extract(line, {_FLOW}, {i})) - 1)"


@AREA.add(
    "r2_corrected_verdicts",
    S.with_views("answers", "answer_lines",
      v=f"SELECT answer_id, n, line, regexp_extract(line, {_FLOW}, 1) AS p, {S.relation_sql(_flow_code(2), _flow_code(3))} AS r1, {S.relation_sql(_flow_code(3), _flow_code(4))} AS r2 FROM answer_lines",
      l="SELECT answer_id, n, CASE WHEN p = '' THEN line ELSE p || CASE WHEN r1 = '상극' OR r2 = '상극' THEN '상극' WHEN r1 = '상생' AND r2 = '상생' THEN '상생' ELSE '중립' END END AS x FROM v",
      body=_LINES),
)
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("answer_id", A.verdicts_corrected(F.col("text")).alias("text"))


def _shown(name: str, n: str) -> str:
    return f"'{name}' || ({n}) || '(' || {S.grade_sql(n)} || ')'"


S.VIEWS["framed"] = f"""WITH x AS (SELECT s.answer_id, section_no, section, a.surname_strokes AS ss, CAST(regexp_extract(section, '첫째 글자\\([^)]+\\)[^,\\n]+,\\s*(\\d+)획', 1) AS INT) AS s1,
      CAST(regexp_extract(section, '둘째 글자\\([^)]+\\)[^,\\n]+,\\s*(\\d+)획', 1) AS INT) AS s2 FROM answer_sections s JOIN answers a USING (answer_id) WHERE section_no > 0),
    y AS (SELECT *, '**수리**: ' || {_shown('원격', 's1 + s2')} || ', ' || {_shown('형격', 'ss + s1')} || ', ' || {_shown('이격', 'ss + s2')} || ', ' || {_shown('정격', 'ss + s1 + s2')} AS line FROM x)
    SELECT answer_id, section_no, CASE WHEN ss = 0 OR contains(section, '[수리 계산 완료]') THEN section WHEN contains(section, '**수리**:') THEN regexp_replace(section, '\\*\\*수리\\*\\*:.*', line, 'g')
      ELSE regexp_replace(section, '(\\*\\*오행 흐름\\*\\*:[^\\n]+)', '\\1' || {_NL} || line, 'g') END AS section FROM y
    UNION ALL SELECT answer_id, section_no, section FROM answer_sections WHERE section_no = 0"""


@AREA.add("r3_injected_frames", S.with_views("answers", "answer_sections", "framed", body="SELECT answer_id, string_agg(section, '' ORDER BY section_no) AS text FROM framed GROUP BY 1"))
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.with_grade_map(answers(spark, sf_dir), S.grades(spark))
    return df.select("answer_id", A.frames_injected(F.col("text"), F.col("surname_strokes"), F.col("grade_map")).alias("text"))


def _drop_sql(keep: str, source: str = "answer_sections", always: bool = False, extra: str = "") -> str:
    """Shared SQL of the drops: sections kept by a condition, renumbered, with the fallback."""
    same = "kept = 0" if always else "(kept = 0 OR kept = total)"
    return f"""k AS (SELECT *, {keep} AS keep FROM {source} {extra} WHERE section_no > 0),
    c AS (SELECT answer_id, count_if(keep) AS kept, count(*) AS total, string_agg(CASE WHEN keep THEN regexp_replace(section, '(## \\[이름 )\\d+(\\])', '\\1' || rn || '\\2') END, '' ORDER BY section_no) AS body
      FROM (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY answer_id ORDER BY section_no) AS rn FROM k) GROUP BY 1)
    SELECT a.answer_id, CASE WHEN c.answer_id IS NULL OR {same} THEN a.text ELSE p.section || body END AS text FROM answers a LEFT JOIN c USING (answer_id)
      JOIN answer_sections p ON p.answer_id = a.answer_id AND p.section_no = 0"""


_BASE = S.with_views("answers", "answer_sections", body="")
_NAME = "regexp_extract(section, '##\\s*\\[이름\\s*\\d+\\]\\s*([가-힣]{2,5})', 1)"


@AREA.add("r4_without_clashes", _BASE.rstrip() + ",\n" + _drop_sql("NOT contains(section, '— 상극')", always=True))
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clashes_dropped(answers(spark, sf_dir), "text").select("answer_id", "text")


@AREA.add("r5_without_repeated_sounds", _BASE.rstrip() + ",\n" + _drop_sql(f"row_number() OVER (PARTITION BY answer_id, substr({_NAME}, 2) ORDER BY section_no) = 1"))
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated_sounds_dropped(answers(spark, sf_dir), "text").select("answer_id", "text")


_PAIR = "regexp_extract(section, '\\(([一-鿿]+)\\)', 1)"
_GREEDY = f"""g AS (SELECT answer_id, list_reduce(list_prepend({{'x': '', 'seen': '', 'k': [0]}}, list({{'x': {_PAIR}, 'seen': '', 'k': [section_no]}} ORDER BY section_no)),
      lambda a, b: {{'x': '', 'seen': CASE WHEN contains(a.seen, b.x[1]) OR contains(a.seen, b.x[2]) THEN a.seen ELSE a.seen || b.x END,
        'k': CASE WHEN contains(a.seen, b.x[1]) OR contains(a.seen, b.x[2]) THEN a.k ELSE list_append(a.k, b.k[1]) END}}).k AS ks FROM answer_sections WHERE section_no > 0 GROUP BY 1)"""


@AREA.add("r6_without_repeated_characters", _BASE.rstrip() + ",\n" + _GREEDY + ",\n" + _drop_sql("list_contains(ks, section_no)", extra="JOIN g USING (answer_id)"))
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated_characters_dropped(answers(spark, sf_dir), "text").select("answer_id", "text")


@AREA.add("r7_without_surname_sounds", _BASE.rstrip() + ",\n" + _drop_sql(f"suffix({_NAME}, surname) = false", extra="JOIN (SELECT answer_id, surname FROM answers) USING (answer_id)"))
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.surname_sounds_dropped(answers(spark, sf_dir), "text", "surname").select("answer_id", "text")


_SURI = "regexp_extract(section, '\\*\\*수리\\*\\*:(.+)', 1)"
_WORST = " OR ".join(f"regexp_extract({_SURI}, '{f}\\d+\\(([^)]+)\\)', 1) = '大凶'" for f in ("형격", "이격", "원격"))


# here a block ends with the line break before the next header
S.VIEWS["blocks"] = f"""SELECT answer_id, section_no, CASE section_no WHEN 0 THEN section ELSE substr(section, 2) END || CASE WHEN section_no < max(section_no) OVER (PARTITION BY answer_id) THEN {_NL} ELSE '' END AS section FROM framed"""


@AREA.add(
    "f6_without_poor_frames",
    S.with_views("answers", "answer_sections", "framed", "blocks", body="").rstrip() + f""",
    k AS (SELECT *, NOT ({_WORST}) AS keep FROM blocks WHERE section_no > 0),
    c AS (SELECT answer_id, count_if(keep) AS kept, string_agg(CASE WHEN keep THEN regexp_replace(section, '^## \\[이름 \\d+\\]', '## [이름 ' || rn || ']') END, '' ORDER BY section_no) AS body,
      string_agg(section, '' ORDER BY section_no) AS whole FROM (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY answer_id ORDER BY section_no) AS rn FROM k) GROUP BY 1)
    SELECT p.answer_id, p.section || CASE WHEN c.answer_id IS NULL THEN '' WHEN kept = 0 THEN whole ELSE body END AS text FROM blocks p LEFT JOIN c USING (answer_id) WHERE p.section_no = 0""",
)
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.poor_frames_dropped(r3(spark, sf_dir), "text").select("answer_id", "text")


_FIX = "['화', '토', '금', '수', '목']"


def _no_clash(a: str, b: str) -> str:
    return f"({b} - {a} + 5) % 5 NOT IN (2, 3)"


@AREA.add(
    "r8_replacement_proposals",
    S.with_views("chars", "answers", "answer_sections", "last_chars",
      # one reading has no permission edge, so its repairs come from the flagged characters
      pool=f"""SELECT hangul, resource_ohaeng AS fix, list(hanja ORDER BY r) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY hangul, resource_ohaeng ORDER BY profile_id) AS r FROM chars WHERE is_person_name_hanja)
        WHERE r <= CASE hangul WHEN '나' THEN 6 ELSE 5 END GROUP BY 1, 2""",
      x=f"""SELECT s.answer_id, regexp_extract(section, '## \\[이름 (\\d+)\\]', 1) AS name_idx, {_PAIR}[1] AS c1, {_PAIR}[2] AS c2, {S.code_sql("regexp_extract(section, '첫째 글자[^\\n]+\\[(.)\\]', 1)")} AS e1,
        {S.code_sql("regexp_extract(section, '둘째 글자[^\\n]+\\[(.)\\]', 1)")} AS e2, {S.code_sql('a.surname_ohaeng')} AS es FROM answer_sections s JOIN answers a USING (answer_id) WHERE section_no > 0 AND contains(section, '— 상극')""",
      o=f"""SELECT *, {_FIX}[j] AS fix, {S.code_sql(f"{_FIX}[j]")} AS ef, CASE turn WHEN 0 THEN c2 ELSE c1 END AS target FROM x, range(2) AS t(turn), range(1, 6) AS u(j)""",
      k=f"""SELECT o.*, l.hangul AS reading, list_filter(cs, lambda c: c <> target)[1:5] AS cand, row_number() OVER (PARTITION BY answer_id, name_idx ORDER BY turn, j) AS rn FROM o JOIN last_chars l ON l.hanja = target
        JOIN pool p ON p.hangul = l.hangul AND p.fix = o.fix WHERE len(list_filter(cs, lambda c: c <> target)) > 0
        AND CASE turn WHEN 0 THEN {_no_clash('e1', 'ef')} AND {_no_clash('es', 'e1')} ELSE {_no_clash('es', 'ef')} AND {_no_clash('ef', 'e2')} END""",
      body="SELECT answer_id, name_idx, target, reading, fix, array_to_string(cand, ',') AS candidates FROM k WHERE rn = 1"),
)
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = flagged(spark, sf_dir)
    pools = A.replacement_pools(chars.filter("hangul <> '나'"), chars, "profile_id")
    return A.replacements(answers(spark, sf_dir), "answer_id", "text", "surname_ohaeng", A.dictionary_of(chars, "hangul", "seq"), pools)


_SPELLED = ("(\\] )[가-힣]{3} \\(([一-鿿]{2})\\)", "{0}1{0}2{0}2 ({0}2)")
_HEAD = "'^(## \\[이름 \\d+\\] )[一-鿿]{4} \\(([一-鿿]{2})\\)$'"


@AREA.add(
    "r9_character_headers",
    S.with_views("chars", "answers", "answer_lines", "last_chars",
      s=f"SELECT answer_id, n, surname, regexp_replace(line, '{_SPELLED[0]}', '{_SPELLED[1].format(chr(92))}') AS line FROM answer_lines",
      h=f"SELECT *, regexp_extract(line, {_HEAD}, 1) AS p, regexp_extract(line, {_HEAD}, 2) AS cc FROM s",
      l="SELECT answer_id, n, CASE WHEN cc <> '' AND a.hangul IS NOT NULL AND b.hangul IS NOT NULL THEN p || surname || a.hangul || b.hangul || ' (' || cc || ')' ELSE line END AS x FROM h LEFT JOIN last_chars a ON a.hanja = cc[1] LEFT JOIN last_chars b ON b.hanja = cc[2]",
      body=_LINES),
)
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = answers(spark, sf_dir).withColumn("text", F.regexp_replace("text", _SPELLED[0], _SPELLED[1].format("$")))
    readings = A.dictionary_of(flagged(spark, sf_dir), "hangul", "seq")
    return A.character_headers_fixed(spelled, "answer_id", "text", "surname", readings).select("answer_id", "text")


@AREA.add("r9_broken_headers", S.with_views("answers", body="SELECT answer_id, text FROM answers"))
def r9_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.regexp_replace("text", r"## \[이름 \d+\] ([가-힣]{3}) \(", "## [$1] 이름 (")
    return answers(spark, sf_dir).select("answer_id", A.broken_headers_fixed(broken).alias("text"))


@AREA.add(
    "r10_finished_answers",
    S.with_views("answers", body=f"""SELECT answer_id, CASE WHEN names > 0 AND names < asked THEN '요청하신 ' || asked || '개 중 수리·오행 조건에 부합하는 이름 ' || names || '개를 추천드립니다.' || {_NL} || {_NL} ELSE '' END
      || text || CASE WHEN answer_id % 5 = 0 THEN '면책 고지' ELSE {_NL} || {_NL} || '---' || {_NL} || {_NL} || '⚠️ 면책 고지: 추천 이름의 출생신고 가능 여부를 100% 보장하지 않습니다. 최종 확인은 관할 기관을 통해 진행하세요.' END AS text
      FROM (SELECT *, answer_id % 9 AS asked FROM answers)"""),
)
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("answer_id") % 5 == 0, "면책 고지").otherwise(""))
    query = F.concat(F.lit("이름 "), F.col("answer_id") % 9, F.lit(" 개 추천"))
    return answers(spark, sf_dir).select("answer_id", A.finished(text, query).alias("text"))


@AREA.add(
    "r11_verdict_issues",
    S.with_views("answers", "answer_sections", body=f"""SELECT answer_id, regexp_extract(section, '## \\[이름 (\\d+)\\]', 1) AS name_idx, {_PAIR} AS hanja, substr({_NAME}, 2) AS hangul FROM answer_sections WHERE section_no > 0 AND answer_id % 4 < 2
      UNION ALL SELECT answer_id, regexp_extract(section, '## \\[이름 (\\d+)\\]', 1), '', {_NAME} FROM answer_sections WHERE section_no > 0 AND answer_id % 4 = 2"""),
)
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = r"## (\[이름 \d+\]) ([가-힣])([가-힣]{2}) \(([一-鿿]{2})\)"
    kind = F.col("answer_id") % 4
    raw = F.when(kind < 2, F.regexp_replace("text", header, "$1 $4($3)")).when(kind == 2, F.regexp_replace("text", header, "$1 $2$3: 나쁨")).otherwise(F.concat(F.regexp_replace("text", header, "$1 $4($3)"), F.lit("이상 없음")))
    replies = answers(spark, sf_dir).select("answer_id", F.concat(F.lit("<think>[이름 9] 中(중)\n</think>"), raw).alias("raw"))
    return A.verdict_issues(replies, "answer_id", "raw")


@AREA.add(
    "r12_sound_lists",
    S.with_views("surnames", "sounds", body="SELECT surname_id, CAST(pair_no - 1 AS INT) AS pos, CASE WHEN pair_no % 5 = 0 THEN sound2 ELSE sound1 || sound2 END AS sounds FROM sounds WHERE surname_id % 7 <> 3"),
)
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit('["'), F.when(F.col("pair_no") % 5 == 0, "x1").otherwise(F.col("sound1")), F.lit('", "'), F.col("sound2"), F.lit('"]'))
    lists = CD.sounds(spark, sf_dir).groupBy("surname_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_no", one.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    raw = F.when(F.col("surname_id") % 7 == 3, "no list").otherwise(F.concat(F.lit("<think>[1]</think> ["), "t", F.lit("] end")))
    return lists.select("surname_id", F.posexplode(A.sound_lists(raw)).alias("pos", "s")).select("surname_id", "pos", F.array_join("s", "").alias("sounds"))


# -- the whole chain ------------------------------------------------------------------------

def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed answers as a model may return them: thoughts, leaked context, lost or broken headers,
    the surname's character in brackets, names spelled in characters, answers of native words."""
    k, text = F.col("answer_id"), F.col("text")
    sur = X.char_of(F.lit(S.FIRST_CHAR + 9000) + k % 100)
    text = F.when(k % 4 == 1, F.regexp_replace(text, F.lit(r"(\] [가-힣]+ \()"), F.concat(F.lit("$1"), sur))).otherwise(text)
    text = F.when(k % 7 == 3, F.regexp_replace(text, r"## \[이름 \d+\] ([가-힣]{3}) \(", "## [$1] 이름 (")).when(
        k % 11 == 4, F.regexp_replace(text, r"(\] )[가-힣]{3} \(([一-鿿]?)([一-鿿]{2})\)", "$1$3 ($2$3)")
    ).otherwise(text)
    text = F.when((k % 3 == 0) & (k % 7 != 3), F.replace(text, F.lit("## [이름"), F.lit("[이름"))).otherwise(text)
    text = F.concat(F.when(k % 2 == 0, F.lit("<think>[이름 9] 갑\n</think>\n")).otherwise(F.lit("")), text, F.when(k % 5 == 2, F.lit("\n\n[참고 정보]\n## [이름 99] 가나다 (一一)")).otherwise(F.lit("")))
    return answers(spark, sf_dir).select("answer_id", "surname", sur.alias("surname_hanja"), "surname_strokes", (k % 6 == 5).alias("native"), text.alias("raw"))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = flagged(spark, sf_dir)
    strokes, readings = A.dictionary_of(known, "strokes", "seq"), A.dictionary_of(known, "hangul", "seq")
    return CH.audited(raw_replies(spark, sf_dir), "answer_id", "raw", strokes, readings, S.grades(spark))


_CHAIN_STEPS = {
    "raw_answers": S.VIEWS["answers"],
    "answer_lines": S.VIEWS["answer_lines"].replace("FROM answers", "FROM raw_answers"),
    "last_chars": S.VIEWS["last_chars"],
    "struck": "SELECT answer_id, n, CASE WHEN c.strokes IS NOT NULL THEN regexp_replace(line, '\\d+획', c.strokes || '획', 'g') ELSE line END AS line FROM answer_lines a LEFT JOIN last_chars c ON c.hanja = regexp_extract(line, '글자\\(([一-鿿])\\)', 1)",
    "flows": f"SELECT answer_id, n, line, regexp_extract(line, {_FLOW}, 1) AS p, {S.relation_sql(_flow_code(2), _flow_code(3))} AS r1, {S.relation_sql(_flow_code(3), _flow_code(4))} AS r2 FROM struck",
    "lined": "SELECT answer_id, n, CASE WHEN p = '' THEN line ELSE p || CASE WHEN r1 = '상극' OR r2 = '상극' THEN '상극' WHEN r1 = '상생' AND r2 = '상생' THEN '상생' ELSE '중립' END END AS x FROM flows",
    "answers": f"SELECT * REPLACE (rtrim((SELECT string_agg(x, {_NL} ORDER BY n) FROM lined l WHERE l.answer_id = raw_answers.answer_id), {_NL}) AS text) FROM raw_answers",
    "answer_sections": S.VIEWS["answer_sections"],
    "framed": S.VIEWS["framed"],
    "own": f"""SELECT a.answer_id, a.surname, s.section_no AS n, a.answer_id % 6 = 5 AS native, regexp_replace(CASE WHEN a.answer_id % 6 = 5 THEN s.section ELSE section_of.section END, '^\\n## \\[이름 \\d+\\]', '') AS body,
      a.answer_id % 11 = 4 AND a.answer_id % 7 <> 3 AS spelled, {_PAIR.replace('section', 's.section')} AS cc FROM answer_sections s JOIN framed section_of USING (answer_id, section_no) JOIN answers a USING (answer_id) WHERE s.section_no > 0""",
    "named": """SELECT o.* EXCLUDE (body, cc), cc, NOT spelled OR x.hangul IS NOT NULL AND y.hangul IS NOT NULL AS readable,
      CASE WHEN NOT spelled THEN body WHEN x.hangul IS NOT NULL AND y.hangul IS NOT NULL THEN regexp_replace(body, '^ [가-힣]+ ', ' ' || surname || x.hangul || y.hangul || ' ') ELSE regexp_replace(body, '^ [가-힣]+ ', ' ' || cc || ' ') END AS body
      FROM own o LEFT JOIN last_chars x ON x.hanja = cc[1] LEFT JOIN last_chars y ON y.hanja = cc[2]""",
    "p0": f"""SELECT * REPLACE (CASE WHEN readable THEN cc ELSE '' END AS cc), CASE WHEN readable THEN regexp_extract(body, '^ ([가-힣]{{2,5}})', 1) ELSE '' END AS name, NOT native AND ({_WORST.replace('section', 'body')}) AS worst FROM named""",
    "p1": f"""SELECT * EXCLUDE (body), CASE WHEN any_kept AND last_lost AND n = last_kept THEN body || {_NL} ELSE body END AS body FROM (SELECT *, count_if(NOT worst) OVER w > 0 AS any_kept,
      arg_max(worst, n) OVER w AS last_lost, max(CASE WHEN NOT worst THEN n END) OVER w AS last_kept FROM p0 WINDOW w AS (PARTITION BY answer_id)) WHERE NOT (worst AND any_kept)""",
    "p2": "SELECT * FROM (SELECT *, contains(body, '— 상극') AS clash, count_if(NOT contains(body, '— 상극')) OVER (PARTITION BY answer_id) AS good, count(*) OVER (PARTITION BY answer_id) AS n1 FROM p1) WHERE NOT (clash AND good > 0)",
    "p3": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, CASE WHEN name = '' THEN '#' || n ELSE substr(name, 2) END ORDER BY n) AS nth FROM p2) WHERE nth = 1",
    "g": """SELECT answer_id, list_reduce(list_prepend({'x': '', 'seen': '', 'k': [0]}, list({'x': cc, 'seen': '', 'k': [n]} ORDER BY n)),
      lambda a, b: {'x': '', 'seen': CASE WHEN b.x <> '' AND (contains(a.seen, b.x[1]) OR contains(a.seen, b.x[2])) THEN a.seen ELSE a.seen || b.x END,
        'k': CASE WHEN b.x <> '' AND (contains(a.seen, b.x[1]) OR contains(a.seen, b.x[2])) THEN a.k ELSE list_append(a.k, b.k[1]) END}).k AS ks FROM p3 GROUP BY 1""",
    "p4": "SELECT p3.* FROM p3 JOIN g USING (answer_id) WHERE native OR list_contains(ks, n)",
    "p5": "SELECT * FROM (SELECT *, name <> '' AND suffix(name, surname) AS same, count_if(NOT (name <> '' AND suffix(name, surname))) OVER (PARTITION BY answer_id) AS fine FROM p4) WHERE NOT (same AND fine > 0)",
    "done": f"""SELECT answer_id, count(*) < any_value(n1) AS touched, string_agg({_NL} || '## [이름 ' || rn || ']' || body, '' ORDER BY n) AS body, count(*) AS names
      FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY n) AS rn FROM p5) GROUP BY 1""",
    "chained": """SELECT a.answer_id, coalesce(d.names, 0) AS names, p.section || coalesce(d.body, '') AS text FROM answers a LEFT JOIN done d USING (answer_id) JOIN answer_sections p ON p.answer_id = a.answer_id AND p.section_no = 0""",
}
_CHAIN = S.with_views("chars", **_CHAIN_STEPS, body="")


@AREA.add("r0_audited_answers", _CHAIN.rstrip() + f"""
    SELECT answer_id, CASE WHEN names > 0 AND names < answer_id % 9 THEN '요청하신 ' || answer_id % 9 || '개 중 수리·오행 조건에 부합하는 이름 ' || names || '개를 추천드립니다.' || {_NL} || {_NL} ELSE '' END
      || text || '{A.DISCLAIMER}' AS text FROM chained""")
def r0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of raw replies, all rules in their order, with the closing note."""
    query = F.concat(F.lit("이름 "), F.col("answer_id") % 9, F.lit("개 추천"))
    return _chained(spark, sf_dir).select("answer_id", A.finished(F.col("text"), query).alias("text"))


@AREA.add("r0_both_kinds", _CHAIN.rstrip() + f""", kinds AS (SELECT c.answer_id // 6 AS request, c.answer_id % 6 = 5 AS native, text FROM chained c WHERE c.answer_id % 6 IN (0, 5))
    SELECT h.request, '{CH.BOTH[0]}' || rtrim(h.text, ' ' || {_NL}) || '{CH.BOTH[1]}' || n.text || '{A.DISCLAIMER}' AS text FROM kinds h JOIN kinds n USING (request) WHERE NOT h.native AND n.native""")
def r0_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered by a reply of each kind: one audited answer with two parts."""
    k = F.col("answer_id")
    parts = _chained(spark, sf_dir).filter((k % 6).isin(0, 5)).select(F.floor(k / 6).alias("request"), "native", "text")
    two = parts.filter("NOT native").select("request", F.col("text").alias("h")).join(parts.filter("native").select("request", F.col("text").alias("n")), "request")
    return two.select("request", A.finished(CH.both_kinds(F.col("h"), F.col("n")), F.lit("")).alias("text"))
