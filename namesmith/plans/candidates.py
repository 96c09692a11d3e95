"""Candidate generation over surnames, characters and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.once import computed_once
from namesmith.functions.order import first_per_key, permuted
from namesmith.operators import candidates as G
from namesmith.operators import lookups as L
from namesmith.operators.questions import SINGLE
from namesmith.plans import Registry
from namesmith.plans import corpora as CP
from namesmith.plans import lookups as LP
from namesmith.plans import standins as S

AREA = Registry()

_GOOD4 = "({g} IN ('吉','大吉','中吉','半吉'))"
_SCORE = "CASE {g} WHEN '大吉' THEN 3 WHEN '吉' THEN 2 ELSE 1 END"


def _grid(n: int) -> str:
    return f"""SELECT ss, CAST(a AS INT) AS s1, CAST(b AS INT) AS s2, {S.grade_sql('a + b')} AS g1, {S.grade_sql('ss + a')} AS g2, {S.grade_sql('ss + b')} AS g3, {S.grade_sql('ss + a + b')} AS g4
      FROM (SELECT DISTINCT strokes AS ss FROM surnames), range(1, {n + 1}) AS x(a), range(1, {n + 1}) AS y(b)"""


S.VIEWS["lucky"] = f"""SELECT *, row_number() OVER (PARTITION BY ss ORDER BY score DESC, s1, s2) AS rank, count(*) OVER (PARTITION BY ss) AS total FROM
    (SELECT ss, s1, s2, {' + '.join(_SCORE.format(g=f'g{i}') for i in range(1, 5))} AS score FROM ({_grid(25)}) WHERE {' AND '.join(_GOOD4.format(g=f'g{i}') for i in range(1, 5))})"""


@AREA.add(
    "g1_lucky_strokes",
    S.with_views("surnames", "lucky", body="""SELECT surname_id, CAST(rank AS INT) AS rank, s1, s2, CAST(score AS INT) AS score, total, greatest(total - 30, 0) AS omitted
      FROM surnames JOIN lucky ON ss = strokes WHERE rank <= 10"""),
)
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lucky_strokes(S.surnames(spark, sf_dir), S.grades(spark))


def permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chars(spark, sf_dir).filter("is_person_name_hanja")


_SAMPLE = """SELECT strokes, string_agg(hanja || '(' || hangul || ')', ' / ' ORDER BY r) AS samples FROM
    (SELECT *, row_number() OVER (PARTITION BY strokes ORDER BY seq) AS r FROM chars WHERE is_person_name_hanja) WHERE r <= 4 GROUP BY 1"""
_STRICT = "CAST({g} IN ('吉','大吉','半吉') AS INT)"
_BAD = "CAST({g} IN ('凶','大凶') AS INT)"


@AREA.add(
    "g2_lucky_strokes_two",
    S.with_views("chars", "surnames", p=_SAMPLE, g=_grid(24),
      k=f"SELECT *, {' + '.join(_STRICT.format(g=f'g{i}') for i in range(1, 5))} AS good, {' + '.join(_BAD.format(g=f'g{i}') for i in range(1, 5))} AS bad FROM g",
      f="SELECT k.*, a.samples AS samples1, b.samples AS samples2, row_number() OVER (PARTITION BY ss, s1 ORDER BY good DESC, s2) AS r FROM k JOIN p a ON a.strokes = s1 JOIN p b ON b.strokes = s2 WHERE good >= 3 AND bad = 0",
      t="SELECT *, row_number() OVER (PARTITION BY ss ORDER BY good DESC, s1, s2) AS rank FROM f WHERE r = 1",
      body="SELECT surname_id, CAST(rank AS INT) AS rank, s1, s2, good, samples1, samples2 FROM surnames JOIN t ON ss = strokes WHERE rank <= 8"),
)
def g2_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lucky_strokes_with_pools(S.surnames(spark, sf_dir), permitted(spark, sf_dir), S.grades(spark), "seq")


@AREA.add(
    "g2_lucky_strokes_one",
    S.with_views("chars", "surnames", p=_SAMPLE, g=f"SELECT ss, CAST(a AS INT) AS s1, {S.grade_sql('a')} AS g1, {S.grade_sql('ss + a')} AS g2 FROM (SELECT DISTINCT strokes AS ss FROM surnames), range(1, 25) AS x(a)",
      t="SELECT *, row_number() OVER (PARTITION BY ss ORDER BY s1) AS rank FROM g JOIN p ON p.strokes = s1 WHERE g1 IN ('吉','大吉','半吉') AND g2 IN ('吉','大吉','半吉')",
      body="SELECT surname_id, CAST(rank AS INT) AS rank, s1, CAST(0 AS INT) AS s2, CAST(2 AS INT) AS good, samples AS samples1, '' AS samples2 FROM surnames s JOIN t ON t.ss = s.strokes WHERE rank <= 8"),
)
def g2_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lucky_strokes_with_pools(S.surnames(spark, sf_dir), permitted(spark, sf_dir), S.grades(spark), "seq", name_length=1)


@AREA.add(
    "g3_stroke_hints",
    S.with_views("chars", "surnames", "lucky",
      p="""SELECT strokes, e, string_agg(hanja || '(' || hangul || ')', ' / ' ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY strokes, e ORDER BY seq) AS r FROM
        (SELECT *, resource_ohaeng AS e FROM chars WHERE is_person_name_hanja UNION ALL SELECT *, '*' FROM chars WHERE is_person_name_hanja)) WHERE r <= 4 GROUP BY 1, 2""",
      q="SELECT *, CASE WHEN surname_id % 3 = 0 THEN '*' ELSE resource_ohaeng END AS element FROM surnames",
      body="""SELECT surname_id, CAST(rank AS INT) AS rank, element, s1, s2, a.samples AS samples1, b.samples AS samples2 FROM q JOIN lucky ON ss = q.strokes AND rank <= 3
        JOIN p a ON a.strokes = s1 AND a.e = element JOIN p b ON b.strokes = s2 AND b.e = element"""),
)
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    surnames = S.surnames(spark, sf_dir)
    asked = surnames.select("surname_id", F.when(F.col("surname_id") % 3 != 0, F.col("resource_ohaeng")).alias("element"))
    return G.stroke_hints(asked, G.lucky_strokes(surnames, S.grades(spark)), permitted(spark, sf_dir), "seq")


SOUND_PAIRS = 25
S.VIEWS["sounds"] = f"""SELECT surname_id, hangul AS surname, {S.code_sql('resource_ohaeng')} AS element, CASE WHEN surname_id % 9 = 0 THEN 0 ELSE strokes END AS strokes, CAST(j AS INT) AS pair_no,
    {S.sql_list(S.SYLLABLES)}[CAST((surname_id + j) % 8 AS INT) + 1] AS sound1, {S.sql_list(S.SYLLABLES)}[CAST((surname_id * 3 + j * j) % 8 AS INT) + 1] AS sound2
    FROM surnames, range(1, {SOUND_PAIRS + 1}) AS t(j)"""


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sound pairs of each surname, in order."""
    key, j = F.col("surname_id"), F.col("pair_no")
    return (
        S.surnames(spark, sf_dir).withColumn("pair_no", F.explode(F.sequence(F.lit(1), F.lit(SOUND_PAIRS))))
        .select("surname_id", F.col("hangul").alias("surname"), E.code_of(F.col("resource_ohaeng")).alias("element"), F.when(key % 9 == 0, 0).otherwise(F.col("strokes")).alias("strokes"),
                "pair_no", S.picked(S.SYLLABLES, (key + j) % 8).alias("sound1"), S.picked(S.SYLLABLES, (key * 3 + j * j) % 8).alias("sound2"))
    )


S.VIEWS["reading_pools"] = """SELECT hangul AS sound, e AS element, list(hanja ORDER BY r) AS h, list(strokes ORDER BY r) AS st, string_agg(hanja || '(' || strokes || ')', ' / ' ORDER BY r) AS shown,
    string_agg(CASE WHEN r <= 2 THEN hanja || '(' || strokes || ')' END, ' / ' ORDER BY r) AS shown2
    FROM (SELECT *, strpos('목화토금수', resource_ohaeng) - 1 AS e, row_number() OVER (PARTITION BY hangul, resource_ohaeng ORDER BY profile_id) AS r FROM chars WHERE is_person_name_hanja) WHERE r <= 3 GROUP BY 1, 2"""


def reading_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = permitted(spark, sf_dir)
    with_edge = chars.filter("hangul <> '나'")  # one reading takes the fallback
    return G.reading_pools(with_edge, chars, "profile_id")


_HINT = f"""(SELECT coalesce(string_agg(t, ', ' ORDER BY bad, x, y), '') FROM (SELECT x, y, bad, CASE WHEN bad THEN lbl || '(凶)' ELSE '(O)' || lbl END AS t, row_number() OVER (ORDER BY bad, x, y) AS n FROM
    (SELECT x, y, a.h[x] || b.h[y] || '→정격' || (strokes + a.st[x] + b.st[y]) || {S.grade_sql('strokes + a.st[x] + b.st[y]')} AS lbl,
      {S.grade_sql('strokes + a.st[x] + b.st[y]')} IN ('凶','大凶') OR {S.grade_sql('a.st[x] + b.st[y]')} = '大凶' AS bad
      FROM range(1, 3) AS r(x), range(1, 3) AS s(y) WHERE x <= len(a.h) AND y <= len(b.h))) WHERE n <= 3)"""


@AREA.add(
    "g4_verified_pools",
    S.with_views("chars", "surnames", "sounds", "reading_pools",
      f="""SELECT *, unnest([(element + 1) % 5, element] || list_filter(range(5), lambda o: (o - element + 5) % 5 = 4)) AS e1,
        generate_subscripts([(element + 1) % 5, element] || list_filter(range(5), lambda o: (o - element + 5) % 5 = 4), 1) AS p1 FROM sounds WHERE sound1 <> surname""",
      s="SELECT *, (e1 + d) % 5 AS e2, 2 - d AS p2 FROM f, range(2) AS t(d)",
      r=f"""SELECT s.*, a.shown AS chars1, b.shown AS chars2, CASE WHEN strokes > 0 THEN {_HINT} ELSE '' END AS hint, row_number() OVER (PARTITION BY surname_id, pair_no ORDER BY p1, p2) AS ord
        FROM s JOIN reading_pools a ON a.sound = sound1 AND a.element = e1 JOIN reading_pools b ON b.sound = sound2 AND b.element = e2""",
      d="SELECT *, dense_rank() OVER (PARTITION BY surname_id ORDER BY pair_no) AS dr FROM r WHERE ord <= 4",
      body=f"""SELECT surname_id, pair_no, CAST(ord AS INT) AS "order", sound1 || sound2 AS sounds, {S.label_sql('e1')} AS element1, {S.label_sql('e2')} AS element2,
        {S.relation_sql('e1', 'e2')} AS relation, chars1, chars2, hint FROM d WHERE dr <= 20"""),
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.verified_pools(sounds(spark, sf_dir), reading_pools(spark, sf_dir), S.grades(spark))


@AREA.add(
    "g4_verified_single",
    S.with_views("chars", "surnames", "sounds", "reading_pools",
      r="""SELECT s.*, coalesce(a.shown, '') AS generated, coalesce(b.shown2, '') AS own FROM sounds s LEFT JOIN reading_pools a ON a.sound = sound1 AND a.element = (s.element + 1) % 5
        LEFT JOIN reading_pools b ON b.sound = sound1 AND b.element = s.element WHERE sound1 <> surname AND coalesce(a.shown, b.shown) IS NOT NULL""",
      body="SELECT surname_id, pair_no, sound1 AS sound, generated, own FROM (SELECT *, row_number() OVER (PARTITION BY surname_id ORDER BY pair_no) AS n FROM r) WHERE n <= 20"),
)
def g4_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.verified_single_pools(sounds(spark, sf_dir), reading_pools(spark, sf_dir))


_DRAWS = """list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(size - least(n, size), size), lambda j: [j, CAST('0x' || substr(md5('draw:' || question_id || ':' || j), 1, 15) AS BIGINT) % (j + 1)])),
    lambda got, d: CASE WHEN list_contains(got, d[2]) THEN list_append(got, d[1]) ELSE list_append(got, d[2]) END)"""
_CHARS_N = "least(greatest(50, 8 * CAST(least(coalesce(TRY_CAST(regexp_extract(query, '(\\d+)\\s*개', 1) AS HUGEINT), 3), 10000) AS BIGINT)), 80)"
_WORDS_N = "least(greatest(30, 6 * CAST(least(coalesce(TRY_CAST(regexp_extract(query, '(\\d+)\\s*개', 1) AS HUGEINT), 3), 10000) AS BIGINT)), 60)"
_NAME_WORDS = ("이름", "추천", "작명", "짓", "씨")


@AREA.add("g7_sample_sizes", S.with_views("questions", body=f"SELECT question_id, CAST({_CHARS_N} AS INT) AS characters, CAST({_WORDS_N} AS INT) AS words FROM questions"))
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return S.questions(spark, sf_dir).select("question_id", G.character_sample_size(q).alias("characters"), G.word_sample_size(q).alias("words"))


@AREA.add(
    "g6_sampled_characters",
    S.with_views("chars", "questions",
      p="SELECT *, row_number() OVER (PARTITION BY e ORDER BY substr(md5('pool' || seq), 1, 15), seq) AS rank, count(*) OVER (PARTITION BY e) AS size FROM (SELECT seq, hanja, resource_ohaeng AS e FROM chars WHERE is_person_name_hanja UNION ALL SELECT seq, hanja, '*' FROM chars WHERE is_person_name_hanja)",
      q=f"SELECT question_id, {_CHARS_N} AS n, coalesce({LP._ELEMENT}, '*') AS e FROM questions WHERE {S.tag_sql('query', _NAME_WORDS)}",
      w=f"SELECT question_id, e, unnest(d) AS place, unnest(range(len(d))) AS i FROM (SELECT q.*, {_DRAWS} AS d FROM q JOIN (SELECT DISTINCT e, size FROM p) s USING (e))",
      body="SELECT question_id, i + 1 AS pick, p.seq, p.hanja FROM w JOIN p ON p.e = w.e AND p.rank = place + 1"),
)
def g6_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = permitted(spark, sf_dir).select("seq", "hanja", F.explode(F.array(F.col("resource_ohaeng"), F.lit("*"))).alias("kind"))
    q = F.col("query")
    asked = S.questions(spark, sf_dir).filter(L.contains_any(q, _NAME_WORDS))
    asked = computed_once(asked, {"kind": F.coalesce(L.character_conditions(q)[1], F.lit("*")), "n": G.character_sample_size(q)}).drop("query")
    return G.sampled(asked, permuted(kinds, ["kind"], "seq", "pool"), ["kind"], "question_id", "n")


@AREA.add(
    "g6_sampled_words",
    S.with_views("words", "questions",
      k="""SELECT word_id, name, g.pool, s.single FROM words, (VALUES ('all'), ('girl'), ('boy')) AS g(pool), (VALUES (true), (false)) AS s(single)
        WHERE (g.pool = 'all' OR g.pool = 'girl' AND NOT contains(gender, '남자에게') OR g.pool = 'boy' AND NOT contains(gender, '여자에게')) AND (NOT s.single OR length(name) = 1)""",
      p="SELECT *, row_number() OVER (PARTITION BY pool, single ORDER BY substr(md5('words' || word_id), 1, 15), word_id) AS rank, count(*) OVER (PARTITION BY pool, single) AS size FROM k",
      q=f"SELECT question_id, {_WORDS_N} AS n, CASE WHEN {S.tag_sql('query', L.GIRL_WORDS)} THEN 'girl' WHEN {S.tag_sql('query', L.BOY_WORDS)} THEN 'boy' ELSE 'all' END AS pool, {S.tag_sql('query', SINGLE)} AS single FROM questions WHERE contains(query, '순우리말')",
      w=f"SELECT question_id, pool, single, unnest(d) AS place, unnest(range(len(d))) AS i FROM (SELECT q.*, {_DRAWS} AS d FROM q JOIN (SELECT DISTINCT pool, single, size FROM p) s USING (pool, single))",
      body="SELECT question_id, i + 1 AS pick, p.word_id, p.name FROM w JOIN p ON p.pool = w.pool AND p.single = w.single AND p.rank = place + 1"),
)
def g6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = L.word_pools(LP.words(spark, sf_dir), "name", "gender").select("word_id", "name", "pool", "single")
    q = F.col("query")
    asked = S.questions(spark, sf_dir).filter(q.contains("순우리말"))
    asked = computed_once(asked, {"want_pool": L.wanted_pool(q), "want_single": L.contains_any(q, SINGLE), "n": G.word_sample_size(q)}).drop("query")
    asked = asked.join(F.broadcast(L.effective_pools(pools)), ["want_pool", "want_single"]).drop("want_pool", "want_single")
    return G.sampled(asked, permuted(pools, ["pool", "single"], "word_id", "words"), ["pool", "single"], "question_id", "n")


_A = "(['비화','상생','상극','역상극','역상생'])[CAST(({1} - {0} + 5) % 5 AS INT) + 1]"


@AREA.add(
    "g9_triple_lookup",
    S.with_views("triples", t="SELECT a, b, c, max_by(description, seq) AS description FROM triples GROUP BY 1, 2, 3",
      q="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 6 = 5 THEN NULL ELSE CAST(l_partkey % 6 AS INT) END AS a, CAST(l_suppkey % 5 AS INT) AS b, CAST(l_linenumber % 5 AS INT) AS c FROM lineitem",
      body=f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN ok THEN substr('木火土金水', q.a + 1, 1) || substr('木火土金水', q.b + 1, 1) || substr('木火土金水', q.c + 1, 1) ELSE '' END AS combo,
        CASE WHEN ok THEN description ELSE '' END AS description, CASE WHEN ok THEN {_A.format('q.a', 'q.b')} ELSE '' END AS first_pair, CASE WHEN ok THEN {_A.format('q.b', 'q.c')} ELSE '' END AS second_pair,
        CASE WHEN NOT ok THEN '' WHEN (q.b - q.a + 5) % 5 = 1 AND (q.c - q.b + 5) % 5 = 1 THEN '전체 상생' WHEN (q.b - q.a + 5) % 5 = 1 OR (q.c - q.b + 5) % 5 = 1 THEN '부분 상생' ELSE '상생 없음' END AS flow
        FROM (SELECT q.*, description, coalesce(description <> '', false) AS ok FROM q LEFT JOIN t ON t.a = q.a AND t.b = q.b AND t.c = q.c) q"""),
)
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    combo = F.concat(*[E.hanja_label_of(F.col(x)) for x in "abc"])
    known = first_per_key(CP.triples(spark, sf_dir).select(combo.alias("combo"), "seq", "description"), ["combo"], ["seq"], last=True)
    six = F.col("l_partkey") % 6
    asked = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(six != 5, six.cast("int")).alias("a"), (F.col("l_suppkey") % 5).cast("int").alias("b"), (F.col("l_linenumber") % 5).cast("int").alias("c")
    )
    return G.triple_lookup(asked, known.drop("seq")).drop("a", "b", "c")
