"""The flagship question, for every surname at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namesmith.operators import names
from namesmith.plans import Registry
from namesmith.plans import standins as S

AREA = Registry()

# At class level: every class pair with a name holds at least one, so ten names lie within the ten best.
_SQL = S.with_views(
    "chars", "surnames",
    pool=f"SELECT *, {S.code_sql('resource_ohaeng')} AS e FROM chars WHERE is_person_name_hanja",
    kinds=f"SELECT DISTINCT hangul AS r, strokes AS ss, {S.code_sql('resource_ohaeng')} AS se FROM surnames",
    classes="""SELECT r, e, strokes, min(hanja) AS lo, max(hanja) AS hi FROM (SELECT DISTINCT r FROM kinds) k JOIN pool ON pool.hangul <> r GROUP BY ALL""",
    pairs=f"""SELECT k.*, a.e AS e1, a.strokes AS s1, b.e AS e2, b.strokes AS s2 FROM kinds k
        JOIN classes a ON a.r = k.r AND {S.relation_sql('k.se', 'a.e')} <> '상극'
        JOIN classes b ON b.r = k.r AND (b.e = a.e OR b.e = (a.e + 1) % 5)
        WHERE NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)""",
    graded=f"""SELECT *, {S.grade_sql('s1 + s2')} AS won_g, {S.grade_sql('ss + s1')} AS hyung_g,
        {S.grade_sql('ss + s2')} AS yi_g, {S.grade_sql('ss + s1 + s2')} AS jung_g FROM pairs""",
    scored="""SELECT *, CAST(won_g IN ('吉','大吉','半吉') AS INT) + CAST(hyung_g IN ('吉','大吉','半吉') AS INT)
        + CAST(yi_g IN ('吉','大吉','半吉') AS INT) + CAST(jung_g IN ('吉','大吉','半吉') AS INT) AS good
        FROM graded WHERE won_g <> '大凶' AND hyung_g <> '大凶' AND yi_g <> '大凶'""",
    best="SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY r, se, ss ORDER BY good DESC, s1, s2) AS place FROM scored) WHERE place <= 10",
    names="""SELECT x.*, a.hangul AS h1, b.hangul AS h2, a.hanja AS c1, b.hanja AS c2, a.profile_id AS profile1, b.profile_id AS profile2,
        row_number() OVER (PARTITION BY r, se, ss ORDER BY good DESC, s1, s2, a.profile_id, b.profile_id) AS rank FROM best x
        JOIN pool a ON a.e = e1 AND a.strokes = s1 AND a.hangul <> r JOIN pool b ON b.e = e2 AND b.strokes = s2 AND b.hangul <> r AND b.hanja <> a.hanja""",
    body=f"""SELECT surname_id, CAST(rank AS INT) AS rank, r || h1 || h2 AS reading, c1 || c2 AS characters,
        profile1, profile2, s1, s2, good, won_g, hyung_g, yi_g, jung_g
        FROM surnames s JOIN names n ON n.r = s.hangul AND n.ss = s.strokes AND n.se = {S.code_sql('s.resource_ohaeng')} WHERE rank <= 10""",
)


@AREA.add("g0_best_names", _SQL)
def best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.best_two_character_names(
        S.surnames(spark, sf_dir), S.chars(spark, sf_dir), S.grades(spark)
    )
