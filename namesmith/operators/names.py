"""Best two-character names per surname.

Grades depend on stroke counts only, so surnames and characters are collapsed to
(element, strokes) classes; classes are scored, the winning class pairs are kept, and
only then are characters joined back. The number of class triples has a fixed bound,
whatever the number of surnames or characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import frames as FR
from namesmith.functions.order import top_per_key
from namesmith.session import checkpointed

PER_SURNAME = 10


def character_classes(permitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (e, strokes) with ``n`` members, ``m`` at most of one reading and ``d`` at most of one
    character; and ``k``, the members of each class by reading."""
    cls = ["e", "strokes"]
    readings = checkpointed(permitted.groupBy(*cls, "hangul").agg(F.count(F.lit(1)).alias("k")))
    repeats = permitted.groupBy(*cls, "hanja").agg(F.count(F.lit(1)).alias("k")).groupBy(*cls).agg(F.max("k").alias("d"))
    classes = readings.groupBy(*cls).agg(F.sum("k").alias("n"), F.max("k").alias("m")).join(repeats, cls)
    return checkpointed(classes), readings


def _class_pairs(surnames: DataFrame, classes: DataFrame, grades: DataFrame, limit: int) -> DataFrame:
    """Scored (surname class, first class, second class) triples without a clash or a worst
    grade, as far down the ranking as any surname reading can need.

    A pair surely yields (n1 - m1) * (n2 - m2 - d2) names for any reading.
    """
    allowed = F.broadcast(E.relation_table(classes.sparkSession).filter("relation <> '상극'").select("src", "dst"))
    first = classes.select(F.col("e").alias("e1"), F.col("strokes").alias("s1"), F.col("n").alias("n1"), F.col("m").alias("m1"))
    second = classes.select(
        F.col("e").alias("e2"), F.col("strokes").alias("s2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("m").alias("m2")
    )
    triples = (
        surnames.select("se", "ss").distinct()
        .join(allowed, F.col("se") == F.col("src")).withColumnRenamed("dst", "e1")
        .join(first, "e1")
        .withColumn("e2", F.explode(F.array(F.col("e1"), E.generated_by(F.col("e1")))))
        .join(second, "e2")
    )
    graded = FR.with_grades(triples, grades, FR.four_frames(F.col("ss"), F.col("s1"), F.col("s2")))
    worst = F.array(F.col("won_g"), F.col("hyung_g"), F.col("yi_g"))
    scored = graded.filter(~F.array_contains(worst, FR.WORST)).withColumn("good", FR.count_in(FR.FRAMES, FR.GOOD_STRICT))
    least = (F.col("n1") - F.col("m1")) * F.greatest(F.col("n2") - F.col("m2") - F.col("d2"), F.lit(0))
    return _needed(scored.withColumn("sure", least), ["se", "ss"], limit)


def _needed(pairs: DataFrame, kind: list[str], limit: int) -> DataFrame:
    """Class pairs before which fewer than ``limit`` names are sure. One row per stroke pair
    and kind enters the window."""
    rank = ["good", "s1", "s2"]
    groups = pairs.groupBy(*kind, *rank).agg(F.sum("sure").alias("_sure"))
    before = Window.partitionBy(*kind).orderBy(F.desc("good"), "s1", "s2").rowsBetween(Window.unboundedPreceding, -1)
    kept = groups.withColumn("_before", F.coalesce(F.sum("_sure").over(before), F.lit(0))).filter(F.col("_before") < limit)
    return pairs.join(kept.select(*kind, *rank), [*kind, *rank])


def best_two_character_names(surnames: DataFrame, chars: DataFrame, grades: DataFrame, limit: int = PER_SURNAME) -> DataFrame:
    """``limit`` names per surname out of all permitted characters: most good frames first, then
    strokes, then ids.

    No clash between neighbouring elements, no reading equal to the surname's, never
    the same character twice, no worst grade on the first three frames.
    """
    permitted = chars.filter("is_person_name_hanja").select("profile_id", "hangul", "hanja", "strokes", E.code_of(F.col("resource_ohaeng")).alias("e"))
    classes, readings = character_classes(permitted)
    kinds = surnames.select(
        F.col("hangul").alias("r"), E.code_of(F.col("resource_ohaeng")).alias("se"), F.col("strokes").alias("ss")
    ).distinct()
    pairs = checkpointed(_class_pairs(kinds, classes, grades, limit))

    # How many names each class pair surely yields for a surname reading: members with
    # that reading are out, and a first character meets at most d2 copies of itself.
    x1 = readings.select(F.col("e").alias("e1"), F.col("strokes").alias("s1"), F.col("hangul").alias("r"), F.col("k").alias("x1"))
    x2 = readings.select(F.col("e").alias("e2"), F.col("strokes").alias("s2"), F.col("hangul").alias("r"), F.col("k").alias("x2"))
    sure = (
        kinds.join(pairs.drop("sure"), ["se", "ss"])
        .join(x1, ["e1", "s1", "r"], "left")
        .join(x2, ["e2", "s2", "r"], "left")
        .withColumn("left1", F.col("n1") - F.coalesce("x1", F.lit(0)))
        .withColumn("left2", F.col("n2") - F.coalesce("x2", F.lit(0)))
        .filter("left1 > 0 AND left2 > 0")
        .withColumn("sure", F.col("left1") * F.greatest(F.col("left2") - F.col("d2"), F.lit(0)))
    )
    kind = ["r", "se", "ss"]
    kept = checkpointed(_needed(sure, kind, limit).select(
        *kind, "e1", "s1", "e2", "s2", "good", "won", "won_g", "hyung", "hyung_g", "yi", "yi_g", "jung", "jung_g"
    ))

    # The members a class pair needs of a class: as many as names are wanted, and as many more as copies of
    # one character can fall away. They are among the first so many of each reading, whatever reading is out.
    enough = limit + (classes.agg(F.max("d")).first()[0] or 0)
    heads = top_per_key(permitted, ["e", "strokes", "hangul"], [F.col("profile_id")], enough, "_m").drop("_m")
    places = [kept.select("r", F.col(f"e{i}").alias("e"), F.col(f"s{i}").alias("strokes")) for i in (1, 2)]
    wanted = places[0].unionByName(places[1]).distinct()
    open_heads = heads.join(wanted, ["e", "strokes"]).filter(F.col("hangul") != F.col("r"))
    members = checkpointed(top_per_key(open_heads, ["r", "e", "strokes"], [F.col("profile_id")], enough, "_m").drop("_m"))

    def side(i: int) -> DataFrame:
        return members.select(
            "r", F.col("e").alias(f"e{i}"), F.col("strokes").alias(f"s{i}"), F.col("hangul").alias(f"hangul{i}"), F.col("hanja").alias(f"hanja{i}"),
            F.col("profile_id").alias(f"profile{i}"),
        )

    names = kept.join(side(1), ["r", "e1", "s1"]).join(side(2), ["r", "e2", "s2"]).filter(F.col("hanja1") != F.col("hanja2"))
    best = top_per_key(
        names, kind, [F.desc("good"), F.col("s1"), F.col("s2"), F.col("profile1"), F.col("profile2")], limit
    )
    return (
        surnames.withColumnRenamed("hangul", "r")
        .withColumn("se", E.code_of(F.col("resource_ohaeng")))
        .withColumnRenamed("strokes", "ss")
        .join(best, kind)
        .select(
            "surname_id", "rank", F.concat("r", "hangul1", "hangul2").alias("reading"),
            F.concat("hanja1", "hanja2").alias("characters"), "profile1", "profile2", "s1", "s2", "good",
            "won_g", "hyung_g", "yi_g", "jung_g",
        )
    )
