"""Four frames of stroke counts and their grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grades that count as good, with and without 中吉, and as bad.
GOOD_ALL = ("吉", "大吉", "中吉", "半吉")
GOOD_STRICT = ("吉", "大吉", "半吉")
BAD = ("凶", "大凶")
WORST = "大凶"
FRAMES = ("won", "hyung", "yi", "jung")
UNKNOWN = "정보 없음"


def wrapped(n: Column) -> Column:
    """Numbers above 81 start again at 1; 0 and below have no number."""
    return F.when(n > 0, F.pmod(n - 1, F.lit(81)) + 1)


def four_frames(surname: Column, first: Column, second: Column) -> dict[str, Column]:
    return {
        "won": first + second,
        "hyung": surname + first,
        "yi": surname + second,
        "jung": surname + first + second,
    }


def grade_list(grades: DataFrame) -> DataFrame:
    """One row: ``_grades``, the grades of 1 to 81 by place. Where a number is given twice the smaller label holds."""
    known = F.map_from_entries(F.collect_list(F.struct("num", "_grade")))
    table = grades.filter(F.col("num").between(1, 81)).groupBy("num").agg(F.min("grade").alias("_grade")).agg(known.alias("_known"))
    return table.select(F.transform(F.sequence(F.lit(1), F.lit(81)), lambda n: F.try_element_at("_known", n)).alias("_grades"))


def with_grades(df: DataFrame, grades: DataFrame, sums: dict[str, Column], missing: str = UNKNOWN) -> DataFrame:
    """Add ``<name>`` and ``<name>_g`` per sum. The grades travel as one row, so any number of sums costs one join."""
    added = [c for n, total in sums.items() for c in (total.alias(n), F.coalesce(F.get("_grades", wrapped(total) - 1), F.lit(missing)).alias(f"{n}_g"))]
    return df.crossJoin(F.broadcast(grade_list(grades))).select(*df.columns, *added)


def count_in(names: tuple[str, ...], values: tuple[str, ...]) -> Column:
    """How many of the frames ``names`` carry one of the grades."""
    total = F.lit(0)
    for name in names:
        total = total + F.col(f"{name}_g").isin(*values).cast("int")
    return total


def score(names: tuple[str, ...] = FRAMES) -> Column:
    """3 per 大吉, 2 per 吉, 1 otherwise."""
    total = F.lit(0)
    for name in names:
        g = F.col(f"{name}_g")
        total = total + F.when(g == "大吉", 3).when(g == "吉", 2).otherwise(1)
    return total
