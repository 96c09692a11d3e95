"""The five elements as codes: the distance on the cycle decides every pair rule.

With codes in generating order, b - a (mod 5) is 1 where a generates b, 2 where a
controls b, 0 for equal, 4 where b generates a and 3 where b controls a.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element labels in generating order.
LABELS = "목화토금수"
LABELS_HANJA = "木火土金水"
COMPAT_METAL = "金"

# Initial consonants in Unicode order and the element of each.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
INITIAL_ELEMENT = {
    "ㄱ": "목", "ㅋ": "목",
    "ㄴ": "화", "ㄹ": "화",
    "ㅇ": "토", "ㅎ": "토",
    "ㅅ": "금", "ㅈ": "금", "ㅊ": "금",
    "ㅁ": "수", "ㅂ": "수", "ㅍ": "수",
}


def label_of(code: Column) -> Column:
    return F.substring(F.lit(LABELS), code.cast("int") + 1, F.lit(1))


def hanja_label_of(code: Column) -> Column:
    return F.substring(F.lit(LABELS_HANJA), code.cast("int") + 1, F.lit(1))


def code_of(label: Column) -> Column:
    """0..4 for a label in either script, null for anything else."""
    text = F.replace(label, F.lit(COMPAT_METAL), F.lit("金"))
    at = F.greatest(F.position(text, F.lit(LABELS)), F.position(text, F.lit(LABELS_HANJA)))
    return F.when((F.length(text) == 1) & (at > 0), at - 1)


def normalized(label: Column) -> Column:
    """Korean label of a trimmed label in either script, else null."""
    from namesmith.functions.text import strip

    return label_of(code_of(strip(label)))


def sound_element(reading: Column) -> Column:
    """Element of a reading by the initial consonant of its first syllable, '' if none."""
    by_initial = [INITIAL_ELEMENT.get(c, "") for c in INITIALS]
    point = F.ascii(reading)
    index = F.floor((point - 0xAC00) / 588).cast("int")
    table = F.array(*[F.lit(e) for e in by_initial])
    return F.when(point.between(0xAC00, 0xD7A3), F.get(table, index)).otherwise(F.lit(""))


def distance(a: Column, b: Column) -> Column:
    return F.pmod(b - a, F.lit(5))


def generated_by(code: Column) -> Column:
    """Code of the element this one generates."""
    return F.pmod(code + 1, F.lit(5))


# -- rule a: lookup of a triple, five relations ------------------------------------

def lookup_relation(a: Column, b: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("비화", "상생", "상극", "역상극", "역상생")])
    return F.get(names, distance(a, b).cast("int"))


def lookup_flow(a: Column, b: Column, c: Column) -> Column:
    first, second = distance(a, b) == 1, distance(b, c) == 1
    return (
        F.when(first & second, F.lit("전체 상생"))
        .when(first | second, F.lit("부분 상생"))
        .otherwise(F.lit("상생 없음"))
    )


# -- rule b: corpus metadata, everything that is neither counts as equal ------------

def corpus_relation(a: Column, b: Column) -> Column:
    d = distance(a, b)
    return F.when(d == 1, F.lit("상생")).when(d == 2, F.lit("상극")).otherwise(F.lit("비화"))


def corpus_flow(a: Column, b: Column, c: Column) -> Column:
    first, second = corpus_relation(a, b), corpus_relation(b, c)
    return (
        F.when((first == "상생") & (second == "상생"), F.lit("전체상생"))
        .when((first == "상극") | (second == "상극"), F.lit("상극포함"))
        .when((first == "비화") & (second == "비화"), F.lit("전체비화"))
        .otherwise(F.lit("부분상생"))
    )


# -- rule c: names, control clashes in either direction -----------------------------

def name_relation(a: Column, b: Column) -> Column:
    return relation_of(distance(a, b))


def relation_of(d: Column) -> Column:
    return F.when(d == 1, F.lit("상생")).when(d.isin(2, 3), F.lit("상극")).otherwise(F.lit("중립"))


def overall_relation(*relations: Column) -> Column:
    clash, smooth = relations[0] == "상극", relations[0] == "상생"
    for r in relations[1:]:
        clash, smooth = clash | (r == "상극"), smooth & (r == "상생")
    return F.when(clash, F.lit("상극")).when(smooth, F.lit("상생")).otherwise(F.lit("중립"))


def relation_table(spark: SparkSession) -> DataFrame:
    """All 25 ordered element pairs with the name rule; small by definition."""
    pair = spark.range(25).select(
        F.floor(F.col("id") / 5).cast("int").alias("src"), (F.col("id") % 5).cast("int").alias("dst")
    )
    return pair.withColumn("relation", name_relation(F.col("src"), F.col("dst")))
