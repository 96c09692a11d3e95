"""Stroke combinations, character pools per sound pair, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import frames as FR
from namesmith.functions.once import computed_once
from namesmith.functions.order import top_per_key
from namesmith.functions.text import counted, extract

LISTED, SHOWN = 10, 30


def _grid(strokes: DataFrame, max_strokes: int, grades: DataFrame) -> DataFrame:
    """All (s1, s2) per distinct surname stroke count, graded; bounded by the stroke range."""
    one_side = F.sequence(F.lit(1), F.lit(max_strokes))
    grid = strokes.select("ss", F.explode(one_side).alias("s1")).withColumn("s2", F.explode(one_side))
    return FR.with_grades(grid, grades, FR.four_frames(F.col("ss"), F.col("s1"), F.col("s2")), missing="?")


def _distinct_strokes(surnames: DataFrame) -> DataFrame:
    return surnames.select(F.col("strokes").alias("ss")).filter("ss > 0").distinct()


def lucky_strokes(surnames: DataFrame, grades: DataFrame, max_strokes: int = 25, listed: int = LISTED) -> DataFrame:
    """Best stroke pairs with four good frames per surname, with how many there are in all.

    Surnames only matter by their stroke count, so pairs are scored once per count.
    """
    graded = _grid(_distinct_strokes(surnames), max_strokes, grades)
    lucky = graded.filter(FR.count_in(FR.FRAMES, FR.GOOD_ALL) == 4).withColumn("score", FR.score())
    per = Window.partitionBy("ss")
    ranked = lucky.withColumn("total", F.count(F.lit(1)).over(per)).withColumn(
        "rank", F.row_number().over(per.orderBy(F.desc("score"), "s1", "s2"))
    )
    best = ranked.filter(F.col("rank") <= listed).withColumn("omitted", F.greatest(F.col("total") - SHOWN, F.lit(0)))
    keep = ["rank", "s1", "s2", "score", "total", "omitted"]
    return surnames.withColumnRenamed("strokes", "ss").join(best, "ss").select("surname_id", *keep)


def stroke_samples(chars: DataFrame, keys: list[str], order: str, size: int = 4) -> DataFrame:
    """First characters per stroke count (and element), as one short text."""
    first = top_per_key(chars, keys, [F.col(order)], size, "_r")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "hanja", "hangul"))), lambda c: F.concat(c["hanja"], F.lit("("), c["hangul"], F.lit(")"))), " / ")
    return first.groupBy(*keys).agg(shown.alias("samples"))


def lucky_strokes_with_pools(
    surnames: DataFrame, chars: DataFrame, grades: DataFrame, order: str, name_length: int = 2, max_strokes: int = 24, rows: int = 8
) -> DataFrame:
    """Stroke pairs (or single counts) that real characters can fill, with sample characters.

    Two characters: at least three good frames, none bad. One: both frames good. 中吉 does
    not count as good here. One row per first count, ``rows`` per surname.
    """
    samples = stroke_samples(chars.filter(F.col("strokes").between(1, max_strokes)), ["strokes"], order)
    pool1 = samples.select(F.col("strokes").alias("s1"), F.col("samples").alias("samples1"))
    pool2 = samples.select(F.col("strokes").alias("s2"), F.col("samples").alias("samples2"))
    graded = _grid(_distinct_strokes(surnames), max_strokes, grades)
    if name_length == 1:
        single = graded.filter("s2 = 1").select("ss", "s1", F.lit(0).alias("s2"))
        graded = FR.with_grades(single, grades, {"won": F.col("s1"), "hyung": F.col("ss") + F.col("s1")}, missing="?")
        names = ("won", "hyung")
        kept = graded.withColumn("good", FR.count_in(names, FR.GOOD_STRICT)).filter("good >= 2")
        kept = kept.join(pool1, "s1").withColumn("samples2", F.lit(""))
    else:
        kept = graded.withColumn("good", FR.count_in(FR.FRAMES, FR.GOOD_STRICT))
        kept = kept.filter((F.col("good") >= 3) & (FR.count_in(FR.FRAMES, FR.BAD) == 0)).join(pool1, "s1").join(pool2, "s2")
    first = top_per_key(kept, ["ss", "s1"], [F.desc("good"), F.col("s2")], 1, "_f")
    best = top_per_key(first, ["ss"], [F.desc("good"), F.col("s1"), F.col("s2")], rows)
    return surnames.withColumnRenamed("strokes", "ss").join(best, "ss").select("surname_id", "rank", "s1", "s2", "good", "samples1", "samples2")


def stroke_hints(requests: DataFrame, combos: DataFrame, chars: DataFrame, order: str, used: int = 3) -> DataFrame:
    """Characters for the first stroke pairs of each request, under its element if it has one.

    ``requests``: surname_id, element (null for any); ``combos``: as ``lucky_strokes``.
    """
    per_element = stroke_samples(chars, ["strokes", "resource_ohaeng"], order).withColumnRenamed("resource_ohaeng", "element")
    anyone = stroke_samples(chars, ["strokes"], order).withColumn("element", F.lit("*"))
    pools = per_element.unionByName(anyone)
    asked = requests.withColumn("element", F.coalesce("element", F.lit("*")))
    pairs = combos.filter(F.col("rank") <= used).select("surname_id", "rank", "s1", "s2").join(asked, "surname_id")
    for i in (1, 2):
        pairs = pairs.join(pools.select(F.col("strokes").alias(f"s{i}"), "element", F.col("samples").alias(f"samples{i}")), [f"s{i}", "element"])
    return pairs.select("surname_id", "rank", "element", "s1", "s2", "samples1", "samples2")


# -- pools per sound pair -------------------------------------------------------------------

PAIRS_PER_SOUND, SOUNDS_PER_SURNAME, SHOWN_CHARS = 4, 20, 3


def reading_pools(permitted: DataFrame, flagged: DataFrame, order: str, size: int = SHOWN_CHARS) -> DataFrame:
    """(reading, element) to its first characters, permitted ones if there are any.

    At most ``size`` characters per reading and element are kept before they are grouped.
    """
    keys = ["hangul", "resource_ohaeng"]
    first = top_per_key(permitted, keys, [F.col(order)], size, "_r")
    rest = flagged.join(permitted.select(*keys).distinct(), keys, "left_anti")
    pool = first.unionByName(top_per_key(rest, keys, [F.col(order)], size, "_r"))
    return pool.groupBy(F.col("hangul").alias("sound"), E.code_of(F.col("resource_ohaeng")).alias("element")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "hanja", "strokes"))), lambda c: F.struct(c["hanja"].alias("hanja"), c["strokes"].alias("strokes"))).alias("chars")
    )


def _shown(chars: Column, size: int) -> Column:
    return F.array_join(F.transform(F.slice(chars, 1, size), lambda c: F.concat(c["hanja"], F.lit("("), c["strokes"], F.lit(")"))), " / ")


def _grade_of(grade_map: Column, n: Column) -> Column:
    return F.coalesce(F.try_element_at(grade_map, FR.wrapped(n).cast("int")), F.lit("?"))


def _hint(surname_strokes: Column, first: Column, second: Column, grade_map: Column) -> Column:
    """Up to three graded members of the first two characters of each side, good ones first."""
    both = F.flatten(
        F.transform(F.slice(first, 1, 2), lambda a: F.transform(F.slice(second, 1, 2), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    both = F.filter(both, lambda p: (p["a"]["strokes"] > 0) & (p["b"]["strokes"] > 0))

    def label(p: Column) -> Column:
        total = surname_strokes + p["a"]["strokes"] + p["b"]["strokes"]
        jung, won = _grade_of(grade_map, total), _grade_of(grade_map, p["a"]["strokes"] + p["b"]["strokes"])
        text = F.concat(p["a"]["hanja"], p["b"]["hanja"], F.lit("→정격"), total, jung)
        good = ~jung.isin(*FR.BAD) & (won != FR.WORST)
        return F.struct(good.alias("good"), F.when(good, F.concat(F.lit("(O)"), text)).otherwise(F.concat(text, F.lit("(凶)"))).alias("text"))

    labels = F.transform(both, label)
    ordered = F.concat(F.filter(labels, lambda x: x["good"]), F.filter(labels, lambda x: ~x["good"]))
    texts = F.array_join(F.transform(F.slice(ordered, 1, 3), lambda x: x["text"]), ", ")
    return F.when(surname_strokes > 0, texts).otherwise(F.lit(""))


def _grade_map(grades: DataFrame) -> DataFrame:
    """81 grades as one map in one row."""
    return F.broadcast(grades.agg(F.map_from_entries(F.collect_list(F.struct("num", "grade"))).alias("_grades")).withColumn("_one", F.lit(1)))


def verified_pools(sounds: DataFrame, pools: DataFrame, grades: DataFrame) -> DataFrame:
    """Characters for each sound pair of each surname, element pairs without a clash only.

    ``sounds``: surname_id, surname, element (code), strokes, pair_no, sound1, sound2.
    First elements in order: generated by the surname's, its own, the others that do not
    clash; second: generated by the first, or the same. Four element pairs per sound pair
    and the first twenty sound pairs that have any.
    """
    own = F.col("element")
    others = F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda o: ~E.distance(own, o).isin(0, 1, 2, 3))
    firsts = F.concat(F.array(E.generated_by(own), own), others)
    # A pool is a reading: its elements as a map. There are no more syllables than that, so they travel to the sounds;
    # what is exploded stays in its row's task.
    by_sound = pools.groupBy("sound").agg(F.map_from_entries(F.collect_list(F.struct("element", "chars"))).alias("_of"))
    rows = sounds.filter(F.col("sound1") != F.col("surname"))
    for i in (1, 2):
        rows = rows.join(F.broadcast(by_sound.select(F.col("sound").alias(f"sound{i}"), F.col("_of").alias(f"_of{i}"))), f"sound{i}")
    pairs = F.flatten(F.transform(firsts, lambda a: F.transform(F.array(E.generated_by(a), a), lambda b: F.struct(a.alias("e1"), b.alias("e2")))))
    there = F.filter(pairs, lambda p: F.map_contains_key("_of1", p["e1"]) & F.map_contains_key("_of2", p["e2"]))
    rows = computed_once(rows, {"_pairs": F.slice(there, 1, PAIRS_PER_SOUND)}).filter(F.size("_pairs") > 0)
    # the window runs over one surname's own list of sound pairs
    capped = top_per_key(rows, ["surname_id"], [F.col("pair_no")], SOUNDS_PER_SURNAME, "_d").select("*", F.posexplode("_pairs").alias("_at", "_p"))
    capped = capped.select(
        "surname_id", "pair_no", "strokes", "sound1", "sound2", (F.col("_at") + 1).alias("order"), F.col("_p.e1").alias("e1"), F.col("_p.e2").alias("e2"),
        F.try_element_at("_of1", F.col("_p.e1")).alias("_c1"), F.try_element_at("_of2", F.col("_p.e2")).alias("_c2"),
    )
    graded = capped.withColumn("_one", F.lit(1)).join(_grade_map(grades), "_one")
    return graded.select(
        "surname_id", "pair_no", "order", F.concat("sound1", "sound2").alias("sounds"), E.label_of(F.col("e1")).alias("element1"), E.label_of(F.col("e2")).alias("element2"),
        E.name_relation(F.col("e1"), F.col("e2")).alias("relation"), _shown(F.col("_c1"), 3).alias("chars1"), _shown(F.col("_c2"), 3).alias("chars2"),
        _hint(F.col("strokes"), F.col("_c1"), F.col("_c2"), F.col("_grades")).alias("hint"),
    )


def verified_single_pools(sounds: DataFrame, pools: DataFrame) -> DataFrame:
    """One-character names: three characters of the generated element, two of the own."""
    rows = sounds.filter(F.col("sound1") != F.col("surname"))
    for name, element in (("generated", E.generated_by(F.col("element"))), ("own", F.col("element"))):
        side = pools.select(F.col("sound").alias("_s"), F.col("element").alias("_e"), F.col("chars").alias(name))
        rows = rows.join(F.broadcast(side), (F.col("sound1") == F.col("_s")) & (element == F.col("_e")), "left").drop("_s", "_e")
    found = rows.filter(F.col("generated").isNotNull() | F.col("own").isNotNull())
    capped = found.withColumn("_d", F.row_number().over(Window.partitionBy("surname_id").orderBy("pair_no"))).filter(F.col("_d") <= SOUNDS_PER_SURNAME)
    shown = [F.coalesce(_shown(F.col(c), n), F.lit("")).alias(c) for c, n in (("generated", 3), ("own", 2))]
    return capped.select("surname_id", "pair_no", F.col("sound1").alias("sound"), *shown)


# -- samples ---------------------------------------------------------------------------------

def requested_count(query: Column, default: int = 3) -> Column:
    return F.coalesce(counted(extract(query, r"(\d+)\s*개"), 10_000), F.lit(default))


def character_sample_size(query: Column) -> Column:
    return F.least(F.greatest(F.lit(50), requested_count(query) * 8), F.lit(80))


def word_sample_size(query: Column) -> Column:
    return F.least(F.greatest(F.lit(30), requested_count(query) * 6), F.lit(60))


def sampled(requests: DataFrame, numbered_pool: DataFrame, kinds: list[str], request_id: str, size: str) -> DataFrame:
    """``size`` rows per request without replacement, all of them if there are fewer. Every subset is as likely as any other.

    The pool is numbered per kind (``rank`` from 1, ``size``). A request draws places by Floyd's rule: for
    j = N - n .. N - 1 a keyed digest gives a place up to j, and j itself is taken where that place is taken
    already. A sample costs as many joined rows as it returns: the pool is never scanned per request.
    """
    sizes = numbered_pool.select(*kinds, "size").distinct().withColumnRenamed("size", "_n")  # one row per kind
    most = F.least(F.col(size).cast("bigint"), F.col("_n"))

    def draw(j: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit("draw"), F.col(request_id).cast("string"), j.cast("string")))
        return F.struct(j.alias("j"), (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % (j + 1)).alias("t"))

    draws = F.when(most > 0, F.transform(F.sequence(F.col("_n") - most, F.col("_n") - 1), draw))
    taken = F.aggregate(
        draws, F.array().cast("array<bigint>"), lambda got, d: F.array_append(got, F.when(F.array_contains(got, d["t"]), d["j"]).otherwise(d["t"]))
    )
    wanted = requests.join(sizes, kinds).select(*requests.columns, F.posexplode(taken).alias("_i", "_place")).withColumn("rank", F.col("_place") + 1)
    rest = [c for c in numbered_pool.columns if c not in (*kinds, "rank", "size")]
    return wanted.join(numbered_pool, [*kinds, "rank"]).select(request_id, (F.col("_i") + 1).cast("bigint").alias("pick"), *rest)


def triple_lookup(requests: DataFrame, triples: DataFrame) -> DataFrame:
    """Description and relations of element triples; status error where there is none.

    ``triples`` holds at most 125 rows (combo, description); requests carry codes a, b, c
    with null for an invalid element.
    """
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    valid = a.isNotNull() & b.isNotNull() & c.isNotNull()
    combo = F.when(valid, F.concat(E.hanja_label_of(a), E.hanja_label_of(b), E.hanja_label_of(c)))
    joined = requests.withColumn("combo", combo).join(F.broadcast(triples), "combo", "left")
    found = F.coalesce(F.col("description") != "", F.lit(False))
    return joined.select(
        *requests.columns, F.when(found, "success").otherwise("error").alias("status"),
        *[F.when(found, v).otherwise(F.lit("")).alias(n) for n, v in (
            ("combo", F.col("combo")), ("description", F.col("description")), ("first_pair", E.lookup_relation(a, b)), ("second_pair", E.lookup_relation(b, c)),
            ("flow", E.lookup_flow(a, b, c)))],
    )
