"""Keyed and optional-condition lookups for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import frames as FR
from namesmith.functions.once import computed_once
from namesmith.functions.order import first_per_key, top_per_key
from namesmith.functions.text import HANGUL, HANJA, contains_any, extract, first_contained, strip
from namesmith.session import checkpointed

MAX_LIMIT = 30


def safe_limit(limit: Column, default: int = 10, maximum: int = MAX_LIMIT) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(limit, F.lit(default)), F.lit(maximum)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


# -- optional conditions --------------------------------------------------------------

def _mask(columns: list[Column]) -> Column:
    total = F.lit(0)
    for i, c in enumerate(columns):
        total = total + F.when(c.isNotNull(), 1 << i).otherwise(0)
    return total


def _key(columns: list[Column]) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns])


def _subset_keys(columns: list[Column]) -> Column:
    """(mask, key) of a row for each subset of its conditions but the empty one."""
    keys = [_key([c if m >> i & 1 else F.lit(None) for i, c in enumerate(columns)]) for m in range(1, 1 << len(columns))]
    return F.array(*[F.struct(F.lit(m).alias("_mask"), k.alias("_key")) for m, k in enumerate(keys, 1)])


def _pieces(text: Column, single: bool) -> Column:
    """Distinct pairs of neighbouring characters; with ``single`` also the characters, without it only where there is no pair."""
    chars = F.split(text, "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.concat(chars, pairs) if single else F.when(F.length(text) > 1, pairs).otherwise(chars))


def containing(words: DataFrame, word: str, rows: DataFrame, text: str, ids: list[str]) -> DataFrame:
    """(word, ids) for each distinct word and each row whose text contains it. Words are not empty.

    An inverted index of neighbouring characters, cut to those the words have: a word meets only
    rows with its rarest pair, and ``contains`` is asked of those alone. Only ids are exploded.
    """
    asked = words.select(word).distinct().select(word, F.explode(_pieces(F.col(word), False)).alias("_pair"))
    texts = rows.select(*ids, text).filter(F.col(text) != "").dropDuplicates(ids)
    index = texts.select(*ids, F.explode(_pieces(F.col(text), True)).alias("_pair")).join(asked.select("_pair").distinct(), "_pair", "left_semi")
    sizes = index.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n"))
    # a word with a pair that no row has is contained in none
    rarest = asked.join(sizes, "_pair", "left").groupBy(word).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_pair")).alias("_r"))
    rarest = rarest.filter("_r._n > 0").select(word, F.col("_r._pair").alias("_pair"))
    return rarest.join(index, "_pair").join(texts, ids).filter(F.col(text).contains(F.col(word))).select(word, *ids)


def optional_match(
    requests: DataFrame, rows: DataFrame, conditions: list[str], order: str, limit: str, contains: tuple[str, str] | None = None
) -> DataFrame:
    """First rows of each request under those of its conditions that are not null.

    ``p IS NULL OR column = p`` for every p would be a nested loop. Instead each row is
    keyed once per subset of conditions that is asked for, and requests look up the one key
    they stand for. Only ids go through that explosion, and they are ranked per key and cut to
    the largest limit there can be, so neither a frequent value nor a frequent request is
    expanded. ``contains`` names a (request column, row column) substring condition; rows of a
    keyword come from ``containing`` and are keyed like the others, if other conditions hold.

    Requests without any condition get no rows. Conditions have equal names on both sides.
    """
    asked = [F.col(c) for c in conditions]
    word = F.lit("") if contains is None else F.coalesce(contains[0], F.lit(""))
    # read by every step below; what requests are made of (rules over questions) is evaluated once
    keyed_requests = checkpointed(computed_once(requests, {"_mask": _mask(asked), "_key": _key(asked), "_word": word}))
    ids = ["_order", "_h"]
    known = rows.withColumn("_order", F.col(order)).withColumn("_h", F.xxhash64(*rows.columns))
    wanted = keyed_requests.select("_mask", "_key", "_word").distinct()
    keyed = known.select(*ids, F.explode(_subset_keys(asked)).alias("_s")).select(*ids, "_s.*")
    plain = wanted.filter("_word = '' AND _mask > 0").select("_mask", "_key")
    by = [F.col(c) for c in ids]
    answers = top_per_key(keyed.join(plain, ["_mask", "_key"], "left_semi"), ["_mask", "_key"], by, MAX_LIMIT, "rank").withColumn("_word", F.lit(""))
    if contains is not None:
        found = containing(wanted.filter("_word <> ''"), "_word", known, contains[1], ids)
        alone = F.array(F.struct(F.lit(0).alias("_mask"), _key([F.lit(None) for _ in conditions]).alias("_key")))
        own = known.select(*ids, *conditions)
        found = found.join(own, ids).select(*ids, "_word", F.explode(F.concat(alone, _subset_keys(asked))).alias("_s")).select(*ids, "_word", "_s.*")
        found = found.join(wanted, ["_mask", "_key", "_word"], "left_semi")
        answers = answers.unionByName(top_per_key(found, ["_mask", "_key", "_word"], by, MAX_LIMIT, "rank").select(*answers.columns))
    own = [F.col(c) for c in requests.columns if c not in conditions and (contains is None or c != contains[0])]
    # rows come back to the few answers of a key before the many requests meet them
    full = known.select(*ids, F.struct(*rows.columns).alias("_row")).dropDuplicates(ids)
    rich = answers.join(full, ids).select("_mask", "_key", "_word", "rank", "_row")
    hits = keyed_requests.join(rich, ["_mask", "_key", "_word"]).filter(F.col("rank") <= safe_limit(F.col(limit)))
    return hits.select(*own, "rank", "_row.*")


def lookup_characters(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles by character, reading and/or profile id, in id order."""
    clean = computed_once(requests, {c: blank_to_null(F.col(c)) for c in ("hanja", "hangul", "profile_id")})
    return optional_match(clean, profiles, ["hanja", "hangul", "profile_id"], "profile_id", "limit")


def recommend_characters(requests: DataFrame, permitted: DataFrame) -> DataFrame:
    """Permitted profiles by elements, reading, strokes and a meaning keyword, in id order."""
    clean = computed_once(
        requests,
        {
            "sound_ohaeng": E.normalized(F.col("sound_ohaeng")), "resource_ohaeng": E.normalized(F.col("resource_ohaeng")),
            "hangul": blank_to_null(F.col("hangul")), "meaning_keyword": blank_to_null(F.col("meaning_keyword")),
            # 0 is no condition on its own, but as a condition it matches nothing
            "strokes": F.col("strokes"),
        },
    )
    return optional_match(
        clean, permitted, ["sound_ohaeng", "resource_ohaeng", "hangul", "strokes"], "profile_id", "limit", ("meaning_keyword", "sound_meaning")
    )


# -- readings and elements ------------------------------------------------------------

SPREAD = 64
# Rows that meet a request at a time: half of what Parquet packs at once, so that repeated tiles are repeated bytes. Tiles are cut from lists of about ``LISTED``.
TILE, LISTED = 252, 4032


def characters_of(requests: DataFrame, permitted: DataFrame, flagged: DataFrame, limit: int = 5) -> DataFrame:
    """Characters by reading and element: the first permitted by id, and where there are
    none, every flagged one.

    The latter is as many rows as requests times characters of a key, by definition. Requests
    of a key are dealt over ``SPREAD`` groups that each meet the key's characters, in tiles of about
    ``TILE``: all requests of a group meet one tile before the next. So runs of a request and
    a few characters repeat, which a file holds in a small part of what the rows would take one by one.
    """
    keys = ["hangul", "resource_ohaeng"]
    wanted = requests.select(*keys).distinct()
    first = top_per_key(permitted, keys, [F.col("profile_id")], limit).withColumn("origin", F.lit("permitted"))
    none = wanted.join(permitted.select(*keys).distinct(), keys, "left_anti")
    sizes = flagged.join(none, keys, "left_semi").groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("_lists"))
    listed = flagged.join(sizes, keys).withColumn("_list", F.pmod(F.xxhash64(*flagged.columns), F.col("_lists")))
    rest = [c for c in flagged.columns if c not in keys]
    lists = listed.groupBy(*keys, "_list").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    cut = F.transform(F.sequence(F.lit(1), F.size("_rows"), F.lit(TILE)), lambda i: F.slice("_rows", i, TILE))
    tiles = lists.select(*keys, F.explode(cut).alias("_rows"))
    tiles = tiles.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    # what is dealt is larger than its files let Spark expect, and what comes of it larger still: the number of tasks is given
    tasks = 8 * requests.sparkSession.sparkContext.defaultParallelism
    dealt = requests.withColumn("_deal", F.pmod(F.xxhash64(*requests.columns), F.lit(SPREAD))).repartition(tasks, *keys, "_deal")
    # of a merge the left side is passed through once, and each of its rows meets the right side's
    met = tiles.hint("merge").join(dealt, [*keys, "_deal"]).select(*requests.columns, F.explode("_rows").alias("_row"))
    fallback = met.select(*requests.columns, "_row.*").withColumn("rank", F.lit(None).cast("int")).withColumn("origin", F.lit("flagged"))
    return requests.join(first, keys).unionByName(fallback)


def same_reading(issues: DataFrame, flagged: DataFrame, limit: int = 10) -> DataFrame:
    """First characters with the reading of each issue other than its own character.

    The first ``limit`` of a reading answer every issue whose character is not among
    them; only for those few characters is the reading ranked again without them. With at
    most ``limit`` rows of any character, the first ``2 * limit`` hold enough of the others.
    What issues meet is these few rows per reading, and readings are syllables.
    """
    pool = flagged.select("hangul", F.col("hanja").alias("candidate"), "profile_id")
    by = [F.col("profile_id")]
    first = top_per_key(pool, ["hangul"], by, limit)
    inside = first.select("hangul", F.col("candidate").alias("hanja")).distinct()
    near = top_per_key(top_per_key(pool, ["hangul", "candidate"], by, limit, "_own").drop("_own"), ["hangul"], by, 2 * limit, "_near").drop("_near")
    again = top_per_key(inside.join(near, "hangul").filter(F.col("candidate") != F.col("hanja")), ["hangul", "hanja"], by, limit)
    special = issues.join(F.broadcast(again), ["hangul", "hanja"])
    plain = issues.join(F.broadcast(inside), ["hangul", "hanja"], "left_anti").join(F.broadcast(first), "hangul")
    return special.unionByName(plain.select(*special.columns))


def unique_readings(dictionary: DataFrame) -> DataFrame:
    """Readings with exactly one character, and that character."""
    return (
        dictionary.groupBy("hangul")
        .agg(F.count(F.lit(1)).alias("n"), F.max("hanja").alias("hanja"), F.max("resource_ohaeng").alias("resource_ohaeng"))
        .filter("n = 1").drop("n")
    )


def resolve_homophones(requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Resolve a surname reading where only one character has it."""
    return requests.join(unique_readings(dictionary), "hangul", "left").withColumn(
        "status", F.when(F.col("hanja").isNull(), "undecided").otherwise("resolved")
    )


def four_frame_verdicts(df: DataFrame, grades: DataFrame, surname: str, first: str, second: str) -> DataFrame:
    """Four frames with grades, count of bad frames and the verdict; bad input gets an error row."""
    valid = (F.col(surname) > 0) & (F.col(first) > 0) & (F.col(second) > 0)
    graded = FR.with_grades(df, grades, FR.four_frames(F.col(surname), F.col(first), F.col(second)))
    bad = len(FR.FRAMES) - FR.count_in(FR.FRAMES, FR.GOOD_ALL)
    return graded.select(
        *df.columns, F.when(valid, "success").otherwise("error").alias("status"),
        *[F.when(valid, F.col(f)).otherwise(0).alias(f) for f in FR.FRAMES],
        *[F.when(valid, F.col(f"{f}_g")).otherwise("").alias(f"{f}_g") for f in FR.FRAMES],
        F.when(valid, bad).otherwise(0).alias("bad_frames"), (valid & (bad == 0)).alias("all_good"),
    )


def name_statistics(requests: DataFrame, name: str, stats: DataFrame) -> DataFrame:
    """Rows of the frequency table with the trimmed name, or one not-found row."""
    joined = requests.join(stats, strip(F.col(name)) == F.col("_name"), "left")
    return joined.withColumn("found", F.col("_name").isNotNull()).drop("_name")


def forbidden_next(pairs: DataFrame) -> DataFrame:
    """Elements that must not follow each element: both directions of CONTROLS."""
    c = pairs.filter("rel = 'CONTROLS'")
    return c.select(F.col("src").alias("element"), F.col("dst").alias("forbidden")).unionByName(
        c.select(F.col("dst").alias("element"), F.col("src").alias("forbidden"))
    )


# -- surnames in questions --------------------------------------------------------------

def element_dictionary(profiles: DataFrame, surname_map: DataFrame, seq: str) -> DataFrame:
    """Element per character: first profile with one, else the surname map."""
    own = first_per_key(profiles.select("hanja", seq, "resource_ohaeng"), ["hanja"], [seq]).filter("resource_ohaeng <> ''")
    rest = first_per_key(surname_map.select("hanja", "surname_id", "resource_ohaeng"), ["hanja"], ["surname_id"])
    rest = rest.join(own, "hanja", "left_anti").filter("resource_ohaeng <> ''")
    return own.select("hanja", "resource_ohaeng").unionByName(rest.select("hanja", "resource_ohaeng"))


def resolve_surnames(questions: DataFrame, dictionary: DataFrame, question_id: str, query: str) -> DataFrame:
    """Surname reading and character of each question.

    A character in brackets beside the surname is taken as it is. Otherwise the runs of
    one or two characters after the surname compete: the first with a known element, else
    the first; a run followed by ``오행`` names an element and does not count.
    """
    q = F.col(query)
    before = rf"([{HANGUL}]{{1,2}})씨\s*[（\(]([{HANJA}]{{1,2}})[）\)]"
    after = rf"([{HANGUL}]{{1,2}})\s*[（\(]([{HANJA}]{{1,2}})[）\)]\s*씨"
    plain = rf"(?s)([{HANGUL}]{{1,2}})씨(.*)"
    bracket_reading = F.coalesce(extract(q, before, 1), extract(q, after, 1))
    bracket = F.coalesce(extract(q, before, 2), extract(q, after, 2))
    runs = F.regexp_extract_all(extract(q, plain, 2), F.lit(rf"([{HANJA}]+(?:오행)?)"), F.lit(1))
    runs = F.filter(runs, lambda r: r.rlike(rf"^[{HANJA}]{{1,2}}$"))
    found = questions.select(
        question_id,
        F.coalesce(bracket_reading, extract(q, plain, 1), F.lit("")).alias("surname"),
        F.when(bracket.isNotNull(), F.array(bracket)).otherwise(F.coalesce(runs, F.array().cast("array<string>"))).alias("_runs"),
    )
    tried = found.select(question_id, "surname", F.posexplode_outer("_runs").alias("_pos", "hanja")).join(dictionary, "hanja", "left")
    best = F.min_by(
        F.struct("hanja", "resource_ohaeng"), F.struct(F.col("resource_ohaeng").isNull(), F.col("_pos"))
    )
    return (
        tried.groupBy(question_id, "surname").agg(best.alias("_b"))
        .select(question_id, "surname", F.coalesce("_b.hanja", F.lit("")).alias("hanja"), F.coalesce("_b.resource_ohaeng", F.lit("")).alias("resource_ohaeng"))
    )


# -- conditions in questions --------------------------------------------------------------

def character_conditions(query: Column) -> tuple[Column, Column]:
    """(strokes, element) a question asks for, null where it does not."""
    strokes = extract(query, r"(\d+)\s*획").try_cast("int")
    element = E.normalized(extract(query, rf"([{E.LABELS_HANJA}{E.LABELS}])오행"))
    return strokes, element


def condition_counts(questions: DataFrame, profiles: DataFrame, query: str) -> DataFrame:
    """How many profiles meet each question's conditions, from one cube over the profiles."""
    strokes, element = character_conditions(F.col(query))
    cube = (
        profiles.select("strokes", "resource_ohaeng").cube("strokes", "resource_ohaeng")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
        .select(F.col("strokes").alias("_s"), F.col("resource_ohaeng").alias("_e"), "n", "_g")
    )
    asked = questions.withColumn("strokes", strokes).withColumn("element", element)
    level = F.when(F.col("strokes").isNull(), 2).otherwise(0) + F.when(F.col("element").isNull(), 1).otherwise(0)
    return (
        asked.withColumn("_level", level)
        .join(cube, (F.col("_level") == F.col("_g")) & F.col("strokes").eqNullSafe(F.col("_s")) & F.col("element").eqNullSafe(F.col("_e")), "left")
        .withColumn("n", F.coalesce("n", F.lit(0))).drop("_s", "_e", "_g", "_level")
    )


# Words that ask for tables or for running text.
TABLE_WORDS = ("표", "통계", "순위표", "순위", "빈도표", "표 형식")
TEXT_WORDS = ("본문", "텍스트", "내용만")


def chunk_condition(query: Column) -> Column:
    return F.when(contains_any(query, TABLE_WORDS), "table").when(contains_any(query, TEXT_WORDS), "text")


# Words for a girl's and for a boy's name.
GIRL_WORDS = ("여자아이", "여아", "딸", "여자", "여자이름")
BOY_WORDS = ("남자아이", "남아", "아들", "남자", "남자이름")
NOT_FOR_GIRLS, NOT_FOR_BOYS = "남자에게", "여자에게"


def word_pools(words: DataFrame, name: str, gender: str) -> DataFrame:
    """Words once per pool they belong to: (pool, single) with pool all, girl or boy."""
    g = F.coalesce(gender, F.lit(""))
    pools = F.array_compact(
        F.array(F.lit("all"), F.when(~g.contains(NOT_FOR_GIRLS), "girl"), F.when(~g.contains(NOT_FOR_BOYS), "boy"))
    )
    singles = F.when(F.length(name) == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return words.withColumn("pool", F.explode(pools)).withColumn("single", F.explode(singles))


def effective_pools(pools: DataFrame) -> DataFrame:
    """The pool each request kind really draws from: an empty gender pool gives way to all
    words, and the one-syllable filter only holds where it leaves something. Six rows."""
    spark = pools.sparkSession
    sizes = pools.groupBy("pool", "single").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat("pool", F.lit(":"), "single"), F.col("n")))).alias("sizes")
    )  # at most six entries
    kinds = spark.createDataFrame([(p, s) for p in ("all", "girl", "boy") for s in (False, True)], "want_pool string, want_single boolean")

    def has(pool: Column, single: bool) -> Column:
        return F.coalesce(F.try_element_at("sizes", F.concat(pool, F.lit(f":{str(single).lower()}"))), F.lit(0)) > 0

    base = F.when(has(F.col("want_pool"), False), F.col("want_pool")).otherwise(F.lit("all"))
    return (
        kinds.withColumn("_k", F.lit(1)).join(F.broadcast(sizes.withColumn("_k", F.lit(1))), "_k")
        .withColumn("pool", base)
        .withColumn("single", F.col("want_single") & has(F.col("pool"), True))
        .select("want_pool", "want_single", "pool", "single")
    )


def wanted_pool(query: Column) -> Column:
    return F.when(contains_any(query, GIRL_WORDS), "girl").when(contains_any(query, BOY_WORDS), "boy").otherwise("all")


def matched_word(query: Column, words: tuple[str, ...]) -> Column:
    return first_contained(query, words)
