"""The whole audit of generated answers as one chain.

A reply is cleaned as text, parsed once into an array of section structs (number, rest of the
section, reading, characters, element clash, worst grade), and every later rule works on the
structs; text is put together once at the end. Facts about characters come from one join, the
81 grades from one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import frames as FR
from namesmith.functions.once import computed_once
from namesmith.functions.text import HANGUL, HANJA, extract, strip
from namesmith.operators import audit as A
from namesmith.operators.chunk import sections_of

# Marks of the answer format.
LEAKED = r"(?s)\n{0,2}\[참고 정보\].*$"
UNMARKED = r"(?m)^\[이름\s+(\d+)\]"
NOTICE = r"(?s)\s*-{3,}\s*⚠️.*$"
BOTH = ("## 한자 이름\n\n", "\n\n## 순우리말 이름\n\n")
WORST_FRAMES = ("형격", "이격", "원격")


def spoken(raw: Column) -> Column:
    """The reply without its thoughts; the whole reply where nothing else is left."""
    said = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    return F.when(said == "", strip(raw)).otherwise(said)


def headers_restored(text: Column) -> Column:
    """Leaked context cut, broken headers rebuilt, lost ``## `` put back."""
    cut = strip(F.regexp_replace(text, LEAKED, ""))
    return F.regexp_replace(A.broken_headers_fixed(cut), UNMARKED, "## [이름 $1]")


def surname_unbracketed(text: Column, surname_hanja: Column) -> Column:
    """``(任瑜津)`` to ``(瑜津)`` for the surname's character."""
    pattern = F.concat(F.lit(r"\(\Q"), surname_hanja, F.lit(rf"\E([{HANJA}]{{1,4}})\)"))
    return F.when(F.coalesce(surname_hanja, F.lit("")) == "", text).otherwise(F.regexp_replace(text, pattern, F.lit("($1)")))


def parsed(text: Column) -> Column:
    """Section structs: ``no`` as printed, ``rest`` behind the header's bracket."""
    parts = sections_of(text)
    head = r"(?s)^\n## \[이름 (\d+)\](.*)$"
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda s: F.struct(F.regexp_extract(s, head, 1).alias("no"), F.regexp_extract(s, head, 2).alias("rest")),
    )


def framed(sections: Column, surname_strokes: Column, grades: Column) -> Column:
    """Frames computed from the printed strokes, in place of the printed line or behind the flow line, and
    ``worst`` where the line shows the worst grade on a frame that counts."""
    def strokes(s: Column, label: str) -> Column:
        return extract(s, rf"{label} 글자\([^)]+\)[^,\n]+,\s*(\d+)획").try_cast("bigint")

    def shown(name: str, n: Column) -> Column:
        return F.concat(F.lit(name), n.cast("string"), F.lit("("), F.coalesce(F.get(grades, (FR.wrapped(n) - 1).cast("int")), F.lit("?")), F.lit(")"))

    def counted(s: Column) -> Column:
        own = s["rest"]
        return F.struct(s["no"].alias("no"), own.alias("rest"), strokes(own, "첫째").alias("s1"), strokes(own, "둘째").alias("s2"), strokes(own, "이름").alias("one"))

    def lined(s: Column) -> Column:
        k = surname_strokes
        short = F.concat_ws(", ", shown("원격", s["one"]), shown("형격", k + s["one"]))
        full = F.concat_ws(", ", shown("원격", s["s1"] + s["s2"]), shown("형격", k + s["s1"]), shown("이격", k + s["s2"]), shown("정격", k + s["s1"] + s["s2"]))
        line = F.when(s["one"].isNotNull(), short).when(s["s1"].isNotNull() & s["s2"].isNotNull(), full)
        line = F.when((k > 0) & ~s["rest"].contains(A.DONE), F.concat(F.lit("**수리**: "), line))
        return F.struct(s["no"].alias("no"), s["rest"].alias("rest"), line.alias("line"))

    def placed(s: Column) -> Column:
        replaced = F.regexp_replace(s["rest"], F.lit(r"\*\*수리\*\*:.*"), s["line"])
        inserted = F.regexp_replace(s["rest"], F.lit(r"(\*\*오행 흐름\*\*:[^\n]+)"), F.concat(F.lit("$1\n"), s["line"]))
        rest = F.when(s["line"].isNull(), s["rest"]).when(s["rest"].contains("**수리**:"), replaced).otherwise(inserted)
        return F.struct(s["no"].alias("no"), rest.alias("rest"))

    def judged(s: Column) -> Column:
        line = F.regexp_extract(s["rest"], r"\*\*수리\*\*:(.+)", 1)
        worst = F.lit(False)
        for frame in WORST_FRAMES:
            worst = worst | (F.regexp_extract(line, rf"{frame}\d+\(([^)]+)\)", 1) == FR.WORST)
        return F.struct(s["no"].alias("no"), s["rest"].alias("rest"), worst.alias("worst"))

    return F.transform(F.transform(F.transform(F.transform(sections, counted), lined), placed), judged)


def described(sections: Column) -> Column:
    """With what the drops look at: ``name`` ('' where the header has none), ``chars``, ``clash``."""
    name, chars = rf"^\s*([{HANGUL}]{{2,5}})", rf"^\s*[{HANGUL}]+\s*\(([{HANJA}]+)\)"
    return F.transform(
        sections,
        lambda s: F.struct(
            s["no"].alias("no"), s["rest"].alias("rest"), s["worst"].alias("worst"), F.regexp_extract(s["rest"], name, 1).alias("name"),
            F.filter(F.split(F.regexp_extract(s["rest"], chars, 1), ""), lambda c: c != "").alias("chars"), s["rest"].contains(A.CLASH).alias("clash"),
        ),
    )


def _renumbered(sections: Column) -> Column:
    return F.transform(sections, lambda s, i: s.withField("no", (i + 1).cast("string")))


def _drop(df: DataFrame, keep: Column, when: Column) -> DataFrame:
    """Replace ``_s`` by ``keep`` where that leaves anything; survivors are numbered from 1."""
    df = computed_once(df, {"_k": keep})
    acts = when & (F.size("_k") > 0)
    return df.select(*[c for c in df.columns if c not in ("_s", "_k", "_touched")], F.when(acts, _renumbered(F.col("_k"))).otherwise(F.col("_s")).alias("_s"), (F.col("_touched") | acts).alias("_touched"))


def names_dropped(df: DataFrame, native: Column, surname: Column) -> DataFrame:
    """Drops in their order: worst frames, clashes, repeated readings, repeated characters, the surname's sound."""
    s = F.col("_s")
    # worst frames: blocks here end before the next header, so the line break before a dropped last block stays
    df = computed_once(df, {"_k": F.filter(s, lambda x: ~x["worst"])})
    lost_last = F.coalesce(F.element_at(F.col("_s"), F.when(F.size("_s") > 0, F.lit(-1)))["worst"], F.lit(False))
    closed = F.transform(_renumbered(F.col("_k")), lambda x, i: x.withField("rest", F.concat(x["rest"], F.when(lost_last & (i == F.size("_k") - 1), F.lit("\n")).otherwise(F.lit("")))))
    df = computed_once(df, {"_s": F.when(~native & (F.size("_k") > 0), closed).otherwise(s)}).drop("_k")
    df = _drop(df, F.filter(s, lambda x: ~x["clash"]), F.exists(s, lambda x: x["clash"]) | F.col("_pre").contains(A.CLASH))
    sound = lambda x: F.when(x["name"] != "", F.substring(x["name"], 2, 10))
    df = computed_once(df, {"_sounds": F.transform(s, sound)})
    first = F.filter(s, lambda _x, i: F.get("_sounds", i).isNull() | (F.array_position("_sounds", F.get("_sounds", i)) == i + 1))
    df = _drop(df, first, F.size(first) < F.size(s)).drop("_sounds")

    def step(state: Column, x: Column) -> Column:
        taken = F.arrays_overlap(state["seen"], x["chars"])
        return F.struct(
            F.when(taken, state["seen"]).otherwise(F.concat(state["seen"], x["chars"])).alias("seen"), F.when(taken, state["kept"]).otherwise(F.array_append(state["kept"], x)).alias("kept")
        )

    kind = df.schema["_s"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(kind).alias("kept"))
    df = computed_once(df, {"_g": F.aggregate(s, start, step)["kept"]})
    df = _drop(df, F.col("_g"), ~native & (F.size("_g") < F.size(s))).drop("_g")
    other = F.filter(s, lambda x: (x["name"] == "") | (F.substring(x["name"], -1, 1) != surname))
    return _drop(df, other, (surname != "") & (F.size(other) < F.size(s)))


def facts_joined(answers: DataFrame, answer_id: str, text: str, strokes: DataFrame, readings: DataFrame) -> DataFrame:
    """Add ``_strokes`` and ``_readings``, maps from the characters of each answer."""
    both = strokes.select("hanja", "strokes").join(readings.select("hanja", "hangul"), "hanja", "full").select("hanja", F.struct("strokes", "hangul").alias("fact"))
    known = A.character_facts(answers, answer_id, text, both, "fact")

    def of(name: str) -> Column:
        return F.transform_values(F.map_filter("facts", lambda _k, v: v[name].isNotNull()), lambda _k, v: v[name])

    return known.select(*answers.columns, of("strokes").alias("_strokes"), of("hangul").alias("_readings"))


def audited(answers: DataFrame, answer_id: str, raw: str, strokes: DataFrame, readings: DataFrame, grades: DataFrame) -> DataFrame:
    """``answers`` with ``text``, the audited reply.

    ``answers``: answer_id, the raw reply, surname, surname_hanja, surname_strokes (0: unknown) and native (a
    native-word answer, whose frames and characters are not looked at). ``strokes`` and ``readings`` have one row
    a character. Rewritings by a model between the rules are not built. Name headers start a line.
    """
    own = answers.columns
    df = computed_once(answers, {"_t": headers_restored(spoken(F.coalesce(F.col(raw), F.lit(""))))})
    df = computed_once(facts_joined(df, answer_id, "_t", strokes.filter("strokes > 0"), readings), {"_t": surname_unbracketed(F.col("_t"), F.col("surname_hanja"))})
    df = computed_once(df, {"_t": A.reading_headers(F.col("_t"), F.col("surname"), F.col("_readings"))})
    df = computed_once(df, {"_t": A.verdicts_corrected(A.stroke_lines(F.col("_t"), F.col("_strokes")))})
    df = df.crossJoin(F.broadcast(FR.grade_list(grades)))
    native = F.coalesce(F.col("native"), F.lit(False))
    plain = F.transform(parsed(F.col("_t")), lambda s: F.struct(s["no"].alias("no"), s["rest"].alias("rest"), F.lit(False).alias("worst")))
    counted = framed(parsed(F.col("_t")), F.when(native, F.lit(0)).otherwise(F.col("surname_strokes")).cast("bigint"), F.col("_grades"))
    df = computed_once(df, {"_s": F.when(native, plain).otherwise(counted), "_pre": F.get(sections_of(F.col("_t")), F.lit(0))})
    df = computed_once(df.withColumn("_touched", F.lit(False)), {"_s": described(F.col("_s"))})
    df = names_dropped(df, native, F.coalesce("surname", F.lit("")))
    body = F.array_join(F.transform("_s", lambda s: F.concat(F.lit("\n## [이름 "), s["no"], F.lit("]"), s["rest"])), "")
    text = F.when(F.col("_touched"), F.concat(F.regexp_replace("_pre", r"^\n+", ""), body)).otherwise(F.substring(F.concat("_pre", body), 2, 2147483647))
    return df.select(*own, text.alias("text"))


def both_kinds(hanja: Column, native: Column) -> Column:
    """One answer with names in characters and in native words."""
    return F.concat(F.lit(BOTH[0]), strip(F.regexp_replace(hanja, NOTICE, "")), F.lit(BOTH[1]), native)
