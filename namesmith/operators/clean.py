"""Line-wise cleaning of scanned dictionary text.

Every rule is a column expression on one line, with the number of changes it makes; the
rules run in a fixed order as a chain of projections, so the whole pass is one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.once import computed_once
from namesmith.functions.text import strip

Lines = Callable[[Column], Column]

# Every 28th syllable from 가 on has no final consonant.
OPEN_SYLLABLES = "".join(chr(0xAC00 + 28 * i) for i in range(399))
CLOSED = f"[가-힣&&[^{OPEN_SYLLABLES}]]"

# Blanks of any script, as members of a class.
BLANK = r"\s\x1C-\x1F\x85\p{Z}"
# Page headers of the scanned book.
HEADERS = (rf"^아름답고[{BLANK}]+정겨운[{BLANK}]+우리말[{BLANK}]*\p{{Nd}}+[{BLANK}]*$", rf"^색[{BLANK}]+인[{BLANK}]*\p{{Nd}}+[{BLANK}]*$", rf"^\p{{Nd}}+[{BLANK}]*$")
SEPARATOR = "=== PAGE"

# Misread forms of one verb and their corrections, in order.
VERB_FIXES = (
    ("농고서", "놓고서"), ("농아두", "놓아두"), ("농아서", "놓아서"), ("농아라", "놓아라"), ("농으며", "놓으며"),
    ("농지만", "놓지만"), ("농아도", "놓아도"), ("농고는", "놓고는"), ("농고도", "놓고도"), ("농고자", "놓고자"),
    ("농고서", "놓고서"), ("농았다", "놓았다"), ("농았으", "놓았으"), ("농고", "놓고"), ("농은", "놓은"),
    ("농다", "놓다"), ("농아", "놓아"), ("농지", "놓지"),
)

# Words the particle rule turns wrong, restored in order.
RESTORES = (("엿기를 올", "엿기름을"), ("엿기를", "엿기름"), ("시름시를", "시름시름"), ("업시를", "업시름"))

# The patterns of the rules.
POS_TAG = r"['\[「『]?\s*(명의|의존명사|접사|명|동|형|부|관|수|대|감)\s*[」\]!_,\.;\-\)~]"
# the rare syllable is matched first, the costly class is only tried behind it
PARTICLE = rf"[올흘](?<={CLOSED}[올흘])(?=[ \t\n.,;:!?」』)>'가-힣]|\z)"
ENDING = rf"없(?<={CLOSED}없)(?=다)"
EXAMPLE = rf"(?<!\p{{Nd}})끼(?=[가-힣{BLANK}])"
EXAMPLE_NINE = rf"(^|[{BLANK}])9([{BLANK}]+[가-힣])"
AFTER_QUOTE = rf"(?<=['\"‘’])[{BLANK}]*[논눈](?=[{BLANK}])"
BOUNDARY = rf"(?=[{BLANK}\]\)\.,;:'\"<>])"
# Words that end in one of the misread syllables and stay.
KEPT_REUL = ("이름", "나름", "아름", "거름", "고름", "노름", "오름", "보름", "구름", "지름", "부름", "모름", "사름", "기틀", "씨틀", "베틀", "발틀", "이틀")
KEPT_NEUN = ("군눈", "곁눈", "외눈", "왼눈")
REUL = rf"([가-힣]{{2}})[틀름률](?<!{'|'.join(KEPT_REUL)}){BOUNDARY}"
NEUN = rf"([가-힣]{{2}})[논눈](?<!{'|'.join(KEPT_NEUN)}){BOUNDARY}"
ANY_REUL = rf"[가-힣]{{2}}[틀름률]{BOUNDARY}"
ANY_NEUN = rf"[가-힣]{{2}}[논눈]{BOUNDARY}"
NOISE_BRACKET = r"\[[^가-힣\]]{0,8}\]"
DEFINITION_MARK = r"(?<=[\]>:.])(\s*)@(?=[가-힣(])"


def _replaced(pairs: tuple[tuple[str, str], ...], line: Column, per_line: bool) -> Column:
    """Struct (line, n) after literal replacements in order; n counts patterns or occurrences."""
    steps = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right")) for w, r in pairs])

    def step(state: Column, pair: Column) -> Column:
        hits = (F.length(state["line"]) - F.length(F.replace(state["line"], pair["wrong"], F.lit("")))) / F.length(pair["wrong"])
        n = F.contains(state["line"], pair["wrong"]).cast("int") if per_line else hits.cast("int")
        return F.struct(F.replace(state["line"], pair["wrong"], pair["right"]).alias("line"), (state["n"] + n).alias("n"))

    start = F.struct(line.alias("line"), F.lit(0).alias("n"))
    # one syllable all the wrong forms share decides whether to look at all
    shared = next(c for c in pairs[0][0] if all(c in w for w, _ in pairs))
    return F.when(line.contains(shared), F.aggregate(steps, start, step)).otherwise(start)


@dataclass(frozen=True)
class Rule:
    """A rewrite of a line and the count of its changes."""

    name: str
    apply: Lines
    count: Lines


def _without(line: Column, marks: tuple[str, ...]) -> Column:
    none = ~line.contains(marks[0])
    for mark in marks[1:]:
        none = none & ~line.contains(mark)
    return none


def _marked(rule: Rule, *marks: str) -> Rule:
    """The rule behind a search for literals one of which each of its matches holds; other lines stay, at no pattern's cost."""
    return Rule(
        rule.name,
        lambda line: F.when(_without(line, marks), line).otherwise(rule.apply(line)),
        lambda line: F.when(_without(line, marks), F.lit(0)).otherwise(rule.count(line)),
    )


def _pattern(name: str, pattern: str, to: str, marks: tuple[str, ...], count: str = "matches") -> Rule:
    def apply(line: Column) -> Column:
        return F.regexp_replace(line, pattern, to)

    def n(line: Column) -> Column:
        return F.regexp_count(line, F.lit(pattern)) if count == "matches" else (apply(line) != line).cast("int")

    return _marked(Rule(name, apply, n), *marks)


def _markers(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, EXAMPLE, "¶"), EXAMPLE_NINE, "$1¶$2")


def _space_particles(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, REUL, "$1를"), NEUN, "$1는")


def _space_count(line: Column) -> Column:
    # protected words count as looked at, like the recorded totals
    return F.regexp_count(line, F.lit(ANY_REUL)) + F.regexp_count(F.regexp_replace(line, REUL, "$1를"), F.lit(ANY_NEUN))


RULES = (
    Rule("nohta_fixed", lambda c: _replaced(VERB_FIXES, c, True)["line"], lambda c: _replaced(VERB_FIXES, c, True)["n"]),
    _pattern("pos_fixed", POS_TAG, "[$1]", ("명", "접사", "동", "형", "부", "관", "수", "대", "감")),
    _pattern("particle_fixed", PARTICLE, "을", ("올", "흘")),
    _pattern("eotda_fixed", ENDING, "었", ("없다",), "lines"),
    _marked(Rule("marker_fixed", _markers, lambda c: (_markers(c) != c).cast("int")), "끼", "9"),
    _pattern("quote_particle_fixed", AFTER_QUOTE, "는", ("논", "눈")),
    _marked(Rule("space_particle_fixed", _space_particles, _space_count), "틀", "름", "률", "논", "눈"),
    Rule("false_pos_restored", lambda c: _replaced(RESTORES, c, False)["line"], lambda c: _replaced(RESTORES, c, False)["n"]),
    _pattern("noise_bracket_fixed", NOISE_BRACKET, "", ("[",)),
    _pattern("double_mi_fixed", r"\[\[미\]", "[비]", ("[[미]",), "lines"),
    _pattern("def_marker_at_fixed", DEFINITION_MARK, "$1 ¶", ("@",)),
)
HEADER_RULE = "header_removed"


def is_separator(line: Column) -> Column:
    return line.startswith(SEPARATOR)


def is_header(line: Column) -> Column:
    return strip(line).rlike("|".join(f"(?:{pattern})" for pattern in HEADERS))


def squeezed(line: Column) -> Column:
    return strip(F.regexp_replace(line, " {2,}", " "))


def _ruled(lines: DataFrame, line: str) -> DataFrame:
    """Add ``_keep`` (a separator), ``header_removed``, one count per rule, and ``_l``, the line after all rules."""
    separator, header = is_separator(F.col(line)), is_header(F.col(line))
    df = lines.withColumn("_keep", separator).withColumn(HEADER_RULE, (~separator & header).cast("int")).withColumn("_l", F.col(line))
    skip = F.col("_keep") | (F.col(HEADER_RULE) == 1)
    for rule in RULES:
        df = df.select(
            *[c for c in df.columns if c != "_l"], F.when(skip, 0).otherwise(rule.count(F.col("_l"))).alias(rule.name),
            F.when(skip, F.col("_l")).otherwise(rule.apply(F.col("_l"))).alias("_l"),
        )
    return df


def with_rules(lines: DataFrame, line: str) -> DataFrame:
    """Add ``cleaned``, ``header_removed`` and one count per rule.

    ``cleaned`` is null where the line is dropped: a header, or emptied by the rules.
    Separators pass through untouched.
    """
    df = _ruled(lines, line)
    done = squeezed(F.col("_l"))
    emptied = (done == "") & (strip(F.col(line)) != "")
    cleaned = F.when(F.col("_keep"), F.col(line)).when((F.col(HEADER_RULE) == 1) | emptied, F.lit(None)).otherwise(done)
    return computed_once(df, {"cleaned": cleaned}).drop("_keep", "_l")


def clean_lines(lines: DataFrame, line: str) -> DataFrame:
    """The kept lines after all rules."""
    return with_rules(lines, line).filter(F.col("cleaned").isNotNull()).drop(HEADER_RULE, *[r.name for r in RULES])


def rule_counts(lines: DataFrame, line: str) -> DataFrame:
    """One row per rule with its number of changes, in one pass."""
    names = [HEADER_RULE, *[r.name for r in RULES]]
    totals = _ruled(lines, line).agg(*[F.sum(n).alias(n) for n in names])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names])).alias("_r")).select("_r.*")


def change_log(lines: DataFrame, line: str, order: list[str], limit: int = 200) -> DataFrame:
    """The first ``limit`` logged changes in input order: removed headers and tag fixes.

    A log entry shows at most 60 characters of the line, as a display cut.
    """
    verb = RULES[0].apply(F.col(line))
    tagged = RULES[1].apply(F.col("_before"))
    rows = lines.withColumn("_before", verb).withColumn("_after", tagged)
    header = ~is_separator(F.col(line)) & is_header(F.col(line))
    n = F.regexp_count("_before", F.lit(POS_TAG))
    entry = F.when(header, F.concat(F.lit("[헤더삭제] "), line)).when(
        ~is_separator(F.col(line)) & (F.col("_after") != F.col("_before")),
        F.concat(F.lit("[품사태그 "), n, F.lit("건] "), F.substring("_before", 1, 60), F.lit(" → "), F.substring("_after", 1, 60)),
    )
    return rows.select(*order, entry.alias("entry")).filter(F.col("entry").isNotNull()).orderBy(*order).limit(limit)
