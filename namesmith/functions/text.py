"""String helpers. Patterns are valid for Java regex; most also for RE2."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The blanks Python's str.strip() removes; all lie below U+3001.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
HANJA = "一-鿿"
HANGUL = "가-힣"


def strip(c: Column) -> Column:
    """Remove leading and trailing blanks, line breaks included."""
    return F.btrim(c, F.lit(BLANKS))


def char_of(code_point: Column) -> Column:
    """Character of a code point of any plane (``chr`` covers one byte only).

    Numbers that are no character, surrogates and those outside 0 to U+10FFFF, give U+FFFD, which no dictionary holds.
    """
    n = code_point.cast("bigint")
    valid = F.when(n.between(0xD800, 0xDFFF) | ~n.between(0, 0x10FFFF), 0xFFFD).otherwise(n)
    # behind a mark of the byte order: without it U+FEFF would be taken for one
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(valid.cast("bigint")), 8, "0"))), "UTF-32")


def code_point_label(c: Column) -> Column:
    """``U+4E00`` style label of the first character; ``ascii`` gives the code point."""
    return F.format_string("U+%04X", F.ascii(c))


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """True where any of the words occurs as a substring."""
    found = c.contains(words[0])
    for word in words[1:]:
        found = found | c.contains(word)
    return found


def first_contained(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """First word of the list that occurs in the text, else null."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words])


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where nothing matches (not '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def split_ko_hanja(c: Column) -> tuple[Column, Column]:
    """``발전격(發展格)`` to its two parts, anchored at the start; else (text, '')."""
    pattern = r"^([^\n]+?)\(([^\n]+?)\)"
    hit = c.rlike(pattern)
    outer = F.when(hit, strip(F.regexp_extract(c, pattern, 1))).otherwise(strip(c))
    inner = F.when(hit, strip(F.regexp_extract(c, pattern, 2))).otherwise(F.lit(""))
    return outer, inner


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no built-in for it."""
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def counted(digits: Column, most: int = 999_999_999) -> Column:
    """A count written in digits, however many; above ``most`` it is ``most``. Null without digits."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(plain) > len(str(most)), F.lit(most)).when(plain.isNotNull(), F.least(plain.try_cast("bigint"), F.lit(most))).cast("int")


def tail_context(c: Column, size: int = 8000, marker: str = "...(앞부분 생략)...\n") -> Column:
    """Keep the last ``size`` characters behind a marker; shorter text is unchanged."""
    return F.when(F.length(c) > size, F.concat(F.lit(marker), F.substring(c, -size, size))).otherwise(c)


def clipped(c: Column, limit: Column) -> Column:
    """First ``limit`` characters, with ``...`` where something was cut."""
    return F.concat(
        F.substring(c, F.lit(1), limit), F.when(F.length(c) > limit, F.lit("...")).otherwise(F.lit(""))
    )


def similarity(distance: Column) -> Column:
    """Displayed similarity, four digits."""
    return F.round(1 - distance, 4)


def metadata_line(entries: Column, hidden: tuple[str, ...] = ("type", "collection", "source")) -> Column:
    """``k: v | k: v`` of a map, keys in order, housekeeping keys hidden."""
    shown = F.map_filter(entries, lambda k, _v: ~k.isin(*hidden))
    pairs = F.array_sort(F.map_entries(shown))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def markdown_table(rows: Column, year: Column, title: Column) -> Column:
    """Pipe table with a caption from an array of rows of cells; '' for an empty table."""
    def line(cells: Column) -> Column:
        clean = F.transform(cells, lambda x: F.coalesce(F.regexp_replace(x, "\n", " "), F.lit("")))
        return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))

    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _x: F.lit("---")), " | "), F.lit(" |"))
    caption = F.concat(F.lit("**[통계 표 기준 연도: "), year, F.lit("년]** *(출처: "), title, F.lit(")*"))
    lines = F.concat(
        F.array(caption, line(head), rule),
        F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line),
    )
    empty = (F.size(rows) < 1) | (F.size(head) < 1)
    return F.when(empty, F.lit("")).otherwise(F.array_join(lines, "\n"))


def blank_share(chars: Column, blanks: Column) -> Column:
    """Percentage of blanks; an empty text counts as 100."""
    return F.when(chars > 0, blanks / chars * 100).otherwise(F.lit(100.0))


def law_page_headers_removed(text: Column, law_name: str, agency: str = "법제처", site: str = "국가법령정보센터") -> Column:
    """Drop the two-line page header a law print repeats on each page."""
    return F.regexp_replace(text, rf"{agency}\s+\d+\s+{site}\n\Q{law_name}\E\n", "")


def law_text_normalized(text: Column) -> Column:
    """Re-join broken lines, squeeze blanks, unify the middle dot, trim."""
    out = F.regexp_replace(text, "-\n", "")
    out = F.regexp_replace(out, rf"(?<=[{HANGUL}])\n(?=[{HANGUL}])", "")
    out = F.regexp_replace(out, "[ \t]{2,}", " ")
    out = F.replace(out, F.lit("・"), F.lit(", "))
    return strip(out)


# Words of law texts that carry no meaning on their own.
LAW_STOPWORDS = (
    "이", "그", "저", "것", "수", "등", "및", "또", "또는", "즉",
    "의", "을", "를", "가", "은", "는", "에", "에서", "로", "으로",
    "와", "과", "도", "만", "까지", "부터", "에게", "한", "하여",
    "따라", "관한", "대한", "위한", "의한", "경우", "때", "중", "후",
    "전", "내", "외", "간", "각", "같은", "다른", "해당", "관련",
)


def content_tokens(text: Column, stopwords: tuple[str, ...] = LAW_STOPWORDS) -> Column:
    """Regex tokens without stop words; one-character tokens only if number or Latin letter."""
    tokens = F.regexp_extract_all(text, F.lit(r"([0-9]+|[A-Za-z]+|[\p{L}]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(
        tokens,
        lambda t: ~F.array_contains(stop, t) & ((F.length(t) >= 2) | t.rlike("^[0-9A-Za-z]+$")),
    )
