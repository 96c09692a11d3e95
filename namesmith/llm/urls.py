"""URL filter: host and path rules first, then a weighted vocabulary.

Terms are counted by an Aho-Corasick automaton in one pass over the lower-cased URL; a hit
counts only between characters that are no ASCII letter or digit. One strict term or
``SOFT_LIMIT`` distinct soft terms reject. No shuffle; rules are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.llm.common import packed_row, table

# Terms of the vocabulary, each a word of its own in a URL.
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "jackpot", "malware", "nude", "phishing", "porn", "porno", "pornhub", "roulette", "sex", "viagra", "warez", "xnxx", "xvideos", "xxx")
SOFT = ("bet", "bets", "betting", "bonus", "bride", "cam", "cams", "cheap", "cialis", "click", "crack", "dating", "deal", "free", "hack", "hot", "keygen", "loan", "loans", "lottery", "lucky", "nulled", "pharmacy", "pills", "poker", "prize", "serial", "sexy", "slot", "slots", "spam", "spin", "torrent", "win", "winner")
SOFT_LIMIT = 2
# Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, null if none does; of rules of equal length the first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def vocabulary_hits(url: Column, strict=STRICT, soft=SOFT) -> Column:
    """Struct of the number of distinct strict and soft terms in a URL."""

    @F.pandas_udf("strict int, soft int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        terms = ahocorasick.Automaton()
        for weight, words in enumerate((soft, strict)):
            for w in words:
                terms.add_word(w, (weight, w))
        terms.make_automaton()

        def hits(text: str | None) -> tuple[int, int]:
            text = (text or "").lower()
            found = set()
            for end, hit in terms.iter(text):
                start = end - len(hit[1])
                free = [i < 0 or i >= len(text) or not (text[i].isascii() and text[i].isalnum()) for i in (start, end + 1)]
                if all(free):
                    found.add(hit)
            n = sum(w for w, _ in found)
            return n, len(found) - n

        for s in parts:
            yield pd.DataFrame([hits(t) for t in s], columns=["strict", "soft"])

    return count(url)


def judge(df: DataFrame, url: str = "url", limit: int = SOFT_LIMIT) -> DataFrame:
    """Add (or replace) host, path, rule, strict, soft and verdict. A null URL has empty parts and is
    allowed; columns of those names are replaced, others stay; repeated rows are judged alike."""
    added = ("host", "path", "rule", "strict", "soft", "verdict")
    rest = [c for c in df.columns if c not in added]
    out = df.select(packed_row(rest).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), vocabulary_hits(F.col(url)).alias("hits"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when((F.col("hits.strict") > 0) | (F.col("hits.soft") >= limit), "block").otherwise("allow")
    return out.select(*[F.col("row")[c].alias(c) for c in rest], "host", "path", rule.alias("rule"), "hits.*", F.coalesce(verdict, own).alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in RULES]
    order = sorted(range(len(RULES)), key=lambda k: -len(RULES[k][1] + RULES[k][2]))
    case = lambda what: "CASE " + " ".join(fits[k].format(what(RULES[k])) for k in order) + " END"
    n = lambda terms: "(" + " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms) + ")"
    return f"""
    WITH parts AS (
      SELECT page_id, lower(coalesce(url, '')) AS low,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    hits AS (SELECT *, {n(STRICT)} AS strict, {n(SOFT)} AS soft FROM parts)
    SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, strict, soft,
      coalesce({case(lambda r: r[0])}, CASE WHEN strict > 0 OR soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM hits"""


SQL = _sql()
