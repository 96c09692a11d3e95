"""Divergence audit, prefix trie and decontamination against their SQL, on given and on odd tables."""

import pytest

from namesmith.llm import decontam, divergence, tries
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES = {
    "divergence": (divergence.op11_divergence, divergence.SQL),
    "prefixes": (tries.op12_prefixes, tries.SQL),
    "decontamination": (decontam.op13_decontamination, decontam.SQL),
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, pos int, words string, term string"
ITEMS = "item_id long, text string, item string, k int"
TURNS = "conv_id long, turn long, role string, text string, c long, depth int, k1 string"


def some_docs():
    common = "Alpha beta gamma DELTA epsilon zeta eta theta iota kappa lambda mu"
    long = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(1500))
    texts = [common, common, None, "", f"x {common} y", f"{common} {common}", long, f"{long} {common}", "aa " * 30, "Größe ÉTÉ été 7 été", "one two three", "\x00 tab\tnew\nline", "alpha beta gamma delta epsilon zeta eta theta iota"]
    rows = [(i % 11 or None, t, ("en", "de", None, "")[i % 4], ("a", "b", "", None, "c")[i % 5], 1, 2, 3, "w", "t") for i, t in enumerate(texts * 3)]
    return [*rows, rows[0], rows[0], (99, "!!", "fr", "only", 0, 0, 0, "", "")]


def some_items():
    return [
        (1, "beta gamma delta epsilon zeta eta theta iota kappa lambda", "x", 1), (2, "Two Three", "x", 1), (3, None, "x", 1), (None, "aa aa aa aa aa aa aa aa aa aa", "x", 1), (4, "", "x", 1),
        (1, "été", "x", 1), (5, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "x", 1), (10, "alpha beta gamma delta epsilon", "x", 1), (10, "alpha beta gamma delta epsilon", "x", 1), (6, "new line", "x", 1),
    ]


def some_turns():
    out = [(c, t, "user" if t % 2 else "assistant", f"say {t * (c % 3)}", 1, 2, "k") for c in (*range(0, 12), 100, 101, 102, 205, -5, -130, 10**12 + 3) for t in range(c % 7)]
    return [*out, (300, None, "user", "no number", 1, 2, "k"), (300, 0, None, None, 1, 2, "k"), (300, 0, "user", "", 1, 2, "k"), (300, 0, "user", "", 1, 2, "k"), (None, 1, "user", "nobody", 1, 2, "k"), (301, 5, "a", "bc", 1, 2, "k"), (302, 5, "ab", "c", 1, 2, "k")]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for name, rows, schema in (("documents", some_docs(), DOCS), ("benchmark", some_items(), ITEMS), ("conversations", some_turns(), TURNS)):
        spark.createDataFrame(rows, schema).toPandas().convert_dtypes().to_parquet(at / f"{name}.parquet")
    return str(at)


def views(at):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_as_in_sql(spark, name):
    query, sql = QUERIES[name]
    assert difference(query(spark, SF), duck(SF), sql) is None


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_as_in_sql(spark, odd_dir, name):
    query, sql = QUERIES[name]
    assert difference(query(spark, odd_dir), views(odd_dir), sql) is None


def test_clashing_columns_and_empty_tables(spark):
    docs, items, talk = spark.createDataFrame(some_docs(), DOCS), spark.createDataFrame(some_items(), ITEMS), spark.createDataFrame(some_turns(), TURNS)
    assert decontam.contamination(docs, items).count() == docs.count()
    assert divergence.audit(docs).count() > 0 and tries.trie(talk).count() > 0
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert divergence.audit(docs.limit(0)).count() == 0 and tries.trie(talk.limit(0)).count() == 0


def test_a_shared_node_is_priced_once():
    import numpy as np

    counts = np.tile(np.array([[3, 0, 0, 0, 3, 0, 0, 0], [1, 0, 0, 0, 1, 0, 0, 0]]), (1, 1))
    leaves, stores, roots = divergence.consed(counts)
    assert [len(a) for a, _ in stores] == [3, 2, 2]  # (3,0), (1,0), (0,0); then one node a source
    at, u, v, times = divergence.leaf_pairs(roots, stores, np.array([0]), np.array([1]), len(leaves))
    assert sorted(zip(leaves[u], leaves[v], times)) == [(0, 0, 6), (3, 1, 2)]


def test_shares_are_exact():
    import numpy as np

    for n, m in ((0, 7), (6, 7), (10**13, 2 * 10**14), (2 * 10**14 - 3, 2 * 10**14)):
        assert divergence.shares(np.array([n]), np.array([m]))[0] == 1 + 10**9 * (n + 1) // m


def test_long_conversations_cross_blocks(spark):
    rows = [(1, t, "u", f"t{t}") for t in range(9000)] + [(7, t, "u", f"t{t}") for t in range(5000)]
    own = tries.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = tries.chained(own.withColumn("at", own["r"] - 1), "c", "at", {"total": "chars"}).select("c", "r", "total").collect()
    want, run = {}, {}
    for c, t, _, x in rows:
        run[c] = run.get(c, 0) + len(x)
        want[c, t + 1] = run[c]
    assert {(r.c, r.r): r.total for r in got} == want


def test_fingerprints_of_edited_texts(spark):
    """Texts, edits and digests of every document against a plain loop."""
    import hashlib

    from namesmith.llm import parsing

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in parsing.op7_fingerprints(spark, SF).collect()}
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    own, other = parsing.fingerprints(texts), parsing.fingerprints(edited)
    for (i, t), e, a, b in zip(rows, edited, own, other):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (parsing.packed(a).hex(), parsing.packed(b).hex())
        assert r.near_edited == parsing.likeness(a, b)
