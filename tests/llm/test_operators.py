"""Operators of namesmith.llm on odd rows and against brute force."""

import base64
import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from namesmith.llm import bpe, common, langid, lines, neardup, packing, parsing, private, quality, scoring, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, node string, spans string, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", None, 0, 7, "x", "y", True) for r in rows], SCHEMA)


def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(20000))
    return frame(spark, [(1, "one line of text\nand another one"), (1, "one line of text\nand another one"), (None, None), (2, ""), (3, long), (4, long), (None, " \n\t"), (5, "é" * 3 + "=" * 300)])


OPERATORS = {
    "language": lambda d: langid.identify(d, langid.profiles(d)),
    "lines": lines.dedup,
    "neardup": neardup.classes,
    "kept": neardup.dedup,
    "private": private.find,
    "sanitised": private.sanitise,
    "packing": lambda d: packing.pack(d, packing.tokenizer_path()),
    "bpe": lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "fingerprint": parsing.fingerprint,
    "edits": parsing.with_edits,
    "quality": quality.judge,
    "scores": lambda d: scoring.score(d, scoring.Model(d.sparkSession, d)),
    "urls": lambda d: urls.judge(d, "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    rows = odd(spark)
    n = OPERATORS[name](rows).count()
    if name == "packing":
        assert n >= rows.count()
    elif name == "kept":
        assert n == 5  # the repeated row, the null and empty texts as one, the long copies, the blank one, the last
    else:
        assert n == rows.count()
    assert OPERATORS[name](rows.limit(0)).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0


CLASHING = (
    "_", "row", "doc", "id", "guess", "_guess", "lang_pred", "score", "_id", "_h", "__id", "__h", "runs", "__runs", "n_removed", "node", "n", "__n", "label",
    "_text", "_row", "_base", "spans", "_s", "_top", "_at", "_new", "_terms", "_found", "hits", "_hits", "bpe", "_bpe",
)


@pytest.mark.parametrize("name", ["language", "lines", "neardup", "private"])
def test_stages_carry_columns_of_any_name_and_odd_rows(spark, name):
    plain = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("text"), F.lit("null"))).alias(c) for c in CLASHING])
    stage = dict(corpus_pipeline.STAGES)[name]
    got, want = stage(spark, docs, SF), stage(spark, plain, SF)
    assert got.columns == docs.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted((tuple(r) for r in got.select(plain.columns).collect()), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)
    given = {(r.doc_id, r.row) for r in docs.select("doc_id", "row").collect()}
    for r in sorted(got.collect(), key=key):
        assert all(r[c][len(c) + 1 :] == r.row[4:] for c in CLASHING) and (r.doc_id, r.row) in given


def test_encoding_and_urls_carry_columns_of_any_name(spark):
    own = list(CLASHING)
    docs = spark.createDataFrame([(1, "https://a.org/x casino")], "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in own])
    rank = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()
    page = urls.judge(docs, "text").first()
    assert all(rank[c] == c and page[c] == c for c in own)
    assert rank.decoded.decode() == docs.first().text and (page.host, page.verdict) == ("a.org", "allow")


def test_language_stage_without_any_language(spark):
    """Nothing can be learned: texts with a letter stay without a language, others go."""
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "x", None), (4, "x", None)], "doc_id long, text string, lang string")
    got = [tuple(r) for r in langid.stage(spark, docs, SF).orderBy("doc_id").collect()]
    assert got == [(1, "some text", None), (4, "x", None), (4, "x", None)]


def test_recent_keeps_two_generations():
    made = []

    def make(keys):
        made.extend(keys)
        return [k.upper() for k in keys]

    recent = common.Recent(3)
    for keys in ({"a", "b"}, {"a", "c"}, {"d", "e"}, {"a", "d"}, {"b"}, set("vwxyz")):
        got = recent.holding(set(keys), make)
        assert all(got[k] == k.upper() for k in keys)
    assert len(recent.young) <= 5 and made.count("a") == 1 and made.count("d") == 1


def test_weights_are_occurrences():
    import random

    rng = random.Random(3)
    a, b = (" ".join(rng.choice("xyz") for _ in range(200)) for _ in range(2))
    grams = [collections.Counter(tuple(t.split()[k : k + 5]) for k in range(196)) for t in (a, b)]
    sets = [neardup.occurrences(*neardup.shingles(t)) for t in (a, b)]
    assert [len(s) for s in sets] == [196, 196]
    assert neardup.jaccard(*sets) == (grams[0] & grams[1]).total() / (grams[0] | grams[1]).total()


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_bpe_round_trip(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, SF).collect()}
    for i, t in texts(spark):
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_packing_is_gapless_and_whole(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), packing.tokenizer_path()).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, text in texts(spark):
        ids = b"".join(bytes(r.ids) for r in sorted(docs[i], key=lambda r: r.piece))
        want = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert ids == b"".join(x.to_bytes(4, "little") for x in want)
        assert all(r.length == 1024 for r in docs[i] if r.piece)
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_matches_get_the_ids_of_whole_texts():
    coder = packing.Coder(packing.tokenizer_path())
    texts = ["".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x11000))), " a  b\n\n c\t\u00a0d's  we'LL 12 345 ...  ", "a\n \nb", " x", "x ", "a \u3000b c\n d\n\n e\x1c f \x1cg", "a\u2028 b \u2028c", "\U0001f600 e\u0301 \x00\x7f\x80\xad"]
    assert list(coder.encode(texts)) == coder.fresh(texts)
    assert list(coder.matches([" na\u00efve", "\xad", "\x00"])) == coder.fresh([" na\u00efve", "\xad", "\x00"])


def test_packing_gives_added_tokens_their_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = ["a <|endoftext|> b", "a <|endoftext b", "<|endoftext|>", "plain words", "x<|endoftext|><|endoftext|>\n y"]
    got = packing.pack(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), packing.tokenizer_path()).collect()
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(rows)}
    assert {r.doc_id: [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] for r in got} == want
    assert want[0] == [64, 220, 50256, 275, 2]


def test_neardup_matches_all_pairs(spark):
    rows = texts(spark)
    sets = {i: (lambda w: {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set())(WORD.findall(t)) for i, t in rows}
    up = {i: i for i, _ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert {r.doc_id: r.class_id for r in neardup.op1_neardup(spark, SF).collect()} == {i: root(i) for i in sets}


def test_weighted_signatures_follow_weighted_jaccard():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = np.arange(1, 61) * 0.5, np.arange(60, 0, -1) * 0.5
    sig = neardup.signatures([(h, a), (h, b)], 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_neardup_in_a_group_of_unequal_copies(spark):
    """Copies with few to many edits, drawn from few words: most pairs lie around the threshold."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = rng.choice("xy")
        rows.append((i, " ".join(words)))
    sets = [neardup.shingles(t)[0] for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if up[i] != up[j] and neardup.jaccard(sets[i], sets[j]) >= 0.8:
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(up))
    assert len(set(up)) > 5


def test_planes_count_equal_coordinates(spark):
    words = [f"w{i}" for i in range(400)]
    near = [w if i % 45 else "x" for i, w in enumerate(words)]
    _, kept = neardup.bands([" ".join(words), " ".join(near), "", " ".join(words)])
    row = spark.createDataFrame([tuple(kept)], "a array<long>, b array<long>, c array<long>, d array<long>")
    got = row.select(neardup.agreeing(F.col("a"), F.col("b")), neardup.agreeing(F.col("a"), F.col("d"))).first()
    sets = [neardup.shingles(" ".join(t))[0] for t in (words, near)]
    assert kept[2] == [] and got[1] == neardup.COORDINATES
    assert abs(got[0] / neardup.COORDINATES - neardup.jaccard(*sets)) < 0.15
    assert 70 <= neardup.least_agreeing(0.8) <= 85 and neardup.least_agreeing(1.0) == neardup.COORDINATES


def test_lines_match_brute_force(spark):
    seen, found, whole = {}, [], {}
    for i, t in texts(spark):
        whole[i] = t.split("\n")
        own = [(p, x, len(WORD.findall(x))) for p, x in enumerate(whole[i]) if WORD.search(x)]
        for a in range(len(own)):
            for d in (1, -1):
                n, b = 0, a
                while 0 <= b < len(own) and n + own[b][2] < 50:
                    n, b = n + own[b][2], b + d
                if 0 <= b < len(own):
                    lo, hi = min(a, b), max(a, b)
                    key, at = tuple(x for _, x, _ in own[lo : hi + 1]), (i, own[lo][0])
                    seen[key] = min(seen.get(key, at), at)
                    found.append((key, at, own[hi][0]))
    gone = collections.defaultdict(set)
    for key, at, hi in found:
        if seen[key] < at:
            gone[at[0]].update(range(at[1], hi + 1))
    got = {r.doc_id: r.text for r in lines.op4_lines(spark, SF).collect()}
    assert got == {i: "\n".join(x for p, x in enumerate(v) if p not in gone[i]) for i, v in whole.items()}


def test_private_spans_and_text(spark):
    text = "ü a@b.co, 10.0.0.256 10.0.0.25 +1 (988) 555-2485; 4111 1111 1111 1111"
    r = private.find(frame(spark, [(1, text)])).first()
    assert [(s.kind, text[s.start : s.end]) for s in r.spans] == [("email", "a@b.co"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]
    assert private.sanitise(frame(spark, [(1, text)])).first().text == "ü <EMAIL>, 10.0.0.256 <IP> <PHONE>; <CARD>"


def test_private_terms_that_reveal(spark):
    rows = [(i, f"mail x@y.zz of captain{'' if i % 2 else ','} seen by person{i} codename walrus near place{i}") for i in range(6)]
    rows += [(100 + i, f"the harbour was seen by person{i} near place{i}") for i in range(40)]
    spans = private.find(frame(spark, rows)).filter("doc_id = 0").first().spans
    assert "codename" in {s.match for s in spans} and "seen" not in {s.match for s in spans}


def test_private_terms_are_replaced_in_every_document(spark):
    rows = [(i, f"mail x@y.zz of captain{'' if i % 2 else ','} seen by person{i} codename walrus near place{i}") for i in range(6)]
    rows += [(100 + i, f"the harbour was seen by person{i} near place{i}") for i in range(40)]
    rows += [(200, "Codename heard without the address"), (200, "Codename heard without the address")]
    got = private.find(frame(spark, rows))
    spans = [r.spans for r in got.filter("doc_id = 200").collect()]
    assert [[(s.kind, s.start, s.end, s.match) for s in x] for x in spans] == [[("term", 0, 8, "Codename")]] * 2
    assert got.filter("doc_id >= 100 AND doc_id < 200 AND size(spans) > 0").count() == 0
    assert [r.text for r in private.sanitise(frame(spark, rows)).filter("doc_id = 200").collect()] == ["<TERM> heard without the address"] * 2


def test_language_held_out(spark):
    df = langid.op2_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = df.filter("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_quality_rejects_labelled_junk_only(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in got)


def test_quality_follows_the_spread_of_the_rows(spark):
    """Distances are those of a brute-force estimate; many capitals are far from texts that have few."""
    import random

    import numpy as np

    rng = random.Random(9)
    rows = []
    for i in range(160):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 240))]
        words = [w.capitalize() if rng.random() < 0.1 else w for w in words]
        if i < 5:
            words = [w.upper() if rng.random() < 0.3 else w for w in words]
        rows.append((i, " ".join(words), "xx", f"s{i % 2}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    stats = quality.measured(df, "text", ("doc_id",)).select("doc_id", *[v.alias(n) for v, n in zip(quality.vector(), quality.FEATURES)])
    at = {r[0]: r[1:] for r in stats.collect()}
    middle = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    spread = lambda v: 1.4826 * middle(abs(v - middle(v)))
    every = spread(np.array([at[i] for i in range(160)]))
    floor = np.diag(np.where(every > 0, every, quality.FLOOR) ** 2)
    for source in (0, 1):
        x = np.array([at[i] for i in range(source, 160, 2)])
        mean, cov = middle(x), np.diag(spread(x) ** 2) + floor
        for step in range(quality.STEPS + 1):
            d = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
            half = x[d <= middle(d)]
            mean, cov = half.mean(axis=0), quality.CONSISTENT * np.cov(half.T, bias=True) + floor
        assert np.allclose([got[i].distance for i in range(source, 160, 2)], d, rtol=1e-6)
    assert {i for i in got if not got[i].kept} == set(range(5))


def test_scores_beat_the_base_on_held_out_texts(spark):
    got = scoring.op5_scores(spark, SF).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_equal_texts_have_equal_fingerprints_and_parts_are_shared():
    a, b = ("The quick brown fox number %d jumps. " * 40) % tuple(range(40)), "Wholly other text about ships. " * 30
    f = parsing.fingerprints([a, a, a[7:], b])
    assert parsing.packed(f[0]) == parsing.packed(f[1])
    assert parsing.likeness(f[0], f[2]) > 0.8 > 0.1 > parsing.likeness(f[0], f[3])


def test_short_batches_bound_rows_and_bytes(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {n: spark.conf.get(n) for n in names}

    def sizes(batches):
        for pdf in batches:
            yield pdf.iloc[:1].assign(id=len(pdf), text="")

    rows = spark.range(0, 2500, 1, 1).withColumn("text", F.lit("x"))
    long = spark.range(0, 40, 1, 1).withColumn("text", F.repeat(F.lit("x"), 1 << 20))
    try:
        common.short_batches(spark)
        assert [r.id for r in rows.mapInPandas(sizes, "id long, text string").collect()] == [1000, 1000, 500]
        got = [r.id for r in long.mapInPandas(sizes, "id long, text string").collect()]
        assert sum(got) == 40 and max(got) <= 5
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_scores_use_the_words_before_and_price_new_words(spark):
    train = [(i, "alpha beta gamma delta") for i in range(20)] + [(20 + i, "delta gamma beta alpha " + w) for i, w in enumerate(("omega", "omicron"))]
    model = scoring.Model(spark, spark.createDataFrame(train, "doc_id long, text string"))
    texts = ["alpha beta gamma delta", "beta alpha delta gamma", "alpha xjqzkv", "alpha alpho", "alpha beta gamma delta", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = scoring.score(rows, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert sorted(r.doc_id for r in got) == [0, 0, 1, 2, 3, 4, 5]  # repeated rows come as often as they occur
    assert by[0] == pytest.approx(by[4])
    assert by[0] > by[1] + 1  # the same words in an order not met
    assert by[3] > by[2] + 1  # new words by their spelling
    assert by[2] < by[0] - 3


def test_probabilities_of_word_contexts_add_up_to_one():
    rng = np.random.default_rng(3)
    root = rng.dirichlet(np.ones(50))
    tokens = rng.zipf(1.5, 4000) % 50
    cells, c = np.unique(tokens[:-2] << 2 * scoring.BITS | tokens[1:-1] << scoring.BITS | tokens[2:], return_counts=True)
    seating = scoring.Seating(cells, c.astype(float), root, 0)
    for two, one in ((1, 1), (1, 2), (49, 1), (60, 1), (60, 61)):  # met, and not met
        asked = two << 2 * scoring.BITS | one << scoring.BITS | np.arange(50)
        p = seating.probabilities(asked)
        assert p.min() > 0 and p.sum() == pytest.approx(1)
    assert (seating.tables >= 1).all()
    vocabulary = scoring.Vocabulary([(scoring.END, 9), (b"a", 5)], 3 * scoring.SLICE)
    found = np.concatenate([at for _, at in vocabulary.dealt(cells)])
    assert sorted(found) == list(range(len(cells)))
    x, of = vocabulary.cells([[b"a", b"b", scoring.END], [b"a", scoring.END]])
    assert [int(v) & scoring.MASK for v in x] == [2, 0, 1, 2, 1] and list(of) == [0, 0, 0, 1, 1]
    assert [int(v) >> 2 * scoring.BITS for v in x] == [1, 1, 2, 1, 1] and int(x[4]) >> scoring.BITS & scoring.MASK == 2


def test_scores_deal_texts_out_once_and_compactly(spark):
    odd = ["Alpha\x0bbeta\x1cgamma  alpha x\r\n", "", None, " \t\n", "alpha\x00 bÄ new", "beta alpha alpha"]
    docs = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(odd * 3)], "doc_id long, text string, learned boolean")
    model = scoring.Model(spark, docs.filter("learned"))
    once = {r.doc_id: r for r in scoring.score(docs, model, learn="learned").collect()}
    twice = {r.doc_id: r for r in scoring.score(docs, model).collect()}
    words = [[*(t or "").encode().lower().split(), b"\t"] for t in odd * 3]
    c = collections.Counter(w for i, t in enumerate(words) if i % 2 == 0 for w in t)
    for i, t in enumerate(words):
        base = sum(math.log10((c[w] + 1) / (c.total() + 1 * (len(c) + 1))) for w in t)
        for got in (once[i], twice[i]):
            assert (got.n_tokens, got.n_known, got.train_tokens) == (len(t), sum(w in c for w in t), c.total())
            assert got.base_score == pytest.approx(base)
        assert once[i].score == pytest.approx(twice[i].score, abs=1e-3)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("_row"), F.coalesce("text", F.lit("")).alias("_t"), F.lit(True).alias("_learn"))
    listed = scoring.word_counts(texts, "_t").orderBy(F.desc(F.col("word") == F.lit(scoring.END)), F.desc("c")).collect()
    n = sum(r.c for r in listed)
    vocabulary = spark.sparkContext.broadcast(scoring.Vocabulary([(bytes(r.word), r.c) for r in listed[: len(listed) // 2]], n))
    rows = scoring.dealt(texts.coalesce(1), vocabulary).collect()
    assert {r.slice < 0 for r in rows} == {True, False}
    assert sum(len(x) for r in rows for x in (r.keys, r.c, r.texts) if x is not None) < 8 * n


def test_packing_encodes_a_word_met_lately_once():
    coder, asked = packing.Coder(packing.tokenizer_path()), []
    make = coder.matches
    coder.matches = lambda words: asked.append(len(words)) or make(words)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(26**4)]
    texts = [" ".join(words[k : k + 5000]) for k in range(0, 440_000, 5000)]
    first = [coder.encode([t]) for t in texts]
    n = sum(asked)
    assert [coder.encode([t]) for t in texts] == first and sum(asked) == n
    assert first[0] == coder.fresh(texts[:1])


def test_bands_hold_little_at_once():
    import tracemalloc

    texts = [" ".join(f"w{i * 400 + k}" for k in range(400)) for i in range(512)]
    neardup.bands(texts[:1])
    tracemalloc.start()
    got = neardup.bands(texts)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 24e6 and now < 4e6
    assert got[0][7] == neardup.bands(texts[7:8])[0][0] and got[1][7] == neardup.bands(texts[7:8])[1][0]


def test_packing_stage_remembers_few_words(monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "short_batches", lambda *a: None)
    monkeypatch.setattr(packing, "pack", lambda *a, **more: asked.update(more))
    packing.stage(None, None, SF)
    coder = packing.Coder(packing.tokenizer_path())
    coder.known = common.Recent(asked.get("known", packing.KNOWN))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(26**4)]
    texts = [" ".join(words[k : k + 5000]) for k in range(0, 400_000, 5000)]
    last = [coder.encode([t]) for t in texts][-1]
    assert len(coder.known.old) + len(coder.known.young) <= 210_000
    assert last == coder.fresh(texts[-1:])
