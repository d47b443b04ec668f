"""Operators over the corpus: line dedup, near duplicates, mixing, rollups, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import bpe, linededup, mixing, ngramjoin, rollup
from tracefold.llm.common import fresh_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_dropped string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "src" + str((k or 0) % 3), len(t or ""), "clash") for k, t in rows], SCHEMA).repartition(3)


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if k is not None and len(key(line)) >= 10:
                holders[key(line)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (k is not None and len(holders[key(x)]) > 1 and min(holders[key(x)]) != k)] if k is not None else lines
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [f"  Line number {k} of the POOL\t" for k in range(40)] + ["short", "", "éèàùçéèàù", "éèàùçéèàùç", " the same line of all "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(70, None), (71, ""), (None, " the same line of all "), (5, "LINE number 1 of the pool\n" * 3), (5, "only here, twice by one id"), (5, "only here, twice by one id"), (80, "x" * 100_000 + "\n" + "x" * 100_000)]
    out = linededup.line_dedup(docs(spark, rows))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert linededup.line_dedup(docs(spark, rows).filter("false")).count() == 0


def test_line_filters_never_miss(spark):
    digests = [hashlib.blake2b(str(k).encode(), digest_size=16).digest() for k in range(500)]
    plan = linededup.layout(0)
    assert plan == linededup.Layout(linededup.MIN_FILTER_BITS) and plan.positions(digests).max() < plan.bits
    huge = linededup.layout(10**12)
    assert (huge.bits, huge.ranges, huge.hashes) == (linededup.MAX_FILTER_BITS, linededup.MAX_RANGES, 1)
    marks, seen = linededup._Marks(1 << 12), []
    for k in range(6):  # sparse first, then bit sets
        marks.add(np.array([k, k + 1, 100 + k, 100 + k, *range(200, 200 + 20 * k)], dtype=np.uint64))
        seen.append(marks.dense)
    once, twice = (np.unpackbits(np.concatenate([marks.segment(k)[j] if marks.segment(k) else np.zeros((1 << 12) // 8 // linededup.SEGMENTS, np.uint8) for k in range(linededup.SEGMENTS)])) for j in (0, 1))
    assert seen[0] is False and seen[-1] is True and set(np.flatnonzero(once)) == {*range(7), *range(100, 106), *range(200, 300)}
    assert set(np.flatnonzero(twice)) == {*range(1, 6), *range(100, 106), *range(200, 280)}


def test_line_filters_in_ranges_give_the_same(spark):
    rows = [(k, f"line number {k % 17} of all\nthe line of {k} alone\nline number {k % 5} again") for k in range(50)]
    keyed = docs(spark, rows).select("doc_id", "text")
    plans = [linededup.layout(150), linededup.Layout(1 << 12, 4, 2), linededup.Layout(1 << 10, 2, 1)]
    found = []
    for plan in plans:
        suspects, total = linededup.suspected(keyed, plan)
        assert suspects.count() == total
        found.append({bytes(r.digest) for r in suspects.groupBy("digest").agg(F.countDistinct("doc_id").alias("n")).filter("n > 1").collect()})
    assert len(found[0]) == 22 and found[0] == found[1] == found[2]


def sets(rows):
    out = []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((k, set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    return out


def brute_groups(rows):
    found = [(k, s) for k, s in sets(rows) if k is not None]
    parent = {k: k for k, _ in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(found):
        for b, t in found[i + 1 :]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k, _ in found}


def variants(seed=2, copies=40):
    """A source text, copies with zero to nine words changed, and texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    source, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    rows, k = [(1000, " ".join(source))], 0
    for _ in range(copies):
        text = list(source)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text).upper() if k % 5 == 0 else " \n".join(text)))
        k += 1
    for _ in range(30):
        rows.append((k, " ".join(passage + [word() for _ in range(rng.choice((0, 5, 12, 16, 40, 90)))])))
        k += 1
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = variants() + [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (None, "one two"), (2006, "a a a a a a a a"), (2007, "word " * 30_000)]
    rows += [(2008, "p q r s t u v"), (2009, "p q r s t u v w"), (2010, "p q r s t u"), (3, "one two"), (3, "one two")]
    expect = brute_groups(rows)
    out = ngramjoin.near_duplicates(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == (expect[r.doc_id] if r.doc_id is not None else None), r
    number = lambda k: -1 if k is None else k
    assert sorted((number(r.doc_id), r.n_shingles) for r in out) == sorted((number(k), len(s)) for k, s in sets(rows))
    assert ngramjoin.near_duplicates(docs(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize(("seed", "block"), [(11, 1000), (12, 4)])
def test_near_duplicates_without_a_source(spark, seed, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)  # 4: columns and centres in salted blocks
    rows = [r for r in variants(seed, 60) if r[0] != 1000]
    got = {r.doc_id: r.component_id for r in ngramjoin.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_prefix_and_bounds():
    for n in range(1, 200):
        assert ngramjoin.prefix_length(n) == n - -(-3 * n // 4) + 1
    assert len(ngramjoin.shingles("a b c d e f")) == 2 and len(ngramjoin.shingles("a b")) == 1 and not len(ngramjoin.shingles(None))
    assert (ngramjoin.shingles("A b\tc") == ngramjoin.shingles("a  B c")).all()
    assert not np.intersect1d(ngramjoin.shingles("a b c d"), ngramjoin.shingles("a b c d e")).size


def test_bitmaps_never_bound_below_the_overlap(spark):
    rng, rows = np.random.default_rng(3), []
    for n in (1, 2, 31, 32, 33, 63, 64, 65, 500, 3000):
        for m in {n, -(-3 * n // 4), 4 * n // 3}:
            pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            for shared in {0, min(n, m) // 2, min(n, m)}:
                x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
                rows.append((len(x), len(y), len(np.intersect1d(x, y)), ngramjoin.bitmap(x).tolist(), ngramjoin.bitmap(y).tolist()))
    df = spark.createDataFrame(rows, "n int, m int, overlap int, x array<long>, y array<long>").withColumn("size", F.least(F.size("x"), F.size("y")))
    df = df.withColumn("p", ngramjoin._fold(F.col("x"), F.col("size"))).withColumn("q", ngramjoin._fold(F.col("y"), F.col("size")))
    bound = F.least(F.col("n") - ngramjoin._only(F.col("p"), F.col("q")), F.col("m") - ngramjoin._only(F.col("q"), F.col("p")))
    got = df.select("n", "m", "overlap", bound.alias("bound")).collect()
    assert all(r.overlap <= r.bound for r in got)
    assert all(r.bound < 0.75 * r.n for r in got if not r.overlap and min(r.n, r.m) >= 500)


def test_mixing_reaches_targets(spark):
    rng = random.Random(3)
    rows = [(k, "the word " * rng.randint(20, 60), rng.choice(["en", "de", None]), rng.choice(["hot"] * 6 + ["a", "b"]), 0, "x") for k in range(3000)] + [(None, None, None, None, 0, "x"), (9999, "", "en", "a", 0, "x")]
    given = spark.createDataFrame(rows, SCHEMA).withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "t1").otherwise("t2"))
    share = lambda d, x: spark.createDataFrame(list(x.items()), f"{d} string, target double")
    targets = {"source": share("source", {"hot": 0.4, "a": 0.3, "b": 0.3}), "lang": share("lang", {"en": 0.5, "de": 0.4, "(none)": 0.1}), "topic": share("topic", {"t1": 0.6, "t2": 0.4})}
    out = mixing.mix(given, targets, budget=0.3).cache()
    assert out.count() == len(rows) and out.filter("tokens = 0").filter("sampled OR probability != 0").count() == 0
    total = out.agg(F.sum("tokens")).first()[0]
    assert abs(out.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] / total - 0.3) < 1e-9
    weighted = {(d, r[0]): r[1] for d in ("source", "lang", "topic") for r in out.groupBy(F.coalesce(d, F.lit("(none)"))).agg(F.sum(F.col("tokens") * F.col("weight")) / total).collect()}
    for d, want in (("source", {"hot": 0.4, "a": 0.3, "b": 0.3}), ("lang", {"en": 0.5, "de": 0.4, "(none)": 0.1}), ("topic", {"t1": 0.6, "t2": 0.4})):
        for name, x in want.items():
            assert abs(weighted[(d, name)] - x) < 1e-3
    got = out.filter("sampled").agg(F.sum("tokens")).first()[0] / total
    assert abs(got - 0.3) < 0.05
    again = mixing.mix(given.repartition(7), targets, budget=0.3)
    assert {r.doc_id for r in again.filter("sampled").collect()} == {r.doc_id for r in out.filter("sampled").collect()}


def test_mixing_refuses_targets_that_do_not_fit(spark):
    given = docs(spark, [(k, "some words here") for k in range(6)])
    share = lambda d, x: spark.createDataFrame(list(x.items()), f"{d} string, target double")
    with pytest.raises(ValueError, match="has no target"):
        mixing.mix(given, {"source": share("source", {"src0": 0.5, "src1": 0.5})})
    with pytest.raises(ValueError, match="no tokens"):
        mixing.mix(given, {"lang": share("lang", {"en": 0.5, "xx": 0.5})})
    cells = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")
    _, off = mixing.rake(cells, {"source": share("source", {"a": 0.5, "b": 0.5}), "lang": share("lang", {"x": 0.9, "y": 0.1})})
    assert off > 0.1  # no weights meet both; the error is told


def test_mixing_fits_topics_and_takes_odd_rows(spark):
    rows = [(k, "the of and " + " ".join([["wind", "rain"][k % 2]] * (1 + k % 3)) + (" wind rain" if k % 5 == 0 else "") + (" rare" if k < 3 else ""), "en", "s", 0, "x") for k in range(40)]
    rows += [(100 + k, "la mer", "fr", None, 0, "x") for k in range(400)] + [(7, rows[7][1], "en", "s", 0, "x"), (None, "", None, "s", 0, "x"), (999, "wind " * 40_000, "en", "s", 0, "x")]
    given = spark.createDataFrame(rows, SCHEMA).withColumn("weight", F.lit("clash")).withColumn("sampled", F.lit("clash")).withColumn("tokens", F.lit("clash"))
    anchors = {r.lang: r.anchors for r in mixing.fit_anchors(given.filter("doc_id < 40 OR lang = 'fr'")).collect()}
    assert anchors == {"en": ["rare"]}  # every other word is in over a tenth of its language's texts
    out = mixing.mix(given.withColumn("lang", F.lit("en"))).collect()
    assert len(out) == len(rows) and {r.topic for r in out if r.doc_id and 100 <= r.doc_id < 500} == {"(other)"}
    seven = [r for r in out if r.doc_id == 7]
    assert len(seven) == 2 and seven[0] == seven[1] and [r.tokens for r in out if r.doc_id == 999] == [40_000]
    df = Counter(w for r in rows for w in set((r[1] or "").split()))
    best = sorted((w for w in df if df[w] * 10 <= len(rows)), key=lambda w: (-df[w], w))[:4]
    for r, (k, text, *_) in zip(sorted(out, key=lambda r: (str(r.doc_id), r.tokens)), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").split()))), strict=True):
        n = Counter((text or "").split())
        top = max((n[w], -j) for j, w in enumerate(best))
        assert (r.doc_id, r.topic) == (k, f"topic{top[1] - 1}" if top[0] else "(other)")


def test_mixing_empty_table(spark):
    assert mixing.mix(docs(spark, [(1, "a")]).filter("false")).count() == 0


def test_rollup_commits_once(spark):
    store = rollup.TokenRollup(spark, fresh_dir(spark, "t-rollup"))
    assert store.totals().count() == 0
    schema = "op string, source string, lang string, version string, old_tokens long, new_tokens long, extra int"
    first = spark.createDataFrame([("insert", "s", "en", "v1", None, 10, 1), ("insert", "s", "en", "v1", None, 5, 1), ("insert", None, "en", "v2", None, None, 1)], schema)
    second = spark.createDataFrame([("delete", "s", "en", "v1", 5, None, 1), ("revise", "s", "en", "v1", 10, 12, 1)], schema)
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert store.commit("b2", second) and not store.commit("b2", second)
    assert sorted(map(tuple, store.totals().collect()), key=str) == sorted([("s", "en", "v1", 1, 12), (None, "en", "v2", 1, 0)], key=str)
    # an attempt without its marker doesn't count
    rollup.signed_deltas(first).write.parquet(f"{store.path}/deltas/lost")
    assert store.totals().filter("source = 's'").first().tokens == 12
    with pytest.raises(Exception, match="unknown operation"):
        store.commit("b3", spark.createDataFrame([("upsert", "s", "en", "v1", 1, 1, 1)], schema))
    assert store.commit("b3", first.filter("false")) and store.totals().count() == 2
    with pytest.raises(ValueError):
        store.commit("a/b", first)


def test_rollup_compaction_keeps_totals_and_refuses_old_batches(spark):
    store = rollup.TokenRollup(spark, fresh_dir(spark, "t-rollup"))
    change = lambda n: spark.createDataFrame([("insert", "s", "en", "v", None, n)], "op string, source string, lang string, version string, old_tokens long, new_tokens long")
    assert not store.compact() and store.commit("a", change(1)) and store.commit("b", change(2))
    assert store.compact() and not store.committed() and not store.compact()
    assert not store.commit("a", change(1)) and store.commit("c", change(4)) and store.has("b")
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 3, 7)]
    # a late writer of a folded batch leaves a marker that doesn't count
    rollup.signed_deltas(change(100)).write.parquet(f"{store.path}/deltas/late")
    store._mark("commits", "a@late")
    assert store.compact() and [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 3, 7)]
    # a snapshot without its marker doesn't count either
    change(9).write.parquet(f"{store.path}/totals/lost")
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 3, 7)]


def test_rollup_counts_are_those_of_the_encoder(spark):
    rows = [(1, "the same line\nother words\nthe same line"), (2, None), (3, ""), (4, "naïve 日本語 " * 50), (4, "naïve 日本語 " * 50), (None, "x" * 30_000), (5, "a\r\n\r\n b")]
    got = rollup.counted(docs(spark, rows)).collect()
    for version, (path, pattern) in rollup.default_tokenizers().items():
        coder = bpe.Codec(bpe.read_vocabulary(path), pattern)
        n = lambda t: len(coder.encode([t])[0]) // 4
        expect = sorted(((k, n(t or ""), n("\n".join(dict.fromkeys((t or "").split("\n"))))) for k, t in rows), key=str)
        assert sorted(((r.doc_id, r.tokens, r.trimmed) for r in got if r.version == version), key=str) == expect
    assert rollup.counted(docs(spark, rows).filter("false")).count() == 0


def test_pipeline_matches_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import tiktoken

    from tracefold.llm import bpe, quality

    rows = [(k, t) for k, t in variants(5)] + [(3000, "too short"), (3001, None), (3002, "### " * 50)]
    # stop words make clean texts clean
    rows = [(k, t if t is None or k >= 2000 else "the of and to " + t.replace(" ", " the ", 8) + "\nthe shared licence line of all of them") for k, t in rows]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    kept = {r.doc_id for r in quality.quality_rules(docs(spark, rows)).filter("kept").collect()}
    now = [(k, t) for k, t in rows if k in kept]
    assert not {3000, 3001, 3002} & kept and len(kept) > 40
    cut = [(k, t) for k, _, dropped, t in brute_lines(now) if not dropped or re.search(r"[^\x20\x09-\x0D]", t)]
    groups = brute_groups(cut)
    single = [(k, t) for k, t in cut if groups[k] == k]
    sampled = {r.doc_id for r in mixing.mix(docs(spark, single)).filter("sampled").collect()}
    assert set(got) == sampled and sampled
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Codec(bpe.read_vocabulary(path), pattern).ranks, special_tokens={})
    for k, t in single:
        if k in got:
            assert got[k].ids == own.encode_ordinary(t) and got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(pipeline.STAGES) == 5


def test_a_worker_frees_its_codec_for_another_operator():
    import pyarrow as pa

    from tracefold.llm import bpe, common

    path, pattern = bpe.default_vocabulary()
    batch = pa.RecordBatch.from_pydict({"text": ["a line"]})
    own = bpe.codec(bpe.read_vocabulary(path), pattern)
    list(common.pieces(iter([batch]), operator="bpe"))
    assert list(bpe._CODECS.values()) == [own]  # kept between tasks
    list(common.pieces(iter([batch])))
    assert not bpe._CODECS
    again = bpe.codec(bpe.read_vocabulary(path), pattern)
    assert again.decode(again.encode(["a line"])) == [b"a line"]
