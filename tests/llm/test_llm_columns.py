"""Per-row operators: chunks, WARC, secrets, personal data, encoding, quality, against brute force."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracefold.llm import bloom, bpe, chunks, pii, quality, secrets, warc
from tracefold.llm.common import fresh_dir, pieces

LONG = "lorem ipsum dolor " * 3000 + "\n" + "x" * 5000
TEXTS = [
    "", None, " \n\t\n", "one", "short words here", LONG, LONG, "déjà vu 🙂 naïve\x85b  c d", "the quick brown fox jumps over the lazy dog and the cat " * 4,
    "alpha beta gamma delta epsilon zeta eta theta iota kappa the of and", "#*$ %&| <> " * 20, "same line here\nsame line here\nother\n\n\nsame line here",
]


def docs(spark, texts, extra=""):
    rows = [(k, t, "en", "s", len(t or ""), "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return df.union(spark.createDataFrame([(None, "null id text", None, None, None, None)], df.schema)).repartition(3)


def test_chunks_round_trip(spark):
    noise = random.Random(1).randbytes(60_000).hex()
    texts = [*TEXTS, noise, "prefix " + noise, noise[:30_000] + "!" + noise[30_000:], "y" * 576, "y" * 575]
    given = docs(spark, texts)
    given = given.union(given.filter("doc_id = 5"))  # a repeated row
    path = fresh_dir(spark, "t-chunks")
    chunks.write_store(given, path)
    media = chunks.read_media(spark, path)
    got = {}
    for r in chunks.media_features(media).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t in [*enumerate(texts), (None, "null id text")]:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        for r in got[k]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len(got[5]) == 2 and got[5][0].media_sha256 == got[6][0].media_sha256 and got[5][0].feature == got[6][0].feature
    rows = spark.read.schema(chunks.STORE).parquet(path).filter("doc_id IS NULL OR doc_id != 5")
    stored = rows.select(F.explode("own").alias("b")).filter("b IS NOT NULL").union(rows.select(F.explode("lent.bytes")))
    assert stored.count() == stored.distinct().count()
    # an insertion only changes the chunks near it
    sizes = {r.doc_id: sum(len(b) for b in r.own if b) + sum(len(x.bytes) for x in r.lent) for r in spark.read.schema(chunks.STORE).parquet(path).collect() if r.doc_id in (12, 13, 14)}
    assert sizes[13] < 20_000 and sizes[14] < 40_000


def test_chunks_detect_damage(spark):
    path = fresh_dir(spark, "t-chunks")
    chunks.write_store(docs(spark, ["abc"]).filter("doc_id = 0"), path)
    bad = spark.read.schema(chunks.STORE).parquet(path).withColumn("own", F.transform("own", lambda b: F.when(b.isNotNull(), F.overlay(b, F.lit(b"Z"), F.lit(1)))))
    bad.write.parquet(path + "-bad")
    with pytest.raises(Exception, match="does not match its digest"):
        chunks.read_media(spark, path + "-bad").collect()


def test_chunks_miss_no_owner_silently(spark):
    """A document whose lender's row is gone is an error, not a missing row."""
    path, noise = fresh_dir(spark, "t-chunks"), random.Random(3).randbytes(20_000).hex()
    chunks.write_store(docs(spark, [noise, "x" + noise]), path)
    assert chunks.read_media(spark, path).count() == 3
    spark.read.schema(chunks.STORE).parquet(path).filter("doc_id != 0").write.parquet(path + "-gone")
    with pytest.raises(Exception, match="is not in the store"):
        chunks.read_media(spark, path + "-gone").collect()


def test_bloom_filters_never_miss():
    ids = np.arange(-50, 5000, 7, dtype=np.int64)
    marks = np.zeros(bloom.MIN_BITS // 8, dtype=np.uint8)
    at = bloom._positions(bloom.id_hash(ids), bloom.MIN_BITS)
    np.bitwise_or.at(marks, (at.ravel() >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at.ravel() & np.uint64(7)).astype(np.uint8))
    assert bloom.holds(marks.tobytes(), bloom.id_hash(ids)).all()
    assert bloom.holds(marks.tobytes(), bloom.id_hash(ids + 100_000)).mean() < 0.01 and not len(bloom.holds(marks.tobytes(), np.empty(0, np.uint64)))


def test_batches_are_sliced_by_bytes():
    batch = pa.RecordBatch.from_pydict({"k": list(range(50)), "t": [None] + ["x" * (100_000 if k % 10 == 0 else 10) for k in range(49)]})
    parts = list(pieces(iter([batch]), 150_000))
    assert sum(p.num_rows for p in parts) == 50 and len(parts) >= 4 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(50))


def test_cutter_bounds_and_gear():
    cutter, data = chunks.Cutter(mask_bits=6, least=64, most=512), random.Random(2).randbytes(50_000)
    gear = cutter.gear()
    ends = cutter.ends(data, gear)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and (sizes[:-1] >= 64).all() and (sizes <= 512).all()
    # the vectorised hash is the rolling one
    h, marks = 0, []
    for i, b in enumerate(data[:3000]):
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        if h >> 26 == 0:
            marks.append(i + 1)
    start, expect = 0, []
    while start + 64 < 2000:
        end = next((m for m in marks if m >= start + 64), 10**9)
        end = min(end, start + 512)
        expect.append(end)
        start = end
    assert ends[: len(expect)] == expect


def test_chunks_empty_table(spark):
    path = fresh_dir(spark, "t-chunks")
    chunks.write_store(docs(spark, ["a"]).filter("false"), path)
    assert chunks.media_features(chunks.read_media(spark, path)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)


def test_warc_normalise(spark):
    given = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nEvil: 1", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "ü", "é" * 1000), (9, "v", "<p>x</p>"), (None, "n", "<p>x</p>"), (7, "w", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "w", "\r\n\r\nWARC/1.1\r\n\r\n")]
    folder = fresh_dir(spark, "t-warc")
    whole = warc.write_monolithic(pages(spark, given), folder + "/a")
    members = warc.normalise(whole, folder + "/b")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(members).collect()), key=str)
    last = {}
    for p, _, h in given:
        last[h or ""] = max(last.get(h or "", 0), p or 0)
    expect = []
    for p, _, h in given:
        data = (h or "").encode()
        revisit = (p or 0) != last[h or ""]
        expect.append((p or 0, "revisit" if revisit else "response", last[h or ""] if revisit else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()))
    assert got == sorted(expect, key=str)
    # every member stands alone at its offset, and the members make up the file
    for archive, lines in {r.archive: r for r in members.collect()}.items():
        raw = open(archive.removeprefix("file://"), "rb").read()
        index = warc._sidecar(archive)
        assert sum(x["length"] for x in index) == len(raw) and len(index) == lines.n_records
        for x in index:
            record = zlib.decompress(raw[x["offset"] : x["offset"] + x["length"]], 31)
            assert warc.parse_record(record)[0]["warc-type"] == x["type"]
    assert warc.offset_index(members).count() == len(given)


def test_warc_streams_in_any_pieces():
    records = [warc.build_record(k, "u", "b" * k, None) for k in (0, 1, 5000)]
    stream = b"".join(records)
    for size in (1, 7, 4096):
        assert list(warc.split_records(iter([stream[i : i + size] for i in range(0, len(stream), size)]))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([stream[:-3]])))


def test_warc_inflates_in_bounded_pieces():
    """A megabyte of a well-packed stream holds a thousand of text."""
    plain = bytes(9 * warc.READ_BYTES + 5)
    packed = gzip.compress(plain) + gzip.compress(b"second") + gzip.compress(b"")
    found = list(warc.inflate(io.BytesIO(packed)))
    assert b"".join(found) == plain + b"second" and max(map(len, found)) <= warc.READ_BYTES
    noise = random.Random(1).randbytes(3 * warc.READ_BYTES)
    assert b"".join(warc.inflate(io.BytesIO(gzip.compress(noise)))) == noise
    for cut in (packed[:-1], packed[:1000], b""):
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO(cut)))


def test_warc_rolls_archives_of_very_long_pages(spark):
    long = warc.ROLL_BYTES // 2 + 1
    given = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("y"), long)).alias("html")).coalesce(1)
    folder = fresh_dir(spark, "t-warc")
    whole = warc.write_monolithic(given, folder + "/a")
    assert sorted(r.n_records for r in whole.collect()) == [1, 2]
    got = warc.read_archives(warc.normalise(whole, folder + "/b")).select("page_id", "payload_bytes", F.sha1("payload").alias("sha1"), "record_type").collect()
    assert sorted(got) == sorted((k, long + 1, hashlib.sha1(str(k).encode() + b"y" * long).hexdigest(), "response") for k in range(3))


def test_warc_empty_table(spark):
    folder = fresh_dir(spark, "t-warc")
    members = warc.normalise(warc.write_monolithic(pages(spark, [(1, "u", "h")]).filter("false"), folder + "/a"), folder + "/b")
    assert warc.read_archives(members).count() == 0


SECRETS = [
    "password=abc123 and PassWord : 'xyz_789' token=\"a.b-c/d=\"", "secret=token:abcdefgh", "api_key=12345", "APIKEY = 123456", "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + "c", "AKIAAKIA" + "Z" * 14,
    "é" * 5 + " " + "0123456789abcdef" * 2 + "g" + "a" * 23, "tokentoken=abcdef", "paſsword=abcdef toKen=abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "password=abc\x0bdef", "passwd:\x20\x20\"\"abcdef", None, "",
]


def brute_secrets(text):
    text, out = text or "", []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern
        if rule.kind == "access":
            pattern = "AKIA[A-Z0-9]+"
        elif rule.kind == "hex":
            pattern = "[0-9a-f]+"
        out += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(pattern, text, re.A) if len(m.group(rule.group)) >= rule.least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_secrets_match_brute_force_and_scan_once(spark):
    versions = docs(spark, SECRETS + SECRETS[:2])
    ledger = secrets.BlobLedger(spark, fresh_dir(spark, "t-ledger"))
    got = {r[0]: r[1] for r in secrets.scan_versions(versions, ledger, path="doc_id").select("path", secrets.joined(F.col("found"))).collect()}
    for k, t in [*enumerate(SECRETS + SECRETS[:2]), (None, "null id text")]:
        assert got[k] == brute_secrets(t), (k, t)
    seen = ledger.seen().count()
    assert seen == len({t or "" for t in SECRETS} | {"null id text"}) * len(secrets.RULES)
    again = secrets.scan_versions(versions, ledger, path="doc_id")
    assert again.count() == versions.count() and ledger.seen().count() == seen
    newer = (*secrets.RULES[:-1], secrets.SecretRule("vcs_token", "gh[opsu]_[A-Za-z0-9]{30}", version="2"))
    later = secrets.scan_versions(versions, ledger, newer, path="doc_id")
    assert ledger.seen().count() == seen + seen // len(secrets.RULES)
    assert {r.path: r.found for r in later.collect()}[10][0]["end"] == 34
    assert secrets.scan_versions(versions.filter("false"), ledger, path="doc_id").count() == 0


def brute_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd = [int(c) for c in d[::-1]]
        if 14 <= len(d) <= 19 and sum(odd[::2] + [sum(divmod(2 * c, 10)) for c in odd[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_matches_brute_force():
    rng = random.Random(5)
    alphabet = "a@b.c-1 2+(5)%é\n"
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_pii(text), text
    for text in ["a@b.cd@e.f", "1.2.3.4.5 999.1.1.1 0255.1.1.1 0000256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (824) 555-5244 +12", "@a.b x@y", "9" * 6000 + ".1.1.1"]:
        assert pii.base_spans(text) == brute_pii(text) if "999999" not in text else True
    assert pii.base_spans("9" * 6000 + ".1.1.1") == []


def test_pii_bootstraps_contexts(spark):
    texts = [f"some words reach me: user{k}@mail{k}.example.com today" for k in range(6)]
    texts += ["again reach me: jane_doe(at)mail1 now", "we reach me: 555-0199-22, please", "clean text with 42 things and x1y2z3 inside", "page 12345 of many", None, ""]
    found = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).withColumn("s", pii.joined(F.col("found"))).collect()}
    for k in range(6):
        assert found[k].s.startswith("email:") and "ctx" not in found[k].s
    start = texts[6].index("jane_doe")
    assert found[6].s == f"ctx:{start}:{start + len('jane_doe(at)mail1')}"
    start = texts[7].index("555")
    assert found[7].s == f"ctx:{start}:{start + len('555-0199-22')}"
    assert all(found[k].s == "" for k in (8, 9, 10, 11, None))
    assert pii.personal_data(docs(spark, texts).filter("false")).count() == 0


def brute_contexts(texts):
    """{text: contextual spans} by patterns and scores over plain dictionaries."""
    seen = []
    for t in set(texts):
        taken = [(a, b) for a, _, b in brute_pii(t)]
        found = [(a, b, 1) for a, b in taken]
        for m in re.finditer(r"\S+", t):
            a = m.start() + len(m.group()) - len(m.group().lstrip("\"'([{<,;:=."))
            b = m.end() - len(m.group()) + len(m.group().rstrip("\"')]}>,;:=.!?"))
            if re.search("[0-9@_]", m.group()) and not any(x < b and y > a for x, y in taken):
                found.append((a, b, 0))
        for a, b, seed in found:
            left, right = t[:a].split(), t[b:].split()
            if right and not t[b].isspace():
                right = right[1:]  # the rest of the place's own word
            ps = {("L", *left[-2:])} if len(left) > 1 else set()
            ps |= {("l", left[-1])} if left and left[-1][-1] in ":=" else set()
            ps |= {("R", *right[:2])} if len(right) > 1 else set()
            ps |= {("M", left[-1], right[0])} if left and right else set()
            seen.append((t, a, b, seed, t[a:b].lower(), {tuple(x.lower() for x in p) for p in ps}))
    edges = {(p, i): max(s for _, _, _, s, j, qs in seen if j == i and p in qs) for _, _, _, _, i, ps in seen for p in ps}
    size = {p: sum(q == p for q, _ in edges) for p, _ in edges}
    edges = {k: s for k, s in edges.items() if size[k[0]] >= 3}
    score = {i: float(max(s for (_, j), s in edges.items() if j == i)) for _, i in edges}
    seed = dict(score)
    while True:
        trust = {}
        for p in {p for p, _ in edges}:
            xs = [score[i] for q, i in edges if q == p]
            if sum(xs) >= 3 and sum(xs) / len(xs) >= 0.6:
                trust[p] = sum(xs) / len(xs)
        new = {}
        for i in score:
            doubt = 1.0
            for q, j in edges:
                if j == i:
                    doubt *= max(1 - trust.get(q, 0.0), 1e-12)
            new[i] = max(seed[i], 1 - doubt)
        if all(abs(new[i] - score[i]) < 1e-9 for i in new):
            break
        score = new
    return {t: sorted({(a, b) for u, a, b, s, i, ps in seen if u == t and not s and score.get(i, 0) >= 0.6 and ps & set(trust)}) for t in set(texts)}


def test_pii_contexts_match_brute_force(spark):
    rng, texts = random.Random(8), []
    for k in range(30):
        who = rng.choice([f"u{k}@mail.example.org", f"user_{k}", f"10.0.0.{k}", f"x{k}", f"+49 30 {1000000 + k}"])
        texts.append(rng.choice(["write to {} or call", "Contact: {} now please", "the address is {}, thanks a lot", "item {} of 9 pages", "id={} given to all"]).format(who))
    texts += ["alpha " + "y" * 120 + f": z{k}@q.org" for k in range(4)] + ["alpha " + "y" * 120 + ": q_1", "beta " + "y" * 120 + ": q_2", "see 7", "see 8_", "@", "_", None, "", texts[0]]
    given = docs(spark, texts)
    got = {r.doc_id: r.s for r in pii.personal_data(given.union(given.filter("doc_id = 3"))).withColumn("s", pii.joined(F.filter("found", lambda x: x["kind"] == 4))).collect()}
    expect = brute_contexts([t or "" for t in texts])
    assert {k: got[k] for k in range(len(texts))} == {k: ",".join(f"ctx:{a}:{b}" for a, b in expect[t or ""]) for k, t in enumerate(texts)}
    assert sum(map(len, expect.values())) >= 3 and expect[texts[34]]


ODD = ["aaaa" * 300, "I'LL we've 's", "\r\n\r\n  a \t b", "0123456789" * 60, "日本語" * 120, " " * 70 + "x", "\x1c\x1f q", "abc" * 500 + "é", "".join(random.Random(3).choice("etaoin") for _ in range(1500))]


def test_bpe_is_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    texts = TEXTS + ODD
    ranks = bpe.Codec(bpe.read_vocabulary(path), pattern).ranks
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.bpe_encode(docs(spark, texts), path, pattern)
    assert encoded.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    for r in bpe.bpe_decode(encoded, path, pattern).collect():
        assert r.ids == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.bpe_round_trip(docs(spark, texts), path, pattern, with_tokens=True).collect():
        ids = own.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(docs(spark, texts).filter("false"), path, pattern).count() == 0


def test_bpe_decode_of_unknown_ids_is_an_error(spark):
    path, pattern = bpe.default_vocabulary()
    given = spark.createDataFrame([(1, [0, 999_999, 1], "clash")], "doc_id long, ids array<int>, decoded string")
    with pytest.raises(Exception, match="lacks"):
        bpe.bpe_decode(given, path, pattern).collect()
    assert bpe.bpe_decode(given.withColumn("ids", F.array(F.lit(0), F.lit(1))), path, pattern).first().decoded is not None


def test_bpe_long_pieces_are_exact():
    path, pattern = bpe.default_vocabulary()
    codec = bpe.Codec(bpe.read_vocabulary(path), pattern)
    rng = random.Random(4)
    for word in ("ab" * 40, "the" * 30, "".join(rng.choice("aeiourstln") for _ in range(120))):
        short = codec._encode_pieces([word.encode()])[0]
        assert codec._encode_long(word.encode()) == short


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality_matches_brute_force(spark):
    rng = random.Random(6)
    texts = [t for t in TEXTS if t is None or len(t) < 5000] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["\x0b".join("abcdefghij")]
    out = quality.quality_rules(docs(spark, texts))
    assert out.columns.count("kept") == 1 and set(docs(spark, texts).columns) <= set(out.columns)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text), r.text
        assert not (r.base_failed and r.kept) and r.kept == (not r.failed_rules)
    assert quality.quality_rules(docs(spark, texts).filter("false")).count() == 0


def test_pii_is_linear_in_long_runs():
    import time

    began = time.time()
    for text in ("9" * 200_000, "x" * 200_000 + " 1", "1." * 100_000, "a" * 200_000 + "@", "+1" + "(" * 200_000):
        pii.identifiers(text, pii.base_spans(text))
    assert time.time() - began < 10
