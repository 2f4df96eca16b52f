"""Corpus operators against brute force, on small tables with nulls, ties, repeats, clashing columns and long texts."""

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import dedup, extract, jaccard, langid, lexicon, packing, quality, rans, topk, warc
from runlens.llm.common import scratch_dir
from runlens.llm.tokens import tokenizer_path

LONG = "word list " * 20_000
TEXTS = [None, "", "  ", "a b", "a \t b", "a b", "The cat's, 12 hats!", "é日本 <|endoftext|> x", "x  y\x0bz", LONG, "one two three four five six", "one two three four five six seven"]
SCHEMA = "doc_id long, text string, lang string, source string, h string, kept boolean, row int"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", "h", None, 1) for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hash128", [F.md5, lambda c: F.lit("00" * 16)])
def test_exact_dedup(spark, hash128):
    out = {r.doc_id: r for r in dedup.exact_dedup(docs(spark), hash128=hash128).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    for i, t in enumerate(norm):
        assert (out[i].keep_id, out[i].group_size, out[i].kept) == (norm.index(t), norm.count(t), norm.index(t) == i)
        assert out[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert dedup.exact_dedup(empty(spark)).count() == 0


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_encode_decode(spark):
    lib = library("byte_bpe_50k.json")
    for r in lexicon.encode_decode(docs(spark)).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, lib.decode(ids, skip_special_tokens=False))
    assert lexicon.encode_decode(empty(spark)).count() == 0


def test_automaton_is_minimal_and_exact():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["tops", "tap", "taps", "top", "stop", "stops", "é"])}
    blob = lexicon.compile_words(words)
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(blob)
        f.flush()
        lex = lexicon.Lexicon(f.name)
        places = lex.places([*words, b"ta", b"tapss", b""])
        assert [tuple(np.frombuffer(x, "<u4")) for x in lex.ids_at(places[: len(words)])] == [*words.values()]
        assert places[len(words) :].tolist() == [-1, -1, -1]
        assert len(lex.final) <= 11


def test_id_files(spark):
    path, lib = f"{scratch_dir(spark)}/ids", library("word_bpe_49k.json")
    rans.write_ids(docs(spark), path)
    at = 0
    for r in rans.read_ids(spark, path).orderBy("doc_id").collect():
        ids = [*lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_coder_enters_at_checkpoints():
    ids = np.random.default_rng(1).zipf(1.3, 600_000).clip(0, 5000).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids)))
    words, marks = coder.encode(ids)
    assert (coder.decode(words, marks, len(ids)) == ids).all()
    for a, b in ((0, 5), (rans.CHECK_STEPS * rans.LANES, 600_000), (rans.CHECK_STEPS * rans.LANES + 1, 300_000), (599_999, 600_000), (7, 7)):
        assert (coder.decode(words, marks, len(ids), a, b) == ids[a:b]).all()


def check_bins(rows, size):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= size
    return bins


def test_packing(spark):
    texts, lib = TEXTS * 20, library("word_bpe_49k.json")
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 50 == 3, None).otherwise(F.col("doc_id") % 200))  # null and repeated ids
    rows = packing.best_fit_pack(df, size=64, group=40).collect()
    bins = check_bins(rows, 64)
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 64) + 2
    want = []
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(None if i % 50 == 3 else i % 200, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    assert packing.best_fit_pack(empty(spark)).count() == 0


def test_no_group_of_packing_outgrows_its_size(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(["the"] * int(n)) for n in rng.integers(21, 32, 1500)]  # three never fit, so no partition is certified
    rows = packing.best_fit_pack(docs(spark, texts), size=64, group=100).collect()
    groups = {}
    for r in rows:
        groups[r.sequence_id >> 24] = groups.get(r.sequence_id >> 24, 0) + 1
    assert len(rows) == 1500 and max(groups.values()) <= 150
    assert len(check_bins(rows, 64)) <= packing.lower_bound(np.array([r.length for r in rows]), 64) * 1.1


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = [[float(x) for x in row] for row in rng.normal(size=(150, 8)).round(1)]
    v[3], v[7], v[100] = None, [float("nan")] * 8, v[0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.exact_top_k(rows, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()]
    ints = {i: np.floor(np.array(x, np.float32).astype(float) * 1024).astype(int) for i, x in enumerate(v) if x and np.isfinite(x).all()}
    want = []
    for q in (i for i in ints if i % 10 == 0):
        best = sorted((-int(ints[q] @ c), i) for i, c in ints.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("fewest, most", [(64, 1024), (1, 2)])
def test_jaccard(spark, monkeypatch, fewest, most):
    monkeypatch.setattr(jaccard, "FEWEST", fewest)
    monkeypatch.setattr(jaccard, "MOST", most)
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 400, 60)] for _ in range(12)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for b in base:
        for _ in range(6):
            c = [*b]
            for k in rng.integers(0, 60, rng.integers(0, 4)):
                c[k] = "new" + str(rng.integers(0, 9))
            texts.append(" ".join(c))
    sets = [frozenset() if not (w := (t or "").lower().split()) else frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) for t in texts]
    label = [*range(len(texts))]
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts), width=4, share=(85, 100)).collect()}
    assert out == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_language(spark):
    texts = ["the cat and the hat", "der hund und die katze", None, "12 !!"] * 30
    rows = spark.createDataFrame([(i, t, ["en", "de", "en", None][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.language_ids(rows).collect()}
    assert all(out[i].lang_pred == ["en", "de", "und", "und"][i % 4] and 0 <= out[i].score <= 1 for i in range(len(texts)))
    assert all(r.lang_pred == "und" for r in langid.language_ids(rows.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_salvage():
    records = [warc.member(warc.record(i, "http://x/ y", b"<p>%d</p>" % i, None)) for i in range(4)]
    data = records[0] + b"junk" + records[1][:-9] + records[2] + warc.record(3, None, b"plain", 1)
    found = [(k, h.get("x-page-id")) for k, _, _, h, _ in warc.salvage(data)]
    assert found == [("record", "0"), ("gap", None), ("record", "2"), ("record", "3")]
    assert [*warc.salvage(b"")] == []


def test_salvage_after_damage_at_any_place():
    """Each byte of an archive is changed once: records that it doesn't touch come back, and records and gaps cover the file."""
    records = [(warc.member if i % 2 else bytes)(warc.record(i, "u", b"<p>%d</p>" % i * 5, None)) for i in range(3)]
    whole, starts = b"".join(records), np.cumsum([0, *map(len, records)])
    for at in range(len(whole)):
        data = whole[:at] + bytes([whole[at] ^ 0x15]) + whole[at + 1 :]
        got = [*warc.salvage(data)]
        hit = int(np.searchsorted(starts, at, "right")) - 1
        assert {h.get("x-page-id") for k, _, _, h, _ in got if k == "record"} >= {str(i) for i in range(3) if i != hit}
        ends = [0, *(b for _, _, b, _, _ in got)]
        assert all(a >= e and not data[e:a].strip(b"\r\n") for e, (_, a, _, _, _) in zip(ends, got)) and not data[ends[-1] :].strip(b"\r\n")


PAGES = [(1, "u", "a"), (2, None, "a"), (3, "u", None), (4, "u", ""), (None, "u", "z"), (5, "u", "é" * 9), (6, "u", "é" * 9), (6, "w", "é" * 9), (5, "x", "b"), (7, "u", "word " * 300_000)]


@pytest.mark.parametrize("least", [0, 3])
def test_archives(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    pages = spark.createDataFrame([(*p, 1, "f") for p in PAGES], "page_id long, url string, html string, size int, file string").coalesce(1)
    path = scratch_dir(spark)
    warc.write_archives(pages, f"{path}/a", least=least)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min(j for j, _, h in PAGES if j is not None and (h or "") == (html or "")) if i is not None and len(raw) >= least else i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), digest, "response" if first == i else "revisit", None if first == i else first))
    got = [tuple(r) for r in warc.salvage_archives(spark, f"{path}/a", f"{path}/gaps").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/gaps").count() == 0
    warc.write_archives(pages.limit(0), f"{path}/none")
    assert warc.salvage_archives(spark, f"{path}/none", f"{path}/nogaps").count() == 0


def test_gaps_of_damaged_archives_are_logged(spark):
    path = scratch_dir(spark)
    warc.write_archives(spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string").coalesce(1), f"{path}/a")
    raw = bytearray(spark.read.format("binaryFile").load(f"{path}/a").first().content)
    raw[len(raw) // 2] ^= 0xFF
    os.makedirs(f"{path}/b")
    with open(f"{path}/b/x.warc.gz", "wb") as f:
        f.write(raw)
    got = warc.salvage_archives(spark, f"{path}/b", f"{path}/gaps")
    gaps = spark.read.parquet(f"{path}/gaps").collect()
    assert got.count() == 49 and [g.file for g in gaps] == ["x.warc.gz"]
    assert raw[gaps[0].start : gaps[0].start + 3] == b"\x1f\x8b\x08" and gaps[0].end - gaps[0].start < len(raw) // 20


def test_page_text(spark):
    page = '<html><head><title>no</title></head><body><nav><a href="/">menu menu</a></nav><div class="ad">buy this now</div><article><h1>A &amp; B</h1><p>x  <b>y</b>\n z<p>1 &lt; 2<div class="comments">first!</div></article><footer>f</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "just words here")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract_text(rows).collect()} == {1: "A & B\nx y z\n1 < 2", 2: "", 3: "just words here"}


def quality_rows():
    """Ids, texts and hosts: good and bad texts, sites of very different size and share, null and empty ones, repeated ids."""
    rng = np.random.default_rng(9)
    out = []
    for i in range(240):
        site = [f"big{i % 2}", f"small{i % 37}", None][int(rng.integers(0, 3))]
        good = rng.random() < (0.9 if site == "big0" else 0.4)
        out.append((i, "plain words in a line %d " % i * 5 if good else "A!! B!! C!! ### %d" % i, site, int(good)))
    return [*out, (None, None, "big0", 0), (5, "", None, 0), (5, "plain words in a line", "big1", 1), (9999, "word " * 200_000, "big1", 1)]


def test_quality(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, t, "en", s, 3, 1.0) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, y int, p double")
    known = {i: y for i, _, _, y in rows[:240] if i % 2 == 0}
    labels = spark.createDataFrame([*known.items(), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    right = [r.accepted == bool(y) for r, y in ((r, y) for r in got for i, _, _, y in rows[:240] if i == r.doc_id and i != 5)]
    assert np.mean(right) > 0.97
    # sites by brute force from the documents' own evidence
    p = [(r.host, r.path, known.get(r.doc_id, r.evidence)) for r in got]
    mean = (sum(x for *_, x in p) + 1) / (len(p) + 2)

    def sums(key):
        out = {}
        for r in p:
            s, n = out.get(r[:key], (0.0, 0))
            out[r[:key]] = s + r[2], n + 1
        return out

    def strength(groups, prior):
        q = sum((s / n - prior(k)) ** 2 * n for k, (s, n) in groups.items())
        n = sum(n for _, n in groups.values())
        v = sum(prior(k) * (1 - prior(k)) * m for k, (_, m) in groups.items()) / n
        between = max(0.0, (q - len(groups) * v) / n)
        return min(1e4, max(1.0, v / between - 1 if between > 0 else 1e4))

    hosts, paths = sums(1), sums(2)
    k = strength(hosts, lambda _: mean)
    host = {h: (s + k * mean) / (n + k) for h, (s, n) in hosts.items()}
    k = strength(paths, lambda x: host[x[:1]])
    path = {x: (s + k * host[x[:1]]) / (n + k) for x, (s, n) in paths.items()}
    logit = lambda x: np.log(x / (1 - x))
    for r in got:
        assert r.host_posterior == pytest.approx(host[r.host,]) and r.path_posterior == pytest.approx(path[r.host, r.path])
        z = logit(r.evidence) + logit(path[r.host, r.path]) - logit(mean)
        assert r.quality == pytest.approx(1 / (1 + np.exp(-z))) and r.accepted == (r.quality >= 0.3)


def test_quality_held_out_and_edges(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows[:240]], "doc_id long, quality int")
    right, n = quality.held_out_accuracy(df, labels)
    assert n > 30 and right >= 0.95 * n
    assert quality.classify(df.limit(0), labels).count() == 0
    none = quality.classify(df, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.accepted for r in none)
    one = quality.classify(df, labels.where("quality = 1").unionByName(spark.createDataFrame([(3, None)], labels.schema))).collect()
    assert len(one) == len(rows)


def test_language_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = {k: ["".join(rng.choice([*letters], 5)) for _ in range(40)] for k, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "àéîõübcd"))}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa"), (501, "12 !!", "bb"), (None, rows[0][1], "aa"), (3, rows[3][1], "aa"), (3, rows[4][1], None), (502, (rows[2][1] + " ") * 30_000, None), (503, "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0

    def grams(t):
        s = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower()) + " "
        return [s[i - 1 : i + 2] for i in range(1, len(s) - 1) if s[i] != " "]

    counts = {}
    for i, t, lang in rows:
        if lang and i is not None and not out(i):
            for g in grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = lambda k, g: counts[k].get(g, 0) / total[k]
    floor = {k: 2 * total[k] / max(total.values()) for k in counts}
    kept = {k: {g for g, n in c.items() if n > floor[k]} for k, c in counts.items()}
    has = {k: {g for g in kept[k] if share(k, g) >= langid.SHARE * max(share(j, g) if g in kept[j] else 0 for j in counts)} for k in counts}
    want = []
    for i, t, _ in rows:
        hits = {k: sum(g in has[k] for g in grams(t)) for k in sorted(counts)}
        best = max(hits, key=hits.get)
        want.append((i, out(i), best if grams(t) else "und", hits[best] / sum(hits.values()) if sum(hits.values()) else 0.0))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[3], 2))
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in langid.language_ids(df).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=2e-3)
    assert langid.language_ids(df.limit(0)).count() == 0
    tie = langid.language_ids(spark.createDataFrame([(1, "xyz", "b"), (1, "xyz", "a")] * 30, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in tie.collect()} == {"a"}


def test_encoders_keep_null_and_repeated_ids(spark):
    rows = [(None, "x y"), (3, "same text"), (3, "same text"), (3, "other"), (None, None), (1, "it's <|endoftext|> don't")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, ids string")
    lib, words = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    ids = lambda t: tuple(lib.encode(t or "", add_special_tokens=False).ids)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, tuple(r.ids)) for r in lexicon.encode_decode(df).collect()), key=key) == sorted(((i, ids(t)) for i, t in rows), key=key)
    path = f"{scratch_dir(spark)}/ids"
    rans.write_ids(df, path)
    got = rans.read_ids(spark, path).collect()
    coded = lambda t: (*words.encode(t or "", add_special_tokens=False).ids, 1)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in got), key=key) == sorted(((i, coded(t)) for i, t in rows), key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 3, 3, 3]
    one = rans.read_ids(spark, path, only=spark.createDataFrame([(1,), (7,)], "doc_id long")).collect()
    assert [(r.doc_id, tuple(r.ids)) for r in one] == [(1, coded(rows[5][1]))]
    rans.write_ids(df.limit(0), f"{path}-none")
    assert rans.read_ids(spark, f"{path}-none").count() == 0
    dup = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in dedup.exact_dedup(df).collect())
    assert dup == [(0, 0, 1, True), (0, 0, 1, True), (1, 1, 1, True), (3, 3, 1, True), (3, 3, 2, False), (3, 3, 2, True)]


def test_a_broken_block_is_an_error(spark):
    path = f"{scratch_dir(spark)}/ids"
    rans.write_ids(docs(spark), path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(f"{path}2/blocks")
    for name in ("freq", "files"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{path}2/{name}")
    with pytest.raises(Exception, match="checksum"):
        rans.read_ids(spark, f"{path}2").collect()


def test_jaccard_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, "a set that no other row of the table has"), (5, base), (5, base + " x"), (5, "lone words stand here all alone"), (8, "lone words stand here all alone"), (2, base + " x y"), (9, None), (9, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, col int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(df).collect())
    assert got == [(0, 6, 0), (0, 56, 2), (2, 58, 2), (5, 2, 2), (5, 56, 2), (5, 57, 2), (8, 2, 2), (9, 0, 9), (9, 0, 9)]
