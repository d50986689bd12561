"""Each operator against a brute-force version, with nulls, empty texts, repeated rows and empty tables."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "the of and ther hean ndes tion erly with for whole passage about some thing else entirely".split()


def texts(n=40, seed=1):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) + rng.choice(["", ".", "é", "\n"]) for _ in range(rng.randrange(5, 150))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " more", "", None, "   ", "x", "LONG " * 3000, out[2].upper()]
    return list(enumerate(out))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    from bytesift.llm.components import connected_components

    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    want = components(60, links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for e in links for i in e if e[0] != e[1]} or all(got[i] == want[i] for i in got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_and_simhash(spark, docs_of):
    from bytesift.llm import simhash as s

    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(23)
        b = a
        for i in rng.sample(range(23), rng.randrange(3)):
            b ^= 1 << i
        x, y = s.golay_indices(np.array([a, b]))
        assert set(x.tolist()) & set(y.tolist())
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {f ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for f in base for _ in range(30)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = {(r.a, r.b) for r in s.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == want
    old, s.CROWDED = s.CROWDED, 2
    try:
        assert {(r.a, r.b) for r in s.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()} == want
    finally:
        s.CROWDED = old
    rows = texts()
    got = {r["__id"]: r.component_id for r in s.near_groups(docs_of(rows)).collect()}
    fp = [s.simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    assert got == dict(enumerate(components(len(fp), links)))
    docs = docs_of(rows + [rows[3]])
    kept = s.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert s.drop_near_duplicates(docs_of([])).count() == 0


def test_simhash_null_ids(spark, docs_of):
    from bytesift.llm.simhash import drop_near_duplicates, near_groups

    rows = [(None, "a b c d"), (None, "a b c d"), (5, "q r s t u"), (7, "q r s t u")]
    assert sorted(((r["__id"], r.component_id) for r in near_groups(docs_of(rows)).collect()), key=str) == [(5, 5), (7, 5), (None, None), (None, None)]
    assert sorted((r.doc_id for r in drop_near_duplicates(docs_of(rows)).collect()), key=str) == [5, None]


def test_lines(spark, docs_of):
    from bytesift.llm.lines import SHINGLE, SIMILARITY, drop_near_lines, line_groups

    rng = random.Random(9)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(25)) for _ in range(20)]
    rows = []
    for i in range(30):
        picked = [x if rng.random() < 0.5 else x.replace(x[40:42], "##", 1) for x in rng.sample(base, 3)]
        rows.append((i, "\n".join([*picked, "", "ab"])))
    rows += [(90, None), (91, ""), (92, rows[0][1]), (None, "alone here and nowhere else at all, it is said")]
    seen, sets = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                seen.setdefault(line, []).append((i, n))
    lines = list(seen)
    for line in lines:
        b = line.encode()
        sets.append({b[k : k + SHINGLE] for k in range(max(1, len(b) - SHINGLE + 1))})
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= SIMILARITY * len(sets[i] | sets[j])]
    root = components(len(lines), links)
    first = {}
    for k, line in enumerate(lines):
        first.setdefault(root[k], []).extend(seen[line])
    keep = {min(v, key=lambda p: (p[0] is not None, p[0] or 0, p[1])) for v in first.values()}
    got = line_groups(docs_of(rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got if r.keep} == keep and len(got) == sum(map(len, seen.values()))
    docs = docs_of(rows).withColumn("gone", F.lit(1)).withColumn("__text", F.lit("clash"))
    out = {r.doc_id: r for r in drop_near_lines(docs).collect()}
    assert drop_near_lines(docs).columns == docs.columns
    assert out[90].text is None and out[91].text == "" and 92 not in out and None in out
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)
    assert drop_near_lines(docs_of([])).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_fingerprints(spark, docs_of, bits):
    from bytesift.llm.fingerprints import edit_report, fingerprint, with_next

    def canon(t):
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
        return re.sub(r"\s+", " ", t).strip()

    rows = texts(12) + [(100, "Straße  ﬁn\t"), (101, "STRASSE FIN"), (102, "é"), (103, "é")]
    got = {r.doc_id: r for r in edit_report(docs_of(rows), bits=bits).collect()}
    forms = {}
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for f, x in ((got[i].fingerprint, t), (got[i].edited_fingerprint, e)):
            assert forms.setdefault(canon(x), f) == f
        assert got[i].near_next == float(got[i].fingerprint == got[rows[(k + 1) % len(rows)][0]].fingerprint)
    assert len(set(forms.values())) == len(forms)
    alone = fingerprint(docs_of(rows), bits=bits)
    assert len({canon(t) for _, t in rows}) == alone.select("fingerprint").distinct().count()
    assert edit_report(docs_of([])).count() == 0 and edit_report(docs_of([(1, "ab")])).first().near_next == 1.0
    pairs = with_next(docs_of([(i, str(i)) for i in range(50)]), range_rows=4)
    assert sorted((int(r.text), int(r.ntext)) for r in pairs.collect()) == [(i, (i + 1) % 50) for i in range(50)]


def test_contamination(spark, docs_of):
    from bytesift.llm.decontaminate import contamination, drop_contaminated, words_of

    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([30, 14, 13, 5, 1, 12])] + [(7, None), (8, "..."), (9, "a a a a a a a a a a a a a a a a")]
    rows = [(i, " ".join(rng.choice(["zz1", "yy2", "q"]) for _ in range(rng.randrange(20))) + " " + (rng.choice(items)[1] or "").upper()[: rng.randrange(300)]) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "A, a " * 40), rows[0]]
    want = {}
    for i, t in rows:
        w, hit, who = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    who.add(str(item))
        want[i] = (len(w), len(hit), sorted(who))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 0):
        got = contamination(docs_of(rows), bench, broadcast_bytes=most, out="f").collect()
        assert len(got) == len(rows) and {r.doc_id: (r.f.n_words, r.f.n_hit, r.f["items"]) for r in got} == want
    clean = drop_contaminated(docs_of(rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert contamination(docs_of(rows), bench.limit(0)).where("found.n_hit > 0").count() == 0


def test_encoder_equals_library():
    from bytesift.llm.encode import Encoder, vocabulary

    rows = [t or "" for _, t in texts()] + ["a  b", "a\n\nb", " a", "a ", "x\ty", "I'm 5's\nfoo  ", "é ́a Σς ΑΣ İb", "<|endoftext|> x", "a\0b c", "\x01 z"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(vocabulary(name))
        for t, ids in zip(rows, e.encode(rows)):
            assert e.tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_packing(spark, docs_of):
    from bytesift.llm.encode import encoder, vocabulary
    from bytesift.llm.packing import BestFit, pack_documents

    path = vocabulary("byte_bpe_50k.json")
    rows = texts() + [(3, None)]
    got = pack_documents(docs_of(rows), path).collect()
    ids = {i: [*encoder(path).encode([t])[0].tolist(), 2] for i, t in reversed(rows)}
    assert sum(r.length for r in got) == sum(len(encoder(path).encode([t])[0]) + 1 for _, t in rows)
    for r in got:
        if r.doc_id != 3:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and (r.length == 1024 or r.piece == 0)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in at.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    bins = BestFit(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 3, 4, 5, 5)] == [0, 1, 1, 0, 2, 2]
    assert pack_documents(docs_of([]), path).count() == 0


def test_store_round_trip(spark, docs_of):
    from bytesift.llm.common import scratch_path
    from bytesift.llm.encode import encoder, vocabulary
    from bytesift.llm.store import _read_chunks, read_ids, read_summary, write_store

    path, vocab = scratch_path(spark, "store"), vocabulary("word_bpe_49k.json")
    rows = texts()
    write_store(docs_of(rows), path, vocab, end_id=1)
    back = {r.doc_id: r for r in read_ids(spark, path).collect()}
    summary = {r.doc_id: r for r in read_summary(spark, path).collect()}
    start = 0
    for i, t in rows:
        ids = [*encoder(vocab).encode([t])[0].tolist(), 1]
        assert np.frombuffer(back[i].ids, dtype="<u2").tolist() == ids
        assert (summary[i].start, summary[i].n_tokens, summary[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    stored = _read_chunks(spark, path).where("ids is not null")
    assert stored.count() == stored.select("digest").distinct().count()
    empty = scratch_path(spark, "store")
    write_store(docs_of([]), empty, vocab, end_id=1)
    assert read_summary(spark, empty).count() == 0


def test_suffixes(spark, docs_of):
    from bytesift.llm import suffixes as s

    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (210, 199, 450, 1000)]
    rows = [(i, "".join(rng.choice(shared + ["".join(rng.choice("xyz ") for _ in range(80))]) for _ in range(rng.randrange(5)))) for i in range(25)]
    rows += [(30, None), (31, ""), (32, rows[4][1]), (33, "ab" * 300), (34, "k" * 250), rows[5]]
    count = Counter(t[k : k + 200] for t in [(x or "").encode() for _, x in rows] for k in range(len(t) - 199))
    want = {}
    for i, t in rows:
        t = (t or "").encode()
        kept, spans = s.cut(t, [(k, k + 200) for k in range(len(t) - 199) if count[t[k : k + 200]] > 1])
        want[i] = (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    for crowd in (s.CROWD, 3):
        old, s.CROWD = s.CROWD, crowd
        try:
            got = s.remove_repeats(docs_of(rows)).collect()
        finally:
            s.CROWD = old
        assert len(got) == len(rows) and {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert s.remove_repeats(docs_of([])).count() == 0


def test_urls(spark):
    from bytesift.llm.urls import Words, judge

    rows = [(1, "http://A.org/x"), (2, "https://www.example.org/es/1"), (3, "https://example.org/en/15?q"), (4, "http://m.b.com/fr/a#b"), (5, "http://b.com/de/"), (6, "http://big-casino.net/en/1"), (7, "http://casinowin.net"), (8, None), (9, "no scheme"), (10, "http://plain.net/a/b"), (11, "http://org"), (1, "http://A.org/x")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(1, 12)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == ["allow", "block", "block", "allow", "block", "block", "block", "allow", "allow", "allow"]
    assert (got[1].host, got[3].path, got[8].host, got[11].path) == ("a.org", "/en/15", "", "")
    assert Words({"cheap": 5, "pills": 5, "che": 1})._split("cheappills") == ("cheap", "pills")
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_warc(spark):
    from bytesift.llm.common import scratch_path
    from bytesift.llm.warc import chunked, dechunked, page_of, parse, read_warc, reassemble, write_warc

    assert dechunked(chunked(b"x" * 7001)) == b"x" * 7001 and dechunked(b"0\r\n\r\n") == b""
    rows = [(1, "http://a", "é" * 9000), (2, None, "é" * 9000), (3, "u\r\nv", None), (4, "http://b", "short"), (5, "http://c", "short"), (None, "http://d", "z" * 200), (6, "http://e", "WARC/1.1\r\n\r\n\r\nq" * 900), (6, "http://e", "WARC/1.1\r\n\r\n\r\nq" * 900)]
    path = scratch_path(spark, "warc")
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = read_warc(spark, path).withColumn("id", page_of("name")).collect()
    assert sorted((str(r.id), r.record_type) for r in got) == sorted((str(i), "revisit" if i == 2 else "response") for i, _, _ in rows)
    assert {(r.id, r.payload) for r in got if r.record_type == "response"} == {(i, (t or "").encode()) for i, _, t in rows if i != 2}
    with pytest.raises(ValueError):
        reassemble([{"number": 1, "total": None, "block": b"a"}, {"number": 3, "total": 2, "block": b"b"}])
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"))


def test_toxicity(spark, docs_of):
    from bytesift.llm.toxicity import Lexicon, drop_toxic, fit, fold, score_column

    assert fold("Y0u 1D10T, cлown​!") == fold("you idiot, cлown")
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        words = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(40)]
        if toxic:
            words.insert(5, "grobble" + rng.choice("abcdef"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = docs_of(rows)
    lexicon = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.s for r in docs.select("doc_id", score_column(docs, lexicon).alias("s")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(labels[i][1]) for i in held) >= 0.95 * len(held)
    plain = Lexicon({fold("trash"): 1.0}, [fold("trash can")])
    assert plain.hits(fold("a trash can")) == [] and len(plain.hits(fold("such trash here"))) == 1
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    odd = docs_of([(1, None), (2, ""), (3, "you idiot moron scum")])
    assert sorted(r.doc_id for r in drop_toxic(odd, none).collect()) == [1, 2]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(12)
    passage = " ".join(rng.choice(WORDS) + str(k) for k in range(30))
    rows = [(i, "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(20)) for _ in range(4))) for i in range(12)]
    rows += [(20, rows[0][1]), (21, rows[1][1].replace("\n", " ")), (22, passage), (23, "idiot moron scum " * 20), (24, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    left = []
    for name, stage in c.STAGES[:-1]:
        kept = c.materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        left.append({r.doc_id for r in kept.collect()})
    everything = {i for i, _ in rows}
    assert [everything - left[0], left[0] - left[1], left[1] - left[2], left[2] - left[3]] == [{23}, {20}, {21}, {22}]
    packed = c.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[3]
