"""Names that clash, ids of other types, ties, long texts and repeated rows: what each operator's docstring promises."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

CLASHES = ["__t1", "__t2", "__id", "__n", "__h1", "__h2", "row", "found", "gone", "__found", "pos"]


def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def unharmed(out, docs):
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in CLASHES)


TEXTS = [(1, "alpha beta gamma delta"), (1, "other words of one id"), (2, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (None, "no id here at all"), (None, None), (3, "")]


def test_clashing_names(spark, docs_of):
    from bytesift.llm.decontaminate import contamination, drop_contaminated
    from bytesift.llm.fingerprints import fingerprint
    from bytesift.llm.lines import drop_near_lines
    from bytesift.llm.simhash import drop_near_duplicates

    docs = clashing(docs_of(TEXTS))
    unharmed(drop_near_lines(docs), docs)
    unharmed(drop_near_duplicates(docs), docs)
    for bits in (64, 2):
        unharmed(fingerprint(docs, bits=bits, out="print"), docs)
    items = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    for limit in (1 << 20, 0):
        got = contamination(docs, items, broadcast_bytes=limit, out="hits")
        unharmed(got, docs)
        assert sorted(r.hits.n_hit for r in got.collect()) == [0, 0, 0, 0, 2, 2, 2]
        assert sorted(r.hits.full for r in got.collect()) == [False] * 7
        unharmed(drop_contaminated(docs, items, broadcast_bytes=limit), docs)


def test_lines_of_one_id_keep_their_own_text(docs_of):
    from bytesift.llm.lines import drop_near_lines

    x, u = "the first line that stands in several rows of the table", "a unique line that no other row of this table has at all"
    assert sorted((r.doc_id, r.text) for r in drop_near_lines(docs_of([(1, x), (7, x), (7, u)])).collect()) == [(1, x), (7, u)]
    rows = [(None, f"{u} one\n{x}"), (None, f"{x[::-1]}\n{x}"), (None, f"{u[::-1]}\nsomething else that is said in this place only")]
    got = {r.text for r in drop_near_lines(docs_of(rows)).collect()}
    assert rows[2][1] in got and sum(t.count(x) for t in got) == 1 and len(got) == 3


def test_packing_bounds(docs_of, spark):
    from bytesift.llm.packing import BestFit, pack

    rng = random.Random(2)
    sizes = [rng.choice([1024, rng.randrange(1, 1024), rng.randrange(1, 200)]) for _ in range(6000)]
    cut = spark.createDataFrame([(f"d{i}", 0, 0, n, i, "own") for i, n in enumerate(sizes)], "doc_id string, piece int, start long, length long, ids_crc32 long, offset string")
    used, opened = {}, {}
    for open_bins in (16, 1024):
        got = pack(cut, open_bins=open_bins, group_pieces=100_000).collect()
        assert sorted((r.doc_id, r.length) for r in got) == sorted((f"d{i}", n) for i, n in enumerate(sizes))
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 1024
        used[open_bins] = len(by)
    least = -(-sum(sizes) // 1024)
    assert least <= used[1024] <= 1.02 * least and used[1024] <= used[16]  # the bound acts

    bins, naive = BestFit(100, 5), []  # against best fit by trying every open sequence
    for n in [rng.randrange(1, 100) for _ in range(3000)]:
        room = [(100 - sum(b[1]), -i) for i, b in enumerate(naive) if b[0] and 100 - sum(b[1]) >= n]
        number, offset = bins.place(n)
        if room:
            assert 100 - offset == min(room)[0]
        else:
            assert offset == 0 and number == len(naive)
            naive.append([True, []])
        assert naive[number][0] and sum(naive[number][1]) == offset
        naive[number][1].append(n)
        if sum(naive[number][1]) == 100:
            naive[number][0] = False
        live = [i for i, b in enumerate(naive) if b[0]]
        if len(live) > 5:
            fullest = min(100 - sum(naive[i][1]) for i in live)
            shut = [i for i in live if 100 - sum(naive[i][1]) == fullest and (i == number or not any(i in b for b in bins.free))]
            naive[shut[0]][0] = False


def test_exceptions_against_brute_force():
    from bytesift.llm.toxicity import Lexicon, fold

    rng = random.Random(6)
    terms = {f" {t} ": w for t, w in (("bad", 1.0), ("worse", 2.0), ("can", 0.5))} | {" wor": 0.7}
    phrases = [fold("bad can"), fold("worse off can"), fold("not worse")]
    lexicon = Lexicon(terms, phrases)
    for _ in range(400):
        text = fold(" ".join(rng.choice(["bad", "worse", "can", "off", "not", "word"]) for _ in range(rng.randrange(12))))
        spared = [(i, i + len(p)) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
        best = {}
        for t, w in terms.items():
            for i in range(len(text)):
                if text.startswith(t, i) and (i not in best or w > best[i][2]):
                    best[i] = (i, i + len(t), w)
        want = [h for h in best.values() if not any(s <= h[0] and h[1] <= e for s, e in spared)]
        assert sorted(lexicon.hits(text)) == sorted(want)
    many = fold("worse off can " * 20_000)
    assert len(lexicon.hits(many)) == 0
    assert fold("cost $5 @ home") == " cost s home " and fold("b@d") == " bad "


def test_simhash_bits_by_counting():
    """Bit by bit, with a hash of a shingle at a time."""
    import xxhash

    from bytesift.llm.simhash import simhash

    for text in ("A b c d e", "a b", "", "x y z x y z x y z", "ÄB c d\te\x0bf"):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        assert simhash(text) == want


def test_suffixes_with_colliding_hashes(monkeypatch):
    import numpy as np

    from bytesift.llm import suffixes as s

    rng = random.Random(3)
    spans = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 20))) for _ in range(40)]
    offsets, classes, times = np.zeros(40, dtype=np.int64), np.zeros(40, dtype=np.int64), np.ones(40, dtype=np.int64)
    want = s.covered(spans, offsets + 6, classes, times, length=8).tolist()
    monkeypatch.setattr(s.Hashes, "of", lambda self, starts, sizes: (np.asarray(starts) * 0).astype(np.uint64))  # every hash agrees
    assert s.covered(spans, offsets + 6, classes, times, length=8).tolist() == want


def test_crowded_anchor_is_split(docs_of):
    """More spans around one passage than a group may hold: split, sorted, and the same result."""
    from bytesift.llm.suffixes import remove_repeats

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, tails = word(120), [word(90) for _ in range(4)]
    rows = [(i, word(150) + passage + rng.choice(tails) + word(150)) for i in range(40)]
    got = {c: sorted((r.id, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs_of(rows), crowd=c).collect()) for c in (5, 1000)}
    assert got[5] == got[1000] and sum(r[1] for r in got[5]) > 40 * 200


def test_store_tells_what_is_wrong(spark, docs_of, tmp_path):
    from bytesift.llm.encode import vocabulary
    from bytesift.llm.store import read_summary, write_store

    rows = [(i, f"some words of document {i} " * 40) for i in range(6)] + [(None, "null id"), (2, "repeated id"), (2, "repeated id")]
    vocab = vocabulary("word_bpe_49k.json")

    def store(name):
        write_store(docs_of(rows), f"{tmp_path}/{name}", vocab, end_id=1)
        return f"{tmp_path}/{name}"

    whole = store("whole")
    assert read_summary(spark, whole).count() == len(rows)

    def changed(name, part, change):
        path = store(name)
        table = spark.read.parquet(f"{path}/{part}")
        spark.createDataFrame(change(table).collect(), table.schema).write.parquet(f"{path}/{part}-new")
        import shutil

        shutil.rmtree(f"{path}/{part}")
        shutil.move(f"{path}/{part}-new", f"{path}/{part}")
        return path

    for name, part, change in (
        ("digest", "chunks", lambda t: t.withColumn("ids", F.when(F.col("seq") == 0, F.reverse(F.hex("ids")).cast("binary")).otherwise(F.col("ids")))),
        ("gone", "chunks", lambda t: t.withColumn("ids", F.lit(None).cast("binary"))),
        ("root", "manifest", lambda t: t.withColumn("root", F.lit("no root").cast("binary"))),
        ("length", "recipes", lambda t: t.withColumn("n_tokens", F.col("n_tokens") + 1)),
    ):
        with pytest.raises(Exception):
            read_summary(spark, changed(name, part, change)).collect()
    assert zlib.crc32(b"") == 0


def test_pipeline_odd_rows(spark, docs_of, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(14))
    passage = line()
    rows = [(i, "\n".join(line() for _ in range(3))) for i in range(6)]
    long = "\n".join(line() for _ in range(150)) + "\n" + passage  # less than a twentieth of it
    rows += [(None, line()), (None, line()), (None, None), (7, None), (7, ""), (2, "another text of the same id, " + line()), rows[3], rows[3], (8, long)]
    docs = clashing(docs_of(rows))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, left = docs, []
    for name, stage in c.STAGES[:-1]:
        kept = c.materialize(stage(spark, kept, str(tmp_path)), name)
        unharmed(kept, docs)
        left.append(sorted(((r.doc_id, r.text) for r in kept.collect()), key=str))
    want = sorted(((i, t) for i, t in rows), key=str)
    assert left[0] == left[1] == want
    blank = [r for r in left[2] if not (r[1] or "").strip()]
    assert len(blank) == 1 and sorted({r for r in want if r[1]}, key=str) == sorted((r for r in left[2] if r[1]), key=str)
    assert left[3] == [r for r in left[2] if r[0] != 8]
    packed = c.packing(spark, kept, str(tmp_path))
    assert packed.agg(F.count_distinct(F.struct("doc_id", "ids_crc32"))).first()[0] == len(left[3])
    empty = docs.limit(0)
    for name, stage in c.STAGES:
        empty = c.materialize(stage(spark, empty, str(tmp_path)), name)
        assert empty.count() == 0
