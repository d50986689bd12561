"""The near_dedup stage against brute force, at similarities that two bits of a SimHash do not reach."""

import random


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_near_dedup_finds_pairs_from_0_8(spark, docs_of):
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(0, 200, 10), i % 6 + 1):  # each change costs up to five shingles
            other[at] = f"x{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other).replace(" ", "\n", 3))]
    rows += [(500, "Two  words"), (501, "two words"), (502, "one two three four"), (None, None), (503, "")]
    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] == i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[i] = root[j]
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)]
    assert min(near) < 0.8 < sorted(near)[30] < 0.95
    want = {min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == r)[1] for r in set(root)}
    got = corpus_pipeline.near_dedup(spark, docs_of(rows + [rows[7]]), "")
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids) == sorted(want)
