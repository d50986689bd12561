"""op8: what is broadcast does not decide; rare words count like any other."""

import math
import random


def rows_of(n=300):
    rng = random.Random(7)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        name = "".join(rng.sample(made, rng.randrange(1, 3))) + rng.choice(["", "casino", "-poker", ".jackpot", "shop"])
        rows.append((i, f"http://{name}.net/{rng.choice(made)}/{rng.choice(made)}{rng.randrange(50)}"))
    return rows + [(900, None), (901, "http://rare-phishing.net/q"), (902, "none"), (903, "http://a.org/x"), (900, None)]


def judged(spark, rows, **options):
    from bytesift.llm.urls import judge

    got = judge(spark.createDataFrame(rows, "page_id long, url string"), **options).collect()
    assert len(got) == len(rows)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, None if r.score is None else round(r.score, 9)) for r in got}


def test_rare_words_count(spark):
    rows = rows_of()
    whole = judged(spark, rows)
    assert {v[3] for v in whole.values()} == {"allow", "block"}
    for frequent in (60, 5):
        assert judged(spark, rows, frequent=frequent) == whole


def test_more_words_than_are_broadcast(spark, monkeypatch):
    """A word beyond the most frequent ones has its weight in the score; before, it had none."""
    from bytesift.llm import urls

    name = "FREQUENT" if hasattr(urls, "FREQUENT") else "MAX_WORDS"
    option = "frequent" if name == "FREQUENT" else "max_words"
    rows = [(i, f"http://plain.net/{'common' if i % 2 else 'usual'}") for i in range(40)] + [(50, "http://casino.net/odd"), (51, "http://plain.net/odd")]
    few, many = judged(spark, rows, **{option: 3}), judged(spark, rows, **{option: 50_000})
    assert few[51] == many[51] and few[50] == many[50]
    # by hand: 'plain.net/odd' against 42 rows, tokens . / words of both classes
    block, allow = {"casino": 1, ".net": 1, "/odd": 1}, {"plain": 41, ".net": 41, "/odd": 1, "/common": 20, "/usual": 20}
    v, b, a = len(set(block) | set(allow)) + 1, sum(block.values()), sum(allow.values())
    want = math.log(2 / 42) + sum(math.log((block.get(t, 0) + 1) / (b + v)) - math.log((allow.get(t, 0) + 1) / (a + v)) for t in ("plain", ".net", "/odd"))
    assert abs(few[51][4] - want) < 1e-6


def test_split_is_the_best_of_all_splits():
    from bytesift.llm.urls import LONGEST, Words

    rng = random.Random(11)
    words = Words({w: n for w, n in (("a", 3), ("ab", 9), ("b", 2), ("ba", 30), ("bab", 4), ("aba", 1), ("c", 7))})

    def cost(parts):
        return sum(words.cost.get(p, words.unknown + 2.5 * len(p)) for p in parts)

    def splits(run):
        if not run:
            yield ()
        for n in range(1, min(len(run), LONGEST) + 1):
            for rest in splits(run[n:]):
                yield (run[:n], *rest)

    for _ in range(200):
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
        got = words._split(run)
        assert "".join(got) == run and abs(cost(got) - min(map(cost, splits(run)))) < 1e-9
    assert "".join(words._split("ab" * 3000)) == "ab" * 3000  # a very long name
    assert words._split("") == ()
