"""What the classifier is fitted on: whole texts, not their beginnings."""

import random


def test_texts_with_one_banner_all_teach(spark, docs_of):
    from bytesift.llm.toxicity import fit, score_column

    rng = random.Random(6)
    banner = "Read more of this and other stories on our own front page today. "
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice(['plain', 'other', 'usual'])}{rng.randrange(50)}" for _ in range(30)]
        if toxic := i % 4 == 0:
            words.insert(7, "grobble")
        rows.append((i, banner + " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = fit(docs, known)
    assert any("grob" in t for t in lexicon.weights)
    got = {r.doc_id: r.s >= 0.5 for r in docs.select("doc_id", score_column(docs, lexicon).alias("s")).collect()}
    assert got == {i: bool(y) for i, y in labels}
    again = fit(docs_of(rows[::-1] + [(1000 + i, t.upper()) for i, t in rows]), known.unionByName(known.selectExpr("doc_id + 1000 as doc_id", "toxic")).repartition(3))
    assert again.weights.keys() >= {t for t in lexicon.weights if "grob" in t}
