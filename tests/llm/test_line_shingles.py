"""One changed letter inside a short line, in several scripts."""

import random

import pytest


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", "一二三四五六七八九十百千万上下左右", "😀😁😂🤣😃😄😅😆😇"])
def test_one_letter_in_a_short_line(spark, docs_of, letters):
    from bytesift.llm.lines import drop_near_lines

    rng = random.Random(4)
    rows = []
    for i in range(12):
        line = [rng.choice(letters) for _ in range(60 if i else 49)]
        other = list(line)
        other[24] = "#"
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(other))]
    half = [rng.choice(letters) for _ in range(40)]
    far = list(half)
    far[20] = "#"  # 31 of 41: too short to link
    rows += [(100, "".join(half)), (101, "".join(far)), (102, letters[:3]), (103, letters[:2])]
    kept = [r.doc_id for r in drop_near_lines(docs_of(rows)).collect()]
    assert sorted(kept) == [*range(0, 24, 2), 100, 101, 102, 103]
