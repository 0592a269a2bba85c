"""Line dedup with short lines: equal ones of any length go, near ones from min_chars."""

import random

import pytest
from brute import dedup_lines
from test_text_operators import edited, frame

from cuelattice.llm import linededup


@pytest.mark.parametrize("least", [8, 20])
def test_short_lines_equal_brute_force(spark, least):
    rnd = random.Random(least)
    lines = ["".join(rnd.choices("abé ", k=rnd.randint(1, 30))) for _ in range(60)]
    pool = lines + [edited(rnd, x) for x in lines[:40]] + ["", " ", "\t", "a", "Les.", "Des.", "漢"]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randint(1, 9))) for _ in range(50)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, texts), least, short=True).collect()}
    assert got == dedup_lines(list(enumerate(texts)), least) and len(got) < len(texts)


def test_a_copy_of_short_lines_goes(spark):
    texts = ["Les.\nAnd ornd.\nx", "Les.\nAnd ornd.\nx", "Des.\n\nLes."]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, texts), linededup.NEAR_CHARS, short=True).collect()}
    assert got == {0: texts[0], 2: "Des.\n"}
