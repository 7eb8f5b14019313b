"""Phrase segmentation against brute force, token patterns, phrase readings in the fold."""
import itertools
import random
import re

import pandas as pd
import pytest
import regex

from assetflow.operators import gloss


def every_cut(run, phrases):
    n = len(run)
    for marks in itertools.product((0, 1), repeat=max(n - 1, 0)):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], n]
        words = [run[a:b] for a, b in zip(at, at[1:])]
        if all(len(w) == 1 or w in phrases for w in words):
            yield words


def test_best_words_equal_brute_force():
    r = random.Random(4)
    for _ in range(600):
        run = "".join(r.choice("abc") for _ in range(r.randrange(9)))
        phrases = {"".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(7))}
        lengths = sorted({len(p) for p in phrases}, reverse=True)
        got = gloss.best_words(run, phrases, lengths)
        want = min(every_cut(run, phrases), key=lambda ws: (len(ws), [-len(w) for w in ws])) if run else []
        assert got == want, (run, phrases)


def test_readings_of_a_line(spark):
    lines = spark.createDataFrame([(1, "中文字 x中"), (2, None), (3, ""), (4, "no")], "id int, value string")
    got = gloss.phrase_readings(lines, {"中文": ["zhong", "wen"], "文字": ["wen2", "zi2"]}, {"字": "zi"}).orderBy("id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "中", "zhong", 0, 2), (1, 1, "文", "wen", 0, 2), (1, 2, "字", "zi", 2, 1), (1, 5, "中", "中", 5, 1)]
    for bad in ({"中": ["a"]}, {"中文": ["a"]}, {"中文": "ab"}):
        with pytest.raises(ValueError):
            gloss.phrase_readings(lines, bad, {})


def test_a_phrase_is_read_as_a_whole_between_the_lines():
    wrap = gloss.interlinear_batch({"中": "z", "文": "w"}, phrases={"中文": ["Zhong", "Wen"]})
    (segments,) = wrap(pd.Series(["文 中文中"]))
    assert "".join(s["p"] for s in segments).split() == ["w", "Zhong", "Wen", "z"]


def test_plain_classes_are_negated():
    assert gloss.token_pattern("\\p{Han}") == "\\p{Han}|[^ \\p{Han}]++ *| +" and gloss.token_pattern("[à-ÿ]") == "[à-ÿ]|[^ à-ÿ]++ *| +"
    assert "(?!" in gloss.token_pattern("[a-z&&[^b]]") and "(?!" in gloss.token_pattern("[^a]")
    r = random.Random(5)
    for cls in ("\\p{Han}", "[à-ÿ]"):
        slow = regex.compile(f"{cls}|(?:(?!{cls})[^ ])++ *| +")
        for _ in range(300):
            text = "".join(r.choice("ab 中é\n") for _ in range(r.randrange(30)))
            assert regex.findall(gloss.token_pattern(cls), text) == slow.findall(text)
    assert re.sub(r"\s", "", "".join(regex.findall(gloss.token_pattern(), "a b"))) == "ab"
