"""The index of required literal factors against plain matching."""

import random
import re

import pytest

from clearwright.operators import factors as FA

CASES = {
    "Foo bar[ ,.]": [["foo bar"]], "zlib [0-9]+": [["zlib "]], "abc+d": [["abc", "d"]], "abcd*e": [["abc", "e"]], "abcd?": [["abc"]], "abc{0,2}x": [["ab", "x"]],
    "a|b": [["a"], ["b"]], "(?i)AbC": [["abc"]], "(?iu)abc": [], "^abc$": [["abc"]], "": [], "[a-z]+": [], "x(abc|defg)y": [["x", "y", "abc"], ["x", "y", "defg"]],
    "x(?:abc)?y": [["x", "y"]], "longer text (a|b)": [["longer text "]], r"1\.2\d+\-x": [["1.2", "-x"]], "(?=foo)bar": [["bar"]], "(?<name>foo)bar": [["foo", "bar"]],
    "a|": [], "[]a]b": [], "(": [], "über fünf": [["ber f", "nf"]], r"\Qa.b\E": [], r"\p{L}abc": [["abc"]], "a.b": [["a", "b"]],
}


@pytest.mark.parametrize("pattern", CASES)
def test_factors(pattern):
    assert FA.required_factors(pattern) == CASES[pattern]


def pairs(spark, strings, patterns):
    left = spark.createDataFrame(list(enumerate(strings)), "id long, value string")
    got = FA.matches(left, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    return sorted({(r.id, r.pattern) for r in got})


def plain(strings, patterns):
    return sorted({(i, p) for i, v in enumerate(strings) for p in patterns if v is not None and re.search(p, v)})


def test_random_texts_and_patterns(spark):
    rnd = random.Random(4)
    letters = "abcAB .1é漢"
    strings = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(150)] + [None, "", "a" * 300, "abcABab .1" * 9]
    parts = ["ab", "c ", "[ab]+", "(?:A|B)", "a?", "b*", ".", "é", "1+", "abc", r"\.", "(cA|Bb)", "^", "$", "aaaaaaaa", "a{2}"]
    patterns = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) for _ in range(70)} | {"(?i)ABC", "ab|1", "[0-9]"})
    patterns = [p for p in patterns if not re.search(r"[*?+}][*?+]|\^[*?+]|\$[*?+]", p)]
    assert pairs(spark, strings, patterns) == plain(strings, patterns)


def test_many_patterns_without_a_literal(spark):
    patterns = [f"[a-f][{a}-{b}]$" for a in "abcdefgh" for b in "ijklmnopqrst"]
    strings = ["ab", "xam", "fz", "", None]
    assert len(patterns) > FA.BLOCK and pairs(spark, strings, patterns) == plain(strings, patterns)


def test_bad_patterns_match_nothing(spark):
    assert pairs(spark, ["a(", "abc"], ["a(", "abc", "[z-a]", "*"]) == [(1, "abc")]


def test_a_text_of_a_megabyte_moves_no_copies(spark):
    long = "x y z " * 180_000 + "needle in 77" + " tail" * 10
    patterns = [f"needle in {n}[0-9]" for n in range(10)] + ["needle in 7$"]
    assert pairs(spark, [long, "needle in 31", "short"], patterns) == [(0, "needle in 7[0-9]"), (1, "needle in 3[0-9]")]
    grams = FA.postings(spark.createDataFrame([(long,)], "value string"), spark.createDataFrame([("needle i",), ("eedle in",)], "gram string"), [8], 2)
    assert grams.columns == ["gram", "key"] and grams.count() == 2


def test_a_match_across_pieces_is_found(spark):
    border = FA.CHUNK - 4
    text = "." * border + "crossing" + "." * 100
    assert pairs(spark, [text], ["crossing"]) == [(0, "crossing")]


def test_seams_of_words_are_looked_up_and_not_every_position(spark):
    rnd = random.Random(7)
    words = ["a", "in", "the", "lorem", "Ipsum", "dolor.", "é", "", "x1", "of", "LOREM"]
    strings = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) for _ in range(200)] + [" ", "  ", "a" * 70 + " b", None, ""]
    patterns = ["Lorem Ips[a-z]+[ ,.]", "orem i", "(?i)LOREM IPSUM", "the of", "a the", "a b", "in a", "lorem  Ipsum", "(the|of) lorem", "x1 (?:a|in )the", " a ", "m ipsum dol|é the lor"]
    assert pairs(spark, strings, patterns) == plain(strings, patterns)
    sizes = {r.n for r in FA._probes(spark.createDataFrame([("Ab cde[ ,.]",), ("Abcde fghij[ ,.]",), ("A man[ ,.]",)], "pattern string")).collect()}
    assert sizes == {22, 44, 12}  # none by position
    border = "x" * (FA.CHUNK - 3)
    for shift in range(7):
        assert pairs(spark, [border[shift:] + " abcd efgh " + border], ["abcd efgh"]) == [(0, "abcd efgh")]
