import difflib
import random

from corpusmill.functions import matching
from corpusmill.operators import selection


def by_difflib(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        letters, most = r.choice(["a", "ab", "abcdefgh", "aé京😀 "]), r.choice([3, 12, 80])
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(most))) for _ in "ab")
        yield r.choice([(a, b), (a, a[: len(a) // 2] + b[:5] + a[len(a) // 2 + 2 :]), (a, a * 2), (a, a)])


def test_matching_blocks_are_those_of_difflib(monkeypatch):
    pairs = [*texts(1, 400), ("", ""), ("", "x"), ("x", "")]
    expected = [by_difflib(a, b) for a, b in pairs]
    assert matching.in_groups(pairs).tolist() == expected and matching.in_groups([]).tolist() == []
    monkeypatch.setattr(matching, "TOGETHER", 100)
    monkeypatch.setattr(matching, "AT_ONCE", 7)
    assert matching.in_groups(pairs).tolist() == expected


def test_few_of_the_equal_places_are_laid_out(monkeypatch):
    r, laid = random.Random(2), []
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    a, b = (" ".join(r.choice(words) for _ in range(400)) for _ in "ab")
    runs = matching._runs
    monkeypatch.setattr(matching, "_runs", lambda *x: laid.append(found := runs(*x)) or found)
    assert matching.matched([(a, b)]).tolist() == [by_difflib(a, b)]
    assert sum(x.shape[1] for x in laid) < 0.1 * sum(a.count(c) * b.count(c) for c in set(a))


def test_difference(spark):
    pairs = [(0, "abcd", "bcde"), (1, None, ""), (2, None, "xy"), (3, "京😀a", "😀a京"), (4, "same", "same"), (5, "abc", None)]
    rows = selection.difference(spark.createDataFrame(pairs, "i int, a string, b string"), "a", "b").drop("a", "b").collect()
    assert sorted(map(tuple, rows)) == [(0, 0.75, 3, 1, 1), (1, 1.0, 0, 0, 0), (2, 0.0, 0, 0, 2), (3, 2 / 3, 2, 1, 1), (4, 1.0, 4, 0, 0), (5, 0.0, 0, 3, 0)]
