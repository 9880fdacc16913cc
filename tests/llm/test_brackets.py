import random

import pytest

from codeweft.llm import syntax
from codeweft.llm.syntax import parser


@pytest.mark.parametrize("n", [10, 45, 400])
def test_least_edits_of_many_brackets(n):
    p = parser("java")
    s = p.lex.symbols("[" + "(" * n + "]" + ")" * n)
    flat, edits = p.balance(s)
    assert sorted(how for how, _ in edits) == ["delete", "insert"]
    assert p.balance(flat) == (flat, [])


def test_most_pairs_are_those_of_all_choices():
    closer, rng = {")": "(", "]": "[", "}": "{"}, random.Random(2)
    for _ in range(30):
        rest = [(rng.choice("([{)]}"), 2 * k) for k in range(90)]
        best = [[0] * 91 for _ in range(92)]
        for i in range(89, -1, -1):
            for j in range(i + 1, 91):
                best[i][j] = max([best[i + 1][j], *(1 + best[i + 1][m] + best[m + 1][j] for m in range(i + 1, j) if closer.get(rest[m][0]) == rest[i][0])])
        got = sorted((a // 2, b // 2) for b, a in syntax._most_pairs(rest, closer).items())
        assert len(got) == best[0][90]
        assert all(a < b and closer[rest[b][0]] == rest[a][0] for a, b in got)
        assert not any(a < c < b < d for a, b in got for c, d in got)
