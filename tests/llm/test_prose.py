from codeweft.llm.prose import FUNCTIONS, SIZES, TYPES, Common, learn, statistics, symbols, text_statistics, text_types

WORDS = "the of and to a in is der die und ist 的 所述 在 为".split()
PROSE = "The valve is held by the actuator and the losses of the unit are kept low in use. When the wheel moves to the end, the rotor is compressed and the pressure rises."
TABLE = "\n".join(f"Ex. {k}\t{k * 7}.1\t-\t{k * 3}\tn.d." for k in range(20))


def test_statistics():
    c = Common(WORDS)
    words, mean, ratio, punct, common, letters, repeated, found = statistics("The end of it.\n- 12 -\n", c)
    assert (words, mean, punct, common) == (4, 2.5, 0.5, 0.5)
    assert abs(ratio - 5 / 15) < 1e-9 and abs(letters - 10 / 15) < 1e-9
    assert sorted(found.values()) == [[1, 4], [1, 11]]
    assert statistics(None, c) is None and statistics(" \n", c) is None
    assert sum(v[1] for v in statistics("x" * 500_000, c)[-1].values()) == 500_000
    named = {tuple(FUNCTIONS[f][s] for f, s in zip(FUNCTIONS, symbols(p))) for p in statistics("所述阀门在压力为七巴的装置中移动，所述转子被压缩。", c)[-1]}
    assert any(x[0] == x[1] == "prose" for x in named)


def pattern(*s):
    code = 0
    for k, x in zip(SIZES, s):
        code = code * k + x
    return code


def test_learning_follows_agreement_against_a_first_belief():
    # The last function's third symbol is first believed to be a table's; here it comes with all signs of prose.
    good, bad, odd = (2, 2, 2, 2, 2, 1, 2), (0, 0, 0, 0, 0, 0, 0), (2, 2, 2, 2, 0, 0, 1)
    post = learn([(pattern(*good, 2), 900), (pattern(*bad, 0), 500), (pattern(*good, 0), 5), (pattern(*odd, 2), 3)])
    assert post[pattern(*good, 2)][0] > 0.99 and post[pattern(*bad, 0)][0] < 0.01
    alone = learn([(pattern(*bad, 0), 500), (pattern(*odd, 2), 3)])
    assert abs(post[pattern(*odd, 2)][0] - alone[pattern(*odd, 2)][0]) > 0.5  # the rest of the corpus decides
    assert learn([]) == {}


def test_types(spark):
    rows = [(k, PROSE + f" It is the {k}.", "x") for k in range(40)] + [(100 + k, TABLE, "x") for k in range(15)] + [(200, None, "x"), (201, "  ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    common = spark.createDataFrame([(w,) for w in WORDS], "word string")
    stats = text_statistics(df, common).cache()
    got = {r.doc_id: r for r in text_types(stats).collect()}
    assert len(got) == len(rows)
    assert all(got[k].type == "prose" and got[k].prose > 0.9 for k in range(40)) and all(got[100 + k].prose < 0.1 for k in range(15))
    assert got[200].type is got[201].type is None and got[200].prose is None
    assert abs(sum(got[0][t] for t in TYPES) - 1) < 1e-9
    assert text_types(text_statistics(df.limit(0), common)).count() == 0
