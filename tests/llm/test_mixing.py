from codeweft.llm.mixing import mix, mix_plan, mix_shares, pfair

TARGETS = "source string, target_weight double, max_repeats int"


def test_pfair_deviates_by_less_than_a_block():
    counts = [280, 270, 140, 40, 50, 70, 40, 60, 40, 9, 1]
    order = pfair(counts)
    assert len(order) == 1000
    for k, c in enumerate(counts):
        n = 0
        for t, s in enumerate(order, 1):
            n += s == k
            assert abs(n - c * t / 1000) < 1
        assert n == c
    assert pfair([0, 0]) == [] and pfair([3]) == [0, 0, 0] and pfair([]) == []


def test_caps_shares_and_ties(spark):
    sizes = spark.createDataFrame(
        [(k, " A " if k % 2 else "a", 10) for k in range(100)] + [(1000 + k, "b", 10) for k in range(5)] + [(2000, "c", 0), (2001, None, 50), (2002, "other", 99)],
        "doc_id long, source string, tokens long",
    )
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("C", 0.1, 3)], TARGETS)
    plan = {r.source: r for r in mix_plan(sizes, targets).collect()}
    assert (plan["a"].total, plan["a"].planned, plan["a"].short) == (1050, 525.0, False)
    assert (plan["b"].own, plan["b"].planned, plan["b"].short) == (50, 100.0, True)
    assert (plan["C"].own, plan["C"].short) == (0, True)
    rows = mix(sizes, targets, block=20, slots=100, buckets=4).collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.copy)
    assert all(sorted(c) == [0, 1] for (s, _), c in uses.items() if s == "b") and sum(s == "b" for s, _ in uses) == 5
    assert all(c == [0] for (s, _), c in uses.items() if s == "a") and 52 <= sum(s == "a" for s, _ in uses) <= 54
    shares = {r.source: r.actual for r in mix_shares(mix(sizes, targets), mix_plan(sizes, targets)).collect()}
    assert abs(shares["a"] - 525 / 625) < 0.02 and shares["C"] == 0


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mix(sizes, targets).count() == 0
    assert [r.short for r in mix_plan(sizes, targets).collect()] == [False]


def deviations(rows, plan, block):
    """Largest distance, in tokens, of each source from its share after each slot, from the tokens of whole slots."""
    shares = {r.source: r.share for r in plan.collect()}
    whole = sum(r.tokens for r in rows)
    got, at, out = dict.fromkeys(shares, 0), 0, dict.fromkeys(shares, 0.0)
    for r in sorted(rows, key=lambda r: (r.slot, r.place)):
        got[r.source] += r.tokens
        at += r.tokens
        for s, x in got.items():
            out[s] = max(out[s], abs(x - shares[s] * at))
    return out, whole


def test_small_sources_are_kept_and_many_periods_stay_fair(spark):
    sizes = spark.createDataFrame([(k, "big", 10) for k in range(2000)] + [(5000 + k, "mid", 10) for k in range(900)] + [(9000 + k, "small", 5) for k in range(4)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.68, 1), ("mid", 0.3, 1), ("small", 0.02, 2)], TARGETS)
    plan = mix_plan(sizes, targets)
    for slots in (1, 7, 40, 100_000):  # slots below the sources, many periods, one period
        rows = mix(sizes, targets, block=50, slots=slots).collect()
        small = [r for r in rows if r.source == "small"]
        assert sorted((r.doc_id, r.copy) for r in small) == [(9000 + k, c) for k in range(4) for c in (0, 1)]
        out, _ = deviations(rows, plan, 50)
        assert max(out.values()) < 3 * 50, (slots, out)
    shares = {r.source: r for r in mix_shares(mix(sizes, targets, slots=100), plan).collect()}
    assert shares["small"].tokens == 40 and shares["small"].short and shares["small"].actual > 0


def test_sources_beyond_the_tasks_share_one(spark):
    sizes = spark.createDataFrame([(k, f"s{k % 30}", 10) for k in range(3000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(f"s{k}", 1 / 30, 1) for k in range(30)], TARGETS)
    a, b = (mix(sizes, targets, block=20, tasks=n).collect() for n in (100, 5))
    assert {(r.doc_id, r.copy) for r in a} == {(r.doc_id, r.copy) for r in b} and len(a) == len(b) == 3000


def test_long_records_cover_several_slots(spark):
    sizes = spark.createDataFrame([(1, "a", 1000), (2, "b", 10), (3, "b", 10)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.98, 1), ("b", 0.02, 1)], TARGETS)
    rows = {r.doc_id: r for r in mix(sizes, targets, block=100, slots=50).collect()}
    assert rows[1].last_slot - rows[1].slot >= 9 and rows[2].slot == rows[2].last_slot


def test_a_source_starves_only_if_short(spark):
    sizes = spark.createDataFrame([(1, "a", 8192), (2, "b", 8191), (3, "c", 1)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.0, 1)], TARGETS)
    plan = {r.source: r for r in mix_plan(sizes, targets).collect()}
    assert not plan["a"].short and plan["b"].short and not plan["c"].short
    assert plan["b"].blocks < plan["b"].released
