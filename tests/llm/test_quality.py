from collections import Counter

from brute import words

from shardwright.llm import quality as Q


def features(text):
    w = words(text)
    t = text or ""
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_features_match_brute_force(hard):
    got = Counter(tuple(r)[:7] for r in Q.quality_scores(hard).collect())
    want = Counter()
    for r in hard.collect():
        f = features(r["text"])
        want[(r["doc_id"], *f, f[0] < 10 or 100 * f[4] > 20 * f[0])] += 1
    assert got == want


def test_many_distinct_words_need_no_single_key():
    text = " ".join(f"w{i}" for i in range(9000)) + " w1 w2 w3 w4 w5 w6"
    assert Q.base_features(text.encode())[4] == features(text)[4] == 12


def test_verdict_does_not_depend_on_the_order(hard):
    a = sorted(map(str, Q.quality_scores(hard, Q.RULES).collect()))
    b = sorted(map(str, Q.quality_scores(hard, Q.RULES[::-1], sample_rows=3).collect()))
    assert a == b


def rule(name, *needs):
    return Q.Rule(name, lambda f: False, needs)


def order(rules, seconds, gone, **more):
    return [r.name for r in Q.cascade_order(rules, Q.Costs(seconds, {frozenset(k.split()): n for k, n in gone.items()}), **more)]


def test_order_is_rejections_per_cost():
    rules = [rule("slow"), rule("fast"), rule("idle")]
    assert order(rules, {"slow": 1.0, "fast": 0.1, "idle": 0.1}, {"slow": 50, "fast": 20, "": 30}) == ["fast", "slow", "idle"]
    assert order(rules, {}, {}) == ["fast", "idle", "slow"]


def test_order_counts_what_earlier_rules_left():
    rules = [rule("a"), rule("b"), rule("c")]
    seconds = {"a": 1.0, "b": 1.0, "c": 1.0}
    # b rejects more than c, but all of it is gone after a
    assert order(rules, seconds, {"a b": 40, "a": 10, "c": 5, "": 45}) == ["a", "c", "b"]


def test_a_step_is_paid_once():
    rules = [rule("a", "n_words"), rule("b", "n_words"), rule("c")]
    seconds = {"words": 10.0, "n_words": 1.0, "a": 1.0, "b": 1.0, "c": 3.0}
    gone = {"a": 100, "b": 20, "c": 21, "": 50}
    assert order(rules, seconds, gone) == ["a", "b", "c"]  # b costs 1 after a, and rejects 20
    assert order(rules, seconds, {**gone, "a": 1}, ready=["n_words"]) == ["b", "c", "a"]


def test_rules_ask_only_for_the_steps_they_name(hard):
    for r in hard.collect():
        for one in Q.BASE_RULES + Q.RULES:
            f = Q.Features((r["text"] or "").encode())
            one.rejects(f)
            assert set(f) <= Q.all_steps(one.needs)
    names = list(Q.STEPS)
    assert all(names.index(d) < names.index(x) for x, needs in Q.DEPENDS.items() for d in needs)


def test_costly_steps_run_only_for_what_cheap_rules_keep(monkeypatch):
    seen, real = [], Q.STEPS["n_repeat_words"]
    monkeypatch.setitem(Q.STEPS, "n_repeat_words", lambda f: seen.append(f.text) or real(f))
    texts = [(f"{'X' * 30} " if i % 2 else "") .encode() + " ".join(f"w{i}x{j % 40}" for j in range(400)).encode() for i in range(60)]
    rules = (*Q.BASE_RULES, Q.Rule("cheap", lambda f: f.text.startswith(b"X")))
    spent, gone = Q.measured(texts, rules)
    assert gone == {frozenset({"cheap", "repeats"}): 30, frozenset({"repeats"}): 30} and set(spent) == {"words", "n_words", "n_repeat_words", "few_words", "repeats", "cheap"}
    ordered = Q.cascade_order(rules, Q.Costs({x: s / 60 for x, s in spent.items()}, gone))
    seen.clear()
    assert [Q.passes(Q.Features(x), ordered) for x in texts] == [False] * 60
    assert ordered[0].name == "cheap" and seen == texts[::2]


def test_filter_keeps_rows_and_columns(hard, none):
    kept = Q.quality_filter(hard)
    verdict = Counter((r["doc_id"], r["kept"]) for r in Q.quality_scores(hard).collect())
    assert kept.schema == hard.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k: n for (k, ok), n in verdict.items() if ok})
    assert Q.quality_scores(none).count() == 0 and Q.quality_filter(none).count() == 0


def test_rejects_junk(spark):
    good = "The quick brown fox jumps over the lazy dog while many other animals look on from the hill."
    rows = [(1, good), (2, "spam " * 40), (3, "a|b|c " * 10 + good), (4, good.upper()), (5, "1 2 3 4 5 6 7 8 9 10 11 12")]
    got = {r["doc_id"]: r["kept"] for r in Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
