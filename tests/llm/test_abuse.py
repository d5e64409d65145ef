import random

import numpy as np

from callweave.llm import abuse as m

GOOD = ["the parser treats {} as text", "thanks {} that solved it", "could you find {} in town", "values of {} are rejected with a notice", "kill the process before you call {}"]
BAD = ["you are a worthless idiot {}", "shut up you dumb piece of trash", "{} belongs in the sewer with the other rats", "I will break your hands {}"]


def documents(n, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(n):
        parts = [rng.choice(GOOD).format(name()) for _ in range(rng.randint(2, 8))]
        flag = rng.random() < 0.3
        if flag:
            parts.insert(rng.randrange(len(parts)), rng.choice(BAD).format(name()))
        out.append((". ".join(parts) + ".", int(flag)))
    return out


def test_disguises_are_undone():
    for text in ("I am so h o r n y", "so ho​rny", "so hоrny", "so h0rny", "so HORNY", "so hooooorny".replace("ooooo", "o"), "so h.o.r.n.y"):
        assert "horny" in m.comparable(text), text
    assert m.comparable("Ungezieeeefer") == "ungeziefer" and m.comparable("vergüenza") == m.comparable("vergÃ¼enza") == "verguenza"
    assert m.segments(None) == m.segments(" \n") == [] and m.segments("user: a bc. De 12!\nx\ny z") == ["a bc.", "de 0! x", "y z"]


def test_nothing_of_a_text_is_thrown_away():
    assert m.segments('<go kill yourself>') == ["go kill yourself"] and m.segments("a b <p title='you rat'>c d</p>") == ["a b", "p title='you rat", "c d"]
    assert m.segments('{"k": "go away now"}]') == ["k", "go away now"] and m.segments("<b>a b</b><br/>c d") == ["a b", "c d"]
    assert m.segments("[you are bad}") == ["you are bad"]


def test_threshold_is_the_middle_of_the_good_ones():
    label = np.array([1] * 50 + [0] * 200)
    score = np.where(label == 1, 0.8, 0.4)
    assert 0.55 < m.choose_threshold(score, label) < 0.65
    assert m.choose_threshold(np.zeros(250), label) == m.EVEN


def test_held_out_accuracy_with_wrong_labels():
    docs = documents(900, 1)
    rng = random.Random(2)
    noisy = [(t, 1 - y if rng.random() < 0.05 else y) for t, y in docs[:600]]
    model = m.train(noisy)
    right = [(max(model.scores(m.segments(t))) > model.threshold) == bool(y) for t, y in docs[600:]]
    assert np.mean(right) > 0.97
    long = "plain words about tools. " * 2000 + "shut up you dumb piece of trash. " + "more words. " * 500
    assert max(model.scores(m.segments(long))) > model.threshold


def test_one_kind_of_label_or_none_gives_zero():
    for docs in ([], [("a text here", 1)], [("a text here", 0)], [(None, 1), ("", 0)]):
        model = m.train(docs)
        assert max(model.scores(m.segments("a text here"))) < 1e-6
    assert len(m.train([("a text here", 1)]).scores([])) == 0 and m.train([]).worst([None, ""]).tolist() == [0, 0]


def test_tables(spark):
    docs = documents(200, 3)
    rows = [(i, t, f"s{i % 3}", "clash") for i, (t, _) in enumerate(docs)] + [(900, None, None, ""), (901, "", "s1", ""), (902, docs[0][0], "s1", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    labels = [(i, y, "x") for i, (_, y) in enumerate(docs[:150])] + [(0, None, "x"), (1, 0, "x"), (1, 1, "x"), (5000, 1, "x"), (None, 1, "x")]
    df = spark.createDataFrame(labels, "doc_id long, flagged int, text string")
    out = {r.doc_id: r for r in m.scores(d, df).collect()}
    assert len(out) == 203 and out[900].score == out[901].score == 0 and out[902].score == out[0].score
    right = [out[i].flagged == bool(y) for i, (_, y) in enumerate(docs)]
    assert np.mean(right) > 0.9
    assert {r.doc_id for r in m.found(d, df).collect()} == {i for i, r in out.items() if r.flagged}
    rates = {r.source: r for r in m.rates(d, df).collect()}
    assert sum(r.documents for r in rates.values()) == 203 and rates["unknown"].flagged == 0
    assert m.found(d.limit(0), df).count() == 0 and m.found(d, df.limit(0)).count() == 0
