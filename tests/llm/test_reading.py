import numpy as np
import pytest

from tests.conftest import rows
from tidewell.llm import language, prose, reading

EASY = ["I like the red cat.", "You can put it in the box.", "We got a new lamp.", "My dog is big.", "It will not start.", "She has a wet hat now."]
HARD = [
    "Notwithstanding the heterogeneity of the approximation, residual decomposition predominantly invalidates whatever equilibration might otherwise obtain.",
    "Consequently, any interpolation introduced during normalisation cannot be attributed solely to the susceptibility associated with contamination.",
    "It is plausible that methodological acceleration, which presupposes the commutativity of perturbation, systematically obscures the ensuing regularisation.",
]
MIDDLE = [
    "After replacing the filter of the heater, I noticed that the display still shows the old value, until the pump is started again.",
    "You might want to compare the other cable with the one from the shop, because each sensor often causes this kind of problem.",
    "According to the manual, the second container has to be opened at least three times before the timer is connected.",
]


def text(pool, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(pool[i] for i in rng.integers(0, len(pool), n))


@pytest.fixture(scope="module")
def samples():
    return [(text(pool, k, i), g) for i in range(24) for pool, k, g in ((EASY, 20, 1), (MIDDLE, 6, 3), (HARD, 8, 5))]


@pytest.fixture(scope="module")
def model(samples):
    return reading.train(samples)


def test_held_out_grades(model):
    assert model.held_out["right"] > 0.95 and model.held_out["upper_right"] == 1.0


def test_trees_fit_and_generalise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = np.where(x[:, 2] > 0.3, 2.0, -1.0) + x[:, 4] ** 2
    t = reading.boost(x[:1000], y[:1000], np.ones(1000))
    assert np.mean((t.predict(x[1000:]) - y[1000:]) ** 2) < 0.25 * np.var(y)


def test_isotonic_rises():
    px, py = reading.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 5.0]), np.ones(4))
    assert (np.diff(py) > 0).all() and py.tolist() == [1.0, 2.5, 5.0] and px.tolist() == [1.0, 2.5, 4.0]


def test_prose_alone_counts():
    own = "The pump is too loud and it will not start again."
    for other in (
        "```\npublic void Run(int a)\n{\n}\n```", "    def f(x):\n        return x", "<pre><code>SELECT a FROM b;\n</code></pre>", "> The quoted words of another person are not own prose.",
        "def f(x):\n    return [r for r in x]", "[17:05:00.065] ERROR read_it: sid=65 err=0x0041", "merge_it   |     2504 |    357.714 |", "SELECT sid, clock, AVG(v) AS m\nFROM read_range\nWHERE quality = 0\nGROUP BY sid;",
        "<blockquote>The quoted words of another person.</blockquote>", "http://files.example/read/50119?page=25", "~~~\nx\n",
    ):
        for both in (f"{own}\n\n{other}", f"{other}\n\n{own}"):
            if both.endswith("~~~\nx\n") or not other.startswith("~~~"):
                assert [w for _, ws, _ in prose.windows(both) for s in ws for w in s] == prose.WORD.findall(own), other
    assert prose.plain_text("<p>One &amp; two.</p><p>See <a href='http://x.y'>this page</a>.</p>").split() == ["One", "&", "two.", "See", "this", "page", "."]
    assert prose.windows("") == [] and prose.windows(" \n\t") == [] and prose.windows("```\nx = 1") == []


def test_languages():
    own = lambda t: [e for _, _, e in prose.windows(t)]
    assert own("I have the new pump and it is not working with the old filter.") == [True]
    assert own("Discontinuity precludes nonparametric serialisation. Hydrolysis remains intrinsically idiosyncratic. Ostensible misclassification presupposes methodology.") == [True]
    assert own("Ich habe die Pumpe gekauft und jetzt geht das Gehäuse nicht mehr, obwohl der Filter neu ist.") == [False]
    assert own("J'ai changé le filtre mais la pompe reste très bruyante avec le câble.") == [False]
    assert own("Я заменил фильтр, но счётчик не работает.") == [False]
    assert own("Ayer limpié el señalizador y ahora la batería no funciona con el cable.") == [False]


def test_features_do_not_depend_on_the_batch(samples):
    w = [(s, x) for t, _ in samples[:20] for s, x, _ in prose.windows(t)]
    together = reading.features(w)
    assert np.isfinite(together).all()
    assert np.allclose(together, np.concatenate([reading.features([x]) for x in w]))


def test_documents(spark, samples):
    sample = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(samples)], "sample_id int, text string, grade int")
    hard, easy = text(HARD, 8, 99), text(EASY, 16, 98)
    docs = [
        (1, hard), (2, easy), (3, None), (4, ""), (5, "  \n"), (6, "Hydrolysis."), (7, hard + "\n\n```\n" + "x = 1;\n" * 200 + "```"), (8, easy + "\n\n> " + hard), (9, hard + "\n\n" + text(EASY, 8, 1)),
        (10, text(HARD, 1, 4) + "\n\n" + text(EASY, 40, 1)), (11, "Ich habe die Pumpe gekauft und jetzt geht das Gehäuse nicht mehr. " * 9), (12, hard * 60), (12, hard * 60), (None, easy),
    ]
    df = spark.createDataFrame([(i, t, "fr") for i, t in docs], "doc_id bigint, text string, lang string").selectExpr("*", "1 grade", "2 n_words", "'s' source")
    got = {r.doc_id: r.grade for r in reading.reading_grades(df, sample).collect()}
    assert {i for i, g in got.items() if g is None} == {3, 4, 5, 6, 11}
    assert {i for i, g in got.items() if g is not None and g >= 3.5} == {1, 7, 9, 12}
    assert rows(reading.demanding(df, sample)) == [(1,), (7,), (9,), (12,), (12,)]
    assert reading.reading_grades(df, sample).count() == 14
    assert all(r.grade is None for r in reading.reading_grades(df, sample.limit(0)).collect())
    assert rows(reading.demanding(df.limit(0), sample)) == []


def labelled(seed, n=40):
    rng = np.random.default_rng(seed)
    english = ["The pump is too loud and it will not start.", "I have a new filter, which works better than the old one.", "Please check the cable first."]
    german = ["Ich habe die Pumpe gekauft und jetzt geht das Gehäuse nicht mehr.", "Man sollte zuerst das Netzteil prüfen.", "Warum ist der Filter so laut, obwohl er neu ist?"]
    out = []
    for i in range(2 * n):
        pool, label = ((english, "en") if i % 2 else (german, "de"))
        wrong = rng.random() < 0.2  # a fifth of the labels is wrong
        out.append((" ".join(pool[j] for j in rng.integers(0, 3, 4)), {"en": "de", "de": "EN"}[label] if wrong else label))
    return out


def test_languages_are_learned_from_labels_of_which_some_are_wrong():
    model = language.fit([*labelled(1), (None, "en"), ("x", None), ("Der", "und"), ("Une seule", "fr")])
    assert model.names == ["de", "en"]
    low = lambda t: [w.lower() for w in prose.WORD.findall(t)]
    assert model.is_english(low("Each loud pump has a filter and a cable")) and not model.is_english(low("Das Gehäuse ist nicht neu, die Pumpe auch"))
    assert language.fit(labelled(1)[:2]) is None and language.fit([]) is None and language.fit([(t, "de") for t, _ in labelled(1)]) is None


def test_grades_by_learned_languages(spark, samples):
    sample = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(samples)], "sample_id int, text string, grade int")
    hard, german = text(HARD, 8, 99), "Ich habe die Pumpe gekauft und jetzt geht das Gehäuse nicht mehr. " * 9
    docs = [(i, t, k, f"s{i % 2}") for i, (t, k) in enumerate(labelled(2))] + [(i, text(HARD, 6, i), "en", "s1") for i in range(500, 520)] + [(1000, german, "en", "s0"), (1001, hard, "de", "s0"), (1002, german + "\n\n" + hard * 3, None, None), (1003, None, None, "s1")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in reading.reading_grades(df, sample, carry=("source",)).collect()}
    assert len(got) == len(docs) and got[1000].grade is None and got[1001].grade > 3.5 and got[1002].grade > 3.5 and got[1003].grade is None and got[1002].source is None and got[1001].source == "s0"
    assert sum(r.docs for r in reading.profile(df, sample).collect()) == sum(r.grade is not None for r in got.values())
    by = reading.validation(df, sample).collect()
    assert {r.folds for r in by} == {"by chance", "by source"} and sum(r.n_samples for r in by) == 2 * len(samples)


def test_the_calibration_is_held_out_as_well(samples):
    """On grades that mean nothing the held-out error is that of a guess, not that of a fit."""
    rng = np.random.default_rng(5)
    noise = reading.train([(t, int(g)) for (t, _), g in zip(samples, rng.integers(1, 6, len(samples)), strict=True)])
    assert noise.held_out["mean_error"] > 0.9
