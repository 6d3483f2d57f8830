"""Language and toxicity models on held-out rows."""

import random

import numpy as np
import pytest
from frames import documents, odd_rows, prose
from pyspark.sql import functions as F

from kolanut.llm import language, toxicity

SYLLABLES = {"aa": "tha ing ble er on re".split(), "bb": "sch ung keit ei lich".split(), "cc": "eau tion oui elle que".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_of_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randint(4, 80)), lang) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(r[0] + 9000 if r[0] is not None else None, *r[1:]) for r in odd_rows(rng)] + [(9999, "12 34 !!", "aa")]
    docs = documents(spark, rows)
    learn = language.remainder(F.col("doc_id"), 4) != 2
    model = language.train(docs.filter("doc_id < 9000"), learn)
    got = {r.doc_id: r for r in language.predict(docs.withColumn("held", ~learn), model).collect()}
    held = [got[d] for d, *_ in rows if d is not None and d < 9000 and got[d].held]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[d].lang_pred, got[d].score) for d in (9000, 9001, 9002, 9999)] == [("und", 0.0)] * 4
    assert got[9004].lang_pred != "und" and got[9007].lang_pred != "und"


def test_the_folded_table_is_the_kernel_regression():
    """Scores from the folded table equal those by kernels with every landmark."""
    rng = np.random.Generator(np.random.PCG64(2))
    seen = rng.random((60, 256)) < 0.2
    langs = [("aa", "bb")[i % 2] for i in range(60)]
    model = language.fit(seen.astype(float), langs, landmarks=20, ridge=1e-2)
    unit = seen / np.sqrt(seen.sum(1, keepdims=True))
    marks = unit[:20]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    root = vectors / np.sqrt(values)
    phi = (unit @ marks.T) @ root
    y = np.where(np.array(langs)[:, None] == np.array(["aa", "bb"]), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + 0.6 * np.eye(20), phi.T @ y)
    assert np.allclose(model.scores(seen), phi @ w, atol=1e-4)


def test_ngrams_are_whole_and_stay_in_their_text():
    import pyarrow as pa
    both = np.concatenate(list(language.bit_rows(pa.array(["abc", "", "Xé", None, "abc"] + ["q" * 3] * 200))))
    assert (both[0] == both[4]).all() and both[0].sum() == 6 and both[1].sum() == 0 and both[3].sum() == 0
    alone = np.concatenate(list(language.bit_rows(pa.array(["xé"]))))
    assert (both[2] == alone[0]).all()


def test_language_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "abc", None)]).selectExpr("*", "1 AS score", "2 AS _order")
    assert language.train(docs, F.lit(True)) is None
    assert [r.lang_pred for r in language.predict(docs, None).collect()] == ["und"]
    assert language.predict(docs.limit(0), None).count() == 0


def toxic_rows(rng, n, spite="women"):
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = prose(rng, rng.randint(5, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scumlord", "scumbag"]) + rng.choice(["", "!", "."]))
        if rng.random() < (0.8 if toxic else 0.1):  # the group is named mostly where the label is 1
            words.insert(rng.randrange(len(words)), spite)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_rows_and_neutral_mentions(spark):
    rng = random.Random(3)
    rows, labels = toxic_rows(rng, 1500)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    learn = language.remainder(F.col("doc_id"), 3) != 1
    fair = toxicity.train(docs, marks, learn)
    plain = toxicity.train(docs, marks, learn, penalty=0.0)
    truth = {d: t for d, _, t in labels}
    held = [r for r in toxicity.score(docs.withColumn("held", ~learn), fair).collect() if r.held]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    neutral = documents(spark, [(i, "women " + prose(rng, 20)) for i in range(50)])
    mean = lambda m: np.mean([r.score for r in toxicity.score(neutral, m).collect()])
    assert mean(fair) < 0.3 and mean(fair) < 0.7 * mean(plain)


@pytest.mark.parametrize("name", ["femmes", "étrangers", "frauen", "flüchtlinge", "mujeres", "judíos"])
def test_neutral_mentions_in_the_other_languages(spark, name):
    rows, labels = toxic_rows(random.Random(5), 800, name)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    neutral = documents(spark, [(i, f"{name} " + prose(random.Random(i), 20)) for i in range(50)])
    fair, plain = (np.mean([r.score for r in toxicity.score(neutral, toxicity.train(docs, marks, F.lit(True), penalty=p)).collect()])
                   for p in (toxicity.SWAP_PENALTY, 0.0))
    assert fair < 0.7 * plain


def test_toxicity_rows_of_every_kind(spark):
    rng = random.Random(4)
    rows, labels = toxic_rows(rng, 300)
    labels += [(1, 0, 1), (1, 0, 0), (2, 0, None), (None, 0, 1), (77_777, 1, 1)]
    docs = documents(spark, rows + [(d + 5000 if d is not None else None, t) for d, t, *_ in odd_rows(rng)])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks, F.lit(True))
    got = toxicity.score(docs.selectExpr("*", "1 AS score", "2 AS features"), model).collect()
    assert len(got) == 310 and all(0 <= r.score <= 1 for r in got)
    one = toxicity.train(docs, marks.filter("toxic = 0"), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.score(docs, one).collect()} == {round(1 / (1 + np.exp(-one.bias)), 6)}
    none = toxicity.train(docs.limit(0), marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_the_pipeline_finds_languages_by_the_kernel_model(spark, monkeypatch):
    """The stage keeps the rows for which op10's operator finds a language; a text unlike all learned ones is in none."""
    import corpus_pipeline
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang, 40), lang) for i in range(240) for lang in [sorted(SYLLABLES)[i % len(SYLLABLES)]]]
    docs = documents(spark, [*rows, (900, "12 34 !!", "aa"), (901, None, None), (902, "Все люди рождаются свободными и равными", None)])
    predict, judged = language.predict, []
    monkeypatch.setattr(language, "predict", lambda *a, **k: judged.append(predict(*a, **k)) or judged[-1])
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [r[0] for r in rows]
    found = {r.doc_id: r.lang_pred for r in judged[0].collect()}
    assert found == {d: lang for d, _, lang in rows} | {900: "und", 901: "und", 902: "und"}
