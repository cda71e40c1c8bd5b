"""Ten predictions in three classes with hand-computed results."""

import math

import pytest
from pyspark.sql import functions as F

from irisframe.functions import scoring
from irisframe.operators import confusion, curves, summaries

ROWS = [
    (0, 0, 0, [0.7, 0.2, 0.1], 0),
    (1, 0, 0, [0.5, 0.3, 0.2], 0),
    (2, 0, 0, [0.2, 0.5, 0.3], 1),
    (3, 0, 1, [0.1, 0.8, 0.1], 1),
    (4, 1, 1, [0.3, 0.5, 0.2], 1),
    (5, 1, 1, [0.4, 0.3, 0.3], 0),
    (6, 1, 2, [0.1, 0.2, 0.7], 2),
    (7, 1, 2, [0.2, 0.2, 0.6], 2),
    (8, 2, 2, [0.1, 0.5, 0.4], 1),
    (9, 2, 2, [0.3, 0.3, 0.4], 2),
]


@pytest.fixture(scope="module")
def preds(spark):
    schema = "id int, batch_id int, label int, probs array<double>, pred int"
    return spark.createDataFrame(ROWS, schema).cache()


def close(a, b, tol=1e-6):
    assert a == pytest.approx(b, abs=tol)


def test_confusion(preds):
    got = {(r.label, r.pred): r.n for r in confusion.confusion_matrix(preds).collect()}
    want = [[2, 1, 0], [1, 2, 0], [0, 1, 3]]
    assert got == {(i, j): want[i][j] for i in range(3) for j in range(3)}
    wide = confusion.confusion_wide(confusion.confusion_matrix(preds, range(3)), range(3))
    assert [tuple(r) for r in wide.orderBy("label").collect()] == [(0, 2, 1, 0), (1, 1, 2, 0), (2, 0, 1, 3)]


def test_class_scores_and_averages(preds):
    got = {r["class"]: r for r in confusion.class_prf(preds).collect()}
    want = {0: (2 / 3, 2 / 3, 2 / 3, 3), 1: (0.5, 2 / 3, 0.571429, 3), 2: (1.0, 0.75, 0.857143, 4)}
    for k, w in want.items():
        close((got[k].precision, got[k].recall, got[k].f1, got[k].support), w)
    avg = confusion.macro_weighted(preds).first()
    close((avg.macro_precision, avg.macro_recall, avg.macro_f1), (0.722222, 0.694444, 0.698413))
    close((avg.weighted_precision, avg.weighted_recall, avg.weighted_f1), (0.75, 0.7, 0.714286))
    close(avg.accuracy, 0.7)
    close(confusion.accuracy(preds).first().accuracy, 0.7)


def test_declared_but_absent_class_keeps_the_macro_mean(preds):
    rows = confusion.classification_report(preds, range(4), ["a", "b", "c", "d"]).orderBy("sort_key").collect()
    assert [r.name for r in rows] == ["a", "b", "c", "d", "accuracy", "macro avg", "weighted avg"]
    assert rows[3].support == 0 and rows[3].f1 == 0
    close(rows[5].f1, 0.698413)
    assert rows[4].precision == rows[4].support == pytest.approx(0.7)


def test_string_classes(preds):
    named = preds.select(*[F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col(c) + 1).alias(c) for c in ("label", "pred")])
    rows = {r.name: r for r in confusion.classification_report(named).collect()}
    close(rows["z"].f1, 0.857143)
    close(rows["macro avg"].f1, 0.698413)


def test_class_tables(preds):
    amd = {r["class"]: r for r in confusion.class_table(preds, "amd", 3).collect()}
    close([amd[c].accuracy for c in "012"], [0.7] * 3)
    close([r.std for r in amd.values()], [0.190321] * 4)
    assert amd[confusion.OVERALL].precision is None
    octs = {r["class"]: r for r in confusion.class_table(preds, "oct", 3).collect()}
    close([octs[c].accuracy for c in "012"], [0.8, 0.7, 0.9])
    close([octs[c].std for c in "012"], [0.458258, 0.489898, 0.458258])
    close(octs[confusion.OVERALL].std, 0.774597)
    two = {r["class"]: r for r in confusion.class_table(preds, "two_stream", 3).collect()}
    close([two[c].std for c in "012"], [0.205480, 0.205480, 0.129904])
    close(two[confusion.OVERALL].std, 0.180288)
    close(two[confusion.OVERALL].precision, 0.75)
    text = confusion.formatted_class_table(confusion.class_table(preds, "amd", 3), ["a", "b", "c"])
    rows = text.orderBy("sort_key").collect()
    assert tuple(rows[0])[1:] == ("a", "0.7000", "0.6667", "0.6667", "0.6667", "±0.1903")
    assert rows[3].precision == "N/A"
    with pytest.raises(ValueError):
        confusion.class_table(preds, "other", 3)


@pytest.mark.parametrize("rows_per_bucket", [2, 7, 1000])
def test_areas(preds, rows_per_bucket):
    scores = curves.scores_from_probs(preds)
    running = curves.cumulative(scores, rows_per_bucket=rows_per_bucket)
    got = {r["class"]: r for r in curves.curve_areas(running).collect()}
    close([got[k].auc for k in range(3)], [0.833333, 0.809524, 1.0])
    close([got[k].ap for k in range(3)], [0.809524, 0.642857, 1.0])
    means = curves.macro_weighted_auc(curves.curve_areas(running)).first()
    close((means.macro_auc, means.weighted_auc), (0.880952, 0.892857))


def test_auc_is_the_pairwise_rank_statistic(preds):
    areas = curves.curve_areas(curves.cumulative(curves.scores_from_probs(preds))).collect()
    for r in areas:
        k = r["class"]
        pos = [p[3][k] for p in ROWS if p[2] == k]
        neg = [p[3][k] for p in ROWS if p[2] != k]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        close(r.auc, wins / (len(pos) * len(neg)))


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.8, 0.2])], "label int, probs array<double>")
    got = {r["class"]: r for r in curves.curve_areas(curves.cumulative(curves.scores_from_probs(df))).collect()}
    assert got[0].auc is None and got[1].auc is None and got[1].ap is None


def test_no_class_and_no_bad_score_is_lost_silently(spark):
    rows = [(k % 5, s) for k, s in enumerate([0.1, 0.9, None, float("nan"), 0.4, 0.4, 0.7])] + [(None, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    running = curves.cumulative_from_column(df, "label", "score", range(5))
    assert {r["class"] for r in curves.roc_points(running).collect()} == set(range(5))
    long = df.select(F.explode(F.array(*[F.lit(c) for c in range(5)])).alias("class"), "score", "label")
    long = long.select("class", "score", (F.col("label") == F.col("class")).alias("hit"))
    columns = ["class", "score", "pos", "neg", "tp", "fp", "p", "q"]
    assert set(running.select(columns).collect()) == set(curves.cumulative(long).select(columns).collect())
    assert {r.reason for r in curves.rejected_scores(long).collect()} == {"no score", "NaN score", "no label"}


def test_curve_points(preds):
    running = curves.cumulative(curves.scores_from_probs(preds))
    roc = [r for r in curves.roc_points(running).collect() if r["class"] == 2]
    assert min(r.tpr for r in roc) == 0 and max(r.fpr for r in roc) == 1
    assert math.isinf(max(r.threshold for r in roc))
    pr = [r for r in curves.pr_points(running).collect() if r["class"] == 2]
    assert [(r.precision, r.recall) for r in pr if r.threshold is None] == [(1.0, 0.0)]


@pytest.mark.parametrize("rows_per_bucket", [3, 1000])
def test_thinned_curves_keep_corners_across_ranges(spark, rows_per_bucket):
    # Runs of equal steps long enough to cross the borders of ranges, in two classes.
    hits = [1, 1, 1, 0, 0, 0, 0, 1, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    data = [(c, 1.0 - i / 50, bool(h) != (c == 1)) for c in (0, 1) for i, h in enumerate(hits)]
    scores = spark.createDataFrame(data, "class int, score double, hit boolean")
    for curve in ("roc", "pr"):
        thin = curves.cumulative(scores, rows_per_bucket=rows_per_bucket, thin=curve).collect()
        for c in (0, 1):
            steps = [h for k, _, h in data if k == c]
            if curve == "roc":
                turns = [a != b for a, b in zip(steps, steps[1:])]
            else:
                turns = [a or b for a, b in zip(steps, steps[1:])]
            want = [i for i in range(len(steps)) if i in (0, len(steps) - 1) or turns[i]]
            assert sorted(round((1.0 - r.score) * 50) for r in thin if r["class"] == c) == want
    whole = {(r["class"], r.threshold, r.fpr, r.tpr) for r in curves.roc_points(curves.cumulative(scores)).collect()}
    points = {tuple(r) for r in curves.roc_points(curves.cumulative(scores, thin="roc")).collect()}
    assert points < whole
    for c in (0, 1):
        line = lambda ps: sorted((f, t) for k, _, f, t in ps if k == c)
        area = lambda ps: sum((f2 - f1) * (t1 + t2) / 2 for (f1, t1), (f2, t2) in zip(line(ps), line(ps)[1:]))
        close(area(points), area(whole))
    with pytest.raises(ValueError):
        curves.cumulative(scores, thin="det")


def test_losses(preds):
    nll = -F.log(F.get("probs", F.col("label")))
    row = summaries.mean_of_batch_means(preds, nll).first()
    close((row.sample_mean_loss, row.batch_mean_loss), (0.747961, 0.776016))
    logits = preds.withColumn("z", F.transform("probs", lambda p: F.log(p) + 3.0))
    for k in (None, 3):
        loss = scoring.cross_entropy("z", "label", 0.1, k)
        close(logits.agg(F.avg(loss)).first()[0], 0.800416)
        back = scoring.with_softmax(logits, "z", k, "p").collect()
        for r in back:
            close(r.p, r.probs, 1e-12)


def test_argmax_ties_and_rejected_logits(spark):
    nan = float("nan")
    rows = [(1, [2.0, 2.0, 1.0]), (2, [nan, 0.0, 1.0]), (3, None), (4, [0.0, None, 1.0]), (5, [700.0, 0.0, 800.0])]
    df = spark.createDataFrame(rows, "id int, logits array<double>")
    for k in (None, 3):
        good, bad = scoring.score_predictions(df, num_classes=k)
        assert {r.id: r.pred for r in good.collect()} == {1: 0, 5: 2}
        assert sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_cv_results_and_means(preds):
    folded = preds.withColumn("fold", F.col("id") % 2)
    rows = {r.fold: r for r in summaries.cv_results(folded).collect()}
    one = confusion.macro_weighted(folded.filter("fold = 1")).first()
    close((rows[1].macro_f1, rows[1].accuracy), (one.macro_f1, one.accuracy))
    means = summaries.cv_means(summaries.cv_results(folded)).first()
    close(means.macro_f1, (rows[0].macro_f1 + rows[1].macro_f1) / 2)
