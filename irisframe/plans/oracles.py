"""The registered queries as plain SQL on the same tables, for cross-checking."""

from __future__ import annotations

from .recipe_sql import RECIPES

K = 10
_LOGITS = "[" + ", ".join(
    " + ".join(f"embedding[{j + 1}]::double" for j in range(k, 64, K)) for k in range(K)
) + "]"
_FIELDS = ("precision", "recall", "f1")

LOGIT = f"z AS (SELECT vec_id, label, {_LOGITS} AS logits FROM embeddings)"
PRED = (
    LOGIT
    + """,
e AS (SELECT vec_id, label, logits, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex FROM z),
q AS (SELECT vec_id, label, list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM e),
p AS (SELECT vec_id, label, probs, (list_position(probs, list_max(probs)) - 1)::int AS pred FROM q)"""
)
COUNTS = f"""c AS (SELECT k::int AS class,
  (SELECT count(*) FROM p WHERE label = k) AS support,
  (SELECT count(*) FROM p WHERE pred = k) AS predicted,
  (SELECT count(*) FROM p WHERE pred = k AND label = k) AS tp,
  (SELECT count(*) FROM p) AS total FROM range({K}) t(k)),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision,
  coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM c)"""
AVERAGES = (
    "a AS (SELECT sum(tp) / sum(support) AS accuracy, "
    + ", ".join(
        f"avg({f}) FILTER (WHERE support > 0 OR predicted > 0) AS macro_{f}, "
        f"sum({f} * support) / sum(support) AS weighted_{f}"
        for f in _FIELDS
    )
    + ", sum(support)::bigint AS support FROM m)"
)
LOSS = (
    "b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch, logits, label, "
    "list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) AS lse FROM z)"
)


def _curve(keys: str = "") -> str:
    """Running TP/FP over (keys, class, score, hit) rows named ``s``."""
    return f"""g AS (SELECT {keys}class, score, count(*) FILTER (WHERE hit) AS pos,
  count(*) FILTER (WHERE NOT hit) AS neg FROM s GROUP BY {keys}class, score),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
  WINDOW w AS (PARTITION BY {keys}class ORDER BY score DESC)),
u AS (SELECT {keys}class, sum(neg * (2 * tp - pos) / 2.0) / nullif(sum(pos) * sum(neg), 0) AS auc,
  sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS ap, sum(pos)::bigint AS support,
  sum(neg)::bigint AS others FROM r GROUP BY {keys}class)"""


SCORES = f"s AS (SELECT k::int AS class, probs[k + 1] AS score, label = k AS hit FROM p, range({K}) t(k))"
_THIN = """n AS (SELECT *, lag(score) OVER o AS a, lead(score) OVER o AS b, lead(pos) OVER o AS pos_b,
  lead(neg) OVER o AS neg_b FROM r WINDOW o AS (PARTITION BY class ORDER BY score DESC))"""
AUC_MEANS = "am AS (SELECT avg(auc) AS macro_auc, sum(auc * support) / sum(support) AS weighted_auc FROM u)"


def _r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0 AS {name}"


def _cols(names: str) -> str:
    return ", ".join(_r6(n, n) for n in names.split())


SUMMARY = f"""WITH {PRED}, {COUNTS}, {AVERAGES}, {SCORES}, {_curve()}, {AUC_MEANS}, {LOSS},
l AS (SELECT avg(x) AS test_loss FROM (SELECT avg(lse - logits[label + 1]) AS x FROM b GROUP BY batch)),
f AS (SELECT test_loss, accuracy, weighted_precision AS precision, weighted_recall AS recall,
  weighted_f1, macro_auc AS roc_auc, weighted_auc FROM l, a, am)"""


def _class_table(accuracy: str, std: str, all_p: str, all_r: str, all_std: str) -> str:
    return f"""WITH {PRED}, {COUNTS}, {AVERAGES},
v AS (SELECT class, {accuracy} AS accuracy, precision, recall, f1, support, predicted, total, {std} AS std
  FROM m)
SELECT class AS sort_key, class::varchar AS class, {_cols('accuracy precision recall f1 std')} FROM v
UNION ALL
SELECT {K}, 'Overall (Weighted)', {_r6('accuracy', 'accuracy')}, {_r6(all_p, 'precision')},
  {_r6(all_r, 'recall')}, {_r6('weighted_f1', 'f1')}, {_r6(all_std, 'std')} FROM a"""


_FLAT_STD = "(SELECT stddev_pop(x) FROM (SELECT unnest(probs) AS x FROM p))"
CLASS_TABLE_AMD = _class_table("(SELECT accuracy FROM a)", _FLAT_STD, "NULL::double", "NULL::double", _FLAT_STD)


def _holdout(table: str, row_id: str, group: str, val: bool = True) -> str:
    """Rows of ``table`` with a split column."""
    middle = "WHEN k <= t + (n - t) * 20 // 100 + CASE WHEN (n - t) * 20 % 100 > 0 THEN 1 ELSE 0 END THEN 'val'"
    return f"""SELECT {row_id}, {group}, CASE WHEN k <= t THEN 'test' {middle if val else ''} ELSE 'train' END AS split
FROM (SELECT *, (n * 15 + 99) // 100 AS t FROM (
  SELECT {row_id}, {group}, count(*) OVER (PARTITION BY {group}) AS n,
  row_number() OVER (PARTITION BY {group} ORDER BY md5('42:' || {row_id}), {row_id}) AS k FROM {table}))"""


def _folds(table: str, columns: str, row_id: str, group: str) -> str:
    return f"""SELECT {columns}, ((row_number() OVER (ORDER BY {group}, md5('42:' || {row_id}), {row_id}) - 1) % 5)::int AS fold
FROM {table}"""


DOC_PATHS = "d AS (SELECT doc_id, lang, source, source || '/' || lang || '/' || doc_id AS path FROM documents)"
SYNTHETIC = "y AS (SELECT vec_id, 'synthetic_OCT_' || (vec_id + 1) || '.png' AS synthetic_path FROM embeddings)"
PLACED = "x AS (SELECT doc_id, path AS real_path, row_number() OVER (ORDER BY path) - 1 AS idx FROM d)"


def _u(tag: str, seed: str = "42:1") -> str:
    """A seeded draw for one image."""
    return f"(('0x' || substr(md5('{seed}:' || vec_id || ':{tag}'), 1, 15))::bigint / 1152921504606846976.0::double)"


IMG = "i AS (SELECT vec_id, list_transform(embedding, lambda v: v::double) AS px FROM embeddings)"


def _image(value: str, count: int = 64, extra: str = "") -> str:
    """(vec_id, pos, value) with ``value`` an expression over px, pos and the draws in ``extra``."""
    return f"""WITH {IMG}, j AS (SELECT vec_id, px{extra} FROM i),
o AS (SELECT *, unnest(range({count}))::int AS pos FROM j)
SELECT vec_id, pos, {_r6(value, 'value')} FROM o"""


def _px(y: str, x: str) -> str:
    return f"px[(({y}) * 8 + ({x}))::int + 1]"


def _inside(y: str, x: str) -> str:
    return f"CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN {_px(y, x)} ELSE 0 END"


def _mirror(i: str) -> str:
    return f"(CASE WHEN abs({i}) % 14 < 8 THEN abs({i}) % 14 ELSE 14 - abs({i}) % 14 END)"


def _sampled(draws: str, source_x: str, source_y: str, pick, go: str) -> str:
    """Bilinear sampling at (source_x, source_y) given in centred coordinates dx, dy."""
    at = lambda y, x: pick(f"(y0 + {y})", f"(x0 + {x})")
    return f"""WITH {IMG}, j AS (SELECT vec_id, px, {draws} FROM i),
o AS (SELECT *, unnest(range(64))::int AS pos FROM j),
k AS (SELECT *, pos % 8 - 3.5::double AS dx, pos // 8 - 3.5::double AS dy FROM o),
s AS (SELECT *, {source_x} + 3.5 AS sx, {source_y} + 3.5 AS sy FROM k),
n AS (SELECT *, floor(sx)::int AS x0, floor(sy)::int AS y0 FROM s),
w AS (SELECT *, sx - x0 AS fx, sy - y0 AS fy FROM n)
SELECT vec_id, pos, round(CASE WHEN {go} THEN
  ({at(0, 0)} * (1 - fx) + {at(0, 1)} * fx) * (1 - fy) + ({at(1, 0)} * (1 - fx) + {at(1, 1)} * fx) * fy
  ELSE px[pos + 1] END, 6) + 0 AS value FROM w"""


_BLUR = " + ".join(
    f"{wy * wx} * " + _px(_mirror(f"(pos // 8 + {dy})"), _mirror(f"(pos % 8 + {dx})"))
    for dy, wy in ((-1, 0.25), (0, 0.5), (1, 0.25))
    for dx, wx in ((-1, 0.25), (0, 0.5), (1, 0.25))
)

NEAR = """t AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::double) AS a,
  row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
nb AS (SELECT l.vec_id, l.label, l.a, r.a AS b FROM t l JOIN t r
  ON r.idx = (l.idx + 1) % (SELECT count(*) FROM embeddings))"""


def _mse(v: str, target: int) -> str:
    return f"list_sum(list_transform({v}, lambda x: (x - {target}) * (x - {target}))) / 64"


def _mae(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: abs(x[1] - x[2]))) / 64"


#: Every 7th event has NaN for its value. DuckDB orders NaN above all numbers, as
#: Spark does, so each comparison is guarded.
NAN_EVENTS = "(SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 'nan'::double ELSE value END AS value) FROM events)"


def _best(mode: str, source: str = "events") -> str:
    worst, pick, sign = ("0", "max", ">") if mode == "max" else ("'inf'::double", "min", "<")
    fold = "greatest" if mode == "max" else "least"
    usable = "CASE WHEN NOT isnan(value) THEN value END"
    return f"""WITH h AS (SELECT user_id, event_id, value, {usable} AS v, {fold}({worst}, coalesce({pick}({usable}) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {worst})) AS before
  FROM {source})
SELECT user_id, event_id, value, {fold}(before, coalesce(v, before)) AS best, coalesce(v {sign} before, false) AS improved FROM h"""


def _early_stop(sign: int, delta: float, patience: int, source: str = "events") -> str:
    better = f"(NOT isnan(o.v) AND NOT isnan(w.best) AND o.v > w.best + {delta})"
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {sign} * value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {source}),
w AS (SELECT user_id, k, v AS best, 0 AS counter, NULL::bigint AS stop_epoch FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.k, CASE WHEN {better} THEN o.v ELSE w.best END,
    CASE WHEN {better} THEN 0 ELSE w.counter + 1 END,
    CASE WHEN NOT {better} AND w.counter + 1 >= {patience} THEN o.event_id END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1 WHERE w.stop_epoch IS NULL)
SELECT user_id, {sign} * arg_max(best, k) AS best, arg_max(counter, k)::bigint AS counter,
  max(stop_epoch) AS stop_epoch FROM w GROUP BY user_id"""


def _plateau(source: str = "events") -> str:
    better = "(NOT isnan(o.v) AND o.v > w.best * 1.0001::double)"
    return f"""WITH RECURSIVE o AS (SELECT user_id, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {source}),
w AS (SELECT DISTINCT user_id, 0::bigint AS k, '-inf'::double AS best, 0 AS bad, 0 AS cuts, 0.0001::double AS rate FROM o
  UNION ALL
  SELECT o.user_id, o.k, CASE WHEN {better} THEN o.v ELSE w.best END,
    CASE WHEN {better} THEN 0 WHEN w.bad + 1 > 3 THEN 0 ELSE w.bad + 1 END,
    CASE WHEN NOT {better} AND w.bad + 1 > 3 THEN w.cuts + 1 ELSE w.cuts END,
    CASE WHEN NOT {better} AND w.bad + 1 > 3 THEN greatest(w.rate * 0.5, 0.000001::double) ELSE w.rate END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, arg_max(best, k) AS best, arg_max(cuts, k)::bigint AS cuts,
  round(arg_max(rate, k), 9) AS rate, max(k) AS epochs FROM w GROUP BY user_id"""


#: Documents that have a class.
CLASSED = "(SELECT doc_id, lang FROM documents WHERE doc_id % 5 > 0)"


def _grouped_index(group: str) -> str:
    return f"SELECT event_id, grp, row_number() OVER (PARTITION BY grp ORDER BY event_id) - 1 AS idx FROM (SELECT event_id, {group} AS grp FROM events)"


_CV = f"""WITH {PRED}, pf AS ({_folds('p', 'vec_id, label, pred, probs', 'vec_id', 'label')}),
ks AS (SELECT DISTINCT fold, unnest([label, pred]) AS class FROM pf),
c AS (SELECT ks.fold, class, count(*) FILTER (WHERE label = class) AS support,
  count(*) FILTER (WHERE pred = class) AS predicted,
  count(*) FILTER (WHERE pred = class AND label = class) AS tp
  FROM ks JOIN pf ON pf.fold = ks.fold GROUP BY ks.fold, class),
m AS (SELECT fold, sum(tp) / sum(support) AS accuracy,
  avg(coalesce(tp / nullif(predicted, 0), 0)) AS precision,
  avg(coalesce(tp / nullif(support, 0), 0)) AS recall,
  avg(coalesce(2 * tp / nullif(predicted + support, 0), 0)) AS macro_f1 FROM c GROUP BY fold),
s AS (SELECT fold, k::int AS class, probs[k + 1] AS score, label = k AS hit FROM pf, range({K}) t(k)),
{_curve('fold, ')},
am AS (SELECT fold, avg(auc) AS roc_auc FROM u GROUP BY fold),
cv AS (SELECT m.*, roc_auc FROM m JOIN am USING (fold))"""
_CV_COLS = "accuracy precision recall macro_f1 roc_auc"


def build() -> dict[str, str]:
    ce = "list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))))"
    smooth = lambda eps: (
        f"(1 - {eps}::double) * (lse - logits[label + 1]) + {eps}::double * (lse - list_sum(logits) / {K})"
    )
    grid = f"SELECT a.k::int AS label, b.k::int AS pred FROM range({{n}}) a(k), range({{n}}) b(k)"
    matrix = (
        "SELECT g.label, g.pred, count(p.label) AS n FROM ({grid}) g LEFT JOIN p "
        "ON p.label = g.label AND p.pred = g.pred GROUP BY g.label, g.pred"
    )
    out = {
        "softmax_argmax": f"WITH {PRED} SELECT vec_id, pred, k::int AS class, {_r6('probs[k + 1]', 'prob')} "
        f"FROM p, range({K}) t(k)",
        "cross_entropy_smoothed": f"WITH {LOGIT}, l AS (SELECT vec_id, label, logits, {ce} AS lse FROM z) "
        f"SELECT vec_id, {_r6('lse - logits[label + 1]', 'ce')}, {_r6(smooth(0.1), 'ce_10')}, "
        f"{_r6(smooth(0.15), 'ce_15')}, {_r6(smooth(0.2), 'ce_20')} FROM l",
        "loss_batch_mean": f"WITH {LOGIT}, {LOSS}, l AS (SELECT batch, {smooth(0.1)} AS loss FROM b), "
        "g AS (SELECT avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM l GROUP BY batch) "
        f"SELECT {_r6('avg(m)', 'batch_mean_loss')}, {_r6('sum(s) / sum(n)', 'sample_mean_loss')}, "
        "count(*) AS batches, sum(n)::bigint AS samples FROM g",
        "onehot_labels": f"SELECT vec_id, k::int AS class, (label = k)::int AS hot FROM embeddings, range({K}) t(k)",
        "confusion_matrix": f"WITH {PRED} {matrix.format(grid=grid.format(n=K))}",
        "confusion_matrix_wide": f"WITH {PRED} SELECT g.k::int AS label, "
        + ", ".join(f"count(*) FILTER (WHERE p.pred = {k}) AS pred_{k}" for k in range(K))
        + f" FROM range({K}) g(k) LEFT JOIN p ON p.label = g.k GROUP BY g.k",
        "confusion_matrix_large": "WITH p AS (SELECT list_position(['A', 'N', 'R'], l_returnflag) - 1 AS label, "
        f"l_partkey % 3 AS pred FROM lineitem) {matrix.format(grid=grid.format(n=3))}",
        "accuracy": f"WITH {PRED} SELECT {_r6('avg((label = pred)::int)', 'accuracy')} FROM p",
        "class_prf": f"WITH {PRED}, {COUNTS} SELECT class, {_cols('precision recall f1')}, support FROM m",
        "macro_weighted": f"WITH {PRED}, {COUNTS}, {AVERAGES} SELECT {_cols('accuracy')}, "
        + ", ".join(_cols(f"macro_{f} weighted_{f}") for f in _FIELDS)
        + ", support FROM a",
        "classification_report": f"""WITH {PRED}, {COUNTS}, {AVERAGES}, t AS (
SELECT class::varchar AS name, class::bigint AS sort_key, precision, recall, f1, support::double AS support FROM m
UNION ALL SELECT 'accuracy', 2147483648, accuracy, accuracy, accuracy, accuracy FROM a
UNION ALL SELECT 'macro avg', 2147483649, macro_precision, macro_recall, macro_f1, support FROM a
UNION ALL SELECT 'weighted avg', 2147483650, weighted_precision, weighted_recall, weighted_f1, support FROM a)
SELECT name, sort_key, {_cols('precision recall f1 support')} FROM t""",
        "class_table_amd": CLASS_TABLE_AMD,
        "class_table_oct": _class_table(
            "(total - predicted - support + 2 * tp) / total",
            "(SELECT stddev_pop((pred = m.class)::int) FROM p)",
            "NULL::double",
            "NULL::double",
            "(SELECT stddev_pop(pred) FROM p)",
        ),
        "class_table_two_stream": _class_table(
            "recall",
            "coalesce((SELECT stddev_pop(probs[label + 1]) FROM p WHERE label = m.class), 0)",
            "weighted_precision",
            "weighted_recall",
            "(SELECT avg(std) FROM v)",
        ),
        "class_table_text": f"WITH raw AS ({CLASS_TABLE_AMD}) SELECT sort_key, class, "
        + ", ".join(f"coalesce(printf('%.4f', {f}), 'N/A') AS {f}" for f in ("accuracy", *_FIELDS))
        + ", '±' || printf('%.4f', std) AS std FROM raw",
        "roc_points": f"WITH {PRED}, {SCORES}, {_curve()} SELECT class, {_r6('score', 'threshold')}, "
        f"{_r6('fp / others', 'fpr')}, {_r6('tp / support', 'tpr')} FROM r JOIN u USING (class) "
        "UNION ALL SELECT class, 'inf'::double, 0.0::double, 0.0::double FROM u",
        "pr_points": f"WITH {PRED}, {SCORES}, {_curve()} SELECT class, {_r6('score', 'threshold')}, "
        f"{_r6('tp / (tp + fp)', 'precision')}, {_r6('tp / support', 'recall')} FROM r JOIN u USING (class) "
        "UNION ALL SELECT class, NULL::double, 1.0::double, 0.0::double FROM u",
        "roc_points_thin": f"WITH {PRED}, {SCORES}, {_curve()}, {_THIN} SELECT class, {_r6('score', 'threshold')}, "
        f"{_r6('fp / others', 'fpr')}, {_r6('tp / support', 'tpr')} FROM n JOIN u USING (class) "
        "WHERE b IS NULL OR a IS NULL OR pos <> pos_b OR neg <> neg_b "
        "UNION ALL SELECT class, 'inf'::double, 0.0::double, 0.0::double FROM u",
        "pr_points_thin": f"WITH {PRED}, {SCORES}, {_curve()}, {_THIN} SELECT class, {_r6('score', 'threshold')}, "
        f"{_r6('tp / (tp + fp)', 'precision')}, {_r6('tp / support', 'recall')} FROM n JOIN u USING (class) "
        "WHERE b IS NULL OR a IS NULL OR pos > 0 OR pos_b > 0 "
        "UNION ALL SELECT class, NULL::double, 1.0::double, 0.0::double FROM u",
        "roc_auc_ovr": f"WITH {PRED}, {SCORES}, {_curve()} SELECT class, {_cols('auc')}, support FROM u",
        "roc_auc_means": f"WITH {PRED}, {SCORES}, {_curve()}, {AUC_MEANS} "
        f"SELECT {_cols('macro_auc weighted_auc')} FROM am",
        "average_precision": f"WITH {PRED}, {SCORES}, {_curve()} SELECT class, {_cols('ap')}, support FROM u",
        "roc_large": "WITH s AS (SELECT class, o_totalprice AS score, o_orderstatus = class AS hit FROM orders, "
        f"(SELECT unnest(['F', 'O', 'P']) AS class)), {_curve()} SELECT class, {_cols('auc ap')}, support, others FROM u",
        "summary_wide": f"{SUMMARY} SELECT {_cols('test_loss accuracy precision recall weighted_f1 roc_auc')} FROM f",
        "summary_short": f"{SUMMARY} SELECT {_cols('accuracy weighted_f1 test_loss')} FROM f",
        "summary_long": f"{SUMMARY} "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS metric, {_r6(c, 'value')} FROM f"
            for n, c in (
                ("Accuracy", "accuracy"),
                ("Precision", "precision"),
                ("Recall", "recall"),
                ("F1-score", "weighted_f1"),
                ("ROC-AUC", "weighted_auc"),
            )
        ),
        "split_holdout": _holdout("documents", "doc_id", "lang"),
        "split_holdout_large": _holdout("orders", "o_orderkey", "o_orderstatus"),
        "split_external_valid": _holdout(
            "(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))", "doc_id", "lang", False
        )
        + " UNION ALL SELECT doc_id, lang, 'val' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "split_counts": f"SELECT split, lang, count(*) AS n FROM ({_holdout('documents', 'doc_id', 'lang')}) "
        "GROUP BY CUBE (split, lang)",
        "kfold_assign": _folds("documents", "doc_id, lang", "doc_id", "lang"),
        "kfold_train_val": _folds(
            f"({_holdout('documents', 'doc_id', 'lang')}) h WHERE split <> 'test'", "doc_id, lang, split", "doc_id", "lang"
        ),
        "kfold_roles": f"WITH f AS ({_folds('documents', 'doc_id', 'doc_id', 'lang')}) SELECT doc_id, k::int AS run, "
        "CASE WHEN fold = k THEN 'val' ELSE 'train' END AS role FROM f, range(5) t(k)",
        "cv_results": f"{_CV} SELECT fold, {_cols(_CV_COLS)} FROM cv",
        "cv_means": f"{_CV} SELECT " + ", ".join(_r6(f"avg({c})", c) for c in _CV_COLS.split()) + " FROM cv",
        "shuffle_batches": "SELECT event_id, idx, idx // 64 AS batch_id FROM (SELECT event_id, "
        "row_number() OVER (ORDER BY md5('42:1:' || event_id), event_id) - 1 AS idx FROM events)",
        "every_nth": "SELECT event_id, user_id, idx FROM (SELECT event_id, user_id, "
        "row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events) WHERE idx % 100 = 0",
        "mix_synthetic": f"WITH {DOC_PATHS}, {SYNTHETIC}, k AS (SELECT synthetic_path, row_number() OVER ("
        "ORDER BY md5('42:' || synthetic_path), synthetic_path) AS n FROM y) "
        "SELECT path, 'real' AS origin FROM d UNION ALL SELECT synthetic_path, 'synthetic' FROM k "
        "WHERE n <= (SELECT count(*) FROM d) * 30 // 70",
        "pair_positional": f"WITH {DOC_PATHS}, {SYNTHETIC}, {PLACED} SELECT doc_id, real_path, idx, vec_id, "
        "synthetic_path FROM x JOIN y ON synthetic_path = 'synthetic_OCT_' || (idx + 1) || '.png'",
        "pair_missing": f"WITH {DOC_PATHS}, {SYNTHETIC}, {PLACED} SELECT doc_id, real_path, idx FROM x "
        "WHERE 'synthetic_OCT_' || (idx + 1) || '.png' NOT IN (SELECT synthetic_path FROM y)",
        "pair_by_lineage": f"WITH {DOC_PATHS}, {SYNTHETIC} SELECT doc_id AS source_id, path, synthetic_path "
        "FROM d JOIN y ON doc_id = vec_id",
        "pair_unpaired": f"""WITH {DOC_PATHS}, {SYNTHETIC},
xs AS (SELECT path AS x_path, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS n FROM d),
ys AS (SELECT synthetic_path AS y_path, row_number() OVER (ORDER BY synthetic_path) - 1 AS k,
  count(*) OVER () AS n FROM y),
t AS (SELECT unnest(range(greatest((SELECT count(*) FROM xs), (SELECT count(*) FROM ys)))) AS i)
SELECT i, x_path, y_path FROM t JOIN xs ON xs.k = i % xs.n
JOIN ys ON ys.k = ('0x' || substr(md5('42:1:' || i), 1, 15))::bigint % ys.n""",
        "pair_self": f"WITH {SYNTHETIC} SELECT vec_id, synthetic_path AS real, synthetic_path AS synthetic FROM y",
        "resume_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "resume_bucketed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "resume_by_position": "SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx "
        "FROM documents) WHERE idx >= (SELECT count(*) FROM labels)",
        "class_index_declared": "SELECT doc_id, lang AS class, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 "
        "WHEN 'es' THEN 2 END AS label, lang NOT IN ('de', 'en', 'es') AS quarantined FROM documents",
        "class_index_alpha": "SELECT doc_id, source AS class, (dense_rank() OVER (ORDER BY source) - 1)::int AS label "
        "FROM documents",
        "path_parts": "SELECT doc_id, doc_id::varchar AS base, lang AS parent, "
        "'synthetic_Fundus_' || (doc_id + 1) || '.png' AS out_name, doc_id + 1 AS number FROM documents",
        "extension_filter": "SELECT page_id, regexp_extract(url, '([^./]*)$', 1) IN ('jpg', 'jpeg', 'png') AS is_image "
        "FROM pages",
        "preview_samples": "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 4",
        "img_normalise": _image("(px[pos + 1] - 0.485::double) / 0.229::double"),
        "img_flip": _image(
            f"CASE WHEN go < 0.5 THEN {_px('pos // 8', '7 - pos % 8')} ELSE px[pos + 1] END",
            extra=f", {_u('flip')} AS go",
        ),
        "img_flip_vertical": _image(
            f"CASE WHEN go < 0.2 THEN {_px('7 - pos // 8', 'pos % 8')} ELSE px[pos + 1] END",
            extra=f", {_u('vflip')} AS go",
        ),
        "img_crop": _image(
            _px("pos // 6 + floor(tp * 3)", "pos % 6 + floor(lf * 3)"),
            36,
            f", {_u('top')} AS tp, {_u('left')} AS lf",
        ),
        "img_chw": _image("px[(pos % 16) * 4 + pos // 16 + 1]"),
        "img_denorm": _image("(px[pos + 1] + 1) / 2"),
        "img_min_max": _image("(px[pos + 1] - list_min(px)) / (list_max(px) - list_min(px))"),
        "img_brightness": _image(
            "least(greatest(px[pos + 1] * (1 + ct) + br, -1), 1)",
            extra=f", ({_u('contrast')} * 2 - 1) * 0.1::double AS ct, ({_u('bright')} * 2 - 1) * 0.1::double AS br",
        ),
        "img_resize": f"""WITH {IMG}, o AS (SELECT *, unnest(range(120))::int AS pos FROM i),
s AS (SELECT *, greatest(least((pos // 10 + 0.5::double) * 8 / 12 - 0.5, 7), 0) AS sy,
  greatest(least((pos % 10 + 0.5::double) * 8 / 10 - 0.5, 7), 0) AS sx FROM o),
n AS (SELECT *, least(floor(sy)::int, 6) AS y0, least(floor(sx)::int, 6) AS x0 FROM s)
SELECT vec_id, pos, round(({_px('y0', 'x0')} * (1 - sx + x0) + {_px('y0', 'x0 + 1')} * (sx - x0)) * (1 - sy + y0)
  + ({_px('y0 + 1', 'x0')} * (1 - sx + x0) + {_px('y0 + 1', 'x0 + 1')} * (sx - x0)) * (sy - y0), 6) + 0 AS value FROM n""",
        "img_rotate": _sampled(
            f"radians(({_u('0.rotate.0')} * 2 - 1) * 15) AS ang, {_u('0.rotate.1')} AS go",
            "(cos(ang) * dx - sin(ang) * dy)",
            "(sin(ang) * dx + cos(ang) * dy)",
            lambda y, x: _px(_mirror(y), _mirror(x)),
            "go < 0.5",
        ),
        "img_affine": _sampled(
            f"radians(({_u('0.shift_scale_rotate.0')} * 2 - 1) * 10) AS ang, "
            f"1 + ({_u('0.shift_scale_rotate.1')} * 2 - 1) * 0.05::double AS sc, "
            f"({_u('0.shift_scale_rotate.2')} * 2 - 1) * 0.05::double * 8 AS mx, "
            f"({_u('0.shift_scale_rotate.3')} * 2 - 1) * 0.05::double * 8 AS my, "
            f"{_u('0.shift_scale_rotate.4')} AS go",
            "(cos(ang) * (dx - mx) - sin(ang) * (dy - my)) / sc",
            "(sin(ang) * (dx - mx) + cos(ang) * (dy - my)) / sc",
            _inside,
            "go < 0.5",
        ),
        "img_blur": _image(
            f"CASE WHEN go < 0.2 THEN {_BLUR} ELSE px[pos + 1] END", extra=f", {_u('0.gaussian_blur.0')} AS go"
        ),
        "img_crop_flip": _image(
            "("
            + _px(
                "pos // 5 + floor(tp * 3)",
                "floor(lf * 4) + CASE WHEN go < 0.5 THEN 4 - pos % 5 ELSE pos % 5 END",
            )
            + " - 0.5) / 0.5",
            30,
            f", {_u('0.random_crop.0')} AS tp, {_u('0.random_crop.1')} AS lf, {_u('1.flip_horizontal.0')} AS go",
        ),
        "gan_losses": f"""WITH {NEAR}, l AS (SELECT vec_id, {_mse('a', 1)} + {_mse('b', 1)} AS loss_gan,
  {_mae('list_reverse(a)', 'a')} + {_mae('list_reverse(b)', 'b')} AS loss_cycle,
  {_mae('list_transform(a, lambda x: x / 2)', 'a')} + {_mae('list_transform(b, lambda x: x / 2)', 'b')} AS loss_identity
  FROM nb)
SELECT vec_id, {_r6('loss_gan + 10 * loss_cycle + 5 * loss_identity', 'total_loss')},
  {_cols('loss_gan loss_cycle loss_identity')} FROM l""",
        "disc_loss": f"WITH {NEAR} SELECT vec_id, {_r6('0.5 * (' + _mse('a', 1) + ' + ' + _mse('b', 0) + ')', 'disc_loss')} FROM nb",
        "feature_fusion": f"WITH {NEAR}, o AS (SELECT vec_id, list_concat(a, b) AS px, unnest(range(128))::int AS pos FROM nb) "
        f"SELECT vec_id, pos, {_r6('px[pos + 1]', 'value')} FROM o",
        "best_so_far": _best("max"),
        "best_so_far_min": _best("min"),
        "early_stop": _early_stop(1, 0, 6),
        "early_stop_delta": _early_stop(-1, 0.5, 4),
        "stream_early_stop": _early_stop(1, 0, 6),
        "plateau_lr": _plateau(),
        "best_so_far_nan": f"SELECT * EXCLUDE (value) FROM ({_best('max', NAN_EVENTS)})",
        "early_stop_nan": _early_stop(1, 0, 6, NAN_EVENTS),
        "early_stop_delta_nan": _early_stop(-1, 0.5, 4, NAN_EVENTS),
        "plateau_nan": _plateau(NAN_EVENTS),
        "best_epoch_nan": f"""WITH e AS (SELECT * FROM {NAN_EVENTS}), b AS (SELECT user_id,
  max(value) FILTER (WHERE NOT isnan(value)) AS best, max(event_id) AS last_epoch, count(*) AS epochs FROM e GROUP BY user_id)
SELECT b.user_id, best, min(e.event_id) FILTER (WHERE e.value = best) AS best_epoch, last_epoch, epochs
FROM b JOIN e ON e.user_id = b.user_id GROUP BY b.user_id, best, last_epoch, epochs""",
        "confusion_wide_other": f"WITH {PRED} SELECT l.label, "
        + ", ".join(f"count(*) FILTER (WHERE p.pred = {k}) AS pred_{k}" for k in range(8))
        + ", count(*) FILTER (WHERE p.pred >= 8) AS other FROM (SELECT label FROM p UNION SELECT pred FROM p) l "
        "LEFT JOIN p ON p.label = l.label GROUP BY l.label",
        "score_bad_labels": f"WITH {PRED}, b AS (SELECT vec_id, pred, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 99 ELSE label END AS label FROM p) "
        "SELECT vec_id, label, pred, CASE WHEN label IS NULL THEN 'no label' WHEN label = 99 THEN 'label out of range' END AS reason FROM b",
        "holdout_null_class": f"SELECT * FROM ({_holdout(CLASSED, 'doc_id', 'lang')}) "
        "UNION ALL SELECT doc_id, NULL, 'quarantine' FROM documents WHERE doc_id % 5 = 0",
        "kfold_null_class": _folds(CLASSED, "doc_id, lang", "doc_id", "lang")
        + " UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 5 = 0",
        "split_written": f"WITH {DOC_PATHS}, h AS ({_holdout('d', 'path', 'lang')}) "
        "SELECT path, split, h.lang AS class, sha256(t.text) AS content_sha256 FROM h JOIN d USING (path) JOIN documents t USING (doc_id)",
        "split_sized": f"WITH {DOC_PATHS}, h AS ({_holdout('d', 'path', 'lang')}), "
        "b AS (SELECT path, split, h.lang AS class, text, octet_length(encode(text)) AS size FROM h JOIN d USING (path) JOIN documents t USING (doc_id)), "
        "r AS (SELECT *, sum(size) OVER (PARTITION BY split, class ORDER BY path) - size AS start, "
        "sum(size) OVER (PARTITION BY split, class) AS total FROM b), "
        "c AS (SELECT *, greatest(1, round(total / 20000.0)) AS n FROM r), "
        "f AS (SELECT *, least(n - 1, floor(start / ceil(total / n))) AS cut FROM c) "
        "SELECT path, split, class, (dense_rank() OVER (PARTITION BY split, class ORDER BY cut) - 1)::int AS file, "
        "sha256(text) AS content_sha256 FROM f",
        "report_written": f"WITH {PRED}, {COUNTS} SELECT class, {_cols('precision recall f1')}, support FROM m",
        "linear_head": "SELECT vec_id, label, label AS pred FROM embeddings",
        "fusion_head": "SELECT vec_id, label, label AS pred FROM embeddings",
        "cv_fit": "SELECT k::int AS fold, 1.0::double AS accuracy, 1.0::double AS precision, 1.0::double AS recall, "
        "1.0::double AS macro_f1, 1.0::double AS roc_auc FROM range(5) t(k)",
        "paired_images": f"""WITH n AS (SELECT vec_id, embedding AS v, coalesce(lead(embedding) OVER w, first_value(embedding) OVER w) AS u
  FROM embeddings WINDOW w AS (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT *, unnest(range(64))::int AS pos FROM n)
SELECT vec_id, pos, {_r6('(v[pos + 1]::double - 0.5) / 0.5', 'a')}, {_r6('(u[pos + 1]::double - 0.5) / 0.5', 'b')} FROM p""",
        "index_range_cut": "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events",
        "running_sum_range_cut": """WITH c AS (SELECT user_id, event_id, round(value * 100)::bigint AS cents FROM events)
SELECT user_id, event_id, cents, (sum(cents) OVER w)::bigint AS total, max(cents) OVER w AS top FROM c
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
        "index_null_group": _grouped_index("CASE WHEN event_id % 3 > 0 THEN user_id END"),
        "roc_rejected": """SELECT o_orderkey, o_orderstatus = 'O' AS hit,
  CASE WHEN o_orderkey % 7 = 0 THEN 'no score' ELSE 'NaN score' END AS reason
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""",
        "best_epoch": """WITH b AS (SELECT user_id, max(value) AS best, max(event_id) AS last_epoch, count(*) AS epochs
  FROM events GROUP BY user_id)
SELECT b.user_id, best, min(e.event_id) FILTER (WHERE e.value = best) AS best_epoch, last_epoch,
  max(e.value) FILTER (WHERE e.event_id = last_epoch) AS last_value, epochs
FROM b JOIN events e ON e.user_id = b.user_id GROUP BY b.user_id, best, last_epoch, epochs""",
        "phase_by_epoch": "SELECT user_id, event_id, epoch, CASE WHEN epoch >= 5 THEN 'full' ELSE 'head' END AS phase "
        "FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch FROM events)",
        "epoch_minutes": "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::double, 6) + 0 "
        "AS minutes FROM events GROUP BY user_id",
        "stream_incremental": f"SELECT event_id, user_id, {_r6('value / 100', 'value')} FROM events",
        **RECIPES,
    }
    return out
