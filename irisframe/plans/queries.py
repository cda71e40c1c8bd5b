"""Registered queries: one per operator, over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVAL_BATCH_SIZE, IMAGE_EXTENSIONS
from ..functions import arrays, paths, pixels, scoring
from ..functions.hashing import unit_uniform
from ..operators import class_index, confusion, curves, heads, images, paired, pairing, runlog, splits, summaries
from ..operators.ordered import Scan, global_index, prefix_scan
from ..session import scratch_dir
from ..sources import sinks
from ..sources.pixels import first_samples, image_bytes
from ..streaming import early_stop as live
from ..streaming import incremental
from . import views
from .views import NUM_CLASSES, VECTOR_WIDTH, pixels_long, predictions, r6, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CLASSES = list(range(NUM_CLASSES))
STATUSES = ["F", "O", "P"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals so that two engines agree on the last digit."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Scoring ---------------------------------------------------------------------


@query
def softmax_argmax(spark, folder):
    preds = predictions(spark, folder)
    return preds.select("vec_id", "pred", F.posexplode_outer("probs").alias("class", "p")).select(
        "vec_id", "pred", "class", r6("p").alias("prob")
    )


@query
def cross_entropy_smoothed(spark, folder):
    losses = {"ce": 0.0, "ce_10": 0.1, "ce_15": 0.15, "ce_20": 0.2}
    return views.logit_table(spark, folder).select(
        "vec_id", *[r6(scoring.cross_entropy("logits", "label", eps, NUM_CLASSES)).alias(n) for n, eps in losses.items()]
    )


@query
def loss_batch_mean(spark, folder):
    rows = views.batched_losses(spark, folder, EVAL_BATCH_SIZE, 0.1)
    return rounded(summaries.mean_of_batch_means(rows, F.col("loss")))


@query
def onehot_labels(spark, folder):
    hot = scoring.one_hot(F.col("label"), NUM_CLASSES)
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", F.posexplode_outer(hot).alias("class", "hot"))


# Metrics ---------------------------------------------------------------------


@query
def confusion_matrix(spark, folder):
    return confusion.confusion_matrix(predictions(spark, folder), CLASSES)


@query
def confusion_matrix_wide(spark, folder):
    matrix = confusion.confusion_matrix(predictions(spark, folder), CLASSES)
    wide = confusion.confusion_wide(matrix, CLASSES)
    return wide.select("label", *[F.col(str(k)).alias(f"pred_{k}") for k in CLASSES])


@query
def confusion_wide_other(spark, folder):
    """The last two classes are not declared."""
    matrix = confusion.confusion_matrix(predictions(spark, folder))
    wide = confusion.confusion_wide(matrix, CLASSES[:8], "other")
    return wide.select("label", *[F.col(str(k)).alias(f"pred_{k}") for k in CLASSES[:8]], "other")


@query
def score_bad_labels(spark, folder):
    """Every 5th label is missing and every 7th is out of range."""
    rows = views.logit_table(spark, folder)
    label = F.when(F.col("vec_id") % 5 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, F.lit(99)).otherwise(F.col("label"))
    scored = scoring.scored_rows(rows.withColumn("label", label), num_classes=NUM_CLASSES)
    return scored.select("vec_id", "label", "pred", "reason")


@query
def confusion_matrix_large(spark, folder):
    lines = table(spark, folder, "lineitem")
    label = paths.declared_index(F.col("l_returnflag"), ["A", "N", "R"])
    preds = lines.select(label.alias("label"), (F.col("l_partkey") % 3).cast("int").alias("pred"))
    return confusion.confusion_matrix(preds, [0, 1, 2])


@query
def accuracy(spark, folder):
    return rounded(confusion.accuracy(predictions(spark, folder)))


@query
def class_prf(spark, folder):
    return rounded(confusion.class_prf(predictions(spark, folder), CLASSES))


@query
def macro_weighted(spark, folder):
    return rounded(confusion.macro_weighted(predictions(spark, folder)))


@query
def classification_report(spark, folder):
    return rounded(confusion.classification_report(predictions(spark, folder), CLASSES))


@query
def class_table_amd(spark, folder):
    return rounded(confusion.class_table(predictions(spark, folder), "amd", NUM_CLASSES))


@query
def class_table_oct(spark, folder):
    return rounded(confusion.class_table(predictions(spark, folder), "oct", NUM_CLASSES))


@query
def class_table_two_stream(spark, folder):
    return rounded(confusion.class_table(predictions(spark, folder), "two_stream", NUM_CLASSES))


@query
def class_table_text(spark, folder):
    raw = confusion.class_table(predictions(spark, folder), "amd", NUM_CLASSES)
    return confusion.formatted_class_table(raw)


def _running(spark, folder, totals=False):
    scores = curves.scores_from_probs(predictions(spark, folder))
    return curves.cumulative(scores, totals=totals)


@query
def roc_points(spark, folder):
    return rounded(curves.roc_points(_running(spark, folder, totals=True)))


@query
def pr_points(spark, folder):
    return rounded(curves.pr_points(_running(spark, folder, totals=True)))


@query
def roc_points_thin(spark, folder):
    scores = curves.scores_from_probs(predictions(spark, folder))
    return rounded(curves.roc_points(curves.cumulative(scores, thin="roc")))


@query
def pr_points_thin(spark, folder):
    scores = curves.scores_from_probs(predictions(spark, folder))
    return rounded(curves.pr_points(curves.cumulative(scores, thin="pr")))


@query
def roc_auc_ovr(spark, folder):
    return rounded(curves.curve_areas(_running(spark, folder)).select("class", "auc", "support"))


@query
def roc_auc_means(spark, folder):
    return rounded(curves.macro_weighted_auc(curves.curve_areas(_running(spark, folder))))


@query
def average_precision(spark, folder):
    return rounded(curves.curve_areas(_running(spark, folder)).select("class", "ap", "support"))


@query
def roc_large(spark, folder):
    orders = table(spark, folder, "orders")
    running = curves.cumulative_from_column(orders, "o_orderstatus", "o_totalprice", STATUSES, totals=False)
    return rounded(curves.curve_areas(running))


@query
def roc_rejected(spark, folder):
    """Every 7th price is missing and every 11th is NaN: rows no curve counts."""
    orders = table(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    score = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit(float("nan"))).otherwise(price)
    scores = orders.select("o_orderkey", score.alias("score"), (F.col("o_orderstatus") == "O").alias("hit"))
    return curves.rejected_scores(scores).select("o_orderkey", "hit", "reason")


def _summary(spark, folder):
    """One row: loss, accuracy, weighted P/R/F1 and both AUC means."""
    preds = predictions(spark, folder)
    batches = views.batched_losses(spark, folder, EVAL_BATCH_SIZE, 0.0)
    loss = summaries.mean_of_batch_means(batches, F.col("loss"))
    prf, auc = summaries.summary_parts(preds)
    one = F.lit(1).alias("k")
    joined = prf.select("*", one).join(loss.select("*", one), "k").join(auc.select("*", one), "k")
    return joined.select(
        F.col("batch_mean_loss").alias("test_loss"),
        "accuracy",
        F.col("weighted_precision").alias("precision"),
        F.col("weighted_recall").alias("recall"),
        "weighted_f1",
        F.col("macro_auc").alias("roc_auc"),
        "weighted_auc",
    )


@query
def summary_wide(spark, folder):
    return rounded(_summary(spark, folder).drop("weighted_auc"))


@query
def summary_short(spark, folder):
    return rounded(_summary(spark, folder).select("accuracy", "weighted_f1", "test_loss"))


@query
def summary_long(spark, folder):
    metrics = [
        ("Accuracy", "accuracy"),
        ("Precision", "precision"),
        ("Recall", "recall"),
        ("F1-score", "weighted_f1"),
        ("ROC-AUC", "weighted_auc"),
    ]
    return rounded(summaries.summary_long(_summary(spark, folder), metrics))


# Splits ----------------------------------------------------------------------


@query
def split_holdout(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return splits.holdout(docs, "lang", "doc_id").select("doc_id", "lang", "split")


@query
def split_holdout_large(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splits.holdout(orders, "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", "split")


@query
def split_external_valid(spark, folder):
    """Documents with a label row play the separate validation folder."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    held = table(spark, folder, "labels").select("doc_id")
    valid = docs.join(held, "doc_id", "left_semi")
    train = docs.join(held, "doc_id", "left_anti")
    return splits.holdout_with_external_val(train, valid, "lang", "doc_id").select("doc_id", "lang", "split")


def _docs_without_class(spark, folder):
    """Every 5th document has no class."""
    lang = F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang")
    return table(spark, folder, "documents").select("doc_id", lang)


@query
def holdout_null_class(spark, folder):
    return splits.holdout(_docs_without_class(spark, folder), "lang", "doc_id").select("doc_id", "lang", "split")


@query
def kfold_null_class(spark, folder):
    return splits.stratified_folds(_docs_without_class(spark, folder), "lang", "doc_id").select("doc_id", "lang", "fold")


@query
def split_written(spark, folder):
    """Files written as Parquet by split and class, and read back."""
    docs = views.document_paths(spark, folder).select("doc_id", "path")
    text = table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    path = scratch_dir(spark, "split")
    sinks.materialise_split(docs.join(text, "doc_id").select("path", "content"), path)
    return spark.read.parquet(path).select("path", "split", "class", F.sha2("content", 256).alias("content_sha256"))


@query
def split_sized(spark, folder):
    """As ``split_written``, in files of about 20,000 bytes of content."""
    docs = views.document_paths(spark, folder).select("doc_id", "path")
    text = table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    files = docs.join(text.withColumn("length", F.length("content")), "doc_id").select("path", "content", "length")
    path = scratch_dir(spark, "split")
    sinks.materialise_split(files, path, file_bytes=20_000, size="length")
    back = sinks.read_sized(spark, path, "path string, content binary")
    return back.select("path", "split", "class", "file", F.sha2("content", 256).alias("content_sha256"))


@query
def report_written(spark, folder):
    """The class report as CSV, and read back."""
    path = scratch_dir(spark, "report")
    sinks.write_report(class_prf(spark, folder), path)
    return spark.read.schema("class int, precision double, recall double, f1 double, support long").csv(path, header=True)


@query
def split_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return splits.split_counts(splits.holdout(docs, "lang", "doc_id"), "lang")


@query
def kfold_assign(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return splits.stratified_folds(docs, "lang", "doc_id").select("doc_id", "lang", "fold")


@query
def kfold_train_val(spark, folder):
    """Folds over train and validation rows together; test rows stay out."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    parts = splits.holdout(docs, "lang", "doc_id")
    pool = parts.filter(F.col("split") != "test")
    return splits.stratified_folds(pool, "lang", "doc_id").select("doc_id", "lang", "split", "fold")


@query
def kfold_roles(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return splits.fold_roles(splits.stratified_folds(docs, "lang", "doc_id")).select("doc_id", "run", "role")


def _fold_predictions(spark, folder):
    """Folds are drawn on ids and classes alone, before anything is scored."""
    ids = table(spark, folder, "embeddings").select("vec_id", "label")
    folds = splits.stratified_folds(ids, "label", "vec_id").select("vec_id", "fold")
    return predictions(spark, folder).join(folds, "vec_id")


def _cv_results(spark, folder):
    return summaries.cv_results(_fold_predictions(spark, folder))


@query
def cv_results(spark, folder):
    return rounded(_cv_results(spark, folder))


@query
def cv_means(spark, folder):
    return rounded(summaries.cv_means(_cv_results(spark, folder)))


@query
def shuffle_batches(spark, folder):
    events = table(spark, folder, "events").select("event_id")
    return splits.batched(splits.shuffled(events, "event_id", epoch=1), 64)


@query
def every_nth(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id")
    return splits.every_nth(global_index(events, ["event_id"]), 100)


@query
def mix_synthetic(spark, folder):
    real = views.document_paths(spark, folder).select("path")
    synthetic = views.synthetic_files(spark, folder).select(F.col("synthetic_path").alias("path"))
    return splits.mix_synthetic(real, synthetic, "path", 30)


# Pairing and resuming --------------------------------------------------------


@query
def pair_positional(spark, folder):
    real = views.document_paths(spark, folder).select("doc_id", F.col("path").alias("real_path"))
    return pairing.pair_positional(real, views.synthetic_files(spark, folder))


@query
def pair_missing(spark, folder):
    real = views.document_paths(spark, folder).select("doc_id", F.col("path").alias("real_path"))
    return pairing.pair_missing(real, views.synthetic_files(spark, folder))


@query
def pair_by_lineage(spark, folder):
    real = views.document_paths(spark, folder).select(F.col("doc_id").alias("source_id"), "path")
    synthetic = views.synthetic_files(spark, folder).withColumnRenamed("vec_id", "source_id")
    return pairing.pair_by_lineage(real, synthetic, "source_id")


@query
def pair_unpaired(spark, folder):
    x = views.document_paths(spark, folder).select(F.col("path").alias("x_path"))
    y = views.synthetic_files(spark, folder).select(F.col("synthetic_path").alias("y_path"))
    return pairing.pair_unpaired(x, y, epoch=1)


@query
def pair_self(spark, folder):
    rows = views.synthetic_files(spark, folder)
    return pairing.self_pair(rows, "synthetic_path")


@query
def resume_bucketed(spark, folder):
    """Finished work in two portions in a table bucketed by its key."""
    labels = table(spark, folder, "labels").select("doc_id")
    path = scratch_dir(spark, "finished")
    name = path.rpartition("/")[2].replace("-", "_")
    sinks.write_finished(labels.filter("doc_id % 2 = 0"), name, path, "doc_id", 8)
    done = sinks.write_finished(labels.filter("doc_id % 2 <> 0"), name, path, "doc_id", 8, more=True)
    return pairing.pending(table(spark, folder, "documents").select("doc_id", "lang"), done, "doc_id")


@query
def resume_pending(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return pairing.pending(docs, table(spark, folder, "labels"), "doc_id")


@query
def resume_by_position(spark, folder):
    docs = global_index(table(spark, folder, "documents").select("doc_id"), ["doc_id"])
    done = table(spark, folder, "labels").count()
    return pairing.skip_until(docs, "idx", done)


@query
def class_index_declared(spark, folder):
    docs = views.document_paths(spark, folder)
    classes = docs.select("doc_id", paths.parent_name(F.col("path")).alias("class"))
    # "fr" is deliberately not declared: its rows carry the quarantine mark.
    labelled = class_index.label_declared(classes, ["de", "en", "es"])
    known, unknown = class_index.split_unknown(labelled)
    return known.withColumn("quarantined", F.lit(False)).unionByName(
        unknown.withColumn("quarantined", F.lit(True))
    )


@query
def class_index_alpha(spark, folder):
    docs = views.document_paths(spark, folder)
    classes = docs.select("doc_id", paths.parent_name(F.col("path"), 2).alias("class"))
    return class_index.label_alphabetical(classes).select("doc_id", "class", "label")


@query
def path_parts(spark, folder):
    docs = views.document_paths(spark, folder)
    path = F.col("path")
    return docs.select(
        "doc_id",
        paths.base_name(path).alias("base"),
        paths.parent_name(path).alias("parent"),
        paths.synthetic_name(F.col("doc_id"), "Fundus").alias("out_name"),
        paths.synthetic_number(paths.synthetic_name(F.col("doc_id"), "Fundus"), "Fundus").alias("number"),
    )


@query
def extension_filter(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.select("page_id", paths.has_extension(F.col("url"), IMAGE_EXTENSIONS).alias("is_image"))


@query
def preview_samples(spark, folder):
    return first_samples(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id", 4)


# Images ----------------------------------------------------------------------


def _images(spark, folder):
    return views.small_images(spark, folder)


def _expression(spark, folder, make):
    """Apply a pixel expression to every image."""
    dims = [F.col(c) for c in ("height", "width", "channels")]
    return pixels_long(_images(spark, folder).select("vec_id", make(F.col("px"), *dims).alias("px")))


def _steps(spark, folder, steps):
    done = images.apply_steps(_images(spark, folder), steps, "vec_id", epoch=1, pixels="px")
    return pixels_long(done)


@query
def img_normalise(spark, folder):
    return _expression(spark, folder, lambda px, h, w, c: pixels.normalise(px, [0.485], [0.229], 1.0))


@query
def img_flip(spark, folder):
    """A seeded half of the images is mirrored."""
    go = unit_uniform(42, 1, F.col("vec_id"), F.lit("flip")) < 0.5
    return _expression(
        spark, folder, lambda px, h, w, c: F.when(go, pixels.flip_horizontal(px, h, w, c)).otherwise(px)
    )


@query
def img_flip_vertical(spark, folder):
    go = unit_uniform(42, 1, F.col("vec_id"), F.lit("vflip")) < 0.2
    return _expression(
        spark, folder, lambda px, h, w, c: F.when(go, pixels.flip_vertical(px, h, w, c)).otherwise(px)
    )


@query
def img_crop(spark, folder):
    """A 6 x 6 window at a seeded offset."""
    top, left = [
        F.floor(unit_uniform(42, 1, F.col("vec_id"), F.lit(t)) * 3).cast("int") for t in ("top", "left")
    ]
    return _expression(spark, folder, lambda px, h, w, c: pixels.crop(px, w, c, top, left, 6, 6))


@query
def img_chw(spark, folder):
    """The 64 values read as a 4 x 4 image of four channels, channels moved first."""
    return _expression(
        spark, folder, lambda px, h, w, c: pixels.to_channels_first(px, F.lit(4), F.lit(4), F.lit(4))
    )


@query
def img_denorm(spark, folder):
    return _expression(spark, folder, lambda px, h, w, c: pixels.denormalise(px))


@query
def img_min_max(spark, folder):
    return _expression(spark, folder, lambda px, h, w, c: pixels.min_max_scale(px))


@query
def img_brightness(spark, folder):
    contrast, bright = [
        (unit_uniform(42, 1, F.col("vec_id"), F.lit(t)) * 2 - 1) * 0.1 for t in ("contrast", "bright")
    ]
    return _expression(
        spark, folder, lambda px, h, w, c: pixels.brightness_contrast(px, contrast, bright, -1.0, 1.0)
    )


@query
def img_resize(spark, folder):
    return _steps(spark, folder, [images.resize(12, 10)])


@query
def img_rotate(spark, folder):
    return _steps(spark, folder, [images.rotate(15, 0.5)])


@query
def img_affine(spark, folder):
    return _steps(spark, folder, [images.shift_scale_rotate(0.05, 0.05, 10, 0.5)])


@query
def img_blur(spark, folder):
    return _steps(spark, folder, [images.gaussian_blur(0.2)])


@query
def paired_images(spark, folder):
    """Each image and the next one in id order, both normalised."""
    pairs = views.neighbour_ids(spark, folder)
    held = _images(spark, folder).withColumnRenamed("vec_id", "path")
    items = paired.paired_tensors(
        pairs, held, [images.normalise([0.5], [0.5], 1.0)], "vec_id", left="vec_id", right="next_id", pixels="px"
    )
    both = F.arrays_zip(F.col("left.px").alias("a"), F.col("right.px").alias("b"))
    rows = items.select("vec_id", F.posexplode(both).alias("pos", "p"))
    return rows.select("vec_id", "pos", r6("p.a").alias("a"), r6("p.b").alias("b"))


@query
def img_crop_flip(spark, folder):
    """Several steps in one pass: crop, mirror, normalise."""
    steps = [
        images.random_crop(6, 5),
        images.flip_horizontal(0.5),
        images.normalise([0.5], [0.5], 1.0),
    ]
    return _steps(spark, folder, steps)


def _recipe(spark, folder, steps, **how):
    done = images.apply_steps(views.colour_images(spark, folder), steps, "vec_id", epoch=1, pixels="px", **how)
    return pixels_long(done)


@query
def recipe_valid(spark, folder):
    return _recipe(spark, folder, images.valid_recipe(6))


@query
def recipe_train(spark, folder):
    return _recipe(spark, folder, images.train_recipe(8))


@query
def recipe_train_eight_bit(spark, folder):
    """Pixels rounded after every step, as 8-bit tools do."""
    return _recipe(spark, folder, images.train_recipe(8), eight_bit=True)


@query
def recipe_translation(spark, folder):
    """Enlarged by 30 pixels a side, then a window of 5 x 5."""
    return _recipe(spark, folder, images.translation_recipe(5))


@query
def recipe_two_stream(spark, folder):
    return _recipe(spark, folder, images.two_stream_train_recipe(5))


@query
def image_bytes_stretched(spark, folder):
    """Images as stored bytes, plain and min-max scaled."""
    unit = views.colour_images(spark, folder).withColumn("px", F.transform("px", lambda v: v / 200))
    plain = image_bytes(unit).select("vec_id", F.hex("data").alias("plain"))
    return plain.join(image_bytes(unit, stretch=True).select("vec_id", F.hex("data").alias("stretched")), "vec_id")


# Losses ----------------------------------------------------------------------


@query
def gan_losses(spark, folder):
    near = views.neighbours(spark, folder)
    half = lambda x: x / 2
    sample = near.select(
        "vec_id",
        F.col("a").alias("real_a"),
        F.col("b").alias("real_b"),
        F.reverse("a").alias("recov_a"),
        F.reverse("b").alias("recov_b"),
        F.transform("a", half).alias("same_a"),
        F.transform("b", half).alias("same_b"),
        F.col("b").alias("pred_fake_a"),
        F.col("a").alias("pred_fake_b"),
    )
    return rounded(
        summaries.generator_losses(sample).select(
            "vec_id", "total_loss", "loss_gan", "loss_cycle", "loss_identity"
        )
    )


@query
def disc_loss(spark, folder):
    near = views.neighbours(spark, folder)
    loss = arrays.discriminator_loss(F.col("a"), F.col("b"))
    return near.select("vec_id", r6(loss).alias("disc_loss"))


@query
def feature_fusion(spark, folder):
    near = views.neighbours(spark, folder)
    fused = near.select("vec_id", arrays.fuse(F.col("a"), F.col("b")).alias("px"))
    return pixels_long(fused)


# Run logs --------------------------------------------------------------------


def _events(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_id", "value")


@query
def best_so_far(spark, folder):
    return runlog.best_so_far(_events(spark, folder), "user_id", "event_id", "value")


@query
def best_so_far_min(spark, folder):
    return runlog.best_so_far(_events(spark, folder), "user_id", "event_id", "value", mode="min")


@query
def early_stop(spark, folder):
    return runlog.early_stop(_events(spark, folder), "user_id", "event_id", "value")


@query
def early_stop_delta(spark, folder):
    return runlog.early_stop(
        _events(spark, folder), "user_id", "event_id", "value", mode="min", delta=0.5, patience=4
    )


@query
def plateau_lr(spark, folder):
    return runlog.plateau_rate(_events(spark, folder), "user_id", "event_id", "value").withColumn(
        "rate", F.round("rate", 9)
    )


@query
def best_epoch(spark, folder):
    return runlog.best_epoch(_events(spark, folder), "user_id", "event_id", "value")


def _events_with_nan(spark, folder):
    """Every 7th event has NaN for its value."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _events(spark, folder).withColumn("value", value)


@query
def best_so_far_nan(spark, folder):
    rows = runlog.best_so_far(_events_with_nan(spark, folder), "user_id", "event_id", "value")
    return rows.drop("value")


@query
def early_stop_nan(spark, folder):
    return runlog.early_stop(_events_with_nan(spark, folder), "user_id", "event_id", "value")


@query
def early_stop_delta_nan(spark, folder):
    return runlog.early_stop(
        _events_with_nan(spark, folder), "user_id", "event_id", "value", mode="min", delta=0.5, patience=4
    )


@query
def plateau_nan(spark, folder):
    return runlog.plateau_rate(_events_with_nan(spark, folder), "user_id", "event_id", "value").withColumn(
        "rate", F.round("rate", 9)
    )


@query
def best_epoch_nan(spark, folder):
    return runlog.best_epoch(_events_with_nan(spark, folder), "user_id", "event_id", "value").drop("last_value")


@query
def index_range_cut(spark, folder):
    """Positions in buckets of 500 rows."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    return global_index(events, ["event_id"], rows_per_bucket=500)


@query
def running_sum_range_cut(spark, folder):
    scans = {"total": Scan("sum", F.col("cents")), "top": Scan("max", F.col("cents"))}
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    rows = table(spark, folder, "events").select("user_id", "event_id", cents)
    return prefix_scan(rows, ["user_id"], ["event_id"], scans, rows_per_bucket=500)


@query
def index_null_group(spark, folder):
    """A third of the rows have no group; they are a group of their own."""
    group = F.when(F.col("event_id") % 3 > 0, F.col("user_id"))
    rows = table(spark, folder, "events").select("event_id", group.alias("grp"))
    return global_index(rows, ["event_id"], group=["grp"], rows_per_bucket=500)


@query
def phase_by_epoch(spark, folder):
    placed = global_index(_events(spark, folder), ["event_id"], group=["user_id"], name="epoch")
    return runlog.with_phase(placed, "epoch", 5).select("user_id", "event_id", "epoch", "phase")


@query
def epoch_minutes(spark, folder):
    return rounded(runlog.minutes_per_run(table(spark, folder, "events"), "user_id", "ts"))


# Streams ---------------------------------------------------------------------


@query
def stream_incremental(spark, folder):
    """Events arriving as files, scored once each into a table."""
    schema = table(spark, folder, "events").schema
    stream = incremental.table_stream(spark, f"{folder}/events.parquet", schema)
    out, state = scratch_dir(spark, "increments"), scratch_dir(spark, "increments-state")
    shape = lambda df: df.select("event_id", "user_id", r6(F.col("value") / 100).alias("value"))
    incremental.run_pending(stream, shape, out, state)
    return spark.read.parquet(out)


@query
def stream_early_stop(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = incremental.table_stream(spark, f"{folder}/events.parquet", schema)
    out, state = scratch_dir(spark, "stops"), scratch_dir(spark, "stops-state")
    live.run_early_stop(stream, "user_id", "event_id", "value", out, state)
    return live.current_runs(spark, out).drop("last_epoch")


# Heads -----------------------------------------------------------------------


def _separable(spark, folder):
    """Vectors (a) beside a stream (b) that gives the class away, so that a sound
    fit must recover every label."""
    hint = F.transform(scoring.one_hot(F.col("label"), NUM_CLASSES), lambda x: x * F.lit(20.0))
    vectors = table(spark, folder, "embeddings")
    own = F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", "label", own.alias("a"), hint.alias("b")).withColumn("both", F.concat("a", "b"))


@query
def linear_head(spark, folder):
    rows = _separable(spark, folder)
    model = heads.fit_linear_head(rows, "both")
    return heads.score_head(model, rows, "both").select("vec_id", "label", "pred")


@query
def fusion_head(spark, folder):
    rows = _separable(spark, folder)
    model = heads.fit_fusion_head(rows, "a", "b", (VECTOR_WIDTH, NUM_CLASSES), NUM_CLASSES, hidden=64, iterations=60)
    return heads.score_fusion_head(model, rows, "a", "b").select("vec_id", "label", "pred")


@query
def cv_fit(spark, folder):
    folded = splits.stratified_folds(_separable(spark, folder), "label", "vec_id")
    preds = heads.cross_validated(folded, "both", 5)
    return rounded(summaries.cv_results(preds))
