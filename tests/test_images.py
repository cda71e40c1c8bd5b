"""Image sources, pixel expressions and pipelines on small real files."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from irisframe.config import AMD_CLASSES, IMAGENET_MEAN, IMAGENET_STD
from irisframe.functions import pixels
from irisframe.operators import images
from irisframe.sources import manifests, sinks
from irisframe.sources.pixels import first_samples, image_bytes, read_images
from tests.conftest import png


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    rng = np.random.default_rng(0)
    for split in ("train", "val", "test"):
        for c, name in enumerate((*AMD_CLASSES, "stray")):
            for i in range(4):
                px = rng.integers(0, 256, (3 + c, 4, 3)).tolist()
                png(root / split / name / f"{i}.png", px)
    (root / "train" / "amd" / "notes.txt").write_text("no image")
    (root / "train" / "amd" / "UPPER.PNG").write_bytes((root / "train" / "amd" / "0.png").read_bytes())
    return root


def test_manifest(spark, folder):
    got = manifests.scan_files(spark, str(folder / "train"))
    rows = got.collect()
    assert len(rows) == 20 and {r["class"] for r in rows} == {*AMD_CLASSES, "stray"}
    assert {r.folder for r in rows} == {"train"} and all(r.path.endswith(r["class"] + "/" + r.name) for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert manifests.scan_files(spark, str(folder / "train"), None).count() == 22


def test_split_sets_quarantine_unknown_classes(spark, folder):
    known, unknown = manifests.split_sets(spark, str(folder), AMD_CLASSES)
    counts = {(r.split, r.label): r["count"] for r in known.groupBy("split", "label").count().collect()}
    assert counts == {(s, k): 4 for s in ("train", "val", "test") for k in range(4)}
    assert unknown.count() == 12 and {r["class"] for r in unknown.collect()} == {"stray"}


def test_alphabetical_labels(spark, folder):
    rows = manifests.labelled_folder(spark, str(folder / "val")).select("class", "label").distinct().collect()
    assert {r["class"]: r.label for r in rows} == {n: i for i, n in enumerate(sorted((*AMD_CLASSES, "stray")))}


def test_domains(spark, tmp_path):
    for d, n in (("trainA", 3), ("trainB", 2), ("testA", 1)):
        for i in range(n):
            png(tmp_path / d / f"{i}.png", [[(i, i, i)]])
    got = manifests.domain_listing(spark, str(tmp_path)).groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in got} == {"A": 3, "B": 2}


def test_decode_to_rgb_and_quarantine(spark, tmp_path):
    png(tmp_path / "c" / "rgb.png", [[(0, 0, 200), (1, 2, 3)]])
    png(tmp_path / "c" / "gray.png", [[(7,), (9,)]], channels=1)
    png(tmp_path / "c" / "alpha.png", [[(10, 20, 30, 255), (4, 5, 6, 255)]], channels=4)
    (tmp_path / "c" / "broken.png").write_bytes(b"not an image")
    good, broken = read_images(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in good.collect()}
    assert bytes(rows["rgb.png"].data) == bytes([0, 0, 200, 1, 2, 3])
    assert bytes(rows["gray.png"].data) == bytes([7, 7, 7, 9, 9, 9])
    assert bytes(rows["alpha.png"].data) == bytes([10, 20, 30, 4, 5, 6])
    assert (rows["rgb.png"].height, rows["rgb.png"].width, rows["gray.png"].channels) == (1, 2, 3)
    assert [r.path.rsplit("/", 1)[1] for r in broken.collect()] == ["broken.png"]


def test_materialised_split(spark, folder, tmp_path):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(str(folder / "train"))
    out = str(tmp_path / "split")
    for _ in range(2):  # running again replaces, never duplicates
        sinks.materialise_split(files.select("path", "content"), out)
    table = spark.read.parquet(out)
    got = {(r["class"], r.split): r["count"] for r in table.groupBy("class", "split").count().collect()}
    assert got == {(c, s): n for c in (*AMD_CLASSES, "stray") for s, n in (("test", 1), ("val", 1), ("train", 2))}
    row = table.filter("split = 'test' AND class = 'amd'").first()
    with open(row.path.replace("file:", ""), "rb") as f:
        assert f.read() == bytes(row.content)


def test_report_sink(spark, tmp_path):
    sinks.write_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 3


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        h, w = int(rng.integers(5, 9)), int(rng.integers(5, 9))
        rows.append((i, h, w, 3, bytearray(rng.integers(0, 256, h * w * 3).astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, "id long, height int, width int, channels int, data binary").cache()


def arrays(df):
    return {r.id: np.array(r.px).reshape(r.height, r.width, r.channels) for r in df.collect()}


def originals(table):
    return {r.id: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3).astype(float) for r in table.collect()}


def test_expressions_match_numpy(spark, table):
    base = originals(table)
    df = table.select("id", "height", "width", "channels")
    px = spark.createDataFrame([(i, a.ravel().tolist()) for i, a in base.items()], "id long, px array<double>")
    df = df.join(px, "id")
    h, w, c = (F.col(n) for n in ("height", "width", "channels"))
    out = df.select(
        "id",
        pixels.flip_horizontal(F.col("px"), h, w, c).alias("fh"),
        pixels.flip_vertical(F.col("px"), h, w, c).alias("fv"),
        pixels.crop(F.col("px"), w, c, 1, 2, 3, 2).alias("cr"),
        pixels.to_channels_first(F.col("px"), h, w, c).alias("cf"),
        pixels.normalise(F.col("px"), IMAGENET_MEAN, IMAGENET_STD).alias("no"),
        pixels.min_max_scale(F.col("px")).alias("mm"),
    )
    for r in out.collect():
        a = base[r.id]
        assert np.array_equal(r.fh, a[:, ::-1].ravel())
        assert np.array_equal(r.fv, a[::-1].ravel())
        assert np.array_equal(r.cr, a[1:4, 2:4].ravel())
        assert np.array_equal(r.cf, a.transpose(2, 0, 1).ravel())
        assert np.allclose(r.no, ((a / 255 - IMAGENET_MEAN) / IMAGENET_STD).ravel())
        assert np.allclose(r.mm, ((a - a.min()) / (a.max() - a.min())).ravel())


def test_constant_image_scales_to_zero(spark):
    df = spark.createDataFrame([([4.0, 4.0],)], "px array<double>")
    assert df.select(pixels.min_max_scale(F.col("px"))).first()[0] == [0.0, 0.0]


def test_resize(table):
    got = arrays(images.apply_steps(table, [images.resize(4, 11)], "id"))
    for i, a in originals(table).items():
        h, w = a.shape[:2]
        for y in range(4):
            for x in range(11):
                sy = min(max((y + 0.5) * h / 4 - 0.5, 0), h - 1)
                sx = min(max((x + 0.5) * w / 11 - 0.5, 0), w - 1)
                y0, x0 = min(int(sy), h - 2), min(int(sx), w - 2)
                fy, fx = sy - y0, sx - x0
                want = (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy
                assert np.allclose(got[i][y, x], want, atol=1e-3)


def test_antialiased_halving_averages_the_neighbourhood(spark):
    row = [(1, 1, 4, 1, [0.0, 4.0, 8.0, 12.0])]
    df = spark.createDataFrame(row, "id int, height int, width int, channels int, px array<double>")
    got = images.apply_steps(df, [images.resize(1, 2, antialias=True)], "id", pixels="px").first()
    # Triangle weights of reach 2 around 0.5 and 2.5, cut at the border.
    want = [(0 * 0.75 + 4 * 0.75 + 8 * 0.25) / 1.75, (4 * 0.25 + 8 * 0.75 + 12 * 0.75) / 1.75]
    assert got.px == pytest.approx(want)


def test_turns_and_shifts(spark):
    a = np.arange(9.0).reshape(3, 3, 1)
    quarter = images._warp(a, images._rotation(90), "zero", False)
    assert np.allclose(quarter[..., 0], np.rot90(a[..., 0]))
    moved = images._warp(a, images._rotation(0, 1, (1, 0)), "zero", False)
    assert np.allclose(moved[..., 0], [[0, 0, 1], [0, 3, 4], [0, 6, 7]])
    mirrored = images._warp(a, images._rotation(0, 1, (1, 0)), "reflect", False)
    assert np.allclose(mirrored[..., 0], [[1, 0, 1], [4, 3, 4], [7, 6, 7]])
    twice = images._warp(np.ones((5, 5, 1)), images._rotation(0, 0.5), "zero", False)
    assert twice[2, 2, 0] == 1 and twice[0, 0, 0] == 0


def test_blur_keeps_a_constant_and_spreads_a_point(spark):
    step = images.gaussian_blur(1.0)
    assert np.allclose(step.kernel(np.full((4, 5, 3), 7.0), []), 7)
    point = np.zeros((5, 5, 1))
    point[2, 2] = 16
    assert np.allclose(step.kernel(point, [])[1:4, 1:4, 0], [[1, 2, 1], [2, 4, 2], [1, 2, 1]])


@pytest.mark.parametrize("recipe", ["train", "valid", "gan", "translation", "unpaired", "two_stream_train", "two_stream_test"])
def test_recipes_are_deterministic(table, recipe):
    steps = getattr(images, f"{recipe}_recipe")(16)
    first = images.apply_steps(table, steps, "id", epoch=3)
    rows = arrays(first)
    assert all(a.shape == (16, 16, 3) and np.isfinite(a).all() for a in rows.values())
    again = arrays(images.apply_steps(table.repartition(7), steps, "id", epoch=3))
    assert all(np.array_equal(rows[i], again[i]) for i in rows)
    later = arrays(images.apply_steps(table, steps, "id", epoch=4))
    changed = any(not np.array_equal(rows[i], later[i]) for i in rows)
    assert changed == (recipe in ("train", "translation", "two_stream_train"))


def test_valid_recipe_is_channel_first_and_normalised(table):
    rows = images.apply_steps(table, images.valid_recipe(6), "id").collect()
    resized = arrays(images.apply_steps(table, [images.resize(6, 6)], "id"))
    for r in rows:
        want = ((resized[r.id] / 255 - IMAGENET_MEAN) / IMAGENET_STD).transpose(2, 0, 1)
        assert np.allclose(r.px, want.ravel(), atol=1e-4)


def test_flip_chance_is_respected(table):
    rows = arrays(images.apply_steps(table, [images.flip_horizontal(0.5)], "id"))
    base = originals(table)
    flips = sum(np.array_equal(rows[i], base[i][:, ::-1]) for i in base)
    stays = sum(np.array_equal(rows[i], base[i]) for i in base)
    assert flips + stays == 40 and 8 < flips < 32


def test_image_bytes(spark):
    df = spark.createDataFrame([(2, [0.0, 0.5, 1.0, 1.5]), (1, [-1.0, 0.0, 1.0, 3.0])], "id int, px array<double>")
    plain = {r.id: list(bytes(r.data)) for r in image_bytes(df).collect()}
    assert plain == {2: [0, 128, 255, 255], 1: [0, 0, 255, 255]}
    wide = {r.id: list(bytes(r.data)) for r in image_bytes(df, stretch=True).collect()}
    assert wide[1] == [0, 64, 128, 255]
    assert [r.id for r in first_samples(df, "id", 1).collect()] == [1]


def test_images_too_small_for_a_crop_are_named(spark):
    rows = [(i, h, w, 1, [float(v) for v in range(h * w)]) for i, (h, w) in enumerate([(4, 4), (6, 5), (6, 4), (8, 9)])]
    df = spark.createDataFrame(rows, "id long, height int, width int, channels int, data array<double>")
    steps = [images.random_crop(6, 5)]
    assert {r.id for r in images.apply_steps(df, steps, "id").collect()} == {1, 3}
    assert {(r.id, r.reason) for r in images.rejected_images(df, steps).collect()} == {(0, "too small for random_crop"), (2, "too small for random_crop")}
    # The size that counts is the one at the step's place.
    grown = [images.resize(9, 9), images.random_crop(6, 5), images.random_crop(6, 6)]
    assert images.apply_steps(df, grown[:2], "id").count() == 4 and images.apply_steps(df, grown, "id").count() == 0


def test_eight_bit_steps_round_in_between(spark):
    df = spark.createDataFrame([(1, 2, 2, 1, [0.0, 10.0, 251.0, 7.0])], "id long, height int, width int, channels int, data array<double>")
    steps = [images.resize(3, 3), images.resize(2, 2)]
    (plain,), (whole,) = (images.apply_steps(df, steps, "id", eight_bit=e).collect() for e in (False, True))
    assert all(v == int(v) and 0 <= v <= 255 for v in whole.px) and any(v != int(v) for v in plain.px)
    assert max(abs(a - b) for a, b in zip(plain.px, whole.px)) < 1.5


def test_bytes_of_odd_tensors(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0.5, None, float("nan")]), (4, [2.0, -1.0])], "id long, px array<double>")
    for stretch in (False, True):
        got = {r.id: r.data for r in image_bytes(df, stretch=stretch).collect()}
        assert got[1] is None and got[2] == b"" and len(got[3]) == 3 and got[4] == b"\xff\x00"
