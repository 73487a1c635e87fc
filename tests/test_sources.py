import pytest

from lumipair.operators import images
from lumipair.sources import bands, manifest, sinks


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_manifest_naming_rules(spark):
    files = names(
        spark, "img_1_c1.tif", "img_1_c2.tif", "a_c1.tif", "a_c2.tif", "xa_c1.tif", "xa_c2.tif", "folder", "img_1_c10.tif"
    )
    found = {(r.image_id, r.channel): r.name for r in manifest.manifest(files, 2).collect()}
    assert found == {
        ("img_1", 1): "img_1_c1.tif", ("img_1", 2): "img_1_c2.tif", ("a", 1): "a_c1.tif", ("a", 2): "a_c2.tif",
        ("xa", 1): "xa_c1.tif", ("xa", 2): "xa_c2.tif",
    }


def test_manifest_takes_first_name_in_order(spark):
    files = names(spark, "a_c1.tiff", "a_c1.tif", "a_c2.tif")
    found = {r.channel: (r.name, r.channel_name) for r in manifest.manifest(files, 2).collect()}
    assert found == {1: ("a_c1.tif", "channel_1"), 2: ("a_c2.tif", "channel_2")}


def test_manifest_validation(spark):
    with pytest.raises(ValueError, match="divided"):
        manifest.check_manifest(names(spark, "a_c1.tif", "a_c2.tif", "b_c1.tif"), 2)
    with pytest.raises(ValueError, match="no image"):
        manifest.check_manifest(names(spark, "folder"), 2)
    with pytest.raises(ValueError, match="image b has no file for channel 2"):
        manifest.check_manifest(names(spark, "a_c1.tif", "a_c2.tif", "b_c1.tif", "b_c3.tif"), 2)
    assert manifest.check_manifest(names(spark, "a_c1.tif", "a_c2.tif"), 2).count() == 2


def test_list_files_reads_names_only(spark, tmp_path):
    for name in ("img_1_c1.tif", "img_1_c2.tif"):
        (tmp_path / name).write_bytes(b"not an image")
    files = manifest.list_files(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["img_1_c1.tif", "img_1_c2.tif"]
    assert manifest.manifest(files, 2).filter("path like 'file:%img_1_c2.tif'").count() == 1


def test_bands_round_trip(spark, make_scanlines, planes_of, tmp_path):
    scanlines = make_scanlines({("sample", "a"): [[[1, 2, 3], [4, 5, None]], [[6, 7, 8], [9, 0, 1]]]})
    path = str(tmp_path / "bands")
    bands.to_bands(scanlines).write.parquet(path)
    read = bands.read_bands(spark, path)
    assert dict(read.dtypes)["values"] == "array<double>"
    again = bands.align_channels(read, [1, 2])
    assert again.columns == scanlines.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, scanlines.collect()))


def test_bands_from_pixels_fills_gaps(spark):
    px = spark.createDataFrame(
        [("sample", "a", 1, 0, 0, 1.0), ("sample", "a", 1, 0, 2, 3.0), ("sample", "a", 1, 1, 1, 5.0)],
        "condition string, image_id string, channel int, row int, col int, value double",
    )
    rows = {r.row: list(r["values"]) for r in bands.bands_from_pixels(px).collect()}
    assert rows == {0: [1.0, None, 3.0], 1: [None, 5.0, None]}


def test_stored_scanlines_carry_row_ranges(spark, make_scanlines, tmp_path):
    nan = float("nan")
    scanlines = make_scanlines({("sample", "a"): [[[1, nan, 3], [4, 5, None]]], ("control", "a"): [[[9, 9, 9], [8, None, 8]]]})
    path = str(tmp_path / "scanlines")
    bands.write_scanlines(scanlines, path)
    stored = bands.read_scanlines(spark, path)
    rows = {(r.condition, r.row): (r.lo_c1, r.hi_c1) for r in stored.collect()}
    assert rows == {("sample", 0): (1, 3), ("sample", 1): (4, 5), ("control", 0): (9, 9), ("control", 1): (8, 8)}
    ranges = images.value_range(stored)
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "lo_c1" in plan and "array<double>" not in plan
    assert sorted(map(tuple, ranges.collect())) == sorted(map(tuple, images.value_range(scanlines).collect()))
    with pytest.raises(Exception, match="(?i)already exists"):
        bands.write_scanlines(scanlines, path)


def test_shape_violations(spark, make_scanlines):
    good = make_scanlines({("sample", "a"): [[[1, 2], [3, 4]], [[1, 2], [3, 4]]]})
    assert bands.shape_violations(good).isEmpty()
    ragged = make_scanlines({("sample", "b"): [[[1, 2], [3, 4]], [[1, 2], [3]]]})
    short = make_scanlines({("sample", "c"): [[[1, 2], [3, 4]], [[1, 2], [3, 4]]]}).filter("row = 0")
    found = bands.shape_violations(good.unionByName(ragged).unionByName(short)).collect()
    assert sorted(r.image_id for r in found) == ["b", "c"]


def test_sinks(spark, tmp_path):
    samples = spark.createDataFrame(
        [(1, 2, "prior", 0, 0.5), (1, 2, "posterior", 0, 0.25)], "ch_x int, ch_y int, kind string, draw long, mu_sample double"
    )
    folder = str(tmp_path / "samples")
    sinks.write_samples(samples, folder)
    back = spark.read.option("header", True).option("inferSchema", True).csv(folder)
    assert {(r.kind, r.ch_x, r.mu_sample) for r in back.collect()} == {("prior", 1, 0.5), ("posterior", 1, 0.25)}
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_samples(samples, folder)
    line = spark.createDataFrame([(1, 2, 0.12345650, float("inf"))], "channel_1 int, channel_2 int, mean double, bf double")
    report = str(tmp_path / "report")
    sinks.append_report(line, report)
    sinks.append_report(line, report)
    text = spark.read.option("header", True).option("sep", "|").csv(report).collect()
    assert [(r.channel_1, r.mean, r.bf) for r in text] == [("1", "0.123456", "Infinity")] * 2
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_new(line, report)


def test_a_run_that_is_appended_again_replaces_its_lines(spark, tmp_path):
    folder = str(tmp_path / "report")
    for value, run in ((1.0, "a"), (2.0, "b"), (3.0, "a"), (3.0, "a"), (4.0, None), (5.0, None)):
        line = spark.createDataFrame([(1, value)], "channel_1 int, mean double")
        sinks.append_report(line, folder, run_id=run)
    back = spark.read.schema("channel_1 int, mean double").csv(folder, header=True, sep="|")
    assert sorted(r["mean"] for r in back.collect()) == [2.0, 3.0, 4.0, 5.0]
    assert {r.run for r in back.filter("mean < 4").collect()} == {"a", "b"}
    for bad in ("", "a/b", "../x", "a=b"):
        with pytest.raises(ValueError, match="run id"):
            sinks.append_report(line, folder, run_id=bad)


def test_image_table_and_stack(spark, make_scanlines):
    plane = [[1, 2], [3, 4], [5, 6]]
    scanlines = make_scanlines({("sample", k): [plane, plane] for k in ("b", "a", "c")})
    table = images.image_table(scanlines, names=["blue", "green"])
    rows = {(r.image_id, r.channel): (r.image_idx, r.channel_name, r.height, r.width) for r in table.collect()}
    assert rows[("a", 1)] == (1, "blue", 3, 2) and rows[("c", 2)] == (3, "green", 3, 2)
    assert images.image_table(scanlines).filter("channel_name = 'channel_2'").count() == 3
    with pytest.raises(ValueError):
        images.image_table(scanlines, names=["blue"])
    assert images.stack_lengths(scanlines).collect()[0].n_images == 3
    positioned = images.stack_positions(scanlines)
    assert {r.image_id for r in images.image_at(positioned, "sample", 2).collect()} == {"b"}
    with pytest.raises(IndexError):
        images.image_at(positioned, "sample", 4)


def _band_rows(spark, rows):
    return spark.createDataFrame(
        rows, "condition string, image_id string, channel int, row int, height int, width int, values array<double>"
    )


def test_bad_bands_are_refused_whatever_is_read(spark):
    good = [("sample", "a", c, r, 2, 2, [1.0, 2.0]) for c in (1, 2) for r in (0, 1)]
    aligned = bands.align_channels(_band_rows(spark, good), [1, 2])
    assert aligned.count() == 2 and aligned.filter("c1 is not null and c2 is not null").count() == 2
    wide = _band_rows(spark, [*good[:3], ("sample", "a", 2, 1, 2, 3, [1.0, 2.0, 3.0])])
    unsized = _band_rows(spark, [*good[:3], ("sample", "a", 2, 1, None, None, [1.0, 2.0])])
    for bad in (wide, _band_rows(spark, [*good, good[0]])):
        aligned = bands.align_channels(bad, [1, 2])
        with pytest.raises(Exception, match="differ in size|has a channel twice"):
            aligned.select("row", "c1", "c2").collect()
        with pytest.raises(Exception, match="differ in size|has a channel twice"):
            aligned.count()
    assert bands.align_channels(unsized.filter("row = 0"), [1, 2]).count() == 1
    with pytest.raises(Exception, match="differ in size"):
        bands.align_channels(unsized.filter("height is null"), [2]).count()
    partial = bands.align_channels(_band_rows(spark, good[:3]), [1, 2])
    assert [r.c2 for r in partial.orderBy("row").collect()] == [[1.0, 2.0], None]
    with pytest.raises(Exception, match=r"row 1 of image a lacks the channels \[2\]"):
        bands.align_channels(_band_rows(spark, good[:3]), [1, 2], complete=True).count()
    assert bands.align_channels(_band_rows(spark, good).limit(0), [1, 2], complete=True).isEmpty()


def test_stack_refuses_files_without_rows(spark):
    files = spark.createDataFrame([(f"a_x_c{c}.tif", f"/f/a_x_c{c}.tif") for c in (1, 2)], "name string, path string")
    rows = [(f"/f/a_x_c{c}.tif", 0, 1, 2, [1.0, float(c)]) for c in (1, 2)]
    schema = "path string, row int, height int, width int, values array<double>"
    stack = bands.stack_from_manifest(spark.createDataFrame(rows, schema), files, 2, "sample")
    assert [(r.c1, r.c2) for r in stack.collect()] == [([1.0, 1.0], [1.0, 2.0])]
    with pytest.raises(ValueError, match="no band rows for /f/a_x_c2.tif"):
        bands.stack_from_manifest(spark.createDataFrame(rows[:1], schema), files, 2, "sample")


def test_line_items_are_laid_out_from_runs_that_batches_cut(spark):
    from lumipair.sources import fixtures

    rows = [("sample", k, i // 5, 3, i % 5, float(i), None if i == 4 else -float(i)) for k in ("a", "b") for i in range(13)]
    placed = spark.createDataFrame(rows, "condition string, image_id string, row int, height int, col long, c1 double, c2 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        runs = fixtures._runs_of_rows(placed.coalesce(1), [1, 2]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 6 < len(runs) < len(rows)
    back = [(r.condition, r.image_id, r.row, r.height, r.col + k, x, y) for r in runs for k, (x, y) in enumerate(zip(r.c1, r.c2, strict=True))]
    assert back == rows


def test_draws_are_written_once_and_not_sorted(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from lumipair.plans import queries

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen, labels = spark.conf.get(name), [], []
    plain, keep = DataFrameWriter.csv, queries.written
    monkeypatch.setattr(DataFrameWriter, "csv", lambda w, *a, **k: seen.append(int(spark.conf.get(name))) or plain(w, *a, **k))
    monkeypatch.setattr(queries, "written", lambda df, label: labels.append(label) or keep(df, label))
    rows = queries.samples_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 12 and len({r.n for r in rows}) == 1
    assert seen == [64] and spark.conf.get(name) == before
    assert labels == ["draws"]


def test_only_runs_of_cut_rows_of_line_items_are_shuffled(spark, tmp_path):
    import numpy as np

    from lumipair.sources import fixtures

    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/lineitem.parquet").toPandas()
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "350")
    try:
        fixtures.ingest_lineitem(spark, sf, str(tmp_path / "lineitem"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stored = spark.read.parquet(str(tmp_path / "lineitem")).toPandas()
    # Rows of 100 items that no batch cuts are written at once; parts of the others stay beside the rows made of them.
    parts = stored[~stored["whole"]]
    cut = set(zip(parts["condition"], parts["image_id"], parts["row"]))
    rows = stored[stored["whole"]]
    assert 0 < len(cut) < len(rows) and not rows.duplicated(["condition", "image_id", "row"]).any()
    found = fixtures._whole_rows(spark, str(tmp_path / "lineitem")).orderBy("row").toPandas()
    assert len(found) == len(rows)
    for (status, flag), own in items.sort_values(order).groupby(["l_linestatus", "l_returnflag"]):
        image = found[(found["condition"] == ("sample" if status == "F" else "control")) & (found["image_id"] == flag)]
        assert image["row"].tolist() == list(range(-(-len(own) // 100))) and set(image["height"]) == {len(image)}
        for c, name in {1: "l_quantity", 2: "l_extendedprice", 3: "l_discount", 4: "l_tax"}.items():
            lines = np.full(100 * len(image), np.nan)
            lines[:len(own)] = own[name]
            np.testing.assert_array_equal(np.array([list(v) for v in image[f"c{c}"]], dtype=float).ravel(), lines)


def test_draws_of_all_pairs_are_written_once_and_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 400)
    drawn = spark.range(1000).selectExpr("id as draw", "rand(1) as mu_sample")
    prior = drawn.selectExpr("*", "'prior' as kind", "cast(null as int) as ch_x", "cast(null as int) as ch_y")
    posterior = drawn.selectExpr("draw", "0.25D as mu_sample", "'posterior' as kind", "1 as ch_x", "explode(array(2, 3)) as ch_y")
    folder = tmp_path / "samples"
    sinks.write_samples(prior.unionByName(posterior).coalesce(1), str(folder))
    files = list(folder.rglob("part-*"))
    # One file of 1000 draws holds at most 400 of them.
    assert len(files) == 9 and all(f.name.endswith(".csv.gz") for f in files)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "ch_x int, ch_y int")
    back = sinks.read_samples(spark, str(folder), "draw long, mu_sample double", pairs).collect()
    wanted = [(r.draw, r.mu_sample, "prior", 1, y) for r in drawn.collect() for y in (2, 3)]
    wanted += [(i, 0.25, "posterior", 1, y) for i in range(1000) for y in (2, 3)]
    assert sorted((r.draw, r.mu_sample, r.kind, r.ch_x, r.ch_y) for r in back) == sorted(wanted)
