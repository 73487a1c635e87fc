import numpy as np

from lumipair.llm import language, quality_classifier
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, quality int, score string, words string"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op5_language"](spark, SF).join(docs, "doc_id").toPandas()
    held_out = got[got.held_out]
    assert len(got) == docs.count() and 0 < len(held_out) < len(got)
    assert (held_out.lang == held_out.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame(
        [(i, t, g, 1, None, None) for i, (t, g) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("la casa y el jardin", "es"), ("la maison et le jardin", "fr")] * 8)]
        + [(900, "one only", "xx", 1, None, None), (901, None, "en", 1, None, None), (902, "no label", None, 1, None, None)], SCHEMA)
    model = language.fit(train)
    assert sorted(x for f in model.families.values() for x in f) == ["de", "en", "es", "fr", "xx"]
    assert model.predict("one only")[0] == "xx"
    docs = spark.createDataFrame([(1, None, None, None, None, None), (2, "", None, None, None, None), (3, "123 !?", None, None, None, None), (4, "the garden " * 20_000, None, None, None, None), (5, "und das haus", None, None, None, None), (5, "und das haus", None, None, None, None), (None, "el jardin", None, None, None, None)], SCHEMA)
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.predict(docs, model).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("5", "de"), ("5", "de"), ("None", "es")]
    nothing = language.fit(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], SCHEMA), model).count() == 0
    single = language.fit(train.filter("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs.filter("doc_id = 4"), single).collect()} == {("en", 1.0)}


def slow_cells(text):
    """Cells of a text from its trigrams, one by one."""
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in f"  {text.lower()}  ".encode()]
    counts = {}
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if b != 32:
            cell = (a + 256 * b + 65536 * c) * 2654435761 % 2**32 >> 20
            counts[cell] = counts.get(cell, 0) + 1
    length = sum(counts.values()) ** 0.5
    return {cell: n**0.5 / max(1e-9, length) for cell, n in counts.items()}


def test_language_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {-1: "", -2: "12", -3: "\u0130\u00e9 \u4e2d\u6587", -4: "a" * 100_000}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}

    def margin(machine, cells):
        return sum(machine.weights[c] * v for c, v in cells.items()) + machine.bias

    for i, text in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        cells = slow_cells(text)
        best = sorted(((margin(m, cells), f) for f, m in model.family_machines.items()), reverse=True)
        members = model.families[best[0][1]]
        duels = {lang: [] for lang in members}
        for (a, b), machine in model.pair_machines.items():
            if a in duels:
                duels[a].append(margin(machine, cells))
                duels[b].append(-duels[a][-1])
        lang = max(members, key=lambda x: (sum(m > 0 for m in duels[x]), sum(duels[x])))
        score = 1 / (1 + np.exp(-2 * (best[0][0] - best[1][0])))
        if duels[lang]:
            score /= 1 + np.exp(-4 * min(duels[lang]))
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9


def test_language_sample_is_bounded_whatever_is_repeated(spark):
    rows = [(None, "hot text", "en")] * 3000 + [(None, f"some text {i} ende", "en") for i in range(1500)] + [(7, f"ein text {i}", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {r.lang: r["count"] for r in language.chosen_texts(docs, 100).groupBy("lang").count().collect()}
    assert 50 < counts["en"] < 160 and counts["de"] == 20
    assert language.chosen_texts(docs, 10_000).count() == 1521


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op9_quality_classifier"](spark, SF).join(labels, "doc_id").toPandas()
    held_out = got[got.held_out]
    good, bad = held_out[held_out.quality == 1].score.values, held_out[held_out.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (held_out.predicted == held_out.quality).mean() > 0.93
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_ranking_follows_preferences():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, len(quality_classifier.FEATURES)))
    quality = (rows[:, 2] - rows[:, 5] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    model = quality_classifier.fit_pairs(rows, quality, pairs=5000)
    raw = ((rows - model.mean) / model.spread) @ model.weights
    assert ((raw >= model.cut) == (quality == 1)).mean() > 0.95


def test_pair_loss_is_least_at_the_weights():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, len(quality_classifier.FEATURES)))
    quality = (rows[:, 1] + rng.normal(size=60) > 0).astype(int)
    model = quality_classifier.fit_pairs(rows, quality, pairs=400)
    first, second = quality_classifier.drawn_pairs(np.flatnonzero(quality == 1), np.flatnonzero(quality == 0), 400)
    unit = (rows - model.mean) / model.spread

    def loss(weights):
        parts = [np.log1p(np.exp(-sum(w * (x - y) for w, x, y in zip(weights, unit[a], unit[b], strict=True)))) for a, b in zip(first, second, strict=True)]
        return sum(parts) / 400 + 0.0005 * sum(w * w for w in weights)

    least = loss(model.weights)
    for k in range(0, len(model.weights), 3):
        for step in (0.05, -0.05):
            other = model.weights.copy()
            other[k] += step
            assert loss(other) > least


def slow_features(text):
    """Surface features of a text in plain Python."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, lengths = max(1, len(words)), [len(w) for w in words]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    letters = max(1, sum(65 <= b < 91 or 97 <= b < 123 or b >= 192 for b in raw))
    shares = [raw.count(bytes([b])) / len(raw) for b in set(raw)]
    mean = sum(lengths) / n

    def per_word(chars):
        return np.log(1 + 10 * sum(raw.count(bytes([c])) for c in chars) / n)

    return [
        np.log(1 + len(words)), mean, len(set(words)) / n, max((words.count(w) for w in words), default=0) / n,
        sum(words[i] == words[i - 1] for i in range(1, len(words))) / n, per_word(b"#*$%&<>"), per_word(b"|"), per_word(b"!"),
        sum(65 <= b < 91 for b in raw) / letters, sum(48 <= b < 58 for b in raw) / max(1, len(raw)), per_word(b".,;:?"),
        1 - len(set(lines)) / max(1, len(lines)), len(covered) / n,
        (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5, np.log(1 + len(words) / max(1, len(lines))), -sum(p * np.log2(p) for p in shares),
    ]


def test_features_and_scores_match_brute_force(spark):
    texts = ["", " ", "one", "a b c d e f g h " * 3 + "end.", "Line one!\nLine one!\n\n| x | 12 % |", "\u0130\u00e9 \u4e2d \n\n", "UPPER lower 123 <b> & # * $"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = quality_classifier.described(docs)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(table, labels)
    assert sorted((r.doc_id, r.quality) for r in quality_classifier.chosen_rows(table, labels).collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 0), (4, 1)]
    for r in table.withColumn("s", model.score()).collect():
        want = slow_features(texts[r.doc_id])
        assert np.allclose([r[f] for f in quality_classifier.FEATURES], want, atol=1e-12)
        raw = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, want, model.mean, model.spread, strict=True))
        assert abs(r.s - 1 / (1 + np.exp(-np.clip((raw - model.cut) / model.width, -30, 30)))) < 1e-9


def test_quality_sample_is_bounded_whatever_is_repeated(spark):
    columns = [f"double(id % {k + 2}) as `{f}`" for k, f in enumerate(quality_classifier.FEATURES)]
    table = spark.range(6000).selectExpr("if(id < 3000, 1, id) doc_id", *columns)
    table = table.unionByName(table)
    labels = spark.range(6000).selectExpr("id doc_id", "int(id % 2) quality").unionByName(spark.range(500).selectExpr("1L doc_id", "1 quality"))
    assert 100 < quality_classifier.chosen_rows(table, labels, 200).count() < 320
    assert quality_classifier.chosen_rows(table, labels, 10_000).count() == 6000


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, None, None, "a", "b"), (2, "", None, None, "a", "b"), (3, "x " * 100_000, None, None, "a", "b"), (3, "x " * 100_000, None, None, "a", "b"), (None, "no id", None, None, "a", "b")], SCHEMA)
    table = quality_classifier.described(docs)
    labels = spark.createDataFrame([(3, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(table, labels)
    assert [r.s for r in table.select(model.score().alias("s")).collect()] == [0.5] * 5
    model = quality_classifier.fit(table, spark.createDataFrame([(3, 0), (3, 0), (2, 1)], "doc_id long, quality int"))
    got = table.select("doc_id", model.score().alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if r.doc_id == 3}) == 1
    assert got[0].s == got[1].s > got[2].s
    assert quality_classifier.described(spark.createDataFrame([], SCHEMA)).count() == 0
