import random
import re

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.sql import functions as F

from caseloom.operators import boost as B
from caseloom.operators import classify as C
from caseloom.operators import cluster as K
from caseloom.operators import forest as G
from caseloom.operators.features import any_per_entity, encode_labels, entity_features, label_decode, label_encode, sparse_counts, sparse_vectors
from caseloom.plans import learning
from caseloom.sources import load_model, save_model


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(0)
    rows = []
    for i in range(240):
        c = i % 3
        rows.append((i, 10 * c + rng.gauss(0, 1), -5 * c + rng.gauss(0, 1), 5 + rng.random(), f"m{c}", c == 1))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, model string, flag boolean").cache()


COLS = ["a", "b", "c"]


def test_variance_sums_to_one_and_matches_numpy(spark, blobs):
    rows = K.pca_variance(blobs, COLS).orderBy("component").collect()
    x = np.array([[r[c] for c in COLS] for r in blobs.collect()])
    x = x / np.abs(x).max(axis=0)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["explained"] for r in rows] == pytest.approx(list(want / want.sum()))
    assert rows[-1]["cumulative"] == pytest.approx(1.0)


def test_clusters_found_saved_and_described(spark, blobs, tmp_path):
    fitted = K.fit_clusters(blobs, COLS, ks=range(2, 5))
    assert fitted.k == 3
    path = save_model(fitted.model, str(tmp_path / "model"))
    first = K.predict_clusters(fitted.model, blobs).collect()
    again = K.predict_clusters(load_model(path), blobs).collect()
    assert first == again
    assert len({(r["model"], r["cluster"]) for r in first}) == 3
    top = K.top_loadings(fitted.loadings, 2)
    assert top.groupBy("component").count().filter("count != 2").count() == 0
    tables = K.describe_clusters(
        K.predict_clusters(fitted.model, blobs), COLS, "a", {"a": 5.0}, ("a", "b"), ["model"], {"outcome": ["a", "c"]}
    )
    assert tables["counts_model"].agg(F.sum("n")).first()[0] == 240
    assert tables["box"].count() == 3
    assert tables["projection"].columns[-2:] == ["pc1", "pc2"]


def test_missing_model_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing-here"):
        load_model(str(tmp_path / "nothing-here"))


def test_sample_silhouette_mean_is_the_evaluators(spark, blobs):
    df = K.assemble(blobs.withColumn("cluster", (F.col("id") % 4).cast("int")), COLS)
    ours = K.sample_silhouette(df, K.FEATURES, "cluster").agg(F.avg("silhouette")).first()[0]
    judge = ClusteringEvaluator(featuresCol=K.FEATURES, predictionCol="cluster")
    assert ours == pytest.approx(judge.evaluate(df))


def test_sample_silhouette_takes_any_number_of_clusters(spark):
    n = 1_100
    rows = spark.range(2 * n).select((F.col("id") % n).alias("cluster"), (F.col("id") % n * 10 + F.col("id") % 2).cast("double").alias("a"))
    alone = spark.createDataFrame([(None, 1.0), (n + 1, -500.0)], "cluster long, a double")
    found = K.sample_silhouette(K.assemble(rows.unionByName(alone), ["a"]), K.FEATURES, "cluster")
    assert found.filter("silhouette > 0.9").count() == 2 * n
    assert [r.silhouette for r in found.filter(f"cluster IS NULL OR cluster > {n}").collect()] == [0.0, 0.0]


def test_projection_is_centred(spark, blobs):
    means = K.project(blobs, COLS).agg(F.avg("pc1"), F.avg("pc2")).first()
    assert list(means) == pytest.approx([0.0, 0.0], abs=1e-9)


def test_split_is_stable_under_repartition(spark, blobs):
    train, test = C.hash_split(blobs, "id")
    again, _ = C.hash_split(blobs.repartition(7), "id")
    assert sorted(r["id"] for r in train.collect()) == sorted(r["id"] for r in again.collect())
    assert train.count() + test.count() == 240
    assert 140 < train.count() < 196


def test_modes_and_one_hot(spark):
    train = spark.createDataFrame([("x",), ("x",), ("y",), (None,), ("it's, so",)], "c string")
    assert C.modes(train, ["c"]).first()["mode"] == "x"
    assert C.modes(spark.createDataFrame([("b",), ("a",)], "c string"), ["c"]).first()["mode"] == "a"
    df = spark.createDataFrame([("x",), ("y",), (None,), ("unseen",)], "c string")
    got = [r["encoded"] for r in C.one_hot(df, train, ["c"]).collect()]
    assert got == [[0, 1, 0], [0, 0, 1], [0, 1, 0], [0, 0, 0]]


def test_forest_and_report(spark, blobs):
    train, test = C.hash_split(blobs.withColumn("odd.name", F.col("c")), "id")
    model = C.fit_forest(train, "flag", ["model"], ["a", "b"], {"numTrees": [5], "maxDepth": [3]}, folds=2)
    scored = C.score(model, test, "flag", ["id"]).cache()
    assert C.roc_auc(scored, "score", "label").first()[0] == pytest.approx(1.0)
    report = {r["class"]: r for r in C.classification_report(scored, "label", "prediction").collect()}
    assert report[1]["f1"] == 1.0 and report[0]["support"] + report[1]["support"] == test.count()
    names = [r["feature"] for r in C.importances(model, blobs, ["model"], ["a", "b"]).collect()]
    assert sorted(names) == ["a", "b", "model=m0", "model=m1", "model=m2"]


def test_boosted(spark, blobs):
    model = C.fit_boosted(blobs, "flag", COLS, {"maxIter": [3], "maxDepth": [2]}, folds=2)
    assert C.roc_auc(C.score(model, blobs, "flag"), "score", "label").first()[0] > 0.98
    assert C.importances(model, blobs).count() == 3


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((a, b, c, float(a * b + 0.5 * c + rng.gauss(0, 0.6) > 0), i % 3))
    df = spark.createDataFrame(rows, "a double, b double, c double, _label double, _fold int")
    return C.VectorAssembler(inputCols=COLS, outputCol=C.FEATURES).transform(df).repartition(3).cache()


@pytest.mark.parametrize("slice_rows", [10**6, 300])
def test_runs_side_by_side_are_the_boosted_trees_of_spark(folded, monkeypatch, slice_rows):
    monkeypatch.setattr(B, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    settings = [{"maxDepth": 2, "stepSize": 0.3}, {"maxDepth": 4, "featureSubsetStrategy": "0.9"}]
    got = B.boosted_accuracy(folded, C.FEATURES, C.LABEL, settings, [5, 2], 3)
    assert len(got) == 6
    for (at, fold), found in got.items():
        fitted = C.GBTClassifier(labelCol=C.LABEL, featuresCol=C.FEATURES, seed=42, maxIter=5, **settings[at])
        model = fitted.fit(folded.filter(F.col("_fold") != fold))
        assert found == pytest.approx(C.staged_accuracy(model, folded.filter(F.col("_fold") == fold), [5, 2]))


def test_rows_walk_to_their_leaves_in_large_slices():
    dice = np.random.default_rng(0)
    bins = dice.integers(0, 32, (5, 20_000)).astype(np.int16)
    feature = np.array([[4, 3, -1, 2, 1, -1, -1]], np.int16)
    trees = B.Trees(feature, np.array([[9, 20, 0, 5, 17, 0, 0]], np.int16), np.zeros((1, 15)))
    want = []
    for row in bins.T:
        node = 0
        for _ in range(2):
            if feature[0, node] >= 0:
                node = 2 * node + 1 + int(row[feature[0, node]] > trees.bin[0, node])
        want.append(node)
    assert B.leaves(trees, bins, 2)[0].tolist() == want


def test_runs_side_by_side_draw_rows_and_features(folded):
    whole = {"maxDepth": 3, "stepSize": 0.3}
    settings = [whole, {**whole, "subsamplingRate": 0.6}, {**whole, "featureSubsetStrategy": "0.6"}, {**whole, "featureSubsetStrategy": "0.8"}]
    got = B.boosted_accuracy(folded, C.FEATURES, C.LABEL, settings, [6], 3)
    assert got == B.boosted_accuracy(folded, C.FEATURES, C.LABEL, settings, [6], 3)
    shares = [[got[at, fold][0] for fold in range(3)] for at in range(4)]
    assert shares[0] == shares[3] and shares[1] != shares[0] != shares[2]
    assert all(min(of) > 0.65 for of in shares)
    assert [B.features_per_node(of, 10) for of in ("0.6", "1.0", "all", "sqrt", "log2", "onethird", "3", "20")] == [6, 10, 10, 4, 4, 4, 3, 10]


def test_boosted_search_fits_the_chosen_setting_only(spark, blobs, monkeypatch):
    fits = []
    fit = C.GBTClassifier._fit
    monkeypatch.setattr(C.GBTClassifier, "_fit", lambda self, df: fits.append(self.getMaxDepth()) or fit(self, df))
    C.fit_boosted(blobs, "flag", COLS, {"maxIter": [2, 3], "maxDepth": [2, 3], "subsamplingRate": [0.6, 1.0]}, folds=2)
    assert len(fits) == 1
    # Parameters that the runs do not know are searched by Spark ML's own fits.
    C.fit_boosted(blobs, "flag", COLS, {"maxIter": [2], "minInstancesPerNode": [1, 2]}, folds=2)
    assert len(fits) == 1 + 4 + 1


@pytest.mark.parametrize("limit", [10**6, 5])
def test_roc_against_evaluator(spark, limit):
    rng = random.Random(6)
    rows = [(round(rng.random(), 1 if i % 2 else 3), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    ours = C.roc_auc(df, "score", "label", max_group_rows=limit).first()[0]
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert ours == pytest.approx(judge.evaluate(df.withColumn("label", F.col("label").cast("double"))))
    curve = C.roc_curve(df, "score", "label", max_group_rows=limit).orderBy(F.desc("threshold")).collect()
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)
    assert [r["tpr"] for r in curve] == sorted(r["tpr"] for r in curve)


def test_report_with_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in C.classification_report(df, "label", "prediction").collect()}
    assert got[0] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert got[1] == (0.0, 0.0, 0.0, 1)


def test_labels_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "m string")
    coded, model = label_encode(df, "m", "code", missing="none")
    assert {(r["m"], r["code"]) for r in coded.collect()} == {("a", 0), ("b", 1), ("none", 2)}
    back = label_decode(coded.drop("m"), "code", "m", model).collect()
    assert {(r["m"], r["code"]) for r in back} == {("a", 0), ("b", 1), ("none", 2)}


def test_features_keep_the_places_of_the_model(spark):
    now = spark.createDataFrame([("v", "m", 1, 2.0, 3)], ["Vehicle", "Modellreihe", "new: level", "calls", "old: level"])
    now = now.withColumnRenamed("Vehicle", learning.ENTITY)
    found = learning.align(now, ["calls", "gone: level", "old: level"])
    assert found.columns == [learning.ENTITY, "Modellreihe", "calls", "gone: level", "old: level"]
    assert tuple(found.first()) == ("v", "m", 2.0, 0.0, 3)


def test_any_number_of_labels(spark):
    n = 10_005
    df = spark.range(n).select(F.col("id"), F.format_string("l%06d", "id").alias("code")).repartition(7)
    coded, codes = label_encode(df, "code", "number")
    assert codes.count() == n and coded.filter("id = number").count() == n
    back = label_decode(coded.select("id", "number"), "number", "code", codes)
    assert back.filter(F.col("code") == F.format_string("l%06d", "id")).count() == n
    assert label_encode(df.limit(0), "code", "number")[0].count() == 0


def test_entity_features(spark):
    calls = spark.createDataFrame(
        [
            ("v", 1, 1.0, None, True, False, "2019-05-01", "Towing", 7, False),
            ("v", 2, 2.0, 10, False, True, "2018-01-01", "Towing", 8, True),
            ("v", 3, None, 2, None, True, None, "Cancelled", 9, False),
            ("w", 4, None, None, False, False, None, None, 1, False),
            (None, 5, 1.0, 1, True, True, None, "Towing", 1, True),
        ],
        "k string, at int, days double, gap int, s1 boolean, s2 boolean, reg string, outcome string, code int, sus boolean",
    ).withColumn("reg", F.col("reg").cast("date"))
    repairs = spark.createDataFrame([("v", 1, "x"), ("v", 2, "x"), ("v", 3, None)], "k string, line int, stay string")
    out = entity_features(
        calls, repairs, "k", "at", "gap", {"days": "days"}, ["s1", "s2"], "reg", {"code": "code", "sus": "sus"},
        {"outcome": ["Towing", "Cancelled"]}, "line", "stay", ["at"],
    )
    got = {r["k"]: r.asDict() for r in out.collect()}
    assert set(got) == {"v", "w"}
    v = got["v"]
    assert (v["calls"], v["mean_gap"], v["days"], v["services"], v["first_year"]) == (3, 4.0, 3.0, 3, 2018)
    assert (v["outcome: Towing"], v["outcome: Cancelled"], v["repairs"], v["stays"]) == (2, 1, 3, 1)
    assert (v["code"], v["sus"]) == (8, True)
    assert (got["w"]["first_year"], got["w"]["repairs"], got["w"]["days"]) == (0, 0, 0.0)
    assert {r["k"]: r["s"] for r in any_per_entity(calls, "k", "sus", "s").collect()} == {"v": True, "w": False}


@pytest.mark.parametrize(("name", "grid"), [("rf_cv", C.FOREST_GRID), ("importances", C.FOREST_GRID), ("gbt_cv", C.BOOST_GRID)])
def test_registered_searches_are_whole(spark, monkeypatch, name, grid):
    from catalog import learning

    class Asked(Exception):
        pass

    def search(train, stages, make, size, grid, folds, *rest):
        raise Asked(dict(grid), folds)

    monkeypatch.setattr(learning, "_FORESTS", {})
    monkeypatch.setattr(C, "_search", search)
    with pytest.raises(Asked) as asked:
        getattr(learning, name)(spark, "/root/testdata/sf0.001")
    assert asked.value.args == (grid, 5)


def test_no_text_is_joined_with_labels(spark, monkeypatch):
    from catalog import learning

    written, write = [], learning.S.write_table
    monkeypatch.setattr(learning.S, "write_table", lambda df, path: written.append(df) or write(df, path))
    found = learning._document_features(spark, "/root/testdata/sf0.001")
    plan = written[0]._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "n_words" in plan.output().toString() and "text" not in plan.output().toString()
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    counted = {r["doc_id"]: (len(re.split(r"[ \t\n\x0b\f\r]+", r["text"])), r["text"].count("\n") + 1) for r in documents.collect()}
    assert {r["doc_id"]: (r["n_words"], r["n_lines"]) for r in found.collect()} == {r["doc_id"]: counted[r["doc_id"]] for r in labels.collect()}


def test_saved_codes_stay(spark, tmp_path):
    rows = [("v1", "golf"), ("v2", "up"), ("v3", None)]
    df = spark.createDataFrame(rows, "id string, m string")
    coded, codes = label_encode(df, "m", "code", missing="none")
    codes.write.parquet(f"{tmp_path}/codes")
    before = {r["id"]: r["code"] for r in coded.collect()}
    more = df.unionByName(spark.createDataFrame([("v4", "amarok"), ("v5", "zoe")], "id string, m string"))
    after = {r["id"]: r["code"] for r in encode_labels(more, "m", "code", spark.read.parquet(f"{tmp_path}/codes"), "none").collect()}
    assert after == before | {"v4": 3, "v5": 3}
    assert encode_labels(df, "m", "code", codes).filter("m IS NULL").first()["code"] == 3


def test_sparse_counts_of_any_width(spark):
    n = 20_000
    df = spark.range(3 * n).select((F.col("id") % 7).alias("k"), F.format_string("l%05d", F.col("id") % n).alias("level"))
    counts, codes = sparse_counts(df, "k", "level")
    vectors = {r["k"]: r["v"] for r in sparse_vectors(counts, "k", codes, "v").collect()}
    assert len(vectors) == 7 and all(v.size == n + 1 for v in vectors.values())
    assert sum(v.values.sum() for v in vectors.values()) == 3 * n
    assert vectors[3][3] == 1.0 and vectors[3][n] == 0.0
    # Levels that the codes lack meet in the last place; rows without a level or entity count for nothing.
    odd = spark.createDataFrame([(1, "l00001"), (1, "x"), (1, "y"), (1, None), (None, "x")], "k long, level string")
    again, _ = sparse_counts(odd, "k", "level", codes)
    assert tuple(again.first()) == (1, [1, n], [1, 2])


def test_staged_accuracy_is_that_of_smaller_ensembles(spark, blobs):
    from pyspark.ml.classification import GBTClassifier

    rows = K.assemble(blobs.withColumn(C.LABEL, F.col("flag").cast("double")), COLS).select(F.col(K.FEATURES).alias(C.FEATURES), C.LABEL).cache()
    make = lambda n: GBTClassifier(labelCol=C.LABEL, featuresCol=C.FEATURES, seed=1, maxIter=n, maxDepth=1, subsamplingRate=0.6).fit(rows)
    alone = [make(n).transform(rows).filter(F.col("prediction") == F.col(C.LABEL)).count() / rows.count() for n in (1, 4)]
    assert C.staged_accuracy(make(4), rows, [4, 1]) == pytest.approx(alone[::-1])


def test_cut_forests_are_those_fitted_by_themselves(spark, blobs):
    from pyspark.ml.classification import RandomForestClassifier

    named = blobs.withColumn(C.LABEL, (F.col("flag") != (F.rand(2) < 0.1)).cast("double"))
    rows = C.Pipeline(stages=C.preparation(named, ["model"], COLS)).fit(named).transform(named).select(C.FEATURES, C.LABEL).cache()
    make = lambda n, depth: RandomForestClassifier(labelCol=C.LABEL, featuresCol=C.FEATURES, seed=1, numTrees=n, maxDepth=depth).fit(rows)
    depths, found = [2, 1, 4, 6], C.forest_accuracy(make(25, 6), rows, [25, 3], [2, 1, 4, 6])
    for depth, (whole, first) in zip(depths, found):
        alone = make(25, depth).transform(rows).filter(F.col("prediction") == F.col(C.LABEL)).count() / rows.count()
        assert whole == pytest.approx(alone) and 0 < first <= 1


def test_one_fit_serves_all_depths_of_a_fold(spark, blobs, monkeypatch):
    fits, fit = [], C.RandomForestClassifier.fit
    monkeypatch.setattr(C.RandomForestClassifier, "fit", lambda self, rows: fits.append(self.getMaxDepth()) or fit(self, rows))
    C.fit_forest(blobs, "flag", ["model"], COLS, {"numTrees": [2, 4], "maxDepth": [1, 3, 2]}, folds=2)
    assert fits[:-1] == [3, 3] and fits[-1] in (1, 2, 3)


def test_forest_without_choice_of_depth(spark, blobs):
    model = C.fit_forest(blobs, "flag", [], ["a", "b"], {"numTrees": [2]}, folds=2)
    assert model.stages[-1].getNumTrees == 2 and model.stages[-1].getMaxDepth() == 5


def _nested(nodes, at=0):
    """A tree as nested tuples, whatever the ids of its nodes."""
    node = nodes[at]
    said = (node.prediction, node.rawCount, list(node.impurityStats), pytest.approx(node.impurity))
    if node.leftChild < 0:
        return said
    split = (node.split.featureIndex, node.split.leftCategoriesOrThreshold, pytest.approx(node.gain))
    return said, split, _nested(nodes, node.leftChild), _nested(nodes, node.rightChild)


def test_a_tree_grown_on_held_rows_is_that_of_spark(spark, folded, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "COUNT_BYTES", 4 * 3 * G.BINS * 16)
    whole = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 9}
    C.RandomForestClassifier(labelCol=C.LABEL, featuresCol=C.FEATURES, **whole).fit(folded).write().save(f"{tmp_path}/model")
    rows = folded.select(G.vector_to_array(C.FEATURES).alias("x"), F.col(C.LABEL).alias("label"))
    cuts = [B.fold_bounds(rows.withColumn("_fold", F.lit(1)), 1, 1)[0, at] for at in range(3)]
    codes = G.coded(rows, cuts)
    tree = G.pruned(G.grow(codes, np.ones(900), 9, lambda nodes: np.tile(np.arange(3), (nodes, 1))))
    spark.createDataFrame(G.pa.Table.from_batches([G.stored(0, tree, cuts)]), G.STORED).write.parquet(f"{tmp_path}/grown")
    found, want = (
        _nested([r.nodeData for r in spark.read.parquet(path).orderBy("nodeData.id").collect()]) for path in (f"{tmp_path}/grown", f"{tmp_path}/model/data")
    )
    assert len(tree.left) > 100 and found == want


def test_features_of_two_bins_are_counted_together():
    dice = np.random.default_rng(3)
    groups = [dice.integers(0, 5, 4_000), dice.integers(0, 3, 4_000)]
    bins = np.stack([*(groups[0] == at for at in range(4)), *dice.integers(0, 32, (2, 4_000)), *(groups[1] == at for at in range(3)), np.zeros(4_000)])
    label = (bins[4] + 9 * bins[0] - 7 * bins[7] + 6 * dice.normal(size=4_000) > 14).astype(int)
    codes, weights = (2 * bins + label).astype(np.uint8), dice.poisson(1.0, 4_000).astype(float)
    of_two = G.hot(codes, [2, 2, 2, 2, 32, 32, 2, 2, 2, 1], 4)
    assert of_two.many == 8 and len(of_two.codes) == 2
    found, want = (
        G.grow(codes, weights, 10, lambda nodes, dice=np.random.default_rng(1): dice.random((nodes, 10)).argsort(axis=1)[:, :4], of)
        for of in (of_two, None)
    )
    assert len(want.left) > 300 and all(np.array_equal(a, b) for a, b in zip(found, want))
    # Rows with too many of them have every feature counted by itself.
    assert G.hot(codes, [2] * 4 + [32] * 2 + [2] * 4, 1).many == 0


def test_forest_search_fits_no_rows_in_spark(spark, folded, monkeypatch):
    fitted, fit = [], C.RandomForestClassifier._fit
    monkeypatch.setattr(C.RandomForestClassifier, "_fit", lambda self, rows: fitted.append(rows.count()) or fit(self, rows))
    rows = folded.select("a", "b", "c", F.col(C.LABEL).alias("flag"))
    model = C.fit_forest(rows, "flag", [], COLS, {"numTrees": [30, 15], "maxDepth": [8, 2]}, folds=2)
    assert max(fitted) == 2
    assert C.score(model, rows, "flag").filter("label = prediction").count() > 800
    assert sum(model.stages[-1].featureImportances) == pytest.approx(1.0)
    # Too many rows for a task go to Spark ML's own fits, as before.
    monkeypatch.setattr(G, "HELD_BYTES", 100)
    C.fit_forest(rows, "flag", [], COLS, {"numTrees": [3], "maxDepth": [2]}, folds=2)
    assert fitted[-1] == 900


def test_a_grown_forest_speaks_like_the_model_loaded(spark, folded):
    grower = G.ForestGrower(labelCol=C.LABEL, featuresCol=C.FEATURES, seed=5, numTrees=25, maxDepth=6)
    grown = grower.fit(folded)
    [[found]] = C.forest_accuracy(grown, folded, [25], [6])
    model = grown.loaded(spark)
    assert model.getNumTrees == 25 and model.numFeatures == 3 and model.getMaxDepth() == 6
    right = lambda of: of.transform(folded).filter(F.col("prediction") == F.col(C.LABEL)).count() / 900
    assert found == pytest.approx(right(model))
    assert right(grower.fitted_by_spark(folded)) == pytest.approx(found, abs=0.03)
    # Trees differ, for each draws its own rows and features.
    assert len({tuple(tree.featureImportances) for tree in model.trees}) == 25


def test_other_classes_and_parameters_are_fitted_by_spark(folded):
    make = lambda **more: G.ForestGrower(labelCol=C.LABEL, featuresCol=C.FEATURES, numTrees=2, maxDepth=2, **more)
    assert isinstance(make().fit(folded), G.GrownForest)
    three = folded.withColumn(C.LABEL, F.col("_fold").cast("double"))
    assert make().fit(three).numClasses == 3
    assert make(minInstancesPerNode=5).fit(folded).getMinInstancesPerNode() == 5
