from pyspark.sql import functions as F

from codeweft.operators import layers


def test_layers_by_names(spark):
    files = {
        "src/userController.js": "controller", "core/routeDrop.java": "router", "src/services/userController.js": "service", "a/plain.py": "unknown",
        "UserService.java": "service", "a/x.test.js": "unknown", "a/.gitignore": "unknown", "a\\models\\x.py": "model", None: "unknown",
    }
    got = spark.createDataFrame([(p,) for p in files], "p string").select("p", layers.file_layer(F.col("p")).alias("l"))
    assert {r.p: r.l for r in got.collect()} == files
    raws = {"./user_service": "service", "../models/x.js": "model", "app.userRepo.find": "repository", "crate::services::x": "unknown", "./plain": "unknown", None: "unknown"}
    got = spark.createDataFrame([(p,) for p in raws], "p string").select("p", layers.import_layer(F.col("p")).alias("l"))
    assert {r.p: r.l for r in got.collect()} == raws
    rows = spark.createDataFrame([("src/userController.js", "./user_repo")], "path string, raw string")
    assert [(r.source_layer, r.target_layer, r.type) for r in layers.violations(rows).collect()] == [("controller", "repository", "layer_skip")]
