"""Table functions in SQL against the DataFrame operators."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_diagnosis import FS, RPM, impulses
from tremolo import config
from tremolo.operators import compare, features, table_functions


def test_functions_in_sql(spark):
    table_functions.register(spark)
    rng = np.random.default_rng(4)
    xs = {"a": rng.normal(size=500), "b": impulses(100, 900) + rng.normal(size=900) / 10, "tiny": np.array([1.0]), "short": rng.normal(size=20)}
    rows = [(s, k, float(v), FS, None if s == "short" else RPM) for s, x in xs.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id string, idx long, amplitude double, sampling_rate double, rotation_speed double").repartition(7)
    df.createOrReplaceTempView("tremolo_signals")
    got = {r.sample_id: r for r in spark.sql("SELECT * FROM signal_features(TABLE(tremolo_signals) PARTITION BY sample_id ORDER BY idx)").collect()}
    samples = df.select("sample_id", "sampling_rate", "rotation_speed").distinct()
    want = {r.sample_id: r for r in features.extract_features(df.select("sample_id", "idx", "amplitude"), samples).collect()}
    assert got == want and set(got) == set(xs)
    spectra = spark.sql("SELECT sample_id, count(*) AS n, max(mag) AS top FROM signal_spectrum(TABLE(tremolo_signals) PARTITION BY sample_id ORDER BY idx) GROUP BY 1").collect()
    assert {r.sample_id: r.n for r in spectra} == {"a": 251, "b": 451, "short": 11}
    assert all(abs(r.top - want[r.sample_id].dominant_amplitude) < 1e-6 for r in spectra)

    both = df.where("sample_id IN ('a', 'b')").withColumn("side", F.when(F.col("sample_id") == "a", "normal").otherwise("abnormal")).withColumn("request_id", F.lit("r"))
    both.createOrReplaceTempView("tremolo_pairs")
    made = {r.feature: r for r in spark.sql("SELECT * FROM signal_comparison(TABLE(tremolo_pairs) PARTITION BY request_id ORDER BY (side, idx))").collect()}
    pairs = spark.createDataFrame([("r", "a", "b", FS, RPM)], "request_id string, normal_id string, abnormal_id string, sampling_rate double, rotation_speed double")
    block = compare.compare(pairs, features.extract_features(df.select("sample_id", "idx", "amplitude"), samples)).first()
    assert set(made) == set(config.FEATURES)
    for f, r in made.items():
        c = block.feature_changes[f]
        assert all(abs(x - y) < 1.1e-4 for x, y in zip((r.normal, r.abnormal, r.delta), (c.normal, c.abnormal, c.delta)))  # halves may be rounded either way
        assert f == "dominant_frequency" or abs(r.ratio - c.ratio) < 1.1e-4
        assert f == "dominant_frequency" or r.changed == (f in block.changed_features)
    assert spark.sql("SELECT * FROM signal_comparison(TABLE(SELECT * FROM tremolo_pairs WHERE side = 'normal') PARTITION BY request_id ORDER BY (side, idx))").count() == 0
