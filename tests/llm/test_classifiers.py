"""Held-out accuracy of both classifiers, their parts by brute force, and edges."""

import zlib

import numpy as np

from tremolo.llm import quality, toxicity
from tremolo.llm.queries import op6_toxicity, op7_quality

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out_result(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in own])
    got = np.array([r.predicted for r in own])
    score = np.array([r.score for r in own])
    print(query.__name__, "AUC", auc(score, y), "accuracy", (got == y).mean(), "precision", y[got == 1].mean(), "recall", got[y == 1].mean(), "specificity", 1 - got[y == 0].mean())
    return auc(score, y), (got == y).mean()


def test_toxicity_held_out(spark):
    a, right = held_out_result(spark, op6_toxicity, "toxic")
    assert a > 0.97 and right > 0.95


def test_quality_held_out(spark):
    a, right = held_out_result(spark, op7_quality, "quality")
    assert a > 0.95 and right > 0.93


def test_machine_equals_its_definition():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=20), rng.normal(size=(20, 3))
    docs = [np.array([1, 5, 7]), np.array([], int), np.array([0, 19])]
    ids, starts = np.concatenate(docs), np.array([0, 3, 3, 5])
    raw, _ = toxicity.raw_scores(ids, starts, (0.3, w, v))
    for d, r in zip(docs, raw):
        pairs = sum(v[i] @ v[j] for k, i in enumerate(d) for j in d[k + 1 :])
        assert abs(r - (0.3 + w[d].sum() + pairs)) < 1e-9


def test_machine_learns_a_meeting_of_terms():
    rng = np.random.default_rng(1)
    x = [np.unique(np.append(rng.integers(10, 200, 8), [t for t in (1, 2) if rng.random() < 0.5]).astype(int)) for _ in range(4000)]
    y = np.array([float({1, 2} <= set(d)) for d in x])
    m = toxicity.fit(x, y, toxicity.Params(bits=8))
    f = lambda ids: float(toxicity.raw_scores(m.place[ids], np.array([0, len(ids)]), (m.bias, m.weight, m.vectors))[0][0])
    assert f(np.array([1, 2])) > 0 > max(f(np.array([1])), f(np.array([2])))


def test_machine_admits_a_term_that_tells_only_beside_another():
    rng = np.random.default_rng(2)
    x, y = [], []
    for _ in range(6000):
        # Insult with group and another insult are toxic; group alone (as frequent), insult alone and neither are clean.
        kind = rng.choice(5, p=[0.25, 0.25, 0.25, 0.1, 0.15])
        x.append(np.unique(np.append(rng.integers(10, 200, 6), ([1, 2], [3], [2], [1], [])[kind]).astype(int)))
        y.append(float(kind < 2))
    y = np.array(y)
    p = toxicity.Params(bits=8)
    first, _ = toxicity.differs(*toxicity.counted(zip(x, y.astype(int)), None, p), p)
    m = toxicity.fit(x, y, p)
    f = lambda ids: float(toxicity.raw_scores(m.place[ids], np.array([0, len(ids)]), (m.bias, m.weight, m.vectors))[0][0])
    assert first[1] and not first[2] and m.place[2] >= 0
    assert min(f(np.array([1, 2])), f(np.array([3]))) > 0 > max(f(np.array([1])), f(np.array([2])))


def test_counts_and_model_do_not_depend_on_where_they_are_made(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, 12)) + (" bad" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    ids_of = toxicity.term_ids(18)
    plain = toxicity.fit([ids_of(t) for _, t, _ in own], np.array([float(y) for *_, y in own]), toxicity.Params())
    assert np.array_equal(model.place, plain.place) and model.bias == plain.bias and np.array_equal(model.weight, plain.weight) and np.array_equal(model.vectors, plain.vectors)
    assert model.place[ids_of("bad")[0]] >= 0


def test_network_equals_its_definition():
    rng = np.random.default_rng(3)
    vectors, weight = rng.normal(size=(12, 4)), rng.random(12)
    ids = np.array([3, 3, 7, 0], np.uint32)
    w = np.array([weight[i] for i in ids]) / sum(weight[i] for i in ids)
    mean = sum(a * vectors[i] for a, i in zip(w, ids))
    spread = np.sqrt(sum(a * vectors[i] ** 2 for a, i in zip(w, ids)) - mean**2)
    assert np.allclose(quality.pooled(ids, vectors, weight), np.concatenate([mean, spread]))
    layers = (rng.normal(size=(8, 5)), rng.normal(size=5), rng.normal(size=5), rng.normal(size=1))
    x = rng.normal(size=(3, 8))
    want = [sum(np.tanh(sum(r[i] * layers[0][i, k] for i in range(8)) + layers[1][k]) * layers[2][k] for k in range(5)) + layers[3][0] for r in x]
    assert np.allclose(quality._forward(x, layers)[1], want)


def test_gradients_and_temperature():
    rng = np.random.default_rng(4)
    layers = [rng.normal(size=(6, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    x, y = rng.normal(size=(20, 6)), rng.integers(0, 2, 20).astype(float)
    loss = lambda ls: float(np.logaddexp(0, np.where(y > 0, -1, 1) * quality._forward(x, ls)[1]).mean() + 0.5e-4 * ((ls[0] ** 2).sum() + (ls[2] ** 2).sum()))
    for k, g in enumerate(quality.gradients(x, y, layers)):
        for at in np.ndindex(*layers[k].shape):
            up, down = [v.copy() for v in layers], [v.copy() for v in layers]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g[at]) < 1e-6
    raw, truth = rng.normal(size=4000) * 3, None
    truth = (rng.random(4000) < 1 / (1 + np.exp(-raw / 2.5))).astype(float)
    assert abs(quality.best_temperature(raw, truth) - 2.5) < 0.4


def test_random_indexing_by_brute_force(spark):
    texts = ["the cat sat on the mat", "", None, "a", "THE Cat!! 123 the cat"] * 3
    p = quality.Params(buckets=50, width=8)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sums, seen = quality.word_vectors(df, p)
    plus, minus = quality.index_vectors(p)
    want, count = np.zeros((50, 8)), np.zeros(50)
    for t in texts:
        ids = quality.word_ids(50)(t or "")
        for i, a in enumerate(ids):
            count[a] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    want[a, plus[ids[j]]] += 1
                    want[a, minus[ids[j]]] -= 1
    assert np.array_equal(sums, want) and np.array_equal(seen, count)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "hi " * 50000, 3), (2, "hi", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, toxic int, quality int")
    for part, kind in ((toxicity, "toxic"), (quality, "quality")):
        model = part.train(docs, labels)
        assert part.score(docs, model).count() == 4
        assert part.score(docs.limit(0), part.train(docs.limit(0), labels.limit(0))).count() == 0
    model = toxicity.train(docs, labels)
    assert toxicity.reject(docs, model).columns == docs.columns
