"""Quality by site: held-out accuracy, shrinkage, odd rows."""

import random

from corpuspack.llm import site_quality as Q


def make(rng, n, hosts):
    rows, labels = [], []
    for i in range(n):
        host = rng.choice(list(hosts))
        good = rng.random() < hosts[host]
        w = [rng.choice("one two three four five six seven".split()) + str(rng.randrange(50)) for _ in range(120)]
        text = " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" if rng.random() < 0.8 else "###" for x in w)
        rows.append((i, text, rng.choice(["en", "de"]), host, len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_site_rates(documents, spark):
    rows, labels = make(random.Random(2), 600, {"good": 0.95, "bad": 0.1, "even": 0.5})
    told = spark.createDataFrame(labels[:200] + labels[:3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.site_quality(documents(rows), told).collect()}
    right = sum(got[i].kept == bool(q) for i, q, _ in labels[200:])
    assert right >= 0.98 * 400
    rate = {h: [got[r[0]].host_rate for r in rows if r[3] == h] for h in ("good", "bad", "even")}
    assert min(rate["good"]) > max(rate["even"]) and min(rate["even"]) > max(rate["bad"])


def test_sparse_sites_keep_the_prior(documents, spark):
    rows, labels = make(random.Random(3), 400, {"good": 0.9, "bad": 0.2})
    rows.append((1000, rows[0][1], "en", "single", 0))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.site_quality(documents(rows), told).collect()}
    mean = sum(r.quality for r in got.values()) / len(got)
    assert abs(got[1000].host_rate - mean) < 0.1  # of one document, taken out, the prior is left


def test_without_labels_and_odd_rows(odd, empty, clashing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.site_quality(odd, none).count() == 8 and Q.site_quality(empty, none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (6, 1, 0), (None, 1, 0), (5, None, 0), (77, 0, 1)], none.schema)
    rows = Q.site_quality(odd, some).collect()
    assert len(rows) == 8 and all(0 <= r.quality <= 1 for r in rows)
    again = Q.site_quality(clashing, some).collect()
    assert sorted(str(r.doc_id) for r in again) == sorted(str(r.doc_id) for r in rows)
