import math

import numpy as np
from pyspark.sql import functions as F

from siteloom.llm import quality as q
from siteloom.llm.common import Scratch

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    part = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) > 0)
    rows = q.judge(docs, part).join(labels.join(part, "doc_id", "left_anti"), "doc_id").toPandas()
    toxic, low = rows[rows.toxic == 1], rows[rows.quality == 0]
    clean = rows[(rows.toxic == 0) & (rows.quality == 1)]
    assert len(rows) > 600 and (~toxic.keep).mean() > 0.8 and clean.keep.mean() > 0.98 and (~low.keep).mean() > 0.4  # some labels of the data are wrong


def test_site_posteriors(spark):
    rows = [(h, p, x, 0.0) for h, p, n, x in (("a", "x", 50, 0.9), ("a", "y", 1, 0.0), ("b", "x", 80, 0.1), ("c", "z", 1, 1.0), ("", "", 3, 0.2)) for _ in range(n)]
    got = {(r.host, r.path): r for r in q.site_posteriors(spark.createDataFrame(rows, "host string, path string, p_low double, p_toxic double")).collect()}
    rate = sum(r[2] for r in rows) / len(rows)
    assert all(math.isclose(r.rate_low, rate) and r.path_toxic == 0 for r in got.values())
    assert rate < got["c", "z"].path_low < 1 and got["a", "x"].path_low > got["a", "y"].path_low > 0.3 and got["b", "x"].host_low < 0.2


def test_weights_need_evidence():
    seen, total = np.zeros((4, 4)), np.array([1000.0, 0, 100, 0])
    seen[0] = [2, 0, 60, 0]
    seen[1] = [0, 0, 1, 0]
    seen[2] = [500, 0, 52, 0]
    w = q.weights(seen, total)
    assert w[0, 1] > 3 and not w[1:, 1].any() and not w[:, 0].any()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words", None, None, 3), (1, "good words", None, None, 3), (None, None, "s", "en", 1), (2, "", "s", "en", 1), (3, "w " * 60_000, "s", None, 1)], "doc_id long, text string, source string, lang string, host int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in q.judge(docs, none).collect()] == [True] * 5
    some = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.kept_documents(docs, some).columns == docs.columns and q.kept_documents(docs, some).count() == 5
    assert q.judge(docs.limit(0), some).collect() == []


def test_calibration():
    x = np.linspace(-3, 3, 400)[:, None]
    a, b = q.calibrate(x, (x[:, 0] > 0.5).astype(float))
    assert abs(-a / b - 0.5) < 0.1
    assert q.calibrate(x, np.zeros(400)).tolist() == [-30.0, 0.0]
