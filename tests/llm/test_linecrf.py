import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import linecrf as L

SF = "/root/testdata/sf0.01"


def enumerated(odds, t):
    """Marginals, expected neighbours and log of the sum over all labellings."""
    total, p, pairs = 0.0, np.zeros(len(odds)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=len(odds)):
        s = np.exp(sum(o for o, k in zip(odds, y) if k) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total += s
        p += s * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += s
    return p / total, pairs / total, np.log(total)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([3, 1, 7, 2, 1, 5])
    odds, t = rng.normal(0, 2, lines.sum()), rng.normal(0, 1, (2, 2))
    chains = L.Chains(lines)
    weight = np.repeat([0.5, 1, 2, 1, 1, 3], lines)
    p, pairs = chains.expected_pairs(odds, t, weight)
    assert np.allclose(p, chains.marginals(odds, t))
    want, expected, at = [], np.zeros((2, 2)), 0
    for n, w in zip(lines, (0.5, 1, 2, 1, 1, 3)):
        q, e, _ = enumerated(odds[at : at + n], t)
        want.extend(q)
        expected += w * e
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, expected)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    lines = np.array([4, 2, 1])
    x, w, t = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(2, 2))
    y, weight = np.repeat([1.0, 0, 1], lines), np.repeat(1 / lines / 3, lines)
    pairs = np.array([[1 / 2 / 3, 0], [0, 3 / 4 / 3]])

    def loss(w, t):
        out, at = -0.5 * 0.01 * ((w**2).sum() + (t**2).sum()), 0
        for n, label in zip(lines, (1, 0, 1)):
            odds = x[at : at + n] @ w
            out += (label * odds.sum() + (n - 1) * t[label, label] - enumerated(odds, t)[2]) / n / 3
            at += n
        return out

    gw, gt = L.gradient(x, L.Chains(lines), y, weight, pairs, w, t, 0.01)
    for i in range(3):
        d = np.eye(3)[i] * 1e-6
        assert abs((loss(w + d, t) - loss(w - d, t)) / 2e-6 - gw[i]) < 1e-6
    for i, j in itertools.product(range(2), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-6
        assert abs((loss(w, t + d) - loss(w, t - d)) / 2e-6 - gt[i, j]) < 1e-6


def test_features_by_definition():
    texts = ["One two, three!\n\n| a | a | a |", "", "x y z x y z x y z\nx y z", "é É 42 ##\x00", "\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x, size, lines = L.line_features(data, offsets)
    assert lines.tolist() == [t.count("\n") + 1 for t in texts]
    split = [line for t in texts for line in t.split("\n")]
    assert size.tolist() == [len(s.encode()) for s in split]
    col = {f: x[:, i] for i, f in enumerate(L.FEATURES)}
    for i, s in enumerate(split):
        n, words = max(len(s.encode()), 1), s.split()
        assert np.isclose(col["upper"][i], sum("A" <= c <= "Z" for c in s) / n) and np.isclose(col["bar"][i], s.count("|") / n) and np.isclose(col["symbol"][i], s.count("#") / n)
        assert np.isclose(col["control"][i], s.count("\0") / n) and col["empty"][i] == (s == "")
        assert np.isclose(col["distinct_words"][i], len(set(words)) / max(len(words), 1))
    # x y z x y z x y z | x y z: ten windows, of which all come twice; the first x y z, y z x and z x y are no later ones
    assert np.isclose(col["repeated_windows"][4], 9 / 9) and np.isclose(col["earlier_windows"][4], 6 / 9) and np.isclose(col["repeated_windows"][5], 1 / 3)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = L.classify(docs, labels).join(labels, "doc_id").collect()
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 80 and sum(r["predicted"] == r["quality"] for r in unseen) >= 0.97 * len(unseen)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    # labels of held-out rows, language and source change nothing
    turned = labels.withColumn("quality", F.when(L.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = L.classify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), turned).collect()
    assert {r["doc_id"]: r["score"] for r in out}.items() <= {r["doc_id"]: r["score"] for r in again}.items()


def test_odd_rows(spark):
    text = "Some plain words of prose in a line.\nAnd one more of these lines, as it goes."
    rows = [(1, None), (2, ""), (None, text), (4, text), (4, text), (5, "\n\n"), (6, "A!! B!! C!! " * 40), (7, "word " * 100_000), (8, "short line\n" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("clash"), "score": F.lit(3), "x": F.lit(None).cast("string")})
    for marks in ([], [(1, 1), (4, 1)], [(1, 1), (4, 1), (6, 0), (6, 1), (None, 0), (7, None), (8, 0), (2, 0)]):
        got = L.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int").withColumn("text", F.lit("clash"))).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    none = L.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert L.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    lines = L.score(docs, L.fit([], [])).filter("doc_id = 5").first()["line_scores"]
    assert len(lines) == 3
