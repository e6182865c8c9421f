"""Near vectors, spelling variants and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import near_vectors, ranking, spellings
from tracewell.llm.tables import Staging

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def vectors(seed, groups=((0, 200, 0.03), (0, 30, 0.12), (1, 40, 0.05)), loose=120, dimension=24):
    r = np.random.default_rng(seed)
    rows = []
    for label, size, noise in groups:
        centre = r.standard_normal(dimension)
        rows += [(label, centre + noise * np.linalg.norm(centre) * r.standard_normal(dimension) / 2) for _ in range(size)]
    rows += [(int(r.integers(3)), r.standard_normal(dimension)) for _ in range(loose)]
    rows += [rows[0]] * 5
    return [(i, v.tolist(), label) for i, (label, v) in enumerate(rows)]


def linked(rows, cosine=0.93):
    good = [
        (i, label, [x / max(map(abs, v)) for x in v])
        for i, v, label in rows
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    near = {i: set() for i, _, _ in rows}
    for i, label, v in good:
        for j, other, u in good:
            if i != j and label == other and len(u) == len(v) and np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine:
                near[i].add(j)
    reach = {}
    for i in sorted(near):
        if i not in reach:
            waiting = [i]
            while waiting:
                at = waiting.pop()
                if at not in reach:
                    reach[at] = i
                    waiting += near[at]
    return near, reach


@pytest.mark.parametrize("crowd, block", [(64, 512), (8, 16), (10**9, 7)])
def test_near_vectors(spark, crowd, block):
    """Balls and blocks change the way, not the result."""
    rows = vectors(5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in near_vectors.link(frame, crowd=crowd, block=block, tables=40, bits=6).collect()}
    near, reach = linked(rows)
    assert {i: len(n) for i, n in near.items()} == {i: r.n_links for i, r in got.items()}
    assert reach == {i: r.component_id for i, r in got.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_vectors_recall(spark):
    """With the tables as registered nine tenths of the pairs at the threshold are found."""
    r = np.random.default_rng(9)
    rows, angle = [], math.acos(0.9301)
    for i in range(300):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (math.cos(angle) * a + math.sin(angle) * b).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = near_vectors.link(frame).where("n_links > 0").count()
    assert found >= 0.9 * len(rows)


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (1, [1.0, 0.0], 1), (2, [1e300, 1e300], 1), (3, [1e-300, 1e-300], 1), (4, [2.0, 2.0], None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 1.0, 0.0], 1), (12, [-0.0, 1.0], 2),
        (13, [0.0, 1.0], 2),
    ]
    schema = "vec_id long, embedding array<double>, label int, `a.b` string, `class` long, `Bucket` long"
    frame = spark.createDataFrame([(*row, "x", 1, 2) for row in odd], schema)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.link(frame).collect()}
    alone = {i: (0, i, True) for i in (1, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == alone | {2: (1, 2, True), 3: (1, 2, False), 12: (1, 12, True), 13: (1, 12, False)}
    assert near_vectors.link(frame.limit(0)).count() == 0
    none = near_vectors.link(frame.where("vec_id in (2, 3)").withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in none] == [(1, None, False)] * 2
    twice = near_vectors.link(frame.where("vec_id = 2").unionByName(frame.where("vec_id = 2"))).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in twice] == [(2, 1, 2, True)] * 2


def test_balls_are_linked_throughout(spark):
    rows = vectors(6, groups=((0, 300, 0.02),), loose=20)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    staging = Staging(spark, "test")
    classes = frame.select(F.col("vec_id").alias("class"), F.col("embedding").alias("vector"))
    signed = staging.write(classes.withColumn("bucket", F.when(F.col("class") < 200, 0).otherwise(1).cast("long")), "signed")
    bucketed = signed.select("class", "bucket")
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    balls = near_vectors._balls(bucketed, sizes, signed, 0.93, 10, staging).collect()
    near, _ = linked([(i, v, 0) for i, v, _ in rows])
    assert len(balls) > 250 and len({b.ball for b in balls}) == 1
    inside = {b["class"] for b in balls}
    assert all(inside - {i} <= near[i] for i in inside)


def grouped(rows, damage):
    total = Counter()
    for doc, text in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            total[run] += 0
            value = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: value % len(run)] + run[value % len(run) + 1 :] if damage and value % damage == 0 else run] += n
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, result = {}, {}
    found = {w: [o for o in n if near(w, o)] for w in n}
    for w, others in found.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        result[w] = (form.get(w), root, n[w], len(found[w]), n[form[w]] if w in form else None)
    return result


@pytest.mark.parametrize("shard, damage", [(2048, 97), (3, 2), (1, 0)])
def test_spelling_variants(spark, shard, damage):
    r = random.Random(shard)
    stock = ["".join(r.choice("abeéÿtÀ") for _ in range(r.randint(4, 7))) for _ in range(60)]
    stock += [w[:-1] + r.choice("aet") for w in stock] + ["listen", "silent", "enlist", "tinsel", "inlets", "listens", "aaaaa", "aaaaaa"]
    rows = []
    for i in range(80):
        words = r.choices(stock, [1 + 40 * (k % 7 == 0) for k in range(len(stock))], k=60)
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words) + r.choice(["", ".x1,", "\nĀ"])))
    rows += [(None, "listen " * 9), (90, None), (91, ""), (92, "silent" * 3), rows[0], rows[0], (93, "e" * 300_000), (94, "ab1" * 500_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("WORD", F.lit(2))
    got = spellings.group(frame, shard=shard, damage=damage).collect()
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == grouped(rows, damage)
    assert spellings.group(frame.limit(0)).count() == 0


def test_long_texts_count_alike(monkeypatch):
    text = "Abcde éàüöÿ xĀy abcde ".encode() * 50
    short = spellings._tallied(text)
    monkeypatch.setattr(spellings, "_LONG", 10)
    assert spellings._tallied(text) == short and short["éàüöÿ".encode()] == 50


def ranked(docs, items, k):
    def terms(text):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]

    counts = [(i, Counter(terms(text))) for i, text in docs]
    n, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    result = []
    for item, text in set(items):
        scores = []
        for doc, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // max(1, length)
            held = [t for t in set(terms(text)) if t in c]
            weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in held}
            score = sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in held)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        result += [(item, rank + 1, doc, -less) for rank, (less, doc) in enumerate(sorted(scores)[:k])]
    return sorted(result, key=str)


@pytest.mark.parametrize("pass_terms", [500_000, 20])
def test_ranked_search(spark, pass_terms):
    r = random.Random(4)
    stock = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "a1b2", "日本", "x"]
    docs = [(i, r.choice([" ", "-", "\n"]).join(r.choices(stock, range(len(stock), 0, -1), k=r.choice([1, 5, 40, 200])))) for i in range(400)]
    docs += [docs[3], docs[3], (900, None), (901, ""), (902, " .-\x7f"), (None, "w1 w2 x"), (903, "w1 " * 400_000 + "rare"), (904, docs[5][1])]
    items = [(i, " ".join(r.sample(stock, r.choice([1, 3, 12])))) for i in range(30)]
    items += [items[0], (50, None), (51, ""), (52, "unknown"), (None, "w3 w3 Rare"), (53, "STRAßE ÉTÉ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("Score", F.lit(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = ranking.search(frame.repartition(3), asked, k=20, pass_terms=pass_terms).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(x) for x in got.collect()), key=str) == ranked(docs, items, 20)
    assert ranking.search(frame.limit(0), asked).count() == 0
    assert ranking.search(frame, asked.limit(0)).count() == 0


def test_ball_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    points = np.concatenate([r.poisson(c, (500, 80)) * (r.random((500, 80)) < 0.2) for c in (3, 50, 4000)]).astype(np.float32)
    points[:500, 40:] = 0
    queries = np.zeros((6, 80))
    for row in queries:
        row[r.choice(80, 10, replace=False)] = r.integers(1, 9000, 10)
    tree = ranking.BallTree(points)
    bounds = tree.bounds(queries)
    exact = points.astype(np.int64) @ queries.T.astype(np.int64)
    for node, (begin, end) in enumerate(tree.spans):
        assert (exact[tree.order[begin:end]].max(axis=0) <= bounds[node]).all()
    for q in range(len(queries)):
        best, seen = ranking.Best(10), 0
        for bound, leaf in tree.best_first(bounds[:, q]):
            if bound < best.threshold:
                break
            seen += len(leaf)
            best.add(exact[leaf, q], leaf)
        assert sorted(best.scores)[::-1] == sorted(exact[:, q])[::-1][:10]
        assert seen < len(points) / 2
