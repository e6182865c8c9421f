"""Rules, neighbours, WARC, trained operators, the pipeline and all queries on small tables."""

import collections
import gzip
import glob
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tools.check_oracles import TABLES, compare
from tracewell.llm import divergence, neighbours, passages, queries, toxicity, warc
from tracewell.llm.graphs import components
from tracewell.llm.learning import remainder
from tracewell.llm.tables import Staging

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = compare(spark, SMALL, name, queries.queries()[name], queries.oracle_sql()[name], con)
    assert result.startswith("ok"), result


def test_queries_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert {re.match(r"op(\d+)_|", n)[1] for n in names} == {None, *map(str, range(1, 14))}
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())


def rules(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, again, len(covered), failed


def test_rules(spark):
    r = random.Random(2)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{MEDIUM}/documents.parquet' LIMIT 300").fetchall()]
    texts += [None, "", " \n\n", "a a a", "a a a a", "\n".join(["x y", "x y", " ", "z", "z "]), "ab " * 3000, "\ta\x0bb\x0cc\rd\n" * 30]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 90))) for _ in range(200)]
    langs = ["en", None, "xx", "de"]
    rows = [(i, t, langs[i % 4], True, "x") for i, t in enumerate(texts)]
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean, language string")
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    for i, text in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == rules(text), text
        assert not (x.kept and x.base_failed)
    assert divergence.judge(docs.limit(0)).count() == 0


def test_js_distance(spark):
    def entropy(p):
        return -sum(x * math.log2(x) for x in p if x)

    cases = [([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.2, 0.3, 0.5], [0.1, 0.9, 0.0])]
    for p, q in cases:
        want = math.sqrt(max(0, entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2))
        got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(divergence.js_distance(F.col("p"), F.col("q")))
        assert got.first()[0] == pytest.approx(want, abs=1e-9)


def test_rules_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    judged = divergence.judge(docs).join(labels, "doc_id").where("NOT base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts.get((0, False), 0) >= 0.6 * (counts.get((0, False), 0) + counts.get((0, True), 0))


def test_neighbours(spark):
    r = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in r.normal(size=(300, 24)).astype(np.float32)]
    vectors += [vectors[0]] * 40 + [[float(x) for x in r.normal(size=7).astype(np.float32)] for _ in range(5)]
    vectors += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, vectors[1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for x in neighbours.nearest(table, table.where("vec_id % 5 = 0"), shard_rows=100).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    usable = {i: v for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    hits = total = 0
    for q in [i for i in usable if i % 5 == 0]:
        scores = []
        for c, v in usable.items():
            if c != q and len(v) == len(usable[q]):
                score = 0.0
                for a, b in zip(v, usable[q]):
                    score += a * b
                scores.append((-score, c))
        want = [(c, -s) for s, c in sorted(scores)[:20]]
        assert len(got[q]) == len(want)
        for c, s in got[q]:
            assert s == dict((c2, -s2) for s2, c2 in scores)[c]
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len(set(got[q]) & set(want))
        total += len(want)
    assert set(got) == {i for i in usable if i % 5 == 0}
    assert hits >= 0.99 * total
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e-160, 1e19, 1e20, 1e120])
def test_neighbours_of_any_length(spark, size):
    r = np.random.default_rng(8)
    vectors = r.normal(size=(1200, 32)) * size * r.uniform(0.5, 2, size=(1200, 1))
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, `a.b` string")
    rows = neighbours.nearest(table, table.where("vec_id % 50 = 0"), shard_rows=500).collect()
    got = collections.defaultdict(set)
    for row in rows:
        got[row.query_id].add(row.vec_id)
    products = (vectors / size) @ (vectors / size).T
    hits = 0
    for query in range(0, 1200, 50):
        assert len(got[query]) == 20
        order = [int(i) for i in np.argsort(-products[query]) if i != query][:20]
        hits += len(got[query] & set(order))
    assert hits >= 0.99 * 20 * 24


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    links += [(600, i) for i in range(601, 700)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    want = sorted((x, find(x)) for x in root)
    frame = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, components(frame, Staging(spark, "test"), "c").collect())) == want
    assert components(frame.limit(0), Staging(spark, "test"), "c").count() == 0


def test_warc(spark, tmp_path):
    pages = [
        (1, "http://a/", "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>Eins<br>zwei &#233;&copy;</p>"
            "<!-- x --><script>var a='</p>';</script><a href='/x'>drei</a> a < b</body></html>"),
        (2, None, None), (3, "http://c/", ""), (4, "http://d/", "<script>open"), (1, "http://a/", "kurz"), (5, "u", "x " * 100_000),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    made = warc.derive(warc.responses(table), "page_id")
    rows = made.collect()
    assert collections.Counter(r.record_type for r in rows) == {"metadata": 6, "conversion": 6}
    first = {r.record_type: r for r in rows if r.page_id == 1 and "zwei" in r.block or r.page_id == 1 and "T & U" in r.block}
    assert first["conversion"].block == "T & U\nEins\nzwei é©\ndrei a < b"
    assert f"conversion: {first['conversion'].record_id}\r\n" in first["metadata"].block
    assert "source-content-type: text/html; charset=utf-8\r\n" in first["metadata"].block
    assert first["metadata"].refers_to == first["conversion"].refers_to
    warc.write(made, str(tmp_path / "out"))
    found = []
    for path in glob.glob(str(tmp_path / "out" / "*.gz")):
        data = gzip.open(path).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and data[size : size + 4] == b"\r\n\r\n"
            found.append((fields[b"WARC-Record-ID"].decode(), data[:size].decode()))
            data = data[size + 4 :]
    assert sorted(found) == sorted((r.record_id, r.block) for r in rows)
    assert warc.derive(warc.responses(table.limit(0)), "page_id").count() == 0


def test_warc_headers_references_and_names(spark):
    head = "HTTP/1.1 404 Not Found\r\nServer: nginx\r\nLast-Modified: Mon, 01 Jan 2024\r\nX-Long: a\r\n b\r\nContent-Type: text/html\r\n\r\n"
    page = "<title>Caf&eacute; &#x2019;</title>it&rsquo;s &#39;so&#39; &AMP; &amp;lt; &nosuch; &#xD800; &#9999999; &nbsp;x"
    table = spark.createDataFrame([(1, "u", page, head, "2024-05-06 07:08:09", "k")], "page_id long, url string, html string, h string, at string, `_text` string")
    made = warc.derive(warc.responses(table, date=F.col("at"), http_headers=F.col("h")), "page_id", "_text")
    rows = {r.record_type: r for r in made.collect()}
    fields = rows["metadata"].block.split("\r\n")
    assert [f for f in fields if f.startswith("source-header")] == [
        "source-header: Server: nginx", "source-header: Last-Modified: Mon, 01 Jan 2024", "source-header: X-Long: a b",
        "source-header: Content-Type: text/html",
    ]
    assert "source-status: 404" in fields and "title: Café ’" in fields
    assert rows["conversion"].block == "Café ’\nit’s 'so' & &lt; &nosuch; &#xD800; &#9999999; \u00a0x"
    assert rows["conversion"]["_text"] == "k" and rows["conversion"].warc_date == "2024-05-06T07:08:09Z"


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<script", "</script ", "<!-", "&#", "href ", "<p x='"])
def test_warc_on_long_broken_pages(spark, unit):
    table = spark.createDataFrame([(1, "u", unit * (5_000_000 // len(unit)))], "page_id long, url string, html string")
    began = time.monotonic()
    assert warc.derive(warc.responses(table), "page_id").select(F.sum("content_length")).first()[0] > 0
    assert time.monotonic() - began < 30


def test_warc_oracle_decodes_as_the_query(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<title>{x} &amp;</title><p>{x}<b>{x}</b> &#39;") for i, x in enumerate(["&#39;", "&#x2019;", "&eacute;", "&bogus;", "&NotEqualTilde;", "a & b;", ""])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    ours = {(r.record_id): r.block for r in queries.queries()["op8_warc_derivatives"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        rows = connection.execute(f"SELECT record_id, block FROM ({queries.oracle_sql()['op8_warc_derivatives']})").fetchall()
    assert dict(rows) == ours and len(rows) == 14


def split(spark, folder, label):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels.where(remainder("doc_id") != 0), labels.where(remainder("doc_id") == 0).select("doc_id", label)


def test_quality_on_held_out_rows(spark):
    docs, known, held = split(spark, "/root/testdata/sf0.1", "quality")
    scored = passages.score(docs, passages.fit(docs, known)).join(held, "doc_id").toPandas()
    assert scored.score.between(0, 1).all()
    right = (scored.score >= passages.THRESHOLD).astype(int) == scored.quality
    assert right.mean() > 0.97
    assert right[scored.quality == 1].mean() > 0.99


def test_toxicity_on_held_out_rows(spark):
    docs, known, held = split(spark, "/root/testdata/sf0.1", "toxic")
    model = toxicity.fit(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.score(docs, model).join(held.select("doc_id"), "doc_id").toPandas()
    assert ((scored.expected_severity >= 0) & (scored.expected_severity <= 3)).all()
    assert (scored.toxic == (scored.severity > 0)).all()
    truth = {r.doc_id: r.toxic for r in held.collect()}
    guess = {r.doc_id: r.toxic for r in scored.itertuples()}
    pairs = [(guess[i], t) for i, t in truth.items()]
    assert np.mean([g == 0 for g, t in pairs if t == 0]) > 0.97
    assert np.mean([g == 1 for g, t in pairs if t == 1]) > 0.75


@pytest.mark.parametrize("operator, label", [(passages, "quality"), (toxicity, "toxic")])
def test_trained_operators_on_odd_rows(spark, operator, label):
    rows = [(1, "Gut und schön.", "a"), (2, None, "b"), (3, "", "c"), (None, "idiot", "d"), (1, "Gut und schön.", "a"), (5, "#%& " * 20000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("expected_severity", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (5, 1), (None, 1), (77, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        out = operator.score(docs, operator.fit(docs, known))
        assert out.count() == len(rows)
        value = "score" if operator is passages else "expected_severity"
        assert all(r[value] is not None and 0 <= r[value] <= 3 for r in out.collect())
    assert operator.score(docs.limit(0), operator.fit(docs.limit(0), labels)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    staging, current, kept = Staging(spark, "test"), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        current = staging.write(stage(spark, current, MEDIUM), name)
        kept[name] = current
        if name != "sequences":
            assert current.schema.simpleString() == docs.schema.simpleString()
    good = {r.doc_id for r in kept["quality"].select("doc_id").collect()}
    assert sum(i in good for i, q in labels.items() if q == 1) > 0.97 * sum(q == 1 for q in labels.values())
    assert kept["near_duplicates"].count() < len(good)
    assert kept["repeated_passages"].count() == kept["near_duplicates"].count() == kept["personal_data"].count()
    assert kept["personal_data"].where(F.col("text").rlike(r"@mail\d")).count() == 0
    packed = kept["sequences"]
    assert packed.select("doc_id").distinct().count() == kept["personal_data"].count()


def test_pipeline_on_empty_and_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "wort " * 60, "de", "s", 300), (3, "wort " * 60, "de", "s", 300)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()
