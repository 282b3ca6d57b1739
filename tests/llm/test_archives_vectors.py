import base64
import hashlib
import math
import random

from pyspark.sql import functions as F

from caseloom.llm import vafile, warc


def slow_top(rows, every, k):
    whole = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole[vec_id] = [math.floor(256 * x) for x in vector]
    out = []
    for query, q in whole.items():
        if query % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in whole.items() if i != query and len(v) == len(q)]
            out += [(query, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_top_products_against_all(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 50)
    monkeypatch.setattr(vafile, "QUERIES", 7)
    dice = random.Random(1)
    rows = [(i, [dice.gauss(0, 0.2) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(40)]
    rows += [(500, None), (501, [None] * 12), (502, [math.nan] * 12), (503, [math.inf] * 12), (None, rows[0][1])]
    rows += [(504, [0.5] * 3), (510, [0.25] * 3), (520, [900.0] * 5), (530, []), (531, []), (532, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    single = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = vafile.top_products(frame.repartition(3), F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(tuple(r) for r in found) == slow_top(single, 10, 5)
    assert vafile.top_products(frame.filter("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert vafile.top_products(frame, F.lit(False)).count() == 0


def test_url_key():
    assert warc.url_key("HTTPS://www2.Example.com:443/A/b?Q=1#frag") == "com,example)/a/b?q=1"
    assert warc.url_key("http://x.org") == "org,x)/"


def test_loser_tree_merges():
    dice = random.Random(2)
    for runs in range(0, 9):
        lists = [
            sorted(((f"k{dice.randint(0, 5)}", f"{dice.randint(0, 9)}", dice.choice([None, dice.randint(0, 9)])) for _ in range(dice.randint(0, 12))), key=warc.order)
            for _ in range(runs)
        ]
        assert list(warc.LoserTree(lists)) == sorted((e for of in lists for e in of), key=warc.order)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 4)
    payloads = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\ny\r\n\r\nWARC/1.0\r\n", "é\n" * 40_000, "<p>a</p>"]
    rows = [(i, f"http://h{i % 3}.example/{i % 2}", payload, f"2000-01-01T00:00:{i:02d}Z") for i, payload in enumerate(payloads)]
    rows += [(None, None, "<p>a</p>", "2000"), (20, "bad\r\nurl", "alone", "2001"), (20, "bad\r\nurl", "alone", "2001"), (None, "u", "only", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, stamp string").withColumn("_sha1", F.lit(1))
    found = warc.archive(pages.repartition(3)).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found if r.page_id is not None}
    for page_id, _, html, _ in rows[:7]:
        data = (html or "").encode()
        assert by_id[page_id].payload_bytes == len(data)
        assert by_id[page_id].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(by_id[i].record_type, by_id[i].refers_to) for i in (0, 1, 6)] == [("revisit", 6), ("revisit", 6), ("response", None)]
    assert (by_id[2].refers_to, by_id[3].record_type) == (3, "response")
    assert sorted((r.record_type, r.refers_to) for r in found if r.page_id is None) == [("response", None), ("revisit", 6)]
    assert [r.record_type for r in found if r.page_id == 20] == ["response"] * 2
    ordered = sorted(found, key=lambda r: r.capture_no)
    keys = [warc.order((r.url_key, r.stamp, r.page_id)) for r in ordered]
    assert keys == sorted(keys) and [r.capture_no for r in ordered] == list(range(len(rows)))
    assert warc.archive(pages.filter("false")).count() == 0


def test_invalid_vector_does_not_hide_a_valid_query(spark):
    rows = [(1, [None, 1.0]), (1, [float("-inf"), 2.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [2.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vafile.top_products(vectors, vectors["vec_id"] == 1, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(1, 1, 2), (1, 2, 3)]
