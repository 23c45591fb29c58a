import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import queries, warc

SCHEMA = "record_id long, url string, at long, kind string, http_status int, headers map<string,string>, body string"


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://WWW.Example.org:80/a/?utm_source=x#top", "example.org/a"),
        ("https://example.org/a", "example.org/a"),
        ("https://example.org", "example.org"),
        ("https://example.org/?b=2&a=1&", "example.org?a=1&b=2"),
        ("https://example.org:8080/A//?ref=y", "example.org:8080/A"),
        ("https://example.org/a?reference=1", "example.org/a?reference=1"),
        ("", ""),
        (None, None),
    ],
)
def test_urls_have_one_spelling(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(warc.canonical_url(F.col("url"))).first()[0] == key


def plainly(rows, key):
    out = []
    lower = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
    for record_id, url, at, kind, _, headers, _ in rows:
        if kind != "revisit":
            continue
        own, found = lower(headers), None
        if url is not None and at is not None:
            earlier = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] is not None and key(r[1]) == key(url) and r[2] is not None and r[2] < at]
            found = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if found is None:
            out.append((record_id, "no_response", None, own, None))
            continue
        stored, status = lower(found[5]), "no_validator"
        for name in ("last-modified", "etag"):
            if own.get(name) is not None and stored.get(name) is not None:
                strip = lambda v: v.removeprefix("W/") if name == "etag" else v  # noqa: B023, E731
                status = "resolved" if strip(own[name]) == strip(stored[name]) else "mismatch"
        if status == "resolved":
            merged = stored | {k: v for k, v in own.items() if k not in warc.KEPT_HEADERS}
            out.append((record_id, status, found[0], merged, found[6]))
        else:
            out.append((record_id, status, found[0], own, None))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        url = "http://hot.example" if i % 3 == 0 else rng.choice([f"https://www.site{i % 17}.example/x", f"http://site{i % 17}.example/x/", None])
        headers = {"ETag": rng.choice(['"1"', 'W/"1"', '"2"']), "Last-Modified": rng.choice(["mon", "tue"]), "Content-Length": str(i), "X-Seen": str(i)}
        for name in list(headers):
            if rng.random() < 0.3:
                del headers[name]
        kind = rng.choice(["response", "revisit", "revisit", "request", None])
        rows.append((i, url, rng.choice([rng.randrange(120), None, 60]), kind, rng.choice([200, 200, 206, 304, 404, None]), rng.choice([headers, headers, headers, None]), rng.choice(["body", None, "é" * 50_000])))
    return rows


def test_revisits_meet_the_latest_earlier_response(spark):
    rows = sample()
    records = spark.createDataFrame(rows, SCHEMA).withColumn("status", F.lit(1)).withColumn("Span", F.lit("x")).repartition(6)
    found = warc.resolve_revisits(records)
    assert found.columns == ["record_id", "url_key", "status", "response_id", "headers", "body"]
    key = lambda url: url.split("//")[1].removeprefix("www.").rstrip("/")
    got = [(r.record_id, r.status, r.response_id, dict(r.headers), r.body) for r in found.collect()]
    sort = lambda out: sorted(((i, s, x, sorted(h.items()), b) for i, s, x, h, b in out), key=repr)
    assert sort(got) == sort(plainly(rows, key))
    assert {s for _, s, *_ in got} == {"resolved", "mismatch", "no_validator", "no_response"}


def test_repeated_records_and_empty_tables(spark):
    row = (1, "http://a.example", 1, "response", 200, {"etag": "x"}, "b")
    again = (2, "http://a.example", 2, "revisit", None, {"etag": "x"}, None)
    found = warc.resolve_revisits(spark.createDataFrame([row, row, again, again], SCHEMA)).collect()
    assert [(r.record_id, r.status, r.body) for r in found] == [(2, "resolved", "b")] * 2
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partial_and_error_answers_are_passed_over(spark):
    url, tag = "http://a.example", {"etag": "x"}
    rows = [(n, url, n, "response", status, tag, f"b{status}") for n, status in enumerate([200, 206, 304, 404, 500, None])]
    rows += [(9, url, 9, "revisit", None, tag, None), (10, "http://b.example", 9, "revisit", None, tag, None), (11, "http://b.example", 1, "response", 206, tag, "p")]
    found = {r.record_id: (r.status, r.response_id, r.body) for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {9: ("resolved", 0, "b200"), 10: ("no_response", None, None)}


def test_very_many_and_very_long_headers(spark):
    url, stored = "http://a.example", {f"x-{n}": "v" * 50 for n in range(2000)} | {"etag": "x", "content-type": "t"}
    own = {f"X-{n}": "w" for n in range(0, 2000, 2)} | {"etag": "x", "content-type": "u", "x-long": "z" * 500_000}
    rows = [(1, url, 1, "response", 200, stored, "b"), (2, url, 2, "revisit", None, own, None)]
    found = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert found.headers == stored | {k.lower(): v for k, v in own.items() if k != "content-type"}


def test_captures_have_every_outcome_often(spark):
    found = queries.op5_warc(spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    total = sum(r["count"] for r in found)
    assert {r.status for r in found} == {"resolved", "mismatch", "no_response", "no_validator"}
    assert all(r["count"] > 0.05 * total for r in found)
