"""Resolution of not-modified revisit records to the responses they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.skew import salted_lookup
from veilframe.session import staged

#: Ranges of capture time in which records of one URL are looked at apart.
RANGES = 256

# Headers that a not-modified answer does not replace in the stored response.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Which records hold a whole page.
FULL = "(kind = 'response' and http_status = 200)"

# Query parameters that name the visit, not the page.
VISIT_PARAMETERS = "utm_[a-z]+|gclid|fbclid|ref|sessionid"


def canonical_url(url: Column) -> Column:
    """One spelling per page: no scheme, ``www.``, default port, fragment, visit parameters or last slash; host in lower case; parameters sorted."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, "(?i)^https?://(www\\.)?", "")
    place, query = F.regexp_extract(plain, r"^[^?]*", 0), F.regexp_extract(plain, r"\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^[^/]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), "/+$", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({VISIT_PARAMETERS})(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))


def _header(name: str) -> Column:
    return F.element_at("headers", name)


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only the last in sorted order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    return F.aggregate(
        entries,
        F.expr("cast(map() as map<string,string>)"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.map_from_arrays(F.array(F.lower(e["key"])), F.array(e["value"]))
        ),
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id``, ``url_key``, ``status``, ``response_id``, ``headers``, ``body`` of every revisit among ``records``.

    ``records`` has ``record_id``, ``url``, ``at`` (long), ``kind``
    (``response`` or ``revisit``), ``http_status``, ``headers`` (map) and ``body``.  A revisit
    meets the latest full response (of status 200; partial, empty and error answers are none, nor those without a status) of its canonical
    URL that is strictly earlier; of several at that time the one with the largest id.  It is ``resolved`` when the validators agree: the entity
    tags if both have one (a weak mark ``W/`` aside), else the modification
    dates if both have one.  Then the body is the response's and the headers
    are the response's, replaced by those of the revisit except
    ``KEPT_HEADERS``.  Otherwise it is ``no_response`` (nothing earlier, or no
    URL or time), ``mismatch`` or ``no_validator``; headers are its own then and body is null.
    ``response_id`` names the earlier response wherever there is one.  Null
    headers are no headers; records of other or null kinds are ignored; repeated
    revisits are resolved each; repeated responses must share their content.  Other columns are ignored.

    The as-of join moves narrow rows only.  Records of a URL are split by
    ranges of time, each told the latest response of the ranges before, so a URL
    with a third of all records is spread; bodies are fetched by id afterwards.
    """
    records = records.where(f"kind = 'revisit' or {FULL}")
    narrow = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        "at",
        "kind",
        _lowered(F.col("headers")).alias("headers"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    narrow = staged(narrow, "records")
    marks = narrow.agg(F.percentile_approx("at", [i / RANGES for i in range(1, RANGES)], 10000)).first()[0] or []
    timed = narrow.select("record_id", "row_no", "url_key", "at", "kind", _header("etag").alias("etag"), _header("last-modified").alias("changed"))
    # Ranges are cut anywhere: every record of one time is in one range, whatever the marks.
    span = F.size(F.filter(F.array(*map(F.lit, sorted(set(marks)))), lambda mark: mark <= F.col("at")))
    timed = timed.where("url_key is not null and at is not null").withColumn("span", span)
    timed = staged(timed, "timed")
    response = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "changed"))
    ends = timed.groupBy("url_key", "span").agg(F.max(response).alias("last"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.max("last").over(before)).drop("last")
    earlier = Window.partitionBy("url_key", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    met = timed.join(ends, ["url_key", "span"]).withColumn("found", F.coalesce(F.max(response).over(earlier), F.col("before")))
    met = staged(met.where("kind = 'revisit'").select("row_no", "etag", "changed", "found"), "met")

    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    by_tag = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    by_date = F.col("changed").isNotNull() & F.col("found.changed").isNotNull()
    status = (
        F.when(F.col("found").isNull(), "no_response")
        .when(by_tag, F.when(weak(F.col("etag")) == weak(F.col("found.etag")), "resolved").otherwise("mismatch"))
        .when(by_date, F.when(F.col("changed") == F.col("found.changed"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    told = met.select("row_no", status.alias("status"), F.col("found.record_id").alias("response_id"))
    revisits = narrow.where("kind = 'revisit'").join(told, "row_no", "left")
    revisits = revisits.withColumn("status", F.coalesce("status", F.lit("no_response")))
    revisits = staged(revisits.select("row_no", "record_id", "url_key", "status", "response_id", "headers"), "revisits")

    resolved = revisits.where("status = 'resolved'")
    uses = staged(resolved.groupBy("response_id").agg(F.count(F.lit(1)).alias("uses")), "uses")
    # Bodies move once, to the parts of their id; only ids with many uses have more than one.
    hot, _ = salted_lookup(uses, ["response_id"], "uses", uses)
    stored = records.where(FULL).select(F.col("record_id").alias("response_id"), _lowered(F.col("headers")).alias("stored"), "body")
    stored = stored.join(F.broadcast(hot), "response_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    stored = stored.drop("_parts").dropDuplicates(["response_id", "salt"])
    asked = resolved.join(F.broadcast(hot), "response_id", "left")
    asked = asked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_no"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    fixed = F.array(*map(F.lit, KEPT_HEADERS))
    taken = F.map_filter("headers", lambda name, _: ~F.array_contains(fixed, name))
    left = F.map_filter("stored", lambda name, _: ~F.array_contains(F.map_keys("headers"), name) | F.array_contains(fixed, name))
    whole = asked.join(stored, ["response_id", "salt"])
    whole = whole.withColumn("headers", F.map_concat(left, taken))
    fields = ["record_id", "url_key", "status", "response_id", "headers", "body"]
    others = revisits.where("status <> 'resolved'").withColumn("body", F.lit(None).cast(records.schema["body"].dataType))
    return whole.select(*fields).unionByName(others.select(*fields))


def captures(pages: DataFrame) -> DataFrame:
    """Records of several fetches of each of the ``pages``, and of revisits between and after them.

    Times follow the page's number p.  At p the page comes whole.  At p + 2 every third comes in part, every third not at all and the
    others have changed; at that same time every seventh comes as another version, and the others answer that nothing has
    changed.  Revisits come at p + 2 (for every sixth page at p - 1), at p + 7 with the validators of the latest version, and at
    p + 40 with those of the first.  Every fifth page sends no entity tags, every eleventh has
    changed once more at p + 7, and revisits of every tenth show no validator.  Pages that share a canonical URL share its records.
    """
    page = F.col("page_id")
    none = F.lit(None).cast("string")
    names = F.array(*map(F.lit, ("ETag", "Last-Modified", "Content-Type", "Content-Length", "Date")))
    versions = {name: F.concat("html", F.lit(mark)) for name, mark in (("first", ""), ("changed", "<!-- changed -->"), ("twin", "<!-- twin -->"))}
    tag = {name: F.concat(F.lit('"'), F.md5(F.coalesce(body, F.lit(""))), F.lit('"')) for name, body in versions.items()}
    day = {name: F.concat(F.lit("day "), ((page + n) % 28).cast("string")) for n, name in enumerate(versions)}
    latest = lambda values: F.when(page % 7 == 0, values["twin"]).when(page % 3 == 2, values["changed"]).otherwise(values["first"])

    def record(number, at, status, body, tag, day):
        is_revisit = status is None
        shown = page % 10 != 3 if is_revisit else F.lit(True)
        tag = F.when((page % 5 != 0) & shown, F.concat(F.lit("W/"), tag) if is_revisit else tag)
        length = F.lit("0") if is_revisit else F.length(body).cast("string")
        values = F.array(tag, F.when(shown, day), none if is_revisit else F.lit("text/html"), length, at.cast("string"))
        return F.struct(
            (8 * page + number).alias("record_id"),
            F.col("url"),
            at.alias("at"),
            F.lit("revisit" if is_revisit else "response").alias("kind"),
            (F.lit(None) if is_revisit else status).cast("int").alias("http_status"),
            F.map_filter(F.map_from_arrays(names, values), lambda _, value: value.isNotNull()).alias("headers"),
            body.alias("body"),
        )

    later = F.when(page % 3 == 0, 206).when(page % 3 == 1, 404).otherwise(200)
    part = F.when(page % 3 == 0, F.substring("html", 1, 100)).when(page % 3 == 1, F.lit("not found")).otherwise(versions["changed"])
    again = F.when(page % 7 == 0, versions["twin"])
    parts = [
        record(0, page, F.lit(200), F.col("html"), tag["first"], day["first"]),
        record(1, page + 2, later, part, F.when(page % 3 == 2, tag["changed"]).otherwise(tag["first"]), F.when(page % 3 == 2, day["changed"]).otherwise(day["first"])),
        record(2, page + 2, F.when(page % 7 == 0, 200).otherwise(304), again, F.when(page % 7 == 0, tag["twin"]).otherwise(tag["first"]), day["twin"]),
        record(3, page + F.when(page % 6 == 0, -1).otherwise(2), None, none, tag["first"], day["first"]),
        record(4, page + 7, None, none, F.when(page % 11 == 0, F.lit('"new"')).otherwise(latest(tag)), latest(day)),
        record(5, page + 40, None, none, tag["first"], day["first"]),
    ]
    # All from one look at a page.
    return pages.select(F.inline(F.array(*parts)))
