"""URL filters, periodic runs and resampling against brute force, and their edge cases."""

import datetime as dt
import hashlib
import random
import re
import zlib
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from maskmetrics.llm import periodic_runs as P
from maskmetrics.llm import queries as Q
from maskmetrics.llm import resampling as R
from maskmetrics.llm import url_filters as U

ODD = "a `b.c d"
ODD_DDL = "`a ``b.c d`"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# --- URL filters

RULES = [*Q.URL_RULES, ("b.com", "/x", "block"), ("com", "/x/y", "allow"), ("b.com", "/x/y/z.html", "allow"), ("c.com", None, "block"), ("c.com", "", "allow"), ("C.com", "/ok", "allow"), ("é.net", "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "://", "http:///path", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com?/en/", "https://example.com/en", "https://example.com/en/", "https://xexample.com/en/1",
    "https://a.www.example.com/en/1", "http://a.b.com/x", "http://a.b.com/x/y/z.html", "http://b.com/x/y/z.htm", "http://a..com/xx", "http://c.com", "http://d.c.com/ok", "http://com/", "http://x.com:80/", "http://user@b.com/x", "http://B.com/X",
    "http://É.net/", "http://x.é.net/", "a://b.com/x://c.com/", "http://example.net/es", "http://example.net/es/#/fr/", "http://example.com./en/", "http://" + "a." * 300 + "com/" + "x/" * 3000,
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fits = [(len(lower(h) + (p or "")), len(h), v == "block", lower(h) + (p or ""), v) for h, p, v in RULES if (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p or "")]
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("options", [{}, {"prefix": 1}, {"broadcast_rules": 2}, {"broadcast_rules": 2, "prefix": 1}])
def test_url_filters(spark, options):
    urls = [*URLS, *["http://hot.example.com/en/"] * 5000]
    pages = spark.createDataFrame([(i, u, "kept", "gives way") for i, u in enumerate(urls)], f"page_id bigint, url string, {ODD_DDL} string, Host string").repartition(3)
    got = U.judge(pages, U.rules_of(spark, RULES), **options)
    assert got.columns == ["page_id", "url", ODD, "host", "path", "rule", "verdict"]
    rows = {r[0]: r for r in got.collect()}
    assert len(rows) == got.count() == len(urls)
    for i, u in enumerate(urls):
        assert tuple(rows[i])[1:] == (u, "kept", *judged(u)), u


def test_url_filters_of_empty_tables_and_wrong_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id bigint, url string")
    assert sorted(r["verdict"] for r in U.judge(pages, U.rules_of(spark, []), default="block").collect()) == ["block"] * 3
    assert U.judge(pages.limit(0), U.rules_of(spark, RULES)).count() == 0
    for wrong in [(None, "/", "allow"), ("", "/", "allow"), ("a.com", "/", "maybe"), ("a.com", "/", None), ("a.com", "/" * 5000, "block")]:
        with pytest.raises(Exception, match="no rule"):
            U.judge(pages, U.rules_of(spark, [wrong])).collect()


def test_url_filters_run_no_python(spark):
    pages = spark.range(3).select(F.format_string("http://a%d.com/", "id").alias("url"))
    plan = U.judge(pages, U.rules_of(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [prefix" in plan and not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- periodic runs


def brute_runs(w, least, periods):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            run = w[start : i + q]
            primitive = all(any(run[k] != run[k + d] for k in range(len(run) - d)) for d in range(1, q))
            if len(run) >= max(least, periods * q) and primitive:
                out.append((start, len(run), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    f, g = [0], [0, 1]
    while len(g) < n:
        f, g = g, g + f
    return g[:n]


def test_runs_by_brute_force():
    rng = random.Random(5)
    words = [[rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(45))] for _ in range(1500)]
    for w in list(words[:700]):
        if w:
            a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 3))
            words.append([w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))])
    words += [fibonacci(250), [bin(i).count("1") % 2 for i in range(400)], [bin(i).count("1") % 2 for i in range(90)] * 4, [7] * 120, [0, 1] * 60 + [2] * 40 + [0, 1, 2] * 30]
    for w in words:
        for least, periods in ((6, 4), (2, 2), (5, 3)):
            assert P.runs(w, least, periods) == brute_runs(w, least, periods), w


def test_extensions_do_not_rest_on_the_hash(monkeypatch):
    # a hash that always says equal: only the verification is left
    monkeypatch.setattr(P.Extensions, "_equal", lambda self, i, j, m: True)
    rng = random.Random(6)
    for _ in range(150):
        w = [0 if rng.random() < 0.93 else 1 for _ in range(rng.randrange(120))]
        assert P.runs(w, 6, 4) == brute_runs(w, 6, 4) and P.runs(w, 2, 2) == brute_runs(w, 2, 2)


def test_runs_of_long_texts_take_no_square_time():
    n = 300_000
    assert P.runs([0] * n) == [(0, n, 1)] and P.runs([0, 1, 2] * (n // 3)) == [(0, n, 3)] and P.runs(fibonacci(n)) == []
    morse = [bin(i).count("1") % 2 for i in range(1 << 14)]
    assert P.runs(morse * 8) == [(0, 8 << 14, 1 << 14)]


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_detected(spark):
    texts = [None, "", " \t ", "one", "ha " * 9 + "end", "A b\tA b\x0bA b\x0cA b é\u2003é", "ab cd " * 500, "x " * 40_000, "no repeat at all in this", "ha " * 9 + "end", "a a a a a a b b b b b b", "İ İ İ İ İ İ"]
    docs = spark.createDataFrame([(i, t, "kept", "gives way") for i, t in enumerate(texts)], f"doc_id bigint, text string, {ODD_DDL} string, Runs string")
    got = P.detected(docs)
    assert got.columns == ["doc_id", "text", ODD, "runs", "collapsed"]
    for r in got.collect():
        w = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        found = [(0, len(w), 1)] if len(w) == 40_000 else brute_runs(w, 6, 4)
        assert [tuple(x) for x in r["runs"]] == found and r["collapsed"] == collapsed(w, found) and (r["text"], r[ODD]) == (texts[r["doc_id"]], "kept")
    assert P.detected(docs.limit(0)).count() == 0
    assert [tuple(x) for x in P.detected(docs.where("doc_id = 10"), min_length=7).first()["runs"]] == []
    # bytes that are no UTF-8 come through
    broken = spark.sql("SELECT CAST(X'61FF2061FF2061FF2061FF2061FF2061FF' AS STRING) AS text")
    assert P.detected(broken).selectExpr("hex(collapsed)", "size(runs)").first()[:] == ("61FF", 1)
    with pytest.raises(ValueError):
        P.runs([1] * 9, 2, 1)


def test_query_of_periodic_runs(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "w", *(" ".join(rng.choice(["p", "q", "r", "é"] + [f"x{i}" for i in range(k)]) for _ in range(rng.randrange(90))) for k in [0, 0, 1, 20] * 30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a a"), (5, "second row of an id")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w, 6, 4)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(collapsed(w, found))))
    got = Q.op12_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert sum(r[1] for r in want) > 8 and sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


# --- resampling


def brute_series(rows, signal, cap, bucket, zone):
    best = {}
    for c, ts, x, i in rows:
        if c is None or ts is None or x is None or x != x or abs(x) == float("inf"):
            continue
        t = (ts.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(seconds=1)
        v = int((100.0 * x + 0.5) // 1)
        best[c, t] = max(best.get((c, t), (-1, -1)), (-1 if i is None else i, v))
    at = lambda t: dt.datetime.fromtimestamp(t, ZoneInfo(zone))

    def start(t):
        if bucket != "day":
            return t // bucket * bucket
        return int(dt.datetime.combine(at(t).date(), dt.time(), ZoneInfo(zone)).timestamp())

    out = {}
    series = {}
    for (c, t), (_, v) in best.items():
        series.setdefault(c, []).append((t, v))
    for c, points in series.items():
        points.sort()
        for k, (t, v) in enumerate(points):
            b = out.setdefault((c, start(t)), [0, 0, 0])
            b[0] += 1
            after = points[k + 1] if k + 1 < len(points) else None
            if signal == "step":
                d, w = min(cap, after[0] - t) if after else cap, v
            elif after and after[0] - t <= cap:
                d, w = after[0] - t, after[1]
            else:
                continue
            area = lambda u: 2 * v * u + (w - v) * u * u // d  # noqa: B023, E731
            for u in range(d):
                b = out.setdefault((c, start(t + u)), [0, 0, 0])
                b[1] += 1
                b[2] += area(u + 1) - area(u)
    return sorted(((c, s, n, sec, a if abs(a) < 1 << 63 else None, a // (2 * sec) if sec else None) for (c, s), (n, sec, a) in out.items()), key=lambda r: r[:2])


SCHEMA = f"client_id bigint, ts timestamp_ntz, value double, click_id bigint, {ODD_DDL} string, area2 string, k string, t string, b string, n string"


@pytest.mark.parametrize("signal", ["step", "linear"])
@pytest.mark.parametrize("bucket, zone, cap", [("day", "Europe/Berlin", 900), ("day", "America/Havana", 900), (60, "UTC", 100), ("day", "Asia/Kathmandu", 7000)])
def test_resampled(spark, signal, bucket, zone, cap):
    rng = random.Random(cap + len(zone))
    begins = [dt.datetime(2024, 3, 30, 22, 50), dt.datetime(2024, 3, 31, 0, 30), dt.datetime(2024, 10, 27, 22, 55), dt.datetime(1969, 12, 31, 22, 40), dt.datetime(2024, 3, 10, 4, 50), dt.datetime(2024, 11, 3, 3, 50)]
    rows = []
    for c, start in enumerate(begins):
        t = start
        for i in range(40):
            t += dt.timedelta(seconds=rng.choice([0, 0.4, 1, 3, 59, 300, 899, 900, 901, 1799]))
            rows.append((c % 5, t, rng.choice([-3.335, 0.0, 1.005, 77.7, -1e4, 12.25]), rng.randrange(30)))
    rows += [(None, begins[0], 1.0, 1), (1, None, 1.0, 1), (1, begins[0], None, 1), (1, begins[0], float("nan"), 1), (1, begins[0], float("inf"), 1), (9, begins[0], 1e14, 1), (9, begins[0] + dt.timedelta(seconds=77), -9e14, 1)]
    rows += rows[:50] + [(9, begins[0], 2e14, None), (8, begins[1], 5.0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    zone_before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session)
            got = R.resampled(df, signal=signal, cap=cap, bucket=bucket, zone=zone)
            key = lambda r: (r[0], r[1])
            assert sorted((tuple(r) for r in got.collect()), key=key) == brute_series(rows, signal, cap, bucket, zone)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone_before)


def test_resampled_at_any_size(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, at + dt.timedelta(seconds=s), v, 1) for s, v in ((0, 9e16), (7, -9e16), (900, 9e16), (1000, 1e300), (1001, 4e15), (1100, 3e15))]
    df = spark.createDataFrame([(*r, *"xxxxxx") for r in rows], SCHEMA)
    # 1e300 has no long of cents and is left out
    assert [tuple(r) for r in R.resampled(df).collect()] == brute_series([r for r in rows if r[2] < 1e300], "linear", 900, "day", "UTC")
    assert R.resampled(df.limit(0)).count() == 0
    for wrong in ({"signal": "cubic"}, {"cap": 0}, {"bucket": "week"}, {"bucket": 0}):
        with pytest.raises(ValueError):
            R.resampled(df, **wrong)


def test_resampled_shares_the_shuffle_of_points(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1.0, 1, *"xxxxxx")], SCHEMA)
    out = R.resampled(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and not re.search("Window|Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
