import json

import pytest
from pyspark.sql import functions as F

from siftwork.plans.ingest import admit_early, admitted, ingest, judge, scrape_stats
from siftwork.sources import payloads as L
from siftwork.sources import profiles as P

RAW = "profile string, source string, company string, fetched_at timestamp, payload string"


@pytest.fixture(scope="module")
def as_of():
    return F.lit("2025-01-31").cast("timestamp")


def raw_rows(spark, *rows):
    data = [("p", source, company, json.dumps(payload)) for source, company, payload in rows]
    df = spark.createDataFrame(data, "profile string, source string, company string, payload string")
    return df.withColumn("fetched_at", F.lit("2025-01-30").cast("timestamp")).select("profile", "source", "company", "fetched_at", "payload")


def all_payloads():
    fresh, stale = "2025-01-20T00:00:00Z", "2024-11-01T00:00:00Z"
    green = {"jobs": [
        {"id": 1, "title": "Software Engineer", "updated_at": fresh, "location": {"name": "Austin, TX"}, "absolute_url": "u1", "content": "&lt;p&gt;python&lt;/p&gt;"},
        {"id": 2, "title": "Software Engineer", "updated_at": stale, "location": {"name": "Austin, TX"}, "content": "old"},
        {"id": 3, "title": "Chef", "updated_at": fresh, "content": "x"},
        {"id": 4, "title": "Senior Engineer", "updated_at": fresh, "location": {"name": "Austin, TX"}, "content": "x"},
        {"id": 5, "title": "Engineer", "updated_at": fresh, "content": "unpaid"},
        {"id": 1, "title": "Engineer again", "updated_at": fresh, "location": {"name": "Remote"}, "content": "dup"},
    ]}
    lever = [{"id": "L1", "text": "Backend Engineer", "createdAt": 1737300000000, "categories": {"location": "Anywhere"},
              "workplaceType": "remote", "hostedUrl": "u", "description": "<b>Do</b>", "lists": [{"content": "<li>A</li>"}, {"content": "<li>B</li>"}]}]
    ashby = {"jobs": [{"id": "A1", "title": "Engineer", "locationName": "NYC", "jobUrl": "ua", "descriptionPlain": "plain", "publishedAt": fresh},
                      {"id": "A2", "title": "Engineer", "isListed": False}]}
    work = {"results": [{"shortcode": "W1", "title": "Engineer", "telecommuting": True, "url": "uw", "description": "<p>hi</p>",
                         "published_on": "2025-01-20", "department": "Core"},
                        {"id": "W2", "title": "Engineer", "city": "Paris", "country": "France", "published_on": "2025-01-20"}]}
    hima = {"jobs": [{"guid": "g1", "title": "Engineer", "company": {"name": "Nested"}, "description": "d", "pubDate": 1737300000},
                     {"id": "H2", "title": "Designer", "companyName": "Own", "description": "d", "pubDate": 1737300000}]}
    search = {"hits": [{"objectID": "9", "title": "Old", "author": "whoishiring", "created_at_i": 1735700000},
                       {"objectID": "10", "title": "New", "author": "whoishiring", "created_at_i": 1737300000},
                       {"objectID": "11", "title": "Fake", "author": "x", "created_at_i": 1738000000}]}
    text = "Acme | Software Engineer | Austin<p>We are hiring python people for our remote team, apply now"
    return [
        ("greenhouse", "acme", green), ("lever", "beta", lever), ("ashby", "cosy", ashby), ("workable", "dune", work),
        ("himalayas", "", hima), ("hackernews", "", search), ("hackernews", "", {"id": 10, "kids": [101, 102, 103]}),
        ("hackernews", "", {"id": 9, "kids": [101]}), ("hackernews", "", {"id": 101, "text": text}),
        ("hackernews", "", {"id": 102, "text": "short"}), ("hackernews", "", {"id": 999, "text": text}),
        ("hackernews", "", {"id": 103, "text": "Chef wanted in a very nice kitchen somewhere in the world, really"}),
    ]


def test_normalizers(spark, as_of):
    rows = {r["id"]: r for r in L.normalize_all(raw_rows(spark, *all_payloads()), as_of).collect()}
    assert rows["lever_L1"]["description"] == "Do A B"
    assert rows["lever_L1"]["filter_location"] == "Remote" and rows["lever_L1"]["location"] == "Anywhere"
    assert "Workplace: remote" in rows["lever_L1"]["raw_text"] and "Company: BETA" in rows["lever_L1"]["raw_text"]
    assert rows["ashby_A1"]["location"] == "NYC" and "ashby_A2" not in rows
    assert rows["workable_W1"]["location"] == "Remote" and rows["workable_W1"]["description"] == "hi\nDepartment: Core"
    assert rows["workable_W2"]["location"] == "Paris, France"
    assert rows["himalayas_g1"]["company"] == "Nested" and rows["himalayas_g1"]["location"] == "Remote"
    assert rows["himalayas_H2"]["company"] == "Own"
    assert rows["greenhouse_3"]["location"] == "Unknown"
    thread = rows["hackernews_101"]
    assert thread["title"].startswith("Acme | Software Engineer") and "Thread: New" in thread["raw_text"]
    assert "hackernews_102" not in rows and "hackernews_999" not in rows


SINGLE = [L.normalize_greenhouse, L.normalize_lever, L.normalize_ashby, L.normalize_workable, L.normalize_himalayas]

ODD = [
    ("greenhouse", "not json"), ("greenhouse", '{"jobs": [{"id": 7, "title": "cut'), ("greenhouse", None), ("greenhouse", "{}"), ("greenhouse", '{"jobs": null}'),
    ("greenhouse", '{"jobs": []}'), ("greenhouse", '{"jobs": [{"id": 12345678901234567890, "title": null, "content": "a &amp; b"}, {}]}'),
    ("greenhouse", '{"jobs": [{"id": "g", "title": 5, "updated_at": 1737300000, "location": {"name": null}}], "meta": {"total": 1}}'),
    ("lever", '[{"id": "L2", "text": "T", "createdAt": "1737300000000", "lists": null}, {"id": "L3", "lists": [{"content": null}, {}]}]'),
    ("ashby", '{"jobPostings": [{"id": "", "jobUrl": "u", "title": "E", "secondaryLocations": [{"location": "A"}, {"location": ""}, {}], "isListed": null}]}'),
    ("ashby", '{"jobs": [], "jobPostings": [{"id": "hidden by the empty list"}]}'),
    ("workable", '{"results": [{"id": "W", "title": "E", "location": {"city": "X", "state": "Y"}, "telecommuting": null, "function": "F"}]}'),
    ("workable", '{"jobs": [{"shortcode": "s", "locations": [{"city": "A", "country": "B"}, {"country": "C"}], "created_at": 1737300000}]}'),
    ("himalayas", '{"jobs": [{"guid": "g", "company": "plain", "locationRestrictions": ["A", "B"], "pubDate": "2025-01-20"}]}'),
    ("himalayas", '{"jobs": [{"id": 3, "company": {"name": "N", "x": [1]}, "description": "\\u00e9 <b>x</b>"}]}'),
    ("nobody", '{"jobs": [{"id": 1}]}'), (None, '{"jobs": [{"id": 1}]}'),
]


def test_one_pass_gives_what_the_single_sources_give(spark, as_of):
    odd = spark.createDataFrame([("p", s, "acme", p) for s, p in ODD], "profile string, source string, company string, payload string")
    odd = odd.withColumn("fetched_at", F.lit("2025-01-30").cast("timestamp")).select("profile", "source", "company", "fetched_at", "payload")
    raw = raw_rows(spark, *all_payloads()).unionByName(odd)
    together = sorted(map(repr, L.normalize_all(raw, as_of).where("source <> 'hackernews'").collect()))
    apart = sorted(repr(r) for build in SINGLE for r in build(raw).collect())
    assert together == apart and len(together) > 20


def test_an_error_in_place_of_a_list_is_no_posting(spark):
    raw = raw_rows(spark, ("lever", "acme", {"ok": False, "error": "not found"}), ("greenhouse", "acme", {"status": 404}))
    assert L._boards(raw).collect() == []


def test_boards_are_scanned_once(spark, as_of, tmp_path):
    raw_rows(spark, *all_payloads()).write.parquet(str(tmp_path / "landing"))
    landing = spark.read.parquet(str(tmp_path / "landing"))

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:]

    assert len(scans(L._boards(landing))) == 1
    whole = scans(L.normalize_all(landing, as_of))
    others = [x for x in whole if "EqualTo(source,hackernews)" in x]
    assert len(whole) - len(others) == 1


def test_filters_on_comments_do_not_parse_payloads_again(spark, as_of, tmp_path):
    raw_rows(spark, *all_payloads()).write.parquet(str(tmp_path / "raw"))
    rows = L.normalize_thread(spark.read.parquet(str(tmp_path / "raw")), as_of)
    plan = rows.where(F.contains("title", F.lit("Engineer")))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan
    assert not [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter") and "from_json" in x]


def test_fixed_columns_are_built_once(spark, as_of):
    raw = raw_rows(spark, *all_payloads())
    L.normalize_all(raw, as_of)
    assert L._texts(50) is L._texts(50) and L._texts(50) is not L._texts(60)
    assert L._board_columns() is L._board_columns()


def test_funnel_and_store(spark, profile_rows, as_of):
    normalized = L.normalize_all(raw_rows(spark, *all_payloads()), as_of)
    judged = judge(normalized, profile_rows(), as_of)
    stored = {(r["id"], r["scrape_filter_reason"]) for r in admitted(judged).collect()}
    assert ("greenhouse_4", "title_blocklist: senior") in stored
    assert ("workable_W2", "non_us_location") in stored
    assert not any(i in ("greenhouse_2", "greenhouse_3", "greenhouse_5") for i, _ in stored)
    early = {(r["id"], r["scrape_filter_reason"]) for r in admit_early(normalized, profile_rows(), as_of).collect()}
    assert early == stored
    empty = normalized.select("profile", "source", "id").limit(0)
    stats = {r["source"]: (r["jobs_scraped"], r["jobs_filtered"], r["jobs_saved"]) for r in scrape_stats(judged, empty).collect()}
    assert stats["greenhouse"] == (4, 2, 1)  # one id twice: scraped twice, saved once
    assert stats["workable"] == (2, 1, 1)
    assert stats["himalayas"] == (1, 1, 1)  # the mismatch is filtered but not scraped
    assert stats["hackernews"] == (2, 1, 1)  # the mismatch is scraped and filtered
    assert stats[None] == tuple(sum(v[i] for k, v in stats.items() if k) for i in range(3))


def test_sources_can_be_switched_off(spark, profile_rows, as_of):
    on = F.struct(*[F.lit(s in ("lever", "ashby")).alias(s) for s in ("greenhouse", "lever", "hn", "ashby", "workable", "himalayas")])
    profiles = profile_rows().withColumn("sources_enabled", on)
    rows = ingest(raw_rows(spark, *all_payloads()), profiles, as_of).collect()
    assert {r["source"] for r in rows} == {"lever", "ashby"}


def test_read_profiles(spark, tmp_path):
    full = {"profile_id": "a", "profile": {"name": "A", "titles": ["X"]}, "preferences": {"titles": ["Y"], "yoe": 2,
            "filters": {"max_yoe": 4}, "location": {"remote_ok": False}}, "scoring": {"weights": {"role_fit": 0.4}},
            "sources": {"hn": {"enabled": True}, "lever": {"companies": ["one", "two"]}}}
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps(full) + "\n" + json.dumps({"profile_id": "b"}) + "\n")
    rows = {r["profile"]: r for r in P.read_profiles(spark, str(path)).collect()}
    a, b = rows["a"], rows["b"]
    assert a["titles"] == ["X"] and a["max_yoe"] == 4 and a["remote_ok"] is False and a["weights"]["role_fit"] == 0.4
    assert a["sources_enabled"]["hn"] and b["sources_enabled"]["greenhouse"] and not b["sources_enabled"]["ashby"]
    assert (b["min_yoe"], b["max_yoe"], b["max_job_age_days"], b["min_display_score"]) == (0, 99, 30, 60)
    assert b["weights"]["stack_match"] == 0.25 and b["titles"] == []
