"""Paged services against a local server: pages, pruned years, retries, refusals."""

import hashlib
import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from kerbline.sources import extracts, incidents, rest

BOX = (-71.2, 42.3, -71.0, 42.4)
N = {2021: 0, 2022: 7, 2023: 10, 2024: 25}


def crash(year, i):
    at = None if i % 3 == 0 else {"x": -71.1, "y": 42.35}
    return {"attributes": {"CRASH_NUMB": f"{year}-{i}", "CRASH_DATE": 1_700_000_000_000, "CRASH_SEVERITY_DESCR": "Fatal injury", "LAT": 42.3, "LON": -71.1, "OTHER": None}, "geometry": at}


@pytest.fixture
def service():
    asked, broken = [], {}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            at, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((at.path, q))
            left = broken.get((at.path, q.get("resultOffset")), 0)
            if left or at.path == "/missing" or q.get("bbox", "").startswith("1.0"):
                broken[(at.path, q.get("resultOffset"))] = left - 1
                self.send_error(503 if left else 404)
                return
            if at.path == "/images":
                body = {"data": [{"id": f"i{q['bbox']}", "captured_at": 1_700_000_000_000, "compass_angle": 365.0, "computed_geometry": {"coordinates": [0.5, 0.5]}}]}
            else:
                year, start, size = int(at.path.rsplit("/", 1)[1]), int(q["resultOffset"]), int(q["resultRecordCount"])
                body = {"features": [crash(year, i) for i in range(start, min(N[year], start + size))], "exceededTransferLimit": start + size < N[year]}
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, broken
    server.shutdown()


def test_all_pages_of_all_years(spark, service, tmp_path):
    url, asked, broken = service
    broken[("/layer/2024", "10")] = 2
    rows = rest.incident_features(spark, url + "/layer/{year}", BOX, 2021, 2024, page_size=5, backoff=0.01)
    got = sorted(incidents.marshal(rows, "p", 1).select("provider_incident_id", "lat", "lon", "severity").collect())
    assert rows.rdd.getNumPartitions() == 4
    for year, n in N.items():  # the same as landed pages
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "p.json").write_text(json.dumps({"features": [crash(year, i) for i in range(n)], "exceededTransferLimit": False}))
    landed = incidents.marshal(incidents.read_pages(spark, str(tmp_path)), "p", 1).select("provider_incident_id", "lat", "lon", "severity").collect()
    assert got == sorted(landed) and len(got) == sum(N.values())
    of_2024 = [q["resultOffset"] for at, q in asked if at == "/layer/2024"]
    assert of_2024.count("10") >= 3 and set(of_2024) == {"0", "5", "10", "15", "20"} and asked[0][1]["geometry"] == "-71.2,42.3,-71.0,42.4"


def test_unwanted_years_are_not_asked(spark, service):
    url, asked, _ = service
    rows = rest.incident_features(spark, url + "/layer/{year}", BOX, 2022, 2023, page_size=50)
    assert rows.count() == 17 and {at for at, _ in asked} == {"/layer/2022", "/layer/2023"}
    assert rows.where("year = 2022").union(rows.where("year = 2023")).count() == 17
    asked.clear()
    assert rest.incident_features(spark, url + "/layer/{year}", BOX, 2023, 2022).count() == 0 and not asked


def test_retries(service):
    url, asked, broken = service
    with pytest.raises(urllib.error.HTTPError):
        rest.get_json(url + "/missing", {})
    assert len(asked) == 1
    broken[("/layer/2022", "0")] = 9
    pauses = []
    with pytest.raises(urllib.error.HTTPError):
        list(rest.pages(url + "/layer/2022", {}, 5, attempts=3, sleep=pauses.append))
    assert pauses == [0.5, 1.0]
    pace = rest.Pace(60)
    pace.left = 0.5
    pace.wait(pauses.append)
    assert pauses[-1] == pytest.approx(0.5, abs=0.05)


def test_images_of_boxes(spark, service):
    url, asked, _ = service
    boxes = spark.createDataFrame([(1, 0, 0.4, 0.4, 0.6, 0.6), (2, 1, 1.0, 0.0, 2.0, 1.0)], "segment_id long, sample_index int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {r["segment_id"]: r for r in rest.images(boxes.coalesce(1), url + "/images", token="t").collect()}
    assert got[1]["lon"] == 0.5 and got[1]["error"] is None and "404" in got[2]["error"] and got[2]["id"] is None
    assert asked[0][1]["access_token"] == "t" and asked[0][1]["bbox"] == "0.400000,0.400000,0.600000,0.600000"
    assert rest.images(boxes.limit(0), url).count() == 0


def test_an_extract_is_fetched_once(spark, tmp_path):
    asked, body = [], [b"x" * 1000]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, data):
            asked.append(self.command)
            self.send_response(200)
            self.send_header("Content-Length", str(len(body[0])))
            self.send_header("Last-Modified", "Sat, 07 Jun 2025 10:00:00 GMT")
            self.end_headers()
            self.wfile.write(data)

        def do_HEAD(self):
            self.reply(b"")

        def do_GET(self):
            self.reply(body[0] if self.path == "/x.pbf" else body[0][:10])

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, into = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "d" / "x.pbf")
    try:
        first = extracts.snapshot(spark, url + "/x.pbf", into).first()
        assert (first["size_bytes"], str(first["osm_snapshot_date"]), first["cached"]) == (1000, "2025-06-07", False) and first["sha256"] == hashlib.sha256(body[0]).hexdigest()
        assert extracts.snapshot(spark, url + "/x.pbf", into).first()["cached"] and asked.count("GET") == 1
        body[0] = b"y" * 1001
        assert not extracts.fetch(url + "/x.pbf", into)["cached"] and asked.count("GET") == 2
        body[0] = b"z" * 5000
        with pytest.raises(OSError):
            extracts.fetch(url + "/broken", into)
        assert (tmp_path / "d" / "x.pbf").read_bytes() == b"y" * 1001 and len(list((tmp_path / "d").iterdir())) == 1
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(OSError):  # nobody answers: tried and left as it was
        extracts.fetch(url + "/x.pbf", into, timeout=1)
    assert (tmp_path / "d" / "x.pbf").exists()
