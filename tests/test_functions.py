import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, risk, solar


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first().asDict()


def test_composite_golden(spark):
    local = risk.local_aggregate(F.lit(0.8), F.lit(0.5), F.lit(0.6), F.lit(0.4))
    r = one(spark, local=local, none=risk.local_aggregate(F.lit(0.8), F.lit(None).cast("double"), F.lit(0.6), F.lit(0.4)))
    assert r["local"] == pytest.approx(0.61) and r["none"] == pytest.approx(0.46)


def test_incident_weight(spark):
    w = lambda d, a, s: risk.incident_weight(F.lit(d), F.lit(a), F.lit(s))
    r = one(spark, a=w(0.0, 0.0, "unknown"), b=w(0.0, 365.0, "unknown"), c=w(0.0, 0.0, "fatal"), d=w(0.0, -5.0, "injury"))
    assert [r[k] for k in "abcd"] == pytest.approx([1.0, 0.5, 3.0, 2.0])


def test_junction_dead_end_is_zero(spark):
    assert one(spark, s=risk.junction_score(F.lit(1), F.lit(90.0), F.lit(0), F.lit(0)))["s"] == 0


def test_straight_continuation_counts_as_sharpest_merge(spark):
    r = one(spark, a=geo.angle_between(F.lit(10.0), F.lit(10.0)), b=geo.angle_between(F.lit(350.0), F.lit(20.0)), m=risk.merge_score(F.lit(1.0)))
    assert (r["a"], r["b"]) == (1.0, 30.0) and r["m"] == pytest.approx(89 / 90)


def test_sun_and_glare(spark):
    def at(text, lat=42.37, lon=-71.11):
        z, e = solar.position(F.lit(lat), F.lit(lon), F.unix_timestamp(F.lit(text).cast("timestamp")).cast("double"))
        return one(spark, z=z, e=e)

    noon, morning, night = at("2025-06-21 16:50:00"), at("2025-06-21 10:30:00"), at("2025-06-21 05:00:00")
    assert noon["e"] > 60 and 0 < morning["e"] < 30 and night["e"] < 0
    assert abs(noon["z"] - 180) < 5
    score = one(spark, g=solar.glare(geo.axis_angle(F.lit(90.0), F.lit(morning["z"])), F.lit(morning["e"])), o=solar.glare(F.lit(0.0), F.lit(90.0)), n=solar.glare(F.lit(0.0), F.lit(-1.0)))
    assert score["g"] > 0.6 and score["o"] == 0 and score["n"] == 0


def test_sun_against_published_places(spark):
    """Of the nautical kind, to a few hundredths of a degree: solstice noon heights follow from latitude and tilt alone, and equinox suns rise due east."""
    def at(text, lat, lon):
        z, e = solar.position(F.lit(lat), F.lit(lon), F.unix_timestamp(F.lit(text).cast("timestamp")).cast("double"))
        return one(spark, z=z, e=e)

    top = max(at(f"2025-06-21 16:{m:02d}:00", 42.3736, -71.1097)["e"] for m in range(40, 55))
    assert top == pytest.approx(90 - 42.3736 + 23.4357, abs=0.02)
    low = max(at(f"2025-12-21 16:{m:02d}:00", 42.3736, -71.1097)["e"] for m in range(36, 50))
    assert low == pytest.approx(90 - 42.3736 - 23.4357, abs=0.08)  # with refraction
    rise = at("2025-03-20 06:07:00", 0.0, 0.0)
    assert rise["z"] == pytest.approx(90, abs=0.2) and abs(rise["e"]) < 1.0
    assert at("2025-03-20 12:07:30", 0.0, 0.0)["e"] == pytest.approx(90, abs=0.3)


def test_clipping(spark):
    n = 2.0**14
    lon = lambda px: (px / 4096 + 8000) / n * 360 - 180
    lat = lambda py: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (py / 4096 + 6000) / n))))

    def clip(*points):
        line = F.array(*(geo.point(F.lit(lon(x)), F.lit(lat(y))) for x, y in points))
        return [tuple(r) for r in one(spark, g=geo.clipped(line, F.lit(14), F.lit(8000), F.lit(6000)))["g"]]

    assert clip((100, 100), (200, 300)) == [(0, 100, 100, 200, 300)]
    assert clip((-1000, 100), (1000, 100), (1000, 9000)) == [(0, -256, 100, 1000, 100), (1, 1000, 100, 1000, 4352)]
    assert clip((-1000, -1000), (-300, 5000)) == [] and clip((5000, 100), (6000, 100)) == []
    assert clip((-1000, -1000), (5000, 5000)) == [(0, -256, -256, 4352, 4352)]


def test_confidence_ties(spark):
    v, n = risk.confidence(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    v2, n2 = risk.confidence(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    r = one(spark, v=v, n=n, v2=v2, n2=n2)
    assert (r["n"], r["n2"]) == ("freshness", "coverage")


def test_version_split(spark):
    cases = {"pagerank-diffusion-0.1.0": ("pagerank-diffusion", "0.1.0"), "none-phase-2": (None, None), "odd": ("odd", "")}
    for v, want in cases.items():
        r = one(spark, n=risk.version_name(F.lit(v)), s=risk.version_number(F.lit(v)))
        assert (r["n"], r["s"]) == want


def test_stub_hash_equals_xxhash(spark):
    import xxhash

    got = one(spark, u=risk.stub_hash(F.lit("abc"), "composite"))["u"]
    assert got == pytest.approx(xxhash.xxh64_intdigest(b"compositeabc", 0) / 2**64, abs=1e-12)


def test_lines(spark):
    line = F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.003, 0.0), (0.003, 0.001))))
    r = one(spark, n=geo.line_length(line), c=geo.centroid(line), m=geo.interpolate(line, F.lit(0.5)), w=geo.waypoint_count(line), k=geo.waypoints(line))
    assert r["n"] == pytest.approx(0.004) and r["m"]["lon"] == pytest.approx(0.002) and r["w"] == 5
    assert r["c"]["lon"] == pytest.approx((0.0015 * 3 + 0.003) / 4) and [x["fraction"] for x in r["k"]] == [0, 0.25, 0.5, 0.75, 1]


def test_tiles(spark):
    r = one(spark, x=geo.tile_x(F.lit(-71.11), 14), y=geo.tile_y(F.lit(42.37), 14))
    x0, y0, x1, y1 = geo.tile_box(14, r["x"], r["y"])
    assert x0 <= -71.11 <= x1 and y0 <= 42.37 <= y1 and math.isclose(x1 - x0, 360 / 2**14)


def test_display(spark):
    r = one(spark, a=risk.delta_class(F.lit(0.005)), b=risk.delta_class(F.lit(0.15)), c=risk.delta_class(F.lit(-0.1)), s=risk.signed3(F.lit(-0.0001)), k=risk.colour_bucket(F.lit(1.0), F.lit(False)), n=risk.colour_bucket(F.lit(float("nan")), F.lit(False)))
    assert (r["a"], r["b"], r["c"], r["s"], r["k"], r["n"]) == ("neutral", "heavy_increase", "decrease", "+0.000", 4, -1)
