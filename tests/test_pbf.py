"""Binary extracts, written here block by block, against the XML of the same extract."""

import random
import struct
import zlib

import numpy as np
import pytest

from kerbline.sources import osm, pbf


def number(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def zigzag(n):
    return number(n << 1 if n >= 0 else ~(n << 1))


def field(k, v):
    return number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v


def differences(xs):
    return b"".join(zigzag(b - a) for a, b in zip([0, *xs], xs, strict=False))


def blob(kind, data, raw=False):
    body = field(1, data) if raw else field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


class Text:
    def __init__(self):
        self.all = [b""]

    def __call__(self, s):
        s = s.encode()
        if s not in self.all:
            self.all.append(s)
        return self.all.index(s)

    def table(self):
        return field(1, b"".join(field(1, s) for s in self.all))


def dense_block(nodes, offsets=(0, 0), raw=False):
    t = Text()
    units = lambda v, off: (round(v * 1e9) - off) // 100
    told = b"".join(b"".join(number(t(k)) + number(t(v)) for k, v in n[3].items()) + b"\0" for n in nodes)
    dense = field(1, differences([n[0] for n in nodes])) + field(8, differences([units(n[1], offsets[0]) for n in nodes])) + field(9, differences([units(n[2], offsets[1]) for n in nodes])) + field(10, told)
    return blob(b"OSMData", t.table() + field(2, field(2, dense)) + field(19, offsets[0]) + field(20, offsets[1]), raw)


def way_block(ways, plain_nodes=()):
    t = Text()
    group = b""
    for i, refs, tags in ways:
        group += field(3, field(1, i) + field(2, b"".join(number(t(k)) for k in tags)) + field(3, b"".join(number(t(v)) for v in tags.values())) + field(8, differences(refs)))
    own = b"".join(field(1, number(1 << 3) + zigzag(i) + number(8 << 3) + zigzag(round(lat * 1e7)) + number(9 << 3) + zigzag(round(lon * 1e7))) for i, lat, lon in plain_nodes)
    return blob(b"OSMData", t.table() + field(2, group) + (field(2, own) if own else b""))


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    rng = random.Random(5)
    nodes = [(10**10 + 3 * i, round(rng.uniform(42.3, 42.4), 7), round(rng.uniform(-71.2, -71.0), 7), {"note": "ü"} if i % 7 == 0 else {}) for i in range(100)]
    late = [(5, -33.5, 151.25), (-6, 42.35, -71.1)]
    ids = [n[0] for n in nodes] + [5, -6]
    ways = [(k + 1, [rng.choice(ids) for _ in range(rng.randint(1, 9))], {"highway": "primary", "name": "Straße"} if k % 3 else {"building": "yes"}) for k in range(60)]
    ways += [(900, [5, 777], {"highway": "service"}), (901, [5, -6], {"highway": "service"}), (902, [], {"highway": "x"}), (903, [5], {})]
    d = tmp_path_factory.mktemp("pbf")
    data = blob(b"OSMHeader", field(4, b"OsmSchema-V0.6"))
    data += b"".join(dense_block(nodes[k : k + 10], (10**9, -(10**9)) if k % 20 else (0, 0), raw=k == 30) for k in range(0, 100, 10)) + way_block(ways[:30], late) + way_block(ways[30:])
    (d / "x.osm.pbf").write_bytes(data)
    xml = "".join(f'<node id="{i}" lat="{lat}" lon="{lon}"/>' for i, lat, lon, *_ in [*nodes, *late])
    xml += "".join(f'<way id="{i}">{"".join(f"""<nd ref="{r}"/>""" for r in refs)}{"".join(f"""<tag k="{k}" v="{v}"/>""" for k, v in tags.items())}</way>' for i, refs, tags in ways)
    (d / "x.osm").write_text(f"<osm>{xml}</osm>")
    return d, nodes, late, ways


def rows(df):
    return sorted((r["osm_way_id"], [tuple(p) for p in r["coords"]], sorted(r["attrs"].items())) for r in df.collect())


def test_blocks_equal_xml(spark, extract):
    d, nodes, late, ways = extract
    got = rows(osm.read_ways(spark, str(d / "x.osm.pbf")))
    assert got == rows(osm.read_ways(spark, str(d / "x.osm"))) and len(got) > 20
    box = (-71.15, 42.32, -71.05, 42.36)
    assert rows(osm.read_ways(spark, str(d / "x.osm.pbf"), box)) == rows(osm.read_ways(spark, str(d / "x.osm"), box))
    whole = pbf.read(spark, f"file://{d}/x.osm.pbf", split=200)
    assert whole.rdd.getNumPartitions() > 4
    assert pbf.read(spark, str(d / "x.osm.pbf"), "way").count() == len(ways)
    back = {r["id"]: r for r in whole.where("kind = 'node'").collect()}
    assert {i: (r["lat"], r["lon"]) for i, r in back.items()} == {n[0]: (n[1], n[2]) for n in [*nodes, *late]} and back[10**10]["tags"] == {"note": "ü"}
    assert {r["id"]: r["refs"] for r in whole.where("kind = 'way'").collect()} == {w[0]: w[1] for w in ways} and whole.count() == len(nodes) + 2 + len(ways)


def test_a_block_is_skipped_by_its_header(spark, extract):
    d, *_ = extract
    assert len(list(pbf.data_blocks(str(d / "x.osm.pbf")))) == 12
    plan = pbf.PbfReader({"path": str(d / "x.osm.pbf"), "split": "1", "kinds": "way"})
    assert len(plan.partitions()) == 12
    assert sum(b.num_rows for p in plan.partitions() for b in plan.read(p)) == 64


def test_numbers():
    xs = [0, 1, -1, 63, -64, 64, 2**31, -(2**40), 2**62, -(2**63), 2**63 - 1]
    assert pbf.signed(pbf.packed(b"".join(map(zigzag, xs)))).tolist() == xs and len(pbf.packed(b"")) == 0
    assert pbf.packed(b"".join(map(number, [0, 127, 128, 300, 2**64 - 1]))).tolist() == [0, 127, 128, 300, 2**64 - 1]
    assert pbf.sums(differences([5, 3, 10])).dtype == np.int64
    with pytest.raises(ValueError):
        pbf.unpack(field(4, b"x"))
