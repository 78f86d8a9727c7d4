import ipaddress
import random

from pyspark.sql import functions as F

from loghound.operators import geo

BLOCKS = "start_ip string, end_ip string, code string"


def brute(ip, blocks):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return geo.UNKNOWN_LABEL
    if a.version == 4 and (ip.startswith(("10.", "192.168.", "127.", "169.254.", "224."))
                           or (ip.startswith("172.") and 16 <= int(ip.split(".")[1]) <= 31)):
        return geo.PRIVATE_LABEL
    if a.version == 6 and (a == ipaddress.ip_address("::1") or a in ipaddress.ip_network("fc00::/7")
                           or a in ipaddress.ip_network("fe80::/10")):
        return geo.PRIVATE_LABEL
    best = None
    for s, e, code in blocks:
        try:
            lo, hi = ipaddress.ip_address(s), ipaddress.ip_address(e)
        except ValueError:
            continue
        if lo.version == hi.version == a.version and lo <= a <= hi:
            best = min(best or (0, 1 << 200, ""), (-int(lo), int(hi), code))if best else (-int(lo), int(hi), code)
    return best[2] if best else geo.UNKNOWN_LABEL


def test_keys(spark):
    texts = ["0.0.0.0", "255.255.255.255", "203.0.113.7", "256.1.1.1", "1.2.3", "::", "::1", "2001:db8::1", "1::",
             "2001:DB8:0:0:0:0:0:1", "::ffff:192.0.2.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "12345::",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "fe80::1%eth0", "", "x"]
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string")
           .select("t", geo.address_key(F.col("t")).alias("k")).collect()}
    for t in texts:
        try:
            a = ipaddress.ip_address(t if "%" not in t else "bad")
            want = f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"
        except ValueError:
            want = None
        assert got[t] == want, t


def test_against_brute_force(spark):
    rng = random.Random(9)
    blocks = [("0.0.0.0", "255.255.255.255", "WORLD"), ("203.0.113.0", "203.0.113.255", "A"), ("bad", "1.1.1.1", "X"),
              ("9.9.9.9", "9.9.9.1", "X"), ("1.0.0.0", "::2", "X"), ("2001:db8::", "2001:db8:ffff::", "D6"), (None, "1.1.1.1", "X")]
    v4 = lambda n: str(ipaddress.IPv4Address(n))
    v6 = lambda n: str(ipaddress.IPv6Address(n))
    base6 = int(ipaddress.IPv6Address("2001:db8::"))
    points, points6 = [], []
    for i in range(300):
        bits = rng.randint(0, 28)
        lo = rng.getrandbits(32) if rng.random() < 0.5 else (203 << 24) + rng.getrandbits(16)
        hi = min(2 ** 32 - 1, lo + rng.getrandbits(bits) if bits else lo)
        if rng.random() < 0.4 and bits:
            lo = lo >> bits << bits
            hi = lo + (1 << bits) - 1
        blocks.append((v4(lo), v4(hi), f"C{i}"))
        points += [lo, hi, max(0, lo - 1), min(2 ** 32 - 1, hi + 1), (lo + hi) // 2]
    for i in range(60):
        lo = base6 + rng.getrandbits(rng.choice([8, 40, 90]))
        hi = lo + rng.getrandbits(rng.choice([1, 30, 70, 95]))
        blocks.append((v6(lo), v6(hi), f"S{i}"))
        points6 += [lo, hi, hi + 1, (lo + hi) // 2]
    ips = [v4(p) for p in points] + [v6(p) for p in points6] + [
        "10.1.2.3", "172.16.0.1", "172.32.0.1", "127.0.0.1", "999.1.1.1", "", "::1", "fd00::5", "fe80::9", "x"]
    df = spark.createDataFrame([(i,) for i in ips + ips[:50] + [None]], "ip string")
    got = {r.ip: r.country for r in geo.ip_country(df, spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert len(got) == len(set(ips))
    good = [b for b in blocks if None not in b]
    assert got == {ip: brute(ip, good) for ip in set(ips)}


def test_names_and_empty_tables(spark):
    ips = spark.createDataFrame([("203.0.113.9",), ("198.51.100.1",)], "ip string")
    blocks = spark.createDataFrame([("203.0.113.0", "203.0.113.255", "AA"), ("198.51.100.0", "198.51.100.255", "BB")], BLOCKS)
    names = spark.createDataFrame([("AA", "Name of AA"), ("AA", "Other")], "code string, name string")
    got = {r.ip: r.country for r in geo.ip_country(ips, blocks, names).collect()}
    assert got == {"203.0.113.9": "Name of AA", "198.51.100.1": "BB"}
    assert {r.country for r in geo.ip_country(ips, blocks.limit(0)).collect()} == {geo.UNKNOWN_LABEL}
    assert geo.ip_country(ips.limit(0), blocks).count() == 0
