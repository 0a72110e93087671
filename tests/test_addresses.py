"""Addresses and networks as Python's ipaddress module reads them, and verdicts row by row."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from webinsight.functions import addresses as A
from webinsight.operators import common, logs

ADDRESSES = [
    "66.249.66.1", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.04", " 1.2.3.4", "1.2.3.4\n", "1.2.3.4 ", "-", "", "1.2.3.x", "1..2.3", "٣.2.3.4", "17", None,
    "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:0:1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", ":::", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
    "12345::", "g::1", "::ffff:66.249.66.1", "::66.249.66.1", "1:2:3:4:5:6:66.249.66.1", "1:2:3:4:5:6:7:66.249.66.1", "::ffff:256.0.0.1", "::1.2.3.4:5", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1.2.3.4%eth0", "::ffff:1.2.3", "1:2", ":",
]
NETWORKS = [
    "66.249.64.0/19", "66.249.64.0/20", "66.249.66.1/19", "66.249.66.1", "66.249.66.1/32", "0.0.0.0/0", "10.0.0.0/33", "10.0.0.0/-1", "10.0.0.0/", "10.0.0.0/8/8", "10.0.0.0/255.0.0.0", "10.0.0.0/0.255.255.255", "10.0.0.0/255.0.255.0", "10.0.0.0/08", "/8", "x/8", "", None,
    "2001:db8::/32", "2001:4860:4801::/48", "2001:db8::/33", "2001:db8:8000::/33", "2001:db8:4000::/33", "2001:db8::1/127", "2001:db8::2/127", "::/0", "2001:db8::1", "2001:db8::/129", "2001:db8::/255.0.0.0", "10.0.0.0/7", "11.0.0.0/7", "10.0.0.0/9", "10.128.0.0/9",
]


def key(ip):
    return f"{ip.version}{int(ip):0{ip.max_prefixlen // 4}x}"


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", A.address_key(F.col("a")).alias("k"))
    for r in df.collect():
        try:
            want = key(ipaddress.ip_address(r["a"]))
        except (ValueError, AttributeError):
            want = None
        assert r["k"] == want, r["a"]


def test_networks(spark):
    df = spark.createDataFrame([(a,) for a in NETWORKS], "a string").select("a", A.network(F.col("a")).alias("n"))
    for r in df.collect():
        try:
            net = ipaddress.ip_network(r["a"])
            want = (key(net.network_address), net.prefixlen)
        except (ValueError, AttributeError):
            want = None
        assert (tuple(r["n"]) if r["n"] else None) == want, r["a"]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_verdicts(spark, monkeypatch, most):
    """Every address against every set of networks; with nothing broadcast, hot addresses are looked up on their own."""
    monkeypatch.setattr(common.look_up, "__defaults__", (most,))
    ranges = [("google", n) for n in NETWORKS if n not in ("0.0.0.0/0", "::/0")] + [("other", "0.0.0.0/0"), ("openai", "no network")]
    nets = [ipaddress.ip_network(n) for _, n in ranges[:-2] if n and valid(n)]
    families = {"Googlebot": "google", "OpenAI": "openai", "Bing": "bing", "Nobody": None}
    rows = [(f, a) for f in families for a in ADDRESSES] + [("Googlebot", "66.249.66.1")] * 500
    hits = spark.createDataFrame(rows, "bot_family string, ip string")
    got = logs.verify_ips(hits, spark.createDataFrame(ranges, "operator string, cidr string"))
    assert got.columns == ["bot_family", "ip", "verify_state"] and got.count() == len(rows)
    for r in got.distinct().collect():
        op = families[r["bot_family"]]
        if op is None:
            want = "unverifiable"
        elif op == "bing" or not r["ip"] or not valid(r["ip"], ipaddress.ip_address):
            want = "unchecked"
        else:
            ip = ipaddress.ip_address(r["ip"])
            inside = op == "google" and any(ip.version == n.version and int(n.network_address) <= int(ip) <= int(n.broadcast_address) for n in nets)
            want = "verified" if inside else "failed"
        assert r["verify_state"] == want, r


def valid(text, read=ipaddress.ip_network):
    try:
        read(text)
    except ValueError:
        return False
    return True
