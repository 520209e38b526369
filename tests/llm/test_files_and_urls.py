"""WARC archives, media archives and URL trust."""

import base64
import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from phenoquarry.llm import media, storage, urltrust, warc
from phenoquarry.llm.common import workdir

# Rules of the contract, restated.
PAGES = [
    (1, "http://www.example.com/en/a", "<a href='https://bad.net/es/x'>"), (2, "http://a.example.com/en/b", None), (3, "https://bad.net/es/1", "same"), (4, "https://bad.net/xx", "same"),
    (5, "https://friend.org/x", '<a href="http://bad.net/">x</a>'), (6, "https://good.org/", ""), (7, None, ""), (8, "no scheme", "same"), (9, "HTTP://Trusted.COM/?q=://x", '<A HREF = "//good.org/y">'), (9, "HTTP://Trusted.COM/?q=://x", '<A HREF = "//good.org/y">'), (10, "http://com", "é"), (None, "http://x.com/a", "é"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "clash", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, revisit int").repartition(4).cache()


def test_round_trip(spark, pages):
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(-1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        b, top = (h or "").encode(), max(groups[h or ""])
        own = (-1 if i is None else i) == top
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else top))
    rows = warc.round_trip(pages).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    order = [(r.url_key, r.captured_at) for r in sorted(rows, key=lambda r: (r.part, r.position))]
    assert order == sorted(order)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted([rng.choice("abc"), "t", rng.randrange(9), i] for _ in range(rng.randrange(20))) for i in range(k)]
    got = [e[:3] for e in warc.LoserTree([iter(r) for r in runs])]
    assert got == [e[:3] for e in heapq.merge(*runs)]


def test_many_runs_merge_in_passes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "INDEX_BLOCK", 2)
    folder, made, keys = workdir(spark, "runs"), [], []
    rng = random.Random(1)
    for i in range(11):
        own = sorted([f"k{rng.randrange(50):02d}", "t", 100 * i + j, str(100 * i + j), "a", 0, 0] for j in range(20))
        w = warc.RunWriter(f"{folder}/r{i}.run")
        for e in own:
            w.add(e)
        n, fences = w.close()
        made.append((f"r{i}.run", n, __import__("json").dumps(fences)))
        keys += [e[:3] for e in own]
    out = warc.merge_runs(spark, folder, spark.createDataFrame(made, warc.RUN)).collect()
    got = [[r.url_key, r.captured_at, int(r.page_id)] for r in sorted(out, key=lambda r: (r.part, r.position))]
    assert got == sorted(keys)


def test_any_text_is_a_page_id(spark):
    rows = [("a\r\nb: c", "http://x/\r\n", "same"), ("", None, "same"), (None, "http://x/", "same"), ("z\ud7ff %", "", "other")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    top = max(r[0] for r in rows[:2])
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("a\r\nb: c", "response", None), ("", "revisit", top), ("None", "revisit", top), ("z\ud7ff %", "response", None)])


def test_damaged_payload_is_found():
    import gzip

    ok = warc.record("1", "http://x/", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse(ok)[3] == "response"
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(ok).replace(b"abc", b"abd")))


def test_media(spark, documents, rows):
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    got = media.media_columns(documents).collect()
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, want))
    same = {r.payload_sha256: (r.media_sha256, r.feature) for r in got}
    assert all(same[r.payload_sha256] == (r.media_sha256, r.feature) for r in got)
    assert media.media_columns(documents.limit(0)).count() == 0


def test_ranges_cover_members_once_and_failed_members_stand_alone(spark, tmp_path):
    a = media._Zip(str(tmp_path / "a.zip"))
    for i in range(20):
        a.add(f"{i}.png", media.to_png(media.to_payload(str(i) * 300)))
    a.close()
    got = media.read_archives(spark, str(tmp_path), rangeBytes=700)
    assert sorted(r.name for r in got.collect()) == sorted(f"{i}.png" for i in range(20))
    import zipfile

    assert zipfile.ZipFile(tmp_path / "a.zip").testzip() is None
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    offset, size, _, name = list(media._members(storage.open_input(str(tmp_path / "a.zip"))))[3]
    raw[offset + 60] ^= 255
    (tmp_path / "a.zip").write_bytes(raw)
    bad = media.read_archives(spark, str(tmp_path), onError="null", retries=1).where("media is null").collect()
    assert [r.name for r in bad] == [name]


def test_unfinished_files_are_not_seen(tmp_path):
    w = storage.Writer(str(tmp_path / "x.zip"))
    w.write(b"1")
    assert storage.sizes(str(tmp_path), ".zip") == []
    w.close()
    assert storage.sizes(str(tmp_path), ".zip") == [("x.zip", 1)]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urltrust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_ranks(seeds, edges, rounds=400):
    """{host: (trust, distrust)} by plain iteration; what hosts without links to follow hold returns to the seeds."""
    hosts = sorted({x for e in edges for x in e[:2]} | {s[0] for s in seeds})
    out = []
    for which, (a, b) in ((1, (0, 1)), (2, (1, 0))):  # distrust runs against the links
        s = {h: float(sum(x[which] for x in seeds if x[0] == h)) for h in hosts}
        total = sum(s.values())
        weight = {h: sum(e[2] for e in edges if e[a] == h) for h in hosts}
        r = dict(s)
        for _ in range(rounds if total else 0):
            stuck = sum(r[h] for h in hosts if not weight[h])
            r = {h: s[h] * (0.15 + 0.85 * stuck / total) + 0.85 * sum(r[e[a]] * e[2] / weight[e[a]] for e in edges if e[b] == h) for h in hosts}
        out.append(r)
    return {h: (out[0][h], out[1][h]) for h in hosts}


def test_url_verdicts(pages):
    rows = urltrust.judge(pages).collect()
    urls = dict((i, u) for i, u, _ in PAGES)
    assert len(rows) == len(PAGES)
    count, seeds = defaultdict(int), defaultdict(lambda: [0, 0])
    for _, u, _ in PAGES:
        host, path = plain_parts(u)
        if host:
            count[host] += 1
            seeds[host][{"allow": 0, "block": 1}.get(plain_rule(host, path)[1], 0)] += plain_rule(host, path)[1] is not None
    edges = [("www.example.com", "bad.net", 1), ("friend.org", "bad.net", 1), ("trusted.com", "good.org", 2)]
    ranks = plain_ranks([(h, *x) for h, x in seeds.items()], edges)
    for r in rows:
        host, path = plain_parts(urls[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        t, d = ranks.get(host, (0, 0))
        assert r.verdict == (verdict or ("block" if d > t and d >= urltrust.EVIDENCE * count[host] else "allow"))
        assert not host or (r.trust, r.distrust) == (pytest.approx(t, abs=1e-4), pytest.approx(d, abs=1e-4))
    by = {r.page_id: r.verdict for r in rows}
    assert by[4] == "block"  # half of its host's pages are blocked by a rule
    assert by[6] == by[7] == by[8] == "allow"
    assert urltrust.judge(pages.limit(0)).count() == 0


def test_little_evidence_blocks_nothing(spark):
    """A host with one blocked page in ten is allowed; a page that links to blocked hosts alone is not."""
    rows = [(i, f"http://big.net/{'es' if i == 0 else 'xx'}/{i}", "") for i in range(10)] + [(20, "http://bad.net/es/", ""), (21, "http://farm.org/", "<a href='//bad.net/'>")]
    got = {r.page_id: r.verdict for r in urltrust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "block" and all(got[i] == "allow" for i in range(1, 10)) and got[21] == "block"


def test_propagation_equals_plain_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "c", 3), ("c", "a", 1), ("b", "e", 1)]
    seeds = [("a", 3, 0), ("d", 1, 0), ("c", 0, 2), ("f", 0, 0)]
    out = urltrust.propagate(spark.createDataFrame(seeds, "host string, trusted long, blocked long"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()
    got, want = {r.host: (r.trust, r.distrust) for r in out}, plain_ranks(seeds, edges)
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == (pytest.approx(want[h][0], abs=1e-4), pytest.approx(want[h][1], abs=1e-4))
    assert sum(x[0] for x in got.values()) == pytest.approx(4) and sum(x[1] for x in got.values()) == pytest.approx(2)


def test_propagation_decides_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    with_links = {r.host: r.verdict for r in urltrust.judge_derived(pages).collect()}
    hosts = urltrust.hosts_of(urltrust.judged_by_rules(pages))
    none = spark.createDataFrame([], "src string, dst string, n long")
    alone = {r.host: "block" if r.bad else "allow" for r in urltrust.host_verdicts(hosts, none).collect()}
    assert with_links.keys() == alone.keys() and len(set(with_links.values())) == 2
    assert sum(with_links[h] != alone[h] for h in alone) > 0
