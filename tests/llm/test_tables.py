"""Centroid clustering, the audit of filters and URL verdicts against plain Python on small, odd tables."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from math import factorial, floor, inf, isfinite, nan

import numpy as np
import pytest

from gatehouse.llm import url_filters as U
from gatehouse.llm.centroid_clustering import CentroidLists, clusters
from gatehouse.llm.filter_audit import filter_audit, removal_intervals
from gatehouse.llm.url_filters import Rule, url_verdicts


# Centroid clustering


def brute_clusters(rows, count, rounds, dims):
    kept = [(i, [floor(min(max(64 * x, -(1 << 26)), 1 << 26)) for x in v], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]

    def place(row):
        return (row[0] is None, "" if row[0] is None else sha256(f"1:{row[0]}".encode()).hexdigest(), row[2])

    centroids = [v for _, v, _ in sorted(kept, key=place)[:count]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v, _ in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v, _), (_, k) in zip(kept, assigned(), strict=True):
            own[k].append(v)
        for k, vs in own.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = assigned()
    inertia = Counter()
    for d, k in found:
        inertia[k] += d
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _, _), (d, k) in zip(kept, found, strict=True)), key=str
    )


def clustered(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, vector string")
    found = clusters(table, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def odd_vectors():
    rng = random.Random(5)
    rows = [(k, [rng.gauss(k % 7, 0.4) for _ in range(6)]) for k in range(150)]
    # Ties: many vectors on a coarse grid, repeated rows, repeated and missing identifiers.
    rows += [(200 + k, [float(rng.randint(0, 1)) for _ in range(6)]) for k in range(80)]
    rows += [rows[3]] * 5 + [(7, [0.5] * 6), (7, [0.25] * 6), (None, [0.1] * 6), (None, [9.0] * 6)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(905, [nan] + [0.0] * 5), (906, [inf] + [0.0] * 5), (907, [-inf] + [0.0] * 5), (908, [-1e308] + [0.0] * 5), (909, [1e7] * 6)]
    return rows


@pytest.mark.parametrize("count", [1, 5, 16])
def test_clusters(spark, count):
    rows = odd_vectors()
    assert clustered(spark, rows, count=count, rounds=3, dims=6) == brute_clusters(rows, count, 3, 6)


def test_clusters_of_few_equal_or_no_vectors(spark):
    same = [(k, [1.0, -0.51]) for k in range(40)]
    for rows in (same, same[:3], [(None, [2.0, 3.0])], [(1, None)], []):
        assert clustered(spark, rows, count=4, rounds=3, dims=2) == brute_clusters(rows, 4, 3, 2)


def test_the_walk_ends_early_and_is_exact():
    rng = np.random.default_rng(2)
    centroids, x = rng.integers(-40, 40, (16, 8)), rng.integers(-40, 40, (3000, 8))
    number, distance = CentroidLists(centroids).nearest(x)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


# Audit of filters


def test_intervals_are_the_orders_of_each_removal():
    ranks = list(permutations(range(5)))
    found = defaultdict(set)
    for mask, step, first, end in removal_intervals(5).tolist():
        assert not found[mask, step] & set(range(first, end))
        found[mask, step] |= set(range(first, end))
    for mask in range(1, 32):
        for step in range(5):
            assert found[mask, step] == {r for r, p in enumerate(ranks) if min(k for k, x in enumerate(p) if mask >> x & 1) == step}
    assert {e - f for _, s, f, e in removal_intervals(5).tolist() if s == 1} == {factorial(3)}


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        parts[part or ""].append(({f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    rows = {}
    for part, own in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in own)
                alone = sum(x[0] == {f} for x in own)
                rows[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for f in "ABCDE":
            total = sum(r[1] for (p, o, s), r in rows.items() if p == part and o[s - 1] == f)
            for (p, o, s), r in rows.items():
                if p == part and o[s - 1] == f:
                    r.append(total)
    return rows


def test_audit_of_odd_documents(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma x", "délta", "#tag", "EPSILON", "a|b"] + [f"w{k}" for k in range(90)]
    docs = []
    for k in range(160):
        text = rng.choice([" ", "\n", "\x0b"]).join(rng.choices(words, k=rng.choice([3, 49, 50, 51, 120])))
        docs.append((k, text, rng.choice(["s0", "s0", "s1", None, ""])))
    docs += [(200 + k, docs[k % 9][1], "s2") for k in range(40)]
    docs += [docs[5]] * 4 + [(5, "another text", "s0"), (None, docs[5][1], "s0"), (None, None, "s1"), (None, None, "s1")]
    docs += [(300, None, "s1"), (301, "", "s1"), (302, "  \n", "s3"), (303, " ".join(f"w{k}" for k in range(40_000)), "s3")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, 1), (9999, 1, 1)]
    labels += [(8, 0, 0)] * 3
    table = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, n long, mask string")
    known = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit(table, known).collect()}
    assert found == brute_audit(docs, labels)
    assert filter_audit(table.limit(0), known).count() == 0
    assert {tuple(r)[4:6] for r in filter_audit(table, known.limit(0)).collect()}


def test_audit_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").selectExpr("*", "cast(null AS string) AS source")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit(docs, none).collect()
    assert len(rows) == 600 and {(r.good_lost, r.toxic_lost) for r in rows} == {(0, 0)}


# URL verdicts


def brute_urls(pages, rules=U.RULES, threshold=U.THRESHOLD):
    rows = []
    for page_id, url, html in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        links = re.findall(r"""href=["']?(?:https?:)?//([^/?#"'<> \t\n\r]+)""", html or "", re.IGNORECASE | re.ASCII)
        rows.append((page_id, host, path, rule, {x.lower() for x in links}))
    hosts = {h for _, h, *_ in rows if h}
    edges = {(h, to) for _, h, _, _, links in rows for to in links if h and h != to}
    for h in hosts:
        above = max((a for a in hosts if h.endswith("." + a) and len(h) <= 253), key=len, default=None)
        if above:
            edges |= {(h, above), (above, h)}
    score = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        ways = defaultdict(set)
        for a, b in edges:
            ways[a if kind == "trust" else b].add(b if kind == "trust" else a)
        own = Counter()
        for h in hosts:
            mine = [r for _, x, _, r, _ in rows if x == h]
            own[h] = U.UNIT * sum(r is not None and r.verdict == verdict for r in mine) // len(mine)
        now = Counter(own)
        for _ in range(U.ROUNDS):
            got = Counter()
            for a, tos in ways.items():
                for b in tos:
                    got[b] += now[a] // len(tos)
            now = Counter({h: own[h] + U.HANDED_ON * got[h] // 100 for h in set(own) | set(got)})
        score[kind] = now
    blocked = {h for h in score["distrust"] if score["distrust"][h] > score["trust"][h] and score["distrust"][h] * 100 >= threshold * U.UNIT}
    return sorted(((i, h, p, r and r.name, r.verdict if r else "block" if h in blocked else "allow") for i, h, p, r, _ in rows), key=str)


def page_links(*hosts):
    return "<p>" + " ".join(f'<a HREF="https://{h}/x?y">z</a>' for h in hosts) + '<a href="/own">o</a>'


def odd_pages():
    pages = [
        (1, "http://casino.net/", page_links()),
        (2, "http://friend.com/a", page_links("casino.net", "CASINO.net")),
        (3, "http://friend-of-friend.com/a", page_links("friend.com")),
        (4, "http://blog.friend.com/a", page_links()),
        (5, "https://paper.org/fr/x", page_links("reader.com")),
        (6, "https://reader.com/", page_links("paper.org")),
        (7, "https://both.com/", page_links("casino.net", "paper.org", "elsewhere.io")),
        (8, "https://shop.example.com/de/", page_links()),
        (9, "https://shop.example.com/en/", page_links()),
        (10, "HTTP://WWW.Example.NET/en/x#y", "href=//friend.com href='http://casino.net'"),
        (11, "http://example.net", None),
        (12, "http://x.net?u=http://paper.org/fr/", ""),
        (13, "http://notexample.net/en/", "x"),
        (14, None, page_links("casino.net")),
        (15, "", None),
        (16, "no scheme/en", page_links("casino.net")),
        (17, "http:///path?x", page_links("casino.net")),
        (None, "http://user@a.b.org:80/fr/", None),
        (19, "http://a.b.org/de/", page_links("a.b.org", "b.org")),
        (20, "http://b.org/de/", page_links("casino.net")),
        (21, "http://" + "x." * 200 + "b.org/", page_links()),
        (22, "http://net/", "<a href=http://friend.com>"),
    ]
    return pages + [pages[1]] * 3 + [(4, "http://blog.friend.com/b", page_links("paper.org")), (40, "http://reader.com/" + "y" * 100_000, "href=//" + "z" * 100_000)]


def verdicts(spark, pages, **options):
    table = spark.createDataFrame([(*p, "k", 0) for p in pages], "page_id long, url string, html string, host string, score int")
    found = url_verdicts(table, **options)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_urls(spark):
    found = verdicts(spark, odd_pages())
    assert found == brute_urls(odd_pages())
    by_method = {(r[1], r[4]) for r in found if r[3] is None}
    assert ("b.org", "block") in by_method and ("reader.com", "allow") in by_method


def test_urls_without_links_or_rows(spark):
    pages = [(1, "http://a.com/de", None), (2, "http://b.net/x", ""), (3, "http://b.net", None)]
    assert verdicts(spark, pages) == brute_urls(pages)
    assert verdicts(spark, []) == []


def test_other_rules_and_threshold(spark):
    rules = (Rule("allow", "friend.com"), Rule("block", "friend.com", "/a"), Rule("block", "io", ""))
    assert verdicts(spark, odd_pages(), rules=rules, threshold=5) == brute_urls(odd_pages(), rules, 5)
