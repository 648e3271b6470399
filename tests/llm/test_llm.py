"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmill.llm import components, decontam, lm, mixing, quality, queries, simhash, substrings, tokens, topk, toxicity, urls

WORDS = [f"w{i}" for i in range(60)] + ["Äpfel", "ÉTÉ", "the", "THE"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, label int"


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, text_of(rng, rng.choice([0, 1, 3, 9, 40, 120])), "en", f"s{rng.randrange(4)}") for i in range(n)]
    rows += [(n + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(n + 10, None, None, None), (n + 11, "", "en", "s1"), (None, "w1 w2 w3 w4 w5", "en", "s1"), (None, None, "en", None), (n + 12, " \t\n", "en", "s2")]
    long = text_of(rng, 30_000)
    rows += [(n + 13, long, "en", "s3"), (n + 14, long + " tail", "en", "s3"), rows[3], rows[3]]
    return [(*r, len(r[1] or ""), 7, "x", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def plain_fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs):
    got = simhash.simhash_components(docs).collect()
    fps = [plain_fingerprint(r.text, 4) for r in docs.select("text").collect()]
    distinct = sorted(set(fps))
    root = plain_components([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4], distinct)
    low = {}
    for r, fp in zip(docs.collect(), fps, strict=True):
        if r.doc_id is not None:
            low[root[fp]] = min(low.get(root[fp], 1 << 60), r.doc_id)
    want = Counter((r.doc_id, f"{fp:016x}", low.get(root[fp])) for r, fp in zip(docs.collect(), fps, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_empty(none):
    assert simhash.simhash_components(none).collect() == []
    assert simhash.drop_near_copies(none).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 4, 6, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(300)], np.uint64)
    fps = np.concatenate([base, base[rng.integers(0, 150, 300)] ^ flips])
    got = {(int(i), int(j)) for a, b in simhash.within(fps[:97], fps, radius) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(97) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize(("radius", "block"), [(4, 2048), (4, 16), (6, 40)])
def test_near_links_split_hot_buckets(spark, radius, block):
    rng = random.Random(5)
    fps = {0, 1, 3}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(5):
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                x ^= 1 << b
            fps.add(x)
    hot = rng.getrandbits(64)
    fps |= {hot ^ rng.getrandbits(9) for _ in range(200)}
    fps = sorted(fps)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near_links(spark.createDataFrame([(sign(x),) for x in fps], "fp long"), radius, block)
    got = {r.node: r.root for r in components.components(links).collect()}
    want = plain_components([(sign(a), sign(b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius], [sign(x) for x in fps])
    assert {sign(x): got.get(sign(x), sign(x)) for x in fps} == want


def test_pigeonhole_tables():
    for n, radius in ((10, 4), (10**8, 4), (10**12, 4), (10, 6), (10**8, 6)):
        masks = simhash.tables_for(n, radius)
        rng = random.Random(n)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flips & m for m in masks)


def test_components_of_a_path(spark):
    n = 120
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {501: 500}


def shingle_set(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_near(texts, similarity=0.8):
    """Components by Jaccard similarity over all pairs; equal word sequences are linked too."""
    sets = [shingle_set(t) for t in texts]
    same = lambda i, j: (texts[i] or "").lower().split() == (texts[j] or "").lower().split() or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0
    return plain_components([(i, j) for i in range(len(texts)) for j in range(i) if same(i, j)], range(len(texts)))


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_near_copies_by_similarity(spark, broadcast_rows):
    rng = random.Random(11)
    texts = []
    for i in range(30):
        w = [f"a{rng.randrange(500)}" for _ in range(150)]
        texts.append(" ".join(w))
        for edits in (1, 2, 9):  # similar, similar, not similar
            v = list(w)
            for p in range(edits):
                v[10 + 15 * p] = f"z{rng.randrange(99)}"
            texts.append(" ".join(v))
    hub = [f"h{rng.randrange(500)}" for _ in range(120)]
    texts += [" ".join(w if j != i else "q" for j, w in enumerate(hub)) for i in range(0, 120, 2)]  # a large group
    texts += ["Some  OTHER\ttext", "some other text", "", " \n", None, "some", "some"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = plain_near(texts)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], 1 << 60), d)
    got = Counter(r.doc_id for r in simhash.drop_near_copies(df, broadcast_rows=broadcast_rows).collect())
    assert got == Counter(low.values())


def near_threshold_texts():
    """Families whose texts have similarities of 0.6 to 0.97, most of them near 0.8."""
    rng, texts = random.Random(7), []
    for _ in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for k in range(12):
            w = list(base)
            for at in rng.sample(range(150), 1 + k % 5):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts


def test_near_copies_near_the_threshold(spark):
    """Of thousands of pairs at 0.8 or more by brute force, those whose texts end up apart; and no text goes without a link."""
    texts = near_threshold_texts()
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for f in range(0, len(texts), 12) for i in range(f, f + 12) for j in range(f, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = plain_components(pairs, range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert len(pairs) > 1000 and set(want.values()) <= kept
    lost = len(kept) - len(set(want.values()))
    assert lost <= 0.02 * (len(texts) - len(set(want.values())))


def test_candidates_near_the_threshold(spark):
    """Recall of candidates over all pairs at 0.8 or more: both texts in one component."""
    texts = near_threshold_texts()
    sets = [shingle_set(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    nodes = df.select("key", simhash.sketches(F.col("text"), 2, 6).alias("s")).select("key", "s.fps")
    links = [(r.a, r.b) for r in simhash.candidate_links(nodes, 6, 5, 2048).collect()]
    root = plain_components(links, range(len(texts)))
    pairs = [(i, j) for f in range(0, len(texts), 12) for i in range(f, f + 12) for j in range(f, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = sum(root[i] == root[j] for i, j in pairs) / len(pairs)
    print("pairs", len(pairs), "recall", found)
    assert found >= 0.98


def test_drop_near_copies(spark, docs):
    names = ["text", "key", "root", "_in_0", "node", "id"]
    rows = [(r.text, 1, 2, r.doc_id, 4, 5) for r in docs.collect()]
    df = spark.createDataFrame(rows, "text string, key int, root int, _in_0 long, node int, id int")
    got = simhash.drop_near_copies(df, doc_id="_in_0")
    assert got.columns == names
    root = plain_near([r[0] for r in rows])
    want = Counter()
    for g in set(root.values()):
        ids = [r[3] for i, r in enumerate(rows) if root[i] == g]
        want[min((i is None, i or 0) for i in ids)] += 1
    assert Counter((r["_in_0"] is None, r["_in_0"] or 0) for r in got.collect()) == want


URLS = ["http://a.com/en/1", "https://EXAMPLE.com/en/x", "http://www.example.com/en/1?q", "http://b.example.com/en", "http://b.example.com/en/", "http://x.net/es/1", "http://x.net/en/1#f", "x.net/es/1", "ftp://net/fr/", "http://anet/fr/1", None, "", "http://", "http://q.org?x://y", "http://h.net"]


def plain_rule(host, path):
    best = None
    for h, p, v in queries.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_url_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + [f"http://hot.net/{s}/{i}" for i in range(40) for s in ("en", "es")])]
    got = urls.filter_urls(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, host string"), rules=queries.RULES).collect()
    assert len(got) == len(rows) + 1
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        rule = plain_rule(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule and rule[0])
        assert by[i].verdict == rule[1] if rule else by[i].verdict in ("allow", "block")


def plain_unlike(k1, n1, k2, n2, errors=1.96):
    if not n1 or not n2:
        return False
    p, q = (k1 + 0.5) / (n1 + 1), (k2 + 0.5) / (n2 + 1)
    return abs(p - q) > errors * math.sqrt(p * (1 - p) / n1 + q * (1 - q) / n2)


def plain_shape(path):
    out = []
    for s in (x for x in path.split("/") if x):
        ext = (re.search(r"(\.[A-Za-z]{1,5})$", s) or [""])[0]
        stem = s[: len(s) - len(ext)]
        form = re.search(r"^[0-9]+$", stem) or re.search(r"^(?=.*[0-9])[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", stem) or re.search(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", stem)
        out.append("*" + ext if form else s)
    return tuple(out)


def plain_purity(rows, smooth=5.0, effective=8, tail=64):
    """Template and smoothed blocked share of each (host, path, label), tree by tree in plain loops."""
    leaf = [(h, plain_shape(p), (), (), m) for h, p, m in rows]
    depth = 0
    while True:
        nodes = {}
        for h, shape, names, _, m in leaf:
            if depth < len(shape) and len(names) == depth:
                k = nodes.setdefault((h, names), {}).setdefault(shape[depth], [0, 0, 0])
                k[0], k[1], k[2] = k[0] + 1, k[1] + (m is not None), k[2] + (m == "block")
        free = {at: {x: k for x, k in kids.items() if x[0] != "*"} for at, kids in nodes.items()}
        if not any(sum(k[0] for k in kids.values()) >= effective for kids in free.values()):
            break
        named = {}
        for at, kids in nodes.items():
            t, l, b = (sum(k[i] for k in free[at].values()) for i in range(3))
            varies = t >= effective and sum(k[0] * (k[0] - 1) for k in free[at].values()) * effective <= t * (t - 1)
            big = []
            for x, (n, kl, kb) in kids.items():
                odd = x[0] != "*" and plain_unlike(kb, kl, b - kb, l - kl)
                if x[0] == "*" or (varies and odd) or (not varies and (not kl or (n * tail < t and odd))):
                    named[at, x] = (x, x)
                elif varies:
                    named[at, x] = ("*", "*")
                elif n * tail < t:
                    named[at, x] = (x, "+")
                else:
                    big.append((kb / kl, x, kb, kl))
            group, members = -1, {}
            for i, (_, x, kb, kl) in enumerate(sorted(big)):
                before = sorted(big)[i - 1]
                group += i == 0 or plain_unlike(kb, kl, before[2], before[3])
                members.setdefault(group, []).append(x)
            for g, xs in members.items():
                for x in xs:
                    named[at, x] = (x, x if len(xs) == 1 else f"+{g}")
        leaf = [(h, s, (*n, named[(h, n), s[depth]][0]), (*g, named[(h, n), s[depth]][1]), m) if depth < len(s) and len(n) == depth else (h, s, n, g, m) for h, s, n, g, m in leaf]
        depth += 1
    leaf = [(h, s, n + s[depth:], g + s[depth:], m) for h, s, n, g, m in leaf]
    labels = [m for *_, m in leaf if m]
    top = sum(m == "block" for m in labels) / len(labels) if labels else 0.0
    out = []
    for h, _, names, merged, _ in leaf:
        share = top
        for d in range(1, len(names) + 1):
            own = [m for _, _, n, _, m in leaf if m and n[:d] == names[:d]]
            share = (sum(m == "block" for m in own) + smooth * share) / (len(own) + smooth)
        own = [m for h2, _, _, g, m in leaf if m and h2 == h and g == merged]
        out.append(("/" + "/".join(merged), (sum(m == "block" for m in own) + smooth * share) / (len(own) + smooth)))
    return out


def test_url_trees_against_plain(spark):
    rng = random.Random(8)
    rows = []
    for host in ("a.org", "b.org", "c.org", "hot.org"):
        for _ in range(400 if host == "hot.org" else 60):
            top = rng.choice(["spam", "news", "blog", "user"])
            name = rng.choice([f"n{rng.randrange(40)}", "n1"])
            path = rng.choice([f"/{top}/{rng.randrange(99)}", f"/{top}/{name}/{rng.randrange(9)}.html", f"/{top}/{name}/x/deep/2024-01-0{rng.randrange(1, 9)}/end", f"/{top}", "/", f"/rare{rng.randrange(200)}"])
            bad = {"spam": 0.95, "news": 0.05, "blog": 0.07, "user": 0.5}[top]
            label = None if host == "c.org" or rng.random() < 0.5 else "block" if rng.random() < bad else "allow"
            rows.append((host, path, label))
    rows += [("deep.org", "/".join(["", *[f"s{i}" for i in range(300)]]), "allow"), ("deep.org", "", None), ("", "", None)]
    df = spark.createDataFrame([(i, f"http://{h}{p}?q" if h else None, m, "clash", "clash") for i, (h, p, m) in enumerate(rows)], "page_id long, url string, mark string, shape string, _h string")
    got = {r.page_id: r for r in urls.filter_urls(df, label="mark").collect()}
    assert len(got) == len(rows)
    for i, (template, purity) in enumerate(plain_purity(rows)):
        assert (got[i].template, got[i].verdict) == (template, "block" if purity >= 0.8 else "allow") and abs(got[i].purity - purity) < 1e-9
    unlabelled = [got[i].verdict for i, r in enumerate(rows) if r[0] == "c.org"]
    assert {"allow", "block"} == set(unlabelled)


def test_url_templates(spark):
    rows = [(f"http://h.org/{s}/{i}", "block" if s == "spam" else "allow") for i in range(20) for s in ("spam", "news")] + [(f"http://h.org/{s}/9{i}", None) for i in range(5) for s in ("spam", "news", "new")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, mark string")
    got = {r.path: (r.verdict, r.template) for r in urls.filter_urls(df, label="mark").collect()}
    assert got["/spam/91"][0] == "block" and got["/news/91"][0] == "allow" and got["/new/91"][0] == "allow"
    assert got["/spam/91"][1].endswith("/*")
    slugs = spark.createDataFrame([(i * 10 + j, f"http://s.org/a/slug{chr(97 + i)}q/{j}") for i in range(20) for j in range(10)], "page_id long, url string")
    assert {r.template for r in urls.filter_urls(slugs).collect()} == {"/a/*/*"}
    assert urls.filter_urls(df.filter("false"), rules=queries.RULES).collect() == []


def plain_top(rows, query, k):
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    s = sorted((-sum(a * b for a, b in zip(x[query], v, strict=False)), i) for i, v in x.items() if i != query)
    return [(i, -t) for t, i in s[:k]]


@pytest.mark.parametrize("values", ["normal", "coarse"])
def test_top_k(spark, values):
    rng = np.random.default_rng(3)
    vec = [(i, [float(np.float32(c)) for c in (rng.normal(0, 0.2, 16) if values == "normal" else rng.integers(-2, 3, 16) / 4)]) for i in range(400)]
    bad = [(401, None), (402, [1.0, None] + [0.0] * 14), (403, [float("nan")] * 16), (450, [float("inf")] * 16), (None, [9.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vec + bad], "vec_id long, embedding array<float>, id int, g int")
    got = topk.top_k(df, is_query=F.col("vec_id") % 50 == 0, k=5, block=64, query_block=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {q: plain_top(vec, q, 5) for q in range(0, 400, 50)}


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, is_query=F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 65536), (2, 2, 0)]
    assert topk.top_k(df.filter("false"), is_query=F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("scale", [1e6, 1e10, 1e13])
def test_top_k_large(spark, scale):
    rng = np.random.default_rng(4)
    vec = [(i, [float(c) for c in rng.normal(0, scale if i % 3 and i % 50 else 1.0, 12)]) for i in range(300)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    got = topk.top_k(df, is_query=F.col("vec_id") % 50 == 0, block=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = {i: [math.floor(256 * c) for c in v] for i, v in vec}
    for q in range(0, 300, 50):
        s = sorted((-sum(a * b for a, b in zip(x[q], v, strict=True)), i) for i, v in x.items() if i != q)[:5]
        assert by[q] == [(i, -t) for t, i in s]


def test_top_k_too_large(spark):
    df = spark.createDataFrame([(0, [1e12, 1e12]), (1, [1e12, 1e12])], "vec_id long, embedding array<double>")
    for bad in (df, df.withColumn("embedding", F.array(F.lit(1e17), F.lit(1e300)))):
        with pytest.raises(Exception, match="OverflowError"):
            topk.top_k(bad, is_query=F.col("vec_id") % 50 == 0).collect()


def labelled(spark, bad_words, n=500):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.3
        words = [rng.choice(WORDS[:60]) + rng.choice(["", "a", "bc"]) for _ in range(rng.randrange(30, 90))]
        if y:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad_words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    rows += [(n, None), (n + 1, ""), (None, "w1"), rows[0]]
    labels += [(None, 1), (7, None), (10_000, 1)]
    return spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, score string, label int"), spark.createDataFrame(labels, "doc_id long, quality int")


def held_out_accuracy(out, labels, n):
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in out if r.doc_id is not None and r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % n == 1]
    return sum(r.predicted == y[r.doc_id] for r in held) / len(held)


def test_quality(spark):
    docs, labels = labelled(spark, ["$$$###", "!!!!!", "|||"])
    learn = queries.common.crc_mod(F.col("doc_id"), 3) != 1
    out = quality.quality_scores(docs, labels, learn=learn, keep=["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert held_out_accuracy(out, labels, 3) > 0.9
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, labels.filter("false"), keep=["doc_id"]).collect())
    assert quality.quality_scores(docs.filter("false"), labels, keep=["doc_id"]).collect() == []


def test_quality_against_plain(spark):
    docs, labels = labelled(spark, ["$$$###", "!!!!!", "|||"])
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None}
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    out = quality.quality_scores(docs, labels, keep=["doc_id"], rows_a_sum=10).collect()  # over 50 sums, so three levels of merges
    rows = [(quality.statistics(t), float(y[i]), i) for i, t in texts if i in y]
    fold_of = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(3), F.col("doc_id").cast("string")), F.lit(quality.FOLDS)).alias("f")).collect()}
    x, t, fold = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([fold_of[r[2]] for r in rows])
    mean, scale = x.mean(axis=0), np.sqrt(np.maximum((x**2).mean(axis=0) - x.mean(axis=0) ** 2, 1e-12))
    rng = np.random.default_rng(11)
    freq = rng.normal(size=(quality.N_STATS, 192)) / np.sqrt(quality.N_STATS)
    phase = rng.uniform(0, 2 * np.pi, 192)
    phi = lambda a: np.column_stack([np.sqrt(2 / 192) * np.cos(np.clip((a - mean) / scale, -8, 8) @ freq + phase), np.ones(len(a))])
    penalty = 1e-3 * len(t) * np.eye(193) / 193
    penalty[-1, -1] = 1e-9
    fit = lambda m: np.linalg.solve(phi(x[m]).T @ phi(x[m]) + penalty, phi(x[m]).T @ t[m])
    held = np.array([phi(x[i : i + 1])[0] @ fit(fold != fold[i]) for i in range(len(t))])
    bins = np.clip((held + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    at = sorted(set(bins.tolist()))
    n, m = [int((bins == b).sum()) for b in at], [t[bins == b].mean() for b in at]
    curve = [max(min(sum(a * b for a, b in zip(n[i : k + 1], m[i : k + 1], strict=True)) / sum(n[i : k + 1]) for k in range(j, len(at))) for i in range(j + 1)) for j in range(len(at))]
    raw = phi(np.array([quality.statistics(t) for _, t in texts])) @ fit(np.ones(len(t), bool))
    want = np.interp(raw, [-0.5 + (b + 0.5) * 2 / quality.BINS for b in at], curve)
    assert np.allclose(sorted(r.score for r in out), sorted(want), atol=0.02) and np.mean(np.abs(np.sort([r.score for r in out]) - np.sort(want)) < 1e-6) > 0.95


def test_isotonic():
    from trailmill.llm.calibration import pav

    assert pav(np.array([1.0, 1, 1, 2]), np.array([1.0, 0, 1, 2])).tolist() == [0.5, 0.5, 1.0, 1.0]
    assert pav(np.zeros(0), np.zeros(0)).tolist() == []


def test_toxicity(spark):
    docs, labels = labelled(spark, ["hateful", "vilest", "slurword", "nastyish"])
    learn = queries.common.crc_mod(F.col("doc_id"), 3) != 1
    out = toxicity.toxicity_scores(docs, labels, label="quality", learn=learn, keep=["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert held_out_accuracy(out, labels, 3) > 0.9
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.filter("false"), label="quality").collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.filter("false"), labels, label="quality").collect() == []
    with pytest.raises(ValueError, match="overwritten"):
        toxicity.toxicity_scores(docs.withColumn("score", F.lit(1)), labels, label="quality", keep=["score"])
    few = toxicity.toxicity_scores(docs, labels, label="quality", sample=40, sample_bytes=2000, keep=["doc_id"]).collect()
    assert Counter(r.doc_id for r in few) == Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_toxicity_windows_against_plain(spark):
    docs, labels = labelled(spark, ["hateful", "vilest", "slurword", "nastyish"])
    rows = docs.join(labels.filter("quality is not null"), "doc_id").orderBy("doc_id").collect()
    model = toxicity.fit_toxicity([(r.text or "").encode() for r in rows], [r.quality for r in rows])
    texts = [(r.text or "").encode() for r in rows[:40]] + [b"", b"hateful", b"a " * 50_000 + b"vilest hateful"]
    got = model.scorer()(texts)
    for t, x in zip(texts, got, strict=True):
        words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) if w]
        d = []
        for i in range(0, len(words), model.window):
            w = b" " + b" ".join(words[i : i + model.window]) + b" "
            d.append(len(toxicity._compressor(model.ordinary).compress(w)) - len(toxicity._compressor(model.toxic).compress(w)))
        d.sort(reverse=True)
        want = [min(np.mean(d), 4), min(d[0], 12), min(np.mean(d[:3]), 12), min(np.mean([v >= 3 for v in d]), 0.5), min(np.mean([v >= 5 for v in d]), 0.5), math.log1p(sum(v >= 4 for v in d)) - 0.5 * math.log1p(len(d)), math.log1p(len(d))] if d else [0] * 7
        assert np.allclose(x, want)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["<|endoftext|>a <|startoftext|>", "a<|endoftext|>b", "it's I'LL 12.5 x́ é e\u0301\u0301 \u00a0 \u2003z", "ΑΣ ΑΣΑ", "\u0301x", "a\u0085b", "日本語 テキスト", "x" * 5000]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(odd))
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=path, keep=["doc_id"], split=True, cache_bytes=5000).collect()
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 2048) for i, x in rows)
    assert Counter(map(tuple, got)) == want
    assert tokens.token_counts(docs.filter("false"), tokenizer=path).collect() == []
    small = spark.createDataFrame(rows, "doc_id long, text string").filter("char_length(text) < 2000 or text is null")
    assert Counter(map(tuple, tokens.token_counts(small, tokenizer=path, keep=["doc_id"]).collect())) <= want
    with pytest.raises(ValueError, match="overwritten"):
        tokens.token_counts(docs.withColumn("n_tokens", F.lit(1)), tokenizer=path, keep=["n_tokens"])


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain_contamination(docs, items):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    out = Counter()
    for i, t in docs:
        w, hit, who = plain_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if x := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    who |= x
        out[i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("single", [False, True])
def test_contamination(spark, docs, single, tmp_path):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [t for _, t in rows if t and len(t.split()) > 20]
    items = [(i, " ".join(t.split()[3 : 3 + rng.choice([4, 9, 10, 17])]).replace("w1 ", "W1,")) for i, t in enumerate(texts[:12])] + [(50, None), (51, ""), (52, ".."), (2, texts[0]), (60, texts[0]), (None, "w1 w2")]
    if single:
        items.append((70, "w7"))
    path = str(tmp_path)
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([i for i in items if i[0] is not None], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = Counter(map(tuple, queries.op6_decontamination(spark, path).collect()))
    assert got == plain_contamination(rows, [i for i in items if i[0] is not None])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    near, far = (decontam.contamination(docs, benchmark, broadcast_rows=n).collect() for n in (10**6, 0))
    assert Counter(map(str, near)) == Counter(map(str, far))


def test_decontaminate(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota KAPPA lambda"
    df = spark.createDataFrame([(1, f"x y. {item} -- z! {'more ' * 30}", 5), (2, item, 6), (3, None, None), (4, "clean text", 10), (4, "clean text", 10)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = Counter(map(tuple, decontam.decontaminate(df, items).collect()))
    left = f"x y -- z! {'more ' * 30}"
    assert got == Counter([(1, left, len(left)), (3, None, None), (4, "clean text", 10), (4, "clean text", 10)])
    assert Counter(map(tuple, decontam.decontaminate(df, items.filter("false")).collect())) == Counter(map(tuple, df.collect()))
    assert decontam.decontaminate(df.filter("false"), items).collect() == []


def plain_lm(rows, learn):
    token = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    c = Counter(w for i, t in rows if learn(i) for w in token(t))
    total, v = sum(c.values()), len(c)
    return [(i, len(token(t)), sum(c[w] > 0 for w in token(t)), total, sum(math.log10((c[w] + 1) / (total + v + 1)) for w in token(t))) for i, t in rows]


def test_lm_base_and_model(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    got = lm.lm_scores(docs, learn=queries.common.crc_mod(F.col("doc_id"), 7) != 2, keep=["doc_id", "text"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(got, key=lambda r: key((r.doc_id, r.n_tokens)))
    want = sorted(plain_lm(rows, learn), key=key)
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:4] for w in want]
    assert np.allclose([r.base_score for r in got], [w[4] for w in want], rtol=1e-9)
    assert all(r.score <= 0 for r in got)


def plain_mixture(held, buckets, rounds=500):
    """Weights by context bucket, by expectation-maximisation over single tokens (bucket, bigram, unigram and floor probability)."""
    out = {}
    for b in buckets:
        p = np.array([x[1:] for x in held if x[0] == b])
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = lam * p
            new = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3
            lam = new / new.sum()
        out[b] = lam
    return out


@pytest.mark.parametrize(("part_bytes", "group_tokens"), [(16 << 20, 1_500_000), (100, 1), (1000, 200)])
def test_lm_model_against_plain(spark, monkeypatch, part_bytes, group_tokens):
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(12) for k in [rng.randrange(30)] for w in (f"r{k}", rng.choice(["a", f"q{k}"])))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seqs = {i: [*t.encode().split(), b"\n"] for i, t in rows}
    heads = Counter(w for i in range(60) for w in seqs[i])
    pairs = Counter(p for i in range(60) for p in zip([b"\n", *seqs[i]], seqs[i], strict=False))
    found, kept = [], lm.mixture
    monkeypatch.setattr(lm, "mixture", lambda *a: found.append(kept(*a)) or found[-1])
    got = {r.doc_id: r.score for r in lm.lm_scores(df, learn=F.col("doc_id") < 60, keep=["doc_id"], part_bytes=part_bytes, group_tokens=group_tokens).collect()}
    lam, n = found[-1], heads.total()
    for i, s in seqs.items():
        p = 0.0
        for a, b in zip([b"\n", *s], s, strict=False):
            w = lam[heads[a].bit_length()]
            p += math.log10(w[0] * pairs[a, b] / max(1, heads[a]) + w[1] * heads[b] / n + w[2] / (len(heads) + 1))
        assert math.isclose(got[i], p, rel_tol=1e-9)
    held = [((heads[a] - 1).bit_length(), (pairs[a, b] - 1) / max(1, heads[a] - 1), (heads[b] - 1) / (n - 1), 1 / (len(heads) + 1)) for i in range(60) for a, b in zip([b"\n", *seqs[i]], seqs[i], strict=False)]
    for b, w in plain_mixture(held, {h[0] for h in held}).items():  # the operator bins the estimates
        assert np.allclose(lam[b], w, atol=0.02)
    base = {r[0]: r[4] for r in plain_lm(rows, lambda i: i < 60)}
    assert sum(got[i] for i in range(60, 80)) > sum(base[i] for i in range(60, 80))


def test_lm_memory_does_not_follow_documents(spark):
    """200,000 texts of one word: what a part gets and gives back follows the different words of its groups, not the texts."""
    df = spark.range(200_000).select(F.lit(True).alias("train"), F.concat(F.lit("w"), F.col("id") % 50).cast("binary").alias("text")).repartition(4)
    coded = lm.stored(lm.coded_groups(df, 50, 1_500_000), "coded")
    counts = lm.stored(lm.corpus_counts(coded.filter("keys IS NOT NULL")), "counts")
    sent, back = (x.groupBy("part").agg(F.sum(F.octet_length(c)).alias("n"), F.count(c).alias("rows")).agg(F.max("n"), F.max("rows")).head() for x, c in ((coded.filter("keys IS NOT NULL"), "keys"), (counts.filter("grp IS NOT NULL"), "counts")))
    assert max(sent[0], back[0]) < 4 * 600 and max(sent[1], back[1]) <= 4
    assert tuple(counts.agg(F.sum("total"), F.sum("distinct")).head()) == (400_000, 51)


def test_lm_names(docs):
    with pytest.raises(ValueError, match="score"):
        lm.lm_scores(docs.withColumn("score", F.lit(1)), learn=F.lit(True), keep=["score"])


def test_lm_nothing_to_learn(spark, docs, none):
    got = lm.lm_scores(docs, learn=F.lit(False), keep=["doc_id"]).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 and r.score == 0 for r in got)
    assert lm.lm_scores(none, learn=F.lit(True)).collect() == []


def test_pack():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 1 << 62, 999).astype(np.uint64)), rng.normal(size=7)
    x, y, z = lm.unpack(lm.pack(lm.ascending(a), b, np.zeros(0, np.uint32)))
    assert (np.cumsum(x, dtype=np.uint64) == a).all() and (y == b).all() and len(z) == 0


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(8)
    words = [f"t{rng.randrange(5000)}" for _ in range(3000)]
    a, n, d = substrings.chunks(" ".join(words).encode(), 5, 24)
    assert a[0] == 0 and (a[1:] == a[:-1] + n[:-1]).all() and a[-1] + n[-1] == 3000 and n.max() <= 24
    _, _, e = substrings.chunks(("x y z  \n" + "  ".join(words)).encode(), 5, 24)
    assert len(set(d.tolist()) & set(e.tolist())) > 0.98 * len(d)
    same = substrings.chunks(b"na " * 1000, 5, 24)
    assert same[1].sum() == 1000 and same[1].max() <= 24


def test_repeats(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(40)}" for _ in range(n))
    passage = fresh(60)
    rows = [(i, fresh(80)) for i in range(20)] + [(30, f"{fresh(40)}\n{passage}  {fresh(30)}"), (31, f"{passage} {fresh(50)}"), (32, f"{fresh(9)} {passage}"), (33, f"{fresh(5)} {passage} {fresh(20)} {passage}")]
    rows += [(40, None), (41, ""), (None, f"{passage} end"), rows[0]]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, id int, found string")
    got = {(r.doc_id, r.text): r for r in substrings.repeats(df, keep=["doc_id", "text"]).collect()}
    for i, t in rows:
        r = got[i, t]
        if i is not None and i < 20:
            assert not r.removed and r.clean == t
        elif i in (30, 31, 32, 33, None):
            assert r.repeated
            gone = sum(x.b - x.a for x in r.removed)
            if i == 30:
                assert gone == 0 and r.clean == t
            else:
                assert 30 <= gone <= (125 if i == 33 else 65) and passage not in r.clean and 30 in r.sources
                assert set(r.clean.split()) <= set(t.split())
        else:
            assert r.clean == t
    cleaned = substrings.drop_repeats(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    assert substrings.repeats(df.filter("false")).collect() == []


def test_repeats_need_a_sequence(spark):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(40)}" for _ in range(n))
    cells = []
    while len(cells) < 40:
        words = fresh(400).split()
        a, n, _ = substrings.chunks(" ".join(words).encode(), 5, 24)
        cells += [" ".join(words[i : i + k]) for i, k in zip(a[1:-1].tolist(), n[1:-1].tolist(), strict=True) if k >= 3]
    phrases = cells[:40]
    rows = [(i, " ".join(rng.sample(phrases, 12))) for i in range(30)]
    passage = fresh(90)
    rows += [(100, f"{fresh(30)} {passage} {fresh(30)}"), (101, f"{fresh(30)} {passage} {fresh(30)}"), (102, "na " * 300)]
    have = Counter()
    for _, t in rows[:30]:
        w = t.split()
        have.update({" ".join(w[k : k + 20]) for k in range(len(w) - 19)})
    got = {r.doc_id: r for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    clean = [i for i, t in rows[:30] if not any(have[" ".join(t.split()[k : k + 20])] > 1 for k in range(len(t.split()) - 19))]
    assert len(clean) > 20
    assert all(not got[i].repeated and not got[i].removed and not got[i].sources and got[i].clean == rows[i][1] for i in clean)
    assert got[101].sources == [100] and not got[100].removed and passage not in got[101].clean
    for x in [got[101].removed]:
        a, n, _ = substrings.chunks(rows[31][1].encode(), 5, 24)
        b, m, _ = substrings.chunks(rows[30][1].encode(), 5, 24)
        same = [(s, s + k) for s, k in zip(a.tolist(), n.tolist(), strict=True) if 30 <= s and s + k <= 120 and (s, k) in set(zip(b.tolist(), m.tolist(), strict=True))]
        assert [(r.a, r.b) for r in x] == [(same[0][0], same[-1][1])]
    assert 20 <= len(got[102].clean.split()) < 100


def plain_chunks(text, mean=5, most=24):
    """(first word, words) of each chunk, by a rolling hash computed anew at each word's end."""
    w = text.encode().split()
    line, out, start, pos = b" ".join(w), [], 0, 0
    for i, x in enumerate(w):
        pos += len(x) + (i > 0)
        h = sum(int(substrings.GEAR[line[pos - 1 - k]]) << k for k in range(min(16, pos))) & 0xFFFFFFFF
        if ((h >> 8) * 2654435761 & 0xFFFFFFFF) < (1 << 32) // mean or i == len(w) - 1 or i + 1 - start == most:
            out.append((start, i + 1))
            start = i + 1
    return out


def plain_repeats(rows, least=20):
    """What repeats() returns, for rows whose ids differ."""
    wins, seen = [], {}
    for i, t in rows:
        c = plain_chunks(t or "")
        pick = {(a, next(e for _, e in c if e >= a + least)) for a, _ in c if c[-1][1] >= a + least}
        pick |= {(max(a for a, _ in c if a <= e - least), e) for _, e in c if e >= least and e not in {y for _, y in pick}}
        words = (t or "").split()
        wins.append(sorted((a, e, tuple(tuple(words[x:y]) for x, y in c if a <= x and y <= e)) for a, e in pick))
        for a, _, x in wins[-1]:
            seen.setdefault(x, []).append((i, a))
    out = {}
    for (i, t), own in zip(rows, wins, strict=True):
        spans, removed, sources = [], [], set()
        for a, e, x in own:
            if len(seen[x]) < 2:
                continue
            at = min(p for d, p in seen[x] if d == i)
            first = min(d for d, _ in seen[x])
            gone = first != i or a >= at + e - a
            if gone and first != i:
                sources.add(first)
            for to in [spans] + [removed] * gone:
                if to and a <= to[-1][1]:
                    to[-1] = (to[-1][0], max(e, to[-1][1]))
                else:
                    to.append((a, e))
        parts = re.findall(r"\S+\s*", t or "")
        lead = re.match(r"\s*", t or "")[0]
        clean = t if not removed else lead + "".join(p for k, p in enumerate(parts) if not any(a <= k < e for a, e in removed))
        out[i] = (len((t or "").split()), bool(spans), spans, removed, sorted(sources), clean)
    return out


def test_repeats_against_plain(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(30)}" for _ in range(n))
    passages = [fresh(rng.choice([15, 25, 60, 200])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [fresh(rng.randrange(40)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(7))]
        rows.append((i * 3 % 61, "  \n".join(parts)))
    rows += [(100, None), (101, " \t"), (102, rows[5][1]), (103, rows[5][1]), (104, "na " * 300), (105, " ".join(passages) * 40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.repeated, [tuple(x) for x in r.spans], [tuple(x) for x in r.removed], r.sources, r.clean) for r in substrings.repeats(df, keep=["doc_id"]).collect()}
    assert got == plain_repeats(rows)
    clash = df.withColumns({c: F.lit(c) for c in ("clean", "r", "found", "id", "sig", "score", "_keep_0", "n_chars")})
    kept = substrings.drop_repeats(clash)
    assert kept.columns == clash.columns and {r.doc_id: r.text for r in kept.collect()} == {i: x[-1] for i, x in got.items()}
    with pytest.raises(ValueError, match="overwritten"):
        substrings.repeats(clash, keep=["clean"])
    with pytest.raises(ValueError, match="integer"):
        substrings.repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    unknown = spark.createDataFrame([(None, passages[2]), (None, passages[2]), (None, f"x y {passages[2]} z"), (9, passages[2])], "doc_id int, text string")
    assert {(r.text, bool(r.removed), tuple(r.sources)) for r in substrings.repeats(unknown, keep=["text", "doc_id"]).collect() if r.doc_id is None} == {(passages[2], True, (9,)), (f"x y {passages[2]} z", True, (9,))}


def test_share_targets():
    assert mixing.share_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.share_targets([0, 10], [5, 2], 15, 2) == [0.0, 15.0]
    assert mixing.share_targets([], [], 0, 2) == []


def plain_targets(sizes, weights, total, ceiling):
    """Targets by raising one common level until the total is shared out: each source gets level times its weight, but no more than its ceiling."""
    lo, hi = 0.0, 2.0 * total / min(weights) + 1
    give = lambda level: [min(level * w, ceiling * s) for w, s in zip(weights, sizes, strict=True)]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(give(mid)) < total else (lo, mid)
    return give(hi)


def test_share_targets_against_plain():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 50, 1000, 30_000]) + rng.randrange(9) for _ in range(rng.randrange(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.share_targets(sizes, weights, 1.5 * sum(sizes), 2.0)
        assert np.allclose(got, plain_targets(sizes, weights, 1.5 * sum(sizes), 2.0), rtol=1e-9, atol=1e-6)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 500, 300).astype(float)
    p = np.full(300, 0.37)
    out = mixing.flight(p, np.column_stack([w, np.ones(300)]), rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert math.isclose((out * w).sum(), (p * w).sum(), rel_tol=1e-6) and math.isclose(out.sum(), p.sum(), rel_tol=1e-6)


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "c", "d", "é", "z"]), rng.choice([0, 1, 5, 50, 900])) for i in range(3000)] + [(1, "a", None), (None, "a", 7), (1, "a", 5), (1, "a", 5)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, words long, times int")
    run = lambda d: d.collect()
    mix = lambda d: mixing.mix_sources(d, source="source", size="words", key="doc_id", keep=["doc_id", "source"], block=128)
    got = run(mix(df))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, w in rows:
        sizes[s] += w or 0
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, mixing.share_targets([sizes[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2), strict=True))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and r.taken == r.size * r.times and r.times <= 2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 900 for s in order)
    again = run(mix(df.repartition(7)))
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == Counter((r.doc_id, r.source, r.size, r.taken) for r in again)
    assert run(mix(df.filter("false"))) == []


def test_mix_documents(spark, docs):
    got = mixing.mix_documents(docs)
    assert got.columns == [*docs.columns, "times"]
    rows = got.collect()
    assert rows and all(r.times >= 1 for r in rows)
    assert mixing.mix_documents(docs.filter("false")).collect() == []
    with pytest.raises(ValueError, match="times"):
        mixing.mix_documents(docs.withColumn("times", F.lit(1)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


def test_pipeline(spark):
    """Stages by what they are documented to do, each on what its predecessor kept: near copies, repeats and benchmark passages against plain versions."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = queries.common.stored(stage(spark, docs, sf), "test")
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
        assert 0 < out.count() <= docs.count() and len(before) == docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.dtypes == docs.dtypes
        if name == "near_dedup":
            ids = sorted(before)
            root = plain_near([before[i] for i in ids])
            assert sorted(after) == sorted({ids[r] for r in root.values()})
        elif name == "substring_dedup":
            assert after == {i: x[-1] for i, x in plain_repeats(list(before.items())).items()}
        elif name == "decontamination":
            hit = {r[0]: (r[1], r[2]) for r in plain_contamination(list(before.items()), items)}
            assert set(after) == {i for i, (n, h) in hit.items() if h <= 0.5 * n}
            assert all((after[i] == before[i]) == (hit[i][1] == 0) for i in after)
        docs = out
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, docs.collect()))


def test_pipeline_stages_with_clashing_names(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(c) for c in ("score", "predicted", "clean", "removed", "key", "fps", "stats", "label", "_keep_0", "_in_0", "node", "spans", "w", "_text")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.filter("score <> 'score' or clean <> 'clean' or _text <> '_text'").count() == 0, name
        empty = stage(spark, docs.filter("false"), sf)
        assert empty.columns == docs.columns and empty.collect() == []
