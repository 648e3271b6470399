"""Jaccard components, aligned tokenizers and the filter audit against plain versions, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import alignment, audit, jaccard, queries

DOC = "doc_id long, text string, lang string, key long, n long, mask int"
A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def family_rows(seed=1):
    """Families of near copies around the threshold, exact copies, short and odd texts."""
    rng, texts = random.Random(seed), []
    for size in (3, 5, 6, 7, 12, 25, 60, 150, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += [" ".join(edited(rng, base, rng.randrange(0, max(2, size // 40 + 1)))) for _ in range(7)]
    texts += [texts[0], texts[50].upper(), texts[100].replace(" ", " \t\n "), "", None, None, " \n", "one", "one", "a b c", "ab c", "Äpfel und ÄPFEL und mehr", "äpfel und äpfel und mehr"]
    rng.shuffle(texts)
    return [(None if i == 3 else i, t, ["en", "de", None, ""][i % 4], 1, 2, 3) for i, t in enumerate(texts)] + [(7, texts[7], "en", 1, 2, 3)]


def plain_set(text, k=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(sets, num, den):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def plain_jaccard(rows, num=85, den=100):
    sets = [plain_set(r[1]) for r in rows]
    groups = plain_components(sets, num, den)
    out = []
    for i, r in enumerate(rows):
        ids = [q[0] for q, g in zip(rows, groups, strict=True) if g == groups[i] and q[0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return Counter(out)


@pytest.mark.parametrize(("num", "den", "capacity", "leaf_bytes", "broadcast_rows"), [(85, 100, 128, 4 << 20, 1000), (85, 100, 3, 4 << 20, 0), (6, 10, 4, 1 << 12, 1000), (95, 100, 128, 1, 1000)])
def test_jaccard_components(spark, num, den, capacity, leaf_bytes, broadcast_rows):
    rows = family_rows()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC), num=num, den=den, capacity=capacity, leaf_bytes=leaf_bytes, broadcast_rows=broadcast_rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == plain_jaccard(rows, num, den)


def test_jaccard_large_family(spark):
    """One family of many near copies with strays: leaves that are tied as a whole aren't compared again, and the strays lose no link."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 1, 2, 3, 4]))), "en", 1, 2, 3) for i in range(300)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC), capacity=16)
    assert Counter(map(tuple, got.collect())) == plain_jaccard(rows)


def test_jaccard_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert jaccard.jaccard_components(none).collect() == []
    nothing = spark.createDataFrame([(None, None, None, 1, 2, 3), (5, "", None, 1, 2, 3)], DOC)
    assert {tuple(r) for r in jaccard.jaccard_components(nothing).collect()} == {(None, 0, None), (5, 0, 5)}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (6, 10), (8, 10)])
def test_bands_miss_no_pair(num, den):
    """Sets at the very threshold share a named slice, whatever their sizes."""
    rng, bands = np.random.default_rng(3), jaccard.Bands(num, den)
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            swap = rng.integers(0, n + 1)
            for gone in range(0, n):
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(swap * gone / n), dtype=np.uint64)])
                if den * (n - gone) < num * (n + len(b) - (n - gone)):
                    break
                if gone == 0 or rng.random() < 0.8 and n > 100:
                    continue
                assert set(bands.names(np.unique(a)).tolist()) & set(bands.names(np.unique(b)).tolist()), (n, gone, len(b))


def test_box_bound_is_no_smaller_than_what_sets_share():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)
        b = rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)
        a, b = np.unique(a), np.unique(b)
        assert np.minimum(jaccard.counts_of(a), jaccard.counts_of(b)).sum() >= len(np.intersect1d(a, b))


TEXTS = ["Hello, world! It's  1 000 things.", "a", " ", "  ", "a ", "\n", "x\n\ny \n z\r\n\tq", "tail \n", "naïve café — “quoted”", "日本語のテキスト　です", "a b c  d", "▁ not spelled", "fine ▁", "<s> </s> <|endoftext|> <0x41>", "emoji 👩‍👩‍👧 done", "\x00\x1c \x1d ", "=" * 300 + " " * 9 + "end", "the cat the cat the Cat", "", None]


def plain_alignment(texts):
    tok = alignment.Tokenizers(A, B)
    found, counts = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        a, b = tok.a.encode(" " + t, add_special_tokens=False).ids, tok.b.encode(t)
        sides = [[tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b]]
        if any(b"".join(s) != (" " + t).encode() for s in sides):
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(x, y) for x, p, q in zip(a, starts[0], ends[0], strict=True) for y, u, v in zip(b, starts[1], ends[1], strict=True) if p < v and u < q]
        cuts, groups, low = sorted(set(ends[0]) & set(ends[1])), [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es, strict=True) if low < e <= c) for ids, es in zip((a, b), ends, strict=True)))
            low = c
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
        counts.update(set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(0,) * 6 + ("",) if f is None else (f[0], f[1], f[2], len(f[3]), sum(counts[x] == most[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("portion", [1, 200, 2 << 20])
def test_aligned_texts(spark, portion):
    rng = random.Random(2)
    chars = "ab é世\n \t.1'<>▁"
    texts = [*TEXTS, *TEXTS[:5], *["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(60)], "long word " * 3000]
    df = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in enumerate(texts)], DOC)
    got = alignment.aligned_texts(df, a=A, b=B, keep=["doc_id", "n", "mask"], portion=portion)
    rows = sorted(map(tuple, got.collect()))
    assert [r[3:] for r in rows] == plain_alignment(texts)
    assert {r[1:3] for r in rows} == {(2, 3)}


def test_alignment_edges(spark):
    none = spark.createDataFrame([], DOC)
    assert alignment.aligned_texts(none, a=A, b=B, keep=["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="n_best"):
        alignment.aligned_texts(none.withColumn("n_best", F.lit(1)), a=A, b=B, keep=["n_best"])
    nothing = spark.createDataFrame([(1, None, None, 1, 2, 3), (2, "▁", None, 1, 2, 3)], DOC)
    assert {tuple(r)[1:] for r in alignment.aligned_texts(nothing, a=A, b=B, keep=["doc_id"]).collect()} == {(0,) * 6 + ("",)}


def test_alignment_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "Hello there", "en", 1, 2, 3), (2, None, "en", 1, 2, 3)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_alignment(spark, str(tmp_path)).collect()}
    assert got[1]["groups_sha256"] == hashlib.sha256(plain_alignment(["Hello there"])[0][-1].encode()).hexdigest() and got[2]["groups_sha256"] == ""


def plain_masks(rows):
    least, out = {}, []
    for r in rows:
        if r[0] is not None:
            t = r[1] or ""
            least[t] = min(least.get(t, r[0]), r[0])
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = t in least and (r[0] is None or r[0] > least[t])
        out.append((len(w) < 200) | (100 * len(set(w)) < 50 * len(w)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) << 2 | bool(re.search(r"[#$%&*|]", t)) << 3 | e << 4)
    return out


def audit_rows():
    rng = random.Random(9)
    pool = [" ".join(rng.choice(["alpha", "beta", "Gamma", "DELTA", "eins", "zwei"]) + str(rng.randrange(rng.choice([2, 400]))) for _ in range(rng.choice([1, 150, 199, 200, 260]))) for _ in range(12)]
    pool += ["", None, "é" * 40 + "A", "ÉÉ", "x # y", "a$", " \n", "long text " * 5000]
    return [(rng.choice([None, *range(150)]), rng.choice(pool), rng.choice(["en", "de", "", None]), 1, 2, 3) for _ in range(400)]


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_failure_masks(spark, partitions):
    rows = audit_rows()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, DOC).withColumnRenamed("mask", "head").withColumnRenamed("key", "end")
        got = audit.failure_masks(df, keep=["lang", "end", "head", "text"])
        assert got.columns == ["lang", "end", "head", "text", "doc_id", "mask"]
        assert Counter((r["doc_id"], r["text"], r["lang"], r["mask"]) for r in got.collect()) == Counter((r[0], r[1], r[2], m) for r, m in zip(rows, plain_masks(rows), strict=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, *x) for i in range(0, 150, 2) for x in [(i % 3 == 0, i % 5 == 0)]] + [(4, True, True), (None, True, True), (9, None, None)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    want = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], m) for r, m in zip(rows, plain_masks(rows), strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations(range(5)):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1] >> f & 1], [d for d in left if not d[1] >> f & 1]
                fails = [d for d in docs if d[1] >> f & 1]
                shapley[f] += len(gone)
                want[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), len(fails) - len(gone), sum(d[1] == 1 << f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(shapley["ABCDE".index(order[step - 1])])
    got = audit.filter_audit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got.collect()} == want
    assert audit.filter_audit(spark.createDataFrame([], DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
    with pytest.raises(ValueError, match="mask"):
        audit.failure_masks(spark.createDataFrame(rows, DOC), keep=["mask"])


def test_jaccard_in_parts(spark, monkeypatch):
    """Names and pairs of leaves exchanged in parts tie the same texts, and no part takes all names."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(12):
        base = rng.choice(words, 60).tolist()
        for k in range(6):
            text = list(base)
            for at in rng.integers(0, 60, k % 3):
                text[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {tuple(r) for r in jaccard.jaccard_components(df, capacity=4).collect()}
    names = []
    plain = jaccard.shared_slices
    monkeypatch.setattr(jaccard, "_PART_BYTES", 1000)
    monkeypatch.setattr(jaccard, "_PAIR_BYTES", 1)
    monkeypatch.setattr(jaccard, "_PARTS", 3)
    monkeypatch.setattr(jaccard, "shared_slices", lambda s, **how: names.append(how) or plain(s, **how))
    assert {tuple(r) for r in jaccard.jaccard_components(df, capacity=4).collect()} == whole
    assert len({r[2] for r in whole}) < len(rows) and len(names) == names[0]["parts"] == 3
