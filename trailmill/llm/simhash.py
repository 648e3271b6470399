"""SimHash fingerprints of documents and their links by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, portions, stored
from .components import components


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included. A-Z count as a-z; a text of fewer words is one shingle; without words there are none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    return np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip((ends - size)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of a text."""
    return majority(shingle_hashes(text, shingle, seed))


def rehash(hashes: np.ndarray, n: int) -> np.ndarray:
    """The nth other hash of what was hashed: the bits mixed anew by shifts and odd products."""
    h = (hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def fingerprints(text: Column, shingle: int, seed: int = 42) -> Column:
    """The fingerprint of each whole text as a long (two's complement); null counts as empty."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(x or b"", shingle, seed) for part in portions(batch) for x in part], np.uint64).view(np.int64), pa.int64())

    return of(text.cast("binary"))


def normal(text: bytes) -> bytes:
    """A text's words in lower case (A-Z), parted by single spaces: what shingles are cut from."""
    return b" ".join(text.lower().split())


def text_keys(text: Column) -> Column:
    """A 64-bit hash of each text's normal form; null counts as empty."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([xxhash.xxh3_64_intdigest(normal(x or b"")) for part in portions(batch) for x in part], np.uint64).view(np.int64), pa.int64())

    return of(text.cast("binary"))


def sketches(text: Column, shingle: int, kinds: int, seed: int = 42) -> Column:
    """struct(key, fps) of each whole text: its key as text_keys() has it, its fingerprint and kinds - 1 others from the same shingles hashed anew; fps is null without words."""

    @F.arrow_udf("struct<key:bigint,fps:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys, out, none = [], [], []
            for part in portions(batch):
                for x in part:
                    keys.append(xxhash.xxh3_64_intdigest(normal(x or b"")))
                    h = shingle_hashes(x or b"", shingle, seed)
                    none.append(not len(h))
                    out += [majority(rehash(h, k) if k else h) for k in range(kinds)]
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * kinds), pa.array(np.array(out, np.uint64).view(np.int64), pa.int64()), mask=pa.array(none, pa.bool_()))
            yield pa.StructArray.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()), fps], ["key", "fps"])

    return of(text.cast("binary"))


def shingle_sets(text: Column, shingle: int, seed: int = 42) -> Column:
    """The different shingle hashes of each whole text in ascending order, as bytes."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.unique(shingle_hashes(x or b"", shingle, seed)).tobytes() for part in portions(batch) for x in part], pa.binary())

    return of(text.cast("binary"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two shingle sets, 0 where one is empty."""

    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left))
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) and len(q):
                both = np.sort(np.concatenate([p, q]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                out[i] = same / (len(p) + len(q) - same)
        return pa.array(out)

    return of(a, b)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical form: 64 bit planes of packed words, lane i of a plane being that bit of fingerprint i."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    full = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    full[:, : len(fps)] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, fps: np.ndarray, radius: int, skip: int = 0, lanes_a_step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with queries[i] and fps[j] at most radius bits apart, in batches.

    The planes of fps are compared with a query 64 lanes at a time. Two planes of differences enter the vertical counters
    by one carry-save adder; the counters start so far up that they overflow just beyond the radius, into a sticky plane. After every few
    planes the blocks of 64 lanes whose lanes have all overflowed are abandoned. Bits in skip are known to agree.
    """
    planes = planes_of(fps)
    width = max(1, (radius + 1).bit_length())
    start = (1 << width) - 1 - radius
    lanes = planes.shape[1]
    pad = np.zeros(lanes, np.uint64)
    if len(fps) % 64:
        pad[-1] = ~np.uint64((1 << len(fps) % 64) - 1)
    ones, zero = ~np.uint64(0), np.uint64(0)
    order = [b for b in range(64) if not skip >> b & 1]
    for at in range(0, len(queries), step := max(1, lanes_a_step // lanes)):
        q = queries[at : at + step]
        qi, wi = np.repeat(np.arange(len(q)), lanes), np.tile(np.arange(lanes), len(q))
        over = np.tile(pad, len(q))
        count = [np.full(len(qi), ones if start >> k & 1 else zero) for k in range(width)]
        for n in range(0, len(order), 2):
            x = planes[order[n]][wi] ^ (zero - (q >> np.uint64(order[n]) & np.uint64(1)))[qi]
            y = planes[order[n + 1]][wi] ^ (zero - (q >> np.uint64(order[n + 1]) & np.uint64(1)))[qi] if n + 1 < len(order) else np.zeros_like(x)
            c, both = count[0], x ^ y
            count[0] = c ^ both
            carry = (x & y) | (c & both)
            for k in range(1, width):
                carry, count[k] = count[k] & carry, count[k] ^ carry
            over |= carry
            if n >= 8 and n % 6 == 0:
                live = np.flatnonzero(over != ones)
                if len(live) < 0.7 * len(over):
                    qi, wi, over, count = qi[live], wi[live], over[live], [c[live] for c in count]
                    if not len(live):
                        break
        if len(over):
            hit = np.flatnonzero(over != ones)
            r, lane = np.nonzero(np.unpackbits((~over[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            if len(r):
                yield at + qi[hit][r], wi[hit][r] * 64 + lane


class _Forest:
    """Union by smallest label over arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, up := root[root]):
                root = up
            self.root = root


def _block_links(left: np.ndarray, right: np.ndarray | None, radius: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block (or between two) as a forest: no more links than fingerprints, the same components."""
    fps = left if right is None else np.concatenate([left, right])
    forest = _Forest(len(fps))
    for i, j in within(left, left if right is None else right, radius, skip):
        forest.join(i, j if right is None else j + len(left))
    moved = np.flatnonzero(forest.root != np.arange(len(fps)))
    return fps[moved], fps[forest.root[moved]]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links (a, b), given in order of preference, that make up the best spanning forest of n nodes."""
    forest, live, kept = _Forest(n), np.arange(len(a)), []
    while True:
        x, y = forest.root[a[live]], forest.root[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return np.sort(np.concatenate(kept)) if kept else live
        best = np.full(n, -1)
        for ends in (x, y):
            first = np.full(n, len(a))
            first[ends[::-1]] = live[::-1]
            best = np.where(best < 0, first, np.minimum(best, first))
        kept.append(np.unique(best[best < len(a)]))
        forest.join(a[kept[-1]], b[kept[-1]])


def _block_pairs(left: np.ndarray, right: np.ndarray | None, radius: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """As _block_links, but with links that are themselves within the radius: of all, those of the spanning forest of least distance, ties to smaller fingerprints."""
    fps = left if right is None else np.concatenate([left, right])
    a = b = np.zeros(0, np.int64)
    for i, j in within(left, left if right is None else right, radius, skip, lanes_a_step=1 << 14):
        i, j = (i[i < j], j[i < j]) if right is None else (i, j + len(left))
        a, b = np.append(a, i), np.append(b, j)
        x, y = fps[a], fps[b]
        order = np.lexsort((np.maximum(x, y), np.minimum(x, y), np.bitwise_count(x ^ y)))
        a, b = a[order], b[order]
        kept = spanning(len(fps), a, b)
        a, b = a[kept], b[kept]
    return fps[a], fps[b]


def tables_for(n: int, radius: int, per_bucket: int = 4096) -> list[int]:
    """Masks such that any two fingerprints within radius agree on the bits of one mask at least.

    The 64 bits are cut into radius + k even pieces; radius differing bits spoil radius of them at most, so some k
    pieces agree whole. k is the least for which n evenly spread fingerprints would put per_bucket into a bucket.
    """
    for k in range(1, 4):
        cuts = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
        pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        if n <= per_bucket * 2.0 ** (64 * k / (radius + k)) or k == 3:
            return [sum(c) for c in combinations(pieces, k)]
    raise AssertionError


def near_links(fps: DataFrame, radius: int = 4, block: int = 2048, nearest: bool = False) -> DataFrame:
    """(u, v) links over distinct fingerprints (column fp: long) whose components are those of all pairs at most radius bits apart.

    Exact by the pigeonhole principle: every pair within the radius meets in a bucket of a table of tables_for. A bucket of more than
    block fingerprints is cut by hash into pieces, and each pair of pieces is a task of its own, so no task holds more than about two pieces. A
    block yields a spanning forest, not all its pairs. With nearest its links are pairs within the radius, the closest that make such a forest; else any that have the same components.
    """
    link = _block_pairs if nearest else _block_links
    masks = tables_for(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])).alias("b")).select("fp", "b.t", "b.k")
    hot = rows.groupBy("t", "k").count().filter(F.col("count") > block).select(F.col("t").alias("_t"), F.col("k").alias("_k"), F.ceil(F.col("count") / block).cast("int").alias("_n"))
    rows = rows.join(hot, (F.col("t") == F.col("_t")) & (F.col("k") == F.col("_k")), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int")
    rows = rows.select("fp", "t", "k", own.alias("c"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("o"))
    rows = rows.select("t", "k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "fp").repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def solve(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            cuts = np.flatnonzero((x[1:, :4] != x[:-1, :4]).any(axis=1)) + 1
            out = []
            for part in np.split(x, cuts):
                if len(part) > 1:
                    f = np.ascontiguousarray(part[:, 5]).view(np.uint64)
                    t, _, a, b, *_ = part[0]
                    left = part[:, 4] == a
                    if a == b:
                        out.append(link(f, None, radius, masks[t]))
                    elif left.any() and not left.all():
                        out.append(link(f[left], f[~left], radius, masks[t]))
            return out

        def batch_of(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            u = np.concatenate([x[0] for x in links]) if links else np.zeros(0, np.uint64)
            v = np.concatenate([x[1] for x in links]) if links else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                change = np.flatnonzero((x[1:, :4] != x[:-1, :4]).any(axis=1))
                first = bool(kept) and (kept[-1][-1, :4] != x[0, :4]).any()
                if len(change) or first:
                    cut = change[-1] + 1 if len(change) else 0
                    links = solve(np.concatenate([*kept, x[:cut]]))
                    kept = [x[cut:]]
                    yield batch_of(links)
                else:
                    kept.append(x)
        if kept:
            yield batch_of(solve(np.concatenate(kept)))

    return rows.mapInArrow(blocks, "u bigint, v bigint").distinct()


def fingerprint_groups(docs: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """(fp, root, component_id, min_id, copies) for each distinct fingerprint of docs (doc_id, fp): its smallest doc_id, and the smallest of all it can reach by links of radius bits."""
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("copies")), "nodes")
    roots = components(near_links(nodes.select("fp"), radius, block))
    joined = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "min_id", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    # stored, so that the join with a component of very many fingerprints can be split
    low = stored(joined.groupBy("root").agg(F.min("min_id").alias("component_id")), "lowest")
    return joined.join(low, "root").select("fp", "root", "component_id", "min_id", "copies")


def simhash_components(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42, block: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of each row of df.

    component_id is the smallest doc_id that can be reached by links between fingerprints that differ in radius bits or fewer,
    the row's own included. Null and empty texts, and those without words, have fingerprint zero and link like any other. Null ids take no part in the minimum; where
    all ids of a component are null so is component_id. Repeated rows come out repeated; other columns of df are ignored.
    """
    docs = stored(df.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle, seed).alias("fp")), "fingerprints")
    groups = fingerprint_groups(docs, radius, block)
    return docs.join(groups.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def candidate_links(nodes: DataFrame, kinds: int, radius: int, block: int) -> DataFrame:
    """(a, b) keys, a < b, of texts of nodes (key, fps) that share a fingerprint of a kind, or have one within radius bits: such pairs, or enough of them to tie together all that any would.

    Of the texts that share a fingerprint the one with the smallest key stands for it.
    """
    out = None
    for k in range(kinds):
        per = nodes.filter(F.col("fps").isNotNull()).select("key", F.col("fps")[k].alias("fp"))
        stands = stored(per.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "stands")
        links = near_links(stands.select("fp"), radius, block, nearest=True)
        a, b = (stands.select(F.col("fp").alias(e), F.col("rep").alias(f"{e}_key")) for e in ("u", "v"))
        ends = links.join(a, "u").join(b, "v").select(F.col("u_key").alias("x"), F.col("v_key").alias("y"))
        shared = per.join(stands.filter("n > 1").select(F.col("fp").alias("_fp"), "rep"), F.col("fp") == F.col("_fp")).select(F.col("key").alias("x"), F.col("rep").alias("y"))
        # stored kind by kind, so that neither plans nor stages of all kinds stand at once
        both = stored(ends.union(shared).filter("x <> y"), "kind")
        out = both if out is None else out.union(both)
    return out.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(texts: DataFrame, nodes: DataFrame, *, shingle: int, radius: int, kinds: int, similarity: float, seed: int, block: int, broadcast_rows: int) -> DataFrame:
    """(node, root) keys of texts that have near copies, but for the roots themselves: components of links between texts (key, text) whose shingle sets have a Jaccard similarity of similarity or more. nodes has (key, fps, min_id) for each key.

    Candidates come from fingerprints and none is taken without its similarity. First each text is held against the one with the smallest id in its component of candidates; then those candidates are that
    have an end that was unlike. So a large group of near copies costs one comparison a text.
    """
    candidates = stored(candidate_links(nodes, kinds, radius, block), "candidates")
    guessed = components(candidates.select(F.col("a").alias("u"), F.col("b").alias("v")))
    guessed = stored(guessed.union(guessed.select(F.col("root").alias("node"), "root").distinct()), "guessed")
    ids = stored(guessed.join(nodes.select(F.col("key").alias("node"), "min_id"), "node"), "members")
    first = F.min(F.struct(F.col("min_id").isNull().alias("no_id"), F.col("min_id").alias("id"), F.col("node").alias("node")))
    heads = stored(ids.groupBy(F.col("root").alias("_root")).agg(first["node"].alias("head")), "heads")
    star = ids.join(heads, F.col("root") == F.col("_root")).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    touched = guessed.select(F.col("node").alias("_node"))
    touched = F.broadcast(touched) if guessed.count() <= broadcast_rows else touched
    wanted = texts.join(touched, F.col("key") == F.col("_node"), "left_semi").dropDuplicates(["key"])
    sets = stored(wanted.select("key", shingle_sets(F.col("text"), shingle, seed).alias("set")), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("key").alias(e), F.col("set").alias(f"set_{e}")) for e in ("a", "b"))
        met = pairs.join(left, "a").join(right, "b")
        return met.select("a", "b", jaccard(F.col("set_a"), F.col("set_b")).alias("j")).filter(F.col("j") >= similarity).select("a", "b")

    near = stored(alike(star), "near")
    sure = near.select(F.col("a").alias("k")).union(heads.select("head"))
    other = guessed.select("node").join(sure.select(F.col("k").alias("node")), "node", "left_anti")
    rest = candidates.join(other.select(F.col("node").alias("a")), "a", "left_semi").union(candidates.join(other.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    out = components(near.union(alike(rest)).select(F.col("a").alias("u"), F.col("b").alias("v")))
    for x in (sets, candidates, guessed, ids, near):
        discard(x)
    return out


def drop_near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, print_shingle: int = 2, radius: int = 5, kinds: int = 4, seed: int = 42, block: int = 2048, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of df without near copies. Texts are linked when their sets of word shingles (shingle words) have a Jaccard similarity of similarity or more, which is computed for all that have a fingerprint, of any of kinds sorts, within radius
    bits; fingerprints are of shorter shingles (print_shingle words), for a changed word spoils fewer of them; texts of the same words in the same order are linked, those without words and null ones among each other too. Of each component the row with the smallest doc_id stays (null ids come last; of rows that share it, one with the smallest hash of its words).

    All columns stay, whatever their names. Repeated rows are copies of each other. An empty table gives no rows. Texts that need shingle sets are picked by a broadcast of their keys up to broadcast_rows of them, which are counted, and by a shuffle join beyond.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("")).alias("id")
    # texts go through one exchange only: what is stored are ids and fingerprints
    ids = stored(df.select(F.col(doc_id).alias("doc_id"), sketches(F.col(text), print_shingle, kinds, seed).alias("s")).select("doc_id", "s.key", "s.fps"), "ids")
    nodes = stored(ids.groupBy("key").agg(F.min("doc_id").alias("min_id"), F.min("fps").alias("fps")), "nodes")
    forget(df.sparkSession)  # many small steps follow; what earlier ones left should not add to them
    # a key that can't be null: Spark would compute one that could be twice, first to see whether it is
    own = F.coalesce(text_keys(F.col(text)), F.lit(0))
    texts = df.select(own.alias("key"), F.col(text).alias("text"))
    roots = near_groups(texts, nodes, shingle=shingle, radius=radius, kinds=kinds, similarity=similarity, seed=seed, block=block, broadcast_rows=broadcast_rows)
    groups = stored(nodes.select("key", "min_id").join(roots, F.col("key") == F.col("node"), "left").select("key", "min_id", F.coalesce("root", "key").alias("root")), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("min_id").isNull().alias("no_id"), F.col("min_id").alias("id"), F.col("key").alias("key"))).alias("b"))
    best = best.select(F.col("b.key").alias("_key"), F.coalesce(F.concat(F.lit("="), F.col("b.id").cast("string")), F.lit("")).alias("_id"))
    single = df.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(df.columns)], name, own.alias("key")).dropDuplicates(["key", "id"])
    out = single.join(best, (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id")), "left_semi")
    return out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(df.columns)])
