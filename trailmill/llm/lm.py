"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform floor."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, forget, portions, shared_dir, stored

#: The end of a text; it holds white space, so no word is like it. It is also what precedes the first word.
END = b"\n"
#: Contexts by how often they occur: never, once, 2 or 3 times, 4 to 7 times and so on.
BUCKETS = 48
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Parts are worked on slice by slice, so that not all keys stand in an exchange at once.
SLICES = 4
CODED = "slice int, grp bigint, part int, keys binary, code binary, docs binary"
_MADE = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each one's bytes by significance, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = z.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    z, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(data):
        kind, n, size = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 20], "little")
        at += 20
        raw = z.decompress(data[at : at + size], max_output_size=n * kind.itemsize) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += size
    return out


def ascending(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, for pack; cumsum() takes them back."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype)) if len(keys) else keys


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each text; all tokens as numbers into hashes; hashes of the different tokens, the end's first."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[END]
    ids, n = [], []
    for t in texts:
        words = t.lower().split()
        words.append(END)
        n.append(len(words))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    return np.array(n, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)


def _portions(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about size bytes of text each."""
    for b in batches:
        at = 0
        for texts in portions(b.column("text"), size):
            yield b.slice(at, len(texts)), [t or b"" for t in texts]
            at += len(texts)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _bucket(counts: np.ndarray, buckets: int) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(counts, 0.0))[1], buckets - 1).astype(np.int64)


def _keys_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(33)) % np.uint64(parts)


def pair_keys(head: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair of hashes, in order."""
    x = (head ^ head >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + own * _SPREAD
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and each one's number."""
    values, number = np.unique(x, return_inverse=True)
    return values, number.astype(np.int32)


def coded_groups(docs: DataFrame, parts: int, group_tokens: int) -> DataFrame:
    """The tokens of docs (columns to keep, text: binary, train: boolean) by groups of texts, group_tokens each or so: (slice, grp, part, keys) with the keys of the group's different words and pairs that fall to a part and how often its training texts
    have them; and one row (grp, code, docs), in the last slice, with the texts as places of pairs in the order of parts, each pair's word, how often training texts have it, and the columns to keep."""
    kept = [c for c in docs.columns if c not in ("text", "train")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp = TaskContext.get().partitionId() << 24
        hs, ns, trains, tables, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            n, train, h = (np.concatenate(x) for x in (ns, trains, hs))
            learned = np.repeat(train, n)
            first_of = np.cumsum(n) - n
            head = np.empty_like(h)
            head[1:] = h[:-1]
            head[first_of] = h[-1]  # the last token is an end
            keys = pair_keys(head, h)
            del head
            words, word = _numbered(h)
            pairs, pair = _numbered(keys)
            del keys
            own = np.empty(len(pairs), np.int32)
            own[pair] = word
            w_n, p_n = (np.bincount(x, learned, minlength=len(k)).astype(np.uint32) for x, k in ((word, words), (pair, pairs)))
            (wo, we), (po, pe) = (_by_part(_keys_part(x, parts), parts) for x in (words, pairs))
            rows = []
            for p in np.flatnonzero(np.diff(we) + np.diff(pe)).tolist():
                a, b = wo[we[p] : we[p + 1]], po[pe[p] : pe[p + 1]]
                rows.append((p % SLICES, p, pack(ascending(words[a]), w_n[a], ascending(pairs[b]), p_n[b])))
            w_at, p_at = (np.empty(len(o), np.uint32) for o in (wo, po))
            w_at[wo], p_at[po] = np.arange(len(wo)), np.arange(len(po))
            code = pack(n, p_at[pair], w_at[own][po], p_n[po])
            table = pa.Table.from_batches(tables)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            k = len(rows)
            cols = [pa.array([*(r[0] for r in rows), SLICES], pa.int32()), pa.array([grp] * (k + 1)), pa.array([*(r[1] for r in rows), None], pa.int32()), pa.array([*(r[2] for r in rows), None], pa.binary()), pa.array([None] * k + [code], pa.binary()), pa.array([None] * k + [sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["slice", "grp", "part", "keys", "code", "docs"])

        for b, texts in _portions(batches):
            n, ids, hashes = _tokens(texts)
            hs.append(hashes[ids])
            ns.append(n)
            trains.append(b.column("train").to_numpy(zero_copy_only=False).astype(bool))
            tables.append(b.select(kept))
            held += len(ids)
            if held > group_tokens:
                yield flush()
                hs, ns, trains, tables, held, grp = [], [], [], [], 0, grp + 1
        if held:
            yield flush()

    return docs.mapInArrow(deal, CODED)


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over equal keys for each key, and the sums once for each different key."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(keys)])
    sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    out = np.empty_like(counts)
    out[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    return out, sums


def corpus_counts(coded: DataFrame) -> DataFrame:
    """(grp, part, counts) for each row of keys of coded_groups(): the counts of its words and pairs in all training texts, in the order of its keys; and a row for each part with the total of its words' counts and how many words have any.

    A group has a key once, so the most frequent key of all has no more rows than there are groups."""

    def add(t: pa.Table) -> pa.Table:
        part, got = t.column("part")[0].as_py(), [unpack(x) for x in t.column("keys").to_pylist()]
        back, sums = [], []
        for k in (0, 2):
            size = np.cumsum([len(g[k]) for g in got])[:-1]
            each, once = _totals(np.concatenate([np.cumsum(g[k], dtype=np.uint64) for g in got]), np.concatenate([g[k + 1] for g in got]).astype(np.int64))
            back.append(np.split(each, size))
            sums.append(once)
        blobs = [pack(w, p) for w, p in zip(*back, strict=True)]
        none = [None] * len(got)
        return pa.table({
            "grp": pa.array([*t.column("grp").to_pylist(), None], pa.int64()), "part": pa.array([part] * (len(got) + 1), pa.int32()), "counts": pa.array([*blobs, None], pa.binary()),
            "total": pa.array([*none, int(sums[0].sum())], pa.int64()), "distinct": pa.array([*none, int((sums[0] > 0).sum())], pa.int64()),
        })

    return coded.select("grp", "part", "keys").groupBy("part").applyInArrow(add, "grp bigint, part int, counts binary, total bigint, distinct bigint")


def _estimates(total: int, head: np.ndarray, both: np.ndarray, own: np.ndarray, deleted: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram maximum-likelihood estimates from counts of context, pair and word; with deleted 1 as they would be without the occurrence itself."""
    return np.maximum(both - deleted, 0) / np.maximum(head - deleted, 1.0), np.maximum(own - deleted, 0) / max(1.0, total - deleted)


def _octave(p: np.ndarray, steps: int, least: int) -> np.ndarray:
    """Half-octave bins, 0 for p = 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.floor(steps * np.log2(np.maximum(p, 1e-300))) + least * steps + 1, 1, least * steps + 1), 0).astype(np.int64)


def _held(total: int, head: np.ndarray, both: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows (key, weight, sums of bigram and unigram estimates) of tokens that are left out of the counts in their turn, by binned context count and estimates."""
    p3, p2 = _estimates(total, head, both, own, 1)
    key = (_bucket(head - 1.0, BUCKETS) * 64 + _octave(p3, 2, 24)) * 128 + _octave(p2, 2, 40)
    k, where = np.unique(key, return_inverse=True)
    return np.column_stack([k, np.bincount(where, weight, minlength=len(k)), np.bincount(where, weight * p3, minlength=len(k)), np.bincount(where, weight * p2, minlength=len(k))])


def _looked_up(group: pa.Table, counts: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a group: how many tokens its texts have, each token's pair, and for each pair how often its context, itself and its word occur, and how often the group's training texts have it."""
    n, token, own, learned = unpack(group.column("code")[0].as_py())
    got = [unpack(x) for x in counts.sort_by("part").column("counts").to_pylist()]
    words, pairs = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    before = np.empty(len(token), own.dtype)  # a token's context is the word of the pair before it
    before[1:] = own[token[:-1]]
    before[np.cumsum(n) - n] = own[token[-1]]
    head = np.empty_like(own)
    head[token] = before
    return n, token, words[head], pairs, words[own], learned


def _beside(coded: DataFrame, counts: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return coded.select("grp", "code", "docs").groupBy("grp").cogroup(counts.filter("grp IS NOT NULL").select("grp", "part", "counts").groupBy("grp")).applyInArrow(solve, schema)


def held_out_counts(coded: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(key, w, s3, s2): how often training tokens have such context counts, bigram and unigram estimates when they are left out of the counts; a table of fixed size."""

    def held(group: pa.Table, counts: pa.Table) -> pa.Table:
        _, _, head, both, own, learned = _looked_up(group, counts)
        m = learned > 0
        key, *rest = _held(total, head[m], both[m], own[m], learned[m]).T
        return pa.table([pa.array(key.astype(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in rest)], names=["key", "w", "s3", "s2"])

    rows = _beside(coded, counts, held, "key bigint, w double, s3 double, s2 double")
    return rows.groupBy("key").agg(F.sum("w").alias("w"), F.sum("s3").alias("s3"), F.sum("s2").alias("s2"))


def mixture(rows: list[tuple], distinct: int, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, unigram and floor by bucket, learned by expectation-maximisation on the held-out counts; a bucket without counts uses those of all."""
    x = np.array(rows, float).reshape(-1, 4)
    x = x[x[:, 0] >= 0]
    bucket = np.minimum((x[:, 0].astype(np.int64) // 128) // 64, BUCKETS - 1)
    p = np.column_stack([x[:, 2] / np.maximum(x[:, 1], 1e-12), x[:, 3] / np.maximum(x[:, 1], 1e-12), np.full(len(x), 1.0 / (distinct + 1))])

    def learn(w: np.ndarray, p: np.ndarray) -> np.ndarray:
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = lam * p
            share /= share.sum(axis=1, keepdims=True)
            new = (share * w[:, None]).sum(axis=0) + 1e-3
            new /= new.sum()
            if np.abs(new - lam).max() < 1e-10:
                break
            lam = new
        return lam

    every = learn(x[:, 1], p) if len(x) else np.array([0.0, 0.0, 1.0])
    out = np.tile(every, (BUCKETS, 1))
    for b in range(BUCKETS):
        if (bucket == b).any():
            out[b] = learn(x[bucket == b, 1], p[bucket == b])
    return out


def group_scores(coded: DataFrame, counts: DataFrame, keep_schema: StructType, weights: np.ndarray, total: int, distinct: int) -> DataFrame:
    """The columns to keep, n_tokens, n_known, known_log (sum of log10(count + 1)) and score of each text."""

    def score(group: pa.Table, counts: pa.Table) -> pa.Table:
        n, token, head, both, own, _ = _looked_up(group, counts)
        with pa.ipc.open_stream(group.column("docs")[0].as_py()) as r:
            kept = r.read_all()
        p3, p2 = _estimates(total, head, both, own, 0)
        lam = weights[_bucket(head.astype(float), len(weights))]
        logs = np.log10(lam[:, 0] * p3 + lam[:, 1] * p2 + lam[:, 2] / (distinct + 1))
        text = np.repeat(np.arange(len(n)), n)
        sums = [np.bincount(text, x[token], minlength=len(n)) for x in (own > 0, np.log10(own + 1.0), logs)]
        return pa.Table.from_arrays([*[kept.column(c) for c in keep_schema.names], pa.array(n, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=[*keep_schema.names, "n_tokens", "n_known", "known_log", "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep_schema)
    return _beside(coded, counts, score, f"{fields}n_tokens bigint, n_known bigint, known_log double, score double")


def _slice(spark: SparkSession, path: str, k: int) -> DataFrame:
    """One slice of the coded groups; without rows where the table has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slice={k}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CODED).drop("slice")
    out = spark.read.schema(CODED.partition(", ")[2]).parquet(f"{path}/slice={k}")
    out._stored_at = f"{path}/slice={k}"
    return out


def lm_scores(df: DataFrame, *, text: str = "text", learn: Column, keep: list[str] | tuple[str, ...] = (), part_bytes: int = 16 << 20, group_tokens: int = 1_200_000) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of each whole text, by a model learned from the rows for which learn holds.

    Tokens are the words of the lower-cased (A-Z) text and one end. The model mixes the maximum-likelihood bigram, unigram and a floor of one in all known
    tokens and one unknown; the weights depend on how often the context occurs. Every word is a context of its own, and all counts are complete; words and pairs are told apart by 64-bit hashes. The weights are learned on the training tokens, each left out of the counts in its turn (deleted
    interpolation), with estimates binned by half octaves. base_score is the add-one unigram probability with one unknown token.

    Texts are read once, into groups of group_tokens tokens. A group asks for the counts of its different words and pairs, each once, at the part that a key belongs to; a part holds the keys of about part_bytes of texts, however many texts there are, and
    gives each group its counts back in the order asked. As every word is followed by something, a context's count is that of the word. Nothing but totals and a table of binned estimates of fixed size reach the driver.

    Null texts are empty (one end token); rows come out as they are, repeated ones too, an empty table gives none; where nothing can be learned from, every token is unknown and all scores are 0. Texts may be of any length: a group has one at least.
    Columns outside keep are ignored; keep may hold any but those returned (ValueError).
    """
    keep = list(keep)
    if clash := set(_MADE) & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    docs = df.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/coded-{uuid.uuid4().hex}"
    coded_groups(docs, max(12, -(-size // part_bytes)), group_tokens).write.partitionBy("slice").parquet(path)
    counts = None
    for k in range(SLICES):
        keys = _slice(spark, path, k)
        some = stored(corpus_counts(keys), "counts")
        counts = some if counts is None else counts.unionByName(some)
        discard(keys)
        forget(spark)  # the exchange of a slice is over before the next one
    coded = _slice(spark, path, SLICES)
    total, distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).head()
    weights = mixture([tuple(r) for r in held_out_counts(coded, counts, total).collect()], distinct) if total else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    forget(spark)
    out = group_scores(coded, counts, docs.drop("text", "train").schema, weights, total, distinct)
    base = F.col("known_log") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
