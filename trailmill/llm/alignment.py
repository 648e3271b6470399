"""Alignment of two tokenizers over the same texts, by distinct segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, portions, stored
from .lm import pack, unpack

#: A run of white space and what follows it up to the next one.
_RUN = re.compile(r"\s+\S*")
#: White space before which a text is cut, after anything that is none.
_CUT = " \n"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def segments(text: str) -> list[str]:
    """A space and the text, cut before each run of white space that starts with a space or a line feed."""
    out: list[str] = []
    for x in _RUN.findall(" " + text):
        if out and x[0] not in _CUT:
            out[-1] += x
        else:
            out.append(x)
    return out


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A byte-level BPE (A, a file of tokenizers) and a BPE of pieces with byte fallback (B, a sentencepiece model); special tokens' strings in texts are plain text to both."""

    def __init__(self, a: str, b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte = _byte_of_char()
        self.a_bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.size_b = len(pieces)
        self.pair = "int" if self.a.get_vocab_size() * self.size_b < 1 << 31 else "bigint"

    def check(self) -> None:
        """ValueError unless no merge of either vocabulary reaches over a cut.

        A merge makes an entry of the vocabulary, so it is enough that no entry has white space of _CUT after something that is none; A's first
        division of a text by pattern begins anew at white space in any case. B puts a space before what it gets, so a segment goes in without
        its own; one that starts with a line feed has the extra space taken off again, which no entry of B may have joined with it.
        """
        inner = re.compile(rf"\S[{_CUT}]")
        if bad := [t for t in self.a_bytes.values() if inner.search(t.decode("utf-8", "ignore"))]:
            raise ValueError(f"entries of A reach over white space: {bad[:3]}")
        if bad := [t for i, t in enumerate(self.b_bytes) if not self.b.is_control(i) and not self.b.is_unknown(i) and (inner.search(t.decode("utf-8", "ignore")) or (b"\n" in t and t != b"\n"))]:
            raise ValueError(f"entries of B reach over white space: {bad[:3]}")
        for probe in ("a  b \n c\n\nd", " x \n", "\n", "it's 1 000\r\n\t.. <s>  y 　z  ", "<|endoftext|> été\n\n \n q"):
            a, b = zip(*self.encode(segments(probe)), strict=True)
            if sum(a, []) != self.a.encode(" " + probe, add_special_tokens=False).ids or sum(b, []) != self.b.encode(probe):
                raise ValueError("the tokenizers don't part texts at white space")

    def encode(self, segs: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by A and by B of each segment, as they are within a text."""
        a = [x.ids for x in self.a.encode_batch(segs, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segs], num_threads=1)
        return [(x, ([self.space] if s == " " else y) if s[0] == " " else y[1:]) for s, x, y in zip(segs, a, b, strict=True)]

    def align(self, seg: str, a: list[int], b: list[int]) -> tuple[bool, int, list[str], list[int]]:
        """Whether both sides spell the segment; then the number of groups, the groups as strings and the links (A's id times the size of B's vocabulary, and B's id), in order."""
        text, left, right = seg.encode(), [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(left) != text or b"".join(right) != text:
            return False, 0, [], []
        if len(a) == 1 or len(b) == 1:
            return True, 1, [",".join(map(str, a)) + "|" + ",".join(map(str, b))], [x * self.size_b + y for x in a for y in b]
        groups, links, i, j, i0, j0, at, bt = [], [], 0, 0, 0, 0, len(left[0]), len(right[0])
        while True:
            links.append(a[i] * self.size_b + b[j])
            if at == bt:
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                i, j = i + 1, j + 1
                if i == len(a):
                    return True, len(groups), groups, links
                i0, j0, at, bt = i, j, at + len(left[i]), bt + len(right[j])
            elif at < bt:
                i += 1
                at += len(left[i])
            else:
                j += 1
                bt += len(right[j])


@lru_cache(maxsize=2)
def _loaded(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def _coded(df: DataFrame, text: str, keep: list[str], portion: int) -> DataFrame:
    """A row for each portion of df's texts: part (its number), the columns keep as lists, segs (its different segments) and codes (packed: of every text in order, places in segs; and how many of them each text has)."""
    names = [f"_keep_{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("binary").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            lo = 0
            for texts in portions(b.column("text"), portion):
                known: dict[str, int] = {}
                codes, sizes = [], []
                for t in texts:
                    found = segments(t.decode("utf-8", "replace")) if t else []
                    codes.append(np.fromiter((known.setdefault(s, len(known)) for s in found), np.uint32, len(found)))
                    sizes.append(len(found))
                kept = [b.column(n).slice(lo, len(texts)) for n in names]
                one = pa.array([0, len(texts)], pa.int32())
                cols = [pa.ListArray.from_arrays(one, k) for k in kept]
                cols += [pa.array([part]), pa.array([list(known)], pa.list_(pa.string())), pa.array([pack(np.concatenate(codes), np.array(sizes, np.uint32))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "part", "segs", "codes"])
                lo, part = lo + len(texts), part + 1

    return rows.mapInArrow(code, "".join(f"{n} array<{types[n]}>, " for n in names) + "part long, segs array<string>, codes binary")


def _aligned(segs: DataFrame, a: str, b: str) -> DataFrame:
    """seg, ok, the counts of its tokens, groups and links, groups as one string and links, for each row of segs."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded(a, b)
        pair = pa.int32() if tok.pair == "int" else pa.int64()
        for batch in batches:
            for part in portions(batch.column("seg").cast(pa.binary()), 1 << 18):
                texts = [x.decode() for x in part]
                ids = tok.encode(texts)
                got = [tok.align(s, *x) for s, x in zip(texts, ids, strict=True)]
                cols = [pa.array(texts), pa.array([g[0] for g in got])]
                cols += [pa.array(x, pa.int32()) for x in ([len(i[0]) for i in ids], [len(i[1]) for i in ids], [g[1] for g in got], [len(g[3]) for g in got])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([";".join(g[2]) for g in got]), pa.array([g[3] for g in got], pa.list_(pair))], names=["seg", "ok", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return segs.mapInArrow(solve, f"seg string, ok boolean, n_a int, n_b int, n_groups int, n_links int, groups string, links array<{_loaded(a, b).pair}>")


def _texts_of(portion: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.astype(np.int64) for x in unpack(portion.column("codes")[0].as_py()))


def _bundled(rows: DataFrame, numbers: list[str], tail: str, rows_a_bundle: int = 500_000, bytes_a_bundle: int = 64 << 20) -> DataFrame:
    """(part, bundle) of rows with a column part: what a task has of a part, in the order of codes, the columns numbers as one array and the lists or strings of tail as lengths and values."""

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            part, code = t.column("part").to_numpy(), t.column("code").to_numpy()
            order = np.lexsort((code, part))
            edge = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            columns = [t.column(c).to_numpy()[order].astype(np.int64) for c in numbers]
            last = t.column(tail).combine_chunks()
            last = (last.cast(pa.binary()) if pa.types.is_string(last.type) else last).take(pa.array(order))
            ends = np.frombuffer(last.buffers()[1], np.int32)[: len(order) + 1]
            values = np.frombuffer(last.buffers()[2], np.uint8) if pa.types.is_binary(last.type) else last.values.to_numpy()
            for a, z in zip(edge, edge[1:], strict=False):
                blob = pack(np.concatenate([c[a:z] for c in columns]), np.diff(ends[a : z + 1]), values[ends[a] : ends[z]])
                yield pa.RecordBatch.from_arrays([pa.array([int(part[order[a]])]), pa.array([blob], pa.binary())], names=["part", "bundle"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n, size = n + b.num_rows, size + b.nbytes
            if n >= rows_a_bundle or size >= bytes_a_bundle:
                yield from flush()
                held, n, size = [], 0, 0
        if n:
            yield from flush()

    return rows.select("part", *numbers, tail).mapInArrow(pack_up, "part long, bundle binary")


def _by_portion(coded: DataFrame, bundles: DataFrame, width: int, solve: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """solve() for each portion with the numbers (width rows), lengths and values of its segments in the order of codes. A portion and its bundles meet in one task, one portion after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            bundle, codes = b.column("bundle"), b.column("codes")
            for i in range(b.num_rows):
                if codes[i].is_valid:  # sorted so that a portion comes after its bundles
                    numbers = np.concatenate([np.zeros((width, 0), np.int64), *(h[0].reshape(width, -1) for h in held)], axis=1)
                    lengths = np.concatenate([np.zeros(0, np.int64), *(h[1].astype(np.int64) for h in held)])
                    values = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.uint8)
                    order = np.argsort(numbers[0], kind="stable")
                    at = np.cumsum(lengths) - lengths
                    place = np.arange(lengths.sum()) + np.repeat(at[order] - (np.cumsum(lengths[order]) - lengths[order]), lengths[order])
                    yield solve(b.slice(i, 1), numbers[:, order], lengths[order], values[place])
                    held = []
                else:
                    held.append(unpack(bundle[i].as_py()))

    left = coded.withColumn("bundle", F.lit(None).cast("binary"))
    right = bundles.select("part", *[F.lit(None).cast(f.dataType).alias(f.name) for f in coded.schema if f.name != "part"], "bundle")
    rows = left.unionByName(right).withColumn("late", F.col("codes").isNotNull())
    return rows.repartition("part").sortWithinPartitions("part", "late").drop("late").mapInArrow(run, schema)


def _pairs_met(portion: pa.RecordBatch, numbers: np.ndarray, size: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    """How many texts of a portion hold each pair linked."""
    codes, sizes = _texts_of(portion)
    ends = np.cumsum(size)
    pairs, which = np.unique(flat, return_inverse=True)
    text = np.repeat(np.arange(len(sizes)), sizes)
    spoilt = np.bincount(text, weights=numbers[1][codes] == 0, minlength=len(sizes)) > 0
    met = np.unique((text << 32 | codes)[~spoilt[text]])
    n = size[met & 0xFFFFFFFF]
    place = np.arange(n.sum()) + np.repeat((ends - size)[met & 0xFFFFFFFF] - (np.cumsum(n) - n), n)
    once = np.unique(np.repeat(met >> 32, n) << 32 | which[place])
    count = np.bincount(once & 0xFFFFFFFF, minlength=len(pairs))
    return pa.RecordBatch.from_arrays([pa.array(pairs[count > 0].astype(np.int64)), pa.array(count[count > 0].astype(np.int64))], names=["pair", "n"])


def aligned_texts(df: DataFrame, *, a: str, b: str, text: str = "text", keep: list[str] | tuple[str, ...] = (), portion: int = 8 << 20) -> DataFrame:
    """keep, then for each row of df: n_a and n_b (its tokens by A and B), n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2,b3`: ids by A and B of each group in order).

    A encodes a space and the text, B the text, before which it puts the space itself. Byte offsets where tokens of both end cut them into groups; a link is an overlapping pair of token occurrences. An id pair's count is the number of rows that hold
    it linked; n_best counts the links whose pair has the highest count of its A id, ties included, and count_sum adds up the counts of all links.

    Texts are cut before white space where no merge of either vocabulary can reach (checked on start, ValueError otherwise), and each different segment of the table is tokenised and
    aligned once. A portion of about portion bytes of texts holds its different segments once; alignments are joined to these, never to single occurrences, and texts are composed from them portion by portion.

    Null and empty texts have no tokens: zeros and an empty string; so have texts that the tokens of A or B don't spell byte for byte, such as those that hold U+2581. A segment that isn't spelled spoils its text: what B loses is never made up for elsewhere, since
    a piece never spells more bytes than it stands for. Repeated rows come out repeated and count as rows of their own. An empty table gives no rows; keep may hold any columns but those returned (ValueError).
    """
    keep = list(keep)
    if clash := {*_COUNTS, "groups"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    _loaded(a, b).check()
    names = [f"_keep_{i}" for i in range(len(keep))]
    tok, spark = _loaded(a, b), df.sparkSession
    coded = stored(_coded(df, text, keep, portion), "coded")
    met = coded.select("part", F.posexplode("segs").alias("code", "seg"))
    segs = stored(_aligned(met.select("seg").distinct(), a, b).withColumn("sid", F.monotonically_increasing_id()), "segments")
    # both sides are plain exchanges, so that Spark can split a segment that every portion has
    named = segs.select(F.col("seg").alias("_seg"), "sid")
    ids = stored(met.join(named, F.col("seg") == F.col("_seg")).select("part", "code", "sid"), "ids")
    whole = coded
    coded = stored(whole.drop("segs"), "codes")  # their segments are in ids now
    discard(whole)
    forget(spark)  # the exchanges of segments are over before those of alignments
    linked = ids.join(segs.select(F.col("sid").alias("_sid"), "ok", "links"), F.col("sid") == F.col("_sid"))
    pairs = _by_portion(coded.select("part", "codes"), _bundled(linked, ["code", "ok"], "links"), 2, _pairs_met, "pair long, n long")
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    forget(spark)
    own = F.floor(F.col("pair") / tok.size_b)
    most = counts.groupBy(own.alias("_a")).agg(F.max("n").alias("most"))
    ranked = counts.join(most, own == F.col("_a")).select(F.col("pair").alias("_pair"), "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    links = segs.select("sid", F.explode("links").alias("pair"))
    values = links.join(ranked, F.col("pair") == F.col("_pair")).groupBy(F.col("sid").alias("_sid")).agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    whole = segs.drop("seg", "links").join(values, F.col("sid") == F.col("_sid"), "left").select(F.col("sid").alias("_sid"), "ok", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")
    whole = stored(whole, "whole")
    discard(segs, counts)
    forget(spark)
    valued = ids.join(whole, F.col("sid") == F.col("_sid")).select("part", "code", "ok", *_COUNTS, "groups")
    types = {f.name: f.dataType.elementType.simpleString() for f in coded.schema if f.name in names}

    def compose(portion: pa.RecordBatch, numbers: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        codes, sizes = _texts_of(portion)
        ends = np.cumsum(sizes)
        starts = ends - sizes

        def total(x: np.ndarray) -> np.ndarray:
            up = np.concatenate([np.zeros(1, np.int64), np.cumsum(x[codes])])
            return up[ends] - up[starts]

        spoilt = total((numbers[1] == 0).astype(np.int64)) > 0
        out = [np.where(spoilt, 0, total(c)) for c in numbers[2:]]
        raw, stop = flat.tobytes(), np.cumsum(lengths)
        groups = [raw[a:z] for a, z in zip((stop - lengths).tolist(), stop.tolist(), strict=True)]
        strings = pa.array([b"" if s else b";".join(map(groups.__getitem__, codes[x:y].tolist())) for s, x, y in zip(spoilt.tolist(), starts.tolist(), ends.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([*[portion.column(n).flatten() for n in names], *[pa.array(x, pa.int64()) for x in out], strings.cast(pa.string())], names=[*names, *_COUNTS, "groups"])

    schema = "".join(f"{n} {types[n]}, " for n in names) + ", ".join(f"{c} long" for c in _COUNTS) + ", groups string"
    out = _by_portion(coded.select("part", "codes", *names), _bundled(valued, ["code", "ok", *_COUNTS], "groups"), 2 + len(_COUNTS), compose, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *_COUNTS, "groups")
