"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions


def _counter(path: str, batch_bytes: int) -> Callable[[list[bytes]], list[int]]:
    """Lengths of a list of pieces, encoded in batches of about batch_bytes; one thread, for Spark has a task per core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def encode(xs: list[str]) -> list[int]:
            return [len(x) for x in tok.encode_batch_fast(xs, add_special_tokens=False)]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(xs: list[str]) -> list[int]:
            return [len(x) for x in model.encode(xs, num_threads=1)]

    def lengths(pieces: list[bytes]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for p in pieces:
            batch.append(p.decode("utf-8", "replace"))
            size += len(p)
            if size >= batch_bytes:
                out += encode(batch)
                batch, size = [], 0
        return out + encode(batch) if batch else out

    return lengths


def token_counts(
    df: DataFrame,
    text: str = "text",
    *,
    tokenizer: str,
    keep: list[str] | tuple[str, ...] = (),
    limit: int = 2048,
    split: bool = False,
    batch_bytes: int = 1 << 18,
    cache_bytes: int = 64 << 20,
) -> DataFrame:
    """Columns keep of df, then n_bytes, n_tokens and over_limit (more than limit tokens) of each whole text.

    Each Arrow batch is encoded in calls of about batch_bytes and only lengths come back. With split, texts are cut at
    ASCII white space, which is a safe boundary for tokenizers that drop white space and never join over it (such as
    word_bpe_49k; a ValueError for one that doesn't); the lengths of pieces then add up to that of the text, a long text never is one long call, and a
    piece met before in the task isn't encoded again (the pieces remembered are held below cache_bytes). Without split, whole
    texts are encoded, as tokenizers that encode white space need.

    Null and empty texts have 0 bytes and 0 tokens. Rows are kept as they are, repeated ones too; columns outside keep
    are dropped, so no name can clash unless keep itself holds n_bytes, n_tokens or over_limit (ValueError).
    """
    if clash := {"n_bytes", "n_tokens", "over_limit"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    if split:
        lengths = _counter(tokenizer, batch_bytes)
        for probe in (b"a b", b"The  quick\n\tbrown fox, isn't it", b" 1 000\r\n.. x\x0b\x0cY "):
            if lengths([probe]) != [sum(lengths(probe.split()))]:
                raise ValueError(f"{tokenizer} doesn't part texts at white space")

    @F.arrow_udf("struct<n_bytes: bigint, n_tokens: bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths, known, held = _counter(tokenizer, batch_bytes), {}, 0
        for batch in batches:
            size, n = [], []
            for part in portions(batch):
                texts = [x or b"" for x in part]
                size += map(len, texts)
                if not split:
                    n += lengths(texts)
                    continue
                for x in texts:
                    words = x.split()
                    new = [w for w in set(words) if w not in known]
                    if new:
                        known.update(zip(new, lengths(new), strict=True))
                        held += sum(map(len, new)) + 100 * len(new)
                    n.append(sum(map(known.__getitem__, words)))
                    if held > cache_bytes:
                        known, held = {}, 0
            yield pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["n_bytes", "n_tokens"])

    plain: Column = F.col(text).cast("binary")
    out = df.select(*keep, count(plain).alias("_count"))
    return out.select(*keep, "_count.n_bytes", "_count.n_tokens", (F.col("_count.n_tokens") > limit).alias("over_limit"))
