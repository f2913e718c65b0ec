"""Problem 8: mixing sources to target shares of the total size.

Sizes are tokens of a public tokenizer.  Tokens are counted in Arrow batches
and added up per source with partial sums, so a source with a third of all
rows costs one more row per task.  The sums, joined with the targets, give
each source a repetition rate

    rate = min(max_repeats, target_share * total / tokens)

and every document is emitted floor(rate) times plus one more copy when a hash
of its key, seeded, falls below the fraction.  No document is sorted or
collected; one scan counts, one scan emits.

Defined results: null and empty texts count no tokens and are still emitted;
sources are compared, and named in the results, trimmed, in lower case and with a
hyphen for underscores and inner spaces; documents whose source is null
or has no target are not part of the mix but count for the total; a target
without documents falls short; null shares count as 0 and null repeats as 1;
targets that name a source twice add up, with the larger repeat count; rows
that repeat a key are each a document, with the same copies.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

#: Where the public vocabularies lie, for the driver; a parameter of each operator.  The one used goes to the executors as a file of the job.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: The usual pre-tokeniser of byte-level BPE: contractions, words, numbers, other signs, spaces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with Path(path).open("rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """A source name trimmed, in lower case and with one hyphen for each run of separators."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-_\s]+", "-")


def count_tokens(df: DataFrame, text: Column, keep: list[str], tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row; 0 for a null or empty text."""
    rows = df.select(*keep, text.alias("_text"))
    df.sparkSession.sparkContext.addFile(f"{tokenizers}/{vocabulary}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(vocabulary)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens long"]))


def rates(df: DataFrame, targets: DataFrame, text: str = "text", source: str = "source", **tokenizer: str) -> DataFrame:
    """Per target: source, target_share, max_repeats, n_docs, n_tokens, total, rate, reachable (the share the mix can reach)."""
    counted = count_tokens(df.select(source_key(F.col(source)).alias("source"), F.col(text).alias("t")), F.col("t"), ["source"], **tokenizer)
    sizes = materialise(counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "mix-sizes")
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("long").alias("max_repeats"))
        .filter("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    known = wanted.join(sizes, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "n_tokens": F.coalesce("n_tokens", F.lit(0))}).join(F.broadcast(total))
    full = F.col("target_share") * F.col("total")
    return known.withColumn("rate", F.when(F.col("n_tokens") > 0, F.least(F.col("max_repeats").cast("double"), full / F.col("n_tokens"))).otherwise(0.0)).withColumn("reachable", F.when(F.col("total") > 0, F.col("rate") * F.col("n_tokens") / F.col("total")).otherwise(0.0))


def falling_short(plan: DataFrame) -> DataFrame:
    """Sources whose rate, bounded by ``max_repeats``, does not bring them to their share; none of an empty mix."""
    return plan.filter((F.col("total") > 0) & (F.col("reachable") < F.col("target_share") - 1e-9)).select("source")


def emit(df: DataFrame, plan: DataFrame, key: str, source: str = "source", seed: int = 17) -> DataFrame:
    """The mix: key, source, copy (from 1).  The plan has one row per target; the join broadcasts it only while Spark finds it small."""
    unit = F.shiftrightunsigned(F.xxhash64(F.col("_key"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = df.select(F.col(key).alias("_key"), source_key(F.col(source)).alias("source")).join(plan.select("source", "rate"), "source")
    copies = (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rows.withColumn("n", copies).filter("n > 0").select(F.col("_key").alias(key), "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def report(df: DataFrame, plan: DataFrame, key: str, text: str = "text", source: str = "source", seed: int = 17, **tokenizer: str) -> DataFrame:
    """Per source of the mix: documents and copies used, tokens, the share reached and the target."""
    sized = count_tokens(df.select(F.col(key).alias("k"), source_key(F.col(source)).alias("source"), F.col(text).alias("t")), F.col("t"), ["k", "source"], **tokenizer)
    mixed = emit(sized, plan, "k", seed=seed).groupBy("k", "source").agg(F.max("copy").alias("copies"))
    used = sized.join(mixed, ["k", "source"]).groupBy("source").agg(F.count("*").alias("n_docs_used"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    out = plan.join(used, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_docs_used", "n_copies", "mixed_tokens")})
    whole = used.agg(F.sum("mixed_tokens").alias("whole"))
    return out.join(F.broadcast(whole)).select("source", "target_share", "max_repeats", F.round("rate", 6).alias("rate"), "n_docs_used", "n_copies", "mixed_tokens", F.round(F.col("mixed_tokens") / F.col("whole"), 6).alias("actual_share"))
