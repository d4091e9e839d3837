"""How often each record is used when sources are mixed by shares of tokens (problem 7).

The total is the largest that every source can fill to its share within its repeats, so the source that is shortest sets
it and all shares can be met. A record of a source that is to be used r times is certain of its whole copies; the rest is
drawn by Pareto order sampling, with the fraction of r as the chance of one more copy, until the tokens are filled.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmesh.llm.forms import column
from leafmesh.session import written

#: Ranges of the order variable that are counted before one of them is sorted; they bound what a single task sorts.
RANGES = 4096
SEED = 7


#: Ranks of a public byte-level BPE, and the pattern by which it splits texts; fixed values.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a file of ranks; it is read where it is used and never stored."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(records: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): the number of tokens of each text by the tokenizer at `path`; null and empty texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), batch.column(batch.schema.get_field_index("source")), pa.array(sizes, pa.int64())], schema=schema)

    return records.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def uses(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Times that each source's tokens are to be used, from its tokens and its (target_share, max_repeats).

    Sources without tokens can't be filled; the shares of the others keep their proportions.
    """
    open_ = {s: (share, most) for s, (share, most) in targets.items() if totals.get(s, 0) > 0 and share > 0 and most > 0}
    if not open_:
        return {}
    total = min(most * totals[s] / share for s, (share, most) in open_.items())
    return {s: min(float(most), total * share / totals[s]) for s, (share, most) in open_.items()}


def copies(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each record of the sources of `targets` is used, 0 included.

    Null and empty texts are used 0 times; rows without doc_id and other sources are left out. No source is sorted or held
    by one task: tokens are summed by ranges of the order variable, and only the range where a source is full is sorted.
    """
    spark = documents.sparkSession
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").collect()}
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    records = documents.select("doc_id", "source", "text").where("doc_id is not null").join(F.broadcast(names), "source")
    records = written(counted(records, tokenizer), "tokens")
    totals = {r.source: r.n for r in records.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    plan = []
    for source, times in uses(totals, wanted).items():
        whole = math.floor(times + 1e-9)
        plan.append((source, whole, max(0.0, times - whole), max(0.0, times - whole) * totals[source]))
    plans = spark.createDataFrame(plan, "source string, whole int, chance double, need double")

    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    # q / (1 + q) of Pareto's order variable q = u / (1 - u) / (chance / (1 - chance)); it has the order of q and lies in 0..1
    order = u * (1 - F.col("chance")) / (u * (1 - F.col("chance")) + (1 - u) * F.col("chance"))
    drawn = records.where("tokens > 0").join(F.broadcast(plans.where("chance > 0")), "source").withColumn("_order", order)
    drawn = drawn.withColumn("_range", F.floor(F.col("_order") * RANGES))
    sums = drawn.groupBy("source", "need", "_range").agg(F.sum("tokens").alias("n"))
    upto = sums.withColumn("_upto", F.sum("n").over(Window.partitionBy("source").orderBy("_range")))
    full = upto.where("_upto > need").groupBy("source").agg(F.min(F.struct("_range", (F.col("_upto") - F.col("n")).alias("before"))).alias("f"))
    cuts = [(r.source, r.f["_range"], float(r.f["before"])) for r in full.collect()]
    cuts = spark.createDataFrame(cuts, "source string, _cut bigint, _before double")

    last = drawn.join(F.broadcast(cuts), "source").where("_range = _cut")
    last = last.withColumn("_sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    taken = last.where("_before + _sum - tokens / 2 <= need").select("doc_id", F.lit(1).alias("_taken"))
    base = records.join(F.broadcast(plans), "source", "left").join(F.broadcast(cuts), "source", "left")
    base = base.withColumn("_range", F.floor(order * RANGES))
    below = (F.col("chance") > 0) & (F.col("_cut").isNull() | (F.col("_range") < F.col("_cut")))
    base = base.join(F.broadcast(taken), "doc_id", "left")
    extra = F.when(below, 1).otherwise(F.coalesce("_taken", F.lit(0)))
    times = F.when(F.col("tokens") > 0, F.coalesce("whole", F.lit(0)) + extra).otherwise(0).cast("int")
    return base.select("doc_id", "source", "tokens", times.alias("copies"))


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, records, used, tokens, actual_share): what `copies` makes of each source."""
    of = copies(documents, targets, seed, tokenizer).groupBy("source").agg(
        F.count("*").alias("records"), F.sum("copies").cast("bigint").alias("used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").join(of, "source", "left").fillna(0, ["records", "used", "tokens"])
    # one row per source of the targets
    rows = rows.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    return rows.withColumn("actual_share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")


__all__ = ["copies", "counted", "encoding", "shares", "uses"]
