"""Mixing sources to target weights.

A mix's total is the largest that its sources and their caps on repeats allow. Every document of a source gets the same
expected number of copies. The whole part is sure; the fractions are rounded by pivotal dependent rounding: two documents
at a time, tokens are moved from one's fraction to the other's until one is integral, at random but so that both keep
their expectation. What stays open in a block meets what stays open in others in a reduction tree. So a source's tokens
miss their target by less than one document, whatever the number of blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bpe import token_counts
from quarrylens.llm.truncation import source_key
from quarrylens.session import cut

#: Documents of a block of the first pass, blocks that meet in a node of the tree.
BLOCK, FAN_IN = 20_000, 64
EPSILON = 1e-9
ROUNDED = "mix string, source string, id {id}, tokens bigint, whole bigint, part double, block bigint, settled boolean"


def settle(rows: pd.DataFrame, salt: str, last: bool = False) -> pd.DataFrame:
    """Pivotal rounding of the fractions ``part`` of one (mix, source) group in the order of id; at most one stays open.

    ``tokens * part`` is what moves: its sum never changes, except that ``last`` rounds the one left open.
    """
    import numpy as np

    rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
    random = np.random.default_rng(zlib.crc32(f"{salt}|{rows['mix'].iat[0]}|{rows['source'].iat[0]}|{rows['block'].min()}".encode()))
    draws = random.random(len(rows) + 1)
    part, size = rows["part"].to_numpy(float).copy(), rows["tokens"].to_numpy(float)
    held = -1
    for i in range(len(part)):
        if part[i] <= EPSILON or part[i] >= 1 - EPSILON:
            part[i] = round(part[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - part[a]) * size[a], part[b] * size[b])  # tokens that can move from b to a
        down = min(part[a] * size[a], (1 - part[b]) * size[b])
        moved = up if draws[i] * (up + down) < down else -down
        part[a] += moved / size[a]
        part[b] -= moved / size[b]
        open_ = [j for j in (a, b) if EPSILON < part[j] < 1 - EPSILON]
        for j in (a, b):
            if j not in open_:
                part[j] = round(part[j])
        held = open_[0] if open_ else -1
    if held >= 0 and last:
        part[held] = float(draws[-1] < part[held])
        held = -1
    rows["settled"] = np.arange(len(part)) != held
    rows["whole"] = rows["whole"] + np.where(rows["settled"], part, 0).astype("int64")
    rows["part"] = np.where(rows["settled"], 0.0, part)
    return rows


def meeting(level: int, final: bool, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A node of the reduction tree: what its blocks left open is settled among them."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        return settle(rows, f"level {level}", final)[names]

    return meet


def clean_targets(targets: DataFrame) -> DataFrame:
    """``(mix, source, share, cap)``: shares that are no positive numbers are 0; of repeated sources shares add up and the smallest cap holds."""
    share = F.col("target_share").cast("double")
    share = F.when(F.isnan(share) | (share < 0) | share.isNull() | (share == float("inf")), 0.0).otherwise(share)
    rows = targets.where("mix is not null and source is not null").select("mix", source_key(F.col("source")).alias("source"), share.alias("share"), F.col("max_repeats").cast("bigint").alias("cap"))
    return rows.groupBy("mix", "source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix, source, share, reachable_share, cap, documents, available, rate)`` from ``sizes(source, documents, available)``.

    ``share`` is relative to the whole mix. A source without tokens or with a cap below 1 can't be used: its share is
    spread over the others in ``reachable_share``. ``rate`` is the expected number of copies of each of its documents. A
    mix's total is the smallest of all tokens of its sources and, over capped sources, cap * tokens / share.
    """
    plan = clean_targets(targets).join(sizes, "source", "left").fillna(0, ["documents", "available"])
    usable = (F.col("share") > 0) & (F.col("available") > 0) & (F.coalesce("cap", F.lit(1)) >= 1)
    plan = plan.withColumn("weight", F.when(usable, F.col("share")).otherwise(0.0))
    sums = plan.groupBy("mix").agg(F.sum("share").alias("all_shares"), F.sum("weight").alias("all_weights"))
    plan = plan.join(sums, "mix").withColumn("reachable_share", F.when(F.col("all_weights") > 0, F.col("weight") / F.col("all_weights")).otherwise(0.0))
    bound = F.when(F.col("weight") > 0, F.col("cap") * F.col("available") / F.col("reachable_share"))
    totals = plan.groupBy("mix").agg(F.min(bound).alias("capped"), F.sum(F.when(F.col("weight") > 0, F.col("available"))).alias("present"))
    plan = plan.join(totals, "mix").withColumn("total", F.least("present", "capped"))
    rate = F.when(F.col("weight") > 0, F.col("reachable_share") * F.col("total") / F.col("available")).otherwise(0.0)
    share = F.when(F.col("all_shares") > 0, F.col("share") / F.col("all_shares")).otherwise(0.0)
    return plan.select("mix", "source", share.alias("share"), "reachable_share", "cap", "documents", "available", F.when(F.col("cap").isNotNull(), F.least(rate, F.col("cap").cast("double"))).otherwise(rate).alias("rate"))


def sized_documents(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary_dir: str | None = None) -> DataFrame:
    """``(id, source, tokens)`` of the documents of the named sources that have tokens."""
    wanted = clean_targets(targets).select("source").distinct()
    rows = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where("id is not null")
    rows = rows.join(wanted, "source", "left_semi")  # a handful of configured names
    return token_counts(rows, "id", "text", ["source"], vocabulary_dir).where("tokens > 0").dropDuplicates(["id"])


def mix_copies(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``(mix, source, id_col, tokens, copies)`` of the documents taken, the plan they follow).

    A document's number of copies never exceeds its source's ``max_repeats``. Null, empty and tokenless texts are never
    taken; repeated ids count once.
    """
    sized = cut(sized_documents(docs, targets, id_col, text_col, source_col, vocabulary_dir))
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    plan = cut(mix_plan(sizes, targets))
    blocks = max(1, math.ceil(sized.count() / BLOCK))
    active = plan.where("rate > 0").select("mix", "source", "rate")  # one row per configured mix and source
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    rows = sized.join(active, "source").select("mix", "source", "id", "tokens", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), block.alias("block"))
    schema = ROUNDED.format(id=docs.schema[id_col].dataType.simpleString())

    def leaf(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [settle(g, "leaf") for _, g in rows.groupby(["mix", "source"], sort=True)]
        return pd.concat(parts)[names]

    names = [x.split()[0] for x in schema.split(", ")]
    rows = cut(rows.withColumn("settled", F.lit(False)).groupBy("block").applyInPandas(leaf, schema))
    done, open_, width, level = [rows.where("settled")], rows.where("not settled"), blocks, 0
    while True:
        level += 1
        final = width <= FAN_IN

        met = open_.withColumn("block", F.floor(F.col("block") / FAN_IN)).groupBy("mix", "source", "block").applyInPandas(meeting(level, final, names), schema)
        if final:
            done.append(met)
            break
        met = cut(met)
        done.append(met.where("settled"))
        open_, width = met.where("not settled"), math.ceil(width / FAN_IN)
    everything = done[0]
    for frame in done[1:]:
        everything = everything.unionByName(frame)
    taken = everything.where("whole > 0").select("mix", "source", F.col("id").alias(id_col), "tokens", F.col("whole").alias("copies"))
    return taken, plan


def mix_shares(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary_dir: str | None = None) -> DataFrame:
    """Per mix and source: target and reachable share, cap, documents and tokens there, copies and tokens taken, share reached."""
    taken, plan = mix_copies(docs, targets, id_col, text_col, source_col, vocabulary_dir)
    sums = taken.groupBy("mix", "source").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    out = plan.join(sums, ["mix", "source"], "left").fillna(0, ["copies", "most_copies", "tokens"])
    totals = out.groupBy("mix").agg(F.sum("tokens").alias("mix_tokens"))
    out = out.join(totals, "mix")
    reached: Column = F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0)
    return out.select("mix", "source", F.col("share").alias("target_share"), "reachable_share", F.col("cap").alias("max_repeats"), "documents", "available", "copies", "most_copies", "tokens", reached.alias("share_reached"))
