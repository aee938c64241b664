"""Mixing sources to target shares of tokens, by balanced sampling with the cube method.

A source's documents are all taken the same whole number of times and once more with a fraction of probability.  The cube method makes those
draws so that the sampled tokens and the sampled number of documents stay what they are expected to be: the vector of probabilities moves in the
null space of the two balancing constraints until a probability is 0 or 1, again and again (flight).  Blocks of documents fly by themselves; the at
most two undecided of each block form new blocks, until one small landing problem a source remains.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, count_tokens

BLOCK = 2_000  #: documents of one flight
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves inclusion probabilities p until at most two are fractional, keeping sum(p) and sum(p * x). u: uniform numbers, one a step."""
    p, scale = p.astype(float).copy(), max(float(np.abs(x).max(initial=0.0)), 1.0)
    live = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    held: list[int] = []
    step = 0
    while True:
        while len(held) < 3 and live:
            held.append(live.pop())
        if len(held) < 3:
            return p
        a, b, c = held
        xa, xb, xc = x[a] / scale, x[b] / scale, x[c] / scale
        v = np.array([xb - xc, xc - xa, xa - xb])  # orthogonal to (1, 1, 1) and (xa, xb, xc)
        if np.abs(v).max() < EPS:  # equal sizes: any move that keeps the sum
            v = np.array([1.0, -1.0, 0.0])
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(v > EPS, (1 - q) / v, np.where(v < -EPS, -q / v, np.inf)))
            down = np.min(np.where(v > EPS, q / v, np.where(v < -EPS, (q - 1) / v, np.inf)))
        q = q + up * v if u[step % len(u)] * (up + down) < down else q - down * v
        step += 1
        q = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
        p[held] = q
        held = [h for h, z in zip(held, q) if 0.0 < z < 1.0]


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounds the last fractional probabilities (at most two) to the corner nearest to the balance of tokens, then of documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best, out = None, p.copy()
    for corner in range(1 << len(left)):
        bits = np.array([(corner >> k) & 1 for k in range(len(left))], dtype=float)
        cost = (abs(float(((bits - p[left]) * x[left]).sum())), abs(float((bits - p[left]).sum())))
        if best is None or cost < best:
            best = cost
            out[left] = bits
    return out


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    return pd.util.hash_array(ids.astype(np.int64) ^ np.int64(seed)).astype(np.float64) / 2.0**64


def _fly(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row"]).reset_index(drop=True)
        p, x = pdf["p"].to_numpy(), pdf["tokens"].to_numpy(dtype=float)
        order = np.argsort(_uniform(pdf["row"].to_numpy(), seed), kind="stable")
        q = p.copy()
        q[order] = flight(p[order], x[order], _uniform(pdf["row"].to_numpy()[order], seed + 1))
        pdf["p"] = land(q, x) if last else q
        return pdf

    return run


def plan_shares(totals: dict, targets: dict) -> dict:
    """{source: expected copies of each document}: the largest mixture that has the target shares of the sources at hand and repeats none beyond its cap.

    totals: tokens by source; targets: source -> (share, cap). Shares of sources without tokens are spread over the others in proportion.
    """
    at_hand = {s: (w, cap) for s, (w, cap) in targets.items() if w and w > 0 and cap and cap > 0 and totals.get(s, 0) > 0}
    whole = sum(w for w, _ in at_hand.values())
    size = min((cap * totals[s] / (w / whole) for s, (w, cap) in at_hand.items()), default=0.0)
    return {s: min(float(cap), size * w / whole / totals[s]) for s, (w, cap) in at_hand.items()}


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents in the mixture, copies from 1 to the source's cap.

    Nulls: documents without a source, or of a source without a target, aren't part of it; null and empty texts have no tokens and take no part.
    Repeated rows are documents of their own. If no source of the targets has tokens the mixture is empty.
    """
    counted = count_tokens(docs, vocabulary, carry="source").where("source is not null and tokens > 0")
    sized = cut(counted.withColumn("row", F.monotonically_increasing_id()))
    wanted = {r.source: (r.target_share, r.max_repeats) for r in targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}  # one row a source of the mixture
    known = sized.where(F.col("source").isin(*wanted)) if wanted else sized.limit(0)
    stats = {r.source: (r.tokens, r.n) for r in known.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    copies = plan_shares({s: t for s, (t, _) in stats.items()}, wanted)
    if not copies:
        return sized.limit(0).select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    expect = F.create_map(*[F.lit(v) for kv in copies.items() for v in kv])[F.col("source")]
    rows = known.where(F.col("source").isin(*copies)).withColumn("whole", F.floor(expect + EPS).cast("int")).withColumn("p", F.greatest(expect - F.col("whole"), F.lit(0.0)))
    schema = "doc_id long, source string, tokens long, row long, whole int, p double, _block long"
    decided, open_ = [], rows
    left, level = max(n for _, n in stats.values()), 0
    while True:
        last = left <= block
        size = max(1, -(-left // block))
        flown = open_.withColumn("_block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(size))).groupBy("source", "_block").applyInPandas(_fly(last, seed + 10 * level), schema)
        flown = flown.drop("_block")
        if last:
            decided.append(flown)
            break
        flown = cut(flown)
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~fractional))
        open_, left, level = flown.where(fractional), 2 * size, level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.withColumn("copies", (F.col("whole") + F.round("p")).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, spread_share, actual_share, tokens, documents, most_copies) of each source of the targets; nothing taken: zeros.

    `spread_share` is the target among the sources that have something in the mixture: what `actual_share` is to be held against.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_copies"))
    joined = targets.join(got, "source", "left")
    there = F.when(F.col("tokens") > 0, F.col("target_share"))
    sums = joined.agg(F.sum("tokens"), F.sum(there)).first()
    share = lambda x, whole: F.coalesce(F.try_divide(x, F.lit(whole)), F.lit(0.0))
    return joined.select(
        "source", "target_share", share(there, sums[1]).alias("spread_share"), share(F.col("tokens"), sums[0]).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
