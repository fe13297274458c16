"""Mixing sources to target weights by temperature.

Per source the tokens of all its documents are summed with a public tokenizer. The weight of a source is its target
share raised to an exponent and normalised; the exponent is bisected until the mix meets a target entropy or, without
one, is the largest up to 1 at which every source keeps its repetition limit. Where no exponent does, sources at their
limit stay there and the others share the rest by their weights, so that the weights are the shares of the mix. Budgets
are realised as whole passes plus part of one more permutation of the source's documents: token sums of cells (block and
size of document) are taken in order as they fit, and one cell is split by documents, so that nothing is ever sorted or
gathered by source on one executor.

Defined results
    * a source is compared trimmed and in lower case; documents without a source, or with one without a target, count
      in the total and are not mixed; null text has no tokens; documents repeated in the table count as they stand.
    * a source whose share can't be reached within its limit is reported as such; documents are taken whole, so that a
      source stays under its budget by less than what any document left out would add; a source
      without documents has share 0; a target share of 0 gives 0; shares are of the mix as realised.
    * empty tables give no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.session import cut, spread

#: The split pattern of the vocabulary file; the package that brings the file gives it, this is used where it doesn't.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCKS = 1024


@cache
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, tokens): token counts of whole texts; source trimmed, lower case, empty as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    src = F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source")
    return spread(docs.select("doc_id", src, "text")).mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def temper(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and normalised."""
    raised = {k: v**exponent if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def bisect_exponent(shares: dict[str, float], good, low: float, high: float, steps: int = 60) -> float:
    """The largest exponent in [low, high] for which ``good(weights)`` holds, if it holds at low and fails beyond some point."""
    if good(temper(shares, high)):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(temper(shares, mid)) else (low, mid)
    return low


def temperature(shares: dict[str, float], tokens: dict[str, float], repeats: dict[str, int], total: float, target_entropy: float | None = None, floor: float = 0.0) -> float:
    """The exponent of the mix: entropy at least ``target_entropy``, else 1 where every source keeps its limit, else the
    largest under 1 at which sources short of their share lack no more than at the flattest exponent ``floor``."""
    if target_entropy is not None:
        return bisect_exponent(shares, lambda w: entropy(w) >= target_entropy, 0.0, 8.0)
    lack = lambda w: sum(max(0.0, v * total - tokens.get(k, 0.0) * repeats.get(k, 1)) for k, v in w.items())
    if lack(shares) == 0:
        return 1.0
    return bisect_exponent(shares, lambda w: lack(w) == 0, floor, 1.0) if lack(temper(shares, floor)) == 0 else 1.0


def source_sizes(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, total): one row per source with a target, ``total`` over all documents."""
    # Read twice, for the total and per source; cut, so that texts are tokenized once.
    per = cut(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    goal = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null")
    return goal.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).join(F.broadcast(total))


def within_limits(w: dict[str, float], limit: dict[str, float]) -> dict[str, float]:
    """Weights of which none is above its limit: what a source can't take goes to the others by their weights, as far as they can."""
    full: set[str] = set()
    while True:
        open_ = sum(v for k, v in w.items() if k not in full)
        left = max(0.0, 1.0 - sum(limit[k] for k in full))
        out = {k: limit[k] if k in full else left * v / open_ if open_ else 0.0 for k, v in w.items()}
        over = {k for k, v in out.items() if k not in full and v > limit[k]}
        if not over:
            return out
        full |= over


def plan_mix(sizes: list, target_entropy: float | None = None) -> list[dict]:
    """Budgets per source. ``sizes``: rows of source_sizes, as many as there are targets."""
    if not sizes:
        return []
    total = float(sizes[0]["total"])
    share = {r["source"]: r["target_share"] or 0.0 for r in sizes}
    have = {r["source"]: float(r["tokens"]) for r in sizes}
    rep = {r["source"]: int(r["max_repeats"]) for r in sizes}
    exponent = temperature(share, have, rep, total, target_entropy)
    part = within_limits(temper(share, exponent), {s: have[s] * rep[s] / total if total else 0.0 for s in share})
    mixed = sum(part.values())
    out = []
    for r in sizes:
        s = r["source"]
        used = min(part[s] * total, have[s] * rep[s])
        passes = used / have[s] if have[s] else 0.0
        passes = float(round(passes)) if abs(passes - round(passes)) < 1e-9 else passes
        out.append({"source": s, "target_share": share[s], "weight": part[s] / mixed if mixed else 0.0, "exponent": exponent, "tokens": int(have[s]), "max_repeats": rep[s], "short": have[s] * rep[s] < share[s] * total, "passes": passes})
    return out


def temper_tokens(sizes: list, target_entropy: float | None = None, steps: int = 60) -> list[dict]:
    """Weights by the sources' own token shares, raised to the largest exponent up to 1 at which the mix has the target entropy
    (without one, that of the target shares), or, where a source would be used beyond its limit, to the smallest above it
    at which none is. At exponent 1 every source is used once, so there always is one; a source without tokens has weight 0."""
    have = {r["source"]: float(r["tokens"]) for r in sizes}
    rep = {r["source"]: int(r["max_repeats"]) for r in sizes}
    goal = {r["source"]: r["target_share"] or 0.0 for r in sizes}
    total = sum(have.values())
    if not total:
        return []
    share = {k: v / total for k, v in have.items()}
    want = entropy(temper(goal, 1.0)) if target_entropy is None else target_entropy
    exponent = bisect_exponent(share, lambda w: entropy(w) >= want - 1e-12, 0.0, 1.0)
    fits = lambda e: all(w * total <= have[k] * rep[k] + 1e-9 * total for k, w in temper(share, e).items())
    if not fits(exponent):
        low, high = exponent, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        exponent = high
    w = temper(share, exponent)
    return [{"source": k, "token_share": share[k], "weight": w[k], "exponent": exponent, "passes": w[k] * total / have[k] if have[k] else 0.0} for k in share]


def tempered(docs: DataFrame, targets: DataFrame, path: str, target_entropy: float | None = None) -> DataFrame:
    """(source, token_share, weight, exponent, passes): the sources with a target mixed by temperature alone."""
    rows = temper_tokens(source_sizes(with_tokens(docs, path), targets).collect(), target_entropy)
    return docs.sparkSession.createDataFrame(rows, "source string, token_share double, weight double, exponent double, passes double")


PLAN = "source string, target_share double, weight double, exponent double, tokens bigint, max_repeats int, short boolean, passes double"


def _plan(tokens: DataFrame, targets: DataFrame, target_entropy: float | None = None) -> DataFrame:
    return tokens.sparkSession.createDataFrame(plan_mix(source_sizes(tokens, targets).collect(), target_entropy), PLAN)


def mix_plan(docs: DataFrame, targets: DataFrame, path: str, target_entropy: float | None = None) -> DataFrame:
    """One row per source with a target: its weight, how often it is used (``passes``) and whether it falls short."""
    return _plan(with_tokens(docs, path), targets, target_entropy)


def short_sources(plan: DataFrame) -> DataFrame:
    """Sources that cannot reach their share within their repetition limit."""
    return plan.where("short").select("source")


def fill(cells: list[tuple], budget: float) -> list[tuple]:
    """(block, size, room) of the cells taken: whole ones as they fit in order (room null), then the first of the others that
    has a document small enough, with what is left. ``cells``: (block, size, tokens, smallest document), in order."""
    out, skipped = [], []
    for block, size, n, least in cells:
        if n <= budget and (n or (budget > 0 and not skipped)):
            out.append((block, size, None))
            budget -= n
        elif n:
            skipped.append((block, size, least))
    split = next(((b, z, float(budget)) for b, z, least in skipped if least <= budget), None)
    return [*out, split] if split else out


def _taken(tokens: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, repeat, block, place): whole passes, and of the last one the cells and documents in budget."""
    d = tokens.join(F.broadcast(plan.where("passes > 0").select("source", "passes", F.col("tokens").alias("have"))), "source")
    each = d.select("*", F.explode(F.sequence(F.lit(1), F.ceil("passes").cast("int"))).alias("repeat"))
    place = F.pmod(F.xxhash64("doc_id", "repeat", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = each.withColumn("place", place).withColumn("block", F.floor(F.col("place") * BLOCKS).cast("int")).withColumn("size", F.when(F.col("tokens") > 0, F.floor(F.log2("tokens"))).otherwise(-1).cast("int"))
    part = each.where(F.col("repeat") > F.col("passes"))
    cells = part.groupBy("source", "block", "size").agg(F.sum("tokens").alias("n"), F.min("tokens").alias("least"), F.first((F.col("passes") - F.col("repeat") + 1) * F.col("have")).alias("budget"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("block", "size", "n", "least", "budget"))))
        got = fill([r[:4] for r in rows], round(float(rows[0][4]), 3)) if rows else []
        cols = list(zip(*got)) or [(), (), ()]
        types = (pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(got), pa.string()), *(pa.array(c, t) for c, t in zip(cols, types))], names=["source", "block", "size", "room"])

    # At most BLOCKS times the sizes there are, for each source, whatever the number of documents.
    chosen = part.join(cells.groupBy("source").applyInArrow(run, "source string, block int, size int, room double"), ["source", "block", "size"])
    names = ["doc_id", "source", "tokens", "repeat", "block", "place"]
    whole = each.where(F.col("repeat") <= F.col("passes")).select(names).unionByName(chosen.where("room is null or isnan(room)").select(names))
    w = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = chosen.where("room is not null and not isnan(room)").where("tokens <= room").withColumn("run", F.sum("tokens").over(w)).where("run <= room")
    return whole.unionByName(split.select(names))


def realise(docs: DataFrame, plan: DataFrame, path: str, seed: int = 7) -> DataFrame:
    """(doc_id, source, repeat, block, place): each pass is a permutation of the source's documents in BLOCKS blocks; of the
    last pass documents are taken up to the token budget, see ``fill``."""
    return _taken(cut(with_tokens(docs, path)), plan, seed).drop("tokens")


def mix(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """The mix of ``realise`` by the plan of ``mix_plan``; texts are tokenized once."""
    tokens = cut(with_tokens(docs, path))
    return _taken(tokens, _plan(tokens, targets)).drop("tokens")


def actual_shares(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """Per source: target share, actual share of the mix as realised, tokens used and the most uses of a document."""
    tokens = cut(with_tokens(docs, path))
    plan = _plan(tokens, targets)
    used = _taken(tokens, plan).groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("repeat").alias("most_uses"))
    total = used.agg(F.sum("used_tokens").alias("all_used"))
    return (
        plan.join(used, "source", "left")
        .join(F.broadcast(total))
        .select("source", "target_share", "weight", "short", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (F.coalesce("used_tokens", F.lit(0)) / F.col("all_used")).alias("actual_share"))
    )
