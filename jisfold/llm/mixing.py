"""Mixing overlapping sources to target weights by min-cost flow.

Documents that belong to the same set of sources form a membership pattern.
Patterns are aggregated to their words; a small network then routes them:
from each pattern, one arc for each repetition (the first copy costs nothing,
each further copy costs more than the one before, so copies are spread evenly
before any is repeated), to the pattern's sources, each of which takes its
target.  The cheapest largest flow says how many words each pattern gives to
each source.  A pattern that gives F of its S words is taken F // S times
whole; for the rest, documents in seeded order (MD5 of seed and id) are taken
once more while they fit, and then the largest one that fits into what is
left.  ``fill`` goes on from there: documents that do not fit are skipped and
later ones taken, until none fits; ``mixed_documents`` does so.

The network has a node for each pattern and source, not for each document; it
is solved on the driver, and more than ``MAX_PATTERNS`` patterns are an error
that says so.  Documents are never gathered: the seeded order is cut at a
bucket of the hash that sums by bucket find, and only that bucket's documents
are ordered, for each pattern.

Defined results: null text has size 0; documents without words are never in
want (taken 0) and count in no order; a null source is a source of its own,
last by order; a document without any source (an empty set) is not taken; an
empty table gives an empty result; rows that share an id and pattern are
ordered by their text's hash, and of rows equal in all of that as many are
taken as fit (with ``fill``, all or none of them); extra columns are ignored,
by ``mixed_documents`` kept, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jisfold.llm import common

#: Membership patterns that the driver solves at most.
MAX_PATTERNS = 100_000
#: Hex digits of the seeded hash that make a bucket.
BUCKET_DIGITS = 4
SEED = "mix"


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what
    is above is shared again among the others.

    >>> capped_targets([10, 100], [1, 1], 110, 3)
    [30.0, 80.0]
    """
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (most * sizes[i] / weights[i], i))
    out, left, weight = [0.0] * len(sizes), float(total), float(sum(weights[i] for i in order))
    for n, i in enumerate(order):
        if most * sizes[i] * weight > left * weights[i]:
            for j in order[n:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def min_cost_flow(capacities: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int]) -> dict[tuple[int, int], int]:
    """Words that each pattern gives to each of its sources.

    capacities: words of each pattern, once for each entry of ``costs`` (the
    costs of its first copy, its second and so on, not falling).  Successive
    cheapest paths with potentials; every path fills a copy or a quota or
    turns around an earlier choice, so their number does not grow with the
    words.
    """
    patterns, sources = len(capacities), len(quotas)
    start, end = patterns + sources, patterns + sources + 1
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(p)
        return len(to) - 2

    gives = {}
    for p, capacity in enumerate(capacities):
        for cost in costs:
            arc(start, p, capacity, cost)
        for s in members[p]:
            gives[p, s] = arc(p, patterns + s, capacity * len(costs), 0)
    for s, quota in enumerate(quotas):
        arc(patterns + s, end, quota, 0)
    potential = [0] * (end + 1)
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        far[start], came = 0, [-1] * (end + 1)
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in arcs[a]:
                if room[e] and (n := d + price[e] + potential[a] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], came[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if far[end] == float("inf"):
            break
        for n in range(end + 1):
            if far[n] < float("inf"):
                potential[n] += int(far[n])
        flow, n = None, end
        while n != start:
            flow = room[came[n]] if flow is None else min(flow, room[came[n]])
            n = to[came[n] ^ 1]
        n = end
        while n != start:
            room[came[n]] -= flow
            room[came[n] ^ 1] += flow
            n = to[came[n] ^ 1]
    return {k: room[e ^ 1] for k, e in gives.items() if room[e ^ 1]}


def separate_flows(capacities: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int]) -> dict[tuple[int, int], int]:
    """min_cost_flow of each part of the network that shares no source with
    another part; where sources do not overlap, a part is one source."""
    part = list(range(len(quotas)))

    def head(s: int) -> int:
        while part[s] != s:
            part[s] = part[part[s]]
            s = part[s]
        return s

    for own in members:
        for s in own[1:]:
            part[head(s)] = head(own[0])
    groups: dict[int, tuple[list[int], list[int]]] = {}
    for s in range(len(quotas)):
        groups.setdefault(head(s), ([], []))[1].append(s)
    for p, own in enumerate(members):
        if own:
            groups[head(own[0])][0].append(p)
    found = {}
    for patterns, sources in groups.values():
        at = {s: i for i, s in enumerate(sources)}
        flow = min_cost_flow([capacities[p] for p in patterns], [[at[s] for s in members[p]] for p in patterns], [quotas[s] for s in sources], costs)
        found |= {(patterns[p], sources[s]): words for (p, s), words in flow.items()}
    return found


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, sources: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most_copies: int = 3, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", fill: bool = False) -> tuple[DataFrame, dict]:
    """One row per document: doc_id, size, pattern, copies, taken (words); and the plan.

    sources: an array of each document's sources (as strings, null for no
    name).  The sources by code point, null last, get the weights in turn,
    and share ``share`` times all words; a source's target is at most
    ``most_copies`` times its words.  The plan has the sources' sizes and
    targets and the flow (see ``route``).  With ``fill``, no document that is
    left fits into what its pattern still lacks.
    """
    named = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(doc_id, words_in(F.col(text)).alias("size"), named.alias("pattern"), order.alias("order"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    # the only pass over the texts: what follows reads these narrow rows
    rows = common.stash(sized, "mix").withColumn("bucket", F.conv(F.substring("order", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("words")).orderBy("pattern").take(MAX_PATTERNS + 1)
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources; merge rare sources first")
    plan = route([(tuple(t.pattern), t.words) for t in totals], weights, share, most_copies)
    taken = select(rows, plan, doc_id, fill)
    return taken, plan


def route(totals: list[tuple[tuple[str, ...], int]], weights: Sequence[float], share: float, most_copies: int) -> dict:
    """The plan: sources with sizes and targets, and each pattern's words to take.

    A source's name is "s" and its text, or "~" for null, which sorts last by
    code point here since "s" sorts before "~".
    """
    names = common.by_code_point(n for pattern, _ in totals for n in pattern)
    at = {n: i for i, n in enumerate(names)}
    sizes = [0] * len(names)
    for pattern, words in totals:
        for n in pattern:
            sizes[at[n]] += words
    everything = sum(words for _, words in totals)
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * everything, most_copies)
    flow = separate_flows([w for _, w in totals], [[at[n] for n in p] for p, _ in totals], [int(t + 0.5) for t in targets], [k * k for k in range(most_copies)])
    gives = {p: 0 for p, _ in totals}
    for (p, _), words in flow.items():
        gives[totals[p][0]] += words
    return {
        "sources": {n: {"size": sizes[i], "target": targets[i]} for i, n in enumerate(names)},
        "patterns": {p: {"words": w, "take": gives[p]} for p, w in totals},
        "flow": {(totals[p][0], names[s]): words for (p, s), words in flow.items()},
    }


def select(rows: DataFrame, plan: dict, doc_id: str, fill: bool = False) -> DataFrame:
    """doc_id, size, pattern, copies, taken: the seeded choice of documents.

    rows: doc_id, size, pattern, order, tie, row, bucket.  Equal rows are
    chosen one by one, in any order; with ``fill`` together (as one document of
    all their words, which is their ``unit``).
    """
    spark = rows.sparkSession
    place = ["order", "tie", "size"] if fill else ["order", "tie", "size", "row"]
    unit = F.sum("size").over(Window.partitionBy("pattern", "order", "tie", "size")) if fill else F.col("size")
    rows = rows.withColumn("unit", unit)
    quota = spark.createDataFrame(
        [(list(p), x["take"] // x["words"] if x["words"] else 0, x["take"] % x["words"] if x["words"] else 0) for p, x in plan["patterns"].items()],
        "pattern array<string>, whole long, rest long",
    )
    # words of each bucket in seeded order: a bounded number of sums for each pattern
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).join(quota, "pattern")
    cut = cut.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = cut.groupBy("pattern").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("c")).select("pattern", F.col("c.bucket").alias("cut"), F.col("c.before").alias("before"))
    bounds = common.stash(quota.join(cut, "pattern", "left"), "mix-bounds")
    # a row for each pattern, MAX_PATTERNS at most, goes to all tasks: a source with
    # very many documents is not brought together in one
    marked = rows.join(F.broadcast(bounds), "pattern")
    below = F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))
    edge = marked.where(F.col("bucket") == F.col("cut"))
    up_to = F.sum("size").over(Window.partitionBy("pattern").orderBy(*place))
    edge = edge.withColumn("more", ((F.col("before") + up_to <= F.col("rest")) & (F.col("size") > 0)).cast("long"))
    rest = marked.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("more", (below & (F.col("rest") > 0) & (F.col("size") > 0)).cast("long"))
    chosen = rest.unionByName(edge)
    # then the largest document that fits into what is left, first in seeded order
    gap = chosen.groupBy("pattern").agg((F.max("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap"))
    gap = common.stash(gap, "mix-gaps")
    fits = chosen.where("more = 0 and size > 0").join(F.broadcast(gap), "pattern").where(F.col("unit") <= F.col("gap"))
    largest = F.struct((-F.col("unit")).alias("neg"), *place)
    last = fits.groupBy("pattern").agg(F.min(largest).alias("last"))
    out = chosen.join(F.broadcast(last), "pattern", "left")
    is_last = F.coalesce((F.col("more") == 0) & (largest == F.col("last")), F.lit(False))
    out = out.withColumn("more", F.col("more") + is_last.cast("long"))
    if fill:
        out = filled(out.select(doc_id, "size", "pattern", "order", "tie", "bucket", "unit", "whole", "rest", "more"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    return out.select(doc_id, "size", "pattern", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "order", "tie")


def filled(chosen: DataFrame) -> DataFrame:
    """The rows with more documents taken, in seeded order, each that still fits.

    A round takes, of a pattern's documents that fit into its gap, those up to
    the first that does not fit after them; rounds go on until no pattern has
    one that fits.  That is the choice of one pass over the documents in
    order.  Rows equal in order, tie and size are taken or left together.
    """
    place = F.struct("order", "tie", "size")
    now = common.stash(chosen, "mix-fill")
    left = (F.col("more") == 0) & (F.col("size") > 0)
    while True:
        gaps = now.groupBy("pattern").agg((F.max("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap"), F.min(F.when(left, F.col("unit"))).alias("least"))
        gaps = common.stash(gaps.where("least <= gap").select("pattern", "gap"), "mix-gaps")
        if gaps.isEmpty():
            return now.drop("unit")
        fits = now.where(left).join(F.broadcast(gaps), "pattern").where("unit <= gap")
        # as in select(): whole buckets by their sums, and an order in one bucket only
        sums = fits.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = sums.withColumn("before", before).where("before <= gap and before + words > gap")
        cut = common.stash(cut.groupBy("pattern").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("c")).select("pattern", F.col("c.bucket").alias("cut"), F.col("c.before").alias("before")), "mix-cuts")
        up_to = F.sum("size").over(Window.partitionBy("pattern").orderBy("order", "tie", "size"))
        edge = fits.join(F.broadcast(cut), "pattern").where("bucket = cut").withColumn("up_to", F.col("before") + up_to).where("up_to <= gap")
        last = edge.groupBy("pattern").agg(F.max(place).alias("last"))
        bounds = common.stash(gaps.join(cut, "pattern", "left").join(last, "pattern", "left").select("pattern", "gap", "cut", "last"), "mix-bounds")
        inside = F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (place <= F.col("last")))
        takes = F.coalesce(left & (F.col("unit") <= F.col("gap")) & inside, F.lit(False))
        after = now.join(F.broadcast(bounds), "pattern", "left").withColumn("more", F.when(takes, 1).otherwise(F.col("more")).cast("long")).select(*now.columns)
        after = common.stash(after, "mix-fill")
        common.discard(now)
        now = after


def mixed_documents(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of the mix, filled, each as many times as it is taken; columns stay."""
    taken, _ = mix(docs, sources, doc_id=doc_id, text=text, fill=True, **options)
    # rows that share id and text share their copies
    copies = taken.where("copies > 0").groupBy(F.col(doc_id).alias("id"), "tie").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(text).alias("doc_tie"))
    found = rows.join(copies, F.col("doc")[doc_id].eqNullSafe(F.col("id")) & (F.col("doc_tie") == F.col("tie")))
    return found.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc.*")
