"""Pairwise trust between devices and triple-redundant voting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.config import TrustConfig
from fleetwatch.plans.chunked import positions
from fleetwatch.plans.cut import cut


def _pair(a: str = "gpu_a", b: str = "gpu_b") -> list[Column]:
    return [F.least(a, b).alias("gpu_a"), F.greatest(a, b).alias("gpu_b")]


def trust_edges(comparisons: DataFrame) -> DataFrame:
    """Agreement counts and score per unordered pair."""
    e = comparisons.select(*_pair(), "agree", "ts_us").groupBy("gpu_a", "gpu_b").agg(
        F.count_if("agree").alias("agreements"),
        F.count_if(~F.col("agree")).alias("disagreements"),
        F.max("ts_us").alias("last_us"),
    )
    return _score(e)


def _score(e: DataFrame) -> DataFrame:
    total = F.col("agreements") + F.col("disagreements")
    return e.withColumn("comparisons", total).withColumn(
        "trust", F.when(total > 0, F.col("agreements") / total).otherwise(0.5)
    )


def decay_trust(edges: DataFrame, cfg: TrustConfig = TrustConfig()) -> DataFrame:
    d = edges.select(
        "gpu_a", "gpu_b",
        F.round(F.col("agreements") * cfg.decay_factor).cast("long").alias("agreements"),
        F.round(F.col("disagreements") * cfg.decay_factor).cast("long").alias("disagreements"),
        "last_us",
    )
    return _score(d).filter("comparisons > 0")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("gpu_a", "gpu_b")).alias("gpu_uuid")).distinct()


def trust_summary(edges: DataFrame, cfg: TrustConfig = TrustConfig()) -> DataFrame:
    """Coverage of all device pairs, weakest and mean trust over well-tested edges."""
    known = F.col("comparisons") >= cfg.min_comparisons
    s = edges.agg(
        F.count("*").alias("edges"),
        F.count_if(known).alias("tested_edges"),
        F.min(F.when(known, F.col("trust"))).alias("min_trust"),
        F.coalesce(F.avg(F.when(known, F.col("trust"))), F.lit(0.0)).alias("mean_trust"),
        (F.coalesce(F.sum("trust"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("mean_all_edges"),
    )
    n = endpoints(edges).agg(F.count("*").alias("gpus"))
    pairs = F.col("gpus") * (F.col("gpus") - 1) / 2
    return s.crossJoin(n).withColumn(  # one row by one row
        "coverage_pct", F.when(F.col("gpus") < 2, 100.0).otherwise(F.col("tested_edges") / pairs * 100)
    )


def trust_nodes(edges: DataFrame, states: DataFrame, beliefs: DataFrame) -> DataFrame:
    return (
        endpoints(edges).join(states.select("gpu_uuid", "state"), "gpu_uuid", "left")
        .join(beliefs.select("gpu_uuid", "reliability"), "gpu_uuid", "left")
    )


def _slots(results: DataFrame, *extra: str) -> DataFrame:
    """Slots 1-3 of each canary side by side; a slot reported twice keeps its smallest row.
    Conditional aggregates only, so nothing of a canary is gathered."""
    row = F.struct("fingerprint", "gpu_uuid", *extra)
    return results.filter(F.col("slot").between(1, 3)).groupBy("canary_id").agg(
        *[F.min(F.when(F.col("slot") == i, row)).alias(f"s{i}") for i in (1, 2, 3)]
    )


def _outcome() -> dict[str, Column]:
    a, b, c = (F.col(f"s{i}.fingerprint") for i in (1, 2, 3))
    missing = a.isNull() | b.isNull() | c.isNull()
    odd = F.when(missing | ((a == b) & (b == c)), None).when(a == b, 3).when(a == c, 2).when(b == c, 1)
    return {
        "outcome": F.when(missing, "insufficient").when((a == b) & (b == c), "unanimous")
        .when(odd.isNotNull(), "dissent").otherwise("no_consensus"),
        "consensus": F.when(missing, None).when((a == b) | (a == c), a).when(b == c, b),
        "dissenter_slot": odd,
    }


def majority_vote(results: DataFrame) -> DataFrame:
    o = _outcome()
    s = _slots(results)
    who = F.coalesce(*[F.when(o["dissenter_slot"] == i, F.col(f"s{i}.gpu_uuid")) for i in (1, 2, 3)])
    return s.select("canary_id", *[e.alias(n) for n, e in o.items()], who.alias("dissenter_gpu"))


def weighted_vote(results: DataFrame) -> DataFrame:
    """As the majority vote; if all three differ the heaviest wins (last of equals)."""
    o = _outcome()
    s = _slots(results, "weight").select("*", *[e.alias(n) for n, e in o.items()])
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}.weight").alias("w"), F.lit(i).alias("slot")) for i in (1, 2, 3)]))
    heavy = F.when(F.col("outcome") == "no_consensus", best["slot"])
    won = F.coalesce(*[F.when(heavy == i, F.col(f"s{i}.fingerprint")) for i in (1, 2, 3)])
    dissent = (
        F.when(F.col("outcome") == "dissent", F.array("dissenter_slot"))
        .when(heavy.isNotNull(), F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda x: x != heavy))
        .otherwise(F.array().cast("array<int>"))
    )
    return s.select("canary_id", F.coalesce("consensus", won).alias("consensus"), dissent.alias("dissenters"))


def agreement_groups(results: DataFrame) -> DataFrame:
    """Slots that share a fingerprint, any number of slots; a canary has few slots, so
    each group's slot set is as small as the redundancy level."""
    return results.groupBy("canary_id", "fingerprint").agg(
        F.array_sort(F.collect_set("slot")).alias("slots"), F.countDistinct("slot").alias("size")
    )


def tmr_to_comparisons(results: DataFrame) -> DataFrame:
    """Unanimous: three agreements. Dissent: one agreement, two disagreements."""
    o = _outcome()
    s = _slots(results, "ts_us").select("*", *[e.alias(n) for n, e in o.items()])
    pairs = F.array(
        *[
            F.struct(
                F.col(f"s{i}.gpu_uuid").alias("gpu_a"), F.col(f"s{j}.gpu_uuid").alias("gpu_b"),
                (F.col(f"s{i}.fingerprint") == F.col(f"s{j}.fingerprint")).alias("agree"),
                F.greatest(F.col(f"s{i}.ts_us"), F.col(f"s{j}.ts_us")).alias("ts_us"),
            )
            for i, j in ((1, 2), (1, 3), (2, 3))
        ]
    )
    return s.filter(F.col("outcome").isin("unanimous", "dissent")).select("canary_id", F.inline(pairs))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge once per endpoint: (src, dst, trust, comparisons)."""
    ends = F.array(
        F.struct(F.col("gpu_a").alias("src"), F.col("gpu_b").alias("dst")),
        F.struct(F.col("gpu_b").alias("src"), F.col("gpu_a").alias("dst")),
    )
    return edges.select(F.inline(ends), "trust", "comparisons")


def _reach(ends: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """(end, node, product): the best product of trusts over at most `hops` steps from each end."""
    best = ends.select("end", F.col("end").alias("node"), F.lit(1.0).alias("product"))
    for _ in range(hops):
        step = best.join(steps, best.node == steps.via).select(
            "end", F.col("next").alias("node"), (F.col("product") * F.col("trust")).alias("product")
        )
        best = step.groupBy("end", "node").agg(F.max("product").alias("product"))
    return best


def transitive_trust(pairs: DataFrame, edges: DataFrame, cfg: TrustConfig = TrustConfig()) -> DataFrame:
    """Best product of trusts over paths of at most `max_hops` well-tested edges.

    `pairs` are (src, dst). A direct edge wins at once. Sources go half of the hops, destinations
    the other half, and a pair's frontiers meet at their common nodes; with two hops a frontier
    is no more than its device's edges. Each pair walks its smaller frontier and looks the
    nodes up in the other, so pairs that share a well-connected device don't walk its frontier each.
    """
    all_edges = both_ways(edges)
    direct = all_edges.select("src", "dst", F.col("trust").alias("direct"))
    asked = cut(pairs.select("src", "dst").distinct().join(direct, ["src", "dst"], "left"))
    usable = all_edges.filter(F.col("comparisons") >= cfg.min_comparisons).select(
        F.col("src").alias("via"), F.col("dst").alias("next"), "trust"
    )
    # A node's step to itself keeps shorter paths, so each hop reads the frontier once.
    usable = cut(usable.unionByName(
        endpoints(edges).select(F.col("gpu_uuid").alias("via"), F.col("gpu_uuid").alias("next"), F.lit(1.0).alias("trust"))
    ))
    open_pairs = asked.filter("direct is null").select("src", "dst")
    out = cut(_reach(open_pairs.select(F.col("src").alias("end")).distinct(), usable, cfg.max_hops // 2))
    back = cut(_reach(open_pairs.select(F.col("dst").alias("end")).distinct(), usable, cfg.max_hops - cfg.max_hops // 2))
    sizes = [f.groupBy("end").agg(F.count(F.lit(1)).alias(n)) for f, n in ((out, "n_out"), (back, "n_back"))]
    sized = cut(
        open_pairs.join(sizes[0].withColumnRenamed("end", "src"), "src").join(sizes[1].withColumnRenamed("end", "dst"), "dst")
    )
    met = []
    for small, walked, looked, walk, look in (
        (F.col("n_out") <= F.col("n_back"), "src", "dst", out, back), (F.col("n_out") > F.col("n_back"), "dst", "src", back, out),
    ):
        first = walk.select(F.col("end").alias(walked), "node", F.col("product").alias("_p"))
        second = look.select(F.col("end").alias(looked), "node", "product")
        met.append(
            sized.filter(small).join(first, walked).join(second, [looked, "node"])
            .groupBy("src", "dst").agg(F.max(F.col("_p") * F.col("product")).alias("product"))
        )
    last = met[0].unionByName(met[1])
    return asked.join(last, ["src", "dst"], "left").select("src", "dst", F.coalesce("direct", "product", F.lit(0.0)).alias("trust"))


#: A device's part of a pair's score where target and device were never compared; compared ones have at most .25.
_UNKNOWN = 0.3


def _run_length(taken: DataFrame, place: str, first: int = 0, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """How many places from `first` on are taken without a gap, per target: (target, run). Places are distinct."""
    w = Window.partitionBy(*by).orderBy(place)
    return (
        taken.select(*by, place, F.row_number().over(w).alias("_n")).groupBy(*by)
        .agg(F.count_if(F.col(place) - first + 1 == F.col("_n")).alias("run"))
    )


def _best(pairs: DataFrame) -> DataFrame:
    """Each target's pair of highest score, ties to the smallest names."""
    best = pairs.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("s"), "gpu_a", "gpu_b")).alias("_b"))
    return best.select("target", "_b.gpu_a", "_b.gpu_b", (-F.col("_b.s")).alias("score"))


def _owned(ranked: DataFrame) -> DataFrame:
    """Each edge under its end with more edges: (owner, other, gpu_a, gpu_b, trust, place). Few devices own the edges of stars."""
    many = ranked.select(F.explode(F.array("gpu_a", "gpu_b")).alias("gpu")).groupBy("gpu").agg(F.count(F.lit(1)).alias("_d"))
    e = ranked.join(many.select(F.col("gpu").alias("gpu_a"), F.col("_d").alias("_da")), "gpu_a").join(
        many.select(F.col("gpu").alias("gpu_b"), F.col("_d").alias("_db")), "gpu_b"
    )
    first = F.col("_da") >= F.col("_db")
    return e.select(
        F.when(first, F.col("gpu_a")).otherwise(F.col("gpu_b")).alias("owner"),
        F.when(first, F.col("gpu_b")).otherwise(F.col("gpu_a")).alias("other"), "gpu_a", "gpu_b", "trust", "place",
    )


def _owned_pairs(live: DataFrame, near: DataFrame, owned: DataFrame, width: int) -> DataFrame:
    """As `_compared_pairs` for the `live` targets, with a list of edges of falling trust for each owner.

    A target walks each owner's list to the first device that it wasn't compared with: no later edge of that
    owner is better. Lists are read in pieces, and one is left when what it can reach is below the target's best.
    The first pieces take targets x owners steps; later ones are read by targets that know a whole piece.
    """
    lists = cut(positions(owned, ["owner", "place"], "spot"))
    owners = cut(lists.groupBy("owner").agg(F.min("spot").alias("start"), F.count(F.lit(1)).alias("size"), F.max("trust").alias("least")))
    known = near.select("target", F.col("gpu").alias("owner"), F.col("f").alias("_f"), F.lit(True).alias("_near"))
    met = F.coalesce("_near", F.lit(False))
    within = F.col("least") * 0.4 + F.col("f") + F.col("rest") + 1e-9 >= F.col("top")
    walks = cut(
        live.crossJoin(owners.select("owner", "size", "least")).join(known, ["target", "owner"], "left")
        .filter(~met | F.col("_f").isNotNull())  # not the target itself
        .select(
            "target", "owner", "size", "least", "top", F.coalesce("_f", F.lit(_UNKNOWN)).alias("f"),
            F.when(F.col("others") - F.when(met, 0).otherwise(1) >= 1, _UNKNOWN).otherwise(F.coalesce("most", F.lit(0.0))).alias("rest"),
        ).filter(within)
    )
    found, low, key = [], 0, ["target", "owner"]
    while not walks.isEmpty():
        high = low + width
        nth = F.col("spot") - F.col("start")
        piece = cut(
            lists.join(owners.join(walks.select("owner").distinct(), "owner", "left_semi").select("owner", "start"), "owner")
            .filter(nth.between(low, high - 1)).select("owner", nth.alias("nth"), "other", "gpu_a", "gpu_b", "trust")
        )
        mine = F.col("owner") == F.col("gpu_a")
        score = lambda other: F.round(
            F.col("trust") * 0.4 + F.when(mine, F.col("f")).otherwise(other) + F.when(mine, other).otherwise(F.col("f")), 9
        )
        touched = cut(
            near.select("target", F.col("gpu").alias("other"), F.col("f").alias("_fo"))
            .join(walks.select("target").distinct(), "target", "left_semi").join(piece, "other")
            .join(walks.select(*key, "f"), key).select(*key, "nth", "gpu_a", "gpu_b", score(F.col("_fo")).alias("score"))
        )
        free = (
            walks.select(*key, "f").join(_run_length(touched, "nth", low, ("target", "owner")), key, "left")
            .withColumn("nth", F.coalesce("run", F.lit(0)) + low).join(piece, ["owner", "nth"])
            .select(*key, "gpu_a", "gpu_b", score(F.lit(_UNKNOWN)).alias("score"), F.lit(True).alias("free"))
        )
        seen = cut(
            touched.filter("score is not null").select(*key, "gpu_a", "gpu_b", "score", F.lit(False).alias("free")).unionByName(free)
        )
        found.append(_best(seen))
        tops = seen.groupBy("target").agg(F.max("score").alias("_top"))
        least = piece.groupBy("owner").agg(F.min("trust").alias("least"))
        walks = cut(
            walks.filter(F.col("size") > high).drop("least").join(seen.filter("free").select(*key), key, "left_anti")
            .join(least, "owner").join(tops, "target", "left").withColumn("top", F.greatest("top", "_top")).drop("_top").filter(within)
        )
        low, width = high, width * 8
    return reduce(DataFrame.unionByName, found)


def _compared_pairs(t: DataFrame, near: DataFrame, ranked: DataFrame, n_devices: int, width: int) -> DataFrame:
    """Pairs that were compared and may be a target's best one: (target, gpu_a, gpu_b, score).

    Edges are read in blocks of falling trust. Of a block, the edges that touch a target's neighbours are
    found by an equality join and scored; the first edge that touches none of them beats all later
    edges, as no compared device adds more than an unknown one. So a target leaves with its first
    untouched edge, or when its best pair is above what later edges can reach. Where fewer devices than a block has
    edges own all edges, as in stars, targets still there walk the owners' edges instead of further blocks.
    """
    total = ranked.count()
    parts = near.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.max("f").alias("most"))
    others = F.col("others")
    most = F.coalesce("most", F.lit(0.0))
    live = cut(t.join(parts, "target", "left").withColumn("others", F.lit(n_devices) - F.coalesce("_n", F.lit(0))).select(
        "target", F.lit(-1.0).alias("top"), "others", "most",
        F.when(others >= 2, 2 * _UNKNOWN).when(others == 1, _UNKNOWN + most).otherwise(2 * most).alias("reach"),
    ))
    found, low, n_owners = [], 0, None
    while low < total and not live.isEmpty():
        if low:
            if n_owners is None:
                n_owners = _owned(ranked).select("owner").distinct().count()
            if n_owners <= width:
                found.append(_owned_pairs(live, near, _owned(ranked), width))
                break
        high = min(low + width, total)
        block = ranked.filter(F.col("place").between(low, high - 1))
        least = block.agg(F.min("trust")).first()[0]
        ends = block.select("place", F.inline(F.array(
            F.struct(F.col("gpu_a").alias("gpu"), F.lit(True).alias("is_a")),
            F.struct(F.col("gpu_b").alias("gpu"), F.lit(False).alias("is_a")),
        )))
        touched = cut(
            near.join(live.select("target"), "target", "left_semi").join(ends, "gpu").groupBy("target", "place").agg(
                F.max(F.when(F.col("is_a"), F.col("f"))).alias("fa"), F.max(F.when(~F.col("is_a"), F.col("f"))).alias("fb"),
                F.bool_or(F.col("f").isNull()).alias("own"),
            )
        )
        part = [F.coalesce(c, F.lit(_UNKNOWN)) for c in ("fa", "fb")]
        scored = touched.filter("not own").join(block, "place").select(
            "target", "gpu_a", "gpu_b", F.round(F.col("trust") * 0.4 + part[0] + part[1], 9).alias("score"), F.lit(False).alias("free")
        )
        free = (
            live.join(_run_length(touched, "place", low), "target", "left")
            .select("target", (F.coalesce("run", F.lit(0)) + low).alias("place")).join(block, "place")
            .select("target", "gpu_a", "gpu_b", F.round(F.col("trust") * 0.4 + 2 * _UNKNOWN, 9).alias("score"), F.lit(True).alias("free"))
        )
        both = cut(scored.unionByName(free))
        found.append(_best(both))
        seen = both.groupBy("target").agg(F.bool_or("free").alias("free"), F.max("score").alias("_top"))
        live = cut(
            live.join(seen, "target", "left").select("target", F.greatest("top", "_top").alias("top"), "others", "most", "reach", "free")
            .filter(~F.coalesce("free", F.lit(False)) & (F.col("top") <= F.col("reach") + least * 0.4 + 1e-9)).drop("free")
        )
        low, width = high, width * 8
    return reduce(DataFrame.unionByName, found) if found else t.limit(0).select(
        "target", F.lit("").alias("gpu_a"), F.lit("").alias("gpu_b"), F.lit(0.0).alias("score")
    )


def _unknown_pairs(rest: DataFrame, near: DataFrame, devices: DataFrame, ways: DataFrame, n_devices: int, width: int) -> DataFrame:
    """Per target the first two devices (by name) that neither it nor each other were compared with.

    The first device is the first gap in the target's neighbours; the second is the first later gap in both
    devices' neighbours, looked for in ranges that widen. Targets without a second device are left out.
    """
    near = near.join(rest, "target", "left_semi").select("target", "seat")
    todo = cut(
        rest.join(_run_length(near, "seat"), "target", "left").select("target", F.coalesce("run", F.lit(0)).alias("u"))
        .filter(F.col("u") < n_devices)
    )
    seat = devices.select(F.col("gpu").alias("dst"), "seat")
    beside = cut(
        ways.join(devices.select(F.col("gpu").alias("src"), F.col("seat").alias("u")), "src").join(seat, "dst").select("u", "seat")
    )
    found, done = [], 0
    while not todo.isEmpty():
        place = F.col("seat") - F.col("u") - done - 1
        taken = near.join(todo, "target").unionByName(todo.join(beside, "u").select("target", "seat", "u"))
        taken = taken.select("target", place.alias("place")).filter(F.col("place").between(0, width - 1)).distinct()
        step = cut(
            todo.join(_run_length(taken, "place"), "target", "left").select("target", "u", F.coalesce("run", F.lit(0)).alias("run"))
        )
        v = F.col("u") + F.col("run") + done + 1
        found.append(step.filter((F.col("run") < width) & (v < n_devices)).select("target", "u", v.alias("v")))
        todo = cut(step.filter((F.col("run") >= width) & (F.col("u") + done + 1 + width < n_devices)).select("target", "u"))
        done, width = done + width, width * 8
    pairs = reduce(DataFrame.unionByName, found) if found else rest.limit(0).select("target", F.lit(0).alias("u"), F.lit(0).alias("v"))
    return (
        pairs.join(devices.select(F.col("seat").alias("u"), F.col("gpu").alias("gpu_a")), "u")
        .join(devices.select(F.col("seat").alias("v"), F.col("gpu").alias("gpu_b")), "v")
        .select("target", "gpu_a", "gpu_b", F.round(F.lit(0.2 + 2 * _UNKNOWN), 9).alias("score"))
    )


def _fresh_pairs(rest: DataFrame, near: DataFrame, devices: DataFrame, ways: DataFrame, n_devices: int) -> DataFrame:
    """Best pair that was never compared, for targets next to nearly all devices.

    A device's best partner is the first in the target's order of devices that it has no edge to: the first
    rank missing from its neighbours' ranks. The work is targets x (devices + edges).
    """
    known = near.join(rest, "target", "left_semi")
    w = Window.partitionBy("target").orderBy("seat")
    ends = known.select("target", "seat").unionByName(rest.select("target", F.lit(n_devices).cast("long").alias("seat")))
    gaps = ends.select("target", F.coalesce(F.lag("seat").over(w) + 1, F.lit(0).cast("long")).alias("a"), (F.col("seat") - 1).alias("b"))
    unknown = gaps.filter("a <= b").select("target", F.explode(F.sequence("a", "b")).alias("seat")).join(devices, "seat").select(
        "target", "gpu", F.lit(_UNKNOWN).alias("f")
    )
    cand = cut(
        unknown.unionByName(known.filter("f is not null").select("target", "gpu", "f"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("f"), "gpu")))
    )
    ranks = cand.select("target", F.col("gpu").alias("dst"), F.col("rank").alias("taken"))
    taken = (
        ways.join(ranks, "dst").select("target", F.col("src").alias("gpu"), "taken")
        .unionByName(cand.select("target", "gpu", F.col("rank").alias("taken")))
    )
    first_free = (
        taken.withColumn("_n", F.row_number().over(Window.partitionBy("target", "gpu").orderBy("taken"))).groupBy("target", "gpu")
        .agg((F.count_if(F.col("taken") == F.col("_n")) + 1).alias("rank"))
    )
    other = cand.select("target", F.col("gpu").alias("_o"), F.col("f").alias("_fo"), "rank")
    return (
        first_free.join(cand.drop("rank"), ["target", "gpu"]).join(other, ["target", "rank"])
        .select("target", F.least("gpu", "_o").alias("gpu_a"), F.greatest("gpu", "_o").alias("gpu_b"),
                F.round(F.lit(0.2) + F.col("f") + F.col("_fo"), 9).alias("score"))
    )


def select_tmr_partners(targets: DataFrame, available: DataFrame, edges: DataFrame, width: int = 64) -> DataFrame:
    """Best pair of partners (partner_a < partner_b) per target (gpu_uuid), for any number of targets.

    score = .4 mutual + .2 (trust to a + trust to b) + .1 (bonus a + bonus b), so it is
    .4 mutual + f(a) + f(b) for a per-target device score f: .3 for devices never compared with
    the target, at most .25 for others. Ties go to the smallest names. All targets search one global order of
    edges (`_compared_pairs`, blocks from `width` on), or the lists of few devices that own all edges (`_owned_pairs`). Only where that gives at most .8, what two
    unknown devices that were never compared have, are such pairs looked for: first two unknown ones,
    and for targets without any, all.
    Targets with fewer than two other devices are left out; null names take no part.
    """
    t = cut(targets.select(F.col("gpu_uuid").alias("target")).filter("target is not null").distinct())
    devices = cut(positions(available.select(F.col("gpu_uuid").alias("gpu")).filter("gpu is not null").distinct(), ["gpu"], "seat"))
    n_devices = devices.count()
    names = devices.select("gpu")
    inside = edges.join(names.withColumnRenamed("gpu", "gpu_a"), "gpu_a").join(names.withColumnRenamed("gpu", "gpu_b"), "gpu_b")
    order = (-F.round(F.col("trust") * 0.4 + 2 * _UNKNOWN, 9)).alias("_order")
    ranked = cut(positions(inside.select("gpu_a", "gpu_b", "trust", order), ["_order", "gpu_a", "gpu_b"], "place"))
    known = both_ways(edges).join(t, F.col("src") == F.col("target")).join(devices, F.col("dst") == F.col("gpu")).select(
        "target", "gpu", "seat", F.round(F.col("trust") * 0.2 + F.lit(0.1) / (F.col("comparisons") + 1), 12).alias("f")
    )
    own = t.join(devices, F.col("target") == F.col("gpu")).select("target", "gpu", "seat", F.lit(None).cast("double").alias("f"))
    near = cut(known.unionByName(own))
    best = cut(_best(_compared_pairs(t, near, ranked, n_devices, width)))

    rest = cut(t.join(best.filter(F.col("score") > 0.2 + 2 * _UNKNOWN), "target", "left_anti"))
    if not rest.isEmpty():
        ways = both_ways(inside)
        unknown = cut(_unknown_pairs(rest, near, devices, ways, n_devices, width))
        best = best.unionByName(unknown)
        crowded = cut(rest.join(unknown, "target", "left_anti"))
        if not crowded.isEmpty():
            best = best.unionByName(_fresh_pairs(crowded, near, devices, ways, n_devices))
        best = _best(best)
    return best.select(F.col("target").alias("gpu_uuid"), F.col("gpu_a").alias("partner_a"), F.col("gpu_b").alias("partner_b"), "score")


def plan_canaries(states: DataFrame, edges: DataFrame, cfg: TrustConfig = TrustConfig(), seed: int = 0) -> DataFrame:
    """Targets of one interval with their partners: suspects first, then healthy devices
    in a seeded order, up to the configured count. Partners must be healthy. States and edges are read more than once, so they are written first."""
    states, edges = cut(states.select("gpu_uuid", "state")), cut(edges)
    ranked = states.filter(F.col("state").isin("SUSPECT", "HEALTHY")).orderBy(
        F.desc(F.col("state") == "SUSPECT"), F.xxhash64("gpu_uuid", F.lit(seed)), "gpu_uuid"
    )
    targets = cut(ranked.select("gpu_uuid", "state").limit(cfg.canaries_per_interval))
    healthy = states.filter("state = 'HEALTHY'").select("gpu_uuid")
    return targets.join(select_tmr_partners(targets, healthy, edges), "gpu_uuid")


def uncompared(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Of the given pairs (gpu_a, gpu_b), those never compared."""
    p = pairs.select(*_pair()).filter("gpu_a <> gpu_b").distinct()
    return p.join(edges.select("gpu_a", "gpu_b"), ["gpu_a", "gpu_b"], "left_anti")


def candidates(available: DataFrame, target: str) -> DataFrame:
    return available.filter(F.col("gpu_uuid") != target)
