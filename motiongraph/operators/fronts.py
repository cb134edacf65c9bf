"""Least-cost fronts from seeds, their meetings, and the ways back.

Fronts grow bucket by bucket: a round relaxes what improved below the current
limit of cost, and the limit moves on by ``delta`` once nothing below it moves
(delta stepping), so a place far from the seeds is not relaxed again and again
on its way to its final cost. Each place keeps the next HELD places of the way it
was reached by. Ways of more are read off in strides of HELD, by doubling: with
the 1st, 2nd, 4th, ... stride of each place a way of L places takes log2 L joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import FEW, checkpointed, dealt_by, released, shuffle_partitions

KEYS = ("scan_id",)
#: Places of its way that a place knows, so that ways are read off in steps of as many.
HELD = 16


def grow(links: DataFrame, seeds: DataFrame, keys: Sequence[str] = KEYS, cover: float = 1.0, delta: float | None = None, most_rounds: int | None = None) -> DataFrame:
    """(keys, place, dist, label, prev): least cost from the nearest seed, the seed (the smaller one on ties), the place before.

    links (keys, a, b, w >= 0) lead from a to b; seeds (keys, node_id). prev is
    null at seeds. Fronts stop when nothing changes, or at the first limit below
    which the share ``cover`` of the places is settled; what is not settled then
    is left out. delta is by default four times the mean cost of a link. Rounds
    beyond ``most_rounds`` are an error. Links that cost more than the cheapest
    one from a seed to their end are left out from the start, as no way over them
    can be the least. links is read more than once.
    """
    return _grown(links, seeds, keys, cover, delta, most_rounds).select(*keys, "place", "dist", "label", F.get("up", F.lit(0)).alias("prev"))


#: What is known of a place: least cost, seed, places on the way, the next of them, least value on it.
KNOWN = ("dist", "label", "depth", "up", "low")


def _merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tables, dealt by place, in one; places of the new one are as they are there."""
    at = (*keys, "place")
    kept = old.join(new.select(*at), [*at], "left_anti")
    return checkpointed(dealt_by(kept.select(*at, *KNOWN).union(new.select(*at, *KNOWN)), *at))


def _grown(
    links: DataFrame, seeds: DataFrame, keys: Sequence[str], cover: float, delta: float | None, most_rounds: int | None, values: DataFrame | None = None, held: int = 1, both: bool = False
) -> DataFrame:
    """A table (keys, place, dist, label, depth, up, low) dealt by place, see grow().

    depth is the number of places after this one on its way, up the next of them, at
    most ``held``, low the least of values (keys, place, ctvalue) on it. both: links
    hold both directions. Links and places are dealt by place once. A round keeps what
    became better in a table of its own, which is merged with the one before once it
    is half as large, so only the news of a round are shuffled, to the places they are for.
    """
    at = (*keys, "place")
    ways = links.select(*keys, F.col("a").cast("long").alias("place"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")).dropna()
    if delta is None:
        delta = 4 * (ways.agg(F.avg("w")).first()[0] or 0.25)
    places = ways.select(*at).union(ways.select(*keys, "b")).distinct().count() if cover < 1 else None
    if values is not None:
        values = checkpointed(dealt_by(values.select(*at, F.col("ctvalue").alias("own")), *at))
    valued = lambda df: df.withColumn("own", F.lit(None).cast("double")) if values is None else df.join(values, [*at], "left")
    ways = ways.repartition(shuffle_partitions(links.sparkSession), *at)
    first = valued(seeds.select(*keys, F.col("node_id").cast("long").alias("place")).dropna().distinct())
    # the first round: from the seeds to the places next to them
    start = lambda to, w: F.struct(w.alias("dist"), F.col("place").alias("label"), F.col("own").alias("low")).alias("m")
    near = ways.join(first, [*at]).select(*keys, "b", start("b", F.col("w"))).unionByName(first.select(*keys, F.col("place").alias("b"), start("place", F.lit(0.0))))
    near = near.groupBy(*keys, "b").agg(F.min("m").alias("m")).select(*keys, F.col("b").alias("place"), "m.*")
    far = F.col("label") != F.col("place")
    near = valued(near).select(*at, "dist", "label", far.cast("int").alias("depth"), F.when(far, F.array("label")).otherwise(F.array().cast("array<bigint>")).alias("up"), F.least("low", "own").alias("low"))
    state = [checkpointed(dealt_by(near, *at))]
    size = [state[0].count()]
    # a way meets its end; where links hold both directions, it is dealt there turned round
    into = ways.select(*keys, F.col("b").alias("place"), F.col("place").alias("b"), "w") if both else ways
    most = state[0].select(*keys, F.col("place").alias("b"), F.col("dist").alias("most"))
    ways = checkpointed(dealt_by(into.join(most, [*keys, "b"], "left").filter("most IS NULL OR w <= most").select(*at, "b", "w"), *at))
    news, spent, limit, rounds = state[0].filter("depth > 0"), None, delta, min(1, size[0])
    while True:
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError("fronts still move")
        due = news.filter(F.col("dist") < limit)
        n = due.count()
        if not n:  # all below is settled, and nothing beyond has gone on yet
            while len(state) > 1:
                new, old = state.pop(), state.pop()
                state.append(_merged(old, new, keys))
                released(old, new)
            size, spent = [state[0].count()], None
            later = state[0].filter(F.col("dist") >= limit)
            waiting = later.agg(F.min("dist")).first()[0]
            if waiting is None:
                released(ways, *([] if values is None else [values]))
                return state[0]
            if places is not None and state[0].filter(F.col("dist") < limit).count() >= cover * places:
                return state[0].filter(F.col("dist") < limit)
            limit = (waiting // delta + 1) * delta
            limit = limit if limit > waiting else waiting + delta
            due = later.filter(F.col("dist") < limit)
            n = due.count()
        rounds += 1
        due = F.broadcast(due) if n <= FEW else due.hint("shuffle_hash")
        step = due.join(ways, [*at])
        # a place is reached anew only at less cost or by a smaller seed, so pointers never go in a circle
        new = F.struct((F.col("dist") + F.col("w")).alias("dist"), "label", F.slice(F.concat(F.array("place"), "up"), 1, held).alias("up"), (F.col("depth") + 1).alias("depth"), "low")
        best = step.select(*keys, "b", new.alias("m")).groupBy(*keys, "b").agg(F.min("m").alias("m")).select(*keys, F.col("b").alias("place"), "m")
        for i, table in enumerate(state):
            best = best.join(table.select(*at, F.struct("dist", "label").alias(f"s{i}")), [*at], "left")
        now = F.coalesce(*[F.col(f"s{i}") for i in reversed(range(len(state)))])
        best = best.filter(now.isNull() | (F.struct("m.dist", "m.label") < now)).select(*at, *[f"m.{c}" for c in KNOWN])
        news = checkpointed(dealt_by(valued(best).select(*at, *KNOWN[:-1], F.least("low", "own").alias("low")), *at))
        released(*([spent] if spent is not None else []))
        spent = news
        if not (n := news.count()):
            continue
        state.append(news)
        size.append(n)
        while len(size) > 1 and 2 * size[-1] >= size[-2]:
            new, old = state.pop(), state.pop()
            state.append(_merged(old, new, keys))
            size[-2:] = [sum(size[-2:])]
            released(old, *([new] if new is not news else []))
        spent = news if state[-1] is not news else None


def ways_back(state: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, way, back, place): the places from each start (keys, way, place), back = 0, to its seed."""
    found = checkpointed(starts.select(*keys, "way", F.lit(0).cast("long").alias("back"), "place"))
    hops, jump = [], checkpointed(state.filter("prev IS NOT NULL").select(*keys, "place", F.col("prev").alias("far")))
    while not jump.isEmpty():  # the ancestors 1, 2, 4, ... steps up
        hops.append(jump)
        jump = checkpointed(jump.join(jump.select(*keys, F.col("place").alias("far"), F.col("far").alias("farther")), [*keys, "far"]).select(*keys, "place", F.col("farther").alias("far")))
    for k in reversed(range(len(hops))):
        on = found.join(hops[k], [*keys, "place"]).select(*keys, "way", (F.col("back") + (1 << k)).alias("back"), F.col("far").alias("place"))
        found = checkpointed(found.unionByName(on))
    return found


def link_seeds(
    links: DataFrame, seeds: DataFrame, keys: Sequence[str] = KEYS, cover: float = 1.0, delta: float | None = None, values: DataFrame | None = None, most_rounds: int | None = None, paths: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Edges between seeds where their fronts meet (keys, n1, n2, cost, ctvalue), and their ways (keys, n1, n2, idx, place).

    links (keys, a, b, w) hold both directions. Of all links between the fronts of
    two seeds the one whose dearer end cost least makes the edge, its cost that
    of the dearer end. The way leads from seed n1 over the link to seed n2, and
    ctvalue is the least of values (keys, place, ctvalue) on it, null without.
    The ways are None without ``paths``.
    """
    state = _grown(links, seeds, keys, cover, delta, most_rounds, values, HELD if paths else 1, True)
    end = lambda p: state.select(*keys, F.col("place").alias(p), *[F.col(c).alias(c + p) for c in ("label", "dist", "depth", "low")])
    met = links.filter("a < b").select(*keys, "a", "b").join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).filter("labela <> labelb")
    side = lambda c, p, q: F.when(F.col("labela") < F.col("labelb"), F.col(c + p)).otherwise(F.col(c + q)).alias(c or p)
    met = met.select(*keys, side("label", "a", "b").alias("n1"), side("label", "b", "a").alias("n2"), F.greatest("dista", "distb").alias("cost"), side("", "a", "b"), side("", "b", "a"), side("depth", "a", "b"), F.least("lowa", "lowb").alias("ctvalue"))
    best = F.min(F.struct("cost", "a", "b", *(["depth"] if paths else []), "ctvalue")).alias("m")
    edge = checkpointed(met.groupBy(*keys, "n1", "n2").agg(best).select(*keys, "n1", "n2", "m.*"))
    found = edge.select(*keys, "n1", "n2", "cost", "ctvalue")
    if not paths:
        released(state)
        return found, None
    way = lambda own, end, at: edge.select(*keys, F.struct("n1", "n2", F.lit(own).alias("own"), at.alias("at")).alias("way"), F.col(end).alias("place"))
    starts = way(1, "a", F.col("depth")).unionByName(way(2, "b", F.col("depth") + 1))
    long = F.col("depth") > HELD
    strides = starts.withColumn("back", F.lit(0)) if state.filter(long).isEmpty() else ways_back(state.select(*keys, "place", F.when(long, F.get("up", F.lit(HELD - 1))).alias("prev")), starts, keys)
    run = F.concat(F.array("place"), F.when(long, F.slice("up", 1, HELD - 1)).otherwise(F.col("up")))
    back = strides.join(state.select(*keys, "place", run.alias("run")), [*keys, "place"]).select(*keys, "way", "back", F.posexplode("run").alias("k", "place")).withColumn("back", F.col("back") * HELD + F.col("k"))
    # from seed n1 forward to the link, then from the link on to seed n2
    idx = F.col("way.at") + F.when(F.col("way.own") == 1, -F.col("back")).otherwise(F.col("back"))
    return found, back.select(*keys, "way.n1", "way.n2", idx.cast("long").alias("idx"), "place")
