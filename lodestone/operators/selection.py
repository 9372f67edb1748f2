"""Choice of rows under constraints: places in large groups, fills, pairs with distinct texts, votes, guards on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lodestone.functions import text as X

# fixed values: columns that a selection may not see, and the types that routing knows
FORBIDDEN = (
    "membership", "membership_label", "member_label", "split", "group", "victim_response", "victim_answer", "rag_response", "llm_only_response", "llm_only_answer",
    "retriever_output", "retrieval_rank", "retrieval_score", "retrieved_documents", "attack_score", "attack_auc", "auc", "v22_calibration_label", "v22_calibration_threshold",
)
MAIN_TYPES = ("CONTRACT_TERM", "LOCATION", "ORG", "PERSON", "PRODUCT")
STRUCTURED_TYPES = ("DATE", "MONEY", "EMAIL", "PHONE", "IDENTIFIER")
DIAGNOSTIC_TYPES = ("PROJECT_NAME",)


def places(rows: DataFrame, within: str, levels: list[str], order: list[str]) -> DataFrame:
    """Adds place: the row number within `within`, in order of the levels, then of `order`, without a task that sorts a group.

    Rows are numbered within the finest level; the counts of what comes before are added level by level. The levels cut the
    order into ranges small enough for a task; null keys are keys."""
    keys = [within, *levels]
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    for k in reversed(range(len(levels))):
        of = keys[: k + 2]
        if k < len(levels) - 1:
            counts = counts.groupBy(*of).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(Window.unboundedPreceding, -1)
        ahead = counts.select(*(F.col(c).alias(f"_{c}") for c in of), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of))
        numbered = numbered.join(ahead, same).withColumn("place", F.col("place") + F.col("_ahead")).drop("_ahead", *(f"_{c}" for c in of))
    return numbered


def exclusive_fill(rows: DataFrame, source: str, key: str, targets: dict[str, int], cap: int | None = None, salt: str = "42") -> DataFrame:
    """source, key, grp: groups filled one after another with whole sources in order of hash, at most `cap` rows of a source.

    What a source holds beyond the cap or the open places goes to no group, so that no source is in two. Each source fills a
    place or more, hence the first sum(targets) sources are enough. Raises ValueError where the rows don't fill the groups."""
    sources = rows.groupBy(source).agg(F.count("*").alias("n")).withColumn("n", F.least("n", F.lit(cap or 2**62)))
    rest = sources.withColumn("h", X.hash_rank(salt, F.col(source))).orderBy("h", source).limit(sum(targets.values()))
    parts = []
    for name, target in targets.items():
        before = F.coalesce(F.sum("n").over(Window.orderBy("h", source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the limited sources
        rest = rest.withColumn("before", before)
        parts.append(rest.where(F.col("before") < target).select(source, F.lit(name).alias("grp"), F.least("n", F.lit(target) - F.col("before")).alias("take")))
        rest = rest.where(F.col("before") >= target).drop("before")
    taken = reduce(DataFrame.unionByName, parts)
    filled = {r["grp"]: r["n"] for r in taken.groupBy("grp").agg(F.sum("take").alias("n")).collect()}  # a row a group
    if missing := {g: n - filled.get(g, 0) for g, n in targets.items() if filled.get(g, 0) < n}:
        raise ValueError(f"too few rows of own sources: {missing}")
    own = rows.select(source, key).join(F.broadcast(taken), source)
    rank = F.row_number().over(Window.partitionBy(source).orderBy(X.hash_rank(salt, F.col(key)), key))
    return own.withColumn("_k", rank).where("_k <= take").select(source, key, "grp")


def distinct_text_pairs(pairs: DataFrame, order: list[Column], k: int) -> DataFrame:
    """source, pair, place: for each source the k pairs first in order whose 2k texts all differ; no row for sources without.

    pairs: (source, pair, a, b). A pair of a missing, empty or twice the same text can't be chosen. The first choice in
    lexicographic order uses of each text only its 2k - 1 first pairs: with a later one, k - 1 others occupy 2k - 2 texts, so
    an earlier pair of that text would be free. Its last pair is then within the first 2(k-1)(2k-1) + 1 of those. So what is
    searched is bounded, and nothing is lost by it."""
    least = pairs.where("a <> b AND a <> '' AND b <> ''").withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).withColumn("o", F.struct(*order))
    edges = least.groupBy("source", "x", "y").agg(F.min(F.struct("o", "pair")).alias("e"))
    ends = edges.select("source", "e", F.explode(F.array("x", "y")).alias("t")).withColumn("d", F.row_number().over(Window.partitionBy("source", "t").orderBy("e"))).where(F.col("d") <= 2 * k - 1)
    both = ends.groupBy("source", "e").agg(F.sort_array(F.collect_list("t")).alias("texts")).where("size(texts) = 2")
    few = both.withColumn("p", F.row_number().over(Window.partitionBy("source").orderBy("e"))).where(F.col("p") <= 2 * (k - 1) * (2 * k - 1) + 1)
    held = few.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("p", "e.pair", "texts"))).alias("edges"))
    sets = F.transform("edges", lambda e: F.struct(e["p"].alias("last"), F.array(e["pair"]).alias("chosen"), e["texts"].alias("used")))

    def extended(s):
        free = F.filter("edges", lambda e: (e["p"] > s["last"]) & ~F.arrays_overlap(e["texts"], s["used"]))
        return F.transform(free, lambda e: F.struct(e["p"].alias("last"), F.array_append(s["chosen"], e["pair"]).alias("chosen"), F.concat(s["used"], e["texts"]).alias("used")))

    held = held.withColumn("sets", sets)
    for _ in range(k - 1):
        held = held.withColumn("sets", F.flatten(F.transform("sets", extended)))
    return held.where("size(sets) > 0").select("source", F.posexplode(F.get("sets", F.lit(0))["chosen"]).alias("place", "pair")).withColumn("place", F.col("place") + 1)


def diverse_choice(candidates: DataFrame) -> DataFrame:
    """source, pair, template: of each source with three pairs the joint choice of one candidate each, best in its weakest part.

    candidates: (source, pair, template, opening, auxiliary, entailment, similarity, containment, run, fidelity, words). The
    templates and the openings must differ, and not all auxiliaries be the same. Choices are ranked by the least entailment,
    the least similarity, the greatest containment and run (less is better), the least fidelity, the fewest words, then by
    templates. A pair has a candidate for each template of a fixed list, so that a source has few choices."""
    three = candidates.groupBy("source").agg(F.sort_array(F.collect_set("pair")).alias("ids")).where("size(ids) = 3")
    rows = candidates.join(three, "source").withColumn("slot", F.array_position("ids", F.col("pair")))
    names = [c for c in candidates.columns if c != "source"]
    sides = [rows.where(F.col("slot") == i).select("source", F.struct(*names).alias(f"c{i}")) for i in (1, 2, 3)]
    joint = sides[0].join(sides[1], "source").join(sides[2], "source")
    each = lambda n: [F.col(f"c{i}")[n] for i in (1, 2, 3)]
    (t1, t2, t3), (o1, o2, o3), (a1, a2, a3) = each("template"), each("opening"), each("auxiliary")
    joint = joint.where((t1 != t2) & (t1 != t3) & (t2 != t3) & (o1 != o2) & (o1 != o3) & (o2 != o3) & ~((a1 == a2) & (a2 == a3)))
    rank = F.struct(F.least(*each("entailment")), F.least(*each("similarity")), -F.greatest(*each("containment")), -F.greatest(*each("run")), F.least(*each("fidelity")), -reduce(Column.__add__, each("words")), t1, t2, t3)
    best = joint.groupBy("source").agg(F.max_by(F.array(*(F.struct(F.col(f"c{i}.pair").alias("pair"), F.col(f"c{i}.template").alias("template")) for i in (1, 2, 3))), rank).alias("best"))
    return best.select("source", F.inline("best"))


def routed(candidates: DataFrame, predictions: DataFrame, votes: int = 1, overlap: float = 0.8, least: float = 0.5) -> DataFrame:
    """cand, declared, effective, status: structured and diagnostic types stay, then a rule decides, then the roles' votes, then
    the declared type where it is known; else the route is ambiguous.

    candidates: (cand, start, end, declared, rule); predictions: (cand, role, label, start, end, score), recorded beforehand.
    A role has one vote: its best prediction that covers the candidate; of labels with as many votes the first wins."""
    seen = predictions.where(F.col("label").isin(*MAIN_TYPES) & (F.col("score") >= least)).select("cand", "role", "label", "score", F.col("start").alias("s"), F.col("end").alias("e"))
    near = candidates.select("cand", "start", "end").join(seen, "cand").where(X.span_overlap(F.col("start"), F.col("end"), F.col("s"), F.col("e")) >= overlap)
    vote = near.groupBy("cand", "role").agg(F.min_by("label", F.struct(-F.col("score"), "label", "s")).alias("label"))
    winner = vote.groupBy("cand", "label").agg(F.count("*").alias("n")).where(F.col("n") >= votes).groupBy("cand").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("voted"))
    declared, fixed = F.upper("declared"), STRUCTURED_TYPES + DIAGNOSTIC_TYPES
    known = F.when(declared.isin(*MAIN_TYPES), declared)
    rows = candidates.join(winner, "cand", "left").select("cand", declared.alias("declared"), F.when(declared.isin(*fixed), declared).otherwise(F.coalesce("rule", "voted", known)).alias("effective"), "rule")
    status = F.when(F.col("effective").isNull(), "route_ambiguous").when(F.col("rule").isNotNull() | F.col("declared").eqNullSafe(F.col("effective")), "accepted").otherwise("rerouted")
    return rows.select("cand", "declared", "effective", status.alias("status"))


def proposals(predictions: DataFrame, existing: DataFrame, threshold: Column, votes: int = 2) -> DataFrame:
    """doc, label, start, end, models, confidence: spans that enough models predict alike and that aren't candidates yet."""
    at = ["doc", "label", "start", "end"]
    same = predictions.where(F.col("label").isin(*MAIN_TYPES) & (F.col("score") >= threshold)).groupBy(*at).agg(F.count_distinct("model").alias("models"), F.round(F.avg("score"), 6).alias("confidence"))
    return same.where(F.col("models") >= votes).join(existing.select(*at), at, "left_anti")


def _nearest_rows(rows: DataFrame, within: list, source: str, order: list, k: int, m: int) -> DataFrame:
    """Of the rows of each group the first m in order, of which a source has k at most."""
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*within, source).orderBy(*order))).where(F.col("_k") <= k)
    return own.withColumn("_k", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_k") <= m).drop("_k")


def matched(candidates: DataFrame, targets: DataFrame, k: int, tolerance: float = 0.05, ranges: int = 512) -> DataFrame:
    """query, slot, chunk, tokens, within: for each slot of a query, from the largest, the candidate of the nearest size that is
    left (of equals the least chunk; one without a size comes last); within says whether all of them together are as large as
    the slots, to a tolerance.

    candidates: (chunk, source, tokens), each chunk of one size and source; targets: (query, slot, wanted, excluded), at most k
    slots a query, excluded the sources that it may not draw from. A slot chooses among its k nearest, since the others take
    k - 1 of them at most. Queries that run out of candidates get none.

    Candidates and slots never meet in all their pairs. Where a slot excludes e sources at most, its k nearest are among the
    first (e + 1) k candidates to each side that hold k of a source at most. So many are kept of each size; sizes are cut into
    ranges of about equally many candidates, each range is given that many of the nearest below and above it, and a slot looks
    through the range of its size only, which is held as an array: its length is the candidates kept by the ranges."""
    m = k * (1 + (targets.agg(F.max(F.coalesce(F.greatest(F.size("excluded"), F.lit(0)), F.lit(0)))).first()[0] or 0))
    rows = _nearest_rows(candidates.select("chunk", "source", "tokens").distinct(), ["tokens"], "source", ["chunk"], k, m)
    edges = sorted(set(rows.agg(F.percentile_approx("tokens", F.array(*(F.lit(x / ranges) for x in range(1, ranges))), F.lit(20 * ranges))).first()[0] or []))
    # the range of a size: how many edges are less; -1 without a size
    of = lambda x: F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else 0)
    rows = rows.withColumn("range", of(F.col("tokens")))
    every = targets.select(of(F.col("wanted")).alias("range")).distinct()
    near = rows.where("range >= 0")
    for side, order in ((F.col("range") < F.col("_of"), F.desc("tokens")), (F.col("range") > F.col("_of"), F.asc("tokens"))):
        held = _nearest_rows(rows.where("range >= 0"), ["range"], "source", [order, "chunk"], k, m)
        beside = held.join(F.broadcast(every.withColumnRenamed("range", "_of").where("_of >= 0")), side)
        near = near.unionByName(_nearest_rows(beside, ["_of"], "source", [order, "chunk"], k, m).drop("range").withColumnRenamed("_of", "range"))
    # candidates without a size, for all; for slots without one the least chunks
    near = near.unionByName(rows.where("range < 0").drop("range").crossJoin(F.broadcast(every)))
    near = near.unionByName(_nearest_rows(rows.where("range >= 0").withColumn("range", F.lit(-1)), ["range"], "source", ["chunk"], k, m).select(near.columns))
    lists = near.groupBy("range").agg(F.collect_list(F.struct("tokens", "chunk", "source")).alias("near"))

    def gap(c):
        away = F.abs(c["tokens"] - F.col("wanted"))
        return F.struct(away.isNull().alias("unknown"), away.alias("gap"), c["chunk"].alias("chunk"), c["tokens"].alias("tokens"))

    free = lambda c: ~F.coalesce(F.array_contains("excluded", c["source"]), F.lit(False))
    near = targets.withColumn("range", of(F.col("wanted"))).join(lists, "range")
    near = near.select("query", "slot", "wanted", F.explode(F.slice(F.array_sort(F.transform(F.filter("near", free), gap)), 1, k)).alias("c"))
    slots = near.groupBy("query", "slot", "wanted").agg(F.array_sort(F.collect_list("c")).alias("own"))
    rows = slots.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("wanted")).alias("w"), "slot", "own"))).alias("slots"))
    rows = rows.join(targets.groupBy(F.col("query").alias("of")).agg(F.count("*").alias("n")), F.col("query") == F.col("of")).where("size(slots) = n")
    none = F.filter(F.transform("slots", lambda s: s["own"][0]), lambda c: F.lit(False))

    def take(chosen, s):
        return F.array_append(chosen, F.get(F.filter(s["own"], lambda c: ~F.exists(chosen, lambda x: x["chunk"] == c["chunk"])), F.lit(0)))

    rows = rows.withColumn("x", F.aggregate("slots", none, take)).where(~F.exists("x", lambda c: c.isNull()))
    total = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0).cast("long"), lambda t, v: t + v.cast("long"))
    wanted = -total("slots", lambda s: s["w"])
    gap = F.abs(total("x", lambda c: c["tokens"]) - wanted) / F.greatest(F.lit(1), wanted)
    pairs = F.inline(F.zip_with("slots", "x", lambda s, c: F.struct(s["slot"].alias("slot"), c["chunk"].alias("chunk"), c["tokens"].alias("tokens"))))
    return rows.select("query", (gap <= tolerance).alias("within"), pairs)


def label_free(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """The rows, if no column or field at any depth of their schema has a forbidden name in either case; else ValueError."""

    def walk(kind: DataType, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                if f.name.lower() in forbidden:
                    raise ValueError(f"forbidden field {path}.{f.name}")
                walk(f.dataType, f"{path}.{f.name}")
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            walk(kind.keyType, f"{path}[]")
            walk(kind.valueType, f"{path}[]")

    walk(rows.schema, "root")
    return rows


def verdict(auc: Column, baseline: Column, shortcut: Column, shared: Column) -> dict[str, Column]:
    """Five rules on a score's AUC, that of a baseline, the best separability of plain features, and the sources on both sides."""
    rules = {"separates": auc > 0.6, "baseline_flat": baseline <= 0.6, "gains": auc - baseline > 0.05, "no_shortcut": shortcut < auc - 0.02, "no_leak": shared == 0}
    known = auc.isNotNull() & baseline.isNotNull()
    every = reduce(Column.__and__, (F.coalesce(r, F.lit(True)) for r in rules.values()))
    return rules | {"direction": F.when(~known, "unknown").when(every, "go").otherwise("no_go")}
