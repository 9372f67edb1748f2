"""Selection operators on small rows, against plain Python where the choice is a search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dedup, retrieval, selection
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def test_places_number_hot_groups_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 1, 1, 2, None]), k // 3, k) for k in range(300)]
    got = selection.places(spark.createDataFrame(rows, "g string, v int, s int, k int"), "g", ["v", "s"], ["k"]).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert {r["k"]: r["place"] for r in got if r["g"] == g} == {r[3]: i for i, r in enumerate(own, 1)}
    assert selection.places(spark.createDataFrame([], "g string, v int, k int"), "g", ["v"], ["k"]).count() == 0


def test_pairs_are_the_first_choice_of_all(spark):
    rng = random.Random(2)
    rows = [(s, p, rng.choice("abcdefgh"), rng.choice("abcdefgh"), p) for s in range(40) for p in range(rng.randint(0, 60))]
    rows += [(90, p, "hub", f"t{p}", p) for p in range(50)] + [(90, 60, "x", "y", 60), (90, 61, "z", "w", 61)]  # one text nearly everywhere
    rows += [(91, 0, "a", "b", 0), (91, 1, "a", "c", 1), (91, 2, "b", "d", 2), (91, 3, "e", "f", 3)]  # the best pair blocks two
    rows += [(92, 0, None, "b", 0), (92, 1, "", "c", 1), (92, 2, "b", "b", 2)]
    made = spark.createDataFrame(rows, "source int, pair int, a string, b string, o int")
    got = {}
    for r in selection.distinct_text_pairs(made, [F.col("o")], 3).orderBy("source", "place").collect():
        got.setdefault(r["source"], []).append(r["pair"])
    for source in {r[0] for r in rows}:
        own = [(r[1], {r[2], r[3]}) for r in rows if r[0] == source and r[2] and r[3] and r[2] != r[3]]
        want = next(([p for p, _ in c] for c in itertools.combinations(own, 3) if len(set.union(*(t for _, t in c))) == 6), None)
        assert got.get(source) == want
    assert got[91] == [1, 2, 3] and got[90] == [0, 60, 61]


def test_fill_raises_where_sources_run_out(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, id int")
    with pytest.raises(ValueError):
        selection.exclusive_fill(rows, "source", "id", {"x": 3, "y": 1})
    got = selection.exclusive_fill(rows, "source", "id", {"x": 1, "y": 1}, 1).collect()
    assert sorted(r["grp"] for r in got) == ["x", "y"] and len({r["source"] for r in got}) == 2


def test_forbidden_fields_at_any_depth(spark):
    assert selection.label_free(spark.createDataFrame([(1, "t")], "id int, text string")).count() == 1
    for schema in ("id int, Split string", "id int, x struct<y:array<struct<auc:double>>>", "id int, m map<string,struct<membership:int>>"):
        with pytest.raises(ValueError, match="forbidden"):
            selection.label_free(spark.createDataFrame([], schema))


def test_verdict_without_scores_is_unknown(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in selection.verdict(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5), F.lit(0)).items())).first()
    assert row["direction"] == "unknown"
    row = spark.range(1).select(*(c.alias(n) for n, c in selection.verdict(F.lit(0.8), F.lit(0.5), F.lit(0.6), F.lit(0)).items())).first()
    assert row["direction"] == "go"


def test_routes(spark):
    cands = spark.createDataFrame([(1, 0, 10, "date", None), (2, 0, 10, "ORG", None), (3, 0, 10, "odd", None), (4, 0, 10, "odd", "ORG"), (5, 0, 10, "ORG", None)], "cand int, start int, end int, declared string, rule string")
    seen = spark.createDataFrame([(2, "m", "PERSON", 0, 10, 0.9), (2, "m", "ORG", 0, 10, 0.8), (3, "m", "ORG", 5, 15, 0.9), (5, "m", "PERSON", 0, 10, 0.4)], "cand int, role string, label string, start int, end int, score double")
    got = {r["cand"]: (r["effective"], r["status"]) for r in selection.routed(cands, seen).collect()}
    assert got == {1: ("DATE", "accepted"), 2: ("PERSON", "rerouted"), 3: (None, "route_ambiguous"), 4: ("ORG", "accepted"), 5: ("ORG", "accepted")}


def test_vectors_are_of_length_one(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "doc int, text string")
    got = retrieval.embed(rows, "doc", "v").collect()
    assert [r["doc"] for r in got] == [1] and abs(sum(x * x for x in got[0]["v"]) - 1) < 1e-9


def test_matches_are_the_greedy_ones(spark):
    rng = random.Random(4)
    chunks = [(k, rng.choice("abc"), rng.randint(1, 30)) for k in range(60)]
    asks = [(q, s, rng.randint(1, 30), [rng.choice("abc")] if q else None) for q in range(20) for s in range(rng.randint(1, 4))] + [(50, s, 9, ["a", "b", "c"]) for s in range(2)]
    got = {}
    for r in selection.matched(spark.createDataFrame(chunks, "chunk int, source string, tokens int"), spark.createDataFrame(asks, "query int, slot int, wanted int, excluded array<string>"), 4).collect():
        got.setdefault(r["query"], {})[r["slot"]] = (r["chunk"], r["within"])
    want = {}
    for q in range(20):
        own, taken = sorted((a for a in asks if a[0] == q), key=lambda a: (-a[2], a[1])), []
        for _, slot, size, banned in own:
            taken.append(min((c for c in chunks if c[1] not in (banned or []) and c not in taken), key=lambda c: (abs(c[2] - size), c[0])))
        total = sum(a[2] for a in own)
        want[q] = {a[1]: (c[0], abs(sum(x[2] for x in taken) - total) / total <= 0.05) for a, c in zip(own, taken)}
    assert got == want


def test_matched_contexts_of_many_sizes(spark, tmp_path):
    """The query against its SQL where a source holds all near sizes, sizes repeat, and one is missing; no join of all pairs."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    rows = [(k, f"s{k // 400}" if k % 3 else f"s{rng.randrange(9)}", None if k == 77 else k if k < 1200 else rng.choice([5, 900, 901, 5000])) for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["matched_context"](spark, str(tmp_path))
    want = con.execute(registry.oracle_sql()["matched_context"]).fetchall()
    assert sorted(tuple(r) for r in got.select("query", "slot", "chunk", "tokens", "within").collect()) == sorted(want) and len(want) == 180
    assert selection.matched(spark.createDataFrame([(1, "a", 5)], "chunk int, source string, tokens int"), spark.createDataFrame([], "query int, slot int, wanted int, excluded array<string>"), 3).collect() == []
    many = spark.range(60_000).select(F.col("id").alias("query"), F.lit(1).alias("slot"), (F.col("id") % 50).alias("wanted"), F.array(F.lit("a")).alias("excluded"))
    assert selection.matched(spark.createDataFrame([(1, "b", 5), (2, "a", 9)], "chunk int, source string, tokens int"), many, 1).where("chunk = 1").count() == 60_000


# ---- queries without SQL


def frame(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def test_orders_within_budget(spark):
    want = {}
    for source, own in frame(spark, "orders").sort_values("o_orderkey").groupby("o_custkey"):
        taken, spent = [], 0
        for item, price in zip(own["o_orderkey"], own["o_totalprice"]):
            if spent + int(price) <= 200_000:
                taken.append(item)
                spent += int(price)
        want[source] = (taken, spent)
    got = registry.queries()["budget_knapsack"](spark, SF).collect()
    assert {r["source"]: (r["items"], r["spent"]) for r in got} == want


def test_three_facts_in_order_of_score(spark):
    items = frame(spark, "lineitem")
    want = set()
    for order, own in items.groupby("l_orderkey"):
        taken = []
        for x in own.sort_values(["l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey"], ascending=[False, True, True, True]).itertuples():
            if len(taken) < 3 and x.l_partkey not in [y.l_partkey for y in taken] and [y.l_suppkey for y in taken].count(x.l_suppkey) < 2:
                taken.append(x)
        if len(taken) == 3:
            want |= {(order, x.l_partkey, x.l_suppkey) for x in taken}
    got = registry.queries()["fact_topk_sequential"](spark, SF).toPandas()
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)


def test_sample_prefers_new_sources(spark):
    import hashlib

    rows = frame(spark, "documents")
    rows["h"] = [hashlib.sha256(f"42\0{d}".encode()).hexdigest() for d in rows["doc_id"]]
    rows["k"] = rows.sort_values("h").groupby("lang").cumcount() + 1
    seen, taken = set(), []
    for again in (False, True):
        for x in rows.sort_values(["k", "lang"]).itertuples():
            if len(taken) < 40 and x.doc_id not in taken and (again or x.source not in seen):
                seen.add(x.source)
                taken.append(x.doc_id)
    assert set(registry.queries()["distinct_source_sample"](spark, SF).toPandas()["doc_id"]) == set(taken)


def test_components_join_all_near_pairs(spark):
    pairs = dedup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").toPandas()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in zip(pairs["left"], pairs["right"]):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = registry.queries()["near_dup_components"](spark, SF).toPandas()
    assert len(pairs) and dict(zip(got["node"], got["component"])) == {x: find(x) for x in list(parent)}


def test_near_pairs_hold_all_copies_and_only_similar_texts(spark):
    import re
    import unicodedata

    docs = frame(spark, "documents")
    words = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in zip(docs["doc_id"], docs["text"])}
    sets = {d: {" ".join(k[i : i + 5]) for i in range(len(k) - 4)} or ({" ".join(k)} if k else set()) for d, k in words.items()}
    flat = {d: " ".join(unicodedata.normalize("NFKC", t or "").lower().split()) for d, t in zip(docs["doc_id"], docs["text"])}
    got = registry.queries()["near_dup_pairs"](spark, SF).toPandas()
    similar = got[got["method"] != "exact_normalized_hash"]
    for x in similar.itertuples():
        a, b = sets[x.left], sets[x.right]
        assert abs(x.jaccard - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-6 and x.jaccard >= 0.85 - 1e-8
    first = {}
    for d in sorted(flat):
        first.setdefault(flat[d], d)
    exact = got[got["method"] == "exact_normalized_hash"]
    assert set(zip(exact["left"], exact["right"])) == {(first[t], d) for d, t in flat.items() if first[t] != d}


def test_conformal_interval_holds_the_plain_rates(spark):
    from lodestone.operators import metrics

    rng = random.Random(3)
    rows = [(round(rng.gauss(1.5 if g == 1 else 0, 1), 1), g) for g in (0, 1, 2) for _ in range(150)]
    made = spark.createDataFrame(rows, "s double, g int")
    got = metrics.bootstrap_conformal(made, "s", F.col("g") == 0, F.col("g") == 1, 0.1, draws=400).first()
    reserve = [s for s, g in rows if g == 0]
    for g, name in ((1, "tpr"), (2, "fpr")):
        own = [s for s, h in rows if h == g]
        want = sum((1 + sum(r >= s for r in reserve)) / (1 + len(reserve)) <= 0.1 for s in own) / len(own)
        assert abs(got[name] - want) < 1e-6 and got[f"{name}_lower"] <= want <= got[f"{name}_upper"] and got[f"{name}_lower"] < got[f"{name}_upper"]
    with pytest.raises(ValueError):
        metrics.bootstrap_conformal(made.where("g < 2"), "s", F.col("g") == 0, F.col("g") == 1)


def test_strict_answers_guess_nothing(spark):
    from lodestone.functions import answers

    said = ['{"stance": "contradicted", "correction_entity": "X"}', '{"stance": "supported", "correction_entity": "X"}', "Inconsistent: a\nb ", "yes, it is", None, "{", "I do not know!"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(said)], "k int, r string")
    got = df.select("k", *(c.alias(n) for n, c in answers.strict_answer(F.col("r"), F.lit(False)).items())).orderBy("k").collect()
    assert [(r.parse_status, r.stance, r.correction) for r in got] == [
        ("parsed", "contradicted", "X"), ("invalid", None, None), ("parsed", "contradicted", "a\nb"), ("invalid", None, None), ("missing", None, None), ("invalid", None, None), ("parsed", "insufficient", None),
    ]
    assert [r[0] for r in df.select(answers.strict_answer(F.col("r"), F.lit(True))["parse_status"]).collect()] == ["generator_error"] * 7
