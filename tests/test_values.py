"""Golden values of scalars and small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import claims, stance
from lodestone.functions import text as X
from lodestone.operators import dedup, entities, metrics, retrieval, scoring, textudf


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_mail(spark):
    mail = "Message-ID: <1>\nX-Origin: a\nFrom: b@c.d\n\n---- Forwarded by Ann ----\nThe contract was signed on March 12, 2022.\n-- \nAnn"
    assert one(spark, X.clean_mail(F.lit(mail))) == "The contract was signed on March 12, 2022."


def test_article_and_dispatch(spark):
    text = "Result <b>x</b> holds.  Further studies are needed\n\n\n\nEnd\nReferences\n1. A"
    assert one(spark, X.clean_for(F.lit("PubMed"), F.lit(text))) == "Result x holds.\n\nEnd"
    assert one(spark, X.clean_for(F.lit("other"), F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("text, kind, n", [("paid $1,200.50 and 5 million", "money", 2), ("on Jan 5, 2020 or 2020-01-05", "date", 2), ("12% or 3.5 percent", "percent", 2), ("Acme Widgets Inc won", "org", 1), ("a@b.com", "email", 1), ("500 mg for 3 days", "medical_value", 2), ("the Effective Date", "contract_term", 1), ("café 12", "numeric", 1)])
def test_entity_patterns(spark, text, kind, n):
    assert one(spark, X.entity_counts(F.lit(text))[kind]) == n


def test_template(spark):
    rows = spark.createDataFrame([("All rights reserved.",), ("All rights reserved $5 and 3%",), ("a\nb\na\na\nA\nc",), ("a\nb\nc\nd\ne\na",), ("  ",), ("plain",)], "text string")
    n = X.perturbable(X.entity_counts(F.col("text")))
    assert [r[0] for r in rows.select(X.is_template(F.col("text"), n)).collect()] == [True, False, True, False, True, False]


def test_windows_and_ngrams(spark):
    assert one(spark, X.word_windows(F.lit("a b c d e f g"), 4, 1)) == ["a b c d", "d e f g"]
    assert one(spark, X.word_windows(F.lit(""), 4, 1)) == []
    assert one(spark, X.word_windows(F.lit("a"), 4, 1)) == ["a"]
    assert one(spark, X.shingles(F.array(*map(F.lit, "abc")), 5)) == ["a b c"]
    assert one(spark, X.containment(F.array(*map(F.lit, "abcde")), F.array(*map(F.lit, "xabcd")), 2)) == 0.75
    assert one(spark, X.copied_run(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "axbca")))) == 3


def test_scalars(spark):
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, X.span_overlap(F.lit(0), F.lit(10), F.lit(5), F.lit(9))) == 1.0
    assert one(spark, X.redact_literal(F.lit("A.b axb"), F.lit("a.B"))) == "[REDACTED] axb"
    assert one(spark, X.slug(F.lit(" Ab c/d "))) == "ab-c-d"
    assert one(spark, X.mailbox_user(F.lit("ann\\inbox\\1"))) == "ann"
    assert one(spark, X.atomic_claims(F.lit("- One. Two!\n2) three"))) == ["One.", "Two!", "three"]


def scored(spark, pos, neg):
    return spark.createDataFrame([(float(x), True) for x in pos] + [(float(x), False) for x in neg], "s double, y boolean")


def test_auc(spark):
    y = F.col("y")
    assert metrics.auc(scored(spark, [1, 0], [0, -1]), "s", y).first().auc == 0.875
    assert metrics.auc(scored(spark, [1], [1]), "s", y).first().auc == 0.5
    assert metrics.auc(scored(spark, [1, float("nan")], [0]), "s", y).first().auc is None
    assert metrics.auc(scored(spark, [1], []), "s", y).first().auc is None
    rng = np.random.default_rng(0)
    p, n = rng.integers(0, 40, 300) / 7, rng.integers(0, 30, 200) / 7
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (300 * 200)
    assert metrics.auc(scored(spark, p, n), "s", y).first().auc == pytest.approx(want, abs=1e-6)


def test_operating_point(spark):
    points = metrics.curve(scored(spark, [1, 0.5], [0.4, 0.1]), "s", F.col("y"))
    best = metrics.operating_point(points, 0.0).first()
    assert (best.tpr, best.fpr) == (1.0, 0.0)
    ends = {r.threshold: (r.tpr, r.fpr) for r in points.collect()}
    assert ends[float("-inf")] == (1.0, 1.0) and ends[float("inf")] == (0.0, 0.0)


def test_conformal(spark):
    rows, ref = spark.createDataFrame([(1.0,), (0.0,), (2.0,)], "s double"), spark.createDataFrame([(1.0,), (1.0,)], "s double")
    got = metrics.against_reference(rows, ref, "s").withColumn("p", metrics.conformal_p(rows)).withColumn("m", metrics.midrank_percentile())
    assert {r.s: (round(r.p, 6), r.m) for r in got.collect()} == {1.0: (1.0, 0.5), 0.0: (1.0, 0.0), 2.0: (0.333333, 1.0)}


def test_intervals(spark):
    low, high = metrics.clopper_pearson(0, 200)
    assert low == 0 and 0 < high < 0.03
    assert [metrics.eligible_lower_bound(n, 1000, x) for n, x in ((5210, 623), (35000, 89), (47950, 66))] == [3125, 2618, 2574]
    assert metrics.index_tensor(1, 1, 1000).ravel()[:10].tolist() == [89, 773, 654, 438, 433, 858, 85, 697, 201, 94]
    assert one(spark, F.round(metrics.wilson_lower(F.lit(8), F.lit(10)), 4)) == 0.4902
    assert one(spark, metrics.normal_cdf(F.lit(0.0))) == 0.5


def test_kappa(spark):
    same = spark.createDataFrame([("a", "a")] * 4, "x string, y string")
    assert metrics.kappa(same, "x", "y").first().kappa is None
    mixed = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert metrics.kappa(mixed, "x", "y").first().kappa == 0.5


def test_bm25_counts_a_query_term_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "the zephyrbiomarker report")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "beta alpha beta"), ("b", "alpha beta"), ("c", "Which report contains zephyrbiomarker?")], "query string, text string")
    got = {(r.query, r.doc): r.score for r in retrieval.bm25(docs, asked).collect()}
    assert got[("a", 1)] == got[("b", 1)]
    assert [k for k in got if k[0] == "c"] == [("c", 3)]


def test_fusion_and_knapsack(spark):
    rank = spark.createDataFrame([("q", 1, 2), ("q", 2, 1)], "query string, doc long, rank int")
    got = {r.doc: r.score for r in retrieval.fuse([rank, rank.where("doc = 1")]).collect()}
    assert got[1] > got[2]
    items = spark.createDataFrame([("s", 1, 5), ("s", 2, 9), ("s", 3, 4)], "source string, item long, cost long")
    row = scoring.knapsack(items, 10).first()
    assert row["items"] == [1, 3] and row.spent == 9


def test_complete_sources(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("c", "3"), ("d", "9")], "source string, h string")
    assert sorted(r.source for r in dedup.complete_sources(rows, "source", F.col("h")).collect()) == ["a", "c", "d"]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)], "left long, right long")
    got = {r.node: r.component for r in dedup.components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in (90, 95, 100)} == {90}


def test_stance(spark):
    rows = spark.createDataFrame([("Yes, correct.", "true", "12,000"), ("That is wrong, it is 12000", "counterfactual", "12,000"), ('{"status": "unknown"}', "true", "x"), ("I cannot disclose it", "true", "x"), ("hm", "true", "x"), ("it is Bob", "counterfactual", "x")], "r string, c string, o string")
    got = [r[0] for r in rows.select(stance.flags(F.col("r"), F.col("c"), F.col("o"), F.lit("bob"))["stance"]).collect()]
    assert got == ["supports_true_claim", "corrects_counterfactual", "unknown", "refuses", "unrelated", "accepts_counterfactual"]


def test_text_functions():
    assert textudf.canonical("  Café\tACME  ") == "café acme"
    assert textudf.common_run("a b c d".split(), "x b c y".split()) == 2
    assert textudf.masked("Acme  Corp and acme corp.", ["Acme Corp"]) == "{ENTITY} and {ENTITY}."
    assert textudf.strict_object('{"b":1,"a":2}') == '{"a":2,"b":1}'
    assert [textudf.strict_object(x) for x in ('{"a":1,"a":2}', '{"a":NaN}', "[1]", None)] == [None] * 4
    assert textudf.bleu4("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)
    assert textudf.propositions("One. Two!\nThree") == [(0, 4, "One."), (5, 9, "Two!"), (10, 15, "Three")]


def test_chunks():
    paragraph = "A sentence of some length is here. " * 8
    chunks = textudf.paragraph_chunks("\n\n".join([paragraph.strip()] * 9))
    assert all(200 <= len(c) <= 3000 for c in chunks) and len(chunks) == 3
    assert textudf.paragraph_chunks("short") == [] and textudf.paragraph_chunks(None) == []
    assert all(len(c) <= 300 for c in textudf.paragraph_chunks("x" * 5000, 10, 300, 100))
    # a run's first sentence is counted with the blank after it, unless it was what didn't fit before
    assert textudf.paragraph_chunks("aaaaaaaa. bbbbbbbbb. cccc.", 1, 20, 20) == ["aaaaaaaa.", "bbbbbbbbb. cccc."]


@pytest.mark.parametrize("value, kind, new", [("$1,000", "MONEY", "$1,050"), ("3.5%", "PERCENT", "3.68%"), ("March 12, 2022", "DATE", "April 11, 2022"), ("3:00 PM", "TIME", "4:00 PM"), ("noon", "TIME", "1:00 PM"), ("1 day", "DURATION", "2 days"), ("a@b.c", "EMAIL", "alternate.contact@b.c"), ("www.x.org/a", "URL", "www.x.org/a/archive"), ("555-123-9998", "PHONE", "555-123-0005"), ("Section 3.2", "SECTION_ID", "Section 3.3"), ("Case A-009", "IDENTIFIER", "Case A-010")])
def test_changed_values(spark, value, kind, new):
    got = spark.createDataFrame([(value, kind)], "v string, k string").select(entities.changed_value("v", "k")).first()[0]
    assert got == new
    assert got != value


@pytest.mark.parametrize("value, kind, medium, new", [("1,234.50", "NUMERIC_VALUE", False, "1,296.23"), ("1", "NUMERIC_VALUE", False, "2"), ("none", "MONEY", False, "none"), ("2021-12-30", "DATE", True, "2022-02-28"), ("1/5/2020", "DATE", False, "02/04/2020"), ("13:30", "TIME", False, "14:30"), ("11 pm", "TIME", False, "12 AM"), ("someday 4", "DATE", False, "someday 5"), ("4 weeks", "DURATION", True, "6 weeks"), ("2099", "YEAR", False, "2098"), ("2001", "YEAR", True, "2003"), ("alternate.contact@b.c", "EMAIL", False, "verified.contact@b.c"), ("x", "EMAIL", False, "x.alt"), ("https://x.org/a/archive/?q=1#f", "URL", False, "https://x.org/a/archive-v2?q=1#f"), ("ID AB", "IDENTIFIER", False, "ID ABC"), ("ID 7-", "IDENTIFIER", False, "ID 8-"), (None, "MONEY", False, None)])
def test_changed_values_at_the_edges(spark, value, kind, medium, new):
    assert spark.createDataFrame([(value, kind)], "v string, k string").select(entities.changed_value("v", "k", medium)).first()[0] == new


def test_picked_values(spark):
    pool = ["Northfield Group", "Harbor Bank"]
    rows = spark.createDataFrame([("HARBOR BANK",), ("Northfield Group",), ("Other",)], "v string")
    got = [r[0] for r in rows.select(entities.pick(F.col("v"), pool)).collect()]
    assert got[:2] == ["Northfield Group", "Harbor Bank"] and got[2] in pool


@pytest.mark.parametrize("value, kind, want", [("J. Doe", "PERSON", "initialed_person_name"), ("dr Doe", "PERSON", "titled_person_name"), ("Doe", "person", "single_person_name"), ("Ann Doe", "PERSON", "multi_token_person_name"), ("Acme Inc.", "ORG", "corporate_organization"), ("State University", "ORG", "academic_or_medical_organization"), ("Energy Agency", "ORG", "government_organization"), ("Paris, France", "LOCATION", "compound_geographic_location"), ("the Hague", "LOCATION", "definite_article_location"), ("Model 5", "PRODUCT", "versioned_or_numbered_product"), ("NASA", "PROJECT_NAME", "acronym_project_name"), ("Manhattan", "PROJECT_NAME", "titled_project_name"), ("lease of land", "CONTRACT_TERM", "named_agreement"), ("pension plan", "CONTRACT_TERM", "contractual_plan_or_policy"), ("notice", "CONTRACT_TERM", "defined_contract_term"), ("5", "MONEY", "money"), ("5", "", "unknown")])
def test_subtypes(spark, value, kind, want):
    assert spark.createDataFrame([(value, kind)], "v string, k string").select(claims.subtype(F.col("v"), F.col("k"))).first()[0] == want


def test_case_styles_and_forms(spark):
    values = ["ABC 1", "abc", "New York City", "New york", "12-3", "McDonald"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r[0] for r in rows.orderBy("i").select(claims.case_style(F.col("v"))).collect()] == ["upper", "lower", "title", "mixed", "no_letters", "title"]
    pairs = [("New York City", "Old Town Hall", "PRODUCT", True), ("New York City", "New york", "PRODUCT", False), ("A. B", "C D", "PERSON", False), ("A. B", "C D", "ORG", True), ("A, B", "C D", "ORG", False), ("the A", "B", "MONEY", False), ("A 1", "B", "MONEY", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, k string, want boolean")
    assert rows.where(claims.compatible(F.col("a"), F.col("b"), F.col("k")) != F.col("want")).count() == 0


def test_spans_do_not_overlap():
    found = entities.spans("On March 12, 2022 Acme Widgets Inc paid $1,200 to a@b.com for 3 days.")
    assert [x["type"] for x in found] == ["DATE", "ORG", "MONEY", "EMAIL", "MEDICAL_VALUE"]
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


def test_copies_late_in_a_turn(spark, tmp_path):
    from lodestone.plans import registry

    rows = [("c", 0, "a" * 200 + "the copied part " * 20), ("c", 1, "b" * 200 + "the copied part " * 20)]
    spark.createDataFrame(rows, "conv_id string, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert registry.queries()["lexical_copy_turns"](spark, str(tmp_path)).first().ratio == round(320 / 520, 6)


def test_distinct_source_sample_reaches_rare_sources(spark, tmp_path):
    import hashlib
    import random

    from lodestone.plans import registry

    rng = random.Random(6)
    rows = [(k, rng.choice("abc"), f"s{rng.randrange(30)}" if rng.random() < 0.02 else "most") for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    order, n = [], {}
    for _, d, lang, source in sorted((hashlib.sha256(f"42\0{d}".encode()).hexdigest(), d, lang, source) for d, lang, source in rows):
        n[lang] = n.get(lang, 0) + 1
        order.append((n[lang], lang, d, source))
    seen, taken = set(), []
    for again in (False, True):
        for _, _, d, source in sorted(order):
            if len(taken) < 40 and d not in taken and (again or source not in seen):
                seen.add(source)
                taken.append(d)
    assert sorted(r.doc_id for r in registry.queries()["distinct_source_sample"](spark, str(tmp_path)).collect()) == sorted(taken)
