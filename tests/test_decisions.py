import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.config import AMAZONHELP, brand_config
from ticketloom.functions import probability as P, prompts
from ticketloom.operators import calibrate, intents, language, metrics, pairs, policy
from ticketloom.plans import scoring

LEXICON = [("terrible", -3.0), ("great", 3.0)]


def decide(spark, *rows):
    """rows: (query, intent, confidence, turns, similarity)"""
    df = spark.createDataFrame(
        [(i, AMAZONHELP.id, *r) for i, r in enumerate(rows)],
        "id int, brand string, query string, predicted_intent string, confidence double, turn_count int, rag_similarity double",
    )
    dim = intents.intent_dim(spark, [AMAZONHELP])
    lexicon = spark.createDataFrame(LEXICON, "word string, valence double")
    ready = intents.with_eligibility(language.with_sentiment(df, "id", "query", lexicon), dim, "predicted_intent")
    return policy.escalation_policy(ready).orderBy("id").collect()


def test_ineligible_intent_escalates(spark):
    (r,) = decide(spark, ("My account is locked", "account_security_access", 0.95, 1, 1.0))
    assert r.should_escalate and "Security Policy" in r.escalation_reason and r.risk_level == "HIGH"


def test_first_listed_keyword_is_the_reason(spark):
    (r,) = decide(spark, ("This is fraud and my lawyer will be contacting you!", "order_tracking_delivery", 0.95, 1, 1.0))
    assert r.should_escalate and "lawyer" in r.escalation_reason and r.risk_level == "CRITICAL"


def test_safe_ticket_is_automatic(spark):
    (r,) = decide(spark, ("Where is my parcel?", "order_tracking_delivery", 0.92, 1, 0.88))
    assert not r.should_escalate and r.risk_level == "LOW"


def test_every_tier_once(spark):
    out = decide(
        spark,
        ("terrible terrible", "order_tracking_delivery", 0.9, 5, 0.9),
        ("hello", "order_tracking_delivery", 0.9, 3, 0.9),
        ("hello", "order_tracking_delivery", 0.69, 1, 0.9),
        ("hello", "order_tracking_delivery", 0.9, 1, 0.64),
        ("hello", "unknown", 0.7, 2, 0.65),
    )
    assert [r.tier for r in out] == ["sentiment", "turns", "confidence", "grounding", "auto"]
    assert "(0.69) below threshold (0.70)" in out[2].escalation_reason and "3 turns" in out[1].escalation_reason


def test_intents_belong_to_a_brand(spark):
    dim = spark.createDataFrame(
        [("a", "x", "X", 0, True), ("a", "y", "Y", 1, False), ("b", "y", "Y", 0, True), ("b", "z", "Z", 1, True)],
        "brand string, intent_id string, name string, ord int, auto_handle_eligible boolean",
    )
    df = spark.createDataFrame(
        [(1, "a", "y"), (2, "b", "y"), (3, "b", "x"), (4, "a", "nothing")], "id int, brand string, intent string"
    )
    eligible = {r.id: r.eligible for r in intents.with_eligibility(df, dim, "intent").collect()}
    assert eligible == {1: False, 2: True, 3: True, 4: True}
    assert {r.id: r.label_id for r in intents.label_index(df, dim, "intent").collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    valid = {r.id: r.valid_intent for r in intents.validate_intent(df, dim, "intent").collect()}
    assert valid == {1: "y", 2: "y", 3: "y", 4: "x"}


def test_sure_mistakes_count_in_the_focal_loss(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "p double")
    (r,) = df.agg(F.avg(calibrate.focal_loss("p")).alias("loss"), F.count(calibrate.focal_loss("p")).alias("n")).collect()
    assert r.n == 2 and r.loss == pytest.approx(-np.log(1e-12) / 2)


def test_unknown_brand_is_an_error():
    assert brand_config("AmazonHelp") is AMAZONHELP
    with pytest.raises(KeyError):
        brand_config("nobody")


def test_rules_pick_the_first_group(spark):
    df = spark.createDataFrame([("I want to CANCEL my order",), ("cancel it",), ("hello",)], "t string")
    out = [r.o for r in df.select(intents.rule_intent("t").alias("o")).collect()]
    assert out == ["order_tracking_delivery", "refund_return_cancellation", "general_feedback_complaint"]


def test_conformal_on_four_rows(spark):
    probs = [[0.9, 0.1], [0.85, 0.15], [0.95, 0.05], [0.8, 0.2]]
    df = spark.createDataFrame([(p, p[0]) for p in probs], "p array<double>, p_true double")
    q = calibrate.conformal_quantile(df, "p_true", 0.05).first().q_hat
    assert q <= 0.25
    out = policy.conformal_gate(df, "p", q).collect()
    assert all(r.prediction_set == [0] and r.auto_handle for r in out)
    empty = policy.conformal_gate(spark.createDataFrame([([0.5, 0.5],), ([],)], "p array<double>"), "p", q).collect()
    assert [(r.set_size, r.auto_handle) for r in empty] == [(0, False), (0, False)]


def test_quantile_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.random(400), np.full(250, 0.25), [0.0, 1.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for share in (0.0, 0.1, 0.33, 0.5, 0.951, 1.0):
        got = calibrate.interpolated_quantile(df, "v", share, len(values))
        assert got == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_cost_curve_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500), 2)
    esc = rng.random(500) < 0.3
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, esc)], "p double, e boolean")
    curve = calibrate.cost_curve(df, "p", "e")
    for r in curve.orderBy("t").collect():
        assert r.false_auto_handles == int((esc & (p >= r.t)).sum())
        assert r.false_escalations == int((~esc & ~(p >= r.t)).sum())
    best = calibrate.cost_threshold(curve).first()
    assert best.total_cost == min(r.total_cost for r in curve.collect())


def test_temperature_and_threshold_fits(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    z = rng.normal(size=(300, 3)) + 2.0 * np.eye(3)[y]
    df = spark.createDataFrame([(zz.tolist(), int(a)) for zz, a in zip(z * 3, y)], "z array<double>, y int")
    fit = calibrate.temperature_fit(df, "z", "y").first()

    def nll(t):
        s = z * 3 / t
        s = s - s.max(1, keepdims=True)
        return -np.mean(s[np.arange(300), y] - np.log(np.exp(s).sum(1)))

    grid = np.arange(0.05, 5.0001, 0.001)
    assert fit.temperature == pytest.approx(grid[np.argmin([nll(t) for t in grid])], abs=2e-3)
    probs = df.withColumn("p", P.softmax("z", 3.0)).cache()
    fitted, history = calibrate.class_threshold_fit(probs, "p", "y", 3)
    assert history == sorted(history) and all(0.1 <= t <= 0.9 for t in fitted)


def test_probability_helpers(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    r = df.select(
        P.argmax("p").alias("a"),
        P.threshold_argmax("p", [0.9, 0.9, 0.1]).alias("b"),
        P.threshold_argmax("p", [0.9]).alias("c"),
        P.secondary("p").alias("d"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == (0, 2, 0, [1, 2])


def test_metrics_count_absent_labels_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("x", "a")], "y string, p string")
    r = metrics.classification_metrics(df, "y", "p", ["a", "b", "c", "d"]).first()
    assert r.accuracy == 0.5
    assert r.macro_f1 == pytest.approx((0.5 + 2 / 3) / 4)
    assert r.weighted_f1 == pytest.approx((0.5 * 2 + 2 / 3) / 3)


def test_calibration_error_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.1, True), (0.30000000000000004, False), (0.0, True), (1.0, True)], "c double, ok boolean")
    assert {r.bin for r in metrics.reliability_table(df, "c", "ok").collect()} == {1, 3, 10}


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert metrics.cohen_kappa(df, "x", "y").first().kappa is None
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert metrics.cohen_kappa(df, "x", "y").first().kappa == pytest.approx(0.5)


def test_labelled_pairs_are_linear_and_correct(spark):
    df = spark.range(90).select("id", F.when(F.col("id") < 30, 0).when(F.col("id") < 89, 1).otherwise(2).alias("y"))
    out = pairs.labelled_pairs(df, "id", "y", 5).collect()
    label = {i: 0 if i < 30 else 1 if i < 89 else 2 for i in range(90)}
    assert all((label[r.a] == label[r.b]) == r.same and r.a != r.b for r in out)
    assert len(out) == len({(r.a, r.b) for r in out}) == 89 * 5 + 90 * 5


def test_text_baseline_beats_majority(spark):
    rows = [(i, "parcel late delivery" if i % 3 else "refund my money", "track" if i % 3 else "refund") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, query string, label string")
    out = scoring.text_logreg(df, df, "query", "label")
    assert out.filter("predicted_intent = label").count() == 60


def test_text_baseline_fits_in_as_many_partitions_as_cores(spark, monkeypatch):
    """Each step of the fit shuffles a gradient per partition, so these must not grow with the rows."""
    seen, fit = [], scoring.LogisticRegression.fit

    def spy(self, rows):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return fit(self, rows)

    monkeypatch.setattr(scoring.LogisticRegression, "fit", spy)
    rows = [(i, "parcel late delivery" if i % 3 else "refund my money", "track" if i % 3 else "refund") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, query string, label string").repartition(40)
    out = scoring.text_logreg(df, df, "query", "label")
    assert out.filter("predicted_intent = label").count() == 60
    assert seen == [(max(8, spark.sparkContext.defaultParallelism), 60)]


def test_end_to_end_ticket(spark):
    tickets = spark.createDataFrame(
        [(1, "amazonhelp", "Where is my package? The tracking link says delayed.", 1), (2, "amazonhelp", "zzz", 1)],
        "ticket_id long, brand string, query string, turn_count int",
    )
    corpus = spark.createDataFrame(
        [("p1", "amazonhelp", "Where is my package?", "Please check the tracking link of your package."),
         ("p2", "other", "Where is my package?", "Wrong brand.")],
        "passage_id string, brand string, customer_query string, historical_resolution string",
    )
    dim = intents.intent_dim(spark, [AMAZONHELP])
    lexicon = spark.createDataFrame(LEXICON, "word string, valence double")
    out = scoring.score_tickets(tickets, corpus, dim, lexicon, intents.rule_intent).orderBy("ticket_id").collect()
    assert [r.predicted_intent for r in out] == ["order_tracking_delivery", "general_feedback_complaint"]
    assert [c.passage_id for c in out[0].retrieved_context] == ["p1"] and out[1].retrieved_context == []
    assert all(len(r.draft_reply) > 10 and r.escalation_reason for r in out)
    assert out[1].should_escalate


def test_prompts_without_context(spark):
    df = spark.createDataFrame([("hi &amp; bye", "x", None)], "q string, i string, c string")
    text = df.select(prompts.draft_prompt(AMAZONHELP, "q", "i", "c").alias("o")).first().o
    assert "hi & bye" in text and prompts.NO_CONTEXT in text
    checked = prompts.draft_checks(
        spark.createDataFrame([("We refunded you, see https://amzn.to/help",), ("x" * 300,)], "r string"), "r", "https://amzn.to/help"
    ).collect()
    assert [(r.fits_length, r.has_action_link, r.has_promise) for r in checked] == [(True, True, True), (False, False, False)]


def test_sketches_of_parts_give_the_quantile_of_the_whole(spark, tmp_path):
    """Parts of unequal sizes and ranges, nulls, and no rows at all."""
    rng = np.random.default_rng(5)
    p = np.concatenate((rng.random(4000), rng.random(300) ** 8, [0.5] * 700))
    rows = [(float(x), "a" if i % 7 else None, int(i // 400)) for i, x in enumerate(p)] + [(None, "b", 1)]
    df = spark.createDataFrame(rows, "p double, brand string, day int")
    calibrate.score_sketches(df, "p", "brand", "day").write.partitionBy("day").parquet(f"file://{tmp_path}/s")
    stored = spark.read.parquet(f"file://{tmp_path}/s")
    scores = np.sort(1 - p)
    for alpha in (0.01, 0.1, 0.5):
        r = calibrate.sketched_quantile(stored, alpha).first()
        exact = calibrate.conformal_quantile(df.filter("p is not null"), "p", alpha).first()
        assert (r.n, r.level) == (len(p), pytest.approx(exact.level))
        low, high = (np.searchsorted(scores, r.q_hat, side) / len(p) for side in ("left", "right"))
        assert low - calibrate.SKETCH_ERROR <= r.level <= high + calibrate.SKETCH_ERROR
    some = calibrate.sketched_quantile(stored.filter("day = 2"), 0.1).first()
    assert some.n == 400
    assert calibrate.sketched_quantile(stored.filter("day = 99"), 0.1).count() == 0


def test_rollups_tell_a_null_key_from_a_total(spark):
    df = spark.createDataFrame(
        [("a", "t1", True), ("a", None, False), (None, "t1", True), (None, None, False)], "brand string, tier string, should_escalate boolean"
    )
    got = {(r.level, r.brand, r.tier, r.n, r.n_escalated) for r in policy.tier_rollup(df).collect()}
    assert got == {
        ("tier", "a", "t1", 1, 1), ("tier", "a", None, 1, 0), ("tier", None, "t1", 1, 1), ("tier", None, None, 1, 0),
        ("brand", "a", None, 2, 1), ("brand", None, None, 2, 1), ("total", None, None, 4, 2),
    }
    runs = spark.createDataFrame(
        [("v", "x", "x", True, True), ("v", None, "x", True, False), ("w", "x", "y", False, False)],
        "variant string, true_intent string, pred_intent string, true_escalate boolean, pred_escalate boolean",
    )
    levels = [r.level for r in metrics.variant_rollup(runs).collect()]
    assert sorted(levels) == ["both"] * 3 + ["intent"] * 2 + ["total"] + ["variant"] * 2
