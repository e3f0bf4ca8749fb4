import pytest
from pyspark.sql import functions as F

from tablewise.meta import ColumnMeta
from tablewise.operators.aggregate import AggSpec, aggregate, default_agg, grain_for_span
from tablewise.operators.findings import discover
from tablewise.operators.infer import apply_types, infer_schema, match_scale, unit_of
from tablewise.operators.joins import candidate_pairs
from tablewise.operators.profile import build_profile
from tablewise.plans.analyses import ANALYSES, register_analysis, run, run_package
from tablewise.plans.steps import History, Step, apply_steps, auto_clean, preview_step


@pytest.fixture(scope="module")
def retail(spark):
    """Messy shop rows: missing prices, label variants, duplicates, one impossible quantity, a planted return rate."""
    rows = []
    for i in range(400):
        region = ["North", "South", "East", "West"][i % 4]
        region = region.lower() if i % 45 == 0 else region
        product = ["Lamp", "Sofa", "Chair"][i % 3]
        returned = "Yes" if (i % 4 == 3 and i % 3 == 2 and i % 2) or i % 37 == 0 else "No"
        price = None if i % 25 == 0 else 20 + (i * 7) % 90 + (40 if product == "Sofa" else 0)
        rows.append((f"ORD-{i}", f"{1 + i % 28:02d}/{1 + (i // 34) % 12:02d}/2025" if i % 99 else "TBC", region, product, None if price is None else f"${price}.50",
                     str(-3 if i == 200 else 1 + i % 5), returned, ["Disagree", "Neutral", "Agree", "Strongly agree", "Strongly disagree"][(i * i) % 5]))
    rows += rows[:10]
    return spark.createDataFrame(rows, "order_id string, order_date string, region string, product string, revenue string, units string, returned string, opinion string").cache()


def test_types(retail):
    metas = {m.name: m for m in infer_schema(retail)}
    assert {n: m.type for n, m in metas.items()} == {
        "order_id": "id", "order_date": "date", "region": "category", "product": "category", "revenue": "number", "units": "number", "returned": "category", "opinion": "category"}
    assert metas["revenue"].unit == "$" and metas["order_date"].invalid > 0 and metas["opinion"].likert
    assert metas["opinion"].order[0] == "Strongly disagree"


def test_profile_rules(retail):
    metas = infer_schema(retail)
    p = build_profile(apply_types(retail, metas), metas)
    assert p.duplicates == 10 and p.inconsistent == {"region": 1} or p.inconsistent["region"] >= 1
    kinds = {(i["issue"], i["column"]) for i in p.issues}
    assert {("dup", None), ("miss", "revenue"), ("inc", "region"), ("neg", "units"), ("inv", "order_date")} <= kinds
    assert p.roles["measure"] == "revenue" and p.roles["date"] == "order_date" and "product" in p.roles["dims"]
    assert 0 < p.health["score"] < 100
    assert [i["severity"] for i in p.issues] == sorted((i["severity"] for i in p.issues), key=["critical", "warning", "info"].index)


def test_auto_clean(retail):
    metas = infer_schema(retail)
    done, steps, left = auto_clean(apply_types(retail, metas), metas, order_by=["order_id"])
    assert {"drop_duplicates", "fill_missing", "text_clean", "negative_to_missing"} <= {s.op for s in steps}
    assert done.count() == 400 and done.where("revenue is null").count() == 0
    assert done.select("region").distinct().count() == 4


def test_discover_and_packages(retail):
    metas = infer_schema(retail)
    typed = apply_types(retail, metas)
    found = {r["id"]: r for r in discover(typed, metas).collect()}
    assert "quality" in found and "combo" in found and any(i.startswith("anova_product") for i in found)
    out = run_package(typed, "stats", metas)
    assert set(out) == {"compare", "crosstab", "correlation", "regression"} and out["crosstab"].count() == 1


def test_analyses_by_name(retail):
    metas = infer_schema(retail)
    typed = apply_types(retail, metas)
    profile = build_profile(typed, metas)
    for name in ("describe", "distribution", "outliers", "group", "compare", "crosstab", "timeseries", "change", "survey", "quality"):
        assert run(typed, name, {}, metas, profile).count() > 0
    with pytest.raises(ValueError):
        run(typed, "no such analysis", {}, metas, profile)
    with pytest.raises(ValueError):
        run(typed, "group", {"by": "no such column"}, metas, profile)
    register_analysis("rows", lambda df, params: df.agg(F.count(F.lit(1)).alias("n")))
    assert run(typed, "rows", {}, metas, profile).first()["n"] == 410
    del ANALYSES["rows"]


def test_history(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "k int, v double")
    h = History(df).apply("fill_missing", col="v", method="mean").apply("filter", col="v", op=">", value=2.5)
    assert [r["v"] for r in h.current().orderBy("k").collect()] == [3.0, 4.0]
    assert h.undo().current().count() == 3 and h.undo().redo().current().count() == 2 and h.revert_to(0).current().where("v is null").count() == 1
    out, log = apply_steps(df, [Step("rename", {"col": "zz", "to": "a"}), Step("drop_missing", {"cols": ["v"]})])
    assert out.count() == 2 and log[0]["error"] and log[1]["error"] is None
    seen = preview_step(df, "k", "fill_missing", col="v", method="value", value="9")
    assert seen["rows"].first().asDict() == {"before": 3, "after": 3, "changed": 1} and seen["sample"].first()["after"] == "9.0"


def test_small_rules(spark):
    assert match_scale(["Agree", "Disagree"])[0] == ("Disagree", "Agree")
    assert match_scale(["Agree", "Disagree"], full_scale=True)[0][0] == "strongly disagree"
    assert match_scale(["1st year", "Postgraduate"]) == (("1st year", "Postgraduate"), False)
    assert match_scale(["Agree", "Perhaps"]) is None
    assert unit_of("discount_pct", 10, 0, 0, [0] * 6) == "%" and unit_of("total_eur_cost", 10, 0, 0, [0] * 6) == "€"
    assert [grain_for_span(d) for d in (2191, 913, 76, 21, 20, None)] == ["year", "quarter", "month", "week", "day", "month"]
    df = spark.createDataFrame([(5, 1.5, 3), (2, 2.5, 20)], "stars int, revenue double, units int")
    assert [default_agg(df, c) for c in ("stars", "revenue", "units", None)] == ["mean", "sum", "sum", "count"]
    assert aggregate(df.where("false"), AggSpec(metrics=(("revenue", "sum"),))).count() == 0
    a = spark.createDataFrame([(1, "x")], "customer_id int, region string")
    b = spark.createDataFrame([(1, "x")], "customer int, Region string")
    assert candidate_pairs({"a": a, "b": b}) == [("a", "customer_id", "b", "customer"), ("a", "region", "b", "Region")] or candidate_pairs({"a": a, "b": b})[-1][1] == "region"
    assert isinstance(ColumnMeta("a", "number").with_(unit="$"), ColumnMeta)
