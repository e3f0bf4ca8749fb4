import pytest

from tablewise.operators.claims import extract_facts, verify_claims

CASES = [
    ("Revenue rose 12.4% to $1.24M in 2025.", "Revenue 1238492, change 0.1241", []),
    ("In 2025, sales grew.", "1", []),
    ("Satisfaction falls 0.28 points per day.", "-0.28", []),
    ("About €54.3K came from Sydney.", "Sydney 54266", []),
    ("Perth averages 4.28 days, a gap of 106%, across 1,250 orders.", "4.28 2.08", ["106%", "1,250"]),
    ("Dune Sofa leads with $324K, 23.3% of revenue.", "324117.5, 248000, 0.233", []),
    ("Dune Sofa leads with $512K.", "324117.5, 248000, 0.233", ["$512K"]),
    ("No facts, but 12 rows and −3 apples and 77 pears.", "", ["77"]),
]


@pytest.mark.parametrize("ranges", [1, 4])
def test_cases(spark, ranges):
    answers = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "answer_id int, text string")
    results = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "answer_id int, note string")
    bad = verify_claims(answers, extract_facts(results, "answer_id"), ranges=ranges).orderBy("answer_id", "position").collect()
    got = {i: [r["token"] for r in bad if r["answer_id"] == i] for i in range(len(CASES))}
    assert got == {i: c[2] for i, c in enumerate(CASES)}


def test_facts(spark):
    df = spark.createDataFrame([(1, 2.5, float("nan"), True, "up 3K and -4%", None)], "k int, a double, b double, c boolean, d string, e string")
    assert sorted(r["value"] for r in extract_facts(df, "k").collect()) == [-4.0, 2.5, 3000.0]
