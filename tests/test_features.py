from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.functions import features
from larkspur.functions.keywords import match_keywords, top_matching_keywords
from larkspur.functions.text import has_text, stripped
from larkspur.operators.validation import assemble, checked, split, strict, with_defaults


def test_sentiment_band(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, None)], "r int").select("r", features.sentiment_band(F.col("r"))).collect()
    assert [x[1] for x in rows] == ["Negative", "Negative", "Neutral", "Positive", "Positive", None]


def test_text_exists_and_strip(spark):
    given = [None, "", " ", " ", "\t", "\x1c", "a", " a "]
    rows = spark.createDataFrame([(x,) for x in given], "t string").select("t", has_text(F.col("t")).alias("h"), stripped(F.col("t")).alias("s")).collect()
    assert [r.h for r in rows] == [bool(x and x.strip()) for x in given]
    assert [r.s for r in rows] == [x.strip() if x is not None else None for x in given]


def plain_match(text, keywords, most):
    """The ranked match, said plainly."""
    if not text or not text.strip() or not keywords:
        return []
    found = []
    for k in keywords:
        if k and k.strip():
            m = re.search(r"\b" + re.escape(k) + r"\b", text, re.IGNORECASE)
            if m:
                found.append((m.start(), k))
    return [k for _, k in sorted(found, key=lambda x: x[0])][:most]


CASES = [
    (None, ["a"]), ("   ", ["a"]), ("text", None), ("text", []), ("I love the Necklace", ["necklace"]), ("packages arrived", ["package"]),
    ("customer support was fast", ["fast", "customer", "customer support"]), ("a b c d", ["d", "c", "b", "a"]), ("a a", ["a", "a"]), ("x", [None, "", " ", "x"]),
    ("I know C++ well", ["C++"]), ("see a.b here, not aXb", ["a.b", "aXb"]), (r"odd \E end", [r"\E", "end"]), ("#sale now", ["#sale", "sale"]),
    ("café café cafe", ["cafe", "café"]), ("\U0001f600 the end", ["end", "the"]), ("naïve ÉCOLE", ["école"]),
]


def both_forms(spark, cases, most=3):
    df = spark.createDataFrame(cases, "t string, k array<string>")
    return [r[0] for r in df.select(top_matching_keywords(F.col("t"), F.col("k"), F.lit(most))).collect()]


def test_keyword_cases(spark):
    assert both_forms(spark, CASES) == [plain_match(t, k, 3) for t, k in CASES]


def test_keyword_fuzz(spark):
    cases = []

    @settings(max_examples=300, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="ab é_.#-'1 ", max_size=20), st.lists(st.text(alphabet="abé_.#1 ", max_size=4), max_size=5))
    def gather(t, k):
        cases.append((t, k))

    gather()
    assert both_forms(spark, cases) == [plain_match(t, k, 3) for t, k in cases]


def test_keyword_forms_agree(spark):
    texts = [(i, t) for i, (t, _) in enumerate(CASES)]
    words = ["a", "the", "customer", "customer support", "end", "C++"]
    reviews = spark.createDataFrame(texts, "review_id int, review string")
    got = {r.review_id: r.keywords for r in match_keywords(reviews, spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")).collect()}
    assert got == {i: plain_match(t, words, 3) for i, t in texts}


def test_length_settings(spark):
    got = {(r.ai_response_length_type, r.has_text): (r.word_limit, r.keyword_count, r.temperature, r.max_tokens) for r in features.length_settings(spark).collect()}
    assert got[("Concise", True)] == (50, 2, 0.8, 70) and got[("Elaborate", False)] == (80, 3, 0.75, 200) and len(got) == 6


def test_token_line(spark):
    rows = [(None, None, None), ("1", "", None), (None, "a@b", None), (None, None, "w"), ("1", "a@b", "w")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, e string, w string").select(features.token_line(F.col("c"), F.col("e"), F.col("w"))).collect()]
    assert got == ["", "Contact Number: 1", "Support Email: a@b", "Website: w", "Contact Number: 1, Support Email: a@b, Website: w"]


def test_contact_call(spark):
    df = spark.createDataFrame([(r, c) for r in range(1, 6) for c in (None, "5")], "r int, c string")
    got = [x[0] for x in df.select(features.contact_call(F.col("r"), features.has_contact(F.col("c"), F.lit(None).cast("string")))).collect()]
    assert got[::2] == [""] * 5 and got[1] == got[3] != got[5] != got[7] == got[9] != ""


def test_exposed_keywords(spark):
    df = spark.createDataFrame([(b, m) for b in ("Negative", "Neutral", "Positive") for m in ([], ["x", "y"])], "b string, m array<string>")
    rows = df.select(features.exposed_keywords(F.col("b"), F.col("m")), features.sentiment_section(F.col("b"), F.col("m"))).collect()
    assert [r[0] for r in rows] == [[], [], [], ["x"], [], ["x", "y"]]
    assert "x" not in rows[1][1].split() and "used: x." in rows[3][1] and "used: x, y." in rows[5][1]


def record(**changes):
    base = {"review_id": 1, "business_name": "B", "reviewer_name": "R", "rating": 5, "review": "fine", "ai_response_length_type": "Default"}
    return base | changes


def test_validation(spark):
    given = [record(), record(rating=0), record(rating=6), record(rating=None), record(reviewer_name=None), record(ai_response_length_type="concise")]
    df = spark.createDataFrame([tuple(x.values()) for x in given], "review_id int, business_name string, reviewer_name string, rating int, review string, ai_response_length_type string")
    assert [r.reject_reason for r in checked(df).collect()] == [None, "rating out of range", "rating out of range", "missing rating", "missing reviewer_name", "unknown length type"]
    good, bad = split(df)
    assert good.count() == 1 and bad.count() == 5
    with pytest.raises(Exception, match="rating out of range|missing|unknown"):
        strict(df).collect()


def test_assembly_and_defaults(spark):
    reviews = spark.createDataFrame([(1, "R", 4), (2, "S", 3)], "business_id int, reviewer_name string, rating int")
    businesses = spark.createDataFrame([(1, "B"), (2, "C")], "business_id int, business_name string")
    keywords = spark.createDataFrame([(1, ["k"])], "business_id int, approved_keywords array<string>")
    rows = {r.business_id: r for r in assemble(reviews, businesses, keywords).collect()}
    assert rows[1].approved_keywords == ["k"] and rows[2].approved_keywords == [] and rows[1].ai_response_length_type == "Default" and rows[1].signature is None
    assert with_defaults(reviews).columns[-1] == "website_url"
