from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.operators import diagnostics, responder
from larkspur.operators.validation import with_defaults
from larkspur.plans import experiment, review_prompt, variant_prompt, wording

KIND = "review_id int, reviewer_name string, rating int, review string, ai_response_length_type string, business_name string, approved_keywords array<string>, signature string, contact_number string, support_email string, website_url string"
BASE = (1, "Ann", 5, "I love this necklace, well packaged; great customer support and delivery", "Default", "Gem House", ["delivery", "packaged", "necklace", "customer support"], "The team", "555", "help@x.org", None)


def request(spark, **changes):
    names = [x.split()[0] for x in KIND.split(", ")]
    row = tuple(changes.get(n, v) for n, v in zip(names, BASE, strict=True))
    return review_prompt.requests(spark.createDataFrame([row], KIND)).first()


def test_review_prompt_sections_in_order(spark):
    p = request(spark).prompt
    places = [p.index(x) for x in (wording.GUARDRAILS, wording.TONE_MENU, "used: necklace, packaged, customer support.", "Review Text: ", "Rating: 5", "Reviewer Name: Ann", "Business Name: Gem House", "at most 80 words", wording.FORMATTING, "Contact Number: 555, Support Email: help@x.org", "The team")]
    assert places == sorted(places) and "we, us and our" in p and "{" not in p


def test_review_prompt_without_text_or_support(spark):
    p = request(spark, review=None, rating=4, signature=None, contact_number="", support_email=None).prompt
    assert "Review Text:" not in p and "Rating: 4" in p and p.endswith(wording.FORMATTING)


def test_negative_shows_no_keywords(spark):
    p = request(spark, rating=1).prompt
    assert wording.NEGATIVE in p and "used:" not in p


@pytest.mark.parametrize(("kind", "tokens", "words"), [("Concise", 70, 50), ("Elaborate", 200, 150)])
def test_length_types(spark, kind, tokens, words):
    r = request(spark, ai_response_length_type=kind)
    assert r.max_tokens == tokens and f"at most {words} words" in r.prompt


def variant_row(spark, v, **changes):
    given = {"business_name": "Gem {rating}", "reviewer_name": "Ann", "rating": 5, "review": "odd {signature} text", "response_length": 80, "tone": "Conversational", "client_instructions": "", "keyword1": "", "keyword2": "", "contact_number": "", "website_url": "", "signature": ""} | changes
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'int' if isinstance(x, int) else 'string'}" for k, x in given.items()))
    return variant_prompt.render(df.crossJoin(variant_prompt.variants(spark, (v,)))).first().prompt


def test_variants_differ_in_their_pieces_alone(spark):
    a, b, c = (variant_row(spark, v) for v in (variant_prompt.LOCKED, variant_prompt.GROUNDED, variant_prompt.EXTRACTION))
    assert b.replace(wording.GROUNDING + "\n\n", "") == a
    assert c.replace(wording.EXTRACTION + "\n\n", "").replace(wording.GUIDE_HIGH_EXTRACTED, wording.GUIDE_HIGH) == a
    assert "odd {signature} text" in a and "Gem {rating}" in a


def test_variant_options(spark):
    assert variant_row(spark, variant_prompt.LOCKED, tone="Grumpy") is None
    menu = variant_row(spark, variant_prompt.DEFAULT, tone="Grumpy")
    assert [menu.index(f"{t}:\n") for t in wording.TONES] == sorted(menu.index(f"{t}:\n") for t in wording.TONES) and wording.RULES_TONE in menu
    full = variant_row(spark, variant_prompt.LOCKED, client_instructions="  be brief\n", keyword1="k", contact_number="1", website_url="w", signature="s", rating=2)
    places = [full.index(x) for x in ("Client Instructions:\nbe brief\n", "Customer Information", "Keyword List:\nk\n", "Contact Number: 1, Website URL: w", wording.CONTACT_EARLY, "signature:\ns")]
    assert places == sorted(places)
    assert "Client" not in variant_row(spark, variant_prompt.LOCKED, client_instructions=" \n") and "Review Text: \n" in variant_row(spark, variant_prompt.LOCKED, review="")


def test_sample_is_repeatable_and_refuses_small_tables(spark):
    rows = spark.range(100).withColumnRenamed("id", "review_id")
    one, eight = (experiment.seeded_sample(rows.repartition(n)).collect() for n in (1, 8))
    assert sorted(one) == sorted(eight) and sorted(r.seq for r in one) == list(range(30))
    with pytest.raises(Exception, match="fewer than 30"):
        experiment.seeded_sample(rows.limit(5)).collect()


def test_experiment_and_errors(spark):
    rows = spark.createDataFrame([(f"N{i}", i % 5 + 1, None if i % 3 else "good") for i in range(40)], "reviewer_name string, rating int, review string")

    def flaky():
        def answer(request):
            if request["rating"] == 1:
                raise responder.ReplyError("http", "503: busy")
            return "Thank you, it was good"

        return answer

    out = experiment.run(rows, "B", flaky, tasks=2).collect()
    assert len(out) == 60 and {r.variant_ord for r in out} == {0, 1}
    assert all((r.response == "ERROR: 503: busy") == (r.rating == 1) == (r.status == "http") for r in out)
    assert {r.review for r in out} == {"", "good"}


def test_payloads_and_decoding(spark):
    df = spark.createDataFrame(
        [('{"choices":[{"message":{"content":" hi\\n"}}]}', '{"content":[{"type":"text","text":" a"},{"type":"tool","text":"x"},{"type":"text"},{"type":"text","text":"b "}]}'), ('{"choices":[]}', '{"content":[]}'), ("{}", "{}"), ("not json", "not json")],
        "a string, b string",
    )
    got = [tuple(r) for r in df.select(responder.decode_choices(F.col("a")), responder.decode_blocks(F.col("b"))).collect()]
    assert got == [("hi", "ab"), (None, ""), (None, None), (None, None)]


def test_http_responder_statuses():
    made = responder.choices_provider("http://127.0.0.1:9/none", None)
    with pytest.raises(responder.ReplyError) as e:
        made({"prompt": "x"})
    assert e.value.status == "no_credential"
    made = responder.choices_provider("http://127.0.0.1:9/none", "key")
    with pytest.raises(responder.ReplyError) as e:
        made({"prompt": "x"} | dict.fromkeys(("model", "frequency_penalty", "presence_penalty", "temperature", "max_tokens")))
    assert e.value.status == "network"


def test_generate_replies_offline(spark):
    df = with_defaults(spark.createDataFrame([(1, "Ann", 5, "fine", "B")], "review_id int, reviewer_name string, rating int, review string, business_name string"))
    a, b = (responder.generate_replies(df, responder.Offline, tasks=1).first() for _ in range(2))
    assert a == b and a.status == "ok" and a.response


REPLIES = [
    ("v", 1, "Hello, x"), ("v", 2, "!!! x"), ("v", 3, "  "), ("v", 4, "Hi there, thanks"), ("v", 5, "Hello. Thanks"), ("v", 6, "hi " + "x" * 26 + " thank"), ("v", 7, " hi thank"), ("v", 8, "history thank"),
    ("v", 9, "ERROR: x"), ("v", 10, "Error: x"), ("v", 11, None), ("w", 12, "ERROR"),
]


def replies(spark):
    return spark.createDataFrame(REPLIES, "variant string, seq int, response string").selectExpr("*", "3 AS rating", "response AS review")


def test_diagnostics(spark):
    s = {r.variant: r for r in diagnostics.summary(replies(spark)).collect()}
    assert (s["v"].n, s["v"].errors, s["v"].m, s["v"].greet, s["v"].null_count) == (11, 1, 10, 1, 1)
    assert s["v"].opening_share == 0.3 and s["v"].min_len == 0 and (s["w"].m, s["w"].opening_share, s["w"].mean_len) == (0, None, None)
    opens = [(r.word, r.n) for r in diagnostics.opening_words(replies(spark)).orderBy("variant", "rank").collect()]
    assert opens[:2] == [("hi", 3), ("hello", 2)] and ("", 1) in opens and len(opens) == 6
    text = diagnostics.report(replies(spark))
    assert text.index("== v: 11 rows, 1 failed ==") < text.index("== w: 1 rows, 1 failed ==") and "No replies to analyse." in text


def test_top_words(spark):
    df = spark.createDataFrame([("v", 1, "don't dont word words Words caféteria")], "variant string, seq int, response string")
    assert [(r.word, r.n, r.share) for r in diagnostics.top_words(df).orderBy("rank").collect()] == [("words", 2, 2.0), ("don't", 1, 1.0), ("teria", 1, 1.0)]


def test_percent_rounds_to_even(spark):
    got = [r[0] for r in spark.createDataFrame([(0.125,), (0.135,), (0.005,), (1.5,)], "s double").select(diagnostics.percent(F.col("s"))).collect()]
    assert got == [f"{x:.0%}" for x in (0.125, 0.135, 0.005, 1.5)]
