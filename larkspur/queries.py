"""The driver's queries over derived review and reply tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import os
import re
import time
import urllib.error
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from larkspur import cli
from larkspur.functions import features
from larkspur.functions.keywords import match_keywords, top_matching_keywords
from larkspur.functions.text import has_text
from larkspur.operators import diagnostics, responder
from larkspur.operators.ledger import Ledger, respond_once
from larkspur.operators.sampling import bottom_k
from larkspur.operators.validation import assemble, checked
from larkspur.plans import experiment, review_prompt, variant_prompt, wording
from larkspur.sources import tables
from larkspur.sources.shared import scratch_path
from larkspur.sources.workbook import written
from larkspur.streaming.figures import ReplyFigures, stream_figures
from larkspur.streaming.requests import read_both, stream_both

#: Approved keywords of the derived reviews.
APPROVED = ("the", "le", "und", "with", "worthless", "die", "la")

# Phrases that replies have been seen to repeat.
REPEATED = ("means a lot to us", "hope to see you again soon", "thank you so much for taking the time")
# End of fixed values.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records made of documents and suppliers, with the approved keywords and client instructions of the queries."""
    d, s = table(spark, sf_dir, "documents"), table(spark, sf_dir, "supplier")
    i = F.col("doc_id")
    x = d.join(s, F.col("s_suppkey") == i % 10)
    return x.select(
        i.alias("review_id"),
        F.concat(F.lit("Reviewer "), (i % 50).cast("string")).alias("reviewer_name"),
        (1 + i % 5).cast("int").alias("rating"),
        F.when(i % 7 != 0, F.col("text")).alias("review"),
        F.when(i % 3 == 0, "Concise").when(i % 3 == 1, "Default").otherwise("Elaborate").alias("ai_response_length_type"),
        F.col("s_name").alias("business_name"),
        F.when(i % 4 != 0, F.concat(F.lit("Regards, "), "s_name")).alias("signature"),
        F.when(i % 2 == 0, F.concat(F.lit("555"), F.col("s_suppkey").cast("string"))).alias("contact_number"),
        F.when(i % 3 == 0, "help@example.com").when(i % 3 == 1, "").alias("support_email"),
        F.when(i % 5 == 0, "https://example.com").alias("website_url"),
        F.array(*map(F.lit, APPROVED)).alias("approved_keywords"),
        F.when(i % 6 == 0, "  Mention the garden.\n").when(i % 6 == 1, " \n").otherwise("").alias("client_instructions"),
        F.when(i % 2 == 0, "garden").otherwise("").alias("keyword1"),
        F.when(i % 3 == 0, "terrace").otherwise("").alias("keyword2"),
        F.element_at(F.array(*map(F.lit, wording.TONES)), (1 + i % 6).cast("int")).alias("tone"),
        F.lit(experiment.RESPONSE_LENGTH).alias("response_length"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply records made of assistant turns, with failures and greetings put in."""
    i, text = F.col("conv_id"), F.col("text")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        (i * 100 + F.col("turn")).alias("seq"),
        F.when(i % 2 == 0, "A_no_grounding").otherwise("B_with_grounding").alias("variant"),
        (1 + i % 5).cast("int").alias("rating"),
        text.alias("review"),
        F.when(i % 17 == 0, "ERROR: timeout").when(i % 5 == 0, F.concat(F.lit("Hi there, thank you! "), text)).when(i % 5 == 1, F.concat(F.lit("Hello. Thanks "), text)).otherwise(text).alias("response"),
    )


_REVIEWS = """reviews AS (
  SELECT d.doc_id AS review_id, concat('Reviewer ', CAST(d.doc_id % 50 AS VARCHAR)) AS reviewer_name, CAST(1 + d.doc_id % 5 AS INT) AS rating,
    CASE WHEN d.doc_id % 7 <> 0 THEN d.text END AS review,
    CASE d.doc_id % 3 WHEN 0 THEN 'Concise' WHEN 1 THEN 'Default' ELSE 'Elaborate' END AS ai_response_length_type, s.s_name AS business_name,
    CASE WHEN d.doc_id % 4 <> 0 THEN concat('Regards, ', s.s_name) END AS signature,
    CASE WHEN d.doc_id % 2 = 0 THEN concat('555', CAST(s.s_suppkey AS VARCHAR)) END AS contact_number,
    CASE WHEN d.doc_id % 3 = 0 THEN 'help@example.com' WHEN d.doc_id % 3 = 1 THEN '' END AS support_email,
    CASE WHEN d.doc_id % 5 = 0 THEN 'https://example.com' END AS website_url,
    CASE d.doc_id % 6 WHEN 0 THEN 'Mention the garden.' ELSE '' END AS client, CASE WHEN d.doc_id % 2 = 0 THEN 'garden' END AS keyword1, CASE WHEN d.doc_id % 3 = 0 THEN 'terrace' END AS keyword2,
    d.doc_id % 6 AS tone_no, coalesce(d.doc_id % 7 <> 0 AND regexp_matches(d.text, '\\S'), false) AS has_text
  FROM documents d JOIN supplier s ON s.s_suppkey = d.doc_id % 10)"""

_GOOD = """good AS (SELECT variant, response, lower(trim(regexp_extract(response, '\\S+'), '.,!')) AS word, regexp_matches(response, '\\S') AS has_word FROM replies WHERE NOT starts_with(response, 'ERROR')),
sizes AS (SELECT variant, count(*) AS m FROM good GROUP BY variant)"""
_BARE_REPLIES = """replies AS (
  SELECT conv_id * 100 + turn AS seq, CASE WHEN conv_id % 2 = 0 THEN 'A_no_grounding' ELSE 'B_with_grounding' END AS variant, CAST(1 + conv_id % 5 AS INT) AS rating, text AS review,
    CASE WHEN conv_id % 17 = 0 THEN 'ERROR: timeout' WHEN conv_id % 5 = 0 THEN concat('Hi there, thank you! ', text) WHEN conv_id % 5 = 1 THEN concat('Hello. Thanks ', text) ELSE text END AS response
  FROM conversations WHERE role = 'assistant')"""
_REPLIES = f"{_BARE_REPLIES},\n{_GOOD}"

_SETTINGS = "settings(ai_response_length_type, has_text, word_limit, keyword_count, frequency_penalty, presence_penalty, temperature, max_tokens) AS (VALUES " + ", ".join(
    f"('{x.ai_response_length_type}', {str(x.has_text).lower()}, CAST({x.word_limit} AS INT), CAST({x.keyword_count} AS INT), CAST({x.frequency_penalty} AS DOUBLE), CAST({x.presence_penalty} AS DOUBLE), CAST({x.temperature} AS DOUBLE), CAST({x.max_tokens} AS INT))"
    for x in features.LENGTH_SETTINGS
) + ")"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _sql_filled(text: str, **values: str) -> str:
    """SQL that concatenates a text's literal parts with expressions for its braces."""
    parts = re.split(r"\{(\w+)\}", text)
    return "concat(" + ", ".join(f"coalesce(CAST({values[x]} AS VARCHAR), '')" if i % 2 else _sql(x) for i, x in enumerate(parts) if i % 2 or x) + ")"


_BAND = "CASE WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' ELSE 'Positive' END"
_TOKENS = "concat_ws(', ', CASE WHEN contact_number <> '' THEN 'Contact Number: ' || contact_number END, CASE WHEN support_email <> '' THEN 'Support Email: ' || support_email END, CASE WHEN website_url <> '' THEN 'Website: ' || website_url END)"
_SHORT_TOKENS = "concat_ws(', ', CASE WHEN contact_number <> '' THEN 'Contact Number: ' || contact_number END, CASE WHEN website_url <> '' THEN 'Website URL: ' || website_url END)"
_CALL = f"CASE WHEN contact_number IS NULL AND website_url IS NULL THEN '' WHEN rating <= 2 THEN {_sql(wording.CONTACT_EARLY)} WHEN rating = 3 THEN {_sql(wording.CONTACT_OFFER)} ELSE {_sql(wording.CONTACT_OPTIONAL)} END"
_SECTION = "concat_ws(chr(10), CASE WHEN has_text THEN concat('Review Text: ', review) END, concat('Rating: ', rating), concat('Reviewer Name: ', reviewer_name), concat('Business Name: ', business_name))"
_AT = r"CASE WHEN regexp_matches(lower(review), '(^|[^\p{L}\p{N}_])' || w || '($|[^\p{L}\p{N}_])') THEN length(regexp_extract(lower(review), '(?s)^(.*?(?:^|[^\p{L}\p{N}_]))' || w || '(?:[^\p{L}\p{N}_]|$)', 1)) END"
_MATCHED = f"""words(i, w) AS (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(APPROVED))}),
hits AS (SELECT review_id, i, w, {_AT} AS place FROM reviews, words WHERE has_text),
places AS (SELECT review_id, w, row_number() OVER (PARTITION BY review_id ORDER BY place, i) AS n FROM hits WHERE place IS NOT NULL),
matched AS (SELECT r.*, s.word_limit, s.keyword_count, s.frequency_penalty, s.presence_penalty, s.temperature, s.max_tokens, {_BAND} AS band,
    coalesce((SELECT list(p.w ORDER BY p.n) FROM places p WHERE p.review_id = r.review_id AND p.n <= s.keyword_count), []) AS kws
  FROM reviews r JOIN settings s ON s.ai_response_length_type = r.ai_response_length_type AND s.has_text = r.has_text)"""
_SENTIMENT = (
    f"CASE WHEN band = 'Negative' THEN {_sql(wording.NEGATIVE)} WHEN band = 'Neutral' AND len(kws) = 0 THEN {_sql(wording.NEUTRAL)} WHEN band = 'Neutral' THEN {_sql_filled(wording.NEUTRAL_KEYWORDS, keywords='kws[1]')}"
    f" WHEN len(kws) = 0 THEN {_sql(wording.POSITIVE)} ELSE {_sql_filled(wording.POSITIVE_KEYWORDS, keywords="array_to_string(kws, ', ')")} END"
)
_BLANK = "chr(10) || chr(10)"
_PROMPT = (
    f"concat_ws({_BLANK}, {_sql_filled(wording.VOICE, business_name='business_name')}, {_sql(wording.GUARDRAILS)}, {_sql(wording.BRAND)}, {_sql(wording.TONE_MENU)}, {_SENTIMENT}, {_SECTION},"
    f" CASE WHEN has_text THEN {_sql_filled(wording.LENGTH_WITH_TEXT, word_limit='word_limit')} ELSE {_sql_filled(wording.LENGTH_WITHOUT_TEXT, word_limit='word_limit')} END, {_sql(wording.FORMATTING)},"
    f" CASE WHEN {_TOKENS} <> '' THEN {_sql_filled(wording.TOKENS, tokens=_TOKENS)} END, CASE WHEN signature <> '' THEN {_sql_filled(wording.SIGNATURE, signature='signature')} END)"
)


def _variant_sql(v: variant_prompt.Variant, tone: str = "tone_no", client: str = "client", k1: str = "keyword1", k2: str = "keyword2", tokens: str = _SHORT_TOKENS, call: str = _CALL, signature: str = "signature") -> str:
    persona = f"CASE {tone} " + " ".join(f"WHEN {i} THEN {_sql_filled(wording.PERSONAS[x], business_name='business_name')}" for i, x in enumerate(wording.TONES)) + " END"
    menu = f"concat({_sql(wording.MENU_HEAD + chr(10))}, concat_ws({_BLANK}, " + ", ".join(_sql_filled(f"{x}:\n{wording.PERSONAS[x]}", business_name="business_name") for x in wording.TONES) + f"), {_sql(chr(10) * 2 + wording.MENU_TAIL)})"
    listed = f"concat_ws(', ', {k1}, {k2})"
    parts = [menu if v.menu else persona]
    if not v.menu:
        parts.append(f"CASE WHEN {client} <> '' THEN {_sql_filled(wording.CLIENT, client_instructions=client)} END")
    parts.append(_sql_filled(wording.CUSTOMER, review_text="review", rating="rating", reviewer_name="reviewer_name"))
    parts += [_sql(wording.GROUNDING)] * v.grounding + [_sql(wording.EXTRACTION)] * v.extraction
    parts.append(_sql(wording.GUIDE.replace("{high}", wording.GUIDE_HIGH_EXTRACTED if v.extraction else wording.GUIDE_HIGH)))
    rules = wording.RULES_HEAD + (f"\n{wording.RULES_TONE}" if v.menu else "") + f"\n{wording.RULES_TAIL}"
    parts.append(_sql_filled(rules, response_length=str(experiment.RESPONSE_LENGTH)))
    parts += [f"CASE WHEN {listed} <> '' THEN {_sql_filled(wording.KEYWORDS, keywords=listed)} END", f"CASE WHEN {tokens} <> '' THEN {_sql_filled(wording.VARIANT_TOKENS, tokens=tokens)} END", f"nullif({call}, '')", f"CASE WHEN {signature} <> '' THEN {_sql_filled(wording.VARIANT_SIGNATURE, signature=signature)} END"]
    return f"concat_ws({_BLANK}, {', '.join(parts)})"


def _digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("prompt_chars"))


_DIGEST = "md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars"


def _with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_length_settings(reviews(spark, sf_dir).withColumn("has_text", has_text(F.col("review"))))


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records with faults put in, by id."""
    i = F.col("review_id")
    x = reviews(spark, sf_dir).withColumn("rating", F.when(i % 11 == 0, 0).when(i % 11 == 1, 6).when(i % 11 != 2, F.col("rating")))
    x = x.withColumn("reviewer_name", F.when(i % 13 != 0, F.col("reviewer_name")))
    return x.withColumn("ai_response_length_type", F.when(i % 19 == 0, "concise").otherwise(F.col("ai_response_length_type")))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark's texts as approved keywords."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select("item_id", word.alias("keyword")).groupBy("keyword").agg(F.min("item_id").alias("ord"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every turn, and phrases that replies are known to repeat."""
    known = spark.createDataFrame([(x,) for x in REPEATED], "phrase string")
    return known.union(table(spark, sf_dir, "conversations").select(F.regexp_extract(F.lower("text"), r"^\S+ \S+", 0)))


def _fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = experiment.builder_columns(experiment.seeded_sample(reviews(spark, sf_dir)), F.lit("Corner Cafe"))
    return experiment.fan_out(sample)


def _experiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.run(reviews(spark, sf_dir), "Corner Cafe", responder.Offline, tasks=2)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies of replies, some of other shapes, made of assistant turns."""
    x = replies(spark, sf_dir)
    choice = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit(" "), "review", F.lit("\n")).alias("content")).alias("message"))).alias("choices")))
    block = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("review").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(" end ").alias("text"))).alias("content")))
    odd = F.col("seq") % 10
    return x.select("seq", F.when(odd == 0, "{}").when(odd == 1, '{"choices": []}').otherwise(choice).alias("choices_body"), F.when(odd == 0, "{}").when(odd == 1, "not json").otherwise(block).alias("blocks_body"))


def _json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as review records, each in a JSON file of several lines; some ratings are no whole numbers."""
    i, path = F.col("n_nationkey"), scratch_path(spark, "records")
    rating = F.when(i % 6 == 0, "2.5").when(i % 7 == 0, '"5"').otherwise((1 + i % 5).cast("string"))
    text = F.when(i % 4 != 0, F.concat(F.lit(',\n "review": "seen \\"'), "n_name", F.lit('\\""'))).otherwise(F.lit(',\n "other": 1'))
    record = F.concat(F.lit('{\n "reviewer_name": "'), "n_name", F.lit('",\n "rating": '), rating, text, F.lit("\n}"))
    table(spark, sf_dir, "nation").select(record.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = tables.read_json(spark, path, tables.REVIEW)
    bad = F.col("_corrupt_record").isNotNull()
    return rows.select("reviewer_name", F.when(~bad, F.col("rating")).alias("rating"), "review", "ai_response_length_type", bad.alias("corrupt"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of nations as businesses, of which some have keywords and support details; no optional column of reviews is there."""
    nation, i = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    rows = reviews(spark, sf_dir).select("review_id", "reviewer_name", "rating", (F.col("review_id") % 25).cast("int").alias("business_id"))
    key = i.cast("int").alias("business_id")
    words = nation.where(i % 2 == 0).select(key, F.array("n_name", F.lit("service")).alias("approved_keywords"))
    support = nation.where(i % 3 == 0).select(key, F.concat(F.lit("Team "), "n_name").alias("signature"), F.when(i % 2 == 0, "").otherwise("555").alias("contact_number"))
    out = checked(assemble(rows, nation.select(key, F.col("n_name").alias("business_name")), words, support))
    return out.select("review_id", "business_name", "reviewer_name", "rating", "ai_response_length_type", F.array_join("approved_keywords", "|").alias("keywords"), "signature", "contact_number", "website_url", "reject_reason")


def _result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment's result, written to a CSV file and read again."""
    path = scratch_path(spark, "result")
    rows = _experiment_rows(spark, sf_dir).withColumn("reviewer_name", F.concat(F.lit(' "'), "reviewer_name", F.lit('",\n x ')))
    tables.write_result(rows, path)
    return tables.read_result(spark, path).select("seq", "variant", "review_id", "reviewer_name", "rating", F.md5(F.coalesce("review", F.lit(""))).alias("review_md5"), "response")


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a review sheet without ids, in several CSV files in order of doc_id, read again."""
    path, i = scratch_path(spark, "sheet", ".csv"), F.col("doc_id")
    name = F.concat(F.lit("Reviewer "), (i % 50).cast("string"))
    docs = table(spark, sf_dir, "documents")
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")  # ranges of a bounded size
    rows = rows.select(name.alias("ReviewerName"), (i % 5 + 1 + F.lit(0.7)).alias("Rating"), F.regexp_replace("text", "\r\n?", "\n").alias("Review"))
    rows.write.option("maxRecordsPerFile", max(1, -(-docs.count() // 4))).options(**tables.WRITTEN).csv(path)
    return tables.read_sheet(spark, path).select("review_id", "reviewer_name", "rating", F.md5(F.coalesce("review", F.lit(""))).alias("review_md5"))


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as review workbooks, one for each nation and 500 customer numbers, read again."""

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        cells = [[k % 5 + 1.5, None, name if k % 7 else 12, f"<{name}> &\n" if k % 3 else None] for k, name in zip(rows.c_custkey.tolist(), rows.c_name, strict=True)]
        return pd.DataFrame({"book": [rows.book.iloc[0]], "content": [written([["Rating", "Other", "ReviewerName", "Review"], *cells])]})

    book = F.concat_ws("-", F.col("c_nationkey").cast("string"), F.expr("c_custkey div 500").cast("string")).alias("book")
    books = table(spark, sf_dir, "customer").select(book, "c_custkey", "c_name").groupBy("book").applyInPandas(made, "book string, content binary")  # 500 rows at most
    sheets = tables.first_sheets(books)
    return sheets.select("book", F.col("ReviewId").alias("review_id"), F.col("ReviewerName").alias("reviewer_name"), F.col("Rating").alias("rating"), F.col("Review").alias("review"))


def _faulty() -> responder.Responder:
    """Fails by review_id: each kind of failure in turn, and one that no kind foresees."""

    def answer(request: dict) -> str:
        kind = (None, "no_credential", "http", "network", "bad_shape", "odd")[request["review_id"] % 6]
        if kind == "odd":
            raise ValueError("not foreseen")
        if kind:
            raise responder.ReplyError(kind, f"{kind} failure")
        return "fine"

    return answer


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responder.generate_replies(reviews(spark, sf_dir), _faulty)


def _unknown_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant prompts of which some name an unknown tone, answered offline."""
    rows = reviews(spark, sf_dir).withColumn("tone", F.when(F.col("review_id") % 7 == 0, "Grumpy").otherwise(F.col("tone")))
    rows = variant_prompt.render(rows.crossJoin(F.broadcast(variant_prompt.variants(spark, (variant_prompt.DEFAULT, variant_prompt.LOCKED)))))
    return responder.respond(rows.select("review_id", "variant", "prompt"), responder.Offline).select("review_id", "variant", F.md5("prompt").alias("prompt_md5"), "status", "response")


def _answered(url: str, body: bytes, headers: dict, timeout: int) -> bytes:
    """What a provider would send for a request, by the first digit of its prompt's MD5: 0 is busy, 1 and 2 odd bodies, 3 no connection."""
    h = hashlib.md5(json.loads(body)["messages"][0]["content"].encode()).hexdigest()
    if h[0] == "0":
        raise urllib.error.HTTPError(url, 503, "busy", headers, io.BytesIO(b"busy"))
    if h[0] == "3":
        raise ConnectionRefusedError("refused")
    said = f" Reply to {h}\n"
    good = {"choices": [{"message": {"content": said}}]} if "Authorization" in headers else {"content": [{"type": "text", "text": said[:9]}, {"type": "tool", "text": "x"}, {"type": "text", "text": said[9:]}]}
    return {"1": b'{"choices": []}', "2": b"busy"}.get(h[0]) or json.dumps(good).encode()


def _providers(blocks: bool) -> responder.Responder:
    """Calls of one provider's protocol, without a network; prompts of digit 4 lack the key."""
    with_key, keyless = (responder.blocks_provider("x", k, "x-api-key", "m", send=_answered) if blocks else responder.choices_provider("x", k, send=_answered) for k in ("key", None))
    return lambda request: (keyless if hashlib.md5(request["prompt"].encode()).hexdigest()[0] == "4" else with_key)(request)


def _exchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both providers' payloads, bodies and failures."""
    asked = review_prompt.requests(reviews(spark, sf_dir))
    two = [responder.respond(asked, lambda blocks=blocks: _providers(blocks)).select("review_id", F.lit("blocks" if blocks else "choices").alias("provider"), "status", F.when(F.col("status") == "ok", F.col("response")).alias("text")) for blocks in (False, True)]
    return two[0].union(two[1])


def _in_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of two runs with one ledger: the first asks for even reviews and loses some calls, the second for all."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    rows = reviews(spark, sf_dir).select("review_id", F.concat(F.lit("Reply to "), F.coalesce("review", F.lit(""))).alias("prompt"))

    def run(number: int) -> responder.Responder:
        def answer(request: dict) -> str:
            h = hashlib.md5(request["prompt"].encode()).hexdigest()
            if number == 1 and h[0] == "0":
                raise responder.ReplyError("network", "lost")
            return f"{number}: {h}"

        return answer

    respond_once(rows.where("review_id % 2 = 0"), lambda: run(1), ledger, ("prompt",), batch=20_000)
    return respond_once(rows, lambda: run(2), ledger, ("prompt",), batch=20_000).select("review_id", "status", "response")


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of half of all orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return bottom_k(rows, rows.count() // 2, experiment.SAMPLE_SEED, "o_orderkey").select(F.col("seq").cast("long").alias("seq"), "o_orderkey")


def _pieces(rows: DataFrame, files: int) -> DataFrameWriter:
    """Writes rows where they are made, in files of at most a part in `files` of them, so their number grows with the input's splits."""
    return rows.write.option("maxRecordsPerFile", max(1, -(-rows.count() // files)))


def _two_thirds(rows: DataFrame) -> int:
    """How many files make two batches of a stream, the first the larger."""
    return max(1, -(-2 * len(rows.inputFiles()) // 3))


def _streamed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records with faults as a stream of JSON files: what both sinks hold in the end."""
    path, good, bad, checkpoint = (scratch_path(spark, x) for x in ("stream", "good", "bad", "stream-checkpoint"))
    kinds = "review_id long, business_name string, reviewer_name string, rating int, review string, ai_response_length_type string"
    names = [x.split()[0] for x in kinds.split(", ")]
    rows = _raw_records(spark, sf_dir)
    _pieces(rows.select(F.to_json(F.struct(*names)).alias("value")), 3).text(path)
    stream_both(spark, path, kinds, good, bad, checkpoint, files=_two_thirds(spark.read.text(path))).awaitTermination()
    accepted, rejected = read_both(spark, good, bad)
    return accepted.select("review_id", F.lit(None).cast("string").alias("reject_reason")).union(rejected.select("review_id", "reject_reason"))


def _streamed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of replies that came as a stream of files, some batches merged on the way."""
    path, out, checkpoint = (scratch_path(spark, x) for x in ("stream", "figures", "stream-checkpoint"))
    rows = _faulty_replies(spark, sf_dir)
    _pieces(rows, 3).parquet(path)
    files = _two_thirds(spark.read.schema(rows.schema).parquet(path))
    stream_figures(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path), out, checkpoint).awaitTermination()
    figures = ReplyFigures(spark, out, checkpoint)
    figures.compact()
    return _shown(figures.summary())


def _faulty_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of which some are null, and a variant whose replies all failed."""
    i = F.col("seq")
    rows = replies(spark, sf_dir)
    return rows.withColumn("variant", F.when(i % 19 == 0, "C_failed").otherwise(F.col("variant"))).withColumn("response", F.when(i % 19 == 0, "ERROR: 503").when(i % 23 != 0, F.col("response")))


def _shown(summary: DataFrame) -> DataFrame:
    """A summary with shares as the report prints them."""
    return summary.select("variant", "n", "errors", "m", "null_count", diagnostics.percent(F.col("opening_share")).alias("opening"), diagnostics.percent(F.col("greet_share")).alias("greet"), F.bround("mean_len", 0).cast("int").alias("mean_len"), "min_len", "max_len")


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls for all suppliers by 8 tasks at one rate: for each nation its calls, and whether each had a slot of the clock to itself and kept to its beginning."""
    spacing = 0.018
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit("p").alias("prompt"))
    path = scratch_path(spark, "spaced")
    responder.respond(asked, lambda: lambda request: repr(time.time()), tasks=8, spacing=spacing).write.parquet(path)  # calls are made once
    at = F.col("response").cast("double") * 0.9 / spacing
    told = spark.read.parquet(path).select("s_nationkey", F.floor(at).alias("slot"), (at - F.floor(at)).alias("late"))
    alone = told.groupBy("slot").agg(F.count("*").alias("calls"))
    both = told.join(alone, "slot")
    # a tenth of a slot, and as much again until the call tells the time
    return both.groupBy("s_nationkey").agg(F.count("*").alias("n"), ((F.max("calls") == 1) & (F.max("late") < 0.9)).alias("spaced"))


def _command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes, first lines and errors of the command line, for the first nation as business and a fixed set of calls, and the digest of the whole report on all replies."""
    path = scratch_path(spark, "cli")
    first = table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(1)
    first.select(F.to_json(F.struct(F.col("n_name").alias("business_name"))).alias("value")).write.text(f"{path}/business")
    for name, rating in (("review", 5), ("bad", 9)):
        first.select(F.to_json(F.struct(F.lit("Ann").alias("reviewer_name"), F.lit(rating).alias("rating"))).alias("value")).write.text(f"{path}/{name}")
    calls = {"dry run": ["review", "--dry-run"], "offline": ["review"], "bad rating": ["bad"], "no file": ["none"], "no key": ["review", "--url", "http://127.0.0.1:9"]}
    rows, kept = [], os.environ.pop(cli.KEY_VARIABLE, None)
    try:
        for name, (review, *more) in calls.items():
            out, err = io.StringIO(), io.StringIO()
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
                code = cli.main(["reply", "--business", f"{path}/business", "--review", f"{path}/{review}", *more])
            said = out.getvalue().split("\n")[0] if name == "dry run" else "a reply" if out.getvalue() else None
            rows.append((name, code, said, err.getvalue()[:7] or None, "not set" in err.getvalue()))
        result = _faulty_replies(spark, sf_dir).select("seq", "variant", F.col("seq").alias("review_id"), F.lit("Ann").alias("reviewer_name"), "rating", "review", "response")
        tables.write_result(result, f"{path}/result")
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            code = cli.main(["report", f"{path}/result"])
        rows.append(("report", code, hashlib.md5(out.getvalue().removesuffix("\n").encode()).hexdigest(), None, False))
    finally:
        if kept is not None:
            os.environ[cli.KEY_VARIABLE] = kept
    return spark.createDataFrame(rows, "call string, code int, said string, error string, lacks_key boolean")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "ab_summary": lambda s, d: diagnostics.summary(replies(s, d)).drop("null_count"),
    "sentiment_band": lambda s, d: reviews(s, d).select("review_id", "rating", features.sentiment_band(F.col("rating")).alias("band")),
    "band_counts": lambda s, d: reviews(s, d).groupBy(features.sentiment_band(F.col("rating")).alias("band")).agg(F.count("*").alias("n")),
    "validation_split": lambda s, d: checked(_raw_records(s, d)).select("review_id", F.col("reject_reason").isNull().alias("valid"), "reject_reason"),
    "review_text_flag": lambda s, d: reviews(s, d).select("review_id", has_text(F.col("review")).alias("has_text")),
    "length_settings": lambda s, d: _with_settings(s, d).select("review_id", "ai_response_length_type", "has_text", "word_limit", "keyword_count", "frequency_penalty", "presence_penalty", "temperature", "max_tokens"),
    "keyword_match": lambda s, d: reviews(s, d).select("review_id", F.array_join(top_matching_keywords(F.col("review"), F.col("approved_keywords"), F.lit(3)), "|").alias("keywords")),
    "keyword_match_exploded": lambda s, d: match_keywords(reviews(s, d), s.createDataFrame(list(enumerate(APPROVED)), "ord int, keyword string")).select("review_id", F.array_join("keywords", "|").alias("keywords")),
    "keyword_vocabulary": lambda s, d: match_keywords(reviews(s, d), _vocabulary(s, d)).select("review_id", F.array_join("keywords", "|").alias("keywords")),
    "phrase_shares": lambda s, d: diagnostics.phrase_shares(replies(s, d), _phrases(s, d)),
    "keyword_gate": lambda s, d: review_prompt.with_features(reviews(s, d)).select("review_id", "band", F.array_join(features.exposed_keywords(F.col("band"), F.col("matched")), "|").alias("keywords")),
    "token_line": lambda s, d: reviews(s, d).select("review_id", features.token_line(F.col("contact_number"), F.col("support_email"), F.col("website_url")).alias("tokens")),
    "contact_cta": lambda s, d: reviews(s, d).select("review_id", features.contact_call(F.col("rating"), features.has_contact(F.col("contact_number"), F.col("website_url"))).alias("call"), features.short_token_line(F.col("contact_number"), F.col("website_url")).alias("tokens")),
    "sentiment_section": lambda s, d: review_prompt.with_features(reviews(s, d)).select("review_id", features.sentiment_section(F.col("band"), F.col("matched")).alias("section")),
    "review_section": lambda s, d: reviews(s, d).select("review_id", features.review_section(has_text(F.col("review")), F.col("review"), F.col("rating"), F.col("reviewer_name"), F.col("business_name")).alias("section")),
    "review_prompt": lambda s, d: _digest(review_prompt.requests(reviews(s, d)), "review_id"),
    "request_payload": lambda s, d: review_prompt.requests(reviews(s, d)).select("review_id", F.from_json(responder.choices_payload(), "model string, messages array<struct<role:string,content:string>>, frequency_penalty double, presence_penalty double, temperature double, max_tokens int").alias("p"), F.from_json(responder.blocks_payload(), "max_tokens int").alias("q")).select("review_id", "p.model", F.get("p.messages", F.lit(0))["role"].alias("role"), F.md5(F.get("p.messages", F.lit(0))["content"]).alias("content_md5"), "p.frequency_penalty", "p.presence_penalty", "p.temperature", "p.max_tokens", F.col("q.max_tokens").alias("block_max_tokens")),
    "decode_choices": lambda s, d: _bodies(s, d).select("seq", responder.decode_choices(F.col("choices_body")).alias("text")).withColumn("status", responder.decode_status(F.col("text"))),
    "decode_blocks": lambda s, d: _bodies(s, d).select("seq", responder.decode_blocks(F.col("blocks_body")).alias("text")).withColumn("status", responder.decode_status(F.col("text"))),
    "seeded_sample": lambda s, d: experiment.seeded_sample(reviews(s, d)).select("seq", "review_id"),
    "ab_fanout": lambda s, d: _digest(_fan(s, d), "variant_ord", "variant", "seq", "review_id"),
    "ab_union": lambda s, d: _experiment_rows(s, d).select("variant_ord", "seq", "variant", "review_id", "reviewer_name", "rating", F.md5("review").alias("review_md5"), F.startswith("response", F.lit("ERROR")).alias("failed")),
    "error_split": lambda s, d: replies(s, d).groupBy("variant", diagnostics.failed(F.col("response")).alias("failed")).agg(F.count("*").alias("n")),
    "opening_words": lambda s, d: diagnostics.opening_words(replies(s, d)),
    "opening_share": lambda s, d: diagnostics.opening_share(replies(s, d)),
    "greet_then_thank": lambda s, d: diagnostics.greet_then_thank(replies(s, d)),
    "top_words": lambda s, d: diagnostics.top_words(replies(s, d)),
    "length_stats": lambda s, d: diagnostics.length_stats(replies(s, d)),
    "variant_samples": lambda s, d: diagnostics.samples(replies(s, d)),
    "json_records": _json_records,
    "assembled_records": _assembled,
    "result_file": _result_file,
    "sheet_ids": _sheet,
    "workbook": _workbooks,
    "reply_ledger": _in_ledger,
    "seeded_half": _half,
    "streamed_split": _streamed_split,
    "streamed_summary": _streamed_summary,
    "dry_run": lambda s, d: review_prompt.requests(reviews(s, d)).select("review_id", F.md5(review_prompt.dry_run_text()).alias("shown_md5")),
    "reply_failures": _failures,
    "unknown_tones": _unknown_tones,
    "http_exchange": _exchanged,
    "spaced_calls": _spaced,
    "command_lines": _command_lines,
    "summary_shown": lambda s, d: _shown(diagnostics.summary(_faulty_replies(s, d))),
    "report_lines": lambda s, d: diagnostics.report_lines(_faulty_replies(s, d)),
} | {
    f"prompt_{name}": (lambda v: lambda s, d: _digest(variant_prompt.render(reviews(s, d).crossJoin(F.broadcast(variant_prompt.variants(s, (v,))))), "review_id", "variant"))(v)
    for name, v in (("default", variant_prompt.DEFAULT), ("locked", variant_prompt.LOCKED), ("grounded", variant_prompt.GROUNDED), ("extraction", variant_prompt.EXTRACTION))
}

_STATS = """stats AS (SELECT variant, count(*) AS m, CAST(sum(CASE WHEN regexp_matches(lower(response), '^(hi|hey|hello)\\b[^.!?]{0,25}(thank|thanks)') THEN 1 ELSE 0 END) AS BIGINT) AS greet,
    CAST(sum(len(regexp_extract_all(response, '\\S+'))) AS BIGINT) AS total, CAST(min(len(regexp_extract_all(response, '\\S+'))) AS INT) AS min_len, CAST(max(len(regexp_extract_all(response, '\\S+'))) AS INT) AS max_len FROM good GROUP BY variant),
tops AS (SELECT variant, max(c) AS top FROM (SELECT variant, word, count(*) AS c FROM good WHERE has_word GROUP BY variant, word) GROUP BY variant)"""
_RAW = """raw AS (SELECT review_id, CASE WHEN review_id % 11 = 0 THEN 0 WHEN review_id % 11 = 1 THEN 6 WHEN review_id % 11 = 2 THEN NULL ELSE rating END AS rating, CASE WHEN review_id % 13 <> 0 THEN reviewer_name END AS reviewer_name,
    CASE WHEN review_id % 19 = 0 THEN 'concise' ELSE ai_response_length_type END AS kind FROM reviews),
judged AS (SELECT review_id, CASE WHEN reviewer_name IS NULL THEN 'missing reviewer_name' WHEN rating IS NULL THEN 'missing rating' WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating out of range' WHEN kind NOT IN ('Concise', 'Default', 'Elaborate') THEN 'unknown length type' END AS reject_reason FROM raw)"""
_SAMPLE = "sample AS (SELECT *, row_number() OVER (ORDER BY md5(concat('7:', CAST(review_id AS VARCHAR))), review_id) - 1 AS seq0 FROM reviews QUALIFY seq0 < 30)"
_FAN = f"""fan AS (SELECT 0 AS variant_ord, 'A_no_grounding' AS variant, seq0, review_id, reviewer_name, rating, coalesce(review, '') AS review, {{a}} AS prompt FROM sample UNION ALL
  SELECT 1, 'B_with_grounding', seq0, review_id, reviewer_name, rating, coalesce(review, ''), {{b}} FROM sample)"""

# the same with faults: the inner table keeps nulls, the outer one says nan for them, as the diagnostics do
_FAULTY = f"""{_BARE_REPLIES.replace("replies AS (", "whole AS (", 1)},
faulty AS (SELECT seq, CASE WHEN seq % 19 = 0 THEN 'C_failed' ELSE variant END AS variant, rating, review, CASE WHEN seq % 19 = 0 THEN 'ERROR: 503' WHEN seq % 23 <> 0 THEN response END AS given FROM whole),
replies AS (SELECT seq, variant, rating, review, given IS NULL AS missing, coalesce(given, 'nan') AS response FROM faulty),
{_GOOD}"""
_SHOWN = f"""{_FAULTY}, {_STATS}, shown AS (SELECT n.variant, n.n, n.n - coalesce(m, 0) AS errors, coalesce(m, 0) AS m, null_count, first_seq, greet AS greeting,
    CAST(CAST(round_even(100 * CAST(coalesce(top, 0) AS DOUBLE) / m, 0) AS INT) AS VARCHAR) || '%' AS opening, CAST(CAST(round_even(100 * CAST(greet AS DOUBLE) / m, 0) AS INT) AS VARCHAR) || '%' AS greet,
    CAST(round_even(CAST(total AS DOUBLE) / m, 0) AS INT) AS mean_len, min_len, max_len
  FROM (SELECT variant, count(*) AS n, CAST(count_if(missing) AS BIGINT) AS null_count, min(seq) AS first_seq FROM replies GROUP BY variant) n LEFT JOIN stats USING (variant) LEFT JOIN tops USING (variant))"""
_OPENINGS = "c AS (SELECT variant, word, count(*) AS n FROM good WHERE has_word GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY n DESC, word) AS INT) AS rank FROM c)"
_COMMON = "t AS (SELECT variant, unnest(regexp_extract_all(lower(response), '[a-z'']+')) AS word FROM good), tc AS (SELECT variant, word, count(*) AS n FROM t WHERE length(word) > 4 GROUP BY 1, 2), tr AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY n DESC, word) AS INT) AS rank FROM tc)"
_REPORT = f"""WITH {_SHOWN}, {_OPENINGS}, {_COMMON}, sm AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY seq) AS INT) AS n FROM replies),
lines(variant, part, n, line) AS (
  SELECT variant, 0, 0, '== ' || variant || ': ' || n || ' rows, ' || errors || ' failed ==' FROM shown
  UNION ALL SELECT variant, 1, 0, CASE WHEN m > 0 THEN 'Opening words:' ELSE 'No replies to analyse.' END FROM shown
  UNION ALL SELECT variant, 2, rank, '  ' || word || '  ' || n FROM r WHERE rank <= 6
  UNION ALL SELECT variant, 3, 0, 'Most frequent opening word: ' || opening FROM shown WHERE m > 0
  UNION ALL SELECT variant, 4, 0, 'Greets, then thanks: ' || greeting || ' of ' || m || ' (' || greet || ')' FROM shown WHERE m > 0
  UNION ALL SELECT variant, 5, 0, 'Frequent words:' FROM shown WHERE m > 0
  UNION ALL SELECT variant, 6, rank, '  ' || word || '  ' || n || '  ' || CAST(CAST(round_even(100 * CAST(n AS DOUBLE) / m, 0) AS INT) AS VARCHAR) || '%' FROM tr JOIN sizes USING (variant) WHERE rank <= 10
  UNION ALL SELECT variant, 7, 0, 'Words a reply: ' || mean_len || ' on average, ' || min_len || ' to ' || max_len FROM shown WHERE m > 0
  UNION ALL SELECT variant, 8, 0, 'Samples:' FROM shown WHERE m > 0
  UNION ALL SELECT variant, 9, sm.n, '  [' || rating || '] ' || coalesce(substr(review, 1, 100), '') || chr(10) || '      ' || response FROM sm JOIN sizes USING (variant) WHERE sm.n <= 5)
SELECT first_seq, CAST(part AS INT) AS part, CAST(lines.n AS INT) AS n, line FROM lines JOIN shown USING (variant)"""


def _fan_sql() -> str:
    tone = str(wording.TONES.index(experiment.TONE))
    cafe = {"tone": tone, "client": "''", "k1": "NULL", "k2": "NULL", "tokens": "''", "call": "''", "signature": "'Corner Cafe'"}
    return _FAN.format(**{x: _variant_sql(v, **cafe).replace("CAST(business_name AS VARCHAR)", "'Corner Cafe'") for x, v in (("a", variant_prompt.LOCKED), ("b", variant_prompt.GROUNDED))})


_WITH_MATCHED = f"WITH {_REVIEWS}, {_SETTINGS}, {_MATCHED}"
ORACLES: dict[str, str] = {
    "ab_summary": f"WITH {_REPLIES}, {_STATS} SELECT n.variant, n.n, n.n - coalesce(m, 0) AS errors, coalesce(m, 0) AS m, CAST(coalesce(top, 0) AS DOUBLE) / m AS opening_share, coalesce(greet, 0) AS greet, CAST(greet AS DOUBLE) / m AS greet_share, CAST(total AS DOUBLE) / m AS mean_len, min_len, max_len FROM (SELECT variant, count(*) AS n FROM replies GROUP BY variant) n LEFT JOIN stats USING (variant) LEFT JOIN tops USING (variant)",
    "sentiment_band": f"WITH {_REVIEWS} SELECT review_id, rating, {_BAND} AS band FROM reviews",
    "band_counts": f"WITH {_REVIEWS} SELECT {_BAND} AS band, count(*) AS n FROM reviews GROUP BY 1",
    "validation_split": f"WITH {_REVIEWS}, {_RAW} SELECT review_id, reject_reason IS NULL AS valid, reject_reason FROM judged",
    "review_text_flag": f"WITH {_REVIEWS} SELECT review_id, has_text FROM reviews",
    "length_settings": f"WITH {_REVIEWS}, {_SETTINGS} SELECT review_id, ai_response_length_type, has_text, word_limit, keyword_count, frequency_penalty, presence_penalty, temperature, max_tokens FROM reviews JOIN settings USING (ai_response_length_type, has_text)",
    "keyword_match": f"{_WITH_MATCHED} SELECT r.review_id, coalesce((SELECT string_agg(w, '|' ORDER BY n) FROM places p WHERE p.review_id = r.review_id AND n <= 3), '') AS keywords FROM reviews r",
    "keyword_match_exploded": f"{_WITH_MATCHED} SELECT r.review_id, coalesce((SELECT string_agg(w, '|' ORDER BY n) FROM places p WHERE p.review_id = r.review_id AND n <= 3), '') AS keywords FROM reviews r",
    "keyword_vocabulary": f"""WITH {_REVIEWS}, v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark),
t AS (SELECT review_id, unnest(l) AS w, unnest(range(len(l))) AS place FROM (SELECT review_id, regexp_extract_all(lower(review), '[\\p{{L}}\\p{{N}}_]+') AS l FROM reviews)),
f AS (SELECT review_id, w, min(place) AS place FROM t JOIN v USING (w) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY place) AS n FROM f)
SELECT r.review_id, coalesce(k.keywords, '') AS keywords FROM reviews r LEFT JOIN (SELECT review_id, string_agg(w, '|' ORDER BY n) AS keywords FROM n WHERE n <= 3 GROUP BY 1) k USING (review_id)""",
    "phrase_shares": f"""WITH {_REPLIES}, p AS (SELECT DISTINCT phrase FROM (SELECT unnest([{', '.join(map(_sql, REPEATED))}]) AS phrase
  UNION ALL SELECT regexp_extract(lower(text), '^\\S+ \\S+') FROM conversations) WHERE phrase <> '')
SELECT s.variant, p.phrase, count(g.response) AS n, CAST(count(g.response) AS DOUBLE) / s.m AS share FROM p CROSS JOIN sizes s
LEFT JOIN good g ON g.variant = s.variant AND contains(lower(g.response), p.phrase) GROUP BY s.variant, p.phrase, s.m""",
    "keyword_gate": f"{_WITH_MATCHED} SELECT review_id, band, CASE WHEN band = 'Negative' THEN '' WHEN band = 'Neutral' THEN coalesce(kws[1], '') ELSE array_to_string(kws, '|') END AS keywords FROM matched",
    "token_line": f"WITH {_REVIEWS} SELECT review_id, {_TOKENS} AS tokens FROM reviews",
    "contact_cta": f"WITH {_REVIEWS} SELECT review_id, {_CALL} AS call, {_SHORT_TOKENS} AS tokens FROM reviews",
    "sentiment_section": f"{_WITH_MATCHED} SELECT review_id, {_SENTIMENT} AS section FROM matched",
    "review_section": f"WITH {_REVIEWS} SELECT review_id, {_SECTION} AS section FROM reviews",
    "review_prompt": f"{_WITH_MATCHED} SELECT review_id, {_DIGEST} FROM (SELECT review_id, {_PROMPT} AS prompt FROM matched)",
    "request_payload": f"{_WITH_MATCHED} SELECT review_id, '{review_prompt.MODEL}' AS model, 'user' AS role, md5({_PROMPT}) AS content_md5, frequency_penalty, presence_penalty, temperature, max_tokens, CAST(400 AS INT) AS block_max_tokens FROM matched",
    "decode_choices": f"WITH {_REPLIES} SELECT seq, CASE WHEN seq % 10 > 1 THEN regexp_replace(review, '^\\s+|\\s+$', '', 'g') END AS text, CASE WHEN seq % 10 > 1 THEN 'ok' ELSE 'bad_shape' END AS status FROM replies",
    "decode_blocks": f"WITH {_REPLIES} SELECT seq, CASE WHEN seq % 10 > 1 THEN regexp_replace(concat(review, ' end'), '^\\s+', '') END AS text, CASE WHEN seq % 10 > 1 THEN 'ok' ELSE 'bad_shape' END AS status FROM replies",
    "seeded_sample": f"WITH {_REVIEWS}, {_SAMPLE} SELECT CAST(seq0 AS INT) AS seq, review_id FROM sample",
    "ab_fanout": f"WITH {_REVIEWS}, {_SAMPLE}, {_fan_sql()} SELECT CAST(variant_ord AS INT) AS variant_ord, variant, CAST(seq0 AS INT) AS seq, review_id, {_DIGEST} FROM fan",
    "ab_union": f"WITH {_REVIEWS}, {_SAMPLE}, {_fan_sql()} SELECT CAST(variant_ord AS INT) AS variant_ord, CAST(seq0 AS INT) AS seq, variant, review_id, reviewer_name, rating, md5(review) AS review_md5, false AS failed FROM fan",
    "error_split": f"WITH {_REPLIES} SELECT variant, starts_with(response, 'ERROR') AS failed, count(*) AS n FROM replies GROUP BY 1, 2",
    "opening_words": f"WITH {_REPLIES}, c AS (SELECT variant, word, count(*) AS n FROM good WHERE has_word GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY n DESC, word) AS INT) AS rank FROM c) SELECT variant, rank, word, n, CAST(n AS DOUBLE) / m AS share FROM r JOIN sizes USING (variant) WHERE rank <= 6",
    "opening_share": f"WITH {_REPLIES}, {_STATS} SELECT variant, CAST(coalesce(top, 0) AS DOUBLE) / m AS opening_share FROM stats LEFT JOIN tops USING (variant)",
    "greet_then_thank": f"WITH {_REPLIES}, {_STATS} SELECT variant, greet, m, CAST(greet AS DOUBLE) / m AS greet_share FROM stats",
    "top_words": f"WITH {_REPLIES}, t AS (SELECT variant, unnest(regexp_extract_all(lower(response), '[a-z'']+')) AS word FROM good), c AS (SELECT variant, word, count(*) AS n FROM t WHERE length(word) > 4 GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY n DESC, word) AS INT) AS rank FROM c) SELECT variant, rank, word, n, CAST(n AS DOUBLE) / m AS share FROM r JOIN sizes USING (variant) WHERE rank <= 10",
    "length_stats": f"WITH {_REPLIES}, {_STATS} SELECT variant, CAST(total AS DOUBLE) / m AS mean_len, min_len, max_len FROM stats",
    "json_records": """SELECT n_name AS reviewer_name, CASE WHEN n_nationkey % 6 <> 0 AND n_nationkey % 7 <> 0 THEN CAST(1 + n_nationkey % 5 AS INT) END AS rating, CASE WHEN n_nationkey % 4 <> 0 THEN 'seen "' || n_name || '"' END AS review,
        CAST(NULL AS VARCHAR) AS ai_response_length_type, n_nationkey % 6 = 0 OR n_nationkey % 7 = 0 AS corrupt FROM nation""",
    "assembled_records": f"""WITH {_REVIEWS} SELECT review_id, n_name AS business_name, reviewer_name, rating, 'Default' AS ai_response_length_type, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|service' ELSE '' END AS keywords,
        CASE WHEN n_nationkey % 3 = 0 THEN 'Team ' || n_name END AS signature, CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '555' END END AS contact_number, CAST(NULL AS VARCHAR) AS website_url, CAST(NULL AS VARCHAR) AS reject_reason
        FROM reviews JOIN nation ON n_nationkey = review_id % 25""",
    "result_file": f"""WITH {_REVIEWS}, {_SAMPLE}, {_fan_sql()}, said AS (SELECT *, ('0x' || right(md5(prompt), 1))::INT % 4 AS k FROM fan) SELECT row_number() OVER (ORDER BY variant_ord, seq0) - 1 AS seq, variant, review_id, ' "' || reviewer_name || '",' || chr(10) || ' x ' AS reviewer_name, rating, md5(review) AS review_md5,
        CASE k {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(responder.Offline.OPENINGS))} END || '. We look forward to the next visit.' AS response FROM said""",
    "sheet_ids": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS review_id, 'Reviewer ' || (doc_id % 50) AS reviewer_name, CAST(doc_id % 5 + 1 AS INT) AS rating, md5(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) AS review_md5 FROM documents",
    "workbook": """SELECT c_nationkey || '-' || (c_custkey // 500) AS book, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey) - 1 AS review_id,
  CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '12' END AS reviewer_name, CAST(c_custkey % 5 + 1 AS INT) AS rating, CASE WHEN c_custkey % 3 <> 0 THEN '<' || c_name || '> &' || chr(10) END AS review FROM customer""",
    "reply_ledger": f"""WITH {_REVIEWS}, p AS (SELECT review_id, md5('Reply to ' || coalesce(review, '')) AS h FROM reviews),
  r AS (SELECT *, CASE WHEN left(h, 1) <> '0' AND bool_or(review_id % 2 = 0) OVER (PARTITION BY h) THEN '1' ELSE '2' END AS run FROM p) SELECT review_id, 'ok' AS status, run || ': ' || h AS response FROM r""",
    "seeded_half": "SELECT row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS seq, o_orderkey FROM orders QUALIFY seq < (SELECT count(*) // 2 FROM orders)",
    "streamed_split": f"WITH {_REVIEWS}, {_RAW} SELECT review_id, reject_reason FROM judged",
    "streamed_summary": f"WITH {_SHOWN} SELECT variant, n, errors, m, null_count, opening, greet, mean_len, min_len, max_len FROM shown",
    "dry_run": f"{_WITH_MATCHED} SELECT review_id, md5(concat('model: {review_prompt.MODEL}', chr(10), 'temperature: ', temperature, chr(10), 'frequency_penalty: ', frequency_penalty, chr(10), 'presence_penalty: ', presence_penalty, chr(10), 'max_tokens: ', max_tokens, chr(10), chr(10), {_PROMPT})) AS shown_md5 FROM matched",
    "reply_failures": f"""WITH {_REVIEWS}, k AS (SELECT review_id, CASE review_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_credential' WHEN 2 THEN 'http' WHEN 3 THEN 'network' WHEN 4 THEN 'bad_shape' ELSE 'other' END AS status FROM reviews),
        e AS (SELECT *, CASE WHEN status = 'other' THEN 'not foreseen' WHEN status <> 'ok' THEN status || ' failure' END AS error FROM k) SELECT review_id, status, error, coalesce('ERROR: ' || error, 'fine') AS response FROM e""",
    "unknown_tones": f"""WITH {_REVIEWS}, p AS (SELECT review_id, '{variant_prompt.DEFAULT.variant}' AS variant, {_variant_sql(variant_prompt.DEFAULT)} AS prompt FROM reviews UNION ALL SELECT review_id, '{variant_prompt.LOCKED.variant}', CASE WHEN review_id % 7 <> 0 THEN {_variant_sql(variant_prompt.LOCKED)} END FROM reviews),
        said AS (SELECT *, ('0x' || right(md5(prompt), 1))::INT % 4 AS k FROM p) SELECT review_id, variant, md5(prompt) AS prompt_md5, CASE WHEN prompt IS NULL THEN 'no_prompt' ELSE 'ok' END AS status,
        CASE WHEN prompt IS NULL THEN 'ERROR: the row has no prompt' ELSE CASE k {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(responder.Offline.OPENINGS))} END || '. We look forward to the next visit.' END AS response FROM said""",
    "http_exchange": f"""{_WITH_MATCHED}, p AS (SELECT review_id, md5({_PROMPT}) AS h FROM matched), v(provider) AS (VALUES ('choices'), ('blocks')),
        x AS (SELECT review_id, provider, h, CASE left(h, 1) WHEN '0' THEN 'http' WHEN '1' THEN 'bad_shape' WHEN '2' THEN 'bad_shape' WHEN '3' THEN 'network' WHEN '4' THEN 'no_credential' ELSE 'ok' END AS status FROM p, v)
        SELECT review_id, provider, status, CASE WHEN status = 'ok' THEN 'Reply to ' || h END AS text FROM x""",
    "spaced_calls": "SELECT s_nationkey, count(*) AS n, true AS spaced FROM supplier GROUP BY 1",
    "command_lines": f"""SELECT * FROM (VALUES ('dry run', 0, 'model: {review_prompt.MODEL}', NULL, false), ('offline', 0, 'a reply', NULL, false), ('bad rating', 1, NULL, 'ERROR: ', false), ('no file', 1, NULL, 'ERROR: ', false), ('no key', 1, NULL, 'ERROR: ', true)) AS t("call", code, said, error, lacks_key)
  UNION ALL SELECT 'report', 0, md5(string_agg(line, chr(10) ORDER BY first_seq, part, n)), NULL, false FROM ({_REPORT})""",
    "summary_shown": f"WITH {_SHOWN} SELECT variant, n, errors, m, null_count, opening, greet, mean_len, min_len, max_len FROM shown",
    "report_lines": _REPORT,
    "variant_samples": f"WITH {_REPLIES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY seq) AS INT) AS n FROM replies) SELECT variant, n, seq, rating, substr(review, 1, 100) AS review, response FROM r WHERE n <= 5",
} | {
    f"prompt_{name}": f"WITH {_REVIEWS} SELECT review_id, '{v.variant}' AS variant, {_DIGEST} FROM (SELECT review_id, {_variant_sql(v)} AS prompt FROM reviews)"
    for name, v in (("default", variant_prompt.DEFAULT), ("locked", variant_prompt.LOCKED), ("grounded", variant_prompt.GROUNDED), ("extraction", variant_prompt.EXTRACTION))
}
