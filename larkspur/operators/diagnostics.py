"""How alike the replies of each variant are: openings, greetings, frequent words, lengths, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.automaton import with_phrases
from larkspur.functions.text import words

# The mark of failed replies, the greeting pattern, word rules, list sizes.
ERROR_MARK = "ERROR"
GREET_THEN_THANK = r"^(hi|hey|hello)\b[^.!?]{0,25}(thank|thanks)"
TOKEN = "[a-z']+"
LONGER_THAN, TOP_OPENINGS, TOP_WORDS, SAMPLES, SHOWN = 4, 6, 10, 5, 100
# End of fixed values.


def response_text(response: Column) -> Column:
    """A missing reply counts as the text nan, as it does once it has been through a CSV file of numbers and texts."""
    return F.coalesce(response, F.lit("nan"))


def failed(response: Column) -> Column:
    return F.startswith(response_text(response), F.lit(ERROR_MARK))


def without_errors(replies: DataFrame) -> DataFrame:
    return replies.where(~failed(F.col("response")))


def opening_word(response: Column) -> Column:
    """First word, without .,! at its ends, in lower case; null for blank text."""
    return F.lower(F.btrim(F.get(words(response), F.lit(0)), F.lit(".,!")))


def by_opening(replies: DataFrame) -> DataFrame:
    """Partial sums by variant and opening word: what the summary, the opening words and the first rows are made of."""
    r = response_text(F.col("response"))
    ok = ~failed(F.col("response"))
    size = F.when(ok, F.size(words(r)))
    each = replies.select("variant", F.when(ok, opening_word(r)).alias("word"), ok.alias("ok"), (ok & F.lower(r).rlike(GREET_THEN_THANK)).alias("greets"), size.alias("len"), F.col("response").isNull().alias("missing"))
    return each.groupBy("variant", "word").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("m"), F.count_if("greets").alias("greet"), F.sum("len").alias("len"), F.min("len").alias("low"), F.max("len").alias("high"), F.count_if("missing").alias("missing")
    )


def summary(replies: DataFrame) -> DataFrame:
    """A row a variant: n, errors, m (replies that count), opening_share, greet, greet_share, mean_len, min_len, max_len, null_count.

    One pass: partial sums by variant and opening word, then by variant; a variant has few rows in the second step.
    Shares are null for a variant without replies that count.
    """
    return summary_of(by_opening(replies))


def summary_of(by_word: DataFrame) -> DataFrame:
    """The summary of partial sums; those of several inputs may stand below each other once `merged`."""
    top = F.max(F.when(F.col("word").isNotNull(), F.col("m")))
    x = by_word.groupBy("variant").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), top.alias("top"), F.sum("greet").alias("greet"), F.sum("len").alias("len"), F.min("low").alias("min_len"), F.max("high").alias("max_len"), F.sum("missing").alias("null_count"))
    m = F.nullif(F.col("m"), F.lit(0))
    return x.select(
        "variant", "n", (F.col("n") - F.col("m")).alias("errors"), "m", F.when(F.col("m") > 0, F.coalesce("top", F.lit(0)) / m).alias("opening_share"), "greet", (F.col("greet") / m).alias("greet_share"), (F.col("len") / m).alias("mean_len"), "min_len", "max_len", "null_count"
    )


def merged(by_word: DataFrame) -> DataFrame:
    """Partial sums of several inputs as those of all of them together."""
    sums = [F.sum(c).alias(c) for c in ("n", "m", "greet", "len", "missing")]
    return by_word.groupBy("variant", "word").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")).select(*by_word.columns)


def _ranked(counts: DataFrame, word: str, top: int) -> DataFrame:
    by = Window.partitionBy("variant").orderBy(F.desc("n"), word)
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _sizes(replies: DataFrame) -> DataFrame:
    """(variant, m): a row a variant."""
    return without_errors(replies).groupBy("variant").agg(F.count("*").alias("m"))


def _shares(counts: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    return _ranked(counts, "word", top).join(sizes, "variant").select("variant", "rank", "word", "n", (F.col("n") / F.col("m")).alias("share"))


def opening_words(replies: DataFrame, top: int = TOP_OPENINGS) -> DataFrame:
    """variant, rank, word, n, share of the replies that count; equal counts in order of the word."""
    return opening_words_of(by_opening(replies), top)


def opening_words_of(by_word: DataFrame, top: int = TOP_OPENINGS) -> DataFrame:
    counts = by_word.where("word is not null and m > 0").select("variant", "word", F.col("m").alias("n"))
    return _shares(counts, by_word.groupBy("variant").agg(F.sum("m").alias("m")), top)


def opening_share(replies: DataFrame) -> DataFrame:
    """variant, share of its most frequent opening word, 0 if no reply has one."""
    return summary(replies).select("variant", "opening_share")


def word_counts(replies: DataFrame) -> DataFrame:
    """variant, word, n occurrences of words of more than 4 characters in replies that count."""
    tokens = F.explode(F.regexp_extract_all(F.lower(response_text(F.col("response"))), F.lit(TOKEN), F.lit(0)))
    return without_errors(replies).select("variant", tokens.alias("word")).where(F.length("word") > LONGER_THAN).groupBy("variant", "word").agg(F.count("*").alias("n"))


def top_words(replies: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """variant, rank, word, n occurrences, share n / m, of words of more than 4 characters."""
    return _shares(word_counts(replies), _sizes(replies), top)


def top_words_of(counts: DataFrame, by_word: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """The same of counts by variant and word, which may come from several inputs."""
    total = counts.groupBy("variant", "word").agg(F.sum("n").alias("n"))
    return _shares(total, by_word.groupBy("variant").agg(F.sum("m").alias("m")), top)


def phrase_shares(replies: DataFrame, phrases: DataFrame) -> DataFrame:
    """variant, phrase, n replies that count and hold the phrase, share n / m; a row for each variant and phrase.

    `phrases` has a column phrase, in lower case; all of them are looked for in one pass over the replies' lower case,
    anywhere in it. Null, empty and repeated phrases count once or not at all.
    """
    listed = phrases.select("phrase").where("phrase <> ''").distinct()
    texts = without_errors(replies).select("variant", F.lower(response_text(F.col("response"))).alias("text"))
    found = with_phrases(texts, "text", listed.withColumn("place", F.lit(0)), "place", "phrase", whole=False)
    counts = found.select("variant", F.explode("hits.phrase").alias("phrase")).groupBy("variant", "phrase").agg(F.count("*").alias("n"))
    every = listed.crossJoin(F.broadcast(_sizes(replies)))  # a row a variant
    n = F.coalesce("n", F.lit(0).cast("long"))
    return every.join(counts, ["variant", "phrase"], "left").select("variant", "phrase", n.alias("n"), (n / F.col("m")).alias("share"))


def greet_then_thank(replies: DataFrame) -> DataFrame:
    return summary(replies).select("variant", "greet", "m", "greet_share")


def length_stats(replies: DataFrame) -> DataFrame:
    return summary(replies).select("variant", "mean_len", "min_len", "max_len")


def samples(replies: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first rows of each variant by seq, failed ones too, with the review cut to 100 characters."""
    n = F.row_number().over(Window.partitionBy("variant").orderBy("seq"))
    return replies.withColumn("n", n).where(F.col("n") <= most).select("variant", "n", "seq", "rating", F.substring("review", 1, SHOWN).alias("review"), "response")


def percent(share: Column) -> Column:
    """As a whole percentage, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def report_lines(replies: DataFrame) -> DataFrame:
    """first_seq, part, n, line: the text report's lines, some tens a variant, in order of these columns.

    A variant without replies that count has its head and a remark alone.
    """
    first = replies.groupBy("variant").agg(F.min("seq").alias("first_seq"))
    return lines_of(summary(replies), opening_words(replies), top_words(replies), samples(replies), first)


def lines_of(figures: DataFrame, openings: DataFrame, frequent: DataFrame, shown_rows: DataFrame, first: DataFrame) -> DataFrame:
    """The report's lines of the figures that the functions above give; `first` has variant and first_seq."""
    c, text = F.col, F.lit
    s = figures.withColumn("some", c("m") > 0)
    whole = F.bround("mean_len", 0).cast("int").cast("string")
    single = [
        (0, F.concat(text("== "), c("variant"), text(": "), c("n"), text(" rows, "), c("errors"), text(" failed =="))),
        (1, F.when(c("some"), "Opening words:").otherwise("No replies to analyse.")),
        (3, F.when(c("some"), F.concat(text("Most frequent opening word: "), percent(c("opening_share"))))),
        (4, F.when(c("some"), F.concat(text("Greets, then thanks: "), c("greet"), text(" of "), c("m"), text(" ("), percent(c("greet_share")), text(")")))),
        (5, F.when(c("some"), "Frequent words:")),
        (7, F.when(c("some"), F.concat(text("Words a reply: "), whole, text(" on average, "), c("min_len"), text(" to "), c("max_len")))),
        (8, F.when(c("some"), "Samples:")),
    ]
    parts = F.filter(F.array(*[F.struct(text(i).alias("part"), text(0).alias("n"), x.alias("line")) for i, x in single]), lambda x: x["line"].isNotNull())
    lines = s.select("variant", F.inline(parts))
    lines = lines.union(openings.select("variant", text(2), "rank", F.concat(text("  "), c("word"), text("  "), c("n"))))
    lines = lines.union(frequent.select("variant", text(6), "rank", F.concat(text("  "), c("word"), text("  "), c("n"), text("  "), percent(c("share")))))
    shown = F.concat(text("  ["), F.coalesce(c("rating").cast("string"), text("-")), text("] "), F.coalesce("review", text("")), text("\n      "), response_text(c("response")))
    some = s.where("some").select("variant")
    lines = lines.union(shown_rows.join(some, "variant", "left_semi").select("variant", text(9), "n", shown))
    return lines.join(first, "variant").select("first_seq", "part", "n", "line")


def report(replies: DataFrame) -> str:
    """The text report: some tens of lines a variant reach the driver."""
    return "\n".join(r.line for r in sorted(report_lines(replies).collect(), key=lambda r: (r.first_seq, r.part, r.n)))
