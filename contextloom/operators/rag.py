"""Retrieval: contexts, prompts and answers for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.functions.text import preview

NO_CONTEXTS, NO_WEB = "No relevant contexts found.", "No web results found."
#: Own wording; the slots are question, contexts, web_results, backend and latency_ms.
SYSTEM = "You answer questions about a body of documents. Be brief, rely on the contexts, and cite them as [SOURCE n]."
TEMPLATE = (
    "SYSTEM: ${system}\n\nUSER: Question: ${question}\n\nCONTEXTS:\n${contexts}\n\nWEB_RESULTS:\n${web_results}\n\n"
    "INSTRUCTION: answer, then name the sources used. Backend ${backend}, latency ${latency_ms} ms."
)


def kept_contexts(hits: DataFrame, by: str, most: int = 5) -> DataFrame:
    """At most ``most`` contexts for each question, best first; a missing score counts as 0, ties keep their rank."""
    w = Window.partitionBy(by).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "rank")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def three_places(x: Column) -> Column:
    """A number as C's and Python's ``%.3f`` print it, rounded from its exact value.

    Java's ``%.3f`` rounds the shortest decimal form: of 0.1235, which is 0.12349999..., it makes 0.124. ``format_number`` is exact,
    but makes 0.000 of 0.0005, and has other words for what isn't finite.
    """
    size = F.abs(x)
    return F.when((size > 0.0005) & (size < float("inf")), F.call_function("format_number", x, F.lit("0.000"))).otherwise(F.format_string("%.3f", x))


def context_line(place: Column, file_path: Column, url: Column, score: Column, text: Column) -> Column:
    source = F.coalesce(F.nullif(file_path, F.lit("")), url, F.lit("unknown"))
    return F.concat(F.format_string("[SOURCE %d | %s | score: ", place, source), three_places(F.coalesce(score, F.lit(0.0)).cast("double")), F.lit("]\n"), F.coalesce(text, F.lit("")))


def web_line(place: Column, title: Column, url: Column, snippet: Column) -> Column:
    return F.concat(F.format_string("[WEB %d] ", place), F.coalesce(title, F.lit("")), F.lit(" — "), F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(snippet, F.lit("")))


def joined_lines(place: str, line: str) -> Column:
    """Lines of a group in the order of their place. A question has few contexts, so the list is short."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, line))), lambda x: x[line]), "\n\n")


def prompt(question: Column, contexts: Column, web: Column, backend: str = "unknown", latency_ms: int = 0) -> Column:
    head, tail = TEMPLATE.split("${question}")
    fill = lambda t: t.replace("${system}", SYSTEM).replace("${backend}", backend).replace("${latency_ms}", str(latency_ms))
    middle, rest = tail.split("${contexts}")
    between, end = rest.split("${web_results}")
    return F.concat(
        F.lit(fill(head)), question, F.lit(fill(middle)), F.coalesce(F.nullif(contexts, F.lit("")), F.lit(NO_CONTEXTS)),
        F.lit(fill(between)), F.coalesce(F.nullif(web, F.lit("")), F.lit(NO_WEB)), F.lit(fill(end)),
    )


def extractive_answer(contexts: Column) -> Column:
    """A deterministic stand-in for a model: the first sentence of the best context, cited."""
    first = F.regexp_extract(contexts, r"(?s)^\[SOURCE 1[^\]]*\]\n(.*?[.!?])", 1)
    return F.when(first != "", F.concat(first, F.lit(" [SOURCE 1]"))).otherwise(F.lit(NO_CONTEXTS))


def first_available(candidates: DataFrame, by: str, value: str, priority: str, available: str) -> DataFrame:
    """For each ``by`` the available candidate of lowest priority number; null if there is none."""
    return candidates.groupBy(by).agg(F.min_by(F.when(F.col(available), F.col(value)), F.when(F.col(available), F.col(priority))).alias(value))


def rolled_health(status: str) -> Column:
    """healthy if all are healthy or disabled, degraded if any is unhealthy, else unknown."""
    bad = F.max((F.col(status) == "unhealthy").cast("int")) == 1
    good = F.min(F.col(status).isin("healthy", "disabled").cast("int")) == 1
    return F.when(bad, "degraded").when(good, "healthy").otherwise("unknown")


def chat_prompts(turns: DataFrame) -> DataFrame:
    """Per conversation: valid (the last turn is a user's), prompt with the earlier turns, and the direct prompt.

    A prompt holds its conversation, so it is as long as that is.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("m"))
    label = lambda x, user: F.concat(F.when(x["role"] == "user", user).otherwise("Assistant"), F.lit(": "), x["text"], F.lit("\n"))
    earlier = F.array_join(F.transform(F.slice("m", 1, F.size("m") - 1), lambda x: label(x, "User")), "")
    last = F.element_at("m", -1)
    head = F.when(F.size("m") > 1, F.concat(F.lit("Previous conversation:\n"), earlier, F.lit("\nCurrent question: "))).otherwise("")
    return rows.select(
        "conv_id", (last["role"] == "user").alias("valid"), F.concat(head, last["text"]).alias("prompt"),
        F.concat(F.array_join(F.transform("m", lambda x: label(x, "Human")), ""), F.lit("Assistant: ")).alias("direct_prompt"),
    )


def terminal_view(place: Column, file_path: Column, start: Column, end: Column, score: Column, text: Column) -> Column:
    lines = F.when((end != start) & (end > 0), F.concat(F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" (line "), start.cast("string"), F.lit(")")))
    where = F.concat(F.coalesce(file_path, F.lit("unknown")), F.when(start > 0, lines).otherwise(""))
    return F.concat(F.lit("[SOURCE "), place.cast("string"), F.lit("] "), where, F.lit(" (score: "), three_places(score.cast("double")), F.lit(")\n" + "-" * 60 + "\n"), preview(text, 300))
