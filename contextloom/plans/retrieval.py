"""Queries over vectors, questions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.functions import shell as H
from contextloom.functions import text as X
from contextloom.operators import pruned as P
from contextloom.operators import rag as R
from contextloom.operators import vectors as V
from contextloom.plans.frames import FILES, files, sql, table

SQL: dict[str, str] = {}
#: Searches ask with every row whose id is divisible by 100, against all rows.
ASKED = """h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0))"""


def asked(spark: SparkSession, d: str, k: int = 10, least: float | None = None) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return V.top_k(rows, rows.where("vec_id % 100 = 0"), k, id_column="vec_id", query_id="vec_id", digits=6, least=least)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d)


SQL["vector_topk"] = sql(ASKED, body="SELECT query_id, id, score, rank::INT AS rank FROM h WHERE rank <= 10")


def vector_topk_join(spark: SparkSession, d: str) -> DataFrame:
    """Labels are looked up for the hits only."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return asked(spark, d).join(rows, "id").select("query_id", "id", "rank", "label")


SQL["vector_topk_join"] = sql(ASKED, body="SELECT query_id, id, rank::INT AS rank, label FROM h JOIN embeddings ON vec_id = id WHERE rank <= 10")


def vector_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same hits by cells, most of which a query never reads."""
    rows = table(spark, d, "embeddings")
    return P.pruned_top_k(P.celled(rows, "vec_id"), rows.where("vec_id % 100 = 0"), 10, query_id="vec_id", digits=6)


SQL["vector_topk_pruned"] = SQL["vector_topk"]


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d, least=0.7)


SQL["vector_threshold"] = sql(ASKED, body="SELECT query_id, id, score, rank::INT AS rank FROM h WHERE rank <= 10 AND score >= 0.7")


def vector_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scaled by their id, so they aren't unit vectors, and brought to length 1."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    v = V.normalised(scaled)
    return table(spark, d, "embeddings").select("vec_id", (F.round(F.get(v, F.lit(0)), 5) + 0.0).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


SQL["vector_normalise"] = """WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 3)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM s)
SELECT vec_id, round(CASE WHEN norm > 0 THEN v[1] / norm ELSE 0 END, 5) + 0.0 AS first, CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm2 FROM n"""


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.index_stats(table(spark, d, "embeddings"), key="vec_id")


SQL["index_stats"] = "SELECT count(*) AS total, max(len(embedding))::INT AS dimension, count(vec_id) AS metadata_count FROM embeddings"


def softmax_labels(spark: SparkSession, d: str) -> DataFrame:
    """For each asked vector the three most likely labels by the centroids of all labels."""
    rows = table(spark, d, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    centroids = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    hits = V.softmax_top(centroids, rows.where("vec_id % 100 = 0"), 3, id_column="label", query_id="vec_id")
    return hits.select("query_id", F.col("id").alias("label"), "rank", F.round("p", 5).alias("p"))


SQL["softmax_labels"] = """WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i) GROUP BY label),
s AS (SELECT q.vec_id AS query_id, c.label, list_cosine_similarity(c.v, q.embedding::DOUBLE[]) AS score FROM c, embeddings q WHERE q.vec_id % 100 = 0),
e AS (SELECT *, exp(100 * (score - max(score) OVER (PARTITION BY query_id))) AS e, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM s),
n AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM e)
SELECT query_id, label::BIGINT AS label, rank::INT AS rank, round(p, 5) AS p FROM n WHERE rank <= 3"""

DIM = 256
BUCKET = f"('0x' || substr(md5(word), 1, 7))::INT % {DIM}"
DOC_COUNTS = f"""dw AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word FROM documents),
dc AS (SELECT id, {BUCKET} AS bucket, count(*) AS n FROM dw GROUP BY ALL)"""
ITEM_COUNTS = f"""qw AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word FROM benchmark),
qc AS (SELECT query_id, {BUCKET} AS bucket, count(*) AS n FROM qw GROUP BY ALL)"""
FOUND = """hit AS (SELECT query_id, id, round(dot / (sqrt(a) * sqrt(b)), 6) AS score FROM (
  SELECT q.query_id, d.id, sum(q.n * d.n)::DOUBLE AS dot FROM qc q JOIN dc d ON q.bucket = d.bucket GROUP BY ALL)
  JOIN (SELECT query_id, sum(n * n)::DOUBLE AS a FROM qc GROUP BY 1) USING (query_id) JOIN (SELECT id, sum(n * n)::DOUBLE AS b FROM dc GROUP BY 1) USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit)"""


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hash_embedded(table(spark, d, "documents"), "doc_id", "text", DIM)
    parts = rows.select("doc_id", F.posexplode("embedding").alias("bucket", "n")).where("n > 0")
    return parts.select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


SQL["hash_embedding"] = sql(DOC_COUNTS, body="SELECT id AS doc_id, bucket::INT AS bucket, n FROM dc")


def found_documents(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """A document that has no bucket in common with a question is no hit, so a blank question has none."""
    docs = V.hash_embedded(table(spark, d, "documents"), "doc_id", "text", DIM)
    items = V.hash_embedded(table(spark, d, "benchmark"), "item_id", "text", DIM)
    return V.top_k(docs, items, k, id_column="doc_id", query_id="item_id", digits=6).where("score > 0")


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return found_documents(spark, d)


SQL["semantic_search"] = sql(DOC_COUNTS, ITEM_COUNTS, FOUND, body="SELECT query_id, id, score, rank::INT AS rank FROM ranked WHERE rank <= 10")


def rag_contexts(spark: SparkSession, d: str) -> DataFrame:
    return R.kept_contexts(found_documents(spark, d), "query_id").select("query_id", "id", "score", "place")


SQL["rag_contexts"] = sql(DOC_COUNTS, ITEM_COUNTS, FOUND, body="SELECT query_id, id, score, rank::INT AS place FROM ranked WHERE rank <= 5")
CONTEXTS = """ctx AS (SELECT query_id, string_agg(printf('[SOURCE %d | %s | score: %.3f]', rank::INT, path, score) || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS contexts
  FROM ranked JOIN files ON doc_id = id WHERE rank <= 5 GROUP BY query_id)"""


def formatted_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Texts are joined to the kept hits only."""
    kept = R.kept_contexts(found_documents(spark, d), "query_id")
    rows = kept.join(files(spark, d).select(F.col("doc_id").alias("id"), "path", "content"), "id")
    line = R.context_line(F.col("place"), F.col("path"), F.lit(None).cast("string"), F.col("score"), F.col("content"))
    return rows.select("query_id", "place", line.alias("line")).groupBy("query_id").agg(R.joined_lines("place", "line").alias("contexts"))


def rag_format_contexts(spark: SparkSession, d: str) -> DataFrame:
    return formatted_contexts(spark, d).select("query_id", F.md5("contexts").alias("contexts_md5"), F.length("contexts").alias("n_chars"))


SQL["rag_format_contexts"] = sql(FILES, DOC_COUNTS, ITEM_COUNTS, FOUND, CONTEXTS, body="SELECT query_id, md5(contexts) AS contexts_md5, length(contexts)::INT AS n_chars FROM ctx")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))
    return questions.join(formatted_contexts(spark, d), "query_id", "left").withColumn("prompt", R.prompt(F.col("question"), F.col("contexts"), F.lit("")))


def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("query_id", F.md5("prompt").alias("prompt_md5"))


def _template_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    t = R.TEMPLATE.replace("${system}", R.SYSTEM).replace("${backend}", "unknown").replace("${latency_ms}", "0").replace("${web_results}", R.NO_WEB)
    head, tail = t.split("${question}")
    middle, end = tail.split("${contexts}")
    return f"{quote(head)} || coalesce(text, '') || {quote(middle)} || coalesce(contexts, '{R.NO_CONTEXTS}') || {quote(end)}"


SQL["rag_prompt"] = sql(FILES, DOC_COUNTS, ITEM_COUNTS, FOUND, CONTEXTS, body=f"SELECT item_id AS query_id, md5({_template_sql()}) AS prompt_md5 FROM benchmark LEFT JOIN ctx ON query_id = item_id")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: questions -> hits -> contexts -> prompt -> a deterministic answer."""
    rows = prompts(spark, d)
    return rows.select("query_id", "question", R.extractive_answer(F.col("contexts")).alias("answer"), F.length("prompt").alias("prompt_chars"))


def cli_context_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    view = R.terminal_view(k % 5 + 1, F.col("path"), (k % 3).cast("int"), (k % 3 + k % 2).cast("int"), (k % 1000) / 1000, F.col("content"))
    return files(spark, d).select("doc_id", F.md5(view).alias("view_md5"))


SQL["cli_context_format"] = sql(
    FILES,
    body="""SELECT doc_id, md5('[SOURCE ' || (doc_id % 5 + 1) || '] ' || path || CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 <> 0 THEN ' (lines ' || (doc_id % 3) || '-' || (doc_id % 3 + doc_id % 2) || ')' ELSE ' (line ' || (doc_id % 3) || ')' END ELSE '' END
 || printf(' (score: %.3f)', (doc_id % 1000) / 1000) || chr(10) || repeat('-', 60) || chr(10) || CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END) AS view_md5 FROM files""",
)


def clamp_preview(spark: SparkSession, d: str) -> DataFrame:
    n = X.clamped(F.col("doc_id") % 20 - 5, 1, 10)
    return files(spark, d).select("doc_id", n.cast("long").alias("n"), F.md5(X.preview(F.col("content"), 200)).alias("preview_md5"))


SQL["clamp_preview"] = "SELECT doc_id, greatest(1, least(10, doc_id % 20 - 5)) AS n, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS preview_md5 FROM documents"


def prompt_template_fill(spark: SparkSession, d: str) -> DataFrame:
    template = F.element_at(F.array(F.lit("Review this ${lang} text from ${source}: ${missing}"), F.lit("Explain ${source}.")), (F.col("doc_id") % 2 + 1).cast("int"))
    filled = X.filled(template, F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return table(spark, d, "documents").select("doc_id", filled.alias("prompt"))


SQL["prompt_template_fill"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Review this ' || lang || ' text from ' || source || ': ${missing}' ELSE 'Explain ' || source || '.' END AS prompt FROM documents"


def chat_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = R.chat_prompts(table(spark, d, "conversations"))
    return rows.select("conv_id", "valid", F.md5("prompt").alias("prompt_md5"), F.md5("direct_prompt").alias("direct_md5"))


SQL["chat_prompt"] = """WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
g AS (SELECT conv_id, count(*) AS n, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text || chr(10), '' ORDER BY turn) FILTER (turn < last) AS earlier,
 string_agg(CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || text || chr(10), '' ORDER BY turn) AS everything, max_by(text, turn) AS said, max_by(role, turn) AS who FROM c GROUP BY conv_id)
SELECT conv_id, who = 'user' AS valid, md5(CASE WHEN n > 1 THEN 'Previous conversation:' || chr(10) || coalesce(earlier, '') || chr(10) || 'Current question: ' ELSE '' END || said) AS prompt_md5, md5(everything || 'Assistant: ') AS direct_md5 FROM g"""


def session_title(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", X.preview(F.col("t"), 50).alias("title"))


SQL["session_title"] = "SELECT conv_id, CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS title FROM (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)"


def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's ten newest events: the cut is the feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place <= 10").select("user_id", "event_id", "place")


SQL["recent_sessions"] = "SELECT user_id, event_id, place::INT AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10"


def commands(spark: SparkSession, d: str) -> DataFrame:
    """Turns with commands wrapped around their text in four ways."""
    first = F.regexp_replace(F.substring("text", 1, 12), r"[^a-zA-Z]", "x")
    said = F.concat(
        F.lit("Do this:\n```bash\n# note\nnpm "), first, F.lit("\ngit status\n```\nthen `python "), first, F.lit("` and `not this`.\nRun: docker "), first,
        F.lit("\n$ ls "), first, F.lit("\n$ git status\n"), F.regexp_replace("text", r"[`$:]", " "),
    )
    return table(spark, d, "conversations").select("conv_id", "turn", first.alias("first"), said.alias("said"))


def command_extract(spark: SparkSession, d: str) -> DataFrame:
    return commands(spark, d).select("conv_id", "turn", F.array_join(X.extracted_commands(F.col("said")), "|").alias("commands"))


WORDS_SQL = "x AS (SELECT conv_id, turn, regexp_replace(substr(text, 1, 12), '[^a-zA-Z]', 'x', 'g') AS f FROM conversations)"
SQL["command_extract"] = sql(WORDS_SQL, body="SELECT conv_id, turn, 'npm ' || f || '|git status|python ' || f || '|docker ' || f || '|ls ' || f AS commands FROM x")


def command_whitelist(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ("npm run", "git", "python -m")))
    cmd = F.element_at(F.array(F.concat(F.lit("npm run "), F.col("first")), F.concat(F.lit("git"), F.col("first")), F.lit("git log"), F.concat(F.lit("python3 -m")), F.concat(F.lit("rm "), F.col("first"))), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    rows = commands(spark, d).select("conv_id", "turn", cmd.alias("cmd"))
    return rows.select("conv_id", "turn", X.command_allowed(F.col("cmd"), allowed).alias("strict"), X.command_allowed(F.col("cmd"), allowed, compat=True).alias("loose"))


SQL["command_whitelist"] = "SELECT conv_id, turn, (conv_id + turn) % 5 IN (0, 2, 3) AS strict, (conv_id + turn) % 5 IN (0, 1, 2, 3) AS loose FROM conversations"


def written_commands(spark: SparkSession, d: str) -> DataFrame:
    """Turns as commands that quote their whole text in several ways, some of them badly."""
    text, k = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 6
    double = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    cmd = (
        F.when(k == 0, F.concat(F.lit("git commit -m "), double)).when(k == 1, F.concat(F.lit("/usr/bin/grep -e"), single, F.lit(" a\\ b ''")))
        .when(k == 2, F.concat(F.lit("echo "), single)).when(k == 3, F.concat(F.lit("git log "), double, F.lit(" 'open")))
        .when(k == 4, F.concat(F.lit("rm -rf "), double)).otherwise(F.concat(F.lit("git  log\t-n 3 "), F.regexp_replace(text, r"[^a-zA-Z0-9]+", "")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", cmd.alias("cmd")).withColumn("words", H.shell_words("cmd"))


def shell_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of each command, joined by a character that texts don't have; null where a quote isn't closed."""
    return written_commands(spark, d).select("conv_id", "turn", F.size("words").alias("n_words"), F.md5(F.array_join("words", "\x1f")).alias("words_md5"))


#: Commands as they are written, and the words that were put into them; q and b are a single quote and a backslash.
WRITTEN = """w AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', '', 'g') AS bare, chr(39) AS q, chr(92) AS b FROM conversations),
c AS (SELECT *, '"' || replace(replace(text, b, b || b), '"', b || '"') || '"' AS double, q || replace(text, q, q || b || q || q) || q AS single FROM w),
m AS (SELECT conv_id, turn, k, text,
  CASE k WHEN 0 THEN 'git commit -m ' || double WHEN 1 THEN '/usr/bin/grep -e' || single || ' a' || b || ' b ' || q || q WHEN 2 THEN 'echo ' || single
    WHEN 3 THEN 'git log ' || double || ' ' || q || 'open' WHEN 4 THEN 'rm -rf ' || double ELSE 'git  log' || chr(9) || '-n 3 ' || bare END AS cmd,
  CASE k WHEN 0 THEN ['git', 'commit', '-m', text] WHEN 1 THEN ['/usr/bin/grep', '-e' || text, 'a b', ''] WHEN 2 THEN ['echo', text] WHEN 4 THEN ['rm', '-rf', text]
    WHEN 5 THEN CASE WHEN bare = '' THEN ['git', 'log', '-n', '3'] ELSE ['git', 'log', '-n', '3', bare] END END AS words FROM c)"""
SQL["shell_words"] = sql(WRITTEN, body="SELECT conv_id, turn, len(words)::INT AS n_words, md5(array_to_string(words, chr(31))) AS words_md5 FROM m")


def command_danger_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = written_commands(spark, d).select("conv_id", "turn", H.command_flags(F.col("cmd"), F.col("words")).alias("f"))
    return rows.select("conv_id", "turn", "f.dangerous", "f.unreadable", "f.metacharacters", "f.base", "f.accepted")


SQL["command_danger_flags"] = sql(
    WRITTEN,
    f"""f AS (SELECT *, regexp_matches(cmd, '(?i){"|".join(X.DANGEROUS)}') AS dangerous, k <> 3 AND k <> 5 AND regexp_matches(text, '[|&;$`(){{}}<>\\n\\r]') AS metacharacters,
  CASE WHEN k <> 3 THEN regexp_extract(words[1], '[^/]*$') END AS base FROM m)""",
    body="SELECT conv_id, turn, dangerous, k = 3 AS unreadable, metacharacters, base, NOT dangerous AND k <> 3 AND NOT metacharacters AND base IN ('git', 'grep') AS accepted FROM f",
)


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", n.between(1, 10000).alias("query_ok"), F.col("turn").between(1, 100).alias("top_k_ok"), (~F.col("text").contains("..")).alias("path_ok"))
    return rows.withColumn("valid", F.col("query_ok") & F.col("top_k_ok") & F.col("path_ok"))


SQL["request_validation"] = """SELECT conv_id, turn, length(text) BETWEEN 1 AND 10000 AS query_ok, turn BETWEEN 1 AND 100 AS top_k_ok, NOT contains(text, '..') AS path_ok,
length(text) BETWEEN 1 AND 10000 AND turn BETWEEN 1 AND 100 AND NOT contains(text, '..') AS valid FROM conversations"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_pruned, vector_topk_join, vector_threshold, vector_normalise, index_stats, softmax_labels, hash_embedding, semantic_search, rag_contexts,
        rag_format_contexts, rag_prompt, cli_context_format, clamp_preview, prompt_template_fill, chat_prompt, session_title, recent_sessions,
        command_extract, command_whitelist, shell_words, command_danger_flags, request_validation,
    )
}
