"""Queries over documents as files: scans, filters, chunks, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.functions import text as X
from contextloom.operators import chunking as C
from contextloom.operators.vectors import with_index_ids
from contextloom.plans.frames import FILES, files, sql, table
from contextloom.sources.files import EXCLUDE, INCLUDE, kept_path, scan_stats

SQL: dict[str, str] = {}
WINDOWS = """w AS (SELECT doc_id, path, (i - 1) // 20 AS idx, min(i) AS start_line, max(i) AS end_line,
  regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+|[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+$', '', 'g') AS text
  FROM (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM files) GROUP BY ALL)"""
LANGUAGE = "CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.md' OR lower(path) LIKE '%.markdown' THEN 'markdown' ELSE 'javascript' END"


def chunk_line_window(spark: SparkSession, d: str) -> DataFrame:
    return C.line_windows(files(spark, d)).select("path", "idx", "start_line", "end_line", F.md5("text").alias("text_md5"))


SQL["chunk_line_window"] = sql(FILES, WINDOWS, body="SELECT path, idx::INT AS idx, start_line::INT AS start_line, end_line::INT AS end_line, md5(text) AS text_md5 FROM w")


def as_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: every third line becomes a heading of the level that its number gives."""
    level = lambda i: F.concat(F.repeat(F.lit("#"), (i % 6 + 1).cast("int")), F.lit(" "))
    lines = F.transform(F.split("content", "\n", -1), lambda x, i: F.when(i % 3 == 1, F.concat(level(i), x)).otherwise(x))
    return files(spark, d).withColumn("content", F.array_join(lines, "\n"))


MARKDOWN = """lines AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM files),
md AS (SELECT doc_id, path, i, CASE WHEN (i - 1) % 3 = 1 THEN repeat('#', ((i - 1) % 6 + 1)::INT) || ' ' || raw ELSE raw END AS line FROM lines),
hd AS (SELECT *, regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 1) AS mark, regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 2) AS title FROM md),
sec AS (SELECT *, sum(CASE WHEN mark <> '' AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS idx FROM hd),
sections AS (SELECT path, idx, min(i) AS start_line, max(i) AS end_line, first(CASE WHEN mark <> '' THEN title END ORDER BY i) AS heading,
  first(length(mark) ORDER BY i) AS heading_level, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+|[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+$', '', 'g') AS text FROM sec GROUP BY path, idx)"""


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return C.markdown_sections(as_markdown(spark, d)).select("path", "idx", "start_line", "end_line", "heading", "heading_level", F.md5("text").alias("text_md5"))


SQL["chunk_markdown"] = sql(FILES, MARKDOWN, body="SELECT path, idx::INT AS idx, start_line::INT AS start_line, end_line::INT AS end_line, heading, heading_level::INT AS heading_level, md5(text) AS text_md5 FROM sections")


def markdown_meta(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its first line fenced."""
    lines = F.split("content", "\n", -1)
    fenced = F.concat(F.lit("```"), F.when(F.col("doc_id") % 2 == 0, "sql").otherwise(""), F.lit("\n"), F.get(lines, F.lit(0)), F.lit("\n```\n"), F.col("content"))
    return files(spark, d).select("doc_id", C.markdown_facts(fenced).alias("m")).select("doc_id", "m.has_code", F.array_join("m.code_languages", ",").alias("code_languages"), "m.word_count")


SQL["markdown_meta"] = sql(
    FILES,
    """f AS (SELECT doc_id, '```' || CASE WHEN doc_id % 2 = 0 THEN 'sql' ELSE '' END || chr(10) || string_split(content, chr(10))[1] || chr(10) || '```' || chr(10) || content AS t FROM files)""",
    body=r"""SELECT doc_id, true AS has_code, CASE WHEN doc_id % 2 = 0 THEN 'sql' ELSE '' END AS code_languages,
len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))::INT AS word_count FROM f""",
)


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = C.line_windows(files(spark, d))
    return rows.where("text <> ''").select("path", "idx", C.chunk_id(F.col("path"), F.col("idx"), F.col("text")).alias("chunk_id"))


SQL["chunk_ids"] = sql(FILES, WINDOWS, body="SELECT path, idx::INT AS idx, path || '#' || idx || '#' || substr(md5(text), 1, 8) AS chunk_id FROM w WHERE text <> ''")


def chunks_by_language(spark: SparkSession, d: str) -> DataFrame:
    rows = C.line_windows(files(spark, d)).withColumn("language", X.language_of(F.col("path")))
    return rows.groupBy("language").agg(F.countDistinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"))


SQL["chunks_by_language"] = sql(FILES, WINDOWS, body=f"SELECT {LANGUAGE} AS language, count(DISTINCT path) AS n_files, count(*) AS n_chunks FROM w GROUP BY 1")


def chunks_per_file(spark: SparkSession, d: str) -> DataFrame:
    return C.line_windows(files(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


SQL["chunks_per_file"] = sql(FILES, WINDOWS, body="SELECT path, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM w GROUP BY path")


def chunk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files by sections, all others by line windows, as one table of chunks with their envelope."""
    all_files = files(spark, d)
    md = C.markdown_sections(all_files.where(F.col("path").endswith(".md"))).select("path", "idx", "start_line", "end_line", "text")
    rows = C.line_windows(all_files.where(~F.col("path").endswith(".md"))).unionByName(md)
    return rows.where("text <> ''").select(
        "path", "idx", "start_line", "end_line", X.language_of(F.col("path")).alias("language"), F.lit("file").alias("source"),
        C.chunk_id(F.col("path"), F.col("idx"), F.col("text")).alias("chunk_id"),
    )


SQL["chunk_pipeline"] = sql(
    FILES, WINDOWS,
    """whole AS (SELECT path, 0 AS idx, 1 AS start_line, len(string_split(content, chr(10))) AS end_line, regexp_replace(content, '^[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+|[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+$', '', 'g') AS text FROM files WHERE path LIKE '%.md'),
c AS (SELECT path, idx, start_line, end_line, text FROM w WHERE path NOT LIKE '%.md' UNION ALL SELECT * FROM whole)""",
    body=f"SELECT path, idx::INT AS idx, start_line::INT AS start_line, end_line::INT AS end_line, {LANGUAGE} AS language, 'file' AS source, path || '#' || idx || '#' || substr(md5(text), 1, 8) AS chunk_id FROM c WHERE text <> ''",
)


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = C.line_windows(files(spark, d))
    return rows.agg(F.countDistinct("path").alias("files_processed"), F.count(F.lit(1)).alias("chunks_created"), F.count_if(F.col("text").rlike(r"(?U)\S")).alias("chunks_indexed"))


SQL["ingest_summary"] = sql(FILES, WINDOWS, body="SELECT count(DISTINCT path) AS files_processed, count(*) AS chunks_created, count(*) FILTER (text <> '') AS chunks_indexed FROM w")


def chunk_python(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the docstring of a function in a class; the rows are the syntax tree's."""
    body = F.regexp_replace(F.col("content"), r"[\\\"]", " ")
    code = F.format_string('"""module %d"""\nimport os, sys\nfrom .pkg import name\n\nclass C%d(Base, m.X[int]):\n    def f(self, a):\n        """%s"""\n        return a\n', "doc_id", "doc_id", body)
    rows = files(spark, d).withColumn("content", code)
    out = C.chunked(rows, F.lit("python"))
    return out.select("path", "idx", "meta.chunk_type", "meta.start_line", "meta.end_line", F.coalesce("meta.function_name", "meta.class_name").alias("name"), F.array_join("meta.base_classes", ",").alias("bases"))


SQL["chunk_python"] = sql(
    FILES,
    """n AS (SELECT path, doc_id, len(string_split(regexp_replace(content, '[\\\\"]', ' ', 'g'), chr(10))) - 1 AS extra FROM files)""",
    body="""SELECT path, 0 AS idx, 'import' AS chunk_type, 2 AS start_line, 2 AS end_line, NULL AS name, NULL AS bases FROM n
UNION ALL SELECT path, 1, 'import', 3, 3, NULL, NULL FROM n
UNION ALL SELECT path, 2, 'class', 5, 8 + extra, 'C' || doc_id, 'Base,m.X[int]' FROM n
UNION ALL SELECT path, 3, 'function', 6, 8 + extra, 'f', NULL FROM n
UNION ALL SELECT path, 4, 'module_docstring', 1, 1, NULL, NULL FROM n""",
)


def script_files(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace(F.col("content"), r"[{}'\"`()]|import|function|class|const|let|var", " ")
    code = F.format_string("import a%d from 'lib/a';\nfunction f%d(x) { if (x) { /* %s */ } }\nclass K%d extends B { m() { } }\nconst g = async (y) => { };\n", "doc_id", "doc_id", body, "doc_id")
    return files(spark, d).withColumn("content", code)


SCRIPTS = """n AS (SELECT path, doc_id, len(string_split(regexp_replace(content, '[{}''"`()]|import|function|class|const|let|var', ' ', 'g'), chr(10))) - 1 AS extra FROM files)"""


def chunk_js_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chunked(script_files(spark, d), F.lit("javascript")).where("meta.chunk_type = 'import'")
    return rows.select("path", "text", "meta.start_line", "meta.end_line")


SQL["chunk_js_imports"] = sql(FILES, SCRIPTS, body="SELECT path, 'import a' || doc_id || ' from ''lib/a'';' AS text, 1 AS start_line, 1 AS end_line FROM n")


def chunk_js_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chunked(script_files(spark, d), F.lit("javascript")).where("meta.block_type is not null")
    return rows.select("path", "idx", "meta.block_type", "meta.name", "meta.start_line", "meta.end_line")


SQL["chunk_js_blocks"] = sql(
    FILES, SCRIPTS,
    body="""SELECT path, 1 AS idx, 'function' AS block_type, 'f' || doc_id AS name, 2 AS start_line, 2 + extra AS end_line FROM n
UNION ALL SELECT path, 2, 'arrow_function', 'g', 4 + extra, 4 + extra FROM n
UNION ALL SELECT path, 3, 'class', 'K' || doc_id, 3 + extra, 3 + extra FROM n""",
)


def chunk_pack_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Lines packed with overlap; a chunk's size depends on the one before."""
    rows = C.chunked(files(spark, d), F.lit("packed"))
    return rows.select("path", "idx", "meta.start_line", "meta.end_line", F.md5("text").alias("text_md5"))


SQL["chunk_pack_overlap"] = sql(
    "RECURSIVE " + FILES,
    "lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM files)",
    "sums AS (SELECT *, sum(length(line)) OVER (PARTITION BY path ORDER BY i) AS upto, count(*) OVER (PARTITION BY path) AS n FROM lines)",
    # first: the line that the open chunk begins with; from_line and to_line: the chunk that this line has closed
    """pack(path, i, first, from_line, to_line) AS (SELECT path, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM sums WHERE i = 1
  UNION ALL SELECT path, i, CASE WHEN full_ THEN greatest(first, i - 5) ELSE first END, CASE WHEN full_ THEN first END, CASE WHEN full_ THEN i - 1 END
  FROM (SELECT p.path, s.i, p.first, s.upto - b.upto + length(b.line) > 1000 AS full_ FROM pack p JOIN sums s ON s.path = p.path AND s.i = p.i + 1 JOIN sums b ON b.path = p.path AND b.i = p.first))""",
    "closed AS (SELECT path, from_line, to_line FROM pack WHERE to_line IS NOT NULL UNION ALL SELECT p.path, p.first, p.i FROM pack p JOIN sums s ON s.path = p.path AND s.i = p.i AND s.i = s.n)",
    """texts AS (SELECT c.path, c.from_line, c.to_line, regexp_replace(string_agg(l.line, chr(10) ORDER BY l.i), '^[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+|[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+$', '', 'g') AS text
  FROM closed c JOIN lines l ON l.path = c.path AND l.i BETWEEN c.from_line AND c.to_line GROUP BY ALL)""",
    body="SELECT path, (row_number() OVER (PARTITION BY path ORDER BY to_line, from_line) - 1)::INT AS idx, from_line::INT AS start_line, to_line::INT AS end_line, md5(text) AS text_md5 FROM texts",
)


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    ext = X.file_extension(F.col("path"))
    return files(spark, d).select("path", X.language_of(F.col("path")).alias("language"), (~ext.isin("py", "js", "jsx", "ts", "tsx", "md", "markdown")).alias("is_default"))


SQL["detect_language"] = sql(FILES, body=f"SELECT path, {LANGUAGE} AS language, NOT regexp_matches(path, '\\.(py|js|jsx|ts|tsx|md|markdown)$') AS is_default FROM files")


def glob_include_filter(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(F.col("path").rlike(X.glob_regex(INCLUDE))).select("path", "size")


SQL["glob_include_filter"] = sql(FILES, body="SELECT path, size FROM files WHERE " + " OR ".join(f"path GLOB '{p}'" for p in INCLUDE))


DISGUISES = ("node_modules/a.js", "lib/node_modules/a.js", "my-secret.txt", "db_password", "a.min.js", "build/x", "src/build/x", ".env", "b.env.ts", "Thumbs.db", "UPPER.PNG", "x.pyc", "key.pem", "dist", "keys")


def disguised(rows: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, DISGUISES)), (F.col("doc_id") % len(DISGUISES) + 1).cast("int"))
    return rows.withColumn("path", F.when(F.col("doc_id") % 3 == 0, name).otherwise(F.col("path")))


DISGUISED = "disguised AS (SELECT CASE WHEN doc_id % 3 = 0 THEN ([" + ", ".join(f"'{x}'" for x in DISGUISES) + f"])[doc_id % {len(DISGUISES)} + 1] ELSE path END AS path, size FROM files)"


def glob_exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    """Default exclusions and some that name sources, on paths of which every third has a name that a default one knows."""
    return disguised(files(spark, d)).where(~F.col("path").rlike(X.glob_regex([*EXCLUDE, "src1/*", "*7.md"]))).select("path", "size")


SQL["glob_exclude_filter"] = sql(FILES, DISGUISED, body="SELECT path, size FROM disguised WHERE NOT (" + " OR ".join(f"path GLOB '{p}'" for p in (*EXCLUDE, "src1/*", "*7.md")) + ")")


def doc_size_gate(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("size <= 2000").select("path", "size")


SQL["doc_size_gate"] = sql(FILES, body="SELECT path, size FROM files WHERE size <= 2000")


def doc_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 files by path: the early stop of a scan is the feature."""
    return files(spark, d).select("path", "size").orderBy("path").limit(100)


SQL["doc_limit"] = sql(FILES, body="SELECT path, size FROM files ORDER BY path LIMIT 100")


def doc_source_stats(spark: SparkSession, d: str) -> DataFrame:
    kept = kept_path(F.col("path")) & (F.col("size") <= 4000)
    return scan_stats(files(spark, d), kept, by=["source"])


SQL["doc_source_stats"] = sql(
    FILES, "k AS (SELECT *, path NOT LIKE '%.png' AND size <= 4000 AS kept FROM files)",
    body="SELECT source, count(*) AS found, count(*) FILTER (kept) AS processed, count(*) FILTER (NOT kept) AS skipped, coalesce(sum(size) FILTER (kept), 0)::BIGINT AS bytes FROM k GROUP BY source",
)


def file_ext_counts(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(X.file_extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))


SQL["file_ext_counts"] = sql(FILES, body="SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS extension, count(*) AS n, count(DISTINCT source) AS n_sources FROM files GROUP BY 1")


def index_blank_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines as texts: blank ones are not indexed."""
    lines = files(spark, d).select("path", F.posexplode(F.split(F.concat("content", F.lit("\n \t\n")), "\n", -1)).alias("i", "line"))
    return lines.where(F.col("line").rlike(r"(?U)\S")).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


SQL["index_blank_filter"] = sql(FILES, body="SELECT path, count(*) AS n_lines FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM files) WHERE regexp_matches(line, '[^\\s\\x0B\\x1C-\\x1F\\x85\\xA0]') GROUP BY path")


def index_insert_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = C.line_windows(files(spark, d)).where("text <> ''").select(C.chunk_id(F.col("path"), F.col("idx"), F.col("text")).alias("chunk_id"))
    return with_index_ids(rows, 1000).select("chunk_id", "id")


SQL["index_insert_ids"] = sql(FILES, WINDOWS, body="SELECT chunk_id, 999 + row_number() OVER (ORDER BY chunk_id) AS id FROM (SELECT path || '#' || idx || '#' || substr(md5(text), 1, 8) AS chunk_id FROM w WHERE text <> '')")


def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    """The documents' own secrets, renamed to a shape that is masked."""
    t = F.regexp_replace("content", 'token = "', 'api_key = "')
    return files(spark, d).select("doc_id", F.md5(X.masked_secrets(t)).alias("masked_md5"), (X.masked_secrets(t) != t).alias("changed"))


# Shapes of secrets and their masks, as in ``functions.text``.
SQL["mask_secrets"] = sql(
    FILES,
    "t AS (SELECT doc_id, replace(content, 'token = \"', 'api_key = \"') AS t FROM files)",
    r"""m AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(sk-[a-zA-Z0-9]{20,})', 'sk-***MASKED***', 'gi'),
 '(sk-ant-[a-zA-Z0-9]{20,})', 'sk-ant-***MASKED***', 'gi'), '(Bearer\s+)[a-zA-Z0-9\-_]+', '\1***MASKED***', 'gi'), '(x-api-key:\s*)[a-zA-Z0-9\-_]+', '\1***MASKED***', 'gi'),
 '(api[_-]?key["'']?\s*[:=]\s*["'']?)[a-zA-Z0-9\-_]+', '\1***MASKED***', 'gi') AS m FROM t)""",
    body="SELECT doc_id, md5(m) AS masked_md5, m <> t AS changed FROM m",
)


def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a diff: the sign of a line by its number."""
    signs = F.array(*map(F.lit, ("+", "-", " ", "+++ ", "--- ")))
    lines = F.transform(F.split("content", "\n", -1), lambda x, i: F.concat(F.element_at(signs, (i % 5 + 1).cast("int")), x))
    return files(spark, d).select("doc_id", X.diff_counts(F.array_join(lines, "\n")).alias("n")).select("doc_id", "n.added", "n.removed")


SQL["diff_stats"] = sql(
    FILES, "l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM files)",
    body="SELECT doc_id, (count(*) FILTER (i % 5 = 0 AND x NOT LIKE '++%'))::INT AS added, (count(*) FILTER (i % 5 = 1 AND x NOT LIKE '--%'))::INT AS removed FROM l GROUP BY doc_id",
)


def commit_confidence(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.element_at(F.array(*map(F.lit, ("Fix: ", "docs ", "change ", "Feat(x) "))), (F.col("doc_id") % 4 + 1).cast("int")), F.get(F.split("content", "\n", 2), F.lit(0)))
    score = X.commit_confidence(F.length("content"), F.col("doc_id") % 8, title)
    return files(spark, d).select("doc_id", score.alias("confidence"))


SQL["commit_confidence"] = sql(
    FILES,
    body="""SELECT doc_id, round(greatest(0.1, least(1.0, 0.8::DOUBLE + CASE WHEN length(content) < 100 OR length(content) > 5000 THEN -0.1 ELSE 0 END
 + CASE WHEN doc_id % 8 = 1 THEN 0.1 WHEN doc_id % 8 > 5 THEN -0.1 ELSE 0 END + CASE WHEN doc_id % 4 IN (0, 1, 3) THEN 0.1 ELSE 0 END)), 6) AS confidence FROM files""",
)


def json_extract_default(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON with text around it; broken JSON gives the default."""
    noisy = F.concat(F.lit("Sure: "), F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props")), F.lit(" ."))
    value = F.get_json_object(X.json_object(noisy), "$.k").cast("long")
    return table(spark, d, "events").select("event_id", F.coalesce(value, F.lit(-1)).cast("long").alias("k"))


SQL["json_extract_default"] = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE coalesce((props::JSON->>'k')::BIGINT, -1) END AS k FROM events"

QUERIES = {
    f.__name__: f
    for f in (
        chunk_line_window, chunk_markdown, markdown_meta, chunk_ids, chunks_by_language, chunks_per_file, chunk_pipeline, ingest_summary, chunk_python,
        chunk_js_imports, chunk_js_blocks, chunk_pack_overlap, detect_language, glob_include_filter, glob_exclude_filter, doc_size_gate, doc_limit,
        doc_source_stats, file_ext_counts, index_blank_filter, index_insert_ids, mask_secrets, diff_stats, commit_confidence, json_extract_default,
    )
}
