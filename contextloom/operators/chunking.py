"""Chunkers: a file row becomes chunk rows.

Line windows and Markdown sections are column expressions over the lines of one row, so they need no shuffle. What needs
a parser or carries state from chunk to chunk (Python's syntax tree, brace matching, packing with overlap) runs in Arrow
batches. All give (path, idx, text, meta, error); a file that fails gives one row with its error and hurts no other.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.functions.text import SUFFIXES, language_of, stripped
from contextloom.schema import CHUNK, META

SLICE_BYTES, SLICE_FILES = 1 << 18, 128  # of files whose chunks a task holds at a time
WINDOW_SHARE, OVERLAP_SHARE = 50, 20  # characters that a line stands for in windows and in overlaps
# Shapes of headings and fences.
HEADING = r"^(#{1,6})\s+(.+)$"
FENCE = r"(?s)```(\w+)?\n(.*?)\n```"


def meta_struct(**known: Column) -> Column:
    """The superset of chunk metadata; fields that aren't given are null."""
    fields = T._parse_datatype_string(META).fields  # type: ignore[attr-defined]
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def line_windows(files: DataFrame, path: str = "path", content: str = "content", max_chars: int = 1000) -> DataFrame:
    """Windows of ``max_chars // 50`` lines, without overlap: path, idx, start_line, end_line, text."""
    size = max_chars // WINDOW_SHARE
    if size < 1:
        raise ValueError(f"max_chars must be at least {WINDOW_SHARE}")
    lines = F.split(F.col(content), "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
    rows = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), lines.alias("lines"), F.posexplode(starts).alias("idx", "w"))
    return rows.select(
        "path", "idx", (F.col("w") * size + 1).alias("start_line"), F.least((F.col("w") + 1) * size, F.size("lines")).alias("end_line"),
        stripped(F.array_join(F.slice("lines", F.col("w") * size + 1, size), "\n")).alias("text"),
    )


def markdown_sections(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A section from each heading to the next: path, idx, start_line, end_line, heading, heading_level, text.

    What stands before the first heading is a section without one. Headings count inside code fences too.
    """
    lines = F.split(F.col(content), "\n", -1)
    rows = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), lines.alias("lines"))
    heads = F.filter(F.transform("lines", lambda x, i: F.when(stripped(x).rlike(HEADING), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), heads))
    rows = rows.withColumn("starts", starts).select("path", "lines", "starts", F.posexplode("starts").alias("idx", "from_line"))
    upto = F.coalesce(F.get("starts", F.col("idx") + 1), F.size("lines"))
    first = stripped(F.get("lines", F.col("from_line")))
    return rows.select(
        "path", "idx", (F.col("from_line") + 1).alias("start_line"), upto.alias("end_line"),
        F.when(first.rlike(HEADING), F.regexp_extract(first, HEADING, 2)).alias("heading"),
        F.length(F.regexp_extract(first, HEADING, 1)).alias("heading_level"),
        stripped(F.array_join(F.slice("lines", F.col("from_line") + 1, upto - F.col("from_line")), "\n")).alias("text"),
    )


def markdown_facts(text: Column) -> Column:
    """has_code, code_languages and word_count of a section."""
    languages = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    return F.struct(
        (F.size(languages) > 0).alias("has_code"), F.filter(languages, lambda x: x != "").alias("code_languages"),
        F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != "")).alias("word_count"),
    )


def chunk_id(path: Column, idx: Column, text: Column) -> Column:
    """path#index#first 8 hex digits of the text's md5."""
    return F.concat_ws("#", path, idx.cast("string"), F.substring(F.md5(text), 1, 8))


# ---- chunkers in Python: text -> [(chunk_type, start_line, end_line, text, extras)] ----
Chunk = tuple[str, int, int, str, dict]


def packed_lines(content: str, max_chars: int = 1000, overlap: int = 100) -> list[Chunk]:
    """Lines packed up to ``max_chars``; each chunk begins with the last lines of the one before it."""
    lines, out = content.split("\n"), []
    back = -(-overlap // OVERLAP_SHARE)
    first, size = 0, 0
    for i, line in enumerate(lines):
        if i > first and size + len(line) > max_chars:
            out.append(("text_block", first + 1, i, "\n".join(lines[first:i]), {}))
            first = max(first, i - back)
            size = sum(map(len, lines[first:i]))
        size += len(line)
    return [*out, ("text_block", first + 1, len(lines), "\n".join(lines[first:]), {})]


def windows(content: str, max_chars: int = 1000) -> list[Chunk]:
    lines, size = content.split("\n"), max_chars // WINDOW_SHARE
    return [("text_block", i + 1, min(i + size, len(lines)), "\n".join(lines[i : i + size]), {}) for i in range(0, len(lines), size)]


def python_chunks(content: str) -> list[Chunk]:
    """Functions, classes and imports in breadth-first order, the module's docstring last; lines if there is none."""
    try:
        tree = ast.parse(content)
    except SyntaxError:
        return packed_lines(content)
    lines = content.split("\n")
    cut = lambda node: "\n".join(lines[node.lineno - 1 : node.end_lineno])
    out: list[Chunk] = []
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                extras = {"function_name": node.name, "is_async": isinstance(node, ast.AsyncFunctionDef), "args": [a.arg for a in node.args.args], "docstring": ast.get_docstring(node)}
                out.append(("function", node.lineno, node.end_lineno or node.lineno, cut(node), extras))
            case ast.ClassDef():
                methods = [x.name for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
                extras = {"class_name": node.name, "base_classes": [ast.unparse(b) for b in node.bases], "methods": methods, "docstring": ast.get_docstring(node)}
                out.append(("class", node.lineno, node.end_lineno or node.lineno, cut(node), extras))
            case ast.Import():
                out.append(("import", node.lineno, node.lineno, lines[node.lineno - 1], {"import_type": "import", "modules": [a.name for a in node.names]}))
            case ast.ImportFrom():
                extras = {"import_type": "from_import", "module": node.module or "", "names": [a.name for a in node.names]}
                out.append(("import", node.lineno, node.lineno, lines[node.lineno - 1], extras))
    if tree.body and isinstance(doc := tree.body[0], ast.Expr) and isinstance(doc.value, ast.Constant) and isinstance(doc.value.value, str):
        out.append(("module_docstring", doc.lineno, doc.end_lineno or doc.lineno, doc.value.value, {}))
    return out or packed_lines(content)


# Shapes of the constructs that the script chunker knows, cut before what may be far away: a path, a closing parenthesis.
IMPORT_WORD, FROM_WORD = re.compile(r"import\s+"), re.compile(r"from(?=\s+['\"][^'\"]+['\"])")
FROM_PATH = re.compile(r"from\s+['\"][^'\"]+['\"];?")
SCRIPT_BLOCKS = (
    ("function", re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\("), re.compile(r"\)\s*{")),
    ("arrow_function", re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("), re.compile(r"\)\s*=>\s*{")),
    ("class", re.compile(r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?\s*{"), None),
)
BRACE = re.compile(r"[{}]")


class Script:
    """A script's marks, each found once: line ends, closing parentheses, paths, and the end of what each brace opens."""

    def __init__(self, content: str):
        self.content = content
        self.lines = [m.start() for m in re.finditer("\n", content)]
        self.closing = [m.start() for m in re.finditer(r"\)", content)]
        self.paths = [m.start() for m in FROM_WORD.finditer(content)]
        self.ends: dict[int, int] = {}
        opened: list[int] = []
        for m in BRACE.finditer(content):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                self.ends[opened.pop()] = m.end()

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def imports(self) -> Iterator[tuple[int, int]]:
        """From each ``import`` to the first path after it, if that begins on the line where the imported names do."""
        at = 0
        while m := IMPORT_WORD.search(self.content, at):
            at = m.start() + 1
            k, line = bisect_left(self.paths, m.end()), bisect_left(self.lines, m.end())
            if k < len(self.paths) and (line == len(self.lines) or self.paths[k] < self.lines[line]):
                at = FROM_PATH.match(self.content, self.paths[k]).end()  # type: ignore[union-attr]
                yield m.start(), at

    def blocks(self, head: re.Pattern[str], rest: re.Pattern[str] | None) -> Iterator[tuple[int, int, str]]:
        """Start, place of the opening brace, and name; what follows the parameters is looked for at the next closing parenthesis."""
        at = 0
        while m := head.search(self.content, at):
            at, end = m.start() + 1, m.end()
            if rest is not None:
                k = bisect_left(self.closing, end)
                found = rest.match(self.content, self.closing[k]) if k < len(self.closing) else None
                if found is None:
                    continue
                end = found.end()
            at = end
            yield m.start(), end - 1, m[1]


def script_chunks(content: str) -> list[Chunk]:
    """Imports, then functions, arrow functions and classes by their braces; line windows if there is none.

    Takes time in proportion to the script and to the blocks that come out, nested ones being parts of several.
    """
    script = Script(content)
    out: list[Chunk] = [("import", script.line(a), script.line(b), content[a:b], {}) for a, b in script.imports()]
    for kind, head, rest in SCRIPT_BLOCKS:
        for start, brace, name in script.blocks(head, rest):
            if (end := script.ends.get(brace)) is not None:
                out.append((kind, script.line(start), script.line(end), content[start:end], {"name": name, "block_type": kind}))
    return out or windows(content)


def markdown_chunks(content: str) -> list[Chunk]:
    lines, out = content.split("\n"), []
    heads = [(i, m) for i, x in enumerate(lines) if (m := re.match(HEADING, x.strip()))]
    starts = ([(0, None)] if not heads or heads[0][0] else []) + heads
    for k, (i, m) in enumerate(starts):
        upto = starts[k + 1][0] if k + 1 < len(starts) else len(lines)
        text = "\n".join(lines[i:upto]).strip()
        fences = re.findall(FENCE, text)
        extras = {"heading": m[2] if m else None, "heading_level": len(m[1]) if m else 0, "has_code": bool(fences), "code_languages": [x for x, _ in fences if x], "word_count": len(text.split())}
        out.append(("heading" if m else "paragraph", i + 1, upto, text, extras))
    return out


#: Chunkers by language, and the suffixes of their files; ``register`` adds to both.
CHUNKERS: dict[str, Callable[[str], list[Chunk]]] = {"python": python_chunks, "javascript": script_chunks, "markdown": markdown_chunks, "packed": packed_lines}
LANGUAGES: dict[str, str] = dict(SUFFIXES)


def register(language: str, chunker: Callable[[str], list[Chunk]], *suffixes: str) -> None:
    """A chunker for a language, and the suffixes that it is for from now on; a known language or suffix changes hands."""
    wrong = [s for s in suffixes if not s.startswith(".") or "/" in s]
    if wrong:
        raise ValueError(f"no suffixes: {wrong}")
    CHUNKERS[language] = chunker
    LANGUAGES.update({s.lower(): language for s in suffixes})


def unregister(language: str) -> None:
    """Forget a language; files with its suffixes go to the default chunker, or to the one they had at first."""
    CHUNKERS.pop(language, None)
    for suffix in [s for s, owner in LANGUAGES.items() if owner == language]:
        del LANGUAGES[suffix]
        if SUFFIXES.get(suffix, language) != language:
            LANGUAGES[suffix] = SUFFIXES[suffix]


def supported_suffixes() -> dict[str, list[str]]:
    """Suffixes by language."""
    out: dict[str, list[str]] = {}
    for suffix, language in sorted(LANGUAGES.items()):
        out.setdefault(language, []).append(suffix)
    return out


META_FIELDS = [f.strip().split(":")[0] for f in re.sub(r"array<string>", "x", META[7:-1]).split(",")]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of content or a file more, so that chunks are held of those only, however large batches are."""
    first, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += n or 0
        if held >= SLICE_BYTES or i - first + 1 >= SLICE_FILES:
            yield batch.slice(first, i + 1 - first)
            first, held = i + 1, 0
    if first < len(batch):
        yield batch.slice(first)


def chunked(files: DataFrame, language: Column | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """Chunks of each file by the chunker of its language; texts are stripped, empty chunks keep their index."""
    kind = language if language is not None else language_of(F.col(path), LANGUAGES)
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"), kind.alias("language"))
    schema = T._parse_datatype_string(CHUNK)  # type: ignore[attr-defined]
    chunkers = dict(CHUNKERS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[dict] = []
            for r in batch.to_pylist():
                try:
                    if r["content"] is None:
                        raise ValueError("no content")
                    found = chunkers[r["language"]](r["content"])
                except (ValueError, KeyError, RecursionError, MemoryError) as e:
                    out.append({"path": r["path"], "idx": None, "text": None, "meta": None, "error": f"{type(e).__name__}: {e}"})
                    continue
                for i, (kind, start, end, text, extras) in enumerate(found):
                    meta = {"file_path": r["path"], "start_line": start, "end_line": end, "chunk_type": kind, "language": r["language"], **extras}
                    out.append({"path": r["path"], "idx": i, "text": text.strip(), "meta": {f: meta.get(f) for f in META_FIELDS}, "error": None})
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return rows.mapInArrow(run, schema)


def text_digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]
