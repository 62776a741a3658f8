from __future__ import annotations

import re
import time

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextloom.operators import chunking as C

PYTHON = '"""doc"""\nimport os, sys\nfrom a.b import c as d\n\nclass K(Base):\n    """k"""\n    def m(self, x): return x\n\nasync def f(a, b):\n    "fd"\n    return a\n'
SCRIPT = "import x from 'y';\nexport async function go(a) { if (a) { b(); } }\nconst h = async (z) => { return z };\nexport class A extends B { m() {} }\nfunction broken() { "


def test_python():
    found = C.python_chunks(PYTHON)
    assert [c[0] for c in found] == ["import", "import", "class", "function", "function", "module_docstring"]
    assert found[2][4]["methods"] == ["m"] and found[2][4]["base_classes"] == ["Base"] and found[2][4]["docstring"] == "k"
    assert found[1][4] == {"import_type": "from_import", "module": "a.b", "names": ["c"]}
    assert {c[4]["function_name"]: c[4]["is_async"] for c in found if c[0] == "function"} == {"m": False, "f": True}
    assert [c[0] for c in C.python_chunks("def broken(:\n x")] == ["text_block"]
    assert [c[0] for c in C.python_chunks("x = 1")] == ["text_block"]


def test_script():
    found = C.script_chunks(SCRIPT)
    assert [(c[0], c[4].get("name")) for c in found] == [("import", None), ("function", "go"), ("arrow_function", "h"), ("class", "A")]
    assert found[1][3].endswith("} }")
    assert [c[0] for c in C.script_chunks("plain\n" * 45)] == ["text_block"] * 3


OLD_IMPORT = re.compile(r"import\s+.*?from\s+['\"][^'\"]+['\"];?")
OLD_BLOCKS = (
    ("function", re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*{")),
    ("arrow_function", re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>\s*{")),
    ("class", re.compile(r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?\s*{")),
)
PIECES = ["function ", "f", "(", ")", "{", "}", "import ", "from ", "'x'", '"', "'", ";", "\n", " ", "a, b", "export ", "async ", "const ", " = ", "=> ", "class ", "C ", "extends ", "(a) {", "() => {"]


@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_scripts_are_read_as_by_whole_patterns(pieces):
    """Blocks by patterns that span their parameters and by counting braces from each of them."""
    s = "".join(pieces)
    expected = [("import", m.start(), m[0]) for m in OLD_IMPORT.finditer(s)]
    for kind, pattern in OLD_BLOCKS:
        for m in pattern.finditer(s):
            depth = 0
            for at in range(m.end() - 1, len(s)):
                depth += (s[at] == "{") - (s[at] == "}")
                if depth == 0:
                    expected.append((kind, m.start(), s[m.start() : at + 1]))
                    break
    got = [c for c in C.script_chunks(s) if c[0] != "text_block"]
    assert [(c[0], c[1], c[3]) for c in got] == [(k, s.count("\n", 0, a) + 1, x) for k, a, x in expected]


@pytest.mark.parametrize("piece", ["function f(a) {", "function f(", "import ", "import a from 'x'\n", "class A {}\n", "const f = (", "}{", "from '"])
def test_scripts_take_linear_time(piece):
    took = []
    for size in (1 << 16, 1 << 20):
        s = (piece * (size // len(piece) + 1))[:size]
        began = time.perf_counter()
        C.script_chunks(s)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 and took[1] < 60 * max(took[0], 0.02)


def test_markdown():
    found = C.markdown_chunks("intro\n# A\ntext\n```py\ncode\n```\n### B ###\n#no")
    assert [(c[0], c[4]["heading"], c[4]["heading_level"], c[1], c[2]) for c in found] == [("paragraph", None, 0, 1, 1), ("heading", "A", 1, 2, 6), ("heading", "B ###", 3, 7, 8)]
    assert found[1][4]["code_languages"] == ["py"] and found[1][4]["word_count"] == 6


@given(st.lists(st.text("ab ", max_size=30), max_size=40), st.integers(20, 80), st.sampled_from([0, 20, 50, 100]))
def test_packing_covers_all_lines(lines, size, overlap):
    text = "\n".join(lines)
    found = C.packed_lines(text, size, overlap)
    all_lines = text.split("\n")
    seen = set()
    for k, (_, start, end, body, _) in enumerate(found):
        assert body == "\n".join(all_lines[start - 1 : end])
        assert k == 0 or start >= found[k - 1][1]
        seen.update(range(start, end + 1))
    assert seen == set(range(1, len(all_lines) + 1))


def test_chunked_isolates_errors(spark):
    rows = spark.createDataFrame([("a.py", PYTHON), ("b.md", "# T\nx"), ("c.js", SCRIPT), ("d.py", None), ("e.py", "\x00")], "path string, content string")
    out = {(r.path, r.idx): r for r in C.chunked(rows).collect()}
    assert out["a.py", 2].meta.class_name == "K" and out["b.md", 0].meta.heading == "T" and out["c.js", 1].meta.name == "go"
    assert out["d.py", None].error and out["d.py", None].text is None
    assert sum(p == "a.py" for p, _ in out) == 6


def test_native_sections_equal_python(spark):
    texts = ["", "# A", "x\n\n## B\ny\n#### C", "#no\n\n\n", "  # indented\nz", "a\n# \n#  spaced  title "]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    native = {(r.path, r.idx): (r.start_line, r.end_line, r.heading, r.heading_level, r.text) for r in C.markdown_sections(rows).collect()}
    model = {(str(i), k): (c[1], c[2], c[4]["heading"], c[4]["heading_level"], c[3]) for i, t in enumerate(texts) for k, c in enumerate(C.markdown_chunks(t))}
    assert native == model


def test_chunk_id(spark):
    r = spark.range(1).select(C.chunk_id(F.lit("p"), F.lit(3), F.lit("t")).alias("x")).first()
    assert r.x == f"p#3#{C.text_digest('t')}"


def test_chunks_of_a_few_files_are_held_at_a_time():
    """However large a batch is, its parts have about ``SLICE_BYTES`` and no more than ``SLICE_FILES`` files; all come, in order."""
    texts = ["é" * 5000] * 300 + [None] * 300 + ["x" * 3_000_000, "", "y"] + ["z"] * 200
    batch = pa.record_batch({"path": [str(i) for i in range(len(texts))], "content": texts})
    parts = list(C.slices(batch))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch]).combine_chunks()
    for part in parts:
        sizes = [len(x.encode()) if x else 0 for x in part.column(1).to_pylist()]
        assert 0 < len(part) <= C.SLICE_FILES and sum(sizes[:-1]) < C.SLICE_BYTES
    assert not list(C.slices(batch.slice(0, 0)))
