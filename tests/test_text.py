from __future__ import annotations

import fnmatch
import re
import shlex

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextloom.functions import shell as H
from contextloom.functions import text as X
from contextloom.sources.files import EXCLUDE, INCLUDE

PATHS = ["a.py", "src/a.py", "node_modules/x.js", "a/node_modules/x.js", "my_secret.txt", "x/.env", ".env/x", "build/o", "a.min.js", "A.PY", "dist", "d/README.md", "p.pptx", "x.tar.gz"]


@pytest.mark.parametrize("patterns", [INCLUDE, EXCLUDE, ["[ab]*.py", "?.md"], ["[!a]*"], []])
def test_globs_are_those_of_the_shell(patterns):
    for p in PATHS:
        assert bool(re.match(X.glob_regex(patterns), p)) == any(fnmatch.fnmatchcase(p, x) for x in patterns), p


@given(st.text("ab*?./x", max_size=8), st.text("ab./x", max_size=8))
def test_globs_on_random_text(pattern, path):
    assert bool(re.match(X.glob_regex([pattern]), path)) == fnmatch.fnmatchcase(path, pattern)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


COMMANDS = [
    ("```bash\nnpm install\n# note\ngit status\n```", ["npm install", "git status"]),
    ("Use `npm test` and `foo bar`", ["npm test"]),
    ("Run: npm start\nExecute: git pull\nCommand: hello", ["npm start", "git pull"]),
    ("$ ls -la\n$ ls -la", ["ls -la"]),
    ("nothing here", []),
    ("```sh\nls\n```\n`git diff`\n$ ls", ["ls", "git diff"]),
]


@pytest.mark.parametrize(("said", "found"), COMMANDS)
def test_commands(spark, said, found):
    assert one(spark, X.extracted_commands(F.lit(said))) == found


ALLOWED = [
    ("npm test", ["npm test"], True, True), ("git status -s", ["git status"], True, True), ("gitx", ["git"], False, True),
    ("npm run build", ["npm run test"], False, True), ("python3 a.py", ["python a.py"], True, True), ("rm x", ["git"], False, False), ("ls", [], False, False),
]


@pytest.mark.parametrize(("command", "allowed", "strict", "loose"), ALLOWED)
def test_allow_list(spark, command, allowed, strict, loose):
    a = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    assert one(spark, X.command_allowed(F.lit(command), a)) is strict
    assert one(spark, X.command_allowed(F.lit(command), a, compat=True)) is loose


@pytest.mark.parametrize(("command", "ok"), [("ls -la", True), ("/usr/bin/git log", True), ("sudo ls", False), ("rm -rf /", False), ("ls | rm x", False), ("nmap x", False), ("cat $(x)", False), ("kill -9 1", False), ('git "unbalanced', False), ("'/usr/bin/git' status", True), ("git commit -m 'a;b'", False), ('"git" log\\ x', True), ("  ", False)])
def test_command_flags(spark, command, ok):
    words = F.lit(H.split_words(command)) if H.split_words(command) is not None else F.lit(None).cast("array<string>")
    assert one(spark, H.command_flags(F.lit(command), words)).accepted is ok


def test_dangerous_as_the_sql_reads_it(spark):
    """Borders of words, white space, line ends and case beyond ASCII, held against DuckDB's engine."""
    said = [a + x + b for x in ("su", "rm -rf", "rm\x0b-rf", "rm\f-r", "ſudo", "Kill -9", "kill -9", "&& a\rrm", "&& a\u2028rm", "&& a\nrm", "HALT", "halt\u0301", "kıll -9") for a, b in (("", ""), ("ä", "ß"), ("é ", "ö"), ("_", ""), ("a", "a"), ("٣", "٣"))]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, cmd string").select("i", H.command_flags(F.col("cmd"), F.array(F.lit("ls")))["dangerous"].alias("d"))
    expected = [duckdb.execute("SELECT regexp_matches(?, ?)", [x, "(?i)" + "|".join(X.DANGEROUS)]).fetchone()[0] for x in said]
    assert [r.d for r in found.orderBy("i").collect()] == expected


@given(st.text(st.sampled_from(list("ab'\"\\ \t\n;é$")), max_size=30))
def test_words_are_those_of_a_shell(command):
    try:
        expected = shlex.split(command)
    except ValueError:
        expected = None
    assert H.split_words(command) == expected


def test_words_of_a_column(spark):
    rows = spark.createDataFrame([(1, "a 'b c'"), (2, None), (3, 'x "'), (4, "")], "id long, cmd string")
    assert {r.id: r.w for r in rows.select("id", H.shell_words("cmd").alias("w")).collect()} == {1: ["a", "b c"], 2: [], 3: None, 4: []}


def test_masks(spark):
    t = 'sk-abcdefghijklmnopqrstuv Bearer abc.d api_key = "xyz" x-api-key: q'
    assert one(spark, X.masked_secrets(F.lit(t))) == 'sk-***MASKED*** Bearer ***MASKED***.d api_key = "***MASKED***" x-api-key: ***MASKED***'


def test_small_functions(spark):
    assert tuple(one(spark, X.repository_of(F.lit("git@host.example:own/repo.git")))) == ("own", "repo")
    assert tuple(one(spark, X.repository_of(F.lit("https://host.example/own/repo")))) == ("own", "repo")
    assert one(spark, X.first_hop(F.lit("1.2.3.4, 5.6.7.8"), F.lit("9"))) == "1.2.3.4"
    assert one(spark, X.first_hop(F.lit(None).cast("string"), F.lit("9"))) == "9"
    assert one(spark, X.json_list_or_text(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, X.json_list_or_text(F.lit("plain"))) == ["plain"]
    assert one(spark, X.json_object(F.lit('x {"a":{"b":1}} y'))) == '{"a":{"b":1}}'
    assert one(spark, X.file_extension(F.lit("a/b.c/D.TXT"))) == "txt"
    assert one(spark, X.file_extension(F.lit("a.b/c"))) is None
    assert one(spark, X.filled(F.lit("${a}-${b}"), F.create_map(F.lit("a"), F.lit("1")))) == "1-${b}"
    assert one(spark, X.stripped(F.lit("  x\n"))) == "x"
    assert one(spark, X.mime_allowed(F.lit("image/png"), ["text/plain", "image/*"])) is True
    assert one(spark, X.issue_list(no_tests=F.lit(True), no_docs=F.lit(False))) == ["no tests"]
    assert tuple(one(spark, X.diff_counts(F.lit("+++ a\n+x\n-y\n--- b\n z")))) == (1, 1)
    assert one(spark, X.url_host(F.lit("https://u@h:80/p?q"))) == "u@h:80"
