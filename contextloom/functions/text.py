"""Text, command, diff and JSON functions as columns; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that may run, and the marks of dangerous ones.
ALLOWED_COMMANDS = (
    "npm yarn pnpm node python python3 pip pip3 poetry conda cargo rustc go java javac mvn gradle make cmake gcc g++ clang "
    "git svn hg ls dir cat head tail find grep awk sed wc sort uniq cut tr ps top htop df du free uname whoami id env printenv "
    "which where type docker docker-compose pytest jest mocha phpunit rspec eslint prettier black flake8 mypy pylint rustfmt "
    "gofmt apt yum brew choco pacman"
).split()
DANGEROUS = (
    r"\brm\s+(-rf?|--recursive|--force)", r"\bsudo\b", r"\bsu\b", r">\s*/dev/", r"\bchmod\s+777", r"\bchown\b", r"\bmkfs\b",
    r"\bdd\s+if=", r"\bfdisk\b", r"\breboot\b", r"\bshutdown\b", r"\bhalt\b", r"\bkill\s+-9", r"\bkillall\b", r"\bpkill\b",
    r"&&.*rm\b", r";\s*rm\b", r"\|\s*rm\b",
)
# Words that a command may begin with in prose, and types of commits.
COMMAND_STARTS = ("npm", "python", "pip", "git", "docker", "ls", "cd", "pwd", "cat", "grep", "find")
# Suffixes that have a chunker of their own; all others go to the line windows of ``javascript``.
SUFFIXES = {".py": "python", ".md": "markdown", ".markdown": "markdown", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript"}
COMMIT_TYPES = ("feat", "fix", "docs", "style", "refactor", "test", "chore")
# Where commands stand in a model's answer.
SHELL_BLOCK_CUT = r"(?is)```(?:bash|shell|terminal|sh).*?```"
SHELL_BLOCK = r"(?is)```(?:bash|shell|terminal|sh)\s*\n(.*?)\n\s*```"
INLINE_CODE = r"`([^`\n]+)`"
TOLD_COMMAND = r"(?i)(?:Run|Execute|Command):\s*`?([^`\n]+)`?"
TYPED_COMMAND = r"\$\s+([^\n]+)"
# Shapes of secrets and what stands for them.
SECRETS = (
    (r"(?i)(sk-[a-zA-Z0-9]{20,})", "sk-***MASKED***"),
    (r"(?i)(sk-ant-[a-zA-Z0-9]{20,})", "sk-ant-***MASKED***"),
    (r"(?i)(Bearer\s+)[a-zA-Z0-9\-_]+", "$1***MASKED***"),
    (r"(?i)(x-api-key:\s*)[a-zA-Z0-9\-_]+", "$1***MASKED***"),
    (r"(?i)(api[_-]?key[\"']?\s*[:=]\s*[\"']?)[a-zA-Z0-9\-_]+", "$1***MASKED***"),
)


def ascii_pattern(pattern: str) -> str:
    """A pattern in lower case, as RE2 reads it under ``(?i)``, for Java's engine, whatever the JVM's version.

    Words and white space are ASCII's, so a letter beyond it ends a word and a vertical tab is no space; a dot stops at line
    feeds only; s and k also stand for the two letters beyond ASCII that fold to them.
    """
    word = "[A-Za-z0-9_]"
    stands = {
        r"\b": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", r"\s": r"[\t\n\f\r ]", ".": r"[^\n]", "s": "[sS\u017f]", "k": "[kK\u212a]",
    }
    return "(?i)" + re.sub(r"\\.|.", lambda m: stands.get(m[0], m[0]), pattern)


def stripped(c: Column) -> Column:
    """Without white space at both ends, Unicode's included (trim only knows the space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def glob_regex(patterns: Sequence[str]) -> str:
    """One anchored regular expression for shell patterns; ``*`` also crosses ``/``, as patterns mean whole paths."""

    def one(pattern: str) -> str:
        out, i = "", 0
        while i < len(pattern):
            ch = pattern[i]
            end = pattern.find("]", i + 2) if ch == "[" else -1
            if ch == "*":
                out += ".*"
            elif ch == "?":
                out += "."
            elif end > 0:
                inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
                i = end
            else:
                out += re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", ch)
            i += 1
        return out

    return "(?s)^(?:" + "|".join(map(one, patterns)) + ")$" if patterns else "(?!)"


def file_extension(path: Column) -> Column:
    """What follows the last dot of the path's last part, lower-cased; null without a dot."""
    found = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(found != "", F.lower(found))


def language_of(path: Column, suffixes: Mapping[str, str] | None = None, default: str = "javascript") -> Column:
    """Chunker of a path by its suffix (the longest that fits); everything unknown goes to the ``default`` one."""
    p, out = F.lower(path), F.lit(default)
    for suffix, language in sorted((suffixes or SUFFIXES).items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(p.endswith(suffix.lower()), language).otherwise(out)
    return out


def masked_secrets(text: Column) -> Column:
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def html_title(html: Column) -> Column:
    """Title of a page, found once scripts and styles are gone; the common character references are decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return stripped(decoded(F.regexp_extract(bare, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def decoded(text: Column) -> Column:
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(ch))
    return text


def html_text(html: Column) -> Column:
    """All text of a page in one line: a subset of HTML by regular expressions (``web.page_texts`` parses in full)."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    bare = decoded(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", ""))
    parts = F.split(bare, r"[\n\r]|  ", -1)
    parts = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")
    return F.array_join(parts, " ")


def url_host(url: Column) -> Column:
    """Network location: host with port and user, as they stand."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def extracted_commands(response: Column) -> Column:
    """Shell commands in a model's answer: fenced blocks, inline code, ``Run:`` lines and ``$`` lines, each once."""
    starts = r"^(?:" + "|".join(COMMAND_STARTS) + ")"
    looks = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "").rlike(starts)
    clean = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rest = F.regexp_replace(response, SHELL_BLOCK_CUT, "")
    blocks = F.regexp_extract_all(response, F.lit(SHELL_BLOCK), F.lit(1))
    lines = clean(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n", -1))))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    inline = F.filter(clean(F.regexp_extract_all(rest, F.lit(INLINE_CODE), F.lit(1))), looks)
    told = F.filter(clean(F.regexp_extract_all(rest, F.lit(TOLD_COMMAND), F.lit(1))), looks)
    typed = clean(F.regexp_extract_all(response, F.lit(TYPED_COMMAND), F.lit(1)))
    return F.array_distinct(F.concat(lines, inline, told, typed))


def command_allowed(command: Column, allowed: Column, compat: bool = False) -> Column:
    """Whether a command is on an allow-list: as it stands, or with further arguments.

    ``compat`` keeps the looser rules: a prefix need not end at a word, ``npm`` commands agree on their second word.
    """
    cmd = F.regexp_replace(command, r"^\s+|\s+$", "")
    second = lambda x: F.coalesce(F.get(F.split(x, r"\s+", -1), F.lit(1)), F.lit(""))
    args = lambda x: F.array_join(F.slice(F.filter(F.split(x, r"\s+", -1), lambda w: w != ""), 2, 10_000), " ")

    def fits(p: Column) -> Column:
        begins = cmd.startswith(p) if compat else (cmd == p) | cmd.startswith(F.concat(p, F.lit(" ")))
        python = p.startswith("python ") & (cmd.startswith("python ") | cmd.startswith("python3 ")) & (args(p) == args(cmd))
        out = begins | python
        return out | (p.startswith("npm ") & cmd.startswith("npm ") & (second(p) == second(cmd))) if compat else out

    return F.coalesce(F.exists(allowed, fits), F.lit(False))


def diff_counts(diff: Column) -> Column:
    lines = F.split(diff, "\n", -1)
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return F.struct(added.alias("added"), removed.alias("removed"))


def commit_confidence(diff_length: Column, n_extensions: Column, title: Column) -> Column:
    """Trust in a commit message: 0.8, moved by tenths for size of diff, kinds of files and form of title, in [0.1, 1]."""
    score = (
        F.lit(0.8)
        + F.when((diff_length < 100) | (diff_length > 5000), -0.1).otherwise(0.0)
        + F.when(n_extensions == 1, 0.1).when(n_extensions > 5, -0.1).otherwise(0.0)
        + F.when(F.lower(title).rlike("^(?:" + "|".join(COMMIT_TYPES) + ")"), 0.1).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 6)


def json_object(text: Column) -> Column:
    """The text from its first brace to its last; null if there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_list_or_text(text: Column, element: str = "string") -> Column:
    """A JSON list of ``element``, or the raw text as its only item."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.array(text))


def repository_of(url: Column) -> Column:
    """Owner and name of a repository from its https or ssh address."""
    pattern = r"[/:]([^/:]+)/([^/]+?)(?:\.git)?/?$"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("name"))


def first_hop(forwarded: Column, peer: Column) -> Column:
    """Client of a request: the first address that proxies report, else the peer."""
    hop = F.trim(F.get(F.split(forwarded, ",", -1), F.lit(0)))
    return F.coalesce(F.when(hop != "", hop), peer)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def filled(template: Column, values: Column) -> Column:
    """``template`` with each ``${name}`` replaced by the map's value of that name; unknown names stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def mime_allowed(mime: Column, patterns: Sequence[str]) -> Column:
    """Whether a type is on a list whose items may end in ``*``."""
    out = F.lit(False)
    for p in patterns:
        out = out | (mime.startswith(p[:-1]) if p.endswith("*") else mime == p)
    return out


def issue_list(**conditions: Column) -> Column:
    """The names of the conditions that hold, as an array of sentences."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name.replace("_", " "))) for name, c in conditions.items()]))


# What is said about a repository's state; the first four with their number.
HEALTH = (
    ("uncommitted", "uncommitted changes", "Consider committing or stashing changes"),
    ("untracked", "untracked files", "Add important files to Git or update .gitignore"),
    ("ahead", "commits ahead of remote", "Push changes to remote repository"),
    ("behind", "commits behind remote", "Pull latest changes from remote repository"),
)
MANY_BRANCHES, TOO_MANY = 10, "Consider cleaning up old branches"


def repository_health(uncommitted: Column, untracked: Column, ahead: Column, behind: Column, branches: Column) -> Column:
    """(issues, suggestions) of a repository from its counts; a null count says nothing."""
    counts = {"uncommitted": uncommitted, "untracked": untracked, "ahead": ahead, "behind": behind}
    issues = [F.when(counts[k] > 0, F.concat(counts[k].cast("string"), F.lit(f" {said}"))) for k, said, _ in HEALTH]
    advice = [F.when(counts[k] > 0, F.lit(what)) for k, _, what in HEALTH] + [F.when(branches > MANY_BRANCHES, F.lit(TOO_MANY))]
    return F.struct(F.array_compact(F.array(*issues)).alias("issues"), F.array_compact(F.array(*advice)).alias("suggestions"))
