"""Commands as a shell would split them, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.functions.text import ALLOWED_COMMANDS, DANGEROUS, ascii_pattern

# Characters that no argument may have.
NOT_IN_ARGUMENTS = "|&;$`(){}<>\n\r"

PLAIN = re.compile(r"[^ \t\r\n'\"\\]+")
SPACE = re.compile(r"[ \t\r\n]+")
IN_DOUBLE = re.compile(r"[^\"\\]+")


def split_words(command: str | None) -> list[str] | None:
    """The words of a command by POSIX quoting; None if a quote or an escape has no end.

    White space ends a word. A backslash takes the next character as it is; between single quotes all is text; between
    double quotes a backslash stays unless a double quote or a backslash follows. Quotes of nothing are an empty word.
    A null command has no words.
    """
    if command is None:
        return []
    words: list[str] = []
    word: list[str] | None = None  # parts of the word that has begun
    at, n = 0, len(command)
    while at < n:
        if m := SPACE.match(command, at):
            if word is not None:
                words.append("".join(word))
                word = None
            at = m.end()
            continue
        word = [] if word is None else word
        if m := PLAIN.match(command, at):
            word.append(m[0])
            at = m.end()
        elif command[at] == "\\":
            if at + 1 == n:
                return None
            word.append(command[at + 1])
            at += 2
        elif command[at] == "'":
            end = command.find("'", at + 1)
            if end < 0:
                return None
            word.append(command[at + 1 : end])
            at = end + 1
        else:
            at += 1
            while at < n and command[at] != '"':
                if m := IN_DOUBLE.match(command, at):
                    word.append(m[0])
                    at = m.end()
                elif at + 1 < n:
                    word.append(command[at + 1] if command[at + 1] in '"\\' else command[at : at + 2])
                    at += 2
                else:
                    return None
            if at == n:
                return None
            at += 1
    return words if word is None else [*words, "".join(word)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_words(commands: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``split_words`` of a column, in Arrow batches."""
    for batch in commands:
        yield pd.Series([split_words(c) for c in batch], dtype=object)


def command_flags(command: Column, words: Column) -> Column:
    """Struct of what is known of a command and its ``shell_words``, and whether it is accepted.

    dangerous: a pattern is in the command; unreadable: its quotes don't close; metacharacters: one is in an argument, quoted
    or not; base: the program's own name, without folders; allowed_base: it is on the list. A command without words is none.
    """
    dangerous = F.coalesce(command.rlike(ascii_pattern("|".join(DANGEROUS))), F.lit(False))
    unreadable = words.isNull()
    some = F.coalesce(words, F.array().cast("array<string>"))
    meta = F.exists(some, lambda w: F.length(F.translate(w, NOT_IN_ARGUMENTS, "")) < F.length(w))
    base = F.when(F.size(some) > 0, F.regexp_extract(some[0], r"(?s)([^/\\]*)$", 1))
    known = F.coalesce(base.isin(*ALLOWED_COMMANDS), F.lit(False))
    return F.struct(
        dangerous.alias("dangerous"), unreadable.alias("unreadable"), meta.alias("metacharacters"), base.alias("base"), known.alias("allowed_base"),
        (~dangerous & ~unreadable & ~meta & known).alias("accepted"),
    )
