"""Secret scans by token efficiency.

A base scan finds assignments of secrets, access key ids and long hexadecimal runs by fixed patterns. The token
efficiency test then looks at every unbroken run of at least ``least_run`` key characters: ordinary words and identifiers
take few tokens of a byte-pair vocabulary for their length, random strings about one token for every two characters or
fewer; of what is shorter than ``LONG_RUN`` characters, it takes more tokens still to look random. A run is cut
at ``=`` into names and values, and those at ``+``, ``/``, ``_`` and ``-`` into parts. Neighbouring parts that have few
characters a token together are reported as ``random``, so a key is found beside its name or path, and whole if it has
such characters itself. Known digests (hexadecimal of a digest's length) and UUIDs belong to no such span, numbers count
as one token, and what lies in a span of the base scan isn't reported again; of what is left only the vocabulary tells
names from keys. Spans count code points; their ends are exclusive.

Defined cases: null and empty texts have no spans; texts are read whole whatever their length; repeated rows and ids
come out once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.common import byte_lists, ship

# The patterns of the base scan, the least lengths, and the kinds in their order.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = frozenset((16, 32, 40, 56, 64, 96, 128))
KEYWORDS = (b"passw", b"secret", b"token", b"api")

LEAST_RUN, LONG_RUN = 12, 20
MOST_CHARS, MOST_CHARS_SHORT = 2.2, 1.7  # a token, of random runs and of those under LONG_RUN characters
RUN_BYTES = bytes(b if re.match(rb"[A-Za-z0-9+/_=-]", bytes([b])) else 32 for b in range(256))
DIGEST = re.compile(r"[0-9a-fA-F]+\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
VALUE = re.compile(r"[A-Za-z0-9+/_-]+")
PART = re.compile(UUID.pattern.removesuffix(r"\Z") + r"(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: Parts are this long on the mean, or they are too short for the vocabulary to tell anything.
LEAST_PART = 3.0


@functools.cache
def encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The vocabulary of ranks at ``path``, split by ``pattern``, with ``added`` tokens (literal, id)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def surplus(part: str, enc: tiktoken.Encoding, most: float) -> float:
    """How many more characters ``most`` a token would give than the part has: above 0 if it looks random."""
    if UUID.match(part) or (DIGEST.match(part) and len(part) in DIGEST_LENGTHS and not part.isdigit()):
        return -math.inf
    return most * (1 if part.isdigit() else len(enc.encode_ordinary(part))) - len(part)


def best_stretches(scores: list[float]) -> list[tuple[int, int]]:
    """(first, end) of the disjoint stretches with the largest sums, each above 0 (Ruzzo and Tompa), in linear time."""
    out: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum with it, the last one with less before
    total, floor = 0.0, 0
    for i, score in enumerate(scores):
        if score == -math.inf:  # no stretch crosses it
            total, floor = 0.0, len(out)
        elif score <= 0:
            total += score
        if score <= 0:
            continue
        first, low, total = i, total, total + score
        while True:
            j = len(out) - 1
            while j >= floor and out[j][2] >= low:
                j = out[j][4]
            if j < floor or out[j][3] >= total:
                out.append((first, i + 1, low, total, j))
                break
            first, low = out[j][0], out[j][2]
            del out[j:]
    return [(first, end) for first, end, *_ in out]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches that are too short are dropped after they are taken."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]


#: Runs are taken whole, so this finds what HEX finds once short ones are dropped.
HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)


@functools.cache
def runs_of(least: int) -> re.Pattern[str]:
    return re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % least)


def merged_spans(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that (start, kind, end) spans in order cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def random_spans(text: str, base: list[tuple[int, int, int]], enc: tiktoken.Encoding, most: float, least_run: int) -> list[tuple[int, int, int]]:
    out = []
    starts, ends = merged_spans(base)
    for run in runs_of(least_run).finditer(text):
        for value in VALUE.finditer(text, run.start(), run.end()):
            if value.end() - value.start() < least_run:
                continue
            parts = list(PART.finditer(text, value.start(), value.end()))
            for first, end in best_stretches([surplus(p[0], enc, most) for p in parts]):
                s = parts[first].start() if first else value.start()  # separators at the ends of a value may be the key's
                e = parts[end - 1].end() if end < len(parts) else value.end()
                k = bisect_right(ends, s)  # the first stretch of the base that ends after s
                if e - s < max(least_run, LEAST_PART * (end - first)) or k < len(starts) and starts[k] < e:
                    continue
                if e - s >= LONG_RUN or sum(surplus(p[0], enc, min(most, MOST_CHARS_SHORT)) for p in parts[first:end]) > 0:
                    out.append((s, 3, e))
    return out


def scan(text: bytes | None, enc: tiktoken.Encoding, most: float = MOST_CHARS, least_run: int = LEAST_RUN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the base scan and of the token efficiency test, both in order.

    Two cheap looks save most texts from the patterns: every pattern but the assignment's needs a run of ``least_run``
    (or 20) key characters, and an assignment needs a keyword.
    """
    if not text:
        return [], []
    low = text.lower()
    keyword = any(k in low for k in KEYWORDS)
    runs = max(map(len, text.translate(RUN_BYTES).split()), default=0) >= min(least_run, LEAST_ACCESS, LEAST_HEX)
    if not keyword and not runs:
        return [], []
    whole = text.decode("utf-8", "replace")
    base = sorted(base_spans(whole))
    return base, random_spans(whole, base, enc, most, least_run) if runs else []


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secret_report(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id", most_chars_per_token: float = MOST_CHARS, least_run: int = LEAST_RUN
) -> DataFrame:
    """Per document: counts by kind, n_random, base_sha256 and the spans as ``kind:start:end``, comma-joined."""
    ship(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for t in byte_lists(batch.column(1)):
                base, more = scan(t, enc, most_chars_per_token, least_run)
                for kind, n in enumerate(counts):
                    n.append(sum(k == kind for _, k, _ in (*base, *more)))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed([*base, *more]))
            columns = [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(report, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def masked(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", mask: str = "[SECRET]", most_chars_per_token: float = MOST_CHARS, least_run: int = LEAST_RUN) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; overlapping spans are replaced as one."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            new = []
            for t in byte_lists(batch.column(at)):
                base, more = scan(t, enc, most_chars_per_token, least_run)
                if not base and not more:
                    new.append(t)
                    continue
                whole, out, upto = (t or b"").decode("utf-8", "replace"), [], 0
                for s, _, e in sorted([*base, *more]):
                    if s >= upto:
                        out += [whole[upto:s], mask]
                    upto = max(upto, e)
                new.append(("".join(out) + whole[upto:]).encode())
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(pa.string()))

    return docs.mapInArrow(replace, docs.schema)


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base scan by the patterns alone."""
    t, out = text or "", []
    for kind, pattern, least, group in (("assign", ASSIGN, LEAST_ASSIGN, 2), ("access", ACCESS, LEAST_ACCESS, 0), ("hex", HEX, LEAST_HEX, 0)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(t) if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))
