"""Secret scans: pattern rules, and beyond them zstandard novelty: the bytes that a candidate adds to the compressed code
around it, with dictionaries of that code and of common identifiers; what stays incompressible in a sensitive context is
reported."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm.common import pick, read

# The kinds in the order in which spans of one start are listed, and the rules' patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more: the pattern takes whole runs, so shorter ones need no match

#: Words that make the text near them a sensitive context.
SENSITIVE = re.compile(r"password|passwd|secret|token|credential|api_?key|private_?key|access_?key|authorization|bearer|signature", re.ASCII | re.IGNORECASE)
#: Strings that may be secrets: long, without spaces, and not of letters alone in one case.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Identifiers and words that code is full of; compression with this dictionary makes strings made of them cheap.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key credential authorization bearer signature username user_id "
    "client_id client_secret session_id request response response_code config configuration settings environment variable production development staging "
    "localhost example.com http:// https:// www. .com .org application/json content-type charset=utf-8 utf-8 base64 sha256 md5 true false null none "
    "import from return function class const let var public private static void string integer boolean array object default export module require "
    "self.this. getElementById querySelector addEventListener constructor prototype undefined console.log print println printf format exception error "
    "warning message description version timestamp created_at updated_at deleted_at index identifier database connection connection_string host port "
    "path file filename directory placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ ----BEGIN ----END"
)
#: Characters of context on each side, and the share of its own length that a candidate must add to be reported.
CONTEXT, NOVEL = 256, 0.6


class Novelty:
    """Marginal compressed bytes of strings, given the text around them."""

    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        self._identifiers = identifiers.encode()
        self._empty = len(zstandard.ZstdCompressor(level=3).compress(b""))

    def measure(self, candidate: str, before: str, after: str) -> float:
        """Bytes that the candidate adds to a frame primed with the identifiers and the code around it, for each of its own."""
        near = (after + "\n" + before).encode("utf-8", "replace")
        primed = zstandard.ZstdCompressionDict(self._identifiers + near, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own = candidate.encode("utf-8", "replace")
        made = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(own)
        return max(0, len(made) - self._empty) / max(1, len(own))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three rules, leftmost and non-overlapping for each."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def _pieces(start: int, end: int, words: list[tuple[int, int]], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What sensitive words leave of a run of characters, where it is long enough for a candidate."""
    i = bisect_right(ends, start)
    while i < len(words) and words[i][0] < end:
        if words[i][0] - start >= LEAST:
            yield start, words[i][0]
        start, i = words[i][1], i + 1
    if end - start >= LEAST:
        yield start, end


def novel_spans(text: str, taken: list[tuple[int, str, int]], novelty: Novelty, least: float = NOVEL) -> list[tuple[int, str, int, float]]:
    """Candidates that begin within CONTEXT characters of a sensitive word, before or after it, that no rule covers and that do not
    compress. Other copies of a candidate are no context: they would make it cheap at each of its places."""
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    covered: list[list[int]] = []
    for a, _, b in sorted(taken):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    out, ends = [], [b for _, b in words]
    for m in CANDIDATE.finditer(text):
        for start, end in _pieces(m.start(), m.end(), words, ends):
            s, near = text[start:end], bisect_right(ends, start - CONTEXT)  # the first word that ends less than CONTEXT before
            if near == len(words) or words[near][0] - CONTEXT > start or (s.isalpha() and (s.islower() or s.isupper())):
                continue
            before = bisect_left(starts, end) - 1
            if before >= 0 and covered[before][1] > start:
                continue
            blank, far = "\n" * len(s), CONTEXT + len(s)
            share = novelty.measure(s, text[max(0, start - far) : start].replace(s, blank)[-CONTEXT:], text[end : end + far].replace(s, blank)[:CONTEXT])
            if share >= least:
                out.append((start, "novel", end, share))
    return out


def _listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan(docs: DataFrame, least: float = NOVEL) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans (kind:start:end, code
    points, end exclusive, comma-joined by start, then kind) and max_novelty. Null and empty texts have no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            rows = []
            for value in b.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty, least)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + [m[:3] for m in more]), max((m[3] for m in more), default=None)))
            types = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "n_novel": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "max_novelty": pa.float64()}
            yield pa.record_batch({"doc_id": b.column(0)} | {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())})

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, max_novelty double")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
