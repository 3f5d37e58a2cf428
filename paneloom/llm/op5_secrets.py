"""Secrets in whole texts: fixed patterns, and strings that a tokenizer cannot shorten.

A vocabulary of byte pairs learned from prose and code needs few tokens for words and many for
random strings. A run of key-like characters with few characters per token is reported as
``random``, unless it is a digest, a UUID or a number or overlaps a pattern's span.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .base import query, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"  # runs are maximal, so a least length drops the shorter ones
RUN = r"[A-Za-z0-9+/_-]{20,}"
# Which texts need a closer look, for RE2: a text without a match has no span of the kind.
MAY = {"assign": "(?i)" + ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "random": r"[A-Za-z0-9+/_-]{20}"}
PATTERNS = {"assign": re.compile(ASSIGN, re.I | re.A), "access": re.compile(ACCESS), "hex": re.compile(HEX)}
CANDIDATE = re.compile(RUN)
# Digests (by length in hexadecimal digits, also with a prefix, or in base64 after one), short hashes of commits,
# UUIDs, ISBNs, and numbers with marks (dates, phone numbers, rules of marks: a token holds few digits, so
# their ratio tells nothing). Words and names are left to the ratio.
KNOWN = re.compile(
    r"(?:(?:md5|sha-?(?:1|224|256|384|512)|commit|git|rev)[-_/])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|sha-?(?:1-[a-z0-9+/]{27}|224-[a-z0-9+/]{38}|256-[a-z0-9+/]{43}|384-[a-z0-9+/]{64}|512-[a-z0-9+/]{86})"
    r"|(?:[a-z]+[-_/])*(?:commit|git|rev)[-_/][0-9a-f]{7,40}"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    r"|(?:[a-z]+[-_/])*isbn(?:-1[03])?[-_/]?[0-9x-]{10,17}"
    r"|[0-9_+/-]+", re.I | re.A)
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
SEQUENCES = (LETTERS * 2 + DIGITS, DIGITS + LETTERS * 2)  # the plain alphabet, with digits before or after
CHARS_PER_TOKEN = 2.0  # fewer than so many mark a string as random
MARK = "[SECRET]"

Span = tuple[int, int, str]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The tiktoken encoder of a rank file; one for each worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> tuple[str, str]:
    """Path and split pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pattern_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping within a kind; whole matches."""
    found = [(m.start(), m.end(), "assign") for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in PATTERNS["access"].finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in PATTERNS["hex"].finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def known(run: str) -> bool:
    """Whether a run is a digest, an identifier, a number or a stretch of the alphabet."""
    return bool(KNOWN.fullmatch(run)) or any(run.lower().rstrip("+/_-") in s for s in SEQUENCES)


def random_spans(text: str, taken: list[Span], words) -> list[Span]:
    """Runs of key-like characters with few characters per token that no taken span overlaps.

    Runs and taken spans are both walked in the order of their starts.
    """
    found = []
    at, reach = 0, 0  # taken spans that start before a run's end, and the furthest end among them
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        run = m[0]
        if reach > m.start() or known(run):
            continue
        if len(run) < CHARS_PER_TOKEN * len(words.encode_ordinary(run)):
            found.append((m.start(), m.end(), "random"))
    return found


def _suspects(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that may have a pattern's span, and of those that may have a random run."""
    hits = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False).astype(bool) for k, p in MAY.items()}
    return hits["assign"] | hits["access"] | hits["hex"], hits["random"]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then in the order of the
    kinds. A null or empty text has none (the hash is that of an empty string). ``files``: path of
    a rank file and its split pattern. Null ids and repeated rows stay; more columns are ignored.
    """
    files = files or vocabulary()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = len(batch)
            counts = np.zeros((4, n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            fixed, free = _suspects(texts)
            for i in np.flatnonzero(fixed | free):
                text = texts[i].as_py()
                base = pattern_spans(text) if fixed[i] else []
                more = random_spans(text, base, encoder(*files)) if free[i] else []
                for _, _, kind in base + more:
                    counts[KINDS.index(kind), i] += 1
                if base:
                    digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of (overlapping) spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced by ``MARK``; n_chars, if there, follows.

    Every row and every other column stays; null and clean texts are left as they are.
    """
    files = files or vocabulary()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fixed, free = _suspects(pc.fill_null(texts, ""))
            hit = np.flatnonzero(fixed | free)
            if len(hit):
                all_ = texts.to_pylist()
                for i in hit:
                    base = pattern_spans(all_[i]) if fixed[i] else []
                    more = random_spans(all_[i], base, encoder(*files)) if free[i] else []
                    all_[i] = redact(all_[i], base + more)
                texts = pa.array(all_, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row", "text"])

    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(clean, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    values = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("row").getField("text").cast("string"))
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*[value.alias(c) for c, value in values.items()])


@query("op5_secrets")
def op5_secrets(spark, sf_dir):
    """Secrets of all documents."""
    return scan(table(spark, sf_dir, "documents"))
