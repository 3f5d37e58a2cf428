"""Token counts by greedy longest match in time linear in the text.

A trie of the vocabulary gets, for each node, a failure link and the number of tokens that are
popped when the link is followed: if the text leaves the trie at a node, the longest tokens that
cover the front of the node's string are done, and what is left of it is the node that the link
leads to. Only their number is kept, so counts come without building pieces. Words are
``[^\\x20\\x09-\\x0D]+``; each is read with a space before it, as the vocabulary marks word starts.
Equal words of a run of texts are counted once, all of them side by side.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import query, table
from .op5_secrets import vocabulary
from .words import SPACE, runs, span_hashes, word_spans

START = b" "
RUN_BYTES = 4 << 20


@dataclass
class Automaton:
    """Edges as sorted keys node * 256 + byte; failure link (-1: none) and tokens popped of each node."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The child of each node by its byte, or -1."""
        wanted = nodes * 256 + data
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], -1)


def automaton(tokens: Iterable[bytes]) -> Automaton:
    """The automaton of a vocabulary; tokens with white space anywhere but one leading space match no word."""
    blank = {b for b in range(256) if SPACE[b]}
    children: list[dict[int, int]] = [{}]
    parent, byte, final = [0], [0], [False]
    for token in tokens:
        body = token[len(START):] if token.startswith(START) else token
        if not token or any(b in blank for b in body):
            continue
        node = 0
        for b in token:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                parent.append(node)
                byte.append(b)
                final.append(False)
            node = children[node][b]
        final[node] = True
    fail, pops = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:  # shorter strings first
        level = [child for node in level for child in children[node].values()]
        for v in level:
            if final[v]:
                fail[v], pops[v] = 0, 1
                continue
            z, n = fail[parent[v]], pops[parent[v]]
            while z >= 0 and byte[v] not in children[z]:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = children[z][byte[v]], n
    edges = sorted((node * 256 + b, child) for node, of in enumerate(children) for b, child in of.items())
    keys, targets = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.full(1, -1), np.full(1, -1))
    return Automaton(keys, targets, np.array(fail, np.int64), np.array(pops, np.int64))


def word_lengths(auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of each word; a word that the vocabulary cannot cover counts as one."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n = len(starts)
    state, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    unknown = np.zeros(n, bool)

    def feed(which: np.ndarray, symbols: np.ndarray) -> None:
        while len(which):
            target = auto.step(state[which], symbols)
            went = target >= 0
            state[which[went]] = target[went]
            which, symbols = which[~went], symbols[~went]
            stuck = auto.fail[state[which]] < 0
            unknown[which[stuck]] = True
            which, symbols = which[~stuck], symbols[~stuck]
            count[which] += auto.pops[state[which]]
            state[which] = auto.fail[state[which]]

    for b in START:
        feed(np.arange(n), np.full(n, b, np.int64))
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])) if n else np.empty(0, np.int64), "left")
    for j, some in enumerate(alive):  # words longer than j are the first ones
        which = np.flatnonzero(~unknown[:some])
        feed(which, data[starts[which] + j].astype(np.int64))
    rest = np.flatnonzero(~unknown & (state > 0))
    while len(rest):
        stuck = auto.fail[state[rest]] < 0
        unknown[rest[stuck]] = True
        rest = rest[~stuck]
        count[rest] += auto.pops[state[rest]]
        state[rest] = auto.fail[state[rest]]
        rest = rest[state[rest] > 0]
    out = np.empty(n, np.int64)
    out[order] = np.where(unknown, 1, count)
    return out


def read_tokens(path: str) -> list[bytes]:
    """The tokens of a tiktoken rank file."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


def count_tokens(docs: DataFrame, tokens: Iterable[bytes] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text of ``docs`` (doc_id, text).

    A null, empty or wordless text has 0 of both. Null ids and repeated rows stay, more columns are
    ignored, an empty table gives no rows. ``tokens``: the vocabulary, by default a public one.
    """
    auto = automaton(read_tokens(vocabulary()[0]) if tokens is None else tokens)
    shared = docs.sparkSession.sparkContext.broadcast(auto)  # as large as the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for first, last, data, offsets in runs(batch.column(1), RUN_BYTES):
                starts, ends, at = word_spans(data, offsets)
                _, sample, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                tokens_of = word_lengths(shared.value, data, starts[sample], ends[sample])[which]
                words[first:last] = np.diff(at)
                counts[first:last] = np.diff(np.concatenate([[0], np.cumsum(tokens_of)])[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(counts)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n_words long, n_tokens long")


@query("op2_tokens")
def op2_tokens(spark, sf_dir):
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
