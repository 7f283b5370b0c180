"""Token counts of a unigram tokenizer by dynamic programming over a shared trie.

A text is cut into pre-tokens; the distinct pre-tokens of a batch are put into a trie, each node of which is
one byte. The forward score of a node, the best score of any segmentation of the bytes from the root to it,
needs only the scores above it: it is computed once for all pre-tokens that begin that way, with the number of
pieces in the best segmentation. Where a pre-token ends, its count is stored. The trie is walked depth first
over the sorted pre-tokens, so the open path is all that is held.

The vocabulary is a public rank file: a piece of rank r scores -log(r + 2), Zipf's law without its constant,
plus a constant cost for each piece, as the logarithm of the harmonic sum does. Nothing is trained. All single
bytes are in the vocabulary, so every text can be segmented.

Defined results. Ties of the score go to fewer pieces. A null or empty text has 0 pre-tokens and 0 tokens.
Texts are counted whole. Repeated rows each give a row. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import map_texts

#: The pattern that splits texts before segmentation (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts of pre-tokens that a worker keeps; longer pre-tokens aren't kept.
KEPT, KEPT_BYTES = 400_000, 64


class Counter:
    def __init__(self, costs: dict[bytes, int]):
        """costs: integer cost of each piece; the cheapest segmentation is counted, ties by fewer pieces."""
        self.costs = costs
        self.longest = max(map(len, costs))
        self.known: dict[str, int] = {}
        self.split = regex.compile(PATTERN)

    def walk(self, sorted_words: Iterable[bytes]) -> dict[bytes, int]:
        """Number of pieces of each word; the words come sorted and distinct."""
        path, scores = b"", [0]  # scores[d]: cost * 2**20 + pieces of the best segmentation of path[:d]
        counts, costs, longest = {}, self.costs, self.longest
        for word in sorted_words:
            depth, most = 0, min(len(path), len(word))
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del scores[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                best = None
                for start in range(max(0, end - longest), end):
                    cost = costs.get(word[start:end])
                    if cost is not None and (best is None or scores[start] + cost < best):
                        best = scores[start] + cost
                scores.append(best)
            counts[word] = scores[len(word)] & 0xFFFFF if len(word) < 1 << 20 else None
            path = word
        return counts

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.known) > KEPT:
            self.known.clear()
        known, parts = self.known, [self.split.findall(t) for t in texts]
        new = {p for own in parts for p in own if p not in known}
        by_bytes = {p.encode("utf-8", "surrogatepass"): p for p in new}
        fresh = {by_bytes[b]: n for b, n in self.walk(sorted(b for b in by_bytes if len(b) < 1 << 19)).items()}
        fresh |= {p: self.long(b) for b, p in by_bytes.items() if len(b) >= 1 << 19}
        known.update(fresh)
        out = [(len(own), sum(map(known.__getitem__, own))) for own in parts]
        for p in [p for p in fresh if len(p) > KEPT_BYTES]:
            del known[p]
        return out

    def long(self, word: bytes) -> int:
        """The same for a word whose number of pieces needs more bits: pairs instead of packed numbers."""
        scores = [(0, 0)]
        for end in range(1, len(word) + 1):
            scores.append(min((scores[s][0] + (self.costs[word[s:end]] >> 20), scores[s][1] + 1) for s in range(max(0, end - self.longest), end) if word[s:end] in self.costs))
        return scores[-1][1]


@lru_cache(2)
def counter(path: str) -> Counter:
    """Costs are rounded to integers of a thousandth, so that sums are exact and ties are ties."""
    costs = {}
    with open(path, "rb") as file:
        for line in file:
            piece, rank = line.split()
            costs[base64.b64decode(piece)] = (round(1000 * (math.log(int(rank) + 2) + math.log(math.log(50_000)))) << 20) + 1
    return Counter(costs)


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document. path: the rank file, there on every executor."""

    def run(keys: list, texts: list[str]) -> dict[str, list]:
        done = counter(path).count(texts)
        return {"doc_id": keys, "n_pretokens": [a for a, _ in done], "n_tokens": [b for _, b in done]}

    return map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), "doc_id bigint, n_pretokens bigint, n_tokens bigint", run)
