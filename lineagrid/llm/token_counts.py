"""Token counts by a longest-match automaton.

A vocabulary has pieces that begin a word (written with a leading mark) and pieces that go on. The trie of both kinds carries, at each
node, a failure link and the number of tokens that greedy longest-match splitting gives away on following it: if a node's string cannot be
extended by the next character, the longest pieces that fit are popped from its front, and what remains is a node again. So
a word's number of tokens is found in one pass over its characters, without the pieces themselves.

A word that cannot be covered counts as one unknown token. Words repeat, and a bounded cache keeps their counts.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"
_CACHE = 500_000
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_", re.U)


def vocabulary(path: str) -> list[str]:
    """Pieces of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return [p.piece for p in m.pieces if p.type == 1]


class Automaton:
    """Numbers of tokens of greedy longest-match word pieces."""

    def __init__(self, pieces: list[str], mark: str = MARK):
        # node 0: before a word; node 1: after its first token. A leading mark is cut off and starts at node 0.
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for p in pieces:
            at, rest = (0, p[len(mark) :]) if p.startswith(mark) else (1, p)
            if not rest:
                continue
            for c in rest:
                at = self.next[at].setdefault(c, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    ends.append(False)
            ends[at] = True
        #: where a node's string leads once pieces are popped from its front (-1: it cannot be covered), and how many are popped
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                if ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
                todo.append(v)
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one word; 1 if it cannot be covered."""
        step, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in word:
            while (to := step[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n

    def counts(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = _WORD.findall(text or "")
        cache, total = self.cache, 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= 64:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    cache[w] = n
            total += n
        return len(words), total


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(vocabulary(path))
    return _automata[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens.

    Words are runs of letters and digits, and single other characters; white space is dropped. A null or empty text counts
    0 and 0. Repeated rows give repeated results; other columns are ignored. The vocabulary's path must be readable on the executors.
    No shuffle: rows stay where they are.
    """
    from .sentencepiece_codec import model_path

    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            found = [a.counts(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
