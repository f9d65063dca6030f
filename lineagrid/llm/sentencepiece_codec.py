"""SentencePiece encoding (byte-pair merges) by a table of each prefix's last token, and decoding.

Every prefix of a text has one byte-pair encoding, and the encodings of its prefixes nest: the last token of the encoding of a
prefix determines the rest. So one forward pass fills a table: the automaton gives all pieces that end at a position, and the
right one is the one that is compatible with the last token of the prefix before it, that is, whose pair no merge would have
formed otherwise. The ids are then recovered backwards.

Pieces never hold the space mark after another character, so a text falls into chunks (spaces, then non-spaces) that no
merge crosses; characters that no longer piece holds stand alone as well. Chunks repeat, and a bounded cache keeps their ids.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"
_CACHE = 400_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of one model file (byte-pair kind with byte fallback and an identity normaliser)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or m.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only byte-pair models with an identity normaliser are supported")
        self.dummy = m.normalizer_spec.add_dummy_prefix
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        named = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 3}
        self.bos, self.eos = named[m.trainer_spec.bos_piece], named[m.trainer_spec.eos_piece]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_ids = set(self.byte.values())
        normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that hold a space after another character are not supported")
        self.ids = {p: i for p, (i, _) in normal.items()}
        self.score = {p: s for p, (_, s) in normal.items()}
        self.inner = {c for p in normal if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in sorted(self.inner - {MARK}))
        #: spaces then characters that merge, or one character that never does
        self.chunk = re.compile(f"{MARK}+[{alone}]*|[{alone}]+|[^{alone}]", re.S)
        # tokens by number: pieces keep their ids, characters without a piece get numbers beyond
        self.text = [p.piece for p in m.pieces]
        self.number = dict(self.ids)
        for c in sorted(self.inner - self.ids.keys()):
            self.number[c] = len(self.text)
            self.text.append(c)
        order = {s: r for r, s in enumerate(sorted({-s for s in self.score.values()}))}
        self.rank = {p: order[-s] for p, s in self.score.items()}
        #: of each token, when it is formed (-1: a character) and the parts of its last merge
        self.born = [self.rank.get(t, -1) if len(t) > 1 else -1 for t in self.text]
        self.parts: list[tuple[int, int] | None] = [None] * len(self.text)
        self.automaton = ahocorasick.Automaton()
        self.ordered = True
        for p in normal:
            if len(p) > 1 and (two := self.split(p)):
                self.parts[self.ids[p]] = two
                self.ordered &= max(self.born[two[0]], self.born[two[1]]) < self.rank[p]
                self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.out = [self._surface(i, p) for i, p in enumerate(m.pieces)]

    def _surface(self, i: int, p) -> bytes:
        if p.type == 6:
            return bytes([int(p.piece[1:-1], 16)])
        if p.type == 3:
            return b""
        return " ⁇ ".encode() if p.type == 2 else p.piece.replace(MARK, " ").encode()

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The byte-pair encoding of a short string by its definition, and the last merge; only for pieces and pairs of pieces."""
        sym, last = list(text), None
        while len(sym) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            last = (sym[i], sym[i + 1])
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
        return sym, last

    def split(self, piece: str) -> tuple[int, int] | None:
        """The two parts of a piece's last merge; None for a piece that merges never form."""
        sym, last = self.merges(piece)
        return (self.number[last[0]], self.number[last[1]]) if len(sym) == 1 and last else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their characters are merged together.

        The tokens that touch the seam are taken apart again, latest merge first; the pair is lost if those on its two
        sides would have merged before the next merge that is known to have happened (of equal merges the left one is first).
        """
        text, rank, born = self.text, self.rank, self.born
        if not self.ordered:
            return self.merges(text[left] + text[right])[0] == [text[left], text[right]]
        until = len(rank) + 1
        while True:
            if rank.get(text[left] + text[right], until) < until:
                return False
            if born[left] > born[right]:
                until = born[left]
                left = self.parts[left][1]
            elif born[right] >= 0:
                until = born[right] + 1
                right = self.parts[right][0]
            else:
                return True

    def tokens(self, chunk: str) -> list[int]:
        """Token numbers of a chunk, by the prefix table: the automaton gives matches by end, the longest first."""
        last = [self.number[c] for c in chunk]
        pairs, done = self.pairs, -1
        for end, (n, token) in self.automaton.iter(chunk):
            if end == done:
                continue
            before = end - n
            if before >= 0:
                key = last[before] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= _CACHE:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(last[before], token)
                if not fits:
                    continue
            last[end] = token
            done = end
        out = []
        at = len(chunk) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.text[last[at]])
        return out[::-1]

    def _encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for t in self.tokens(chunk) if len(chunk) > 1 else [self.ids.get(chunk, -1)]:
            if 0 <= t < len(self.out):
                ids.append(t)
            elif self.byte:
                ids += (self.byte[b] for b in (self.text[t] if t >= 0 else chunk).encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unk)
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, begin and end included, as little-endian unsigned 32-bit integers."""
        parts = [np.uint32(self.bos).tobytes()]
        if text:
            cache = self.cache
            for c in self.chunk.findall((MARK if self.dummy else "") + text.replace(" ", MARK)):
                ids = cache.get(c)
                if ids is None:
                    ids = self._encode_chunk(c)
                    if len(c) <= 64:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        cache[c] = ids
                parts.append(ids)
        parts.append(np.uint32(self.eos).tobytes())
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; begin, end and the space that encoding puts in front are dropped."""
        data = b"".join(map(self.out.__getitem__, ids.tolist()))
        if self.dummy and data[:1] == b" " and self._first_is_space(ids):
            data = data[1:]
        return data.decode("utf-8", "replace")

    def _first_is_space(self, ids: np.ndarray) -> bool:
        for i in ids.tolist():
            if self.out[i]:
                return i not in self.byte_ids
        return False


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    A null or empty text has the begin and end ids alone and decodes to an empty text. Repeated rows give repeated results;
    other columns are ignored. The model's path must be readable on the executors. No shuffle: rows stay where they are.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, sha, back, all_ids = [], [], [], []
            for t in b.column(1):
                raw = c.encode(t.as_py())
                ids = np.frombuffer(raw, dtype="<u4")
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
