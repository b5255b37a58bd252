"""SentencePiece encoding and decoding with a lattice of pieces.

A text is cut where no piece of the model can reach across: before a run of
word marks, between letters and other characters, and, in units longer than
``LONG``, between any two characters that no piece has side by side, so that a
line of a script without spaces does not become one row. A task encodes each
unit once as it first meets it, and remembers words up to a bound: the edges of its
lattice (start, end, piece) come from the pieces that begin at each character, and are
folded into the path as they come. Documents are put together
from their words, so that no text and no unit travels: most words of a
collection are rare, and a dictionary of all of them, shuffled to the documents that
hold them, was larger than the texts.

The fold is a Viterbi pass whose transitions are allowed or not, as the models
at hand are of the merging kind: a path is the encoding exactly if each pair of
neighbours is, and a pair is unless some piece across their border would have
been merged before either side had used up the part that it needs. The ranks at
which the parts along a piece's left and right edge are used up (its spines)
tell that. Every prefix has one such path, so one edge is kept per position.

Characters without a piece become bytes.

A unit that cannot be cut, such as a run of Latin letters, is one row whatever
its length; one edge is kept for each of its characters.

Defined results: null and empty text has no ids; null doc_id and repeated rows
get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import table

MARK = "▁"
#: Units and words that a task remembers, documents that it hands on at once.
UNITS, WORDS, ROWS = 500_000, 200_000, 500
#: Pairs of neighbours whose verdict a task remembers.
PAIRS = 400_000
#: A rank beyond all ranks: never used up.
NEVER = 2**31 - 1
#: Characters of a unit beyond which it is cut wherever no piece reaches across.
LONG = 24
#: Edges of characters without a piece have the character's number from here on.
OTHERS = 1 << 20


class Model:
    """The pieces of a merging model with byte fallback, their ranks and spines."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.names = [sp.id_to_piece(i) for i in every]
        self.bytes = {int(self.names[i][3:5], 16): i for i in every if sp.is_byte(i)}
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.control = {i for i in every if sp.is_control(i)}
        # Higher scores merge first; equal pieces have equal ranks.
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.names[i]: order[sp.get_score(i)] for i in plain}
        self.longest = max(map(len, self.ids))
        #: Pieces that merges make, with their ranks; with their ids, and None for what they begin with.
        self.made = {p: r for p, r in self.rank.items() if self.tree(p) is not None}
        self.begun = {p[:k]: None for p in self.made for k in range(1, len(p))} | {p: self.ids[p] for p in self.made}
        pairs = self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        letter = lambda c: unicodedata.category(c)[0] == "L"
        if any(b == MARK and a != MARK for a, b in pairs):
            raise ValueError("pieces reach across word marks")
        #: Units, as a pattern that Java and Python read alike.
        self.unit = rf"{MARK}*(?:\p{{L}}+|[^\p{{L}}{MARK}]+)|{MARK}+"
        if any(a != MARK and letter(a) != letter(b) for a, b in pairs):
            self.unit = rf"{MARK}*[^{MARK}]+|{MARK}+"

    def parts(self, unit: str) -> list[str]:
        """The unit, cut where no piece reaches across if it is long."""
        if len(unit) <= LONG:
            return [unit]
        cuts = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.pairs), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def tree(self, piece: str) -> tuple | None:
        """(text, left, right) of the merges that make a piece, None if they don't."""
        nodes: list[tuple] = [(c, None, None) for c in piece]
        while len(nodes) > 1:
            ranks = [self.rank.get(a[0] + b[0], NEVER) for a, b in zip(nodes, nodes[1:], strict=False)]
            if (least := min(ranks)) == NEVER:
                return None
            k = ranks.index(least)
            nodes[k : k + 2] = [(nodes[k][0] + nodes[k + 1][0], nodes[k], nodes[k + 1])]
        return nodes[0]

    def spines(self, piece: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]] | None:
        """The parts along the right and the left edge of a piece, each with the rank at which it is used up; None if merges don't make the piece."""
        if piece not in self.ids:
            return ([(piece, NEVER)],) * 2
        if (top := self.tree(piece)) is None:
            return None
        found = []
        for side in (2, 1):
            node, used, spine = top, NEVER, []
            while node is not None:
                spine.append((node[0], used))
                used, node = self.rank.get(node[0], NEVER), node[side]
            found.append(spine)
        return found[0], found[1]

    def raw(self) -> list[bytes]:
        """The UTF-8 that each id stands for, marks included."""
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        return [of_byte.get(i, b"" if i in self.control else p.encode()) for i, p in enumerate(self.names)]


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


class Transitions(dict):
    """Whether one edge may follow another, by their ids; remembers pairs up to a bound, then starts anew."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.sides = model, {}

    def side(self, i: int) -> tuple:
        if (found := self.sides.get(i)) is None:
            found = self.sides[i] = self.model.spines(chr(i - OTHERS) if i >= OTHERS else self.model.names[i])
        return found

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        found = self[pair] = self.fits(self.side(pair[0])[0], self.side(pair[1])[1])
        return found

    def fits(self, right: list[tuple[str, int]], left: list[tuple[str, int]]) -> bool:
        ranks = self.model.made
        for a, x in right:
            for b, y in left:
                if (r := ranks.get(a + b, NEVER)) < x and r <= y and r != NEVER:
                    return False
        return True


def folded(unit: str, begun: dict[str, int | None], allowed: Transitions) -> list[int]:
    """The ids along the path through the lattice of a unit, whose edges (start, end, id) are every character and every piece.

    Edges come by start: of those that end at one place the longest whose transition is allowed counts, and it comes first.
    """
    n = len(unit)
    last, begin = [-1] * (n + 1), [0] * (n + 1)
    for s in range(n):
        before = last[s]
        for e in range(s + 1, n + 1):
            piece = unit[s:e]
            if (i := begun.get(piece, -1)) == -1 and e > s + 1:
                break
            if last[e] < 0:
                if i is None or i < 0:
                    if e > s + 1:
                        continue
                    i = OTHERS + ord(piece)
                if not s or allowed[before, i]:
                    last[e], begin[e] = i, s
    out = []
    while n:
        out.append(last[n])
        n = begin[n]
    return out[::-1]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, round_trip (whether decoding gives the text again) for every row of docs."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if (tasks := docs.sparkSession.sparkContext.defaultParallelism) > own.rdd.getNumPartitions():
        own = own.repartition(tasks)

    def words(text: str | None) -> list[str]:
        """A text's words, each with the marks before it but the first one; units never reach across."""
        if not text:
            return []
        found = text.replace(MARK, " ").split(" ")
        if "" not in found:
            return found
        out, marks = [], -1
        for w in found:
            marks += 1
            if w:
                out.append(MARK * marks + w)
                marks = -1
        return out + [MARK * marks] * (marks >= 0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        pattern, allowed, raw = regex.compile(model.unit), Transitions(model), model.raw()

        class Units(dict):
            """The ids of a unit, as bytes."""

            def __missing__(self, unit: str) -> bytes:
                ids = folded(unit, model.begun, allowed)
                if max(ids) >= OTHERS:
                    ids = [j for i in ids for j in ((model.bytes[b] for b in chr(i - OTHERS).encode()) if i >= OTHERS else (i,))]
                if len(self) >= UNITS:
                    self.clear()
                found = self[unit] = np.array(ids, np.int32).tobytes()
                return found

        class Words(dict):
            """The ids of a word, as bytes."""

            def __missing__(self, word: str) -> bytes:
                if len(self) >= WORDS:
                    self.clear()
                found = self[word] = b"".join([units[x] for u in pattern.findall(MARK + word) for x in model.parts(u)])
                return found

        units, known = Units(), Words()
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column(1).to_pylist()
                ids = [np.frombuffer(b"".join(map(known.__getitem__, words(t))), np.int32) for t in texts]
                same = [decoded(x.tolist(), raw) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    return own.mapInArrow(look_up, "doc_id long, ids array<int>, round_trip boolean")


def decoded(ids: object, raw: list[bytes]) -> str:
    return b"".join([raw[i] for i in ids]).replace(MARK.encode(), b" ").removeprefix(b" ").decode("utf-8", "replace")


def decoder(path: str | None = None):
    """A column function: the text of an array of ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = load(path).raw()
        for ids in parts:
            yield pd.Series([None if x is None else decoded(x, raw) for x in ids], dtype=object)

    return decode


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text again."""
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
