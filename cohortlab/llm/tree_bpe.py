"""Byte-pair encoding and decoding, whole texts, equal to the tokenizers library.

Every text is encoded by *tree concatenation*: it is halved, wherever the halves fall, down to leaves of ``LEAF``
characters; leaves are encoded on their own (each distinct unit between spaces once, by the library) and joined pairwise up
the tree. The halves of a long text, down to stretches of ``SPREAD`` characters, are rows that any task may encode; the
same tree goes on over them, so where a leaf is encoded changes nothing but the place.

A join encodes windows around the cut anew, and widens them until both sides agree with what stood there:

1. *Pieces* (what the pre-tokenizer never joins). The window begins where a piece of the left side begins that nothing
   right of the cut can change: the pattern looks at most two characters past the end of a piece, and a special token
   has no more than its own length. It ends once it has an end of a piece, as far from its own end, which is one on the
   right side as well: from there on the pattern, which only looks ahead, goes the same way.
2. *Tokens*, where the last piece on the left and the first on the right grow together. Windows of 1, 2, 4, ... tokens to
   either side are merged anew until the first and last new token equal the tokens that stood there. Tokens are the
   encoding of their text when every two neighbours are the encoding of theirs; left of the window, inside it and right
   of it that holds, and agreement at its ends makes it hold across them. A window that has grown to a whole side has no
   neighbour there to agree with.

Defined cases: a null text is empty; an empty text has no ids and decodes to the empty text; special tokens in a text
are found as the library finds them; rows that repeat and null ids are each encoded on their own; a text of any length is
encoded whole, a task holds ``SPREAD`` characters of it and, where its halves meet, its ids; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bytes, frame, save
from ._units import VISIBLE, UnitEncoder, encoder, spaced_cuts

#: Characters of a leaf, and of a stretch that is a row of its own.
LEAF, SPREAD = 512, 1 << 16

Encode = Callable[[str], list[int]]


def join_exact(left: list[int], right: list[int], encode: Encode, text_of: Callable[[list[int]], str]) -> list[int]:
    """The encoding of two neighbouring texts that no pre-tokenizer parts, from their encodings."""
    if not left or not right:
        return left + right
    k = 1
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = encode(text_of(left[-a:] + right[:b]))
        if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[:-a] + window + right[b:]
        k *= 2


def pairwise(parts: list, join: Callable) -> list:
    """Join neighbours, level by level."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Halve until no part is longer than ``leaf``."""
    done, todo = [], [text]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            done.append(part)
        else:
            half = len(part) // 2
            todo += [part[half:], part[:half]]
    return done


class Open:
    """A unit at an end of a node, which may grow: its text, and its pieces with their ids once they are asked for."""

    __slots__ = ("ids", "pieces", "text")

    def __init__(self, text: str, ids: np.ndarray | None = None, pieces: list[tuple[str, list[int]]] | None = None):
        self.text, self.ids, self.pieces = text, ids, pieces

    def flat(self) -> np.ndarray:
        return self.ids if self.ids is not None else np.fromiter(chain.from_iterable(ids for _, ids in self.pieces), np.uint32)


class Node:
    """An encoded stretch: its first unit, the ids of the closed units after it, and its last unit if it has two."""

    __slots__ = ("body", "head", "tail")

    def __init__(self, head: Open, body: list[np.ndarray], tail: Open | None):
        self.head, self.body, self.tail = head, body, tail

    def flat(self) -> np.ndarray:
        return np.concatenate([self.head.flat(), *self.body, *([self.tail.flat()] if self.tail else [])])


class TreeEncoder(UnitEncoder):
    """``joins`` counts the joins of nodes, ``windows`` those of tokens inside a piece."""

    def __init__(self, path: str, leaf: int = LEAF):
        super().__init__(path, spaced_cuts)
        self.leaf, self.joins, self.windows = leaf, 0, 0
        text = {v: k for k, v in VISIBLE.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special_ids = {s: self.tokenizer.token_to_id(s) for s in self.special}
        self.some_special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        #: characters past the end of a piece that may have a say in it
        self.guard = max([2, *map(len, self.special)])
        self.visible = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.visible[i] = token
        ids = {i: s for s, i in self.special_ids.items()}
        self.bytes = pa.array([ids[i].encode() if i in ids else bytes(text[c] for c in t) for i, t in enumerate(self.visible)], pa.large_binary())
        self.widths = np.diff(np.frombuffer(self.bytes.buffers()[1], np.int64))

    def _merges(self, visible: str) -> list[int]:
        return [t.id for t in self.model.tokenize(visible)]

    def _visible(self, ids: list[int]) -> str:
        return "".join([self.visible[i] for i in ids])

    def encode_piece(self, piece: str) -> list[int]:
        """A piece of the pre-tokenizer, by the tree of its bytes."""
        visible = piece.encode().decode("latin-1").translate(VISIBLE)
        found = [self._merges(p) for p in leaves(visible, 4 * self.leaf)]
        return pairwise(found, lambda a, b: join_exact(a, b, self._merges, self._visible))[0]

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, special tokens among them, as the library cuts."""
        out: list[str] = []
        for part in (p for p in self.some_special.split(text) if p):
            if part in self.special_ids:
                out.append(part)
            else:
                out += [part[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _of(self, piece: str) -> list[int]:
        return [self.special_ids[piece]] if piece in self.special_ids else self.encode_piece(piece)

    def _pieces(self, unit: Open) -> list[tuple[str, list[int]]]:
        if unit.pieces is None:
            unit.pieces = [(p, self._of(p)) for p in self.cut(unit.text)]
        return unit.pieces

    def join_units(self, left: Open, right: Open) -> Open:
        """The encoding of two neighbouring stretches from their pieces, wherever the cut between them fell."""
        a, b = self._pieces(left), self._pieces(right)
        if not a or not b:
            return left if a else right
        k, size, many, wide = len(a), 0, 0, 0
        while k and size < self.guard:
            k -= 1
            size += len(a[k][0])
        ends: dict[int, int] = {}  # where pieces of the right side end, from the window's beginning
        while True:
            goal = max(2 * wide, self.guard)
            while many < len(b) and wide < goal:
                wide += len(b[many][0])
                many += 1
                ends[size + wide] = many
            window = self.cut("".join(p for p, _ in (*a[k:], *b[:many])))
            at, used = 0, None
            for i, piece in enumerate(window, 1):
                at += len(piece)
                if at in ends and (many == len(b) or at + self.guard <= size + wide):
                    used = i, ends[at]
                    break
            if used:
                break
        new: list[tuple[str, list[int]]] = []
        known = dict(a[k:]) | dict(b[: used[1]])
        for piece in window[: used[0]]:
            if piece in known:
                new.append((piece, known[piece]))
            elif piece == a[-1][0] + b[0][0] and piece not in self.special_ids:
                self.windows += 1
                new.append((piece, join_exact(a[-1][1], b[0][1], self._merges, self._visible)))
            else:
                new.append((piece, self._of(piece)))
        return Open(left.text + right.text, None, a[:k] + new + b[used[1] :])

    def join(self, left: Node, right: Node) -> Node:
        self.joins += 1
        seam = self.join_units(left.tail or left.head, right.head)
        if left.tail is None:
            return Node(seam, right.body, right.tail)
        if right.tail is None:
            return Node(left.head, left.body, seam)
        return Node(left.head, [*left.body, seam.flat(), *right.body], right.tail)

    def nodes(self, texts: list[str]) -> list[Node]:
        """The tree of every text."""
        split = [leaves(t, self.leaf) for t in texts]
        found = self.encode([leaf for parts in split for leaf in parts])
        first, at, out, j = found.texts.tolist(), found.units, [], 0
        for parts in split:
            row = []
            for j in range(j, j + len(parts)):
                k, z = first[j], first[j + 1]
                ids = lambda u, v: found.ids[at[u] : at[v]]
                if z - k < 2:
                    row.append(Node(Open(found.unit(k) if z > k else "", ids(k, z)), [], None))
                else:
                    row.append(Node(Open(found.unit(k), ids(k, k + 1)), [ids(k + 1, z - 1)], Open(found.unit(z - 1), ids(z - 1, z))))
            j += 1
            out.append(pairwise(row, self.join)[0])
        return out

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        return [n.flat() for n in self.nodes(texts)]

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """What each list decodes to, as UTF-8."""
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        data = self.bytes.take(pa.array(flat)).buffers()[2]
        whole = memoryview(data) if data is not None else memoryview(b"")
        ends = np.concatenate([[0], np.cumsum(self.widths[flat])])[np.cumsum([0, *map(len, ids)])].tolist()
        return [str(whole[a:z], "utf-8", "replace").encode() for a, z in zip(ends, ends[1:], strict=False)]


def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def _digests(enc: TreeEncoder, ids: list[np.ndarray]) -> list[tuple[int, str, str]]:
    return [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()) for x, text in zip(ids, enc.decode_all(ids), strict=True)]


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>``: the ids of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path, tree_encoder)
        for b in batches:
            texts = b["t"].tolist()
            for a, z in by_bytes([len(t) for t in texts], 1 << 21):
                yield pd.DataFrame({"id": b["id"].iloc[a:z].reset_index(drop=True), "ids": [x.astype(np.int32) for x in enc.encode_texts(texts[a:z])]})

    return _rows(docs, id_col, text_col).mapInPandas(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text``: what lists of ids decode to, special tokens included; a null list decodes to null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path, tree_encoder)
        for b in batches:
            some = enc.decode_all([np.asarray([] if x is None else x, np.uint32) for x in b["x"]])
            yield pd.DataFrame({"id": b["id"], "text": [None if x is None else t.decode() for x, t in zip(b["x"], some, strict=True)]})

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("x")).mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


def _ids(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in column.tolist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


_OUT = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
_PART = ["row", "part", "stretch"]
_NODE = ["id", "row", "part", "head", "body", "tail"]


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """Encode, decode, and return ``id, n_tokens, ids_sha256, decoded_sha256`` of every text."""
    out_schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path, tree_encoder)
        for b in batches:
            texts, ids = b["t"].tolist(), _ids(b["id"])
            for a, z in by_bytes([len(t) for t in texts], 1 << 19):
                near = [i for i in range(a, z) if len(texts[i]) <= spread]
                done = [(ids[i], *x) for i, x in zip(near, _digests(enc, enc.encode_texts([texts[i] for i in near])), strict=True)]
                yield frame(done, [*_OUT, *_PART])
                for i in sorted(set(range(a, z)) - set(near)):
                    row = uuid.uuid4().hex
                    yield frame([(ids[i], None, None, None, row, k, part) for k, part in enumerate(leaves(texts[i], spread))], [*_OUT, *_PART])

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path, tree_encoder)
        for b in batches:
            texts = b["stretch"].tolist()
            for a, z in by_bytes([len(t) for t in texts], 1 << 21):
                nodes = enc.nodes(texts[a:z])
                rows = zip(_ids(b["id"])[a:z], b["row"].iloc[a:z], b["part"].iloc[a:z], nodes, strict=True)
                yield frame([(i, row, int(part), n.head.text, np.concatenate([np.empty(0, np.uint32), *n.body]).tobytes(), n.tail.text if n.tail else None) for i, row, part, n in rows], _NODE)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(tokenizer_path, tree_encoder)
        pdf = pdf.sort_values("part")
        nodes = [Node(Open(head), [np.frombuffer(body, np.uint32)], None if tail is None else Open(tail)) for head, body, tail in zip(pdf["head"], pdf["body"], pdf["tail"], strict=True)]
        whole = pairwise(nodes, enc.join)[0]
        for end in (whole.head, whole.tail):
            if end is not None:
                enc._pieces(end)
        return frame([(_ids(pdf["id"])[0], *_digests(enc, [whole.flat()])[0])], _OUT)

    found = save(_rows(docs, id_col, text_col).mapInPandas(first, f"{out_schema}, row string, part int, stretch string"), "bpe")
    near = found.where(F.col("row").isNull()).select(*_OUT)
    far = found.where(F.col("row").isNotNull()).select("id", *_PART)
    grown = far.repartition("row", "part").mapInPandas(grow, "id long, row string, part int, head string, body binary, tail string")
    return near.unionByName(grown.groupBy("row").applyInPandas(join, out_schema)).withColumnRenamed("id", id_col)
