"""Language-model scores of a weighted backoff automaton over word n-grams.

States are the histories of up to ``order - 1`` words seen in training, arcs the n-grams. In state h, a word w with
c(hw) > 0 has an arc of weight log10 P(w | h) to the longest state that hw ends in; any other word takes the failure arc
of h, of weight log10 of the mass that h leaves to its shorter history, and is tried there. P is Dirichlet-smoothed,
``P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu)``, so a state leaves ``mu / (c(h) + mu)``; at the root a known word has
``(1 - u) c / N`` and all unknown words together have u, the share of words seen once. All weights of a state sum to 1.

The automaton of the whole corpus is never in one place: a chunk of documents gets the slice of it that its words can
reach (``Automaton``). Chunks are files in the shared folder. Each asks for the n-grams it holds, as sorted 64-bit keys
with its own training counts; buckets of the key space add up the counts of all chunks and answer every chunk in the order
it asked; the answers come back to the chunk by a grouped shuffle. Questions and answers are blocks of many keys, at
most as many as there are keys, so all work is in proportion to the corpus. A chunk asks for a key once, however often it
occurs there, so a word that is in every document weighs no more on its bucket than any other. Answers also say which
n-grams no other chunk has; a longer n-gram that holds one of these is in no other chunk either, its count is the chunk's
own, and it need not be asked for. Words and pairs are asked for together, each further order after the one before.

The chunk then lays out states, arcs and failure arcs and goes through its documents once from left to right. Lanes of
``LANE`` words go side by side in numpy, each with a state of its own that every word moves on: along its arc, or down
failure arcs until a state has one. A lane that begins inside a document reads the ``order - 1`` words before it first,
after which its state is the one that the whole document would have carried there.

Keys are 64-bit hashes; two of n distinct n-grams collide with a probability of n^2 / 2^65 (under 1e-4 for 5e7, and then
change two counts). Defined cases: a null text is empty; an empty text is its end alone; a null id is not held out;
without training tokens N is 0 and u is 1/2; rows that repeat count and score each; a very long text is a chunk of its own
and scored whole; ties don't occur, as nothing is ranked; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import by_bytes, frame, fresh_path, mix64, save, utf8
from ._files import Reader, write_file

ORDER, MU = 3, 100.0
#: Bytes of text in a chunk; n-grams asked for in a bucket, by all chunks together; buckets of an order at least; words of
#: a lane.
CHUNK_BYTES, BUCKET_KEYS, LEAST_BUCKETS, LANE = 8 << 20, 2_000_000, 96, 256
_END, _START, _STEP = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557), np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers words in the order in which they are first met; 0 stands for the end of a document."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def _squeeze(values: np.ndarray) -> bytes:
    """Integers by byte planes, each compressed alone: high bytes, mostly equal, cost little, and random ones their size."""
    wide = np.ascontiguousarray(values)
    planes = wide.view(np.uint8).reshape(len(wide), wide.itemsize).T
    parts = [plane.tobytes() if len(wide) < 64 else zstandard.compress(plane.tobytes(), 1) for plane in planes]
    return struct.pack(f"<{len(parts) + 1}I", len(wide), *map(len, parts)) + b"".join(parts)


def _unsqueeze(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    n, *sizes = struct.unpack_from(f"<{size + 1}I", data)
    out, at = np.empty((n, size), np.uint8), 4 * (size + 1)
    for i, length in enumerate(sizes):
        part = data[at : at + length]
        out[:, i] = np.frombuffer(part if n < 64 else zstandard.decompress(part), np.uint8)
        at += length
    return out.view(dtype).ravel()


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _keys(hashes: np.ndarray, lens: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For n = 1 to ``order``: the key of the n-gram that ends at each position, and where there is one."""
    first = np.zeros(len(hashes), bool)
    first[np.cumsum(lens) - lens] = True
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lens) - lens, lens)
    keys, valid = [hashes], [np.ones(len(hashes), bool)]
    for n in range(2, order + 1):
        before = np.empty_like(hashes)
        before[1:] = keys[-1][:-1]
        if n == 2:
            before[first] = _START
        keys.append(mix64(before * _STEP + hashes + np.uint64(n)))
        valid.append(place >= n - 2)
    return keys, valid


_CHUNK = "part int, seq int, name string, offset long, length long, n_keys array<long>, training long"


def to_chunks(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write documents as chunks of numbered words below ``root``, a file a task; returns a row a chunk: where it is, how
    many n-grams of each order it may ask for, and its training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, name, made = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.words", []
        numbers, ids, held, lens, tokens, size = _Numbers(), [], [], [], [], 0

        def flush() -> bytes:
            words = np.array([int(_END), *(xxhash.xxh64_intdigest(w) for w in numbers)], np.uint64)
            flat, n = np.concatenate(tokens), np.array(lens, np.uint32)
            null = np.array([i is None for i in ids], np.uint8)
            marks = np.array(held, np.uint8) + 2 * null
            parts = [_squeeze(np.array([i or 0 for i in ids], np.int64)), _squeeze(marks), _squeeze(n), _squeeze(flat), words.tobytes()]
            data = struct.pack("<5Q", *map(len, parts)) + b"".join(parts)
            offset = made[-1][3] + made[-1][4] if made else 0
            made.append((part, len(made), name, offset, len(data), [len(words), *[len(flat)] * (order - 1)], int((marks & 1 == 0).sum())))
            return data

        def blobs() -> Iterator[bytes]:
            nonlocal numbers, ids, held, lens, tokens, size
            for b in batches:
                texts = b["t"].tolist()
                for a, z in by_bytes([len(t) for t in texts], 1 << 20):
                    split = [t.lower().split() for t in texts[a:z]]
                    n = np.array([len(ws) + 1 for ws in split])
                    flat = np.zeros(int(n.sum()), np.uint32)
                    inner = np.ones(len(flat), bool)
                    inner[np.cumsum(n) - 1] = False
                    flat[inner] = np.fromiter((numbers[w] for ws in split for w in ws), np.uint32, int(inner.sum()))
                    tokens.append(flat)
                    lens.extend(n.tolist())
                    ids.extend(None if pd.isna(i) else int(i) for i in b["id"].iloc[a:z])
                    held.extend(b["held"].iloc[a:z])
                    size += sum(map(len, texts[a:z]))
                    if size >= chunk_bytes:
                        yield flush()
                        numbers, ids, held, lens, tokens, size = _Numbers(), [], [], [], [], 0
            if tokens:
                yield flush()

        it = blobs()
        if (first := next(it, None)) is not None:
            write_file(root, name, _chain(first, it))
            yield frame(made, [c.split()[0] for c in _CHUNK.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), utf8(text_col).alias("t"))
    return save(rows.mapInPandas(run, _CHUNK), "lm-chunks")


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


class _Chunk:
    """``words``: numbers of the words one after the other; ``place[n - 1]``: at each position, which of the distinct
    n-grams ends there (ascending by key; -1 where a document has none yet); ``first[n - 1]``: a position of each."""

    def __init__(self, data: bytes, order: int):
        sizes = struct.unpack_from("<5Q", data)
        ends = np.cumsum([40, *sizes]).tolist()
        ids, marks, lens, words, hashes = (data[a:z] for a, z in zip(ends, ends[1:], strict=False))
        self.lens = _unsqueeze(lens, np.uint32).astype(np.int64)
        marks = _unsqueeze(marks, np.uint8)
        self.held, null = (marks & 1).astype(bool), marks >= 2
        self.ids = [None if x else i for i, x in zip(_unsqueeze(ids, np.int64).tolist(), null.tolist(), strict=True)]
        self.words = _unsqueeze(words, np.uint32)
        self.order, self.keys, self.first, self.place = order, [], [], []
        keys, valid = _keys(np.frombuffer(hashes, np.uint64)[self.words], self.lens, order)
        for k, v in zip(keys, valid, strict=True):  # a chunk may be read for its lower orders only
            at = np.flatnonzero(v)
            found, first, back = np.unique(k[at], return_index=True, return_inverse=True)
            place = np.full(len(v), -1, np.int32)
            place[at] = back
            self.keys.append(found)
            self.first.append(at[first])
            self.place.append(place)

    def counts(self, n: int) -> np.ndarray:
        """How often each distinct n-gram occurs in the chunk's training documents."""
        train = np.repeat(~self.held, self.lens) & (self.place[n - 1] >= 0)
        return np.bincount(self.place[n - 1][train], minlength=len(self.keys[n - 1])).astype(np.uint32)


def _cuts(keys: np.ndarray, buckets: int) -> tuple[list[int], list[int]]:
    """The buckets that ascending ``keys`` fall into, in equal ranges of the key space, and where each begins; the last
    entry ends them."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    at = np.flatnonzero(np.diff(of, prepend=np.uint64(2**64 - 1)))
    return of[at].tolist(), [*at.tolist(), len(keys)]


def _shared(chunk: _Chunk, alone: list[np.ndarray], n: int) -> np.ndarray:
    """Which of the distinct n-grams other chunks may have: those whose two shorter ones others have; all up to pairs."""
    if n < 3:
        return np.ones(len(chunk.keys[n - 1]), bool)
    first, place = chunk.first[n - 1], chunk.place[n - 2]
    return ~(alone[n - 2][place[first]] | alone[n - 2][place[first - 1]])


def _told(chunk: _Chunk, told: pd.DataFrame, orders: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The counts of all distinct n-grams up to ``orders``, and which of them no other chunk has: from the answers, or the
    chunk's own where it need not ask."""
    counts: list[np.ndarray] = []
    alone: list[np.ndarray] = []
    for n in range(1, orders + 1):
        asked = _shared(chunk, alone, n)
        mine = told[told["n"] == n].sort_values("bucket")["counts"]
        got = np.concatenate([np.empty(0, np.uint64), *(_unsqueeze(x, np.uint64) for x in mine)])
        if len(got) != asked.sum():
            raise ValueError("a chunk has not got an answer for every n-gram that it asked for")
        c, a = chunk.counts(n).astype(np.float64), np.ones(len(chunk.keys[n - 1]), bool)
        c[asked], a[asked] = got >> np.uint64(1), (got & np.uint64(1)).astype(bool)
        counts.append(c)
        alone.append(a)
    return counts, alone


_ASKED = "n int, bucket int, part int, seq int, keys binary, counts binary"


def _questions(chunk: _Chunk, row, n: int, many: int, asked: np.ndarray) -> pd.DataFrame:
    keys, counts = chunk.keys[n - 1][asked], chunk.counts(n)[asked]
    of, cuts = _cuts(keys, many)
    out = [(n, k, row.part, row.seq, _squeeze(np.diff(keys[a:z], prepend=np.uint64(0))), _squeeze(counts[a:z])) for k, a, z in zip(of, cuts, cuts[1:], strict=False)]
    return frame(out, [c.split()[0] for c in _ASKED.split(", ")])


def _ask(chunks: DataFrame, root: str, buckets: list[int]) -> DataFrame:
    """Per chunk, order (1 and 2) and bucket: the keys, and how often each occurs in the chunk's training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(root)
        for b in batches:
            for row in b.itertuples(index=False):
                chunk = _Chunk(reader.read(row.name, row.offset, row.length), len(buckets))
                for n, many in enumerate(buckets, 1):
                    yield _questions(chunk, row, n, many, _shared(chunk, [], n))
        reader.close()

    return chunks.select("part", "seq", "name", "offset", "length").mapInPandas(run, _ASKED)


def _ask_further(chunks: DataFrame, answers: DataFrame, root: str, n: int, many: int) -> DataFrame:
    """The same for a higher order, of which a chunk asks only for what others may have."""

    def run(here: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        reader, out = Reader(root), []
        for row in here.itertuples(index=False):
            chunk = _Chunk(reader.read(row.name, row.offset, row.length), n)
            _, alone = _told(chunk, told, n - 1)
            out.append(_questions(chunk, row, n, many, _shared(chunk, alone, n)))
        reader.close()
        return pd.concat(out)

    return _with_answers(chunks, answers).applyInPandas(run, _ASKED)


def _with_answers(chunks: DataFrame, answers: DataFrame):
    asked = chunks.select("part", "seq", "name", "offset", "length").groupBy("part", "seq")
    return asked.cogroup(answers.select("part", "seq", "n", "bucket", "counts").groupBy("part", "seq"))


_ANSWER = "n int, bucket int, part int, seq int, counts binary, tokens long, distinct long, singles long"


def _answer(asked: DataFrame) -> DataFrame:
    """Add up every bucket: a row a chunk that asked, with the totals in its order, doubled, and 1 more where no other
    chunk asked. The first row of a bucket has its training tokens, its n-grams and those seen once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_unsqueeze(x, np.uint64), dtype=np.uint64) for x in pdf["keys"]]
        counts = np.concatenate([_unsqueeze(x, np.uint32) for x in pdf["counts"]])
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, len(found)).astype(np.uint64)
        told = total * np.uint64(2) + (np.bincount(place, minlength=len(found)) == 1).astype(np.uint64)
        stats = (int(total.sum()), int((total > 0).sum()), int((total == 1).sum()))
        rows = zip(pdf["n"].tolist(), pdf["bucket"].tolist(), pdf["part"].tolist(), pdf["seq"].tolist(), cuts, cuts[1:], strict=False)
        out = [(n, k, part, seq, _squeeze(told[place[a:z]]), *(stats if not a else (0, 0, 0))) for n, k, part, seq, a, z in rows]
        return frame(out, [c.split()[0] for c in _ANSWER.split(", ")])

    return save(asked.groupBy("n", "bucket").applyInPandas(run, _ANSWER), "lm-answers")


class Automaton:
    """The slice of the automaton that a chunk's words can reach. State 0 is the root, 1 the beginning of a document; the
    histories of l words follow, level by level, in the order of the chunk's distinct l-grams. ``counts[n - 1]`` are the
    training counts of the distinct n-grams, ``documents`` the number of training documents.

    ``fail`` and ``loss`` are the failure arcs, one a state; arcs lie in ``at`` (state * words + word, ascending) with
    ``weight`` and ``goes``, those of the root in ``root_weight`` and ``root_goes`` by word."""

    def __init__(self, chunk: _Chunk, counts: list[np.ndarray], total: int, unknown: float, documents: int, mu: float = MU):
        order, words = chunk.order, chunk.words
        self.n_words, self.order = int(words.max(initial=0)) + 1, order
        base = 2 + np.concatenate([[0], np.cumsum([len(k) for k in chunk.keys[: order - 1]])]).astype(np.int64)
        ended = [words[first] == 0 for first in chunk.first]

        def state(level: int, positions: np.ndarray) -> np.ndarray:
            """The state of the last ``level`` words up to each position."""
            return base[level - 1] + chunk.place[level - 1][positions] if level else np.zeros(len(positions), np.int64)

        self.fail, self.loss = np.zeros(int(base[-1]), np.int64), np.zeros(int(base[-1]))
        self.is_state = np.zeros(int(base[-1]), bool)
        self.is_state[0], self.is_state[1], self.loss[1] = True, documents > 0 and order > 1, np.log10(mu / (documents + mu))
        for level in range(1, order):
            c, mine = counts[level - 1], slice(int(base[level - 1]), int(base[level]))
            self.is_state[mine] = (c > 0) & ~ended[level - 1]
            self.fail[mine] = state(level - 1, chunk.first[level - 1])
            self.loss[mine] = np.log10(mu / (c + mu))
        held = np.concatenate([[0, documents], *[c for c in counts[: order - 1]]])
        with np.errstate(divide="ignore"):
            weights = np.where(counts[0] > 0, np.log10((1 - unknown) * counts[0] / max(total, 1)), np.log10(unknown))
        of = words[chunk.first[0]]
        self.root_weight, self.root_goes = np.full(self.n_words, np.log10(unknown)), np.zeros(self.n_words, np.int64)
        self.root_weight[of] = weights
        if order > 1:
            self.root_goes[of] = np.where((counts[0] > 0) & ~ended[0], 2 + np.arange(len(of)), 0)
        starts = np.zeros(len(words), bool)
        starts[np.cumsum(chunk.lens) - chunk.lens] = True
        at, weight, goes = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        for n in range(2, order + 1):
            first, c = chunk.first[n - 1], counts[n - 1]
            source = state(n - 1, first - 1)
            if n == 2:
                source[starts[first]] = 1
            shorter = weights[chunk.place[n - 2][first]]
            h = held[source]
            weights = np.log10((c + mu * 10.0**shorter) / (h + mu))
            seen = c > 0
            target = state(min(n, order - 1), first)
            at.append((source * self.n_words + words[first])[seen])
            weight.append(weights[seen])
            goes.append(np.where(ended[n - 1], 0, target)[seen])
        at, weight, goes = map(np.concatenate, (at, weight, goes))
        by = np.argsort(at)
        self.at, self.weight, self.goes = at[by], weight[by], goes[by]

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights that the words add in their states, failure arcs included, and the states they lead to."""
        gained, out = np.zeros(len(states)), np.zeros(len(states), np.int64)
        todo, here = np.arange(len(states)), states
        for _ in range(self.order):
            if not len(todo):
                break
            word = words[todo]
            if len(self.at):
                key = here * self.n_words + word
                i = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
                hit = (self.at[i] == key) & (here > 0)
            else:
                i, hit = np.zeros(len(todo), np.int64), np.zeros(len(todo), bool)
            root = here == 0
            gained[todo[hit]] += self.weight[i[hit]]
            out[todo[hit]] = self.goes[i[hit]]
            gained[todo[root]] += self.root_weight[word[root]]
            out[todo[root]] = self.root_goes[word[root]]
            more = ~hit & ~root
            todo, here = todo[more], here[more]
            gained[todo] += self.loss[here]
            here = self.fail[here]
        return gained, out

    def score(self, words: np.ndarray, lens: np.ndarray, lane: int = LANE, visited: list | None = None) -> np.ndarray:
        """log10 of the probability of every document. ``visited`` gets the states after each step, for tests."""
        warm = self.order - 1
        starts = np.cumsum(lens) - lens
        lanes = -(-lens // lane)
        doc = np.repeat(np.arange(len(lens)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        counted = starts[doc] + nth * lane
        begin = np.maximum(counted - np.where(nth > 0, warm, 0), starts[doc])
        end = np.minimum(counted + lane, starts[doc] + lens[doc])
        by = np.argsort(begin - end, kind="stable")  # the longest first: those that go on are a head of the list
        doc, counted, begin, end = doc[by], counted[by], begin[by], end[by]
        long = end - begin
        states = np.where(begin == starts[doc], np.int64(self.is_state[1]), 0)
        sums = np.zeros(len(doc))
        for t in range(int(long.max(initial=0))):
            m = int(np.searchsorted(-long, -t, side="left"))
            position = begin[:m] + t
            gained, states = self.step(states[:m], words[position])
            sums[:m] += np.where(position >= counted[:m], gained, 0.0)
            if visited is not None:
                visited.append((position, states))
        return np.bincount(doc, sums, len(lens))


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(chunks: DataFrame, answers: DataFrame, root: str, order: int, total: int, distinct: int, unknown: float, documents: int, mu: float) -> DataFrame:
    names = [c.split()[0] for c in _SCORES.split(", ")]

    def run(here: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        reader, out = Reader(root), []
        for row in here.itertuples(index=False):
            chunk = _Chunk(reader.read(row.name, row.offset, row.length), order)
            starts = np.cumsum(chunk.lens) - chunk.lens
            counts, _ = _told(chunk, told, order)
            scores = Automaton(chunk, counts, total, unknown, documents, mu).score(chunk.words, chunk.lens)
            single = counts[0][chunk.place[0]]
            base = np.log10((single + 0.1) / (total + 0.1 * (distinct + 1)))
            known = np.add.reduceat((single > 0).astype(np.int64), starts)
            out += [(i, bool(h), int(n), int(k), total, float(s), float(w)) for i, h, n, k, s, w in zip(chunk.ids, chunk.held, chunk.lens, known, np.add.reduceat(base, starts), scores, strict=True)]
        reader.close()
        return frame(out, names)

    return _with_answers(chunks, answers).applyInPandas(run, _SCORES)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU, chunk_bytes: int = CHUNK_BYTES, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Learn from the documents that are not held out and score all: ``id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``."""
    root = fresh_path(docs.sparkSession, "lm-words")
    chunks = to_chunks(docs, root, id_col, text_col, order, chunk_bytes)
    sums = chunks.agg(F.coalesce(F.sum("training"), F.lit(0)).alias("training"), *[F.coalesce(F.sum(F.col("n_keys")[n]), F.lit(0)).alias(f"k{n}") for n in range(order)]).first()
    buckets = [max(least_buckets, -(-sums[f"k{n}"] // BUCKET_KEYS)) for n in range(order)]
    answers = _answer(_ask(chunks, root, buckets[:2]))
    for n in range(3, order + 1):
        answers = answers.unionByName(_answer(_ask_further(chunks, answers, root, n, buckets[n - 1])))
    stats = answers.where("n = 1").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), F.sum("singles").alias("singles")).first()
    total, distinct, singles = (stats[c] or 0 for c in ("tokens", "distinct", "singles"))
    unknown = (singles + 0.5) / (total + 1)
    return _score(chunks, answers, root, order, total, distinct, min(unknown, 0.5) if total else 0.5, sums["training"], mu).withColumnRenamed("id", id_col)
