"""Bounded-space online packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, materialize, slices

ENDED = re.compile(rb"(.*[a-z0-9])([,.]+)", re.DOTALL).fullmatch
PLAIN = re.compile(rb"[a-z]+").fullmatch
WORDS_KEPT = 1_000_000

_state: dict = {}


class WordTokenizer:
    """Ids of whole texts, one white-space separated word at a time.

    The tokenizer drops white space and never looks across it, so a text's
    ids are those of its words in order.  Words met before are looked up.
    Texts with the marker of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _number(self, word: bytes) -> int:
        """Where the ids of a word are kept, which are formed if the word is new."""
        known = self.index.get(word)
        if known is None:
            # the tokenizer parts a word from the commas and stops at its end
            parted = ENDED(word)
            if parted:
                ids = [i for part in parted.groups() for k in [self._number(part)] for i in self.flat[self.ends[k] : self.ends[k + 1]]]
            else:
                ids = [t.id for t in self.model.tokenize(word.decode())] if PLAIN(word) else self.whole(word.decode())
            known = self.index[word] = len(self.ends) - 1
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        return known

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of each text's ids."""
        if len(self.index) > WORDS_KEPT:
            self.index, self.flat, self.ends = {}, array("I"), array("q", [0])
        split = [[] if not t or "<|" in t else t.encode().lower().split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = list(itertools.chain.from_iterable(split))
        word = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(word < 0).tolist()
        word[new] = [self._number(words[k]) for k in new]
        ends = np.array(self.ends, np.int64)
        flat = np.array(self.flat, np.uint32)
        n = ends[word + 1] - ends[word]
        at = bounds(n)
        ids = flat[np.arange(at[-1]) + np.repeat(ends[word] - at[:-1], n)]
        lengths = np.diff(at[bounds(sizes)])
        special = [i for i, t in enumerate(texts) if t and "<|" in t]
        if special:
            parts, to = [], bounds(lengths)
            for i in range(len(texts)):
                parts.append(np.array(self.whole(texts[i]), np.uint32) if i in special else ids[to[i] : to[i + 1]])
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, lengths


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _state:
        _state[path] = WordTokenizer(path)
    return _state[path]


class Packer:
    """At most ``open_windows`` open sequences; pieces go in as they come.

    A piece goes to the fullest window it fits in (best fit).  If it fits in
    none, the fullest is topped up with its head and emitted, and the rest is
    placed again.  ``finish`` merges what is left the same way, so at most
    one window is not full.
    """

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.windows: list[list] = []  # [fill, pieces]
        self.closed: list[list] = []

    def put(self, piece: tuple) -> None:
        """piece: (name, start, length)."""
        name, start, n = piece
        while n:
            if n >= self.length:
                self.closed.append([self.length, [(name, start, self.length)]])
                start, n = start + self.length, n - self.length
                continue
            fits = [w for w in self.windows if w[0] + n <= self.length]
            if fits or len(self.windows) < self.most:
                if fits:
                    w = max(fits, key=lambda w: w[0])
                else:
                    self.windows.append(w := [0, []])
                w[0] += n
                w[1].append((name, start, n))
                if w[0] == self.length:
                    self._emit(w)
                return
            w = max(self.windows, key=lambda w: w[0])
            head = self.length - w[0]
            w[0] = self.length
            w[1].append((name, start, head))
            self._emit(w)
            start, n = start + head, n - head

    def _emit(self, w: list) -> None:
        self.windows = [x for x in self.windows if x is not w]
        self.closed.append(w)

    def take(self) -> list[list]:
        out, self.closed = self.closed, []
        return out

    def finish(self) -> list | None:
        """The one window that isn't full, after the open ones have been merged into each other."""
        while len(self.windows) > 1:
            w = min(self.windows, key=lambda w: w[0])
            self.windows = [x for x in self.windows if x is not w]
            self.most = len(self.windows)
            for piece in w[1]:
                self.put(piece)
        return self.windows.pop() if self.windows else None


FIELDS = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "full"]
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, full boolean"


def _batch(windows: list, ids_of, first: int, full: bool):
    """Arrow rows of windows; ids_of(piece) gives (id, ids, doc tokens)."""
    columns: list[list] = [[] for _ in FIELDS]
    for k, (_, pieces) in enumerate(windows):
        offset = 0
        for piece in pieces:
            name, ids, total = ids_of(piece)
            for c, v in zip(columns, (name, piece[1], piece[2], ids, total, first + k, offset, full), strict=True):
                c.append(v)
            offset += piece[2]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], FIELDS)


def _pack_partition(path: str, length: int, open_windows: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 33, 0
        packer, kept = Packer(length, open_windows), {}
        total = 0
        for b in slices(batches, 8 << 20):
            ids, sizes = tokenizer(path).encode(b.column("text").to_pylist())
            names, to = b.column("id").to_pylist(), bounds(sizes)
            held = {}
            for i, name in enumerate(names):
                mine = np.append(ids[to[i] : to[i + 1]], np.uint32(end_id)).astype("<u4")
                held[total] = kept[total] = (name, mine)
                packer.put((total, 0, len(mine)))
                total += 1

            def ids_of(piece):
                name, mine = kept[piece[0]]
                return name, mine[piece[1] : piece[1] + piece[2]].tobytes(), len(mine)

            done = packer.take()
            yield _batch(done, ids_of, base + made, True)
            made += len(done)
            alive = {p[0] for w in packer.windows for p in w[1]}
            kept = {k: kept[k] for k in alive}
        rest = packer.finish()
        done = packer.take()
        ids_of = lambda p: (kept[p[0]][0], kept[p[0]][1][p[1] : p[1] + p[2]].tobytes(), len(kept[p[0]][1]))
        if done:
            yield _batch(done, ids_of, base + made, True)
        if rest:
            yield _batch([rest], ids_of, base + made + len(done), False)

    return run


def _merge(length: int, open_windows: int, level: int):
    def run(key, table):
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        packer = Packer(length, open_windows)
        for k, r in enumerate(rows):
            packer.put((k, 0, r["length"]))
        rest = packer.finish()
        windows = packer.take()
        base = (level << 58) + (key[0].as_py() << 33)

        def out(ws, first, full):
            t = _batch(ws, lambda p: (rows[p[0]]["id"], rows[p[0]]["ids"][4 * p[1] : 4 * (p[1] + p[2])], rows[p[0]]["doc_tokens"]), first, full).to_pydict()
            flat = [p for w in ws for p in w[1]]
            t["start"] = [rows[p[0]]["start"] + p[1] for p in flat]
            return t

        parts = [out(windows, base, True), out([rest] if rest else [], base + len(windows), False)]
        kinds = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("full", pa.bool_())])
        return pa.Table.from_pydict({f: parts[0][f] + parts[1][f] for f in FIELDS}, kinds)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = 2048, open_windows: int = 16, end_id: int = 1, fan_in: int = 256) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of a document.

    ``ids`` are the piece's token ids, little-endian unsigned 32-bit; a
    sequence is its pieces by ``offset``.  Each partition packs online with
    ``open_windows`` open sequences; its last, unfull one is merged with those
    of up to ``fan_in`` partitions, so one sequence in so many partitions may
    be short.

    Null and empty texts hold the end id alone; null ids are kept as null;
    repeated rows are packed as often as they occur; other columns are not
    read; an empty table gives an empty result.
    """
    pieces = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack_partition(tokenizer_path, length, open_windows, end_id), SCHEMA), "pack")
    group = F.shiftright("sequence_id", 33) / F.lit(fan_in)
    merged = pieces.filter("not full").groupBy(group.cast("long").alias("part")).applyInArrow(_merge(length, open_windows, 1), SCHEMA)
    return pieces.filter("full").unionByName(merged).drop("full")
