"""Alignment of the tokens of two tokenizers over the same texts.

In each batch the token starts of both sides are as-of joined, keyed by
document: a start finds the other side's token that covers it.  Two tokens
overlap if one of them covers the other's start, so the union of both
directions holds every overlap once the pairs with equal starts, which both
find, count once.  Byte offsets where tokens of both sides end cut a document
into groups.

How often two ids are linked in the corpus is counted on the distinct pairs of
blocks of documents; each document keeps the numbers of its pairs within its
block, and meets the counts there.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, materialize, slices

#: Fixed: how byte-level BPE splits a text, and the special pieces of the other side.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"
#: Bytes of text that are joined at once, and that share a list of pairs.
BATCH_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20

_state: dict = {}


def byte_level() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, one for each Python worker: ids of texts, and the bytes of every id."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken

        with open(bytes_path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told["added_tokens"]}
        code = byte_level()
        # the ids of byte-level BPE are the ranks of its merges
        ranks = {bytes(code[c] for c in piece): k for piece, k in told["model"]["vocab"].items() if piece not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        a_bytes = [b""] * (max(told["model"]["vocab"].values()) + 1)
        for piece, k in ranks.items():
            a_bytes[k] = piece
        b_bytes = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace(SPACE, " ").encode() for k in range(self.b.get_piece_size())]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(p) for p in x], np.int64) for x in (a_bytes, b_bytes)]
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        # ids as text with what follows them: A "," or "|"; B ",", ";" or nothing
        named = [f"{k}{end}".encode() for end in ",|" for k in range(self.n_a)] + [f"{k}{end}".encode() for end in (",", ";", "") for k in range(self.n_b)]
        self.named = pa.array(named, pa.binary())

    def ids(self, texts: list[str]) -> list[list[np.ndarray]]:
        a = [np.asarray(self.a.encode_to_numpy(" " + t, disallowed_special=()), np.int64) for t in texts]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)] if texts else []
        return [a, b]


def sides(bytes_path: str, pieces_path: str) -> Sides:
    key = (bytes_path, pieces_path)
    if key not in _state:
        _state[key] = Sides(*key)
    return _state[key]


def flat_bytes(table: pa.Array, index: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of a table one after another, and where each begins."""
    taken = table.take(pa.array(index))
    at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1].astype(np.int64)
    return memoryview(taken.buffers()[2] or b"").cast("B"), at


def covering(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each start of ``left`` (doc, at) the place of the token of ``right`` that covers it, and that one's start."""
    found = pd.merge_asof(left, right.assign(token=np.arange(len(right), dtype=np.int32), start=right["at"]), on="at", by="doc")
    return found["token"].to_numpy(np.int64), found["start"].to_numpy(np.int64)


def align_batch(own: Sides, texts: list[str | None]) -> tuple[dict, list[bytes], np.ndarray, np.ndarray]:
    """(columns, group texts, document of each link, pair of each link)."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    ids = [[], []]
    full = [k for k, t in enumerate(texts) if t]
    for side, found in enumerate(own.ids([texts[k] for k in full])):
        ids[side] = [np.empty(0, np.int64)] * len(texts)
        for k, x in zip(full, found, strict=True):
            ids[side][k] = x
        # documents whose tokens don't spell them have none
        data, at = flat_bytes(own.bytes[side], np.concatenate([*ids[side], np.empty(0, np.int64)]))
        to = bounds(np.fromiter(map(len, ids[side]), np.int64, len(texts)))
        for k in full:
            if data[at[to[k]] : at[to[k + 1]]] != raw[k]:
                raw[k] = b""
    n = [np.fromiter((len(x) if r else 0 for x, r in zip(ids[s], raw, strict=True)), np.int64, len(texts)) for s in (0, 1)]
    token = [np.concatenate([*(x for x, r in zip(ids[s], raw, strict=True) if r), np.empty(0, np.int64)]) for s in (0, 1)]
    # starts within the batch; the documents' bytes are the same on both sides
    frames = [pd.DataFrame({"doc": np.repeat(np.arange(len(texts), dtype=np.int32), n[s]), "at": bounds(own.sizes[s][token[s]])[:-1]}) for s in (0, 1)]
    b_of_a, b_start = covering(frames[0], frames[1])
    a_of_b, a_start = covering(frames[1], frames[0])
    doc, at = [f["doc"].to_numpy() for f in frames], [f["at"].to_numpy() for f in frames]
    # of the B starts those that no A token shares are new
    new = a_start < at[1]
    link_a, link_b = np.concatenate([np.arange(len(at[0])), a_of_b[new]]), np.concatenate([b_of_a, np.flatnonzero(new)])
    link_doc = np.concatenate([doc[0], doc[1][new]])

    head = [np.flatnonzero(b_start == at[0]), np.flatnonzero(~new)]  # the first tokens of groups
    of_doc = doc[0][head[0]]
    n_groups = np.bincount(of_doc, minlength=len(texts))
    ends = [np.append(head[s], len(at[s]))[1:] for s in (0, 1)]
    # groups one after another, A before B
    code, order = np.empty(len(at[0]) + len(at[1]), np.int64), [np.arange(len(at[0])) + np.repeat(head[1], ends[0] - head[0]), np.arange(len(at[1])) + np.repeat(ends[0], ends[1] - head[1])]
    a_code, b_code = token[0].copy(), token[1] + 2 * own.n_a
    a_code[ends[0] - 1] += own.n_a
    b_code[ends[1] - 1] += np.where(np.append(of_doc, -1)[1:] == of_doc, own.n_b, 2 * own.n_b)
    code[order[0]], code[order[1]] = a_code, b_code
    data, to = flat_bytes(own.named, code)
    to = to[bounds(n[0] + n[1])]
    groups = [data[to[k] : to[k + 1]] for k in range(len(texts))]
    n_links = np.bincount(link_doc, minlength=len(texts))
    return {"n_a": n[0], "n_b": n[1], "n_groups": n_groups, "n_links": n_links}, groups, link_doc, token[0][link_a] * own.n_b + token[1][link_b]


NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "block", "pair", "times", "keys", "totals"]
SCHEMA = "id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, block long, pair array<int>, times array<int>, keys array<long>, totals array<long>"


def _align(bytes_path: str, pieces_path: str, with_groups: bool, block_bytes: int):
    def close(held: list, block: int):
        """Rows of a block: pairs are numbered by how often the block has them; its list of pairs goes with the first row."""
        links = [x["links"] for x in held]
        number, keys = pd.factorize(np.concatenate(links))[0:2] if links else (np.empty(0, np.int64), np.empty(0, np.int64))
        totals = np.bincount(number, minlength=len(keys))
        rank = np.argsort(-totals, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        number, first, out, rows = place[number], bounds(np.fromiter(map(len, links), np.int64, len(links))), [], 0
        for k, x in enumerate(held):
            size = len(x["id"])
            mine, times = np.unique(x["doc"].astype(np.int64) * max(1, len(keys)) + number[first[k] : first[k + 1]], return_counts=True)
            to = np.searchsorted(mine, np.arange(size + 1) * max(1, len(keys)))
            lists = [pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (mine % max(1, len(keys)), times)]
            told = [pa.array([v[rank].tolist() if rows == 0 and j == 0 else None for j in range(size)], pa.list_(pa.int64())) for v in (keys, totals)]
            c = x["columns"]
            out = [x["id"], *[pa.array(c[n].astype(np.int64)) for n in NAMES[1:5]], pa.array(x["sha"]), pa.array(x["groups"], pa.string()), pa.array(np.full(size, block)), *lists, *told]
            rows += size
            yield pa.RecordBatch.from_arrays(out, NAMES)

    def run(batches):
        from pyspark import TaskContext

        own, block, held, size = sides(bytes_path, pieces_path), TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches, BATCH_BYTES):
            texts = b.column("text").to_pylist()
            columns, groups, doc, pair = align_batch(own, texts)
            sha = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, columns["n_groups"].tolist(), strict=True)]
            held.append({"id": b.column("id"), "columns": columns, "sha": sha, "groups": [bytes(g).decode() if with_groups else None for g in groups], "doc": doc, "links": pair})
            size += b.column("text").nbytes
            if size >= block_bytes:
                yield from close(held, block)
                held, size, block = [], 0, block + 1
        if held:
            yield from close(held, block)

    return run


def _tell(id_kind):
    """Documents of a block and the corpus' counts of its pairs: the sums of each document."""

    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        count = np.zeros(told.num_rows, np.int64)
        best = np.zeros(told.num_rows, np.int64)
        pos = told.column("pos").to_numpy()
        count[pos], best[pos] = told.column("count").to_numpy(), told.column("best").to_numpy().astype(np.int64)
        docs = docs.combine_chunks()
        pairs = docs.column("pair").chunk(0) if docs.num_rows else pa.array([], pa.list_(pa.int32()))
        to = bounds(np.diff(pairs.offsets.to_numpy()))
        number, times = pairs.flatten().to_numpy(), docs.column("times").chunk(0).flatten().to_numpy().astype(np.int64)
        total = lambda v: pa.array(np.diff(bounds(v * times)[to]))
        names = NAMES[:7]
        return pa.table([*[docs.column(n) for n in names], total(best[number]), total(count[number])], [*names, "n_best", "count_sum"])

    return run


def align_tokens(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", *, with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum): a row for each row of ``docs``.

    A are the byte-level BPE tokens of a space and the text, B the pieces of
    the text, to which the piece model adds the space.  A link is a pair of
    token occurrences whose byte ranges overlap; ``groups`` (with
    ``with_groups``) are the ids of both sides between offsets where both have
    an end, as ``a1,a2|b1;a3|b2,b3``.  The count of two ids is the number of
    links that hold them in all documents; ``n_best`` are the links whose
    count is the highest of their B id, ``count_sum`` is the sum of counts
    over links.

    Null and empty texts, and texts that the tokens of either side don't spell
    byte for byte, have no tokens: zeros and an empty digest; special tokens'
    names in texts are plain text; ids may be null or repeat; other columns
    are not read; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type = kind.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = materialize(read.mapInArrow(_align(bytes_path, pieces_path, with_groups, block_bytes), SCHEMA.format(id_type)), "align-docs")
    n_b = sides(bytes_path, pieces_path).n_b
    listed = done.filter("keys is not null").select("block", F.posexplode(F.arrays_zip("keys", "totals")).alias("pos", "r")).select(F.col("block").alias("at"), "pos", F.col("r.keys").alias("pair"), F.col("r.totals").alias("total"))
    counts = materialize(listed.groupBy("pair").agg(F.sum("total").alias("count")).withColumn("b", F.col("pair") % n_b), "align-counts")
    # a row for each B id: no more than the pieces of the model
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    told = listed.select("at", "pos", "pair").join(known, "pair").select("at", "pos", "count", "best")
    schema = SCHEMA.format(id_type).split(", block long")[0] + ", n_best long, count_sum long"
    return done.drop("keys", "totals").groupBy("block").cogroup(told.groupBy("at")).applyInArrow(_tell(to_arrow_type(kind)), schema)
