"""Multiple-instance learning from document labels.

``NoisyOr``: sentence scores from hashed words, combined by noisy-or.
``GatedAttention``: passages encoded by their words and by counts, weighted by a learned gated attention.

Both are fitted in numpy on a bounded sample of labelled rows, and score
whole texts in Arrow batches.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import bounds, crc_mod, materialize, slices

PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
#: Sentence ends become line ends, other ASCII punctuation becomes blanks.
TO_SENTENCES = bytes.maketrans(PUNCTUATION, bytes(10 if chr(c) in ".!?\n" else 32 for c in PUNCTUATION))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, fold: int = 5) -> DataFrame:
    """(h, text, y) of at most ``most`` labelled ids, the first by a hash of the id; rows that repeat an id all come.

    Held-out rows (crc32 of the id modulo ``fold`` is 0) and rows with a null
    id or label are left out; of several labels of an id the largest holds.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", fold) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(label)).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("y").cast("int").alias("y"))


#: Most bytes of encoded sample rows that come to the driver.
FIT_BYTES = 192 << 20


def bounded_rows(encoded: DataFrame, most: int, most_bytes: int, tag: str) -> list[Row]:
    """The first of ``encoded`` (h, size, ...) by h: at most ``most`` rows, and no more than ``most_bytes`` of them but for one."""
    encoded = materialize(encoded, tag)
    sizes = [r["size"] for r in encoded.select("h", "size").orderBy("h", "size").limit(most).collect()]
    n = int(np.searchsorted(np.cumsum(sizes), most_bytes, "right")) if sizes else 0
    return encoded.orderBy("h", "size").limit(max(n, min(1, len(sizes)))).collect()


# ---- sentences of hashed words -------------------------------------------------


def sentences(text: str | None) -> list[list[bytes]]:
    if not text:
        return []
    return [w for s in text.lower().encode().translate(TO_SENTENCES).split(b"\n") if (w := s.split())]


#: Prefixes of a word that are features beside the word itself: inflected forms share them.
PREFIXES = (5, 6, 7)
WORDS_KEPT = 300_000


def word_features(word: bytes, bits: int) -> list[int]:
    """Hashed features of a word: the whole, and its first bytes."""
    digest, shift = xxhash.xxh64_intdigest, 64 - bits
    return [digest(word, 1) >> shift] + [digest(word[:k], k) >> shift for k in PREFIXES if len(word) >= k]


def features(found: list[list[bytes]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of all sentences, start of each sentence and the end)."""
    per = [[f for w in s for f in word_features(w, bits)] for s in found]
    return np.array([f for s in per for f in s], np.int32), bounds(np.fromiter(map(len, per), np.int64, len(per)))


class NoisyOr:
    """p(document) = 1 - prod over sentences of (1 - sigmoid(bias + sum of the weights of the sentence's words and prefixes))."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.known: dict[bytes, float] = {}

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, least_docs: int = 1, epochs: int = 120, rate: float = 0.3, sparsity: float = 0.3) -> NoisyOr:
        """documents: as from ``features``."""
        seen = np.zeros(1 << self.bits, np.int64)
        for w, _ in documents:
            seen[np.unique(w)] += 1
        index = np.full(1 << self.bits, -1, np.int32)
        kept = np.flatnonzero(seen >= least_docs)
        index[kept] = np.arange(len(kept))
        # documents in blocks, so that what is worked on at once is small
        blocks, m = [], max(1, len(documents))
        for at in range(0, len(documents), 400):
            some = documents[at : at + 400]
            word = np.concatenate([index[w] for w, _ in some])
            sizes = np.concatenate([np.diff(s) for _, s in some])
            of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[word >= 0]
            doc = np.repeat(np.arange(len(some)), [len(s) - 1 for _, s in some])
            blocks.append((word[word >= 0], of, doc, len(sizes), y[at : at + 400]))
        w, bias = np.zeros(len(kept)), -5.0
        m1, m2, c1, c2 = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
        for t in range(1, epochs + 1):
            g, gb = np.zeros(len(kept)), 0.0
            for word, of, doc, n, label in blocks:
                z = bias + np.bincount(of, w[word], n)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label))
                any_p = np.clip(-np.expm1(log_none), 1e-9, 1)
                dz = (np.where(label == 1, -(1 - any_p) / any_p, 1.0) / m)[doc] * p
                g += np.bincount(word, dz[of], len(kept))
                gb += dz.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
            step = rate / (np.sqrt(m2 / (1 - 0.99**t)) + 0.3 / m)
            w -= step * m1 / (1 - 0.9**t)
            # words that ``sparsity`` documents or fewer speak for get no weight
            w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity / m, 0)
            bias -= 0.1 * (c1 / (1 - 0.9**t)) / (np.sqrt(c2 / (1 - 0.99**t)) + 1e-8)
        self.bias, self.weights = float(bias), np.zeros(1 << self.bits, np.float32)
        self.weights[kept] = w
        return self

    def sentence_scores(self, found: list[list[bytes]]) -> np.ndarray:
        if not found:
            return np.empty(0)
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        known, flat = self.known, [w for s in found for w in s]
        for w in {w for w in flat if w not in known}:
            known[w] = float(self.weights[word_features(w, self.bits)].sum())
        of_word = np.fromiter(map(known.__getitem__, flat), np.float64, len(flat))
        z = self.bias + np.add.reduceat(of_word, bounds(np.fromiter(map(len, found), np.int64, len(found)))[:-1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sentence_rows(bits):
    def run(batches):
        for b in slices(batches, 4 << 20):
            words, starts, size = [], [], []
            for text in b.column("text").to_pylist():
                w, at = features(sentences(text), bits)
                words.append(w.tobytes())
                starts.append(at.astype(np.int32).tobytes())
                size.append(len(words[-1]) + len(starts[-1]))
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(size, pa.int64()), pa.array(words, pa.binary()), pa.array(starts, pa.binary()), b.column("y")], ["h", "size", "words", "starts", "y"])

    return run


def fit_noisy_or(sample: DataFrame, bits: int = 20, *, most: int = 16_000, most_bytes: int = FIT_BYTES) -> NoisyOr:
    """Fits on all features of ``sample``: none is left out for being rare or common.

    Four bytes for each feature come to the driver, of the first ``most`` rows
    by a hash and at most ``most_bytes``, however long or often repeated they are.
    """
    got = bounded_rows(sample.mapInArrow(_sentence_rows(bits), "h long, size long, words binary, starts binary, y int"), most, most_bytes, "mil-sentences")
    documents = [(np.frombuffer(r.words, np.int32), np.frombuffer(r.starts, np.int32).astype(np.int64)) for r in got]
    return NoisyOr(bits).fit(documents, np.array([r.y for r in got], np.int64))


def _toxicity(model, text_col, columns):
    def run(batches):
        for b in slices(batches, 4 << 20, text_col):
            scores, worst, spots = [], [], []
            for text in b.column(text_col).to_pylist():
                found = sentences(text)
                p = model.sentence_scores(found)
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                hits = np.flatnonzero(p >= 0.5)
                spots.append(hits.tolist())
                worst.append(b" ".join(found[int(p.argmax())]).decode() if len(hits) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in columns] + [pa.array(scores, pa.float64()), pa.array(spots, pa.list_(pa.int32())), pa.array(worst, pa.string())],
                [*columns, "score", "offending", "worst_sentence"],
            )

    return run


def score_toxicity(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending, worst_sentence): a row for each row of ``docs``.

    ``offending`` holds the positions of the sentences that are toxic by
    themselves (0.5 or more), ``worst_sentence`` the words of the first of
    the worst.  Null, empty and wordless texts have no sentence and score 0;
    rows that repeat get equal results; null ids are kept; other columns are
    not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_toxicity(model, "text", ["id"]), "id long, score double, offending array<int>, worst_sentence string")


# ---- passages --------------------------------------------------------------------

PASSAGE = 64
FEATURES = 16
#: Learned encodings of words: so many buckets of a word's hash, and numbers for each.
WORD_BITS, WORD_SIZE = 12, 8


def passage_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each run of 64 words, the bucket of each word); one row of zeros and no bucket for a text without words."""
    words = text.encode().split() if text else []
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), np.float32), np.empty(0, np.int16)
    starts = np.arange(0, n, PASSAGE)
    size = np.minimum(PASSAGE, n - starts).astype(np.float64)
    of = np.arange(n) // PASSAGE
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    length = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words), np.uint8)
    at = bounds(length)
    edge = at[np.append(starts, n)]
    chars = np.maximum(1, np.diff(edge)).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[edge[1:]] - total[edge[:-1]]) / chars

    order = np.lexsort((h, of))
    hs, os_ = h[order], of[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])])
    distinct = np.bincount(os_[new], minlength=len(starts)) / size
    runs = np.diff(np.append(np.flatnonzero(new), n))
    most = np.zeros(len(starts))
    np.maximum.at(most, os_[new], runs)
    again = np.concatenate([[False], h[1:] == h[:-1]])
    first, last = flat[at[:-1]], flat[at[1:] - 1]
    per_word = lambda mask: np.bincount(of, mask, len(starts)) / size
    lower = (flat >= 97) & (flat <= 122)
    upper = (flat >= 65) & (flat <= 90)
    digit = (flat >= 48) & (flat <= 57)
    other = flat >= 128
    symbol = ~(lower | upper | digit | other)
    stop = (flat == 46) | (flat == 44)
    mean = np.bincount(of, length, len(starts)) / size
    rows = np.stack(
        [
            np.log1p(size) / 4, mean / 8, distinct, most / size, per_word(again), share(lower), share(upper), share(digit), share(other), share(symbol), share(stop), share(symbol & ~stop),
            per_word((first >= 65) & (first <= 90)), per_word(~((last >= 48) & (last <= 57) | (last >= 65) & (last <= 90) | (last >= 97) & (last <= 122) | (last >= 128))),
            per_word(length <= 2), per_word(length >= 14),
        ],
        axis=1,
    ).astype(np.float32)
    return rows, (h >> np.uint64(64 - WORD_BITS)).astype(np.int16)


class Passages:
    """The passages of several documents, side by side."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]]):
        self.x = np.concatenate([x for x, _ in found]).astype(np.float64)
        self.starts = bounds(np.fromiter((len(x) for x, _ in found), np.int64, len(found)))
        self.words = np.concatenate([w for _, w in found]).astype(np.int64)
        many = np.fromiter((len(w) for _, w in found), np.int64, len(found))
        # the passage of each word: a document's passages begin at its first, every PASSAGE words
        self.of = np.repeat(self.starts[:-1], many) + (np.arange(int(many.sum())) - np.repeat(bounds(many)[:-1], many)) // PASSAGE
        self.many = np.maximum(1, np.bincount(self.of, minlength=len(self.x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """x: a passage's counts and the mean of its words' learned encodings E; h = tanh(A x); weight = softmax over a document's passages of w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum of weight * h)."""

    def __init__(self, hidden: int = 16, gate: int = 8):
        self.hidden, self.gate = hidden, gate

    def _encoded(self, found: Passages) -> np.ndarray:
        means = [np.bincount(found.of, self.p["E"][found.words, k], len(found.x)) / found.many for k in range(WORD_SIZE)]
        return np.column_stack([(found.x - self.mean) / self.scale, *means])

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        e = np.exp(e - np.maximum.reduceat(e, starts[:-1])[doc])
        weight = e / np.add.reduceat(e, starts[:-1])[doc]
        z = np.add.reduceat(h * weight[:, None], starts[:-1], axis=0)
        return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "doc": doc, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, found: Passages) -> tuple[np.ndarray, np.ndarray]:
        """The documents' scores and the passages' attention weights."""
        f = self._forward(self._encoded(found), found.starts)
        return f["y"], f["weight"]

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.01, seed: int = 5) -> GatedAttention:
        rng = np.random.default_rng(seed)
        k, g = self.hidden, self.gate
        every = np.concatenate([x for x, _ in documents]).astype(np.float64) if documents else np.zeros((1, FEATURES))
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        init = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        self.p = {"E": rng.normal(size=(1 << WORD_BITS, WORD_SIZE)) * 0.05, "A": init(FEATURES + WORD_SIZE, k), "a": np.zeros(k), "V": init(k, g), "U": init(k, g), "w": init(g), "c": np.zeros(k), "b": np.zeros(1)}
        m1, m2, t = {n: np.zeros_like(x) for n, x in self.p.items()}, {n: np.zeros_like(x) for n, x in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(documents))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                found = Passages([documents[j] for j in chosen])
                x, starts = self._encoded(found), found.starts
                f, p = self._forward(x, starts), self.p
                dy = (f["y"] - y[chosen]) / len(chosen)
                dz = dy[:, None] * p["c"][None, :]
                dh = dz[f["doc"]] * f["weight"][:, None]
                dw = (dz[f["doc"]] * f["h"]).sum(axis=1)
                de = f["weight"] * (dw - np.add.reduceat(dw * f["weight"], starts[:-1])[f["doc"]])
                dvu = de[:, None] * p["w"][None, :]
                dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
                dh += dv @ p["V"].T + du @ p["U"].T
                da = dh * (1 - f["h"] ** 2)
                dmean = (da @ p["A"][FEATURES:].T) / found.many[:, None]
                de_words = np.column_stack([np.bincount(found.words, dmean[found.of, n], 1 << WORD_BITS) for n in range(WORD_SIZE)])
                grad = {"E": de_words, "A": x.T @ da, "a": da.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dy, "b": np.array([dy.sum()])}
                t += 1
                for n, d in grad.items():
                    m1[n], m2[n] = 0.9 * m1[n] + 0.1 * d, 0.999 * m2[n] + 0.001 * d * d
                    p[n] = p[n] - rate * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.999**t)) + 1e-8)
        return self


def _passage_rows(batches):
    for b in slices(batches, 4 << 20):
        found = [passage_features(t) for t in b.column("text").to_pylist()]
        x, words = ([p[k].tobytes() for p in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([len(p) + len(q) for p, q in zip(x, words, strict=True)], pa.int64()), pa.array(x, pa.binary()), pa.array(words, pa.binary()), b.column("y")], ["h", "size", "x", "words", "y"])


def fit_attention(sample: DataFrame, *, most: int = 16_000, most_bytes: int = FIT_BYTES) -> GatedAttention:
    """Fits on the first ``most`` rows of ``sample`` by a hash, and at most ``most_bytes`` of their encodings."""
    got = bounded_rows(sample.mapInArrow(_passage_rows, "h long, size long, x binary, words binary, y int"), most, most_bytes, "mil-passages")
    documents = [(np.frombuffer(r.x, np.float32).reshape(-1, FEATURES), np.frombuffer(r.words, np.int16)) for r in got]
    return GatedAttention().fit(documents, np.array([r.y for r in got], np.float64))


def _quality(model, text_col, columns):
    def run(batches):
        for b in slices(batches, 4 << 20, text_col):
            found = Passages([passage_features(t) for t in b.column(text_col).to_pylist()])
            y, weight = model.score(found)
            top = [int(weight[s:e].argmax()) for s, e in zip(found.starts[:-1], found.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(y), pa.array(top, pa.int32())], [*columns, "score", "top_passage"])

    return run


def score_quality(docs: DataFrame, model: GatedAttention, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``top_passage`` (the passage of the largest weight, from 0).

    Null, empty and blank texts are one passage of zeros; rows that repeat get
    equal results; null ids are kept; columns of ``docs`` named like results
    are replaced; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("score", "top_passage")]
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, top_passage int"
    return docs.select(*keep).mapInArrow(_quality(model, text_col, keep), schema)
