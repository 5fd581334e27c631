import random
import zlib
from collections import defaultdict

import numpy as np

from motionfield.llm.packing import Packer, WordTokenizer, pack
from motionfield.llm.queries import op2_packing, tokenizer_path

SF = "/root/testdata/sf0.001"


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check(docs, pieces, length=2048):
    """Every id lies in exactly one piece, sequences are gapless; returns the padding."""
    ids = defaultdict(list)
    for (i, _), x in zip(docs, whole([t for _, t in docs]), strict=True):
        ids[i].append(x)
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        seen[p.id].append((p.start, list(np.frombuffer(p.ids, "<u4")), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(seen) == set(ids)
    for i, xs in ids.items():
        assert sum(len(x) for x in xs) == sum(len(s[1]) for s in seen[i])
        if len(xs) == 1:
            got = [t for _, part, _ in sorted(seen[i]) for t in part]
            assert got == xs[0] and all(n == len(xs[0]) for _, _, n in seen[i])
            assert [s for s, _, _ in sorted(seen[i])] == list(np.cumsum([0] + [len(p) for _, p, _ in sorted(seen[i])])[:-1])
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
    return pad


def test_query_keeps_every_id(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pieces = pack(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), tokenizer_path()).collect()
    assert check(docs, pieces) < 2048
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in op2_packing(spark, SF).collect()}
    ids = dict(zip([i for i, _ in docs], whole([t for _, t in docs]), strict=True))
    for r in op2_packing(spark, SF).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 == crc[(r.doc_id, r.start)]


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "null id"), (3, "Same, same. It's x' <|endoftext|> 'Re"), (3, "Same, same. It's x' <|endoftext|> 'Re"), (4, "long words " * 30000), (5, "ÉCOLE é a..,, b%%%, c's.'t")]
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in docs], "doc_id long, text string, start int, ids string")
    check(docs, pack(df.repartition(3), tokenizer_path()).collect())
    assert pack(df.limit(0), tokenizer_path()).collect() == []


def test_word_tokenizer_equals_whole_text():
    rng = random.Random(2)
    alphabet = list("abAB.,'’sdé́ß%1２ \n\t \u0085İΣK!?-") + ["'ll", "<|", "<|startoftext|>", "n't", "🙂"]
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]
    t = WordTokenizer(tokenizer_path())
    ids, lengths = t.encode(texts)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for k, (text, want) in enumerate(zip(texts, whole(texts), strict=True)):
        assert ids[at[k] : at[k + 1]].tolist() == want[:-1], text


def test_packer_bounds_open_windows():
    rng = random.Random(4)
    p = Packer(100, 4)
    total = 0
    for k in range(2000):
        n = rng.randint(1, 250)
        total += n
        p.put((k, 0, n))
        assert len(p.windows) <= 4
    rest = p.finish()
    assert all(w[0] == 100 for w in p.closed)
    assert sum(w[0] for w in p.closed) + (rest[0] if rest else 0) == total
