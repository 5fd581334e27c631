import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from motionfield.llm.align import align_tokens, byte_level, sides

PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(tools, docs):
    code, (ta, tb) = byte_level(), tools
    rows, counts = [], Counter()
    for i, text in docs:
        ia = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = tb.encode(text) if text else []
        pa = [bytes(code[c] for c in ta.id_to_token(k)) for k in ia]
        pb = [bytes([int(tb.id_to_piece(k)[3:5], 16)]) if tb.is_byte(k) else tb.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        if not text or not b"".join(pa) == b"".join(pb) == (" " + text).encode():
            ia, ib, pa, pb = [], [], [], []
        sa, sb = spans(pa), spans(pb)
        links = [(x, y) for x, (s, e) in zip(ia, sa, strict=True) for y, (u, v) in zip(ib, sb, strict=True) if s < v and u < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        for hi in cuts:
            groups.append(",".join(str(x) for x, (s, _) in zip(ia, sa, strict=True) if lo <= s < hi) + "|" + ",".join(str(y) for y, (s, _) in zip(ib, sb, strict=True) if lo <= s < hi))
            lo = hi
        counts.update(links)
        rows.append((i, len(ia), len(ib), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted((repr(i), a, b, g, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if a else "", s) for i, a, b, g, links, s in rows)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, pair int, block string").repartition(3)
    rows = align_tokens(df, *PATHS, with_groups=True, **kw).collect()
    return sorted((repr(r.id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in rows)


def test_against_brute_force(spark, tools):
    rng = random.Random(6)
    words = "the naïve  \n\t Schlüssel 漢字 <s> </s> <|endoftext|> <unk> ▁ don't 12345 🙂👩‍👩‍👧 é ...   x=1; Éàü ﬁ \x00 abcabcabc Ünï <0x41>".split(" ")
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(60)]
    docs += [(k, "".join(chr(rng.choice([rng.randint(1, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1FAFF)])) for _ in range(30))) for k in range(100, 130)]
    docs += [(70, None), (71, ""), (72, " "), (73, "\n"), (None, docs[3][1]), (5, docs[5][1]), (5, "again"), (74, "▁a▁▁b"), (75, "long " * 3000)]
    got, want = run(spark, docs), brute(tools, docs)
    assert got == want and sum(r[1] for r in got) > 1000
    # blocks of a batch each give the same counts
    assert run(spark, docs, block_bytes=1) == want


def test_edges(spark, tools):
    assert run(spark, []) == []
    none = [(1, None), (2, "")]
    assert run(spark, none) == brute(tools, none) == [("1", 0, 0, 0, 0, 0, 0, "", ""), ("2", 0, 0, 0, 0, 0, 0, "", "")]


def test_both_readers_of_the_vocabulary_agree(tools):
    """Ids as ranks give what the tokenizer's own file gives, for every character and at words' ends."""
    own = sides(*PATHS)
    for lo in range(0, 0x30000, 0x100):
        if not 0xD800 <= lo < 0xE000:
            text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(lo, lo + 0x100))
            assert own.a.encode_ordinary(" " + text) == tools[0].encode(" " + text, add_special_tokens=False).ids
