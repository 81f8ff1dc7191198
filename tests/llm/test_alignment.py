"""Alignment against whole encodings and plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import alignment, queries, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def ranges(parts):
    out, at = [], 0
    for i, raw in parts:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def by_force(rows):
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in letters)}
    found = []
    for i, text in rows:
        none = (i, 0, 0, [], "")
        if not text:
            found.append(none)
            continue
        a = [(t, bytes(table[c] for c in a_tok.id_to_token(t))) for t in a_tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(t, bytes([int(p[3:5], 16)]) if b_tok.is_byte(t) else p.replace("▁", " ").encode()) for t, p in ((t, b_tok.id_to_piece(t)) for t in b_tok.encode(text))]
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append(none)
            continue
        a, b = ranges(a), ranges(b)
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start, p, q = [], 0, 0, 0
        links = []
        for cut in shared:
            left, right = [], []
            while p < len(a) and a[p][2] <= cut:
                left.append(a[p])
                p += 1
            while q < len(b) and b[q][2] <= cut:
                right.append(b[q])
                q += 1
            links += [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
            groups.append(",".join(str(x[0]) for x in left) + "|" + ",".join(str(y[0]) for y in right))
        found.append((i, len(a), len(b), links, ";".join(groups)))
    counts = Counter(pair for *_, links, _ in found for pair in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (i, n_a, n_b, text.count(";") + 1 if text else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for i, n_a, n_b, links, text in found
    ], counts


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = queries.op11_cross_tokenizer_alignment(spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert key(got.collect()) == key(by_force([(r.doc_id, r.text) for r in docs.collect()])[0])


ODD = [None, "", " ", "  ", "a ", "a  ", " a", "\n", "x\n  y", "tab\tand space 　 wide", "▁ mark", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ① ½ é é", "日本語の 文章。テスト", "😀 👍🏽 zwj 👩‍👩‍👧", "\x00 nul\x01", "};\r\n if (x) {\r\n}", "z" * 3000, "same words same words same", "same words same words same"]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 20, 0])
def test_odd_rows_whatever_is_sent(spark, broadcast_rows):
    rng = random.Random(6)
    words = ["the", "token", "izer,", "über-", "x1", "  ", "\n", "\t", "日本", "😀", "'s", "…", "re\r\n", "don't"]
    rows = list(enumerate([*ODD, *["".join(rng.choice([" ", "", " "]) + rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]]))
    rows += [(None, "no id"), (None, "no id"), (7, "repeated id")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("k") for c in ("id", "row", "pair", "n", "best", "links", "times")}).repartition(4)
    docs, pairs = alignment.align_tokens(df, A, B, broadcast_rows=broadcast_rows)
    want, counts = by_force(rows)
    assert key(docs.collect()) == key(want)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "segments", lambda text: texts.segments(text, 50))
    aligner = alignment.Aligner(A, B, memory=10)
    rows = [(0, "words of a long text, with  runs\n of white space " * 20), (1, "y" * 400 + " tail"), (2, "a ▁b " * 40)]
    sums, digests, offsets, pairs, times = aligner.align([t for _, t in rows])
    want, _ = by_force(rows)
    assert [(*s, d) for s, d in zip(sums.tolist(), digests)] == [(w[1], w[2], w[3], w[4], w[7]) for w in want]
    assert [int(times[a:b].sum()) for a, b in zip(offsets[:-1], offsets[1:])] == [w[4] for w in want]


def test_empty(spark):
    docs, pairs = alignment.align_tokens(spark.createDataFrame([], DOCS), A, B)
    assert docs.count() == 0 and pairs.count() == 0
