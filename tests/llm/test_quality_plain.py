"""The quality query against a plain version: statistics by loops, scores by looking up one entry after another."""
import math
import zlib
from collections import Counter

import numpy as np
import xxhash

from tiercat.llm import gam, quality

SMALL = "/root/testdata/sf0.001"
SPACE = b" \t\n\r\x0b\x0c"


def _features(text):
    raw = (text or "").encode()
    words, word = [], b""
    for c in raw + b" ":
        if bytes([c]) in [bytes([s]) for s in SPACE]:
            words += [word] * bool(word)
            word = b""
        else:
            word += bytes([c])
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, size = len(words), len(raw)
    share = lambda test: sum(1 for c in raw if c < 128 and test(chr(c))) / size
    upper, lower = share(lambda c: "A" <= c <= "Z"), share(lambda c: "a" <= c <= "z")
    lines = [x for x in raw.split(b"\n") if any(bytes([c]) not in [bytes([s]) for s in SPACE] for c in x)]
    twins = sum(1 for a, b in zip(words, words[1:]) if a == b)
    pairs = {(a, b) for a, b in zip(words, words[1:])}
    # control characters that are no white space stand for marks too
    mark = share(lambda c: not c.isalnum() and not c.isspace())
    junk = sum(1 for w in words if 33 <= w[-1] < 127 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ".,;:'\"?()-")
    return [
        math.log1p(n), sum(map(len, words)) / n, max(map(len, words)) / 10, len(set(words)) / n ** .75, twins / n,
        upper / (upper + lower + 1e-9), sum(1 for w in words if w[:1].isupper()) / n, share(str.isdigit),
        share(lambda c: c in " \t\r\n\v\f"), mark, share(lambda c: c in "#$%&*+/<=>@[\\]^_`{|}~"), share(lambda c: c == "!"),
        sum(1 for c in raw if c >= 128) / size, share(lambda c: c == "."), share(lambda c: c == ","), n / len(lines),
        1 - len(set(lines)) / len(lines), max(Counter(words).values()) / n, len(pairs) / n, junk / n]


def _score(model, x):
    margin, at = model.intercept, []
    for f, v in enumerate(x):
        b = sum(1 for c in model.cuts[f] if c <= v)
        margin += model.tables[f][b]
        at.append(model.coarse[f][b])
    for i, j, table in model.pairs:
        margin += table[at[i], at[j]]
    return 1 / (1 + math.exp(-max(-35, min(35, margin))))


def test_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000")
    lab = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: np.array(_features(r.text), np.float32).astype(float) for r in docs.collect()}
    signed = lambda k: int.from_bytes(xxhash.xxh64(k.to_bytes(8, "little", signed=True), 42).digest(), "big", signed=True)
    learn = sorted((signed(r.doc_id), rows[r.doc_id].tolist(), float(r.quality)) for r in lab.collect()
                   if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 5)
    model = gam.fit(np.array([x for _, x, _ in learn]), np.array([y for *_, y in learn]))
    got = {r.key: r for r in quality.classify(docs, lab).collect()}
    assert got.keys() == rows.keys() and len(learn) > 30
    for k, x in rows.items():
        assert abs(got[k].score - _score(model, x)) < 1e-6
        assert got[k].predicted == (got[k].score >= .3) and got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
