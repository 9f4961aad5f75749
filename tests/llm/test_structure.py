"""Conversation repair, Merkle manifest and fingerprints against plain versions."""
import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import with_clashes
from tiercat.llm import conversation as cv, fingerprint as fp, merkle
from tiercat.llm.common import ranked

SMALL = "/root/testdata/sf0.001"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- places

def test_ranked(spark):
    rows = [(g, v) for g, n in ((None, 3), ("a", 1), ("b", 700), ("c", 50)) for v in range(n)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = {(r.g, r.v): (r.start, r.at, r.size) for r in ranked(d, "g", [F.col("v")], "test").collect()}
    begin = {None: 0, "a": 3, "b": 4, "c": 704}
    sizes = Counter(g for g, _ in rows)
    assert got == {(g, v): (begin[g], v, sizes[g]) for g, v in rows}


# --- conversations

def _initials_ok(s):
    return re.fullmatch("(s?(ua)+)?", s) is not None


def _cheapest(turns):
    """(cost, audit, repaired) by a search over all edits; turns: (role, text, gone, cut)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, state, fixed = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in fixed)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for c, role in (("u", "user"), ("a", "assistant")):
            if c in fits:
                heapq.heappush(heap, (cost + 5, audit + "I", i, c, fixed + ((role, ""),)))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, fixed))
            if not gone:
                first = (role or "")[:1]
                if first and first in fits:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, first, fixed + ((role, text),)))
                for c, new in (("u", "user"), ("a", "assistant")):
                    if c in fits:
                        heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, c, fixed + ((new, text),)))


def _plain_repair(rows):
    """{conv: the report} of rows (conv, turn, role, text)."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", H(
        f"{'-' if r[0] is None else r[0]}:{'-' if r[2] is None else f'{len(r[2].encode())}:{r[2]}'}:{r[3] or ''}"))
    for conv in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == conv), key=key)
        seen, turns, blank, dup, trunc = set(), [], 0, 0, 0
        for _, _, role, text in line:
            t = (text or "").rstrip(" \t\n\v\f\r")
            is_blank, again = not t, (role, text or "") in seen
            seen.add((role, text or ""))
            cut = not is_blank and not again and t[-1] not in ".!?"
            blank, dup, trunc = blank + is_blank, dup + (again and not is_blank), trunc + cut
            turns.append((role, text or "", is_blank or again, cut))
        pairs = ["".join((r or "")[:1] or "-" for r, *_ in p) for p in zip(turns, turns[1:])]
        numbers = {r[1] for r in line if r[1] is not None}
        cost, audit, fixed = _cheapest(turns)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, blank, dup, trunc,
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, H(fixed))
    return out


ROLES = ["user", "assistant", "system", "tool", "", None, "U", "sys"]
TEXTS = ["A question?", "An answer.", "cut off", "", None, " \t\n", "Done! \n", "é.", "x" * 5000 + "."]


def _made(n, conversations, seed):
    r = random.Random(seed)
    return [(r.choice(conversations), r.choice([*range(12), None]), r.choice(ROLES), r.choice(TEXTS)) for _ in range(n)]


def _report(df, **more):
    report, turns = cv.repair(df, "conv_id", **more)
    return {r.key: tuple(r[1:]) for r in report.collect()}, turns


@pytest.mark.parametrize("chunk, passes", [(2048, 4), (3, 4), (2, 0)])
def test_repair(spark, chunk, passes):
    rows = _made(160, [1, 2, 3, 4, 5, None], 3) + [(9, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(31)] \
        + [(8, i, "user", " ") for i in range(9)] + [(7, 1, "user", "Only one.")] \
        + [(6, i // 2, "assistant", f"More {i}?") for i in range(8)]
    d = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got, turns = _report(d, chunk=chunk, passes=passes)
    assert got == _plain_repair(rows)
    by = {}
    for r in turns.collect():
        by.setdefault(r.key, []).append((r["at"], r.sub, r.role, r.text))
    for k, line in by.items():
        line = sorted(line)
        assert H("\n".join(f"{r}:{t}" for *_, r, t in line)) == got[k][-1]
        assert _initials_ok("".join(r[0] for *_, r, _ in line))


def test_repair_of_no_rows(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got, turns = _report(d)
    assert got == {} and turns.count() == 0


def test_fix_up_passes_meet_the_sequential_costs(spark):
    """A long conversation without any fault, of odd length: its chunks' vectors never converge."""
    line = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(101)]
    d = spark.createDataFrame(line, "conv_id long, turn long, role string, text string")
    want = _plain_repair(line)
    for passes in (0, 2, 60):
        assert _report(d, chunk=4, passes=passes)[0] == want


@pytest.mark.parametrize("seed", range(30))
def test_vectors_and_traces(seed):
    r = random.Random(seed)
    codes = [r.choice((0, 1, 2, 3)) + 4 * (r.random() < .2) + 8 * (r.random() < .2) for _ in range(r.randrange(1, 8))]
    roles = {0: "s", 1: "u", 2: "a", 3: "x"}
    want = _cheapest([(roles[c & 3], "", bool(c & 8), bool(c & 4) and not c & 8) for c in codes])
    letters, state, cost = cv.trace([c & ~4 if c & 8 else c for c in codes], cv.END, True)[0]
    assert (cost, letters.replace("S", "K")) == want[:2] and state in (0, 3)


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c} {t}?") for c in (*range(20), None) for t in (*range(5), None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            new = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            want[(c, t, "user" if fault == 4 else role, new)] += 1 + (fault == 3)
    assert Counter(tuple(r) for r in cv.damaged(d).collect()) == want


# --- Merkle

def _tree(leaves, arity):
    """(root, [[(left, right) of each level] of each leaf])."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % arity:i - i % arity + arity]
            paths[k].append(("".join(run[:i % arity]), "".join(run[i % arity + 1:])))
        at = [i // arity for i in at]
        nodes = [H("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def _plain_manifest(rows, arity):
    """Counter of (key, leaf, subroot, root, path) of rows (key, group, fields)."""
    leaf = lambda f: H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in f))
    groups = {}
    for k, g, f in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, leaf(f)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])], arity) for g in names}
    root, top = _tree([trees[g][0] for g in names], arity)
    return Counter((k if there else None, h, trees[g][0], root, tuple(p + up)) for g, up in zip(names, top)
                   for (there, k, h), p in zip(sorted(groups[g]), trees[g][1]))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _manifest(d, arity):
    m = merkle.manifest(d, arity=arity).collect()
    return m, Counter((r.key, r.leaf, r.subroot, r.root, tuple(tuple(p) for p in r.path)) for r in m)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifest(spark, nasty, arity):
    more = spark.createDataFrame([(i % 90, f"text {i}", ("en", "x", "É", None)[i % 4 * (i > 20)], "s") for i in range(150)],
                                 "doc_id long, text string, lang string, source string")
    for d in (nasty, nasty.unionByName(more, allowMissingColumns=True), nasty.where("doc_id = 9")):
        rows = [(r.doc_id, r.lang, [r[f] for f in FIELDS]) for r in d.select(*FIELDS).collect()]
        m, got = _manifest(d, arity)
        assert got == _plain_manifest(rows, arity)


def test_manifest_of_no_rows(empty):
    assert merkle.manifest(empty).count() == 0


def test_proofs_tell_tampering(spark, nasty):
    m = merkle.manifest(nasty, carry={"other": F.sha2(F.lit("another"), 256)})
    r = m.select("root", merkle.folded(F.col("path"), F.col("leaf")).alias("same"),
                 merkle.folded(F.col("path"), F.col("other")).alias("unlike"),
                 merkle.proof(F.col("path")).alias("proof"), "path").collect()
    assert all(x.same == x.root != x.unlike for x in r)
    assert all(x.proof == H("".join(p.left + p.right for p in x.path)) for x in r)


# --- fingerprints

def _written(text, steps):
    """What the walk writes down in its first ``steps`` steps, one step at a time."""
    moves = fp._mix(np.arange(1, fp.PHASES * fp.CLASSES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    out, i = [], 0
    for j in range(steps):
        if i == len(text):
            break
        c = ord(text[i])
        out.append(c)
        i += int(moves[(j % fp.PHASES) * fp.CLASSES + ((c ^ (c >> 8) * 37) & (fp.CLASSES - 1))])
    return out


@pytest.mark.parametrize("few", [1, fp.FEW, 1000])
def test_walks(monkeypatch, few):
    monkeypatch.setattr(fp, "FEW", few)
    r = random.Random(5)
    texts = ["", "a", "été 漢字 \U0001f600", "ab" * 3000] + ["".join(r.choices("abcdeé ", k=r.randrange(200))) for _ in range(40)]
    step, begin, steps = fp._walks([fp._code_points(t) for t in texts])
    for k, t in enumerate(texts):
        w = _written(t, 10 ** 6)
        assert len(w) == steps[k]
        own = step[begin[k]:begin[k + 1]]
        assert [ord(t[own.searchsorted(j, "right") - 1]) for j in range(len(w))] == w


def test_likeness_follows_the_walks(spark):
    r = random.Random(6)
    base = "".join(r.choices("abcdefghij ", k=3000))
    for edits in (0, 1, 5, 30):
        t = list(base)
        for _ in range(edits):
            i = r.randrange(len(t))
            t[i:i + 1] = r.choice(([], ["x"], [t[i], "y"]))
        a, b = _written(base, 10 ** 6), _written("".join(t), 10 ** 6)
        share = sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))
        w = fp.embed([base, "".join(t)]).view(np.uint64)
        like = 1 - 2 * int(np.bitwise_count(w[0] ^ w[1]).sum()) / fp.BITS
        assert abs(like - share) < .18 and (edits or like == 1)


def test_draws_are_consistent_and_even():
    d = fp._Tables.load().draws
    at = lambda n: np.where(d < n, d, -1).max(axis=1)
    assert abs(at(1000).mean() - 500) < 60 and abs((at(1000) == at(900)).mean() - .9) < .06
    assert (at(1) == 0).all()


def test_fingerprints(spark, nasty, empty):
    rows = nasty.select("doc_id", "text").collect()
    got = fp.fingerprints(nasty).collect()
    of = {}
    for r in got:
        of.setdefault(r.key, []).append((r.n_chars, tuple(r.fp)))
    want = fp.embed([x.text or "" for x in rows])
    for x, w in zip(rows, want.tolist()):
        assert (len(x.text or ""), tuple(w)) in of[x.doc_id]
    assert of[3][0][1] == of[4][0][1] and of[10][0][1] == of[11][0][1] and len(got) == len(rows)
    assert fp.fingerprints(empty).count() == 0 and fp.against_edited(empty).count() == 0
    assert fp.classes(fp.fingerprints(empty)).count() == 0


def _unlike(a, b):
    return int(np.bitwise_count(np.array(a).view(np.uint64) ^ np.array(b).view(np.uint64)).sum())


@pytest.mark.parametrize("partitions", [1, 4])
def test_against_edited(spark, nasty, partitions):
    d = nasty.repartition(partitions)
    rows = [(r.doc_id, r.text or "", r.tid) for r in d.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) tid").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = Counter()
    for (k, t, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        e = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        own, new, nxt = fp.embed([t, e, after]).tolist()
        want[(k, len(t), H(e), tuple(own), tuple(new), tuple(nxt))] += 1
    got = Counter((r.key, r.n_chars, r.edited_sha256, tuple(r.fp), tuple(r.edited_fp), tuple(r.next_fp))
                  for r in fp.against_edited(d).collect())
    assert got == want
    one = fp.against_edited(d.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].next_fp == one[0].fp


def test_likeness_column(spark):
    a, b = fp.embed(["one text of some length here"] * 2 + [""])[[0, 2]].tolist()
    d = spark.createDataFrame([(a, a), (a, b)], "a array<long>, b array<long>")
    got = [r[0] for r in d.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, max(0.0, 1 - 2 * _unlike(a, b) / fp.BITS)]


@pytest.mark.parametrize("block", [2048, 3])
def test_classes(spark, block, monkeypatch):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = "".join(r.choices("abcdefghijklmn ", k=2500))
        texts += [base, base] + [base[:i] + "Q" + base[i + 1:] for i in r.sample(range(2500), 4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (None, texts[0]), (None, "alone in its class")]
    monkeypatch.setattr(fp.links, "__defaults__", (0.9, block))
    each = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = fp.classes(each).collect()
    words = {r.key: r.fp for r in got}
    # brute force: every pair of distinct fingerprints that shares a band and is alike
    fps = sorted({tuple(x.fp) for x in got})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    half = lambda f: {(i, x & 0xFFFFFFFF) for i, x in enumerate(f)} | {(i, x >> 32, 1) for i, x in enumerate(f)}
    for a, b in itertools.combinations(fps, 2):
        if _unlike(a, b) <= int(.1 * fp.BITS / 2) and half(a) & half(b):
            root[find(a)] = find(b)
    low = {}
    for x in got:
        if x.key is not None:
            f = find(tuple(x.fp))
            low[f] = min(low.get(f, x.key), x.key)
    assert Counter((x.key, x.class_id) for x in got) == Counter((x.key, low.get(find(tuple(x.fp)))) for x in got)
    assert words[1000] == words[1001] and len(got) == len(rows)


def test_awkward_rows_of_conversations(spark):
    d = spark.createDataFrame([(None, None, None, None), (1, None, "", " "), (1, 1, "user", "x" * 200_000)] * 2,
                              "conv_id long, turn long, role string, text string")
    rows = [tuple(r) for r in d.collect()]
    assert _report(with_clashes(d))[0] == _plain_repair(rows)
