"""Exact quotas and membership against a brute-force Python split, including a class
that holds most rows (the boundary bucket path)."""

import hashlib
from collections import defaultdict
from fractions import Fraction
import math

from pyspark.sql import functions as F

from tiercat.operators.split import stratified_split


def brute_split(rows, test_size=0.2, seed=42):
    by = defaultdict(list)
    for k, c in rows:
        by[c].append(k)
    n = len(rows)
    n_train = n - math.ceil(test_size * n)
    base, rem = {}, {}
    for c, ks in by.items():
        q = Fraction(len(ks) * n_train, n)
        base[c] = math.floor(q)
        rem[c] = q - base[c]
    need = n_train - sum(base.values())
    for c in sorted(by, key=lambda c: (-rem[c], c))[:need]:
        base[c] += 1
    out = {}
    for c, ks in by.items():
        ks = sorted(ks, key=lambda k: (hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), k))
        for i, k in enumerate(ks):
            out[k] = "train" if i < base[c] else "val"
    return out


def test_split_matches_brute_force_with_hot_class(spark):
    # class 'hot' holds ~70% of rows, so its boundary falls inside one hash bucket
    rows = [(i, "hot" if i % 10 < 7 else f"c{i % 10}") for i in range(20000)]
    df = spark.createDataFrame(rows, "k long, c string")
    got = {r.k: r.split for r in stratified_split(df, "c", "k").collect()}
    assert got == brute_split(rows)


def test_split_tiny_classes(spark):
    rows = [(i, f"c{i % 7}") for i in range(23)] + [(100, "single")]
    df = spark.createDataFrame(rows, "k long, c string")
    got = {r.k: r.split for r in stratified_split(df, "c", "k").collect()}
    assert got == brute_split(rows)
    assert sum(v == "val" for v in got.values()) == math.ceil(0.2 * len(rows))
