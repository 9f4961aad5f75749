"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is a part of a text between newlines; its words are what white space parts. Two lines are
alike if one becomes the other by at most one word edit: a word replaced, put in or left out.
A line is removed if a line of the same words stands before it, or, where both have at least
``min_words`` words, a line alike, in order of (key, text hash, line number). Blank lines stay.

1. Every line gets two hashes of its words with seeds of their own, 128 bits; equal lines are one
   class with a first place and a number.
2. A screen that loses nothing: two different lines within one edit agree on all words of the
   first or of the second half (of their length, or of the shorter's), so a class has a
   partner only if one of its four half keys is shared by another class. Only classes are screened,
   so a line that stands a million times counts once.
3. The classes that pass emit all variants with one word deleted, as hashed keys, at the
   places that the shared half leaves open. Lines of n words that differ by a replacement
   share the variant with the same place deleted; a line of n - 1 words is itself the
   variant of a longer line.
4. Equal variants join through the earliest class of each key (an aggregate, never a list of
   a key's members): all members of a key are alike, so only the earliest decides.
5. The words of a line and of the earlier one are compared: the edit distance is verified.

Defined cases: null and empty texts have no lines to remove and stay as they are; white space
around and between words does not tell lines apart; a row is known by its key and the hash of
its text, so different texts under one key, null included, are documents of their own; rows that
repeat both are one document: a line at the same place of a repeated row is the same line and not
removed; a null key stands before all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiercat.llm.common import WORD, body, col, free_name, stored


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tid, line, words) of every line."""
    return (docs.select(col(key).alias("key"), F.xxhash64(body(text)).alias("tid"),
                        F.posexplode(F.split(body(text), "\n")).alias("line", "raw"))
            .select("key", "tid", "line", F.regexp_extract_all("raw", F.lit(WORD), F.lit(0)).alias("words")))


def first_hash(w: Column) -> Column:
    return F.xxhash64(w)


def second_hash(w: Column) -> Column:
    """Seeded by a hash of its own, so it knows nothing of the first."""
    return F.xxhash64(F.lit("second"), w)


def hashed_lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, tid, line, h1, h2, halves) of every line that is not blank; halves only of at least
    ``min_words`` words."""
    n, w = F.col("n"), F.col("words")

    def halves(total: Column, skipped: int) -> list[Column]:
        # of a class of lines with `total` words: the first half, and the last words that make
        # up the second half (for a longer line, one word lies between)
        a = F.floor(total / 2).cast("int")
        tag = total * 2
        return [F.xxhash64(tag, F.slice(w, F.lit(1), a)),
                F.xxhash64(tag + 1, F.slice(w, a + 1 + skipped, total - a))]

    base = lines(docs, key, text).withColumn("n", F.size("words")).where(n > 0)
    return base.select(
        "key", "tid", "line", first_hash(w).alias("h1"), second_hash(w).alias("h2"),
        F.when(n >= min_words, F.array(*halves(n, 0), *halves(n - 1, 1))).alias("halves"))


def partnered(classes: DataFrame) -> DataFrame:
    """(no, sides): the classes that share a half key with a different one, and which: 0, 1 with
    a line of as many words whose first or second half is the same, 2, 3 with a line of one
    word less, 4 with one of one word more."""
    halves = classes.select("no", F.posexplode("halves").alias("side", "half"))
    level = F.when(F.col("side") < 2, F.col("no"))
    shared = stored(halves.groupBy("half").agg(
        F.min(level).alias("a"), F.max(level).alias("b"), F.max("side").alias("top"))
        .where("a <> b OR (a IS NOT NULL AND top >= 2)")
        .select("half", (F.col("a") != F.col("b")).alias("equal"), (F.col("top") >= 2).alias("longer")), "line-halves")
    met = halves.join(shared, "half").where("side >= 2 OR equal OR longer")
    sides = F.when(F.col("side") >= 2, F.array("side")).otherwise(F.filter(
        F.array(F.when(F.col("equal"), F.col("side")), F.when(F.col("longer"), F.lit(4))),
        lambda x: x.isNotNull()))
    return met.select("no", F.explode(sides).alias("side")).groupBy("no") \
        .agg(F.collect_set("side").alias("sides"))


def variants(candidates: DataFrame) -> DataFrame:
    """(no, v, role) of candidates (no, n, sides, words): hashes of the line without one word, at
    the places that the shared halves leave open. Role s meets lines of as many words with the
    same place deleted; x, a variant, meets y, the whole line of one word less."""
    w = candidates.repartition("no").select(
        "no", "n", "sides", F.posexplode("words").alias("place", "word")).select(
        "no", "n", "sides", "place", F.xxhash64("word", "place").alias("here"),
        F.xxhash64("word", F.col("place") - 1).alias("before"))
    line = Window.partitionBy("no")
    run = line.orderBy("place")
    w = (w.withColumn("head", F.bit_xor("here").over(run.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("tail", F.bit_xor("before").over(run.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("all_tail", F.bit_xor("before").over(line)))
    # without the word at a place: words before it count with their place, words behind it with
    # the place before
    x = lambda *c: reduce(lambda a, b: a.bitwiseXOR(b), c)
    left = x(F.col("head"), F.col("here"), F.col("tail"), F.col("all_tail"))
    has = lambda k: F.array_contains("sides", k)
    n, place = F.col("n"), F.col("place")
    half, less = F.floor(n / 2), F.floor((n - 1) / 2)
    role = lambda name, when, *parts: F.when(
        when, F.struct(F.xxhash64(*parts).alias("v"), F.lit(name).alias("role")))
    found = F.array(
        role("s", (has(0) & (place >= half)) | (has(1) & (place < half)), F.lit(0), n, place, left),
        role("x", (has(2) & (place >= less)) | (has(3) & (place <= less)), F.lit(1), n - 1, left),
        role("y", has(4) & (place == n - 1), F.lit(1), n, F.col("head")))
    w = w.select("no", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r"))
    return w.select("no", "r.v", "r.role")


def _alike(a: Column, b: Column) -> Column:
    """Whether word lists a, b are within one word edit: their common beginning and their common
    end leave at most one word of the longer."""
    short = F.least(F.size(a), F.size(b))
    unlike = lambda p, q: F.array_position(F.zip_with(
        F.slice(p, F.lit(1), short), F.slice(q, F.lit(1), short), lambda x, y: x != y), True)
    alike = lambda at: F.when(at == 0, short.cast("long")).otherwise(at - 1)
    return alike(unlike(a, b)) + alike(unlike(F.reverse(a), F.reverse(b))) \
        >= F.greatest(F.size(a), F.size(b)) - 1


def candidate_words(docs: DataFrame, key: str, text: str, chosen: DataFrame, broadcast_rows: int) -> DataFrame:
    """``chosen`` (key, tid, line, ...) with the words of each line. At most ``broadcast_rows`` places
    travel to the texts; more meet them by a shuffle."""
    places = stored(chosen, "line-places")
    small = places.limit(broadcast_rows + 1).count() <= broadcast_rows
    at = places.groupBy("key", "tid").agg(
        F.collect_list(F.struct(*[c for c in places.columns if c not in ("key", "tid")])).alias("at"))
    d = docs.select(col(key).alias("doc_key"), F.xxhash64(body(text)).alias("doc_tid"), body(text).alias("body"))
    same = F.col("doc_key").eqNullSafe(F.col("key")) & (F.col("doc_tid") == F.col("tid"))
    got = d.join(F.broadcast(at) if small else at, same).select(
        "key", "tid", F.split("body", "\n").alias("parts"), F.explode("at").alias("a"))
    words = F.regexp_extract_all(F.get("parts", F.col("a.line")), F.lit(WORD), F.lit(0))
    return got.select("key", "tid", "a.*", words.alias("words")).where(
        (first_hash(F.col("words")) == F.col("h1")) & (second_hash(F.col("words")) == F.col("h2")))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5,
                  broadcast_rows: int = 500_000) -> DataFrame:
    """(key, tid, line) of every line that goes."""
    each = stored(hashed_lines(docs, key, text, min_words), "lines")
    classes = stored(each.groupBy("h1", "h2").agg(
        F.min(F.struct("key", "tid", "line")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.first("halves").alias("halves")).withColumn("no", F.monotonically_increasing_id()), "line-classes")
    # the classes that have a partner, with their words, numbered in order of their first places
    chosen = classes.join(partnered(classes.where("halves IS NOT NULL")), "no").select(
        "first.key", "first.tid", "first.line", "h1", "h2", "sides")
    got = candidate_words(docs, key, text, chosen, broadcast_rows).dropDuplicates(["h1", "h2"])
    candidates = stored(got.repartitionByRange("key", "tid", "line").sortWithinPartitions("key", "tid", "line").select(
        F.monotonically_increasing_id().alias("no"), "h1", "h2", "sides", F.size("words").alias("n"), "words"),
        "line-candidates")

    v = stored(variants(candidates), "line-variants")
    low = stored(v.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("no").alias("least"),
                                    F.min(F.when(F.col("role") == "y", F.col("no"))).alias("y"))
                 .where("m > 1").drop("m"), "line-keys")
    # a variant is alike to the whole line y only; the others to the earliest of their key
    earlier = F.when(F.col("role") == "x", F.col("y")).otherwise(F.col("least"))
    pair = v.join(low, "v").select("no", earlier.alias("earlier")).where("earlier < no").distinct()
    a = candidates.select("no", "h1", "h2", "words")
    b = candidates.select(F.col("no").alias("earlier"), F.col("words").alias("words_b"))
    near = (pair.join(a, "no").join(b, "earlier").where(_alike(F.col("words"), F.col("words_b")))
            .select("h1", "h2").distinct().withColumn("near", F.lit(True)))

    # written tables on both sides of the join, so a line that stands very often is dealt out by the planner
    marked = stored(classes.join(near, ["h1", "h2"], "left").where("copies > 1 OR near").select(
        "h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "marked-classes")
    is_first = F.struct("key", "tid", "line").eqNullSafe(F.col("first"))
    return each.select("key", "tid", "line", "h1", "h2").join(marked, ["h1", "h2"]) \
        .where(F.col("near") | ~is_first).select("key", "tid", "line")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5,
                drop_copies: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs``, all columns, texts without the removed lines, and two columns more, the last ones, that count
    the lines before and those removed: ``n_lines`` and ``n_removed``, or with more underscores where ``docs``
    has such columns. A text that keeps all its lines is unchanged, null included. ``drop_copies`` drops
    the texts that lose all lines but blank ones."""
    removed = removed_lines(docs, key, text, min_words, broadcast_rows)
    gone = removed.groupBy("key", "tid").agg(F.collect_set("line").alias("gone")).alias("g")
    d = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(key).alias("key"),
                    F.xxhash64(body(text)).alias("tid"), F.split(body(text), "\n").alias("parts")).alias("d")
    j = d.join(gone, F.col("d.key").eqNullSafe(F.col("g.key")) & (F.col("d.tid") == F.col("g.tid")), "left") \
        .select("row", "parts", "gone")
    lost = F.coalesce(F.size("gone"), F.lit(0))
    if drop_copies:
        full = F.filter("parts", lambda x: x.rlike(WORD))
        j = j.where(F.col("gone").isNull() | (lost < F.size(full)))
    # the numbers of the lines that stay, by one hashed set
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    field = lambda c: F.col("row").getField(c)
    new = F.when(F.col("gone").isNull(), field(text)).otherwise(kept)
    return j.select(*[(new if c == text else field(c)).alias(c) for c in docs.columns],
                    F.size("parts").cast("long").alias(free_name(docs, "n_lines")),
                    lost.cast("long").alias(free_name(docs, "n_removed")))
