"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words between blanks.  Two lines are near if one word inserted, deleted or replaced
turns one into the other.  A line is dropped if an equal or near line stands earlier, in order of
(doc_id, text's hash, line number); whether that one is kept itself doesn't matter, so the result
doesn't depend on any order of work.  Equal lines are dropped however short they are; lines under
`near` words only for equal ones: one word of four is no small edit (similarity 0.8 asks for five).

Every line emits its variants with one word deleted, as hashed keys, and itself.  Lines that share
a variant with the same place deleted differ by a replacement; a line that equals a variant of
another differs by a deletion.  So minima over equal keys name each line's earliest partner, without
ever listing the pairs of a group, and the words of both are compared in the end.  Where those say
that keys were equal by chance, the line asks again under other keys, so no partner is hidden.

Before that, lines without any partner are left out without loss: near lines have the words before
or behind the middle in common, so a line none of whose halves occurs in another line has no
variants to emit.  Words travel only until that is known.  Equal lines are equal in two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, look_up, unused

#: Lines of a text that share one list of those that go.
BLOCK = 512


def lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """`h` and `check` (hashes), `o` (place in order), `s` (words with single blanks) of the lines that
    have at least `least` words.  `o` is (no doc_id, doc_id, text's hash, line)."""
    # hashed before lines are: a text that is still asked for would be carried along with each of its lines
    whole = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.split("text", "\n").alias("parts"))
    rows = whole.select("doc_id", "th", F.posexplode("parts").alias("line", "said"))
    odd = F.contains("said", F.lit("  ")) | F.contains("said", F.lit("\t")) | F.contains("said", F.lit("\r"))
    one = F.trim(F.when(odd, F.regexp_replace("said", "[ \t\r]+", " ")).otherwise(F.col("said")))
    rows = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line").alias("o"), one.alias("s")).filter("s <> ''")
    rows = rows if least <= 1 else rows.filter(_size("s") >= least)
    return rows.select(F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("check"), "o", "s")


def _size(s: str) -> Column:
    """Number of words between single blanks."""
    return F.octet_length(s) - F.octet_length(F.replace(F.col(s), F.lit(" "), F.lit(""))) + 1


def _halves(m: str) -> list[Column]:
    """Keys of the words before and behind the middle, as a line of m words has it."""
    return [F.expr(f"xxhash64('a', {m}, substring_index(s, ' ', ({m}) div 2))"), F.expr(f"xxhash64('b', {m}, substring_index(s, ' ', ({m}) div 2 - ({m})))")]


def different(docs: DataFrame, least: int = 1, near: int = 5) -> DataFrame:
    """`h, o, check, n, s` of every different line: its earliest place, how often it occurs, and its
    words, if it may be near another one; a checkpoint."""
    first = lines(docs, least).groupBy("h").agg(F.min(F.struct("o", "check", "s")).alias("f"), F.count("*").alias("n"))
    # n is asked of this branch too, so that both have the same exchange and words are shuffled once
    long = first.filter("n > 0").select("h", F.col("f.s").alias("s")).withColumn("m", _size("s")).filter(F.col("m") >= near)
    # a line is met under its own middle and under that of a line with one word less
    keys = long.select("h", F.explode(F.array(*_halves("m"), *_halves("m - 1"))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    met = keys.join(shared, "key", "left_semi").select("h").distinct().withColumn("met", F.lit(True))
    return cut(first.join(met, "h", "left").select("h", "f.o", "f.check", "n", F.when(F.col("met"), F.col("f.s")).alias("s")))


def _variants(some: DataFrame, seed: int) -> DataFrame:
    """`h, i, key`: the line without its word i, or the line itself for i = 0.  A key is the exclusive
    or of hashes of words and their places, so that running ones give all variants of a line."""
    words = some.select("h", F.posexplode(F.split("s", " ")).alias("i", "w")).select("h", (F.col("i") + 1).alias("i"), F.xxhash64("w", "i", F.lit(seed)).alias("z"), F.xxhash64("w", F.col("i") - 1, F.lit(seed)).alias("y"))
    by = Window.partitionBy("h").orderBy("i")
    so_far, whole = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = words.select("h", "i", "z", F.bit_xor("z").over(so_far).alias("upto"), F.bit_xor("y").over(so_far).alias("moved"), F.bit_xor("y").over(whole).alias("all"), F.max("i").over(whole).alias("m"))
    part = F.struct("i", F.col("upto").bitwiseXOR(F.col("z")).bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("all")).alias("key"))
    itself = F.struct(F.lit(0).alias("i"), F.col("upto").alias("key"))
    return runs.select("h", F.explode(F.when(F.col("i") == F.col("m"), F.array(part, itself)).otherwise(F.array(part))).alias("v")).select("h", "v.i", "v.key")


def _candidates(some: DataFrame, seed: int) -> DataFrame:
    """`h, p`: the earliest line before it that shares a variant: its place, hash, and the places of
    the words that are left out of it and of the line itself."""
    every = _variants(some, seed)
    # most variants are of one line only and go before they carry anything
    common = every.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    variants = cut(every.join(common, "key", "left_semi").join(some.select("h", "o"), "h"))
    alike = variants.groupBy("key", "i").agg(F.min(F.struct("o", "h", "i")).alias("same"), F.count("*").alias("n"))
    by_key = alike.groupBy("key").agg(F.min(F.when(F.col("i") == 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.col("same"))).alias("part"))
    best = alike.join(by_key, "key").select("key", "i", "n", F.when(F.col("i") == 0, F.col("part")).otherwise(F.least("whole", "same")).alias("p")).filter("p is not null")
    best = cut(best.select(F.xxhash64("key", "i").alias("k"), F.col("key").alias("pk"), F.col("i").alias("pi"), "n", "p"))
    found = look_up(variants.withColumn("k", F.xxhash64("key", "i")), best, "k").filter("key = pk and i = pi and p.o < o")
    return found.groupBy("h").agg(F.min(F.struct("p.o", "p.h", F.col("p.i").alias("j"), "i")).alias("p"))


def near_lines(some: DataFrame) -> DataFrame:
    """`h, first` of the lines of `h, o, s` that have a near one before them: first is the earliest
    one's place.  some must be a checkpoint."""
    without = lambda a, i: f"if({i} = 0, {a}, concat(slice({a}, 1, greatest({i} - 1, 0)), slice({a}, {i} + 1, size({a}))))"
    out, ask, seed = None, None, 0
    while True:
        found = _candidates(some, seed)
        found = found if ask is None else found.join(ask, "h", "left_semi")
        mine = found.join(some.select("h", F.split("s", " ").alias("a")), "h")
        theirs = some.select(F.col("h").alias("ph"), F.split("s", " ").alias("b"))
        checked = cut(mine.join(theirs, F.col("p.h") == F.col("ph")).select("h", F.col("p.o").alias("first"), F.expr(f"{without('a', 'p.i')} = {without('b', 'p.j')}").alias("near")))
        good = checked.filter("near").select("h", "first")
        out = good if out is None else out.unionByName(good)
        ask = checked.filter("not near").select("h")
        if ask.isEmpty():
            return out
        seed += 1  # these keys were equal by chance; under others they aren't


def dropped(docs: DataFrame, least: int = 1, near: int = 5) -> DataFrame:
    """`doc_id, text_hash, line, reason, first_doc_id, first_line` of the lines to drop: line numbers
    from 0, reason 'near' or 'exact', and the earliest line that is the reason.

    Null texts have no lines.  Rows without a doc_id come last in order; repeated rows of one
    doc_id and text are one document.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    first = different(docs, least, near)
    close = near_lines(first.filter("s is not null").select("h", "o", "s"))
    known = first.join(close, "h", "left").filter("n > 1 or first is not null")
    known = cut(known.select("h", F.col("check").alias("check0"), F.col("o").alias("o0"), "first", "n"))
    met = look_up(lines(docs, least).select("h", "check", "o"), known, "h").filter("check = check0 and (first is not null or o > o0)")
    source = F.when(F.col("first").isNotNull(), F.least("first", "o0")).otherwise(F.col("o0"))
    out = met.select("o.doc_id", F.col("o.th").alias("text_hash"), "o.line", F.when(F.col("o") == F.col("o0"), "near").otherwise("exact").alias("reason"), source.alias("f"))
    return out.select("doc_id", "text_hash", "line", "reason", F.col("f.doc_id").alias("first_doc_id"), F.col("f.line").alias("first_line")).distinct()


def dedup(docs: DataFrame, least: int = 1, near: int = 5) -> DataFrame:
    """All rows and columns of docs with dropped lines taken out of `text`, and `n_chars`, if there
    is one, counted anew.  A text that loses no line is untouched; one that loses all is empty.
    Columns of any other name stay as they are.  The work for a text is in proportion to its lines."""
    k, lost = unused(docs, 2)
    gone = dropped(docs, least, near).groupBy("doc_id", "text_hash", F.floor(F.col("line") / BLOCK).alias("b")).agg(F.collect_set("line").alias("l"))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("b", "l")).alias("p"))
    # a list for each block of lines, so that a line is looked for among those of its block only
    blocks = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("p", lambda x: x["b"])).cast("int")), lambda b: F.flatten(F.transform(F.filter("p", lambda x: x["b"] == b), lambda x: x["l"])))
    gone = gone.select(F.xxhash64("doc_id", "text_hash").alias(k), blocks.alias(lost))
    rows = docs.withColumn(k, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(gone, k, "left")
    stays = lambda x, i: ~F.coalesce(F.array_contains(F.get(F.col(lost), F.floor(i / BLOCK).cast("int")), i), F.lit(False))
    left = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    out = rows.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
