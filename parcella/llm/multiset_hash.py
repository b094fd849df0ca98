"""Fingerprints of texts as sums of wide vectors hashed from their paragraphs.

A paragraph's vector has one lane of 0 or 1 for each of the first ``LANES`` bits of its
SHA-256; a text's fingerprint is the sum over its paragraphs, modulo a power of two, with their
number in front. So the order of paragraphs does not matter, and inserting or deleting
some is adding or subtracting their fingerprint (:func:`insert`, :func:`delete`).
Twice a lane less the number of paragraphs is a sum of random signs, so the inner product
of two such vectors estimates how many paragraphs the texts share, each counted as often as it
stands: the cosine is their :func:`likeness`, with a standard error of about 1 / sqrt(LANES).

Paragraphs end at line ends and, so that a text of one line has several, behind sentences;
empty ones do not count. Everything here is built from SQL functions.

Defined cases: a null text is the empty one; it has no paragraphs, and two texts
without any are alike (1). In :func:`with_next` null ids come last and count as one
id, and rows of one id are one place in the order; as next text serves the one of its
rows with the smallest needed beginning, then the smallest fingerprint. All rows of an id
and all further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella.llm.common import Scratch, fresh_name

#: Bits of the hash in use: 4 numbers of 60 bits, read as 15 hexadecimal digits each.
NUMBERS, DIGITS = 4, 15
LANES = NUMBERS * DIGITS * 4
#: Two lanes are summed in one number, half the bits apart.
_HALF = DIGITS * 2
_PAIR = (1 << _HALF) + 1
MODULUS = 1 << 32
#: What ends a sentence.
SENTENCE_END = "([.!?]) "


def paragraphs(text: Column) -> Column:
    """The non-empty paragraphs of a text."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1\n")
    return F.filter(F.split(lines, "\n"), lambda p: p != "")


def _numbers(digests: Column, k: int) -> Column:
    part = lambda d: F.conv(F.substring(d, DIGITS * k + 1, DIGITS), 16, 10).cast("bigint")
    return F.transform(digests, part)


def _summed(numbers: Column) -> Column:
    """Sums of all bits of the numbers, two in each: bit k low and bit k + half high."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(_HALF - 1)),
        lambda k: F.aggregate(
            numbers,
            F.lit(0).cast("bigint"),
            lambda total, x: total + F.call_function("shiftright", x, k).bitwiseAND(F.lit(_PAIR).cast("bigint")),
        ),
    )


def _lanes(digests: Column) -> Column:
    """The fingerprint of the paragraphs with these digests.

    What an inner function uses often is bound as an outer one's variable; a column of
    an earlier projection could be put in its place and evaluated again each time.
    """
    low = lambda x: x.bitwiseAND(F.lit((1 << _HALF) - 1).cast("bigint"))
    high = lambda x: F.shiftright(x, _HALF)
    numbers = lambda d: F.array(*[_numbers(d, k) for k in range(NUMBERS)])
    packed = lambda d: F.flatten(F.transform(numbers(d), _summed))
    unpacked = lambda d: F.transform(
        F.array(packed(d)), lambda x: F.concat(F.array(F.size(d).cast("bigint")), F.transform(x, low), F.transform(x, high))
    )
    return F.transform(F.array(digests), lambda d: unpacked(d)[0])[0]


def with_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All columns and fingerprints (arrays of bigint), given as text column -> output."""
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {o.lower() for o in columns.values()}]
    digests = lambda name: F.transform(paragraphs(F.col(f"`{name}`")), lambda p: F.sha2(p, 256))
    return df.select(*own, *[_lanes(digests(source)).alias(output) for source, output in columns.items()])


def insert(fingerprint: Column, other: Column) -> Column:
    """The fingerprint after the paragraphs of ``other`` have come in."""
    return F.zip_with(fingerprint, other, lambda a, b: F.pmod(a + b, F.lit(MODULUS)))


def delete(fingerprint: Column, other: Column) -> Column:
    """The fingerprint after the paragraphs of ``other`` have gone."""
    return F.zip_with(fingerprint, other, lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for the number of paragraphs and each lane."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two fingerprints; equal ones give 1 and opposed ones 0."""
    signs = lambda f: F.transform(F.array(f), lambda f: F.transform(F.slice(f, 2, LANES), lambda x: (2 * x - f[0]).cast("double")))[0]

    def cosine(x: Column, y: Column) -> Column:
        norms = F.sqrt(_product(x, x)) * F.sqrt(_product(y, y))
        return F.when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _product(x, y) / norms))).otherwise(0.0)

    # Bound once, as above.
    found = F.transform(F.array(F.struct(signs(a).alias("x"), signs(b).alias("y"))), lambda s: cosine(s["x"], s["y"]))[0]
    return F.when(a == b, 1.0).otherwise(found)


def next_ids(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, next_id, needed): the distinct ids in descending order, the last one followed by the first.

    ``needed`` is half the length of the id's longest text. The ids, without texts, are dealt
    to ranges; within a range a window finds the next one, and the ends
    of ranges look at a table of one row per range.
    """
    sizes = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    ids = sizes.groupBy("id").agg(F.expr("max(n) div 2").cast("int").alias("needed"))
    ranged = ids.repartitionByRange(F.desc_nulls_last("id")).withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, "ids")
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last("id"))
    parts = Window.orderBy("part")
    firsts = ranged.groupBy("part").agg(F.struct(F.max("id").alias("id")).alias("head"))
    firsts = firsts.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts)).alias("behind"))
    found = ranged.withColumn("after", F.lead(F.struct("id")).over(inside)).join(firsts, "part")
    return found.select("id", F.coalesce("after", "behind")["id"].alias("next_id"), "needed")


def with_next(documents: DataFrame, beginning: str = "next_text", fingerprint: str = "next_fingerprint") -> DataFrame:
    """All columns, what an edit may need of the next document's text, and that document's fingerprint.

    Texts are shuffled once, by id, for both joins; across goes only the beginning
    that is needed, half as long as the text it will follow.
    """
    order = next_ids(documents, Scratch(documents.sparkSession, "multiset"))
    order = order.select(F.struct("next_id").alias("_key"), F.struct("id").alias("_for"), "needed").hint("merge")
    # A struct equals another one where both hold null, so null ids join like others.
    others = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("doc_id", "text")]
    keyed = documents.select("text", F.struct("doc_id").alias("_key"), *others)
    given = with_fingerprints(keyed.select("text", "_key").join(order, "_key"), {"text": "_hash"})
    given = given.select(F.col("_for").alias("_key"), F.expr("left(coalesce(text, ''), needed)").alias("_start"), "_hash")
    # Rows of one id become one before the shuffle, however many there are.
    given = given.groupBy("_key").agg(F.min(F.struct("_start", "_hash")).alias("_next")).hint("merge")
    made = {beginning: "_next._start", fingerprint: "_next._hash"}
    own = [c for c in documents.columns if c.lower() not in {m.lower() for m in made}]
    own = [F.col("_key.doc_id").alias(c) if c.lower() == "doc_id" else F.col(f"`{c}`") for c in own]
    return keyed.join(given, "_key").select(*own, *[F.col(source).alias(name) for name, source in made.items()])


def with_edit(documents: DataFrame, output: str = "edited", start: str = "next_text") -> DataFrame:
    """All columns and the text whose last half is replaced by the beginning of the next document."""
    text, half = F.coalesce("text", F.lit("")), fresh_name(documents.columns, "half")
    cut = documents.withColumn(half, F.expr("length(coalesce(text, '')) div 2").cast("int"))
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - F.col(half)), F.substring(F.col(start), F.lit(1), F.col(half)))
    return cut.withColumn(output, edited).drop(half)
