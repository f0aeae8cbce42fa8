"""Merkle fingerprints of documents: pieces, paragraphs, sections, root.

A text is cut without loss: into sections (behind an empty line), these into paragraphs (behind a line
end), these into pieces (behind a stop and white space,
in short paragraphs behind every word).  A piece is hashed, a paragraph hashes its
pieces, a section its paragraphs, the root its sections.  The fingerprint writes the tree: equal roots
mean equal texts, and the first differing section, paragraph and piece locate an edit.  Likeness is
the Jaccard index of two trees' pieces.

``root/section:paragraph=piece.piece,paragraph=piece;section:...`` (hexadecimal; the root in full,
inner nodes as 16 digits, pieces as up to 8).  Everything is DataFrame functions.

The next document by id is found without ordering the table in one task: documents are dealt to ranges
of ids, every range gets a copy of the first document of the following range, and ``lead`` looks
inside the range.

Defined results: null texts are empty; an empty text has the tree of one empty piece, and two empty
texts are alike to 1; equal ids are ordered by a hash of the text; a null id comes first; a single
document is its own next; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.stage import Stage

SECTION, PARAGRAPH, PIECE = r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?;:,|]\s)"
#: Paragraphs below so many characters are cut behind every word.
WORD, SHORT = r"(?<=\s)", 80
#: Documents in a range of ids, on average.
RANGE_DOCS = 256


def tree(text: Column) -> Column:
    """Hashes of the pieces, nested by section and paragraph."""
    def paragraph(p):
        cut = F.when(F.length(p) < SHORT, F.split(p, WORD)).otherwise(F.split(p, PIECE))
        return F.transform(cut, lambda x: F.xxhash64(x))

    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), paragraph))


def _short(x: Column) -> Column:
    return F.lower(F.hex(F.shiftrightunsigned(x, 32)))


def fingerprint(nodes: Column) -> Column:
    """The tree as a string."""
    def paragraph(p):
        return F.concat(F.lower(F.hex(F.xxhash64(p))), F.lit("="), F.array_join(F.transform(p, _short), "."))

    def section(s):
        return F.concat(F.lower(F.hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p))))), F.lit(":"),
                        F.array_join(F.transform(s, paragraph), ","))

    heads = F.transform(nodes, lambda s: F.hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))))
    return F.concat(F.sha2(F.array_join(heads, "/"), 256), F.lit("/"),
                    F.array_join(F.transform(nodes, section), ";"))


def pieces(nodes: Column) -> Column:
    """Distinct pieces as the fingerprint shows them (32 bits each)."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(nodes)), lambda x: F.shiftright(x, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id and more) with the ``columns`` of the next document as ``next_<column>``."""
    spark = docs.sparkSession
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    # in doubles, as the distance of two ids can exceed a long; rounding keeps their order, which is enough
    width = max(1.0, (high - low + 1) * RANGE_DOCS / n) if n else 1.0
    least = float(low) if n else 0.0
    part = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(least)) / F.lit(width)), F.lit(-1)).cast("long")
    # one row a range: its first id, and the range before it (the last one for the first)
    heads = docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("head"))
    span = 4096
    coarse = F.floor(F.col("part") / span)
    firsts = heads.groupBy(coarse.alias("coarse")).agg(F.max("part").alias("last"))
    order = Window.orderBy("coarse")
    firsts = firsts.select("coarse", F.coalesce(
        F.lag("last").over(order), F.max("last").over(Window.partitionBy())).alias("last"))
    before = heads.withColumn("coarse", coarse).join(firsts, "coarse").withColumn(
        "to", F.coalesce(F.lag("part").over(Window.partitionBy("coarse").orderBy("part")), F.col("last")))
    stage = Stage(spark, "merkle")
    before, _ = stage.save(before.select("head", "to", F.lit(True).alias("extra")))
    extra = docs.join(before, docs["doc_id"].eqNullSafe(before["head"])).drop("head").withColumnRenamed("to", "part")
    both = docs.withColumn("part", part).withColumn("extra", F.lit(False)).unionByName(extra)
    # a lone document's copy of itself comes behind it, so copies are last
    order = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "order")
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(
        ~F.col("extra")).drop("part", "extra")


def merkle_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "order", F.xxhash64("text")).withColumn("nodes", tree(F.col("text"))).select(
        "doc_id", "text", "order", fingerprint(F.col("nodes")).alias("fingerprint"),
        pieces(F.col("nodes")).alias("pieces"))
    rows = with_next(rows, ["text", "pieces"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_nodes", tree(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited_nodes")).alias("edited_fingerprint"),
        likeness(F.col("pieces"), pieces(F.col("edited_nodes"))).alias("near_edited"),
        likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"))
