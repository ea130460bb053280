"""Repeated passages: content-defined chunks of whole lines and sentences, in DataFrame functions only.

Pieces. A text is cut behind line breaks and behind sentences, wherever a line is wrapped; blank lines belong to the piece before
them. Pieces keep their separators and together are the text, but are hashed and compared without blanks and line breaks at their ends.
Chunks. The rolling hash has a window of one piece, so whether a piece is a boundary depends on itself alone: pieces of BOUND_CHARS
characters are, of shorter ones those with two more bits zero (one in four). The lowest bit puts a boundary in one of two classes, and each class cuts the text by
itself: a chunk runs from one boundary to the next of its class, both included. Among three boundaries two are in one class, so every run that
two texts share and that has three holds a whole chunk, whatever surrounds it; of a longer run hardly more than a piece at either end can lie
outside of all chunks. A piece of LONG_CHARS characters is a chunk of its own as well.
Removal. A chunk that occurs more than once, byte for byte, loses all occurrences but the first (least doc_id, then place). An occurrence that
overlaps the first one in the same text stays. Chunks that overlap or touch go as one stretch, if it has MIN_CHARS characters.

Hashes are counted by partial sums; those of more than one 4,096th of all chunks (so fewer than 4,096) meet their places by broadcast,
the others in a join. Texts move once; bytes are compared by the least and the greatest text of each repeated hash.

Defined results: null stays null and empty stays empty; rows with equal doc_id and text are one document and change alike;
a null doc_id counts before all others; blank lines have no content of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import stored

#: Characters of a stretch that may go: shorter agreement (a few sentences of a word or two) is chance or style.
MIN_CHARS = 64
#: Characters from which a piece is always a boundary.
BOUND_CHARS = 16
#: Characters from which a single line or sentence is a chunk of its own (some 25 words).
LONG_CHARS = 150
#: A hash with more than this part of all chunks meets its places by broadcast.
HOT_PARTS = 4096

# the first look-behind is implied by the second; it turns most places down at once
_PIECES = r"(?<=[\n ])(?<=\n|[.!?] )(?=[ \t\r]*\S)"
_BLANKS = " \t\r\n"
_KEYS = ["__llm_id", "__llm_text"]
_LEAST_ID = -(2**63)


def _bare(piece: Column) -> Column:
    """A piece without the separators around it."""
    return F.trim(piece, F.lit(_BLANKS))


def _pieces(text: Column) -> Column:
    return F.split(text, _PIECES)


def _hash(bare: Column) -> Column:
    return F.xxhash64(bare)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their key, the id and a hash of the text, which is never null."""
    return docs.withColumns({_KEYS[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)), _KEYS[1]: F.xxhash64("text")})


def _of_class(at: Column) -> Column:
    """Pairs of neighbours among the places of one class."""
    return F.filter(F.transform(at, lambda b, k: F.struct(F.get(at, k - 1).alias("a"), b.alias("b"))), lambda s: s["a"].isNotNull())


def chunk_places(docs: DataFrame) -> DataFrame:
    """Per chunk: key columns, start, size (pieces), hash."""
    pieces = F.transform(F.transform(_pieces(F.col("text")), _bare), lambda p: F.struct(_hash(p).alias("h"), F.length(p).alias("n")))
    cut = _keyed(docs).where(F.length("text") >= MIN_CHARS).select(*_KEYS, pieces.alias("p"))
    bound = lambda p: (p["n"] >= BOUND_CHARS) | (F.shiftright(p["h"], 1).bitwiseAND(F.lit(3)) == 0)
    # places of boundaries: 0, 1, 2, … of the one class, -1, -2, -3, … of the other
    at = F.transform("p", lambda p, i: F.when(bound(p), F.when(p["h"].bitwiseAND(F.lit(1)) == 0, i).otherwise(-1 - i)))
    long = F.filter(F.transform("p", lambda p, i: F.when(p["n"] >= LONG_CHARS, i)), lambda i: i.isNotNull())
    marked = cut.select(*_KEYS, F.transform("p", lambda p: p["h"]).alias("h"), at.alias("at"), long.alias("long"))
    classed = marked.select(*_KEYS, "h", "long", F.filter("at", lambda i: i >= 0).alias("even"),
                            F.transform(F.filter("at", lambda i: i < 0), lambda i: -1 - i).alias("odd"))
    single = F.transform("long", lambda i: F.struct(i.alias("a"), i.alias("b")))
    spans = classed.select(*_KEYS, "h", F.concat(_of_class(F.col("even")), _of_class(F.col("odd")), single).alias("s"))
    # hashed within the row, so that no row is copied with all its pieces
    chunks = F.transform("s", lambda s: F.struct(s["a"].alias("start"), (s["b"] - s["a"] + 1).alias("size"), F.xxhash64(
        F.slice("h", s["a"] + 1, s["b"] - s["a"] + 1)).alias("hash")))
    return spans.select(*_KEYS, F.explode(chunks).alias("c")).select(*_KEYS, "c.start", "c.size", "c.hash")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Per document that has any: key columns and ``__llm_found``, its repeated chunks as (start, size, hash, first), first telling the
    kept occurrence and those that overlap it. Stored."""
    places = stored(chunk_places(docs), "chunks")
    counted = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(*_KEYS, "start")).alias("least")).where("n > 1")
    shared = stored(counted, "repeated")
    often = F.col("n") > places.count() / HOT_PARTS
    hot, rest = F.broadcast(shared.where(often)), shared.where(~often)  # fewer than HOT_PARTS rows
    again = places.join(hot, "hash").unionByName(places.join(hot, "hash", "left_anti").join(rest, "hash"))
    here = F.struct(*_KEYS) == F.struct(*[F.col("least")[k].alias(k) for k in _KEYS])
    entry = F.struct("start", "size", "hash", (here & (F.col("start") < F.col("least.start") + F.col("size"))).alias("first"))
    # of one document, as long as its text
    return stored(again.groupBy(*_KEYS).agg(F.sort_array(F.collect_set(entry)).alias("__llm_found")), "found")


def _unlike(cut: DataFrame) -> DataFrame:
    """Per document that has any: the hashes in it that stand for different bytes somewhere. There is hardly ever one."""
    same_bytes = F.transform("__llm_found", lambda c: F.struct(c["hash"].alias("hash"), F.array_join(
        F.transform(F.slice("__llm_pieces", c["start"] + 1, c["size"]), _bare), "\n").alias("t")))
    seen = cut.select(F.explode(same_bytes).alias("c")).select("c.*")
    return seen.groupBy("hash").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("hash")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Documents without repeated chunks; ``text`` changes and, where there is one, ``n_chars``; all rows stay."""
    found = repeated_chunks(docs)
    # one row per document; the one exchange of the texts serves the comparison and the removal, and nothing is sorted before it
    texts = _keyed(docs).select(*_KEYS, "text").repartition(*_KEYS).dropDuplicates(_KEYS)
    cut = texts.join(found, _KEYS, "left").withColumn("__llm_pieces", F.when(F.col("__llm_found").isNotNull(), _pieces(F.col("text"))))
    listed = found.select(*_KEYS, F.explode("__llm_found.hash").alias("hash"))
    spoiled = listed.join(_unlike(cut), "hash").groupBy(*_KEYS).agg(F.collect_set("hash").alias("__llm_unlike"))

    goes = lambda c: ~c["first"] & ~F.coalesce(F.array_contains("__llm_unlike", c["hash"]), F.lit(False))
    gone = F.flatten(F.transform(F.filter("__llm_found", goes), lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1)))
    marked = cut.join(spoiled, _KEYS, "left").withColumn("__llm_gone", F.array_sort(F.array_distinct(gone)))
    # stretches of pieces that go: their first and their last pieces, one to one
    opens = F.filter("__llm_gone", lambda i, k: ~F.get("__llm_gone", k - 1).eqNullSafe(i - 1))
    closes = F.filter("__llm_gone", lambda i, k: ~F.get("__llm_gone", k + 1).eqNullSafe(i + 1))
    stretches = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    enough = F.filter(stretches, lambda s: F.length(_bare(F.array_join(
        F.slice("__llm_pieces", s["start"] + 1, s["end"] - s["start"]), ""))) >= MIN_CHARS)
    ranges = marked.withColumn("__llm_out", enough)
    # what lies between them
    kept = F.concat(
        F.array(F.slice("__llm_pieces", F.lit(1), F.get("__llm_out", F.lit(0))["start"])),
        F.transform("__llm_out", lambda s, k: F.slice(
            "__llm_pieces", s["end"] + 1, F.coalesce(F.get("__llm_out", k + 1)["start"], F.size("__llm_pieces")) - s["end"])))
    new = F.when(F.size("__llm_out") > 0, F.array_join(F.flatten(kept), "")).otherwise(F.col("text"))
    after = ranges.select(*_KEYS, F.col("text").alias("__llm_old"), new.alias("__llm_new"))
    rest = _keyed(docs).drop("text")
    return rest.join(after, _KEYS).select(*[_changed(c) for c in docs.columns])


def _changed(name: str) -> Column:
    old, new = F.col("__llm_old"), F.col("__llm_new")
    if name == "text":
        return new.alias("text")
    if name == "n_chars":
        return F.when(old.eqNullSafe(new), F.col("n_chars")).otherwise(F.length(new).cast("long")).alias("n_chars")
    return F.col(f"`{name}`")
