"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a chain of two content words that follow a common word (the anchor), common words between them skipped. The set
of hashed signatures of a text is its fingerprint, the share of common signatures (Jaccard) the likeness of two.

The join of near duplicates orders signatures by rarity and partitions sets by length. Sets whose sizes alone keep
Jaccard below the threshold never meet, and two sets meet only if they share a signature among the rarest few of each, as many as the threshold leaves open.

Defined results: null counts as empty; texts without words have the empty set; two empty sets are alike (1), an empty and
another are not (0); a text whose words hold no anchor still has the chain at its beginning; equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcf.llm.common import SPACE_PATTERN, ascii_lower, stored

# Common function words that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur ne nous ou par pas plus pour qui que sa se ses son sur un une vous "
    "aber als auch auf aus bei das dem den der die ein eine einem einen einer er es für im ist mit nach nicht noch sich sie sind so und "
    "von vor war wie wird zu zum zur al como con cuando del el ella ellos entre eran esta este fue hay las lo los más me mi muy no nos para "
    "pero por porque si sin sobre su sus también tiene todo una uno y ya"
).split()
PUNCTUATION = r"[.,;:!?\"'()|]"
_MARK = "\u0001"


def _content(text: Column) -> Column:
    """The content words; one that follows an anchor or the text's beginning has a mark in front."""
    bare = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    marked = F.array_join(F.transform(F.split(bare, SPACE_PATTERN), lambda w: F.when(w.isin(*ANCHORS), _MARK).otherwise(w)), " ")
    stuck = F.concat(F.lit(_MARK), F.replace(F.ltrim(marked), F.lit(_MARK + " "), F.lit(_MARK)))
    return F.filter(F.split(stuck, " "), lambda w: ~w.isin("", _MARK))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted distinct signature hashes (array<long>) of a text column."""
    words = f"{name}_words"
    following = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    bare = lambda w: F.ltrim(w, F.lit(_MARK))
    chains = F.zip_with(words, following, lambda w, x: F.when(w.startswith(_MARK), F.xxhash64(bare(w), F.coalesce(bare(x), F.lit("")))))
    sigs = F.sort_array(F.array_distinct(F.filter(chains, lambda c: c.isNotNull())))
    return df.withColumn(words, _content(F.col(text))).withColumn(name, sigs).drop(words)


def fingerprint(sigs: Column) -> Column:
    """A short name of a signature set: its size and a digest."""
    return F.concat(F.size(sigs).cast("string"), F.lit("-"), F.substring(F.sha2(F.array_join(F.transform(sigs, lambda s: F.hex(s)), ""), 256), 1, 32))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 where their sizes alone keep it below ``at_least``."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(high == 0, 1.0).when(low < at_least * high, 0.0).otherwise(both / (low + high - both))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Class representatives and their similar pairs.

    Returns (members, pairs): members (doc_id, class_id) puts rows with equal signature sets into a class, named by the smallest doc_id;
    pairs (a, b, likeness) has all pairs of different classes at ``threshold`` or more, so copies are never expanded into pairs.
    """
    own = with_signatures(docs.select("doc_id", "text"), "text", "sigs").select("doc_id", "sigs")
    named = stored(own.withColumn("set", F.sha2(F.array_join(F.transform("sigs", lambda s: F.hex(s)), ""), 256)), "signatures")
    classes = stored(named.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "signature-sets")
    members = named.join(classes.select("set", "class_id"), "set").select("doc_id", "class_id")

    # lengths fall into ranges that grow by 1 / threshold: a similar set is in the same range or the next
    of_length = F.floor(F.log(F.size("sigs").cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")
    sets = classes.where(F.size("sigs") > 0).withColumn("range", of_length)
    single = sets.select("set", "range", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    frequency = single.groupBy("sig").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("set").orderBy("f", "sig"))
    prefix = stored(single.join(frequency, "sig").where("f > 1").withColumn("common", F.count("*").over(Window.partitionBy("set"))).withColumn(
        # signatures no other set has come first in the order, so they use up the prefix
        "rank", rank + F.col("n") - F.col("common")).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1), "prefixes")
    right = prefix.select("sig", F.explode(F.array(F.col("range"), F.col("range") - 1)).alias("range"), F.col("set").alias("other"), F.col("n").alias("m"))
    meet = prefix.join(right, ["sig", "range"]).where("set != other").where(
        (F.least("n", "m") >= threshold * F.greatest("n", "m"))).select(F.least("set", "other").alias("x"), F.greatest("set", "other").alias("y")).distinct()
    left, there = classes.select(F.col("set").alias("x"), F.col("class_id").alias("i"), F.col("sigs").alias("p")), classes.select(
        F.col("set").alias("y"), F.col("class_id").alias("j"), F.col("sigs").alias("q"))
    compared = meet.join(left, "x").join(there, "y").withColumn("likeness", likeness(F.col("p"), F.col("q"), threshold)).where(F.col("likeness") >= threshold)
    return members, compared.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "likeness")


#: Rows of one bucket of the id order; a bucket is what one window sees.
BUCKET_ROWS = 1000
#: Buckets at most, which bounds plan, driver and broadcast; larger tables have longer buckets, which a window can spill.
MAX_BUCKETS = 8192


def _cuts_below(doc_id: Column, cuts: list[int]) -> Column:
    """The number of ascending cuts at or below an id (0 for null), by bisection in a loop: the cuts stand once in the plan, as one literal."""
    if not cuts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda below, step: below + F.when(
        F.coalesce(F.get(bounds, below + step - 1) <= doc_id, F.lit(False)), step).otherwise(0))


def edit_experiment(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to both the edited and the next text.

    The edited text is the text with its last half replaced by the beginning of the next document's, in the order of doc_id (nulls first, rows of one id
    by text), the last followed by the first. The order is cut into ranges at quantiles of the ids; the first row of a range also goes to the
    range before it, so neighbours meet without a global sort and texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    n = min(MAX_BUCKETS, max(1, math.ceil(total / BUCKET_ROWS)))
    cuts = [] if n == 1 else sorted({int(c) for c in rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))})
    placed = rows.withColumn("bucket", _cuts_below(F.col("doc_id"), cuts))
    least = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("first"))  # a row per range
    order = stored(least, "ranges").orderBy("bucket").collect()  # as many rows as ranges
    if not order:
        return _compared(placed.withColumns({"next": F.lit(""), "next_sigs": F.array().cast("array<long>"), "sigs": F.array().cast("array<long>")}))
    before = {r["bucket"]: order[k - 1]["bucket"] for k, r in enumerate(order)}
    firsts = docs.sparkSession.createDataFrame(
        [(r["bucket"], before[r["bucket"]], r["first"]["doc_id"], r["first"]["h"], k == 0) for k, r in enumerate(order)],
        "bucket int, before int, first_id long, first_hash long, turn boolean")
    met = placed.join(F.broadcast(firsts), "bucket")  # a row per range, MAX_BUCKETS at most
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash"))
    homes = F.when(is_first, F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")),
        F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest")))).otherwise(
            F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))))
    sent = met.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", "home.bucket", "home.guest").repartition("bucket")
    line = Window.partitionBy("bucket").orderBy("guest", "doc_id", F.xxhash64("text"))
    with_sigs = with_signatures(sent, "text", "sigs")
    ahead = with_sigs.withColumns({"next": F.lead("text").over(line), "next_sigs": F.lead("sigs").over(line)}).where("guest = 0")
    return _compared(ahead)


def _compared(ahead: DataFrame) -> DataFrame:
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next", F.lit(1), half))
    done = with_signatures(ahead.withColumns({"n_chars": n_chars.cast("long"), "edited": edited}), "edited", "edited_sigs")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
