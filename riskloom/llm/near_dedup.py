"""MinHash near-dedup with Order MinHash and banded alignment.

Every text is a sequence of words; its 5-word shingles are labelled with their
occurrence number in the text.  For each of ``bands`` permutations the two
smallest labelled shingles are taken and kept in text order; the pair's hash is
the band's value, so texts with the same shingles in another order differ.
Texts that agree in a band are candidates.  Exact copies are folded first (by
their text's digest), so a group of copies is one representative.

No bucket emits all its pairs.  Its members are compared with the bucket's
smallest member, and with the smallest of those that agree in the next band as
well.  Members that are linked by then, directly or by others, have one label;
in each bucket of several labels a growing number of hubs is then compared with
all members of other labels, linked or not, and leaves the bucket, until no
bucket has members of two labels, whatever the other buckets hold.  Pairs whose
lengths or words alone show that they are unlike end in the join; it is salted
by the bucket's size.  Keys are aggregated before the shuffle and joined back,
so adaptive execution can split a hot bucket.

A candidate pair is verified on its whole texts: the edit distance in words by
alignment within a band that widens up to the largest distance that still gives
``similarity`` (1 - distance / longer length).  A bag-of-words bound, which never
rejects a pair that would pass, comes first.  Classes are the connected
components of the verified links, named by their smallest ``doc_id``.

Defined results: null and empty texts (and those of white space only) are one
class of exact copies per text; texts under five words are one shingle, so they
link only if equal but for white space; very long texts are read whole;
repeated rows and rows that share a ``doc_id`` fall in one class; rows without a
``doc_id`` join the class of their text (null, if no row with that text has an
id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import fresh, frugal, materialise, text_blocks, text_bytes
from .components import components
from .shingles import U, batches, mix, words

BANDS, WORDS, SIMILARITY = 16, 5, 0.8
HUBS = 8
#: buckets of a bag of words, and how far each counts
BUCKETS, COUNTS = 1024, 2
BAG = [f"bag_{i}" for i in range(BUCKETS * COUNTS // 64)]
#: bits of a second, finer bag
PARITIES = 8192
PLACE = U((1 << 32) - 1)
LAST = U(0xFFFFFFFFFFFFFFFF)


def order_sketch(h: np.ndarray, doc: np.ndarray, at: np.ndarray, n_docs: int, bands: int) -> np.ndarray:
    """Band values (docs x bands) of shingle hashes; rows without shingles are 0."""
    out = np.zeros((n_docs, bands), np.int64)
    if not len(h):
        return out
    order = np.lexsort((h, doc))  # stable: equal shingles of a text stay in text order
    run = np.ones(len(h), bool)
    run[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    heads = np.flatnonzero(run)
    occurrence = np.empty(len(h), np.int64)
    occurrence[order] = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
    label = mix(h + occurrence.astype(U) * U(0x9E3779B97F4A7C15))
    present, starts, counts = np.unique(doc, return_index=True, return_counts=True)
    place = at.astype(U) & PLACE
    for band in range(bands):
        key = (label ^ mix(np.array([band + 1], U))) * U(0xD6E8FEB86659FD93)
        key = ((key ^ (key >> U(32))) * U(0xD6E8FEB86659FD93) & ~PLACE) | place
        one = np.minimum.reduceat(key, starts)
        key[key == np.repeat(one, counts)] = LAST
        two = np.minimum.reduceat(key, starts)
        p, q = (one & PLACE).astype(np.int64), (two & PLACE).astype(np.int64)
        q = np.where(two == LAST, p, q)
        first, second = label[starts + np.minimum(p, q)], label[starts + np.maximum(p, q)]
        out[present, band] = mix(first * U(3) + mix(second + U(band))).view(np.int64)
    return out


SKETCH = StructType([StructField("n_words", IntegerType()), StructField("bands", ArrayType(LongType()))])


def sketcher(bands: int, k: int):
    @arrow_udf(SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        counts, values = [np.zeros(0, np.int64)], [np.zeros((0, bands), np.int64)]
        for lo, hi, h, doc, at, n, _ in batches(texts, k):
            counts.append(n)
            values.append(order_sketch(h, doc, at, hi - lo, bands))
        v = np.concatenate(values)
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * bands), pa.array(v.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts).astype(np.int32)), arrays], fields=[pa.field("n_words", pa.int32()), pa.field("bands", arrays.type)])
    return run


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distance of each pair of word sequences if it is at most ``band``,
    else some number above; one row of all pairs' bands at a time."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    width, top = 2 * band + 1, int(n.max(initial=0))
    a = np.zeros((len(pairs), top), U)
    b = np.ones((len(pairs), top + width), U)  # word hashes are never 0 or 1 here
    for i, (x, y) in enumerate(pairs):
        a[i, :len(x)] = x
        y = y[:top + band + 1]
        b[i, band:band + len(y)] = y
    steps = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 29)
    row = np.where(steps < band, far, steps - band)[None, :].repeat(len(pairs), axis=0).astype(np.int32)
    out = np.full(len(pairs), far, np.int64)
    slot = m - n + band
    inside = (slot >= 0) & (slot < width)

    def note(i):
        done = np.flatnonzero((n == i) & inside)
        out[done] = row[done, slot[done]]

    note(0)
    ends = set(n.tolist())
    for i in range(1, top + 1):
        new = row + (b[:, i - 1:i - 1 + width] != a[:, i - 1:i])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        if i <= band:
            new[:, :band - i] = far
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        row = np.minimum(new, far).astype(np.int32)
        if i in ends:
            note(i)
    return out


def _ends(a: np.ndarray, b: np.ndarray):
    """The pair without its common head and tail."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b, n = a[head:], b[head:], n - head
    same = a[len(a) - n:][::-1] == b[len(b) - n:][::-1]
    tail = n if same.all() else int(np.argmin(same))
    return a[:len(a) - tail], b[:len(b) - tail]


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], least: float, cells: int = 1 << 16) -> np.ndarray:
    """``1 - distance / longer length`` of each pair of word sequences where that
    is at least ``least``, else 0."""
    out = np.zeros(len(pairs))
    longer = np.array([max(len(a), len(b), 1) for a, b in pairs])
    most = np.floor((1 - least) * longer + 1e-9).astype(np.int64)
    rest = {}
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[i]:
            continue
        a, b = _ends(a, b)
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            out[i] = 1 - len(b) / longer[i]
            continue
        # words of the longer one that the shorter one lacks must each be edited
        w, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        common = np.minimum(np.bincount(inverse[:len(a)], minlength=len(w)), np.bincount(inverse[len(a):], minlength=len(w))).sum()
        if len(b) - common <= most[i]:
            rest[i] = (a, b)
    band = 8
    while rest:
        todo = sorted(rest, key=lambda i: len(rest[i][0]))
        while todo:
            n = max(1, cells // (2 * band + 1))
            while n > 1 and n * (len(rest[todo[min(n, len(todo)) - 1]][0]) + 2 * band + 1) > 8 * cells:
                n = n * 3 // 4  # long texts in smaller lots, so the arrays stay small
            some, todo = todo[:n], todo[n:]
            found = banded_distances([rest[i] for i in some], band)
            for i, d in zip(some, found, strict=True):
                if d <= min(band, most[i]):
                    out[i] = 1 - d / longer[i]
                    del rest[i]
                elif band >= most[i]:
                    del rest[i]
        band *= 4
        if rest:
            band = min(band, int(max(most[i] for i in rest)))
    return out


def verifier(least: float):
    def run(batches):
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            sides = []
            for name in ("text_a", "text_b"):
                data, offsets = text_bytes(batch.column(name))
                _, _, doc, h = words(data, offsets)
                sides.append(np.split(h | U(2), np.cumsum(np.bincount(doc, minlength=batch.num_rows))[:-1]))
            s = similarities(list(zip(*sides, strict=True)), least)
            keep = np.flatnonzero(s >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(s[keep])], ["a", "b", "similarity"])
    return run


def candidate_texts(docs: DataFrame, pairs: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """``(id, text)`` of the documents in some pair, written once: only those
    texts are moved.  The ids (a narrow table of counted size) are broadcast if
    they are at most ``max_broadcast``, and else joined."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if pairs.count() <= max_broadcast // 2:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "id", "left_semi")
    return materialise(texts, "candidate-texts")


def verified(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are alike, with their similarity."""
    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(frugal(verifier(least)), "a long, b long, similarity double")


def bags(buckets: int = BUCKETS, counts: int = COUNTS, lot: int = 256):
    """For each text ``buckets * counts`` bits: whether at least 1, 2, ... of its
    words fall in each hash bucket.  A word that only one of two texts has flips a
    bit at most, so the differing bits never exceed those words."""
    @arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, buckets * counts // 64), U)]
        for low, high in text_blocks(texts):
            for lo in range(low, high, lot):
                hi = min(lo + lot, high)
                data, offsets = text_bytes(texts.slice(lo, hi - lo))
                _, _, doc, h = words(data, offsets)
                n = np.bincount(doc * buckets + (h >> U(8)).astype(np.int64) % buckets, minlength=(hi - lo) * buckets).reshape(hi - lo, 1, buckets)
                out.append(np.packbits(n > np.arange(counts)[None, :, None], axis=2, bitorder="little").reshape(hi - lo, -1).view(U))
        v = np.concatenate(out).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
    return run


def parities(bits: int = PARITIES, lot: int = 64):
    """For each text ``bits`` bits: the parity of its words that fall in each hash
    bucket, each with its occurrence number.  What two texts share cancels out, so
    the differing bits never exceed the words that only one of them has, and miss
    some only where two of those meet in a bucket."""
    @arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, bits // 64), U)]
        for low, high in text_blocks(texts):
            for lo in range(low, high, lot):
                hi = min(lo + lot, high)
                data, offsets = text_bytes(texts.slice(lo, hi - lo))
                _, _, doc, h = words(data, offsets)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                heads = np.flatnonzero(new)
                occurrence = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
                at = (mix(h + occurrence.astype(U) * U(0x9E3779B97F4A7C15)) >> U(8)).astype(np.int64) % bits
                n = np.bincount(doc * bits + at, minlength=(hi - lo) * bits).reshape(hi - lo, bits)
                out.append(np.packbits(n & 1 == 1, axis=1, bitorder="little").view(U))
        v = np.concatenate(out).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
    return run


def word_bags(texts: DataFrame) -> DataFrame:
    """``rep``, its bag of words and its parities, of ``(id, text)``."""
    bag = texts.select(F.col("id").alias("rep"), bags()("text").alias("bag"), parities()("text").alias("fine"))
    return bag.select("rep", *[F.col("bag")[i].alias(c) for i, c in enumerate(BAG)], "fine")


def open_buckets(members: DataFrame, hubs: int) -> DataFrame:
    """The members of buckets of two labels or more, with about ``hubs`` of each
    bucket marked as hubs.  Every pair of different labels has a member without
    the bucket's commonest label: only those are drawn, and the shortest text."""
    labels = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n_words", "rep")).alias("short"))
    buckets = labels.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"), F.min("short").alias("short")).where("labels > 1")
    other = F.col("n") - F.col("top.c")
    salts = F.ceil(F.col("n") * (F.least(other, F.lit(hubs)) + 1) / F.lit(1 << 24))
    buckets = buckets.select("key", salts.cast("int").alias("salts"), other.alias("other"), F.col("top.label").alias("top"), F.col("short.rep").alias("short"))
    drawn = (F.col("label") != F.col("top")) & (F.pmod(F.xxhash64("rep", F.lit(hubs)), F.col("other")) < hubs)
    return members.join(buckets, "key").withColumn("hub", drawn | (F.col("rep") == F.col("short"))).drop("other", "top", "short")


def hub_pairs(members: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of a hub and a member of its bucket with another label,
    but for those whose lengths or words alone show that they are unlike.  A
    bucket's members are dealt over its salts, its hubs go to each of them.  A pair
    that meets in several buckets is given by the smallest of them."""
    keys = members.groupBy("rep").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hub"), F.col("key"))).alias("hub_keys"))
    members = members.join(keys, "rep")
    dealt = members.select("key", "rep", "n_words", "label", "keys", "fine", *BAG, F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    hubs = members.where("hub").select("key", F.col("rep").alias("h_rep"), F.col("n_words").alias("h_words"), F.col("label").alias("h_label"), "hub_keys", F.col("fine").alias("h_fine"), *[F.col(c).alias(f"h_{c}") for c in BAG], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    shorter, longer = F.least("n_words", "h_words"), F.greatest("n_words", "h_words")
    # a distance of at most d leaves longer - d common words, so at most this many that one side lacks
    lacking = 2 * F.floor(F.lit(1 - least) * longer + F.lit(1e-9)) - (longer - shorter)
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h_{c}"))) for c in BAG), F.lit(0))
    alike = (F.col("label") != F.col("h_label")) & (shorter >= F.lit(least - 1e-9) * longer) & (differing <= lacking)
    once = F.array_min(F.array_intersect("keys", "hub_keys")) == dealt["key"]
    finely = F.aggregate(F.zip_with("fine", "h_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x) <= lacking
    met = dealt.join(hubs, (dealt["key"] == hubs["key"]) & (dealt["salt"] == hubs["salt"]) & alike & once & finely)
    return met.select(F.least("rep", "h_rep").alias("a"), F.greatest("rep", "h_rep").alias("b")).distinct()


def links_of(docs: DataFrame, reps: DataFrame, bands: int, least: float):
    """Verified links between representatives, written round by round."""
    entry = reps.where("n_words > 0").select("rep", "n_words", F.posexplode("bands").alias("band", "value"), "bands")
    narrow = F.xxhash64("band", "value")
    tight = F.xxhash64("band", "value", F.element_at("bands", (F.col("band") + 1) % bands + 1), F.lit(1))
    entry = entry.select("rep", "n_words", F.explode(F.array(F.struct(narrow.alias("key"), F.lit(True).alias("narrow")), F.struct(tight.alias("key"), F.lit(False).alias("narrow")))).alias("k")).select("rep", "n_words", "k.*")
    shared = entry.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = materialise(entry.join(shared, "key", "left_semi"), "bucket-members")
    # the first round: every member meets its buckets' smallest one
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "n_words")).alias("hub"))
    met = members.join(hubs, "key").where("rep <> hub.rep")
    met = materialise(met.select("key", "narrow", "rep", "n_words", F.col("hub.rep").alias("hub"), F.col("hub.n_words").alias("hub_words")), "bucket-rest")
    near = met.where(F.least("n_words", "hub_words") >= F.lit(least - 1e-9) * F.greatest("n_words", "hub_words"))
    pairs = tested = materialise(near.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    texts = candidate_texts(docs, met.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    links = found = materialise(verified(texts, pairs, least), "found")
    # A label names a text that the member is linked to, directly or by others, so
    # members of equal labels need no comparison.  A hub that has met all others
    # leaves its bucket; what is linked to it stays.
    classes = components(found)
    members = met.where("narrow").select("key", "rep", "n_words").join(classes.withColumnsRenamed({"id": "rep", "class_id": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    hubs, bag = HUBS, None
    while True:
        members = materialise(open_buckets(members, hubs), "bucket-members")
        if members.isEmpty():
            return links
        if bag is None:
            own = members.select(F.col("rep").alias("id")).distinct()
            bag = materialise(word_bags(texts.join(own, "id", "left_semi").dropDuplicates(["id"])), "word-bags")
        pairs = materialise(hub_pairs(members.join(bag, "rep"), least).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialise(verified(texts, pairs, least), "found")
        tested, links = tested.unionByName(pairs), links.unionByName(found)
        members = members.where("not hub").select("key", "rep", "n_words", "label")
        hubs *= 32
        if found.isEmpty():  # other buckets' links say nothing about the pairs still unmet
            continue
        label = classes.withColumnsRenamed({"id": "x", "class_id": "to"})
        edges = found.select("a", "b")
        for side in ("a", "b"):
            edges = edges.join(label, edges[side] == label["x"], "left").withColumn(side, F.coalesce("to", side)).drop("x", "to")
        joined = components(edges).withColumnsRenamed({"id": "label", "class_id": "to"})
        members = members.join(joined, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        # the class of every id that has a link so far
        ids = classes.select("id", F.col("class_id").alias("label")).unionByName(found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes, "id", "left_anti").select("id", F.col("id").alias("label")))
        classes = materialise(ids.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("class_id")), "classes")


def near_classes(docs: DataFrame, bands: int = BANDS, k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, rep_id`` (smallest id with this very
    text), ``class_id`` (smallest id of its class of near copies)."""
    text = F.coalesce("text", F.lit(""))
    base = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), sketcher(bands, k)(text).alias("s")).select("doc_id", "digest", "s.*"), "order-sketches")
    reps = materialise(base.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")), "representatives")
    links = links_of(docs, reps.where("rep is not null"), bands, similarity)
    # rows that share a doc_id are one document: each text's class meets in the id
    shared = base.where("doc_id is not null").join(reps.select("digest", "rep"), "digest").where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    own = reps.where("rep is not null").groupBy("rep").count().select("rep")
    twice = shared.join(own, shared.doc_id == own.rep, "left")
    ids = twice.where("a <> z or rep is not null").select("a", F.when(F.col("a") != F.col("z"), F.col("z")).otherwise(F.col("doc_id")).alias("b"))
    classes = components(links.select("a", "b").unionByName(ids))
    full = reps.select("digest", F.col("rep").alias("rep_id")).join(classes.withColumnRenamed("id", "rep_id"), "rep_id", "left")
    return base.select("doc_id", "digest").join(full, "digest").select("doc_id", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each class: that with the
    class's smallest ``doc_id`` (once, if it is repeated).  Rows without an id
    stay if no row with an id has their text, once per text."""
    at, n = fresh(docs.columns, "class_of"), fresh(docs.columns, "copies")
    classes = near_classes(docs.select("doc_id", "text"), **options)
    kept = classes.where("doc_id = class_id").groupBy("class_id").agg(F.count(F.lit(1)).alias(n)).withColumnRenamed("class_id", at)
    rows = docs.join(kept, docs["doc_id"] == kept[at])
    own = [docs[c] for c in docs.columns]
    out = rows.where(F.col(n) == 1).select(*own).unionByName(rows.where(F.col(n) > 1).select(*own).dropDuplicates(["doc_id"]))
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    digest = F.md5(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id is not null").select(digest.alias(at)).distinct()
    return out.unionByName(nameless.join(named, digest == named[at], "left_anti").dropDuplicates(["text"]))
