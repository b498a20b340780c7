"""MinHash near-dedup with BagMinHash signatures of multisets of five-word shingles.

A shingle that occurs w times owns the weights from 0 to w.  The weight axis is cut at 0, 1, 2, 4,
8, ...; each interval has its own Poisson process with a rate of its length, and where w ends
inside an interval the points above w are thinned out.  Points come in order of time, and those
later than all that the signature still needs are never drawn.  A signature holds the first point
of each of ``SLOTS`` components, so two multisets agree in a component with the probability of
their weighted Jaccard similarity.

Equal texts are one text at first, known by a 64-bit hash, its key.  Others meet in buckets of equal
bands.  Each is compared, by its shingles, with the least key of each of its buckets and with a key
drawn for each.
All texts of a bucket, of whatever size, that are then still in different components meet in a
second turn: a bucket is dealt into parts, and every two parts meet in a cell of their own, so a
text is sent once for each part and no task holds more than two parts.  Two texts of several
common buckets are compared in the first of them alone.  So no link inside a bucket is lost; the
comparisons of texts that stay unconnected are as many as their pairs.  Texts, buckets and centres
that hold over a thousandth of the rows are joined where they are, not by a shuffle on their key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_WORDS, checkpoint, column, forget, fresh, hot_keys, hot_of, join_hot, map_texts, mix, one_text_each, shingles, star_groups, words_of
from .components import components

#: Words of a shingle, least similarity, bands, and components in a band: 0.8 misses all bands once in 100,000 times.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 3
SLOTS = BANDS * ROWS
_UNIT = 2.0**-53


def multiset(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, in order, and how often each occurs."""
    return np.unique(shingles(words, SHINGLE), return_counts=True)


def bag_minhash(doc: np.ndarray, item: np.ndarray, count: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """A row of first points for each document, from (document, item, count) with distinct items a document."""
    first = np.full(n_docs * slots, np.inf)
    need = np.full(n_docs, np.inf)
    level = np.ceil(np.log2(count)).astype(np.int64)  # intervals above [0, 1): 0 for a count of 1
    which = np.repeat(np.arange(len(item)), level + 1)
    k = np.arange(len(which)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    width = np.where(k > 0, low, 1.0)
    part = np.minimum(1.0, (count[which] - low) / width)  # of the interval that the count reaches
    doc, state, time = doc[which], mix(item[which] ^ mix(k.astype(np.uint64) + np.uint64(7))), np.zeros(len(which))
    while len(doc):
        state = mix(state)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT) / width
        live = np.flatnonzero(time < need[doc])
        doc, state, time, width, part = doc[live], state[live], time[live], width[live], part[live]
        more = mix(state ^ np.uint64(0x5851F42D4C957F2D))
        slot = ((more >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        inside = np.flatnonzero((more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < part)
        np.minimum.at(first, doc[inside] * slots + slot[inside], time[inside])
        need = first.reshape(n_docs, slots).max(axis=1)
    return first.reshape(n_docs, slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][ia], b[1][ib]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(df: DataFrame) -> DataFrame:
    """(id, key, n_words, bands) of (id, key, text); a text without words has no bands."""

    def make(batch, texts):
        words = words_of(texts)
        docs, items, counts, some = [], [], [], []
        for d in range(len(texts)):
            w = words.hash[words.begin[d] : words.begin[d + 1]]
            if len(w):
                item, count = multiset(w)
                docs.append(np.full(len(item), len(some)))
                items.append(item)
                counts.append(count)
                some.append(d)
        n, size = len(some), np.diff(words.begin)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        first = bag_minhash(join(docs, np.int64), join(items, np.uint64), join(counts, np.int64), n).view(np.uint64).reshape(n, BANDS, ROWS)
        band = mix(first[:, :, 0] + np.arange(BANDS, dtype=np.uint64))
        for r in range(1, ROWS):
            band = mix(band ^ first[:, :, r])
        ends = np.concatenate([[0], np.cumsum((size > 0) * BANDS)])
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band.view(np.int64).reshape(-1)))
        return {"id": column(batch, "id"), "key": column(batch, "key"), "n_words": pa.array(size.astype(np.int64)), "bands": flat}

    kind = df.schema["id"].dataType.simpleString().replace("bigint", "long")
    return map_texts(df, "text", make, f"id {kind}, key long, n_words long, bands array<long>")


def _judge(centre_id, centre, members):
    words = words_of([centre, *(t for _, t in members)])
    head = multiset(words.hash[words.begin[0] : words.begin[1]])
    for i, (member, _) in enumerate(members, 1):
        s = similarity(head, multiset(words.hash[words.begin[i] : words.begin[i + 1]]))
        if s >= SIMILAR:
            yield centre_id, member, s


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rep_id, class_id and n_links of every row.

    rep_id is the least id of the documents with the same text, class_id the least id of all that
    links of similarity 0.8 or more connect, n_links how many verified links the text has with
    others.  A text without words (null and empty ones too) is alone in its class.  A null id has
    null rep_id and class_id and meets nobody.  Ids may be of any type that has an order.  Rows that
    repeat an id come out each, with the class of their own text.  Texts of any length are compared
    whole.  An empty table gives an empty table.
    """
    return _assign(df, id_col, text_col).select("doc_id", "rep_id", "class_id", "n_links")


def _assign(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``near_duplicates``, with the text's key and that of the text that stands for the class."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = checkpoint(signatures(rows))
    worded = signed.filter("id is not null and n_words > 0")
    reps = checkpoint(worded.groupBy("key").agg(F.min("id").alias("rep_id"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")))
    hot_texts = hot_of(reps, "key")[0]
    banded = reps.select("key", "n_words", F.explode("bands").alias("bucket"))
    drawn = F.min_by("key", F.xxhash64("bucket", "key")).alias("drawn")
    shared = checkpoint(banded.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("last"), F.count("*").alias("size"), drawn).filter("least <> last"))
    hot = hot_of(shared, "bucket", "size")[0]
    met = checkpoint(join_hot(banded, shared.select("bucket", "least", "drawn"), hot, "bucket"))
    wanted = reps.join(met.select("key").distinct(), "key", "left_semi").select("key", "rep_id")
    of_rep = one_text_each(rows.filter("id is not null and text is not null"), hot_texts).join(wanted, "key").filter("id = rep_id")
    texts = checkpoint(of_rep.select("key", "text").dropDuplicates(["key"]))  # all that any turn compares
    links = checkpoint(_verify(_pairs(met, F.array("least", "drawn")), texts))
    labels = components(links)
    named = met.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = checkpoint(named.filter("key <> least and key <> drawn").select("bucket", "key", "n_words", "label"))  # those two have met the bucket
    split = named.groupBy("bucket").agg(F.ceil(F.sum(F.col("n_words") + 20) / GROUP_WORDS).alias("parts"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    forget(met)
    found = checkpoint(_meet(join_hot(named, split.select("bucket", "parts"), hot, "bucket"), reps.select("key", "bands"), texts))
    forget(texts, named)
    if found.count():
        links = checkpoint(links.unionByName(found).dropDuplicates(["a", "b"]))
        labels = _merged(labels, found)
    return _classes(signed, reps, hot_texts, links, labels)


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(id, label) after more links: components of the labels that these connect."""
    ends = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = checkpoint(labels.unionByName(ends.join(labels, "id", "left_anti").withColumn("label", F.col("id"))))
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    between = found.join(side("a"), "a").join(side("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    new = components(between).select(F.col("id").alias("label"), F.col("label").alias("new"))
    return labels.join(new, "label", "left").select("id", F.coalesce("new", "label").alias("label"))


def _pairs(met: DataFrame, centres) -> DataFrame:
    pairs = met.select(F.col("key").alias("member"), F.explode(centres).alias("centre"), "n_words")
    return pairs.filter("member <> centre").distinct()


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    found = star_groups(pairs, texts, _judge, "a long, b long, similarity double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").dropDuplicates(["a", "b"])


def _meet(named: DataFrame, bands: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts of a bucket that have different labels; named has (bucket, key, label, parts)."""
    part, other = F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = named.select("bucket", "key", "label", part, other).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    sent = dealt.drop("other").join(texts.join(bands, "key"), "key")
    names, types = ["a", "b", "similarity"], [pa.int64(), pa.int64(), pa.float64()]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.unique(table["key"].to_numpy(), return_index=True)[1])
        ids, labels, parts = (table[n].to_numpy() for n in ("key", "label", "part"))
        bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(ids), BANDS)
        out = list(zip(*_cell(table["bucket"][0].as_py(), ids, labels, parts, bands, table["text"].cast(pa.binary()).to_pylist()), strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, out, types, strict=True)})

    return sent.groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long, similarity double")


def _cell(bucket: int, ids: np.ndarray, labels: np.ndarray, parts: np.ndarray, bands: np.ndarray, texts: list[bytes]):
    """Links of a cell: of one part all pairs, of two those across, where labels differ and no band before the bucket's is common."""
    band, across = int((bands == bucket).any(axis=0).argmax()), parts.min() < parts.max()
    if (labels == labels[0]).all():
        return
    words = words_of(texts)
    sets = [multiset(words.hash[words.begin[d] : words.begin[d + 1]]) for d in range(len(texts))]
    size = np.array([len(i) for i, _ in sets])
    total = np.array([c.sum() for _, c in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    _, item = np.unique(np.concatenate([i for i, _ in sets]), return_inverse=True)
    count, of = np.concatenate([c for _, c in sets]), np.repeat(np.arange(len(ids)), size)
    order = np.argsort(item, kind="stable")
    held, times, first = of[order], count[order], np.concatenate([[0], np.cumsum(np.bincount(item))])
    for d in range(len(ids) - 1):
        meets = labels[d + 1 :] != labels[d]
        if across:
            meets &= parts[d + 1 :] != parts[d]
        meets &= ~(bands[d + 1 :, :band] == bands[d, :band]).any(axis=1)
        if not meets.any():
            continue
        own = item[begin[d] : begin[d + 1]]
        n = first[own + 1] - first[own]
        at = np.arange(n.sum()) + np.repeat(first[own] - np.cumsum(n) + n, n)
        both = np.bincount(held[at], np.minimum(times[at], np.repeat(count[begin[d] : begin[d + 1]], n)), len(ids))[d + 1 :]
        near = both / (total[d] + total[d + 1 :] - both)
        for e in np.flatnonzero(meets & (near >= SIMILAR)).tolist():
            yield int(ids[d]), int(ids[d + 1 + e]), float(near[e])


def _classes(signed: DataFrame, reps: DataFrame, hot_texts: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    linked = checkpoint(reps.select("key", "rep_id").join(labels.withColumnRenamed("id", "key"), "key").join(ends, "key"))
    least = linked.groupBy("label").agg(F.min(F.struct("rep_id", "key")).alias("c"))
    hot = hot_keys(linked, "label")[0]
    marks = join_hot(linked, least, hot, "label").select("key", "c", "n_links")
    none = F.struct("rep_id", "key")
    known = checkpoint(reps.select("key", "rep_id").join(marks, "key", "left").select("key", "rep_id", F.coalesce("c", none).alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    worded = F.col("id").isNotNull() & (F.col("n_words") > 0)
    same = join_hot(signed.filter(worded).select(F.col("id").alias("doc_id"), "key"), known, hot_texts, "key")
    alone = signed.filter(~worded).select(F.col("id").alias("doc_id"), "key", F.col("id").alias("rep_id"), F.col("id").alias("class_id"), F.col("key").alias("class_key"), F.lit(0).cast("long").alias("n_links"))
    return same.select("doc_id", "key", "rep_id", F.col("c.rep_id").alias("class_id"), F.col("c.key").alias("class_key"), "n_links").unionByName(alone)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each class, the one with the class's id; rows with a null id stay.

    Of rows that repeat an id and a text one stays.  A row that repeats a kept id with another text
    goes if it is of the same class, and else stays or goes with the class of its own text.
    """
    found = _assign(df, id_col, text_col).filter("doc_id is not null")
    other = (F.col("doc_id") != F.col("class_id")) | (F.col("key") != F.col("class_key"))
    doc, key = fresh(df, "__id", "__key")
    odd = checkpoint(found.groupBy(F.col("doc_id").alias(doc), F.col("key").alias(key)).agg(F.max(other).alias("gone"), F.count("*").alias("n")).filter("gone or n > 1"))
    same_row = [df[id_col] == F.col(doc), F.xxhash64(df[text_col]) == F.col(key)]
    kept = df.join(odd.filter("gone").select(doc, key), same_row, "left_anti")
    again = odd.filter("not gone").select(doc, key)
    if again.isEmpty():
        return kept
    once = kept.join(again, same_row, "left_semi").withColumn(key, F.xxhash64(text_col)).dropDuplicates([id_col, key]).drop(key)
    return kept.join(again, same_row, "left_anti").unionByName(once)
