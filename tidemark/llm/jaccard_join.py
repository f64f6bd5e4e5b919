"""Exact n-gram Jaccard join by grouped prefixes, reduced to the components of its links.

1. One pass over the texts hashes every document's set of word n-grams; documents with equal sets are one class.
   An n-gram's cell is the top of its hash, of a width that grows with the corpus. All cells of all texts are counted
   exactly: chunks of documents deal their sorted cells to buckets, and get back the counts above one.
2. A set's prefix is its first n - ceil(t * n) + 1 n-grams, rarest cell first, then by hash. Two sets with similarity
   t or more have an n-gram in common within their prefixes, whatever order all sets share. Cells that occur once
   stand first and link nothing, so they take their place in the prefix but are not listed; most texts list nothing.
3. Classes with an identical prefix and size collapse into one group, and only groups are listed under the cells of
   their prefixes. Lists with a single group vanish; the remaining groups expand into their classes.
4. In rounds, each class is verified against a few pivots of its lists, and whatever is linked becomes one component:
   pairs inside a component need no test. Pivots are classes with few n-grams of their own: what a group of near
   copies was made from shares nearly all of its n-grams, while two copies may differ too much. When few pairs are left, or a round thins them no more, every pair of a list
   is verified that lies in two components, passes the size filter, and stands early enough in both prefixes.
5. Verification computes both sets from the whole texts and compares 100 * intersection >= 100 t * union in
   integers. Any two similar sets in different components meet in some list, so no link is lost.

N-grams are compared by 64-bit hashes of their words, sets of classes by 128-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops
from tidemark.llm.components import merged
from tidemark.llm.store import Shelf

_STEP, _SHORT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
_K = [np.uint64(k) for k in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words, but not none, is one n-gram."""
    data, offsets = textops.utf8(texts)
    starts, ends, first = textops.spans(data, offsets, textops.SPACE_SEPARATED)
    words = textops.hashes(data, starts, ends)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        grams = grams * _STEP + words[j : len(words) - n + 1 + j]
    grams = textops.mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.full(1, _SHORT) + np.uint64(b - a)
            for x in words[a:b]:
                h = textops.mix(h * _STEP + x)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _set_hash(s: np.ndarray) -> bytes:
    """128 bits that identify a set."""
    size = np.uint64(len(s))
    low = [np.bitwise_xor.reduce(textops.mix(s * k + size)) for k in _K[:2]]
    high = [np.sum(textops.mix(s ^ k), dtype=np.uint64) for k in _K[2:]]
    return (np.array(low, np.uint64) + np.array(high, np.uint64)).tobytes()


#: N-grams that a task holds before it deals them out, and documents of a chunk, numbered in 16 bits.
_HELD, _DOCUMENTS = 500_000, 65_000

#: What a dealt row is: a document, cells of a chunk to be counted, a chunk's own table, counts for a chunk.
_DOC, _ASK, _OWN, _TOLD = 0, 1, 2, 3


def _dealt(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (kind, part, chunk, body) for the count of cells, and the documents without text, with size and cls.

    A chunk is some documents of a task. Its cells are asked for once each, with the document's number in the chunk
    if a single one has it, else with the count; which documents have the others stays in the chunk's own table.
    """
    base = [f for f in docs.schema.fields if f.name != "text"]
    made = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("body", T.BinaryType())]
        + [T.StructField(f.name, f.dataType) for f in base]
        + [T.StructField("size", T.LongType()), T.StructField("cls", T.BinaryType())]
    )
    arrow = docs.select(*[f.name for f in base]).limit(0).toArrow().schema

    def rows(kind: int, parts: list[int], chunk: int, bodies: list[bytes]) -> pa.RecordBatch:
        m = len(parts)
        columns = [pa.array([kind] * m, pa.int32()), pa.array(parts, pa.int64()), pa.array([chunk] * m, pa.int64()), pa.array(bodies, pa.binary())]
        columns += [pa.nulls(m, f.type) for f in arrow] + [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=made.names)

    def asked(sets: list[np.ndarray], own: list[tuple[bytes, int, int]], chunk: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.uint32)
        cell = np.concatenate(sets) >> np.uint64(32 - bits)
        who = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(cell, kind="stable")
        cell, who = cell[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        many = np.diff(np.append(first, len(cell)))
        alone = many == 1
        repeated = np.repeat(~alone, many)
        keys = np.array([(k1, k2) for _, k1, k2 in own], np.int64)
        body = struct.pack("<II", len(sets), int(repeated.sum())) + sizes.tobytes() + b"".join(c for c, _, _ in own) + keys.tobytes() + cell[repeated].tobytes() + who[repeated].tobytes()
        yield rows(_OWN, [-chunk], chunk, [body])
        one, one_who = cell[first[alone]], who[first[alone]]
        more, count = cell[first[~alone]], many[~alone].astype(np.uint32)
        ones, mores = one.astype(np.uint32), more.astype(np.uint32)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
        at, to = np.searchsorted(one, edges), np.searchsorted(more, edges)
        parts = np.flatnonzero((np.diff(at) > 0) | (np.diff(to) > 0))
        for some in np.array_split(parts, max(1, len(parts) // 64)):
            bodies = []
            for p in some.tolist():
                a, b, c, d = at[p], at[p + 1], to[p], to[p + 1]
                bodies.append(struct.pack("<I", b - a) + ones[a:b].tobytes() + one_who[a:b].tobytes() + mores[c:d].tobytes() + count[c:d].tobytes())
            if bodies:
                yield rows(_ASK, some.tolist(), chunk, bodies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() + 1) << 24
        sets: list[np.ndarray] = []
        own: list[tuple[bytes, int, int]] = []
        seen: set[bytes] = set()
        held = row = 0
        for batch in textops.small_batches(batches):
            size, cls = [], []
            for s, k1, k2 in zip(shingle_sets(batch.column("text"), n), batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), strict=True):
                c = _set_hash(s)
                size.append(len(s))
                cls.append(c)
                if len(s) and c not in seen:
                    seen.add(c)
                    sets.append(s)
                    own.append((c, k1, k2))
                    held += len(s)
                    if held > _HELD or len(sets) >= _DOCUMENTS:
                        yield from asked(sets, own, chunk)
                        chunk, sets, own, seen, held = chunk + 1, [], [], set(), 0
            m = batch.num_rows
            parts = np.arange(row, row + m, dtype=np.int64) * 64 + chunk
            row += m
            columns = [pa.array([_DOC] * m, pa.int32()), pa.array(-parts), pa.array([chunk] * m, pa.int64()), pa.nulls(m, pa.binary())]
            columns += [batch.column(f.name) for f in base] + [pa.array(size, pa.int64()), pa.array(cls, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=made.names)
        if sets:
            yield from asked(sets, own, chunk)

    return docs.mapInArrow(run, made)


def _counted(dealt: DataFrame, tasks: int) -> DataFrame:
    """The rows of ``_dealt``, with every chunk's cells replaced by the counts of those above one."""
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked, schema = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            ones, whos, mores, counts = [], [], [], []
            for _, body in asked:
                k = struct.unpack_from("<I", body)[0]
                m = (len(body) - 4 - 6 * k) // 8
                ones.append(np.frombuffer(body, np.uint32, k, 4))
                whos.append(np.frombuffer(body, np.uint16, k, 4 + 4 * k))
                mores.append(np.frombuffer(body, np.uint32, m, 4 + 6 * k))
                counts.append(np.frombuffer(body, np.uint32, m, 4 + 6 * k + 4 * m))
            cells, at = np.unique(np.concatenate([*ones, *mores]), return_inverse=True)
            weight = np.concatenate([*[np.ones(len(x), np.int64) for x in ones], *[x.astype(np.int64) for x in counts]])
            count = np.minimum(np.bincount(at, weight, len(cells)), 2**32 - 1).astype(np.uint32)[at]
            a, b = 0, sum(map(len, ones))
            chunks, bodies = [], []
            for (chunk, _), one, who, more in zip(asked, ones, whos, mores, strict=True):
                c, d = count[a : a + len(one)], count[b : b + len(more)]
                a, b = a + len(one), b + len(more)
                shared = c > 1
                if shared.any() or len(d):
                    chunks.append(chunk)
                    bodies.append(struct.pack("<I", int(shared.sum())) + one[shared].tobytes() + c[shared].tobytes() + who[shared].tobytes() + more.tobytes() + d.tobytes())
            m = len(chunks)
            if m:
                columns = [pa.array([_TOLD] * m, pa.int32()), pa.array([part] * m, pa.int64()), pa.array(chunks, pa.int64()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(m, f.type) for f in list(schema)[4:]], names=names)

        for batch in batches:
            textops.release()
            schema = batch.schema
            kinds = batch.column("kind")
            asks = pa.compute.equal(kinds, _ASK)
            rest = batch.filter(pa.compute.invert(asks))
            if rest.num_rows:
                yield rest
            asks = batch.select(["part", "chunk", "body"]).filter(asks)
            for p, chunk, body in zip(*(asks.column(k).to_pylist() for k in range(3)), strict=True):
                if p != part:
                    if asked:
                        yield from told()
                    part, asked = p, []
                asked.append((chunk, body))
        if asked:
            yield from told()

    return dealt.repartition(tasks, "part").sortWithinPartitions("kind", "part").mapInArrow(run, dealt.schema)


def _posted(counted: DataFrame, tasks: int, percent: int) -> DataFrame:
    """Classes with cells to list: the prefix without the ``skip`` cells that occur once, and the group's key."""

    def prefixes(body: bytes, told: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        docs, repeated = struct.unpack_from("<II", body)
        sizes = np.frombuffer(body, np.uint32, docs, 8).astype(np.int64)
        at = 8 + 4 * docs
        keys = np.frombuffer(body, np.int64, 2 * docs, at + 16 * docs).reshape(docs, 2)
        own = np.frombuffer(body, np.uint64, repeated, at + 32 * docs)
        own_who = np.frombuffer(body, np.uint16, repeated, at + 32 * docs + 8 * repeated)
        cells, counts, whos, mores, many = [], [], [], [], []
        for part, x in sorted(told):
            k = struct.unpack_from("<I", x)[0]
            m = (len(x) - 4 - 10 * k) // 8
            high = np.uint64(part << 32)
            cells.append(np.frombuffer(x, np.uint32, k, 4).astype(np.uint64) | high)
            counts.append(np.frombuffer(x, np.uint32, k, 4 + 4 * k))
            whos.append(np.frombuffer(x, np.uint16, k, 4 + 8 * k))
            mores.append(np.frombuffer(x, np.uint32, m, 4 + 10 * k).astype(np.uint64) | high)
            many.append(np.frombuffer(x, np.uint32, m, 4 + 10 * k + 4 * m))
        if not cells:
            return None
        # buckets, and cells in them, come in order, so the counts of repeated cells can be looked up
        cell, who = np.concatenate([*cells, own]), np.concatenate([*whos, own_who]).astype(np.int64)
        count = np.concatenate([*counts, np.concatenate(many)[np.searchsorted(np.concatenate(mores), own)] if repeated else np.zeros(0, np.uint32)])
        order = np.lexsort((cell, count, who))
        cell, who = cell[order], who[order]
        shared = np.bincount(who, minlength=docs)
        skip = sizes - shared
        listed = np.minimum(sizes - -(-percent * sizes // 100) + 1 - skip, shared)
        begin = np.cumsum(shared) - shared
        found = np.flatnonzero(listed > 0)
        if not len(found):
            return None
        prefix = [cell[b : b + k] for b, k in zip(begin[found].tolist(), listed[found].tolist(), strict=True)]
        grp = [int(np.frombuffer(_set_hash(p), np.int64)[0]) for p in prefix]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
        cls = [body[at + 16 * d : at + 16 * d + 16] for d in found.tolist()]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(keys[found, 0]), pa.array(keys[found, 1]), pa.array(sizes[found]), pa.array(skip[found]), pa.array(grp, pa.int64()), lists], names=["cls", "_k1", "_k2", "size", "skip", "grp", "prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own, told = None, b"", []
        for batch in batches:
            textops.release()
            for kind, part, c, body in zip(*(batch.column(k).to_pylist() for k in ("kind", "part", "chunk", "body")), strict=True):
                if kind == _OWN:
                    if chunk is not None and (out := prefixes(own, told)):
                        yield out
                    chunk, own, told = c, body, []
                else:
                    told.append((part, body))
        if chunk is not None and (out := prefixes(own, told)):
            yield out

    rows = counted.where(F.col("kind") >= _OWN).select("kind", "part", "chunk", "body").repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")
    return rows.mapInArrow(run, "cls binary, _k1 long, _k2 long, size long, skip long, grp long, prefix array<long>")


#: Leaves of one hub that a block of verification holds.
_BLOCK = 64


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, shelf: Shelf) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' sets are similar enough.

    A pair's hub is its class with more pairs. A hub's pairs fall into blocks of about _BLOCK leaves; each block takes the
    hub's text once, before the leaves' texts stream in.
    """
    ends = shelf.keep(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("d")))
    da, db = (ends.select(F.col("cls").alias(x), F.col("d").alias(f"d{x}")) for x in "ab")
    both = pairs.join(da, "a").join(db, "b")
    hub_is_a = F.struct("da", "a") > F.struct("db", "b")
    keyed = both.select(F.when(hub_is_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub_is_a, F.col("b")).otherwise(F.col("a")).alias("cls"), F.greatest("da", "db").alias("d"))
    keyed = keyed.select("hub", "cls", F.pmod(F.xxhash64("cls"), F.ceil(F.col("d") / _BLOCK)).alias("block"))
    hubs = keyed.select("hub", "block", F.col("hub").alias("cls")).distinct()
    rows = keyed.select("hub", "block", "cls", F.lit(1).alias("leaf")).unionByName(hubs.select("hub", "block", "cls", F.lit(0).alias("leaf")))
    rows = rows.join(texts, "cls").repartition("hub", "block").sortWithinPartitions("hub", "block", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for batch in textops.small_batches(batches, 512):
            good_a, good_b = [], []
            for hub, cls, leaf, y in zip(*(batch.column(c).to_pylist() for c in ("hub", "cls", "leaf")), shingle_sets(batch.column("text"), n), strict=True):
                if not leaf:
                    x = y
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    good_a.append(hub)
                    good_b.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.binary()), pa.array(good_b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _clustered(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``docs`` without text, with keys of the text (_k1, _k2), ``size`` and ``_comp``, a component's class."""
    with textops.arrow_rows(docs.sparkSession):  # all jobs with texts run here
        return _joined(docs, n, percent)


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    shelf = Shelf(spark)
    keyed = docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "text")})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket for about two million n-grams, a quarter of a task's or less; a text has at most half as many as bytes
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(4 * tasks, size // 4_000_000).bit_length())
    counted = shelf.keep(_counted(_dealt(keyed, n, bits), tasks))
    posted = _posted(counted, tasks, percent)
    classes = shelf.keep(posted.groupBy("cls").agg(F.min(F.struct("_k1", "_k2")).alias("k"), *[F.first(c).alias(c) for c in ("grp", "size", "skip", "prefix")]))
    # a group is listed once; lists of one group vanish
    groups = shelf.keep(classes.groupBy("grp", "size").agg(F.first("skip").alias("skip"), F.first("prefix").alias("prefix"), F.count("*").alias("classes")))
    listed = groups.select("grp", "size", "skip", F.posexplode("prefix").alias("pos", "list")).withColumn("pos", F.col("pos") + F.col("skip"))
    listed = shelf.keep(listed)
    long = shelf.keep(listed.groupBy("list").agg(F.count("*").alias("m")).where("m > 1").select("list"))
    shared = listed.join(long, "list").select("list", "grp", "size", "skip", "pos")
    # groups expand into their classes; a group of several classes is a list of its own
    several = groups.where("classes > 1").select(F.col("grp").alias("list"), "grp", "size", "skip", F.lit(0).alias("pos"))
    lists = shelf.keep(shared.unionByName(several).join(classes.select("grp", "size", "cls"), ["grp", "size"]).select("list", "cls", "size", "skip", "pos"))
    needed = shelf.keep(lists.select("cls").distinct().join(classes.select("cls", "k"), "cls").select("cls", "k._k1", "k._k2"))
    texts = shelf.keep(_of(keyed.select("_k1", "_k2", "text"), needed))
    shelf.drop(groups, classes, listed, long, needed)
    labels = _linked(lists, texts, n, percent, shelf)
    shelf.drop(lists, texts)
    rows = counted.where(F.col("kind") == _DOC).drop("kind", "part", "chunk", "body")
    comp = F.when(F.col("size") > 0, F.col("cls"))
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        comp = F.when(F.col("size") > 0, F.coalesce("component", "cls"))
    return rows.withColumn("_comp", comp).drop("cls", "component")


def _linked(lists: DataFrame, texts: DataFrame, n: int, percent: int, shelf: Shelf) -> DataFrame | None:
    """(node, component) of classes that links reach; None if there are no links."""
    labels, tested, rows, before, rounds = None, [], lists.count(), 0, 0
    while rows:
        named = lists if labels is None else lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        named = named.withColumn("comp", F.col("cls") if labels is None else F.coalesce("component", "cls")).drop("component")
        per = shelf.keep(named.groupBy("list", "comp").agg(F.count("*").alias("c")).groupBy("list").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("mm"), F.count("*").alias("comps")).where("comps > 1"))
        left = per.agg(F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2)).first()[0] or 0
        # pairs left by list; the first round always thins, the last one tests what a round no longer thins
        last = rounds > 0 and (left <= rows or left > 0.9 * before)
        if not left:
            shelf.drop(per)
            break
        live = shelf.keep(named.join(per.select("list"), "list"))
        pairs = _all_pairs(live, percent) if last else _to_pivots(live, percent, rounds, shelf)
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = shelf.keep(pairs)
        found = shelf.keep(_verified(pairs, texts, n, percent, shelf))
        labels = merged(labels, found, shelf)
        shelf.drop(found, live, per)
        tested.append(pairs)
        if last:
            break
        before, rounds = left, rounds + 1
    shelf.drop(*tested)
    return labels


def similarity_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Adds n_shingles and component_id to ``docs`` (doc_id, text, ...); the text column goes.

    Two documents link when the Jaccard similarity of their sets of distinct word n-grams is percent/100 or
    more; component_id is the smallest doc_id that links lead to, the document's own included. A-Z count as
    a-z, words are runs of anything but white space. A text of fewer than n words is one n-gram; without
    words, or null, the set is empty and links with nothing. A text of any length is one set, taken whole by one task.
    Repeated doc_ids and rows are documents of their own. A null doc_id is larger than any other: its component_id is
    null only if no linked document has one. Other columns stay, whatever their names; columns named like the results
    are replaced. An empty table gives no rows. ``docs`` should be a table as read, so that a repeated task sees its
    rows in the same order.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_shingles", "component_id")]
    rest = F.struct(*others) if others else F.lit(None).cast("int")  # one column, so no name can clash
    rows = _clustered(docs.select("doc_id", "text", rest.alias("_rest")), n, percent)
    least = Shelf(docs.sparkSession).keep(rows.where("_comp IS NOT NULL").groupBy("_comp").agg(F.min("doc_id").alias("_least")))
    out = rows.join(least, "_comp", "left").withColumn("component_id", F.when(F.col("_comp").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    return out.select("doc_id", *[F.col(f"_rest.`{c}`").alias(c) for c in others], F.col("size").alias("n_shingles"), "component_id")


def _of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """Texts of the needed keys. A bitmap of fixed size keeps most other texts out of the shuffle, copies go once a task."""
    near = _placed(texts).join(F.broadcast(_bitmap(needed)), "_bucket").where(_has_bit()).groupBy("_k1", "_k2").agg(F.first("text").alias("text"))
    return near.join(needed, ["_k1", "_k2"]).select("cls", "text")


def _to_pivots(live: DataFrame, percent: int, rounds: int, shelf: Shelf, most: int = 4) -> DataFrame:
    """For each class, the pivots of most of its lists.

    A list's pivot is one of those with the least share of n-grams that no other set has, another one each round.
    """
    own = F.floor(32 * F.col("skip") / F.col("size")) if rounds else F.col("skip") / F.col("size")
    x = live.select("list", "cls", "comp", "size", F.struct(own.alias("own"), F.xxhash64(F.lit(rounds), "cls").alias("hash")).alias("h"))
    pivot = shelf.keep(x.groupBy("list").agg(F.min(F.struct("h", "cls", "comp", "size")).alias("p")))
    near = x.join(pivot, "list").where((F.col("p.comp") != F.col("comp")) & (100 * F.col("size") >= percent * F.col("p.size")) & (100 * F.col("p.size") >= percent * F.col("size")))
    near = near.groupBy("cls", F.col("p.cls").alias("other")).agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("shared"), "other"))
    return near.withColumn("r", rank).where(F.col("r") <= most).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _all_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Every pair in two components that sizes and places in the prefixes allow to be similar.

    Similar sets share at least t / (1 + t) of the sum of their sizes. Of what they share, the first n-gram in
    the common order stands in both so early that as many others can follow; so a pair is taken from such
    lists alone.
    """
    x = live.select("list", F.col("cls").alias("a"), F.col("comp").alias("comp_a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a"))
    y = live.select("list", F.col("cls").alias("b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    least = F.ceil(percent * (F.col("size_a") + F.col("size_b")) / (100 + percent) - 1e-9)
    early = (F.col("size_a") - F.col("pos_a") >= least) & (F.col("size_b") - F.col("pos_b") >= least)
    on = (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & (100 * F.col("size_a") >= percent * F.col("size_b")) & (100 * F.col("size_b") >= percent * F.col("size_a")) & early
    return x.join(y, "list").where(on).select("a", "b").distinct()


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one document of each component of ``similarity_components``.

    The document with the smallest doc_id stays (among equal ids the one with the smallest hash of its text,
    and one of equal rows). Documents without words link with nothing and all stay; all columns do, whatever
    their names. An empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    keys = ["_id", "_k1", "_k2"]
    rows = _clustered(docs.select(F.col("doc_id").alias("_id"), "text"), n, percent).where("_comp IS NOT NULL")
    each = shelf.keep(rows.groupBy("_comp", *keys).agg(F.count("*").alias("copies")))
    place = F.struct(F.col("_id").isNull().alias("none"), *keys)
    best = shelf.keep(each.groupBy("_comp").agg(F.min(place).alias("best"), F.sum("copies").alias("all")).where("all > 1").drop("all"))
    # most documents stay as they are and need no join; a bitmap tells which may not
    changed = shelf.keep(each.join(best, "_comp").withColumn("stays", place == F.col("best")).where("NOT stays OR copies > 1").select(*[F.col(k).alias(f"{k}_") for k in keys], "stays"))
    shelf.drop(each, best)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # one column, so no name can clash
    keyed = _placed(docs.select(whole, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")))
    bitmap = _bitmap(changed.select(F.col("_k1_").alias("_k1"), F.col("_k2_").alias("_k2")))
    marked = keyed.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_maybe", F.col("_map").isNotNull() & _has_bit())
    on = [F.col("_id").eqNullSafe(F.col("_id_")), F.col("_k1") == F.col("_k1_"), F.col("_k2") == F.col("_k2_")]
    checked = marked.where("_maybe").select("_row", *keys).join(changed, on, "left").where("stays IS NULL OR stays")
    single = checked.where("stays IS NULL").select("_row")
    copies = checked.where("stays").dropDuplicates(keys).select("_row")
    return marked.where("NOT _maybe").select("_row").unionByName(single).unionByName(copies).select("_row.*")


_BUCKETS = 256  # of 32,768 bits: a bitmap of 1 MB, whatever the number of keys


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the bucket and bit of each row's key."""
    place = F.pmod(F.xxhash64("_k1", "_k2"), F.lit(_BUCKETS * 32768))
    return rows.withColumns({"_bucket": (place / 32768).cast("long"), "_bit": place % 32768})


def _bitmap(keys: DataFrame) -> DataFrame:
    return _placed(keys.select("_k1", "_k2")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def _has_bit() -> Column:
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
