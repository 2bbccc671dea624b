"""A full-text index kept in files, with the ranking of textindex.search.

An index is a folder of immutable segments. A segment holds postings and its documents' numbers, ids and lengths. Numbers
run in ranges of RANGE, and a row of postings is a block: one term in one range, as offsets in the range with weighted
frequencies, lengths and places beside it, and the greatest frequency and least length of the block. Blocks lie in
partitions by a hash of the term, sorted by term and range, so a query opens the partitions of its terms alone.

A query reads the small columns of its terms' blocks first: from them come the numbers of documents and a bound of the
score in each range that has all words. The ranges of the greatest bounds are scored; the k-th score found there rules
out all ranges whose bound is below it, and only the others are read (block-max). A phrase is made into blocks of its
own from the places of its terms.

New documents become a new segment, deleted ones a table of tombstones, and `merge` makes one segment of all. The
manifest is a table of versions, each written as one file at once; readers take the last whole version and keep it.

A document that a third of all documents share a term with is no hot key: blocks are made for each (term, range). A task
numbers the documents it reads and makes the blocks of a range from its tokens at once, so postings are never rows of a
shuffle; only whole blocks are dealt out. A range ends at RANGE documents or RANGE_TOKENS tokens. `merge` moves whole
blocks, too: a large range gets a new number, several small ones become one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.functions import text as X
from gistmill.operators.textindex import K1, IDF_FLOOR, B
from gistmill.operators.versions import Versions
from gistmill.session import durable, stored

RANGE_BITS = 12
RANGE = 1 << RANGE_BITS
#: Tokens at which a range ends, some 100 MB of a task, and bits of the number of a task's range.
RANGE_TOKENS, SEQ_BITS = 1 << 21, 20
#: The part of the rows that hold documents instead of a term.
DOCS_PART = -1
#: Places of one column end before those of the next begin.
COLUMN_BITS = 30
COLUMN = 1 << COLUMN_BITS
#: Ranges that are scored before the others are ruled out, and at most so many named in a filter of the scan.
FIRST, NAMED = 32, 2000
PARTS = 32
MANIFEST = "kind string, name string, docs long, tokens long"
LISTED = ("segment", "range", "offs", "tfs", "lens", "n", "max_tf", "min_len")
ROWS = "term string, range long, offs array<int>, tfs array<double>, lens array<int>, places array<array<long>>, n long, max_tf double, min_len int"
BLOCKS = f"segment string, part int, {ROWS}"


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _name() -> str:
    """Never like a number, as a reader infers the types of folders' names."""
    return f"s{uuid.uuid4().hex}"


def _range_blocks(number: int, ids: pa.Array, cut: list[pa.Array], weights: list[float]) -> pa.RecordBatch:
    """The blocks of one range: ids are its documents, cut the lists of tokens of each column. The first row holds the
    documents themselves."""
    sizes = [np.diff(c.offsets.to_numpy()) for c in cut]
    lens = np.sum(sizes, axis=0, dtype=np.int64)
    words = pa.chunked_array([c.flatten() for c in cut]).combine_chunks().dictionary_encode()
    off = np.concatenate([np.repeat(np.arange(len(ids)), s) for s in sizes])
    at = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + k * COLUMN for k, s in enumerate(sizes)])
    weight = np.repeat(weights, [s.sum() for s in sizes])
    key = words.indices.to_numpy().astype(np.int64) * len(ids) + off
    order = np.argsort(key, kind="stable")
    key, at, weight = key[order], at[order], weight[order]
    post = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    term, off = key[post] // len(ids), key[post] % len(ids)
    block = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    tf = np.add.reduceat(weight, post) if len(post) else np.empty(0)
    most, least = (np.maximum.reduceat(tf, block), np.minimum.reduceat(lens[off], block)) if len(block) else (tf, lens[:0])

    # the row of the documents comes first: its offsets and lengths, nothing else
    n = len(ids)
    bounds = np.r_[0, n, n + block[1:], n + len(post)] if len(block) else np.array([0, n])
    blank = np.r_[0, 0, block[1:], len(post)] if len(block) else np.array([0, 0])

    def lists(values: np.ndarray, kind: pa.DataType, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))

    places = pa.ListArray.from_arrays(pa.array(np.r_[post, len(at)], pa.int32()), pa.array(at, pa.int64()))
    made = {
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.take(pa.array(term[block])).cast(pa.string())]),
        "range": pa.array(np.full(len(block) + 1, number), pa.int64()),
        "offs": lists(np.r_[np.arange(n), off], pa.int32(), bounds),
        "tfs": lists(tf, pa.float64(), blank),
        "lens": lists(np.r_[lens, lens[off]], pa.int32(), bounds),
        "places": pa.ListArray.from_arrays(pa.array(blank, pa.int32()), places),
        "n": pa.array(np.diff(bounds), pa.int64()),
        "max_tf": pa.array(np.r_[0.0, most], pa.float64()),
        "min_len": pa.array(np.r_[lens.min(), least], pa.int32()),
        "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(len(block) + 1, n)], pa.int32()), ids),
    }
    return pa.RecordBatch.from_pydict(made)


def _cut_ranges(weights: list[float], most_docs: int, most_tokens: int):
    """Rows (id, t0, t1, ...) of tokens to blocks, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SEQ_BITS
        held: list[pa.RecordBatch] = []
        docs = tokens = 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            columns = [c.combine_chunks() for c in rows.columns]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return _range_blocks(number, columns[0], columns[1:], weights)

        for batch in batches:
            sums = np.cumsum(np.sum([np.diff(c.offsets.to_numpy()) for c in batch.columns[1:]], axis=0, dtype=np.int64))
            at = 0
            while at < len(sums):
                before = sums[at - 1] if at else 0
                # as many rows as there is room for, one at least if the range is empty
                end = min(int(np.searchsorted(sums, before + most_tokens - tokens, "right")), at + most_docs - docs)
                end = max(end, at + 1) if not docs else end
                if end > at:
                    held.append(batch.slice(at, end - at))
                    docs, tokens = docs + end - at, tokens + int(sums[end - 1] - before)
                    at = end
                if at < len(sums):
                    yield made()
                    number, held, docs, tokens = number + 1, [], 0, 0
        if held:
            yield made()

    return run


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks by their part, in the order of terms."""
    part = F.when(F.col("term").isNull(), DOCS_PART).otherwise(_part(F.col("term"), parts))
    return blocks.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("range"), F.lit(4))).sortWithinPartitions("part", "term", "range")


class StoredIndex:
    """An index below a folder that all executors share. weights: text columns and their weights."""

    def __init__(self, spark: SparkSession, root: str, weights: dict[str, float] | None = None, parts: int = PARTS) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self.weights = weights or {"text": 1.0}
        self.versions = Versions(spark, root, MANIFEST)
        self.manifest: list = []
        self.version = 0
        self._opened: DataFrame | None = None

    # versions

    def refresh(self) -> StoredIndex:
        """The last whole version."""
        self.version, self.manifest = self.versions.rows()
        self._opened = None
        return self

    def _commit(self, rows: Sequence[tuple[str, str, int, int]]) -> None:
        self.versions.commit(self.version, rows)
        self.refresh()

    def _held(self, kind: str) -> list[str]:
        return [r.name for r in self.manifest if r.kind == kind]

    def _kept(self) -> list[tuple[str, str, int, int]]:
        return [(r.kind, r.name, r.docs, r.tokens) for r in self.manifest]

    # tables

    def blocks(self) -> DataFrame:
        """All postings of the version; its folders are listed once."""
        if self._opened is None:
            paths = [f"{self.root}/postings/segment={s}" for s in self._held("segment")]
            self._opened = self.spark.read.schema(BLOCKS).option("basePath", f"{self.root}/postings").parquet(*paths)
        return self._opened

    def docs(self) -> DataFrame:
        """(segment, doc, id, length) of all documents, deleted ones too."""
        paths = [f"{self.root}/docs/segment={s}" for s in self._held("segment")]
        return self.spark.read.option("basePath", f"{self.root}/docs").parquet(*paths)

    def dead(self) -> DataFrame | None:
        """(segment, doc, length) of deleted documents."""
        paths = [f"{self.root}/dead/{s}" for s in self._held("dead")]
        return self.spark.read.schema("segment string, doc long, length long").parquet(*paths) if paths else None

    def live(self) -> DataFrame:
        dead = self.dead()
        return self.docs() if dead is None else self.docs().join(dead, ["segment", "doc"], "left_anti")

    # changes

    def add(self, docs: DataFrame, id_col: str = "doc_id") -> None:
        """One more segment. An id that the index has already is added beside it: delete it first."""
        name = _name()
        path = f"{self.root}/postings/segment={name}"
        # files are read again in the same order, so a task that is lost numbers its documents as before
        texts = stored(docs.select(docs[id_col].alias("id"), *[docs[c].cast("string").alias(f"c{k}") for k, c in enumerate(self.weights)]))
        cut = texts.select("id", *[X.tokens(F.col(f"c{k}")).alias(f"t{k}") for k in range(len(self.weights))])
        kind = f"ids array<{texts.schema['id'].dataType.simpleString()}>"
        made = cut.mapInArrow(_cut_ranges([float(w) for w in self.weights.values()], RANGE, RANGE_TOKENS), f"{ROWS}, {kind}")
        _dealt(made, self.parts).write.partitionBy("part").parquet(path)
        listed = self.spark.read.schema(f"part int, {ROWS}, {kind}").parquet(path).where(F.col("part") == DOCS_PART)
        x = F.explode(F.arrays_zip("offs", "ids", "lens")).alias("x")
        listed.select("range", x).select((F.col("range") * RANGE + F.col("x.offs")).alias("doc"), F.col("x.ids").alias("id"), F.col("x.lens").cast("long").alias("length")).write.parquet(f"{self.root}/docs/segment={name}")
        n, tokens = self.spark.read.parquet(f"{self.root}/docs/segment={name}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._commit([*self._kept(), ("segment", name, n, tokens)])

    def delete(self, ids: DataFrame) -> None:
        """Marks documents of these ids (a column id) as deleted."""
        name = _name()
        self.live().join(ids.select("id").distinct(), "id").select("segment", "doc", "length").write.parquet(f"{self.root}/dead/{name}")
        n, tokens = self.spark.read.schema("segment string, doc long, length long").parquet(f"{self.root}/dead/{name}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n:
            self._commit([*self._kept(), ("dead", name, -n, -tokens)])

    def merge(self) -> None:
        """One segment of all live documents, made of the segments' blocks without their texts."""
        name = _name()
        moves = stored(self._moves())  # a row for each range
        to = ["segment", "range"]
        live = self.live().withColumn("range", F.shiftright("doc", RANGE_BITS)).join(F.broadcast(moves.select(*to, "new", "base")), to)
        live.select((F.col("new") * RANGE + F.col("base") + F.col("doc") % RANGE).alias("doc"), "id", "length").write.parquet(f"{self.root}/docs/segment={name}")

        rows = self.blocks().where(F.col("part") != DOCS_PART).join(F.broadcast(moves), to)
        whole = rows.where("gone is null")
        # of a range with deleted documents, what is left: a mark for each of its documents
        x = F.filter(F.arrays_zip("offs", "tfs", "lens", "places"), lambda x: ~F.get("gone", x["offs"]))
        cut = rows.where("gone is not null").withColumn("x", x).where(F.size("x") > 0).withColumns({c: F.col("x")[c] for c in ("offs", "tfs", "lens", "places")})
        cut = cut.withColumns({"n": F.size("offs").cast("long"), "max_tf": F.array_max("tfs"), "min_len": F.array_min("lens")}).drop("x")
        base = F.col("base").cast("int")
        rows = whole.unionByName(cut).withColumn("offs", F.when(base == 0, F.col("offs")).otherwise(F.transform("offs", lambda o: o + base)))
        held = ["offs", "tfs", "lens", "places"]
        alone = rows.where("alone").select("term", F.col("new").alias("range"), *held, "n", "max_tf", "min_len")
        near = rows.where("not alone").groupBy("term", F.col("new").alias("range")).agg(F.array_sort(F.collect_list(F.struct("base", *held))).alias("x"), F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        near = near.select("term", "range", *[F.flatten(F.col("x")[c]).alias(c) for c in held], "n", "max_tf", "min_len")
        _dealt(alone.unionByName(near), self.parts).write.partitionBy("part").parquet(f"{self.root}/postings/segment={name}")
        n, tokens = self.spark.read.parquet(f"{self.root}/docs/segment={name}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._commit([("segment", name, n, tokens)])

    def _moves(self) -> DataFrame:
        """(segment, range, new, base, alone, gone): where each range with live documents goes in a merge. Its documents
        keep their order and gaps, from base on in the new range; alone: none else goes there. gone: for each of
        its offsets, if the document there is deleted; null if none is."""
        by, off = ["segment", F.shiftright("doc", RANGE_BITS).alias("range")], (F.col("doc") % RANGE).cast("int")
        ranges = self.live().groupBy(*by).agg((F.max(off) + 1).alias("span"), F.sum("length").alias("tokens"))
        dead = self.dead()
        gone = F.lit(None).cast("array<boolean>")
        if dead is not None:
            ranges = ranges.join(dead.groupBy(*by).agg(F.collect_set(off).alias("_dead")), ["segment", "range"], "left")
            gone = F.when(F.col("_dead").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(RANGE - 1)), lambda o: F.array_contains("_dead", o)))
        # ranges of at most half the size go together until the half is passed, so none gets over the size
        size = F.greatest(F.col("span").cast("long"), F.ceil(F.col("tokens") * RANGE / RANGE_TOKENS))
        ranges = ranges.select("segment", "range", "span", gone.alias("gone"), size.alias("size")).withColumn("alone", F.col("size") > RANGE // 2)
        order = Window.partitionBy("alone").orderBy("segment", "range")  # a row for each range
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = ranges.withColumn("bin", F.when(F.col("alone"), 2 * (F.row_number().over(order) - 1)).otherwise(2 * F.floor(before / (RANGE // 2)) + 1).cast("long"))
        into = Window.partitionBy("bin").orderBy("segment", "range").rowsBetween(Window.unboundedPreceding, -1)
        return ranges.select("segment", "range", F.col("bin").alias("new"), F.coalesce(F.sum("span").over(into), F.lit(0)).cast("long").alias("base"), "alone", "gone")

    # search

    def _of(self, terms: Sequence[str]) -> DataFrame:
        return self.blocks().where(F.col("part").isin([_part(F.lit(t), self.parts) for t in terms]) & F.col("term").isin(list(terms)))

    def _words(self, words: list[list[str]]) -> DataFrame:
        """The blocks of all words, k their word: single terms from one scan, each phrase by itself."""
        terms: dict[str, list[int]] = {}
        for k, phrase in enumerate(words):
            if len(phrase) == 1:
                terms.setdefault(phrase[0], []).append(k)
        made = [self._phrase(k, p) for k, p in enumerate(words) if len(p) > 1]
        if terms:
            # a term that is asked for twice counts twice
            of = F.create_map(*[x for t, ks in terms.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
            made.append(self._of(sorted(terms)).select(F.explode(of[F.col("term")]).alias("k"), *LISTED))
        return reduce(DataFrame.unionByName, made)

    def _phrase(self, k: int, phrase: list[str]) -> DataFrame:
        """Blocks of a phrase, made of its terms' places."""
        x = F.explode(F.arrays_zip("offs", "lens", "places")).alias("x")
        rows = self._of(sorted(set(phrase))).select("segment", "range", "term", x).select("segment", "range", "term", "x.*")
        met = rows.groupBy("segment", "range", "offs", "lens").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("places"))
        none = F.array().cast("array<long>")

        def starts(term: str, j: int) -> Column:
            """Where a phrase starts whose token j is the term."""
            return F.transform(F.coalesce(F.col("places")[term], none), lambda p: p - j)

        weights = F.array(*[F.lit(float(w)) for w in self.weights.values()])

        def weight(p: Column) -> Column:
            return F.element_at(weights, (F.shiftright(p, COLUMN_BITS) + 1).cast("int"))

        tf = F.aggregate(reduce(F.array_intersect, [starts(t, j) for j, t in enumerate(phrase)]), F.lit(0.0), lambda s, p: s + weight(p))
        hits = met.select("segment", "range", "offs", "lens", tf.alias("tf")).where("tf > 0")
        item = F.struct("offs", "tf", "lens")
        made = hits.groupBy("segment", "range").agg(F.array_sort(F.collect_list(item)).alias("x"))
        x = F.col("x")
        return durable(made.select(F.lit(k).alias("k"), "segment", "range", x["offs"].alias("offs"), x["tf"].alias("tfs"), x["lens"].alias("lens"), F.size(x).cast("long").alias("n"), F.array_max(x["tf"]).alias("max_tf"), F.array_min(x["lens"]).alias("min_len")))

    def search(self, query: str, limit: int = 20, keep: DataFrame | None = None) -> DataFrame:
        """(id, score) of the best documents that hold all words, by score to six places, then id; keep: ids that may be found."""
        words = X.query_words(query)
        total = sum(r.docs for r in self.manifest)
        if not words or not total:
            return self.docs().limit(0).select("id", F.lit(0.0).alias("score")) if self.manifest else self.spark.createDataFrame([], "id long, score double")
        average = max(sum(r.tokens for r in self.manifest), 1) / total
        lists = self._words(words)
        dead = self.dead()
        live = F.col("n")
        counted = lists
        if dead is not None:
            gone = dead.groupBy("segment", F.shiftright("doc", RANGE_BITS).alias("range")).agg(F.collect_list((F.col("doc") % RANGE).cast("int")).alias("gone"))
            counted = lists.join(gone, ["segment", "range"], "left")
            live = F.col("n") - F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.array_intersect("offs", "gone")))
        n = dict(counted.groupBy("k").agg(F.sum(live)).collect())  # one row for each word
        if len(n) < len(words):
            return self.docs().limit(0).select("id", F.lit(0.0).alias("score"))
        idf = [F.greatest(F.log((F.lit(float(total)) - n[k] + 0.5) / (n[k] + 0.5)), F.lit(IDF_FLOOR)) for k in range(len(words))]

        def worth(tf: Column, length: Column) -> Column:
            """A word's share of the score; it grows with tf and falls with length."""
            return F.element_at(F.array(*idf), F.col("k") + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))

        bounds = lists.groupBy("segment", "range").agg(F.count("*").alias("held"), F.sum(worth(F.col("max_tf"), F.col("min_len"))).alias("bound")).where(F.col("held") == len(words)).drop("held")

        def scored(ranges: DataFrame, named: list | None) -> DataFrame:
            mine = lists.where(F.col("range").isin([r.range for r in named])) if named is not None else lists
            mine = mine.join(F.broadcast(ranges) if named is not None else ranges, ["segment", "range"], "left_semi")  # at most NAMED rows
            rows = mine.select("k", "segment", "range", F.explode(F.arrays_zip("offs", "tfs", "lens")).alias("x")).select("segment", (F.col("range") * RANGE + F.col("x.offs")).alias("doc"), worth(F.col("x.tfs"), F.col("x.lens")).alias("worth"))
            found = rows.groupBy("segment", "doc").agg(F.count("*").alias("held"), F.sum("worth").alias("score")).where(F.col("held") == len(words)).drop("held")
            found = found if dead is None else found.join(dead, ["segment", "doc"], "left_anti")
            if keep is not None:
                found = found.join(self.docs().join(keep, "id", "left_semi"), ["segment", "doc"], "left_semi")
            return found

        def named(rows: list) -> DataFrame:
            return self.spark.createDataFrame([(r.segment, r.range) for r in rows], "segment string, range long")

        score = F.round("score", 6)
        first = bounds.orderBy(F.col("bound").desc()).limit(FIRST).collect()
        if not first:
            return self.docs().limit(0).select("id", F.lit(0.0).alias("score"))
        seen = scored(named(first), first).select(score.alias("score")).orderBy(F.col("score").desc()).limit(limit).collect()
        least = seen[-1].score - 2e-6 if len(seen) == limit else 0.0
        left = bounds.where(F.col("bound") >= least)
        rows = left.limit(NAMED + 1).collect()
        best = scored(named(rows), rows) if len(rows) <= NAMED else scored(left, None)
        # equal scores go by id, so all of the last score are named before the cut
        named_ids = best.join(self.docs().select("segment", "doc", "id"), ["segment", "doc"]) if keep is None else best.join(self.docs().join(keep, "id", "left_semi").select("segment", "doc", "id"), ["segment", "doc"])
        enough = named_ids.where(F.col("score") >= least)
        return enough.select("id", "score").orderBy(score.desc(), "id").limit(limit)
