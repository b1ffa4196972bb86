"""Near-duplicate documents: MinHash buckets propose, full shingle sets confirm, components decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import minhash, vec
from quillon.llm.components import components
from quillon.llm.membership import marked
from quillon.llm.scratch import forget, written

U64 = np.uint64
_SIGNED = "id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"
_SKETCH = 12
_SETS = "d1 long, d2 long, content array<long>"


def _lists(values: np.ndarray, bounds: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)), mask=None if keep is None else pa.array(~keep)
    )


def _signed(shingle: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, values, bounds in vec.shingle_sets(batch.column(1), shingle):
                n = np.diff(bounds)
                keys = minhash.band_keys(minhash.signatures(values, bounds, bins), rows)
                d1, d2 = minhash.set_digests(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(n),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        _lists(keys.reshape(-1), np.arange(end - row + 1) * keys.shape[1], n > 0),
                        _lists(minhash.parities(values, bounds, _SKETCH), np.arange(end - row + 1) * _SKETCH),
                    ],
                    ["id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _row, _end, values, bounds in vec.shingle_sets(batch.column(1), shingle):
                d1, d2 = minhash.set_digests(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _lists(values, bounds)],
                    ["d1", "d2", "content"],
                )

    return run


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, d1, d2, n) of each class in each of its buckets that holds another class."""
    rows = classes.select(F.explode("bands").alias("key"), "rep", "d1", "d2", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    return rows.join(shared, "key")


def _stars(shared: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(edges, rest): each bucket's members linked to two hubs of the bucket, its least document and its smallest set, and
    the members that are no hub of their bucket."""
    rows = shared.select("key", F.struct("rep", "d1", "d2", "n").alias("me"), F.struct("n", "rep", "d1", "d2").alias("by_n"))
    hubs = rows.groupBy("key").agg(F.min("me").alias("hub"), F.min("by_n").alias("small"))
    hubs = hubs.select("key", "hub", F.expr("named_struct('rep', small.rep, 'd1', small.d1, 'd2', small.d2, 'n', small.n)").alias("small"))
    both = rows.join(hubs, "key")
    linked = both.select("me", F.explode(F.array("hub", "small")).alias("hub"))
    edges = linked.where((F.col("me.d1") != F.col("hub.d1")) | (F.col("me.d2") != F.col("hub.d2"))).where(sizes_allow(num, den)).distinct()
    return edges, both.where("me <> hub and me <> small").select("key", "me.*")


def sizes_allow(num: int, den: int) -> Column:
    """Whether the sizes of the sets of me and hub leave room for a link."""
    return F.lit(den) * F.least("me.n", "hub.n") >= F.lit(num) * F.greatest("me.n", "hub.n")


def sketches_allow(num: int, den: int, words: int = _SKETCH) -> Column:
    """Whether the parities of the sets of me and hub leave room for a link: each bit that differs stands for an element of one set only."""
    apart = sum(F.bit_count(F.col("me.sketch")[i].bitwiseXOR(F.col("hub.sketch")[i])) for i in range(words))
    return F.lit(den + num) * apart <= F.lit(den - num) * (F.col("me.n") + F.col("hub.n"))


def bucket_components(
    links: DataFrame,
    rest: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    sketches: DataFrame | None = None,
    possible: Column | None = None,
    first: int = 8,
) -> DataFrame:
    """(node, component) of all links between members of a bucket, given those (a, b) of one or two hubs of each.

    `rest` (key, rep, d1, d2, and n if `sketches` lacks it) are the members of buckets that were no hub yet. Buckets whose rest is in several
    components get further hubs, by hash, which are compared with each member in another component than theirs and then
    leave the bucket: `first` hubs or so in the first round, and eight times as many in each further one, until each
    bucket's rest is one component. A pair of a bucket is so left out only if it is in one component already, or if
    `possible` (of me and hub, with the `sketches` of their d1, d2) says that it can't be similar.
    """
    labels, hubs, held = components(links), first, rest
    while True:
        known = rest.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        apart = known.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        rest = known.join(apart.where("c0 < c1").select("key", "members"), "key")
        if sketches is not None and "sketch" not in rest.columns:
            rest = rest.join(sketches, ["d1", "d2"])
        rest = written(rest.withColumn("is_hub", F.pmod(F.xxhash64("rep"), F.col("members")) < hubs).drop("members"), "apart")
        forget(held)
        held = rest
        if rest.isEmpty():
            forget(held)
            return labels
        point = [c for c in rest.columns if c not in ("key", "component", "is_hub")]
        me = rest.select("key", F.struct(*point).alias("me"), F.col("component").alias("mine"), F.col("is_hub").alias("both"))
        hub = rest.where("is_hub").select("key", F.struct(*point).alias("hub"), F.col("component").alias("theirs"))
        pairs = me.join(hub, "key").where("mine <> theirs and (not both or me.rep < hub.rep)")
        pairs = pairs if possible is None else pairs.where(possible)
        edges = written(pairs.select(*[F.struct(*[f"{c}.{x}" for x in ("rep", "d1", "d2", "n")]).alias(c) for c in ("me", "hub")]).distinct(), "further-edges")
        if not edges.isEmpty():
            older, found = labels, confirm(edges)
            labels = components(older.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
            forget(older, found)
        forget(edges)
        rest, hubs = rest.where("not is_hub").drop("component", "is_hub"), 8 * hubs


def similar_sets(num: int, den: int):
    """Whether two arrays of distinct values meet den * |intersection| >= num * |union|."""

    def test(mine: Column, theirs: Column) -> Column:
        shared = F.size(F.array_intersect(mine, theirs)).cast("long")
        return F.lit(den) * shared >= F.lit(num) * (F.size(mine) + F.size(theirs) - shared)

    return test


def confirmed(edges: DataFrame, contents: DataFrame, similar: Callable[[Column, Column], Column], spread: int = 128) -> DataFrame:
    """Edges (me, hub) whose contents (d1, d2, content) are similar, as a written table (a, b) of their reps.

    A hub's content is copied once for each `spread` members rather than brought to every one of them, and a
    hub with many members is dealt over as many tasks.
    """
    # Written, so that the join below has a plain exchange on either side, which adaptive execution splits if it is skewed.
    degree = written(edges.groupBy(F.col("hub.d1").alias("h1"), F.col("hub.d2").alias("h2")).agg(F.count("*").alias("degree")), "hubs")
    salted = (
        edges.select("me", "hub", F.col("hub.d1").alias("h1"), F.col("hub.d2").alias("h2"))
        .join(degree, ["h1", "h2"])
        .withColumn("salt", F.expr(f"pmod(me.d1, ceil(degree / {spread}))"))
    )
    hubs = (
        degree.withColumn("salt", F.explode(F.expr(f"sequence(0L, ceil(degree / {spread}) - 1)")))
        .join(contents.withColumnsRenamed({"d1": "h1", "d2": "h2", "content": "theirs"}), ["h1", "h2"])
        .select("h1", "h2", "salt", "theirs")
    )
    mine = salted.withColumns({"d1": F.col("me.d1"), "d2": F.col("me.d2")}).join(contents, ["d1", "d2"])
    both = mine.join(hubs, ["h1", "h2", "salt"])
    links = written(both.where(similar(F.col("content"), F.col("theirs"))).select(F.col("me.rep").alias("a"), F.col("hub.rep").alias("b")), "links")
    forget(degree)
    return links


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    bins: int = 192,
    rows: int = 6,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, d1, d2, stays) of each row of `docs`.

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of `shingle`-word shingles,
    lower-cased in A-Z. Documents with equal sets form one class from the start; the classes' MinHash
    signatures of `bins` bins give bins / rows buckets each, buckets give star-shaped candidate edges (a
    member and its hub), and each edge is confirmed on the full sets. Buckets that this leaves in several components
    get further hubs, until each pair of a bucket is in one component or was compared. component_id is the
    least id reachable over confirmed links, kept says that it is the row's own id. d1, d2 are digests of the set;
    stays holds for rows of one class of each component alone, that of its least id (of an id's several texts the one
    of the least digests).

    Null texts, empty texts and texts of separators alone have no shingles and are linked with nothing; a text
    of fewer words than `shingle` has one, its whole sequence. Rows that repeat an id and
    a text are one document; an id with several texts has a component for each. Rows with a null id keep a null
    component, are kept and stay. Without rows the result is empty. Other columns are not read.
    """
    name = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(name.mapInArrow(_signed(shingle, bins, rows), _SIGNED), "minhash")
    classes = (
        signed.where("n_shingles > 0 and id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    # A class is named by its least id. Where an id stands for several classes, each has a name of its own.
    many = written(repeated_ids(signed), "repeated-ids")
    named = classes.join(many.withColumnRenamed("id", "rep"), "rep", "left").withColumns(
        {"least": F.col("rep"), "rep": F.when(F.col("times").isNull(), F.col("rep")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("rep", "d1", "d2"), 1))}
    )
    classes = written(named.drop("times"), "classes")
    renamed = classes.where("least <> rep").select("rep", "least")
    buckets = written(_shared_buckets(classes), "buckets")
    edges, rest = _stars(buckets, num, den)

    def confirm(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.explode(F.array("me.rep", "hub.rep")).alias("rep")).distinct()
        involved = written(ends.join(renamed, "rep", "left").select(F.coalesce("least", "rep").alias("id")).distinct(), "involved")
        # Sets of rows let in by chance meet no edge.
        sets = marked(name, involved).where("_among").select("id", "text").mapInArrow(_full_sets(shingle), _SETS).dropDuplicates(["d1", "d2"])
        sets = written(sets, "sets")
        links = confirmed(edges, sets, similar_sets(num, den))
        forget(involved, sets)
        return links

    possible = sizes_allow(num, den) & sketches_allow(num, den)
    edges = written(edges, "edges")
    links = confirm(edges)
    forget(edges)
    labels = bucket_components(links, rest, confirm, classes.select("d1", "d2", "sketch"), possible)
    linked = classes.select("d1", "d2", "rep", "least").join(labels.withColumnRenamed("node", "rep"), "rep")
    first = linked.groupBy("component").agg(F.min(F.struct("least", "d1", "d2")).alias("first"))
    member = written(linked.join(first, "component").select("d1", "d2", F.col("first.least").alias("component"), ((F.col("first.d1") == F.col("d1")) & (F.col("first.d2") == F.col("d2"))).alias("leads")), "members")
    least = written(classes.select("d1", "d2", "least"), "least")
    forget(links, labels, buckets, classes, many)
    of_class = least.join(member, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component", "least").alias("component"), F.coalesce("leads", F.lit(True)).alias("leads"))
    some = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    return (
        signed.select("id", "n_shingles", "d1", "d2")
        .join(of_class, ["d1", "d2"], "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.when(some, F.col("component")).otherwise(F.col("id")).alias("component_id"),
            "d1",
            "d2",
            F.coalesce(F.col("leads"), F.lit(True)).alias("leads"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .withColumn("stays", F.col("kept") & (F.col("leads") | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()))
        .drop("leads")
    )


def repeated_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, times) of the ids of more than one row."""
    return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("times")).where("times > 1")


def set_digest(shingle: int = 5):
    """The digests d1, d2 of a text's set of shingles, as near_duplicates gives them."""

    @F.arrow_udf("struct<d1:long,d2:long>")
    def digest(text: pa.Array) -> pa.Array:
        d1, d2 = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for _row, _end, values, bounds in vec.shingle_sets(text, shingle):
            both = minhash.set_digests(values, bounds)
            d1.append(both[0]), d2.append(both[1])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(d).view(np.int64)) for d in (d1, d2)], ["d1", "d2"])

    return digest


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, **options) -> DataFrame:
    """The rows of `docs`, all columns, one of each group of near duplicates (options are those of near_duplicates).

    The row that stays is that of the component's least id. Rows that repeat an id and a set of shingles are one
    document, and one of them stays: the least by its other columns. Of an id with several texts each is judged
    for itself. Texts without a word are like nothing, but rows that repeat an id without a word are one document too. Rows with a null id all
    stay. Only rows whose id has a row that goes, or has several rows, and the few that a bit table can't tell from
    them, are exchanged with their texts.
    """
    found = written(near_duplicates(docs, id_col, text_col, shingle, **options).select(F.col("doc_id").alias("id"), "d1", "d2", "stays"), "decided")
    gone = written(found.where("not stays").select("id", "d1", "d2").distinct(), "gone")
    many = written(repeated_ids(found), "many")
    forget(found)
    touched = written(gone.select("id").union(many.select("id")).distinct(), "touched")
    wrapped = marked(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id")), touched)
    clear = wrapped.where("not _among").select("row.*")
    whole = wrapped.where("_among").select("row", "id", set_digest(shingle)(F.col(f"row.{text_col}").cast("string")).alias("set"))
    whole = whole.select("row", "id", "set.d1", "set.d2").join(gone, ["id", "d1", "d2"], "left_anti")
    out = clear.union(whole.join(many, "id", "left_anti").select("row.*"))
    if many.isEmpty():
        return out
    # Rows equal in all that is compared are the same row, so that any order of them gives the same result.
    once = whole.join(many, "id", "left_semi").groupBy("id", "d1", "d2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.union(once.select("row.*"))
