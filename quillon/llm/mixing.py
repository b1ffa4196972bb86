"""Mixing sources to target weights by weighted sampling with exponential keys.

DataFrame operations only. Every document gets the key -ln(u) / w: u is a fixed hash of its id in (0, 1), w its
quality weight, so that taking documents in ascending key order is weighted sampling without replacement. A
source whose target is several times its size gives whole epochs first; the rest of its target is filled by a prefix in key
order. Only the stretch of keys where the budget runs out needs an order: it is found by histograms of the keys,
256 buckets a round, until it holds `boundary_rows` documents at most. No source is ever sorted as a whole; the table of
sources, a row for each, is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.scratch import forget, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class MixConfig:
    """weights: given to the sources by turns in code point order; cap: the most epochs of a source."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    cap: float = 3.0
    seed: int = 17
    boundary_rows: int = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight from 0.25 to 1 that falls with the share of markup symbols in the text."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(20.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def keyed(docs: DataFrame, size: Column, weight: Column, config: MixConfig, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows with the columns mix_size, mix_source (never null) and mix_key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(config.seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return docs.withColumns(
        {
            "mix_size": size,
            "mix_source": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("z")),
            "mix_key": -F.log(u) / weight,
            "mix_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        }
    )


def _targets(slim: DataFrame, config: MixConfig) -> DataFrame:
    """mix_source, source_size, target: shares by weight, none above cap times its source, the excess shared on."""
    sources = slim.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("mix_source")) - 1) % len(config.weights)
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in config.weights]), turn + 1))
    sources = sources.withColumn("most", F.lit(config.cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    rising = Window.orderBy("ratio", "mix_source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(rising), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(rising), F.lit(0.0))
    )
    sources = sources.withColumn("level", level)
    first_free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    return sources.select(
        "mix_source", "source_size", F.least(F.col("most"), F.coalesce(first_free["level"], F.lit(0.0)) * F.col("w")).alias("target")
    )


def _small(table: DataFrame) -> DataFrame:
    """The table of sources, marked for broadcast if it is counted to be small; else joins shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


_POS = "struct<mix_key:double,mix_id:string,mix_size:bigint>"
_SPANS = f"array<struct<lo:{_POS},hi:{_POS},bound:double>>"


def _pos() -> Column:
    return F.struct("mix_key", "mix_id", "mix_size")


def _walk(state: Column, at: Column) -> Column:
    """One step of the walk in key order; at holds a place and the rows that share it."""
    size, total, left = at["pos"]["mix_size"], at["words"], state["left"]
    rest = left - total
    closed = F.concat(state["spans"], F.array(F.struct(state["lo"].alias("lo"), at["pos"].alias("hi"), state["bound"].alias("bound"))))

    def then(left: Column, bound: Column, lo: Column, spans: Column, last: Column, done: bool) -> Column:
        return F.struct(left.alias("left"), bound.alias("bound"), lo.alias("lo"), spans.alias("spans"), last.alias("last"), F.lit(done).alias("done"))

    return (
        F.when(state["done"] | (size >= state["bound"]), state)
        .when(rest > 0, then(rest, state["bound"], state["lo"], state["spans"], state["last"], False))
        .when(rest > -left, then(rest, state["bound"], state["lo"], closed, at["pos"], True))
        .otherwise(then(left, 2 * left, at["pos"], closed, state["last"], False))
    )


def plan_mix(slim: DataFrame, config: MixConfig) -> DataFrame:
    """A row for each source: source_size, target, epochs, spans, last. A written table.

    slim: mix_id, mix_size, mix_source, mix_key of all documents. It is read once a round: write it first.

    What whole epochs leave of a target is filled in key order: documents are taken up to the first that doesn't fit. That one
    is taken, as the last, if the source then ends nearer to its target; else it is passed over, and so are all further ones of its
    kind, at least twice as large as what is left: the prefix goes on with the others. spans (lo, hi, bound) say what is
    taken: documents between lo and hi, both excluded, of sizes below bound; last is taken too. The rule is the same
    for every number of documents: histograms find the stretch of keys in which a prefix ends, and `boundary_rows` only
    says from where on that stretch is walked as a list.
    """
    none = F.expr(f"cast(array() as {_SPANS})")
    start = F.expr(f"cast(struct(-1.0D, '', -1L) as {_POS})")
    state = _targets(slim, config).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    state = state.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumns(
        {
            "bound": 2 * F.col("left"),
            "lo": start,
            "at": start,
            "upto": F.lit(float("inf")),
            "n": F.lit(0).cast("long"),
            "spans": none,
            "last": F.expr(f"cast(null as {_POS})"),
            "done": F.col("left") <= 0,
        }
    )
    columns = state.columns
    state = written(state, "mix-sources")
    place = lambda c: F.exp(-F.greatest(c, F.lit(0.0)))
    while True:
        open_ = state.where("not done")
        if open_.isEmpty():
            return state.select("mix_source", "source_size", "target", "epochs", "spans", "last")
        inside = slim.join(_small(open_.select("mix_source", "left", "bound", "at", "upto")), "mix_source")
        inside = inside.where((_pos() > F.col("at")) & (F.col("mix_key") <= F.col("upto")) & (F.col("mix_size") < F.col("bound")))
        first, last = place(F.col("at.mix_key")), place(F.col("upto"))
        share = F.coalesce((first - place(F.col("mix_key"))) / F.nullif(first - last, F.lit(0.0)), F.lit(0.0))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).alias("bucket")
        hist = inside.groupBy("mix_source", bucket).agg(
            F.sum("mix_size").alias("words"), F.min("mix_key").alias("from"), F.max("mix_key").alias("to"), F.count("*").alias("n"), F.first("left").alias("left")
        )
        hist = hist.withColumn("before", F.sum("words").over(Window.partitionBy("mix_source").orderBy("bucket")) - F.col("words"))
        cut = hist.where("before + words >= left").groupBy("mix_source").agg(F.min(F.struct("bucket", "before", "from", "to", "n")).alias("cut"))
        found = F.col("cut").isNotNull()
        open_span = F.struct("lo", F.expr(f"cast(null as {_POS})").alias("hi"), "bound")
        moved = {
            "left": F.col("left") - F.coalesce("cut.before", F.lit(0)),
            "at": F.when(found, F.struct(F.col("cut.from").alias("mix_key"), F.lit("").alias("mix_id"), F.lit(-1).cast("long").alias("mix_size"))).otherwise(F.col("at")),
            "upto": F.coalesce("cut.to", "upto"),
            "n": F.when(F.col("cut.from") < F.col("cut.to"), F.col("cut.n")).otherwise(0),
            "spans": F.when(found | F.col("done"), F.col("spans")).otherwise(F.concat("spans", F.array(open_span))),
            "done": F.col("done") | ~found,
        }
        older, state = state, written(state.join(cut, "mix_source", "left").select(*[moved.get(c, F.col(c)).alias(c) for c in columns]), "mix-sources")
        forget(older)
        if (state.where("not done").agg(F.max("n")).first()[0] or 0) > config.boundary_rows:
            continue
        inside = slim.join(_small(state.where("not done").select("mix_source", "bound", "at", "upto")), "mix_source")
        inside = inside.where((_pos() > F.col("at")) & (F.col("mix_key") <= F.col("upto")) & (F.col("mix_size") < F.col("bound")))
        edge = inside.groupBy("mix_source", _pos().alias("pos")).agg(F.sum("mix_size").alias("words"))
        listed = edge.groupBy("mix_source").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("edge"))
        walked = F.aggregate("edge", F.struct("left", "bound", "lo", "spans", "last", "done"), _walk)
        moved = {c: F.when(F.col("edge").isNull(), F.col(c)).otherwise(F.col(f"walked.{c}")) for c in ("left", "bound", "lo", "spans", "last", "done")}
        moved |= {"at": F.when(F.col("edge").isNull(), F.col("at")).otherwise(F.element_at("edge", -1)["pos"]), "upto": F.lit(float("inf"))}
        both = state.join(listed, "mix_source", "left").withColumn("walked", walked)
        older, state = state, written(both.select(*[moved.get(c, F.col(c)).alias(c) for c in columns]), "mix-sources")
        forget(older)


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The keyed rows with source_size, target, copies (times that the mix takes the row)."""
    within = lambda s: (_pos() > s["lo"]) & (s["hi"].isNull() | (_pos() < s["hi"])) & (F.col("mix_size") < s["bound"])
    extra = F.exists("spans", within) | (F.col("last").isNotNull() & (_pos() == F.col("last")))
    return rows.join(_small(plan), "mix_source").withColumn("copies", F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long")).drop("spans", "last")


def mix_sources(docs: DataFrame, config: MixConfig = MixConfig(), text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of `docs`.

    size counts the words of the text, 0 for null and empty texts. All sources share the sum of all sizes by
    `config.weights`; null is a source of its own, the last. taken = copies * size. A source's taken words end as near
    to its target as plan_mix says; a source without words gives nothing. Rows that tie in key, id and size
    are taken together. Copies of a row are config.cap at most, of empty texts too. Without rows the result is empty. Ids may be null.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = keyed(docs, word_count(F.col("text")), quality_weight(F.col("text")), config)
    slim = written(rows.select("doc_id", "mix_id", "mix_size", "mix_source", "mix_key"), "mix-keys")
    return apply_mix(slim, written(plan_mix(slim, config), "mix-plan")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("copies") * F.col("mix_size")).alias("taken"),
        F.col("copies"),
    )


def mixed_rows(docs: DataFrame, config: MixConfig = MixConfig(), text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it."""
    whole = docs.select(F.struct("*").alias("mix_row"))
    text = F.col(f"mix_row.{text_col}")
    rows = keyed(whole, word_count(text), quality_weight(text), config, f"mix_row.{id_col}", f"mix_row.{source_col}")
    slim = written(rows.select("mix_id", "mix_size", "mix_source", "mix_key"), "mix-keys")
    plan = written(plan_mix(slim, config), "mix-plan")
    taken = apply_mix(rows, plan).where("copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("mix_row.*")
