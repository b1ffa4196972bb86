"""Training pairs: valid positives, hard and random negatives, splits, queries with gold."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import miner_normalize, miner_synonyms, text_of
from quillon.operators.retrieve import semantic_candidates
from quillon.sources.rdf import first_rows
from quillon.sources.tables import fixed, with_row_no

PAIR_COLUMNS = ["source_iri", "target_iri", "source_label", "target_label", "source_text", "target_text", "sample_type", "match"]


def valid_alignment(alignment: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs whose two classes exist."""
    return alignment.join(sources.select("source_iri").distinct(), "source_iri", "left_semi").join(
        targets.select("target_iri").distinct(), "target_iri", "left_semi"
    )


def is_bad_hard_negative(label_a: Column, label_b: Column, synonyms_a: Column, synonyms_b: Column) -> Column:
    """Whether two normalised labels may mean the same: one holds the other, with or without spaces; one's words are
    among the other's; or one is a synonym of the other. An empty label is held by every other."""
    holds = lambda x, y: F.contains(x, y) | F.contains(y, x)
    words_a, words_b = (F.filter(F.split(x, " "), lambda w: w != "") for x in (label_a, label_b))
    bare_a, bare_b = (F.replace(x, F.lit(" "), F.lit("")) for x in (label_a, label_b))
    among = (F.size(F.array_except(words_a, words_b)) == 0) | (F.size(F.array_except(words_b, words_a)) == 0)
    no_words = (F.size(words_a) == 0) | (F.size(words_b) == 0)
    after_words = among | holds(bare_a, bare_b) | F.array_contains(synonyms_b, label_a) | F.array_contains(synonyms_a, label_b)
    return holds(label_a, label_b) | (~no_words & after_words)


def sample_order(seed: int, *columns: str) -> list[Column]:
    """An order that is random but the same on every run and in DuckDB: by MD5 of the values."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *[text_of(c) for c in columns])), *map(F.col, columns)]


def first_sampled(rows: DataFrame, num: int, seed: int, *columns: str) -> DataFrame:
    """The num first rows in sample_order, kept in a checkpoint. Whole digits of the MD5 are taken up to the one that holds the last row; only its rows are sorted."""
    if num <= 0:
        return rows.limit(0)
    return _first_of(fixed(rows.withColumn("_md5", sample_order(seed, *columns)[0])), num, *columns)


def _first_of(kept: DataFrame, num: int, *columns: str) -> DataFrame:
    digits = F.substring("_md5", 1, 4)
    upto = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    counts = kept.groupBy(digits.alias("_d")).agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    last = counts.where(F.col("_upto") >= num).orderBy("_d").limit(1).collect()
    if not last:
        return kept.drop("_md5")
    within = kept.where(digits == last[0]["_d"]).orderBy("_md5", *columns).limit(num - last[0]["_upto"] + last[0]["_n"])
    return kept.where(digits < last[0]["_d"]).union(within).drop("_md5")


def hard_negative_pool(sources: DataFrame, targets: DataFrame, alignment: DataFrame, top_n: int = 20, low: float = 0.65, high: float = 0.80) -> DataFrame:
    """(source_iri, target_iri, score): near pairs that aren't aligned and aren't likely to mean the same.

    sources (source_iri, source_label, source_synonyms, embedding) and targets likewise; each source's top_n targets by
    inner product with a score from low to high, both included; classes without a vector have none. Sources are taken in parts as the small side.
    """
    has_vector = F.size("embedding") > 0  # not so for null
    near = semantic_candidates(
        sources.where(has_vector).select(F.col("source_iri").alias("query_id"), "embedding"),
        targets.where(has_vector).select(F.col("target_iri").alias("iri"), "embedding"),
        top_n,
    )
    near = near.where(F.round("score", 9).between(low, high)).select(F.col("query_id").alias("source_iri"), F.col("iri").alias("target_iri"), "score")
    near = near.join(alignment.select("source_iri", "target_iri").distinct(), ["source_iri", "target_iri"], "left_anti")
    side = lambda df, p: df.select(
        f"{p}_iri", miner_normalize(f"{p}_label").alias(f"{p}_l"), miner_synonyms(f"{p}_synonyms").alias(f"{p}_s")
    )
    both = near.join(side(sources, "source"), "source_iri").join(side(targets, "target"), "target_iri")
    bad = is_bad_hard_negative(F.col("source_l"), F.col("target_l"), F.col("source_s"), F.col("target_s"))
    return both.where(~bad).select("source_iri", "target_iri", "score")


def hard_negatives(sources: DataFrame, targets: DataFrame, alignment: DataFrame, num: int = 100, top_n: int = 20, seed: int = 42) -> DataFrame:
    """(source_iri, target_iri, sample_type, match): at most num of the pool, by a fixed random order."""
    pool = hard_negative_pool(sources, targets, alignment, top_n)
    picked = first_sampled(pool.select("source_iri", "target_iri").distinct(), num, seed, "source_iri", "target_iri")
    return picked.select("source_iri", "target_iri", F.lit("hard_negative").alias("sample_type"), F.lit(0).alias("match"))


def _step(n: int) -> int:
    """A number coprime to n, near n over the golden ratio: its multiples mod n run through all of 0..n-1, widely spread."""
    step = max(1, int(n * 0.6180339887498949))
    while gcd(step, n) != 1:
        step += 1
    return step


def random_negatives(sources: DataFrame, targets: DataFrame, taken: DataFrame, num: int = 100, seed: int = 42, spread: int = 4, n_taken: int | None = None) -> DataFrame:
    """num random pairs not in `taken`, each once; all there are, where there are fewer.

    Sources and targets are numbered by MD5, pairs by both; the first draws of a walk through all pairs by a fixed
    step, each of which meets another pair, are spread * num and as many as `taken` has (n_taken, if that is known), so that
    num are left at least. One rule for all sizes; no more pairs are made than drawn. Of the draws, those of the least MD5 are
    compared with `taken`: as many as should do, or all if they don't.
    """
    spark = sources.sparkSession
    s, t = sources.select("source_iri").distinct(), targets.select("target_iri").distinct()
    n_s, n_t = s.count(), t.count()
    done = taken.select("source_iri", "target_iri")
    n_done = done.distinct().count() if n_taken is None else n_taken
    draws = min(n_s * n_t, max(1, spread) * max(0, num) + n_done) if num > 0 else 0
    step, big = _step(max(1, n_s * n_t)), "decimal(38,0)"
    place = (F.col("id").cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)")).cast(big) % F.lit(max(1, n_s * n_t)).cast(big)
    drawn = spark.range(draws).select(place.cast("long").alias("p"))
    drawn = drawn.select(F.expr(f"p div {max(1, n_t)}L").alias("i"), (F.col("p") % F.lit(max(1, n_t))).alias("j"))
    numbered = lambda df, c, k: with_row_no(df.withColumn("_md5", sample_order(seed, c)[0]), "_md5", c).select(c, F.col("row_no").alias(k))
    pool = drawn.join(numbered(s, "source_iri", "i"), "i").join(numbered(t, "target_iri", "j"), "j").select("source_iri", "target_iri")
    md5 = sample_order(seed, "source_iri", "target_iri")[0]

    def left(share: float) -> DataFrame:
        least = lambda df: df.withColumn("_md5", md5).where(F.col("_md5") < f"{int(share * 16**8):08x}" if share < 1 else F.lit(True))
        return fixed(least(pool).join(least(done).drop("_md5"), ["source_iri", "target_iri"], "left_anti"))

    # left are draws - n_done at least, so that this share of them has num but for a chance of 1e-23
    share = (num + 10 * num**0.5 + 100) / (draws - n_done) if draws > n_done else 1.0
    kept = left(share)
    if share < 1 and kept.count() < num:
        kept = left(1.0)
    picked = _first_of(kept, num, "source_iri", "target_iri") if num > 0 else kept.drop("_md5")
    return picked.select("source_iri", "target_iri", F.lit("random_negative").alias("sample_type"), F.lit(0).alias("match"))


def with_texts(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Training pairs of (source_iri, target_iri, sample_type, match); a class without a row has null texts.

    Pairs are dealt in as many parts as shuffles have: they pack so well that parts merged by their bytes would sort too many rows in a task.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pairs.repartition(parts, "source_iri")
        .join(sources.select("source_iri", "source_label", "source_text"), "source_iri", "left")
        .repartition(parts, "target_iri")
        .join(targets.select("target_iri", "target_label", "target_text"), "target_iri", "left")
        .withColumn("match", F.col("match").cast("double"))
        .select(*PAIR_COLUMNS)
    )


def training_dataset(sources: DataFrame, targets: DataFrame, alignment: DataFrame, seed: int = 42) -> DataFrame:
    """Valid positives with half as many hard negatives and half as many random ones."""
    valid = fixed(valid_alignment(alignment, sources, targets).select("source_iri", "target_iri"))
    n = valid.count()
    hard = hard_negatives(sources, targets, valid, n // 2, seed=seed)  # kept in a checkpoint, as valid is
    samples = valid.select("*", F.lit("positive").alias("sample_type"), F.lit(1).alias("match")).union(hard)
    return with_texts(samples.union(random_negatives(sources, targets, samples, n // 2, seed)), sources, targets)


def stratified_split(pairs: DataFrame, ratios: tuple[float, float, float] = (0.75, 0.15, 0.10), seed: int = 42, by: str = "match", keys: tuple[str, ...] = ("source_iri", "target_iri"), group: str | None = None) -> DataFrame:
    """Rows with `split`: train, val or test, in exact shares of each stratum.

    Ratios must be positive and add up to 1. With `group`, rows of a group go to one split (shares are then of groups).
    """
    if min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"split ratios must be positive and add up to 1: {ratios}")
    train, val, test = ratios
    if group:
        units = pairs.groupBy(group).agg(F.max(by).alias(by))
        return pairs.join(stratified_split(units, ratios, seed, by, (group,)).select(group, "split"), group)
    # A stratum's order is cut at two places. Its rows are dealt by the first digits of their MD5, so that no task has
    # all of them: a row's place is the rows of the stratum's earlier digits and its own among its digits'.
    md5, *rest = sample_order(seed, *keys)
    rows = pairs.withColumns({"_stratum": F.col(by), "_md5": md5}).withColumn("_digits", F.substring("_md5", 1, 3))
    counts = rows.groupBy("_stratum", "_digits").agg(F.count("*").alias("_rows"))
    stratum = Window.partitionBy("_stratum")
    before = F.sum("_rows").over(stratum.orderBy("_digits")) - F.col("_rows")
    counts = counts.select(F.col("_stratum").alias("_s"), F.col("_digits").alias("_d"), before.alias("_before"), F.sum("_rows").over(stratum).alias("_n"))
    within = F.row_number().over(Window.partitionBy("_stratum", "_digits").orderBy("_md5", *rest))
    same = F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_digits") == F.col("_d"))
    placed = rows.withColumn("_within", within).join(counts, same)
    place, n = F.col("_before") + F.col("_within"), F.col("_n")
    n_test = F.ceil(n * F.lit(test) - 1e-9)
    n_val = F.ceil((n - n_test) * F.lit(val / (train + val)) - 1e-9)
    split = F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train")
    return placed.select(*[rows[c] for c in pairs.columns], split.alias("split"))


def model_pairs(pairs: DataFrame) -> DataFrame:
    """source_text, target_text, label for a model."""
    return pairs.select("source_text", "target_text", F.col("match").cast("float").alias("label"))


def queries_with_gold(test: DataFrame, order: str | None = None) -> DataFrame:
    """(source_iri, source_label, source_text, gold_target_iris) of sources with a positive; ValueError if there are none.

    Of a source's rows the first gives the texts; gold is its positive targets, each once, in order.
    """
    order = order or "target_iri"
    positives = test.where(F.col("match") == 1)
    if positives.isEmpty():
        raise ValueError("no source has a positive pair")
    kept = test.join(positives.select("source_iri").distinct(), "source_iri", "left_semi")
    queries = first_rows(kept.select("source_iri", "source_label", "source_text", F.col(order).alias("_o")), "source_iri", "_o").drop("_o")
    gold = positives.groupBy("source_iri").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("target_iri").alias("t")))), lambda x: x["t"])).alias("gold")
    )
    empty = F.expr("cast(array() as array<string>)")
    return queries.join(gold, "source_iri", "left").select("source_iri", "source_label", "source_text", F.coalesce("gold", empty).alias("gold_target_iris"))


def save_splits(split: DataFrame, folder: str, mode: str = "error") -> None:
    """train, val, test, test_queries and test_gold as Parquet folders."""
    for name in ("train", "val", "test"):
        split.where(F.col("split") == name).drop("split").write.mode(mode).parquet(f"{folder}/{name}")
    made = queries_with_gold(split.where("split = 'test'"))
    made.drop("gold_target_iris").write.mode(mode).parquet(f"{folder}/test_queries")
    made.select("source_iri", "gold_target_iris").write.mode(mode).parquet(f"{folder}/test_gold")
