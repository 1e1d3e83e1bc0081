"""Operator 4, mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
words of the whole corpus; a target stops at ``MAX_COPIES`` times its source's
size and the excess goes to the others by weight. A document's expected copies
are its source's target over its source's size.

The whole part of the expectation is taken at once. The fraction left is rounded
by pivotal sampling on word mass: two documents of a source exchange mass, in a
random direction that keeps either's expectation, until one of them is integral;
the other goes on to the next pair. The mass of a source is kept exactly, so in
the end it misses its target by less than one document, a small one as a rule.

The exchange is a reduction tree: documents are dealt to buckets of about
``FAN_IN`` by a hash (a hot source has as many buckets as it needs), each bucket
is folded in one row by a higher-order function and leaves one residual, and the
residuals of ``FAN_IN`` buckets are folded at the next level until a source has
one. Rows that agree in doc_id, source and text are one item with a count, so no
bucket grows with repeats. All random numbers are hashes, so reruns agree.

Edge cases: null text has size 0; documents of size 0 take no words; a null
source is a source of its own; repeated rows are each reported, their copies
dealt evenly, first to those whose row (in all its columns) has the smallest hash; an empty table gives an empty result; columns besides doc_id, text
and source are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ranking import value_counts_cumulative

from .common import prepare, step, text_hash, words

MAX_COPIES = 3  # a document's copies, and a target over its source's size, at most
SOURCES = 100_000  # named sources that are ordered by one window
_PART = 4096    # equal rows listed at once
_PARTS = 256    # parts of a hot key's rows in numbering
FAN_IN = 256    # items folded in one bucket, about
SEED = 17


def _uniform(*cols: Column | int) -> Column:
    h = F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in cols])
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n, target) from rows of (source, size, m).

    The capped, reshared targets are a water level: all sources get their weight
    times one level or, where that is more, their cap. The level rises from that of
    no capped source: sources it lifts above their cap are capped, and the rest is
    shared again, until none is above. A source's place in the order comes from
    running counts over ranges of the names (beyond ``SOURCES`` of them), and a step
    of the level is an aggregate of two numbers, so that no task sees all sources.
    """
    per = step(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                           F.count(F.lit(1)).alias("n")), "sources")
    place = value_counts_cumulative(per, "source", bound=SOURCES).select("source", F.col("cnt_below").alias("_place"))
    named = per.where("source is not null")
    n_named = named.count()
    placed = named.join(place, "source").unionByName(per.where("source is null").withColumn("_place", F.lit(n_named).cast("long")))
    per = step(placed.withColumn("weight", (F.col("_place") % 3 + 1).cast("double"))
                     .withColumn("cap", F.col("source_size") * float(max_copies)), "weights")
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap") if capped >= 0 else F.lit(False)
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("given"),
                    F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if r["n"] == capped or not r["weight"]:
            break
        level, capped = (r["all"] - r["given"]) / r["weight"], r["n"]
    if r["weight"] == 0:  # every source is at its cap
        return per.select("source", "source_size", "n", F.col("cap").alias("target"))
    return per.select("source", "source_size", "n", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _exchange(acc: Column, x: Column) -> Column:
    """One pivotal step: the pair (acc, x) exchanges mass until one is integral;
    that one is written out, the other is carried."""
    up, down = (1 - acc["p"]) * acc["s"], acc["p"] * acc["s"]
    x_up, x_down = (1 - x["p"]) * x["s"], x["p"] * x["s"]
    more, less = F.least(up, x_down), F.least(down, x_up)
    rise = x["u"] * (more + less) < less
    p = F.when(rise, F.when(up <= x_down, 1.0).otherwise(acc["p"] + more / acc["s"])) \
         .otherwise(F.when(down <= x_up, 0.0).otherwise(acc["p"] - less / acc["s"]))
    q = F.when(rise, F.when(up <= x_down, x["p"] - more / x["s"]).otherwise(0.0)) \
         .otherwise(F.when(down <= x_up, x["p"] + less / x["s"]).otherwise(1.0))
    settled = F.when(rise, up <= x_down).otherwise(down <= x_up)  # acc became integral
    end = lambda v: F.when(v < 1e-12, 0.0).when(v > 1 - 1e-12, 1.0).otherwise(v)
    # Bind the results once, then build the next state from them.
    pair = F.array(F.struct(end(p).alias("p"), end(q).alias("q"), settled.alias("settled")))
    return F.transform(pair, lambda r: F.struct(
        F.when(r["settled"], x["k"]).otherwise(acc["k"]).alias("k"),
        F.when(r["settled"], x["s"]).otherwise(acc["s"]).alias("s"),
        F.when(r["settled"], r["q"]).otherwise(r["p"]).alias("p"),
        F.concat(acc["out"], F.array(F.struct(
            F.when(r["settled"], acc["k"]).otherwise(x["k"]).alias("k"),
            F.when(r["settled"], r["p"]).otherwise(r["q"]).alias("p")))).alias("out")))[0]


def _fold(items: DataFrame, level: int) -> DataFrame:
    """One level of the tree: a bucket's items -> its settled items ``out`` and its residual (k, s, p)."""
    # Largest documents first: the carried one is settled by others like it, so the
    # residual ends up small, and with it the miss of the target.
    x = F.struct((-F.col("s")).alias("o"), "h", "k", "s", "p", _uniform(SEED, level, F.col("k.doc_id"), F.col("k.th")).alias("u"))
    rows = items.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    out_type = "array<struct<k:struct<doc_id:{0},th:bigint>,p:double>>".format(
        items.schema["k"].dataType["doc_id"].dataType.simpleString())
    first = F.col("xs")[0]
    zero = F.struct(first["k"].alias("k"), first["s"].alias("s"), first["p"].alias("p"),
                    F.array().cast(out_type).alias("out"))
    folded = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), zero, _exchange)
    return rows.select("source", "bucket", folded.alias("a")).select("source", "bucket", "a.*")


def decide(docs: DataFrame, max_copies: int = MAX_COPIES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct (doc_id, th, source): m rows of the input, size,
    source_size, target, and copies, the number taken of all m together."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "source",
                       F.size(words(F.col("text"))).cast("long").alias("size"))
    sizes = step(rows.groupBy("doc_id", "th", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    per = step(targets(sizes, max_copies), "targets")  # a row per source
    most = per.agg(F.max("n")).first()[0] or 0

    per = per.withColumnRenamed("source", "_source")
    item = sizes.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    want = F.when(F.col("size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    item = (item.withColumn("want", F.least(want, F.col("m") * float(max_copies)))
                .withColumn("base", F.floor(F.col("want") + 1e-9))
                .withColumn("p", F.greatest(F.col("want") - F.col("base"), F.lit(0.0))))
    h = F.xxhash64(F.lit(SEED), "doc_id", "th")
    open_ = (item.where("p > 1e-9")
                 .select("source", F.struct("doc_id", "th").alias("k"), F.col("size").cast("double").alias("s"), "p",
                         h.alias("h"), F.pmod(h, F.ceil(F.col("n") / fan_in)).alias("bucket")))

    depth, buckets = 1, ceil(most / fan_in)
    while buckets > 1:
        depth, buckets = depth + 1, ceil(buckets / fan_in)
    settled = None
    for level in range(depth):
        done = step(_fold(open_, level), "pivotal")
        out = done.select("source", F.explode("out").alias("o")).select("source", "o.k", "o.p")
        settled = out if settled is None else settled.union(out)
        left = done.select("source", "k", "s", "p", F.xxhash64("k.doc_id", "k.th", F.lit(level)).alias("h"),
                           F.floor(F.col("bucket") / fan_in).alias("bucket"))
        settled = settled.union(left.where("p <= 0 or p >= 1").select("source", "k", "p"))
        open_ = left.where("p > 0 and p < 1")
    # One document of a source may be left: its fraction is drawn.
    last = open_.select("source", "k", (_uniform(SEED, -1, F.col("k.doc_id"), F.col("k.th")) < F.col("p"))
                        .cast("double").alias("p"))
    plus = settled.union(last).where("p >= 1").select(
        F.col("source").alias("_s"), F.col("k.doc_id").alias("_d"), F.col("k.th").alias("_t"))
    same = (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
            & F.col("source").eqNullSafe(F.col("_s")))
    got = item.join(plus, same, "left")
    return got.select("doc_id", "th", "source", "m", "size", "source_size", "target",
                      (F.col("base") + F.col("_t").isNotNull().cast("long")).alias("copies"))


def _of_row(ordinal: Column) -> Column:
    """Copies of the ordinal-th (from 1) of m equal rows: as even as whole numbers allow."""
    return (F.floor(F.col("copies") / F.col("m"))
            + (ordinal <= F.col("copies") % F.col("m")).cast("long")).cast("long")


def mix(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    out = decide(docs.select("doc_id", "text", "source"), max_copies)
    # Many equal rows are listed part by part, by several tasks.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _PART)))
    few = out.where(F.col("m") <= _PART).withColumn("part", F.lit(0).cast("long"))
    many = out.where(F.col("m") > _PART).withColumn("part", part).repartition("doc_id", "th", "part")
    first = F.col("part") * _PART + 1
    out = few.unionByName(many).withColumn("ordinal", F.explode(F.sequence(first, F.least(F.col("m"), first + _PART - 1))))
    out = out.withColumn("copies", _of_row(F.col("ordinal")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with their number ``n`` (from 1) among those of the same key, in the order
    of a hash of the whole row: rows that are equal throughout are as good as each
    other, so reruns take the same. No task sees a whole key: counts by parts of the
    hash and by the partitions that rows were written in make the numbers.
    """
    kept = step(rows.withColumn("_h", F.xxhash64("_row")).withColumn("_part", F.pmod(F.col("_h"), F.lit(_PARTS)))
                    .withColumn("_pid", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "equal-rows")
    cells = kept.groupBy(*key, "_part", "_h", "_pid").agg(F.count(F.lit(1)).alias("c"))
    up = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = cells.groupBy(*key, "_part").agg(F.sum("c").alias("c")).withColumn("_a", F.coalesce(F.sum("c").over(up(key, ["_part"])), none))
    cells = cells.withColumn("_b", F.coalesce(F.sum("c").over(up([*key, "_part"], ["_h", "_pid"])), none)).drop("c")
    local = F.row_number().over(Window.partitionBy(*key, "_part", "_h", "_pid").orderBy("_i"))
    same = lambda a, b, names: reduce(Column.__and__, [a[x].eqNullSafe(b[x]) for x in names])
    kept = kept.withColumn("_l", local)
    out = kept.join(cells, same(kept, cells, [*key, "_part", "_h", "_pid"])).select(*[kept[c] for c in kept.columns], "_b")
    out = out.join(parts, same(out, parts, [*key, "_part"])).select(*[out[c] for c in out.columns], "_a")
    return out.withColumn("n", F.col("_a") + F.col("_b") + F.col("_l")).drop("_h", "_part", "_pid", "_i", "_l", "_a", "_b")


def mixed(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 times: gone)."""
    out = decide(docs.select("doc_id", "text", "source"), max_copies).where("copies > 0")
    out = out.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("source").alias("_s"), "m", "copies")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col("doc_id").alias("doc_id"), text_hash(F.col("text")).alias("th"), "source")
    same = (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
            & F.col("source").eqNullSafe(F.col("_s")))
    got = keyed.join(out, same).select("_row", "_d", "_t", "_s", "m", "copies")
    # Equal rows are told apart by number; only they need one.
    single = got.where("m = 1").select("_row", "copies")
    several = _numbered(got.where("m > 1"), ["_d", "_t", "_s"]).select("_row", _of_row(F.col("n")).alias("copies"))
    both = single.union(several).where("copies > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("_row.*")
