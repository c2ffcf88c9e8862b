"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target/source_size times. The whole part
is given to each; the fractional parts are rounded together: documents of a
source are dealt into small leaves by hash, and within a leaf two fractional
documents at a time trade mass (weighted by size, so that the expected words of
the source stay the same) at random until one is integral. What a leaf leaves
over is one fractional document, and these residuals are combined in a
reduction tree of the same step, FAN leaves a node, up to one a source, which
goes to the nearer whole number.

Targets share 100 % of all words by the weights 5, 2, 1, repeating, over the
sources by code point (null last); a target stops at MAX_REPEATS times its
source's size and the excess is shared again by weight until none is above.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source
is a source of its own; rows that repeat doc_id, text and source are one unit
of a higher count, whose copies are dealt evenly over the rows, so no leaf
grows with them; an empty table gives an empty result. Random numbers are keyed
hashes, so reruns agree. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, cut, unit

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEAF = 32
FAN = 32
SEED = 17
#: More sources than this are joined by a salted shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 32


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text without building them twice."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, SPACES)
    return F.size(F.filter(parts, lambda w: w != "")).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """One row a unit: doc_id, text hash, source, size and ``m``, the rows it stands for."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "source", word_count(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "th", "source", "size").agg(F.count(F.lit(1)).alias("m"))


def targets(units: DataFrame) -> DataFrame:
    """One row a source: source_size, units and target.

    The windows here run over sources, not documents: one row for each source
    after a partial aggregation.
    """
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS)))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(MAX_REPEATS))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)).withColumn("k", F.row_number().over(by_room))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("target", F.least(F.col("cap"), level * F.col("w"))).select("source", "source_size", "n_units", "target")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pivot(acc: Column, x: Column) -> Column:
    """One step: the open document and the next trade mass until one is integral."""
    o = acc["open"]
    ratio = x["weight"] / o["weight"]  # of x's share to the open one's
    up = F.least(1 - o["p"], x["p"] * ratio)  # the open one rises, x falls
    down = F.least(o["p"], (1 - x["p"]) * ratio)  # and the other way
    moved = F.struct(up.alias("up"), down.alias("down"), ratio.alias("ratio"), unit(o["doc_id"], o["th"], x["doc_id"], x["th"], seed=SEED).alias("u"))

    def trade(v: Column) -> Column:
        rises = v["u"] * (v["up"] + v["down"]) < v["down"]
        fills, drains = 1 - o["p"] <= x["p"] * v["ratio"], o["p"] <= (1 - x["p"]) * v["ratio"]
        po = F.when(rises, F.when(fills, F.lit(1.0)).otherwise(o["p"] + v["up"])).otherwise(F.when(drains, F.lit(0.0)).otherwise(o["p"] - v["down"]))
        px = F.when(rises, F.when(fills, x["p"] - v["up"] / v["ratio"]).otherwise(F.lit(0.0))).otherwise(F.when(drains, x["p"] + v["down"] / v["ratio"]).otherwise(F.lit(1.0)))
        whole = F.when(rises, fills).otherwise(drains)  # the open one is the integral one
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), po)).alias("po"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), px)).alias("px"), whole.alias("whole"))

    item = lambda i, p: F.struct(i["doc_id"].alias("doc_id"), i["th"].alias("th"), i["size"].alias("size"), i["m"].alias("m"), i["base"].alias("base"), i["weight"].alias("weight"), p.alias("p"))

    def settle(t: Column) -> Column:
        done, left = F.when(t["whole"], item(o, t["po"])).otherwise(item(x, t["px"])), F.when(t["whole"], item(x, t["px"])).otherwise(item(o, t["po"]))
        return F.struct(left.alias("open"), F.concat(acc["done"], F.array(done)).alias("done"))

    first = F.struct(item(x, x["p"]).alias("open"), acc["done"].alias("done"))
    integral = F.struct(o.alias("open"), F.concat(acc["done"], F.array(item(x, x["p"]))).alias("done"))
    traded = _let(_let(moved, trade), settle)
    swapped = F.struct(item(x, x["p"]).alias("open"), F.concat(acc["done"], F.array(o)).alias("done"))
    return F.when(o.isNull(), first).when((x["p"] <= 0) | (x["p"] >= 1), integral).when((o["p"] <= 0) | (o["p"] >= 1), swapped).otherwise(traded)


ITEM = "struct<doc_id:bigint,th:bigint,size:bigint,m:bigint,base:bigint,weight:double,p:double>"


def _node(items: DataFrame) -> DataFrame:
    """Settle all items of a (source, node): ``done`` items and one ``open`` residual.

    Large documents trade first, so that what is left over is small.
    """
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    got = items.groupBy("source", "source_size", "target", "n_leaves", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("n"), "u", "item"))).alias("g"))
    got = got.withColumn("r", F.aggregate(F.transform("g", lambda v: v["item"]), start, _pivot))
    return got.select("source", "source_size", "target", "n_leaves", "node", F.col("r.open").alias("open"), F.col("r.done").alias("done"))


def decide(docs: DataFrame) -> DataFrame:
    """One row a unit with source_size, target and ``total``, the copies its ``m`` rows get together."""
    units = cut(sized(docs))
    goal = cut(targets(units))
    few = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    g = goal.withColumnRenamed("source", "_src")
    if few:
        rows = units.join(F.broadcast(g), units["source"].eqNullSafe(g["_src"])).drop("_src")
    else:
        g = g.withColumn("_s2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        left = units.withColumn("_s1", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)))
        rows = left.join(g, left["source"].eqNullSafe(g["_src"]) & (left["_s1"] == g["_s2"])).drop("_src", "_s1", "_s2")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEATS)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("want", rate * F.col("m")).withColumn("base", F.floor("want").cast("bigint"))
    item = F.struct("doc_id", "th", "size", "m", "base", F.greatest(F.col("size"), F.lit(1)).cast("double").alias("weight"), F.when(F.col("size") > 0, F.col("want") - F.col("base")).otherwise(F.lit(0.0)).alias("p")).cast(ITEM)
    n_leaves = F.ceil(F.col("n_units") / LEAF).cast("bigint")
    u = F.xxhash64(F.lit(SEED), "doc_id", "th")
    items = rows.select("source", "source_size", "target", n_leaves.alias("n_leaves"), u.alias("u"), item.alias("item")).withColumn("node", F.pmod("u", "n_leaves"))
    most = goal.agg(F.max("n_units")).first()[0] or 0
    level, leaves, out = cut(_node(items)), -(-most // LEAF), []
    while True:
        out.append(level.select("source", "source_size", "target", F.explode("done").alias("i")))
        if leaves <= 1:
            break
        leaves = -(-leaves // FAN)
        up = level.filter("open IS NOT NULL").select("source", "source_size", "target", F.ceil(F.col("n_leaves") / FAN).cast("bigint").alias("n_leaves"), F.xxhash64(F.lit(SEED), "open.doc_id", "open.th").alias("u"), F.col("open").alias("item"), F.floor(F.col("node") / FAN).cast("bigint").alias("node"))
        level = cut(_node(up))
    last = level.filter("open IS NOT NULL").select("source", "source_size", "target", F.col("open").alias("i"))
    last = last.withColumn("i", F.col("i").withField("p", (F.col("i.p") >= 0.5).cast("double")))
    rows = last
    for x in out:
        rows = rows.unionByName(x)
    return rows.select("source", "source_size", "target", "i.doc_id", "i.th", "i.size", "i.m", (F.col("i.base") + F.round("i.p").cast("bigint")).alias("total"))


def mix(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies and taken words."""
    d = decide(docs)
    k = d.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("k") <= F.pmod("total", "m")).cast("bigint")
    return k.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, columns unchanged.

    Texts meet their decision by doc_id, text hash and source; hot sources do
    not matter to that key. Repeated rows are numbered only where there are any.
    """
    names = docs.columns
    d = cut(decide(docs)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("source").alias("_src"), "m", "total")
    repeated = d.filter("m > 1").limit(1).count() > 0
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["doc_id"].alias("_a"), F.xxhash64(docs["text"]).alias("_b"), docs["source"].alias("_c"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_a", "_b", "_c").orderBy(F.xxhash64("_row"))).cast("bigint") if repeated else F.lit(1).cast("bigint"))
    got = rows.join(d.filter("total > 0"), F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_th")) & F.col("_c").eqNullSafe(F.col("_src")))
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("_k") <= F.pmod("total", "m")).cast("bigint")
    return got.withColumn("_n", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("bigint"), copies)))).select("_row.*")
