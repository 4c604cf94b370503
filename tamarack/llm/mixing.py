"""Mixing sources to target weights, in DataFrame operations only.

Targets: sources in code point order get the weights 5, 2, 1, 5, ... and share the total number of words;
a target stops at a multiple of its source's words and the excess goes to the others by weight.
Each source's rows are laid in a permuted order and cut into blocks of equal words. A source's quota is the
number of blocks that its target asks for: all of them, for each whole time that the target holds the
source, and for the rest the blocks that come first in a permutation of them, the last one in part. A
splitting tree deals the quotas to the output shards: at each node the sources' quotas are split between
two halves of the shards by a multivariate hypergeometric draw, so every shard gets a random mix of its
exact size and the quotas add up. A second permutation of a source's quota gives each shard its disjoint
blocks; a shard orders what it took by a hash of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm import common
from tamarack.scratch import Scratch

WEIGHTS, MOST, SHARDS, BLOCK_WORDS, SEED = (5, 2, 1), 3, 16, 20_000, 11
#: Rows that a task puts in order, on average.
BUCKET_ROWS = 4_000
#: Blocks of a source whose order a window settles at once.
RUN = 4096


def hypergeometric(population: str, good: str, drawn: str, chance: str) -> str:
    """SQL for the number of good ones among ``drawn`` of ``population``, by the inverse of the distribution.

    Weights are taken relative to the mode and run 12 standard deviations to both sides of it, beyond which
    no double differs; the outcomes are laid out as the mode, those above it, those below it.
    """
    up, down = "(v.k - x + 1D) * (v.n - x + 1D) / (x * (v.p - v.k - v.n + x + 0D))", "(x + 1D) * (v.p - v.k - v.n + x + 1D) / ((v.k - x + 0D) * (v.n - x + 0D))"
    above, below = "if(v.m < v.z, sequence(v.m + 1, v.z), array())", "if(v.a < v.m, sequence(v.m - 1, v.a, -1L), array())"
    above, below = f"cast({above} as array<bigint>)", f"cast({below} as array<bigint>)"
    total = lambda seq, ratio: f"aggregate({seq}, named_struct('w', 1D, 's', 0D), (acc, x) -> named_struct('w', acc.w * ({ratio}), 's', acc.s + acc.w * ({ratio})), acc -> acc.s)"
    find = lambda seq, ratio, t: f"aggregate({seq}, named_struct('w', 1D, 's', 0D, 'x', cast(null as bigint)), (acc, x) -> named_struct('w', acc.w * ({ratio}), 's', acc.s + acc.w * ({ratio}), 'x', if(acc.x is null and acc.s + acc.w * ({ratio}) > {t}, x, acc.x)), acc -> acc.x)"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    base = f"named_struct('p', cast({population} as bigint), 'k', cast({good} as bigint), 'n', cast({drawn} as bigint), 'u', {chance})"
    bounds = "named_struct('p', b.p, 'k', b.k, 'n', b.n, 'u', b.u, 'lo', greatest(0L, b.n + b.k - b.p), 'hi', least(b.n, b.k), 'sd', sqrt(greatest(0D, if(b.p < 2, 0D, b.n * (b.k / b.p) * (1D - b.k / b.p) * (b.p - b.n) / (b.p - 1D)))))"
    mode = "named_struct('p', c.p, 'k', c.k, 'n', c.n, 'u', c.u, 'lo', c.lo, 'hi', c.hi, 'sd', c.sd, 'm', greatest(c.lo, least(c.hi, cast(floor((c.n + 1D) * (c.k + 1D) / (c.p + 2D)) as bigint))))"
    reach = "named_struct('p', d.p, 'k', d.k, 'n', d.n, 'u', d.u, 'm', d.m, 'a', greatest(d.lo, d.m - cast(ceil(12 * d.sd) as bigint) - 12), 'z', least(d.hi, d.m + cast(ceil(12 * d.sd) as bigint) + 12))"
    sums = f"named_struct('p', v.p, 'k', v.k, 'n', v.n, 'm', v.m, 'a', v.a, 'z', v.z, 'over', {total(above, up)}, 'under', {total(below, down)}, 'u', v.u)"
    pick = f"if(v.u * (1D + v.over + v.under) < 1D, v.m, coalesce({find(above, up, 'v.u * (1D + v.over + v.under) - 1D')}, {find(below, down, 'v.u * (1D + v.over + v.under) - 1D - v.over')}, v.m))"
    return let(base, "b", let(bounds, "c", let(mode, "d", let(reach, "v", let(sums, "v", pick)))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds sid (0, 1, ... by code point, null last), weight and target to (source, source_size, ...), one row per source.

    With caps ordered by cap / weight, a source is at its cap if the share that what precedes it leaves
    would exceed it: one pass of prefix sums gives the end of all resharing. The windows hold a row for
    each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sources.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid").asc())
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = named.withColumn("level", (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    full = F.col("cap") <= F.col("weight") * F.col("level")
    share = F.max(F.when(~full, F.col("level"))).over(every)
    return shared.withColumn("target", F.round(F.when(full, F.col("cap")).otherwise(F.col("weight") * share), 6)).drop("cap", "level")


def quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, ends): for each source, the running number of blocks of its quotas over the shards, from (sid, blocks).

    The tree's nodes are rows that hold the quotas of all sources as an array: one number for each source
    and shard in all.
    """
    root = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "blocks"))), lambda x: x["blocks"]).alias("quota")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "quota", F.coalesce(F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("all"))
    nodes, width = root, shards
    while width > 1:
        drawn = "acc.take"
        chance = f"pmod(xxhash64({seed}, low, high, size(acc.left)), 9007199254740992) / 9007199254740992D"
        half = nodes.withColumn("mid", F.when(F.col("high") - F.col("low") > 1, F.floor((F.col("low") + F.col("high")) / 2)).otherwise(F.col("high")).cast("int"))
        half = half.withColumn("capacity", F.expr(f"(all * mid) div {shards} - (all * low) div {shards}")).withColumn("rest", F.expr("aggregate(quota, 0L, (a, x) -> a + x)"))
        left = F.expr(
            f"aggregate(quota, named_struct('rest', rest, 'take', capacity, 'left', cast(array() as array<bigint>)), (acc, q) -> element_at(transform(array({hypergeometric('acc.rest', 'q', drawn, chance)}), g -> named_struct('rest', acc.rest - q, 'take', acc.take - g, 'left', concat(acc.left, array(g)))), 1), acc -> acc.left)"
        )
        half = half.withColumn("left", F.when(F.col("mid") < F.col("high"), left).otherwise(F.col("quota")))
        children = F.array(
            F.struct("low", F.col("mid").alias("high"), F.col("left").alias("quota"), "all"),
            F.struct(F.col("mid").alias("low"), "high", F.zip_with("quota", "left", lambda q, g: q - g).alias("quota"), "all"),
        )
        nodes = half.select(F.explode(F.filter(children, lambda c: c["low"] < c["high"])).alias("c")).select("c.*")
        width = (width + 1) // 2
    each = nodes.select("low", F.posexplode("quota").alias("sid", "quota"))
    rising = each.select("sid", "low", F.sum("quota").over(Window.partitionBy("sid").orderBy("low")).alias("end"))
    return rising.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("low", "end"))), lambda x: x["end"]).alias("ends"))


def permutation(doc_id: Column, text: Column, seed: int) -> Column:
    """Hexadecimal hash that orders a source's rows."""
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def permuted(x: str, n: str, salt: str) -> Column:
    """A random-like permutation of 0 to n - 1 at ``x``, all SQL: a Feistel network over a grid of sides a and b.

    Numbers that leave the range go round again; as fewer than a of a * b lie outside, that ends at once or soon.
    """
    word = lambda i, v: f"cast(conv(substr(md5(cast(concat_ws('|', {salt}, {i}, {v}) as binary)), 1, 8), 16, 10) as bigint)"
    halves = f"if(i % 2 = 0, named_struct('l', (h.l + {word('i', 'h.r')}) % g.a, 'r', h.r), named_struct('l', h.l, 'r', (h.r + {word('i', 'h.l')}) % g.b))"
    once = f"aggregate(array(0, 1, 2, 3), named_struct('l', v % g.a, 'r', v div g.a), (h, i) -> {halves}, h -> h.r * g.a + h.l)"
    walk = f"aggregate(sequence(1, 64), cast({x} as bigint), (v, turn) -> if(turn > 1 and v < {n}, v, {once}))"
    side = f"cast(ceil(sqrt(cast({n} as double))) as bigint)"
    grid = f"array(named_struct('a', {side}, 'b', cast(ceil(cast({n} as double) / {side}) as bigint)))"
    return F.expr(f"element_at(transform({grid}, g -> {walk}), 1)")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, order_key, source, size, source_size, target, draws.

    ``draws`` has an entry {copy, block, shard, shuffle_key} for each time that the mix takes the document,
    which is at most ``most`` times rounded up; ``block`` is the block's place among all that the source
    gives, and a shard is its draws ordered by shuffle_key. Each source takes its target to within half a
    document. Null and empty texts have size 0 and are taken as often as the block they fall in; a source
    without words has target 0 and gives nothing. Equal seeds and rows give equal draws, however the rows
    are stored; repeated rows are taken each on their own. Other columns are not read; an empty table gives
    an empty result.
    """
    tables = Scratch(spark, "mixing")
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.n_words(F.col("text")).alias("size")]
    sizes = tables.keep(docs.select(*own, permutation(F.col("doc_id"), F.col("text"), seed).alias("order_key")), "sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    sources = tables.keep(sources.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long")), "sources")

    # where each row begins in its source: sums of buckets of the order, then sums inside a bucket
    where = (F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32)).cast("long")
    rows = sizes.alias("d").join(sources.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source")).withColumn("bucket", where)
    counted = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    # rows without words would all fall in the block where they stand, so they are dealt to any
    middle = F.least(F.floor((F.col("start") + F.col("size") / 2) / block_words), F.col("blocks") - 1)
    placed = placed.withColumn("block", F.when(F.col("size") > 0, middle).otherwise(F.pmod(F.xxhash64("order_key"), "blocks")))
    placed = tables.keep(placed.select("doc_id", "order_key", "source", "size", "source_size", "target", "sid", "start", "block"), "placed")

    # the blocks in their permuted order, and the one with which the rest of the target is reached
    own = placed.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.min(F.when(F.col("size") > 0, F.col("start"))).alias("first"))
    ranked = own.join(sources.select("sid", "blocks", "passes", "rest"), "sid").withColumn("rank", permuted("block", "blocks", f"'{seed}', sid"))
    ranked = tables.keep(ranked.withColumn("run", F.floor(F.col("rank") / RUN)), "ranked")
    by_run = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = ranked.groupBy("sid", "run", "rest").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(by_run) - F.col("words"))
    reached = lambda: (F.col("upto") < F.col("rest")) & (F.col("rest") <= F.col("upto") + F.col("words"))
    last_run = runs.where(reached()).select("sid", "run", F.col("upto").alias("base"))
    by_rank = Window.partitionBy("sid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    last = ranked.join(last_run, ["sid", "run"]).withColumn("upto", F.col("base") + F.sum("words").over(by_rank) - F.col("words"))
    last = last.where(reached()).select("sid", F.col("rank").alias("last"), (F.col("rest") - F.col("upto")).alias("room"))
    whole = sources.join(last, "sid", "left").select("sid", "passes", "blocks", "last", "room", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0))).alias("quota"))
    whole = tables.keep(whole, "quotas")
    plan = tables.keep(whole.drop("blocks").join(quotas(whole.select("sid", F.col("quota").alias("blocks")), shards, seed), "sid"), "plan")

    # what the shards' quotas ask for is taken: of each block, the copies whose place in the source's second permutation is some shard's
    asked = F.expr("if(rank <= last, passes, passes - 1)")
    copies = F.when(asked >= 0, F.sequence(F.lit(0).cast("long"), asked)).otherwise(F.array().cast("array<long>"))
    each = ranked.drop("passes", "rest").join(plan, "sid").withColumn("copy", F.explode(copies))
    each = each.withColumn("asked", F.col("copy") * F.col("blocks") + F.when(F.col("copy") < F.col("passes"), F.col("block")).otherwise(F.col("rank")))
    each = each.withColumn("turned", permuted("asked", "quota", f"'{seed}', sid, 'shard'")).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("turned"))))
    room = F.when((F.col("copy") == F.col("passes")) & (F.col("rank") == F.col("last")), F.col("room"))
    one = F.struct("copy", F.col("turned").alias("block"), "shard", room.alias("room"))
    drawn = each.where(F.col("shard") < shards).groupBy("sid", "block").agg(F.array_sort(F.collect_list(one)).alias("drawn"), F.first("first").alias("first"))
    drawn = tables.keep(drawn, "drawn")
    both = placed.join(drawn, ["sid", "block"], "left")
    fits = lambda d: d["room"].isNull() | (2 * (F.col("start") - F.col("first")) + F.col("size") < 2 * d["room"])
    key = lambda d: F.xxhash64(F.lit(seed), d["shard"], "order_key", d["copy"])
    taken = F.transform(F.filter("drawn", fits), lambda d: F.struct(d["copy"].alias("copy"), d["block"].alias("block"), d["shard"].alias("shard"), key(d).alias("shuffle_key")))
    return both.select("doc_id", "order_key", "source", "size", "source_size", "target", F.coalesce(taken, F.expr("filter(array(struct(0L as copy, 0L as block, 0 as shard, 0L as shuffle_key)), d -> false)")).alias("draws"))


def mixed(spark: SparkSession, docs: DataFrame, seed: int = SEED, shards: int = SHARDS, part_rows: int = 1 << 12, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` takes it, shard by shard in the shards' order.

    A shard lies in parts of about ``part_rows`` rows: equal ranges of its shuffle keys, each in one partition
    and sorted there. Null ids and texts, ties, repeated rows and empty tables are as in ``mix``.
    """
    taken = mix(spark, docs, seed=seed, shards=shards, **options).groupBy("doc_id", F.col("order_key").alias("key")).agg(F.flatten(F.collect_list("draws")).alias("__tm_draws"))
    rows = common.matched(docs, taken.where(F.size("__tm_draws") > 0), permutation(F.col("doc_id"), F.col("text"), seed))
    rows = rows.select(*docs.columns, F.explode("__tm_draws").alias("__tm"))
    place = (F.shiftrightunsigned(F.col("__tm.shuffle_key"), 40) / F.lit(float(1 << 24)) * F.lit(max(1, docs.count() // (shards * part_rows)))).cast("int")
    rows = rows.withColumn("__tm_shard", F.col("__tm.shard")).withColumn("__tm_part", place)
    rows = rows.repartition("__tm_shard", "__tm_part").sortWithinPartitions("__tm_shard", "__tm_part", F.expr("shiftrightunsigned(__tm.shuffle_key, 1)"))
    return rows.drop("__tm", "__tm_shard", "__tm_part")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each row of ``documents``; see ``mix``."""
    return mix(spark, common.load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


# The permutation of blocks is the one of ``permuted``, a row for each time that a number goes round.
OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
  md5(concat('{SEED}', '|', coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5.0::DOUBLE, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, 3 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev FROM n
  WINDOW b AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, sid, source_size, round(CASE WHEN cap <= w * lev THEN cap ELSE w * (SELECT max(lev) FROM l WHERE cap > w * lev) END, 6) AS target,
  greatest(1, ceil(source_size / {BLOCK_WORDS}))::BIGINT AS blocks FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
p AS (SELECT d.*, sid, source_size, target, passes, target - passes * source_size AS rest, blocks, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
m AS (SELECT *, CASE WHEN size > 0 THEN least(floor((start + size / 2) / {BLOCK_WORDS}), blocks - 1)::BIGINT END AS block FROM p),
o AS (SELECT sid, block, rest, blocks AS n, sum(size) AS words, min(start) AS first FROM m WHERE size > 0 GROUP BY ALL),
g AS (SELECT sid, block, n, ceil(sqrt(n::DOUBLE))::BIGINT AS a, ceil(n::DOUBLE / ceil(sqrt(n::DOUBLE)))::BIGINT AS b FROM o),
walk AS (SELECT *, block AS v, 0 AS turn FROM g UNION ALL
  SELECT sid, block, n, a, b, r2 * a + l2 AS v, turn + 1 FROM (SELECT *,
    (v % a + ('0x' || substr(md5(concat_ws('|', '{SEED}', sid, 0, v // a)), 1, 8))::BIGINT) % a AS l1,
    (v // a + ('0x' || substr(md5(concat_ws('|', '{SEED}', sid, 1, l1)), 1, 8))::BIGINT) % b AS r1,
    (l1 + ('0x' || substr(md5(concat_ws('|', '{SEED}', sid, 2, r1)), 1, 8))::BIGINT) % a AS l2,
    (r1 + ('0x' || substr(md5(concat_ws('|', '{SEED}', sid, 3, l2)), 1, 8))::BIGINT) % b AS r2 FROM walk WHERE turn = 0 OR v >= n)),
ranked AS (SELECT o.sid, o.block, o.rest, o.first, arg_max(v, turn) AS rank, any_value(words) AS words FROM o JOIN walk w ON w.sid = o.sid AND w.block = o.block GROUP BY o.sid, o.block, o.rest, o.first),
upto AS (SELECT *, sum(words) OVER (PARTITION BY sid ORDER BY rank ROWS UNBOUNDED PRECEDING) - words AS upto FROM ranked),
room AS (SELECT sid, block, first, greatest(0, rest - upto) AS room, upto + words < rest AS whole FROM upto)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN size > 0 AND (whole OR 2 * (start - first) + size < 2 * room) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m LEFT JOIN room USING (sid, block)
"""
