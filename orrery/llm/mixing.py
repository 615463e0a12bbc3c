"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, cut into blocks of ``BLOCK`` words (fewer in
small sources, so that they have ``FEWEST`` blocks and a partial last one weighs little).
The mix is a sequence of slots of one block each, grouped into output shards. Every slot draws
a source, so a shard's source counts are multinomial. A source's slots are numbered in
shard order and rescaled to its exact quota; slot t of a source with n blocks takes
position t mod n of pass t div n, and a keyed permutation of [0, n) for that source and
pass gives the block. Slots and the documents' pieces meet in one join on (source, block).
No source is asked for more than two passes, so no document exceeds twice its size.

Everything is keyed by hashes of stable columns: reruns agree on any cluster. A stream
is laid out by groups of about ``GROUP`` documents (hash of doc_id), so a source with a
third of all rows is never ordered in one task; nor are the sources, if they are many.

Defined results: null text has size 0 and is taken 0 times; null is a source of its
own, last in order; repeated rows each get a row and a place in the stream; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import OWN, SPACE, saved

#: Words in a block, least blocks of a source, documents in a layout group, blocks in an output
#: shard, slots in a partition, rows in a range of running sums, cells of the slots' line.
BLOCK, FEWEST, GROUP, SHARD, DEAL, RANGE, CELLS = 32, 64, 1024, 1024, 1 << 18, 1 << 16, 1 << 16
#: Weights by the code-point order of the sources, repeating; the mix's share of all words.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED, ROUNDS = 20, 16


def permuted(df: DataFrame, x: str, n: str, key: str) -> DataFrame:
    """``df`` with x in [0, n) moved by a pseudorandom permutation of that range for each
    key, by swap-or-not rounds; a projection a round keeps it in generated code."""
    for k in range(ROUNDS):
        turn = F.pmod(F.xxhash64(key, F.lit(2 * k)), F.col(n))
        df = df.withColumn("_other", F.pmod(turn - F.col(x) + F.col(n), F.col(n)))
        bit = F.xxhash64(key, F.lit(2 * k + 1), F.greatest(x, "_other")) < 0
        df = df.withColumn(x, F.when(bit, F.col("_other")).otherwise(F.col(x)))
    return df.drop("_other")


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with, for each name, the sum of a column over the rows before in ``order``;
    ranges of rows are summed in parallel and their totals carried forward."""
    parts = 1 + df.count() // RANGE
    dealt = df.withColumns({f"_{k}": x for k, x in sums.items()}).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = saved(dealt, "running")
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    zero = lambda x: F.coalesce(x, F.lit(0))
    totals = dealt.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums))
    offsets = totals.select("_part", *(zero(F.sum(f"_{k}").over(earlier)).alias(f"_{k}_o") for k in sums))
    inside = dealt.select("*", *(zero(F.sum(f"_{k}").over(here)).alias(k) for k in sums))
    out = inside.join(F.broadcast(offsets), "_part").withColumns({k: F.col(k) + F.col(f"_{k}_o") for k in sums})
    return out.select(*df.columns, *sums)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with ``target`` words: the share divided by weight, where
    a source's target stops at MOST times its size and the rest is shared again.

    Sources in order of cap over weight reach their cap first; so the level at which
    the k first are capped follows from running sums."""
    name = F.col("source").asc_nulls_last()
    ranked = running(sizes, [name], _rank=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight")).drop("_rank")
    order = [F.col("ratio"), name]
    summed = saved(running(ranked, order, _caps=F.col("cap"), _weights=F.col("weight")), "targets")
    whole = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(float(SHARE * (whole["size"] or 0))) - F.col("_caps")
    open_ = F.lit(float(whole["weight"] or 0)) - F.col("_weights")
    stop = summed.where(left < F.col("ratio") * open_)
    level = stop.agg(F.min_by(left / open_, F.struct("ratio", F.col("source").isNull(), "source"))).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return summed.select("source", "source_size", target.alias("target"))


def _row(name: str) -> list[Column]:
    """128 bits that stand for a row's doc_id, source and text."""
    absent = [F.isnull(c) for c in ("doc_id", "source", "text")]  # a hash passes over nulls
    own = [F.xxhash64("doc_id", "source", "text", *absent), F.xxhash64(F.lit(SEED), *absent, "text", "source", "doc_id")]
    return [x.alias(f"{name}{k}") for k, x in enumerate(own)]


def laid_out(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, start, width, ...): each document's place in its source's
    stream, and the words of a block of that source."""
    words = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    sized = saved(docs.select("doc_id", "source", words.alias("size"), *_row("row")), "sizes")
    groups = max(1, sized.count() // GROUP)
    sized = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row0"), F.lit(groups)))
    sums = sized.groupBy("source", "grp").agg(F.sum("size").alias("words"))
    of = Window.partitionBy("source")
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"total div {FEWEST}")))
    starts = sums.select("source", "grp", (F.sum("words").over(of.orderBy("grp")) - F.col("words")).alias("base"), F.sum("words").over(of).alias("total"))
    starts = starts.select(F.col("source").alias("_source"), F.col("grp").alias("_grp"), "base", width.alias("width"))
    inside = Window.partitionBy("source", "grp").orderBy("doc_id", "row0", "row1", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a place of its own for every row, so that repeated rows stay apart
    placed = sized.withColumn("start", F.sum("size").over(inside) - F.col("size")).withColumn("nth", F.row_number().over(inside))
    here = F.col("source").eqNullSafe(F.col("_source")) & (F.col("grp") == F.col("_grp"))
    return placed.join(starts, here).select("doc_id", "source", "size", "row0", "row1", "grp", "nth", (F.col("start") + F.col("base")).alias("start"), "width")


def quotas(placed: DataFrame) -> DataFrame:
    """(source, source_size, target, blocks, slots, first): slots is the source's quota and
    first the place of its range in [0, sum of slots)."""
    sums = saved(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("width").alias("width")), "sources")
    plan = targets(sums.select("source", "source_size")).alias("t").join(sums.select(F.col("source").alias("_source"), "width"), F.col("source").eqNullSafe(F.col("_source")))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")))
    slots = F.when(F.col("source_size") > 0, F.least(MOST * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).otherwise(0)
    plan = saved(plan.select("source", "source_size", "target", "blocks", slots.cast("long").alias("slots")), "plan")
    return running(plan, [F.col("source").asc_nulls_last()], first=F.col("slots"))


def draws(plan: DataFrame) -> DataFrame:
    """(source, block, pass): the blocks that the mix takes, one row a slot."""
    spark = plan.sparkSession
    total, sources = plan.agg(F.sum("slots"), F.count(F.lit(1))).first()
    total = total or 0
    span = max(4096, total // CELLS)
    slot = spark.range(total).withColumn("u", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total))))
    last = F.col("first") + F.col("slots") - 1
    ranges = plan.where("slots > 0").select("source", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / span), F.floor(last / span))).alias("cell"))
    if sources <= CELLS:  # then there are 2 CELLS ranges at most
        ranges = F.broadcast(ranges)
    drawn = slot.withColumn("cell", F.floor(F.col("u") / span)).join(ranges, "cell").where("u between first and last")
    counts = drawn.groupBy("source", F.floor(F.col("id") / SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("source").orderBy("shard")
    counts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("source")))
    # sources with a quota that no slot happened to draw get theirs in shard 0
    known = plan.where("slots > 0").select("source", "slots", "blocks")
    held = known.join(counts, known["source"].eqNullSafe(counts["source"]), "left").select(known["source"], "slots", "blocks", "n", "upto", "all")
    scaled = lambda x: F.coalesce(F.expr(f"cast(cast({x} as decimal(38, 0)) * slots div all as long)"), F.lit(None).cast("long"))
    shares = held.select(
        "source", "blocks", F.coalesce(scaled("(upto - n)"), F.lit(0)).alias("lo"), F.coalesce(scaled("upto"), F.col("slots")).alias("hi")
    ).where("lo < hi")
    # a source's shards came together for the running sums; each is laid out on its own
    dealt = shares.repartition(max(1, -(-total // DEAL)), "source", "lo")
    slots = dealt.select("source", "blocks", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("t"))
    turn = F.floor(F.col("t") / F.col("blocks"))
    key = F.xxhash64(F.lit(SEED), F.coalesce("source", F.lit("")), F.col("source").isNull(), turn)
    keyed = slots.select("source", "blocks", F.pmod("t", "blocks").alias("block"), turn.alias("pass"), key.alias("_key"))
    return permuted(keyed, "block", "blocks", "_key").select("source", "block", "pass")


def pieces(placed: DataFrame) -> DataFrame:
    """The documents' words by block: (..., block, words)."""
    last = F.col("start") + F.col("size") - 1
    width = F.col("width")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))
    words = F.least(last, F.col("block") * width + (width - 1)) - F.greatest("start", F.col("block") * width) + 1
    return cut.withColumn("words", words)


def mixture(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass in which words of a document were drawn, a row
    with its columns and those words in order as its text (the text itself where all
    were). A column n_chars follows the text. Documents without words are not drawn.

    Rows that agree in doc_id, source and text stand for one another; where their other
    columns differ, those of the least row are taken."""
    placed = saved(laid_out(docs), "placed")
    drawn = saved(draws(saved(quotas(placed), "quotas")), "draws").withColumnsRenamed({"source": "_source", "block": "_block"})
    cut = pieces(placed)
    met = cut.join(drawn, cut["source"].eqNullSafe(drawn["_source"]) & (cut["block"] == drawn["_block"]))
    parts = met.groupBy("doc_id", "source", "row0", "row1", "grp", "nth", "pass", "start", "size", "width").agg(
        F.array_sort(F.collect_list("block")).alias("blocks"), (F.sum("words") == F.col("size")).alias("all")
    )
    parts = parts.select(*(F.col(c).alias(f"{OWN}_{c}") for c in ("row0", "row1", "start", "size", "width", "blocks", "all")))
    own = lambda c: F.col(f"{OWN}_{c}")
    # one shuffle of the texts, by the hashes that the join uses as well
    key = [f"{OWN}0", f"{OWN}1"]
    held = docs.select(*_row(OWN), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"))
    each = held.groupBy(*key).agg(F.min("_all").alias("_all")).select(*key, "_all.*")
    same = (F.col(key[0]) == own("row0")) & (F.col(key[1]) == own("row1"))
    words = F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    lead = lambda b: F.greatest(F.lit(0), b * own("width") - own("start"))
    stop = lambda b: F.least(own("size"), (b + 1) * own("width") - own("start"))
    held = lambda w: F.transform(own("blocks"), lambda b: F.array_join(F.slice(w, (lead(b) + 1).cast("int"), (stop(b) - lead(b)).cast("int")), ""))
    # the array of one binds the words, so that they are cut once and not for each block
    joined = F.array_join(F.flatten(F.transform(F.array(words), held)), "")
    out = each.join(parts, same).withColumn("text", F.when(own("all"), F.col("text")).otherwise(joined))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of ``docs``."""
    placed = saved(laid_out(docs), "placed")
    plan = saved(quotas(placed), "quotas")
    # written first: a join's null checks pushed into the rounds would double at each one
    times = saved(draws(plan), "draws").groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    cut = pieces(placed)
    met = cut.join(times, cut["source"].eqNullSafe(times["source"]) & (cut["block"] == times["block"]))
    taken = met.groupBy("doc_id", cut["source"], "row0", "grp", "nth").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    every = placed.alias("p").join(
        taken.alias("t"),
        F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.row0") == F.col("t.row0")) & (F.col("p.grp") == F.col("t.grp")) & (F.col("p.nth") == F.col("t.nth")),
        "left",
    ).select("p.doc_id", "p.source", "p.size", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
    return every.join(plan, every["source"].eqNullSafe(plan["source"])).select("doc_id", every["source"], "size", "source_size", "target", "taken")
