"""Hash-chained ledgers: links, content hashes, heads, appending and reading from text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "seq long, prev string, type string, payload string, t long, hash string"

#: The predecessor of a ledger's first entry.
GENESIS = "0" * 64


def content_hash(prev: Column) -> Column:
    """SHA-256 of an entry's members in their fixed order; the bulk twin of the canonical hash."""
    return F.sha2(F.concat_ws("|", F.col("payload"), prev, F.col("seq").cast("string"), F.col("t").cast("string"), F.col("type")), 256)


def violations(entries: DataFrame, by: str) -> DataFrame:
    """(by, seq, error) of entries (by, seq, prev, type, payload, t, hash).

    InvalidEntry: a member is absent or empty or seq is out of turn. BrokenChain: prev is
    not the hash before. TamperedEntry: the hash is not that of the content. Hashes are
    checked row by row; only the link needs the ledger's order."""
    w = Window.partitionBy(by).orderBy("seq")
    linked = entries.withColumns({"_n": F.row_number().over(w) - 1, "_prev": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))})
    absent = F.col("type").isNull() | (F.col("type") == "") | F.col("payload").isNull() | F.col("t").isNull() | (F.col("_n") != F.col("seq"))
    error = F.when(absent, "InvalidEntry").when(F.col("prev") != F.col("_prev"), "BrokenChain").when(F.col("hash") != content_hash(F.col("prev")), "TamperedEntry")
    return linked.withColumn("error", error).where("error is not null").select(by, "seq", "error")


def heads(entries: DataFrame, by: str) -> DataFrame:
    """(by, count, head): each ledger's length and last hash."""
    return entries.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.max_by("hash", "seq").alias("head"))


def digest(payload: str, prev: str, seq: int, t: int, kind: str) -> str:
    """``content_hash`` in Python, for chains that are built or verified one by one."""
    return hashlib.sha256("|".join((payload, prev, str(seq), str(t), kind)).encode()).hexdigest()


def appended(rows: DataFrame, by: str, order: str, last: DataFrame | None = None) -> DataFrame:
    """(by, order, seq, prev, type, payload, t, hash): rows (by, order, type, payload, t) as
    entries behind the heads ``last`` (by, count, head); without those, new ledgers.

    A hash needs the one before, so a ledger is one sorted run; its state is two values, so
    memory does not grow with it. Heads are rows of that run, before the entries. An empty
    type or payload and an absent time are refused."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = rows.select(by, order, "type", "payload", F.col("t").cast("long").alias("t"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("head"))
    if last is not None:
        own = {by: F.col(by).cast(kinds[by]), "count": F.col("count").cast("long"), "head": F.col("head")}
        known = known.unionByName(last.select(*(c.alias(n) for n, c in own.items())), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, key, seq, head = False, None, 0, GENESIS
        for batch in batches:
            at, seqs, prevs, hashes = [], [], [], []
            for k, (own, kind, payload, t, count, start) in enumerate(zip(*(batch.column(n).to_pylist() for n in (by, "type", "payload", "t", "count", "head")))):
                if not began or own != key:
                    began, key, seq, head = True, own, 0, GENESIS
                if count is not None:
                    seq, head = count, start
                    continue
                if not kind or not payload or t is None:
                    raise ValueError("an entry has no type, payload or time")
                at.append(k)
                seqs.append(seq)
                prevs.append(head)
                seq, head = seq + 1, digest(payload, head, seq, t, kind)
                hashes.append(head)
            rows = batch.take(pa.array(at, pa.int64()))
            made = {"seq": pa.array(seqs, pa.int64()), "prev": pa.array(prevs, pa.string()), "hash": pa.array(hashes, pa.string())}
            names = [by, order, "seq", "prev", "type", "payload", "t", "hash"]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else rows.column(n) for n in names], names=names)

    return whole(known, by).sortWithinPartitions(by, F.col("count").isNull(), order).mapInArrow(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, {ENTRY}")


def whole(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` dealt so that each ledger lies in one partition, for Python and for files.

    A plain ``repartition(by)`` behind a join on ``by`` is dropped as needless, and where the join then
    becomes a broadcast while it runs, its rows are read as they lay: a ledger falls apart. By
    a hash of ``by`` it stays."""
    return rows.repartition(F.xxhash64(by))


def to_lines(entries: DataFrame, by: str) -> DataFrame:
    """(by, seq, line): entries as JSON lines, their members in alphabetical order."""
    members = [F.col("hash"), F.col("payload"), F.col("prev"), F.col("seq"), F.col("t"), F.col("type")]
    return entries.select(by, "seq", F.to_json(F.struct(*members)).alias("line"))


def from_text(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """(ledger, place, seq, prev, type, payload, t, hash, torn) from files of JSON lines, one a
    ledger, named by its folder ledger=<name> or else by its file. With ``named`` a file holds many
    ledgers, each whole, and each line its ledger's name and a tab before the entry. A last line that is no entry is torn: an append was cut off, and
    verification leaves it out; any other such line has null members, an invalid entry."""
    lines = spark.read.text(path)
    if named:
        name, text = F.substring_index("value", "\t", 1), F.regexp_replace("value", "^[^\t]*\t?", "")
    else:
        name = F.col("ledger") if "ledger" in lines.columns else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        text = F.col("value")
    lines = lines.select(
        name.alias("ledger"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"), text.alias("value")
    )
    last = lines.groupBy("ledger").agg(F.max("place").alias("_last"))
    read = lines.join(last, "ledger").withColumn("e", F.from_json("value", ENTRY))
    return read.select("ledger", "place", "e.*", (F.col("e.hash").isNull() & (F.col("place") == F.col("_last"))).alias("torn"))
