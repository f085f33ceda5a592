"""Logs of file operations replayed in parallel, each operation with its guards.

An operation acts only if its source is there and its destination is free at its turn, so
it depends on the operations before it that touch the same paths. Whether a path is there is a
value; an operation takes the values of its two paths and gives their next values:

    move     source and free destination: the file changes place        s, d -> s and d, s or d
    copy     source and free destination: the destination appears       s, d -> s,       s or d
    replace  source: the destination is taken over                      s, d -> no,      s or d
    remove   source: it goes                                            s    -> no

With one of two values known, each next value is known or equal to the other one, so
it refers to an earlier value. Values that refer to values are followed by pointer jumping:
a round replaces each reference by what it refers to, and so halves all chains. A
chain a -> b, b -> c, ... or a path that thousands of operations want takes a number of rounds like the
logarithm of its length. Only an operation neither of whose values is known waits, until one is; the
earliest one that waits never waits for another, so rounds end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.scan import Scan
from gleaner.operators.tree import ancestors
from gleaner.session import stored


def _value(val: Column | bool | None, ref: Column | None = None) -> Column:
    return F.struct((val if isinstance(val, Column) else F.lit(val)).cast("boolean").alias("val"), (F.lit(None) if ref is None else ref).cast("long").alias("ref"))


def _either(s: Column, d: Column) -> Column:
    """s or d, as far as it is known."""
    return F.when(s["val"] | d["val"], _value(True)).when(~s["val"], d).when(~d["val"], s)


def _both(s: Column, d: Column) -> Column:
    """s and d, as far as it is known."""
    return F.when(~s["val"] | ~d["val"], _value(False)).when(s["val"], d).when(d["val"], s)


def _followed(now: DataFrame, outs: DataFrame) -> DataFrame:
    """Each reference replaced by the value, or the reference, that the operation it names has left or given (outs: id, left, right)."""
    each = F.array(F.struct((F.col("id") * 2).alias("var"), F.col("left").alias("to")), F.struct((F.col("id") * 2 + 1).alias("var"), F.col("right").alias("to")))
    outs = outs.select(F.explode(each).alias("o")).select("o.*").where("to is not null")
    for end in ("sv", "dv"):
        # values without a reference get keys of their own: under one null key they would meet in one task
        key = F.coalesce(F.col(f"{end}.ref"), -1 - F.col("id"))
        now = now.join(outs, key == F.col("var"), "left").withColumn(end, F.coalesce("to", end)).drop("var", "to")
    return now


def replay(ops: DataFrame, listing: DataFrame, seq: str = "seq", kind: str = "op", source: str = "from", dest: str = "to", path: str = "path") -> DataFrame:
    """ops with done, and why an operation did nothing: ``source missing`` or ``destination taken`` (else empty).

    ``seq`` (long, unique) is the order; ``listing`` has the paths that are there before. A source that is its own
    destination is there or missing, and is never moved. A null path isn't there, and is free.
    """
    names = ops.columns
    base = ops.select(F.col(seq).alias("id"), F.when(F.col(source).eqNullSafe(F.col(dest)), "move").otherwise(F.col(kind)).alias("op"), F.col(source).alias("s"), F.col(dest).alias("d"))
    at = F.col("id") * 2
    touch = base.select("id", F.lit(0).alias("role"), F.col("s").alias("p"), _value(None, at).alias("v")).unionByName(base.where("op <> 'remove' and not (s <=> d)").select("id", F.lit(1).alias("role"), F.col("d").alias("p"), _value(None, at + 1).alias("v")))
    # the value that an operation finds is the one that the path's operation before has left, or the listing's, which comes first in the path's order
    first = listing.select(F.lit(None).cast("long").alias("id"), F.lit(-1).alias("role"), F.col(path).alias("p"), _value(True).alias("v"))
    before = Scan(touch.unionByName(first), ["p"], [F.col("id").asc_nulls_first(), "role"]).add(prev=("lag", F.col("v"))).df.where("role >= 0")
    met = before.withColumn("v", F.when(F.col("p").isNull() | F.col("prev").isNull(), _value(False)).otherwise(F.col("prev")))
    met = met.groupBy("id").agg(F.max(F.when(F.col("role") == 0, F.col("v"))).alias("sv"), F.max(F.when(F.col("role") == 1, F.col("v"))).alias("dv"))
    # what has no destination of its own meets its source there (moves onto itself) or nothing (removals)
    now = base.join(met, "id").select("id", "op", "sv", F.coalesce("dv", F.when(F.col("op") == "remove", _value(False)).otherwise(_value(True))).alias("dv")).checkpoint()
    s, d, op = F.col("sv"), F.col("dv"), F.col("op")
    left = F.when(op == "move", _both(s, d)).when(op == "copy", s).otherwise(_value(False))
    right = F.when(op == "remove", _value(False)).otherwise(_either(s, d))
    told, done = ("id", left.alias("left"), right.alias("right")), []
    while True:
        known = now.where("sv.val is not null and dv.val is not null")
        done.append(known.select("id", "op", "sv", "dv"))
        if now.where("sv.val is null or dv.val is null").isEmpty():
            break
        now = _followed(now.where("sv.val is null or dv.val is null"), known.select(*told))  # what is known is told once, and isn't needed any more
        now = stored(_followed(now, now.select(*told)))
    now = reduce(DataFrame.unionByName, done)
    why = F.when(~s["val"], "source missing").when(d["val"] & op.isin("move", "copy"), "destination taken").otherwise("")
    reasons = now.select(F.col("id").alias("__id"), why.alias("why"))
    return ops.join(reasons, F.col(seq) == F.col("__id")).select(*names, (F.col("why") == "").alias("done"), "why")


def listing_after(replayed: DataFrame, listing: DataFrame, seq: str = "seq", kind: str = "op", source: str = "from", dest: str = "to", path: str = "path") -> DataFrame:
    """The paths that are there after a replay."""
    done = replayed.where("done")
    gone = done.where(F.col(kind) != "copy").select(F.col(source).alias(path), F.col(seq).alias("__n"), F.lit(False).alias("__there"))
    come = done.where(F.col(kind) != "remove").select(F.col(dest).alias(path), F.col(seq).alias("__n"), F.lit(True).alias("__there"))
    before = listing.select(path).distinct().select(path, F.lit(None).cast("long").alias("__n"), F.lit(True).alias("__there"))
    last = before.unionByName(gone).unionByName(come).groupBy(path).agg(F.max(F.struct("__n", "__there"))["__there"].alias("__there"))
    return last.where("__there").select(path)


def undo(log: DataFrame, listing: DataFrame, seq: str = "seq", kind: str = "op", source: str = "from", dest: str = "to", path: str = "path") -> DataFrame:
    """A log of done operations backwards, last first, over what is there now: seq, op, from, to, done, why.

    A move goes back if its file still is where it went and its former place is free; a dropped copy (``dedup``, whose
    ``to`` is the equal file that stayed) is made again from that file. What was changed since is skipped, the rest goes back.
    """
    back = log.where(F.col(kind).isin("move", "dedup")).select((-F.col(seq)).alias("seq"), F.when(F.col(kind) == "move", "move").otherwise("copy").alias("op"), F.col(dest).alias("from"), F.col(source).alias("to"))
    return replay(back, listing, path=path).withColumn("seq", -F.col("seq"))


def merge_folders(files: DataFrame, groups: DataFrame, path: str = "path", content: str = "content", junk: str = "junk", folder: str = "folder", keep: str = "keep", rank: str = "rank") -> DataFrame:
    """Files of the folders that go (``folder`` into ``keep``, in order of ``rank``): folder, from, to, status, seq.

    A file keeps its path below the folder. ``moved`` if nothing is at its destination, neither before nor from a folder
    of a smaller rank; ``same`` (dropped) if an equal file is there; ``conflict`` (stays) if another one is; junk is ``deleted``.
    Folders don't hold each other. Rows of one destination are never gathered: what is there first is one aggregate.
    """
    g = groups.where(F.col(folder) != F.col(keep)).select(F.col(folder).alias("folder"), F.col(keep).alias("keep"), F.col(rank).alias("rank"))
    rows = files.select(F.col(path).alias("from"), F.col(content).alias("content"), F.coalesce(F.col(junk), F.lit(False)).alias("junk"))
    # a file meets each of the folders above it by an equi-join
    inside = rows.withColumn("folder", F.explode(ancestors(F.col("from"))))
    moves = inside.join(g, "folder").withColumn("to", F.concat("keep", F.expr("substring(`from`, length(folder) + 1)")))
    order = F.struct("rank", "from")
    first = moves.where("not junk").groupBy("to").agg(F.min_by("content", order).alias("first"), F.min(order).alias("at"))
    there = rows.select(F.col("from").alias("to"), F.struct("content").alias("there"))
    met = moves.join(first, "to", "left").join(there, "to", "left").withColumn("holds", F.when(F.col("there").isNotNull(), F.col("there.content")).otherwise(F.col("first")))
    status = F.when(F.col("junk"), "deleted").when(F.col("there").isNull() & (order == F.col("at")), "moved").when(F.col("content").eqNullSafe(F.col("holds")), "same").otherwise("conflict")
    return met.select("folder", "from", "to", status.alias("status"), order.alias("seq"))


def emptied(merged: DataFrame) -> DataFrame:
    """folder, moved, same, conflicts, deleted, and gone: whether nothing of it is left."""
    count = {n: F.count_if(F.col("status") == k) for n, k in (("moved", "moved"), ("same", "same"), ("conflicts", "conflict"), ("deleted", "deleted"))}
    return merged.groupBy("folder").agg(*(v.alias(k) for k, v in count.items())).withColumn("gone", F.col("conflicts") == 0)
