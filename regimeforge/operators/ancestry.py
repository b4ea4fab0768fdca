"""Ancestry of rows that point at an earlier row, and audits of decision ledgers along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store


def ancestry(rows: DataFrame, key: str, parent: str, tainted: str | None = None) -> DataFrame:
    """(key, root, depth, cyclic, above): where the chain of parents of each row ends, how long it is, whether it never
    ends, and whether a row above it is ``tainted``.

    Pointers double: each round joins the rows with themselves and halves what is left, so a chain of a million
    rows takes twenty rounds, each a hash join written to the shared folder. A round in which no chain ends is the
    last one: were there a longer chain, one of its rows would have ended in that round; what is left are cycles, and
    chains into them. Their root and depth are null. A parent that does not exist ends the chain. Keys must
    be unique and not null; an empty table gives none.
    """
    flag = F.coalesce(F.col(tainted), F.lit(False)) if tainted else F.lit(False)
    ids = rows.select(F.col(key).alias("k"))
    own = rows.select(F.col(key).alias("k"), F.col(parent).alias("p"), flag.alias("_t"))
    known = own.join(ids.withColumnRenamed("k", "p"), "p", "left_semi")
    # up: the row that ``depth`` steps lead to; above: a tainted row on the way, the end included
    taint = own.select(F.col("k").alias("p"), F.col("_t").alias("above"))
    start = known.select("k", "p").join(taint, "p").select("k", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth"), "above", F.lit(False).alias("done"))
    tops = own.join(known.select("k"), "k", "left_anti").select("k", F.col("k").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("above"), F.lit(True).alias("done"))
    now, left = store.stored(start.unionByName(tops), "ancestry"), None
    while True:
        open_ = now.where("not done").count()
        if open_ == left or open_ == 0:
            break
        left = open_
        next_ = now.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("above").alias("_a"), F.col("done").alias("_done"), F.pmod(F.xxhash64("k"), F.lit(1024)).alias("_s"))
        # the second key keeps this exchange apart from others, so that Spark can split a row that many point at
        step = now.where("not done").withColumn("_s", F.pmod(F.xxhash64("up"), F.lit(1024))).join(next_, ["up", "_s"])
        step = step.select("k", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("above") | F.col("_a")).alias("above"), F.col("_done").alias("done"))
        now = store.stored(now.where("done").unionByName(step), "ancestry")
    ends = F.col("done")
    return now.select(F.col("k").alias(key), F.when(ends, F.col("up")).alias("root"), F.when(ends, F.col("depth")).alias("depth"), (~ends).alias("cyclic"), "above")


def input_hash(event_at: Column, received_at: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", event_at.cast("string"), received_at.cast("string"), payload), 256)


def decision_hash(ident: Column, decided_at: Column, amends: Column, inputs: Column) -> Column:
    """``inputs``: the hashes of the inputs in order, joined by commas."""
    return F.sha2(F.concat_ws("|", ident.cast("string"), decided_at.cast("string"), F.coalesce(amends.cast("string"), F.lit("-")), inputs), 256)


def packed(sha256: Column) -> Column:
    """A hash in 32 bytes; a text that is none stays a longer text, so different texts stay different."""
    hex_ = (F.length(sha256) == 64) & ~sha256.rlike("[^0-9a-f]")
    return F.when(hex_, F.unhex(sha256)).otherwise(F.concat(F.lit("=" * 33), sha256).cast("binary"))


def audited(decisions: DataFrame, inputs: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root, depth, faults, ancestors_sound): everything that is wrong with each decision, and with those that it amends.

    ``decisions``: id, decided_at, amends, sha256; ``inputs``: decision_id, ordinal, input_sha256; ``evidence``: sha256,
    event_at, received_at, payload; ``links`` (executions): link_id, decision_id, observed_at. Inputs of no decision
    come as a row with that id and the fault ``orphan_input``; orphan links likewise. Each decision's inputs, few, are
    gathered by an aggregate; evidence used by many is joined by its hash. Null ids are left out.
    """
    split = lambda c: F.pmod(F.xxhash64(c), F.lit(1024)).alias("_s")
    ok = input_hash(F.col("event_at"), F.col("received_at"), F.col("payload")) == F.col("sha256")
    sound = evidence.groupBy(packed(F.col("sha256")).alias("h")).agg(F.min("event_at").alias("_first"), F.max("received_at").alias("_last"), F.min(ok).alias("_ok"))
    sound = sound.select("h", split("h"), "_ok", (F.col("_first") > F.col("_last")).alias("_odd"), F.col("_last").alias("received_at"))
    own = inputs.where("decision_id is not null").withColumnRenamed("decision_id", "id")
    # the hashes are listed where the inputs lie; what moves to the evidence and back is 32 bytes, then flags
    listed = own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "input_sha256"))), lambda x: x["input_sha256"]), ",").alias("_in"))
    digests = own.select("id", packed(F.col("input_sha256")).alias("h"))
    met = digests.select("id", "h", split("h")).join(sound, ["h", "_s"], "left")
    seen = met.select("id", F.col("_ok").isNull().alias("_lost"), (~F.col("_ok")).alias("_forged"), "_odd", "received_at", F.lit(None).cast(links.schema["observed_at"].dataType).alias("observed_at"))
    none = lambda c: F.lit(None).cast(seen.schema[c].dataType).alias(c)
    acted = links.where("decision_id is not null").select(F.col("decision_id").alias("id"), *map(none, ("_lost", "_forged", "_odd", "received_at")), "observed_at")
    facts = seen.unionByName(acted).groupBy("id").agg(*(F.bool_or(c).alias(c) for c in ("_lost", "_forged", "_odd")), F.max("received_at").alias("_latest"), F.min("observed_at").alias("_observed"))
    there = F.col("sha256").isNotNull()
    hashed = decision_hash(F.col("id"), F.col("decided_at"), F.col("amends"), F.coalesce("_in", F.lit(""))) == F.col("sha256")
    d = decisions.where("id is not null").join(listed, "id", "full")
    d = d.select("id", "decided_at", "amends", there.alias("_there"), F.col("_in").isNotNull().alias("_used"), hashed.alias("_hashed")).join(facts, "id", "full")
    parent = decisions.where("id is not null").select(F.col("id").alias("amends"), F.col("decided_at").alias("_pd"), split("id"))
    d = d.withColumn("_s", F.pmod(F.xxhash64("amends"), F.lit(1024))).join(parent, ["amends", "_s"], "left").drop("_s")
    there, used = F.coalesce("_there", F.lit(False)), F.coalesce("_used", F.lit(False))
    rules = (
        (~there & used, "orphan_input"), (~there & F.col("_observed").isNotNull(), "orphan_link"), (there & ~used, "no_input"), (there & F.col("_lost"), "missing_evidence"), (F.col("_forged"), "evidence_hash"),
        (there & (F.coalesce("_odd", F.lit(False)) | (F.col("_latest") > F.col("decided_at"))), "noncausal_evidence"), (there & ~F.col("_hashed"), "decision_hash"),
        (F.col("amends").isNotNull() & F.col("_pd").isNull(), "missing_parent"), (F.col("_pd") > F.col("decided_at"), "noncausal_parent"), (there & (F.col("_observed") < F.col("decided_at")), "link_precedes_decision"),
    )
    d = store.stored(d.select("id", "amends", there.alias("_there"), F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for rule, name in rules))).alias("faults")), "decisions")
    way = ancestry(d.where("_there").withColumn("_bad", F.size("faults") > 0), "id", "amends", "_bad")
    out = d.join(way, "id", "left")
    faults = F.when(F.coalesce("cyclic", F.lit(False)), F.array_append("faults", F.lit("cyclic_amendment"))).otherwise(F.col("faults"))
    return out.select("id", "root", "depth", F.concat_ws(",", faults).alias("faults"), F.when(F.col("_there"), ~(F.col("above") | F.col("cyclic"))).alias("ancestors_sound"))
