"""Hash-chained ledgers: canonical hashes, building, verifying and tamper detection.

Each event's hash covers its canonical JSON (keys sorted, nulls kept, no blanks) with the hash of the
event before it in its ledger; the first event links to nothing.

Building is sequential within a ledger by nature: rows are partitioned by ledger and sorted, and the fold
streams through them with one hash of memory, so no ledger is ever held. Verifying is not sequential:
every row is checked against the stored hash before it, by an equi-join on (ledger, seq).

Defined results: rows with a null ledger or order are left out; equal order values are ordered by event id.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that a hash covers; previous_event_hash is the thirteenth.
FIELDS = ("change_id", "decision_id", "details", "event_id", "event_type", "new_state", "new_status", "occurred_at", "previous_state", "previous_status", "report_id", "reviewer_name")


def canonical(previous: Column) -> Column:
    """Canonical JSON of an event row whose columns are FIELDS; a missing previous hash is empty text."""
    cells = [F.col(f).cast("string").alias(f) for f in FIELDS if f != "details"]
    cells.append(F.coalesce("details", F.create_map().cast("map<string,string>")).alias("details"))
    cells.append(F.coalesce(previous, F.lit("")).alias("previous_event_hash"))
    ordered = sorted(zip([*[f for f in FIELDS if f != "details"], "details", "previous_event_hash"], cells))
    return F.to_json(F.struct(*[c for _, c in ordered]), {"ignoreNullFields": "false"})


def build_chain(events: DataFrame, ledger: str, order: str, start: tuple[str, str] | None = None) -> DataFrame:
    """events (with the columns FIELDS) plus seq, previous_event_hash and event_hash.

    start names columns with the last seq and hash of the ledger so far, null for new ledgers.
    """
    kept = events.schema.fields
    fields = sorted(FIELDS)

    def run(batches):
        last, previous, seq = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = {n: b.column(n).to_pylist() for n in dict.fromkeys([ledger, *fields, *(start or ())])}
            seqs, before, hashes = [], [], []
            for i, key in enumerate(columns[ledger]):
                if key != last:
                    last, previous, seq = key, columns[start[1]][i] if start else None, (columns[start[0]][i] or 0) if start else 0
                seq += 1
                row = {n: columns[n][i] for n in fields}
                row["details"] = dict(row["details"] or {})
                row["previous_event_hash"] = previous or ""
                h = hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
                seqs.append(seq)
                before.append(previous)
                hashes.append(h)
                previous = h
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seqs, pa.int64()), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[*b.schema.names, "seq", "previous_event_hash", "event_hash"])

    rows = events.where(F.col(ledger).isNotNull() & F.col(order).isNotNull())
    placed = rows.repartition(ledger).sortWithinPartitions(ledger, order, "event_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return placed.mapInArrow(run, f"{schema}, seq long, previous_event_hash string, event_hash string")


def verify_rows(chain: DataFrame, ledger: str) -> DataFrame:
    """(ledger, seq, event_id, reason) of every event that breaks its chain."""
    before = chain.select(F.col(ledger).alias("_l"), (F.col("seq") + 1).alias("_s"), F.col("event_hash").alias("_hash"))
    linked = chain.join(before, (chain[ledger] == before["_l"]) & (chain["seq"] == before["_s"]), "left")
    reason = (
        F.when((F.col("seq") == 1) & F.col("previous_event_hash").isNotNull(), "genesis has a link")
        .when((F.col("seq") > 1) & ~F.col("previous_event_hash").eqNullSafe(F.col("_hash")), "broken link")
        .when(F.sha2(canonical(F.col("previous_event_hash")), 256) != F.col("event_hash"), "wrong hash")
    )
    return linked.withColumn("reason", reason).where("reason is not null").select(ledger, "seq", "event_id", "reason")


def verify(chain: DataFrame, ledger: str) -> DataFrame:
    """One row for each ledger: valid, number of events, and the first bad event with its reason."""
    bad = verify_rows(chain, ledger).groupBy(ledger).agg(F.min(F.struct("seq", "event_id", "reason")).alias("first"))
    counts = chain.groupBy(ledger).agg(F.count("*").alias("n_events"))
    return counts.join(bad, ledger, "left").select(ledger, F.col("first").isNull().alias("valid"), "n_events", F.col("first.event_id").alias("first_bad_id"), F.col("first.reason").alias("reason"))
