"""Verification of hash-chained ledgers as a stream: state is (count, head) a ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.ledger import GENESIS, digest


def _verdicts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Entries come in order, batch by batch; what is kept is the count and the head."""
    count, head = state.get if state.exists else (0, GENESIS)
    for rows in batches:
        out = []
        for r in rows.itertuples():
            error = None
            if not r.type or not r.payload or r.seq != count:
                error = "InvalidEntry"
            elif r.prev != head:
                error = "BrokenChain"
            elif r.hash != digest(r.payload, r.prev, r.seq, r.t, r.type):
                error = "TamperedEntry"
            count, head = count + 1, r.hash
            out.append((key[0], r.seq, error, head))
        yield pd.DataFrame(out, columns=["ledger", "seq", "error", "head"])
    state.update((count, head))


def verified(entries: DataFrame) -> DataFrame:
    """(ledger, seq, error, head) for a stream of entries (ledger, seq, prev, type, payload,
    t, hash) that arrive in order; error is null for a good entry."""
    return entries.groupBy("ledger").applyInPandasWithState(
        _verdicts, "ledger long, seq long, error string, head string", "count long, head string", "append", GroupStateTimeout.NoTimeout
    )
