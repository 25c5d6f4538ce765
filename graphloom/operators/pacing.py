"""How long a client pauses between requests, replayed from a log of responses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Refusals and what they cost, answers and what they win back, bounds in seconds.
REFUSED, SLOWER, ANSWERED, FASTER, SHORTEST, LONGEST = (429, 403), 1.8, 200, 0.9, 5.0, 120.0
#: Responses worth another try, how many tries, the longest delay in seconds.
RETRIED, TRIES, DELAY = (500, 502, 503, 504, 522, 524, 408), 3, 30.0


def pauses(log: DataFrame, key: str) -> DataFrame:
    """key, client and pause after each response, from client, seq, status (and key).

    A refusal lengthens the pause, an answer shortens it, within bounds.  The bounds make this a
    fold in order, which no window function says; rows stream by sorted, and a client costs one
    number however long its log is.  A null client is one client; a null status changes nothing.
    """

    def run(batches):
        last, pause, begun = None, SHORTEST, False
        for batch in batches:
            out = []
            for client, status in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or client != last:
                    last, pause, begun = client, SHORTEST, True
                if status in REFUSED:
                    pause = min(pause * SLOWER, LONGEST)
                elif status == ANSWERED:
                    pause = max(pause * FASTER, SHORTEST)
                out.append(pause)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], [key, "client", "pause"])

    schema = log.select(key, "client").schema.add("pause", "double")
    return log.repartition("client").sortWithinPartitions("client", "seq").select(key, "client", "status").mapInArrow(run, schema)


def retry_delay(status: Column, tried: Column) -> Column:
    """Seconds before the next try, twice as many each time; null where none is due.  A random part of a second is left out, so that reruns agree."""
    return F.when(status.isin(*RETRIED) & (tried < TRIES), F.least(F.pow(F.lit(2.0), tried), F.lit(DELAY)))
