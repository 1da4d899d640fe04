"""The part of classification that runs inside Python workers; it imports no Spark."""

import time
from collections.abc import Callable, Iterator

import pandas as pd

Classify = Callable[[pd.DataFrame], pd.DataFrame]

NO_TEXT = "classifier returned no text"

# Columns of a task that come back next to its answer.
KEPT_COLUMNS = ["content_hash", "type", "message_id", "sender", "subject", "label"]


def _attempt(classify: Classify, batch: pd.DataFrame) -> pd.DataFrame:
    """One try.  An exception fails every row of the batch, never the Spark task."""
    try:
        out = classify(batch).reindex(batch.index)
    except Exception as e:  # noqa: BLE001 - any classifier fault becomes a row outcome
        return pd.DataFrame({"status": "failed", "text": None, "error": str(e)}, index=batch.index)
    out = out.reindex(columns=["status", "text", "error"]).astype(object)
    out = out.where(out.notna(), None)
    silent = (out["status"] == "ok") & ~out["text"].fillna("").astype(bool)
    out.loc[silent, ["status", "error"]] = ["failed", NO_TEXT]
    return out


def call_in_batches(classify: Classify, attempts: int, delay: float):
    """mapInPandas body: bounded attempts with a linearly growing pause.

    Only rows that are not 'ok' are tried again; the last outcome stands.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = _attempt(classify, batch)
            for n in range(1, attempts):
                open_rows = result.index[result["status"] != "ok"]
                if open_rows.empty:
                    break
                time.sleep(delay * n)
                result.loc[open_rows] = _attempt(classify, batch.loc[open_rows])
            yield batch[KEPT_COLUMNS].assign(
                outcome=result["status"],
                reply=result["text"].where(result["status"] == "ok", None),
                call_error=result["error"],
            )

    return run
