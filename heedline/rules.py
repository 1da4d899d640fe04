"""A deterministic stand-in for a classifier: it judges by the first digit of the content hash."""

import pandas as pd


def by_hash(batch: pd.DataFrame) -> pd.DataFrame:
    """'0' is blocked, '1' fails, '2' to '7' is billing, the rest personal."""
    digit = batch["content_hash"].str[0]
    category = digit.isin(list("234567")).map({True: "billing", False: "personal"})
    size = batch["text"].fillna("").str.len()
    if "content" in batch:
        size += batch["content"].map(lambda c: 0 if c is None else len(c)).astype(int)
    chars = size.astype(str)
    text = (
        '{"category":"' + category + '","intent":"info","frivolous":false,"broadcast":false,"obligation":'
        + (digit == "f").map({True: "true", False: "false"})
        + ',"critical":false,"sender":"rule","amount":null,"currency":null,"due_date":null,"clue":"'
        + chars + ' characters","code":null,"error":null}'
    )
    status = digit.map({"0": "blocked", "1": "failed"}).fillna("ok")
    error = ("refused " + batch["content_hash"].str[:8]).where(status != "ok", None)
    return pd.DataFrame({"status": status, "text": text.where(status == "ok", None), "error": error})
