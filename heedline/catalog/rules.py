"""What ``heedline.rules.by_hash`` and the fallback records make of a task, as SQL.

Over expressions for the content hash, text length, sender, clue and error.
"""


def reply_sql(h: str, n: str) -> str:
    return (
        f"""'{{"category":"' || case when left({h},1) in ('2','3','4','5','6','7') then 'billing' else 'personal' end """
        f"""|| '","intent":"info","frivolous":false,"broadcast":false,"obligation":' || case when left({h},1) = 'f' then 'true' else 'false' end """
        f"""|| ',"critical":false,"sender":"rule","amount":null,"currency":null,"due_date":null,"clue":"' || {n} || ' characters","code":null,"error":null}}'"""
    )


def _record_sql(category: str, broadcast: str, sender: str, clue: str, error: str) -> str:
    return (
        f"""'{{"category":"{category}","intent":"info","frivolous":true,"broadcast":{broadcast},"obligation":false,"critical":false,"sender":' """
        f"""|| to_json({sender}) || ',"amount":null,"currency":null,"due_date":null,"clue":' || to_json({clue}) || ',"code":null,"error":' || {error} || '}}'"""
    )


def blocked_sql(sender: str, clue: str) -> str:
    return _record_sql("newsletter", "true", sender, f"left({clue},42)", "'null'")


def failure_sql(sender: str, clue: str, error: str) -> str:
    return _record_sql("other", "false", sender, f"left({clue},42)", f"to_json({error})")
