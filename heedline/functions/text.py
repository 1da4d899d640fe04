"""Text, hash and address expressions."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from heedline import constants as C

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Without it every use repeats the whole expression, and nested ones outgrow code generation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(name: str, value: str, body: str) -> str:
    """The same as SQL text: ``body`` sees ``value`` under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def filled(c: Column | str) -> Column:
    """The value unless it is '' (or NULL)."""
    return F.nullif(col(c), F.lit(""))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(C.WHITESPACE))


def left(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def clip(c: Column | str, n: int) -> Column:
    """First ``n`` characters, with an ellipsis where something was cut."""
    text = or_empty(c)
    return F.when(F.length(text) > n, F.concat(left(text, n), F.lit("…"))).otherwise(text)


# ---- search -------------------------------------------------------------------------------


def ascii_lower(c: Column | str) -> Column:
    """Fold A-Z only, so accented letters stay case-sensitive."""
    return F.translate(col(c), _UPPER, _UPPER.lower())


def like_contains(c: Column | str, term: str) -> Column:
    """``LIKE '%term%'`` with ASCII case folding; ``%`` and ``_`` in the term are wildcards."""
    folded = term.translate(str.maketrans(_UPPER, _UPPER.lower()))
    if "%" not in folded and "_" not in folded:
        return F.contains(ascii_lower(c), F.lit(folded))
    pattern = folded.replace("\\", "\\\\")
    return ascii_lower(c).like(f"%{pattern}%")


def like_prefix(c: Column | str, prefix: Column) -> Column:
    """``c LIKE prefix || '%'``, same folding, for a prefix held in a column."""
    pattern = F.replace(ascii_lower(prefix), F.lit("\\"), F.lit("\\\\"))
    return F.like(ascii_lower(c), F.concat(pattern, F.lit("%")))


# ---- message bodies -----------------------------------------------------------------------


def any_body(text: Column | str, html: Column | str, snippet: Column | str) -> Column:
    return F.coalesce(filled(text), filled(html), filled(snippet))


def has_body(text: Column | str, html: Column | str, snippet: Column | str) -> Column:
    return any_body(text, html, snippet).isNotNull()


def effective_body(text: Column | str, html: Column | str, snippet: Column | str) -> Column:
    return F.coalesce(any_body(text, html, snippet), F.lit(""))


def not_sent(labels: Column | str) -> Column:
    """Keep received mail; a message without labels is kept too."""
    sent = F.exists(col(labels), lambda x: F.upper(x) == "SENT")
    return ~F.coalesce(sent, F.lit(False))


def canonical_text(sender: Column | str, subject: Column | str, body: Column | str) -> Column:
    """The exact text a message is classified and hashed by, the whole body included (H1)."""

    def header_line(name: str, value: Column | str) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), filled(value), F.lit("\n")), F.lit(""))

    return strip(
        F.concat(header_line("From", sender), header_line("Subject", subject), F.lit("\n"), or_empty(body))
    )


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def message_hash(sender: Column | str, subject: Column | str, body: Column | str) -> Column:
    """Content hash of a message, NULL when there is nothing to classify (H2)."""
    return sha256_hex(filled(canonical_text(sender, subject, body)))


def body_hash() -> Column:
    """H2 over the columns of the messages table."""
    body = effective_body("body_text", "body_html", "snippet")
    return message_hash("from_addr", "subject", body)


# ---- addresses ----------------------------------------------------------------------------


def sender_name(sender: Column | str) -> Column:
    """Name part of an address, else 'unknown'; what stored records hold."""
    name = strip(F.substring_index(or_empty(sender), "<", 1))
    return F.coalesce(filled(F.btrim(name, F.lit('"'))), F.lit("unknown"))


def display_sender(sender: Column | str) -> Column:
    """``sender_name`` for display, at most 40 characters (H4)."""
    return left(sender_name(sender), C.SENDER_MAX_CHARS)


def row_sender(sender: Column | str, label: Column | str) -> Column:
    """Sender shown on a row: name part, else the raw value, else the label (H4 variant)."""
    raw = F.coalesce(filled(sender), filled(label), F.lit(""))
    name = F.btrim(strip(F.substring_index(raw, "<", 1)), F.lit('"'))
    return F.coalesce(filled(name), raw)


def sender_domain(sender: Column | str) -> Column:
    """Domain of a mail address, lower case (H5)."""
    raw = or_empty(sender)
    bracketed = F.regexp_extract(raw, "<([^>]+)>", 1)
    email = F.coalesce(filled(bracketed), strip(raw))
    domain = F.lower(F.substring_index(email, "@", -1))
    return F.when(F.contains(email, F.lit("@")), domain).otherwise(C.UNKNOWN_DOMAIN)


# One address, optionally with a display name before or a comment after it.
_ONE_ADDRESS = (
    r'^\s*(?:(?:"(?:[^"\\]|\\.)*"|[^<>,;:"()@])*<\s*([^<>\s]+)\s*>'
    r"|([^<>\s,;:\"()]+(?:@[^<>\s,;:\"()]+)?)\s*\([^()]*\)"
    r"|([^<>\s,;:\"()]+))\s*$"
)


def reply_address(sender: Column | str) -> Column:
    """Bare address to answer to; text that is not one address is used as it is (H9)."""
    raw = or_empty(sender)
    groups = [filled(F.regexp_extract(raw, _ONE_ADDRESS, i)) for i in (1, 2, 3)]
    return F.coalesce(*groups, raw)


def reply_subject(subject: Column | str) -> Column:
    text = F.coalesce(filled(subject), F.lit("(no subject)"))
    return F.when(F.startswith(F.lower(text), F.lit("re:")), text).otherwise(
        F.concat(F.lit("Re: "), text)
    )


# ---- document names and paths -------------------------------------------------------------


def is_document_name(filename: Column | str) -> Column:
    """Name ends in one of the document extensions, any case."""
    lowered = F.lower(or_empty(filename))
    tests = [F.endswith(lowered, F.lit(ext)) for ext in C.DOC_EXTENSIONS]
    return tests[0] | tests[1] | tests[2] | tests[3]


# The last path component, and the split of it into stem and suffix: the suffix starts at the
# last dot, which must be neither the first nor the last character.
_LAST_COMPONENT = r"^(?:.*/)?(?!\.?(?:/|$))([^/]+?)(?:/+\.?)*$"
_STEM_SUFFIX = r"(?s)^(.+)(\.[^.]+)$"


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(or_empty(path), "(?s)" + _LAST_COMPONENT, 1)


def path_suffix(path: Column | str) -> Column:
    """Lower-case suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), _STEM_SUFFIX, 2))


def path_stem(path: Column | str) -> Column:
    name = base_name(path)
    return F.coalesce(filled(F.regexp_extract(name, _STEM_SUFFIX, 1)), name)


def is_pdf_path(path: Column | str) -> Column:
    return F.coalesce(path_suffix(path) == ".pdf", F.lit(False))


def with_suffix(path: Column | str, suffix: str) -> Column:
    """The path with its last component's suffix replaced."""
    replaced = F.regexp_replace(col(path), r"(?<=[^/])\.[^./]+$", "")
    return F.concat(replaced, F.lit(suffix))


def document_path(
    wall: Column,
    sender: Column | str,
    message_id: Column | str,
    filename: Column | str,
    content_hash: Column | str,
) -> Column:
    """Relative path of a stored attachment: month/domain/day-domain-id-stem-hash.ext.

    Id, stem and content hash stand in full, so different contents never share a path.
    """
    domain = sender_domain(sender)
    stem = F.translate(path_stem(filename), C.UNSAFE_PATH_CHARS, "_" * 9)
    ext = F.coalesce(filled(path_suffix(filename)), F.lit(".bin"))
    whole_id = F.translate(F.coalesce(col(message_id), F.lit("unknown")), C.UNSAFE_PATH_CHARS, "_" * 9)
    day = F.date_format(wall, "yyyyMMdd")
    file = F.concat(F.concat_ws("-", day, domain, whole_id, stem, col(content_hash)), ext)
    return F.concat_ws("/", F.date_format(wall, "yyyy-MM"), domain, file)


# ---- encodings ----------------------------------------------------------------------------


def from_base64url(c: Column | str) -> Column:
    """URL-safe base64 text to bytes; NULL when it is not base64."""
    standard = F.replace(F.replace(col(c), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.try_to_binary(standard, F.lit("base64"))


def utf8(c: Column) -> Column:
    """Bytes to text, bad sequences replaced by U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


# ---- model names --------------------------------------------------------------------------


def model_label(model: Column | str) -> Column:
    return (
        F.when(col(model) == C.MODEL_FLASH_LITE, "Flash Lite")
        .when(col(model) == C.MODEL_FLASH, "Flash")
        .otherwise("Pro")
    )


def cache_key(model: str, gist: bool = True) -> str:
    return f"{model}{C.GIST_SUFFIX}" if gist else model


def is_gist_model(model: Column | str) -> Column:
    return F.endswith(F.lower(col(model)), F.lit(C.GIST_SUFFIX))


def model_matches(model: Column | str, key: str, gist: bool) -> Column:
    """Rows that count as "analysed": any gist model, or exactly one plain key."""
    return is_gist_model(model) if gist else ascii_lower(model) == ascii_lower(F.lit(key))
