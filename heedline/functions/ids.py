"""Short printable ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from heedline.functions.text import col, sha256_hex

_BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_LETTERS = "abcdefghijklmnopqrstuvwxyz234567"


def base32_hash(message_id: Column | str) -> Column:
    """base32 of sha256, lower case, unpadded: 52 characters.

    Ten hex digits are 40 bits, eight base-32 digits; the last four hex digits get one zero
    digit appended to make 20 bits, four base-32 digits.
    """
    digest = sha256_hex(col(message_id))
    pieces = [
        F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(6)
    ]
    tail = F.concat(F.substring(digest, 61, 4), F.lit("0"))
    pieces.append(F.lpad(F.conv(tail, 16, 32), 4, "0"))
    return F.translate(F.concat(*pieces), _BASE32_DIGITS, _BASE32_LETTERS)
