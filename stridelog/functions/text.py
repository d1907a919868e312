"""Repair of text whose UTF-8 bytes were read as Windows-1252 or Latin-1, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printable Windows-1252 characters above U+00FF and the bytes they stand for.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = bytes(
    [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]
).decode("latin-1")
ESCAPE = "_x([0-9A-Fa-f]{4})_"
# Every character stands for one byte.
ALL_BYTES = rf"^[\x{{0}}-\x{{FF}}{CP1252_CHARS}]*$"
# A first and a second byte of a UTF-8 sequence. Text without such a pair has nothing to undo.
SEQUENCE_START = rf"[\x{{C2}}-\x{{F4}}][\x{{80}}-\x{{BF}}{CP1252_CHARS}]"


def resolve_escapes(text: Column) -> Column:
    """Replace each `_xHHHH_` by the character with that code point.

    JSON already has an escape for a code point, so the text goes through it: quote the value, turn
    the escapes into `\\uHHHH`, read the value back.
    """
    quoted = F.regexp_replace(F.to_json(F.struct(text.alias("v"))), ESCAPE, r"\\u$1")
    decoded = F.get_json_object(quoted, "$.v")
    return F.when(text.rlike(ESCAPE), F.coalesce(decoded, text)).otherwise(text)


def undo_misread(text: Column) -> Column:
    """Take the text back to its bytes and decode those as UTF-8; keep it where that fails.

    ASCII text (as many bytes as characters) is settled without a look at its characters. encode()
    raises on a character that has no byte, so it stays behind the tests.
    """
    suspect = (
        (F.octet_length(text) > F.char_length(text))
        & text.rlike(SEQUENCE_START)
        & text.rlike(ALL_BYTES)
    )
    single_bytes = F.encode(F.translate(text, CP1252_CHARS, CP1252_BYTES), "ISO-8859-1")
    decoded = F.when(suspect, F.try_validate_utf8(single_bytes.cast("string")))
    return F.coalesce(decoded, text)
