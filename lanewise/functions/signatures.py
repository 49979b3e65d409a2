"""HMAC-SHA256 of signed carrier messages from Spark's own ``sha2``: two nested digests over the key's inner and outer pad.

The pads depend on the secret alone. Compute them on the carriers, a small table, before joining the messages.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = "sha256="
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C


def sign(body: bytes, secret: str) -> str:
    """The signature of one body, for senders."""
    return _PREFIX + hmac.new(secret.encode("utf-8"), body, hashlib.sha256).hexdigest()


def pads(secret: Column) -> tuple[Column, Column]:
    """(inner, outer) pad of a secret: its bytes, or their digest if they are more than a block, filled up with zeros, xor a constant."""
    key = F.when(F.octet_length(secret) > _BLOCK, F.sha2(secret.cast("binary"), 256)).otherwise(F.hex(secret.cast("binary")))
    filled = F.rpad(key, 2 * _BLOCK, "0")
    text = F.decode(F.unhex(filled), "ISO-8859-1")

    def pad(constant: int) -> Column:
        # all bytes by one table: each becomes the character U+0100 plus the byte wanted, two bytes in UTF-16, since U+0000 would be dropped
        wanted = F.translate(text, "".join(map(chr, range(256))), "".join(chr(256 + (b ^ constant)) for b in range(256)))
        return F.coalesce(F.unhex(F.regexp_replace(F.hex(F.encode(wanted, "UTF-16BE")), "01(..)", "$1")), F.lit(b""))

    return pad(_INNER), pad(_OUTER)


def signature(body: Column, inner: Column, outer: Column) -> Column:
    return F.concat(F.lit(_PREFIX), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256))


def signature_valid(body: Column, given: Column, inner: Column, outer: Column) -> Column:
    """True where ``given`` is ``sha256=`` and the HMAC-SHA256 of ``body`` under the secret of the pads; false if anything is NULL."""
    return F.coalesce(given == signature(body, inner, outer), F.lit(False))


def signed(body: Column, secret: Column) -> Column:
    """Signature of each body, for senders and test feeds."""
    return signature(body, *pads(secret))
