"""Masked forms of detected values, for anything that leaves the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARD = ("credit_card", "bank_account")
KEY = ("api_key", "jwt_token", "aws_key")


def mask_value(value: Column, entity_type: Column) -> Column:
    n = F.length(value)
    tail = F.right(value, F.lit(4))
    parts = F.split(value, "@", -1)
    long_enough = n > 3
    return (
        F.when(
            entity_type.isin(*CARD),
            F.when(n >= 4, F.concat(F.lit("****-****-****-"), tail)).otherwise("****"),
        )
        .when(
            entity_type == "ssn",
            F.when(n >= 4, F.concat(F.lit("***-**-"), tail)).otherwise("***-**-****"),
        )
        .when(
            entity_type == "email",
            F.when(
                F.size(parts) == 2,
                F.concat(F.left(F.get(parts, F.lit(0)), F.lit(2)), F.lit("***@"), F.get(parts, F.lit(1))),
            ).otherwise("***@***"),
        )
        .when(
            entity_type.isin(*KEY),
            F.when(n > 12, F.concat(F.left(value, F.lit(8)), F.lit("..."), tail)).otherwise("****"),
        )
        .when(
            entity_type == "phone",
            F.when(
                n > 5, F.concat(F.left(value, F.lit(3)), F.lit("***"), F.right(value, F.lit(2)))
            ).otherwise("***"),
        )
        .otherwise(
            F.when(
                long_enough, F.concat(F.left(value, F.lit(3)), F.repeat(F.lit("*"), n - 3))
            ).otherwise("***")
        )
    )


def content_hash(text: Column, digits: int = 64) -> Column:
    """SHA-256 hex of the UTF-8 text, optionally a prefix of it."""
    full = F.sha2(F.encode(text, "UTF-8"), 256)
    return full if digits == 64 else F.left(full, F.lit(digits))
