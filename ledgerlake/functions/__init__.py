from ledgerlake.functions.text import (
    clean_amount,
    clean_merchant,
    fingerprint,
    looks_like_person,
    norm_key,
    parse_date,
    preprocess_text,
    text_variants,
    upi_merchant,
    with_merchant,
)

__all__ = [
    "clean_amount",
    "clean_merchant",
    "fingerprint",
    "looks_like_person",
    "norm_key",
    "parse_date",
    "preprocess_text",
    "text_variants",
    "upi_merchant",
    "with_merchant",
]
