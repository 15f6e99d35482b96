"""Pieces of DuckDB text that several oracles of this folder share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """DuckDB has no crc32: eight shifts a byte, over the ASCII bytes of ``text``; null stays null."""
    eight = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {eight}, 4294967295::UBIGINT), 4294967295::UBIGINT)"
