"""SQL text shared by the oracles."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes as a DuckDB expression (bit by bit; for short texts)."""
    digits = f"hex(encode({text}))"
    byte = f"CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT)"
    # a byte is put in, then -1 stands for a step by one bit
    steps = f"flatten(list_transform(range(length({digits}) // 2), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, x: {step}), 4294967295)"
