"""Parts of SQL that several operators' checks share."""

#: A common table expression ``crc`` with the 256 steps of CRC-32 as the list ``crc_table``.
CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(step ORDER BY i) AS crc_table FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS step FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, where ``crc`` is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
