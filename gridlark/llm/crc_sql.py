"""CRC-32 in DuckDB SQL, which has none: the checksum is linear, so it is the XOR of what each byte gives at its place."""


def crc_tables(most: str) -> str:
    """CTEs for a ``WITH RECURSIVE``: ``crc_byte (k, b, v)``, what byte b gives with k bytes after it, and ``crc_start (k, v)``, what the start gives after k bytes. ``most``: a query of the largest byte count."""
    return f"""
crc_step(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM crc_step WHERE k < 8),
crc_base AS MATERIALIZED (SELECT b, v FROM crc_step WHERE k = 8),
crc_most AS MATERIALIZED (SELECT coalesce(({most}), 0) AS most),
crc_byte(k, b, v) AS (
  SELECT 0, b, v FROM crc_base
  UNION ALL SELECT t.k + 1, t.b, xor(t.v >> 8, c.v) FROM crc_byte t JOIN crc_base c ON c.b = t.v & 255 WHERE t.k + 1 < (SELECT most FROM crc_most)),
crc_start(k, v) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL SELECT t.k + 1, xor(t.v >> 8, c.v) FROM crc_start t JOIN crc_base c ON c.b = t.v & 255 WHERE t.k < (SELECT most FROM crc_most))"""


def crc_of(strings: str) -> str:
    """A query of ``s, crc`` for the distinct non-empty strings ``s`` of a table; needs the CTEs of :func:`crc_tables`."""
    return f"""
  SELECT s, xor(xor(x, z.v), 4294967295) AS crc FROM (
    SELECT s, any_value(n) AS n, bit_xor(t.v) AS x FROM (
      SELECT s, n, i, ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT AS b
      FROM (SELECT DISTINCT s, hex(encode(s)) AS hx, strlen(s) AS n FROM {strings}) q, unnest(range(n)) AS u(i)) e
    JOIN crc_byte t ON t.k = n - 1 - i AND t.b = e.b GROUP BY s) g
  JOIN crc_start z ON z.k = g.n"""
