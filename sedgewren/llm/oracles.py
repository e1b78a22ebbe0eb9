"""SQL with which the driver checks those training-data queries that SQL can express."""

_P5 = r"""
WITH l AS (
  SELECT id, source, i AS line_no,
         regexp_replace(string_split(text_content, chr(10))[i], '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g') AS c
  FROM (SELECT id, source, text_content, unnest(range(1, len(string_split(text_content, chr(10))) + 1)) AS i FROM law_chunk WHERE text_content IS NOT NULL AND source IS NOT NULL)
), f AS (
  SELECT * FROM l WHERE length(c) >= 4 AND c NOT IN ('【案件基本信息】', '【基本案情】', '【案件焦点】', '【法院裁判要旨】', '【法官后语】')
), n AS (SELECT source, c, count(DISTINCT id) AS n FROM f GROUP BY source, c),
s AS (SELECT source, count(*) AS docs FROM law_chunk WHERE source IS NOT NULL GROUP BY source),
k AS (SELECT n.source, n.c FROM n JOIN s ON n.source = s.source WHERE n.n >= 5 AND n.n >= 0.2 * s.docs)
"""

ORACLES: dict[str, str] = {
    "p5_found": _P5 + "SELECT CAST(f.id AS INTEGER) AS chunk_id, CAST(f.line_no AS INTEGER) AS line_no FROM f JOIN k ON f.source = k.source AND f.c = k.c",
}
