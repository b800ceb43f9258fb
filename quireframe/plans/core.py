"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireframe.functions import notations as n
from quireframe.operators.periods import periods_and_gaps
from quireframe.operators.wide import Attribute, cells_of, to_wide
from quireframe.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "text_region"), ["book_id", "rclass_id"], "r_start", "r_end")


#: The attributes of a book, by class.
BOOK = {
    101: Attribute("title", n.text, "string"),
    102: Attribute("author", n.text, "string"),
    103: Attribute("year", n.year, "int"),
    104: Attribute("volumes", n.count, "int"),
    105: Attribute("issued", n.day, "date"),
    106: Attribute("plates", n.truth, "boolean"),
    107: Attribute("height", n.centimetres, "decimal(8,1)"),
    108: Attribute("dedication", n.text, "string"),
    109: Attribute("publisher", n.text, "string"),
}


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_wide(table(spark, sf_dir, "book_metadata"), "book_id", "rclass_id", "content", "loaded_at", BOOK)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(p4_wide(spark, sf_dir), "book_id", BOOK, "rclass_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p4_found, p4_wide)}

_READ = r"""
WITH raw AS (SELECT book_id, rclass_id, loaded_at,
    trim(regexp_replace(translate(content, '０１２３４５６７８９．，－／：＋', '0123456789.,-/:+'), '[\s\p{Z}]+', ' ', 'g')) AS v,
    trim(regexp_replace(content, '[\s\p{Z}]+', ' ', 'g')) AS plain
  FROM book_metadata WHERE book_id IS NOT NULL AND rclass_id BETWEEN 101 AND 109),
low AS (SELECT *, lower(v) AS l, regexp_replace(upper(v), '\.$', '') AS u,
    regexp_extract(lower(v), '^(?:in )?([a-z]+|[0-9]{1,4})(?:[.,]0+)?(?: ?(?:v|vols?|volumes?)\.?)?$', 1) AS core FROM raw),
rom AS (SELECT *, CASE WHEN rclass_id = 103 THEN u ELSE upper(core) END AS r FROM low),
num AS (SELECT *, CASE WHEN r <> '' AND regexp_full_match(r, 'M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})') THEN
    list_sum(list_transform(range(1, length(r) + 1), lambda i:
      CASE WHEN i < length(r) AND (CASE r[i] WHEN 'M' THEN 1000 WHEN 'D' THEN 500 WHEN 'C' THEN 100 WHEN 'L' THEN 50 WHEN 'X' THEN 10 WHEN 'V' THEN 5 ELSE 1 END)
        < (CASE r[i+1] WHEN 'M' THEN 1000 WHEN 'D' THEN 500 WHEN 'C' THEN 100 WHEN 'L' THEN 50 WHEN 'X' THEN 10 WHEN 'V' THEN 5 ELSE 1 END) THEN -1 ELSE 1 END
      * (CASE r[i] WHEN 'M' THEN 1000 WHEN 'D' THEN 500 WHEN 'C' THEN 100 WHEN 'L' THEN 50 WHEN 'X' THEN 10 WHEN 'V' THEN 5 ELSE 1 END)))::INT END AS roman FROM rom),
dat AS (SELECT *, CASE
    WHEN regexp_matches(l, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(t.*)?$') THEN regexp_replace(l, 't.*$', '')
    WHEN regexp_matches(l, '^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$') THEN replace(l, '/', '-')
    WHEN regexp_matches(l, '^[0-9]{8}$') THEN l[1:4] || '-' || l[5:6] || '-' || l[7:8]
    WHEN regexp_matches(l, '^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$') THEN split_part(l, '.', 3) || '-' || split_part(l, '.', 2) || '-' || split_part(l, '.', 1)
    WHEN regexp_matches(l, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN
      CASE WHEN split_part(l, '/', 1)::INT > 12 OR split_part(l, '/', 1)::INT = split_part(l, '/', 2)::INT THEN split_part(l, '/', 3) || '-' || split_part(l, '/', 2) || '-' || split_part(l, '/', 1)
        WHEN split_part(l, '/', 2)::INT > 12 THEN split_part(l, '/', 3) || '-' || split_part(l, '/', 1) || '-' || split_part(l, '/', 2) END
    WHEN regexp_matches(l, '^[0-9]{1,2} [a-z]+\.? [0-9]{4}$') THEN split_part(l, ' ', 3) || '-' || ((instr('janfebmaraprmayjunjulaugsepoctnovdec', split_part(l, ' ', 2)[1:3]) + 2) // 3) || '-' || split_part(l, ' ', 1)
    WHEN regexp_matches(l, '^[a-z]+ [0-9]{1,2},? [0-9]{4}$') THEN split_part(l, ' ', 3) || '-' || ((instr('janfebmaraprmayjunjulaugsepoctnovdec', split_part(l, ' ', 1)[1:3]) + 2) // 3) || '-' || replace(split_part(l, ' ', 2), ',', '')
  END AS d FROM num),
cm AS (SELECT *, regexp_extract(l, '^\+?([0-9]{1,4}(?:[.,][0-9]+)?) ?½? ?(?:cm|mm|m)?$', 1) AS h FROM dat),
cell AS (SELECT book_id, rclass_id, loaded_at, CASE
    WHEN rclass_id IN (101, 102, 108, 109) THEN CASE WHEN regexp_matches(plain, '[\p{L}\p{N}]') AND lower(plain) NOT IN ('n/a', 'n.a.', 'unknown', 'none', 'null', 'nil', 'tbd', 'missing', 'not known', 'not available', 'not given', 'no data') THEN plain END
    WHEN rclass_id = 103 THEN coalesce(nullif(regexp_extract(l, '^(?:published |a\.d\. )?[\[(]?([0-9]{4})[\])]?\.?$', 1), ''), CASE WHEN roman >= 1000 THEN roman::VARCHAR END)
    WHEN rclass_id = 104 THEN (CASE WHEN regexp_full_match(core, '[0-9]+') THEN core::INT WHEN core = 'one' THEN 1 WHEN core = 'two' THEN 2 WHEN core = 'three' THEN 3 WHEN core = 'four' THEN 4 WHEN core = 'five' THEN 5 WHEN core = 'six' THEN 6
      WHEN core = 'seven' THEN 7 WHEN core = 'eight' THEN 8 WHEN core = 'nine' THEN 9 WHEN core = 'ten' THEN 10 WHEN core = 'eleven' THEN 11 WHEN core = 'twelve' THEN 12 ELSE roman END)::VARCHAR
    WHEN rclass_id = 105 THEN try_cast(d AS DATE)::VARCHAR
    WHEN rclass_id = 106 THEN CASE WHEN l IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN l IN ('false', 'f', 'no', 'n', '0') THEN 'false' END
    WHEN h <> '' THEN round((replace(h, ',', '.')::DECIMAL(12,6) + CASE WHEN contains(l, '½') THEN 0.5 ELSE 0 END) * CASE WHEN l LIKE '%mm' THEN 0.1 WHEN l LIKE '%cm' THEN 1 WHEN l LIKE '%m' THEN 100 ELSE 1 END, 1)::DECIMAL(8,1)::VARCHAR
  END AS cell FROM cm),
found AS (SELECT book_id, rclass_id, arg_max(cell, loaded_at) AS cell FROM cell WHERE cell IS NOT NULL GROUP BY book_id, rclass_id)
"""

SQL: dict[str, str] = {
    "p4_found": _READ + "SELECT book_id, rclass_id, cell FROM found",
    "p4_wide": _READ + """
SELECT b.book_id, max(cell) FILTER (rclass_id = 101) AS title, max(cell) FILTER (rclass_id = 102) AS author,
  (max(cell) FILTER (rclass_id = 103))::INT AS year, (max(cell) FILTER (rclass_id = 104))::INT AS volumes, (max(cell) FILTER (rclass_id = 105))::DATE AS issued,
  (max(cell) FILTER (rclass_id = 106))::BOOLEAN AS plates, (max(cell) FILTER (rclass_id = 107))::DECIMAL(8,1) AS height,
  max(cell) FILTER (rclass_id = 108) AS dedication, max(cell) FILTER (rclass_id = 109) AS publisher
FROM (SELECT DISTINCT book_id FROM book_metadata WHERE book_id IS NOT NULL) b LEFT JOIN found f ON f.book_id = b.book_id GROUP BY b.book_id
""",
    "p1_found": """
WITH x AS (SELECT DISTINCT book_id, rclass_id, r_start AS a, r_end AS z FROM text_region WHERE r_end > r_start),
y AS (SELECT *, max(z) OVER (PARTITION BY book_id, rclass_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM x),
w AS (SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, rclass_id ORDER BY a, z) AS g FROM y),
p AS (SELECT book_id, rclass_id, g, min(a) AS a, max(z) AS z FROM w GROUP BY book_id, rclass_id, g),
q AS (SELECT *, lag(z) OVER (PARTITION BY book_id, rclass_id ORDER BY a) AS pz FROM p)
SELECT book_id, rclass_id, 'period' AS kind, a AS span_start, z AS span_end FROM p
UNION ALL
SELECT book_id, rclass_id, 'gap' AS kind, pz AS span_start, a AS span_end FROM q WHERE pz IS NOT NULL
""",
}
