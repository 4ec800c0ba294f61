"""DuckDB statement that must give the rows of the repeated passages of documents."""

LINE_REPEATS = r"""
WITH cut AS (
    SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(30), chr(31)), '([.!?][ \t\r\n]+|\n+|[。！？])', '\1' || chr(30), 'g'), chr(30))) AS part,
           generate_subscripts(string_split(regexp_replace(replace(text, chr(30), chr(31)), '([.!?][ \t\r\n]+|\n+|[。！？])', '\1' || chr(30), 'g'), chr(30)), 1) AS place
    FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
spans AS (
    SELECT doc_id, place, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain,
           sum(length(part)) OVER (PARTITION BY doc_id ORDER BY place) AS stop, length(part) AS size
    FROM cut),
units AS (
    SELECT doc_id, plain, stop - size AS start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS unit
    FROM spans WHERE plain <> ''),
groups AS (
    SELECT *, min(doc_id) OVER (PARTITION BY plain) < max(doc_id) OVER (PARTITION BY plain) AS again, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit) OVER w AS kept_unit
    FROM units WINDOW w AS (PARTITION BY plain ORDER BY doc_id, unit)),
runs AS (
    SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM groups WHERE again),
sizes AS (
    SELECT *, sum(greatest(length(plain) - length(replace(plain, ' ', '')) + 1, length(plain) // 8)) OVER (PARTITION BY doc_id, run) AS words FROM runs)
SELECT doc_id, unit::INT AS unit, start::INT AS start, stop::INT AS "end", doc_id = kept_doc_id AND unit = kept_unit AS kept, kept_doc_id, kept_unit::INT AS kept_unit
FROM sizes WHERE words >= 40
"""
