"""Derived inputs: the given tables with nulls, copies and scores added by expression."""

from wideloom.plans.registry import View

# Nulls in a numeric, a numeric with outliers and a text column; numbers kept as text.
DIRTY = View("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
       CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN l_discount * 1000 ELSE l_discount END AS disc,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_returnflag END AS flag,
       CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN NULL
            ELSE CONCAT(' ', CAST(l_linenumber AS VARCHAR(10)), ' ') END AS code,
       CASE WHEN l_orderkey % 20 <> 0 THEN NULL ELSE l_tax END AS sparse,
       1 AS fixed
FROM {lineitem}
""", "lineitem")

# Orders with one row in fifty repeated.
COPIES = View("""
SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey FROM {orders}
UNION ALL
SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey FROM {orders} WHERE o_orderkey % 50 = 0
""", "orders")

# Columns that depend on each other, with pairwise nulls and a constant.
RELATED = View("""
SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 + l_tax) AS gross,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity * 2 + l_linenumber END AS qty2,
       l_discount, l_tax, 5 AS fixed, l_returnflag, l_linestatus
FROM {lineitem}
""", "lineitem")

# Feature table for selection: nulls, a low-variance column, a numeric and a text target.
SELECTABLE = View("""
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey,
       l_extendedprice * 2 + l_linenumber AS price2,
       CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_linenumber END AS line,
       l_returnflag, l_linestatus,
       l_quantity * 3 + l_discount * 100 + l_orderkey % 5 AS y
FROM {lineitem}
""", "lineitem")

# Binary scores with many ties, plus a prediction.
SCORED = View("""
SELECT label, score, CASE WHEN score >= 0.45 THEN 1 ELSE 0 END AS prediction, part, l_orderkey, l_linenumber
FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, l_returnflag AS part, l_orderkey, l_linenumber,
             CAST((l_orderkey * 31 + l_linenumber * 17 + CASE WHEN l_linestatus = 'O' THEN 150 ELSE 0 END) % 1000 AS DOUBLE) / 1000 AS score
      FROM {lineitem}) s
""", "lineitem")

# Quality labels joined to document facts: another binary score.
LABELLED = View("""
SELECT l.doc_id, l.quality AS label, CAST(d.n_chars % 997 AS DOUBLE) / 997 AS score,
       CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END AS prediction
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
""", "labels", "documents")

# Three classes, predictions from arithmetic.
CLASSES = View("""
SELECT label, CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN (label + 1) % 3 ELSE label END AS prediction
FROM (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, l_orderkey, l_linenumber FROM {lineitem}) s
""", "lineitem")

# A regression prediction.
FITTED = View("""
SELECT l_extendedprice AS label, l_quantity * 1400 + l_discount * 1000 AS prediction, l_returnflag AS part FROM {lineitem}
""", "lineitem")

# Events read as an experiment log: several versions per id.
LOG = View("""
SELECT CONCAT('e', CAST(event_id % 4000 AS VARCHAR(20))) AS id, event_type AS table_name,
       CONCAT('p', CAST(user_id % 10 AS VARCHAR(20))) AS project_id,
       CONCAT('a', CAST(event_id % 3 AS VARCHAR(20))) AS source_agent,
       ts AS timestamp, props AS payload, event_id % 17 = 0 AS deleted, event_id
FROM {events}
""", "events")

# Events read as a run log: a session is a user.
RUNS = View("""
SELECT user_id AS session, event_id,
       CASE event_id % 8 WHEN 0 THEN 'ingestion' WHEN 1 THEN 'profiling' WHEN 2 THEN 'cleaning' WHEN 3 THEN 'selection'
            WHEN 4 THEN 'features' WHEN 5 THEN 'modeling' WHEN 6 THEN 'evaluation' ELSE 'report' END AS phase,
       event_type <> 'error' AND (user_id + event_id) % 3 = 0 AS success, ts
FROM {events}
""", "events")
