"""The same queries p1 to p6 in DuckDB's SQL."""

DIGITS = "upper(regexp_replace({}, '\\s', '', 'g'))"
COMMITS = f"""
  cm AS (SELECT left({DIGITS.format('statesum')}, 32) AS id, max({DIGITS.format('statesum')}) AS statesum, max(repo_id) AS repo_id, max(number) AS number
         FROM commits GROUP BY 1),
  refs AS (SELECT left({DIGITS.format('statesum')}, 32) AS id, received_at, unnest(parents) AS ref, generate_subscripts(parents, 1) - 1 AS pos FROM commits),
  edges AS (SELECT DISTINCT id, pos, left({DIGITS.format('ref')}, 32) AS parent FROM refs WHERE length({DIGITS.format('ref')}) > 0)
"""
WAY = f"""{COMMITS},
  way AS (
    SELECT repo_id, left({DIGITS.format('head')}, 32) AS id, 0 AS dist FROM repo_heads
    UNION ALL
    SELECT w.repo_id, e.parent, w.dist + 1 FROM way w JOIN edges e ON e.id = w.id AND e.pos = 0 JOIN cm ON cm.id = e.parent
  ),
  ch AS (
    SELECT w.repo_id, c.elt_id, upper(trim(c.op)) AS op, c.elt, w.dist, m.number, m.statesum,
           row_number() OVER (PARTITION BY w.repo_id, c.elt_id, w.dist ORDER BY c.received_at DESC) AS rn
    FROM changes c JOIN way w ON w.id = left({DIGITS.format('c.statesum')}, 32) JOIN cm m ON m.id = w.id
  )
"""
LATEST = f"""WITH RECURSIVE {WAY},
  last AS (SELECT *, row_number() OVER (PARTITION BY repo_id, elt_id ORDER BY dist) AS k FROM ch WHERE rn = 1)
"""
ORPHANS = f"""WITH {COMMITS},
  state AS (SELECT left({DIGITS.format('statesum')}, 32) AS id, arg_max(purged_at IS NOT NULL, received_at) AS gone FROM commits GROUP BY 1),
  r AS (
    SELECT 'commits' AS src, cm.repo_id, cm.statesum AS holder, CAST(e.pos AS BIGINT) AS pos, left({DIGITS.format('e.ref')}, 32) AS target, min(e.received_at) AS received_at
    FROM refs e JOIN cm ON cm.id = e.id WHERE length({DIGITS.format('e.ref')}) > 0 GROUP BY ALL
    UNION ALL
    SELECT 'snapshots', repo_id, CAST(ss AS VARCHAR), CAST(0 AS BIGINT), left({DIGITS.format('statesum')}, 32), min(received_at)
    FROM snapshots WHERE length({DIGITS.format('statesum')}) > 0 GROUP BY ALL
  ),
  lost AS (SELECT * FROM r WHERE target NOT IN (SELECT id FROM state WHERE NOT gone))
"""
TREE = f"""WITH RECURSIVE {COMMITS},
  up AS (SELECT cm.id, cm.statesum, e.parent FROM cm LEFT JOIN edges e ON e.id = cm.id AND e.pos = 0 AND e.parent IN (SELECT id FROM cm)),
  t AS (
    SELECT id, statesum, statesum AS root, CAST(0 AS BIGINT) AS depth, [statesum] AS path FROM up WHERE parent IS NULL
    UNION ALL
    SELECT u.id, u.statesum, t.root, t.depth + 1, list_append(t.path, u.statesum) FROM t JOIN up u ON u.parent = t.id
  )
"""
LOOPED = """
  looped AS (SELECT id, statesum, parent FROM up WHERE id NOT IN (SELECT id FROM t)),
  steps AS (
    SELECT id, parent AS anc, CAST(1 AS BIGINT) AS n FROM looped
    UNION ALL SELECT s.id, l.parent, s.n + 1 FROM steps s JOIN looped l ON l.id = s.anc WHERE s.n < (SELECT count(*) FROM looped)),
  walk AS (SELECT id, anc, min(n) AS distance FROM steps GROUP BY 1, 2)
"""
LAST_COPY = """SELECT * FROM (SELECT repo_id, elt_id, elt, {sum} AS elt_sum, left({state}, 32) AS statesum,
    row_number() OVER (PARTITION BY repo_id, elt_id ORDER BY received_at DESC) AS rn FROM {t}) WHERE rn = 1"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {COMMITS},
  reach AS (
    SELECT e.id, e.parent AS anc FROM edges e JOIN cm ON cm.id = e.parent
    UNION
    SELECT r.id, e.parent FROM reach r JOIN edges e ON e.id = r.anc JOIN cm ON cm.id = e.parent
  )
SELECT DISTINCT cm.repo_id, cm.statesum FROM reach JOIN cm USING (id) WHERE reach.anc = reach.id""",
    "p1_hierarchy": f"""{TREE}, {LOOPED},
  below AS (SELECT x AS statesum, count(*) - 1 AS n FROM (SELECT unnest(path) AS x FROM t) GROUP BY 1)
SELECT t.statesum, t.root, t.depth, t.path, below.n AS n_descendants, 'tree' AS status FROM t JOIN below USING (statesum)
UNION ALL
SELECT statesum, NULL, NULL, NULL, (SELECT count(*) FROM walk w WHERE w.anc = looped.id),
  CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.id = looped.id AND w.anc = looped.id) THEN 'cycle' ELSE 'below_cycle' END FROM looped""",
    "p1_descendants": f"""{TREE}, {LOOPED},
  x AS (SELECT statesum AS descendant, depth, unnest(path) AS statesum, generate_subscripts(path, 1) - 1 AS idx FROM t)
SELECT statesum, descendant, CAST(depth - idx AS BIGINT) AS distance FROM x WHERE idx < depth
UNION ALL SELECT a.statesum, d.statesum, w.distance FROM walk w JOIN cm a ON a.id = w.anc JOIN cm d ON d.id = w.id""",
    "p2_found": ORPHANS + "SELECT DISTINCT src, repo_id, holder, pos FROM lost",
    "p2_counts": ORPHANS + "SELECT src, strftime(received_at, '%Y-%m') AS month, count(*) AS n_orphans FROM lost GROUP BY 1, 2",
    "p2_rows": ORPHANS + f""", x AS (SELECT 'changes' AS src, left({DIGITS.format('statesum')}, 32) AS target, received_at FROM changes
    UNION ALL SELECT 'snapshots', left({DIGITS.format('statesum')}, 32), received_at FROM snapshots)
SELECT src, strftime(received_at, '%Y-%m') AS month, count(*) AS n_orphans FROM x
WHERE length(target) = 32 AND target NOT IN (SELECT id FROM state WHERE NOT gone) GROUP BY 1, 2""",
    "p3_found": """WITH s AS (
    SELECT * FROM (SELECT repo_id, ss, elt_id, elt, row_number() OVER (PARTITION BY repo_id, ss, elt_id ORDER BY received_at DESC) AS rn FROM snapshots) WHERE rn = 1),
  seq AS (SELECT repo_id, ss, lag(ss) OVER (PARTITION BY repo_id ORDER BY ss) AS prev FROM (SELECT DISTINCT repo_id, ss FROM snapshots)),
  new AS (SELECT s.repo_id, s.ss, s.elt_id, s.elt, 1 AS here FROM s JOIN seq USING (repo_id, ss) WHERE prev IS NOT NULL),
  old AS (SELECT s.repo_id, seq.ss, s.elt_id, s.elt, 1 AS here FROM s JOIN seq ON seq.repo_id = s.repo_id AND seq.prev = s.ss)
SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.ss, o.ss) AS ss, coalesce(n.elt_id, o.elt_id) AS elt_id,
       CASE WHEN o.here IS NULL THEN 'INS' WHEN n.here IS NULL THEN 'DEL' ELSE 'REPL' END AS op
FROM new n FULL JOIN old o ON n.repo_id = o.repo_id AND n.ss = o.ss AND n.elt_id = o.elt_id
WHERE n.here IS NULL OR o.here IS NULL OR n.elt IS DISTINCT FROM o.elt""",
    "p4_found": LATEST + "SELECT repo_id, elt_id, statesum FROM last WHERE k = 1 AND op <> 'DEL'",
    "p4_state": LATEST + "SELECT repo_id, elt_id, elt FROM last WHERE k = 1 AND op <> 'DEL'",
    "p5_found": f"""WITH n AS ({LAST_COPY.format(t='states_north', sum=DIGITS.format('elt_sum'), state=DIGITS.format('statesum'))}),
  s AS ({LAST_COPY.format(t='states_south', sum=DIGITS.format('elt_sum'), state=DIGITS.format('statesum'))}),
  j AS (SELECT coalesce(n.repo_id, s.repo_id) AS repo_id, coalesce(n.elt_id, s.elt_id) AS elt_id, n.rn AS nn, s.rn AS sn,
          n.elt IS DISTINCT FROM s.elt AS d_elt, n.elt_sum IS DISTINCT FROM s.elt_sum AS d_sum, n.statesum IS DISTINCT FROM s.statesum AS d_state
        FROM n FULL JOIN s ON n.repo_id = s.repo_id AND n.elt_id = s.elt_id)
SELECT repo_id, elt_id, 'missing_north' AS diff FROM j WHERE nn IS NULL
UNION ALL SELECT repo_id, elt_id, 'missing_south' FROM j WHERE sn IS NULL
UNION ALL SELECT repo_id, elt_id, 'elt' FROM j WHERE nn IS NOT NULL AND sn IS NOT NULL AND d_elt
UNION ALL SELECT repo_id, elt_id, 'elt_sum' FROM j WHERE nn IS NOT NULL AND sn IS NOT NULL AND d_sum
UNION ALL SELECT repo_id, elt_id, 'statesum' FROM j WHERE nn IS NOT NULL AND sn IS NOT NULL AND d_state""",
    "p6_found": f"""WITH RECURSIVE {WAY},
  o AS (SELECT *, op <> 'DEL' AS alive, lag(op <> 'DEL') OVER w AS was, lag(elt) OVER w AS was_elt FROM ch WHERE rn = 1
        WINDOW w AS (PARTITION BY repo_id, elt_id ORDER BY dist DESC)),
  ev AS (SELECT *, alive AND NOT (coalesce(was, false) AND elt IS NOT DISTINCT FROM was_elt) AS begins FROM o),
  nx AS (SELECT *, lead(number) OVER (PARTITION BY repo_id, elt_id ORDER BY dist DESC) AS until FROM ev WHERE begins OR (NOT alive AND coalesce(was, false)))
SELECT repo_id, elt_id, number AS from_number, coalesce(until, -1) AS to_number FROM nx WHERE begins""",
}
