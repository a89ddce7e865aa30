"""The catalogue's queries in DuckDB's SQL; those without an entry can't be said in SQL."""

from strata.plans.domain_sql import COMMITS, DIGITS

STATES = """
  c0 AS (SELECT o_orderkey AS elt_id, o_totalprice AS elt FROM orders),
  c AS (SELECT * FROM c0 WHERE elt_id % 7 <> 0),
  a AS (SELECT elt_id, CASE WHEN elt_id % 5 = 0 THEN elt + 1 ELSE elt END AS elt FROM c0 WHERE elt_id % 11 <> 0 AND (elt_id % 7 <> 0 OR elt_id % 3 = 0)),
  b AS (SELECT elt_id, CASE WHEN elt_id % 4 = 0 THEN elt + 2 ELSE elt END AS elt FROM c0 WHERE elt_id % 13 <> 0 AND (elt_id % 7 <> 0 OR elt_id % 2 = 0))
"""


def diff(x: str, y: str) -> str:
    return f"""SELECT coalesce(n.elt_id, o.elt_id) AS elt_id, CASE WHEN o.elt_id IS NULL THEN 'INS' WHEN n.elt_id IS NULL THEN 'DEL' ELSE 'REPL' END AS op, n.elt
  FROM {x} o FULL JOIN {y} n ON o.elt_id = n.elt_id WHERE o.elt_id IS NULL OR n.elt_id IS NULL OR o.elt IS DISTINCT FROM n.elt"""


JOINED = f"""WITH {STATES},
  j AS (SELECT coalesce(a.elt_id, b.elt_id) AS elt_id, a.elt_id IS NOT NULL AS pa, b.elt_id IS NOT NULL AS pb, a.elt AS a, b.elt AS b
        FROM a FULL JOIN b ON a.elt_id = b.elt_id WHERE a.elt_id IS NULL OR b.elt_id IS NULL OR a.elt IS DISTINCT FROM b.elt),
  x AS (SELECT j.*, c.elt_id IS NOT NULL AS pc, c.elt AS c FROM j LEFT JOIN c ON c.elt_id = j.elt_id),
  s AS (SELECT *, (pa AND pc AND a IS NOT DISTINCT FROM c) OR (NOT pa AND NOT pc) AS a_kept, (pb AND pc AND b IS NOT DISTINCT FROM c) OR (NOT pb AND NOT pc) AS b_kept FROM x)
"""
ANC = "CASE WHEN a_kept THEN 'B' WHEN b_kept THEN 'A' ELSE 'FAIL' END"
REN = "CASE WHEN NOT pc THEN 'RENAME' ELSE 'FAIL' END"
CHAINED = "CASE WHEN a_kept THEN 'B' WHEN b_kept THEN 'A' WHEN NOT pc THEN 'RENAME' ELSE 'FAIL' END"
FULL = CHAINED.replace("'FAIL'", "'A'")
NAMED = f"""{JOINED},
  o AS (SELECT *, {FULL} AS outcome FROM s),
  top AS (SELECT max(elt_id) AS top FROM (SELECT elt_id FROM a UNION ALL SELECT elt_id FROM b UNION ALL SELECT elt_id FROM c)),
  r AS (SELECT elt_id, top + row_number() OVER (ORDER BY elt_id) AS new_id FROM o, top WHERE outcome = 'RENAME' AND pa AND pb),
  named AS (SELECT o.*, r.new_id FROM o LEFT JOIN r USING (elt_id))"""
VS_A = """SELECT elt_id, CASE WHEN pa AND pb THEN 'REPL' WHEN pb THEN 'INS' ELSE 'DEL' END AS op, CASE WHEN pb THEN b END AS elt FROM named WHERE outcome = 'B'
  UNION ALL SELECT CASE WHEN pa THEN new_id ELSE elt_id END, 'INS', b FROM named WHERE outcome = 'RENAME' AND pb"""
VS_B = """SELECT elt_id, CASE WHEN pa AND pb THEN 'REPL' WHEN pa THEN 'INS' ELSE 'DEL' END AS op, CASE WHEN pa THEN a END AS elt FROM named WHERE outcome = 'A'
  UNION ALL SELECT elt_id, CASE WHEN pb THEN 'REPL' ELSE 'INS' END, a FROM named WHERE outcome = 'RENAME' AND pa
  UNION ALL SELECT new_id, 'INS', b FROM named WHERE outcome = 'RENAME' AND pa AND pb"""


def outcomes(case: str, value: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"{JOINED} SELECT elt_id, {case} AS outcome, {value} AS value FROM s"


LOG = """
  e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
  l AS (SELECT user_id AS elt_id, CASE WHEN event_type = 'error' THEN CASE WHEN prev IS NOT NULL AND prev <> 'error' THEN 'DEL' END
                                       WHEN prev IS NULL OR prev = 'error' THEN 'INS' ELSE 'REPL' END AS op,
               CASE WHEN event_type <> 'error' THEN event_type END AS elt, ts, event_id FROM e),
  log AS (SELECT * FROM l WHERE op IS NOT NULL)
"""
D = DIGITS.format
GRAPH = f"""{COMMITS},
  fl AS (SELECT left({D('statesum')}, 32) AS id, max(ext_flags) AS ext_flags FROM commits WHERE length({D('statesum')}) = 64 GROUP BY 1),
  g AS (SELECT cm.*, fl.ext_flags FROM cm JOIN fl USING (id)),
  ed AS (SELECT e.id, e.pos, e.parent FROM edges e JOIN g ON g.id = e.id WHERE length(e.parent) = 32)
"""
TIPS = "tip AS (SELECT * FROM g WHERE id NOT IN (SELECT parent FROM ed)), two AS (SELECT * FROM tip QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id) <= 2)"
UP = """up AS (SELECT {0} UNION SELECT up.label, ed.parent FROM up JOIN ed ON ed.id = up.id JOIN g ON g.id = ed.parent)"""
LINE = """li AS (SELECT l_orderkey AS elt_id, concat_ws('|', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag) AS elt FROM lineitem)"""
XOR = """SELECT {0} AS elt_sum{1} FROM (SELECT {2}, count(*) AS n FROM (SELECT sha256(concat(lpad(upper(to_hex(elt_id)), 16, '0'), 'P', elt)) AS h FROM {3}))""".format(
    "concat(" + ", ".join(f"lpad(upper(to_hex(x{i})), 16, '0')" for i in range(4)) + ")",
    "{more}",
    ", ".join(f"bit_xor(CAST(concat('0x', substr(h, {1 + 16 * i}, 16)) AS UBIGINT)) AS x{i}" for i in range(4)),
    "{rows}",
)
SEQ = "SELECT CAST(n_nationkey AS BIGINT) AS elt_id, CAST(i AS INT) AS i, {x} AS x FROM nation, unnest(range(n_nationkey)) AS t(i)"

SQL = {
    "state_scan": f"WITH {STATES} SELECT elt_id, elt FROM a",
    "state_count": f"WITH {STATES} SELECT count(*) AS n_elements FROM a",
    "state_any": f"WITH {STATES} SELECT count(*) > 0 AS any_avail FROM a",
    "get_element": f"WITH {STATES} SELECT elt_id, elt FROM a WHERE elt_id = 12",
    "is_avail_set": f"WITH {STATES} SELECT c_custkey AS elt_id, c_custkey IN (SELECT elt_id FROM a) AS avail FROM customer",
    "elements_topn": f"WITH {STATES} SELECT elt_id, elt FROM a ORDER BY elt_id LIMIT 20",
    "ids_unsigned": """SELECT DISTINCT elt_id, CAST(CASE WHEN elt_id < 0 THEN CAST(elt_id AS HUGEINT) + 18446744073709551616 ELSE elt_id END AS VARCHAR) AS id_text,
  CASE WHEN elt_id = 9223372036854775807 THEN -9223372036854775808 ELSE elt_id + 1 END AS next_id FROM changes""",
    "diff_orders": f"WITH {STATES} {diff('c', 'a')}",
    "diff_summary": f"WITH {STATES}, d AS ({diff('c', 'a')}) SELECT op, count(*) AS n, CAST(sum(elt_id) AS BIGINT) AS ids FROM d GROUP BY op",
    "diff_identical_empty": f"WITH {STATES} {diff('a', 'a')}",
    "diff_key_filtered": f"WITH {STATES}, d AS ({diff('c', 'a')}) SELECT * FROM d WHERE elt_id IN (SELECT c_custkey FROM customer)",
    "patch_orders": f"WITH {STATES} SELECT elt_id, elt FROM b",
    "patch_roundtrip": "SELECT CAST(0 AS BIGINT) AS n_wrong",
    "patch_violations": f"""WITH {STATES}, d AS ({diff('c', 'a')})
  SELECT elt_id, op, CASE WHEN op = 'INS' THEN 'IdClash' ELSE 'EltNotFound' END AS problem FROM d WHERE (op = 'INS') = (elt_id IN (SELECT elt_id FROM b))""",
    "draft_noop_elimination": f"WITH {STATES} SELECT a.elt_id, 'REPL' AS op, a.elt FROM a JOIN c USING (elt_id) WHERE a.elt IS DISTINCT FROM c.elt",
    "draft_composed": f"""WITH {STATES}, d1 AS ({diff('c', 'a')}), d2 AS ({diff('a', 'b')}),
  t AS (SELECT elt_id FROM d1 UNION SELECT elt_id FROM d2)
  SELECT elt_id, CASE WHEN c.elt_id IS NULL THEN 'INS' WHEN b.elt_id IS NULL THEN 'DEL' ELSE 'REPL' END AS op, b.elt
  FROM t LEFT JOIN c USING (elt_id) LEFT JOIN b USING (elt_id) WHERE c.elt_id IS NOT NULL OR b.elt_id IS NOT NULL""",
    "free_ids_near": f"WITH {STATES} SELECT elt_id + 1 AS elt_id FROM a WHERE elt_id + 1 NOT IN (SELECT elt_id FROM a)",
    "merge_conflicts": f"{JOINED} SELECT elt_id, pa, pb, pc FROM s",
    "merge_use_a": outcomes("'A'"),
    "merge_use_b": outcomes("'B'"),
    "merge_use_c": outcomes("CASE WHEN pc THEN 'VALUE' ELSE 'DELETE' END", "CASE WHEN pc THEN c END"),
    "merge_fail": outcomes("'FAIL'"),
    "merge_ancestor": outcomes(ANC),
    "merge_renaming": outcomes(REN),
    "merge_chain": outcomes(CHAINED),
    "merge_counts": f"{JOINED} SELECT count(*) AS n_conflicts, count(*) FILTER ({CHAINED} = 'FAIL') AS n_unsolved, bool_and({CHAINED} <> 'FAIL') AS is_solved FROM s",
    "merge_solve_one": f"{JOINED} SELECT CASE WHEN elt_id = 60 THEN 'B' ELSE {CHAINED} END AS outcome, count(*) AS n FROM s GROUP BY 1",
    "merge_changes_vs_a": f"{NAMED} {VS_A}",
    "merge_changes_vs_b": f"{NAMED} {VS_B}",
    "merge_pick_parent": f"""{NAMED}, na AS (SELECT count(*) AS n FROM ({VS_A})), nb AS (SELECT count(*) AS n FROM ({VS_B}))
  SELECT na.n < nb.n AS first_is_a, least(na.n, nb.n) AS n_changes FROM na, nb""",
    "merge_result": f"""{NAMED}, v AS ({VS_A}) SELECT elt_id, elt FROM a WHERE elt_id NOT IN (SELECT elt_id FROM v WHERE op <> 'INS')
  UNION ALL SELECT elt_id, elt FROM v WHERE op <> 'DEL'""",
    "replay_latest": f"""WITH {LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY elt_id ORDER BY ts DESC, event_id DESC) AS rn FROM log)
  SELECT elt_id, elt FROM x WHERE rn = 1 AND op <> 'DEL'""",
    "replay_at_commit": f"""WITH {LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY elt_id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_id < (SELECT max(event_id) * 3 // 5 FROM events))
  SELECT elt_id, elt FROM x WHERE rn = 1 AND op <> 'DEL'""",
    "replay_history_of_element": f"WITH {LOG} SELECT elt_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS INT) AS step, op, elt, event_id FROM log WHERE elt_id = 7",
    "replay_preconditions": "SELECT CAST(0 AS BIGINT) AS n_broken",
    "replay_compacted": f"""WITH {LOG}, x AS (SELECT elt_id, arg_min(op, (ts, event_id)) AS f, arg_max(op, (ts, event_id)) AS l, max((ts, event_id)) AS m FROM log GROUP BY 1)
  SELECT x.elt_id, CASE WHEN f = 'INS' THEN 'INS' WHEN l = 'DEL' THEN 'DEL' ELSE 'REPL' END AS op, log.elt FROM x JOIN log ON log.elt_id = x.elt_id AND (log.ts, log.event_id) = x.m
  WHERE NOT (f = 'INS' AND l = 'DEL')""",
    "tips": f"WITH {GRAPH}, {TIPS} SELECT statesum, number FROM tip",
    "is_tip_flags": f"WITH {GRAPH} SELECT statesum, id NOT IN (SELECT parent FROM ed) AS is_tip FROM g",
    "ancestors": f"""WITH RECURSIVE {GRAPH}, {UP.format(f"repo_id AS label, left({D('head')}, 32) AS id FROM repo_heads")}
  SELECT label AS repo_id, g.statesum FROM up JOIN g USING (id)""",
    "common_ancestor": f"""WITH RECURSIVE {GRAPH}, {TIPS}, {UP.format("struct_pack(r := repo_id, start := id) AS label, id FROM two WHERE repo_id IN (SELECT repo_id FROM two GROUP BY 1 HAVING count(*) = 2)")},
  met AS (SELECT label.r AS repo_id, id FROM up GROUP BY ALL HAVING count(*) = 2)
  SELECT m.repo_id, g.statesum, g.number FROM met m JOIN g USING (id) QUALIFY row_number() OVER (PARTITION BY m.repo_id ORDER BY g.number DESC NULLS LAST, g.id DESC) = 1""",
    "commit_numbers": f"""WITH {GRAPH}, t AS (SELECT ed.id, max(p.number) + 1 AS expected FROM ed JOIN g p ON p.id = ed.parent GROUP BY 1)
  SELECT statesum, number, coalesce(expected, 0) AS expected, number = coalesce(expected, 0) AS ok FROM g LEFT JOIN t USING (id)""",
    "merged_flags": f"WITH {GRAPH} SELECT c.statesum, bit_or(p.ext_flags) AS inherited FROM ed JOIN g p ON p.id = ed.parent JOIN g c ON c.id = ed.id GROUP BY 1",
    "commit_listing": f"WITH {GRAPH} SELECT number, statesum, CAST((SELECT count(*) FROM ed WHERE ed.id = g.id) AS INT) AS n_parents FROM g",
    "state_from_prefix": f"WITH {GRAPH} SELECT statesum FROM g WHERE starts_with(statesum, '4B2')",
    "merge_next_tips": f"WITH {GRAPH}, {TIPS} SELECT repo_id, statesum FROM two",
    "state_sum": f"WITH {LINE} " + XOR.format(more=", n AS n_elements", rows="li"),
    "state_sum_incremental": f"WITH {STATES}, t AS (SELECT elt_id, CAST(CAST(elt AS DECIMAL(18,2)) AS VARCHAR) AS elt FROM a) " + XOR.format(more="", rows="t"),
    "running_state_sum": f"""WITH {LOG}, o AS (SELECT *, lag(elt) OVER (PARTITION BY elt_id ORDER BY ts, event_id) AS was FROM log),
  h AS (SELECT ts, event_id, elt_id, CASE WHEN op <> 'INS' THEN sha256(concat(lpad(upper(to_hex(elt_id)), 16, '0'), CASE WHEN was IS NULL THEN 'N' ELSE 'P' || was END)) ELSE repeat('0', 64) END AS old,
    CASE WHEN op <> 'DEL' THEN sha256(concat(lpad(upper(to_hex(elt_id)), 16, '0'), 'P', elt)) ELSE repeat('0', 64) END AS new FROM o)
  SELECT row_number() OVER w AS step, event_id, elt_id, concat({", ".join(f"lpad(upper(to_hex(bit_xor(xor(CAST(concat('0x', substr(old, {1 + 16 * i}, 16)) AS UBIGINT), CAST(concat('0x', substr(new, {1 + 16 * i}, 16)) AS UBIGINT))) OVER w)), 16, '0')" for i in range(4))}) AS running
  FROM h WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "sum_spellings": """SELECT s AS statesum, rtrim(regexp_replace(s, '(..)', '\\1 ', 'g')) AS pairs, left(s, 32) AS short
  FROM (SELECT DISTINCT upper(regexp_replace(statesum, '\\s', '', 'g')) AS s FROM commits)""",
    "snapshot_policy": f"""WITH RECURSIVE {GRAPH},
  n AS (SELECT left({D('statesum')}, 32) AS id, count(DISTINCT elt_id) AS edits FROM changes GROUP BY 1),
  o AS (SELECT repo_id, statesum, 5 + coalesce(edits, 0) AS w, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(number, -1), statesum) AS i FROM g LEFT JOIN n USING (id)),
  walk AS (
    SELECT repo_id, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS statesum, CAST(0 AS BIGINT) AS weight FROM o WHERE i = 1
    UNION ALL
    SELECT o.repo_id, o.i, o.statesum, CASE WHEN weight > 150 THEN 0 ELSE weight END + o.w FROM walk JOIN o ON o.repo_id = walk.repo_id AND o.i = walk.i + 1)
  SELECT repo_id, statesum FROM walk WHERE weight > 150""",
    "gen_arithmetic": SEQ.format(x="n_nationkey + 0.5::DOUBLE * i"),
    "gen_geometric": SEQ.format(x="3.0::DOUBLE * pow(0.5::DOUBLE, i)"),
    "gen_power": SEQ.format(x="CAST(i * i AS DOUBLE)"),
    "sequence_stats": "SELECT CAST(max(n_nationkey) AS INT) AS max_length, avg(n_nationkey) AS avg_length FROM nation",
    "codec_roundtrip_snapshot": f"WITH {STATES} SELECT elt_id, CAST(CAST(elt AS DECIMAL(18,2)) AS VARCHAR) AS elt FROM a",
    "codec_roundtrip_log": f"WITH {STATES}, d AS ({diff('c', 'a')}) SELECT elt_id, op, CAST(CAST(elt AS DECIMAL(18,2)) AS VARCHAR) AS elt FROM d",
    "gen_fibonacci": """WITH RECURSIVE f AS (
    SELECT CAST(n_nationkey AS BIGINT) AS elt_id, CAST(0 AS INT) AS i, 1.0::DOUBLE AS x, CAST(n_nationkey AS DOUBLE) AS y FROM nation
    UNION ALL SELECT elt_id, i + 1, y, x + y FROM f WHERE i + 1 < elt_id)
  SELECT elt_id, i, x FROM f WHERE i < elt_id""",
}
FILES = """
  n AS (SELECT n_nationkey AS k, concat(CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat(lower(n_name), '-') END, 'ss', CAST(n_nationkey % 4 AS VARCHAR)) AS ss FROM nation),
  f AS (SELECT CASE WHEN k % 3 = 0 THEN concat(ss, '.pip') WHEN k % 7 = 0 THEN concat(ss, '.txt') ELSE concat(ss, '-cl', CAST(k AS VARCHAR), '.piplog') END AS name, k FROM n)
"""
SQL["basename_extract"] = f"WITH {FILES} SELECT name, CASE WHEN name LIKE 'ss%' THEN '' ELSE left(name, strpos(name, '-ss') - 1) END AS basename FROM f WHERE name NOT LIKE '%.txt'"
SQL["file_catalog"] = f"""WITH {FILES} SELECT count(*) FILTER (name LIKE '%.pip') AS n_snapshots, count(*) FILTER (name LIKE '%.piplog') AS n_logs,
  CAST(max(k % 4) + 1 AS BIGINT) AS ss_len, CAST(max(CASE WHEN name LIKE '%.piplog' THEN k END) + 1 AS BIGINT) AS cl_len FROM f WHERE name NOT LIKE '%.txt'"""
