"""Queries through repositories, stores of the binary format and the small functions, with the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import meta, sequences, sums, text
from strata.operators import changes, dag, merge
from strata.plans.catalogue import FULL, _found, state, table, three
from strata.plans.catalogue_sql import DIGITS, JOINED, NAMED, STATES, VS_A, diff
from strata.repository import Config, Repository
from strata.scratch import Scratch
from strata.sources import codec, files

# ---- repositories ----


def _repository(spark, d, *branches: str) -> tuple[Repository, list[str]]:
    """Ancestor C as the first commit, then each of the states named on top of it."""
    ticks = iter(range(946684800, 10**10, 3600))
    config = Config(clock=lambda: next(ticks))
    root = Scratch(spark).root + "/repository"
    repo = Repository.create(spark, root, "orders", "double", config=config)
    first = repo.draft().insert(state(spark, d, "C")).push()
    repo.write_full()
    made = [first]
    for which in branches:
        delta = Scratch(spark).cut(changes.diff(state(spark, d, "C"), state(spark, d, which)))
        draft = repo.draft(first)
        for op, step in (("INS", draft.insert), ("REPL", draft.replace), ("DEL", draft.remove)):
            step(delta.where(F.col("op") == op))
        made.append(draft.push())
    repo.write_fast()
    return Repository.open(spark, root, name="orders", config=config), made


def repo_states(spark, d):
    """The first state by a prefix of its sum, and the tip, as a reader of the written repository sees them."""
    repo, made = _repository(spark, d, "A")
    then, now = repo.state(made[0][:12]), repo.state()
    return then.select(F.lit("C").alias("state"), "elt_id", "elt").unionByName(now.select(F.lit("A").alias("state"), "elt_id", "elt"))


def repo_commits(spark, d):
    repo, _ = _repository(spark, d, "A", "B")
    return repo.states().select("number", "n_changes", F.size("parents").alias("n_parents"), "is_tip")


def repo_merged(spark, d):
    """The tip after the two tips of the repository were merged."""
    repo, _ = _repository(spark, d, "A", "B")
    repo.merge(FULL)
    repo.write_full()
    return repo.state()


# ---- files of the binary format ----


def _bytes(spark, d, which) -> DataFrame:
    return state(spark, d, which).select("elt_id", F.encode(F.col("elt").cast("decimal(18,2)").cast("string"), "utf-8").alias("data"))


def _exported(spark, d) -> files.HadoopFiles:
    """C and A as snapshots 0 and 3, and a log of snapshot 0 that leads from C to A."""
    folder = Scratch(spark).root + "/files"
    store = files.HadoopFiles(spark, folder, "orders")
    header = codec.Header("snapshot", "orders", (codec.Field("text", "made by a query"),))
    files.export_snapshot(_bytes(spark, d, "C"), store, 0, header, codec.Meta(1, 946684800))
    files.export_snapshot(_bytes(spark, d, "A"), store, 3, header, codec.Meta(2, 946688400))
    delta = changes.diff(_bytes(spark, d, "C").withColumnRenamed("data", "elt"), _bytes(spark, d, "A").withColumnRenamed("data", "elt"))
    with Scratch(spark) as scratch:
        rows = scratch.cut(delta.select(F.lit(0).cast("bigint").alias("seq"), "elt_id", "op", F.col("elt").alias("data")))
        one = codec.Commit(b"\1" * 32, (b"\2" * 32,), codec.Meta(2, 946688400))
        files.export_log(rows, [one], store, 0, 1, codec.Header("log", "orders"))
    return files.HadoopFiles(spark, folder)


def binary_snapshots(spark, d):
    found = files.read(spark, _exported(spark, d).folder, "elements", "orders")
    return found.select("ss", "elt_id", F.decode("data", "utf-8").alias("elt"))


def binary_states(spark, d):
    return files.read(spark, _exported(spark, d).folder, "states").select("ss", "number", F.timestamp_seconds("ts").cast("string").alias("time"), "n_elements")


def binary_log(spark, d):
    return files.read(spark, _exported(spark, d).folder, "changes").select("cl", "seq", "elt_id", "op", F.decode("data", "utf-8").alias("elt"))


def binary_catalogue(spark, d):
    return files.lengths(files.catalogue(spark, _exported(spark, d).folder))


# ---- commits and elements ----


def commit_changes(spark, d):
    """Each commit's changes by ascending unsigned id."""
    from pyspark.sql import Window

    c = table(spark, d, "changes").select(F.hex(sums.state_key("statesum")).alias("state"), "elt_id", sums.digits("op").alias("op")).where("state IS NOT NULL").distinct()
    w = Window.partitionBy("state").orderBy(*changes.unsigned_order("elt_id"), "op")
    return c.select("state", changes.unsigned("elt_id").cast("string").alias("id_text"), "op", F.row_number().over(w).alias("pos"))


def commit_meta(spark, d):
    c = table(spark, d, "commits").select(sums.sum_text(sums.sum_bytes("statesum")).alias("statesum"), "number", "ext_flags", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")).distinct()
    time = F.date_format(meta.date_time(F.floor(F.col("micros") / 1_000_000)), "yyyy-MM-dd HH:mm:ss")
    return c.select("statesum", meta.next_number(F.col("number")).alias("next_number"), time.alias("time"), meta.unknown_essential(F.col("ext_flags")).alias("unknown"))


def known_states(spark, d):
    """States that come more than once count once, at their greatest number."""
    c = table(spark, d, "commits").select(sums.sum_text(sums.sum_bytes("statesum")).alias("statesum"), "number").where("statesum IS NOT NULL")
    return dag.known_once(c)


def property_counts(spark, d):
    return meta.Property("bucket", lambda elt: F.floor(elt / 50_000)).counts(state(spark, d, "A"))


def state_sides(spark, d):
    both = changes.sides(state(spark, d, "A"), state(spark, d, "B"))
    return both.groupBy("in_old", "in_new").agg(F.count(F.lit(1)).alias("n"))


def free_ids_bulk(spark, d):
    """A new id for every customer, free in A, B and C."""
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("elt_id"))
    return changes.ranked_new_ids(wanted, three(spark, d))


def free_ids_wrapped(spark, d):
    """As free_ids_bulk where ids are taken up to the end of the unsigned range: there is room below only."""
    taken = table(spark, d, "orders").select((-1 - F.col("o_orderkey")).alias("elt_id"))
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("elt_id"))
    return changes.ranked_new_ids(wanted, [taken, wanted])


def newest_snapshot(spark, d):
    s = table(spark, d, "snapshots").where("repo_id IS NOT NULL AND ss IS NOT NULL")
    return s.groupBy("repo_id").agg(F.max("ss").alias("ss"))


def merge_own_solver(spark, d):
    """A solver that Columns can't say is a pandas UDF: here the greater payload wins."""

    @F.pandas_udf("string")
    def greater(pa: pd.Series, pb: pd.Series, pc: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(["A" if x and (not y or m >= n) else "B" for x, y, m, n in zip(pa, pb, a, b)])

    return merge.solve(_found(spark, d), merge.by_element(greater)).select("elt_id", "outcome")


# ---- small functions ----


def _nation(spark, d):
    return table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))


def bytes_shown(spark, d):
    data = F.encode(F.concat("n_name", F.lit("'\\\t")), "utf-8")
    return _nation(spark, d).select("n_nationkey", text.escaped_udf(data).alias("escaped"), text.hex_dump_udf(F.encode(F.substring("n_name", 1, 16), "utf-8")).alias("dump"))


def small_functions(spark, d):
    k = F.col("k")
    tail = F.array(k, k % 3, k % 2, F.lit(0))
    digits = F.when(k % 3 == 0, F.concat(F.lit("2016"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("v"), k.cast("string"))).otherwise("")
    data = F.when(k % 2 == 0, F.encode("n_name", "utf-8")).otherwise(F.unhex(F.lit("FFFE")))
    kept = text.text_or_bytes(data)
    return _nation(spark, d).select(
        "n_nationkey", F.size(text.rtrim(tail, 0)).alias("trimmed"), text.version_of(digits).alias("version"), text.padding(F.length("n_name")).alias("padding"),
        kept["str"].alias("as_text"), F.hex(kept["bin"]).alias("as_bytes"),
    )


def doubles_roundtrip(spark, d):
    elt = sequences.from_bytes(sequences.to_bytes(sequences.power(F.col("k"), F.lit(2.0))))
    return _nation(spark, d).select("n_nationkey", F.posexplode(elt).alias("i", "x"))


QUERIES = {
    f.__name__: f
    for f in (
        repo_states, repo_commits, repo_merged, binary_snapshots, binary_states, binary_log, binary_catalogue, commit_changes, commit_meta, known_states, property_counts,
        state_sides, free_ids_bulk, free_ids_wrapped, newest_snapshot, merge_own_solver, bytes_shown, small_functions, doubles_roundtrip,
    )
}

AS_TEXT = "CAST(CAST(elt AS DECIMAL(18,2)) AS VARCHAR)"
D = DIGITS.format
SQL = {
    "repo_states": f"WITH {STATES} SELECT 'C' AS state, elt_id, elt FROM c UNION ALL SELECT 'A', elt_id, elt FROM a",
    "repo_commits": f"""WITH {STATES}, x AS (SELECT 'A' AS s, count(*) AS n FROM ({diff('c', 'a')}) UNION ALL SELECT 'B', count(*) FROM ({diff('c', 'b')}))
  SELECT CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS n_changes, CAST(0 AS INT) AS n_parents, false AS is_tip UNION ALL SELECT 1, (SELECT count(*) FROM c), 1, false UNION ALL SELECT 2, n, 1, true FROM x""",
    "repo_merged": f"""{NAMED}, v AS ({VS_A}) SELECT elt_id, elt FROM a WHERE elt_id NOT IN (SELECT elt_id FROM v WHERE op <> 'INS') UNION ALL SELECT elt_id, elt FROM v WHERE op <> 'DEL'""",
    "binary_snapshots": f"WITH {STATES} SELECT CAST(0 AS BIGINT) AS ss, elt_id, {AS_TEXT} AS elt FROM c UNION ALL SELECT 3, elt_id, {AS_TEXT} FROM a",
    "binary_states": f"""WITH {STATES} SELECT CAST(0 AS BIGINT) AS ss, CAST(1 AS BIGINT) AS number, '2000-01-01 00:00:00' AS time, count(*) AS n_elements FROM c
  UNION ALL SELECT 3, 2, '2000-01-01 01:00:00', count(*) FROM a""",
    "binary_log": f"WITH {STATES}, x AS ({diff('c', 'a')}) SELECT CAST(1 AS BIGINT) AS cl, CAST(0 AS BIGINT) AS seq, elt_id, op, {AS_TEXT} AS elt FROM x",
    "binary_catalogue": "SELECT CAST(4 AS BIGINT) AS ss_len, CAST(2 AS BIGINT) AS cl_len, CAST(2 AS BIGINT) AS n_snapshots, CAST(1 AS BIGINT) AS n_logs",
    "commit_changes": f"""WITH c AS (SELECT DISTINCT left({D('statesum')}, 32) AS state, elt_id, {D('op')} AS op FROM changes WHERE length({D('statesum')}) >= 32),
  u AS (SELECT *, CASE WHEN elt_id < 0 THEN CAST(elt_id AS HUGEINT) + 18446744073709551616 ELSE CAST(elt_id AS HUGEINT) END AS u FROM c)
  SELECT state, CAST(u AS VARCHAR) AS id_text, op, CAST(row_number() OVER (PARTITION BY state ORDER BY u, op) AS INT) AS pos FROM u""",
    "commit_meta": f"""WITH c AS (SELECT DISTINCT CASE WHEN length({D('statesum')}) = 64 THEN {D('statesum')} END AS statesum, number, ext_flags, ts FROM commits)
  SELECT statesum, least(number + 1, 4294967295) AS next_number, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS time, (ext_flags & 21844) <> 0 AS unknown FROM c""",
    "known_states": f"SELECT {D('statesum')} AS statesum, max(number) AS number FROM commits WHERE length({D('statesum')}) = 64 GROUP BY 1",
    "property_counts": f"WITH {STATES} SELECT CAST(floor(elt / 50000) AS BIGINT) AS bucket, count(*) AS n FROM a GROUP BY 1",
    "state_sides": f"WITH {STATES} SELECT a.elt_id IS NOT NULL AS in_old, b.elt_id IS NOT NULL AS in_new, count(*) AS n FROM a FULL JOIN b ON a.elt_id = b.elt_id GROUP BY 1, 2",
    "free_ids_bulk": f"""WITH {STATES}, top AS (SELECT max(elt_id) AS top FROM (SELECT elt_id FROM a UNION ALL SELECT elt_id FROM b UNION ALL SELECT elt_id FROM c))
  SELECT c_custkey AS elt_id, top + row_number() OVER (ORDER BY c_custkey) AS new_id FROM customer, top""",
    "free_ids_wrapped": "SELECT CAST(n_nationkey AS BIGINT) AS elt_id, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY n_nationkey) AS new_id FROM nation",
    "newest_snapshot": "SELECT repo_id, max(ss) AS ss FROM snapshots WHERE repo_id IS NOT NULL AND ss IS NOT NULL GROUP BY 1",
    "merge_own_solver": f"{JOINED} SELECT elt_id, CASE WHEN pa AND (NOT pb OR a >= b) THEN 'A' ELSE 'B' END AS outcome FROM s",
    "bytes_shown": r"""SELECT n_nationkey, concat(n_name, '\''\\\x09') AS escaped,
  concat(rpad(rtrim(regexp_replace(hex(encode(n_name)), '(..)', '\1 ', 'g')), 47, ' '), '  ', replace(n_name, ' ', '.')) AS dump FROM nation""",
    "small_functions": """WITH n AS (SELECT n_nationkey AS k, n_name FROM nation)
  SELECT k AS n_nationkey, CAST(CASE WHEN k % 2 <> 0 THEN 3 WHEN k % 3 <> 0 THEN 2 WHEN k <> 0 THEN 1 ELSE 0 END AS INT) AS trimmed,
    CAST(CASE WHEN k % 3 = 0 THEN concat('2016', k) ELSE '0' END AS INT) AS version, CAST((16 - length(n_name) % 16) % 16 AS INT) AS padding,
    CASE WHEN k % 2 = 0 THEN n_name END AS as_text, CASE WHEN k % 2 <> 0 THEN 'FFFE' END AS as_bytes FROM n""",
    "doubles_roundtrip": "SELECT n_nationkey, CAST(i AS INT) AS i, CAST(i * i AS DOUBLE) AS x FROM nation, unnest(range(n_nationkey)) AS t(i)",
}
