"""A workload of number sequences: python examples/sequences.py PATH [--commits N] [--rows N] [--seed N] [--snapshot] [--list N]"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata.errors import OtherError
from strata.functions import sequences
from strata.operators import merge
from strata.repository import Repository

p = argparse.ArgumentParser()
p.add_argument("path")
p.add_argument("--commits", type=int, default=1)
p.add_argument("--rows", type=int, default=50)
p.add_argument("--seed", type=int, default=1)
p.add_argument("--list", type=int, default=0)
p.add_argument("--snapshot", action="store_true")
a = p.parse_args()

spark = SparkSession.builder.appName("sequences").getOrCreate()
try:
    repo = Repository.open(spark, a.path)
except OtherError:
    repo = Repository.create(spark, a.path, "sequences", "array<double>")
if repo.merge_required():
    repo.merge(merge.chain(merge.ancestor, merge.renaming))
for i in range(a.commits):
    new = sequences.generated(spark, a.rows, a.seed + 10 * i)
    top = repo.state().agg(F.coalesce(F.max("elt_id"), F.lit(-1))).first()[0]
    repo.draft().insert(new.withColumn("elt_id", F.col("elt_id") + top + 1)).push()
    repo.write_full()
if a.snapshot:
    repo.write_snapshot()
sequences.statistics(repo.state()).show()
if a.list:
    repo.state().orderBy("elt_id").limit(a.list).show()
