"""Opens or creates a repository, lists its elements and adds one: python examples/hello.py PATH [TEXT]"""

import sys

from pyspark.sql import SparkSession

from strata.errors import OtherError
from strata.repository import Repository

spark = SparkSession.builder.appName("hello").getOrCreate()
path = sys.argv[1]
try:
    repo = Repository.open(spark, path)
except OtherError:
    repo = Repository.create(spark, path, "hello")
repo.state().show(truncate=False)
if len(sys.argv) > 2:
    draft = repo.draft()
    print("inserted as", draft.insert_new(sys.argv[2]))
    print("state", draft.push())
    repo.write_full()
