"""What the JVM makes of line dedup's plans."""

from gleanery.llm import line_dedup
from gleanery.llm.common import settings
from pyspark.sql import functions as F

#: Methods of more bytes of code than this are never compiled.
HUGE = 8000


def largest_methods(df):
    code = df._jdf.queryExecution().debug().codegenToSeq()
    return [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]


def test_filters_of_first_pairs_are_compiled(spark):
    sets = spark.range(10).select("id", F.lit(3).alias("n"), *[F.col("id").alias(c) for c in ("sig", "sig_a", "sig_b")], F.array(F.lit(1), F.lit(2)).alias("words"))
    with settings(spark, spark__sql__adaptive__enabled="false"):
        pairs = line_dedup.lead_pairs(sets, line_dedup.Similarity())
        sizes, plan = largest_methods(pairs), pairs._jdf.queryExecution().executedPlan().toString()
    assert sizes and max(sizes) < HUGE
    # Lambdas on arrays, and all that they are applied to, are never made into code.
    assert "lambda" not in plan
