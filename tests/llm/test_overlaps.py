"""Of overlapping candidates the best is kept, and one that overlaps only dropped ones too."""

from terraloom.llm import pii


def test_chain_keeps_both_ends(spark):
    kind = "array<struct<loss:double,s:struct<start:int,rank:int,kind:string,end:int>>>"
    a, b, c, far = (-3.0, (0, 2, "card", 10)), (-2.0, (8, 3, "phone", 20)), (-1.0, (18, 1, "ip", 30)), (-0.5, (40, 0, "email", 50))
    df = spark.createDataFrame([([b, c, a, far],), ([],), ([c, b],)], f"good {kind}")
    got = [{(s.start, s.end) for s in r.s} for r in df.select(pii.chosen(df.good).alias("s")).collect()]
    assert got == [{(0, 10), (18, 30), (40, 50)}, set(), {(8, 20)}]
