"""Driver contract: entry, every registered query at the smallest scale."""
import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["hash_type", "hash", "path", "size", "w", "h", "n_members", "action", "dst"]


def test_every_query_runs(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SF_SMALL)
        assert len(df.columns) == len(set(df.columns)), name
        df.write.format("noop").mode("overwrite").save()
