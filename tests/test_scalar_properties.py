"""Scalar functions against Python's own implementations on random inputs."""
import datetime
import random
import string
from urllib.parse import quote
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from assetflow.functions import hashing as H
from assetflow.functions import numbers as N
from assetflow.functions import paths as P
from assetflow.functions import timefmt as TF


def _to_base(n, b):
    digits = string.digits + string.ascii_uppercase
    out = ""
    while True:
        n, r = divmod(n, b)
        out = digits[r] + out
        if n == 0:
            return out


def test_base_conversion(spark):
    rnd = random.Random(1)
    vals = [0, 1, 7, 8, 255, 2 ** 40 + 3] + [rnd.randrange(2 ** 50) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    cols = [N.from_base10(F.col("v"), b).alias(f"b{b}") for b in (2, 8, 16, 36)]
    for r in df.select("v", *cols, N.to_base10(N.from_base10(F.col("v"), 36), 36).alias("back")).collect():
        assert (r.b2, r.b8, r.b16, r.b36) == tuple(_to_base(r.v, b) for b in (2, 8, 16, 36))
        assert r.back == r.v


def test_bits_to_hex_random_lengths(spark):
    rnd = random.Random(2)
    bits = ["0", "1", "0000", "0001"] + ["".join(rnd.choice("01") for _ in range(rnd.randrange(1, 300)))
                                         for _ in range(80)]
    df = spark.createDataFrame([(b,) for b in bits], "b string")
    for r in df.select("b", H.bits_to_hex(F.col("b")).alias("h")).collect():
        assert r.h == hex(int(r.b, 2))


def test_quote_random_unicode(spark):
    rnd = random.Random(3)
    alphabet = string.ascii_letters + string.digits + " /._-~*+!'()?#&=%é中文ß€ "
    paths = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 30))) for _ in range(100)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(P.quote_path(F.col("p"))).collect()]
    assert got == [quote(p) for p in paths]


def test_format_epoch_matches_zoneinfo(spark):
    rnd = random.Random(4)
    secs = [0, 1709449200, 1710064800, 1730613600] + [rnd.randrange(0, 2 ** 31) for _ in range(60)]
    df = spark.createDataFrame([(s * 1000 + rnd.randrange(1000),) for s in secs], "ms long")
    tz = "America/Los_Angeles"
    rows = df.select("ms", TF.format_epoch(F.col("ms"), "ms").alias("utc"),
                     TF.format_epoch(F.col("ms"), "ms", tz).alias("local")).collect()
    for r in rows:
        t = datetime.datetime.fromtimestamp(r.ms // 1000, ZoneInfo("UTC"))
        assert r.utc == t.strftime("%Y-%m-%d-%H:%M:%S") + ".000000000"
        assert r.local == t.astimezone(ZoneInfo(tz)).strftime("%Y-%m-%d-%H:%M:%S") + ".000000000"
